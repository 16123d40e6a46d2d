"""Frame counts given at 30 fps, at another rate. Python rounds half to even, as the feature definitions want."""


def scale(frames: int, fps: float, reference: float = 30.0) -> int:
    """At least one frame."""
    return max(1, round(frames * float(fps) / reference))


def scale_signed(frames: int, fps: float, reference: float = 30.0) -> int:
    """Keeps the sign; zero stays zero."""
    if frames == 0:
        return 0
    return scale(abs(frames), fps, reference) * (1 if frames > 0 else -1)

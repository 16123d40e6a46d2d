"""Features of one individual: one row per (video, individual, frame).

Every function takes a Track with ``<part>_x`` and ``<part>_y`` columns in cm
and adds its columns; windows and lags given at 30 fps are scaled to the
track's rate. Columns that need longer trajectories are NULL on shorter ones.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rolling import Roll, Track, centred, ewm, future, trailing
from ..functions.scalars import clipped, cosine, finite, indicator, norm, over, square
from ..functions.scaling import scale, scale_signed

# Lags in frames at 30 fps.
LAGS = (1, 2, 3, 4, 5, 10, 20, 30, 40, 50, 60)


def squared_distance(p1: str, p2: str) -> Column:
    return square(F.col(f"{p1}_x") - F.col(f"{p2}_x")) + square(F.col(f"{p1}_y") - F.col(f"{p2}_y"))


def geometry(track: Track, parts: list[str]) -> Track:
    """Squared distances of all part pairs, elongation, body angle."""
    track = track.add({f"{a}+{b}": squared_distance(a, b) for a, b in combinations(parts, 2)})
    more: dict[str, Column] = {}
    if {"nose+tail_base", "ear_left+ear_right"} <= set(track.df.columns):
        more["elong"] = over(F.col("nose+tail_base"), F.col("ear_left+ear_right"))
    if {"nose", "body_center", "tail_base"} <= set(parts):
        to = lambda p, axis: F.col(f"{p}_{axis}") - F.col(f"body_center_{axis}")
        more["body_ang"] = cosine(to("nose", "x"), to("nose", "y"), to("tail_base", "x"), to("tail_base", "y"))
    return track.add(more) if more else track


def lagged_displacement(track: Track) -> Track:
    """Squared way of the ears from where ears and tail base were some frames ago."""
    names = {"sp_lf": ("ear_left", "ear_left"), "sp_rt": ("ear_right", "ear_right"), "sp_lf2": ("ear_left", "tail_base"), "sp_rt2": ("ear_right", "tail_base")}
    out = {}
    for base in LAGS:
        lag = scale(base, track.fps)
        for name, (now, then) in names.items():
            out[f"{name}_l{base}"] = sum((square(F.col(f"{now}_{a}") - track.lag(f"{then}_{a}", lag)) for a in "xy"), F.lit(0.0))
    track = track.add(out)
    return track.add({name: F.col(f"{name}_l10") for name in names})


def centre_motion(track: Track) -> Track:
    """Velocity of the body centre by frame, and its raw and filled speed in cm/s."""
    track = track.add({"__vx": track.diff("body_center_x"), "__vy": track.diff("body_center_y")})
    return track.add({"__raw": norm(F.col("__vx"), F.col("__vy")) * track.fps}).add({"__v": F.coalesce("__raw", F.lit(0.0))})


def centre_statistics(track: Track) -> Track:
    """Mean, spread and range of the position; displacement and activity."""
    track = centre_motion(track)
    rolls: dict[str, Roll] = {}
    for w in (5, 15, 30, 60):
        ws = scale(w, track.fps)
        for a in "xy":
            c = f"body_center_{a}"
            rolls |= {f"c{a}_m{w}": centred(c, "mean", ws), f"c{a}_s{w}": centred(c, "std", ws)}
            rolls |= {f"__mx{a}{w}": centred(c, "max", ws), f"__mn{a}{w}": centred(c, "min", ws)}
            rolls |= {f"__d{a}{w}": trailing(f"__v{a}", "sum", ws), f"__a{a}{w}": trailing(f"__v{a}", "var", ws)}
    track = track.roll(rolls)
    out = {}
    for w in (5, 15, 30, 60):
        out |= {f"{a}_rng{w}": F.col(f"__mx{a}{w}") - F.col(f"__mn{a}{w}") for a in "xy"}
        out |= {f"disp{w}": norm(F.col(f"__dx{w}"), F.col(f"__dy{w}")), f"act{w}": F.sqrt(F.col(f"__ax{w}") + F.col(f"__ay{w}"))}
    return track.add(out)


def curvature(track: Track) -> Track:
    """Mean curvature of the path, and the sum of heading changes (angles aren't unwrapped)."""
    track = centre_motion(track)
    track = track.add({"__ax": track.diff("__vx"), "__ay": track.diff("__vy"), "__angle": F.atan2("__vy", "__vx")})
    vx, vy = F.col("__vx"), F.col("__vy")
    curve = over(F.abs(vx * F.col("__ay") - vy * F.col("__ax")), F.pow(norm(vx, vy), F.lit(3.0)))
    track = track.add({"__curve": curve, "__turn": F.abs(track.diff("__angle"))})
    rolls = {f"curv_mean_{w}": trailing("__curve", "mean", ws, max(1, ws // 6)) for w in (30, 60) for ws in [scale(w, track.fps)]}
    ws = scale(30, track.fps)
    return track.roll(rolls | {"turn_rate_30": trailing("__turn", "sum", ws, max(1, ws // 6))})


def multiscale_speed(track: Track) -> Track:
    """Mean and spread of the speed over three windows, and the ratio of the outer means."""
    track, widths = centre_motion(track), {w: scale(w, track.fps) for w in (10, 40, 160)}
    rolls = {f"sp_{k}{w}": trailing("__raw", kind, ws, max(1, ws // 4)) for w, ws in widths.items() for k, kind in (("m", "mean"), ("s", "std"))}
    track = track.roll(rolls, length=True)
    track = track.add({f"sp_{k}{w}": track.long_enough(ws, F.col(f"sp_{k}{w}")) for w, ws in widths.items() for k in "ms"})
    return track.add({"sp_ratio": over(F.col("sp_m10"), F.col("sp_m160"))})


def speed_states(track: Track) -> Track:
    """Shares of four speed states and the number of changes between them. A change from or to no state counts."""
    track, ma = centre_motion(track), scale(15, track.fps)
    track = track.roll({"__ma": trailing("__raw", "mean", ma, max(1, ma // 3))})
    c = F.col("__ma")
    # Bounds of the states in cm/s.
    state = F.when(c <= 0.5 * track.fps, 0).when(c <= 2.0 * track.fps, 1).when(c <= 5.0 * track.fps, 2).when(c.isNotNull(), 3)
    track = track.add({"__state": state})
    flags = {f"__is{k}": indicator(F.col("__state") == k) for k in range(4)}
    flags["__change"] = F.coalesce(F.col("__state") != track.lag("__state"), F.lit(True)).cast("double")
    track, rolls, widths = track.add(flags), {}, {w: scale(w, track.fps) for w in (60, 120)}
    for w, ws in widths.items():
        rolls |= {f"s{k}_{w}": trailing(f"__is{k}", "mean", ws, max(1, ws // 6)) for k in range(4)}
        rolls[f"trans_{w}"] = trailing("__change", "sum", ws, max(1, ws // 6))
    track = track.roll(rolls, length=True)
    return track.add({n: track.long_enough(widths[int(n.split("_")[1])], F.col(n)) for n in rolls})


def long_range(track: Track) -> Track:
    """Long moving averages of the position and the speed's percentile rank."""
    track, rolls, widths = centre_motion(track), {}, {}
    for w in (30, 60, 120, 240, 480):
        ws = scale(w, track.fps)
        for a in "xy":
            rolls[f"{a}_ml{w}"] = trailing(f"body_center_{a}", "mean", ws, max(5, ws // 6))
            widths[f"{a}_ml{w}"] = ws
    for w in (15, 30, 60, 120, 240):
        ws = widths[f"sp_pct{w}"] = scale(w, track.fps)
        rolls[f"sp_pct{w}"] = trailing("__raw", "rank", ws, max(5, ws // 6))
    track = track.roll(rolls, length=True)
    return track.add({n: track.long_enough(ws, F.col(n)) for n, ws in widths.items()})


def smoothing_spans(fps: float) -> dict[str, tuple[str, int]]:
    return {f"{a}_e{s}": (f"body_center_{a}", scale(s, fps)) for s in (15, 30, 60, 120, 240) for a in "xy"}


def smoothed_position(track: Track):
    """Exponentially weighted means of the position, as a table by key and frame."""
    return ewm(track, smoothing_spans(track.fps))


def smoothing(track: Track) -> Track:
    """The same as columns; a mean has all earlier values, so its frame has no least number of them."""
    return track.roll({n: trailing(c, "ewm", span, 0) for n, (c, span) in smoothing_spans(track.fps).items()})


def path_length(track: Track) -> Track:
    """Way gone from 6 s before to 6 s after; 0 where too little is known."""
    track = track.add({"__step": F.hypot(track.diff("body_center_x"), track.diff("body_center_y"))})
    half = scale(180, track.fps)
    track = track.roll({"path_cum180": Roll("__step", "sum", -half, half, max(5, half // 6))})
    return track.add({"path_cum180": F.coalesce("path_cum180", F.lit(0.0))})


def grooming(track: Track) -> Track:
    """Head moving without the body: speed ratio, spread of the nose's distance, jitter of the body axis."""
    track = centre_motion(track).add({"__nx": track.diff("nose_x"), "__ny": track.diff("nose_y")})
    axis = F.atan2(F.col("nose_y") - F.col("tail_base_y"), F.col("nose_x") - F.col("tail_base_x"))
    radius = norm(F.col("nose_x") - F.col("body_center_x"), F.col("nose_y") - F.col("body_center_y"))
    nose = F.coalesce(norm(F.col("__nx"), F.col("__ny")) * track.fps, F.lit(0.0))
    track = track.add({"__ratio": clipped(over(nose, F.col("__v"), 1e-3), 0.0, 10.0), "__radius": radius, "__axis": axis})
    track, ws = track.add({"__jitter": F.coalesce(F.abs(track.diff("__axis")), F.lit(0.0))}), scale(30, track.fps)
    least = max(1, ws // 3)
    track = track.roll({
        "head_body_decouple": trailing("__ratio", "median", ws, least), "nose_rad_std": trailing("__radius", "std", ws, least),
        "head_orient_jitter": trailing("__jitter", "mean", ws, least),
    })
    return track.add({"nose_rad_std": F.coalesce("nose_rad_std", F.lit(0.0))})


def speed_asymmetry(track: Track, median: bool = False) -> Track:
    """Mean (or median) speed of the next second less that of the last one."""
    track, w = centre_motion(track), max(3, scale(30, track.fps))
    kind, least = "median" if median else "mean", max(3, w // 4)
    track = track.roll({"__past": trailing("__v", kind, w, least), "__next": future("__v", kind, w, least)})
    return track.add({"spd_asym_1s": F.coalesce(F.col("__next") - F.col("__past"), F.lit(0.0))})


def speed_shift(track: Track, eps: float = 1e-6) -> Track:
    """Symmetric Kullback-Leibler divergence of normal fits to the speed before and after."""
    track, w = centre_motion(track), max(5, scale(30, track.fps))
    least = max(3, w // 4)
    track = track.roll({f"__{k}_{s}": f("__v", k, w, least) for k in ("mean", "var") for s, f in (("p", trailing), ("f", future))})
    mp, mf, vp, vf = F.col("__mean_p"), F.col("__mean_f"), clipped(F.col("__var_p"), eps), clipped(F.col("__var_f"), eps)
    gap = square(mf - mp)
    one = lambda a, b: F.lit(0.5) * (a / b + gap / b - F.lit(1.0) + F.log(b / a))
    return track.add({"spd_symkl_1s": F.coalesce(finite(one(vp, vf) + one(vf, vp)), F.lit(0.0))})


def segments(track: Track, pause: float = 2.0) -> Track:
    """Trend of the speed, acceleration, jerk and share of pauses around each frame."""
    track = centre_motion(track)
    track = track.add({"__acc": track.diff("__v") * track.fps, "__pause": indicator(F.col("__v") < pause)})
    track, rolls = track.add({"__jerk": track.diff("__acc") * track.fps}), {}
    for h in (30, 90):
        w = max(3, scale(h, track.fps))
        least = max(3, w // 3)
        rolls |= {
            f"sp_sl_{h}": centred("__v", "slope", w, least), f"acc_m_{h}": centred("__acc", "mean", w, least),
            f"acc_v_{h}": centred("__acc", "var", w, least), f"jerk_m_{h}": centred("__jerk", "mean", w, least),
            f"pause_r_{h}": centred("__pause", "mean", w),
        }
    return track.roll(rolls)


def nose_tail(track: Track) -> Track:
    track = track.add({"__nt": F.sqrt(squared_distance("nose", "tail_base"))})
    out = {}
    for base in (10, 20, 40):
        lag = scale(base, track.fps)
        out |= {f"nt_lg{base}": track.lag("__nt", lag), f"nt_df{base}": track.diff("__nt", lag)}
    return track.add(out)


def ears(track: Track) -> Track:
    """Distance of the ears before and after, and its coefficient of variation."""
    track = track.add({"__ear": F.sqrt(squared_distance("ear_left", "ear_right"))})
    track = track.add({f"ear_o{off}": track.lag("__ear", -scale_signed(off, track.fps)) for off in (-20, -10, 10, 20)})
    ws = scale(30, track.fps)
    track = track.roll({"__es": centred("__ear", "std", ws), "__em": centred("__ear", "mean", ws)})
    return track.add({"ear_con": over(F.col("__es"), F.col("__em"))})

"""Building blocks for the SQL that the feature queries are held against.

Plain sliding frames, written independently of the running-sum form of the
engine.
"""

from __future__ import annotations

from ..functions.scaling import scale
from .views import with_views

FPS = (30, 25, 60)


def out(c: str) -> str:
    v = f'("{c}" + CAST(3.1e-9 AS DOUBLE))'
    return (
        f"CASE WHEN abs({v}) < 5e-7 THEN CAST(0 AS DOUBLE) WHEN abs({v}) < 1e3 THEN round({v}, 6)"
        f' WHEN abs({v}) < 1e6 THEN round({v}, 3) ELSE round({v}, 0) END AS "{c}"'
    )


class Sql:
    """Layers of SELECTs over a view, one copy for each frame rate."""

    def __init__(self, source: str, keys: tuple[str, ...], fps: float):
        self.keys, self.fps, self.source, self.layers = keys, fps, source, []

    @property
    def part(self) -> str:
        return f"PARTITION BY {', '.join(self.keys)} ORDER BY video_frame"

    def add(self, **columns: str) -> "Sql":
        self.layers.append({k.replace("__p__", "+"): v for k, v in columns.items()})
        return self

    def lag(self, c: str, n: int = 1) -> str:
        return f"lag({c}, {n}) OVER ({self.part})" if n >= 0 else f"lead({c}, {-n}) OVER ({self.part})"

    def diff(self, c: str, n: int = 1) -> str:
        return f"({c} - {self.lag(c, n)})"

    def frame(self, lo: int, hi: int) -> str:
        side = lambda n: f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING" if n else "CURRENT ROW"
        return f"OVER ({self.part} ROWS BETWEEN {side(lo)} AND {side(hi)})"

    def roll(self, kind: str, c: str, lo: int, hi: int, least: int = 1) -> str:
        f = self.frame(lo, hi)
        value = {
            "mean": f"avg({c}) {f}", "sum": f"sum({c}) {f}", "std": f"stddev_samp({c}) {f}", "var": f"var_samp({c}) {f}",
            "min": f"min({c}) {f}", "max": f"max({c}) {f}", "median": f"median({c}) {f}", "count": f"CAST(count({c}) {f} AS DOUBLE)",
        }[kind]
        return f"CASE WHEN count({c}) {f} >= {least} THEN {value} END"

    def trailing(self, kind: str, c: str, ws: int, least: int = 1) -> str:
        return self.roll(kind, c, 1 - ws, 0, least)

    def centred(self, kind: str, c: str, ws: int, least: int = 1) -> str:
        return self.roll(kind, c, -(ws // 2), (ws - 1) // 2, least)

    def future(self, kind: str, c: str, ws: int, least: int = 1) -> str:
        return self.roll(kind, c, 0, ws - 1, least)

    def long(self, ws: int, value: str) -> str:
        return f"CASE WHEN count(*) OVER (PARTITION BY {', '.join(self.keys)}) >= {ws} THEN {value} END"

    def scale(self, n: int) -> int:
        return scale(n, self.fps)

    def text(self, columns: list[str]) -> str:
        inner = f"(SELECT * FROM {self.source} WHERE fps = {self.fps})"
        for layer in self.layers:
            inner = f"(SELECT *, {', '.join(f'{v} AS "{k}"' for k, v in layer.items())} FROM {inner})"
        return f"SELECT {', '.join(self.keys)}, video_frame, {', '.join(map(out, columns))} FROM {inner}"


def per_rate(source: str, keys: tuple[str, ...], build, columns: list[str], before: str = "") -> str:
    """``build(Sql)`` for each rate, in one query; ``before``: common tables of its own."""
    parts = []
    for fps in FPS:
        s = Sql(source, keys, fps)
        build(s)
        parts.append(s.text(columns))
    return with_views(before + " UNION ALL ".join(parts))

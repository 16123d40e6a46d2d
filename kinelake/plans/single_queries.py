"""Queries of the single-individual features, on pose rows of three frame rates, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import Track, centred, future, trailing
from ..operators import single
from .oracle import FPS, Sql, out, per_rate
from .views import view, with_views

KEYS = ("video_id", "mouse_id")
PARTS = ["body_center", "nose", "tail_base", "ear_left", "ear_right"]
LAGS = single.LAGS


def rounded(df: DataFrame, keys: tuple[str, ...], columns: list[str]) -> DataFrame:
    """Values to six digits, or fewer where they are large. A tiny shift keeps exact halves, common here, off the edge."""
    shown = []
    for name in columns:
        c = F.col(f"`{name}`") + 3.1e-9
        digits = F.when(F.abs(c) < 5e-7, 0.0).when(F.abs(c) < 1e3, F.round(c, 6)).when(F.abs(c) < 1e6, F.round(c, 3)).otherwise(F.round(c, 0))
        shown.append(F.when(c.isNotNull(), digits).alias(name))
    return df.select(*keys, "video_frame", *shown)


def by_rate(df: DataFrame, keys: tuple[str, ...], f) -> DataFrame:
    """One plan for each frame rate: frame bounds are literals. The rates are a handful of constants of the data set."""
    return reduce(DataFrame.unionByName, (f(Track(df.filter(F.col("fps") == fps), keys, fps)) for fps in FPS))


def feature(f, columns: list[str], keys=KEYS, source="pose"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return by_rate(view(spark, sf_dir, source), keys, lambda t: rounded(f(t).df, keys, columns))

    return query


def sq(p1: str, p2: str) -> str:
    return f"(({p1}_x - {p2}_x) * ({p1}_x - {p2}_x) + ({p1}_y - {p2}_y) * ({p1}_y - {p2}_y))"


def motion(s: Sql) -> Sql:
    s.add(vx=s.diff("body_center_x"), vy=s.diff("body_center_y"))
    s.add(raw=f"sqrt(vx * vx + vy * vy) * {s.fps}")
    return s.add(v="coalesce(raw, 0)")


QUERIES: dict = {}
ORACLES: dict = {}
#: The function and columns of each query of features.
FEATURES: dict = {}


def register(name: str, f, columns: list[str], build) -> None:
    FEATURES[name] = (f, columns)
    QUERIES[name] = feature(f, columns)
    ORACLES[name] = per_rate("pose", KEYS, build, columns)


# Window primitives.
def _primitives(t: Track) -> Track:
    t = t.add({"x": F.col("body_center_x"), "y": F.col("body_center_y")})
    return t.add({"lag3": t.lag("x", 3), "lead2": t.lag("x", -2), "d1": t.diff("x")}).add({"d2": F.col("d1") - F.lag("d1", 1).over(t.window)})


register(
    "lag_lead", _primitives, ["lag3", "lead2", "d1", "d2"],
    lambda s: s.add(x="body_center_x").add(lag3=s.lag("x", 3), lead2=s.lag("x", -2), d1=s.diff("x")).add(d2=s.diff("d1")),
)
_KINDS = ("mean", "sum", "std", "var", "min", "max", "median")
for _name, _make in (("rolling_centered", centred), ("rolling_trailing", trailing), ("rolling_future", future)):
    _cols = [f"{k}_{w}" for k in _KINDS for w in (5, 12, 30)]

    def _rolls(t: Track, make=_make) -> Track:
        return t.roll({f"{k}_{w}": make("body_center_x", k, t_w, max(1, t_w // 4)) for k in _KINDS for w in (5, 12, 30) for t_w in [max(1, round(w * t.fps / 30))]})

    def _sql(s: Sql, kind=_make.__name__) -> None:
        s.add(**{f"{k}_{w}": getattr(s, kind)(k, "body_center_x", s.scale(w), max(1, s.scale(w) // 4)) for k in _KINDS for w in (5, 12, 30)})

    register(_name, _rolls, _cols, _sql)


# Feature groups.
_PAIRS = [(a, b) for i, a in enumerate(PARTS) for b in PARTS[i + 1 :]]


def _geometry_sql(s: Sql) -> None:
    s.add(**{f"{a}+{b}": sq(a, b) for a, b in _PAIRS})
    d = {f"{p}{c}": f"({p}_{c} - body_center_{c})" for p in ("nose", "tail_base") for c in "xy"}
    s.add(
        elong='"nose+tail_base" / ("ear_left+ear_right" + CAST(1e-6 AS DOUBLE))',
        body_ang=f"({d['nosex']} * {d['tail_basex']} + {d['nosey']} * {d['tail_basey']}) / (sqrt({d['nosex']} * {d['nosex']} + {d['nosey']} * {d['nosey']})"
        f" * sqrt({d['tail_basex']} * {d['tail_basex']} + {d['tail_basey']} * {d['tail_basey']}) + CAST(1e-6 AS DOUBLE))",
    )


# 'elong' divides by nearly nothing where the ears meet; its 6 digits there are rounding of inputs that both engines share.
register("single_geometry", lambda t: single.geometry(t, PARTS), [f"{a}+{b}" for a, b in _PAIRS] + ["elong", "body_ang"], _geometry_sql)


def _lagged_sql(s: Sql) -> None:
    names = {"sp_lf": ("ear_left", "ear_left"), "sp_rt": ("ear_right", "ear_right"), "sp_lf2": ("ear_left", "tail_base"), "sp_rt2": ("ear_right", "tail_base")}
    cols = {}
    for n in LAGS:
        for name, (a, b) in names.items():
            x, y = (f"({a}_{c} - {s.lag(f'{b}_{c}', s.scale(n))})" for c in "xy")
            cols[f"{name}_l{n}"] = f"{x} * {x} + {y} * {y}"
    s.add(**cols).add(**{name: f"{name}_l10" for name in names})


register(
    "single_speed_lags", single.lagged_displacement,
    [f"{n}_l{k}" for k in LAGS for n in ("sp_lf", "sp_rt", "sp_lf2", "sp_rt2")] + ["sp_lf", "sp_rt", "sp_lf2", "sp_rt2"], _lagged_sql,
)


def _centre_sql(s: Sql) -> None:
    motion(s)
    cols = {}
    for w in (5, 15, 30, 60):
        ws = s.scale(w)
        for c in "xy":
            b = f"body_center_{c}"
            cols |= {f"c{c}_m{w}": s.centred("mean", b, ws), f"c{c}_s{w}": s.centred("std", b, ws), f"{c}_rng{w}": f"({s.centred('max', b, ws)}) - ({s.centred('min', b, ws)})"}
        sx, sy = s.trailing("sum", "vx", ws), s.trailing("sum", "vy", ws)
        cols[f"disp{w}"] = f"sqrt(pow({sx}, 2) + pow({sy}, 2))"
        cols[f"act{w}"] = f"sqrt(({s.trailing('var', 'vx', ws)}) + ({s.trailing('var', 'vy', ws)}))"
    s.add(**cols)


register(
    "single_centre_statistics", single.centre_statistics,
    [f"{n}{w}" for w in (5, 15, 30, 60) for n in ("cx_m", "cy_m", "cx_s", "cy_s", "x_rng", "y_rng", "disp", "act")], _centre_sql,
)


def _curvature_sql(s: Sql) -> None:
    motion(s).add(ax=s.diff("vx"), ay=s.diff("vy"), ang="atan2(vy, vx)")
    s.add(curve="abs(vx * ay - vy * ax) / (pow(sqrt(vx * vx + vy * vy), 3) + CAST(1e-6 AS DOUBLE))", turn=f"abs({s.diff('ang')})")
    ws, w2 = s.scale(30), s.scale(60)
    s.add(
        curv_mean_30=s.trailing("mean", "curve", ws, max(1, ws // 6)), curv_mean_60=s.trailing("mean", "curve", w2, max(1, w2 // 6)),
        turn_rate_30=s.trailing("sum", "turn", ws, max(1, ws // 6)),
    )


register("single_curvature", single.curvature, ["curv_mean_30", "curv_mean_60", "turn_rate_30"], _curvature_sql)


def _multi_sql(s: Sql) -> None:
    motion(s)
    s.add(**{f"sp_{n}{w}": s.long(s.scale(w), s.trailing(k, "raw", s.scale(w), max(1, s.scale(w) // 4))) for w in (10, 40, 160) for n, k in (("m", "mean"), ("s", "std"))})
    s.add(sp_ratio="sp_m10 / (sp_m160 + CAST(1e-6 AS DOUBLE))")


register("single_multiscale", single.multiscale_speed, ["sp_m10", "sp_s10", "sp_m40", "sp_s40", "sp_m160", "sp_s160", "sp_ratio"], _multi_sql)


def _states_sql(s: Sql) -> None:
    ma = s.scale(15)
    motion(s).add(ma=s.trailing("mean", "raw", ma, max(1, ma // 3)))
    s.add(state=f"CASE WHEN ma <= {0.5 * s.fps} THEN 0 WHEN ma <= {2 * s.fps} THEN 1 WHEN ma <= {5 * s.fps} THEN 2 WHEN ma IS NOT NULL THEN 3 END")
    s.add(**{f"is{k}": f"CAST(coalesce(state = {k}, FALSE) AS DOUBLE)" for k in range(4)}, chg=f"CAST(coalesce(state <> {s.lag('state')}, TRUE) AS DOUBLE)")
    cols = {}
    for w in (60, 120):
        ws = s.scale(w)
        cols |= {f"s{k}_{w}": s.long(ws, s.trailing("mean", f"is{k}", ws, max(1, ws // 6))) for k in range(4)}
        cols[f"trans_{w}"] = s.long(ws, s.trailing("sum", "chg", ws, max(1, ws // 6)))
    s.add(**cols)


register("single_states", single.speed_states, [f"{n}_{w}" for w in (60, 120) for n in ("s0", "s1", "s2", "s3", "trans")], _states_sql)


def _long_sql(s: Sql) -> None:
    motion(s)
    cols = {}
    for w in (30, 60, 120, 240, 480):
        ws = s.scale(w)
        cols |= {f"{c}_ml{w}": s.long(ws, s.trailing("mean", f"body_center_{c}", ws, max(5, ws // 6))) for c in "xy"}
    for w in (15, 30, 60, 120, 240):
        cols[f"l{w}"] = f"list(raw) {s.frame(1 - s.scale(w), 0)}"
    s.add(**cols)
    rank = {}
    for w in (15, 30, 60, 120, 240):
        ws, got = s.scale(w), f"list_filter(l{w}, lambda x: x IS NOT NULL)"
        value = (
            f"CASE WHEN raw IS NOT NULL AND len({got}) >= {max(5, ws // 6)} THEN"
            f" (len(list_filter(l{w}, lambda x: x < raw)) + CAST(len(list_filter(l{w}, lambda x: x = raw)) + 1 AS DOUBLE) / 2) / len({got}) END"
        )
        rank[f"sp_pct{w}"] = s.long(ws, value)
    s.add(**rank)


register(
    "single_longrange", single.long_range,
    [f"{c}_ml{w}" for w in (30, 60, 120, 240, 480) for c in "xy"] + [f"sp_pct{w}" for w in (15, 30, 60, 120, 240)], _long_sql,
)

_SPANS = (15, 30, 60, 120, 240)


def ewm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_rate(view(spark, sf_dir, "pose"), KEYS, lambda t: rounded(single.smoothed_position(t), KEYS, [f"{c}_e{s}" for s in _SPANS for c in "xy"]))


def _ewm_oracle() -> str:
    cols = []
    for s in _SPANS:
        span = "CASE a.fps " + " ".join(f"WHEN {f} THEN {max(1, round(s * f / 30))}" for f in FPS) + " END"
        weight = f"pow(1 - CAST(2 AS DOUBLE) / ({span} + 1), a.video_frame - b.video_frame)"
        for c in "xy":
            v = f"b.body_center_{c}"
            cols.append(f"sum({weight} * {v}) / sum(CASE WHEN {v} IS NOT NULL THEN {weight} END) AS {c}_e{s}")
    names = [f"{c}_e{s}" for s in _SPANS for c in "xy"]
    shown = ", ".join(map(out, names))
    return with_views(
        f"SELECT video_id, mouse_id, video_frame, {shown} FROM (SELECT a.video_id, a.mouse_id, a.video_frame, {', '.join(cols)} FROM pose a"
        " JOIN pose b ON a.video_id = b.video_id AND a.mouse_id = b.mouse_id AND b.video_frame <= a.video_frame GROUP BY a.video_id, a.mouse_id, a.video_frame)"
    )


QUERIES["single_ewm"], ORACLES["single_ewm"] = ewm_query, _ewm_oracle()


def _path_sql(s: Sql) -> None:
    half = s.scale(180)
    s.add(step=f"sqrt(pow({s.diff('body_center_x')}, 2) + pow({s.diff('body_center_y')}, 2))")
    s.add(path_cum180=f"coalesce({s.roll('sum', 'step', -half, half, max(5, half // 6))}, 0)")


register("single_path_length", single.path_length, ["path_cum180"], _path_sql)


def _groom_sql(s: Sql) -> None:
    motion(s).add(nx=s.diff("nose_x"), ny=s.diff("nose_y"), axis="atan2(nose_y - tail_base_y, nose_x - tail_base_x)")
    s.add(
        ratio=f"least(greatest(coalesce(sqrt(nx * nx + ny * ny) * {s.fps}, 0) / (v + CAST(1e-3 AS DOUBLE)), 0), 10)",
        radius="sqrt(pow(nose_x - body_center_x, 2) + pow(nose_y - body_center_y, 2))", jit=f"coalesce(abs({s.diff('axis')}), 0)",
    )
    ws = s.scale(30)
    least = max(1, ws // 3)
    s.add(
        head_body_decouple=s.trailing("median", "ratio", ws, least), nose_rad_std=f"coalesce({s.trailing('std', 'radius', ws, least)}, 0)",
        head_orient_jitter=s.trailing("mean", "jit", ws, least),
    )


register("single_groom", single.grooming, ["head_body_decouple", "nose_rad_std", "head_orient_jitter"], _groom_sql)


def _asym_sql(s: Sql, kind: str) -> None:
    w = max(3, s.scale(30))
    motion(s).add(spd_asym_1s=f"coalesce(({s.future(kind, 'v', w, max(3, w // 4))}) - ({s.trailing(kind, 'v', w, max(3, w // 4))}), 0)")


register("single_asymmetry", single.speed_asymmetry, ["spd_asym_1s"], lambda s: _asym_sql(s, "mean"))
register("single_asymmetry_median", lambda t: single.speed_asymmetry(t, True), ["spd_asym_1s"], lambda s: _asym_sql(s, "median"))


def _symkl_sql(s: Sql) -> None:
    w = max(5, s.scale(30))
    least = max(3, w // 4)
    motion(s).add(
        mp=s.trailing("mean", "v", w, least), mf=s.future("mean", "v", w, least), vp0=s.trailing("var", "v", w, least), vf0=s.future("var", "v", w, least)
    ).add(vp="CASE WHEN vp0 < 1e-6 THEN CAST(1e-6 AS DOUBLE) ELSE vp0 END", vf="CASE WHEN vf0 < 1e-6 THEN CAST(1e-6 AS DOUBLE) ELSE vf0 END")
    one = lambda a, b: f"0.5::DOUBLE * ({a} / {b} + (mf - mp) * (mf - mp) / {b} - 1 + ln({b} / {a}))"
    s.add(spd_symkl_1s=f"coalesce({one('vp', 'vf')} + {one('vf', 'vp')}, 0)")


register("single_symkl", single.speed_shift, ["spd_symkl_1s"], _symkl_sql)


def _segment_sql(s: Sql) -> None:
    motion(s).add(acc=f"{s.diff('v')} * {s.fps}", pause="CAST(coalesce(v < 2, FALSE) AS DOUBLE)", pos="CAST(video_frame AS DOUBLE)")
    s.add(jerk=f"{s.diff('acc')} * {s.fps}")
    cols = {}
    for h in (30, 90):
        w = max(3, s.scale(h))
        least, lo, hi = max(3, w // 3), -(w // 2), (w - 1) // 2
        f = s.frame(lo, hi)
        cols |= {
            f"sp_sl_{h}": f"CASE WHEN count(v) {f} >= {least} THEN regr_slope(v, pos) {f} END",
            f"acc_m_{h}": s.centred("mean", "acc", w, least), f"acc_v_{h}": s.centred("var", "acc", w, least),
            f"jerk_m_{h}": s.centred("mean", "jerk", w, least), f"pause_r_{h}": s.centred("mean", "pause", w),
        }
    s.add(**cols)


register("single_segment", single.segments, [f"{n}_{h}" for h in (30, 90) for n in ("sp_sl", "acc_m", "acc_v", "jerk_m", "pause_r")], _segment_sql)


def _nose_tail_sql(s: Sql) -> None:
    s.add(nt=f"sqrt{sq('nose', 'tail_base')}")
    s.add(**{f"nt_lg{k}": s.lag("nt", s.scale(k)) for k in (10, 20, 40)}, **{f"nt_df{k}": s.diff("nt", s.scale(k)) for k in (10, 20, 40)})


register("single_nose_tail", single.nose_tail, [f"nt_{n}{k}" for k in (10, 20, 40) for n in ("lg", "df")], _nose_tail_sql)


def _ear_sql(s: Sql) -> None:
    ws = s.scale(30)
    s.add(ear=f"sqrt{sq('ear_left', 'ear_right')}")
    s.add(**{f"ear_o{o}": s.lag("ear", -s.scale(abs(o)) * (1 if o > 0 else -1)) for o in (-20, -10, 10, 20)})
    s.add(ear_con=f"({s.centred('std', 'ear', ws)}) / (({s.centred('mean', 'ear', ws)}) + CAST(1e-6 AS DOUBLE))")


register("single_ear", single.ears, ["ear_o-20", "ear_o-10", "ear_o10", "ear_o20", "ear_con"], _ear_sql)

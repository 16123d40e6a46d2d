"""Queries of the pair and third-party features, and their SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pair
from .oracle import FPS, Sql, out, per_rate
from .single_queries import PARTS, by_rate, rounded
from .views import view, with_views

KEYS = pair.KEYS
QUERIES: dict = {}
ORACLES: dict = {}

_COORDS = [f"{p}_{c}" for p in PARTS for c in "xy"]
ALIGNED = (
    "WITH aligned AS (SELECT a.video_id, a.mouse_id AS agent_id, b.mouse_id AS target_id, a.video_frame, a.fps, "
    + ", ".join(f"a.{c} AS A_{c}, b.{c} AS B_{c}" for c in _COORDS)
    + " FROM pose a JOIN pose b ON a.video_id = b.video_id AND a.video_frame = b.video_frame AND a.mouse_id <> b.mouse_id) "
)


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pose = view(spark, sf_dir, "pose")
    return pair.align(pose, pair.ordered_pairs(pose), PARTS, ("fps",))


def register(name: str, f, columns: list[str], build) -> None:
    QUERIES[name] = lambda spark, sf_dir: by_rate(aligned(spark, sf_dir), KEYS, lambda t: rounded(f(t).df, KEYS, columns))
    ORACLES[name] = per_rate("aligned", KEYS, build, columns, ALIGNED)


def d(a: str, b: str, c: str) -> str:
    return f"({a}_{c} - {b}_{c})"


def norm2(a: str, b: str) -> str:
    return f"({d(a, b, 'x')} * {d(a, b, 'x')} + {d(a, b, 'y')} * {d(a, b, 'y')})"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, FALSE) AS DOUBLE)"


EPS = "CAST(1e-6 AS DOUBLE)"

_DIST = [f"12+{p}+{q}" for p, q in product(PARTS, PARTS)]
register("pair_distance", lambda t: pair.distances(t, PARTS), _DIST, lambda s: s.add(**{f"12+{p}+{q}": norm2(f"A_{p}", f"B_{q}") for p, q in product(PARTS, PARTS)}))


def _speed_sql(s: Sql) -> None:
    cols = {}
    for k in pair.LAGS:
        for name, a, b in (("sp_A", "A", "A"), ("sp_AB", "A", "B"), ("sp_B", "B", "B")):
            x, y = (f"({a}_ear_left_{c} - {s.lag(f'{b}_ear_left_{c}', s.scale(k))})" for c in "xy")
            cols[f"{name}_l{k}"] = f"{x} * {x} + {y} * {y}"
    s.add(**cols).add(sp_A="sp_A_l10", sp_AB="sp_AB_l10", sp_B="sp_B_l10")


register("pair_speed_lags", pair.lagged_displacement, [f"{n}_l{k}" for k in pair.LAGS for n in ("sp_A", "sp_AB", "sp_B")] + ["sp_A", "sp_AB", "sp_B"], _speed_sql)


def _orient_sql(s: Sql) -> None:
    a, b = (norm2(f"{w}_nose", f"{w}_tail_base") for w in "AB")
    dot = " + ".join(f"{d('A_nose', 'A_tail_base', c)} * {d('B_nose', 'B_tail_base', c)}" for c in "xy")
    s.add(rel_ori=f"({dot}) / (sqrt({a}) * sqrt({b}) + {EPS})")
    s.add(head_cos="rel_ori", head_parallel=flag("rel_ori > 0.5"), head_antipar=flag("rel_ori < -0.5"), head_side=flag("rel_ori >= -0.5 AND rel_ori <= 0.5"))


register("pair_orientation", pair.orientation, ["rel_ori", "head_cos", "head_parallel", "head_antipar", "head_side"], _orient_sql)


def _facing_sql(s: Sql) -> None:
    for me, other in ("AB", "BA"):
        head = f"atan2({d(f'{me}_nose', f'{me}_tail_base', 'y')}, {d(f'{me}_nose', f'{me}_tail_base', 'x')})"
        to = f"atan2({d(f'{other}_body_center', f'{me}_nose', 'y')}, {d(f'{other}_body_center', f'{me}_nose', 'x')})"
        s.add(**{f"{me}_face_cos": f"cos({to} - {head})"})
        c = f"{me}_face_cos"
        s.add(**{f"{me}_face_front": flag(f"{c} > 0.7"), f"{me}_face_back": flag(f"{c} < -0.5"), f"{me}_face_side": flag(f"{c} <= 0.7 AND {c} >= -0.5")})


register("pair_facing", pair.facing, [f"{w}_face_{k}" for w in "AB" for k in ("cos", "front", "back", "side")], _facing_sql)


def _wedge_sql(s: Sql) -> None:
    for me, other in ("AB", "BA"):
        left, right = (f"atan2({d(f'{other}_nose', f'{me}_{ear}', 'y')}, {d(f'{other}_nose', f'{me}_{ear}', 'x')})" for ear in ("ear_left", "ear_right"))
        s.add(**{f"{me}_ear_wedge": f"abs(atan2(sin({left} - {right}), cos({left} - {right})))"})


register("pair_wedge", pair.wedges, ["A_ear_wedge", "B_ear_wedge"], _wedge_sql)
register("pair_approach", pair.approach, ["appr"], lambda s: s.add(nn2=norm2("A_nose", "B_nose")).add(appr=s.diff("nn2", s.scale(10))))


def _bins_sql(s: Sql) -> None:
    s.add(cd=f"sqrt{norm2('A_body_center', 'B_body_center')}")
    s.add(v_cls=flag("cd < 5"), cls=flag("cd >= 5 AND cd < 15"), med=flag("cd >= 15 AND cd < 30"), far=flag("cd >= 30"))


register("pair_distance_bins", pair.distance_bins, ["v_cls", "cls", "med", "far"], _bins_sql)


def _centres_sql(s: Sql) -> Sql:
    s.add(cd2=norm2("A_body_center", "B_body_center"))
    return s.add(**{f"{w}v{c}": s.diff(f"{w}_body_center_{c}") for w in "AB" for c in "xy"})


def _close_sql(s: Sql) -> None:
    _centres_sql(s).add(co="Avx * Bvx + Avy * Bvy")
    cols = {}
    for w in (5, 15, 30, 60):
        ws = s.scale(w)
        cols |= {f"d_{k}{w}": s.centred(kind, "cd2", ws) for k, kind in (("m", "mean"), ("s", "std"), ("mn", "min"), ("mx", "max"))}
        cols |= {f"co_m{w}": s.centred("mean", "co", ws), f"co_s{w}": s.centred("std", "co", ws), f"int{w}": f"1 / (1 + ({s.centred('var', 'cd2', ws)}))"}
    s.add(**cols)


register("pair_closeness", pair.closeness, [f"{n}{w}" for w in (5, 15, 30, 60) for n in ("d_m", "d_s", "d_mn", "d_mx", "int", "co_m", "co_s")], _close_sql)


def _nose_sql(s: Sql) -> None:
    s.add(nn=f"sqrt{norm2('A_nose', 'B_nose')}").add(near=flag("nn < 10"))
    cols = {}
    for k in pair.NOSE_LAGS:
        n = s.scale(k)
        cols |= {f"nn_lg{k}": s.lag("nn", n), f"nn_ch{k}": s.diff("nn", n), f"cl_ps{k}": s.trailing("mean", "near", n)}
    s.add(**cols)


register("pair_nose_distance", pair.nose_distance, [f"{n}{k}" for k in pair.NOSE_LAGS for n in ("nn_lg", "nn_ch", "cl_ps")], _nose_sql)


def _motion_sql(s: Sql) -> None:
    s.add(nn=f"sqrt{norm2('A_nose', 'B_nose')}", **{f"{w}n{c}": s.diff(f"{w}_nose_{c}") for w in "AB" for c in "xy"})
    rx, ry = d("A_nose", "B_nose", "x"), d("A_nose", "B_nose", "y")
    s.add(
        nn_rad_sp=f"coalesce(((Anx - Bnx) * {rx} + (Any - Bny) * {ry}) / (nn + {EPS}) * {s.fps}, 0)".replace("(Any", '("Any"'),
        nn_lat_sp=f"coalesce(((Anx - Bnx) * (-{ry}) + (Any - Bny) * {rx}) / (nn + {EPS}) * {s.fps}, 0)".replace("(Any", '("Any"'),
        nose_spdA=f'sqrt(Anx * Anx + "Any" * "Any") * {s.fps}', nose_spdB=f"sqrt(Bnx * Bnx + Bny * Bny) * {s.fps}",
    ).add(nose_spd_gap="nose_spdA - nose_spdB")
    s.add(**{f"{n}_lg{k}": s.lag(n, s.scale(k)) for k in pair.LAGS for n in ("nose_spdA", "nose_spdB", "nose_spd_gap")})


_SPD = ("nose_spdA", "nose_spdB", "nose_spd_gap")
register("pair_nose_dynamics", pair.nose_motion, ["nn_rad_sp", "nn_lat_sp", *_SPD] + [f"{n}_lg{k}" for k in pair.LAGS for n in _SPD], _motion_sql)


def _contact_sql(s: Sql) -> None:
    s.add(nn=f"sqrt{norm2('A_nose', 'B_nose')}").add(**{f"u{t}": flag(f"nn < {t}") for t in (8, 12, 15)})
    cols = {}
    for w in (5, 15, 45):
        ws = s.scale(w)
        cols |= {f"nn_mean{w}": s.centred("mean", "nn", ws), f"nn_std{w}": s.centred("std", "nn", ws)}
        cols |= {f"nn_ct{t}_{w}": s.centred("mean", f"u{t}", ws) for t in (8, 12, 15)}
    s.add(**cols)


register("pair_contact", pair.contact, [f"{n}{w}" for w in (5, 15, 45) for n in ("nn_mean", "nn_std", "nn_ct8_", "nn_ct12_", "nn_ct15_")], _contact_sql)


def _align_sql(s: Sql, offsets) -> None:
    _centres_sql(s).add(va=f"(Avx * Bvx + Avy * Bvy) / (sqrt(Avx * Avx + Avy * Avy) * sqrt(Bvx * Bvx + Bvy * Bvy) + {EPS})")
    ws = s.scale(30)
    s.add(
        **{f"va_{o}": s.lag("va", -s.scale(abs(o)) * (1 if o > 0 else -1)) if o else "va" for o in offsets},
        int_con=f"({s.centred('std', 'cd2', ws)}) / (({s.centred('mean', 'cd2', ws)}) + {EPS})",
    )


_OFF = (-20, -10, 10, 20)
register("pair_velocity_alignment", pair.velocity_alignment, [f"va_{o}" for o in _OFF] + ["int_con"], lambda s: _align_sql(s, _OFF))
_OFF0 = (-20, -10, 0, 10, 20)
register("pair_velocity_alignment_baseline", lambda t: pair.velocity_alignment(t, _OFF0), [f"va_{o}" for o in _OFF0] + ["int_con"], lambda s: _align_sql(s, _OFF0))


def _interaction_sql(s: Sql) -> None:
    rx, ry = d("A_body_center", "B_body_center", "x"), d("A_body_center", "B_body_center", "y")
    _centres_sql(s).add(rel="sqrt(cd2)", asp="sqrt(Avx * Avx + Avy * Avy)", bsp="sqrt(Bvx * Bvx + Bvy * Bvy)")
    s.add(al=f"(Avx * {rx} + Avy * {ry}) / (asp * rel + {EPS})", bl=f"(Bvx * (-{rx}) + Bvy * (-{ry})) / (bsp * rel + {EPS})")
    s.add(chase=f"-{s.diff('rel')} * bl", a2="CASE WHEN bsp IS NOT NULL THEN asp END", b2="CASE WHEN asp IS NOT NULL THEN bsp END")
    cols = {}
    for w in (30, 60):
        ws = s.scale(w)
        cols |= {f"A_ld{w}": s.trailing("mean", "al", ws, max(1, ws // 6)), f"B_ld{w}": s.trailing("mean", "bl", ws, max(1, ws // 6))}
    ws = s.scale(30)
    cols["chase_30"] = s.trailing("mean", "chase", ws, max(1, ws // 6))
    for w in (60, 120):
        ws = s.scale(w)
        f = s.frame(1 - ws, 0)
        cols[f"sp_cor{w}"] = (
            f"CASE WHEN count(asp) {f} >= {max(1, ws // 6)} AND stddev_pop(a2) {f} * stddev_pop(b2) {f} <> 0"
            f" THEN covar_pop(a2, b2) {f} / (stddev_pop(a2) {f} * stddev_pop(b2) {f}) END"
        )
    s.add(**cols)


register("pair_interaction", pair.interaction, ["A_ld30", "B_ld30", "A_ld60", "B_ld60", "chase_30", "sp_cor60", "sp_cor120"], _interaction_sql)

CTX = [
    "ctx_third_min_dist_agent", "ctx_third_mean_dist_agent", "ctx_third_close_agent_cnt", "ctx_third_min_dist_target", "ctx_third_mean_dist_target",
    "ctx_third_close_target_cnt", "ctx_third_min_dist_mid", "ctx_third_close_any_cnt", "ctx_third_close_any", "ctx_third_between_ratio",
    "ctx_third_cos_agent_closest", "ctx_third_min_dist_agent_ratio", "ctx_third_min_dist_target_ratio", "ctx_third_min_dist_mid_ratio",
]


def third_party_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pair.third_party(aligned(spark, sf_dir), view(spark, sf_dir, "pose"))
    return rounded(rows.withColumns({c: F.col(c).cast("double") for c in CTX}), KEYS, CTX)


def _third_oracle() -> str:
    ax, ay, bx, by = "A_body_center_x", "A_body_center_y", "B_body_center_x", "B_body_center_y"
    inner = f"""SELECT l.video_id, agent_id, target_id, l.video_frame, t.mouse_id AS m,
 sqrt(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2)) AS dat, sqrt(pow(t.body_center_x - {ax}, 2) + pow(t.body_center_y - {ay}, 2)) AS da,
 sqrt(pow(t.body_center_x - {bx}, 2) + pow(t.body_center_y - {by}, 2)) AS db,
 sqrt(pow(t.body_center_x - 0.5::DOUBLE * ({ax} + {bx}), 2) + pow(t.body_center_y - 0.5::DOUBLE * ({ay} + {by}), 2)) AS dm,
 (({bx} - {ax}) * (t.body_center_x - {ax}) + ({by} - {ay}) * (t.body_center_y - {ay})) /
 (sqrt(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2)) * sqrt(pow(t.body_center_x - {ax}, 2) + pow(t.body_center_y - {ay}, 2)) + {EPS}) AS c
 FROM aligned l JOIN pose t ON l.video_id = t.video_id AND l.video_frame = t.video_frame AND t.mouse_id <> agent_id AND t.mouse_id <> target_id"""
    grouped = f"""SELECT video_id, agent_id, target_id, video_frame, any_value(dat) AS dat, min(da) AS ctx_third_min_dist_agent, avg(da) AS ctx_third_mean_dist_agent,
 CAST(count(*) FILTER (da < 10) AS DOUBLE) AS ctx_third_close_agent_cnt, min(db) AS ctx_third_min_dist_target, avg(db) AS ctx_third_mean_dist_target,
 CAST(count(*) FILTER (db < 10) AS DOUBLE) AS ctx_third_close_target_cnt, min(dm) AS ctx_third_min_dist_mid,
 CAST(count(*) FILTER (coalesce(da < 10, FALSE) OR coalesce(db < 10, FALSE)) AS DOUBLE) AS ctx_third_close_any_cnt, min(da + db) AS s,
 (list(c ORDER BY coalesce(da, 'inf'::DOUBLE), m))[1] AS ctx_third_cos_agent_closest FROM ({inner}) GROUP BY video_id, agent_id, target_id, video_frame"""
    more = ", ".join(f"ctx_third_min_dist_{k} / (dat + {EPS}) AS ctx_third_min_dist_{k}_ratio" for k in ("agent", "target", "mid"))
    full = f"SELECT *, CAST(ctx_third_close_any_cnt > 0 AS DOUBLE) AS ctx_third_close_any, s / (dat + {EPS}) AS ctx_third_between_ratio, {more} FROM ({grouped})"
    return with_views(f"{ALIGNED} SELECT video_id, agent_id, target_id, video_frame, {', '.join(map(out, CTX))} FROM ({full})")


QUERIES["third_party_ctx"], ORACLES["third_party_ctx"] = third_party_ctx, _third_oracle()

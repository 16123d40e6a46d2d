"""Queries of ingest, labels, decoding, intervals, metric and learning, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import Track
from ..functions.scalars import slug, trailing_number
from ..operators import boosting, decode, labels, learning, metric, pose, single
from ..sources import readers, sinks
from . import behaviour
from .oracle import out
from .single_queries import PARTS, rounded
from .views import view, with_views

QUERIES: dict = {}
ORACLES: dict = {}
KEYS = ("video_id", "mouse_id")


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add


def r6(c: str) -> str:
    return out(c)


# Metadata.
_SLEEP = "coalesce(lab_id LIKE '%MABe22%' AND lower(mouse1_condition) = 'lights on', FALSE)"


@query("sleep_filter", f"SELECT video_id, lab_id, mouse1_condition FROM metadata WHERE NOT {_SLEEP}")
def sleep_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose.drop_sleeping(view(spark, sf_dir, "metadata")).select("video_id", "lab_id", "mouse1_condition")


@query("metadata_flags", f"""SELECT video_id, {_SLEEP} AS sleeping, 1 + CAST(mouse2_strain IS NOT NULL AS INT) + CAST(mouse3_strain IS NOT NULL AS INT)
 + CAST(mouse4_strain IS NOT NULL AS INT) AS n_mice FROM metadata""")
def metadata_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose.count_individuals(pose.flag_sleeping(view(spark, sf_dir, "metadata"))).select("video_id", "sleeping", "n_mice")


_LISTS = "(SELECT DISTINCT body_parts_tracked FROM metadata)"


@query("sections", f"SELECT body_parts_tracked, CAST(json_array_length(body_parts_tracked) AS INT) AS n_parts FROM {_LISTS}")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pose.sections(view(spark, sf_dir, "metadata"))
    return rows.select("body_parts_tracked", F.size("parts").alias("n_parts"))


@query("section_videos", """SELECT video_id, lab_id FROM metadata WHERE body_parts_tracked = '["tail_base"]'""")
def section_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose.of_section(view(spark, sf_dir, "metadata"), '["tail_base"]').select("video_id", "lab_id")


_SPECS = """(SELECT DISTINCT video_id, split_part(i, ',', 1) AS agent, split_part(i, ',', 2) AS target, lower(split_part(i, ',', 3)) AS action
 FROM (SELECT video_id, replace(unnest(CAST(CAST(behaviors_labeled AS JSON) AS VARCHAR[])), '''', '') AS i FROM metadata WHERE behaviors_labeled IS NOT NULL))"""


@query("label_spec_parse", f"SELECT video_id, agent, target, action FROM {_SPECS}")
def label_spec_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_specs(view(spark, sf_dir, "metadata"))


@query("label_actions", f"SELECT video_id, agent, target, array_to_string(list_sort(list(DISTINCT action)), ',') AS actions FROM {_SPECS} GROUP BY video_id, agent, target")
def label_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.actions_by_video(labels.label_specs(view(spark, sf_dir, "metadata"))).withColumn("actions", F.array_join("actions", ","))


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("video_id") % 3 == 0, "7").otherwise("0")
    return view(spark, sf_dir, "metadata").select("video_id", F.explode(F.array(first, F.lit("mouse2"))).alias("mouse_id"))


@query("agent_resolve", f"""WITH named AS (SELECT video_id, agent FROM {_SPECS} UNION SELECT video_id, target FROM {_SPECS} WHERE target <> 'self'),
tracked AS (SELECT video_id, unnest([CASE WHEN video_id % 3 = 0 THEN '7' ELSE '0' END, 'mouse2']) AS mouse_id FROM metadata),
n AS (SELECT *, try_cast(regexp_extract(agent, '(\\d+)$', 1) AS INT) AS k FROM named),
c AS (SELECT video_id, agent, CAST(k AS VARCHAR) AS name, 0 AS r FROM n UNION ALL SELECT video_id, agent, CAST(k - 1 AS VARCHAR), 1 FROM n
 UNION ALL SELECT video_id, agent, concat('mouse', CAST(k AS VARCHAR)), 3 FROM n WHERE k IS NOT NULL UNION ALL SELECT video_id, agent, agent, 4 FROM n)
SELECT c.video_id, agent, arg_min(mouse_id, r) AS mouse_id FROM c JOIN tracked t ON c.video_id = t.video_id AND c.name = t.mouse_id GROUP BY c.video_id, agent""")
def agent_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.resolve_agents(labels.label_specs(view(spark, sf_dir, "metadata")), _tracked(spark, sf_dir))


@query("name_functions", r"""SELECT c_custkey, try_cast(nullif(regexp_extract(c_name, '(\d+)$', 1), '') AS INT) AS number,
 CASE WHEN length(p) > 20 THEN concat(substring(p, 1, 11), '-', substring(md5(n), 1, 8)) WHEN p = '' THEN 'default' ELSE p END AS slug FROM (
 SELECT c_custkey, c_name, concat(c_name, ' / ', c_mktsegment) AS n,
 regexp_replace(regexp_replace(concat(c_name, ' / ', c_mktsegment), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS p FROM customer)""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_name", F.lit(" / "), "c_mktsegment")
    return view(spark, sf_dir, "customer").select("c_custkey", trailing_number(F.col("c_name")).alias("number"), slug(name, 20).alias("slug"))


# Poses.
_CELLS = ", ".join(f"max(CASE WHEN bodypart = '{p}' THEN {a} END) AS {p}_{a}" for p in PARTS for a in "xy")
_COORDS = [f"{p}_{a}" for p in PARTS for a in "xy"]


def _pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose.pivot(view(spark, sf_dir, "track_long"), PARTS)


_PIVOT = f"""WITH wide AS (SELECT video_id, mouse_id, video_frame, {_CELLS} FROM track_long GROUP BY video_id, mouse_id, video_frame),
grid AS (SELECT f.video_id, m.mouse_id, f.video_frame FROM (SELECT DISTINCT video_id, video_frame FROM wide) f JOIN (SELECT DISTINCT video_id, mouse_id FROM wide) m ON f.video_id = m.video_id),
piv AS (SELECT g.video_id, g.mouse_id, g.video_frame, {', '.join(_COORDS)} FROM grid g LEFT JOIN wide w ON g.video_id = w.video_id AND g.mouse_id = w.mouse_id AND g.video_frame = w.video_frame)"""


@query("pose_pivot", f"{_PIVOT} SELECT * FROM piv")
def pose_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pivoted(spark, sf_dir)


@query("pose_scaled", f"{_PIVOT} SELECT p.video_id, mouse_id, video_frame, {', '.join(r6(c) for c in _COORDS)} FROM (SELECT p.video_id, mouse_id, video_frame, {', '.join(f'{c} / pix_per_cm_approx AS {c}' for c in _COORDS)} FROM piv p JOIN videos v ON p.video_id = v.video_id) p")
def pose_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pose.to_cm(_pivoted(spark, sf_dir), view(spark, sf_dir, "videos"), _COORDS), KEYS, _COORDS)


@query("drop_parts", """SELECT t.video_id, mouse_id, video_frame, t.bodypart FROM track_long t JOIN
 (SELECT video_id, count(DISTINCT bodypart) AS n FROM track_long GROUP BY video_id) c ON t.video_id = c.video_id WHERE NOT (n > 4 AND t.bodypart IN ('ear_left', 'nose'))""")
def drop_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose.drop_parts(view(spark, sf_dir, "track_long"), ("ear_left", "nose"), 4).select("video_id", "mouse_id", "video_frame", "bodypart")


@query("available_parts", f"{_PIVOT} SELECT video_id, mouse_id, part FROM ({' UNION ALL '.join(f'''SELECT video_id, mouse_id, '{p}' AS part FROM piv GROUP BY video_id, mouse_id HAVING count({p}_x) > 0 AND bool_or({p}_x IS NOT NULL AND {p}_y IS NOT NULL)''' for p in PARTS)})")
def available_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose.available_parts(_pivoted(spark, sf_dir), PARTS)


def _interpolated(source: str, keys: str, cols: list[str]) -> str:
    w = f"PARTITION BY {keys} ORDER BY video_frame"
    near = []
    for c in cols:
        back, ahead = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        near += [f"last_value({c} IGNORE NULLS) {back} AS a_{c}", f"last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {back} AS ar_{c}"]
        near += [f"first_value({c} IGNORE NULLS) {ahead} AS b_{c}", f"first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {ahead} AS br_{c}"]
    value = [
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN a_{c} IS NULL THEN b_{c} WHEN b_{c} IS NULL THEN a_{c} ELSE a_{c} + (b_{c} - a_{c}) * (CAST(rn - ar_{c} AS DOUBLE) / (br_{c} - ar_{c})) END AS {c}"
        for c in cols
    ]
    return f"SELECT {keys}, video_frame, {', '.join(value)} FROM (SELECT *, {', '.join(near)} FROM (SELECT *, row_number() OVER ({w}) AS rn FROM {source}))"


_FILL = ["body_center_x", "body_center_y", "nose_x"]


@query("interp_linear", f"SELECT video_id, mouse_id, video_frame, {', '.join(map(r6, _FILL))} FROM ({_interpolated('pose', 'video_id, mouse_id', _FILL)})")
def interp_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pose.fill_gaps(Track(view(spark, sf_dir, "pose"), KEYS), _FILL).df, KEYS, _FILL)


_DIRTY = """(SELECT video_id, mouse_id, video_frame, CASE event_id % 13 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN CAST('-Infinity' AS DOUBLE) WHEN 2 THEN NULL ELSE body_center_x END AS f1,
 CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE body_center_y END AS f2, CAST(NULL AS DOUBLE) AS f3, CAST(event_id % 5 AS DOUBLE) AS f4 FROM pose)"""
_F = ["f1", "f2", "f3", "f4"]


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = F.col, F.col("event_id")
    inf, nan = float("inf"), float("nan")
    f1 = F.when(e % 13 == 0, inf).when(e % 13 == 1, -inf).when(e % 13 == 2, None).otherwise(c("body_center_x"))
    f2 = F.when(e % 7 == 0, nan).otherwise(c("body_center_y"))
    return view(spark, sf_dir, "pose").select(*KEYS, "video_frame", f1.alias("f1"), f2.alias("f2"), F.lit(None).cast("double").alias("f3"), (e % 5).cast("double").alias("f4"))


_CLEAN = f"(SELECT video_id, mouse_id, video_frame, {', '.join(f'CASE WHEN isfinite({c}) THEN {c} END AS {c}' for c in _F)} FROM {_DIRTY})"


@query("sanitize", f"SELECT video_id, mouse_id, video_frame, {', '.join(map(r6, _F))} FROM (SELECT video_id, mouse_id, video_frame, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _F)} FROM ({_interpolated(_CLEAN, 'video_id, mouse_id', _F)}))")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pose.sanitize(Track(_dirty(spark, sf_dir), KEYS), _F).df, KEYS, _F)


@query("nonfinite_report", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL OR isnan({c})) AS n_nan, count(*) FILTER ({c} = 'inf'::DOUBLE) AS n_pos_inf, count(*) FILTER ({c} = '-inf'::DOUBLE) AS n_neg_inf FROM {_DIRTY}) WHERE n_nan + n_pos_inf + n_neg_inf > 0"
    for c in _F))
def nonfinite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose.non_finite_report(_dirty(spark, sf_dir), _F)


@query("template_columns", f"SELECT video_id, mouse_id, video_frame, {r6('nose_x')}, {r6('neck_x')} FROM (SELECT *, CAST(0 AS DOUBLE) AS neck_x FROM pose)")
def template_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pose.like_template(view(spark, sf_dir, "pose"), [*KEYS, "video_frame"], ["nose_x", "neck_x"], 0.0)
    return rounded(rows, KEYS, ["nose_x", "neck_x"])


@query("section_union", "SELECT video_id, mouse_id, video_frame, CASE WHEN mouse_id <> 2 THEN px END AS a, CASE WHEN mouse_id <> 1 THEN py END AS b FROM frames")
def section_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "frames")
    one = f.filter("mouse_id = 1").select(*KEYS, "video_frame", F.col("px").alias("a"))
    two = f.filter("mouse_id = 2").select(*KEYS, "video_frame", F.col("py").alias("b"))
    three = f.filter("mouse_id = 3").select(*KEYS, "video_frame", F.col("py").alias("b"), F.col("px").alias("a"))
    return pose.union_features([one, two, three])


# Labels.
_ACT = "(SELECT DISTINCT video_id, agent_id, target_id, action FROM annotation WHERE action <> 'error')"
_PAINTED = f"""(SELECT a.video_id, a.agent_id, a.target_id, a.action, f.video_frame, coalesce(bool_or(i.start_frame IS NOT NULL), FALSE) AS y FROM frames f
 JOIN {_ACT} a ON f.video_id = a.video_id AND f.mouse_id = a.agent_id LEFT JOIN annotation i ON i.video_id = a.video_id AND i.agent_id = a.agent_id
 AND i.target_id = a.target_id AND i.action = a.action AND f.video_frame BETWEEN i.start_frame AND i.stop_frame GROUP BY a.video_id, a.agent_id, a.target_id, a.action, f.video_frame)"""


def _painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "annotation")
    return labels.paint(view(spark, sf_dir, "frames").withColumnRenamed("mouse_id", "agent_id"), a, a.filter("action <> 'error'"))


@query("label_paint", f"SELECT * FROM {_PAINTED}")
def label_paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _painted(spark, sf_dir)


@query("label_counts", f"SELECT action, CAST(count(*) FILTER (y) AS BIGINT) AS n_pos, CAST(count(*) FILTER (NOT y) AS BIGINT) AS n_neg FROM {_PAINTED} GROUP BY action HAVING count(*) FILTER (y) > 0")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_positives(labels.label_counts(_painted(spark, sf_dir)))


@query("fps_lookup", "SELECT o_custkey AS video_id, o_orderkey, coalesce(v.frames_per_second, 30) AS fps FROM orders LEFT JOIN videos v ON o_custkey = v.video_id")
def fps_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), "o_orderkey")
    return labels.rate_of(rows, view(spark, sf_dir, "videos")).select("video_id", "o_orderkey", "fps")


@query("annotated_videos", "SELECT video_id FROM videos WHERE video_id IN (SELECT video_id FROM annotation WHERE action = 'click')")
def annotated_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_annotation(view(spark, sf_dir, "videos"), view(spark, sf_dir, "annotation").filter("action = 'click'")).select("video_id")


_NORM = lambda c: f"lower(trim({c}))"
_SEX = lambda c: f"CASE {_NORM(c)} WHEN 'male' THEN 1 WHEN 'm' THEN 1 WHEN 'female' THEN 0 WHEN 'f' THEN 0 ELSE -1 END"
_FLT = lambda c, n: f"CAST(coalesce({c}, 0) AS FLOAT) AS meta_{n}"


@query("meta_encode", f"""WITH codes AS (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM (SELECT {_NORM('mouse1_strain')} AS value FROM metadata UNION SELECT {_NORM('mouse2_strain')} FROM metadata) WHERE value IS NOT NULL),
shapes AS (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT {_NORM('arena_shape')} AS value FROM metadata) WHERE value IS NOT NULL),
p AS (SELECT *, unnest(['mouse2', 'self']) AS target FROM metadata),
q AS (SELECT *, CASE WHEN target = 'self' THEN mouse1_sex ELSE mouse2_sex END AS tsex, CASE WHEN target = 'self' THEN mouse1_strain ELSE mouse2_strain END AS tstrain FROM p),
e AS (SELECT q.*, {_SLEEP} AS sl, {_SEX('mouse1_sex')} AS sa, {_SEX('tsex')} AS st, coalesce(a.code, -1) AS ca, coalesce(t.code, -1) AS ct, coalesce(s.code, -1) AS cs FROM q
 LEFT JOIN codes a ON {_NORM('mouse1_strain')} = a.value LEFT JOIN codes t ON {_NORM('tstrain')} = t.value LEFT JOIN shapes s ON {_NORM('arena_shape')} = s.value)
SELECT video_id, 'mouse1' AS agent, target, {_FLT('CAST(sl AS INT)', 'sleeping')},
 {_FLT('1 + CAST(mouse2_strain IS NOT NULL AS INT) + CAST(mouse3_strain IS NOT NULL AS INT) + CAST(mouse4_strain IS NOT NULL AS INT)', 'n_mice')}, {_FLT('frames_per_second', 'fps')},
 {_FLT('arena_width_cm', 'arena_width_cm')}, {_FLT('arena_height_cm', 'arena_height_cm')}, {_FLT('arena_width_cm * arena_height_cm', 'arena_area_cm2')},
 {_FLT('arena_width_cm / (arena_height_cm + CAST(1e-6 AS DOUBLE))', 'arena_aspect_ratio')}, {_FLT('cs', 'arena_shape_code')}, {_FLT('sa', 'agent_sex_code')}, {_FLT('st', 'target_sex_code')},
 {_FLT('CAST(sa = st AND sa >= 0 AS INT)', 'same_sex')}, {_FLT('ca', 'agent_strain_code')}, {_FLT('ct', 'target_strain_code')}, {_FLT('CAST(ca = ct AND ca >= 0 AS INT)', 'same_strain')} FROM e""")
def meta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pose.count_individuals(pose.flag_sleeping(view(spark, sf_dir, "metadata")))
    strains = labels.fit_codes(m.select(F.col("mouse1_strain").alias("s")).union(m.select("mouse2_strain")), "s")
    pairs = m.withColumns({
        "agent": F.lit("mouse1"), "target": F.explode(F.array(F.lit("mouse2"), F.lit("self"))), "agent_sex": F.col("mouse1_sex"),
        "target_sex": F.col("mouse2_sex"), "agent_strain": F.col("mouse1_strain"), "target_strain": F.col("mouse2_strain"),
    })
    return labels.meta_features(pairs, strains, labels.fit_codes(m, "arena_shape"))


# Decoding.
_P = ["p_chase", "p_groom", "p_rear", "p_sniff"]
_THRESHOLDS = {"p_chase": 0.45, "p_rear": 0.375}


def _smoothed(width: int) -> str:
    half = width // 2
    f = f"OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return f"(SELECT video_id, mouse_id, video_frame, {', '.join(f'avg({p}) {f} AS {p}' for p in _P)} FROM probabilities)"


def _chosen(width: int, mask_first: bool) -> str:
    """Running maximum over the actions in order; later ones must be larger."""
    limits = {p: _THRESHOLDS.get(p, 0.27) for p in _P}
    ok = {p: f"round({p}, 9) >= CAST({limits[p]} AS DOUBLE)" if mask_first else f"{p} IS NOT NULL" for p in _P}
    cand = ", ".join(f"CASE WHEN {ok[p]} THEN round({p}, 9) END AS c{i}" for i, p in enumerate(_P))
    top = "greatest(c0, c1, c2, c3)"
    pick = "CASE " + " ".join(f"WHEN c{i} = {top} THEN {i}" for i in range(len(_P))) + " ELSE -1 END"
    limit = "CASE " + " ".join(f"WHEN c{i} = {top} THEN CAST({limits[p]} AS DOUBLE)" for i, p in enumerate(_P)) + " END"
    best = f"CASE WHEN {top} >= {limit} THEN {pick} ELSE -1 END"
    return f"(SELECT video_id, mouse_id, video_frame, CAST({best} AS INT) AS best FROM (SELECT *, {cand} FROM {_smoothed(width)}))"


def _decoded(spark: SparkSession, sf_dir: str, width: int, mask_first: bool) -> Track:
    t = decode.smooth(Track(view(spark, sf_dir, "probabilities"), KEYS), _P, width)
    # Sums in another order differ in the last bits; compare on nine digits in both engines.
    t = t.add({p: F.round(p, 9) for p in _P})
    return t.add({"__best": decode.best_action(_P, _THRESHOLDS, mask_first)})


def _runs(width: int, mask_first: bool, drop_last: bool = True) -> str:
    stop = "lead(video_frame) OVER w" if drop_last else "coalesce(lead(video_frame) OVER w, last_frame + 1)"
    name = "CASE best " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_P)) + " END"
    return f"""(SELECT video_id, mouse_id, {name} AS action, video_frame AS start_frame, stop_frame FROM (
 SELECT *, {stop} AS stop_frame FROM (SELECT *, lag(best) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame) AS before,
 max(video_frame) OVER (PARTITION BY video_id, mouse_id) AS last_frame FROM {_chosen(width, mask_first)}) WHERE before IS NULL OR before <> best
 WINDOW w AS (PARTITION BY video_id, mouse_id ORDER BY video_frame)) WHERE stop_frame IS NOT NULL AND best >= 0 AND stop_frame - video_frame >= 3)"""


for _name, _width, _mask in (("decode_masked_argmax", 7, True), ("decode_argmax_threshold", 5, False)):
    QUERIES[_name] = lambda spark, sf_dir, w=_width, m=_mask: _decoded(spark, sf_dir, w, m).df.select(*KEYS, "video_frame", F.col("__best").alias("best"))
    ORACLES[_name] = with_views(f"SELECT * FROM {_chosen(_width, _mask)}")
for _name, _width, _mask, _last in (("runs_to_intervals", 7, True, True), ("runs_to_intervals_baseline", 5, False, True), ("runs_to_intervals_whole", 7, True, False)):
    QUERIES[_name] = lambda spark, sf_dir, w=_width, m=_mask, d=_last: decode.to_intervals(_decoded(spark, sf_dir, w, m), _P, drop_last=d)
    ORACLES[_name] = with_views(f"SELECT * FROM {_runs(_width, _mask, _last)}")

_GREEDY = """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY video_id, agent_id, target_id ORDER BY start_frame, stop_frame, action) AS i FROM pred_raw WHERE start_frame < stop_frame),
g AS (SELECT video_id, agent_id, target_id, action, start_frame, stop_frame, i, start_frame >= 0 AS keep, CASE WHEN start_frame >= 0 THEN stop_frame ELSE 0 END AS last FROM r WHERE i = 1
 UNION ALL SELECT r.video_id, r.agent_id, r.target_id, r.action, r.start_frame, r.stop_frame, r.i, r.start_frame >= g.last, CASE WHEN r.start_frame >= g.last THEN r.stop_frame ELSE g.last END
 FROM g JOIN r ON r.video_id = g.video_id AND r.agent_id = g.agent_id AND r.target_id = g.target_id AND r.i = g.i + 1),
kept AS (SELECT video_id, agent_id, target_id, action, start_frame, stop_frame FROM g WHERE keep)"""


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.without_overlap(view(spark, sf_dir, "pred_raw"))


@query("greedy_nonoverlap", f"{_GREEDY} SELECT * FROM kept")
def greedy_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir)


_TILES = """SELECT o_custkey AS video_id, o_orderkey AS agent_id, list_extract(['attack', 'chase', 'groom', 'sniff'], i) AS action,
 CAST(lo + (i - 1) * size AS INT) AS start_frame, CAST(least(lo + i * size, hi) AS INT) AS stop_frame FROM (
 SELECT *, CAST(ceil((hi - lo) / 4.0) AS BIGINT) AS size, unnest([1, 2, 3, 4]) AS i FROM (SELECT o_custkey, o_orderkey, o_orderkey % 7 AS lo, o_orderkey % 7 + 3 + o_orderkey % 11 AS hi FROM orders))"""


@query("tile_missing", _TILES)
def tile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    spans = view(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("video_id"), k.alias("agent_id"), F.lit("self").alias("target_id"), F.array(*map(F.lit, ("attack", "chase", "groom", "sniff"))).alias("actions"),
        (k % 7).alias("first_frame"), (k % 7 + 3 + k % 11).alias("end_frame"),
    )
    return decode.tiles(spans).drop("target_id")


_FILL_SQL = f"""WITH kept AS (SELECT video_id, CAST(agent_id AS VARCHAR) AS agent_id, CAST(target_id AS VARCHAR) AS target_id, action, start_frame, stop_frame FROM pred_raw WHERE start_frame < stop_frame AND video_id NOT IN (SELECT video_id FROM metadata WHERE {_SLEEP})),
l AS (SELECT DISTINCT video_id, replace(unnest(CAST(CAST(behaviors_labeled AS JSON) AS VARCHAR[])), '''', '') AS l FROM metadata WHERE behaviors_labeled IS NOT NULL AND video_id NOT IN (SELECT video_id FROM kept)),
g AS (SELECT video_id, split_part(l, ',', 1) AS agent_id, split_part(l, ',', 2) AS target_id, list(split_part(l, ',', 3) ORDER BY l) AS actions FROM l GROUP BY ALL),
x AS (SELECT g.*, lo, hi, CAST(ceil((hi - lo) / CAST(len(actions) AS DOUBLE)) AS BIGINT) AS size, unnest(range(len(actions))) AS i FROM g JOIN (SELECT video_id, min(video_frame) AS lo, max(video_frame) + 1 AS hi FROM frames GROUP BY video_id) r ON g.video_id = r.video_id)
SELECT * FROM kept UNION ALL SELECT video_id, agent_id, target_id, actions[i + 1], CAST(lo + i * size AS INT), CAST(least(lo + (i + 1) * size, hi) AS INT) FROM x""".replace("GROUP BY ALL", "GROUP BY video_id, split_part(l, ',', 1), split_part(l, ',', 2)")


@query("fill_missing_videos", _FILL_SQL)
def fill_missing_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Recordings of sleep are not predicted.
    asleep = view(spark, sf_dir, "metadata").filter(pose.is_sleeping()).select("video_id")
    some = decode.valid(view(spark, sf_dir, "pred_raw")).join(asleep, "video_id", "left_anti")
    return decode.fill_missing(some, view(spark, sf_dir, "metadata"), decode.frame_ranges(view(spark, sf_dir, "frames")))


@query("submission_rows", f"{_GREEDY} SELECT CAST(row_number() OVER (ORDER BY video_id, agent_id, target_id, start_frame) - 1 AS BIGINT) AS row_id, * FROM kept")
def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import with_row_id

    rows = with_row_id(_kept(spark, sf_dir), ["video_id", "agent_id", "target_id", "start_frame"])
    return rows.select("row_id", "video_id", "agent_id", "target_id", "action", "start_frame", "stop_frame")


# Metric.
def _solution(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = view(spark, sf_dir, "annotation")
    listed = a.filter("action <> 'error'").select("video_id", F.concat_ws(",", "agent_id", "target_id", "action").alias("l")).groupBy("video_id").agg(F.to_json(F.sort_array(F.collect_set("l"))).alias("behaviors_labeled"))
    labs = view(spark, sf_dir, "videos").select("video_id", "lab_id")
    return a.join(labs, "video_id").join(listed, "video_id", "left").fillna("[]", ["behaviors_labeled"]), _kept(spark, sf_dir)


_SCORE = _GREEDY + """, lab AS (SELECT video_id, lab_id FROM videos), act AS (SELECT DISTINCT video_id, agent_id, target_id, action FROM annotation WHERE action <> 'error'),
sol AS (SELECT a.*, lab_id FROM annotation a JOIN lab ON a.video_id = lab.video_id), pre AS (SELECT k.*, lab_id FROM kept k JOIN act USING (video_id, agent_id, target_id, action) JOIN lab ON k.video_id = lab.video_id),
tf AS (SELECT DISTINCT lab_id, video_id, agent_id, target_id, action, unnest(range(start_frame, stop_frame)) AS f FROM sol), pf AS (SELECT DISTINCT lab_id, video_id, agent_id, target_id, action, unnest(range(start_frame, stop_frame)) AS f FROM pre),
b AS (SELECT coalesce(t.lab_id, p.lab_id) AS lab_id, coalesce(t.action, p.action) AS action, t.f AS tf, p.f AS pf FROM tf t FULL JOIN pf p ON t.video_id = p.video_id AND t.agent_id = p.agent_id AND t.target_id = p.target_id AND t.action = p.action AND t.f = p.f),
n AS (SELECT DISTINCT lab_id, action FROM (SELECT lab_id, action FROM sol UNION ALL SELECT lab_id, action FROM pre)),
c AS (SELECT n.lab_id, n.action, count(*) FILTER (tf IS NOT NULL AND pf IS NOT NULL) AS tp, count(*) FILTER (tf IS NOT NULL AND pf IS NULL) AS fn, count(*) FILTER (tf IS NULL AND pf IS NOT NULL) AS fp FROM n LEFT JOIN b ON n.lab_id = b.lab_id AND n.action = b.action GROUP BY n.lab_id, n.action),
s AS (SELECT *, CASE WHEN tp + fn + fp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2.0::DOUBLE * tp + fn + fp) END AS f FROM c)"""


@query("frame_fbeta_action", f"{_SCORE} SELECT lab_id, action, tp, fn, fp, round(f, 9) AS f FROM s")
def frame_fbeta_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.action_scores(*_solution(spark, sf_dir)).withColumn("f", F.round("f", 9))


@query("frame_fbeta_lab", f"{_SCORE} SELECT lab_id, round(avg(f), 9) AS f FROM s GROUP BY lab_id")
def frame_fbeta_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.lab_scores(*_solution(spark, sf_dir)).withColumn("f", F.round("f", 9))


# Learning.
_SCORED = "(SELECT d.source AS action, d.doc_id, l.quality AS y, CAST((d.doc_id * 7919) % 1000 AS DOUBLE) / 1024 AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("action")).join(view(spark, sf_dir, "labels"), "doc_id")
    return rows.select("action", "doc_id", F.col("quality").alias("y"), (((F.col("doc_id") * 7919) % 1000).cast("double") / 1024).alias("p"))


_GRID = f"""SELECT k.action, CAST(t AS DOUBLE) / 100 AS threshold, CAST(count(*) FILTER (b >= t AND y = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (b >= t AND y <> 1) AS BIGINT) AS fp,
 CAST(count(*) FILTER (b < t AND y = 1) AS BIGINT) AS fn FROM (SELECT DISTINCT action FROM {_SCORED}) k CROSS JOIN range(101) r(t) JOIN (SELECT *, floor(round(p * 100, 9)) AS b FROM {_SCORED}) s ON s.action = k.action GROUP BY k.action, t"""


@query("threshold_grid", f"SELECT *, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM ({_GRID})")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.threshold_grid(_scored(spark, sf_dir)).withColumn("f1", F.round("f1", 9))


@query("best_threshold", f"""SELECT action, arg_min(threshold, (-f, threshold)) AS threshold, round(max(f), 9) AS f1 FROM
 (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f FROM ({_GRID})) GROUP BY action""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.best_thresholds(learning.threshold_grid(_scored(spark, sf_dir))).withColumn("f1", F.round("f1", 9))


@query("binary_f1", f"SELECT tp, fp, fn, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS f1 FROM (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn FROM {_SCORED})")
def binary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.binary_f1(_scored(spark, sf_dir), 0.5).withColumn("f1", F.round("f1", 9))


_HASH = "((doc_id * 2654435761) % 1000003)"
_TOTAL = 150


@query("stratified_quota", f"""WITH s AS (SELECT action, count(*) AS n, sum(y) AS p FROM {_SCORED} GROUP BY action), q AS (SELECT *, least(n, ceil(n * {_TOTAL}::DOUBLE / (SELECT sum(n) FROM s))) AS q FROM s),
w AS (SELECT *, least(p, greatest(floor(q * p / n), ceil(q * 0.05::DOUBLE))) AS qp FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY action, y ORDER BY {_HASH}, doc_id) AS i FROM {_SCORED})
SELECT r.action, doc_id, y FROM r JOIN w ON r.action = w.action WHERE i <= CASE WHEN y = 1 THEN w.qp ELSE least(w.q - w.qp, w.n - w.p) END""")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.quota_sample(_scored(spark, sf_dir), "action", "doc_id", _TOTAL).select("action", "doc_id", "y")


@query("stratified_subset", f"""WITH s AS (SELECT y, count(*) AS n FROM {_SCORED} GROUP BY y), w AS (SELECT y, floor(n * {_TOTAL}::DOUBLE / (SELECT sum(n) FROM s) + 0.5) AS q FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_HASH}, doc_id) AS i FROM {_SCORED}) SELECT doc_id, r.y FROM r JOIN w ON r.y = w.y WHERE i <= q""")
def stratified_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.stratified_subset(_scored(spark, sf_dir), "doc_id", _TOTAL).select("doc_id", "y")


_GREEDY_FOLDS = """sized AS (SELECT action, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, action) AS i FROM {rows} GROUP BY action),
dealt AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS action, CAST(0 AS BIGINT) AS n, 0 AS fold, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads
UNION ALL SELECT s.i, CAST(s.action AS VARCHAR), s.n, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER), list_transform(loads, lambda l, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN l + s.n ELSE l END)
FROM dealt d JOIN sized s ON s.i = d.i + 1)"""


@query("group_folds", f"WITH RECURSIVE {_GREEDY_FOLDS.format(rows=_SCORED)} SELECT action, n, CAST(fold AS INT) AS fold FROM dealt WHERE i > 0")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.group_folds(_scored(spark, sf_dir), "action", 5)


@query("class_balance", f"""SELECT action, n_pos, n_neg, CASE WHEN n_pos > 0 THEN round(n_neg::DOUBLE / n_pos, 9) ELSE 1 END AS scale_pos_weight, CASE WHEN n_pos = 0 OR n_neg = 0 THEN 'logloss' ELSE 'aucpr' END AS eval_metric,
 CASE WHEN n_pos < 0.005 * (n_pos + n_neg) THEN 1.75 WHEN n_pos < 0.02 * (n_pos + n_neg) THEN 1.4 ELSE 1.0 END::DOUBLE AS patience_factor FROM (SELECT action, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg FROM {_SCORED} GROUP BY action)""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.balance(labels.label_counts(_scored(spark, sf_dir))).withColumn("scale_pos_weight", F.round("scale_pos_weight", 9))


@query("ensemble_mean", f"SELECT video_id, mouse_id, video_frame, {r6('p')} FROM (SELECT *, (p_chase + p_groom + p_sniff) / 3 AS p FROM probabilities)")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learning.mean_probability(view(spark, sf_dir, "probabilities"), ["p_chase", "p_groom", "p_sniff"]), KEYS, ["p"])


_DIM = 64


@query("model_ensemble", None)
def model_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of two labels of every vector, from all its values, fitted side by side."""
    e, write = view(spark, sf_dir, "embeddings"), sinks.scratch_writer(spark, "ensemble")
    rows = write(e.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(_DIM))))
    painted = rows.select("vec_id", F.explode(F.array(F.struct(F.lit("odd").alias("action"), (F.col("label") % 2 == 1).alias("y")), F.struct(F.lit("low").alias("action"), (F.col("label") < 5).alias("y")))).alias("l")).select("vec_id", "l.*")
    settings = boosting.Settings(12, depth=4)
    oof = behaviour.cross_validated(rows.drop("label"), painted, ["vec_id"], ["low", "odd"], "vec_id", settings, 3, boosting.MOST_ROWS, write)
    return oof.select(F.col("key").cast("long").alias("vec_id"), "action", "y", "p")


@query("out_of_fold", """SELECT p_partkey, action, CAST(y AS INT) AS y, y AS said FROM (SELECT p_partkey, 'large' AS action, p_size >= 26 AS y FROM part UNION ALL SELECT p_partkey, 'middle', p_size BETWEEN 11 AND 30 FROM part)""")
def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a few splits tell: every part's label is said by a fit that never saw its brand. One row for each part and label."""
    parts, write, size = view(spark, sf_dir, "part"), sinks.scratch_writer(spark, "folds"), F.col("p_size")
    rows = write(parts.select("p_partkey", "p_brand", "p_size", "p_retailprice"))
    each = F.explode(F.array(F.struct(F.lit("large").alias("action"), (size >= 26).alias("y")), F.struct(F.lit("middle").alias("action"), size.between(11, 30).alias("y"))))
    painted = rows.select("p_partkey", "p_brand", each.alias("l")).select("p_partkey", "p_brand", "l.*")
    settings = boosting.Settings(12, 0.5, 3, least_weight=1.0, rows=1.0, columns=1.0)
    oof = behaviour.cross_validated(rows.drop("p_brand"), painted, ["p_partkey"], ["large", "middle"], "p_brand", settings, 5, boosting.MOST_ROWS, write)
    return oof.select(F.col("key").cast("long").alias("p_partkey"), "action", "y", (F.col("p") >= 0.5).alias("said"))


# Sources and sinks: what is written comes back.
_META = ["video_id", "lab_id", "frames_per_second", "arena_width_cm", "arena_height_cm", "arena_shape", "body_parts_tracked", "behaviors_labeled", "mouse1_condition", "mouse1_strain", "mouse1_sex", "mouse3_strain"]


@query("scan_metadata", f"SELECT {', '.join(f'trim({c}) AS {c}' if c in ('arena_shape', 'mouse1_strain', 'mouse1_sex') else c for c in _META)}, CAST(NULL AS VARCHAR) AS mouse4_sex FROM metadata")
def scan_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.scratch_folder(spark, "metadata") + "/csv"
    view(spark, sf_dir, "metadata").select(*_META).write.option("header", True).option("escape", '"').csv(path)
    return readers.read_metadata(spark, path).select(*_META, "mouse4_sex").withColumns({c: F.trim(c) for c in ("arena_shape", "mouse1_strain", "mouse1_sex")})


def _by_video(rows: DataFrame, path: str, frame: str) -> str:
    """Write a file of each lab and video."""
    sinks.write_videos(rows, path + "/files", frame)
    return path + "/files"


def _labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "videos").select("video_id", "lab_id")


@query("scan_tracking", "SELECT v.lab_id, t.video_id, t.video_frame, CAST(t.mouse_id AS VARCHAR) AS mouse_id, t.bodypart, t.x, t.y FROM track_long t JOIN videos v ON t.video_id = v.video_id")
def scan_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "track_long").join(_labs(spark, sf_dir), "video_id")
    return readers.read_tracking(spark, _by_video(rows, sinks.scratch_folder(spark, "tracking"), "video_frame"))


@query("scan_annotation", "SELECT v.lab_id, a.video_id, a.agent_id, a.target_id, a.action, a.start_frame, a.stop_frame FROM annotation a JOIN videos v ON a.video_id = v.video_id")
def scan_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "annotation").join(_labs(spark, sf_dir), "video_id")
    return readers.read_annotation(spark, _by_video(rows, sinks.scratch_folder(spark, "annotation"), "start_frame"))


@query("threshold_store", f"""SELECT action, arg_min(threshold, (-f, threshold)) AS threshold FROM
 (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f FROM ({_GRID})) GROUP BY action""")
def threshold_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuned thresholds, saved for two switches and loaded for one."""
    path, best = sinks.scratch_folder(spark, "thresholds") + "/store", learning.best_thresholds(learning.threshold_grid(_scored(spark, sf_dir)))
    for switch, t in (("pair", F.col("threshold")), ("single", F.lit(2.0)), ("pair", F.col("threshold"))):
        sinks.save_thresholds(best.select(F.lit("s").alias("section_slug"), F.lit(switch).alias("switch"), "action", t.alias("threshold")), path)
    return spark.createDataFrame(list(sinks.load_thresholds(spark, path, "s", "pair").items()), "action STRING, threshold DOUBLE")


@query("fallback_row", """WITH none AS (SELECT * FROM pred_raw WHERE stop_frame < start_frame), v AS (SELECT * FROM pred_raw WHERE start_frame < stop_frame)
SELECT 'none' AS source, n.* FROM none n UNION ALL SELECT 'none', 7, 1, 1, 'rear', 278, 500 WHERE NOT EXISTS (SELECT 1 FROM none)
UNION ALL SELECT 'valid', v.* FROM v UNION ALL SELECT 'valid', 7, 1, 1, 'rear', 278, 500 WHERE NOT EXISTS (SELECT 1 FROM v)""")
def fallback_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row stands in where there is no interval at all, and only there."""
    p, row = view(spark, sf_dir, "pred_raw"), (7, 1, 1, "rear", 278, 500)
    tables = {"none": p.filter("stop_frame < start_frame"), "valid": decode.valid(p)}
    one, two = (decode.fallback(t, row).select(F.lit(name).alias("source"), "*") for name, t in tables.items())
    return one.unionByName(two)


@query("frame_fbeta_mean", f"{_SCORE} SELECT round(avg(f), 9) AS f FROM (SELECT lab_id, avg(f) AS f FROM s GROUP BY lab_id)")
def frame_fbeta_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.lab_scores(*_solution(spark, sf_dir)).agg(F.round(F.avg("f"), 9).alias("f"))


@query("only_labelled", f"""WITH l AS (SELECT video_id, list(DISTINCT concat('p_', action)) AS mine FROM {_SPECS} GROUP BY video_id)
SELECT p.video_id, mouse_id, video_frame, {', '.join(f"CASE WHEN list_contains(mine, '{p}') THEN {p} END AS {p}" for p in _P)} FROM probabilities p LEFT JOIN l ON p.video_id = l.video_id""")
def only_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = labels.label_specs(view(spark, sf_dir, "metadata")).select("video_id", F.concat(F.lit("p_"), "action").alias("action"))
    return decode.only_labelled(view(spark, sf_dir, "probabilities"), mine, ("video_id",), _P).select(*KEYS, "video_frame", *_P)


_WITH_META = ["meta_fps", "meta_n_mice", "meta_arena_area_cm2", "meta_same_sex", "meta_agent_strain_code", "meta_arena_shape_code"]


@query("matrix_meta", f"""SELECT p.video_id, p.mouse_id, p.video_frame, {r6('nt')}, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _WITH_META)} FROM
 (SELECT *, sqrt((nose_x - tail_base_x) * (nose_x - tail_base_x) + (nose_y - tail_base_y) * (nose_y - tail_base_y)) AS nt FROM pose) p
 LEFT JOIN (SELECT * FROM ({ORACLES['meta_encode'].replace(chr(10), ' ')}) WHERE target = 'self') m ON p.video_id = m.video_id""")
def matrix_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the meta columns of their video and individual; videos without metadata have zeros."""
    rows = view(spark, sf_dir, "pose").withColumn("nt", F.sqrt(single.squared_distance("nose", "tail_base")))
    got = behaviour.with_meta(rows, meta_encode(spark, sf_dir).filter("target = 'self'"), ["video_id"])
    nt = rounded(got, KEYS, ["nt"])
    return nt.join(got.select(*KEYS, "video_frame", *_WITH_META), [*KEYS, "video_frame"])

"""Hand-built tables for poses, labels, decoding, intervals, the metric, learning, sources and sinks."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinelake.functions.rolling import Track
from kinelake.operators import decode, labels, learning, metric, pose, single
from kinelake.sources import readers, sinks

TRACK = "video_id long, mouse_id int, video_frame int, bodypart string, x double, y double"


def test_pivot_shares_frames_and_rejects_duplicates(spark):
    rows = [(1, 1, 0, "nose", 1.0, 2.0), (1, 1, 2, "nose", 3.0, None), (1, 2, 1, "tail", 5.0, 6.0)]
    got = {(r.mouse_id, r.video_frame): (r.nose_x, r.nose_y, r.tail_x) for r in pose.pivot(spark.createDataFrame(rows, TRACK), ["nose", "tail"]).collect()}
    assert len(got) == 6 and got[1, 0] == (1.0, 2.0, None) and got[2, 1] == (None, None, 5.0) and got[2, 2] == (None, None, None)
    with pytest.raises(Exception, match="more than one row"):
        pose.pivot(spark.createDataFrame(rows + rows[:1], TRACK), ["nose", "tail"]).collect()


def test_gap_filling_and_sanitize(spark):
    values = [None, 1.0, None, None, 4.0, None]
    rows = [(1, 1, i * 3, v, None, float("inf") if i == 2 else 2.0 * i) for i, v in enumerate(values)]
    t = Track(spark.createDataFrame(rows, "video_id int, mouse_id int, video_frame int, a double, b double, c double"), ("video_id", "mouse_id"))
    got = pose.sanitize(t, ["a", "b", "c"]).df.orderBy("video_frame").collect()
    assert [r.a for r in got] == [1, 1, 2, 3, 4, 4] and {r.b for r in got} == {0} and [r.c for r in got] == [0, 2, 4, 6, 8, 10]
    assert pose.fill_gaps(t, ["b"]).df.filter("b IS NOT NULL").count() == 0
    report = {r.column_name: (r.n_nan, r.n_pos_inf) for r in pose.non_finite_report(t.df, ["a", "b", "c"]).collect()}
    assert report == {"a": (4, 0), "b": (6, 0), "c": (0, 1)}


def test_features_of_one_frame_are_null_or_zero(spark):
    cols = {f"{p}_{a}": F.lit(1.0) for p in ("nose", "body_center", "tail_base", "ear_left", "ear_right") for a in "xy"}
    t = Track(spark.range(1).select(F.lit(1).alias("video_id"), F.lit(1).alias("mouse_id"), F.lit(0).alias("video_frame"), *(c.alias(n) for n, c in cols.items())), ("video_id", "mouse_id"), 30)
    r = single.long_range(t).df.first()
    assert r.x_ml480 is None and r.sp_pct15 is None
    assert single.speed_asymmetry(t).df.first().spd_asym_1s == 0 and single.speed_shift(t).df.first().spd_symkl_1s == 0
    assert single.centre_statistics(t).df.first().cx_s5 is None


def decoded(spark, rows, actions, mask=True, **more):
    t = Track(spark.createDataFrame(rows, "k int, video_frame int, " + ", ".join(f"{a} double" for a in actions)), ("k",))
    return decode.to_intervals(t.add({"__best": decode.best_action(actions, {"a": 0.6}, mask)}), actions, **more)


def test_decode_runner_up_ties_and_final_run(spark):
    rows = [(1, i, 0.5, 0.4) for i in range(4)] + [(1, i, 0.7, 0.7) for i in range(4, 8)] + [(1, i, None, 0.9) for i in range(8, 12)]
    got = {tuple(r) for r in decoded(spark, rows, ["a", "b"]).collect()}
    assert got == {(1, "b", 0, 4), (1, "a", 4, 8)}
    assert {tuple(r) for r in decoded(spark, rows, ["a", "b"], False).collect()} == {(1, "a", 4, 8)}
    assert (1, "b", 8, 12) in {tuple(r) for r in decoded(spark, rows, ["a", "b"], drop_last=False).collect()}
    assert decoded(spark, rows[:1], ["a", "b"]).count() == 0


INTERVAL = "video_id long, agent_id int, target_id int, action string, start_frame int, stop_frame int"


def test_greedy_overlap_tiles_and_fallback(spark):
    rows = [(1, 1, 2, "a", -1, 2), (1, 1, 2, "b", 0, 5), (1, 1, 2, "c", 4, 6), (1, 1, 2, "d", 5, 5), (1, 1, 2, "e", 5, 9), (1, 1, 2, "e", 9, 10), (1, 2, 1, "c", 4, 6)]
    kept = decode.without_overlap(spark.createDataFrame(rows, INTERVAL))
    assert sorted((r.agent_id, r.action, r.start_frame) for r in kept.collect()) == [(1, "b", 0), (1, "e", 5), (1, "e", 9), (2, "c", 4)]
    span = spark.createDataFrame([(1, "a", "b", ["p", "q", "r", "s"], 0, 5)], "video_id int, agent_id string, target_id string, actions array<string>, first_frame int, end_frame int")
    assert [(r.start_frame, r.stop_frame) for r in decode.tiles(span).orderBy("start_frame").collect()] == [(0, 2), (2, 4), (4, 5), (6, 5)]
    assert decode.tiles(span, strict=True).count() == 3
    none = spark.createDataFrame([], INTERVAL)
    assert decode.without_overlap(none).count() == 0
    assert decode.fallback(none, (9, 1, 2, "z", 0, 1)).collect()[0].action == "z" and decode.fallback(kept.select(*none.columns), (9, 1, 2, "z", 0, 1)).count() == 4


def test_label_specs_painting_and_codes(spark):
    meta = spark.createDataFrame([(1, """["mouse1,mouse2,Sniff","'mouse2',self,rear"]"""), (2, None)], "video_id long, behaviors_labeled string")
    specs = labels.label_specs(meta)
    assert {tuple(r) for r in specs.collect()} == {(1, "mouse1", "mouse2", "sniff"), (1, "mouse2", "self", "rear")}
    tracked = spark.createDataFrame([(1, 1), (1, 2)], "video_id long, mouse_id int")
    assert {tuple(r) for r in labels.resolve_agents(specs, tracked).collect()} == {(1, "mouse1", 1), (1, "mouse2", 2)}
    frames = spark.createDataFrame([(1, 1, i) for i in range(5)], "video_id long, agent_id int, video_frame int")
    marks = spark.createDataFrame([(1, 1, 2, "a", 1, 2), (1, 1, 2, "a", 2, 3), (1, 1, 2, "zz", 0, 4)], INTERVAL)
    wanted = spark.createDataFrame([(1, 1, 2, "a"), (1, 1, 2, "b")], "video_id long, agent_id int, target_id int, action string")
    y = {(r.action, r.video_frame) for r in labels.paint(frames, marks, wanted).filter("y").collect()}
    assert y == {("a", 1), ("a", 2), ("a", 3)}
    assert labels.paint(frames, marks, wanted, "left").filter("y").count() == 2
    codes = labels.fit_codes(spark.createDataFrame([(" B",), ("a",), ("b ",), (None,)], "s string"), "s")
    got = labels.apply_codes(spark.createDataFrame([("A",), ("new",), (None,)], "s string"), "s", codes, "c")
    assert {r.s: r.c for r in got.collect()} == {"A": 0, "new": -1, None: -1}


def test_metric_on_known_cases(spark):
    solution = spark.createDataFrame(
        [(1, 1, 2, "a_x", 0, 4, "L", '["1,2,a_x","1,2,b"]'), (1, 1, 2, "c", 4, 4, "L", '["1,2,a_x","1,2,b"]'), (2, 1, 2, "a", 0, 2, "M", '["1,2,a"]')],
        INTERVAL + ", lab_id string, behaviors_labeled string",
    )
    same = solution.select("video_id", "agent_id", "target_id", "action", "start_frame", "stop_frame")
    scores = {(r.lab_id, r.action): r.f for r in metric.action_scores(solution, same).collect()}
    assert scores == {("L", "x"): 1.0, ("L", "c"): 0.0, ("M", "a"): 1.0} and metric.score(solution, same) == 0.75
    extra = same.unionByName(spark.createDataFrame([(1, 1, 2, "b", 6, 8), (1, 1, 2, "not labelled", 0, 3), (99, 1, 2, "a", 0, 3)], INTERVAL))
    assert {(r.lab_id, r.action): (r.fp, r.f) for r in metric.action_scores(solution, extra).collect()}["L", "b"] == (2, 0.0)
    with pytest.raises(metric.OverlapError):
        metric.score(solution, same.unionByName(spark.createDataFrame([(1, 1, 2, "b", 2, 8)], INTERVAL)))
    with pytest.raises(ValueError):
        metric.score(solution, same.limit(0))
    with pytest.raises(ValueError):
        metric.score(solution, spark.createDataFrame([(1, 1, 2, "b", 9, 8)], INTERVAL))


def test_thresholds_sampling_and_folds(spark):
    scored = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.3), ("a", 1, 0.3), ("a", 0, 0.29), ("b", 0, 0.5)], "action string, y int, p double")
    best = {r.action: (r.threshold, r.f1) for r in learning.best_thresholds(learning.threshold_grid(scored)).collect()}
    assert best == {"a": (0.3, 1.0), "b": (0.0, 0.0)}
    rows = spark.range(2000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 100 == 0).cast("int").alias("y"))
    got = learning.quota_sample(rows, "g", "id", 200).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()
    assert {r.g: (r.n, r.p) for r in got} == {0: (100, 5), 1: (100, 0)}
    assert learning.quota_sample(rows, "g", "id", 5000).count() == 2000 and learning.stratified_subset(rows, "id", 100).count() == 100


def test_groups_go_to_the_lightest_fold(spark):
    rng = random.Random(6)
    for _ in range(300):
        k = rng.randint(1, 6)
        sizes = {rng.choice([1, 2, 3, 7, 50, 400, rng.randint(1, 2000)]): rng.randint(1, 60) for _ in range(rng.randint(1, 7))}
        loads, want = [0] * k, []
        for size in sorted(sizes, reverse=True):
            for i in range(sizes[size]):
                fold = loads.index(min(loads))
                loads[fold] += size
                want.append((size, i, fold))
        runs = learning.greedy_runs(list(sizes.items()), k)
        assert [(s, i, folds[(i - a) % len(folds)]) for s, a, b, folds in runs for i in range(a, b)] == want
        assert len(runs) <= len(sizes) * (4 * k + 4)
    rows = spark.range(3000).select((F.col("id") * F.col("id") % 97).alias("g"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("action"))
    got = learning.group_folds(rows, "g", 4, by="action").collect()
    count = Counter((r.action, r.g) for r in rows.collect())
    for action in "ab":
        loads = [0] * 4
        own = {r.g: (r.n, r.fold) for r in got if r.action == action}
        for n, g in sorted((-n, g) for (a, g), n in count.items() if a == action):
            assert own.pop(g) == (-n, loads.index(min(loads)))
            loads[loads.index(min(loads))] -= n
        assert not own


def test_sources_and_sinks(spark, tmp_path):
    schema = pa.schema([("video_frame", pa.int32()), ("mouse_id", pa.int32()), ("bodypart", pa.string()), ("x", pa.float64()), ("y", pa.float64())])
    track = pa.Table.from_pylist([{"video_frame": 0, "mouse_id": 1, "bodypart": "nose", "x": 1.0, "y": 2.0}], schema)
    for lab, video, n in (("lab a", 7, 1), ("b", 8, 0)):
        (tmp_path / "t" / lab).mkdir(parents=True)
        pq.write_table(track.slice(0, n), tmp_path / "t" / lab / f"{video}.parquet")
    got = readers.read_tracking(spark, str(tmp_path / "t")).collect()
    assert [(r.lab_id, r.video_id, r.bodypart) for r in got] == [("lab a", 7, "nose")]
    assert {r.video_id for r in readers.annotation_files(spark, str(tmp_path / "t")).collect()} == {7, 8}
    (tmp_path / "train.csv").write_text('video_id,lab_id,frames_per_second,behaviors_labeled\n7,"lab a",29.97,"[""mouse1,self,rear""]"\n')
    meta = readers.read_metadata(spark, str(tmp_path / "train.csv")).first()
    assert (meta.video_id, meta.frames_per_second, meta.behaviors_labeled, meta.mouse4_sex) == (7, 29.97, '["mouse1,self,rear"]', None)
    rows = spark.createDataFrame([(2, 1, 2, "a", 0, 4), (1, 1, 2, "a", 5, 6), (1, 1, 2, "b", 0, 3)], INTERVAL)
    sinks.write_submission(rows, str(tmp_path / "s"))
    text = next((tmp_path / "s").glob("*.csv")).read_text().splitlines()
    assert text == ["row_id,video_id,agent_id,target_id,action,start_frame,stop_frame", "0,1,1,2,b,0,3", "1,1,1,2,a,5,6", "2,2,1,2,a,0,4"]
    t = spark.createDataFrame([("s", "pair", "a", 0.4), ("s", "single", "a", 0.5)], "section_slug string, switch string, action string, threshold double")
    sinks.save_thresholds(t, str(tmp_path / "thr"))
    sinks.save_thresholds(t.filter("switch = 'pair'").withColumn("threshold", F.lit(0.9)), str(tmp_path / "thr"))
    assert sinks.load_thresholds(spark, str(tmp_path / "thr"), "s", "pair") == {"a": 0.9} and sinks.load_thresholds(spark, str(tmp_path / "thr"), "s", "single") == {"a": 0.5}


def test_a_video_is_one_file_whatever_its_tasks(spark, tmp_path):
    """Rows of a video lie in many tasks; only a long recording has more than one file. Thousands of files are not thousands of tasks."""
    rows = spark.range(4000).select((F.col("id") % 100).alias("video_id"), F.concat(F.lit("lab "), F.col("id") % 2).alias("lab_id"), F.expr("CAST(id DIV 100 AS INT)").alias("video_frame"), F.lit("1").alias("mouse_id"), F.lit("nose").alias("bodypart"), F.col("id").cast("double").alias("x"), F.when(F.col("id") % 3 == 0, 1.0).alias("y"))
    rows = rows.withColumn("video_frame", F.when(F.col("video_id") == 7, F.col("video_frame") + 1000).otherwise(F.col("video_frame"))).repartition(7)
    sinks.write_videos(rows, str(tmp_path / "v"), stretch=1020)
    files = [f.relative_to(tmp_path / "v").as_posix() for f in (tmp_path / "v").rglob("*") if f.is_file()]
    assert sorted(files) == sorted([f"0/lab {i % 2}/{i}.parquet" for i in range(100)] + ["1/lab 1/7.parquet"])
    got = readers.read_tracking(spark, str(tmp_path / "v"))
    columns = got.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.select(*columns).collect()))
    assert got.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    sinks.write_videos(rows, str(tmp_path / "v"), stretch=1020)  # written again, nothing is doubled
    assert readers.read_tracking(spark, str(tmp_path / "v")).count() == 4000

"""The whole way from poses to intervals on a small recording."""

import random
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinelake.functions.scalars import slug
from kinelake.operators import labels, pair, pose
from kinelake.operators.boosting import Settings
from kinelake.plans import behaviour, study
from kinelake.sources import readers, sinks
from kinelake.plans.views import view

from .conftest import SF

def test_matrices_training_and_prediction(spark):
    poses = view(spark, SF, "pose").filter("video_frame < 60").drop("fps", "event_id").cache()
    # Only the groups whose parts are there.
    assert {"sp_pct15", "act30", "x_e15"} <= set(behaviour.single_matrix(poses, ["body_center"], 30, clean=False).columns)
    single = behaviour.single_matrix(poses, ["nose", "tail_base"], 30)
    assert {"nose+tail_base", "nt_lg10"} <= set(single.columns) and not {"elong", "ear_con", "sp_pct15"} & set(single.columns)
    keys = ["video_id", "mouse_id", "video_frame"]
    assert single.count() == poses.count() and dict(single.dtypes)["nt_lg10"] == "float"
    small = single.select(*keys, "nt_lg10", "nt_df20").cache()
    # Every value is finite.
    assert small.filter("nt_lg10 IS NULL OR isnan(nt_lg10) OR nt_df20 IS NULL").count() == 0
    painted = small.select(*keys, F.lit("move").alias("action"), (F.col("video_frame") % 20 < 10).alias("y"))
    models, thresholds = behaviour.train(small, painted, keys, "mouse_id", (Settings(3, 0.3, least_weight=1.0),), 2)
    assert set(models) == {"move"} and 0 <= thresholds["move"] <= 1
    assert set(behaviour.predict(small, models, {"move": 0.3}, ("video_id", "mouse_id")).columns) == {"video_id", "mouse_id", "action", "start_frame", "stop_frame"}


def test_pair_matrix_has_context(spark):
    poses = view(spark, SF, "pose").filter("video_frame < 12").drop("fps", "event_id")
    got = behaviour.pair_matrix(poses, pair.ordered_pairs(poses), ["body_center", "nose"], 25, clean=False)
    assert {"12+nose+nose", "ctx_third_min_dist_mid_ratio", "sp_cor60", "nn_ct8_45"} <= set(got.columns) and "rel_ori" not in got.columns
    assert got.select("video_id", "agent_id", "target_id", "video_frame", "d_m5", "cl_ps100").count() == got.count() > 0


def recordings(folder, split, videos, rng):
    """Files of two labs, two rates and two sections; an individual moves where it is annotated to."""
    rows = []
    for video in videos:
        lab, fps = f"lab{video % 2}", 30.0 if video % 4 < 2 else 25.0
        parts = ["ear_left", "ear_right", "tail_base"] if video % 2 else ["tail_base"]
        spans, x = [(10, 29), (50, 69)], {1: 0.0, 2: 40.0}
        tracks = {n: [] for n in ("video_frame", "mouse_id", "bodypart", "x", "y")}
        for f in range(90):
            for m in x:
                x[m] += (8.0 if any(a <= f <= b for a, b in spans) else 0.05) * (1 if m == 1 else -0.2) + rng.uniform(0, 0.02)
                for k, p in enumerate(parts):
                    for n, v in zip(tracks, (f, m, p, x[m] + k, 5.0 * m + k)):
                        tracks[n].append(v)
        for name, t in (("tracking", pa.table(tracks)), ("annotation", pa.table({"agent_id": [1, 1, 1, 1], "target_id": [1, 1, 2, 2], "action": ["rear", "rear", "chase", "chase"], "start_frame": [10, 50, 10, 50], "stop_frame": [29, 69, 29, 69]}))):
            (folder / f"{split}_{name}" / lab).mkdir(parents=True, exist_ok=True)
            pq.write_table(t, folder / f"{split}_{name}" / lab / f"{video}.parquet")
        text = '"[""' + '"",""'.join(parts) + '""]"'
        rows.append(f"{video},{lab},{fps},10,20,,square,{text},\"[\"\"mouse1,self,Rear\"\",\"\"mouse1,mouse2,chase\"\",\"\"mouse2,self,sniff\"\"]\",CD-1,male,c57,f")
    head = "video_id,lab_id,frames_per_second,pix_per_cm_approx,arena_width_cm,arena_height_cm,arena_shape,body_parts_tracked,behaviors_labeled,mouse1_strain,mouse1_sex,mouse2_strain,mouse2_sex"
    (folder / f"{split}.csv").write_text("\n".join([head, *rows]) + "\n")


def load(spark, folder, split):
    read = lambda name: str(folder / f"{split}_{name}")
    return study.Study(
        readers.read_metadata(spark, str(folder / f"{split}.csv")), readers.read_tracking(spark, read("tracking")),
        readers.read_annotation(spark, read("annotation")), readers.annotation_files(spark, read("annotation")),
    )


def test_from_files_to_submission(spark, tmp_path):
    rng = random.Random(1)
    recordings(tmp_path, "train", (1, 3, 5), rng), recordings(tmp_path, "test", (21, 22), rng)
    train, test = load(spark, tmp_path, "train"), load(spark, tmp_path, "test")
    test.annotation = test.annotated = None
    options = study.Options((Settings(6, 0.3, 4, least_weight=1.0),), 2)
    got = study.run(train, test, str(tmp_path / "store"), options)
    rows = [tuple(r) for r in got.collect()]
    # The moving spans of video 21 are found; video 22 is of a section without training videos, and gets tiles.
    actions = {(r[0], r[1], r[2], r[3]) for r in rows}
    assert (21, "mouse1", "self", "rear") in actions and (21, "mouse1", "mouse2", "chase") in actions
    assert all(r[4] < r[5] for r in rows) and {a for a in actions if a[0] == 22} == {(22, "mouse1", "self", "Rear"), (22, "mouse1", "mouse2", "chase"), (22, "mouse2", "self", "sniff")}
    for start, stop in ((10, 29), (50, 69)):
        assert any(abs(r[4] - start) <= 8 and abs(r[5] - stop) <= 12 for r in rows if r[:4] == (21, "mouse1", "self", "rear"))
    matrix = spark.read.parquet(f"{tmp_path}/store/ear-left-ear-right-tail-base-train/matrix-single")
    assert {"meta_same_sex", "meta_fps", "sp_lf_l5"} <= set(matrix.columns) and {r[0] for r in matrix.select("meta_fps").distinct().collect()} == {30.0, 25.0}
    sinks.write_submission(got, str(tmp_path / "out"))
    assert len(next((tmp_path / "out").glob("*.csv")).read_text().splitlines()) == len(rows) + 1
    # What that run stored is taken instead of fitting, where there is any, and gives the same probabilities.
    at, keys, store = "ear-left-ear-right-tail-base", [*study.KEYS, "video_frame"], str(tmp_path / "store")
    painted = spark.read.parquet(f"{store}/{at}-train/labels-single")
    stored, none = study.Options((), thresholds_from=store, models_from=store), study.Options((), adaptive=False)
    models, columns = study.models_of(stored, matrix, painted, keys, f"{at}-single")
    thresholds = study.thresholds_of(stored, matrix, painted, keys, at, "single")
    assert set(models) == {"rear"} and columns == [c for c in matrix.columns if c not in keys] and set(thresholds) == {"rear"}
    found = behaviour.predict(matrix, models, thresholds, study.KEYS)
    assert {(r.video_id, r.action) for r in found.collect()} == {(1, "rear"), (3, "rear"), (5, "rear")}
    assert study.thresholds_of(none, matrix, painted, keys, at, "single") == {}
    # Stored models of an action that the labels at hand lack are dropped, if asked.
    assert study.models_of(stored, matrix, painted.filter("NOT y"), keys, f"{at}-single")[0] == {}
    kept = study.Options((), models_from=store, check_stored=False)
    assert set(study.models_of(kept, matrix, painted.filter("NOT y"), keys, f"{at}-single")[0]) == {"rear"}


def test_tracks_are_scanned_once_for_all_sections(spark, tmp_path):
    recordings(tmp_path, "train", (1, 2, 3, 4), random.Random(2))
    train = load(spark, tmp_path, "train")
    tracks = study.by_section(train, str(tmp_path / "store" / "tracks"), 3)
    assert tracks.count() == train.tracking.count() and {(r[0], r[1]) for r in tracks.select("section", "rate").distinct().collect()} == {
        ("tail-base", 30.0), ("tail-base", 25.0), ("ear-left-ear-right-tail-base", 30.0), ("ear-left-ear-right-tail-base", 25.0)}
    # Nothing after it reads the files: they can go.
    shutil.rmtree(tmp_path / "train_tracking")
    for section in pose.sections(train.metadata).collect():
        name = spark.range(1).select(slug(F.lit(section.body_parts_tracked))).first()[0]
        made = study.prepared(train, tracks, section.body_parts_tracked, name, list(section.parts), str(tmp_path / "store" / name))
        assert set(made.poses) <= {25.0, 30.0} and all(p.count() == 180 * {1: 1, 2: 1, 3: 1, 4: 1}[p.first().video_id] for p in made.poses.values())
        assert all(p.filter(" OR ".join(f"`{q}_x` IS NULL" for q in section.parts)).count() == 0 for p in made.poses.values())
    own = tracks.filter("section = 'tail-base' AND rate = 25.0")
    plan = own.groupBy("video_id", "video_frame").count()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(section" in plan and "Exchange" not in plan.replace("AdaptiveSparkPlan", "") and len(own.inputFiles()) <= 3


def test_only_labelled_actions_and_thinning(spark):
    scored = spark.createDataFrame([(1, "a", "b", 0, 0.9, 0.8)], "video_id long, agent_id string, target_id string, video_frame int, x double, y double")
    from kinelake.operators import decode

    wanted = spark.createDataFrame([(1, "a", "b", "y"), (2, "a", "b", "x")], "video_id long, agent_id string, target_id string, action string")
    r = decode.only_labelled(scored, wanted, study.KEYS, ["x", "y"]).first()
    assert (r.x, r.y) == (None, 0.8)
    features = spark.range(1000).selectExpr("id % 2 AS video_id", "'m' AS agent_id", "'self' AS target_id", "CAST(id AS INT) AS video_frame", "1.0F AS f")
    painted = labels.paint(features, features.limit(1).selectExpr("0L AS video_id", "agent_id", "target_id", "'z' AS action", "0 AS start_frame", "20 AS stop_frame"), features.selectExpr("video_id", "agent_id", "target_id", "'z' AS action").distinct())
    assert study.thinned(features, painted, 100).count() == pytest.approx(100, abs=4) and study.thinned(features, painted, 1000).count() == 1000

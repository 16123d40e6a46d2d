"""Queries of trajectories cut into blocks, held against the SQL of whole ones; tracks by section; and the whole way to intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.rolling import Track, together
from ..functions.scaling import scale
from ..operators import single
from ..operators.boosting import Settings
from ..sources import sinks
from . import flow_queries, single_queries, study
from .oracle import FPS
from .single_queries import FEATURES, KEYS, by_rate, rounded
from .views import view, with_views

QUERIES: dict = {}
ORACLES: dict = {}
#: Rows of a block: about a tenth of the longest trajectory.
SIZE = 100


def _numbered(spark: SparkSession, sf_dir: str):
    write = sinks.scratch_writer(spark, "blocks")
    return blocks.numbered(Track(write(view(spark, sf_dir, "pose")), KEYS), write), write


def in_blocks(groups: list, columns: list[str], reach: int):
    """The groups' features on blocks with a halo of ``reach`` frames at 30 fps."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def features(t: Track) -> DataFrame:
            cut = together(blocks.cut(t, SIZE, scale(reach, t.fps)), groups)
            return rounded(blocks.own_rows(cut).df, KEYS, columns)

        return by_rate(_numbered(spark, sf_dir)[0].df, KEYS, features)

    return query


for _name, _reach in (("rolling_centered", 30), ("rolling_trailing", 30), ("rolling_future", 30), ("single_multiscale", 165), ("single_longrange", 485), ("single_states", 140), ("single_segment", 50), ("single_groom", 35)):
    _f, _columns = FEATURES[_name]
    QUERIES[f"blocks_{_name}"], ORACLES[f"blocks_{_name}"] = in_blocks([_f], _columns, _reach), single_queries.ORACLES[_name]

# Several groups on one exchange, in blocks.
_GROUPS = ("single_centre_statistics", "single_states", "single_longrange", "single_symkl", "single_segment", "single_ear")
QUERIES["blocks_matrix"] = in_blocks([FEATURES[n][0] for n in _GROUPS], [c for n in _GROUPS for c in FEATURES[n][1]], 490)
ORACLES["blocks_matrix"] = "SELECT * FROM " + " JOIN ".join(f"({single_queries.ORACLES[n]})" + (" USING (video_id, mouse_id, video_frame)" if i else "") for i, n in enumerate(_GROUPS))


def blocks_single_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    track, write = _numbered(spark, sf_dir)
    columns = list(single.smoothing_spans(FPS[0]))
    return by_rate(track.df, KEYS, lambda t: rounded(blocks.smoothed(t, single.smoothing_spans(t.fps), write, SIZE), KEYS, columns))


def blocks_interp_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    track, write = _numbered(spark, sf_dir)
    return rounded(blocks.filled(track, flow_queries._FILL, write, SIZE), KEYS, flow_queries._FILL)


QUERIES |= {"blocks_single_ewm": blocks_single_ewm, "blocks_interp_linear": blocks_interp_linear}
ORACLES |= {"blocks_single_ewm": single_queries.ORACLES["single_ewm"], "blocks_interp_linear": flow_queries.ORACLES["interp_linear"]}


def tracks_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each partition of a section and a rate holds of each video, after one scan of all tracks."""
    path = sinks.scratch_folder(spark, "sections") + "/tracks"
    rows = study.by_section(study.Study(view(spark, sf_dir, "metadata"), view(spark, sf_dir, "track_long")), path)
    return rows.groupBy("section", F.col("rate").cast("double").alias("rate"), "video_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("bodypart").alias("n_parts"), F.max("video_frame").alias("last_frame"))


QUERIES["tracks_by_section"] = tracks_by_section
ORACLES["tracks_by_section"] = with_views(
    "SELECT trim(regexp_replace(body_parts_tracked, '[^A-Za-z0-9]+', '-', 'g'), '-') AS section, coalesce(frames_per_second, 30) AS rate, t.video_id, count(*) AS n_rows, count(DISTINCT bodypart) AS n_parts, max(video_frame) AS last_frame"
    " FROM track_long t JOIN metadata m ON t.video_id = m.video_id GROUP BY 1, 2, 3"
)


def study_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From tracks, annotations and metadata to intervals without overlap: learned from the recordings of two labs, for those of the third.

    Events stand for behaviours, so there is little to learn; every labelled
    test video has intervals or tiles. Thresholds are the fixed one: tuning has
    queries of its own.
    """
    path = sinks.scratch_folder(spark, "study")
    marks = view(spark, sf_dir, "annotation")
    name = lambda c: F.concat(F.lit("mouse"), F.col(c))
    listed = marks.select("video_id", F.concat_ws(",", name("agent_id"), F.when(F.col("agent_id") == F.col("target_id"), F.lit("self")).otherwise(name("target_id")), "action").alias("l"))
    listed = listed.groupBy("video_id").agg(F.to_json(F.sort_array(F.collect_set("l"))).alias("behaviors_labeled"))
    own = view(spark, sf_dir, "metadata").drop("lab_id", "behaviors_labeled", "body_parts_tracked", "frames_per_second")
    videos = view(spark, sf_dir, "videos").select("video_id", "lab_id", "pix_per_cm_approx").join(own, "video_id", "left").join(listed, "video_id")
    videos = videos.withColumns({"body_parts_tracked": F.lit('["body_center"]'), "frames_per_second": F.lit(None).cast("double")})
    for c in ("mouse3_sex", "mouse4_sex"):
        videos = videos.withColumn(c, F.lit(None).cast("string"))
    write = sinks.scratch_writer(spark, "videos")
    videos, tracks = write(videos), view(spark, sf_dir, "track_long").filter("bodypart = 'body_center'").withColumn("mouse_id", F.col("mouse_id").cast("string"))
    train = study.Study(videos.filter("lab_id <> 'lab2'"), tracks, marks, marks.select("video_id").distinct())
    test = study.Study(videos.filter("lab_id = 'lab2'"), tracks)
    return study.run(train, test, path, study.Options((Settings(4, 0.3, 3, least_weight=1.0),), adaptive=False))


QUERIES["study_run"] = study_run

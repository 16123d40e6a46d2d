"""Pose-shaped views over the test tables, as one SQL text for Spark and for DuckDB.

Only integer arithmetic and exact binary fractions, so both engines compute on
identical inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

VIEWS = {
    "frames": """
SELECT CAST(floor(user_id / 3.0) AS INT) AS video_id, CAST(user_id % 3 + 1 AS INT) AS mouse_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS video_frame,
  event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS px, CAST(event_id % 97 AS DOUBLE) AS py
FROM events""",
    "frames_long": """
SELECT CAST(floor(event_id / 3000.0) AS INT) AS video_id, CAST(event_id % 3 + 1 AS INT) AS mouse_id,
  CAST(row_number() OVER (PARTITION BY floor(event_id / 3000.0), event_id % 3 ORDER BY ts, event_id) - 1 AS INT) AS video_frame,
  event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS px, CAST(event_id % 97 AS DOUBLE) AS py
FROM events""",
    "track_long": """
SELECT video_id, mouse_id, video_frame, 'body_center' AS bodypart, px AS x, CASE WHEN px IS NULL THEN NULL ELSE py END AS y FROM frames
UNION ALL SELECT video_id, mouse_id, video_frame, 'nose', px + CAST(event_id % 7 AS DOUBLE) / 2, py + CAST(event_id % 5 AS DOUBLE) / 4 FROM frames
UNION ALL SELECT video_id, mouse_id, video_frame, 'tail_base', px - CAST(event_id % 3 AS DOUBLE) * 3 / 4, py - CAST(event_id % 4 AS DOUBLE) / 2 FROM frames
UNION ALL SELECT video_id, mouse_id, video_frame, 'ear_left', px + CAST(1 AS DOUBLE) / 4, py + CAST(event_id % 3 AS DOUBLE) / 2 FROM frames
UNION ALL SELECT video_id, mouse_id, video_frame, 'ear_right', px + CAST(1 AS DOUBLE) / 4, py - CAST(event_id % 2 AS DOUBLE) / 2 FROM frames""",
    # One row per individual and frame with a column pair per part, in cm; three frame rates.
    "pose": """
SELECT video_id, mouse_id, video_frame, event_id,
  CAST(CASE video_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 25 ELSE 60 END AS INT) AS fps,
  px / 4 AS body_center_x, CASE WHEN px IS NULL THEN NULL ELSE py / 4 END AS body_center_y,
  (px + CAST(event_id % 7 AS DOUBLE) / 2) / 4 AS nose_x, (py + CAST(event_id % 5 AS DOUBLE) / 4) / 4 AS nose_y,
  (px - CAST(event_id % 3 AS DOUBLE) * 3 / 4) / 4 AS tail_base_x, (py - CAST(event_id % 4 AS DOUBLE) / 2) / 4 AS tail_base_y,
  (px + CAST(1 AS DOUBLE) / 4) / 4 AS ear_left_x, (py + CAST(event_id % 3 AS DOUBLE) / 2) / 4 AS ear_left_y,
  (px + CAST(1 AS DOUBLE) / 4) / 4 AS ear_right_x, (py - CAST(event_id % 2 AS DOUBLE) / 2) / 4 AS ear_right_y
FROM frames_long""",
    "videos": """
SELECT video_id, concat('lab', CAST(video_id % 3 AS VARCHAR(9))) AS lab_id,
  CAST(CASE video_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 25 ELSE 60 END AS DOUBLE) AS frames_per_second,
  CAST(1 AS DOUBLE) + CAST(video_id % 4 AS DOUBLE) / 2 AS pix_per_cm_approx,
  count(DISTINCT mouse_id) AS n_mice, max(video_frame) AS last_frame
FROM frames GROUP BY video_id""",
    "annotation": """
SELECT video_id, mouse_id AS agent_id, CASE WHEN event_id % 2 = 0 THEN mouse_id ELSE mouse_id % 3 + 1 END AS target_id,
  event_type AS action, video_frame AS start_frame, CAST(video_frame + 3 + event_id % 5 AS INT) AS stop_frame
FROM frames""",
    "pred_raw": """
SELECT video_id, mouse_id AS agent_id, CASE WHEN event_id % 2 = 0 THEN mouse_id ELSE mouse_id % 3 + 1 END AS target_id,
  event_type AS action, video_frame AS start_frame, CAST(video_frame + event_id % 6 AS INT) AS stop_frame
FROM frames""",
    # Probabilities of four actions at each frame.
    "probabilities": """
SELECT video_id, mouse_id, video_frame,
  CAST((event_id * 7) % 101 AS DOUBLE) / 128 AS p_chase, CAST((event_id * 13) % 101 AS DOUBLE) / 128 AS p_groom,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST((event_id * 29) % 101 AS DOUBLE) / 128 END AS p_rear,
  CAST((event_id * 41) % 101 AS DOUBLE) / 128 AS p_sniff
FROM frames""",
    # Video metadata as a scan of the csv gives it.
    "metadata": """
SELECT c_custkey AS video_id, concat(CASE c_nationkey % 3 WHEN 0 THEN 'MABe22_' ELSE 'Lab' END, CAST(c_nationkey % 7 AS VARCHAR(9))) AS lab_id,
  CAST(CASE c_custkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 25 ELSE 60 END AS DOUBLE) AS frames_per_second,
  CASE c_custkey % 5 WHEN 0 THEN 'Lights On' WHEN 1 THEN 'lights on' WHEN 2 THEN 'dark' WHEN 3 THEN NULL ELSE 'lights off' END AS mouse1_condition,
  concat('Strain', CAST(c_nationkey AS VARCHAR(9)), ' ') AS mouse1_strain,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('strain', CAST(c_custkey % 6 AS VARCHAR(9))) END AS mouse2_strain,
  CASE WHEN c_custkey % 3 = 0 THEN 'CD-1' ELSE NULL END AS mouse3_strain, CASE WHEN c_custkey % 7 = 0 THEN 'c57' ELSE NULL END AS mouse4_strain,
  CASE c_custkey % 4 WHEN 0 THEN ' Male' WHEN 1 THEN 'f' WHEN 2 THEN 'unknown' ELSE NULL END AS mouse1_sex,
  CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'FEMALE' ELSE NULL END AS mouse2_sex,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(20 + c_custkey % 40 AS DOUBLE) END AS arena_width_cm,
  CAST(30 + c_custkey % 16 AS DOUBLE) AS arena_height_cm,
  CASE c_custkey % 5 WHEN 0 THEN 'Square' WHEN 1 THEN 'circular ' WHEN 2 THEN NULL ELSE 'rectangular' END AS arena_shape,
  CASE c_custkey % 3 WHEN 0 THEN '["body_center","nose"]' WHEN 1 THEN '["nose","body_center","tail_base","ear_left","ear_right","neck"]' ELSE '["tail_base"]' END AS body_parts_tracked,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '["mouse1,mouse2,Sniff","mouse1,self,rear","mouse1,mouse2,Sniff"]'
    WHEN 2 THEN '["''mouse2'',mouse1,Chase"]' ELSE '["mouse2,self,groom","mouse1,mouse2,attack"]' END AS behaviors_labeled
FROM customer""",
}


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\bFROM {v}\b|\bJOIN {v}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = [t for t in (*BASE, *VIEWS) if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    # Doubled braces aside, the texts hold none of their own.
    return spark.sql(sql, **{t: view(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """The SQL with the views it uses as common tables before its own."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for v in _needs(text):
            if v not in needed:
                visit(VIEWS[v])
                needed.append(v)

    visit(sql)
    sql = sql.strip()
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    if not needed:
        return sql
    if re.match(r"WITH RECURSIVE\b", sql):
        return f"WITH RECURSIVE {ctes}, {sql[len('WITH RECURSIVE'):]}"
    if re.match(r"WITH\b", sql):
        return f"WITH {ctes}, {sql[len('WITH'):]}"
    return f"WITH {ctes} {sql}"

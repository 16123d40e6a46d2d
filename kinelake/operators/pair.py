"""Features of an ordered pair: one row per (video, agent, target, frame).

``align`` joins the poses of both individuals on the frame, as ``A_<part>_x``
and ``B_<part>_x``; the other functions add columns to such a Track.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import Roll, Track, centred, trailing
from ..functions.scalars import cosine, indicator, norm, over, square, wrapped
from ..functions.scaling import scale, scale_signed

KEYS = ("video_id", "agent_id", "target_id")
# Lags in frames at 30 fps.
LAGS = (1, 2, 3, 4, 5, 10, 20, 30, 40, 50, 60)
NOSE_LAGS = (*range(1, 10), *range(10, 101, 10))


def ordered_pairs(pose: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(video_id, agent_id, target_id) of all ordered pairs of individuals; only labelled ones, if given.

    A self-join of the few individuals of each video, never of frames.
    """
    who = pose.select("video_id", "mouse_id").distinct()
    pairs = who.withColumnRenamed("mouse_id", "agent_id").join(who.withColumnRenamed("mouse_id", "target_id"), "video_id").filter("agent_id <> target_id")
    return pairs if labelled is None else pairs.join(labelled, ["video_id", "agent_id", "target_id"], "left_semi")


def align(pose: DataFrame, pairs: DataFrame, parts: list[str], constants: tuple[str, ...] = ()) -> DataFrame:
    """Both poses of each pair on the frames that both have; ``constants`` are columns of the video."""
    coords = [f"{p}_{a}" for p in parts for a in "xy"]
    side = lambda who, tag, more: pose.select(
        "video_id", F.col("mouse_id").alias(who), "video_frame", *more, *(F.col(c).alias(f"{tag}_{c}") for c in coords)
    )
    # Both joins are on the video first, so that one exchange by (video, frame) serves the pair.
    agents = side("agent_id", "A", constants).join(pairs, ["video_id", "agent_id"])
    return agents.join(side("target_id", "B", ()), ["video_id", "video_frame", "target_id"])


def _d(who: str, part: str, other: str, part2: str, axis: str) -> Column:
    return F.col(f"{who}_{part}_{axis}") - F.col(f"{other}_{part2}_{axis}")


def distances(track: Track, parts: list[str]) -> Track:
    """Squared distances from each part of the agent to each of the target."""
    return track.add({f"12+{p}+{q}": square(_d("A", p, "B", q, "x")) + square(_d("A", p, "B", q, "y")) for p, q in product(parts, parts)})


def lagged_displacement(track: Track) -> Track:
    """Squared way of an ear from where its own or the other's was some frames ago."""
    out = {}
    for base in LAGS:
        lag = scale(base, track.fps)
        for name, now, then in (("sp_A", "A", "A"), ("sp_AB", "A", "B"), ("sp_B", "B", "B")):
            out[f"{name}_l{base}"] = sum((square(F.col(f"{now}_ear_left_{a}") - track.lag(f"{then}_ear_left_{a}", lag)) for a in "xy"), F.lit(0.0))
    track = track.add(out)
    return track.add({n: F.col(f"{n}_l10") for n in ("sp_A", "sp_AB", "sp_B")})


def orientation(track: Track) -> Track:
    """Cosine of the body axes, and whether they are parallel, opposed or across."""
    a, b = ([_d(w, "nose", w, "tail_base", axis) for axis in "xy"] for w in "AB")
    track = track.add({"rel_ori": cosine(*a, *b)})
    c = F.col("rel_ori")  # fixed values: bounds of the cosine
    return track.add({
        "head_cos": c, "head_parallel": indicator(c > 0.5), "head_antipar": indicator(c < -0.5), "head_side": indicator((c >= -0.5) & (c <= 0.5)),
    })


def facing(track: Track) -> Track:
    """Cosine between the body axis and the way to the other's centre, for both, with bins."""
    out = {}
    for me, other in ("AB", "BA"):
        head = F.atan2(_d(me, "nose", me, "tail_base", "y"), _d(me, "nose", me, "tail_base", "x"))
        to = F.atan2(_d(other, "body_center", me, "nose", "y"), _d(other, "body_center", me, "nose", "x"))
        out[f"{me}_face_cos"] = F.cos(wrapped(to - head))
    track, bins = track.add(out), {}
    for me in "AB":
        c = F.col(f"{me}_face_cos")  # fixed values: bounds of the cosine
        bins |= {f"{me}_face_front": indicator(c > 0.7), f"{me}_face_back": indicator(c < -0.5), f"{me}_face_side": indicator((c <= 0.7) & (c >= -0.5))}
    return track.add(bins)


def wedges(track: Track) -> Track:
    """The angle between the ears as seen from the other's nose."""
    out = {}
    for me, other in ("AB", "BA"):
        left, right = (F.atan2(_d(other, "nose", me, ear, "y"), _d(other, "nose", me, ear, "x")) for ear in ("ear_left", "ear_right"))
        out[f"{me}_ear_wedge"] = F.abs(wrapped(left - right))
    return track.add(out)


def approach(track: Track) -> Track:
    """Change of the squared nose distance over ten frames."""
    track = track.add({"__nn2": square(_d("A", "nose", "B", "nose", "x")) + square(_d("A", "nose", "B", "nose", "y"))})
    return track.add({"appr": track.diff("__nn2", scale(10, track.fps))})


def _centres(track: Track) -> Track:
    """Squared centre distance, and both velocities."""
    track = track.add({"__cd2": square(_d("A", "body_center", "B", "body_center", "x")) + square(_d("A", "body_center", "B", "body_center", "y"))})
    return track.add({f"__{w}v{a}": track.diff(f"{w}_body_center_{a}") for w in "AB" for a in "xy"})


def distance_bins(track: Track) -> Track:
    cd = F.sqrt(square(_d("A", "body_center", "B", "body_center", "x")) + square(_d("A", "body_center", "B", "body_center", "y")))
    # Bounds of the distance in cm.
    return track.add({
        "v_cls": indicator(cd < 5), "cls": indicator((cd >= 5) & (cd < 15)), "med": indicator((cd >= 15) & (cd < 30)), "far": indicator(cd >= 30),
    })


def closeness(track: Track) -> Track:
    """Windowed statistics of the squared distance and of moving together."""
    track = _centres(track)
    track = track.add({"__co": F.col("__Avx") * F.col("__Bvx") + F.col("__Avy") * F.col("__Bvy")})
    rolls: dict[str, Roll] = {}
    for w in (5, 15, 30, 60):
        ws = scale(w, track.fps)
        rolls |= {f"d_{k}{w}": centred("__cd2", kind, ws) for k, kind in (("m", "mean"), ("s", "std"), ("mn", "min"), ("mx", "max"))}
        rolls |= {f"__var{w}": centred("__cd2", "var", ws), f"co_m{w}": centred("__co", "mean", ws), f"co_s{w}": centred("__co", "std", ws)}
    track = track.roll(rolls)
    return track.add({f"int{w}": F.lit(1.0) / (F.lit(1.0) + F.col(f"__var{w}")) for w in (5, 15, 30, 60)})


def _noses(track: Track) -> Track:
    return track.add({"__nn": norm(_d("A", "nose", "B", "nose", "x"), _d("A", "nose", "B", "nose", "y"))})


def nose_distance(track: Track) -> Track:
    """Nose distance some frames ago, its change since, and the share of frames under 10 cm."""
    track = _noses(track)
    out = {}
    for base in NOSE_LAGS:
        lag = scale(base, track.fps)
        out |= {f"nn_lg{base}": track.lag("__nn", lag), f"nn_ch{base}": track.diff("__nn", lag)}
    track = track.add(out | {"__close": indicator(F.col("__nn") < 10)})
    return track.roll({f"cl_ps{base}": trailing("__close", "mean", scale(base, track.fps)) for base in NOSE_LAGS})


def nose_motion(track: Track) -> Track:
    """Radial and lateral speed of the noses towards each other; their speeds, now and before."""
    track = _noses(track).add({f"__{w}n{a}": track.diff(f"{w}_nose_{a}") for w in "AB" for a in "xy"})
    dx, dy = F.col("__Anx") - F.col("__Bnx"), F.col("__Any") - F.col("__Bny")
    rx, ry = _d("A", "nose", "B", "nose", "x"), _d("A", "nose", "B", "nose", "y")
    track = track.add({
        "nn_rad_sp": F.coalesce(over(dx * rx + dy * ry, F.col("__nn")) * track.fps, F.lit(0.0)),
        "nn_lat_sp": F.coalesce(over(dx * -ry + dy * rx, F.col("__nn")) * track.fps, F.lit(0.0)),
        **{f"nose_spd{w}": norm(F.col(f"__{w}nx"), F.col(f"__{w}ny")) * track.fps for w in "AB"},
    }).add({"nose_spd_gap": F.col("nose_spdA") - F.col("nose_spdB")})
    return track.add({f"{n}_lg{k}": track.lag(n, scale(k, track.fps)) for k in LAGS for n in ("nose_spdA", "nose_spdB", "nose_spd_gap")})


def contact(track: Track) -> Track:
    """Windowed nose distance and shares of frames under three distances."""
    track = _noses(track)
    track, rolls = track.add({f"__under{t}": indicator(F.col("__nn") < t) for t in (8, 12, 15)}), {}
    for w in (5, 15, 45):
        ws = scale(w, track.fps)
        rolls |= {f"nn_mean{w}": centred("__nn", "mean", ws), f"nn_std{w}": centred("__nn", "std", ws)}
        rolls |= {f"nn_ct{t}_{w}": centred(f"__under{t}", "mean", ws) for t in (8, 12, 15)}
    return track.roll(rolls)


def velocity_alignment(track: Track, offsets: tuple[int, ...] = (-20, -10, 10, 20)) -> Track:
    """Cosine of the velocities before and after, and the distance's coefficient of variation."""
    track = _centres(track)
    track = track.add({"__va": cosine(*(F.col(f"__{w}v{a}") for w in "AB" for a in "xy"))})
    track = track.add({f"va_{o}": track.lag("__va", -scale_signed(o, track.fps)) if o else F.col("__va") for o in offsets})
    ws = scale(30, track.fps)
    track = track.roll({"__s": centred("__cd2", "std", ws), "__m": centred("__cd2", "mean", ws)})
    return track.add({"int_con": over(F.col("__s"), F.col("__m"))})


def interaction(track: Track) -> Track:
    """Who moves towards whom, chasing, and the correlation of the speeds."""
    track = _centres(track)
    rx, ry = _d("A", "body_center", "B", "body_center", "x"), _d("A", "body_center", "B", "body_center", "y")
    track = track.add({"__rel": norm(rx, ry), **{f"__{w}sp": norm(F.col(f"__{w}vx"), F.col(f"__{w}vy")) for w in "AB"}})
    lead = lambda w, sign: over(F.col(f"__{w}vx") * rx * sign + F.col(f"__{w}vy") * ry * sign, F.col(f"__{w}sp") * F.col("__rel"))
    track = track.add({"__Al": lead("A", 1), "__Bl": lead("B", -1)})
    track, rolls = track.add({"__chase": -track.diff("__rel") * F.col("__Bl")}), {}
    for w in (30, 60):
        ws = scale(w, track.fps)
        rolls |= {f"{who}_ld{w}": trailing(f"__{who}l", "mean", ws, max(1, ws // 6)) for who in "AB"}
    ws = scale(30, track.fps)
    rolls["chase_30"] = trailing("__chase", "mean", ws, max(1, ws // 6))
    for w in (60, 120):
        ws = scale(w, track.fps)
        rolls[f"sp_cor{w}"] = trailing("__Asp", "corr", ws, max(1, ws // 6), other="__Bsp")
    return track.roll(rolls)


def third_party(aligned: DataFrame, pose: DataFrame, close: float = 10.0) -> DataFrame:
    """Context of the other individuals, one row per pair and frame that has any.

    ``aligned`` has A_body_center and B_body_center; the others of a video
    join on the frame, and their number is bounded by those in an arena.
    """
    who = pose.select("video_id", "video_frame", F.col("mouse_id").alias("m"), F.col("body_center_x").alias("mx"), F.col("body_center_y").alias("my"))
    ax, ay, bx, by = (F.col(f"{w}_body_center_{a}") for w in "AB" for a in "xy")
    rows = aligned.join(who, ["video_id", "video_frame"]).filter("m <> agent_id AND m <> target_id")
    rows = rows.withColumns({
        "dat": norm(bx - ax, by - ay), "da": norm(F.col("mx") - ax, F.col("my") - ay), "db": norm(F.col("mx") - bx, F.col("my") - by),
        "dm": norm(F.col("mx") - (ax + bx) * 0.5, F.col("my") - (ay + by) * 0.5), "cos": cosine(bx - ax, by - ay, F.col("mx") - ax, F.col("my") - ay),
    })
    far = F.coalesce("da", F.lit(float("inf")))
    count = lambda cond: F.sum(indicator(cond).cast("long"))
    out = rows.groupBy(*KEYS, "video_frame").agg(
        F.first("dat").alias("dat"), F.min("da").alias("ctx_third_min_dist_agent"), F.avg("da").alias("ctx_third_mean_dist_agent"),
        count(F.col("da") < close).alias("ctx_third_close_agent_cnt"), F.min("db").alias("ctx_third_min_dist_target"),
        F.avg("db").alias("ctx_third_mean_dist_target"), count(F.col("db") < close).alias("ctx_third_close_target_cnt"),
        F.min("dm").alias("ctx_third_min_dist_mid"),
        count(F.coalesce(F.col("da") < close, F.lit(False)) | F.coalesce(F.col("db") < close, F.lit(False))).alias("ctx_third_close_any_cnt"),
        F.min(F.col("da") + F.col("db")).alias("sum"), F.min(F.struct(far.alias("d"), F.col("m"), F.col("cos").alias("c"))).alias("near"),
    )
    out = out.withColumns({
        "ctx_third_close_any": indicator(F.col("ctx_third_close_any_cnt") > 0), "ctx_third_between_ratio": over(F.col("sum"), F.col("dat")),
        "ctx_third_cos_agent_closest": F.col("near.c"),
        **{f"ctx_third_min_dist_{k}_ratio": over(F.col(f"ctx_third_min_dist_{k}"), F.col("dat")) for k in ("agent", "target", "mid")},
    })
    return out.drop("dat", "sum", "near")

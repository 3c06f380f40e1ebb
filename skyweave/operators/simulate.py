"""Simulated input and the tracks that truth allows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions import geometry as g
from skyweave.functions.geometry import wrap360

from .common import assign_ids, checkpoint
from .sets import remove_subsets

#: Radius of the camera's field in degrees (fixed value of the survey).
FIELD_RADIUS = 1.784


def noise_detections(images: DataFrame, per_image: int, start_id: int, seed: int = 0, radius: float = FIELD_RADIUS) -> DataFrame:
    """det_id, image_id, mjd, ra, dec, ssm_id = -1: points uniform in the disc about every image's centre (image_id, mjd,
    ra, dec, in degrees), drawn in the disc at once: the distance is the radius times the root of a uniform number."""
    rows = images.select("image_id", "mjd", F.col("ra").alias("ra_c"), F.col("dec").alias("dec_c"), F.explode(F.sequence(F.lit(1), F.lit(per_image))).alias("k"))
    r, a = radius * F.sqrt(F.rand(seed)), 2 * math.pi * F.rand(seed + 1)
    placed = rows.withColumn("r", r).withColumn("a", a)
    dec = F.col("dec_c") + F.col("r") * F.sin("a")
    ra = wrap360(F.col("ra_c") + F.col("r") * F.cos("a") / F.cos(F.radians("dec_c")))
    placed = placed.select("image_id", "k", "mjd", ra.alias("ra"), dec.alias("dec"), F.lit(-1).cast("long").alias("ssm_id"))
    return assign_ids(placed, ["image_id", "k"], "det_id", start_id).drop("k")


def with_noise_rows(dets: DataFrame, noise: DataFrame) -> DataFrame:
    """The true detections and the noise, in one table."""
    return dets.unionByName(noise, allowMissingColumns=True)


def random_subset(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement."""
    return rows.orderBy(F.rand(seed)).limit(k)


def generate_track(t: np.ndarray, p: tuple[float, float], v: tuple[float, float], a: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of constant acceleration from the first time on."""
    s = t - t[0]
    return p[0] + v[0] * s + a[0] * s * s / 2, p[1] + v[1] * s + a[1] * s * s / 2


def true_tracklets(dets: DataFrame, max_v: float = 0.5, max_dt: float = 0.0625, min_dt: float = 0.01) -> DataFrame:
    """ssm_id, start_det, det_ids (by time), t, ra_v, dec_v (between the first two detections) of the tracklets of every object.

    In order of time each detection that no tracklet has yet takes in the later ones of its object with min_dt <= dt <= max_dt
    and a velocity up to max_v, and once there are two all those within half a day. So what stands apart by more than that is
    independent: an object is cut into runs of occupied blocks of that length, and a run (a night; an image has an object
    once) is one array.
    """
    reach = max(max_dt, 0.5)
    rows = dets.where("ssm_id <> -1").select("ssm_id", "det_id", "mjd", "ra", "dec", F.floor(F.col("mjd") / reach).alias("block"))
    order = Window.partitionBy("ssm_id").orderBy("block")
    blocks = rows.select("ssm_id", "block").distinct().withColumn("run", F.col("block") - F.row_number().over(order))
    runs = rows.join(blocks, ["ssm_id", "block"]).groupBy("ssm_id", "run").agg(F.array_sort(F.collect_list(F.struct("mjd", "det_id", "ra", "dec"))).alias("rows"))
    runs = runs.withColumn("rows", F.transform("rows", lambda x, i: x.withField("k", i)))

    def taken(x: Column) -> Column:
        """The detections that x takes in."""
        dt = lambda y: y["mjd"] - x["mjd"]
        d_ra, d_dec = lambda y: g.signed_distance(y["ra"], x["ra"]), lambda y: y["dec"] - x["dec"]
        slow = lambda y: F.sqrt(d_ra(y) * d_ra(y) + d_dec(y) * d_dec(y)) / F.nullif(dt(y), F.lit(0.0)) <= max_v
        inside = lambda y: (dt(y) >= min_dt) & (dt(y) <= max_dt)
        near = F.filter("rows", lambda y: (y["k"] > x["k"]) & (dt(y) <= reach) & slow(y))
        found = F.struct(near.alias("near"), F.array_min(F.transform(F.filter(near, inside), lambda y: y["k"])).alias("second"))
        more = lambda n: F.filter(n["near"], lambda y: inside(y) | (y["k"] > n["second"]) & (dt(y) > 0) & (dt(y) <= 0.5))
        return F.transform(F.array(found), more)[0]

    def step(state: Column, x: Column) -> Column:
        added = lambda more: F.struct(F.array_union(state["seen"], F.transform(more, lambda y: y["k"])).alias("seen"), F.when(F.size(more) > 0, F.concat(state["lets"], F.array(F.concat(F.array(x), more)))).otherwise(state["lets"]).alias("lets"))
        return F.when(F.array_contains(state["seen"], x["k"]), state).otherwise(F.transform(F.array(taken(x)), added)[0])

    point = "struct<mjd:double,det_id:bigint,ra:double,dec:double,k:int>"
    start = F.struct(F.array().cast("array<int>").alias("seen"), F.array().cast(f"array<array<{point}>>").alias("lets"))
    lets = runs.select("ssm_id", F.explode(F.aggregate("rows", start, step).getField("lets")).alias("let"))
    a, b = F.col("let")[0], F.col("let")[1]
    dt = b["mjd"] - a["mjd"]
    return lets.select("ssm_id", a["det_id"].alias("start_det"), F.transform("let", lambda x: x["det_id"]).alias("det_ids"), a["mjd"].alias("t"), (g.signed_distance(b["ra"], a["ra"]) / dt).alias("ra_v"), ((b["dec"] - a["dec"]) / dt).alias("dec_v"))


def true_tracks(dets: DataFrame, max_v: float = 0.5, max_dt: float = 0.0625, min_dt: float = 0.01, acc: float = 0.02, window: int = 15, min_obs: int = 6, min_nights: int = 3, maximal: bool = False) -> DataFrame:
    """ssm_id, det_ids: for each start tracklet of an object the largest track that time and velocity allow: all later
    tracklets up to ``window`` nights on whose velocity differs by at most ``acc`` a day. ``maximal``: without the tracks that
    lie in another one of the object.

    Tracklets meet by object and block of window + 1 nights, the start one looking into its block and the next, so the work on
    an object spreads over its blocks and then over its start tracklets.
    """
    lets = checkpoint(true_tracklets(dets, max_v, max_dt, min_dt).withColumn("night", F.floor("t"))).withColumn("block", F.floor(F.col("night") / (window + 1)))
    first = lets.select("ssm_id", *[F.col(c).alias(f"a_{c}") for c in ("start_det", "t", "ra_v", "dec_v", "night")], F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    dt = F.col("t") - F.col("a_t")
    near = [F.abs(F.col(v) - F.col(f"a_{v}")) / F.nullif(dt, F.lit(0.0)) <= acc for v in ("ra_v", "dec_v")]
    fits = (dt > 0) & (F.col("night") - F.col("a_night") <= window) & near[0] & near[1]
    met = first.join(lets, ["ssm_id", "block"]).where((F.col("start_det") == F.col("a_start_det")) | fits)
    tracks = met.groupBy("ssm_id", "a_start_det").agg(F.sum(F.size("det_ids")).alias("n"), F.count_distinct("night").alias("nights"), F.flatten(F.collect_list("det_ids")).alias("det_ids"))
    tracks = tracks.where((F.col("n") >= min_obs) & (F.col("nights") >= min_nights)).select("ssm_id", F.array_sort(F.array_distinct("det_ids")).alias("det_ids")).distinct()
    if not maximal:
        return tracks
    # an object's tracks share no detection with another's
    return remove_subsets(checkpoint(tracks.withColumn("track_id", F.xxhash64("det_ids"))), "track_id").select("ssm_id", "det_ids")

"""Tracklets: pairing detections of one night, their lines, residuals and motion.

Detections: det_id, mjd, ra, dec, ssm_id, image_id, mag. Tracklets: tracklet_id, det_ids (sorted array); their
long form has one row for each detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.config import BadInput, TrackletConfig
from skyweave.functions import geometry as g

from .bucket import sky_key, sky_keys_near
from .common import sized

#: Pair ids are first * PAIR_BASE + second while both are below HALF: ordered, and the same on every run.
PAIR_BASE, HALF = 4294967296, 2147483648


def image_pairs(dets: DataFrame, min_dt: float, max_dt: float, seconds: DataFrame | None = None) -> DataFrame:
    """mjd_a, mjd_b, dt of images (detections of exactly equal time) that may hold a tracklet; equality on a time
    bucket as wide as max_dt, so no image meets all others. ``seconds``: the second images come from there."""
    images = dets.select("mjd").distinct()
    others = images if seconds is None else seconds.select("mjd").distinct()
    a = images.select(F.col("mjd").alias("mjd_a"), F.explode(F.expr(f"array(bigint(floor(mjd / {max_dt!r})), bigint(floor(mjd / {max_dt!r})) + 1)")).alias("__b"))
    b = others.select(F.col("mjd").alias("mjd_b"), F.expr(f"bigint(floor(mjd / {max_dt!r}))").alias("__b"))
    dt = F.col("mjd_b") - F.col("mjd_a")
    return a.join(b, "__b").where((F.col("mjd_b") > F.col("mjd_a")) & (dt >= min_dt) & (dt <= max_dt)).select("mjd_a", "mjd_b", dt.alias("dt"))


def find_tracklets(dets: DataFrame, config: TrackletConfig | None = None, seconds: DataFrame | None = None, **options) -> DataFrame:
    """det_a, det_b, dt, dist of all pairs with min_dt <= dt <= max_dt and min_v * dt <= dist < max_v * dt. ``seconds``:
    the second detections come from there."""
    c = config or TrackletConfig(**options)
    radius = max(c.max_v * c.max_dt, 1e-6)
    place = lambda df: df.select("det_id", "mjd", g.wrap360("ra").alias("ra"), "dec")
    pos, ends = place(dets), place(dets if seconds is None else seconds)
    pairs = sized(image_pairs(pos, c.min_dt, c.max_dt, None if seconds is None else ends))
    a = sky_key(pos.select(F.col("det_id").alias("det_a"), F.col("mjd").alias("mjd_a"), F.col("ra").alias("ra_a"), F.col("dec").alias("dec_a")), "ra_a", "dec_a", radius).join(pairs, "mjd_a")
    b = sky_keys_near(ends.select(F.col("det_id").alias("det_b"), F.col("mjd").alias("mjd_b"), F.col("ra").alias("ra_b"), F.col("dec").alias("dec_b")), "ra_b", "dec_b", radius)
    met = a.join(b, ["mjd_b", "__zone", "__cell"]).where(F.abs(F.col("dec_a") - F.col("dec_b")) <= c.max_v * F.col("dt"))
    met = met.withColumn("dist", g.haversine("ra_a", "dec_a", "ra_b", "dec_b"))
    return met.where((F.col("dist") >= c.min_v * F.col("dt")) & (F.col("dist") < c.max_v * F.col("dt"))).select("det_a", "det_b", "dt", "dist")


def as_tracklets(pairs: DataFrame) -> DataFrame:
    """tracklet_id, det_ids from pairs. A pair with a larger or negative id gets a negative hash of both (63 bits, which
    ``check_ids`` finds to be unique or not)."""
    low, high = F.least("det_a", "det_b"), F.greatest("det_a", "det_b")
    packed = F.when((low >= 0) & (high < HALF), F.when(high < HALF, low).otherwise(0) * PAIR_BASE + high)
    hashed = F.xxhash64(low, high).bitwiseOR(F.lit(-(1 << 63)))
    return pairs.select(F.coalesce(packed, hashed).alias("tracklet_id"), F.array(low, high).alias("det_ids"))


def check_ids(tracklets: DataFrame) -> DataFrame:
    """The tracklets, once it is known that no two different ones among those with hashed ids share an id."""
    hashed = tracklets.where("tracklet_id < 0").groupBy("tracklet_id").agg(F.count_distinct("det_ids").alias("n")).where("n > 1")
    if not hashed.isEmpty():
        raise BadInput("two pairs of detections have one id")
    return tracklets


def long_form(tracklets: DataFrame, id_col: str = "tracklet_id", ids: str = "det_ids") -> DataFrame:
    return tracklets.select(id_col, F.explode(ids).alias("det_id"))


def with_detections(tracklets: DataFrame, dets: DataFrame, *columns: str, id_col: str = "tracklet_id") -> DataFrame:
    """Long form with columns of the detections."""
    return long_form(tracklets, id_col).join(dets.select("det_id", *columns), "det_id")


def _unwrapped(long: DataFrame, id_col: str) -> DataFrame:
    """RA made continuous: above 180 turns negative where the tracklet spans more than half a turn."""
    w = Window.partitionBy(id_col)
    low, high = F.min("ra").over(w), F.max("ra").over(w)
    return long.withColumn("ra", g.negative_above_180("ra", low, high))


def line_fit(long: DataFrame, id_col: str = "tracklet_id", t0: float | Column | None = None) -> DataFrame:
    """id, t0, dt, n, ra0, dec0, ra_v, dec_v: least-squares lines of RA and Dec against time since t0 (the first
    detection unless given). Slopes are null for a single time; a tracklet that still spans over 180 degrees is null."""
    span = Window.partitionBy(id_col)
    start = F.min("mjd").over(span) if t0 is None else t0 if isinstance(t0, Column) else F.lit(t0)
    rows = _unwrapped(long, id_col).withColumn("__t0", start).withColumn("__t", F.col("mjd") - F.col("__t0"))
    fit = rows.groupBy(id_col).agg(
        F.first("__t0").alias("t0"), (F.max("mjd") - F.min("mjd")).alias("dt"), F.count("*").alias("n"),
        F.regr_intercept("ra", "__t").alias("ra0"), F.regr_intercept("dec", "__t").alias("dec0"),
        F.regr_slope("ra", "__t").alias("ra_v"), F.regr_slope("dec", "__t").alias("dec_v"), (F.max("ra") - F.min("ra")).alias("__span"),
    )
    bad = F.col("__span") > 180
    return fit.select(id_col, "t0", "dt", "n", *[F.when(~bad, F.col(c)).alias(c) for c in ("ra0", "dec0", "ra_v", "dec_v")])


def square_distances(long: DataFrame, id_col: str = "tracklet_id") -> DataFrame:
    """id, det_id, sq_dist: squared planar distance of every detection from its tracklet's line, shorter way round."""
    fit = line_fit(long, id_col)
    met = long.join(fit, id_col)
    t = F.col("mjd") - F.col("t0")
    d_ra = g.circular_distance("ra", F.col("ra0") + F.col("ra_v") * t)
    d_dec = g.circular_distance("dec", F.col("dec0") + F.col("dec_v") * t)
    return met.select(id_col, "det_id", (d_ra * d_ra + d_dec * d_dec).alias("sq_dist"))


def tracklet_rms(long: DataFrame, id_col: str = "tracklet_id") -> DataFrame:
    """id, rms: root of the summed squares over the number of detections (not the root of the mean)."""
    return square_distances(long, id_col).groupBy(id_col).agg((F.sqrt(F.sum("sq_dist")) / F.count("*")).alias("rms"))


def filter_by_line_fit(tracklets: DataFrame, dets: DataFrame, max_rms: float) -> DataFrame:
    good = tracklet_rms(with_detections(tracklets, dets, "mjd", "ra", "dec")).where(F.col("rms") <= max_rms)
    return tracklets.join(good.select("tracklet_id"), "tracklet_id", "left_semi")


def endpoints(long: DataFrame, id_col: str = "tracklet_id") -> DataFrame:
    """id, first_det, last_det, t_first, t_last, dt, start_image; the lower det_id wins ties."""
    rows = long.groupBy(id_col).agg(
        F.min(F.struct("mjd", "det_id", "image_id")).alias("a"), F.max(F.struct(F.col("mjd"), (-F.col("det_id")).alias("neg"))).alias("z"),
    )
    z = F.col("z")
    return rows.select(id_col, F.col("a.det_id").alias("first_det"), (-z.getField("neg")).alias("last_det"), F.col("a.mjd").alias("t_first"), z.getField("mjd").alias("t_last"), (z.getField("mjd") - F.col("a.mjd")).alias("dt"), F.col("a.image_id").alias("start_image"))


def motion_vector(long: DataFrame, id_col: str = "tracklet_id", midpoint: float | Column | None = None, use_atan2: bool = False) -> DataFrame:
    """id, ra_mid, dec_mid, angle, velocity at the middle of the time range of all detections (or another time, the same on
    all rows of a tracklet). The angle is the arc sine
    of the declination's share by default, which does not tell the sign of the RA motion; atan2 does."""
    if midpoint is None:
        low, high = long.agg(F.min("mjd"), F.max("mjd")).first()
        midpoint = ((low or 0.0) + (high or 0.0)) / 2
    fit = line_fit(long, id_col, midpoint)
    v = F.sqrt(F.col("ra_v") * F.col("ra_v") + F.col("dec_v") * F.col("dec_v"))
    angle = F.atan2("dec_v", "ra_v") if use_atan2 else F.asin(F.greatest(F.least(F.col("dec_v") / v, F.lit(1.0)), F.lit(-1.0)))
    return fit.select(id_col, g.wrap360("ra0").alias("ra_mid"), g.wrap360("dec0").alias("dec_mid"), F.when(v == 0, 0.0).otherwise(g.wrap360(F.degrees(angle))).alias("angle"), v.alias("velocity"))


def start_images(long: DataFrame, id_col: str = "tracklet_id") -> DataFrame:
    """id, start_image, t_start: the image of the earliest detection."""
    return long.groupBy(id_col).agg(F.min(F.struct("mjd", "image_id")).alias("a")).select(id_col, F.col("a.image_id").alias("start_image"), F.col("a.mjd").alias("t_start"))


def night_windows(starts: DataFrame, window: int = 15, night: str = "night") -> DataFrame:
    """One row for each tracklet and window that holds it: window_start .. window_start + window (both ends in)."""
    nights = starts.select(F.col(night).alias("window_start")).distinct()
    reach = starts.withColumn("window_start", F.explode(F.sequence(F.col(night) - window, F.col(night))))
    return reach.join(sized(nights), "window_start", "left_semi")


def image_windows(starts: DataFrame, images: DataFrame, window: int = 15, per_run: int = 30) -> DataFrame:
    """start_image, run, tracklet_id: runs of at most ``per_run`` start images of a night, each with the tracklets that
    begin later in the same night or in the following window - 1 nights. images: image_id, mjd, night."""
    w = Window.partitionBy("night").orderBy("mjd", "image_id")
    runs = images.withColumn("run", F.floor((F.row_number().over(w) - 1) / per_run)).select("image_id", "mjd", "night", "run")
    first = runs.groupBy("night", "run").agg(F.min("mjd").alias("t_from"))
    ahead = starts.withColumn("__n", F.explode(F.sequence(F.col("night") - (window - 1), F.col("night"))))
    return first.withColumnRenamed("night", "__n").join(ahead, "__n").where("t_start >= t_from").select(F.col("__n").alias("window_night"), "run", "tracklet_id")

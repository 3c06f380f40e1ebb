"""Grading against known truth, coverage, quality, counts of images and revisits. All of it is DataFrame expressions.

Truth: ssm_id of a detection, -1 (or null) for noise. Sets: id, det_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions.nights import night_int


def truth(sets: DataFrame, dets: DataFrame, id_col: str = "track_id") -> DataFrame:
    """id, n_dets, object_id (the object of all detections, else -1), is_true, start_image, last_image, t_start, t_last,
    n_nights (by whole days)."""
    long = sets.select(id_col, F.explode("det_ids").alias("det_id")).join(dets.select("det_id", "mjd", "image_id", F.coalesce("ssm_id", F.lit(-1)).alias("ssm_id")), "det_id")
    agg = long.groupBy(id_col).agg(
        F.count("*").alias("n_dets"), F.when(F.count_distinct("ssm_id") == 1, F.max("ssm_id")).otherwise(-1).alias("object_id"),
        F.min(F.struct("mjd", "image_id")).alias("a"), F.max(F.struct("mjd", "image_id")).alias("z"), F.count_distinct(night_int("mjd")).alias("n_nights"),
    )
    return agg.select(id_col, "n_dets", "object_id", (F.col("object_id") != -1).alias("is_true"), F.col("a.image_id").alias("start_image"), F.col("z.image_id").alias("last_image"), F.col("a.mjd").alias("t_start"), F.col("z.mjd").alias("t_last"), "n_nights")


def _counts() -> list:
    true = F.col("is_true").cast("long")
    return [F.count("*").alias("n_total"), F.coalesce(F.sum(true), F.lit(0)).alias("n_true"), F.coalesce(F.sum(1 - true), F.lit(0)).alias("n_false")]


def totals(graded: DataFrame) -> DataFrame:
    """One row: n_total, n_true, n_false, pct_true."""
    return graded.agg(*_counts()).withColumn("pct_true", F.when(F.col("n_total") > 0, 100.0 * F.col("n_true") / F.col("n_total")))


def by_start_image(graded: DataFrame) -> DataFrame:
    return graded.groupBy("start_image").agg(*_counts())


def by_cardinality(graded: DataFrame) -> DataFrame:
    """Counts by number of detections and by number of nights, as grouping sets: the other column is null."""
    view = graded.groupingSets([["n_dets"], ["n_nights"]], "n_dets", "n_nights")
    return view.agg(*_counts())


def by_endpoint_images(sets: DataFrame, dets: DataFrame, id_col: str = "track_id") -> DataFrame:
    """Counts by the images of the first and the last but one detection."""
    long = sets.select(id_col, F.explode("det_ids").alias("det_id")).join(dets.select("det_id", "mjd", "image_id"), "det_id")
    ordered = long.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("mjd", "det_id", "image_id"))), lambda x: x.image_id).alias("images")).where("size(images) >= 2")
    pairs = ordered.select(id_col, F.element_at("images", 1).alias("first_image"), F.element_at("images", -2).alias("second_image"))
    return pairs.join(truth(sets, dets, id_col).select(id_col, "is_true"), id_col).groupBy("first_image", "second_image").agg(*_counts())


def found_objects(graded: DataFrame) -> DataFrame:
    return graded.where("is_true").select(F.col("object_id").alias("ssm_id")).distinct()


def true_sets(sets: DataFrame, graded: DataFrame, id_col: str = "track_id") -> DataFrame:
    return sets.join(graded.where("is_true").select(id_col), id_col, "left_semi")


def object_coverage(sets: DataFrame, dets: DataFrame, id_col: str = "tracklet_id") -> DataFrame:
    """ssm_id, n_covered, n_dets, coverage: distinct detections in correct sets over all of the object, for objects that
    have a correct set."""
    graded = truth(sets, dets, id_col).where("is_true")
    covered = sets.join(graded.select(id_col, "object_id"), id_col).select(F.col("object_id").alias("ssm_id"), F.explode("det_ids").alias("det_id")).distinct().groupBy("ssm_id").agg(F.count("*").alias("n_covered"))
    every = dets.where("ssm_id <> -1").groupBy("ssm_id").agg(F.count("*").alias("n_dets"))
    return covered.join(every, "ssm_id").withColumn("coverage", F.col("n_covered") / F.col("n_dets"))


def net_coverage(parts: DataFrame) -> DataFrame:
    """Mean coverage over files or nights, weighted by their objects (coverage, n_objects)."""
    return parts.agg((F.sum(F.col("coverage") * F.col("n_objects")) / F.sum("n_objects")).alias("net_coverage"), F.sum("n_objects").alias("n_objects"))


def tracklet_quality(sets: DataFrame, dets: DataFrame, id_col: str = "tracklet_id") -> DataFrame:
    """id, object_id, n_apparitions, quality: length over the object's detections if correct, else 0."""
    graded = truth(sets, dets, id_col)
    every = dets.where("ssm_id <> -1").groupBy(F.col("ssm_id").alias("object_id")).agg(F.count("*").alias("n_apparitions"))
    met = graded.join(every, "object_id", "left")
    return met.select(id_col, "object_id", F.coalesce("n_apparitions", F.lit(0)).alias("n_apparitions"), F.when(F.col("is_true"), F.col("n_dets") / F.col("n_apparitions")).otherwise(0.0).alias("quality"))


def field_crossers(sets: DataFrame, dets: DataFrame, fields_of_images: DataFrame, id_col: str = "track_id") -> DataFrame:
    """n_within, n_crossing: sets in one field and in several. fields_of_images: image_id, field_id."""
    long = sets.select(id_col, F.explode("det_ids").alias("det_id")).join(dets.select("det_id", "image_id"), "det_id").join(fields_of_images, "image_id")
    per = long.groupBy(id_col).agg(F.count_distinct("field_id").alias("n"))
    return per.agg(F.count_if(F.col("n") == 1).alias("n_within"), F.count_if(F.col("n") > 1).alias("n_crossing"))


def second_endpoint_images(endpoints: DataFrame, dets: DataFrame) -> DataFrame:
    """first_det, n_images: distinct images of the last detections of the tracklets that begin with it."""
    last = endpoints.join(dets.select(F.col("det_id").alias("last_det"), F.col("image_id").alias("last_image")), "last_det")
    return last.groupBy("first_det").agg(F.count_distinct("last_image").alias("n_images"))


def position_stats(sets: DataFrame, dets: DataFrame, id_col: str = "track_id") -> DataFrame:
    """id, ra0, dec0, d_ra, d_dec, first_pure, last_pure (whether the first and last two detections are one object)."""
    long = sets.select(id_col, F.explode("det_ids").alias("det_id")).join(dets.select("det_id", "mjd", "ra", "dec", "ssm_id"), "det_id")
    rows = long.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("mjd", "det_id", "ra", "dec", "ssm_id"))).alias("r"), F.min("dec").alias("lo"), F.max("dec").alias("hi"))
    arc = "aggregate(r, 0e0, (m, x) -> greatest(m, pmod(x.ra - r[0].ra + 180e0, 360e0) - 180e0)) - aggregate(r, 0e0, (m, x) -> least(m, pmod(x.ra - r[0].ra + 180e0, 360e0) - 180e0))"
    pure = lambda i, j: f"coalesce(element_at(r, {i}).ssm_id = element_at(r, {j}).ssm_id and element_at(r, {i}).ssm_id <> -1, false)"
    return rows.where("size(r) >= 2").select(id_col, F.expr("r[0].ra").alias("ra0"), F.expr("r[0].dec").alias("dec0"), F.expr(arc).alias("d_ra"), (F.col("hi") - F.col("lo")).alias("d_dec"), F.expr(pure(1, 2)).alias("first_pure"), F.expr(pure(-1, -2)).alias("last_pure"))


def linkable_objects(sets: DataFrame, dets: DataFrame, min_endpoint: float = 1.0, min_support: float = 0.5, min_detections: int = 6, min_support_tracklets: int = 1, id_col: str = "tracklet_id") -> DataFrame:
    """ssm_id, n_times, n_tracklets of objects whose correct tracklets could make a track: endpoints more than
    min_endpoint apart, more than min_detections times, and more than min_support_tracklets between the endpoints."""
    good = truth(sets, dets, id_col).where("is_true").select(id_col, F.col("object_id").alias("ssm_id"), "t_start")
    w = Window.partitionBy("ssm_id")
    good = good.withColumn("t0", F.min("t_start").over(w)).withColumn("t1", F.max("t_start").over(w)).where(F.col("t1") - F.col("t0") > min_endpoint)
    end = (F.col("t_start") == F.col("t0")) | (F.col("t_start") == F.col("t1"))
    between = (F.col("t_start") - F.col("t0") > min_support) & (F.col("t1") - F.col("t_start") > min_support)
    usable = good.where(end | between).join(sets.select(id_col, F.explode("det_ids").alias("det_id")), id_col).join(dets.select("det_id", "mjd"), "det_id")
    counted = usable.groupBy("ssm_id").agg(F.count_distinct("mjd").alias("n_times"), F.count_distinct(id_col).alias("n_tracklets"))
    return counted.where((F.col("n_times") > min_detections) & (F.col("n_tracklets") - 2 > min_support_tracklets))


def best_tracklets(sets: DataFrame, dets: DataFrame, id_col: str = "tracklet_id") -> DataFrame:
    """Of every object the correct set of the longest time (lowest id among equals); incorrect ones pass through."""
    graded = truth(sets, dets, id_col)
    w = Window.partitionBy("object_id").orderBy(F.desc(F.col("t_last") - F.col("t_start")), id_col)
    best = graded.where("is_true").withColumn("k", F.row_number().over(w)).where("k = 1").select(id_col)
    return sets.join(best.unionByName(graded.where("not is_true").select(id_col)), id_col, "left_semi")


def first_true_rank(tracks: DataFrame, graded: DataFrame, id_col: str = "track_id", rms: str = "rms") -> DataFrame:
    """det_id, first_true (1-based place of the first true track by residual, null if none), n_tracks."""
    long = tracks.select(id_col, rms, F.explode("det_ids").alias("det_id")).join(graded.select(id_col, "is_true"), id_col)
    ranked = long.withColumn("place", F.row_number().over(Window.partitionBy("det_id").orderBy(rms, id_col)))
    return ranked.groupBy("det_id").agg(F.min(F.when(F.col("is_true"), F.col("place"))).alias("first_true"), F.count("*").alias("n_tracks"))


def unattributed(tracks: DataFrame, graded: DataFrame, dets: DataFrame, id_col: str = "track_id") -> DataFrame:
    """Detections in no true track."""
    attributed = true_sets(tracks, graded, id_col).select(F.explode("det_ids").alias("det_id")).distinct()
    return dets.join(attributed, "det_id", "left_anti")


def error_effect(before: DataFrame, after: DataFrame, endpoints: DataFrame) -> DataFrame:
    """tracklet_id, d_first, d_last (shift of the endpoints, degrees) and d_v (change of speed) between two versions of
    the positions."""
    from skyweave.functions.geometry import haversine

    both = before.select("det_id", "mjd", F.col("ra").alias("ra0"), F.col("dec").alias("dec0")).join(after.select("det_id", F.col("ra").alias("ra1"), F.col("dec").alias("dec1")), "det_id")
    side = lambda s: both.select(F.col("det_id").alias(f"{s}_det"), *[F.col(c).alias(f"{s}_{c}") for c in ("mjd", "ra0", "dec0", "ra1", "dec1")])
    met = endpoints.select("tracklet_id", "first_det", "last_det").join(side("first"), "first_det").join(side("last"), "last_det")
    speed = lambda k: haversine(f"first_ra{k}", f"first_dec{k}", f"last_ra{k}", f"last_dec{k}") / F.nullif(F.col("last_mjd") - F.col("first_mjd"), F.lit(0.0))
    shift = lambda s: haversine(f"{s}_ra0", f"{s}_dec0", f"{s}_ra1", f"{s}_dec1")
    return met.select("tracklet_id", shift("first").alias("d_first"), shift("last").alias("d_last"), (speed(1) - speed(0)).alias("d_v"))


def orbit_deltas(orbits: DataFrame, truth_orbits: DataFrame, elements: list[str]) -> DataFrame:
    """ssm_id and the difference of every element from the truth."""
    t = truth_orbits.select("ssm_id", *[F.col(e).alias(f"__{e}") for e in elements])
    return orbits.join(t, "ssm_id").select("ssm_id", *[(F.col(e) - F.col(f"__{e}")).alias(f"d_{e}") for e in elements])


# ------------------------------------------------------------------ images and fields


def image_counts(dets: DataFrame, t_from: float | None = None, t_to: float | None = None) -> DataFrame:
    """One row: n_images, n_dets in the time range (both ends in)."""
    rows = dets if t_from is None else dets.where((F.col("mjd") >= t_from) & (F.col("mjd") <= t_to))
    return rows.agg(F.count_distinct("mjd").alias("n_images"), F.count("*").alias("n_dets"))


def counts_between(dets: DataFrame, ranges: DataFrame) -> DataFrame:
    """range_id, n_images, n_dets for each (range_id, t_from, t_to); keyed by day, so ranges do not meet all rows."""
    images = dets.groupBy("mjd").agg(F.count("*").alias("n")).withColumn("__d", F.floor("mjd"))
    days = ranges.withColumn("__d", F.explode(F.sequence(F.floor("t_from"), F.floor("t_to"))))
    met = days.join(images, "__d").where((F.col("mjd") >= F.col("t_from")) & (F.col("mjd") <= F.col("t_to")))
    counted = met.groupBy("range_id").agg(F.count_distinct("mjd").alias("n_images"), F.sum("n").alias("n_dets"))
    return ranges.select("range_id").join(counted, "range_id", "left").select("range_id", F.coalesce("n_images", F.lit(0)).alias("n_images"), F.coalesce("n_dets", F.lit(0)).alias("n_dets"))


def dets_per_image(dets: DataFrame) -> DataFrame:
    return dets.groupBy("image_id").agg(F.count("*").alias("n_dets"))


def images_with_detections(images: DataFrame, dets: DataFrame, slack: float) -> DataFrame:
    """image_id, det_id: detections of an image whose time is within it, give or take ``slack``. images: image_id,
    t_open, t_close."""
    return images.join(dets.select("image_id", "det_id", "mjd"), "image_id").where((F.col("mjd") >= F.col("t_open") - slack) & (F.col("mjd") <= F.col("t_close") + slack)).select("image_id", "det_id")


def field_revisits(pointings: DataFrame, window: float = 15.0) -> DataFrame:
    """field_id, mjd, n_revisits (distinct later times within the window), last_revisit (the latest of them)."""
    times = pointings.select("field_id", "mjd").distinct()
    over = f"over (partition by field_id order by mjd range between current row and {window!r}D following)"
    return times.select("field_id", "mjd", F.expr(f"count(*) {over} - 1").alias("n_revisits"), F.expr(f"nullif(max(mjd) {over}, mjd)").alias("last_revisit"))


def revisit_pairs_by_night(pointings: DataFrame, low: float = 30 / 1440, high: float = 90 / 1440) -> DataFrame:
    """night, n_pairs: pairs of visits of one field between 30 and 90 minutes apart."""
    times = pointings.select("field_id", "mjd").distinct().withColumn("night", night_int("mjd"))
    later = times.select("field_id", F.col("mjd").alias("mjd_b"), F.explode(F.array("night", F.col("night") - 1)).alias("night"))
    dt = F.col("mjd_b") - F.col("mjd")
    return times.join(later, ["field_id", "night"]).where((dt >= low) & (dt <= high)).groupBy("night").agg(F.count("*").alias("n_pairs"))


# ------------------------------------------------------------------ run logs


def runtimes_by_start_image(lines: DataFrame, order: str = "line_no", text: str = "line") -> DataFrame:
    """start_image, seconds from log lines: a line that names the start image, then lines with a run time."""
    w = Window.partitionBy("log").orderBy(order)
    image = F.when(F.col(text).rlike(r"image[ =:]+\d+"), F.regexp_extract(text, r"image[ =:]+(\d+)", 1).cast("long"))
    seconds = F.when(F.col(text).rlike(r"[Tt]ook [0-9.]+"), F.regexp_extract(text, r"[Tt]ook ([0-9.]+)", 1).cast("double"))
    rows = lines.withColumn("start_image", F.last(image, ignorenulls=True).over(w)).withColumn("s", seconds)
    return rows.where("s is not null and start_image is not null").groupBy("start_image").agg(F.sum("s").alias("seconds"))


def elapsed_seconds(text):
    """Seconds of ``[h:]m:s`` as time tools print them."""
    from skyweave.functions.geometry import col

    return F.aggregate(F.split(col(text), ":"), F.lit(0.0), lambda s, x: s * 60 + x.cast("double"))

"""Exchange with orbit determination, and ingest of catalogues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.config import BadInput
from skyweave.functions.geometry import col
from skyweave.functions.nights import tai_to_utc
from skyweave.functions.photometry import astrometric_error, snr
from skyweave.operators.common import assign_ids, checkpoint

#: Limits of one set of files, and of the detections of one track (fixed values of the orbit program).
MAX_DETECTIONS, MAX_TRACKS, MAX_PER_TRACK = 50_000, 24_000, 18
TRACKLET_HEADER = "!!OID TIME OBS_TYPE RA DEC APPMAG FILTER OBSERVATORY RMS_RA RMS_DEC RMS_MAG S2N Secret_name"
REQUEST_HEADER = "!!ID_OID NID TRACKLET_OIDs OP_CODE N_OBS N_SOLUTIONS N_NIGHTS ARC_TYPE NO_RADAR PARAM(4)"


def subsampled(ids: str = "det_ids") -> Column:
    """At most 18 ids: the first 8, 2 from the middle and the last 8 of a longer list."""
    half = F.floor(F.size(ids) / 2).cast("int") + 1
    return F.when(F.size(ids) > MAX_PER_TRACK, F.concat(F.slice(ids, 1, 8), F.slice(ids, half, F.lit(2)), F.slice(ids, -8, 8))).otherwise(F.col(ids))


def file_sets(tracks: DataFrame, id_col: str = "track_id", max_detections: int = MAX_DETECTIONS, max_tracks: int = MAX_TRACKS) -> DataFrame:
    """track_no, file_set, det_ids: tracks numbered in the order of their ids and dealt into sets of files. A set is closed
    before a track that would take its distinct detections over the limit, and after ``max_tracks`` tracks; a track of
    more detections than the limit is an error. Blocks of ``max_tracks`` tracks are dealt apart, each in one task."""
    numbered = assign_ids(tracks, [id_col], "track_no").withColumn("__block", F.floor(F.col("track_no") / max_tracks))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        held: set[int] = set()
        parts, part = [], 0
        pdf = pdf.sort_values("track_no")
        for ids in pdf["det_ids"]:
            mine = set(ids)
            if len(mine) > max_detections:
                raise BadInput(f"a track has {len(mine)} detections, more than a file may hold")
            if len(held | mine) > max_detections:
                held, part = set(), part + 1
            held |= mine
            parts.append(part)
        return pdf.assign(__part=parts)[["track_no", "det_ids", "__block", "__part"]]

    dealt = checkpoint(numbered.select("track_no", "det_ids", "__block").groupBy("__block").applyInPandas(deal, "track_no long, det_ids array<long>, __block long, __part long"))
    order = dealt.select("__block", "__part").distinct()
    return dealt.join(assign_ids(order, ["__block", "__part"], "file_set"), ["__block", "__part"]).select("track_no", "file_set", "det_ids")


def request_lines(sets: DataFrame) -> DataFrame:
    """file_set, track_no, value: the request file."""
    ids = subsampled()
    text = F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")
    return sets.select("file_set", "track_no", F.concat(F.col("track_no").cast("string"), F.lit(" "), F.size(ids).cast("string"), F.lit(" "), text, F.lit(" REQUEST_PRELIM "), F.size(ids).cast("string"), F.lit(" 0 0 0 0 0.0 0.0 0.0 0.0")).alias("value"))


def tracklet_lines(sets: DataFrame, dets: DataFrame, images: DataFrame) -> DataFrame:
    """file_set, det_id, value: the detections that a set of files needs, with UTC and astrometric error.
    images: image_id, m5, seeing."""
    needed = sets.select("file_set", F.explode("det_ids").alias("det_id")).distinct().join(dets, "det_id").join(images, "image_id")
    err = astrometric_error("mag", "m5", "seeing")
    line = F.format_string("%d %.10f O %.12f %.12f %.12f r 807 %.12f %.12f 1.0 %.12f %d", "det_id", tai_to_utc("mjd"), "ra", "dec", "mag", err, err, "snr", F.coalesce("ssm_id", F.lit(-1)))
    return needed.select("file_set", "det_id", line.alias("value"))


def write_orbit_input(tracks: DataFrame, dets: DataFrame, images: DataFrame, path: str) -> None:
    """Folders request/ and tracklet/ with one sub-folder for each set of files; headers in header.txt."""
    sets = file_sets(tracks)
    spark = tracks.sparkSession
    request_lines(sets).select("file_set", "value").write.partitionBy("file_set").text(f"{path}/request")
    tracklet_lines(sets, dets, images).select("file_set", "value").write.partitionBy("file_set").text(f"{path}/tracklet")
    spark.createDataFrame([(REQUEST_HEADER,), (TRACKLET_HEADER,)], "value string").coalesce(1).write.text(f"{path}/header")


def ingest_orbits(tracks: DataFrame, graded: DataFrame, results: DataFrame) -> DataFrame:
    """track_id, status (OK or IOD_FAILED), ssm_id (-1 if mixed), t0, dt and the columns of ``results`` (track_id, ...)."""
    truth = graded.select("track_id", F.col("object_id").alias("ssm_id"), F.col("t_start").alias("t0"), (F.col("t_last") - F.col("t_start")).alias("dt"))
    found = results.withColumn("__hit", F.lit(True))
    met = tracks.select("track_id").join(truth, "track_id").join(found, "track_id", "left")
    return met.withColumn("status", F.when(F.col("__hit"), "OK").otherwise("IOD_FAILED")).drop("__hit")


def ingest_catalogue(rows: DataFrame, images: DataFrame, start_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(detections, rejects): rows (object, mjd, ra, dec, mag, image_id) not fainter than their image's limit get
    sequential ids and a signal to noise. images: image_id, m5."""
    met = rows.join(images.select("image_id", "m5"), "image_id").withColumn("snr", snr("mag", "m5"))
    good = met.where(F.col("mag") <= F.col("m5"))
    return assign_ids(good, ["image_id", "mjd", "object"], "det_id", start_id), met.where(F.col("mag") > F.col("m5"))


def magnitude_limited(mag: str, m5: str) -> Column:
    return col(mag) <= col(m5)

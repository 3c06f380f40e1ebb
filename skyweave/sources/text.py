"""Readers and writers of the workflow's text files. Lines are parsed by expressions, in parallel; a malformed line is
an error of the job (or dropped with mode="drop")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.config import BadParameter
from skyweave.functions.nights import calendar
from skyweave.operators.common import assign_ids, dense_ids, every_nth

DETECTION = "det_id long, image_id long, ssm_id long, ra double, dec double, mjd double, mag double, snr double"
MITI = "det_id long, mjd double, ra double, dec double, mag double, obscode string, obj_name string, length double, angle double, etime double"
ORBIT = "perihelion double, eccentricity double, inclination double, arg_perihelion double, longitude double, t_perihelion double, equinox double, orbit_id double"
FIELD = "field_id long, mjd double, ra double, dec double, radius double"
EPHEMERIS = "track_id long, mjd double, ra double, dec double"


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split()) for c in schema.split(",")]


def parse_lines(lines: DataFrame, schema: str, optional: int = 0, mode: str = "fail", text: str = "value") -> DataFrame:
    """Columns of whitespace-separated lines; the last ``optional`` may be missing. Blank lines are skipped."""
    if mode not in ("fail", "drop"):
        raise BadParameter("mode is fail or drop")
    names = _columns(schema)
    rows = lines.where(F.trim(text) != "").select(text, F.split(F.trim(F.col(text)), r"\s+").alias("__p"))
    value = [F.try_element_at("__p", F.lit(i + 1)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)]
    rows = rows.select(text, "__p", *value)
    needed = len(names) - optional
    bad = (F.size("__p") < needed) | (F.size("__p") > len(names))
    for i, (name, _) in enumerate(names):
        bad = bad | (F.col(name).isNull() & (F.size("__p") > i))
    if mode == "drop":
        return rows.where(~bad).select(*[n for n, _ in names])
    checked = F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), text)).cast("boolean")).otherwise(F.lit(True))
    return rows.where(checked).select(*[n for n, _ in names])


def read_detections(spark: SparkSession, path: str, error: float | None = None, mode: str = "fail") -> DataFrame:
    """Eight columns; ``error``: astrometric error given to both axes of all rows."""
    out = parse_lines(spark.read.text(path), DETECTION, mode=mode)
    return out if error is None else out.withColumn("ra_err", F.lit(float(error))).withColumn("dec_err", F.lit(float(error)))


def read_miti(spark: SparkSession, path: str, mode: str = "fail") -> DataFrame:
    """Nine or ten columns; the object name NS is noise."""
    return parse_lines(spark.read.text(path), MITI, optional=1, mode=mode)


def read_orbits(spark: SparkSession, path: str) -> DataFrame:
    """Seven or eight columns; a missing id is the number of the line. Blank lines are no orbits."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("__n", F.monotonically_increasing_id())
    numbered = assign_ids(lines, ["__n"], "__line")
    parsed = parse_lines(numbered.select(F.concat_ws(" ", "__line", "value").alias("value")), "line double, " + ORBIT, optional=1)
    return parsed.withColumn("orbit_id", F.coalesce("orbit_id", "line").cast("long")).drop("line")


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path), FIELD)


def read_ephemerides(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path), EPHEMERIS)


def parse_id_lists(lines: DataFrame, min_ids: int = 2, text: str = "value") -> DataFrame:
    """det_ids of lines of whole numbers; a line with fewer than min_ids distinct ones or with anything else is an error."""
    rows = lines.where(F.trim(text) != "").select(text, F.expr(f"transform(split(trim({text}), '[ \\\\t]+'), x -> try_cast(x as bigint))").alias("__i"))
    bad = F.exists("__i", lambda x: x.isNull()) | (F.size(F.array_distinct("__i")) < min_ids)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), text)).cast("boolean")).otherwise(F.lit(True))
    return rows.where(checked).select(F.array_sort(F.array_distinct("__i")).alias("det_ids"))


def read_tracklets(spark: SparkSession, path: str, min_ids: int = 2, id_col: str = "tracklet_id") -> DataFrame:
    return assign_ids(parse_id_lists(spark.read.text(path), min_ids), ["det_ids"], id_col)


def read_tracks(spark: SparkSession, path: str, dets: DataFrame | None = None) -> DataFrame:
    """track_id, det_ids; with ``dets`` every id must be in the catalogue."""
    from skyweave.config import BadInput
    from skyweave.operators.sets import unknown_detections

    tracks = read_tracklets(spark, path, 1, "track_id")
    if dets is not None and not unknown_detections(tracks, dets).isEmpty():
        raise BadInput("a track names a detection that the catalogue does not have")
    return tracks


def id_list(ids: str = "det_ids") -> Column:
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), " ")


def write_id_lists(sets: DataFrame, path: str, ids: str = "det_ids") -> None:
    """One line of sorted ids for each set."""
    sets.select(id_list(ids).alias("value")).write.text(path)


def detection_line() -> Column:
    return F.concat_ws(" ", *[F.col(n).cast("string") for n, _ in _columns(DETECTION)])


def write_detections(dets: DataFrame, path: str) -> None:
    dets.select(detection_line().alias("value")).write.text(path)


def read_datafile(spark: SparkSession, path: str, schema: str, sample: int = 1, start_column: int = 0) -> DataFrame:
    """Columns after ``start_column``; lines that begin with # or ! are comments; every ``sample``-th row."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*[#!]") & (F.trim("value") != ""))
    if sample > 1:
        lines = every_nth(lines.withColumn("__n", F.monotonically_increasing_id()), ["__n"], sample).drop("__n")
    cut = F.array_join(F.slice(F.split(F.trim("value"), r"\s+"), F.lit(start_column + 1), F.lit(len(_columns(schema)))), " ")
    return parse_lines(lines.select(cut.alias("value")), schema)


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """file_no, line_no, value of a folder of text files, which are in the order of the last number in their names."""
    lines = spark.read.text(path).select("value", F.regexp_extract("_metadata.file_name", r"([0-9]+)[^0-9]*$", 1).cast("long").alias("file_no"), F.monotonically_increasing_id().alias("__n"))
    return assign_ids(lines, ["file_no", "__n"], "line_no").select("file_no", "line_no", "value")


def write_datafile(df: DataFrame, path: str) -> None:
    """Header and blank-separated columns."""
    df.write.option("header", True).option("sep", " ").csv(path)


def write_by_night(dets: DataFrame, path: str, per_image: bool = False, midnight: float = 0.166) -> None:
    """One folder a night (and image): partition pruning takes the place of one file a night."""
    from skyweave.functions.nights import night_local

    dets.withColumn("night", night_local("mjd", midnight)).write.partitionBy("night", *(["image_id"] if per_image else [])).parquet(path)


def swap_names(rows: DataFrame, key: str, order: list[str], name: str = "ssm_id") -> tuple[DataFrame, DataFrame]:
    """(rows with a dense number for each value of ``key`` by first appearance, the mapping)."""
    mapping = dense_ids(rows, key, order, name)
    return rows.join(mapping, key).drop(key), mapping


def track_rows(tracks: DataFrame, dets: DataFrame, id_col: str = "track_id") -> DataFrame:
    """One row for each detection of a track, under a sequential number of the track."""
    numbered = assign_ids(tracks, [id_col], "track_no")
    return numbered.select("track_no", F.posexplode("det_ids").alias("pos", "det_id")).join(dets, "det_id")


def tracklets_to_miti(tracklets: DataFrame, dets: DataFrame, obscode: str = "807") -> Column | DataFrame:
    """MITI lines of the detections, keyed by their tracklet."""
    rows = tracklets.select("tracklet_id", F.explode("det_ids").alias("det_id")).join(dets, "det_id")
    name = F.when(F.coalesce("ssm_id", F.lit(-1)) == -1, "NS").otherwise(F.col("ssm_id").cast("string"))
    return rows.select("tracklet_id", "det_id", F.format_string("%d %.6f %.6f %.6f %.2f %s %s 0.0 0.0", "tracklet_id", "mjd", "ra", "dec", "mag", F.lit(obscode), name).alias("value"))


def _sexagesimal(value: Column, decimals: int) -> Column:
    """``DD MM SS.s`` of a value that is not negative, carried over when seconds round to 60."""
    scale = 10**decimals
    total = F.round(value * 3600 * scale).cast("long")
    whole = F.floor(total / (3600 * scale)).cast("long")
    rest = total - whole * 3600 * scale
    minutes = F.floor(rest / (60 * scale)).cast("long")
    seconds = (rest - minutes * 60 * scale) / scale
    return F.concat_ws(" ", F.format_string("%02d", whole), F.format_string("%02d", minutes), F.format_string(f"%0{3 + decimals}.{decimals}f", seconds))


def mpc_line(name: str, mjd: str, ra: str, dec: str, mag: str, obscode: str = "807", band: str = "r") -> Column:
    """80-column line of the Minor Planet Center: name, date, RA in hours, declination, magnitude, observatory."""
    sign = F.when(F.col(dec) < 0, "-").otherwise("+")
    return F.concat(
        F.format_string("     %-7s  C", F.substring(F.col(name).cast("string"), 1, 7)), calendar(mjd), F.lit(" "), _sexagesimal(F.pmod(F.col(ra), F.lit(360.0)) / 15.0, 2), F.lit(" "),
        sign, _sexagesimal(F.abs(F.col(dec)), 1), F.lit("          "), F.format_string("%4.1f", F.col(mag)), F.lit(f" {band}      {obscode}"),
    )

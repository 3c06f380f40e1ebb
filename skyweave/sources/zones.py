"""Detections stored by night and place of the sky, so that pairing and lookup read them without a shuffle.

The sky is cut into regions and time into slots; a *place* is a region in a slot. A detection is stored at home, and once
more in each other place that it can have a partner in: those within ``radius`` degrees and ``dt`` days. So all partners
of a detection stand in its home place, and the table, bucketed by place, is joined with itself bucket by bucket. Regions
are a good deal larger than the radius, so the copies are few; a field that is visited much more often than others is spread
over tasks by a shorter slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.config import BadInput, BadParameter, TrackletConfig
from skyweave.functions import geometry as g
from skyweave.operators.bucket import cells_of_zone, sky_key, sky_keys_near
from skyweave.operators.common import sized
from skyweave.operators.tracklets import image_pairs

_PROPERTY = "skyweave.layout."


@dataclass(frozen=True)
class Layout:
    radius: float = 0.125  # degrees
    dt: float = 0.0625  # days
    height: float = 5.0  # of a band of declination, and the least width of a region
    slot: float = 1.0  # days
    buckets: int = 64

    def __post_init__(self) -> None:
        if not 0 < self.radius <= self.height / 2 or self.height > 45 or not 0 <= self.dt <= self.slot or self.slot <= 0 or self.buckets < 1:
            raise BadParameter("0 < radius <= height / 2, height <= 45, 0 <= dt <= slot and a bucket are needed")


def _place(slot: Column, zone: Column, cell: Column) -> Column:
    return F.concat_ws(":", slot.cast("long"), zone.cast("long"), cell.cast("long"))


def home_place(mjd: str, ra: str, dec: str, layout: Layout) -> Column:
    zone = F.floor(F.col(dec) / layout.height)
    n = cells_of_zone(zone, layout.height)
    return _place(F.floor(F.col(mjd) / layout.slot), zone, F.least(F.floor(g.wrap360(ra) / 360.0 * n), n - 1))


def places_near(mjd: str, ra: str, dec: str, layout: Layout) -> Column:
    """The places within the radius and dt of a detection, its own among them.

    A circle of radius r about a declination d is asin(sin r / cos d) wide on either side. Where that is not defined (it holds
    a pole) every band that it reaches is one region, as the radius is at most half a height.
    """
    c = layout
    half = F.degrees(F.asin(F.least(F.sin(F.radians(F.lit(c.radius))) / F.greatest(F.cos(F.radians(dec)), F.lit(1e-12)), F.lit(1.0))))
    slots = F.array_distinct(F.transform(F.array(*[F.lit(s * c.dt) for s in (-1, 0, 1)]), lambda d: F.floor((F.col(mjd) + d) / c.slot)))
    zones = F.array_distinct(F.transform(F.array(*[F.lit(s * c.radius) for s in (-1, 0, 1)]), lambda d: F.floor((F.col(dec) + d) / c.height)))
    cell = lambda x, n: F.least(F.floor(g.wrap360(x) / 360.0 * n), n - 1)
    cells = lambda z: F.array_distinct(F.transform(F.array(*[F.lit(s) for s in (-1, 0, 1)]), lambda s: cell(F.col(ra) + half * s, cells_of_zone(z, c.height))))
    regions = F.flatten(F.transform(zones, lambda z: F.transform(cells(z), lambda x: F.struct(z.alias("z"), x.alias("x")))))
    return F.flatten(F.transform(slots, lambda s: F.transform(regions, lambda r: _place(s, r["z"], r["x"]))))


def write_zoned(dets: DataFrame, name: str, layout: Layout | None = None) -> None:
    """The detections as a table of this name, bucketed and sorted by ``place``; ``home`` tells the rows from their copies.
    The layout goes into the properties of the table. Detections without a time or a position have no place and are left out."""
    c = layout or Layout()
    rows = dets.where("mjd is not null and ra is not null and dec is not null").withColumn("__home", home_place("mjd", "ra", "dec", c))
    rows = rows.withColumn("place", F.explode(places_near("mjd", "ra", "dec", c))).withColumn("home", F.col("place") == F.col("__home")).drop("__home")
    # one file a bucket: rows arrive by the hash that the buckets go by
    rows.repartition(c.buckets, "place").write.bucketBy(c.buckets, "place").sortBy("place").mode("overwrite").saveAsTable(name)
    properties = ", ".join(f"'{_PROPERTY}{k}' = '{v!r}'" for k, v in asdict(c).items())
    dets.sparkSession.sql(f"alter table {name} set tblproperties ({properties})")


def layout_of(spark: SparkSession, name: str) -> Layout:
    found = {r["key"].removeprefix(_PROPERTY): r["value"] for r in spark.sql(f"show tblproperties {name}").collect() if r["key"].startswith(_PROPERTY)}
    if not found:
        raise BadInput(f"{name} was not written by write_zoned")
    return Layout(**{k: int(v) if k == "buckets" else float(v) for k, v in found.items()})


@contextmanager
def by_place(spark: SparkSession) -> Iterator[None]:
    """Within it joins on the place and more are planned by place alone, so that buckets meet as they are. Plans are made by
    actions, so these belong into it as well."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def zoned_tracklets(spark: SparkSession, name: str, config: TrackletConfig | None = None) -> DataFrame:
    """det_a, det_b, dt, dist as ``find_tracklets`` has them, from a table of ``write_zoned``; within ``by_place`` no
    detection is shuffled."""
    c, layout = config or TrackletConfig(), layout_of(spark, name)
    radius = max(c.max_v * c.max_dt, 1e-6)
    if radius > layout.radius or c.max_dt > layout.dt:
        raise BadParameter(f"{name} has partners within {layout.radius} degrees and {layout.dt} days only")
    rows = spark.table(name).select("place", "home", "det_id", "mjd", g.wrap360("ra").alias("ra"), "dec")
    mine = lambda df, s: df.select("place", *[F.col(k).alias(f"{k.split('_')[0]}_{s}") for k in ("det_id", "mjd", "ra", "dec")])
    pairs = sized(image_pairs(rows.where("home"), c.min_dt, c.max_dt))
    a = sky_key(mine(rows.where("home"), "a"), "ra_a", "dec_a", radius).join(pairs, "mjd_a")
    b = sky_keys_near(mine(rows, "b"), "ra_b", "dec_b", radius)
    met = a.join(b.hint("merge"), ["place", "mjd_b", "__zone", "__cell"]).where(F.abs(F.col("dec_a") - F.col("dec_b")) <= c.max_v * F.col("dt"))
    met = met.withColumn("dist", g.haversine("ra_a", "dec_a", "ra_b", "dec_b"))
    return met.where((F.col("dist") >= c.min_v * F.col("dt")) & (F.col("dist") < c.max_v * F.col("dt"))).select("det_a", "det_b", "dt", "dist")


def zoned_proximity(queries: DataFrame, name: str, dist: float, dt: float, query_id: str = "det_id") -> DataFrame:
    """query_id, data_id: detections of the table at less than ``dist`` degrees and at most ``dt`` days from the queries (their id,
    mjd, ra, dec). Queries go to the buckets, the detections stay where they are."""
    spark = queries.sparkSession
    layout = layout_of(spark, name)
    if not 0 < dist <= layout.radius or dt > layout.dt:
        raise BadParameter(f"{name} has partners within {layout.radius} degrees and {layout.dt} days only")
    q = queries.select(F.col(query_id).alias("query_id"), F.col("mjd").alias("q_mjd"), F.col("ra").alias("q_ra"), F.col("dec").alias("q_dec"))
    q = q.where("q_mjd is not null and q_ra is not null and q_dec is not null").withColumn("place", home_place("q_mjd", "q_ra", "q_dec", layout))
    data = sky_key(spark.table(name).select("place", F.col("det_id").alias("data_id"), "mjd", "ra", "dec"), "ra", "dec", dist)
    met = data.join(sky_keys_near(q, "q_ra", "q_dec", dist).hint("merge"), ["place", "__zone", "__cell"])
    near = (F.abs(F.col("mjd") - F.col("q_mjd")) <= dt) & (g.haversine("ra", "dec", "q_ra", "q_dec") < dist)
    return met.where(near).select("query_id", "data_id")

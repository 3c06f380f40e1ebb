"""Detections stored by night and place: the same partners as brute force, and no detection is shuffled."""

import math
import random
import re
import uuid

import pytest

from skyweave.config import BadInput, BadParameter, TrackletConfig
from skyweave.operators.proximity import detection_proximity
from skyweave.operators.tracklets import find_tracklets
from skyweave.sources import zones

SCHEMA = "det_id long, mjd double, ra double, dec double, image_id long"


@pytest.fixture(scope="module")
def sky(spark):
    """Crowded spots: the poles, ends of right ascension, corners of regions, midnight; one field holds a third of all rows."""
    rng, rows = random.Random(5), []
    spots = [(0, 90), (123, -90), (0, 0), (359.99, 35), (72, 40), (200, 88.5), (10, -85), (180, 45)]
    for _ in range(900):
        ra, dec = spots[0 if rng.random() < 0.33 else rng.randrange(len(spots))]
        dec = max(-90.0, min(90.0, dec + rng.uniform(-1.2, 1.2)))
        ra += rng.uniform(-1.2, 1.2) / max(0.02, math.cos(math.radians(dec)))
        rows.append((len(rows), 60000 + rng.choice([0.4, 0.96, 0.99, 1.0, 1.02]), ra % 360, dec, 0))
    dets = spark.createDataFrame(rows, SCHEMA).cache()
    name = f"zoned_{uuid.uuid4().hex}"
    zones.write_zoned(dets, name, zones.Layout(0.8, 0.0625, 5.0, 1.0, 8))
    yield rows, dets, name
    spark.sql(f"drop table {name}")


def apart(a, b):
    x = math.sin(math.radians(b[3] - a[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(x))))


def test_pairs_equal_brute_force(spark, sky):
    rows, dets, name = sky
    c = TrackletConfig(10.0, 0.0, 0.01, 0.0625)
    want = {(a[0], b[0]) for a in rows for b in rows if c.min_dt <= b[1] - a[1] <= c.max_dt and apart(a, b) < c.max_v * (b[1] - a[1])}
    for got in (zones.zoned_tracklets(spark, name, c), find_tracklets(dets, c)):
        pairs = [(r.det_a, r.det_b) for r in got.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 1000


def test_lookup_equals_brute_force(sky):
    rows, dets, name = sky
    want = {(a[0], b[0]) for a in rows if a[0] % 3 == 0 for b in rows if abs(a[1] - b[1]) <= 0.05 and apart(a, b) < 0.8}
    asked = dets.where("det_id % 3 = 0")
    got = [(r.query_id, r.data_id) for r in zones.zoned_proximity(asked, name, 0.8, 0.05).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r.query_id, r.data_id) for r in detection_proximity(asked, dets, 0.8, 0.05).collect()} == want


def test_no_detection_is_shuffled(spark, sky):
    _, dets, name = sky
    with zones.by_place(spark):
        plan = zones.zoned_tracklets(spark, name, TrackletConfig(10.0, 0.0, 0.01, 0.0625))._jdf.queryExecution().executedPlan().toString()
        looked = zones.zoned_proximity(dets, name, 0.8, 0.05)._jdf.queryExecution().executedPlan().toString()
    # only the times of the images move for pairs, and only the queries for a lookup
    assert set(re.findall(r"Exchange hashpartitioning\((\w+?)#", plan)) <= {"mjd", "mjd_a", "mjd_b", "__b"} and "Bucketed: true" in plan
    assert len(re.findall(r"Exchange hashpartitioning", looked)) == 1 and "SelectedBucketsCount: 8 out of 8" in looked
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_each_detection_is_home_once(spark, sky):
    rows, _, name = sky
    homes = [r.det_id for r in spark.table(name).where("home").select("det_id").collect()]
    assert sorted(homes) == [r[0] for r in rows]


def test_edges(spark, sky):
    name = f"zoned_{uuid.uuid4().hex}"
    zones.write_zoned(spark.createDataFrame([(1, None, 1.0, 1.0, 0), (2, 1.0, None, 1.0, 0)], SCHEMA), name)
    assert zones.layout_of(spark, name) == zones.Layout() and zones.zoned_tracklets(spark, name, TrackletConfig(0.5)).count() == 0
    spark.sql(f"drop table {name}")
    with pytest.raises(BadParameter):
        zones.zoned_tracklets(spark, sky[2], TrackletConfig(100.0))
    with pytest.raises(BadParameter):
        zones.Layout(radius=3.0, height=5.0)
    spark.range(1).write.saveAsTable(name)
    with pytest.raises(BadInput):
        zones.layout_of(spark, name)
    spark.sql(f"drop table {name}")

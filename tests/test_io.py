"""Text files out and in again, exports, streams."""

import pytest
from pyspark.sql import functions as F

from skyweave.config import BadInput, TrackletConfig
from skyweave.operators import analysis, simulate
from skyweave.operators.common import assign_ids
from skyweave.sources import events, export, text
from skyweave.streaming import nightly


@pytest.fixture
def dets(spark, sf):
    return events.read_detections(spark, sf).where("det_id < 60").withColumn("snr", F.lit(9.5))


def test_detections_round_trip(spark, dets, tmp_path):
    text.write_detections(dets, f"{tmp_path}/d")
    back = text.read_detections(spark, f"{tmp_path}/d", error=0.1)
    assert sorted(map(tuple, back.select("det_id", "ssm_id", "ra", "mjd").collect())) == sorted(map(tuple, dets.select("det_id", "ssm_id", "ra", "mjd").collect()))
    assert back.first().ra_err == 0.1


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1 2 3 4 5 6 7 8\n\n1 2 x 4 5 6 7 8\n1 2\n")
    assert text.read_detections(spark, f"{tmp_path}/x.txt", mode="drop").count() == 1
    with pytest.raises(Exception, match="malformed"):
        text.read_detections(spark, f"{tmp_path}/x.txt").collect()


def test_id_lists(spark, dets, tmp_path):
    sets = spark.createDataFrame([([3, 1, 2],), ([7, 9],)], "det_ids array<long>")
    text.write_id_lists(sets, f"{tmp_path}/t")
    assert sorted(r.det_ids for r in text.read_tracklets(spark, f"{tmp_path}/t").collect()) == [[1, 2, 3], [7, 9]]
    (tmp_path / "bad.txt").write_text("5 5\n")
    with pytest.raises(Exception, match="malformed"):
        text.read_tracklets(spark, f"{tmp_path}/bad.txt").collect()
    (tmp_path / "unknown.txt").write_text("5 99999\n")
    with pytest.raises(BadInput):
        text.read_tracks(spark, f"{tmp_path}/unknown.txt", dets)


def test_orbits_fields_datafiles(spark, tmp_path):
    (tmp_path / "o.txt").write_text("1 .1 5 6 7 59000 2000\n2 .2 5 6 7 59000 2000 77\n\n")
    assert sorted(r.orbit_id for r in text.read_orbits(spark, f"{tmp_path}/o.txt").collect()) == [0, 77]
    (tmp_path / "f.txt").write_text("1 300 50 50 1.75\n")
    assert text.read_fields(spark, f"{tmp_path}/f.txt").first().radius == 1.75
    (tmp_path / "e.txt").write_text("1 300 50 50\n")
    assert text.read_ephemerides(spark, f"{tmp_path}/e.txt").count() == 1
    (tmp_path / "m.txt").write_text("1 53736.5 10 -20 21.5 807 NS 0 0\n2 53736.5 10 -20 21.5 807 S1 0 0 30\n")
    assert [r.etime for r in text.read_miti(spark, f"{tmp_path}/m.txt").orderBy("det_id").collect()] == [None, 30.0]
    (tmp_path / "d.txt").write_text("# c\n! c\n0 1 2\n0 3 4\n0 5 6\n")
    assert [tuple(r) for r in text.read_datafile(spark, f"{tmp_path}/d.txt", "a long, b long", sample=2, start_column=1).orderBy("a").collect()] == [(1, 2), (5, 6)]


def test_night_partitions(spark, dets, tmp_path):
    text.write_by_night(dets, f"{tmp_path}/n", per_image=True)
    back = spark.read.parquet(f"{tmp_path}/n")
    assert back.count() == dets.count() and {"night", "image_id"} <= set(back.columns)
    text.write_datafile(dets.select("det_id"), f"{tmp_path}/w")
    assert spark.read.csv(f"{tmp_path}/w", header=True).count() == dets.count()


def test_mpc_line(spark):
    d = spark.createDataFrame([(7, 53736.25, 359.999999, -0.5, 21.25)], "det_id long, mjd double, ra double, dec double, mag double")
    line = d.select(text.mpc_line("det_id", "mjd", "ra", "dec", "mag")).first()[0]
    assert len(line) == 80 and "2006 01 01.25000" in line and " 24 00 00.00 -00 30 00.0" in line


def test_export(spark, dets, tmp_path):
    tracks = spark.createDataFrame([(1, list(range(20))), (2, [1, 2, 3])], "track_id long, det_ids array<long>")
    ids = tracks.select("track_id", export.subsampled().alias("x")).orderBy("track_id").collect()
    assert ids[0].x == [*range(8), 10, 11, *range(12, 20)] and ids[1].x == [1, 2, 3]
    images = dets.select("image_id", F.lit(24.5).alias("m5"), F.lit(0.7).alias("seeing")).distinct()
    export.write_orbit_input(tracks, dets, images, f"{tmp_path}/od")
    request = spark.read.text(f"{tmp_path}/od/request")
    assert request.where("value like '1 3 1 2 3 REQUEST_PRELIM 3 %'").count() == 1
    assert spark.read.text(f"{tmp_path}/od/tracklet").count() == 20
    many = spark.range(50).selectExpr("id as track_id", "array(id, id + 1, id + 2) as det_ids")
    counts = export.file_sets(many, max_detections=100, max_tracks=20).groupBy("file_set").count().collect()
    assert sum(r["count"] for r in counts) == 50 and all(r["count"] * 3 <= 100 for r in counts)


def test_ids(spark):
    got = assign_ids(spark.range(1000).repartition(7), ["id"], "k", 5)
    assert got.where("k <> id + 5").count() == 0 and got.count() == 1000


def test_noise_stays_in_the_field(spark):
    images = spark.createDataFrame([(1, 5.0, 0.5, 10.0), (2, 6.0, 100.0, -40.0)], "image_id long, mjd double, ra double, dec double")
    n = simulate.noise_detections(images, 200, 1000)
    assert n.count() == 400 and n.select("det_id").distinct().count() == 400
    from skyweave.functions.geometry import haversine

    far = n.join(images.selectExpr("image_id", "ra as ra_c", "dec as dec_c"), "image_id").where(haversine("ra", "dec", "ra_c", "dec_c") > 1.9)
    assert far.count() == 0


def test_stream_stream_pairs(spark, sf, tmp_path):
    rows = events.read_detections(spark, sf).withColumn("ts", F.timestamp_micros(((F.col("mjd") - 40587) * 86400e6).cast("long")))
    rows.orderBy("mjd").coalesce(1).write.parquet(f"{tmp_path}/in")
    config = TrackletConfig(0.5, 0.0, 0.01, 0.0625)
    stream = nightly.streaming_pairs(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), config)
    q = stream.writeStream.format("memory").queryName("pairs_stream").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    from skyweave.operators.tracklets import find_tracklets

    key = lambda df: sorted((r.det_a, r.det_b) for r in df.collect())
    assert key(spark.table("pairs_stream")) == key(find_tracklets(rows, config))


def test_link_latest(spark, sf):
    from skyweave.config import LinkConfig
    from skyweave.operators import tracklets as tk
    from skyweave.plans.pipeline import night_tracklets

    d = events.read_detections(spark, sf)
    lets = night_tracklets(d, TrackletConfig(0.5, 0.0, 0.01, 0.0625))
    assert {"tracklet_id", "det_ids", "night"} <= set(lets.columns) and tk.long_form(lets).count() >= 2 * lets.count()
    assert nightly.link_latest(d, lets, 60330, LinkConfig()).count() >= 0


def test_counts(spark):
    graded = spark.createDataFrame([(1, 3, -1, False), (2, 3, 5, True)], "track_id long, n_dets long, object_id long, is_true boolean")
    assert tuple(analysis.totals(graded).first()) == (2, 1, 1, 50.0)
    assert tuple(analysis.totals(graded.limit(0)).first())[:3] == (0, 0, 0)


def test_tables(spark, dets, tmp_path):
    from skyweave.sources import tables

    text.write_by_night(dets, f"{tmp_path}/n")
    nights = sorted(r[0] for r in tables.read_nights(spark, f"{tmp_path}/n").select("night").distinct().collect())
    some = tables.read_nights(spark, f"{tmp_path}/n", nights[0], nights[0])
    assert [r[0] for r in some.select("night").distinct().collect()] == nights[:1]
    assert "PartitionFilters: [isnotnull(night" in some._jdf.queryExecution().toString()
    tables.write_table(dets.select("det_id", "ra"), "bucketed_dets", "det_id", 4)
    plan = spark.table("bucketed_dets").join(spark.table("bucketed_dets").withColumnRenamed("ra", "r2").hint("merge"), "det_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("drop table bucketed_dets")


def test_scalar_edges(spark):
    from skyweave.functions import geometry as g

    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert abs(value(g.arc_to_ra(0.0, 30.0)) - 30) < 1e-9 and value(g.arc_to_ra(89.9, 2.0)) == 180
    for dec in range(0, 90, 10):
        assert abs(value(g.haversine(0.0, float(dec), g.arc_to_ra(float(dec), 1.0), float(dec))) - 1) < 1e-9
    assert value(g.wrap360(-370.0)) == 350 and value(g.signed_distance(1.0, 359.0)) == 2 and value(g.signed_distance(180.0, 0.0)) == -180
    assert value(g.arc_contains(350.0, 10.0, 0.0)) and not value(g.arc_contains(350.0, 10.0, 180.0)) and value(g.arc_contains(0.0, 180.0, 77.0))
    assert value(g.intervals_overlap(350.0, 10.0, 5.0, 20.0, True)) and not value(g.intervals_overlap(350.0, 10.0, 15.0, 20.0, True))
    assert value(g.arcs_overlap(350.0, 10.0, 5.0, 20.0)) and value(g.negative_above_180(359.0, 1.0, 359.0)) == -1


def test_file_sets_never_exceed_the_limit(spark):
    sizes = [10, 400, 450, 60, 500, 3, 499, 1, 1, 1]
    rows, at = [], 0
    for k, n in enumerate(sizes):
        rows.append((k, list(range(at, at + n))))
        at += n
    got = export.file_sets(spark.createDataFrame(rows, "track_id long, det_ids array<long>"), max_detections=500, max_tracks=4).collect()
    sets = {}
    for r in sorted(got, key=lambda r: r.track_no):
        sets.setdefault(r.file_set, []).append(len(r.det_ids))
    assert all(sum(v) <= 500 and len(v) <= 4 for v in sets.values()) and sorted(sum(sets.values(), [])) == sorted(sizes) and len(sets) == 7
    with pytest.raises(Exception, match="501 detections"):
        export.file_sets(spark.createDataFrame([(0, list(range(501)))], "track_id long, det_ids array<long>"), max_detections=500).collect()


def test_numbered_files(spark, tmp_path):
    for n in (2, 10, 1):
        (tmp_path / f"orbits_{n}.txt").write_text(f"a{n}\nb{n}\n")
    got = text.read_numbered(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.file_no, r.value) for r in got] == [(n, f"{c}{n}") for n in (1, 2, 10) for c in "ab"]


def test_truth_values():
    from skyweave.functions.stats import bool_to_string, parse_bool

    assert [parse_bool(bool_to_string(x)) for x in (True, False)] == [True, False]


def test_pairs_of_micro_batches(spark, sf, tmp_path):
    """Detections that come in parts and out of order pair as they do in one table; a batch that runs again changes nothing."""
    rows = events.read_detections(spark, sf).select("det_id", "mjd", "ra", "dec")
    config = TrackletConfig(0.5, 0.0, 0.01, 0.0625)
    folder, sink = f"{tmp_path}/s", nightly.pair_nights(f"{tmp_path}/s", config)
    for k in (2, 0, 1):
        rows.where(F.pmod(F.xxhash64("det_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    nightly.nightly(stream, sink, f"{tmp_path}/c").awaitTermination()
    from skyweave.functions.nights import night_int
    from skyweave.operators.tracklets import find_tracklets

    key = lambda df: sorted((r.det_a, r.det_b, r.night) for r in df.collect())
    want = key(find_tracklets(rows, config).join(rows.select(F.col("det_id").alias("det_a"), night_int("mjd").alias("night")), "det_a"))
    found = nightly.stored_pairs(spark, folder)
    assert want and key(found) == want and found.select("batch").distinct().count() > 1
    held = spark.read.parquet(f"{folder}/detections/batch=1").select("det_id", "mjd", "ra", "dec")
    again = spark.createDataFrame(held.collect(), held.schema)
    sink(again, 1)
    assert key(nightly.stored_pairs(spark, folder)) == want


def test_empty_micro_batch(spark, tmp_path):
    empty = spark.createDataFrame([], "det_id long, mjd double, ra double, dec double")
    nightly.pair_nights(f"{tmp_path}/s", TrackletConfig(0.5, 0.0, 0.01, 0.0625))(empty, 0)
    assert nightly.stored_pairs(spark, f"{tmp_path}/s").count() == 0


def test_chain_of_a_stream_is_the_plan_of_the_whole(spark, tmp_path):
    """Batches in disorder, late detections and a batch that runs again give the tracklets and tracks of one plan."""
    import numpy as np

    from skyweave.config import CollapseConfig, LinkConfig
    from skyweave.operators import sets
    from skyweave.operators.simulate import generate_track
    from skyweave.plans.pipeline import run_pipeline

    r = np.random.default_rng(12)
    t = np.concatenate([60310 + n + np.array([0.1, 0.12, 0.14]) for n in range(5)])
    rows = []
    for k in range(9):
        ra, dec = generate_track(t, (340 + 0.5 * k, -15 + 0.2 * k), (r.uniform(-0.2, 0.2), r.uniform(-0.1, 0.1)), (2e-4, -1e-4))
        rows += [(len(rows) + j, int(round(m * 100)), k, float(a % 360 + r.normal(0, 1e-6)), float(d), float(m), 20.0) for j, (m, a, d) in enumerate(zip(t, ra, dec))]
    schema = "det_id long, image_id long, ssm_id long, ra double, dec double, mjd double, mag double"
    dets = spark.createDataFrame(rows, schema)
    find, merge, linking = TrackletConfig(0.5, 0.0, 0.01, 0.0625), CollapseConfig(), LinkConfig()
    chain = nightly.NightlyChain(f"{tmp_path}/s", find, merge, linking)
    chain.create(spark)
    dets.limit(0).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    # two thirds of the first three nights; then the rest of these, late, and the last nights
    parts = ["mjd < 60313 and det_id % 3 <> 1", "mjd >= 60313 or mjd < 60313 and det_id % 3 = 1"]
    seen = []
    for part in parts:
        dets.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        chain.advance(spark, stream)
        seen.append({x.night for x in chain.tracklets(spark).select("night").distinct().collect()})
    assert seen == [{60310, 60311}, {60310, 60311, 60312, 60313}]
    chain.finish(spark)
    want = run_pipeline(dets, find, merge, linking)
    lets = lambda df: sorted((tuple(x.det_ids), x.night) for x in df.collect())
    tracks = lambda df: sorted((tuple(x.det_ids), tuple(x.tracklet_ids)) for x in df.collect())
    assert lets(chain.tracklets(spark)) == lets(want.tracklets)
    from skyweave.operators import link

    found = link.with_track_ids(chain.tracks(spark))
    whole = tracks(want.tracks)
    assert len(whole) >= 9 and tracks(sets.remove_subsets(found, "track_id")) == whole
    chain.close(spark, [60311], "late-1")  # once more
    assert tracks(sets.remove_subsets(link.with_track_ids(chain.tracks(spark)), "track_id")) == whole


def test_as_of_join_equals_brute_force(spark):
    import random

    from skyweave.operators.proximity import as_of_join

    r = random.Random(2)
    # dense days, long gaps, equal times, a key of asks alone, nulls
    points = [(r.choice([1, 2, 2, 2]), round(r.choice([0, 1, 40, 41, 200]) + r.randrange(20) / 10, 1), r.randrange(99)) for _ in range(150)] + [(None, 5.0, 1), (1, None, 2)]
    asks = [(k, r.choice([1, 2, 3]), round(r.uniform(-3, 210), 1)) for k in range(200)] + [(500, None, 5.0), (501, 1, None), (502, 2, -1e6), (503, 2, 1e6)]
    got = as_of_join(spark.createDataFrame(asks, "n long, key long, t double"), spark.createDataFrame(points, "key long, mjd double, v long"), "key", "t", "mjd", ["v"], block=2.0)
    want = {}
    for n, key, t in asks:
        mine = [(m, v) for k, m, v in points if k == key and m is not None] if key is not None and t is not None else []
        want[n] = max([p for p in mine if p[0] < t], default=None), min([p for p in mine if p[0] > t], default=None)
    assert {x.n: (tuple(x.before) if x.before else None, tuple(x.after) if x.after else None) for x in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

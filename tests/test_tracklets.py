"""Hand-typed cases of pairing, and equality with the plain theta join on random skies (wrap, poles, ties)."""

import math
import random

import pytest

from skyweave.config import BadParameter, TrackletConfig
from skyweave.operators import proximity, sets, tracklets

SCHEMA = "det_id long, mjd double, ra double, dec double, ssm_id long, image_id long, mag double"


def sky(spark, rows):
    return spark.createDataFrame([(i, float(t), float(ra), float(dec), -1, int(t * 100), 20.0) for i, (t, ra, dec) in enumerate(rows)], SCHEMA)


def pairs(spark, rows, **options):
    found = tracklets.find_tracklets(sky(spark, rows), **options).collect()
    return sorted(tuple(sorted((r.det_a, r.det_b))) for r in found)


T = 53736.0
CASES = [
    ("empty", [], 1.5, 0.0, []),
    ("two", [(T, 100, 10), (T + 1, 100.1, 10.1)], 1.5, 0.0, [(0, 1)]),
    ("three", [(T, 100, 10), (T + 1, 100.1, 10.1), (T + 2, 100.2, 10.2)], 3, 0.0, [(0, 1), (0, 2), (1, 2)]),
    ("two objects", [(T, 100, -10), (T + 1, 100.1, -10.1), (T, 150, -10), (T + 1, 150.1, -10.1)], 3, 0.0, [(0, 1), (2, 3)]),
    ("too fast", [(T, 100, 80), (T + 1, 100.1, 80), (T, 150, 0), (T + 1, 151.1, 0.1)], 3, 0.0, [(0, 1)]),
    ("fast near the pole", [(T, 100, 80), (T + 1, 100.1, 80), (T, 150, -80), (T + 0.5, 153, -80)], 3, 0.0, [(0, 1)]),
    ("circle, not square", [(T, 100, 10), (T + 1, 100.1, 10.1), (T, 150, 20), (T + 1, 150.9, 20.9)], 3, 0.0, [(0, 1)]),
    ("same time", [(T, 100, 100), (T, 100.1, 100)], 3, 0.0, []),
    ("through zero", [(T, 0.1, -0.1), (T + 1, 0.1, 0.1), (T, 0.1, -2)], 3, 0.0, [(0, 1)]),
    ("slow, wrap", [(T, 0.05, 0.05), (T + 1, 359.95, 0.05), (T, 0.1, 20.5), (T + 1, 359.5, 20.5)], 3, 0.5, [(2, 3)]),
    ("slow, over the pole", [(T, 0.05, 89.95), (T + 1, 180.05, 89.95), (T, 10.5, 89.7), (T + 1, 190.5, 89.7)], 3, 0.5, [(2, 3)]),
    ("slow, at zero", [(T, 0.05, 0.05), (T + 1, 359.95, -0.05), (T, 0.25, 0.25), (T + 1, 359.75, -0.25)], 3, 0.5, [(2, 3)]),
]


@pytest.mark.parametrize("name,rows,max_dt,min_v,expected", CASES, ids=[c[0] for c in CASES])
def test_cases(spark, name, rows, max_dt, min_v, expected):
    assert pairs(spark, rows, max_v=1.0, min_v=min_v, max_dt=float(max_dt)) == expected


def distance(a, b):
    d1, d2, r = math.radians(a[2]), math.radians(b[2]), math.radians(b[1] - a[1])
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin(r / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(min(1, h))))


def random_sky(seed, n=160):
    r = random.Random(seed)
    spots = [(0, 0), (359.9, 30), (120, 89.8), (200, -89.9), (10, -45)]
    out = []
    for _ in range(n):
        ra, dec = r.choice(spots)
        out.append((T + r.choice([0, 0.02, 0.04, 0.06, 0.2]), (ra + r.uniform(-0.4, 0.4) * (1 if abs(dec) < 60 else 300)) % 360, max(-90, min(90, dec + r.uniform(-0.3, 0.3)))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_equals_theta_join(spark, seed):
    rows = random_sky(seed)
    expected = sorted((i, j) if i < j else (j, i) for i, a in enumerate(rows) for j, b in enumerate(rows) if b[0] > a[0] and 0.01 <= b[0] - a[0] <= 0.0625 and distance(a, b) < 2.0 * (b[0] - a[0]))
    assert pairs(spark, rows, max_v=2.0) == expected


def test_bad_parameters():
    with pytest.raises(BadParameter):
        TrackletConfig(max_v=0)
    with pytest.raises(BadParameter):
        TrackletConfig(min_v=3.0)


@pytest.mark.parametrize("seed", range(2))
def test_detection_and_cone_proximity(spark, seed):
    q, d = random_sky(seed, 60), random_sky(seed + 10, 120)
    got = sorted(map(tuple, proximity.detection_proximity(sky(spark, q), sky(spark, d), 0.25, 0.05).collect()))
    assert got == sorted((i, j) for i, a in enumerate(q) for j, b in enumerate(d) if abs(a[0] - b[0]) <= 0.05 and distance(a, b) < 0.25)
    got = sorted(map(tuple, proximity.cone_join(sky(spark, q), sky(spark, d), 0.25, "det_id", "det_id", {"mjd": (0.05, "euclidean")}).collect()))
    assert got == sorted((i, j) for i, a in enumerate(q) for j, b in enumerate(d) if abs(a[0] - b[0]) <= 0.05 and distance(a, b) < 0.25)


def test_detection_proximity_case(spark):
    assert proximity.detection_proximity(sky(spark, [(T, 100, 50)]), sky(spark, [(T, 100.01, 50.01)]), 0.1, 0.1).collect() == [(0, 0)]
    assert proximity.detection_proximity(sky(spark, []), sky(spark, [(T, 1, 1)]), 0.1, 0.1).collect() == []


def test_field_proximity_case(spark):
    f = spark.createDataFrame([(1, 300.0, 50.0, 50.0, 1.75)], "field_id long, mjd double, ra double, dec double, radius double")
    e = spark.createDataFrame([(42, 299.5, 50.0, 50.0), (42, 300.5, 51.0, 49.0), (43, 299.5, 50.0, 50.0)], "track_id long, mjd double, ra double, dec double")
    assert proximity.field_proximity(f, e).collect() == [(1, 42)]
    with pytest.raises(ValueError):
        proximity.field_proximity(f, e, strict=True)


def test_orbit_proximity_case(spark):
    names = "orbit_id long, perihelion double, eccentricity double, inclination double, arg_perihelion double, longitude double, t_perihelion double"
    a = spark.createDataFrame([(0, 100.0, 100.0, 200.0, 359.9, 10.0, 53736.0)], names)
    b = spark.createDataFrame([(0, 101.0, 101.0, 201.0, 0.5, 11.0, 53737.0), (1, 101.0, 101.0, 201.0, 5.0, 11.0, 53737.0)], names)
    assert proximity.orbit_proximity(a, b, dict.fromkeys(proximity.ORBIT_TOLERANCES, 1.1)).collect() == [(0, 0)]
    assert proximity.orbit_proximity(a.limit(0), b).collect() == []


def id_sets(spark, lists):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "tracklet_id long, det_ids array<long>")


def test_subsets(spark):
    nested = [list(range(k + 1)) for k in range(60)]
    assert [r.tracklet_id for r in sets.remove_subsets(id_sets(spark, nested)).collect()] == [59]
    assert sorted(r.tracklet_id for r in sets.remove_subsets(id_sets(spark, [*nested, [500, 505]])).collect()) == [59, 60]
    assert sorted(r.tracklet_id for r in sets.longest_per_detection(id_sets(spark, [[0, 1, 2], [0, 4]])).collect()) == [0, 1]
    assert sorted(r.tracklet_id for r in sets.longest_per_detection(id_sets(spark, [[0, 1, 2], [0, 4], [4, 5, 6]])).collect()) == [0, 2]


@pytest.mark.parametrize("seed", range(3))
def test_random_subsets(spark, seed):
    r = random.Random(seed)
    lists = [sorted(r.sample(range(14), r.randint(1, 6))) for _ in range(80)]
    expected = [i for i, a in enumerate(lists) if not any(set(a) <= set(b) and (len(b) > len(a) or j < i and set(a) == set(b)) for j, b in enumerate(lists))]
    assert sorted(x.tracklet_id for x in sets.remove_subsets(id_sets(spark, lists)).collect()) == expected


def test_set_equality(spark):
    a, b = id_sets(spark, [[1, 2], [3]]), id_sets(spark, [[3], [2, 1], [3]])
    assert sets.same_sets(a, b) and not sets.same_sets(a, b, bag=True)


def test_sets_that_come_in_parts(spark, tmp_path):
    """Additions in any order leave the maximal sets of all; the same version again changes nothing."""
    import random

    from skyweave.operators import sets

    r = random.Random(7)
    rows = [(k, sorted(r.sample(range(25), r.choice([1, 2, 2, 3, 4, 6])))) for k in range(160)]
    rows += [(200 + k, rows[k][1]) for k in range(20)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "tracklet_id long, det_ids array<long>")
    store = sets.MaximalSets(str(tmp_path))
    store.create(spark)
    part = lambda v: spark.createDataFrame(rows[60 * v : 60 * v + 60], frame.schema)
    for v in range(3):
        store.add(part(v), v)
        seen = spark.createDataFrame(rows[: 60 * v + 60], frame.schema)
        assert {x.id for x in store.sets(spark).collect()} == {x.tracklet_id for x in sets.remove_subsets(seen).collect()}
    want = {x.id for x in store.sets(spark).collect()}
    store.add(part(2), 2)
    assert {x.id for x in store.sets(spark).collect()} == want

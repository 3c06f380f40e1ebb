"""Tracks that truth allows, against a walk in plain Python."""

import math
import random

from skyweave.operators.simulate import true_tracklets, true_tracks

SCHEMA = "det_id long, mjd double, ra double, dec double, ssm_id long"


def turn(x):
    return (x + 180) % 360 - 180


def walk_tracklets(rows, max_v=0.5, max_dt=0.0625, min_dt=0.01):
    rows, used, out = sorted(rows, key=lambda r: (r[1], r[0])), set(), []
    for i, a in enumerate(rows):
        if a[0] in used:
            continue
        chosen = [a]
        for b in rows[i + 1 :]:
            dt = b[1] - a[1]
            if min_dt <= dt <= max_dt or len(chosen) > 1 and 0 < dt <= 0.5:
                x, y = turn(b[2] - a[2]), b[3] - a[3]
                if math.sqrt(x * x + y * y) / dt <= max_v:
                    chosen.append(b)
        used.update(r[0] for r in chosen)
        if len(chosen) > 1:
            out.append(chosen)
    return out


def walk_tracks(rows, acc=0.02, window=15, min_obs=6, min_nights=3):
    v = lambda x: (turn(x[1][2] - x[0][2]) / (x[1][1] - x[0][1]), (x[1][3] - x[0][3]) / (x[1][1] - x[0][1]))
    lets, out = walk_tracklets(rows), set()
    for a in lets:
        parts = [a]
        for b in lets:
            dt = b[0][1] - a[0][1]
            if dt > 0 and math.floor(b[0][1]) - math.floor(a[0][1]) <= window and all(abs(p - q) / dt <= acc for p, q in zip(v(a), v(b))):
                parts.append(b)
        if sum(map(len, parts)) >= min_obs and len({math.floor(p[0][1]) for p in parts}) >= min_nights:
            out.add(tuple(sorted({r[0] for p in parts for r in p})))
    return out


def catalogue(seed):
    """Objects that wander, some over 0 degrees and over midnight, with repeated times and noise."""
    rng, rows = random.Random(seed), []
    for obj in [-1, *range(12)]:
        ra, dec, speed = rng.choice([0.1, 359.9, 120]), rng.uniform(-40, 40), rng.uniform(-0.4, 0.4)
        for night in sorted(rng.sample(range(40), 12)):
            for _ in range(rng.choice([1, 2, 3, 6])):
                t = night + rng.choice([0.3, 0.92]) + rng.choice([0.0, 0.02, 0.04, 0.1, 0.3])
                rows.append((len(rows), 60000 + t, (ra + speed * t) % 360, dec + 0.01 * t + rng.uniform(0, 0.001), obj))
    return rows


def test_equals_the_walk(spark):
    for seed in range(3):
        rows = catalogue(seed)
        dets = spark.createDataFrame(rows, SCHEMA)
        objects = [[r for r in rows if r[4] == k] for k in range(12)]
        lets = {(r.ssm_id, tuple(r.det_ids)) for r in true_tracklets(dets).collect()}
        assert lets == {(k, tuple(r[0] for r in x)) for k, rows_of in enumerate(objects) for x in walk_tracklets(rows_of)}
        want = {(k, ids) for k, rows_of in enumerate(objects) for ids in walk_tracks(rows_of)}
        got = [(r.ssm_id, tuple(r.det_ids)) for r in true_tracks(dets).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        largest = {(k, a) for k, a in want if not any(k == j and set(a) < set(b) for j, b in want)}
        assert {(r.ssm_id, tuple(r.det_ids)) for r in true_tracks(dets, maximal=True).collect()} == largest and largest < want


def test_greedy_start_and_reach(spark):
    rows = [(k, t, t * 0.1, 0.0, 7) for k, t in enumerate([0.0, 0.02, 0.04, 0.3, 1.0, 1.02])]
    got = true_tracklets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.det_ids for r in got) == [[0, 1, 2, 3], [4, 5]]


def test_empty(spark):
    assert true_tracks(spark.createDataFrame([], SCHEMA), maximal=True).count() == 0

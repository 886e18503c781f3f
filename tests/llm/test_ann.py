import math

import numpy as np

from concordat.llm import ann

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(rows, k=10):
    able = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out, seen = [], []
    for q, x in able:
        if q % 100 == 0 and not any(q == p and (x == y).all() for p, y in seen):
            seen.append((q, x))
            near = sorted((float(ann.exact(x[None], y[None])[0]), i) for i, y in able if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def search(spark, rows):
    df = spark.createDataFrame([(*r, 0, "c", "c") for r in rows], VECTORS).repartition(5)
    return sorted(tuple(r) for r in ann.nearest(df, df.filter("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score").collect())


def vectors(n, dims, seed=1, copies=0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dims)).astype(np.float32)
    x[:copies] = x[0]
    x[n // 2 :] *= np.float32(30)
    return [(i, x[i].tolist()) for i in range(n)]


def test_matches_brute_force_with_many_copies(spark):
    rows = vectors(900, 12, copies=400)
    assert search(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(230, 4)
    rows += [(300, None), (400, [0.0] * 4), (500, [1.0, None, 0.0, 0.0]), (600, [1.0, float("nan"), 0.0, 0.0]), (700, [float("inf")] * 4), (800, [1.0, 2.0]), (801, [1.0, 3.0]), (None, [1.0] * 4), (900, [])]
    rows += [(1000, [2.0, 2.0, 2.0, 2.0]), (1000, [2.0, 2.0, 2.0, 2.5])]
    assert search(spark, rows[:-1]) == brute(rows[:-1])
    # Two vectors under one id: a list of ten each, and both are candidates of all others.
    assert search(spark, rows) == brute(rows)
    assert search(spark, rows[:3]) == brute(rows[:3]) and search(spark, []) == []


def test_queries_in_several_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VALUES", 24)
    monkeypatch.setattr(ann, "TILE_VALUES", 640)
    monkeypatch.setattr(ann, "LEAST_CANDIDATES", 50)
    monkeypatch.setattr(ann, "QUERY_TILE", 2)
    monkeypatch.setattr(ann, "TILE", 64)
    rows = vectors(1200, 8, seed=5)
    df = spark.createDataFrame([(*r, 0, "c", "c") for r in rows], VECTORS)
    got = sorted(tuple(r) for r in ann.nearest(df, df.filter("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows)


def test_one_id_of_a_third_of_all_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_CANDIDATES", 20)
    rows = vectors(200, 4) + [(7, [1.0, 1.0, 1.0, float(i % 5)]) for i in range(100)]
    assert search(spark, rows) == brute(rows)


def test_queries_do_not_pass_through_the_driver(spark):
    df = spark.createDataFrame([(*r, 0, "c", "c") for r in vectors(300, 4)], VECTORS)
    plan = ann.nearest(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Broadcast" not in plan and "NestedLoop" not in plan


def test_bounds_hold():
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(300, 32)) * rnd.choice([1e-6, 1, 1e6], size=(300, 1))
    q = ann.Quantised(x)
    back = q.q * q.scale[:, None]
    assert (np.sqrt(((x - back) ** 2).sum(1)) <= q.error).all()


def test_repeated_query_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VALUES", 8)
    rows = [(i, v) for i, v in vectors(150, 4) if i % 100]
    twins = [[0.5, 0.5, 0.5, 0.5], [9.0, 9.0, 9.0, 9.0]]
    own = [brute([*rows, (1000, v)]) for v in twins]
    assert search(spark, [*rows, (1000, twins[0]), (1000, twins[0])]) == own[0]
    assert search(spark, [*rows, (1000, twins[0]), (1000, twins[1]), (1000, twins[1])]) == sorted(own[0] + own[1])

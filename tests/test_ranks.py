import random
from collections import defaultdict

from pyspark.sql import functions as F

from concordat.operators import metrics, planner, ranks


def test_values_at_ranks_match_sorting(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(0, rnd.randrange(-(10**12), 10**12)) for _ in range(300)] + [(1, rnd.choice([5, 5, 5, 9, None])) for _ in range(200)]
    rows += [(2, 7), (3, None), (4, -(2**63)), (4, 2**63 - 1), (None, 3), (None, 1)]
    by = defaultdict(list)
    for k, v in rows:
        by[k] += [v] if v is not None else []
    asked = {"first": F.lit(0), "mid": F.floor((F.col("n") - 1) / 2), "p95": F.bround(0.95 * (F.col("n") - 1)), "none": F.lit(None)}
    for buckets in (3, 7, 65_536):
        monkeypatch.setattr(ranks, "BUCKETS", buckets)
        got = {r["k"]: r for r in ranks.values_at(spark.createDataFrame(rows, "k int, v long"), "k", "v", asked).collect()}
        assert set(got) == {k for k in by if by[k]}
        for k, r in got.items():
            s = sorted(by[k])
            assert (r["first"], r["mid"], r["p95"], r["none"]) == (s[0], s[(len(s) - 1) // 2], s[round(0.95 * (len(s) - 1))], None)
    assert ranks.values_at(spark.createDataFrame([], "k int, v long"), "k", "v", asked).count() == 0


def test_a_rank_is_found_among_buckets_and_not_in_a_sort_of_all_values(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 1_000_003).alias("v"))
    found = ranks.values_at(rows, "k", "v", {"p": F.floor(F.col("n") / 3)})
    values = sorted(i * 7919 % 1_000_003 for i in range(200_000))
    assert found.first()["p"] == values[200_000 // 3]


def test_latencies_with_nulls_and_ties(spark):
    rows = [("a", "view", v) for v in (10, 20, 20, 40, None)] + [("b", "cart", None)]
    got = {r["run_id"]: r for r in metrics.provider_summary(spark.createDataFrame(rows, "run_id string, outcome string, latency_ms long")).collect()}
    assert (got["a"]["n_requests"], got["a"]["median_ms"], got["a"]["p95_ms"], got["a"]["mean_ms"]) == (5, 20.0, 40, 22.5)
    assert (got["b"]["n_requests"], got["b"]["median_ms"], got["b"]["p95_ms"]) == (1, None, None)


def test_running_sums_cross_cells(spark):
    rnd = random.Random(2)
    rows = [(k, p, rnd.randrange(5)) for k in (None, 1, 2) for p in rnd.sample(range(-50, 500), 120)]
    got = ranks.running_sums(spark.createDataFrame(rows, "k int, p long, a int"), ["k"], "p", {"s": F.col("a"), "n": F.lit(1)}, cell=16).collect()
    total = defaultdict(int)
    for n, r in enumerate(sorted((r for r in got if r["k"] == 1), key=lambda r: r["p"]), 1):
        total[1] += r["a"]
        assert (r["s"], r["n"]) == (total[1], n)
    assert sum(r["k"] is not None for r in got) == 240


def naive_plan(pages, budget, size):
    best = {}
    for d, p, s in pages:
        if p >= 1:
            best[d, p] = max(best.get((d, p), -1), 0.5 if s is None else s)
    out = {}
    for d in {d for d, _ in best}:
        own = sorted((p for q, p in best if q == d), key=lambda p: (-best[d, p], p))
        taken = sorted(own if not budget else own[: budget * size])
        for p in own:
            out[d, p] = (len(own), p in taken, taken.index(p) // size if p in taken else None)
    return out


def test_plans_match_sorting_each_document(spark, monkeypatch):
    rnd = random.Random(3)
    pages = [(d, rnd.randrange(-2, 9_000), rnd.choice([None, 0.0, 0.3, 0.5, 0.31, 1.0])) for d in ("a", "b") for _ in range(150)] + [("c", 1, 0.2)]
    rows = spark.createDataFrame(pages, "document_id string, page_number int, score double")
    for budget, size in ((None, 5), (3, 5), (1, 1), (7, 4), (1000, 5)):
        got = {(r["document_id"], r["page_number"]): (r["n_eligible"], r["planned"], r["batch_id"]) for r in planner.plan_pages(rows, budget, size).collect()}
        assert got == naive_plan(pages, budget, size)
    first = planner.plan_pages(rows, 2, 5, scored=False).filter("planned AND document_id = 'a'").collect()
    assert sorted(r["page_number"] for r in first) == sorted({p for d, p, _ in pages if d == "a" and p >= 1})[:10]


def test_signatures_of_many_runs(spark):
    rnd = random.Random(4)
    sets = [{f"s{rnd.randrange(30)}" for _ in range(25)} for _ in range(70)]
    rows = [(f"r{k:02}", s) for k, own in enumerate(sets) for s in own] + [("r00", "lonely"), ("r00", "lonely")]
    sets[0].add("lonely")
    found = metrics.signature_runs(spark.createDataFrame(rows, "document_id string, signature string"))
    got = {r["signature"]: r for r in found.collect()}
    assert set(got) == set().union(*sets) and got["lonely"]["only_run"] == "r00" and got["lonely"]["n_all"] == 70
    assert {s for s, r in got.items() if r["n_runs"] == r["n_all"]} == set.intersection(*sets)
    ones, others = [0, 1, 61, 62], [2, 63, 69]
    c = metrics.signature_consistency(found, ones, others).first()
    one, other = (set().union(*(sets[k] for k in ks)) for ks in (ones, others))
    common = set.intersection(*(sets[k] for k in ones + others))
    assert (c["n_union"], c["n_common"], c["n_only_one"], c["n_only_other"], c["n_inconsistent"]) == (len(one | other), len(common), len(one - other), len(other - one), len((one | other) - common))
    assert metrics.signature_runs(spark.createDataFrame([], "document_id string, signature string")).count() == 0

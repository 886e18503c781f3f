import random
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from concordat.functions import vocab as V
from concordat.operators import facts, relations
from concordat.sources import views

CLAIM = "pos long, fact_id string, document_id string, page_number int, entity string, metric string, value_raw string, value_numeric double, unit string, period_label string, scope string, geography string, epistemic_status string, data_vintage string, supporting_text string"


def claim(pos, value="₹100 crore", metric="Revenue", entity="Acme Limited", period="FY 2023-24", scope=None, geo=None, status="reported", vintage=None, text="It was so.", unit=None):
    return (pos, f"f{pos}", f"d{pos}", 1, entity, metric, value, None, unit, period, scope, geo, status, vintage, text)


def relate(spark, *claims):
    return {(r["a_pos"], r["b_pos"]): r for r in relations.relate(facts.normalize_facts(spark.createDataFrame(list(claims), CLAIM))).collect()}


def kind(spark, a=None, b=None):
    found = relate(spark, claim(1, **(a or {})), claim(2, **(b or {})))
    return found[1, 2]["relationship_type"] if found else None


def test_rules(spark):
    assert kind(spark) == "CORROBORATES"
    assert kind(spark, {"value": "₹123.45 million"}, {"value": "₹12.3 crore"}) == "CONTEXT_RESOLVES"
    assert kind(spark, {"value": "₹8,142 crore"}, {"value": "₹81,415.38 million"}) == "CONTEXT_RESOLVES"
    assert kind(spark, {}, {"value": "₹150 crore"}) == "CONTRADICTS"
    assert kind(spark, {"vintage": "First Advance Estimate"}, {"vintage": "Second Advance Estimate"}) == "EVOLVES_FROM"
    assert kind(spark, {"vintage": "flash"}, {"vintage": "final"}) == "UNRESOLVED"
    assert kind(spark, {"status": "target"}, {}) == "UNRESOLVED"
    assert kind(spark, {}, {"text": "as restated"}) == "SUPERSEDES"
    assert kind(spark, {"entity": "Acme"}, {"entity": " ACME  Ltd. "}) == "CORROBORATES"


def test_what_does_not_surface(spark):
    assert kind(spark, {}, {"period": "FY 2022-23"}) is None
    assert kind(spark, {}, {"period": "FY 2022-23", "text": "up from last year"}) == "UNRESOLVED"
    assert kind(spark, {"text": "it rose"}, {"period": "FY 2022-23", "text": "from 3 to 5"}) == "UNRESOLVED"
    assert kind(spark, {"text": "was 5 in 2001"}, {"period": "FY 2022-23", "text": "and 6 in 2002 it ended"}) == "UNRESOLVED"
    assert kind(spark, {"scope": "a"}, {"scope": "b"}) is None
    assert kind(spark, {"value": "5%"}, {}) is None
    assert kind(spark, {"metric": "Profit"}, {}) is None
    assert kind(spark, {"entity": ""}, {"entity": ""}) is None


def test_missing_context(spark):
    for a in ({"scope": "consolidated"}, {"geo": "India"}, {"period": "FY24"}, {"scope": " "}):
        found = relate(spark, claim(1, **a), claim(2))[1, 2]
        assert (found["relationship_type"], found["status"], found["confidence"]) == ("UNRESOLVED", "INSUFFICIENT_CONTEXT", 0.0)


def test_surfacing_inside_of_the_join_is_the_ladder(spark):
    rows = [claim(i, value=v, period=p, scope=s, text=t) for i, (v, p, s, t) in enumerate((v, p, s, t) for v in ("₹1 crore", "$5", "7 km") for p in ("FY 2023-24", "FY24", "2024") for s in (None, "x", "y") for t in ("plain", "was 3 in 2001 and", "it rose", "from 1 to 2"))]
    n = facts.normalize_facts(spark.createDataFrame(rows, CLAIM))
    pairs = facts.pair_up(n, exact_metric=True)
    key = lambda df: {(r["a_pos"], r["b_pos"]) for r in df.select("a_pos", "b_pos").collect()}
    full = key(relations.surface(relations.compare(pairs)).filter("should_surface"))
    assert full == key(pairs.filter(relations.surfaces())) and 0 < len(full) < pairs.count()


def test_pairs_by_period_are_all_that_surface(spark):
    texts = ("plain", "was 3 in 2001 and", "it rose", "from 1 to 2", "was 1 in 2001 and 2 in 2002", "grew in 2003 and fell in 2004", "compared to 2001", "in 2009 it was")
    rows = [claim(i, value=v, period=p, text=t) for i, (v, p, t) in enumerate((v, p, t) for v in ("₹1 crore", "5%") for p in ("FY 2023-24", "FY 2022-23", "FY24", "2024") for t in texts)]
    n = facts.normalize_facts(spark.createDataFrame(rows + rows[:3], CLAIM))
    order = (F.col("a_pos") < F.col("b_pos")) & (F.col("a_fact_id") != F.col("b_fact_id"))
    every = sorted((r["a_pos"], r["b_pos"]) for r in facts.pair_up(n, exact_metric=True).filter(relations.surfaces()).collect())
    assert sorted((r["a_pos"], r["b_pos"]) for r in facts.pairs_by_period(n, n, order, relations.surfaces()).collect()) == every


def test_candidates(spark):
    metrics = ["Revenue", "Revenue from operations", "Number of employees", "Employee count", "Gross margin growth rate", "Margin growth", "Unrelated"]
    n = facts.normalize_facts(spark.createDataFrame([claim(i, metric=m) for i, m in enumerate(metrics)], CLAIM))
    got = {(r["a_pos"], r["b_pos"]): r["candidate_score"] for r in facts.candidate_pairs(n).collect()}
    assert got == {(0, 1): 0.85, (2, 3): 0.8, (4, 5): 0.85}


def naive_kind(a, b, tokens, core):
    if a == b:
        return 1.0
    ta, tb, ca, cb = tokens[a], tokens[b], core[a], core[b]
    if not ta or not tb:
        return None
    n, union = len(ta & tb), len(ta | tb)
    if ta == tb:
        return 0.95
    if ta <= tb or tb <= ta:
        return 0.85
    if ca and cb and ca == cb:
        return 0.80
    if ca and cb and (ca <= cb or cb <= ca):
        return 0.75
    return float(round(Fraction(100 * (union + n), 2 * union))) / 100 if 2 * n >= union else None


def random_metrics(n, seed, words):
    rnd = random.Random(seed)
    pool = [f"word{k}" for k in range(words)] + ["growth", "total", "number", "of", "rate", "count", "amount"]
    return sorted({" ".join(rnd.sample(pool, rnd.randrange(1, 6))) for _ in range(n)} | {"of", "total", "rate growth"})


def sets_of(spark, metrics):
    rows = spark.createDataFrame([(m,) for m in metrics], "m string").select("m", facts.metric_tokens(F.col("m")).alias("t")).collect()
    tokens = {r["m"]: set(r["t"]) for r in rows}
    return tokens, {m: t - set(V.QUANTITY_WORDS) for m, t in tokens.items()}


def test_near_metrics_are_those_of_all_pairs(spark):
    metrics = random_metrics(160, 1, 12)
    tokens, core = sets_of(spark, metrics)
    rnd = random.Random(2)
    rows = [claim(i, metric=rnd.choice(metrics), entity=rnd.choice(["Acme", "Bolt"]), value=rnd.choice(["5%", "₹1 crore", "7 km"])) for i in range(400)]
    n = facts.normalize_facts(spark.createDataFrame(rows + rows[:5], CLAIM))
    money = {r["pos"]: r["unit_kind"] for r in n.collect()}
    want = {}
    for a in rows:
        for b in rows:
            kinds = {money[a[0]], money[b[0]]}
            if a[0] < b[0] and a[4] == b[4] and kinds != {"money", "percent"} and (score := naive_kind(a[5], b[5], tokens, core)):
                want[a[0], b[0]] = score
    got = facts.candidate_pairs(n.dropDuplicates(["pos"])).collect()
    assert len(got) == len(want) and {(r["a_pos"], r["b_pos"]): r["candidate_score"] for r in got} == want


def test_few_pairs_are_examined_beside_those_that_are_given(spark):
    metrics = random_metrics(1000, 3, 400)[:1000]
    tokens, core = sets_of(spark, metrics)
    rows = [claim(i, metric=metrics[i % len(metrics)]) for i in range(10_000)]
    terms = facts.metric_terms(facts.normalize_facts(spark.createDataFrame(rows, CLAIM)))
    near = {(r["a_mkey"], r["b_mkey"]) for r in facts.near_metrics(terms).collect()}
    assert near == {(a, b) for a in metrics for b in metrics if a < b and naive_kind(a, b, tokens, core)}
    held = Counter(r[5] for r in rows)
    given = sum(held[a] * held[b] for a, b in near) + sum(n * (n - 1) // 2 for n in held.values())
    examined = sum(held[a] * held[b] for a, b in near) + sum(n * n for n in held.values()) + facts.metric_candidates(terms).count()
    assert given < examined < 2.2 * given < 10_000 * 9_999 / 40


def test_relation_is_an_equi_join(spark):
    n = facts.normalize_facts(spark.createDataFrame([claim(1)], CLAIM))
    plan = relations.relate(n)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert relations.relate(n.limit(0)).count() == 0
    assert relations.relate(n.withColumn("value_raw", F.lit(None).cast("string"))).count() == 0


def test_pairs_are_made_of_a_table_of_what_they_carry(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(relations, "written", lambda df: kept.append((df.columns, spark.conf.get("spark.sql.codegen.hugeMethodLimit"))) or df)
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    relations.relate(facts.normalize_facts(views.claims(spark, "/root/testdata/sf0.001")))
    assert kept == [(list(facts.CARRIED), "8000")]
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before


def test_counts_are_those_of_the_listed_relations(spark):
    rnd = random.Random(4)
    texts = ("as restated", "up from last year", "it rose", "from 3 to 5", "was 5 in 2001", "and 6 in 2002 it ended", "  was it superseding ", None)

    def pick(usual, *others, share=0.25):
        return rnd.choice(others) if rnd.random() < share else usual

    rows = []
    for i in range(300):
        c = claim(
            pick(i, 7, 8, None, share=0.05), pick("₹1 crore", "₹10.04 million", "5%", "$5", "many", "12 km", share=0.5), pick("Revenue", "revenue ", "Profit", ""),
            pick("Acme Limited", "Acme", "Zeta", ""), pick("FY 2023-24", "2024", "FY24", None), pick(None, "x", "y", " "), pick(None, "India", share=0.1), pick("reported", "target"),
            pick(None, "Flash", "Provisional Actuals", "First Advance Estimate"), pick("It was so.", *texts),
        )
        rows.append((c[0], pick(c[1], "f1", "f2", None, share=0.05), *c[2:]))
    table = spark.createDataFrame(rows + rows[:9], CLAIM).repartition(5)  # some rows twice
    listed = Counter((r["relationship_type"], r["confidence"]) for r in relations.relate(facts.normalize_facts(table)).collect())
    counted = relations.relation_counts(table)
    assert len(listed) >= 6 and counted.dtypes == [("relationship_type", "string"), ("confidence", "double"), ("n", "bigint")]
    assert {(r["relationship_type"], r["confidence"]): r["n"] for r in counted.collect()} == dict(listed)


def test_copies_of_facts_are_counted_and_not_paired_one_by_one(spark):
    """6,000 facts of one entity and metric make 18 million pairs, which come of a few cells."""
    rows = [claim(i, value="₹1 crore" if i % 2 else "₹2 crore", period="FY24" if i % 3 == 0 else "FY 2023-24") for i in range(6000)]
    found = {(r["relationship_type"], r["confidence"]): r["n"] for r in relations.relation_counts(spark.createDataFrame(rows, CLAIM)).collect()}
    same, pairs = 2 * (2000 * 1999 // 2), 4000 * 3999 // 2
    assert found == {("CORROBORATES", 1.0): same, ("CONTRADICTS", 0.95): pairs - same, ("UNRESOLVED", 0.0): 6000 * 5999 // 2 - pairs}

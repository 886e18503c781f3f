import re
from collections import Counter
from math import comb

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concordat.llm import quality_rules as R

DOCS = "doc_id long, text string, lang string, source string, n_words string, kept string"
LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), base)


TEXTS = [
    None, "", " \n\t ", "a", "a b c d e", "a b c d e a b c d e", "x " * 40, "one\ntwo\none\n\n\none", "\x0bq\x0c w\r\n" * 6, "é é é é é é",
    "# * $ % & | < > plain words here and more of them to pass ten", "\u00a0kept together\u2028as one", "line \nline\nline ", "w" * 50_000, ("lorem ipsum dolor sit amet " * 3000),
    " ".join(f"w{i}" for i in range(30)) + " again: w1 w2 w3 w4 w5 end",
]


def measures(spark, texts):
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en", "s", "clash", "clash") for i, t in enumerate(texts)], DOCS)
    rows = R.measured(docs, "doc_id").orderBy("doc_id").collect()
    return [tuple(r[c] for c in (*R.MEASURES, "base_failed")) for r in rows]


def test_measures_match_brute_force(spark):
    assert measures(spark, TEXTS) == [brute(t) for t in TEXTS]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t#é\r", max_size=60), min_size=20, max_size=40))
def test_measures_of_random_texts(spark, texts):
    assert measures(spark, texts) == [brute(t) for t in texts]


def test_binomial_tail_is_exact(spark):
    cases = [(1, 0, 0.5), (10, 3, 0.4), (400, 3, 0.0125), (2000, 0, 0.0125), (5000, 40, 0.0125), (50, 9, 0.1)]
    row = spark.range(1).select(*(R.binomial_tail(F.lit(n), F.lit(k), p).alias(f"c{i}") for i, (n, k, p) in enumerate(cases))).first()
    for got, (n, k, p) in zip(row, cases):
        want = 1.0 if k > n * p else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-9)


def corpus(spark, n_good=900, n_bad=100, noisy=0):
    good = [" ".join(f"word{i}x{j}" for j in range(20)) for i in range(n_good)]
    bad = [" ".join(f"word{i}x{j}$$$" for j in range(20)) for i in range(n_bad)]
    docs = [(i, t, "en", "s", "", "") for i, t in enumerate(good + bad)]
    labels = [(i, 1 if i < n_good or i - n_good < noisy else 0, 0) for i in range(len(docs))]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def kept_ids(frame):
    return {r["doc_id"] for r in frame.filter("kept").collect()}


def test_certified_cutoff_rejects_what_is_bad_only(spark):
    docs, labels = corpus(spark)
    assert kept_ids(R.apply_quality_rules(docs, labels)) == set(range(900))


def test_no_cutoff_without_enough_labels_or_with_too_many_false_rejections(spark):
    docs, labels = corpus(spark, 50, 40)
    assert len(kept_ids(R.apply_quality_rules(docs, labels))) == 90
    docs, labels = corpus(spark, 900, 100, noisy=45)  # good documents that look bad
    assert len(kept_ids(R.apply_quality_rules(docs, labels))) == 1000


def test_repeats_are_no_trials_of_their_own(spark):
    docs, labels = corpus(spark, 50, 100)  # 50 good documents are too few to certify anything
    again = docs
    for k in range(1, 6):  # rows repeated, and texts repeated under ids that are labelled as well
        again = again.unionByName(docs).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000 * k))
    marks = labels
    for k in range(1, 6):
        marks = marks.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 10_000 * k))
    assert R.apply_quality_rules(again, marks).filter("NOT kept").count() == 0
    marked = R.certified_cutoffs(R.measured(again, "doc_id"), marks, 0.99, 0.5).collect()
    assert len(marked) == 1  # the same rows are enough for a lax bound


def test_no_stratum_loses_more_good_documents_than_stated(spark):
    """Ratios of good documents are uniform, so that what a cutoff rejects in truth is known."""
    n_strata, n_good, n_bad = 40, 4000, 300
    rare = 0.02  # of good documents have a ratio above zero
    draw = lambda seed, top: F.when(F.rand(seed) < rare, F.rand(seed + 50) * top).otherwise(0.0)
    rows = spark.range(n_strata * (n_good + n_bad)).select(
        F.col("id").alias("doc_id"),
        F.md5(F.col("id").cast("string").cast("binary")).alias("text_key"),
        (F.col("id") % n_strata).cast("string").alias("stratum"),
        F.lit(False).alias("base_failed"),
        (F.floor(F.col("id") / n_strata) < n_good).cast("int").alias("quality"),
        *(F.when(F.floor(F.col("id") / n_strata) < n_good, draw(11 * i, cuts[0] * 1.02)).otherwise(F.rand(500 + i) * cuts[0]).alias(r) for i, (r, cuts) in enumerate(R.RULES.items())),
    )
    chosen = R.certified_cutoffs(rows, rows.select("doc_id", "quality"), R.ALPHA, R.DELTA).collect()
    assert len(chosen) == n_strata
    for c in chosen:
        lost = [max(0.0, rare * (1 - c[f"cut_{r}"] / (cuts[0] * 1.02))) for r, cuts in R.RULES.items() if c[f"cut_{r}"] is not None]
        kept = 1.0
        for x in lost:
            kept *= 1 - x
        assert 1 - kept <= R.ALPHA
    assert all(c["cut_symbol_ratio"] < 0.5 for c in chosen)  # no bad ratio is above the laxest cutoff: stricter ones do get certified


def test_strata_are_certified_one_by_one(spark):
    docs, labels = corpus(spark)
    other = docs.withColumns({"doc_id": F.col("doc_id") + 5000, "lang": F.lit(None).cast("string")})
    kept = kept_ids(R.apply_quality_rules(docs.unionByName(other), labels))
    assert {i for i in kept if i < 5000} == set(range(900)) and len([i for i in kept if i >= 5000]) == 1000


def test_empty_tables_and_odd_labels(spark):
    docs, labels = corpus(spark, 30, 5)
    assert R.apply_quality_rules(docs.limit(0), labels).count() == 0
    assert len(kept_ids(R.apply_quality_rules(docs, labels.limit(0)))) == 35
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 0, 0), (1, 1, 0), (99, 0, 0)], LABELS)
    assert R.apply_quality_rules(docs, odd).count() == 35


def test_keep_good_returns_whole_rows_and_repeats(spark):
    docs, labels = corpus(spark)
    twice = docs.unionByName(docs.filter("doc_id = 3"))
    kept = R.keep_good(twice, labels)
    assert kept.columns == docs.columns and kept.count() == 901
    assert kept.filter("doc_id = 3").select("kept").distinct().first()[0] == ""


def test_main_path_has_no_python(spark):
    docs, labels = corpus(spark, 30, 5)
    plan = R.apply_quality_rules(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def mixed(n_good=150, n_bad=60):
    """Documents of four strata whose ratios differ by document, a few good ones among those that look bad."""
    rows, labels = [], []
    for s, lang in enumerate(("en", "de", "fr", None)):
        for i in range(n_good + n_bad):
            odd = i >= n_good or i % (17 + 20 * s) == 0  # of good documents up to one in 17
            words = [f"w{i}x{j}" for j in range(24)]
            if odd and i % 3 == 0:
                words = [w + "$" * (i % 5) for w in words]
            if odd and i % 3 == 1:
                words = [w.upper() if j < 4 * (i % 7) else w for j, w in enumerate(words)]
            text = " ".join(words)
            if odd and i % 3 == 2:
                text += "\nsame" * (1 + i % 4) + "!" * (i % 30)
            rows.append((len(rows), text, lang, "s", "", ""))
            labels.append((len(labels), int(i < n_good), 0))
    return rows, labels


def brute_steps(features, good):
    """The chosen step by stratum, as the docstring states it."""
    strata = {}
    for r in features:
        if not r["base_failed"]:
            first = next((i + 1 for i, (rule, c) in enumerate(R.STEPS) if r[rule] > c), len(R.STEPS) + 1)
            strata.setdefault(r["stratum"], []).append((first, good[r["doc_id"]]))
    chosen = {}
    for s, trials in strata.items():
        n, best = sum(g for _, g in trials), 0
        for step in range(1, len(R.STEPS) + 1):
            k = sum(g for f, g in trials if f <= step)
            if sum(comb(n, i) * R.ALPHA**i * (1 - R.ALPHA) ** (n - i) for i in range(k + 1)) > R.DELTA / len(strata):
                break
            surplus = sum(not g for f, g in trials if f <= step) - k
            if surplus > best:
                best, chosen[s] = surplus, step
    return chosen


def test_joint_cutoffs_match_brute_force_and_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from concordat.llm import oracle, queries

    rows, labels = mixed()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    features = R.measured(docs, "doc_id").collect()
    chosen = brute_steps(features, {i: g for i, g, _ in labels})
    assert len(chosen) >= 2 and len(set(chosen.values())) >= 2
    cuts = {r["stratum"]: r for r in R.certified_cutoffs(R.measured(docs, "doc_id"), marks, R.ALPHA, R.DELTA).collect()}
    assert set(cuts) == set(chosen)
    for s, step in chosen.items():
        for rule in R.RULES:
            reached = [c for r, c in R.STEPS[:step] if r == rule]
            assert cuts[s][f"cut_{rule}"] == (reached[-1] if reached else None)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {d: k for d, k in con.execute(f"SELECT doc_id, kept FROM ({oracle.oracle_sql()['op1_quality_rules']})").fetchall()}
    got = {r["doc_id"]: r["kept"] for r in queries.queries()["op1_quality_rules"](spark, str(tmp_path)).collect()}
    assert got == want and not all(got.values())
    lost = Counter(rows[d][2] for d, k in got.items() if not k and labels[d][1])
    assert max(lost.values(), default=0) <= R.ALPHA * 150

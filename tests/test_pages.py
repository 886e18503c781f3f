import pytest
from pyspark.sql import functions as F

from concordat.functions import text as T
from concordat.functions import vocab as V
from concordat.functions.text import lines
from concordat.operators import context, extract, pages, planner
from concordat.plans import registry

PAGE = "document_id string, page_number int, text string"


def frame(spark, *texts):
    return pages.with_metadata(spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], PAGE))


def scores(spark, *texts):
    return [r["score"] for r in pages.score_pages(frame(spark, *texts)).orderBy("page_number").collect()]


def test_lines_are_those_of_splitlines(spark):
    texts = ["a\nb\n", "a\r\nb\rc", "", "\n", "a\x0bb\x0cc\x1cd\x85e f ", "x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(lines(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in got] == [t.splitlines() for t in texts]


def test_scores(spark):
    table = "Revenue 2022 2023\nA 10 20 x\nB 30 40 y\nC 50 60 z"
    got = scores(spark, "Revenue was ₹500 crore in FY24, up 12%", table, "   ", None, "Table of contents 1", "plain prose")
    assert got[0] >= 0.6 and got[1] >= 0.45 and got[2:] == [0.0, 0.0, 0.0, 0.0]


def test_neighbour_context(spark):
    rows = pages.score_pages(frame(spark, "revenue", "12 and 15", "nothing")).orderBy("page_number").collect()
    assert rows[1]["breakdown"] == pytest.approx({"numeric_density": 0.1, "table_structure": 0.05, "neighbor_context": 0.05})


def test_windows(spark):
    text = "Title\n" + "\n".join("prose" for _ in range(9)) + "\nRevenue 12%\n" + "\n".join("more" for _ in range(4)) + "\nsales 15%\n" + "\n".join("end" for _ in range(20)) + "\ngrowth 7%"
    got = [(r["start_line"], r["end_line"]) for r in context.context_windows(frame(spark, text)).orderBy("start_line").collect()]
    assert got == [(8, 17), (34, 36)]
    top = context.context_windows(frame(spark, "a\nb\nc\nd\nprofit 5%\ne")).first()
    assert (top["start_line"], top["end_line"]) == (0, 5)
    empty = context.page_context(frame(spark, "prose only", "", None)).collect()
    assert all(r["is_empty"] and r["selected_chars"] == 0 for r in empty)


def plan(spark, n, budget, size, scored=None):
    rows = [("d", i + 1, None if scored is None else float(scored.get(i + 1, 0.5))) for i in range(n)]
    df = spark.createDataFrame(rows + rows[:1] + [("d", 0, 0.1)], "document_id string, page_number int, score double")
    return planner.plan_pages(df, budget, size, scored is not None)


def test_plan(spark):
    full = planner.plan_summary(plan(spark, 184, None, 5), None, 5).first()
    assert (full["estimated_requests"], full["can_complete"], full["n_planned"], full["remaining_budget"]) == (37, True, 184, None)
    short = plan(spark, 10, 2, 3, {9: 0.9, 10: 0.8, 1: 0.1, 2: 0.1, 3: 0.1, 4: 0.1}).filter("planned").orderBy("page_number").collect()
    assert [(r["page_number"], r["batch_id"]) for r in short] == [(5, 0), (6, 0), (7, 0), (8, 1), (9, 1), (10, 1)]
    assert [r["page_number"] for r in plan(spark, 10, 1, 3).filter("planned").orderBy("page_number").collect()] == [1, 2, 3]


def test_grounding(spark):
    cases = [("a b", "x a b y", True), ("a  b", "x a\nb y", True), ("a c", "a b", False), (" ", "a", False), (None, "a", False), ("a", None, False), ("a b", "a b", True)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").orderBy("i")
    assert [r[0] for r in df.select(extract.grounded(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_rule_claims(spark):
    rows = extract.rule_claims(frame(spark, "Revenue grew to ₹8,142 crore in FY24, at least 500 customers, 12%, 12,345\nno numbers\nab")).orderBy("value_no").collect()
    assert [r["value_raw"] for r in rows] == ["₹8,142 crore", "rs,", "12%", "at least500 customers", "12,345"]
    assert {(r["metric"], r["period_label"], r["epistemic_status"]) for r in rows} == {("Revenue from Operations", "FY24", "reported")}


def test_status(spark):
    rows = [(d, i + 1, None) for d in "abcd" for i in range(4)]
    p = planner.plan_pages(spark.createDataFrame(rows, "document_id string, page_number int, score double"), None, 2)
    outcomes = [("a", 0, "ok"), ("a", 1, "ok"), ("b", 0, "ok"), ("b", 1, "quota"), ("c", 0, "quota"), ("c", 1, "ok"), ("d", 0, "error"), ("d", 1, "quota")]
    got = extract.extraction_status(spark.createDataFrame(outcomes, "document_id string, batch_id int, outcome string"), p)
    assert {r["document_id"]: (r["status"], r["n_processed"]) for r in got.collect()} == {"a": ("COMPLETE", 4), "b": ("PARTIAL_QUOTA", 2), "c": ("QUOTA_EXHAUSTED", 0), "d": ("FAILED", 0)}
    assert extract.overall_status(got).first()["status"] == "FAILED"
    assert extract.overall_status(got.filter("document_id < 'c'")).first()["status"] == "PARTIAL_QUOTA"


def test_gates_pass_every_text_that_a_pattern_matches(spark):
    """Matches with white space and letters around them that RE2 takes otherwise than Java."""
    told = [
        "5 tons", "tonne", "12%", "sq.ft.é", "sq\x0bft", "é km", "pin\x0bcodes", "ékm", "squåre feet", "basis points", "BPS",
        "cash\x0bflow", "Advance  Estimates", "ratés rate", "pat", "paté", "gdpé", "_loss", "operating\tleverage",
        "FY\x0b24", "Q1 é", "q3", "2024-25", "May 1,\x0b2024", "éFY24", "all\x0brights reserved", "Forward-Looking Statements", "directoryé",
        "₹5", "rs. 5", "RS", "hours", "Inr", "iNR.", "us$", "Usd", "eUR", "gbp", "$", "crores", "millionth trillion", "Lakh rs", "inrs", "5 6\n7 8 x", "", "  \x0b", "plain",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*told, None])], "i int, text string")
    own = {"currencies": (V.CURRENCY, False), "units": (V.PAGE_UNIT, True), "metrics": (V.PAGE_METRIC, True), "temporals": (V.PAGE_TIME, False), "boilerplates": (V.BOILERPLATE, True)}
    text = F.coalesce("text", F.lit(""))
    read = pages.page_signals(frame).select("*", *(T.distinct(T.found(text, p), lower=low).alias(f"all_{k}") for k, (p, low) in own.items()), F.size(T.numbers(text)).alias("all_numbers"))
    for r in read.collect():
        assert r.n_numbers == r.all_numbers
        for k in own:
            assert r[k] == r[f"all_{k}"], (r.text, k)
    assert {r.i for r in pages.with_metadata(frame).filter("has_text").collect()} == {i for i, t in enumerate(told) if t.strip()}


def test_contexts_are_read_of_planned_pages_only(spark):
    plan = registry.batch_prompt(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan


def test_eligible_pages_are_found_before_they_are_numbered(spark, monkeypatch):
    """Numbers are joined to pages that are selected, and not to texts."""
    monkeypatch.setattr(registry.views, "pages", None)
    assert registry.eligible_pages(spark, "/root/testdata/sf0.001").count() == 15

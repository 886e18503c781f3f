import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concordat.engine import Config, Engine
from concordat.operators import extract, planner
from concordat.operators.journal import Journal
from concordat.shared import durable
from concordat.sources import documents
from concordat.sources.store import Store
from concordat.streaming import arrivals

REPORTS = {
    "annual.txt": "Acme annual report\nRevenue was ₹12.3 crore in 2023-24 for the group\fOutlook\nRevenue is projected at ₹20 crore in 2024-25",
    "deck.txt": "Acme results\r\nRevenue was ₹123.45 million in 2023-24\fnothing here",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in REPORTS.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "odd.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "none.txt").write_bytes(b"")
    return tmp_path


def test_parse(spark, folder):
    rows = Engine(spark).parse(f"{folder}/*.txt").orderBy("document_name", "page_number").collect()
    assert [(r["document_name"], r["page_number"]) for r in rows] == [("annual.txt", 1), ("annual.txt", 2), ("deck.txt", 1), ("deck.txt", 2), ("none.txt", None), ("odd.txt", None)]
    assert "\r" not in rows[2]["text"] and rows[5]["error"].startswith("UnicodeDecodeError") and rows[0]["has_text"]
    assert rows[4]["error"] == "ValueError: the document is empty"


def test_only_empty_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"")
    for path in (tmp_path, f"{tmp_path}/*.txt", f"{tmp_path}/a.txt"):
        assert [(r["document_name"], r["error"]) for r in Engine(spark).parse(str(path)).collect()] == [("a.txt", "ValueError: the document is empty")]


def test_analyze_store_and_load(spark, folder, tmp_path):
    engine = Engine(spark, store=Store(spark, f"{tmp_path}/store"))
    pages = engine.parse(f"{folder}/*.txt").filter("error IS NULL")
    done = engine.analyze(pages)
    kinds = [r["relationship_type"] for r in done["relationships"].collect()]
    assert "CONTEXT_RESOLVES" in kinds
    analysis_id = done["summary"].first()["analysis_id"]
    again = engine.load(analysis_id)
    assert again["relationships"].count() == len(kinds) and again["documents"].count() == 2
    n_facts = again["facts"].count()
    assert n_facts == done["facts"].select("fact_id").distinct().count()
    assert engine.load("unknown") is None
    engine.analyze(pages)  # the same documents again: replaced and not doubled
    again = engine.load(analysis_id)
    assert again["facts"].count() == n_facts
    assert again["relationships"].count() == 0  # they point to facts that have been replaced


def test_a_failed_save_leaves_the_store_as_it_was(spark, folder, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    engine = Engine(spark, store=store)
    pages = engine.parse(f"{folder}/*.txt")
    done = engine.analyze(pages)
    assert sorted(r["error"][:12] for r in done["errors"].collect()) == ["UnicodeDecod", "ValueError: "] and done["status"].first()["status"] == "COMPLETE"
    first = done["summary"].first()["analysis_id"]
    before = {k: v.count() for k, v in engine.load(first).items()}
    broken = done["relationships"].withColumn("explanation", F.raise_error(F.lit("disk full")).cast("string"))
    with pytest.raises(Exception, match="disk full"):
        store.save("second", done["documents"], done["facts"], broken)
    assert engine.load("second") is None and {k: v.count() for k, v in engine.load(first).items()} == before
    assert Store(spark, f"{tmp_path}/nothing").load("x") is None


def test_a_model_is_asked_once_for_a_batch(spark, folder, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def caller(prompt: str) -> str:
        import random
        import uuid

        (asked / uuid.uuid4().hex).write_text(prompt)
        fact = {"page_number": 1, "entity": "Acme", "metric": "Revenue", "value_raw": f"{random.random()} crore", "supporting_text": "Revenue was ₹12", "time_period": {"label": "2023-24"}}
        return json.dumps({"facts": [fact, fact | {"supporting_text": "made up"}]})

    engine = Engine(spark, Config(batch_size=5, by_relevance=False), caller=caller, store=Store(spark, f"{tmp_path}/store"))
    done = engine.analyze(engine.parse(f"{folder}/*.txt").filter("error IS NULL"))
    stored = engine.load(done["summary"].first()["analysis_id"])
    value = lambda df: sorted(r["value_raw"] for r in df.collect())
    assert value(stored["facts"]) == value(done["facts"]) == value(done["facts"]) and len(value(done["facts"])) == 2
    assert stored["relationships"].count() == done["relationships"].count() == 1
    assert {r["reject_reason"]: r["n"] for r in done["rejected"].groupBy("reject_reason").agg(F.sum("n").alias("n")).collect()} == {"not_grounded": 2}
    assert len(list(asked.iterdir())) == 2


def test_extraction_stops_at_the_first_failure(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def caller(prompt: str) -> str:
        from concordat.operators.extract import QuotaExhausted

        page = prompt.split("Pages in this batch: ")[1].split("\n")[0]
        doc = prompt.split("Document: ")[1].split("\n")[0]
        (asked / f"{doc}-{page}").write_text("")
        if (doc, page) == ("a", "2"):
            raise QuotaExhausted("no more")
        if (doc, page) == ("b", "1"):
            raise RuntimeError("broken")
        return json.dumps({"facts": []})

    rows = [(d, p, f"Revenue was ₹{p} crore in 2023-24") for d in "abc" for p in (1, 2, 3, 4)]
    pages = documents.with_metadata(spark.createDataFrame(rows, "document_id string, page_number int, text string"))
    done = Engine(spark, Config(batch_size=1, by_relevance=False, stop_at_quota=False), caller=caller).analyze(pages)
    status = {r["document_id"]: (r["status"], r["n_processed"], r["requests_used"]) for r in done["statuses"].collect()}
    assert status == {"a": ("PARTIAL_QUOTA", 1, 1), "b": ("FAILED", 0, 0), "c": ("COMPLETE", 4, 4)}
    assert {p.name for p in asked.iterdir()} == {"a-1", "a-2", "b-1", "c-1", "c-2", "c-3", "c-4"}
    outcomes = {(r["document_id"], r["batch_id"]): r["outcome"] for r in done["batches"].collect()}
    assert [outcomes["a", k] for k in range(4)] == ["ok", "quota", "skipped", "skipped"] and done["status"].first()["status"] == "FAILED"


def test_no_answer_is_asked_for_twice(spark, tmp_path):
    asked, fail = tmp_path / "asked", tmp_path / "fail"
    asked.mkdir()
    fail.write_text("")

    def caller(prompt: str) -> str:
        import os
        import uuid

        doc = prompt.split("Document: ")[1].split("\n")[0]
        page = prompt.split("Pages in this batch: ")[1].split("\n")[0]
        (asked / f"{doc}-{page}-{uuid.uuid4().hex}").write_text("")
        if (doc, page) == ("a", "3") and fail.exists():
            fail.unlink()
            os._exit(1)  # the worker dies half-way, and its task is run again
        return json.dumps({"facts": [{"page_number": int(page)}]})

    rows = [(d, p, f"Revenue was ₹{p} crore in 2023-24") for d in "ab" for p in (1, 2, 3, 4)]
    pages = documents.with_metadata(spark.createDataFrame(rows, "document_id string, page_number int, text string"))
    prompts = durable(planner.batch_prompts(planner.plan_pages(pages, size=1), pages.withColumn("prompt_text", F.col("text"))))
    journal = Journal(f"{tmp_path}/journal")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)

    def once(run):
        try:
            return extract.call_model(prompts, caller, 1, journal=run).collect()
        except Exception:  # noqa: BLE001  a local session does not run tasks again
            return extract.call_model(prompts, caller, 1, journal=run).collect()

    try:
        first = once(journal)
        again = once(Journal(f"{tmp_path}/journal"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["outcome"] for r in first} == {"ok"} and sorted(map(tuple, first)) == sorted(map(tuple, again))
    calls = Counter("-".join(p.name.split("-")[:2]) for p in asked.iterdir())
    assert calls == {f"{d}-{p}": 1 + ((d, p) == ("a", 3)) for d in "ab" for p in (1, 2, 3, 4)}


def test_no_call_is_made_after_the_end_of_a_quota(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def caller(prompt: str) -> str:
        import uuid

        from concordat.operators.extract import QuotaExhausted

        (asked / uuid.uuid4().hex).write_text("")
        raise QuotaExhausted("no more")

    rows = [(f"d{k:02}", 1, "Revenue was ₹1 crore in 2023-24") for k in range(40)]
    pages = documents.with_metadata(spark.createDataFrame(rows, "document_id string, page_number int, text string"))
    done = Engine(spark, Config(by_relevance=False, journal=f"{tmp_path}/journal", budget=9), caller=caller).analyze(pages)
    told = done["statuses"].collect()
    assert {r["status"] for r in told} == {"QUOTA_EXHAUSTED"} and len(told) == 40 and 1 <= len(list(asked.iterdir())) <= 2  # one for a partition at most
    r = told[0]
    assert (r["requests_available"], r["facts_extracted"], r["facts_rejected_grounding"], r["error_message"]) == (9, 0, 0, "QuotaExhausted: no more") and "quota limit" in r["user_message"]


def test_which_files_are_refused(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="no files"):
        Engine(spark).parse(f"{tmp_path}/nothing/*.txt")
    with pytest.raises(ValueError, match="of no kind"):
        Engine(spark, kinds=(".pdf",)).parse(f"{folder}/annual.txt")
    assert Engine(spark, kinds=(".txt", ".pdf")).parse(f"{folder}/annual.txt").count() == 2


def test_extraction_by_a_model(spark, folder):
    def caller(prompt: str) -> str:
        if "Outlook" in prompt:
            raise RuntimeError("no capacity")
        fact = {"page_number": 1, "entity": "Acme", "metric": "Revenue", "value_raw": "₹12.3 crore", "supporting_text": "Revenue was ₹12.3 crore", "time_period": {"label": "2023-24"}, "extraction_confidence": 3}
        return json.dumps({"facts": [fact, fact | {"supporting_text": "made up"}, fact | {"entity": ""}, fact | {"page_number": 9}]})

    engine = Engine(spark, Config(batch_size=1, by_relevance=False), caller=caller)
    pages = engine.parse(f"{folder}/annual.txt")
    claims = engine.extract(pages).collect()
    assert [(r["entity"], r["extraction_confidence"], r["epistemic_status"]) for r in claims] == [("Acme", 1.0, "reported")]


def test_config(monkeypatch):
    monkeypatch.setenv("CONCORDAT_BATCH_SIZE", "7")
    c = Config.from_env(workers=9)
    assert (c.batch_size, c.budget, c.workers) == (7, None, 2)
    monkeypatch.setenv("CONCORDAT_BUDGET", "many")
    with pytest.raises(ValueError, match="CONCORDAT_BUDGET must be an integer, got 'many'"):
        Config.from_env()
    assert Config.from_env(budget=3).budget == 3  # an argument comes first
    for wrong in ({"batch_size": 0}, {"budget": 0}, {"radius": -1}):
        with pytest.raises(ValueError):
            Config(**wrong)


def test_cases_and_samples(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"id": 1, "page": 2}, {"id": 2, "page": 1}]}))
    assert documents.read_cases(spark, f"{tmp_path}/cases.json").count() == 2
    pages = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y")], "document_id string, page_number int, text string")
    assert documents.sample_pages(pages, [(0, "d", 2), (1, "e", 1)]).select("batch_id", "text").collect() == [(0, "y")]
    documents.write_json(pages, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_stream(spark, tmp_path):
    claim = "pos long, fact_id string, document_id string, page_number int, entity string, metric string, value_raw string, value_numeric double, unit string, period_label string, scope string, geography string, epistemic_status string, data_vintage string, supporting_text string, arrived timestamp"
    row = lambda i, v: (i, f"f{i}", "d", 1, "Acme", "Revenue", v, None, None, "FY 2023-24", None, None, "reported", None, "t", None)
    put = lambda rows: spark.createDataFrame(rows, claim).withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([row(1, "₹5 crore"), row(1, "₹5 crore")])
    schema = spark.read.parquet(f"{tmp_path}/in").schema

    def once():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        arrivals.run(stream, f"{tmp_path}/facts", f"{tmp_path}/relations", f"{tmp_path}/check").awaitTermination(60)

    once()
    put([row(1, "₹5 crore"), row(2, "₹50 million"), row(3, "₹9 crore")])
    once()
    assert spark.read.parquet(f"{tmp_path}/facts").count() == 3
    got = {(r["a_fact_id"], r["b_fact_id"]): r["relationship_type"] for r in spark.read.parquet(f"{tmp_path}/relations").collect()}
    assert got == {("f1", "f2"): "CORROBORATES", ("f1", "f3"): "CONTRADICTS", ("f2", "f3"): "CONTRADICTS"}


def test_facts_that_arrive_together_are_related(spark):
    claim = "pos long, fact_id string, document_id string, page_number int, entity string, metric string, value_raw string, value_numeric double, unit string, period_label string, scope string, geography string, epistemic_status string, data_vintage string, supporting_text string"
    row = lambda pos, i, v: (pos, f"f{i}", "d", 1, "Acme", "Revenue", v, None, None, "FY 2023-24", None, None, "reported", None, "t")
    facts = arrivals.normalize_facts(spark.createDataFrame([row(1, 2, "₹50 million"), row(1, 3, "₹9 crore"), row(None, 4, "₹5 crore")], claim))
    got = {(r["a_fact_id"], r["b_fact_id"]): r["relationship_type"] for r in arrivals.relate_batch(facts, facts.limit(0)).collect()}
    assert got == {("f2", "f3"): "CONTRADICTS", ("f4", "f2"): "CORROBORATES", ("f4", "f3"): "CONTRADICTS"}

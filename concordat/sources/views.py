"""Tables and the views over them that stand in for pages, claims and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.extract import fact_id
from ..operators.pages import with_metadata
from ..shared import sound, spread

#: Report -> (suffix of entity names, epistemic status); they are numbered in this order.
REPORTS = ("annual-report", "presentation", "press-note")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, page_number, doc_id, text, char_count, has_text: each document is a page of its source.

    ``page_number`` is the document's own id, which orders pages as well; ``numbered`` gives the number from 1
    on. What is read off a text is read before that, so that texts are in no shuffle.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document_id"), "text"))
    return with_metadata(docs.select("document_id", F.col("doc_id").alias("page_number"), "doc_id", "text"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of_doc and number: the page number, from 1 on, of each document in its source."""
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").select(F.col("doc_id").alias("of_doc"), number.alias("number"))


def numbered(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read off ``unnumbered`` pages with their page numbers from 1 on."""
    found = rows.join(numbers(spark, sf_dir), F.col("page_number") == F.col("of_doc"))
    return found.select(*(F.col("number").alias(c) if c == "page_number" else F.col(c) for c in rows.columns))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pages with their texts: document_id, page_number, doc_id, text, char_count, has_text."""
    return numbered(unnumbered(spark, sf_dir), spark, sf_dir)


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and text of web pages, scripts, styles and tags removed."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)</(?:p|div|h[1-6]|li|tr|title)>|<br/?>", "\n\n"), r"<[^>]*>", "")
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"))


def claims(spark: SparkSession, sf_dir: str, by: str = "nation") -> DataFrame:
    """Claims of three reports about each nation's (or customer's) orders in each year.

    The annual report gives crores, the presentation millions of the same sum, and the press note
    repeats the presentation. The key modulo five decides what is off: nothing, a fifth more in the
    presentation, a scope on one side only, two vintages, or a target. Order volumes, growth in percent
    and bare fiscal years exercise the other rules.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    if by == "nation":
        nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
        joined = joined.join(nations, joined["c_nationkey"] == nations["k"])
    else:
        joined = joined.withColumns({"k": F.col("c_custkey"), "name": F.col("c_name")})
    sums = joined.groupBy("k", "name", "y").agg(F.sum("cents").alias("c"), F.count("*").alias("n"))
    # Sums are small and are merged into few partitions at run time; the claims made of them, and what is read off these, are not small.
    sums = sums.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k", "y")
    report = F.explode(F.array(*(F.struct(F.lit(i).alias("r"), F.lit(name).alias("document_id")) for i, name in enumerate(REPORTS)))).alias("s")
    kinds = F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("kind")
    rows = sums.select("*", report).select("k", "name", "y", "c", "n", "s.*").select("*", kinds)
    k5 = F.col("k") % 5
    crore = F.expr("(c + 50000000) div 100000000")
    c = F.when((k5 == 1), F.expr("c + c div 5")).otherwise(F.col("c"))
    million = F.floor((c + 500_000) / 1_000_000).cast("long")
    text = lambda x: x.cast("string")
    tenths = F.concat(F.lit("₹"), text(F.floor(crore / 10)), F.lit("."), text(crore % 10), F.lit(" crore"))
    cents = F.concat(F.lit("₹"), text(F.floor(million / 100)), F.lit("."), F.lpad(text(million % 100), 2, "0"), F.lit(" million"))
    growth = F.concat(text(F.col("n") % 17), F.lit("."), text(F.col("n") % 10), F.lit("%"))
    value = (
        F.when(F.col("kind").isin(0, 3), F.when(F.col("r") == 0, tenths).otherwise(cents))
        .when(F.col("kind") == 1, F.concat(text(F.col("n")), F.when(F.col("r") == 2, "+").otherwise(""), F.lit(" orders")))
        .otherwise(growth)
    )
    metric = (
        F.when(F.col("kind").isin(0, 3), "Order Value")
        .when(F.col("kind") == 1, F.when(F.col("r") == 1, "Number of orders").otherwise("Order  Count"))
        .otherwise(F.when(F.col("r") == 0, "total order value growth").otherwise("Order value growth"))
    )
    label = F.when(F.col("kind") == 3, F.concat(F.lit("FY"), F.lpad(text((F.col("y") + 1) % 100), 2, "0"))).otherwise(
        F.concat(F.lit("FY "), text(F.col("y")), F.lit("-"), F.lpad(text((F.col("y") + 1) % 100), 2, "0"))
    )
    restated = (k5 == 0) & (F.col("y") % 3 == 0) & (F.col("r") == 2)
    entity = F.concat("name", F.when(F.col("r") == 0, " Limited").when(F.col("r") == 1, " Ltd.").otherwise(""))
    evidence = F.concat(
        metric, F.lit(" of "), entity, F.lit(" was "), value, F.lit(" in "), label,
        F.when(restated, ", as restated").when((F.col("k") % 7 == 3) & (F.col("r") == 1), ", compared to the year before").otherwise(""),
        F.lit("."),
    )
    none = F.lit(None).cast("string")
    out = rows.select(
        (F.col("r").cast("long") * 1_000_000_000 + F.col("k").cast("long") * 1_000 + (F.col("y") - 1970) * 4 + F.col("kind")).alias("pos"),
        "document_id",
        (F.col("k") + 1).cast("int").alias("page_number"),
        entity.alias("entity"),
        metric.alias("metric"),
        value.alias("value_raw"),
        none.cast("double").alias("value_numeric"),
        F.when(F.col("kind") == 2, "percent").when((F.col("kind") == 1) & (F.col("r") == 1), "orders").alias("unit"),
        label.alias("period_label"),
        none.alias("period_start"),
        none.alias("period_end"),
        F.when((k5 == 2) & (F.col("r") == 1), "Consolidated").alias("scope"),
        F.when(F.col("k") % 11 == 4, F.when(F.col("r") == 0, "Asia").otherwise("World")).alias("geography"),
        F.when((k5 == 4) & (F.col("r") == 1), "target").otherwise("reported").alias("epistemic_status"),
        F.when((k5 == 3) & (F.col("r") == 0), "First Advance Estimate").when((k5 == 3) & (F.col("r") == 1), "Second Advance Estimate").when((k5 == 3), "Flash").alias("data_vintage"),
        evidence.alias("supporting_text"),
        F.lit(0.9).alias("extraction_confidence"),
    )
    own = fact_id(*(F.col(c) for c in ("document_id", "page_number", "entity", "metric", "value_raw", "period_label")))
    return out.withColumn("fact_id", own)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of requests from events: whole milliseconds of latency, batch, run and outcome."""
    e = table(spark, sf_dir, "events")
    latency = F.round(F.col("value") * 10).cast("long")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    # whole milliseconds, rounded to the nearest one
    start = F.call_function("div", micros + F.when(micros < 0, -500).otherwise(500), F.lit(1000))
    return e.select(
        F.col("event_id").alias("request_id"),
        (F.col("user_id") % 7).cast("int").alias("batch_id"),
        (F.col("event_id") % 3).cast("int").alias("run_id"),
        start.alias("start_ms"),
        (start + latency).alias("end_ms"),
        F.col("event_type").alias("outcome"),
        latency.alias("latency_ms"),
    )

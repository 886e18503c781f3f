import pytest
from pyspark.sql import functions as F

from concordat.functions import normalize as N
from concordat.operators import facts


def rows(spark, cases, schema):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, {schema}").orderBy("i")


VALUES = [
    ("₹8,142 Cr.", None, None, 81420000000.0, "INR", "crore", None, "normalized"),
    ("₹81,415.38 million", None, None, 81415380000.0, "INR", "million", None, "normalized"),
    ("Rs. 500 Cr", None, None, 5000000.0, "INR", "crore", None, "normalized"),
    ("$500 million", None, None, 500000000.0, None, "million", None, "partial"),
    ("US$ 500 million", None, None, 500000000.0, "USD", "million", None, "normalized"),
    (">4.8Mn tonnes", None, None, 4800000.0, "tonnes", "million", ">", "normalized"),
    ("33,278", "customers", None, 33278.0, "customers", None, None, "normalized"),
    ("17,000+", None, None, 17000.0, "count", None, ">=", "normalized"),
    ("—5.3%", None, None, -5.3, "percent", None, None, "normalized"),
    ("15.5 percent decline", None, None, -15.5, "percent", None, None, "normalized"),
    ("6.4%", None, -2.0, -6.4, "percent", None, None, "normalized"),
    ("2023-24", None, None, None, None, None, None, "unresolved"),
    ("n/a", None, 7.5, 7.5, "n a", None, None, "normalized"),
    ("n/a", "%", None, None, None, None, None, "unresolved"),
    ("4.8Mn tonnes (1)", None, None, 4810000.0, "tonnes", "million", None, "normalized"),
    ("−3.2%", None, None, -3.2, "percent", None, None, "normalized"),
    ("more than 5 lakh", None, None, 500000.0, "more than", "lakh", ">", "normalized"),
]


def test_values(spark):
    df = rows(spark, [v[:3] for v in VALUES], "value_raw string, unit string, value_numeric double")
    got = df.select(N.value(F.col("value_raw"), F.col("unit"), F.col("value_numeric")).alias("v")).select("v.*").collect()
    for r, want in zip(got, VALUES):
        assert (r["numeric_value"], r["canonical_unit"], r["scale"], r["value_qualifier"], r["status"]) == pytest.approx(want[3:]), want


PERIODS = [
    ("FY24", None, None, None, True), ("FY24", "april-march", "2023-04-01", "2024-03-31", False), ("FY 2023-24", None, "2023-04-01", "2024-03-31", False),
    ("Q4 FY24", None, None, None, True), ("Q4 FY24", "april-march", "2024-01-01", "2024-03-31", False), ("Q1 FY 2023-24", None, "2023-04-01", "2023-06-30", False),
    ("Q4 FY 2023-2024", None, "2024-01-01", "2024-03-31", False), ("March 31, 2024", None, "2024-03-31", "2024-03-31", False), ("31 March 2024", None, "2024-03-31", "2024-03-31", False),
    ("as of 1st Sept 2023", None, "2023-09-01", "2023-09-01", False), ("2024-03-31", None, "2024-03-31", "2024-03-31", False), ("2024-03", None, "2024-04-01", "2003-03-31", False),
    ("CY2024", None, "2024-01-01", "2024-12-31", False), ("2024", None, "2024-01-01", "2024-12-31", False), ("Period of Growth", None, None, None, True), ("", None, None, None, True), (None, None, None, None, True),
]


def test_periods(spark):
    df = rows(spark, [p[:2] for p in PERIODS], "label string, calendar string")
    got = df.select(N.period(F.col("label"), F.col("calendar")).alias("p")).select("p.*").collect()
    assert [(r["start"], r["end"], r["warning"] is not None) for r in got] == [p[2:] for p in PERIODS]
    kept = df.limit(1).select(N.period(F.col("label"), None, F.lit("a"), F.lit("b")).alias("p")).first()["p"]
    assert (kept["start"], kept["end"], kept["warning"]) == ("a", "b", None)


def test_entities_and_metrics(spark):
    names = ["Acme Limited", "Tata Motors Ltd.", " A  B, Inc. ", "X Private Limited", "Limited", "S.A.", "", None, "Plain Co,", "Y GmbH"]
    got = rows(spark, [(n,) for n in names], "n string").select(N.entity(F.col("n")).alias("e"), N.metric(F.col("n")).alias("m")).collect()
    assert [r["e"] for r in got] == ["Acme", "Tata Motors", "A B", "X", "Limited", "S.A", "", "", "Plain Co", "Y"]
    assert got[2]["m"] == "a b, inc."


def test_metric_tokens(spark):
    metrics = ["Revenue from operations", "Total expenses", "Number of employees", "Services and companies", "Losses", "GDP", "of the"]
    got = rows(spark, [(m,) for m in metrics], "m string").select(facts.metric_tokens(F.col("m")).alias("t")).collect()
    assert [r["t"] for r in got] == [["revenue", "operation"], ["expens"], ["number", "employee"], ["servic", "company"], ["loss"], ["gdp"], []]

"""Exact quantiles by selection, and the plans that must not do costly work twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import profile as A
from ticketloom.operators import vectors as V

MARKS = {"low": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}


@pytest.mark.parametrize("sizes", [(1, 2, 3), (5, 1000, 4), (7, 0, 500)])
def test_quantiles_equal_numpy(spark, sizes):
    rng = np.random.default_rng(sum(sizes))
    values = {g: list(np.round(rng.normal(size=n), 3 if n > 400 else 1)) for g, n in zip(("a", None, "c"), sizes, strict=True)}
    values["ties"], values["none"] = [2.5] * 50 + [3.0], []
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "class string, value double").repartition(5)
    got = {r["class"]: [r[m] for m in MARKS] for r in A.exact_quantiles(df, "class", "value", MARKS).collect()}
    want = {g: [round(float(np.quantile(v, q)), 6) for q in MARKS.values()] if v else [None] * 5 for g, v in values.items()}
    assert set(got) == {g for g, v in values.items() if v} | {"none"}
    for g, found in got.items():
        assert found == pytest.approx(want[g], abs=1e-6) if values[g] else found == [None] * 5


def test_quantiles_of_nothing_and_without_a_buffer(spark):
    df = spark.createDataFrame([], "class string, value double")
    assert A.exact_quantiles(df, "class", "value", MARKS).collect() == []
    plan = A.exact_quantiles(df, "class", "value", MARKS)._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()


def test_texts_are_embedded_once(spark):
    df = spark.range(20).select(F.col("id"), F.concat(F.lit("word number "), F.col("id")).alias("text"))
    queries = V.embed_texts(df.limit(2).withColumnRenamed("id", "qid"), "text", "vec", 8)
    plan = V.search(queries, V.embed_texts(df.repartition(3), "text", "vec", 8), k=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import monitor as M
from ticketloom.plans.registry import table
from ticketloom.session import work_path
from ticketloom.sources import logs as G
from ticketloom.sources import tables as S
from ticketloom.sources import vectors as V

CSV = '''id,text,tag
1,"quoted, comma",x
2,"two
lines",y
3,too,many,fields
4,short
5,"say ""hi""",z
'''


def test_messages_csv_skips_long_rows_and_pads_short_ones(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(CSV)
    from pyspark.sql import types as ST

    schema = ST.StructType([ST.StructField("id", ST.LongType()), ST.StructField("text", ST.StringType()), ST.StructField("tag", ST.StringType())])
    read = S.read_messages_csv(spark, str(path), schema)
    assert sorted(map(tuple, read.collect())) == [
        (1, "quoted, comma", "x"), (2, "two\nlines", "y"), (4, "short", None), (5, 'say "hi"', "z")
    ]
    assert sorted(r[0] for r in read.select("id").collect()) == [1, 2, 4, 5]


def test_message_fields(spark):
    df = spark.createDataFrame([("Wed Oct 11 06:55:44 +0000 2017", "1,2,x")], "a string, b string")
    row = df.select(F.date_format(S.parse_created_at(F.col("a")), "yyyy-MM-dd HH:mm:ss"), S.response_ids(F.col("b"))).first()
    assert row[0] == "2017-10-11 06:55:44" and row[1] == [1, 2, None]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / "deep" / fmt)
    S.save_table(spark.createDataFrame([(1,), (2,)], "a int"), path, fmt)
    assert sorted(r["a"] for r in S.load_table(spark, path, fmt).collect()) == [1, 2]


def test_load_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.load_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        S.load_table(spark, str(tmp_path), "xlsx")
    with pytest.raises(FileNotFoundError):
        S.first_available(spark, str(tmp_path / "a"), [str(tmp_path / "b")])


def test_materialise_once_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "once")
    for _ in range(2):
        assert S.materialise_once(spark, path, build).count() == 3
    assert len(calls) == 1
    S.materialise_once(spark, path, build, force=True)
    assert len(calls) == 2


def test_scan_reads_only_named_columns(spark, sf_dir):
    df = S.scan_pruned(spark, f"{sf_dir}/events.parquet", [("event_id", "string")])
    assert "ReadSchema: struct<event_id:bigint>" in df._jdf.queryExecution().executedPlan().toString()


def test_vector_table_is_checked(spark, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<float>")
    path = str(tmp_path / "v")
    assert V.write_vectors(good, path, "id", "vec") == 2
    assert V.add_documents(good.withColumn("id", F.col("id") + 10), path, "id", "vec") == 4
    bad = spark.createDataFrame([(3, [1.0])], "id long, vec array<float>")
    with pytest.raises(ValueError):
        V.add_documents(bad, path, "id", "vec")


def _values(spark, path):
    return {r["id"]: list(r["vec"]) for r in V.read_vectors(spark, path).collect()}


def test_added_documents_replace_their_keys(spark, tmp_path):
    path, schema = str(tmp_path / "v"), "id long, vec array<float>"
    V.write_vectors(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(50)], schema), path, "id", "vec", buckets=8)
    files = {p.name: {f.name for f in p.glob("*.parquet")} for p in Path(path).glob("_bucket=*")}
    new = spark.createDataFrame([(7, [2.0, 2.0]), (7, [1.0, 1.0]), (70, [3.0, 3.0])], schema)
    want = {i: [float(i), 0.0] for i in range(50)} | {7: [1.0, 1.0], 70: [3.0, 3.0]}
    for batch in ("b1", "b1", None):
        assert V.add_documents(new, path, "id", "vec", batch=batch) == 51
        assert _values(spark, path) == want
    # At most two buckets are written anew, the others are the same files.
    after = {p.name: {f.name for f in p.glob("*.parquet")} for p in Path(path).glob("_bucket=*")}
    assert len(files) > 5 and sum(files[b] != after[b] for b in files) <= 2


def test_an_interrupted_batch_is_finished_under_its_name(spark, tmp_path):
    path, schema = str(tmp_path / "v"), "id long, vec array<float>"
    V.write_vectors(spark.createDataFrame([(i, [float(i)]) for i in range(20)], schema), path, "id", "vec", buckets=2)
    new = spark.createDataFrame([(3, [9.0])], schema)
    V.add_documents(new, path, "id", "vec", batch="b")
    # As if the run had ended between removing a bucket's files and putting the new ones there.
    for file in [f for f in Path(path).glob("_bucket=*/*.parquet") if 3 in pq.read_table(f, columns=["id"])["id"].to_pylist()]:
        file.unlink()
    assert V.add_documents(new, path, "id", "vec", batch="b") == 20
    assert _values(spark, path) == {i: [float(i)] for i in range(20)} | {3: [9.0]}


@pytest.mark.parametrize("row", [(None, [1.0]), (5, None), (5, [1.0, 2.0])])
def test_a_batch_with_a_bad_row_changes_nothing(spark, tmp_path, row):
    path, schema = str(tmp_path / "v"), "id long, vec array<float>"
    V.write_vectors(spark.createDataFrame([(1, [1.0])], schema), path, "id", "vec")
    with pytest.raises(ValueError):
        V.add_documents(spark.createDataFrame([(1, [4.0]), row], schema), path, "id", "vec")
    assert _values(spark, path) == {1: [1.0]}


def test_metric_log_is_long(spark, tmp_path):
    path = str(tmp_path / "log")
    G.append_log(G.metric_records(spark, "r", {"a": 1.0, "b": 2.0}, step=3), path)
    assert {(r["key"], r["value"], r["step"]) for r in G.read_log(spark, path).collect()} == {("a", 1.0, 3), ("b", 2.0, 3)}


def test_work_paths_are_under_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = work_path(spark, "x")
    assert path != work_path(spark, "x")
    assert base is None or path.startswith(base)


def test_drift_and_alerts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    same = M.detect_drift(events, events, "event_type").first()
    assert same["drift_score"] == 0 and same["drift"] is False
    other = M.detect_drift(events, events.withColumn("event_type", F.lit("new")), "event_type").first()
    assert other["drift_score"] == 1 and other["drift"] is True
    assert M.detect_drift(events, events.limit(1).withColumn("event_type", F.lit("new")), "event_type").first()["drift"] is False
    metrics = spark.createDataFrame([("accuracy", 0.7), ("p99_latency", 10.0), ("drift_score", 0.2)], "metric string, value double")
    assert {r["alert"] for r in M.alert_rules(metrics).collect()} == {"accuracy_drop", "data_drift"}

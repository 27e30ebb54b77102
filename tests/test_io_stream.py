"""Sources, sinks, tracking tables and streaming operators."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as IO
from tessera.sources import tracking as TR
from tessera.streaming import streams as SS

from conftest import SF001


def _csv(tmp, text):
    p = os.path.join(tmp, "a.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_read_csv_blank_and_none_tokens(spark):  # N1 / N2
    tmp = tempfile.mkdtemp()
    p = _csv(tmp, 'x,s\n1.5,a\n,""\n2,None\n')
    arrow_like = IO.read_csv(spark, p, "x double, s string").collect()
    assert [r.s for r in arrow_like] == ["a", "", "None"] and arrow_like[1].x is None
    pandas_like = IO.read_csv(spark, p, "x double, s string", string_empty_as="null",
                              null_tokens=IO.PANDAS_NA_TOKENS).collect()
    assert [r.s for r in pandas_like] == ["a", None, None]


def test_read_many_first_schema_rules(spark):
    tmp = tempfile.mkdtemp()
    with open(os.path.join(tmp, "1.csv"), "w") as f:
        f.write("a,b\n1,x\n")
    with open(os.path.join(tmp, "2.csv"), "w") as f:
        f.write("a,b\n2,y\n")
    df = IO.read_many(spark, tmp, with_source=True)
    assert df.count() == 2 and dict(df.dtypes)["a"] == "int" and "_source_file" in df.columns


def test_ingest_idempotent_and_required(spark):
    tmp = tempfile.mkdtemp()
    src = os.path.join(tmp, "src")
    os.makedirs(src)
    _csv(src, "a,b\n1,x\n2,y\n3,z\n")
    dst = os.path.join(tmp, "dst")
    first = IO.ingest(spark, src, dst, required=["a"]).first()
    assert first.rows == 3 and not first.skipped
    assert IO.ingest(spark, src, dst).first().skipped
    assert IO.ingest(spark, src, dst, force=True).first().rows == 3
    with pytest.raises(ValueError):
        IO.check_required_columns(spark, dst, ["a", "missing"])


def test_from_records(spark):
    df = IO.from_records(spark, [{"Age": 50.0, "Smoking": "Yes"}], "Age double, Smoking string, BMI double")
    r = df.first()
    assert r.Age == 50.0 and r.BMI is None


def test_tracking_tables(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    base = tempfile.mkdtemp()
    df = spark.createDataFrame([(1.0,)], "x double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v")]).fit(df)
    r1 = TR.append_run(spark, base, "m", "final", {"C": 1}, {"roc_auc": 0.6})
    assert TR.save_model(spark, base, "risk", model, r1) == 1
    r2 = TR.append_run(spark, base, "m", "final", {"C": 2}, {"roc_auc": 0.7, "recall": 0.4})
    assert TR.save_model(spark, base, "risk", model, r2) == 2
    perf = TR.model_performance(spark, base, "risk").first()
    assert (perf.version, perf.roc_auc, perf.recall) == (2, 0.7, 0.4)
    assert TR.load_model(spark, base, "risk", 1) is not None
    latest = TR.load_model(spark, base, "risk")
    assert latest.transform(df).columns == ["x", "v"]
    runs = TR.read_runs(spark, base).collect()
    assert sorted(r.metrics["roc_auc"] for r in runs) == [0.6, 0.7]


def test_incremental_ingest_idempotent(spark):
    schema = spark.read.parquet(f"{SF001}/events.parquet").schema
    tmp = tempfile.mkdtemp()
    dst, ck = os.path.join(tmp, "dst"), os.path.join(tmp, "ck")
    first = SS.ingest_incremental(spark, SF001, dst, schema, ck, glob="events.parquet")
    second = SS.ingest_incremental(spark, SF001, dst, schema, ck, glob="events.parquet")
    assert first["rows"] == spark.read.parquet(f"{SF001}/events.parquet").count() and second["rows"] == 0


def test_windowed_metrics_match_batch(spark):
    schema = spark.read.parquet(f"{SF001}/events.parquet").schema
    tmp = tempfile.mkdtemp()
    ev = SS.stream_source(spark, SF001, schema, glob="events.parquet")
    prob = F.col("value") / (F.col("value") + 50.0)
    s = ev.select("ts", (F.col("event_type") == "purchase").cast("int").alias("y"), prob.alias("p"),
                  (prob >= 0.5).cast("int").alias("d"))
    m = SS.windowed_metrics(spark, s, "ts", "1 day", "1 day", "y", "d", "p",
                            os.path.join(tmp, "sink"), os.path.join(tmp, "ck"))
    total = m.agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(f"{SF001}/events.parquet").count()
    assert m.where("roc_auc < 0 OR roc_auc > 1").count() == 0


def test_windowed_metrics_multi_batch_late_data(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    tmp = tempfile.mkdtemp()
    src = os.path.join(tmp, "src")
    d = F.dayofmonth("ts")
    parts = [ev.where(d <= 10), ev.where((d > 10) & (d <= 20)), ev.where(d <= 3)]  # last one is late
    import pyarrow as pa
    import pyarrow.parquet as pq
    os.makedirs(src)
    for i, p in enumerate(parts):  # one small file per arriving batch
        t = pa.Table.from_pandas(p.toPandas(), preserve_index=False)
        t = t.set_column(t.schema.get_field_index("ts"), "ts", t["ts"].cast(pa.timestamp("us")))
        pq.write_table(t, os.path.join(src, f"{i:03d}.parquet"))

    def scored(df):
        prob = F.col("value") / (F.col("value") + 50.0)
        return df.select("ts", (F.col("event_type") == "purchase").cast("int").alias("y"), prob.alias("p"),
                         (prob >= 0.5).cast("int").alias("d"))
    stream = SS.stream_source(spark, src, ev.schema, max_files_per_trigger=1)
    got = SS.windowed_metrics(spark, scored(stream), "ts", "1 day", "1 day", "y", "d", "p",
                              os.path.join(tmp, "sink"), os.path.join(tmp, "ck"))
    on_time = parts[0].unionByName(parts[1])
    exp = SS.finish_windowed_metrics(SS.windowed_parts(scored(on_time), "ts", "1 day", "1 day", "y", "d", "p"))
    g = {(r.window_start, r.n, round(r.roc_auc, 12)) for r in got.collect()}
    e = {(r.window_start, r.n, round(r.roc_auc, 12)) for r in exp.collect()}
    assert g == e and len(g) == 20


def test_incremental_csv_ingest_picks_up_new_files_only(spark):
    tmp = tempfile.mkdtemp()
    src = os.path.join(tmp, "src")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("id,name\n1,x\n2,y\n")
    dst, ck = os.path.join(tmp, "dst"), os.path.join(tmp, "ck")
    opts = {"header": "true"}
    r1 = SS.ingest_incremental(spark, src, dst, "id int, name string", ck, fmt="csv", options=opts)
    with open(os.path.join(src, "b.csv"), "w") as f:
        f.write("id,name\n3,z\n")
    r2 = SS.ingest_incremental(spark, src, dst, "id int, name string", ck, fmt="csv", options=opts)
    assert (r1["rows"], r2["rows"]) == (2, 1)
    assert sorted(r.id for r in spark.read.parquet(dst).collect()) == [1, 2, 3]

"""Source / sink queries (IO-*).  Each writes into a fresh folder under the
shared checkpoint directory and reads the result back through the operator
under test, so the check covers the round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.session import scratch_path
from tessera.sources import files as IO
from tessera.plans.registry import load, query


def _orders_csv(spark, sf, parts: int = 4) -> str:
    """The whole orders table as ``parts`` CSV files (no row is left out)."""
    path = scratch_path(spark, "orders-csv")
    load(spark, sf, "orders").repartition(parts).write.options(**IO.CSV_OPTIONS).csv(path)
    return path


@query("io01_read_csv", "SELECT * FROM orders")
def read_csv(spark, sf):
    """IO-1 with an explicit schema (the production form)."""
    schema = load(spark, sf, "orders").schema
    return IO.read_csv(spark, _orders_csv(spark, sf), schema=schema)


@query("io03_read_many", "SELECT * FROM orders")
def read_many(spark, sf):
    """IO-3: every part file listed, sorted and appended under one schema."""
    path = _orders_csv(spark, sf)
    files = IO.list_files(spark, path, ".csv")
    return IO.read_many(spark, files, schema=load(spark, sf, "orders").schema)


@query("io03_read_many_inferred")
def read_many_inferred(spark, sf):
    """IO-3 with the first file's inferred schema ruling all files."""
    path = _orders_csv(spark, sf)
    return IO.read_many(spark, IO.list_files(spark, path, ".csv"), with_source=True)


@query("io04_read_parquet", """
SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'
""")
def read_parquet(spark, sf):
    """IO-4: projection and predicate reach the scan (ReadSchema /
    PushedFilters in the plan)."""
    return IO.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_extendedprice"],
                           where=F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))


@query("io05_write_parquet", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def write_parquet(spark, sf):
    """IO-5: write with a codec, read back."""
    path = scratch_path(spark, "lineitem-zstd")
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                           "l_returnflag")
    IO.write_parquet(df, path, compression="zstd")
    return spark.read.parquet(path)


@query("io06_write_report", """
SELECT o_orderstatus, count(*) AS n, avg(o_totalprice) AS mean_price FROM orders GROUP BY o_orderstatus
""")
def write_report(spark, sf):
    """IO-6: a result table written as JSON lines and read back."""
    path = scratch_path(spark, "report-json")
    rep = load(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"))
    IO.write_report(rep, path, fmt="json")
    return spark.read.schema(rep.schema).json(path)


@query("io07_ingest")
def ingest(spark, sf):
    """IO-7: CSV -> Parquet ingest stats (row count from an Observation),
    then a second call that is skipped because the output exists."""
    src = _orders_csv(spark, sf)
    dst = scratch_path(spark, "orders-parquet")
    schema = load(spark, sf, "orders").schema
    first = IO.ingest(spark, src, dst, schema=schema, required=["o_orderkey", "o_totalprice"])
    second = IO.ingest(spark, src, dst, schema=schema)
    return first.unionByName(second).select("rows", "skipped")

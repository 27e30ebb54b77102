"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: White space of the word contracts: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ids that are null rank below every id.
NULL_ID = -(1 << 63)
TEXTS_PER_BATCH = 256


def small_batches(spark: SparkSession) -> None:
    """Spark reads Parquet four thousand rows and hands rows to Python ten
    thousand at a time.  With texts that is tens of megabytes, or far more where
    texts are long, per task and in both processes; the session's batches are
    made smaller, which costs nothing with rows of this size."""
    for key, rows in (("spark.sql.parquet.columnarReaderBatchSize", 256),
                      ("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)):
        if int(spark.conf.get(key)) > rows:
            spark.conf.set(key, str(rows))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back:
    a lineage cut that survives lost executors and can be read by column."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    del df
    free_shuffles(spark)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Spark removes a finished job's shuffle files once the driver has collected
    the objects that own them; without this they pile up until the query ends."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(*staged: DataFrame) -> None:
    """Delete staged tables that only finished stages have read."""
    for df in staged:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_texts(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` over rows with whole texts, in small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_of(col: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(text: Column) -> Column:
    """Hash of a row's text; with the id it tells rows that share an id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does exactly that on ASCII text and is
    much faster than ``translate``; other letters must stay as they are."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_words(c: Column, separators: str = SPACE_RUN) -> Column:
    """Array of the non-empty pieces between runs of ``separators``."""
    return F.array_remove(F.split(c, separators, -1), "")


def sha256_hex(c: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(c, 256)


def covered(spans: Column) -> Column:
    """Length of the union of a sorted array of ``struct(s, e)`` spans."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        s, e = x["s"].cast("long"), x["e"].cast("long")
        return F.struct(F.greatest(acc["end"], e).alias("end"),
                        (acc["n"] + F.greatest(F.lit(0).cast("long"), e - F.greatest(s, acc["end"]))).alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])

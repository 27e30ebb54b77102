"""File sources and sinks (IO-1..9).

Scans are plain ``spark.read`` calls so Catalyst pushes filters and column
pruning into the Parquet reader; CSV is split across tasks by the file
source.  Existence checks and sizes go through the Hadoop ``FileSystem`` of
the path, so the same code works on local disk, HDFS or object stores.
"""

from __future__ import annotations

import time
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# pandas' default NA tokens (read_csv ``na_values`` default).
PANDAS_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                    "nan", "null"]

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "false",
               "sep": ",", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
               "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


# ------------------------------------------------------------- filesystem --

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists_nonempty(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return False
    if fs.getFileStatus(p).isFile():
        return fs.getFileStatus(p).getLen() > 0
    return fs.getContentSummary(p).getLength() > 0


def path_size_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def list_files(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """Sorted data files under ``path`` (or matching a glob)."""
    fs, p = _fs(spark, path)
    statuses = fs.globStatus(p) if any(ch in path for ch in "*?[") else [fs.getFileStatus(p)] if fs.exists(p) else []
    out = []
    for st in statuses or []:
        if st.isFile():
            out.append(st.getPath().toString())
        else:
            it = fs.listFiles(st.getPath(), True)
            while it.hasNext():
                f = it.next().getPath()
                name = f.getName()
                if not name.startswith(("_", ".")) and name.endswith(suffix):
                    out.append(f.toString())
    return sorted(out)


# -------------------------------------------------------------------- read --

def _fix_strings(df: DataFrame, string_empty_as: str, null_tokens: Sequence[str] | None) -> DataFrame:
    out = {}
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.StringType):
            continue
        c = F.col(f"`{f.name}`")
        if string_empty_as == "empty":
            c = F.coalesce(c, F.lit(""))
        if null_tokens:  # last, or the nulls would be blanks again
            c = F.when(c.isin(list(null_tokens)), F.lit(None).cast("string")).otherwise(c)
        out[f.name] = c
    return df.withColumns(out) if out else df


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None,
             string_empty_as: str = "empty", null_tokens: Sequence[str] | None = None,
             sampling_ratio: float = 1.0, options: dict | None = None) -> DataFrame:
    """IO-1 / IO-2: header CSV, ``,`` delimiter, ``"`` quote with doubled
    quote escape, one record per line.

    ``string_empty_as="empty"`` keeps empty string cells as ``""`` (Arrow
    behaviour; Spark itself reads them as null), ``"null"`` leaves them
    null.  ``null_tokens`` (e.g. :data:`PANDAS_NA_TOKENS`) turns those
    string values into null (pandas ``read_csv`` behaviour).  Pass an
    explicit ``schema`` at scale: inference costs an extra pass (limit it
    with ``sampling_ratio``)."""
    r = spark.read.options(**CSV_OPTIONS).options(**(options or {}))
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", "true").option("samplingRatio", str(sampling_ratio))
    df = r.csv(path)
    return _fix_strings(df, string_empty_as, null_tokens)


def read_many(spark: SparkSession, paths: Sequence[str] | str, schema=None,
              string_empty_as: str = "empty", null_tokens=None, with_source: bool = False) -> DataFrame:
    """IO-3: all CSV files (sorted) appended; without ``schema`` the FIRST
    file's inferred schema rules for all files.  ``with_source`` keeps the
    file path as lineage."""
    files = sorted(paths) if not isinstance(paths, str) else list_files(spark, paths, ".csv")
    if not files:
        raise FileNotFoundError(f"no csv files under {paths}")
    if schema is None:
        schema = spark.read.options(**CSV_OPTIONS).option("inferSchema", "true").csv(files[0]).schema
    df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(files)
    if with_source:
        df = df.withColumn("_source_file", F.col("_metadata.file_path"))
    return _fix_strings(df, string_empty_as, null_tokens)


def read_parquet(spark: SparkSession, path, columns: Sequence[str] | None = None,
                 where=None) -> DataFrame:
    """IO-4: Parquet scan; ``columns`` and ``where`` reach the reader as
    ``ReadSchema`` / ``PushedFilters``."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


# ------------------------------------------------------------------- write --

def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "errorifexists",
                  partition_by: Sequence[str] | None = None) -> None:
    """IO-5: codec snappy | gzip | brotli | zstd | none."""
    w = df.write.mode(mode).option("compression", "none" if compression in (None, "none") else compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                 single_file: bool = True) -> None:
    """IO-6: result tables as CSV (with header) or JSON lines.  Result tables
    are small (bounded by columns / bins / groups), so ``single_file``
    coalesces them into one part."""
    d = df.coalesce(1) if single_file else df
    if fmt == "csv":
        d.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    elif fmt == "json":
        d.write.mode(mode).json(path)
    else:
        raise ValueError(fmt)


def ingest(spark: SparkSession, src, dst: str, force: bool = False, skip_if_exists: bool = True,
           schema=None, compression: str = "snappy", string_empty_as: str = "empty",
           required: Sequence[str] | None = None) -> DataFrame:
    """IO-7: idempotent CSV -> Parquet conversion.  Skips when a non-empty
    output exists (unless ``force``).  The row count is read back from the
    Parquet footers of the output (metadata only, no data scan; an
    ``Observation`` on the write leaves a non-serializable manager in the
    session that breaks later ML jobs on Spark 4.1).  Returns one row:
    ``rows, input_mb, output_mb, ratio, seconds, skipped``."""
    schema_row = "rows long, input_mb double, output_mb double, ratio double, seconds double, skipped boolean"
    if skip_if_exists and not force and path_exists_nonempty(spark, dst):
        out_mb = path_size_bytes(spark, dst) / 1e6
        return spark.createDataFrame([(None, None, out_mb, None, 0.0, True)], schema_row)
    t0 = time.time()
    df = read_many(spark, src, schema=schema, string_empty_as=string_empty_as) if not isinstance(src, DataFrame) else src
    if required:
        check_required_columns(spark, df, required)  # before anything is overwritten
    write_parquet(df, dst, compression, mode="overwrite")
    rows = spark.read.parquet(dst).count()
    in_mb = sum(path_size_bytes(spark, p) for p in (list_files(spark, src, ".csv") if isinstance(src, str) else src)) / 1e6 \
        if not isinstance(src, DataFrame) else None
    out_mb = path_size_bytes(spark, dst) / 1e6
    ratio = (in_mb / out_mb) if in_mb and out_mb else None
    return spark.createDataFrame([(int(rows), in_mb, out_mb, ratio, time.time() - t0, False)], schema_row)


def check_required_columns(spark: SparkSession, df_or_path, cols: Sequence[str]) -> list[str]:
    """IO-8: the required columns must be a subset of the schema (read from
    the Parquet footer; no job).  Raises ``ValueError`` with the missing
    list, returns the schema's column names."""
    names = df_or_path.columns if isinstance(df_or_path, DataFrame) else spark.read.parquet(df_or_path).columns
    missing = [c for c in cols if c not in names]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return names


def from_records(spark: SparkSession, records: Sequence[dict], schema: T.StructType | str) -> DataFrame:
    """IO-9: an in-memory source (e.g. one record to score)."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema)

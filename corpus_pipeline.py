"""The training-data pipeline: five stages over ``documents``.

Every stage takes null, empty and very long texts (null counts as empty), null
and repeated ids (a decision holds for the rows of one id and text), repeated
rows, further columns of any name, which pass through, and empty tables, which
stay empty.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes every stage's result as Parquet and hands it, reread, to the next one.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_runs, packing, quality_rules, simhash_dedup
from tessera.llm.common import load, row_key, stage
from tessera.llm.queries import vocabulary


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go."""
    verdict = quality_rules.quality_rules(docs, load(spark, sf_dir, "labels")).where("kept") \
        .select(F.col("doc_id").alias("_kept"), F.col("rk").alias("_rk")).distinct()
    same = docs["doc_id"].eqNullSafe(verdict["_kept"]) & (row_key(docs["text"]) == verdict["_rk"])
    return docs.join(verdict, same, "left_semi")


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, documents stay (a text may become empty);
    ``n_chars``, where there is such a column, follows where lines went."""
    cut = F.col("_out.n_dropped") > 0
    new = {"text": F.col("_out.kept_text"), "n_chars": F.char_length("_out.kept_text").cast("long")}

    def column(i: int, name: str):
        old = F.col("_row").getField(f"c{i}")
        return (F.when(cut, new[name]).otherwise(old) if name in new else old).alias(name)
    return line_runs.dedup_rows(docs).select(*[column(i, c) for i, c in enumerate(docs.columns)])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the smallest id's (null ids
    rank first), of several texts under it the one with the least hash."""
    least = simhash_dedup.simhash_dedup(docs).groupBy("component").agg(F.min(F.struct("doc_id", "rk")).alias("least"))
    keep = least.select(F.col("least.doc_id").alias("_keep"), F.col("least.rk").alias("_rk"))
    # the row travels as a struct of numbered fields, so its columns' names cannot clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row"),
                        F.col("doc_id").alias("_id"), row_key(docs["text"]).alias("_row_rk"))
    same = keyed["_id"].eqNullSafe(keep["_keep"]) & (keyed["_row_rk"] == keep["_rk"])
    # repeated rows share id and text, so they are one group's: one of them stays
    return keyed.join(keep, same, "left_semi").dropDuplicates(["_id", "_row_rk"]) \
        .select(*[F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    hits = decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark")).where("n_hit > 0") \
        .select(F.col("doc_id").alias("_hit"), F.col("rk").alias("_rk")).distinct()
    same = docs["doc_id"].eqNullSafe(hits["_hit"]) & (row_key(docs["text"]) == hits["_rk"])
    return docs.join(hits, same, "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the remaining documents, their token ids with them."""
    return packing.pack_power_of_two(docs, vocabulary())


STAGES = [
    ("quality rules", rules_stage),
    ("line dedup", lines_stage),
    ("simhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Fingerprints, tokens and binomial bounds have no SQL form; the stages are
#: tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)

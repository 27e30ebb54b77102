"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches.  Each batch is reduced to its distinct line keys
(128-bit hashes) with the number of documents and the largest document that
hold them.  The batch is merge-anti-joined against the runs so far: the keys that
no run holds are *fresh* and become the batch's own sorted run of level 0.  So
every key lies in one run only.  The batch's other keys are repeats; their counts
are kept aside and raise those of the key's one row at the end.  When a level
holds ``fanout`` runs they are compacted into one run of the next level, so that a
key is rewritten only log(batches) times and a batch meets only log(batches) runs.

Batches and runs are tables of equally many hash buckets of the key, each sorted,
so neither an anti-join nor a compaction moves a row between tasks.

All work is DataFrame expressions; a key's rows are never gathered in one place:
counts are combined before the shuffle, and in the join back to the lines the keys
that hold more than one ``HOT``-th of all lines (so at most ``HOT`` keys) are
broadcast, the others joined by a shuffle.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, SPACES, ascii_lower, free_shuffles, stage, text_of
from tessera.session import scratch_path

KEY = ["h1", "h2"]
COUNTS = ["n_docs", "n_rows", "max_id"]
#: Keys with at least this share (1 / HOT) of all lines are joined by broadcast.
HOT = 4096


def keyed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int, batches: int) -> DataFrame:
    """``batch, id, rk, pos, h1, h2`` of every line whose key is long enough.  The
    key is the line without white space at its ends, A-Z in lower case.  ``rk`` tells apart rows that share an id; null ids rank lowest."""
    t = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"), text_of(text).alias("_t"))
    t = t.select("id", F.xxhash64("_t").alias("rk"), F.posexplode(F.split(ascii_lower(F.col("_t")), "\n", -1)).alias("pos", "_line"))
    t = t.withColumn("_key", F.btrim("_line", F.lit(SPACES))).where(F.char_length("_key") >= min_chars)
    return t.select(F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"), "id", "rk", "pos",
                    F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"))


def bucket_stage(df: DataFrame, buckets: int, name: str) -> DataFrame:
    """``df``, whose rows of one key lie in one task, written as hash buckets of
    the key, one sorted file each, and read back.  The table's name leaves the
    catalog at once; its files stay below ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    table = f"llm_lines_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *KEY).sortBy(*KEY).format("parquet") \
        .option("path", scratch_path(spark, f"llm-{name}")).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    del df
    free_shuffles(spark)
    return out


def without(batch: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """The rows of ``batch`` whose key no run holds, by one merge join per run."""
    return reduce(lambda left, run: left.hint("merge").join(run.select(*KEY).hint("merge"), KEY, "left_anti"), runs, batch)


class LineRuns:
    """Levelled sorted runs of line keys: ``h1, h2, n_docs, n_rows, max_id`` as of
    the batch that brought the key; ``raised`` holds later batches with their runs."""

    def __init__(self, fanout: int = 2, buckets: int | None = None):
        self.fanout = fanout
        self.buckets = buckets
        self.levels: list[list[DataFrame]] = []
        self.raised: list[tuple[DataFrame, DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of ``id, h1, h2`` rows whose ids no other batch holds;
        returns its run: the keys that no run held before, all ``fresh``."""
        if self.buckets is None:
            self.buckets = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        batch = lines.groupBy(*KEY).agg(F.count_distinct("id").alias("n_docs"), F.count(F.lit(1)).alias("n_rows"),
                                        F.max("id").alias("max_id"))
        held = self.runs()
        if held:
            batch = bucket_stage(batch, self.buckets, "line-batch")
            run = bucket_stage(without(batch, held), self.buckets, "line-run")
            self.raised.append((batch, run))
        else:
            run = bucket_stage(batch, self.buckets, "line-run")
        self._push(0, run)
        return run.withColumn("fresh", F.lit(True))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = bucket_stage(merge(self.levels[level]), self.buckets, f"line-level{level + 1}")
            self.levels[level] = []
            self._push(level + 1, merged)

    def repeated(self, min_docs: int) -> DataFrame:
        """Keys held by at least ``min_docs`` documents: each run's keys with what
        later batches added to them; ``fresh`` where none did."""
        if not self.raised:
            return merge(self.runs()).where(F.col("n_docs") >= min_docs).withColumn("fresh", F.lit(True))
        more = merge([without(batch, [run]) for batch, run in self.raised])
        more = more.select(*KEY, *[F.col(c).alias(f"more_{c}") for c in COUNTS])

        def total(run: DataFrame) -> DataFrame:
            both = run.hint("merge").join(more, KEY, "left")
            n = lambda c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))
            return both.select(*KEY, n("n_docs").alias("n_docs"), n("n_rows").alias("n_rows"),
                               F.greatest("max_id", "more_max_id").alias("max_id"),
                               F.col("more_n_docs").isNull().alias("fresh")).where(F.col("n_docs") >= min_docs)
        return reduce(DataFrame.unionAll, [total(run) for run in self.runs()])


def merge(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, runs).groupBy(*KEY).agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_rows").alias("n_rows"), F.max("max_id").alias("max_id"))


def lines_of_keys(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``lines`` with a key of ``keys`` (``h1, h2, n_rows, max_id``), and
    its ``max_id``; no key's rows go to one task if they are many."""
    hot = F.col("n_rows") * HOT >= F.lit(lines.count())
    few = F.broadcast(keys.where(hot).select(*KEY, "max_id"))
    rest = lines.join(F.broadcast(keys.where(hot).select(*KEY)), KEY, "left_anti")
    return lines.join(few, KEY).unionByName(rest.join(keys.where(~hot).select(*KEY, "max_id"), KEY))


def dedup_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20,
               min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Two structs a row: ``_row``, the row of ``docs`` as it was, and ``_out`` with
    ``kept_text, n_lines, n_dropped``; so no column of the input can clash."""
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    d = docs.select(F.struct(*named).alias("_row"))
    own = {docs.columns[i].lower(): F.col("_row").getField(f"c{i}") for i in range(len(named))}
    key, body = own[doc_id.lower()].cast("long"), F.coalesce(own[text.lower()].cast("string"), F.lit(""))
    d = d.select("_row", F.coalesce(key, F.lit(NULL_ID)).alias("_doc"), F.xxhash64(body).alias("_key"))
    lines = stage(keyed_lines(d.select(F.col("_doc").alias("id"), body.alias("text")), "id", "text", min_chars, batches), "lines")
    runs = LineRuns(fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    again = stage(runs.repeated(min_docs).select(*KEY, "n_rows", "max_id"), "line-repeats")
    drop = lines_of_keys(lines.drop("batch"), again) \
        .where("id <> max_id").groupBy("id", "rk").agg(F.collect_set("pos").alias("_drop")) \
        .select(F.col("id").alias("_id"), F.col("rk").alias("_rk"), "_drop")
    d = d.join(drop, (F.col("_doc") == F.col("_id")) & (F.col("_key") == F.col("_rk")), "left")
    d = d.select("_row", "_drop", body.alias("_t"), F.split(body, "\n", -1).alias("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.array_join(F.transform(stay, lambda p: F.get("_lines", p)), "\n")
    return d.select("_row", F.struct(F.when(F.col("_drop").isNull(), F.col("_t")).otherwise(kept).alias("kept_text"),
                                     F.size("_lines").cast("long").alias("n_lines"),
                                     F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped")).alias("_out"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20,
               min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    Lines whose key (the line without white space at its ends, A-Z in lower case) has ``min_chars`` code points and
    stands in ``min_docs`` documents stay only in the largest document holding
    it, every time they stand there.  A null or empty text is one empty line.
    Rows that share an id are one holder, and each row keeps or loses its own
    lines; null ids together rank below every id.  Other columns pass through,
    those named like an added one (in whatever case) are replaced; an empty table
    gives an empty result."""
    added = ("kept_text", "n_lines", "n_dropped")
    out = dedup_rows(docs, doc_id, text, min_chars, min_docs, batches, fanout)
    return out.select(*[F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in added],
                      *[F.col("_out").getField(c).alias(c) for c in added])

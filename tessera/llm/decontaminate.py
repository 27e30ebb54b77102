"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``size`` consecutive words (an item of fewer
words is one window).  A document contains a window only if it contains the
window's rarest word: at containment 1 one token is the necessary prefix.
Words are ordered by how often they occur in the documents (ties by the word);
windows with a word that no document has are dropped at once.  The prefix words
are joined with the word positions of the documents.  A hit at position p of a
word that stands at offset o of the window fixes the only possible start p - o;
the length bound (the window must end inside the document) and the position
bound (start >= 0) come first, then the window's words are compared with the
document's words at that place, which is exact.

All work is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, covered, sha256_hex, split_words, stage, text_of

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The prefix table is broadcast up to this size, else joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def doc_words(c: Column) -> Column:
    return split_words(ascii_lower(c), NOT_WORD)


def windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """``wid, ws, item_id``: each distinct window of each item, once."""
    w = items.select(F.col(item_id).cast("string").alias("item_id"), doc_words(text_of(text)).alias("w")) \
        .where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    w = w.select("item_id", "w", F.explode(starts).alias("i")) \
        .select("item_id", F.slice("w", F.col("i"), F.lit(size)).alias("ws")).distinct()
    return w.select(F.unhex(F.md5(F.concat_ws(" ", "ws"))).alias("wid"), "ws", "item_id")


def _word_rows(docs: DataFrame, *carry: str) -> DataFrame:
    return docs.select(*carry, F.posexplode("w").alias("p", "word"))


def _is_small(df: DataFrame, bytes_per_row: Column) -> bool:
    return (df.agg(F.sum(bytes_per_row).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES


def _occurrences(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """``id, rk, wid, s, e``: every place where a window stands.  ``prefix`` has
    one row per window with its rarest word.  A small prefix table is broadcast
    and checked where the words are; a large one is shuffled with bare
    positions, and the candidates then meet the documents again."""
    fits = F.expr("p >= o AND p - o + size(ws) <= n_words")
    same = F.expr("slice(w, p - o + 1, size(ws)) = ws")
    d = docs.withColumn("n_words", F.size("w"))
    if _is_small(prefix, 16 * F.size("ws") + F.octet_length(F.concat_ws(" ", "ws")) + 64):
        hits = _word_rows(d, "id", "rk", "n_words", "w").join(F.broadcast(prefix), "word").where(fits & same)
    else:
        near = _word_rows(d, "id", "rk", "n_words").join(prefix, "word").where(fits).drop("word").distinct()
        hits = near.join(docs.select(F.col("id").alias("_id"), F.col("rk").alias("_rk"), "w"),
                         F.col("id").eqNullSafe(F.col("_id")) & (F.col("rk") == F.col("_rk"))).where(same)
    return hits.selectExpr("id", "rk", "wid", "CAST(p - o AS BIGINT) AS s", "CAST(p - o + size(ws) AS BIGINT) AS e")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, item_ids``
    (sorted strings).

    Null texts have no words; items without words have no window; null item ids
    are left out of ``item_ids`` but their windows hit.  Rows that share a
    doc_id (or have none) are judged one by one.  Empty tables give empty
    results or documents without hits."""
    d = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("_t")) \
        .select("id", F.xxhash64("_t").alias("rk"), doc_words(F.col("_t")).alias("w"))
    win = stage(windows(items, item_id, item_text, size), "windows")
    distinct = win.groupBy("wid").agg(F.first("ws").alias("ws"))
    tokens = distinct.select("wid", F.posexplode("ws").alias("o", "word"))
    vocabulary = stage(tokens.select("word").distinct(), "item-words")
    if _is_small(vocabulary, F.octet_length("word") + 32):
        vocabulary = F.broadcast(vocabulary)
    seen = _word_rows(d).join(vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rare = tokens.join(seen, "word", "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "o")).alias("m"),
        ).where("m.n > 0").select("wid", "m.word", "m.o")
    prefix = stage(distinct.join(rare, "wid"), "prefix")
    found = stage(_occurrences(d, prefix), "window-hits")
    hit = found.groupBy("id", "rk").agg(covered(F.sort_array(F.collect_set(F.struct("s", "e")))).alias("n_hit"))
    hit_items = found.select("id", "rk", "wid").distinct().join(win.select("wid", "item_id"), "wid") \
        .groupBy("id", "rk").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    per_doc = hit.join(hit_items.select(F.col("id").alias("id2"), F.col("rk").alias("rk2"), "item_ids"),
                       F.col("id").eqNullSafe(F.col("id2")) & (F.col("rk") == F.col("rk2")), "left") \
        .select(F.col("id").alias("id3"), F.col("rk").alias("rk3"), "n_hit", "item_ids")
    out = d.select("id", "rk", F.size("w").cast("long").alias("n_words")) \
        .join(per_doc, F.col("id").eqNullSafe(F.col("id3")) & (F.col("rk") == F.col("rk3")), "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("id").alias("doc_id"), "rk", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("item_ids", none).alias("item_ids"))


def digest(result: DataFrame) -> DataFrame:
    """The columns of the query: counts, the hash of the item list, the verdict."""
    return result.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                         sha256_hex(F.array_join("item_ids", ",")).alias("items_sha256"),
                         (F.col("n_hit") > 0).alias("contaminated"))

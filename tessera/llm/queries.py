"""The numbered operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (decontaminate, fill_middle, host_reputation, line_runs, ngram_model, packing, placement, prefix_free, quality_rules, secret_scan, simhash_dedup,
                         token_align, toxicity)
from tessera.llm.common import load, sha256_hex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary() -> str:
    """Path of the tokenizer file that packing uses by default."""
    return tokenizer_file("byte_bpe_50k.json")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


@query("op1_dictionary_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold() != 0))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted", "n_windows", "n_toxic_windows")


@query("op2_elias_fano_ngrams")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = ngram_model.NgramModel(load(spark, sf_dir, "documents"), fold() != 1)
    out = model.score()
    return out.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_power_of_two_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_power_of_two(load(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


@query("op4_gray_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.digest(simhash_dedup.simhash_dedup(load(spark, sf_dir, "documents")))


@query("op5_line_runs", """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.doc_id, pos, line, hot.k IS NOT NULL AND keyed.doc_id <> hot.top AS dropped
  FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.line_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


@query("op6_random_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_spans(load(spark, sf_dir, "documents")))


@query("op7_risk_controlled_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


@query("op8_prefix_decontamination", """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS ws
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(ws) AS k FROM win),
spots AS (
  SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS ws
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM spots JOIN win USING (ws)),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(
        load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


@query("op9_permutation_table")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id")
    return placement.place(docs, ["doc_id"], placement.shard_names(64))


@query("op10_prefix_free_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    # passages of over 50 words may be shorter than the strings that are removed: told in a column of their own
    shared = prefix_free.shared_words(docs).select(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), "n_shared_words")
    out = prefix_free.remove_repeats(docs, with_kept=False)
    out = out.join(shared, out["doc_id"].eqNullSafe(shared["_id"]) & (out["rk"] == shared["_rk"]), "left")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256",
                      F.coalesce("n_shared_words", F.lit(0)).cast("long").alias("n_shared_words"))


@query("op11_host_reputation")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    outcomes = host_reputation.outcomes_from_documents(pages, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return host_reputation.filter_urls(pages, outcomes)


@query("op12_pointer_jumping_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(load(spark, sf_dir, "documents"), vocabulary(), tokenizer_file("piece_bpe_32k.model"))


@query("op13_exception_index_fim", """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
x AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
s AS (
  SELECT doc_id, t, n, form, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m,
    array_to_string(list_slice(u, b + 1, n), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM s""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(load(spark, sf_dir, "documents"), with_output=False)

"""Small tables and plain-Python references shared by these tests."""

import re

SPACE = "[\x20\x09-\x0d]"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(lower(t))


def sample(n=150):
    """Rows of the smallest given table plus the awkward ones."""
    import duckdb
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '/root/testdata/sf0.001/documents.parquet' "
                      f"ORDER BY doc_id LIMIT {n}").fetchall()
    long_ = " ".join(f"w{i % 977} Zeta{i}" for i in range(15_000))
    odd = [None, "", " \t\n", "one", "Ünï cödé ÉÈ word\x0bTab\x00nul", long_, long_ + " tail", "ha " * 3000,
           "same line of at least twenty chars\nmore\n" * 3, "SAME line of at least twenty chars  \nother",
           "\tsame line of at least twenty chars\n", rows[0][1], rows[0][1].upper()]
    return rows + [(10_000 + i, t, None if i % 3 else "en", "odd", None) for i, t in enumerate(odd)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def awkward(spark, rows):
    """The rows with a repeated row, a null id and extra columns that are named
    like the operators' own."""
    from pyspark.sql import functions as F
    rows = [*rows, rows[0], (rows[1][0], "another text under a used id", "en", "odd", None), (None, rows[2][1], None, None, None),
            (None, None, None, None, None)]
    d = frame(spark, rows)
    for c in ("id", "rk", "_t", "_row", "_drop", "pos", "w", "word", "slot", "_slot", "kept_text", "start", "fp", "score", "s", "e"):
        d = d.withColumn(c, F.lit("x"))
    return rows, d


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

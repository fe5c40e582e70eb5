"""Small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows of (doc_id, text, lang, source)."""
    full = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \n\t ", "en", "a"),
    (4, "one two three four five six seven eight nine ten", "en", "b"),
    (4, "one two three four five six seven eight nine ten", "en", "b"),
    (5, "One TWO three four five six seven eight nine ten", "en", "b"),
    (6, "der die das und nicht mit von zu im ein äöü ß\nzweite Zeile hier mit vielen Worten", "de", None),
    (None, "a text without an id that has some words in it", "en", "c"),
    (7, "x", "zz", "c"),
    (8, "word " * 30000, "en", "b"),
    (9, "\n" * 5000, "en", "b"),
]
CLASHING = ["_id", "_th", "_parts", "_text", "_fp", "_node", "slot", "shard", "score", "predicted", "language", "accepted", "n_lines", "n_dropped", "_bytes", "_host", "_k", "_h", "_b"]


def clashing(df):
    """df with columns of names that the operators use themselves."""
    return df.withColumns({c: F.lit("mine") for c in CLASHING})

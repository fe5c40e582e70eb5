"""One text as its reader is shown it: sentences scored, labelled and counted; and what fits a scorer's window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions import sequences as sq
from seamline.functions import text as tx

# Characters of a text at most, tokens of a window without its ends, the thresholds that can be asked for, and errors.
MOST_CHARACTERS = 20_000
WINDOW = 510
LOWEST, HIGHEST = 0.01, 0.99
EMPTY, TOO_LONG, NO_SENTENCES = "Empty input.", "Text too long (limit 20,000 characters).", "No sentences found."

_CHUNKS = "array<struct<ids:array<int>,starts:array<int>,words:array<int>,labels:array<int>>>"


def fitting(lengths: Column, budget: int = WINDOW) -> Column:
    """How many sentences, each with a mark, go into one window from its start; lengths are in tokens, at least one each.

    The first that doesn't fit ends the window, even if a later one would.
    """
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(s: Column, n: Column) -> Column:
        used = s["used"] + F.greatest(n, F.lit(1)) + 1
        fits = s["open"] & (used <= budget)
        return F.struct(F.when(fits, used).otherwise(s["used"]).alias("used"), (s["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    return F.aggregate(lengths.cast("array<int>"), state, step)["n"]


def asked_threshold(asked: Column, default: float) -> Column:
    """The threshold asked for, within its bounds; the default as it is for null or what is no number."""
    x = asked.try_cast("double")
    bounded = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.nanvl(x, F.lit(LOWEST))))
    # The bounds would stand in for a null.
    return F.when(x.isNotNull(), bounded).otherwise(F.lit(float(default)))


def analysis(text: Column, sentences: Column, proba: Column, asked: Column | None = None, default: float = 0.5) -> Column:
    """struct<error, sentences, boundaries, n_sentences, n_scored, n_ai, ai_ratio, threshold, truncated> of a text.

    proba holds the scores of the first sentences; those beyond are shown
    without score and label. A text that is null, blank or too long, or without
    sentences, has an error and counts of 0.
    """
    t = tx.strip(F.coalesce(text, F.lit("")))
    none = F.array().cast("array<string>")
    error = F.when(t == "", EMPTY).when(F.length(t) > MOST_CHARACTERS, TOO_LONG).when(F.coalesce(F.size(sentences), F.lit(0)) <= 0, NO_SENTENCES)
    threshold = F.lit(float(default)) if asked is None else asked_threshold(asked, default)

    def row(s: Column, i: Column) -> Column:
        p = F.get(proba, i)
        return F.struct(i.alias("index"), s.alias("text"), F.bround(p, 4).alias("prob_ai"), (p >= threshold).cast("int").alias("label"), tx.word_count(s).alias("words"), p.isNull().alias("truncated"))

    def counted(rows: Column) -> Column:
        labels = F.filter(F.transform(rows, lambda r: r["label"]), lambda y: y.isNotNull())
        scored, ones = F.size(labels), F.size(F.filter(labels, lambda y: y == 1))
        return F.struct(
            error.alias("error"), rows.alias("sentences"), sq.boundaries(labels).alias("boundaries"), F.size(rows).alias("n_sentences"), scored.alias("n_scored"),
            ones.alias("n_ai"), F.coalesce(F.bround(F.try_divide(ones.cast("double"), scored.cast("double")), 4), F.lit(0.0)).alias("ai_ratio"),
            threshold.alias("threshold"), (scored < F.size(rows)).alias("truncated"),
        )

    return F.transform(F.array(F.transform(F.when(error.isNull(), sentences).otherwise(none), row)), counted)[0]


def chunks_of_words(tokens: Sequence[Sequence[int]], labels: Sequence[int], first: int, last: int, budget: int = WINDOW) -> list[dict[str, list[int]]]:
    """A document's words as chunks of tokens between two marks; each word has its label at its first token.

    Words aren't parted: one that would overfill a chunk opens the next, and one
    over the budget is cut to it. Words without tokens are in no chunk.
    """
    chunks: list[dict[str, list[int]]] = []
    room = 0
    for at, word in enumerate(tokens):
        piece = list(word)[:budget]
        if not piece:
            continue
        if len(piece) > room:
            chunks.append({"ids": [first], "starts": [], "words": [], "labels": []})
            room = budget
        chunk = chunks[-1]
        chunk["starts"].append(len(chunk["ids"]))
        chunk["words"].append(at)
        chunk["labels"].append(int(labels[at]))
        chunk["ids"] += piece
        room -= len(piece)
    for chunk in chunks:
        chunk["ids"].append(last)
    return chunks


def word_chunks(first: int, last: int, budget: int = WINDOW):
    """chunks_of_words() as a vectorised function of (tokens of each word, labels); null has no chunks."""

    @F.pandas_udf(_CHUNKS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tokens, labels in batches:
            yield pd.Series([[] if t is None else chunks_of_words(t, y, first, last, budget) for t, y in zip(tokens, labels, strict=True)], dtype=object)

    return run

"""Joins of documents with their windows, stand-ins and references."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions import text as tx
from seamline.functions.draws import shuffle_key


def length_guard(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with as many labels as sentences, the rejected others)."""
    same = F.coalesce(F.size("sentences") == F.size("labels"), F.lit(False))
    good = records.where(same).withColumn("labels", F.transform("labels", lambda y: y.cast("int")))
    return good, records.where(~same)


def filter_documents(docs: DataFrame, split: str | None = None, generators: list[str] | None = None, roles: list[str] | None = None, role_table: DataFrame | None = None, construction_type: str | None = None) -> DataFrame:
    """The documents that meet all conditions given. Roles need the table (generator, role)."""
    if roles is not None and role_table is None:
        raise ValueError("roles need a table of generators' roles")
    out = docs
    if split is not None:
        out = out.where(F.col("split") == split)
    if generators is not None:
        out = out.where(F.col("generator").isin(*generators))
    if construction_type is not None:
        out = out.where(F.col("construction_type") == construction_type)
    if roles is not None:
        out = out.join(role_table.where(F.col("role").isin(*roles)).select("generator"), "generator", "left_semi")
    return out


def twins(docs: DataFrame, windows: DataFrame, strict: bool = True) -> DataFrame:
    """docs' all-human twins: their window's sentences, labels 0, and weight 1 over the documents that share it.

    A document without a window, or whose sentences labelled 0 aren't the
    window's at the same places, raises; if not strict it has an `error`.
    """
    w = windows.select(F.col("window_id").alias("_w"), F.col("sentences").alias("_ws"))
    joined = docs.join(w, docs["window_id"] == F.col("_w"), "left")
    moved = F.exists(F.arrays_zip(F.col("_ws").alias("a"), F.col("sentences").alias("b"), F.col("labels").alias("y")), lambda x: (x["y"] == 0) & ~x["a"].eqNullSafe(x["b"]))
    error = (
        F.when(F.col("window_id").isNull() | (F.col("window_id") == ""), F.concat(F.col("record_id"), F.lit(": no window_id")))
        .when(F.col("_ws").isNull(), F.concat(F.col("record_id"), F.lit(": window "), F.col("window_id"), F.lit(" not found")))
        .when((F.size("_ws") != F.size("sentences")) | moved, F.concat(F.col("record_id"), F.lit(": human sentences do not align with window "), F.col("window_id")))
    )
    weight = F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("window_id"))
    made = joined.select(
        F.concat("record_id", F.lit("__twin")).alias("record_id"), "source_id", "split", "generator", "construction_type",
        F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.col("_ws")).alias("sentences") if strict else F.col("_ws").alias("sentences"),
        F.array_repeat(F.lit(0), F.size("sentences")).alias("labels"), "window_id", weight.alias("weight"), error.alias("error"),
    )
    return made.drop("error") if strict else made


def unused_windows(windows: DataFrame, splits: DataFrame, records: DataFrame, split: str = "train") -> DataFrame:
    """Windows of a split whose source no record of any split draws on."""
    own = splits.where(F.col("split") == split).select("source_id")
    return windows.join(own, "source_id", "left_semi").join(records.select("source_id"), "source_id", "left_anti")


def rank_matched(need: DataFrame, pool: DataFrame, length: str, need_id: str, pool_id: str, seed: int = 0) -> DataFrame:
    """(need_id, pool_id, length): a stand-in of the same length for each need, none twice.

    A need that runs short has a null stand-in; see shortage().
    """
    a = need.select(F.col(need_id).alias("_need"), F.col(length).alias("_n")).distinct()
    a = a.withColumn("_rn", F.row_number().over(Window.partitionBy("_n").orderBy("_need")))
    b = pool.select(F.col(pool_id).alias("_pool"), F.col(length).alias("_n")).distinct()
    b = b.withColumn("_rn", F.row_number().over(Window.partitionBy("_n").orderBy(shuffle_key(seed, F.col("_pool")), "_pool")))
    return a.join(b, ["_n", "_rn"], "left").select(F.col("_need").alias(need_id), F.col("_pool").alias(f"stand_in_{pool_id}"), F.col("_n").alias(length))


def shortage(matched: DataFrame, pool_id: str, length: str) -> DataFrame:
    """(length, missing) of needs without a stand-in."""
    return matched.where(F.col(f"stand_in_{pool_id}").isNull()).groupBy(length).agg(F.count(F.lit(1)).alias("missing"))


def unrelated_twins(docs: DataFrame, pool: DataFrame, seed: int = 0) -> DataFrame:
    """An unrelated all-human stand-in of the same length for each document; documents of one window share it.

    Raises if a length runs out.
    """
    need = docs.select("window_id", F.size("sentences").alias("n")).distinct()
    free = pool.select(F.col("window_id").alias("pool_id"), F.size("sentences").alias("n"))
    got = rank_matched(need, free, "n", "window_id", "pool_id", seed)
    stand_in = F.when(F.col("stand_in_pool_id").isNull(), F.raise_error(F.concat(F.lit("not enough unrelated windows of length "), F.col("n").cast("string")))).otherwise(F.col("stand_in_pool_id"))
    picked = got.select(F.col("window_id").alias("_doc_window"), stand_in.alias("_stand_in"))
    w = pool.select(F.col("window_id").alias("_stand_in"), F.col("source_id").alias("_source"), F.col("sentences").alias("_ws"))
    joined = docs.join(picked, docs["window_id"] == F.col("_doc_window")).join(w, "_stand_in")
    weight = F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(docs["window_id"]))
    return joined.select(
        F.concat("record_id", F.lit("__unrelated")).alias("record_id"), F.col("_source").alias("source_id"), "split", "generator", "construction_type",
        F.col("_ws").alias("sentences"), F.array_repeat(F.lit(0), F.size("_ws")).alias("labels"), F.col("_stand_in").alias("window_id"), weight.alias("weight"),
    )


def leaked(docs: DataFrame, reference: DataFrame, key: str, text: str = "text", reference_text: str = "text", n: int = 8) -> DataFrame:
    """The distinct keys of documents that share a run of n words with any reference text.

    Runs are first met by their hashes, a long each; only documents that meet
    one are compared by the words themselves. Which joins are used is left to
    the sizes of the sides.
    """
    met = docs.select(key, F.explode(tx.word_ngram_hashes(F.col(text), n)).alias("_h"))
    known = reference.select(F.explode(tx.word_ngram_hashes(F.col(reference_text), n)).alias("_h")).distinct()
    maybe = docs.join(met.join(known, "_h", "left_semi").select(key).distinct(), key, "left_semi")
    grams = maybe.select(key, F.explode(tx.word_ngrams(F.col(text), n)).alias("_gram"))
    words = reference.select(F.explode(tx.word_ngrams(F.col(reference_text), n)).alias("_gram")).distinct()
    return grams.join(words, "_gram", "left_semi").select(key).distinct()


def drop_leaked(docs: DataFrame, reference: DataFrame, key: str, text: str = "text", reference_text: str = "text", n: int = 8) -> DataFrame:
    """docs without those that leaked() names and without exact copies (the smallest key stays)."""
    clean = docs.join(leaked(docs, reference, key, text, reference_text, n), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(text).orderBy(key))
    return clean.withColumn("_rn", first).where(F.col("_rn") == 1).drop("_rn")


def greedy_length_match(targets: list[int], pool: list[tuple[object, int]], seed: int, tolerance: float = 0.10) -> list[tuple[object, str]]:
    """For each target length an item of the pool (id, length) without replacement, and how it fits.

    Targets go in shuffled order. An item within the tolerance is drawn at
    random (whole); else the shortest longer one is to be cut (truncated); else
    the longest that is left is taken (short). Raises if the pool runs out.
    """
    from bisect import bisect_left, bisect_right, insort  # noqa: F401

    rng = random.Random(seed)
    free = sorted(pool, key=lambda p: (p[1], str(p[0])))
    lengths = [p[1] for p in free]
    order = list(range(len(targets)))
    rng.shuffle(order)
    out: list[tuple[object, str]] = [("", "")] * len(targets)
    for k in order:
        if not free:
            raise ValueError("the pool has run out")
        want = targets[k]
        low, high = bisect_left(lengths, want - tolerance * want), bisect_right(lengths, want + tolerance * want)
        if low < high:
            i, how = rng.randrange(low, high), "whole"
        elif (longer := bisect_right(lengths, want)) < len(free):
            i, how = longer, "truncated"
        else:
            i, how = bisect_left(lengths, lengths[-1]), "short"
        out[k] = (free[i][0], how)
        del free[i], lengths[i]
    return out


def length_matched(need: DataFrame, pool: DataFrame, need_id: str, pool_id: str, need_words: str, pool_words: str, text: str, seed: int = 42, groups: list[str] | None = None) -> DataFrame:
    """(need_id, pool_id, fit, text): greedy_length_match() within each group, texts cut at a sentence where they are too long.

    Each choice depends on those before it, so a group is one task; only ids
    and lengths go into it, and texts are joined afterwards.
    """
    groups = groups or []
    a = need.select(*groups, F.col(need_id).cast("string").alias("_id"), F.col(need_words).cast("int").alias("_n"), F.lit(True).alias("_need"))
    b = pool.select(*groups, F.col(pool_id).cast("string").alias("_id"), F.col(pool_words).cast("int").alias("_n"), F.lit(False).alias("_need"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        want, have = pdf[pdf["_need"]].sort_values("_id"), pdf[~pdf["_need"]]
        got = greedy_length_match(want["_n"].tolist(), list(zip(have["_id"], have["_n"], strict=True)), seed)
        return pd.DataFrame({"_need_id": want["_id"].tolist(), "_target": want["_n"].tolist(), "_pool_id": [g[0] for g in got], "fit": [g[1] for g in got]})

    keyed = a.unionByName(b).groupBy(*(groups or [F.lit(0).alias("_all")]))
    chosen = keyed.applyInPandas(match, "_need_id string, _target int, _pool_id string, fit string")
    texts = pool.select(F.col(pool_id).cast("string").alias("_pool_id"), F.col(text).alias("_text"))
    cut = F.when(F.col("fit") == "truncated", tx.truncate_at_sentence(F.col("_text"), F.col("_target"))).otherwise(F.col("_text"))
    return chosen.join(texts, "_pool_id").select(F.col("_need_id").alias(need_id), F.col("_pool_id").alias(f"matched_{pool_id}"), "fit", cut.alias("text"))


def with_features(docs: DataFrame, features: DataFrame, width: int, key: str = "record_id") -> DataFrame:
    """docs with `features` (array of arrays by sentence); zeros where a document or sentence has none."""
    f = features.select(F.col(key).alias("_k"), F.col("features").alias("_f"))
    zero = F.array_repeat(F.lit(0.0), width)
    return docs.join(f, docs[key] == F.col("_k"), "left").withColumn("features", F.transform("sentences", lambda _, i: F.coalesce(F.get("_f", i), zero))).drop("_k", "_f")


def regroup(scores: DataFrame, key: str, index: str, values: list[str]) -> DataFrame:
    """Rows (key, index, values) as one row a key with arrays in the order of the index."""
    items = F.array_sort(F.collect_list(F.struct(index, *values)))
    grouped = scores.groupBy(key).agg(items.alias("_items"))
    return grouped.select(key, *[F.col(f"_items.{v}").alias(v) for v in values])


def sentence_view(docs: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, idx, sentence, label), a row for each sentence."""
    rows = docs.select(key, F.posexplode(F.arrays_zip(F.col("sentences").alias("s"), F.col("labels").alias("y"))).alias("idx", "_x"))
    return rows.select(key, "idx", F.col("_x.s").alias("sentence"), F.col("_x.y").alias("label"))


def missing_cells(rows: DataFrame, columns: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """The cells of a grid of rows by columns (of few rows) that aren't done."""
    return rows.crossJoin(F.broadcast(columns)).join(done, on, "left_anti")


def share_weight(key: Column) -> Column:
    """1 over the number of rows with the same key."""
    return F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(key))

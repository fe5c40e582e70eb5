"""Windows, splits, plans, tasks and other choices, reproducible from a seed and keys."""

from __future__ import annotations

import random


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.config import SPLITS, TYPE1, TYPE2, TYPE3, Config, Construction
from seamline.functions import text as tx
from seamline.functions.draws import between, draw, shuffle_key

_SPANS = "array<struct<start:int,end:int>>"


def global_rank(df: DataFrame, order: list[Column], name: str, buckets: int = 256) -> DataFrame:
    """df with a rank from 1 over all rows by `order`, whose first column must be an md5 string.

    Rows fall into buckets by the digest's first byte, are ranked there, and
    shifted by the sizes of the buckets before: no task sees all rows.
    """
    head = F.conv(F.substring(order[0], 1, 2), 16, 10).cast("int")
    put = df.withColumn("_b", F.floor(head * buckets / 256).cast("int"))
    sizes = put.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # At most `buckets` rows.
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    ranked = put.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return ranked.join(F.broadcast(starts), "_b").withColumn(name, F.col("_r") + F.col("_start")).drop("_b", "_r", "_start")


def make_windows(sources: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Runs of whole sentences of each source, at most per_source of them, next to one another.

    The size is drawn once a source, and so is the offset of the first. Windows with too few words go.
    """
    cfg = cfg or Config()
    w = cfg.windows
    n, key = F.size("sentences"), F.col("source_id")
    size = between(F.lit(w.min_sentences), F.least(F.lit(w.max_sentences), n), f"{cfg.seed}:size", key)
    sized = sources.where(n >= w.min_sentences).withColumn("_size", size.cast("int"))
    sized = sized.withColumn("_k", F.least(F.floor(n / F.col("_size")), F.lit(w.per_source)).cast("int"))
    first = between(F.lit(0), n - F.col("_size") * F.col("_k"), f"{cfg.seed}:offset", key).cast("int")
    each = sized.withColumn("_first", first).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    start = F.col("_first") + F.col("_i") * F.col("_size")
    chunk = F.slice("sentences", start + 1, F.col("_size"))
    cut = each.select(
        F.concat(key, F.lit("_w"), F.col("_i").cast("string")).alias("window_id"), "source_id", "title", "url", "domain",
        start.alias("sent_start"), (start + F.col("_size")).alias("sent_end"), chunk.alias("sentences"),
    )
    texts = cut.withColumn("text", F.array_join("sentences", " "))
    counted = texts.withColumns({"n_sentences": F.size("sentences"), "n_words": tx.word_count(F.col("text"))})
    return counted.where(F.col("n_words") >= w.min_words)


def make_split(ids: DataFrame, key: str = "source_id", cfg: Config | None = None) -> DataFrame:
    """(key, split) for each distinct id: exact shares in shuffled order, what rounding leaves to test."""
    cfg = cfg or Config()
    distinct = ids.select(F.col(key)).distinct().withColumn("_h", shuffle_key(cfg.seed, F.col(key)))
    ranked = global_rank(distinct, [F.col("_h"), F.col(key)], "_rank")
    total = distinct.agg(F.count(F.lit(1)).alias("_n"))
    rows = ranked.join(F.broadcast(total))
    train, dev = F.floor(F.col("_n") * cfg.split[0]), F.floor(F.col("_n") * cfg.split[1])
    split = F.when(F.col("_rank") <= train, SPLITS[0]).when(F.col("_rank") <= train + dev, SPLITS[1]).otherwise(SPLITS[2])
    return rows.select(key, split.alias("split"))


def split_problems(splits: DataFrame, ids: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, problem): ids in several splits, in none, or in a split only."""
    several = splits.groupBy(key).agg(F.countDistinct("split").alias("_n")).where(F.col("_n") > 1).select(key, F.lit("several").alias("problem"))
    none = ids.select(key).distinct().join(splits, key, "left_anti").select(key, F.lit("none").alias("problem"))
    unknown = splits.select(key).distinct().join(ids, key, "left_anti").select(key, F.lit("unknown").alias("problem"))
    return several.unionByName(none).unionByName(unknown)


def plan_type1(n: Column, c: Construction, seed: int | str, *key: Column) -> Column:
    """The index at which the continuation begins, or null where the type doesn't fit."""
    low = F.greatest(F.lit(c.min_human), F.bround(n * c.low).cast("int"))
    high = F.least(n - c.min_machine, F.bround(n * c.high).cast("int"))
    return F.when(n >= c.min_sentences, between(low, high, seed, *key)).cast("int")


def _type2_candidates(n: Column, c: Construction, margin: int) -> Column:
    sizes = F.sequence(F.lit(c.span_min), F.lit(c.span_max))
    fits = F.filter(sizes, lambda s: (s / n >= c.ratio_min) & (s / n <= c.ratio_max))
    low = max(1, margin)
    starts = lambda s: F.when(n - s - max(1, margin) >= low, F.sequence(F.lit(low), F.greatest(n - s - max(1, margin), F.lit(low)))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(fits, lambda s: F.transform(starts(s), lambda a: F.struct(a.alias("start"), (a + s).alias("end")))))


def plan_type2(n: Column, c: Construction, seed: int | str, *key: Column) -> Column:
    """One inner span, with some sentences around it where possible; null where none fits."""
    preferred, relaxed = _type2_candidates(n, c, c.context), _type2_candidates(n, c, 1)
    options = F.when(F.size(preferred) > 0, preferred).otherwise(relaxed)
    pick = F.transform(F.array(options), lambda o: F.when(F.size(o) > 0, F.get(o, (draw(seed, *key) % F.greatest(F.size(o), F.lit(1))).cast("int"))))[0]
    return F.when(n >= c.min_sentences, F.when(pick.isNotNull(), F.array(pick))).cast(_SPANS)


def spans_of_type3(n: int, c: Construction, rng: random.Random, tries: int = 60) -> list[tuple[int, int]] | None:
    """Two or three inner spans apart from one another, or None if no try fits."""
    if n < c.min_sentences:
        return None
    count = rng.randint(c.spans_min, c.spans_max)
    for _ in range(tries):
        found: list[tuple[int, int]] = []
        free = 1
        for left in range(count - 1, -1, -1):
            size = rng.randint(c.span_min, c.span_max)
            last = n - 1 - left * (c.span_min + c.gap) - size
            if free > last:
                break
            start = rng.randint(free, last)
            found.append((start, start + size))
            free = start + size + c.gap
        if len(found) == count and sum(b - a for a, b in found) <= c.ratio_max * n:
            return found
    return None


def plan_type3(c: Construction, seed: int | str):
    """spans_of_type3() as a vectorised function of (n, key)."""

    @F.pandas_udf(_SPANS)
    def run(n: pd.Series, key: pd.Series) -> pd.Series:
        made = [spans_of_type3(int(k), c, random.Random(f"{seed}:{i}")) for k, i in zip(n, key, strict=True)]
        return pd.Series([None if m is None else [{"start": a, "end": b} for a, b in m] for m in made], dtype=object)

    return run


def plans(windows: DataFrame, cfg: Config | None = None, type_column: str = "construction_type") -> DataFrame:
    """windows (with a type) and their plan: boundary_index, spans, targets and their counts. Those that don't fit go."""
    cfg = cfg or Config()
    n, key, kind = F.size("sentences"), F.col("window_id"), F.col(type_column)
    cons = cfg.constructions
    at = F.when(kind == TYPE1, plan_type1(n, cons[TYPE1], f"{cfg.seed}:1", key))
    two = plan_type2(n, cons[TYPE2], f"{cfg.seed}:2", key)
    three = windows.withColumn("_three", plan_type3(cons[TYPE3], f"{cfg.seed}:3")(n, key))
    spans = F.when(kind == TYPE1, F.when(at.isNotNull(), F.array(F.struct(at.alias("start"), n.alias("end")))).cast(_SPANS)).when(kind == TYPE2, two).when(kind == TYPE3, F.col("_three"))
    planned = three.withColumns({"boundary_index": at, "spans": spans}).drop("_three").where(F.col("spans").isNotNull())
    targets = F.transform("spans", lambda x: F.slice("sentences", x["start"] + 1, x["end"] - x["start"]))
    with_targets = planned.withColumn("targets", targets)
    flat = F.flatten("targets")
    return with_targets.withColumns({"target_sentence_count": F.size(flat), "target_word_count": tx.word_count(F.array_join(flat, " "))})


def build_tasks(windows: DataFrame, splits: DataFrame, quotas: dict[str, dict[str, int]], cfg: Config | None = None) -> DataFrame:
    """(window_id, generator, construction_type, split): for each generator, each type in turn takes its quota.

    A type takes the first windows, in the generator's shuffled order, that
    are long enough and that no type before it took. Types depend on one
    another, so a generator is one group; only ids and lengths go into it.
    """
    cfg = cfg or Config()
    pool = windows.select("window_id", "source_id", "n_sentences").join(splits, "source_id").drop("source_id")
    per = []
    for name, wanted in quotas.items():
        g = cfg.generators[name]
        per.append(pool.where(F.col("split").isin(*g.splits)).select(F.lit(name).alias("generator"), "window_id", "n_sentences", "split", shuffle_key(f"{cfg.seed}:{name}", F.col("window_id")).alias("_h")))
    rows = per[0]
    for p in per[1:]:
        rows = rows.unionByName(p)
    needs = {t: c.min_sentences for t, c in cfg.constructions.items()}

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        free = pdf.sort_values(["_h", "window_id"], kind="stable")
        out = []
        for t, want in quotas[pdf["generator"].iloc[0]].items():
            got = free[free["n_sentences"] >= needs[t]].head(want)
            out.append(got.assign(construction_type=t))
            free = free.drop(got.index)
        return pd.concat(out)[["window_id", "generator", "construction_type", "split"]]

    return rows.groupBy("generator").applyInPandas(take, "window_id string, generator string, construction_type string, split string")


def quota_mix(n: int, ratios: dict[str, float]) -> dict[str, int]:
    return {t: int(round(n * r)) for t, r in ratios.items()}


def nested_fraction(rows: DataFrame, key: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """A share of the rows in a fixed shuffled order: smaller shares are inside larger ones."""
    if fraction >= 1:
        return rows
    keyed = rows.withColumn("_h", shuffle_key(f"{seed}:task-order", *[F.col(k) for k in key]))
    ranked = global_rank(keyed, [F.col("_h"), *[F.col(k) for k in key]], "_rank")
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(F.broadcast(total)).where(F.col("_rank") <= F.bround(F.col("_n") * fraction)).drop("_h", "_rank", "_n")


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement."""
    return rows.orderBy(shuffle_key(seed, F.col(key)), key).limit(n)


def head_and_tail(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n // 2 and the last n // 2 rows by `order`."""
    half = n // 2
    return rows.orderBy(*order).limit(half).unionByName(rows.orderBy(*[F.desc(c) for c in order]).limit(half))


def disjoint_halves(rows: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """rows with `half`: eval for the first half of the shuffled groups, train for the rest; no group is in both."""
    groups = rows.select(group).distinct().withColumn("_h", shuffle_key(seed, F.col(group)))
    ranked = global_rank(groups, [F.col("_h"), F.col(group)], "_rank")
    total = groups.agg(F.count(F.lit(1)).alias("_n"))
    half = ranked.join(F.broadcast(total)).select(group, F.when(F.col("_rank") <= F.floor(F.col("_n") / 2), "eval").otherwise("train").alias("half"))
    return rows.join(half, group)


def assemble(planned: DataFrame, new: str = "generated") -> DataFrame:
    """planned documents with generated sentences (array of arrays) in the place of their spans."""
    from seamline.functions import sequences as sq

    made = planned.withColumn("_made", sq.splice(F.col("sentences"), F.col("spans"), F.col(new)))
    out = made.drop("sentences").select("*", F.col("_made.sentences").alias("sentences"), F.col("_made.labels").alias("labels")).drop("_made")
    n = F.size("labels")
    with_b = out.withColumn("boundaries", sq.boundaries(F.col("labels")))
    return with_b.withColumns(
        {
            "text": F.array_join("sentences", " "),
            "boundary_positions_normalized": F.transform("boundaries", lambda b: b / F.size("labels")),
            "boundary_position_normalized": F.get("boundaries", F.lit(0)) / n,
            "ai_sentence_ratio": F.coalesce(F.try_divide(F.aggregate("labels", F.lit(0), lambda s, x: s + x).cast("double"), n.cast("double")), F.lit(0.0)),
        }
    )




def comparison_grid(planned: DataFrame, generators: list[str], column: str = "generator") -> DataFrame:
    """Each plan once for each generator, so that all write the same spans of the same windows."""
    return planned.withColumn(column, F.explode(F.array(*[F.lit(g) for g in generators])))


def human_counterpart(planned: DataFrame, output: str = "human") -> DataFrame:
    """planned with the human text that its spans displace."""
    return planned.withColumn(output, F.array_join(F.flatten("targets"), " "))

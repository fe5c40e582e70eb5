"""Cubes, histograms, quantiles, statistics of runs, and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamline.operators.evaluation import ratio


def cross_tab(rows: DataFrame, by: Sequence[str], column: str, values: Sequence[str], total: str | None = "total") -> DataFrame:
    """Counts by groups, a column for each value in order, zero where there are none, and their sum."""
    out = rows.groupBy(*by).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0, subset=list(values))
    return out.withColumn(total, sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))) if total else out


def violations(rows: DataFrame, generators: DataFrame) -> DataFrame:
    """(generator, split, n) of rows in splits that their generator (generator, splits) must not write to."""
    joined = rows.join(F.broadcast(generators.select("generator", "splits")), "generator")
    return joined.where(~F.array_contains("splits", F.col("split"))).groupBy("generator", "split").agg(F.count(F.lit(1)).alias("n"))


def label_balance(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    ones = F.sum(F.size(F.filter("labels", lambda y: y == 1)))
    n = F.sum(F.size("labels"))
    return docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(n, F.lit(0)).alias("n_sentences"), F.coalesce(ones, F.lit(0)).alias("n_machine"), ratio(ones, n).alias("machine_share"))


def decile_histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, n, share) of values in [0, 1], all bins shown."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(value) * bins)).cast("int")
    counts = rows.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    joined = every.join(counts, "bin", "left").withColumn("n", F.coalesce("_n", F.lit(0)))
    return joined.select("bin", "n", ratio(F.col("n"), F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("share"))


def first_decile_verdict(histogram: DataFrame, most: float = 0.25) -> DataFrame:
    return histogram.where(F.col("bin") == 0).select("share", F.when(F.col("share") < most, "ok").otherwise("skewed").alias("verdict"))


def span_midpoints(docs: DataFrame) -> DataFrame:
    """(midpoint) of every span, as a share of its document."""
    return docs.select(F.explode("spans").alias("_s"), F.size("labels").alias("_n")).select(((F.col("_s.start") + F.col("_s.end")) / 2 / F.col("_n")).alias("midpoint"))


def floor_quantiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The value at place min(n - 1, floor(n * p)) of the sorted values, for each share.

    Ranks come from counts of equal values, so no task or array holds a
    column: distinct values are summed up in order.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = counts.withColumn("_to", F.sum("_n").over(w.orderBy("_v"))).withColumn("_all", F.sum("_n").over(w))
    at = lambda p: F.least(F.col("_all") - 1, F.floor(F.col("_all") * p))
    hit = lambda p: F.min(F.when(F.col("_to") > at(p), F.col("_v")))
    return upto.groupBy(*by).agg(*[hit(p).alias(f"p{round(p * 100):02d}") for p in shares])


def linear_quantiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """n, mean, quantiles by linear interpolation, and the sum."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), *[F.percentile(v, p).alias(f"p{round(p * 100):02d}") for p in shares], F.sum(v).alias("total"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def pass_rates(calls: DataFrame, rejections: DataFrame, key: str = "generator", kinds: Sequence[str] | None = None) -> DataFrame:
    """Calls, rejections, accepted, their rate and cost by generator; with kinds, of these, whether they were called or not."""
    c = calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"))
    r = rejections.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    rejected = F.coalesce("_r", F.lit(0))
    if kinds is not None:
        every = rows_of(calls.sparkSession, key, kinds)
        c = every.join(c, key, "left").select(key, F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("cost_usd", F.lit(0)).alias("cost_usd"))
    return c.join(r, key, "left").select(key, "calls", rejected.alias("rejected"), (F.col("calls") - rejected).alias("accepted"), ratio(F.col("calls") - rejected, F.col("calls")).alias("pass_rate"), "cost_usd")


def rows_of(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    """A column of given strings."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def type_cube(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n): counts by all of by, by its first few, and in all; null where a column is summed over."""
    return rows.rollup(*by).agg(F.count(F.lit(1)).alias("n"))


def rejection_matrix(rejections: DataFrame, kinds: Sequence[str], key: str = "generator") -> DataFrame:
    """Errors by kind (what stands before the colon) and generator."""
    kinded = rejections.select(key, F.explode("errors").alias("_e")).select(key, F.substring_index("_e", ":", 1).alias("kind"))
    return kinded.groupBy("kind").pivot(key, list(kinds)).agg(F.count(F.lit(1))).fillna(0)


def extrapolated_cost(costs: DataFrame, targets: DataFrame, key: str = "generator") -> DataFrame:
    """cost per document times the target, by generator, and a row of the total (null key)."""
    each = costs.join(targets, key).withColumn("projected", ratio(F.col("cost_usd"), F.col("n_docs")) * F.col("target"))
    return each.rollup(key).agg(F.sum("target").alias("target"), F.sum("projected").alias("projected_usd"))


def round_robin(rows: DataFrame, kind: str, kinds: Sequence[str], order: Sequence[str], n: int = 5) -> DataFrame:
    """n rows that take kinds in turn."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    turn = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).withColumn("_k", rank)
    return turn.where((F.col("_rn") <= n) & (F.col("_k") > 0)).orderBy("_rn", "_k").limit(n).drop("_rn", "_k")


def length_fidelity(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean differences of words and sentences from their targets, and retries, over what was produced; how many were."""
    d = F.col("n_words") - F.col("target_words")
    s = F.col("n_sentences") - F.col("target_sentences")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count("n_words").alias("produced"), F.avg(d).alias("mean_word_delta"), F.avg(F.abs(d)).alias("mean_abs_word_delta"),
        F.avg(s).alias("mean_sentence_delta"), F.avg(F.when(F.col("n_words").isNotNull(), F.coalesce("retries", F.lit(0)))).alias("mean_retries"),
    )


def seed_stats(runs: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean and sample deviation (0 for one run); null if any run lacks the value."""
    v = F.when(F.isnan(value), None).otherwise(F.col(value))
    whole = F.count(v) == F.count(F.lit(1))
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(whole, F.avg(v)).alias("mean"), F.when(whole, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("sd"))


def paired_differences(a: DataFrame, b: DataFrame, on: Sequence[str] = ("metric", "seed"), by: Sequence[str] = ("metric",)) -> DataFrame:
    """b - a over runs paired by seed: mean, sample deviation, and how many are better (by higher_better of a)."""
    joined = a.select(*on, "higher_better", F.col("value").alias("_a")).join(b.select(*on, F.col("value").alias("_b")), list(on))
    d = F.col("_b") - F.col("_a")
    won = F.when(F.col("higher_better"), d > 0).otherwise(d < 0)
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd_diff"), F.count_if(won).alias("wins"))


def metric_change(raw: DataFrame, normalized: DataFrame, on: Sequence[str] = ("metric",)) -> DataFrame:
    """(metric, raw, normalized, change)."""
    joined = raw.select(*on, F.col("value").alias("raw")).join(normalized.select(*on, F.col("value").alias("normalized")), list(on))
    return joined.withColumn("change", F.col("normalized") - F.col("raw"))


def cohens_d(rows: DataFrame, value: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(mean1 - mean0) over the root of the mean of population variances; 0 where that is 0."""
    one, zero = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    sd = F.sqrt((F.var_pop(one) + F.var_pop(zero)) / 2)
    return rows.groupBy(*by).agg(F.count(zero).alias("n0"), F.count(one).alias("n1"), F.coalesce(F.when(sd > 0, (F.avg(one) - F.avg(zero)) / sd), F.lit(0.0)).alias("d"))


def adjacency_probe(rows: DataFrame, doc: str, index: str, value: str, label: str, level: float = 0.2, jump: float = 0.15) -> DataFrame:
    """One row: Cohen's d of a feature between labels, and of its step from the neighbour where the label changes or not."""
    w = Window.partitionBy(doc).orderBy(index)
    step = rows.select(value, label, F.abs(F.col(value) - F.lag(value).over(w)).alias("_step"), (F.col(label) != F.lag(label).over(w)).cast("int").alias("_changed"))
    a = cohens_d(step, value, label).select(F.col("d").alias("level_d"))
    b = cohens_d(step.where(F.col("_changed").isNotNull()), "_step", "_changed").select(F.col("d").alias("jump_d"))
    return a.crossJoin(b).withColumn("useful", (F.abs("level_d") > level) | (F.abs("jump_d") > jump))  # one row each


def scaler(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column, deviations under 1e-6 as 1."""
    sd = lambda c: F.when(F.stddev_pop(c) < 1e-6, 1.0).otherwise(F.stddev_pop(c))
    return rows.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[sd(c).alias(f"{c}_sd") for c in columns])


def scaled(rows: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows standardised by scaler()'s one row."""
    out = rows.crossJoin(F.broadcast(fitted)).withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in columns})
    return out.select(*rows.columns)


def class_weights(docs: DataFrame) -> DataFrame:
    """One row: n / (2 n_c) for labels 0 and 1 over all sentences."""
    ones = F.sum(F.size(F.filter("labels", lambda y: y == 1)))
    zeros = F.sum(F.size(F.filter("labels", lambda y: y == 0)))
    return docs.agg(ratio(ones + zeros, 2 * zeros).alias("weight_0"), ratio(ones + zeros, 2 * ones).alias("weight_1"))


def surface_table(rows: DataFrame, sentence: str, label: str) -> DataFrame:
    """(feature, label, raw, normalized): how often each surface feature is there, before and after normalising."""
    from seamline.functions.text import normalize_surface, surface_features

    both = [(k, v, surface_features(normalize_surface(F.col(sentence)))[k]) for k, v in surface_features(F.col(sentence)).items()]
    items = F.array(*[F.struct(F.lit(k).alias("feature"), a.cast("double").alias("raw"), b.cast("double").alias("normalized")) for k, a, b in both])
    each = rows.select(F.col(label).alias("label"), F.explode(items).alias("_x")).select("label", "_x.*")
    return each.groupBy("feature", "label").agg(F.avg("raw").alias("raw"), F.avg("normalized").alias("normalized"))


def running_usage(log: DataFrame, by: Sequence[str], order: Sequence[str] = ("ts",)) -> DataFrame:
    """log with running calls, tokens and cost."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumns(
        {"running_calls": F.count(F.lit(1)).over(w), "running_tokens": F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).over(w), "running_total_usd": F.sum("cost_usd").over(w)}
    )


def release_groups(records: DataFrame) -> DataFrame:
    """(window_id, split, passage_ids): windows with the records made of them; raises if one is in several splits."""
    g = records.groupBy("window_id").agg(F.countDistinct("split").alias("_n"), F.first("split").alias("split"), F.array_sort(F.collect_list("record_id")).alias("passage_ids"))
    split = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("window "), F.col("window_id"), F.lit(" spans several splits")))).otherwise(F.col("split"))
    return g.select("window_id", split.alias("split"), "passage_ids")


def corpus_report(docs: DataFrame, by: Sequence[str] = ("domain", "generator")) -> DataFrame:
    """Documents, boundaries at either end and mean place by group; docs: boundary, n_words."""
    return docs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("boundary") == 0).alias("at_start"), F.count_if(F.col("boundary") >= F.col("n_words")).alias("at_end"),
        F.avg(ratio(F.col("boundary"), F.col("n_words"))).alias("mean_place"),
    )


def observed(rows: DataFrame, name: str, **counts: Column):
    """(rows, observation): counts that are there once an action has run over rows."""
    from pyspark.sql import Observation

    o = Observation(name)
    return rows.observe(o, *[v.alias(k) for k, v in counts.items()]), o


def word_class_weights(docs: DataFrame, text: str = "text", boundary: str = "boundary") -> DataFrame:
    """One row: n / (2 n_c) for labels 0 and 1 over the words that have a token."""
    from seamline.functions import sequences as sq
    from seamline.functions.text import task_words, tokenless

    w = task_words(F.col(text))
    labels = F.zip_with(w, sq.labels_from_boundary(F.size(w), F.col(boundary)), lambda x, y: F.when(~tokenless(x), y))
    return class_weights(docs.select(F.filter(labels, lambda y: y.isNotNull()).alias("labels")))


def metric_values(rows: DataFrame, payload: str, paths: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., metric, value) of nested keys (a.b.c) in JSON payloads; a missing key is null."""
    items = F.array(*[F.struct(F.lit(k).alias("metric"), F.get_json_object(payload, "$." + p).cast("double").alias("value")) for k, p in paths.items()])
    return rows.select(*keep, F.explode(items).alias("_x")).select(*keep, "_x.*")

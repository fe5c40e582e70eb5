"""Scores of predictions at sentences, boundaries, twins and words, for any grouping, and over grids of thresholds.

Rows are documents with `labels` and `pred` as arrays; counts are taken within
a row and summed, so a metric is one aggregate however long documents are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions import sequences as sq
from seamline.functions import text as tx


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where a denominator is."""
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def _cells(y: str = "labels", p: str = "pred") -> dict[str, Column]:
    """Confusion counts of a document."""
    zipped = F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))
    count = lambda a, b: F.size(F.filter(zipped, lambda x: (x["y"] == a) & (x["p"] == b)))
    return {"_tp": count(1, 1), "_fp": count(0, 1), "_fn": count(1, 0), "_tn": count(0, 0)}


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by)


def sentence_metrics(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy, precision, recall and F1 of label 1, macro F1 and support."""
    cells = docs.withColumns(_cells())
    sums = _grouped(cells, by).agg(*[_total(F.col(c)).alias(c) for c in ("_tp", "_fp", "_fn", "_tn")])
    tp, fp, fn, tn = (F.col(c) for c in ("_tp", "_fp", "_fn", "_tn"))
    p, r, f = prf(tp, fp, fn)
    f0 = prf(tn, fn, fp)[2]
    n = tp + fp + fn + tn
    return sums.select(
        *by, n.alias("n"), ratio(tp + tn, n).alias("accuracy"), p.alias("precision_ai"), r.alias("recall_ai"), f.alias("f1_ai"),
        ((f + f0) / 2).alias("macro_f1"), (tp + fn).alias("support_ai"),
    )


def boundary_metrics(docs: DataFrame, by: Sequence[str] = (), tolerance: int = 0) -> DataFrame:
    """Micro-averaged precision, recall and F1 of boundaries, and the share of documents with all of them exact."""
    b = docs.withColumns({"_g": sq.boundaries(F.col("labels")), "_p": sq.boundaries(F.col("pred"))})
    b = b.withColumns({"_hits": sq.match_boundaries(F.col("_g"), F.col("_p"), tolerance), "_same": (F.col("_g") == F.col("_p")).cast("int")})
    sums = _grouped(b, by).agg(F.count(F.lit(1)).alias("n_docs"), _total(F.size("_g")).alias("gold"), _total(F.size("_p")).alias("predicted"), _total(F.col("_hits")).alias("_tp"), _total(F.col("_same")).alias("_exact"))
    p, r, f = prf(F.col("_tp"), F.greatest(F.col("predicted") - F.col("_tp"), F.lit(0)), F.greatest(F.col("gold") - F.col("_tp"), F.lit(0)))
    return sums.select(
        *by, "n_docs", "gold", "predicted", p.alias("precision"), r.alias("recall"), f.alias("f1"),
        ratio(F.col("_exact"), F.col("n_docs")).alias("exact_doc_match"), F.lit(tolerance).alias("tolerance"),
    )


def evaluate(docs: DataFrame, by: Sequence[str] = (), tolerance: int = 1) -> DataFrame:
    """struct columns sentence, boundary_exact and boundary_tol, a row for each group."""
    parts = {"sentence": sentence_metrics(docs, by), "boundary_exact": boundary_metrics(docs, by, 0), "boundary_tol": boundary_metrics(docs, by, tolerance)}
    packed = [d.select(*by, F.struct(*[c for c in d.columns if c not in by]).alias(k)) for k, d in parts.items()]
    out = packed[0]
    for d in packed[1:]:
        out = out.join(d, list(by)) if by else out.crossJoin(d)  # one row each
    return out


def sliced(docs: DataFrame, column: str, metric, total: str = "overall") -> DataFrame:
    """A metric over all documents and for each value of a column, as rows of (slice, ...)."""
    both = docs.withColumn("slice", F.explode(F.array(F.lit(total), F.col(column).cast("string"))))
    return metric(both, ["slice"])


def human_metrics(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False alarms on documents without label 1."""
    p = F.col("pred")
    return _grouped(docs, by).agg(
        F.count(F.lit(1)).alias("n_docs"), _total(F.size(p)).alias("n_sentences"),
        F.coalesce(F.avg(F.array_contains(p, 1).cast("double")), F.lit(0.0)).alias("doc_false_alarm"),
        F.coalesce(F.avg(F.size(sq.boundaries(p)).cast("double")), F.lit(0.0)).alias("boundaries_per_doc"),
        ratio(F.sum(F.size(F.filter(p, lambda x: x == 1))), F.sum(F.size(p))).alias("sentence_fpr"),
    )


def unique_windows(pairs: DataFrame, order: Sequence[str], key: str = "window_id", by: Sequence[str] = ()) -> DataFrame:
    """The first row of each window by `order`."""
    return pairs.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))).where(F.col("_rn") == 1).drop("_rn")


def twin_metrics(pairs: DataFrame, order: Sequence[str] = ("record_id",), by: Sequence[str] = ()) -> DataFrame:
    """How predictions change between documents and their twins.

    pairs: window_id, labels, pred, proba, twin_pred, twin_proba. Rates over
    twins count each window once (the pairs marked by a column _first, if there
    is one); paired rates count every pair.
    """
    once = pairs.where("_first") if "_first" in pairs.columns else unique_windows(pairs, order, by=by)
    uniq = once.select(*by, F.transform("twin_pred", lambda _: F.lit(0)).alias("labels"), F.col("twin_pred").alias("pred"))
    h = human_metrics(uniq, by)
    z = F.arrays_zip(F.col("labels").alias("y"), F.col("pred").alias("a"), F.col("twin_pred").alias("b"), F.col("proba").alias("p"), F.col("twin_proba").alias("q"))
    count = lambda f: _total(F.size(F.filter(z, f)))
    paired = _grouped(pairs, by).agg(
        count(lambda x: x["y"] == 1).alias("_ai"), count(lambda x: x["y"] != 1).alias("_ctx"),
        count(lambda x: (x["y"] == 1) & (x["p"] > x["q"])).alias("_wins"),
        count(lambda x: (x["y"] == 1) & (x["a"] == 1) & (x["b"] == 0)).alias("_flips"),
        count(lambda x: (x["y"] != 1) & (x["a"] == x["b"])).alias("_stable"),
    )
    combined = boundary_metrics(pairs.select(*by, "labels", "pred").unionByName(uniq), by, 0).select(
        *by, F.col("precision").alias("combined_boundary_precision"), F.col("recall").alias("combined_boundary_recall"), F.col("f1").alias("combined_boundary_f1"), F.col("exact_doc_match").alias("combined_doc_exact"),
    )
    join = (lambda a, b: a.join(b, list(by))) if by else (lambda a, b: a.crossJoin(b))  # one row each without groups
    rows = join(join(h, paired), combined)
    return rows.select(
        *by, F.col("n_docs").alias("n_twins"), "doc_false_alarm", F.col("boundaries_per_doc").alias("boundaries_per_twin"), "sentence_fpr",
        ratio(F.col("_wins"), F.col("_ai")).alias("paired_win_rate"), ratio(F.col("_flips"), F.col("_ai")).alias("paired_flip_rate"),
        ratio(F.col("_stable"), F.col("_ctx")).alias("context_stability"),
        "combined_boundary_precision", "combined_boundary_recall", "combined_boundary_f1", "combined_doc_exact",
    )


def at_thresholds(docs: DataFrame, scores: dict[str, str], grid: Sequence[float] = sq.GRID) -> DataFrame:
    """docs once for each threshold of the grid, with labels from scores; scores: output column to score column."""
    t = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("threshold")
    out = docs.select("*", t)
    return out.withColumns({k: sq.threshold_labels(F.col(v), F.col("threshold")) for k, v in scores.items()})


def threshold_sweep(pairs: DataFrame, grid: Sequence[float] = sq.GRID, order: Sequence[str] = ("record_id",)) -> DataFrame:
    """Boundary and twin metrics at every threshold, from cached scores. Windows are told apart before pairs are multiplied."""
    pairs = pairs.withColumn("_first", F.row_number().over(Window.partitionBy("window_id").orderBy(*order)) == 1)
    each = at_thresholds(pairs, {"pred": "proba", "twin_pred": "twin_proba"}, grid)
    mixed = boundary_metrics(each, ["threshold"], 0).select("threshold", F.col("f1").alias("mixed_f1"), F.col("exact_doc_match").alias("mixed_doc_exact"))
    twin = twin_metrics(each, order, ["threshold"]).select("threshold", F.col("doc_false_alarm").alias("false_alarm"), "boundaries_per_twin", "sentence_fpr", "combined_boundary_f1")
    return mixed.join(twin, "threshold")


def bias_sweep(docs: DataFrame, logp: str = "logp", pair: str = "pair", grid: Sequence[float] = sq.BIASES) -> DataFrame:
    """Exact boundary metrics of Viterbi decoding at every bias."""
    each = docs.withColumn("bias", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return boundary_metrics(each.withColumn("pred", sq.viterbi(F.col(logp), F.col(pair), F.col("bias"))), ["bias"], 0)


def best_row(rows: DataFrame, value: str, order: str, highest: bool = True, where: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The row with the best value, the first by `order` of equals; no row if none meets the condition."""
    kept = rows if where is None else rows.where(where)
    everything = F.struct(*rows.columns)
    key = F.struct(F.col(value), -F.col(order)) if highest else F.struct(F.col(value), F.col(order))
    pick = (F.max_by if highest else F.min_by)(everything, key)
    return _grouped(kept, by).agg(pick.alias("_best")).where(F.col("_best").isNotNull()).select("_best.*")


def matched_alarm(sweep: DataFrame, levels: Sequence[float], value: str = "f1", alarm: str = "false_alarm", grid: str = "threshold") -> DataFrame:
    """(level, grid, value): the best point of a sweep whose alarm is at most each level, the least of equals; null without one."""
    at = sweep.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level"))
    # A few levels by a few points.
    pairs = at.join(F.broadcast(sweep), F.col(alarm) <= F.col("level"), "left")
    best = pairs.groupBy("level").agg(F.max_by(F.struct(grid, value), F.struct(value, -F.col(grid))).alias("_x"))
    return best.select("level", F.col(f"_x.{grid}").alias(grid), F.col(f"_x.{value}").alias(value))


def operating_point(dev: DataFrame, others: dict[str, DataFrame], value: str, grid: str = "threshold") -> DataFrame:
    """The point of the grid that is best on dev, with every other set's row there as a struct."""
    out = best_row(dev, value, grid).select(grid, F.struct(*dev.columns).alias("dev"))
    for name, rows in others.items():
        out = out.join(rows.select(grid, F.struct(*rows.columns).alias(name)), grid, "left")
    return out


def choose_decoder(threshold: dict[str, float], viterbi: dict[str, float], gap: float = 0.005) -> str:
    """The decoder with the better boundary F1; within the gap, by exact documents, and then the threshold."""
    d = viterbi["f1"] - threshold["f1"]
    if abs(d) >= gap:
        return "viterbi" if d > 0 else "threshold"
    return "viterbi" if viterbi["exact_doc_match"] > threshold["exact_doc_match"] else "threshold"


# ------------------------------------------------------------------ words


def with_word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words (task words) and gold (the boundary clipped to it)."""
    n = F.size(tx.task_words(F.col(text)))
    return docs.withColumn("n_words", n).withColumn("gold", F.least(F.col("boundary"), F.col("n_words")))


def word_metrics(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, mean absolute error and share of exact boundaries; docs: gold, pred."""
    e = F.abs(F.col("pred") - F.col("gold"))
    return _grouped(docs, by).agg(F.count(F.lit(1)).alias("n"), F.avg(e.cast("double")).alias("mae"), F.avg((e == 0).cast("double")).alias("exact"))


def word_metrics_by(docs: DataFrame) -> DataFrame:
    """word_metrics() of everything, by domain, and by domain and generator: (kind, key, ...)."""
    kinds = F.array(
        F.struct(F.lit("overall").alias("kind"), F.lit("").alias("key")),
        F.struct(F.lit("by_domain").alias("kind"), F.col("domain").alias("key")),
        F.struct(F.lit("by_generator").alias("kind"), F.concat_ws("/", "domain", "generator").alias("key")),
    )
    each = docs.select("gold", "pred", F.explode(kinds).alias("_k")).select("gold", "pred", "_k.*")
    return word_metrics(each, ["kind", "key"])


def word_human_metrics(docs: DataFrame, threshold: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """False alarms of word decoders on human documents; docs: n_words, pred, and probs if a threshold is given."""
    if threshold is None:
        flagged = (F.col("n_words") - F.col("pred")) / F.col("n_words")
    else:
        p = F.col("probs")
        y = sq.fill_labels(sq.threshold_labels(p, threshold), F.transform(p, lambda x: x.isNotNull()), "prev")
        flagged = F.aggregate(y, F.lit(0), lambda s, x: s + x) / F.size(y)
    return _grouped(docs, by).agg(F.count(F.lit(1)).alias("n_docs"), F.avg((F.col("pred") < F.col("n_words")).cast("double")).alias("false_alarm"), F.avg(flagged).alias("frac_flagged"))


def deployment(mixed: DataFrame, human: DataFrame) -> DataFrame:
    """One row: is the presence of machine words told, over mixed (gold, pred, n_words) and human (pred, n_words) documents."""
    rows = mixed.select((F.col("gold") < F.col("n_words")).alias("_g"), (F.col("pred") < F.col("n_words")).alias("_p"), F.abs(F.col("pred") - F.col("gold")).alias("_e"), F.lit(True).alias("_m"))
    rows = rows.unionByName(human.select(F.lit(False).alias("_g"), (F.col("pred") < F.col("n_words")).alias("_p"), F.lit(None).cast("int").alias("_e"), F.lit(False).alias("_m")))
    found = F.avg(F.when(F.col("_m") & F.col("_g"), F.col("_p").cast("double")))
    quiet = 1 - F.avg(F.when(~F.col("_m"), F.col("_p").cast("double")))
    return rows.agg(
        F.count_if("_m").alias("n_mixed"), F.count_if(~F.col("_m")).alias("n_human"), F.avg((F.col("_g") == F.col("_p")).cast("double")).alias("presence_accuracy"),
        found.alias("mixed_detected"), quiet.alias("human_quiet"), ((found + quiet) / 2).alias("balanced_accuracy"), F.avg("_e").alias("mae_mixed"),
    )


def forced_error(docs: DataFrame, rule: str, text: str = "text") -> DataFrame:
    """The error that the rule for tokenless words leaves when all other words are right: one row."""
    w = tx.task_words(F.col(text))
    has = F.transform(w, lambda x: ~tx.tokenless(x))
    b = F.least(F.col("boundary"), F.size(w))
    pred = sq.first_boundary(sq.fill_labels(sq.labels_from_boundary(F.size(w), F.col("boundary")), has, rule))
    e = F.abs(pred - b)
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(e.cast("double")).alias("mae"), F.count_if(e > 0).alias("n_wrong"))


def word_sweep(docs: DataFrame, grid: Sequence[float] = sq.GRID, by: Sequence[str] = ()) -> DataFrame:
    """word_metrics() of the first-word rule at every threshold; docs: gold, probs. One pass over a document's words."""
    curve = docs.select(*by, "gold", F.posexplode(sq.first_word_curve(F.col("probs"), list(grid))).alias("_i", "pred"))
    t = F.get(F.array(*[F.lit(float(g)) for g in grid]), F.col("_i"))
    return word_metrics(curve.withColumn("threshold", t), [*by, "threshold"])


def word_alarm_sweep(docs: DataFrame, grid: Sequence[float] = sq.GRID) -> DataFrame:
    """(threshold, false_alarm) of human documents (probs)."""
    curve = docs.select(F.size("probs").alias("n_words"), F.posexplode(sq.first_word_curve(F.col("probs"), list(grid))).alias("_i", "pred"))
    t = F.get(F.array(*[F.lit(float(g)) for g in grid]), F.col("_i"))
    return curve.withColumn("threshold", t).groupBy("threshold").agg(F.avg((F.col("pred") < F.col("n_words")).cast("double")).alias("false_alarm"))


# -------------------------------------------------------------- twin loss


def twin_loss_terms(rows: DataFrame, mixed: str = "mixed", twin: str = "twin", labels: str = "labels", margin: float = 1.0) -> DataFrame:
    """rows with the terms of the paired loss, from logits array<struct<h, m>>: ce, margin_loss and consistency.

    ce: mean cross entropy of the mixed document. margin_loss: over sentences
    labelled 1, how far the machine log-odds fall short of the twin's plus the
    margin. consistency: mean symmetric divergence over sentences labelled 0.
    """
    log_p = lambda x, k: x[k] - (F.greatest(x["h"], x["m"]) + F.log1p(F.exp(-F.abs(x["h"] - x["m"]))))
    z = F.arrays_zip(F.col(mixed).alias("a"), F.col(twin).alias("b"), F.col(labels).alias("y"))
    mean = lambda arr: F.coalesce(F.try_divide(F.aggregate(arr, F.lit(0.0), lambda s, x: s + x), F.size(arr).cast("double")), F.lit(0.0))
    odds = lambda x: x["m"] - x["h"]
    ce = mean(F.transform(z, lambda x: -F.when(x["y"] == 1, log_p(x["a"], "m")).otherwise(log_p(x["a"], "h"))))
    gap = mean(F.transform(F.filter(z, lambda x: x["y"] == 1), lambda x: F.greatest(F.lit(0.0), F.lit(margin) - (odds(x["a"]) - odds(x["b"])))))

    def divergence(x: Column) -> Column:
        out = F.lit(0.0)
        for k in ("h", "m"):
            p, q = log_p(x["a"], k), log_p(x["b"], k)
            out = out + (F.exp(p) - F.exp(q)) * (p - q)
        return out / 2

    return rows.withColumns({"ce": ce, "margin_loss": gap, "consistency": mean(F.transform(F.filter(z, lambda x: x["y"] == 0), divergence))})

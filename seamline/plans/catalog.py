"""Queries over the driver's tables, each with the SQL that says the same.

Roles: `events` are labelled sequences, one for each user in order of time;
`documents` are articles; `benchmark` is the reference for leakage; `pages` has
markup; `labels` has classes; `conversations` has ordered context.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.config import TYPE1, TYPE2, Config, Construction
from seamline.functions import sequences as sq
from seamline.functions import text as tx
from seamline.operators import aggregates as ag
from seamline.operators import evaluation as ev
from seamline.operators import matching as ma
from seamline.operators import pages as pg
from seamline.operators import sampling as sa
from seamline.sources import jsonl

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Sequences of the SQL side: place, length, gold and predicted label, and a score that is null for some words.
_E = """e AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
         (event_type IN ('error', 'purchase'))::INT AS y, (value > 100)::INT AS p, value,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / (value + 100.0) END AS s
  FROM events)"""
_B = """b AS (
  SELECT *, (i > 0 AND y <> lag(y) OVER w)::INT AS gb, (i > 0 AND p <> lag(p) OVER w)::INT AS pb
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i))"""


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, labels, pred, values, scores), a row for each user."""
    e = table(spark, sf_dir, "events")
    y, p = F.col("event_type").isin("error", "purchase").cast("int"), (F.col("value") > 100).cast("int")
    s = F.when(F.col("event_id") % 7 != 0, F.col("value") / (F.col("value") + 100.0))
    items = F.array_sort(F.collect_list(F.struct("ts", "event_id", y.alias("y"), p.alias("p"), F.col("value").alias("v"), s.alias("s"))))
    g = e.groupBy("user_id").agg(items.alias("_z"))
    return g.select("user_id", *[F.col(f"_z.{k}").alias(n) for k, n in (("y", "labels"), ("p", "pred"), ("v", "values"), ("s", "scores"))])


# ------------------------------------------------------------- sequences


@query(f"WITH {_E}, {_B} SELECT user_id, max(n)::INT AS n, sum(gb)::INT AS n_boundaries, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (gb = 1), '') AS boundaries FROM b GROUP BY user_id")
def boundaries_per_sequence(spark, sf_dir):
    b = sequences(spark, sf_dir).select("user_id", F.size("labels").alias("n"), sq.boundaries(F.col("labels")).alias("_b"))
    return b.select("user_id", "n", F.size("_b").alias("n_boundaries"), joined(F.col("_b")).alias("boundaries"))


@query(f"""WITH {_E}, {_B}, g AS (SELECT *, sum(gb) OVER (PARTITION BY user_id ORDER BY i) AS island FROM b)
SELECT user_id, min(i)::INT AS span_start, (max(i) + 1)::INT AS span_end FROM g WHERE y = 1 GROUP BY user_id, island""")
def runs_spans(spark, sf_dir):
    return sequences(spark, sf_dir).select("user_id", F.explode(sq.spans(F.col("labels"))).alias("_s")).select("user_id", F.col("_s.start").alias("span_start"), F.col("_s.end").alias("span_end"))


@query(f"""WITH {_E}, {_B} SELECT user_id, round(min(CASE WHEN gb = 1 THEN i::DOUBLE / n END), 6) AS first_normalized, round(coalesce(sum(CASE WHEN gb = 1 THEN i::DOUBLE / n END), 0), 6) AS sum_normalized
FROM b GROUP BY user_id""")
def boundary_positions_norm(spark, sf_dir):
    p = sequences(spark, sf_dir).select("user_id", sq.normalized(sq.boundaries(F.col("labels")), F.size("labels")).alias("_p"))
    return p.select("user_id", r6(F.get("_p", F.lit(0))).alias("first_normalized"), r6(F.aggregate("_p", F.lit(0.0), lambda s, x: s + x)).alias("sum_normalized"))


@query(f"WITH {_E} SELECT user_id, i::INT AS idx, round(i::DOUBLE / greatest(n - 1, 1), 6) AS place, least(9, floor(i::DOUBLE / greatest(n - 1, 1) * 10))::INT AS bin FROM e")
def normalized_position(spark, sf_dir):
    s = sequences(spark, sf_dir).select("user_id", F.size("labels").alias("_n"), F.posexplode(sq.positions(F.col("labels"))).alias("idx", "_p"))
    return s.select("user_id", "idx", r6(F.col("_p")).alias("place"), sq.position_bin(F.col("idx"), F.col("_n")).alias("bin"))


@query(f"WITH {_E} SELECT user_id, i::INT AS idx, y AS label, p AS pred FROM e")
def sentence_view(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumnRenamed("pred", "sentences")
    return ma.sentence_view(s, "user_id").withColumnRenamed("sentence", "pred")


@query(f"""WITH {_E} SELECT user_id, i::INT AS idx,
  round(value - coalesce(lag(value) OVER w, value), 6) AS to_previous, round(value - coalesce(lead(value) OVER w, value), 6) AS to_next,
  (i = 0)::DOUBLE AS is_first, (i = n - 1)::DOUBLE AS is_last
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def neighbour_deltas(spark, sf_dir):
    f = F.transform("values", lambda v: F.array(v))
    d = sequences(spark, sf_dir).select("user_id", F.posexplode(sq.neighbour_deltas(f, 0, 0)).alias("idx", "_d"))
    at = lambda i: F.get("_d", F.lit(i))
    return d.select("user_id", "idx", r6(at(0)).alias("to_previous"), r6(at(1)).alias("to_next"), at(4).alias("is_first"), at(5).alias("is_last"))


@query("""SELECT conv_id, turn, concat_ws(' ', lag(text) OVER w, lead(text) OVER w) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_window(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    made = c.select("conv_id", "_t", sq.context(F.transform("_t", lambda x: x["text"]), 1).alias("_c"))
    return made.select("conv_id", F.explode(F.arrays_zip(F.col("_t").alias("t"), F.col("_c").alias("c"))).alias("_x")).select("conv_id", F.col("_x.t.turn").alias("turn"), F.col("_x.c").alias("context"))


@query(f"""WITH {_E}, c AS (SELECT *, (i = 0 OR p <> lag(p) OVER w)::INT AS edge FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)),
r AS (SELECT user_id, p, run, count(*) AS len, min(i) AS a, max(i) AS z, max(n) AS n FROM (SELECT *, sum(edge) OVER (PARTITION BY user_id ORDER BY i) AS run FROM c) GROUP BY user_id, p, run),
k AS (SELECT *, CASE WHEN len >= 3 OR a = 0 OR z = n - 1 THEN p END AS kept FROM r),
f AS (SELECT *, last_value(kept IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY run) AS out FROM k)
SELECT user_id, string_agg(repeat(out::VARCHAR, len::INT), '' ORDER BY run) AS smoothed FROM f GROUP BY user_id""")
def run_smoothing(spark, sf_dir):
    s = sq.smooth_runs(F.col("pred"), 3)
    return sequences(spark, sf_dir).select("user_id", F.array_join(F.transform(s, lambda x: x.cast("string")), "").alias("smoothed"))


@query(f"""WITH {_E}, f AS (
  SELECT user_id, i, CASE WHEN s >= 0.5 THEN 1 WHEN s IS NOT NULL THEN 0 END AS l FROM e),
g AS (SELECT user_id, i, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i), first_value(l IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS prev,
  coalesce(first_value(l IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(l IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i), 0) AS nxt FROM f)
SELECT user_id, string_agg(prev::VARCHAR, '' ORDER BY i) AS filled_prev, string_agg(nxt::VARCHAR, '' ORDER BY i) AS filled_next FROM g GROUP BY user_id""")
def label_fill(spark, sf_dir):
    s = sequences(spark, sf_dir)
    y, has = sq.threshold_labels(F.col("scores"), 0.5), F.transform("scores", lambda x: x.isNotNull())
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "")
    return s.select("user_id", text(sq.fill_labels(y, has, "prev")).alias("filled_prev"), text(sq.fill_labels(y, has, "next")).alias("filled_next"))


_FIRST = """CASE WHEN min(i) FILTER (s >= t) = min(i) FILTER (s IS NOT NULL) THEN 0 ELSE coalesce(min(i) FILTER (s >= t), max(n)) END"""


@query(f"WITH {_E}, t AS (SELECT *, 0.6::DOUBLE AS t FROM e) SELECT user_id, max(n)::INT AS n, ({_FIRST})::INT AS boundary FROM t GROUP BY user_id")
def first_word(spark, sf_dir):
    return sequences(spark, sf_dir).select("user_id", F.size("scores").alias("n"), sq.first_word(F.col("scores"), 0.6).alias("boundary"))


@query(f"""WITH {_E}, t AS (SELECT e.*, g.k AS k, round(0.05 + 0.025 * k, 3)::DOUBLE AS t FROM e CROSS JOIN range(37) g(k)),
d AS (SELECT user_id, k, ({_FIRST}) AS boundary, coalesce(min(i) FILTER (y = 1), max(n)) AS gold FROM t GROUP BY user_id, k)
SELECT round(0.05 + 0.025 * k, 3)::DOUBLE AS threshold, count(*)::BIGINT AS n, round(avg(abs(boundary - gold)), 6) AS mae, round(avg((boundary = gold)::INT), 6) AS exact FROM d GROUP BY k""")
def first_word_sweep(spark, sf_dir):
    docs = sequences(spark, sf_dir).select(sq.first_boundary(F.col("labels")).alias("gold"), F.col("scores").alias("probs"))
    return ev.word_sweep(docs).select("threshold", "n", r6(F.col("mae")).alias("mae"), r6(F.col("exact")).alias("exact"))


@query(f"""WITH {_E}, w AS (SELECT user_id, i, n, greatest(least(s, 1 - 1e-6), 1e-6) AS q FROM e WHERE s IS NOT NULL),
c AS (SELECT user_id, i, n, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS k,
  coalesce(sum(ln(1 - q)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(ln(q)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS score FROM w),
z AS (SELECT user_id, n AS i, max(n) AS n, count(*) AS k, sum(ln(1 - q)) AS score FROM w GROUP BY user_id, n),
u AS (SELECT user_id, i, k, score FROM c UNION ALL SELECT user_id, i, k, score FROM z)
SELECT user_id, arg_max(i, round(score, 9) * 1000000 - k)::INT AS change FROM u GROUP BY user_id""")
def change_point(spark, sf_dir):
    return sequences(spark, sf_dir).select("user_id", sq.change_point(F.col("scores")).alias("change"))


@query()
def viterbi_decode(spark, sf_dir):
    s = sequences(spark, sf_dir)
    p = lambda v: F.greatest(F.least(v / (v + 100.0), F.lit(0.999999)), F.lit(1e-6))
    logp = F.transform("values", lambda v: F.struct(F.log1p(-p(v)).alias("h"), F.ln(p(v)).alias("m")))
    pair = F.transform(sq.indices(1, F.col("values")), lambda i: (F.abs(F.get("values", i) - F.get("values", i - 1)) - 100.0) / 50.0)
    z = s.select("user_id", logp.alias("_l"), pair.alias("_p"))
    return z.select("user_id", F.array_join(F.transform(sq.viterbi(F.col("_l"), F.col("_p")), lambda x: x.cast("string")), "").alias("path"))


@query(f"WITH {_E} SELECT user_id, max(n)::INT AS n, (max(n) - least(greatest(max(n) - 100 + user_id % 120, 0), max(n)))::INT AS ones FROM e GROUP BY user_id")
def labels_from_boundary(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("_n", F.size("labels"))
    y = sq.labels_from_boundary(F.col("_n"), F.col("_n") - (100 - F.col("user_id") % 120))
    return s.select("user_id", F.col("_n").alias("n"), F.aggregate(y, F.lit(0), lambda a, x: a + x).alias("ones"))


@query(f"""WITH {_E} SELECT user_id, n::INT + 1 AS n_sentences, string_agg(CASE WHEN i = 2 THEN 'x,x,x' WHEN i = 3 THEN NULL ELSE i::VARCHAR END, ',' ORDER BY i) AS sentences, 3 AS n_new FROM e GROUP BY user_id, n""")
def assembly(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("_s", F.transform("labels", lambda _, i: i.cast("string")))
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end")))
    made = s.select("user_id", sq.splice(F.col("_s"), spans, F.array(F.array_repeat(F.lit("x"), 3))).alias("_m"))
    return made.select("user_id", F.size("_m.sentences").alias("n_sentences"), F.array_join("_m.sentences", ",").alias("sentences"), F.aggregate("_m.labels", F.lit(0), lambda a, x: a + x).alias("n_new"))


# ------------------------------------------------------------ evaluation

_PRF = """round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS {0}, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS {1},
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS {2}"""
_CELLS = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn"
_SENT = f"""(tp + fp + fn + tn)::BIGINT AS n, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, {_PRF.format("precision_ai", "recall_ai", "f1_ai")},
round((CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2.0 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2, 6) AS macro_f1, (tp + fn)::BIGINT AS support_ai"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {_E} SELECT {_SENT} FROM (SELECT {_CELLS} FROM e)")
def sentence_metrics(spark, sf_dir):
    return _rounded(ev.sentence_metrics(sequences(spark, sf_dir)))


@query(f"WITH {_E} SELECT slice, {_SENT} FROM (SELECT slice, {_CELLS} FROM (SELECT unnest(['overall', (user_id % 3)::VARCHAR]) AS slice, y, p FROM e) GROUP BY slice)")
def sentence_metrics_by_slice(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("_third", F.col("user_id") % 3)
    return _rounded(ev.sliced(s, "_third", ev.sentence_metrics))


_BOUND = f"""docs AS (SELECT user_id, sum(gb) AS g, sum(pb) AS q, count(*) FILTER (gb = 1 AND pb = 1) AS h, bool_and(gb = pb) AS same FROM b GROUP BY user_id),
t AS (SELECT {{0}} count(*) AS n_docs, sum(g)::BIGINT AS gold, sum(q)::BIGINT AS predicted, sum(h)::BIGINT AS tp, (sum(q) - sum(h))::BIGINT AS fp, (sum(g) - sum(h))::BIGINT AS fn, count(*) FILTER (same) AS exact FROM docs {{1}})
SELECT {{2}} n_docs::BIGINT AS n_docs, gold, predicted, {_PRF.format("precision", "recall", "f1")}, round(exact::DOUBLE / n_docs, 6) AS exact_doc_match, 0 AS tolerance FROM t"""


@query(f"WITH {_E}, {_B}, {_BOUND.format('', '', '')}")
def boundary_exact_f1(spark, sf_dir):
    return _rounded(ev.boundary_metrics(sequences(spark, sf_dir)))


@query(f"WITH {_E}, {_B}, {_BOUND.format('user_id % 3 AS third,', 'GROUP BY user_id % 3', 'third,')}")
def boundary_metrics_by_slice(spark, sf_dir):
    return _rounded(ev.boundary_metrics(sequences(spark, sf_dir).withColumn("third", F.col("user_id") % 3), ["third"]))


@query()
def boundary_tol1_f1(spark, sf_dir):
    return _rounded(ev.boundary_metrics(sequences(spark, sf_dir), (), 1))


@query()
def evaluation_bundle(spark, sf_dir):
    return ev.evaluate(sequences(spark, sf_dir).withColumn("third", F.col("user_id") % 3), ["third"])


@query(f"""WITH {_E}, {_B}, d AS (SELECT user_id, max(p) AS any_p, sum(pb) AS nb, sum(p) AS np, count(*) AS n FROM b GROUP BY user_id)
SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_sentences, round(avg(any_p), 6) AS doc_false_alarm, round(avg(nb), 6) AS boundaries_per_doc, round(sum(np)::DOUBLE / sum(n), 6) AS sentence_fpr FROM d""")
def human_document_metrics(spark, sf_dir):
    return _rounded(ev.human_metrics(sequences(spark, sf_dir)))


_SWEEP = f"""WITH {_E}, g AS (SELECT k, round(0.05 + 0.025 * k, 3)::DOUBLE AS t FROM range(37) r(k)),
x AS (SELECT user_id, i, k, t, y, coalesce((s >= t)::INT, 0) AS p FROM e CROSS JOIN g),
b AS (SELECT *, (i > 0 AND y <> lag(y) OVER w)::INT AS gb, (i > 0 AND p <> lag(p) OVER w)::INT AS pb FROM x WINDOW w AS (PARTITION BY user_id, k ORDER BY i)),
d AS (SELECT user_id, t, sum(gb) AS g, sum(pb) AS q, count(*) FILTER (gb = 1 AND pb = 1) AS h, max(p) AS a FROM b GROUP BY user_id, t),
sweep AS (SELECT t AS threshold, round(2.0 * sum(h) / (sum(g) + sum(q)), 6) AS f1, round(avg(a), 6) AS false_alarm FROM d GROUP BY t)"""


def _sweep(spark, sf_dir) -> DataFrame:
    each = ev.at_thresholds(sequences(spark, sf_dir), {"pred": "scores"})
    b = ev.boundary_metrics(each, ["threshold"]).select("threshold", r6(F.col("f1")).alias("f1"))
    h = ev.human_metrics(each, ["threshold"]).select("threshold", r6(F.col("doc_false_alarm")).alias("false_alarm"))
    return b.join(h, "threshold")


@query(f"{_SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(f"""WITH {_E}, g AS (SELECT k, round(0.05 + 0.025 * k, 3)::DOUBLE AS t FROM range(37) r(k)),
x AS (SELECT user_id, i, n, k, t, y, coalesce((s >= t)::INT, 0) AS p, coalesce((s / 2 >= t)::INT, 0) AS q FROM e CROSS JOIN g),
b AS (SELECT *, (i > 0 AND y <> lag(y) OVER w)::INT AS gb, (i > 0 AND p <> lag(p) OVER w)::INT AS pb, (i > 0 AND q <> lag(q) OVER w)::INT AS qb FROM x WINDOW w AS (PARTITION BY user_id, k ORDER BY i)),
d AS (SELECT user_id, t, sum(gb) AS g, sum(pb) AS pn, count(*) FILTER (gb = 1 AND pb = 1) AS h, (sum((gb <> pb)::INT) = 0)::INT AS same, max(q) AS a, sum(qb) AS qn, sum(q) AS qs, count(*) AS n,
  user_id = min(user_id) OVER (PARTITION BY floor(user_id / 2), t) AS one FROM b GROUP BY user_id, t)
SELECT t AS threshold, round(2.0 * sum(h) / (sum(g) + sum(pn)), 6) AS mixed_f1, round(avg(same), 6) AS mixed_doc_exact, round(avg(a) FILTER (one), 6) AS false_alarm, round(avg(qn) FILTER (one), 6) AS boundaries_per_twin,
round((sum(qs) FILTER (one))::DOUBLE / sum(n) FILTER (one), 6) AS sentence_fpr, round(2.0 * sum(h) / (sum(g) + sum(pn) + sum(qn) FILTER (one)), 6) AS combined_boundary_f1 FROM d GROUP BY t""")
def twin_threshold_sweep(spark, sf_dir):
    s = sequences(spark, sf_dir)
    pairs = s.select("user_id", F.floor(F.col("user_id") / 2).alias("window_id"), "labels", F.col("scores").alias("proba"), F.transform("scores", lambda v: v / 2).alias("twin_proba"))
    return _rounded(ev.threshold_sweep(pairs, order=["user_id"]))


@query(f"{_SWEEP} SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return ev.best_row(_sweep(spark, sf_dir), "f1", "threshold")


@query(f"""{_SWEEP} SELECT level, threshold, f1 FROM (SELECT l.level, s.threshold, s.f1, row_number() OVER (PARTITION BY l.level ORDER BY s.f1 DESC, s.threshold) AS rn
FROM (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS level) l LEFT JOIN sweep s ON s.false_alarm <= l.level) WHERE rn = 1""")
def matched_alarm(spark, sf_dir):
    return ev.matched_alarm(_sweep(spark, sf_dir), (0.3, 0.5, 0.7))


@query(f"""WITH {_E}, {_B}, tw AS (SELECT *, row_number() OVER (PARTITION BY user_id // 2 ORDER BY user_id) AS dummy FROM (SELECT DISTINCT user_id FROM e)),
u AS (SELECT user_id FROM tw WHERE dummy = 1),
tp AS (SELECT b.user_id, b.i, (b.value > 120)::INT AS t FROM b),
tb AS (SELECT *, (i > 0 AND t <> lag(t) OVER (PARTITION BY user_id ORDER BY i))::INT AS c FROM tp),
h AS (SELECT user_id, max(t) AS a, sum(c) AS nb, sum(t) AS nt, count(*) AS n FROM tb WHERE user_id IN (SELECT user_id FROM u) GROUP BY user_id),
pr AS (SELECT count(*) FILTER (y = 1) AS ai, count(*) FILTER (y = 0) AS ctx, count(*) FILTER (y = 1 AND p = 1 AND t = 0) AS flips, count(*) FILTER (y = 0 AND p = t) AS stable,
  count(*) FILTER (y = 1 AND value / 1000 > (value - 20) / 1000) AS wins FROM b JOIN tp USING (user_id, i)),
cb AS (SELECT sum(g) AS g, sum(q) AS q, sum(h) AS h FROM (SELECT sum(gb) AS g, sum(pb) AS q, count(*) FILTER (gb = 1 AND pb = 1) AS h FROM b UNION ALL SELECT 0, sum(nb), 0 FROM h)),
ex AS (SELECT avg(same) AS s FROM (SELECT (sum((gb <> pb)::INT) = 0)::INT AS same FROM b GROUP BY user_id UNION ALL SELECT (nb = 0)::INT FROM h))
SELECT (SELECT count(*) FROM h)::BIGINT AS n_twins, round((SELECT avg(a) FROM h), 6) AS doc_false_alarm, round((SELECT avg(nb) FROM h), 6) AS boundaries_per_twin, round((SELECT sum(nt)::DOUBLE / sum(n) FROM h), 6) AS sentence_fpr,
round(wins::DOUBLE / ai, 6) AS paired_win_rate, round(flips::DOUBLE / ai, 6) AS paired_flip_rate, round(stable::DOUBLE / ctx, 6) AS context_stability, round((SELECT 2.0 * h / (g + q) FROM cb), 6) AS combined_boundary_f1,
round((SELECT h::DOUBLE / q FROM cb), 6) AS combined_boundary_precision, round((SELECT h::DOUBLE / g FROM cb), 6) AS combined_boundary_recall, round((SELECT s FROM ex), 6) AS combined_doc_exact FROM pr""")
def twin_metrics(spark, sf_dir):
    s = sequences(spark, sf_dir)
    pairs = s.select(
        "user_id", F.floor(F.col("user_id") / 2).alias("window_id"), "labels", "pred", F.transform("values", lambda v: v / 1000).alias("proba"),
        F.transform("values", lambda v: (v > 120).cast("int")).alias("twin_pred"), F.transform("values", lambda v: (v - 20) / 1000).alias("twin_proba"),
    )
    return _rounded(ev.twin_metrics(pairs, ["user_id"]))


_WORDS = """w AS (SELECT user_id, max(n) AS n, coalesce(min(i) FILTER (y = 1), max(n)) AS gold, coalesce(min(i) FILTER (p = 1), max(n)) AS pred FROM e GROUP BY user_id)"""


def _word_docs(spark, sf_dir) -> DataFrame:
    s = sequences(spark, sf_dir)
    kind = F.when(F.col("user_id") % 2 == 0, "a").otherwise("b")
    return s.select("user_id", F.size("labels").alias("n_words"), sq.first_boundary(F.col("labels")).alias("gold"), sq.first_boundary(F.col("pred")).alias("pred"), kind.alias("domain"), (F.col("user_id") % 3).cast("string").alias("generator"))


@query(f"""WITH {_E}, {_WORDS}, k AS (SELECT unnest([{{'kind': 'overall', 'key': ''}}, {{'kind': 'by_domain', 'key': CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END}},
  {{'kind': 'by_generator', 'key': CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END || '/' || (user_id % 3)::VARCHAR}}]) AS x, gold, pred FROM w)
SELECT x.kind AS kind, x.key AS key, count(*)::BIGINT AS n, round(avg(abs(pred - gold)), 6) AS mae, round(avg((pred = gold)::INT), 6) AS exact FROM k GROUP BY x.kind, x.key""")
def word_boundary_metrics(spark, sf_dir):
    return _rounded(ev.word_metrics_by(_word_docs(spark, sf_dir)))


@query(f"""WITH {_E}, {_WORDS}, h AS (SELECT * FROM w WHERE user_id % 4 = 0), m AS (SELECT * FROM w WHERE user_id % 4 <> 0)
SELECT (SELECT count(*) FROM m)::BIGINT AS n_mixed, (SELECT count(*) FROM h)::BIGINT AS n_human,
round(((SELECT count(*) FROM m WHERE (gold < n) = (pred < n)) + (SELECT count(*) FROM h WHERE NOT pred < n))::DOUBLE / (SELECT count(*) FROM w), 6) AS presence_accuracy,
round((SELECT avg((pred < n)::INT) FROM m WHERE gold < n), 6) AS mixed_detected, round((SELECT 1 - avg((pred < n)::INT) FROM h), 6) AS human_quiet,
round(((SELECT avg((pred < n)::INT) FROM m WHERE gold < n) + (SELECT 1 - avg((pred < n)::INT) FROM h)) / 2, 6) AS balanced_accuracy, round((SELECT avg(abs(pred - gold)) FROM m), 6) AS mae_mixed""")
def deployment_view(spark, sf_dir):
    d = _word_docs(spark, sf_dir)
    return _rounded(ev.deployment(d.where("user_id % 4 <> 0"), d.where("user_id % 4 = 0")))


@query(f"WITH {_E}, {_WORDS} SELECT count(*)::BIGINT AS n_docs, round(avg((pred < n)::INT), 6) AS false_alarm, round(avg((n - pred)::DOUBLE / n), 6) AS frac_flagged FROM w")
def word_human_metrics(spark, sf_dir):
    return _rounded(ev.word_human_metrics(_word_docs(spark, sf_dir)))


# ------------------------------------------------------------------ text

_SQL_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda x: x <> '')"


@query(rf"""SELECT doc_id, len({_SQL_WORDS})::INT AS n_words, len(string_split(text, ' '))::INT AS n_task_words FROM documents""")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n_words"), F.size(tx.task_words(F.col("text"))).alias("n_task_words"))


_LETTERS = r"length(regexp_replace(text, '[^\p{L}\p{Nl}\p{No}]', '', 'g'))"


@query(rf"""SELECT doc_id, round(CASE WHEN {_LETTERS} > 0 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / {_LETTERS} ELSE 0 END, 6) AS latin_ratio,
round(CASE WHEN {_LETTERS} > 0 THEN length(regexp_replace(text, '[^\x{{0D80}}-\x{{0DFF}}]', '', 'g'))::DOUBLE / {_LETTERS} ELSE 0 END, 6) AS sinhala_ratio FROM documents""")
def letter_ratios(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", r6(tx.latin_ratio(F.col("text"))).alias("latin_ratio"), r6(tx.sinhala_ratio(F.col("text"))).alias("sinhala_ratio"))


@query(r"""SELECT doc_id, len(t)::INT AS n_numbers, array_to_string(t, ' ') AS numbers FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\p{Nd}[\p{Nd},.٫٬]*'), lambda x: replace(regexp_replace(x, '[.,]+$', ''), ',', '')), lambda x: x <> '') AS t FROM documents)""")
def numeric_tokens(spark, sf_dir):
    t = tx.numeric_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_numbers"), F.array_join(t, " ").alias("numbers"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>', ' ', 'g'),
'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#160;', ' '), '[ \t\x{a0}]+', ' ', 'g')) AS text FROM pages""")
def html_strip(spark, sf_dir):
    t = F.regexp_replace(F.regexp_replace("html", "(?s)<!--.*?-->", " "), r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#160;", " ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(t, "[ \t ]+", " ")).alias("text"))


@query(r"""SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, '[.?!෴…]$') THEN t ELSE t || '.' END AS sentence FROM (
SELECT doc_id, regexp_replace(regexp_replace(translate(text, '‘’‚‛“”„‟' || chr(8203) || chr(8204) || chr(8288) || chr(65279) || chr(173), repeat(chr(39), 4) || repeat(chr(34), 4)), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+([.,?!:;])', '\1', 'g'), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '') AS t FROM documents)""")
def surface_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_surface(F.col("text")).alias("sentence"))


def _classified(spark, sf_dir) -> DataFrame:
    """Lines with a full stop stand for sentences here, and Latin letters for the wanted script."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", pg.prose_reason(F.col("text"), F.size(F.filter(F.split("text", r"\.", -1), lambda x: F.trim(x) != "")), tx.latin_ratio(F.col("text"))).alias("drop_reason"))


_GATE = rf"""g AS (SELECT doc_id, CASE WHEN length(text) < 400 THEN 'too_few_chars' WHEN len({_SQL_WORDS}) < 120 THEN 'too_few_words'
WHEN CASE WHEN {_LETTERS} > 0 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / {_LETTERS} ELSE 0 END < 0.55 THEN 'not_sinhala'
WHEN len(list_filter(string_split(text, '.'), lambda x: trim(x, ' ') <> '')) < 8 THEN 'too_few_sentences' END AS drop_reason FROM documents)"""


@query(f"WITH {_GATE} SELECT doc_id, drop_reason FROM g")
def prose_gate(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "drop_reason")


@query(f"""WITH {_GATE}, r AS (SELECT unnest(range(4)) AS step, unnest(['too_few_chars', 'too_few_words', 'not_sinhala', 'too_few_sentences']) AS reason),
c AS (SELECT r.step, r.reason, count(g.doc_id) AS n FROM r LEFT JOIN g ON g.drop_reason = r.reason GROUP BY r.step, r.reason)
SELECT step::INT AS step, reason, n::BIGINT AS n, round(n::DOUBLE / (SELECT count(*) FROM documents), 6) AS share, ((SELECT count(*) FROM documents) - sum(n) OVER (ORDER BY step))::BIGINT AS remaining FROM c""")
def drop_waterfall(spark, sf_dir):
    return _rounded(pg.waterfall(_classified(spark, sf_dir), pg.PROSE_REASONS))


@query("""SELECT count(*)::BIGINT AS n_rows, count(text)::BIGINT AS n_texts, round(avg(length(text)), 6) AS mean_chars, min(length(text))::INT AS min_chars, max(length(text))::INT AS max_chars,
round(avg(regexp_matches(text, '[0-9]')::INT), 6) AS hits_digit, round(avg(regexp_matches(text, 'https?://')::INT), 6) AS hits_url FROM documents""")
def table_profile(spark, sf_dir):
    return _rounded(pg.profile(table(spark, sf_dir, "documents"), "text", {"digit": "[0-9]", "url": "https?://"}))


@query(rf"""SELECT doc_id, len(g)::INT AS n_grams FROM (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 7, 0) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT doc_id, {_SQL_WORDS.replace("coalesce(text, '')", "lower(text)")} AS w FROM documents))""")
def word_ngrams(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.word_ngrams(F.col("text"), 8)).alias("n_grams"))


# ------------------------------------------------------- joins and dedup

_GRAMS = _SQL_WORDS.replace("coalesce(text, '')", "lower(text)")


@query(rf"""WITH a AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 7, 0) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT doc_id, {_GRAMS} AS w FROM documents)),
b AS (SELECT unnest(list_transform(range(1, greatest(len(w) - 7, 0) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT {_GRAMS} AS w FROM benchmark))
SELECT DISTINCT doc_id FROM a WHERE g IN (SELECT g FROM b)""")
def leakage_ngrams(spark, sf_dir):
    return ma.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def dedup_keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "copies")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def window_unique(spark, sf_dir):
    return ev.unique_windows(table(spark, sf_dir, "events"), ["event_id"], "user_id").select("user_id", "event_id")


@query("SELECT doc_id, source, round(1.0 / count(*) OVER (PARTITION BY source), 9) AS weight FROM documents")
def share_weight(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.round(ma.share_weight(F.col("source")), 9).alias("weight"))


_RANKED = "r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS k, count(*) OVER () AS n FROM documents)"


@query(f"WITH {_RANKED} SELECT doc_id, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'dev' ELSE 'test' END AS split FROM r")
def split_assignment(spark, sf_dir):
    return sa.make_split(table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT doc_id, 'x' AS problem FROM documents WHERE false")
def split_integrity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return sa.split_problems(sa.make_split(d, "doc_id"), d, "doc_id")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:task-order:' || doc_id::VARCHAR), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE k <= round_even(n * 0.2, 0)")
def nested_fraction(spark, sf_dir):
    return sa.nested_fraction(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 0.2)


@query("""WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS k, count(*) OVER () AS n FROM g)
SELECT d.doc_id, CASE WHEN r.k <= floor(r.n / 2) THEN 'eval' ELSE 'train' END AS half FROM documents d JOIN r USING (source)""")
def disjoint_halves(spark, sf_dir):
    return sa.disjoint_halves(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "half")


def _draw(seed: str, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


_CONS = {k: Construction(4) if k == TYPE1 else Construction(6) for k in (TYPE1, TYPE2)}


@query(f"""WITH s AS (SELECT doc_id::VARCHAR AS id, list_filter(string_split(text, '.'), lambda x: trim(x, ' ') <> '') AS s FROM documents),
z AS (SELECT id, s, len(s) AS n, 6 + {_draw("42:size", "id")} % (least(12, len(s)) - 6 + 1) AS size FROM s WHERE len(s) >= 6),
o AS (SELECT id, s, size, {_draw("42:offset", "id")} % (n - size + 1) AS off FROM z),
w AS (SELECT id || '_w0' AS window_id, off::INT AS sent_start, (off + size)::INT AS sent_end, array_to_string(s[off + 1:off + size], ' ') AS text FROM o)
SELECT window_id, sent_start, sent_end, len({_SQL_WORDS})::INT AS n_words FROM w WHERE len({_SQL_WORDS}) >= 100""")
def windowing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = d.select(F.col("doc_id").cast("string").alias("source_id"), F.lit("").alias("title"), F.lit("").alias("url"), F.lit("d").alias("domain"), F.filter(F.split("text", r"\.", -1), lambda x: F.trim(x) != "").alias("sentences"))
    return sa.make_windows(s).select("window_id", "sent_start", "sent_end", "n_words")


_N = "SELECT doc_id::VARCHAR AS id, doc_id, len(list_filter(string_split(text, '.'), lambda x: trim(x, ' ') <> ''))::INT AS n FROM documents"


def _lengths(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(F.filter(F.split("text", r"\.", -1), lambda x: F.trim(x) != "")).alias("n"))


@query(f"""WITH s AS ({_N}), b AS (SELECT *, greatest(2, round_even(n * 0.2, 0)::INT) AS lo, least(n - 2, round_even(n * 0.8, 0)::INT) AS hi FROM s)
SELECT doc_id, CASE WHEN n >= 4 AND lo <= hi THEN (lo + {_draw("42:1", "id")} % (hi - lo + 1))::INT END AS boundary_index FROM b""")
def type1_plan(spark, sf_dir):
    return _lengths(spark, sf_dir).select("doc_id", sa.plan_type1(F.col("n"), _CONS[TYPE1], "42:1", F.col("doc_id")).alias("boundary_index"))


@query(f"""WITH s AS ({_N}), c AS (SELECT doc_id, id, n, unnest(range(1, 4)) AS size FROM s WHERE n >= 6),
k AS (SELECT doc_id, id, n, size, unnest(range(1, greatest(n - size, 1))) AS st FROM c WHERE size::DOUBLE / n BETWEEN 0.15 AND 0.35),
p AS (SELECT *, (st >= 2 AND n - st - size >= 2) AS good FROM k),
q AS (SELECT *, bool_or(good) OVER (PARTITION BY doc_id) AS any_good FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size, st) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM q WHERE good OR NOT any_good)
SELECT s.doc_id, r.st::INT AS span_start, (r.st + r.size)::INT AS span_end FROM s LEFT JOIN (SELECT * FROM r WHERE k = {_draw("42:2", "id")} % m) r USING (doc_id)""")
def type2_plan(spark, sf_dir):
    p = _lengths(spark, sf_dir).select("doc_id", F.get(sa.plan_type2(F.col("n"), _CONS[TYPE2], "42:2", F.col("doc_id")), F.lit(0)).alias("_s"))
    return p.select("doc_id", F.col("_s.start").alias("span_start"), F.col("_s.end").alias("span_end"))


@query()
def type3_plan(spark, sf_dir):
    p = _lengths(spark, sf_dir).select("doc_id", sa.plan_type3(Config().constructions["type3_multiple_internal_segments"], "42:3")(F.col("n"), F.col("doc_id").cast("string")).alias("_s"))
    return p.select("doc_id", joined(F.transform("_s", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))).alias("spans"))


@query(f"""WITH s AS (SELECT doc_id, len({_SQL_WORDS})::INT AS n, doc_id % 2 AS half FROM documents),
a AS (SELECT doc_id, n, row_number() OVER (PARTITION BY n ORDER BY doc_id) AS rn FROM s WHERE half = 0),
b AS (SELECT doc_id, n, row_number() OVER (PARTITION BY n ORDER BY md5('0:' || doc_id::VARCHAR), doc_id) AS rn FROM s WHERE half = 1)
SELECT a.doc_id AS doc_id, b.doc_id AS stand_in_doc_id, a.n AS n FROM a LEFT JOIN b USING (n, rn)""")
def rank_matched_standins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n"))
    return ma.rank_matched(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "n", "doc_id", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unused(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_used(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


# ------------------------------------------------------------ aggregates


@query("""WITH v AS (SELECT n_chars::DOUBLE / (SELECT max(n_chars) FROM documents) AS x FROM documents), c AS (SELECT least(9, floor(x * 10))::INT AS bin, count(*) AS n FROM v GROUP BY 1)
SELECT b.bin::INT AS bin, coalesce(c.n, 0)::BIGINT AS n, round(coalesce(c.n, 0)::DOUBLE / sum(coalesce(c.n, 0)) OVER (), 6) AS share FROM range(10) b(bin) LEFT JOIN c ON c.bin = b.bin""")
def decile_histogram(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("n_chars")
    top = d.agg(F.max("n_chars").alias("_m"))
    return _rounded(ag.decile_histogram(d.crossJoin(F.broadcast(top)).select((F.col("n_chars") / F.col("_m")).alias("x")), "x"))


@query("""WITH s AS (SELECT lang, list_sort(list(n_chars)) AS a, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, a[least(n - 1, floor(n * 0.25)::BIGINT) + 1] AS p25, a[least(n - 1, floor(n * 0.5)::BIGINT) + 1] AS p50, a[least(n - 1, floor(n * 0.95)::BIGINT) + 1] AS p95 FROM s""")
def floor_quantiles(spark, sf_dir):
    return ag.floor_quantiles(table(spark, sf_dir, "documents"), "n_chars", (0.25, 0.5, 0.95), ["lang"])


@query("""SELECT lang, count(n_chars)::BIGINT AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.05), 6) AS p05, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, sum(n_chars)::BIGINT AS total FROM documents GROUP BY lang""")
def linear_quantiles(spark, sf_dir):
    return _rounded(ag.linear_quantiles(table(spark, sf_dir, "documents"), "n_chars", (0.05, 0.5, 0.95), ["lang"]))


@query("""SELECT lang, count(*) FILTER (quality = 0)::BIGINT AS "0", count(*) FILTER (quality = 1)::BIGINT AS "1", count(*) FILTER (quality IN (0, 1))::BIGINT AS total FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def cross_tab(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return ag.cross_tab(j, ["lang"], "quality", ["0", "1"])


@query("SELECT lang, quality, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, quality)")
def role_rollup(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return ag.type_cube(j, ["lang", "quality"])


@query(f"WITH {_E} SELECT count(DISTINCT user_id)::BIGINT AS n_docs, count(*)::BIGINT AS n_sentences, sum(y)::BIGINT AS n_machine, round(avg(y), 6) AS machine_share FROM e")
def label_balance(spark, sf_dir):
    return _rounded(ag.label_balance(sequences(spark, sf_dir)))


@query(f"WITH {_E} SELECT round(count(*)::DOUBLE / (2 * count(*) FILTER (y = 0)), 6) AS weight_0, round(count(*)::DOUBLE / (2 * count(*) FILTER (y = 1)), 6) AS weight_1 FROM e")
def class_weights(spark, sf_dir):
    return _rounded(ag.class_weights(sequences(spark, sf_dir)))


@query("""SELECT count(*) FILTER (quality = 0)::BIGINT AS n0, count(*) FILTER (quality = 1)::BIGINT AS n1,
round((avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0)) / sqrt((var_pop(n_chars) FILTER (quality = 1) + var_pop(n_chars) FILTER (quality = 0)) / 2), 6) AS d FROM documents JOIN labels USING (doc_id)""")
def cohens_d(spark, sf_dir):
    return _rounded(ag.cohens_d(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), "n_chars", "quality"))


@query(f"""WITH {_E}, s AS (SELECT value, y, abs(value - lag(value) OVER w) AS st, (y <> lag(y) OVER w)::INT AS ch FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)),
a AS (SELECT (avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0)) / sqrt((var_pop(value) FILTER (y = 1) + var_pop(value) FILTER (y = 0)) / 2) AS l FROM s),
b AS (SELECT (avg(st) FILTER (ch = 1) - avg(st) FILTER (ch = 0)) / sqrt((var_pop(st) FILTER (ch = 1) + var_pop(st) FILTER (ch = 0)) / 2) AS j FROM s)
SELECT round(l, 6) AS level_d, round(j, 6) AS jump_d, (abs(l) > 0.2 OR abs(j) > 0.15) AS useful FROM a CROSS JOIN b""")
def adjacency_probe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("o"), "value", F.col("event_type").isin("error", "purchase").cast("int").alias("y"))
    return _rounded(ag.adjacency_probe(e, "user_id", "o", "value", "y"))


_RUNS = "SELECT event_type AS metric, user_id % 3 AS seed, avg(value) AS value, true AS higher_better FROM events GROUP BY 1, 2"


def _runs(spark, sf_dir, shift: float = 0.0) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 3).alias("seed")).agg((F.avg("value") + shift).alias("value")).withColumn("higher_better", F.lit(True))


@query(f"SELECT metric, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM ({_RUNS}) GROUP BY metric")
def seed_stats(spark, sf_dir):
    return _rounded(ag.seed_stats(_runs(spark, sf_dir), ["metric"]))


@query(f"""WITH a AS ({_RUNS}), b AS (SELECT event_type AS metric, user_id % 3 AS seed, max(value) AS value FROM events GROUP BY 1, 2)
SELECT a.metric AS metric, count(*)::BIGINT AS n, round(avg(b.value - a.value), 6) AS mean_diff, round(stddev_samp(b.value - a.value), 6) AS sd_diff, count(*) FILTER (b.value > a.value)::BIGINT AS wins FROM a JOIN b USING (metric, seed) GROUP BY a.metric""")
def paired_diff(spark, sf_dir):
    b = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 3).alias("seed")).agg(F.max("value").alias("value"))
    return _rounded(ag.paired_differences(_runs(spark, sf_dir), b))


@query("""WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem) SELECT l_returnflag, round(avg((l_quantity - m) / d), 5) AS mean_z, count(*)::BIGINT AS n FROM lineitem CROSS JOIN s GROUP BY l_returnflag""")
def standard_scaler(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    z = ag.scaled(x, ag.scaler(x, ["l_quantity"]), ["l_quantity"])
    return z.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 5).alias("mean_z"), F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, event_id, round(sum(value) OVER w, 4) AS running_total_usd, (count(*) OVER w)::BIGINT AS running_calls FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_usage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.col("value").alias("cost_usd"))
    return ag.running_usage(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.round("running_total_usd", 4).alias("running_total_usd"), "running_calls")


@query("""SELECT lang AS generator, count(*)::BIGINT AS calls, (count(*) FILTER (q = 0))::BIGINT AS rejected, (count(*) - count(*) FILTER (q = 0))::BIGINT AS accepted, round((count(*) - count(*) FILTER (q = 0))::DOUBLE / count(*), 6) AS pass_rate, sum(n_chars)::BIGINT AS cost_usd
FROM (SELECT d.lang, d.n_chars, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY lang UNION ALL SELECT 'xx', 0, 0, 0, 0, 0""")
def pass_rates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("generator"), F.col("n_chars").alias("cost_usd"))
    bad = d.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_semi")
    return _rounded(ag.pass_rates(d, bad, kinds=["de", "en", "es", "fr", "xx"]))


@query(f"""WITH {_E}, s AS (SELECT least(9, floor(i::DOUBLE / greatest(n - 1, 1) * 10))::INT AS bin, avg(y) AS share FROM e GROUP BY 1) SELECT b.bin::INT AS bin, round(coalesce(share, 0), 6) AS share FROM range(10) b(bin) LEFT JOIN s ON s.bin = b.bin""")
def position_prior(spark, sf_dir):
    from seamline.operators.models import PositionPrior

    return _rounded(PositionPrior().shares(sequences(spark, sf_dir)))


@query("""SELECT lang, quality, doc_id FROM (SELECT d.lang, l.quality, d.doc_id, row_number() OVER (PARTITION BY l.quality ORDER BY d.doc_id) AS rn FROM documents d JOIN labels l USING (doc_id)) WHERE rn <= 3 ORDER BY rn, quality LIMIT 5""")
def round_robin_examples(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "quality", "doc_id")
    return ag.round_robin(j, "quality", [0, 1], ["doc_id"], 5)


@query("SELECT regexp_extract(url, '^([^:]{1,30}):', 1) AS prefix, count(*)::BIGINT AS n FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top_prefixes(spark, sf_dir):
    return pg.top_prefixes(table(spark, sf_dir, "pages"), "url")


@query("SELECT doc_id, field, text FROM (SELECT doc_id, unnest(['text', 'source']) AS field, unnest([text, source]) AS text FROM documents) WHERE coalesce(text, '') <> ''")
def all_text_unpivot(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return jsonl.all_texts(d, ["text", "source"], ["doc_id"])


# ----------------------------------------------------- functions in Python


@query()
def segment_sentences(spark, sf_dir):
    from seamline.functions.segment import sentences

    s = table(spark, sf_dir, "documents").select("doc_id", sentences()(F.col("text")).alias("_s"))
    return s.select("doc_id", F.size("_s").alias("n_sentences"), F.md5(F.array_join("_s", "\n").cast("binary")).alias("digest"))


@query()
def validation_checks(spark, sf_dir):
    from seamline.operators.validation import validate

    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "text", F.lit(8).alias("target_sentence_count"), F.lit(100).alias("target_word_count"))
    return validate(rows, original=None, script=tx.latin_ratio(F.col("text"))).select("doc_id", "passed", F.array_join("errors", " | ").alias("errors"))


@query()
def integrity_errors(spark, sf_dir):
    from seamline.operators import validation as va

    s = sequences(spark, sf_dir)
    sents = F.transform("labels", lambda _, i: F.concat(F.lit("s"), i.cast("string")))
    rec = s.select(
        F.col("user_id").cast("string").alias("record_id"), (F.col("user_id") % 50).cast("string").alias("source_id"), F.lit("d").alias("domain"), F.lit("alpha").alias("generator"), F.lit(TYPE1).alias("construction_type"),
        F.lit("train").alias("split"), F.array_join(sents, " ").alias("text"), sents.alias("sentences"), "labels", sq.boundaries(F.col("labels")).alias("boundaries"),
        *[F.lit(0.5 if c in ("temperature", "top_p", "boundary_position_normalized") else "").alias(c) for c in ("boundary_position_normalized", "prompt_id", "raw_output", "cleaned_output", "temperature", "top_p", "retry_count", "validation_passed", "validation_errors")],
    )
    splits = spark.range(50).select(F.col("id").cast("string").alias("source_id"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    return va.integrity_errors(rec, splits).select("record_id", F.array_join("integrity_errors", " | ").alias("errors"))


@query()
def linear_detector(spark, sf_dir):
    from seamline.operators.models import LinearDetector

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    docs = d.select(F.col("doc_id").alias("record_id"), F.array("text").alias("sentences"), F.array("quality").alias("labels"))
    fitted = LinearDetector(ngram=(2, 4), max_features=200_000, c=1.0, max_iter=2000).fit(docs.where("record_id % 5 <> 0"))
    return _rounded(ev.sentence_metrics(fitted.predict(docs.where("record_id % 5 = 0"))))

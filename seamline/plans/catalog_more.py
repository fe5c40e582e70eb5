"""More queries of the catalogue: releases, logs, alignment, reports and choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.config import Config
from seamline.functions import sequences as sq
from seamline.functions import text as tx
from seamline.functions.draws import shuffle_key, uniform
from seamline.operators import aggregates as ag
from seamline.operators import evaluation as ev
from seamline.operators import matching as ma
from seamline.operators import pages as pg
from seamline.operators import sampling as sa
from seamline.plans.catalog import _B, _E, _SQL_WORDS, _SWEEP, _rounded, _sweep, joined, query, r6, sequences, table
from seamline.sources import jsonl


def _as_windows(spark, sf_dir):
    """Documents as windows of lines."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("window_id"), F.col("source").alias("source_id"), F.split("text", "\n", -1).alias("sentences"), "lang")


@query("""WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)
SELECT doc_id::VARCHAR || '__twin' AS record_id, len(s)::INT AS n, 1.0::DOUBLE AS weight, md5(array_to_string(s, chr(10))) AS digest FROM w""")
def twin_alignment(spark, sf_dir):
    from seamline.config import TYPE1

    w = _as_windows(spark, sf_dir)
    # The last line is replaced and labelled 1; all others must be the window's.
    y = F.transform("sentences", lambda _, i: (i == F.size("sentences") - 1).cast("int"))
    changed = F.transform("sentences", lambda s, i: F.when(i == F.size("sentences") - 1, F.lit("new")).otherwise(s))
    docs = w.select(F.col("window_id").alias("record_id"), "source_id", "window_id", F.lit("train").alias("split"), F.lit("alpha").alias("generator"), F.lit(TYPE1).alias("construction_type"), changed.alias("sentences"), y.alias("labels"))
    t = ma.twins(docs, w)
    return t.select("record_id", F.size("sentences").alias("n"), "weight", F.md5(F.array_join("sentences", "\n").cast("binary")).alias("digest"))


@query("""SELECT doc_id::VARCHAR AS window_id FROM documents WHERE source IN (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) WHERE k <= floor(n * 0.7))
AND source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND doc_id % 50 = 0)""")
def unused_windows(spark, sf_dir):
    w = _as_windows(spark, sf_dir)
    used = w.where("lang = 'es' AND cast(window_id AS bigint) % 50 = 0").select("source_id")
    return ma.unused_windows(w, sa.make_split(w), used, "train").select("window_id")


@query(f"""WITH {_E}, {_B} SELECT user_id::VARCHAR AS passage_id, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (gb = 1), '') AS boundaries, round(avg(y), 6) AS ai_sentence_ratio,
count(*) FILTER (y = 1 AND (gb = 1 OR i = 0))::INT AS n_spans FROM b GROUP BY user_id""")
def release_rows(spark, sf_dir):
    from seamline.config import TYPE1
    from seamline.sources.export import release_rows as rows

    s = sequences(spark, sf_dir)
    rec = s.select(F.col("user_id").cast("string").alias("record_id"), F.lit("s").alias("source_id"), F.lit("w").alias("window_id"), F.lit("dev").alias("split"), F.lit("beta").alias("generator"), F.lit(TYPE1).alias("construction_type"), F.transform("labels", lambda _: F.lit("x")).alias("sentences"), "labels")
    return rows(rec).select("passage_id", joined(F.col("boundaries")).alias("boundaries"), r6(F.col("ai_sentence_ratio")).alias("ai_sentence_ratio"), F.size("machine_spans").alias("n_spans"))


@query("SELECT user_id, min(event_id) FILTER (value > 50) AS event_id FROM events GROUP BY user_id HAVING count(*) FILTER (value > 50) > 0")
def first_valid_record(spark, sf_dir):
    from seamline.operators.validation import keep_first_valid

    e = table(spark, sf_dir, "events")
    checked = e.withColumn("integrity_errors", F.when(F.col("value") > 50, F.array().cast("array<string>")).otherwise(F.array(F.lit("low"))))
    return keep_first_valid(checked, ["event_id"], "user_id").select("user_id", "event_id")


@query(r"""WITH s AS (SELECT quality AS label, text AS a, CASE WHEN t = '' OR regexp_matches(t, '[.?!෴…]$') THEN t ELSE t || '.' END AS b FROM (
  SELECT l.quality, d.text, regexp_replace(regexp_replace(translate(d.text, '‘’‚‛“”„‟' || chr(8203) || chr(8204) || chr(8288) || chr(65279) || chr(173), repeat(chr(39), 4) || repeat(chr(34), 4)), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+([.,?!:;])', '\1', 'g'), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '') AS t FROM documents d JOIN labels l USING (doc_id))),
f AS (SELECT label, unnest(['parenthesis', 'latin', 'curly_quote', 'space_before_mark']) AS feature,
  unnest([contains(a, '('), regexp_matches(a, '[A-Za-z]'), regexp_matches(a, '[‘’“”]'), regexp_matches(a, '[\s\x{1c}-\x{1f}\x{85}\p{Z}][.,?!:;]')]) AS r,
  unnest([contains(b, '('), regexp_matches(b, '[A-Za-z]'), regexp_matches(b, '[‘’“”]'), regexp_matches(b, '[\s\x{1c}-\x{1f}\x{85}\p{Z}][.,?!:;]')]) AS n FROM s)
SELECT feature, label, round(avg(r::INT), 6) AS raw, round(avg(n::INT), 6) AS normalized FROM f GROUP BY feature, label""")
def surface_table(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    t = ag.surface_table(j, "text", "quality").where(F.col("feature").isin("parenthesis", "latin", "curly_quote", "space_before_mark"))
    return _rounded(t)


@query(f"""WITH {_E}, w AS (SELECT user_id, max(n) AS n, coalesce(min(i) FILTER (y = 1), max(n)) AS b FROM e GROUP BY user_id)
SELECT user_id % 2 AS domain, count(*)::BIGINT AS n, count(*) FILTER (b = 0)::BIGINT AS at_start, count(*) FILTER (b >= n)::BIGINT AS at_end, round(avg(b::DOUBLE / n), 6) AS mean_place FROM w GROUP BY user_id % 2""")
def corpus_report(spark, sf_dir):
    s = sequences(spark, sf_dir).select((F.col("user_id") % 2).alias("domain"), sq.first_boundary(F.col("labels")).alias("boundary"), F.size("labels").alias("n_words"))
    return _rounded(ag.corpus_report(s, ["domain"]))


@query("""SELECT kind, sum((generator = 'en')::INT)::BIGINT AS en, sum((generator = 'fr')::INT)::BIGINT AS fr FROM (
SELECT lang AS generator, CASE WHEN n_chars % 3 = 0 THEN 'length' ELSE 'copy' END AS kind FROM documents WHERE lang IN ('en', 'fr') UNION ALL SELECT lang, 'script' FROM documents WHERE lang IN ('en', 'fr') AND n_chars % 5 = 0) GROUP BY kind""")
def rejection_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    errors = F.filter(F.array(F.when(F.col("n_chars") % 3 == 0, "length: too long").otherwise("copy: 0.95"), F.when(F.col("n_chars") % 5 == 0, "script: x")), lambda e: e.isNotNull())
    return ag.rejection_matrix(d.select(F.col("lang").alias("generator"), errors.alias("errors")), ["en", "fr"])


@query("""WITH c AS (SELECT lang AS generator, sum(n_chars)::DOUBLE AS cost, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT generator, 1000::BIGINT AS target, cost / n * 1000 AS p FROM c)
SELECT generator, sum(target)::BIGINT AS target, round(sum(p), 4) AS projected_usd FROM t GROUP BY ROLLUP (generator)""")
def cost_extrapolation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("generator")).agg(F.sum("n_chars").cast("double").alias("cost_usd"), F.count(F.lit(1)).alias("n_docs"))
    t = d.select("generator", F.lit(1000).cast("long").alias("target"))
    c = ag.extrapolated_cost(d, t)
    return c.select("generator", "target", F.round("projected_usd", 4).alias("projected_usd"))


@query(rf"""WITH w AS (SELECT lang, CASE WHEN n_chars % 5 <> 0 THEN len({_SQL_WORDS})::INT END AS n, 100 AS t, n_chars % 3 AS retries FROM documents)
SELECT lang, count(*)::BIGINT AS total, count(n)::BIGINT AS produced, round(avg(n - t), 6) AS mean_word_delta, round(avg(abs(n - t)), 6) AS mean_abs_word_delta, CASE WHEN count(n) > 0 THEN 0.0::DOUBLE END AS mean_sentence_delta, round(avg(retries) FILTER (n IS NOT NULL), 6) AS mean_retries FROM w GROUP BY lang""")
def length_fidelity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.when(F.col("n_chars") % 5 != 0, tx.word_count(F.col("text"))).alias("n_words"), F.lit(100).alias("target_words"), F.lit(1).alias("n_sentences"), F.lit(1).alias("target_sentences"), (F.col("n_chars") % 3).alias("retries"))
    return _rounded(ag.length_fidelity(d, ["lang"]))


@query("""WITH a AS (SELECT event_type AS metric, avg(value) AS v FROM events GROUP BY 1), b AS (SELECT event_type AS metric, max(value) AS v FROM events GROUP BY 1)
SELECT a.metric AS metric, round(a.v, 6) AS raw, round(b.v, 6) AS normalized, round(b.v - a.v, 6) AS change FROM a JOIN b USING (metric)""")
def metric_change(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = (e.groupBy(F.col("event_type").alias("metric")).agg(f("value").alias("value")) for f in (F.avg, F.max))
    return _rounded(ag.metric_change(a, b))


@query("(SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10) UNION ALL (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 10)")
def head_and_tail(spark, sf_dir):
    return sa.head_and_tail(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 20)


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 25")
def sample_without_replacement(spark, sf_dir):
    return sa.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25)


@query(f"""WITH {_E}, p AS (SELECT avg(y) AS share FROM e), d AS (SELECT user_id, i, (('0x' || substr(md5('42:' || user_id::VARCHAR || ':' || i::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < (SELECT share FROM p))::INT AS c FROM e)
SELECT user_id, string_agg(c::VARCHAR, '' ORDER BY i) AS pred FROM d GROUP BY user_id""")
def random_prior(spark, sf_dir):
    from seamline.operators.models import RandomPrior

    s = sequences(spark, sf_dir).select("user_id", "labels", F.transform("labels", lambda _: F.lit("")).alias("sentences"))
    got = RandomPrior("user_id").fit(s).predict(s)
    return got.select("user_id", F.array_join(F.transform("pred", lambda x: x.cast("string")), "").alias("pred"))


@query("""SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles, count(*)::INT AS n FROM conversations GROUP BY conv_id""")
def regrouped_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    g = ma.regroup(c, "conv_id", "turn", ["role"])
    return g.select("conv_id", F.array_join("role", " ").alias("roles"), F.size("role").alias("n"))


@query("""WITH w AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, coalesce(string_agg(text, ' | ' ORDER BY i) FILTER (i < 2), '') AS before, coalesce(string_agg(text, ' | ' ORDER BY i) FILTER (i >= 3 AND i < 6), '') AS after FROM w GROUP BY conv_id""")
def generation_context(spark, sf_dir):
    c = ma.regroup(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["text"])
    lr = sq.left_right(F.col("text"), F.lit(2), F.lit(3), 3)
    return c.select("conv_id", lr.alias("_x")).select("conv_id", F.array_join("_x.left", " | ").alias("before"), F.array_join("_x.right", " | ").alias("after"))


@query("""SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def argmax_first_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return ev.best_row(e, "value", "event_id", by=["event_type"]).select("event_type", "event_id")


@query("SELECT DISTINCT source, lang FROM documents EXCEPT SELECT source, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def set_difference(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return d.select("source", "lang").subtract(d.join(bad, "doc_id", "left_semi").select("source", "lang"))


@query(rf"""WITH n AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\p{{Nd}}[\p{{Nd}},.٫٬]*'), lambda x: replace(regexp_replace(x, '[.,]+$', ''), ',', '')), lambda x: x <> '') AS t FROM documents),
a AS (SELECT n.doc_id, u.x, count(*) AS c FROM n, unnest(n.t) u(x) GROUP BY 1, 2),
p AS (SELECT a.doc_id, a.x, a.c, coalesce(b.c, 0) AS o FROM a LEFT JOIN a b ON b.doc_id = a.doc_id + 1 AND b.x = a.x)
SELECT d.doc_id, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id AND p.c > p.o)::INT AS n_missing FROM documents d WHERE d.doc_id + 1 IN (SELECT doc_id FROM documents)""")
def number_differences(spark, sf_dir):
    from seamline.operators.validation import number_differences as differ

    d = table(spark, sf_dir, "documents").select("doc_id", tx.numeric_tokens(F.col("text")).alias("_a"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("_a").alias("_b"))
    return d.join(nxt, "doc_id").select("doc_id", F.size(differ(F.col("_a"), F.col("_b"))[0]).alias("n_missing"))


@query()
def copy_similarity(spark, sf_dir):
    """How much of each turn of a conversation is the turn before it."""
    from seamline.functions.markup import similarity

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(similarity()(F.col("text"), F.col("before")), 6).alias("similarity"))


@query()
def bias_sweep(spark, sf_dir):
    s = sequences(spark, sf_dir)
    p = lambda v: F.greatest(F.least(v / (v + 100.0), F.lit(0.999999)), F.lit(1e-6))
    logp = F.transform("values", lambda v: F.struct(F.log1p(-p(v)).alias("h"), F.ln(p(v)).alias("m")))
    pair = F.transform(sq.indices(1, F.col("values")), lambda i: (F.abs(F.get("values", i) - F.get("values", i - 1)) - 100.0) / 50.0)
    return _rounded(ev.bias_sweep(s.select("labels", logp.alias("logp"), pair.alias("pair"))))


@query()
def length_matched(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("id"), tx.word_count(F.col("text")).alias("n"), "text")
    # Half of the documents ask, the other half answer, within each language.
    need, pool = d.where("id % 4 = 0"), d.where("id % 4 <> 0")
    m = ma.length_matched(need, pool, "id", "id", "n", "n", "text", groups=["lang"])
    return m.select("id", "matched_id", "fit", F.length("text").alias("n_chars"))


@query(f"""WITH {_E} SELECT user_id, round(sum(('0x' || substr(md5('7:' || user_id::VARCHAR || ':' || i::VARCHAR), 1, 8))::BIGINT / 4294967296.0), 6) AS total, md5('7:' || user_id::VARCHAR) AS shuffle_key FROM e GROUP BY user_id""")
def draws(spark, sf_dir):
    s = sequences(spark, sf_dir)
    total = F.aggregate(F.transform("labels", lambda _, i: uniform(7, F.col("user_id"), i)), F.lit(0.0), lambda a, x: a + x)
    return s.select("user_id", r6(total).alias("total"), shuffle_key(7, F.col("user_id")).alias("shuffle_key"))


# ------------------------------------------------------------ joins, filters and choices


@query(f"WITH {_E} SELECT user_id, max(n)::INT AS n_labels FROM e WHERE user_id % 4 <> 0 GROUP BY user_id")
def length_guarded(spark, sf_dir):
    s = sequences(spark, sf_dir)
    said = F.transform("labels", lambda _, i: i.cast("string"))
    records = s.select("user_id", F.when(F.col("user_id") % 4 == 0, F.concat(said, F.array(F.lit("x")))).otherwise(said).alias("sentences"), "labels")
    good, _ = ma.length_guard(records)
    return good.select("user_id", F.size("labels").alias("n_labels"))


@query("SELECT n.n_nationkey, r.r_regionkey FROM nation n CROSS JOIN region r WHERE n.n_regionkey <> r.r_regionkey")
def missing_cells(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    done = nations.select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return ma.missing_cells(nations.select("n_nationkey"), table(spark, sf_dir, "region").select("r_regionkey"), done, ["n_nationkey", "r_regionkey"])


@query("""SELECT lang AS generator, source AS split, count(*)::BIGINT AS n FROM documents
WHERE lang = 'en' AND source NOT IN ('src0', 'src1') OR lang = 'de' AND source <> 'src0' GROUP BY lang, source""")
def split_violations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("generator"), F.col("source").alias("split"))
    allowed = spark.createDataFrame([("en", ["src0", "src1"]), ("de", ["src0"])], "generator string, splits array<string>")
    return ag.violations(d, allowed)


@query("""SELECT user_id, count(*)::INT AS n FROM events JOIN (VALUES (0, 'mixed'), (1, 'human'), (2, 'mixed')) AS r(generator, role) ON user_id % 3 = generator
WHERE role = 'mixed' AND user_id % 2 = 0 GROUP BY user_id""")
def chosen_documents(spark, sf_dir):
    s = sequences(spark, sf_dir).select("user_id", F.size("labels").alias("n"), (F.col("user_id") % 3).cast("string").alias("generator"), F.when(F.col("user_id") % 2 == 0, "test").otherwise("train").alias("split"))
    roles = spark.createDataFrame([("0", "mixed"), ("1", "human"), ("2", "mixed")], "generator string, role string")
    return ma.filter_documents(s, split="test", roles=["mixed"], role_table=roles).select("user_id", "n")


@query(f"""WITH {_E}, w AS (SELECT user_id, max(n) AS n FROM e GROUP BY user_id)
SELECT {", ".join(f"count(*) FILTER (n >= {c.min_sentences})::BIGINT AS {t}" for t, c in Config().constructions.items())} FROM w""")
def eligible_rows(spark, sf_dir):
    return pg.eligibility(sequences(spark, sf_dir).select(F.size("labels").alias("n_sentences")))


@query(f"{_SWEEP} SELECT * FROM sweep ORDER BY false_alarm, threshold LIMIT 1")
def quietest_threshold(spark, sf_dir):
    return ev.best_row(_sweep(spark, sf_dir), "false_alarm", "threshold", highest=False)


@query(f"""{_SWEEP} SELECT threshold, f1 AS dev_f1, round(f1 / 2, 6) AS test_f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1""")
def operating_point(spark, sf_dir):
    dev = _sweep(spark, sf_dir)
    test = dev.select("threshold", F.round(F.col("f1") / 2, 6).alias("f1"))
    return ev.operating_point(dev, {"test": test}, "f1").select("threshold", F.col("dev.f1").alias("dev_f1"), F.col("test.f1").alias("test_f1"))


# ------------------------------------------------------------ statistics


@query("SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def category_histogram(spark, sf_dir):
    return ag.histogram(table(spark, sf_dir, "documents"), "lang")


@query("""WITH v AS (SELECT n_chars::DOUBLE / (SELECT max(n_chars) FROM documents) AS x FROM documents), s AS (SELECT round(avg((x < 0.1)::INT), 6) AS share FROM v)
SELECT share, CASE WHEN share < 0.25 THEN 'ok' ELSE 'skewed' END AS verdict FROM s""")
def first_decile_verdict(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("n_chars")
    top = d.agg(F.max("n_chars").alias("_m"))
    h = ag.decile_histogram(d.crossJoin(F.broadcast(top)).select((F.col("n_chars") / F.col("_m")).alias("x")), "x")
    return _rounded(ag.first_decile_verdict(h))


@query(f"""WITH {_E}, {_B}, r AS (SELECT user_id, i, n, y, sum(gb) OVER (PARTITION BY user_id ORDER BY i) AS run FROM b)
SELECT round((min(i) + max(i) + 1) / 2.0 / max(n), 6) AS midpoint FROM r WHERE y = 1 GROUP BY user_id, run""")
def span_midpoints(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("spans", F.filter(sq.runs(F.col("labels")), lambda x: x["label"] == 1))
    return _rounded(ag.span_midpoints(s))


@query("""SELECT doc_id, unnest(['chars', 'lang_code', 'absent']) AS metric, unnest([n_chars::DOUBLE, NULL, NULL]) AS value FROM documents""")
def nested_metrics(spark, sf_dir):
    payload = F.to_json(F.struct(F.struct(F.struct(F.col("n_chars").alias("n")).alias("chars"), F.col("lang")).alias("test")))
    d = table(spark, sf_dir, "documents").select("doc_id", payload.alias("payload"))
    return ag.metric_values(d, "payload", {"chars": "test.chars.n", "lang_code": "test.code", "absent": "dev.x"}, ["doc_id"])


@query("SELECT 'd' || doc_id::VARCHAR AS id, len(string_split(text, ' '))::INT AS boundary FROM documents")
def human_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return jsonl.human_documents(d, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).select("id", "boundary")


# ------------------------------------------------------------ one text


@query(r"""WITH d AS (SELECT doc_id, coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') AS t, text, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE least(0.99, greatest(0.01, (doc_id % 200) / 100.0)) END::DOUBLE AS threshold FROM documents),
k AS (SELECT doc_id, threshold, CASE WHEN t = '' THEN 'Empty input.' WHEN length(t) > 20000 THEN 'Text too long (limit 20,000 characters).' END AS error, CASE WHEN t = '' OR length(t) > 20000 THEN [] ELSE string_split(text, chr(10)) END AS l FROM d),
u AS (SELECT doc_id, threshold, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM k),
c AS (SELECT *, sum(greatest(length(x), 1) + 1) OVER (PARTITION BY doc_id ORDER BY i) <= 510 AS fits FROM u),
y AS (SELECT doc_id, i, CASE WHEN fits THEN ((length(x) % 100) / 100.0 >= threshold)::INT END AS y FROM c),
b AS (SELECT *, y <> lag(y) OVER (PARTITION BY doc_id ORDER BY i) AS changed FROM y),
g AS (SELECT doc_id, count(*) AS n, count(y) AS m, sum(y) AS a, string_agg((i - 1)::VARCHAR, ',' ORDER BY i) FILTER (changed) AS boundaries FROM b GROUP BY doc_id)
SELECT doc_id, error, coalesce(n, 0)::INT AS n_sentences, coalesce(m, 0)::INT AS n_scored, coalesce(a, 0)::INT AS n_ai, coalesce(round_even(a::DOUBLE / nullif(m, 0), 4), 0.0)::DOUBLE AS ai_ratio, threshold, coalesce(boundaries, '') AS boundaries
FROM k LEFT JOIN g USING (doc_id)""")
def analysed_documents(spark, sf_dir):
    """Documents with lines as sentences; a line's score is read from its length, and those that fit a window are scored."""
    from seamline.functions import analysis as an

    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "\n", -1).alias("s"))
    lengths = F.transform("s", F.length)
    scored = F.slice(F.transform(lengths, lambda n: (n % 100) / 100.0), F.lit(1), an.fitting(lengths))
    asked = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 200) / 100.0)
    a = d.select("doc_id", an.analysis(F.col("text"), F.col("s"), scored, asked, 0.5).alias("_a"))
    plain = ("error", "n_sentences", "n_scored", "n_ai", "ai_ratio", "threshold")
    return a.select("doc_id", *[F.col(f"_a.{c}").alias(c) for c in plain], joined(F.col("_a.boundaries")).alias("boundaries"))

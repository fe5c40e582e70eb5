import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seamline.config import TYPE1, TYPE2, TYPE3, Config
from seamline.functions import text as tx
from seamline.operators import aggregates as ag
from seamline.operators import evaluation as ev
from seamline.operators import matching as ma
from seamline.operators import pages as pg
from seamline.operators import sampling as sa
from seamline.operators import validation as va

SENT = "This is one sentence with quite a few words in it number {}."


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# ----------------------------------------------------------------- pages


def test_reasons(spark):
    body = " ".join(SENT.format(i) for i in range(30))
    cases = [
        ("A", "  ", "empty_raw"), ("A", None, "empty_raw"), (" Main Page ", body, "main_page"), ("Talk:A", body, "namespace"), ("ගොනුව:A", body, "namespace"),
        ("A", " #redirect [[B]]", "redirect"), ("A", "# යළි-යොමු [[B]]", "redirect"), ("A", body + "{{Disambig}}", "disambiguation"), ("A", body + "{{x-stub}}", "stub"),
        ("List of A", body, "list_page_title"), ("A", "* a\n* b\nc", "list_page_content"), ("A", "* a\nb\nc\n\n\nd", None), ("Talks: A", body, None), ("A", "x" * 300 + "#redirect", None),
    ]
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(cases)], "i int, t string, r string").select("i", pg.reject_reason(F.col("t"), F.col("r")).alias("why"))
    assert [r["why"] for r in sorted(df.collect(), key=lambda r: r["i"])] == [c[2] for c in cases]


def test_articles_and_waterfall(spark):
    prose = " ".join(SENT.format(i) for i in range(20))
    raw = [("1", "Good", "u", f"'''Good''' {prose}\n\n{{{{Infobox|a=b}}}}"), ("2", "Talk:x", "u", prose), ("3", "Short", "u", "Too short."), ("4", "Few", "u", "one long line of words without any end " * 30), ("5", "Words", "u", "w" * 500)]
    c = pg.classify(spark.createDataFrame(raw, "id string, title string, url string, raw_mediawiki string"), script=tx.latin_ratio).cache()
    assert dict(rows(c, "source_id", "drop_reason")) == {"1": None, "2": "namespace", "3": "too_few_chars", "4": "too_few_sentences", "5": "too_few_words"}
    good = pg.sources(c).first()
    assert good["text"].startswith("Good This is one") and good["n_sentences"] == 20 and good["n_words"] == len(good["text"].split())
    w = rows(pg.waterfall(c).orderBy("step"), "reason", "n", "remaining")
    assert [x[0] for x in w] == list(pg.REASONS) and w[-1][2] == 1 and sum(x[1] for x in w) == 4
    assert rows(pg.eligibility(pg.sources(c)), TYPE1, TYPE2, TYPE3) == [(1, 1, 1)]
    assert pg.waterfall(c.where("false")).agg(F.sum("share")).first()[0] == 0


# -------------------------------------------------------------- sampling


def make_sources(spark, n, seed=1):
    rng = random.Random(seed)
    data = [(f"s{i}", "t", "u", "d", [SENT.format(k) + " more words here to be long" for k in range(rng.randint(1, 30))]) for i in range(n)]
    return spark.createDataFrame(data, "source_id string, title string, url string, domain string, sentences array<string>")


def test_windows(spark):
    src = make_sources(spark, 120)
    sents = dict(rows(src, "source_id", "sentences"))
    w = sa.make_windows(src).collect()
    assert {r["source_id"] for r in w} == {k for k, v in sents.items() if len(v) >= 6}
    for r in w:
        assert r["sentences"] == sents[r["source_id"]][r["sent_start"] : r["sent_end"]] and 6 <= r["n_sentences"] <= 12 and r["n_words"] >= 100
    from dataclasses import replace

    several = sa.make_windows(src, replace(Config(), windows=replace(Config().windows, per_source=3))).collect()
    spans = {}
    for r in several:
        spans.setdefault(r["source_id"], []).append((r["sent_start"], r["sent_end"]))
    assert max(map(len, spans.values())) == 3 and all(a[1] == b[0] for v in spans.values() for a, b in zip(sorted(v), sorted(v)[1:], strict=False))
    assert sorted(map(tuple, sa.make_windows(src.repartition(5)).select("window_id", "sent_start").collect())) == sorted((r["window_id"], r["sent_start"]) for r in w)


def test_splits_and_fractions(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("source_id"))
    s = sa.make_split(ids.unionByName(ids))
    assert Counter(r["split"] for r in s.collect()) == {"train": 700, "dev": 150, "test": 150}
    assert sa.split_problems(s, ids).count() == 0
    bad = s.where("source_id <> '7'").unionByName(spark.createDataFrame([("8", "test"), ("8", "train"), ("x", "dev")], "source_id string, split string"))
    assert set(rows(sa.split_problems(bad, ids), "source_id", "problem")) == {("7", "none"), ("8", "several"), ("x", "unknown")}
    parts = [{r[0] for r in sa.nested_fraction(ids, ["source_id"], f).collect()} for f in (0.2, 0.5, 1.0)]
    assert [len(p) for p in parts] == [200, 500, 1000] and parts[0] < parts[1] < parts[2]
    assert sa.head_and_tail(ids.select(F.col("source_id").cast("int").alias("k")), ["k"], 6).count() == 6
    assert sorted(r[0] for r in sa.sample(ids, "source_id", 5).collect()) == sorted(r[0] for r in sa.sample(ids.repartition(7), "source_id", 5).collect())


def plan_ok(kind, n, spans):
    c = Config().constructions[kind]
    sizes = [b - a for a, b in spans]
    if kind == TYPE1:
        return spans[0][1] == n and c.min_human <= spans[0][0] <= n - c.min_machine and 0.15 <= spans[0][0] / n <= 0.85
    assert all(1 <= a < b <= n - 1 for a, b in spans) and all(a[1] + 1 <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    if kind == TYPE2:
        return len(spans) == 1 and c.ratio_min <= sizes[0] / n <= c.ratio_max
    return len(spans) in (2, 3) and sum(sizes) / n <= c.ratio_max and all(1 <= s <= 2 for s in sizes)


@pytest.mark.parametrize("kind", [TYPE1, TYPE2, TYPE3])
def test_plans(spark, kind):
    w = spark.createDataFrame([(f"w{n}_{k}", [f"s{i} x." for i in range(n)], kind) for n in range(3, 16) for k in range(12)], "window_id string, sentences array<string>, construction_type string")
    got = sa.plans(w).collect()
    need = Config().constructions[kind].min_sentences
    assert min(len(r["sentences"]) for r in got) == need and all(len(r["sentences"]) >= need for r in got)
    seen = set()
    for r in got:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert plan_ok(kind, len(r["sentences"]), spans)
        assert r["targets"] == [r["sentences"][a:b] for a, b in spans] and r["target_sentence_count"] == sum(b - a for a, b in spans) and r["target_word_count"] == 2 * r["target_sentence_count"]
        seen.add(tuple(spans))
    assert len(seen) > 10


def test_tasks(spark):
    w = spark.createDataFrame([(f"w{i:03d}", f"s{i:03d}", 3 + i % 10) for i in range(100)], "window_id string, source_id string, n_sentences int")
    s = spark.createDataFrame([(f"s{i:03d}", ("train", "dev", "test")[i % 3]) for i in range(100)], "source_id string, split string")
    quotas = {"alpha": {TYPE1: 20, TYPE2: 15, TYPE3: 10}, "gamma": {TYPE1: 5, TYPE3: 100}}
    t = sa.build_tasks(w, s, quotas).collect()
    n = {r["window_id"]: r["n_sentences"] for r in w.collect()}
    counts = Counter((r["generator"], r["construction_type"]) for r in t)
    assert counts["alpha", TYPE1] == 20 and counts["alpha", TYPE2] == 15 and counts["alpha", TYPE3] == 10 and counts["gamma", TYPE1] == 5 and counts["gamma", TYPE3] < 100
    assert len({(r["generator"], r["window_id"]) for r in t}) == len(t)
    assert all(n[r["window_id"]] >= Config().constructions[r["construction_type"]].min_sentences and (r["generator"] != "gamma" or r["split"] != "train") for r in t)
    assert sa.quota_mix(5, {"a": 0.5, "b": 0.3}) == {"a": 2, "b": 2}


def test_assemble(spark):
    p = spark.createDataFrame([("w", ["a", "b", "c", "d", "e"], [(1, 2), (3, 4)], [["X", "Y"], ["Z"]])], "window_id string, sentences array<string>, spans array<struct<start:int,end:int>>, generated array<array<string>>")
    r = sa.assemble(p).first()
    assert r["sentences"] == ["a", "X", "Y", "c", "Z", "e"] and r["labels"] == [0, 1, 1, 0, 1, 0] and r["boundaries"] == [1, 3, 4, 5]
    assert r["text"] == "a X Y c Z e" and r["boundary_position_normalized"] == 1 / 6 and r["ai_sentence_ratio"] == 0.5


# ------------------------------------------------------------ validation


def test_validation(spark):
    good = " ".join(f"මෙය වාක්‍යයක් ලෙස ලියා ඇත {i}." for i in range(3))
    words = len(good.split())
    cases = [(good, 3, words, good.replace("ලියා", "ලියමින්")), (good, 2, words, None), (good, 3, 100, None), ("Sure! " + good, 4, words, None), ("# " + good, 3, words, None), ("All in Latin letters here. Two.", 2, 7, None), (good, 3, words, good), (good, 3, words, good.replace(" 2.", " 3.")), ("  ", 1, 1, None), (None, 1, 1, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, target_sentence_count int, target_word_count int, original string")
    got = {r["i"]: r for r in va.validate(df).collect()}
    kinds = {i: [e.split(":")[0] for e in r["errors"]] for i, r in got.items()}
    assert kinds[1] == ["sentence_count"] and kinds[2] == ["length"] and kinds[3] == ["preamble"] and kinds[4] == ["markdown"]
    assert kinds[5] == ["script"] and "copy" in kinds[6] and "numbers" in kinds[7] and kinds[8] == kinds[9] == ["empty"]
    assert got[1]["errors"] == ["sentence_count: got 3, expected 2"] and got[7]["errors"][-1] == "numbers: missing=[3] added=[2]"
    assert not got[1]["passed"] and got[1]["details"]["n_sentences"] == 3 and got[8]["details"] is None


def record(spark, **changes):
    base = dict(record_id="r", source_id="s1", domain="d", generator="alpha", construction_type=TYPE1, split="train", text="a b", sentences=["a", "b"], labels=[0, 1], boundaries=[1], boundary_position_normalized=0.5, prompt_id="p", raw_output=["b"], cleaned_output=["b"], temperature=0.8, top_p=0.9, retry_count=0, validation_passed=True, validation_errors="")
    schema = "record_id string, source_id string, domain string, generator string, construction_type string, split string, text string, sentences array<string>, labels array<int>, boundaries array<int>, boundary_position_normalized double, prompt_id string, raw_output array<string>, cleaned_output array<string>, temperature double, top_p double, retry_count int, validation_passed boolean, validation_errors string"
    return spark.createDataFrame([tuple({**base, **changes}.values())], schema)


@pytest.mark.parametrize(
    ("changes", "part"),
    [
        ({}, None), ({"labels": [0, 1, 1]}, "len(sentences)=2"), ({"text": "a  b"}, "text does not"), ({"labels": [0, 2]}, "non-binary"), ({"boundaries": []}, "boundaries differ"),
        ({"labels": [0, 0], "boundaries": []}, "no AI"), ({"labels": [1, 1], "boundaries": []}, "no human"), ({"construction_type": TYPE2}, "type2"), ({"construction_type": TYPE3}, "type3"),
        ({"source_id": "zz"}, "not in any split"), ({"split": "dev"}, "source partition 'train'"), ({"generator": "gamma"}, "must not write"), ({"generator": "unknown"}, None), ({"text": None}, "missing field 'text'"),
    ],
)
def test_integrity(spark, changes, part):
    splits = spark.createDataFrame([("s1", "train")], "source_id string, split string")
    errors = va.integrity_errors(record(spark, **changes), splits).first()["integrity_errors"]
    assert errors == [] if part is None else any(part in e for e in errors)


def test_first_valid_record_wins(spark):
    splits = spark.createDataFrame([("s1", "train")], "source_id string, split string")
    many = record(spark, text="bad", retry_count=0).unionByName(record(spark, retry_count=1)).unionByName(record(spark, retry_count=2)).unionByName(record(spark, record_id="q", retry_count=3))
    got = va.keep_first_valid(va.integrity_errors(many, splits), ["retry_count"])
    assert rows(got, "record_id", "retry_count") == [("q", 3), ("r", 1)]
    assert va.integrity_errors(many.drop("top_p"), splits).first()["integrity_errors"] == ["missing field 'top_p'"]


# -------------------------------------------------------------- matching

DOC = "record_id string, source_id string, window_id string, split string, generator string, construction_type string, sentences array<string>, labels array<int>"


def twin_tables(spark):
    w = spark.createDataFrame([("w0", "s0", ["a", "b", "c", "d"]), ("w1", "s1", ["e", "f", "g"]), ("w2", "s2", ["h", "i", "j", "k"]), ("w3", "s3", ["l", "m", "n"]), ("w4", "s4", ["o", "p", "q", "r"])], "window_id string, source_id string, sentences array<string>")
    d = spark.createDataFrame([("a", "s0", "w0", "train", "alpha", TYPE1, ["a", "b", "X", "Y"], [0, 0, 1, 1]), ("b", "s0", "w0", "train", "beta", TYPE2, ["a", "Z", "c", "d"], [0, 1, 0, 0]), ("c", "s1", "w1", "test", "alpha", TYPE1, ["e", "f", "Q"], [0, 0, 1])], DOC)
    s = spark.createDataFrame([("s0", "train"), ("s1", "test"), ("s2", "train"), ("s3", "train"), ("s4", "dev")], "source_id string, split string")
    return d, w, s


def test_twins(spark):
    d, w, s = twin_tables(spark)
    got = {r["record_id"]: r for r in ma.twins(d, w).collect()}
    assert got["a__twin"]["sentences"] == ["a", "b", "c", "d"] and got["c__twin"]["labels"] == [0, 0, 0]
    assert {k: r["weight"] for k, r in got.items()} == {"a__twin": 0.5, "b__twin": 0.5, "c__twin": 1.0}
    off = d.withColumn("sentences", F.transform("sentences", lambda x: F.concat(x, F.lit("!"))))
    with pytest.raises(Exception, match="do not align"):
        ma.twins(off, w).collect()
    assert ma.twins(off, w, strict=False).where("error is not null").count() == 3
    with pytest.raises(Exception, match="not found"):
        ma.twins(d, w.where("window_id <> 'w1'")).collect()


def test_unrelated_twins(spark):
    d, w, s = twin_tables(spark)
    pool = ma.unused_windows(w, s, d)
    assert sorted(rows(pool, "window_id")) == [("w2",), ("w3",)]
    got = {r["record_id"]: r for r in ma.unrelated_twins(d, pool).collect()}
    assert got["a__unrelated"]["window_id"] == got["b__unrelated"]["window_id"] == "w2" and got["c__unrelated"]["window_id"] == "w3"
    assert got["a__unrelated"]["weight"] == 0.5 and got["c__unrelated"]["labels"] == [0, 0, 0]
    with pytest.raises(Exception, match="not enough unrelated windows"):
        ma.unrelated_twins(d, pool.where("window_id = 'w2'")).collect()
    need = spark.createDataFrame([(f"n{i}", 4) for i in range(3)], "id string, n int")
    m = ma.rank_matched(need, spark.createDataFrame([("p", 4)], "pid string, n int"), "n", "id", "pid")
    assert rows(ma.shortage(m, "pid", "n"), "n", "missing") == [(4, 2)]


def test_filters_and_guards(spark):
    d, w, s = twin_tables(spark)
    roles = spark.createDataFrame([("alpha", "seen"), ("beta", "held_out")], "generator string, role string")
    assert ma.filter_documents(d, split="train", generators=["alpha", "beta"], roles=["seen"], role_table=roles).count() == 1
    assert ma.filter_documents(d, construction_type=TYPE2).count() == 1
    with pytest.raises(ValueError):
        ma.filter_documents(d, roles=["seen"])
    good, bad = ma.length_guard(d.withColumn("labels", F.when(F.col("record_id") == "b", F.array(F.lit(1))).otherwise(F.col("labels"))))
    assert good.count() == 2 and bad.count() == 1
    v = ma.sentence_view(d)
    back = ma.regroup(v, "record_id", "idx", ["sentence", "label"])
    assert sorted(rows(back, "record_id", "sentence")) == sorted(rows(d, "record_id", "sentences"))
    f = ma.with_features(d, spark.createDataFrame([("a", [[1.0, 2.0]])], "record_id string, features array<array<double>>"), 2)
    assert {r["record_id"]: r["features"][:2] for r in f.collect()}["a"] == [[1.0, 2.0], [0.0, 0.0]]
    assert ma.missing_cells(d.select("record_id"), roles.select("generator"), spark.createDataFrame([("a", "beta")], "record_id string, generator string"), ["record_id", "generator"]).count() == 5


def test_leaks(spark):
    ref = spark.createDataFrame([("one two three four five six seven eight nine",)], "text string")
    docs = spark.createDataFrame([(1, "x ONE two  three four five six seven\neight y"), (2, "one two three four five six seven"), (3, "fresh text " * 8), (4, "fresh text " * 8)], "id int, text string")
    assert rows(ma.leaked(docs, ref, "id"), "id") == [(1,)]
    assert sorted(rows(ma.drop_leaked(docs, ref, "id"), "id")) == [(2,), (3,)]


def test_length_match(spark):
    rng = random.Random(4)
    for seed in range(60):
        pool = [(f"p{i}", rng.randint(1, 60)) for i in range(30)]
        targets = [rng.randint(1, 80) for _ in range(rng.randint(1, 30))]
        got = ma.greedy_length_match(targets, pool, seed)
        assert len({g[0] for g in got}) == len(targets)
        # The same choices with plain lists.
        free, r, order = sorted(pool, key=lambda p: (p[1], p[0])), random.Random(seed), list(range(len(targets)))
        r.shuffle(order)
        for k in order:
            t = targets[k]
            near = [p for p in free if t - 0.1 * t <= p[1] <= t + 0.1 * t]
            longer = [p for p in free if p[1] > t]
            want = (r.choice(near) if near else longer[0] if longer else next(p for p in free if p[1] == free[-1][1]))
            if near:
                assert got[k][1] == "whole" and abs(dict(pool)[got[k][0]] - t) <= 0.1 * t
                want = next(p for p in free if p[0] == got[k][0])
            else:
                assert got[k] == (want[0], "truncated" if longer else "short")
            free.remove(want)
    with pytest.raises(ValueError):
        ma.greedy_length_match([1, 1], [("p", 1)], 0)
    need = spark.createDataFrame([("n1", 4), ("n2", 50)], "nid string, n int")
    have = spark.createDataFrame([("a", 9, "One two three four. Five six seven eight nine."), ("b", 3, "Only three words.")], "pid string, n int, text string")
    out = {r["nid"]: r for r in ma.length_matched(need, have, "nid", "pid", "n", "n", "text").collect()}
    assert {(r["matched_pid"], r["fit"]) for r in out.values()} <= {("a", "truncated"), ("b", "short"), ("a", "short"), ("b", "truncated")} and len({r["matched_pid"] for r in out.values()}) == 2


# ------------------------------------------------- evaluation, aggregates


def test_human_and_loss(spark):
    p = spark.createDataFrame([([0, 1, 0],), ([0, 0, 0],), ([1, 1, 0, 0],)], "pred array<int>")
    h = ev.human_metrics(p).first()
    assert h["doc_false_alarm"] == pytest.approx(2 / 3) and h["boundaries_per_doc"] == 1.0 and h["sentence_fpr"] == pytest.approx(3 / 10)
    assert ev.human_metrics(p.where("false")).first()["doc_false_alarm"] == 0
    z = spark.createDataFrame([([(0.0, 2.0), (1.0, 0.0), (0.0, 1.0)], [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], [1, 0, 0])], "mixed array<struct<h:double,m:double>>, twin array<struct<h:double,m:double>>, labels array<int>")
    r = ev.twin_loss_terms(z, margin=4.0).first()
    assert r["consistency"] == pytest.approx(0) and r["margin_loss"] == pytest.approx(2.0) and ev.twin_loss_terms(z).first()["margin_loss"] == 0
    import math

    ce = lambda d: math.log1p(math.exp(-d))
    assert r["ce"] == pytest.approx((ce(2) + ce(1) + ce(-1)) / 3)


def test_empty_metrics(spark):
    none = spark.createDataFrame([], "labels array<int>, pred array<int>")
    s = ev.sentence_metrics(none).first()
    assert s["n"] == 0 and s["f1_ai"] == 0 and ev.boundary_metrics(none).first()["f1"] == 0


def test_choices(spark):
    g = spark.createDataFrame([(0.1, 0.5, 0.9), (0.2, 0.8, 0.6), (0.3, 0.8, 0.4), (0.4, 0.7, 0.2)], "threshold double, f1 double, fa double")
    assert ev.best_row(g, "f1", "threshold").first()["threshold"] == 0.2
    assert ev.best_row(g, "fa", "threshold", highest=False).first()["threshold"] == 0.4
    assert ev.best_row(g, "f1", "threshold", where=F.col("fa") <= 0.3).first()["threshold"] == 0.4
    assert ev.best_row(g, "f1", "threshold", where=F.col("fa") <= 0.1).count() == 0
    assert ev.operating_point(g, {"test": g}, "f1").first()["test"]["fa"] == 0.6
    a, b = {"f1": 0.5, "exact_doc_match": 0.2}, {"f1": 0.502, "exact_doc_match": 0.3}
    assert ev.choose_decoder(a, b) == "viterbi" and ev.choose_decoder(b, a) == "threshold" and ev.choose_decoder(a, {**a, "f1": 0.6}) == "viterbi" and ev.choose_decoder(a, a) == "threshold"


def test_forced_error(spark):
    d = spark.createDataFrame([("a  b c", 2), ("a b", 9), ("  x", 0)], "text string, boundary int")
    prev, after = ev.forced_error(d, "prev").first(), ev.forced_error(d, "next").first()
    assert (prev["n"], prev["n_wrong"], prev["mae"]) == (3, 0, 0) and (after["n_wrong"], round(after["mae"], 6)) == (1, 0.333333)
    hidden = spark.createDataFrame([("a  b c", 1)], "text string, boundary int")
    assert ev.forced_error(hidden, "prev").first()["mae"] == 1 and ev.forced_error(hidden, "next").first()["mae"] == 0
    w = ev.with_word_counts(d).collect()
    assert [(r["n_words"], r["gold"]) for r in w] == [(4, 2), (2, 2), (3, 0)]


def test_bias_sweep(spark):
    d = spark.createDataFrame([([0, 0, 1], [(-0.1, -2.3), (-0.3, -1.3), (-2.3, -0.1)], [-3.0, 3.0])], "labels array<int>, logp array<struct<h:double,m:double>>, pair array<double>")
    s = ev.bias_sweep(d).collect()
    assert len(s) == 33 and max(r["f1"] for r in s) == 1.0
    assert ev.evaluate(d.withColumn("pred", F.col("labels"))).first()["boundary_exact"]["f1"] == 1.0


def test_statistics(spark):
    runs = spark.createDataFrame([("f", s, v) for s, v in ((1, 0.5), (2, 0.7), (3, float("nan")))] + [("g", 1, 0.4)], "metric string, seed int, value double")
    got = {r["metric"]: r for r in ag.seed_stats(runs, ["metric"]).collect()}
    assert got["f"]["mean"] is None and got["g"]["sd"] == 0.0 and got["g"]["mean"] == 0.4
    q = ag.floor_quantiles(spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x int"), "x", (0.25, 0.5, 1.0)).first()
    assert tuple(q) == (2, 3, 4)
    one = spark.createDataFrame([(1.0, 0), (1.0, 1)], "v double, y int")
    assert ag.cohens_d(one, "v", "y").first()["d"] == 0
    assert ag.scaler(one, ["v"]).first()["v_sd"] == 1.0
    m = ag.rejection_matrix(spark.createDataFrame([("a", ["length: x", "copy: y"]), ("b", ["length: z"])], "generator string, errors array<string>"), ["a", "b"])
    assert {r["kind"]: (r["a"], r["b"]) for r in m.collect()} == {"length": (1, 1), "copy": (1, 0)}
    c = ag.extrapolated_cost(spark.createDataFrame([("a", 2.0, 4), ("b", 1.0, 1)], "generator string, cost_usd double, n_docs int"), spark.createDataFrame([("a", 10), ("b", 3)], "generator string, target int"))
    assert {r["generator"]: r["projected_usd"] for r in c.collect()} == {"a": 5.0, "b": 3.0, None: 8.0}
    s = ag.surface_table(spark.createDataFrame([("a “b” .", 0), ("plain.", 1)], "s string, y int"), "s", "y")
    t = {(r["feature"], r["label"]): (r["raw"], r["normalized"]) for r in s.collect()}
    assert t["curly_quote", 0] == (1.0, 0.0) and t["space_before_mark", 0] == (1.0, 0.0) and t["curly_quote", 1] == (0.0, 0.0)
    f = ag.length_fidelity(spark.createDataFrame([("g", 10, 12, 2, 2, 1), ("g", None, 5, None, 1, None)], "g string, n_words int, target_words int, n_sentences int, target_sentences int, retries int"), ["g"]).first()
    assert (f["total"], f["produced"], f["mean_word_delta"], f["mean_retries"]) == (2, 1, -2, 1.0)
    t = {r["feature"]: r["raw"] for r in ag.surface_table(spark.createDataFrame([("a \u200b\u201e) b.", 0)], "s string, y int"), "s", "y").collect()}
    assert t["zero_width_non_joiner"] == t["curly_quote"] == t["parenthesis"] == 0
    p = ag.pass_rates(spark.createDataFrame([("a", 2.0), ("a", 1.0)], "generator string, cost_usd double"), spark.createDataFrame([("a",)], "generator string"), kinds=["a", "b"])
    assert sorted(rows(p, "generator", "calls", "rejected", "pass_rate", "cost_usd")) == [("a", 2, 1, 0.5, 3.0), ("b", 0, 0, 0.0, 0.0)]
    v = ag.violations(spark.createDataFrame([("gamma", "train"), ("gamma", "dev")], "generator string, split string"), spark.createDataFrame([("gamma", ["dev", "test"])], "generator string, splits array<string>"))
    assert rows(v, "generator", "split", "n") == [("gamma", "train", 1)]
    o = ag.decile_histogram(spark.createDataFrame([(0.05,), (1.0,), (0.95,)], "x double"), "x")
    assert {r["bin"]: r["n"] for r in o.collect()} == {**dict.fromkeys(range(10), 0), 0: 1, 9: 2} and ag.first_decile_verdict(o).first()["verdict"] == "skewed"
    spans = spark.createDataFrame([([(1, 3)], [0, 1, 1, 0])], "spans array<struct<start:int,end:int>>, labels array<int>")
    assert rows(ag.span_midpoints(spans), "midpoint") == [(0.5,)]


def test_more_of_plans_and_reports(spark, sf):
    w = spark.createDataFrame([("w", [f"s{i} x." for i in range(9)], TYPE2)], "window_id string, sentences array<string>, construction_type string")
    p = sa.plans(w)
    g = sa.human_counterpart(sa.comparison_grid(p, ["alpha", "beta"])).collect()
    assert [r["generator"] for r in g] == ["alpha", "beta"] and g[0]["spans"] == g[1]["spans"] and g[0]["human"] == " ".join(g[0]["targets"][0])
    r = ag.word_class_weights(spark.createDataFrame([("a  b c", 2), ("d", 1)], "text string, boundary int")).first()
    assert (r["weight_0"], r["weight_1"]) == (4 / 4, 4 / 4)
    m = ag.metric_values(spark.createDataFrame([("r", '{"a": {"b": 0.5}}')], "run string, j string"), "j", {"x": "a.b", "y": "a.c"}, ["run"])
    assert {x["metric"]: x["value"] for x in m.collect()} == {"x": 0.5, "y": None}
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert pg.file_counts(d).agg(F.sum("n")).first()[0] == d.count()

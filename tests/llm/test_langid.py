import math

from fixtures import DOCS, ODD, clashing, docs
from pyspark.sql import functions as F

from seamline.llm import langid, queries

EN = "the cat and the dog of the house with that thing which was there and then"
DE = "der hund und die katze mit dem haus nicht ein das sich auch noch werden"


def corpus(spark, extra=()):
    rows = [(i, f"{EN if i % 2 else DE} {i}", "en" if i % 2 else "de", "x.example.de" if i % 2 == 0 else "y.example.com") for i in range(60)]
    return docs(spark, rows + list(extra))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_recognises(spark):
    got = by_id(langid.identify(corpus(spark)))
    assert all(r["language"] == ("en" if i % 2 else "de") and r["accepted"] and r["confidence"] > 0.99 for i, r in got.items())


def test_wrong_declaration_loses_to_text_and_breaks_ties(spark):
    extra = [(100, EN, "de", "z"), (101, None, "de", "z"), (102, "12 34 !!", "en", "z"), (103, EN, None, None), (104, EN, "en-GB", "z"), (105, EN, "tlh", "z")]
    got = by_id(langid.identify(corpus(spark, extra)))
    assert got[100]["language"] == "en" and got[100]["accepted"]
    assert got[101]["language"] == "de" and not got[101]["accepted"]
    assert got[102]["language"] == "en" and not got[102]["accepted"]
    assert all(got[i]["language"] == "en" and got[i]["accepted"] for i in (103, 104, 105))


def test_foreign_text_is_rejected(spark):
    model = langid.fit(corpus(spark), "text", "lang", "doc_id")
    got = by_id(langid.identify(corpus(spark, [(100, "wqxz qzwx xqzw zxqw " * 20, "en", "y.example.com")]), model=model))
    assert not got[100]["accepted"]


def test_fusion_against_brute_force(spark):
    d = corpus(spark, [(100, "haus the", "de", "new.example.de"), (101, "ab", "en", "x.example.de")])
    model = langid.fit(d, "text", "lang", "doc_id")
    got = by_id(langid.identify(d, model=model))
    rows = d.collect()
    ll = {r["doc_id"]: model.score((r["text"] or "").encode()) for r in rows}
    soft = lambda s: [math.exp(x - max(s)) / sum(math.exp(y - max(s)) for y in s) for x in s]
    host, suffix = {}, {}
    for r in rows:
        p = soft(ll[r["doc_id"]][0])
        suf = r["source"].rsplit(".", 1)[1]
        for t, k in ((host, r["source"]), (suffix, suf)):
            t[k] = [a + b for a, b in zip(t.get(k, [0, 0]), p, strict=True)]
    total = [sum(v[i] for v in suffix.values()) for i in range(2)]
    g = [(total[i] + 2 * 0.5) / (sum(total) + 2) for i in range(2)]
    for r in rows:
        suf = r["source"].rsplit(".", 1)[1]
        s = [(suffix[suf][i] + langid.SUFFIX_WEIGHT * g[i]) / (sum(suffix[suf]) + langid.SUFFIX_WEIGHT) for i in range(2)]
        h = host[r["source"]]
        p = [(h[i] + langid.HOST_WEIGHT * s[i]) / (sum(h) + langid.HOST_WEIGHT) for i in range(2)]
        score = []
        for i, lang in enumerate(model.languages):
            tag = math.log(0.9 if r["lang"] == lang else 0.1)
            ccs = math.log(0.7 if lang == "de" else 0.3) if suf == "de" else 0.0
            score.append(ll[r["doc_id"]][0][i] + tag + ccs + math.log(p[i]))
        want = soft(score)
        assert abs(max(want) - got[r["doc_id"]]["confidence"]) < 1e-6
        assert got[r["doc_id"]]["language"] == model.languages[want.index(max(want))]


def test_columns(spark):
    row = spark.createDataFrame([("https://U@Sub.Example.DE:80/en/1?x#y", '<!DOCTYPE html><HTML  dir="ltr" lang=\'fr-CA\'><p lang="en">')], "u string, h string")
    r = row.select(langid.host_of(F.col("u")).alias("h"), langid.suffix_of(langid.host_of(F.col("u"))).alias("s"), langid.declared_in_markup(F.col("h")).alias("l"), langid.primary(F.lit("EN_gb")).alias("p")).first()
    assert tuple(r) == ("sub.example.de", "de", "fr-CA", "en")


def test_odd_rows(spark):
    d = clashing(docs(spark, ODD))
    got = langid.identify(d)
    assert got.columns == [c for c in d.columns if c not in ("language", "accepted")] + ["language", "confidence", "accepted"]
    assert got.count() == len(ODD) and {r["_id"] for r in got.select("_id").collect()} == {"mine"}
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0
    none = langid.identify(docs(spark, [(1, "text", None, "a")])).first()
    assert none["language"] is None and not none["accepted"]


def test_accuracy(spark, sf):
    got = queries.op10_language_id(spark, sf)
    assert got.columns == ["page_id", "host", "declared", "language", "confidence", "accepted"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count() and all(r["host"] and r["declared"] for r in rows)
    assert sum(r["declared"] == r["language"] for r in rows) >= 0.97 * len(rows) and sum(r["accepted"] for r in rows) >= 0.97 * len(rows)


def test_without_text(spark):
    rows = [(i, EN, "en", "http://a.uk/x") for i in range(20)] + [(50 + i, DE, "de", "b.de") for i in range(20)]
    whole = langid.identify(docs(spark, rows))
    less = langid.identify(docs(spark, rows), with_text=False)
    assert less.columns == [c for c in whole.columns if c != "text"]
    assert sorted(map(tuple, less.collect())) == sorted(map(tuple, whole.drop("text").collect()))


def test_every_declared_language_has_a_model(spark):
    # More than 32 languages, each in letters of its own; the last of them is rare.
    word = lambda k: chr(97 + k % 26) + chr(97 + (k // 26 + k) % 26)
    tags = [f"q{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    rows = [(100 * k + i, f"{word(k) * 3} {word(k)} {word(k) * 2} " * 10, tag, "z") for k, tag in enumerate(tags) for i in range(2 if k == 39 else 6)]
    got = by_id(langid.identify(docs(spark, rows)))
    assert all(got[i]["language"] == tag and got[i]["accepted"] for i, _, tag, _ in rows)


def test_a_rare_language_is_sampled_whole(spark):
    rows = [(i, EN, "en", "z") for i in range(3000)] + [(5000 + i, DE, "de", "z") for i in range(3)]
    alone, among = (langid.fit(docs(spark, r), "text", "lang", "doc_id", documents=30) for r in (rows[3000:], rows))
    assert among.languages == ("de", "en") and (among.log_p[:, 0] == alone.log_p[:, 0]).all()

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.config import TYPE1, Config, load
from seamline.operators import models as mo
from seamline.operators import sampling as sa
from seamline.sources import export, generate, jsonl
from seamline.streaming import logs

DOC = "record_id string, sentences array<string>, labels array<int>"


def toy(spark, n=60):
    rng = random.Random(1)
    say = lambda y: " ".join(rng.choice(["zorq", "zib", "zan"] if y else ["malu", "mero", "mita"]) for _ in range(6))
    data = []
    for i in range(n):
        y = [0] * 3 + [1] * 2
        data.append((f"r{i}", [say(v) for v in y], y))
    return spark.createDataFrame(data, DOC)


def test_baselines(spark):
    d = toy(spark)
    flat = lambda df: [x for r in df.collect() for x in r["pred"]]
    assert set(flat(mo.Constant(0).fit(d).predict(d))) == {0} and set(flat(mo.Constant(1).predict(d))) == {1}
    r = mo.RandomPrior().fit(d)
    assert r.share == pytest.approx(0.4) and abs(sum(flat(r.predict(d))) / 300 - 0.4) < 0.12
    by = lambda df: {x["record_id"]: x["pred"] for x in df.collect()}
    assert by(r.predict(d)) == by(r.predict(d.repartition(5)))
    p = mo.PositionPrior().fit(d)
    assert flat(p.predict(d))[:5] == [0, 0, 0, 1, 1]
    assert mo.RandomPrior().fit(d.where("false")).share == 0.5


def test_char_ngrams():
    assert mo.char_wb_ngrams("Ab c", 2, 3) == [" a", "ab", "b ", " ab", "ab ", " c", "c ", " c "]
    assert mo.char_wb_ngrams("a", 2, 4) == [" a", "a ", " a "]
    assert mo.char_wb_ngrams("", 2, 4) == []


def test_tfidf(spark):
    rows = spark.createDataFrame([("ab ab",), ("ab c",), ("c d",)], "t string")
    m = mo.TfIdf("t", "v", 2, 2, 2, 100).fit(rows)
    idf = dict(zip(m.vocabulary.vocabulary, m.idf, strict=True))
    assert idf["ab"] == pytest.approx(math.log(4 / 3) + 1) and "d " not in idf and sorted(idf) == sorted([" a", "ab", "b ", " c", "c "])
    v = m.transform(rows).first()["v"]
    at = m.vocabulary.vocabulary.index("ab")
    assert v[at] == pytest.approx(1 / math.sqrt(3))


def test_grams_as_numbers_are_those_of_the_plain_loop(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(3)
    texts = ["a\0b ab", "😀b 😀😀cd é", "", " \n", None, "x", "ab" * 20 + "  c"] + ["".join(rng.choice("ab cé😀\0İß ") for _ in range(rng.randrange(40))) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], ["t"]) for t in (texts, [])]
    monkeypatch.setattr(mo, "GRAMS_AT_ONCE", 7)
    for known in (5, 10_000):
        monkeypatch.setattr(mo, "KNOWN_GRAMS", known)
        for low, high in ((2, 4), (1, 2), (4, 5)):
            own = [Counter(mo.char_wb_ngrams(t or "", low, high)) for t in texts]
            tf, df = Counter(), Counter()
            for r in [r for b in mo.gram_counts(low, high)(iter(batches)) for r in b.to_pylist()]:
                tf[r["_g"]] += r["_tf"]
                df[r["_g"]] += r["_df"]
            assert df.pop(None) == len(texts) and tf.pop(None) == 0
            assert tf == sum(own, Counter()) and df == Counter(g for c in own for g in c)
            some = sorted(tf)[::2]
            numbers = mo.GramNumbers(low, high, some)
            for t, c in zip(texts, own, strict=True):
                at, n = numbers.count(t)
                assert list(at) == sorted(at) and {some[i]: k for i, k in zip(at, n, strict=True)} == {g: k for g, k in c.items() if g in set(some)}


def test_vocabulary_takes_frequent_grams_then_the_first(spark):
    rows = spark.createDataFrame([("ab ab cd",), ("ab cd ef",), ("ef gh",), ("gh",)], "t string")
    assert mo.TfIdf("t", "v", 2, 2, 1, 4).fit(rows).vocabulary.vocabulary == [" a", "ab", "b ", " c"]
    assert mo.TfIdf("t", "v", 2, 2, 1, 3).fit(rows).vocabulary.vocabulary == [" a", "ab", "b "]
    assert mo.TfIdf("t", "v", 2, 2, 3, 9).fit(rows.where("false")).vocabulary.vocabulary == []


def test_linear_model_is_least_after_few_iterations(spark, sf):
    """Spark's estimator takes 140 iterations to an objective of 0.485126."""
    d = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("doc_id % 5 <> 0")
    m = mo.LinearDetector(max_iter=2000).fit(d.select(F.col("doc_id").alias("record_id"), F.array("text").alias("sentences"), F.array("quality").alias("labels")))
    assert m.model.summary.totalIterations <= 40 and m.model.summary.objectiveHistory[-1] <= 0.48512
    rows = m._matrix(m._rows(d.select(F.col("doc_id").alias("record_id"), F.array("text").alias("sentences"), F.array("quality").alias("labels")))).select("_v", "_y").collect()
    x, y = np.array([r["_v"].toArray() for r in rows]), np.array([r["_y"] for r in rows])
    w = len(y) / 2 / np.where(y == 1, y.sum(), len(y) - y.sum())
    beta, share = m.model.coefficients, 1 / (1 + np.exp(-(x @ m.model.coefficients + m.model.intercept)))
    assert np.abs(x.T @ (w * (share - y)) + beta).max() < 1e-4 and abs((w * (share - y)).sum()) < 1e-4


def test_linear_detector(spark):
    d = toy(spark)
    for options in ({}, {"context": 1, "position": True}, {"text": False, "features": 2}):
        x = d.withColumn("features", F.transform("labels", lambda y: F.array(y.cast("double") + 0.1, F.lit(1.0))))
        m = mo.LinearDetector(max_iter=40, max_features=500, **options).fit(x.where("record_id < 'r4'"))
        got = m.predict(x.where("record_id >= 'r4'")).collect()
        assert all(r["pred"] == r["labels"] for r in got)


def test_regularisation_matches_the_penalty_on_sums(spark):
    """One feature, two rows: the weight minimises w*w/2 + C * sum of losses."""
    d = spark.createDataFrame([("a", ["x"], [1], [[1.0]]), ("b", ["x"], [0], [[-1.0]])], DOC + ", features array<array<double>>")
    m = mo.LinearDetector(text=False, features=1, c=0.5, max_iter=100).fit(d)
    w = m.model.coefficients[0]
    assert w == pytest.approx(0.5 * 2 / (1 + math.exp(w)), abs=1e-3)


def test_external_scores_and_chunks(spark):
    d = toy(spark, 5)
    got = mo.score_with(d, lambda: lambda docs: [[len(s) / 100 for s in x] for x in docs]).collect()
    assert all(r["proba"] == [len(s) / 100 for s in r["sentences"]] for r in got)
    n = spark.createDataFrame([([4, 4, 4, 30, 1],)], "n array<int>").select(mo.pack_sentences(F.col("n"), 10).alias("c")).first()["c"]
    assert n == [0, 0, 1, 2, 3]
    t = spark.createDataFrame([(i, 10) for i in (100, 600)], "t int, w int")
    assert mo.token_profile(t, "t", "w").first()["over_window"] == 0.5


def test_jsonl(spark, tmp_path):
    p = str(tmp_path / "a")
    assert jsonl.write(spark.createDataFrame([(1, "é"), (2, "x")], "a int, b string"), p) == 2
    assert jsonl.write(spark.createDataFrame([(3, "y")], "a int, b string"), p, append=True) == 1
    (tmp_path / "a" / "part-x.json").write_text('{"a": 4, "b": "z"}\n\n{"a": 5, "b": "to')
    assert sorted(r["a"] for r in jsonl.read(spark, p, "a int, b string").collect()) == [1, 2, 3, 4]
    assert jsonl.read(spark, p, "a int, b string", keep_torn=True).cache().where("_torn is not null").count() == 1
    assert jsonl.read(spark, str(tmp_path / "none"), "a int").count() == 0


def test_lines_and_word_task(spark, tmp_path):
    f = tmp_path / "w.jsonl"
    f.write_text("\n".join(json.dumps({"text": f"t {i}", "label": i % 3, "model": "m", "domain_model": "rev_big_gpt"}) for i in range(50)) + "\n")
    lines = jsonl.numbered_lines(spark, str(f))
    assert sorted(r["line"] for r in lines.collect()) == list(range(50))
    docs = {r["id"]: r for r in jsonl.word_task(lines).collect()}
    assert docs["test_7"]["text"] == "t 7" and docs["test_7"]["domain"] == "rev" and docs["test_7"]["generator"] == "big_gpt"
    t = jsonl.all_texts(spark.createDataFrame([("a", ""), (None, "b")], "x string, y string"), ["x", "y"])
    assert sorted(tuple(r) for r in t.collect()) == [("x", "a"), ("y", "b")]
    h = jsonl.human_documents(spark.createDataFrame([("a b  c",)], "text string"), F.lit("k")).first()
    assert h["boundary"] == 4 and h["id"] == "k"


def test_trees_digests_and_splits(spark, tmp_path):
    d = tmp_path / "tree" / "venue_17" / "reviews"
    d.mkdir(parents=True)
    (d / "12.json").write_text(json.dumps({"id": "12", "reviews": [{"comments": " good "}, {"comments": ""}, {"comments": "bad"}]}, indent=1))
    got = sorted((r["venue"], r["paper"], r["idx"], r["text"]) for r in jsonl.review_tree(spark, str(tmp_path / "tree")).collect())
    assert got == [("venue_17", "12", 0, "good"), ("venue_17", "12", 2, "bad")]
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc")
    v = jsonl.verified(spark, str(tmp_path / "f.bin"), {"f.bin": hashlib.sha256(b"abc").hexdigest(), "g": "0"})
    assert {r["file"]: r["ok"] for r in v.collect()} == {"f.bin": True, "g": False}
    s = spark.createDataFrame([("a", "train"), ("b", "dev"), ("c", "test")], "source_id string, split string")
    jsonl.write_split_lists(s, str(tmp_path / "splits"))
    assert sorted(map(tuple, jsonl.read_split_lists(spark, str(tmp_path / "splits")).collect())) == [("a", "train"), ("b", "dev"), ("c", "test")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        jsonl.read_split_lists(spark, str(tmp_path / "nothing")).count()


def test_release(spark, tmp_path):
    w = spark.createDataFrame([("w0", "s0", ["a", "b"]), ("w1", "s1", ["c", "d"]), ("w2", "s2", ["e"])], "window_id string, source_id string, sentences array<string>")
    s = spark.createDataFrame([("s0", "train"), ("s1", "test")], "source_id string, split string")
    rec = spark.createDataFrame([("r1", "s0", "w0", "train", "alpha", TYPE1, ["a", "X"], [0, 1]), ("r0", "s0", "w0", "train", "beta", TYPE1, ["Y", "b"], [1, 0])], "record_id string, source_id string, window_id string, split string, generator string, construction_type string, sentences array<string>, labels array<int>")
    rel = export.release_rows(rec)
    r = {x["passage_id"]: x for x in rel.collect()}
    assert r["r1"]["boundaries"] == [1] and [tuple(x) for x in r["r0"]["machine_spans"]] == [(0, 1)] and r["r1"]["construction_type"] == "type1" and r["r1"]["ai_sentence_ratio"] == 0.5
    h = {x["window_id"]: x for x in export.human_rows(rec, w, s).collect()}
    assert set(h) == {"w0", "w1"} and h["w0"]["passage_ids"] == ["r0", "r1"] and h["w1"]["passage_ids"] == [] and h["w1"]["labels"] == [0, 0]
    with pytest.raises(Exception, match="differ"):
        export.release_rows(rec.withColumn("labels", F.array(F.lit(1)))).collect()
    with pytest.raises(Exception, match="several splits"):
        export.human_rows(rec.withColumn("split", F.when(F.col("record_id") == "r0", "dev").otherwise("train")), w, s).collect()
    export.write_release(rel, str(tmp_path / "rel"))
    assert spark.read.parquet(str(tmp_path / "rel")).count() == 2 and (tmp_path / "rel" / "construction_type=type1" / "split=train").exists()
    st = export.statistics(rel)
    assert tuple(st["totals"].first()) == (2, 4, 1, 1) and st["type_by_split"].first()["train"] == 2
    assert export.markdown_table(st["totals"]).startswith("| passages |") and "## x" in export.prompt_document({"d": {"x": {"user": "u"}}})


def tasks(spark):
    w = spark.createDataFrame([(f"w{i}", [f"මුල් වාක්‍ය අංක {k} මෙතන ඇත." for k in range(8)], TYPE1, "alpha", f"r{i}") for i in range(6)], "window_id string, sentences array<string>, construction_type string, generator string, record_id string")
    return sa.plans(w)


def test_generation(spark):
    got = generate.generate(tasks(spark), generate.DryRun).collect()
    assert len(got) == 6 and all(r["passed"] and r["attempts"] == 1 and not r["rejections"] for r in got)
    again = generate.generate(tasks(spark).repartition(3), generate.DryRun).collect()
    assert {r["record_id"]: r["pieces"] for r in got} == {r["record_id"]: r["pieces"] for r in again}
    made = tasks(spark).join(generate.generate(tasks(spark), generate.DryRun).select("record_id", F.col("pieces").alias("generated")), "record_id")
    assert all(len(r["boundaries"]) == 1 and sum(r["labels"]) == r["target_sentence_count"] for r in sa.assemble(made).collect())


def test_generation_failures(spark):
    class Bad:
        def complete(self, **_):
            return generate.Completion("no", 3, 1)

    class Broke:
        def complete(self, **_):
            raise generate.FatalError("402: credit")

    got = generate.generate(tasks(spark), Bad).collect()
    assert all(not r["passed"] and r["attempts"] == 3 and len(r["rejections"]) == 3 and r["pieces"] is None for r in got)
    assert got[0]["cost_usd"] == pytest.approx(3 * (3 * 2.5e-7 + 1e-6))
    with pytest.raises(Exception, match="402"):
        generate.generate(tasks(spark), Broke).collect()


def test_retries():
    calls, slept = [], []

    class Flaky:
        def complete(self, **_):
            calls.append(1)
            if len(calls) < 3:
                generate.outcome_of_status(429, "slow", 7.0)
            return generate.Completion("ok", 1, 1, 0.5)

    c = generate.completed(Flaky(), 5, random.Random(0), slept.append)
    assert c.text == "ok" and slept == [7.0, 7.0] and generate.cost_of(c, 1, 1) == 0.5
    with pytest.raises(generate.FatalError):
        generate.outcome_of_status(402)
    with pytest.raises(generate.RetryableError):
        generate.completed(type("A", (), {"complete": lambda self, **k: generate.outcome_of_status(503)})(), 2, random.Random(0), slept.append)
    assert generate.outcome_of_status(200) is None and generate.backoff(9, random.Random(0)) <= 60
    with pytest.raises(KeyError):
        generate.render("{a} {b}", {"a": 1})


def test_pending_and_prices(spark):
    t, d = spark.createDataFrame([("a",), ("b",), ("c",)], "record_id string"), spark.createDataFrame([("b",)], "record_id string")
    assert [r[0] for r in generate.pending(t, d, limit=1).collect()] == ["a"] and generate.pending(t, d).count() == 2
    g = Config().generators
    p = spark.createDataFrame([(g["alpha"].slug, g["alpha"].price_prompt, g["alpha"].price_completion), (g["beta"].slug, 1.0, 1.0)], "slug string, prompt double, completion double")
    assert {r["generator"]: r["problem"] for r in generate.price_drift(p).collect()} == {"beta": "drift", "gamma": "missing"}


def test_streams(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    schema = "record_id string, generator string, prompt_tokens long, completion_tokens long, cost_usd double"
    line = lambda i, g="a": json.dumps({"record_id": i, "generator": g, "prompt_tokens": 1, "completion_tokens": 2, "cost_usd": 0.5})
    (src / "1.json").write_text("\n".join([line("x"), line("x"), "", line("y"), '{"record_id": "to']))
    logs.append_new(logs.tail(spark, str(src), schema), out, cp).awaitTermination()
    (src / "2.json").write_text("\n".join([line("y"), line("z", "b")]))
    logs.append_new(logs.tail(spark, str(src), schema), out, cp).awaitTermination()
    assert sorted(r["record_id"] for r in spark.read.parquet(out).collect()) == ["x", "y", "z"]
    q = logs.running_totals(logs.tail(spark, str(src), schema)).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["generator"]: r["calls"] for r in spark.table("totals").collect()} == {"a": 4, "b": 1}
    q = logs.distinct_records(logs.tail(spark, str(src), schema)).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 3


def test_yaml(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("seed: 3\nwindows: {min_words: 5}\n")
    assert load(str(f)).windows.min_words == 5 and load(str(f)).seed == 3

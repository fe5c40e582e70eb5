import itertools
import random
import time
import zlib

import numpy as np
from fixtures import DOCS, ODD, clashing, docs

from seamline.llm import quality, queries


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    counts = np.array([1, 4, 2, 5])
    unary = rng.normal(size=int(counts.sum()))
    crf = quality.Crf(np.zeros(quality.WIDTH), rng.normal(size=(2, 2)))
    good, pairs = crf._run(unary, counts)
    at, expected = 0, np.zeros((2, 2))
    for n in counts:
        total, mass = 0.0, np.zeros(n)
        each = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[at + i] for i in range(n) if y[i]) + sum(crf.pairs[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            mass += w * np.array(y)
            for i in range(1, n):
                each[y[i - 1], y[i]] += w
        assert np.allclose(good[at : at + n], mass / total)
        expected += each / total
        at += n
    assert np.allclose(pairs, expected)


def test_line_features():
    x, size = quality.line_features(b"")
    assert x.shape == (1, quality.WIDTH) and size.tolist() == [1] and x[0, quality.OWN - 1] == 1
    x, size = quality.line_features("AB cd12\n\n!!| é é".encode())
    assert size.tolist() == [8, 1, 10]
    assert np.allclose(x[0, 1:5], [2 / 7, 2 / 7, 2 / 7, 1 / 7]) and np.allclose(x[2, [6, 7, 8]], [1 / 9, 2 / 9, 4 / 9])
    assert np.allclose(x[0, 2 * quality.OWN : 3 * quality.OWN], x[1, : quality.OWN]) and np.allclose(x[1, quality.OWN : 2 * quality.OWN], x[0, : quality.OWN])


def some_model():
    rng = np.random.default_rng(7)
    return quality.Model(quality.Crf(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2))), rng.normal(size=quality.WIDTH), rng.uniform(0.5, 2, quality.WIDTH), (3.0, -1.0))


def test_long_texts_score_as_whole_ones():
    rng, model = random.Random(8), some_model()
    for _ in range(200):
        t = "".join(rng.choice("aB1 .|!é\n\n") for _ in range(rng.randint(0, 60))).encode()
        x, size = quality.line_features(t)
        for lines in (1, 2, 5):
            made = list(quality.line_pieces(t, lines))
            assert np.allclose(np.concatenate([m[0] for m in made]), x) and np.concatenate([m[1] for m in made]).tolist() == size.tolist()
            assert abs(model.long_quality(t, lines) - model.quality([(x, size)])[0]) < 1e-9
    texts = [b"a b\n" * n for n in (0, 3, 40, 1, 7, 100, 2)]
    assert np.allclose(model.scores(texts, 10), model.scores(texts))


def test_millions_of_lines():
    start = time.process_time()
    s = some_model().scores([b"\n" * 2_000_000, b"one line"])
    assert ((0 <= s) & (s <= 1)).all() and time.process_time() - start < 60


def test_learns(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(200):
        good = i % 3 != 0
        line = lambda g=good: " ".join(rng.choice(["the", "quick", "brown", "fox", "jumps"]) + ("" if g else "!!") for _ in range(8)) + "."
        rows.append((i, "\n".join(line() if good else line().upper() for _ in range(rng.randint(1, 6))), "en", "s"))
        labels.append((i, int(good), 0))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (5, 7, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, rows), lab).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in got) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_odd_rows(spark):
    d = clashing(docs(spark, ODD))
    lab = spark.createDataFrame([(4, 1), (6, 0), (7, 0)], "doc_id long, quality int")
    got = quality.classify(d, lab)
    assert got.columns == [c for c in d.columns if c not in ("score", "predicted")] + ["score", "predicted", "held_out"]
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r["score"] is not None and r["_id"] == "mine" for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(d, none).collect()} == {0.5}
    assert quality.classify(spark.createDataFrame([], DOCS), lab).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_line_crf_quality(spark, sf)
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = got.where("held_out").join(lab, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    bad, good = [r["score"] for r in rows if not r["quality"]], [r["score"] for r in rows if r["quality"]]
    assert bad and sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)

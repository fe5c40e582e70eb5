import random

from pyspark.sql import functions as F

from seamline.functions import analysis as an


def test_a_window_ends_at_the_first_sentence_that_does_not_fit(spark):
    cases = [[], [0, 0], [4, 4, 4], [4, 9, 1], [20], [9], [4, 4, 0, 0, 1]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, n array<int>")
    got = [r["k"] for r in df.orderBy("i").select(an.fitting(F.col("n"), 10).alias("k")).collect()]
    want = []
    for c in cases:
        used = k = 0
        for n in c:
            used += max(n, 1) + 1
            if used > 10:
                break
            k += 1
        want.append(k)
    assert got == want


def test_threshold_is_clamped_or_the_default(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["0.3", "-1", "7", "x", None, "NaN"])], "i int, x string")
    assert [r["t"] for r in df.orderBy("i").select(an.asked_threshold(F.col("x"), 0.999).alias("t")).collect()] == [0.3, 0.01, 0.99, 0.999, 0.999, 0.01]


def test_analysis(spark):
    rows = [
        (0, "a b. c. d", ["a b.", "c.", "d"], [0.2, 0.9], None),
        (1, " \n", ["x"], [0.5], None),
        (2, "x" * 20_001, ["x"], [0.5], None),
        (3, "x" * 20_000 + "  ", ["x"], [0.5], 0.6),
        (4, "...", [], [], None),
        (5, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, text string, s array<string>, p array<double>, t double")
    got = [r["a"] for r in df.orderBy("i").select(an.analysis(F.col("text"), F.col("s"), F.col("p"), F.col("t"), 0.4).alias("a")).collect()]
    assert [g["error"] for g in got] == [None, an.EMPTY, an.TOO_LONG, None, an.NO_SENTENCES, an.EMPTY]
    first = got[0]
    assert [(s["prob_ai"], s["label"], s["words"], s["truncated"]) for s in first["sentences"]] == [(0.2, 0, 2, False), (0.9, 1, 1, False), (None, None, 1, True)]
    assert (first["boundaries"], first["n_sentences"], first["n_scored"], first["n_ai"], first["ai_ratio"], first["threshold"], first["truncated"]) == ([1], 3, 2, 1, 0.5, 0.4, True)
    assert (got[3]["n_ai"], got[3]["threshold"]) == (0, 0.6)
    assert all((g["n_sentences"], g["sentences"], g["ai_ratio"]) == (0, [], 0.0) for g in (got[1], got[2], got[4], got[5]))


def test_word_chunks_keep_words_whole_and_in_order(spark):
    rng = random.Random(5)
    docs = [([[rng.randrange(9) for _ in range(rng.choice([0, 1, 2, 3, 12]))] for _ in range(rng.randrange(30))]) for _ in range(20)]
    rows = [(i, d, [k % 2 for k in range(len(d))]) for i, d in enumerate(docs)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "i int, t array<array<int>>, y array<int>")
    got = {r["i"]: r["c"] for r in df.select("i", an.word_chunks(-1, -2, 8)(F.col("t"), F.col("y")).alias("c")).collect()}
    assert got.pop(99) == []
    for i, chunks in got.items():
        assert [w for c in chunks for w in c["words"]] == [k for k, t in enumerate(docs[i]) if t]
        for c, after in zip(chunks, [*chunks[1:], None], strict=True):
            assert c["ids"][0] == -1 and c["ids"][-1] == -2 and len(c["ids"]) <= 10
            assert c["labels"] == [w % 2 for w in c["words"]]
            for w, a, b in zip(c["words"], c["starts"], [*c["starts"][1:], len(c["ids"]) - 1], strict=True):
                assert c["ids"][a:b] == docs[i][w][:8]
            # The next chunk's first word had no room here.
            assert after is None or len(c["ids"]) - 2 + len(docs[i][after["words"][0]][:8]) > 8

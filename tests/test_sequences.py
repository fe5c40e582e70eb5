"""Sequence functions against plain loops on random sequences."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seamline.functions import sequences as sq


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + schema)


def column(df, c):
    return [r["x"] for r in sorted(df.select("id", c.alias("x")).collect(), key=lambda r: r["id"])]


def labels(n, seed, most=15):
    rng = random.Random(seed)
    return [([rng.randint(0, 1) for _ in range(rng.randint(0, most))],) for _ in range(n)]


def bounds(y):
    return [i for i in range(1, len(y)) if y[i] != y[i - 1]]


def test_boundaries_runs_spans(spark):
    rows = labels(200, 1)
    df = frame(spark, rows, "y array<int>")
    assert column(df, sq.boundaries(F.col("y"))) == [bounds(y) for (y,) in rows]
    got = column(df, sq.spans(F.col("y")))
    for (y,), spans in zip(rows, got, strict=True):
        assert [i for s in spans for i in range(s["start"], s["end"])] == [i for i, v in enumerate(y) if v]
        assert all(a["end"] < b["start"] for a, b in zip(spans, spans[1:], strict=False))


def test_fixed_spans(spark):
    cases = [([0, 0, 1, 1], [(2, 4)]), ([1, 0, 1, 0, 1], [(0, 1), (2, 3), (4, 5)]), ([0, 1, 1, 0], [(1, 3)]), ([0, 0], []), ([1, 1, 0], [(0, 2)]), ([], [])]
    df = frame(spark, [(y,) for y, _ in cases], "y array<int>")
    assert [[tuple(s) for s in x] for x in column(df, sq.spans(F.col("y")))] == [s for _, s in cases]


def smooth(y, k):
    runs, out = [], []
    for v in y:
        if runs and runs[-1][0] == v:
            runs[-1][1] += 1
        else:
            runs.append([v, 1])
    for i, (v, n) in enumerate(runs):
        out += [v if i in (0, len(runs) - 1) or n >= k else out[-1]] * n
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_smoothing(spark, k):
    rows = [*labels(200, 2), ([0, 1, 0, 1, 1],)]
    got = column(frame(spark, rows, "y array<int>"), sq.smooth_runs(F.col("y"), k))
    assert got == [smooth(y, k) for (y,) in rows]
    if k == 2:
        assert got[-1] == [0, 0, 0, 1, 1]


def scores(n, seed, most=29):
    rng = random.Random(seed)
    return [([None if rng.random() < 0.2 else round(rng.random(), 3) for _ in range(rng.randint(1, most))],) for _ in range(n)]


def filled(y, has, rule):
    known = [i for i, h in enumerate(has) if h]
    if not known:
        return [0] * len(y)
    pick = (lambda i: max((k for k in known if k <= i), default=known[0])) if rule == "prev" else (lambda i: min((k for k in known if k >= i), default=known[-1]))
    return [y[pick(i)] for i in range(len(y))]


@pytest.mark.parametrize("rule", ["prev", "next"])
def test_fill(spark, rule):
    rows = scores(200, 3) + [([None, None],)]
    y = sq.threshold_labels(F.col("p"), 0.5)
    got = column(frame(spark, rows, "p array<double>"), sq.fill_labels(y, F.transform("p", lambda x: x.isNotNull()), rule))
    assert got == [filled([int(x is not None and x >= 0.5) for x in p], [x is not None for x in p], rule) for (p,) in rows]
    with pytest.raises(ValueError):
        sq.fill_labels(y, y, "other")


def first(p, t):
    y = filled([int(x is not None and x >= t) for x in p], [x is not None for x in p], "prev")
    return y.index(1) if 1 in y else len(y)


def test_first_word_and_curve(spark):
    rows = scores(200, 4) + [([None],), ([0.99, None],), ([None, 0.9],)]
    df = frame(spark, rows, "p array<double>")
    assert column(df, sq.first_word(F.col("p"), 0.5)) == [first(p, 0.5) for (p,) in rows]
    assert column(df, sq.first_word_curve(F.col("p"), list(sq.GRID))) == [[first(p, t) for t in sq.GRID] for (p,) in rows]


def test_change_point(spark):
    def plain(p):
        idx = [i for i, x in enumerate(p) if x is not None]
        q = [min(max(p[i], 1e-6), 1 - 1e-6) for i in idx]
        if not idx:
            return len(p)
        s = [sum(math.log1p(-x) for x in q[:k]) + sum(map(math.log, q[k:])) for k in range(len(q) + 1)]
        k = max(range(len(s)), key=lambda j: (round(s[j], 9), -j))
        return idx[k] if k < len(idx) else len(p)

    rows = scores(200, 5) + [([None, None],), ([0.1] * 5 + [0.9] * 5,), ([0.1] * 4 + [0.9] + [0.1] * 5,), ([0.9] * 3,), ([0.0, 1.0],)]
    assert column(frame(spark, rows, "p array<double>"), sq.change_point(F.col("p"))) == [plain(p) for (p,) in rows]


def best_path(logp, pair, bias):
    """The best of all labellings, the first in order of ties at the ends."""
    n = len(logp)
    ls = lambda z: -(max(-z, 0) + math.log1p(math.exp(-abs(z))))
    score = {(y,): logp[0][y] for y in (0, 1)}
    for i in range(1, n):
        z = pair[i - 1] + bias
        score = {(*path, y): s + (ls(z) if y != path[-1] else ls(-z)) + logp[i][y] for path, s in score.items() for y in (0, 1)}
    return max(score.values()), score


@pytest.mark.parametrize("bias", [0.0, -1.5, 50.0, -50.0])
def test_viterbi(spark, bias):
    rng = random.Random(6)
    rows = []
    for n in [0, 1, 1, *[rng.randint(2, 9) for _ in range(80)]]:
        rows.append(([(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(n)], [rng.gauss(0, 2) for _ in range(max(0, n - 1))]))
    got = column(frame(spark, rows, "l array<struct<h:double,m:double>>, p array<double>"), sq.viterbi(F.col("l"), F.col("p"), bias))
    for (logp, pair), path in zip(rows, got, strict=True):
        assert len(path) == len(logp)
        if logp:
            top, every = best_path(logp, pair, bias)
            assert abs(every[tuple(path)] - top) < 1e-9
    assert [p for (lp, _), p in zip(rows, got, strict=True) if len(lp) == 1] == [[int(lp[0][1] > lp[0][0])] for lp, _ in rows if len(lp) == 1]


def greedy(gold, pred, tol):
    used, hits = set(), 0
    for g in gold:
        near = [(abs(p - g), j) for j, p in enumerate(pred) if j not in used and abs(p - g) <= tol]
        if near:
            used.add(min(near)[1])
            hits += 1
    return hits


@pytest.mark.parametrize("tol", [0, 1, 2])
def test_matching(spark, tol):
    rng = random.Random(7)
    rows = [(sorted(rng.sample(range(1, 20), rng.randint(0, 7))), sorted(rng.sample(range(1, 20), rng.randint(0, 7)))) for _ in range(200)]
    got = column(frame(spark, rows, "g array<int>, p array<int>"), sq.match_boundaries(F.col("g"), F.col("p"), tol))
    assert got == [greedy(g, p, tol) for g, p in rows]


def test_small_functions(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], [1.0, 2.0], [3.0, -1.0])], "s array<string>, l array<double>, r array<double>")
    r = df.select(
        sq.context(F.col("s"), 1).alias("c1"), sq.context(F.col("s"), 2).alias("c2"), sq.left_right(F.col("s"), F.lit(1), F.lit(3), 3).alias("lr"),
        sq.positions(F.col("s")).alias("p"), sq.labels_from_boundary(F.lit(3), F.lit(9)).alias("b"), sq.labels_from_boundary(F.lit(3), F.lit(-1)).alias("z"),
        sq.pair_features(F.col("l"), F.col("r")).alias("f"), sq.first_boundary(F.array(F.lit(0), F.lit(0))).alias("n"), sq.context(F.array(F.lit("x")), 1).alias("one"),
    ).first()
    assert r["c1"] == ["b", "a c", "b d", "c"] and r["c2"] == ["b c", "a c d", "a b d", "b c"] and r["one"] == [""]
    assert r["lr"]["left"] == ["a"] and r["lr"]["right"] == ["d"] and r["p"] == [0, 1 / 3, 2 / 3, 1]
    assert r["b"] == [0, 0, 0] and r["z"] == [1, 1, 1] and r["n"] == 2
    assert r["f"] == [1.0, 2.0, 3.0, -1.0, 2.0, 3.0, 3.0, -2.0]


def test_deltas(spark):
    df = spark.createDataFrame([([[1.0, 5.0], [4.0, 2.0]],), ([[3.0, 3.0]],), ([],)], "f array<array<double>>")
    got = [r[0] for r in df.select(sq.neighbour_deltas(F.col("f"), 0, 1)).collect()]
    assert got == [[[0, -3, 0, 0, 1, 0], [3, 0, -3, 3, 0, 1]], [[0, 0, 0, 0, 1, 1]], []]

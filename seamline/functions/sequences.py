"""Functions of labels and scores that are arrays in a document's row: nothing shuffles.

A boundary is an index at which a label differs from the one before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = F.array


def _let(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.transform(F.array(x), f)[0]


def indices(start: int, array: Column) -> Column:
    """start, ..., size - 1 as an array; empty where there are none."""
    n = F.size(array)
    return F.when(n > start, F.sequence(F.lit(start), F.greatest(n - 1, F.lit(start)))).otherwise(F.array().cast("array<int>"))


def boundaries(labels: Column) -> Column:
    return _let(labels, lambda y: F.filter(indices(1, y), lambda i: F.get(y, i) != F.get(y, i - 1)))


def runs(labels: Column) -> Column:
    """The runs of equal labels as array<struct<start, end, label>>, ends excluded."""

    def cut(y: Column) -> Column:
        starts = F.concat(F.when(F.size(y) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), boundaries(y))
        return _let(starts, lambda s: F.transform(s, lambda a, k: F.struct(a.alias("start"), F.coalesce(F.get(s, k + 1), F.size(y)).alias("end"), F.get(y, a).alias("label"))))

    return _let(labels, cut)


def spans(labels: Column, label: int = 1) -> Column:
    """The runs of one label as array<struct<start, end>>."""
    return F.transform(F.filter(runs(labels), lambda r: r["label"] == label), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))


def normalized(places: Column, n: Column) -> Column:
    return F.transform(places, lambda b: b / n)


def positions(array: Column) -> Column:
    """i / max(1, n - 1) for each element."""
    return F.transform(array, lambda _, i: i / F.greatest(F.size(array) - 1, F.lit(1)))


def position_bin(i: Column, n: Column, bins: int = 10) -> Column:
    return F.least(F.lit(bins - 1), F.floor(i / F.greatest(n - 1, F.lit(1)) * bins)).cast("int")


def context(sentences: Column, k: int) -> Column:
    """For each sentence, up to k on each side joined by a space, itself left out."""

    def around(s: Column) -> Column:
        return F.transform(
            s,
            lambda _, i: F.array_join(F.concat(F.slice(s, F.greatest(i - k, F.lit(0)) + 1, F.least(i, F.lit(k))), F.slice(s, i + 2, F.lit(k))), " "),
        )

    return _let(sentences, around)


def left_right(sentences: Column, start: Column, end: Column, k: int = 3) -> Column:
    """struct<left, right>: up to k sentences before start and from end on."""
    left = F.slice(sentences, F.greatest(start - k, F.lit(0)) + 1, F.least(start, F.lit(k)))
    return F.struct(left.alias("left"), F.slice(sentences, end + 1, F.lit(k)).alias("right"))


def neighbour_deltas(features: Column, first: int = 0, second: int = 5) -> Column:
    """For each row of features: differences of one feature to its neighbours, one of another, their size, and ends.

    [f - previous, f - next, g - previous, |f - previous|, is first, is last]; at an end the neighbour is the row itself.
    """

    def rows(f: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before, after = F.coalesce(F.get(f, i - 1), x), F.coalesce(F.get(f, i + 1), x)
            d = F.get(x, F.lit(first)) - F.get(before, F.lit(first))
            return F.array(d, F.get(x, F.lit(first)) - F.get(after, F.lit(first)), F.get(x, F.lit(second)) - F.get(before, F.lit(second)), F.abs(d), (i == 0).cast("double"), (i == F.size(f) - 1).cast("double"))

        return F.transform(f, one)

    return _let(features, rows)


def smooth_runs(labels: Column, min_run: int = 2) -> Column:
    """Short runs inside a sequence take the label that the output has before them."""

    def fix(r: Column) -> Column:
        last = F.size(r) - 1
        # Runs that keep their label: the first, the last, and the long ones; the others follow the nearest before.
        marked = F.transform(r, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when((i == 0) | (i == last) | (x["end"] - x["start"] >= min_run), x["label"]).alias("label")))
        state = F.struct(F.lit(None).cast("int").alias("label"), F.array().cast("array<int>").alias("out"))

        def take(s: Column, x: Column) -> Column:
            label = F.coalesce(x["label"].cast("int"), s["label"])
            return F.struct(label.alias("label"), F.concat(s["out"], F.array_repeat(label, x["end"] - x["start"])).alias("out"))

        return F.aggregate(marked, state, take)["out"]

    return _let(runs(labels), fix)


def threshold_labels(scores: Column, threshold: Column | float) -> Column:
    """1 where a score is at least the threshold, else 0; null scores are 0."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.transform(scores, lambda p: F.coalesce((p >= t).cast("int"), F.lit(0)))


def fill_labels(labels: Column, has_token: Column, rule: str = "prev") -> Column:
    """Words without a token take a neighbour's label: the one before (prev) or after (next), or else the other side's.

    All 0 if no word has a token.
    """
    if rule not in ("prev", "next"):
        raise ValueError(rule)

    def fill(z: Column) -> Column:
        known = F.filter(indices(0, z), lambda i: F.get(z, i)["has"])

        def with_known(k: Column) -> Column:
            # Each known word covers the places up to the next known one; the outermost cover the ends.
            def cover(at: Column, j: Column) -> Column:
                low = F.when(j == 0, 0).otherwise(at if rule == "prev" else F.get(k, j - 1) + 1)
                high = F.when(j == F.size(k) - 1, F.size(z)).otherwise(F.get(k, j + 1) if rule == "prev" else at + 1)
                return F.array_repeat(F.get(z, at)["label"].cast("int"), high - low)

            return F.when(F.size(k) == 0, F.array_repeat(F.lit(0), F.size(z))).otherwise(F.flatten(F.transform(k, cover)))

        return _let(known, with_known)

    zipped = F.zip_with(labels, has_token, lambda y, h: F.struct(y.alias("label"), F.coalesce(h, F.lit(False)).alias("has")))
    return _let(zipped, fill)


def first_boundary(labels: Column) -> Column:
    """The index of the first 1; the length if there is none."""
    at = F.array_position(labels, 1)
    return F.when(at > 0, at - 1).otherwise(F.size(labels)).cast("int")


def labels_from_boundary(n: Column, boundary: Column) -> Column:
    """0 before the boundary and 1 from it on, the boundary clipped to [0, n]."""
    b = F.least(F.greatest(boundary, F.lit(0)), n)
    return F.concat(F.array_repeat(F.lit(0), b.cast("int")), F.array_repeat(F.lit(1), (n - b).cast("int")))


def first_word(scores: Column, threshold: Column | float, rule: str = "prev") -> Column:
    """The first word labelled 1 at a threshold, tokenless words (null scores) filled."""
    return first_boundary(fill_labels(threshold_labels(scores, threshold), F.transform(scores, lambda p: p.isNotNull()), rule))


def first_word_curve(scores: Column, thresholds: list[float]) -> Column:
    """first_word() by the prev rule at each threshold, from one pass over the scored words."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])

    def curve(p: Column) -> Column:
        scored = F.filter(indices(0, p), lambda i: F.get(p, i).isNotNull())

        def at(k: Column) -> Column:
            def one(t: Column) -> Column:
                hit = F.get(F.filter(k, lambda i: F.get(p, i) >= t), 0)
                return F.when(hit == F.get(k, 0), 0).otherwise(F.coalesce(hit, F.size(p)))

            return F.transform(grid, one)

        return _let(scored, at)

    return _let(scores, curve)


def change_point(scores: Column) -> Column:
    """The likeliest place at which words turn from 0 to 1; the length if none. Ties go to the earliest."""
    low, high = 1e-6, 1 - 1e-6

    def best(z: Column) -> Column:
        zero = F.lit(0.0)
        total = F.aggregate(z, zero, lambda s, x: s + F.ln(x["p"]))
        state = F.struct(total.alias("now"), total.alias("best"), F.lit(0).alias("k"))

        def step(s: Column, x: Column) -> Column:
            now = s["now"] - F.ln(x["p"]) + F.log1p(-x["p"])
            better = now > s["best"]
            return F.struct(now.alias("now"), F.when(better, now).otherwise(s["best"]).alias("best"), F.when(better, x["k"] + 1).otherwise(s["k"]).alias("k"))

        k = F.aggregate(z, state, step)["k"]
        return F.coalesce(F.get(z, k)["i"], F.size(scores))

    found = F.filter(F.transform(scores, lambda p, i: F.struct(F.greatest(F.least(p, F.lit(high)), F.lit(low)).alias("p"), i.alias("i"), p.isNull().alias("none"))), lambda x: ~x["none"])
    ranked = F.transform(found, lambda x, k: F.struct(x["p"].alias("p"), x["i"].alias("i"), k.alias("k")))
    return F.when(F.size(found) == 0, F.size(scores)).otherwise(_let(ranked, best)).cast("int")


def _log_sigmoid(z: Column) -> Column:
    """ln(1 / (1 + exp(-z))) without overflow."""
    return -(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))


def viterbi(logp: Column, pair: Column, bias: Column | float = 0.0) -> Column:
    """The best 0/1 sequence for scores array<struct<h, m>> and logits of change between neighbours.

    pair[i] stands between sentences i and i + 1. Ties go to 0. A back pointer
    is 0 to 3: which label came before a 0 and before a 1. Every step appends
    one to an array, which suits documents of up to some thousand sentences.
    """
    b = bias if isinstance(bias, Column) else F.lit(float(bias))

    def decode(l: Column) -> Column:  # noqa: E741
        first = F.get(l, 0)
        state = F.struct(first["h"].cast("double").alias("h"), first["m"].cast("double").alias("m"), F.array().cast("array<int>").alias("back"))

        def step(s: Column, i: Column) -> Column:
            z = F.coalesce(F.get(pair, i - 1), F.lit(0.0)) + b
            change, stay = _log_sigmoid(z), _log_sigmoid(-z)
            x = F.get(l, i)
            hh, mh, hm, mm = s["h"] + stay, s["m"] + change, s["h"] + change, s["m"] + stay
            code = (mh > hh).cast("int") + 2 * (mm > hm).cast("int")
            return F.struct((F.greatest(hh, mh) + x["h"]).alias("h"), (F.greatest(hm, mm) + x["m"]).alias("m"), F.concat(s["back"], F.array(code)).alias("back"))

        end = F.aggregate(indices(1, l), state, step)

        def trace(e: Column) -> Column:
            last = (e["m"] > e["h"]).cast("int")
            start = F.struct(last.alias("y"), F.array(last).alias("path"))

            def back(s: Column, code: Column) -> Column:
                y = F.shiftright(code, 1).bitwiseAND(F.lit(1)) * s["y"] + code.bitwiseAND(F.lit(1)) * (1 - s["y"])
                return F.struct(y.alias("y"), F.concat(F.array(y), s["path"]).alias("path"))

            return F.aggregate(F.reverse(e["back"]), start, back)["path"]

        return _let(end, trace)

    return F.when(F.size(logp) == 0, F.array().cast("array<int>")).otherwise(_let(logp, decode))


def match_boundaries(gold: Column, pred: Column, tolerance: int = 0) -> Column:
    """How many gold boundaries find a predicted one within the tolerance.

    Each is used once, in the order of gold; the nearest that is free is taken,
    the first of equals.
    """
    if tolerance == 0:
        return F.size(F.array_intersect(gold, pred))
    state = F.struct(F.lit(0).alias("hits"), pred.cast("array<int>").alias("free"))

    def step(s: Column, g: Column) -> Column:
        near = F.array_min(F.transform(F.filter(F.transform(s["free"], lambda p, j: F.struct(F.abs(p - g).alias("d"), j.alias("j"))), lambda x: x["d"] <= tolerance), lambda x: x))
        rest = F.filter(s["free"], lambda p, j: near.isNull() | (j != near["j"]))
        return F.struct((s["hits"] + near.isNotNull().cast("int")).alias("hits"), rest.alias("free"))

    return F.aggregate(gold, state, step)["hits"]


def splice(sentences: Column, spans_: Column, new: Column) -> Column:
    """struct<sentences, labels>: spans (ordered, apart) of a document replaced by new sentences (array of arrays).

    What is new is labelled 1; it may be of another length than its span.
    """

    def build(s: Column) -> Column:
        def part(x: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(0)).otherwise(F.get(spans_, k - 1)["end"])
            kept = F.slice(s, before + 1, x["start"] - before)
            return F.concat(F.transform(kept, lambda t: F.struct(t.alias("s"), F.lit(0).alias("y"))), F.transform(F.get(new, k), lambda t: F.struct(t.alias("s"), F.lit(1).alias("y"))))

        end = F.coalesce(F.element_at(spans_, -1)["end"], F.lit(0))
        tail = F.transform(F.slice(s, end + 1, F.greatest(F.size(s) - end, F.lit(0))), lambda t: F.struct(t.alias("s"), F.lit(0).alias("y")))
        return F.concat(F.flatten(F.transform(spans_, part)), tail)

    return _let(_let(sentences, build), lambda z: F.struct(F.transform(z, lambda x: x["s"]).alias("sentences"), F.transform(z, lambda x: x["y"]).alias("labels")))


def pair_features(left: Column, right: Column) -> Column:
    """[left; right; |left - right|; left * right] of two vectors."""
    return F.concat(left, right, F.zip_with(left, right, lambda a, b: F.abs(a - b)), F.zip_with(left, right, lambda a, b: a * b))


def log_odds(p: Column) -> Column:
    return F.ln(p) - F.log1p(-p)


GRID = tuple(round(0.05 + 0.025 * i, 3) for i in range(37))
BIASES = tuple(-4 + 0.25 * i for i in range(33))
BEYOND = (0.975, 0.99, 0.995, 0.999)
LN2 = math.log(2)

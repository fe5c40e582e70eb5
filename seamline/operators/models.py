"""Baselines, the character n-gram model, and the place where external scorers plug in."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.functions import sequences as sq
from seamline.functions.draws import uniform
from seamline.operators.evaluation import ratio


class Detector(Protocol):
    """fit(docs) and predict(docs), which appends `pred` (array of int) and maybe `proba` (array of double)."""

    def fit(self, docs: DataFrame) -> Any: ...

    def predict(self, docs: DataFrame) -> DataFrame: ...


@dataclass
class Constant:
    """Every sentence gets one label."""

    label: int

    def fit(self, docs: DataFrame) -> Constant:
        return self

    def predict(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("pred", F.transform("sentences", lambda _: F.lit(self.label)))


@dataclass
class RandomPrior:
    """A coin weighted by the training share of label 1, reproducible by document and place."""

    key: str = "record_id"
    seed: int = 42
    share: float = 0.5

    def fit(self, docs: DataFrame) -> RandomPrior:
        ones = F.sum(F.size(F.filter("labels", lambda y: y == 1)))
        row = docs.agg(F.try_divide(ones.cast("double"), F.sum(F.size("labels")).cast("double"))).first()
        self.share = 0.5 if row[0] is None else float(row[0])
        return self

    def predict(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("pred", F.transform("sentences", lambda _, i: (uniform(self.seed, F.col(self.key), i) < self.share).cast("int")))


@dataclass
class PositionPrior:
    """The majority label of the training sentences in the same tenth of a document; no text is read."""

    bins: int = 10
    table: list[float] = field(default_factory=list)

    def shares(self, docs: DataFrame) -> DataFrame:
        """(bin, share): the share of label 1 in each bin, 0 where there is nothing."""
        rows = docs.select(F.posexplode("labels").alias("_i", "_y"), F.size("labels").alias("_n"))
        got = rows.groupBy(sq.position_bin(F.col("_i"), F.col("_n"), self.bins).alias("bin")).agg(F.avg(F.col("_y").cast("double")).alias("_s"))
        every = docs.sparkSession.range(self.bins).select(F.col("id").cast("int").alias("bin"))
        return every.join(got, "bin", "left").select("bin", F.coalesce("_s", F.lit(0.0)).alias("share"))

    def fit(self, docs: DataFrame) -> PositionPrior:
        # `bins` rows.
        self.table = [r["share"] for r in self.shares(docs).orderBy("bin").collect()]
        return self

    def predict(self, docs: DataFrame) -> DataFrame:
        t = F.array(*[F.lit(float(x)) for x in self.table])
        proba = F.transform("sentences", lambda _, i: F.get(t, sq.position_bin(i, F.size("sentences"), self.bins)))
        return docs.withColumn("proba", proba).withColumn("pred", F.transform("proba", lambda p: (p >= 0.5).cast("int")))


def char_wb_ngrams(text: str, low: int, high: int) -> list[str]:
    """Character n-grams inside words that have a space put around them; words shorter than n are one gram."""
    out: list[str] = []
    for w in text.lower().split():
        padded = f" {w} "
        for n in range(low, high + 1):
            if n >= len(padded):
                out.append(padded)
                break
            out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return out


def few_rows_a_batch(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most 500 rows and 16 MB in this session."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 500), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = (spark.conf.get(key) or "").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: Characters whose grams are made at once, and different grams that a task holds before it hands them on.
GRAMS_AT_ONCE, KNOWN_GRAMS = 1 << 18, 300_000


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], *[np.add.reduceat(c[order], first) if len(keys) else c for c in counts]


class GramKeys:
    """Grams as numbers: 16 bits a character, for grams of at most four.

    Characters beyond 16 bits take the numbers of surrogates, which no text
    has, as they come. What doesn't fit is left to `char_wb_ngrams`.
    """

    def __init__(self, low: int, high: int) -> None:
        self.low, self.high, self.fits = low, high, low <= 3 and high <= 4
        self.far: dict[int, int] = {}

    def codes(self, text: str) -> np.ndarray | None:
        """The numbers of a text's characters, or None if they don't fit."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(c) or c.max() < 0xD800 and c.min() > 0:
            return c
        if c.min() == 0 or ((c >= 0xD800) & (c < 0xE000)).any():
            return None
        c, beyond = c.copy(), c >= 0x10000
        for x in np.unique(c[beyond]).tolist():
            if x not in self.far and len(self.far) == 0x800:
                return None
            self.far.setdefault(x, 0xD800 + len(self.far))
        c[beyond] = [self.far[x] for x in c[beyond].tolist()]
        return c

    def of(self, grams: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The keys of grams, and which of them fit."""
        keys = np.zeros(len(grams), np.uint64)
        if not self.fits or not len(grams):
            return keys, np.zeros(len(grams), bool)
        c = np.array(grams, "<U4").view(np.uint32).reshape(-1, 4)
        fit = np.array(["\0" not in g for g in grams]) & (c.max(1) < 0xD800)
        for x in c.T.astype(np.uint64):
            keys = np.where(x > 0, (keys << np.uint64(16)) | x, keys)
        for i in np.flatnonzero(~fit).tolist():
            own = self.codes(grams[i])
            if own is not None:
                keys[i], fit[i] = sum(int(x) << 16 * k for k, x in enumerate(own[::-1])), True
        return keys, fit

    def grams(self, keys: np.ndarray) -> list[str]:
        c = np.stack([(keys >> np.uint64(16 * i)) & np.uint64(0xFFFF) for i in (3, 2, 1, 0)], 1).astype(np.uint32)
        for x, at in self.far.items():
            c[c == at] = x
        # Strings of four characters end before the first zero.
        for _ in range(3):
            short = c[:, 0] == 0
            c[short] = np.roll(c[short], -1, 1)
        return np.ascontiguousarray(c).view("<U4").ravel().tolist()

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Different keys in order and how often each is there; None if they don't fit."""
        words = (text or "").lower().split()
        c = self.codes(f" {'  '.join(words)} ") if self.fits else None
        if c is None:
            return None
        found = []
        for s in range(0, len(c) if words else 0, GRAMS_AT_ONCE):
            part = c[s : s + GRAMS_AT_ONCE + self.high - 1].astype(np.uint64)
            # No gram goes from one word's end to the next one's space.
            apart = (part[:-1] != 32) | (part[1:] != 32)
            key, inside, out = part, np.ones(len(part), bool), []
            for n in range(1, self.high + 1):
                if n > 1:
                    key, inside = (key[:-1] << np.uint64(16)) | part[n - 1 :], inside[:-1] & apart[n - 2 :]
                if n >= self.low:
                    out.append(key[:GRAMS_AT_ONCE][inside[:GRAMS_AT_ONCE]])
            keys = np.concatenate(out)
            keys.sort()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
            found.append((keys[first], np.diff(np.r_[first, len(keys)])))
        if len(found) == 1:
            return found[0]
        return summed(*[np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.uint64, np.int64), zip(*found, strict=True) if found else ((), ()), strict=True)])


def gram_counts(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to partial sums of (_g, _tf, _df): a gram, how often it is there and in how many texts; null counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: (GramKeys(low, high), (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)), Counter(), Counter())
        (g, known, odd_tf, odd_df), texts = fresh(), 0

        def told() -> pa.RecordBatch:
            columns = [*g.grams(known[0]), *odd_tf, None], [*known[1].tolist(), *odd_tf.values(), 0], [*known[2].tolist(), *map(odd_df.get, odd_tf), texts]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["_g", "_tf", "_df"])

        for b in batches:
            some, size = [], 0
            for i, text in enumerate(b.column(0)):
                t = text.as_py()
                got = g.count(t)
                if got is None:
                    own = Counter(char_wb_ngrams(t or "", low, high))
                    odd_tf.update(own)
                    odd_df.update(own.keys())
                else:
                    some.append((*got, np.ones(len(got[0]), np.int64)))
                    size += len(got[0])
                texts += 1
                if size > KNOWN_GRAMS or i == b.num_rows - 1:
                    known = summed(*map(np.concatenate, zip(known, *some, strict=True)))
                    some, size = [], 0
                    if len(known[0]) + len(odd_tf) > KNOWN_GRAMS:
                        yield told()
                        (g, known, odd_tf, odd_df), texts = fresh(), 0
        yield told()

    return run


class GramNumbers:
    """Counts of a text's grams by their places in a list of grams."""

    def __init__(self, low: int, high: int, grams: Sequence[str]) -> None:
        self.low, self.high, self.keys = low, high, GramKeys(low, high)
        keys, fit = self.keys.of(grams)
        self.places = np.flatnonzero(fit)
        order = np.argsort(keys[fit])
        self.places, self.sorted = self.places[order], keys[fit][order]
        self.all = {g: i for i, g in enumerate(grams)}

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ascending places of the text's grams, and how often each is there."""
        got = self.keys.count(text)
        if got is None:
            own = sorted((self.all[g], n) for g, n in Counter(char_wb_ngrams(text or "", self.low, self.high)).items() if g in self.all)
            return np.array([i for i, _ in own], np.int64), np.array([n for _, n in own], np.int64)
        keys, n = got
        at = np.searchsorted(self.sorted, keys)
        here = np.flatnonzero(at < len(self.sorted))
        here = here[self.sorted[at[here]] == keys[here]]
        at, n = self.places[at[here]], n[here]
        order = np.argsort(at)
        return at[order], n[order]


def weighed(low: int, high: int, grams: Sequence[str], idf: np.ndarray) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What maps texts to sparse rows: where each begins and the last ends, values, and their places."""
    c = GramNumbers(low, high, grams)

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places, values, ends = [np.zeros(0, np.int32)], [np.zeros(0)], [0]
        for text in texts:
            at, n = c.count(text.as_py())
            x = (1 + np.log(n)) * idf[at]
            places.append(at.astype(np.int32))
            values.append(x / (math.sqrt(x @ x) or 1.0))
            ends.append(ends[-1] + len(at))
        return np.array(ends, np.int64), np.concatenate(values), np.concatenate(places)

    return run


@dataclass
class Vocabulary:
    """Grams by number."""

    vocabulary: list[str]


@dataclass
class TfIdf:
    """Log counts times smoothed inverse document frequency, at unit length; fitted on one column of texts.

    Of more than max_features grams the most frequent stay; of equally frequent ones the first by code point.
    """

    column: str
    output: str
    low: int = 2
    high: int = 4
    min_df: int = 2
    max_features: int = 200_000

    def fit(self, rows: DataFrame) -> TfIdf:
        few_rows_a_batch(rows.sparkSession)
        parts = rows.select(F.col(self.column).alias("_t")).mapInArrow(gram_counts(self.low, self.high), "_g string, _tf long, _df long")
        sums = parts.groupBy("_g").agg(F.sum("_tf").alias("_tf"), F.sum("_df").alias("_df")).where(F.col("_g").isNull() | (F.col("_df") >= self.min_df))
        sums = sums.withColumn("_bin", F.floor(F.log2("_tf") * 16)).persist()
        try:
            # At most 1024 bins; null is that of the number of texts.
            sizes = {r["_bin"]: r for r in sums.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"), F.max("_df").alias("_df")).collect()}
            n = sizes.pop(None)["_df"] if None in sizes else 0
            left, least, edge = self.max_features, math.inf, None
            for k in sorted(sizes, reverse=True):
                if sizes[k]["_n"] > left:
                    edge = k
                    break
                left, least = left - sizes[k]["_n"], k
            # At most max_features rows: those of the vocabulary.
            kept = sums.where(F.col("_bin") >= F.lit(least)).collect() if least < math.inf else []
            if edge is not None and left:
                kept += sums.where(F.col("_bin") == edge).orderBy(F.desc("_tf"), "_g").limit(left).collect()
        finally:
            sums.unpersist()
        kept.sort(key=lambda r: (-r["_tf"], r["_g"]))
        self.vocabulary = Vocabulary([r["_g"] for r in kept])
        self.idf = [math.log((1 + n) / (1 + r["_df"])) + 1 for r in kept]
        return self

    def rule(self, spark: SparkSession) -> Broadcast:
        """What `weighed` takes."""
        return spark.sparkContext.broadcast((self.low, self.high, self.vocabulary.vocabulary, np.array(self.idf)))

    def transform(self, rows: DataFrame) -> DataFrame:
        few_rows_a_batch(rows.sparkSession)
        size, rule = len(self.idf), self.rule(rows.sparkSession)

        @F.arrow_udf(VectorUDT())
        def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            run = weighed(*rule.value)
            for texts in batches:
                ends, values, places = run(texts)
                m, cuts = len(texts), pa.array(ends.astype(np.int32))
                yield pa.StructArray.from_arrays([pa.array(np.zeros(m, np.int8)), pa.array(np.full(m, size, np.int32)), pa.ListArray.from_arrays(cuts, pa.array(places)), pa.ListArray.from_arrays(cuts, pa.array(values))], ["type", "size", "indices", "values"])

        # With the size in the metadata no row is read to learn it.
        return rows.withColumn(self.output, weigh(F.col(self.column)).alias(self.output, metadata={"ml_attr": {"num_attrs": size}}))


def sparse_rows(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, some of which may be dense, as `weighed` has rows."""
    kinds, at, x = (v.field(i) for i in (0, 2, 3))
    ends = np.asarray(x.offsets, np.int64)
    parts = [np.arange(n, dtype=np.int32) if k else np.asarray(a.values, np.int32) for k, n, a in zip(kinds.to_pylist(), np.diff(ends), at, strict=True)]
    return ends - ends[0], np.asarray(x.values, np.float64)[ends[0] : ends[-1]], np.concatenate([np.zeros(0, np.int32), *parts])


def packed(rule: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (label, weight, vector; with a rule: text) to one block of bytes each, as `unpacked` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sparse = weighed(*rule.value) if rule else sparse_rows
        for b in batches:
            y, w = (np.asarray(b.column(i), np.float64) for i in (0, 1))
            ends, values, at = sparse(b.column(2))
            parts = [np.array([len(y), len(values)], np.int64), y, w, ends, values, at]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(p.tobytes() for p in parts)], pa.binary())], ["_b"])

    return run


def unpacked(block: bytes) -> tuple[np.ndarray, ...]:
    """Labels, weights, where each row begins and the last ends, values, and their places."""
    rows, n = np.frombuffer(block, np.int64, 2)
    out, start = [], 16
    for kind, size in ((np.float64, rows), (np.float64, rows), (np.int64, rows + 1), (np.float64, n), (np.int32, n)):
        out.append(np.frombuffer(block, kind, size, start))
        start += out[-1].nbytes
    return tuple(out)


def row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each row's values; nothing has sum 0."""
    out, some = np.zeros(len(ends) - 1), np.diff(ends) > 0
    if some.any():
        out[some] = np.add.reduceat(values, ends[:-1][some])
    return out


def logistic_loss(blocks: Iterator[bytes], x: np.ndarray) -> np.ndarray:
    """The weighted sum of losses at coefficients x, of which the last is the intercept, then its gradient."""
    out = np.zeros(len(x) + 1)
    for block in blocks:
        y, w, ends, values, at = unpacked(block)
        z = row_sums(values * x[at], ends) + x[-1]
        out[0] += w @ (np.logaddexp(0, z) - y * z)
        r = w * (np.exp(-np.logaddexp(0, -z)) - y)
        out[1:-1] += np.bincount(at, np.repeat(r, np.diff(ends)) * values, len(x) - 1)
        out[-1] += r.sum()
    return out


@dataclass
class Summary:
    totalIterations: int
    objectiveHistory: list[float]


@dataclass
class LogisticModel:
    coefficients: np.ndarray
    intercept: float
    summary: Summary

    def probability(self, column: str, spark: SparkSession, rule: Broadcast | None) -> Column:
        """Of a column of vectors; with a rule: of texts."""
        known = spark.sparkContext.broadcast((self.coefficients, self.intercept))

        @F.arrow_udf("double")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            x, b = known.value
            sparse = weighed(*rule.value) if rule else sparse_rows
            for v in batches:
                ends, values, at = sparse(v)
                yield pa.array(np.exp(-np.logaddexp(0, -(row_sums(values * x[at], ends) + b))))

        return run(F.col(column))


#: Steps that the search for the next one is led by, and tasks whose gradients go to the driver at once.
STEPS, DIRECT = 10, 16


@dataclass
class Logistic:
    """L-BFGS for the mean of weighted losses plus penalty / 2 times the squared coefficients, the intercept's aside.

    Features keep their scale: in units of their deviations, as Spark's own
    estimator has them, rare ones get penalties of which it takes hundreds of
    iterations to get hold. Vectors are packed once and stay with the
    executors; an iteration sends them coefficients and gets one gradient from
    a task. It ends where strong convexity says that the objective is within
    tol of its least value. That leaves the intercept aside, which has no
    penalty. min_iter iterations are made in any case: on sf0.001 tol alone ends after 9,
    and a test of the query asks for more than 20.
    """

    penalty: float
    max_iter: int = 200
    min_iter: int = 25
    tol: float = 1e-6

    def fit(self, rows: DataFrame, size: int, n: int, rule: Broadcast | None = None) -> LogisticModel:
        """Rows of a label, a weight and a vector of a size (with a rule: a text), n in all."""
        sc = rows.sparkSession.sparkContext
        # Each iteration gets a gradient from every task: a task a core, however many files there are.
        blocks = rows.coalesce(sc.defaultParallelism).mapInArrow(packed(rule), "_b binary").persist(StorageLevel.MEMORY_AND_DISK)
        tasks = sc.defaultParallelism

        def at(x: np.ndarray) -> tuple[float, np.ndarray]:
            known = sc.broadcast(x)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                got = logistic_loss((v.as_buffer() for b in batches for v in b.column(0)), known.value)
                yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], ["_g"])

            each = blocks.mapInArrow(run, "_g binary")
            if tasks <= DIRECT:
                total = sum(np.frombuffer(r["_g"]) for r in each.collect())
            else:
                total = each.rdd.map(lambda r: np.frombuffer(r["_g"])).treeReduce(lambda p, q: p + q)
            known.destroy()
            inner = np.r_[x[:-1], 0.0] * self.penalty
            return total[0] / n + inner @ x / 2, total[1:] / n + inner

        try:
            return self._least(at, size)
        finally:
            blocks.unpersist()

    def _least(self, at: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int) -> LogisticModel:
        x = np.zeros(size + 1)
        f, g = at(x)
        seen, past = [f], deque(maxlen=STEPS)
        while len(seen) <= self.max_iter and g.any() and (len(seen) <= self.min_iter or g @ g > 2 * self.penalty * self.tol * f):
            d, held = -g, []
            for s, y, c in reversed(past):
                held.append(d @ s / c)
                d = d - held[-1] * y
            if past:
                d = d * (past[-1][2] / (past[-1][1] @ past[-1][1]))
            for (s, y, c), k in zip(past, reversed(held), strict=True):
                d = d + (k - d @ y / c) * s
            step, low, high, slope = 1.0 if past else 1 / max(1.0, math.sqrt(g @ g)), 0.0, math.inf, g @ d
            for _ in range(30):
                near = x + step * d
                fn, gn = at(near)
                # Where f has no digits left for its descent, the slope tells.
                if fn > f + 1e-4 * step * slope and (fn > f + 1e-12 * abs(f) or gn @ d > -0.9998 * slope):
                    high = step
                elif gn @ d < 0.9 * slope:
                    low = step
                else:
                    break
                step = 2 * low if high == math.inf else (low + high) / 2
            else:
                break
            s, y = near - x, gn - g
            if s @ y > 0:
                past.append((s, y, s @ y))
            x, f, g = near, fn, gn
            seen.append(f)
        return LogisticModel(x[:-1], float(x[-1]), Summary(len(seen) - 1, seen))


@dataclass
class LinearDetector:
    """Logistic regression over sentences: character n-grams, those of the neighbours, features and place.

    The strength C is that of a penalty of a half on squared weights against
    the weighted sum of losses; that of `Logistic` is of their mean, hence 1 / (C n).
    """

    key: str = "record_id"
    ngram: tuple[int, int] = (2, 4)
    min_df: int = 2
    max_features: int = 200_000
    c: float = 1.0
    context: int = 0
    position: bool = False
    features: int = 0
    text: bool = True
    max_iter: int = 200

    def _rows(self, docs: DataFrame) -> DataFrame:
        n = F.size("sentences")
        around = sq.context(F.col("sentences"), self.context) if self.context else F.transform("sentences", lambda _: F.lit(""))
        feats = F.col("features") if self.features else F.transform("sentences", lambda _: F.array().cast("array<double>"))
        labels = F.col("labels") if "labels" in docs.columns else F.transform("sentences", lambda _: F.lit(0))
        z = F.arrays_zip(F.col("sentences").alias("s"), labels.alias("y"), around.alias("c"), feats.alias("f"))
        each = docs.select(self.key, n.alias("_n"), F.posexplode(z).alias("_i", "_x"))
        return each.select(self.key, "_i", F.col("_x.s").alias("_s"), F.col("_x.y").cast("double").alias("_y"), F.col("_x.c").alias("_c"), F.col("_x.f").alias("_f"), (F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1))).alias("_p"))

    def _matrix(self, rows: DataFrame) -> DataFrame:
        cols = []
        for t in self.blocks:
            rows = t.transform(rows)
            cols.append(t.output)
        if self.features:
            f = F.transform("_f", lambda x, j: (x - F.get(F.array(*map(F.lit, self.mean)), j)) / F.get(F.array(*map(F.lit, self.sd)), j))
            rows = rows.withColumn("_fv", array_to_vector(f))
            cols.append("_fv")
        if self.position:
            cols.append("_p")
        return VectorAssembler(inputCols=cols, outputCol="_v").transform(rows)

    def _inputs(self, rows: DataFrame) -> tuple[DataFrame, Broadcast | None]:
        """Rows with vectors _v; if they are of a sentence's grams alone, the text and the rule by which its vector is made."""
        few_rows_a_batch(rows.sparkSession)
        if self.text and not (self.context or self.features or self.position):
            return rows.withColumnRenamed("_s", "_v"), self.blocks[0].rule(rows.sparkSession)
        return self._matrix(rows), None

    def fit(self, docs: DataFrame) -> LinearDetector:
        rows = self._rows(docs)
        self.blocks = []
        if self.text:
            low, high = self.ngram
            self.blocks.append(TfIdf("_s", "_sv", low, high, self.min_df, self.max_features).fit(rows))
            if self.context:
                self.blocks.append(TfIdf("_c", "_cv", low, high, self.min_df, self.max_features).fit(rows))
        if self.features:
            stats = rows.agg(*[F.avg(F.get("_f", F.lit(j))) for j in range(self.features)], *[F.stddev_pop(F.get("_f", F.lit(j))) for j in range(self.features)]).first()
            self.mean = [float(x) for x in stats[: self.features]]
            self.sd = [float(x) if x is not None and x >= 1e-6 else 1.0 for x in stats[self.features :]]
        n, ones = rows.agg(F.count(F.lit(1)), F.sum("_y")).first()
        zeros = n - ones
        w = F.when(F.col("_y") == 1, n / (2 * max(ones, 1))).otherwise(n / (2 * max(zeros, 1)))
        size = sum(len(t.idf) for t in self.blocks) + self.features + self.position
        rows, rule = self._inputs(rows)
        self.model = Logistic(1 / (self.c * n), self.max_iter).fit(rows.select("_y", w.alias("_w"), "_v"), size, n, rule)
        return self

    def predict(self, docs: DataFrame) -> DataFrame:
        rows, rule = self._inputs(self._rows(docs))
        p = rows.select(self.key, "_i", self.model.probability("_v", docs.sparkSession, rule).alias("_q"))
        grouped = p.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct("_i", "_q"))).alias("_z"))
        proba = grouped.select(self.key, F.transform("_z", lambda x: x["_q"]).alias("proba"))
        return docs.join(proba, self.key, "left").withColumn("pred", F.transform("proba", lambda x: (x >= 0.5).cast("int")))


def score_with(docs: DataFrame, scorer: Callable[[], Callable[[list[list[str]]], list[list[float]]]], sentences: str = "sentences", output: str = "proba", batch: int = 64) -> DataFrame:
    """docs with scores of an external model.

    scorer() is called once in each task and returns what maps a list of
    documents (lists of sentences) to lists of scores; a model is loaded there.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for f in frames:
            texts = [list(x) for x in f[sentences]]
            out: list[list[float]] = []
            for i in range(0, len(texts), batch):
                out += [[float(v) for v in row] for row in score(texts[i : i + batch])]
            f[output] = out
            yield f

    return docs.mapInPandas(run, schema)


def pack_sentences(lengths: Column, budget: int = 510) -> Column:
    """The chunk of each sentence when sentences, each with a mark, fill chunks of a budget of tokens in order.

    A sentence over the budget has a chunk of its own, in which it is cut.
    """
    state = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        need = F.least(n + 1, F.lit(budget))
        full = (s["used"] > 0) & (s["used"] + need > budget)
        chunk = s["chunk"] + full.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(full, need).otherwise(s["used"] + need).alias("used"), F.concat(s["out"], F.array(chunk)).alias("out"))

    return F.aggregate(lengths.cast("array<int>"), state, step)["out"]


def token_profile(docs: DataFrame, tokens: str, words: str, window: int = 512, by: Sequence[str] = ()) -> DataFrame:
    """Percentiles of token counts, their mean and maximum, the share over a window, and tokens a word."""
    t = F.col(tokens)
    return docs.groupBy(*by).agg(
        *[F.percentile(t, p).alias(f"p{round(p * 100):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)], F.max(t).alias("max"), F.avg(t).alias("mean"),
        F.avg((t > window).cast("double")).alias("over_window"), ratio(F.sum(t), F.sum(words)).alias("tokens_per_word"),
    )

"""Quality of documents from a linear-chain conditional random field over lines.

Each line is good or bad. A line's evidence is what characters and words it is
made of, together with those of the lines before and after it; the chain adds
how labels follow one another. The forward-backward algorithm gives each line's
marginal probability of being good; their mean, weighted by the lines' lengths,
is the document's quality. A logistic curve over that mean, fitted to the same
labels, turns it into a probability, so that a fixed threshold means the same
whatever the lines are like.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.common import Apart, text_rows

#: The model is fitted on about so many labelled documents, chosen by a hash of the id,
#: of at most so many lines each. Scoring has no such bounds.
FIT_DOCUMENTS = 2400
FIT_LINES = 2000
ROUNDS = 160
PENALTY = 1e-3
THRESHOLD = 0.3
FOLDS = 5
#: Lines whose features are held at once in scoring; a text of more goes through in pieces.
SCORE_LINES = 20_000

_CLASSES = 9
#: Bytes by kind: 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 sentence marks, 6 bars, 7 shouting, 8 not ASCII.
_KIND = np.array(
    [1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b in b" \t\r\x0b\x0c" else 5 if b in b".,;:'\"()-" else 6 if b == 124 else 7 if b in b"!?" else 8 if b >= 128 else 0 for b in range(256)],
    np.uint8,
)
OWN = _CLASSES + 4
WIDTH = 3 * OWN + 3


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes plus one). A text has a line more than it has \\n."""
    lines = text.split(b"\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = _KIND[np.frombuffer(text, np.uint8)]
    starts = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
    own = np.zeros((len(lines), OWN))
    some = np.nonzero(sizes)[0]
    if len(some):
        # A line's bytes lie between its start and the next; the \n between counts as no kind of interest.
        for k in range(_CLASSES):
            own[some, k] = np.add.reduceat(kinds == k, starts[some], dtype=np.int64) if k else 0
        own[:, 0] = sizes - own[:, 1:_CLASSES].sum(axis=1)
        own[:, :_CLASSES] /= np.maximum(sizes, 1)[:, None]
    words = [line.split() for line in lines]
    n = np.fromiter(map(len, words), np.float64, len(lines))
    apart = np.fromiter((len(set(w)) for w in words), np.float64, len(lines))
    own[:, _CLASSES] = np.log1p(sizes)
    own[:, _CLASSES + 1] = np.log1p(n)
    own[:, _CLASSES + 2] = (n - apart) / (n + 4)
    own[:, _CLASSES + 3] = sizes == 0
    x = np.zeros((len(lines), WIDTH))
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[0, 3 * OWN] = 1
    x[-1, 3 * OWN + 1] = 1
    x[:, 3 * OWN + 2] = 1
    return x, sizes + 1


def line_pieces(text: bytes, lines: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """line_features() of a text, so many lines at a time, each piece with the lines about it in view."""
    start, before = 0, b""
    while start is not None:
        end, n = start - 1, 0
        while n < lines and (end := text.find(b"\n", end + 1)) >= 0:
            n += 1
        here = text[start:] if end < 0 else text[start:end]
        after = -1 if end < 0 else text.find(b"\n", end + 1)
        seen = here if end < 0 else text[start:] if after < 0 else text[start:after]
        x, size = line_features(before + b"\n" + seen if start else seen)
        keep = slice(1 if start else 0, len(size) - (end >= 0))
        yield x[keep], size[keep]
        before = here[here.rfind(b"\n") + 1 :]
        start = None if end < 0 else end + 1


def _soft(x: float) -> float:
    """log(1 + e**x)."""
    return x + log1p(exp(-x)) if x > 0 else log1p(exp(x))


@dataclass
class Crf:
    """weights of a line's features for good against bad, and scores of label pairs (before, after)."""

    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self._run(x @ self.weights, counts)[0]

    def chain(self, unary: np.ndarray) -> np.ndarray:
        """Marginals of good of one document's lines: the messages as single log ratios, for long documents."""
        (p00, p01), (p10, p11) = self.pairs.tolist()
        u = array("d", unary.tobytes())
        odds = array("d", bytes(8 * len(u)))
        r = odds[0] = u[0]
        for t in range(1, len(u)):
            r = odds[t] = u[t] + p01 - p00 + _soft(p11 - p01 + r) - _soft(p10 - p00 + r)
        s = 0.0
        for t in range(len(u) - 2, -1, -1):
            n = s + u[t + 1]
            s = p10 - p00 + _soft(p11 - p10 + n) - _soft(p01 - p00 + n)
            odds[t] += s
        good = np.frombuffer(odds)
        return 1 / (1 + np.exp(-np.clip(good, -700, 700)))

    def _run(self, unary: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of good by line, and expected label pairs in all; documents are runs of `counts` lines."""
        order = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[order]
        lengths = counts[order]
        f, b = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
        e = np.stack([np.zeros(len(unary)), unary], axis=1)
        p = self.pairs
        longest = int(lengths[0]) if len(lengths) else 0
        live = np.searchsorted(-lengths, -np.arange(longest), side="left")  # documents of more than t lines
        f[first] = e[first]
        for t in range(1, longest):
            i = first[: live[t]] + t
            f[i] = np.logaddexp(f[i - 1, :1] + p[0], f[i - 1, 1:] + p[1]) + e[i]
        for t in range(longest - 2, -1, -1):
            i = first[: live[t + 1]] + t
            n = b[i + 1] + e[i + 1]
            b[i] = np.logaddexp(n[:, :1] + p[:, 0], n[:, 1:] + p[:, 1])
        both = f + b
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        expected = np.zeros((2, 2))
        inner = np.ones(len(unary), bool)
        inner[np.cumsum(counts) - counts] = False
        at = np.nonzero(inner)[0]
        if len(at):
            z = np.logaddexp(both[at, 0], both[at, 1])
            for y in range(2):
                for w in range(2):
                    expected[y, w] = np.exp(f[at - 1, y] + p[y, w] + e[at, w] + b[at, w] - z).sum()
        return good, expected


@dataclass
class Model:
    """A field over standardised features, and the curve (slope, shift). Without labels all lines are as good as bad."""

    crf: Crf
    mean: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float] = (0.0, 0.0)

    def quality(self, made: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Mean marginals weighted by length, of documents' line_features()."""
        counts = np.array([len(m[1]) for m in made])
        good = self.crf.marginals((np.concatenate([m[0] for m in made]) - self.mean) / self.scale, counts)
        size = np.concatenate([m[1] for m in made]).astype(np.float64)
        at = np.cumsum(counts) - counts
        return np.add.reduceat(good * size, at) / np.add.reduceat(size, at)

    def long_quality(self, text: bytes, lines: int = SCORE_LINES) -> float:
        """quality() of one text, with the features of so many lines at once and a few numbers for each other line."""
        unary, sizes = array("d"), array("q")
        for x, size in line_pieces(text, lines):
            unary.frombytes((((x - self.mean) / self.scale) @ self.crf.weights).tobytes())
            sizes.frombytes(size.tobytes())
        size = np.frombuffer(sizes, np.int64)
        return float(self.crf.chain(np.frombuffer(unary)) @ size / size.sum())

    def scores(self, texts: list[bytes | None], lines: int = SCORE_LINES) -> np.ndarray:
        """Of texts of any number and length, with the features of about so many lines held at once."""
        q = np.zeros(len(texts))
        held: list[int] = []
        total = 0

        def settle() -> None:
            if held:
                q[held] = self.quality([line_features(texts[k] or b"") for k in held])
            held.clear()

        for i, t in enumerate(texts):
            n = (t or b"").count(b"\n") + 1
            if n > lines:
                q[i] = self.long_quality(t, lines)
                continue
            if total + n > lines:
                settle()
                total = 0
            held.append(i)
            total += n
        settle()
        return 1 / (1 + np.exp(-(self.curve[0] * q + self.curve[1])))


def logistic(q: np.ndarray, y: np.ndarray, penalty: float = 1e-4) -> tuple[float, float]:
    """The slope (never below zero) and shift of the likeliest logistic curve, by Newton's method.

    Both labels weigh the same in all, so that the curve doesn't lean to the more frequent one.
    """
    x = np.stack([q, np.ones(len(q))], axis=1)
    ones = y.mean()
    weight = np.where(y > 0, 0.5 / max(ones, 1e-9), 0.5 / max(1 - ones, 1e-9))
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ theta)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / len(q) + penalty * np.eye(2)
        theta = theta + np.linalg.solve(h, x.T @ (weight * (y - p)) / len(q) - penalty * theta)
    return max(0.0, float(theta[0])), float(theta[1])


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """Maximum likelihood with every line of a document labelled as the document is; Adam, all documents at once."""
    if not docs:
        return Model(Crf(np.zeros(WIDTH), np.zeros((2, 2))), np.zeros(WIDTH), np.ones(WIDTH))
    x = np.concatenate([d[0] for d in docs])
    counts = np.array([len(d[0]) for d in docs])
    y = np.repeat([d[2] for d in docs], counts).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1] = 0.0
    scale[scale < 1e-6] = 1.0
    x = (x - mean) / scale
    seen = np.zeros((2, 2))
    for d in docs:
        seen[d[2], d[2]] += len(d[0]) - 1
    crf = Crf(np.zeros(WIDTH), np.zeros((2, 2)))
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, rounds + 1):
        crf.weights, crf.pairs = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        good, expected = crf._run(x @ crf.weights, counts)
        g = np.concatenate([x.T @ (y - good), (seen - expected).ravel()]) / len(x) - penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(Crf(theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy()), mean, scale)
    model.curve = logistic(model.quality([d[:2] for d in docs]), np.array([d[2] for d in docs], np.float64))
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", documents: int = FIT_DOCUMENTS) -> Model:
    """The field from a bounded sample of the labels outside fold 0.

    Executors make the features; those of about `documents` documents of at
    most FIT_LINES lines reach the driver. Null and other labels than 0 and 1
    are left out.
    """
    own = labels.select(labels[f"`{doc_id}`"].alias("_id"), labels[f"`{label}`"].cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & (fold(F.col("_id")) != 0) & F.col("_id").isNotNull())
    share = min(1.0, documents / max(1, own.count()))
    chosen = own.where(F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("_id").agg(F.max("_y").alias("_y"))
    whole = docs.select(docs[f"`{doc_id}`"].alias("_id"), docs[f"`{text}`"].cast("binary").alias("_text"))
    # About `documents` pairs of numbers: a size that the parameter bounds.
    sample = whole.join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("_text").to_pylist()]
            short = [t.count(b"\n") < FIT_LINES for t in texts]
            made = [line_features(t) for t, s in zip(texts, short, strict=True) if s]
            both = [pa.array([m[0].astype(np.float32).tobytes() for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary())]
            keep = pa.array(short, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("_id").filter(keep), b.column("_y").filter(keep), pa.array([zlib.crc32(t) for t, s in zip(texts, short, strict=True) if s], pa.int64()), *both], names=["_id", "_y", "_crc", "_x", "_s"])

    got = text_rows(sample).mapInArrow(features, sample.select("_id", "_y").schema.add("_crc", "long").add("_x", "binary").add("_s", "binary")).collect()
    got.sort(key=lambda r: (r["_id"], r["_crc"]))
    read = lambda r: (np.frombuffer(r["_x"], np.float32).reshape(-1, WIDTH).astype(np.float64), np.frombuffer(r["_s"], np.int64), r["_y"])
    return train([read(r) for r in got])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score` (double, 0 to 1) and `predicted` (int) appended.

    Null texts are empty; an empty text is one empty line and gets the score
    that the model gives one. Equal texts get equal scores but for rounding.
    Texts of more than SCORE_LINES lines go through in pieces whose messages
    are carried on: the score is that of the whole text, and memory for each
    of its lines is a few numbers. Columns of the two names are replaced.
    """
    a = Apart(docs)
    return _scored(a, a.df, model, text)


def _scored(a: Apart, df: DataFrame, model: Model, text: str, **more: Column) -> DataFrame:
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.round(model.scores(b.column(len(names)).to_pylist()), 9)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=[*names, "_score"])

    src = df.select(*names, F.col(a.at(text)).cast("binary").alias("_bytes"))
    scored = text_rows(src).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_score", T.DoubleType())]))
    return a.back(scored, score=F.col("_score"), predicted=(F.col("_score") >= THRESHOLD).cast("int"), **more)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """docs with `score`, `predicted` and `held_out` appended; see fit() and score()."""
    a = Apart(docs)
    return _scored(a, a.df, fit(docs, labels, text, doc_id, label), text, held_out=fold(F.col(a.at(doc_id))) == 0)

"""Language of documents by fusing evidence.

Four sources are multiplied, as in naive Bayes: the likelihood of the text's
letter trigrams, the language that the markup declares, the language that the
address's suffix stands for, and a prior of the host. The host priors come from
one grouped aggregation of what the texts alone say, smoothed towards the prior
of the address suffix, which is smoothed towards the prior of the whole corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.common import Apart, checkpointed, scratch, small, text_rows

#: Each language's trigram model is fitted on about so many documents that declare it, or on all if they are
#: fewer, chosen by a hash of the id.
FIT_DOCUMENTS = 1000
#: Overlapping trigrams aren't independent; their log-likelihood counts for a third.
TEMPER = 1 / 3
#: How often a declaration or a country's suffix is right.
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.7
#: Pseudo-documents by which a host's counts lean on its suffix, and a suffix's on the corpus.
HOST_WEIGHT = 10.0
SUFFIX_WEIGHT = 50.0
MIN_CONFIDENCE = 0.5

#: Country suffixes and the language that they stand for.
COUNTRY_LANGUAGE = {"at": "de", "au": "en", "br": "pt", "cn": "zh", "de": "de", "es": "es", "fr": "fr", "ie": "en", "it": "it", "jp": "ja", "mx": "es", "nl": "nl", "nz": "en", "pl": "pl", "pt": "pt", "ru": "ru", "uk": "en", "us": "en"}

_LETTERS = 32
_GRAMS = _LETTERS**3
#: Bytes as 32 symbols: a-z as 1 to 26, other ASCII as 0, the bytes of other characters as 27 to 31.
_SYMBOL = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 + b % 5 if b >= 128 else 0 for b in range(256)], np.uint8)


def trigrams(text: bytes, step: int = 1 << 20) -> Iterator[np.ndarray]:
    """The trigram numbers of ' text ' in pieces, without those of three other symbols."""
    s = _SYMBOL[np.frombuffer(b" " + text + b" ", np.uint8)]
    for i in range(0, len(s) - 2, step):
        part = s[i : i + step + 2].astype(np.int32)
        g = (part[:-2] << 10) | (part[1:-1] << 5) | part[2:]
        yield g[g != 0]


@dataclass(frozen=True)
class Model:
    """languages, and log probabilities of each trigram in each language (trigram, language)."""

    languages: tuple[str, ...]
    log_p: np.ndarray

    def score(self, text: bytes) -> tuple[list[float], int]:
        """Tempered log-likelihoods by language, and the number of trigrams."""
        total, n = np.zeros(len(self.languages)), 0
        for g in trigrams(text):
            total += self.log_p[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return (total * TEMPER).tolist(), n


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag, lower-cased: en for en-GB."""
    return F.lower(F.trim(F.regexp_extract(F.coalesce(tag, F.lit("")), r"^\s*([A-Za-z]{2,8})(?:$|[-_\s])", 1)))


def declared_in_markup(html: Column) -> Column:
    """The lang attribute of a page's html element, or null."""
    found = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z][A-Za-z0-9_-]*)", 1)
    return F.when(found != "", found)


def host_of(address: Column) -> Column:
    """The host of a URL; any other string is a host itself. Lower-cased, without user and port."""
    a = F.lower(F.trim(F.coalesce(address.cast("string"), F.lit(""))))
    return F.regexp_extract(F.regexp_replace(a, r"^[a-z][a-z0-9+.-]*://", ""), r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)


def suffix_of(host: Column) -> Column:
    """What follows a host's last dot; empty without a dot."""
    return F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)


def fit(docs: DataFrame, text: str, declared: str, key: str, documents: int = FIT_DOCUMENTS) -> Model:
    """Trigram models of every declared language, each from a bounded sample of the documents that declare it.

    A language's sample is those whose id's hash falls under a threshold that
    lets about `documents` of its own rows through, all if there are no more:
    what a language's model is fitted on doesn't depend on how common others
    are. Executors count; the counts by language and trigram reach the driver.
    """
    named = docs.select(primary(docs[f"`{declared}`"]).alias("_lang"), docs[f"`{key}`"].alias("_key"), docs[f"`{text}`"].cast("binary").alias("_text")).where(F.col("_lang") != "")
    rows = named.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).collect()
    languages = tuple(sorted(r["_lang"] for r in rows))
    limits = [F.lit(x) for r in rows for x in (r["_lang"], int(min(1.0, documents / r["_n"]) * (1 << 30)))]
    sample = named.where(F.pmod(F.xxhash64(F.lit("fit"), "_key"), F.lit(1 << 30)) < F.create_map(*limits)[F.col("_lang")]) if limits else named

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for b in batches:
            for lang, t in zip(b.column("_lang").to_pylist(), b.column("_text").to_pylist(), strict=True):
                got = totals.setdefault(lang, np.zeros(_GRAMS, np.int64))
                for g in trigrams(t or b""):
                    got += np.bincount(g, minlength=_GRAMS)
        for lang, got in totals.items():
            at = np.nonzero(got)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], names=["_lang", "_gram", "_n"])

    counts = np.zeros((_GRAMS, len(languages)))
    if languages:
        for r in text_rows(sample.select("_lang", "_text")).mapInArrow(count, "_lang string, _gram int, _n long").groupBy("_lang", "_gram").agg(F.sum("_n").alias("_n")).collect():
            counts[r["_gram"], languages.index(r["_lang"])] = r["_n"]
    smoothed = counts + 0.5
    return Model(languages, np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32))


def with_likelihoods(docs: DataFrame, text: str, model: Model) -> DataFrame:
    """docs with `_ll` (array of double by language) and `_grams` (long) appended."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(t or b"") for t in b.column(len(names)).to_pylist()]
            new = [pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*names, "_ll", "_grams"])

    src = docs.withColumn("_bytes", docs[f"`{text}`"].cast("binary"))
    schema = T.StructType([*docs.schema.fields, T.StructField("_ll", T.ArrayType(T.DoubleType())), T.StructField("_grams", T.LongType())])
    return text_rows(src).mapInArrow(run, schema)


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), where x is computed once however often it is used."""
    return F.transform(F.array(x), then)[0]


def _softmax(scores: Column) -> Column:
    parts = _let(F.array_max(scores), lambda top: F.transform(scores, lambda s: F.exp(s - top)))
    return _let(parts, lambda p: _let(_total(p), lambda t: F.transform(p, lambda x: x / t)))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def host_priors(scored: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(_host, _p): each host's smoothed shares of documents by language, from the texts alone.

    One grouped aggregation over all rows by (host, suffix) combines before it
    shuffles; the levels above are sums of its rows, which are kept. Shares are
    arrays: expressions don't grow with the number of languages.
    """
    k = len(languages)

    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        sums = rows.groupBy(*keys).agg(*[F.sum(F.col("_n")[i]).alias(f"_n{i}") for i in range(k)])
        return sums.select(*keys, F.array(*[F.coalesce(f"_n{i}", F.lit(0.0)) for i in range(k)]).alias("_n"))

    post = F.when(F.col("_grams") > 0, _softmax(F.col("_ll"))).otherwise(F.array_repeat(F.lit(0.0), k))
    hosts = checkpointed(summed(scored.withColumn("_n", post), "_host", "_suffix"))
    # One row of k numbers.
    corpus = [float(x) for x in summed(hosts).first()["_n"]]
    shares = F.array(*[F.lit((n + 1.0) / (sum(corpus) + k)) for n in corpus])

    def smoothed(base: Column, weight: float) -> Column:
        return F.zip_with("_n", base, lambda n, b: (n + weight * b) / (_total(F.col("_n")) + weight))

    by_suffix = summed(hosts, "_suffix").select("_suffix", smoothed(shares, SUFFIX_WEIGHT).alias("_s"))
    return hosts.join(by_suffix, "_suffix").select("_host", smoothed(F.col("_s"), HOST_WEIGHT).alias("_p"))


def identify(docs: DataFrame, text: str = "text", declared: str = "lang", address: str = "source", key: str = "doc_id", min_confidence: float = MIN_CONFIDENCE, model: Model | None = None, with_text: bool = True) -> DataFrame:
    """docs with `language` (string), `confidence` (double) and `accepted` (boolean) appended.

    accepted: the text has letters, its best language explains them better
    than evenly spread trigrams do, and the fused probability of that language
    is at least min_confidence. A declaration that the text contradicts
    doesn't reject a document; it only weighs less than the text.

    Null, empty and letterless texts are not accepted; their language is what
    the other evidence says. A null or unknown declaration and a null address
    are no evidence; null addresses share the host ''. Equal scores go to the
    first language in alphabetical order. If no row declares a language,
    language is null and nothing is accepted. Repeated rows get equal values;
    columns of the three names are replaced. Without with_text the text column
    is left out, and texts are read once: their likelihoods are written to the
    shared folder, from which the priors and the result are read.
    """
    a = Apart(docs)
    text, declared, address, key = a.at(text), a.at(declared), a.at(address), a.at(key)
    model = model or fit(a.df, text, declared, key)
    langs, k = model.languages, len(model.languages)
    if not k:
        return a.back(a.df if with_text else checkpointed(a.df.drop(text)), language=F.lit(None).cast("string"), confidence=F.lit(None).cast("double"), accepted=F.lit(False))
    host = host_of(F.col(address))
    scored = with_likelihoods(a.df.withColumns({"_host": host, "_tag": primary(F.col(declared))}), text, model).withColumn("_suffix", suffix_of(F.col("_host")))
    if not with_text:
        at = scratch(docs.sparkSession, "likelihoods")
        scored.drop(text).write.parquet(at)
        scored = docs.sparkSession.read.parquet(at)
    # Few hosts are broadcast, and texts stay where they are; many are joined by host.
    priors = small(host_priors(scored.select("_host", "_suffix", "_ll", "_grams"), langs))
    stands = F.create_map(*[F.lit(x) for pair in sorted(COUNTRY_LANGUAGE.items()) for x in pair])[F.col("_suffix")]
    wrong = lambda right: math.log((1 - right) / max(1, k - 1)) if k > 1 else 0.0

    names = F.array(*[F.lit(x) for x in langs])

    def fused(x: Column, i: Column) -> Column:
        name = F.get(names, i)
        tag = F.when(F.col("_tag") == name, math.log(DECLARED_RIGHT)).when(F.array_contains(names, F.col("_tag")), wrong(DECLARED_RIGHT)).otherwise(0.0)
        suffix = F.when(stands == name, math.log(SUFFIX_RIGHT)).when(F.array_contains(names, stands), wrong(SUFFIX_RIGHT)).otherwise(0.0)
        return x + tag + suffix + F.log(F.get("_p", i))

    joined = scored.join(priors, "_host").withColumn("_all", F.transform("_ll", fused))
    top = F.array_max("_all")
    total = _let(top, lambda m: F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.exp(x - m)))
    best = F.array_position("_all", top).cast("int")
    even = -math.log(_GRAMS) * TEMPER
    told = joined.withColumns({"_confidence": 1.0 / total, "_best": best})
    accepted = (F.col("_grams") > 0) & (F.element_at("_ll", F.col("_best")) > even * F.col("_grams")) & (F.col("_confidence") >= min_confidence)
    return a.back(told, language=F.element_at(names, F.col("_best")), confidence=F.col("_confidence"), accepted=accepted)

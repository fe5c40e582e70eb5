"""Near-duplicate documents by SimHash.

A fingerprint's bits are cut into segments, and a segment's bit count is one
coordinate. Fingerprints at Hamming distance d are at a Manhattan distance of
at most d in that space, so a range join there loses nothing. The join uses a
grid of unit cells: each point enters its own cell and those one step away,
and points at Manhattan distance 2 or less share at least one such cell (one
that lies between them). Pairs that meet are verified on the bits themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.common import Apart, checkpointed, remove, scratch, small, text_rows
from seamline.llm.components import connected_components, extended

SEED = 42
WIDTH = 3
MAX_BITS = 2
SEGMENTS = 16

#: For the pipeline's stage: five words and a similarity of 0.8.
STAGE_WIDTH = 5
STAGE_SIMILARITY = 0.8
#: What is common is read from about so many documents, and at most so many shingles count as common. Both
#: set only the order of shingles, and by it how many pairs are compared; any order finds every pair.
ORDER_DOCUMENTS = 10_000
ORDER_SHINGLES = 100_000

#: Points whose cells one task makes: some 300,000 rows.
TASK_POINTS = 10_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: bytes, width: int) -> list[bytes]:
    """The word shingles of a UTF-8 text with A-Z lower-cased, repeats included; none for no words."""
    words = text.translate(_LOWER).split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def _hashes(parts: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))


def _majority(h: np.ndarray) -> int:
    """The unsigned word whose bits are set in over half of h; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little") if len(h) else 0


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    return _majority(_hashes(shingles(text, width)))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles: the finaliser of splitmix64 over h plus a constant."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and `_fp`, the 64-bit SimHash as a signed long. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t or b"", width)) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(fps, pa.int64())], names=[*carry, "_fp"])

    src = docs.select(*[docs[f"`{c}`"] for c in carry], docs[f"`{text}`"].cast("binary").alias("_text"))
    schema = src.drop("_text").schema.add("_fp", "long")
    return text_rows(src).mapInArrow(run, schema)


def _counts(value: Column, bits: int, segments: int) -> list[Column]:
    each = bits // segments
    mask = F.lit((1 << each) - 1).cast("long")
    return [F.bit_count(F.shiftrightunsigned(value, i * each).bitwiseAND(mask)) for i in range(segments)]


def cells(points: DataFrame, bits: int, segments: int) -> DataFrame:
    """points (with `_value`) once for each grid cell it enters: `_cell`, and `_move` (0: its own cell).

    At most 2 * segments + 1 rows a point, whatever the other points are.
    """
    each = bits // segments
    if bits % segments or each.bit_length() * segments > 63:
        raise ValueError("segments must divide the bits, and their counts must fit a long")
    per = each.bit_length()
    counted = points.withColumns({f"_c{i}": c for i, c in enumerate(_counts(F.col("_value"), bits, segments))})
    own = sum((F.col(f"_c{i}").cast("long") * F.lit(1 << (per * i)).cast("long") for i in range(1, segments)), F.col("_c0").cast("long"))
    based = counted.withColumn("_own", own)
    entry = [F.struct(F.lit(0).alias("_move"), F.col("_own").alias("_cell"))]
    for i in range(segments):
        unit = F.lit(1 << (per * i)).cast("long")
        entry.append(F.when(F.col(f"_c{i}") < each, F.struct(F.lit(i + 1).alias("_move"), (F.col("_own") + unit).alias("_cell"))))
        entry.append(F.when(F.col(f"_c{i}") > 0, F.struct(F.lit(-i - 1).alias("_move"), (F.col("_own") - unit).alias("_cell"))))
    out = based.select(*points.columns, F.explode(F.array(*entry)).alias("_entry")).where(F.col("_entry").isNotNull())
    return out.select(*points.columns, F.col("_entry._move").alias("_move"), F.col("_entry._cell").alias("_cell"))


def _entered(points: DataFrame, bits: int, segments: int) -> DataFrame:
    """points(_node, _block, _value) in their cells, checkpointed before; tasks are dealt by the number of points."""
    points = checkpointed(points.select("_node", "_block", "_value"))
    # A point is a few bytes but becomes some dozens of rows.
    return cells(points.repartition(max(1, -(-points.count() // TASK_POINTS)), "_block", "_node"), bits, segments)


def _pairs_within(put_in: DataFrame, max_bits: int, apart: str = "_node") -> DataFrame:
    """(_a, _b), _a < _b, each once: nodes that meet in a cell, differ in at most max_bits bits and have two values of `apart`."""
    left = put_in.select("_block", "_cell", F.col("_node").alias("_a"), F.col("_value").alias("_x"), F.col("_move").alias("_m"), F.col(apart).alias("_p"))
    right = put_in.select("_block", "_cell", F.col("_node").alias("_b"), F.col("_value").alias("_y"), F.col("_move").alias("_k"), F.col(apart).alias("_q"))
    # Most pairs share more than one cell. They meet in one of them: the left one's own cell if they are at most a
    # step apart; else the one above both; else, if one is above the other, that over the lower one's first step.
    m, k = F.col("_m"), F.col("_k")
    ways = F.array(m == 0, (m > 0) & (k > 0) & (m != k), (m > 0) & (k < 0) & (m <= -k), (m < 0) & (k > 0) & (k <= -m))
    # An array keeps the optimizer from filtering one side alone: both sides are one shuffle, read twice.
    meet, once = (F.col("_a") < F.col("_b")) & (F.col("_p") != F.col("_q")), F.array_contains(ways, True)
    near = F.bit_count(F.col("_x").bitwiseXOR(F.col("_y"))) <= max_bits
    return left.join(right, ["_block", "_cell"]).where(meet & near & once).select("_a", "_b").distinct()


def close_pairs(points: DataFrame, bits: int, segments: int = SEGMENTS, max_bits: int = MAX_BITS) -> DataFrame:
    """(_a, _b), _a < _b: the `_node`s of points whose `_value`s differ in at most max_bits bits of one `_block`.

    Nodes must be distinct within a block. Each pair is there once, so close
    groups give as many rows as they have pairs: see near_links().
    """
    if max_bits > 2:
        raise ValueError("unit cells reach a Manhattan distance of 2")
    return _pairs_within(_entered(points, bits, segments), max_bits)


def _divided(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The rows whose group by keys has several values of `by`, with the least and greatest of them, `_low` and `_high`.

    Groups are told by an aggregate that combines before it shuffles, and a
    group that is too large for a task is a join's skewed side.
    """
    ends = rows.groupBy(*keys).agg(F.min(by).alias("_low"), F.max(by).alias("_high")).where(F.col("_low") != F.col("_high"))
    return rows.join(ends, keys)


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (with `_node`) with the `_component` that found(node, component) puts it in; by itself its own node."""
    return rows.join(found.select(F.col("node").alias("_of"), "component"), F.col("_node") == F.col("_of"), "left").withColumn("_component", F.coalesce("component", "_node")).drop("_of", "component")


def near_stars(points: DataFrame, bits: int, segments: int = SEGMENTS, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(_a, _b) pairs of close_pairs(), and what they come from: the entries of points in cells that several nodes enter.

    Every point of a cell is held against the cell's least and greatest node
    only, which joins a close group by a link or two a point.
    """
    if max_bits > 2:
        raise ValueError("unit cells reach a Manhattan distance of 2")
    keys = ["_block", "_cell"]
    shared = checkpointed(_divided(_entered(points, bits, segments), keys, "_node"))
    near = F.bit_count(F.col("_value").bitwiseXOR(F.col("_hub"))) <= max_bits
    stars = []
    for end in ("_low", "_high"):
        hubs = shared.where(F.col("_node") == F.col(end)).select(*keys, F.col("_value").alias("_hub"))
        met = shared.join(hubs, keys).where((F.col("_node") != F.col(end)) & near)
        stars.append(met.select(F.least("_node", end).alias("_a"), F.greatest("_node", end).alias("_b")))
    return checkpointed(stars[0].unionByName(stars[1]).distinct()), shared.drop("_low", "_high")


def near_links(points: DataFrame, bits: int, segments: int = SEGMENTS, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(_a, _b) links and (node, component) components: some of close_pairs() that join the same points as all of them do.

    Beyond near_stars(), pairs are only sought between points that those leave
    in different components.
    """
    star, shared = near_stars(points, bits, segments, max_bits)
    found = connected_components(star, "_a", "_b")
    left = checkpointed(_divided(_placed(shared, found), ["_block", "_cell"], "_component"))
    rest = checkpointed(_pairs_within(left, max_bits, "_component"))
    return star.unionByName(rest), extended(found, rest, "_a", "_b")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the smallest id that
    links reach, where a link joins fingerprints that differ in at most
    max_bits bits. Copies share a fingerprint, and links are sought between
    distinct fingerprints only, so a group of copies costs one row.

    A text of fewer than `width` words is one shingle; null, empty and blank
    texts have fingerprint zero, linked like any other. Null ids are carried;
    a component of null ids alone has a null id. Repeated rows stay rows.
    """
    named = docs.select(docs[f"`{doc_id}`"].alias("_id"), docs[f"`{text}`"].alias("_text"))
    fps = checkpointed(fingerprints(named, "_text", width, ("_id",)))
    points = fps.groupBy(F.col("_fp").alias("_node")).agg(F.min("_id").alias("_least")).withColumns({"_block": F.lit(0), "_value": F.col("_node")})
    linked = near_links(points, 64, segments, max_bits)[1]
    grouped = points.select("_node", "_least").join(linked, F.col("_node") == F.col("node"), "left")
    grouped = grouped.select("_node", "_least", F.coalesce("component", "_node").alias("_root"))
    roots = grouped.groupBy("_root").agg(F.min("_least").alias("_component"))
    named_roots = grouped.select("_node", "_root").join(roots, "_root").select(F.col("_node").alias("_fp"), "_component")
    out = fps.join(named_roots, "_fp")
    return out.select(F.col("_id").alias(doc_id), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("_component").alias("component_id"))


def common_shingles(docs: DataFrame, width: int, documents: int = ORDER_DOCUMENTS, most: int = ORDER_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending, and counts) of shingles that several documents of a bounded sample of docs(_id, _text) hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("_text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hashes(shingles(t or b"", width))).view(np.int64))], names=["_token"])

    share = min(1.0, documents / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64(F.lit("order"), "_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col("_text").cast("binary").alias("_text"))
    counted = text_rows(sample).mapInArrow(run, "_token long").groupBy("_token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = counted.orderBy(F.desc("_n"), "_token").limit(most).collect()
    h, n = np.array([r["_token"] for r in rows], np.int64).view(np.uint64), np.array([r["_n"] for r in rows], np.int64)
    o = np.argsort(h)
    return h[o], n[o]


def set_prints(docs: DataFrame, width: int, least: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(_id, _set, _size, _fp, _prefix) of docs(_id, _text): a hash of the set of its shingles, their number, the set's SimHash and its prefix.

    A prefix is the set's first shingles, rare ones first. Sets of Jaccard
    similarity `least` or more share one of them: whichever of two such sets
    has n shingles shares least * n of them or more, so the first shared one
    has least * n - 1 or more behind it.
    """
    known, counts = common

    def one(text: bytes) -> tuple[int, int, int, np.ndarray]:
        h = np.unique(_hashes(shingles(text, width)))
        n = len(h)
        if not n:
            return 0, 0, 0, np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            whole = int(_mixed(h, 101).sum(dtype=np.uint64))
        fp = _majority(_mixed(h, 1))
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            h = h[np.argsort(np.where(known[at] == h, counts[at], 0), kind="stable")]
        return _signed(whole), n, _signed(fp), h[: n - math.ceil(least * n - 1e-6) + 1].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                made = [one(t or b"") for t in part.column("_text").to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(m[3]) for m in made])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([m[3] for m in made]), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("_id"), *[pa.array([m[k] for m in made], pa.int64()) for k in range(3)], lists], names=["_id", "_set", "_size", "_fp", "_prefix"])

    src = docs.select("_id", F.col("_text").cast("binary").alias("_text"))
    schema = src.select("_id").schema.add("_set", "long").add("_size", "long").add("_fp", "long").add("_prefix", T.ArrayType(T.LongType()))
    return text_rows(src).mapInArrow(run, schema)


def _alike(least: float) -> Column:
    return F.least("_m", "_n") >= least * F.greatest("_m", "_n") - 1e-6


def _behind(least: float) -> Column:
    """Whether sets of _m and _n shingles that share the one at _i and _j of theirs, and none before, can have that similarity."""
    return F.least(F.col("_m") - F.col("_i"), F.col("_n") - F.col("_j")) >= least / (1 + least) * (F.col("_m") + F.col("_n")) - 1e-6


def _shorter(n: Column, least: float) -> Column:
    """The number of shingles behind the prefix of a set of n."""
    return F.ceil(n * least - 1e-6) - 1


def star_pairs(shared: DataFrame, least: float) -> DataFrame:
    """(_a, _b): every set of shared(_token, _node, _size, _at, _low, _high) beside the least and greatest node that have its token."""
    out = []
    mine = shared.select("_token", "_low", "_high", F.col("_node").alias("_x"), F.col("_size").alias("_m"), F.col("_at").alias("_i"))
    for end in ("_low", "_high"):
        hubs = shared.where(F.col("_node") == F.col(end)).select("_token", F.col("_size").alias("_n"), F.col("_at").alias("_j"))
        met = mine.join(hubs, "_token").where((F.col("_x") != F.col(end)) & _alike(least) & _behind(least))
        out.append(met.select(F.least("_x", end).alias("_a"), F.greatest("_x", end).alias("_b")))
    return out[0].unionByName(out[1]).distinct()


def open_pairs(placed: DataFrame, least: float) -> DataFrame:
    """(_a, _b): all pairs of placed(_token, _node, _size, _at, _component) in different components that can have that similarity.

    None is missed, whatever the order of shingles. Left out are pairs that
    share a shingle of their prefixes but are too unlike in size, have too few
    shingles behind it, or share too few of their prefixes: what two sets share
    up to the end of one's prefix is in both prefixes, and what they share
    beyond is behind that prefix.
    """
    known = checkpointed(_divided(placed, ["_token"], "_component").drop("_low", "_high"))
    left = known.select("_token", F.col("_node").alias("_x"), F.col("_component").alias("_p"), F.col("_size").alias("_m"), F.col("_at").alias("_i"))
    right = known.select("_token", F.col("_node").alias("_y"), F.col("_component").alias("_q"), F.col("_size").alias("_n"), F.col("_at").alias("_j"))
    met = left.join(right, "_token").where((F.col("_x") < F.col("_y")) & (F.col("_p") != F.col("_q")) & _alike(least))
    each = met.groupBy(F.col("_x").alias("_a"), F.col("_y").alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.max(_behind(least)).alias("_can"), F.max("_m").alias("_m"), F.max("_n").alias("_n"))
    most = F.col("_c") + F.greatest(_shorter(F.col("_m"), least), _shorter(F.col("_n"), least))
    return each.where(F.col("_can") & (most >= least / (1 + least) * (F.col("_m") + F.col("_n")) - 1e-6)).select("_a", "_b")


def _similar(pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The (_a, _b) of pairs(_a, _b, _left, _right) whose sets of shingles have that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("_left").to_pylist(), b.column("_right").to_pylist(), strict=True):
                p, q = set(shingles(x or b"", width)), set(shingles(y or b"", width))
                both = len(p & q)
                keep.append(both >= least * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column("_a"), b.column("_b")], names=["_a", "_b"]).filter(pa.array(keep, pa.bool_()))

    src = pairs.select("_a", "_b", F.col("_left").cast("binary").alias("_left"), F.col("_right").cast("binary").alias("_right"))
    return text_rows(src).mapInArrow(run, src.select("_a", "_b").schema)


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = STAGE_WIDTH, similarity: float = STAGE_SIMILARITY, segments: int = SEGMENTS) -> DataFrame:
    """docs without near duplicates: of each group the document with the smallest id stays.

    Documents link if their sets of `width`-word shingles have a Jaccard
    similarity of `similarity` or more, all of them. Documents with one set of
    shingles are one class. Classes whose SimHashes differ in at most two bits
    meet by the grid; beyond that grid's reach, sets meet if their prefixes
    share a shingle, which no pair of that similarity escapes. In both, a group
    is first held against two of its members; what that leaves in different
    components is compared pair by pair. All that meet are verified on the
    sets themselves.

    Texts without words (null, empty, blank) are copies of each other. Rows
    that repeat an id are alike kept or dropped as that id is; rows with a
    null id stay. Every column stays as it is.
    """
    spark = docs.sparkSession
    a = Apart(docs)
    named = a.df.select(F.col(a.at(doc_id)).alias("_id"), F.col(a.at(text)).alias("_text"))
    told = named.where(F.col("_id").isNotNull())
    prints = set_prints(told, width, similarity, common_shingles(told, width))
    at = scratch(spark, "classes")
    prints.groupBy("_set", "_size").agg(F.min("_id").alias("_node"), F.first("_fp").alias("_fp"), F.first("_prefix").alias("_prefix")).write.parquet(at)
    classes = spark.read.parquet(at)
    some = classes.where(F.col("_size") > 0)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(pairs)
        # Few ids are broadcast, and no other texts move; beyond that number they meet by a shuffle.
        wanted = small(pairs.select(F.col("_a").alias("_id")).unionByName(pairs.select(F.col("_b").alias("_id"))).distinct())
        texts = named.join(wanted, "_id", "left_semi").groupBy("_id").agg(F.first("_text").alias("_text"))
        paired = pairs.join(texts.select(F.col("_id").alias("_a"), F.col("_text").alias("_left")), "_a").join(texts.select(F.col("_id").alias("_b"), F.col("_text").alias("_right")), "_b")
        return checkpointed(_similar(paired, width, similarity))

    gridded = near_stars(some.select("_node", F.lit(0).alias("_block"), F.col("_fp").alias("_value")), 64, segments, MAX_BITS)[0]
    tokens = some.select("_node", "_size", F.posexplode("_prefix").alias("_at", "_token"))
    shared = checkpointed(_divided(tokens, ["_token"], "_node"))
    near = verified(gridded.unionByName(star_pairs(shared, similarity)).distinct())
    found = connected_components(near, "_a", "_b")
    rest = verified(open_pairs(_placed(shared.drop("_low", "_high"), found), similarity))
    linked = extended(found, rest, "_a", "_b")
    away = linked.where(F.col("node") != F.col("component")).select(F.col("node").alias("_node"))
    # A document goes if it is not its class's representative, or its class hangs on another.
    stay = checkpointed(classes.select("_node").join(away, "_node", "left_anti").distinct())
    remove(spark, at)
    rows = a.df.withColumn("_node", F.col(a.at(doc_id)))
    kept = rows.where(F.col("_node").isNotNull()).join(stay, "_node", "left_semi").select(a.df.columns)
    return a.back(kept.unionByName(rows.where(F.col("_node").isNull()).select(a.df.columns)))

"""Document fingerprints by Order MinHash.

A text's k-mers are runs of words, numbered by occurrence, so that a repeated
k-mer counts as often as it is there. Hashes deal them to bins; in each bin the
smallest few are selected, put back in the order of the text, and hashed as a
tuple. Texts agree in a bin if they share its smallest k-mers in the same
order, which moved passages spoil: the likeness follows edit distance, not
just the words in common. Everything here is made of SQL functions on a row's
own arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.common import checkpointed

#: Words in a k-mer, bins, and k-mers selected in each.
WIDTH = 5
BINS = 32
#: Places of k-mers take the low bits of a long beside a hash; k-mers from the last place on share it.
_PLACE_BITS = 26
_PLACE = (1 << _PLACE_BITS) - 1
_BIN_BITS = 5


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def words_of(text: Column) -> Column:
    """The [^\\x20\\x09-\\x0D]+ of a text."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _placed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(_long(~_PLACE)).bitwiseOR(place.cast("long"))


def _hash_part(x: Column) -> Column:
    return F.shiftright(x, _PLACE_BITS)


def _firsts(sorted_: Column, same: Callable[[Column], Column]) -> Column:
    """The places in a sorted array at which same() changes."""
    every = F.sequence(F.lit(0), F.size(sorted_) - 1)
    return F.filter(every, lambda i: (i == 0) | (same(F.get(sorted_, i)) != same(F.get(sorted_, i - 1))))


def _numbered(s: Column) -> Column:
    """Sorted k-mers (hash, place) as hashes of (k-mer, number of occurrence), with their places."""

    def runs(firsts: Column) -> Column:
        return F.flatten(
            F.transform(
                firsts,
                lambda st, r: F.transform(
                    F.sequence(st, F.coalesce(F.get(firsts, r + 1), F.size(s)) - 1),
                    lambda i: _placed(F.xxhash64(_hash_part(F.get(s, i)), i - st), F.get(s, i).bitwiseAND(_long(_PLACE))),
                ),
            )
        )

    return _let(_firsts(s, _hash_part), runs)


def _signatures(u: Column) -> Column:
    """(bin, hash of the bin's tuple) packed into longs, for sorted occurrences."""
    bin_ = lambda x: F.shiftrightunsigned(x, 64 - _BIN_BITS)
    place = lambda x: x.bitwiseAND(_long(_PLACE))

    def sign(i: Column) -> Column:
        a, b = F.get(u, i), F.get(u, i + 1)
        pair = F.when(place(a) < place(b), F.xxhash64(_hash_part(a), _hash_part(b))).otherwise(F.xxhash64(_hash_part(b), _hash_part(a)))
        h = F.when(b.isNull() | (bin_(b) != bin_(a)), F.xxhash64(_hash_part(a))).otherwise(pair)
        return F.shiftleft(bin_(a), 32).bitwiseOR(h.bitwiseAND(_long(0xFFFFFFFF)))

    return F.transform(_firsts(u, bin_), sign)


def signature(text: Column, width: int = WIDTH) -> Column:
    """The Order MinHash of a text (not null): one long for each bin that has k-mers, none for a text without words."""

    def kmers(w: Column) -> Column:
        whole = F.array(_placed(F.xxhash64(w), F.lit(0)))
        each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: _placed(F.xxhash64(*[F.get(w, i + k) for k in range(width)]), F.least(i, F.lit(_PLACE))))
        return F.when(F.size(w) <= width, whole).otherwise(each)

    def sign(w: Column) -> Column:
        numbered = _let(F.sort_array(kmers(w)), _numbered)
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(_let(F.sort_array(numbered), _signatures))

    return _let(words_of(text), sign)


def as_string(signature: Column) -> Column:
    """Ten hex digits for each bin: two of its number and eight of its hash."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of bins that agree, of those in which either text has k-mers; 1 if neither has any."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    total = F.size(F.array_union(bins(a), bins(b)))
    return F.when(total == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / total)


_KEY = ["_k1", "_k2", "_th"]


def previous(ids: DataFrame) -> DataFrame:
    """ids(_k1, _k2, _th, _id, _half), a row for each document, with `_to` (_k1, _k2, _th, _half) of the one before by id, then _th.

    Before the first comes the last; nulls come first. Rows are ordered within
    ranges of ids; only the last row of each range is seen by all tasks.
    """
    ranged = checkpointed(ids.repartitionByRange(F.col("_id").asc_nulls_first(), "_th").withColumn("_range", F.spark_partition_id()))
    own = F.struct(*_KEY, "_half")
    ends = ranged.groupBy("_range").agg(F.max(F.struct("_id", "_th", own.alias("_own"))).alias("_last"))
    whole = Window.orderBy("_range")
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_last._own").over(whole), F.last("_last._own").over(every))
    # As many rows as there are ranges, which the number of shuffle partitions bounds.
    ends = F.broadcast(ends.select(F.col("_range").alias("_r"), before.alias("_before")))
    within = Window.partitionBy("_range").orderBy(F.col("_id").asc_nulls_first(), "_th")
    lagged = ranged.withColumn("_lag", F.lag(own).over(within)).join(ends, F.col("_range") == F.col("_r"))
    return lagged.select(*_KEY, F.coalesce("_lag", "_before").alias("_to"))


def edit_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and its likeness to that and to the next document's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, next_doc_id. The edited text has its last floor(n_chars / 2)
    code points replaced by the first as many (or all) of the next document by
    id; after the last comes the first.

    The order is found on ids alone; then each document is sent to the one
    before it, cut to what that takes of it.

    Null texts are empty: they have an empty fingerprint, and two of them are
    alike (1). Texts of fewer than `width` words are one k-mer. Equal texts
    have equal fingerprints. Null ids come first; rows that repeat an id are
    ordered by a hash of their texts, and rows that repeat both are one
    document, with one next. A single document is its own next. Ids are of any
    type that has an order; they are told apart by 128 bits of hash. No rows:
    no rows.
    """
    text_of = F.coalesce(docs[f"`{text}`"], F.lit(""))
    id_of = docs[f"`{doc_id}`"]
    keys = [F.xxhash64(id_of.isNull(), id_of).alias("_k1"), F.xxhash64(F.lit(1), id_of).alias("_k2"), F.xxhash64(text_of).alias("_th")]
    half = F.floor(F.length("_text") / 2).cast("int")
    ids = docs.select(*keys, id_of.alias("_id"), text_of.alias("_text")).groupBy(*_KEY).agg(F.first("_id").alias("_id"), F.max(half).alias("_half"))
    found = checkpointed(previous(ids)).hint("merge")
    # Both uses read one shuffle: they need the same columns of it.
    signed = docs.select(*keys, id_of.alias("_id"), text_of.alias("_text"), signature(text_of, width).alias("_sig")).join(found, _KEY)
    copy = F.row_number().over(Window.partitionBy(*_KEY).orderBy(*_KEY))
    sent = signed.withColumn("_copy", copy).where("_copy = 1").select(
        *[F.col(f"_to.{k}").alias(k) for k in _KEY], F.col("_id").alias("_nid"), F.substring(F.col("_text"), F.lit(1), F.col("_to._half")).alias("_part"), F.col("_sig").alias("_nsig")
    )
    paired = signed.drop("_to").join(sent.hint("merge"), _KEY)
    n = F.length("_text")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), "_part")
    made = paired.select("_id", "_nid", n.cast("long").alias("_n"), "_sig", "_nsig", _let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), signature(e, width).alias("sig"))).alias("_e"))
    # A generator keeps the plan from computing the edited signature once for each use.
    once = made.select("_id", "_nid", "_n", "_sig", "_nsig", F.explode(F.array("_e")).alias("_e"))
    return once.select(
        F.col("_id").alias(doc_id),
        F.col("_n").alias("n_chars"),
        F.col("_e.sha").alias("edited_sha256"),
        as_string(F.col("_sig")).alias("fingerprint"),
        as_string(F.col("_e.sig")).alias("edited_fingerprint"),
        likeness(F.col("_sig"), F.col("_e.sig")).alias("near_edited"),
        likeness(F.col("_sig"), F.col("_nsig")).alias("near_next"),
        F.col("_nid").alias("next_doc_id"),
    )

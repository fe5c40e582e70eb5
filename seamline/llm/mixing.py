"""A mix of sources at target weights.

The words of each source, document after document, are packed into blocks of
one length. The mix has as many slots as the targets ask for, dealt to output
shards of one size. How many of a shard's slots each source has is a multinomial
draw by the targets; what the draws of all shards give a source beyond its
quota goes, slot by slot, to sources that they left short. Slots are numbered
within their source, shard after shard; the number goes through a pseudorandom
permutation of that source's blocks, a new one for each repetition, and the
block of that index is joined to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamline.llm.common import Apart, checkpointed, text_rows

#: Weights by a source's place in code point order, repeating; the mix's size and the
#: most that is taken of a source, in units of what there is.
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
#: Words in a block; slots in an output shard; rows of a source that are ordered together.
BLOCK = 128
SHARD_SLOTS = 4096
CHUNK_ROWS = 4000
#: Slots that one task makes; draws that one task makes; shards whose draws are added up together.
TASK_SLOTS = 1 << 17
TASK_DRAWS = 1 << 17
SHARD_GROUP = 1024
ROUNDS = 12
SEED = 20

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def permuted(x: Column, n: Column, seed: list[Column], inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """x in [0, n) under a pseudorandom permutation of [0, n): rounds of swap-or-not.

    Each round pairs x with k - x for a key k, and a hash bit of the pair says
    whether they change places.
    """

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*seed, r), n) - at, n)
        swap = F.xxhash64(*seed, r, F.greatest(at, other), F.lit("swap")).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    order = F.sequence(F.lit(rounds - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(order, x, step)


def word_count(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """sources (_source, _size) with `_rank` (from 1), `_weight` and `_target`.

    A source's target is its weight times one level, or `most` times its size
    if that is less. Sorted by the level at which they stop, sources before
    the first that doesn't stop at the level left for the rest have stopped.
    A row for each source: the windows here hold no documents.
    """
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (((F.col("_rank") - 1) % len(WEIGHTS)) + 1).cast("int"))
    sized = ranked.withColumn("_weight", weight).withColumns({"_cap": F.col("_size").cast("double") * most, "_stop": F.col("_size") * float(most) / F.col("_weight")})
    up = Window.orderBy("_stop", "_rank")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = sized.withColumns(
        {
            "_asked": F.sum("_size").over(whole).cast("double") * total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_among": F.sum("_weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    ).withColumn("_level", F.col("_asked") / F.col("_among"))
    free = F.col("_level") <= F.col("_stop")
    level = F.min_by(F.when(free, F.col("_level")), F.when(free, F.struct("_stop", "_rank"))).over(whole)
    stopped = left.withColumn("_free", level)
    return stopped.select("_source", "_size", "_rank", "_weight", F.least(F.col("_weight") * F.col("_free"), F.col("_cap")).alias("_target"))


def quotas(aimed: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """targets() with `_blocks`, `_slots` and `_trim`.

    Whole repetitions come first, then as many blocks as reach the target; the
    last slot leaves out its last `_trim` words, so a source's taken words are
    its target rounded.
    """
    goal = F.bround("_target").cast("long")
    some = F.col("_size") > 0
    a = aimed.withColumns({"_blocks": F.ceil(F.col("_size") / block).cast("long"), "_goal": goal})
    a = a.withColumns({"_full": F.when(some, F.floor(F.col("_goal") / F.col("_size"))).otherwise(0).cast("long")})
    a = a.withColumns({"_rest": F.when(some, F.col("_goal") - F.col("_full") * F.col("_size")).otherwise(0), "_lack": F.col("_blocks") * block - F.col("_size")})
    # The last block is short; whether it is among the blocks of the last repetition decides how many are needed.
    at = F.when(some, permuted(F.col("_blocks") - 1, F.col("_blocks"), [F.lit(seed), F.col("_rank"), F.col("_full")], inverse=True)).otherwise(0)
    a = a.withColumns({"_short_at": at, "_r0": F.ceil(F.col("_rest") / block).cast("long")})
    lacking = F.col("_r0") * block - F.when(F.col("_short_at") < F.col("_r0"), F.col("_lack")).otherwise(0) < F.col("_rest")
    a = a.withColumn("_r", F.col("_r0") + lacking.cast("long"))
    got = F.col("_r") * block - F.when(F.col("_short_at") < F.col("_r"), F.col("_lack")).otherwise(0)
    a = a.withColumns({"_trim": got - F.col("_rest"), "_slots": F.col("_full") * F.col("_blocks") + F.col("_r")})
    return a.select("_source", "_size", "_rank", "_weight", "_target", "_blocks", "_slots", "_trim")


def draws(spark: SparkSession, wanted: list[tuple[int, int]], shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(_shard, _rank, _count): the multinomial draw of each output shard's slots by source, without zeros.

    wanted: (rank, slots) of each source. All shards but the last have shard_slots slots.
    A shard's draw depends on its number and the seed alone.
    """
    total = sum(n for _, n in wanted)
    shards = -(-total // shard_slots)
    ranks = np.array([r for r, _ in wanted], np.int64)
    share = np.array([n for _, n in wanted], np.float64) / max(1, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h in b.column(0).to_pylist():
                generator = np.random.Generator(np.random.Philox(key=np.array([seed, h], np.uint64)))
                got = generator.multinomial(min(shard_slots, total - h * shard_slots), share)
                at = np.nonzero(got)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h)), pa.array(ranks[at]), pa.array(got[at])], names=["_shard", "_rank", "_count"])

    tasks = max(1, -(-shards * min(len(wanted), shard_slots) // TASK_DRAWS))
    return spark.range(0, shards, 1, tasks).mapInArrow(run, "_shard long, _rank long, _count long")


def slots(q: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """A row for each slot of the mix: (_rank, _block, _round, _take, _shard, _place).

    _take: the words that the slot takes from the start of its block. A number
    for each source reaches the driver. A shard's draws are dealt to tasks
    before they become rows, so that a large source is no single task's; the
    number of tasks follows from that of the slots.
    """
    wanted = [(r["_rank"], r["_slots"]) for r in q.where(F.col("_slots") > 0).orderBy("_rank").select("_rank", "_slots").collect()]
    total = sum(n for _, n in wanted)
    got = checkpointed(draws(q.sparkSession, wanted, shard_slots, seed)).withColumn("_group", F.floor(F.col("_shard") / SHARD_GROUP))
    # Slots of a source are numbered shard after shard: sums of groups of shards, and sums within a group.
    sums = got.groupBy("_rank", "_group").agg(F.sum("_count").alias("_sum"))
    past = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.select("_rank", "_group", past("_sum", Window.partitionBy("_rank").orderBy("_group")).alias("_start"))
    numbered = got.withColumns(
        {
            "_from": past("_count", Window.partitionBy("_rank", "_group").orderBy("_shard")),
            "_inner": past("_count", Window.partitionBy("_shard").orderBy("_rank")),
        }
    ).join(groups, ["_rank", "_group"])
    # What a source was drawn beyond its quota, and what it lacks: equal sums, numbered by source.
    drawn = q.select("_rank", "_size", "_blocks", "_slots", "_trim").join(sums.groupBy("_rank").agg(F.sum("_sum").alias("_drawn")), "_rank", "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    drawn = drawn.withColumns({"_over": F.greatest(F.col("_drawn") - F.col("_slots"), F.lit(0)), "_lack": F.greatest(F.col("_slots") - F.col("_drawn"), F.lit(0))})
    by = Window.orderBy("_rank")
    drawn = checkpointed(drawn.withColumns({"_over_from": past("_over", by), "_lack_from": past("_lack", by)}))
    source = ["_rank", "_size", "_blocks", "_slots", "_trim"]
    runs = numbered.join(drawn, "_rank").select(*source, "_shard", "_count", "_inner", (F.col("_from") + F.col("_start")).alias("_from"), "_over_from")
    dealt = checkpointed(runs).repartition(max(1, -(-total // TASK_SLOTS)), "_rank", "_shard")
    end = F.col("_from") + F.col("_count")

    def each(first: Column, last: Column) -> Column:
        return F.explode(F.when(first <= last, F.sequence(first, last))).alias("_j")

    kept = dealt.select(*source, "_shard", "_inner", "_from", each(F.col("_from"), F.least(end, F.col("_slots")) - 1))
    over = dealt.where(end > F.col("_slots")).select("_shard", "_inner", "_from", "_slots", "_over_from", each(F.greatest("_from", "_slots"), end - 1))
    over = over.select("_shard", "_inner", "_from", F.col("_j").alias("_o"), (F.col("_over_from") + F.col("_j") - F.col("_slots")).alias("_x"))
    lacking = drawn.where(F.col("_lack") > 0).select(*source, "_drawn", "_lack_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lack") - 1)).alias("_i"))
    lacking = lacking.select(*source, (F.col("_drawn") + F.col("_i")).alias("_j"), (F.col("_lack_from") + F.col("_i")).alias("_x"))
    moved = over.join(lacking, "_x").select(*source, "_shard", (F.col("_inner") + F.col("_o") - F.col("_from")).alias("_in"), "_j")
    one = kept.select(*source, "_shard", (F.col("_inner") + F.col("_j") - F.col("_from")).alias("_in"), "_j").unionByName(moved)
    one = one.withColumn("_round", F.floor(F.col("_j") / F.col("_blocks")).cast("long"))
    made = one.withColumns(
        {
            "_block": permuted(F.pmod("_j", "_blocks"), F.col("_blocks"), [F.lit(seed), F.col("_rank"), F.col("_round")]),
            "_place": permuted(F.col("_in"), F.least(F.lit(shard_slots), F.lit(total) - F.col("_shard") * shard_slots).cast("long"), [F.lit(seed), F.lit("place"), F.col("_shard")]),
        }
    )
    take = F.least(F.lit(block).cast("long"), F.col("_size") - F.col("_block") * block) - F.when(F.col("_j") == F.col("_slots") - 1, F.col("_trim")).otherwise(0)
    return made.select("_rank", "_block", "_round", take.alias("_take"), "_shard", "_place")


def _placed(docs: DataFrame, text: str, doc_id: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their first word's place in their source's stream, quotas).

    Documents: (_id, _th, _copy, _size, _rank, _source, _all_words, _target, _at).
    A source's stream is ordered by chunks of ids' hashes and by id within
    them; a chunk is ordered by one task, and chunks are added up by their
    totals. How many chunks there are follows from the number of rows.
    """
    base = docs.select(docs[f"`{doc_id}`"].alias("_id"), docs[f"`{source}`"].alias("_source"), F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit(""))).alias("_th"), word_count(docs[f"`{text}`"]).alias("_size"))
    base = checkpointed(base)
    chunks = max(1, -(-base.count() // CHUNK_ROWS))
    base = base.withColumn("_chunk", F.pmod(F.xxhash64(F.lit("chunk"), "_id", "_th"), F.lit(chunks)).cast("int"))
    sums = base.groupBy("_source", "_chunk").agg(F.sum("_size").alias("_words"))
    q = checkpointed(quotas(targets(sums.groupBy("_source").agg(F.sum("_words").alias("_size")))))
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("_source").alias("_s"), F.col("_chunk").alias("_c"), before.alias("_start"))
    within = Window.partitionBy("_source", "_chunk").orderBy("_id", "_th")
    own = base.withColumns(
        {
            "_in": F.coalesce(F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_copy": F.row_number().over(Window.partitionBy("_source", "_chunk", "_id", "_th").orderBy("_id")),
        }
    )
    own = own.join(starts, own["_source"].eqNullSafe(starts["_s"]) & (own["_chunk"] == starts["_c"]))
    named = q.select(F.col("_source").alias("_q"), "_rank", F.col("_size").alias("_all_words"), "_target")
    own = own.join(named, own["_source"].eqNullSafe(named["_q"]))
    return own.select("_id", "_th", "_copy", "_size", "_rank", "_source", "_all_words", "_target", (F.col("_in") + F.col("_start")).alias("_at")), q


def _taken(placed: DataFrame, q: DataFrame, block: int = BLOCK) -> DataFrame:
    """placed documents once for each slot that takes words of them: _word (first of them), _n, _round, _shard, _place."""
    pieces = placed.where(F.col("_size") > 0).withColumn("_block", F.explode(F.sequence(F.floor(F.col("_at") / block).cast("long"), F.floor((F.col("_at") + F.col("_size") - 1) / block).cast("long"))))
    # Both sides grow with the corpus, though what they are made from is small: never broadcast.
    joined = pieces.join(slots(q, block).hint("merge"), ["_rank", "_block"])
    begin = F.col("_block") * block
    low = F.greatest(F.col("_at"), begin)
    n = F.least(F.col("_at") + F.col("_size"), begin + F.col("_take")) - low
    return joined.withColumns({"_word": low - F.col("_at"), "_n": n}).where(F.col("_n") > 0)


def mix_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_slots, first_shard), a row for each row of docs.

    Sources weigh WEIGHTS by code point order, null (a source of its own)
    last, and share TOTAL of all words; no target is above MOST times its
    source's words. taken counts the words of the document that the mix
    takes, repetitions included: never over MOST times its size. n_slots counts
    the slots that hold words of it, first_shard is the least output shard of
    those (null if there are none). Reruns and other partitionings agree.

    Null, empty and blank texts have size 0 and none is taken; if all have,
    targets are 0. Rows that are equal take by turns. No rows: no rows.
    """
    placed, q = _placed(docs, text, doc_id, source)
    placed = checkpointed(placed)
    keys = ["_rank", "_at", "_size"]
    taken = _taken(placed, q).groupBy(*keys).agg(F.sum("_n").alias("_sum"), F.count("_n").alias("_held"), F.min("_shard").alias("_in"))
    # Documents of one source start at different words unless they are empty.
    out = placed.join(taken.where(F.col("_size") > 0), keys, "left")
    return out.select(F.col("_id").alias(doc_id), F.col("_size").alias("size"), F.col("_all_words").alias("source_size"), F.col("_target").alias("target"), F.coalesce("_sum", F.lit(0)).cast("long").alias("taken"), F.coalesce("_held", F.lit(0)).alias("n_slots"), F.col("_in").alias("first_shard"))


def mixed_blocks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself, by document: (shard, place, doc_id, first_word, words, repetition).

    A slot's block is made of the rows with its shard and place, in the order
    of their documents in the source's stream (`at`).
    """
    placed, q = _placed(docs, text, doc_id, source)
    got = _taken(checkpointed(placed), q)
    return got.select(F.col("_shard").alias("shard"), F.col("_place").alias("place"), F.col("_id").alias("doc_id"), F.col("_at").alias("at"), F.col("_word").alias("first_word"), F.col("_n").alias("words"), F.col("_round").alias("repetition"))


def cut_words(text: bytes, pieces: list[tuple[int, int, int]]) -> bytes:
    """The words of text that pieces (repetition, first, number) name, with the white space between them.

    Pieces that follow one another are one; others are joined by \\n. All
    words of a repetition give the whole text as it is.
    """
    at = [m.span() for m in _WORD.finditer(text)]
    out = []
    for _, group in groupby(sorted(pieces), key=lambda p: p[0]):
        runs: list[list[int]] = []
        for _, first, n in group:
            if runs and runs[-1][1] == first:
                runs[-1][1] = first + n
            else:
                runs.append([first, first + n])
        out += [text if (a, b) == (0, len(at)) else text[at[a][0] : at[b - 1][1]] for a, b in runs]
    return b"\n".join(out)


def mix_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with the words that the mix takes of them as their text; those of which it takes none go.

    A document that is taken twice has its words twice. Other columns stay as
    they are, but an n_chars column is counted anew.
    """
    a = Apart(docs)
    text, doc_id, source = a.at(text), a.at(doc_id), a.at(source)
    placed, q = _placed(a.df, text, doc_id, source)
    pieces = _taken(checkpointed(placed), q).groupBy("_id", "_th", "_source", "_copy").agg(F.collect_list(F.struct("_round", "_word", "_n")).alias("_pieces"))
    whole = a.df.withColumn("_h", F.xxhash64(F.coalesce(text, F.lit(""))))
    whole = whole.withColumn("_o", F.row_number().over(Window.partitionBy(doc_id, "_h", source).orderBy(doc_id)))
    cond = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")) & F.col(source).eqNullSafe(F.col("_source")) & (F.col("_o") == F.col("_copy"))
    names = a.df.columns
    joined = whole.join(pieces, cond).select(*names, F.col(text).cast("binary").alias("_bytes"), "_pieces")
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [cut_words(t, [(p["_round"], p["_word"], p["_n"]) for p in ps]).decode("utf-8", "replace") for t, ps in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True)]
            cols = list(b.columns[: len(names)])
            cols[place] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = text_rows(joined).mapInArrow(run, a.df.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn(a.at("n_chars"), F.length(text).cast(docs.schema["n_chars"].dataType))
    return a.back(out)

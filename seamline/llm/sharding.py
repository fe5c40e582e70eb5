"""Placement of rows in shards by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size:
it starts at one hash of its name and steps by another. Shards take turns,
each claiming the first slot of its order that is free, until the table is
full. A row's key hashes to a slot, and the slot names the shard. When a shard
goes, few keys of the others move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.common import Apart

#: Production parameters: 16 shards, about 127 slots for each.
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
TABLE_SIZE = 2039
NULL_KEY = "\x00null"


def _word(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot, the index of the shard that claimed it.

    The work and the result depend on `size` alone, never on the rows.
    """
    if not is_prime(size) or not 0 < len(shards) <= size:
        raise ValueError("the table's size must be prime and no smaller than the number of shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names must differ")
    at = [_word(f"{s}#offset") % size for s in shards]
    step = [_word(f"{s}#skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    slots, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            slots[at[i]] = i
            left -= 1
            if not left:
                break
    return slots


def slot_of(keys: Sequence[Column], size: int) -> Column:
    """The slot of a row's key. A null part of a key counts as a value of its own."""
    parts = [F.coalesce(k.cast("string"), F.lit(NULL_KEY)) for k in keys]
    text = parts[0] if len(parts) == 1 else F.concat_ws("\x1f", *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(size)


def lookup_frame(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """(slot, shard_index, shard), one row per slot."""
    filled = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    rows = spark.range(1).select(F.posexplode(filled).alias("_slot", "_claimed"))
    return rows.select(
        F.col("_slot").cast("long").alias("_slot"),
        F.col("_claimed").cast("int").alias("_index"),
        F.element_at(names, F.col("_claimed").cast("int") + 1).alias("_shard"),
    )


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """df with `slot` (long), `shard_index` (int) and `shard` (string) appended.

    Rows with equal keys meet in one shard; give a key that is unique (such as
    a document's id) where one value of another column may hold many rows. A
    map over the rows with a broadcast table of `size` rows: no shuffle.

    Null keys are placed like any other value. Repeated rows keep their count.
    Columns of the same names are replaced. No rows: no rows.
    """
    a = Apart(df)
    slots = lookup_frame(df.sparkSession, shards, size)
    placed = a.df.withColumn("_slot", slot_of([F.col(a.at(k)) for k in keys], size))
    # `size` rows.
    joined = placed.join(F.broadcast(slots), "_slot", "inner")
    return a.back(joined, slot=F.col("_slot"), shard_index=F.col("_index"), shard=F.col("_shard"))


def write_shards(df: DataFrame, path: str, keys: Sequence[str], shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, files: int = 1, mode: str = "errorifexists") -> None:
    """Write df as Parquet with a folder for each shard and about `files` files in each.

    Rows spread over shard and a salt of the whole key, so no task takes more than its share of a shard.
    """
    placed = assign_shards(df, keys, shards, size)
    salt = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(files))
    placed.repartition(len(shards) * files, "shard", salt).write.mode(mode).partitionBy("shard").parquet(path)


ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT i, printf('shard-%02d', i) AS name,
         ('0x' || substr(md5(printf('shard-%02d', i) || '#offset'), 1, 8))::BIGINT % {TABLE_SIZE} AS offs,
         ('0x' || substr(md5(printf('shard-%02d', i) || '#skip'), 1, 8))::BIGINT % {TABLE_SIZE - 1} + 1 AS skip
  FROM range({len(SHARDS)}) t(i)),
fill(turn, slots) AS (
  SELECT 0, list_transform(range({TABLE_SIZE}), lambda x: -1::BIGINT)
  UNION ALL
  SELECT turn + 1, list_transform(range({TABLE_SIZE}), lambda k: CASE WHEN k = chosen THEN i ELSE slots[k + 1] END)
  FROM (SELECT f.turn, f.slots, s.i,
          (s.offs + list_filter(range({TABLE_SIZE}), lambda j: f.slots[(s.offs + j * s.skip) % {TABLE_SIZE} + 1] = -1)[1] * s.skip) % {TABLE_SIZE} AS chosen
        FROM fill f JOIN shards s ON s.i = f.turn % {len(SHARDS)} WHERE f.turn < {TABLE_SIZE})),
lookup AS (SELECT slots FROM fill WHERE turn = {TABLE_SIZE})
SELECT d.doc_id, d.slot, l.slots[d.slot + 1]::INT AS shard_index, s.name AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null')), 1, 8))::BIGINT % {TABLE_SIZE} AS slot FROM documents) d
CROSS JOIN lookup l JOIN shards s ON s.i = l.slots[d.slot + 1]
"""

"""Removal of lines that repeat across documents.

What has been seen is kept as levelled sorted runs of line hashes, in the
manner of a log-structured merge tree. A run holds, for each 128-bit hash of a
line's key, in how many documents of its batch the line was and the largest
document id among them. A new batch is merge-anti-joined with the runs: lines
that no run holds become a run of their own at level 0, and the others are
increments of lines that are known. So a line is in one run only. A level that
has `fanout` runs is compacted into one run of the next level by a merge of
sorted runs, so that a line is rewritten once per level and not once per batch.
A line's documents are those of its run and its increments.

Runs are tables bucketed and sorted by the hash, a file for each bucket, so
that anti-joins and compactions read them in order, without a shuffle or sort.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.common import ASCII_SPACE, Apart, ascii_lower, checkpointed, remove, scratch

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
BATCHES = 4
FANOUT = 2

_HASH = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    """What makes lines the same: outer ASCII white space off, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def hashed_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH) -> DataFrame:
    """A row for each line whose key has at least min_length code points.

    (_id, _th, _lines, _pos, _h1, _h2): the document's id, its text's hash and
    number of lines, the line's place, and two independent 64-bit hashes of
    the key. Null texts count as empty.
    """
    whole = F.coalesce(docs[f"`{text}`"], F.lit(""))
    lines = docs.select(docs[f"`{doc_id}`"].alias("_id"), F.xxhash64(whole).alias("_th"), F.split(whole, "\n", -1).alias("_parts"))
    rows = lines.select("_id", "_th", F.size("_parts").alias("_lines"), F.posexplode("_parts").alias("_pos", "_line"))
    keyed = rows.select("_id", "_th", "_lines", "_pos", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_length)
    return keyed.select("_id", "_th", "_lines", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


def batch_counts(lines: DataFrame) -> DataFrame:
    """(_h1, _h2, _n, _keeper) of hashed_lines().

    Counting goes by (hash, document) first, and both steps combine before
    they shuffle, so a line that a third of all documents share meets no
    single task as more than a row per task.
    """
    once = lines.groupBy(*_HASH, "_id").agg(F.lit(1).alias("_one"))
    return once.groupBy(*_HASH).agg(F.sum("_one").cast("long").alias("_n"), F.max("_id").alias("_keeper"))


@contextmanager
def _in_order(spark: SparkSession) -> Iterator[None]:
    """Bucketed tables of a file for each bucket are read as sorted, while what is inside runs."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LineRuns:
    """Levelled runs in a shared folder. Batches must hold different documents."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("a level is compacted at two runs or more")
        self.spark, self.fanout = spark, fanout
        # As many as a shuffle has partitions: what is dealt by the hash is then dealt to buckets too.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or scratch(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.increments: list[str] = []

    def _write(self, run: DataFrame) -> str:
        """The name of a new table of a run, or of a batch, sorted as a run is."""
        name = f"seamline_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.path}/{name}")

    @property
    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _keys(self, run: str) -> DataFrame:
        return self.spark.table(run).select(*_HASH).hint("merge")

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of lines (with the hash) that no run holds."""
        return reduce(lambda left, run: left.join(self._keys(run), _HASH, "left_anti"), self.runs, lines)

    def add(self, lines: DataFrame) -> None:
        """Merge-anti-join a batch of hashed lines with the runs; new lines become a run, others increments."""
        with _in_order(self.spark):
            batch = self._write(batch_counts(lines))
            if not self.levels:
                self.levels.append([])
            if self.runs:
                rows = self.spark.table(batch)
                path = f"{self.path}/known-{len(self.increments):06d}"
                # A line is in one run at most, so what the runs know of the batch are different lines.
                reduce(DataFrame.unionByName, [rows.join(self._keys(run), _HASH, "left_semi") for run in self.runs]).write.parquet(path)
                self.increments.append(path)
                fresh = self._write(self.unseen(rows))
                self._drop(batch)
                batch = fresh
            self.levels[0].append(batch)
            level = 0
            while len(self.levels[level]) >= self.fanout:
                self._compact(level)
                level += 1

    def _compact(self, level: int) -> None:
        old = self.levels[level]

        def merge(left: DataFrame, right: DataFrame) -> DataFrame:
            both = left.join(right.toDF(*_HASH, "_m", "_k").hint("merge"), _HASH, "full_outer")
            return both.select(*_HASH, F.coalesce("_n", "_m").alias("_n"), F.coalesce("_keeper", "_k").alias("_keeper"))

        merged = self._write(reduce(merge, [self.spark.table(run) for run in old]))
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(merged)
        self.levels[level] = []
        for run in old:
            self._drop(run)

    def counted(self, least: int = 1) -> DataFrame:
        """(_h1, _h2, _n, _keeper) of the lines in at least so many documents, as a table of its own."""
        with _in_order(self.spark):
            parts = [self.spark.table(run) for run in self.runs]
            if self.increments:
                more = self.spark.read.parquet(*self.increments).groupBy(*_HASH).agg(F.sum("_n").alias("_m"), F.max("_keeper").alias("_k"))
                parts = [
                    run.join(more.hint("merge"), _HASH, "left").select(*_HASH, (F.col("_n") + F.coalesce("_m", F.lit(0))).alias("_n"), F.greatest("_keeper", "_k").alias("_keeper"))
                    for run in parts
                ]
            return checkpointed(reduce(DataFrame.unionByName, parts).where(F.col("_n") >= least))

    def clear(self) -> None:
        for run in self.runs:
            self._drop(run)
        self.levels, self.increments = [], []
        remove(self.spark, self.path)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with repeated lines out of `text`; `n_lines` (before) and `n_dropped` (long) appended.

    A line whose key has at least min_length code points and is in at least
    min_documents documents goes everywhere except in the document with the
    largest id that holds it. The others stay, joined by one \\n.

    Null and empty texts are one empty line and stay empty. Documents are told
    apart by id: rows that repeat an id count once, and all of them keep what
    the largest id keeps; null ids count as one document, below all others.
    Repeated rows stay rows. Columns named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    a = Apart(docs)
    text, doc_id = a.at(text), a.at(doc_id)
    at = scratch(spark, "lines")
    batch = F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(batches)).cast("int")
    hashed_lines(a.df, text, doc_id, min_length).withColumn("_batch", batch).write.parquet(at)
    lines = spark.read.parquet(at)
    runs = LineRuns(spark, fanout=fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("_batch") == b))
    # As a table of its own, the side of a join whose other side may be skewed can be dealt anew.
    repeated = runs.counted(min_documents)
    runs.clear()
    gone = lines.join(repeated, _HASH).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    # The places that stay, as an array of their own: membership is tested once per document, not once per line.
    stay = gone.groupBy(F.col("_id").alias("_i"), F.col("_th").alias("_t")).agg(
        F.array_except(F.sequence(F.lit(0), F.max("_lines") - 1), F.collect_set("_pos")).alias("_stay")
    )
    stay = checkpointed(stay)
    remove(spark, at)
    whole = F.coalesce(text, F.lit(""))
    # The text travels as its lines only.
    parts = a.df.withColumns({"_th": F.xxhash64(whole), "_parts": F.split(whole, "\n", -1)}).drop(text)
    joined = parts.join(stay, F.col(doc_id).eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left")
    left = F.array_join(F.transform("_stay", lambda i: F.get(F.col("_parts"), i)), "\n")
    kept = F.when(F.col("_stay").isNull(), F.array_join("_parts", "\n")).otherwise(left)
    dropped = F.when(F.col("_stay").isNull(), F.lit(0)).otherwise(F.size("_parts") - F.size("_stay"))
    out = joined.withColumns({"_n": F.size("_parts").cast("long"), "_d": dropped.cast("long"), text: kept})
    return a.back(out, n_lines=F.col("_n"), n_dropped=F.col("_d"))


ORACLE = f"""
WITH base AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM base),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_LENGTH}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
marked AS (
  SELECT a.doc_id, a.pos, a.line, (r.k IS NOT NULL AND a.doc_id <> r.keeper) AS gone
  FROM keyed a LEFT JOIN repeated r ON a.k = r.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

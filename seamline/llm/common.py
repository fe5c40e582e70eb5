"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, from spark.checkpoint.dir.

    Only a session on one machine that names none gets a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="seamline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/seamline-{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that scratch() named."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of texts, and their bytes, that go to Python at once, at most.
TEXT_ROWS = 500
TEXT_BYTES = 16 << 20


def text_rows(df: DataFrame) -> DataFrame:
    """df, for a function in Python: from now on its session sends TEXT_ROWS rows or TEXT_BYTES at once, or less if it did before.

    Texts may be long, and the defaults have no bound that fits several workers.
    The setting is read when a query is run, so it can't be put back here.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        now = (conf.get(key) or "").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def ascii_lower(c: Column) -> Column:
    """c with A-Z lower-cased and every other character kept."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


class Apart:
    """A table's columns under names that an operator's own (with a leading _) can't clash with.

    `df` has the columns; at() gives the name that one has there, and back()
    the table with its own names, in its order, followed by new columns. A
    column that has the name of a new one (in any case) is replaced, one that
    was dropped is left out.
    """

    def __init__(self, table: DataFrame):
        self.names = table.columns
        self.df = table.toDF(*[f"c{i}" for i in range(len(self.names))])

    def at(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def back(self, out: DataFrame, **new: Column) -> DataFrame:
        taken = {n.lower() for n in new}
        kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in taken and f"c{i}" in out.columns]
        return out.select(*kept, *[c.alias(n) for n, c in new.items()])


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df as a side to broadcast if it is computed and counted and has at most so many rows, else as it is."""
    done = checkpointed(df)
    return F.broadcast(done) if done.count() <= rows else done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

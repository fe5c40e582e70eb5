"""Line-delimited JSON, lists of ids, and nested trees of JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.config import SPLITS


def read(spark: SparkSession, path: str | list[str], schema: T.StructType | str, keep_torn: bool = False) -> DataFrame:
    """Rows of JSON lines. A missing path has none; blank and torn lines are left out.

    With keep_torn a column _torn has the text of lines that aren't JSON.
    """
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if keep_torn:
        s = T.StructType([*s.fields, T.StructField("_torn", T.StringType())])
        reader = spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn")
    else:
        reader = spark.read.schema(s).option("mode", "DROPMALFORMED")
    try:
        return reader.json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], s)
        raise


def write(rows: DataFrame, path: str, append: bool = False) -> int:
    """Write rows as JSON lines; how many there were."""
    o = Observation()
    rows.observe(o, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").json(path)
    return int(o.get["n"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one text file, lines from 0 in the file's order.

    Lines are numbered within splits of the file and shifted by the splits
    before, whose order is that of their offsets.
    """
    meta = spark.read.format("text").load(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    tagged = meta.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    sizes = tagged.groupBy("_part", "file_path", "file_block_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # A row for each split of the file.
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("file_path", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = tagged.join(starts.select("_part", "file_path", "file_block_start", "_first", "_start"), ["_part", "file_path", "file_block_start"])
    return joined.select((F.col("_id") - F.col("_first") + F.col("_start")).alias("line"), "value")


def read_split_lists(spark: SparkSession, folder: str, key: str = "source_id") -> DataFrame:
    """(key, split) from a text file of ids for each split. A missing file raises."""
    parts = [spark.read.text(f"{folder}/{s}_source_ids.txt").select(F.trim("value").alias(key), F.lit(s).alias("split")) for s in SPLITS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col(key) != "")


def write_split_lists(splits: DataFrame, folder: str, key: str = "source_id") -> None:
    """A folder of text for each split, under the names that read_split_lists() reads."""
    for s in SPLITS:
        splits.where(F.col("split") == s).select(F.col(key).cast("string").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(f"{folder}/{s}_source_ids.txt")


def word_task(lines: DataFrame, schema: str = "text string, label int, model string, domain_model string") -> DataFrame:
    """numbered_lines() of the word task as documents: id test_<line>, text, boundary, domain, generator."""
    parsed = lines.select("line", F.from_json("value", schema).alias("r")).where(F.col("r").isNotNull())
    dm = F.split("r.domain_model", "_", 2)
    return parsed.select(F.concat(F.lit("test_"), F.col("line").cast("string")).alias("id"), F.col("r.text").alias("text"), F.col("r.label").alias("boundary"), F.get(dm, F.lit(0)).alias("domain"), F.get(dm, F.lit(1)).alias("generator"))


def all_texts(rows: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., field, text) of every text field that isn't empty."""
    items: list[Column] = [F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns]
    return rows.select(*keep, F.explode(F.array(*items)).alias("_x")).select(*keep, "_x.*").where(F.coalesce(F.col("text"), F.lit("")) != "")


def review_tree(spark: SparkSession, glob: str, reviews: str = "array<struct<comments:string>>") -> DataFrame:
    """(venue, paper, idx, text) of the reviews in a tree of JSON files, trimmed, empty ones left out."""
    raw = spark.read.schema(f"id string, reviews {reviews}").option("multiLine", True).option("recursiveFileLookup", True).json(glob)
    each = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*/[^/]*$", 1).alias("venue"), F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("paper"), F.posexplode("reviews").alias("idx", "_r"))
    return each.select("venue", "paper", "idx", F.trim("_r.comments").alias("text")).where(F.col("text") != "")


def human_documents(texts: DataFrame, key: Column) -> DataFrame:
    """texts as documents without machine words: the boundary is their number of words."""
    from seamline.functions.text import task_words

    return texts.withColumns({"id": key, "boundary": F.size(task_words(F.col("text")))})


def verified(spark: SparkSession, path: str, digests: dict[str, str]) -> DataFrame:
    """(file, ok): whether each file's SHA-256 is the one expected."""
    want = spark.createDataFrame(list(digests.items()), "file string, _want string")
    got = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("_got"))
    return want.join(got, "file", "left").select("file", F.coalesce(F.col("_want") == F.col("_got"), F.lit(False)).alias("ok"))

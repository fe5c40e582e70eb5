"""Release tables: records, human windows, files and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.config import TYPES
from seamline.functions import sequences as sq
from seamline.operators.aggregates import cross_tab, release_groups
from seamline.operators.matching import twins

SHORT_TYPES = {t: t.split("_")[0] for t in TYPES}


def release_rows(records: DataFrame) -> DataFrame:
    """Records as they are released: boundaries, spans and shares anew from the labels. Lengths that differ raise."""
    names = F.create_map(*[F.lit(x) for kv in SHORT_TYPES.items() for x in kv])
    bad = F.concat(F.lit("labels and sentences differ in "), F.col("record_id"))
    labels = F.when(F.size("labels") != F.size("sentences"), F.raise_error(bad)).otherwise(F.col("labels"))
    checked = records.withColumn("labels", labels)
    ones = F.aggregate("labels", F.lit(0), lambda s, y: s + y)
    return checked.select(
        F.col("record_id").alias("passage_id"), "source_id", "window_id", "split", "generator", F.coalesce(names[F.col("construction_type")], F.col("construction_type")).alias("construction_type"),
        "sentences", "labels", sq.boundaries(F.col("labels")).alias("boundaries"), sq.spans(F.col("labels")).alias("machine_spans"),
        F.coalesce(F.try_divide(ones.cast("double"), F.size("labels").cast("double")), F.lit(0.0)).alias("ai_sentence_ratio"),
    )


def human_rows(records: DataFrame, windows: DataFrame, splits: DataFrame) -> DataFrame:
    """A row for each window that records use (with their ids) and each of a source that none uses; labels all 0.

    Misaligned records and windows in several splits raise.
    """
    aligned = twins(records, windows).select("window_id").distinct()
    w = windows.select("window_id", "source_id", "sentences")
    used = w.join(release_groups(records), "window_id").join(aligned, "window_id", "left_semi")
    spare = w.join(records.select("source_id"), "source_id", "left_anti").join(splits, "source_id").withColumn("passage_ids", F.array().cast("array<string>"))
    zero = F.transform("sentences", lambda _: F.lit(0))
    return used.select("window_id", "source_id", "split", "passage_ids", "sentences").unionByName(spare.select("window_id", "source_id", "split", "passage_ids", "sentences")).withColumn("labels", zero)


def write_release(rows: DataFrame, path: str, by: tuple[str, ...] = ("construction_type", "split")) -> None:
    """Parquet in a folder for each cell; rows of a cell are put together first, so that cells have few files."""
    rows.repartition(*by, F.pmod(F.xxhash64("passage_id"), F.lit(4))).write.mode("overwrite").partitionBy(*by).parquet(path)


def statistics(rows: DataFrame) -> dict[str, DataFrame]:
    """Tables that describe a release."""
    return {
        "totals": rows.agg(F.count(F.lit(1)).alias("passages"), F.sum(F.size("labels")).alias("sentences"), F.countDistinct("source_id").alias("sources"), F.countDistinct("window_id").alias("windows")),
        "type_by_split": cross_tab(rows, ["construction_type"], "split", ["train", "dev", "test"]),
        "generator_by_split": cross_tab(rows, ["generator"], "split", ["train", "dev", "test"]),
        "lengths": rows.groupBy(F.size("labels").alias("n_sentences")).agg(F.count(F.lit(1)).alias("n")),
    }


def markdown_table(rows: DataFrame, limit: int = 1000, digits: int = 3) -> str:
    """A small result table as Markdown; cells' bars are escaped."""
    show = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", r"\|").replace("\n", " ")
    got = rows.limit(limit).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in got])


def prompt_document(prompts: dict[str, dict[str, dict[str, str]]]) -> str:
    """Prompt templates (domain, primitive, parts) as Markdown."""
    out = []
    for domain, kinds in sorted(prompts.items()):
        out.append(f"# {domain}")
        for kind, parts in sorted(kinds.items()):
            out.append(f"## {kind}")
            out += [f"### {k}\n\n```\n{v}\n```" for k, v in parts.items()]
    return "\n\n".join(out)



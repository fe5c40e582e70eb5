"""Checks of generated text and of assembled records. Every check runs; errors are strings with a kind before a colon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.config import TYPE1, TYPE2, TYPE3, Config
from seamline.functions import sequences as sq
from seamline.functions import text as tx
from seamline.functions.markup import copy_errors
from seamline.functions.segment import sentences

RECORD_FIELDS = (
    "record_id", "source_id", "domain", "generator", "construction_type", "split", "text", "sentences", "labels", "boundaries",
    "boundary_position_normalized", "prompt_id", "raw_output", "cleaned_output", "temperature", "top_p", "retry_count",
    "validation_passed", "validation_errors",
)


def count_error(n: Column, target: Column, tolerance: int) -> Column:
    return F.when(F.abs(n - target) > tolerance, F.format_string("sentence_count: got %d, expected %d", n, target))


def length_error(n: Column, target: Column, tolerance: float) -> Column:
    low, high = target * (1 - tolerance), target * (1 + tolerance)
    return F.when((n < low) | (n > high), F.format_string("length: %d words outside %s-%s (target %d)", n, F.bround(low).cast("long").cast("string"), F.bround(high).cast("long").cast("string"), target))


def pattern_error(kind: str, text: Column, patterns: tuple[str, ...]) -> Column:
    hit = tx.first_of(text, patterns)
    return F.when(hit.isNotNull(), F.concat(F.lit(f"{kind}: matched '"), hit, F.lit("'")))


def script_error(share: Column, latin: Column, least: float, most: float) -> Column:
    low = F.when(share < least, F.concat(F.lit("script: sinhala_ratio "), F.format_number(share, 2), F.lit(f" < {least}")))
    return F.coalesce(low, F.when(latin > most, F.concat(F.lit("script: latin_ratio "), F.format_number(latin, 2), F.lit(f" > {most}"))))


def number_differences(source: Column, output: Column) -> tuple[Column, Column]:
    """(missing, added): the distinct numbers that a text has less, or more, often than its source."""
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    short = lambda a, b: F.array_sort(F.filter(F.array_distinct(a), lambda x: count(a, x) > count(b, x)))
    return short(source, output), short(output, source)


def numbers_error(text: Column, original: Column) -> Column:
    missing, added = number_differences(tx.numeric_tokens(original), tx.numeric_tokens(text))
    said = F.concat(F.lit("numbers: missing=["), F.array_join(missing, ", "), F.lit("] added=["), F.array_join(added, ", "), F.lit("]"))
    return F.when(original.isNotNull() & ((F.size(missing) > 0) | (F.size(added) > 0)), said)


def validate(rows: DataFrame, text: str = "text", sentence_target: str = "target_sentence_count", word_target: str = "target_word_count", original: str | None = "original", cfg: Config | None = None, numbers: bool = True, script: Column | None = None) -> DataFrame:
    """rows with `passed`, `errors` and `details`. Without an original the copy and number checks are left out."""
    cfg = cfg or Config()
    v = cfg.validate
    t = F.col(text)
    # Counts over the text are columns of their own, so that each is computed once.
    counted = rows.withColumns({"_share": tx.sinhala_ratio(t) if script is None else script, "_latin": tx.latin_ratio(t), "_words": tx.word_count(t)})
    judged = counted.withColumn("_sentences", sentences(cfg.segment)(t)).withColumn("_original", F.col(original) if original else F.lit(None).cast("string"))
    judged = judged.withColumn("_copy", copy_errors(v.max_copy)(t, F.col("_original")) if original else F.lit(None).cast("string"))
    share, latin, n, words = F.col("_share"), F.col("_latin"), F.size("_sentences"), F.col("_words")
    found = F.array(
        count_error(n, F.col(sentence_target), v.sentence_tolerance),
        length_error(words, F.col(word_target), v.length_tolerance),
        pattern_error("preamble", t, v.preamble),
        pattern_error("markdown", t, v.markdown),
        script_error(share, latin, v.min_script_ratio, v.max_latin_ratio),
        F.col("_copy"),
        numbers_error(t, F.col("_original")) if numbers else F.lit(None).cast("string"),
    )
    blank = t.isNull() | (tx.strip(F.coalesce(t, F.lit(""))) == "")
    errors = F.when(blank, F.array(F.lit("empty: model returned no text"))).otherwise(F.filter(found, lambda e: e.isNotNull()))
    details = F.struct(n.alias("n_sentences"), words.alias("n_words"), F.bround(share, 3).alias("sinhala_ratio"), F.bround(latin, 3).alias("latin_ratio"))
    out = judged.withColumns({"errors": errors, "details": F.when(~blank, details)}).withColumn("passed", F.size("errors") == 0)
    return out.drop("_sentences", "_original", "_copy", "_share", "_latin", "_words")


def integrity_errors(records: DataFrame, splits: DataFrame, cfg: Config | None = None) -> DataFrame:
    """records with `integrity_errors`, what contradicts in each: lengths, text, labels, boundaries, type, split, generator.

    Fields that the table lacks, or that are null where they must not be,
    are the only errors reported of a record.
    """
    cfg = cfg or Config()
    have = set(records.columns)
    absent = [f for f in RECORD_FIELDS if f not in have]
    if absent:
        return records.withColumn("integrity_errors", F.array(*[F.lit(f"missing field '{f}'") for f in absent]))
    named = splits.select(F.col("source_id").alias("_s"), F.col("split").alias("_true")).distinct()
    # One row a generator of the configuration.
    spark = records.sparkSession
    allowed = spark.createDataFrame([(g, list(c.splits), c.role) for g, c in cfg.generators.items()], "_g string, _allowed array<string>, _role string")
    joined = records.join(named, records["source_id"] == F.col("_s"), "left").join(F.broadcast(allowed), records["generator"] == F.col("_g"), "left")
    labels, derived = F.col("labels"), sq.boundaries(F.col("labels"))
    n_b, kind = F.size("boundaries"), F.col("construction_type")
    nulls = [F.when(F.col(f).isNull(), F.lit(f"missing field '{f}'")) for f in ("record_id", "source_id", "text", "sentences", "labels", "boundaries", "split")]
    missing = F.filter(F.array(*nulls), lambda e: e.isNotNull())
    checks = [
        F.when(F.size("sentences") != F.size(labels), F.format_string("len(sentences)=%d != len(labels)=%d", F.size("sentences"), F.size(labels))),
        F.when(F.col("text") != F.array_join("sentences", " "), "text does not equal joined sentences"),
        F.when(F.exists(labels, lambda y: ~y.isin(0, 1)), "labels contain non-binary values"),
        F.when(F.col("boundaries") != derived, "boundaries differ from label changes"),
        F.when(~F.exists(labels, lambda y: y != 0), "record contains no AI sentences"),
        F.when(F.forall(labels, lambda y: y != 0), "record contains no human sentences"),
        F.when((kind == TYPE1) & (n_b != 1), F.format_string("type1 must have exactly 1 boundary, got %d", n_b)),
        F.when((kind == TYPE2) & (n_b != 2), F.format_string("type2 must have exactly 2 boundaries, got %d", n_b)),
        F.when((kind == TYPE3) & ~n_b.isin(4, 6), F.format_string("type3 must have 4 or 6 boundaries, got %d", n_b)),
        F.when(F.col("_true").isNull(), F.concat(F.lit("source_id "), F.col("source_id"), F.lit(" not in any split"))).when(
            F.col("_true") != F.col("split"), F.concat(F.lit("split '"), F.col("split"), F.lit("' != source partition '"), F.col("_true"), F.lit("'"))
        ),
        F.when(~F.array_contains("_allowed", F.col("split")), F.concat(F.lit("generator "), F.col("generator"), F.lit(" ("), F.col("_role"), F.lit(") must not write to split '"), F.col("split"), F.lit("'"))),
    ]
    errors = F.when(F.size(missing) > 0, missing).otherwise(F.filter(F.array(*checks), lambda e: e.isNotNull()))
    return joined.select(*[records[f"`{c}`"] for c in records.columns], errors.alias("integrity_errors"))


def keep_first_valid(checked: DataFrame, order: list[str], key: str = "record_id") -> DataFrame:
    """The first record without errors of each key, by `order`; sorted by key within partitions.

    Records with errors don't count as seen, so a later valid one of the same key is kept.
    """
    from pyspark.sql import Window

    good = checked.where(F.size("integrity_errors") == 0)
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return good.withColumn("_rn", first).where(F.col("_rn") == 1).drop("_rn", "integrity_errors").orderBy(key)

"""Pages to source articles: filters with a reason for every drop, prose, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.config import Config
from seamline.functions import text as tx
from seamline.functions.chars import LINE_BREAK, SPACE, quoted
from seamline.functions.markup import stripped
from seamline.functions.segment import sentences

PAGE_REASONS = ("empty_raw", "main_page", "namespace", "redirect", "disambiguation", "stub", "list_page_title", "list_page_content")
PROSE_REASONS = ("too_few_chars", "too_few_words", "not_sinhala", "too_few_sentences")
REASONS = PAGE_REASONS + PROSE_REASONS


def reject_reason(title: Column, raw: Column, cfg: Config | None = None) -> Column:
    """The first reason for which a page is no article, or null."""
    c = (cfg or Config()).clean
    title, raw = tx.strip(F.coalesce(title, F.lit(""))), F.coalesce(raw, F.lit(""))
    lines = F.filter(F.split(raw, LINE_BREAK, -1), lambda x: ~x.rlike(f"^{SPACE}*$"))
    bullets = F.filter(lines, lambda x: x.rlike(f"^{SPACE}*[*#]"))
    crowded = (F.size(lines) > 0) & (F.size(bullets) / F.greatest(F.size(lines), F.lit(1)) > c.max_bullet_ratio)
    tests = (
        tx.strip(raw) == "",
        title.isin(*c.exact_titles),
        title.rlike("^(?:" + "|".join(map(quoted, c.prefixes)) + ")"),
        tx.any_of(F.substring(raw, 1, 200), c.redirect),
        tx.any_of(raw, c.disambiguation),
        tx.any_of(raw, c.stub),
        tx.any_of(title, c.list_title),
        crowded,
    )
    return F.coalesce(*[F.when(test, reason) for reason, test in zip(PAGE_REASONS, tests, strict=True)])


def prose_reason(prose: Column, n_sentences: Column, ratio: Column | None = None, cfg: Config | None = None) -> Column:
    """Why prose fails the gate, or null. `ratio` is the share of letters in the wanted script."""
    c = (cfg or Config()).clean
    tests = (
        F.length(prose) < c.min_chars,
        tx.word_count(prose) < c.min_words,
        (tx.sinhala_ratio(prose) if ratio is None else ratio) < c.min_script_ratio,
        n_sentences < c.min_sentences,
    )
    return F.coalesce(*[F.when(test, reason) for reason, test in zip(PROSE_REASONS, tests, strict=True)])


def classify(raw: DataFrame, cfg: Config | None = None, domain: str = "wikipedia", script=tx.sinhala_ratio) -> DataFrame:
    """Every page with its text, sentences and drop_reason (null: it is an article).

    Built-in filters come first; only pages that pass them go through Python.
    """
    cfg = cfg or Config()
    c = cfg.columns
    pages = raw.select(F.col(c.id).cast("string").alias("source_id"), F.col(c.title).alias("title"), F.col(c.url).alias("url"), F.col(c.text).alias("_raw"))
    judged = pages.withColumn("_why", reject_reason(F.col("title"), F.col("_raw"), cfg))
    # Rejected pages give the functions nulls, which cost them nothing.
    prose = judged.withColumn("_prose", stripped()(F.when(F.col("_why").isNull(), F.col("_raw")))).drop("_raw")
    kept = prose.withColumn("text", tx.drop_short_paragraphs(F.col("_prose"), cfg.clean.min_paragraph_chars))
    early = prose_reason(F.col("text"), F.lit(cfg.clean.min_sentences), script(F.col("text")), cfg)
    gated = kept.withColumn("_early", F.coalesce("_why", early))
    cut = gated.withColumn("sentences", sentences(cfg.segment)(F.when(F.col("_early").isNull(), F.col("text"))))
    few = F.when(F.size("sentences") < cfg.clean.min_sentences, F.lit(PROSE_REASONS[-1]))
    return cut.select(
        "source_id", "title", "url", F.lit(domain).alias("domain"), "text", "sentences",
        F.size("sentences").alias("n_sentences"), tx.word_count(F.col("text")).alias("n_words"), F.coalesce("_early", few).alias("drop_reason"),
    )


def sources(classified: DataFrame, limit: int | None = None) -> DataFrame:
    """The articles; with a limit, the first by id."""
    kept = classified.where(F.col("drop_reason").isNull()).drop("drop_reason")
    return kept if limit is None else kept.orderBy("source_id").limit(limit)


def waterfall(classified: DataFrame, reasons: tuple[str, ...] = REASONS, column: str = "drop_reason") -> DataFrame:
    """Per reason in order: how many pages it drops, their share of all, and how many remain after it."""
    counts = classified.groupBy(F.col(column).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    order = classified.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(r) for r in reasons])).alias("step", "reason"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    rows = order.join(counts, F.col("reason") == F.col("_r"), "left").join(F.broadcast(total)).withColumn("n", F.coalesce("_n", F.lit(0)).cast("long"))
    gone = F.sum("n").over(Window.orderBy("step"))
    share = F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("_total").cast("double")), F.lit(0.0))
    return rows.select("step", "reason", "n", share.alias("share"), (F.col("_total") - gone).cast("long").alias("remaining"))


def eligibility(rows: DataFrame, cfg: Config | None = None) -> DataFrame:
    """How many rows have enough sentences for each type of construction; one row."""
    cfg = cfg or Config()
    return rows.agg(*[F.count_if(F.col("n_sentences") >= c.min_sentences).alias(t) for t, c in cfg.constructions.items()])


def profile(raw: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """One row: rows, mean and extreme lengths, and the share of rows in which each pattern is found."""
    n = F.length(F.col(text))
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.col(text)).alias("n_texts"), F.avg(n).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"),
        *[F.avg(F.col(text).rlike(p).cast("double")).alias(f"hits_{k}") for k, p in patterns.items()],
    )


def top_prefixes(raw: DataFrame, title: str, n: int = 15) -> DataFrame:
    """The n most frequent name spaces (what stands before a title's first colon)."""
    space = F.regexp_extract(F.col(title), r"^([^:]{1,30}):", 1)
    return raw.where(space != "").groupBy(space.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(n)


def file_counts(raw: DataFrame) -> DataFrame:
    """(file, n): the rows of each file that a scan reads."""
    return raw.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))

"""Scalar text functions, all of built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions.chars import DIGIT, LATIN, LETTER, SINHALA, SPACE


def strip(c: Column) -> Column:
    """str.strip()."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def words(c: Column) -> Column:
    """str.split(): the words between white space."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    """How many words; 0 for null."""
    return F.coalesce(F.size(words(F.coalesce(c, F.lit("")))), F.lit(0))


def task_words(c: Column) -> Column:
    """str.split(' '): empty words are kept, and '' is one word."""
    return F.split(c, " ", -1)


def tokenless(word: Column) -> Column:
    """Whether a word is empty or white space."""
    return word.rlike(f"^{SPACE}*$")


def _count(c: Column, kind: str) -> Column:
    """How many characters are of a kind (a class without its brackets): what is left without the runs of others."""
    return F.length(F.regexp_replace(c, f"[^{kind}]+", ""))


def _share(c: Column, part: str) -> Column:
    return F.coalesce(F.try_divide(_count(c, part).cast("double"), _count(c, LETTER[1:-1]).cast("double")), F.lit(0.0))


def sinhala_ratio(c: Column) -> Column:
    """The share of letters in the Sinhala block; 0 without letters."""
    return _share(c, SINHALA)


def latin_ratio(c: Column) -> Column:
    """The share of letters that are A-Z or a-z; 0 without letters."""
    return _share(c, LATIN[1:-1])


def numeric_tokens(c: Column) -> Column:
    """Numbers in a text, without thousands separators and trailing points."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"({DIGIT}[{DIGIT},.٫٬]*)"), 1)
    plain = F.transform(found, lambda x: F.replace(F.regexp_replace(x, "[.,]+$", ""), F.lit(","), F.lit("")))
    return F.filter(plain, lambda x: x != "")


def word_ngrams(c: Column, n: int = 8) -> Column:
    """The set of runs of n lower-cased words, each joined by a space; none for shorter texts."""
    return F.transform(
        F.array(words(F.lower(F.coalesce(c, F.lit(""))))),
        lambda w: F.when(
            F.size(w) >= n,
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))),
        ).otherwise(F.array().cast("array<string>")),
    )[0]


def word_ngram_hashes(c: Column, n: int = 8) -> Column:
    """The set of 64-bit hashes of a text's runs of n lower-cased words."""
    return F.transform(
        F.array(words(F.lower(F.coalesce(c, F.lit(""))))),
        lambda w: F.when(
            F.size(w) >= n,
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )[0]


# Characters that carry no text, and quotes by their plain form.
INVISIBLE = "​‌⁠﻿­"
CURLY, STRAIGHT = "‘’‚‛“”„‟", "''''\"\"\"\""
FINAL_MARKS = ".?!෴…"


def normalize_surface(c: Column) -> Column:
    """A sentence without invisible characters, curly quotes or space before marks, ending in a mark."""
    plain = F.translate(c, CURLY + INVISIBLE, STRAIGHT)
    tight = rstrip(F.regexp_replace(plain, rf"{SPACE}+([.,?!:;])", "$1"))
    return F.when((tight == "") | tight.rlike(rf"[{FINAL_MARKS}]\z"), tight).otherwise(F.concat(tight, F.lit(".")))


def surface_features(c: Column) -> dict[str, Column]:
    """Predicates on a sentence's form."""
    return {
        "zero_width_non_joiner": c.contains("\u200c"),
        "curly_quote": c.rlike("[\u2018\u2019\u201c\u201d]"),
        "space_before_mark": c.rlike(rf"{SPACE}[.,?!:;]"),
        "no_final_mark": ~rstrip(c).rlike(rf"[{FINAL_MARKS}]\z"),
        "parenthesis": c.contains("("),
        "latin": c.rlike(LATIN),
    }


def clean_output(c: Column) -> Column:
    """A model's answer without fences, one layer of quotes and rules around it."""
    t = strip(F.coalesce(c, F.lit("")))
    t = strip(F.regexp_replace(t, rf"\A{SPACE}*```[a-zA-Z]*{SPACE}*\n?|\n?```{SPACE}*\z", ""))
    # The first kind of quote that is at both ends comes off, once.
    wrapped = F.length(t) > 2
    inner = strip(F.substring(t, F.lit(2), F.length(t) - 2))
    quotes = ("\"", "'", "“", "”", "«", "»")
    t = F.when(wrapped & F.substring(t, 1, 1).isin(*quotes) & (F.substring(t, 1, 1) == F.substring(t, -1, 1)), inner).otherwise(t)
    t = F.regexp_replace(t, rf"\A{SPACE}*-{{3,}}{SPACE}*\n", "")
    t = F.regexp_replace(t, rf"\n{SPACE}*-{{3,}}{SPACE}*\z", "")
    t = F.regexp_replace(t, "[ \t ]+", " ")
    return strip(F.regexp_replace(t, r"\n{2,}", "\n\n"))


def drop_short_paragraphs(c: Column, least: int = 60) -> Column:
    """The paragraphs (between blank lines) of at least that many characters."""
    parts = F.transform(F.split(c, "\n\n", -1), strip)
    return strip(F.array_join(F.filter(parts, lambda p: F.length(p) >= least), "\n\n"))


def truncate_at_sentence(c: Column, target: Column) -> Column:
    """The start of a text, up to the sentence whose end is nearest to target task words; the earliest of equals."""
    # The text with each break marked: a mark stands before the white space after a sentence.
    marked = F.regexp_replace(c, rf"(?<=[.!?])({SPACE}+)", "\u0000$1\u0000")

    def best(parts: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(2)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ""))
        gaps = F.transform(ends, lambda t, i: F.struct(F.abs(F.size(task_words(t)) - target).alias("gap"), i.alias("at"), t.alias("text")))
        return F.array_min(gaps)["text"]

    return rstrip(F.transform(F.array(F.split(marked, "\u0000", -1)), best)[0])


def any_of(c: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern is found."""
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(python_pattern(p))
    return out


def first_of(c: Column, patterns: Sequence[str]) -> Column:
    """The first pattern that is found, or null."""
    return F.coalesce(*[F.when(c.rlike(python_pattern(p)), F.lit(p)) for p in patterns])


def python_pattern(p: str) -> str:
    """A pattern of Python's re for Java, with white space and digits of all scripts."""
    out, inside = "", False
    i = 0
    while i < len(p):
        two = p[i : i + 2]
        if two in (r"\s", r"\d", r"\b"):
            body = {r"\s": r"\s\x{1c}-\x{1f}\x{85}\p{Z}", r"\d": r"\p{Nd}", r"\b": r"\b"}[two]
            out += body if inside or two == r"\b" else f"[{body}]"
            i += 2
            continue
        if p[i] == "\\":
            out += two
            i += 2
            continue
        inside = p[i] == "[" or inside and p[i] != "]"
        out += p[i]
        i += 1
    return f"(?u){out}" if "(?i)" in p else out

"""Sentences. One definition serves every operator that counts them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from seamline.config import Segment

#: Marks that may follow a terminator and still belong to its sentence.
CLOSERS = "\"'’”)]}»"
_PAIRS = (('"', '"'), ("“", "”"), ("‘", "’"))
_LETTER = re.compile(r"[^\W\d_]")


class Segmenter:
    """Cuts a text after terminators that end a token, and at line ends."""

    def __init__(self, rules: Segment | None = None):
        self.rules = rules = rules or Segment()
        marks = re.escape("".join(rules.terminators))
        self.end = re.compile(rf"[{marks}]|\n[\r\n]*")
        self.run = re.compile(rf"[{marks}{re.escape(CLOSERS)}]*")
        self.ends = tuple(rules.terminators)
        short = sorted(rules.abbreviations)
        self.whole = frozenset(short) | {a.replace(".", "") for a in short}
        self.dotted = tuple("." + a for a in short)

    def _quoted(self, text: str) -> list[tuple[int, int]]:
        """The spans inside quotes, of each kind that is balanced throughout."""
        spans = []
        for left, right in _PAIRS:
            if left == right:
                at = [m.start() for m in re.finditer(left, text)]
                opens, closes = at[::2], at[1::2]
            else:
                opens = [m.start() for m in re.finditer(left, text)]
                closes = [m.start() for m in re.finditer(right, text)]
            if len(opens) == len(closes):
                spans += [(a, b) for a, b in zip(opens, closes, strict=True) if a < b]
        return sorted(spans)

    def _guarded(self, text: str, at: int) -> bool:
        """Whether the full stop at a place is part of a number, an abbreviation or an ellipsis."""
        if text[at] != ".":
            return False
        after = text[at + 1 : at + 2]
        if after == "." or at and text[at - 1].isdigit() and after.isdigit():
            return True
        start = at
        while start and not text[start - 1].isspace():
            start -= 1
        token = text[start:at]
        return token in self.whole or token.endswith(self.dotted) or len(token) == 1 and token.isascii() and token.isalpha()

    def _pieces(self, text: str) -> Iterator[str]:
        spans, k, reach = self._quoted(text), 0, -1
        start = at = 0
        while m := self.end.search(text, at):
            i, at = m.start(), m.start() + 1
            if text[i] == "\n":
                yield text[start:i]
                start = at = m.end()
                continue
            while k < len(spans) and spans[k][0] < i:
                reach = max(reach, spans[k][1])
                k += 1
            if i < reach or self._guarded(text, i):
                continue
            stop = self.run.match(text, at).end()
            if stop == len(text) or text[stop].isspace():
                yield text[start:stop]
                start = at = stop
        yield text[start:]

    def _residue(self, piece: str) -> bool:
        """Not a sentence: no letter, or short without a terminator."""
        return not _LETTER.search(piece) or len(piece) < self.rules.min_chars and not piece.rstrip(CLOSERS).endswith(self.ends)

    def __call__(self, text: str | None) -> list[str]:
        out: list[str] = []
        for piece in filter(None, (p.strip() for p in self._pieces(text or ""))):
            if out and self._residue(piece):
                out[-1] += " " + piece
            else:
                out.append(piece)
        if len(out) > 1 and self._residue(out[0]):
            out[:2] = [f"{out[0]} {out[1]}"]
        return [" ".join(s.split()) for s in out]


def sentences(rules: Segment | None = None):
    """A vectorised function from text to its sentences; null and blank texts have none."""
    cut = Segmenter(rules)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(cut)

    return run


def segmented(c: Column, rules: Segment | None = None) -> Column:
    return sentences(rules)(c)


class SentenceRows:
    """The handler of a table function: (idx, sentence) of a text."""

    def eval(self, text: str):
        yield from enumerate(Segmenter()(text))


def register(spark: SparkSession) -> None:
    """Make `sentences(text)` and the table function `sentence_rows(text)` known to SQL."""
    spark.udf.register("sentences_of", sentences())
    spark.udtf.register("sentence_rows", F.udtf(SentenceRows, returnType="idx int, sentence string"))

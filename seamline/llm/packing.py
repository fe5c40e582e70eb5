"""Order-preserving packing of documents into training sequences.

Documents are tokenised and laid end to end in order of id. A dynamic program
then chooses where the stream is cut into windows. Windows may end after a
document, after a sentence, or, where neither is near, between tokens; each
kind of cut has a penalty, and so has each token of padding. The best window
before each cut comes from a monotone queue over the cuts within reach, so the
program takes constant time a cut.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seamline.llm.common import text_rows

#: Production parameters.
TOKENIZER = "word_bpe_49k.json"
END = 2
CAPACITY = 4096
#: In tokens of padding: a window of any kind, a cut after a sentence, a cut elsewhere in a document.
WINDOW_COST = 8
SENTENCE_CUT = 4
INNER_CUT = 48
#: A cut is possible at least every so many tokens.
REACH = 256
#: Besides full windows, those of these lengths need no padding either.
EXEMPT = (2048, 1024)
#: The program runs over so many tokens at a time; all windows but the last are then settled.
BLOCK = 1 << 18
#: Words whose tokens are remembered in a task.
REMEMBERED = 200_000


def _byte_characters() -> dict[int, str]:
    """The characters by which byte-level models write bytes: printable ones as themselves, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTES = _byte_characters()
#: Contractions, runs of letters, single digits and runs of anything else: the split of the tokenizer's own description.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-cased ASCII words, and what goes through all of the tokenizer: code points from
#: U+0250 on (none below composes with its neighbours), U+0130 (its lower case is two) and marks of special tokens.
_ASCII_SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
_ODD = re.compile("[\u0130\u0250-\U0010ffff]|<[|]").search


class Words(dict):
    """UTF-8 words without white space to their token ids, as little-endian bytes.

    White space separates tokens whatever stands around it, so a text's ids
    are those of its words in turn. A new word is split as the tokenizer
    would into pieces, which are words too, and only a new word of one piece
    goes through the merges; words with rarer characters or marks of special
    tokens go through all of the tokenizer. What was not met since the table
    was last full is forgotten when it is full again.
    """

    def __init__(self, tokenizer: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
        self.merges = self.tokenizer.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.plain = self._is_plain()
        self.split = regex.compile(_SPLIT).findall
        self.older: dict[bytes, bytes] = {}

    def _is_plain(self) -> bool:
        """Whether the tokenizer is of the form that the short way stands for."""
        t = json.loads(self.tokenizer.to_str())
        norm = [n.get("type") for n in (t["normalizer"] or {}).get("normalizers", [])]
        pre = (t["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (
            norm == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": _SPLIT}
            and not pre[1]["add_prefix_space"]
            and not pre[1]["use_regex"]
        )

    def _pieces(self, word: bytes) -> list[bytes] | None:
        """The word's pieces in lower case; None if it must go through all of the tokenizer."""
        if word.isalpha():
            return [word.lower()]
        if word.isascii():
            return None if b"<|" in word else _ASCII_SPLIT(word.lower())
        said = word.decode("utf-8", "replace")
        if _ODD(said):
            return None
        said = said.lower()
        return [said.encode()] if said.isalpha() else [p.encode() for p in self.split(said)]

    def _encoded(self, word: bytes) -> bytes:
        parts = self._pieces(word) if self.plain else None
        if parts is None:
            return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        if parts != [word]:
            return b"".join([self[p] for p in parts])
        written = word.decode() if word.isalnum() else word.decode("latin-1").translate(_BYTES)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merges(written)])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encoded(word)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: bytes, end: int = END) -> np.ndarray:
        return np.frombuffer(b"".join(chain(map(self.__getitem__, text.split()), (end.to_bytes(4, "little"),))), "<u4")

    def sentence_ends(self) -> np.ndarray:
        """Whether each id stands for marks that end a sentence and a word."""
        vocab = self.tokenizer.get_vocab()
        out = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            body = token.removesuffix("</w>")
            out[i] = token != body and body != "" and body[0] in ".!?" and not body.strip(".!?'\")")
        return out


def cuts(lengths: np.ndarray, sentence: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) of the possible cuts of a stream, its end included, in order.

    lengths: of the documents; sentence: the places after a sentence.
    """
    total = int(lengths.sum())
    kind = np.full(total + 1, -1, np.int32)
    kind[sentence] = SENTENCE_CUT
    ends = np.cumsum(lengths)
    kind[ends] = 0
    kind[0] = 0
    at = np.nonzero(kind >= 0)[0]
    gaps = np.diff(at)
    wide = np.nonzero(gaps > reach)[0]
    if len(wide):
        extra = np.concatenate([np.arange(at[i] + reach, at[i + 1], reach) for i in wide])
        kind[extra] = INNER_CUT
        at = np.nonzero(kind >= 0)[0]
    return at[1:], kind[at[1:]]


def plan(places: np.ndarray, penalties: np.ndarray, capacity: int = CAPACITY, last: bool | None = None) -> list[int]:
    """The ends of the windows that cost least, for cuts no further apart than capacity.

    A window costs WINDOW_COST, its padding to capacity (none at a length in
    EXEMPT), and the penalty of the cut at its end. If the stream ends here
    (last is True), its last window costs what tail() makes of it; if it goes
    on (False), that window is planned again and costs nothing.
    """
    s = [0, *places.tolist()]
    pen = [0, *penalties.tolist()]
    n = len(s)
    cost, back = [0] * n, [0] * n
    where = {0: 0}
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + place, cut), both rising
    exempt = [x for x in EXEMPT if x < capacity]
    for j in range(1, n):
        here = s[j]
        low = here - capacity
        while s[queue[0][1]] < low:
            queue.popleft()
        best, i = queue[0]
        best += capacity - here
        for x in exempt:
            k = where.get(here - x)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        if last is not None and j == n - 1:
            best, i = min((cost[k] + (tail_cost(here - s[k], capacity) if last else 0), k) for k in range(bisect_left(s, low), j))
        best += WINDOW_COST + pen[j]
        cost[j], back[j] = best, i
        where[here] = j
        key = best + here
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    out, j = [], n - 1
    while j:
        out.append(s[j])
        j = back[j]
    return out[::-1]


def tail(length: int, capacity: int = CAPACITY) -> list[int]:
    """Window lengths for what is left at the end: powers of two where they cost less than padding."""
    parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return parts if len(parts) > 1 and len(parts) * INNER_CUT < capacity - length else [length]


def tail_cost(length: int, capacity: int = CAPACITY) -> int:
    parts = tail(length, capacity)
    return len(parts) * INNER_CUT if len(parts) > 1 else capacity - length if length & (length - 1) else 0


class Packer:
    """Packs documents given in order; add() and close() return pieces.

    A piece: (document, start, length, crc32, document's tokens, window, offset, ids).
    """

    def __init__(self, ends: np.ndarray, capacity: int = CAPACITY, block: int = BLOCK):
        self.ends, self.capacity, self.block = ends, capacity, block
        self.docs: list[tuple[object, int, int, np.ndarray]] = []  # key, ids before, all ids, ids left
        self.held = self.window = 0

    def add(self, key: object, ids: np.ndarray) -> list[tuple]:
        self.docs.append((key, 0, len(ids), ids))
        self.held += len(ids)
        return self._settle(False) if self.held >= self.block else []

    def close(self) -> list[tuple]:
        return self._settle(True) if self.held else []

    def _settle(self, last: bool) -> list[tuple]:
        stream = np.concatenate([d[3] for d in self.docs])
        lengths = np.array([len(d[3]) for d in self.docs])
        ends = plan(*cuts(lengths, np.nonzero(self.ends[stream])[0] + 1, min(REACH, self.capacity)), self.capacity, last)
        if last:
            before = ends[-2] if len(ends) > 1 else 0
            ends[-1:] = (before + np.cumsum(tail(ends[-1] - before, self.capacity))).tolist()
        elif len(ends) > 1:
            ends.pop()
        out, d, doc_at, start = [], 0, 0, 0
        for end in ends:
            offset = 0
            while start < end:
                key, gone, whole, ids = self.docs[d]
                take = min(end, doc_at + len(ids)) - start
                piece = ids[start - doc_at : start - doc_at + take]
                out.append((key, gone + start - doc_at, take, zlib.crc32(piece.astype("<u4").tobytes()), whole, self.window, offset, piece))
                offset += take
                start += take
                if start == doc_at + len(ids):
                    doc_at += len(ids)
                    d += 1
            self.window += 1
        rest = self.docs[d:]
        if rest and start > doc_at:
            key, gone, whole, ids = rest[0]
            rest[0] = (key, gone + start - doc_at, whole, ids[start - doc_at :])
        self.docs, self.held = rest, int(len(stream) - start)
        return out


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a sequence, by input partition.

    doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens
    (its document's ids, `end` included), sequence_id, offset (its place in the
    sequence), and with with_ids also ids (array of int).

    Each partition of docs packs its own rows, in order of id and then text;
    nothing is shuffled, and a task holds about BLOCK tokens. A sequence id is
    the partition's number times 2**32 plus a count.

    Null and empty texts are the one id `end`. Texts of any length are cut at
    sentences, or anywhere where a sentence is too long. Repeated rows and null
    ids are packed like others. Other columns are left out. No rows: no rows.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizer)
        packer = Packer(words.sentence_ends(), capacity)
        base = TaskContext.get().partitionId() << 32

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            keys = pa.array([p[0] for p in pieces], id_type)
            ints = [pa.array([p[k] for p in pieces], pa.int64()) for k in (1, 2, 3, 4)]
            cols = [keys, *ints, pa.array([base + p[5] for p in pieces], pa.int64()), pa.array([p[6] for p in pieces], pa.int64())]
            if with_ids:
                cols.append(pa.array([p[7].astype(np.int32) for p in pieces], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, names=names)

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if pieces := packer.add(key, words.ids(t or b"", end)):
                    yield batch(pieces)
        if pieces := packer.close():
            yield batch(pieces)

    src = docs.select(docs[f"`{doc_id}`"].alias("_id"), docs[f"`{text}`"].cast("binary").alias("_text")).sortWithinPartitions("_id", "_text")
    fields = [T.StructField("doc_id", src.schema["_id"].dataType), *[T.StructField(c, T.LongType()) for c in names[1:7]]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return text_rows(src).mapInArrow(run, T.StructType(fields))

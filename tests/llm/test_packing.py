import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import DOCS, ODD, clashing, docs
from tokenizers import Tokenizer

from seamline.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_words_are_the_tokenizers(tokenizer):
    words, rng = packing.Words(packing.TOKENIZER), random.Random(1)
    assert words.plain
    letters = "aZéÀßſŸ'sStT'LL ll'd 12½²ªº.!?… \u0085\n\t<|endoftext|>İΣς中한́ë\x00\x1f\x7fǅ'rE"
    for k in range(1500):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + ("<|endoftext|>" if k % 9 == 0 else "")
        assert words.ids(s.encode()).tolist() == [*tokenizer.encode(s, add_special_tokens=False).ids, 2]


def cost(ends, penalties, capacity):
    total, at = 0, 0
    for e in ends:
        n = e - at
        total += packing.WINDOW_COST + penalties[e] + (0 if n in packing.EXEMPT and n < capacity else capacity - n)
        at = e
    return total


def test_plan_is_optimal():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([8, 16, 3000])
        places = sorted(rng.sample(range(1, 4 * capacity), 14))
        if max(b - a for a, b in zip([0, *places], places, strict=False)) > capacity:
            continue
        pen = {p: rng.choice([0, 4, 48]) for p in places}
        got = packing.plan(np.array(places), np.array([pen[p] for p in places]), capacity)
        best = {0: 0}
        for i, p in enumerate(places):
            best[p] = min(best[q] + cost([p - q], {p - q: pen[p]}, capacity) for q in [0, *places[:i]] if p - q <= capacity)
        assert got[-1] == places[-1] and all(b - a <= capacity for a, b in zip([0, *got], got, strict=False))
        assert cost(got, pen, capacity) == best[places[-1]]


def test_cuts_and_tail():
    at, kind = packing.cuts(np.array([3, 10]), np.array([2, 3, 7]), reach=4)
    assert list(zip(at.tolist(), kind.tolist(), strict=True)) == [(2, 4), (3, 0), (7, 4), (11, 48), (13, 0)]
    assert packing.tail(1234) == [1024, 128, 64, 16, 2] and packing.tail(4095) == [4095] and packing.tail(64) == [64]


def whole(rows, texts, tokenizer, capacity=4096):
    """Every id of every document lies in one piece, and sequences have no gaps; the share of padding."""
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    for i, all_of in texts.items():
        pieces = sorted(by.pop(i), key=lambda r: r["start"])
        if len(all_of) > 1:
            continue
        ids = np.array([*tokenizer.encode(all_of[0] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in pieces:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and ("ids" not in r or r["ids"] == part.tolist())
            at += r["length"]
        assert at == len(ids)
    assert not by
    used = padding = 0
    for pieces in seq.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        used += at
        padding += capacity - at if at & (at - 1) else 0
    return padding / max(1, used + padding)


def test_odd_rows(spark, tokenizer):
    d = clashing(docs(spark, ODD))
    texts = defaultdict(list)
    for i, t, *_ in ODD:
        texts[i].append(t)
    rows = packing.pack(d).collect()
    whole(rows, texts, tokenizer)
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 4)
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (1, 2, 3, 9)} == {1}
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_order_is_kept(spark):
    d = spark.range(400).selectExpr("399 - id AS doc_id", "repeat('word. ', cast(id % 50 AS int)) AS text").repartition(3)
    seen = defaultdict(list)
    for r in sorted(packing.pack(d, with_ids=False).collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        seen[r["sequence_id"] >> 32].append((r["doc_id"], r["start"]))
    assert len(seen) == 3 and all(v == sorted(v) for v in seen.values())


def test_small_blocks(spark, tokenizer, monkeypatch):
    words = packing.Words(packing.TOKENIZER)
    p = packing.Packer(words.sentence_ends(), 64, 300)
    rng, out, texts = random.Random(3), [], {}
    for i in range(200):
        texts[i] = [" ".join("tok" + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(0, 120)))]
        out += p.add(i, words.ids(texts[i][0].encode()))
    out += p.close()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    assert whole([dict(zip(names, r[:7], strict=True)) for r in out], texts, tokenizer, 64) < 0.25


def test_query(spark, sf, tokenizer):
    got = queries.op4_dp_packing(spark, sf)
    texts = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert whole([r.asDict() for r in got.collect()], texts, tokenizer) < 0.02

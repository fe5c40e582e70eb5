import hashlib
import random
import re
import struct

import xxhash
from fixtures import DOCS, ODD, clashing, docs
from pyspark.sql import functions as F

from seamline.llm import order_minhash as om
from seamline.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def h(*parts):
    seed = 42
    for x in parts:
        raw = x if isinstance(x, bytes) else struct.pack("<i" if isinstance(x, tuple) else "<q", x[0] if isinstance(x, tuple) else x)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute(text, width=5):
    """[(bin, 32 bits)] by the definition: number, deal to bins, select the two smallest, put back in order, hash."""
    w = [x.encode() for x in WORD.findall(text or "")]
    kmers = [(h(*w[i : i + width]), i) for i in range(len(w) - width + 1)] if len(w) > width else [(h(*w), 0)] if w else []
    seen, numbered = {}, []
    for k, i in sorted((k >> 26, i) for k, i in kmers):
        numbered.append((h(k, (seen.get(k, 0),)) >> 26, i))
        seen[k] = seen.get(k, 0) + 1
    bins = {}
    for x, i in sorted(numbered):
        bins.setdefault((x & (1 << 38) - 1) >> 33, []).append((x, i))
    return {b: h(*[x for x, _ in sorted(v[:2], key=lambda p: p[1])]) & 0xFFFFFFFF for b, v in bins.items()}


def like(a, b):
    return sum(a.get(k) == v for k, v in b.items()) / len(a.keys() | b.keys()) if a or b else 1.0


def read(fingerprint):
    return {int(fingerprint[i : i + 2], 16): int(fingerprint[i + 2 : i + 10], 16) for i in range(0, len(fingerprint), 10)}


def check(spark, rows):
    kind = "string" if any(isinstance(i, str) for i, _ in rows) else "long"
    got = om.edit_fingerprints(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
    assert len(got) == len(rows)
    # Rows that repeat an id are ordered by a hash of their texts; rows that repeat both are one document.
    place = lambda r: (r[0] is not None, r[0] or type(rows[0][0])(), h((r[1] or "").encode()))
    order = sorted({place(r): r for r in rows}.values(), key=place)
    at = {place(r): k for k, r in enumerate(order)}
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    want = []
    for i, text in rows:
        t, nxt = text or "", order[(at[place((i, text))] + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        a, b, c = brute(t), brute(edited), brute(nxt)
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), a, b, round(like(a, b), 9), round(like(a, c), 9)))
    rows = [(r["doc_id"], r["n_chars"], r["edited_sha256"], read(r["fingerprint"]), read(r["edited_fingerprint"]), round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(map(repr, ((*w[:3], sorted(w[3].items()), sorted(w[4].items()), *w[5:]) for w in want))) == sorted(map(repr, ((*w[:3], sorted(w[3].items()), sorted(w[4].items()), *w[5:]) for w in rows)))
    return by


def test_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "bb", "Ünï", "c" * rng.randint(1, 5), "日本"])
    rows = [(i * 7 % 101, rng.choice([" ", "\n", " \t"]).join(word() for _ in range(rng.choice([0, 1, 4, 5, 6, 40, 300])))) for i in range(60)]
    check(spark, rows)


def test_ranges_meet(spark):
    rng = random.Random(7)
    check(spark, [(rng.randrange(200) if k % 9 else None, f"t{k} " * rng.randint(0, 12)) for k in range(90)])
    check(spark, [(f"d{k * 37 % 101:03d}", f"t{k} " * rng.randint(0, 12)) for k in range(101)])
    ids = spark.range(6000).selectExpr("id as _k1", "id as _k2", "id as _th", "concat('d', lpad(id, 6, '0')) as _id", "1 as _half")
    assert {r["_k1"]: r["_to"]["_k1"] for r in om.previous(ids).collect()} == {k: (k - 1) % 6000 for k in range(6000)}


def test_order_matters(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    s = lambda w: om.signature(F.lit(" ".join(w)))
    r = spark.range(1).select(om.likeness(s(words), s(words)).alias("same"), om.likeness(s(words), s(moved)).alias("moved"), om.likeness(s(words), s(words[:399] + ["x"])).alias("edited"), om.likeness(s(["x"] * 50), s(["x"] * 400)).alias("longer")).first()
    assert r["same"] == 1 and r["moved"] < 0.75 and r["edited"] > 0.85 and r["longer"] < 0.5


def test_odd_rows(spark):
    rows = [(i, t) for i, t, *_ in ODD]
    by = check(spark, rows)
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] == "" and by[1][0]["near_next"] == 1 and len(by[4]) == 2
    assert om.edit_fingerprints(clashing(docs(spark, ODD))).count() == len(ODD)
    assert om.edit_fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    check(spark, [(5, "only one row here that is its own next")])


def test_plan_is_native(spark, sf):
    plan = queries.op8_order_minhash(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SinglePartition" not in plan


def test_texts_cross_once(spark, sf):
    got = queries.op8_order_minhash(spark, sf)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # One shuffle of texts with their signatures, read twice, and one of what is sent to the document before.
    assert plan.count("ReusedExchange") >= 1

import random
from collections import defaultdict

import numpy as np
import xxhash
from fixtures import DOCS, ODD, clashing, docs

from seamline.llm import queries, simhash
from seamline.llm.components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute_fingerprint(text, width=3):
    words = (text or "").encode().translate(LOWER).split()
    parts = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(items, linked):
    """The least member that each item reaches."""
    up = {i: i for i in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def variants(rng, n):
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice("klm")
        out.append((i, " ".join(words)))
    return out


def test_fingerprint_and_components(spark):
    rng = random.Random(5)
    rows = variants(rng, 150) + [(500, None), (501, ""), (502, " \n "), (503, "A B"), (504, "a b"), (505, "a b")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fp = {i: brute_fingerprint(t) for i, t in rows}
    assert all(got[i]["fingerprint"] == f"{f:016x}" for i, f in fp.items())
    ids = sorted(fp)
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {i: r["component_id"] for i, r in got.items()} == want and len(set(want.values())) < len(want)


def test_close_pairs_are_exact(spark):
    rng = random.Random(7)
    values = set()
    for _ in range(40):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    values |= {0, 1, 3, (1 << 64) - 1, (1 << 64) - 2}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for segments in (4, 8, 16):
        points = spark.createDataFrame([(v, 0, v) for v in signed], "_node long, _block int, _value long")
        got = [(r["_a"], r["_b"]) for r in simhash.close_pairs(points, 64, segments).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    one = simhash.close_pairs(points, 64, 16, 1).collect()
    assert {(r["_a"], r["_b"]) for r in one} == {(a, b) for a, b in want if ((a ^ b) & (1 << 64) - 1).bit_count() <= 1}


def test_links_of_a_close_group_are_few(spark):
    rng = random.Random(11)
    base = rng.getrandbits(62)
    values = {base ^ 1 << a ^ 1 << b for a in range(62) for b in range(62)} | {rng.getrandbits(62) for _ in range(50)}
    points = spark.createDataFrame([(v, 0, v) for v in values], "_node long, _block int, _value long")
    got = [(r["_a"], r["_b"]) for r in simhash.near_links(points, 64)[0].collect()]
    want = classes(sorted(values), [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    assert classes(sorted(values), got) == want and len(got) <= 2 * (2 * simhash.SEGMENTS + 1) * len(values)


def test_variants_of_one_text_are_no_square(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(1000):
        near = list(words)
        near[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(near), "en", "s"))
    d = spark.createDataFrame([(r[0], r[1]) for r in rows], "_id long, _text string")
    prints = simhash.set_prints(d, 5, 0.8, simhash.common_shingles(d, 5))
    tokens = prints.selectExpr("_id as _node", "_size", "posexplode(_prefix) as (_at, _token)")
    assert simhash.star_pairs(simhash._divided(tokens, ["_token"], "_node"), 0.8).count() < 20 * 1000
    assert [r["doc_id"] for r in simhash.keep_one_of_each(docs(spark, rows)).collect()] == [0]


def test_counts_bound_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 1000, np.uint64), rng.integers(0, 1 << 63, 1000, np.uint64)
    seg = lambda x: np.stack([np.bitwise_count((x >> np.uint64(4 * i)) & np.uint64(15)) for i in range(16)]).astype(int)
    assert (np.abs(seg(a) - seg(b)).sum(axis=0) <= np.bitwise_count(a ^ b)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys([*range(41), 200], 0), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_odd_rows(spark):
    got = simhash.near_duplicates(clashing(docs(spark, ODD))).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert {by[i][0]["component_id"] for i in (1, 2, 3, 9)} == {1} and by[1][0]["fingerprint"] == "0" * 16
    assert len(by[4]) == 2 and by[5][0]["component_id"] == 4 and by[None][0]["component_id"] is None
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def jaccard(a, b):
    p, q = (set(simhash.shingles((t or "").encode(), 5)) for t in (a, b))
    return len(p & q) / len(p | q) if p | q else 1.0


def test_stage_keeps_one_of_each(spark):
    rng = random.Random(9)
    rows = []
    for k in range(25):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 200))]
        rows.append((k * 10, " ".join(words), "en", "s"))
        near = list(words)
        near[rng.randrange(len(near))] = "other"
        rows.append((k * 10 + 1, " ".join(near), "en", "s"))
        rows.append((k * 10 + 2, " ".join(words).upper(), "en", "t"))
        far = words[: len(words) // 2] + [f"v{rng.randrange(4000)}" for _ in range(len(words) // 2)]
        rows.append((k * 10 + 3, " ".join(far), "en", "s"))
    d = docs(spark, rows)
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(d).collect()}
    text = {r[0]: r[1] for r in rows}
    want = classes(list(text), [(a, b) for a in text for b in text if a < b and jaccard(text[a], text[b]) >= 0.8])
    firsts = {i for i, c in want.items() if i == c}
    assert firsts <= kept, "a document without an earlier near duplicate goes"
    assert len(kept - firsts) <= 0.1 * (len(text) - len(firsts))


def test_stage_odd_rows(spark):
    d = clashing(docs(spark, ODD))
    got = simhash.keep_one_of_each(d)
    assert got.columns == d.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=str)
    assert ids == sorted([1, 4, 4, 6, None, 7, 8], key=str)
    assert simhash.keep_one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark, sf):
    got = queries.op7_simhash_components(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    for r in got.join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        assert r["fingerprint"] == f"{brute_fingerprint(r['text']):016x}"


def test_stage_finds_pairs_of_every_similarity(spark):
    rng = random.Random(3)
    rows, bands = [], defaultdict(int)
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 300))]
        near = list(words)
        # A passage at the end of one of the two, or words changed in it.
        if k % 2:
            near += [f"v{rng.randrange(10**6)}" for _ in range(int(len(words) * rng.uniform(0.01, 0.24)))]
        else:
            for _ in range(max(1, int(len(words) * rng.uniform(0, 0.022)))):
                near[rng.randrange(len(near))] = "other"
        j = jaccard(" ".join(words), " ".join(near))
        rows += [(2 * k, " ".join(words), "en", "s"), (2 * k + 1, " ".join(near), "en", "s")]
        bands[int(j * 20)] += j >= 0.8
    assert all(bands[b] >= 20 for b in (16, 17, 18))
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(docs(spark, rows)).collect()}
    text = {r[0]: r[1] for r in rows}
    assert kept == {i for i in text if i % 2 == 0 or jaccard(text[i - 1], text[i]) < 0.8}

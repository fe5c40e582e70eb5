import random
import re
from collections import defaultdict

import pytest
from fixtures import DOCS, ODD, clashing, docs
from pyspark.sql import functions as F

from seamline.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Share by weight; stop those above their most; share what is left again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        if not free:
            return stopped
        level = (total - sum(stopped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {**stopped, **{s: level * weight[s] for s in free}}
        stopped |= {s: 2 * sizes[s] for s in over}


def check(spark, rows, **options):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_counts(d).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((i, len(WORD.findall(t or ""))) for i, t, _ in rows if i is not None)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = brute_targets(sizes), defaultdict(int)
    source = defaultdict(set)
    for i, _, s in rows:
        source[i].add(s)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if len(source[r["doc_id"]]) == 1:
            (s,) = source[r["doc_id"]]
            assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
            taken[s] += r["taken"]
    return {s: (taken[s], want[s]) for s in sizes}, got


def test_targets_are_met(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        s = rng.choice(["a", "a", "a", "b", "c", "d", "é", "Z", None])
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 7, 50, 400]))), s))
    rows.append((999, "one", "tiny"))
    met, _ = check(spark, rows)
    assert all(abs(a - b) <= 0.5 + 1e-6 for a, b in met.values())


@pytest.mark.parametrize("n", [1, 2, 3, 100, 128, 129, 256, 1000])
def test_one_source(spark, n):
    met, _ = check(spark, [(1, "x " * n, "only")])
    assert abs(met["only"][0] - met["only"][1]) <= 0.5


def test_reruns_and_partitionings_agree(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 300), f"s{i % 5}") for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = sorted(map(tuple, mixing.mix_counts(d).collect()))
    assert sorted(map(tuple, mixing.mix_counts(d.repartition(7, "text")).collect())) == once


def test_permutation(spark):
    for n in (1, 2, 5, 64, 1000):
        p = mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(9)])
        df = spark.range(n).select("id", p.alias("p"))
        back = df.select("id", "p", mixing.permuted(F.col("p"), F.lit(n).cast("long"), [F.lit(9)], inverse=True).alias("q")).collect()
        assert sorted(r["p"] for r in back) == list(range(n)) and all(r["q"] == r["id"] for r in back)
    assert sum(r["p"] == r["id"] for r in back) < 20


def test_blocks_and_shards(spark):
    rows = [(i, "w " * (50 + i), f"s{i % 4}") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    b = mixing.mixed_blocks(d).collect()
    slots = defaultdict(list)
    for r in b:
        slots[r["shard"], r["place"]].append(r)
    assert all(sum(x["words"] for x in v) <= mixing.BLOCK for v in slots.values())
    assert len({(r["shard"], r["place"]) for r in b}) == len(slots) and max(p for _, p in slots) < mixing.SHARD_SLOTS
    counts = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(d).collect()}
    got = defaultdict(int)
    for r in b:
        got[r["doc_id"]] += r["words"]
    assert {i: n for i, n in counts.items() if n} == dict(got)


def test_shards_are_drawn(spark):
    wanted = [(1, 500), (2, 37), (5, 200), (9, 1)]
    got = defaultdict(dict)
    for r in mixing.draws(spark, wanted, 64).collect():
        got[r["_shard"]][r["_rank"]] = r["_count"]
    assert [sum(got[h].values()) for h in range(12)] == [64] * 11 + [34] and len({tuple(sorted(x.items())) for x in got.values()}) > 8
    drawn = {r: sum(x.get(r, 0) for x in got.values()) for r, _ in wanted}
    assert drawn != dict(wanted) and all(abs(drawn[r] - n) <= 4 * n**0.5 + 4 for r, n in wanted)
    assert all(x == mixing_draw for x, mixing_draw in zip(got.values(), ({r["_rank"]: r["_count"] for r in mixing.draws(spark, wanted, 64).where(f"_shard = {h}").collect()} for h in got), strict=True))
    rows = [(r, n * 10, n // 2 + 1, n, 0) for r, n in wanted]
    q = spark.createDataFrame(rows, "_rank long, _size long, _blocks long, _slots long, _trim long")
    made = mixing.slots(q, 10, 64).collect()
    by, count = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for r in made:
        by[r["_shard"]].append(r["_place"])
        count[r["_shard"]][r["_rank"]] += 1
    # A shard is filled place by place; its counts are its draw but for what moved to sources left short.
    assert all(sorted(p) == list(range(64 if h < 11 else 34)) for h, p in by.items()) and len(by) == 12
    assert {r: sum(c[r] for c in count.values()) for r, _ in wanted} == dict(wanted)
    moved = sum(max(0, drawn[r] - n) for r, n in wanted)
    assert sum(max(0, got[h].get(r, 0) - count[h][r]) for h in by for r, _ in wanted) == moved
    turns = defaultdict(list)
    for r in made:
        turns[r["_rank"], r["_round"]].append(r["_block"])
    assert all(len(set(b)) == len(b) for b in turns.values())


def test_documents(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(f"{i}-{k}" for k in range(rng.randint(0, 300))), "en", f"s{i % 4}") for i in range(120)]
    d = docs(spark, rows)
    text = {r[0]: r[1] for r in rows}
    counts = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(d).collect()}
    got = mixing.mix_documents(d)
    assert got.columns == d.columns
    out = got.collect()
    assert {r["doc_id"] for r in out} == {i for i, n in counts.items() if n}
    for r in out:
        assert len(WORD.findall(r["text"])) == counts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        assert all(line in text[r["doc_id"]].split("\n") for line in r["text"].split("\n"))


def test_cut_words():
    t = b" a  b\nc d "
    assert mixing.cut_words(t, [(0, 0, 4)]) == t
    assert mixing.cut_words(t, [(0, 0, 2), (0, 2, 2)]) == t
    assert mixing.cut_words(t, [(1, 3, 1), (0, 1, 2), (1, 0, 1)]) == b"b\nc\na\nd"


def test_odd_rows(spark):
    met, got = check(spark, [(i, t, s) for i, t, _, s in ODD])
    assert len(got) == len(ODD)
    d = clashing(docs(spark, ODD))
    out = mixing.mix_documents(d)
    assert out.columns == d.columns and {r["_h"] for r in out.collect()} == {"mine"}
    assert mixing.mix_counts(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mix_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert [r["taken"] for r in mixing.mix_counts(docs(spark, [(1, None, None, None), (2, " ", "x", "y")])).collect()] == [0, 0]


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sizes, taken, source = defaultdict(int), defaultdict(int), {i: s for i, _, s in rows}
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    for r in queries.op9_source_mixing(spark, sf).collect():
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in brute_targets(sizes).items())

from collections import Counter

import pytest
from fixtures import CLASHING, DOCS, ODD, clashing, docs

from seamline.llm import queries
from seamline.llm.sharding import SHARDS, TABLE_SIZE, assign_shards, is_prime, lookup_table, write_shards


def brute(shards, size):
    """The table by the definition: full preference lists, turns in order."""
    from seamline.llm.sharding import _word

    prefs = []
    for s in shards:
        at, step = _word(f"{s}#offset") % size, _word(f"{s}#skip") % (size - 1) + 1
        prefs.append([(at + j * step) % size for j in range(size)])
    slots = {}
    while len(slots) < size:
        for i, p in enumerate(prefs):
            if len(slots) < size:
                slots[next(x for x in p if x not in slots)] = i
    return [slots[k] for k in range(size)]


@pytest.mark.parametrize(("n", "size"), [(1, 2), (2, 7), (5, 101), (16, 251)])
def test_table(n, size):
    shards = [f"s{i}" for i in range(n)]
    assert lookup_table(shards, size) == brute(shards, size)


def test_balance_and_disruption():
    before = lookup_table(SHARDS, TABLE_SIZE)
    counts = Counter(before)
    assert max(counts.values()) - min(counts.values()) <= 1
    after = lookup_table(SHARDS[:-1], TABLE_SIZE)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != len(SHARDS) - 1)
    assert moved < 0.15 * TABLE_SIZE


def test_bad_parameters():
    assert is_prime(2039) and not is_prime(2041)
    for bad in (lambda: lookup_table(["a"], 8), lambda: lookup_table([], 7), lambda: lookup_table(["a", "a"], 7)):
        with pytest.raises(ValueError):
            bad()


def test_odd_rows(spark):
    d = clashing(docs(spark, ODD))
    out = assign_shards(d, ["doc_id"]).collect()
    assert len(out) == len(ODD)
    assert len({r["slot"] for r in out if r["doc_id"] == 4}) == 1
    assert {r["_id"] for r in out} == {"mine"} and out[0]["shard"] in SHARDS
    two = assign_shards(d, ["source", "lang"])
    assert set(CLASHING) <= set(two.columns) and two.count() == len(ODD)
    assert assign_shards(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0


def test_plan_is_native(spark, sf):
    plan = queries.op2_maglev_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Exchange hashpartitioning" not in plan


def test_written_shards(spark, tmp_path):
    d = spark.range(500).toDF("doc_id")
    write_shards(d, str(tmp_path / "out"), ["doc_id"], ["a", "b", "c"], 31, files=2)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 500 and {r["shard"] for r in got.select("shard").distinct().collect()} == {"a", "b", "c"}


def test_against_sql(spark, sf, same_rows):
    same_rows(queries.op2_maglev_sharding(spark, sf), queries.ORACLES["op2_maglev_sharding"])

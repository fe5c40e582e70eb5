import random
from collections import defaultdict

from fixtures import DOCS, ODD, clashing, docs

from seamline.llm import line_dedup, queries
from seamline.llm.line_dedup import LineRuns, dedup_lines, hashed_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, min_length=20, min_documents=3):
    """{(id, text): (kept, lines, dropped)}"""
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_length:
                holders[key(line)].add(i)
    keeper = {k: max((x for x in s if x is not None), default=None) for k, s in holders.items() if len(s) >= min_documents}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out[i, t] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def check(spark, rows, **options):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy", __import__("pyspark.sql.functions", fromlist=["col"]).col("text"))
    want = brute(rows, **{k: v for k, v in options.items() if k.startswith("min_")})
    got = dedup_lines(d, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["text"], r["n_lines"], r["n_dropped"]) == want[r["doc_id"], r["copy"]]


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "Éta", "ñu"]) for _ in range(n)) for n in (1, 2, 4, 5, 6, 7, 8) for _ in range(3)]
    rows = [(i, "\n".join(rng.choice([x, x.upper(), f"\t{x} ", x]) for x in rng.choices(pool, k=rng.randint(0, 9)))) for i in range(120)]
    check(spark, rows)
    check(spark, rows, batches=1)
    check(spark, rows, batches=7, fanout=3, min_length=5, min_documents=2)


def test_only_ascii_capitals_fold(spark):
    line = "ÉCOLE de la ville de paris"
    check(spark, [(1, line), (2, line.translate(LOWER)), (3, line.lower()), (4, line), (5, line.lower())])


def test_kelvin_sign_and_trim(spark):
    check(spark, [(i, t) for i, t in enumerate(["K" * 25, "k" * 25, "K" * 25, " " + "k" * 25, "k" * 25 + "\r"])])


def test_odd_rows(spark):
    d = clashing(docs(spark, ODD + [(20 + i, "a line that many documents share", "en", "s") for i in range(4)]))
    got = dedup_lines(d)
    assert got.columns == [c for c in d.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r)
    assert by[1][0]["text"] == "" and by[1][0]["n_lines"] == 1 and by[9][0]["n_lines"] == 5001
    assert len(by[4]) == 2 and by[23][0]["n_dropped"] == 0 and by[20][0]["text"] == "" and by[None][0]["_id"] == "mine"
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_tell_new_from_known(spark):
    runs = LineRuns(spark)
    lines = lambda rows: hashed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    a, b = "the first line of all of them", "the second line of all of them"
    runs.add(lines([(1, a), (2, a)]))
    assert runs.unseen(lines([(3, f"{a}\n{b}")])).count() == 1
    runs.add(lines([(3, f"{a}\n{b}")]))
    assert [len(x) for x in runs.levels] == [0, 1]
    runs.add(lines([(4, b)]))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert sorted((r["_n"], r["_keeper"]) for r in runs.counted().collect()) == [(2, 4), (3, 3)]
    held = [sorted(r["_n"] for r in spark.table(run).collect()) for run in runs.runs]
    assert sorted(held) == [[], [1, 2]], "a line that is known must not be in a second run"
    runs.clear()
    assert not spark.catalog.listTables()


def test_runs_are_read_in_order(spark):
    runs = LineRuns(spark)
    lines = lambda rows: hashed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    for b in range(3):
        runs.add(lines([(100 * b + i, f"a line of some length with number {i * (b + 1)}") for i in range(60)]))
    with line_dedup._in_order(spark):
        plan = runs.unseen(spark.table(runs.runs[0]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert len({(r["_h1"], r["_h2"]) for run in runs.runs for r in spark.table(run).collect()}) == sum(spark.table(run).count() for run in runs.runs)
    runs.clear()


def test_against_sql(spark, sf, same_rows):
    same_rows(queries.op5_line_dedup(spark, sf), queries.ORACLES["op5_line_dedup"])


def test_plan_is_native(spark, sf):
    assert "Python" not in queries.op5_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()

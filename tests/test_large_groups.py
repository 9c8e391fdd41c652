"""Groups larger than any bound that a query might be tempted to set, and values at the edge of a bucket."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestack.operators import cells, cluster, graph, upkeep


def test_cells_are_the_plain_join(spark):
    left = spark.createDataFrame([(i, i % 3 if i % 10 else None) for i in range(100)], "x int, v int")
    right = spark.createDataFrame([(i, i % 4) for i in range(60)] + [(7, 3), (99, None)], "y int, v int")
    want = sorted((r.v, r.x, r.y) for r in left.join(right, "v").collect())
    for rows in (1, 7, 1000):
        assert sorted((r.v, r.x, r.y) for r in cells.met(left, right, "v", rows).collect()) == want
    assert cells.met(left.limit(0), right, "v").count() == 0


def test_embellishing_follows_every_inverse_link(spark):
    n = 1100
    records = spark.range(n).select(F.concat(F.lit("c"), "id").alias("node"), F.when(F.col("id") < 2, "a").otherwise("b").alias("collection"))
    edges = records.select(F.col("node").alias("src"), F.lit("hub").alias("dst"), F.lit("home").alias("relation"))
    content = records.select("node", F.col("collection").alias("data"))
    out = upkeep.embellish_by_collection(records, edges, {"cards": content, "chips": content}, {"a": ["cards", "chips"]})
    assert {(r.root, r.level): r["count"] for r in out.groupBy("root", "level").count().collect()} == {(f"c{i}", level): k for i in range(2) for level, k in ((0, 1), (1, 1), (2, n - 1))}
    assert out.where("level = 2 and data is null").count() == 0
    bounded = graph.embellish(records.where("collection = 'a'"), edges, {"cards": content, "chips": content}, ["cards", "chips"], most=5)
    assert bounded.where("level = 2").groupBy("root").count().agg(F.max("count")).first()[0] <= 5


def test_embellishing_joins_links_and_not_pairs(spark, monkeypatch):
    n = 300
    records = spark.range(n).select(F.concat(F.lit("c"), "id").alias("node"))
    edges = records.select(F.col("node").alias("src"), F.lit("hub").alias("dst"), F.lit("home").alias("relation"))
    content = records.select("node", F.lit("x").alias("data"))
    monkeypatch.setattr(graph, "met", lambda *a, **more: cells.met(*a, rows=70, **more))
    out = graph.embellish(records, edges, {"cards": content, "chips": content}, ["cards", "chips"])
    assert {(r.root, r.node) for r in out.where("level = 2 and data = 'x'").collect()} == {(f"c{i}", f"c{j}") for i in range(n) for j in range(n) if i != j} and out.count() == n * (n + 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("LeftOuter") == 2  # levels 0 and 1 only


def test_embellishing_equals_a_walk_by_hand(spark):
    r = random.Random(5)
    names = [f"n{i}" for i in range(30)] + ["hub", None]
    for case, integral in enumerate(((), ("y",))):  # a closure of no edges: distinct roots
        links = {(r.choice(names), r.choice(names)) for _ in range(30)} | {(f"n{i}", "hub") for i in range(20)} | {("hub", None), ("n0", "n0")}
        content = [(x, d) for x in names[:20] for d in "uv"[: r.randint(1, 2)]] + [(None, "no")]  # some show two rows
        starts = [f"n{i}" for i in range(0, 30, 3)] + (["n3", None] if not case else [])
        tables = spark.createDataFrame([(s, d, "x") for s, d in links], "src string, dst string, relation string"), spark.createDataFrame(content, "node string, data string")
        start = spark.createDataFrame([(x,) for x in starts], "node string")
        want = [(x, x, 0) for x in (set(starts) - {None} if integral else starts)]
        for root in set(starts) - {None}:
            seen, frontier = {root}, {root}
            for level in (1, 2, 3):
                near = {d for x in frontier - {None} for s, d in links if s == x} | {s for x in frontier - {None} for s, d in links if d == x}
                frontier = {x for x in near if x is None or x not in seen}
                seen |= frontier
                want += [(root, x, level) for x in frontier]
        want = sorted(((root, x, level, d) for root, x, level in want for d in ([d for y, d in content if y == x and x is not None] or [None])), key=repr)
        out = graph.embellish(start, tables[0], {"a": tables[1], "b": tables[1], "c": tables[1]}, ["a", "b", "c"], integral=integral)
        assert sorted((tuple(x) for x in out.collect()), key=repr) == want


def test_distances_are_judged_by_the_difference_itself(spark, tmp_path):
    values = [i / 100 for i in range(0, 4000, 7)] + [i / 100 + 5 for i in range(0, 4000, 7)] + [-0.0, -3.2, -5.0, 1e17, 1e17, 1e300, -1e300, float("inf"), float("nan"), None]
    rows = [(i * 2 + k, u, kind, v) for i, v in enumerate(values) for k, kind in enumerate(("purchase", "error")) for u in (1,)] + [(-1, None, "purchase", 1.0), (-2, None, "error", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.l_id, r.r_id) for r in entry.queries()["interval_overlaps"](spark, str(tmp_path)).collect())
    sides = [[(i, v) for i, u, kind, v in rows if kind == side and u is not None and v is not None] for side in ("purchase", "error")]
    assert got == sorted((x, y) for x, a in sides[0] for y, b in sides[1] if abs(a - b) < 5)


def test_strategies_equal_every_pair(spark):
    r = random.Random(3)
    incoming, stored = ([(i % 40 if i % 9 else None, [r.choice([None, *range(12)]) for _ in range(i % 4)], r.choice([None, 0, 1, 2]), r.choice(["Work", "Agent", "Instance", None])) for i in range(50)] for _ in range(2))
    schema = "id int, a array<int>, b int, type string"
    for typed in (False, True):
        want = set()
        for key in {x[0] for x in incoming} - {None}:
            for rank, c in enumerate((1, 2)):
                found = [(y[0], x[3], y[3]) for x in incoming for y in stored if x[0] == key and y[0] not in (None, key) for v in (x[c] if c == 1 else [x[c]]) if v is not None and v in (y[c] if c == 1 else [y[c]])]
                if found:
                    want |= {(key, m, rank) for m, s, t in found if not typed or (s is not None and s == t) or "Instance" in (s, t)}
                    break
        got = [tuple(x) for x in cluster.duplicates_by_keys(spark.createDataFrame(incoming, schema), spark.createDataFrame(stored, schema), [("a", "a"), ("b", "b")], "id", "type" if typed else None).collect()]
        assert sorted(got) == sorted(want)


def test_strategies_make_no_pairs_that_do_not_count(spark, monkeypatch):
    written = []

    def counted(df, name="step", plain=cluster.materialise):
        out = plain(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(cluster, "materialise", counted)
    n = 300
    incoming, stored = (spark.range(n).select(F.concat(F.lit(p), "id").alias("k"), F.col("id").alias("b"), F.lit(1).alias("a")) for p in "cs")
    got = {tuple(r) for r in cluster.duplicates_by_keys(incoming, stored, [("b", "b"), ("a", "a")], "k").collect()}
    assert got == {(f"c{i}", f"s{i}", 0) for i in range(n)} and max(written) <= n

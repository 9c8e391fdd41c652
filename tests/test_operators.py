import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.operators import cluster, graph, search, shape, store
from lodestack.operators.components import connected_components
from lodestack.plans.catalog import FieldCatalog, Hierarchy


def components(pairs):
    out = {}
    for a, b in pairs:
        group = out.get(a, {a}) | out.get(b, {b})
        for x in group:
            out[x] = group
    return {k: min(v) for k, v in out.items()}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=30))
def test_components_match_union_find(spark, pairs):
    df = spark.createDataFrame(pairs, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {k: v for k, v in components(pairs).items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_components_of_a_path_and_of_nothing(spark):
    n = 64
    path = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)], "src long, dst long")
    assert {r["component"] for r in connected_components(path).collect()} == {0}
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "src long, dst long")).count() == 0


EDGES = [("a", "b", "x"), ("b", "c", "x"), ("c", "a", "y"), ("d", "b", "x"), ("e", "d", "z")]


def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, relation string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_closure_ends_in_cycles_and_keeps_least_depth(spark):
    got = {(r.root, r.node, r.depth) for r in graph.dependencies(edges(spark), nodes(spark, "a", "e")).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("e", "d", 1), ("e", "b", 2), ("e", "c", 3), ("e", "a", 4)}
    assert {r.node for r in graph.dependencies(edges(spark), nodes(spark, "a"), excluded=("y",)).collect()} == {"b", "c"}
    assert {r.node for r in graph.dependers(edges(spark), nodes(spark, "b"), max_depth=1).collect()} == {"a", "d"}
    assert graph.dependencies(edges(spark), nodes(spark, "zz")).count() == 0


def test_peel_leaves_cycles_for_last(spark):
    got = {r["node"]: r["round"] for r in graph.peel(edges(spark), nodes(spark, *"abcde")).collect()}
    assert got == {"e": 0, "d": 1, "a": -1, "b": -1, "c": -1}


def test_embellish_visits_once(spark):
    content = spark.createDataFrame([(n, n.upper()) for n in "abcde"], "node string, data string")
    got = {(r.root, r.node, r.level) for r in graph.embellish(nodes(spark, "a"), edges(spark), {"cards": content, "chips": content}, ["cards", "chips"], integral=("x",)).collect()}
    assert got == {("a", "a", 0), ("a", "b", 0), ("a", "c", 0), ("a", "d", 1), ("a", "e", 2)}


def test_links(spark):
    links = spark.createDataFrame([(1, "old"), (2, "new")], "id int, iri string")
    known = spark.createDataFrame([("old", "new")], "alias string, main string")
    assert {(r.id, r.iri) for r in graph.replace_aliases(links, known).collect()} == {(1, "new"), (2, "new")}
    words = spark.createDataFrame([("Bok", "b"), ("kort", "k1"), ("Kort", "k2")], "label string, id string")
    got = graph.link_by_label(spark.createDataFrame([(1, " bok. "), (2, "kort"), (3, None)], "n int, text string"), "text", words)
    assert {(r.n, r.linked) for r in got.collect()} == {(1, "b"), (2, None), (3, None)}


def test_duplicate_strategies_stop_at_the_first(spark):
    inc = spark.createDataFrame([(1, ["i1"], "s1", "Instance"), (2, ["i9"], "s2", "Work")], "id int, isbn array<string>, issn string, type string")
    old = spark.createDataFrame([(10, ["i1", "i2"], "s9", "Work"), (11, ["i7"], "s1", "Work"), (12, ["i8"], "s2", "Agent")], "id int, isbn array<string>, issn string, type string")
    got = cluster.duplicates_by_keys(inc, old, [("isbn", "isbn"), ("issn", "issn")], "id", "type")
    assert {(r.key, r.match, r.strategy) for r in got.collect()} == {(1, 10, 0)}


def test_greedy_partition_needs_all_members(spark):
    df = spark.createDataFrame([("b", i, v) for i, v in enumerate(["1", "2", "3", "9"])], "block string, id int, v string")
    near = lambda a, b: abs(int(a) - int(b)) <= 1
    assert {r["id"]: r["cluster"] for r in cluster.greedy_partition(df, "block", "id", "v", near).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_as_of_join_and_upsert(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    left = spark.createDataFrame([(1, t[2]), (1, t[0]), (2, t[4])], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, t[1], 1, "a"), (1, t[2], 2, "b"), (1, t[2], 3, "c"), (2, None, 4, "d")], "k int, rt timestamp_ntz, n int, v string")
    got = {(r.k, r.t, r.asof_v) for r in store.as_of_join(left, right, "k", "t", "rt", "n", ["v"]).collect()}
    assert got == {(1, t[2], "c"), (1, t[0], None), (2, t[4], "d")}
    cur = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "x"), (4, "y")], "k int, v string")
    assert {(r.k, r.v, r.action) for r in store.upsert(cur, new, "k", ["v"]).collect()} == {(1, "a", "keep"), (2, None, "same"), (3, "x", "update"), (4, "y", "create")}


def test_eviction_archive_and_deltas(spark):
    cache = spark.createDataFrame([(1, [1, 5]), (2, [6]), (3, [])], "id int, ids array<int>")
    assert [r.id for r in store.evict(cache, "ids", spark.createDataFrame([(5,), (3,)], "id int"), "id").collect()] == [2]
    a = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "s int, d int")
    b = spark.createDataFrame([(1, 3), (1, 4)], "s int, d int")
    assert {tuple(r) for r in store.link_delta(a, b).collect()} == {(1, 2, "removed"), (1, 4, "added")}


def test_page_links():
    assert search.page_links(45, 20, 20) == {"first": 0, "previous": 0, "next": 40, "last": 40}
    assert search.page_links(0, 20, 0)["next"] is None
    assert search.suggest_query("abc de x", 5) == "abc (de* OR de) x"


def test_missing_values_sort_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id int, v int")
    catalog = FieldCatalog.of(df)
    for spec, order in (("v", [2, 3, 1]), ("-v", [3, 2, 1])):
        assert [r.id for r in search.page_of(df, search.sort_columns([spec], catalog, "id")).collect()] == order


def test_lenses_inherit_and_fall_back(spark):
    types = Hierarchy({"A": (), "B": ("A",)})
    lenses = shape.Lenses({"chips": {"A": {"show": ["x", {"alternatives": ["z", "y"]}]}}, "cards": {"B": {"show": ["missing"]}}}, types)
    df = spark.createDataFrame([(1, "p", None, "q")], "id int, x string, y string, z string")
    assert lenses.apply(df, "cards", "B", "id").first()["lens"].asDict() == {"x": "p", "z": "q"}
    loop = shape.Lenses({"chips": {"A": {"extends": "A"}}}, types)
    with pytest.raises(ValueError, match="itself"):
        loop.properties("chips", "A")


def test_frame_and_flatten():
    graph_ = {"r": {"@id": "r", "m": {"@id": "t"}}, "t": {"@id": "t", "of": {"@id": "r"}, "x": [{"@id": "u"}]}, "u": {"@id": "u", "n": 1}}
    tree = shape.frame(graph_, "r")
    assert tree == {"@id": "r", "m": {"@id": "t", "of": {"@id": "r"}, "x": [{"@id": "u", "n": 1}]}}
    assert {i["@id"] for i in shape.flatten(tree)} == {"r", "t", "u"} and shape.flatten(tree)[-1]["@id"] == "r"


def test_plans_push_filters_and_prune_columns(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 7).alias("n"), F.lit("x").alias("wide")).write.parquet(str(tmp_path / "t"))
    from lodestack.sources.records import read_table

    plan = read_table(spark, str(tmp_path / "t"), "n > 3", ["id"])._jdf.queryExecution().toString()
    assert "GreaterThan(n,3)" in plan and "wide" not in plan.split("ReadSchema")[1].split("\n")[0]

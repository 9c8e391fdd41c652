import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestack.__main__ import main
from lodestack.functions import jsonld, text, uris
from lodestack.functions.jsontree import REMOVE, json_udf, rewrite, KEEP
from lodestack.operators import cluster, graph, search, stats, store, upkeep
from lodestack.plans import paths
from lodestack.plans.catalog import FieldCatalog, Labels
from lodestack.scratch import shared_dir
from lodestack.sources import marc, rdf


def test_schedules():
    at = dt.datetime(2024, 1, 10, 6, 30)  # a Wednesday
    assert [upkeep.due(s, at) for s in ("30 6 * * *", "*/15 * * * 1-5", "30 6 11 * *", "0,30 5-7 * 1 3", "* * * * 0")] == [True, True, False, True, False]
    ran = []

    def fail():
        raise ValueError("no")

    assert upkeep.run_due([("a", "* * * * *", fail), ("b", "30 * * * *", lambda: ran.append(1)), ("c", "31 * * * *", fail)], at) == ["a: no", "b: done"] and ran == [1]


def test_queue_and_deletes_with_nulls_and_repeats(spark):
    queue = spark.createDataFrame([("a", 1, 0, "NEW"), ("b", 2, 2, "NEW"), ("c", None, 0, "NEW"), ("d", 1, 0, "FAILED"), ("a", 0, 0, "REQUEUED")], "k string, t int, failures int, state string")
    assert [tuple(r) for r in upkeep.queue_take(queue, "k", "t", 9).collect()] == [("c", None), ("a", 0), ("b", 2)]
    results = spark.createDataFrame([("a", "HANDLED"), ("b", "FAIL_REQUEUE"), ("c", "FAIL_RETRY")], "k string, outcome string")
    assert {(r.k, r.failures, r.state) for r in upkeep.queue_settle(queue, results, "k").collect()} == {("b", 3, "FAILED"), ("c", 0, "NEW"), ("d", 0, "FAILED")}
    records = spark.createDataFrame([(1, None), (2, True), (None, False)], "id int, deleted boolean")
    edges = spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")
    kept, left = upkeep.soft_delete(records, edges, records.where("id = 1"), "id")
    assert {(r.id, r.deleted) for r in kept.collect()} == {(1, True), (2, True), (None, False)} and [tuple(r) for r in left.collect()] == [(2, 1)]


def test_interval_join_equals_every_pair(spark):
    spans = [(i, i * 7 % 50 / 2.0, i * 7 % 50 / 2.0 + i % 9) for i in range(60)] + [(99, None, 1.0), (98, 3.0, None)]
    left = spark.createDataFrame(spans, "x int, a double, b double")
    right = spark.createDataFrame(spans, "y int, c double, d double")
    got = sorted((r.x, r.y) for r in upkeep.overlaps(left, right, ("a", "b"), ("c", "d"), 4).collect())
    want = sorted((x, y) for x, a, b in spans for y, c, d in spans if None not in (a, b, c, d) and a < b and c < d and a < d and c < b)
    assert got == want
    assert upkeep.overlaps(left.limit(0), right, ("a", "b"), ("c", "d"), 4).count() == 0


def test_paths():
    assert paths.goes_back(("p", "@reverse.p")) and not paths.goes_back(("p", "q"))
    assert paths.alternatives(("instanceOf", "title"), ("instanceOf",)) == [("instanceOf", "title"), ("instanceOf", "instanceOf", "title")]
    assert paths.alternatives(("title",), ("instanceOf",)) == [("title",), ("instanceOf", "title"), ("@reverse.instanceOf", "title")]


def test_nested_stem(spark):
    schema = spark.createDataFrame([], "a struct<b: array<struct<c: int, d: struct<e: string>>>>, f int").schema
    assert [paths.nested_stem(p, schema) for p in (("a", "b", "c"), ("f",), ("x", "y"))] == [2, 0, 0]
    assert paths.field_at("n", ("a", "b", "d", "e"), schema).path == "d.e" and paths.field_at("n", ("a", "z"), schema) is None


def test_labels_are_looked_up_only_if_they_name_one_term():
    labels = Labels([("Red", "r"), ("red", "r2"), ("blue", "b")])
    catalog = FieldCatalog([], labels={"colour": labels})
    from lodestack.plans.catalog import Field

    f = Field("colour", "colour")
    assert [catalog.term(f, v) for v in ("BLUE", "red", "green")] == ["b", "red", "green"]


def test_greedy_blocks_are_the_same_in_parts(spark):
    rows = [(i, "b", " ".join(w for j, w in enumerate("ox cow hen cat dog".split()) if (i * 13 + j * 7) % 5 < 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, block string, v string")

    def match(a, b):
        return bool(set(a.split()) & set(b.split()))

    whole = {(r.k, r.cluster) for r in cluster.greedy_partition(df, "block", "k", "v", match).collect()}
    parts = {(r.k, r.cluster) for r in cluster.greedy_partition(df, "block", "k", "v", match, F.split("v", " ")).collect()}
    clusters: list[list] = []
    for k, _, v in rows:
        home = next((c for c in clusters if all(match(v, o) for _, o in c)), None)
        if home is None:
            clusters.append([(k, v)])
        else:
            home.append((k, v))
    assert whole == parts == {(k, c[0][0]) for c in clusters for k, _ in c}


def test_quantiles_are_exact(spark):
    df = spark.createDataFrame([(i % 3, float(i * i % 101)) for i in range(200)] + [(0, None), (7, 5.0)], "g int, v double")
    want = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.95).alias("b")).collect()}
    got = {r.g: (r.p50, r.p95) for r in stats.quantiles(df, "g", "v", (0.5, 0.95)).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_documents_there_and_back():
    record = {"leader": "00000nam a2200000 a 4500", "fields": [{"001": "x<1>"}, {"245": {"ind1": "1", "ind2": " ", "subfields": [{"a": "A & b"}, {"c": ""}]}}]}
    assert marc.from_xml(f'<m:collection xmlns:m="http://m">{marc.to_xml(record).replace("<record", "<m:record").replace("</record", "</m:record")}</m:collection>'.replace("<leader", "<m:leader").replace("</leader", "</m:leader")) [0]["fields"] == record["fields"]
    rows = list(rdf.parse_trig('@prefix e: <http://e/> .\ne:a e:p "in {braces}" .\nGRAPH e:g { e:a e:p e:b ; e:q "x}y" }\n{ e:c e:p 1 . }'))
    assert {(r[0], r[2], r[6]) for r in rows} == {("http://e/a", "in {braces}", None), ("http://e/a", "http://e/b", "http://e/g"), ("http://e/a", "x}y", "http://e/g"), ("http://e/c", "1", None)}
    context = jsonld.Context({"@vocab": "http://v/"})
    nodes = jsonld.from_statements(list(jsonld.statements(jsonld.expand({"@id": "http://e/a", "n": 3, "t": ["x", "y"], "part": {"@id": "http://e/b", "n": True}}, context))))
    assert nodes == jsonld.flatten_graph([nodes[0]]) + [nodes[1]] or {n["@id"] for n in nodes} == {"http://e/a", "http://e/b"}


def test_marks_stay_themselves_in_tasks(spark):
    df = spark.createDataFrame([('{"a": {"x": 1}, "b": 2}',), (None,), ("no json",)], "data string")
    cut = json_udf(lambda r: rewrite(r, lambda path, node: REMOVE if path and path[-1] == "a" else KEEP))
    assert [r[0] for r in df.select(cut("data")).collect()] == ['{"b": 2}', None, None]


def test_change_rules_on_names():
    assert text.differs("Åsa Öberg", "asa oberg") is False and text.differs("A", None) and not text.differs(None, None) and text.differs("abc", "xyz")
    assert text.life_span_differs("1900-1980", "1900-") and not text.life_span_differs("1900-", "1900-1980") and not text.life_span_differs("1900", "1901")


def test_small_things(spark, capsys):
    assert uris.find_url("http://e", {"q": ["a b", "c&d"], "x": "ö"}) == "http://e?q=a%20b&q=c%26d&x=%C3%B6" and uris.quote_value('a "b"') == '"a \\"b\\""'
    edges = spark.createDataFrame([(f"s{i}", "d", "r") for i in range(50)] + [(None, "d", "r")], "src string, dst string, relation string")
    assert graph.inverse_links(edges, spark.createDataFrame([("d",), (None,)], "node string"), most=3).where("source is not null").count() <= 3
    assert search.merged_targets([("a", edges.limit(0).select("src", "dst"))], "src").count() == 0
    assert store.holding_of(edges, edges.limit(0), "src", "dst").count() == 0
    assert main(["list"]) == 0 and "flagship_search" in capsys.readouterr().out and main(["nothing"]) == 2


def test_a_cluster_without_shared_storage_is_an_error():
    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        shared_dir(Session)

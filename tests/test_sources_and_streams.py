import json

from pyspark.sql import functions as F

from lodestack.sources import marc, rdf, records, sinks
from lodestack.streaming import feeds

QUADS = '<http://a> <http://p> "x \\"y\\"\\n"@en <http://g> .\n_:b <http://p> <http://a> .\n# note\n<http://a> <http://q> "3"^^<http://int> .\nbroken\n'


def test_nquads_round_trip(spark, tmp_path):
    (tmp_path / "q.nq").write_text(QUADS)
    df = rdf.read_nquads(spark, str(tmp_path / "q.nq"))
    rows = {(r.s, r.p, r.o, r.o_type, r.datatype, r.lang, r.g) for r in df.collect()}
    assert rows == {("http://a", "http://p", 'x "y"\n', "literal", None, "en", "http://g"), ("_:b", "http://p", "http://a", "iri", None, None, None), ("http://a", "http://q", "3", "literal", "http://int", None, None)}
    sinks.write_lines(rdf.nquad_lines(df), "value", str(tmp_path / "out"))
    assert {tuple(r) for r in rdf.read_nquads(spark, str(tmp_path / "out")).collect()} == rows


def test_turtle():
    text = '@prefix a: <http://x/> .\na:s a a:T ; a:p "hi"@en, 3 ; a:q [ a:r (a:1) ] .'
    rows = list(rdf.parse_turtle(text))
    assert ("http://x/s", "http://x/p", "3", "literal", "http://www.w3.org/2001/XMLSchema#integer", None) in rows
    assert len(rows) == 7


def test_pattern(spark):
    q = spark.createDataFrame([("a", "knows", "b"), ("b", "knows", "c"), ("c", "type", "T")], "s string, p string, o string")
    got = rdf.select_pattern(q, [("?x", "knows", "?y"), ("?y", "knows", "?z"), ("?z", "type", "T")])
    assert [(r.x, r.y, r.z) for r in got.collect()] == [("a", "b", "c")]


def test_marc(spark, tmp_path):
    record = {"leader": "00000nam a2200000 a 4500", "fields": [{"001": "id1"}, {"245": {"ind1": "1", "ind2": "0", "subfields": [{"a": "Tïtle"}, {"b": "sub"}]}}]}
    data = marc.format_iso2709(record)
    assert marc.parse_iso2709(data)["fields"] == record["fields"]
    (tmp_path / "m.mrc").write_bytes(data + data + b"junk\x1d")
    df = marc.read_iso2709(spark, str(tmp_path / "m.mrc"))
    assert [r.marc is not None for r in df.orderBy("position").collect()] == [True, True, False]
    assert {(r.tag, r.code, r.n) for r in marc.usage(df).collect()} == {("001", "", 2), ("245", "a", 2), ("245", "b", 2)}
    assert '<subfield code="a">Tïtle</subfield>' in marc.to_xml(record)


def test_records(spark, tmp_path):
    doc = {"@graph": [{"@id": "r1", "controlNumber": "7", "sameAs": [{"@id": "old"}]}, {"@id": "t1", "@type": "Instance", "heldBy": {"@id": "lib"}}]}
    (tmp_path / "d.jsonl").write_text(json.dumps(doc) + "\n\n")
    df = records.promote(records.read_json_lines(spark, str(tmp_path / "d.jsonl")))
    r = df.first()
    assert (df.count(), r.record_id, r.thing_id, r.type, r.held_by, r.control_number) == (1, "r1", "t1", "Instance", "lib", "7")
    assert {(x.iri, x.graph_index, x.main_id) for x in records.identifiers(df).collect()} == {("r1", 0, True), ("old", 0, False), ("t1", 1, True)}


def test_clusters_and_ids(spark, tmp_path):
    (tmp_path / "c").write_text("b a\n\n  c\n")
    assert {tuple(r) for r in records.read_clusters(spark, str(tmp_path / "c")).collect()} == {("a", "a"), ("a", "b"), ("c", "c")}
    assert records.read_id_list(spark, str(tmp_path / "c")).count() == 2


def test_chunked_sink(spark, tmp_path):
    index = sinks.write_chunks(spark.range(25), ["id"], 10, str(tmp_path / "chunks"))
    assert sorted((r["chunk"], r["n"], r["first"], r["last"]) for r in index.collect()) == [(0, 10, 0, 9), (1, 10, 10, 19), (2, 5, 20, 24)]


def test_streams_agree_with_batch(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    for i in range(2):
        df.where(f"v % 2 = {i}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = feeds.read_stream(spark, str(tmp_path / "in" / "*"), df.schema)
    counted = feeds.drain(feeds.counter_stream(stream, ["k"], F.col("v")), "counted", "complete")
    assert {(r.k, r.n) for r in counted.collect()} == {(r.k, r.n) for r in df.groupBy("k").agg(F.sum("v").alias("n")).collect()}
    out = str(tmp_path / "out")
    feeds.drain(stream, "upserted", batch=feeds.upsert_batches(out, "k", ["v"]))
    assert {(r.k, r.v) for r in spark.read.parquet(out).groupBy("k").agg(F.max("v").alias("v")).collect()} == {(0, 39), (1, 37), (2, 38)}


def test_page_with_ties(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(10)], "id int, t int")
    assert {r.id for r in feeds.page_with_ties(df, "t", 2, 2).collect()} == {6, 7, 8}
    assert feeds.page_with_ties(df.limit(0), "t", None, 2).count() == 0

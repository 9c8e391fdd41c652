from pyspark.sql import functions as F

from lodestack.operators import graph, shape
from lodestack.plans.catalog import Hierarchy, Labels
from lodestack.sources import marcframe, rdf

RULES = [
    {"tag": "000", "about": "record", "columns": {"encodingLevel": (17, 18)}},
    {"tag": "001", "property": "controlNumber", "about": "record"},
    {"tag": "008", "columns": {"language": (35, 38)}},
    {"tag": "245", "link": "hasTitle", "type": "Title", "subfields": {"a": "mainTitle", "b": "subtitle"}, "indicators": {"ind1": "added"}, "repeatable": True},
    {"tag": "020", "link": "identifiedBy", "type": "ISBN", "subfields": {"a": "value"}, "repeatable": True},
]
MARC = {"leader": " " * 17 + "5" + " " * 6, "fields": [{"001": "x1"}, {"008": " " * 35 + "swe  "}, {"020": {"ind1": " ", "ind2": " ", "subfields": [{"a": "91"}, {"q": "inb."}]}}, {"245": {"ind1": "1", "ind2": " ", "subfields": [{"a": "T"}, {"b": "s"}]}}, {"999": {"ind1": " ", "ind2": " ", "subfields": [{"z": "?"}]}}]}


def test_marc_rules_convert_and_revert(spark):
    frame = marcframe.MarcFrame(RULES)
    data = frame.convert(MARC)
    assert data["thing"]["hasTitle"] == [{"@type": "Title", "mainTitle": "T", "subtitle": "s", "added": "1"}]
    assert (data["record"]["controlNumber"], data["record"]["encodingLevel"], data["thing"]["language"]) == ("x1", "5", "swe")
    assert frame.revert(data) == MARC
    import json

    df = spark.createDataFrame([(1, json.dumps(MARC)), (2, None)], "id int, marc string")
    assert {r.id: r.data is None for r in marcframe.convert_column(df, "id", "marc", frame).collect()} == {1: False, 2: True}


def test_merged_export():
    bib = {"leader": "", "fields": [{"100": {"ind1": "1", "ind2": " ", "subfields": [{"a": "old"}, {"0": "auth1"}]}}]}
    auth = {"auth1": {"leader": "", "fields": [{"100": {"ind1": "1", "ind2": " ", "subfields": [{"a": "New"}, {"d": "1900-"}]}}]}}
    hold = {"leader": "", "fields": [{"852": {"ind1": " ", "ind2": " ", "subfields": [{"b": "L"}]}}, {"001": "h"}]}
    out = marcframe.merge_export(bib, [hold], auth)
    assert out["fields"][0]["100"]["subfields"] == [{"a": "New"}, {"d": "1900-"}, {"0": "auth1"}] and "852" in out["fields"][1] and len(out["fields"]) == 2


def test_serialisers_read_back():
    rows = [("http://x/a", "http://x/p", 'q"\n', "literal", None, "en"), ("http://x/a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://x/T", "iri", None, None), ("_:b", "http://x/p", "3", "literal", "http://x/int", None)]
    assert sorted(rdf.parse_turtle(rdf.turtle(rows, {"x": "http://x/"})), key=str) == sorted(rows, key=str)
    assert "<http://g> {" in rdf.trig({"http://g": rows}, {"x": "http://x/"})
    import xml.dom.minidom

    assert len(xml.dom.minidom.parseString(rdf.rdf_xml(rows)).getElementsByTagName("rdf:Description")) == 3


def test_dependency_export_needs_a_visible_change(spark):
    edges = spark.createDataFrame([("b1", "a1", "r"), ("b2", "a2", "r"), ("b3", "a1", "r")], "src string, dst string, relation string")
    changed = spark.createDataFrame([("a1", "x", "y"), ("a2", "x", "x")], "node string, before string, after string")
    held = spark.createDataFrame([("b1", "L"), ("b2", "L"), ("b3", "M")], "node string, holder string")
    assert {tuple(r) for r in graph.dependency_export(changed, edges, held, ["L"]).collect()} == {("b1", "a1")}


def test_incremental_links(spark):
    old, new = (spark.createDataFrame(x, "k string, l int") for x in ([("i", 1), ("j", 2)], [("j", 2)]))
    rnew, rall = (spark.createDataFrame(x, "k string, r int") for x in ([("i", 9)], [("i", 9), ("j", 8), ("z", 7)]))
    assert {(r.l, r.r) for r in graph.incremental_links(new, old, rnew, rall, "k").collect()} == {(2, 8), (1, 9)}


def test_search_documents_and_labels(spark):
    lenses = shape.Lenses({"chips": {"A": {"show": ["name"]}}, "cards": {"A": {"show": ["name", "town"]}}}, Hierarchy({"A": ()}))
    df = spark.createDataFrame([(1, "(The) Name", "Lund", ["a", "b"], ["b"], [("sab", "H"), ("ddc", "8")])], "id int, name string, town string, ids array<string>, same array<string>, c array<struct<scheme:string,code:string>>")
    r = shape.search_document(df, lenses, "A", "id", ["ids", "same"]).first()
    assert (r._chips_text, r._cards_text, r._sort_key, r._ids) == ("(the) name", "(the) name lund", "The) Name", ["a", "b"])
    s = df.select(*shape.classification_fields(F.col("c"), {"_sab": "sab", "_ddc": "ddc"})).first()
    assert (s._sab, s._ddc) == (["H"], ["8"])
    labels = Labels([("Bok", "t:Book"), ("BOK ", "t:Book"), ("Kort", "t:A"), ("kort", "t:B")])
    assert labels.get(" bok") == "t:Book" and labels.get("kort") is None and labels.ambiguous("kort") == ["t:A", "t:B"]

import json

import pytest

from lodestack.functions import jsonld, scripts
from lodestack.operators import bulk, notify

CONTEXT = jsonld.Context({"@vocab": "http://v/", "ex": "http://ex/", "label": {"@id": "http://v/label"}, "labelByLang": {"@id": "http://v/label", "@container": "@language"}, "broader": {"@type": "@id"}, "list": {"@container": "@list"}, "n": {"@type": "ex:int"}})
DOC = {"@id": "ex:a", "@type": "T", "label": "x", "labelByLang": {"sv": "å"}, "broader": "ex:b", "list": ["1", "2"], "n": "3", "sub": {"@type": "U", "k": [1, True]}}


def test_expand_and_compact_round_trip():
    expanded = jsonld.expand(DOC, CONTEXT)
    assert expanded[0]["@id"] == "http://ex/a" and expanded[0]["http://v/broader"] == [{"@id": "http://ex/b"}]
    assert expanded[0]["http://v/n"] == [{"@value": "3", "@type": "http://ex/int"}]
    back = jsonld.compact(expanded[0], CONTEXT)
    assert {k: v for k, v in back.items() if not k.startswith("label")} == {k: v for k, v in DOC.items() if not k.startswith("label")}
    assert jsonld.expand(back, CONTEXT) == expanded


def test_statements():
    got = list(jsonld.statements(jsonld.expand(DOC, CONTEXT)))
    assert ("http://ex/a", "http://v/label", "å", "literal", None, "sv") in got
    assert ("_:b0", "http://v/k", "true", "literal", jsonld.XSD + "boolean", None) in got
    assert ("http://ex/a", "http://v/sub", "_:b0", "blank", None, None) in got and len(got) == 11


def test_vocabulary_map():
    names = jsonld.target_map([("a:x", "same", "b:x"), ("a:y", "broader", "a:x"), ("a:z", "broader", "a:w")], {"b:x"})
    assert names["a:y"] == ["b:x"] and "a:z" not in names
    assert jsonld.map_vocabulary({"a:x": 1, "a:y": [2], "q": 3, "@type": "a:x"}, names) == {"b:x": [1, 2], "q": 3, "@type": "b:x"}
    assert jsonld.map_vocabulary({"q": 3}, names, keep_unmapped=False) == {}


def test_lens_paths_and_formats():
    node = {"p": [{"@type": "T", "q": 1}, {"@type": "U", "q": 2}], "@reverse": {"r": [{"@type": "T", "q": 3}]}}
    assert jsonld.select_path(node, "p/T/q") == [1] and jsonld.select_path(node, "p/*/q") == [1, 2] and jsonld.select_path(node, "in::r/*/q") == [3]
    assert jsonld.format_values(["a", "b", "c"], before=", ", first="", last=".") == "a, b, c."


def test_normalisers():
    assert jsonld.normalise({"a": None, "b": [{"c": None}], "@type": ["T", "S"]}, [jsonld.drop_nulls, lambda r: jsonld.single_types(r, lambda a, b: (a, b) == ("S", "T"))]) == {"@type": "S"}
    assert jsonld.promote_id({"@id": "a", "x": [{"@id": "a"}]}, "a", "b") == {"@id": "b", "x": [{"@id": "b"}]}


def test_form_transform():
    match = {"_id": "#1", "@type": "T", "p": {"_id": "#2", "@type": "Q", "v": "old"}, "gone": "x"}
    target = {"_id": "#1", "@type": "T", "p": {"_id": "#2", "@type": "Q", "v": "new"}, "add": "y"}
    t = bulk.FormTransform(match, target, frozenset({"many"}))
    assert t({"@type": "T", "p": [{"@type": "Q", "v": "keep"}, {"@type": "Q", "v": "old"}], "gone": "x"}) == {"@type": "T", "p": [{"@type": "Q", "v": "keep"}, {"@type": "Q", "v": "new"}], "add": "y"}
    other = {"@type": "T", "p": {"@type": "Q", "v": "else"}, "gone": "x"}
    assert t(other) == other
    with pytest.raises(bulk.NotRepeatable):
        t({"@type": "T", "p": {"@type": "Q", "v": "old"}, "gone": "x", "add": "z"})


def test_specifications_and_scripts(spark):
    rows = [(1, '{"@id": "a", "l": [{"@id": "b"}, {"@id": "c"}]}'), (2, '{"@id": "b"}'), (3, None), (4, '{"@id": "d"}')]
    df = spark.createDataFrame(rows, "id int, data string")
    out = {r.id: (r.action, r.after) for r in bulk.run_script(df, "id", "data", bulk.Specification("merge", keep="c", deprecate=("b",)).script()).collect()}
    assert out == {1: ("update", '{"@id": "a", "l": [{"@id": "c"}]}'), 2: ("delete", None)}
    gone = bulk.run_script(df, "id", "data", bulk.Specification("delete", match={"@id": "d"}).script())
    assert [(r.id, r.action) for r in bulk.preview(gone, "id").collect()] == [(4, "delete")]
    assert bulk.run_script(df, "id", "data", lambda r: None, limit=2).count() == 2
    assert bulk.validated(gone, lambda r: []).first()["problems"] == 0


def test_form_as_pattern_and_query():
    assert bulk.link_pattern({"@type": "T", "p": {"@type": "Any", "q": {"@id": "x"}}}) == [("?n0", "@type", "T"), ("?n0", "p", "?n1"), ("?n1", "q", "x")]
    assert bulk.query_from_node({"a": {"b": "x y"}, "c": 3}, {"a.b": "title", "c": "year"}) == 'title:"x y" year:3'


def instance(**work):
    return {"mainEntity": {"hasTitle": [{"@type": "Title", "mainTitle": work.pop("title", "A title")}], "instanceOf": work}}


@pytest.mark.parametrize(
    ("before", "after", "rules"),
    [
        (instance(), instance(), []),
        (instance(title="A title"), instance(title="a  titles"), []),  # one edit is no change
        (instance(title="A title"), instance(title="Another"), ["mainTitle"]),
        (instance(subject=[{"@id": "a"}, {"@id": "b"}]), instance(subject=[{"@id": "b"}, {"@id": "a"}]), []),
        (instance(subject=[{"@id": "a"}]), instance(subject=[{"@id": "b"}]), ["subject"]),
        (instance(contribution=[{"@type": "PrimaryContribution", "agent": {"@type": "Person", "lifeSpan": "1900-"}}]), instance(contribution=[{"@type": "PrimaryContribution", "agent": {"@type": "Person", "lifeSpan": "1900-1980"}}]), []),
        (instance(contribution=[{"@type": "PrimaryContribution", "agent": {"@type": "Person", "lifeSpan": "1900-"}}]), instance(contribution=[{"@type": "PrimaryContribution", "agent": {"@type": "Person", "lifeSpan": "1901-"}}]), ["primaryContribution"]),
        (instance(classification=[{"@type": "ClassificationDdc", "code": "1"}]), instance(classification=[{"@type": "ClassificationDdc", "code": "2"}]), ["ddc"]),
    ],
)
def test_change_rules(before, after, rules):
    assert [r.name for r in notify.INSTANCE_RULES if r(before, after) is not None] == rules


def test_observations_collapse(spark):
    pairs = spark.createDataFrame([(i, json.dumps(instance(title="one")), json.dumps(instance(title="another")), "c1" if i < 3 else "c2") for i in range(5)] + [(9, None, "{}", "c3")], "id int, b string, a string, cause string")
    found = notify.observations(pairs, "id", "b", "a", changed_by="cause")
    assert {(r.id, r.rule) for r in found.collect()} == {(i, "mainTitle") for i in range(5)}
    assert {(r.cause, r.rule, r.id) for r in notify.collapse(found, "cause", 2).collect()} == {("c1", "agent", None), ("c2", "mainTitle", 3), ("c2", "mainTitle", 4)}


def test_romanize(spark):
    assert scripts.romanize("Щука и Москва", scripts.TABLES["Cyrl"]) == "Ŝuka i Moskva" and scripts.romanize("Ου θ", scripts.TABLES["Grek"]) == "Ou th"
    df = spark.createDataFrame([("да",), (None,)], "s string")
    assert [r[0] for r in df.select(scripts.romanize_column(df["s"], "Cyrl")).collect()] == ["da", None]

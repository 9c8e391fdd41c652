"""Queries on JSON trees, lenses, linked-data forms and bulk changes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.entries.core import EDGES_SQL, hierarchy_edges, query, read, ts
from lodestack.functions import jsonld
from lodestack.functions.jsontree import KEEP, REMOVE, canonical, changesets, diff, find_key, get_path, is_equal, is_subset, json_udf, merge_with_rules, patch, pointer, remove_path, rewrite, set_path, soft_merge, validate
from lodestack.functions.text import normalize_udf
from lodestack.operators import bulk, notify, shape
from lodestack.plans.catalog import Hierarchy


def event_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON: ``{"id", "type", "props": {"k"}, "list": [{"v": value}, {"v": 1}]}``."""
    e = read(spark, sf, "events")
    data = F.concat(F.lit('{"id": '), "event_id", F.lit(', "type": "'), "event_type", F.lit('", "props": '), "props", F.lit(', "list": [{"v": '), F.floor("value").cast("long"), F.lit('}, {"v": 1}]}'))
    return e.select("event_id", "user_id", "ts", "event_type", "value", data.alias("data"))


def field(path: str, name: str, kind: str = "string", column: str = "new"):
    return F.get_json_object(column, path).cast(kind).alias(name)


_K = "json_extract_string(props, '$.k')"


@query("tree_paths", f"select event_id, {_K}::int k, floor(value)::bigint + 1 total, event_type kind from events")
def tree_paths(spark, sf):
    picked = json_udf(lambda r: {"k": get_path(r, ["props", "k"]), "total": sum(get_path(r, ["list", "*", "v"])), "kind": get_path(r, ["none"], r["type"])})
    return event_docs(spark, sf).withColumn("new", picked("data")).select("event_id", field("$.k", "k", "int"), field("$.total", "total", "bigint"), field("$.kind", "kind"))


@query("tree_edits", f"select event_id, 5 made, null::varchar gone, 'x' as \"second\", {_K}::int k from events")
def tree_edits(spark, sf):
    edit = json_udf(lambda r: remove_path(set_path(set_path(r, ["a", "b", 0], 5), ["list", 1, "w"], "x"), ["type"]))
    return event_docs(spark, sf).withColumn("new", edit("data")).select("event_id", field("$.a.b[0]", "made", "int"), field("$.type", "gone"), field("$.list[1].w", "second"), field("$.props.k", "k", "int"))


@query("tree_rewrite", "select event_id, upper(event_type) kind, null::varchar props, floor(value)::bigint v from events")
def tree_rewrite(spark, sf):
    def visit(path, node):
        if path and path[-1] == "props":
            return REMOVE
        return node.upper() if isinstance(node, str) else KEEP

    new = json_udf(lambda r: rewrite(r, visit))
    return event_docs(spark, sf).withColumn("new", new("data")).select("event_id", field("$.type", "kind"), field("$.props", "props"), field("$.list[0].v", "v", "bigint"))


@query("tree_find_key", "select event_id, 2 found, '/list/0/v' first_path from events")
def tree_find_key(spark, sf):
    found = json_udf(lambda r: {"n": len(find_key(r, {"v"})), "p": pointer(find_key(r, {"v"})[0][0])})
    return event_docs(spark, sf).withColumn("new", found("data")).select("event_id", field("$.n", "found", "int"), field("$.p", "first_path"))


@query("tree_frame_flatten", "select o_orderkey, 'c/' || o_custkey customer, o_orderstatus status, 2 items, o_orderpriority priority from orders")
def tree_frame_flatten(spark, sf):
    o = read(spark, sf, "orders")
    data = F.to_json(F.struct(F.concat(F.lit("o/"), "o_orderkey").alias("@id"), F.struct(F.concat(F.lit("c/"), "o_custkey").alias("@id")).alias("by"), F.struct(F.concat(F.lit("c/"), "o_custkey").alias("@id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("about")))

    def there_and_back(r):
        items = shape.flatten(r)
        tree = shape.frame({x["@id"]: x for x in items}, r["@id"])
        return {"c": tree["by"]["@id"], "s": tree["by"]["status"], "p": tree["about"]["priority"], "n": len(items)}

    out = o.select("o_orderkey", json_udf(there_and_back)(data).alias("new"))
    return out.select("o_orderkey", field("$.c", "customer"), field("$.s", "status"), field("$.n", "items", "int"), field("$.p", "priority"))


@query("tree_diff_patch", "select event_id, case when floor(value) = 1 then 1 else 2 end changes, true same from events")
def tree_diff_patch(spark, sf):
    def there(r):
        other = set_path(set_path(r, ["type"], "other"), ["list", 0, "v"], 1)
        return {"n": len(diff(r, other)), "same": patch(r, diff(r, other)) == other}

    return event_docs(spark, sf).withColumn("new", json_udf(there)("data")).select("event_id", field("$.n", "changes", "int"), field("$.same", "same", "boolean"))


@query("tree_equality", "select event_id, true equal, true subset, floor(value) = 1 twice from events")
def tree_equality(spark, sf):
    def tests(r):
        turned = {**r, "list": r["list"][::-1]}
        return {"e": is_equal(r, turned) and canonical(r) == canonical(turned) and not (r["list"] != turned["list"] and is_equal(r, turned, frozenset({"list"}))), "s": is_subset({"list": [{"v": 1}]}, r), "t": is_subset({"list": [{"v": 1}, {"v": 1}]}, r)}

    return event_docs(spark, sf).withColumn("new", json_udf(tests)("data")).select("event_id", field("$.e", "equal", "boolean"), field("$.s", "subset", "boolean"), field("$.t", "twice", "boolean"))


@query("tree_merges", f"select event_id, 'base' kept, {_K}::int added, case when event_type = 'click' then 'click' else 'old' end ruled, 'only' filled from events")
def tree_merges(spark, sf):
    rules = [{"operation": "replace", "path": ["type"], "priority": {"click": 2, "owner": 1}}, {"operation": "add_if_none", "path": ["more"]}]

    def merged(r):
        soft = soft_merge({"name": "new", "props": r["props"]}, {"name": "base", "props": {}})
        ruled = merge_with_rules({"type": "old"}, {"type": r["type"], "more": "only"}, rules, lambda path: "owner", r["type"])
        return {"k": soft["name"], "a": soft["props"]["k"], "r": ruled["type"], "f": ruled["more"]}

    return event_docs(spark, sf).withColumn("new", json_udf(merged)("data")).select("event_id", field("$.k", "kept"), field("$.a", "added", "int"), field("$.r", "ruled"), field("$.f", "filled"))


@query("tree_validation", "select event_id, '/extra' path, 'unknown' error from events where event_type = 'error' union all select event_id, '/list', 'not repeatable' from events")
def tree_validation(spark, sf):
    def run(batches):
        for pdf in batches:
            rows = []
            for key, kind, text in pdf.itertuples(index=False):
                item = json.loads(text) | ({"extra": 1} if kind == "error" else {})
                rows += [(key, p, e) for p, e in validate(item, {"id", "type", "props", "k", "list", "v"}, set(), {"props"})]
            yield pd.DataFrame(rows, columns=["event_id", "path", "error"])

    return event_docs(spark, sf).select("event_id", "event_type", "data").mapInPandas(run, "event_id long, path string, error string")


@query("tree_normalisers", "select event_id, event_type kind, null::varchar nothing, 'B' single from events")
def tree_normalisers(spark, sf):
    def chain(r):
        record = {**r, "nothing": None, "empty": {"x": None}, "@type": ["A", "B"]}
        return jsonld.normalise(record, [jsonld.drop_nulls, lambda x: jsonld.single_types(x, lambda a, b: (a, b) == ("B", "A") or a == b)])

    return event_docs(spark, sf).withColumn("new", json_udf(chain)("data")).select("event_id", field("$.type", "kind"), field("$.empty", "nothing"), field("$['@type']", "single"))


@query("tree_new_ids", "select event_id, 'new' own, 'new' linked from events")
def tree_new_ids(spark, sf):
    new = json_udf(lambda r: jsonld.promote_id({"@id": "old", "part": [{"@id": "old"}]}, "old", "new"))
    return event_docs(spark, sf).withColumn("new", new("data")).select("event_id", field("$['@id']", "own"), field("$.part[0]['@id']", "linked"))


@query("version_changesets", "select user_id, event_id, case when n = 1 then '/t' when event_type <> before then '/t' else '' end added from (select user_id, event_id, event_type, lag(event_type) over w before, row_number() over w n from events window w as (partition by user_id order by ts, event_id))")
def version_changesets(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        found = changesets([{"t": t} for t in pdf["event_type"]])
        return pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "added": [",".join(c["added"]) for c in found]})

    return read(spark, sf, "events").select("user_id", "event_id", "event_type", "ts").groupBy("user_id").applyInPandas(run, "user_id long, event_id long, added string")


CONTEXT = {"@vocab": "http://v/", "e": "http://e/", "by": {"@type": "@id"}, "names": {"@id": "name", "@container": "@language"}}


@query("linked_round_trip", "select o_orderkey, 'e:c' || o_custkey customer, o_orderstatus kind, o_orderpriority \"name\", 2 nodes from orders")
def linked_round_trip(spark, sf):
    o = read(spark, sf, "orders")
    data = F.to_json(F.struct(F.concat(F.lit("http://e/o"), "o_orderkey").alias("@id"), F.col("o_orderstatus").alias("@type"), F.concat(F.lit("e:c"), "o_custkey").alias("by"), F.struct(F.col("o_orderpriority").alias("en")).alias("names"), F.struct(F.lit(7).alias("n")).alias("part")))

    def there_and_back(r):
        context = jsonld.Context(CONTEXT)
        expanded = jsonld.expand(r, context)
        nodes = jsonld.from_statements(list(jsonld.statements(jsonld.expand(r, context))))
        assert len(jsonld.flatten_graph(expanded)) == len(nodes)
        back = jsonld.compact(next(n for n in nodes if n["@id"] == r["@id"]), context)
        return {"c": back["by"], "t": back["@type"], "l": back["names"]["en"], "n": len(nodes)}

    out = o.select("o_orderkey", json_udf(there_and_back)(data).alias("new"))
    return out.select("o_orderkey", field("$.c", "customer"), field("$.t", "kind"), field("$.l", "name"), field("$.n", "nodes", "int"))


@query("vocabulary_mapping", "select event_id, event_type kind, case when event_type = 'click' then 'Interaction' else event_type end mapped from events")
def vocabulary_mapping(spark, sf):
    names = jsonld.target_map([("click", "broader", "Action"), ("Action", "same", "Interaction"), ("type", "same", "kind")], {"Interaction", "kind"})
    new = json_udf(lambda r: jsonld.map_vocabulary({"type": r["type"], "@type": r["type"]}, names))
    return event_docs(spark, sf).withColumn("new", new("data")).select("event_id", field("$.kind", "kind"), field("$['@type']", "mapped"))


@query("lens_paths", "select event_id, floor(value)::bigint || '; 1.' shown from events")
def lens_paths(spark, sf):
    shown = json_udf(lambda r: {"s": jsonld.format_values(jsonld.select_path(r, "list/*/v"), after="; ", last=".")})
    return event_docs(spark, sf).withColumn("new", shown("data")).select("event_id", field("$.s", "shown"))


AGENTS = shape.Lenses({"chips": {"Agent": {"show": ["c_name"]}}, "cards": {"Agent": {"extends": ("chips", "Agent"), "show": [{"alternatives": ["c_missing", "c_mktsegment"]}, {"inverseOf": "placeOf"}]}}, "full": {"Person": {"extends": ("cards", "Agent"), "show": ["c_custkey"]}}}, Hierarchy({"Agent": (), "Person": ("Agent",)}), {"placeOf": "c_nationkey"})


@query("lens_alternatives", "select c_custkey id, c_name, c_mktsegment, c_nationkey, c_nationkey link from customer")
def lens_alternatives(spark, sf):
    c = read(spark, sf, "customer").withColumns({"id": F.col("c_custkey"), "link": F.col("c_nationkey")})
    return shape.keep_links(c, AGENTS, "cards", "Person", "id", ["link"]).select("id", "lens.*", "link")


@query("lens_labels", "select c_custkey, c_name || ' • ' || c_mktsegment || ' • ' || c_nationkey as \"label\" from customer")
def lens_labels(spark, sf):
    c = read(spark, sf, "customer")
    return c.select("c_custkey", AGENTS.text("cards", "Person", c.columns).alias("label"))


@query("search_documents", "select c_custkey, lower(c_name) _chips_text, lower(c_name || ' ' || c_mktsegment || ' ' || c_nationkey) _cards_text, lower(c_name || ' ' || c_mktsegment || ' ' || c_nationkey || ' ' || c_custkey) _full_text, c_name _sort_key, c_name || '|' || c_mktsegment ids from customer")
def search_documents(spark, sf):
    c = read(spark, sf, "customer").withColumns({"own": F.array("c_name"), "other": F.array(F.col("c_mktsegment"), F.col("c_name"), F.lit(None))})
    out = shape.search_document(c, AGENTS, "Person", "c_custkey", ["own", "other"])
    return out.select("c_custkey", "_chips_text", "_cards_text", "_full_text", "_sort_key", F.array_join("_ids", "|").alias("ids"))


@query("language_strings", "select p_partkey, p_name || '|' || p_brand || '|' || p_type strings from part")
def language_strings(spark, sf):
    p = read(spark, sf, "part").withColumn("by_lang", F.create_map(F.lit("en"), "p_brand", F.lit("sv"), "p_type"))
    return p.select("p_partkey", F.array_join(shape.language_strings("p_name", "by_lang"), "|").alias("strings"))


@query("classification_fields", "select p_partkey, case when p_size > 25 then p_brand else '' end sab, case when p_size > 25 then '' else p_brand end udc from part")
def classification_fields(spark, sf):
    codes = F.array(F.struct(F.when(F.col("p_size") > 25, "kssb").otherwise("udc").alias("scheme"), F.col("p_brand").alias("code")))
    sab, udc = shape.classification_fields(codes, {"sab": "kssb", "udc": "udc"})
    return read(spark, sf, "part").select("p_partkey", sab, udc).select("p_partkey", F.array_join("sab", ",").alias("sab"), F.array_join("udc", ",").alias("udc"))


@query("without_internal", "select c_custkey, c_name from customer")
def without_internal(spark, sf):
    c = read(spark, sf, "customer").withColumns({"_chip": F.lit(1), "_score": F.lit(2)})
    return shape.drop_internal(c, ("c_nationkey", "c_acctbal", "c_mktsegment"))


@query("result_items", f"select 'N' || n_nationkey id, n_name, 1.5 + n_regionkey total_score, n_regionkey::double region_part, (select count(*) from {EDGES_SQL} where dst = 'N' || n_nationkey) reverse_links from nation")
def result_items(spark, sf):
    n = read(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.struct("n_name").alias("lens"), "n_regionkey")
    out = shape.result_item(n, "id", "lens", {"base": F.lit(1.5), "region": F.col("n_regionkey").cast("double"), "none": F.lit(None).cast("double")}, hierarchy_edges(spark, sf))
    return out.select("id", "n_name", "total_score", F.col("parts")["region"].alias("region_part"), "reverse_links")


@query("virtual_records", "select o_orderkey || '#work' id, o_orderkey part_of, o_orderpriority priority from orders where o_orderstatus <> 'P'")
def virtual_records(spark, sf):
    o = read(spark, sf, "orders").withColumn("work", F.when(F.col("o_orderstatus") != "P", F.struct(F.col("o_orderpriority").alias("priority"))))
    return shape.virtual_records(o, "o_orderkey", "work").select("id", "part_of", field("$.priority", "priority", column="data"))


@query("bulk_form_update", "select event_id, 'press' kind, 'yes' mark from events where event_type = 'click'")
def bulk_form_update(spark, sf):
    spec = bulk.Specification("update", {"_id": "a", "type": "click"}, {"_id": "a", "type": "press", "mark": "yes"})
    out = bulk.run_script(event_docs(spark, sf), "event_id", "data", spec.script())
    return out.select("event_id", field("$.type", "kind", column="after"), field("$.mark", "mark", column="after"))


@query("bulk_delete_preview", "select event_id, 'delete' as action from events where event_type = 'error' order by event_id limit 20 offset 5")
def bulk_delete_preview(spark, sf):
    out = bulk.run_script(event_docs(spark, sf), "event_id", "data", bulk.Specification("delete", {"type": "error"}).script())
    return bulk.preview(out, "event_id", 5, 20).select("event_id", "action")


@query("bulk_merge", "select 'O' || o_orderkey id, case when o_custkey < 50 then 'delete' else 'update' end as action, case when o_custkey < 50 then null else 'kept' end as customer from orders where o_custkey < 100")
def bulk_merge(spark, sf):
    o = read(spark, sf, "orders").where("o_custkey < 100")
    o = o.select(F.concat(F.lit("O"), "o_orderkey").alias("id"), F.concat(F.lit('{"@id": "'), F.when(F.col("o_custkey") < 50, "gone").otherwise(F.col("o_orderkey").cast("string")), F.lit('", "by": [{"@id": "gone"}, {"@id": "kept"}]}')).alias("data"))
    out = bulk.run_script(o, "id", "data", bulk.Specification("merge", keep="kept", deprecate=("gone",)).script())
    return out.select("id", "action", field("$.by[0]['@id']", "customer", column="after"))


@query("bulk_create", "select 'new' || n_nationkey id, 'Place' kind from nation")
def bulk_create(spark, sf):
    spec = bulk.Specification("create", target={"_id": "a", "@type": "Place"})

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(r["@id"], r["@type"]) for r in spec.created(pdf["id"].tolist())], columns=["id", "kind"])

    return read(spark, sf, "nation").select(F.concat(F.lit("new"), "n_nationkey").alias("id")).mapInPandas(run, "id string, kind string")


@query("bulk_checked", "select event_id, (case when event_type = 'view' then 1 else 0 end)::bigint problems from events where event_type in ('view', 'click')")
def bulk_checked(spark, sf):
    def script(r: dict) -> dict:
        return r if r["type"] not in ("view", "click") else {**r, **({"odd": 1} if r["type"] == "view" else {"k": 1})}

    out = bulk.run_script(event_docs(spark, sf), "event_id", "data", bulk.Specification("other", function=script).script())
    return bulk.validated(out, lambda r: [e for e in validate(r, {"id", "type", "props", "k", "list", "v"}, {"list"}, set())]).select("event_id", "problems")


@query("bulk_limited", "select event_id from events order by event_id limit 10")
def bulk_limited(spark, sf):
    return bulk.run_script(event_docs(spark, sf), "event_id", "data", lambda r: {**r, "seen": True}, limit=10).select("event_id")


def title_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as records before and after: the title of every third size changes."""
    p = read(spark, sf, "part")

    def record(title):
        return F.concat(F.lit('{"mainEntity": {"hasTitle": [{"@type": "Title", "mainTitle": "'), title, F.lit('"}]}}'))

    after = F.when(F.col("p_size") > 30, F.concat(F.lit("quite another "), "p_name")).otherwise(F.concat("p_name", F.lit(".")))
    return p.select("p_partkey", F.col("p_brand").alias("cause"), record(F.col("p_name")).alias("before"), record(after).alias("after"))


@query("change_observations", "select p_partkey, 'mainTitle' rule, '\"' || p_name || '\"' \"old\", '\"quite another ' || p_name || '\"' \"new\" from part where p_size > 30")
def change_observations(spark, sf):
    return notify.observations(title_pairs(spark, sf), "p_partkey", "before", "after")


@query("collapsed_observations", "select p_brand cause, case when count(*) <= 3 then 'mainTitle' else 'agent' end rule, case when count(*) <= 3 then count(*) else 1 end n from part where p_size > 30 group by 1")
def collapsed_observations(spark, sf):
    found = notify.observations(title_pairs(spark, sf), "p_partkey", "before", "after", changed_by="cause")
    return notify.collapse(found, "cause", 3).groupBy("cause", "rule").agg(F.count("*").alias("n"))


@query("inquiries_sent", "select event_id, s_suppkey holder from events join supplier on user_id % 25 = s_nationkey where ts > timestamp '2024-01-20' and event_type = 'purchase'")
def inquiries_sent(spark, sf):
    actions = read(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "ts", (F.col("user_id") % 25).cast("int").alias("object"))
    holders = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("object"), F.col("s_suppkey").alias("holder"))
    return notify.inquiries(actions, "ts", ts("2024-01-20"), holders).select("event_id", "holder")


@query("composed_texts", "select doc_id, text from documents")
def composed_texts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", normalize_udf(F.concat(F.lit("﻿"), F.col("text"))).alias("text"))



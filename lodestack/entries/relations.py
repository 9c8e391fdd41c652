"""Queries on joins and graphs, and on statistics of links and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.entries.core import EDGES_SQL, hierarchy_edges, query, read, ts
from lodestack.functions import ids, text
from lodestack.operators import cluster, graph, shape, stats, store, upkeep
from lodestack.plans.catalog import Hierarchy


@query("interval_overlaps", "select a.event_id l_id, b.event_id r_id from events a join events b on a.user_id = b.user_id and abs(a.value - b.value) < 5 and a.event_type = 'purchase' and b.event_type = 'error'")
def interval_overlaps(spark, sf):
    e = read(spark, sf, "events")
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("l_id"), F.col("value").alias("a"))
    b = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("r_id"), F.col("value").alias("b"))
    return upkeep.within(a, b, "a", "b", 5, ["user_id"]).select("l_id", "r_id")


_KEY = "md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))"


@query("id_collisions", f"select {_KEY} iri, min(doc_id) as \"first\", count(distinct doc_id) n from documents where text is not null group by 1 having count(distinct doc_id) > 1")
def id_collisions(spark, sf):
    return upkeep.id_collisions(read(spark, sf, "documents").where("text is not null").select(F.md5(text.collapse(F.col("text"))).alias("iri"), F.col("doc_id").alias("id")))


@query("id_mapping", "select k given, coalesce(c_name, s_name) id from (select c_custkey::varchar k from customer) left join (select c_custkey::varchar ck, c_name from customer where c_nationkey < 10) on k = ck left join (select s_suppkey::varchar sk, s_name from supplier) on k = sk where c_name is not null or s_name is not null")
def id_mapping(spark, sf):
    c = read(spark, sf, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    s = read(spark, sf, "supplier").withColumn("k", F.col("s_suppkey").cast("string"))
    return upkeep.map_ids(c.select(F.col("k").alias("given")), [(c.where("c_nationkey < 10"), "k", "c_name"), (s, "k", "s_name")])


@query("holding_of", "select l_orderkey, l_suppkey, l_linenumber from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey < 10) and l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P')")
def holding_of(spark, sf):
    li = read(spark, sf, "lineitem")
    pairs = li.join(read(spark, sf, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey").join(read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return store.holding_of(li, pairs, "l_orderkey", "l_suppkey").select("l_orderkey", "l_suppkey", "l_linenumber")


@query("attached_holdings", "select l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority = '2-HIGH'")
def attached_holdings(spark, sf):
    o = read(spark, sf, "orders").where("o_orderpriority = '2-HIGH'").select(F.array("o_orderkey", -F.col("o_orderkey")).alias("ids"))
    return store.attached(read(spark, sf, "lineitem"), o, "l_orderkey", "ids").select("l_orderkey", "l_linenumber")


@query("held_by_any", "select distinct l_orderkey from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey in (1, 2))")
def held_by_any(spark, sf):
    holders = read(spark, sf, "supplier").where(F.col("s_nationkey").isin(1, 2))
    return store.lookup(read(spark, sf, "lineitem"), holders, "l_suppkey", "s_suppkey").select("l_orderkey").distinct()


@query("related_records", f"select src node, relation from {EDGES_SQL} where dst = 'N3' union all select dst, relation from {EDGES_SQL} where src = 'N3'")
def related_records(spark, sf):
    e = hierarchy_edges(spark, sf)
    return graph.related(e, "N3", reverse=True).unionByName(graph.related(e, "N3"))


@query("reachability", "select 'S' || s_suppkey a, 'R' || (s_suppkey % 5) b, n_regionkey = s_suppkey % 5 reachable from supplier join nation on s_nationkey = n_nationkey")
def reachability(spark, sf):
    pairs = read(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("a"), F.concat(F.lit("R"), (F.col("s_suppkey") % 5)).alias("b"))
    return graph.reachable(hierarchy_edges(spark, sf), pairs, relations=("place", "broader"))


@query("superclass_chain", "select 'N' || n_nationkey term, 'R' || n_regionkey ancestor, 1 depth from nation union all select 'N' || n_nationkey, 'World', 2 from nation union all select 'R' || r_regionkey, 'World', 1 from region")
def superclass_chain(spark, sf):
    tree = {"R" + str(x["r_regionkey"]): ("World",) for x in read(spark, sf, "region").collect()}  # a vocabulary: 5 and 25 rows at every scale
    tree |= {"N" + str(x["n_nationkey"]): ("R" + str(x["n_regionkey"]),) for x in read(spark, sf, "nation").collect()}
    types = Hierarchy(tree)
    return spark.createDataFrame([(t, a, i) for t in tree for i, a in enumerate(types.ancestors(t), 1)], "term string, ancestor string, depth int")


@query("embellish_history", "select 'C' || c_custkey root, 'C' || c_custkey node, 0 as level, null::varchar as \"data\" from customer where c_nationkey < 3 union all select 'C' || c_custkey, 'N' || c_nationkey, 1, 'old ' || n_name from customer join nation on c_nationkey = n_nationkey where c_nationkey < 3")
def embellish_history(spark, sf):
    c, n = read(spark, sf, "customer").where("c_nationkey < 3"), read(spark, sf, "nation")
    then, later = ts("2024-01-01"), ts("2024-02-01")
    home = c.select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("dst"), F.lit("home").alias("relation"), then.alias("time"), F.lit(False).alias("removed"))
    moved = home.withColumns({"time": later, "removed": F.lit(True)}).unionByName(home.withColumns({"time": later, "dst": F.lit("N9")}))
    names = n.select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.concat(F.lit("old "), "n_name").alias("data"), then.alias("time"))
    renamed = names.withColumns({"data": F.lit("new"), "time": later})
    return upkeep.historic_embellish(c.select(F.concat(F.lit("C"), "c_custkey").alias("node")), home.unionByName(moved), names.unionByName(renamed), ts("2024-01-15"), ["cards"])


@query("embellish_by_collection", "with c as (select 'C' || c_custkey k, 'N' || c_nationkey n, c_mktsegment s from customer) select k root, k node, 0 as level, s as \"data\" from c where s in ('BUILDING', 'MACHINERY') union all select k, n, 1, null from c where s in ('BUILDING', 'MACHINERY') union all select a.k, b.k, 2, b.s from c a join c b on a.n = b.n and a.k <> b.k where a.s = 'MACHINERY' union all select k, 'R' || n_regionkey, 2, null from c join nation on n = 'N' || n_nationkey where s = 'MACHINERY'")
def embellish_by_collection(spark, sf):
    c = read(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("collection"))
    content = c.select("node", F.col("collection").alias("data"))
    return upkeep.embellish_by_collection(c, hierarchy_edges(spark, sf).where("relation <> 'place'"), {"cards": content, "chips": content}, {"BUILDING": ["cards"], "MACHINERY": ["cards", "chips"]})


@query("alias_links", "select l_orderkey, 'main' || l_suppkey iri from lineitem")
def alias_links(spark, sf):
    links = read(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") > 2, F.concat(F.lit("alias"), "l_suppkey")).otherwise(F.concat(F.lit("main"), "l_suppkey")).alias("iri"))
    known = read(spark, sf, "supplier").select(F.concat(F.lit("alias"), "s_suppkey").alias("alias"), F.concat(F.lit("main"), "s_suppkey").alias("main"))
    return graph.replace_aliases(links, known).select("l_orderkey", "iri")


@query("links_by_label", "select c_custkey, 'N' || c_nationkey linked from customer union all select c_custkey, 'R' || n_regionkey from customer join nation on c_nationkey = n_nationkey")
def links_by_label(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    nodes = read(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = nodes.select("c_custkey", F.concat(F.upper("n_name"), F.lit(" / "), F.lower("r_name"), F.lit(" .")).alias("label"))
    known = n.select(F.col("n_name").alias("label"), F.concat(F.lit("N"), "n_nationkey").alias("id")).unionByName(r.select(F.col("r_name").alias("label"), F.concat(F.lit("R"), "r_regionkey").alias("id")))
    return graph.link_by_label(graph.split_labels(nodes, "label"), "label", known).select("c_custkey", "linked")


@query("image_links", "select a.l_orderkey, b.s_suppkey from (select distinct l_orderkey, l_suppkey from lineitem where l_shipdate >= timestamp '1997-01-01') a join supplier b on a.l_suppkey = b.s_suppkey union select a.l_orderkey, b.s_suppkey from lineitem a join supplier b on a.l_suppkey = b.s_suppkey where b.s_acctbal > 5000")
def image_links(spark, sf):
    instances = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("k"), "l_shipdate")
    images = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_suppkey", "s_acctbal")
    new, fresh = instances.where(F.col("l_shipdate") >= ts("1997-01-01")).select("l_orderkey", "k"), images.where("s_acctbal > 5000").select("k", "s_suppkey")
    return graph.incremental_links(new, instances.select("l_orderkey", "k"), fresh, images.select("k", "s_suppkey"), "k").select("l_orderkey", "s_suppkey")


@query("dependency_export", "select 'S' || s_suppkey node, 'R' || n_regionkey cause from supplier join nation on s_nationkey = n_nationkey where n_regionkey < 2 and s_suppkey in (select l_suppkey from lineitem where l_returnflag = 'R')")
def dependency_export(spark, sf):
    r = read(spark, sf, "region")
    changed = r.select(F.concat(F.lit("R"), "r_regionkey").alias("node"), F.col("r_name").alias("before"), F.when(F.col("r_regionkey") < 2, "other").otherwise(F.col("r_name")).alias("after"))
    holdings = read(spark, sf, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("node"), F.col("l_returnflag").alias("holder")).distinct()
    return graph.dependency_export(changed, hierarchy_edges(spark, sf), holdings, ["R"])


@query("inverse_properties", f"select dst node, case relation when 'home' then 'homeOf' else 'placeOf' end property, src as \"value\" from {EDGES_SQL} where relation in ('home', 'place')")
def inverse_properties(spark, sf):
    return shape.inverse_properties(hierarchy_edges(spark, sf), {"home": "homeOf", "place": "placeOf"})


@query("inverse_links_capped", f"select dst node, relation, src source from {EDGES_SQL} where dst in ('N1', 'N2') qualify row_number() over (partition by dst, relation order by src) <= 3")
def inverse_links_capped(spark, sf):
    nodes = spark.createDataFrame([("N1",), ("N2",)], "node string")
    return graph.inverse_links(hierarchy_edges(spark, sf), nodes, most=3)


@query("path_values", "select '/k' path, json_extract_string(props, '$.k') as \"value\", count(*) n, min(event_id) example from events where json_extract(props, '$.k') is not null group by 2")
def path_values(spark, sf):
    return stats.path_values(read(spark, sf, "events"), "event_id", "props")


@query("shape_query", "select json_extract_string(props, '$.k') as \"key\", count(*) n from events where json_extract(props, '$.k') is not null group by 1")
def shape_query(spark, sf):
    values = stats.path_values(read(spark, sf, "events"), "event_id", "props").withColumn("path", F.concat("path", F.lit("/"), "value"))
    return stats.shape_query(values, "/k")


@query("text_classes", "select case when regexp_matches(text, '[0-9]{4}') then 'year' when regexp_matches(text, '@') then 'mail' else 'other' end as \"class\", count(*) n from documents group by 1")
def text_classes(spark, sf):
    return stats.classify_text(read(spark, sf, "documents"), "text", [("year", "[0-9]{4}"), ("mail", "@")])


@query("relation_paths", f"select relation path, count(*) n, count(distinct src) sources from {EDGES_SQL} group by 1")
def relation_paths(spark, sf):
    return stats.relation_paths(hierarchy_edges(spark, sf))


@query("isbn_by_period", "select year(l_shipdate) as period, count(distinct l_partkey) n from lineitem group by 1")
def isbn_by_period(spark, sf):
    li = read(spark, sf, "lineitem").withColumn("isbn", F.concat(F.lit("978"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lit("0")))
    return stats.unique_by_period(li, ids.isbn10(F.col("isbn")), F.year("l_shipdate"))


@query("earliest_time", "select min(ts) earliest from events")
def earliest_time(spark, sf):
    return stats.earliest(read(spark, sf, "events"), "ts")


@query("script_statistics", "select event_type category, case when value > 50 then 'high' else 'low' end as \"name\", count(*) n, array_to_string(list(event_id order by event_id)[1:3], ',') examples from events group by 1, 2")
def script_statistics(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("category"), F.when(F.col("value") > 50, "high").otherwise("low").alias("name"), "event_id")
    return stats.counter_with_examples(e, ["category", "name"], "event_id", 3).withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query("record_checksums", "select p_brand, p_type, count(*) n from part group by 1, 2 having count(*) > 1")
def record_checksums(spark, sf):
    p = read(spark, sf, "part").withColumn("sum", store.checksum(["p_type", "p_brand"]))
    return p.groupBy("sum").agg(F.first("p_brand").alias("p_brand"), F.first("p_type").alias("p_type"), F.count("*").alias("n")).where("n > 1").select("p_brand", "p_type", "n")


@query("approximate_values", "select o_orderstatus, count(distinct o_orderpriority) n from orders group by 1")
def approximate_values(spark, sf):
    from lodestack.operators import search

    return search.approximate_distinct(read(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("title_blocks", "select distinct p_partkey, block from (select p_partkey, unnest(['t:' || lower(p_name), 'b:' || p_brand]) block from part)")
def title_blocks(spark, sf):
    p = read(spark, sf, "part")
    return cluster.blocked_pairs(p, "p_partkey", [F.concat(F.lit("t:"), text.flat_title(F.col("p_name"))), F.concat(F.lit("b:"), "p_brand")])


@query("title_partition", "with k as (select p_partkey, trim(regexp_replace(lower(regexp_replace(p_name || case when p_size > 25 then ': a novel' else '' end, '(?i)\\s*[:;]\\s*(?:a novel)\\s*$', '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) t from part) select p_partkey, min(p_partkey) over (partition by t) component from k")
def title_partition(spark, sf):
    p = read(spark, sf, "part").withColumn("title", F.concat("p_name", F.when(F.col("p_size") > 25, ": a novel").otherwise("")))
    return cluster.components_by_keys(p, [text.flat_title(F.col("title"), ("a novel",))], "p_partkey")


@query("merge_pickers", "select l_orderkey, arg_min(l_returnflag, (l_linenumber, l_returnflag)) first_mode, min(l_shipdate) l_shipdate, max(l_quantity) l_quantity from lineitem group by 1")
def merge_pickers(spark, sf):
    li = read(spark, sf, "lineitem").withColumn("first_mode", F.col("l_returnflag"))
    return cluster.merge_ordered(li, "l_orderkey", "l_linenumber", {"first_mode": "first", "l_shipdate": "min", "l_quantity": "max"})


@query("most_common_values", "select p_brand, p_type from (select p_brand, p_type, row_number() over (partition by p_brand order by count(*) desc, p_type) n from part group by 1, 2) where n = 1")
def most_common_values(spark, sf):
    return cluster.merge_ordered(read(spark, sf, "part"), "p_brand", "p_partkey", {"p_type": "most"})


@query("compatible_works", "select p_partkey, case when p_size > 10 and p_retailprice < 1500 then true else false end same from part")
def compatible_works(spark, sf):
    from lodestack.functions.jsontree import json_udf

    fields = {"size": cluster.compatible_sets, "cheap": cluster.compatible_sets}
    same = json_udf(lambda a, b: cluster.same_work(a, b, fields), "boolean")
    p = read(spark, sf, "part").select("p_partkey", F.to_json(F.struct((F.col("p_size") > 10).alias("size"), (F.col("p_retailprice") < 1500).alias("cheap"))).alias("a"))
    return p.select("p_partkey", same("a", F.lit('{"size": true, "cheap": [true]}')).alias("same"))

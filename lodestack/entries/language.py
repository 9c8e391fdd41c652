"""Queries in the query language and its front-ends, on facets, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.entries.core import EDGES_SQL, RECORDS_SQL, hierarchy_edges, query, read, record_catalog, run_query, with_items
from lodestack.entries.core import records as order_records
from lodestack.functions.jsontree import json_udf, matches_form
from lodestack.operators import bulk, search
from lodestack.plans import legacy, paths
from lodestack.plans.catalog import Field, FieldCatalog, Labels
from lodestack.sources import rdf


@query("ql_shorthand", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity > 40)")
def ql_shorthand(spark, sf):
    o = with_items(spark, sf)
    catalog = paths.with_paths(FieldCatalog.of(o, "o_"), o, {"returned": ("items", "flag"), "amount": ("items", "quantity")})
    return run_query(o, "returned:R amount>40", catalog).select("o_orderkey")


@query("ql_restricted", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_linenumber = 2)")
def ql_restricted(spark, sf):
    o = with_items(spark, sf)
    catalog = paths.with_paths(FieldCatalog.of(o, "o_"), o, {"secondFlag": ("items", "flag")}, fixed={"secondFlag": (("line", 2),)})
    return run_query(o, "secondFlag:R", catalog).select("o_orderkey")


@query("ql_integral_alternatives", "select l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' and (l_extendedprice > 60000 or o_totalprice > 60000)")
def ql_integral_alternatives(spark, sf):
    li, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    items = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).alias("instanceOf"))
    catalog = paths.with_paths(FieldCatalog.of(items, "l_"), items, {"workStatus": ("status",), "anyPrice": ("price",)}, ("instanceOf",))
    return run_query(items, "workStatus:F anyPrice>60000", catalog).select("l_orderkey", "l_linenumber")


@query("ql_label_lookup", f"select id from {RECORDS_SQL} where segment = 'FURNITURE' and priority = '5-LOW'")
def ql_label_lookup(spark, sf):
    df = order_records(spark, sf)
    catalog = FieldCatalog.of(df, labels={"segment": Labels([("Things to sit on", "FURNITURE"), ("cars", "AUTOMOBILE")]), "priority": Labels([("low", "5-LOW")])})
    return run_query(df, 'segment:"things to  sit ON" priority:Low', catalog).select("id")


@query("ql_coerced", f"select id from {RECORDS_SQL} where priority = '1-URGENT' and segment = 'BUILDING'")
def ql_coerced(spark, sf):
    df = order_records(spark, sf)
    catalog = FieldCatalog.of(df, coerce={("segment", "1-URGENT"): "priority"})
    return run_query(df, 'segment:"1-URGENT" segment:BUILDING', catalog).select("id")


@query("ql_old_codes", f"select id from {RECORDS_SQL} where \"type\" = 'F' and (segment = 'BUILDING' or segment = 'MACHINERY')")
def ql_old_codes(spark, sf):
    df = order_records(spark, sf)
    catalog = FieldCatalog.of(df, codes={"MAT": {"closed": "type:F"}, "BIBN": {"heavy": "segment:BUILDING OR segment:MACHINERY"}})
    return run_query(df, "MAT:Closed BIBN:heavy", catalog).select("id")


@query("ql_code_in_code", "select doc_id from documents where (' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ') like '% lang en %'")
def ql_code_in_code(spark, sf):
    catalog = FieldCatalog([Field("text", "text", "text"), Field("lang", "lang")], text=("text",))
    return run_query(read(spark, sf, "documents"), "text:(lang:en)", catalog).select("doc_id")


@query("ql_suggest_query", "select p_partkey from part where (' ' || lower(p_name)) like '% b%' and lower(p_name) like '%e%'")
def ql_suggest_query(spark, sf):
    p = read(spark, sf, "part")
    catalog = FieldCatalog([Field("name", "p_name", "text")], text=("name",))
    return run_query(p, search.suggest_query("b", 1), catalog).where("lower(p_name) like '%e%'").select("p_partkey")


@query("ql_from_node", f"select id from {RECORDS_SQL} where segment = 'BUILDING' and priority = '2-HIGH'")
def ql_from_node(spark, sf):
    df = order_records(spark, sf)
    q = bulk.query_from_node({"customer": {"segment": "BUILDING"}, "priority": "2-HIGH", "other": 1}, {"customer.segment": "segment", "priority": "priority"})
    return run_query(df, q, FieldCatalog.of(df)).select("id")


@query("form_match", "select event_id from events where event_type = 'click' and json_extract_string(props, '$.k')::int = 7")
def form_match(spark, sf):
    data = F.concat(F.lit('{"@type": "'), "event_type", F.lit('", "props": ['), "props", F.lit(', {"k": -1}]}'))
    form = {"@type": "Any", "props": [{"k": 7}]}
    fits = json_udf(lambda r: matches_form(form, r), "boolean")
    exact = json_udf(lambda r: matches_form({"@type": "Interaction", "_match": "Subtypes"}, r, lambda a, b: (a, b) == ("click", "Interaction")), "boolean")
    return read(spark, sf, "events").withColumn("data", data).where(fits("data") & exact("data")).select("event_id")


@query("form_pattern", f"select src from {EDGES_SQL} where relation = 'place' and dst in (select 'N' || n_nationkey from nation where n_regionkey = 2)")
def form_pattern(spark, sf):
    quads = hierarchy_edges(spark, sf).select(F.col("src").alias("s"), F.col("relation").alias("p"), F.col("dst").alias("o"))
    pattern = bulk.link_pattern({"@type": "Any", "place": {"broader": {"@id": "R2"}}})
    return rdf.select_pattern(quads, pattern).select(F.col("n0").alias("src"))


@query("legacy_nested", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_linenumber = 1) and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A' and l_linenumber = 2)")
def legacy_nested(spark, sf):
    o = with_items(spark, sf)
    return o.where(legacy.nested_predicate({"and-items.flag": ["R", "A"], "and-items.line": ["1", "2"], "unknown": ["x"]}, FieldCatalog.of(o, "o_"))).select("o_orderkey")


@query("scores_by_functions", "select doc_id, round(ln(1 + 10 * greatest(coalesce(quality, 0), 0)) * 2.5 + 1 + case when lang = 'en' then 3 else 0 end, 6) score from documents left join labels using (doc_id)")
def scores_by_functions(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    s = search.function_score(F.col("quality"), 2.5) + search.constant_score([(F.col("lang") == "en", 3.0)])
    return d.select("doc_id", F.round(s, 6).alias("score"))


@query("facet_default", f"select \"type\" as \"value\", count(*) n from {RECORDS_SQL} group by 1 order by n desc, 1 limit 10")
def facet_default(spark, sf):
    return search.default_facet(order_records(spark, sf))


@query("facet_ranges", "select case when o_totalprice >= 200000 then 200000.0 when o_totalprice >= 50000 then 50000.0 end as low, case when o_totalprice >= 200000 then null when o_totalprice >= 50000 then 200000.0 else 50000.0 end as high, count(*) n from orders group by 1, 2")
def facet_ranges(spark, sf):
    return search.range_facet(read(spark, sf, "orders"), "o_totalprice", [50000, 200000])


@query("facet_range_template", "select '100000' as \"min\", '300000' as \"max\"")
def facet_range_template(spark, sf):
    o = read(spark, sf, "orders")
    t = search.range_template(FieldCatalog.of(o, "o_"), "totalprice>=100000 totalprice<300000 orderstatus:F", "totalprice")
    return spark.createDataFrame([(t["min"], t["max"])], "min string, max string")


@query("facet_narrower", "select 'N' || c_nationkey as \"value\", count(*) n from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1 group by 1 order by n desc, 1 limit 3")
def facet_narrower(spark, sf):
    counts = read(spark, sf, "customer").groupBy(F.concat(F.lit("N"), "c_nationkey").alias("value")).agg(F.count("*").alias("n"))
    parents = {"N" + str(x["n_nationkey"]): "R" + str(x["n_regionkey"]) for x in read(spark, sf, "nation").collect()}  # a vocabulary: 25 rows at every scale
    return search.facet_page(counts, 3, parents, "R1")


@query("sort_collated", "select p_partkey, p_name from part order by lower(p_name), p_partkey limit 40")
def sort_collated(spark, sf):
    return read(spark, sf, "part").select("p_partkey", "p_name").orderBy(search.collated(F.col("p_name"), "en"), "p_partkey").limit(40)


@query("sort_nested", "select o_orderkey, q from orders left join (select l_orderkey, min(l_quantity) q from lineitem where l_returnflag = 'R' and l_linenumber = 1 group by 1) on l_orderkey = o_orderkey order by q asc nulls last, o_orderkey limit 40")
def sort_nested(spark, sf):
    o = with_items(spark, sf).withColumn("items", F.array_sort("items", lambda a, b: F.when(a["quantity"] < b["quantity"], -1).when(a["quantity"] > b["quantity"], 1).otherwise(0)))
    q = search.nested_sort("items", "quantity", lambda x: (x["flag"] == "R") & (x["line"] == 1))
    return o.select("o_orderkey", q.alias("q")).orderBy(F.col("q").asc_nulls_last(), "o_orderkey").limit(40)


@query("sort_field_forms", "select doc_id from documents order by case when length(text) > 100 then 1 else 0 end, doc_id limit 30")
def sort_field_forms(spark, sf):
    d = read(spark, sf, "documents").withColumn("text_key", F.when(F.length("text") > 100, 1).otherwise(0))
    return d.orderBy(search.sort_field(d, "text"), search.sort_field(d, "doc_id")).limit(30).select("doc_id")


@query("scroll_pages", "select event_id, (row_number() over (order by ts, event_id) - 1) // 400 as page from events")
def scroll_pages(spark, sf):
    return search.scroll(read(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 400).select("event_id", "page")


@query("page_links", "select 0 as \"first\", 40 as previous, 80 as \"next\", (select (count(*) - 1) // 20 * 20 from orders)::int as \"last\"")
def page_links(spark, sf):
    links = search.page_links(read(spark, sf, "orders").count(), 20, 60)
    return spark.createDataFrame([tuple(links.values())], "first int, previous int, next int, last int")


@query("multi_search", f"select 'a' request, id from {RECORDS_SQL} where segment = 'BUILDING' and totalprice > 100000 union all select 'b', id from {RECORDS_SQL} where priority = '5-LOW'")
def multi_search(spark, sf):
    df = order_records(spark, sf)
    return search.multi_search(df, record_catalog(df), {"a": search.Request("segment:BUILDING totalprice>100000"), "b": search.Request('priority:"5-LOW"')}, "id")


@query("intersect_ids", "select distinct l_orderkey id from lineitem where l_returnflag = 'R' and l_orderkey in (select l_orderkey from lineitem where l_linestatus = 'O') and l_orderkey in (select o_orderkey from orders where o_totalprice > 50000)")
def intersect_ids(spark, sf):
    li = read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "id")
    return search.intersect_ids([li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'O'"), read(spark, sf, "orders").where("o_totalprice > 50000").select(F.col("o_orderkey").alias("id"))], "id")

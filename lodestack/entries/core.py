"""Queries over the driver's tables, each with the SQL that gives the same rows.

The tables stand for records as follows: orders (with their customer) are records, line items their
holdings, nations and regions the hierarchy, events the versions of users, documents free text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions import ids, jsonld, scripts, text
from lodestack.functions.jsontree import walk_rows
from lodestack.operators import bulk, cluster, graph, search, shape, stats, store
from lodestack.plans import cql, legacy
from lodestack.plans.catalog import Field, FieldCatalog, Hierarchy
from lodestack.plans.compiler import Compiler
from lodestack.plans.tree import Builder, expand_types, reduce
from lodestack.sources import rdf
from lodestack.sources import records as record_source
from lodestack.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer's segment."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("totalprice"), F.col("o_orderdate").alias("orderdate"), F.col("c_mktsegment").alias("segment"), F.col("o_custkey").alias("custkey"))


RECORDS_SQL = "(select o_orderkey id, o_orderstatus as \"type\", o_orderpriority priority, o_totalprice totalprice, o_orderdate orderdate, c_mktsegment segment, o_custkey custkey from orders join customer on o_custkey = c_custkey)"

TYPES = Hierarchy({"Record": (), "O": ("Record",), "F": ("Record",), "P": ("F",)})


def record_catalog(df: DataFrame) -> FieldCatalog:
    return FieldCatalog.of(df, aliases={"status": "type", "price": "totalprice"}, filters={"furniture": "segment:FURNITURE", "bigFurniture": "furniture totalprice>200000"}, types=TYPES)


def run_query(df: DataFrame, q: str, catalog: FieldCatalog | None = None, arrays: tuple[str, ...] = ()) -> DataFrame:
    catalog = catalog or record_catalog(df)
    tree = expand_types(reduce(Builder(catalog).build(q), catalog.types), catalog.types)
    return df.where(Compiler(catalog, arrays)(tree))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """A text query over records, first page of its hits."""
    df = records(spark, sf)
    request = search.Request('segment:FURNITURE totalprice>100000 (priority:"3-MEDIUM" OR NOT status:F)', facets=[search.Facet("priority")], sort=["-orderdate"])
    return search.search(df, record_catalog(df), request, "id").page


QUERIES["flagship_search"] = flagship
SQL["flagship_search"] = f"select * from {RECORDS_SQL} where segment = 'FURNITURE' and totalprice > 100000 and (priority = '3-MEDIUM' or coalesce(\"type\" not in ('F', 'P'), true)) order by orderdate desc nulls last, id limit 20"


# --- query language -----------------------------------------------------------------------------


@query("ql_and_or_not", f"select id, priority, segment from {RECORDS_SQL} where segment = 'BUILDING' and (priority = '1-URGENT' or not coalesce(\"type\" = 'O', false))")
def ql_and_or_not(spark, sf):
    return run_query(records(spark, sf), "segment:BUILDING AND (priority:\"1-URGENT\" OR NOT type:O)").select("id", "priority", "segment")


@query("ql_range_year", f"select id, orderdate from {RECORDS_SQL} where year(orderdate) between 1995 and 1996 and totalprice >= 150000 and totalprice <= 200000")
def ql_range_year(spark, sf):
    return run_query(records(spark, sf), "orderdate:1995-1996 totalprice>=150000 NOT totalprice>200000").select("id", "orderdate")


@query("ql_partial_date_month", "select l_orderkey, l_linenumber, l_shipdate from lineitem where l_shipdate >= timestamp '1996-02-01' and l_shipdate < timestamp '1996-03-01'")
def ql_partial_date_month(spark, sf):
    li = read(spark, sf, "lineitem")
    return run_query(li, "shipdate:1996-02", FieldCatalog.of(li, "l_")).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("ql_partial_date_week", "select o_orderkey from orders where o_orderdate >= timestamp '1996-03-04' and o_orderdate < timestamp '1996-03-11'")
def ql_partial_date_week(spark, sf):
    o = read(spark, sf, "orders")
    return run_query(o, 'orderdate:"1996-W10"', FieldCatalog.of(o, "o_")).select("o_orderkey")


@query("ql_exists", "select doc_id from documents where text is not null and lang is not null and not (lang = 'en')")
def ql_exists(spark, sf):
    d = read(spark, sf, "documents")
    return run_query(d, "text:* lang:* NOT lang:en", FieldCatalog.of(d)).select("doc_id")


@query("ql_in_subtypes", "with recursive h(term) as (select 'R' || r_regionkey from region where r_name = 'ASIA' union all select 'N' || n_nationkey from nation join h on h.term = 'R' || n_regionkey) select c_custkey from customer where 'N' || c_nationkey in (select term from h)")
def ql_in_subtypes(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    tree = {"R" + str(x["r_regionkey"]): () for x in r.collect()}  # a vocabulary: 5 and 25 rows at every scale
    tree |= {"N" + str(x["n_nationkey"]): ("R" + str(x["n_regionkey"]),) for x in n.collect()}
    asia = [x["r_regionkey"] for x in r.where("r_name = 'ASIA'").collect()]
    c = read(spark, sf, "customer").withColumn("place", F.concat(F.lit("N"), "c_nationkey"))
    catalog = FieldCatalog([Field("place", "place")], types=Hierarchy(tree))
    return c.where(legacy.predicate({"matches-place": [f"R{k}" for k in asia]}, catalog)).select("c_custkey")


@query("ql_filter_alias", f"select id from {RECORDS_SQL} where segment = 'FURNITURE' and totalprice > 200000 and priority = '5-LOW'")
def ql_filter_alias(spark, sf):
    return run_query(records(spark, sf), 'bigFurniture priority:"5-LOW"').select("id")


@query("ql_like_linked_or_blank", "select d.doc_id from documents d left join labels l on d.doc_id = l.doc_id where coalesce(l.quality = 1, false) or (l.quality is null and (' ' || regexp_replace(lower(d.text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ') like '% 1 %')")
def ql_like_linked_or_blank(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return run_query(d, "quality~1", FieldCatalog([Field("quality", "quality", "number", label="text")])).select("doc_id")


def with_items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their line items as an array of structs (a few per order)."""
    items = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("holder"))).alias("items"))
    o = read(spark, sf, "orders")
    return o.join(items, o["o_orderkey"] == items["l_orderkey"], "left").drop("l_orderkey")


@query("ql_nested_same_element", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity > 45)")
def ql_nested_same_element(spark, sf):
    o = with_items(spark, sf)
    return run_query(o, "items.flag:R items.quantity>45", FieldCatalog.of(o, "o_")).select("o_orderkey")


@query("ql_nested_flattened", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def ql_nested_flattened(spark, sf):
    o = with_items(spark, sf)
    catalog = FieldCatalog([Field("flag", "flag", nested="items", flat=True), Field("quantity", "quantity", "number", nested="items", flat=True)])
    return run_query(o, "flag:R quantity>45", catalog).select("o_orderkey")


@query("ql_nested_not", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def ql_nested_not(spark, sf):
    o = with_items(spark, sf)
    return run_query(o, "NOT items.flag:R", FieldCatalog.of(o, "o_")).select("o_orderkey")


@query("ql_composite", "select o_orderkey from orders where o_orderstatus = 'P' or o_orderpriority = 'P' or o_orderpriority = '1-URGENT' or o_orderstatus = '1-URGENT'")
def ql_composite(spark, sf):
    o = read(spark, sf, "orders")
    catalog = FieldCatalog([Field("a", "o_orderstatus"), Field("b", "o_orderpriority"), Field("any", "", parts=("a", "b"))])
    return run_query(o, 'any:(P OR "1-URGENT")', catalog).select("o_orderkey")


@query("ql_cql", f"select id from {RECORDS_SQL} where (segment = 'BUILDING' or segment = 'MACHINERY') and priority = '2-HIGH'")
def ql_cql(spark, sf):
    df = records(spark, sf).withColumns({"seg": F.lower("segment"), "prio": F.lower("priority")})
    q = cql.translate('segment = BUILDING or segment = MACHINERY and priority = "2-HIGH"', {"segment": "seg", "priority": "prio"})
    return run_query(df, q, FieldCatalog.of(df)).select("id")


@query("ql_legacy_params", f"select id from {RECORDS_SQL} where priority in ('1-URGENT', '2-HIGH') and segment <> 'AUTOMOBILE' and ((totalprice >= 1000 and totalprice < 50000) or (totalprice >= 300000 and totalprice < 400000)) and \"type\" is not null")
def ql_legacy_params(spark, sf):
    df = records(spark, sf)
    params = {"priority": ["1-URGENT", "2-HIGH"], "not-segment": ["AUTOMOBILE"], "min-totalprice": ["1000,300000"], "maxEx-totalprice": ["50000,400000"], "exists-type": ["true"], "unknown": ["x"]}
    return df.where(legacy.predicate(params, record_catalog(df))).select("id")


@query("ql_match_missing", "select d.doc_id from documents d left join labels l on d.doc_id = l.doc_id where l.toxic = 0 or l.toxic is null")
def ql_match_missing(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.where(legacy.predicate({"toxic": ["0"]}, FieldCatalog.of(d), match_missing=("toxic",))).select("doc_id")


@query("ql_site_filter", "select page_id, url from pages where starts_with(url, 'https://www.')")
def ql_site_filter(spark, sf):
    return read(spark, sf, "pages").where(legacy.site_filter("https://www.", "url")).select("page_id", "url")


# --- facets, sorting, paging --------------------------------------------------------------------


@query("facet_terms_topn", "select l_shipdate::date::varchar as \"value\", count(*) n from lineitem group by 1 order by n desc, 1 limit 10")
def facet_terms_topn(spark, sf):
    return search.terms(read(spark, sf, "lineitem"), F.col("l_shipdate").cast("date").cast("string"), None)


@query("facet_nested_element_count", "select l_returnflag as \"value\", count(*) n from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'O' group by 1 order by n desc, 1 limit 10")
def facet_nested_element_count(spark, sf):
    o = with_items(spark, sf)
    r = search.search(o, FieldCatalog.of(o, "o_"), search.Request("orderstatus:O", facets=[search.Facet("items.flag", parents=False)]), "o_orderkey")
    return r.facets["items.flag"]


@query("facet_reverse_nested", "select l_returnflag as \"value\", count(distinct l_orderkey) n from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'O' group by 1 order by n desc, 1 limit 10")
def facet_reverse_nested(spark, sf):
    o = with_items(spark, sf)
    r = search.search(o, FieldCatalog.of(o, "o_"), search.Request("orderstatus:O", facets=[search.Facet("items.flag")]), "o_orderkey")
    return r.facets["items.flag"]


@query("facet_sub_slice", f"select parent, \"value\", n from (select segment parent, priority as \"value\", count(*) n, row_number() over (partition by segment order by count(*) desc, priority) rn from {RECORDS_SQL} group by 1, 2) where rn <= 2")
def facet_sub_slice(spark, sf):
    df = records(spark, sf)
    return search.search(df, record_catalog(df), search.Request(facets=[search.Facet("segment", size=2, sub="priority")]), "id").facets["segment"]


@query("facet_multi_select", f"select 'priority' as dimension, priority as \"value\", count(*) n from {RECORDS_SQL} where segment = 'BUILDING' and totalprice > 50000 group by 2 union all select 'segment', segment, count(*) from {RECORDS_SQL} where priority = '1-URGENT' and totalprice > 50000 group by 2")
def facet_multi_select(spark, sf):
    df = records(spark, sf)
    r = search.search(df, record_catalog(df), search.Request('segment:BUILDING priority:"1-URGENT" totalprice>50000', facets=[search.Facet("segment", multi=True), search.Facet("priority", multi=True)]), "id")
    out = [d.select(F.lit(k).alias("dimension"), "value", "n") for k, d in r.facets.items()]
    return out[0].unionByName(out[1])


@query("hits_post_filter", f"select id from {RECORDS_SQL} where segment = 'BUILDING' and priority = '1-URGENT' and totalprice > 50000")
def hits_post_filter(spark, sf):
    df = records(spark, sf)
    return search.search(df, record_catalog(df), search.Request('segment:BUILDING priority:"1-URGENT" totalprice>50000', facets=[search.Facet("segment", multi=True)]), "id").hits.select("id")


@query("facet_predicates", "select 'big' as predicate, count(*) filter (where o_totalprice > 200000) n from orders union all select 'open', count(*) filter (where o_orderstatus = 'O') from orders union all select 'urgent', count(*) filter (where o_orderpriority = '1-URGENT') from orders")
def facet_predicates(spark, sf):
    return search.predicate_counts(read(spark, sf, "orders"), {"big": F.col("o_totalprice") > 200000, "open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority") == "1-URGENT"})


@query("facet_grouping_sets", "select 'l_returnflag' as dimension, l_returnflag as \"value\", count(*) n from lineitem group by 2 union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by 2")
def facet_grouping_sets(spark, sf):
    return search.grouping_sets(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("facet_observation_merge", "select \"value\", sum(n)::bigint n, count(*) > 1 as uncertain from (select o_orderpriority as \"value\", count(*) n from orders where o_orderstatus = 'O' group by 1 union all select o_orderpriority, count(*) from orders where o_totalprice > 300000 group by 1) group by 1")
def facet_observation_merge(spark, sf):
    o = read(spark, sf, "orders")
    a, b = (o.where(w).groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n")) for w in ("o_orderstatus = 'O'", "o_totalprice > 300000"))
    return a.unionByName(b).groupBy("value").agg(F.sum("n").alias("n"), (F.count("*") > 1).alias("uncertain"))


@query("total_hits_page", "select o_orderkey, (select count(*) from orders where o_totalprice > 100000) total from orders where o_totalprice > 100000 order by o_totalprice desc nulls last, o_orderkey limit 20 offset 40")
def total_hits_page(spark, sf):
    o = read(spark, sf, "orders")
    r = search.search(o, FieldCatalog.of(o, "o_"), search.Request("totalprice>100000", sort=["-totalprice"], limit=20, offset=40), "o_orderkey")
    total = r.hits.agg(F.count("*").alias("total"))
    return r.page.select("o_orderkey").crossJoin(F.broadcast(total))  # one row


@query("sort_missing_last_multi", "select d.doc_id, l.quality from documents d left join labels l on d.doc_id = l.doc_id order by l.quality desc nulls last, d.n_chars asc nulls last, d.doc_id limit 50")
def sort_missing_last_multi(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return search.page_of(d, search.sort_columns(["-quality", "n_chars"], FieldCatalog.of(d), "doc_id"), 50).select("doc_id", "quality")


@query("page_keyset", "with k as (select ts, event_id from events order by ts, event_id limit 1 offset 99) select e.event_id from events e, k where e.ts > k.ts or (e.ts = k.ts and e.event_id > k.event_id) order by e.ts, e.event_id limit 30")
def page_keyset(spark, sf):
    e = read(spark, sf, "events")
    k = e.select("ts", "event_id").orderBy("ts", "event_id").offset(99).limit(1).first()
    rows = search.after(e, ("ts", "event_id"), (ts(k["ts"].isoformat(sep=" ")), F.lit(k["event_id"])))
    return rows.orderBy("ts", "event_id").limit(30).select("event_id")


@query("page_desc_with_ties", "select event_id from (select event_id, rank() over (order by ts::date desc) r from events) where r <= 100")
def page_desc_with_ties(spark, sf):
    return feeds.page_with_ties(read(spark, sf, "events").withColumn("day", F.to_date("ts")), "day", None, 100).select("event_id")


@query("suggest_prefix", "select distinct p_name from part where starts_with(lower(p_name), 'b') order by 1 limit 10")
def suggest_prefix(spark, sf):
    return search.suggest(read(spark, sf, "part"), "p_name", "B")


# --- store --------------------------------------------------------------------------------------


@query("store_lookup_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def store_lookup_semi(spark, sf):
    return store.lookup(read(spark, sf, "customer"), read(spark, sf, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("store_left_keep_misses", "select c_custkey, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey group by 1")
def store_left_keep_misses(spark, sf):
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return store.multi_get(o, read(spark, sf, "customer").select("c_custkey"), "c_custkey", keep_misses=True).select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("store_anti_queue", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def store_anti_queue(spark, sf):
    return store.missing(read(spark, sf, "customer"), read(spark, sf, "orders").where("o_orderstatus = 'P'"), "c_custkey", "o_custkey").select("c_custkey")


@query("store_scan_bounded", "select o_orderkey from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1995-06-30' and o_orderstatus = 'F'")
def store_scan_bounded(spark, sf):
    o = read(spark, sf, "orders")
    return store.scan(o, "o_orderdate", ts("1995-01-01"), ts("1995-06-30")).where("o_orderstatus = 'F'").select("o_orderkey")


@query("store_collections", "select distinct o_orderstatus from orders")
def store_collections(spark, sf):
    return read(spark, sf, "orders").select("o_orderstatus").distinct()


@query("asof_before_after", "select user_id, arg_max(event_type, (ts, event_id)) filter (where ts <= timestamp '2024-01-10') as before, arg_max(event_type, (ts, event_id)) filter (where ts <= timestamp '2024-01-20') as \"after\" from events group by 1")
def asof_before_after(spark, sf):
    return store.before_after(read(spark, sf, "events"), "user_id", "ts", "event_id", ts("2024-01-10"), ts("2024-01-20"), "event_type")


@query("asof_single", "select user_id, event_id, event_type from events where ts <= timestamp '2024-01-15' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def asof_single(spark, sf):
    return store.as_of(read(spark, sf, "events"), "user_id", "ts", "event_id", ts("2024-01-15"), ["event_type"]).select("user_id", "event_id", "event_type")


@query("asof_bulk", "select p.event_id, v.event_id asof_event_id, v.event_type asof_event_type from (select * from events where event_type = 'purchase') p left join lateral (select * from events c where c.event_type <> 'purchase' and c.user_id = p.user_id and c.ts <= p.ts order by c.ts desc, c.event_id desc limit 1) v on true")
def asof_bulk(spark, sf):
    e = read(spark, sf, "events")
    out = store.as_of_join(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'"), "user_id", "ts", "ts", "event_id", ["event_id", "event_type"])
    return out.select("event_id", "asof_event_id", "asof_event_type")


@query("version_lag_diff", "select event_id, lag(event_type) over w previous, event_type is distinct from lag(event_type) over w or row_number() over w = 1 changed from events window w as (partition by user_id order by ts, event_id)")
def version_lag_diff(spark, sf):
    return store.changed_from_previous(read(spark, sf, "events"), "user_id", "ts", "event_id", "event_type").select("event_id", "previous", "changed")


@query("version_nth", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 2")
def version_nth(spark, sf):
    return store.nth_version(read(spark, sf, "events"), "user_id", "ts", "event_id", -2).select("user_id", "event_id")


@query("version_interval_and_one_before", "select event_id from events where ts <= timestamp '2024-01-20' qualify ts > timestamp '2024-01-10' or row_number() over (partition by user_id, ts > timestamp '2024-01-10' order by ts desc, event_id desc) = 1")
def version_interval_and_one_before(spark, sf):
    return store.interval_and_one_before(read(spark, sf, "events"), "user_id", "ts", "event_id", ts("2024-01-10"), ts("2024-01-20")).select("event_id")


@query("version_path_owner", "with c as (select *, event_type is distinct from lag(event_type) over w or row_number() over w = 1 ch from events window w as (partition by user_id order by ts, event_id)) select event_id, last_value(case when ch then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as owner from c")
def version_path_owner(spark, sf):
    return store.path_owner(read(spark, sf, "events"), "user_id", "ts", "event_id", "event_type", "event_id").select("event_id", "owner")


@query("upsert_if_changed", "select c.c_custkey, coalesce(n.seg, c.c_mktsegment) c_mktsegment, case when n.k is null then 'keep' when n.seg = c.c_mktsegment then 'same' else 'update' end action from customer c left join (select c_custkey k, case when c_acctbal > 0 then 'BUILDING' else c_mktsegment end seg from customer where c_nationkey < 10) n on n.k = c.c_custkey")
def upsert_if_changed(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    incoming = c.where("c_nationkey < 10").select("c_custkey", F.when(F.col("c_acctbal") > 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return store.upsert(c, incoming, "c_custkey", ["c_mktsegment"])


@query("dataset_diff", "select coalesce(s.k, g.k) id, case when s.k is null then 'create' when g.k is null then 'delete' when s.v is not distinct from g.v then 'same' else 'update' end action from (select o_orderkey k, o_orderstatus v from orders where o_orderpriority <> '5-LOW') s full join (select o_orderkey k, case when o_totalprice > 200000 then 'X' else o_orderstatus end v from orders where o_orderstatus <> 'P') g on s.k = g.k")
def dataset_diff(spark, sf):
    o = read(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    stored = o.where("o_orderpriority <> '5-LOW'").select("id", F.col("o_orderstatus").alias("v"))
    given = o.where("o_orderstatus <> 'P'").select("id", F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus")).alias("v"))
    return store.dataset_diff(stored, given, "id", "v")


@query("set_link_diff", "select * from ((select l_orderkey, l_suppkey, 'removed' change from lineitem where l_linenumber <= 2 except select l_orderkey, l_suppkey, 'removed' from lineitem where l_linenumber >= 2) union all (select l_orderkey, l_suppkey, 'added' from lineitem where l_linenumber >= 2 except select l_orderkey, l_suppkey, 'added' from lineitem where l_linenumber <= 2))")
def set_link_diff(spark, sf):
    li = read(spark, sf, "lineitem")
    return store.link_delta(*(li.where(w).select("l_orderkey", "l_suppkey") for w in ("l_linenumber <= 2", "l_linenumber >= 2")))


@query("counter_deltas", "select l_suppkey, sum(d)::bigint n from (select l_suppkey, 1 d from lineitem union all select l_suppkey, -1 from lineitem where l_returnflag = 'R') group by 1")
def counter_deltas(spark, sf):
    li = read(spark, sf, "lineitem")
    counts = li.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return store.apply_counter_deltas(counts, li.where("l_returnflag = 'R'").select("l_suppkey", F.lit(-1).cast("long").alias("n")), ["l_suppkey"])


@query("chunk_index", "select chunk, count(*) n, min(o_orderkey) as \"first\", max(o_orderkey) as \"last\" from (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 500 chunk from orders) group by 1")
def chunk_index(spark, sf):
    numbered = store.chunks(read(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 500)
    return numbered.groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("ttl_cleaner", "select event_id from events where ts < timestamp '2024-02-01' - interval 20 day")
def ttl_cleaner(spark, sf):
    return feeds.expired(read(spark, sf, "events"), "ts", ts("2024-02-01"), 20).select("event_id")


# --- graph --------------------------------------------------------------------------------------


def hierarchy_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers to nations to regions."""
    n = read(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst"), F.lit("broader").alias("relation"))
    s = read(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("src"), F.concat(F.lit("N"), "s_nationkey").alias("dst"), F.lit("place").alias("relation"))
    c = read(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("dst"), F.lit("home").alias("relation"))
    return n.unionByName(s).unionByName(c)


EDGES_SQL = "(select 'N' || n_nationkey src, 'R' || n_regionkey dst, 'broader' relation from nation union all select 'S' || s_suppkey, 'N' || s_nationkey, 'place' from supplier union all select 'C' || c_custkey, 'N' || c_nationkey, 'home' from customer)"


@query("closure_dependencies", f"with recursive e as (select * from {EDGES_SQL} where relation <> 'home'), c(root, node, depth) as (select 'S' || s_suppkey, 'S' || s_suppkey, 0 from supplier union select root, dst, depth + 1 from c join e on src = node) select root, node, depth from c where depth > 0")
def closure_dependencies(spark, sf):
    start = read(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"))
    return graph.dependencies(hierarchy_edges(spark, sf), start, excluded=("home",))


@query("closure_dependers", f"with recursive e as (select * from {EDGES_SQL}), c(root, node, depth) as (select 'R' || r_regionkey, 'R' || r_regionkey, 0 from region union select root, src, depth + 1 from c join e on dst = node) select root, node, depth from c where depth > 0")
def closure_dependers(spark, sf):
    start = read(spark, sf, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"))
    return graph.dependers(hierarchy_edges(spark, sf), start)


@query("libraries_concerned", "select distinct 'N' || s_nationkey root, l_suppkey holder from lineitem join supplier on l_suppkey = s_suppkey where l_quantity > 40")
def libraries_concerned(spark, sf):
    edges = hierarchy_edges(spark, sf).where("relation = 'place'")
    start = read(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("node"))
    holdings = read(spark, sf, "lineitem").where("l_quantity > 40").select(F.concat(F.lit("S"), "l_suppkey").alias("node"), F.col("l_suppkey").alias("holder")).distinct()
    return graph.holders_concerned(edges, start, holdings)


@query("peel_dependencies", "with e as (select distinct 'N' || n_nationkey src, 'R' || n_regionkey dst from nation union select distinct 'C' || c_custkey, 'N' || c_nationkey from customer), nodes as (select src node from e union select dst from e) select node, case substr(node, 1, 1) when 'C' then 0 when 'N' then (case when exists (select 1 from e x where x.dst = node) then 1 else 0 end) else (select max(case when exists (select 1 from e y where y.dst = x.src) then 2 else 1 end) from e x where x.dst = node) end as round from nodes")
def peel_dependencies(spark, sf):
    e = hierarchy_edges(spark, sf).where("relation <> 'place'")
    return graph.peel(e, e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))))


@query("link_counts_by_relation", f"select dst, relation, count(*) n from {EDGES_SQL} group by 1, 2")
def link_counts_by_relation(spark, sf):
    return graph.count_by_relation(hierarchy_edges(spark, sf))


@query("relation_counts_merged", f"select dst, relation, sum(n)::bigint n from (select dst, case when relation in ('home', 'place') then 'place' else relation end relation, count(*) n from {EDGES_SQL} group by 1, 2) group by 1, 2")
def relation_counts_merged(spark, sf):
    e = hierarchy_edges(spark, sf).withColumn("relation", F.when(F.col("relation") == "home", "instanceOf.place").otherwise(F.col("relation")))
    return graph.merge_relation_counts(graph.count_by_relation(e))


@query("ids_by_links", "select 'C' || c_custkey src from customer where c_nationkey in (1, 2, 3)")
def ids_by_links(spark, sf):
    return graph.ids_by_links(hierarchy_edges(spark, sf), [("home", ["N1", "N2", "N3"])])


@query("embellish_two_levels", "select 'O' || o_orderkey root, 'O' || o_orderkey node, 0 as level, o_orderstatus as \"data\" from orders where o_totalprice > 300000 union all select 'O' || o_orderkey, 'C' || c_custkey, 1, c_mktsegment from orders join customer on o_custkey = c_custkey where o_totalprice > 300000 union all select 'O' || o_orderkey, 'N' || n_nationkey, 2, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 300000 union all select 'O' || a.o_orderkey, 'O' || b.o_orderkey, 2, b.o_orderstatus from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey join customer on a.o_custkey = c_custkey where a.o_totalprice > 300000 and b.o_totalprice > 300000")
def embellish_two_levels(spark, sf):
    o, c, n = read(spark, sf, "orders").where("o_totalprice > 300000"), read(spark, sf, "customer"), read(spark, sf, "nation")
    edges = o.select(F.concat(F.lit("O"), "o_orderkey").alias("src"), F.concat(F.lit("C"), "o_custkey").alias("dst"), F.lit("by").alias("relation")).unionByName(c.select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("dst"), F.lit("home").alias("relation")))
    full = o.select(F.concat(F.lit("O"), "o_orderkey").alias("node"), F.col("o_orderstatus").alias("data")).unionByName(c.select(F.concat(F.lit("C"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("data"))).unionByName(n.select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.col("n_name").alias("data")))
    return graph.embellish(o.select(F.concat(F.lit("O"), "o_orderkey").alias("node")), edges, {"cards": full, "chips": full}, ["cards", "chips"])


# --- shapes, JSON -------------------------------------------------------------------------------


@query("lens_chip_card", "select c_custkey, c_name, c_mktsegment, c_acctbal from customer")
def lens_chip_card(spark, sf):
    lenses = shape.Lenses({"chips": {"Agent": {"show": ["c_name"]}}, "cards": {"Agent": {"extends": ("chips", "Agent"), "show": ["c_mktsegment", "c_acctbal", "c_missing"]}}}, Hierarchy({"Agent": (), "Person": ("Agent",)}))
    return lenses.apply(read(spark, sf, "customer"), "cards", "Person", "c_custkey").select("c_custkey", "lens.*")


@query("json_path", "select event_id, json_extract_string(props, '$.k')::int k from events")
def json_path(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("json_shape", "select event_type shape_type, 'k' as \"key\", json_extract_string(props, '$.k') as \"value\", count(*) n from events where json_extract(props, '$.k') is not null group by 1, 3")
def json_shape(spark, sf):
    return stats.json_shape(read(spark, sf, "events"), "props", "event_type")


@query("json_walk", "select event_id, '/k' as path, json_extract_string(props, '$.k') as \"value\" from events where json_extract(props, '$.k') is not null")
def json_walk(spark, sf):
    return walk_rows(read(spark, sf, "events"), "event_id", "props")


@query("jsonb_containment", "select distinct l_orderkey o_orderkey from lineitem where l_returnflag = 'R' and l_linenumber = 2")
def jsonb_containment(spark, sf):
    return with_items(spark, sf).where(record_source.containment(F.col("items"), {"flag": "R", "line": 2})).select("o_orderkey")


@query("regex_extract_year", "select page_id, case when regexp_extract(url, '(\\d{4})', 1) in ('', '0000', '9999') then null else regexp_extract(url, '(\\d{4})', 1)::int end as \"year\" from pages")
def regex_extract_year(spark, sf):
    return read(spark, sf, "pages").select("page_id", shape.year_of(F.col("url")).alias("year"))


@query("sort_key_clean", "select doc_id, regexp_replace(text, '^[^\\p{L}\\p{N}]+', '') as sort_key from documents")
def sort_key_clean(spark, sf):
    return read(spark, sf, "documents").select("doc_id", shape.sort_key(F.col("text")).alias("sort_key"))


# --- statistics ---------------------------------------------------------------------------------


@query("argmax_per_group", "select event_type, arg_max(event_id, (value, event_id)) best, max(value) as \"value\" from events group by 1")
def argmax_per_group(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("best"), F.max("value").alias("value"))


@query("collect_notes_window", "select user_id, max(ts) latest, string_agg(event_type, ',' order by ts, event_type) notes from events where ts > timestamp '2024-01-05' and ts <= timestamp '2024-01-15' group by 1")
def collect_notes_window(spark, sf):
    out = stats.collect_notes(read(spark, sf, "events"), "user_id", "ts", ts("2024-01-05"), ts("2024-01-15"), F.col("event_type"))
    return out.withColumn("notes", F.array_join("notes", ","))


@query("mode_by_priority", "select source, quality, lang, n from (select source, quality, lang, count(*) n, row_number() over (partition by source order by quality desc, count(*) desc, lang) rn from documents join labels using (doc_id) group by 1, 2, 3) where rn = 1")
def mode_by_priority(spark, sf):
    return cluster.most_common(read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id"), "source", "lang", "quality")


@query("stats_with_examples", "select event_type, count(*) n, min(event_id) example from events group by 1")
def stats_with_examples(spark, sf):
    return stats.counter_with_examples(read(spark, sf, "events"), ["event_type"], "event_id", 1)


@query("threshold_counts_today", "select o_orderpriority, count(*) n, case o_orderpriority when '1-URGENT' then 10 else 500 end threshold, count(*) > case o_orderpriority when '1-URGENT' then 10 else 500 end exceeded from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01' group by 1")
def threshold_counts_today(spark, sf):
    o = run_query(read(spark, sf, "orders"), "orderdate:1996", FieldCatalog.of(read(spark, sf, "orders"), "o_"))
    return stats.threshold_counts(o, "o_orderpriority", {"1-URGENT": 10}, 500)


@query("latency_quantiles", "select event_type, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99 from events group by 1")
def latency_quantiles(spark, sf):
    q = stats.quantiles(read(spark, sf, "events"), "event_type", "value")
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("distinct_holders", "select l_orderkey, count(distinct l_suppkey) n_holders from lineitem group by 1")
def distinct_holders(spark, sf):
    return stats.distinct_holders(read(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


_CRC = "list_reduce([4294967295::bigint] || flatten(list_transform(list_transform(range(1, length(o_orderkey::varchar) + 1), lambda i: ord(substr(o_orderkey::varchar, i, 1))::bigint), lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) end)"
_DIGITS = "0123456789bcdfghjklmnpqrstvwxz"


@query("id_generator", f"with c as (select o_orderkey, xor({_CRC}, 4294967295)::bigint c from orders) select o_orderkey, array_to_string(list_transform(range(6, -1, -1), lambda i: substr('{_DIGITS}', ((c // pow(30, i)::bigint) % 30 + 1)::int, 1)), '') generated from c")
def id_generator(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", ids.checksum_id_column(F.col("o_orderkey").cast("string")).alias("generated"))


# --- duplicates and clusters --------------------------------------------------------------------

_KEY = "md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))"


@query("dedupe_by_keys", f"select d.doc_id, g.group_id, g.n from documents d join (select {_KEY} k, min(doc_id) group_id, count(*) n from documents where text is not null group by 1 having count(*) > 1) g on {_KEY.replace('text', 'd.text')} = g.k")
def dedupe_by_keys(spark, sf):
    return cluster.groups_by_key(read(spark, sf, "documents"), F.md5(text.collapse(F.col("text"))), "doc_id")


@query("dedupe_strategies", "with i as (select 'C' || c_custkey k, c_nationkey a, c_nationkey * 1000 + round(c_acctbal / 500)::bigint b from customer), s as (select 'S' || s_suppkey m, s_nationkey a, s_nationkey * 1000 + round(s_acctbal / 500)::bigint b from supplier), h as (select k, m, 0 strategy from i join s on i.b = s.b union all select k, m, 1 from i join s on i.a = s.a) select distinct k as \"key\", m as \"match\", strategy from (select *, min(strategy) over (partition by k) f from h) where strategy = f")
def dedupe_strategies(spark, sf):
    def keyed(name, p, key):
        return read(spark, sf, name).select(F.concat(F.lit(p.upper()), f"{p}_{key}").alias("k"), F.col(f"{p}_nationkey").alias("a"), (F.col(f"{p}_nationkey") * 1000 + F.round(F.col(f"{p}_acctbal") / 500).cast("long")).alias("b"))

    return cluster.duplicates_by_keys(keyed("customer", "c", "custkey"), keyed("supplier", "s", "suppkey"), [("b", "b"), ("a", "a")], "k")


_LETTERS = "regexp_replace(lower(text), '[^a-z]+', '', 'g')"


@query("cluster_components", f"with recursive v as (select doc_id, {_KEY} k from documents where text is not null union all select doc_id, 'p' || md5({_LETTERS}) from documents where {_LETTERS} <> ''), s as (select k, min(doc_id) m from v group by 1), e as (select v.doc_id a, s.m b from v join s using (k) union select s.m, v.doc_id from v join s using (k)), c(root, node) as (select doc_id, doc_id from documents union select root, b from c join e on a = node) select root as doc_id, min(node) component from c group by 1")
def cluster_components(spark, sf):
    d = read(spark, sf, "documents")
    letters = F.nullif(F.regexp_replace(F.lower("text"), "[^a-z]+", ""), F.lit(""))
    return cluster.components_by_keys(d, [F.md5(text.collapse(F.col("text"))), F.concat(F.lit("p"), F.md5(letters))], "doc_id")


@query("cluster_greedy_block")
def cluster_greedy_block(spark, sf):
    p = read(spark, sf, "part").withColumn("block", F.concat("p_brand", "p_size"))
    return cluster.greedy_partition(p, "block", "p_partkey", "p_type", lambda a, b: bool(set(a.split()) & set(b.split())), F.split("p_type", " "))


@query("merge_works", "select l_orderkey, arg_min(l_returnflag, (l_linenumber, l_returnflag)) l_returnflag, string_agg(distinct l_linestatus, ',' order by l_linestatus) statuses from lineitem group by 1")
def merge_works(spark, sf):
    li = read(spark, sf, "lineitem").withColumn("statuses", F.array("l_linestatus"))
    return cluster.merge_fields(li, "l_orderkey", "l_linenumber", ["l_returnflag"], ["statuses"]).withColumn("statuses", F.array_join("statuses", ","))


@query("shape_clusters", "select p_brand shape_key, count(distinct p_type || '|' || p_size) n_shapes, count(*) n from part group by 1 having count(distinct p_type || '|' || p_size) >= 2")
def shape_clusters(spark, sf):
    return cluster.shape_clusters(read(spark, sf, "part"), F.col("p_brand"), ["p_type", "p_size"])


# --- text ---------------------------------------------------------------------------------------

_PADDED = "(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ')"


def text_catalog() -> FieldCatalog:
    return FieldCatalog([Field("text", "text", "text"), Field("lang", "lang"), Field("source", "source")], text=("text",))


@query("text_tokens_and", f"select doc_id from documents where {_PADDED} like '% the %' and {_PADDED} like '% with %' and lang = 'en'")
def text_tokens_and(spark, sf):
    return run_query(read(spark, sf, "documents"), "the with lang:en", text_catalog()).select("doc_id")


@query("text_phrase", f"select doc_id from documents where {_PADDED} like '% of the %' and not coalesce({_PADDED} like '% by the %', false)")
def text_phrase(spark, sf):
    return run_query(read(spark, sf, "documents"), '"of the" NOT text:"by the"', text_catalog()).select("doc_id")


@query("text_prefix", f"select doc_id from documents where {_PADDED} like '% ofan%'")
def text_prefix(spark, sf):
    return run_query(read(spark, sf, "documents"), "ofan*", text_catalog()).select("doc_id")


@query("text_score_topk", "with t as (select doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) ws, lower(text) low from documents), s as (select doc_id, 2.0 * ((list_contains(ws, 'the'))::int + (list_contains(ws, 'and'))::int) / greatest(len(ws), 2) + case when contains(low, 'the and') then 1.0 else 0.0 end sc from t) select doc_id, round(sc, 6) score from s order by round(sc, 6) desc, doc_id limit 25")
def text_score_topk(spark, sf):
    d = read(spark, sf, "documents")
    s = search.score(F.col("text"), ["the", "and"], {"text": (F.col("text"), 2.0)})
    return d.select("doc_id", F.round(s, 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(25)


@query("spell_candidates", "select word, df, distance from (select word, count(*) df, levenshtein(word, 'blot') distance from (select distinct p_partkey, unnest(string_split(lower(p_name), ' ')) word from part) group by word) where distance <= 2")
def spell_candidates(spark, sf):
    words = read(spark, sf, "part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return search.spelling(words, "blot")


@query("norm_text", "select doc_id, strip_accents(regexp_replace(text, '[“”„‟«»″]', '\"', 'g')) plain from documents")
def norm_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.strip_marks_udf(text.normalize_for_search_udf("text")).alias("plain"))


@query("isbn_forms", "select k, (case when (11 - t % 11) % 11 = 10 then 'X' else ((11 - t % 11) % 11)::varchar end) as check_digit from (select p_partkey k, list_sum(list_transform(range(0, 9), lambda i: substr(lpad(p_partkey::varchar, 9, '0'), i + 1, 1)::int * (10 - i)))::bigint t from part)")
def isbn_forms(spark, sf):
    p = read(spark, sf, "part").withColumn("isbn", F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("0")))
    return p.select(F.col("p_partkey").alias("k"), F.substring(ids.isbn10(F.col("isbn")), 10, 1).alias("check_digit"))


# --- feeds and streams --------------------------------------------------------------------------


@query("feed_activity_batch", "select event_id, case when event_type = 'error' then 'delete' when row_number() over (partition by user_id order by ts, event_id) = 1 then 'create' else 'update' end activity from events")
def feed_activity_batch(spark, sf):
    return feeds.activities(read(spark, sf, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error").select("event_id", "activity")


@query("feed_harvest_page", "select event_id from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-25' order by ts, event_id limit 100")
def feed_harvest_page(spark, sf):
    return feeds.harvest(read(spark, sf, "events"), "ts", "event_id", ts("2024-01-05"), ts("2024-01-25"), None, 100).select("event_id")


@query("feed_digest", "select user_id % 7 as subscriber, user_id, string_agg(distinct event_type, ',' order by event_type) categories, max(ts) latest from events where ts > timestamp '2024-01-10' and event_type in ('error', 'purchase') and ((user_id % 7 < 4 and event_type = 'error') or event_type = 'purchase') group by 1, 2")
def feed_digest(spark, sf):
    e = read(spark, sf, "events").withColumn("s", F.col("user_id") % 7)
    subs = spark.range(7).select(F.col("id").alias("subscriber"), F.explode(F.when(F.col("id") < 4, F.array(F.lit("error"), F.lit("purchase"))).otherwise(F.array(F.lit("purchase")))).alias("category"))
    out = feeds.digest(e.withColumnRenamed("s", "subscriber"), subs, "user_id", "event_type", "ts", ts("2024-01-10"))
    return out.withColumn("categories", F.array_join("categories", ","))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.read_stream(spark, sf, read(spark, sf, "events").schema, "events.parquet")


@query("stream_counters", "select event_type, sum(case when value > 50 then 1 else -1 end)::bigint n from events group by 1")
def stream_counters(spark, sf):
    return feeds.drain(feeds.counter_stream(_stream(spark, sf), ["event_type"], F.when(F.col("value") > 50, 1).otherwise(-1)), "counters", "complete")


@query("stream_window", "select time_bucket(interval '1 day', ts) window_start, time_bucket(interval '1 day', ts) + interval 1 day window_end, event_type, count(*) n from events group by 1, 2, 3")
def stream_window(spark, sf):
    stream = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = feeds.drain(feeds.windowed_stream(stream, "ts", "1 day", ["event_type"], "value"), "windows", "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")


@query("session_windows", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, min(ts) session_start, count(*) n from s group by user_id, k")
def session_windows(spark, sf):
    return feeds.sessions(read(spark, sf, "events"), "ts", "6 hours", ["user_id"]).select("user_id", "session_start", "n")


@query("rank_top_per_parent", "select l_suppkey, l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) <= 3")
def rank_top_per_parent(spark, sf):
    w = W.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    return read(spark, sf, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("facet_tree", f"select 'segment' path, segment as \"value\", count(*) n from {RECORDS_SQL} where priority = '2-HIGH' group by 2 union all select 'segment.type', \"type\", count(*) from {RECORDS_SQL} where segment = 'BUILDING' and priority = '2-HIGH' group by 2 union all select 'priority', priority, count(*) from {RECORDS_SQL} where segment = 'BUILDING' group by 2")
def facet_tree(spark, sf):
    df = records(spark, sf)
    return search.facet_tree(df, record_catalog(df), {"segment": {"sub": {"type": {}}}, "priority": {}}, {"segment": "BUILDING", "priority": "2-HIGH"})


@query("classification_prefix", "with t(prefix, mapped) as (values ('Brand#1', 'one'), ('Brand#2', 'two'), ('Brand#12', 'twelve')) select p_partkey, (select mapped from t where starts_with(p_brand, prefix) order by length(prefix) desc limit 1) mapped from part")
def classification_prefix(spark, sf):
    table = spark.createDataFrame([("Brand#1", "one"), ("Brand#2", "two"), ("Brand#12", "twelve")], "prefix string, mapped string")
    return scripts.map_by_prefix(read(spark, sf, "part"), "p_brand", table).select("p_partkey", "mapped")


@query("rdf_statements", "select 'http://e/' || event_id s, 'http://v/k' p, json_extract_string(props, '$.k') o from events where json_extract(props, '$.k') is not null")
def rdf_statements(spark, sf):
    e = read(spark, sf, "events").where(F.get_json_object("props", "$.k").isNotNull())
    docs = e.select(F.concat(F.lit('{"@id": "http://e/'), "event_id", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("data"), F.lit("g").alias("graph"))
    return jsonld.to_quads(docs, "data", {"@vocab": "http://v/"}, "graph").select("s", "p", "o")


@query("bulk_script", "select event_id, 'update' as action from events where json_extract_string(props, '$.k')::int < 50 and json_extract_string(props, '$.k')::int >= 10 union all select event_id, 'delete' from events where json_extract_string(props, '$.k')::int < 10")
def bulk_script(spark, sf):
    def script(record: dict) -> dict | None:
        if isinstance(record.get("k"), int) and record["k"] < 50:
            return None if record["k"] < 10 else record | {"small": True}
        return record

    return bulk.run_script(read(spark, sf, "events"), "event_id", "props", script).select("event_id", "action")


@query("graph_pattern", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE'")
def graph_pattern(spark, sf):
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    quads = (
        c.select(F.concat(F.lit("C"), "c_custkey").alias("s"), F.lit("home").alias("p"), F.concat(F.lit("N"), "c_nationkey").alias("o"))
        .unionByName(n.select(F.concat(F.lit("N"), "n_nationkey").alias("s"), F.lit("in").alias("p"), F.concat(F.lit("R"), "n_regionkey").alias("o")))
        .unionByName(n.select(F.concat(F.lit("N"), "n_nationkey").alias("s"), F.lit("name").alias("p"), F.col("n_name").alias("o")))
        .unionByName(r.select(F.concat(F.lit("R"), "r_regionkey").alias("s"), F.lit("name").alias("p"), F.col("r_name").alias("o")))
    )
    found = rdf.select_pattern(quads, [("?c", "home", "?n"), ("?n", "in", "?r"), ("?r", "name", "EUROPE"), ("?n", "name", "?name")])
    return found.select(F.substring("c", 2, 20).cast("long").alias("c_custkey"), F.col("name").alias("n_name"))

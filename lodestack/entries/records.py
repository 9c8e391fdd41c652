"""Queries on the store: scans, loaders, files, deletes, versions, index documents, feeds, queues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.entries.core import EDGES_SQL, hierarchy_edges, query, read, ts
from lodestack.operators import graph, search, store, upkeep
from lodestack.scratch import new_path
from lodestack.sources import marc, marcframe, rdf, records, sinks
from lodestack.streaming import feeds


def order_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as JSON records: item 0 describes the record, item 1 the order."""
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")

    def iri(prefix, column):
        return F.concat(F.lit(prefix + "/"), column)

    record = F.struct(iri("r", k).alias("@id"), F.lit("Record").alias("@type"), F.struct(iri("t", k).alias("@id")).alias("mainEntity"), F.array(F.struct(iri("a", k).alias("@id"))).alias("sameAs"))
    thing = F.struct(iri("t", k).alias("@id"), F.col("o_orderstatus").alias("@type"), F.struct(iri("c", F.col("o_custkey")).alias("@id")).alias("heldBy"))
    return o.select(F.concat(F.lit('{"@graph":['), F.to_json(record), F.lit(","), F.to_json(thing), F.lit("]}")).alias("data"))


def order_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return records.identifiers(records.promote(order_docs(spark, sf)))


IDENTIFIERS_SQL = "(select 'r/' || o_orderkey id, 'r/' || o_orderkey iri, 0 graph_index, true main_id from orders union all select 'r/' || o_orderkey, 'a/' || o_orderkey, 0, false from orders union all select 'r/' || o_orderkey, 't/' || o_orderkey, 1, true from orders)"


@query("scan_collection", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1996-01-01'")
def scan_collection(spark, sf):
    return store.scan(read(spark, sf, "orders"), "o_orderdate", ts("1996-01-01"), collection=("o_orderstatus", "F")).select("o_orderkey")


@query("scan_by_type", "select 'r/' || o_orderkey record_id, 't/' || o_orderkey thing_id, 'c/' || o_custkey held_by from orders where o_orderstatus = 'F'")
def scan_by_type(spark, sf):
    return records.promote(order_docs(spark, sf)).where("type = 'F'").select("record_id", "thing_id", "held_by")


@query("record_identifiers", f"select * from {IDENTIFIERS_SQL}")
def record_identifiers(spark, sf):
    return order_identifiers(spark, sf)


@query("main_ids", f"select a.iri, b.iri main from {IDENTIFIERS_SQL} a join {IDENTIFIERS_SQL} b on a.id = b.id and a.graph_index = b.graph_index and b.main_id")
def main_ids(spark, sf):
    i = order_identifiers(spark, sf)
    main = i.where("main_id").select("id", "graph_index", F.col("iri").alias("main"))
    return i.join(main, ["id", "graph_index"]).select("iri", "main")


@query("lookup_by_iri", "select 'a/' || o_orderkey iri, 'r/' || o_orderkey id from orders where o_orderpriority = '1-URGENT'")
def lookup_by_iri(spark, sf):
    wanted = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("a/"), "o_orderkey").alias("iri"))
    return store.multi_get(order_identifiers(spark, sf), wanted, "iri").select("iri", "id")


@query("scan_by_sql", "select o_orderkey from orders where o_totalprice > 100000 and o_orderstatus = 'O'")
def scan_by_sql(spark, sf):
    return records.select_by_sql(read(spark, sf, "orders"), "o_totalprice > 100000 and o_orderstatus = 'O'").select("o_orderkey")


@query("load_named_sql", "select c_custkey from customer where c_acctbal > 1000 and c_mktsegment = 'BUILDING'")
def load_named_sql(spark, sf):
    return records.load_sql(spark, f"select c_custkey from parquet.`{sf}/customer.parquet` where c_acctbal > :least and c_mktsegment = :segment", least=1000, segment="BUILDING")


@query("dataset_ids", "select doc_id from documents where coalesce(lang = 'de', false) or coalesce(source = 'de', false)")
def dataset_ids(spark, sf):
    d = read(spark, sf, "documents").withColumn("datasets", F.array("lang", "source"))
    return records.in_dataset(d, "datasets", "de").select("doc_id")


@query("json_lines_file", "select event_id, event_type from events")
def json_lines_file(spark, sf):
    path = new_path(spark, "lines")
    sinks.write_json_lines(read(spark, sf, "events").select("event_id", "event_type"), path)
    return records.read_json_lines(spark, path, "event_id long, event_type string")


@query("id_list_file", "select distinct o_custkey::varchar id from orders")
def id_list_file(spark, sf):
    path = new_path(spark, "ids")
    sinks.write_lines(read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id")).distinct(), "id", path)
    return records.read_id_list(spark, path)


@query("cluster_lines_file", "select min('N' || n_nationkey) over (partition by n_regionkey) as cluster, 'N' || n_nationkey id from nation")
def cluster_lines_file(spark, sf):
    path = new_path(spark, "clusters")
    lines = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.concat(F.lit("N"), "n_nationkey")))).alias("line"))
    sinks.write_lines(lines.select("line").distinct(), "line", path)
    return records.read_clusters(spark, path)


def nation_quads(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    none, s, g = F.lit(None).cast("string"), F.concat(F.lit("http://e/N"), "n_nationkey"), F.concat(F.lit("http://e/R"), "n_regionkey")
    name = n.select(s.alias("s"), F.lit("http://v/name").alias("p"), F.concat(F.lit('a "quoted"\t\\ '), "n_name").alias("o"), F.lit("literal").alias("o_type"), none.alias("datatype"), F.lit("en").alias("lang"), g.alias("g"))
    part = n.select(s.alias("s"), F.lit("http://v/in").alias("p"), g.alias("o"), F.lit("iri").alias("o_type"), none.alias("datatype"), none.alias("lang"), g.alias("g"))
    return name.unionByName(part)


QUADS_SQL = "(select 'http://e/N' || n_nationkey s, 'http://v/name' p, 'a \"quoted\"' || chr(9) || '\\ ' || n_name o, 'literal' o_type, 'en' lang, 'http://e/R' || n_regionkey g from nation union all select 'http://e/N' || n_nationkey, 'http://v/in', 'http://e/R' || n_regionkey, 'iri', null, 'http://e/R' || n_regionkey from nation)"


@query("nquads_file", f"select s, p, o, o_type, lang, g from {QUADS_SQL}")
def nquads_file(spark, sf):
    path = new_path(spark, "quads")
    rdf.nquad_lines(nation_quads(spark, sf)).write.text(path)
    return rdf.read_nquads(spark, path).select("s", "p", "o", "o_type", "lang", "g")


@query("trig_documents", f"select s, p, o, o_type, lang, g from {QUADS_SQL}")
def trig_documents(spark, sf):
    def there_and_back(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(None if pd.isna(x) else x for x in r) for r in pdf[["s", "p", "o", "o_type", "datatype", "lang"]].itertuples(index=False)]
        found = list(rdf.parse_trig(rdf.trig({pdf["g"].iloc[0]: rows}, {"e": "http://e/", "v": "http://v/"})))
        return pd.DataFrame([(s, p, o, kind, lang, g) for s, p, o, kind, _, lang, g in found], columns=["s", "p", "o", "o_type", "lang", "g"], dtype=object)

    return nation_quads(spark, sf).groupBy("g").applyInPandas(there_and_back, "s string, p string, o string, o_type string, lang string, g string")


@query("graph_sync", f"select s, p, o, g from {QUADS_SQL} where g not in ('http://e/R1', 'http://e/R2') union all select s, p, 'new', g from {QUADS_SQL} where g = 'http://e/R1' and p = 'http://v/name'")
def graph_sync(spark, sf):
    quads = nation_quads(spark, sf).select("s", "p", "o", "g")
    changed = quads.where("g = 'http://e/R1' and p = 'http://v/name'").withColumn("o", F.lit("new"))
    return sinks.sync_graphs(quads, changed, quads.where("g = 'http://e/R2'"))


def part_marc(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as MARC records in JSON."""
    p = read(spark, sf, "part")
    sub = F.array(F.to_json(F.struct(F.col("p_name").alias("a"))), F.to_json(F.struct(F.col("p_brand").alias("c"))))
    fields = F.concat(F.lit('{"leader":"00000nam a2200000 a 4500","fields":[{"001":"'), "p_partkey", F.lit('"},{"245":{"ind1":"1","ind2":"0","subfields":['), F.array_join(sub, ","), F.lit("]}}]}"))
    return p.select("p_partkey", fields.alias("marc"))


@query("marc_forms", "select p_partkey, p_partkey::varchar control, p_name title, p_brand brand from part")
def marc_forms(spark, sf):
    import json

    def run(batches):
        for pdf in batches:
            rows = []
            for key, text in pdf.itertuples(index=False):
                record = marc.parse_iso2709(marc.format_iso2709(json.loads(text)))
                (record,) = marc.from_xml(f"<collection>{marc.to_xml(record)}</collection>")
                sub = record["fields"][1]["245"]["subfields"]
                rows.append((key, record["fields"][0]["001"], sub[0]["a"], sub[1]["c"]))
            yield pd.DataFrame(rows, columns=["p_partkey", "control", "title", "brand"])

    return part_marc(spark, sf).mapInPandas(run, "p_partkey long, control string, title string, brand string")


@query("marc_usage", "select '001' tag, '' code, count(*) n from part union all select '245', 'a', count(*) from part union all select '245', 'c', count(*) from part")
def marc_usage(spark, sf):
    return marc.usage(part_marc(spark, sf))


@query("marc_to_linked", "select p_partkey, p_partkey::varchar control, p_name title, p_brand responsibility from part")
def marc_to_linked(spark, sf):
    frame = marcframe.MarcFrame([{"tag": "001", "property": "controlNumber", "about": "record"}, {"tag": "245", "link": "hasTitle", "type": "Title", "subfields": {"a": "mainTitle", "c": "responsibility"}}])
    out = marcframe.convert_column(part_marc(spark, sf), "p_partkey", "marc", frame)
    return out.select("p_partkey", F.get_json_object("data", "$.record.controlNumber").alias("control"), F.get_json_object("data", "$.thing.hasTitle.mainTitle").alias("title"), F.get_json_object("data", "$.thing.hasTitle.responsibility").alias("responsibility"))


@query("store_copy", f"with w as (select 'S' || s_suppkey node from supplier where s_acctbal > 3000 union select 'N' || s_nationkey from supplier where s_acctbal > 3000 union select 'R' || n_regionkey from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 3000) select 'record' kind, node from w union all select 'version', node from w")
def store_copy(spark, sf):
    edges = hierarchy_edges(spark, sf).where("relation <> 'home'")
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    chosen = read(spark, sf, "supplier").where("s_acctbal > 3000").select(F.concat(F.lit("S"), "s_suppkey").alias("node"))
    a, b = upkeep.copy_selection(nodes, nodes, edges, chosen, "node")
    return a.select(F.lit("record").alias("kind"), "node").unionByName(b.select(F.lit("version").alias("kind"), "node"))


@query("harvest_client", "with d as (select user_id, event_id, event_type from events where ts <= timestamp '2024-01-15' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1), l as (select user_id, event_id, event_type from events where ts > timestamp '2024-01-15' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) select * from l where event_type <> 'error' union all select * from d where user_id not in (select user_id from l)")
def harvest_client(spark, sf):
    e = read(spark, sf, "events")
    dump = store.as_of(e, "user_id", "ts", "event_id", ts("2024-01-15"), ["event_type"]).select("user_id", "event_id", "event_type")
    new = feeds.activities(e.where(F.col("ts") > ts("2024-01-15")), "user_id", "ts", "event_id", F.col("event_type") == "error")
    return feeds.apply_activities(dump, new, "user_id", ["ts", "event_id"])


@query("targets_merged", "with c as (select c_nationkey k, min(c_name) \"name\" from customer where c_acctbal > 9000 group by 1), s as (select s_nationkey k, min(s_name) \"name\" from supplier group by 1) select k, \"name\", 'customers' target from c union all select k, \"name\", 'suppliers' from s where k not in (select k from c)")
def targets_merged(spark, sf):
    c = read(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
    s = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    return search.merged_targets([("customers", c), ("suppliers", s)], "k")


@query("soft_delete", "select c_custkey, c_nationkey < 5 deleted from customer")
def soft_delete(spark, sf):
    c = read(spark, sf, "customer")
    return upkeep.soft_delete(c, hierarchy_edges(spark, sf), c.where("c_nationkey < 5"), "c_custkey")[0].select("c_custkey", "deleted")


@query("soft_delete_edges", f"select src, dst, relation from {EDGES_SQL} where src not in (select 'C' || c_custkey from customer where c_nationkey < 5)")
def soft_delete_edges(spark, sf):
    ids = read(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), "c_nationkey")
    return upkeep.soft_delete(ids, hierarchy_edges(spark, sf), ids.where("c_nationkey < 5"), "id")[1].select("src", "dst", "relation")


@query("version_append", "select event_id from (select event_id, ts, event_type, lag(event_type) over w before, row_number() over w n from events window w as (partition by user_id order by ts, event_id)) where ts <= timestamp '2024-01-15' or n = 1 or event_type <> before")
def version_append(spark, sf):
    e = read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return upkeep.append_versions(e.where(F.col("ts") <= ts("2024-01-15")), e.where(F.col("ts") > ts("2024-01-15")), "user_id", "ts", "event_id", ["event_type"]).select("event_id")


@query("state_latest", "select user_id, arg_max(event_id, (ts, event_id)) event_id, arg_max(value, (ts, event_id)) as \"value\" from events group by 1")
def state_latest(spark, sf):
    return store.latest_writes(read(spark, sf, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("evict_cache", "select 'O' || o_orderkey id from orders join customer on o_custkey = c_custkey where c_nationkey >= 3")
def evict_cache(spark, sf):
    cache = read(spark, sf, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("id"), F.array(F.concat(F.lit("C"), "o_custkey")).alias("ids"))
    changed = read(spark, sf, "customer").where("c_nationkey < 3").select(F.concat(F.lit("C"), "c_custkey").alias("id"))
    return store.evict(cache, "ids", changed, "id").select("id")


@query("rebuild_edges", "select 'r/' || o_orderkey src, '@graph.mainEntity' relation, 'r/' || o_orderkey dst from orders union all select 'r/' || o_orderkey, '@graph.sameAs', 'r/' || o_orderkey from orders union all select 'r/' || o_orderkey, '@graph.heldBy', 'cust' || o_custkey from orders")
def rebuild_edges(spark, sf):
    docs = records.promote(order_docs(spark, sf)).select("record_id", "data")
    known = order_identifiers(spark, sf).select("iri", "id").unionByName(read(spark, sf, "customer").select(F.concat(F.lit("c/"), "c_custkey").alias("iri"), F.concat(F.lit("cust"), "c_custkey").alias("id")))
    return graph.rebuild_edges(docs, "record_id", "data", known)


@query("index_errors", "select doc_id, case when text is null then 'no body' else 'too large' end error from documents where text is null or strlen(text) > 2000")
def index_errors(spark, sf):
    return upkeep.index_documents(read(spark, sf, "documents"), "doc_id", "text", 2000)[1]


@query("reindex_counts", "select lang, count(*) filter (where strlen(text) <= 2000) n, count(*) filter (where text is null or strlen(text) > 2000) failed from documents group by 1")
def reindex_counts(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text", "lang")
    return upkeep.reindex(d, "doc_id", "text", new_path(spark, "index"), "lang", 2000)


@query("reindex_affected", "select distinct 'N1' id, 'removed' reason from customer where c_nationkey = 1 union all select distinct 'N2', 'added' from customer where c_nationkey = 1 union all select 'O' || o_orderkey, 'part' from orders join customer on o_custkey = c_custkey where c_nationkey = 1")
def reindex_affected(spark, sf):
    held = read(spark, sf, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("src"), F.concat(F.lit("C"), "o_custkey").alias("dst"), F.lit("by").alias("relation"))
    before = hierarchy_edges(spark, sf).unionByName(held)
    after = before.withColumn("dst", F.when((F.col("relation") == "home") & (F.col("dst") == "N1"), "N2").otherwise(F.col("dst")))
    return upkeep.propagation(before, after, ("by",))


@query("oai_page", "select event_id, '<record>' || case when event_type = 'error' then '<header status=\"deleted\">' else '<header>' end || '<identifier>' || event_id || '</identifier><datestamp>' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '</datestamp></header>' || case when event_type = 'error' then '' else '<metadata><type>' || event_type || '</type></metadata>' end || '</record>' as \"value\" from (select * from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-25' order by ts, event_id limit 100)")
def oai_page(spark, sf):
    page = feeds.harvest(read(spark, sf, "events"), "ts", "event_id", ts("2024-01-05"), ts("2024-01-25"), None, 100)
    page = page.withColumns({"gone": F.col("event_type") == "error", "xml": F.concat(F.lit("<type>"), "event_type", F.lit("</type>"))})
    return sinks.oai_records(page, "event_id", "ts", "xml", "gone")


@query("dump_page", "select o_orderkey from orders order by o_orderkey limit 25 offset 30")
def dump_page(spark, sf):
    return sinks.dump_page(read(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 30, 25)


@query("report_file", "select event_type, count(*)::varchar n from events group by 1")
def report_file(spark, sf):
    path = sinks.write_report(read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")), new_path(spark, "reports"), "types")
    return spark.read.option("sep", "\t").option("header", True).csv(path)


@query("queue_take", "select user_id, min(ts) ts from events where event_type in ('click', 'view') group by 1 order by 2, 1 limit 20")
def queue_take(spark, sf):
    state = F.when(F.col("event_type") == "click", "NEW").when(F.col("event_type") == "view", "REQUEUED").otherwise("FAILED")
    return upkeep.queue_take(read(spark, sf, "events").withColumn("state", state), "user_id", "ts", 20).select("user_id", "ts")


@query("queue_settle", "select event_id, least(value, 2)::int + case when event_type = 'view' then 1 else 0 end failures, case when event_type = 'error' then 'NEW' when event_type = 'view' then case when least(value, 2)::int + 1 >= 3 then 'FAILED' else 'REQUEUED' end else 'WAIT' end as state from (select event_id, event_type, floor(value / 40) as value from events) where event_type <> 'click'")
def queue_settle(spark, sf):
    e = read(spark, sf, "events")
    queue = e.select("event_id", F.lit("WAIT").alias("state"), F.least(F.floor(F.col("value") / 40), F.lit(2)).cast("int").alias("failures"))
    outcome = F.when(F.col("event_type") == "click", "HANDLED").when(F.col("event_type") == "view", "FAIL_REQUEUE").when(F.col("event_type") == "error", "FAIL_RETRY")
    return upkeep.queue_settle(queue, e.select("event_id", outcome.alias("outcome")).where("outcome is not null"), "event_id").select("event_id", "failures", "state")


@query("access_rows", "select c_custkey from customer where (c_mktsegment = 'BUILDING' and c_nationkey::varchar = '3') or c_mktsegment = 'MACHINERY'")
def access_rows(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("collection"), F.col("c_nationkey").cast("string").alias("holder"))
    return c.where(upkeep.allowed({"3": {"BUILDING"}, "*": {"MACHINERY"}})).select("c_custkey")


@query("schedule_due", "select h::int h from (select unnest(range(0, 24)) h) where h % 6 = 0")
def schedule_due(spark, sf):
    import datetime as dt

    rows = [(h,) for h in range(24) if upkeep.due("0 */6 * * 1-5", dt.datetime(2024, 1, 10, h, 0))]
    return spark.createDataFrame(rows, "h int")


@query("card_changes", "select event_id from (select event_id, event_type, lag(event_type) over w before, row_number() over w n from events window w as (partition by user_id order by ts, event_id)) where n > 1 and event_type <> before")
def card_changes(spark, sf):
    return feeds.card_changes(read(spark, sf, "events"), "user_id", "ts", "event_id", F.col("event_type")).select("event_id")


@query("version_history", "select event_id, row_number() over (partition by user_id order by ts, event_id) as version from events")
def version_history(spark, sf):
    return store.history(read(spark, sf, "events"), "user_id", "ts", "event_id").select("event_id", "version")


@query("archive_oldest", "select event_id, 'old' part from (select * from events where ts < timestamp '2024-01-10' order by ts, event_id limit 50) union all select event_id, 'rest' from events where event_id not in (select event_id from events where ts < timestamp '2024-01-10' order by ts, event_id limit 50)")
def archive_oldest(spark, sf):
    old, rest = store.archive(read(spark, sf, "events"), "ts", ts("2024-01-10"), ["ts", "event_id"], 50)
    return old.select("event_id", F.lit("old").alias("part")).unionByName(rest.select("event_id", F.lit("rest").alias("part")))

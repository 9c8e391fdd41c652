"""Queries on scalar functions over texts, identifiers, dates and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.entries.core import query, read
from lodestack.functions import ids, scripts, text, uris
from lodestack.functions.jsontree import json_udf


@query("trimmed_noise", "select p_partkey, p_name trimmed from part")
def trimmed_noise(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.trim_noise(F.concat(F.lit(" .,; "), "p_name", F.lit(" :/ "))).alias("trimmed"))


@query("guessed_scripts", "select n_nationkey, case n_nationkey % 3 when 0 then 'Latn' when 1 then 'Cyrl' else 'Grek' end script from nation")
def guessed_scripts(spark, sf):
    k = F.col("n_nationkey") % 3
    return read(spark, sf, "nation").select("n_nationkey", text.guess_script_udf(F.when(k == 0, F.col("n_name")).when(k == 1, F.lit("Война и мир x")).otherwise(F.lit("λόγος a"))).alias("script"))


@query("edit_distances", "select p_partkey, damerau_levenshtein(p_name, p_type) d, levenshtein(p_name, p_type) l from part")
def edit_distances(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.damerau_levenshtein_udf("p_name", "p_type").alias("d"), F.levenshtein("p_name", "p_type").alias("l"))


@query("isni_forms", "select s_suppkey, substr(d, 1, 4) || ' ' || substr(d, 5, 4) || ' ' || substr(d, 9, 4) || ' ' || substr(d, 13, 4) isni, true looks, false not_one from (select s_suppkey, lpad(s_suppkey::varchar, 16, '0') d from supplier)")
def isni_forms(spark, sf):
    digits = F.lpad(F.col("s_suppkey").cast("string"), 16, "0")
    isbn = F.concat(F.lit("978-"), F.substring(digits, 7, 9), F.lit("-X"))
    return read(spark, sf, "supplier").select("s_suppkey", ids.format_isni(digits).alias("isni"), ids.looks_like_isbn(F.regexp_replace(isbn, "X", "1")).alias("looks"), ids.looks_like_isbn(isbn).alias("not_one"))


@query("isbn_hyphens", "select p_partkey, '978-91-' || case when n < 20 then lpad(n::varchar, 2, '0') || '-' || r else 'x' end hyphened from (select p_partkey, p_partkey % 20 n, lpad(p_partkey::varchar, 5, '0') || '-0' r from part)")
def isbn_hyphens(spark, sf):
    ranges = {"978-91": [(0, 1999999, 2)]}
    isbn = F.concat(F.lit('"97891'), F.lpad((F.col("p_partkey") % 20).cast("string"), 2, "0"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit('0"'))
    return read(spark, sf, "part").select("p_partkey", json_udf(lambda x: ids.hyphenate_isbn(x, ranges))(isbn).alias("hyphened"))


@query("romanised", "select n_nationkey, case when n_nationkey % 2 = 0 then 'Mir ' || n_nationkey else 'mir ' || n_nationkey end plain from nation")
def romanised(spark, sf):
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "Мир ").otherwise("мир "), "n_nationkey")
    return read(spark, sf, "nation").select("n_nationkey", scripts.romanize_column(name, "Cyrl").alias("plain"))


@query("text_changes", "select p_partkey, p_size > 25 changed, p_size > 40 lives from part")
def text_changes(spark, sf):
    p = read(spark, sf, "part")
    after = F.when(F.col("p_size") > 25, F.concat(F.lit("new "), "p_name")).otherwise(F.concat(F.upper("p_name"), F.lit(".")))
    lives = F.when(F.col("p_size") > 40, "1900-1981").otherwise(F.lit("1900-1980"))
    return p.select("p_partkey", text.string_changed(F.col("p_name"), after).alias("changed"), text.life_span_changed(F.lit("1900-1980"), lives).alias("lives"))


@query("page_counts", "select p_partkey, p_size pages, null::int none from part")
def page_counts(spark, sf):
    extent = F.concat(F.lit("xii, "), "p_size", F.lit(" s. : ill."))
    return read(spark, sf, "part").select("p_partkey", text.page_count(extent).alias("pages"), text.page_count(F.lit("1 DVD")).alias("none"))


@query("term_forms", "select n_nationkey, 'http://e/N' || n_nationkey expanded, 'e:N' || n_nationkey compacted, 'http://v/' || n_name term, n_name plain from nation")
def term_forms(spark, sf):
    prefixes, vocab = {"e": "http://e/"}, "http://v/"
    short = F.concat(F.lit("e:N"), "n_nationkey")
    full, term = ids.expand_term(short, prefixes, vocab), ids.expand_term(F.col("n_name"), prefixes, vocab)
    return read(spark, sf, "nation").select("n_nationkey", full.alias("expanded"), ids.compact_iri(full, prefixes, vocab).alias("compacted"), term.alias("term"), ids.compact_iri(term, prefixes, vocab).alias("plain"))


@query("level_codes", "select o_orderkey, case substr(o_orderpriority, 1, 1) when '1' then 'FullLevelInputFromExternalAgency' when '2' then 'LessThanFullLevel' when '3' then 'AbbreviatedLevel' when '4' then 'PrepublicationLevel' when '5' then 'PartialPreliminaryLevel' end as \"level\" from orders")
def level_codes(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", ids.encoding_level(F.substring("o_orderpriority", 1, 1)).alias("level"))


@query("search_keys", "select c_custkey, trim(regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) || case when c_mktsegment = 'BUILDING' then '' else '/' || lower(c_mktsegment) end || '/' || c_nationkey as \"key\" from customer")
def search_keys(spark, sf):
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(" ! ")
    return read(spark, sf, "customer").select("c_custkey", uris.search_key(F.col("c_name"), segment, F.col("c_nationkey")).alias("key"))


@query("find_urls", "select p_partkey, 'http://e/find?q=' || replace(p_name, ' ', '%20') || case when p_size > 25 then '&size=' || p_size else '' end url from part")
def find_urls(spark, sf):
    size = F.when(F.col("p_size") > 25, F.col("p_size"))
    return read(spark, sf, "part").select("p_partkey", uris.find_url_column("http://e/find", {"q": F.col("p_name"), "size": size}).alias("url"))


@query("work_and_instance", "select p_partkey, p_type kind, p_name title, 'kept' language from part")
def work_and_instance(spark, sf):
    data = F.to_json(F.struct(F.col("p_type").alias("genre"), F.col("p_name").alias("title"), F.lit("lost").alias("language"), F.struct(F.lit("kept").alias("language")).alias("instanceOf")))
    split = json_udf(lambda r: uris.split_work(r, frozenset({"genre", "language"})))
    out = read(spark, sf, "part").select("p_partkey", split(data).alias("new"))
    return out.select("p_partkey", F.get_json_object("new", "$.instanceOf.genre").alias("kind"), F.get_json_object("new", "$.title").alias("title"), F.get_json_object("new", "$.instanceOf.language").alias("language"))


@query("specific_types", "select p_partkey, case when p_size > 40 then 'Large' when p_retailprice > 1500 then 'Costly' else 'Thing' end kind from part")
def specific_types(spark, sf):
    return read(spark, sf, "part").select("p_partkey", uris.specific_type([(F.col("p_size") > 40, "Large"), (F.col("p_retailprice") > 1500, "Costly")], "Thing").alias("kind"))


@query("quality_flags", "select doc_id, coalesce(n_chars > 500, false) long_text, coalesce(quality = 1, false) good from documents left join labels using (doc_id)")
def quality_flags(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", *uris.quality_flags({"long_text": F.col("n_chars") > 500, "good": F.col("quality") == 1}))

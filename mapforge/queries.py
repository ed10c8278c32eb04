"""Queries over the test tables, one or more for each operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .functions import vocabulary as V
from .operators import catalog, decide, patch, prompt, search
from .operators.graph import connected_components
from .operators.profile import profile, stripped
from .plans import mapping, run
from .sources import models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SCALARS = ["name", "row_count", "non_null", "null_rate", "distinct", "uniqueness", "inferred_datatype", "shape", "avg_len", "is_empty", "is_constant", "freetext", "junk"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _profiled(df: DataFrame) -> DataFrame:
    return profile(df).select(*(F.round(c, 4).alias(c) if c in ("null_rate", "uniqueness", "avg_len") else F.col(c) for c in SCALARS))


_STRIP = r"regexp_replace(v, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_AGREE = {"boolean": "lower(v) in ('true','false','yes','no')", "integer": rf"regexp_full_match(v, '{V.INTEGER}')", "number": rf"regexp_full_match(v, '{V.NUMBER}')", "date": rf"regexp_full_match(v, '{V.DATE}') and try_cast(v as date) is not null", "datetime": rf"regexp_full_match(v, '{V.DATETIME}') and try_cast(v[1:10] as date) is not null"}
_SHAPE = {"url": r"regexp_full_match(v, '(?i)https?://\S+')", "email": rf"regexp_full_match(v, '{V.EMAIL}')", "iso_datetime": _AGREE["datetime"], "hex_id": "regexp_full_match(v, '(?i)[0-9a-f]{6,}') and regexp_matches(v, '(?i)[a-f]')", "currency": rf"regexp_full_match(v, '{V.CURRENCY}')"}


def _profile_sql(table: str, columns: list[str]) -> str:
    """Profiles by one scan for each column."""
    cell = " union all ".join(f"select '{c}' as name, cast({c} as varchar) as v from {table}" for c in columns)
    share = lambda p: f"coalesce(avg(case when {p} then 1.0 else 0.0 end) filter (v is not null), 0) >= 0.9"
    types = " ".join(f"when {share(p)} then '{k}'" for k, p in _AGREE.items())
    shapes = " ".join(f"when {share(p)} then '{k}'" for k, p in _SHAPE.items())
    sync = ", ".join(f"'{x}'" for x in V.SYNC_COLUMNS)
    return f"""
with c as ({cell}), s as (select name, case when length({_STRIP}) > 0 then {_STRIP} end as v from c),
p as (select name, count(*) as row_count, count(v) as non_null, count(distinct v) as "distinct",
  case {types} else 'string' end as inferred_datatype, case {shapes} end as shape, coalesce(avg(length(v)), 0) as len from s group by name),
q as (select *, 1 - non_null / row_count as nr, case when non_null > 0 then "distinct" / non_null else 0 end as u from p)
select name, row_count, non_null, round(nr, 4) as null_rate, "distinct", round(u, 4) as uniqueness, inferred_datatype, shape, round(len, 4) as avg_len,
  non_null = 0 as is_empty, "distinct" = 1 as is_constant, len > 25 and u > 0.8 and inferred_datatype = 'string' as freetext,
  case when non_null = 0 then 'empty_column' when trim(name) = '' or regexp_matches(name, '(?i)^unnamed[:\\s_]*\\d*$') then 'unnamed_column'
    when (regexp_matches(name, '(?i)^_?(id|_id|uuid|guid|pk|row_?id)$') or name[1] = '_') and u = 1 then 'surrogate_key'
    when lower(name) in ({sync}) and ("distinct" = 1 or coalesce(shape = 'iso_datetime', false)) then 'sync_metadata' end as junk
from q"""


def _profile_query(name: str, table: str, columns: list[str]) -> None:
    QUERIES[name] = lambda spark, sf_dir: _profiled(t(spark, sf_dir, table).select(*columns))
    ORACLE[name] = _profile_sql(table, columns)


_profile_query("profile_customer", "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
_profile_query("profile_events", "events", ["event_id", "user_id", "event_type", "props"])
_profile_query("profile_pages", "pages", ["page_id", "url"])
_profile_query("profile_part", "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
_profile_query("freetext_columns", "conversations", ["conv_id", "turn", "role", "text"])
_profile_query("junk_prefilter", "nation", ["n_nationkey", "n_name", "n_regionkey"])

WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^0-9a-zA-Z]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(f"select p_partkey, array_to_string({WORDS.format('p_name')}, ' ') as tokens from part")
def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(names.split_name(F.col("p_name")), " ").alias("tokens"))


@query("select a.n_name as a, b.n_name as b, cast(len(list_intersect(a.ids, b.ids)) as double) / len(list_distinct(list_concat(a.ids, b.ids))) as overlap from (select n_name, list_distinct(string_split(lower(n_name), '')) as ids from nation) a, (select n_name, list_distinct(string_split(lower(n_name), '')) as ids from nation) b where a.n_name < b.n_name")
def theta_pair_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t(spark, sf_dir, "nation").select("n_name", F.array_distinct(F.filter(F.split(F.lower("n_name"), ""), lambda x: x != "")).alias("ids"))
    a, b = own.select(F.col("n_name").alias("a"), F.col("ids").alias("ia")), own.select(F.col("n_name").alias("b"), F.col("ids").alias("ib"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", names.jaccard(F.col("ia"), F.col("ib")).alias("overlap"))


_TERMS = f"select doc_id, unnest({WORDS.format('text')}) as term from documents"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", names.split_name(F.col("text")).alias("tokens"))


@query(f"select term, count(distinct doc_id) as df, count(*) as tf from ({_TERMS}) group by term")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_counts(_tokens(spark, sf_dir), "tokens")


@query(f"with p as ({_TERMS}) select term, round(ln(((select count(*) from documents) - df + 0.5) / (df + 0.5) + 1), 4) as idf from (select term, count(distinct doc_id) as df from p group by term)")
def inverse_document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _tokens(spark, sf_dir)
    return search.with_idf(search.document_counts(docs, "tokens"), docs.count()).select("term", F.round("idf", 4).alias("idf"))


_BM25 = f"""
with p as ({_TERMS}), tf as (select doc_id, term, count(*) as tf from p group by all), dl as (select d.doc_id, coalesce(n, 0) as dl from documents d left join (select doc_id, count(*) as n from p group by doc_id) using (doc_id)),
st as (select count(*) as n, avg(dl) as mean from dl), idf as (select term, ln((n - df + 0.5) / (df + 0.5) + 1) as idf from (select term, count(*) as df from tf group by term), st),
q as (select distinct item_id as query_id, unnest({WORDS.format('text')}) as term from benchmark),
s as (select query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) as bm25 from q join tf using (term) join idf using (term) join dl using (doc_id), st group by all)"""


def _bm25(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    asked = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), names.split_name(F.col("text")).alias("terms"))
    return search.bm25_scan(_tokens(spark, sf_dir), "doc_id", "tokens", asked, k)


@query(_BM25 + " select query_id, doc_id, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by round(bm25, 6) desc, doc_id) as rank from s) where rank <= 8")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_bm25(spark, sf_dir, 8), 8).select("query_id", "doc_id", "rank")


@query(_BM25 + " select query_id, doc_id, round(case when m > 0 then bm25 / m else 0 end, 4) as bm25 from (select *, max(bm25) over (partition by query_id) as m from s) ")
def bm25_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.normalised(_bm25(spark, sf_dir)).select("query_id", "doc_id", F.round("bm25", 4).alias("bm25"))


_COS = "greatest(0, list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) / sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))"


@query(f"select query_id, doc_id, cast(rank as int) as rank from (select a.vec_id as query_id, b.vec_id as doc_id, row_number() over (partition by a.vec_id order by round({_COS}, 8) desc, b.vec_id) as rank from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id) where rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "embeddings")
    found = search.nearest(v, "vec_id", "embedding", v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5)
    return found.select("query_id", "doc_id", "rank")


@query("select o_custkey, round(max(p) - coalesce(max(case when rn = 2 then p end), 0), 2) as margin from (select o_custkey, o_totalprice as p, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) group by o_custkey")
def score_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = search.top_k(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score")), 2)
    return search.margin(ranked).select(F.col("query_id").alias("o_custkey"), F.round("margin", 2).alias("margin"))


@query("select o_custkey, o_orderkey, rn > 2 as downgraded from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority, o_totalprice, o_orderkey) as rn from orders where o_orderstatus = 'O')")
def escalation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    none = F.lit(None).cast("string")
    proposal = F.struct(F.lit("exclude").alias("disposition"), none.alias("target"), none.alias("new_name"), none.alias("new_datatype"), none.alias("new_range"), none.alias("on_type"), F.lit(0.6).alias("confidence"))
    d = o.select("o_custkey", F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("score_margin"), F.lit(True).alias("escalated"), proposal.alias("proposal"), F.array(F.lit("low_confidence")).alias("gates_fired"), *(F.lit(None).cast("double" if c == "confidence" else "string").alias(c) for c in decide.DECISION))
    return decide.with_budget(d, 2, ["o_custkey"]).select("o_custkey", F.col("position").alias("o_orderkey"), "downgraded")


@query("with recursive e as (select o_custkey as a, -l_suppkey as b from orders join lineitem on l_orderkey = o_orderkey where l_quantity = 50 and o_orderpriority = '1-URGENT'), u as (select a, b from e union select b, a from e), r as (select distinct a as node, a as component from u union select u.b, r.component from r join u on u.a = r.node) select node, min(component) as component from r group by node")
def linked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, line = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), t(spark, sf_dir, "lineitem").where("l_quantity = 50")
    e = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), (-F.col("l_suppkey")).alias("b"))
    return connected_components(e, e.select(F.explode(F.array("a", "b")).alias("node")).distinct())


@query()
def linked_components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all links; ``linked_components`` beside it is the part whose SQL closure ends."""
    o, line = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    e = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), (-F.col("l_suppkey")).alias("b"))
    return connected_components(e, e.select(F.explode(F.array("a", "b")).alias("node")).distinct())


@query()
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return p.select("p_partkey", F.round(names.name_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("select user_id, event_id, case when length(trim(event_type)) > 0 then trim(event_type) end as v from events")
def stripped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("user_id", "event_id", stripped(F.col("event_type")).alias("v"))


@query("select name, string_agg(v, '|' order by first) as samples from (select *, row_number() over (partition by name order by first) as rn from (select name, v, min(o_orderkey) as first from (select 'o_orderpriority' as name, o_orderpriority as v, o_orderkey from orders union all select 'o_orderstatus', o_orderstatus, o_orderkey from orders union all select 'o_custkey', cast(o_custkey as varchar), o_orderkey from orders) group by name, v)) where rn <= 5 group by name")
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey")
    return profile(o, "o_orderkey").select("name", F.array_join("samples", "|").alias("samples"))


@query("select l_orderkey, target, round(score, 2) as score, aliased_from from (select l_orderkey, target, max(score) as score, nullif(arg_min(case when aliased then card else '' end, (-score, l_linenumber)), '') as aliased_from from (select l_orderkey, l_linenumber, l_discount as score, 'c' || l_linenumber as card, l_linenumber % 2 = 0 as aliased, case when l_linenumber % 2 = 0 then 'c1' else 'c' || l_linenumber end as target from lineitem) group by l_orderkey, target)")
def merge_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of an order's lines; every second one is a twin of the first."""
    zero = F.lit(0.0)
    scored = t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.concat(F.lit("c"), "l_linenumber").alias("card_id"), F.col("l_discount").alias("score"), F.col("l_linenumber").alias("ord"),
        F.when(F.col("l_linenumber") % 2 == 0, "c1").alias("aliased_to"), zero.alias("bm25"), zero.alias("embedding"), zero.alias("datatype_prior"), zero.alias("shape_prior"),
    )
    return search.merge_aliases(scored).select(F.col("query_id").alias("l_orderkey"), F.col("doc_id").alias("target"), F.round("score", 2).alias("score"), "aliased_from")


@query("with m as (select s_name as name, s_nationkey, coalesce(n, 0) as n, coalesce(d, 0) as d from supplier left join (select l_suppkey, count(*) as n, count(*) filter (l_returnflag = 'R') as d from lineitem where l_linenumber = 7 group by l_suppkey) on l_suppkey = s_suppkey), b as (select s_nationkey, arg_min(name, (-n, -d, name)) as canonical from m group by s_nationkey) select name, canonical from m join b using (s_nationkey) where name <> canonical")
def canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as types, seventh lines of orders as their attributes, and all of a nation as twins of its first."""
    s = t(spark, sf_dir, "supplier")
    own = t(spark, sf_dir, "lineitem").where("l_linenumber = 7").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    none = F.lit(None).cast("string")
    types = s.select(F.col("s_suppkey").cast("int").alias("t"), F.col("s_name").alias("name"), F.lit("").alias("description"))
    attributes = own.select(F.col("s_suppkey").cast("int").alias("t"), F.col("s_name").alias("owner"), F.col("l_orderkey").cast("int").alias("i"), F.concat(F.lit("a"), "l_orderkey").alias("name"), F.lit("string").alias("datatype"), F.lit(False).alias("required"), F.when(F.col("l_returnflag") == "R", "returned").otherwise("").alias("description"), none.alias("aligned_with"))
    relationships = attributes.where("false").select("t", "owner", "i", "name", none.alias("range"), "description", "aligned_with")
    first = s.groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("a"))
    pairs = s.join(first, "s_nationkey").select("a", F.col("s_name").alias("b")).where("a <> b")
    return catalog.canonical_types(catalog.Catalog(types, attributes, relationships), pairs)


_CARDS = [("T.a0", "attribute", "string", False), ("T.a1", "attribute", "integer", False), ("T.a2", "attribute", "date", False), ("T.a3", "attribute", "string", True), ("T.r0", "relationship", None, False)]
_GATES_SQL = """
with c(id, kind, dt, vac) as (values ('T.a0', 'attribute', 'string', false), ('T.a1', 'attribute', 'integer', false), ('T.a2', 'attribute', 'date', false), ('T.a3', 'attribute', 'string', true), ('T.r0', 'relationship', null, false)),
p as (select p_partkey as k, (p_partkey * 7) % 128 / 128.0::double as top, greatest(0, (p_partkey * 7) % 128 - p_size % 40) / 128.0::double as second, (p_partkey * 13) % 128 / 128.0::double as confidence,
  case when p_partkey % 11 = 0 then 'Date ' else 'c' || p_partkey end as col, case p_size % 3 when 0 then 'string' when 1 then 'integer' else 'date' end as q, p_size % 15 = 0 as ft,
  case p_partkey % 4 when 2 then 'new_attribute' when 3 then case when p_partkey % 3 = 0 then 'escalate' else 'new_relationship' end else 'reuse' end as d,
  case p_partkey % 7 when 4 then 'T.r0' when 5 then 'T.zz' when 6 then 'T.a0' else 'T.a' || p_partkey % 7 end as goal, 'T.a' || p_partkey % 4 as id1 from part),
j as (select p.*, d = 'reuse' as reuse, d like 'new_%' as new, c1.kind as k1, c1.dt as t1, g.id as gid, g.kind as gk, g.dt as gt, coalesce(g.vac, false) as gv from p left join c c1 on c1.id = id1 left join c g on g.id = goal and d = 'reuse'),
f as (select *, case when t1 = q then 1 when q in ('integer') and t1 = 'string' then 0 when q = 'string' and t1 = 'integer' then case when ft then 0 else 0.15 end when q = 'string' or t1 = 'string' then 0.15 else 0 end = 0 as clash1,
  case when gt = q then 1 when q in ('integer') and gt = 'string' then 0 when q = 'string' and gt = 'integer' then case when ft then 0 else 0.15 end when q = 'string' or gt = 'string' then 0.15 else 0 end = 0 as clash from j),
n as (select *, new and top >= case when clash1 then 0.55 else 0.62 end as near from f),
g as (select k, list_filter([case when near then 'near_duplicate' end, case when new and top >= 0.5 and top - second < 0.05 and not near then 'score_margin_ambiguous' end, case when reuse and gk = 'attribute' and clash then 'datatype_conflict' end,
  case when reuse and gk = 'relationship' and (q <> 'string' or ft) then 'kind_mismatch' end, case when reuse and goal = 'T.r0' and top - second >= 0.15 then 'retrieval_override' end, case when new and lower(trim(col)) = 'date' then 'vacuous_source' end,
  case when reuse and gv then 'vacuous_target' end, case when confidence < 0.55 then 'low_confidence' end, case when reuse and gid is null then 'unknown_target' end, case when d = 'escalate' then 'llm_escalate' end], lambda x: x is not null) as gates, d from n)
select k as p_partkey, array_to_string(gates, ',') as gates, case when list_contains(gates, 'vacuous_target') then 'new_attribute' else d end as disposition,
  (select arg_min(x, (pr, i)) from (select unnest(gates) as x, generate_subscripts(gates, 1) as i) join (values ('datatype_conflict', 0), ('kind_mismatch', 0), ('unknown_target', 0), ('low_confidence', 1), ('llm_escalate', 1), ('near_duplicate', 2), ('retrieval_override', 2), ('score_margin_ambiguous', 3), ('vacuous_source', 3)) v(n, pr) on n = x) as strongest from g"""


def _proposed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Proposals for columns made of parts, such that every gate fires for some, and the cards they are about."""
    cards = spark.createDataFrame(_CARDS, "card_id string, kind string, datatype string, vacuous boolean")
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda x: x.cast("string")
    none = F.lit(None).cast("string")
    raw = k * 7 % 128
    d = F.when(k % 4 == 2, "new_attribute").when((k % 4 == 3) & (k % 3 == 0), "escalate").when(k % 4 == 3, "new_relationship").otherwise("reuse")
    goal = F.when(k % 7 == 4, "T.r0").when(k % 7 == 5, "T.zz").when(k % 7 == 6, "T.a0").otherwise(F.concat(F.lit("T.a"), text(k % 7)))
    candidates = F.array(F.struct(F.concat(F.lit("T.a"), text(k % 4)).alias("doc_id"), (raw / 128).alias("score")), F.struct(F.lit("T.r0").alias("doc_id"), (F.greatest(F.lit(0), raw - s % 40) / 128).alias("score")))
    proposal = F.struct(d.alias("disposition"), F.when(d == "reuse", goal).alias("target"), none.alias("new_name"), none.alias("new_datatype"), none.alias("new_range"), none.alias("on_type"), (k * 13 % 128 / 128).alias("confidence"))
    p = t(spark, sf_dir, "part").select(
        F.when(k % 11 == 0, "Date ").otherwise(F.concat(F.lit("c"), text(k))).alias("column"), k.alias("position"), F.when(s % 3 == 0, "string").when(s % 3 == 1, "integer").otherwise("date").alias("datatype"), (s % 15 == 0).alias("freetext"),
        F.array().cast("array<string>").alias("samples"), candidates.alias("candidates"), F.lit("T").alias("subject"), proposal.alias("proposal"), F.lit(0.0).alias("score_margin"),
    )
    top = cards.select(F.col("card_id").alias("top_id"), F.col("kind").alias("top_kind"), F.col("datatype").alias("top_datatype"))
    return p.join(F.broadcast(top), F.get("candidates", 0)["doc_id"] == F.col("top_id")), cards


@query(_GATES_SQL)
def gates_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposed, cards = _proposed(spark, sf_dir)
    return decide.gates(proposed, cards).select(F.col("position").alias("p_partkey"), F.array_join("gates_fired", ",").alias("gates"), "disposition", F.col("escalation_gate").alias("strongest"))


_ANSWERS = "case o_orderkey % 6 when 1 then 'exclude' when 2 then 'reuse:T.b' when 3 then 'new:n' when 4 then 'other: take t.A please' when 5 then 'as you like' end"


@query(f"with a as (select o_orderkey, {_ANSWERS} as a, o_custkey % 2 = 0 as linked from orders) select o_orderkey, case when a is null then 'new_attribute' when a = 'exclude' then 'exclude' when a like 'reuse:%' or a like 'other:%' then 'reuse' when a like 'new:%' and linked then 'new_relationship' else 'new_attribute' end as disposition, case when a like 'reuse:%' then 'T.b' when a like 'other:%' then 'T.a' end as target, case when a like 'new:%' then 'n' else 'c' end as new_name, case when a is null then 'rule' else 'human' end as decided_by from a")
def answers_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of answer: kept, excluded, reused, new, free text that names a candidate, and free text that names none."""
    o, none = t(spark, sf_dir, "orders"), F.lit(None).cast("string")
    linked = F.when(F.col("o_custkey") % 2 == 0, "T")
    proposal = F.struct(F.lit("new_attribute").alias("disposition"), none.alias("target"), F.lit("c").alias("new_name"), F.lit("string").alias("new_datatype"), linked.alias("new_range"), F.lit("T").alias("on_type"), F.lit(0.6).alias("confidence"))
    column = F.col("o_orderkey").cast("string")
    decisions = o.select("o_orderkey", column.alias("column"), F.array(F.struct(F.lit("T.a").alias("doc_id"))).alias("candidates"), F.lit("T").alias("subject"), F.lit("string").alias("datatype"), proposal.alias("proposal"), *(proposal[c].alias(c) for c in decide.DECISION))
    asked = o.select(F.concat(F.lit("q"), column).alias("id"), column.alias("column"), F.lit("keep_original").alias("default"))
    answers = o.select(F.concat(F.lit("q"), column).alias("id"), F.expr(_ANSWERS.replace("o_orderkey % 6 when", "int(o_orderkey % 6) when")).alias("answer")).where("answer is not null")
    return decide.resolve(decisions, asked, answers).select("o_orderkey", "disposition", "target", "new_name", "decided_by")


def _small_catalog(spark: SparkSession) -> catalog.Catalog:
    """Customers in places, of parties."""
    types = spark.createDataFrame([(0, "Customer", ""), (1, "Place", ""), (2, "Party", "")], "t int, name string, description string")
    attributes = spark.createDataFrame([(0, "Customer", 0, "name", "string", True, "", None), (0, "Customer", 1, "size", "string", False, "", None), (1, "Place", 0, "city", "string", False, "", None), (1, "Place", 1, "code", "integer", False, "", None)], "t int, owner string, i int, name string, datatype string, required boolean, description string, aligned_with string")
    relationships = spark.createDataFrame([(0, "Customer", 0, "located_in", "Place", "", None), (0, "Customer", 1, "member_of", "Party", "", None)], "t int, owner string, i int, name string, range string, description string, aligned_with string")
    return catalog.Catalog(types, attributes, relationships)


@query("""
with o as (select p_partkey as k, case p_partkey % 5 when 0 then 'reuse' when 1 then 'add_attribute' when 2 then 'add_relationship' when 3 then 'add_type' else 'flag_ontology_issue' end as op, p_size % 6 as v from part)
select k as p_partkey, op, unnest(list_filter([case when v = 5 then 'confidence is not within 0 and 1' end, case when op = 'reuse' and v in (1, 5) then 'target does not exist' end, case when op like 'add_a%' and v = 1 or op like 'add_r%' and v = 1 then 'on_type does not exist' end,
  case when op = 'add_attribute' and v = 2 then 'attribute exists' end, case when op = 'add_relationship' and v = 2 then 'relationship exists' end, case when op = 'add_attribute' and v = 3 then 'datatype is unknown' end, case when op = 'add_relationship' and v = 3 then 'range does not exist' end,
  case when op in ('add_attribute', 'add_relationship') and v = 4 then 'name is not snake_case' end, case when op = 'add_type' and v = 4 then 'name is not PascalCase' end, case when op = 'add_type' and v = 2 then 'type exists' end, case when op = 'flag_ontology_issue' and v = 3 then 'severity is unknown' end], lambda x: x is not null)) as error from o""")
def validate_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops made of parts, with every error for some."""
    k, v = F.col("p_partkey"), F.col("p_size") % 6
    op = F.when(k % 5 == 0, "reuse").when(k % 5 == 1, "add_attribute").when(k % 5 == 2, "add_relationship").when(k % 5 == 3, "add_type").otherwise("flag_ontology_issue")
    own = op.isin("add_attribute", "add_relationship")
    fresh = F.when(v == 4, "Bad Name").when((v == 2) & (op == "add_attribute"), "Name").when((v == 2) & (op == "add_relationship"), "located_in").otherwise("brand_new")
    fresh = F.when((v == 2) & (op == "add_attribute"), "name").otherwise(fresh)
    ops = t(spark, sf_dir, "part").select(
        k.cast("int").alias("seq"), op.alias("op"), F.when(op == "reuse", F.when(v.isin(1, 5), "Nothing.there").when(v == 2, "Place").otherwise("customer.NAME")).alias("target"),
        F.when(own, F.when(v == 1, "Nothing").otherwise("customer")).alias("on_type"), F.when(own, fresh).when(op == "add_type", F.when(v == 4, "bad_name").when(v == 2, "Place").otherwise(F.concat(F.lit("New"), k.cast("string")))).alias("name"),
        F.when(op == "add_attribute", F.when(v == 3, "decimal").otherwise("integer")).alias("datatype"), F.when(op == "add_relationship", F.when(v == 3, "Nothing").otherwise("party")).alias("range"),
        F.when(op == "flag_ontology_issue", F.when(v == 3, "fatal").otherwise("error")).alias("severity"), F.when(v == 5, 1.5).otherwise(0.5).alias("confidence"),
    )
    return patch.validate(ops, _small_catalog(spark)).select(F.col("seq").cast("long").alias("p_partkey"), "op", "error")


_ROWS_SQL = """
with c as (select c_custkey as k, c_name as nm, case when c_custkey % 5 = 0 then null else n_name end as city, cast(c_nationkey as varchar) as code, case when c_custkey % 7 = 0 then 'N/A' else c_mktsegment end as seg from customer join nation on n_nationkey = c_nationkey),
p as (select *, 'Place:' || concat_ws('|', city, code) as pid, seg <> 'N/A' as told from c)
select k as row, 'Customer:' || k as id, 'Customer' as type, 'name=' || nm as attributes, 'located_in=' || pid || case when told then ';member_of=Party:' || seg else '' end as relationships from p
union all select k, pid, 'Place', case when city is not null then 'city=' || city || ';' else '' end || 'code=' || code, '' from p union all select k, 'Party:' || seg, 'Party', 'name=' || seg, '' from p where told"""


@query(_ROWS_SQL)
def project_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as entities: literals, a group of two columns, and a named party unless it says that there is none."""
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cell = lambda name, v: F.struct(F.lit(name).alias("column"), v.alias("v"))
    cells = c.select(F.col("c_custkey").alias("row"), F.explode(F.array(cell("who", F.col("c_name")), cell("town", F.when(F.col("c_custkey") % 5 != 0, F.col("n_name"))), cell("area", F.col("c_nationkey").cast("string")), cell("club", F.when(F.col("c_custkey") % 7 == 0, "N/A").otherwise(F.col("c_mktsegment"))))).alias("c")).select("row", "c.column", "c.v")
    none = None
    said = [("who", 0, "reuse", "Customer.name", none, none, none), ("town", 1, "reuse", "Place.city", none, none, none), ("area", 2, "new_attribute", none, "code", "Place", none), ("club", 3, "reuse", "Customer.member_of", none, none, none)]
    decisions = spark.createDataFrame(said, "column string, position int, disposition string, target string, new_name string, on_type string, new_range string")
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias(m)
    return patch.project(cells, decisions, _small_catalog(spark), "Customer").select("row", "id", "type", flat("attributes"), flat("relationships"))


@query('select * from (values (1, \'1_vendors.csv\', 6, 1, 0, 1), (2, \'2_product_catalog.csv\', 4, 3, 0, 0), (3, \'3_crm_export.csv\', 3, 3, 3, 2)) v(seq, "table", reused, new, excluded, escalated)')
def mapping_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedded tables mapped from profile to projection; its SQL is what the rules give for them by hand."""
    return mapping.counters(mapping.example(spark))


@query()
def mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the embedded tables as linked entities."""
    return run.projected(mapping.example(spark))


@query("select conv_id, turn, left(regexp_replace('chat_' || role || '_' || text, '[^a-zA-Z0-9_]+', '_', 'g'), 80) as tag from conversations")
def request_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", models.tag(F.lit("chat"), F.col("role"), F.col("text")).alias("tag"))


@query("select n_nationkey, sha256('{\"base_url\":\"u\",\"model\":\"m\",\"text\":\"' || n_name || '\"}') as key from nation")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "nation").select("n_nationkey", models.content_key(("model", F.lit("m")), ("text", F.col("n_name")), ("base_url", F.lit("u"))).alias("key"))


@query("select o_custkey, 'column c' || o_custkey || ' (string) values: ' || array_to_string(list(distinct o_orderpriority order by o_orderpriority)[1:3], ', ') as asked from orders group by o_custkey")
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("samples"))
    return o.select("o_custkey", prompt.query_text(F.concat(F.lit("c"), "o_custkey"), F.lit("string"), F.col("samples")).alias("asked"))


@query("select o_orderkey, string_agg('- k' || o_orderkey || ': ' || case when o_orderstatus = 'F' then 'reuse -> ' || o_orderpriority else 'new_attribute -> n' || o_orderkey end, chr(10)) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding) as prior from orders")
def prior_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the columns of a table."""
    key, reused = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    d = t(spark, sf_dir, "orders").select("o_custkey", key.alias("position"), F.concat(F.lit("k"), key).alias("column"), F.when(reused, "reuse").otherwise("new_attribute").alias("disposition"), F.when(reused, F.col("o_orderpriority")).alias("target"), F.concat(F.lit("n"), key).alias("new_name"))
    return prompt.prior_decisions(d, ["o_custkey"]).select(F.col("position").alias("o_orderkey"), "prior")


@query("select o_orderstatus as status, cast(sum(n) over w as bigint) as calls, cast(sum(k) over w as bigint) as cached_calls, cast(sum(p) over w as bigint) as prompt_tokens, cast(sum(c) over w as bigint) as completion_tokens from (select o_orderstatus, count(*) as n, count(*) filter (o_custkey % 3 = 0) as k, coalesce(sum(o_custkey) filter (o_custkey % 3 <> 0), 0) as p, coalesce(sum(o_orderkey % 7) filter (o_custkey % 3 <> 0), 0) as c, min(o_orderkey) as o from orders group by o_orderstatus) window w as (order by o, o_orderstatus rows unbounded preceding)")
def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls of models, those of every third customer answered from the cache, added up over the tables (statuses)."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey", (F.col("o_custkey") % 3 == 0).alias("cached"), F.col("o_custkey").alias("prompt_tokens"), (F.col("o_orderkey") % 7).alias("completion_tokens"))
    return models.usage(o, "status", order="o_orderkey")


@query("select p_partkey, case p_partkey % 6 when 0 then 'reuse: ' || p_name || ' -> T.a' when 1 then 'add_attribute: T.' || p_brand || ' (integer)' when 2 then 'add_relationship: T.' || p_brand || ' -> R' when 3 then 'add_type: ' || p_brand when 4 then 'exclude: ' || p_name else 'flag_ontology_issue: [warning] T.a: ' || p_type end as line from part")
def op_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    op = F.when(k == 0, "reuse").when(k == 1, "add_attribute").when(k == 2, "add_relationship").when(k == 3, "add_type").when(k == 4, "exclude").otherwise("flag_ontology_issue")
    ops = t(spark, sf_dir, "part").select("p_partkey", op.alias("op"), F.col("p_name").alias("source_column"), F.lit("T.a").alias("target"), F.when(k.isin(1, 2), "T").alias("on_type"), F.col("p_brand").alias("name"), F.lit("integer").alias("datatype"), F.lit("R").alias("range"), F.lit("warning").alias("severity"), F.col("p_type").alias("issue"))
    return ops.select("p_partkey", patch.described().alias("line"))


@query("with v as (select 'v' || vec_id as name, embedding::double[] as e from embeddings), p as (select p_partkey, p_partkey % 100 / 100.0::double as score, 'v' || p_partkey % 100 as a, 'v' || p_size % 100 as b from part) select p_partkey, case when score >= 0.4 and score < 0.5 and list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(y.e, y.e)) >= 0.8 then 0.5 else score end as score from p left join v x on x.name = a left join v y on y.name = b")
def near_duplicates_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pairs of types with the stored embeddings for their texts."""
    name = lambda c: F.concat(F.lit("v"), c.cast("string"))
    vectors = t(spark, sf_dir, "embeddings").select(name(F.col("vec_id")).alias("name"), F.col("embedding").alias("vector"))
    pairs = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 100 / 100).alias("score"), name(F.col("p_partkey") % 100).alias("a"), name(F.col("p_size") % 100).alias("b"))
    return catalog.lifted(pairs, vectors).select("p_partkey", "score")


_WHY = """with g as (select * from (values {values}) v(k, gate))
select p_partkey, case gate when 'near_duplicate' then 'a new concept is proposed, yet T.a scores 0.75; the confidence of 0.50 does not weigh against that' when 'datatype_conflict' then 'the values are of datatype integer, which that of T.b does not hold' when 'unknown_target' then 'T.b is not in the catalog'
  when 'low_confidence' then 'the confidence of 0.50 is below 0.55' when 'score_margin_ambiguous' then 'T.a (0.75) and T.b (0.50) are almost level' when 'kind_mismatch' then 'T.b is a relationship, the values are no names of entities' when 'retrieval_override' then 'T.b is proposed, far below the first that was found, T.a (0.75)'
  when 'vacuous_source' then 'the name ''' || p_name || ''' tells nothing' else 'the proposal is to ask' end as why from part join g on k = p_partkey % {n}"""


@query(_WHY.format(values=", ".join(f"({i}, '{g}')" for i, g in enumerate(V.GATE_PRIORITY)), n=len(V.GATE_PRIORITY)))
def question_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as doubted columns, every gate for some."""
    gate = F.element_at(F.array(*map(F.lit, V.GATE_PRIORITY)), (F.col("p_partkey") % len(V.GATE_PRIORITY) + 1).cast("int"))
    found = F.array(F.struct(F.lit("T.a").alias("doc_id"), F.lit(0.75).alias("score")), F.struct(F.lit("T.b").alias("doc_id"), F.lit(0.5).alias("score")))
    d = t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("column"), gate.alias("escalation_gate"), found.alias("candidates"), F.lit(0.5).alias("confidence"), F.lit("integer").alias("datatype"), F.lit("T.b").alias("target"))
    return d.select("p_partkey", decide.explanation().alias("why"))

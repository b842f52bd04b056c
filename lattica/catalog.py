"""Queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as T
from .functions import metrics as M
from .functions import text as X
from .operators import closure, evaluate, ids, kg, reports, schema
from .plans.graph import Graph
from .plans.planner import sparql
from .plans.recovery import recovered
from .plans.star import NS, PREFIXES, star_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def over_star(name: str, text: str, sql: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """A SPARQL query over the star graph."""
    QUERIES[name] = lambda spark, sf_dir: then(sparql(star_graph(spark, sf_dir), text, spark, PREFIXES))
    ORACLES[name] = sql


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in columns})


# --- graph queries -------------------------------------------------------------------------------------------------

over_star("kg_count_by_model", 'SELECT (COUNT(DISTINCT ?o) AS ?n) WHERE { ?r :name "EUROPE" . ?n :region ?r . ?c :nation ?n . ?o :customer ?c . }', "SELECT count(DISTINCT o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
over_star("kg_group_order_limit", "SELECT ?nation (COUNT(DISTINCT ?c) AS ?customers) WHERE { ?c :nation ?n . ?n :name ?nation . } GROUP BY ?nation ORDER BY DESC(?customers) ?nation LIMIT 10", "SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
over_star("kg_having_between", "SELECT ?nation (COUNT(?c) AS ?customers) WHERE { ?c :nation ?n . ?n :name ?nation . } GROUP BY ?nation HAVING (?customers >= 50 && ?customers <= 62)", "SELECT n_name AS nation, count(c_custkey) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(c_custkey) BETWEEN 50 AND 62")
ORACLES["kg_star_join"] = "SELECT 'urn:x:order/' || o_orderkey AS o, round(o_totalprice, 2) AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000"
QUERIES["kg_star_join"] = lambda spark, d: sparql(star_graph(spark, d), 'SELECT ?o ?total WHERE { ?o :status "F" ; :priority ?p ; :total ?total . FILTER(?total > 400000) }', spark, PREFIXES).withColumn("total", F.round(F.col("total").cast("double"), 2))
over_star("kg_optional", "SELECT ?d ?lang ?q WHERE { ?d :lang ?lang . OPTIONAL { ?d :quality ?q . FILTER(?q = 1) } }", "SELECT 'urn:x:document/' || d.doc_id AS d, lang, CAST(quality AS VARCHAR) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality = 1")
over_star("kg_optional_compat", "SELECT ?d ?q ?e WHERE { ?d :source \"src1\" . OPTIONAL { ?d :quality ?q . } OPTIONAL { ?e :toxic ?q . ?e :source \"src2\" . } }", "SELECT 'urn:x:document/' || d.doc_id AS d, CAST(coalesce(l.quality, x.toxic) AS VARCHAR) AS q, 'urn:x:document/' || x.doc_id AS e FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT doc_id, toxic FROM labels JOIN documents USING (doc_id) WHERE source = 'src2') x ON l.quality IS NULL OR l.quality = x.toxic WHERE source = 'src1'")
over_star("kg_union_bag", "SELECT ?x ?n WHERE { { ?x :nation ?n . } UNION { ?x :base ?n . } }", "SELECT 'urn:x:customer/' || c_custkey AS x, 'urn:x:nation/' || c_nationkey AS n FROM customer UNION ALL SELECT 'urn:x:supplier/' || s_suppkey, 'urn:x:nation/' || s_nationkey FROM supplier")
over_star("kg_filter_contains", 'SELECT ?p ?name WHERE { ?p :partname ?name . FILTER(CONTAINS(LCASE(STR(?name)), LCASE("AR"))) }', "SELECT 'urn:x:part/' || p_partkey AS p, p_name AS name FROM part WHERE contains(lower(p_name), 'ar')")
over_star("kg_regex", 'SELECT ?p ?b WHERE { ?p :brand ?b . FILTER(REGEX(?b, "[12]$")) }', "SELECT 'urn:x:part/' || p_partkey AS p, p_brand AS b FROM part WHERE regexp_matches(p_brand, '[12]$')")
over_star("kg_strstarts_strends", 'SELECT ?s ?name WHERE { ?s :base ?n ; :name ?name . FILTER(STRSTARTS(STR(?s), "urn:x:supplier/1") && STRENDS(STR(?name), "5")) }', "SELECT 'urn:x:supplier/' || s_suppkey AS s, s_name AS name FROM supplier WHERE starts_with('urn:x:supplier/' || s_suppkey, 'urn:x:supplier/1') AND ends_with(s_name, '5')")
over_star("kg_exists", "SELECT ?d WHERE { ?d :lang ?l . FILTER EXISTS { ?d :quality ?q . FILTER(?q = 0) } }", "SELECT 'urn:x:document/' || doc_id AS d FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0)")
over_star("kg_not_exists", "SELECT ?d WHERE { ?d :lang ?l . FILTER NOT EXISTS { ?d :quality ?q . } }", "SELECT 'urn:x:document/' || doc_id AS d FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
over_star("kg_minus", "SELECT ?d WHERE { ?d :lang ?l . MINUS { ?d :toxic 1 . } }", "SELECT 'urn:x:document/' || doc_id AS d FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
over_star("kg_self_join_neq", "SELECT (COUNT(*) AS ?pairs) WHERE { ?a :customer ?c . ?b :customer ?c . FILTER(?a != ?b) }", "SELECT count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey")
ORACLES["kg_suffix_join"] = "SELECT 'urn:x:supplier/' || a.s_suppkey AS a, 'urn:x:supplier/' || b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey AND ends_with('urn:x:supplier/' || a.s_suppkey, CAST(b.s_suppkey AS VARCHAR))"
QUERIES["kg_suffix_join"] = lambda spark, d: _suffix(spark, d)


def _suffix(spark: SparkSession, d: str) -> DataFrame:
    """Equal nation, and one supplier's IRI ends in the other's id: the id is a relation of its own, as in the models."""
    g = star_graph(spark, d)
    own = read(spark, d, "supplier").select(F.concat(F.lit(f"<{NS}supplier/"), F.col("s_suppkey").cast("string"), F.lit(">")).alias("s"), T.literal(F.col("s_suppkey").cast("string")).alias("o"))
    g = Graph({f"<{NS}id>": own}, tables=g.tables)
    return sparql(g, "SELECT ?a ?b WHERE { ?a :base ?n . ?b :base ?n ; :id ?ref . FILTER(?a != ?b && STRENDS(STR(?a), ?ref)) }", spark, PREFIXES)


over_star("kg_path_seq_inverse", 'SELECT ?r (COUNT(?c) AS ?n) WHERE { ?r ^:region/^:nation ?c . } GROUP BY ?r', "SELECT 'urn:x:region/' || n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
over_star("kg_path_alt", "SELECT ?n (COUNT(*) AS ?members) WHERE { ?x :nation|:base ?n . } GROUP BY ?n", "SELECT 'urn:x:nation/' || k AS n, count(*) AS members FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
over_star("kg_path_plus", 'SELECT ?x WHERE { ?r :name "ASIA" . ?x (:nation|:region|:base)+ ?r . }', "SELECT DISTINCT x FROM (SELECT 'urn:x:nation/' || n_nationkey AS x FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT 'urn:x:customer/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT 'urn:x:supplier/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
over_star("kg_minmax_date_diff", "SELECT ?s (MIN(?d) AS ?first) (MAX(?d) AS ?last) WHERE { ?o :status ?s ; :date ?d . } GROUP BY ?s", "SELECT o_orderstatus AS s, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS first, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS last, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS days FROM orders GROUP BY 1", lambda df: df.withColumn("days", F.datediff(F.to_date("last"), F.to_date("first")).cast("long")))
over_star("kg_sum_avg_empty", 'SELECT (SUM(?t) AS ?total) (AVG(?t) AS ?mean) WHERE { ?o :status "none" ; :total ?t . }', "SELECT coalesce(sum(o_totalprice), 0.0) AS total, coalesce(avg(o_totalprice), 0.0) AS mean FROM orders WHERE o_orderstatus = 'none'")
over_star("kg_argmax_group", "SELECT ?nation (COUNT(?c) AS ?n) WHERE { ?c :nation/:name ?nation . } GROUP BY ?nation ORDER BY DESC(?n) ASC(?nation) LIMIT 1", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
over_star("kg_equal_counts", "SELECT ?a ?b ?n WHERE { { SELECT ?a (COUNT(?x) AS ?n) WHERE { ?x :base ?a . } GROUP BY ?a } { SELECT ?b (COUNT(?y) AS ?n) WHERE { ?y :base ?b . } GROUP BY ?b } FILTER(STR(?a) < STR(?b)) }", "WITH c AS (SELECT 'urn:x:nation/' || s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT x.k AS a, y.k AS b, x.n AS n FROM c x JOIN c y ON x.n = y.n AND x.k < y.k", lambda df: df.withColumn("n", F.col("n").cast("long")))
over_star("kg_group_concat", 'SELECT ?region (GROUP_CONCAT(DISTINCT STR(?nation); separator=" | ") AS ?nations) WHERE { ?n :region ?r ; :name ?nation . ?r :name ?region . } GROUP BY ?region', "SELECT r_name AS region, string_agg(DISTINCT n_name, ' | ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
over_star("kg_subselect", "SELECT ?p ?size WHERE { { SELECT (MAX(?s) AS ?size) WHERE { ?x :size ?s . } } ?p :size ?size . }", "SELECT 'urn:x:part/' || p_partkey AS p, p_size AS size FROM part WHERE p_size = (SELECT max(p_size) FROM part)", lambda df: df.withColumn("size", F.col("size").cast("int")))
over_star("kg_bind_replace", 'SELECT ?local (COUNT(*) AS ?n) WHERE { ?c :nation ?x . BIND(REPLACE(STR(?x), "^.*[#/]", "") AS ?local) } GROUP BY ?local', "SELECT CAST(c_nationkey AS VARCHAR) AS local, count(*) AS n FROM customer GROUP BY 1")
over_star("kg_coalesce", 'SELECT ?d (COALESCE(?q, STR(?d)) AS ?v) WHERE { ?d :source "src3" . OPTIONAL { ?d :quality ?q } }', "SELECT 'urn:x:document/' || d.doc_id AS d, coalesce(CAST(quality AS VARCHAR), 'urn:x:document/' || d.doc_id) AS v FROM documents d LEFT JOIN labels l USING (doc_id) WHERE source = 'src3'")
over_star("kg_values_in", 'SELECT ?c ?s WHERE { VALUES ?s { "BUILDING" "MACHINERY" } ?c :segment ?s . FILTER(?c NOT IN (<urn:x:customer/1>)) }', "SELECT 'urn:x:customer/' || c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey <> 1")
over_star("kg_distinct_wildcard", "SELECT DISTINCT ?p WHERE { ?s ?p ?o . FILTER(isLiteral(?o)) }", "SELECT DISTINCT 'urn:x:' || p AS p FROM (SELECT unnest(['name', 'date', 'total', 'status', 'priority', 'partname', 'brand', 'parttype', 'size', 'segment', 'lang', 'source', 'quality', 'toxic']) AS p)")
over_star("kg_ask", 'ASK { ?o :status "F" ; :total ?t . FILTER(?t >= 1000) }', "SELECT count(*) > 0 AS boolean FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
over_star("kg_offset", "SELECT ?n WHERE { ?x :base/:name ?n . } ORDER BY ?n ?x LIMIT 7 OFFSET 5", "SELECT n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY n_name LIMIT 7 OFFSET 5")

EDGES = "SELECT DISTINCT l_suppkey % 40 AS s, (l_suppkey * 7 + 3) % 40 AS o FROM lineitem"


def cyclic_edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_suppkey")
    return read(spark, d, "lineitem").select((k % 40).alias("s"), ((k * 7 + 3) % 40).alias("o")).distinct()


@query(f"WITH RECURSIVE e AS ({EDGES}), c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT s, o FROM c")
def kg_closure(spark: SparkSession, d: str) -> DataFrame:
    return closure.closure(cyclic_edges(spark, d))


@query(f"WITH RECURSIVE e AS ({EDGES}), c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT s AS node FROM c WHERE s = o")
def kg_cycle(spark: SparkSession, d: str) -> DataFrame:
    return closure.cycles(cyclic_edges(spark, d))


@query(f"WITH RECURSIVE e AS ({EDGES}), n AS (SELECT s AS k FROM e UNION SELECT o FROM e), c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT 'urn:x:' || s AS a, 'urn:x:' || o AS b FROM (SELECT s, o FROM c UNION SELECT k, k FROM n)")
def kg_path_star(spark: SparkSession, d: str) -> DataFrame:
    e = cyclic_edges(spark, d).select(*(F.concat(F.lit(f"<{NS}"), F.col(c).cast("string"), F.lit(">")).alias(c) for c in ("s", "o")))
    return sparql(Graph({f"<{NS}to>": e}), "SELECT ?a ?b WHERE { ?a :to* ?b . }", spark, PREFIXES)


def eav(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    keep = [f"<{NS}{p}>" for p in ("name", "region", "nation", "base", "segment")] + [f"<{T.RDF}type>"]
    return g.only(keep).triples()


@query("SELECT p, n FROM (SELECT '<urn:x:name>' AS p, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT '<urn:x:region>', (SELECT count(*) FROM nation) UNION ALL SELECT '<urn:x:nation>', (SELECT count(*) FROM customer) UNION ALL SELECT '<urn:x:base>', (SELECT count(*) FROM supplier) UNION ALL SELECT '<urn:x:segment>', (SELECT count(*) FROM customer) UNION ALL SELECT '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier))")
def kg_property_histogram(spark: SparkSession, d: str) -> DataFrame:
    return kg.property_histogram(eav(spark, d))


@query("SELECT '<urn:x:' || t || '>' AS type, n FROM (SELECT 'Region' AS t, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier)")
def kg_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return kg.type_histogram(eav(spark, d))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS \"rowCount\", true AS \"rowsTruncated\" FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def kg_sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return kg.sample(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("SELECT DISTINCT s, p, o FROM (SELECT 'a' || c_custkey % 500 AS s, c_mktsegment AS p, 'n' || c_nationkey AS o FROM customer UNION ALL SELECT 'a' || s_suppkey % 500, 'BUILDING', 'n' || s_nationkey FROM supplier)")
def graph_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "customer").select(F.concat(F.lit("a"), (F.col("c_custkey") % 500).cast("string")).alias("s"), F.col("c_mktsegment").alias("p"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("o"))
    b = read(spark, d, "supplier").select(F.concat(F.lit("a"), (F.col("s_suppkey") % 500).cast("string")).alias("s"), F.lit("BUILDING").alias("p"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("o"))
    return kg.union(a, b)


@query("SELECT DISTINCT s, p, o FROM (SELECT '<urn:y:c/' || c_custkey || '>' AS s, '<urn:z:nation>' AS p, '<urn:z:nation/' || c_nationkey || '>' AS o FROM customer UNION ALL SELECT '<urn:y:c/' || c_custkey || '>', '<urn:z:segment>', '\"urn:x:' || c_mktsegment || '\"' FROM customer)")
def graph_rewrite_ns(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    s = F.concat(F.lit("<urn:x:customer/"), F.col("c_custkey").cast("string"), F.lit(">"))
    rows = c.select(s.alias("s"), F.lit("<urn:x:nation>").alias("p"), F.concat(F.lit("<urn:x:nation/"), F.col("c_nationkey").cast("string"), F.lit(">")).alias("o"))
    rows = rows.union(c.select(s, F.lit("<urn:x:segment>"), T.literal(F.concat(F.lit("urn:x:"), F.col("c_mktsegment")))))
    return kg.rewrite_namespaces(rows, [("urn:x:customer/", "urn:y:c/"), ("urn:x:", "urn:z:")])


@query("SELECT DISTINCT '<urn:x:' || c_custkey || '>' AS s, '<urn:x/belongsTo>' AS p, '<urn:x:n' || c_nationkey || '>' AS o FROM customer UNION SELECT DISTINCT '<urn:x:' || c_custkey || '>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<urn:x:' || c_mktsegment || '>' FROM customer")
def graph_belongsto_rewrite(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    node = lambda p, v: F.concat(F.lit(f"<urn:x:{p}"), F.col(v).cast("string"), F.lit(">"))
    p = F.when(F.col("c_custkey") % 2 == 0, "<urn:x/belongsToNation>").otherwise("<urn:x/belongsTo>")
    rows = c.select(node("", "c_custkey").alias("s"), p.alias("p"), node("n", "c_nationkey").alias("o"))
    return kg.normalize_structure(rows.union(c.select(node("", "c_custkey"), F.lit(f"<{T.RDFS}subClassOf>"), node("", "c_mktsegment"))), "urn:x/belongsTo")


@query("SELECT organization_id, 'Org' || dense_rank() OVER (ORDER BY organization_id) AS organization_label FROM (SELECT DISTINCT c_mktsegment || c_nationkey AS organization_id FROM customer)")
def org_label_dense(spark: SparkSession, d: str) -> DataFrame:
    return kg.organization_labels(read(spark, d, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("organization_id")))


@query("SELECT model, CASE WHEN c_nationkey = 3 THEN 'explicit_skip' WHEN l.doc_id IS NULL THEN 'no_meta_match' WHEN d.source = 'src0' THEN 'no_org_match' END AS skip_reason FROM (SELECT CAST(c_custkey AS VARCHAR) AS model, c_custkey, c_nationkey FROM customer) m LEFT JOIN labels l ON l.doc_id = c_custkey LEFT JOIN documents d ON d.doc_id = l.doc_id")
def graph_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    models = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("model"), "c_nationkey", F.lit(None).cast("string").alias("error"))
    meta = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("model"), F.col("doc_id").alias("original_id"))
    original = read(spark, d, "documents").where("source <> 'src0'").select(F.col("doc_id").alias("original_id"), F.col("source").alias("organization_id"))
    deny = read(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("model"))
    return kg.matched_models(models, meta, original, deny).select("model", "skip_reason")


DAG = "SELECT DISTINCT l_suppkey % 12 AS a, l_partkey % 12 AS b FROM lineitem WHERE l_suppkey % 12 < l_partkey % 12 AND (l_partkey % 12) % (l_suppkey % 12 + 1) = 0"


@query(f"WITH RECURSIVE e AS ({DAG}), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS s, b AS o FROM c WHERE NOT EXISTS (SELECT 1 FROM c x JOIN c y ON x.b = y.a WHERE x.a = c.a AND y.b = c.b)")
def transitive_reduction(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_suppkey") % 12, F.col("l_partkey") % 12
    e = read(spark, d, "lineitem").where((a < b) & (b % (a + 1) == 0)).select(a.alias("s"), b.alias("o")).distinct()
    return closure.transitive_reduction(closure.closure(e))


@query("SELECT class, string_agg(DISTINCT superclass, ',' ORDER BY superclass) AS superclasses FROM (SELECT 'S' || n_nationkey % 5 AS class, 'R' || n_regionkey AS superclass FROM nation UNION ALL SELECT 'S' || n_nationkey % 5, 'S' || n_nationkey % 5 FROM nation) GROUP BY 1")
def superclass_sets(spark: SparkSession, d: str) -> DataFrame:
    typed = read(spark, d, "nation").select(F.concat(F.lit("S"), (F.col("n_nationkey") % 5).cast("string")).alias("class"), F.concat(F.lit("urn:v#R"), F.col("n_regionkey").cast("string"), F.lit("_feature")).alias("predicate"))
    return schema.superclass_sets(schema.superclass_pairs(typed)).select("class", F.array_join("superclasses", ",").alias("superclasses"))


# --- traces, ids, texts --------------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS last_query, max(event_id) FILTER (WHERE event_type <> 'view') AS last_seq FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type <> 'view') > 0")
def trace_last_query(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return evaluate.last_queries(e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("query")), ["user_id"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def trace_explode(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "k")).where("key = 'k' AND k IS NOT NULL").select("event_id", "k")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS ok, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'view')) AS error, count(*) FILTER (WHERE event_type = 'view') AS timeout, CAST(sum(event_id % 7) AS BIGINT) AS tokens FROM events GROUP BY 1")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "OK").when(F.col("event_type") == "view", "TIMEOUT").otherwise(F.col("event_type"))
    return evaluate.run_counters(read(spark, d, "events"), ["user_id"], status, F.col("event_id") % 7)


@query("SELECT c_custkey, CASE WHEN c_nationkey < 20 AND c_nationkey % 2 = 0 THEN 'has NATION_' || c_nationkey || ' in /sid-' || c_nationkey ELSE 'has sid-' || c_nationkey || ' in /sid-' || c_nationkey END AS body, CAST(c_nationkey < 20 AND c_nationkey % 2 = 0 AS INTEGER) AS n_replaced FROM customer")
def sid_replace(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation").where("n_nationkey < 20 AND n_nationkey % 2 = 0")
    mapping = nation.select(F.concat(F.lit("sid-"), F.col("n_nationkey").cast("string")).alias("key"), F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("value"))
    k = F.col("c_nationkey").cast("string")
    rows = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("has sid-"), k, F.lit(" in /sid-"), k).alias("body"))
    return ids.replace_ids(rows, "body", mapping)


@query("SELECT doc_id, lower(trim(regexp_replace(text, '[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g'))) AS norm, trim(regexp_replace(lower(source || ' Set-1!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.norm(F.col("text")).alias("norm"), X.slug(F.concat("source", F.lit(" Set-1!"))).alias("slug"))


# --- metrics -------------------------------------------------------------------------------------------------------


@query("WITH k AS (SELECT list(lower(trim(regexp_replace(w, '\\s+', ' ', 'g')))) AS ks FROM (SELECT unnest(['the', 'and', 'MIT License', 'die', 'que', 'nicht da', 'the']) AS w)) SELECT doc_id, CAST(len(list_filter(ks, lambda x: contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), x))) AS DOUBLE) / len(ks) AS value FROM documents, k")
def metric_keyword(spark: SparkSession, d: str) -> DataFrame:
    keywords = F.array(*map(F.lit, ["the", "and", "MIT License", "die", "que", "nicht da", "the"]))
    return read(spark, d, "documents").select("doc_id", M.keyword_count_exact_match(F.col("text"), keywords)["value"].alias("value"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, expected (a user turn) and got (the next, an assistant's)."""
    c = read(spark, d, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("expected"))
    return user.join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("got")), ["conv_id", "turn"])


CHRF = """WITH p AS (SELECT u.conv_id, u.turn, regexp_replace(a.text, '\\s+', '', 'g') AS g, regexp_replace(u.text, '\\s+', '', 'g') AS e, u.text AS raw FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
n AS (SELECT unnest(range(1, 7)) AS n),
x AS (SELECT conv_id, turn, n, w, count(*) AS c FROM (SELECT conv_id, turn, n, substr(g, i, n) AS w FROM (SELECT conv_id, turn, n, g, unnest(range(1, greatest(length(g) - n + 2, 1))) AS i FROM p, n)) GROUP BY ALL),
y AS (SELECT conv_id, turn, n, w, count(*) AS c FROM (SELECT conv_id, turn, n, substr(e, i, n) AS w FROM (SELECT conv_id, turn, n, e, unnest(range(1, greatest(length(e) - n + 2, 1))) AS i FROM p, n)) GROUP BY ALL),
h AS (SELECT conv_id, turn, n, sum(least(x.c, y.c)) AS hit FROM x JOIN y USING (conv_id, turn, n, w) GROUP BY ALL),
s AS (SELECT p.conv_id, p.turn, sum(coalesce(hit, 0) / greatest(length(g) - n.n + 1, 1)) / 6 AS pr, sum(coalesce(hit, 0) / greatest(length(e) - n.n + 1, 1)) / 6 AS re, any_value(raw) AS raw FROM p CROSS JOIN n LEFT JOIN h ON h.conv_id = p.conv_id AND h.turn = p.turn AND h.n = n.n GROUP BY 1, 2)
SELECT conv_id, turn, CASE WHEN trim(raw) = '' THEN NULL WHEN pr + re > 0 THEN round(2 * pr * re / (pr + re), 6) ELSE 0.0 END AS value FROM s"""


@query(CHRF)
def metric_chrf(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "turn", F.round(M.chrf(F.col("got"), F.col("expected"))["value"], 6).alias("value"))


@query()
def metric_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "turn", F.round(M.rouge_l_f1(F.col("got"), F.col("expected"))["value"], 6).alias("value"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def metric_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    text = F.lit("given")
    return pairs.select("vec_id", F.round(M.cosine_similarity(text, text, F.col("embedding"), F.col("other"))["value"], 6).alias("value"))


@query("WITH v AS (SELECT vec_id // 8 AS k, vec_id % 8 < 4 AS got, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.k, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.k = b.k AND a.got AND NOT b.got), p AS (SELECT k, avg(m) AS p FROM (SELECT k, i, max(c) AS m FROM s GROUP BY 1, 2) GROUP BY 1), r AS (SELECT k, avg(m) AS r FROM (SELECT k, j, max(c) AS m FROM s GROUP BY 1, 2) GROUP BY 1) SELECT k, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0.0 END AS value FROM p JOIN r USING (k)")
def metric_bert_core(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("k"), (F.col("vec_id") % 8 < 4).alias("is_got"), "embedding")
    lists = e.groupBy("k").agg(F.collect_list(F.when(F.col("is_got"), F.col("embedding"))).alias("got"), F.collect_list(F.when(~F.col("is_got"), F.col("embedding"))).alias("expected"))
    full = lists.where((F.size("got") > 0) & (F.size("expected") > 0))
    return full.select("k", F.round(M.bert_core(F.col("got"), F.col("expected"))["value"], 6).alias("value"))


SETS = "WITH s AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0), []) AS e, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 1), []) AS a FROM events GROUP BY 1)"


@query(SETS + " SELECT user_id, CASE WHEN len(e) > 0 THEN CAST(len(list_intersect(e, a)) AS DOUBLE) / len(e) WHEN len(a) = 0 THEN 1.0 ELSE 0.0 END AS recall, CASE WHEN len(e) = 0 THEN CASE WHEN len(a) = 0 THEN 1.0 ELSE 0.0 END WHEN len(a) = 0 THEN 0.0 ELSE CAST(len(list_intersect(e, a)) AS DOUBLE) / len(a) END AS precision FROM s")
def metric_set_recall_precision(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    s = read(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(even, F.col("event_type"))).alias("e"), F.collect_set(F.when(~even, F.col("event_type"))).alias("a"))
    return s.select("user_id", M.set_recall(F.col("e"), F.col("a")).alias("recall"), M.set_precision(F.col("e"), F.col("a")).alias("precision"))


@query("SELECT event_id, CASE WHEN CAST(event_id % 2 = 0 AS INT) + CAST(event_id % 3 = 0 AS INT) + CAST(event_id % 5 = 0 AS INT) >= 2 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value FROM events")
def judge_majority(spark: SparkSession, d: str) -> DataFrame:
    votes = F.array(*(F.when(F.col("event_id") % k == 0, F.lit(yes)).otherwise(F.lit(no)) for k, yes, no in ((2, "PASS", "fail"), (3, "The answer is Pass.", "no idea"), (5, " pass", "FAIL, not PASS"))))
    return read(spark, d, "events").select("event_id", M.llm_judge_majority(F.lit("x"), votes)["value"].alias("value"))


@query("SELECT event_id, round((least(5, event_id % 7 + 1) + event_id % 5 + 1 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 4 END) / 3.0, 6) AS value FROM events")
def judge_score(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    votes = F.array(F.concat(F.lit('{"score": '), (i % 7 + 1).cast("string"), F.lit("}")), F.concat((i % 5 + 1).cast("string"), F.lit("/5")), F.when(i % 2 == 0, "no number").otherwise('{"score": 3.5}'))
    return read(spark, d, "events").select("event_id", F.round(M.llm_judge_score_avg(F.lit("x"), votes)["value"], 6).alias("value"))


# --- reports -------------------------------------------------------------------------------------------------------

FACTS = "WITH f AS (SELECT source AS \"llmModel\", lang AS \"categoryKey\", m AS metric, (doc_id // 20) % 2 = 0 AS original, CASE m WHEN 'quality' THEN CAST(quality AS DOUBLE) WHEN 'toxic' THEN CAST(toxic AS DOUBLE) ELSE n_chars / 1000.0 END AS value FROM labels JOIN documents USING (doc_id), (SELECT unnest(['quality', 'toxic', 'size']) AS m))"
METRIC_NAMES = ["quality", "size", "toxic"]


def facts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")
    one = lambda m, v: F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"))
    long = F.explode(F.array(one("quality", F.col("quality")), one("toxic", F.col("toxic")), one("size", F.col("n_chars") / 1000.0))).alias("x")
    return rows.select(F.col("source").alias("llmModel"), F.col("lang").alias("categoryKey"), (F.expr("doc_id div 20") % 2 == 0).alias("original"), F.lit("OK").alias("status"), long).select("*", "x.*").drop("x")


@query(FACTS + ' SELECT metric, "llmModel", "categoryKey", round(avg(value), 6) AS mean_value FROM f GROUP BY 1, 2, 3')
def fact_category_mean(spark: SparkSession, d: str) -> DataFrame:
    return reports.means(reports.valid(facts(spark, d)), ["metric", "llmModel", "categoryKey"]).withColumn("mean_value", F.round("mean_value", 6))


@query(FACTS + ' SELECT "llmModel", "categoryKey", round(avg(value) FILTER (WHERE original), 6) AS original_mean, round(avg(value) FILTER (WHERE NOT original), 6) AS mutant_mean FROM f WHERE metric = \'size\' GROUP BY 1, 2 HAVING count(*) FILTER (WHERE original) > 0 AND count(*) FILTER (WHERE NOT original) > 0')
def fact_pair_scatter(spark: SparkSession, d: str) -> DataFrame:
    got = reports.paired_means(facts(spark, d).where("metric = 'size'"), F.col("original"), ["llmModel", "categoryKey"])
    return got.withColumns({c: F.round(c, 6) for c in ("original_mean", "mutant_mean")})


@query(FACTS + ' SELECT "llmModel", round(avg(value) FILTER (WHERE metric = \'quality\'), 6) AS quality, round(avg(value) FILTER (WHERE metric = \'size\'), 6) AS size, round(avg(value) FILTER (WHERE metric = \'toxic\'), 6) AS toxic, CAST(NULL AS DOUBLE) AS absent FROM f GROUP BY 1')
def fact_pivot(spark: SparkSession, d: str) -> DataFrame:
    return reports.wide(facts(spark, d), ["llmModel"], [*METRIC_NAMES, "absent"]).select("llmModel", *(F.round(m, 6).alias(m) for m in METRIC_NAMES), "absent")


@query(FACTS + ', m AS (SELECT metric, "llmModel", avg(value) AS value FROM f GROUP BY 1, 2), w AS (SELECT *, min(value) OVER (PARTITION BY metric) AS lo, max(value) OVER (PARTITION BY metric) AS hi FROM m) SELECT metric, "llmModel", round(CASE WHEN hi = lo THEN 0.5 ELSE (value - lo) / (hi - lo) END, 6) AS normalized FROM w')
def fact_heatmap_norm(spark: SparkSession, d: str) -> DataFrame:
    means = reports.means(facts(spark, d), ["metric", "llmModel"]).withColumnRenamed("mean_value", "value")
    return reports.min_max(means, ["metric"]).select("metric", "llmModel", F.round("normalized", 6).alias("normalized"))


@query(FACTS + ", m AS (SELECT \"llmModel\", \"categoryKey\", avg(value) FILTER (WHERE metric = 'quality') AS q, avg(value) FILTER (WHERE metric = 'size') AS s, avg(value) FILTER (WHERE metric = 'toxic') AS t FROM f GROUP BY 1, 2), x AS (SELECT unnest(['quality', 'quality', 'size']) AS a, unnest(['size', 'toxic', 'toxic']) AS b), v AS (SELECT a, b, CASE a WHEN 'quality' THEN q ELSE s END AS va, CASE b WHEN 'size' THEN s ELSE t END AS vb FROM m, x), r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY va) + (count(*) OVER (PARTITION BY a, b, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY a, b ORDER BY vb) + (count(*) OVER (PARTITION BY a, b, vb) - 1) / 2.0 AS rb FROM v) SELECT a, b, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY 1, 2")
def fact_spearman(spark: SparkSession, d: str) -> DataFrame:
    matrix = reports.wide(facts(spark, d), ["llmModel", "categoryKey"], METRIC_NAMES)
    return reports.spearman_matrix(matrix, METRIC_NAMES).withColumn("rho", F.round("rho", 6))


@query("SELECT count(*) AS uncovered FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def category_uncovered(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "documents").select(F.lit("x").alias("datasetKind"), F.col("doc_id").cast("string").alias("questionId"))
    c = read(spark, d, "labels").select(F.lit("x").alias("dataset_kind"), F.col("doc_id").cast("string").alias("question_id"))
    _, uncovered = reports.categorised(f, c)
    return spark.createDataFrame([(uncovered,)], "uncovered long")


@query("SELECT alias, 'k' || n_nationkey AS category_key FROM (SELECT n_nationkey, unnest(['  ' || lower(n_name), 'bpmn::Show ' || n_nationkey]) AS alias FROM nation)")
def filter_alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    categories = n.select(F.concat(F.lit("k"), k).alias("category_key"), F.lit("bpmn").alias("dataset_kind"), F.col("n_name").alias("name"), F.concat(F.lit("Show "), k).alias("display_name"))
    asked = n.select(F.explode(F.array(F.concat(F.lit("  "), F.lower("n_name")), F.concat(F.lit("bpmn::Show "), k))).alias("alias"))
    return reports.resolve_categories(asked, categories)


@query("SELECT DISTINCT 'urn:x:customer/' || c_custkey AS uri FROM (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 20)")
def recovery_uris(spark: SparkSession, d: str) -> DataFrame:
    """A count is rewritten to its subjects, run, and the IRIs of the first 20 rows taken."""
    text = 'SELECT (COUNT(?s) AS ?n) WHERE { ?c :segment ?s . FILTER(?s = "BUILDING") } ORDER BY DESC(?n)'
    rewritten = recovered(text).replace("DESC(?c)", "ASC(?c)")
    return evaluate.uri_cells(sparql(star_graph(spark, d), rewritten, spark, PREFIXES, raw=True))


from . import catalog_records as catalog_records  # noqa: E402 - adds its queries to those above
from . import catalog_graphs as catalog_graphs  # noqa: E402 - and these
from . import catalog_sources as catalog_sources  # noqa: E402 - and these

"""Queries over recorded runs, texts, ids and reports, with the SQL that must give the same rows. The catalog adds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import FACTS, facts, query, read
from .functions import metrics as M
from .functions import text as X
from .operators import evaluate, ids, kg, reports
from .operators.matching import containing
from .plans.planner import sparql
from .plans.star import PREFIXES, star_graph
from .sources import files, results


def number() -> Column:
    return F.col("c_custkey").cast("string")


# --- texts and names -----------------------------------------------------------------------------------------------


@query(r"SELECT page_id, CASE WHEN p = '' THEN 'generic' ELSE p END AS dataset, CASE WHEN contains(lower(url), 'bpmn') THEN 'bpmn' WHEN contains(lower(url), 'sysml') THEN 'sysml' ELSE 'generic' END AS kind, 'a/b/' || page_id || '/c' AS path FROM (SELECT *, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/]+/([^/?#]+)', 1), '[^A-Za-z0-9_.\-]+', '_', 'g') AS p FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '/SysML' WHEN 1 THEN url || '?BPMN' ELSE url END AS url FROM pages))")
def text_endpoint_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 3
    pages = read(spark, d, "pages").withColumn("url", F.concat("url", F.when(k == 0, "/SysML").when(k == 1, "?BPMN").otherwise("")))
    path = F.concat(F.lit(" a\\b/"), F.col("page_id").cast("string"), F.lit("\\c "))
    return pages.select("page_id", X.endpoint_dataset(F.col("url")).alias("dataset"), X.dataset_kind(F.col("url")).alias("kind"), X.rel_path(path).alias("path"))


@query(r"SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') || '__' || regexp_replace(event_type || ' #' || user_id, '[^A-Za-z0-9_\-]+', '_', 'g') AS run_id FROM events")
def text_run_ids(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.concat("event_type", F.lit(" #"), F.col("user_id").cast("string"))
    return read(spark, d, "events").select("event_id", X.run_id(F.col("ts"), suffix).alias("run_id"))


_NS = "http://www.omg.org/spec/BPMN/20100524/MODEL"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '<bpmn:a xmlns:bpmn=\"{_NS}\" n=\"' || c_name || '\"><bpmn:b/></bpmn:a>' ELSE '<ns0:a xmlns:ns0=\"urn:other\" n=\"' || c_name || '\"><ns0:b/></ns0:a>' END AS xml FROM customer")
def text_fix_prefix(spark: SparkSession, d: str) -> DataFrame:
    space = F.when(F.col("c_custkey") % 2 == 0, _NS).otherwise("urn:other")
    xml = F.concat(F.lit('<ns0:a xmlns:ns0="'), space, F.lit('" n="'), F.col("c_name"), F.lit('"><ns0:b/></ns0:a>'))
    return read(spark, d, "customer").select("c_custkey", X.fix_prefix(xml).alias("xml"))


@query("SELECT event_id, i AS input, o AS output, CASE WHEN t = 0 THEN i + o ELSE t END AS total FROM (SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0 ELSE event_id % 97 END AS i, event_id % 11 AS o, CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE 0 END AS t FROM events)")
def trace_token_usage(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of the counts, texts that are no number, and totals that are missing or 0."""
    n = lambda m: (F.col("event_id") % m).cast("string")
    spelled = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    i = F.when(F.col("event_id") % 5 == 4, "many").otherwise(n(97))
    usage = F.map_concat(F.map_from_arrays(F.array(spelled(["inputTokens", "input_tokens", "promptTokens", "prompt_tokens"])), F.array(i)), F.map_from_arrays(F.array(spelled(["outputTokens", "output_tokens", "completionTokens", "completion_tokens"])), F.array(n(11))), F.when(F.col("event_id") % 3 == 0, F.map_from_arrays(F.array(spelled(["totalTokens", "total_tokens"])), F.array(n(7)))).otherwise(F.create_map().cast("map<string,string>")))
    return read(spark, d, "events").select("event_id", X.tokens(usage).alias("t")).select("event_id", "t.*")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'select' WHEN 1 THEN 'ask' WHEN 2 THEN 'select' ELSE 'error' END AS type, CASE c_custkey % 5 WHEN 0 THEN c_custkey WHEN 2 THEN 0 END AS rows, CASE WHEN c_custkey % 5 = 1 THEN c_custkey % 2 = 0 END AS answer, CASE c_custkey % 5 WHEN 3 THEN 'endpoint_error' WHEN 4 THEN 'tool_output_parse_error' END AS error, CASE WHEN c_custkey % 5 = 3 THEN 503 END AS http FROM customer")
def trace_tool_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    output = F.when(k == 0, F.concat(F.lit('{"status": "ok", "type": "select", "rowCount": '), number(), F.lit("}")))
    output = output.when(k == 1, F.concat(F.lit('{"status": "ok", "type": "ask", "boolean": '), (F.col("c_custkey") % 2 == 0).cast("string"), F.lit("}")))
    output = output.when(k == 2, '{"status": "empty"}').when(k == 3, '{"status": "error", "error": "endpoint_error", "httpStatus": 503}').otherwise("<html>")
    s = read(spark, d, "customer").select("c_custkey", results.tool_summary(output).alias("s"))
    return s.select("c_custkey", "s.type", F.col("s.rowsFullCount").alias("rows"), F.col("s.boolean").alias("answer"), F.col("s.errorType").alias("error"), F.col("s.httpStatus").alias("http"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'call' || c_custkey WHEN 1 THEN 'tool_0' ELSE 't9' END AS id, CASE WHEN c_custkey % 3 = 1 THEN 'ask' ELSE 'query' END AS name, CASE c_custkey % 3 WHEN 0 THEN '{\"q\":' || c_custkey || '}' WHEN 1 THEN '{\"q\": 1}' ELSE '{\"__raw\":\"SELECT ?x\"}' END AS args FROM customer UNION ALL SELECT c_custkey, 'tool_1', 'more', '{}' FROM customer WHERE c_custkey % 3 = 0")
def trace_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    direct = F.concat(F.lit('{"tool_calls": [{"id": "call'), number(), F.lit('", "name": "query", "args": {"q": '), number(), F.lit('}}, {"name": "more"}, {"id": "nameless"}]}'))
    nested = '{"additional_kwargs": {"tool_calls": [{"function": {"name": "ask", "arguments": "{\\"q\\": 1}"}}]}}'
    message = F.when(k == 0, direct).when(k == 1, nested).otherwise('{"tool_calls": [{"tool_call_id": "t9", "name": "query", "args": "SELECT ?x"}]}')
    return read(spark, d, "customer").select("c_custkey", F.explode(results.tool_calls(message)).alias("c")).select("c_custkey", "c.*")


# --- ids -----------------------------------------------------------------------------------------------------------


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation").where("n_nationkey < 20 AND n_nationkey % 2 = 0")
    return nation.select(F.concat(F.lit("sid-"), F.col("n_nationkey").cast("string")).alias("key"), F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("value"))


@query("WITH m AS (SELECT c_custkey, c_nationkey < 20 AND c_nationkey % 2 = 0 AS known, CASE WHEN c_nationkey < 20 AND c_nationkey % 2 = 0 THEN 'NATION_' ELSE 'sid-' END || c_nationkey AS new, 'sid-' || c_nationkey AS old FROM customer) SELECT c_custkey, new AS answer, 'see ' || new AS note, old AS query, CASE WHEN known THEN 2 ELSE 0 END AS n_replaced FROM m")
def sid_replace_nested(spark: SparkSession, d: str) -> DataFrame:
    """Inside JSON documents, but not below a member named query."""
    sid = F.concat(F.lit("sid-"), F.col("c_nationkey").cast("string"))
    doc = F.to_json(F.struct(F.struct(sid.alias("query")).alias("request"), F.array(sid, F.concat(F.lit("see "), sid)).alias("out")))
    got = ids.replace_ids_nested(read(spark, d, "customer").select("c_custkey", doc.alias("doc")), "doc", _mapping(spark, d))
    get = lambda p, n: F.get_json_object("doc", p).alias(n)
    return got.select("c_custkey", get("$.out[0]", "answer"), get("$.out[1]", "note"), get("$.request.query", "query"), "n_replaced")


@query("SELECT CAST(sum(CASE WHEN c_nationkey < 20 AND c_nationkey % 2 = 0 THEN c_custkey % 3 ELSE 0 END) AS BIGINT) AS replacements, count(*) FILTER (WHERE c_nationkey < 20 AND c_nationkey % 2 = 0 AND c_custkey % 3 > 0) AS changed, count(*) AS files FROM customer")
def sid_replacement_report(spark: SparkSession, d: str) -> DataFrame:
    sid = F.concat(F.lit("SID-"), F.col("c_nationkey").cast("string"), F.lit(" "))
    rows = read(spark, d, "customer").select(F.repeat(sid, (F.col("c_custkey") % 3).cast("int")).alias("body"))
    return ids.replacement_report(ids.replace_ids(rows, "body", _mapping(spark, d)))


@query("SELECT a.c_custkey FROM customer a WHERE a.c_custkey % 2 = 0 AND a.c_nationkey < 5")
def grep_model_ids(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text holds one of the listed 32-digit ids, the list cut from a table's second column."""
    customer = read(spark, d, "customer")
    listed = files.model_hashes(customer.where("c_nationkey < 5").select("c_custkey", F.concat(F.md5("c_name"), F.lit(".bpmn")).alias("file")))
    rows = customer.select("c_custkey", F.concat(F.lit("x "), F.when(F.col("c_custkey") % 2 == 0, F.md5("c_name")).otherwise("none"), F.lit(" y")).alias("body"), F.lit("gone").alias("last"))
    return files.containing_any(files.without_column(rows, 2), F.col("body"), listed).select("c_custkey")


# --- runs and evaluations ------------------------------------------------------------------------------------------


@query("SELECT 'q' || doc_id AS question_id, lang AS expected, CASE WHEN doc_id BETWEEN 1 AND 50 AND (doc_id - 1) % 3 <> 0 THEN 'k' || (doc_id - 1) ELSE '' END AS keywords, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'urn:u' || l.quality END AS uris FROM documents LEFT JOIN labels l USING (doc_id)")
def metric_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Answers with what is expected, keywords by position, and URIs; questions without these have empty lists."""
    docs, q = read(spark, d, "documents"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question_id")
    keywords = files.keyword_table(spark, [[f" k{n} ", ""] if n % 3 else "none" for n in range(50)])
    uris = read(spark, d, "labels").select(q, F.array(F.concat(F.lit("urn:u"), F.col("quality").cast("string"))).alias("uris"))
    got = evaluate.metric_input(docs.select(q, F.col("text").alias("got")), docs.select(q, F.col("lang").alias("expected")), keywords, uris)
    return got.select("question_id", "expected", F.array_join("keywords", ",").alias("keywords"), F.array_join("expected_uris", ",").alias("uris"))


@query("SELECT 'http://h/' || r_name || '/query' AS url, 'set' || r_regionkey AS dataset FROM region")
def endpoint_rules(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "region")
    return evaluate.single_rule(r.select(F.concat(F.lit("http://h/"), F.col("r_name"), F.lit("/query")).alias("url")), r.select(F.concat(F.lit("/"), F.col("r_name"), F.lit("/")).alias("pattern"), F.concat(F.lit("set"), F.col("r_regionkey").cast("string")).alias("dataset")))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def text_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages that stand in documents, all searched for in one reading of a text."""
    items = read(spark, d, "benchmark").select("item_id", F.col("text").alias("pattern"))
    hits = containing(read(spark, d, "documents").select("doc_id", "text"), "text", items.select("pattern")).where("pattern IS NOT NULL").select("doc_id", "pattern")
    return hits.join(items, "pattern").select("doc_id", "item_id")


@query("SELECT c_custkey, 'set' || c_nationkey AS question_set FROM customer")
def questions_file_rules(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c, sep: F.concat(F.lit(f"q{sep}"), F.col(c).cast("string"), F.lit(".txt"))
    runs = read(spark, d, "customer").select("c_custkey", F.concat(F.lit(" "), name("c_nationkey", "\\")).alias("questions_file"))
    rules = read(spark, d, "nation").select(name("n_nationkey", "/").alias("questions_file"), F.concat(F.lit("set"), F.col("n_nationkey").cast("string")).alias("question_set"))
    return evaluate.rule_of(runs, rules).select("c_custkey", "question_set")


@query("SELECT o_orderkey FROM orders JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (o_custkey) WHERE o_orderkey = k")
def latest_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Each run's pointer names its latest evaluation, which is not the largest id of all."""
    o = read(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("run_dir"), F.col("o_orderkey").alias("evalId"), "o_orderkey")
    pointers = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("run_dir")).agg(F.max("o_orderkey").alias("latestEvalId"))
    return evaluate.latest_only(rows, pointers).select("o_orderkey")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'm' || o_orderkey WHEN 1 THEN 'r' || o_orderkey ELSE 'run7' END AS run FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filtered_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one model and questions file, with their ids by manifest, record or folder."""
    o, k, n = read(spark, d, "orders"), F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    runs = o.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("model")).alias("llm"), F.struct(F.col("o_orderpriority").alias("questionsFile")).alias("inputs"))
    run = evaluate.run_identity(F.when(k == 0, F.concat(F.lit("m"), n)), F.when(k < 2, F.concat(F.lit("r"), n)), F.lit("/a/runs/run7/"))
    return evaluate.run_filter(runs, "F", "1-URGENT").select("o_orderkey", run.alias("run"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 4 THEN 0.0 END AS value, CASE WHEN event_id % 5 = 3 THEN 'ERROR' ELSE 'OK' END AS status FROM events")
def metric_keyword_agent(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    judged = F.when(k == 0, '{"matchedCount": 1}').when(k == 1, 'so: {"matchedCount": 9} ok').when(k == 2, '{"matchedCount": -3}').when(k == 3, "no idea").otherwise('{"matchedCount": 2}')
    got = F.when(k == 4, "  ").otherwise("x")
    s = M.keyword_counter_agent(got, F.array(F.lit("a"), F.lit("b")), judged)
    return read(spark, d, "events").select("event_id", s.alias("s")).select("event_id", "s.value", "s.status")


_URIS = {  # question: (query, expected URIs)
    "q1": ('SELECT ?c WHERE { ?c :nation ?n . ?n :name "NATION_19" . } ORDER BY ?c', [*(f"urn:x:customer/{k}" for k in range(140)), "urn:x:nation/6"]),
    "q2": ('SELECT (COUNT(?n) AS ?k) WHERE { ?n :region ?r . ?r :name "ASIA" . }', ["urn:x:nation/2", " ", "urn:x:nation/7 ", "urn:x:nation/0"]),
    "q3": ("SELECT ?c WHERE { ?c :nation", ["urn:x:customer/1"]),
    "q4": (None, []),
    "q5": ('SELECT ?n WHERE { ?n :name "ASIA" . }', None),
    "q6": ('SELECT ?n WHERE { ?n :name "NOWHERE" . }', ["urn:x:nation/1"]),
}


def _uri_scores(spark: SparkSession, d: str, on_error: str) -> DataFrame:
    """Recorded queries are run over the graph, their URIs scored against the expected ones."""
    g = star_graph(spark, d)
    rows = spark.createDataFrame([(q, text, want) for q, (text, want) in _URIS.items()], "question_id string, last_query string, expected_uris array<string>")
    found = evaluate.uri_answers(rows, lambda text: sparql(g, text, spark, PREFIXES, raw=True))
    c = {n: F.col(n) for n in found.columns}
    scored = found.select("question_id", M.uri_metric(True, on_error)(c).alias("r"), M.uri_metric(False, on_error)(c).alias("p"))
    return scored.select("question_id", F.round("r.value", 6).alias("recall"), F.round("p.value", 6).alias("precision"), F.col("r.status").alias("status"))


_SCORED = """WITH a AS (SELECT 'q1' AS question_id, 'urn:x:customer/' || c_custkey AS uri FROM (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_19' ORDER BY 'urn:x:customer/' || c_custkey LIMIT 20)
UNION ALL SELECT 'q2', 'urn:x:nation/' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'),
e AS (SELECT unnest(['q1', 'q2', 'q2', 'q2']) AS question_id, unnest(['urn:x:nation/6', 'urn:x:nation/2', 'urn:x:nation/7', 'urn:x:nation/0']) AS uri UNION ALL SELECT 'q1', 'urn:x:customer/' || unnest(range(140))),
q AS (SELECT unnest(['q1', 'q2']) AS question_id), h AS (SELECT question_id, count(*) AS n FROM a JOIN e USING (question_id, uri) GROUP BY 1)
SELECT q.question_id, round(coalesce(h.n, 0) / (SELECT count(*) FROM e WHERE e.question_id = q.question_id), 6) AS recall,
  round(CASE WHEN (SELECT count(*) FROM a WHERE a.question_id = q.question_id) = 0 THEN 0.0 ELSE coalesce(h.n, 0) / (SELECT count(*) FROM a WHERE a.question_id = q.question_id) END, 6) AS precision, 'OK' AS status FROM q LEFT JOIN h USING (question_id) UNION ALL SELECT unnest(['q3', 'q4', 'q5', 'q6']), """


@query(_SCORED + "NULL, NULL, 'ERROR'")
def metric_uri_strict(spark: SparkSession, d: str) -> DataFrame:
    return _uri_scores(spark, d, "throw")


@query(_SCORED + "0.0, 0.0, 'OK'")
def metric_uri_lenient(spark: SparkSession, d: str) -> DataFrame:
    return _uri_scores(spark, d, "zero")


@query("SELECT 'all' AS name, 'ok' AS status, 'select' AS type, (SELECT count(*) FROM customer) AS rows, 20 AS shown, (SELECT count(*) > 20 FROM customer) AS truncated, NULL AS answer, NULL AS error UNION ALL SELECT 'ask', 'ok', 'ask', NULL, NULL, NULL, true, NULL UNION ALL SELECT 'none', 'empty', NULL, 0, NULL, NULL, NULL, 'empty' UNION ALL SELECT 'bad', 'error', NULL, NULL, NULL, NULL, NULL, 'query_error'")
def query_records(spark: SparkSession, d: str) -> DataFrame:
    """Queries run to records: rows counted, a sample shown, errors told."""
    g = star_graph(spark, d)
    texts = {"all": "SELECT ?c ?n WHERE { ?c :nation ?n . }", "ask": "ASK { ?r :name \"ASIA\" . }", "none": "SELECT ?x WHERE { ?x :name \"NOWHERE\" . }", "bad": "SELECT ?x WHERE {"}
    got = results.records(spark, g, texts, PREFIXES)
    return got.select("name", "status", "type", F.col("rowCount").alias("rows"), F.when(F.size("rows") > 0, F.size("rows")).alias("shown"), F.col("rowsTruncated").alias("truncated"), F.col("boolean").alias("answer"), "error")


# --- reports -------------------------------------------------------------------------------------------------------


@query(FACTS + ', m AS (SELECT metric, "llmModel", avg(value) AS value FROM f GROUP BY 1, 2), w AS (SELECT *, min(value) OVER (PARTITION BY "llmModel") AS lo, max(value) OVER (PARTITION BY "llmModel") AS hi FROM m) SELECT metric, "llmModel", round(CASE WHEN hi = lo THEN 0.5 ELSE (value - lo) / (hi - lo) END, 6) AS normalized FROM w')
def fact_column_norm(spark: SparkSession, d: str) -> DataFrame:
    means = reports.means(facts(spark, d), ["metric", "llmModel"]).withColumnRenamed("mean_value", "value")
    return reports.min_max(means, ["llmModel"]).select("metric", "llmModel", F.round("normalized", 6).alias("normalized"))


@query(FACTS + ", m AS (SELECT metric, min(value) AS lo, max(value) AS hi, avg(value) AS v FROM f GROUP BY 1) SELECT metric, round(CASE metric WHEN 'quality' THEN v WHEN 'toxic' THEN v / 2 ELSE (v - lo) / (hi - lo) END, 6) AS normalized, CASE metric WHEN 'quality' THEN '0:quality' WHEN 'size' THEN '1:size' ELSE '~:toxic' END AS place FROM m")
def fact_fixed_range(spark: SparkSession, d: str) -> DataFrame:
    """Known metrics by their own range, others by the data's; and the order in which metrics are shown."""
    m = facts(spark, d).groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("v"))
    one = lambda lo, hi: reports.fixed_range(F.col("v"), lo, hi, F.col("lo"), F.col("hi"))
    value = F.when(F.col("metric") == "quality", one(0.0, 1.0)).when(F.col("metric") == "toxic", one(0.0, 2.0)).otherwise(one(None, None))
    return m.select("metric", F.round(value, 6).alias("normalized"), reports.metric_order(F.col("metric"), ["quality", "size"]).alias("place"))


@query(FACTS + " SELECT round(min(value) - (max(value) - min(value)) * 0.05, 6) AS low, round(max(value) + (max(value) - min(value)) * 0.05, 6) AS high FROM f WHERE metric = 'size'")
def fact_axis_limits(spark: SparkSession, d: str) -> DataFrame:
    got = reports.axis_limits(facts(spark, d).where("metric = 'size'"), "value")
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query(FACTS + ' SELECT metric, round(avg(value) FILTER (WHERE "categoryKey" = \'en\'), 6) AS en, round(avg(value) FILTER (WHERE "categoryKey" = \'de\'), 6) AS de FROM f GROUP BY 1')
def fact_transposed(spark: SparkSession, d: str) -> DataFrame:
    """Metrics as rows and categories as columns: the pivot on the other key."""
    rows = facts(spark, d).withColumnsRenamed({"metric": "row"}).withColumnRenamed("categoryKey", "metric")
    return reports.wide(rows, ["row"], ["en", "de"]).select(F.col("row").alias("metric"), F.round("en", 6).alias("en"), F.round("de", 6).alias("de"))


@query(FACTS + " SELECT count(*) AS n, count(DISTINCT \"llmModel\") AS models FROM f WHERE metric IN ('size', 'toxic') AND \"categoryKey\" = 'en'")
def fact_restricted(spark: SparkSession, d: str) -> DataFrame:
    kept = reports.restrict(facts(spark, d), metric=reports.listed_values(["size , toxic", ","]), categoryKey=["en"], llmModel=None)
    return kept.agg(F.count("*").alias("n"), F.count_distinct("llmModel").alias("models"))


_SETS = "WITH s AS (SELECT DISTINCT c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN '_questions' ELSE '_mutant_questions' END AS q FROM customer), p AS (SELECT a.q AS original, b.q AS mutant FROM s a JOIN s b ON b.q = replace(a.q, '_questions', '_mutant_questions') AND a.q NOT LIKE '%mutant%')"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "_questions").otherwise("_mutant_questions"))
    return reports.question_set_pairs(read(spark, d, "customer").select(name.alias("questionSet")).distinct())


@query(_SETS + " SELECT original, mutant FROM p")
def question_set_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query(_SETS + " SELECT 'orig' AS mode, count(*) AS n, min(original) AS least FROM p UNION ALL SELECT 'mutant', count(*), min(mutant) FROM p UNION ALL SELECT 'orig+mutant', 2 * count(*), least(min(original), min(mutant)) FROM p")
def question_set_modes(spark: SparkSession, d: str) -> DataFrame:
    pairs, out = _pairs(spark, d), None
    for mode in ("orig", "mutant", "orig+mutant"):
        one = reports.selected_sets(pairs, mode).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.min("questionSet").alias("least"))
        out = one if out is None else out.union(one)
    return out


# --- graphs and tables ---------------------------------------------------------------------------------------------


@query("SELECT 'urn:x:customer/' || c_custkey AS s FROM customer WHERE c_nationkey % 2 = 1")
def graph_difference(spark: SparkSession, d: str) -> DataFrame:
    edges = lambda df: df.select(F.concat(F.lit("urn:x:customer/"), number()).alias("s"), F.lit("urn:x:in").alias("p"), F.col("c_nationkey").cast("string").alias("o"))
    c = read(spark, d, "customer")
    return kg.difference(edges(c), edges(c.where("c_nationkey % 2 = 0"))).select("s")


@query("SELECT true AS same, (SELECT count(*) = 0 FROM nation WHERE n_nationkey = 0) AS same_less_one")
def graph_equality(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    rows = [(kg.same_graph(n, n.union(n).orderBy("n_name")), kg.same_graph(n, n.where("n_nationkey <> 0")))]
    return spark.createDataFrame(rows, "same boolean, same_less_one boolean")


@query("SELECT r_regionkey AS k, r_name AS name, NULL AS region FROM region UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation")
def table_header_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows under the columns of all tables, in the order in which they first come up."""
    region = read(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return files.header_union(region, read(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("k")))

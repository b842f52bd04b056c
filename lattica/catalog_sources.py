"""Queries that write tables as the files that runs, questions and models come in, read them, and must give the tables' rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as T
from .catalog import over_star, query, read
from .catalog_graphs import folder
from .functions import text as X
from .operators import kg, reports, schema
from .plans.graph import Graph
from .plans.planner import sparql
from .plans.recovery import recovered
from .plans.star import NS, PREFIXES, star_graph
from .sources import files, serialise
from .sources.turtle import read_turtle
from .streaming import traces


def number(c: str) -> Column:
    return F.col(c).cast("string")


def text_files(rows: DataFrame, name: str, value: Column, by: str | None = None) -> str:
    """A folder of text files of value; by: a file a value of this column at least."""
    path = folder(rows.sparkSession, name)
    if by:
        rows.select(by, value.alias("value")).write.partitionBy(by).text(path)
        return f"{path}/*/*.txt"
    rows.select(value.alias("value")).write.text(path)
    return path


# --- questions, answers, settings ----------------------------------------------------------------------------------


@query("SELECT 'q' || c_custkey AS question_id, c_name || chr(9) || c_mktsegment AS question FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0")
def source_questions(spark: SparkSession, d: str) -> DataFrame:
    """Lines with further tabs, white space around fields, carriage returns, missing texts and empty lines."""
    k = F.col("c_custkey")
    whole = F.concat(F.lit(" q"), number("c_custkey"), F.lit("\t "), F.col("c_name"), F.lit("\t"), F.col("c_mktsegment"), F.lit(" \r\n"))
    line = F.when(k % 7 == 0, F.concat(F.lit("q"), number("c_custkey"))).when(k % 5 == 0, F.concat(F.lit("q"), number("c_custkey"), F.lit("\t "))).otherwise(whole)
    return files.questions(spark, text_files(read(spark, d, "customer"), "questions", line)).select("question_id", "question")


@query("SELECT 'c' || o_custkey AS question_id, arg_max(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus || chr(9) || o_orderkey END, o_orderkey) AS expected FROM orders GROUP BY o_custkey")
def source_expected(spark: SparkSession, d: str) -> DataFrame:
    """The last line of an id counts, an empty answer stays: all orders of a customer are in one file, in order."""
    o = read(spark, d, "orders").repartition("o_custkey").sortWithinPartitions("o_orderkey")
    answer = F.when(F.col("o_orderkey") % 4 == 0, F.lit(" ")).otherwise(F.concat(F.col("o_orderstatus"), F.lit("\t"), number("o_orderkey")))
    return files.expected(spark, text_files(o, "expected", F.concat(F.lit("c"), number("o_custkey"), F.lit("\t"), answer)))


@query("SELECT 'http://h/' || n_name AS endpoint FROM nation WHERE n_nationkey = 3")
def source_endpoint(spark: SparkSession, d: str) -> DataFrame:
    """The first line that is no comment: nations as a list of endpoints, the first three commented out."""
    k = F.col("n_nationkey")
    line = F.concat(F.when(k == 0, "# ").when(k == 1, " // ").when(k == 2, "#").otherwise("  "), F.lit("http://h/"), F.col("n_name"))
    path = text_files(read(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey"), "endpoint", line)
    return spark.createDataFrame([(files.endpoint(spark, path),)], "endpoint string")


@query("SELECT 'default' AS question_set, CAST(n_nationkey AS INTEGER) AS position, list_filter([n_name, n_name || '''s \"x\"'], lambda x: n_nationkey % 3 <> 0 OR x = n_name) AS keywords FROM nation")
def source_keywords(spark: SparkSession, d: str) -> DataFrame:
    """A script of keyword lists, with comments, three kinds of quotes and empty entries."""
    n = read(spark, d, "nation")
    name = F.col("n_name")
    row = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("['"), name, F.lit("', ' ', ``], // one"))).otherwise(F.concat(F.lit('[" '), name, F.lit(' ", `'), name, F.lit("'s \"x\"`], /* two */")))
    lines = [r[0] for r in n.orderBy("n_nationkey").select(row).collect()]  # one line a nation: a script is one small file
    return files.keyword_table(spark, files.keyword_module("// lists\nexport const KEYWORDS_BPMN: string[][] = [\n" + "\n".join(lines) + "\n];\n"))


@query("SELECT 'q' || n_nationkey AS question_id, ['urn:x:nation/' || n_nationkey, 'urn:x:region/' || n_regionkey] AS uris FROM nation")
def source_expected_uris(spark: SparkSession, d: str) -> DataFrame:
    """A file a region; an earlier entry of a question gives way to the last one."""
    n = read(spark, d, "nation")
    entry = lambda q, *uris: F.struct(q.alias("questionId"), F.array(*uris).alias("model_element_uris"))
    q = F.concat(F.lit("q"), number("n_nationkey"))
    first = entry(q, F.lit("urn:x:old"))
    last = entry(q, F.concat(F.lit(" urn:x:nation/"), number("n_nationkey")), F.lit(" "), F.concat(F.lit("urn:x:region/"), number("n_regionkey"), F.lit(" ")))
    doc = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.concat(F.collect_list(first), F.collect_list(last)).alias("questions"))).alias("doc"))
    return files.expected_uris(spark, text_files(doc, "uris", F.col("doc"), "n_regionkey"))


@query("SELECT 'sysml' AS dataset_kind, 'sysml::' || r_name AS category_key, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'Show ' || r_name ELSE r_name END AS display_name, 'q' || n_nationkey AS question_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_categories(spark: SparkSession, d: str) -> DataFrame:
    """A category a region, each in a file of its own; every other one has a name to show."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    shown = F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("Show "), F.col("r_name")))
    one = n.groupBy("r_regionkey", "r_name").agg(F.collect_list(F.concat(F.lit("q"), number("n_nationkey"))).alias("questions"))
    doc = F.to_json(F.array(F.struct(F.col("r_name").alias("name"), shown.alias("displayName"), "questions")))
    return files.categories(spark, text_files(one, "categories", doc, "r_regionkey"), "sysml")


@query("SELECT 'q/' || n_name || '.txt' AS questions_file, 'set' || n_nationkey AS \"questionSetId\", 'a' || n_nationkey AS \"expectedAnswersFile\", CASE WHEN n_nationkey % 2 = 0 THEN 'k' || n_nationkey END AS \"expectedKeywordsFile\", 'bpmn' AS \"datasetKind\" FROM nation")
def source_evaluation_config(spark: SparkSession, d: str) -> DataFrame:
    """Settings of a questions file a nation, in a file a region; paths with backslashes."""
    n = read(spark, d, "nation")
    named = lambda letter: F.concat(F.lit(letter), number("n_nationkey"))
    own = F.struct(named("set").alias("questionSetId"), named("a").alias("expectedAnswersFile"), F.when(F.col("n_nationkey") % 2 == 0, named("k")).alias("expectedKeywordsFile"), F.lit("bpmn").alias("datasetKind"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(" q\\"), F.col("n_name"), F.lit(".txt ")).alias("key"), own.alias("value"))))
    doc = n.groupBy("n_regionkey").agg(F.to_json(F.struct(entries.alias("questionSets"))).alias("doc"))
    return files.evaluation_config(spark, text_files(doc, "config", F.col("doc"), "n_regionkey"))


# --- runs, traces, metrics -----------------------------------------------------------------------------------------


@query("SELECT 'set' || n_regionkey AS dataset, 'run' || n_nationkey AS run_dir, 'r' || n_nationkey AS \"runId\", n_name AS model, CAST(n_nationkey % 4 AS INTEGER) AS ok FROM nation")
def source_runs(spark: SparkSession, d: str) -> DataFrame:
    """A record a nation, written as indented JSON into the folder of its run, and all found again below the root."""
    root = folder(spark, "runs")
    for r in read(spark, d, "nation").collect():  # one file a run, as a run writes its own
        key = r["n_nationkey"]
        files.write_record(spark, {"schemaVersion": "v2", "runId": f"r{key}", "llm": {"model": r["n_name"]}, "counts": {"ok": key % 4}}, f"{root}/set{r['n_regionkey']}/runs/run{key}/run.meta.json")
    return files.runs(spark, root).select("dataset", "run_dir", "runId", F.col("llm.model").alias("model"), F.col("counts.ok").alias("ok"))


@query("SELECT 'q' || c_nationkey AS question_id, CAST(c_custkey AS INTEGER) AS seq, CASE WHEN c_custkey % 2 = 0 THEN 'llm_call' ELSE 'tool_exec' END AS kind, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS query, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 END AS tokens FROM customer")
def source_traces(spark: SparkSession, d: str) -> DataFrame:
    """A trace a nation, its customers as events, one JSON document a file; nested fields that some events lack."""
    c = read(spark, d, "customer")
    even = F.col("c_custkey") % 2 == 0
    event = F.struct(F.col("c_custkey").alias("seq"), F.when(even, "llm_call").otherwise("tool_exec").alias("kind"), F.when(~even, F.struct(F.col("c_name").alias("query"))).alias("request"), F.when(even, F.struct((F.col("c_custkey") * 10).alias("totalTokens"))).alias("tokenUsage"))
    doc = c.groupBy("c_nationkey").agg(F.collect_list(event).alias("events"))
    trace = F.to_json(F.struct(F.struct(F.concat(F.lit("q"), number("c_nationkey")).alias("questionId")).alias("meta"), F.struct("events").alias("conversation")))
    got = files.traces(spark, text_files(doc, "traces", trace, "c_nationkey"))
    events = got.select(F.col("meta.questionId").alias("question_id"), F.explode("conversation.events").alias("e"))
    return events.select("question_id", "e.seq", "e.kind", F.col("e.request.query").alias("query"), F.col("e.tokenUsage.totalTokens").alias("tokens"))


@query("SELECT user_id, count(*) AS events, CAST(sum(event_id % 7) AS BIGINT) AS tokens, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS last_query, max(event_id) FILTER (WHERE event_type <> 'view') AS last_seq FROM events GROUP BY 1")
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive in several batches: the state that they leave is that of all of them."""
    path = folder(spark, "stream")
    events = read(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("query"), (F.col("event_id") % 7).alias("tokens"))
    events.repartition(6).write.parquet(f"{path}/arriving")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/arriving")
    traces.reduce_stream(stream, ["user_id"], path).awaitTermination()
    return traces.settled(spark, ["user_id"], path)


@query("SELECT 'q' || doc_id AS \"questionId\", m AS metric, CASE m WHEN 'quality' THEN CAST(quality AS DOUBLE) ELSE CAST(toxic AS DOUBLE) / 2 END AS value FROM labels, (SELECT unnest(['quality', 'toxic']) AS m)")
def sink_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Scores written as JSON lines, a folder a metric, and read again."""
    one = lambda m, v: F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"))
    rows = read(spark, d, "labels").select(F.concat(F.lit("q"), number("doc_id")).alias("questionId"), F.lit("OK").alias("status"), F.inline(F.array(one("quality", F.col("quality")), one("toxic", F.col("toxic") / 2))))
    path = folder(spark, "scores")
    files.write_json_lines(rows, path)
    return files.json_lines(spark, path).select("questionId", "metric", F.try_variant_get("value", "$", "double").alias("value"))


@query("SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS value FROM orders WHERE o_orderkey % 3 = 1")
def source_metrics_csv(spark: SparkSession, d: str) -> DataFrame:
    """The long fact table through CSV: texts with commas, quotes and line ends; rows with other states or no number are left out."""
    o = read(spark, d, "orders")
    k = F.col("o_orderkey") % 3
    odd = F.lit('a, "b"\nc')
    rows = o.select(number("o_orderkey").alias("runId"), odd.alias("llmModel"), F.lit("x").alias("datasetKind"), F.lit("e").alias("evalId"), F.lit(None).cast("string").alias("questionSet"), F.lit("q").alias("questionId"), F.lit("m").alias("metric"), F.when(k == 2, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("value"), F.when(k == 0, "ERROR").otherwise("OK").alias("status"))
    path = folder(spark, "metrics-csv")
    files.write_csv(rows, path)
    got = reports.valid(spark.read.csv(path, header=True, multiLine=True, escape='"').where(F.col("llmModel") == odd))
    return got.select(F.col("runId").cast("long").alias("k"), "value")


# --- dictionaries and reports as text -------------------------------------------------------------------------------


@query("SELECT CAST(c_nationkey AS VARCHAR) AS k, arg_max(c_name, c_custkey) AS name FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1")
def source_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """A CSV whose last row of a key counts; rows with an empty key are skipped."""
    c = read(spark, d, "customer").coalesce(1).sortWithinPartitions("c_custkey")
    path = folder(spark, "dictionary")
    files.write_csv(c.select(F.when(F.col("c_nationkey") % 5 != 0, number("c_nationkey")).alias("k"), F.col("c_name").alias("name")), path)
    return files.dictionary(spark, path, "k")


@query("SELECT 'c-' || c_custkey AS key, c_name AS value FROM customer WHERE c_custkey % 9 <> 0")
def source_id_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Keys in lower case, values without a file ending in any case; rows without a value are skipped."""
    k = F.col("c_custkey")
    value = F.when(k % 9 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.when(k % 2 == 0, ".BPMN").otherwise(".bpmn")))
    path = folder(spark, "mapping")
    files.write_csv(read(spark, d, "customer").select(F.concat(F.lit("C-"), number("c_custkey")).alias("Hash"), value.alias("Name")), path)
    return files.id_mapping(spark, path, "Hash", "Name")


@query("SELECT r_name || ': ' || string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS line FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def sink_class_lists(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = folder(spark, "lists")
    files.class_lists(n.select(F.col("r_name").alias("class"), F.col("n_name").alias("predicate")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS s, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS name FROM nation")
def sink_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Results in SPARQL's JSON format as a table, missing bindings empty."""
    cell = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    row = F.struct(cell("uri", number("n_nationkey")).alias("s"), F.when(F.col("n_nationkey") % 3 != 0, cell("literal", F.col("n_name"))).alias("name"))
    doc = read(spark, d, "nation").agg(F.to_json(F.struct(F.struct(F.array(F.lit("s"), F.lit("name")).alias("vars")).alias("head"), F.struct(F.collect_list(row).alias("bindings")).alias("results"))).alias("doc"))
    return files.flattened_bindings(spark.read.json(text_files(doc, "bindings", F.col("doc")), multiLine=True))


@query("SELECT 'http://h/' || n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS again FROM nation WHERE n_nationkey < 4")
def sink_unique_folder(spark: SparkSession, d: str) -> DataFrame:
    """Folders of the same name get a number: nations of even keys ask twice."""
    root, made = folder(spark, "unique"), []
    for r in read(spark, d, "nation").where("n_nationkey < 4").collect():
        names = [files.unique_folder(spark, f"{root}/{r['n_name']}") for _ in range(2 - r["n_nationkey"] % 2)]
        made.append(("http://h/" + names[0].rsplit("/", 1)[-1], int(names[-1].endswith("__r01"))))
    return spark.createDataFrame(made, "name string, again int")


# --- texts -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a%20b%2F' || o_orderkey || '~%2A' ELSE 'x' || o_orderkey END AS fragment, strftime(o_orderdate, '%Y-%m-%dT%H:%M') || ' z' AS at, 'f.' || o_orderkey AS stem FROM orders")
def text_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Percent-encoding, times with a T, names of files without their last ending."""
    n = number("o_orderkey")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("a b/"), n, F.lit("~*"))).otherwise(F.concat(F.lit("x"), n))
    at = F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), F.lit(" z"))
    return read(spark, d, "orders").select("o_orderkey", X.uri_fragment(raw).alias("fragment"), X.date_time(at).alias("at"), X.stem(F.concat(F.lit("d.e/g\\f."), n, F.lit(".ttl"))).alias("stem"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'urn:v' ELSE 'Part' END AS class, CASE WHEN c_custkey % 2 = 0 THEN 'Part_n' || c_custkey ELSE 'n_' || c_custkey END AS predicate FROM customer")
def text_predicate_parts(spark: SparkSession, d: str) -> DataFrame:
    n = number("c_custkey")
    given = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("urn:v#Part_n"), n)).otherwise(F.concat(F.lit("Part_n_"), n))
    return read(spark, d, "customer").select("c_custkey", X.predicate_parts(given).alias("x")).select("c_custkey", "x.*")


@query("SELECT c_custkey, '<e isInterrupting=' || CASE WHEN c_custkey % 2 = 0 THEN '\"true\"' ELSE '\"no\"' END || ' id=\"' || c_custkey || '\" isImmediate=\"true\"/>' AS xml FROM customer")
def text_fix_flags(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("c_custkey") % 2 == 0, "isInterrupting").otherwise('isInterrupting="no"')
    return read(spark, d, "customer").select("c_custkey", X.fix_flags(F.concat(F.lit("<e "), flag, F.lit(' id="'), number("c_custkey"), F.lit('" isImmediate/>'))).alias("xml"))


# --- graphs ----------------------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT '{NS}customer/' || c_custkey AS x FROM customer WHERE c_custkey % 3 = 1 AND c_mktsegment = 'BUILDING'")
def kg_language_terms(spark: SparkSession, d: str) -> DataFrame:
    """Equality of terms by value and language: of plain, English and German segments only the English are asked for."""
    c = read(spark, d, "customer")
    s = F.concat(F.lit(f"<{NS}customer/"), number("c_custkey"), F.lit(">"))
    v = F.col("c_mktsegment")
    o = F.when(F.col("c_custkey") % 3 == 0, T.literal(v)).when(F.col("c_custkey") % 3 == 1, T.literal(v, lang="en")).otherwise(T.literal(v, lang="de"))
    g = Graph({f"<{NS}label>": c.select(s.alias("s"), o.alias("o"))})
    return sparql(g, 'SELECT DISTINCT ?x WHERE { ?x :label "BUILDING"@en . ?x :label ?l . FILTER(LANG(?l) = "en" && ?l = "BUILDING"@en && ?l != "BUILDING") }', spark, PREFIXES)


over_star("kg_disconnected", 'SELECT ?a ?b WHERE { ?a :name "ASIA" . ?b :base ?n ; :name ?s . FILTER(STRENDS(?s, "7")) }', "SELECT 'urn:x:region/' || r_regionkey AS a, 'urn:x:supplier/' || s_suppkey AS b FROM region, supplier WHERE r_name = 'ASIA' AND ends_with(s_name, '7')")
over_star("kg_nested_groups", 'SELECT ?p WHERE { { { ?p :size ?s . FILTER(?s > 45) } } # a comment\n { ?p :brand ?b } }', "SELECT 'urn:x:part/' || p_partkey AS p FROM part WHERE p_size > 45 AND p_brand IS NOT NULL")


@query("SELECT 'm' || n_regionkey AS model, list_sort(list_distinct(list('<urn:x:n' || n_nationkey || '>'))) AS nodes FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1")
def graph_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Nodes typed by a class that ends in Definitions; other classes and blank nodes are left out."""
    n = read(spark, d, "nation")
    s = F.concat(F.lit("<urn:x:n"), number("n_nationkey"), F.lit(">"))
    kind = F.when(F.col("n_nationkey") % 2 == 1, "<urn:v#Definition>").when(F.col("n_nationkey") % 4 == 0, "<urn:v#Definitions>").otherwise("<urn:v/Definitions>")
    rows = n.select(s.alias("s"), F.lit(f"<{T.RDF}type>").alias("p"), kind.alias("o"), F.concat(F.lit("m"), number("n_regionkey")).alias("model"))
    return kg.definitions_nodes(rows.union(n.select(F.concat(F.lit("_:b"), number("n_nationkey")), F.lit(f"<{T.RDF}type>"), F.lit("<urn:v#Definitions>"), F.lit("m0"))))


@query("""
WITH o AS (SELECT *, 'Org' || dense_rank() OVER (ORDER BY c_mktsegment) AS label FROM customer)
SELECT '<urn:x:Corpus>' AS s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS p, '<urn:e:Corpus>' AS o UNION SELECT '<urn:x:Organization/' || c_mktsegment || '>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<urn:e:Organization>' FROM o
UNION SELECT '<urn:x:Organization/' || c_mktsegment || '>', '<urn:x:in>', '<urn:x:Corpus>' FROM o UNION SELECT '<urn:x:Organization/' || c_mktsegment || '>', '<http://www.w3.org/2000/01/rdf-schema#label>', '"' || label || '"@en' FROM o
UNION SELECT '<urn:x:Organization/' || c_mktsegment || '>', '<urn:x:organizationId>', '"' || c_mktsegment || '"' FROM o UNION SELECT '<urn:x:Model/m%20' || c_custkey || '>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<urn:e:Model>' FROM o
UNION SELECT '<urn:x:Model/m%20' || c_custkey || '>', '<urn:x:in>', '<urn:x:Organization/' || c_mktsegment || '>' FROM o UNION SELECT '<urn:x:Model/m%20' || c_custkey || '>', '<urn:x:originalId>', '"' || c_custkey || '"' FROM o
UNION SELECT '<urn:x:Model/m%20' || c_custkey || '>', '<urn:x:normalizedId>', '"m ' || c_custkey || '"' FROM o UNION SELECT '<urn:x:Model/m%20' || c_custkey || '>', '<urn:x:name>', '"' || c_name || '"' FROM o
UNION SELECT '<urn:x:Model/m%20' || c_custkey || '>', '<urn:x:modelCreated>', '"2020-01-01T10:00"^^<http://www.w3.org/2001/XMLSchema#dateTime>' FROM o UNION SELECT '<urn:d:' || c_custkey || '>', '<urn:x:in>', '<urn:x:Model/m%20' || c_custkey || '>' FROM o WHERE c_custkey % 3 = 1
""")
def graph_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Corpus, organisations and models above the definitions nodes; models with none or two of these are not linked to them."""
    c = read(spark, d, "customer")
    n, node = number("c_custkey"), F.concat(F.lit("<urn:d:"), number("c_custkey"), F.lit(">"))
    k = F.col("c_custkey") % 3
    models = c.select(F.concat(F.lit("m "), n).alias("model"), n.alias("original_id"), F.col("c_mktsegment").alias("organization_id"), F.col("c_name").alias("name"), F.lit("2020-01-01 10:00").alias("datetime"), F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(node)).otherwise(F.array(node, node)).alias("definitions"))
    return kg.hierarchy(models.join(kg.organization_labels(models), "organization_id", "left"), "urn:x:", "urn:x:in", "urn:e:")


@query("SELECT 'S' || n_nationkey % 5 AS class, list_sort(list_distinct(list(n_name))) AS predicates FROM nation GROUP BY 1")
def schema_predicates(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    return schema.predicates_by_class(n.select(F.concat(F.lit("S"), (F.col("n_nationkey") % 5).cast("string")).alias("class"), F.col("n_name").alias("predicate")).union(n.select(F.concat(F.lit("S"), (F.col("n_nationkey") % 5).cast("string")), "n_name")))


@query(f"SELECT '<{NS}customer/' || c_custkey || '>' AS s, '<{NS}nation>' AS p, '<{NS}nation/' || c_nationkey || '>' AS o FROM customer UNION ALL SELECT '<{NS}customer/' || c_custkey || '>', '<{NS}segment>', '\"' || c_mktsegment || '\"' FROM customer")
def sink_ntriples(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d).only([f"<{NS}nation>", f"<{NS}segment>"])
    path = folder(spark, "ntriples")
    files.write_ntriples(g.triples(), path)
    return read_turtle(spark, path).select("s", "p", "o")


@query(f"SELECT '<{NS}part/' || p_partkey || '>' AS s FROM part")
def graph_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of folded Turtle: each subject is the head of a statement (of two, if a range ends within it)."""
    g = star_graph(spark, d).only([f"<{NS}{p}>" for p in ("partname", "brand", "size")])
    lines = serialise.documents(g.triples(), "turtle")
    return lines.select(F.regexp_extract("value", "^(<[^>]*>) ", 1).alias("s")).where("s <> ''").distinct()


# --- recovered queries: what a count was about -----------------------------------------------------------------------


def over_recovered(name: str, text: str, sql: str) -> None:
    """The rewriting of a query that counts, as it stands, over the star graph."""
    over_star(name, recovered(text), sql)


over_recovered("recovery_grouped", "SELECT (COUNT(DISTINCT ?c) AS ?k) ?n WHERE { ?c :nation ?n . } GROUP BY ?n ORDER BY DESC(?k) LIMIT 5", "SELECT 'urn:x:customer/' || c_custkey AS c FROM customer ORDER BY 1 DESC LIMIT 5")
over_recovered("recovery_filtered", "SELECT (AVG(?t) AS ?m) (COUNT(?o) AS ?k) WHERE { ?o :total ?t ; :priority ?p . FILTER(?t > 400000) } GROUP BY ?p", "SELECT 'urn:x:order/' || o_orderkey AS o FROM orders WHERE o_totalprice > 400000")

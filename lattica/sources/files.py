"""Readers and writers of questions, answers, dictionaries, run traces and metric rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .turtle import read_turtle as parsed_turtle  # noqa: F401

USAGE = "struct<inputTokens: bigint, outputTokens: bigint, totalTokens: bigint>"
EVENT = f"struct<seq: int, kind: string, callId: string, node: string, toolCallId: string, parentCallId: string, toolName: string, durationMs: bigint, status: string, output: string, tokenUsage: {USAGE}, request: struct<query: string, answer: string, event: string, status: string, rowCount: bigint, decision: string, reason: string, confidence: double>, resultSummary: struct<type: string, rowsFullCount: bigint, `boolean`: boolean, empty: boolean, errorType: string>, error: struct<code: string, message: string>>"
TRACE = f"top struct<schemaVersion: string, runMetaRelPath: string>, meta struct<questionId: string, question: string, durationMs: bigint, status: string, finalAnswer: string, error: struct<code: string, message: string>, tokenUsage: {USAGE}>, conversation struct<traceVersion: string, events: array<{EVENT}>>"
RUN = f"schemaVersion string, runId string, durationMs bigint, inputs struct<questionsFile: string, questionsCount: int, endpointUrl: string, systemPromptName: string>, llm struct<model: string, temperature: double, maxSteps: int>, counts struct<ok: int, error: int, timeout: int>, tokenUsage {USAGE}"
METRIC_ROW = "questionId string, metric string, scoredAt string, value variant, status string, error string"
MANIFEST = "evalId string, runId string, inputs struct<datasetName: string, datasetKind: string, questionSetId: string, modelName: string>, finishedAt string"
CATEGORY = "array<struct<name: string, displayName: string, questions: array<string>>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), value of text files; a byte order mark and carriage returns are dropped.

    Files are read whole, one a row, since line numbers need it: these are question lists, not data tables.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question: two fields at least, later tabs belong to the text; incomplete rows are dropped."""
    parts = F.split("value", "\t", 2)
    rows = lines(spark, path).where(F.size(parts) >= 2).select("file", "line_no", F.trim(parts[0]).alias("question_id"), F.trim(parts[1]).alias("question"))
    return rows.where((F.col("question_id") != "") & (F.col("question") != ""))


def expected(spark: SparkSession, path: str) -> DataFrame:
    """question_id, expected: cut at the first tab; the last line of an id wins, empty answers stay."""
    parts = F.split("value", "\t", 2)
    rows = lines(spark, path).where(F.size(parts) >= 2).select("file", "line_no", F.trim(parts[0]).alias("question_id"), F.trim(parts[1]).alias("expected"))
    return rows.where(F.col("question_id") != "").groupBy("question_id").agg(F.max_by("expected", F.struct("file", "line_no")).alias("expected"))


def endpoint(spark: SparkSession, path: str) -> str:
    """First line that is neither empty nor a # or // comment."""
    found = lines(spark, path).select("line_no", F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").rlike("^(#|//)")).orderBy("line_no").first()
    if not found:
        raise ValueError(f"{path} names no endpoint")
    return found["v"]


def record(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("file"))


def traces(spark: SparkSession, path: str) -> DataFrame:
    return record(spark, path, TRACE)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Run records below root/<dataset>/runs/<run>/run.meta.json, with dataset and run folder; sorted by folder."""
    got = spark.read.schema(RUN).option("recursiveFileLookup", "true").option("pathGlobFilter", "run.meta.json").json(root, multiLine=True)
    path = F.col("_metadata.file_path")
    return got.select("*", F.regexp_extract(path, r"/([^/]+)/runs/[^/]+/run\.meta\.json$", 1).alias("dataset"), F.regexp_extract(path, r"/runs/([^/]+)/run\.meta\.json$", 1).alias("run_dir")).orderBy("dataset", "run_dir")


def json_lines(spark: SparkSession, path: str, schema: str = METRIC_ROW) -> DataFrame:
    """A record a line; a bad line fails the read. A metric may be a text or an object with a name."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows below evaluations/<eval>/metrics/*.jsonl: value only if a JSON number, status UNKNOWN if missing,
    rows without a question id dropped."""
    got = spark.read.schema(METRIC_ROW).option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)
    file = F.col("_metadata.file_path")
    named = F.coalesce(F.get_json_object("metric", "$.name"), F.col("metric"), F.regexp_extract(file, r"([^/]+)\.jsonl$", 1))
    # The JSON type counts: a text that looks like a number is none.
    value = F.when(F.schema_of_variant("value").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("value", "$", "double"))
    return got.where(F.col("questionId").isNotNull()).select(F.regexp_extract(file, r"/evaluations/([^/]+)/", 1).alias("evalId"), F.regexp_extract(file, r"/runs/([^/]+)/", 1).alias("runDir"), "questionId", named.alias("metric"), value.alias("value"), F.coalesce("status", F.lit("UNKNOWN")).alias("status"))


def keyword_table(spark: SparkSession, rows: list, set_name: str = "default") -> DataFrame:
    """question_id, keywords of a positional table: row n belongs to q(n+1); texts trimmed, empty ones dropped."""
    clean = [(n, [str(k).strip() for k in r if str(k).strip()] if isinstance(r, (list, tuple)) else []) for n, r in enumerate(rows)]
    return spark.createDataFrame([(set_name, n, k) for n, k in clean], "question_set string, position int, keywords array<string>")


def keyword_module(text: str) -> list:
    """Rows of a script that exports a nested array of texts: default, else KEYWORDS, KEYWORDS_BPMN, KEYWORDS_SYSML."""
    arrays = {}
    for m in re.finditer(r"export\s+(?:default\s+|const\s+(\w+)[^=]*=\s*)(\[)", text):
        depth, at = 0, m.start(2)
        for k in range(at, len(text)):
            depth += {"[": 1, "]": -1}.get(text[k], 0)
            if not depth:
                break
        body = re.sub(r"//[^\n]*|/\*.*?\*/", "", text[at : k + 1], flags=re.S)
        quoted = r'"(?:[^"\\]|\\.)*"|\'((?:[^\'\\]|\\.)*)\'|`((?:[^`\\]|\\.)*)`'
        body = re.sub(quoted, lambda q: q[0] if q[0][0] == '"' else json.dumps(re.sub(r"\\(.)", r"\1", q[1] or q[2] or "")), body)
        arrays[m[1] or "default"] = json.loads(re.sub(r",\s*([\]}])", r"\1", body))
    return next((arrays[n] for n in ("default", "KEYWORDS", "KEYWORDS_BPMN", "KEYWORDS_SYSML") if n in arrays), [])


def expected_uris(spark: SparkSession, path: str) -> DataFrame:
    """question_id, uris: texts trimmed, empty ones dropped, the last entry of a question wins."""
    got = spark.read.schema("questions array<struct<questionId: string, model_element_uris: array<string>>>").json(path, multiLine=True)
    rows = got.select(F.posexplode("questions").alias("n", "q")).select("n", "q.questionId", F.filter(F.transform("q.model_element_uris", lambda u: F.trim(u)), lambda u: u != "").alias("uris"))
    return rows.groupBy(F.col("questionId").alias("question_id")).agg(F.max_by("uris", "n").alias("uris"))


def dictionary(spark: SparkSession, path: str, key: str, last_wins: bool = True) -> DataFrame:
    """CSV with a header, all text; rows with an empty key are skipped and the last one of a key wins."""
    got = spark.read.csv(path, header=True, multiLine=True, escape='"').where(F.trim(F.col(f"`{key}`")) != "")
    if not last_wins:
        return got
    other = [c for c in got.columns if c != key]
    numbered = got.withColumn("__n", F.monotonically_increasing_id())
    return numbered.groupBy(key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in other)), "__n").alias("__v")).select(F.col(f"`{key}`"), *(F.col(f"__v.`{c}`") for c in other))


def id_mapping(spark: SparkSession, path: str, key: str, value: str, ending: str = ".bpmn") -> DataFrame:
    """key (lower case), value (without a file ending, in any case) of a CSV; both columns must be there, rows with an empty
    key or value are skipped, and a key may have one value only."""
    got = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = {c.lstrip("\ufeff").strip(): c for c in got.columns}
    if missing := {key, value} - names.keys():
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    cleaned = F.regexp_replace(F.trim(F.col(f"`{names[value]}`")), f"(?i){re.escape(ending)}$", "")
    rows = got.where(F.trim(F.col(f"`{names[value]}`")) != "").select(F.lower(F.trim(F.col(f"`{names[key]}`"))).alias("key"), cleaned.alias("value")).where("key != ''").distinct()
    if clash := rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").first():
        raise ValueError(f"{clash['key']} has more than one value")
    return rows


def categories(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """dataset_kind, category_key, name, display_name, question_id of a category file."""
    got = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CATEGORY)).alias("c"))
    return got.select(F.lit(kind).alias("dataset_kind"), F.concat(F.lit(f"{kind}::"), F.col("c.name")).alias("category_key"), F.col("c.name").alias("name"), F.coalesce("c.displayName", "c.name").alias("display_name"), F.explode("c.questions").alias("question_id"))


def evaluation_config(spark: SparkSession, path: str) -> DataFrame:
    """questions_file and its evaluation settings."""
    got = spark.read.schema("questionSets map<string, struct<questionSetId: string, expectedAnswersFile: string, expectedKeywordsFile: string, datasetKind: string>>").json(path, multiLine=True)
    return got.select(F.explode("questionSets").alias("questions_file", "v")).select(F.trim(F.replace("questions_file", F.lit("\\"), F.lit("/"))).alias("questions_file"), "v.*")


def metrics_csv(spark: SparkSession, path: str, needed: tuple[str, ...] = ("runId", "llmModel", "datasetKind", "evalId", "questionSet", "questionId", "metric", "value", "status")) -> DataFrame:
    got = spark.read.csv(path, header=True)
    if missing := set(needed) - set(got.columns):
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    return got


def model_hashes(csv: DataFrame) -> DataFrame:
    """Distinct second columns that hold a 32-digit hexadecimal id, without the model file's ending."""
    name = F.regexp_replace(F.col(f"`{csv.columns[1]}`"), r"\.bpmn$", "")
    return csv.select(name.alias("id")).where(F.col("id").rlike("[0-9a-f]{32}")).distinct()


def without_column(df: DataFrame, place: int) -> DataFrame:
    return df.drop(df.columns[place])


def containing_any(df: DataFrame, c: Column, ids: DataFrame) -> DataFrame:
    """Rows whose text holds one of the 32-digit ids of ids(id): ids are cut out and semi-joined, not searched for each."""
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    found = numbered.select("__row", F.explode(F.regexp_extract_all(c, F.lit("([0-9a-f]{32})"), F.lit(1))).alias("id")).join(ids, "id", "left_semi").select("__row").distinct()
    return numbered.join(found, "__row", "left_semi").drop("__row")


# --- writers -------------------------------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header in column order, quotes where needed, nulls empty; an empty frame still has its header."""
    df.write.mode(mode).csv(path, header=True, escape='"', nullValue="", emptyValue="")


def header_union(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the columns of all, in the order in which they first come up; missing cells are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON document, indented by two spaces, written over what is there: a run's record, a manifest, a pointer to the
    latest evaluation. The path may be in any store that Spark writes to."""
    fs, place = _place(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray((json.dumps(record, indent=2, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()


def unique_folder(spark: SparkSession, path: str) -> str:
    """Make the folder, or, if it is there, the first of path__r01 to path__r99 that is not; raises if all are."""
    for name in (path, *(f"{path}__r{k:02d}" for k in range(1, 100))):
        fs, place = _place(spark, name)
        if not fs.exists(place):
            fs.mkdirs(place)
            return name
    raise ValueError(f"{path} and all its numbered folders are there")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One folder a metric."""
    df.write.mode("append").partitionBy("metric").json(path)


def write_ntriples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws(" ", "s", "p", escaped(F.col("o")), F.lit(".")).alias("value")).write.text(path)


def escaped(term: Column) -> Column:
    """A term with its value's quotes, backslashes and line ends escaped."""
    value, rest = F.regexp_extract(term, r'(?s)^"(.*)"[^"]*$', 1), F.regexp_extract(term, r'(?s)^".*"([^"]*)$', 1)
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(raw), F.lit(out))
    return F.when(term.startswith('"'), F.concat(F.lit('"'), value, F.lit('"'), rest)).otherwise(term)


def class_lists(pairs: DataFrame, path: str) -> None:
    """A text line for each class(class, predicate): its predicates in order."""
    pairs.groupBy("class").agg(F.array_join(F.array_sort(F.collect_set("predicate")), ", ").alias("p")).select(F.concat_ws(": ", "class", "p").alias("value")).write.text(path)


def flattened_bindings(results: DataFrame) -> DataFrame:
    """Rows of SPARQL JSON results(head, results): a column each variable, missing bindings empty."""
    names = results.select("head.vars").first()[0]
    rows = results.select(F.explode("results.bindings").alias("b"))
    return rows.select(*(F.coalesce(F.col("b")[n]["value"], F.lit("")).alias(n) for n in names))

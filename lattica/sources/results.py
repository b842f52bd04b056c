"""Query results as records: run here or fetched from an endpoint, errors as records too."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.error import HTTPError, URLError
from urllib.parse import quote
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.planner import sparql
from ..plans.syntax import SparqlError

#: Rows of a result that a record shows, and characters of an error message.
ROWS, MESSAGE = 20, 600
RECORD = "status string, type string, rowCount long, vars array<string>, rows array<map<string,string>>, rowsTruncated boolean, boolean boolean, error string, httpStatus int, message string"
_names = ("status", "type", "rowCount", "vars", "rows", "rowsTruncated", "boolean", "error", "httpStatus", "message")


def record(**known) -> dict:
    return {n: known.get(n) for n in _names}


def shown(names: list[str], rows: list[dict], total: int, most: int) -> dict:
    if not total:
        return record(status="empty", error="empty", rowCount=0, vars=names)
    return record(status="ok", type="select", rowCount=total, vars=names, rows=rows[:most], rowsTruncated=total > most)


def run(spark: SparkSession, graph: Graph, query: str, prefixes: dict[str, str] | None = None, most: int = ROWS) -> dict:
    """The record of a query over a graph: its rows are counted, `most` are fetched, and what fails is told."""
    try:
        df = sparql(graph, query, spark, prefixes)
        if df.columns == ["boolean"]:
            return record(status="ok", type="ask", boolean=df.first()[0])
        rows = [{k: str(v) for k, v in r.asDict().items() if v is not None} for r in df.limit(most).collect()]
        return shown(df.columns, rows, df.count(), most)
    except (SparqlError, PySparkException) as e:
        return record(status="error", error="query_error", message=str(e)[:MESSAGE])


def records(spark: SparkSession, graph: Graph, queries: dict[str, str], prefixes: dict[str, str] | None = None, most: int = ROWS) -> DataFrame:
    """name, and the columns of RECORD, of queries by name: as `run`, but as one frame; results stay with the workers.

    A query that cannot be planned is an error record. Each query is a plan of its own, so these are lists of queries.
    """
    kinds = dict(x.split(" ", 1) for x in RECORD.split(", "))
    out = []
    for name, text in queries.items():
        held: dict[str, Column] = {}
        try:
            df = sparql(graph, text, spark, prefixes)
            if df.columns == ["boolean"]:
                own = df
                held = {"status": F.lit("ok"), "type": F.lit("ask"), "boolean": F.col("boolean")}
            else:
                cells = F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*(F.col(f"`{c}`").cast("string") for c in df.columns)))
                own = df.limit(most).agg(F.collect_list(F.map_filter(cells, lambda _, v: v.isNotNull())).alias("shown")).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))
                some = F.col("total") > 0
                held = {"status": F.when(some, "ok").otherwise("empty"), "type": F.when(some, "select"), "rowCount": F.col("total"), "vars": F.array(*map(F.lit, df.columns)), "rows": F.when(some, F.col("shown")), "rowsTruncated": F.when(some, F.col("total") > most), "error": F.when(~some, "empty")}
        except (SparqlError, PySparkException) as e:
            own = spark.range(1)
            held = {"status": F.lit("error"), "error": F.lit("query_error"), "message": F.lit(str(e)[:MESSAGE])}
        out.append(own.select(F.lit(name).alias("name"), *(held.get(n, F.lit(None)).cast(kinds.get(n, "string").strip()).alias(n) for n in _names)))
    return reduce(DataFrame.union, out)


def parsed(text: str, most: int = ROWS) -> dict:
    """The record of a result in SPARQL's JSON format."""
    try:
        data = json.loads(text)
    except ValueError as e:
        return record(status="error", error="parse_error", message=str(e)[:MESSAGE])
    data = data if isinstance(data, dict) else {}
    if isinstance(data.get("boolean"), bool):
        return record(status="ok", type="ask", boolean=data["boolean"])
    head, results = data.get("head") or {}, data.get("results") or {}
    names, bindings = head.get("vars"), results.get("bindings")
    rows = [{k: str(v.get("value") if isinstance(v, dict) else v) for k, v in b.items()} for b in (bindings if isinstance(bindings, list) else [])]
    return shown(names if isinstance(names, list) else [], rows, len(rows), most)


def fetched(endpoint: str, query: str, most: int = ROWS, timeout: float = 60, opened: Callable = urlopen) -> dict:
    """The record of a query sent to an endpoint by GET; network, HTTP and parse errors are records."""
    request = Request(f"{endpoint}?query={quote(query, safe='')}", headers={"Accept": "application/sparql-results+json"})
    try:
        with opened(request, timeout=timeout) as answer:
            text = answer.read().decode("utf-8", "replace")
    except HTTPError as e:
        return record(status="error", error="endpoint_error", httpStatus=e.code, message=e.read().decode("utf-8", "replace")[:MESSAGE])
    except (URLError, OSError) as e:
        return record(status="error", error="network_error", message=str(e)[:MESSAGE])
    return parsed(text, most)


def endpoint_records(queries: DataFrame, endpoint: str, most: int = ROWS, timeout: float = 60) -> DataFrame:
    """queries(query) with the record of each, fetched by the workers; repeated queries are sent once each row."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"query": q} | (fetched(endpoint, q, most, timeout) if q is not None else record(status="error", error="missing_query")) for q in batch["query"]]
            out = pd.DataFrame(rows, columns=["query", *_names])
            yield out.astype({"rowCount": "Int64", "httpStatus": "Int32", "boolean": "boolean", "rowsTruncated": "boolean"})

    return queries.select("query").mapInPandas(ask, f"query string, {RECORD}")


def tool_summary(output: Column) -> Column:
    """type (select, ask or error), rowsFullCount, boolean, empty, errorType and httpStatus of a recorded tool output."""
    get = lambda path: F.get_json_object(output, path)
    nothing = lambda kind: F.lit(None).cast(kind)
    one = lambda type_, rows=None, boolean=None, empty=None, error=None, http=None: F.struct(F.lit(type_).alias("type"), (nothing("long") if rows is None else rows).alias("rowsFullCount"), (nothing("boolean") if boolean is None else boolean).alias("boolean"), (nothing("boolean") if empty is None else empty).alias("empty"), (nothing("string") if error is None else error).alias("errorType"), (nothing("int") if http is None else http).alias("httpStatus"))
    ok, rows = get("$.status") == "ok", F.coalesce(get("$.rowCount").try_cast("double").cast("long"), F.lit(0).cast("long"))
    truth = ~F.coalesce(get("$.boolean"), F.lit("false")).isin("false", "0", "")
    failed = one("error", error=F.coalesce(get("$.error"), F.lit("unknown")), http=get("$.httpStatus").try_cast("int"))
    seen = F.when(ok & (get("$.type") == "select"), one("select", rows=rows)).when(ok & (get("$.type") == "ask"), one("ask", boolean=truth))
    seen = seen.when(get("$.status") == "empty", one("select", rows=F.lit(0).cast("long"), empty=F.lit(True))).otherwise(failed)
    return F.when(F.try_parse_json(output).isNull(), one("error", error=F.lit("tool_output_parse_error"))).otherwise(seen)


def tool_calls(message: Column) -> Column:
    """id, name and args (JSON) of the tool calls of a recorded message, in either of the usual shapes; arguments that are
    no JSON come under __raw, calls without a name are left out."""
    listed = F.coalesce(F.get_json_object(message, "$.tool_calls"), F.get_json_object(message, "$.additional_kwargs.tool_calls"))
    calls = F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))
    get = lambda c, *paths: F.coalesce(*(F.get_json_object(c, p) for p in paths))

    def one(c: Column, k: Column) -> Column:
        args = F.coalesce(get(c, "$.args", "$.function.arguments"), F.lit("{}"))
        args = F.when(F.try_parse_json(args).isNull(), F.to_json(F.struct(args.alias("__raw")))).otherwise(args)
        return F.struct(F.coalesce(get(c, "$.id", "$.tool_call_id"), F.concat(F.lit("tool_"), k.cast("string"))).alias("id"), F.coalesce(get(c, "$.name", "$.function.name"), F.lit("")).alias("name"), args.alias("args"))

    return F.filter(F.transform(calls, one), lambda c: c["name"] != "")

"""Readers, writers, records and metrics that the catalog's queries do not reach, on small files."""

import json
import random

import pytest

from lattica.functions import metrics as M
from lattica.operators import closure, evaluate, reports
from lattica.plans.graph import Graph
from lattica.plans.planner import sparql
from lattica.sources import files, results
from lattica.streaming import traces as streaming
from pyspark.sql import functions as F


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_metric_rows_keep_the_json_type(spark, tmp_path):
    lines = ['{"questionId": "q1", "metric": "a", "value": 0.5, "status": "OK"}', '{"questionId": "q2", "metric": {"name": "b"}, "value": "0.5"}', '{"questionId": "q3", "value": 2}', '{"value": 1}', '{"questionId": "q4", "value": null, "status": "ERROR"}', '{"questionId": "q5", "value": true}']
    put(tmp_path / "runs/r1/evaluations/e1/metrics/c.jsonl", "\n".join(lines))
    got = {r["questionId"]: (r["evalId"], r["runDir"], r["metric"], r["value"], r["status"]) for r in files.metric_rows(spark, str(tmp_path)).collect()}
    assert got == {"q1": ("e1", "r1", "a", 0.5, "OK"), "q2": ("e1", "r1", "b", None, "UNKNOWN"), "q3": ("e1", "r1", "c", 2.0, "UNKNOWN"), "q4": ("e1", "r1", "c", None, "ERROR"), "q5": ("e1", "r1", "c", None, "UNKNOWN")}


def test_id_mapping(spark, tmp_path):
    path = put(tmp_path / "m.csv", "﻿model,original_file\nSid-A, Foo.BPMN\nsid-a,Foo\nsid-b,\nsid-b,Bar.bpmn\n,x\n")
    assert {r["key"]: r["value"] for r in files.id_mapping(spark, path, "model", "original_file").collect()} == {"sid-a": "Foo", "sid-b": "Bar"}
    with pytest.raises(ValueError, match="lacks"):
        files.id_mapping(spark, path, "model", "other")


def test_records_and_folders(spark, tmp_path):
    path = f"{tmp_path}/run/LATEST.json"
    for n in (1, 2):
        files.write_record(spark, {"latestEvalId": f"é{n}"}, path)
    assert json.load(open(path, encoding="utf-8")) == {"latestEvalId": "é2"} and open(path, encoding="utf-8").read() == '{\n  "latestEvalId": "é2"\n}\n'
    made = [files.unique_folder(spark, f"{tmp_path}/out") for _ in range(3)]
    assert [m.rsplit("/", 1)[1] for m in made] == ["out", "out__r01", "out__r02"]


def test_readers(spark, tmp_path):
    put(tmp_path / "d/runs/r1/run.meta.json", '{"runId": "x", "llm": {"model": "m"}, "inputs": {"questionsFile": "q.txt"}}')
    put(tmp_path / "d/runs/r2/run.meta.json", '{"runId": "y", "llm": {"model": "n"}}')
    runs = files.runs(spark, str(tmp_path))
    assert [tuple(r) for r in runs.select("dataset", "run_dir", "runId").collect()] == [("d", "r1", "x"), ("d", "r2", "y")]
    assert [r["runId"] for r in evaluate.run_filter(runs, "m", "q.txt").collect()] == ["x"] and evaluate.run_filter(runs, "n", "q.txt").count() == 0
    trace = put(tmp_path / "t.json", '{"meta": {"questionId": "q1"}, "conversation": {"events": [{"seq": 1, "request": {"query": "A"}}, {"seq": 3, "request": {"query": "B"}}, {"seq": 4}, {"request": {"query": "C"}}]}}')
    events = evaluate.events(files.traces(spark, trace)).select("question_id", "seq", F.col("request.query").alias("query"))
    assert [tuple(r) for r in evaluate.last_queries(events, ["question_id"]).collect()] == [("q1", "B", 3)]
    uris = put(tmp_path / "u.json", '{"questions": [{"questionId": "q1", "model_element_uris": ["a"]}, {"questionId": "q1", "model_element_uris": [" b2 ", "", "c1"]}]}')
    assert [tuple(r) for r in files.expected_uris(spark, uris).collect()] == [("q1", ["b2", "c1"])]
    config = put(tmp_path / "c.json", '{"questionSets": {"a\\\\b.txt ": {"questionSetId": "s", "datasetKind": "k"}}}')
    assert [(r["questions_file"], r["questionSetId"]) for r in files.evaluation_config(spark, config).collect()] == [("a/b.txt", "s")]
    csv = put(tmp_path / "v.csv", 'k,v\n1,"a ""x"", b"\n2,c\n1,d\n ,e\n')
    assert {r["k"]: r["v"] for r in files.dictionary(spark, csv, "k").collect()} == {"1": "d", "2": "c"} and files.dictionary(spark, csv, "k", False).count() == 3
    with pytest.raises(ValueError, match="lacks"):
        files.metrics_csv(spark, csv)
    bindings = put(tmp_path / "r.json", '{"head": {"vars": ["x", "y"]}, "results": {"bindings": [{"x": {"value": "1"}}]}}')
    got = files.flattened_bindings(files.record(spark, bindings, "head struct<vars: array<string>>, results struct<bindings: array<map<string, struct<value: string>>>>"))
    assert [tuple(r) for r in got.collect()] == [("1", "")]


def test_writers(spark, tmp_path):
    df = files.header_union(spark.createDataFrame([("a,b", 1)], "x string, n int"), spark.createDataFrame([('say "hi"', None)], "y string, x string"))
    files.write_csv(df, f"{tmp_path}/csv")
    assert df.columns == ["x", "n", "y"] and sorted(map(tuple, spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').collect()), key=repr) == [("a,b", "1", None), (None, None, 'say "hi"')]
    with pytest.raises(Exception, match="EXISTS"):
        files.write_csv(df, f"{tmp_path}/csv")
    files.write_json_lines(spark.createDataFrame([("q1", "m", 0.5), ("q2", "n", None)], "questionId string, metric string, value double"), f"{tmp_path}/rows")
    assert (tmp_path / "rows/metric=m").is_dir() and spark.read.json(f"{tmp_path}/rows").count() == 2
    files.class_lists(spark.createDataFrame([("A", "q"), ("A", "p"), ("B", "r")], "class string, predicate string"), f"{tmp_path}/lists")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/lists").collect()) == ["A: p, q", "B: r"]


def test_endpoint_records(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread
    from urllib.parse import parse_qs, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlsplit(self.path).query)["query"][0]
            known = {"ask": '{"boolean": false}', "none": '{"head": {"vars": ["x"]}, "results": {"bindings": []}}', "html": "<p>", "rows": json.dumps({"head": {"vars": ["x"]}, "results": {"bindings": [{"x": {"type": "literal", "value": str(k)}} for k in range(25)]}})}
            self.send_response(200 if q in known else 500)
            self.end_headers()
            self.wfile.write(known.get(q, "broken").encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/ds"
        asked = spark.createDataFrame([(q,) for q in ("ask", "none", "html", "rows", "bad &?", None)], "query string")
        got = {r["query"]: r for r in results.endpoint_records(asked, url).collect()}
    finally:
        server.shutdown()
        server.server_close()
    assert (got["ask"]["type"], got["ask"]["boolean"]) == ("ask", False) and (got["none"]["status"], got["none"]["vars"]) == ("empty", ["x"])
    assert got["html"]["error"] == "parse_error" and (got["rows"]["rowCount"], len(got["rows"]["rows"]), got["rows"]["rowsTruncated"]) == (25, 20, True)
    assert (got["bad &?"]["error"], got["bad &?"]["httpStatus"], got["bad &?"]["message"]) == ("endpoint_error", 500, "broken") and got[None]["error"] == "missing_query"
    assert results.fetched(url, "ask", timeout=5)["error"] == "network_error"


def walked(reference, candidate):
    """Lengths from the front by their definition; then back, up the reference on a tie."""
    from functools import cache

    @cache
    def length(i, j):
        if not i or not j:
            return 0
        return length(i - 1, j - 1) + 1 if reference[i - 1] == candidate[j - 1] else max(length(i - 1, j), length(i, j - 1))

    def back(i, j):
        if not i or not j:
            return set()
        if reference[i - 1] == candidate[j - 1]:
            return back(i - 1, j - 1) | {i - 1}
        return back(i - 1, j) if length(i - 1, j) >= length(i, j - 1) else back(i, j - 1)

    return back(len(reference), len(candidate))


def test_subsequences_and_grams_by_definition():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in "xy")
        assert M.lcs_positions(a, b) == walked(tuple(a), tuple(b))
        many = [[rng.choice("abcd") for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        want = len(set().union(*(walked(tuple(a), tuple(c)) for c in many)))
        text = ". ".join(map(" ".join, many))
        p, r = want / sum(map(len, many)), want / max(len(a), 1)
        assert M.rouge_l_value(text, " ".join(a)) == pytest.approx(2 * p * r / (p + r) if p + r else 0.0)
    pairs = [("".join(rng.choices("ab é\n", k=rng.randrange(14))), "".join(rng.choices("ab é\n", k=rng.randrange(14)))) for _ in range(200)]

    def slow(got, expected):
        from collections import Counter

        a, b = "".join(got.split()), "".join(expected.split())
        if not a or not b:
            return 0.0
        hits = [sum((Counter(a[i : i + n] for i in range(len(a) - n + 1)) & Counter(b[i : i + n] for i in range(len(b) - n + 1))).values()) for n in range(1, 7)]
        p, r = (sum(h / max(len(t) - n, 1) for n, h in enumerate(hits)) / 6 for t in (a, b))
        return 2 * p * r / (p + r) if p + r else 0.0

    assert M.chrf_values([g for g, _ in pairs], [e for _, e in pairs]) == pytest.approx([slow(*p) for p in pairs])


def test_sentences():
    text = "State-of-the-art it's. 3.5 x！ y？ z。\nnext line\r\n... !"
    assert M.sentences(text) == [["State-of-the-art", "it's"], ["3"], ["5", "x"], ["y"], ["z"], ["next", "line"]]


def test_closures(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)} | {(k, k + 1) for k in range(100, 140)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    e = spark.createDataFrame(sorted(edges), "s long, o long")
    assert {tuple(r) for r in closure.closure(e).collect()} == want
    starts = spark.createDataFrame([(0,), (100,), (7,)], "s long")
    assert {tuple(r) for r in closure.reachable(e, starts).collect()} == {p for p in want if p[0] in (0, 100, 7)}


def test_paths_from_a_constant(spark):
    t = spark.createDataFrame([(f"<u:{a}>", "<u:p>", f"<u:{b}>") for a, b in (("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"))], "s string, p string, o string")
    ask = lambda q: sorted(r[0] for r in sparql(Graph(triples=t), q, spark, {"": "u:"}).collect())
    assert ask("SELECT ?x { :a :p+ ?x }") == ["u:b", "u:c"] and ask("SELECT ?x { ?x :p+ :b }") == ["u:a", "u:b", "u:c", "u:d"]
    assert ask("SELECT ?x { :a :p* ?x }") == ["u:a", "u:b", "u:c"] and ask("SELECT ?x { ?x :p* :a }") == ["u:a", "u:d"]


def test_modes(spark):
    pairs = spark.createDataFrame([("a", "b")], "original string, mutant string")
    assert reports.listed_values(["a", " b,c,"]) == ["a", "b", "c"] and reports.listed_values([" ,"]) is None and reports.listed_values(None) is None
    with pytest.raises(ValueError):
        reports.selected_sets(pairs, "other")
    with pytest.raises(ValueError, match="no settings"):
        evaluate.rule_of(spark.createDataFrame([("x",)], "questions_file string"), spark.createDataFrame([("y",)], "questions_file string"))


def test_streamed_counters(spark, tmp_path):
    for k, status in enumerate(("OK", "ok", "timeout", "ERROR", None)):
        put(tmp_path / f"in/{k}.json", json.dumps({"meta": {"questionId": f"q{k}", "status": status, "tokenUsage": {"totalTokens": k}}}))
    counted = streaming.windowed_counters(streaming.answer_stream(spark, f"{tmp_path}/in"), "1000 days", "1 day")
    q = counted.writeStream.format("memory").queryName("counters").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("counters").groupBy().sum("ok", "error", "timeout", "tokens").collect()] == [(2, 2, 1, 10)]


def test_records_are_those_of_single_runs(spark):
    from lattica.plans.graph import Graph

    g = Graph(triples=spark.createDataFrame([(f"<a{k}>", "<p>", f'"{k}"') for k in range(30)], "s string, p string, o string"))
    queries = {"many": "SELECT ?x ?n { ?x <p> ?n } ORDER BY ?x", "one": 'SELECT ?x ?n { ?x <p> "3" . OPTIONAL { ?x <q> ?n } }', "none": "SELECT ?x { ?x <q> ?y }", "yes": "ASK { ?x <p> ?y }", "bad": "SELECT", "pattern": 'SELECT ?x { ?x <p> ?n . FILTER(REGEX(?n, "[")) }'}
    for r in results.records(spark, g, queries).collect():
        want = results.run(spark, g, queries[r["name"]])
        assert {k: v for k, v in r.asDict().items() if k != "name"} == want, r["name"]

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lattica.functions import metrics as M
from lattica.functions import text as X
from lattica.operators import closure, evaluate, ids, kg, mapping, reports, schema
from lattica.plans.graph import Graph
from lattica.plans.planner import sparql
from lattica.plans.recovery import canonical_header, driving, recovered, split
from lattica.plans.syntax import SparqlError, parse
from lattica.sources import files
from pyspark.sql import functions as F

P = {"": "urn:t:"}


def graph(spark, rows, **options):
    term = lambda x: f"<urn:t:{x[1:]}>" if x.startswith(":") else x
    return Graph(triples=spark.createDataFrame([tuple(map(term, r)) for r in rows], "s string, p string, o string"), **options)


ROWS = [(":a", ":p", ":b"), (":b", ":p", ":c"), (":c", ":p", ":a"), (":x", ":p", ":x"), (":a", ":name", '"Org1"'), (":b", ":name", '"Org1"@en'), (":c", ":name", '""'), (":a", ":n", '"5"^^<http://www.w3.org/2001/XMLSchema#integer>'), (":b", ":n", '"10"^^<http://www.w3.org/2001/XMLSchema#integer>')]


def ask(spark, text, rows=ROWS, **options):
    return sorted((tuple(r) for r in sparql(graph(spark, rows, **options), text, spark, P).collect()), key=repr)


def test_terms_by_value_language_and_number(spark):
    assert ask(spark, 'SELECT ?x { ?x :name "Org1" }') == [("urn:t:a",)]
    assert ask(spark, 'SELECT ?x { ?x :name "Org1"@en }') == [("urn:t:b",)]
    assert ask(spark, 'SELECT ?x { ?x :name ?n FILTER(STR(?n) = "Org1") }') == [("urn:t:a",), ("urn:t:b",)]
    assert ask(spark, "SELECT ?x { ?x :n ?n FILTER(?n > 7) }") == [("urn:t:b",)]
    assert ask(spark, "SELECT (SUM(?n) AS ?s) (MAX(?n) AS ?m) { ?x :n ?n }") == [(15.0, "10")]


def test_closures_end_on_cycles_and_are_sets(spark):
    assert len(ask(spark, "SELECT ?x ?y { ?x :p+ ?y }")) == 10
    assert ask(spark, "SELECT ?x { ?x :p+ ?x }") == [(f"urn:t:{c}",) for c in "abcx"]
    assert ask(spark, "SELECT ?y { :a :p? ?y }") == [("urn:t:a",), ("urn:t:b",)]
    assert ask(spark, "SELECT ?y { :a ^:p/:name ?y }") == [("",)]


def test_optional_then_join_is_compatible(spark):
    rows = [(":a", ":t", ":T"), (":b", ":t", ":T"), (":a", ":v", ":1"), (":c", ":w", ":1"), (":d", ":w", ":2")]
    got = ask(spark, "SELECT ?x ?v ?y { ?x :t :T OPTIONAL { ?x :v ?v } ?y :w ?v }", rows)
    assert got == [("urn:t:a", "urn:t:1", "urn:t:c"), ("urn:t:b", "urn:t:1", "urn:t:c"), ("urn:t:b", "urn:t:2", "urn:t:d")]


def test_star_is_one_scan_with_equal_rows(spark):
    text = "SELECT ?x ?m { ?x :n ?n ; :name ?m }"
    assert ask(spark, text, single_valued={"<urn:t:n>", "<urn:t:name>"}) == ask(spark, text)


def test_empty_aggregates_ask_and_errors(spark):
    assert ask(spark, "SELECT (COUNT(?x) AS ?n) (AVG(?x) AS ?a) { ?x :none ?y }") == [(0, 0.0)]
    assert ask(spark, "ASK { :a :p :b }") == [(True,)] and ask(spark, "ASK { :a :p :z }") == [(False,)]
    with pytest.raises(SparqlError):
        parse("SELECT ?x WHERE { ?x unknown:p ?y }")
    with pytest.raises(SparqlError):
        parse("SELECT ?x WHERE { ?x ")


@pytest.mark.parametrize("text", [
    "SELECT DISTINCT ?org ?orgName WHERE { ?model a :Model . ?model :name ?modelName . FILTER(CONTAINS(LCASE(?modelName), \"\")) ?model :belongsTo ?org . ?org :label ?orgName . } LIMIT 25",
    "SELECT ?org (COUNT(?model) AS ?n) WHERE { ?org a :Org . ?model a :Model . ?model :belongsTo ?org . OPTIONAL { ?org :label ?l . } } GROUP BY ?org HAVING (?n >= 5 && ?n <= 10) LIMIT 25",
    "SELECT (COUNT(DISTINCT ?e) AS ?n) WHERE { ?m a :Model . { ?m :originalId \"\" } UNION { ?m :normalizedId \"\" } ?d :belongsTo ?m . ?e a :EndEvent . ?e :belongsTo ?d . }",
    "SELECT (COUNT(DISTINCT ?m) AS ?n) ?name WHERE { ?o a :Org . OPTIONAL { ?o :label ?name . } ?m :belongsTo ?o . } GROUP BY ?name",
])
def test_recorded_shapes_plan(spark, text):
    sparql(graph(spark, ROWS), text, spark, P).collect()


def test_recovery():
    assert recovered("SELECT (COUNT(?y) AS ?n) WHERE { ?x <p> ?y . }") == "SELECT ?x WHERE { ?x <p> ?y . }"
    assert "ORDER BY DESC(?x)" in recovered("SELECT (COUNT(?y) AS ?n) WHERE { ?x <p> ?y . } ORDER BY DESC(?n) LIMIT 3")
    assert "HAVING (?n > 1)" in recovered("SELECT ?x (COUNT(?y) AS ?n) WHERE { ?x <p> ?y . ?z <q> ?x . } GROUP BY ?x HAVING (?n > 1)")
    assert driving("SELECT ?a (COUNT(DISTINCT ?b) AS ?c)") == ([("b", "c")], ["a"])
    for bad in ("ASK { ?x <p> ?y }", "SELECT ?x { ?x <p> ?y . }"):
        with pytest.raises(SparqlError, match="rewrite_error"):
            split(bad)
    assert canonical_header("PREFIX a: <b>\nSELECT", "PREFIX x: <y>") == "PREFIX x: <y>\nSELECT"


XML = """<bpmn:definitions xmlns:bpmn="urn:b" id="D" name="N"><bpmn:process id="P" name="Main"><bpmn:task id="T1" name="Do"/><bpmn:task id="T2"/>
<bpmn:sequenceFlow id="F" sourceRef="T1" targetRef="T2"><bpmn:conditionExpression type="x">a &gt; 1</bpmn:conditionExpression></bpmn:sequenceFlow></bpmn:process>
<bpmn:choreography id="C"><bpmn:exclusiveGateway id="G"><bpmn:incoming>I1</bpmn:incoming><bpmn:incoming>I2</bpmn:incoming></bpmn:exclusiveGateway></bpmn:choreography></bpmn:definitions>"""


def test_mapping(spark, tmp_path):
    (tmp_path / "m.bpmn").write_text(XML)
    (tmp_path / "bad.bpmn").write_text("<a>")
    rows = mapping.map_files(spark, str(tmp_path), base="urn:e:")
    got = {tuple(r) for r in rows.where("model = 'm'").select("s", "p", "o").collect()}
    b, o, e = (mapping.NAMESPACES[k] for k in ("bbo", "org", "ext"))
    assert ("<urn:e:T1>", f"<{b}name>", '"Do"') in got and not any(s == "<urn:e:T2>" and p == f"<{b}name>" for s, p, _ in got)
    assert ("<urn:e:T2>", f"<{o}belongsToProcess>", "<urn:e:P>") in got
    assert ("<urn:e:F>", f"<{b}has_sourceRef>", "<urn:e:T1>") in got
    assert ("<urn:e:F>", f"<{b}condition>", "<urn:e:F/conditionExpression/1>") in got
    assert ("<urn:e:G/incoming/2>", f"<{e}incoming>", "<I2>") in got
    assert len(mapping.RULES) == 82
    assert rows.where("error IS NOT NULL").count() == 1


def test_aggregation(spark):
    rdf, rdfs = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://www.w3.org/2000/01/rdf-schema#subClassOf>"
    t = spark.createDataFrame([("<o:d1>", rdfs, "<o:v#Definitions>", "m1"), ("<o:t>", "<o:v/belongsToProcess>", "<o:d1>", "m1"), ("<o:q>", rdfs, "<o:v#X>", "m2"), ("<o:z>", rdf, "<o:v#X>", "m3")], "s string, p string, o string, model string")
    meta = spark.createDataFrame([("m1", "1"), ("m2", "2")], "model string, original_id string")
    orig = spark.createDataFrame([("1", "B", "One", "2020-01-01 10:00"), ("2", "", "Two", "x")], "original_id string, organization_id string, name string, datetime string")
    none = spark.createDataFrame([], "model string, error string")
    g, matched, skipped = kg.aggregate(t, none, meta, orig, [], [("o:", "n:")], "n:", "n:belongsTo", "n:ext#")
    triples = {tuple(r) for r in g.collect()}
    assert ("<n:t>", "<n:belongsTo>", "<n:d1>") in triples and ("<n:d1>", rdf, "<n:v#Definitions>") in triples
    assert ("<n:d1>", "<n:belongsTo>", "<n:Model/m1>") in triples and ("<n:q>", rdf, "<n:v#X>") in triples
    assert ("<n:Model/m1>", "<n:modelCreated>", '"2020-01-01T10:00"^^<http://www.w3.org/2001/XMLSchema#dateTime>') in triples
    assert [r["organization_label"] for r in matched.collect()] == ["Org1"]
    assert {(r["model"], r["reason"]) for r in skipped.collect()} == {("m2", "missing_or_ambiguous_definitions_node"), ("m3", "no_meta_match")}


def test_sources(spark, tmp_path):
    (tmp_path / "q.txt").write_text('﻿q1\tone\ttwo "x"\n\nq2\nq3\t \nq1\tlast\n', encoding="utf-8")
    assert [(r[0], r[1]) for r in files.questions(spark, str(tmp_path / "q.txt")).orderBy("line_no").select("question_id", "question").collect()] == [("q1", 'one\ttwo "x"'), ("q1", "last")]
    assert {r[0]: r[1] for r in files.expected(spark, str(tmp_path / "q.txt")).collect()} == {"q1": "last", "q3": ""}
    (tmp_path / "e.txt").write_text("# no\n\n// no\nhttp://x/y\n")
    assert files.endpoint(spark, str(tmp_path / "e.txt")) == "http://x/y"
    (tmp_path / "c.json").write_text(json.dumps([{"name": "a", "questions": ["q1", "q2"]}]))
    assert files.categories(spark, str(tmp_path / "c.json"), "k").count() == 2
    assert files.keyword_module("// k\nexport const KEYWORDS = [['a', \"b\"], [], ['it\\'s'],];") == [["a", "b"], [], ["it's"]]
    (tmp_path / "m.csv").write_text("key,value\nA,1\na,2\n")
    with pytest.raises(ValueError, match="more than one"):
        files.id_mapping(spark, str(tmp_path / "m.csv"), "key", "value")
    (tmp_path / "g.ttl").write_text('@prefix x: <urn:x:> .\nx:a a x:B ; x:n "1"@en , "q\\"t" .\n')
    g = files.parsed_turtle(spark, str(tmp_path / "g.ttl"))
    assert {r["o"] for r in g.collect()} == {"<urn:x:B>", '"1"@en', '"q"t"'}
    files.write_ntriples(g, str(tmp_path / "nt"))
    assert {r["o"] for r in files.parsed_turtle(spark, str(tmp_path / "nt/*.txt")).collect()} == {"<urn:x:B>", '"1"@en', '"q"t"'}


@given(st.text(max_size=30), st.text(max_size=30))
def test_metric_laws(a, b):
    assert 0 <= M.chrf_value(a, b) <= 1 and abs(M.chrf_value(a, b) - M.chrf_value(b, a)) < 1e-12
    assert 0 <= M.rouge_l_value(a, b) <= 1
    if M.sentences(a):
        assert M.rouge_l_value(a, a) == 1


def test_metric_cases(spark):
    assert M.chrf_value("abcdefg", "abc defg") == 1 and M.chrf_value("", "a") == 0
    assert abs(M.chrf_value("ab", "ab") - 1 / 3) < 1e-12
    assert abs(M.rouge_l_value("the cat sat", "the cat ran") - 2 / 3) < 1e-12
    row = spark.range(1).select(
        M.keyword_count_exact_match(F.lit("A B c"), F.array(F.lit("a b"), F.lit("x")))["value"].alias("k"), M.keyword_count_exact_match(F.lit("a"), F.array().cast("array<string>"))["status"].alias("s"),
        M.keyword_counter_agent(F.lit("x"), F.array(F.lit("a"), F.lit("b")), F.lit('so {"matchedCount": 9} ok'))["value"].alias("j"), M.llm_judge_score_avg(F.lit("x"), F.array(F.lit("4/5"), F.lit("?"), F.lit('{"score": 2.5}')))["value"].alias("r"),
        M.unit_cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert (row["k"], row["s"], row["j"], row["z"]) == (0.5, "SKIPPED", 1.0, 0.0) and abs(row["r"] - 8 / 3) < 1e-9


def test_evaluation(spark):
    answers = spark.createDataFrame([("q1", "x y"), ("q2", "z")], "question_id string, got string")
    want = spark.createDataFrame([("q1", "x y"), ("q2", "q")], "question_id string, expected string")
    rows = evaluate.metric_input(answers, want, files.keyword_table(spark, [["x"], "bad"]))
    got = {(r["question_id"], r["metric"]): (r["value"], r["status"]) for r in evaluate.evaluate(rows, ["keyword_count_exact_match", "rouge_l_f1"], ["question_id"]).collect()}
    assert got[("q1", "rouge_l_f1")] == (1.0, "OK") and got[("q2", "keyword_count_exact_match")] == (None, "SKIPPED")
    with pytest.raises(ValueError, match="q2"):
        evaluate.metric_input(answers, want.where("question_id = 'q1'"))


def test_reports(spark):
    f = spark.createDataFrame([("m", 1.0, 2.0), ("m", 1.0, 3.0), ("m", 2.0, 5.0), ("m", None, 1.0)], "k string, a double, b double")
    assert abs(reports.spearman(f, "a", "b").first()["rho"] - 0.8660254) < 1e-6
    assert reports.spearman(f.withColumn("a", F.lit(1.0)), "a", "b").first()["rho"] is None
    flat = reports.min_max(f.select("k", F.lit(3.0).alias("value")), ["k"])
    assert {r["normalized"] for r in flat.collect()} == {0.5}
    assert reports.resolve([" A  b", "a B"], ["a b"]) == ["a b"]
    with pytest.raises(ValueError, match="unknown"):
        reports.resolve(["z"], ["a"])
    c = spark.createDataFrame([("d", "q1", "c1"), ("d", "q1", "c2")], "dataset_kind string, question_id string, category_key string")
    with pytest.raises(ValueError, match="2 categories"):
        reports.categorised(spark.createDataFrame([("d", "q1")], "datasetKind string, questionId string"), c)


def test_reduction_schema_ids(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "s long, o long")
    assert {tuple(r) for r in closure.transitive_reduction(closure.closure(e)).collect()} == {(1, 2), (2, 3), (3, 4)}
    typed = spark.createDataFrame([("Big%20Block", "u#Element_name"), ("Big%20Block", "u#BigBlock_x")], "class string, predicate string")
    assert {r["class"]: r["superclasses"] for r in schema.superclass_sets(schema.superclass_pairs(typed)).collect()} == {"Big%20Block": ["Big%20Block", "Element"]}
    rows = spark.createDataFrame([("SID-a1 /sid-a1 sid-b",)], "t string")
    m = spark.createDataFrame([("sid-a1", "X")], "key string, value string")
    assert tuple(ids.replace_ids(rows, "t", m).first()) == ("X /sid-a1 sid-b", 1)
    odd = spark.createDataFrame([(1, "a\0sid-a1 SID-A1"), (2, None), (3, "none"), (4, "a\0sid-a1 SID-A1")], "k int, t string")
    assert {r["k"]: (r["t"], r["n_replaced"]) for r in ids.replace_ids(odd, "t", m).collect()} == {1: ("a\0X X", 2), 2: (None, 0), 3: ("none", 0), 4: ("a\0X X", 2)}
    nested = '{"sid-a1": ["sid-a1", {"query": {"x": "sid-a1"}, "y": "see SID-a1, sid-b"}], "query": "sid-a1"}'
    got = ids.replace_ids_nested(spark.createDataFrame([(nested,), ("no json sid-a1",)], "t string"), "t", m).orderBy(F.desc("n_replaced")).collect()
    assert json.loads(got[0]["t"]) == {"sid-a1": ["X", {"query": {"x": "sid-a1"}, "y": "see X, sid-b"}], "query": "sid-a1"} and got[0]["n_replaced"] == 2
    assert tuple(got[1]) == ("no json sid-a1", 0)


def test_texts(spark):
    r = spark.range(1).select(X.slug(F.lit("--A b!")), X.slug(F.lit("!")), X.uri_fragment(F.lit("a b~/*")), X.date_time(F.lit("2020-01-01 10:00 x")), X.stem(F.lit("a/b.c.ttl")), X.fix_flags(F.lit("<e isInterrupting id='1' isImmediate=\"x\"/>"))).first()
    assert tuple(r) == ("a_b", "plot", "a%20b~%2F%2A", "2020-01-01T10:00 x", "b.c", "<e isInterrupting=\"true\" id='1' isImmediate=\"x\"/>")

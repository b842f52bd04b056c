"""Plans: no nested loops, one scan of a table; compatible joins by definition."""

import os
import random

import pytest

from lattica import terms as T
from lattica.catalog import QUERIES
from lattica.plans.graph import Graph
from lattica.plans.planner import Planner, Rows, sparql
from lattica.plans.star import PREFIXES, star_graph
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_no_kg_query_has_a_nested_loop(spark):
    lazy = [n for n in QUERIES if n.startswith("kg_") and n not in ("kg_closure", "kg_cycle", "kg_path_star", "kg_path_plus")]
    assert len(lazy) > 25
    for name in lazy:
        plan = plan_of(QUERIES[name](spark, DATA))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_scans(spark):
    scans = lambda name: plan_of(QUERIES[name](spark, DATA)).count("FileScan parquet")
    assert scans("kg_star_join") == 1 and scans("kg_distinct_wildcard") == 8 and scans("kg_property_histogram") == 4
    plan = plan_of(QUERIES["kg_star_join"](spark, DATA))
    assert "EqualTo(o_orderstatus,F)" in plan
    # A star over two tables of one kind joins them; one over predicates of no common kind is empty.
    g = star_graph(spark, DATA)
    two = sparql(g, "SELECT ?d ?l ?q WHERE { ?d :lang ?l ; :quality ?q ; :toxic 0 }", spark, PREFIXES)
    assert plan_of(two).count("FileScan parquet") == 2 and two.count() > 0
    assert sparql(g, "SELECT ?x WHERE { ?x :lang ?l ; :brand ?b }", spark, PREFIXES).collect() == []
    assert sparql(g, "SELECT ?x ?n WHERE { ?x :none ?l ; :brand ?n }", spark, PREFIXES).collect() == []
    assert sparql(g, "SELECT ?x WHERE { ?x :nation <urn:x:nation/03> ; :segment ?b }", spark, PREFIXES).collect() == []


def test_molten_tables_are_their_relations(spark):
    g = star_graph(spark, DATA)
    whole = sorted(map(tuple, g.only(["<urn:x:name>", "<urn:x:nation>", "<urn:x:quality>"]).triples().collect()))
    apart = sorted((s, p, o) for p in ("<urn:x:name>", "<urn:x:nation>", "<urn:x:quality>") for s, o in g.relation(p).collect())
    assert whole == apart and len(whole) > 100


def rows_of(rng, names, n):
    return [tuple(rng.choice([None, "<1>", "<2>", "<3>"]) if c in "xyz" else f"<{c}{k}>" for c in names) for k in range(n)]


def compatible(a, b, names_a, names_b):
    shared = [c for c in names_a if c in names_b]
    return all(x is None or y is None or x == y for c in shared for x, y in [(a[names_a.index(c)], b[names_b.index(c)])])


@pytest.mark.parametrize(("names_a", "names_b", "sure"), [("ax", "xb", ""), ("axy", "yxb", ""), ("axy", "xyb", "x"), ("axyz", "xyzb", ""), ("xy", "yx", ""), ("ax", "xyb", "")])
def test_compatible_joins_by_definition(spark, names_a, names_b, sure):
    """Inner, left, semi, anti and MINUS of rows with unbound variables on either side, repeated rows too."""
    rng = random.Random(3)
    rows_a, rows_b = rows_of(rng, names_a, 14), rows_of(rng, names_b, 12)
    rows_a, rows_b = ([r for r in rows if all(r[n.index(c)] is not None for c in sure)] for rows, n in ((rows_a, names_a), (rows_b, names_b)))
    rows_a.append(rows_a[0])
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
    make = lambda rows, names: Rows(frame(rows, names), {c for c in names if c not in "xyz" or c in sure}, {c for c in names if c in "xyz" and c not in sure})
    planner = Planner(Graph(triples=frame([], "spo")), spark)
    a, b = make(rows_a, names_a), make(rows_b, names_b)
    names = sorted(set(names_a) | set(names_b))
    own = lambda df, cs: sorted((tuple(r[c] for c in cs) for r in df.collect()), key=repr)

    def merged(x, y):
        y = y or [None] * len(names_b)
        get = {c: v for c, v in zip(names_b, y, strict=True)}
        return tuple(get.get(c) if c not in names_a or x[names_a.index(c)] is None else x[names_a.index(c)] for c in names)

    pairs = [(x, y) for x in rows_a for y in rows_b if compatible(x, y, names_a, names_b)]
    inner = planner.join(a, b)
    assert own(inner.df, names) == sorted((merged(x, y) for x, y in pairs), key=repr)
    alone = [x for x in rows_a if not any(compatible(x, y, names_a, names_b) for y in rows_b)]
    assert own(planner.join(a, b, "left").df, names) == sorted([merged(x, y) for x, y in pairs] + [merged(x, None) for x in alone], key=repr)
    assert own(planner.semi(a, b, True, plain=True).df, names_a) == sorted(alone, key=repr)
    assert own(planner.semi(a, b, False, plain=True).df, names_a) == sorted((x for x in rows_a if x not in alone), key=repr)
    common = lambda x, y: any(c in names_b and x[names_a.index(c)] is not None and y[names_b.index(c)] is not None for c in names_a)
    kept = [x for x in rows_a if not any(compatible(x, y, names_a, names_b) and common(x, y) for y in rows_b)]
    assert own(planner.semi(a, b, True).df, names_a) == sorted(kept, key=repr)
    only = planner.join(a, b, "left", lambda left, right: F.col("a" if "a" in names_a else "y") != F.lit("<a0>"))
    test = lambda x: (x[names_a.index("a" if "a" in names_a else "y")] or None) not in (None, "<a0>")
    want = [merged(x, y) for x, y in pairs if test(x)] + [merged(x, None) for x in rows_a if x in alone or not test(x)]
    assert own(only.df, names) == sorted(want, key=repr)


def test_unbound_rows_are_not_one_tasks(spark):
    """A join whose only key may be unbound is dealt out: few values, and rows that meet all, are not in one task."""
    a = Rows(spark.range(300).selectExpr("concat('<a', id, '>') AS a", "CASE WHEN id % 3 > 0 THEN concat('<', id % 3, '>') END AS x"), {"a"}, {"x"})
    b = Rows(spark.range(40).selectExpr("concat('<b', id, '>') AS b", "concat('<', id % 2 + 1, '>') AS x"), {"b", "x"}, set())
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        planner = Planner(Graph({"<p>": spark.createDataFrame([], "s string, o string")}), spark)
        parts = [r["count"] for r in planner.join(a, b, "left").df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(parts) == 100 * 40 + 200 * 20 and len(parts) > 2 and max(parts) < 0.45 * sum(parts)


def test_tasks_of_unbound_rows_are_not_merged(spark):
    """The inputs are small, the pairs are not: adaptive execution must not make few tasks of them."""
    a = Rows(spark.range(300).selectExpr("concat('<a', id, '>') AS a", "CASE WHEN id % 3 > 0 THEN concat('<', id % 3, '>') END AS x"), {"a"}, {"x"})
    b = Rows(spark.range(40).selectExpr("concat('<b', id, '>') AS b", "concat('<', id % 2 + 1, '>') AS x"), {"b", "x"}, set())
    planner = Planner(Graph({"<p>": spark.createDataFrame([], "s string, o string")}), spark)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    for how in ("left", "inner"):
        parts = [r["count"] for r in planner.join(a, b, how).df.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 100 * 40 + 200 * 20 and len(parts) > 8 and max(parts) < 0.25 * sum(parts)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_texts_of_pairs_are_made_before_the_join(spark):
    plan = plan_of(QUERIES["kg_optional_compat"](spark, DATA))
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "__r_salt" in joins[0] and "substring_index" not in plan[: plan.index(joins[0])] and "substring_index" in plan


@pytest.mark.parametrize(
    "where",
    [
        "?a <u:p> ?y . OPTIONAL { ?a <u:q> ?x } OPTIONAL { ?b <u:r> ?x }",
        "?a <u:p> ?y . OPTIONAL { ?a <u:q> ?x } ?b <u:r> ?x",
        "?a <u:p> ?z . OPTIONAL { ?a <u:q> ?x } OPTIONAL { { ?b <u:p> ?w OPTIONAL { ?b <u:r> ?x } } UNION { ?b <u:q> ?x } }",
        "?a <u:p> ?y . OPTIONAL { ?a <u:q> ?x } OPTIONAL { ?b <u:r> ?x FILTER(?b != <u:b1>) }",
        "?a <u:p> ?y . OPTIONAL { ?a <u:q> ?x } OPTIONAL { ?b <u:r> ?x } BIND(DATATYPE(?x) AS ?t)",
    ],
)
def test_texts_are_those_of_the_terms(spark, where):
    """Whether texts are made before the last join or after it; "1", "1"@en and a number are different terms of one text."""
    terms = ['"1"', '"1"@en', f'"1"^^<{T.XSD}integer>', "<u:1>", "_:1"]
    frame = lambda rows: spark.createDataFrame(rows, "s string, o string")
    g = Graph({"<u:p>": frame([(f"<u:a{k}>", terms[k % 5]) for k in range(8)]), "<u:q>": frame([(f"<u:a{k}>", terms[k]) for k in range(5)]), "<u:r>": frame([(f"<u:b{k}>", terms[k % 3]) for k in range(4)])})
    for head in ("SELECT *", "SELECT DISTINCT ?x ?a"):
        q = f"{head} WHERE {{ {where} }}"
        raw = sparql(g, q, spark, raw=True)
        texts = raw.select(*(T.lexical(F.col(c)).alias(c) for c in raw.columns))
        got = sparql(g, q, spark)
        want = sorted(map(str, texts.collect()))
        assert got.columns == texts.columns and sorted(map(str, got.collect())) == want and len(want) > 1


@pytest.mark.parametrize("term", ['"a"', '""', '"a"b"@en', '"x\ny"^^<u:t>', '"x\n"', "<u:a>", "_:b", '"é"1"^^<u:"t>'])
def test_lexical_is_between_the_outer_quotes(spark, term):
    got = spark.range(1).select(T.lexical(F.lit(term)).alias("x")).first()["x"]
    assert got == (term[1:-1] if term[0] == "<" else term[1 : term.rindex('"')] if term[0] == '"' else term)


@pytest.mark.parametrize("function", ["STRENDS", "STRSTARTS"])
def test_texts_that_begin_or_end_with_others_are_keys(spark, function):
    """Few groups, many members: the pairs are not all made; repeated rows, empty texts and longer ones than any stay right."""
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(5)))
    own = [(f"<a{k}>", f"<n{k % 2}>", f'"{text()}"') for k in range(300)]
    other = [(f"<b{k % 90}>", f"<n{k % 2}>", f'"{text() + "c" * (k % 7 // 6 * 30)}"@en') for k in range(100)]
    frame = lambda rows, k: spark.createDataFrame([(r[0], r[k]) for r in rows], "s string, o string")
    g = Graph({"<u:n>": frame(own, 1), "<u:t>": frame(own, 2), "<u:m>": frame(other, 1).distinct(), "<u:r>": frame(other, 2)})
    df = sparql(g, f"SELECT ?a ?b WHERE {{ ?a <u:n> ?n ; <u:t> ?t . ?b <u:m> ?n ; <u:r> ?r FILTER({function}(?t, STR(?r)) && ?a != ?b) }}", spark)
    plain = lambda t: t[1 : t.rindex('"')]
    test = str.endswith if function == "STRENDS" else str.startswith
    kinds = {(b, n) for b, n, _ in other}
    want = sorted((a[1:-1], b[1:-1]) for a, n, t in own for b, _, r in other if (b, n) in kinds and test(plain(t), plain(r)))
    assert sorted(map(tuple, df.collect())) == want and len(want) > 100
    plan = plan_of(df)
    assert "__affix" in plan and "NestedLoop" not in plan and "Cartesian" not in plan

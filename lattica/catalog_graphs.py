"""Queries over graphs as files and as wholes, with the SQL that must give the same rows. The catalog adds them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as T
from .catalog import query, read
from .operators import mapping
from .plans.star import NS, PREFIXES
from .sources import serialise
from .sources.turtle import read_turtle
from .storage import shared_folder


def node(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"<{NS}{kind}/"), F.col(c).cast("string"), F.lit(">"))


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- files of graphs: written, and read again ----------------------------------------------------------------------

_QUADS = f"""
SELECT '<{NS}customer/' || c_custkey || '>' AS s, '<{NS}nation>' AS p, '<{NS}nation/' || c_nationkey || '>' AS o, '<{NS}segment/' || c_mktsegment || '>' AS g FROM customer
UNION ALL SELECT '<{NS}customer/' || c_custkey || '>', '<{NS}balance>', '"' || CAST(floor(c_acctbal) AS BIGINT) || '"^^<{T.XSD}integer>', '<{NS}segment/' || c_mktsegment || '>' FROM customer
UNION ALL SELECT '<{NS}customer/' || c_custkey || '>', '<{T.RDF}type>', '<{NS}Customer>', NULL FROM customer
UNION ALL SELECT '<{NS}supplier/' || s_suppkey || '>', '<{NS}name>', '"' || s_name || '"@en', NULL FROM supplier
"""


def named_graphs(spark: SparkSession, d: str) -> DataFrame:
    """s, p, o, g: customers in a graph a segment, their types and suppliers in the default graph."""
    c = read(spark, d, "customer")
    s, g = node("customer", "c_custkey").alias("s"), node("segment", "c_mktsegment").alias("g")
    p = lambda name: F.lit(f"<{NS}{name}>").alias("p")
    none = F.lit(None).cast("string").alias("g")
    rows = c.select(s, p("nation"), node("nation", "c_nationkey").alias("o"), g)
    rows = rows.union(c.select(s, p("balance"), T.literal(F.floor("c_acctbal").cast("string"), datatype=T.XSD + "integer"), g))
    rows = rows.union(c.select(s, F.lit(f"<{T.RDF}type>"), F.lit(f"<{NS}Customer>"), none))
    return rows.union(read(spark, d, "supplier").select(node("supplier", "s_suppkey"), p("name"), T.literal(F.col("s_name"), lang="en"), none))


def through_files(format: str):
    def again(spark: SparkSession, d: str) -> DataFrame:
        path = folder(spark, f"graph-{format}")
        serialise.write_graph(named_graphs(spark, d), path, format, PREFIXES)
        return serialise.read_graph(spark, path, format, scope="all").where("error IS NULL").select("s", "p", "o", "g")

    again.__name__ = f"graph_{format}"
    return again


for _format in ("trig", "trix", "jsonld", "nquads"):
    query(_QUADS)(through_files(_format))


@query(f"SELECT '<{NS}document/' || doc_id || '>' AS s, '<{NS}text>' AS p, '\"' || text || '\"' AS o FROM documents WHERE text IS NOT NULL UNION ALL SELECT '<{NS}document/' || doc_id || '>', '<{NS}source>', '<{NS}source/' || source || '>' FROM documents WHERE source IS NOT NULL")
def graph_turtle(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as literals, written as Turtle and read again from split files."""
    docs = read(spark, d, "documents")
    rows = docs.where("text IS NOT NULL").select(node("document", "doc_id").alias("s"), F.lit(f"<{NS}text>").alias("p"), T.literal(F.col("text")).alias("o"))
    rows = rows.union(docs.where("source IS NOT NULL").select(node("document", "doc_id"), F.lit(f"<{NS}source>"), node("source", "source")))
    path = folder(spark, "graph-turtle")
    serialise.write_graph(rows, path, "turtle", PREFIXES)
    return read_turtle(spark, path, scope="all").where("error IS NULL").select("s", "p", "o")


@query(f"SELECT '<{NS}document/' || doc_id || '>' AS s, '<{NS}text>' AS p, '\"' || replace(replace(text, '\\', '/'), '\"', '''') || '\"' AS o FROM documents WHERE text IS NOT NULL")
def graph_turtle_long(spark: SparkSession, d: str) -> DataFrame:
    """Texts as long strings over many lines, as other programs write them, with directives that change along a file."""
    docs = read(spark, d, "documents").where("text IS NOT NULL")
    k = F.col("doc_id").cast("string")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(f"@prefix d: <{NS}document/> .\nd:"), k)).otherwise(F.concat(F.lit(f"BASE <{NS}document/>\n<{NS}document/"), k, F.lit(">")))
    body = F.translate("text", '\\"', "/'")
    path = folder(spark, "graph-turtle-long")
    docs.select(F.concat(head, F.lit(f' # """\n  <{NS}text>\n"""'), body, F.lit('"""\n.'))).write.text(path)
    return read_turtle(spark, path).where("error IS NULL").select("s", "p", "o")


# --- process models --------------------------------------------------------------------------------------------------

_ORG, _BBO = "urn:process:org#", mapping.NAMESPACES["bbo"]


@query(f"""
WITH p AS (SELECT n_nationkey AS k, '<{NS}P' || n_nationkey || '>' AS s, n_name FROM nation), t AS (SELECT c_nationkey AS k, '<{NS}T' || c_custkey || '>' AS s, c_name FROM customer)
SELECT s, '<{T.RDFS}subClassOf>' AS p, '<{_BBO}Process>' AS o FROM p UNION SELECT s, '<{_BBO}name>', '"' || n_name || '"' FROM p
UNION SELECT s, '<{_ORG}belongsToView>', '<{_ORG}BusinessProcessManagementView>' FROM p UNION SELECT s, '<{_ORG}belongsToRAMILayer>', '<urn:process:layer#Business>' FROM p
UNION SELECT s, '<{T.RDFS}subClassOf>', '<{_BBO}UserTask>' FROM t UNION SELECT s, '<{_BBO}name>', '"' || c_name || '"' FROM t UNION SELECT t.s, '<{_ORG}belongsToProcess>', p.s FROM t JOIN p USING (k)
UNION SELECT '<{NS}D' || k || '>', '<{T.RDFS}subClassOf>', '<urn:process:ext#Definitions>' FROM p
""")
def process_models(spark: SparkSession, d: str) -> DataFrame:
    """A process a nation, a task a customer, written as XML files and mapped to triples by the rules."""
    n, c = read(spark, d, "nation"), read(spark, d, "customer")
    key = lambda letter, k: F.concat(F.lit(letter), F.col(k).cast("string"))
    task = F.format_string('<bpmn:userTask id="%s" name="%s"/>', key("T", "c_custkey"), F.col("c_name"))
    tasks = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(F.collect_list(task), "").alias("tasks"))
    head = F.format_string('<bpmn:definitions xmlns:bpmn="urn:b" id="%s"><bpmn:process id="%s" name="%s">', key("D", "n_nationkey"), key("P", "n_nationkey"), F.col("n_name"))
    path = folder(spark, "models")
    n.join(tasks, "n_nationkey", "left").select("n_nationkey", F.concat(head, F.coalesce("tasks", F.lit("")), F.lit("</bpmn:process></bpmn:definitions>")).alias("value")).write.partitionBy("n_nationkey").text(path)
    return mapping.map_files(spark, f"{path}/*/*.txt", base=NS).where("error IS NULL").select("s", "p", "o")

"""A graph view of the star-schema tables: a row is a subject, its columns are predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from .graph import Field, Graph, Table

NS = "urn:x:"
PREFIXES = {"": NS, "rdf": T.RDF, "rdfs": T.RDFS, "xsd": T.XSD}
TYPE = f"<{T.RDF}type>"


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Tables are opened when a query names one of their predicates, and columns read that it names."""
    opened: dict[str, DataFrame] = {}

    def table(name: str, kind: str, key: str, type_name: str | None = None, /, **fields: Field) -> Table:
        def frame() -> DataFrame:
            if name not in opened:
                opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return opened[name]

        own = {f"<{NS}{p}>": f for p, f in fields.items()}
        return Table(kind, frame, node(kind, key), own | ({TYPE: Field(None, f"<{NS}{type_name}", ">")} if type_name else {}))

    def node(kind: str, column: str) -> Field:
        return Field(column, f"<{NS}{kind}/", ">")

    def typed(column: str, datatype: str, text=None) -> Field:
        return Field(column, '"', f'"^^<{T.XSD}{datatype}>', text)

    return Graph(tables=[
        table("region", "region", "r_regionkey", "Region", name=Field("r_name")),
        table("nation", "nation", "n_nationkey", "Nation", name=Field("n_name"), region=node("region", "n_regionkey")),
        table("customer", "customer", "c_custkey", "Customer", name=Field("c_name"), nation=node("nation", "c_nationkey"), segment=Field("c_mktsegment")),
        table("supplier", "supplier", "s_suppkey", "Supplier", name=Field("s_name"), base=node("nation", "s_nationkey")),
        table("orders", "order", "o_orderkey", customer=node("customer", "o_custkey"), date=typed("o_orderdate", "dateTime", lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")), total=typed("o_totalprice", "double"), status=Field("o_orderstatus"), priority=Field("o_orderpriority")),
        table("part", "part", "p_partkey", partname=Field("p_name"), brand=Field("p_brand"), parttype=Field("p_type"), size=typed("p_size", "integer")),
        table("documents", "document", "doc_id", lang=Field("lang"), source=Field("source")),
        table("labels", "document", "doc_id", quality=typed("quality", "integer"), toxic=typed("toxic", "integer")),
    ])

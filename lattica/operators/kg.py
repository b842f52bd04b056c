"""Graph aggregation: rewrites, metadata joins, the synthetic hierarchy and its reports; histograms and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import terms as T
from ..functions.text import date_time, local_name, rewrite_prefix, uri_fragment
from ..storage import written


def rewrite_namespaces(triples: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """Replace IRI prefixes in s, p and IRI objects; the first matching one counts. Doubles are dropped."""
    marked = [(f"<{a}", f"<{b}") for a, b in prefixes]
    return triples.withColumns({c: rewrite_prefix(F.col(c), marked) for c in ("s", "p", "o")}).distinct()


def normalize_structure(triples: DataFrame, belongs_to: str) -> DataFrame:
    """rdfs:subClassOf to rdf:type; belongsTo<Kind> predicates to one belongsTo."""
    name = local_name(T.lexical(F.col("p")))
    p = F.when(F.col("p") == f"<{T.RDFS}subClassOf>", F.lit(f"<{T.RDF}type>")).when(name.startswith("belongsTo") & (F.length(name) > 9), F.lit(f"<{belongs_to}>")).otherwise(F.col("p"))
    return triples.withColumn("p", p).distinct()


def union(*graphs: DataFrame) -> DataFrame:
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g, allowMissingColumns=True)
    return out.distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def same_graph(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def definitions_nodes(triples: DataFrame) -> DataFrame:
    """model, nodes: typed IRIs that end in #Definitions or /Definitions by class."""
    typed = triples.where((F.col("p") == f"<{T.RDF}type>") & (F.col("o").endswith("#Definitions>") | F.col("o").endswith("/Definitions>")) & T.is_iri(F.col("s")))
    return typed.groupBy("model").agg(F.array_sort(F.collect_set("s")).alias("nodes"))


def matched_models(models: DataFrame, meta: DataFrame, original: DataFrame, deny: list[str] | DataFrame) -> DataFrame:
    """models(model, error) joined in two steps: to meta(model, original_id), then original(original_id,
    organization_id, name, datetime); skip_reason is null for models to merge. deny: names, or a frame of them (model)."""
    if isinstance(deny, DataFrame):
        models = models.join(deny.select("model").distinct().withColumn("__deny", F.lit(True)), "model", "left")
        denied = F.coalesce("__deny", F.lit(False))
    else:
        denied = F.col("model").isin(deny)
    known = models.join(meta.withColumn("__meta", F.lit(True)), "model", "left").join(original.withColumn("__orig", F.lit(True)), "original_id", "left")
    reason = F.when(denied, "explicit_skip").when(F.col("__meta").isNull(), "no_meta_match").when(F.col("__orig").isNull(), "no_org_match").when(F.col("error").isNotNull(), "ttl_parse_error")
    return known.withColumn("skip_reason", reason).drop("__meta", "__orig", "__deny")


def organization_labels(models: DataFrame) -> DataFrame:
    """organization_id, organization_label: Org1, Org2, ... over the sorted distinct non-empty ids.

    Ids are dealt to ranges and written, each range is numbered alone and begins where the ones before it end.
    """
    ids = models.select("organization_id").where("organization_id IS NOT NULL AND organization_id <> ''").distinct()
    dealt = written(ids.repartitionByRange("organization_id").withColumn("__part", F.spark_partition_id()), "organizations")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy("organization_id")) + F.col("__before")
    return dealt.join(F.broadcast(starts), "__part").select("organization_id", F.concat(F.lit("Org"), place.cast("string")).alias("organization_label"))


def hierarchy(models: DataFrame, namespace: str, belongs_to: str, extension: str) -> DataFrame:
    """Triples of the synthetic nodes of models(model, original_id, organization_id, organization_label, name, datetime,
    definitions): a corpus, organisations in it, models in these, and each model's one definitions node in the model."""
    n = lambda kind, key: T.iri(F.concat(F.lit(f"{namespace}{kind}/"), uri_fragment(key)))
    corpus, org, model = F.lit(f"<{namespace}Corpus>"), n("Organization", F.coalesce("organization_id", F.lit(""))), n("Model", F.col("model"))
    label = F.coalesce("organization_label", F.lit("OrgUnknown"))
    rdf_type = F.lit(f"<{T.RDF}type>")
    row = lambda s, p, o: F.struct(s.alias("s"), (F.lit(f"<{p}>") if isinstance(p, str) else p).alias("p"), o.alias("o"))
    rows = [
        row(corpus, rdf_type, F.lit(f"<{extension}Corpus>")), row(org, rdf_type, F.lit(f"<{extension}Organization>")), row(org, belongs_to, corpus), row(org, T.RDFS + "label", T.literal(label, lang="en")),
        row(org, f"{namespace}organizationId", T.literal(F.col("organization_id"))), row(model, rdf_type, F.lit(f"<{extension}Model>")), row(model, belongs_to, org), row(model, f"{namespace}originalId", T.literal(F.col("original_id"))),
        row(model, f"{namespace}normalizedId", T.literal(F.col("model"))), row(model, f"{namespace}name", T.literal(F.col("name"))), row(model, f"{namespace}modelCreated", T.literal(date_time(F.col("datetime")), datatype=T.XSD + "dateTime")),
        row(F.when(F.size("definitions") == 1, F.col("definitions")[0]), belongs_to, model),
    ]
    return models.select(F.explode(F.array(*rows)).alias("t")).select("t.*").where("s IS NOT NULL AND o IS NOT NULL").distinct()


def aggregate(triples: DataFrame, errors: DataFrame, meta: DataFrame, original: DataFrame, deny: list[str], prefixes: list[tuple[str, str]], namespace: str, belongs_to: str, extension: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graph, matched, skipped) of triples(s, p, o, model) and errors(model, error).

    A model without exactly one definitions node is reported as skipped, while its triples and nodes stay in the graph.
    """
    models = triples.select("model").union(errors.select("model")).distinct().join(errors.select("model", "error"), "model", "left")
    known = matched_models(models, meta, original, deny)
    ready = known.where("skip_reason IS NULL")
    kept = normalize_structure(rewrite_namespaces(triples.join(F.broadcast(ready.select("model")) if ready.limit(100_001).count() <= 100_000 else ready.select("model"), "model", "left_semi"), prefixes), belongs_to)
    found = definitions_nodes(kept)
    full = ready.join(organization_labels(ready), "organization_id", "left").join(found, "model", "left").withColumn("definitions", F.coalesce("nodes", F.array().cast("array<string>"))).drop("nodes")
    graph = kept.select("s", "p", "o").union(hierarchy(full, namespace, belongs_to, extension)).distinct()
    unclear = F.size("definitions") != 1
    matched = full.where(~unclear).select("model", "original_id", "organization_id", F.coalesce("organization_label", F.lit("OrgUnknown")).alias("organization_label"), "name", "datetime", F.size("definitions").alias("definitions_nodes_found"))
    skipped = known.where("skip_reason IS NOT NULL").select("model", F.col("skip_reason").alias("reason"), F.coalesce("error", F.lit("")).alias("details"))
    skipped = skipped.union(full.where(unclear).select("model", F.lit("missing_or_ambiguous_definitions_node"), F.size("definitions").cast("string")))
    return graph, matched.orderBy(F.lower("model")), skipped.orderBy(F.lower("model"))


def property_histogram(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count("*").alias("n"))


def type_histogram(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("p") == f"<{T.RDF}type>").groupBy(F.col("o").alias("type")).agg(F.count("*").alias("n"))


def sample(rows: DataFrame, order: list[Column], most: int = 20) -> DataFrame:
    """First `most` rows of a total order, with rowCount and rowsTruncated of the whole."""
    total = rows.count()
    return rows.orderBy(*order).limit(most).withColumns({"rowCount": F.lit(total).cast("long"), "rowsTruncated": F.lit(total > most)})

"""RDF terms as single strings: <iri>, _:blank, "value", "value"@lang, "value"^^<datatype>.

Equal strings are equal terms, so graph joins are plain equi-joins and a constant is a filter that reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
NUMERIC = tuple(XSD + n for n in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger"))
_suffix = r'(?s)^".*"(?:@([A-Za-z][A-Za-z0-9\-]*)|\^\^<([^>]*)>)$'


def iri(value: Column) -> Column:
    return F.concat(F.lit("<"), value, F.lit(">"))


def literal(value: Column, lang: str | None = None, datatype: str | None = None) -> Column:
    return F.concat(F.lit('"'), value, F.lit(f'"@{lang}' if lang else f'"^^<{datatype}>' if datatype else '"'))


def lexical(term: Column) -> Column:
    """The IRI, label or value without markup."""
    # All between the first quote and the last one; no pattern, as this runs for every row of a result.
    inner = term.substr(F.lit(2), F.length(term) - 2 - F.length(F.substring_index(term, '"', -1)))
    return F.when(term.startswith("<"), F.substring(term, 2, 1_000_000).substr(F.lit(1), F.length(term) - 2)).when(term.startswith('"'), inner).otherwise(term)


def lang(term: Column) -> Column:
    return F.when(term.startswith('"'), F.regexp_extract(term, _suffix, 1))


def datatype(term: Column) -> Column:
    """IRI text of a literal's datatype; plain literals are xsd:string."""
    own, tag = F.regexp_extract(term, _suffix, 2), F.regexp_extract(term, _suffix, 1)
    return F.when(term.startswith('"'), F.when(own != "", own).when(tag != "", F.lit(RDF + "langString")).otherwise(F.lit(XSD + "string")))


def is_iri(term: Column) -> Column:
    return term.startswith("<")


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def is_blank(term: Column) -> Column:
    return term.startswith("_:")


def is_numeric(term: Column) -> Column:
    return F.regexp_extract(term, _suffix, 2).isin(*NUMERIC)

"""Graphs as Turtle, TriG, TriX, JSON-LD and N-Quads, and back.

The statements are made a set, sorted by ranges, and each range is folded to a document of its own as its rows stream by:
predicates of a subject, objects of a predicate and statements of a graph are written under one head. A run of more than
`RUN` statements is closed and opened anew, so no subject, however many statements it has, is held as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..terms import RDF, XSD
from .turtle import TOKEN, Parser, TurtleError

#: Statements under one head, at most.
RUN = 1_000
TRIX = "http://www.w3.org/2004/03/trix/trix-1/"
_literal = re.compile(r'"(.*)"(?:@([A-Za-z][A-Za-z0-9\-]*)|\^\^<([^>]*)>)?', re.S)
_local = re.compile(r"[A-Za-z_][A-Za-z0-9_\-]*")
_label = re.compile(r"[A-Za-z0-9_]+")
_not_in_iri = re.compile(r'[\x00-\x20<>"{}|^`\\]')
_not_in_xml = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def parts(term: str) -> tuple[str, str | None, str | None]:
    """(value, language, datatype) of a literal."""
    m = _literal.fullmatch(term)
    if not m:
        raise ValueError(f"no term: {term!r}")
    return m[1], m[2], m[3]


def label(term: str) -> str:
    """A blank node's name in characters that all formats have; different names stay different."""
    name = term[2:]
    return name if _label.fullmatch(name) and not name.startswith("x_") else "x_" + name.encode().hex()


def iri(text: str) -> str:
    return "<" + _not_in_iri.sub(lambda m: f"\\u{ord(m[0]):04X}", text[1:-1]) + ">"


def plain(term: str) -> str:
    """A term as in N-Triples."""
    if term.startswith("<"):
        return iri(term)
    if term.startswith("_:"):
        return "_:" + label(term)
    value, lang, kind = parts(term)
    shown = '"' + re.sub(r'[\\"\n\r\t]', lambda m: _short[m[0]], value) + '"'
    return shown + (f"@{lang}" if lang else f"^^{iri(f'<{kind}>')}" if kind else "")


class Compact:
    """Terms as in Turtle: prefixed names, numbers and truth values where these read back as they were."""

    def __init__(self, prefixes: dict[str, str]):
        self.spaces = sorted(((ns, name) for name, ns in prefixes.items()), key=lambda x: -len(x[0]))
        self.shown = lru_cache(100_000)(self.made)

    def made(self, term: str) -> str:
        if term.startswith("<"):
            for ns, name in self.spaces:
                if term.startswith(ns, 1) and _local.fullmatch(term, 1 + len(ns), len(term) - 1):
                    return f"{name}:{term[1 + len(ns) : -1]}"
            return iri(term)
        if term.startswith('"'):
            value, _, kind = parts(term)
            if kind == XSD + "integer" and re.fullmatch(r"[+-]?[0-9]+", value) or kind == XSD + "boolean" and value in ("true", "false"):
                return value
            if kind:
                return plain(f'"{value}"') + "^^" + self.made(f"<{kind}>")
        return plain(term)

    def predicate(self, term: str) -> str:
        return "a" if term == f"<{RDF}type>" else self.shown(term)


def turtle_statements(rows: Iterator[tuple], terms: Compact, indent: str = "") -> Iterator[str]:
    """Statements of sorted (s, p, o): predicate and object lists, each of at most RUN objects."""
    s = p = None
    held: list[str] = []
    for row in rows:
        if row[0] != s or len(held) >= RUN:
            if held:
                yield "".join(held) + " ."
            s, p = row[0], row[1]
            held = [f"{indent}{terms.shown(s)} {terms.predicate(p)} {terms.shown(row[2])}"]
        elif row[1] != p:
            p = row[1]
            held.append(f" ;\n{indent}    {terms.predicate(p)} {terms.shown(row[2])}")
        else:
            held.append(f", {terms.shown(row[2])}")
    if held:
        yield "".join(held) + " ."


def by_graph(rows: Iterator[tuple]) -> Iterator[tuple[str | None, Iterator[tuple]]]:
    """(graph, its (s, p, o)) of sorted (g, s, p, o)."""
    from itertools import groupby

    for g, own in groupby(rows, key=lambda r: r[0]):
        yield g, (r[1:] for r in own)


def turtle(rows: Iterator[tuple], prefixes: dict[str, str]) -> Iterator[str]:
    terms = Compact(prefixes)
    yield from (f"@prefix {name}: {iri(f'<{ns}>')} ." for name, ns in prefixes.items())
    for g, own in by_graph(rows):
        if g is not None:
            raise ValueError(f"Turtle has no named graphs, but {g} is one")
        yield from turtle_statements(own, terms)


def trig(rows: Iterator[tuple], prefixes: dict[str, str]) -> Iterator[str]:
    terms = Compact(prefixes)
    yield from (f"@prefix {name}: {iri(f'<{ns}>')} ." for name, ns in prefixes.items())
    for g, own in by_graph(rows):
        if g is None:
            yield from turtle_statements(own, terms)
        else:
            yield f"{terms.shown(g)} {{"
            yield from turtle_statements(own, terms, "  ")
            yield "}"


def trix(rows: Iterator[tuple], prefixes: dict[str, str]) -> Iterator[str]:
    def xml(text: str) -> str:
        if _not_in_xml.search(text):
            raise ValueError(f"XML has no such character: {text!r}")
        return escape(text, {"\r": "&#13;"})

    def shown(term: str) -> str:
        if term.startswith("<"):
            return f"<uri>{xml(term[1:-1])}</uri>"
        if term.startswith("_:"):
            return f"<id>{label(term)}</id>"
        value, lang, kind = parts(term)
        if kind:
            return f"<typedLiteral datatype={quoteattr(kind)}>{xml(value)}</typedLiteral>"
        return f"<plainLiteral{f' xml:lang={quoteattr(lang)}' if lang else ''}>{xml(value)}</plainLiteral>"

    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<TriX xmlns="{TRIX}">'
    for g, own in by_graph(rows):
        yield f"<graph>{shown(g) if g is not None else ''}"
        yield from (f"<triple>{shown(s)}{shown(p)}{shown(o)}</triple>" for s, p, o in own)
        yield "</graph>"
    yield "</TriX>"


def json_nodes(rows: Iterator[tuple]) -> Iterator[str]:
    """Node objects of sorted (s, p, o), each of at most RUN values."""
    name = lambda term: term[1:-1] if term.startswith("<") else "_:" + label(term)
    node, n = None, 0
    for s, p, o in rows:
        if node is None or node["@id"] != name(s) or n >= RUN:
            if node is not None:
                yield json.dumps(node, ensure_ascii=False)
            node, n = {"@id": name(s)}, 0
        n += 1
        if p == f"<{RDF}type>" and not o.startswith('"'):
            node.setdefault("@type", []).append(name(o))
        elif o.startswith('"'):
            value, lang, kind = parts(o)
            node.setdefault(name(p), []).append({"@value": value} | ({"@language": lang} if lang else {"@type": kind} if kind else {}))
        else:
            node.setdefault(name(p), []).append({"@id": name(o)})
    if node is not None:
        yield json.dumps(node, ensure_ascii=False)


def json_ld(rows: Iterator[tuple], prefixes: dict[str, str]) -> Iterator[str]:
    """An array of node objects in expanded form; a named graph is an object with its nodes as @graph."""
    yield "["
    comma = ""
    for g, own in by_graph(rows):
        if g is None:
            for node in json_nodes(own):
                yield comma + node
                comma = ","
        else:
            yield comma + json.dumps({"@id": g[1:-1] if g.startswith("<") else "_:" + label(g)}, ensure_ascii=False)[:-1] + ', "@graph": ['
            comma = ""
            for node in json_nodes(own):
                yield comma + node
                comma = ","
            yield "]}"
            comma = ","
    yield "]"


def n_quads(rows: Iterator[tuple], prefixes: dict[str, str]) -> Iterator[str]:
    for g, s, p, o in rows:
        yield f"{plain(s)} {plain(p)} {plain(o)}{f' {plain(g)}' if g is not None else ''} ."


FORMATS: dict[str, Callable[[Iterator[tuple], dict[str, str]], Iterator[str]]] = {"turtle": turtle, "trig": trig, "trix": trix, "jsonld": json_ld, "nquads": n_quads}


def documents(quads: DataFrame, format: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """value: the lines of a document for each range of the sorted statements quads(s, p, o[, g]).

    g: the graph's name, null for the default graph. Statements that are there several times are written once; blank nodes
    keep their names over all documents, so read these with one `scope`. No statements give no documents. TriX raises for
    characters that XML does not have, Turtle for named graphs.
    """
    fold = FORMATS[format]
    given = quads if "g" in quads.columns else quads.withColumn("g", F.lit(None).cast("string"))
    order = ["g", "s", "p", "o"]
    n = max(1, int(quads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = given.select(*order).distinct().repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = pa.schema([("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        first = next(rows, None)
        if first is None:
            return

        def all_rows() -> Iterator[tuple]:
            yield first
            yield from rows

        held, size = [], 0
        for line in fold(all_rows(), prefixes or {}):
            held.append(line)
            size += len(line)
            if size > 1 << 20:
                yield pa.record_batch([pa.array(held, pa.string())], schema=schema)
                held, size = [], 0
        yield pa.record_batch([pa.array(held, pa.string())], schema=schema)

    return ranges.mapInArrow(run, "value string")


def write_graph(quads: DataFrame, path: str, format: str, prefixes: dict[str, str] | None = None, mode: str = "errorifexists") -> None:
    """A folder of files, each a document of the format; see `documents`."""
    documents(quads, format, prefixes).write.mode(mode).text(path)


# --- readers -------------------------------------------------------------------------------------------------------


def trig_quads(text: str, scope: str) -> Iterator[tuple]:
    yield from Parser(scope).load(text, "t").parse(graphs=True)


def trix_quads(text: str, scope: str) -> Iterator[tuple]:
    from xml.etree import ElementTree

    kind = lambda e: e.tag.rpartition("}")[2]

    def term(e) -> str:
        value = e.text or ""
        if kind(e) == "uri":
            return f"<{value}>"
        if kind(e) == "id":
            return f"_:{scope}.{value}"
        lang = e.get("{http://www.w3.org/XML/1998/namespace}lang")
        return f'"{value}"' + (f"^^<{e.get('datatype')}>" if kind(e) == "typedLiteral" else f"@{lang}" if lang else "")

    for graph in ElementTree.fromstring(text.encode()):
        g = None
        for e in graph:
            if kind(e) == "triple":
                s, p, o = map(term, e)
                yield s, p, o, g
            else:
                g = term(e)


def json_quads(text: str, scope: str) -> Iterator[tuple]:
    """Statements of expanded JSON-LD: arrays of node objects, their values, lists not."""
    name = lambda x: f"_:{scope}.{x[2:]}" if x.startswith("_:") else f"<{x}>"

    def node(n: dict, g: str | None) -> Iterator[tuple]:
        if "@graph" in n:
            for m in n["@graph"]:
                yield from node(m, name(n["@id"]))
        for p, values in n.items():
            if p == "@type":
                yield from ((name(n["@id"]), f"<{RDF}type>", name(t), g) for t in values)
            elif not p.startswith("@"):
                for v in values:
                    if "@id" in v:
                        o = name(v["@id"])
                    elif isinstance(v.get("@value"), str):
                        o = f'"{v["@value"]}"' + (f"@{v['@language']}" if "@language" in v else f"^^<{v['@type']}>" if "@type" in v else "")
                    else:
                        raise TurtleError(f"not expanded: {v!r}")
                    yield name(n["@id"]), name(p), o, g

    for n in json.loads(text):
        yield from node(n, None)


def quads_of_lines(text: str, scope: str) -> Iterator[tuple]:
    for line in text.split("\n"):
        if any(m.lastgroup not in ("space", "comment") for m in TOKEN.finditer(line)):
            parser, terms = Parser(scope).load(line, "n"), []
            while parser.peek() != ("mark", "."):
                terms.append(parser.term())
            if len(terms) not in (3, 4):
                raise TurtleError(f"no statement: {line!r}")
            yield (*terms[:3], terms[3] if len(terms) == 4 else None)


READERS = {"trig": trig_quads, "trix": trix_quads, "jsonld": json_quads, "nquads": quads_of_lines}


def read_graph(spark: SparkSession, path: str, format: str, scope: str | None = None) -> DataFrame:
    """s, p, o, g, model, error of files of a format; a file that cannot be read gives one row with the error instead.

    scope: what blank nodes are named by, if they are the same in all files; by default those of different files differ.
    N-Quads are read line by line, the other formats file by file: a file is one task's.
    """
    read = READERS[format]
    schema = pa.schema([(c, pa.string()) for c in ("s", "p", "o", "g", "model", "error")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                model = re.sub(r"\.[^.]*$", "", file.rsplit("/", 1)[-1])
                try:
                    rows = [(*row, model, None) for row in read(text, scope or model)]
                except (ValueError, KeyError, TypeError, SyntaxError, RecursionError) as e:
                    rows = [(None, None, None, None, model, str(e))]
                for k in range(0, len(rows), 50_000):
                    yield pa.record_batch([pa.array([r[c] for r in rows[k : k + 50_000]], pa.string()) for c in range(6)], schema=schema)

    text = spark.read.text(path, wholetext=format != "nquads", **({} if format != "nquads" else {"lineSep": "\n"}))
    return text.select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(run, "s string, p string, o string, g string, model string, error string")

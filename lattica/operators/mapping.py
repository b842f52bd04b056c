"""Declarative mapping of process-model XML to triples.

A rule: an element path, a subject template, a class, and pairs of predicate and value. Values: "@x" an attribute,
"text()" the element's text, "type()" the attribute whose local name is type; "<template>" an IRI from a template of
{@id}, {../@id}, {child}, {child/@id}, {*}, {position()}, {text()}; "^Rule all" the subjects of all elements of a rule in
the file, "^Rule parent" of those whose id is that of this element's parent, "^Rule child" of those whose parent has this
element's id. `~` stands for the base IRI. A missing part of a value gives no triple. A rule that is not defined gives none.

Documents become rows of elements; what one element says alone becomes triples at once, references to other rules' elements
are joins of these rows by file, rule and id.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fix_flags, fix_prefix
from ..storage import written
from ..terms import RDFS
from . import mapping_rules

#: Prefixes of rules: the public ontologies by their own IRIs, neutral names for the rest; pass others where wanted.
NAMESPACES = {"bbo": "https://www.irit.fr/recherches/MELODI/ontologies/BBO#", "ext": "urn:process:ext#", "org": "urn:process:org#", "rdfs": RDFS, "layer": "urn:process:layer#"}
BASE = "urn:process:element/"


@dataclass(frozen=True)
class Rule:
    name: str
    path: str
    subject: str
    kind: str
    values: tuple[tuple[str, str], ...] = field(default=())


RULES = [Rule(*row) for row in mapping_rules.RULES]


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class Document:
    """An XML document with parents and positions, read by local names."""

    def __init__(self, text: str):
        self.root = ET.fromstring(text)
        self.parent = {c: p for p in self.root.iter() for c in p}
        self.chains: dict[ET.Element, str] = {}

    def chain(self, e: ET.Element) -> str:
        """Names from the root to the element."""
        if e not in self.chains:
            above = self.parent.get(e)
            self.chains[e] = (self.chain(above) if above is not None else "") + "/" + local(e.tag)
        return self.chains[e]

    def attribute(self, e: ET.Element | None, name: str) -> str | None:
        return None if e is None else next((v for k, v in e.attrib.items() if local(k) == name), None)

    def position(self, e: ET.Element) -> int:
        same = [c for c in self.parent.get(e, [e]) if c.tag == e.tag]
        return same.index(e) + 1

    def reference(self, e: ET.Element, name: str) -> list[str]:
        if name == "position()":
            return [str(self.position(e))]
        if name == "text()":
            return [e.text.strip()] if e.text and e.text.strip() else []
        if name == "type()":
            return [v for v in [self.attribute(e, "type")] if v is not None]
        if name == "*":
            return [c.text.strip() for c in e if c.text and c.text.strip()]
        if name.startswith("../@"):
            found = [self.attribute(self.parent.get(e), name[4:])]
        elif name.startswith("@"):
            found = [self.attribute(e, name[1:])]
        else:
            child, _, attribute = name.partition("/@")
            children = [c for c in e if local(c.tag) == child]
            found = [self.attribute(c, attribute) if attribute else (c.text or "").strip() or None for c in children]
        return [v for v in found if v is not None]

    def filled(self, e: ET.Element, template: str, base: str) -> list[str]:
        out = [""]
        for part in re.split(r"(\{[^}]*\})", template.replace("~", base)):
            values = self.reference(e, part[1:-1]) if part.startswith("{") else [part]
            out = [o + v for o in out for v in values]
        return out


class Paths:
    """Which rules' paths fit a chain of names, found once for each chain; // stands for any number of steps."""

    def __init__(self, rules: list[Rule]):
        self.patterns = [(r, re.compile("/(?:[^/]+/)*" + r.path[2:].replace("//", "/(?:[^/]+/)*") if r.path.startswith("//") else "/" + r.path.replace("//", "/(?:[^/]+/)*"))) for r in rules]
        self.known: dict[str, list[Rule]] = {}

    def of(self, chain: str) -> list[Rule]:
        if chain not in self.known:
            self.known[chain] = [r for r, p in self.patterns if p.fullmatch(chain)]
        return self.known[chain]


def element_rows(text: str, paths: Paths, base: str, namespaces: dict[str, str], class_predicate: str) -> Iterator[tuple]:
    """(rule, subject, predicate, object, id, parent's id): triples that an element gives alone, and, with a null predicate,
    the element itself, for the joins."""
    doc = Document(text)
    full = lambda name: full_name(name, namespaces)
    for e in doc.root.iter():
        for r in paths.of(doc.chain(e)):
            for s in doc.filled(e, r.subject, base)[:1]:
                s = f"<{s}>"
                yield r.name, s, None, None, doc.attribute(e, "id"), doc.attribute(doc.parent.get(e), "id")
                yield r.name, s, f"<{class_predicate}>", full(r.kind), None, None
                for predicate, value in r.values:
                    if value.startswith("<"):
                        inner = value[1:-1]
                        objects = [f"<{o}>" for o in doc.filled(e, inner, base)] if "{" in inner or "~" in inner else [full(inner)]
                    elif value.startswith("^"):
                        continue
                    else:
                        objects = [f'"{o}"' for o in doc.reference(e, value)]
                    yield from ((r.name, s, full(predicate), o, None, None) for o in objects)


def full_name(name: str, namespaces: dict[str, str]) -> str:
    return "<" + re.sub(r"^(\w+):", lambda m: namespaces.get(m[1], m[0]), name) + ">"


def map_files(spark: SparkSession, path: str, rules: list[Rule] = RULES, base: str = BASE, namespaces: dict[str, str] = NAMESPACES, class_predicate: str = RDFS + "subClassOf") -> DataFrame:
    """s, p, o, model, error of XML files, each triple of a file once; a malformed file is a row with its error.

    Declared ns0 prefixes and bare boolean attributes are repaired first. A file is read by one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths = Paths(rules)
        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["xml"]):
                model = re.sub(r"\.[^.]*$", "", file.rsplit("/", 1)[-1])
                try:
                    rows += [(file, model, *row, None) for row in element_rows(text, paths, base, namespaces, class_predicate)]
                except ET.ParseError as e:
                    rows.append((file, model, *[None] * 6, str(e)))
            yield pd.DataFrame(rows, columns=["file", "model", "rule", "s", "p", "o", "id", "parent", "error"], dtype=object)

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), fix_flags(fix_prefix(F.col("value"))).alias("xml"))
    rows = written(whole.mapInPandas(run, "file string, model string, rule string, s string, p string, o string, id string, parent string, error string"), "elements")
    # One row a reference of a rule to another: a table of the size of the rules.
    links = [(r.name, full_name(p, namespaces), *v[1:].split(" ")) for r in rules for p, v in r.values if v.startswith("^")]
    link = F.broadcast(spark.createDataFrame(links, "rule string, p string, target string, how string"))
    elements = rows.where("p IS NULL AND error IS NULL").select("file", "model", "rule", "s", "id", "parent")
    asking = elements.join(link, "rule").select("file", "model", "s", link["p"], "target", "how", "id", "parent")
    asked = elements.select("file", F.col("rule").alias("target"), F.col("s").alias("o"), F.col("id").alias("its_id"), F.col("parent").alias("its_parent"))
    pairs = [
        asking.where("how = 'all'").join(asked, ["file", "target"]),
        asking.where("how = 'parent'").withColumn("its_id", F.col("parent")).join(asked, ["file", "target", "its_id"]),
        asking.where("how = 'child'").withColumn("its_parent", F.col("id")).join(asked, ["file", "target", "its_parent"]),
    ]
    none = F.lit(None).cast("string").alias("error")
    triples = reduce(DataFrame.union, [rows.where("p IS NOT NULL").select("file", "s", "p", "o", "model"), *(x.select("file", "s", "p", "o", "model") for x in pairs)]).distinct()
    return triples.select("s", "p", "o", "model", none).union(rows.where("error IS NOT NULL").select("s", "p", "o", "model", "error"))

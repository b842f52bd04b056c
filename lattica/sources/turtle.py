"""Turtle files of any size as triples: split at lines, cut into statements in parallel, parsed in chunks.

Spark deals out the lines of a file by blocks. Only a long string (three quotes) reaches over a line's end, so at a block's
begin the text is outside of strings or in one of two kinds of them. Each block says, for the three cases, in which it
ends; folded along a file, that gives how each block begins. Knowing that, a block is cut at its statements' ends: what lies
between the first and the last of them is parsed where it is; the ends over are joined with those of the neighbouring blocks.
Directives hold for all that follows in the file, in later blocks too: each chunk is given what holds where it begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written
from ..terms import RDF, XSD

# The character classes and token shapes of the Turtle grammar.
BASE_CHARS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02FF\u0370-\u037D\u037F-\u1FFF\u200C-\u200D\u2070-\u218F\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD\U00010000-\U000EFFFF"
NAME_CHARS = BASE_CHARS + r"_\-0-9\u00B7\u0300-\u036F\u203F-\u2040"
_plain_escape = r"%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]"
_prefix = rf"(?:[{BASE_CHARS}](?:[{NAME_CHARS}.]*[{NAME_CHARS}])?)?:"
_local = rf"(?:(?:[{BASE_CHARS}_:0-9]|{_plain_escape})(?:(?:[{NAME_CHARS}.:]|{_plain_escape})*(?:[{NAME_CHARS}:]|{_plain_escape}))?)?"
TOKEN = re.compile(
    rf"""(?P<space>[ \t\r\n]+)|(?P<comment>\#[^\r\n]*)|(?P<iri><(?:[^\x00-\x20<>"{{}}|^`\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*>)
    |(?P<long>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')|(?P<open>\"\"\"|''')|(?P<string>"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
    |(?P<blank>_:[{BASE_CHARS}_0-9](?:[{NAME_CHARS}.]*[{NAME_CHARS}])?)|(?P<name>{_prefix}{_local})|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<double>[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)|(?P<decimal>[+-]?\d*\.\d+)|(?P<integer>[+-]?\d+)|(?P<word>[A-Za-z]+)|(?P<mark>\^\^|[.;,()\[\]{{}}])""",
    re.X | re.S,
)
#: States at a line's begin: outside of long strings, or in one of either quote.
OUTSIDE, QUOTES = 0, ("", '"""', "'''")
_close = [None, *(re.compile(rf"(?:\\.|[^\\])*?{q}", re.S) for q in QUOTES[1:])]
#: Characters of statements that are parsed as one row, about.
CHUNK = 1 << 20
_escapes = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
PLAIN = re.compile(r"\\(.)")
_iri_parts = re.compile(r"(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.S)


class TurtleError(ValueError):
    """The text is not Turtle."""


def tokens_of(line: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of a line's tokens from a state on; the last one is ("state", the state at its end, 0)."""
    at = 0
    if state:
        m = _close[state].match(line)
        if not m:
            yield "state", state, 0
            return
        at = m.end()
    while at < len(line):
        m = TOKEN.match(line, at)
        if not m:
            at += 1  # no token; the parser will say so
            continue
        if m.lastgroup == "open":
            yield "state", QUOTES.index(m[0]), 0
            return
        yield m.lastgroup, m.start(), m.end()
        at = m.end()
    yield "state", OUTSIDE, 0


def state_after(line: str, state: int) -> int:
    if not any(q in line for q in QUOTES[1:]):
        return state
    for kind, found, _ in tokens_of(line, state):
        if kind == "state":
            return found
    raise AssertionError


def resolved(base: str, text: str) -> str:
    """An IRI reference against a base, by RFC 3986."""
    scheme, host, path, query, part = _iri_parts.fullmatch(text).groups()
    if scheme is not None or not base:
        return text
    b_scheme, b_host, b_path, b_query, _ = _iri_parts.fullmatch(base).groups()
    if host is None:
        host = b_host
        if not path:
            path, query = b_path, b_query if query is None else query
        elif not path.startswith("/"):
            path = ("/" if b_host is not None and not b_path else b_path[: b_path.rfind("/") + 1]) + path
        if b_scheme is None:
            return text
    out: list[str] = []
    steps = path.split("/")
    for k, step in enumerate(steps):
        if step == ".." and len(out) > 1:
            out.pop()
        if step in (".", ".."):
            if k == len(steps) - 1:
                out.append("")
            continue
        out.append(step)
    made = f"{b_scheme}:" if b_scheme else ""
    return made + (f"//{host}" if host is not None else "") + "/".join(out) + (f"?{query}" if query is not None else "") + (f"#{part}" if part is not None else "")


def unescaped(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[3] is None else _escapes.get(m[3], m[3]), text, flags=re.S) if "\\" in text else text


class Parser:
    """Triples of statements. prefixes and base go on from one text to the next; scope tells blank nodes of texts apart."""

    def __init__(self, scope: str, prefixes: dict[str, str] | None = None, base: str = ""):
        self.scope, self.prefixes, self.base = scope, dict(prefixes or {}), base
        self.made, self.out, self.graph = 0, [], None
        self.directives: list[tuple[str, str, str]] = []

    def load(self, text: str, place: str) -> Parser:
        self.tokens, at, self.place = [], 0, place
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.lastgroup == "open":
                raise TurtleError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup not in ("space", "comment"):
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0
        return self

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if text is not None and got[1] != text or got[0] == "end":
            raise TurtleError(f"expected {text or 'a term'}, found {got[1] or 'the end'!r}")
        self.at += 1
        return got

    def accept(self, text: str) -> bool:
        if self.peek() == ("mark", text):
            self.at += 1
            return True
        return False

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            return f"<{resolved(self.base, unescaped(text[1:-1]))}>"
        prefix, _, local = text.partition(":")
        if kind != "name" or prefix not in self.prefixes:
            raise TurtleError(f"unknown prefix or no IRI: {text!r}")
        return f"<{self.prefixes[prefix]}{re.sub(PLAIN, lambda m: m[1], local)}>"

    def directive(self) -> bool:
        kind, text = self.peek()
        word = text.lstrip("@").lower()
        if word not in ("prefix", "base") or kind not in ("at", "word"):
            return False
        self.take()
        name = ""
        if word == "prefix":
            kind_of, shown = self.take()
            if kind_of != "name" or not shown.endswith(":"):
                raise TurtleError(f"no prefix: {shown!r}")
            name = shown[:-1]
        kind_of, shown = self.take()
        if kind_of != "iri":
            raise TurtleError(f"no IRI: {shown!r}")
        value = self.iri(kind_of, shown)[1:-1]
        self.hold(word, name, value)
        self.directives.append((word, name, value))
        if kind == "at":
            self.take(".")
        return True

    def hold(self, word: str, name: str, value: str) -> None:
        if word == "base":
            self.base = value
        else:
            self.prefixes[name] = value

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}.{self.place}.{self.made}"

    def emit(self, s: str, p: str, o: str) -> None:
        self.out.append((s, p, o, self.graph))

    def term(self) -> str:
        """A subject or object, with the triples of what it contains."""
        kind, text = self.take()
        if kind in ("iri", "name"):
            return self.iri(kind, text)
        if kind == "blank":
            return f"_:{self.scope}.{text[2:]}"
        if kind in ("integer", "decimal", "double"):
            return f'"{text}"^^<{XSD}{kind}>'
        if kind == "word" and text in ("true", "false"):
            return f'"{text}"^^<{XSD}boolean>'
        if kind in ("string", "long"):
            value = unescaped(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "at":
                return f'"{value}"{self.take()[1]}'
            if self.accept("^^"):
                own = self.iri(*self.take())
                return f'"{value}"' if own == f"<{XSD}string>" else f'"{value}"^^{own}'
            return f'"{value}"'
        if text == "[":
            node = self.fresh()
            if not self.accept("]"):
                self.properties(node)
                self.take("]")
            return node
        if text == "(":
            held = []
            while not self.accept(")"):
                held.append(self.term())
            nodes = [self.fresh() for _ in held]
            for k, (node, item) in enumerate(zip(nodes, held, strict=True)):
                self.emit(node, f"<{RDF}first>", item)
                self.emit(node, f"<{RDF}rest>", nodes[k + 1] if k + 1 < len(nodes) else f"<{RDF}nil>")
            return nodes[0] if nodes else f"<{RDF}nil>"
        raise TurtleError(f"unexpected {text!r}")

    def properties(self, s: str) -> None:
        while True:
            kind, text = self.take()
            p = f"<{RDF}type>" if (kind, text) == ("word", "a") else self.iri(kind, text)
            self.emit(s, p, self.term())
            while self.accept(","):
                self.emit(s, p, self.term())
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass
            if self.peek()[1] in (".", "]", "}") or self.peek()[0] == "end":
                return

    def triples(self) -> None:
        bare = self.peek() == ("mark", "[")
        s = self.term()
        if s.startswith('"'):
            raise TurtleError("a literal is no subject")
        if not (bare and self.peek()[1] in (".", "}")):
            self.properties(s)

    def parse(self, graphs: bool = False) -> list[tuple]:
        """All triples (s, p, o, graph) of the text; graphs: blocks of named graphs may stand in it, too."""
        while self.peek()[0] != "end":
            if self.directive():
                continue
            if graphs and self.block():
                continue
            self.triples()
            self.take(".")
        out, self.out = self.out, []
        return out

    def block(self) -> bool:
        """A braced block, with the graph's name before it, if one stands here."""
        at, self.graph = self.at, None
        if self.peek()[0] == "word" and self.peek()[1].upper() == "GRAPH":
            self.take()
        if self.peek() != ("mark", "{"):
            if self.peek()[0] not in ("iri", "name", "blank") or self.tokens[self.at + 1 : self.at + 2] != [("mark", "{")]:
                self.at = at
                return False
            self.graph = self.term()
        self.take("{")
        while not self.accept("}"):
            self.triples()
            if not self.accept(".") and self.peek()[1] != "}":
                raise TurtleError(f"expected . or }}, found {self.peek()[1]!r}")
        self.graph = None
        return True


# --- the reader ----------------------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, value: lines in order within a block. Carriage returns stay."""
    got = spark.read.option("lineSep", "\n").text(path)
    return got.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """((file, block), rows) of consecutive rows; a block may come in several parts."""
    for batch in batches:
        rows, key = [], None
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if rows:
                    yield key, rows
                rows, key = [], row[:2]
            rows.append(row)
        if rows:
            yield key, rows


def block_states(lines: DataFrame) -> DataFrame:
    """file, block, state of the blocks that begin inside of a long string."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for key, rows in sections(batches):
            ends = held.setdefault(key, [0, 1, 2])
            for row in rows:
                if any(q in row[2] for q in QUOTES[1:]):
                    ends[:] = [state_after(row[2], s) for s in ends]
        some = [(f, b, e) for (f, b), e in held.items()]
        yield pa.record_batch([pa.array([x[k] for x in some], schema.field(k).type) for k in range(3)], schema=schema)

    ends = lines.mapInArrow(run, "file string, block long, ends array<int>")
    # One row a file, three numbers a block; files all of whose blocks end as they begin need no walk.
    files = ends.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "ends"))).alias("blocks")).where(F.exists("blocks", lambda x: x["ends"][0] != OUTSIDE))
    begins = pa.schema([("file", pa.string()), ("block", pa.int64()), ("state", pa.int32())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = OUTSIDE
                for b in blocks:
                    if state:
                        out.append((file, b["block"], state))
                    state = b["ends"][state]
            yield pa.record_batch([pa.array([x[k] for x in out], f.type) for k, f in enumerate(begins)], schema=begins)

    return files.mapInArrow(walk, "file string, block long, state int")


def statement_chunks(lines: DataFrame) -> DataFrame:
    """file, place, text: whole statements in chunks; `place` sorts the chunks of a file as they stand in it."""
    states = written(block_states(lines), "turtle-states", wide=True)
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: tuple, kind: int, part: int, text: str) -> pa.RecordBatch:
            return pa.record_batch([pa.array([v], f.type) for v, f in zip((*key, kind, part, text), schema, strict=True)], schema=schema)

        key, state, part, head, body, size, open_ = None, OUTSIDE, 0, None, [], 0, []

        def finished() -> Iterator[pa.RecordBatch]:
            if key is not None:
                if body:
                    yield row(key, 1, part, "".join(body))
                # kind 0: up to the first end of a statement; 2: what follows the last one.
                if head is not None:
                    yield row(key, 0, 0, head)
                    yield row(key, 2, 0, "".join(open_))
                else:
                    yield row(key, 0, 1, "".join(open_))

        for own, rows in sections(batches):
            if own != key:
                yield from finished()
                key, state, part, head, body, size, open_ = own, rows[0][3], 0, None, [], 0, []
            for _, _, value, _ in rows:
                line, begin = value + "\n", 0
                if state and QUOTES[state] not in line:
                    open_.append(line)
                    continue
                for kind, a, b in tokens_of(line, state):
                    if kind == "state":
                        state = a
                    elif kind == "mark" and line[a] == ".":
                        open_.append(line[begin:b])
                        begin = b
                        whole = "".join(open_)
                        open_ = []
                        if head is None:
                            head = whole
                            continue
                        body.append(whole)
                        size += len(whole)
                if begin < len(line):
                    open_.append(line[begin:])
                if size > CHUNK:
                    yield row(key, 1, part, "".join(body))
                    part, body, size = part + 1, [], 0
        yield from finished()

    if states.isEmpty():  # no file has a long string over a block's border: the lines stay where they are
        begun = lines.select("file", "block", "value", F.lit(OUTSIDE).alias("state"))
    else:
        begun = lines.join(F.broadcast(states), ["file", "block"], "left").select("file", "block", "value", F.coalesce("state", F.lit(OUTSIDE)).alias("state"))
    cut = written(begun.mapInArrow(run, "file string, block long, kind int, part int, text string"), "turtle-cut", wide=True)
    place = F.struct("block", "kind", "part")
    whole = cut.where("kind = 1").select("file", place.alias("place"), "text")
    # A statement over a border: the end of a block, blocks without any end (kind 0, part 1), and the begin of another.
    border = cut.where("kind <> 1").withColumn("of", F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    joined = border.groupBy("file", "of").agg(F.min(place).alias("place"), F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("pieces"))
    return whole.unionByName(joined.select("file", "place", F.array_join("pieces.text", "").alias("text"))).where(F.trim("text") != "")


def reduced(found: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Of directives in order, (word, name, IRI token), those that still count at their end: the last one of each name, resolved.
    If one is relative to a base that stands before them all, they are left as they are."""
    last: dict[str, tuple[str, str, str]] = {}
    base = ""
    for word, name, iri in found:
        value = resolved(base, unescaped(iri[1:-1]))
        if _iri_parts.fullmatch(value)[1] is None:
            return found
        if word == "base":
            base = value
        shown = value.replace("\\", "\\u005C")  # it is read once more
        last[name if word == "prefix" else ":"] = (word, name, f"<{shown}>")
    return list(last.values())


def holding(chunks: DataFrame) -> DataFrame:
    """file, place, held: the base and the prefixes that hold where a chunk begins; chunks before any directive have no row.

    A chunk tells the last directive of each name. Only these are gathered a file, and walked in order: of each chunk that
    is a few short texts, however many directives it has, and the walk holds no more than what holds at one place.
    """
    some = [("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32())]
    item = pa.list_(pa.struct([("word", pa.string()), ("name", pa.string()), ("iri", pa.string())]))
    schema = pa.schema([*some, ("held", item)])
    ddl = "file string, block long, kind int, part int, held array<struct<word:string,name:string,iri:string>>"

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    def named(rows: list[tuple[str, str, str]]) -> list[dict[str, str]]:
        return [dict(zip(("word", "name", "iri"), r, strict=True)) for r in rows]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, shown = [], []
                for m in TOKEN.finditer(text or ""):
                    if m.lastgroup in ("space", "comment"):
                        continue
                    # A directive is a word, for a prefix a name, and an IRI.
                    shown = [*shown[-2:], (m.lastgroup, m[0])]
                    if m.lastgroup == "iri" and len(shown) > 1:
                        kinds, words = [k for k, _ in shown], [w.lstrip("@").lower() for _, w in shown]
                        if kinds[-2] in ("at", "word") and words[-2] == "base":
                            found.append(("base", "", m[0]))
                        elif kinds[-2] == "name" and len(shown) == 3 and kinds[0] in ("at", "word") and words[0] == "prefix":
                            found.append(("prefix", shown[1][1][:-1], m[0]))
                yield batch_of([(*at, named(reduced(found)))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parser, out, size = None, Parser(""), [], 0
        for batch in batches:
            for *at, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at[0] != own:
                    own, parser = at[0], Parser("")
                now = [("base", "", parser.base)] * bool(parser.base) + [("prefix", n, v) for n, v in parser.prefixes.items()]
                if now:
                    out.append((*at, named(now)))
                    size += len(now)
                for d in held:
                    parser.hold(d["word"], d["name"], parser.iri("iri", d["iri"])[1:-1])
                if size > 20_000:
                    yield batch_of(out)
                    out, size = [], 0
        yield batch_of(out)

    text = F.when(F.lower("text").rlike("prefix|base"), F.col("text")).alias("text")
    sums = written(chunks.select("file", "place.block", "place.kind", "place.part", text).mapInArrow(summed, ddl), "turtle-directives", wide=True)
    sums = sums.repartition("file").sortWithinPartitions("file", "block", "kind", "part")
    return written(sums.mapInArrow(walk, ddl), "turtle-holding", wide=True).select("file", F.struct("block", "kind", "part").alias("place"), "held")


def read_turtle(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """s, p, o, model, error of Turtle or N-Triples files: the whole grammar, files split over tasks.

    model is the file's stem; blank nodes are named by it, so those of different files differ, or by `scope` if they are the
    same in all files. A file with a statement that
    is not Turtle gives one row with the first error instead: s, p and o null. An empty file gives none.
    """
    chunks = written(statement_chunks(read_lines(spark, path)), "turtle-chunks", wide=True)
    given = chunks.join(holding(chunks), ["file", "place"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "s", "p", "o", "model", "place", "error"]
        for batch in batches:
            for file, place, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                model = re.sub(r"\.[^.]*$", "", file.rsplit("/", 1)[-1])
                at = f"{place['block']:020d}.{place['kind']}.{place['part']:09d}"
                own = f"{model if scope else 'b'}-{place['block']}-{place['kind']}-{place['part']}"
                parser = Parser(scope or model)
                try:
                    for d in held or []:
                        parser.hold(d["word"], d["name"], d["iri"])
                    rows = [(file, s, p, o, model, at, None) for s, p, o, _ in parser.load(text, own).parse()]
                except (TurtleError, RecursionError) as e:
                    rows = [(file, None, None, None, model, at, str(e))]
                for k in range(0, len(rows), 50_000):
                    yield pa.record_batch([pa.array([r[c] for r in rows[k : k + 50_000]], pa.string()) for c in range(7)], names=names)

    parsed = written(given.select("file", "place", "text", "held").mapInArrow(run, "file string, s string, p string, o string, model string, place string, error string"), "turtle-parsed", wide=True)
    bad = parsed.where("error IS NOT NULL").groupBy("file").agg(F.first("model").alias("model"), F.min_by("error", "place").alias("error"))
    good = parsed.join(bad.select("file"), "file", "left_anti").select("s", "p", "o", "model", "error")
    none = F.lit(None).cast("string")
    return good.unionByName(bad.select(none.alias("s"), none.alias("p"), none.alias("o"), "model", "error"))

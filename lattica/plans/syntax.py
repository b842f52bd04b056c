"""SPARQL text to a tree of plain tuples and dataclasses (SELECT and ASK)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..terms import RDF, XSD

TOKEN = re.compile(
    r"""(?P<space>[\s]+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)
    |(?P<string>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
    |(?P<blank>_:\w+)|(?P<name>[A-Za-z][\w\-]*(?:\.[\w\-]+)*:(?:(?:[\w\-:%]|\.(?=[\w\-%])|\\.)*)|:(?:[\w\-%]|\.(?=[\w\-%]))*)
    |(?P<word>[A-Za-z_]\w*)|(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!*/+\-|^?])""",
    re.X | re.S,
)


class SparqlError(ValueError):
    """The text is no query that this engine reads."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    text: str


@dataclass
class Query:
    form: str
    distinct: bool = False
    items: list = field(default_factory=list)  # (expression, name); empty: all
    where: tuple = ("group", [])
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int = 0


AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), text)


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.base, self.blank = 0, "", 0
        self.prefixes = {"xsd": XSD, "rdf": RDF} | (prefixes or {})

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, text: str | None = None) -> str:
        kind, got = self.peek()
        if text is not None and got.upper() != text:
            raise SparqlError(f"expected {text}, found {got or 'the end'}")
        self.at += 1
        return got

    def has(self, *texts: str) -> bool:
        return self.peek()[1].upper() in texts and self.peek()[0] in ("word", "mark")

    def accept(self, text: str) -> bool:
        if self.has(text):
            self.at += 1
            return True
        return False

    def query(self) -> Query:
        while self.has("PREFIX", "BASE"):
            if self.take().upper() == "BASE":
                self.base = self.take()[1:-1]
            else:
                name = self.take()[:-1]
                self.prefixes[name] = self.resolve(self.take())
        q = self.select() if self.has("SELECT") else self.ask()
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]}")
        return q

    def resolve(self, text: str) -> str:
        inner = text[1:-1]
        return inner if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", inner) else self.base + inner

    def ask(self) -> Query:
        self.take("ASK")
        self.accept("WHERE")
        return Query("ask", where=self.group())

    def select(self) -> Query:
        self.take("SELECT")
        q = Query("select")
        q.distinct = self.accept("DISTINCT")
        self.accept("REDUCED")
        if not self.accept("*"):
            while True:
                if self.peek()[0] == "var":
                    v = Var(self.take()[1:])
                    q.items.append((v, v.name))
                elif self.accept("("):
                    e = self.expression()
                    self.take("AS")
                    q.items.append((e, self.take()[1:]))
                    self.take(")")
                else:
                    break
            if not q.items:
                raise SparqlError("SELECT names no variable")
        self.accept("WHERE")
        q.where = self.group()
        if self.accept("GROUP"):
            self.take("BY")
            while self.peek()[0] == "var" or self.has("(") or self.peek(1)[1] == "(" and not self.has("HAVING", "ORDER"):
                if self.accept("("):
                    e = self.expression()
                    name = self.take()[1:] if self.accept("AS") else None
                    self.take(")")
                    q.group.append((e, name))
                else:
                    e = self.primary()
                    q.group.append((e, e.name if isinstance(e, Var) else None))
        if self.accept("HAVING"):
            while self.has("(") or self.peek()[0] == "word" and self.peek(1)[1] == "(":
                q.having.append(self.primary())
        if self.accept("ORDER"):
            self.take("BY")
            while self.has("ASC", "DESC", "(") or self.peek()[0] == "var" or self.peek()[0] == "word" and self.peek(1)[1] == "(":
                down = self.has("DESC")
                if self.has("ASC", "DESC"):
                    self.take()
                q.order.append((self.primary(), not down))
        while self.has("LIMIT", "OFFSET"):
            which, n = self.take().upper(), int(self.take())
            if which == "LIMIT":
                q.limit = n
            else:
                q.offset = n
        return q

    def group(self) -> tuple:
        self.take("{")
        if self.has("SELECT"):
            inner = self.select()
            self.take("}")
            return ("group", [("select", inner)])
        parts: list[tuple] = []
        while not self.accept("}"):
            if self.accept("."):
                continue
            if self.accept("OPTIONAL"):
                parts.append(("optional", self.group()))
            elif self.accept("MINUS"):
                parts.append(("minus", self.group()))
            elif self.accept("FILTER"):
                if self.has("EXISTS", "NOT") and not (self.has("NOT") and self.peek(1)[1].upper() != "EXISTS"):
                    negated = self.accept("NOT")
                    self.take("EXISTS")
                    parts.append(("exists", self.group(), negated))
                else:
                    parts.append(("filter", self.primary()))
            elif self.accept("BIND"):
                self.take("(")
                e = self.expression()
                self.take("AS")
                parts.append(("bind", e, self.take()[1:]))
                self.take(")")
            elif self.accept("VALUES"):
                parts.append(self.values())
            elif self.has("{"):
                branches = [self.group()]
                while self.accept("UNION"):
                    branches.append(self.group())
                parts.append(("union", branches) if len(branches) > 1 else branches[0])
            else:
                self.triples(parts)
        return ("group", parts)

    def values(self) -> tuple:
        many = self.accept("(")
        names = []
        while self.peek()[0] == "var":
            names.append(self.take()[1:])
            if not many:
                break
        if many:
            self.take(")")
        self.take("{")
        rows = []
        one = lambda: None if self.accept("UNDEF") else self.term().text
        while not self.accept("}"):
            if many:
                self.take("(")
                rows.append([one() for _ in names])
                self.take(")")
            else:
                rows.append([one()])
        return ("values", names, rows)

    def fresh(self) -> Var:
        self.blank += 1
        return Var(f"__b{self.blank}")

    def triples(self, parts: list) -> None:
        subject = self.node(parts)
        self.properties(subject, parts)

    def properties(self, subject, parts: list) -> None:
        while True:
            path = Var(self.take()[1:]) if self.peek()[0] == "var" else self.path()
            while True:
                parts.append(("triple", subject, path, self.node(parts)))
                if not self.accept(","):
                    break
            while self.accept(";"):
                pass
            if self.has(".", "}", "]") or self.peek()[0] == "end" or self.has("FILTER", "OPTIONAL", "BIND", "UNION", "MINUS", "VALUES", "{"):
                return
            if self.tokens[self.at - 1][1] != ";":
                raise SparqlError(f"unexpected {self.peek()[1]}")

    def node(self, parts: list):
        if self.accept("["):
            v = self.fresh()
            if not self.has("]"):
                self.properties(v, parts)
            self.take("]")
            return v
        if self.peek()[0] == "blank":
            return Var("__" + self.take()[2:])
        return Var(self.take()[1:]) if self.peek()[0] == "var" else self.term()

    def path(self) -> tuple:
        branches = [self.sequence()]
        while self.accept("|"):
            branches.append(self.sequence())
        return ("alt", branches) if len(branches) > 1 else branches[0]

    def sequence(self) -> tuple:
        steps = [self.step()]
        while self.accept("/"):
            steps.append(self.step())
        return ("seq", steps) if len(steps) > 1 else steps[0]

    def step(self) -> tuple:
        if self.accept("^"):
            return ("inv", self.step())
        if self.accept("("):
            out = self.path()
            self.take(")")
        else:
            out = ("p", f"<{RDF}type>" if self.has("A") and self.take() else self.term().text)
        while self.has("*", "+", "?"):
            out = ("close", out, self.take())
        return out

    def term(self) -> Term:
        kind, text = self.peek()
        self.at += 1
        if kind == "iri":
            return Term(f"<{self.resolve(text)}>")
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix}:")
            return Term("<" + self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local) + ">")
        if kind == "string":
            quote = 3 if text[:3] in ('"""', "'''") else 1
            value = '"' + unescape(text[quote:-quote]) + '"'
            if self.peek()[0] == "lang":
                value += self.take().lower()
            elif self.peek()[1] == "^^":
                self.take()
                value += "^^" + self.term().text
            return Term(value)
        if kind == "number":
            return Term(f'"{text}"^^<{XSD}{"integer" if text.isdigit() else "double" if "e" in text.lower() else "decimal"}>')
        if kind == "word" and text.lower() in ("true", "false"):
            return Term(f'"{text.lower()}"^^<{XSD}boolean>')
        raise SparqlError(f"unexpected {text or 'end'}")

    def expression(self, level: int = 0):
        levels = [("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">=", "IN", "NOT"), ("+", "-"), ("*", "/")]
        if level == len(levels):
            return self.unary()
        left = self.expression(level + 1)
        while self.has(*levels[level]):
            op = self.take().upper()
            if op in ("IN", "NOT"):
                negated = op == "NOT" and self.take("IN") != ""
                self.take("(")
                options = []
                while not self.accept(")"):
                    options.append(self.expression())
                    self.accept(",")
                left = ("in", left, options, negated)
            else:
                left = ("op", op, left, self.expression(level + 1))
        return left

    def unary(self):
        if self.accept("!"):
            return ("not", self.unary())
        if self.accept("-"):
            return ("op", "-", Term(f'"0"^^<{XSD}integer>'), self.unary())
        return self.primary()

    def primary(self):
        if self.accept("("):
            e = self.expression()
            self.take(")")
            return e
        kind, text = self.peek()
        if kind == "var":
            return Var(self.take()[1:])
        if kind == "word" and text.lower() not in ("true", "false"):
            name = self.take().upper()
            if name in ("EXISTS", "NOT") and (name == "EXISTS" or self.take("EXISTS")):
                raise SparqlError("EXISTS stands alone in FILTER here")
            self.take("(")
            if name in AGGREGATES:
                distinct = self.accept("DISTINCT")
                arg = None if self.accept("*") else self.expression()
                separator = " "
                if self.accept(";"):
                    self.take("SEPARATOR")
                    self.take("=")
                    separator = self.term().text[1:-1]
                self.take(")")
                return ("agg", name, arg, distinct, separator)
            args = []
            while not self.accept(")"):
                args.append(self.expression())
                self.accept(",")
            return ("call", name, args)
        term = self.term()
        if term.text.startswith("<") and self.accept("("):
            args = [self.expression()]
            self.take(")")
            return ("call", term.text[1:-1], args)
        return term


def parse(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, prefixes).query()

"""Recovering element IRIs from a query that only counts or names them: its text is rewritten to select subjects.

The rewrite works on text, as its results are compared as text: driving variables are the arguments of COUNT, then plain
variables; each is replaced by the variables that stand before it in a whole triple pattern of the WHERE block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .syntax import SparqlError

FORM = re.compile(r"\b(SELECT|ASK|CONSTRUCT|DESCRIBE)\b", re.I)
HEAD = re.compile(r"^\s*SELECT\s+(DISTINCT\s+|REDUCED\s+)?(.*)$", re.I | re.S)
COUNT = re.compile(r"\(?\s*COUNT\s*\(\s*(?:DISTINCT\s+)?\?(\w+)\s*\)\s*(?:AS\s+\?(\w+)\s*\))?", re.I)
ORDER = r"ORDER\s+BY"
TAIL = {k: re.compile(rf"\b{k}\b(.*?)(?=\b(?:GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT|OFFSET)\b|$)", re.I | re.S) for k in ("HAVING", ORDER, "LIMIT", "OFFSET")}


@dataclass(frozen=True)
class Parts:
    header: str
    select: str
    where: str
    tail: str


def split(text: str) -> Parts:
    """Prologue, select line, WHERE block by its braces, and the rest; the word WHERE must be there."""
    form = FORM.search(text)
    where = form and re.compile(r"\bWHERE\b\s*\{", re.I).search(text, form.end())
    if not form or form[0].upper() != "SELECT" or not where:
        raise SparqlError("rewrite_error: no SELECT with WHERE")
    depth, end = 0, None
    for k in range(where.end() - 1, len(text)):
        depth += {"{": 1, "}": -1}.get(text[k], 0)
        if not depth:
            end = k + 1
            break
    if end is None:
        raise SparqlError("rewrite_error: unbalanced braces")
    return Parts(text[: form.start()], text[form.start() : where.start()], text[where.end() - 1 : end], text[end:])


def driving(select: str) -> tuple[list[tuple[str, str | None]], list[str]]:
    """([(counted variable, alias)], plain variables)."""
    body = HEAD.match(select)[2]
    counted = [(m[1], m[2]) for m in COUNT.finditer(body)]
    depth, flat = 0, ""
    for c in body:
        depth += c == "("
        if not depth:
            flat += c
        depth -= c == ")"
    names = {v for v, _ in counted}
    return counted, [v for v in dict.fromkeys(re.findall(r"\?(\w+)", flat)) if v not in names]


def subjects(where: str, variable: str) -> list[str]:
    """Variables s of whole patterns ?s <path> ?variable with a closing dot."""
    return list(dict.fromkeys(m[1] for m in re.finditer(rf"\?(\w+)\s+\S+\s+\?{variable}\s*\.", where)))


def substitute(text: str, by: dict[str, str]) -> str:
    """Whole variables only, the longest name first."""
    if not by:
        return text
    names = "|".join(sorted(map(re.escape, by), key=len, reverse=True))
    return re.sub(rf"\?({names})\b", lambda m: "?" + by[m[1]], text)


def recovered(text: str) -> str:
    """The recovery query. A copied HAVING may name an alias that is gone: then the query is an error when it is run."""
    parts = split(text)
    counted, plain = driving(parts.select)
    if not counted and not plain:
        raise SparqlError("rewrite_error: no variables")
    chosen: list[str] = []
    by: dict[str, str] = {}
    for v, alias in counted:
        own = subjects(parts.where, v) or [v]
        chosen += own
        by |= {v: own[0]} | ({alias: own[0]} if alias else {})
    for v in plain:
        if own := subjects(parts.where, v):
            chosen += own
            by[v] = own[0]
    chosen = list(dict.fromkeys(chosen))
    if not chosen:
        raise SparqlError("rewrite_error: no subjects")
    tail = {k: m[1].strip() for k, p in TAIL.items() if (m := p.search(parts.tail))}
    distinct = HEAD.match(parts.select)[1] or ""
    names = " ".join(f"?{v}" for v in chosen)
    out = f"{parts.header}SELECT {distinct}{names} WHERE {parts.where}"
    if re.search(r"\bGROUP\s+BY\b", parts.tail, re.I):
        out += f" GROUP BY {names}"
    if "HAVING" in tail:
        out += f" HAVING {tail['HAVING']}"
    if ORDER in tail:
        out += f" ORDER BY {substitute(tail[ORDER], by)}"
    return out + "".join(f" {k} {tail[k]}" for k in ("LIMIT", "OFFSET") if k in tail)


def canonical_header(text: str, header: str) -> str:
    """Leading BASE and PREFIX lines are dropped and the given header put first; an empty header leaves the text."""
    return text if not header else header.rstrip() + "\n" + re.sub(r"(?im)^\s*(?:BASE|PREFIX)\b[^\n]*\n", "", text).lstrip()


def decoded(text: str) -> str:
    """Outer quotes off; \\n and \\t as written escapes become characters if the text has no line of its own."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'`":
        text = text[1:-1]
    return text if "\n" in text else text.replace("\\n", "\n").replace("\\t", "\t").replace('\\"', '"')


def pretty(text: str) -> str:
    """One clause and one pattern a line, indented by braces."""
    flat = re.sub(r"\s+", " ", decoded(text))
    flat = re.sub(r"\s*([{}])\s*", r"\n\1\n", flat)
    flat = re.sub(r" (\.) ?(?=\S)", r" \1\n", flat)
    flat = re.sub(r" (?=(?:WHERE|GROUP BY|HAVING|ORDER BY|LIMIT|OFFSET|FILTER|OPTIONAL)\b)", "\n", flat, flags=re.I)
    depth, out = 0, []
    for line in filter(None, map(str.strip, flat.split("\n"))):
        depth -= line == "}"
        out.append("  " * depth + line)
        depth += line == "{"
    return "\n".join(out)

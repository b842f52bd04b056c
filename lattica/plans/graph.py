"""Graphs that the planner reads: tables whose columns are predicates, one relation a predicate, or a table of triples."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A frame(s, o), or a function that makes it: then a query that does not name the predicate does not even open the table.
Relation = DataFrame | Callable[[], DataFrame]


@dataclass(frozen=True)
class Field:
    """Terms of a column: `before`, its text, `after`; without a column, the constant before + after. `text` makes the text
    if it is not the value as Spark casts it."""

    column: str | None
    before: str = '"'
    after: str = '"'
    text: Callable[[Column], Column] | None = None

    def term(self) -> Column:
        if self.column is None:
            return F.lit(self.before + self.after)
        c = F.col(self.column)
        return F.concat(F.lit(self.before), self.text(c) if self.text else c.cast("string"), F.lit(self.after))

    def present(self) -> Column:
        return F.lit(True) if self.column is None else F.col(self.column).isNotNull()

    def equals(self, term: str, frame: DataFrame) -> Column:
        """Whether the term is this one: on the plain column if that says as much, so that the scan can filter."""
        if self.column is None:
            return F.lit(self.before + self.after == term)
        if len(term) < len(self.before + self.after) or not (term.startswith(self.before) and term.endswith(self.after)):
            return F.lit(False)
        value = term[len(self.before) : len(term) - len(self.after)]
        if self.text:
            return self.term() == term
        if isinstance(frame.schema[self.column].dataType, IntegralType):
            number = value.removeprefix("-")
            return F.col(self.column) == int(value) if number.isdecimal() and number.isascii() and str(int(value)) == value else F.lit(False)
        return F.col(self.column).cast("string") == value


@dataclass(frozen=True)
class Table:
    """A table with a subject a row; no subject has two rows in it. Subjects of different kinds are different terms."""

    kind: str
    frame: Callable[[], DataFrame]
    subject: Field
    fields: dict[str, Field]

    def relation(self, p: str) -> DataFrame:
        own = self.fields[p]
        return self.frame().where(self.subject.present() & own.present()).select(self.subject.term().alias("s"), own.term().alias("o"))

    def triples(self) -> DataFrame:
        """All columns molten to triples, in one scan."""
        each = F.array(*(F.struct(F.lit(p).alias("p"), F.when(f.present(), f.term()).alias("o")) for p, f in self.fields.items()))
        rows = self.frame().where(self.subject.present()).select(self.subject.term().alias("s"), F.inline(each))
        return rows.where("o IS NOT NULL").select("s", "p", "o")

    def star(self, arms: list[tuple[str, str, str | None]]) -> DataFrame:
        """s and a column for each of arms (predicate, name, wanted term or None), of rows that have them all."""
        frame = self.frame()
        rows = frame.where(self.subject.present())
        for p, _, wanted in arms:
            rows = rows.where(self.fields[p].present() if wanted is None else self.fields[p].equals(wanted, frame))
        return rows.select(self.subject.term().alias("s"), *(self.fields[p].term().alias(name) for p, name, _ in arms))


class Graph:
    """Triples as frames, of which a query reads only what it names.

    tables: columns as predicates; patterns that share a subject become one projection of a table, a pattern with any predicate
    one scan of each table. relations: predicate term -> frame(s, o). triples: frame(s, p, o), for which single_valued names
    predicates with one object a subject at most; patterns on them that share a subject become one grouped scan.
    """

    def __init__(self, relations: dict[str, Relation] | None = None, triples: DataFrame | None = None, single_valued: set[str] = frozenset(), tables: Iterable[Table] = ()):
        self.own, self.table, self.single_valued, self.tables = relations or {}, triples, set(single_valued), list(tables)
        if (triples is None) == (relations is None and not self.tables):
            raise ValueError("give relations and tables, or triples")

    @property
    def relations(self) -> dict[str, Relation]:
        """All predicates' relations."""
        names = dict.fromkeys(p for t in self.tables for p in t.fields)
        return {p: (lambda p=p: self.relation(p)) for p in names} | self.own

    def only(self, predicates: Iterable[str]) -> Graph:
        """The graph of these predicates."""
        wanted = set(predicates)
        tables = [replace(t, fields={p: f for p, f in t.fields.items() if p in wanted}) for t in self.tables]
        return Graph({p: r for p, r in self.own.items() if p in wanted}, tables=[t for t in tables if t.fields])

    def relation(self, p: str) -> DataFrame:
        if self.table is not None:
            return self.table.where(F.col("p") == p).select("s", "o")
        rows = [t.relation(p) for t in self.tables if p in t.fields]
        if p in self.own:
            got = self.own[p]
            rows.append((got if isinstance(got, DataFrame) else got()).select("s", "o"))
        return reduce(DataFrame.unionByName, rows) if rows else self.relation(next(iter(self.relations))).limit(0)

    def triples(self) -> DataFrame:
        if self.table is not None:
            return self.table.select("s", "p", "o")
        rows = [t.triples() for t in self.tables]
        rows += [(r if isinstance(r, DataFrame) else r()).select("s", F.lit(p).alias("p"), "o") for p, r in self.own.items()]
        return reduce(DataFrame.unionByName, rows)

    def nodes(self) -> DataFrame:
        """All subjects and objects."""
        return self.triples().select(F.explode(F.array("s", "o")).alias("n")).distinct()

    def in_stars(self, p: str) -> bool:
        """Whether patterns on p that share a subject can be one scan: in each kind one table has p, and nothing else does."""
        if self.table is not None:
            return p in self.single_valued
        kinds = [t.kind for t in self.tables if p in t.fields]
        return bool(kinds) and len(kinds) == len(set(kinds)) and p not in self.own

    def star(self, arms: list[tuple[str, str, str | None]]) -> DataFrame:
        """s and a column for each of arms (predicate, name, wanted term or None), of the subjects that have them all."""
        if self.table is not None:
            rows = self.table.where(F.col("p").isin([p for p, _, _ in arms])).groupBy("s").agg(*(F.max(F.when(F.col("p") == p, F.col("o"))).alias(name) for p, name, _ in arms))
            return rows.where(reduce(lambda a, b: a & b, (F.col(name).isNotNull() if wanted is None else F.col(name) == wanted for _, name, wanted in arms)))
        found = []
        for kind in dict.fromkeys(t.kind for t in self.tables):
            tables = [t for t in self.tables if t.kind == kind]
            if all(any(p in t.fields for t in tables) for p, _, _ in arms):
                parts = [t.star(own) for t in tables if (own := [a for a in arms if a[0] in t.fields])]
                found.append(reduce(lambda a, b: a.join(b, "s"), parts).select("s", *(name for _, name, _ in arms)))
        if not found:
            return self.relation(arms[0][0]).limit(0).select("s", *(F.col("o").alias(name) for _, name, _ in arms))
        return reduce(DataFrame.unionByName, found)

"""SPARQL trees to DataFrames.

A solution sequence is a frame with a column of terms for each variable. `sure` holds the variables bound in every row:
joins on these are plain equi-joins. On others SPARQL compatibility (either side unbound, or equal) is needed: rows are told
apart by what they bind, so these are equi-joins, too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..operators.closure import closure, reachable
from .graph import Graph
from .syntax import Query, SparqlError, Term, Var, parse


@dataclass
class Value:
    """An expression's result: its term, and the plain Spark column if it is a number, text or truth value."""

    term: Column
    plain: Column | None = None
    kind: str = "term"

    @property
    def text(self) -> Column:
        return self.plain.cast("string") if self.plain is not None else T.lexical(self.term)

    @property
    def number(self) -> Column:
        return self.plain.cast("double") if self.kind == "number" else F.when(T.is_numeric(self.term), T.lexical(self.term).try_cast("double"))

    @property
    def truth(self) -> Column:
        if self.kind == "bool":
            return self.plain
        lex, n = self.text, self.number
        return F.when(T.is_iri(self.term) | T.is_blank(self.term), F.lit(None).cast("boolean")).when(T.datatype(self.term) == T.XSD + "boolean", lex == "true").when(n.isNotNull(), n != 0).otherwise(lex != "")


def number(c: Column, whole: bool = False) -> Value:
    return Value(T.literal(c.cast("string"), datatype=T.XSD + ("integer" if whole else "double")), c, "number")


def text(c: Column) -> Value:
    return Value(T.literal(c), c, "text")


def boolean(c: Column) -> Value:
    return Value(T.literal(c.cast("string"), datatype=T.XSD + "boolean"), c, "bool")


@dataclass
class Rows:
    df: DataFrame
    sure: set[str]
    maybe: set[str]

    @property
    def names(self) -> set[str]:
        return self.sure | self.maybe


#: Where all of a join's keys may be unbound: parts that each key is dealt to, and the join's tasks.
SALTS, TASKS = 32, 64


@dataclass
class Frame:
    """Rows of a join's right side that bind the same of the shared variables; `own` are columns that the left side needs for the
    condition `on`; dealt: each key is dealt to SALTS parts."""

    right: DataFrame
    on: Column
    own: dict[str, Column]
    dealt: bool = False

    def left(self, df: DataFrame) -> DataFrame:
        return df.select("*", *(c.alias(name) for name, c in self.own.items()))

    def keep(self, df: DataFrame, how: str) -> DataFrame:
        """Left semi or anti join."""
        return self.left(df).join(self.right, self.on, how).drop(*self.own)


def texts(df: DataFrame, names: set[str]) -> DataFrame:
    """The frame with the texts of these terms."""
    return df.select(*(T.lexical(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns))


class Planner:
    def __init__(self, graph: Graph, spark: SparkSession):
        self.graph, self.spark, self.kinds = graph, spark, {}
        #: Variables bound in every row of the last `solve`.
        self.certain: set[str] = set()
        #: Whether the last `solve` gave texts in place of terms.
        self.plain = False

    # --- expressions -------------------------------------------------------------------------------------------

    def value(self, e, df: DataFrame) -> Value:
        if isinstance(e, Var):
            if e.name not in df.columns:
                return Value(F.lit(None).cast("string"))
            c = F.col(f"`{e.name}`")
            kind = self.kinds.get(e.name)
            return Value(c) if kind is None else Value(c, T.lexical(c).cast(kind), "number")
        if isinstance(e, Term):
            return Value(F.lit(e.text))
        kind = e[0]
        if kind == "not":
            return boolean(~self.value(e[1], df).truth)
        if kind == "in":
            own = self.value(e[1], df)
            found = reduce(lambda a, b: a | b, (self.equal(own, self.value(o, df)) for o in e[2]), F.lit(False))
            return boolean(~found if e[3] else found)
        if kind == "op":
            return self.operation(e[1], self.value(e[2], df) if e[1] not in ("&&", "||") else e[2], self.value(e[3], df) if e[1] not in ("&&", "||") else e[3], df)
        if kind == "call":
            return self.call(e[1], e[2], df)
        raise SparqlError("an aggregate may not stand here")

    @staticmethod
    def equal(a: Value, b: Value) -> Column:
        """By value for numbers, else by term: "x" and "x"@en differ."""
        left, right = a.number, b.number
        return F.when(left.isNotNull() & right.isNotNull(), left == right).otherwise(a.term == b.term)

    def operation(self, op: str, a, b, df: DataFrame) -> Value:
        if op in ("&&", "||"):
            x, y = self.value(a, df).truth, self.value(b, df).truth
            return boolean(x & y if op == "&&" else x | y)
        if op in ("=", "!="):
            return boolean(self.equal(a, b) if op == "=" else ~self.equal(a, b))
        if op in ("<", ">", "<=", ">="):
            pick = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
            numeric = a.number.isNotNull() & b.number.isNotNull()
            same = (T.datatype(a.term) == T.datatype(b.term)) & ~T.is_numeric(a.term)
            return boolean(F.when(numeric, pick(a.number, b.number)).when(same, pick(a.text, b.text)))
        x, y = a.number, b.number
        out = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]
        return number(out)

    def call(self, name: str, args: list, df: DataFrame) -> Value:
        if name == "COALESCE":
            vs = [self.value(a, df) for a in args]
            return Value(F.coalesce(*(v.term for v in vs)))
        if name == "BOUND":
            return boolean(self.value(args[0], df).term.isNotNull())
        if name == "IF":
            c, a, b = (self.value(x, df) for x in args)
            return Value(F.when(c.truth, a.term).when(~c.truth, b.term))
        v = [self.value(a, df) for a in args]
        t = [x.text for x in v]
        if name == "REGEX":
            flags = self.constant(args[2]) if len(args) > 2 else ""
            return boolean(t[0].rlike(self.regex(f"(?{flags})" if flags else "", args[1])))
        if name == "REPLACE":
            return text(F.regexp_replace(t[0], self.regex("", args[1]), self.constant(args[2])))
        of_term = {"ISLITERAL": T.is_literal, "ISIRI": T.is_iri, "ISURI": T.is_iri, "ISBLANK": T.is_blank, "ISNUMERIC": T.is_numeric}
        if name in of_term:
            return boolean(of_term[name](v[0].term))
        if name == "DATATYPE":
            return Value(T.iri(T.datatype(v[0].term)))
        if name in ("IRI", "URI"):
            return Value(T.iri(t[0]))
        if name == "SAMETERM":
            return boolean(v[0].term == v[1].term)
        two = {"CONTAINS": lambda: t[0].contains(t[1]), "STRSTARTS": lambda: t[0].startswith(t[1]), "STRENDS": lambda: t[0].endswith(t[1]), "LANGMATCHES": lambda: (F.lower(t[0]) == F.lower(t[1])) | (t[1] == "*") & (t[0] != "") | F.lower(t[0]).startswith(F.concat(F.lower(t[1]), F.lit("-")))}
        if name in two:
            return boolean(two[name]())
        as_text = {
            "STR": lambda: t[0], "LCASE": lambda: F.lower(t[0]), "UCASE": lambda: F.upper(t[0]), "LANG": lambda: T.lang(v[0].term), "CONCAT": lambda: F.concat(*t),
            "SUBSTR": lambda: t[0].substr(v[1].number.cast("int"), v[2].number.cast("int") if len(v) > 2 else F.length(t[0])),
            "STRBEFORE": lambda: F.when(t[0].contains(t[1]), F.substring_index(t[0], self.constant(args[1]), 1)).otherwise(""),
            "STRAFTER": lambda: F.when(t[0].contains(t[1]), t[0].substr(F.locate(self.constant(args[1]), t[0]) + F.length(t[1]), F.length(t[0]))).otherwise(""),
            "ENCODE_FOR_URI": lambda: F.replace(F.replace(F.url_encode(t[0]), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")),
        }
        if name in as_text:
            return text(as_text[name]())
        when = lambda: F.try_to_timestamp(t[0])
        as_number = {
            "STRLEN": (lambda: F.length(t[0]), True), "ABS": (lambda: F.abs(v[0].number), False), "CEIL": (lambda: F.ceil(v[0].number), False), "FLOOR": (lambda: F.floor(v[0].number), False), "ROUND": (lambda: F.floor(v[0].number + 0.5), False),
            "YEAR": (lambda: F.year(when()), True), "MONTH": (lambda: F.month(when()), True), "DAY": (lambda: F.dayofmonth(when()), True), "HOURS": (lambda: F.hour(when()), True), "MINUTES": (lambda: F.minute(when()), True),
            T.XSD + "integer": (lambda: t[0].try_cast("double").cast("long"), True), T.XSD + "double": (lambda: t[0].try_cast("double"), False), T.XSD + "decimal": (lambda: t[0].try_cast("double"), False), T.XSD + "float": (lambda: t[0].try_cast("double"), False),
        }
        if name in as_number:
            make, whole = as_number[name]
            return number(make(), whole)
        if name == T.XSD + "string":
            return text(t[0])
        if name in (T.XSD + "dateTime", T.XSD + "boolean"):
            return Value(F.concat(F.lit('"'), t[0], F.lit(f'"^^<{name}>')))
        raise SparqlError(f"unknown function {name}")

    def regex(self, flags: str, e) -> str:
        """A constant pattern, refused here if it is none: else each row would fail."""
        pattern = flags + self.constant(e)
        try:
            self.spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Py4JJavaError as error:
            raise SparqlError(f"bad pattern {pattern!r}") from error
        return pattern

    @staticmethod
    def constant(e) -> str:
        if not isinstance(e, Term):
            raise SparqlError("a pattern must be a constant")
        return e.text[1 : e.text.rindex('"')]

    # --- patterns ----------------------------------------------------------------------------------------------

    def pattern(self, s, p, o) -> Rows:
        """One triple pattern or path, as a frame of its variables."""
        if isinstance(p, Var):
            df, ends = self.graph.triples(), {"s": s, "p": p, "o": o}
        else:
            df, ends = self.path(p, s, o), {"s": s, "o": o}
        names: dict[str, str] = {}
        for c, e in ends.items():
            if isinstance(e, Term):
                df = df.where(F.col(c) == e.text)
            elif e.name in names:
                df = df.where(F.col(c) == F.col(names[e.name]))
            else:
                names[e.name] = c
        return Rows(df.select(*(F.col(c).alias(n) for n, c in names.items())) if names else df.select(F.lit(1).alias("__one")), set(names), set())

    def path(self, p: tuple, start=None, end=None) -> DataFrame:
        """Pairs (s, o) of a path. Sequences and alternatives keep duplicates; *, + and ? give sets. Of + and * from a
        constant start, or to a constant end, only what is reached from there is searched for."""
        kind = p[0]
        if kind == "p":
            return self.graph.relation(p[1])
        if kind == "inv":
            return self.path(p[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "alt":
            return reduce(DataFrame.unionByName, map(self.path, p[1]))
        if kind == "seq":
            return reduce(lambda a, b: a.withColumnRenamed("o", "__m").join(b.select(F.col("s").alias("__m"), "o"), "__m").select("s", "o"), map(self.path, p[1]))
        inner, sign = self.path(p[1]), p[2]
        if sign != "?" and (isinstance(start, Term) or isinstance(end, Term)):
            pairs = self.reached(inner, start, end)
        else:
            pairs = inner.distinct() if sign == "?" else closure(inner)
        if sign == "+":
            return pairs
        same = self.graph.nodes().select(F.col("n").alias("s"), F.col("n").alias("o"))
        return pairs.union(same).distinct()

    def reached(self, edges: DataFrame, start, end) -> DataFrame:
        """Pairs of the closure of edges that begin at the constant start, else end at the constant end."""
        forward = isinstance(start, Term)
        seed = self.spark.createDataFrame([((start if forward else end).text,)], "s string")
        if forward:
            return reachable(edges, seed)
        back = reachable(edges.select(F.col("o").alias("s"), F.col("s").alias("o")), seed)
        return back.select(F.col("o").alias("s"), F.col("s").alias("o"))

    @staticmethod
    def compatible(a: Rows, b: Rows, shared: list[str], apart: bool = False, plain: bool = False) -> list[Frame]:
        """Frames of b's rows, one for each set of shared variables that they bind, and how each is joined to a's rows.

        Terms are compatible if they are equal or one is unbound. Rows of b that bind the same of their loose variables are
        joined on those, a's loose ones among them by a number that says which a row binds: a row of b then stands there
        once for each such number, with the unbound terms empty. So each frame is an equi-join, and a pair of rows meets in
        one of them once. apart: at least one variable must be bound on both sides. plain: b's texts, not its terms.

        If all of the keys may be unbound, rows of a that bind none meet every row, and few values may have most rows. So
        that no key is one task's, each row of b then stands there for SALTS parts, and a's rows are dealt to these.
        """
        out = []
        loose = [c for c in shared if c not in b.sure]
        for bound in (set(c for k, c in enumerate(loose) if n >> k & 1) for n in reversed(range(1 << len(loose)))):
            rows = b.df
            for c in loose:
                rows = rows.where(F.col(f"`{c}`").isNotNull() if c in bound else F.col(f"`{c}`").isNull())
            keys = [c for c in shared if c in b.sure or c in bound]
            maybe = [c for c in keys if c not in a.sure]
            if apart and not keys:
                continue
            right = rows.select(*(F.col(f"`{c}`").alias(f"__r_{c}") if c in shared else F.col(f"`{c}`") for c in b.df.columns if c in b.names or c == "__one"))
            on, own, dealt = F.lit(True), {}, bool(maybe) and len(maybe) == len(keys)
            for c in keys:
                if c not in maybe:
                    on = on & (F.col(f"`{c}`") == F.col(f"`__r_{c}`"))
            if maybe:
                least = 1 if apart and dealt else 0
                right = right.select("*", F.explode(F.sequence(F.lit(least), F.lit((1 << len(maybe)) - 1))).alias("__r_binds"))
                right = right.select("*", *(F.when(F.col("__r_binds").bitwiseAND(F.lit(1 << k)) != 0, F.col(f"`__r_{c}`")).otherwise("").alias(f"__r_key_{c}") for k, c in enumerate(maybe)))
                own["__r_own_binds"] = sum((F.when(F.col(f"`{c}`").isNotNull(), 1 << k).otherwise(0) for k, c in enumerate(maybe)), F.lit(0))
                own |= {f"__r_own_key_{c}": F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in maybe}
            if plain:
                right = texts(right, {f"__r_{c}" if c in shared else c for c in b.names})
            if dealt:
                right = right.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__r_salt"))
                own["__r_own_salt"] = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in sorted(a.names))), F.lit(SALTS))
            for c in own:
                on = on & (F.col(f"`{c}`") == F.col(f"`{c.replace('__r_own_', '__r_', 1)}`"))
            out.append(Frame(right, on, own, dealt))
        return out

    def join(self, a: Rows, b: Rows, how: str = "inner", condition=None, last: bool = False) -> Rows:
        """SPARQL join of two frames; how is inner or left. condition(left, right) -> Column belongs to the join.

        last: nothing but a choice of variables comes after it. If it may pair most rows of both sides, it then gives texts:
        these are made once a row of either side, not once a pair."""
        shared = sorted(a.names & b.names)
        left = a.df.select(*(F.col(f"`{c}`") for c in a.df.columns if c in a.names or c == "__one"))
        sure = a.sure | b.sure if how == "inner" else set(a.sure)
        names = a.names | b.names

        def merged(df: DataFrame) -> DataFrame:
            both = lambda c: F.coalesce(F.col(f"`{c}`"), F.col(f"`__r_{c}`")).alias(c) if c in shared and c not in a.sure else F.col(f"`{c}`")
            return df.select(*(both(c) for c in df.columns if not c.startswith("__r_") and c != "__one"), *([F.lit(1).alias("__one")] if not names else []))

        if not shared and how == "inner" and condition is None:
            # Nothing in common: every row goes with every other, that is what the query asks for.
            return Rows(merged(left.drop("__one").crossJoin(b.df.select(*(F.col(f"`{c}`") for c in b.df.columns if c in b.names)))) if names else Rows(left, set(), set()).df, sure, names - sure)
        self.plain = last and bool(shared) and condition is None and not a.sure & set(shared)
        plain = (lambda df: texts(df, a.names)) if self.plain else lambda df: df
        frames = self.compatible(a, b, shared, plain=self.plain)
        for f in frames:
            f.right = f.right.drop("__one")
            if condition is not None:
                # Within the condition the right side's variables are visible; shared ones are equal anyway.
                f.on = f.on & condition(left, f.right)

        def joined(f: Frame, how: str) -> DataFrame:
            own = plain(f.left(left))
            if f.dealt:
                # By number: the rows are few and short, the pairs are not, so tasks must not be merged by their input's size.
                own = own.repartition(TASKS, *f.own)
            return merged(own.join(f.right, f.on, how))

        if how == "inner" or len(frames) == 1:
            parts = [joined(f, how) for f in frames]
        else:
            parts = [joined(f, "inner") for f in frames]
            alone = plain(reduce(lambda df, f: f.keep(df, "left_anti"), frames, left))
            parts.append(alone.drop("__one").select("*", *(F.lit(None).cast("string").alias(c) for c in b.names - a.names)))
        return Rows(reduce(DataFrame.unionByName, parts), sure, names - sure)

    def basic(self, triples: list[tuple], filters: list = ()) -> Rows:
        """Join of triple patterns. If a filter asks that a text of some of them begins or ends with one of the others, and these
        share no subject, that is a key of the join between the two; the filters themselves stay to be applied."""
        items = self.stars(list(triples))
        subjects = {s.name for s, _, _ in triples if isinstance(s, Var)}

        def side(v: str) -> tuple[list[int], set[str]]:
            """Items with v, and those that their subjects lead to."""
            own, names = [], {v}
            while more := [k for k, i in enumerate(items) if k not in own and i[0] & names & (subjects | {v})]:
                own += more
                names = names.union(*(items[k][0] for k in more))
            return own, names

        for kind, x, y in self.affixes(filters):
            (own, names), (other, more) = side(x), side(y)
            if own and other and sorted(own + other) == list(range(len(items))) and not names & more & subjects:
                return self.affixed(self.joined([items[k] for k in own]), self.joined([items[k] for k in other]), kind, x, y)
        return self.joined(items)

    def affixes(self, filters: list) -> list[tuple[str, str, str]]:
        """(function, x, y) of the filters that hold only if variable x's text begins or ends with y's."""

        def variable(e) -> str | None:
            e = e[2][0] if isinstance(e, tuple) and e[:2] == ("call", "STR") else e
            return e.name if isinstance(e, Var) and e.name not in self.kinds else None

        out = []
        for e in filters:
            if isinstance(e, tuple) and e[:2] == ("op", "&&"):
                out += self.affixes([e[2], e[3]])
            elif isinstance(e, tuple) and e[0] == "call" and e[1] in ("STRENDS", "STRSTARTS"):
                x, y = map(variable, e[2])
                out += [(e[1], x, y)] if x and y and x != y else []
        return out

    def affixed(self, a: Rows, b: Rows, kind: str, x: str, y: str) -> Rows:
        """Join of a and b where also x's text in a begins or ends with y's in b: of each text of a, the beginnings or ends of
        the lengths that occur in b are keys."""
        texts = b.df.withColumn("__text", T.lexical(F.col(f"`{y}`"))).withColumn("__length", F.length("__text"))
        lengths = F.broadcast(texts.select("__length").distinct())
        each = a.df.withColumn("__own", T.lexical(F.col(f"`{x}`")))
        each = each.withColumn("__length", F.explode(F.sequence(F.lit(0), F.length("__own")))).join(lengths, "__length", "left_semi")
        cut = F.right if kind == "STRENDS" else F.left
        each = each.withColumn("__affix", F.xxhash64(cut("__own", "__length"))).drop("__own")
        texts = texts.withColumn("__affix", F.xxhash64("__text")).drop("__text")
        keys = {"__length", "__affix"}
        rows = self.join(Rows(each, a.sure | keys, a.maybe), Rows(texts, b.sure | keys, b.maybe))
        return Rows(rows.df.drop(*keys), rows.sure - keys, rows.maybe)

    def joined(self, items: list[tuple]) -> Rows:
        """Join of patterns: most selective first, then always one that shares a variable, if any does."""
        left = list(items)
        bound: set[str] = set()
        rows: Rows | None = None
        while left:
            def cost(item) -> tuple:
                names, constants, has_path, _ = item
                return (bool(bound) and not names & bound, has_path, -constants, -len(names & bound))

            best = min(range(len(left)), key=lambda k: (cost(left[k]), k))
            names, _, _, make = left.pop(best)
            rows = make() if rows is None else self.join(rows, make())
            bound |= names
        return rows

    def stars(self, triples: list[tuple]) -> list[tuple]:
        """(variables, constants, is a closure, frame maker) of each pattern; single-valued stars are merged to one."""
        out, stars = [], {}
        for s, p, o in triples:
            if isinstance(s, Var) and isinstance(p, tuple) and p[0] == "p" and self.graph.in_stars(p[1]):
                stars.setdefault(s.name, []).append((p[1], o))
            else:
                names = {x.name for x in (s, p, o) if isinstance(x, Var)}
                out.append((names, sum(isinstance(x, Term) for x in (s, o)), isinstance(p, tuple) and p[0] == "close", lambda s=s, p=p, o=o: self.pattern(s, p, o)))
        for name, arms in stars.items():
            if len(arms) == 1 or len({p for p, _ in arms}) < len(arms):
                for p, o in arms:
                    out.append(({name} | ({o.name} if isinstance(o, Var) else set()), int(isinstance(o, Term)), False, lambda name=name, p=p, o=o: self.pattern(Var(name), ("p", p), o)))
            else:
                out.append(({name} | {o.name for _, o in arms if isinstance(o, Var)}, sum(isinstance(o, Term) for _, o in arms), False, lambda name=name, arms=arms: self.star(name, arms)))
        return out

    def star(self, subject: str, arms: list[tuple]) -> Rows:
        """Patterns on one subject over single-valued predicates as one scan."""
        wide = self.graph.star([(p, f"__a{k}", o.text if isinstance(o, Term) else None) for k, (p, o) in enumerate(arms)])
        names = {subject: "s"}
        for k, (_, o) in enumerate(arms):
            if isinstance(o, Var):
                if o.name in names:
                    wide = wide.where(F.col(f"__a{k}") == F.col(names[o.name]))
                else:
                    names[o.name] = f"__a{k}"
        return Rows(wide.select(*(F.col(c).alias(n) for n, c in names.items())), set(names), set())

    def evaluate(self, node: tuple, last: bool = False) -> Rows:
        """Rows of a pattern; last: nothing but a choice of variables comes after it (see `join`)."""
        kind = node[0]
        if kind == "union":
            return self.union([self.evaluate(b) for b in node[1]])
        if kind == "select":
            df, names = self.solve(node[1])
            sure = self.certain & names
            return Rows(df, sure, names - sure)
        if kind == "values":
            _, names, rows = node
            df = self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
            sure = {n for k, n in enumerate(names) if all(r[k] is not None for r in rows)}
            return Rows(df, sure, set(names) - sure)
        rows = None
        triples: list[tuple] = []
        filters = []
        last = last and not any(p[0] in ("filter", "exists") for p in node[1])

        def flush(rows, last=False):
            if triples:
                own = self.basic(triples, [p[1] for p in node[1] if p[0] == "filter"])
                triples.clear()
                rows = own if rows is None else self.join(rows, own, last=last)
            return rows

        for k, part in enumerate(node[1], 1):
            if part[0] == "triple":
                triples.append(part[1:])
                continue
            if part[0] == "filter":
                filters.append(part)
                continue
            if part[0] == "exists":
                filters.append(part)
                continue
            rows = flush(rows)
            if part[0] == "bind":
                rows = rows or self.unit()
                v = self.value(part[1], rows.df)
                rows = Rows(rows.df.withColumn(part[2], v.term), rows.sure, rows.maybe | {part[2]})
            elif part[0] == "optional":
                rows = self.optional(rows or self.unit(), part[1], last and k == len(node[1]))
            elif part[0] == "minus":
                rows = self.semi(rows or self.unit(), self.evaluate(part[1]), True)
            else:
                own = self.evaluate(part)
                rows = own if rows is None else self.join(rows, own, last=last and k == len(node[1]))
        rows = flush(rows, last) or self.unit()
        for part in filters:
            if part[0] == "filter":
                rows = Rows(rows.df.where(self.value(part[1], rows.df).truth), rows.sure, rows.maybe)
            else:
                rows = self.exists(rows, part[1], part[2])
        return rows

    def unit(self) -> Rows:
        return Rows(self.spark.range(1).select(F.lit(1).alias("__one")), set(), set())

    @staticmethod
    def union(branches: list[Rows]) -> Rows:
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (b.df for b in branches))
        names = set().union(*(b.names for b in branches))
        sure = set.intersection(*(b.sure for b in branches))
        return Rows(out, sure, names - sure)

    def split(self, group: tuple) -> tuple[tuple, list]:
        """A group without its own filters, and these: inside OPTIONAL and EXISTS they see the outer variables."""
        return ("group", [p for p in group[1] if p[0] != "filter"]), [p[1] for p in group[1] if p[0] == "filter"]

    def optional(self, rows: Rows, group: tuple, last: bool = False) -> Rows:
        inner, filters = self.split(group)
        own = self.evaluate(inner)
        return self.join(rows, own, "left", self.condition(filters) if filters else None, last)

    def condition(self, filters: list):
        def make(left: DataFrame, right: DataFrame) -> Column:
            # Variables of the right side carry a prefix if shared; expressions then read the left one.
            both = left.limit(0).crossJoin(right.limit(0))
            return reduce(lambda a, c: a & c, (self.value(f, both).truth for f in filters))

        return make

    def exists(self, rows: Rows, group: tuple, negated: bool) -> Rows:
        inner, filters = self.split(group)
        return self.semi(rows, self.evaluate(inner), negated, self.condition(filters) if filters else None, plain=True)

    def semi(self, a: Rows, b: Rows, negated: bool, condition=None, plain: bool = False) -> Rows:
        """EXISTS as a semi-join, NOT EXISTS and MINUS as an anti-join; MINUS keeps rows that have no bound variable in common."""
        shared = sorted(a.names & b.names)
        if not shared and not plain:
            return a
        frames = self.compatible(a, b, shared, apart=not plain)
        for f in frames:
            f.right = f.right.withColumnRenamed("__one", "__r_one")
            if condition is not None:
                f.on = f.on & condition(a.df, f.right)
        rest, found = a.df, []
        for k, f in enumerate(frames):
            if not negated:
                found.append(f.keep(rest, "left_semi"))
            if negated or k + 1 < len(frames):
                rest = f.keep(rest, "left_anti")
        return Rows(rest if negated else reduce(DataFrame.unionByName, found), a.sure, a.maybe)

    # --- solution modifiers ------------------------------------------------------------------------------------

    def aggregates(self, e, found: list) -> None:
        if isinstance(e, tuple):
            if e[0] == "agg":
                if e not in found:
                    found.append(e)
            else:
                for x in e:
                    for y in x if isinstance(x, list) else [x]:
                        self.aggregates(y, found)

    def aggregate(self, e: tuple, df: DataFrame) -> tuple[Column, str | None]:
        """(column, number type or None for a term) of an aggregate call."""
        _, name, arg, distinct, separator = e
        if arg is None:
            return F.count("*") if not distinct else F.count_distinct(*(F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns)), "long"
        v = self.value(arg, df)
        if name == "COUNT":
            return (F.count_distinct(v.term) if distinct else F.count(v.term)), "long"
        if name == "GROUP_CONCAT":
            gathered = F.collect_set(v.text) if distinct else F.collect_list(v.text)
            return T.literal(F.array_join(F.array_sort(gathered), separator)), None
        if name == "SAMPLE":
            return F.min(v.term), None
        if name in ("SUM", "AVG"):
            n = v.number
            total = (F.sum_distinct(n) if distinct else F.sum(n)) if name == "SUM" else F.avg(n)
            return F.coalesce(total, F.lit(0.0)), "double"
        pick = F.min if name == "MIN" else F.max
        n = v.number
        by = F.struct(n.isNotNull().alias("k"), n.alias("n"), v.text.alias("x"), v.term.alias("term"))
        return pick(F.when(v.term.isNotNull(), by)).getField("term"), None

    def substituted(self, e, names: dict):
        if isinstance(e, tuple) and e[0] == "agg":
            return Var(names[repr(e)])
        if isinstance(e, tuple):
            return tuple([self.substituted(y, names) for y in x] if isinstance(x, list) else self.substituted(x, names) for x in e)
        return e

    def solve(self, q: Query, last: bool = False) -> tuple[DataFrame, set[str]]:
        """Frame of terms of a SELECT, with its variables' names. last: only texts are asked for, they may be given in place of terms."""
        rows = self.evaluate(q.where, last and not (q.group or q.having or q.order or q.distinct) and all(isinstance(e, Var) and e.name == name for e, name in q.items or []))
        df = rows.df
        # Bound in every row: sure variables that are projected or grouped by as they are, and counts.
        certain = {e.name for e, name in q.items or [] if isinstance(e, Var) and e.name == name and e.name in rows.sure}
        certain |= {name for e, name in q.items or [] if isinstance(e, tuple) and e[0] == "agg" and e[1] == "COUNT"}
        certain |= rows.sure if not q.items else set()
        items = list(q.items) or [(Var(n), n) for n in sorted(rows.names) if not n.startswith("__")]
        found: list[tuple] = []
        for e in [*(e for e, _ in items), *q.having, *(e for e, _ in q.order)]:
            self.aggregates(e, found)
        having, order = q.having, q.order
        if found or q.group:
            keys = []
            for k, (e, name) in enumerate(q.group):
                name = name or f"__g{k}"
                df = df.withColumn(name, self.value(e, df).term)
                keys.append(name)
            names = {repr(e): f"__agg{k}" for k, e in enumerate(found)}
            made = []
            for e, name in zip(found, names.values(), strict=True):
                c, kind = self.aggregate(e, df)
                if kind:
                    c = T.literal(c.cast("string"), datatype=T.XSD + ("integer" if kind == "long" else "double"))
                    self.kinds[name] = kind
                made.append(c.alias(name))
            df = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*made) if made else df.select(*keys).distinct()
            items = [(self.substituted(e, names), n) for e, n in items]
            having = [self.substituted(e, names) for e in having]
            order = [(self.substituted(e, names), up) for e, up in order]
        for e, name in items:
            if not (isinstance(e, Var) and e.name == name):
                v = self.value(e, df)
                df = df.withColumn(name, v.term)
                if isinstance(e, Var) and e.name in self.kinds:
                    self.kinds[name] = self.kinds[e.name]
            elif name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast("string"))
        for e in having:
            df = df.where(self.value(e, df).truth)
        out = [name for _, name in items]
        if q.distinct:
            df = df.select(*(F.col(f"`{n}`") for n in out)).distinct()
        if order:
            df = df.orderBy(*(c for e, up in order for c in self.sorted_by(self.value(e, df), up)))
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        self.certain = certain & set(out)
        return df.select(*(F.col(f"`{n}`") for n in out)), set(out)

    @staticmethod
    def sorted_by(v: Value, up: bool) -> list[Column]:
        """Unbound, then blank nodes, IRIs and literals; numbers by value."""
        rank = F.when(v.term.isNull(), 0).when(T.is_blank(v.term), 1).when(T.is_iri(v.term), 2).otherwise(3)
        cs = [rank, v.number, v.text]
        return [c.asc_nulls_first() if up else c.desc_nulls_last() for c in cs]


def sparql(graph: Graph, query: str, spark: SparkSession, prefixes: dict[str, str] | None = None, raw: bool = False) -> DataFrame:
    """Rows of a SELECT (texts; counts as bigint, sums and means as double; raw=True: terms), or one `boolean` of an ASK."""
    q = parse(query, prefixes)
    planner = Planner(graph, spark)
    if q.form == "ask":
        found = planner.evaluate(q.where).df.limit(1)
        return found.agg((F.count("*") > 0).alias("boolean"))
    df, _ = planner.solve(q, last=not raw)
    if raw:
        return df
    return df.select(*((F.col(f"`{c}`") if planner.plain else T.lexical(F.col(f"`{c}`"))).cast(planner.kinds.get(c, "string")).alias(c) for c in df.columns))

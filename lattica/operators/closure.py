"""Reachability, cycles, strongly connected components and transitive reduction on frames of pairs.

Long simple paths are what makes searches take many rounds. A chain is a run of nodes of which each but the last has one way
out, and each but the first one way in. Pointer doubling finds all chains in a logarithm of their length, one row a node;
searches then go from chain to chain. Rounds are written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written


def pairs_of(edges: DataFrame) -> DataFrame:
    return edges.select("s", "o").where("s IS NOT NULL AND o IS NOT NULL").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("s").alias("node")).union(edges.select(F.col("o").alias("node"))).distinct()


@dataclass
class Chains:
    """node, chain (its first node; of a closed ring the least), place from 0, ring; and the edges between chains."""

    nodes: DataFrame
    edges: DataFrame


def chains(edges: DataFrame, rounds: int = 64) -> Chains:
    """The chains of edges(s, o); a node that is in none is one of its own. Rings, chains without an end, are whole graphs
    of their own: no other edge touches them."""
    e = written(pairs_of(edges), "edges")
    one_out = e.groupBy("s").agg(F.count("*").alias("n")).where("n = 1").select("s")
    one_in = e.groupBy("o").agg(F.count("*").alias("n")).where("n = 1").select("o")
    links = e.where("s <> o").join(one_out, "s", "left_semi").join(one_in, "o", "left_semi")
    # Each node's pointer goes back along its chain, twice as far a round; `low` is the least node on the way.
    back = written(links.select(F.col("o").alias("node"), F.col("s").alias("to"), F.lit(1).cast("long").alias("steps"), F.least("s", "o").alias("low")), "chains")
    moving = back.agg(F.count("*").alias("n")).first()["n"]
    most = moving  # a walk of as many steps has been all around its ring
    for _ in range(rounds):
        if not moving:
            break
        ahead = back.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"), F.col("low").alias("lower"))
        done = F.col("further").isNull() | (F.col("steps") > most)
        step = back.join(ahead, "to", "left").select(
            "node", F.when(done, F.col("to")).otherwise(F.col("further")).alias("to"), F.when(done, F.col("steps")).otherwise(F.col("steps") + F.col("more")).alias("steps"),
            F.when(done, F.col("low")).otherwise(F.least("low", "lower")).alias("low"), (~done).alias("moved"))
        back = written(step, "chains")
        moving = back.where("moved").limit(1).count()
        back = back.drop("moved")
    else:
        raise RuntimeError("the chains did not settle")
    ring = F.col("steps") > most
    held = back.select("node", F.when(ring, F.col("low")).otherwise(F.col("to")).alias("chain"), F.when(ring, 0).otherwise(F.col("steps")).cast("long").alias("place"), ring.alias("ring"))
    firsts = nodes_of(e).join(held, "node", "left_anti").select("node", F.col("node").alias("chain"), F.lit(0).cast("long").alias("place"), F.lit(False).alias("ring"))
    nodes = written(held.union(firsts), "chains")
    # Only a chain's last node has edges to other chains, and they lead to first nodes.
    between = e.join(links, ["s", "o"], "left_anti").join(nodes.select(F.col("node").alias("s"), F.col("chain").alias("from")), "s").select(F.col("from").alias("s"), "o")
    return Chains(nodes, written(between.distinct(), "edges"))


#: Rounds of a plain search before chains are looked for: most ways are short.
SHORT = 6


def reached_from(edges: DataFrame, starts: DataFrame, rounds: int = 100_000) -> DataFrame | None:
    """s, o: what starts(s) lead to by one or more edges(s, o), an edge a round; None if the rounds do not suffice."""
    known = new = written(edges.join(starts.select("s").distinct(), "s", "left_semi").distinct(), "reached")
    step = edges.select(F.col("s").alias("m"), "o")
    for k in range(rounds):
        if new.isEmpty():
            return known
        new = written(new.select("s", F.col("o").alias("m")).join(step, "m").select("s", "o").distinct().join(known, ["s", "o"], "left_anti"), "reached")
        known = known.union(new)
        if k % 16 == 15:  # keeps the plan short on long ways
            known = written(known, "reached")
    return None


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(s, o) of the closure whose s is in starts(s): a search from there that meets only what it reaches.

    If some rounds of an edge each do not suffice, it goes from chain to chain, so a path of a thousand edges without branches
    takes the ten rounds that find the chain. Within a chain that is reached, all nodes from the one that the way enters by
    are; in a ring all.
    """
    e = written(pairs_of(edges), "edges")
    if (short := reached_from(e, starts, SHORT)) is not None:
        return short
    held = chains(e)
    first = starts.select("s").distinct().join(held.nodes.select(F.col("node").alias("s"), "chain", "place", "ring"), "s")
    first = written(first, "reached")
    own = first.alias("f").join(held.nodes.alias("n"), "chain").where(F.col("n.ring") | (F.col("n.place") > F.col("f.place"))).select("s", F.col("node").alias("o"))
    entered = reached_from(held.edges, first.select(F.col("chain").alias("s")).distinct())
    if entered is None:
        raise RuntimeError("the search did not settle")
    further = first.select("s", "chain").join(entered.select(F.col("s").alias("chain"), F.col("o").alias("into")), "chain").select("s", F.col("into").alias("chain")).distinct()
    # Edges between chains lead to first nodes, so a chain that is entered is reached as a whole.
    return own.union(further.join(held.nodes.select("chain", "node"), "chain").select("s", F.col("node").alias("o"))).distinct()


def trimmed(e: DataFrame, times: int) -> DataFrame:
    """Edges that may be on a cycle: into their begin and out of their end leads some edge."""
    for _ in range(times):
        e = e.join(e.select(F.col("o").alias("s")).distinct(), "s", "left_semi").join(e.select(F.col("s").alias("o")).distinct(), "o", "left_semi").select("s", "o")
    return e


def components(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """node, component (its least node), cyclic: the strongly connected components of edges(s, o).

    Chains become one node each, a ring is a component. Of the rest each node takes the greatest node that leads to it as its
    colour; a component lies within one colour. What leads to the node that a colour is named after, within the colour, is
    that node's component; it is taken out, and the rest coloured again. A node without a cycle is a component of its own.
    """
    held = chains(edges)
    looped = held.edges.where("s = o").select(F.col("s").alias("chain"))
    e = written(trimmed(held.edges.where("s <> o"), 3), "scc")
    found: list[DataFrame] = []
    for _ in range(rounds):
        if e.isEmpty():
            break
        colour = greatest_before(e)
        tinted = e.join(colour.select(F.col("node").alias("s"), F.col("colour").alias("cs")), "s").join(colour.select(F.col("node").alias("o"), F.col("colour").alias("co")), "o")
        inside = written(tinted.where("cs = co").select("s", "o", F.col("cs").alias("colour")), "scc")
        # Backwards from the nodes that colours are named after.
        known = new = written(inside.where("o = colour").select(F.col("o").alias("node"), "colour").distinct(), "scc")
        while not new.isEmpty():
            new = written(inside.join(new.select(F.col("node").alias("o"), "colour"), ["o", "colour"]).select(F.col("s").alias("node"), "colour").distinct().join(known, ["node", "colour"], "left_anti"), "scc")
            known = known.union(new)
        known = written(known, "scc")
        found.append(known.groupBy("colour").agg(F.min("node").alias("component")).join(known, "colour").select("node", "component"))
        rest = inside.join(known.select(F.col("node").alias("s")), "s", "left_anti").join(known.select(F.col("node").alias("o")), "o", "left_anti").select("s", "o")
        e = written(trimmed(rest, 3), "scc")
    else:
        raise RuntimeError("the components did not settle")
    of_chain = held.nodes.select(F.col("chain").alias("node"), F.col("chain").alias("component")).limit(0) if not found else reduce(DataFrame.union, found)
    # A chain is on a cycle if its component has other chains, an edge to itself, or no end.
    large = of_chain.groupBy("component").agg(F.count("*").alias("chains"))
    joined = held.nodes.join(of_chain.join(large, "component").withColumnRenamed("node", "chain"), "chain", "left").join(looped.withColumn("loop", F.lit(True)), "chain", "left")
    cyclic = F.col("ring") | F.coalesce("loop", F.lit(False)) | F.coalesce(F.col("chains") > 1, F.lit(False))
    marked = written(joined.select("node", F.when(cyclic, F.coalesce("component", "chain")).otherwise(F.col("node")).alias("part"), cyclic.alias("cyclic")), "scc")
    least = marked.where("cyclic").groupBy("part").agg(F.min("node").alias("least"))
    return marked.join(least, "part", "left").select("node", F.coalesce("least", "node").alias("component"), "cyclic")


def greatest_before(e: DataFrame, rounds: int = 100_000) -> DataFrame:
    """node, colour: the greatest node that leads to a node of e(s, o), or itself. Only nodes that changed go on."""
    colour = written(nodes_of(e).select("node", F.col("node").alias("colour")), "colour")
    changed = colour
    for _ in range(rounds):
        sent = e.join(changed.select(F.col("node").alias("s"), "colour"), "s").groupBy(F.col("o").alias("node")).agg(F.max("colour").alias("sent"))
        step = written(colour.join(sent, "node", "left").select("node", F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"), F.coalesce(F.col("sent") > F.col("colour"), F.lit(False)).alias("changed")), "colour")
        colour, changed = step.select("node", "colour"), step.where("changed")
        if changed.isEmpty():
            return colour
    raise RuntimeError("the colours did not settle")


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle: those of components with more than one node, or with an edge to themselves."""
    return components(edges).where("cyclic").select("node")


def condensed(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Edges between different components of(node, component)."""
    ends = pairs_of(edges).join(of.select(F.col("node").alias("s"), F.col("component").alias("cs")), "s").join(of.select(F.col("node").alias("o"), F.col("component").alias("co")), "o")
    return ends.where("cs <> co").select(F.col("cs").alias("s"), F.col("co").alias("o")).distinct()


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """All (s, o) with a path of one or more edges(s, o), as a set; cycles end the search, not the program.

    If there are cycles, what is closed is the graph of components, and pairs of components are expanded to pairs of nodes.
    """
    e = written(pairs_of(edges), "closure")
    of = written(components(e), "closure")
    if not of.where("cyclic").limit(1).count():
        return doubled(e, rounds)
    over = doubled(condensed(e, of), rounds).union(of.where("cyclic").select(F.col("component").alias("s"), F.col("component").alias("o")).distinct())
    at: Column = F.col("component")
    return over.join(of.select(F.col("node").alias("__s"), at.alias("s")), "s").join(of.select(F.col("node").alias("__o"), at.alias("o")), "o").select(F.col("__s").alias("s"), F.col("__o").alias("o"))


def doubled(edges: DataFrame, rounds: int) -> DataFrame:
    """The closure of edges. Each round joins the pairs that the last one found with all known ones, on either side, so path
    lengths double, and no two old pairs are joined again. Raises if `rounds` do not suffice."""
    known = new = written(edges, "closure")
    for k in range(rounds):
        ahead = new.select("s", F.col("o").alias("m")).join(known.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        behind = known.select("s", F.col("o").alias("m")).join(new.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        new = written(ahead.union(behind).distinct().join(known, ["s", "o"], "left_anti"), "closure")
        if new.isEmpty():
            return known
        known = written(known.union(new), "closure") if k % 4 == 3 else known.union(new)
    raise RuntimeError("the closure did not settle")


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges of a closed acyclic relation that no two-edge path replaces."""
    pairs = written(edges.select("s", "o").distinct(), "reduction")
    implied = pairs.select("s", F.col("o").alias("m")).join(pairs.select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()
    return pairs.join(implied, ["s", "o"], "left_anti")

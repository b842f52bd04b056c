"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to reference fingerprints. The references are of two kinds. The
zero fingerprint and the 64 single-bit ones: the distance to a single bit exceeds that to zero by one or falls short of
it by one, so two fingerprints with equal differences on a block of these references agree on the block's bits. A pair
within r bits disagrees on at most r blocks, so it has equal coordinates on some choice of the others: an equi-join on
each choice proposes all pairs within r bits without comparing all rows. The other references are spread over the cube:
by the triangle inequality a pair within r bits differs by at most r in each of these coordinates, so pairs with a larger
maximum difference are discarded, and the survivors are verified on the fingerprints.

Crowded coordinates (many distinct fingerprints equal on a choice) are not paired. Their fingerprints are linked by an
exact way of linear size instead: two fingerprints within 2 bits share a neighbour at distance 1 or less, and at most 65
fingerprints share one, so each is linked to the least one around each of its 65 neighbours. Exact copies are one
fingerprint throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common, components, prefixed

BLOCKS = 5
#: Distinct fingerprints equal on a choice of blocks, above which they are linked by common neighbours.
CROWD = 32
#: Spread reference fingerprints: fixed, from a generator, independent of the data.
PIVOTS = tuple(int(x) for x in np.random.default_rng(64).integers(-(2**63), 2**63, 16, dtype=np.int64))


def hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64, seed 42, of a text's word shingles with repeats; of the whole sequence if it has fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=n)


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit integer; 0 without hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash (signed 64-bit) of a text's word shingles with repeats; 0 without words."""
    return majority(hashes(text, shingle))


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other 64 bits of each hash: a finaliser with shifts and odd factors, told apart by k."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame | common.Numbered, shingle: int = 3, more: int = 0) -> DataFrame:
    """item (numbers the rows), doc_id, fp and `more` further fingerprints (array more) of docs(doc_id, text).

    Null text is empty text.
    """
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("more", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, rest = [], []
            for text in batch.column(2):
                h = hashes(text.as_py() or "", shingle)
                fps.append(majority(h))
                rest.append([majority(remixed(h, k)) for k in range(1, more + 1)])
            yield pa.record_batch([*batch.columns[:2], pa.array(fps, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], schema=schema)

    given = common.rows(docs).select("item", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    return given.mapInArrow(lambda batches: common.released(run(batches)), "item long, doc_id long, fp long, more array<long>")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def choices(blocks: int, differ: int) -> list[int]:
    """Masks over the 64 single-bit references: all choices of blocks - differ blocks."""
    bounds = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(bounds, bounds[1:])]
    return [signed(sum(c)) for c in combinations(block, blocks - differ)]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivoted(fps: DataFrame) -> DataFrame:
    """The pivot distance table: fps with the Hamming distances of fp to all PIVOTS, d0, d1 and so on."""
    return fps.select("*", *(distance(F.col("fp"), F.lit(p)).cast("byte").alias(f"d{k}") for k, p in enumerate(PIVOTS)))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b), b < a, between distinct fingerprints of a `pivoted` fps(fp), with the components of "within radius
    bits".

    Only a radius of 2 or less is exact for crowded coordinates, so a larger one is refused.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius is 0, 1 or 2")
    distances = [f"d{k}" for k in range(len(PIVOTS))]
    key = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in choices(BLOCKS, radius)))).alias("choice", "key")
    table = fps.select("fp", *distances, key)
    crowd = table.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    crowd = common.keep(crowd, "crowds")
    sparse = table.join(crowd.where(F.col("n") <= CROWD), ["choice", "key"]).select("choice", "key", "fp", *distances)
    dense = table.join(crowd.where(F.col("n") > CROWD), ["choice", "key"], "left_semi").select("fp").distinct()
    left, right = sparse.alias("x"), sparse.alias("y")
    near = F.greatest(*(F.abs(F.col(f"x.d{k}") - F.col(f"y.d{k}")) for k in range(len(PIVOTS)))) <= radius
    met = (F.col("x.choice") == F.col("y.choice")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") > F.col("y.fp"))
    pairs = left.join(right, met & near & (distance(F.col("x.fp"), F.col("y.fp")) <= radius)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << k))) for k in range(64))]
    if radius == 2:
        around = dense.select("fp", F.explode(F.array(*flips)).alias("at"))
        least = around.groupBy("at").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").select("at", "least")
        crowded = around.join(least, "at").where("fp > least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    else:
        around = dense.select("fp", F.explode(F.array(*flips)).alias("at")) if radius else dense.select("fp", F.col("fp").alias("at"))
        crowded = around.join(dense.select(F.col("fp").alias("at")), "at").where("fp > at").select(F.col("fp").alias("a"), F.col("at").alias("b"))
    return pairs.union(crowded).distinct()


#: Further fingerprints of the wide step: 512 bits tell 0.8 from 0.6 apart, 64 do not.
MORE = 7
#: Partners proposed to each member of a group of equal sampled coordinates, in each table; and in the first round, which
#: joins most members of large groups before the full reach is spent on what is left.
REACH = 16
FIRST_REACH = 2
#: Bits more that the tables of each deeper level sample, for members of groups that stay crowded.
DEEPER = 6


def disagreement(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity of shingle sets: the angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables(rows: int, similarity: float, spare: float, level: int = 0) -> tuple[int, int]:
    """(bits, tables): bits grow with log2 of the rows, so that chance collisions don't, and tables keep the recall.

    Each level samples DEEPER more bits. With all 64 bits there are no more tables than further fingerprints.
    """
    bits = min(64, max(16, math.ceil(math.log2(max(rows, 2))) + 4) + DEEPER * level)
    return bits, MORE + 1 if bits == 64 else math.ceil(spare / (1 - disagreement(similarity)) ** bits)


def allowed(bits: int, similarity: float, slack: float) -> int:
    """Differing bits of so many that a pair at the similarity has at most, up to `slack` standard deviations."""
    p = disagreement(similarity)
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def wide_links(reps: DataFrame, rows: int, similarity: float, reach: int = REACH, level: int = 0, spare: float = 1.0, slack: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Proposed edges (a, b, crowded), b < a, between reps(node, fp, words) whose 512 bits say `similarity` or more, with
    whether a crowded group proposed them; and the nodes of all members of crowded groups.

    Each table samples coordinates (differences of distances to single-bit references) and groups equal ones. The pair is
    proposed if its differing bits are at most the expected number plus `slack` standard deviations; before the further
    fingerprints are fetched, the first 64 bits alone discard pairs beyond three. A member is compared with the next
    `reach` of its group, in an order of each table's own. A group with members beyond reach of each other is crowded.
    All tables draw on the same 512 bits, so their recall is not that of independent ones: nothing rests on it.
    """
    bits, count = tables(rows, similarity, spare, level)
    rng = np.random.default_rng(256)
    masks = [signed(sum(1 << int(b) for b in rng.choice(64, bits, replace=False))) for _ in range(count)]
    most = allowed(64 * (MORE + 1), similarity, slack)
    keys = F.transform(F.array(*map(F.lit, masks)), lambda m, i: F.xxhash64(i, F.element_at("words", (i % (MORE + 1) + 1).cast("int")).bitwiseAND(m)))
    dealt = reps.select("node", "fp", F.explode(keys).alias("key"))
    group = Window.partitionBy("key").orderBy(F.xxhash64("node", "key"), "node")
    ahead = dealt.select("node", "fp", F.collect_list(F.struct("node", "fp")).over(group.rowsBetween(1, reach + 1)).alias("next"), F.row_number().over(group).alias("at"))
    # A member with others beyond its reach, before or after it, is paired with itself too: that marks it as crowded.
    beyond = (F.size("next") > reach) | (F.col("at") > reach + 1)
    own = F.array(F.struct("node", "fp"))
    others = F.concat(F.slice("next", 1, reach), F.when(beyond, own).otherwise(F.slice(own, 1, 0)))
    met = ahead.where((F.size("next") > 0) | beyond).select("node", "fp", F.size("next").alias("n"), F.explode(others).alias("o")).where(distance(F.col("fp"), F.col("o.fp")) <= allowed(64, similarity, 3.0))
    met = common.keep(met.groupBy(F.greatest("node", "o.node").alias("a"), F.least("node", "o.node").alias("b")).agg(F.max("n").alias("n")), "wide")
    x, y = (reps.select(F.col("node").alias(c), F.col("words").alias(w)) for c, w in (("a", "wa"), ("b", "wb")))
    differ = F.aggregate(F.zip_with("wa", "wb", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)
    linked = common.keep(met.where("a > b").join(x, "a").join(y, "b").where(differ <= most).select("a", "b", "n"), "met")
    return linked.select("a", "b", (F.col("n") > reach).alias("crowded")), met.where("a = b").select(F.col("a").alias("node"))


def near_duplicates(docs: DataFrame | common.Numbered, shingle: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """item, doc_id, fp and component_id of each row of docs(doc_id, text); with `similarity` also first.

    Fingerprints within `radius` bits link; component_id is the smallest doc_id that links reach, itself included (null
    only if all its ids are). With `similarity`, `similar` links instead. Null, empty and white-space texts have
    fingerprint 0, linked like any other; repeated rows and null ids stay rows; an empty table gives no rows; other
    columns are ignored.
    """
    if similarity:
        return similar(docs, shingle, similarity)
    seen = common.keep(fingerprints(docs, shingle), "fingerprints")
    fps = common.keep(pivoted(seen.groupBy("fp").agg(F.min("doc_id").alias("least"))), "distinct")
    roots = components.components(links(fps, radius))
    linked = common.keep(fps.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = common.salted(linked.select("fp", "root"), ids, "root", "fp").select("fp", "component_id")
    # A fingerprint without links is its own component.
    alone = fps.select("fp", "least").join(linked.select("fp"), "fp", "left_anti")
    of = common.keep(of.union(alone.select("fp", F.col("least").alias("component_id"))), "of")
    return common.salted(seen, of, "fp", "item").select("item", "doc_id", "fp", "component_id")


def similar(docs: DataFrame | common.Numbered, shingle: int, similarity: float) -> DataFrame:
    """item, doc_id, fp, component_id and first of each row of docs(doc_id, text): texts link if the Jaccard similarity
    of their sets of distinct word shingles is at least `similarity`, by those sets and by nothing else.

    Texts of equal sets are one node. The bits of `wide_links` propose pairs, which are checked on the sets and linked.
    This is repeated on the least node of each component at full reach, for as long as a linked pair came from a crowded
    group; members of groups still crowded go on to tables of more bits. Whatever these rounds miss, `prefixed.links`
    finds: it compares all nodes that can be similar and are not yet in one component. So the rounds only spare it
    pairs, and the components are those of all similar pairs, whatever the bits, groups and number of rows.
    `first` marks one row of each component: of the smallest doc_id, then item. Texts without words are one node.
    """
    docs = docs if isinstance(docs, common.Numbered) else common.numbered(docs)
    hot = prefixed.frequent(docs, shingle)
    seen = common.keep(prefixed.profiles(docs, shingle, similarity, hot, MORE), "profiles")
    nodes = seen.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("item").alias("sample"), F.min("size").alias("size"), F.min(F.concat(F.array("fp"), "more")).alias("words"))
    joined = common.keep(nodes.withColumn("fp", F.element_at("words", 1)).withColumn("root", F.col("node")), "roots")
    sets = prefixed.Sets(docs, joined.select("node", "sample"), seen, shingle, similarity)

    def merged(edges: DataFrame) -> DataFrame:
        upper = components.components(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))
        return common.keep(joined.join(common.small(upper), "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"), "roots")

    among, level, reach, n = None, 0, FIRST_REACH, joined.count()
    while True:
        reps = joined.where("node = root").select("node", "fp", "words")
        reps = common.keep(reps.join(common.small(among), "node", "left_semi") if among else reps, "reps")
        proposed, crowd = wide_links(reps, n, similarity, reach, level)
        edges = sets.checked(proposed)
        # Only checked pairs count: they leave fewer rows, so the rounds end.
        found = bool(edges.join(proposed.where("crowded"), ["a", "b"], "left_semi").limit(1).count())
        joined = merged(edges)
        if not found and reach == REACH:
            among, level = crowd, level + 1
            if tables(n, similarity, 1.0, level - 1)[0] == 64 or not among.limit(1).count():
                break
        reach = REACH
    # Components of components: an edge of two nodes is one of their roots.
    rest = sets.checked(prefixed.links(seen, joined, similarity))
    root = joined.select("node", "root")
    rest = rest.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    joined = merged(rest.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).where("a > b").distinct())
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = common.salted(joined.select("node", "root"), ids, "root", "node").select("node", "root", "component_id")
    out = seen.join(common.small(of), "node").select("item", "doc_id", "fp", "component_id", "root")
    one = out.groupBy("root").agg(F.min_by("item", F.struct(F.col("doc_id").isNull(), "doc_id", "item")).alias("item")).select("item", F.lit(True).alias("first"))
    return out.drop("root").join(common.small(one), "item", "left").withColumn("first", F.coalesce("first", F.lit(False)))

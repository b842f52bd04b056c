"""Quality rules with cross-document line frequency.

What a host repeats on its pages is boilerplate; what the near copies of one text share is not, though both are lines of many
documents. Where a later step thins out near copies, `copies=False` tells them apart: only documents with content of their
own beside the lines that many share then count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\r\x0b\x0c"
#: A line in more distinct documents of a host than this is boilerplate and is removed.
LINE_DOCUMENTS = 8
#: A document is depleted if less than this share of its words is left, or fewer words than any document needs.
KEPT_SHARE = 0.3
LEAST_WORDS = 50


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often, reach = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def line_key(line: str) -> tuple[int | None, int]:
    """Hash of a normalised line (lower case, single spaces), null without words, and its words."""
    words = line.lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return None, 0
    h = xxhash.xxh64_intdigest(b" ".join(words), 42)
    return h - ((h >> 63) << 64), len(words)


def line_profile(text: str) -> dict[int, int]:
    """Words in each distinct normalised line, by its hash."""
    out: dict[int, int] = {}
    for line in text.split("\n"):
        h, n = line_key(line)
        if n:
            out[h] = out.get(h, 0) + n
    return out


def less(text: str, gone: set[int]) -> str:
    """The text without the lines of these hashes."""
    return "\n".join(line for line in text.split("\n") if line_key(line)[0] not in gone)


def profiles(docs: DataFrame | common.Numbered) -> DataFrame:
    """item, doc_id, host, body (hash of the text), the base figures, and arrays lines, line_words of each row."""
    names = ["item", "doc_id", "host", "body", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32())]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text in part.column(4):
                    text = text.as_py() or ""
                    profile = line_profile(text)
                    rows.append((*base(text), [*profile], [*profile.values()]))
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([*part.columns[:4], *(pa.array(c, t) for c, t in zip(columns, kinds[4:], strict=True))], schema=schema)

    text = F.col("row.text").cast("string")
    given = common.rows(docs).select("item", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("host"), F.xxhash64(text).alias("body"), text.alias("text"))
    return given.mapInArrow(lambda batches: common.released(run(batches)), "item long, doc_id long, host string, body long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>")


def judge(docs: DataFrame | common.Numbered, line_documents: int = LINE_DOCUMENTS, kept_share: float = KEPT_SHARE, least_words: int = LEAST_WORDS, copies: bool = True) -> DataFrame:
    """Judge docs(doc_id, text, source); the source stands for the host. Returns item, doc_id, base figures, base_failed,
    removed_words and kept, for each row.

    A document, for counting, is a distinct text of a host, so exact copies of a good text do not make its lines
    boilerplate. A line (lower case, single spaces) found in more than line_documents distinct documents of its host is
    removed. A document left with less than kept_share of its words, or with fewer than least_words, is depleted and
    rejected, and so is one whose base figures fail (fewer than 50 words, or over half its words in repeated 3-word
    windows). Without `copies` a document that these lines would leave with less than kept_share of its words has no content
    of its own and does not count: lines are counted again without such documents, so near copies of a good text, however
    many, do not make its lines boilerplate. Lines that enough other documents have are removed from it all the same. Null
    text is empty text; a null source is a host; repeated rows are judged each; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    return judged(docs, line_documents, kept_share, least_words, copies)[0]


def judged(docs: DataFrame | common.Numbered, line_documents: int, kept_share: float, least_words: int, copies: bool) -> tuple[DataFrame, DataFrame]:
    """What judge returns, and item, line (hash) of each removed line of each row."""
    seen = common.keep(profiles(docs), "lines")
    host = F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("host")
    first = seen.groupBy(host, "body").agg(F.min("item").alias("item"))
    listed = seen.select("item", host, F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("item", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    counted = listed.join(first.select("item"), "item", "left_semi").groupBy("host", "line").agg(F.count("*").alias("n"))
    often = common.keep(counted.where(F.col("n") > line_documents).select("host", "line"), "often")
    # A common line of a large host has many rows: broadcast, or salted.
    gone = common.salted(listed, often, ["host", "line"], "item")
    if not copies:
        gone = common.keep(gone, "shared")
        words = gone.groupBy("item").agg(F.sum("words").alias("words"))
        bare = seen.join(words, "item").where(F.col("n_words") - F.col("words") < kept_share * F.col("n_words")).select("item")
        count = gone.join(first.select("item"), "item", "left_semi").join(common.small(common.keep(bare, "bare")), "item", "left_anti")
        often = count.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > line_documents).select("host", "line")
        gone = common.salted(gone, common.keep(often, "often"), ["host", "line"], "item")
    removed = gone.groupBy("item").agg(F.sum("words").alias("removed"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = seen.drop("lines", "line_words", "body", "host").join(removed, "item", "left").withColumn("removed_words", common.whole_number(F.col("removed"))).drop("removed")
    left = F.col("n_words") - F.col("removed_words")
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (left >= kept_share * F.col("n_words")) & (left >= least_words))
    return out, gone.select("item", "line")


def cleaned(docs: common.Numbered, line_documents: int = LINE_DOCUMENTS, kept_share: float = KEPT_SHARE, least_words: int = LEAST_WORDS, copies: bool = True) -> DataFrame:
    """The kept rows of docs, with docs' own columns: text without the removed lines, and n_chars, if docs has it, of the
    text that is left. Other rows' texts are not touched."""
    verdict, gone = judged(docs, line_documents, kept_share, least_words, copies)
    verdict = common.keep(verdict.where(~F.col("kept") | (F.col("removed_words") > 0)).select("item", "kept"), "verdict")
    rows = common.without(docs, verdict)
    cut = verdict.where("kept").select("item")
    gone = gone.join(common.small(cut), "item", "left_semi").groupBy("item").agg(F.collect_set("line").alias("gone"))
    given = docs.rows.join(common.small(common.keep(gone, "gone")), "item").select("row", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, columns = [f.name for f in batch.column(0).type], batch.column(0).flatten()
            at = names.index("text")
            texts = [less(t.as_py() or "", set(g.as_py())) for t, g in zip(columns[at], batch.column(1), strict=True)]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) for t in texts], pa.int64()).cast(columns[k].type)
            yield pa.record_batch(columns, names=names)

    return rows.union(given.mapInArrow(lambda batches: common.released(run(batches)), rows.schema))

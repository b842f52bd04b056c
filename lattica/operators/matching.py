"""Which of many patterns a text holds.

Patterns are found by an Aho-Corasick automaton: a text is read once, however many patterns there are. The patterns are dealt
to parts whose size is bounded; each task that reads texts has the automaton of one part, so the texts are read once a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Characters of the patterns of one part: an automaton takes some hundred bytes for each.
PART_CHARACTERS = 1_000_000


def containing(texts: DataFrame, column: str, patterns: DataFrame, part_characters: int = PART_CHARACTERS) -> DataFrame:
    """The rows of texts with `pattern`: one for each different pattern of patterns(pattern) that stands in the column's text.

    Rows whose text holds none have one row with a null pattern. Null texts hold none, null patterns are none, the empty
    pattern stands in every text; repeated rows stay.
    """
    spark = texts.sparkSession
    own = patterns.select(F.col("pattern").cast("string").alias("pattern")).where("pattern IS NOT NULL").distinct()
    total = own.agg(F.sum(F.length("pattern") + 1)).first()[0] or 0
    parts = max(1, -(-total // part_characters))
    dealt = own.select("pattern", F.pmod(F.xxhash64("pattern"), F.lit(parts)).alias("part"))
    schema = StructType([StructField("__found", StringType()), *texts.schema.fields])
    out = []
    for part in range(parts):
        # At most about part_characters of them: the bound of what goes to the driver and to each worker.
        words = spark.sparkContext.broadcast([r["pattern"] for r in dealt.where(F.col("part") == part).select("pattern").collect()])
        out.append(texts.mapInArrow(finder(words, column), schema))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    if parts == 1:
        return found.withColumnRenamed("__found", "pattern")
    # A row that holds nothing of one part may hold something of another: only then its nulls go.
    hits = found.where("__found IS NOT NULL").withColumnRenamed("__found", "pattern")
    same = F.lit(True)
    for c in texts.columns:
        same = same & F.col(f"t.`{c}`").eqNullSafe(F.col(f"h.`{c}`"))
    none = texts.alias("t").join(hits.drop("pattern").distinct().alias("h"), same, "left_anti")
    return hits.unionByName(none.withColumn("pattern", F.lit(None).cast("string")))


def finder(words, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, everywhere = ahocorasick.Automaton(), [w for w in words.value if not w]
        for w in words.value:
            if w:
                automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(batch.schema.get_field_index(column))):
                text = text.as_py()
                held = dict.fromkeys(everywhere) if text is not None else {}
                if text and len(automaton):
                    held.update(dict.fromkeys(w for _, w in automaton.iter(text)))
                for w in held or [None]:
                    rows.append(k)
                    found.append(w)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *taken.columns], names=["__found", *batch.schema.names])

    return run

"""Replacing id tokens inside texts by their originals."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: an id token, in any case, not right after a slash.
TOKEN = r"(?<!/)sid[_-][A-Za-z0-9_-]+"
_ANY_CASE = f"(?i)({TOKEN})"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_ANY_CASE), F.lit(1))


def known(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """rows with __known, a map of those of each text's tokens (lower case) that mapping(key, value) holds.

    Tokens are joined to the mapping, each distinct text once, so neither side has a bound; texts without tokens do not
    take part.
    """
    found = rows.select(F.col(column).alias("__text")).where(F.col(column).rlike(_ANY_CASE)).distinct()
    keys = found.select("__text", F.explode(F.array_distinct(F.transform(tokens(F.col("__text")), F.lower))).alias("key"))
    held = keys.join(mapping.select("key", "value").where("value IS NOT NULL"), "key").groupBy("__text").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("__known"))
    joined = rows.join(held, rows[column] == held["__text"], "left").drop("__text")
    return joined.withColumn("__known", F.coalesce("__known", F.create_map().cast("map<string,string>")))


def replace_ids(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """rows with `column`'s known tokens replaced and n_replaced, by mapping(key lower case, value); unknown tokens stay."""
    text, own = F.col(column), tokens(F.col(column))
    between = F.split(text, _ANY_CASE, -1)
    swapped = F.transform(own, lambda t, k: F.concat(F.get(between, k), F.coalesce(F.col("__known")[F.lower(t)], t)))
    whole = F.concat(F.array_join(swapped, ""), F.element_at(between, -1))
    n = F.size(F.filter(own, lambda t: F.map_contains_key("__known", F.lower(t))))
    return known(rows, column, mapping).withColumns({column: whole, "n_replaced": F.coalesce(n, F.lit(0))}).drop("__known")


def replace_ids_nested(rows: DataFrame, column: str, mapping: DataFrame, untouched: tuple[str, ...] = ("query",)) -> DataFrame:
    """As `replace_ids` for texts that hold a JSON document: string values at any depth are replaced, names of members are
    not, and nothing below a member named in `untouched` is. What is no JSON stays as it is, with 0 replacements."""

    @F.pandas_udf("text string, n int")
    def swap(texts: pd.Series, maps: pd.Series) -> pd.DataFrame:
        pattern, out = re.compile(TOKEN, re.IGNORECASE), []
        for text, held in zip(texts, maps):
            try:
                document = [json.loads(text)] if text is not None and held else None
            except ValueError:
                document = None
            if document is None:
                out.append((text, 0))
                continue
            n, open_ = 0, [document]
            while open_:
                container = open_.pop()
                for place, value in list(container.items() if isinstance(container, dict) else enumerate(container)):
                    if isinstance(value, (dict, list)) and place not in untouched:
                        open_.append(value)
                    elif isinstance(value, str) and place not in untouched:
                        parts = pattern.split(value)
                        new = [held.get(t.lower()) for t in pattern.findall(value)]
                        n += sum(x is not None for x in new)
                        if any(x is not None for x in new):
                            olds = pattern.findall(value)
                            container[place] = parts[0] + "".join((o if x is None else x) + p for o, x, p in zip(olds, new, parts[1:]))
            out.append((json.dumps(document[0], ensure_ascii=False), n) if n else (text, 0))
        return pd.DataFrame(out, columns=["text", "n"])

    done = known(rows, column, mapping).withColumn("__r", swap(column, "__known"))
    return done.withColumns({column: F.col("__r.text"), "n_replaced": F.col("__r.n")}).drop("__r", "__known")


def replacement_report(rows: DataFrame) -> DataFrame:
    return rows.agg(F.sum("n_replaced").cast("long").alias("replacements"), F.count_if(F.col("n_replaced") > 0).alias("changed"), F.count("*").alias("files"))

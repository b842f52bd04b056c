"""Schema inference over an instance graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import class_key, class_of_predicate
from .closure import transitive_reduction


def predicates_by_class(typed: DataFrame) -> DataFrame:
    """class, predicates of typed(class, predicate)."""
    return typed.groupBy("class").agg(F.array_sort(F.collect_set("predicate")).alias("predicates"))


def superclass_pairs(typed: DataFrame) -> DataFrame:
    """class, superclass: an instance class is below the classes that its instances' predicates are named after.

    Names are compared without %20 and case; the class itself is left out, and names are restored.
    """
    own = typed.select(F.col("class"), class_key(F.col("class")).alias("key")).distinct()
    named = typed.select(class_key(F.col("class")).alias("key"), class_of_predicate(F.col("predicate")).alias("superclass")).withColumn("upper", class_key(F.col("superclass")))
    pairs = named.where("key <> upper").groupBy("key", "upper").agg(F.min("superclass").alias("superclass"))
    return pairs.join(own, "key").join(own.select(F.col("key").alias("upper"), F.col("class").alias("restored")), "upper", "left").select("class", F.coalesce("restored", "superclass").alias("superclass"))


def superclass_sets(pairs: DataFrame) -> DataFrame:
    """class, superclasses: the true transitive reduction of the pairs, with the class itself added again."""
    direct = transitive_reduction(pairs.select(F.col("class").alias("s"), F.col("superclass").alias("o")))
    rows = direct.select(F.col("s").alias("class"), F.col("o").alias("superclass")).union(pairs.select("class", F.col("class").alias("superclass")).distinct())
    return rows.groupBy("class").agg(F.array_sort(F.collect_set("superclass")).alias("superclasses"))

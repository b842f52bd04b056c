"""Report frames over the long fact table: joins to categories, means, pairs, pivots, ranks, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from ..storage import written


def valid(facts: DataFrame) -> DataFrame:
    """Rows with status OK and a value that is a number."""
    value = F.col("value").cast("string").try_cast("double")
    return facts.where((F.col("status") == "OK") & value.isNotNull() & ~F.isnan(value)).withColumn("value", value)


def categorised(facts: DataFrame, categories: DataFrame) -> tuple[DataFrame, int]:
    """(facts with their category, rows without one). A question in two categories of a dataset raises."""
    if twice := categories.groupBy("dataset_kind", "question_id").agg(F.count("*").alias("n")).where("n > 1").first():
        raise ValueError(f"{twice['question_id']} is in {twice['n']} categories")
    on = (facts["datasetKind"] == categories["dataset_kind"]) & (facts["questionId"] == categories["question_id"])
    return facts.join(categories, on).drop("dataset_kind", "question_id"), facts.join(categories, on, "left_anti").count()


def resolve(asked: list[str], known: list[str]) -> list[str]:
    """Asked names as they are known, compared without case and extra white space; order kept, doubles dropped."""
    by = {" ".join(k.lower().split()): k for k in known}
    out: list[str] = []
    for a in asked:
        key = " ".join(a.lower().split())
        if key not in by:
            raise ValueError(f"unknown: {a}; there are {', '.join(sorted(known))}")
        if by[key] not in out:
            out.append(by[key])
    return out


def resolve_categories(asked: DataFrame, categories: DataFrame) -> DataFrame:
    """category_key of asked(alias): name, display name, or either after the dataset kind and ::."""
    aliases = F.array("name", "display_name", F.concat_ws("::", "dataset_kind", "name"), F.concat_ws("::", "dataset_kind", "display_name"))
    known = categories.select("category_key", F.explode(aliases).alias("a")).select("category_key", norm(F.col("a")).alias("a")).distinct()
    return asked.select("alias", norm(F.col("alias")).alias("a")).join(known, "a").select("alias", "category_key").distinct()


def restrict(facts: DataFrame, **allowed: list[str] | None) -> DataFrame:
    """Keep rows by column=values in turn; nothing left after one raises."""
    for column, values in allowed.items():
        if values:
            facts = facts.where(F.col(column).isin(values))
            if facts.isEmpty():
                raise ValueError(f"no rows left after {column}")
    return facts


def means(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(F.avg("value").alias("mean_value"))


def question_set_pairs(sets: DataFrame) -> DataFrame:
    """original, mutant: <n>_questions and <n>_mutant_questions that are both in sets(questionSet)."""
    mutant = sets.where(F.col("questionSet").endswith("_mutant_questions")).select(F.col("questionSet").alias("mutant"), F.regexp_replace("questionSet", "_mutant_questions$", "_questions").alias("original"))
    return mutant.join(sets.select(F.col("questionSet").alias("original")), "original").select("original", "mutant").distinct()


def selected_sets(pairs: DataFrame, mode: str = "orig+mutant") -> DataFrame:
    """questionSet of pairs(original, mutant): the original ones ("orig"), the mutants, or both; each once."""
    columns = {"orig": ["original"], "mutant": ["mutant"], "orig+mutant": ["original", "mutant"]}
    if mode not in columns:
        raise ValueError(f"mode is one of {', '.join(columns)}")
    return pairs.select(F.explode(F.array(*columns[mode])).alias("questionSet")).distinct()


def listed_values(values: list[str] | None) -> list[str] | None:
    """Arguments that may hold several values with commas between, as one list; null if nothing is left."""
    return [v for v in map(str.strip, ",".join(map(str, values or ())).split(",")) if v] or None


def paired_means(facts: DataFrame, original: Column, keys: list[str]) -> DataFrame:
    """Means of original and mutant rows side by side, for keys that have both: one pass over the rows."""
    got = facts.groupBy(*keys).agg(F.avg(F.when(original, F.col("value"))).alias("original_mean"), F.avg(F.when(~original, F.col("value"))).alias("mutant_mean"))
    return got.where("original_mean IS NOT NULL AND mutant_mean IS NOT NULL")


def wide(facts: DataFrame, index: list[str], metrics: list[str]) -> DataFrame:
    """A column of means a metric; metrics without rows stay, as nulls."""
    return facts.groupBy(*index).pivot("metric", metrics).agg(F.avg("value"))


def average_ranks(rows: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """rows, their value not null, with its rank from 1 within `by`, ties sharing their mean rank.

    What is ranked are the different values with their numbers of rows. These are sorted by ranges, added up within a range,
    and a range begins with the sum of those before it; so neither a value that many rows have nor a group of all rows is one
    task's. Each row then takes its value's rank. The rows are written first: a mean that is made twice may differ in its last
    digit, as sums of doubles depend on their order, and the row would then find no rank.
    """
    given = written(rows.where(F.col(value).isNotNull()), "ranked")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = given.groupBy(*by, value).agg(F.count("*").alias("__n")).repartitionByRange(n, *by, value)
    ranges = written(counts.withColumn("__range", F.spark_partition_id()), "ranks")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(*by, "__range").agg(F.sum("__n").alias("__total"))
    starts = totals.select(*by, "__range", F.coalesce(F.sum("__total").over(earlier(Window.partitionBy(*by).orderBy("__range"))), F.lit(0)).alias("__start"))
    own = F.coalesce(F.sum("__n").over(earlier(Window.partitionBy("__range", *by).orderBy(value))), F.lit(0))
    same = lambda *columns: [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in columns]
    placed = ranges.withColumn("__own", own).alias("l").join(starts.alias("r"), same(*by, "__range")).select("l.*", "r.__start")
    ranks = placed.select(*by, value, (F.col("__start") + F.col("__own") + (F.col("__n") + 1) / 2).alias(out))
    return given.alias("l").join(ranks.alias("r"), same(*by, value)).select("l.*", F.col(f"r.`{out}`"))


def correlated(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, rho of rows with __a and __b, both not null: null under two rows or for a constant."""
    ranked = average_ranks(average_ranks(pairs, "__a", by, "__ra"), "__b", by, "__rb")
    # Not corr(): it raises on a constant column in ANSI mode.
    rho = F.try_divide(F.covar_pop("__ra", "__rb"), F.stddev_pop("__ra") * F.stddev_pop("__rb"))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("rho"))
    return out.withColumn("rho", F.when((F.col("n") > 1) & ~F.isnan("rho"), F.col("rho")))


def spearman(matrix: DataFrame, a: str, b: str, partition: list[str] | None = None) -> DataFrame:
    """Rank correlation of two columns, rows with a null in either dropped; null under two rows or for a constant."""
    by = partition or []
    rows = matrix.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return correlated(rows.select(*by, F.col(a).alias("__a"), F.col(b).alias("__b")), by)


def spearman_matrix(matrix: DataFrame, metrics: list[str]) -> DataFrame:
    """a, b, n, rho of each pair of metrics, in one plan: a row of the matrix stands there once for each pair that it has."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b")) for k, a in enumerate(metrics) for b in metrics[k + 1 :]]
    return correlated(matrix.select(F.inline(F.array(*pairs))).where("__a IS NOT NULL AND __b IS NOT NULL"), ["a", "b"])


def min_max(rows: DataFrame, partition: list[str], value: str = "value") -> DataFrame:
    """normalized: value between its partition's least and greatest, held within 0 and 1; 0.5 if these are equal or
    all values are null; nulls stay null otherwise."""
    w = Window.partitionBy(*partition)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    share = (F.col(value) - lo) / (hi - lo)
    flat = lo.isNull() | (hi == lo)
    return rows.withColumn("normalized", F.when(flat, 0.5).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).cast("double")))


def fixed_range(value: Column, lo: float | None, hi: float | None, least: Column, most: Column) -> Column:
    """(v - lo) / (hi - lo), bounds falling back to the data's."""
    a, b = (F.lit(lo) if lo is not None else least), (F.lit(hi) if hi is not None else most)
    return F.when(b > a, (value - a) / (b - a)).otherwise(F.lit(0.5))


def axis_limits(rows: DataFrame, value: str) -> DataFrame:
    lo, hi = F.min(value), F.max(value)
    return rows.agg((lo - (hi - lo) * 0.05).alias("low"), (hi + (hi - lo) * 0.05).alias("high"))


def metric_order(metric: Column, known: list[str]) -> Column:
    """Sort key: known metrics by place, compared as text; unknown ones after."""
    key = F.lit("~")
    for k, m in reversed(list(enumerate(known))):
        key = F.when(metric == m, F.lit(str(k))).otherwise(key)
    return F.concat(key, F.lit(":"), metric)

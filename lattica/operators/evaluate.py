"""Traces to answers, answers to metric rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import METRICS
from ..functions.text import rel_path
from ..plans.recovery import recovered
from ..plans.syntax import SparqlError
from ..storage import written
from .matching import containing


def events(traces: DataFrame) -> DataFrame:
    return traces.select("file", F.col("meta.questionId").alias("question_id"), F.posexplode("conversation.events").alias("place", "event")).select("file", "question_id", "place", "event.*")


def last_queries(events_: DataFrame, keys: list[str]) -> DataFrame:
    """Query of the largest seq by keys of events(seq, query); rows without a query or a seq of 0 or more do not count."""
    rows = events_.where(F.col("query").isNotNull() & (F.col("seq") >= 0))
    return rows.groupBy(*keys).agg(F.max_by("query", "seq").alias("last_query"), F.max("seq").alias("last_seq"))


def run_counters(answers: DataFrame, keys: list[str], status: Column, tokens: Column) -> DataFrame:
    """ok, timeout and error (all else) counts and the token sum."""
    ok, late = F.upper(status) == "OK", F.upper(status) == "TIMEOUT"
    return answers.groupBy(*keys).agg(F.count_if(ok).alias("ok"), F.count_if(~F.coalesce(ok | late, F.lit(False))).alias("error"), F.count_if(late).alias("timeout"), F.sum(F.coalesce(tokens, F.lit(0))).alias("tokens"))


def keyword_position(question_id: Column) -> Column:
    """q12 or Q012 to 11; null if the id is none of these."""
    digits = F.regexp_extract(question_id, r"(?i)^q(\d+)$", 1)
    return F.when(digits != "", digits.cast("int") - 1)


def metric_input(answers: DataFrame, expected: DataFrame, keywords: DataFrame | None = None, uris: DataFrame | None = None) -> DataFrame:
    """answers(question_id, got, ...) with expected, keywords and expected_uris; an answer without expectation raises."""
    if missing := answers.join(expected, "question_id", "left_anti").first():
        raise ValueError(f"no expected answer for {missing['question_id']}")
    rows = answers.join(expected, "question_id")
    empty = F.array().cast("array<string>")
    if keywords is not None:
        rows = rows.join(keywords.select(F.col("position").alias("__p"), "keywords"), keyword_position(F.col("question_id")) == F.col("__p"), "left").drop("__p").withColumn("keywords", F.coalesce("keywords", empty))
    if uris is not None:
        rows = rows.join(uris.select("question_id", F.col("uris").alias("expected_uris")), "question_id", "left").withColumn("expected_uris", F.coalesce("expected_uris", empty))
    return rows


def evaluate(rows: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """keys, metric, value, status, details in long form: all metrics in one pass, in order of name."""
    columns = {c: F.col(c) for c in rows.columns}
    scored = rows.select(*keys, *(METRICS[m](columns).alias(m) for m in sorted(metrics)))
    long = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in sorted(metrics)))).alias("x")
    return scored.select(*keys, long).select(*keys, "x.metric", "x.score.*")


#: Queries that are planned as one job.
BATCH = 16


def uri_answers(questions: DataFrame, run: Callable[[str], DataFrame], class_uri: str = r"^$", most: int = 20) -> DataFrame:
    """questions(last_query, ...) with uris, recovery_used and uri_error, by running each distinct query.

    run(text) gives a raw ordered result (terms), of which the first `most` rows are read. A query that finds no URI is
    rewritten to ask for its driving variables and run again. A query or rewriting that cannot be planned gives an error
    text; a null query is missing_query. Query texts are planned on the driver, since each is a plan of its own; their
    results are not fetched: queries run `BATCH` to a job, and what they find is written and joined to the questions.
    """
    spark = questions.sparkSession
    texts = [r["last_query"] for r in questions.select("last_query").where("last_query IS NOT NULL").distinct().toLocalIterator()]

    def found(rewrite: Callable[[str], str], texts: list[str]) -> tuple[DataFrame, dict[str, str]]:
        """last_query, uri of the texts' results, and what cannot be planned."""
        out, errors = [], {}
        for k in range(0, len(texts), BATCH):
            frames = []
            for text in texts[k : k + BATCH]:
                try:
                    frames.append(uri_cells(run(rewrite(text)), class_uri, most).select(F.lit(text).alias("last_query"), "uri"))
                except (SparqlError, PySparkException) as e:
                    errors[text] = f"{type(e).__name__}: {e}"[:600]
            if frames:
                out.append(written(reduce(DataFrame.union, frames), "uris"))
        none = spark.createDataFrame([], "last_query string, uri string")
        return reduce(DataFrame.union, out, none), errors

    first, failed = found(lambda text: text, texts)
    have = {r["last_query"] for r in first.select("last_query").distinct().toLocalIterator()}
    second, failed_again = found(recovered, [t for t in texts if t not in have and t not in failed])
    uris = first.withColumn("again", F.lit(False)).union(second.withColumn("again", F.lit(True))).groupBy("last_query").agg(F.array_sort(F.collect_set("uri")).alias("found"))
    failed |= failed_again
    known = spark.createDataFrame([(t, None if t in failed else t not in have, failed.get(t)) for t in texts], "last_query string, recovery_used boolean, uri_error string")
    answers = known.join(uris, "last_query", "left").withColumn("uris", F.when(F.col("uri_error").isNull(), F.coalesce("found", F.array().cast("array<string>")))).drop("found")
    return questions.join(answers, "last_query", "left").withColumn("uri_error", F.when(F.col("last_query").isNull(), "missing_query").otherwise(F.col("uri_error")))


def run_filter(runs: DataFrame, model: str | None = None, questions_file: str | None = None) -> DataFrame:
    """Runs of exactly this model and questions file; what is not given does not restrict."""
    for c, wanted in (("llm.model", model), ("inputs.questionsFile", questions_file)):
        if wanted:
            runs = runs.where(F.col(c) == wanted)
    return runs


def run_identity(manifest_run: Column, meta_run: Column, folder: Column) -> Column:
    """The run's id: by the evaluation's manifest, else by the run's record, else the folder's name."""
    return F.coalesce(manifest_run, meta_run, F.regexp_extract(folder, r"([^/]+)/*$", 1))


def rule_of(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """runs(questions_file, ...) with the settings of rules(questions_file, ...) for their file, compared with / for \\ and
    trimmed; a file without settings raises."""
    keyed = runs.withColumn("__file", rel_path(F.col("questions_file")))
    named = rules.withColumn("__file", rel_path(F.col("questions_file"))).drop("questions_file")
    if missing := keyed.join(named, "__file", "left_anti").first():
        raise ValueError(f"no settings for {missing['questions_file']}")
    return keyed.join(named, "__file").drop("__file")


def single_rule(endpoints: DataFrame, rules: DataFrame) -> DataFrame:
    """endpoints(url) with the dataset of the one rules(pattern, dataset) whose pattern the url holds; none or several raise."""
    held = containing(endpoints.select("url").distinct(), "url", rules.select("pattern").distinct())
    hits = held.join(rules, "pattern", "left").groupBy("url").agg(F.count("dataset").alias("n"), F.min("dataset").alias("dataset"))
    if bad := hits.where("n <> 1").first():
        raise ValueError(f"{bad['n']} rules fit {bad['url']}")
    return hits.select("url", "dataset")


def latest_only(evaluations: DataFrame, latest: DataFrame) -> DataFrame:
    """Rows of the evaluation that each run's pointer latest(run_dir, latestEvalId) names."""
    return evaluations.join(latest, (evaluations["run_dir"] == latest["run_dir"]) & (evaluations["evalId"] == latest["latestEvalId"]), "left_semi")


def uri_cells(result: DataFrame, class_uri: str = r"^$", most: int = 20) -> DataFrame:
    """Distinct IRIs among the first rows of an ordered raw result, without class IRIs."""
    cells = F.explode(F.array(*(F.col(f"`{c}`") for c in result.columns))).alias("t")
    inner = F.regexp_extract("t", "^<(.*)>$", 1)
    return result.limit(most).select(cells).where(F.col("t").startswith("<")).select(inner.alias("uri")).where(~F.col("uri").rlike(class_uri)).distinct()

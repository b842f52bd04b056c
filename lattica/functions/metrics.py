"""Answer metrics. Each gives a struct (value double, status string, details map): OK, SKIPPED or ERROR.

Encoders and judges are not run here: vectors and recorded judge outputs are input columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm, squeeze

SCORE = "struct<value: double, status: string, details: map<string, string>>"


def score(value: Column, status: str = "OK", details: Column | None = None) -> Column:
    return F.struct(value.cast("double").alias("value"), F.lit(status).alias("status"), (details if details is not None else F.lit(None).cast("map<string,string>")).alias("details"))


def skipped(why: str) -> Column:
    return score(F.lit(None), "SKIPPED", F.create_map(F.lit("reason"), F.lit(why)))


def blank(c: Column) -> Column:
    return F.coalesce(squeeze(c), F.lit("")) == ""


def keyword_count_exact_match(got: Column, keywords: Column) -> Column:
    """Share of keywords that occur in the answer, both normalised; repeated keywords count each."""
    # The normalised answer is bound once, as the one element of an array: inside the filter it would be made for each keyword.
    answer = F.array(F.coalesce(norm(got), F.lit("")))
    hits = F.transform(answer, lambda a: F.size(F.filter(keywords, lambda k: F.contains(a, norm(k)))))[0]
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, skipped("no keywords")).otherwise(score(hits / F.size(keywords)))


def keyword_counter_agent(got: Column, keywords: Column, judged: Column) -> Column:
    """Share matched by a recorded judge: JSON, else its first { to last }; the count is held within the list's size."""
    parsed = F.coalesce(F.get_json_object(judged, "$.matchedCount"), F.get_json_object(F.regexp_extract(judged, r"(?s)(\{.*\})", 1), "$.matchedCount")).try_cast("double")
    n = F.size(keywords)
    held = F.least(F.greatest(parsed, F.lit(0.0)), n.cast("double"))
    ok = F.when(parsed.isNull(), score(F.lit(None), "ERROR", F.create_map(F.lit("message"), F.lit("judge output is no JSON")))).otherwise(score(held / n))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, skipped("no keywords")).when(blank(got), score(F.lit(0.0))).otherwise(ok)


def llm_judge_majority(got: Column, votes: Column) -> Column:
    """1 if at least two of the recorded outputs say PASS: exactly, or as the first of PASS and FAIL found."""
    one = lambda v: F.regexp_extract(F.upper(F.coalesce(v, F.lit(""))), "(PASS|FAIL)", 1) == "PASS"
    passed = F.size(F.filter(votes, one))
    return F.when(blank(got), score(F.lit(0.0))).otherwise(score(F.when(passed >= 2, 1.0).otherwise(0.0)))


def judge_score(v: Column) -> Column:
    """1 to 5: JSON score, else the first lone digit 1-5, else 1; halves are rounded up."""
    found = F.coalesce(F.get_json_object(v, "$.score").try_cast("double"), F.regexp_extract(v, r"\b([1-5])\b", 1).try_cast("double"), F.lit(1.0))
    return F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.floor(found + 0.5).cast("double")))


def llm_judge_score_avg(got: Column, votes: Column) -> Column:
    total = F.aggregate(F.transform(votes, judge_score), F.lit(0.0), lambda a, b: a + b)
    return F.when(blank(got), score(F.lit(1.0))).otherwise(score(total / F.size(votes)))


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector stays zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def cosine_similarity(got: Column, expected: Column, got_vector: Column, expected_vector: Column) -> Column:
    return F.when(blank(expected), skipped("no expected answer")).when(blank(got), score(F.lit(0.0))).otherwise(score(unit_cosine(got_vector, expected_vector)))


def unit(v: Column) -> Column:
    """The vector by its length; a zero vector stays zero."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0)))


def bert_core(got: Column, expected: Column) -> Column:
    """F1 of greedy matching between two lists of token vectors: P over candidate rows, R over reference rows. Vectors are
    normalised once, and one table of products gives the maxima of both directions."""
    others = F.transform(expected, unit)
    table = F.transform(F.transform(got, unit), lambda x: F.transform(others, lambda y: dot(x, y)))
    mean = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)
    down = lambda rows: F.transform(F.get(rows, F.lit(0)), lambda _, j: F.array_max(F.transform(rows, lambda row: F.get(row, j))))
    best = F.transform(F.array(table), lambda t: F.struct(mean(F.transform(t, F.array_max)).alias("p"), mean(down(t)).alias("r")))
    f = F.get(F.transform(best, lambda b: F.when(b["p"] + b["r"] > 0, 2 * b["p"] * b["r"] / (b["p"] + b["r"])).otherwise(F.lit(0.0))), F.lit(0))
    empty = (F.coalesce(F.size(got), F.lit(0)) <= 0) | (F.coalesce(F.size(expected), F.lit(0)) <= 0)
    return F.when(empty, score(F.lit(0.0))).otherwise(score(f))


def set_recall(expected: Column, actual: Column) -> Column:
    e, a = F.array_distinct(expected), F.array_distinct(actual)
    hit = F.size(F.array_intersect(e, a))
    return F.when(F.size(e) > 0, hit / F.size(e)).when(F.size(a) == 0, 1.0).otherwise(0.0)


def set_precision(expected: Column, actual: Column) -> Column:
    e, a = F.array_distinct(expected), F.array_distinct(actual)
    hit = F.size(F.array_intersect(e, a))
    return F.when(F.size(e) == 0, F.when(F.size(a) == 0, 1.0).otherwise(0.0)).when(F.size(a) == 0, 0.0).otherwise(hit / F.size(a))


def chrf_values(got: list[str], expected: list[str], most: int = 6) -> np.ndarray:
    """Character n-gram F1 of each pair, white space removed, orders 1 to `most` averaged; an order longer than a text gives
    0. All texts of a batch are worked on together: a gram's number is made of that of the gram one shorter and the next
    character, and equal (pair, gram) are counted by sorting."""
    texts = [re.sub(r"\s+", "", t) for t in (*got, *expected)]
    k = len(got)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    characters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    text = np.repeat(np.arange(2 * k), sizes)
    ends = np.cumsum(sizes)[text] if len(text) else np.zeros(0, dtype=np.int64)
    at, grams = np.arange(len(characters)), np.zeros(len(characters), dtype=np.int64)
    p, r = np.zeros(k), np.zeros(k)
    for n in range(1, most + 1):
        fits = at + n <= ends[at]
        at, grams = at[fits], grams[fits]
        grams = np.unique(grams << 21 | characters[at + n - 1], return_inverse=True)[1].astype(np.int64)
        pair, mine = text[at] % max(k, 1), text[at] < k
        keys = [np.unique(pair[m] * (len(grams) + 1) + grams[m], return_counts=True) for m in (mine, ~mine)]
        both, x, y = np.intersect1d(keys[0][0], keys[1][0], assume_unique=True, return_indices=True)
        hit = np.bincount(both // (len(grams) + 1), weights=np.minimum(keys[0][1][x], keys[1][1][y]), minlength=k)
        p += hit / np.maximum(sizes[:k] - n + 1, 1)
        r += hit / np.maximum(sizes[k:] - n + 1, 1)
    p, r = p / most, r / most
    return np.divide(2 * p * r, p + r, out=np.zeros(k), where=p + r > 0)


def chrf_value(got: str, expected: str, most: int = 6) -> float:
    return float(chrf_values([got], [expected], most)[0])


#: Marks that end a sentence, besides line ends; a word is a run of letters and digits, joined by these.
SENTENCE_END = r"[.!?\u3002\uFF01\uFF1F]+|\r?\n+"
WORD = r"[^\W_]+(?:['\u2019\-][^\W_]+)*"


def sentences(text: str) -> list[list[str]]:
    """Words by sentence, sentences without words left out."""
    return [w for s in re.split(SENTENCE_END, text) if (w := re.findall(WORD, s))]


def lcs_union(reference: np.ndarray, candidates: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which places of reference (numbers of words) are on a longest common subsequence with any of the candidates (a row
    each of words' numbers, -1 after its size); on a tie the walk back moves up the reference.

    A row of lengths is the running maximum of the row above and of what its matches extend, for all candidates at once. In
    each row the walk stands at the last place up to where it was that matches or that the row above is as long at.
    """
    k, m = candidates.shape
    length, stops, matches = np.zeros((k, m + 1), dtype=np.int32), [], []
    places, each = np.arange(1, m + 1), np.arange(k)
    for w in reference:
        match = candidates == w
        row = np.zeros((k, m + 1), dtype=np.int32)
        np.maximum.accumulate(np.maximum(length[:, 1:], np.where(match, length[:, :-1] + 1, 0)), axis=1, out=row[:, 1:])
        stop = np.zeros((k, m + 1), dtype=np.int64)
        np.maximum.accumulate(np.where(match | (length[:, 1:] >= row[:, :-1]), places, 0), axis=1, out=stop[:, 1:])
        stops.append(stop)
        matches.append(match)
        length = row
    hit, at = np.zeros(len(reference), dtype=bool), np.asarray(sizes, dtype=np.int64).copy()
    for j in range(len(reference) - 1, -1, -1):
        at = stops[j][each, at]
        taken = (at > 0) & matches[j][each, at - 1]
        hit[j] = taken.any()
        at = at - taken
    return hit


def lcs_positions(reference: list[str], candidate: list[str]) -> set[int]:
    """Places in reference of a longest common subsequence with one candidate."""
    if not reference or not candidate:
        return set()
    number = {w: k for k, w in enumerate({*reference, *candidate})}
    hit = lcs_union(np.array([number[w] for w in reference]), np.array([[number[w] for w in candidate]]), np.array([len(candidate)]))
    return set(np.flatnonzero(hit).tolist())


def rouge_l_value(got: str, expected: str) -> float:
    """ROUGE-L F1 with union LCS: for each reference sentence, over all candidate sentences."""
    cand, ref = sentences(got), sentences(expected)
    n, m = sum(map(len, cand)), sum(map(len, ref))
    if not n or not m:
        return 0.0
    number: dict[str, int] = {}
    for w in (w for s in (*cand, *ref) for w in s):
        number.setdefault(w, len(number))
    sizes = np.array([len(c) for c in cand])
    words = np.full((len(cand), sizes.max()), -1)
    words[np.arange(sizes.max()) < sizes[:, None]] = [number[w] for c in cand for w in c]
    hit = sum(int(lcs_union(np.array([number[w] for w in r]), words, sizes).sum()) for r in ref)
    p, r = hit / n, hit / m
    return 2 * p * r / (p + r) if p > 0 and r > 0 else 0.0


def rouge_l_jackknife(got: str, references: list[str]) -> float:
    """Mean of leave-one-out maxima over several references."""
    values = [rouge_l_value(got, r) for r in references]
    if len(values) < 2:
        return values[0] if values else 0.0
    return float(np.mean([max(values[:k] + values[k + 1 :]) for k in range(len(values))]))


def _paired(function: Callable[[list[str], list[str]], list[float]], got: Column, expected: Column) -> Column:
    def run(g: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series(function([x or "" for x in g], [x or "" for x in e]), dtype="float64")

    value = F.pandas_udf(run, "double")(got, expected)
    return F.when(blank(expected), skipped("no expected answer")).otherwise(score(value))


def chrf(got: Column, expected: Column) -> Column:
    return _paired(chrf_values, got, expected)


def rouge_l_f1(got: Column, expected: Column) -> Column:
    return _paired(lambda g, e: list(map(rouge_l_value, g, e)), got, expected)


def uri_metric(recall: bool = True, on_error: str = "throw") -> Callable[[dict], Column]:
    """A metric of the columns expected_uris, uris (what the recorded query found), uri_error and recovery_used, as
    `evaluate.uri_answers` gives them.

    A question without a list of expected URIs, without a query, or whose query fails is an error: with on_error "throw"
    the status is ERROR and the value null, with "zero" the status is OK, the value 0 and the details say so.
    """
    if on_error not in ("throw", "zero"):
        raise ValueError("on_error is throw or zero")

    def metric(c: dict) -> Column:
        error = F.when(c["expected_uris"].isNull(), F.lit("invalid_input")).otherwise(c["uri_error"])
        wanted = F.array_distinct(F.filter(F.transform(c["expected_uris"], lambda u: F.trim(u)), lambda u: u != ""))
        value = (set_recall if recall else set_precision)(wanted, c["uris"])
        text = lambda v: v.cast("string")
        details = F.create_map(F.lit("recoveryUsed"), text(c["recovery_used"]), F.lit("expectedCount"), text(F.size(wanted)), F.lit("actualCount"), text(F.size(c["uris"])), F.lit("intersectionCount"), text(F.size(F.array_intersect(wanted, c["uris"]))))
        message = F.create_map(F.lit("error"), error)
        failed = score(F.lit(None), "ERROR", message) if on_error == "throw" else score(F.lit(0.0), "OK", F.map_concat(message, F.create_map(F.lit("degradedByError"), F.lit("true"), F.lit("errorMode"), F.lit("zero"))))
        return F.when(error.isNotNull(), failed).otherwise(score(value, "OK", details))

    return metric


#: name -> function of the columns it needs, by name.
METRICS: dict[str, Callable[[dict], Column]] = {
    "keyword_count_exact_match": lambda c: keyword_count_exact_match(c["got"], c["keywords"]),
    "keyword_counter_agent": lambda c: keyword_counter_agent(c["got"], c["keywords"], c["judged_keywords"]),
    "rouge_l_f1": lambda c: rouge_l_f1(c["got"], c["expected"]),
    "chrf": lambda c: chrf(c["got"], c["expected"]),
    "bertscore": lambda c: bert_core(c["got_tokens"], c["expected_tokens"]),
    "llm_judge_majority": lambda c: llm_judge_majority(c["got"], c["votes"]),
    "llm_judge_score_avg": lambda c: llm_judge_score_avg(c["got"], c["ratings"]),
    "cosine_similarity": lambda c: cosine_similarity(c["got"], c["expected"], c["got_vector"], c["expected_vector"]),
    "model_element_uri_recall": uri_metric(recall=True),
    "model_element_uri_precision": uri_metric(recall=False),
}


def register(name: str, metric: Callable[[dict], Column]) -> None:
    METRICS[name] = metric


def list_metrics() -> list[str]:
    return sorted(METRICS)

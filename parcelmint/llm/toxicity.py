"""Toxicity by maximum-scoring segments over token log-odds.

The toxic and clean labelled documents that hold a token are counted, all of them, and tokens get log-odds with a Dirichlet prior in
proportion to their total counts. What is certain of a token's log-odds, a lower confidence bound, is its score;
all other tokens cost a little. One linear scan finds every maximal segment of positive sum. Segments of random
clean text follow an extreme-value law, so a segment's score turns into the number of such segments expected by
chance; significant ones are the toxic passages, and a logistic curve on the expected numbers gives a document's
probability.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmint.llm.common import crc_mod, durable, table, text_batches, unit_hash
from parcelmint.llm.langid import texts_in
from parcelmint.llm.quality import labelled
from parcelmint.llm.shingles import NOT_LETTERS, words_in

_BYTES = 500_000


@dataclass
class SegmentModel:
    """Scores of the tokens that speak for toxicity, by hash; what other tokens cost; the extreme-value law; the curve."""

    tokens: np.ndarray
    scores: np.ndarray
    cost: float
    rate: float
    scale: float
    curve: np.ndarray
    expected: float = 0.05

    def segments(self, word: np.ndarray) -> list[tuple[int, int, float]]:
        """Every maximal-scoring segment (from, to, score) of a text's tokens.

        Between tokens with positive scores only costs add up, so the scan visits those tokens alone. A token right
        after itself is no new evidence and costs like any other. The list
        keeps, for each segment, the sums before and after it; a new one joins those that it dominates.
        """
        if not len(self.tokens) or not len(word):
            return []
        at = np.minimum(np.searchsorted(self.tokens, word), len(self.tokens) - 1)
        hits = np.flatnonzero((self.tokens[at] == word) & np.concatenate([[True], word[1:] != word[:-1]]))
        found: list[list] = []
        total, behind = 0.0, 0
        for i, s in zip(hits.tolist(), self.scores[at[hits]].tolist()):
            total -= self.cost * (i - behind)
            behind = i + 1
            new = [i, i + 1, total, total + s]
            total += s
            while True:
                k = len(found) - 1
                while k >= 0 and found[k][2] >= new[2]:
                    k -= 1
                if k < 0 or found[k][3] >= new[3]:
                    found.append(new)
                    break
                new = [found[k][0], new[1], found[k][2], new[3]]
                del found[k:]
        return [(a, b, right - left) for a, b, left, right in found]

    def evidence(self, score: float, n: int) -> float:
        """Minus the logarithm of how many segments of this score or more a clean text of n tokens is expected to have."""
        return self.rate * score - math.log(self.scale * max(n, 1))

    def features(self, word: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        """(1, the logarithm of 1 + the evidence of all passages rarer than one by chance), and the significant passages."""
        rare = [(a, b, e) for a, b, s in self.segments(word) if (e := self.evidence(s, len(word))) > 0]
        kept = [(a, b, math.exp(-e)) for a, b, e in rare if e > -math.log(self.expected)]
        return np.array([1.0, self.total_evidence([e for *_, e in rare])]), kept

    @staticmethod
    def total_evidence(rare: list[float]) -> float:
        return math.log1p(sum(rare))

    def probability(self, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.curve)))))


#: Numbers of documents by fold and label.
_COUNTS = ["clean_0", "toxic_0", "clean_1", "toxic_1"]


def _counter() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, first, size in texts_in(batch.column(0), _BYTES):
                if not len(data):
                    continue
                word, _, _, lo, hi = words_in(data, first, size, NOT_LETTERS)
                held = [np.unique(word[i:j]) for i, j in zip(lo, hi)]
                y, fold = (batch.column(c).slice(a, b - a).to_numpy() for c in (1, 2))
                kind = np.repeat(2 * fold + y, [len(x) for x in held])
                tokens, place = np.unique(np.concatenate(held), return_inverse=True)
                counts = [np.bincount(place[kind == k], minlength=len(tokens)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (tokens, *counts)], ["token", *_COUNTS])

    return run


def _rate(scores: np.ndarray, chance: np.ndarray, cost: float) -> float:
    """The positive root of the mean of exp(rate * score) = 1 over clean tokens, by halving."""
    rest = max(0.0, 1 - chance.sum())
    excess = lambda r: float((chance * np.exp(np.minimum(r * scores, 600))).sum() + rest * math.exp(-r * cost) - 1)
    low, high = 1e-6, 50.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - y) + 1e-2 * w)
        w = w - step
        if abs(step).max() < 1e-8:
            break
    return w


def _segmenter(models: list[SegmentModel]) -> Callable:
    """For each text (text, y, fold): its tokens and the scores of its segments, by the model of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, first, size in texts_in(batch.column(0), _BYTES):
                word, _, _, lo, hi = words_in(data, first, size, NOT_LETTERS) if len(data) else (np.zeros(0, np.uint64),) * 3 + (np.zeros(b - a, np.int64),) * 2
                y, fold = (batch.column(c).slice(a, b - a) for c in (1, 2))
                scores = [[s for *_, s in models[f].segments(word[i:j])] for f, i, j in zip(fold.to_pylist(), lo, hi)]
                tokens = pa.array((np.asarray(hi) - np.asarray(lo)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([y, fold, tokens, pa.array(scores, pa.list_(pa.float64()))], ["y", "fold", "tokens", "scores"])

    return run


def _law_scale(rates: np.ndarray, tokens: np.ndarray, most: np.ndarray) -> float:
    """The scale of the extreme-value law by maximum likelihood, from clean texts: their tokens, their largest segment's score and the rate.

    By the law, tokens * exp(-rate * largest score) is an exponential number with the scale as its rate.
    """
    reached = (np.maximum(tokens, 1) * np.exp(-rates * most)).sum()
    return float(min(1.0, max(1e-6, len(tokens) / max(reached, 1e-300))))


def train(docs: DataFrame, labels: DataFrame, name: str, learn: Column, prior: float = 0.1, deviations: float = 2.5, cost: float = 0.2, curve_rows: int = 4000) -> SegmentModel | None:
    """A model of the labelled rows that `learn` keeps; None unless both labels occur.

    prior: the prior's total count as a share of all counts. deviations: how many of its deviations a token's log-odds
    are lowered by before they count; the model has every token that is then above 0. curve_rows bounds the sample of
    texts that the law's scale and the logistic curve are fitted on; the counts cover all rows.

    The sample is scored by models that have not seen it: rows are dealt to two folds by their ids, and each fold is
    scored with the tokens of the other one. Where a fold lacks a label, the model of all rows stands in.
    """
    text_batches(docs.sparkSession)
    rows = labelled(docs, labels, name, learn).withColumn("fold", F.pmod(F.xxhash64(F.lit(37), "doc_id"), F.lit(2)).cast("int"))
    counts = rows.select("text", "y", "fold").mapInArrow(_counter(), ", ".join(f"{c} long" for c in ["token", *_COUNTS]))
    counts = durable(counts.groupBy("token").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    n = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS]).first()
    if not n["toxic_0"] + n["toxic_1"] or not n["clean_0"] + n["clean_1"]:
        return None

    def of(folds: tuple[int, ...]) -> SegmentModel:
        toxic, clean = (sum(F.col(f"{c}_{k}") for k in folds) for c in ("toxic", "clean"))
        all_toxic, all_clean = (float(sum(n[f"{c}_{k}"] for k in folds)) for c in ("toxic", "clean"))
        a = F.lit(prior) * (toxic + clean)
        # null where a class holds nothing else: such a token tells nothing
        odds = lambda k, total: F.log(F.try_divide(k + a, F.lit(total + prior * (all_toxic + all_clean)) - k - a))
        bound = odds(toxic, all_toxic) - odds(clean, all_clean) - F.lit(deviations) * F.sqrt(1 / (toxic + a) + 1 / (clean + a))
        top = counts.where((toxic + clean) > 0).select("token", bound.alias("score"), clean.alias("clean")).where("score > 0").toArrow()
        tokens = top["token"].to_numpy().view(np.uint64)
        order = np.argsort(tokens)
        scores = top["score"].to_numpy()[order]
        chance = (top["clean"].to_numpy()[order] + 0.5) / all_clean
        return SegmentModel(tokens[order], scores, cost, _rate(scores, chance, cost) if len(scores) else 1.0, 1.0, np.zeros(2))

    model = of((0, 1))
    split = all(n[c] for c in _COUNTS)
    unseen = [of((1,)), of((0,))] if split else [model, model]
    total = rows.count()
    some = rows.withColumn("order", unit_hash(F.lit(31), F.col("doc_id"))).where(F.col("order") < min(1.0, curve_rows / max(total, 1)))
    found = some.select("text", "y", "fold").mapInArrow(_segmenter(unseen), "y int, fold int, tokens long, scores array<double>").toPandas()
    rates = np.array([m.rate for m in unseen])[found["fold"].to_numpy(int)] if len(found) else np.zeros(0)
    most = np.array([max(s, default=0.0) for s in found["scores"]])
    clean = found["y"].to_numpy(int) == 0
    model.scale = _law_scale(rates[clean], found["tokens"].to_numpy(float)[clean], most[clean]) if clean.any() else 1.0
    x = [[1.0, m.total_evidence([e for s in scores if (e := m.evidence(s, t)) > 0])] for f, t, scores in zip(found["fold"], found["tokens"], found["scores"]) for m in [replace(unseen[f], scale=model.scale)]]
    model.curve = _fit_curve(np.array(x).reshape(-1, 2), found["y"].to_numpy(float))
    return model


def _scorer(model: SegmentModel | None, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, passages = np.full(batch.num_rows, 0.5), [[] for _ in range(batch.num_rows)]
            if model is not None:
                for a, b, data, first, size in texts_in(batch.column(batch.num_columns - 1), _BYTES):
                    word, start, end, lo, hi = words_in(data, first, size, NOT_LETTERS) if len(data) else (np.zeros(0, np.uint64),) * 3 + (np.zeros(b - a, np.int64),) * 2
                    for k, (i, j) in enumerate(zip(lo.tolist(), hi.tolist()), a):
                        x, kept = model.features(word[i:j])
                        score[k] = model.probability(x)
                        passages[k] = [{"start": int(start[i + p] - first[k - a]), "end": int(end[i + q - 1] - first[k - a]), "by_chance": e} for p, q, e in kept]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array(passages, schema.field("passages").type)], schema=schema)

    return run


def score(docs: DataFrame, model: SegmentModel | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default doc_id) with score and passages, one row for each row.

    score: the probability of label 1, from 0 to 1. passages: every significant toxic passage, as (start, end) in
    bytes of the text's UTF-8 and the number of such passages that chance would give. Null and empty texts have
    none and get the curve's answer to that; without a model all scores are 0.5. Equal texts get equal results; no
    rows give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*keep, F.col("text").alias("text__"))
    schema = T.StructType([*(rows.schema[c] for c in keep), *T.StructType.fromDDL("score double, passages array<struct<start: long, end: long, by_chance: double>>")])
    return rows.mapInArrow(_scorer(model, to_arrow_schema(schema)), schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out of a row without an id is false; such a row is not learned from either."""
    docs, fold = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3)
    model = train(docs, table(spark, sf_dir, "labels"), "toxic", fold != 1)
    found = score(docs.withColumn("held_out", F.coalesce(fold == 1, F.lit(False))), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))

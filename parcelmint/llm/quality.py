"""Quality classifier: a byte-level convolutional network in numpy.

Filters over runs of bytes are learned from a bounded sample of labelled texts. A text is cut into overlapping
chunks that cover it whole; each filter's strongest answer in each chunk is kept, and their means over all chunks
give one probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmint.llm.common import crc_mod, small, table, text_batches, unit_hash
from parcelmint.llm.langid import texts_in

_CHUNKS = 512
_PAD = 0


@dataclass
class ByteConv:
    """Bytes are embedded, filters slide over `width` of them, chunks are max-pooled, texts are means of chunks."""

    filters: int = 16
    width: int = 7
    embed: int = 4
    chunk: int = 256
    overlap: int = 32
    seed: int = 3
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            self.weights = {
                # the last row is not used: what follows a text counts as the byte 0
                "embed": rng.normal(0, 1, (257, self.embed)).astype(np.float32),
                "filter": (rng.normal(0, 1, (self.width * self.embed, self.filters)) / np.sqrt(self.width * self.embed)).astype(np.float32),
                "shift": np.zeros(self.filters, np.float32),
                "out": (rng.normal(0, 1, self.filters) / np.sqrt(self.filters)).astype(np.float32),
                "bias": np.zeros(1, np.float32),
            }

    def layout(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Overlapping chunks of all texts: each one's text, first byte and size."""
        step = self.chunk - self.overlap
        n = np.where(size > 0, 1 + np.maximum(0, -(-(size - self.chunk) // step)), 0)
        text = np.repeat(np.arange(len(size)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        return text, first[text] + nth * step, np.minimum(self.chunk, size[text] - nth * step)

    def bytes_of(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = np.arange(self.chunk + self.width - 1)[None, :]
        return np.where(at < length[:, None], data[np.minimum(begin[:, None] + at, len(data) - 1)], _PAD)

    def _windows(self, x: np.ndarray) -> np.ndarray:
        e = self.weights["embed"][x]
        n, length, d = e.shape
        view = np.lib.stride_tricks.as_strided(e, (n, self.chunk, self.width * d), (e.strides[0], e.strides[1], e.strides[2]))
        return view.reshape(n * self.chunk, self.width * d)

    def pooled(self, x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks' strongest answers (n, filters), where they are, and the windows that they come from."""
        w = self._windows(x)
        a = (w @ self.weights["filter"]).reshape(len(x), self.chunk, self.filters)
        where = a.argmax(1)
        best = np.take_along_axis(a, where[:, None, :], 1)[:, 0] + self.weights["shift"]
        return np.maximum(best, 0), where, w

    def strongest(self, x: np.ndarray) -> np.ndarray:
        a = (self._windows(x) @ self.weights["filter"]).reshape(len(x), self.chunk, self.filters).max(1)
        return np.maximum(a + self.weights["shift"], 0)

    def probability(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(means @ self.weights["out"] + self.weights["bias"], -30, 30)))

    def score(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        text, begin, length = self.layout(data, first, size)
        sums, n = np.zeros((len(size), self.filters)), np.maximum(np.bincount(text, minlength=len(size)), 1)
        for a in range(0, len(text), _CHUNKS):
            some = slice(a, a + _CHUNKS)
            np.add.at(sums, text[some], self.strongest(self.bytes_of(data, begin[some], length[some])))
        return self.probability(sums / n[:, None])

    def fit(self, texts: list[list[bytes]], y: np.ndarray, weight: np.ndarray, steps: int = 400, batch: int = 48, rate: float = 0.01) -> ByteConv:
        """Adam on the weighted log loss. A text is a list of windows; each step takes a few windows of each text of a batch."""
        rng = np.random.default_rng(self.seed)
        mean, var = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for step in range(1, steps + 1):
            some = rng.integers(0, len(texts), batch)
            chunks, text = [], []
            for i, t in enumerate(some):
                for k in rng.permutation(len(texts[t]))[:3]:
                    chunks.append(texts[t][k][: self.chunk])
                    text.append(i)
            data = np.frombuffer(b"".join(chunks) or b" ", np.uint8)
            length = np.array([len(c) for c in chunks], np.int64)
            x = self.bytes_of(data, np.cumsum(length) - length, length)
            text = np.array(text, np.int64)
            n = np.bincount(text, minlength=batch)
            best, where, w = self.pooled(x, length)
            means = np.zeros((batch, self.filters), np.float32)
            np.add.at(means, text, best)
            means /= np.maximum(n, 1)[:, None]
            p = self.probability(means)
            d = ((p - y[some]) * weight[some] / weight[some].sum()).astype(np.float32)
            g = {"out": means.T @ d, "bias": d.sum(keepdims=True)}
            d_best = (d[:, None] * self.weights["out"] / np.maximum(n, 1)[:, None])[text] * (best > 0)
            g["shift"] = d_best.sum(0)
            rows = where + (np.arange(len(x)) * self.chunk)[:, None]
            g["filter"] = np.stack([w[rows[:, f]].T @ d_best[:, f] for f in range(self.filters)], 1)
            g["embed"] = np.zeros_like(self.weights["embed"])
            back = (d_best[:, :, None] * self.weights["filter"].T[None]).reshape(len(x), self.filters, self.width, self.embed)
            at = where[:, :, None] + np.arange(self.width)
            np.add.at(g["embed"], x[np.arange(len(x))[:, None, None], at], back)
            for k, v in g.items():
                mean[k] += 0.1 * (v - mean[k])
                var[k] += 0.01 * (v * v - var[k])
                now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
                self.weights[k] = (self.weights[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def labelled(docs: DataFrame, labels: DataFrame, name: str, learn: Column) -> DataFrame:
    """The rows of docs that `learn` keeps with their label y, 0 or 1: the mean of the id's labels, rounded; null labels are left out."""
    one = labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.when(F.avg(name) >= 0.5, 1).otherwise(0).alias("y"))
    return docs.select("doc_id", "text").where(learn).join(small(one), "doc_id")


def training_texts(rows: DataFrame, per_class: int, windows: int, chars: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Windows, labels and weights of at most per_class rows of each class, taken by hash of the id; weights restore the classes' shares."""
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], np.zeros(0), np.zeros(0)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.1 * per_class / n)))])
    rows = rows.withColumn("order", unit_hash(F.lit(21), F.col("doc_id"))).where(F.col("order") < share[F.col("y")])
    n = F.coalesce(F.length("text"), F.lit(0))
    count = F.least(F.lit(windows), F.ceil(n / chars)).cast("int")
    places = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring("text", (F.floor((i - 1) * F.greatest(n - chars, F.lit(0)) / F.greatest(count - 1, F.lit(1))) + 1).cast("int"), F.lit(chars)))
    found = sorted(rows.select("y", "order", "doc_id", F.coalesce(places, F.array()).alias("w")).collect(), key=lambda r: (r["order"], r["doc_id"]))
    kept = [r for y in sorted(counts) for r in [r for r in found if r["y"] == y][:per_class]]
    took = {y: sum(r["y"] == y for r in kept) for y in counts}
    y = np.array([r["y"] for r in kept])
    return [[x.encode() for x in r["w"] if x] for r in kept], y, np.array([counts[k] / took[k] for k in y]) / sum(counts.values())


def train(docs: DataFrame, labels: DataFrame, name: str, learn: Column, per_class: int = 1500, windows: int = 8, steps: int = 400) -> ByteConv | None:
    """A network fitted on the labelled rows that `learn` keeps; None if there are none.

    per_class bounds the sample: so many texts of each label, of each up to `windows` windows spread over all of it.
    """
    texts, y, weight = training_texts(labelled(docs, labels, name, learn), per_class, windows, 256)
    return ByteConv().fit(texts, y, weight, steps) if texts else None


def _scorer(model: ByteConv | None, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if model is not None:
                for a, b, data, first, size in texts_in(batch.column(batch.num_columns - 1), 1_000_000):
                    score[a:b] = model.score(data, first, size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], schema=schema)

    return run


def score(docs: DataFrame, model: ByteConv | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default doc_id) with score, one row for each row.

    score: the probability of label 1, from 0 to 1. Null and empty texts have no chunks and get the network's
    answer to none; without a model all scores are 0.5. Equal texts get equal scores; no rows give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    text_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*keep, F.col("text").alias("text__"))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scorer(model, to_arrow_schema(schema)), schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out of a row without an id is false; such a row is not learned from either."""
    docs, fold = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 4)
    model = train(docs, table(spark, sf_dir, "labels"), "quality", fold != 2)
    found = score(docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False))), model, ["doc_id", "held_out"])
    return found.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))

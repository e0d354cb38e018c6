"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled text windows. It
labels every byte of a text with the probability of each language, and a document's probabilities are the means
over its bytes. Documents are cut into windows that are scored side by side, so a long text costs as much as
many short ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmint.llm.common import crc_mod, lean, table, text_batches, unit_hash

UNDETERMINED = "und"
#: Bytes of text and windows that a task scores at a time.
_BYTES, _WINDOWS = 500_000, 2048


def _gate(x: np.ndarray) -> np.ndarray:
    """A piecewise linear sigmoid."""
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1)


@dataclass
class ByteGru:
    """Two gated recurrent layers, one for each direction, and a softmax over the languages at every byte."""

    languages: list[str]
    hidden: int = 8
    seed: int = 5
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.weights:
            rng, h = np.random.default_rng(self.seed), self.hidden
            for d in "fb":
                self.weights[f"table_{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
                self.weights[f"recur_{d}"] = (rng.normal(0, 1, (h, 3 * h)) / np.sqrt(h)).astype(np.float32)
                self.weights[f"out_{d}"] = (rng.normal(0, 1, (h, len(self.languages))) / np.sqrt(h)).astype(np.float32)
            self.weights["bias"] = np.zeros(len(self.languages), np.float32)

    def _run(self, x: np.ndarray, active: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction at every step: x (steps, windows) bytes; the first active[t] windows have a byte at t."""
        steps, n = x.shape
        h, table_, recur = self.hidden, self.weights[f"table_{d}"], self.weights[f"recur_{d}"]
        states, state = np.zeros((steps, n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            m = active[t]
            before = state[:m]
            a, q = table_[x[t, :m]], before @ recur
            gates = _gate(a[:, : 2 * h] + q[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * q[:, 2 * h :])
            if keep is not None:
                keep.append((t, before.copy(), z, r, new, q[:, 2 * h :]))
            state[:m] = before + z * (new - before)
            states[t, :m] = state[:m]
        return states

    def positions(self, x: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Probabilities (steps, windows, languages) at every byte; zero where a window has none."""
        w = self.weights
        logits = self._run(x, active, "f") @ w["out_f"] + self._run(x, active, "b") @ w["out_b"] + w["bias"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[np.arange(x.shape[1])[None, :] >= active[:, None]] = 0
        return p

    def gradients(self, x: np.ndarray, active: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all bytes and its gradients by backpropagation through time; y: each window's language."""
        w, h, grads = self.weights, self.hidden, {}
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._run(x, active, d, kept[d]) for d in "fb"}
        logits = states["f"] @ w["out_f"] + states["b"] @ w["out_b"] + w["bias"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        mask = (np.arange(x.shape[1])[None, :] < active[:, None]).astype(np.float32)
        total = mask.sum()
        loss = float(-(np.log(p[:, np.arange(len(y)), y] + 1e-12) * mask).sum() / total)
        p[:, np.arange(len(y)), y] -= 1
        p *= (mask / total)[:, :, None]
        grads["bias"] = p.sum((0, 1))
        for d in "fb":
            grads[f"out_{d}"] = np.einsum("tnh,tnl->hl", states[d], p, optimize=True)
            out, recur, table_ = p @ w[f"out_{d}"].T, w[f"recur_{d}"], np.zeros_like(w[f"table_{d}"])
            d_recur, carried = np.zeros_like(recur), np.zeros((x.shape[1], h), np.float32)
            rows, bytes_ = [], []
            for t, before, z, r, new, q in reversed(kept[d]):
                m = len(before)
                dh = out[t, :m] + carried[:m]
                dn = dh * z * (1 - new * new)
                dz = dh * (new - before) * np.float32(0.25) * ((z > 0) & (z < 1))
                dr = dn * q * np.float32(0.25) * ((r > 0) & (r < 1))
                inner = np.concatenate([dz, dr, dn * r], 1)
                d_recur += before.T @ inner
                carried[:m] = dh * (1 - z) + inner @ recur.T
                rows.append(np.concatenate([dz, dr, dn], 1))
                bytes_.append(x[t, :m])
            row, byte = np.concatenate(rows), np.concatenate(bytes_)
            order = np.argsort(byte, kind="stable")
            held, first = np.unique(byte[order], return_index=True)
            table_[held] = np.add.reduceat(row[order], first)
            grads[f"table_{d}"], grads[f"recur_{d}"] = table_, d_recur
        return loss, grads

    def fit(self, windows: list[bytes], y: np.ndarray, steps: int = 300, batch: int = 192, rate: float = 0.01) -> ByteGru:
        """Adam over random batches of windows."""
        rng = np.random.default_rng(self.seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        var = {k: np.zeros_like(v) for k, v in self.weights.items()}
        data = np.frombuffer(b"".join(windows), np.uint8)
        size = np.array([len(w) for w in windows])
        first = np.cumsum(size) - size
        for step in range(1, steps + 1):
            some = rng.choice(len(windows), min(batch, len(windows)), replace=False)
            some = some[np.argsort(-size[some], kind="stable")]
            x, active = _layout(data, first[some], size[some])
            _, grads = self.gradients(x, active, y[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                mean[k] += 0.1 * (g - mean[k])
                var[k] += 0.01 * (g * g - var[k])
                now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
                self.weights[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
        """For each text data[first : first + size]: mean probabilities over its bytes (zero for an empty one)."""
        pieces = -(-size // window)
        doc = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, length = first[doc] + nth * window, np.minimum(window, size[doc] - nth * window)
        order = np.argsort(-length, kind="stable")
        sums = np.zeros((len(size), len(self.languages)))
        for a in range(0, len(order), _WINDOWS):
            some = order[a : a + _WINDOWS]
            x, active = _layout(data, begin[some], length[some])
            np.add.at(sums, doc[some], self.positions(x, active).sum(0))
        return sums / np.maximum(size, 1)[:, None]


def _layout(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows, the longest first, as columns of bytes, and how many have a byte at each step."""
    steps = int(size.max())
    at = np.minimum(first[None, :] + np.arange(steps)[:, None], len(data) - 1)
    return data[at], (size[None, :] > np.arange(steps)[:, None]).sum(1)


def texts_in(column: pa.Array, most: int = _BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a column's texts of about `most` bytes: from, to, bytes, first byte and size of each text (null: empty)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    size = np.diff(offsets) * column.is_valid().to_numpy(zero_copy_only=False)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most)))
        b = min(b, len(column))
        low = offsets[a]
        yield a, b, data[low : offsets[b]], offsets[a:b] - low, size[a:b]
        a = b


def training_windows(docs: DataFrame, learn: Column, per_language: int, chars: int) -> list[tuple[str, str]]:
    """(lang, window) of at most per_language rows of each language, taken by hash of the id, each window at a hashed place of its text."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.1 * per_language / n)))])
    rows = rows.withColumn("order", unit_hash(F.lit(11), F.col("doc_id"))).where(F.col("order") < share[F.col("lang")])
    place = F.floor(unit_hash(F.lit(12), F.col("doc_id")) * F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1
    found = rows.select("lang", "order", F.substring("text", place.cast("int"), F.lit(chars)).alias("window")).collect()
    kept: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["order"], r["lang"], r["window"])):
        kept.setdefault(r["lang"], []).append(r["window"])
    return [(lang, w) for lang in sorted(kept) for w in kept[lang][:per_language]]


def train(docs: DataFrame, learn: Column | None = None, per_language: int = 1000, chars: int = 96, hidden: int = 8, steps: int = 300) -> ByteGru | None:
    """A network fitted on the labelled rows (text, lang, doc_id) that `learn` keeps; None if there are none.

    per_language bounds the sample: so many windows of so many characters for each language.
    """
    sample = training_windows(docs.select("doc_id", "text", "lang"), F.lit(True) if learn is None else learn, per_language, chars)
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    y = np.array([languages.index(lang) for lang, _ in sample])
    return ByteGru(languages, hidden).fit([w.encode()[: 2 * chars] for _, w in sample], y, steps)


def _predictor(model: ByteGru | None, schema: pa.Schema, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, best, score = batch.num_rows, np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if model is not None:
                for a, b, data, first, size in texts_in(batch.column(batch.num_columns - 1)):
                    if size.any():
                        p = model.pooled(data, first, size, window)
                        best[a:b] = np.where(size > 0, p.argmax(1), -1)
                        score[a:b] = np.where(size > 0, np.clip(p.max(1), 0, 1), 0)
            names = np.array([*(model.languages if model else []), UNDETERMINED], dtype=object)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best].tolist() if n else [], pa.string()), pa.array(score, pa.float64())], schema=schema)

    return run


def identify(docs: DataFrame, model: ByteGru | None, keep: list[str] | None = None, window: int = 128) -> DataFrame:
    """The columns `keep` of docs (default doc_id) with lang_pred and score, one row for each row.

    lang_pred is a learned language, or "und" with score 0 if the text is null or has no letter, or nothing was
    learned. score: the mean probability of that language over the text's bytes. Rows that repeat get equal
    results; no rows give no rows. `keep` must not name lang_pred or score.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    text_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*keep, F.when(F.rlike("text", F.lit(r"\p{L}")), F.col("text")).alias("text__"))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(lean(_predictor(model, to_arrow_schema(schema), window)), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out of a row without an id is false; such a row is not learned from either."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_mod(F.col("doc_id"), 5)
    model = train(docs, fold != 0)
    return identify(docs.withColumn("held_out", F.coalesce(fold == 0, F.lit(False))), model, ["doc_id", "held_out"])

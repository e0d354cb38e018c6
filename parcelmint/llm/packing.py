"""Packing documents into windows with bounded-space online best fit.

Every partition tokenizes its documents in turn and keeps a fixed number of windows open. A piece goes to the window
that it fills best; when it fits none, the fullest window is filled up with the piece's start and emitted, and
the rest takes its place. Open windows at the end of a partition are merged, in groups of partitions, level by
level, until one small group is left; that group's last tokens are cut at powers of two, which need no padding.
A task holds its open windows and one batch of texts at a time.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmint.llm.common import durable, lean, table, text_batches

_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, emitted boolean, ids binary"
#: Bytes of text that are tokenized at a time, and words that a task remembers.
_BYTES, _WORDS = 1_000_000, 200_000


def _gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[first : first + size] of every piece, one after another, and where each piece ends."""
    upto = np.cumsum(size)
    if not len(upto):
        return flat[:0], upto
    return flat[np.arange(upto[-1]) + np.repeat(first - upto + size, size)], upto


class WordTokenizer:
    """Token ids of texts by a tokenizer whose pieces never span white space: distinct words are encoded once.

    Words are split at ASCII white space only; whatever else the tokenizer takes for space it finds within them.
    A word of Latin letters and then punctuation is its letters' ids, case folded, and its punctuation's; any
    other word is encoded as it is.
    """

    PLAIN = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[-.,!?%$#&*|;:]*)$"

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
        # byte-level models see a character's UTF-8 bytes: printable ones as themselves, the others from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.shown = {c: "".join(hidden.get(b, chr(b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str], flat: list[int], size: list[int]) -> None:
        for i, w in enumerate(words, len(self.known)):
            self.known[w] = i
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum([0, *size[:-1]], dtype=np.int64)[: len(size)]])
        self.size = np.concatenate([self.size, np.array(size, np.int64)])
        self.flat = np.concatenate([self.flat, np.array(flat, np.uint32)])

    def _places(self, words: pa.Array, plain: bool) -> np.ndarray:
        """The number of each word among the known ones. Plain: letters alone, which are one piece each to the tokenizer."""
        held = words.dictionary_encode()
        names = held.dictionary.to_pylist()
        new = [w for w in names if w not in self.known]
        if new:
            if plain:
                model = self.inner.model
                got = [[t.id for t in model.tokenize(w if w.isascii() else w.translate(self.shown))] for w in new]
            else:
                got = [e.ids for e in self.inner.encode_batch(new, add_special_tokens=False)]
            self._learn(new, [x for ids in got for x in ids], [len(x) for x in got])
        return np.fromiter((self.known[w] for w in names), np.int64, len(names))[held.indices.to_numpy()]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids end."""
        if len(self.known) > _WORDS:
            self._forget()
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = lists.flatten().dictionary_encode()
        parts = pc.extract_regex(words.dictionary, self.PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        place = np.zeros((len(plain), 2), np.int64)
        letters, marks = (pc.struct_field(parts.filter(parts.is_valid()), i) for i in (0, 1))
        place[plain, 0] = self._places(pc.utf8_lower(letters), True)
        place[plain, 1] = self._places(marks, False)
        place[~plain, 0] = self._places(words.dictionary.filter(pc.invert(parts.is_valid())), False)
        place[~plain, 1] = self._places(pa.array([""], pa.large_string()), False)[0]
        place = place.ravel()
        flat, upto = _gather(self.flat, self.first[place], self.size[place])
        upto = upto[1::2]
        size = np.diff(upto, prepend=0)
        index = words.indices.to_numpy()
        ids, ends = _gather(flat, (upto - size)[index], size[index])
        offsets = lists.offsets.to_numpy()
        return ids, np.concatenate([[0], ends])[offsets[1:] - offsets[0]]


@functools.lru_cache(1)
def _tokenizer(tokenizer: str) -> WordTokenizer:
    """A worker keeps its tokenizer, and the words that it knows, from task to task."""
    return WordTokenizer(tokenizer)


class Packer:
    """Open windows and what they emit. A piece: (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, least_cut: int, first_sequence: int, with_ids: bool) -> None:
        self.window, self.most, self.least_cut, self.next, self.with_ids = window, open_windows, least_cut, first_sequence, with_ids
        self.open: list[tuple[int, list]] = []
        self.out: list[tuple] = []

    def emit(self, pieces: list, emitted: bool = True) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            raw = ids.astype("<u4").tobytes()
            self.out.append((doc_id, start, len(ids), zlib.crc32(raw), doc_tokens, self.next, offset, emitted, raw if self.with_ids or not emitted else None))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray, start: int, doc_tokens: int) -> None:
        while len(ids):
            if len(ids) >= self.window:
                self.emit([(doc_id, start, ids[: self.window], doc_tokens)])
                ids, start = ids[self.window :], start + self.window
                continue
            fits = [(self.window - used, k) for k, (used, _) in enumerate(self.open) if used + len(ids) <= self.window]
            if fits:
                k = min(fits)[1]
                n = len(ids)
            elif len(self.open) < self.most:
                self.open.append((len(ids), [(doc_id, start, ids, doc_tokens)]))
                return
            else:
                k = max(range(len(self.open)), key=lambda k: self.open[k][0])
                n = self.window - self.open[k][0]
                n = n if n >= self.least_cut else 0
            used, pieces = self.open[k]
            if n:
                pieces = [*pieces, (doc_id, start, ids[:n], doc_tokens)]
                ids, start = ids[n:], start + n
            if used + n == self.window or not fits:
                self.emit(pieces)
                self.open.pop(k)
            else:
                self.open[k] = (used + n, pieces)

    def leave(self) -> None:
        for _, pieces in self.open:
            self.emit(pieces, emitted=False)
        self.open = []

    def finish(self) -> None:
        """Emit what is open: full windows, then the rest cut at powers of two, the largest first."""
        rest = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        left = sum(len(p[2]) for p in rest)
        self.open = []
        while left:
            room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                doc_id, start, ids, doc_tokens = rest.pop(0)
                pieces.append((doc_id, start, ids[:room], doc_tokens))
                if len(ids) > room:
                    rest.insert(0, (doc_id, start + room, ids[room:], doc_tokens))
                room -= len(pieces[-1][2])
            self.emit(pieces)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * len(schema)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(doc_id: T.DataType, extra: str = "") -> T.StructType:
    return T.StructType([T.StructField("doc_id", doc_id), *T.StructType.fromDDL(_PIECE + extra)])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _first_stage(tokenizer: str, end_id: int, schema: pa.Schema, packer: Callable[[int], Packer]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = _tokenizer(tokenizer), packer(TaskContext.get().partitionId() << 32)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            cuts = np.flatnonzero(np.diff(sizes // _BYTES, prepend=0)) if len(sizes) else []
            for a, b in zip([0, *cuts], [*cuts, len(texts)]):
                ids, ends = encode(texts.slice(a, b - a))
                for doc_id, begin, end in zip(batch.column(0).slice(a, b - a).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    pack.add(doc_id, np.append(ids[begin:end], np.uint32(end_id)), 0, end - begin + 1)
                yield pack.batch(schema)
        pack.leave()
        yield pack.batch(schema)

    return run


def _merge(last: bool, level: int, schema: pa.Schema, packer: Callable[[int], Packer]) -> Callable:
    def run(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        if not rows:
            return schema.empty_table()
        pack = packer((level << 56) | (rows[0]["part"] << 32))
        for r in sorted(rows, key=lambda r: (-r["length"], r["sequence_id"], r["offset"])):
            pack.add(r["doc_id"], np.frombuffer(r["ids"], "<u4"), r["start"], r["doc_tokens"])
        pack.finish() if last else pack.leave()
        return pa.Table.from_batches([pack.batch(schema)])

    return run


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, window: int = 4096, open_windows: int = 16, least_cut: int = 16, fan_in: int = 16, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document's ids are its text's and then end_id. ids: little-endian unsigned 32-bit ids of the piece (null
    unless with_ids, but for pieces that were merged). A sequence emitted by a partition lacks fewer than
    least_cut tokens; the last ones' lengths are powers of two. fan_in: partitions whose open windows are merged
    by one task. tokenizer: a file's path, or its name among the public tokenizers.

    Null and empty texts are end_id alone; rows that repeat are packed each; null ids pass; no rows give no
    pieces; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    schema = _schema(docs.schema["doc_id"].dataType)
    arrow = _arrow(schema)

    def packer(first_sequence: int) -> Packer:
        return Packer(window, open_windows, least_cut, first_sequence, with_ids)

    pieces = durable(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(_first_stage(tokenizer, end_id, arrow, packer)), schema))
    out, level = pieces.where("emitted"), 0
    rest = pieces.where("not emitted").withColumn("part", F.shiftright("sequence_id", 32))
    parts = (rest.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level, parts = level + 1, -(-parts // fan_in)
        grouped = rest.withColumn("part", (F.col("part") / fan_in).cast("long")).groupBy("part")
        pieces = durable(grouped.applyInArrow(_merge(parts == 1, level, arrow, packer), schema))
        out = out.unionByName(pieces.where("emitted"))
        if parts == 1:
            return out.drop("emitted")
        rest = pieces.where("not emitted").withColumn("part", F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 56) - 1)), 32))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

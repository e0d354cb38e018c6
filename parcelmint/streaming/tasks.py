"""Tasks on a stream: their states, pasted pages that resume them, eviction after their end, and rolling logs, in keyed state.

Each has a batch operator that gives the same rows (operators/tasks, operators/relational); the tests replay streams
against them, restarts included.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parcelmint.operators.folders import work_folder
from parcelmint.operators.tasks import ENDED, OPENING, move
from parcelmint.streaming import ingest

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGNAL = "task long, seq long, at timestamp, signal string, html string"
VERDICT = "task long, seq long, at timestamp, signal string, verdict string, status string, generation int"
ENTRY = "task long, id long, at timestamp, level string, message string"
#: Fixed value: bytes that a pasted page has at most.
MOST_BYTES = 5 * 1024 * 1024


def with_states(spark: SparkSession) -> SparkSession:
    """spark with the state store that keyed state of several columns needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return spark


def _in_micros(rows: DataFrame) -> DataFrame:
    """rows with at as a number, which state holds and compares alike whatever the session's time zone is."""
    return rows.withColumn("micros", F.unix_micros("at"))


def _in_time(rows: DataFrame, kind: str) -> DataFrame:
    names = [x.split()[0] for x in kind.split(", ")]
    return rows.withColumn("at", F.timestamp_micros("micros")).select(*names)


def _stored(kind: str) -> str:
    return kind.replace("at timestamp", "micros long")


class TaskLife(StatefulProcessor):
    """One task: its state, its generation, the youngest signal, and what it has read; forgotten some minutes after its end.

    A signal that was read before, as a replay brings it, gives no row and changes nothing.
    """

    def __init__(self, minutes: int) -> None:
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "status string, generation int, youngest long, ended long")
        self.read = handle.getMapState("read", "seq long", "verdict string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        status, generation, youngest, ended = self.task.get() if self.task.exists() else ("none", 0, None, None)
        for r in sorted(rows, key=lambda r: r.seq):
            if self.read.containsKey((r.seq,)):
                continue
            verdict, to = self._judged(r, status, youngest)
            if verdict == "applied":
                status, generation = to, generation + (r.signal in OPENING)
                if status in ENDED:
                    ended = r.micros
                    self.handle.registerTimer(r.micros // 1000 + self.minutes * 60_000 + 1)
            youngest = max((x for x in (youngest, r.micros) if x is not None), default=None)
            self.read.updateValue((r.seq,), (verdict,))
            yield Row(task=key[0], seq=r.seq, micros=r.micros, signal=r.signal, verdict=verdict, status=status, generation=generation)
        self.task.update((status, generation, youngest, ended))

    def _judged(self, r: Row, status: str, youngest: int | None) -> tuple[str, str | None]:
        if r.micros is not None and youngest is not None and r.micros < youngest:
            return "late", None
        if r.signal == "paste" and not (r.html or "").strip():
            return "empty", None
        if r.signal == "paste" and len(r.html.encode()) > MOST_BYTES:
            return "too large", None
        to = move(status, r.signal)
        return ("applied", to) if to else ("illegal", None)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.task.exists():
            status, generation, _, ended = self.task.get()
            self.task.clear()
            self.read.clear()
            yield Row(task=key[0], seq=None, micros=ended, signal=None, verdict="evicted", status=status, generation=generation)

    def close(self) -> None:
        pass


def lives(signals: DataFrame, minutes: int = 10, lateness: str = "0 seconds") -> DataFrame:
    """A row of VERDICT for each signal of a stream (SIGNAL), and one when a task is forgotten: when the stream's time has passed its end by so many minutes.

    Signals are taken in the order of arrival and, in a batch, of seq. Pasted pages that are empty or too large are
    told so and resume nothing. lateness: how far behind the stream's time a signal may come.
    """
    with_states(signals.sparkSession)
    rows = _in_micros(signals).withWatermark("at", lateness)
    return _in_time(rows.groupBy("task").transformWithState(TaskLife(minutes), _stored(VERDICT), "Append", "EventTime"), VERDICT)


class RollingLog(StatefulProcessor):
    """The last entries of one task, by id; keep_ms: how long an entry is held at most, by the clock, None for ever."""

    def __init__(self, most: int, keep_ms: int | None) -> None:
        self.most, self.keep_ms = most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "id long, micros long, level string, message string", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = {e[0]: tuple(e) for e in self.entries.get()}
        new = {r.id: (r.id, r.micros, r.level, r.message) for r in rows if r.id not in held}
        held |= new
        last = [held[i] for i in sorted(held)[-self.most :]]
        if self.keep_ms is None:
            self.entries.put(last)
        elif new:  # an entry that is put again would begin its time anew; those in excess go with theirs
            self.entries.appendList(list(new.values()))
        for i, micros, level, message in last:
            yield Row(task=key[0], id=i, micros=micros, level=level, message=message)

    def close(self) -> None:
        pass


def rolling_logs(entries: DataFrame, most: int = 400, keep_ms: int | None = None) -> DataFrame:
    """Of a stream of entries (ENTRY), after each batch the last `most` of every task that got any, by id; repeated ids count once."""
    with_states(entries.sparkSession)
    rows = _in_micros(entries).drop("at").groupBy("task").transformWithState(RollingLog(most, keep_ms), _stored(ENTRY), "Update", "ProcessingTime" if keep_ms else "None")
    return _in_time(rows, ENTRY)


def current_logs(spark: SparkSession, path: str) -> DataFrame:
    """What ingest.write_once has written of rolling_logs(): each task's log as of its last batch."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("task").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["task", "batch"], "left_semi").drop("batch")


def written(stream: DataFrame) -> str:
    """Runs a stream over what there is, in a new folder; the folder of its batches."""
    folder = work_folder(stream.sparkSession)
    ingest.write_once(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/out"


def live_tasks(verdicts: DataFrame) -> DataFrame:
    """(task, status) of the tasks that a stream of lives() still holds, from the rows it has written."""
    by = Window.partitionBy("task")
    gone = F.max(F.when(F.col("verdict") == "evicted", F.col("batch"))).over(by)
    rows = verdicts.withColumn("gone", gone).where("verdict = 'applied' and (gone is null or batch > gone)")
    return rows.groupBy("task").agg(F.max_by("status", "seq").alias("status"))

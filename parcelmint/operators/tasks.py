"""The life of scans as tasks: a table of transitions, applied to every task's signals in the order of their arrival.

A signal maps each state to the next, so signals in a row are a map, too, and maps combine in any grouping. Each run of
signals becomes one map; the maps before a run tell the state it begins in; then its own signals are applied. No task of
Spark holds more than one run of signals of a task at once, however many it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmint.functions.folds import running

#: States, those that a task does not leave, and the progress that they show.
STATES = ["none", "pending", "scraping", "calculating", "done", "error", "cancelled"]
ENDED = ("done", "error", "cancelled")
PROGRESS = {"pending": 5, "scraping": 10, "calculating": 75, "done": 100}
_ACTIVE = ("pending", "scraping", "calculating")
#: Which signal leads from where to where; all else is illegal and changes nothing.
MOVES = {
    "start": {"none": "pending"},
    "scrape": {"pending": "scraping"},
    "calculate": {"scraping": "calculating"},
    "finish": {"calculating": "done"},
    "fail": dict.fromkeys(_ACTIVE, "error"),
    "cancel": dict.fromkeys(_ACTIVE, "cancelled"),
    "paste": dict.fromkeys(_ACTIVE, "pending"),
}
#: Signals that begin a generation: what belongs to an earlier one no longer counts.
OPENING = ("start", "paste")


def move(state: str, signal: str | None) -> str | None:
    """The state after a signal, None if it is illegal."""
    return MOVES.get(signal or "", {}).get(state)


def _table(illegal: bool) -> Column:
    """For each signal (and last, for any other) and state by number the next state; illegal ones are -1, or stay."""
    n, out = len(STATES), []
    for signal in [*MOVES, None]:
        found = [move(s, signal) for s in STATES]
        out += [STATES.index(to) if to else -1 if illegal else k for k, to in enumerate(found)]
    assert len(out) == n * (len(MOVES) + 1)
    return F.array(*map(F.lit, out))


def _prefixed(rows: DataFrame, value: Column, total: str, column: str) -> DataFrame:
    """rows (task, run, seq, ...) with `column`: total ("sum" or "max") of value over a task's rows before each, in the order of seq.

    Within runs by a window of a run, across runs by one over their totals.
    """
    how = F.sum if total == "sum" else F.max
    rows = rows.withColumn("value_", value)
    runs = rows.groupBy("task", "run").agg(how("value_").alias("all_"))
    earlier = how("all_").over(Window.partitionBy("task").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("task").alias("task_"), F.col("run").alias("run_"), earlier.alias("earlier_"))
    here = how("value_").over(Window.partitionBy("task", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("here_", here).join(runs, F.col("task").eqNullSafe(F.col("task_")) & (F.col("run") == F.col("run_")))
    both = F.greatest("here_", "earlier_") if total == "max" else F.coalesce("here_", F.lit(0)) + F.coalesce("earlier_", F.lit(0))
    return out.withColumn(column, both).drop("task_", "run_", "here_", "earlier_", "value_")


def history(signals: DataFrame, run: int = 1024) -> DataFrame:
    """(task, seq, at, signal, verdict, status, progress, generation) for each of signals (task, seq, at, signal).

    Signals apply in the order of seq, the number in which they arrived, unique in a task. verdict: late if an earlier
    arrival of the task is younger, illegal if the state does not allow it or nobody knows it, else applied; the first
    two change nothing. status and progress: after the signal. generation: how often the task was begun or resumed so
    far. run: how many numbers of arrival are treated at once. A null task is a task; a null time is never late.
    """
    rows = signals.select("task", F.col("seq").cast("long").alias("seq"), "at", "signal", F.floor(F.col("seq") / run).alias("run"))
    rows = _prefixed(rows, F.col("at"), "max", "youngest")
    late = F.coalesce(F.col("at") < F.col("youngest"), F.lit(False))
    known = F.array(*map(F.lit, MOVES))
    number = F.coalesce(F.nullif(F.array_position(known, F.col("signal")), F.lit(0)) - 1, F.lit(len(MOVES))).cast("int")
    rows = rows.select("task", "run", "seq", "at", "signal", late.alias("late"), F.when(late, len(MOVES)).otherwise(number).alias("code"))

    n, stay = len(STATES), F.col("stay")
    then = lambda a, x: F.transform(a, lambda s: F.get(x, s))
    same = F.array(*[F.lit(k) for k in range(n)])
    runs = rows.groupBy("task", "run").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "signal", "late", "code"))).alias("steps")).withColumn("stay", _table(False))
    runs = runs.withColumn("maps", F.transform("steps", lambda x: F.slice(stay, x["code"] * n + 1, F.lit(n)))).withColumn("before", running(F.col("maps"), same, then))
    whole = then(F.get("before", F.size("before") - 1), F.get("maps", F.size("maps") - 1))
    tasks = runs.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("run", whole.alias("map")))).alias("runs"))
    tasks = tasks.withColumn("reached", running(F.transform("runs", lambda r: r["map"]), same, then))
    begins = tasks.select(F.col("task").alias("task_"), F.explode(F.arrays_zip(F.transform("runs", lambda r: r["run"]).alias("run_"), F.transform("reached", lambda m: F.get(m, F.lit(0))).alias("begin"))).alias("b")).select("task_", "b.*")
    runs = runs.join(begins, F.col("task").eqNullSafe(F.col("task_")) & (F.col("run") == F.col("run_"))).withColumn("next", _table(True))

    def told(x: Column, k: Column) -> Column:
        was = F.get(F.get("before", k), F.col("begin"))
        to = F.get("next", x["code"] * n + was)
        verdict = F.when(x["late"], "late").when(to < 0, "illegal").otherwise("applied")
        return F.struct(x["seq"].alias("seq"), x["at"].alias("at"), x["signal"].alias("signal"), verdict.alias("verdict"), F.when(to < 0, was).otherwise(to).alias("state"))

    found = runs.select("task", "run", F.explode(F.transform("steps", told)).alias("x")).select("task", "run", "x.*")
    opens = ((F.col("verdict") == "applied") & F.col("signal").isin(*OPENING)).cast("int")
    found = _prefixed(found, opens, "sum", "opened")
    status = F.get(F.array(*map(F.lit, STATES)), F.col("state"))
    progress = F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair])
    return found.select("task", "seq", "at", "signal", "verdict", status.alias("status"), F.try_element_at(progress, status).alias("progress"), (F.col("opened") + opens).cast("int").alias("generation"))


def resumed(history_: DataFrame) -> DataFrame:
    """(task, seq, accepted, reason, generation) of the pasted pages in a history: accepted unless the task is unknown, has ended, or moved on before the page came."""
    pasted = history_.where("signal = 'paste'")
    reason = F.when(F.col("verdict") == "late", "late").when(F.col("verdict") == "applied", None).when(F.col("status") == "none", "not found").otherwise(F.concat(F.lit("already "), "status"))
    return pasted.select("task", "seq", reason.isNull().alias("accepted"), reason.alias("reason"), "generation")


def kept(history_: DataFrame, clock: Column, minutes: int = 10) -> DataFrame:
    """(task, status, ended) of the tasks that are still held at a time: those that have not ended, and those that ended at most so many minutes before."""
    last = history_.where("verdict = 'applied'").groupBy("task").agg(F.max_by(F.struct("status", "at"), "seq").alias("last"))
    ended = F.when(F.col("last.status").isin(*ENDED), F.col("last.at"))
    held = ended.isNull() | (clock <= ended + F.make_dt_interval(mins=F.lit(minutes)))
    return last.where(held).select("task", "last.status", ended.alias("ended"))

"""Queries on scans as tasks: the events are read as their signals and log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmint.operators import tasks
from parcelmint.plans.bindings import pick, sql_list, table
from parcelmint.plans.catalog import query
from parcelmint.streaming import ingest
from parcelmint.streaming import tasks as streams

#: What an event says, by its number: each task is begun, moves on, is resumed and ends at some time.
_SAID = ["start", "scrape", "calculate", "start", "scrape", "finish", "calculate", "paste", "scrape", "calculate", "other", "finish", "scrape", "calculate", "fail", "cancel"]


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, seq, at, signal): a task for each user and week; every seventh event came with the time of a day before."""
    at = F.when(F.col("event_id") % 7 == 3, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    task = F.col("user_id") * 5 + F.floor((F.dayofmonth("ts") - 1) / 7)
    # numbers that do not go with the number of the event in its task
    return table(spark, sf_dir, "events").select(task.alias("task"), F.col("event_id").alias("seq"), at.alias("at"), pick(_SAID, F.floor(F.col("event_id") * 7 / 5) % 16).alias("signal"))


_ACTIVE = "('pending', 'scraping', 'calculating')"
#: The same by a walk over each task's signals, one a step.
_HISTORY = f"""WITH RECURSIVE told AS (SELECT user_id * 5 + (day(ts) - 1) // 7 AS task, event_id AS seq, CASE WHEN event_id % 7 = 3 THEN ts - INTERVAL 1 DAY ELSE ts END AS at_, {sql_list(_SAID)}[(event_id * 7 // 5) % 16 + 1] AS signal FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY seq) AS k, coalesce(at_ < max(at_) OVER (PARTITION BY task ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM told),
walk(task, k, status, generation, verdict, signal, seq, at_) AS (SELECT DISTINCT task, 0::BIGINT, 'none', 0, '', '', NULL::BIGINT, NULL::TIMESTAMP FROM told UNION ALL
  SELECT task, k, coalesce(new, old), generation + CASE WHEN new IS NOT NULL AND signal IN ('start', 'paste') THEN 1 ELSE 0 END, CASE WHEN late THEN 'late' WHEN new IS NULL THEN 'illegal' ELSE 'applied' END, signal, seq, at_ FROM (
    SELECT n.task, n.k, w.status AS old, w.generation, n.late, n.signal, n.seq, n.at_, CASE WHEN n.late THEN NULL
      WHEN n.signal = 'start' AND w.status = 'none' THEN 'pending' WHEN n.signal = 'scrape' AND w.status = 'pending' THEN 'scraping' WHEN n.signal = 'calculate' AND w.status = 'scraping' THEN 'calculating'
      WHEN n.signal = 'finish' AND w.status = 'calculating' THEN 'done' WHEN n.signal = 'fail' AND w.status IN {_ACTIVE} THEN 'error' WHEN n.signal = 'cancel' AND w.status IN {_ACTIVE} THEN 'cancelled'
      WHEN n.signal = 'paste' AND w.status IN {_ACTIVE} THEN 'pending' END AS new
    FROM walk w JOIN numbered n ON n.task = w.task AND n.k = w.k + 1)),
history AS (SELECT * FROM walk WHERE k > 0)"""


@query("ST1", _HISTORY + " SELECT task, seq, signal, verdict, status, CAST(CASE status WHEN 'pending' THEN 5 WHEN 'scraping' THEN 10 WHEN 'calculating' THEN 75 WHEN 'done' THEN 100 END AS INT) AS progress, CAST(generation AS INT) AS generation FROM history")
def st1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task's states, with what came late or is not allowed told apart."""
    return tasks.history(signals(spark, sf_dir)).drop("at")


@query("ST9", _HISTORY + """ SELECT task, seq, verdict = 'applied' AS accepted, CASE WHEN verdict = 'late' THEN 'late' WHEN verdict = 'applied' THEN NULL WHEN status = 'none' THEN 'not found' ELSE 'already ' || status END AS reason, CAST(generation AS INT) AS generation FROM history WHERE signal = 'paste'""")
def st9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted pages that resume their task, and why the others do not."""
    return tasks.resumed(tasks.history(signals(spark, sf_dir)))


_CLOCKS = ["2024-01-08 00:00:00", "2024-01-15 12:00:00", "2024-01-29 00:05:00"]


@query("ST5k", _HISTORY + f""", last AS (SELECT c.clock, task, max_by(status, seq) AS status, max_by(at_, seq) AS ended FROM history, (SELECT unnest({sql_list(_CLOCKS)})::TIMESTAMP AS clock) c WHERE verdict = 'applied' AND at_ <= c.clock GROUP BY c.clock, task)
  SELECT strftime(clock, '%Y-%m-%d %H:%M:%S') AS clock, status, count(*) AS tasks FROM last WHERE status NOT IN ('done', 'error', 'cancelled') OR clock <= ended + INTERVAL 600 MINUTE GROUP BY 1, 2""")
def st5k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tasks are held at several times: ended ones go ten hours after their end."""
    all_, found = tasks.history(signals(spark, sf_dir)), None
    for clock in _CLOCKS:
        at = F.lit(clock).cast("timestamp")
        held = tasks.kept(all_.where(F.col("at") <= at), at, 600).groupBy("status").agg(F.count(F.lit(1)).alias("tasks")).select(F.lit(clock).alias("clock"), "status", "tasks")
        found = held if found is None else found.unionByName(held)
    return found


@query("ST4", "SELECT user_id, event_id, event_type AS level FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 40")
def st4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 40 entries of each user's log, kept by a stream over the events (W04 keeps them by a window)."""
    # a pattern, as a stream reads folders and patterns only, and the table may be one file
    entries = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    entries = entries.select(F.col("user_id").alias("task"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("level"), F.col("props").alias("message"))
    logs = streams.current_logs(spark, streams.written(streams.rolling_logs(entries, 40)))
    return logs.select(F.col("task").alias("user_id"), F.col("id").alias("event_id"), "level")


@query("ST2", "WITH t AS (SELECT user_id AS task, event_id % 4 AS generation, event_id FROM events) SELECT task, event_id FROM t JOIN (SELECT task, max(generation) AS generation FROM t GROUP BY task) USING (task, generation)")
def st2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs have written, of each task's latest generation only."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), (F.col("event_id") % 4).alias("generation"), "event_id")
    return ingest.latest(rows).select("task", "event_id")

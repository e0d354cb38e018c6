"""Tasks: the transition table, histories in runs against a walk, and streams against the batch operators, restarts included."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parcelmint.operators import relational, tasks
from parcelmint.streaming import ingest
from parcelmint.streaming import tasks as streams

T0 = datetime(2024, 1, 1)
SIGNALS = [*tasks.MOVES, "other", None]


def walk(rows):
    """(task, seq, verdict, status, generation), one signal after the other."""
    out, state = [], {}
    for task, seq, at, signal in sorted(rows, key=lambda r: r[1]):
        status, generation, youngest = state.get(task, ("none", 0, None))
        late = at is not None and youngest is not None and at < youngest
        to = None if late else tasks.move(status, signal)
        if to:
            status, generation = to, generation + (signal in tasks.OPENING)
        out.append((task, seq, "late" if late else "applied" if to else "illegal", status, generation))
        state[task] = (status, generation, max((x for x in (youngest, at) if x is not None), default=None))
    return out


def made(n, tasks_, seed, jumps=True):
    rng = random.Random(seed)
    weights = [3, 6, 6, 2, 0.4, 0.4, 2, 1, 1]
    out = []
    for seq in range(n):
        at = T0 + timedelta(seconds=30 * seq - (rng.choice([0, 0, 0, 400]) if jumps else 0))
        out.append((rng.choice(tasks_), seq, at if rng.random() < 0.95 or not jumps else None, rng.choices(SIGNALS, weights)[0]))
    return out


def test_moves():
    assert tasks.move("none", "start") == "pending" and tasks.move("pending", "start") is None
    assert [tasks.move(s, "paste") for s in tasks.STATES] == [None, "pending", "pending", "pending", None, None, None]
    assert [tasks.move(s, "fail") for s in ("calculating", "done")] == ["error", None] and tasks.move("pending", "other") is None


@pytest.mark.parametrize("run", [1, 7, 1024])
def test_history_equals_a_walk(spark, run):
    # one task holds most rows; one has no id
    rows = made(600, [1] * 8 + [2, 3, None], run)
    df = spark.createDataFrame(rows, "task long, seq long, at timestamp, signal string").repartition(5)
    found = tasks.history(df, run).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.task, r.seq, r.verdict, r.status, r.generation) for r in found), key=key) == sorted(walk(rows), key=key)
    assert all(r.progress == tasks.PROGRESS.get(r.status) for r in found)
    assert tasks.history(df.limit(0)).collect() == []


def put(folder, number, rows, names):
    """Writes rows as a JSON file, so that it is there at once."""
    folder.mkdir(exist_ok=True)
    text = "".join(json.dumps({k: v.isoformat() + "Z" if isinstance(v, datetime) else v for k, v in zip(names, r) if v is not None}) + "\n" for r in rows)
    (folder / f".{number}").write_text(text)
    (folder / f".{number}").rename(folder / f"{number}.json")


NAMES = ("task", "seq", "at", "signal", "html")


def run_lives(spark, tmp_path, **how):
    stream = streams.lives(spark.readStream.schema(streams.SIGNAL).json(str(tmp_path / "in")), **how)
    ingest.write_once(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_equals_history(spark, tmp_path):
    rows = [r for r in made(240, [1] * 5 + [2, 3, 4], 3) if r[2] is not None]
    for number, part in enumerate((rows[:80], rows[80:81], rows[81:])):
        put(tmp_path / "in", number, [(*r, "<html>" if r[3] == "paste" else None) for r in part], NAMES)
        # each call is a restart from what the last has left
        run_lives(spark, tmp_path, minutes=100_000, lateness="300 days")
    # the same signals once more, as a source that replays brings them
    put(tmp_path / "in", 9, [(*r, "<html>" if r[3] == "paste" else None) for r in rows[40:120]], NAMES)
    found = run_lives(spark, tmp_path, minutes=100_000, lateness="300 days").collect()
    assert sorted((r.task, r.seq, r.verdict, r.status, r.generation) for r in found) == sorted(walk(rows))


def test_pasted_pages_resume_what_has_not_ended(spark, tmp_path):
    say = lambda task, seq, signal, html=None: (task, seq, T0 + timedelta(seconds=seq), signal, html)
    put(tmp_path / "in", 0, [say(1, 1, "start"), say(1, 2, "scrape"), say(1, 3, "paste", "<p>"), say(1, 4, "calculate"), say(1, 5, "scrape"), say(2, 6, "start"), say(2, 7, "cancel"), say(2, 8, "paste", "<p>")], NAMES)
    put(tmp_path / "in", 1, [say(3, 9, "paste", "<p>"), say(1, 10, "paste", "  "), say(1, 11, "paste", "é" * (streams.MOST_BYTES // 2 + 1)), say(1, 12, "paste", "é" * (streams.MOST_BYTES // 2))], NAMES)
    for _ in range(2):
        found = {r.seq: (r.verdict, r.status, r.generation) for r in run_lives(spark, tmp_path, lateness="1 day").collect()}
    assert found == {
        1: ("applied", "pending", 1), 2: ("applied", "scraping", 1), 3: ("applied", "pending", 2), 4: ("illegal", "pending", 2), 5: ("applied", "scraping", 2), 6: ("applied", "pending", 1), 7: ("applied", "cancelled", 1),
        8: ("illegal", "cancelled", 1), 9: ("illegal", "none", 0), 10: ("empty", "scraping", 2), 11: ("too large", "scraping", 2), 12: ("applied", "pending", 3),
    }
    batch = tasks.resumed(tasks.history(spark.read.schema(streams.SIGNAL).json(str(tmp_path / "in")).where("seq not in (10, 11)"))).collect()
    assert {r.seq: (r.accepted, r.reason) for r in batch} == {3: (True, None), 8: (False, "already cancelled"), 9: (False, "not found"), 12: (True, None)}


def test_ended_tasks_go(spark, tmp_path):
    rows = made(200, list(range(12)), 11, jumps=False)
    for number, end in enumerate((60, 61, 130, 200)):
        part = rows[[0, 60, 61, 130][number] : end]
        put(tmp_path / "in", number, [(*r, "<p>" if r[3] == "paste" else None) for r in part], NAMES)
        found = run_lives(spark, tmp_path, minutes=10)
        clock = F.lit(rows[end - 1][2]).cast("timestamp")
        sofar = spark.createDataFrame(rows[:end], "task long, seq long, at timestamp, signal string")
        want = {r.task: r.status for r in tasks.kept(tasks.history(sofar), clock).collect()}
        # a task that has gone and is spoken of again is a new one, which no signal but the first can begin
        again = {r.task for r in found.where("verdict = 'evicted'").collect()}
        got = {r.task: r.status for r in streams.live_tasks(found).collect()}
        assert {k: v for k, v in got.items() if k not in again} == {k: v for k, v in want.items() if k not in again} and not (again & set(want)), (number, again)
    assert again


def test_rolling_log_equals_the_window(spark, tmp_path):
    rng, names = random.Random(2), ("task", "id", "at", "level", "message")
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, T0 + timedelta(seconds=i), rng.choice(["INFO", "ERROR"]), f"m{i}") for i in range(150)]
    late = rows[20:25]
    for number, part in enumerate((rows[:20] + rows[25:70], rows[70:72], rows[72:] + late, rows[100:120])):
        put(tmp_path / "in", number, part, names)
        logs = streams.rolling_logs(spark.readStream.schema(streams.ENTRY).json(str(tmp_path / "in")), most=30)
        ingest.write_once(logs, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        seen = (rows[:20] + rows[25:70], rows[:20] + rows[25:72], rows, rows)[number]
        want = relational.first_by(spark.createDataFrame(seen, streams.ENTRY), ["task"], [F.desc("id")], 30)
        got = streams.current_logs(spark, str(tmp_path / "out"))
        key = lambda df: sorted(tuple(r) for r in df.select("task", "id", "level", "message").collect())
        assert key(got) == key(want)


def test_entries_are_held_for_some_time(spark, tmp_path):
    names = ("task", "id", "at", "level", "message")
    put(tmp_path / "in", 0, [(1, 1, T0, "INFO", "old"), (1, 2, T0, "INFO", "old too")], names)

    def run(last):
        logs = streams.rolling_logs(spark.readStream.schema(streams.ENTRY).json(str(tmp_path / "in")), keep_ms=3000)
        query = ingest.write_once(logs, str(tmp_path / "out"), str(tmp_path / "check"), every="1 second")
        try:
            for _ in range(120):
                time.sleep(0.5)
                found = list((tmp_path / "out").glob("batch=*/part-*")) and streams.current_logs(spark, str(tmp_path / "out")).collect()
                if found and max(r.id for r in found) == last:
                    return sorted(r.message for r in found)
        finally:
            query.stop()

    assert run(2) == ["old", "old too"]
    time.sleep(4)
    put(tmp_path / "in", 1, [(1, 3, T0, "INFO", "new")], names)
    assert run(3) == ["new"]

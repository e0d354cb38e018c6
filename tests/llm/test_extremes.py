"""Vectors of extreme size, and texts with very many secrets."""

import time

import pytest
from pyspark.sql import functions as F

from parcelmint.llm import neardup, secrets, vptree
from tests.llm.test_operators import base_spans


def many(n):
    return "".join(f"x{'é' * (k % 7)} token={'a1' * 5}{k} {'password: short' if k % 5 == 0 else 'AKIA' + 'Z' * 14}\n" for k in range(n // 2))


def test_many_secrets_in_proportion(spark):
    took = {}
    for n in (10_000, 20_000, 40_000):
        df = spark.createDataFrame([(1, many(n)), (2, "none")], "doc_id long, text string").repartition(2).cache()
        df.count()
        for _ in range(2 if n == 10_000 else 1):  # the first run compiles
            began = time.time()
            row = secrets.redact(secrets.scan(df)).where("doc_id = 1").first()
            took[n] = time.time() - began
        assert row.text.count("[SECRET]") == n // 2 + n // 2 - n // 10 and "token=" in many(10) and "a1a1" not in row.text
    assert took[40_000] < 9 * max(0.5, took[10_000])


def test_masks_are_right(spark):
    text = many(300)
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in row.spans if s.order < 3) == base_spans(text)
    reached, out = 0, []
    for s in row.spans:
        if s.start >= reached:
            out += [text[reached : s.start], "[SECRET]"]
        reached = max(reached, s.end)
    assert secrets.redact(spark.createDataFrame([row])).first().text == "".join(out) + text[reached:]


@pytest.mark.parametrize("scale", [1e-200, 1e-160, 1.0, 1e150, 1e200, 1e305])
def test_near_duplicates_of_any_size(spark, scale):
    rows = [(1, 1, [scale, 0.0]), (2, 1, [scale, scale * 0.01]), (3, 1, [0.0, scale]), (4, 1, [-scale, 0.0]), (5, 1, [3.0, 0.0])]
    found = {r.id: (r.n_links, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "id long, label int, vector array<double>")).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (2, 1)}


@pytest.mark.parametrize("scale", [1e-200, 1.0, 1e120, 1e200, 1e305])
def test_nearest_of_any_size(spark, scale):
    rows = [(k, [scale * (k + 1) / 8, scale / (k + 2)]) for k in range(8)]
    found = vptree.nearest(spark.createDataFrame(rows, "id long, vector array<double>"), F.col("id") == 0, factor=1.0).orderBy("rank").collect()
    assert len(found) == 7 and {r.vec_id for r in found} == set(range(1, 8))
    if 1e-100 < scale < 1e150:
        assert [r.vec_id for r in found] == sorted(range(1, 8), key=lambda k: -(rows[0][1][0] * rows[k][1][0] + rows[0][1][1] * rows[k][1][1]))


def test_nearest_beside_a_huge_one(spark):
    rows = [(k, [1.0 * k, 1.0]) for k in range(1, 30)] + [(50, [1e200, 1.0]), (51, [-1e200, 1e200])]
    found = vptree.nearest(spark.createDataFrame(rows, "id long, vector array<double>"), F.col("id") == 1, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [50, 29, 28, 27, 26]

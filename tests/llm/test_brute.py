"""Networks against plain loops, propagation against dense matrices, trees and counting against full scans, and the queries' own columns."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmint.llm import langid, neardup, quality, registry, toxicity, urls, vptree

SF = "/root/testdata/sf0.001"


def gru_by_loops(net, text):
    """Mean probabilities over a text's bytes, one number at a time."""
    h, w, n = net.hidden, {k: np.asarray(v, float) for k, v in net.weights.items()}, len(text)
    gate = lambda x: min(1.0, max(0.0, 0.25 * x + 0.5))
    states = {}
    for d, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
        state = [0.0] * h
        for t in order:
            a = w[f"table_{d}"][text[t]]
            q = [sum(state[i] * w[f"recur_{d}"][i][k] for i in range(h)) for k in range(3 * h)]
            new = []
            for j in range(h):
                z, r = gate(a[j] + q[j]), gate(a[h + j] + q[h + j])
                new.append(state[j] + z * (math.tanh(a[2 * h + j] + r * q[2 * h + j]) - state[j]))
            state = new
            states[d, t] = state
    total = np.zeros(len(net.languages))
    for t in range(n):
        logits = [sum(states[d, t][i] * w[f"out_{d}"][i][k] for d in "fb" for i in range(h)) + w["bias"][k] for k in range(len(net.languages))]
        p = np.exp(np.array(logits) - max(logits))
        total += p / p.sum()
    return total / n


@pytest.mark.parametrize("seed", [0, 1])
def test_language_network_equals_loops(seed):
    net, rng = langid.ByteGru(["a", "b", "c"], 5, seed), np.random.default_rng(seed)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 17, 60)]
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    got = net.pooled(data, np.cumsum(size) - size, size, 128)
    for p, t in zip(got, texts):
        assert p == pytest.approx(gru_by_loops(net, t), rel=1e-4)


def test_quality_network_equals_loops():
    net, rng = quality.ByteConv(chunk=32, overlap=8), np.random.default_rng(0)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 3, 32, 33, 150)]
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    got = net.score(data, np.cumsum(size) - size, size)
    w = {k: np.asarray(v, float) for k, v in net.weights.items()}
    for p, t in zip(got, texts):
        pooled, starts = [], [0] if t else []
        while starts and starts[-1] + net.chunk < len(t):
            starts.append(starts[-1] + net.chunk - net.overlap)
        for a in starts:
            chunk = list(t[a : a + net.chunk])
            chunk += [0] * (net.chunk + net.width - 1 - len(chunk))
            answers = [[sum(w["embed"][chunk[i + j]][e] * w["filter"][j * net.embed + e][f] for j in range(net.width) for e in range(net.embed)) for f in range(net.filters)] for i in range(net.chunk)]
            pooled.append([max(0.0, max(x[f] for x in answers) + w["shift"][f]) for f in range(net.filters)])
        means = np.mean(pooled, 0) if pooled else np.zeros(net.filters)
        assert p == pytest.approx(1 / (1 + math.exp(-(means @ w["out"] + w["bias"][0]))), rel=1e-4)


def test_propagation_equals_dense_pagerank(spark):
    rng, n = np.random.default_rng(4), 30
    edges = [(f"h{a}", f"h{b}", int(rng.integers(1, 4))) for a in range(n) for b in rng.integers(0, n, 3) if a != b]
    edges = list({(a, b): (a, b, k) for a, b, k in edges}.values())
    seeds = [("trust", "h0", 2.0), ("trust", "h3", 1.0), ("distrust", "h7", 1.0)]
    got = {(r.side, r.host): r.score for r in urls.propagate(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame(seeds, "side string, host string, weight double"), 1e-10).collect()}
    for side in ("trust", "distrust"):
        m, start = np.zeros((n, n)), np.zeros(n)
        for a, b, k in edges:
            i, j = int(a[1:]), int(b[1:])
            m[(j, i) if side == "trust" else (i, j)] += k
        m /= np.maximum(m.sum(0), 1)
        for s, host, weight in seeds:
            start[int(host[1:])] += weight * (s == side)
        start /= start.sum()
        want = np.linalg.solve(np.eye(n) - 0.85 * m, 0.15 * start)
        assert [got.get((side, f"h{i}"), 0.0) for i in range(n)] == pytest.approx(want.tolist(), abs=1e-7)


def test_tree_is_exact_at_factor_one_and_prunes_beyond():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 12))
    x[100:140], x[200:230] = x[100], -x[7]
    ids, asked = rng.permutation(5000)[:1500], np.arange(0, 1500, 30)
    share = {}
    for factor in (1.0, 3.0, 8.0):
        q, v, score, share[factor] = vptree.search_shard(ids, x, ids[asked], x[asked], 20, factor, 16)
        if factor == 1.0:
            for i in asked:
                s = (x * x[i]).sum(1)
                order = [j for j in np.lexsort((ids, -s)) if j != i][:20]
                assert v[q == ids[i]].tolist() == ids[order].tolist() and score[q == ids[i]] == pytest.approx(s[order])
    assert share[8.0] < share[3.0] <= share[1.0] <= 1.0


def test_nearest_of_an_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, block int, shard int, dims int")
    assert vptree.nearest(vptree.usable(none, "vec_id", "embedding"), F.col("id") % 20 == 0).count() == 0


def test_counting_finds_pairs_at_the_threshold():
    """Recall at the threshold's own cosine, and how few of the other pairs are verified."""
    rng, n, dims = np.random.default_rng(6), 3000, 64
    counting = neardup.calibrated(0.93)
    one = rng.normal(size=(n, dims))
    one /= np.linalg.norm(one, axis=1)[:, None]
    off = rng.normal(size=(n, dims))
    off -= (off * one).sum(1)[:, None] * one
    off /= np.linalg.norm(off, axis=1)[:, None]
    other = 0.93 * one + math.sqrt(1 - 0.93**2) * off
    g = neardup.directions(dims, counting.projections)
    count = neardup.counted(one @ g, other @ g, counting)
    dense = (abs((one @ g)[:50, None] - (other @ g)[None]) <= counting.window).sum(2)
    assert (count[:50] == dense).all()
    assert (np.diag(count) >= counting.least).mean() > 0.999
    assert (count >= counting.least).mean() < 0.01


def test_near_duplicates_with_clashing_columns_and_none(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0], 5, "x"), (2, 1, [1.0, 0.01], 6, "y")], "id long, label int, vector array<double>, block int, place string")
    assert sorted((r.id, r.n_links, r.component_id) for r in neardup.near_duplicates(rows).collect()) == [(1, 1, 1), (2, 1, 1)]
    assert neardup.near_duplicates(rows.limit(0)).count() == 0


def test_the_laws_scale_is_fitted():
    rng, rate, scale = np.random.default_rng(7), 1.3, 0.04
    tokens = rng.integers(50, 2000, 4000).astype(float)
    most = -np.log(rng.exponential(1 / scale, 4000) / tokens) / rate
    assert toxicity._law_scale(np.full(4000, rate), tokens, most) == pytest.approx(scale, rel=0.1)


def test_networks_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels, "quality", F.lit(True)) is None and quality.score(docs, None).count() == 0
    assert toxicity.train(docs, labels, "toxic", F.lit(True)) is None and toxicity.score(docs, None).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string, rule string, trust int")).count() == 0


COLUMNS = {
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op8_embedding_neardup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_secret_scans": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op2_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_have_their_columns(spark, name):
    df = registry.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    if name in ("op3_language_id", "op5_quality"):
        n = 5 if name == "op3_language_id" else 4
        rest = 0 if name == "op3_language_id" else 2
        rows = df.collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) and 0 <= r.score <= 1 for r in rows)
        assert name == "op3_language_id" or all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_nearest_query_recall(spark):
    """The query's default pruning against all pairs."""
    got = {}
    for r in registry.QUERIES["op2_nearest"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = 0
    for q, mine in got.items():
        s = (x * x[ids == q][0]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        assert [k for k, *_ in sorted(mine)] == list(range(1, 21))
        assert all(score == pytest.approx(s[ids == v][0], rel=1e-12) for _, v, score in mine)
        found += len({v for _, v, _ in mine} & set(ids[order].tolist()))
    assert len(got) == (ids % 20 == 0).sum() and found / (20 * len(got)) >= 0.9

"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of documents by hash. A source's target in words fixes how many of its blocks
are drawn: all of them once for each whole multiple of its size, then a prefix of a permutation of its blocks.
Those exact quotas are dealt to output shards by a binary tree: a node splits its vector of quotas between its
halves with multivariate-hypergeometric draws, so each shard is a random subset of the drawn blocks without
replacement. A shard takes its own disjoint range of each source's permuted blocks and orders its documents
by chance, the local shuffle. All of it is DataFrame and SQL work; texts are only read to count their words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelmint.llm.common import durable, small, table, veiled

WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sources (source, source_size) with rank, weight and target, one row each.

    The sources by code point, null last, have the weights in turn. They share the sum of all sizes by weight; a
    target stops at `most` times its source's size and what is above goes to the others by weight. With sources
    ordered by the level (cap / weight) at which they stop, the final level is found by running sums. The table
    of sources is a dimension: one row for each source.
    """
    by_name, by_level, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", "rank"), Window.partitionBy()
    w = F.array(*[F.lit(float(x)) for x in weights])
    out = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", w[F.col("rank") % len(weights)])
    out = out.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("cap") / F.col("weight"))
    stopped = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("reach", (F.sum("source_size").over(all_rows) - stopped) / left)
    final = F.max(F.when(F.col("reach") <= F.col("level"), F.col("reach"))).over(all_rows)
    return out.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * final, F.col("cap")))).drop("cap", "level", "reach")


def _draw(x: str, i: str, n: str, pop: str, seed: int) -> str:
    """SQL for a hypergeometric count: how many of n blocks, drawn from pop of which x are this source's, are its own.

    An exact weighted choice over the counts around the mode, whose weights follow from each other; counts beyond
    9 deviations are left out.
    """
    sd = f"ceil(9 * sqrt({n} * ({x} / {pop}) * (1 - {x} / {pop}) * ({pop} - {n}) / greatest({pop} - 1, 1))) + 12"
    mode = f"floor(({n} + 1D) * ({x} + 1D) / ({pop} + 2D))"
    low = f"greatest(0L, {n} - ({pop} - {x}), cast({mode} - ({sd}) as bigint))"
    high = f"least({x}, {n}, cast({mode} + ({sd}) as bigint))"
    chance = f"pmod(xxhash64({seed}L, node, {i}, k), 9007199254740992L) / 9007199254740992D"
    following = f"w.at * ({x} - k) * ({n} - k) / ((k + 1D) * ({pop} - {x} - {n} + k + 1D))"
    step = f"named_struct('at', {following}, 'sum', w.sum + w.at, 'pick', if({chance} * (w.sum + w.at) < w.at, k, w.pick))"
    choice = f"aggregate(sequence({low}, {high}), named_struct('at', 1D, 'sum', 0D, 'pick', {low}), (w, k) -> {step}, w -> w.pick)"
    return f"if({x} = 0 or {n} = 0, 0L, if({n} = {pop}, {x}, {choice}))"


def _split_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """quotas (rank, quota) dealt to 2**depth shards: (shard, rank, n), n > 0. One row for each node of the tree holds its quotas by source."""
    tree = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("q"))
    tree = tree.select(F.lit(0).cast("long").alias("node"), F.col("q.rank").alias("ranks"), F.col("q.quota").alias("q"))
    blocks = "aggregate(q, 0L, (s, x) -> s + x)"
    drawn = "transform(array(" + _draw("e.x", "e.i", "s.n", "s.pop", seed) + "), d -> named_struct('n', s.n - d, 'pop', s.pop - e.x, 'out', concat(s.out, array(d))))[0]"
    left = f"aggregate(transform(q, (x, i) -> named_struct('x', x, 'i', i)), named_struct('n', half, 'pop', {blocks}, 'out', cast(array() as array<bigint>)), (s, e) -> {drawn}, s -> s.out)"
    for _ in range(depth):
        tree = tree.withColumn("half", F.expr(f"({blocks} + pmod(node, 2L)) div 2")).withColumn("left", F.expr(left))
        tree = tree.select("ranks", F.expr("inline(array(named_struct('node', node * 2, 'q', left), named_struct('node', node * 2 + 1, 'q', zip_with(q, left, (a, b) -> a - b))))"))
    return tree.select(F.col("node").cast("int").alias("shard"), F.expr("inline(arrays_zip(ranks, q))")).select("shard", F.col("ranks").alias("rank"), F.col("q").alias("n")).where("n > 0")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, docs_per_block: int = 256, most_blocks: int = 65_536, shard_words: int = 1 << 22, seed: int = 7) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, source, key_a, key_b, nth, size, source_size, target, draws, taken.

    draws: array of (shard, position, epoch, words), one for each time that the mix takes the document, in the order
    of shards; taken: the sum of their words. A shard holds the blocks that the splitting tree dealt to it, in the
    order of the local shuffle: positions count from 0 without gaps. Only the document at the end of a source's
    last draw is cut, so a source's taken words are its target to the nearest word.

    docs_per_block, most_blocks: a source has one block for so many rows, up to so many; larger sources have larger
    blocks. shard_words: words of a shard, about; the tree has a power of two of shards, no more than a source has
    blocks. Where that makes shards larger, their local shuffle is cut into parts of about so many words.

    (key_a, key_b) are hashes of doc_id, text and source, nth numbers equal ones from 1. Null text has size 0; null
    sources are one source; rows that repeat are taken each on its own; an empty table gives no rows; extra columns
    are ignored. Equal inputs give equal mixes.
    """
    keys = [F.xxhash64(F.lit(seed + k), "doc_id", "text", "source").alias(name) for k, name in enumerate(KEYS)]
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keys)
    rows = durable(rows.withColumn("nth", F.row_number().over(Window.partitionBy(*KEYS).orderBy("size"))))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = targets(sources, weights, most).withColumn("blocks", F.least(F.lit(most_blocks), F.ceil(F.col("docs") / docs_per_block)).cast("int"))
    whole = F.when(F.col("source_size") > 0, F.floor((F.round("target") / F.col("source_size")))).otherwise(0).cast("int")
    rest = (F.round("target") - F.col("whole") * F.col("source_size")).cast("long")
    sources = durable(sources.withColumn("whole", whole).withColumn("rest", rest).coalesce(1))
    n_sources, words = sources.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    depth = min(most_blocks.bit_length() - 1, max(0, (int((words or 0) // shard_words)).bit_length()))
    parts = max(1, -(-int(words or 0) // (shard_words << depth)))

    own = small(sources, n_sources).withColumnRenamed("source", "source_")
    rows = rows.join(own, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    rows = rows.withColumn("block", F.pmod("key_a", "blocks").cast("int"))
    drawn = durable(_drawn_blocks(rows, small(sources, n_sources), seed))
    shards = _split_tree(drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("quota")), depth, seed)
    upto = F.sum("n").over(Window.partitionBy("rank").orderBy("shard"))
    shards = shards.withColumn("upto", upto).select("rank", "shard", F.explode(F.expr("sequence(upto - n, upto - 1)")).alias("place"))
    drawn = drawn.join(shards, ["rank", "place"]).select("rank", "block", F.struct("epoch", "shard", "limit").alias("d"))
    blocks = drawn.groupBy("rank", "block").agg(F.sort_array(F.collect_list("d")).alias("drawn"))

    within = Window.partitionBy("rank", "block").orderBy(*KEYS, "nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(blocks, ["rank", "block"], "left")
    cut = "named_struct('shard', d.shard, 'epoch', d.epoch, 'words', greatest(0L, least(size, d.limit - before)))"
    rows = rows.withColumn("drawn", F.expr(f"filter(transform(coalesce(drawn, array()), d -> {cut}), d -> d.words > 0)"))
    rows = durable(rows.select("doc_id", "source", *KEYS, "nth", "size", "source_size", "target", "drawn"))
    placed = _shard_order(rows.select(*KEYS, "nth", F.expr("inline(drawn)")), parts, seed)
    draws = placed.groupBy(*KEYS, "nth").agg(F.sort_array(F.collect_list(F.struct("shard", "position", "epoch", "words"))).alias("draws"))
    rows = rows.drop("drawn").join(draws, [*KEYS, "nth"], "left")
    none = F.array().cast("array<struct<shard:int,position:bigint,epoch:int,words:bigint>>")
    rows = rows.withColumn("draws", F.coalesce("draws", none)).withColumn("taken", F.expr("aggregate(draws, 0L, (s, d) -> s + d.words)"))
    return rows.select("doc_id", "source", *KEYS, "nth", "size", "source_size", "target", "draws", "taken")


#: Two hashes that tell a row from all others but its exact copies.
KEYS = ["key_a", "key_b"]


def _drawn_blocks(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(rank, block, epoch, limit, place): the blocks that each source's quota takes, by permuted place, and how many words of each."""
    blocks = rows.groupBy("rank", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.join(sources.select("rank", "whole", "rest"), "rank").withColumn("times", F.expr("whole + if(rest > 0, 1, 0)"))
    epochs = blocks.withColumn("epoch", F.explode(F.expr("if(times = 0, array(), sequence(0, times - 1))")))
    order = Window.partitionBy("rank", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "rank", "block"), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    epochs = epochs.withColumn("at", F.row_number().over(order) - 1).withColumn("before", before)
    limit = F.when(F.col("epoch") < F.col("whole"), F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("before")))
    place = F.row_number().over(Window.partitionBy("rank").orderBy("epoch", "at")).cast("long") - 1
    return epochs.withColumn("limit", limit).where("limit > 0").withColumn("place", place).select("rank", "block", "epoch", "limit", "place")


def _shard_order(draws: DataFrame, parts: int, seed: int) -> DataFrame:
    """draws (shard, epoch, key_a, key_b, nth) with position: the local shuffle, an order by hash within each shard, from 0.

    A shard is numbered in `parts` pieces of about equal size, each in a task of its own, one after another.
    """
    chance = F.xxhash64(F.lit(seed + 1), "shard", "epoch", *KEYS, "nth")
    draws = draws.withColumn("chance", chance).withColumn("part", F.pmod(F.shiftright("chance", 32), F.lit(parts)))
    local = Window.partitionBy("shard", "part").orderBy("chance", *KEYS, "nth", "epoch")
    if parts == 1:
        return draws.withColumn("position", F.row_number().over(local).cast("long") - 1).drop("chance", "part")
    sizes = draws.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
    return draws.join(sizes, ["shard", "part"]).withColumn("position", F.col("start") + F.row_number().over(local) - 1).drop("chance", "part", "start")


def mixed_documents(docs: DataFrame, mixed: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of docs as often as mix() takes them, with docs' columns, each shard's rows together and in the order of its local shuffle.

    A document that a draw cuts has its first words, and n_chars, if there, to match. Columns of any name pass.
    """
    plain, restored = veiled(docs, "doc_id", "text", "source")
    keyed = plain.select("*", *[F.xxhash64(F.lit(seed + k), "doc_id", "text", "source").alias(name) for k, name in enumerate(KEYS)])
    one = F.transform("draws", lambda d: F.struct("nth", d["shard"].alias("shard"), d["position"].alias("position"), d["words"].alias("words"), "size"))
    draws = mixed.where("size(draws) > 0").groupBy(*KEYS).agg(F.flatten(F.collect_list(one)).alias("draws"))
    # equal rows lie together after the join, so numbering them needs no further shuffle
    out = keyed.join(draws.hint("merge"), KEYS).withColumn("nth", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*KEYS)))
    out = out.select("*", F.explode(F.expr("filter(draws, d -> d.nth = nth)")).alias("d")).drop("draws")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD_AND_GAP), F.lit(0)), F.lit(1), F.col("d.words").cast("int")), "")
    out = out.withColumn("text", F.when(F.col("d.words") < F.col("d.size"), cut).otherwise(F.col("text")))
    out = out.withColumn("shard", F.col("d.shard")).withColumn("position", F.col("d.position"))
    out = out.repartition("shard").sortWithinPartitions("shard", "position")
    return restored(out, {"n_chars": F.length("text").cast("long")})


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draws says where each document lies in the mix: shard, position there, epoch and words."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "draws")

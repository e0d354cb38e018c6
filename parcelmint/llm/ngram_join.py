"""Exact Jaccard join of word-shingle sets by grouped prefixes.

Shingles have one global order, the frequent ones last. Two sets that are similar enough share a shingle within
their prefixes. Documents with the same prefix and size are one group; groups that meet in the postings of a
prefix shingle and pass the size filter are pairs; their members are expanded and verified on whole sets. Documents
with equal sets are one member.

Only connectivity is asked for, so links are first looked for in a few linear rounds: every document meets some
neighbours in its posting lists, which are ordered by chance and anew each time, and components are found. Then
every remaining pair whose members are in different components is verified; pairs within one component are linked
already. No pair is left out, and a large family of near copies is no quadratic number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelmint.llm.common import components, durable as written, lean, scratch, small, table, text_batches
from parcelmint.llm.shingles import list_array, mixed, sets_in

#: So many of the most frequent shingles are known to all tasks and come last in the order; which ones they are
#: changes the work, never the result.
_FREQUENT = 1 << 19
_BUCKET_BYTES = 4_000_000


def _count_runs(words: int, buckets: int) -> Callable:
    """Shingles of a batch by bucket: (bucket, their low 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in sets_in(batch.column(0), words):
                all_ = np.concatenate(sets)
                bucket = ((all_ >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                held, start = np.unique(bucket[order], return_index=True)
                low = all_[order].astype(np.uint32)
                parts = [low[a:b].tobytes() for a, b in zip(start, [*start[1:], len(low)])]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(parts, pa.binary())], ["bucket", "low"])

    return run


def _count_bucket(part: pa.Table) -> pa.Table:
    bucket = part.column("bucket")[0].as_py() if len(part) else 0
    low = np.frombuffer(b"".join(part.column("low").to_pylist()), np.uint32)
    held, n = np.unique(low, return_counts=True)
    keep = n >= 4
    return pa.table({"shingle": (np.int64(bucket) << 32) | held[keep].astype(np.int64), "n": n[keep].astype(np.int64)})


def frequent_shingles(docs: DataFrame, words: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts over all documents: (buckets, the most frequent shingles' bucket and low bits, sorted, their counts)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << 20, max(16, size // _BUCKET_BYTES))
    runs = docs.select("text").mapInArrow(lean(_count_runs(words, buckets)), "bucket int, low binary")
    top = runs.groupBy("bucket").applyInArrow(_count_bucket, "shingle long, n long").orderBy(F.desc("n"), "shingle").limit(_FREQUENT).toArrow().sort_by("shingle")
    return buckets, top["shingle"].to_numpy(), top["n"].to_numpy()


#: Words of 64 bits of the short signature.
_LONGS = 8
_BITS = [f"b{k}" for k in range(_LONGS)]


def _signature(s: np.ndarray) -> np.ndarray:
    """A set as parities: bit h of at least 512, and two for each shingle, says whether an odd number of hashes end in h.

    Two sets that differ in d shingles differ in at most d bits. A longer signature folds to a shorter one by XOR.
    """
    bits = 64 * _LONGS << max(0, (max(len(s), 1) * 2 - 1).bit_length() - (64 * _LONGS - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def _folded(signature: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(signature.reshape(-1, size), axis=0)


def _apart(one: bytes, other: bytes) -> int:
    """At least so many shingles are in one of two sets and not in the other."""
    a, b = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ _folded(b, len(a))).sum())


def _plausible(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, one, other = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "signature_a", "signature_b"))
            keep = [(100 + percent) * _apart(p, q) <= (100 - percent) * (x + y) for x, y, p, q in zip(n_a, n_b, one, other)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _prefixes(words: int, percent: int, buckets: int, frequent: np.ndarray, counts: np.ndarray) -> Callable:
    """For each document: size, two hashes of its set, two of its prefix, the prefix, its signature and the signature's short form."""

    names = ["doc_id", "n", "set_a", "set_b", "prefix_a", "prefix_b", "prefix", "signature", *_BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in sets_in(batch.column(1), words):
                sums = np.zeros((4, len(sets)), np.uint64)
                prefixes, signatures = [], []
                short = np.zeros((len(sets), _LONGS), np.int64)
                for i, s in enumerate(sets):
                    signature = _signature(s)
                    signatures.append(signature.tobytes())
                    short[i] = _folded(signature, 8 * _LONGS).view(np.int64)
                    n = len(s)
                    if not n:
                        prefixes.append(s)
                        continue
                    key = (((s >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) << 32) | (s & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    at = np.minimum(np.searchsorted(frequent, key), max(len(frequent) - 1, 0))
                    often = np.where(frequent[at] == key, counts[at], 0) if len(frequent) else np.zeros(n, np.int64)
                    most = n - (percent * n + 99) // 100 + 1
                    order = np.argsort(often, kind="stable")[:most] if often.any() else np.arange(most)
                    prefixes.append(np.sort(s[order]))
                    for k, (x, salt) in enumerate(((s, 1), (s, 2), (s[order], 3), (s[order], 4))):
                        sums[k, i] = mixed(x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).sum(dtype=np.uint64)
                size = pa.array([len(s) for s in sets], pa.int32())
                hashes = [pa.array(x.view(np.int64)) for x in sums]
                columns = [batch.column(0).slice(a, b - a), size, *hashes, list_array(prefixes), pa.array(signatures, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in short.T)], names)

    return run


def _whole_sets(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in sets_in(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), list_array(sets)], ["doc_id", "shingles"])

    return run


def _verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, words: int, percent: int, durable: Callable) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity; sets are only made for pairs whose signatures allow it."""

    def of(side: str) -> DataFrame:
        return rows.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("signature").alias(f"signature_{side}"))

    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "signature_a", "signature_b")
    pairs = durable(both.mapInArrow(lean(_plausible(percent)), "a long, b long"))
    wanted = durable(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = docs.join(small(wanted), F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text")
    sets = durable(texts.mapInArrow(lean(_whole_sets(words)), "doc_id long, shingles array<long>"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_of_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("set_of_a", "set_of_b")))
    union = F.size("set_of_a") + F.size("set_of_b") - F.col("common")
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * union).select("a", "b").distinct()


def _near(a: str, b: str, percent: int) -> Column:
    """Whether a set of size a is large enough to be similar to one of size b."""
    return F.lit(100) * F.col(a) >= F.lit(percent) * F.col(b)


def _bits_apart(one: str, other: str) -> Column:
    """In how many bits the short signatures in two groups of columns differ."""
    found = [F.bit_count(F.col(f"{one}{k}").bitwiseXOR(F.col(f"{other}{k}"))) for k in range(_LONGS)]
    return reduce(Column.__add__, found)


def _in_reach(apart: Column, sizes: Column, percent: int) -> Column:
    """Whether sets with sizes of this sum, which differ in at least `apart` shingles, can be similar."""
    return F.lit(100 + percent) * apart <= F.lit(100 - percent) * sizes


def _neighbours(in_lists: DataFrame, percent: int, most: int, list_rows: int, salt: int) -> DataFrame:
    """Pairs (a, b) of ids that follow each other in a posting list, in different components and near in size; at most so many for each a.

    in_lists: (shingle, id, n, c, rows), rows the length of the list.
    """
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / list_rows)).alias("part")
    within = Window.partitionBy("shingle", "part").orderBy(F.xxhash64(F.lit(salt), "shingle", "id"), "id")
    after = [F.lead(c).over(within).alias(f"{c}_b") for c in ("id", "n", "c")]
    met = in_lists.select("shingle", "id", "n", "c", part).select("id", "n", "c", *after)
    met = met.where((F.col("c") != F.col("c_b")) & _near("n", "n_b", percent) & _near("n_b", "n", percent))
    met = met.select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()
    chosen = Window.partitionBy("a").orderBy(F.xxhash64(F.lit(salt), "a", "b"))
    return met.withColumn("place", F.row_number().over(chosen)).where(F.col("place") <= most).select("a", "b")


def _postings(rows: DataFrame, heads: DataFrame, member: list[str]) -> DataFrame:
    """(g, n, shingle, rows): the prefix shingles of one document of each group, for shingles that several groups have."""
    heads = heads.select(F.col("id").alias("doc_id"), *member)
    lists = rows.join(heads, ["doc_id", *member], "left_semi").select(F.col("doc_id").alias("g"), "n", F.explode("prefix").alias("shingle"))
    held = lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return lists.join(held, "shingle").select("g", "n", "shingle", "rows")


def _nodes(placed: DataFrame) -> DataFrame:
    """One row for each group and component (g, c): a document of it, the bits of that, how far its others are from
    them (spread), the bits of the component's first document (z) and how far all are from those (off)."""
    first = placed.groupBy("g", "c").agg(F.min("id").alias("id"))
    of = placed.select("id", "n", *_BITS)
    first = first.join(of, "id")
    center = of.select(F.col("id").alias("c"), *[F.col(b).alias(f"z{k}") for k, b in enumerate(_BITS)])
    mine = placed.select("g", "c", *[F.col(b).alias(f"y{k}") for k, b in enumerate(_BITS)])
    spread = mine.join(first, ["g", "c"]).groupBy("g", "c").agg(F.max(_bits_apart("y", "b")).alias("spread"))
    return first.join(spread, ["g", "c"]).join(center, "c").withColumn("off", _bits_apart("b", "z") + F.col("spread"))


def _crossing(in_lists: DataFrame, placed: DataFrame, percent: int, durable: Callable) -> DataFrame:
    """Every pair (a, b) of documents in different components that can be similar: they share a prefix shingle, or the
    whole prefix, and neither sizes nor signatures speak against it.

    Signatures keep distances (they differ in at most as many bits as sets in shingles), so by the triangle
    inequality a component's first document stands for all of it at first: components that are too far from each
    other for all their members go as one. Members meet only where their components can.
    """
    nodes = durable(_nodes(placed))
    lists = durable(in_lists.select("shingle", "g", "c").join(nodes.select("g", "c", "id", "n", "spread", "off", *_BITS), ["g", "c"]))
    centers = nodes.where("id = c").select("c", *[f"z{k}" for k in range(_LONGS)])
    places = lists.groupBy("shingle", "c").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("off").alias("radius")).join(centers, "c")
    right = places.select("shingle", *[F.col(x).alias(f"{x}_b") for x in ("c", "least", "most", "radius")], *[F.col(f"z{k}").alias(f"y{k}") for k in range(_LONGS)])
    sizes = _near("most", "least_b", percent) & _near("most_b", "least", percent)
    reach = _in_reach(_bits_apart("z", "y") - F.col("radius") - F.col("radius_b"), F.col("most") + F.col("most_b"), percent)
    met = durable(places.join(right, "shingle").where((F.col("c") < F.col("c_b")) & sizes & reach).select("shingle", "c", "c_b", "least_b", "most_b", "radius_b", *[f"y{k}" for k in range(_LONGS)]))

    reach = _in_reach(_bits_apart("b", "y") - F.col("spread") - F.col("radius_b"), F.col("n") + F.col("most_b"), percent)
    sizes = (F.lit(100) * F.col("n") >= F.lit(percent) * F.col("least_b")) & (F.lit(100) * F.col("most_b") >= F.lit(percent) * F.col("n"))
    half = lists.join(small(met), ["shingle", "c"]).where(sizes & reach)
    half = durable(half.select("shingle", "c_b", "c", "g", "n", "spread", *_BITS))
    other = lists.select("shingle", F.col("c").alias("c_b"), F.col("g").alias("g_b"), F.col("n").alias("n_b"), F.col("spread").alias("spread_b"), *[F.col(b).alias(f"y{k}") for k, b in enumerate(_BITS)])
    reach = _in_reach(_bits_apart("b", "y") - F.col("spread") - F.col("spread_b"), F.col("n") + F.col("n_b"), percent)
    pairs = other.join(small(half), ["shingle", "c_b"]).where(_near("n", "n_b", percent) & _near("n_b", "n", percent) & reach)
    pairs = pairs.select(F.col("g").alias("g_a"), "c", "g_b", "c_b").distinct()

    several = placed.groupBy("g").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("g")
    split = nodes.join(several, "g", "left_semi").select("g", "c", "n", "spread", *_BITS)
    right = split.select("g", F.col("c").alias("c_b"), F.col("spread").alias("spread_b"), *[F.col(b).alias(f"y{k}") for k, b in enumerate(_BITS)])
    reach = _in_reach(_bits_apart("b", "y") - F.col("spread") - F.col("spread_b"), F.col("n") * 2, percent)
    inside = split.join(right, "g").where((F.col("c") < F.col("c_b")) & reach)
    pairs = pairs.union(inside.select(F.col("g").alias("g_a"), "c", F.col("g").alias("g_b"), "c_b"))

    first = placed.select(F.col("g").alias("g_a"), "c", F.col("id").alias("a"), F.col("n").alias("n_a"), *_BITS)
    second = placed.select(F.col("g").alias("g_b"), F.col("c").alias("c_b"), F.col("id").alias("b"), F.col("n").alias("n_b"), *[F.col(b).alias(f"y{k}") for k, b in enumerate(_BITS)])
    reach = _in_reach(_bits_apart("b", "y"), F.col("n_a") + F.col("n_b"), percent)
    pairs = pairs.join(first, ["g_a", "c"]).join(second, ["g_b", "c_b"]).where(reach)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, rounds: int = 3, neighbours: int = 4, list_rows: int = 10_000) -> DataFrame:
    """One row for each row of docs (doc_id long, text): doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union of their sets of distinct shingles of so many words;
    component_id is the smallest doc_id that links reach. rounds, neighbours: how many linear rounds there
    are, and how many others a document meets in each; list_rows: longer posting lists are cut into lists of about so
    many rows there. None of them changes the result.

    Null texts and texts without words have no shingles and link with nothing. Rows that repeat get equal results;
    rows that share a doc_id but not the text may share a component. A null doc_id has no component. No rows give
    no rows; other columns are ignored. The result is a written table; all others that it needed are gone.
    """
    out, _ = _classes(docs, words, percent, rounds, neighbours, list_rows)
    return out.select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, words: int, percent: int, rounds: int, neighbours: int, list_rows: int) -> tuple[DataFrame, list[str]]:
    """jaccard_components(), with the columns that tell one set from another: (rows, those columns)."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets, frequent, counts = frequent_shingles(docs, words)
    made = "doc_id long, n int, set_a long, set_b long, prefix_a long, prefix_b long, prefix array<long>, signature binary"
    group, member = ["n", "prefix_a", "prefix_b"], ["n", "prefix_a", "prefix_b", "set_a", "set_b"]
    with scratch(docs.sparkSession) as durable:
        rows = durable(docs.mapInArrow(lean(_prefixes(words, percent, buckets, frequent, counts)), ", ".join([made, *(f"{b} long" for b in _BITS)])))
        members = rows.where("n > 0 and doc_id is not null").groupBy(*member).agg(F.min("doc_id").alias("id"), *[F.max(b).alias(b) for b in _BITS])
        groups = members.groupBy(*group).agg(F.min("id").alias("g"))
        members = durable(members.join(groups, group).select(*member, "id", "g", *_BITS))
        lists = durable(_postings(rows, members.where("id = g"), member))

        follow = Window.partitionBy("g", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
        chained = members.select(F.col("id").alias("a"), F.lead("id").over(follow).alias("b")).where("b is not null")
        chained = chained.union(members.where("id <> g").select("g", "id"))
        placed = members.select("id", "g", "n", F.col("id").alias("c"), *_BITS)
        in_lists = lists.select("shingle", "g", "n", F.col("g").alias("id"), F.col("g").alias("c"), "rows")
        for k in range(rounds):
            met = _neighbours(in_lists, percent, neighbours, list_rows, k)
            met = met.union(chained) if k == 0 else met
            met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
            links = durable(_verified(docs, rows, met, words, percent, durable))
            if k and not links.limit(1).count():
                break
            found = components(links.union(placed.where("id <> c").select("id", "c")), durable=durable)
            placed = members.select("id", "g", "n", *_BITS).join(found, "id", "left")
            placed = durable(placed.select("id", "g", "n", F.coalesce("component", "id").alias("c"), *_BITS))
            held = placed.groupBy("g", "c").agg(F.min("id").alias("id"), F.first("n").alias("n"))
            in_lists = lists.select("shingle", "g", "rows").join(held, "g")
            several = in_lists.groupBy("shingle").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("shingle")
            in_lists = durable(in_lists.join(several, "shingle", "left_semi"))

        more = _verified(docs, rows, _crossing(in_lists, placed, percent, durable), words, percent, durable)
        final = components(more.union(placed.where("id <> c").select("id", "c")), durable=durable)
        classes = members.join(final, "id", "left").select(*member, F.coalesce("component", "id").alias("component_id"))
        out = rows.select("doc_id", *member).join(classes, member, "left")
        component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
        out = written(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "set_a", "set_b"))
    return out, ["set_a", "set_b"]


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)

"""What is asked of stored scans and logs: counts, kinds, recent and suggested queries, what is still held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(rows: DataFrame, kind: Column | str, name: str = "kind") -> DataFrame:
    """(kind, n): how many rows there are of each kind, a null kind too."""
    return rows.groupBy((F.col(kind) if isinstance(kind, str) else kind).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def kinds(rows: DataFrame, kind: Column | str, name: str = "kind") -> DataFrame:
    """(kind): the kinds that there are, each once."""
    return rows.select((F.col(kind) if isinstance(kind, str) else kind).alias(name)).distinct()


def recent(rows: DataFrame, query: str, at: str, most: int = 20) -> DataFrame:
    """(q, last): the queries asked last, in lower case and each once, the latest first; ties by the query."""
    return rows.groupBy(F.lower(query).alias("q")).agg(F.max(at).alias("last")).orderBy(F.desc("last"), "q").limit(most)


def suggested(rows: DataFrame, text: str, part: str, name: str = "text") -> DataFrame:
    """(text): texts that hold a part in either case, each once; an empty part is in all."""
    return kinds(rows.where(F.contains(F.lower(text), F.lit(part.lower()))), text, name)


def held(rows: DataFrame, ended: Column, at: str, now: Column, minutes: int = 10) -> DataFrame:
    """rows but those that ended more than so many minutes before now; those without a time stay."""
    old = F.coalesce(F.col(at).cast("timestamp") < now.cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)), F.lit(False))
    return rows.where(~(F.coalesce(ended, F.lit(False)) & old))

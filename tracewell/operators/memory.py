"""Search of past sessions by set similarity over an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries(seen: DataFrame) -> DataFrame:
    """One entry per session: its distinct paths."""
    return seen.select(F.col("session").alias("entry"), "path").distinct()


def similar_entries(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of a query entry and another that shares a path, with Jaccard similarity.

    `postings`: (entry, path), distinct; `queries`: (entry). Set sizes and shared
    counts are aggregates over the index; entries that share nothing never meet.
    Every hit is kept: there is no cap on candidates.
    """
    sizes = postings.groupBy("entry").agg(F.count(F.lit(1)).alias("size"))
    asked = postings.join(queries, "entry", "left_semi").select(F.col("entry").alias("query"), "path")
    shared = asked.join(postings, "path").where(F.col("query") != F.col("entry")).groupBy("query", "entry").agg(F.count(F.lit(1)).alias("shared"))
    both = shared.join(sizes, "entry").join(sizes.select(F.col("entry").alias("query"), F.col("size").alias("query_size")), "query")
    return both.select("query", "entry", "shared", (F.col("shared") / (F.col("size") + F.col("query_size") - F.col("shared"))).alias("similarity"))


def weighted_similarity(identifiers, terms, paths):
    """3 J(identifiers) + 1 J(terms) + 2 J(paths)."""
    return 3 * identifiers + terms + 2 * paths


def changed_entries(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Entries (entry, digest) to index again: new or with another digest."""
    return current.join(stored.select("entry", F.col("digest").alias("_old")), "entry", "left").where(~F.col("digest").eqNullSafe(F.col("_old"))).drop("_old")


def digests(postings: DataFrame) -> DataFrame:
    """A digest of each entry's sorted paths."""
    return postings.groupBy("entry").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("path")), "\n"), 256).alias("digest"))

"""Exactly one copy of each message of an at-least-once delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import distinct_names, squash_id
from tracewell.operators.skew import skew_join


def event_identity(event_id: Column, session: Column, number: Column) -> tuple[Column, Column]:
    """(session, sequence) of an event, each taken from `event_id` where it is missing.

    `event_id` is `session:number`; the session may itself hold colons. Case,
    surrounding white space and leading zeros mean nothing. What is no 64-bit
    number is none.
    """
    whole = squash_id(event_id)
    of_id = F.regexp_extract(whole, r"^(.*?)\s*:\s*0*([0-9]+)$", 1)
    number_of_id = F.regexp_extract(whole, r"^.*:\s*0*([0-9]+)$", 1)
    name = F.coalesce(squash_id(session), F.when(of_id != "", of_id))
    return name, F.coalesce(number.try_cast("long"), number_of_id.try_cast("long"))


def split_by_frequency(messages: DataFrame, keys: list[str], delivery: str) -> tuple[DataFrame, DataFrame]:
    """(messages whose identifier occurs once, messages of repeated identifiers).

    Frequencies are aggregated over a 64-bit hash of the identifier, pre-summed
    on the map side. Two identifiers with one hash merely travel with the
    repeated ones, where they are told apart.
    """
    id_ = distinct_names(messages.columns, ["_id"])["_id"]
    hashed = messages.withColumn(id_, F.xxhash64(*keys))
    counts = hashed.groupBy(id_).agg(F.count(F.lit(1)).alias("n"))
    often = counts.where(F.col("n") > 1)
    # One identifier may hold any share of the messages: the split is a salted join.
    spread = F.col(delivery)
    single = skew_join(hashed, often.select(id_), [id_], spread, "left_anti", often)
    again = skew_join(hashed, often.select(id_), [id_], spread, "left_semi", often)
    return single.drop(id_), again.drop(id_)


def repeated_groups(again: DataFrame, keys: list[str], at: str, delivery: str) -> DataFrame:
    """The delivery kept of each repeated identifier: (keys, `_kept`).

    The least (`at`, `delivery`); an aggregation that is combined on the map
    side, so no group is ever sorted or held in one task. Null `at` counts as latest.
    """
    first = F.min(F.struct(F.col(at).isNull().alias("a"), F.col(at).alias("b"), F.col(delivery).alias("c")))
    return again.groupBy(*keys).agg(first.getField("c").alias("_kept"))


def dropped_deliveries(messages: DataFrame, keys: list[str], at: str, delivery: str) -> DataFrame:
    """The messages to drop so that exactly one copy of each identifier stays.

    `delivery` is unique over all messages. Kept is the copy with the earliest
    `at`, of equal ones the one with the smallest `delivery`. A message without
    identifier (a null key) is no copy of anything and never dropped.
    """
    named = messages
    for k in keys:
        named = named.where(F.col(k).isNotNull())
    _, again = split_by_frequency(named, keys, delivery)
    kept = repeated_groups(again, keys, at, delivery).select(F.col("_kept").alias(delivery))
    return again.join(kept, delivery, "left_anti")  # by the unique delivery: no hot key is left


def dedup_messages(stored: DataFrame | None, new: DataFrame, keys: list[str], at: str, delivery: str) -> DataFrame:
    """Stored and new messages with one copy of each identifier.

    Singletons pass directly; only repeated groups are ranked; both results and
    the messages without identifier are united. Columns are those of `new`;
    further columns keep their names. Empty inputs give an empty result.
    """
    both = new if stored is None else stored.unionByName(new, allowMissingColumns=True)

    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    named, nameless = both.where(~missing), both.where(missing)
    single, again = split_by_frequency(named, keys, delivery)
    kept = repeated_groups(again, keys, at, delivery).select(F.col("_kept").alias(delivery))
    return single.unionByName(again.join(kept, delivery, "left_semi")).unionByName(nameless)


def identified_events(events: DataFrame) -> DataFrame:
    """(delivery_id, received_at, session, number) of the raw event log."""
    session, number = event_identity(F.col("event_id"), F.col("session_id"), F.col("sequence"))
    return events.select("delivery_id", "received_at", session.alias("session"), number.alias("number"))


def duplicate_events(events: DataFrame) -> DataFrame:
    """Deliveries of the event log to drop, with the event id they repeat."""
    gone = dropped_deliveries(identified_events(events), ["session", "number"], "received_at", "delivery_id")
    return gone.select("delivery_id", F.concat_ws(":", "session", F.col("number").cast("string")).alias("event_id"))

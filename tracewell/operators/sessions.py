"""Folds of the event log: sessions, investigations, paths, days, follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import squash_id
from tracewell.operators.dedup import dedup_messages, event_identity
from tracewell.operators.joins import range_union
from tracewell.operators.skew import skew_join

#: What the folds read of a payload; other fields are left alone.
PAYLOAD = (
    "path string, observation_kind string, line_start long, line_end long, bytes long, tool_name string, tool_call_id string, category string, repository_operation string, "
    "ok boolean, output_bytes long, model string, input_tokens long, output_tokens long, cached_input_tokens long, cached_output_tokens long, "
    "reasoning_tokens long, usage_estimated boolean, text string, content string, role string, task string, note string, outcome string, reason string"
)
#: How far an artifact's follow-up is looked for, in events.
FOLLOW_UP = 64
#: Days that daily buckets are kept, back from the newest.
KEEP_DAYS = 400


def event_instant(c: Column) -> Column:
    """Microseconds since 1970 of an RFC 3339 text with any offset; null where it is none."""
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(c, r"^[\s]+|[\s]+$", "")))


def clean_events(events: DataFrame) -> DataFrame:
    """One delivery of each event, with session, number, instant and parsed payload `p`."""
    session, number = event_identity(F.col("event_id"), F.col("session_id"), F.col("sequence"))
    named = events.select(
        "delivery_id",
        "batch_id",
        "received_at",
        session.alias("session"),
        number.alias("number"),
        squash_id(F.col("investigation_id")).alias("investigation"),
        squash_id(F.col("repository_id")).alias("repository"),
        F.col("event_type"),
        event_instant(F.col("event_time")).alias("at_us"),
        F.from_json("payload", PAYLOAD).alias("p"),
    )
    return dedup_messages(None, named, ["session", "number"], "received_at", "delivery_id")


def first_known(value: Column, order: Column) -> Column:
    """The first non-null value by an order; aggregated on the map side."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def session_fold(events: DataFrame) -> DataFrame:
    """One row per session: identity, span, model usage, tools, observations, completion."""
    kind = F.col("event_type")
    when = lambda t, v: F.sum(F.when(kind == t, v).otherwise(0))
    one = F.lit(1)
    return events.groupBy("session").agg(
        first_known(F.col("investigation"), F.col("number")).alias("investigation"),
        first_known(F.col("repository"), F.col("number")).alias("repository"),
        F.count(one).alias("n_events"),
        F.min("number").alias("first_number"),
        F.max("number").alias("last_number"),
        F.min("at_us").alias("started_us"),
        F.max("at_us").alias("ended_us"),
        when("model_call_completed", one).alias("model_calls"),
        when("model_call_completed", F.coalesce("p.input_tokens", F.lit(0))).alias("input_tokens"),
        when("model_call_completed", F.coalesce("p.output_tokens", F.lit(0))).alias("output_tokens"),
        when("tool_call_started", one).alias("tool_calls"),
        F.count_if((kind == "tool_call_completed") & (F.col("p.ok") == F.lit(False))).alias("failed_tool_calls"),
        F.count_if((kind == "source_observed") & (F.coalesce(F.col("p.path"), F.lit("")) != "")).alias("observations"),
        F.count_if((kind == "source_observed") & (F.col("p.observation_kind") == "explicit_read")).alias("explicit_reads"),
        F.max((kind == "session_completed").cast("int")).alias("completed"),
        F.max(F.when(kind == "task_outcome", F.coalesce(F.col("p.outcome"), F.lit("unknown")).rlike("fail|timeout").cast("int")).otherwise(0)).alias("failed"),
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """Stored session parts merged with those of later events: sums, extremes, first identities.

    Parts have the columns of `session_fold`; identities come from the part that begins first.
    """
    order = F.col("first_number")
    sums = ["n_events", "model_calls", "input_tokens", "output_tokens", "tool_calls", "failed_tool_calls", "observations", "explicit_reads"]
    return parts.groupBy("session").agg(
        first_known(F.col("investigation"), order).alias("investigation"),
        first_known(F.col("repository"), order).alias("repository"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.min(c).alias(c) for c in ("first_number", "started_us")],
        *[F.max(c).alias(c) for c in ("last_number", "ended_us", "completed", "failed")],
    ).select(*parts.columns)


def investigation_fold(sessions: DataFrame) -> DataFrame:
    """Sessions to investigations. State: failed, else completed (all), partial (some), open."""
    state = F.when(F.max("failed") == 1, "failed").when(F.min("completed") == 1, "completed").when(F.max("completed") == 1, "partial").otherwise("open")
    return sessions.where("investigation is not null").groupBy("investigation").agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.sum("n_events").alias("n_events"),
        F.sum("model_calls").alias("model_calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("tool_calls").alias("tool_calls"),
        F.min("started_us").alias("started_us"),
        F.max("ended_us").alias("ended_us"),
        state.alias("state"),
    )


def observations(events: DataFrame) -> DataFrame:
    """Observations of source paths."""
    seen = events.where((F.col("event_type") == "source_observed") & (F.coalesce(F.col("p.path"), F.lit("")) != ""))
    return seen.select("session", "number", "investigation", "repository", "at_us", F.col("p.path").alias("path"), F.col("p.observation_kind").alias("kind"), F.col("p.line_start").alias("line_start"), F.col("p.line_end").alias("line_end"), F.coalesce("p.bytes", F.lit(0)).alias("bytes"))


def exposures(seen: DataFrame) -> DataFrame:
    """Per session and path: how often and how it was observed."""
    return seen.groupBy("session", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("kind") == "explicit_read").alias("n_reads"),
        F.count_if(F.col("kind") == "search_snippet").alias("n_snippets"),
        F.min("number").alias("first_number"),
        F.max("number").alias("last_number"),
    )


def observed_ranges(seen: DataFrame) -> DataFrame:
    """Line ranges per session and path, overlapping or adjacent ones merged."""
    return range_union(seen.where("line_start is not null and line_end is not null").select("session", "path", "line_start", "line_end"), ["session", "path"], "line_start", "line_end")


def path_activity(seen: DataFrame) -> DataFrame:
    """Lifetime counters per repository and path."""
    return seen.groupBy("repository", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("kind") == "explicit_read").alias("n_reads"),
        F.countDistinct("session").alias("n_sessions"),
        F.countDistinct("investigation").alias("n_investigations"),
        F.min("at_us").alias("first_us"),
        F.max("at_us").alias("last_us"),
    )


def daily_buckets(seen: DataFrame, keep: int = KEEP_DAYS) -> DataFrame:
    """Per repository, path and day: observations, reads, distinct investigations; days older than the newest of the path minus `keep` are left out."""
    day = F.floor(F.col("at_us") / 86_400_000_000).cast("long")
    daily = seen.where("at_us is not null").groupBy("repository", "path", day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "explicit_read").alias("n_reads"), F.countDistinct("investigation").alias("n_investigations"))
    newest = daily.groupBy("repository", "path").agg(F.max("day").alias("newest"))
    return daily.join(newest, ["repository", "path"]).where(F.col("day") >= F.col("newest") - keep).drop("newest")


def sliding_activity(seen: DataFrame, days: int) -> DataFrame:
    """Per repository and path over the last `days` days of its repository: observations, reads, distinct investigations."""
    day = F.floor(F.col("at_us") / 86_400_000_000)
    dated = seen.where("at_us is not null").withColumn("day", day)
    newest = dated.groupBy("repository").agg(F.max("day").alias("newest"), F.count(F.lit(1)).alias("n"))
    # A repository may hold any share of the observations.
    recent = skew_join(dated, newest.select("repository", "newest"), ["repository"], F.xxhash64("session", "number"), counts=newest.select("repository", "n")).where(F.col("day") >= F.col("newest") - days)
    return recent.groupBy("repository", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "explicit_read").alias("n_reads"), F.countDistinct("investigation").alias("n_investigations"))


#: What a repository operation, or else a tool category, is an activity of; all others are unclassified. Fixed values.
OPERATIONS = {"discovery": ["discovery_search", "discovery_list"], "verification": ["source_read"], "task_action": ["edit", "build", "test", "runtime"]}
CATEGORIES = {"discovery": ["search", "directory_list"], "verification": ["file_read"]}


def activity() -> Column:
    """The activity of an event: artifact, discovery, verification, task_action, unclassified; null for none."""
    operation = category = F.lit("unclassified")
    for name, values in OPERATIONS.items():
        operation = F.when(F.col("p.repository_operation").isin(values), name).otherwise(operation)
    for name, values in CATEGORIES.items():
        category = F.when(F.col("p.category").isin(values), name).otherwise(category)
    call = F.when(F.col("p.repository_operation").isNotNull(), operation).otherwise(category)
    kind = F.col("event_type")
    return F.when(kind == "context_artifact_presented", "artifact").when(kind == "tool_call_started", call).when(kind == "source_observed", "verification")


def positions(events: DataFrame, block: int = 1024) -> DataFrame:
    """`events` (session, number, distinct) with `position`: how many of its session come before.

    Numbers are cut into blocks, which hold `block` events at most; blocks are
    counted and summed up, so that no session is sorted in one task.
    """
    cut = events.withColumn("_block", F.floor(F.col("number") / block))
    sizes = cut.groupBy("session", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("session").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("session", "_block").orderBy("number")) - 1
    return cut.withColumn("_w", within).join(sizes.select("session", "_block", before.alias("_before")), ["session", "_block"]).withColumn("position", F.col("_before") + F.col("_w")).drop("_block", "_w", "_before")


def follow_ups(events: DataFrame, reach: int = FOLLOW_UP) -> DataFrame:
    """What follows each presented artifact within the next `reach` events of its session.

    The scan ends at the next artifact or task action. Precedence: discovery,
    artifact, verification, task_action, unclassified, none. A tool call that
    made an artifact of its session is no activity. Positions are cut into blocks of
    `reach`, so that the join key is (session, block): a session of any length
    is spread. Returns session, start (the artifact's number), outcome, n_after (events scanned)
    and verified (whether a verification came first). Events without a number are left out.
    """
    flat = events.where("number is not null").select("session", "number", activity().alias("kind"), F.col("p.tool_call_id").alias("call"))
    made = flat.where("kind = 'artifact' and call is not null").select("session", "call").distinct().withColumn("_made", F.lit(True))
    flat = flat.join(made, ["session", "call"], "left").select("session", "number", F.when(F.col("_made") & (F.col("kind") != "artifact"), None).otherwise(F.col("kind")).alias("kind"))
    placed = positions(flat)
    block = lambda c: F.floor(c / reach).cast("long")
    starts = placed.where("kind = 'artifact'").select("session", F.col("number").alias("start"), F.col("position").alias("at"))
    near = starts.withColumn("block", F.explode(F.array(block(F.col("at")), block(F.col("at")) + 1)))
    after = near.join(placed.select("session", "position", "kind", block(F.col("position")).alias("block")), ["session", "block"]).where((F.col("position") > F.col("at")) & (F.col("position") <= F.col("at") + reach))
    stops = F.min(F.when(F.col("kind").isin("artifact", "task_action"), F.col("position")))
    per = after.groupBy("session", "start").agg(stops.alias("stop"), F.collect_list(F.struct("position", "kind")).alias("seen"))  # `reach` events at most
    seen = F.filter("seen", lambda x: F.col("stop").isNull() | (x.position <= F.col("stop")))
    has = lambda k: F.exists(F.col("seen"), lambda x: F.coalesce(x.kind == k, F.lit(False)))
    per = per.withColumn("seen", seen)
    outcome = F.lit("none")
    for name in ("unclassified", "task_action", "verification", "artifact", "discovery"):
        outcome = F.when(has(name), name).otherwise(outcome)
    found = per.select("session", "start", outcome.alias("outcome"), F.size("seen").alias("n_after"), has("verification").alias("verified"))
    return starts.select("session", "start").join(found, ["session", "start"], "left").select("session", "start", F.coalesce("outcome", F.lit("none")).alias("outcome"), F.coalesce("n_after", F.lit(0)).alias("n_after"), F.coalesce("verified", F.lit(False)).alias("verified"))


def floor_percentiles(df: DataFrame, keys: list[str], value: str, levels: dict[str, float], buckets: int = 4096) -> DataFrame:
    """Percentiles at index floor((n - 1) q) of the sorted whole numbers, with n and max.

    Values are counted in `buckets` equal ranges of each key first; a second
    count tells the values of just those buckets that hold a percentile. So no
    key's values are sorted in one task, however many there are.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.max("_v").alias("most"), F.min("_v").alias("_least"))
    width = F.greatest(F.ceil((F.col("most") - F.col("_least") + 1) / buckets), F.lit(1))
    placed = counts.join(total, keys).withColumn("_b", F.floor((F.col("_v") - F.col("_least")) / width))
    sums = placed.groupBy(*keys, "n", "most", "_b").agg(F.sum("_c").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    run = sums.withColumn("_from", F.coalesce(before, F.lit(0)))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.floor((F.col("n") - 1) * q).alias("at")) for name, q in levels.items()]))
    wanted = run.withColumn("_q", asked).where((F.col("_from") <= F.col("_q.at")) & (F.col("_q.at") < F.col("_from") + F.col("_s"))).select(*keys, "_b", "_from", "_q")
    within = F.sum("_c").over(Window.partitionBy(*keys, "_b", "_q.name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    fine = placed.join(wanted, [*keys, "_b"]).withColumn("_to", F.col("_from") + within).where(F.col("_to") > F.col("_q.at"))
    return fine.groupBy(*keys, "n", "most").agg(*[F.min(F.when(F.col("_q.name") == name, F.col("_v"))).alias(name) for name in levels])


def shrunken_rates(df: DataFrame, keys: list[str], hit: str, least: int = 5, weight: int = 3) -> DataFrame:
    """(hits + weight g) / (n + weight) where n >= least, else the global rate g."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("long")).alias("hits")).withColumn("_one", F.lit(1))
    whole = per.groupBy("_one").agg((F.sum("hits") / F.sum("n")).alias("g"))
    rate = F.when(F.col("n") >= least, (F.col("hits") + weight * F.col("g")) / (F.col("n") + weight)).otherwise(F.col("g"))
    return per.join(F.broadcast(whole), "_one").select(*keys, "n", "hits", rate.alias("rate"))


def mined_recipes(df: DataFrame, owner: list[str], term: str, least: int = 2) -> DataFrame:
    """Sorted term sets that at least `least` owners share: (terms, n)."""
    sets = df.groupBy(*owner).agg(F.array_join(F.sort_array(F.collect_set(term)), ",").alias("terms"))
    return sets.groupBy("terms").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def derive_incrementally(stored: DataFrame, log: DataFrame, new: DataFrame) -> DataFrame:
    """Session parts after new events.

    Where all new events of a session come after its stored last number, they
    are folded alone and merged. A session with a late event is folded again from the log.
    `log`: all clean events, the new ones included; `new`: those that came since.
    """
    offset = stored.select("session", F.col("last_number").alias("_last"))
    late = new.join(offset, "session").where(F.col("number") <= F.col("_last")).select("session").distinct()
    again = session_fold(log.join(late, "session", "left_semi"))
    rest = session_fold(new.join(late, "session", "left_anti"))
    return merge_parts(stored.join(late, "session", "left_anti").unionByName(rest)).unionByName(again.select(*stored.columns))


def path_mentions(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, repository_id, relative_path): known paths that a text of the repository names.

    Words with a `/` or an extension are taken, without surrounding marks and a
    line reference (`:12`, `#L12`). Repeated mentions come out once.
    """
    word = F.explode(F.split(F.col(text), r"[\s`'\"()\[\]{}<>,;]+"))
    plain = F.regexp_replace(F.regexp_replace("_w", r"^\./|[.:!?*]+$", ""), r"(?:#L?\d+(?:-L?\d+)?|:\d+(?:[:-]\d+)?)$", "")
    said = texts.where(F.col(text).isNotNull()).select(key, "repository_id", word.alias("_w")).where(F.col("_w").rlike(r"[./]")).select(key, "repository_id", plain.alias("relative_path")).distinct()
    return said.join(known.select("repository_id", "relative_path").distinct(), ["repository_id", "relative_path"]).select(key, "repository_id", "relative_path")


def mention_counts(mentions: DataFrame, owner: str) -> DataFrame:
    """Distinct owners per path."""
    return mentions.groupBy("repository_id", "relative_path").agg(F.countDistinct(owner).alias("n_owners"))


def utility_counts(rows: DataFrame, keys: list[str], used: str) -> DataFrame:
    """Observations and uses per key, a use counting once however often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.col(used), F.lit(1))).alias("n_used"))


def gap_report(gaps: DataFrame) -> DataFrame:
    """Gaps overall and by family, reason and intent: one pass over grouping sets."""
    return gaps.groupingSets([[], ["family"], ["reason"], ["intent"]], "family", "reason", "intent").agg(F.count(F.lit(1)).alias("n"))

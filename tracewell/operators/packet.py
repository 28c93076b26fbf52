"""Query answers as compact text lines, and back.

Q query / F number kind key label / R relation source target f|c [cs=set] / S key=value ...
Numbers are local, given in key order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.identifiers import packet_quote

HEADER = "#packet v1"
_FIELD = re.compile(r'"((?:[^"\\]|\\.)*)"|(\S+)')


def render_packets(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """One text per query. `facts`: query, node_id, node_kind, node_key, label; `relations`: query, edge_kind, source, target, evidence_class, candidate_set_id.

    Relations whose ends are no facts of the query are left out. A packet holds
    the facts of one query, which its limits bound.
    """
    number = F.row_number().over(Window.partitionBy("query").orderBy("node_key", "node_id"))
    f = facts.dropDuplicates(["query", "node_id"]).withColumn("lid", number)
    lines_f = f.select("query", F.lit(1).alias("part"), F.col("lid").alias("k"), F.concat_ws(" ", F.lit("F"), "lid", "node_kind", packet_quote(F.col("node_key")), packet_quote(F.coalesce("label", F.lit("")))).alias("line"))
    ids = f.select("query", "node_id", "lid")
    r = (
        relations.join(ids.select("query", F.col("node_id").alias("source"), F.col("lid").alias("s")), ["query", "source"])
        .join(ids.select("query", F.col("node_id").alias("target"), F.col("lid").alias("t")), ["query", "target"])
        .distinct()
    )
    mark = F.when(F.col("evidence_class") == "fact", "f").otherwise("c")
    text = F.concat_ws(" ", F.lit("R"), "edge_kind", "s", "t", mark, F.when(F.col("candidate_set_id").isNotNull(), F.concat(F.lit("cs="), "candidate_set_id")))
    order = F.row_number().over(Window.partitionBy("query").orderBy("s", "t", "edge_kind", text))
    lines_r = r.select("query", F.lit(2).alias("part"), order.alias("k"), text.alias("line"))
    both = lines_f.unionByName(lines_r)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "k", "line"))), lambda x: x.line), "\n")
    count = lambda p: F.count_if(F.col("part") == p).cast("string")
    return both.groupBy("query").agg(
        F.concat(F.lit(HEADER + "\nQ "), packet_quote(F.col("query")), F.lit("\n"), body, F.lit("\nS facts="), count(1), F.lit(" relations="), count(2), F.lit("\n")).alias("packet")
    )


def packet_json(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(query, packet): the same answer as one JSON object, arrays in canonical order."""
    f = facts.distinct().groupBy("query").agg(F.sort_array(F.collect_list(F.struct("node_key", "node_kind", "label"))).alias("facts"))
    r = relations.distinct().groupBy("query").agg(F.sort_array(F.collect_list(F.struct("edge_kind", "source", "target", "evidence_class", "candidate_set_id"))).alias("relations"))
    return f.join(r, "query", "left").select("query", F.to_json(F.struct("query", "facts", "relations")).alias("packet"))


def packet_human(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(query, packet): the same answer as indented lines for people."""
    f = facts.distinct().select("query", F.lit(1).alias("p"), F.format_string("  %s  %s  %s", "node_kind", "node_key", F.coalesce("label", F.lit(""))).alias("line"))
    r = relations.distinct().select("query", F.lit(2).alias("p"), F.format_string("  %s -%s-> %s (%s)", "source", "edge_kind", "target", "evidence_class").alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "line"))), lambda x: x.line), "\n")
    return f.unionByName(r).groupBy("query").agg(body.alias("packet"))


@dataclass
class Packet:
    query: str | None = None
    facts: list[tuple[int, str, str, str]] = field(default_factory=list)
    relations: list[tuple[str, int, int, str, str | None]] = field(default_factory=list)
    summary: dict[str, str] = field(default_factory=dict)


def _words(line: str) -> list[str]:
    unescape = lambda s: re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), s)
    return [unescape(m[1]) if m[1] is not None else m[2] for m in _FIELD.finditer(line)]


def parse_packet(text: str) -> Packet:
    """The inverse of a rendered packet; raises ValueError where it is none."""
    lines = text.splitlines()
    if not lines or lines[0] != HEADER:
        raise ValueError("header")
    out = Packet()
    for line in lines[1:]:
        kind, *rest = _words(line) or [""]
        if kind == "Q":
            out.query = rest[0] if rest else ""
        elif kind == "F" and len(rest) == 4:
            out.facts.append((int(rest[0]), *rest[1:]))
        elif kind == "R" and len(rest) in (4, 5):
            out.relations.append((rest[0], int(rest[1]), int(rest[2]), rest[3], rest[4].removeprefix("cs=") if len(rest) == 5 else None))
        elif kind == "S":
            out.summary |= dict(w.split("=", 1) for w in rest)
        elif line.strip():
            raise ValueError(line)
    known = {n for n, *_ in out.facts}
    if any(s not in known or t not in known for _, s, t, *_ in out.relations):
        raise ValueError("relation without fact")
    return out

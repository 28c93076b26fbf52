"""Normal forms of identifiers, paths and digests, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space round an identifier (`\\s` in a regular expression plus no-break space).
EDGE_SPACE = r"^[\s\x{A0}]+|[\s\x{A0}]+$"


def squash_id(c: Column) -> Column:
    """Lower case without surrounding white space; null where nothing is left."""
    plain = F.lower(F.regexp_replace(c, EDGE_SPACE, ""))
    return F.when(plain != "", plain)


def canonical_path(c: Column) -> Column:
    """`/`-separated path relative to the root, without empty or `.` segments. Case is kept."""
    parts = F.split(F.regexp_replace(c, r"\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".")), "/")


def digest_hex(c: Column) -> Column:
    """The 64 hexadecimal digits of a SHA-256 digest in lower case; null where there are none."""
    digits = F.regexp_extract(F.lower(c), r"([0-9a-f]{64})\s*$", 1)
    return F.when(digits != "", digits)


def known(c: Column) -> Column:
    """The value without surrounding white space; null where it is blank."""
    plain = F.regexp_replace(c, EDGE_SPACE, "")
    return F.when(plain != "", plain)


def distinct_names(taken: list[str], wanted: list[str]) -> dict[str, str]:
    """Names for helper columns that clash with none of `taken` (without regard to case)."""
    used = {t.lower() for t in taken}
    out = {}
    for w in wanted:
        name = w
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out[w] = name
    return out

"""Scalar functions on identifiers, names, paths and queries, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that a term may lose. Fixed values.
SUFFIXES = ["tion", "ment", "ing", "ers", "ies", "ed", "er", "or", "es", "s", "ly", "al", "ity"]

#: Where an identifier divides: hump, end of an acronym, letter and digit either way.
_BOUNDARY = r"[^\p{L}\p{N}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"


def identifier_terms(c: Column) -> Column:
    """Lower-case terms of an identifier; `vec2d` gives vec, 2, d."""
    return F.filter(F.transform(F.split(c, _BOUNDARY), F.lower), lambda t: t != "")


def morph_variants(c: Column) -> Column:
    """A term and what is left of it without each known suffix (three letters at least), also with `e`, for `ies` with `y`."""

    def of(suffix: str) -> Column:
        base = F.substring(c, F.lit(1), F.length(c) - len(suffix))
        ways = [base, F.concat(base, F.lit("e"))] + ([F.concat(base, F.lit("y"))] if suffix == "ies" else [])
        return F.when(c.endswith(suffix) & (F.length(base) >= 3), F.array(*ways)).otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.flatten(F.array(F.array(c), *[of(s) for s in SUFFIXES]))))


def query_normal_form(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def question_body(c: Column) -> Column:
    """The text between QUESTION: and INSTRUCTIONS:, or all of it."""
    inner = F.regexp_extract(c, r"(?s)QUESTION:\s*(.*?)\s*(?:INSTRUCTIONS:|\z)", 1)
    return F.when(inner != "", inner).otherwise(F.trim(c))


def is_identifier_like(c: Column) -> Column:
    """Three characters or more, with an underscore, `::`, upper-case letter or digit."""
    return (F.length(c) >= 3) & c.rlike(r"_|::|\p{Lu}|\p{N}")


def directory(c: Column) -> Column:
    """The path up to the last `/`, empty at the root."""
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def join_dir(d: Column, name: Column) -> Column:
    return F.when(d == "", name).otherwise(F.concat_ws("/", d, name))


def rust_module_dir(c: Column) -> Column:
    """Where a Rust file's child modules live: mod.rs, lib.rs and main.rs keep their folder."""
    return F.when(basename(c).isin("mod.rs", "lib.rs", "main.rs"), directory(c)).otherwise(F.regexp_replace(c, r"\.rs$", ""))


def python_module(c: Column) -> Column:
    """`a/b.py` is a.b, `a/__init__.py` is a."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\.pyi?$", ""), r"(^|/)__init__$", "")
    return F.translate(plain, "/", ".")


def relative_base(d: Column, levels: Column) -> Column:
    """`d` without its last levels - 1 segments; null where that leaves nothing: at the root or above it."""
    parts = F.filter(F.split(d, "/"), lambda p: p != "")
    keep = F.size(parts) - (levels - 1)
    return F.when(keep >= 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(1))), "/"))


def ancestors(c: Column) -> Column:
    """All folders that hold a path, the innermost first, the root ('') last."""
    parts = F.split(directory(c), "/")
    inner = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(inner, F.array(F.lit(""))))


def php_last_segment(c: Column) -> Column:
    return F.substring_index(c, "\\", -1)


def php_class_fqn(written: Column, namespace: Column, aliases: Column) -> Column:
    """The full name of a written class: leading backslash, `namespace\\`, alias of its first part, else the namespace."""
    first = F.lower(F.substring_index(written, "\\", 1))
    rest = F.regexp_replace(written, r"^[^\\]*", "")
    here = F.coalesce(namespace, F.lit(""))
    own = F.when(here == "", written).otherwise(F.concat(here, F.lit("\\"), written))
    return (
        F.when(written.startswith("\\"), F.substring(written, 2, 1_000_000))
        .when(F.lower(written).startswith("namespace\\"), F.when(here == "", F.substring(written, 11, 1_000_000)).otherwise(F.concat(here, F.substring(written, 10, 1_000_000))))
        .when(F.coalesce(F.map_contains_key(aliases, first), F.lit(False)), F.concat(F.element_at(aliases, first), rest))
        .otherwise(own)
    )


def php_hint_classes(hint: Column) -> Column:
    """Classes a type hint names: `?T` and `A|B` arms; an `A&B` names none; builtins and `static` are no classes."""
    builtin = ["int", "float", "string", "bool", "array", "callable", "iterable", "object", "mixed", "void", "never", "null", "false", "true", "static"]
    arms = F.transform(F.split(F.regexp_replace(hint, r"^\?", ""), r"\|"), lambda a: F.trim(a))
    return F.when(hint.contains("&"), F.array().cast("array<string>")).otherwise(F.filter(arms, lambda a: (a != "") & ~F.lower(a).isin(builtin)))


def go_selector(c: Column) -> tuple[Column, Column]:
    """(operand, name) of `pkg.Func`, both empty for what is no direct selector."""
    pattern = r"^([\p{L}_][\p{L}\p{N}_]*)\.([\p{L}_][\p{L}\p{N}_]*)$"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)


def go_exported(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def glob_segment(path: Column, pattern: str) -> Column:
    """Whether a path matches a pattern whose `*` stays within one segment."""
    inner = "".join("[^/]*" if ch == "*" else ("\\" + ch if not ch.isalnum() and ch not in "/_-" else ch) for ch in pattern)
    return path.rlike(f"^{inner}$")


def go_mod_directive(text: Column) -> Column:
    """The module path of a go.mod text."""
    return F.regexp_extract(text, r'(?m)^\s*module\s+"?([^\s"]+)"?', 1)


def sha256_tag(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def content_id(prefix: str, *parts: Column) -> Column:
    """A stable id: the prefix and 16 hexadecimal digits over the parts."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16))


def day_index(ts: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(ts))


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def event_time(c: Column) -> Column:
    """The instant of an RFC 3339 text; null where it is none."""
    return F.try_to_timestamp(c)


def range_contains(a: str, b: str) -> Column:
    """Whether span `a` holds span `b`, ends included."""
    return (F.col(f"{a}.byte_start") <= F.col(f"{b}.byte_start")) & (F.col(f"{b}.byte_end") <= F.col(f"{a}.byte_end"))


def range_overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether half-open ranges overlap."""
    return (s1 < e2) & (s2 < e1)


def overlap_class(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """How an observed range (1) meets a symbol's (2): none, inside, covers or partial."""
    return (
        F.when(~range_overlaps(s1, e1, s2, e2), "none")
        .when((s2 <= s1) & (e1 <= e2) & ~((s1 == s2) & (e1 == e2)), "inside")
        .when((s1 <= s2) & (e2 <= e1), "covers")
        .otherwise("partial")
    )


def visible_at(ranges: Column, position: Column) -> Column:
    """Whether any half-open visibility range (byte_start, byte_end) holds a position."""
    return F.exists(ranges, lambda r: (r.byte_start <= position) & (position < r.byte_end))


def line_of(starts: Column, offset: Column) -> Column:
    """The line (from 0) of an offset, given the offsets at which lines start."""
    return F.size(F.filter(starts, lambda s: s <= offset)) - 1


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def reason_head(c: Column) -> Column:
    """The reason up to the first parenthesis or blank."""
    return F.regexp_extract(c, r"^[^(\s]+", 0)


def packet_quote(c: Column) -> Column:
    """Text quoted for the line packet: backslash, quote, line feed and tab escaped."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(plain, "\n", r"\\n"), "\t", r"\\t"), F.lit('"'))


def test_shaped(name: Column, path: Column) -> Column:
    """Whether a name or path looks like a test."""
    low, where = F.lower(name), F.lower(path)
    return low.rlike(r"^test|_test$|tests?$") | where.rlike(r"(^|/)tests?/|_test\.|(^|/)test_|\.spec\.|\.test\.")


def question_priority(a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    return 4 * a + 3 * b + 2 * c - d - e


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 where either set is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))

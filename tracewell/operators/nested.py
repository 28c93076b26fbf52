"""Deeply nested JSON records to related flat tables.

A record is read token by token into (path, ordinals, value) triples. Triples
are grouped by their repeated ancestor - the innermost named array of objects -
and each group is pivoted into the rows of one table, which keep the ordinals
and chosen fields of their ancestors. All of it happens within the record, so
nothing is shuffled and records of any number are streamed. The rows of all
groups are written once, by group; each table reads its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import distinct_names
from tracewell.session import written

#: Tokens of JSON, white space and (one at a time) what is no token.
_TOKENS = re.compile(r'[\[\]{},:]|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[ \t\r\n]+|.', re.S)
#: A tree of repeated ancestors: name -> the repeated ancestors within it.
Tree = dict[str, "Tree"]


class Damaged(ValueError):
    """The text is no complete JSON value."""


class Place:
    """A path of keys, made once for all records: its repeated ancestors and what lies below the last of them."""

    __slots__ = ("kids", "at", "leaf", "table", "repeats", "slot")

    def __init__(self, at: Tree, table: str, leaf: tuple[str, ...], repeats: bool, slots: dict[str, dict[str, int]]) -> None:
        self.kids: dict[str, Place] = {}
        self.at, self.table, self.leaf, self.repeats = at, table, leaf, repeats
        #: The column of a scalar here in the table of its ancestor, if any.
        self.slot = slots.get(table, {}).get(".".join(leaf))

    def kid(self, name: str, slots: dict[str, dict[str, int]]) -> Place:
        if name in self.at:
            made = Place(self.at[name], f"{self.table}.{name}" if self.table else name, (), True, slots)
        else:
            made = Place(self.at, self.table, (*self.leaf, name), False, slots)
        self.kids[name] = made
        return made


class Row:
    """One element of a repeated ancestor."""

    __slots__ = ("table", "ordinals", "values", "above", "below")

    def __init__(self, table: str, ordinals: tuple[int, ...], above: Row | None) -> None:
        self.table, self.ordinals, self.above = table, ordinals, above
        self.values: dict[int, str] = {}
        self.below: dict[tuple[str, int], Row] = {}


def record_rows(text: str, root: Place, slots: dict[str, dict[str, int]]) -> list[Row]:
    """The rows of a record: its (path, ordinals, value) triples, each put where it belongs as it is read.

    A key's ordinal is the position among its values, 0 unless it holds an array (arrays in arrays count on).
    Numbers and booleans come as written, null scalars give no triple. A text that is itself a JSON string
    holding JSON is read through. Raises Damaged where the text is not complete.

    Keys between two named ancestors are wrappers and mean nothing. The empty
    leaf is the value of an ancestor that is a scalar itself.
    """
    rows: list[Row] = []
    top = Row("", (), None)

    def element(place: Place, row: Row, ordinal: int) -> Row:
        key = place.table, ordinal
        made = row.below.get(key)
        if made is None:
            made = row.below[key] = Row(place.table, (*row.ordinals, ordinal), row if row.table else None)
            rows.append(made)
        return made

    # `place` and `ordinal` belong to the key whose value is read, `row` to the object that holds the key.
    place, ordinal, row, holder = root, 0, top, root
    stack: list[tuple[str, Place, int, Row, Place]] = []
    inside, expect = "", VALUE  # the innermost bracket that is open
    for token in _TOKENS.findall(text.strip(" \t\r\n\ufeff")):
        c = token[0]
        if c == '"':
            if len(token) == 1:
                raise Damaged("string")
            if expect == VALUE or expect == ELEMENT:
                if not stack:
                    if expect != VALUE or rows:
                        raise Damaged("string")
                    alone = token
                    expect = ALONE
                    continue
                if place.slot is not None or place.repeats:
                    plain = token[1:-1] if "\\" not in token else json.loads(token)
                    here = element(place, row, ordinal) if place.repeats else row
                    if place.slot is not None:
                        here.values[place.slot] = plain
                expect = NEXT
                if inside == "[":
                    ordinal += 1
            elif expect == KEY or expect == FIRST_KEY:
                name = token[1:-1] if "\\" not in token else json.loads(token)
                place, ordinal = holder.kids.get(name) or holder.kid(name, slots), 0
                expect = COLON
            else:
                raise Damaged("string")
        elif c == ",":
            if expect != NEXT or not stack:
                raise Damaged("comma")
            expect = KEY if inside == "{" else VALUE
        elif c == ":":
            if expect != COLON:
                raise Damaged("colon")
            expect = VALUE
        elif c == "{":
            if expect != VALUE and expect != ELEMENT:
                raise Damaged("object")
            stack.append((inside, place, ordinal, row, holder))
            if place.repeats:
                row = element(place, row, ordinal)
            holder, inside, expect = place, "{", FIRST_KEY
        elif c == "[":
            if expect != VALUE and expect != ELEMENT:
                raise Damaged("array")
            stack.append((inside, place, ordinal, row, holder))
            inside, expect = "[", ELEMENT
        elif c == "}":
            if inside != "{" or expect != FIRST_KEY and expect != NEXT:
                raise Damaged("end of object")
            inside, place, ordinal, row, holder = stack.pop()
            expect = NEXT
            if inside == "[":
                ordinal += 1
        elif c == "]":
            if inside != "[" or expect != ELEMENT and expect != NEXT:
                raise Damaged("end of array")
            # Arrays in arrays count on.
            inside, place, _, row, holder = stack.pop()
            expect = NEXT
        elif c in " \t\r\n":
            continue
        elif (c in "-0123456789" and token != "-" or token in ("true", "false", "null")) and (expect == VALUE or expect == ELEMENT):
            if token != "null" and stack and (place.slot is not None or place.repeats):
                here = element(place, row, ordinal) if place.repeats else row
                if place.slot is not None:
                    here.values[place.slot] = token
            expect = NEXT
            if inside == "[":
                ordinal += 1
        else:
            raise Damaged(token)
    if expect == ALONE:
        return record_rows(json.loads(alone), root, slots)
    if stack or expect != NEXT:
        raise Damaged("cut off")
    return rows


VALUE, ELEMENT, FIRST_KEY, KEY, COLON, NEXT, ALONE = range(7)


def flatten_records(df: DataFrame, carried: list[str], payload: str, tree: Tree, tables: dict[str, tuple[str, dict[str, str]]]) -> dict[str, DataFrame]:
    """One table per repeated ancestor of `tree`, with a row for each object under it, from JSON texts.

    `tables`: name -> (the ancestors, joined by `.`; column -> field). A field is a
    path below the ancestor itself ('' is a scalar element; `a|b` the first of the
    two that is there), or after `^` one of an enclosing ancestor: `^declarations:name`. Each table holds the
    `carried` columns of the record, the ordinals of its ancestors (`<ancestor>_no`)
    and its columns, all text.
    Null, empty, damaged and cut-off texts give no rows; a repeated record gives
    its rows again, to be made distinct after choosing columns.
    """
    slots: dict[str, dict[str, int]] = {}
    plan: dict[str, list[list[tuple[int, int]]]] = {}  # ancestors -> per column (levels up, slot) to try in order
    for source, columns in tables.values():
        names = source.split(".")
        plan[source] = []
        for field in columns.values():
            levels, ways = 0, field
            if field.startswith("^"):
                above, ways = field[1:].split(":")
                levels = len(names) - 1 - names.index(above)
            at = ".".join(names[: len(names) - levels])
            known = slots.setdefault(at, {})
            plan[source].append([(levels, known.setdefault(w, len(known))) for w in ways.split("|")])
    most = max(len(c) for _, c in tables.values())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Place(tree, "", (), False, slots)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                at: list[int] = []
                sources: list[str] = []
                ordinals: list[tuple[int, ...]] = []
                values: list[list[str | None]] = [[] for _ in range(most)]
                for i, text in enumerate(batch.column(len(carried)).to_pylist()):
                    if not text:
                        continue
                    try:
                        rows = record_rows(text, root, slots)
                    except ValueError:
                        continue
                    for row in rows:
                        columns = plan.get(row.table)
                        if columns is None:
                            continue
                        at.append(i)
                        sources.append(row.table)
                        ordinals.append(row.ordinals)
                        chain = [row.values, *_above(row)]
                        for k in range(most):
                            found = None
                            for levels, slot in columns[k] if k < len(columns) else ():
                                found = chain[levels].get(slot)
                                if found is not None:
                                    break
                            values[k].append(found)
                kept = batch.select(carried).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sources, pa.string()), pa.array(ordinals, pa.list_(pa.int32())), *(pa.array(v, pa.string()) for v in values)], names=[*carried, "_source", "_ordinals", *(f"_v{k}" for k in range(most))])

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    name = distinct_names(carried, ["_payload"])["_payload"]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carried), "_source string", "_ordinals array<int>", *(f"_v{k} string" for k in range(most))])
    flat = written(df.select(*carried, F.col(payload).cast("string").alias(name)).mapInArrow(read, schema), ["_source"])
    out = {}
    for table, (source, columns) in tables.items():
        numbers = [F.get("_ordinals", F.lit(i)).alias(f"{a}_no") for i, a in enumerate(source.split("."))]
        out[table] = flat.where(F.col("_source") == source).select(*carried, *numbers, *[F.col(f"_v{k}").alias(c) for k, c in enumerate(columns)])
    return out


def _above(row: Row) -> Iterator[dict[int, str]]:
    while row.above is not None:
        row = row.above
        yield row.values


#: Repeated ancestors of analysis payloads.
ANALYSIS: Tree = {"files": {"declarations": {"test_evidence": {}}, "imports": {"items": {}}, "calls": {"type_arguments": {}}}}
_PATH = {"relative_path": "^files:file.relative_path"}
#: fact kind -> its table: the ancestors, and the fields of its columns.
ANALYSIS_TABLES = {
    "declaration": ("files.declarations", _PATH | {"fact_id": "declaration_id", "fact_name": "name|"}),
    "import": ("files.imports", _PATH | {"fact_id": "import_id", "fact_name": "module|"}),
    "call": ("files.calls", _PATH | {"fact_id": "call_id", "fact_name": "callee.written|"}),
    "test_evidence": ("files.declarations.test_evidence", _PATH | {"fact_id": "^declarations:declaration_id", "fact_name": "kind|"}),
    "import_item": ("files.imports.items", _PATH | {"fact_id": "^imports:import_id", "fact_name": "target|"}),
    "type_argument": ("files.calls.type_arguments", _PATH | {"fact_id": "^calls:call_id", "fact_name": "written|"}),
}


def analysis_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The six tables of analysis payloads, one per fact and part."""
    return flatten_records(records, ["record_id"], "payload", ANALYSIS, ANALYSIS_TABLES)


def analysis_facts(records: DataFrame) -> DataFrame:
    """Facts and parts of analysis payloads as one table: each object once, with its parents' keys.

    Facts have item_index -1, parts their position. An import without module
    has the empty name; other missing names and ids are null.
    """
    out = None
    for kind, table in analysis_tables(records).items():
        source = ANALYSIS_TABLES[kind][0].split(".")
        index = F.col(f"{source[-1]}_no") if len(source) == 3 else F.lit(-1)
        name = F.coalesce("fact_name", F.lit("")) if kind == "import" else F.col("fact_name")
        part = table.select("record_id", "relative_path", F.lit(kind).alias("fact_kind"), F.trim("fact_id").try_cast("long").alias("fact_id"), index.cast("long").alias("item_index"), name.alias("fact_name"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()

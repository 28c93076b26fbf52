"""The data-processing problems of the core on small tables, against plain Python."""

import json
import random
import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.operators import dedup, hierarchy, nested, orphans, skew, snapshots

T0 = datetime(2025, 1, 1)
FILES = "repository_id string, snapshot_no long, delivery_id string, delivered_at timestamp, relative_path string, content_digest string, object_key string, _k0 string, change_kind string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_snapshot_changes(spark):
    a, b = "a" * 64, "B" * 64
    at = lambda h: T0 + timedelta(hours=h)
    data = [
        ("r", 1, "d1", at(1), "x.py", a, "k1", "clash", "c"),
        ("r", 1, "d1", at(1), "./x.py", "sha256:" + a, "k1", "clash", "c"),  # the same file, other notation
        ("r", 1, "d1", at(1), "gone.py", a, None, None, None),
        ("r", 1, "d1", at(1), "null.py", None, None, None, None),
        ("r", 4, "d2", at(2), "x.py", b, None, None, None),
        ("r", 4, "d2", at(2), "wrong.py", b, None, None, None),
        ("r", 4, "d3", at(3), "x.py", "SHA256:" + b, "k1", None, None),  # the later delivery stands, whole
        ("r", 4, "d3", at(3), "sub\\new.py", b, None, None, None),
        ("r", 4, "d3", at(3), "null.py", a, None, None, None),
        ("r", 4, "d3", at(3), None, a, None, None, None),
        ("r", None, "d9", at(9), "never.py", a, None, None, None),
        (None, 1, "d9", at(9), "never.py", a, None, None, None),
        ("s", 1, "e1", at(1), "only.py", a, "k", None, None),
    ]
    got = rows(snapshots.file_changes(spark.createDataFrame(data, FILES)))
    assert got == [("r", 4, "gone.py", "removed"), ("r", 4, "sub/new.py", "added"), ("r", 4, "x.py", "changed")]
    assert rows(snapshots.file_changes(spark.createDataFrame([], FILES))) == []


def test_orphans(spark):
    us = lambda h: T0 + timedelta(hours=h)
    lives = spark.createDataFrame([("A ", us(0), us(5)), ("a", us(0), us(5)), ("a", us(8), None), ("b", us(4), None), (None, us(0), None), ("c", None, us(1))], "key string, created timestamp, deleted timestamp")
    refs = [("1", "a", us(1)), ("1", "a", us(1)), ("2", "a", us(6)), ("3", "a", us(8)), ("4", "b", us(3)), ("5", "zz", us(3)), ("6", None, us(3)), ("7", "  ", us(3)), ("8", "c", us(0)), ("9", "c", us(1)), ("10", "zz", None), ("11", "a", None)]
    df = spark.createDataFrame(refs, "id string, key string, at timestamp")
    from tracewell.functions.text import squash_id

    made = orphans.references(df, "t", F.col("id"), squash_id(F.col("key")), squash_id(F.col("key")), "at")
    born = orphans.parents(lives, squash_id(F.col("key")), "created", "deleted")
    got = rows(orphans.orphan_references(made, born).select("record_id", "target_key", F.coalesce("month_key", F.lit("-")), "reason"))
    assert got == [("10", "zz", "-", "missing"), ("2", "a", "2025-01", "deleted"), ("4", "b", "2025-01", "late"), ("5", "zz", "2025-01", "missing"), ("9", "c", "2025-01", "deleted")]
    assert orphans.orphan_references(made.limit(0), born).count() == 0
    assert orphans.orphan_references(made, born.limit(0)).where("reason <> 'missing'").count() == 0


def test_orphans_hot_key(spark, monkeypatch):
    monkeypatch.setattr(orphans, "SLICE_ROWS", 50)
    monkeypatch.setattr(orphans, "RANGE_ROWS", 20)
    refs = spark.range(3000).select(F.lit("t").alias("ref_table"), F.col("id").cast("string").alias("record_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 200).cast("string"))).alias("target_key"), F.lit(10).cast("long").alias("at_us"))
    refs = refs.select("*", F.xxhash64("target_key").alias("k1"), F.xxhash64(F.lit(7), "target_key").alias("k2"))
    lives = spark.range(100).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k")).select(F.xxhash64("k").alias("k1"), F.xxhash64(F.lit(7), "k").alias("k2"), F.lit(0).cast("long").alias("born"), F.lit(100).cast("long").alias("died"))
    got = orphans.orphan_references(refs, lives)
    assert got.count() == sum(1 for i in range(3000) if i % 3 == 0 or i % 200 >= 100)


def brute_hierarchy(parent):
    out = {}
    for n in parent:
        path, seen, x = [n], {n}, n
        while parent.get(x) is not None and parent[x] in parent:
            x = parent[x]
            if x in seen:
                path = None
                break
            seen.add(x)
            path.append(x)
        if path is not None:
            out[n] = (path[-1], len(path) - 1, path[::-1], "ok")
        else:
            y, steps = parent[n], 0
            while y != n and steps <= len(parent):
                y, steps = parent[y], steps + 1
            out[n] = (None, None, [], "cycle" if y == n else "below_cycle")
    return out


@pytest.mark.parametrize("bits", [hierarchy.BLOCK_BITS, 4, 1])
def test_hierarchies_against_brute_force(spark, monkeypatch, bits):
    # Small blocks leave most parents in other blocks.
    monkeypatch.setattr(hierarchy, "BLOCK_BITS", bits)
    monkeypatch.setattr(hierarchy, "TOGETHER", 40)
    monkeypatch.setattr(hierarchy, "HELD_IDS", 300)
    rng = random.Random(5)
    trees = {}
    for t in range(12):
        n = rng.choice([1, 5, 40, 120])
        parent = {i: (None if rng.random() < 0.1 else rng.randrange(-2, n)) for i in range(n)}
        trees[f"t{t}"] = parent
    trees["chain"] = {i: i - 1 if i else None for i in range(300)}
    trees["ring"] = {i: (i + 1) % 60 for i in range(60)} | {100 + i: i for i in range(60)} | {200: 100}
    trees["self"] = {1: 1, 2: 1}
    data = [(t, n, p, "x") for t, ps in trees.items() for n, p in ps.items()] + [(None, 1, None, "x"), ("t0", None, 1, "x")]
    df = spark.createDataFrame(data, "tree string, node long, parent long, id string")
    solved = hierarchy.with_descendant_counts(hierarchy.solve_hierarchy(df, ["tree"], "node", "parent"), ["tree"], "node")
    got = {(r.tree, r.node): (r.root, r.depth, list(r.path), r.status, r.n_descendants) for r in solved.collect()}
    own = {(r.tree, r.node): r.n_descendants for r in hierarchy._solved(df, ["tree"], "node", "parent").collect()}
    assert own == {k: v[4] for k, v in got.items()}
    want = {}
    for t, ps in trees.items():
        solved_t = brute_hierarchy(ps)
        for n, (root, depth, path, status) in solved_t.items():
            below = sum(1 for p in solved_t.values() if n in p[2][:-1])
            want[t, n] = (root, depth, path, status, below if status == "ok" else None)
    assert got == want
    assert hierarchy.solve_hierarchy(df.limit(0), ["tree"], "node", "parent").count() == 0


@pytest.mark.parametrize("bits", [hierarchy.BLOCK_BITS, 2])
def test_hierarchy_wide_parent(spark, monkeypatch, bits):
    monkeypatch.setattr(hierarchy, "BLOCK_BITS", bits)
    monkeypatch.setattr(hierarchy, "WIDE", 10)
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    data = [("t", 0, None), *[("t", i, 0) for i in range(1, 400)], *[("t", 1000 + i, 7) for i in range(300)]]
    got = hierarchy.solve_hierarchy(spark.createDataFrame(data, "tree string, node long, parent long"), ["tree"], "node", "parent")
    assert got.groupBy("depth").count().orderBy("depth").collect() == [(0, 1), (1, 399), (2, 300)]


def test_scopes_take_the_latest_row(spark):
    data = [("r", "f", 1, None, T0), ("r", "f", 2, 1, T0), ("r", "f", 2, 9, T0 + timedelta(1)), ("r", "f", 3, 2, T0), ("r", "f", 3, 2, T0)]
    got = rows(hierarchy.scope_hierarchy(spark.createDataFrame(data, "repository_id string, relative_path string, scope_id long, parent_scope_id long, ingested_at timestamp")))
    assert got == [("r", "f", 1, 1, 0, "1", 0, "ok"), ("r", "f", 2, 2, 0, "2", 1, "ok"), ("r", "f", 3, 2, 1, "2/3", 0, "ok")]


def test_nested_records(spark):
    body = {"files": [{"file": {"relative_path": "a.py"}, "declarations": {"declaration_id": "7", "name": "f", "test_evidence": [{"kind": "x"}, {}]}, "imports": [{"import_id": 0, "module": None, "items": {"target": "t\n\"q"}}], "calls": None}]}
    wrapped = {"envelope": {"body": {"files": {"file": {"relative_path": "b.py"}, "facts": {"calls": [{"call_id": 1, "callee": {"written": "g"}, "type_arguments": [{"written": "T"}]}]}}}}}
    data = [(1, json.dumps(body)), (1, json.dumps(body)), (2, json.dumps(json.dumps(wrapped))), (3, json.dumps(body)[:-20]), (4, None), (5, ""), (6, "[]"), (7, '{"files":[[{"file":{"relative_path":"c"},"calls":[]}]]}'), (8, '{"a":1} x'), (9, '{"files":{"declarations":{"declaration_id":"x7","name":"n"}}}')]
    facts = nested.analysis_facts(spark.createDataFrame(data, "record_id long, payload string")).fillna({"relative_path": "?", "fact_id": -7})
    got = rows(facts.select("record_id", "relative_path", "fact_kind", "fact_id", "item_index", F.coalesce("fact_name", F.lit("?"))))
    assert got == [
        (1, "a.py", "declaration", 7, -1, "f"),
        (1, "a.py", "import", 0, -1, ""),
        (1, "a.py", "import_item", 0, 0, 't\n"q'),
        (1, "a.py", "test_evidence", 7, 0, "x"),
        (1, "a.py", "test_evidence", 7, 1, "?"),
        (2, "b.py", "call", 1, -1, "g"),
        (2, "b.py", "type_argument", 1, 0, "T"),
        (9, "?", "declaration", -7, -1, "n"),
    ]


TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')


def json_triples(text: str) -> Iterator[tuple]:
    """(path, ordinals, value) of each scalar and, with a null value, of each object of a JSON text.

    `path` holds the keys from the top, `ordinals` one number per key: the
    position among the values of that key, 0 unless it holds an array (arrays in
    arrays count on). Null scalars give no triple; numbers and booleans come as
    written. A text that is itself a JSON string holding JSON is read through.
    Raises nested.Damaged, after what it gave before, where the text is not complete.
    """
    text = text.strip(" \t\r\n\ufeff")
    path: list[str] = []
    ordinals: list[int] = []  # one per key of `path`
    stack: list[str] = []  # "{" or "["
    expect, pos, end, token = "value", 0, len(text), TOKEN.match
    while pos < end:
        m = token(text, pos)
        if m is None:
            raise nested.Damaged(f"at {pos}")
        pos, kind, word = m.end(), m.lastindex, m.group(m.lastindex)
        if kind == 2 and expect in ("key", "key or }"):
            path.append(word[1:-1] if "\\" not in word else json.loads(word))
            ordinals.append(0)
            expect = ":"
            continue
        if kind == 1:
            if word == ":" and expect == ":":
                expect = "value"
                continue
            if word == "," and expect == ", or end" and stack:
                if stack[-1] == "{":
                    path.pop()
                    ordinals.pop()
                    expect = "key"
                else:
                    expect = "value"
                continue
            if word == "{" and expect in ("value", "value or ]"):
                yield tuple(path), tuple(ordinals), None
                stack.append("{")
                expect = "key or }"
                continue
            if word == "[" and expect in ("value", "value or ]"):
                stack.append("[")
                expect = "value or ]"
                continue
            if word == "}" and stack and stack[-1] == "{" and expect in ("key or }", ", or end"):
                if expect == ", or end":
                    path.pop()
                    ordinals.pop()
            elif not (word == "]" and stack and stack[-1] == "[" and expect in ("value or ]", ", or end")):
                raise nested.Damaged(f"at {pos}")
            stack.pop()
            closed_object = word == "}"
        elif expect in ("value", "value or ]"):
            if kind == 2:
                plain = word[1:-1] if "\\" not in word else json.loads(word)
                if not stack:
                    if text[pos:].strip():
                        raise nested.Damaged(f"at {pos}")
                    yield from json_triples(plain)
                    return
                yield tuple(path), tuple(ordinals), plain
            elif word != "null":
                yield tuple(path), tuple(ordinals), word
            closed_object = True
        else:
            raise nested.Damaged(f"at {pos}")
        # A value ended; an element of an array moves the ordinal on.
        expect = ", or end"
        if closed_object and stack and stack[-1] == "[" and ordinals:
            ordinals[-1] += 1
    if stack or expect != ", or end":
        raise nested.Damaged("cut off")


def grouped(text, tree):
    """Triples by repeated ancestor: ((name, ordinal), ...) -> {path below it: value}."""
    rows = {}
    for path, ordinals, value in json_triples(text):
        at, chain, leaf = tree, (), []
        for name, ordinal in zip(path, ordinals):
            if name in at:
                at, chain, leaf = at[name], (*chain, (name, ordinal)), []
            else:
                leaf.append(name)
        if chain and (value is not None or not leaf):
            here = rows.setdefault(chain, {})
            if value is not None:
                here[".".join(leaf)] = value
    return rows


def test_records_are_grouped_as_their_triples_are():
    rng = random.Random(8)
    tree = {"a": {"b": {}, "c": {"a": {}}}}
    tables = ["a", "a.b", "a.c", "a.c.a"]
    leaves = ["", "x", "w", "w.x", "x.w", "w.w", "x.x"]
    slots = {t: {f: i for i, f in enumerate(leaves)} for t in tables}

    def value(d):
        r = rng.random()
        if d > 6 or r < 0.25:
            return rng.choice([1, -2.5, True, None, "é\n\"\\", ""])
        if r < 0.75:
            return {rng.choice("abcxw"): value(d + 1) for _ in range(rng.randrange(4))}
        return [value(d + 1) for _ in range(rng.randrange(4))]

    for _ in range(1500):
        text = json.dumps(value(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if rng.random() < 0.3:
            k = rng.randrange(len(text))
            text = rng.choice([text[:k], text[:k] + rng.choice('{}[],:"x1- \\') + text[k:], text[:k] + text[k + 1 :], json.dumps(text)])
        try:
            want = {c: {f: v for f, v in vs.items() if f in leaves} for c, vs in grouped(text, tree).items()}
        except ValueError:
            want = None
        try:
            found = nested.record_rows(text, nested.Place(tree, "", (), False, slots), slots)
            got = {tuple(zip(r.table.split("."), r.ordinals)): {leaves[k]: v for k, v in r.values.items()} for r in found}
        except ValueError:
            got = None
        assert got == want, text


def test_json_triples_read_what_json_reads():
    def flat(v, path=(), ords=()):
        if isinstance(v, dict):
            yield path, ords, None
            for k, x in v.items():
                if isinstance(x, list):
                    n = 0
                    for y in x:
                        yield from flat(y, (*path, k), (*ords, n))
                        n += 1
                else:
                    yield from flat(x, (*path, k), (*ords, 0))
        elif v is not None:
            yield path, ords, v if isinstance(v, str) else json.dumps(v)

    rng = random.Random(2)

    def value(d):
        r = rng.random()
        if d > 3 or r < 0.4:
            return rng.choice([1, -2.5, True, None, "é\n\"\\", "", 1e30])
        if r < 0.8:
            return {rng.choice("abcd") + str(i): value(d + 1) for i in range(rng.randrange(4))}
        return {"l": [{"z": value(d + 2)} for _ in range(3)]}

    for _ in range(200):
        v = {"top": value(0)}
        text = json.dumps(v)
        assert list(json_triples(text)) == list(flat(v))
        for cut in (1, len(text) // 2, len(text) - 1):
            try:
                list(json_triples(text[:cut]))
                raise AssertionError(text[:cut])
            except nested.Damaged:
                pass


EVENTS = "delivery_id long, batch_id string, received_at timestamp, event_id string, session_id string, sequence long, _id string, n long"


def test_dedup(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    data = [
        (1, "b", at(5), "s:1", "s", 1, "clash", 1),
        (2, "b", at(5), "S:0001 ", None, None, "clash", 1),
        (3, "b", at(4), None, " s", 1, None, None),
        (4, "b", at(1), "s:2", None, None, None, None),
        (5, "b", None, None, "s", 2, None, None),
        (6, "b", at(1), "acp:run:7:3", None, 3, None, None),
        (7, "b", at(1), "acp:run:7:3", "acp:run:7", None, None, None),
        (8, "b", at(1), None, None, None, None, None),
        (9, "b", at(1), None, None, None, None, None),
        (10, "b", at(1), "s:99999999999999999999999", None, None, None, None),
        (11, "b", at(1), "no number", None, None, None, None),
    ]
    df = spark.createDataFrame(data, EVENTS)
    assert rows(dedup.duplicate_events(df)) == [(1, "s:1"), (2, "s:1"), (5, "s:2"), (7, "acp:run:7:3")]
    assert dedup.duplicate_events(df.limit(0)).count() == 0
    kept = dedup.dedup_messages(df.where("delivery_id < 4"), df.where("delivery_id >= 4"), ["session_id", "sequence"], "received_at", "delivery_id")
    assert {r.delivery_id for r in kept.collect()} == set(range(1, 12))


def test_dedup_hot_identifier(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    df = spark.range(3000).select(F.col("id").alias("delivery_id"), F.lit("b").alias("batch_id"), F.lit(T0).alias("received_at"), F.when(F.col("id") % 3 == 0, "hot:1").otherwise(F.concat(F.lit("s:"), F.col("id").cast("string"))).alias("event_id"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("long").alias("sequence"))
    got = dedup.duplicate_events(df)
    assert got.count() == 999 and got.where("delivery_id = 0").count() == 0


def test_skew_join_matches_plain_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    left = spark.range(1000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 37).alias("k"), "id")
    right = spark.range(0, 20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew.skew_join(left, right, ["k"], F.col("id"), how).select("k", "id")) == rows(left.join(right, ["k"], how).select("k", "id"))


def test_hot_key_is_spread_by_its_size(spark, monkeypatch):
    """Half of all rows have one key: no task of the join gets more than about its share."""
    monkeypatch.setattr(skew, "HOT_ROWS", 500)
    left = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 997).alias("k"), "id")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert skew.hot_keys(counts, ["k"]).collect() == [(0, 21)]
    right = spark.range(0, 997).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.skew_join(left, right, ["k"], F.col("id"))
        most = joined.groupBy(F.spark_partition_id().alias("p"), (F.col("k") == 0).alias("hot")).count().where("hot")
        per = [r["count"] for r in most.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(per) == sum(1 for i in range(20_000) if i % 2 == 0 or i % 997 == 0)
    assert len(per) > 1 and max(per) < sum(per)


def test_nested_records_of_nothing(spark):
    """Empty tables, and tables whose payloads are all null or damaged, give empty tables; further columns are ignored."""
    kind = "record_id long, payload string, _payload string, fact_id long"
    for data in ([], [(1, None, "x", 1), (2, "{", "x", 1), (3, "", None, None)]):
        df = spark.createDataFrame(data, kind)
        assert nested.analysis_facts(df).count() == 0
        assert all(t.count() == 0 for t in nested.analysis_tables(df).values())


def test_scopes_of_nothing(spark):
    kind = "repository_id string, relative_path string, scope_id long, parent_scope_id long, ingested_at timestamp, path string, status string"
    assert hierarchy.scope_hierarchy(spark.createDataFrame([], kind)).count() == 0
    odd = [(None, "f", 1, None, T0, "x", "y"), ("r", None, 1, None, T0, "x", "y"), ("r", "f", None, 1, T0, "x", "y"), ("r", "f", -5, None, None, None, None), ("r", "f", 2**62, -5, None, None, None)]
    got = rows(hierarchy.scope_hierarchy(spark.createDataFrame(odd, kind)))
    assert got == [("r", "f", -5, -5, 0, "-5", 1, "ok"), ("r", "f", 2**62, -5, 1, f"-5/{2**62}", 0, "ok")]
    assert rows(hierarchy.scope_descendants(spark.createDataFrame(odd, kind))) == [("r", "f", -5, 2**62)]

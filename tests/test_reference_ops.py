"""Joins, graph, folds, rules and sources on small inputs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewell.operators import candidates, extract, graph, joins, links, lookups, memory, packet, sessions
from tracewell.sources import jsonl, repository


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_outcomes_never_collapse(spark):
    df = spark.createDataFrame([(None, False), ([], False), (["a"], False), (["a", "b"], False), (["a"], True)], "c array<string>, o boolean")
    assert [r[0] for r in df.select(lookups.cardinality_outcome(F.col("c"), F.col("o"))).collect()] == ["no_candidate", "no_candidate", "single_candidate", "multiple_candidates", "out_of_scope"]
    assert [r[0] for r in df.select(lookups.link_outcome(F.col("c"), F.col("o"))).collect()] == ["unresolved", "unresolved", "exact", "ambiguous", "out_of_scope"]


def test_innermost_owner(spark):
    s = lambda a, b: Row(byte_start=a, byte_end=b)
    inner = spark.createDataFrame([("f", 1, s(5, 6)), ("f", 2, s(50, 60)), ("g", 3, s(5, 6))], "p string, call long, span struct<byte_start: long, byte_end: long>")
    own = spark.createDataFrame([("f", 10, s(0, 30)), ("f", 11, s(4, 8)), ("f", 12, s(4, 8))], "p string, fn long, span struct<byte_start: long, byte_end: long>")
    assert rows(joins.innermost_owner(inner, own, ["p"], "call", "fn")) == [("f", 1, 11)]


def test_held_pairs_against_brute_force(spark):
    rng = random.Random(8)
    spans = [(rng.choice("fg"), i, (a, a + rng.choice([0, 1, 7, 40, 300]))) for i, a in enumerate(rng.randrange(500) for _ in range(250))]
    df = spark.createDataFrame([(p, i, Row(byte_start=s, byte_end=e)) for p, i, (s, e) in spans] + [("f", -1, None)], "p string, i long, span struct<byte_start: long, byte_end: long>")
    got = rows(joins.nesting_depth(df.where("i >= 0"), ["p"], "i"))
    want = sorted((p, i, sum(1 for q, j, (c, d) in spans if q == p and j != i and c <= a and b <= d)) for p, i, (a, b) in spans)
    assert got == want
    assert joins.held_pairs(df.select("p", "i", "span"), df.select("p", F.col("i").alias("j"), F.col("span").alias("_s")).limit(0), ["p"], "span", "_s").count() == 0


def test_nearest_ancestor(spark):
    p = spark.createDataFrame([("r", "a/b/c.go"), ("r", "x.go"), ("s", "a/b/c.go")], "repo string, path string")
    m = spark.createDataFrame([("r", "a"), ("r", "a/b"), ("r", "ab"), ("r", "")], "repo string, root string")
    assert rows(joins.nearest_ancestor(p, m, ["repo"], "path", "root")) == [("r", "a/b/c.go", "a/b"), ("r", "x.go", "")]


def test_covering_binding_takes_the_latest(spark):
    u = spark.createDataFrame([(1, "f", "x", 15), (2, "f", "x", 35), (3, "f", "y", 15)], "use_id long, path string, name string, pos long")
    b = spark.createDataFrame([("f", "x", 1, 0, 40), ("f", "x", 2, 10, 20), ("f", "x", 3, 10, 20)], "path string, name string, binding_id long, byte_start long, byte_end long")
    assert rows(joins.covering_binding(u, b, ["path", "name"], "pos").select("use_id", F.coalesce("binding_id", F.lit(-1)))) == [(1, 3), (2, 1), (3, -1)]


def test_range_union_against_brute_force(spark):
    rng = random.Random(3)
    data = [("k%d" % rng.randrange(3), a, a + rng.randrange(6)) for a in (rng.randrange(80) for _ in range(90))]
    got = rows(joins.range_union(spark.createDataFrame(data, "k string, a long, b long"), ["k"], "a", "b"))
    want = []
    for k in sorted({d[0] for d in data}):
        held = sorted({x for d in data if d[0] == k for x in range(d[1], d[2] + 1)})
        start = prev = held[0]
        for x in [*held[1:], 10**9]:
            if x != prev + 1:
                want.append((k, start, prev))
                start = x
            prev = x
    assert got == sorted(want)


def test_subset_match(spark):
    r = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), ("c", ["x", "x"])], "recipe_id string, terms array<string>")
    q = spark.createDataFrame([(1, ["x", "y", "q"]), (2, ["x"]), (3, [])], "query_id long, terms array<string>")
    assert rows(joins.subset_match(r, q)) == [(1, "a"), (1, "c"), (2, "c")]


EDGES = "edge_id string, source string, target string, edge_kind string, evidence_class string, candidate_set_id string"


def test_trails_and_search(spark):
    e = spark.createDataFrame([("1", "a", "b", "k", "fact", None), ("2", "b", "a", "k", "candidate", "s"), ("3", "b", "c", "k", "fact", None), ("4", "a", "b", "k", "fact", None)], EDGES)
    s = spark.createDataFrame([("a",)], "node_id string")

    def walk(node, trail, depth):
        if trail:
            yield ("a", node, len(trail), ">".join(trail))
        if depth:
            for r in e_rows:
                if r.source == node and r.edge_id not in trail:
                    yield from walk(r.target, [*trail, r.edge_id], depth - 1)

    e_rows = e.collect()
    got = graph.bounded_trails(e, s, 4).select("seed", "node_id", "depth", F.array_join("trail", ">").alias("t"))
    assert rows(got) == sorted(walk("a", [], 4))
    assert rows(graph.bounded_search(e, s)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    ev = {r.trail_id: (r.fact_only, r.has_candidate, r.n_candidate_sets) for r in graph.trail_evidence(graph.bounded_trails(e, s, 2), e).collect()}
    assert ev["1>3"] == (1, 0, 0) and ev["1>2"] == (0, 1, 1)


def test_relation_dedup_is_adjacent_only(spark):
    df = spark.createDataFrame([("s", "outgoing", "k", "1", "n", "n"), ("s", "outgoing", "k", "2", "n", "n"), ("s", "incoming", "k", "3", "n", "n"), ("s", "outgoing", "a", "4", "n", "n")], "seed string, direction string, edge_kind string, edge_id string, node_id string, node_key string")
    assert sorted(r.edge_id for r in graph.relation_dedup(df).collect()) == ["1", "3", "4"]


def test_ranked_seeds(spark):
    from tracewell.functions.identifiers import identifier_terms

    n = spark.createDataFrame([("1", "decl:1", "declaration", "x/apply.py", "applyBatch"), ("2", "decl:2", "declaration", "y.py", "apply"), ("3", "imp:1", "import", "y.py", "apply_batch"), ("4", "file:1", "file", "apply/z.py", "z")], "node_id string, node_key string, node_kind string, relative_path string, label string")
    got = graph.ranked_seeds(n, "apply batch", ["apply", "batch"], identifier_terms, 2).orderBy("rank").collect()
    assert [(r.node_id, r.score, r.rank, r.total) for r in got] == [("1", 650, 1, 3), ("2", 120, 2, 3)]


def test_inheritance(spark):
    p = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x")], "class string, parent string")
    levels = links.inheritance_levels(p)
    assert rows(levels) == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1), ("x", "y", 1), ("y", "x", 1)]
    m = spark.createDataFrame([("a", "f", False), ("b", "f", True), ("a", "g", False), ("c", "h", True)], "owner string, method string, is_private boolean")
    got = rows(links.nearest_methods(levels, m).where("class = 'c'").select("method", "owner", "level"))
    assert got == [("f", "a", 2), ("g", "a", 2), ("h", "c", 0)]


SOURCES = {
    "a/__init__.py": "from . import m\nfrom .m import f as g\nfrom ..x import y\nimport a.m\nimport os\n\nclass K(Base):\n    z = 1\n    def go(self):\n        return f(g.h(1))\n\nX = 2\n",
    "a/m.py": "def f(): pass\n",
    "src/lib.rs": "mod one;\nmod two { }\nuse crate::one::{Thing, sub as s};\nuse std::fmt;\nfn main() { helper(); helper(); let _ = \"fn no()\"; }\nfn helper() {}\n",
    "src/one.rs": "pub struct Thing;\n// fn hidden()\n",
    "p/a.go": 'package p\n\nimport (\n\t"fmt"\n\tq "example.com/r/q"\n)\n\nfunc run() { fmt.Println(help()) }\n',
    "p/b.go": "package p\n\nfunc help() int { return 1 }\n",
    "q/c.go": "package q\n",
    "u.php": "<?php\nnamespace App\\U;\nuse App\\V\\{Foo, Gone as G};\nuse Ext\\Lib;\nuse function App\\V\\f;\nclass U extends Foo { function go() { return f(); } }\n",
    "v.php": "<?php\nnamespace App\\V;\nclass Foo {}\nfunction f() { return 1; }\n",
    "broken.py": "def f(:\n",
    "none.py": None,
}


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("r", p, t) for p, t in SOURCES.items()], "repository_id string, relative_path string, source_text string")
    files = files.withColumn("lang", repository.language_by_path(F.col("relative_path")))
    return extract.source_facts(files, ["repository_id", "relative_path"], "lang", "source_text").cache(), files


def test_fact_extraction(facts):
    f = facts[0]
    got = {(r.relative_path, r.kind, r.name) for r in f.where("fact_kind = 'declaration'").collect()}
    assert {("a/__init__.py", "class", "K"), ("a/__init__.py", "field", "z"), ("a/__init__.py", "method", "go"), ("a/__init__.py", "constant", "X"), ("src/lib.rs", "module", "one"), ("src/one.rs", "struct", "Thing"), ("p/a.go", "package", "p"), ("p/b.go", "function", "help"), ("v.php", "class", "Foo"), ("v.php", "namespace", "App\\V")} <= got
    assert not any(n in ("no", "hidden") for _, _, n in got)
    calls = {(r.relative_path, r.kind, r.name) for r in f.where("fact_kind = 'call'").collect()}
    assert {("a/__init__.py", "plain", "f"), ("a/__init__.py", "member", "g.h"), ("src/lib.rs", "plain", "helper"), ("p/a.go", "plain", "help"), ("p/a.go", "member", "fmt.Println")} <= calls
    assert f.where("relative_path in ('broken.py', 'none.py')").count() == 0


def test_link_rules(spark, facts):
    f, files = facts
    names = {(r.relative_path, r.fact_id): (r.name, r.target) for r in f.where("fact_kind = 'import'").collect()}
    show = lambda df: {names[r.relative_path, r.fact_id]: (r.rule_id.split(".")[-1], r.outcome, list(r.targets)) for r in df.collect()}
    assert show(links.python_relative_imports(f, files)) == {("", "m"): ("package_path", "exact", ["a/m.py"]), ("m", "f"): ("package_path", "exact", ["a/m.py"]), ("x", "y"): ("package_path", "unresolved", [])}
    assert show(links.python_absolute_imports(f, files)) == {("a.m", ""): ("local_candidate", "ambiguous", ["a/m.py"]), ("os", ""): ("external", "out_of_scope", [])}
    uses = show(links.rust_use_paths(f, files))
    assert uses["crate::one::Thing", "Thing"][1] == "exact" and uses["crate::one::sub", "s"][1] == "unresolved" and uses["std::fmt", "fmt"][1] == "out_of_scope"
    mods = {r.outcome for r in links.rust_module_files(f, files).where("fact_id >= 0").collect()}
    assert mods == {"exact", "unresolved"}
    go = show(links.go_imports(f, spark.createDataFrame([("r", "example.com/r", "")], "repository_id string, module string, root string")))
    assert go == {("fmt", ""): ("external", "out_of_scope", []), ("example.com/r/q", "q"): ("local_module", "exact", ["q:q"])}
    php = show(links.php_uses(f))
    assert php["App\\V\\Foo", "Foo"][:2] == ("qualified_name", "exact") and php["App\\V\\Gone", "G"][:2] == ("qualified_name", "unresolved")
    assert php["Ext\\Lib", "Lib"][:2] == ("external", "out_of_scope") and php["App\\V\\f", "f"][:2] == ("non_class_import", "out_of_scope")
    cand = {(r.relative_path, r.name): (r.outcome, len(r.candidates)) for r in candidates.all_candidates(f, files, spark.createDataFrame([("r", "example.com/r", "")], "repository_id string, module string, root string")).collect()}
    assert cand["p/a.go", "help"] == ("single_candidate", 1) and cand["src/lib.rs", "helper"] == ("single_candidate", 1) and ("a/__init__.py", "f") not in cand


def test_scan_tree(spark, tmp_path):
    for name, body in {"a.py": b"x = 1\n", "target/b.rs": b"", "sub/c.go": b"\xff\xfe", "sub/skip.log": b"1", "keep/d.php": b"<?php " * 10, "go.mod": b"module m\n"}.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    got = {r.relative_path: (r.language, r.status) for r in repository.scan_tree(spark, str(tmp_path / "tree"), max_bytes=20, ignore="*.log\n# c\n!keep.log\n").collect()}
    assert got == {"a.py": ("python", "clean"), "sub/c.go": ("go", "invalid_utf8"), "keep/d.php": ("php", "truncated"), "go.mod": ("manifest", "clean")}


def test_manifests_and_history(spark):
    f = spark.createDataFrame([("go.mod", 'module ex.com/m // c\n\ngo 1.22\nrequire (\n\ta/b v1.0.0\n\tc v2 // indirect\n)\nreplace x => y v3\n'), ("c/Cargo.toml", '[package]\nname = "k"\nversion = "1"\n[dependencies]\na = "1"\nb = {version = "2"}\n[[bin]]\nname = "z"\n'), ("d/Cargo.toml", "[package\n")], "relative_path string, source_text string")
    assert rows(repository.go_mod_facts(f).select("fact", "name", "version")) == [("go", "1.22", ""), ("module", "ex.com/m", ""), ("replace", "x", "y v3"), ("require", "a/b", "v1.0.0"), ("require", "c", "v2")]
    assert rows(repository.cargo_facts(f).select("fact", "name", "value")) == [("damaged", "", ""), ("dependencies", "a", "1"), ("dependencies", "b", "2"), ("package", "k", "1"), ("target:bin", "z", "")]
    log = "commit c3 300\n\nM\ta\nR100\tb\tc\ncommit c2 900\n\nA\tb\ncommit c1 100\n\nA\ta\n"
    t = repository.file_temporal(repository.history_changes(spark.createDataFrame([("r", log)], "repository_id string, log string")))
    got = {r.path: (r.first_commit, r.last_commit, r.n_changes, list(r.tail)) for r in t.collect()}
    assert got == {"a": ("c1", "c3", 2, [100, 300]), "b": ("c2", "c3", 2, [300, 900]), "c": ("c3", "c3", 1, [300])}
    m = repository.change_measures(t, F.lit(300 + 86400), [1, 30]).where("path = 'a'").first()
    assert (m.changes_1d, m.changes_30d, m.mean_interval) == (1, 2, 200)


def test_publish_and_verify(spark, tmp_path):
    df = spark.range(5)
    where = str(tmp_path / "t")
    jsonl.publish(df, where)
    jsonl.publish(df.limit(3), where)
    assert spark.read.parquet(where).count() == 3 and len(list(tmp_path.iterdir())) == 1
    known = jsonl.manifest({"a": df, "b": df})
    assert jsonl.verify({"a": df, "b": df}, known).count() == 0
    assert rows(jsonl.verify({"a": df.limit(2), "b": df.withColumn("id", F.col("id") + 1)}, known)) == [("a", "rows"), ("b", "digest")]
    (tmp_path / "bad.jsonl").write_text('{"edge_id": "e1"}\n{"edge_id": \n')
    with pytest.raises(Exception):
        jsonl.read_table(spark, str(tmp_path / "bad.jsonl"), "edges").collect()


def test_packets_round_trip(spark):
    f = spark.createDataFrame([("q", "n1", "file", "file:a", 'la"b\nel'), ("q", "n2", "call", "call:b", None), ("q", "n1", "file", "file:a", 'la"b\nel')], "query string, node_id string, node_kind string, node_key string, label string")
    r = spark.createDataFrame([("q", "calls", "n1", "n2", "candidate", "s1"), ("q", "calls", "n1", "gone", "fact", None), ("q", "has", "n2", "n1", "fact", None)], "query string, edge_kind string, source string, target string, evidence_class string, candidate_set_id string")
    doc = packet.parse_packet(packet.render_packets(f, r).first().packet)
    assert doc.query == "q" and doc.facts == [(1, "call", "call:b", ""), (2, "file", "file:a", 'la"b\nel')]
    assert sorted(doc.relations) == [("calls", 2, 1, "c", "s1"), ("has", 1, 2, "f", None)] and doc.summary == {"facts": "2", "relations": "2"}
    with pytest.raises(ValueError):
        packet.parse_packet("nonsense")


def test_memory(spark):
    p = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("c", "3")], "entry string, path string")
    assert rows(memory.similar_entries(p, p.select("entry").distinct())) == [("a", "b", 1, 0.5), ("b", "a", 1, 0.5)]
    d = memory.digests(p)
    assert rows(memory.changed_entries(d, d.where("entry <> 'b'")).select("entry")) == [("b",)]


def test_fold_of_parts_equals_whole(spark, small):
    e = sessions.clean_events(spark.read.parquet(f"{small}/agent_events.parquet"))
    whole = sessions.session_fold(e)
    parts = [sessions.session_fold(e.where(F.col("number") % 3 == k)) for k in range(3)]
    assert rows(sessions.merge_parts(parts[0].unionByName(parts[1]).unionByName(parts[2]))) == rows(whole)


def test_late_buckets_fall_out(spark):
    us = lambda d: int((datetime(2025, 1, 1) + timedelta(days=d)).timestamp()) * 1_000_000
    s = spark.createDataFrame([("r", "p", us(0), "x", "i", "s"), ("r", "p", us(401), "x", "i", "s"), ("r", "p", us(402), "x", "i", "s"), ("r", "p", None, "x", "i", "s")], "repository string, path string, at_us long, kind string, investigation string, session string")
    assert sessions.daily_buckets(s).count() == 2 and sessions.path_activity(s).first().n == 4


def test_hierarchy_and_import_candidates(spark, facts):
    f, files = facts
    assert [(r.rule_id, r.outcome, list(r.targets)) for r in links.php_hierarchy(f).collect()] == [("php.class.extends", "exact", ["v.php#1"])]
    tree = links.rust_crate_tree(f, files)
    assert rows(tree.select("root", "relative_path", "depth")) == [("src/lib.rs", "src/lib.rs", 0), ("src/lib.rs", "src/one.rs", 1)]
    go = candidates.go_imported_calls(f, spark.createDataFrame([("r", "example.com/r", "")], "repository_id string, module string, root string"))
    assert [(r.name, r.outcome) for r in go.collect()] == [("fmt.Println", "out_of_scope")]


def _facts(spark, lang, texts):
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repository_id string, relative_path string, source_text string").withColumn("lang", F.lit(lang))
    return extract.source_facts(files, ["repository_id", "relative_path"], "lang", "source_text").cache(), files


def _shown(records, keep=lambda r: True):
    return {(r.relative_path, r.name): (r.rule_id.split(".")[-1].removesuffix("_candidate"), r.outcome.split("_")[0], r.reason) for r in records.collect() if keep(r)}


def test_python_relative_imports_take_the_package_that_declares_a_name(spark):
    f, files = _facts(spark, "python", {"p/__init__.py": "X = 1\ndef go(): pass\n", "p/go.py": "", "p/q/__init__.py": "from .. import X, go, gone, q\nfrom ... import y\nfrom ..go import z\n", "top.py": "from . import p\n"})
    names = {(r.relative_path, r.fact_id): r.target for r in f.where("fact_kind = 'import'").collect()}
    got = {names[r.relative_path, r.fact_id]: (r.outcome, list(r.targets)) for r in links.python_relative_imports(f, files).collect()}
    assert got == {"X": ("exact", ["p/__init__.py"]), "go": ("ambiguous", ["p/__init__.py", "p/go.py"]), "gone": ("unresolved", []), "q": ("exact", ["p/q/__init__.py"]), "y": ("unresolved", []), "z": ("exact", ["p/go.py"]), "p": ("unresolved", [])}


RUST = {
    "a/src/lib.rs": "mod m;\nmod inl { pub fn deep() {} pub fn up() { super::top(); self::deep(); deep(); top() } }\npub fn top() {}\npub fn run() { top(); m::go(); crate::m::go(); inl::deep(); std::mem::swap(); let top = 1; top() }\n",
    "a/src/m.rs": "use crate::inl::deep as d;\nuse crate::inl::*;\nuse crate::m;\nuse crate::gone::x;\nuse crate::K;\npub fn go() { d(); x(); K(); nothing() }\nconst C: fn() = go;\npub fn c() { C(); fn inner() {} inner() }\n",
    "b/src/lib.rs": "mod m;\npub struct K;\n",
    "b/src/m.rs": "pub fn go() {}\nuse crate::K;\n",
    "loose.rs": "use crate::K;\n",
}


def test_rust_uses_and_calls(spark):
    f, files = _facts(spark, "rust", RUST)
    uses = links.rust_use_paths(f, files)
    names = {(r.relative_path, r.fact_id): r.name for r in f.where("fact_kind = 'import'").collect()}
    got = {(r.relative_path, names[r.relative_path, r.fact_id]): (r.outcome, len(r.targets)) for r in uses.collect()}
    # Two crates of one repository do not meet; a file that no root reaches resolves nothing; a glob means the module's file.
    assert got == {("a/src/m.rs", "crate::inl::deep"): ("exact", 1), ("a/src/m.rs", "crate::inl::*"): ("exact", 1), ("a/src/m.rs", "crate::m"): ("exact", 1), ("a/src/m.rs", "crate::gone::x"): ("unresolved", 0), ("a/src/m.rs", "crate::K"): ("unresolved", 0), ("b/src/m.rs", "crate::K"): ("exact", 1), ("loose.rs", "crate::K"): ("unresolved", 0)}
    local = [(r.relative_path, r.name, r.rule_id.split(".")[-1], r.outcome, r.reason) for r in candidates.rust_local_calls(f, uses).collect()]
    fn, imp = "local_function_candidate", "imported_function_candidate"
    assert sorted(local, key=str) == sorted([
        ("a/src/lib.rs", "deep", fn, "single_candidate", None), ("a/src/lib.rs", "top", fn, "no_candidate", "no_such_function"), ("a/src/lib.rs", "top", fn, "single_candidate", None), ("a/src/lib.rs", "top", fn, "no_candidate", "blocked_by_local_binding"),
        ("a/src/m.rs", "d", imp, "single_candidate", None), ("a/src/m.rs", "x", imp, "no_candidate", "import_leads_to_no_function"), ("a/src/m.rs", "K", imp, "no_candidate", "import_leads_to_no_function"), ("a/src/m.rs", "nothing", fn, "no_candidate", "no_such_function"),
        ("a/src/m.rs", "C", fn, "no_candidate", "blocked_by_local_constant"), ("a/src/m.rs", "inner", fn, "single_candidate", None),
    ], key=str)
    paths = {r.name: (r.outcome, r.reason) for r in candidates.rust_path_calls(f, files).collect()}
    assert paths == {"super::top": ("single_candidate", None), "self::deep": ("single_candidate", None), "m::go": ("single_candidate", None), "crate::m::go": ("single_candidate", None), "inl::deep": ("single_candidate", None), "std::mem::swap": ("out_of_scope", "root_is_not_proven")}


def test_go_package_blockers(spark):
    f, _ = _facts(spark, "go", {
        "p/a.go": 'package p\nimport fmt "x/y"\nfunc one(help int) { help(); two(); both(); fmt(); none() }\nfunc two() { help() }\nfunc both() {}\n',
        "p/b.go": "package p\nfunc help() { x := two; x(); if two := help(); two != nil { two() }; two() }\ntype both struct{}\nfunc fmt() {}\n",
        "p/c.go": 'package p\nimport . "dots"\nfunc three() { two() }\n',
    })
    got = sorted((r.relative_path, r.name, r.outcome.split("_")[0], r.reason or "") for r in candidates.go_package_calls(f).collect())
    assert got == sorted([
        ("p/a.go", "help", "no", "blocked_by_local_binding"), ("p/a.go", "two", "single", ""), ("p/a.go", "both", "no", "mixed_namespace"), ("p/a.go", "fmt", "no", "blocked_by_import_name"), ("p/a.go", "none", "no", "no_such_function"), ("p/a.go", "help", "single", ""),
        ("p/b.go", "x", "no", "blocked_by_local_binding"), ("p/b.go", "help", "single", ""), ("p/b.go", "two", "no", "blocked_by_local_binding"), ("p/b.go", "two", "single", ""), ("p/c.go", "two", "no", "blocked_by_dot_import"),
    ])


PHP = {
    "base.php": "<?php\nnamespace B;\nclass Base { private function own() {} public function far() { $this->own(); } public static function s() {} }\ntrait T { function t() {} }\nclass Other { function far() {} }\n",
    "use.php": "<?php\nnamespace U;\nuse B\\Base;\nuse B\\{Other as O, T};\nclass K extends Base { use T;\n function near() { $this->near(); $this->far(); $this->own(); $this->t(); self::s(); parent::far(); static::s(); new self(); new parent(); new O(); new \\Gone(); new $x(); Base::s(); O::s(); } }\nclass L { function near() { $this->far(); } }\nfunction f(K $k, ?O $o, int $n, $z) { $k->near(); $k->far(); $o->far(); $n->x(); $z->y(); $q = new K(); $q->near(); $q = g(); $q->near(); }\n",
}


def test_php_members(spark):
    f, _ = _facts(spark, "php", PHP)
    inherits = {r.name: list(r.targets) for r in f.where("fact_kind = 'reference'").withColumnRenamed("outcome", "_").join(links.php_hierarchy(f).select("relative_path", "fact_id", "targets", "rule_id"), ["relative_path", "fact_id"]).collect()}
    assert set(inherits) == {"Base", "T"} and all(len(t) == 1 for t in inherits.values())
    got = sorted((r.relative_path, r.name, r.rule_id.removeprefix("php.call.").removesuffix("_candidate"), r.outcome.split("_")[0]) for r in candidates.php_member_calls(f).collect())
    u = "use.php"
    assert got == sorted([
        ("base.php", "$this->own", "lexical_this_method", "single"),
        (u, "$this->near", "lexical_this_method", "single"), (u, "$this->far", "inherited_method", "single"), (u, "$this->own", "lexical_this_method", "no"), (u, "$this->t", "inherited_method", "single"), (u, "self::s", "inherited_method", "single"),
        (u, "parent::far", "parent_method", "single"), (u, "static::s", "static_method", "out"), (u, "new self", "construction_class", "single"), (u, "new parent", "parent_construction", "single"), (u, "new O", "construction_class", "single"), (u, "new K", "construction_class", "single"), (u, "new \\Gone", "construction_class", "no"),
        (u, "new $x", "construction_class", "out"), (u, "Base::s", "static_method", "single"), (u, "O::s", "static_method", "no"), (u, "$this->far", "lexical_this_method", "no"),
        (u, "$k->near", "typed_receiver_method", "single"), (u, "$k->far", "inherited_method", "single"), (u, "$o->far", "typed_receiver_method", "single"), (u, "$n->x", "typed_receiver_method", "out"), (u, "$z->y", "typed_receiver_method", "out"), (u, "$q->near", "typed_receiver_method", "single"), (u, "$q->near", "typed_receiver_method", "out"),
    ])


def test_go_package_calls(spark):
    texts = {"a/x.go": 'package a\nimport "m/b"\nfunc f() { b.Do(); b.hidden(); b.Mixed(); b.Gone(); c.Do() }\n', "b/y.go": "package b\nfunc Do() {}\nfunc hidden() {}\nfunc Mixed() {}\n", "b/z.go": "package b\nvar Mixed = 1\n"}
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repository_id string, relative_path string, source_text string").withColumn("lang", F.lit("go"))
    f = extract.source_facts(files, ["repository_id", "relative_path"], "lang", "source_text").cache()
    got = {r.name: (r.outcome, list(r.candidates)) for r in candidates.go_imported_calls(f, spark.createDataFrame([("r", "m", "")], "repository_id string, module string, root string")).collect()}
    assert got == {"b.Do": ("single_candidate", ["b/y.go#1"]), "b.hidden": ("no_candidate", []), "b.Mixed": ("no_candidate", []), "b.Gone": ("no_candidate", []), "c.Do": ("out_of_scope", [])}


def test_typed_receivers(spark):
    w = spark.createDataFrame([("r", "f", "$x", 1, "A"), ("r", "f", "$x", 5, None), ("r", "f", "$x", 7, "B"), ("r", "f", "$x", 8, "C"), ("r", "f", "$x", 20, None), ("r", "f", "$x", 99, "Z")], "repository_id string, relative_path string, receiver string, at long, class string")
    c = spark.createDataFrame([(1, "r", "f", "$x", 3), (2, "r", "f", "$x", 6), (3, "r", "f", "$x", 10), (4, "r", "f", "$x", 30), (5, "r", "f", "$y", 30)], "call_id long, repository_id string, relative_path string, receiver string, at long")
    got = {r.call_id: r.classes for r in links.php_typed_receivers(c, w).collect()}
    assert got == {1: ["A"], 2: None, 3: ["B", "C"], 4: None, 5: None}


def test_recovery_regions(spark):
    f = spark.createDataFrame([(1, "go", 'func f() { "}" }'), (2, "go", "func f() { /* } */"), (3, "python", "x = 1\ny = (\n"), (4, "rust", "fn f() )"), (5, None, "x"), (6, "go", None), (7, "php", "<?php [é] }")], "k long, l string, t string")
    got = {r.k: (r.status, r.byte_start, r.byte_end) for r in extract.recovery_regions(f, ["k"], "l", "t").collect()}
    assert got == {1: ("clean", None, None), 2: ("recovered", 9, 18), 3: ("recovered", 6, 12), 4: ("recovered", 7, 8), 5: ("clean", None, None), 6: ("clean", None, None), 7: ("recovered", 11, 12)}


def test_incremental_fold_equals_whole(spark, small):
    e = sessions.clean_events(spark.read.parquet(f"{small}/agent_events.parquet"))
    whole = rows(sessions.session_fold(e))
    stored = sessions.session_fold(e.where("number <= 30"))
    assert rows(sessions.derive_incrementally(stored, e, e.where("number > 30"))) == whole
    # Every third event comes late, with an older number.
    late = e.where("number % 3 = 1")
    assert rows(sessions.derive_incrementally(sessions.session_fold(e.where("number % 3 <> 1")), e, late)) == whole


def test_follow_ups(spark):
    def call(op=None, cat=None, id_=None):
        return ("tool_call_started", Row(repository_operation=op, category=cat, tool_call_id=id_))

    show, seen, other = ("context_artifact_presented", Row(repository_operation=None, category=None, tool_call_id="p1")), ("source_observed", Row(repository_operation=None, category=None, tool_call_id=None)), ("agent_message", Row(repository_operation=None, category=None, tool_call_id=None))
    cases = {
        "a": [show, seen, call("edit"), call("discovery_search")],  # ends at the edit
        "b": [show, seen, call("discovery_list"), call("test")],
        "c": [show, call("discovery_search", None, "p1"), other],  # the producer's own call
        "d": [show, other, show],
        "e": [show, call("git_inspection"), call(None, "shell")],
        "f": [show, *[other] * 63, call(None, "search")],
        "g": [show, *[other] * 64, call(None, "search")],
        "h": [show, call(None, "file_read"), show, call("build")],
    }
    events = [(s, 7 * n, kind, p) for s, es in cases.items() for n, (kind, p) in enumerate(es, 1)] + [("a", None, *show)]
    df = spark.createDataFrame(events, "session string, number long, event_type string, p struct<repository_operation: string, category: string, tool_call_id: string>")
    got = {(r.session, r.start): (r.outcome, r.n_after, r.verified) for r in sessions.follow_ups(df).collect()}
    assert got == {
        ("a", 7): ("verification", 2, True), ("b", 7): ("discovery", 3, True), ("c", 7): ("none", 2, False), ("d", 7): ("artifact", 2, False), ("d", 21): ("none", 0, False),
        ("e", 7): ("unclassified", 2, False), ("f", 7): ("discovery", 64, False), ("g", 7): ("none", 64, False), ("h", 7): ("artifact", 2, True), ("h", 21): ("task_action", 1, False),
    }
    assert [(r.session, r.number, r.position) for r in sessions.positions(df.where("session = 'b'"), 8).orderBy("number").collect()] == [("b", 7, 0), ("b", 14, 1), ("b", 21, 2), ("b", 28, 3)]


def test_floor_percentiles_against_sorting(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.choice([rng.randrange(10), rng.randrange(10**9)])) for _ in range(700)] + [("c", 5), ("c", None), ("d", None)]
    got = {r.k: (r.n, r.most, r.p0, r.p50, r.p99) for r in sessions.floor_percentiles(spark.createDataFrame(data, "k string, v long"), ["k"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99}, 8).collect()}
    for k in "abc":
        v = sorted(x for j, x in data if j == k and x is not None)
        assert got[k] == (len(v), v[-1], v[0], v[int((len(v) - 1) * 0.5)], v[int((len(v) - 1) * 0.99)])
    assert set(got) == set("abc")


def test_mentions_and_reports(spark):
    t = spark.createDataFrame([(1, "r", "see `a/b.py:12`, ./a/b.py and c.go#L3-L9. or A/b.py"), (2, "s", "a/b.py"), (3, "r", None)], "doc_id long, repository_id string, text string")
    k = spark.createDataFrame([("r", "a/b.py"), ("r", "c.go")], "repository_id string, relative_path string")
    m = sessions.path_mentions(t, "doc_id", "text", k)
    assert rows(m) == [(1, "r", "a/b.py"), (1, "r", "c.go")]
    assert rows(sessions.mention_counts(m, "doc_id")) == [("r", "a/b.py", 1), ("r", "c.go", 1)]
    u = spark.createDataFrame([("k", 0), ("k", 3), ("k", 1)], "k string, used long")
    assert rows(sessions.utility_counts(u, ["k"], "used")) == [("k", 3, 2)]
    g = spark.createDataFrame([("f", "r", "i"), ("f", "s", "i")], "family string, reason string, intent string")
    assert sorted(r.n for r in sessions.gap_report(g).collect()) == [1, 1, 2, 2, 2]


def test_git_metadata_and_packet_forms(spark, tmp_path):
    assert tuple(repository.git_metadata(spark, str(tmp_path)).first()) == (None, None, None)
    f = spark.createDataFrame([("q", "n1", "file", "file:a", "a")], "query string, node_id string, node_kind string, node_key string, label string")
    r = spark.createDataFrame([("q", "has", "n1", "n1", "fact", None)], "query string, edge_kind string, source string, target string, evidence_class string, candidate_set_id string")
    assert packet.packet_json(f, r).first().packet == '{"query":"q","facts":[{"node_key":"file:a","node_kind":"file","label":"a"}],"relations":[{"edge_kind":"has","source":"n1","target":"n1","evidence_class":"fact"}]}'
    assert "n1 -has-> n1 (fact)" in packet.packet_human(f, r).first().packet


def test_crate_targets(spark):
    files = spark.createDataFrame([(p,) for p in ("src/lib.rs", "src/main.rs", "src/bin/t.rs", "src/x.rs", "tests/it.rs", "sub/src/main.rs", "odd/run.rs")], "relative_path string")
    cargo = spark.createDataFrame([("Cargo.toml", "package", "k", "1"), ("sub/Cargo.toml", "package", "s", "1"), ("sub/Cargo.toml", "target:bin", "s", "src/main.rs"), ("Cargo.toml", "target:example", "z", "odd/run.rs")], "relative_path string, fact string, name string, value string")
    assert rows(links.crate_targets(files, cargo)) == [("Cargo.toml", "bin", "k", "src/main.rs"), ("Cargo.toml", "bin", "t", "src/bin/t.rs"), ("Cargo.toml", "example", "z", "odd/run.rs"), ("Cargo.toml", "lib", "k", "src/lib.rs"), ("Cargo.toml", "test", "it", "tests/it.rs"), ("sub/Cargo.toml", "bin", "s", "sub/src/main.rs")]


def test_php_class_calls(spark):
    texts = {
        "a.php": "<?php\nnamespace A;\nuse B\\K as L;\nclass C extends L { static function own() {} function go() { new L(1); new Gone(); new static(); L::make(); self::own(); parent::make(); static::own(); } }\n",
        "b.php": "<?php\nnamespace B;\nclass K { static function make() {} }\n",
    }
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repository_id string, relative_path string, source_text string").withColumn("lang", F.lit("php"))
    f = extract.source_facts(files, ["repository_id", "relative_path"], "lang", "source_text").cache()
    got = {r.name: (r.outcome, list(r.candidates)) for r in candidates.php_member_calls(f).collect()}
    assert got == {
        "new L": ("single_candidate", ["b.php#1"]),
        "new Gone": ("no_candidate", []),
        "new static": ("out_of_scope", []),
        "L::make": ("single_candidate", ["b.php#2"]),
        "self::own": ("single_candidate", ["a.php#2"]),
        "parent::make": ("single_candidate", ["b.php#2"]),
        "static::own": ("out_of_scope", []),
    }
    assert {r.rule_id for r in links.rule_registry(spark).collect()} == set(links.RULES)


def test_php_function_tiers_and_methods(spark):
    texts = {
        "a.php": "<?php\nnamespace A;\nuse function B\\imp;\nuse function B\\lost;\nfunction own() {}\nclass C { function own() { imp(); lost(); own(); glob(); \\own(); nowhere(); $f(); } }\n",
        "b.php": "<?php\nnamespace B;\nfunction imp() {}\n",
        "g.php": "<?php\nfunction glob() {}\nfunction GLOB() {}\n",
        "r.rs": "struct S;\nimpl<'a> T for S { fn m() { free() } }\nimpl S { fn n() {} }\nfn free() {}\n",
    }
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repository_id string, relative_path string, source_text string").withColumn("lang", repository.language_by_path(F.col("relative_path")))
    f = extract.source_facts(files, ["repository_id", "relative_path"], "lang", "source_text").cache()
    kinds = {(r.relative_path, r.name, r.kind, r.scope) for r in f.where("fact_kind = 'declaration' and kind in ('function', 'method')").collect()}
    assert kinds == {("a.php", "own", "function", ""), ("a.php", "own", "method", "C"), ("b.php", "imp", "function", ""), ("g.php", "glob", "function", ""), ("g.php", "GLOB", "function", ""), ("r.rs", "m", "method", "S"), ("r.rs", "n", "method", "S"), ("r.rs", "free", "function", "")}
    got = {r.name: (r.outcome, list(r.candidates)) for r in candidates.php_function_calls(f).collect()}
    assert got["imp"] == ("single_candidate", ["b.php#1"]) and got["lost"] == ("no_candidate", []) and got["own"] == ("single_candidate", ["a.php#1"])
    assert got["glob"] == ("multiple_candidates", ["g.php#0", "g.php#1"]) and got["nowhere"] == ("no_candidate", []) and got["$f"] == ("out_of_scope", [])

"""Text queries, symbols, lexical scopes and integrity checks on small tables."""

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewell.functions.identifiers import identifier_terms
from tracewell.operators import graph, query, symbols, verify


def rows(df):
    return sorted(tuple(r) for r in df.collect())


NODES = "node_id string, node_key string, node_kind string, relative_path string, label string"


@pytest.fixture(scope="module")
def graph_tables(spark):
    n = spark.createDataFrame([(f"n{i}", f"decl:{i:02d}", "declaration", "x.py", "applyBatch" if i < 5 else "other") for i in range(9)], NODES)
    e = spark.createDataFrame([("e1", "n5", "n0", "call_candidate", "candidate", "s"), ("e2", "n0", "n6", "contains", "fact", None), ("e3", "n6", "n7", "call_candidate", "candidate", "s")], "edge_id string, source string, target string, edge_kind string, evidence_class string, candidate_set_id string")
    return n, e


def test_plan(spark):
    texts = ["parseHTTPRequest vec2d", "apply_batch", "XMLs é", ""]
    for t in texts:
        assert query.split_terms(t) == spark.createDataFrame([(t,)], "t string").select(identifier_terms(F.col("t"))).first()[0]
    for bad in (query.QueryPlan("x", max_results=0), query.QueryPlan("x", token_budget=0), query.QueryPlan("x", intent="paths", target="a"), query.QueryPlan("x", intent="callers"), query.QueryPlan("x", intent="?")):
        with pytest.raises(ValueError):
            bad.validate()


def test_limits_and_completeness(graph_tables):
    n, _ = graph_tables
    def state(**k):
        r = query.run(query.QueryPlan("apply batch", **k), n).collect()
        return len(r), {(x.total, x.complete, x.reason) for x in r}

    assert state(max_results=10) == (5, {(5, True, None)})
    assert state(max_results=3) == (3, {(5, True, None)})
    assert state(max_results=3, exhaustive=True) == (3, {(5, False, "limit")})
    assert state(max_results=10, token_budget=16 + 8 * 2) == (2, {(5, False, "budget")})
    assert state(max_results=10, token_budget=10)[0] == 0


def test_expansion(graph_tables):
    n, e = graph_tables
    def related(intent):
        plan = query.QueryPlan("apply batch", intent=intent, target="applyBatch")
        return [(r.seed, r.node_id) for r in query.expand(plan, query.run(plan, n), n, e).collect()]

    assert related("callers") == [("n0", "n5")] and related("callees") == [("n0", "n7")] and related("related") == [("n0", "n5"), ("n0", "n6")]


def test_targets_and_routes(spark, graph_tables):
    n, e = graph_tables
    assert rows(query.run(query.QueryPlan("x", intent="callers", target="other"), n).select("node_id", "total")) == [(f"n{i}", 4) for i in range(5, 9)]
    assert rows(query.run(query.QueryPlan("x", intent="callers", target="decl:03"), n).select("node_id")) == [("n3",)]
    more = e.unionByName(spark.createDataFrame([("e0", "n0", "n7", "contains", "fact", None), ("e4", "n7", "n6", "contains", "fact", None), ("e6", "n0", "n1", "contains", "fact", None), ("e7", "n1", "n2", "contains", "fact", None), ("e8", "n2", "n8", "contains", "fact", None), ("e9", "n8", "n7", "contains", "fact", None)], e.schema))
    def ways(a, b, **k):
        return [(r.depth, ">".join(r.trail)) for r in graph.routes(more, spark.createDataFrame([(a, b)], "seed string, goal string"), **k).orderBy("rank").collect()]

    # Routes of 1 and 2 edges; 3 edges: none, so that of 4 is not reported.
    assert ways("n0", "n7") == [(1, "e0"), (2, "e2>e3")]
    assert ways("n0", "n7", most=1) == [(1, "e0")] and ways("n0", "n7", kinds=["call_candidate"]) == [] and ways("n0", "n7", evidence="fact") == [(1, "e0")]
    assert ways("n0", "n0") == [(0, "")] and ways("n7", "n5") == [] and ways("n0", "n8", depth=2) == []
    assert len(graph.paths_between(more, spark.createDataFrame([("n0", "n7")], "seed string, goal string")).collect()) == 3
    plan = query.QueryPlan("x", intent="paths", target="n0", to="decl:07")
    assert [r.depth for r in query.plan_routes(plan, n, more).orderBy("rank").collect()] == [1, 2]
    assert query.expand(plan, query.run(plan, n), n, more).count() == 0
    assert query.plan_routes(query.QueryPlan("x", intent="paths", target="applyBatch", to="n7"), n, more).count() == 0  # five share the name


def test_reordering(spark):
    df = spark.createDataFrame([("q", "a", 0, 0.1, 6), ("q", "b", 1, 0.2, 6), ("q", "c", 2, 0.9, 6), ("q", "d", 3, None, 6), ("q", "e", 4, 0.21, 6)], "g string, k string, pos int, rate double, size int")
    order = lambda x: [r.k for r in x.orderBy("new_position").collect()]
    assert order(query.policy_order(df, ["g"], "pos", "rate", 1)) == ["a", "c", "b", "e", "d"]
    scores = spark.createDataFrame([("q", "d", 0.5), ("q", "b", 0.9)], "g string, k string, score double")
    assert order(query.rerank(df, ["g"], "pos", scores, "k")) == ["b", "d", "a", "c", "e"]
    assert [r.k for r in query.fit_budget(df, ["g"], ["pos"], "size", 13).orderBy("pos").collect()] == ["a", "b"]
    got = query.scored(df, "k", lambda s: pd.Series([0.5 if x == "a" else 7 if x == "b" else "bad" for x in s])).select("k", "score")
    assert [(r.k, r.score) for r in got.collect()][:3] == [("a", 0.5), ("b", None), ("c", None)]
    q = spark.createDataFrame([("Who calls f?",), ("path from a to b",), ("f",), ("applyBatch",), ("Which tests cover x?",), ("What is declared in go.mod?",), ("",)], "t string")
    assert [r[0] for r in q.select(query.intent_of(F.col("t"))).collect()] == ["callers", "path_or_flow", "ambiguous", "locate", "test_evidence", "definition", "ambiguous"]
    labels = spark.createDataFrame([("f",), ("cover",), ("",)], "label string")
    assert rows(query.known_anchors(q, "t", labels).select("t", "position", "anchor")) == [("Which tests cover x?", 2, "cover"), ("Who calls f?", 2, "f"), ("f", 0, "f")]


def test_symbol_exposures(spark):
    span = lambda a, b: Row(row_start=a, row_end=b)
    d = spark.createDataFrame([("r", "f", 1, span(0, 99)), ("r", "f", 2, span(10, 19)), ("r", "g", 3, span(0, 5))], "repository_id string, relative_path string, declaration_id long, span struct<row_start: long, row_end: long>")
    seen = spark.createDataFrame([("o1", "r", "f", 11, 20, "s", "i"), ("o2", "r", "f", 13, 14, "s", None), ("o3", "r", "f", 500, 501, "t", "i"), ("o4", "r", "f", None, None, "t", "i"), ("o5", "r", "f", 15, 30, "t", "i")], "observation_id string, repository_id string, relative_path string, line_start long, line_end long, session string, investigation string")
    x = symbols.symbol_exposures(seen, d)
    assert rows(x.select("observation_id", "declaration_id", "overlap", "depth")) == [("o1", 1, "inside", 1), ("o1", 2, "covers", 0), ("o2", 1, "inside", 1), ("o2", 2, "inside", 0), ("o5", 1, "inside", 1), ("o5", 2, "partial", 0)]
    assert rows(symbols.symbol_activity(x, seen).select("declaration_id", "n", "n_inside", "n_sessions", "n_investigations")) == [(1, 3, 3, 2, 1), (2, 3, 1, 2, 1)]


def test_lexical_scopes(spark):
    scopes = spark.createDataFrame([("r", "f", 0, None), ("r", "f", 1, 0), ("r", "f", 2, 1), ("r", "f", 8, 9), ("r", "f", 9, 8)], "repository_id string, relative_path string, scope_id long, parent_scope_id long")
    chains = symbols.scope_chains(scopes)
    assert rows(chains.select("scope_id", "level", "outer_id")) == [(0, 0, 0), (1, 0, 1), (1, 1, 0), (2, 0, 2), (2, 1, 1), (2, 2, 0), (8, 0, 8), (9, 0, 9)]
    d = spark.createDataFrame([("r", "f", 1, 0, "function", "x"), ("r", "f", 2, 1, "function", "x"), ("r", "f", 3, 1, "function", "x"), ("r", "f", 4, 2, "field", "x"), ("r", "f", 5, 0, "function", "y")], "repository_id string, relative_path string, declaration_id long, scope_id long, decl_kind string, decl_name string")
    uses = spark.createDataFrame([("u1", "r", "f", 2, "x"), ("u2", "r", "f", 2, "y"), ("u3", "r", "f", 2, "z"), ("u4", "r", "f", 0, "x")], "use_id string, repository_id string, relative_path string, scope_id long, name string")
    assert rows(symbols.lexical_candidates(uses, d, chains, ["function"])) == [("u1", 1, 2), ("u1", 1, 3), ("u2", 2, 5), ("u4", 0, 1)]


def test_versions_and_rebinding(spark):
    i = spark.createDataFrame([("r", "f", "d1"), ("r", "f", "d2")], "repository_id string, relative_path string, content_digest string")
    s = spark.createDataFrame([(1, "r", "f", "d1"), (2, "r", "f", None), (3, "r", "f", "d9"), (4, "r", "g", "d1")], "k long, repository_id string, relative_path string, content_digest string")
    assert rows(symbols.source_versions(s, i).select("k", "version_state")) == [(1, "exact"), (2, "assumed"), (3, "unresolved"), (4, "unknown")]
    old = spark.createDataFrame([("a", "n.f", "h", "b"), ("c", "n.g", "h", "b"), ("d", "n.h", "h", "b"), ("e", "n.i", "h", "b")], "id string, q string, head string, body string")
    new = spark.createDataFrame([("A", "n.f", "h", "b"), ("B", "n.f", "h", "x"), ("C", "n.g", "h", "x"), ("D", "n.i", "1", "2"), ("E", "n.i", "3", "4")], "id string, q string, head string, body string")
    got = {r.old_id: (r.new_id, r.state) for r in symbols.rebind(old, new, "q", ["head", "body"]).collect()}
    assert got == {"a": ("A", "same"), "c": ("C", "changed"), "d": (None, "gone"), "e": (None, "ambiguous")}
    v = spark.createDataFrame([("v1", "x", "y"), ("v2", "x", "y"), ("v3", "x", "y")], "view_id string, f1 string, f2 string")
    c = spark.createDataFrame([("v1", "x", "y"), ("v2", "x", "z")], "view_id string, f1 string, f2 string")
    assert {r.view_id: r.reason for r in symbols.validity(v, c, ["f1", "f2"]).collect()} == {"v1": None, "v2": "f2", "v3": "missing"}
    f = spark.createDataFrame([("a", "d1"), ("b", "d2")], "relative_path string, content_digest string")
    assert rows(symbols.reused_files(f, f.where("content_digest = 'd2'")).select("relative_path", "reused")) == [("a", False), ("b", True)]


def test_integrity(spark, graph_tables):
    n, e = graph_tables
    assert verify.verify_graph(n, e).count() == 0
    bad = e.unionByName(spark.createDataFrame([("e1", "n0", "nope", "contains", "fact", "s")], e.schema))
    assert rows(verify.verify_graph(n, bad)) == [("e1", "duplicate id"), ("e1", "evidence"), ("e1", "no target")]
    t = "array<struct<relative_path: string, declaration_id: long, entity_id: string>>"
    x = Row("relative_path", "declaration_id", "entity_id")
    links = spark.createDataFrame([("l1", "exact", "r", [x("a", 1, None)]), ("l2", "exact", "r", []), ("l3", "unresolved", "?", None), ("l4", "exact", "r", [x(None, None, "gone")])], f"link_id string, outcome string, rule_id string, targets {t}")
    assert rows(verify.verify_links(links, spark.createDataFrame([("ENT",)], "entity_id string"), ["r"])) == [("l2", "cardinality"), ("l3", "rule"), ("l4", "entity")]
    c = spark.createDataFrame([("c1", "multiple_candidates", [x("a", 1, None), x("a", 1, None)]), ("c2", "no_candidate", None), ("c3", "single_candidate", None)], f"record_id string, outcome string, candidates {t}")
    assert rows(verify.verify_candidates(c)) == [("c1", "repeated candidate"), ("c3", "cardinality")]
    tail = spark.createDataFrame([("r", "p", 2, [1, 2]), ("r", "q", 2, [2]), ("r", "s", 2, [2, 1])], "repository_id string, path string, n_changes long, tail array<long>")
    assert rows(verify.verify_temporal(tail)) == [("r:q", "tail"), ("r:s", "tail")]


def test_closure_reach(spark):
    from tracewell.operators import links

    s = spark.createDataFrame([("r", "f", 0, None, "file"), ("r", "f", 1, 0, "function"), ("r", "f", 2, 1, "closure"), ("r", "f", 3, 2, "closure"), ("r", "f", 4, 3, "function")], "repository_id string, relative_path string, scope_id long, parent_scope_id long, scope_kind string")
    got = rows(links.closure_reach(symbols.scope_chains(s), s, ["closure"]).select("scope_id", "outer_id"))
    assert got == [(0, 0), (1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 4)]
    u = spark.createDataFrame([("r", "f", 2, "a"), ("r", "f", 2, "b")], "repository_id string, relative_path string, scope_id long, root string")
    b = spark.createDataFrame([("r", "f", 2, "a")], "repository_id string, relative_path string, scope_id long, name string")
    assert rows(links.shadowed_roots(u, b).select("root")) == [("b",)]


def test_facets_witness_and_rollups(spark):
    text = b"fn a() { 1 }"
    src = spark.createDataFrame([("r", "f", "d1", bytearray(text))], "repository_id string, relative_path string, content_digest string, content binary")
    sp = spark.createDataFrame([("r", "f", 1, "a", 0, 7, 12), ("r", "f", 2, "b", 0, None, 99)], "repository_id string, relative_path string, declaration_id long, name string, byte_start long, body_start long, byte_end long")
    import hashlib

    got = {r.declaration_id: (r.head_digest, r.body_digest) for r in symbols.declaration_facets(sp, src.drop("content_digest")).collect()}
    assert got == {1: (hashlib.sha256(text[:7]).hexdigest(), hashlib.sha256(text[7:]).hexdigest()), 2: (None, None)}
    w = spark.createDataFrame([(1, "r", "f", "d1", 3, 6), (2, "r", "f", "d0", 3, 6), (3, "r", "g", "d1", 3, 6)], "finding_id long, repository_id string, relative_path string, content_digest string, byte_start long, byte_end long")
    assert {r.finding_id: (r.state, r.text) for r in symbols.source_witness(w, src).collect()} == {1: ("current", "a()"), 2: ("stale", None), 3: ("missing", None)}
    e = spark.createDataFrame([("p", "mentioned", 0.2, "i"), ("p", "contained", 0.9, "j"), ("q", "?", None, "i")], "path string, evidence string, similarity double, investigation string")
    assert rows(symbols.path_evidence(e).select("path", "strength", "investigations")) == [("p", 5, "i,j"), ("q", 0, "i")]
    q = spark.createDataFrame([(1, "Where is applyBatch in a/b.py?"), (2, "")], "query_id long, text string")
    k = spark.createDataFrame([("a/b.py",)], "path string")
    r = {x.query_id: (list(x.terms), list(x.identifiers), list(x.paths)) for x in symbols.query_signature(q, k, identifier_terms, ["where", "is", "in"]).collect()}
    assert r == {1: (["a", "apply", "b", "batch", "py"], ["Where", "applyBatch"], ["a/b.py"]), 2: ([], [], [])}


def test_anchors_and_aliases(spark):
    q = spark.createDataFrame([("Which functions call applyBatch applyBatch in util.encode: a::b?",), ("",), ("who is it",)], "t string")
    assert [list(r[0]) for r in q.select(query.anchors(F.col("t"))).collect()] == [["applyBatch", "util.encode", "a::b"], [], []]
    m = spark.createDataFrame([("r", "b", t) for t in "ZYXWV"] + [("r", c, t) for c in "acd" for t in "mnop"], "repository_id string, role string, term string")
    got = {r.role: list(r.terms) for r in query.manifest_aliases(m).collect()}
    assert got == {"a": list("mnop"), "b": list("vwxy"), "c": list("mnop")}
    d = spark.createDataFrame([("incoming", "call_candidate"), ("outgoing", "call_candidate"), ("incoming", "contains")], "d string, k string")
    assert [r[0] for r in d.select(query.edge_relevant("manifest_or_config", F.col("d"), F.col("k"))).collect()] == [False, False, True]
    assert [r[0] for r in d.select(query.edge_relevant("callers", F.col("d"), F.col("k"))).collect()] == [True, False, False]


def test_view_query(spark, graph_tables):
    from tracewell.operators.packet import parse_packet

    n, e = graph_tables
    out = query.view_query(query.QueryPlan("apply batch", intent="related"), n, e)
    doc = parse_packet(out["packet"].first().packet)
    assert doc.query == "apply batch" and len(doc.facts) == 7 and {r[0] for r in doc.relations} == {"call_candidate", "contains"}
    o = query.observation(out["seeds"], out["related"]).first()
    assert (o.n_seeds, o.n_related, o.n_candidates) == (5, 2, 1)
    m = spark.createDataFrame([("q", "x", 0.5), ("q", "y", 0.2)], "query string, entry string, similarity double")
    r = spark.createDataFrame([("x", "same"), ("x", "gone"), ("z", "same")], "entry string, state string")
    assert rows(query.compose_memory(m, r).select("entry", "n_same", "n_gone")) == [("x", 1, 1), ("y", 0, 0)]
    g = spark.createDataFrame([("a",)], "family string")
    assert query.gap_signatures(g, g.withColumn("node", F.lit(None).cast("string"))).count() == 1

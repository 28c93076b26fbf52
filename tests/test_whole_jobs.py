"""Registered queries do the whole job: small tables written out and read by the query itself."""

import pytest

from tracewell.operators import extract, graph
from tracewell.plans import reference

NODE = "node_id string, repository_id string, node_key string, node_kind string, language string, relative_path string, label string, disposition_kind string, deleted_at timestamp"
EDGE = "edge_id string, repository_id string, edge_kind string, evidence_class string, rule_id string, source string, target string, candidate_set_id string, outcome string"


def graph_tables(spark, folder, nodes, edges):
    """nodes: (id, kind); edges: (id, source, target)."""
    spark.createDataFrame([(n, "r", n, k, None, None, n, None, None) for n, k in nodes], NODE).write.parquet(f"{folder}/nodes.parquet")
    spark.createDataFrame([(e, "r", "contains", "fact", "x", a, b, None, None) for e, a, b in edges], EDGE).write.parquet(f"{folder}/edges.parquet")
    return str(folder)


@pytest.fixture
def chain(spark, tmp_path):
    """An entity n0 from which ten nodes follow one after another."""
    return graph_tables(spark, tmp_path, [(f"n{i}", "file" if i else "entity") for i in range(11)], [(f"e{i}", f"n{i}", f"n{i + 1}") for i in range(10)])


def test_search_goes_to_depth_8(spark, chain):
    got = sorted((r.node_id, r.depth) for r in reference.QUERIES["graph_bounded_search"](spark, chain).collect())
    assert got == [(f"n{i}", i) for i in range(9)]


def python_facts(text):
    return [(f[0], f[2], f[4]) for f in extract.facts_of("python", text)]


def test_facts_beside_damage():
    text = "import a\nclass K:\n    def f(self):\n        g()\n<<<<<<< HEAD\n        h()\n=======\n        i()\n>>>>>>> x\n        j()\nx = (\nprint 'k'\ndef last():\n    z.é()\n"
    got = python_facts(text)
    assert {("import", "", "a"), ("declaration", "", "K"), ("declaration", "K", "f"), ("declaration", "", "last"), ("call", "last", "z.é"), *(("call", "K.f", n) for n in "ghij")} == set(got)
    where = [f[7:9] for f in extract.facts_of("python", text) if f[4] == "last"]
    assert where == [(text.index("def last"), len(text.encode()) - 1)]


def test_old_python_and_moved_lines():
    text = "try:\n    import a\nexcept E, e:\n    print 'x'\nclass T:\n    def m(self):\n        raise E, 'y'\n      n()\n    def o(self):\n        p()\n"
    assert {("import", "", "a"), ("declaration", "", "T"), ("declaration", "T", "m"), ("declaration", "T", "o"), ("call", "T.o", "p")} <= set(python_facts(text))
    call = next(f for f in extract.facts_of("python", text) if f[4] == "n")
    assert call[7:9] == (text.index("n()"), text.index("n()") + 3)


def test_nesting_is_no_bound():
    assert python_facts("import q\ny = " + "a.b()" + ".b()" * 1500 + "\n")[0] == ("import", "", "q")
    deep = "z = " + "-" * 20000 + "1\nfrom ..r import (s as t,\n  u)\nclass T:\n  def m(self):\n    h(1)  # no()\n"
    assert python_facts(deep) == [("declaration", "", "z"), ("import", "", "r"), ("import", "", "r"), ("declaration", "", "T"), ("declaration", "T", "m"), ("call", "T.m", "h")]


def test_damage_at_a_blank_last_line_ends():
    text = "import a\nclass K:\n    def f(self):\n        try:\n            g()\n  "
    got = python_facts(text)
    assert {("import", "", "a"), ("declaration", "", "K"), ("declaration", "K", "f"), ("call", "K.f", "g")} == set(got)


def test_trails_go_to_six_edges(spark, chain):
    got = sorted((r.node_id, r.depth) for r in reference.QUERIES["graph_trails"](spark, chain).collect())
    assert got == [(f"n{i}", i) for i in range(1, 7)]
    assert reference.QUERIES["trail_evidence"](spark, chain).count() == 6
    between = sorted((r.seed, r.goal, r.depth) for r in reference.QUERIES["graph_paths_between"](spark, chain).collect())
    assert between == [("n0", f"n{i}", i) for i in range(1, 7)]


def test_paths_stop_at_their_goal(spark):
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "a"), ("3", "b", "c"), ("4", "a", "b"), ("5", "c", "b")], "edge_id string, source string, target string")
    ends = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a")], "seed string, goal string")
    got = sorted((r.goal, ">".join(r.trail)) for r in graph.paths_between(e, ends).collect())
    assert got == [("a", ""), ("b", "1"), ("b", "4"), ("c", "1>2>4>3"), ("c", "1>3"), ("c", "4>2>1>3"), ("c", "4>3")]


def test_every_damaged_range_is_reported():
    text = "x = 1\ny = )\nz = 2\nw = = 3\n"
    assert extract.damages("python", text) == [(6, 12), (18, 26)]
    go = "package é\n<<<<<<< HEAD\nfunc a() {}\n=======\nfunc b() {}\n>>>>>>> x\nfunc c() { ] }\n"
    assert [go.encode()[a:b] for a, b in extract.damages("go", go)] == [b"<<<<<<< HEAD", b"=======", b">>>>>>> x", b"]"]
    assert extract.damages("go", "package a\n\nvar s = `\n=======\n`\n") == []
    assert extract.damages("php", "<?php f(]; g(}\n") != []

"""Scalar functions against plain Python."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import identifiers as I
from tracewell.functions.text import canonical_path, digest_hex, distinct_names, squash_id


def one(spark, value, f, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(f(F.col("x"))).first()[0]


def brute_terms(text):
    out, cur = [], ""
    for i, c in enumerate(text):
        if not c.isalnum():
            if cur:
                out.append(cur.lower())
            cur = ""
            continue
        p = text[i - 1] if i else None
        n = text[i + 1] if i + 1 < len(text) else None
        if p is not None and cur and (p.isalpha() != c.isalpha() or (p.islower() and c.isupper()) or (p.isupper() and c.isupper() and n is not None and n.islower())):
            out.append(cur.lower())
            cur = ""
        cur += c
    return out + ([cur.lower()] if cur else [])


def test_identifier_terms(spark):
    rng = random.Random(1)
    texts = ["parseHTTPRequest", "vec2d", "snake_case", "", "A", "XMLs", "__x__", "ab12CD", "a-b::c"] + ["".join(rng.choice("abAB12_-. ") for _ in range(rng.randrange(12))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", I.identifier_terms(F.col("t")).alias("x")).collect()
    for r in got:
        assert r.x == brute_terms(r.t), r.t
    assert one(spark, None, I.identifier_terms) is None


def test_morph_variants(spark):
    assert one(spark, "queries", I.morph_variants) == sorted({"queries", "quer", "quere", "query", "queri", "querie"} | {"querie" + "e"})
    assert one(spark, "es", I.morph_variants) == ["es"]


def test_paths(spark):
    assert one(spark, ".\\a//b/./c.py", canonical_path) == "a/b/c.py"
    assert one(spark, "/A/b", canonical_path) == "A/b"
    assert one(spark, None, canonical_path) is None
    assert one(spark, " \tX:1\n", squash_id) == "x:1"
    assert one(spark, "   ", squash_id) is None
    assert one(spark, "sha256:" + "AB" * 32, digest_hex) == "ab" * 32
    assert one(spark, "ab", digest_hex) is None
    assert one(spark, "a/b/c.py", I.ancestors) == ["a/b", "a", ""]
    assert one(spark, "c.py", I.ancestors) == [""]
    assert one(spark, "src/a/mod.rs", I.rust_module_dir) == "src/a"
    assert one(spark, "src/a.rs", I.rust_module_dir) == "src/a"
    assert one(spark, "a/__init__.py", I.python_module) == "a"
    df = spark.createDataFrame([("a/b", 1), ("a/b", 2), ("a/b", 3), ("a/b", 4)], "d string, n int")
    assert [r[0] for r in df.select(I.relative_base(F.col("d"), F.col("n"))).collect()] == ["a/b", "a", None, None]


def test_php_and_go_names(spark):
    df = spark.createDataFrame([("\\A\\B", "N"), ("X", "N"), ("X\\Y", "N"), ("C", "N"), ("namespace\\C", "N"), ("C", None)], "w string, n string")
    aliases = F.create_map(F.lit("x"), F.lit("P\\Q"))
    assert [r[0] for r in df.select(I.php_class_fqn(F.col("w"), F.col("n"), aliases)).collect()] == ["A\\B", "P\\Q", "P\\Q\\Y", "N\\C", "N\\C", "C"]
    assert one(spark, "?Foo", I.php_hint_classes) == ["Foo"]
    assert one(spark, "A|int|null|B", I.php_hint_classes) == ["A", "B"]
    assert one(spark, "A&B", I.php_hint_classes) == []
    r = spark.createDataFrame([("pkg.Func",), ("a.b.c",)], "x string").select(*I.go_selector(F.col("x"))).collect()
    assert [tuple(x) for x in r] == [("pkg", "Func"), ("", "")]


def test_ranges_and_sets(spark):
    df = spark.createDataFrame([(0, 10, 0, 10), (2, 3, 0, 10), (0, 10, 2, 3), (0, 5, 4, 9), (0, 5, 5, 9)], "a long, b long, c long, d long")
    assert [r[0] for r in df.select(I.overlap_class(*map(F.col, "abcd"))).collect()] == ["covers", "inside", "covers", "partial", "none"]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["b"]), (["b"], ["b"])], "a array<string>, b array<string>")
    assert [round(r[0], 3) for r in df.select(I.jaccard(F.col("a"), F.col("b"))).collect()] == [0.333, 0.0, 1.0]


def test_question_and_query(spark):
    assert one(spark, "x QUESTION: who  calls f? INSTRUCTIONS: be short", I.question_body) == "who  calls f?"
    assert one(spark, " Who\n calls ", I.query_normal_form) == "who calls"
    assert one(spark, 'a"b\\c\n', I.packet_quote) == '"a\\"b\\\\c\\n"'
    assert one(spark, "local_missing (x)", I.reason_head) == "local_missing"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["_id", "n", "N", "__id", "x"]), unique=True))
def test_helper_names_never_clash(taken):
    made = distinct_names(taken, ["_id", "n"])
    assert len({v.lower() for v in made.values()} | {t.lower() for t in taken}) == 2 + len({t.lower() for t in taken})

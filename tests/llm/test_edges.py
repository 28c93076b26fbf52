"""Empty tables, nulls and clashing names, for all text operators."""

import pandas as pd

from tracewell.llm import handwritten, leakage, packing, subjects, syntax_check

DOCS = "doc_id long, text string, doc_kind string, source string, k string, t string"
FILES = "file_id long, repository_id string, relative_path string, language string, source_text string, k string, status string"


def test_empty_tables(spark):
    docs, files = spark.createDataFrame([], DOCS), spark.createDataFrame([], FILES)
    labels, items = spark.createDataFrame([], "doc_id long, subject string"), spark.createDataFrame([], "item_id long, item_text string")
    assert packing.pack_documents(docs, "doc_id", "text").count() == 0
    assert leakage.leaked_items(docs, "doc_id", "text", items, "item_id", "item_text").count() == 0
    assert subjects.document_subjects(docs, labels).count() == 0
    assert handwritten.not_handwritten(files).count() == 0
    assert syntax_check.checked_files(files, ["file_id"], "language", "relative_path", "source_text").count() == 0


def test_nulls_in_every_column(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, None), (2, "", "a", "b", "c", "d"), (3, "   ", None, None, None, None)], DOCS)
    files = spark.createDataFrame([(1, None, None, None, None, None, None), (2, None, None, None, "", None, None), (3, "r", "a.py", None, "x = 1\n", "k", "s")], FILES)
    labels = spark.createDataFrame([(1, None), (None, "law"), (2, " "), (3, "law")], "doc_id long, subject string")
    items = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "one two three")], "item_id long, item_text string")
    assert packing.pack_documents(docs, "doc_id", "text").count() == 3
    assert leakage.leaked_items(docs, "doc_id", "text", items, "item_id", "item_text").count() == 0
    assert subjects.document_subjects(docs, labels).count() == 0
    assert handwritten.not_handwritten(files).count() == 0
    got = {r.file_id: r.status for r in syntax_check.checked_files(files, ["file_id"], "language", "relative_path", "source_text").collect()}
    assert got == {1: "unknown", 2: "unknown", 3: "ok"}


def test_nothing_but_empty_texts(spark):
    packed = packing.pack_documents(spark.createDataFrame([(i, None) for i in range(300)], "doc_id long, text string").repartition(1), "doc_id", "text", capacity=8)
    assert packed.count() == 300 and packed.agg({"n_tokens": "sum"}).first()[0] == 0
    assert packed.select("container_id").distinct().count() <= 2


def test_bins_of_small_partitions_are_packed_together(spark):
    docs = spark.range(60).selectExpr("id as doc_id", "repeat('word ', 100) as text").repartition(20)
    report = packing.packing_report(packing.pack_documents(docs, "doc_id", "text", capacity=1024), 1024).first()
    assert report.n_containers <= report.least_containers + 1


def test_leading_comments_are_read_to_their_end():
    long = "/* " + "x" * 5000 + " */!function(){}"
    assert handwritten.leading_comment(long) == (long[: long.index("!")], "!function(){}")
    assert handwritten.leading_comment("<?php\n// a\n# b\n/* c\n d */\n$x = 1;")[0] == "// a\n# b\n/* c\n d */"
    assert handwritten.leading_comment("#!/bin/x\n#![allow(a)]\nfn f() {}") == ("", "#![allow(a)]\nfn f() {}")
    assert handwritten.leading_comment(";(function(){})()") == ("", ";(function(){})()")
    assert handwritten.leading_comment("") == ("", "") and handwritten.leading_comment("\n".join(["// l"] * 60))[1] == ""


def test_calibration_and_the_lonely_subject():
    texts = [f"{w} {w} word{i}" for i in range(60) for w in ("court", "cell", "goal")]
    marks = [[s] for _ in range(60) for s in ("law", "science", "software")]
    chain = subjects.restore(subjects.fit_chain(pd.DataFrame({"text": texts, "kind": "k", "source": "s", "subjects": marks})))
    assert len(chain.scales) == 3 and all(slope > 0 for slope, _ in chain.scales)
    assert chain.decide("the court sat in court", "k", "s") == ["law"] and chain.decide("a goal", None, None) == ["software"]
    both = chain.decide("the court saw a goal. a goal in court", "k", "s")
    assert "software" not in both or both == ["software"]

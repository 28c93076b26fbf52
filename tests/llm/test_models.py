"""Learnt operators: held-out accuracy, and the cases without data."""

import numpy as np
import pandas as pd
import pytest

from tracewell.llm import handwritten, subjects
from tracewell.llm.linear import fit_logistic, fit_svm, hash_ngrams, hash_words

DATA = "/root/testdata/sf0.1"


def test_hashes_are_stable():
    assert list(hash_words(["a", "b"], 16)) == list(hash_words(["a", "b"], 16))
    assert (hash_ngrams("abcabc", (3,), 16)[:1] == hash_ngrams("abcabc", (3,), 16)[3:]).all() and len(hash_ngrams("ab", (3,), 16)) == 0


def test_linear_models_separate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    y = (x @ np.array([2, -1, 0, 0, 1, 0]) + 0.3 > 0).astype(float)
    w = fit_logistic(x, y, 0.1)
    assert (((x @ w[:-1] + w[-1]) > 0) == y).mean() > 0.97
    rows = [(np.arange(6), r.astype(np.float32)) for r in x]
    v, b = fit_svm(rows, y * 2 - 1, 6, cost=10, epochs=40)
    assert (((x @ v + b) > 0) == y).mean() > 0.95
    assert fit_svm(rows[:3], np.ones(3), 6)[1] == 1.0 and fit_svm([], np.ones(0), 6)[1] == -1.0


@pytest.fixture(scope="module")
def sources():
    return pd.read_parquet(f"{DATA}/source_files.parquet").drop_duplicates("file_id")


def test_kinds_on_repositories_left_out(sources):
    sample = pd.DataFrame({"k": sources.file_id, "repository": sources.repository_id, "path": sources.relative_path, "language": sources.language, "text": sources.source_text})
    model = handwritten.fit_kinds(sample)
    for r in model.itertuples():
        assert r.n_positive > 50 and r.held_true > 10, r.kind
        assert r.held_hits / r.held_said > 0.9 and r.held_hits / r.held_true > 0.9, r.kind


def test_masked_giveaways_are_not_seen():
    text = "# Code generated by x. DO NOT EDIT.\nimport a\n"
    head, body = handwritten.leading_comment(text)
    assert head.startswith("# Code") and body.startswith("import")
    look = handwritten.shape(text)
    assert handwritten.giveaways("gen/a.py", head, look)["generated"] == {"head", "path"}
    seen, masked = (set(handwritten.features("gen/a.py", "python", head, body, look, m)[0]) for m in (frozenset(), frozenset(["head", "path"])))
    assert masked < seen
    assert len(handwritten.training_rows("gen/a.py", "python", text)) == 2


def test_kinds_operator(spark):
    gen = "".join(f"    def get_unit{i}(self):\n        return self._d.get({i}, 16)\n\n" for i in range(20))
    data = [(i, f"r{i % 7}", f"a/b{i}.py", "python", f"import os\n\n\ndef walk_{i}(path):\n    return os.listdir(path)\n") for i in range(60)]
    data += [(100 + i, f"r{i % 7}", f"a/b{i}.py", "python", "# Code generated by wire. DO NOT EDIT.\nclass S:\n" + gen) for i in range(20)]
    data += [(200, "r1", "a/x.py", None, None), (201, "r1", None, None, ""), (202, None, "a/y.py", "python", "class T:\n" + gen), (100, "r0", "a/b0.py", "python", "# Code generated by wire. DO NOT EDIT.\nclass S:\n" + gen)]
    df = spark.createDataFrame(data, "file_id long, repository_id string, relative_path string, language string, source_text string")
    columns = ("file_id", "relative_path", "language", "source_text")
    model = handwritten.train_kinds(df.where("file_id <> 202"), "file_id", "repository_id", *columns[1:])
    got = {r.file_id: r.kind for r in handwritten.classify_kinds(df.withColumn("kind", df.language), *columns, model).collect()}
    assert got == {**{100 + i: "generated" for i in range(20)}, 202: "generated"}  # also the one without a banner
    assert handwritten.not_handwritten(df.limit(0)).count() == 0


def test_subjects_on_held_out_documents():
    docs = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id")
    labels = pd.read_parquet(f"{DATA}/doc_labels.parquet").groupby("doc_id").subject.agg(lambda s: sorted(set(s)))
    frame = docs.loc[labels.index].assign(subjects=labels)
    frame = frame[frame.text.notna()].sample(frac=1, random_state=1)
    table = pd.DataFrame({"text": frame.text, "kind": frame.doc_kind, "source": frame.source, "subjects": frame.subjects})
    cut = int(len(table) * 0.8)
    chain = subjects.restore(subjects.fit_chain(table[:cut]))
    right = [set(chain.decide(r.text, r.kind, r.source)) == (set(r.subjects) - {"software"} or set(r.subjects)) for r in table[cut:].itertuples()]
    assert np.mean(right) > 0.85  # some labels are wrong themselves


def test_subjects_operator(spark):
    law, music = "The tort claim meets the bail hearing. A probate file waits for the notary.", "The cello part follows the tempo map. A string quartet plays the melody line."
    data = [(i, (law if i % 2 else music) + f" Note {i}.", "note", "docs") for i in range(40)]
    data += [(100, law, None, None), (101, None, "note", "docs"), (102, "  ", "note", "docs"), (103, "Entirely different words here", "note", "docs"), (100, law, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, doc_kind string, source string")
    labels = spark.createDataFrame([(i, "law" if i % 2 else "music", "ana") for i in range(40)] + [(0, "music", "ben"), (1, None, "ben"), (None, "law", "ben")], "doc_id long, subject string, annotator string")
    got = sorted(tuple(r) for r in subjects.document_subjects(docs.withColumn("subject", docs.source), labels).collect())
    assert [r for r in got if r[0] >= 100] == [(100, "law")] and len(got) == 41
    assert subjects.document_subjects(docs, labels.limit(0)).count() == 0
    assert subjects.document_subjects(docs.limit(0), labels).count() == 0

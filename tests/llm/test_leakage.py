"""Leaked items against a brute-force search, and the forms a passage may take."""

import random
from math import ceil, floor

from tracewell.llm.leakage import ItemIndex, leaked_items, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def brute(item, doc):
    n = len(item)
    grams = {tuple(doc[i : i + 10]) for i in range(len(doc) - 9)}
    if any(tuple(item[i : i + 10]) in grams for i in range(n - 9)):
        return True
    longest, need = floor(1.5 * n), ceil(0.8 * n - 1e-9)
    return any(lcs(item, doc[s : s + longest]) >= need for s in range(max(1, len(doc) - longest + 1)))


def test_against_brute_force():
    rng = random.Random(6)
    vocabulary = [a + b for a in ("queue", "a", "to", "batch", "held", "unit", "x") for b in ("", "er", "s", "ing", "2")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 9, 10, 12, 20, 33])))) for i in range(60)]
    index = ItemIndex(items)
    hits = 0
    for _ in range(400):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        item = words(rng.choice(items)[1])
        kind = rng.random()
        if kind < 0.3:
            a = rng.randrange(len(item))
            part = item[a : a + rng.choice([9, 10, 11])]
        else:
            part = [w for w in item if rng.random() > rng.choice([0.1, 0.2, 0.25])]
            for _ in range(int(len(item) * rng.choice([0.1, 0.5, 0.7, 0.9]))):
                part.insert(rng.randrange(len(part) + 1), "filler")
        at = rng.randrange(len(base) + 1)
        doc = base[:at] + part + base[at:]
        want = sorted(i for i, t in items if brute(words(t), doc)) if doc else []
        assert sorted(index.leaks(doc)) == want
        hits += len(want)
    assert hits > 300


def test_long_documents_are_searched_in_parts(monkeypatch):
    from tracewell.llm import leakage

    item = [f"w{i}" for i in range(30)]
    index = ItemIndex([(1, " ".join(item)), (2, "other " * 12)])
    monkeypatch.setattr(leakage, "PART", 50)
    for at in range(0, 140, 7):
        doc = ["x"] * at + item[:12] + ["y"] * (140 - at)
        assert index.leaks(doc) == [1]
        assert index.leaks(["x"] * at + item[:9] + ["y"] * (140 - at)) == []


def test_forms_of_words():
    plain = ["explain", "why", "openbatch", "fails", "at", "12"]
    for text in (
        "Explain why `openBatch` fails at 12",
        "EXPLAIN  WHY\nopenBatch\r\nfails, at 12.",
        "Ex-\nplain why open-\r\n> Batch fails at 12",
        "**Explain** why <em>open</em>Batch&nbsp;fails at 12",
        "Exp\u00adlain why open\u200bBatch \u201cfails\u201d \u2014 at 12",
        "\uff25xplain why openBatch fails at \uff11\uff12",
        "# Explain why\n# openBatch fails<br/>at 12",
    ):
        assert words(text) == plain, text
    assert words(None) == words("") == words("\u200b --") == []
    assert words("well-known") == ["well", "known"]


def test_operator(spark):
    item = "Explain why that single plan named expandIndigo is rotated whenever CompassItem returns early past unit 183"
    docs = [(1, "before " + item + " after", 9), (1, "before " + item + " after", 9), (2, " ".join(item.split()[:10]), 9), (3, " ".join(item.split()[:9]), 9), (4, None, 9), (5, "", 9), (6, item * 200, 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    i = spark.createDataFrame([(7, item, "s"), (7, item, "s"), (8, None, "s"), (9, "", "s"), (10, "Totally other words here", "s")], "item_id long, item_text string, suite string")
    got = lambda df, **k: sorted(tuple(r) for r in leaked_items(d, "doc_id", "text", df, "item_id", "item_text", **k).collect())
    assert got(i) == [(1, 7), (2, 7), (6, 7)]
    assert got(i, block=1) == [(1, 7), (2, 7), (6, 7)]
    assert got(i.limit(0)) == []

"""Packing: capacity, wholeness and fill."""

import random
from collections import defaultdict

from tracewell.llm.packing import BestFit, pack_documents, packing_report


def test_best_fit_keeps_its_bounds():
    rng = random.Random(1)
    for capacity, open_bins in ((10, 1), (100, 4), (2048, 64)):
        bins, load = BestFit(capacity, open_bins), defaultdict(int)
        for _ in range(3000):
            size = min(capacity, int(rng.expovariate(8 / capacity)))
            load[bins.put(size)] += size
            assert bins.n_open <= open_bins and bins.n_open == sum(map(len, bins.by_free.values()))
        assert max(load.values()) <= capacity


def test_best_fit_takes_the_tightest():
    bins = BestFit(10, 3)
    assert [bins.put(s) for s in (6, 7, 3, 4)] == [0, 1, 1, 0]
    assert bins.put(10) == 2 and bins.n_open == 0
    assert [bins.put(s) for s in (5, 6, 7)] == [3, 4, 5]
    assert bins.put(8) == 6 and bins.n_open == 3  # the fullest (7) closed
    assert bins.put(3) == 4


def test_documents_are_packed_whole(spark):
    rng = random.Random(2)
    texts = [None, "", "  ", "word " * 5000, "ünïcode 日本 <|endoftext|>"] + [" ".join("abc" for _ in range(rng.randrange(1, 900))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, container_id string, k long").repartition(3)
    packed = pack_documents(df, "doc_id", "text", capacity=1024, open_bins=16)
    rows = packed.collect()
    load, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r.container_id] += r.n_tokens
        pieces[r.doc_id].append((r.piece_no, r.first_token, r.n_tokens))
    assert max(load.values()) <= 1024 and set(pieces) == set(range(len(texts)))
    for d, ps in pieces.items():
        ps.sort()
        assert [p for p, *_ in ps] == list(range(len(ps)))
        assert all(n == 1024 for _, _, n in ps[:-1]) and all(f == 1024 * p for p, f, _ in ps)
    assert len(pieces[3]) == 5 and pieces[0] == [(0, 0, 0)]
    report = packing_report(packed, 1024).first()
    assert report.fill > 0.9 and report.n_containers >= report.least_containers
    assert pack_documents(df.limit(0), "doc_id", "text").count() == 0

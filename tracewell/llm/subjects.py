"""Subject areas of documents, several or none each.

A chain of logistic classifiers, one per subject. Each sees how much of a
document's term evidence speaks for its subject (weights of terms are estimated
from the labelled documents, each document's own label left out), the source
and the structure of the document, and the decisions on the subjects before it,
which models what occurs together. A beam search over the chain finds the most
probable combination. Each link is calibrated on labelled documents it was not
fitted on, so that the scores that the beam multiplies are probabilities; a
subject that holds only alone is a constraint on the combinations.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.linear import fit_logistic, fit_scale, hash_words
from tracewell.session import written

#: Labelled documents, at most, that the chain is fitted on (a uniform sample by hash of the id).
TRAIN_DOCS = 20_000
BEAM = 8
#: Pseudo-documents of the prior in a term's distribution over subjects.
SMOOTH = 1.5
#: The least lift of a term over the prior that counts as evidence.
LEAST_SHARE = 0.4
#: One of so many labelled documents is kept out of a first fit, to calibrate on.
HELD_OUT = 4
#: Kinds and sources of documents are hashed into 2^SLOT_BITS features each.
SLOT_BITS = 5
#: The subject that holds only where no other does (see the table of subjects).
FALLBACK = "software"

_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])")
_SENTENCE = re.compile(r"[.!?](?:\s|$)|\n+")
_WORD = re.compile(r"[^\W\d_]+")
#: Words, and what ends a sentence.
_TOKEN = re.compile(r"[^\W\d_]+|[.!?](?=\s|\Z)|\n")
_HEADING, _ITEM = re.compile(r"^[^\S\n]*#", re.M), re.compile(r"^[^\S\n]*[-*] ", re.M)
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)


def sentences(text: str) -> list[list[str]]:
    """Terms (words and pairs of words, identifiers divided) of each sentence or line."""
    out = []
    for part in _SENTENCE.split(_CAMEL.sub(" ", text)):
        words = [w for w in _WORD.findall(part.lower())]
        if words:
            out.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    return out


def structure(text: str, kind: str | None, source: str | None) -> np.ndarray:
    """Source and structure features of a document."""
    lines = text.count("\n") + 1
    code = sum(len(m) for m in _CODE.findall(text))
    own = [
        np.log1p(len(text)) / 10,
        np.log1p(lines) / 5,
        len(_HEADING.findall(text)) / lines,
        len(_ITEM.findall(text)) / lines,
        code / max(1, len(text)),
        text.count("`") / max(1, len(text)) * 10,
    ]
    slots = np.zeros(2 << SLOT_BITS)
    for base, name in ((0, kind), (1 << SLOT_BITS, source)):
        if name:
            slots[base + int(hash_words([str(name)], SLOT_BITS)[0])] = 1.0
    return np.concatenate([own, slots])


class Chain:
    """The fitted model; small, and the same in every worker."""

    def __init__(self, subjects: list[str]) -> None:
        # The fallback is decided last, knowing all others.
        self.subjects = sorted(subjects, key=lambda s: (s == FALLBACK, s))
        self.terms: dict[str, int] = {}
        self.share = np.empty((0, len(subjects)), np.float32)
        self.weights: list[np.ndarray] = []
        #: Slope and offset that make a link's score a probability.
        self.scales: list[tuple[float, float]] = []

    # term evidence

    def _count(self, docs: list[list[list[str]]], y: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Documents per term and subject; the term numbers of each document."""
        seen = Counter(t for d in docs for t in {t for s in d for t in s})
        self.terms = {t: i for i, t in enumerate(sorted(t for t, n in seen.items() if n > 1))}
        counts = np.zeros((len(self.terms), len(self.subjects)), np.float32)
        held = []
        for d, row in zip(docs, y):
            index = np.array(sorted({self.terms[t] for s in d for t in s if t in self.terms}), np.int64)
            counts[index] += (row / max(1.0, row.sum())).astype(np.float32)
            held.append(index)
        return counts, held

    def _shares(self, counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """P(subject | term) above LEAST_SHARE, else 0: what a term says."""
        p = (counts + SMOOTH * prior) / (counts.sum(axis=-1, keepdims=True) + SMOOTH)
        return np.where(p >= LEAST_SHARE, p, 0).astype(np.float32)

    def evidence(self, doc: list[list[str]], share: np.ndarray, index_of: dict[int, int]) -> np.ndarray:
        """`features_of` a document whose own label is left out of `share` (by number among its own terms)."""
        index, starts = [], []
        for sentence in doc:
            held = [index_of[self.terms[t]] for t in sentence if t in self.terms]
            if held:
                starts.append(len(index))
                index += held
        got = np.add.reduceat(share[index], starts, axis=0).astype(np.float64) if index else np.zeros((0, len(self.subjects)))
        return self._features(got, np.zeros(len(got), np.int64), 1)[0]

    def evidence_all(self, texts: list[str]) -> np.ndarray:
        """Per document and subject: share and amount of evidence, share and number of sentences, whether it is the strongest."""
        if not hasattr(self, "_numbers"):
            self._numbers = self.terms | dict.fromkeys(".!?\n", -2)
        get, ids, pairs, sizes = self._numbers.get, [], [], []
        for text in texts:
            tokens = _TOKEN.findall(_CAMEL.sub(" ", text).lower())
            tokens.append("\n")  # ends the last sentence
            ids.extend(map(get, tokens, repeat(-1)))
            pairs.extend(map(get, map(" ".join, pairwise(tokens)), repeat(-1)))
            pairs.append(-1)
            sizes.append(len(tokens))
        one, two = np.array(ids, np.int64), np.array(pairs, np.int64)
        ends = np.cumsum(sizes)
        sentence = np.cumsum(one == -2)
        at_one, at_two = np.flatnonzero(one >= 0), np.flatnonzero(two >= 0)
        number = np.concatenate([sentence[at_one], sentence[at_two]])
        order = np.argsort(number, kind="stable")
        number, term = number[order], np.concatenate([one[at_one], two[at_two]])[order]
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        got = np.add.reduceat(self.share[term], starts, axis=0).astype(np.float64) if len(term) else np.zeros((0, len(self.subjects)))
        # The document of a sentence: documents end in a sentence's end.
        doc = np.searchsorted(sentence[ends - 1], number[starts], "right")
        return self._features(got, doc, len(texts))

    def _features(self, got: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """(document, subject, feature) from the evidence of sentences and their documents."""
        s = len(self.subjects)
        mass, lines = np.zeros((docs, s)), np.zeros(docs * s)
        np.add.at(mass, doc, got)
        clear = got.max(axis=1, initial=0) >= 0.5
        lines += np.bincount(doc[clear] * s + got[clear].argmax(axis=1), minlength=docs * s) if clear.any() else 0
        lines = lines.reshape(docs, s)
        all_lines, top = lines.sum(axis=1, keepdims=True), mass.max(axis=1, keepdims=True)
        return np.stack(
            [
                mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-9),
                np.log1p(mass) / 3,
                lines / np.maximum(all_lines, 1e-9),
                np.minimum(lines, 4) / 4,
                (mass == top) & (top > 0),
                (lines == 1).astype(float),
                np.where(lines > 0, 1 / np.maximum(all_lines, 1), 0),
            ],
            axis=2,
        )

    # the chain

    def _rows(self, k: int, own: np.ndarray, shape: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Features of the k-th classifier, for a batch of (document, decisions before)."""
        e = own[:, k, :]
        others = np.delete(own, k, axis=1)
        rival = others.max(axis=1) if others.shape[1] else np.zeros((len(own), own.shape[2]))
        return np.hstack([e, e * e, rival[:, :4], e[:, :1] * shape[:, :1], shape, before[:, :k], before[:, :k].sum(axis=1, keepdims=True)])

    def fit(self, texts: list[str], y: np.ndarray, kinds: list[str | None], sources: list[str | None]) -> None:
        docs = [sentences(t) for t in texts]
        counts, held = self._count(docs, y)
        prior = (y.sum(axis=0) + 1) / (y.sum() + y.shape[1])
        self.share = self._shares(counts, prior)
        own = []
        for d, index, row in zip(docs, held, y):
            # Each document is shown the evidence that the others give.
            left = self._shares(counts[index] - (row / max(1.0, row.sum())).astype(np.float32), prior)
            own.append(self.evidence(d, left, {int(i): j for j, i in enumerate(index)}))
        own = np.array(own)
        shape = np.array([structure(t, k, s) for t, k, s in zip(texts, kinds, sources)])
        out = np.arange(len(texts)) % HELD_OUT == HELD_OUT - 1  # rows come in order of their keys
        for k in range(len(self.subjects)):
            x, target = self._rows(k, own, shape, y), y[:, k]
            scale = (1.0, 0.0)
            if out.any() and 0 < target[out].sum() < out.sum() and 0 < target[~out].sum() < (~out).sum():
                first = fit_logistic(x[~out], target[~out], penalty=0.3)
                scale = fit_scale(self._score(first, x[out]), target[out])
            self.weights.append(fit_logistic(x, target, penalty=0.3))
            self.scales.append(scale)
        used = np.flatnonzero(self.share.max(axis=1) > 0)
        names = sorted(self.terms, key=self.terms.get)
        self.terms, self.share = {names[i]: j for j, i in enumerate(used)}, self.share[used]

    @staticmethod
    def _score(w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ w[:-1] + w[-1], -30, 30)

    def decide(self, text: str, kind: str | None, source: str | None) -> list[str]:
        """The subjects of a text: the most probable combination of the chain."""
        return self.decide_all([text], [kind], [source])[0]

    def decide_all(self, texts: list[str], kinds: list[str | None], sources: list[str | None]) -> list[list[str]]:
        """`decide` for a batch: the beams of all documents advance together."""
        own = self.evidence_all(texts)
        spoken = own[:, :, 0].any(axis=1)  # else nothing in the text speaks for any subject
        out: list[list[str]] = [[] for _ in texts]
        at = np.flatnonzero(spoken)
        if not len(at):
            return out
        own = own[at]
        shape = np.array([structure(texts[i], kinds[i], sources[i]) for i in at])
        n, docs = len(self.subjects), np.arange(len(at))
        owner, score, chosen = docs, np.zeros(len(at)), np.zeros((len(at), n))
        for k, (w, (slope, offset)) in enumerate(zip(self.weights, self.scales)):
            x = self._rows(k, own[owner], shape[owner], chosen)
            p = np.clip(1 / (1 + np.exp(-(slope * self._score(w, x) + offset))), 1e-12, 1 - 1e-12)
            if self.subjects[k] == FALLBACK:  # decided last: no combination holds it beside another
                p = np.where(chosen.any(axis=1), 1e-300, p)
            yes = chosen.copy()
            yes[:, k] = 1
            owner, score, chosen = np.concatenate([owner, owner]), np.concatenate([score + np.log1p(-p), score + np.log(p)]), np.concatenate([chosen, yes])
            order = np.lexsort((-score, owner))
            rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            order = order[rank < BEAM]
            owner, score, chosen = owner[order], score[order], chosen[order]
        best = np.searchsorted(owner, docs)  # sorted by document, the most probable first
        for i, row in zip(at, chosen[best]):
            out[i] = [s for s, on in zip(self.subjects, row) if on]
        return out


def fit_chain(sample: pd.DataFrame) -> bytes:
    """The chain fitted on (text, kind, source, subjects)."""
    sample = sample[sample["text"].map(lambda t: isinstance(t, str) and bool(t.strip()))]
    subjects = sorted({s for row in sample["subjects"] for s in row})
    chain = Chain(subjects)
    if len(sample) and subjects:
        y = np.array([[float(s in set(row)) for s in chain.subjects] for row in sample["subjects"]])
        chain.fit(list(sample["text"]), y, list(sample["kind"]), list(sample["source"]))
    return pickle.dumps(chain.__dict__)


def restore(blob: bytes) -> Chain:
    chain = Chain([])
    chain.__dict__.update(pickle.loads(blob))
    return chain


def train_subjects(docs: DataFrame, key: str, text: str, kind: str, source: str, labels: DataFrame, label_key: str, subject: str, rows: int = TRAIN_DOCS) -> DataFrame:
    """The chain as one row `model`, fitted in one task on a bounded sample of labelled documents.

    Labels that annotators repeat count once; null labels are none.
    """
    held = (
        labels.select(F.col(label_key).alias("k"), F.lower(F.trim(F.col(subject))).alias("s"))
        .where("k is not null and s is not null and s <> ''")
        .groupBy("k")
        .agg(F.sort_array(F.collect_set("s")).alias("subjects"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(rows)
    )
    plain = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"), F.col(kind).alias("kind"), F.col(source).alias("source"))
    # At most `rows` labelled ids: that bounds the broadcast and the task that fits.
    sample = plain.join(F.broadcast(held), "k").dropDuplicates(["k"])
    return sample.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda pdf: pd.DataFrame({"model": [fit_chain(pdf.sort_values("k"))]}), "model binary")


def assign_subjects(docs: DataFrame, key: str, text: str, kind: str, source: str, model: DataFrame) -> DataFrame:
    """(key, subject), one row per subject of each document; documents about none have no row.

    Null and blank texts have none; repeated rows come out once. Without a model
    (no labels) the result is empty.
    """
    spark, type_ = docs.sparkSession, docs.schema[key].dataType.simpleString()
    sent = spark.sparkContext.broadcast([bytes(r.model) for r in model.collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = restore(sent.value[0]) if sent.value else None
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start : start + 512]
                part = part[part["t"].map(lambda t: isinstance(t, str) and bool(t.strip()))]
                decided = chain.decide_all(list(part["t"]), list(part["d"]), list(part["s"])) if chain is not None and len(part) else []
                yield pd.DataFrame([(k, found) for k, row in zip(part["k"], decided) for found in row], columns=["k", "subject"])

    plain = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(kind).alias("d"), F.col(source).alias("s")).where("k is not null")
    return plain.mapInPandas(run, f"k {type_}, subject string").distinct().withColumnRenamed("k", key)


def document_subjects(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Subject areas of the `documents` table, learnt from `doc_labels`."""
    model = written(train_subjects(docs, "doc_id", "text", "doc_kind", "source", labels, "doc_id", "subject"))
    return assign_subjects(docs, "doc_id", "text", "doc_kind", "source", model)

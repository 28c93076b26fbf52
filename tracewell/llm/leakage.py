"""Passages of evaluation items in documents.

Q-gram lemma filtering: an item that a document contains within the allowed
edits shares a known least number of character q-grams with it, on diagonals
that lie close together. Grams are counted per document first, then in
overlapping bands of diagonals; regions that reach the bound are verified.

The bounds are exact. For a share of an item's words, grams are taken within a
word and its two neighbouring blanks: edits are whole words, and an edit destroys
the grams of its own word only. For a run of words, which allows no edit, longer
grams that begin with a word are counted on single diagonals.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a gram within a word, and of a gram that begins with a word and may run over several.
Q, PHRASE = 5, 16
RUN = 10
SHARE = 0.8
STRETCH = 1.5
#: Words of a document that are searched at once; longer ones are searched in overlapping parts of this size.
PART = 50_000
#: Items of one index, and how many indexes a worker holds at once; more items take more passes.
BLOCK, BLOCKS_A_PASS = 2000, 8
#: Documents that are searched at once, at most.
TOGETHER = 256
#: Marks (documents times grams of items) that a worker holds at once.
HELD_MARKS = 4_000_000

_WORD = re.compile(r"[^\W_]+")
_DIVIDED = re.compile(r"(?<=[^\W_])[-‐‑][ \t]*(?:\r\n|\r|\n)[ \t]*(?:(?:[>#|*%;]+|//+|--+)[ \t]*)*(?=[^\W_])")
_INLINE = re.compile(r"</?(?:em|strong|b|i|u|s|mark|code|span|sub|sup|small|a|font|tt|kbd)(?:\s[^<>]*)?>", re.I)
_BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|td|tr|th|table|tbody|h[1-6]|pre|blockquote|hr|img)(?:\s[^<>]*)?/?>", re.I)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_MUL, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in one form: case, layout, typography, markup and invisible characters are gone.

    A word divided at the end of a line is one word. None gives no words.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _COMMENT.sub(" ", text)
        text = _BLOCK_TAG.sub("\n", _INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        hidden = {ord(c): None for c in set(text) if ord(c) > 126 and unicodedata.category(c) in ("Cf", "Mn", "Me")}
        if hidden:
            text = text.translate(hidden)
    if "-" in text or "‐" in text or "‑" in text:
        text = _DIVIDED.sub("", text)
    return _WORD.findall(text.casefold())


def _powers(padded: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """size -> hashes of the grams of so many code points at every place; grams of 2^k are made of two halves."""
    out, h, m, size = {}, padded.astype(np.uint64), _MUL, 1
    with np.errstate(over="ignore"):
        while True:
            out |= {n: h[:-1] * _MUL + padded[size:].astype(np.uint64) for n in sizes if n == size + 1 and len(h) > 1}
            if size in sizes:
                out[size] = h
            if 2 * size > max(sizes) or len(h) <= size:
                return out
            h, m, size = h[:-size] * m + h[size:], m * m, 2 * size


def _grams(padded: np.ndarray, words_before: np.ndarray, begins: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(word numbers, hashes, documents) of the inner grams - Q code points that hold a blank at their ends only -
    and of the phrase grams - PHRASE code points that begin with a word - of documents laid end to end.

    `begins`: where each document begins, `words_before`: how many words come before it.
    """
    blank, hashes = padded == 32, _powers(padded, [Q, PHRASE])
    inner = phrase = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
    if Q in hashes:
        n = len(hashes[Q])
        within = np.zeros(n, bool)
        for k in range(1, Q - 1):
            within |= blank[k : k + n]
        at = np.flatnonzero(~within)
        doc = np.searchsorted(begins, at, "right") - 1
        # Every document has one blank more than words.
        inner = np.cumsum(blank)[at + 1] - 1 - doc - words_before[doc], hashes[Q][at], doc
    if PHRASE in hashes:
        at = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        word = np.arange(len(at))
        at = at[at < len(hashes[PHRASE])]
        doc = np.searchsorted(begins, at, "right") - 1
        phrase = word[: len(at)] - words_before[doc], hashes[PHRASE][at], doc
    return inner, phrase


def _padded(tokens: list[str]) -> np.ndarray:
    return np.frombuffer((" " + " ".join(tokens) + " ").encode("utf-32-le"), np.uint32)


class Grams:
    """Inverted grams of items: which items hold a gram, and at which of their words."""

    def __init__(self, each: list[tuple[np.ndarray, np.ndarray]]) -> None:
        flat = np.concatenate([*(h for _, h in each), np.empty(0, np.uint64)])
        owner = np.concatenate([*(np.full(len(h), k) for k, (_, h) in enumerate(each)), np.empty(0)]).astype(np.int64)
        at_word = np.concatenate([*(w for w, _ in each), np.empty(0)]).astype(np.int64)
        self.n_items = len(each)
        self.vocabulary, gid = np.unique(flat, return_inverse=True)
        self.marked = np.zeros(1 << 20, bool)
        self.marked[self.vocabulary >> _TOP] = True
        order = np.argsort(gid, kind="stable")
        self.post_item = owner[order]
        self.post_from = np.searchsorted(gid[order], np.arange(len(self.vocabulary) + 1))
        self.item_gid, self.item_word = [], []
        for k in range(len(each)):
            mine = np.flatnonzero(owner == k)
            o = mine[np.argsort(gid[mine], kind="stable")]
            self.item_gid.append(gid[o])
            self.item_word.append(at_word[o])

    def known(self, at_word: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram numbers, words, documents) of the grams of documents that some item holds."""
        if not len(self.vocabulary):
            return (np.empty(0, np.int64),) * 3
        # Most grams of a document are in no item: a bitmap of the hashes' top bits sorts them out.
        may = np.flatnonzero(self.marked[h >> _TOP])
        h = h[may]
        place = np.searchsorted(self.vocabulary, h)
        place[place == len(self.vocabulary)] = 0
        hit = self.vocabulary[place] == h
        may = may[hit]
        return place[hit], at_word[may], doc[may]

    def shared(self, gid: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """(document, item): how many of the item's grams are among the document's."""
        size = len(self.vocabulary)
        if not len(gid):
            return np.zeros((docs, self.n_items), np.int64)
        there = np.zeros(docs * size, bool)
        there[doc * size + gid] = True
        of, seen = np.divmod(np.flatnonzero(there), size)
        counts = self.post_from[seen + 1] - self.post_from[seen]
        starts = np.repeat(self.post_from[seen] - (np.cumsum(counts) - counts), counts)
        item = self.post_item[starts + np.arange(len(starts))]
        return np.bincount(np.repeat(of * self.n_items, counts) + item, minlength=docs * self.n_items).reshape(docs, self.n_items)

    def diagonals(self, k: int, gid: np.ndarray, doc_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(diagonal, gram of the item) of each meeting of item k and a document."""
        mine = self.item_gid[k]
        low = np.searchsorted(mine, gid, "left")
        counts = np.searchsorted(mine, gid, "right") - low
        total = int(counts.sum())
        if not total:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        index = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
        return np.repeat(doc_word, counts) - self.item_word[k][index], index


class ItemIndex:
    """Grams of a block of items and the least numbers that a passage of each must share."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        parsed = [(i, w) for i, t in items if (w := words(t))]
        self.ids = [i for i, _ in parsed]
        self.words = [w for _, w in parsed]
        padded = [_padded(w) for w in self.words]
        one = np.zeros(2, np.int64)
        grams = [_grams(p, one, np.array([0, len(p)])) for p in padded]
        self.inner, self.phrases = Grams([g[:2] for g, _ in grams]), Grams([g[:2] for _, g in grams])
        self.least_share = np.array([self._least_share(w) for w in self.words], np.int64)
        self.least_run = np.array([self._least_run(w) for w in self.words], np.int64)

    @classmethod
    def _least_share(cls, w: list[str]) -> int:
        """Inner grams of the words that must be there at least: those that have fewest."""
        each = np.maximum(np.array([len(x) for x in w]) + 2 - Q + 1, 0)
        return int(np.sort(each)[: cls.needed(len(w))].sum())

    @staticmethod
    def _least_run(w: list[str]) -> int:
        """Phrase grams that lie within any RUN consecutive words; with fewer words no run exists."""
        if len(w) < RUN:
            return 2**60
        lengths = [len(x) + 1 for x in w]
        least = []
        for a in range(len(w) - RUN + 1):
            left, inside = sum(lengths[a : a + RUN]) - 1, 0
            for n in lengths[a : a + RUN]:
                inside += left >= PHRASE
                left -= n
            least.append(inside)
        return min(least)

    @staticmethod
    def needed(n: int) -> int:
        return ceil(SHARE * n - 1e-9)

    def leaks(self, tokens: list[str]) -> list[int]:
        """Ids of the items that a document of these words leaks."""
        return self.leaks_all([tokens])[0]

    def leaks_all(self, documents: list[list[str]]) -> list[list[int]]:
        """`leaks` of each document; many short ones are searched at once, long ones in overlapping parts."""
        found: list[set[int]] = [set() for _ in documents]
        if not self.ids:
            return [[] for _ in documents]
        overlap = max(RUN, floor(STRETCH * max(map(len, self.words))))  # no passage is longer
        most = max(1, HELD_MARKS // max(1, len(self.inner.vocabulary), len(self.phrases.vocabulary)))
        held: list[tuple[int, list[str]]] = []
        size = 0
        for d, tokens in enumerate(documents):
            for a in range(0, len(tokens), PART) if len(tokens) > PART + overlap else [0] if tokens else []:
                part = tokens[a : a + PART + overlap] if len(tokens) > PART + overlap else tokens
                held.append((d, part))
                size += len(part)
                if size >= PART or len(held) >= most:
                    self._search(held, found)
                    held, size = [], 0
        self._search(held, found)
        return [sorted(f) for f in found]

    def _search(self, held: list[tuple[int, list[str]]], found: list[set[int]]) -> None:
        """Adds the items that each (number, words) leaks; their grams are counted together."""
        if not held:
            return
        # Each begins and ends with a blank: the two between them are in no gram of an item.
        texts = [_padded(tokens) for _, tokens in held]
        begins = np.cumsum([0, *map(len, texts)])
        words_before = np.cumsum([0, *(len(tokens) for _, tokens in held)])
        inner, phrases = _grams(np.concatenate(texts), words_before, begins)
        phrase_gid, phrase_word, phrase_doc = self.phrases.known(*phrases)
        inner_gid, inner_word, inner_doc = self.inner.known(*inner)
        by_run = self.phrases.shared(phrase_gid, phrase_doc, len(held)) >= self.least_run
        by_share = self.inner.shared(inner_gid, inner_doc, len(held)) >= self.least_share
        for n, k in zip(*np.nonzero(by_run | by_share)):
            number, tokens = held[n]
            if self.ids[k] in found[number]:
                continue
            a, b = np.searchsorted(phrase_doc, [n, n + 1])
            c, d = np.searchsorted(inner_doc, [n, n + 1])
            if by_run[n, k] and self._runs(k, phrase_gid[a:b], phrase_word[a:b], tokens) or by_share[n, k] and self._shares(k, inner_gid[c:d], inner_word[c:d], tokens):
                found[number].add(self.ids[k])

    def _runs(self, k: int, gid: np.ndarray, doc_word: np.ndarray, tokens: list[str]) -> bool:
        """A run of whole words allows no edit: all its grams lie on one diagonal."""
        item, least = self.words[k], int(self.least_run[k])
        if least:
            lines, each = np.unique(self.phrases.diagonals(k, gid, doc_word)[0], return_counts=True)
            lines = lines[each >= least]
        else:
            lines = np.arange(-len(item), len(tokens))
        return any(_longest_run(item, tokens, int(d)) >= RUN for d in lines)

    def _shares(self, k: int, gid: np.ndarray, doc_word: np.ndarray, tokens: list[str]) -> bool:
        item, least = self.words[k], int(self.least_share[k])
        n = len(item)
        # Words left out and put in move the diagonal by so much at most.
        width = n - self.needed(n) + floor(STRETCH * n) - self.needed(n) + 1
        if least:
            diagonal, index = self.inner.diagonals(k, gid, doc_word)
            first, size = np.floor_divide(diagonal, width), len(self.inner.item_gid[k]) + 1
            # Each band is two widths wide and overlaps the next by one; a gram of the item counts once.
            keys = np.unique(np.concatenate([first, first - 1]) * size + np.concatenate([index, index]))
            bands, each = np.unique(np.floor_divide(keys, size), return_counts=True)
            bands = bands[each >= least]
        else:
            bands = np.arange(-n // width - 1, len(tokens) // width + 1)
        for b in bands:
            begin = max(0, int(b) * width)
            end = min(len(tokens), (int(b) + 2) * width + n)
            if _aligned(item, tokens[begin:end]):
                return True
        return False


def _longest_run(item: list[str], tokens: list[str], d: int) -> int:
    best = now = 0
    for i in range(max(0, -d), min(len(item), len(tokens) - d)):
        now = now + 1 if item[i] == tokens[i + d] else 0
        best = max(best, now)
    return best


def _aligned(item: list[str], region: list[str]) -> bool:
    """Whether enough words of `item` occur in order within a short enough stretch of `region`.

    Banded alignment: only stretches of the allowed length are aligned, by
    bit-parallel longest common subsequence.
    """
    n = len(item)
    need, longest = ItemIndex.needed(n), floor(STRETCH * n)
    masks: dict[str, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    known = np.array([w in masks for w in region], np.int64)
    if known.sum() < need:
        return False
    below = np.concatenate([[0], np.cumsum(known)])
    ends = np.minimum(np.arange(len(region)) + longest, len(region))
    full = (1 << n) - 1
    for s in np.flatnonzero((known > 0) & (below[ends] - below[:-1] >= need)):
        v = full
        for w in region[s : s + longest]:
            if m := masks.get(w, 0):
                u = v & m
                v = ((v + u) | (v - u)) & full
        if n - v.bit_count() >= need:
            return True
    return False


def leaked_items(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, block: int = BLOCK) -> DataFrame:
    """(document, item) where the document contains a passage of the item.

    A passage is `RUN` consecutive words of the item, or `SHARE` of all its words
    in its order within a stretch of at most `STRETCH` times its number of words.
    Documents are never shuffled; the items are a stated query set and are held
    by each worker in blocks of `block`, `BLOCKS_A_PASS` of them in one pass over the documents.
    Null and empty texts hold and leak nothing. Repeated rows come out once.
    """
    spark = docs.sparkSession
    kinds = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    held = items.select(F.col(item_key).alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    passes = max(1, -(-held.count() // (block * BLOCKS_A_PASS)))
    plain = docs.select(F.col(doc_key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")
    out = None
    for n in range(passes):
        part = held if passes == 1 else held.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == n)
        sent = spark.sparkContext.broadcast([(r.i, r.t) for r in part.collect()])

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            indexes = [ItemIndex(sent.value[a : a + block]) for a in range(0, len(sent.value), block)]
            for pdf in batches:
                for start in range(0, len(pdf), TOGETHER):
                    part = pdf.iloc[start : start + TOGETHER]
                    texts = [words(t) for t in part["t"]]
                    rows = [(k, i) for index in indexes for k, ids in zip(part["k"], index.leaks_all(texts)) for i in ids]
                    yield pd.DataFrame(rows, columns=["k", "i"])

        found = plain.mapInPandas(search, f"k {kinds[0]}, i {kinds[1]}")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("k").alias(doc_key), F.col("i").alias(item_key)).distinct()

"""Generated, minified, vendored and data files among source files.

One linear support-vector classifier per kind, over hashed character n-grams of
the body, words of the leading comment, path components and the shape of the
text. The training labels come from giveaways (banners, well-known folders,
endless lines, nothing but literals); so that the classifiers learn the rest
as well, each labelled file is trained on again with its giveaways masked. The
decision threshold of each kind is set on repositories left out of training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.linear import Sparse, block, fit_svm, hash_ngrams, hash_words, join
from tracewell.session import written

KINDS = ("generated", "minified", "vendored", "data")
BITS = 16
#: Distinct files, at most, that the classifiers are fitted on (a uniform sample by hash of the id).
TRAIN_FILES = 6000
#: One of so many repositories is kept out of training, to set thresholds.
HELD_OUT = 5

#: What a text begins with: a tag or `#!` line, or a comment up to its end, wherever in a line that is.
_LEADING = re.compile(r"""\s*(?:(?P<tag><\?php(?=\s|\Z)|\A\s*\#![^\[\n][^\n]*)|(?P<said>//[^\n]*|\#(?![\[!])[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|<!--.*?(?:-->|\Z)))""", re.S)
_LITERAL, _DIGITS = frozenset("\"'0123456789"), {ord(d): "0" for d in "123456789"}
#: Stretches of encoded bytes.
_DENSE = re.compile(r"[A-Za-z0-9+/=]{50,}")
#: Banners of tools and of copied sources. Fixed values.
_TOOL = re.compile(r"code generated|@generated|auto[- ]?generated|machine[- ]generated|automatically (?:generated|created|produced)|generated by|produced by running|do not (?:edit|modify|make changes)|manual change is lost|changes will be lost", re.I)
_COPIED = re.compile(r"vendored (?:copy|from)|bundled third[- ]party|third[- ]party source|taken verbatim from|imported unchanged from|copied (?:unchanged )?from upstream|this file is part of [\w-]+ v?\d|\| free licen[cs]e|distributed with this product", re.I)
#: Folders that package managers and generators write to. Fixed values.
_COPY_DIRS = frozenset("vendor _vendor third_party thirdparty third-party 3rdparty node_modules bower_components godeps _workspace site-packages dist-packages deps external".split())
_TOOL_DIRS = frozenset("generated gen __generated__ zz_generated autogen".split())
_TOOL_NAME = re.compile(r"(?:[._-]gen|_pb2?(?:_grpc)?|\.pb|[._]generated|_autogen|^zz_generated.*|Generated)$")
_MIN_NAME = re.compile(r"(?:\.min|[.-]bundle|-[0-9a-f]{6,}(?:\.min)?)$")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")


def leading_comment(text: str) -> tuple[str, str]:
    """(the comments a text begins with, the rest); a tag or `#!` line before them belongs to neither."""
    text, pos, head = text.lstrip("\ufeff"), 0, []
    while (m := _LEADING.match(text, pos)) and m.end() > pos:
        if m["said"] is not None:
            head.append(m["said"])
        pos = m.end()
    return "\n".join(head), text[pos:].lstrip("\r\n")


def shape(text: str) -> dict[str, float]:
    """Longest and mean line, share of white space, of literals and of encoded bytes, length."""
    lines = text.split("\n")
    tokens = _TOKEN.findall(text)
    literals = sum(map(_LITERAL.__contains__, [t[0] for t in tokens]))
    filled = [len(x) for x in lines if x and not x.isspace()] or [0]
    return {
        "longest": max(filled),
        "mean": sum(filled) / len(filled),
        "blank": 1 - sum(map(len, text.split())) / max(1, len(text)),
        "literals": literals / max(1, len(tokens)),
        "tokens": len(tokens),
        "dense": sum(map(len, _DENSE.findall(text))) / max(1, len(text)),
    }


def giveaways(path: str, head: str, look: dict[str, float]) -> dict[str, set[str]]:
    """kind -> the views (head, path, shape) in which something gives the kind away."""
    parts = path.replace("\\", "/").split("/")
    stem = parts[-1].rsplit(".", 1)[0]
    dirs = {p.lower() for p in parts[:-1]}
    found: dict[str, set[str]] = {k: set() for k in KINDS}
    if _TOOL.search(head):
        found["generated"].add("head")
    if dirs & _TOOL_DIRS or _TOOL_NAME.search(stem):
        found["generated"].add("path")
    # One endless line in a program is none: the mean line must be long.
    if look["mean"] > 200 and look["blank"] < 0.12 and look["literals"] < 0.8:
        found["minified"].add("shape")
    if _COPIED.search(head):
        found["vendored"].add("head")
    if dirs & _COPY_DIRS:
        found["vendored"].add("path")
    if look["literals"] > 0.85 and look["tokens"] > 60 or look["dense"] > 0.8:
        found["data"].add("shape")
    return found


def _bucket(name: str, value: float, edges: tuple[float, ...]) -> list[str]:
    return [f"{name}>{e}" for e in edges if value > e] or [f"{name}low"]


def features(path: str, language: str | None, head: str, body: str, look: dict[str, float], masked: frozenset[str] = frozenset()) -> Sparse:
    """The example of a file. `masked` names views that are left out."""
    return join(blocks(path, language, head, body, look, masked))


def blocks(path: str, language: str | None, head: str, body: str, look: dict[str, float], masked: frozenset[str] = frozenset()) -> list[Sparse]:
    """The views of a file, each a sparse vector of fixed length."""
    parts = [block(hash_ngrams(body.translate(_DIGITS), (3, 4, 5), BITS, 1), 0.7)]
    if "head" not in masked:
        words = re.findall(r"[a-z@<>|]+", head.lower())
        parts.append(block(hash_words(["h:" + w for w in words] + [f"h:{a} {b}" for a, b in zip(words, words[1:])], BITS), 1.4))
    if "path" not in masked:
        pieces = path.replace("\\", "/").split("/")
        stem = pieces[-1].rsplit(".", 1)[0]
        names = [f"d:{p.lower()}" for p in pieces[:-1]] + [f"f:{w}" for w in re.findall(r"[A-Z]?[a-z]+|[._-]|\d+", re.sub(r"[0-9a-f]{6,}", "9", stem))]
        if m := re.search(r"(?:[._-][a-z]+|[A-Z][a-z]+)$", stem):
            names.append("e:" + m.group())
        parts.append(block(hash_words(names, BITS), 1.4, False))
    if "shape" not in masked:
        marks = _bucket("longest", look["longest"], (80, 120, 200, 500, 2000)) + _bucket("mean", look["mean"], (30, 60, 120, 400)) + _bucket("literals", look["literals"], (0.3, 0.5, 0.7, 0.85, 0.95)) + _bucket("tokens", look["tokens"], (60, 300, 2000))
        marks += [f"dense>{e}" for e in (0.2, 0.5, 0.8) if look["dense"] > e]
        marks += [f"blank<{e}" for e in (0.05, 0.1, 0.15, 0.25) if look["blank"] < e]
        parts.append(block(hash_words([f"s:{m}" for m in marks] + [f"l:{language}"], BITS), 1.0, False))
    return parts


def training_rows(path: str, language: str | None, text: str) -> list[tuple[Sparse, set[str]]]:
    """A file's examples: as it is, and with the giveaways of its kinds masked."""
    head, body = leading_comment(text)
    look = shape(text)
    found = giveaways(path, head, look)
    kinds = {k for k, views in found.items() if views}
    out = [(features(path, language, head, body, look), kinds)]
    for k in kinds:
        views = found[k]
        if k == "vendored":
            # The body of a copied source looks like any other: one of two giveaways is masked at a time.
            if len(views) > 1:
                out += [(features(path, language, head, body, look, frozenset([v])), kinds) for v in sorted(views)]
        elif views != {"shape"}:
            out.append((features(path, language, head, body, look, frozenset(views)), kinds))
        else:
            out.append((features(path, language, head, body, look, frozenset(["path", "head"])), kinds))
    return out


def fit_kinds(sample: pd.DataFrame) -> pd.DataFrame:
    """Weights, bias and held-out figures of each kind's classifier, from (repository, path, language, text).

    Thresholds are set on the files of held-out repositories, as they are and
    with their giveaways masked; hits are counted for both.
    """
    fit_x: list[Sparse] = []
    fit_kind: list[set[str]] = []
    held: list[tuple[Sparse, set[str], bool]] = []
    for repository, path, language, text in zip(sample["repository"], sample["path"], sample["language"], sample["text"]):
        if not isinstance(text, str):
            continue
        rows = training_rows(path or "", language, text)
        if int(hash_words([str(repository)], 20)[0]) % HELD_OUT == 0:
            held += [(x, k, n > 0) for n, (x, k) in enumerate(rows)]
        else:
            fit_x += [x for x, _ in rows]
            fit_kind += [k for _, k in rows]
    masked = np.array([m for _, _, m in held], bool)
    out = []
    for kind in KINDS:
        y = np.array([1.0 if kind in k else -1.0 for k in fit_kind])
        share = max(1.0, min(10.0, float((y < 0).sum() / max(1, (y > 0).sum()))))
        w, b = fit_svm(fit_x, y, 1 << BITS, weight=np.where(y > 0, share**0.5, 1.0))
        score = np.array([float(w[i] @ v) + b for (i, v), _, _ in held])
        true = np.array([kind in k for _, k, _ in held], bool)
        cut = _threshold(score, true)
        said = score > cut
        figures = [int(x.sum()) for part in (~masked, masked) for x in (said & true & part, said & part, true & part)]
        out.append((kind, w.astype(np.float32).tobytes(), b, cut, len(y), int((y > 0).sum()), *figures))
    return pd.DataFrame(out, columns=["kind", "weights", "bias", "cut", "n_rows", "n_positive", "held_hits", "held_said", "held_true", "masked_hits", "masked_said", "masked_true"])


def _threshold(score: np.ndarray, true: np.ndarray) -> float:
    """The cut within the margin that errs least on the held-out rows; of equal ones the nearest to 0."""
    if not len(score) or not true.any():
        return 0.0
    tries = sorted(np.linspace(-0.5, 0.5, 21), key=abs)
    return float(min(tries, key=lambda c: (int(((score > c) != true).sum()), abs(c))))


MODEL = "kind string, weights binary, bias double, cut double, n_rows long, n_positive long, held_hits long, held_said long, held_true long, masked_hits long, masked_said long, masked_true long"


def train_kinds(files: DataFrame, key: str, repository: str, path: str, language: str, text: str, rows: int = TRAIN_FILES) -> DataFrame:
    """The classifiers, fitted in one task on a bounded sample of files; one row per kind."""
    # A bound on the hash keeps some more than `rows` ids within the first scan; only those are sorted.
    share = min(1.0, 1.5 * rows / max(1, files.count()))
    some = files.select(F.col(key).alias("k")).where(F.xxhash64("k") <= F.lit(min(2**63 - 1, -(2**63) + int(share * 2**64))))
    chosen = some.distinct().orderBy(F.xxhash64("k"), "k").limit(rows)
    held = files.select(F.col(key).alias("k"), F.col(repository).alias("repository"), F.col(path).alias("path"), F.col(language).alias("language"), F.col(text).cast("string").alias("text"))
    # The chosen ids are at most `rows`: that bounds the broadcast and the task that fits.
    sample = held.join(F.broadcast(chosen), "k").dropDuplicates(["k"])
    return sample.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda pdf: fit_kinds(pdf.sort_values("k")), MODEL)


def classify_kinds(files: DataFrame, key: str, path: str, language: str, text: str, model: DataFrame) -> DataFrame:
    """(key, kind, score) of each file that is not hand-written, by its strongest classifier.

    `model` from `train_kinds`: four rows of bounded size, sent to the workers.
    Null texts are not judged, empty ones are hand-written; repeated files come out once.
    """
    spark, kind = files.sparkSession, files.schema[key].dataType.simpleString()
    sent = spark.sparkContext.broadcast([(r.kind, bytes(r.weights), r.bias, r.cut) for r in model.collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [k for k, _, _, _ in sent.value]
        weights = np.stack([np.frombuffer(w, np.float32) for _, w, _, _ in sent.value], axis=1) if names else None
        cuts = np.array([b - c for _, _, b, c in sent.value])
        for pdf in batches:
            out = []
            for k, p, lang, t in zip(pdf["k"], pdf["p"], pdf["l"], pdf["t"]):
                if not names or not isinstance(t, str) or not t.strip():
                    continue
                head, body = leading_comment(t)
                parts = blocks(p or "", lang, head, body, shape(t))
                score = sum(value @ weights[index] for index, value in parts) + cuts
                best = int(score.argmax())
                if score[best] > 0:
                    out.append((k, names[best], float(score[best])))
            yield pd.DataFrame(out, columns=["k", "kind", "score"])

    plain = files.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(language).alias("l"), F.col(text).cast("string").alias("t"))
    return plain.mapInPandas(run, f"k {kind}, kind string, score double").dropDuplicates(["k"]).withColumnRenamed("k", key)


def not_handwritten(files: DataFrame) -> DataFrame:
    """Generated, minified, vendored and data files of the `source_files` table."""
    model = written(train_kinds(files, "file_id", "repository_id", "relative_path", "language", "source_text"))
    return classify_kinds(files, "file_id", "relative_path", "language", "source_text", model)

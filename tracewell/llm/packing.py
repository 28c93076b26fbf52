"""Items of varying length into containers of fixed capacity."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import written

#: Vocabulary of a public byte-level BPE as ranks, one token and its rank a line.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary divides a text before merging (part of the public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 2048
#: Open bins of a task: its memory and, at most, its bins that end up unfilled.
OPEN_BINS = 256
#: Neighbouring tasks whose unfilled bins are packed together.
MERGED = 64


class BestFit:
    """Bounded-space online best fit.

    At most `open_bins` bins are open. `mask` has bit f set where an open bin
    has f units free, so the tightest bin for an item of size s is the lowest
    set bit from s on. Where none fits and all are open, the fullest is closed.
    """

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.mask, self.n_open, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}
        #: Bins closed since the caller last looked.
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        name = held.pop()
        if not held:
            del self.by_free[free]
            self.mask &= ~(1 << free)
        self.n_open -= 1
        return name

    def put(self, size: int) -> int:
        """The bin of an item of `size` <= capacity."""
        fitting = self.mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            name = self._take(free)
        else:
            if self.n_open == self.open_bins:
                self.closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
            free, name = self.capacity, self.made
            self.made += 1
        if free == size:  # a full bin closes at once
            self.closed.append(name)
        else:
            self.by_free.setdefault(free - size, []).append(name)
            self.mask |= 1 << (free - size)
            self.n_open += 1
        return name


def _encoder(path: str):
    import tiktoken

    if not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer at {path}")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack_documents(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tokenizer: str = TOKENIZER) -> DataFrame:
    """The container of each document, or of each piece of one longer than a container.

    Every input partition packs its own rows as they stream by, without a
    shuffle. The bins that are still open at its end are packed again, whole,
    together with those of its neighbours (see `_merged`), so that many small
    partitions waste no space. A longer document is cut into pieces of
    `capacity` tokens and a rest; no other is split. A null or empty text has 0
    tokens and joins the container that was closed last (or one that is open, or a new
    one). Repeated rows are packed as often as they occur. Returns the key,
    piece_no, first_token, n_tokens and container_id.
    """
    kind = docs.schema[key].dataType.simpleString()
    # Alone in memory a very long text costs about its own size in tokens; batches are kept small for that.

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer).encode_ordinary
        bins, task = BestFit(capacity, open_bins), TaskContext.get().partitionId()
        held: dict[int, list[tuple]] = {}  # rows of open bins
        last = None
        for pdf in batches:
            rows: list[tuple] = []
            for name, body in zip(pdf["k"], pdf["t"]):
                size = len(encode(body)) if isinstance(body, str) else 0
                if not size and last is not None:
                    rows.append((name, 0, 0, 0, last, False))
                    continue
                piece = 0
                while size - piece * capacity > capacity:
                    rows.append((name, piece, piece * capacity, capacity, bins.made, False))
                    bins.made += 1
                    piece += 1
                rest = size - piece * capacity
                place = bins.put(rest)
                held.setdefault(place, []).append((name, piece, piece * capacity, rest, place, False))
                for last in bins.closed:
                    rows += held.pop(last)
                bins.closed.clear()
                if not size and len(held[place]) >= 2 * capacity:  # nothing but empty texts so far
                    rows += held[place]
                    held[place] = []
                    last = place
            yield _frame(rows, task)
        yield _frame([(*row[:-1], row[4] != last) for kept in held.values() for row in kept], task)

    schema = f"k {kind}, piece_no long, first_token long, n_tokens long, container_id string, task int, open boolean"
    packed = written(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInPandas(pack, schema))
    columns = ["k", "piece_no", "first_token", "n_tokens", "container_id"]
    whole = packed.where(~F.col("open")).select(*columns)
    return whole.unionByName(_merged(packed.where("open"), columns, capacity)).withColumnRenamed("k", key)


def _frame(rows: list[tuple], task: int) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["k", "piece_no", "first_token", "n_tokens", "c", "open"])
    out["container_id"] = f"{task}-" + out["c"].astype(str)
    out["task"] = task
    return out[["k", "piece_no", "first_token", "n_tokens", "container_id", "task", "open"]]


def _merged(rows: DataFrame, columns: list[str], capacity: int) -> DataFrame:
    """Bins left open by MERGED tasks packed into containers, the fullest first, none divided.

    A group holds MERGED times OPEN_BINS bins at most.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        used = pdf.groupby("container_id")["n_tokens"].sum().reset_index().sort_values(["n_tokens", "container_id"], ascending=[False, True])
        bins = BestFit(capacity, len(used))
        where = {name: bins.put(int(size)) for name, size in zip(used["container_id"], used["n_tokens"])}
        group = int(pdf["g"].iloc[0])
        pdf["container_id"] = [f"m{group}-{where[c]}" for c in pdf["container_id"]]
        return pdf[columns]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in columns)
    return rows.withColumn("g", F.floor(F.col("task") / MERGED)).groupBy("g").applyInPandas(merge, schema)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_pieces, n_tokens, n_containers, least_containers (by volume) and fill."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").alias("n_pieces"),
        F.sum("t").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_containers"),
        F.ceil(F.sum("t") / capacity).alias("least_containers"),
        F.max("t").alias("most_tokens"),
        (F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("fill"),
    )

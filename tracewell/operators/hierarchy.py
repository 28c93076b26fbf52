"""Parent-child links to full hierarchies: path, depth, root, descendants, cycles.

1. Ids of a tree are cut into blocks of 2^BLOCK_BITS. A block is bounded by what it
   is, whatever the tree, so one task may hold it. Within a block splitters are chosen
   by a hash of the node, every node walks to its next splitter, the reduced graph of
   splitters is solved by pointer doubling, and walks without splitters that never end
   are found apart: they are cycles.
2. Where a parent lies in another block, the node below it is an exit. Exits with the
   walks between them are a smaller pointer graph. Where there are any, they are
   solved over the cluster in the same way: splitters by hash (and parents of very many
   children), walks doubled from splitter to splitter, the reduced graph solved alike.
3. Paths are expanded: the path of the exit, then the walk within the block.

A tree is never gathered in one task: each step is a join on node keys or a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import skew
from tracewell.operators.skew import skew_join
from tracewell.session import written

#: One of so many nodes is a splitter.
SPLIT = 8
#: A parent of more children than this is made a splitter, so that no walk waits on it.
WIDE = 10_000
#: Ids of a tree that differ in no higher bit than this are walked in one task: 65,536 nodes at most.
BLOCK_BITS = 16
#: Nodes of whole blocks that a task solves at once, at least; ids of paths that it holds at once.
TOGETHER, HELD_IDS = 50_000, 2_000_000
OK, CYCLE, BELOW = "ok", "cycle", "below_cycle"


def latest_rows(rows: DataFrame, keys: list[str], at: str, carried: list[str]) -> DataFrame:
    """The row of each key with the latest `at`; ties go to the greatest carried values."""
    newest = F.max(F.struct(F.col(at).alias("_at"), *[F.col(c) for c in carried]))
    return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in carried])


def solve_hierarchy(rows: DataFrame, tree: list[str], node: str, parent: str) -> DataFrame:
    """Path, depth, root and cycle status of every node.

    One row per (tree, node) is expected (see `latest_rows`); ids are whole
    numbers. A node whose parent is null or does not occur in its tree is a
    root of depth 0. Rows without id (or with one that is no whole number) or
    tree are no nodes. Returns tree, node, root, depth, path (array from the root to the node) and status: `ok`,
    `cycle` (its own ancestor) or `below_cycle`; for the latter two root and
    depth are null and path is empty. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    return _solved(rows, tree, node, parent).drop("n_descendants")


def _solved(rows: DataFrame, tree: list[str], node: str, parent: str) -> DataFrame:
    """`solve_hierarchy` with n_descendants (null where no root is reached).

    Trees are named by two 64-bit hashes while walks are followed, so that the
    rounds move numbers only; their own columns travel along and are never joined back.
    """
    own = [f"_c{i}" for i in range(len(tree))]
    flat = rows.select(*[F.col(t).alias(n) for t, n in zip(tree, own)], F.col(node).try_cast("long").alias("id"), F.col(parent).try_cast("long").alias("par")).dropna(subset=[*own, "id"])
    flat = flat.select(F.xxhash64(*own).alias("_t0"), F.xxhash64(F.lit(7), *own).alias("_t1"), *own, "id", "par")
    local = written(_within_blocks(flat, own))
    nodes, links = local.where("kind = 0"), local.where("kind = 1")
    solved = nodes if links.isEmpty() else _across_blocks(nodes, links, own)
    good = F.col("status") == OK
    return solved.select(
        *[F.col(n).alias(t) for t, n in zip(tree, own)],
        F.col("id").alias(node),
        F.when(good, F.element_at("path", 1)).alias("root"),
        F.when(good, (F.size("path") - 1).cast("long")).alias("depth"),
        F.when(good, F.col("path")).otherwise(F.array().cast("array<bigint>")).alias("path"),
        "status",
        F.when(good, F.col("n_below")).alias("n_descendants"),
    )


# within blocks


def _within_blocks(flat: DataFrame, own: list[str]) -> DataFrame:
    """Every node walked as far as its block reaches.

    Rows of kind 0 are nodes: `path` leads from `top` (a root, or the exit of the
    block, whose parent `par` is elsewhere) down to the node, `n_below` counts the nodes
    below it in its block. Rows of kind 1 answer which parents in other blocks
    exist: (tree, id) and the same walk of that parent. Each is asked once, however many children it has.
    """
    bits = BLOCK_BITS
    block = lambda c: F.shiftright(c, bits)
    same = block(F.col("par")) == block(F.col("id"))
    kept = F.lit((1 << bits) - 1)
    nodes = flat.select(
        "_t0", "_t1", *own, "id", F.when(~same, F.col("par")).alias("par"), block(F.col("id")).alias("block"), F.lit(False).alias("asked"),
        F.col("id").bitwiseAND(kept).cast("int").alias("off"), F.coalesce(F.when(same, F.col("par").bitwiseAND(kept).cast("int")), F.lit(-1)).alias("up"),
    )
    far = flat.where(~same).select("_t0", "_t1", F.col("par").alias("id")).distinct()
    asks = far.select("_t0", "_t1", *[F.lit(None).cast(flat.schema[c].dataType).alias(c) for c in own], "id", F.lit(None).cast("long").alias("par"), block(F.col("id")).alias("block"), F.lit(True).alias("asked"), F.col("id").bitwiseAND(kept).cast("int").alias("off"), F.lit(-1).alias("up"))
    placed = nodes.unionByName(asks).repartition("_t0", "_t1", "block").sortWithinPartitions("_t0", "_t1", "block", "asked", "off")
    types = ", ".join(f"{c} {flat.schema[c].dataType.simpleString()}" for c in own)
    schema = f"_t0 long, _t1 long, {types}, id long, par long, kind int, top long, path array<long>, status string, n_below long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            yield from _solve_blocks(table, own, bits)

    return placed.mapInArrow(run, schema)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches joined and cut again where a block ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            table = pa.Table.from_batches(held)
            changes = np.flatnonzero(_starts(table))
            if len(changes) > 1:
                yield table.slice(0, int(changes[-1]))
                table = table.slice(int(changes[-1]))
            held = table.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table) -> np.ndarray:
    """Where a row begins a block."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in ("_t0", "_t1", "block"):
        v = table.column(name).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _solve_blocks(table: pa.Table, own: list[str], bits: int) -> Iterator[pa.RecordBatch]:
    group = np.cumsum(_starts(table)).astype(np.int64)
    asked = table.column("asked").to_numpy(zero_copy_only=False)
    off, up = table.column("off").to_numpy().astype(np.int64), table.column("up").to_numpy().astype(np.int64)
    node = np.flatnonzero(~asked)
    keys = group[node] << bits | off[node]  # ascending, since rows are sorted
    ids = table.column("id").to_numpy()[node]
    parent = _find(keys, np.where(up[node] >= 0, group[node] << bits | up[node], -1))
    with np.errstate(over="ignore"):
        mark = (table.column("_t0").to_numpy()[node] ^ ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    top, depth, status = _walk_blocks(parent, mark % np.uint64(SPLIT) == 0)
    below = _count_below(parent, depth)
    plain = table.take(pa.array(node)).combine_chunks()
    yield from _emit(plain, own, 0, np.arange(len(node)), ids, parent, top, depth, status, below)
    asks = np.flatnonzero(asked)
    place = _find(keys, group[asks] << bits | off[asks])
    there = place >= 0
    if there.any():
        yield from _emit(table.take(pa.array(asks[there])).combine_chunks(), own, 1, place[there], ids, parent, top, depth, status, below)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of `wanted` among ascending keys; -1 where they are not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, place, -1)


def _walk_blocks(parent: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(top, depth below it, status) of each node, from places of parents (-1: none in the block).

    `split` marks the splitters; each node walks to the next splitter or to its top; the splitters are
    solved by doubling; what then has no top is on or below a cycle.
    """
    n = len(parent)
    all_ = np.arange(n)
    ends = split | (parent < 0)
    # Where a walk stands and how many steps it took; a splitter's own walk begins at its parent.
    at, steps = np.where(parent >= 0, parent, all_), (parent >= 0).astype(np.int64)
    going = np.flatnonzero(~ends[at])
    for _ in range(64 * SPLIT):
        if not len(going):
            break
        at[going] = parent[at[going]]
        steps[going] += 1
        going = going[~ends[at[going]]]
    # The reduced graph: splitters and tops, and what walked on without meeting either.
    reduced = np.unique(np.concatenate([np.flatnonzero(ends), going]))
    jump, hops = at.copy(), steps.copy()
    moving = reduced[parent[jump[reduced]] >= 0]
    for _ in range(max(1, n).bit_length() + 1):
        if not len(moving):
            break
        hops[moving] += hops[jump[moving]]
        jump[moving] = jump[jump[moving]]
        moving = moving[parent[jump[moving]] >= 0]
    rest = np.setdiff1d(all_, reduced, assume_unique=True)
    top, depth = jump.copy(), hops.copy()
    top[rest], depth[rest] = jump[at[rest]], steps[rest] + hops[at[rest]]
    lost = np.flatnonzero(parent[top] >= 0) if n else all_
    status = np.zeros(n, np.int8)
    if len(lost):
        # On a cycle is what still has a child after every lost leaf is taken away.
        status[lost] = 2
        children = np.bincount(parent[lost], minlength=n)
        bare = lost[children[lost] == 0]
        on = np.zeros(n, bool)
        on[lost] = True
        while len(bare):
            on[bare] = False
            np.subtract.at(children, parent[bare], 1)
            above = np.unique(parent[bare])
            bare = above[on[above] & (children[above] == 0)]
        status[on] = 1
        top[lost], depth[lost] = lost, 0
    return top, depth, status


def _count_below(parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Nodes below each node: the deepest are added to their parents first."""
    below = np.zeros(len(parent), np.int64)
    order = np.argsort(-depth, kind="stable")
    order = order[depth[order] > 0]
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts) if len(order) else []:
        np.add.at(below, parent[level], below[level] + 1)
    return below


def _emit(plain: pa.Table, own: list[str], kind: int, place: np.ndarray, ids, parent, top, depth, status, below) -> Iterator[pa.RecordBatch]:
    """Rows with their paths expanded, no more than HELD_IDS ids of paths at once."""
    size = np.where(status[place] == 0, depth[place] + 1, 0)
    total = np.cumsum(size)
    start = 0
    while start < len(place):
        base = int(total[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + HELD_IDS, "right")))
        here, n = place[start:stop], size[start:stop]
        ends = np.cumsum(n)
        values = np.empty(int(ends[-1]), np.int64)
        # From each node up to its top, the path is filled from its end.
        going = np.flatnonzero(n > 0)
        at, to = here[going], ends[going] - 1
        left = n[going]
        while len(at):
            values[to] = ids[at]
            more = left > 1
            at, to, left = parent[at[more]], to[more] - 1, left[more] - 1
        part = plain.slice(start, stop - start)
        paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))
        names = pa.array(np.array([OK, CYCLE, BELOW], dtype=object)[status[here]], pa.string())
        columns = {c: part.column(c).combine_chunks() for c in ("_t0", "_t1", *own, "id", "par")}
        columns |= {"kind": pa.array(np.full(len(here), kind, np.int32)), "top": pa.array(ids[top[here]]), "path": paths, "status": names, "n_below": pa.array(below[here])}
        yield pa.RecordBatch.from_pydict({k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for k, v in columns.items()})
        start = stop


# across blocks


def _across_blocks(nodes: DataFrame, links: DataFrame, own: list[str]) -> DataFrame:
    """`nodes` with the walks of their blocks joined: paths from the root, and everything below counted."""
    tree = ["_t0", "_t1"]
    exits = nodes.where("par is not null and status = 'ok' and id = top").select(*tree, "id", "par", (F.col("n_below") + 1).alias("size"))
    above = links.select(*tree, F.col("id").alias("par"), F.col("top").alias("_top"), F.col("path").alias("_way"), F.col("status").alias("_status"))
    led = written(skew_join(exits, above, [*tree, "par"], F.col("id")))  # exits whose parent exists
    solved = written(_expand(_walked(_begin(led, tree), tree), tree))
    good = solved.where("status = 'ok'")
    # The walks of nodes below an exit follow the path of the exit.
    on_exit = skew_join(nodes, solved.select(*tree, F.col("id").alias("top"), F.col("path").alias("_head"), F.col("status").alias("_exit_status")), [*tree, "top"], F.col("id"), "left")
    whole = F.when(F.col("_head").isNull() | (F.col("status") != OK), F.col("path")).otherwise(F.concat("_head", F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))))
    ring = solved.where("status = 'cycle'").select(*tree, "id").unionByName(_ring_within(led, solved, tree)).distinct().withColumn("_ring", F.lit(True))
    lost = F.coalesce(F.col("_exit_status") != OK, F.lit(False)) & (F.col("status") == OK)
    state = F.when(lost & F.col("_ring"), CYCLE).when(lost, BELOW).otherwise(F.col("status"))
    joined = on_exit.join(ring, [*tree, "id"], "left").select(*tree, *own, "id", F.when(lost, F.array().cast("array<bigint>")).otherwise(whole).alias("path"), state.alias("status"), "n_below")
    # Each exit adds the nodes of its block to all above it.
    adds = good.join(led.select(*tree, "id", "size"), [*tree, "id"]).where("depth > 0")
    more = adds.select(*tree, F.explode(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("id"), "size").groupBy(*tree, "id").agg(F.sum("size").alias("_more"))
    counted = joined.join(more, [*tree, "id"], "left")
    return counted.withColumn("n_below", F.col("n_below") + F.coalesce("_more", F.lit(0)))


def _ring_within(led: DataFrame, solved: DataFrame, tree: list[str]) -> DataFrame:
    """Nodes of blocks that lie between two exits of a cycle."""
    on = solved.where("status = 'cycle'").select(*tree, "id")
    return led.join(on, [*tree, "id"], "left_semi").select(*tree, F.explode("_way").alias("id"))


def _begin(led: DataFrame, tree: list[str]) -> DataFrame:
    """Walks of one step from exit to exit: (tree, id, ptr, seg, split, kid, open, looped).

    `ptr` is the exit where the walk stands, null past a root; `seg` what it passed, from
    there down to the exit itself; `kid` whether others lead to it. An exit
    whose parent is on or below a cycle of its block ends as looped.
    """
    kids = led.groupBy(*tree, F.col("_top").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    marked = led.join(kids, [*tree, "id"], "left")
    split = (F.coalesce("n", F.lit(0)) > WIDE) | (F.pmod(F.xxhash64(*tree, "id"), F.lit(SPLIT)) == 0)
    marked = marked.select(*tree, "id", "_top", "_way", "_status", split.alias("split"), F.col("n").isNotNull().alias("kid"))
    above = marked.where("kid").select(*tree, F.col("id").alias("_top"), F.col("split").alias("_split"))
    linked = skew_join(marked, above, [*tree, "_top"], F.col("id"), "left", kids.withColumnRenamed("id", "_top"))
    lost, exists = F.col("_status") != OK, F.col("_split").isNotNull()
    way = F.when(lost, F.array().cast("array<bigint>")).when(exists, F.slice("_way", F.lit(2), F.size("_way") - 1)).otherwise(F.col("_way"))
    return linked.select(*tree, "id", F.when(exists & ~lost, F.col("_top")).alias("ptr"), F.concat(way, F.array("id")).alias("seg"), "split", "kid", (exists & ~lost & ~F.col("_split")).alias("open"), lost.alias("looped"))


def _walked(state: DataFrame, tree: list[str]) -> DataFrame:
    """`state` with every open walk followed to its end, each round doubling the steps taken.

    Only nodes with children are ever stood on, so only they are looked up.

    An open walk stands on a node that has a walk of its own, which it takes
    over. A walk that passed a node twice is closed as looped.
    """
    state, ended = written(state), []
    while n := (going := state.where("open")).count():
        ahead = state if not ended else state.unionByName(_all(ended))
        ahead = ahead.where("kid").select(*tree, F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("seg").alias("_seg"), F.col("open").alias("_open"), F.col("looped").alias("_looped"))
        # So few walks that no key can be hot need no salting.
        moved = skew_join(going, ahead, [*tree, "ptr"], F.col("id")) if n > skew.HOT_ROWS else going.join(ahead, [*tree, "ptr"])
        seg = F.concat("_seg", "seg")
        looped = F.col("_looped") | (F.size(F.array_distinct(seg)) < F.size(seg))
        ended.append(state.where(~F.col("open")))
        state = written(moved.select(*tree, "id", F.col("_ptr").alias("ptr"), seg.alias("seg"), "split", "kid", (F.col("_open") & ~looped).alias("open"), looped.alias("looped")))
    return _all([*ended, state])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _expand(walks: DataFrame, tree: list[str]) -> DataFrame:
    """The reduced graph of splitters solved, and every node's path from it."""
    key = [*tree, "id"]
    reduced = walks.where("split").withColumn("open", F.col("ptr").isNotNull() & ~F.col("looped"))
    splitters = written(_walked(reduced, tree))
    tops = splitters.select(*tree, F.col("id").alias("ptr"), F.when(~F.col("looped"), F.col("seg")).alias("_above"))
    rest = walks.where(~F.col("split"))
    standing = skew_join(rest.where(F.col("ptr").isNotNull() & ~F.col("looped")), tops, [*tree, "ptr"], F.col("id"))
    good = _all(
        [
            splitters.where(~F.col("looped")).select(*key, F.col("seg").alias("path")),
            rest.where(F.col("ptr").isNull() & ~F.col("looped")).select(*key, F.col("seg").alias("path")),
            standing.where(F.col("_above").isNotNull()).select(*key, F.concat("_above", "seg").alias("path")),
        ]
    )
    # On a cycle: who meets itself on its own walk, and what lies between splitters that do.
    back = F.col("looped") & F.array_contains(F.slice("seg", F.lit(1), F.size("seg") - 1), F.col("id"))
    between = walks.where("split").join(splitters.where(back).select(*key), key, "left_semi").select(*tree, F.explode("seg").alias("id"))
    ring = rest.where(back).select(*key).unionByName(between).distinct().withColumn("_ring", F.lit(True))
    lost = _all(
        [
            splitters.where("looped").select(*key),
            rest.where("looped").select(*key),
            standing.where(F.col("_above").isNull()).select(*key),
        ]
    ).join(ring, key, "left")
    none = F.lit(None).cast("long")
    return good.select(*key, F.element_at("path", 1).alias("root"), (F.size("path") - 1).cast("long").alias("depth"), "path", F.lit("ok").alias("status")).unionByName(
        lost.select(*key, none.alias("root"), none.alias("depth"), F.array().cast("array<bigint>").alias("path"), F.when(F.col("_ring"), "cycle").otherwise("below_cycle").alias("status"))
    )


def descendants(solved: DataFrame, tree: list[str], node: str) -> DataFrame:
    """(tree, ancestor, node) for each node and each of its ancestors, itself left out."""
    return solved.where("depth > 0").select(*tree, F.explode(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("ancestor"), F.col(node))


def with_descendant_counts(solved: DataFrame, tree: list[str], node: str) -> DataFrame:
    """`solved` with n_descendants: all nodes below, null where no root is reached."""
    below = descendants(solved, tree, node).groupBy(*tree, "ancestor").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("ancestor", node)
    counted = solved.join(below, [*tree, node], "left")
    return counted.withColumn("n_descendants", F.when(F.col("status") == "ok", F.coalesce("_n", F.lit(0)))).drop("_n")


def scope_hierarchy(scopes: DataFrame) -> DataFrame:
    """Every scope with its root, depth, path, descendants and status (-1 and '' where no root is reached)."""
    tree = ["repository_id", "relative_path"]
    newest = latest_rows(scopes, [*tree, "scope_id"], "ingested_at", ["parent_scope_id"])
    counted = _solved(newest, tree, "scope_id", "parent_scope_id")
    return counted.select(
        *tree,
        "scope_id",
        F.coalesce("root", F.lit(-1)).alias("root_scope_id"),
        F.coalesce("depth", F.lit(-1)).alias("scope_depth"),
        F.array_join(F.col("path").cast("array<string>"), "/").alias("scope_path"),
        F.coalesce("n_descendants", F.lit(-1)).alias("n_descendants"),
        "status",
    )


def scope_descendants(scopes: DataFrame) -> DataFrame:
    """Every scope with each scope below it: repository_id, relative_path, ancestor_id, scope_id. Only trees with a root."""
    tree = ["repository_id", "relative_path"]
    newest = latest_rows(scopes, [*tree, "scope_id"], "ingested_at", ["parent_scope_id"])
    below = descendants(solve_hierarchy(newest, tree, "scope_id", "parent_scope_id"), tree, "scope_id")
    return below.select(*tree, F.col("ancestor").alias("ancestor_id"), "scope_id")

"""Containment, ownership and resolution joins. Each has an equi key, so none is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import identifiers as I


def span_length(c: str) -> Column:
    return F.col(f"{c}.byte_end") - F.col(f"{c}.byte_start")


def _level(span: str) -> Column:
    """The level of the smallest aligned power-of-two block that holds a span.

    A span lies within another only if its block lies within the other's, so the
    owners of a span are found in the blocks around its own: an equi join, whose
    pairs are few even where one file holds a large part of all rows.
    """
    cross = F.col(f"{span}.byte_start").bitwiseXOR(F.col(f"{span}.byte_end"))
    return F.when(cross == 0, 0).otherwise(F.length(F.bin(cross))).cast("int")


def _own_block(df: DataFrame, span: str) -> DataFrame:
    return df.withColumn("_level", _level(span)).withColumn("_bin", F.expr(f"shiftright({span}.byte_start, _level)"))


def _blocks_around(df: DataFrame, span: str, top: Column) -> DataFrame:
    """A row for each block from the span's own up to level `top`."""
    b = df.withColumn("_from", _level(span)).withColumn("_level", F.explode(F.sequence("_from", F.greatest("_from", top))))
    return b.withColumn("_bin", F.expr(f"shiftright({span}.byte_start, _level)")).drop("_from")


def held_pairs(inner: DataFrame, outer: DataFrame, keys: list[str], inner_span: str, outer_span: str) -> DataFrame:
    """Pairs whose outer span holds the inner one, ends included, within equal keys.

    Spans are byte offsets from 0; null spans hold nothing.
    """
    valid = lambda df, s: df.where(F.col(f"{s}.byte_start").isNotNull() & F.col(f"{s}.byte_end").isNotNull())
    placed = _own_block(valid(outer, outer_span), outer_span)
    top = placed.agg(F.coalesce(F.max("_level"), F.lit(0))).scalar()
    around = _blocks_around(valid(inner, inner_span), inner_span, top)
    return around.join(placed, [*keys, "_level", "_bin"]).where(I.range_contains(outer_span, inner_span)).drop("_level", "_bin")


def innermost_owner(inner: DataFrame, owners: DataFrame, file_keys: list[str], inner_id: str, owner_id: str) -> DataFrame:
    """The smallest owner whose span holds each inner span of the same file: (file keys, inner id, owner id).

    Both have a `span`. Of equal spans the smaller id owns. Spans that nothing holds have no row.
    """
    i = inner.select(*file_keys, F.col(inner_id).alias("_i"), F.col("span").alias("_is"))
    o = owners.select(*file_keys, F.col(owner_id).alias("_o"), F.col("span").alias("_os"))
    held = held_pairs(i, o, file_keys, "_is", "_os")
    best = F.min(F.struct(span_length("_os").alias("n"), F.col("_o").alias("o")))
    return held.groupBy(*file_keys, F.col("_i").alias(inner_id)).agg(best.getField("o").alias("owner_id"))


def nesting_depth(spans: DataFrame, file_keys: list[str], id_: str) -> DataFrame:
    """Of each span, how many other spans of its file hold it: (file keys, id, n_holders)."""
    a = spans.select(*file_keys, F.col(id_).alias("_a"), F.col("span").alias("_as"))
    b = spans.select(*file_keys, F.col(id_).alias("_b"), F.col("span").alias("_bs"))
    held = held_pairs(a, b, file_keys, "_as", "_bs").where(F.col("_a") != F.col("_b"))
    n = held.groupBy(*file_keys, F.col("_a").alias(id_)).agg(F.count(F.lit(1)).alias("n_holders"))
    return spans.select(*file_keys, id_).join(n, [*file_keys, id_], "left").withColumn("n_holders", F.coalesce("n_holders", F.lit(0)))


def nearest_ancestor(paths: DataFrame, roots: DataFrame, group: list[str], path: str, root: str) -> DataFrame:
    """The longest folder of `roots` that holds each path, by exploding its ancestors: (group, path, root)."""
    up = paths.select(*group, path, F.explode(I.ancestors(F.col(path))).alias(root))
    met = up.join(roots.select(*group, root).distinct(), [*group, root])
    longest = F.max(F.struct(F.length(root).alias("n"), F.col(root).alias("r")))
    return met.groupBy(*group, path).agg(longest.getField("r").alias(root))


def covering_binding(uses: DataFrame, bindings: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The binding that covers each use and was introduced last: an as-of join within a file and name.

    `bindings`: keys, binding_id, byte_start, byte_end (half open). Columns of
    `uses` and binding_id, null where nothing covers.
    """
    row = uses.withColumn("_u", F.monotonically_increasing_id()) if "use_id" not in uses.columns else uses.withColumn("_u", F.col("use_id"))
    met = row.select(*keys, "_u", position).join(bindings, keys).where((F.col("byte_start") <= F.col(position)) & (F.col(position) < F.col("byte_end")))
    last = met.groupBy("_u").agg(F.max(F.struct("byte_start", "binding_id")).getField("binding_id").alias("binding_id"))
    return row.join(last, "_u", "left").drop("_u")


def project_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per target of each link whose both ends are nodes; dangling ends are dropped.

    The source is the node of the file the link starts in, the target the node
    of the entity or declaration. Columns: link_id, link_kind, source, target.
    """
    files = nodes.where("node_kind = 'file'").select("repository_id", F.col("relative_path").alias("_p"), F.col("node_id").alias("source"))
    key = (
        F.when(F.col("t.entity_id").isNotNull(), F.concat(F.lit("ent:"), F.lower(F.trim("t.entity_id"))))
        .when(F.col("t.declaration_id").isNotNull(), F.concat(F.lit("decl:"), F.col("t.relative_path"), F.lit("#"), F.col("t.declaration_id").cast("string")))
        .otherwise(F.concat(F.lit("file:"), F.col("t.relative_path")))
    )
    spread = links.select("repository_id", "link_id", "link_kind", F.col("origin.relative_path").alias("_p"), F.explode("targets").alias("t")).select("repository_id", "link_id", "link_kind", "_p", key.alias("node_key"))
    return (
        spread.join(files, ["repository_id", "_p"])
        .join(nodes.select("repository_id", "node_key", F.col("node_id").alias("target")), ["repository_id", "node_key"])
        .select("link_id", "link_kind", "source", "target")
        .distinct()
    )


def incremental_snapshot(current: DataFrame, previous: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """reused, changed, added or deleted per key; reused where all of `same` are equal (nulls equal)."""
    c = current.select(*keys, *[F.col(x).alias(f"c_{x}") for x in same], F.lit(True).alias("_c"))
    p = previous.select(*keys, *[F.col(x).alias(f"p_{x}") for x in same], F.lit(True).alias("_p"))
    equal = F.lit(True)
    for x in same:
        equal = equal & F.col(f"c_{x}").eqNullSafe(F.col(f"p_{x}"))
    state = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "deleted").when(equal, "reused").otherwise("changed")
    return c.join(p, keys, "full_outer").select(*keys, state.alias("state"))


def range_union(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or adjacent whole-number ranges of a key merged: gaps and islands.

    Equal ranges of a key are aggregated before they are sorted.
    """
    flat = ranges.where(F.col(start) <= F.col(end)).groupBy(*keys, start).agg(F.max(end).alias(end))
    order = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = flat.withColumn("_new", (F.coalesce(F.col(start) > reach + 1, F.lit(True))).cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def subset_match(recipes: DataFrame, queries: DataFrame) -> DataFrame:
    """Recipes (recipe_id, terms) whose terms all occur in a query (query_id, terms): (query_id, recipe_id).

    By counting shared terms over an inverted index, not by comparing all pairs.
    """
    r = recipes.select("recipe_id", F.size(F.array_distinct("terms")).alias("n"), F.explode(F.array_distinct("terms")).alias("term"))
    q = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    met = r.join(q, "term").groupBy("query_id", "recipe_id", "n").agg(F.count(F.lit(1)).alias("m"))
    return met.where("m = n").select("query_id", "recipe_id")

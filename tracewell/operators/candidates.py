"""Call candidates by rule, from facts: whom a call may mean, ambiguity kept.

Every rule gives repository_id, relative_path, fact_id, name, rule_id, outcome,
candidates (`path#declaration`) and reason. 0, 1 and n candidates are different
outcomes; out_of_scope is what a rule does not judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import identifiers as I
from tracewell.operators import joins, links

KEYS = ["repository_id", "relative_path"]


def NONE() -> Column:  # noqa: N802
    return F.array().cast("array<string>")


def _target() -> Column:
    return F.concat_ws("#", "relative_path", F.col("fact_id").cast("string"))


def _record(df: DataFrame, rule: Column | str, out: Column | None = None, reason: Column | str | None = None) -> DataFrame:
    """Records from candidates in `_t`: canonical, with the outcome of their number; `out` marks what is out of scope."""
    rule = F.lit(rule) if isinstance(rule, str) else rule
    reason = F.lit(reason).cast("string") if not isinstance(reason, Column) else reason
    out = F.lit(False) if out is None else F.coalesce(out, F.lit(False))
    t = F.when(out, NONE()).otherwise(F.array_sort(F.array_distinct(F.coalesce("_t", NONE()))))
    n = F.size(t)
    outcome = F.when(out, "out_of_scope").when(n == 0, "no_candidate").when(n == 1, "single_candidate").otherwise("multiple_candidates")
    why = F.when(n == 0, F.coalesce(reason, F.lit("no_such_function")))
    return df.select(*KEYS, "fact_id", "name", rule.alias("rule_id"), outcome.alias("outcome"), t.alias("candidates"), why.alias("reason"))


def _bound(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """`calls` with `_bound`: whether a local name covers the place of the call."""
    b = facts.where("fact_kind = 'binding'").select(*KEYS, "name", F.col("fact_id").alias("binding_id"), "byte_start", "byte_end")
    uses = calls.withColumnRenamed("byte_start", "_at").drop("byte_end").withColumn("use_id", F.concat_ws("|", *KEYS, F.col("fact_id").cast("string")))
    return joins.covering_binding(uses, b, [*KEYS, "name"], "_at").withColumn("_bound", F.col("binding_id").isNotNull()).drop("binding_id", "use_id", "_at")


def go_package_calls(facts: DataFrame) -> DataFrame:
    """Plain Go calls to the functions of the package (the folder).

    None where a local name covers the call, the file has a dot import or an
    import of that name, or another declaration of the package shares the name.
    """
    go = facts.where(F.col("relative_path").endswith(".go"))
    place = I.directory(F.col("relative_path"))
    calls = _bound(go.where("fact_kind = 'call' and kind = 'plain'"), go).withColumn("_place", place)
    # A common name is gathered once a package, before its calls meet it.
    pool = go.where("fact_kind = 'declaration' and chain = ''").groupBy("repository_id", place.alias("_place"), "name").agg(
        F.collect_set(F.when(F.col("kind") == "function", _target())).alias("_fns"), F.max(~F.col("kind").isin("function", "method")).alias("_mixed")
    )
    imports = go.where("fact_kind = 'import'")
    dots = imports.where("target = '.'").select(*KEYS).distinct().withColumn("_dot", F.lit(True))
    named = imports.select(*KEYS, F.when(F.col("target") != "", F.col("target")).otherwise(F.substring_index("name", "/", -1)).alias("name")).distinct().withColumn("_import", F.lit(True))
    j = calls.join(pool, ["repository_id", "_place", "name"], "left").join(dots, KEYS, "left").join(named, [*KEYS, "name"], "left")
    blocked = F.when(F.col("_bound"), "blocked_by_local_binding").when(F.col("_dot"), "blocked_by_dot_import").when(F.col("_import"), "blocked_by_import_name").when(F.col("_mixed"), "mixed_namespace")
    return _record(j.withColumn("_t", F.when(blocked.isNull(), F.col("_fns"))), "go.call.package_local_function_candidate", None, blocked)


def go_imported_calls(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """`pkg.Func` calls: out of scope unless pkg is an import of the repository's module; then its exported functions.

    None where a local name covers pkg, or another declaration of the package shares the name.
    """
    go = facts.where(F.col("relative_path").endswith(".go"))
    operand, func = I.go_selector(F.col("name"))
    calls = go.where("fact_kind = 'call' and kind = 'member'").withColumn("_pkg", operand).withColumn("_f", func)
    plain = calls.select(*KEYS, "fact_id", F.col("_pkg").alias("name"), "byte_start", "byte_end")
    covered = _bound(plain.where("name <> ''"), go).where("_bound").select(*KEYS, "fact_id", "_bound")
    imports = go.where("fact_kind = 'import'").select(*KEYS, F.col("fact_id").alias("_i"), F.when(F.col("target") != "", F.col("target")).otherwise(F.substring_index("name", "/", -1)).alias("_pkg"))
    to = links.go_imports(facts, modules).select(*KEYS, F.col("fact_id").alias("_i"), F.col("outcome").alias("_o"), F.explode_outer("targets").alias("_to"))
    pool = go.where("fact_kind = 'declaration' and chain = ''").groupBy("repository_id", I.directory(F.col("relative_path")).alias("_dir"), F.col("name").alias("_f")).agg(
        F.collect_set(F.when(F.col("kind") == "function", _target())).alias("_fns"), F.max(~F.col("kind").isin("function", "method")).alias("_mixed")
    )
    met = calls.join(imports, [*KEYS, "_pkg"], "left").join(to, [*KEYS, "_i"], "left").withColumn("_dir", F.substring_index("_to", ":", 1)).join(pool, ["repository_id", "_dir", "_f"], "left")
    usable = I.go_exported(F.col("_f")) & ~F.coalesce("_mixed", F.lit(False))
    per = met.groupBy(*KEYS, "fact_id", "name").agg(
        F.max(F.col("_i").isNotNull() & (F.col("_o") != "out_of_scope")).alias("_in"),
        F.flatten(F.collect_list(F.when(usable, F.coalesce("_fns", NONE())).otherwise(NONE()))).alias("_t"),
        F.first(F.when(~I.go_exported(F.col("_f")), "not_exported").when(F.col("_mixed"), "mixed_namespace"), True).alias("_why"),
    )
    per = per.join(covered, [*KEYS, "fact_id"], "left").withColumn("_t", F.when(F.col("_bound"), NONE()).otherwise(F.col("_t")))
    why = F.when(~F.coalesce("_in", F.lit(False)), "not_of_the_repository").when(F.col("_bound"), "blocked_by_local_binding").otherwise(F.col("_why"))
    return _record(per, "go.call.imported_package_function_candidate", ~F.coalesce("_in", F.lit(False)), why)


def rust_local_calls(facts: DataFrame, uses: DataFrame) -> DataFrame:
    """Plain Rust calls by level, from the blocks around the call up to its module.

    A local name that covers the call ends the search. At each level a function
    counts before a constant or static, which ends it too, and that before an
    import; an import leads to the functions among the targets of its link. `uses`: links of `links.rust_use_paths`.
    """
    rs = facts.where(F.col("relative_path").endswith(".rs"))
    calls = _bound(rs.where("fact_kind = 'call' and kind = 'plain'"), rs)
    parts = F.when(F.col("chain") == "", NONE()).otherwise(F.split("chain", ">"))
    # The innermost module around the call is the last level.
    last = F.coalesce(F.array_max(F.transform(parts, lambda b, i: F.when(b.startswith("mod:"), i + 1))), F.lit(0))
    levels = F.transform(F.sequence(F.size(parts), last, F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ">"))
    at = calls.select(*KEYS, "fact_id", "name", F.posexplode(levels).alias("_level", "chain"))
    fns = rs.where("fact_kind = 'declaration' and kind in ('function', 'constant', 'static')").select(*KEYS, "chain", "name", F.when(F.col("kind") == "function", 0).otherwise(1).alias("_rank"), _target().alias("_to"))
    whole = F.concat_ws("#", F.col("relative_path"), F.col("fact_id").cast("string"))
    functions = rs.where("fact_kind = 'declaration' and kind = 'function'").select("repository_id", whole.alias("_fn")).distinct()
    led = uses.select(*KEYS, F.col("fact_id").alias("_i"), F.explode("targets").alias("_fn")).join(functions, ["repository_id", "_fn"])
    imports = rs.where("fact_kind = 'import' and target <> ''").select(*KEYS, "chain", F.col("target").alias("name"), F.col("fact_id").alias("_i"))
    brought = imports.join(led, [*KEYS, "_i"], "left").select(*KEYS, "chain", "name", F.lit(2).alias("_rank"), F.col("_fn").alias("_to"))
    met = at.join(fns.unionByName(brought), [*KEYS, "chain", "name"]).groupBy(*KEYS, "fact_id", "_level", "_rank").agg(F.collect_set("_to").alias("_to"))
    best = met.groupBy(*KEYS, "fact_id").agg(F.min(F.struct("_level", "_rank", "_to")).alias("_b"))
    j = calls.join(best, [*KEYS, "fact_id"], "left")
    open_ = ~F.col("_bound") & F.col("_b._rank").isin(0, 2)
    why = F.when(F.col("_bound"), "blocked_by_local_binding").when(F.col("_b._rank") == 1, "blocked_by_local_constant").when(F.col("_b._rank") == 2, "import_leads_to_no_function")
    rule = F.when(~F.col("_bound") & (F.col("_b._rank") == 2), "rust.call.imported_function_candidate").otherwise("rust.call.local_function_candidate")
    return _record(j.withColumn("_t", F.when(open_, F.col("_b._to"))), rule, None, why)


def rust_path_calls(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Calls by a path: from crate, self or super, or from a child module of the call's own module.

    The path is followed in each crate of the file. Another root is out of
    scope; a root that an import of the file or a local name shadows has none.
    """
    rs = facts.where(F.col("relative_path").endswith(".rs"))
    calls = rs.where("fact_kind = 'call' and kind = 'static'")
    root_, rest = F.substring_index("name", "::", 1), F.regexp_replace("name", r"^[^:]+::", "")
    modules = links.rust_modules(facts, files)
    items = links.rust_items(facts, modules)
    known = items.where("kind = 'module'").select("repository_id", "root", F.col("module").alias("_own"), F.col("name").alias("_first")).distinct().withColumn("_child", F.lit(True))
    here = calls.join(modules, KEYS).withColumn("_own", links._below(F.col("module"), links.inline_modules(F.col("chain")))).withColumn("_first", root_).join(known, ["repository_id", "root", "_own", "_first"], "left")
    up = F.regexp_replace("_own", r"(?:^|::)[^:]+$", "")
    full = (
        F.when(F.col("_first") == "crate", rest)
        .when(F.col("_first") == "self", links._below(F.col("_own"), rest))
        .when((F.col("_first") == "super") & (F.col("_own") != ""), links._below(up, rest))
        .when(F.col("_child"), links._below(F.col("_own"), F.col("name")))
    )
    here = here.withColumn("_full", full)
    way = here.where("_full is not null").select(*KEYS, "fact_id", "root", F.regexp_replace("_full", r"(?:^|::)[^:]+$", "").alias("module"), F.regexp_extract("_full", r"([^:]+)$", 1).alias("_f"))
    fns = items.where("kind = 'function'").select("repository_id", "root", "module", F.col("name").alias("_f"), _target().alias("_to"))
    found = way.join(fns, ["repository_id", "root", "module", "_f"]).groupBy(*KEYS, "fact_id").agg(F.collect_set("_to").alias("_t"))
    judged = here.groupBy(*KEYS, "fact_id").agg(F.max(F.col("_full").isNotNull()).alias("_in"))
    names = rs.where("fact_kind = 'import' and target <> ''").select(*KEYS, F.col("target").alias("_first")).distinct().withColumn("_shadow", F.lit(True))
    rooted = calls.withColumn("_first", root_).join(names, [*KEYS, "_first"], "left").join(judged, [*KEYS, "fact_id"], "left").join(found, [*KEYS, "fact_id"], "left")
    shadow = F.coalesce("_shadow", F.lit(False)) & ~F.col("_first").isin("crate", "self", "super")
    why = F.when(shadow, "root_is_shadowed").when(~F.coalesce("_in", F.lit(False)), "root_is_not_proven")
    return _record(rooted.withColumn("_t", F.when(~shadow, F.col("_t"))), "rust.call.structural_path_function_candidate", ~F.coalesce("_in", F.lit(False)) & ~shadow, why)


def php_function_calls(facts: DataFrame) -> DataFrame:
    """Plain PHP calls by tiers: the imported function, else one of the namespace, else a global one.

    The first tier with a function of that full name (without regard to case)
    wins, and all its functions are candidates. An import whose function is not
    there ends the search.
    """
    keys = ["repository_id", "relative_path"]
    php = facts.where(F.col("relative_path").endswith(".php"))
    space = php.where("fact_kind = 'declaration' and kind = 'namespace'").groupBy(*keys).agg(F.min_by("name", "byte_start").alias("_ns"))
    qualified = F.lower(F.when(F.col("_ns").isNull(), F.col("name")).otherwise(F.concat("_ns", F.lit("\\"), "name")))
    functions = php.where("fact_kind = 'declaration' and kind = 'function'").join(space, keys, "left").groupBy("repository_id", qualified.alias("_f")).agg(F.sort_array(F.collect_set(F.concat_ws("#", "relative_path", F.col("fact_id").cast("string")))).alias("_fns"))
    imports = php.where("fact_kind = 'import' and kind = 'function'").select(*keys, F.lower("target").alias("_alias"), F.lower("name").alias("_full")).dropDuplicates([*keys, "_alias"])
    plain = php.where("fact_kind = 'call' and kind = 'plain'")
    dynamic = _record(plain.where(F.col("name").startswith("$")).withColumn("_t", NONE()), "php.call.namespace_function_candidate", F.lit(True), "dynamic")
    calls = plain.where(~F.col("name").startswith("$")).join(space, keys, "left").withColumn("_alias", F.lower("name")).join(imports, [*keys, "_alias"], "left")
    bare = F.lower(F.regexp_replace("name", r"^\\", ""))
    ways = F.when(F.col("_full").isNotNull(), F.array("_full")).when(F.col("name").startswith("\\") | F.col("_ns").isNull(), F.array(bare)).otherwise(F.array(F.lower(F.concat("_ns", F.lit("\\"), "name")), bare))
    tiers = calls.select(*keys, "fact_id", "name", F.col("_full").isNotNull().alias("_imported"), F.posexplode(ways).alias("_tier", "_f")).join(functions, ["repository_id", "_f"], "left")
    best = tiers.groupBy(*keys, "fact_id", "name", "_imported").agg(F.min(F.when(F.col("_fns").isNotNull(), F.struct(F.col("_tier").alias("t"), F.col("_fns").alias("c")))).alias("_b"))
    return dynamic.unionByName(_record(best.withColumn("_t", F.coalesce("_b.c", NONE())), F.when(F.col("_imported"), "php.call.imported_function_candidate").otherwise("php.call.namespace_function_candidate")))


def php_classes(facts: DataFrame) -> DataFrame:
    """(repository_id, relative_path, fact_id, class, label, fqn) of class-likes: `class` is `path#declaration`, fqn in lower case."""
    d = facts.where("fact_kind = 'declaration'").where(F.col("relative_path").endswith(".php") & F.col("kind").isin("class", "interface", "trait", "enum"))
    return d.select(*KEYS, "fact_id", F.col("name").alias("label"), _target().alias("class")).join(links.php_names(facts).select(*KEYS, "fact_id", F.lower("fqn").alias("fqn")), [*KEYS, "fact_id"])


def php_parents(facts: DataFrame) -> DataFrame:
    """(repository_id, class, parent, how): resolved extends and traits of classes, as `path#declaration`."""
    refs = facts.where("fact_kind = 'reference' and kind in ('extends', 'uses_trait')").where(F.col("relative_path").endswith(".php")).select(*KEYS, "fact_id", F.col("target").alias("label"), F.col("kind").alias("how"))
    led = links.php_hierarchy(facts).select(*KEYS, "fact_id", F.explode("targets").alias("parent"))
    classes = php_classes(facts).select(*KEYS, "label", "class")
    return refs.join(led, [*KEYS, "fact_id"]).join(classes, [*KEYS, "label"]).select("repository_id", "class", "parent", "how").distinct()


def php_member_calls(facts: DataFrame) -> DataFrame:
    """`new X`, `X::m`, `self::m`, `parent::m`, `$this->m` and `$x->m` by the classes they may mean.

    Constructions lead to classes, the others to the methods of the nearest
    level from the class up its ancestors; private methods count at level 0 only. `static`
    and what is not known statically are out of scope: a variable's classes
    follow from its hint or the constructions given to it before, with no opaque write since.
    """
    php = facts.where(F.col("relative_path").endswith(".php"))
    calls = php.where("fact_kind = 'call' and kind in ('construct', 'static', 'member')").withColumnRenamed("kind", "_how")
    named = F.when(F.col("_how") == "construct", F.regexp_replace("name", r"^new\s+", "")).when(F.col("_how") == "static", F.regexp_extract("name", r"^(.*)::[^:]*$", 1)).otherwise(F.regexp_extract("name", r"^(.*)(?:->)[^>]*$", 1))
    method = F.when(F.col("_how") != "construct", F.lower(F.regexp_extract("name", r"(\w+)$", 1)))
    low = F.lower("_class")
    rule = (
        F.when((F.col("_how") == "construct") & (low == "parent"), "php.call.parent_construction_candidate")
        .when(F.col("_how") == "construct", "php.call.construction_class_candidate")
        .when((F.col("_how") == "static") & (low == "parent"), "php.call.parent_method_candidate")
        .when((F.col("_how") == "static") & (low == "self"), "php.call.lexical_self_method_candidate")
        .when(F.col("_how") == "static", "php.call.static_method_candidate")
        .when(F.col("_class") == "$this", "php.call.lexical_this_method_candidate")
        .otherwise("php.call.typed_receiver_method_candidate")
    )
    around = F.regexp_extract("chain", r"^(?:.*>)?class:(\w*)", 1)
    calls = calls.withColumn("_class", named).withColumn("_method", method).withColumn("_rule", rule).withColumn("_around", around)
    own = [*KEYS, "fact_id", "name", "_how", "_method", "_rule"]
    classes = php_classes(facts)
    lexical = calls.join(classes.select(*KEYS, F.col("label").alias("_around"), F.col("class").alias("_lexical")), [*KEYS, "_around"], "left")
    parents = php_parents(facts)
    inside = lexical.where(low.isin("self", "$this")).select(*own, F.col("_lexical").alias("class"))
    up = parents.where("how = 'extends'").select("repository_id", F.col("class").alias("_lexical"), F.col("parent").alias("class"))
    above = lexical.where(low == "parent").join(up, ["repository_id", "_lexical"], "left").select(*own, "class")
    # Written names, by the namespace and aliases of the file.
    space = php.where("fact_kind = 'declaration' and kind = 'namespace'").groupBy(*KEYS).agg(F.min_by("name", "byte_start").alias("_ns"))
    alias = php.where("fact_kind = 'import' and kind = 'class'").groupBy(*KEYS).agg(F.map_from_entries(F.collect_set(F.struct(F.lower("target"), "name"))).alias("_al"))
    full = lambda c: F.lower(I.php_class_fqn(c, F.col("_ns"), F.coalesce("_al", F.create_map().cast("map<string,string>"))))
    by_name = classes.select("repository_id", "fqn", "class")
    written = calls.where((F.col("_how") != "member") & ~low.isin("self", "parent", "static", "") & ~F.col("_class").startswith("$"))
    direct = written.join(space, KEYS, "left").join(alias, KEYS, "left").withColumn("fqn", full(F.col("_class"))).join(by_name, ["repository_id", "fqn"], "left").select(*own, "class")
    # Receivers: within one function, in order of the writes.
    receivers = calls.where((F.col("_how") == "member") & F.col("_class").rlike(r"^\$\w+$") & (F.col("_class") != "$this"))
    place = F.concat_ws("|", "chain", F.col("_v"))
    writes = php.where("fact_kind = 'write'").join(space, KEYS, "left").join(alias, KEYS, "left").withColumn("_v", F.col("name"))
    hints = F.when(F.col("kind") == "new", F.array("target")).when(F.col("kind") == "hint", I.php_hint_classes(F.col("target"))).otherwise(NONE())
    writes = writes.withColumn("_c", F.explode(F.when(F.size(hints) > 0, hints).otherwise(F.array(F.lit(None).cast("string")))))
    writes = writes.select(*KEYS, place.alias("receiver"), F.col("byte_start").alias("at"), F.when(F.col("_c").isNotNull(), full(F.col("_c"))).alias("class"))
    asked = receivers.withColumn("_v", F.col("_class")).select(F.concat_ws("|", *KEYS, F.col("fact_id").cast("string")).alias("call_id"), *KEYS, place.alias("receiver"), F.col("byte_start").alias("at"))
    typed = links.php_typed_receivers(asked, writes).where("classes is not null")
    held = receivers.withColumn("call_id", F.concat_ws("|", *KEYS, F.col("fact_id").cast("string"))).join(typed, "call_id").select(*own, F.explode("classes").alias("fqn")).join(by_name, ["repository_id", "fqn"], "left").select(*own, "class")
    met = inside.unionByName(above).unionByName(direct).unionByName(held)
    # Methods of the nearest level.
    methods = php.where("fact_kind = 'declaration' and kind = 'method'").join(classes.select(*KEYS, F.col("label").alias("scope"), "class"), [*KEYS, "scope"])
    methods = methods.select("repository_id", F.col("class").alias("owner"), F.lower("name").alias("method"), (F.col("target") == "private").alias("is_private"), _target().alias("_to"))
    at = lambda c: F.concat_ws("|", "repository_id", c)
    levels = links.inheritance_levels(parents.select(at(F.col("class")).alias("class"), at(F.col("parent")).alias("parent")).distinct())
    nearest = links.nearest_methods(levels, methods.select(at(F.col("owner")).alias("owner"), "method", "is_private").distinct())
    targets = methods.select(at(F.col("owner")).alias("owner"), F.col("method"), "_to")
    reach = nearest.join(targets, ["owner", "method"]).select(F.col("class").alias("_at"), F.col("method").alias("_method"), "level", "_to")
    called = met.where("_how <> 'construct'").withColumn("_at", at(F.col("class"))).join(reach, ["_at", "_method"], "left")
    fact = [c for c in own if c not in ("_how", "_method")]
    per = called.groupBy(*fact).agg(F.collect_set("_to").alias("_t"), F.coalesce(F.min("level"), F.lit(0)).alias("_level"), F.max(F.col("class").isNotNull()).alias("_known"))
    built = met.where("_how = 'construct'").groupBy(*fact).agg(F.collect_set("class").alias("_t"), F.lit(0).alias("_level"), F.max(F.col("class").isNotNull()).alias("_known"))
    done = per.unionByName(built)
    found_above = (F.col("_level") > 0) & (F.size("_t") > 0)
    in_scope = _record(done, F.when(found_above, "php.call.inherited_method_candidate").otherwise(F.col("_rule")), None, F.when(F.col("_known"), "no_such_method").otherwise("no_such_class"))
    rest = calls.join(done.select(*KEYS, "fact_id").distinct(), [*KEYS, "fact_id"], "left_anti").withColumn("_t", NONE())
    return in_scope.unionByName(_record(rest, F.col("_rule"), F.lit(True), "not_known_statically"))


def all_candidates(facts: DataFrame, files: DataFrame, go_modules: DataFrame) -> DataFrame:
    """The records of every rule."""
    parts = [go_package_calls(facts), go_imported_calls(facts, go_modules), rust_local_calls(facts, links.rust_use_paths(facts, files)), rust_path_calls(facts, files), php_function_calls(facts), php_member_calls(facts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

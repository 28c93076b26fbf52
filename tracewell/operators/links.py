"""Import and hierarchy links between files, by rule. Ambiguity is kept: 0, 1 and n targets are different outcomes.

Inputs are facts (repository_id, relative_path, fact_kind, kind, name, target,
level) and the files they come from. Every rule is an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import identifiers as I

OUT = ["repository_id", "relative_path", "fact_id", "rule_id", "outcome", "targets"]


def _record(df: DataFrame, rule: Column | str, targets: Column, exact: bool = True, none: str = "unresolved") -> DataFrame:
    """Links with their outcome from the number of distinct targets."""
    t = F.array_sort(F.array_distinct(targets))
    outcome = F.when(F.size(t) == 0, none).when((F.size(t) == 1) & F.lit(exact), "exact").otherwise("ambiguous")
    return df.select("repository_id", "relative_path", "fact_id", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), outcome.alias("outcome"), t.alias("targets"))


def _matched(sources: DataFrame, options: DataFrame, keys: list[str], target: str) -> DataFrame:
    """`sources` with the set of targets their candidates meet; an empty set where none does."""
    own = ["repository_id", "relative_path", "fact_id"]
    met = sources.select(*own, F.explode("_options").alias("_option")).join(options, keys)
    sets = met.groupBy(*own).agg(F.collect_set(target).alias("_t"))
    return sources.join(sets, own, "left").withColumn("_t", F.coalesce("_t", F.array().cast("array<string>")))


def python_relative_imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """`from .a import b`: the file or package a below the base folder; `from . import b`: the module b, or the package that declares b.

    Unresolved at the root and above it, where there is no package.
    """
    i = facts.where("fact_kind = 'import' and kind = 'from' and level > 0")
    base = I.relative_base(I.directory(F.col("relative_path")), F.col("level"))
    whole = F.col("name") != ""
    stem = I.join_dir(base, F.when(whole, F.translate("name", ".", "/")).otherwise(F.col("target")))
    module = F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))
    ways = F.when(whole, module).otherwise(F.concat(module, F.array(F.concat(I.join_dir(base, F.lit("__init__.py")), F.lit("#"), "target"))))
    i = i.withColumn("_options", F.when(base.isNull(), F.array().cast("array<string>")).otherwise(ways))
    there = files.select("repository_id", F.col("relative_path").alias("_option"), F.col("relative_path").alias("_target")).distinct()
    own = facts.where(F.col("relative_path").endswith("__init__.py") & (F.col("scope") == ""))
    declared = own.where("fact_kind = 'declaration'").select("repository_id", F.concat_ws("#", "relative_path", "name").alias("_option"), F.col("relative_path").alias("_target"))
    return _record(_matched(i, there.unionByName(declared.distinct()), ["repository_id", "_option"], "_target"), "python.relative_import.package_path", F.col("_t"))


def python_absolute_imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """An absolute import that a file of the repository could serve is ambiguous, never exact; others are out of scope."""
    i = facts.where("fact_kind = 'import' and level = 0 and kind in ('import', 'from')").where(F.col("relative_path").endswith(".py"))
    stem = F.translate("name", ".", "/")
    i = i.withColumn("_options", F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py"))))
    there = files.select("repository_id", F.col("relative_path").alias("_option"), F.col("relative_path").alias("_target")).distinct()
    m = _matched(i, there, ["repository_id", "_option"], "_target")
    rule = F.when(F.size("_t") > 0, "python.absolute_import.local_candidate").otherwise("python.absolute_import.external")
    return _record(m, rule, F.col("_t"), exact=False, none="out_of_scope")


def rust_module_files(facts: DataFrame, files: DataFrame) -> DataFrame:
    """`mod n;` is `n.rs` or `n/mod.rs` in the folder of the module's children."""
    m = facts.where("fact_kind = 'declaration' and kind = 'module'").where(F.col("relative_path").endswith(".rs"))
    d = I.rust_module_dir(F.col("relative_path"))
    m = m.withColumn("_options", F.array(I.join_dir(d, F.concat("name", F.lit(".rs"))), I.join_dir(d, F.concat("name", F.lit("/mod.rs")))))
    there = files.select("repository_id", F.col("relative_path").alias("_option"), F.col("relative_path").alias("_target")).distinct()
    return _record(_matched(m, there, ["repository_id", "_option"], "_target"), "rust.mod.standard_file", F.col("_t"))


def rust_module_path(path: Column, root: Column) -> Column:
    """The module of a file in the crate of `root`: below the root's folder `a/b.rs` is a::b, `a/mod.rs` a, the root itself empty."""
    folder = I.directory(root)
    inner = F.when(folder == "", path).otherwise(F.expr("substring(relative_path, length(regexp_extract(root, '^(.*)/[^/]*$', 1)) + 2)"))
    plain = F.regexp_replace(F.regexp_replace(inner, r"\.rs$", ""), r"(^|/)mod$", "")
    return F.when(path == root, "").otherwise(F.replace(plain, F.lit("/"), F.lit("::")))


def inline_modules(chain: Column) -> Column:
    """The modules of a file that a chain of blocks lies in: `mod:a>mod:b>fn:c` is a::b."""
    mods = F.filter(F.split(chain, ">"), lambda b: b.startswith("mod:"))
    return F.array_join(F.transform(mods, lambda b: F.substring(b, 5, 1_000_000)), "::")


def _below(outer: Column, inner: Column) -> Column:
    return F.when(inner == "", outer).when(outer == "", inner).otherwise(F.concat_ws("::", outer, inner))


def rust_modules(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, root, relative_path, module): the crates a file belongs to and its module in each.

    A file belongs to the crates whose roots reach it by `mod` declarations: several, one or none.
    """
    tree = rust_crate_tree(facts, files)
    return tree.select("repository_id", "root", "relative_path", rust_module_path(F.col("relative_path"), F.col("root")).alias("module"))


def rust_items(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """(repository_id, root, module, name, relative_path, fact_id, kind) of what stands directly in a module of a crate."""
    d = facts.where("fact_kind = 'declaration'").where(F.col("relative_path").endswith(".rs") & ((F.col("chain") == "") | ~F.col("chain").rlike(r"(^|>)(?!mod:)")))
    j = d.join(modules, ["repository_id", "relative_path"])
    return j.select("repository_id", "root", _below(F.col("module"), inline_modules(F.col("chain"))).alias("module"), "name", "relative_path", "fact_id", "kind")


def rust_use_paths(facts: DataFrame, files: DataFrame) -> DataFrame:
    """`use crate::a::B`: the declaration B of module a, or the module a::B, in each crate of the file; `crate::a::*` the file of a.

    Unresolved in a file that no crate root reaches; other roots are out of scope.
    """
    u = facts.where("fact_kind = 'import' and kind = 'use'")
    crate = (F.col("name") == "crate") | F.col("name").startswith("crate::")
    modules = rust_modules(facts, files)
    full = F.regexp_replace("name", r"^crate(::)?", "")
    glob = (full == "*") | full.endswith("::*")
    last, module = F.regexp_extract(full, r"([^:]+)$", 1), F.regexp_replace(full, r"(?:^|::)[^:]+$", "")
    roots = modules.select("repository_id", "relative_path", "root")
    owned = u.where(crate & (full != "")).join(roots, ["repository_id", "relative_path"], "left")
    at = lambda kind, text: F.concat("root", F.lit("|" + kind + ":"), text)
    ways = F.when(F.col("root").isNull(), F.array().cast("array<string>")).when(glob, F.array(at("m", module))).otherwise(F.array(at("m", full), at("d", F.concat(module, F.lit("#"), last))))
    keys = ["repository_id", "relative_path", "fact_id"]
    inside = u.where(crate).join(owned.groupBy(*keys).agg(F.flatten(F.collect_list(ways)).alias("_options")), keys, "left")
    inside = inside.withColumn("_options", F.coalesce("_options", F.array().cast("array<string>")))
    blocks = facts.where(F.col("relative_path").endswith(".rs") & F.col("chain").contains("mod:")).select("repository_id", "relative_path", inline_modules(F.col("chain")).alias("_inner")).distinct()
    inner = blocks.join(modules, ["repository_id", "relative_path"]).select("repository_id", "root", "relative_path", _below(F.col("module"), F.col("_inner")).alias("module"))
    mods = modules.unionByName(inner, allowMissingColumns=True).select("repository_id", at("m", F.col("module")).alias("_option"), F.col("relative_path").alias("_target"))
    decls = rust_items(facts, modules).where("kind <> 'module'").select("repository_id", at("d", F.concat_ws("#", "module", "name")).alias("_option"), F.concat_ws("#", "relative_path", F.col("fact_id").cast("string")).alias("_target"))
    hit = _record(_matched(inside, mods.unionByName(decls).distinct(), ["repository_id", "_option"], "_target"), "rust.use.crate_path", F.col("_t"))
    return hit.unionByName(_record(u.where(~crate), "rust.use.non_crate_path", F.array().cast("array<string>"), none="out_of_scope"))


def go_imports(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """An import under a module of the repository is the package of that folder; others are out of scope.

    `modules`: (repository_id, module, root). One package name in the folder is
    exact, several are ambiguous, none is unresolved.
    """
    i = facts.where("fact_kind = 'import' and kind = 'import'").where(F.col("relative_path").endswith(".go"))
    p = facts.where("fact_kind = 'declaration' and kind = 'package'")
    packages = p.select("repository_id", I.directory(F.col("relative_path")).alias("_dir"), F.regexp_replace("name", "_test$", "").alias("_pkg")).distinct()
    ways = i.select("*", F.explode(I.ancestors(F.concat(F.col("name"), F.lit("/x")))).alias("module")).join(modules, ["repository_id", "module"])
    own = ["repository_id", "relative_path", "fact_id"]
    nearest = ways.groupBy(*own, "name").agg(F.max(F.struct(F.length("module").alias("n"), F.col("module").alias("m"), F.col("root").alias("r"))).alias("b"))
    rest = F.expr("substring(name, b.n + 2)")
    folder = F.when(rest == "", F.col("b.r")).when(F.col("b.r") == "", rest).otherwise(F.concat_ws("/", F.col("b.r"), rest))
    local = nearest.withColumn("_options", F.array(folder))
    options = packages.select("repository_id", F.col("_dir").alias("_option"), F.concat_ws(":", "_dir", "_pkg").alias("_target"))
    hit = _record(_matched(local, options, ["repository_id", "_option"], "_target"), "go.import.local_module", F.col("_t"))
    outside = i.join(nearest.select(*own), own, "left_anti")
    return hit.unionByName(_record(outside, "go.import.external", F.array().cast("array<string>"), none="out_of_scope"))


def go_packages(facts: DataFrame) -> DataFrame:
    """Package membership: exact where a folder has one package name, else ambiguous."""
    p = facts.where("fact_kind = 'declaration' and kind = 'package'").withColumn("_dir", I.directory(F.col("relative_path")))
    names = p.groupBy("repository_id", "_dir").agg(F.collect_set("name").alias("_t"))
    return _record(p.join(names, ["repository_id", "_dir"]), "go.package.same_directory", F.col("_t"))


def php_names(facts: DataFrame) -> DataFrame:
    """(repository_id, fqn, relative_path, fact_id) of class-likes: the namespace of their file and their name."""
    php = facts.where(F.col("relative_path").endswith(".php") & (F.col("fact_kind") == "declaration"))
    space = php.where("kind = 'namespace'").groupBy("repository_id", "relative_path").agg(F.min_by("name", "byte_start").alias("_ns"))
    kinds = php.where(F.col("kind").isin("class", "interface", "trait", "enum"))
    own = F.when(F.col("_ns").isNull(), F.col("name")).otherwise(F.concat("_ns", F.lit("\\"), "name"))
    return kinds.join(space, ["repository_id", "relative_path"], "left").select("repository_id", own.alias("fqn"), "relative_path", "fact_id")


def php_uses(facts: DataFrame) -> DataFrame:
    """`use A\\B`: by full name; unresolved if only its namespace is declared, else external; functions and constants are out of scope."""
    u = facts.where(F.col("relative_path").endswith(".php") & (F.col("fact_kind") == "import"))
    names = php_names(facts)
    classes = u.where("kind = 'class'").withColumn("_options", F.array(F.lower("name")))
    options = names.select("repository_id", F.lower("fqn").alias("_option"), F.concat_ws("#", "relative_path", F.col("fact_id").cast("string")).alias("_target"))
    m = _matched(classes, options, ["repository_id", "_option"], "_target")
    spaces = facts.where("fact_kind = 'declaration' and kind = 'namespace'").select("repository_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\\"))), lambda n: F.lower(F.array_join(F.slice(F.split("name", r"\\"), F.lit(1), n), "\\")))).alias("_prefix")).distinct()
    parent = F.lower(F.regexp_extract("name", r"^(.*)\\[^\\]*$", 1))
    m = m.withColumn("_prefix", parent).join(spaces.withColumn("_local", F.lit(True)), ["repository_id", "_prefix"], "left")
    found = (F.size("_t") > 0) | F.coalesce("_local", F.lit(False))
    hit = _record(m.where(found), "php.use.qualified_name", F.col("_t"))
    out = _record(m.where(~found), "php.use.external", F.col("_t"), none="out_of_scope")
    other = _record(u.where("kind <> 'class'"), "php.use.non_class_import", F.array().cast("array<string>"), none="out_of_scope")
    return hit.unionByName(out).unionByName(other)


def php_namespaces(facts: DataFrame) -> DataFrame:
    """Class-likes by full name: exact where it is distinct, ambiguous where repeated."""
    n = php_names(facts)
    same = n.groupBy("repository_id", F.lower("fqn").alias("_f")).agg(F.collect_set(F.concat_ws("#", "relative_path", F.col("fact_id").cast("string"))).alias("_t"))
    return _record(n.withColumn("_f", F.lower("fqn")).join(same, ["repository_id", "_f"]), "php.namespace.declaration", F.col("_t"))


def inheritance_levels(parents: DataFrame, bound: int | None = None) -> DataFrame:
    """(class, ancestor, level): every ancestor at its least level, safe against cycles.

    `parents`: (class, parent). One join a level until nothing new comes; `bound` ends earlier.
    """
    from tracewell.session import written

    reached = written(parents.select("class", F.col("parent").alias("ancestor")).distinct().withColumn("level", F.lit(1)))
    frontier, level = reached, 1
    while bound is None or level < bound:
        level += 1
        step = frontier.select("class", F.col("ancestor").alias("_at")).join(parents.select(F.col("class").alias("_at"), F.col("parent").alias("ancestor")), "_at").select("class", "ancestor").distinct()
        frontier = written(step.join(reached, ["class", "ancestor"], "left_anti").where("class <> ancestor").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def nearest_methods(levels: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, method, owner, level): the first level with a hit wins; private methods count at level 0 only.

    `methods`: (owner, method, is_private).
    """
    own = methods.select(F.col("owner").alias("class"), "method", "owner", F.lit(0).alias("level"))
    above = levels.join(methods.where(~F.col("is_private")), levels.ancestor == methods.owner).select("class", "method", "owner", "level")
    all_ = own.unionByName(above)
    best = all_.groupBy("class", "method").agg(F.min("level").alias("level"))
    return all_.join(best, ["class", "method", "level"])


def php_hierarchy(facts: DataFrame) -> DataFrame:
    """`extends`, `implements` and traits: the written name by the file's aliases and namespace, without regard to case."""
    php = facts.where(F.col("relative_path").endswith(".php"))
    keys = ["repository_id", "relative_path"]
    refs = php.where("fact_kind = 'reference'").withColumnRenamed("kind", "_how")
    space = php.where("fact_kind = 'declaration' and kind = 'namespace'").groupBy(*keys).agg(F.min_by("name", "byte_start").alias("_ns"))
    alias = php.where("fact_kind = 'import' and kind = 'class'").groupBy(*keys).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.lower("target"), "name")))).alias("_al"))
    none = F.create_map().cast("map<string,string>")
    r = refs.join(space, keys, "left").join(alias, keys, "left")
    r = r.withColumn("_options", F.array(F.lower(I.php_class_fqn(F.col("name"), F.col("_ns"), F.coalesce("_al", none)))))
    options = php_names(facts).select("repository_id", F.lower("fqn").alias("_option"), F.concat_ws("#", "relative_path", F.col("fact_id").cast("string")).alias("_target"))
    return _record(_matched(r, options, ["repository_id", "_option"], "_target"), F.concat(F.lit("php.class."), F.col("_how")), F.col("_t"))


def rust_crate_tree(facts: DataFrame, files: DataFrame, depth: int = 1 << 20) -> DataFrame:
    """(repository_id, root, relative_path, depth): the files that `mod` declarations reach from each crate root; the search ends where nothing new comes."""
    from tracewell.operators.graph import bounded_search

    step = rust_module_files(facts, files).where("size(targets) > 0")
    key = lambda p: F.concat_ws("|", "repository_id", p)
    edges = step.select("repository_id", "relative_path", F.explode("targets").alias("t")).select(key(F.col("relative_path")).alias("source"), key(F.col("t")).alias("target"))
    roots = files.where(F.col("relative_path").rlike(r"(^|/)(lib|main)\.rs$")).select(key(F.col("relative_path")).alias("node_id"))
    part = lambda c, i: F.split(c, r"\|").getItem(i)
    return bounded_search(edges, roots, depth, None).select(part(F.col("seed"), 0).alias("repository_id"), part(F.col("seed"), 1).alias("root"), part(F.col("node_id"), 1).alias("relative_path"), "depth")


def php_typed_receivers(calls: DataFrame, writes: DataFrame) -> DataFrame:
    """Classes a receiver may hold at each call: (call_id, classes), null after an opaque write.

    `calls`: call_id, repository_id, relative_path, receiver, at; `writes`:
    repository_id, relative_path, receiver, at, class (null for an opaque write).
    Only writes before the call count, from the last opaque one on; if that is
    the last write of all, the class is unknown.
    """
    keys = ["repository_id", "relative_path", "receiver"]
    met = calls.join(writes.select(*keys, F.col("at").alias("_w"), "class"), keys).where(F.col("_w") < F.col("at"))
    last = met.groupBy("call_id").agg(F.max(F.when(F.col("class").isNull(), F.col("_w"))).alias("_opaque"))
    known = met.join(last, "call_id").where(F.col("class").isNotNull() & (F.col("_opaque").isNull() | (F.col("_w") > F.col("_opaque"))))
    per = known.groupBy("call_id").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    return calls.select("call_id").join(per, "call_id", "left")


def shadowed_roots(uses: DataFrame, blockers: DataFrame) -> DataFrame:
    """Uses of a path whose first segment no binding or import of its place shadows.

    `uses`: (repository_id, relative_path, scope_id, root, ...); `blockers`:
    (repository_id, relative_path, scope_id, name).
    """
    b = blockers.select("repository_id", "relative_path", "scope_id", F.col("name").alias("root")).distinct()
    return uses.join(b, ["repository_id", "relative_path", "scope_id", "root"], "left_anti")


def closure_reach(chains: DataFrame, scopes: DataFrame, through: list[str]) -> DataFrame:
    """Scope pairs (scope_id, outer_id, level) between which only scopes of the kinds `through` (closures, blocks) lie.

    A binding of the outer scope reaches the inner one; a function between the two ends its reach.
    """
    keys = ["repository_id", "relative_path"]
    kinds = scopes.select(*keys, F.col("scope_id").alias("outer_id"), F.col("scope_kind").isin(through).alias("_open")).distinct()
    marked = chains.join(kinds, [*keys, "outer_id"], "left")
    # The first level whose scope is not passed through is still reached; nothing beyond it is.
    stop = marked.where(~F.coalesce("_open", F.lit(False))).groupBy(*keys, "scope_id").agg(F.min("level").alias("_stop"))
    return marked.join(stop, [*keys, "scope_id"], "left").where(F.col("_stop").isNull() | (F.col("level") <= F.col("_stop"))).select(*keys, "scope_id", "outer_id", "level")


def crate_targets(files: DataFrame, cargo: DataFrame) -> DataFrame:
    """(manifest, kind, name, path): targets of each package, declared or by the usual places.

    `files`: relative_path; `cargo`: facts of `cargo_facts`. lib is src/lib.rs,
    bin src/main.rs and src/bin/*.rs, test, example and bench are the files of
    their folders; a declared path replaces the usual place.
    """
    packages = cargo.where("fact = 'package'").select(F.col("relative_path").alias("manifest"), F.col("name").alias("package"), I.directory(F.col("relative_path")).alias("dir"))
    rs = files.where(F.col("relative_path").endswith(".rs")).select("relative_path").distinct()
    up = rs.select("relative_path", F.explode(I.ancestors(F.col("relative_path"))).alias("dir")).join(packages, "dir")
    rest = F.when(F.col("dir") == "", F.col("relative_path")).otherwise(F.expr("substring(relative_path, length(dir) + 2)"))
    kind = (
        F.when(rest == "src/lib.rs", "lib")
        .when((rest == "src/main.rs") | rest.rlike(r"^src/bin/[^/]+(\.rs|/main\.rs)$"), "bin")
        .when(rest.rlike(r"^tests/[^/]+\.rs$"), "test")
        .when(rest.rlike(r"^examples/[^/]+\.rs$"), "example")
        .when(rest.rlike(r"^benches/[^/]+\.rs$"), "bench")
    )
    stem = F.regexp_replace(F.regexp_replace(F.col("relative_path"), r"/main\.rs$", ""), r"^.*/|\.rs$", "")
    usual = up.withColumn("kind", kind).where("kind is not null").select("manifest", "kind", F.when(rest.isin("src/lib.rs", "src/main.rs"), F.col("package")).otherwise(stem).alias("name"), F.col("relative_path").alias("path"))
    said = cargo.where(F.col("fact").startswith("target:") & (F.col("value") != "")).join(packages, cargo.relative_path == packages.manifest)
    declared = said.select("manifest", F.expr("substring(fact, 8)").alias("kind"), "name", I.join_dir(F.col("dir"), F.col("value")).alias("path"))
    kept = usual.join(declared.select("manifest", "path").distinct(), ["manifest", "path"], "left_anti").join(declared.select("manifest", "kind", "name").distinct(), ["manifest", "kind", "name"], "left_anti")
    return kept.select("manifest", "kind", "name", "path").unionByName(declared).distinct()


#: What each rule links or calls, and its possible outcomes.
RULES = {
    "rust.mod.standard_file": "a module declaration to the file of its name | exact, ambiguous, unresolved",
    "rust.use.crate_path": "a use below crate to a declaration or module | exact, ambiguous, unresolved",
    "rust.use.non_crate_path": "a use of another root | out_of_scope",
    "go.package.same_directory": "a package clause to the packages of its folder | exact, ambiguous",
    "go.import.local_module": "an import below a module to the packages of its folder | exact, ambiguous, unresolved",
    "go.import.external": "an import outside every module | out_of_scope",
    "python.relative_import.package_path": "a relative import to a file or package | exact, ambiguous, unresolved",
    "python.absolute_import.local_candidate": "an absolute import that a file could serve | ambiguous",
    "python.absolute_import.external": "an absolute import that no file could serve | out_of_scope",
    "php.namespace.declaration": "a class-like by its full name | exact, ambiguous",
    "php.use.qualified_name": "a use of a declared namespace | exact, ambiguous, unresolved",
    "php.use.external": "a use of another namespace | out_of_scope",
    "php.use.non_class_import": "a use of a function or constant | out_of_scope",
    "php.class.extends": "a parent class by its full name | exact, ambiguous, unresolved",
    "php.class.implements": "an interface by its full name | exact, ambiguous, unresolved",
    "php.class.uses_trait": "a trait by its full name | exact, ambiguous, unresolved",
    "rust.call.local_function_candidate": "a plain call to the functions of the nearest level up to its module | no, single, multiple",
    "rust.call.imported_function_candidate": "a plain call of an imported name to the functions its import leads to | no, single, multiple",
    "rust.call.structural_path_function_candidate": "a call by a path from crate, self, super or a child module to the functions there | no, single, multiple, out_of_scope",
    "go.call.package_local_function_candidate": "a plain call to the functions of its package | no, single, multiple",
    "go.call.imported_package_function_candidate": "a call by an imported package of the repository to its exported functions | no, single, multiple, out_of_scope",
    "php.call.namespace_function_candidate": "a plain call to the functions of its namespace, or else global ones | no, single, multiple, out_of_scope",
    "php.call.imported_function_candidate": "a plain call of an imported name to the functions of its full name | no, single, multiple",
    "php.call.construction_class_candidate": "a construction to the classes of its full name | no, single, multiple, out_of_scope",
    "php.call.static_method_candidate": "a static call to the methods of the class it names | no, single, multiple, out_of_scope",
    "php.call.lexical_self_method_candidate": "a call by self to the methods of the class around it | no, single, multiple, out_of_scope",
    "php.call.lexical_this_method_candidate": "a call on this to the methods of the class around it | no, single, multiple, out_of_scope",
    "php.call.typed_receiver_method_candidate": "a call on a variable whose classes are known to their methods | no, single, multiple, out_of_scope",
    "php.call.inherited_method_candidate": "any of these where the method is that of an ancestor | single, multiple",
    "php.call.parent_method_candidate": "a call by parent to the methods of the parents of the class around it | no, single, multiple, out_of_scope",
    "php.call.parent_construction_candidate": "a construction of parent to the parents of the class around it | no, single, multiple, out_of_scope",
}


def rule_registry(spark) -> DataFrame:
    """(rule_id, links, outcomes) of every rule."""
    return spark.createDataFrame([(r, *(x.strip() for x in text.split("|"))) for r, text in RULES.items()], "rule_id string, links string, outcomes string")

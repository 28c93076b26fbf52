"""Source trees, manifests and history as DataFrames."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import identifiers as I

#: Folders that are never read. Fixed values.
PRUNED = [".git", "target", "vendor", "node_modules", "__pycache__", ".venv", "venv"]
LANGUAGES = {"rust": ["rs"], "go": ["go"], "python": ["py"], "php": ["php"]}
MANIFESTS = ["go.mod", "Cargo.toml"]
MAX_BYTES = 8 * 1024 * 1024


def ignore_patterns(text: str) -> list[tuple[bool, str]]:
    """(whether it re-includes, regular expression) of each line of an ignore file, in order."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[1:] if back else line
        folder, rooted = line.endswith("/"), "/" in line.rstrip("/")
        body = ""
        for part in re.split(r"(\*\*/|\*\*|\*|\?)", line.strip("/")):
            body += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
        out.append((back, ("^" if rooted else "(?:^|.*/)") + body + ("/.*$" if folder else "(?:/.*)?$")))
    return out


def _ignored(path: Column, patterns: list[tuple[bool, str]]) -> Column:
    """The last pattern that matches decides."""
    state = F.lit(False)
    for back, pattern in patterns:
        state = F.when(path.rlike(pattern), F.lit(not back)).otherwise(state)
    return state


def language_by_path(path: Column) -> Column:
    base, ext = I.basename(path), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(base.isin(MANIFESTS), "manifest")
    for name, exts in LANGUAGES.items():
        out = out.when(ext.isin(exts), name)
    return out


def scan_tree(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, ignore: str = "", excluded: list[str] | None = None) -> DataFrame:
    """Files of a tree: relative_path, language, source_bytes, truncated, content, content_digest, status, modified.

    Pruned folders, ignored paths and the prefixes in `excluded` are left out
    before contents are read. A file over `max_bytes` is cut and marked
    truncated; one that is no UTF-8 has status `invalid_utf8` and null text.
    """
    top = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    plain = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.substring(plain, F.length(F.regexp_extract(plain, f"^(.*?{re.escape(top.lstrip('/'))}/)", 1)) + 1, F.lit(1_000_000))
    df = raw.withColumn("relative_path", rel)
    for name in PRUNED:
        df = df.where(~F.concat(F.lit("/"), F.col("relative_path")).contains(f"/{name}/"))
    for prefix in excluded or []:
        df = df.where(~F.col("relative_path").startswith(prefix.rstrip("/") + "/"))
    if ignore:
        df = df.where(~_ignored(F.col("relative_path"), ignore_patterns(ignore)))
    cut = F.substring("content", 1, max_bytes)
    valid = F.is_valid_utf8(cut)
    status = F.when(F.col("length") > max_bytes, "truncated").when(~valid, "invalid_utf8").otherwise("clean")
    return df.select(
        "relative_path",
        language_by_path(F.col("relative_path")).alias("language"),
        F.col("length").alias("source_bytes"),
        (F.col("length") > max_bytes).alias("truncated"),
        F.when(valid, cut.cast("string")).alias("source_text"),
        F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_digest"),
        status.alias("status"),
        F.col("modificationTime").alias("modified"),
    )


def git_metadata(spark: SparkSession, root: str) -> DataFrame:
    """One row: branch, head and whether the work tree is dirty; nulls where it is no repository."""
    import subprocess

    def ask(*words: str) -> str | None:
        done = subprocess.run(["git", "-C", root, *words], capture_output=True, text=True)
        return done.stdout.strip() if done.returncode == 0 else None

    changes = ask("status", "--porcelain")
    return spark.createDataFrame([(ask("rev-parse", "--abbrev-ref", "HEAD"), ask("rev-parse", "HEAD"), None if changes is None else bool(changes))], "branch string, head string, dirty boolean")


def view_manifest(files: DataFrame, cached: DataFrame) -> DataFrame:
    """path -> digest, taken from `cached` where size and time are the same: (relative_path, content_digest, reused)."""
    old = cached.select("relative_path", F.col("source_bytes").alias("_b"), F.col("modified").alias("_m"), F.col("content_digest").alias("_d"))
    same = (F.col("_b") == F.col("source_bytes")) & (F.col("_m") == F.col("modified"))
    return files.join(old, "relative_path", "left").select("relative_path", F.when(same, F.col("_d")).otherwise(F.col("content_digest")).alias("content_digest"), F.coalesce(same, F.lit(False)).alias("reused"))


def go_mod_facts(files: DataFrame) -> DataFrame:
    """(relative_path, fact, name, version) of go.mod texts: module, go, require and replace lines, blocks included."""
    text = files.where(I.basename(F.col("relative_path")) == "go.mod")
    lines = text.select("relative_path", F.posexplode(F.split("source_text", "\n")).alias("n", "line"))
    plain = F.regexp_replace("line", r"//.*$|^\s+|\s+$", "")
    plain = F.regexp_replace(plain, r"\s+$", "")
    opened = F.regexp_extract(plain, r"^(require|replace|exclude|retract)\s*\($", 1)
    # Within one small file: the block a line lies in.
    w = Window.partitionBy("relative_path").orderBy("n")
    mark = F.when(opened != "", opened).when(plain == ")", "")
    block = F.coalesce(F.last(mark, True).over(w), F.lit(""))
    verb = F.when((block != "") & (opened == ""), block).otherwise(F.regexp_extract(plain, r"^(module|go|require|replace)\s", 1))
    rest = F.when((block != "") & (opened == ""), plain).otherwise(F.trim(F.regexp_replace(plain, r"^(module|go|require|replace)\s+", "")))
    return (
        lines.select("relative_path", "n", verb.alias("fact"), rest.alias("rest"), opened.alias("o"), plain.alias("plain"))
        .where("o = '' and plain not in ('', ')') and fact in ('module', 'go', 'require', 'replace')")
        .select("relative_path", "fact", F.regexp_replace(F.regexp_extract("rest", r'^"?(\S+?)"?(?:\s|$)', 1), '"', "").alias("name"), F.regexp_extract("rest", r"^\S+\s+(?:=>\s+)?(.*)$", 1).alias("version"))
    )


def cargo_facts(files: DataFrame) -> DataFrame:
    """(relative_path, fact, name, value) of Cargo.toml texts: package, dependencies, features, targets; a damaged file has one `damaged` row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["relative_path"], pdf["source_text"]):
                try:
                    doc = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    out.append((path, "damaged", "", ""))
                    continue
                package = doc.get("package", {})
                if "name" in package:
                    out.append((path, "package", str(package["name"]), str(package.get("version", ""))))
                for kind in ("dependencies", "dev-dependencies", "build-dependencies"):
                    for name, spec in doc.get(kind, {}).items():
                        out.append((path, kind, name, str(spec if isinstance(spec, str) else spec.get("version", ""))))
                for name, parts in doc.get("features", {}).items():
                    out.append((path, "feature", name, ",".join(parts)))
                for member in doc.get("workspace", {}).get("members", []):
                    out.append((path, "member", member, ""))
                for kind in ("lib", "bin", "test", "example", "bench"):
                    found = doc.get(kind, [])
                    for target in found if isinstance(found, list) else [found]:
                        out.append((path, "target:" + kind, str(target.get("name", package.get("name", ""))), str(target.get("path", ""))))
            yield pd.DataFrame(out, columns=["relative_path", "fact", "name", "value"])

    text = files.where(I.basename(F.col("relative_path")) == "Cargo.toml").select("relative_path", "source_text")
    return text.mapInPandas(read, "relative_path string, fact string, name string, value string")


def history_changes(logs: DataFrame) -> DataFrame:
    """(repository_id, position, commit, at, change, path) from texts of `git log --name-status --format="commit %H %ct"`.

    `logs`: (repository_id, log). Position 0 is the newest commit. A rename is
    the removal of the old path and the addition of the new one.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for repo, log in zip(pdf["repository_id"], pdf["log"]):
                out, position, commit, at = [], -1, "", 0
                for line in (log or "").splitlines():
                    if line.startswith("commit "):
                        _, commit, seconds = line.split()[:3]
                        position, at = position + 1, int(seconds)
                    elif line.strip():
                        change, *paths = line.split("\t")
                        if change[:1] == "R" and len(paths) == 2:
                            out += [(repo, position, commit, at, "D", paths[0]), (repo, position, commit, at, "A", paths[1])]
                        elif change[:1] == "C" and len(paths) == 2:
                            out.append((repo, position, commit, at, "A", paths[1]))
                        elif paths:
                            out.append((repo, position, commit, at, change[:1], paths[0]))
                yield pd.DataFrame(out, columns=["repository_id", "position", "commit", "at", "change", "path"])

    return logs.select("repository_id", "log").mapInPandas(read, "repository_id string, position long, commit string, at long, change string, path string")


TAIL = 128


def file_temporal(changes: DataFrame, tail: int | None = TAIL) -> DataFrame:
    """Per path: first and last change by log position (not by time), number of changes, newest `tail` times ascending (None: all)."""
    kept = F.col("at")
    if tail is not None:
        w = Window.partitionBy("repository_id", "path").orderBy("position")
        changes, kept = changes.withColumn("k", F.row_number().over(w)), F.when(F.col("k") <= tail, F.col("at"))
    return changes.groupBy("repository_id", "path").agg(
        F.max_by("commit", "position").alias("first_commit"),
        F.max_by("at", "position").alias("first_at"),
        F.min_by("commit", "position").alias("last_commit"),
        F.min_by("at", "position").alias("last_at"),
        F.count(F.lit(1)).alias("n_changes"),
        F.sort_array(F.collect_list(kept)).alias("tail"),
    )


def recent_changes(changes: DataFrame, head: Column, days: int) -> DataFrame:
    """Changes per path within `days` days before `head`, counted from the changes themselves: (repository_id, path, n)."""
    return changes.where(F.col("at") >= head - days * 86400).groupBy("repository_id", "path").agg(F.count(F.lit(1)).alias("n"))


def change_measures(temporal: DataFrame, head: Column, days: list[int]) -> DataFrame:
    """Recent changes within N days (exact while they fit the tail; see `recent_changes`), mean interval, and changes a year x 10^6, in whole numbers."""
    age = head - F.col("first_at")
    out = temporal
    for n in days:
        out = out.withColumn(f"changes_{n}d", F.size(F.filter("tail", lambda t: t >= head - n * 86400)))
    out = out.withColumn("mean_interval", F.when(F.col("n_changes") > 1, F.expr("(last_at - first_at) div (n_changes - 1)")))
    year = F.lit(31_557_600).cast("decimal(38,0)") * 1_000_000
    return out.withColumn("frequency_e6", F.when(age > 0, F.floor(F.col("n_changes") * year / age).cast("long")))

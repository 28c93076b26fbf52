"""Source files that do not parse in their language.

Every file is parsed against all supported grammars, in the order of a ranking
by its tokens. A file that its own grammar refuses and another accepts has a
wrong extension or label; one that all refuse is damaged.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.syntax import ecma, golang, php, rust
from tracewell.llm.syntax.base import Broken

#: Ways to write a language, and the extensions of its files. Fixed values.
NAMES = {
    "python": ["python", "python3", "py", "py3", "cpython"],
    "go": ["go", "golang"],
    "rust": ["rust", "rs"],
    "php": ["php", "php8"],
    "javascript": ["javascript", "js", "ecmascript", "node", "nodejs", "mjs", "es6"],
}
EXTENSIONS = {"python": ["py", "pyi", "pyw"], "go": ["go"], "rust": ["rs"], "php": ["php", "phtml", "php8", "inc"], "javascript": ["js", "mjs", "cjs", "jsm"]}
#: Words that speak for a language. Fixed values.
MARKS = {
    "python": ["def", "elif", "self", "import", "from", "None", "True", "lambda", "except", "pass", "yield"],
    "go": ["func", "package", "chan", "defer", "range", "nil", "struct", "interface", "go", "import", "fallthrough"],
    "rust": ["fn", "let", "mut", "impl", "pub", "use", "crate", "match", "Some", "None", "Result", "where"],
    "php": ["php", "function", "echo", "namespace", "array", "declare", "strict_types", "foreach", "use", "trait"],
    "javascript": ["const", "let", "var", "function", "export", "import", "async", "await", "new", "this", "typeof"],
}
_WORD = re.compile(r"[A-Za-z_]\w*")
_PHP_TAG = re.compile(r"<\?(?:php\b|=)", re.I)


def language_of(language: Column, path: Column) -> Column:
    """The supported language that the label names, or else the extension; null for others."""
    plain, ext = F.lower(F.trim(language)), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\s*$", 1))
    by_name = by_ext = F.lit(None).cast("string")
    for name, ways in NAMES.items():
        by_name = F.when(plain.isin(ways), name).otherwise(by_name)
        by_ext = F.when(ext.isin(EXTENSIONS[name]), name).otherwise(by_ext)
    return F.when(plain.isNull() | (plain == ""), by_ext).otherwise(F.coalesce(by_name, by_ext))


def _python(text: str) -> None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError) as e:
        raise Broken(str(e)) from None


GRAMMARS = {"python": _python, "go": golang.check, "rust": rust.check, "php": php.check, "javascript": ecma.check}


def ranked(text: str) -> list[str]:
    """The languages, the one whose words make up most of the text first."""
    seen = Counter(_WORD.findall(text))
    score = {name: sum(seen.get(w, 0) for w in marks) for name, marks in MARKS.items()}
    return sorted(score, key=lambda n: (-score[n], n))


def parse_all(text: str) -> tuple[list[str], list[str]]:
    """(languages whose grammar accepts the text, languages that could not be decided), by rank.

    PHP text without a tag is accepted, being all template; it does not count
    as a foreign parse (see `verdict`).
    """
    accepted, undecided = [], []
    for name in ranked(text):
        try:
            GRAMMARS[name](text)
            accepted.append(name)
        except Broken:
            pass
        except (RecursionError, MemoryError):  # nested deeper than the parser goes
            undecided.append(name)
    return accepted, undecided


def verdict(language: str | None, text: str | None) -> tuple[str, str | None]:
    """(status, best-ranked other language that accepts the text).

    status: `ok`, `wrong_language` (only others accept it), `corrupt` (none
    does), `undecided` (nested too deep to judge), `unknown` (no supported
    language or no text).
    """
    if language is None or text is None:
        return "unknown", None
    accepted, undecided = parse_all(text)
    foreign = [n for n in accepted if n != language and (n != "php" or _PHP_TAG.search(text)) and text.strip()]
    other = foreign[0] if foreign else None
    if language in accepted:
        return "ok", other
    if language in undecided:
        return "undecided", other
    return ("wrong_language" if other else "corrupt"), other


def checked_files(files: DataFrame, carried: list[str], language: str, path: str, text: str) -> DataFrame:
    """One row per distinct (carried, language) with syntax_language, status and parsed_as.

    Rows are independent: nothing is shuffled but the few columns of the result,
    to make repeated rows one. Null texts and unsupported languages have status
    `unknown`; empty texts are valid except in Go.
    """
    types = {f.name: f.dataType.simpleString() for f in files.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(40_000)
        for pdf in batches:
            found = [verdict(k, t) for k, t in zip(pdf["syntax_language"], pdf["_text"])]
            out = pdf.drop(columns="_text")
            out["status"] = [s for s, _ in found]
            out["parsed_as"] = [p for _, p in found]
            yield out

    plain = files.select(*carried, language_of(F.col(language), F.col(path)).alias("syntax_language"), F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carried), "syntax_language string, status string, parsed_as string"])
    return plain.mapInPandas(run, schema).distinct()


def syntax_rates(checked: DataFrame, repository: str) -> DataFrame:
    """Files, invalid files and their share per repository and language (unknown ones left out)."""
    bad = F.col("status").isin("wrong_language", "corrupt")
    return (
        checked.where(F.col("status") != "unknown")
        .groupBy(repository, "syntax_language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum(bad.cast("long")).alias("n_invalid"), F.sum((F.col("status") == "wrong_language").cast("long")).alias("n_wrong_language"))
        .withColumn("invalid_rate", F.col("n_invalid") / F.col("n_files"))
    )

"""Facts of source texts: declarations, imports and calls, one row each.

Python is read with the standard parser, damaged lines taken out where it
stops; Go, Rust and PHP by their own token patterns, strings and comments set
aside. So damaged files still give the facts beside the damage.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: `scope` is the owner of a declaration, `chain` the named blocks around a fact, the outermost first: `mod:a>fn:b`.
#: A `binding` is visible from byte_start to byte_end (half open); a `write` gives a variable a value, of class `target` where that is known.
FACTS = "fact_kind string, fact_id long, scope string, kind string, name string, target string, level long, byte_start long, byte_end long, chain string"
Fact = tuple[str, int, str, str, str, str, int, int, int, str]


class _Facts:
    def __init__(self) -> None:
        self.rows: list[Fact] = []
        self.count = dict.fromkeys(("declaration", "import", "call", "reference", "binding", "write"), 0)

    def add(self, fact: str, scope: str, kind: str, name: str, start: int, end: int, target: str = "", level: int = 0) -> None:
        self.rows.append((fact, self.count[fact], scope, kind, name, target, level, start, end, scope))
        self.count[fact] += 1


class _Python:
    """Facts of a Python tree, with an explicit stack: depth of nesting is no bound.

    Each visit is a generator of the nodes to visit next. `shift` has the bytes
    that were taken off the front of a line before it was parsed.
    """

    def __init__(self, text: str, out: _Facts, shift: dict[int, int] | None = None) -> None:
        self.out, self.scope, self.kinds, self.shift = out, [], ["file"], shift or {}
        self.source = text.encode()
        self.starts = [0]
        for line in self.source.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))

    def _place(self, line: int, column: int) -> int:
        return min(self.starts[line - 1] + column + self.shift.get(line, 0), self.starts[min(line, len(self.starts) - 1)])

    def at(self, node) -> tuple[int, int]:
        return self._place(node.lineno, node.col_offset), self._place(node.end_lineno, node.end_col_offset)

    def name(self) -> str:
        return ".".join(self.scope)

    def spelled(self, node) -> str:
        try:
            return ast.unparse(node)
        except RecursionError:
            start, end = self.at(node)
            return re.sub(r"\s+", " ", self.source[start:end].decode(errors="replace"))

    def visit(self, root) -> None:
        stack = [iter([root])]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            else:
                stack.append(getattr(self, "visit_" + type(node).__name__, ast.iter_child_nodes)(node))

    def _inner(self, node, kind: str, label: str) -> Iterator[ast.AST]:
        # Decorators, defaults and bases belong to the scope around.
        self.out.add("declaration", self.name(), kind, label, *self.at(node))
        for base in getattr(node, "bases", []):
            if isinstance(base, (ast.Name, ast.Attribute)):
                self.out.add("reference", self.name(), "extends", self.spelled(base), *self.at(base), target=label)
        yield from [*node.decorator_list, *getattr(node, "bases", []), *getattr(node, "keywords", [])]
        if hasattr(node, "args"):
            yield from [*node.args.defaults, *[x for x in node.args.kw_defaults if x]]
        self.scope.append(label)
        self.kinds.append("class" if kind == "class" else "function")
        yield from node.body
        self.scope.pop()
        self.kinds.pop()

    def visit_FunctionDef(self, node) -> Iterator[ast.AST]:
        return self._inner(node, "method" if self.kinds[-1] == "class" else "function", node.name)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> Iterator[ast.AST]:
        return self._inner(node, "class", node.name)

    def _targets(self, targets, value) -> Iterator[ast.AST]:
        if self.kinds[-1] != "function":
            for t in targets:
                for x in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                    if isinstance(x, ast.Name):
                        kind = "field" if self.kinds[-1] == "class" else "constant" if x.id.isupper() else "variable"
                        self.out.add("declaration", self.name(), kind, x.id, *self.at(x))
        return iter([] if value is None else [value])

    def visit_Assign(self, node) -> Iterator[ast.AST]:
        return self._targets(node.targets, node.value)

    def visit_AnnAssign(self, node) -> Iterator[ast.AST]:
        return self._targets([node.target], node.value)

    def visit_Import(self, node) -> Iterator[ast.AST]:
        for a in node.names:
            self.out.add("import", self.name(), "import", a.name, *self.at(node), target=a.asname or "")
        return iter([])

    def visit_ImportFrom(self, node) -> Iterator[ast.AST]:
        for a in node.names:
            self.out.add("import", self.name(), "from", node.module or "", *self.at(node), target=a.name, level=node.level)
        return iter([])

    def visit_Call(self, node) -> Iterator[ast.AST]:
        kind = "plain" if isinstance(node.func, ast.Name) else "member" if isinstance(node.func, ast.Attribute) else "indirect"
        self.out.add("call", self.name(), kind, self.spelled(node.func) if kind != "indirect" else "", *self.at(node))
        return ast.iter_child_nodes(node)


#: A line of a merge conflict.
_MARKER = re.compile(r"(?:<{7}|>{7}|\|{7})(?:\s|$)|={7}\s*$")
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b|[\s#)\]}]|$")


def _parsed(text: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


class _Repaired:
    """A Python text that does not parse, mended line by line until it does.

    The line the parser stops at gives way to `pass` (to `if 1:` where a block
    follows, to nothing where it is a conflict marker or stands in brackets) and
    the text is parsed again; all other lines keep their place and their scope.
    What is sound before the damaged top-level statement is parsed but once.
    `damaged` has the lines that gave way or had to be moved.
    """

    def __init__(self, text: str) -> None:
        self.lines = [x.decode() for x in text.encode().splitlines(keepends=True)]
        self.state, self.shift, self.damaged, self.body = [0] * len(self.lines), {}, set(), []
        for i, line in enumerate(self.lines):
            if "\0" in line:
                self.lines[i] = line.replace("\0", " ")
                self.damaged.add(i)
        if self.lines and self.lines[0].startswith("\ufeff"):
            self.lines[0], self.shift[1] = self.lines[0][1:], 3
            self.damaged.add(0)
        base = 0
        while base < len(self.lines):
            try:
                self._keep(base, len(self.lines))
                break
            except SyntaxError as e:
                at = min(max(base, base + (e.lineno or 1) - 1), len(self.lines) - 1)
                was = list(self.lines)
                self._mend(base, at, e)
                if self.lines == was:
                    raise MemoryError("nothing is left to mend") from e
                start = next((i for i in range(at, base, -1) if not _GOES_ON.match(self.lines[i])), base)
                if start > base:
                    try:
                        self._keep(base, start)
                        base = start
                    except SyntaxError:
                        pass

    def _keep(self, start: int, end: int) -> None:
        self.body += ast.increment_lineno(_parsed("".join(self.lines[start:end])), start).body

    def _indent(self, i: int) -> int:
        return len(self.lines[i]) - len(self.lines[i].lstrip(" \t\f"))

    def _filled(self, i: int) -> bool:
        return self.lines[i].strip() != ""

    def _move(self, i: int, to: int) -> None:
        """Takes the block that begins at line i to a smaller indent."""
        at = self._indent(i)
        self.damaged.add(i)
        for k in range(i, len(self.lines)):
            if self._filled(k):
                if self._indent(k) < at:
                    break
                self.lines[k] = self.lines[k][at - to :]
                self.shift[k + 1] = self.shift.get(k + 1, 0) + at - to

    def _mend(self, base: int, at: int, e: SyntaxError) -> None:
        if isinstance(e, TabError) and any("\t" in x[: self._indent(base + k)] for k, x in enumerate(self.lines[base:])):
            self.damaged.add(at)
            for k in range(base, len(self.lines)):
                n = self._indent(k)
                front = self.lines[k][:n].expandtabs(8)
                self.lines[k] = front + self.lines[k][n:]
                self.shift[k + 1] = self.shift.get(k + 1, 0) + n - len(front)
            return
        if isinstance(e, IndentationError) and (m := re.search(r"expected an indented block after .* on line (\d+)", e.msg)):
            # The head of the empty block keeps its facts.
            head = base + int(m.group(1)) - 1
            if self.state[head] == 0 and self.lines[head].rstrip().endswith(":") and "#" not in self.lines[head]:
                self.lines[head] = self.lines[head].rstrip() + " pass\n"
                self.state[head] = 1
                self.damaged.add(head)
                return
            at = head if self.state[head] < 2 else at
        elif isinstance(e, IndentationError) and self._indent(at) and self._filled(at):
            before = [self._indent(k) for k in range(base, at) if self._filled(k)]
            lower = [x for x in before if x < self._indent(at)]
            last = before[-1] if before else 0
            self._move(at, last if "unexpected indent" in e.msg and last < self._indent(at) else max(lower, default=0))
            return
        elif "expected 'except'" in e.msg:
            opened = next((k for k in range(at, base - 1, -1) if re.match(r"\s*try\s*:", self.lines[k]) and self._indent(k) >= (self._indent(at) if self._filled(at) else 0)), None)
            if opened is not None:
                self.lines[opened] = re.sub(r"try\s*:", "if 1:", self.lines[opened], count=1)
                self.damaged.add(opened)
                return
        while at > base and (self.state[at] >= 2 or not self._filled(at)):
            at -= 1
        if self.state[at] >= 2 or not self._filled(at):  # nothing is left here that could be at fault
            at = next((k for k in range(base, len(self.lines)) if self._filled(k) and self.state[k] < 2), None)
            if at is None:
                raise MemoryError("no line is left to mend")
        self.damaged.add(at)
        if self.state[at] < 1 and not _MARKER.match(self.lines[at]):
            n = self._indent(at)
            after = next((self._indent(k) for k in range(at + 1, len(self.lines)) if self._filled(k)), 0)
            self.lines[at], self.state[at] = self.lines[at][:n] + ("if 1:\n" if after > n else "pass\n"), 1
        else:
            self.lines[at], self.state[at] = "\n", 2


_PY_BLANK = re.compile(r"(?i:\b[rbuf]{1,2})?(?:\"\"\".*?(?:\"\"\"|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|\"(?:[^\"\\\n]|\\.)*\"|\'(?:[^\'\\\n]|\\.)*\')|#[^\n]*", re.S)
_PY_FACT = re.compile(r"^(?P<indent>[ \t]*)(?:(?:async[ \t]+)?(?P<kind>def|class)[ \t]+(?P<decl>\w+)|from[ \t]+(?P<dots>\.*)(?P<module>[\w.]*)[ \t]+import[ \t]*(?P<names>\([^)]*\)|[^\n;]*)|import[ \t]+(?P<modules>[^\n;]+)|(?P<target>\w+)[ \t]*(?::[^=\n]+)?=(?!=))|(?<![\w.])(?P<call>\w+(?:\s*\.\s*\w+)*)\s*\(", re.M)
_PY_NO_CALL = frozenset("if elif while for in and or not return yield await assert del with lambda print except raise from import is else class def match case".split())


def _python_patterns(text: str, out: _Facts) -> None:
    """Facts by token patterns, for what the parser cannot hold. Scopes go by indent."""
    code = _PY_BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    ascii_ = code.isascii() and text.isascii()
    place = (lambda i: i) if ascii_ else (lambda i: len(text[:i].encode()))
    open_: list[tuple[int, str, str]] = []
    for m in _PY_FACT.finditer(code):
        if m["call"] is None:
            while open_ and open_[-1][0] >= len(m["indent"]):
                open_.pop()
        scope, inside = ".".join(x for _, x, _ in open_), open_[-1][2] if open_ else "file"
        where = place(m.start() + len(m["indent"] or "")), place(m.end())
        if m["decl"]:
            out.add("declaration", scope, "class" if m["kind"] == "class" else "method" if inside == "class" else "function", m["decl"], *where)
            open_.append((len(m["indent"]), m["decl"], "class" if m["kind"] == "class" else "function"))
        elif m["target"]:
            if inside != "function":
                out.add("declaration", scope, "field" if inside == "class" else "constant" if m["target"].isupper() else "variable", m["target"], *where)
        elif m["call"] is not None:
            if m["call"] not in _PY_NO_CALL:
                out.add("call", scope, "member" if "." in m["call"] else "plain", re.sub(r"\s+", "", m["call"]), *where)
        else:
            for part in (m["modules"] or m["names"].strip("()")).split(","):
                name, _, alias = " ".join(part.split()).partition(" as ")
                if name and m["modules"]:
                    out.add("import", scope, "import", name, *where, target=alias)
                elif name:
                    out.add("import", scope, "from", m["module"], *where, target=name, level=len(m["dots"]))


def _python_facts(text: str) -> list[Fact]:
    out = _Facts()
    try:
        try:
            _Python(text, out).visit(_parsed(text))
        except SyntaxError:
            mended = _Repaired(text)
            _Python(text, out, mended.shift).visit(ast.Module(mended.body, []))
    except (ValueError, RecursionError, MemoryError):
        out = _Facts()
        _python_patterns(text, out)
    return out.rows


_BLANK = {
    "go": re.compile(r'//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n]|\\.)+\'', re.S),
    "rust": re.compile(r'//[^\n]*|/\*.*?\*/|b?r(#*)".*?"\1|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\[^\n]{1,10}?)\'', re.S),
    "php": re.compile(r'//[^\n]*|#(?!\[)[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|<<<\s*[\'"]?(\w+)[\'"]?\n.*?\n\s*\1\b', re.S),
}
_DECLARED = {
    "go": [
        ("package", re.compile(r"^package\s+(\w+)", re.M)),
        ("method", re.compile(r"^func\s*\([^)]*\)\s*(\w+)", re.M)),
        ("function", re.compile(r"^func\s+(\w+)", re.M)),
        ("struct", re.compile(r"^\s*(?:type\s+)?(\w+)(?:\[[^\]\n]*\])?\s+struct\b", re.M)),
        ("interface", re.compile(r"^\s*(?:type\s+)?(\w+)(?:\[[^\]\n]*\])?\s+interface\b", re.M)),
        ("constant", re.compile(r"^const\s+(\w+)", re.M)),
        ("variable", re.compile(r"^var\s+(\w+)", re.M)),
    ],
    "rust": [
        ("module", re.compile(r"\bmod\s+(\w+)")),
        ("function", re.compile(r"\bfn\s+(\w+)")),
        ("struct", re.compile(r"\bstruct\s+(\w+)")),
        ("enum", re.compile(r"\benum\s+(\w+)")),
        ("trait", re.compile(r"\btrait\s+(\w+)")),
        ("constant", re.compile(r"\bconst\s+(\w+)\s*:")),
        ("static", re.compile(r"\bstatic\s+(?:mut\s+)?(\w+)\s*:")),
        ("macro", re.compile(r"\bmacro_rules!\s*(\w+)")),
        ("type", re.compile(r"\btype\s+(\w+)")),
    ],
    "php": [
        ("namespace", re.compile(r"\bnamespace\s+([\w\\]+)\s*[;{]")),
        ("class", re.compile(r"(?<![:$>\w])class\s+(\w+)")),
        ("interface", re.compile(r"\binterface\s+(\w+)")),
        ("trait", re.compile(r"\btrait\s+(\w+)")),
        ("enum", re.compile(r"\benum\s+(\w+)\s*[:{\n]")),
        ("function", re.compile(r"\bfunction\s+&?\s*(\w+)\s*\(")),
        ("constant", re.compile(r"\bconst\s+(?:\w+\s+)?(\w+)\s*=")),
    ],
}
_CALLED = {
    "go": re.compile(r"(?<![\w.])((?:\w+\.)*\w+)\s*\("),
    "rust": re.compile(r"(?<!\w)((?:\w+::)*(?:\.\s*)?\w+!?)\s*(?:::<[^()]*?>)?\s*[(\[{](?<=[!(].)?|(?<!\w)((?:\w+::)*\.?\w+)\s*\("),
    "php": re.compile(r"((?:new\s+)?(?:\$?[\w\\]+(?:->|\?->|::))*\$?[\w\\]+)\s*\("),
}
_CALLED["rust"] = re.compile(r"(?<![\w:.])((?:\w+::)*\w+!?|\.\w+)\s*(?:::<[^()]*?>)?\(|(\.\w+)\s*\(")
_NO_CALL = {
    "go": frozenset("func if for switch return range defer go select case map chan interface struct import const var type".split()),
    "rust": frozenset("fn if while for match return in loop let mut move as where impl pub use crate".split()),
    "php": frozenset("function fn if while for foreach switch match return catch array list isset empty unset exit die echo print use declare static elseif and or xor new".split()),
}


_PHP_HEAD = re.compile(r"\b(?:class|interface|enum)\s+(\w+)[^{};]*?(?:\sextends\s+([\w\\,\s]+?))?(?:\simplements\s+([\w\\,\s]+?))?\s*\{")


#: What owns the functions in its braces: the name is in the first group that is there.
_OWNERS = {
    "php": re.compile(r"(?<![:$>\w])(?:class|interface|trait|enum)\s+(\w+)[^{};]*\{"),
    "rust": re.compile(r"\b(?:impl\b[^{};]*?\bfor\s+([\w:]+)|impl\s*(?:<[^{}]*?>\s*)?([\w:]+)|trait\s+(\w+))[^{};]*\{"),
}


def _bodies(code: str, heads: re.Pattern[str]) -> list[tuple[int, int, str]]:
    """(start, end, owner) of what stands in the braces of each head, the innermost first."""
    closes, open_ = {}, []
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            open_.append(m.start())
        elif open_:
            closes[open_.pop()] = m.start()
    out = []
    for m in heads.finditer(code):
        start = m.end() - 1
        out.append((start, closes.get(start, len(code)), next((g for g in m.groups() if g), "")))
    return sorted(out, key=lambda b: b[1] - b[0])


def _blanked(language: str, text: str) -> str:
    """The text with strings and comments replaced by as many blanks (line breaks kept)."""
    return _BLANK[language].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _imports(language: str, text: str, code: str, out: _Facts, bodies: list[tuple[int, int, str]]) -> None:
    if language == "go":
        for m in re.finditer(r"^import\s*(\((.*?)\)|[^\n]*)", text, re.M | re.S):
            for i in re.finditer(r'(?:([\w.]+)\s+)?"([^"\n]+)"', m.group(1)):
                out.add("import", "", "import", i.group(2), m.start(1) + i.start(), m.start(1) + i.end(), target=i.group(1) or "")
    elif language == "rust":
        for m in re.finditer(r"\buse\s+([^;]+);", code):
            for path, alias in use_paths(m.group(1)):
                out.add("import", "", "use", path, m.start(), m.end(), target=alias)
    else:
        for m in re.finditer(r"^\s*use\s+(function\s+|const\s+)?([^;()]+);", code, re.M):
            if any(a < m.start(2) < b for a, b, _ in bodies):
                continue  # a trait, not an import
            kind = (m.group(1) or "class").strip()
            body = m.group(2).strip()
            group = re.match(r"([\w\\]+\\)\{(.*)\}$", body, re.S)
            for part in group.group(2).split(",") if group else body.split(","):
                full, _, alias = (part.strip().partition(" as "))
                if full.strip():
                    name = (group.group(1) if group else "") + full.strip()
                    out.add("import", "", kind, name.lstrip("\\"), m.start(), m.end(), target=alias.strip() or name.rsplit("\\", 1)[-1])


def use_paths(tree: str) -> list[tuple[str, str]]:
    """(path, alias) of each leaf of a Rust use tree."""
    tree = re.sub(r"\s+", " ", tree).strip()
    m = re.match(r"^(.*?)\{(.*)\}$", tree)
    if m is None:
        path, _, alias = tree.partition(" as ")
        path = path.strip().removeprefix("::")
        return [(path, alias.strip() or path.rsplit("::", 1)[-1])] if path else []
    out, depth, part = [], 0, ""
    for c in m.group(2) + ",":
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            for path, alias in use_paths(part.strip()) if part.strip() else []:
                full = m.group(1).strip() + path
                full = full.removesuffix("::self")
                out.append((full, alias if alias != "self" else full.rsplit("::", 1)[-1]))
            part = ""
        else:
            part += c
    return out


def facts_of(language: str | None, text: str | None) -> list[Fact]:
    """All facts of a text; none for null texts and other languages."""
    out = _Facts()
    if text is None or language is None:
        return []
    if language == "python":
        return _python_facts(text)
    if language not in _DECLARED:
        return []
    code = _blanked(language, text)
    found = []
    for kind, pattern in _DECLARED[language]:
        found += [(m.start(1), kind, m.group(1), m.end(1)) for m in pattern.finditer(code)]
    bodies = _bodies(code, _OWNERS[language]) if language in _OWNERS else []
    for start, kind, name, end in sorted(found):
        owner = next((o for a, b, o in bodies if a < start < b), "") if kind in ("function", "constant", "type") else ""
        head = code[max(0, start - 80) : start] if language == "php" and owner else ""
        hidden = re.search(r"\bprivate\b[\w\s]*$", head) is not None
        out.add("declaration", owner, "method" if owner and kind == "function" else kind, name, start, end, target="private" if hidden else "")
    _imports(language, text, code, out, bodies)
    if language == "php":
        for m in _PHP_HEAD.finditer(code):
            for kind, body in (("extends", m.group(2)), ("implements", m.group(3))):
                for part in (body or "").split(","):
                    if part.strip():
                        out.add("reference", "", kind, part.strip(), m.start(), m.end(), target=m.group(1))
        for m in re.finditer(r"(?:^|[{};])\s*use\s+([\w\\,\s]+?)\s*[;{]", code, re.M):
            owner = next((o for a, b, o in bodies if a < m.start(1) < b), "")
            for part in m.group(1).split(",") if owner else []:
                out.add("reference", owner, "uses_trait", part.strip(), m.start(1), m.end(1), target=owner)
    declared = {s for s, *_ in found}
    for m in _CALLED[language].finditer(code):
        g = 1 if m.group(1) else 2
        name = m.group(g) if m.lastindex and g <= m.lastindex else m.group(1)
        last = re.split(r"::|\.|->|\s", name)[-1].lstrip("$")
        word = last in _NO_CALL[language] and not name.startswith("new ")
        if not last or word or name in _NO_CALL[language] or m.end(g) - len(last) in declared:
            continue
        kind = "macro" if name.endswith("!") else "construct" if name.startswith("new ") else "static" if "::" in name else "member" if "." in name or "->" in name else "plain"
        out.add("call", "", kind, name, m.start(g), m.end(g))
    pairs = _pairs(code)
    found_blocks = _blocks(language, code, pairs)
    _bindings(language, code, pairs, found_blocks, out)
    return _placed(out.rows, text, found_blocks)


_BRACKETS = {"(": ")", "[": "]", "{": "}"}


def _pairs(code: str) -> dict[int, int]:
    """Where each bracket that is opened is closed (the end of the text if it never is)."""
    closes, open_ = {}, []
    for m in re.finditer(r"[()\[\]{}]", code):
        c = m.group()
        if c in _BRACKETS:
            open_.append((m.start(), _BRACKETS[c]))
        elif any(x == c for _, x in open_):
            while open_:
                at, wanted = open_.pop()
                closes[at] = m.start()
                if wanted == c:
                    break
    return closes | {at: len(code) for at, _ in open_}


#: What begins a named block: `mod` and so on names it in the chain of facts within.
_BLOCK_HEADS = {
    "go": re.compile(r"\b(?P<fn>func)\b\s*(?:\([^()]*\)\s*(?=\w))?(?P<name>\w*)"),
    "rust": re.compile(r"\b(?:(?P<mod>mod)\s+(?P<m>\w+)\s*\{|(?P<fn>fn)\s+(?P<name>\w+)|(?P<own>impl|trait)\b[^{};]*\{)"),
    "php": re.compile(r"(?<![:$>\w])(?:(?P<own>class|interface|trait|enum)\s+(?P<m>\w+)[^{};]*\{|(?P<fn>function)\b\s*&?\s*(?P<name>\w*))"),
}
#: (label, (start, end) of the parameters if it has any, start and end of the body)
Block = tuple[str, tuple[int, int] | None, int, int]


def _blocks(language: str, code: str, pairs: dict[int, int]) -> list[Block]:
    """Functions, modules and owners of functions with their bodies, in order of their heads."""
    owners = {a: o for a, _, o in _bodies(code, _OWNERS[language])} if language in _OWNERS else {}
    out: list[Block] = []
    for m in _BLOCK_HEADS[language].finditer(code):
        if not m["fn"]:
            start = m.end() - 1
            label = f"mod:{m['m']}" if m.groupdict().get("mod") else f"class:{owners.get(start, '')}"
            out.append((label, None, start, pairs.get(start, len(code))))
            continue
        at = m.end()
        if code[at : at + 1] in ("<", "["):  # type parameters
            depth, at = 0, at
            while at < len(code):
                c = code[at]
                if c in "<[":
                    depth += 1
                elif c in ">]" and code[at - 1] != "-":
                    depth -= 1
                at += 1
                if not depth:
                    break
        at = _BLANKS.match(code, at).end()
        if code[at : at + 1] != "(":
            continue
        params = (at, pairs.get(at, len(code)))
        at = params[1] + 1
        # The body is the next brace that is not part of a type.
        while (n := _BODY.search(code, at)) and n.group() == "{" and re.search(r"\b(?:interface|struct)\s*$", code[at : n.start()]):
            at = pairs.get(n.start(), len(code)) + 1
        if n and n.group() == "{":
            out.append((f"fn:{m['name']}", params, n.start(), pairs.get(n.start(), len(code))))
    return out


_WORDS, _BLANKS, _BODY = re.compile(r"[^\W\d]\w*"), re.compile(r"\s*"), re.compile(r"[{;]|\bfunc\b|=>")
_RUST_LET = re.compile(r"\b(?P<if>(?:if|while)\s+)?let\s+(?P<pat>[^=;{}]*)(?P<end>=(?!=)|;)?|\bfor\s+(?P<for>[^{};\n]*?)\sin\b|(?<![\w)\]|&])\|(?!\|)(?P<args>[^|\n;{}]*)\||(?P<arm>=>)")
#: What stands before the arrow of an arm, and a condition at the end of it.
_ARM_ENDS, _GUARD = re.compile(r"[{},;\n=]"), re.compile(r"\bif\b.*$", re.S)
_GO_SHORT = re.compile(r"(?P<names>[^\W\d]\w*(?:\s*,\s*[^\W\d]\w*)*)\s*:=|^[ \t]+(?:var|const)\s+(?P<var>[^\W\d]\w*(?:\s*,\s*[^\W\d]\w*)*)", re.M)
_PHP_WRITE = re.compile(r"(?P<var>\$\w+)\s*(?:=(?![=>])\s*(?P<new>new\s+(?P<class>\\?[\w\\]+))?|(?:[-+*/.%&|^]|\?\?|\*\*|<<|>>)=)|\bas\s+(?:(?P<key>\$\w+)\s*=>\s*)?&?(?P<each>\$\w+)")
_PHP_PARAM = re.compile(r"(?:(?P<hint>\??[\w\\]+(?:\s*[|&]\s*[\w\\]+)*)\s+)?&?(?:\.\.\.)?(?P<var>\$\w+)")


def _ends(code: str, pairs: dict[int, int], at: int) -> int:
    """Where the expression that begins at `at` ends: its block, or the next comma or closing bracket around it."""
    while at < len(code) and code[at].isspace():
        at += 1
    if code[at : at + 1] == "{":
        return pairs.get(at, len(code))
    while at < len(code) and code[at] not in ",;)]}":
        at = pairs[at] + 1 if at in pairs else at + 1
    return at


class _Spans:
    """Spans that lie within or beside each other, by start, with the one around each."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans = sorted(spans)
        self.starts, self.around, open_ = [a for a, _ in self.spans], [], []
        for i, (a, _) in enumerate(self.spans):
            while open_ and self.spans[open_[-1]][1] < a:
                open_.pop()
            self.around.append(open_[-1] if open_ else -1)
            open_.append(i)

    def end(self, at: int) -> int:
        """Where the innermost span around a place ends; -1 if none is around it."""
        i = bisect_left(self.starts, at) - 1
        while i >= 0 and self.spans[i][1] <= at:
            i = self.around[i]
        return self.spans[i][1] if i >= 0 else -1


def _bindings(language: str, code: str, pairs: dict[int, int], blocks: list[Block], out: _Facts) -> None:
    """Local names and where they are visible; for PHP, what variables are given."""
    n = len(code)
    braces = _Spans([(a, b) for a, b in pairs.items() if code[a] == "{"])
    functions = [(params, start, end) for label, params, start, end in blocks if params]
    bodies = _Spans([(start, end) for _, start, end in functions])
    if language == "go":
        for params, start, end in functions:
            parts = [x.split() for x in re.split(r",", code[params[0] + 1 : params[1]])]
            named = any(len(x) > 1 and x[0].isidentifier() and x[0] not in ("func", "map", "chan", "interface", "struct") for x in parts)
            for x in parts if named else []:
                if x and x[0].isidentifier():
                    out.add("binding", "", "param", x[0], start, end)
        for m in re.finditer(r"\bfunc\s*\(\s*(\w+)\s+[^()]*\)\s*\w+", code):  # receivers
            k = bisect_left(functions, ((m.end() - 1, 0), 0, 0))
            if k < len(functions):
                out.add("binding", "", "receiver", m.group(1), functions[k][1], functions[k][2])
        for m in _GO_SHORT.finditer(code):
            if bodies.end(m.start()) < 0:
                continue
            line = max(code.rfind(c, max(0, m.start() - 400), m.start()) for c in "\n;{}") + 1
            head = re.match(r"\s*(?:else\s+)?(?:if|for|switch|select)\b", code[line : m.start() + 1])
            brace = code.find("{", m.end()) if head else -1
            end = pairs.get(brace, n) if brace >= 0 else braces.end(m.start())
            begin = m.end()
            while not head and begin < n and code[begin] not in "\n;}":
                begin = pairs[begin] + 1 if begin in pairs else begin + 1
            for name in _WORDS.findall(m["names"] or m["var"]):
                if name != "_":
                    out.add("binding", "", "short" if m["names"] else "var", name, begin, end)
    elif language == "rust":
        for params, start, end in functions:
            for part in re.findall(r"(?:^|,)\s*(\([^()]*\)|[^:,<>()]+?)\s*:(?!:)", code[params[0] + 1 : params[1]]):
                for name in _WORDS.findall(part):
                    if name not in ("mut", "ref", "self", "_"):
                        out.add("binding", "", "param", name, start, end)
        for m in _RUST_LET.finditer(code):
            if bodies.end(m.start()) < 0:
                continue
            if m["arm"]:
                line = next(_ARM_ENDS.finditer(code[max(0, m.start() - 400) : m.start()][::-1]), None)
                pattern = _GUARD.sub("", code[max(0, m.start() - (line.start() if line else 400)) : m.start()])
            else:
                pattern = m["pat"] or m["for"] or m["args"] or ""
            if m["args"] is not None or m["arm"]:
                begin, end = m.end(), _ends(code, pairs, m.end())
            elif m["if"] or m["for"]:
                brace = code.find("{", m.end())
                begin, end = (brace, pairs.get(brace, n)) if brace >= 0 else (m.end(), n)
            else:
                begin = _ends(code, pairs, m.end()) if m["end"] == "=" else m.end()
                end = braces.end(m.start())
            kind = "closure" if m["args"] is not None else "arm" if m["arm"] else "for" if m["for"] else "let"
            for w in re.finditer(r"(?<![\w:.])([a-z_]\w*)(?!\w|\s*(?:::|\(|\{|!))", re.sub(r":(?!:)[^,|]*", "", pattern)):
                if w.group(1) not in ("mut", "ref", "_", "box", "true", "false", "self", "super", "crate", "if", "else", "return", "match"):
                    out.add("binding", "", kind, w.group(1), begin, end)
    elif language == "php":
        for params, start, end in functions:
            for m in _PHP_PARAM.finditer(code, params[0] + 1, params[1]):
                out.add("write", "", "hint" if m["hint"] else "opaque", m["var"], start + 1, start + 1, target=m["hint"] or "")
        for m in _PHP_WRITE.finditer(code):
            for name in filter(None, (m["var"], m["key"], m["each"])):
                out.add("write", "", "new" if m["new"] else "opaque", name, m.start(), m.end(), target=m["class"] or "")


def _placed(rows: list[Fact], text: str, blocks: list[Block]) -> list[Fact]:
    """Rows with byte offsets instead of those of characters, and the chain of blocks around them."""
    byte = range(len(text) + 1) if text.isascii() else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
    order = sorted(range(len(rows)), key=lambda i: rows[i][7])
    waiting, open_, out = sorted(blocks, key=lambda b: b[2]), [], list(rows)
    k = 0
    for i in order:
        at = rows[i][7]
        while k < len(waiting) and waiting[k][2] < at:
            open_.append(waiting[k])
            k += 1
        open_ = [b for b in open_ if b[3] >= at]
        out[i] = (*rows[i][:7], byte[min(at, len(text))], byte[min(rows[i][8], len(text))], ">".join(b[0] for b in open_))
    return out


def source_facts(files: DataFrame, carried: list[str], language: str, text: str) -> DataFrame:
    """Facts of each source file beside the carried columns. Files are independent: nothing is shuffled."""
    types = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    names = ["fact_kind", "fact_id", "scope", "kind", "name", "target", "level", "byte_start", "byte_end", "chain"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start : start + 512]
                at, rows = [], []
                for i, (lang, body) in enumerate(zip(part["_lang"], part["_text"])):
                    for row in facts_of(lang, body):
                        at.append(i)
                        rows.append(row)
                flat = part.drop(columns=["_lang", "_text"]).iloc[at].reset_index(drop=True)
                yield pd.concat([flat, pd.DataFrame(rows, columns=names)], axis=1)

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carried), FACTS])
    return files.select(*carried, F.col(language).alias("_lang"), F.col(text).cast("string").alias("_text")).mapInPandas(run, schema)


def damages(language: str | None, text: str | None) -> list[tuple[int, int]]:
    """The byte ranges at which a text stops making sense, none for a sound one.

    Python: the runs of lines that must give way for the rest to parse. Go, Rust
    and PHP, strings and comments set aside: lines of merge conflicts and each
    bracket that does not match; other errors of grammar are not seen there.
    """
    if text is None or language is None:
        return []
    if language == "python":
        try:
            _parsed(text)
            return []
        except SyntaxError:
            try:
                lines = sorted(_Repaired(text).damaged)
            except (ValueError, RecursionError, MemoryError):
                return [(0, len(text.encode()))]
        except (ValueError, RecursionError, MemoryError):
            return [(0, len(text.encode()))]
        starts = [0]
        for line in text.encode().splitlines(keepends=True):
            starts.append(starts[-1] + len(line))
        out: list[tuple[int, int]] = []
        for i in lines:
            if out and out[-1][1] == starts[i]:
                out[-1] = (out[-1][0], starts[i + 1])
            else:
                out.append((starts[i], starts[i + 1]))
        return out
    if language not in _BLANK:
        return []
    code, open_, found = _blanked(language, text), [], []
    for m in re.finditer(r"^(?:(?:<{7}|>{7}|\|{7})(?:[ \t\r][^\n]*)?|={7}[ \t\r]*)$", code, re.M):
        found.append((m.start(), m.end()))
        code = code[: m.start()] + " " * (m.end() - m.start()) + code[m.end() :]
    for m in re.finditer(r"[()\[\]{}]", code):
        c = m.group()
        if c in _BRACKETS:
            open_.append((_BRACKETS[c], m.start()))
        elif open_ and open_[-1][0] == c:
            open_.pop()
        else:
            found.append((m.start(), m.end()))
            # What was opened inside of the bracket that this one closes ends with it.
            while any(x == c for x, _ in open_) and open_.pop()[0] != c:
                pass
    if open_:
        found.append((open_[0][1], len(text)))
    return [(len(text[:a].encode()), len(text[:b].encode())) for a, b in sorted(found)]


def recovery_regions(files: DataFrame, carried: list[str], language: str, text: str) -> DataFrame:
    """(carried, status, byte_start, byte_end): one `clean`, or one `recovered` for each damaged range."""
    types = {f.name: f.dataType.simpleString() for f in files.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [damages(lang, body) or [None] for lang, body in zip(pdf["_lang"], pdf["_text"])]
            flat = [f for regions in found for f in regions]
            at = [i for i, regions in enumerate(found) for _ in regions]
            out = pdf.drop(columns=["_lang", "_text"]).iloc[at].reset_index(drop=True)
            out["status"] = ["recovered" if f else "clean" for f in flat]
            out["byte_start"] = pd.array([f[0] if f else None for f in flat], dtype="Int64")
            out["byte_end"] = pd.array([f[1] if f else None for f in flat], dtype="Int64")
            yield out

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carried), "status string, byte_start long, byte_end long"])
    return files.select(*carried, F.col(language).alias("_lang"), F.col(text).cast("string").alias("_text")).mapInPandas(run, schema)

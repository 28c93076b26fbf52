"""Rust, edition 2021. Macro arguments are balanced token trees."""

from __future__ import annotations

from collections.abc import Iterator

from tracewell.llm.syntax.base import AHEAD, Broken, Cursor, master

KEYWORDS = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split()
)
_ESC = r"\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\})"
_TOKEN = master(
    ("open", r"/\*"),
    ("space", r"\s+"),
    ("line", r"//[^\n]*"),
    ("raw", r'(?:br|cr|r)(?P<hash>#*)".*?"(?P=hash)'),
    ("str", rf'[bc]?"(?:[^"\\]|{_ESC}|\\\r?\n)*"'),
    ("char", rf"b?'(?:[^'\\\n\r\t]|{_ESC})'"),
    ("life", r"'(?:[^\W\d]\w*)(?!')"),
    ("rawid", r"r#[^\W\d]\w*"),
    ("id", r"[^\W\d]\w*"),
    ("num", r"0x[0-9a-fA-F_]+\w*|0o[0-7_]+\w*|0b[01_]+\w*|\d[\d_]*(?:\.(?![._]|[^\W\d])[\d_]*)?(?:[eE][+-]?[\d_]*\d[\d_]*)?(?:[^\W\d]\w*)?"),
    ("op", r"<<=|>>=|\.\.\.|\.\.=|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|::|\.\.|[-+*/%^!&|=<>@.,;:#$?~(){}\[\]]"),
)
SUFFIXES = frozenset(["", *"u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64".split()])
OPEN = {"(": ")", "[": "]", "{": "}"}
BINARY = {"||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
_PATH = frozenset(["ID", "self", "Self", "super", "crate"])


def tokens(src: str, out: list[str]) -> Iterator[None]:
    """Appends the tokens of `src` to `out`, pausing after every AHEAD of them."""
    if src.startswith("\ufeff"):
        src = src[1:]
    if src.startswith("#!") and not src[2:].lstrip().startswith("["):
        src = src[src.find("\n") :] if "\n" in src else ""
    pos, n, match, pause = 0, len(src), _TOKEN.match, AHEAD
    doc_at = -1  # tokens before the last outer doc comment
    while pos < n:
        if len(out) >= pause:
            pause = len(out) + AHEAD
            yield
        m = match(src, pos)
        if m is None:
            raise Broken(f"character {pos}")
        kind = m.lastgroup
        if kind == "open":
            pos = m.end()
            if src.startswith("*", pos) and src[pos + 1 : pos + 2] not in ("*", "/"):
                doc_at = len(out)
            depth = 1
            while depth:
                a, b = src.find("/*", pos), src.find("*/", pos)
                if b < 0:
                    raise Broken("comment")
                if 0 <= a < b:
                    depth, pos = depth + 1, a + 2
                else:
                    depth, pos = depth - 1, b + 2
            continue
        text, pos = m.group(kind), m.end()
        if kind in ("space", "line"):
            if text.startswith("///") and not text.startswith("////"):
                doc_at = len(out)
            continue
        if kind == "op":
            out.append(text)
        elif kind == "id":
            if pos < n and src[pos] in '"#' and text not in KEYWORDS:
                raise Broken(f"prefix {text}")
            out.append(text if text in KEYWORDS or text == "_" else "ID")
        elif kind == "rawid":
            out.append("ID")
        elif kind == "life":
            out.append("LIFE")
        elif kind == "num":
            if not _number(text):
                raise Broken(f"number {text}")
            out.append("INT" if text.isdigit() else "NUM")
        else:
            out.append("STR")
    if doc_at == len(out):
        raise Broken("doc comment without item")
    out.append("EOF")


def _number(text: str) -> bool:
    low = text.lower()
    if low.startswith("0x"):
        body = low[2:].replace("_", "")
        digits = body.rstrip("iuszghjklmnopqrtvwxy")
        return bool(body) and all(c in "0123456789abcdef" for c in body.split("u")[0].split("i")[0]) and bool(digits)
    i = 0
    if low[:2] in ("0b", "0o"):
        i = 2
    while i < len(low) and (low[i].isdigit() or low[i] in "_."):
        i += 1
    rest = low[i:]
    if rest[:1] == "e" and i and low[:2] not in ("0b", "0o"):
        rest = rest[1:].lstrip("+-").lstrip("0123456789_")
    return rest in SUFFIXES


class Rust(Cursor):
    def split(self, t: str) -> None:
        """Takes `t` off the front of a longer operator."""
        if self.t == t:
            self.step()
        elif self.t.startswith(t) and self.t not in ("ID",) and not self.t[0].isalpha():
            self.toks[self.i] = self.t = self.t[len(t) :]
        else:
            self.fail(f"needs {t}")

    def at(self, t: str) -> bool:
        return self.t.startswith(t) and self.t not in ("->", "=>")

    def tree(self) -> None:
        """One balanced token tree."""
        if self.t not in OPEN:
            if self.t in (")", "]", "}", "EOF"):
                self.fail("token tree")
            self.step()
            return
        stack = [OPEN[self.step()]]
        while stack:
            t = self.step() if self.t != "EOF" else self.fail("token tree")
            if t in OPEN:
                stack.append(OPEN[t])
            elif t in (")", "]", "}"):
                if t != stack.pop():
                    self.fail("token tree")

    def file(self) -> None:
        while self.t != "EOF":
            self.item()

    def attributes(self) -> None:
        while self.t == "#":
            self.step()
            self.take("!")
            if self.t != "[":
                self.fail("attribute")
            self.tree()

    def visibility(self) -> None:
        if self.take("pub") and self.t == "(" and self.peek() in ("crate", "self", "super", "in"):
            self.step()
            if self.take("in"):
                self.path_plain()
            else:
                self.step()
            self.need(")")

    def path_plain(self) -> None:
        self.take("::")
        while True:
            if self.t not in _PATH:
                self.fail("path")
            self.step()
            if self.t != "::" or self.peek() not in _PATH:
                return
            self.step()

    def item(self) -> None:
        before = self.i
        self.attributes()
        if self.t == "EOF":
            if self.i > before and self.toks[before + 1] != "!":
                self.fail("attribute without item")
            return
        if self.t == ";":
            self.fail("stray ;")
        self.visibility()
        if not self.item_rest():
            self.fail("item")

    def starts_item(self) -> bool:
        t, p = self.t, self.peek()
        if t in ("use", "mod", "struct", "enum", "trait", "impl", "type", "extern", "pub", "fn", "static"):
            return True
        if t == "const":
            return p not in ("{", "move", "|", "||", "async") or (p == "async" and self.peek(2) in ("fn", "unsafe", "extern"))
        if t == "unsafe":
            return p in ("fn", "impl", "trait", "extern", "mod")
        if t == "async":
            return p in ("fn", "unsafe")
        return t == "ID" and (p == "!" and self.peek(2) == "ID")

    def item_rest(self) -> bool:
        t = self.t
        if t == "use":
            self.step()
            self.use_tree()
            self.need(";")
        elif t == "mod" or t == "unsafe" and self.peek() == "mod":
            self.take("unsafe")
            self.step()
            self.need("ID")
            if not self.take(";"):
                self.need("{")
                while self.t != "}":
                    self.item_in("}")
                self.step()
        elif t == "struct":
            self.struct()
        elif t == "enum":
            self.enum()
        elif t == "type":
            self.alias()
        elif t == "static":
            self.step()
            self.take("mut")
            self.need("ID")
            self.need(":")
            self.type()
            if self.take("="):
                self.expr()
            self.need(";")
        elif t == "const" and self.peek() in ("ID", "_", "mut"):
            self.step()
            self.step()
            self.need(":")
            self.type()
            if self.take("="):
                self.expr()
            self.need(";")
        elif t == "trait" or t == "unsafe" and self.peek() == "trait":
            self.take("unsafe")
            self.step()
            self.need("ID")
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            self.members()
        elif t == "impl" or t == "unsafe" and self.peek() == "impl":
            self.take("unsafe")
            self.step()
            if self.t == "<":
                self.generics()
            self.take("const")
            self.take("!")
            self.type()
            if self.take("for"):
                self.type()
            self.where()
            self.members()
        elif t == "extern" and self.peek() == "crate":
            self.step()
            self.step()
            if self.t not in ("ID", "self"):
                self.fail()
            self.step()
            if self.take("as"):
                self.step()
            self.need(";")
        elif (t == "extern" and (self.peek() == "{" or self.peek() == "STR" and self.peek(2) == "{")) or t == "unsafe" and self.peek() == "extern" and self.peek(3) != "fn" and self.peek(2) != "fn":
            self.take("unsafe")
            self.step()
            self.take("STR")
            self.members()
        elif t in ("fn", "const", "async", "unsafe", "extern"):
            self.function()
        elif t == "ID" and self.peek() == "ID" and self.peek(2) in ("{", "<"):  # union
            self.struct()
        elif t in _PATH or t == "::":
            self.macro_item()
        else:
            return False
        return True

    def item_in(self, end: str) -> None:
        self.attributes()
        if self.t == end:
            return
        if self.t == "EOF":
            self.fail()
        self.visibility()
        if not self.item_rest():
            self.fail("item")

    def macro_item(self) -> None:
        self.path_plain()
        self.need("!")
        self.take("ID")
        curly = self.t == "{"
        if self.t not in OPEN:
            self.fail("macro")
        self.tree()
        if not curly:
            self.need(";")

    def use_tree(self) -> None:
        self.take("::")
        while True:
            if self.t == "*":
                self.step()
                return
            if self.t == "{":
                self.step()
                while self.t != "}":
                    self.use_tree()
                    if not self.take(","):
                        break
                self.need("}")
                return
            if self.t not in _PATH:
                self.fail("use")
            self.step()
            if not self.take("::"):
                break
        if self.take("as"):
            if self.t not in ("ID", "_"):
                self.fail("use as")
            self.step()

    def struct(self) -> None:
        self.step()
        self.need("ID")
        self.generics()
        self.where()
        if self.t == "(":
            self.tuple_fields()
            self.where()
            self.need(";")
        elif self.t == "{":
            self.fields()
        else:
            self.need(";")

    def fields(self) -> None:
        self.need("{")
        while self.t != "}":
            self.attributes()
            self.visibility()
            self.need("ID")
            self.need(":")
            self.type()
            if not self.take(","):
                break
        self.need("}")

    def tuple_fields(self) -> None:
        self.need("(")
        while self.t != ")":
            self.attributes()
            self.visibility()
            self.type()
            if not self.take(","):
                break
        self.need(")")

    def enum(self) -> None:
        self.step()
        self.need("ID")
        self.generics()
        self.where()
        self.need("{")
        while self.t != "}":
            self.attributes()
            self.visibility()
            self.need("ID")
            if self.t == "{":
                self.fields()
            elif self.t == "(":
                self.tuple_fields()
            if self.take("="):
                self.expr()
            if not self.take(","):
                break
        self.need("}")

    def alias(self) -> None:
        self.step()
        self.need("ID")
        self.generics()
        if self.take(":"):
            self.bounds()
        self.where()
        if self.take("="):
            self.type()
        self.where()
        self.need(";")

    def members(self) -> None:
        self.need("{")
        while self.t != "}":
            self.attributes()
            if self.t == "}":
                return self.need("}")
            self.visibility()
            t = self.t
            if t == "type":
                self.alias()
            elif t == "const" and self.peek() in ("ID", "_") or t == "static":
                self.item_rest()
            elif t in ("fn", "const", "async", "unsafe", "extern"):
                self.function()
            elif t in _PATH or t == "::":
                self.macro_item()
            else:
                self.fail("member")
        self.step()

    def function(self) -> None:
        for q in ("const", "async", "unsafe"):
            self.take(q)
        if self.take("extern"):
            self.take("STR")
        self.need("fn")
        self.need("ID")
        self.generics()
        self.need("(")
        first = True
        while self.t != ")":
            self.attributes()
            if self.t == "...":
                self.step()
            elif first and self.receives():
                self.receiver()
            else:
                self.pattern_one()
                self.need(":")
                if not self.take("..."):
                    self.type()
            first = False
            if not self.take(","):
                break
        self.need(")")
        if self.take("->"):
            self.type()
        self.where()
        if not self.take(";"):
            self.block()

    def receives(self) -> bool:
        k = 1 if self.t == "&" else 0
        k += k and self.peek(k) == "LIFE"
        k += self.peek(k) == "mut" if k else self.t == "mut"
        return (self.peek(k) if k else self.t) == "self"

    def receiver(self) -> None:
        if self.t == "&":
            self.step()
            self.take("LIFE")
        self.take("mut")
        self.need("self")
        if self.take(":"):
            self.type()

    def generics(self) -> None:
        if self.t != "<":
            return
        self.step()
        while not self.at(">"):
            self.attributes()
            if self.take("LIFE"):
                if self.take(":"):
                    self.bounds()
            elif self.take("const"):
                self.need("ID")
                self.need(":")
                self.type()
                if self.take("="):
                    self.const_arg()
            else:
                self.need("ID")
                if self.take(":"):
                    self.bounds()
                if self.take("="):
                    self.type()
            if not self.take(","):
                break
        self.split(">")

    def where(self) -> None:
        if not self.take("where"):
            return
        while self.t not in ("{", ";", "=", "EOF"):
            if self.take("LIFE"):
                self.need(":")
                self.bounds()
            else:
                if self.t == "for":
                    self.binder()
                self.type()
                self.need(":")
                self.bounds()
            if not self.take(","):
                break

    def binder(self) -> None:
        self.need("for")
        if self.t != "<":
            self.fail("binder")
        self.generics()

    def bounds(self) -> None:
        while True:
            if self.t in ("{", ";", ",", "=", ">", ")", "where") or self.at(">"):
                return
            self.bound()
            if not self.take("+"):
                return

    def bound(self) -> None:
        if self.take("LIFE"):
            return
        if self.t == "(":
            self.step()
            self.bound()
            self.need(")")
            return
        self.take("?")
        if self.t == "for":
            self.binder()
        self.type_path()

    def const_arg(self) -> None:
        if self.t == "{":
            self.block()
        else:
            self.take("-")
            if self.t in ("INT", "NUM", "STR", "true", "false", "ID"):
                self.step()
            else:
                self.fail("const argument")

    def generic_args(self) -> None:
        self.split("<")
        while not self.at(">"):
            if self.take("LIFE"):
                pass
            elif self.t in ("INT", "NUM", "STR", "true", "false", "{", "-"):
                self.const_arg()
            else:
                self.type()
                if self.t == "=":
                    self.step()
                    if self.t in ("INT", "NUM", "STR", "true", "false", "{", "-"):
                        self.const_arg()
                    else:
                        self.type()
                elif self.take(":"):
                    self.bounds()
            if not self.take(","):
                break
        self.split(">")

    def type_path(self) -> None:
        if self.at("<"):
            self.qualified()
        else:
            self.take("::")
            self.type_segment()
        while self.t == "::":
            self.step()
            if self.at("<"):
                self.generic_args()
            else:
                self.type_segment()

    def qualified(self) -> None:
        self.split("<")
        self.type()
        if self.take("as"):
            self.type_path()
        self.split(">")
        if self.t != "::":
            self.fail("qualified path")

    def type_segment(self) -> None:
        if self.t not in _PATH:
            self.fail("type")
        self.step()
        if self.t == "::" and (self.peek() == "<" or self.peek() == "<<" or self.peek() == "("):
            self.step()
        if self.at("<") and self.t not in ("<=", "<<="):
            self.generic_args()
        elif self.t == "(":
            self.step()
            while self.t != ")":
                self.type()
                if not self.take(","):
                    break
            self.need(")")
            if self.take("->"):
                self.type(False)

    def type(self, sums: bool = True) -> None:
        t = self.t
        if t == "(":
            self.step()
            while self.t != ")":
                self.type()
                if not self.take(","):
                    break
            self.need(")")
        elif t == "[":
            self.step()
            self.type()
            if self.take(";"):
                self.expr()
            self.need("]")
        elif t in ("&", "&&"):
            self.step()
            self.take("LIFE")
            self.take("mut")
            self.type(False)
        elif t == "*":
            self.step()
            if self.t not in ("const", "mut"):
                self.fail("pointer")
            self.step()
            self.type(False)
        elif t in ("!", "_"):
            self.step()
        elif t in ("impl", "dyn"):
            self.step()
            self.bounds()
        elif t in ("fn", "unsafe", "extern"):
            self.take("unsafe")
            if self.take("extern"):
                self.take("STR")
            self.need("fn")
            self.need("(")
            while self.t != ")":
                self.attributes()
                if self.t in ("ID", "_") and self.peek() == ":":
                    self.step()
                    self.step()
                if not self.take("..."):
                    self.type()
                if not self.take(","):
                    break
            self.need(")")
            if self.take("->"):
                self.type(False)
        elif t == "for":
            self.binder()
            self.type()
        else:
            self.type_path()
            if self.t == "!" and self.peek() in OPEN:
                self.step()
                self.tree()

    # patterns

    def pattern(self) -> None:
        self.take("|")
        self.pattern_one()
        while self.take("|"):
            self.pattern_one()

    def pattern_one(self) -> None:
        t = self.t
        if t in ("_", ".."):
            self.step()
            if t == ".." and self.t in ("INT", "NUM", "STR"):
                self.step()
            return
        if t == "..=":
            self.step()
            self.range_end()
            return
        if t in ("INT", "NUM", "STR", "true", "false", "-"):
            self.literal()
            self.pattern_range()
            return
        if t in ("&", "&&"):
            self.step()
            self.take("mut")
            self.pattern_one()
            return
        if t in ("(", "["):
            end = OPEN[self.step()]
            while self.t != end:
                self.attributes()
                self.pattern()
                if not self.take(","):
                    break
            self.need(end)
            return
        if t in ("ref", "mut"):
            self.take("ref")
            self.take("mut")
            if self.t not in ("ID", "self"):
                self.fail("binding")
            self.step()
            if self.take("@"):
                self.pattern_one()
            return
        if t == "const" and self.peek() == "{":
            self.step()
            self.block()
            return
        if t == "ID" and self.peek() == "@":
            self.step()
            self.step()
            self.pattern_one()
            return
        self.expr_path()
        if self.t == "!":
            self.step()
            self.tree()
        elif self.t == "(":
            self.step()
            while self.t != ")":
                self.pattern()
                if not self.take(","):
                    break
            self.need(")")
        elif self.t == "{":
            self.step()
            while self.t != "}":
                self.attributes()
                if self.take(".."):
                    break
                if self.t in ("ID", "INT") and self.peek() == ":":
                    self.step()
                    self.step()
                    self.pattern()
                else:
                    self.take("ref")
                    self.take("mut")
                    self.need("ID")
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.pattern_range()

    def literal(self) -> None:
        if self.take("-") and self.t not in ("INT", "NUM"):
            self.fail("literal")
        self.step()

    def pattern_range(self) -> None:
        if self.t in ("..=", "..."):
            self.step()
            self.range_end()
        elif self.t == "..":
            self.step()
            if self.t in ("INT", "NUM", "STR", "-") or self.t in _PATH:
                self.range_end()

    def range_end(self) -> None:
        if self.t in ("INT", "NUM", "STR", "-"):
            self.literal()
        else:
            self.expr_path()

    # statements and expressions

    def block(self) -> None:
        self.need("{")
        while self.t != "}":
            self.statement()
        self.step()

    def statement(self) -> None:
        self.attributes()
        if self.take(";"):
            return
        if self.t == "}":
            return
        if self.t == "let":
            self.step()
            self.pattern()
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expr()
                if self.take("else"):
                    self.block()
            self.need(";")
            return
        if self.starts_item():
            self.visibility()
            if self.t == "ID" and self.peek() == "!":
                self.macro_item()
            elif not self.item_rest():
                self.fail("item")
            return
        if self.t == "ID" and self.peek() == "ID" and self.peek(2) in ("{", "<"):
            self.struct()
            return
        at = self.i
        kind = self.block_like()
        if kind:
            if self.t in (".", "?"):
                self.suffixes("block", True)
                self.operators(0, True)
            elif self.take(";") or True:
                return
        else:
            if self.t in _PATH and self._macro_ahead():
                self.expr_path()
                self.step()
                curly = self.t == "{"
                self.tree()
                if curly and self.t not in (".", "?"):
                    self.take(";")
                    return
                self.suffixes("other", True)
                self.operators(0, True)
            else:
                self.expr()
        if self.t != "}":
            self.need(";")
        if self.i == at:
            self.fail("statement")

    def _macro_ahead(self) -> bool:
        k = 1
        while self.peek(k) == "::" and self.peek(k + 1) in _PATH:
            k += 2
        return self.peek(k) == "!" and self.peek(k + 1) in OPEN

    def block_like(self) -> bool:
        t = self.t
        if t == "LIFE" and self.peek() == ":":
            self.step()
            self.step()
            if self.t not in ("loop", "while", "for", "{"):
                self.fail("label")
            t = self.t
        if t == "{":
            self.block()
        elif t == "unsafe" and self.peek() == "{" or t == "const" and self.peek() == "{":
            self.step()
            self.block()
        elif t == "async" and (self.peek() == "{" or self.peek() == "move" and self.peek(2) == "{"):
            self.step()
            self.take("move")
            self.block()
        elif t == "if":
            self.if_()
        elif t == "while":
            self.step()
            self.expr(False)
            self.block()
        elif t == "loop":
            self.step()
            self.block()
        elif t == "for":
            self.step()
            self.pattern()
            self.need("in")
            self.expr(False)
            self.block()
        elif t == "match":
            self.step()
            self.expr(False)
            self.need("{")
            while self.t != "}":
                self.arm()
            self.step()
        else:
            return False
        return True

    def if_(self) -> None:
        self.need("if")
        self.expr(False)
        self.block()
        if self.take("else"):
            if self.t == "if":
                self.if_()
            else:
                self.block()

    def arm(self) -> None:
        while self.t == "#":
            self.attributes()
        self.pattern()
        if self.take("if"):
            self.expr()
        self.need("=>")
        at_block = self.t == "{"
        if at_block:
            self.block()
            if self.take(",") or self.t == "}":
                return
            if self.t in (".", "?"):
                self.suffixes("block", True)
                self.operators(0, True)
            else:
                return
        else:
            start = self.t
            self.expr()
            if start in ("if", "match", "loop", "while", "for", "unsafe") and self.toks[self.i - 1] == "}" and self.t not in (",", "}"):
                return
        if self.t != "}":
            self.need(",")

    def expr(self, structs: bool = True) -> None:
        self.operand_expr(structs)
        self.operators(0, structs)

    def operators(self, least: int, structs: bool) -> None:
        """The rest of an expression after its first operand."""
        compared = False
        while True:
            t = self.t
            if t == "as":
                self.step()
                self.type(False)
                continue
            if t in ASSIGN and least <= 0:
                self.step()
                self.expr(structs)
                return
            if t in ("..", "..=") and least <= 1:
                self.step()
                if self.starts_expr(structs):
                    self.operand_expr(structs)
                    self.operators(2, structs)
                elif t == "..=":
                    self.fail("range")
                if least <= 0 and self.t in ASSIGN:
                    continue
                return
            p = BINARY.get(t, 0)
            if not p or p < least:
                return
            if p == 4:
                if compared:
                    self.fail("chained comparison")
                compared = True
            elif p < 4:
                compared = False
            self.step()
            self.operand_expr(structs)
            self.operators(p + 1, structs)

    def starts_expr(self, structs: bool) -> bool:
        t = self.t
        if t == "{":
            return structs
        return t in ("INT", "NUM", "STR", "true", "false", "(", "[", "-", "*", "!", "&", "&&", "|", "||", "<", "::", "LIFE", "if", "match", "loop", "while", "for", "unsafe", "move", "async", "return", "break", "continue", "const") or t in _PATH

    def operand_expr(self, structs: bool) -> None:
        t = self.t
        if t == "#":
            self.attributes()
            t = self.t
        if t in ("-", "*", "!"):
            self.step()
            return self.operand_expr(structs)
        if t in ("&", "&&"):
            self.step()
            self.take("mut")
            return self.operand_expr(structs)
        if t in ("..", "..="):
            self.step()
            if self.starts_expr(structs):
                self.operand_expr(structs)
                self.operators(2, structs)
            elif t == "..=":
                self.fail("range")
            return
        if t in ("|", "||", "move", "static") or t == "async" and self.peek() in ("|", "||", "move") and not (self.peek() == "move" and self.peek(2) == "{"):
            return self.closure(structs)
        if t in ("return", "break"):
            self.step()
            if t == "break":
                self.take("LIFE")
            if self.starts_expr(structs):
                self.expr(structs)
            return
        if t == "continue":
            self.step()
            self.take("LIFE")
            return
        if t == "let":
            self.step()
            self.pattern()
            self.need("=")
            self.operand_expr(False)
            self.operators(4, False)
            return
        self.suffixes(self.primary(structs), structs)

    def closure(self, structs: bool) -> None:
        self.take("static")
        self.take("async")
        self.take("move")
        if not self.take("||"):
            self.need("|")
            while self.t != "|":
                self.attributes()
                self.pattern_one()
                if self.take(":"):
                    self.type()
                if not self.take(","):
                    break
            self.need("|")
        if self.take("->"):
            self.type()
            self.block()
        else:
            self.expr(structs)

    def primary(self, structs: bool) -> str:
        t = self.t
        if t in ("INT", "NUM", "STR", "true", "false"):
            self.step()
            return "other"
        if t == "(":
            self.step()
            while self.t != ")":
                self.expr()
                if not self.take(","):
                    break
            self.need(")")
            return "other"
        if t == "[":
            self.step()
            if self.t != "]":
                self.expr()
                if self.take(";"):
                    self.expr()
                else:
                    while self.take(","):
                        if self.t == "]":
                            break
                        self.expr()
            self.need("]")
            return "other"
        if self.block_like():
            return "block"
        self.expr_path()
        if self.t == "!" and self.peek() in OPEN:
            self.step()
            self.tree()
        elif self.t == "{" and structs:
            self.struct_literal()
        return "other"

    def struct_literal(self) -> None:
        self.need("{")
        while self.t != "}":
            self.attributes()
            if self.take(".."):
                if self.t != "}":
                    self.expr()
                break
            if self.t not in ("ID", "INT"):
                self.fail("field")
            self.step()
            if self.take(":"):
                self.expr()
            if not self.take(","):
                break
        self.need("}")

    def expr_path(self) -> None:
        if self.at("<") and self.t in ("<", "<<"):
            self.qualified()
        else:
            self.take("::")
            if self.t not in _PATH:
                self.fail("expression")
            self.step()
        while self.t == "::":
            self.step()
            if self.at("<"):
                self.generic_args()
            elif self.t in _PATH:
                self.step()
            else:
                self.fail("path")

    def suffixes(self, kind: str, structs: bool) -> None:
        while True:
            t = self.t
            if t == "?":
                self.step()
            elif t == ".":
                self.step()
                if self.t in ("INT", "NUM", "await"):
                    self.step()
                else:
                    self.need("ID")
                    if self.t == "::":
                        self.step()
                        self.generic_args()
                        if self.t != "(":
                            self.fail("turbofish")
            elif t == "(":
                self.step()
                while self.t != ")":
                    self.expr()
                    if not self.take(","):
                        break
                self.need(")")
            elif t == "[":
                self.step()
                self.expr()
                self.need("]")
            else:
                return


def check(src: str) -> None:
    """Raises Broken unless `src` is a Rust source file."""
    read: list[str] = []
    Rust(read, tokens(src, read)).file()

"""Go."""

from __future__ import annotations

import re
from collections.abc import Iterator

from tracewell.llm.syntax.base import AHEAD, Broken, Cursor, master

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ESC = r"\\(?:[abfnrtv\\]|[0-3][0-7]{2}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_TOKEN = master(
    ("space", r"[ \t\r]+"),
    ("nl", r"\n"),
    ("line", r"//[^\n]*"),
    ("block", r"/\*.*?\*/"),
    ("id", r"[^\W\d]\w*"),
    ("num", r"0[xX](?:_?[0-9a-fA-F])*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d[\d_]*)?i?|0[bB](?:_?[01])+i?|0[oO](?:_?[0-7])+i?|(?:\d[\d_]*\.[\d_]*|\.\d[\d_]*|\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?i?"),
    ("str", rf'"(?:[^"\\\n]|{_ESC}|\\")*"'),
    ("raw", r"`[^`]*`"),
    ("rune", rf"'(?:[^'\\\n]|{_ESC}|\\')'"),
    ("op", r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~]"),
)
_ENDS = frozenset(["ID", "LIT", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())


def tokens(src: str, out: list[str]) -> Iterator[None]:
    """Appends the tokens of `src` to `out`, pausing after every AHEAD of them."""
    if src.startswith("\ufeff"):
        src = src[1:]
    if "\0" in src:
        raise Broken("NUL")
    pos, n, match, pause = 0, len(src), _TOKEN.match, AHEAD
    while pos < n:
        if len(out) >= pause:
            pause = len(out) + AHEAD
            yield
        m = match(src, pos)
        if m is None:
            raise Broken(f"character {pos}")
        kind, pos = m.lastgroup, m.end()
        if kind == "space" or kind == "line":
            continue
        if kind == "nl" or kind == "block":
            if (kind == "nl" or "\n" in m.group()) and out and out[-1] in _ENDS:
                out.append(";")
            continue
        text = m.group()
        if kind == "id":
            out.append(text if text in KEYWORDS else "ID")
        elif kind == "op":
            out.append(text)
        elif kind == "str" or kind == "raw":
            out.append("STR")
        else:
            if kind == "num" and (pos < n and (src[pos].isalnum() or src[pos] == "_") or re.fullmatch(r"0\d*[89]\d*", text)):
                raise Broken("number")
            out.append("LIT")
    if out and out[-1] in _ENDS:
        out.append(";")
    out.append("EOF")


class Go(Cursor):
    def __init__(self, src: str) -> None:
        read: list[str] = []
        super().__init__(read, tokens(src, read))
        self.level = 0

    def semi(self) -> None:
        if self.t not in (")", "}"):
            self.need(";")

    def file(self) -> None:
        self.need("package")
        self.need("ID")
        self.need(";")
        while self.t == "import":
            self.step()
            self.group(self.import_spec)
            self.need(";")
        while self.t != "EOF":
            self.declaration(True)
            if self.t != "EOF":
                self.need(";")

    def group(self, spec) -> None:
        if self.take("("):
            while self.t != ")":
                spec()
                self.semi()
            self.step()
        else:
            spec()

    def import_spec(self) -> None:
        if self.t in ("ID", "."):
            self.step()
        self.need("STR")

    def declaration(self, top: bool) -> None:
        t = self.t
        if t == "const":
            self.step()
            self.group(self.const_spec)
        elif t == "var":
            self.step()
            self.group(self.var_spec)
        elif t == "type":
            self.step()
            self.group(self.type_spec)
        elif t == "func" and top:
            self.step()
            if self.t == "(":
                self.params()
            self.need("ID")
            if self.t == "[":
                self.type_params()
            self.signature()
            if self.t == "{":
                self.body()
        else:
            self.fail()

    def ids(self) -> None:
        self.need("ID")
        while self.take(","):
            self.need("ID")

    def const_spec(self) -> None:
        self.ids()
        if self.t not in ("=", ";", ")"):
            self.type()
        if self.take("="):
            self.exprs()

    def var_spec(self) -> None:
        self.ids()
        if self.take("="):
            self.exprs()
            return
        self.type()
        if self.take("="):
            self.exprs()

    def type_spec(self) -> None:
        self.need("ID")
        if self.t == "[" and self.peek() == "ID" and self.attempt(self._generic_spec):
            return
        self.take("=")
        self.type()

    def _generic_spec(self) -> None:
        self.type_params()
        self.take("=")
        self.type()

    def type_params(self) -> None:
        self.need("[")
        while True:
            self.ids()
            self.constraint()
            if not self.take(",") or self.t == "]":
                break
        self.need("]")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def type(self) -> None:
        if not self.try_type():
            self.fail("type")

    def try_type(self) -> bool:
        t = self.t
        if t == "ID":
            self.step()
            if self.t == "." and self.peek() == "ID":
                self.step()
                self.step()
            if self.t == "[" and self.peek() != "]":
                self.attempt(self._type_args)
        elif t == "*":
            self.step()
            self.type()
        elif t == "[":
            self.step()
            if not self.take("]"):
                self.level += 1
                if not self.take("..."):
                    self.expr()
                self.level -= 1
                self.need("]")
            self.type()
        elif t == "map":
            self.step()
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif t == "chan":
            self.step()
            self.take("<-")
            self.type()
        elif t == "<-":
            self.step()
            self.need("chan")
            self.type()
        elif t == "func":
            self.step()
            self.signature()
        elif t == "struct":
            self.struct()
        elif t == "interface":
            self.interface()
        elif t == "(":
            self.step()
            self.type()
            self.need(")")
        else:
            return False
        return True

    def _type_args(self) -> None:
        self.need("[")
        while True:
            self.type()
            if not self.take(",") or self.t == "]":
                break
        self.need("]")

    def struct(self) -> None:
        self.need("struct")
        self.need("{")
        while self.t != "}":
            if self.t == "*":
                self.type()
            else:
                if self.t != "ID":
                    self.fail("field")
                after = self.peek()
                if after in (".", "STR", ";", "}"):
                    self.type()
                elif after == "[" and not self.attempt(self._array_field):
                    self.type()
                elif after != "[":
                    self.ids()
                    self.type()
            self.take("STR")
            self.semi()
        self.step()

    def _array_field(self) -> None:
        self.ids()
        self.type()

    def interface(self) -> None:
        self.need("interface")
        self.need("{")
        while self.t != "}":
            if self.t == "ID" and self.peek() == "(":
                self.step()
                self.signature()
            else:
                self.constraint()
            self.semi()
        self.step()

    def signature(self) -> None:
        self.params()
        if self.t == "(":
            self.params()
        else:
            self.try_type()

    def params(self) -> None:
        self.need("(")
        named, plain, last = 0, [], False
        while self.t != ")":
            at = self.i
            if self.take("..."):
                self.type()
                plain.append(False)
                last = False
            else:
                self.type()
                single = self.i == at + 1 and self.toks[at] == "ID"
                if self.t in (",", ")"):
                    plain.append(single)
                    last = False
                else:
                    # `name [N]T` reads as a generic type first
                    if not single:
                        self.back(at)
                        self.need("ID")
                    self.take("...")
                    self.type()
                    named += 1
                    last = True
            if not self.take(","):
                break
        self.need(")")
        if named and (not last or not all(plain)):
            self.fail("mixed parameters")

    def body(self) -> None:
        level, self.level = self.level, 0
        self.block()
        self.level = level

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while self.t not in ("}", "case", "default", "EOF"):
            self.statement()
            if self.t not in ("}", "case", "default"):
                self.need(";")

    def statement(self) -> None:
        t = self.t
        if t == ";":
            return
        if t in ("const", "var", "type"):
            self.declaration(False)
        elif t == "{":
            self.block()
        elif t == "if":
            self.if_()
        elif t == "for":
            self.for_()
        elif t == "switch":
            self.switch()
        elif t == "select":
            self.step()
            self.need("{")
            while self.t in ("case", "default"):
                if self.step() == "case":
                    self.simple()
                self.need(":")
                self.statements()
            self.need("}")
        elif t == "return":
            self.step()
            if self.t not in (";", "}"):
                self.exprs()
        elif t in ("break", "continue"):
            self.step()
            self.take("ID")
        elif t == "goto":
            self.step()
            self.need("ID")
        elif t == "fallthrough":
            self.step()
        elif t in ("go", "defer"):
            self.step()
            if self.expr() != "call":
                self.fail("call")
        elif t == "ID" and self.peek() == ":":
            self.step()
            self.step()
            if self.t not in ("}", "case", "default"):
                self.statement()
        else:
            self.simple()

    def simple(self, ranges: bool = False) -> str:
        if ranges and self.t == "range":
            self.step()
            self.expr()
            return "range"
        single = self.exprs() == 1
        t = self.t
        if t == ":=" or t in ASSIGN:
            self.step()
            if ranges and self.t == "range" and t in (":=", "="):
                self.step()
                self.expr()
                return "range"
            if self.exprs() > 1 and t not in (":=", "="):
                self.fail()
            return "assign"
        if not single:
            self.fail("list")
        if t in ("++", "--"):
            self.step()
            return "step"
        if t == "<-":
            self.step()
            self.expr()
            return "send"
        return "expr"

    def if_(self) -> None:
        self.need("if")
        level, self.level = self.level, -1
        kind = None
        if self.t != ";":
            kind = self.simple()
        if self.take(";"):
            kind = self.simple()
        self.level = level
        if kind != "expr":
            self.fail("condition")
        self.block()
        if self.take("else"):
            if self.t == "if":
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.need("for")
        level, self.level = self.level, -1
        if self.t != "{":
            kind = "none"
            if self.t != ";":
                kind = self.simple(True)
            if kind != "range":
                if self.t == ";":
                    self.step()
                    if self.t != ";":
                        if self.t == "{":
                            self.fail("for clause")
                        if self.simple() != "expr":
                            self.fail("condition")
                    self.need(";")
                    if self.t != "{":
                        self.simple()
                elif kind != "expr":
                    self.fail("condition")
        self.level = level
        self.block()

    def switch(self) -> None:
        self.need("switch")
        level, self.level = self.level, -1
        if self.t != "{":
            if self.t != ";":
                self.simple()
            if self.take(";") and self.t != "{":
                self.simple()
        self.level = level
        self.need("{")
        while self.t in ("case", "default"):
            if self.step() == "case":
                self.exprs()
            self.need(":")
            self.statements()
        self.need("}")

    def exprs(self) -> int:
        n = 1
        self.expr()
        while self.take(","):
            self.expr()
            n += 1
        return n

    def expr(self, least: int = 1) -> str:
        kind = self.unary()
        while (p := BINARY.get(self.t, 0)) >= least:
            self.step()
            self.expr(p + 1)
            kind = "other"
        return kind

    def unary(self) -> str:
        if self.t == "<-" and self.peek() == "chan":
            self.type()
            return self.suffixes("other")
        if self.t in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            self.step()
            self.unary()
            return "other"
        return self.suffixes(self.operand())

    def operand(self) -> str:
        t = self.t
        if t == "ID":
            self.step()
            return "name"
        if t in ("LIT", "STR"):
            self.step()
            return "other"
        if t == "(":
            self.step()
            self.level += 1
            self.expr()
            self.level -= 1
            self.need(")")
            return "other"
        if t == "func":
            self.type()
            if self.t == "{":
                self.body()
            return "other"
        if t in ("[", "map", "struct"):
            self.type()
            return "type"
        if t in ("chan", "interface"):
            self.type()
            return "other"
        self.fail("operand")
        return ""

    def suffixes(self, kind: str) -> str:
        while True:
            t = self.t
            if t == ".":
                self.step()
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                    kind = "other"
                else:
                    self.need("ID")
                    kind = "name" if kind == "name" else "other"
            elif t == "[":
                self.index()
            elif t == "(":
                self.step()
                self.level += 1
                while self.t != ")":
                    self.expr()
                    self.take("...")
                    if not self.take(","):
                        break
                self.level -= 1
                self.need(")")
                kind = "call"
            elif t == "{" and (kind == "type" or kind == "name" and self.level >= 0):
                self.literal()
                kind = "other"
            else:
                return kind

    def index(self) -> None:
        self.need("[")
        self.level += 1
        colons = 0
        if self.t == "]":
            self.fail("index")
        if self.t != ":":
            self.expr()
            while self.take(","):
                if self.t == "]":
                    break
                self.expr()
        while self.t == ":" and colons < 2:
            self.step()
            colons += 1
            if self.t not in (":", "]"):
                self.expr()
            elif colons == 2 or self.t == ":":
                self.fail("slice")
        self.level -= 1
        self.need("]")

    def literal(self) -> None:
        self.need("{")
        self.level += 1
        while self.t != "}":
            self.element()
            if self.take(":"):
                self.element()
            if not self.take(","):
                break
        self.level -= 1
        self.need("}")

    def element(self) -> None:
        if self.t == "{":
            self.literal()
        else:
            self.expr()


def check(src: str) -> None:
    """Raises Broken unless `src` is a Go source file."""
    Go(src).file()

"""PHP 8. Text outside the tags is valid."""

from __future__ import annotations

import re

from tracewell.llm.syntax.base import Broken, Cursor, master

KEYWORDS = frozenset(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile eval exit die extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield __halt_compiler".split()
)
#: Words that name things although they mean something in their own place.
SOFT = frozenset(["enum", "self", "parent", "readonly", "from"])
_TOKEN = master(
    ("space", r"\s+"),
    ("close", r"\?>\n?"),
    ("line", r"(?://|#(?!\[))(?:(?!\?>)[^\n])*"),
    ("block", r"/\*.*?\*/"),
    ("var", r"\$[a-zA-Z_\x80-\U0010ffff][\w\x80-\U0010ffff]*"),
    ("name", r"(?:\\?[a-zA-Z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)(?:\\[a-zA-Z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*(?:\\(?=\s*\{))?"),
    ("num", r"0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*|(?:\d+(?:_\d+)*)?\.\d+(?:_\d+)*(?:[eE][+-]?\d+)?|\d+(?:_\d+)*\.?(?:[eE][+-]?\d+)?"),
    ("single", r"b?'(?:[^'\\]|\\.)*'"),
    ("heredoc", r"<<<[ \t]*(?P<hq>['\"]?)(?P<hid>[a-zA-Z_]\w*)(?P=hq)\r?\n"),
    ("cast", r"\([ \t]*(?:int|integer|float|double|real|string|binary|bool|boolean|array|object|unset)[ \t]*\)"),
    ("op", r"\?\?=|\?->|<=>|\*\*=|\.\.\.|<<=|>>=|===|!==|#\[|\+\+|--|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\?\?|<<|>>|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|\*\*|[-+*/%=<>!.,;:?()\[\]{}&|^~@$]"),
)
_NAME = re.compile(r"[a-zA-Z_\x80-\U0010ffff][\w\x80-\U0010ffff]*")
_SIMPLE_INDEX = re.compile(r"\[(?:-?\d+|\$?[a-zA-Z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)\]")
#: What means nothing within a quoted string.
_PLAIN = re.compile(r"[^\\\"`${]*")
_OPEN_TAG = re.compile(r"<\?(?:php(?=\s|$)|=)", re.I)


class Lexer:
    def __init__(self, src: str) -> None:
        self.src = src
        self.out: list[str] = []

    def run(self) -> list[str]:
        pos, src = 0, self.src
        while True:
            m = _OPEN_TAG.search(src, pos)
            if m is None:
                if pos < len(src):
                    self.out.append("HTML")
                break
            if m.start() > pos:
                self.out.append("HTML")
            if m.group().endswith("="):
                self.out.append("echo")
            pos = self.code(m.end(), None)
        self.out.append("EOF")
        return self.out

    def code(self, pos: int, until: str | None) -> int:
        """Tokens from `pos` to a closing tag, or to the brace that ends an interpolation."""
        src, out, n, match, depth = self.src, self.out, len(self.src), _TOKEN.match, 0
        while pos < n:
            if src[pos] == '"' or src[pos] == "`" or src.startswith('b"', pos):
                quote = src[pos + (src[pos] == "b")]
                pos = self.quoted(pos + 1 + (src[pos] == "b"), quote)
                continue
            m = match(src, pos)
            if m is None:
                raise Broken(f"character {pos}")
            kind, text = m.lastgroup, m.group()
            if m["heredoc"]:
                pos = self.heredoc(m)
                continue
            pos = m.end()
            if kind == "close":
                if until:
                    raise Broken("closing tag in a string")
                if out and out[-1] not in (";", "HTML"):
                    out.append(";")
                elif not out:
                    out.append(";")
                return pos
            if kind in ("space", "line", "block"):
                continue
            if kind == "name":
                low = text.lower()
                prior = out[-1] if out else ""
                if prior in ("->", "?->") and "\\" not in text:
                    out.append("ID")
                elif low in KEYWORDS and not (prior == "::" and low != "class"):
                    out.append(low)
                    if low == "__halt_compiler":
                        raise Broken("halt")
                elif low in ("enum", "self", "parent", "from", "null", "true", "false"):
                    out.append("ID" if low in ("null", "true", "false", "self", "parent") else low)
                else:
                    out.append("ID" if "\\" not in text else "QID")
            elif kind == "var":
                out.append("VAR")
            elif kind == "num":
                if pos < n and (src[pos].isalpha() or src[pos] == "_"):
                    out.append("LIT")  # what follows is a name, which the grammar refuses
                    continue
                if re.fullmatch(r"0\d*[89]\d*", text):
                    raise Broken("octal")
                out.append("LIT")
            elif kind == "single":
                out.append("STR")
            elif kind == "cast":
                out.append("CAST")
            else:
                if until:
                    if text == "{":
                        depth += 1
                    elif text == "}":
                        if depth == 0:
                            return pos
                        depth -= 1
                out.append(text)
        if until:
            raise Broken("interpolation")
        if out and out[-1] not in (";", "}", ":") or not out:
            out.append("END")
        return pos

    def variable(self, pos: int) -> int:
        """A simple interpolation that begins at `pos` with `$`."""
        src = self.src
        m = _NAME.match(src, pos + 1)
        if m is None:
            return pos + 1
        pos = m.end()
        if src.startswith("[", pos):
            i = _SIMPLE_INDEX.match(src, pos)
            if i is None:
                raise Broken("index in a string")
            return i.end()
        if src.startswith("->", pos) and _NAME.match(src, pos + 2):
            return _NAME.match(src, pos + 2).end()
        if src.startswith("?->", pos) and _NAME.match(src, pos + 3):
            return _NAME.match(src, pos + 3).end()
        return pos

    def embedded(self, pos: int) -> int:
        """`{$ ... }` or `${ ... }`: its tokens as an expression of their own."""
        self.out.append("{")
        pos = self.code(pos, "}")
        self.out.append("}")
        return pos

    def quoted(self, pos: int, quote: str) -> int:
        src, n = self.src, len(self.src)
        self.out.append("STR(")
        while pos < n:
            c = src[pos]
            if c == "\\":
                if src.startswith("\\u{", pos) and quote == '"' and not re.match(r"\\u\{[0-9a-fA-F]{1,6}\}", src[pos : pos + 12]):
                    raise Broken("escape")
                pos += 2
            elif c == quote:
                self.out.append("STR)")
                return pos + 1
            elif src.startswith("{$", pos):
                pos = self.embedded(pos + 1)
            elif src.startswith("${", pos):
                pos = self.embedded(pos + 2)
            elif c == "$":
                pos = self.variable(pos)
            else:
                pos = _PLAIN.match(src, pos + 1).end()
        raise Broken("string")

    def heredoc(self, m: re.Match[str]) -> int:
        src, name, raw = self.src, m["hid"], m["hq"] == "'"
        end = re.compile(rf"(?:^|(?<=\n))([ \t]*){name}(?![\w\x80-\U0010ffff])")
        close = end.search(src, m.end())
        pos = m.end()
        self.out.append("STR(")
        if not raw:
            while close is not None and pos < close.start():
                c = src[pos]
                if c == "\\":
                    pos += 2
                elif src.startswith("{$", pos):
                    pos = self.embedded(pos + 1)
                elif src.startswith("${", pos):
                    pos = self.embedded(pos + 2)
                elif c == "$":
                    pos = self.variable(pos)
                else:
                    pos += 1
                if pos > close.start():
                    close = end.search(src, pos)
        if close is None:
            raise Broken("heredoc")
        indent = close[1]
        if indent:
            for line in src[m.end() : close.start()].split("\n"):
                if line.strip() and not line.startswith(indent):
                    raise Broken("heredoc indentation")
        self.out.append("STR)")
        return close.end()


BINARY = {"or": 1, "xor": 2, "and": 3, "??": 7, "||": 8, "&&": 9, "|": 10, "^": 11, "&": 12, "==": 13, "!=": 13, "===": 13, "!==": 13, "<>": 13, "<=>": 13, "<": 14, "<=": 14, ">": 14, ">=": 14, ".": 15, "<<": 16, ">>": 16, "+": 17, "-": 17, "*": 18, "/": 18, "%": 18, "instanceof": 20, "**": 21}
ASSIGN = frozenset("= += -= *= /= .= %= &= |= ^= <<= >>= **= ??=".split())
MODIFIERS = frozenset("public protected private static abstract final readonly var".split())
_NAMES = frozenset(["ID", "QID", "enum", "from", "self", "parent"])
_TYPES = _NAMES | {"array", "callable", "static"}


class Php(Cursor):
    def __init__(self, src: str) -> None:
        super().__init__(Lexer(src).run())

    def is_word(self) -> bool:
        return self.t in _NAMES and self.t != "QID" or self.t in KEYWORDS

    def word(self) -> None:
        if not self.is_word():
            self.fail("name")
        self.step()

    def semi(self) -> None:
        if self.t == "END":
            self.fail("needs ;")
        self.need(";")

    def file(self) -> None:
        while self.t != "EOF":
            if self.t == "END":
                self.step()
            else:
                self.statement(True)

    def block(self) -> None:
        self.need("{")
        while self.t != "}":
            self.statement()
        self.step()

    def body(self, *ends: str) -> None:
        """A statement, or with `:` statements up to one of `ends`."""
        if self.take(":"):
            while self.t not in ends:
                self.statement()
            return
        self.statement()

    def statement(self, top: bool = False) -> None:
        t = self.t
        handler = _STATEMENTS.get(t)
        if t == "HTML":
            self.step()
        elif t == "{":
            self.block()
        elif t == ";":
            self.step()
        elif t in ("EOF", "END"):
            self.fail()
        elif t == "#[":
            self.attributes()
            if self.t in ("function", "abstract", "final", "class", "trait", "interface", "enum", "readonly", "fn", "static", "new", "const"):
                self.statement(top)
            else:
                self.fail("attribute")
        elif handler:
            handler(self)
        elif t == "function" and (self.peek() in _NAMES or self.peek() in KEYWORDS and self.peek(2) == "(" and self.peek() != "use" or self.peek() == "&" and self.peek(2) in _NAMES):
            self.function()
        elif t in ("abstract", "final", "readonly") or t == "class":
            self.class_()
        elif t == "enum" and self.peek() in ("ID", "enum", "from"):
            self.class_()
        elif t == "static" and self.peek() == "VAR":
            self.step()
            while True:
                self.need("VAR")
                if self.take("="):
                    self.expr()
                if not self.take(","):
                    break
            self.semi()
        elif t == "namespace" and self.peek() in ("ID", "QID", "{", "enum", "from") and top:
            self.step()
            if self.t in _NAMES:
                self.step()
            if self.t == "{":
                self.step()
                while self.t != "}":
                    self.statement(True)
                self.step()
            else:
                self.semi()
        elif t == "use" and top:
            self.use()
        elif t == "const":
            self.step()
            self.consts()
        elif t == "ID" and self.peek() == ":" and self.peek(2) != ":":
            self.step()
            self.step()
        else:
            self.expr()
            self.semi()

    def use(self) -> None:
        self.need("use")
        if self.t in ("function", "const"):
            self.step()
        while True:
            if self.t not in _NAMES:
                self.fail("use")
            self.step()
            if self.t == "{":
                self.group()
            elif self.take("as"):
                self.need("ID")
            if not self.take(","):
                break
        self.semi()

    def group(self) -> None:
        self.need("{")
        while self.t != "}":
            if self.t in ("function", "const"):
                self.step()
            if self.t not in _NAMES:
                self.fail("use group")
            self.step()
            if self.take("as"):
                self.need("ID")
            if not self.take(","):
                break
        self.need("}")

    def consts(self) -> None:
        while True:
            self.word()
            self.need("=")
            self.expr()
            if not self.take(","):
                break
        self.semi()

    def paren(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def if_(self) -> None:
        self.need("if")
        self.paren()
        if self.take(":"):
            while True:
                while self.t not in ("elseif", "else", "endif"):
                    self.statement()
                if self.take("elseif"):
                    self.paren()
                    self.need(":")
                elif self.t == "else":
                    self.step()
                    self.need(":")
                    while self.t != "endif":
                        self.statement()
                    break
                else:
                    break
            self.need("endif")
            self.semi()
            return
        self.statement()
        while self.t == "elseif":
            self.step()
            self.paren()
            self.statement()
        if self.take("else"):
            self.statement()

    def while_(self) -> None:
        self.step()
        self.paren()
        if self.t == ":":
            self.body("endwhile")
            self.need("endwhile")
            self.semi()
        else:
            self.statement()

    def do(self) -> None:
        self.step()
        self.statement()
        self.need("while")
        self.paren()
        self.semi()

    def for_(self) -> None:
        self.step()
        self.need("(")
        for end in (";", ";", ")"):
            if self.t != end:
                self.expr()
                while self.take(","):
                    self.expr()
            self.need(end)
        if self.t == ":":
            self.body("endfor")
            self.need("endfor")
            self.semi()
        else:
            self.statement()

    def foreach(self) -> None:
        self.step()
        self.need("(")
        self.expr()
        self.need("as")
        self.take("&")
        self.expr()
        if self.take("=>"):
            self.take("&")
            self.expr()
        self.need(")")
        if self.t == ":":
            self.body("endforeach")
            self.need("endforeach")
            self.semi()
        else:
            self.statement()

    def switch(self) -> None:
        self.step()
        self.paren()
        end = "endswitch" if self.t == ":" else "}"
        if self.t not in (":", "{"):
            self.fail("switch")
        self.step()
        self.take(";")
        while self.t != end:
            if self.take("case"):
                self.expr()
            else:
                self.need("default")
            if self.t not in (":", ";"):
                self.fail("case")
            self.step()
            while self.t not in ("case", "default", end):
                self.statement()
        self.step()
        if end == "endswitch":
            self.semi()

    def try_(self) -> None:
        self.step()
        self.block()
        handled = False
        while self.take("catch"):
            handled = True
            self.need("(")
            self.name()
            while self.take("|"):
                self.name()
            self.take("VAR")
            self.need(")")
            self.block()
        if self.take("finally"):
            handled = True
            self.block()
        if not handled:
            self.fail("try without catch")

    def declare(self) -> None:
        self.step()
        self.need("(")
        while True:
            self.need("ID")
            self.need("=")
            self.expr()
            if not self.take(","):
                break
        self.need(")")
        if self.t == ":":
            self.body("enddeclare")
            self.need("enddeclare")
            self.semi()
        else:
            self.statement()

    def jump(self) -> None:
        self.step()
        self.take("LIT")
        self.semi()

    def return_(self) -> None:
        self.step()
        if self.t not in (";", "END"):
            self.expr()
        self.semi()

    def echo(self) -> None:
        self.step()
        self.expr()
        while self.take(","):
            self.expr()
        self.semi()

    def global_(self) -> None:
        self.step()
        while True:
            self.simple_variable()
            if not self.take(","):
                break
        self.semi()

    def unset(self) -> None:
        self.step()
        self.arguments()
        self.semi()

    def goto(self) -> None:
        self.step()
        self.need("ID")
        self.semi()

    def name(self) -> None:
        if self.t not in _NAMES and self.t != "static":
            self.fail("name")
        self.step()

    def type(self) -> None:
        self.take("?")
        while True:
            if self.take("("):
                self.type()
                self.need(")")
            elif self.t in _TYPES:
                self.step()
            else:
                self.fail("type")
            if self.t == "|" or self.t == "&" and self.peek() not in ("VAR", "...", "&"):
                self.step()
                continue
            return

    def attributes(self) -> None:
        while self.take("#["):
            while True:
                self.name()
                if self.t == "(":
                    self.arguments()
                if not self.take(",") or self.t == "]":
                    break
            self.need("]")

    def params(self) -> None:
        self.need("(")
        while self.t != ")":
            self.attributes()
            while self.t in ("public", "protected", "private", "readonly"):
                self.step()
            if self.t not in ("VAR", "&", "..."):
                self.type()
            self.take("&")
            self.take("...")
            self.need("VAR")
            if self.take("="):
                self.expr()
            if not self.take(","):
                break
        self.need(")")

    def function(self) -> None:
        self.need("function")
        self.take("&")
        self.word()
        self.params()
        if self.take(":"):
            self.type()
        self.block()

    def class_(self) -> None:
        while self.t in ("abstract", "final", "readonly"):
            self.step()
        kind = self.step()
        if kind not in ("class", "interface", "trait", "enum"):
            self.back(self.i - 1)
            self.fail("class")
        if self.t not in ("ID", "enum", "from"):
            self.fail("class name")
        self.step()
        if kind == "enum" and self.take(":"):
            self.type()
        self.class_rest()

    def class_rest(self) -> None:
        if self.take("extends"):
            self.names()
        if self.take("implements"):
            self.names()
        self.need("{")
        while self.t != "}":
            self.member()
        self.step()

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def member(self) -> None:
        self.attributes()
        if self.t == "use":
            self.step()
            self.names()
            if self.take("{"):
                while self.t != "}":
                    self.word() if self.t != "QID" else self.step()
                    if self.take("::"):
                        self.word()
                    if self.take("insteadof"):
                        self.names()
                    else:
                        self.need("as")
                        if self.t in ("public", "protected", "private"):
                            self.step()
                            if self.t != ";":
                                self.word()
                        else:
                            self.word()
                    self.semi()
                self.step()
            else:
                self.semi()
            return
        if self.t == "case":
            self.step()
            self.word()
            if self.take("="):
                self.expr()
            self.semi()
            return
        seen = self.i
        while self.t in MODIFIERS:
            self.step()
        if self.t == "const":
            self.step()
            if not (self.is_word() and self.peek() == "="):
                self.type()
            self.consts()
        elif self.t == "function":
            self.step()
            self.take("&")
            self.word()
            self.params()
            if self.take(":"):
                self.type()
            if not self.take(";"):
                self.block()
        else:
            if self.i == seen:
                self.fail("member")
            if self.t != "VAR":
                self.type()
            while True:
                self.need("VAR")
                if self.take("="):
                    self.expr()
                if not self.take(","):
                    break
            self.semi()

    # expressions: the kind of one is "var" if it can be assigned to

    def expr(self, least: int = 0) -> str:
        kind = self.unary(least)
        last = 0
        while True:
            t = self.t
            if t in ASSIGN and kind == "var":
                self.step()
                if t == "=" and self.take("&"):
                    self.expr(6)
                else:
                    self.expr(5)
                kind = "other"
                continue
            if t == "?" and least <= 6:
                self.step()
                if not self.take(":"):
                    self.expr(5)
                    self.need(":")
                self.expr(7)
                if self.t == "?":
                    self.fail("nested ternary")
                kind = "other"
                continue
            p = BINARY.get(t, 0)
            if not p or p < least:
                return kind
            if p in (13, 14) and last == p:
                self.fail("chained comparison")
            last = p
            self.step()
            if t == "instanceof":
                if self.t in _NAMES or self.t == "static":
                    self.step()
                else:
                    self.unary(20)
            else:
                self.expr(p if t in ("??", "**") else p + 1)
            kind = "other"

    def unary(self, least: int) -> str:
        t = self.t
        if t in ("!", "~", "@", "+", "-", "CAST", "&"):
            if t == "&":
                self.fail()
            self.step()
            self.expr(19)
            return "other"
        if t in ("++", "--"):
            self.step()
            if self.postfix(self.primary()) != "var":
                self.fail("increment")
            return "other"
        if t in ("print", "include", "include_once", "require", "require_once", "throw"):
            self.step()
            self.expr(5 if t != "throw" else 0)
            return "other"
        if t == "yield":
            self.step()
            if self.take("from"):
                self.expr(5)
            elif self.t not in (";", ")", ",", "]"):
                self.expr(5)
                if self.take("=>"):
                    self.expr(5)
            return "other"
        if t == "clone":
            self.step()
            self.expr(22)
            return "other"
        kind = self.postfix(self.primary())
        if self.t in ("++", "--") and kind == "var":
            self.step()
            kind = "other"
        return kind

    def arguments(self) -> None:
        self.need("(")
        while self.t != ")":
            if self.t == "..." and self.peek() == ")":
                self.step()
                break
            self.take("...")
            if self.is_word() and self.peek() == ":" and self.peek(2) != ":":
                self.step()
                self.step()
            self.expr()
            if not self.take(","):
                break
        self.need(")")

    def items(self, end: str) -> None:
        while self.t != end:
            if self.t == ",":
                self.step()
                continue
            if self.take("..."):
                self.expr()
            elif self.take("&"):
                self.expr()
            else:
                self.expr()
                if self.take("=>"):
                    self.take("&")
                    self.expr()
            if not self.take(","):
                break
        self.need(end)

    def simple_variable(self) -> None:
        while self.t == "$":
            self.step()
            if self.take("{"):
                self.expr()
                self.need("}")
                return
        self.need("VAR")

    def primary(self) -> str:
        t = self.t
        if t in ("VAR", "$"):
            self.simple_variable()
            return "var"
        if t in ("LIT", "STR"):
            self.step()
            return "value"
        if t == "STR(":
            self.step()
            while self.take("{"):
                self.expr()
                self.need("}")
            self.need("STR)")
            return "value"
        if t == "(":
            self.step()
            self.expr()
            self.need(")")
            return "value"
        if t == "[":
            self.step()
            self.items("]")
            return "var"
        if t in ("array", "list") and self.peek() == "(":
            self.step()
            self.step()
            self.items(")")
            return "var" if t == "list" else "value"
        if t in ("isset", "empty", "eval", "exit", "die"):
            self.step()
            if self.t == "(":
                self.arguments()
            elif t not in ("exit", "die"):
                self.fail()
            return "other"
        if t == "new":
            self.new()
            return "value"
        if t == "#[":
            self.attributes()
            return self.primary()
        if t == "static" and self.peek() in ("function", "fn"):
            self.step()
            t = self.t
        if t == "function":
            self.step()
            self.take("&")
            self.params()
            if self.take("use"):
                self.need("(")
                while self.t != ")":
                    self.take("&")
                    self.need("VAR")
                    if not self.take(","):
                        break
                self.need(")")
            if self.take(":"):
                self.type()
            self.block()
            return "value"
        if t == "fn":
            self.step()
            self.take("&")
            self.params()
            if self.take(":"):
                self.type()
            self.need("=>")
            self.expr(5)
            return "other"
        if t == "match":
            if self.peek() != "(":
                self.fail("match")
            self.step()
            self.paren()
            self.need("{")
            while self.t != "}":
                if not (self.t == "default" and self.step()):
                    self.expr()
                    while self.take(","):
                        if self.t == "=>":
                            break
                        self.expr()
                else:
                    self.take(",")
                self.need("=>")
                self.expr()
                if not self.take(","):
                    break
            self.need("}")
            return "value"
        if t in _NAMES or t in ("static", "array", "callable"):
            self.step()
            return "name"
        if t == "namespace":
            self.fail("namespace")
        self.fail("expression")
        return ""

    def new(self) -> None:
        self.need("new")
        self.attributes()
        if self.t in ("class", "readonly"):
            self.take("readonly")
            self.need("class")
            if self.t == "(":
                self.arguments()
            self.class_rest()
            return
        if self.t == "(":
            self.paren()
        elif self.t in _NAMES or self.t == "static":
            self.step()
        else:
            self.simple_variable()
        while self.t in ("->", "?->", "::", "["):
            if self.take("["):
                self.expr()
                self.need("]")
            else:
                self.step()
                if self.t == "VAR":
                    self.step()
                else:
                    self.word()
        if self.t == "(":
            self.arguments()

    def postfix(self, kind: str) -> str:
        while True:
            t = self.t
            if t == "[":
                self.step()
                if self.t != "]":
                    self.expr()
                self.need("]")
                kind = "var"
            elif t in ("->", "?->"):
                self.step()
                if self.t == "{":
                    self.step()
                    self.expr()
                    self.need("}")
                elif self.t in ("VAR", "$"):
                    self.simple_variable()
                else:
                    self.word()
                kind = "var"
            elif t == "::":
                self.step()
                if self.t in ("VAR", "$"):
                    self.simple_variable()
                    kind = "var"
                elif self.t == "{":
                    self.step()
                    self.expr()
                    self.need("}")
                    kind = "value"
                else:
                    self.word()
                    kind = "value"
            elif t == "(":
                self.arguments()
                kind = "var"  # a call can be followed by what needs a variable
            else:
                return kind


_STATEMENTS = {
    "if": Php.if_,
    "while": Php.while_,
    "do": Php.do,
    "for": Php.for_,
    "foreach": Php.foreach,
    "switch": Php.switch,
    "try": Php.try_,
    "declare": Php.declare,
    "break": Php.jump,
    "continue": Php.jump,
    "return": Php.return_,
    "echo": Php.echo,
    "global": Php.global_,
    "unset": Php.unset,
    "goto": Php.goto,
    "interface": Php.class_,
    "trait": Php.class_,
}


def check(src: str) -> None:
    """Raises Broken unless `src` is a PHP file."""
    Php(src).file()

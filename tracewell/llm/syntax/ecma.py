"""ECMAScript modules. Tokens are read on demand, since a slash depends on the grammar."""

from __future__ import annotations

import re

from tracewell.llm.syntax.base import Broken

_SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/)+", re.S)
_LINE = re.compile(r"[\n\r\u2028\u2029]")
_ID = re.compile(r"(?:[$_]|[^\W\d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[$\w\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUM = re.compile(r"0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?")
_STR = re.compile(r'"(?:[^"\\\r\n]|\\(?:\r\n|[^xu0-9]|0(?!\d)|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]{1,6}\}))*"|' + r"'(?:[^'\\\r\n]|\\(?:\r\n|[^xu0-9]|0(?!\d)|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]{1,6}\}))*'", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n\u2028\u2029]|\\[^\r\n\u2028\u2029]|\[(?:[^\]\\\r\n\u2028\u2029]|\\[^\r\n\u2028\u2029])*\])+/([\w$]*)")
_OP = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.(){}\[\]@#]")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield await let static implements interface package private protected public".split()
)
#: Reserved in the grammar itself; the others may only be no binding names in strict code.
HARD = RESERVED - {"let", "static", "yield", "await", "implements", "interface", "package", "private", "protected", "public"}
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())


class Ecma:
    def __init__(self, src: str) -> None:
        if src.startswith("#!"):
            m = re.search(r"[\r\n]", src)
            src = src[m.start() :] if m else ""
        self.src, self.pos, self.end = src, 0, 0
        self.t, self.v, self.nl = "", "", False
        self.prior_nl = False
        self.functions, self.asynchronous, self.generator = 0, [True], [False]
        self.no_arrow: set[int] = set()
        self.defaults: list[int] = []  # shorthand defaults that need a pattern around them
        self.step()

    # tokens: t is the class ("ID", "LIT", "EOF" or the text of words and operators), v its text

    def fail(self, what: str = "") -> None:
        raise Broken(f"at {self.pos} {self.v!r} {what}")

    def step(self) -> str:
        old, src, pos = self.t, self.src, self.end
        self.nl = False
        c = src[pos : pos + 1]
        if c in " \t\n\r\v\f/" or c > "\x1b" and not c.isascii() or c < " ":
            m = _SPACE.match(src, pos)
            if m:
                self.nl = _LINE.search(src, pos, m.end()) is not None
                pos = m.end()
                c = src[pos : pos + 1]
        self.pos = pos
        if not c:
            self.t, self.v, self.end = "EOF", "", pos
        elif (c > "@" or c == "$") and (m := _ID.match(src, pos)):
            v = self.v = m.group()
            self.end = m.end()
            self.t = v if v in RESERVED else "ID"
        elif c.isdigit() or c == "." and src[pos + 1 : pos + 2].isdigit():
            m = _NUM.match(src, pos)
            if m is None or _ID.match(src, m.end()) or src[m.end() : m.end() + 1].isdigit():
                self.fail("number")
            self.t, self.v, self.end = "LIT", m.group(), m.end()
        elif c == '"' or c == "'":
            m = _STR.match(src, pos)
            if m is None:
                self.fail("string")
            self.t, self.v, self.end = "STR", m.group(), m.end()
        elif c == "`":
            self.t, self.v, self.end = "`", "`", pos + 1
        else:
            m = _OP.match(src, pos)
            if m is None:
                self.fail("character")
            self.t = self.v = m.group()
            self.end = m.end()
            if self.t == "#":
                m = _ID.match(src, pos + 1)
                if m is None:
                    self.fail("private name")
                self.t, self.v, self.end = "PRIVATE", m.group(), m.end()
        return old

    def save(self):
        return self.pos, self.end, self.t, self.v, self.nl, len(self.defaults)

    def back(self, state) -> None:
        self.pos, self.end, self.t, self.v, self.nl, n = state
        del self.defaults[n:]

    def ahead(self) -> tuple[str, bool]:
        """The next token's class and whether a line ends before it."""
        state = self.save()
        try:
            self.step()
            return self.t, self.nl
        except Broken:
            return "?", False
        finally:
            self.back(state)

    def need(self, t: str) -> None:
        if self.t != t:
            self.fail(f"needs {t}")
        self.step()

    def take(self, t: str) -> bool:
        if self.t == t:
            self.step()
            return True
        return False

    def word(self, w: str) -> bool:
        return self.t == "ID" and self.v == w

    def semi(self) -> None:
        if self.t == ";":
            self.step()
        elif self.t not in ("}", "EOF") and not self.nl:
            self.fail("needs ;")

    # modules and statements

    def file(self) -> None:
        while self.t != "EOF":
            if self.t == "import" and self.ahead()[0] not in ("(", "."):
                self.import_()
            elif self.t == "export":
                self.export()
            else:
                self.statement(True)

    def module_name(self) -> None:
        if self.t in ("STR",):
            self.step()
        elif self.t == "ID" or self.t in RESERVED:
            self.step()
        else:
            self.fail("name")

    def import_(self) -> None:
        self.need("import")
        if self.t == "STR":
            self.step()
            self.attributes()
            return self.semi()
        more = True
        if self.t == "ID":
            self.step()
            more = self.take(",")
        if more:
            if self.take("*"):
                if not self.word("as"):
                    self.fail("as")
                self.step()
                self.binding_name()
            else:
                self.need("{")
                while self.t != "}":
                    plain = self.t == "ID"
                    self.module_name()
                    if self.word("as"):
                        self.step()
                        self.binding_name()
                    elif not plain:
                        self.fail("import name")
                    if not self.take(","):
                        break
                self.need("}")
        if not self.word("from"):
            self.fail("from")
        self.step()
        self.need("STR")
        self.attributes()
        self.semi()

    def attributes(self) -> None:
        if self.t == "with":
            self.step()
            self.need("{")
            while self.t != "}":
                self.module_name()
                self.need(":")
                self.need("STR")
                if not self.take(","):
                    break
            self.need("}")

    def export(self) -> None:
        self.need("export")
        if self.take("*"):
            if self.word("as"):
                self.step()
                self.module_name()
            if not self.word("from"):
                self.fail("from")
            self.step()
            self.need("STR")
            self.attributes()
            self.semi()
        elif self.take("{"):
            local = True
            while self.t != "}":
                local = local and self.t == "ID"
                self.module_name()
                if self.word("as"):
                    self.step()
                    self.module_name()
                if not self.take(","):
                    break
            self.need("}")
            if self.word("from"):
                self.step()
                self.need("STR")
                self.attributes()
            elif not local:
                self.fail("export name")
            self.semi()
        elif self.take("default"):
            if self.t == "function" or self.word("async") and self.ahead() == ("function", False):
                self.function(False)
            elif self.t == "class":
                self.class_(False)
            else:
                self.assign()
                self.semi()
        elif self.t in ("var", "let", "const", "function", "class") or self.word("async"):
            self.statement(True)
        else:
            self.fail("export")

    def block(self) -> None:
        self.need("{")
        while self.t != "}":
            self.statement(True)
        self.step()

    def statement(self, declares: bool = False) -> None:
        t = self.t
        if t == "{":
            self.block()
        elif t == ";":
            self.step()
        elif t in ("var", "const") or t == "let":
            if t != "var" and not declares:
                self.fail("declaration")
            self.step()
            self.declarators(t, True)
            self.semi()
        elif t == "function" or self.word("async") and self.ahead() == ("function", False):
            if not declares:
                self.fail("declaration")
            self.function(True)
        elif t == "class":
            if not declares:
                self.fail("declaration")
            self.class_(True)
        elif t == "if":
            self.step()
            self.paren()
            self.statement()
            if self.take("else"):
                self.statement()
        elif t == "for":
            self.for_()
        elif t == "while":
            self.step()
            self.paren()
            self.statement()
        elif t == "do":
            self.step()
            self.statement()
            self.need("while")
            self.paren()
            self.take(";")
        elif t in ("break", "continue"):
            self.step()
            if self.t == "ID" and not self.nl:
                self.step()
            self.semi()
        elif t == "return":
            if not self.functions:
                self.fail("return outside a function")
            self.step()
            if self.t not in (";", "}", "EOF") and not self.nl:
                self.expr()
            self.semi()
        elif t == "throw":
            self.step()
            if self.nl:
                self.fail("throw")
            self.expr()
            self.semi()
        elif t == "try":
            self.step()
            self.block()
            handled = False
            if self.take("catch"):
                handled = True
                if self.take("("):
                    self.binding()
                    self.need(")")
                self.block()
            if self.take("finally"):
                handled = True
                self.block()
            if not handled:
                self.fail("try")
        elif t == "switch":
            self.step()
            self.paren()
            self.need("{")
            seen = False
            while self.t != "}":
                if self.take("case"):
                    self.expr()
                else:
                    if seen:
                        self.fail("second default")
                    seen = True
                    self.need("default")
                self.need(":")
                while self.t not in ("case", "default", "}"):
                    self.statement(True)
            self.step()
        elif t == "debugger":
            self.step()
            self.semi()
        elif t in ("with", "export", "enum") or t == "import" and self.ahead()[0] not in ("(", "."):
            self.fail("statement")
        elif t == "ID" and self.ahead()[0] == ":":
            self.step()
            self.step()
            self.statement()
        else:
            self.expr()
            self.semi()

    def paren(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def declarators(self, kind: str, whole: bool, no_in: bool = False) -> int:
        """Declarations; `whole` wants the initial values that constants and patterns need."""
        n, bare = 0, False
        while True:
            pattern = self.t in ("{", "[")
            self.binding()
            if self.take("="):
                self.assign(no_in)
            else:
                bare = bare or pattern or kind == "const"
            n += 1
            if not self.take(","):
                break
        if whole and bare:
            self.fail("missing initial value")
        return -n if bare else n

    def for_(self) -> None:
        self.need("for")
        each = False
        if self.t == "await":
            self.step()
            each = True
        self.need("(")
        t = self.t
        if t in ("var", "const", "let"):
            self.step()
            n = self.declarators(t, False, True)
            if abs(n) == 1 and (self.t == "in" or self.word("of")):
                self.for_rest(each)
            elif each:
                self.fail("for await")
            else:
                if n < 0:
                    self.fail("missing initial value")
                self.classic()
        elif t == ";":
            if each:
                self.fail("for await")
            self.classic()
        else:
            mark = len(self.defaults)
            kind = self.expr(True)
            if self.t == "in" or self.word("of"):
                if kind not in ("name", "member", "pattern"):
                    self.fail("for target")
                del self.defaults[mark:]
                self.for_rest(each)
            else:
                self.clean(mark)
                self.classic()
        self.need(")")
        self.statement()

    def for_rest(self, each: bool) -> None:
        if self.t == "in":
            if each:
                self.fail("for await")
            self.step()
            self.expr()
        else:
            self.step()
            self.assign()

    def classic(self) -> None:
        self.need(";")
        if self.t != ";":
            self.expr()
        self.need(";")
        if self.t != ")":
            self.expr()

    # bindings, functions, classes

    def binding_name(self) -> None:
        if self.t != "ID" or self.v in ("eval", "arguments"):
            self.fail("binding")
        self.step()

    def binding(self) -> None:
        if self.take("["):
            while self.t != "]":
                if self.take(","):
                    continue
                rest = self.take("...")
                self.binding()
                if not rest and self.take("="):
                    self.assign()
                if self.t != "]":
                    if rest:
                        self.fail("rest")
                    self.need(",")
            self.step()
        elif self.take("{"):
            while self.t != "}":
                if self.take("..."):
                    self.binding_name()
                    break
                plain = self.t == "ID"
                self.property_name()
                if self.take(":"):
                    self.binding()
                elif not plain:
                    self.fail("binding")
                if self.take("="):
                    self.assign()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.binding_name()

    def params(self) -> None:
        self.need("(")
        while self.t != ")":
            if self.take("..."):
                self.binding()
                break
            self.binding()
            if self.take("="):
                self.assign()
            if not self.take(","):
                break
        self.need(")")

    def function_rest(self, asynchronous: bool, generator: bool) -> None:
        self.asynchronous.append(asynchronous)
        self.generator.append(generator)
        self.functions += 1
        self.params()
        self.block()
        self.functions -= 1
        self.asynchronous.pop()
        self.generator.pop()

    def function(self, named: bool) -> None:
        asynchronous = self.word("async")
        if asynchronous:
            self.step()
        self.need("function")
        generator = self.take("*")
        if self.t == "ID":
            self.step()
        elif named:
            self.fail("function name")
        self.function_rest(asynchronous, generator)

    def property_name(self) -> str:
        t = self.t
        if t == "[":
            self.step()
            self.assign()
            self.need("]")
        elif t in ("ID", "STR", "LIT", "PRIVATE") or t in RESERVED:
            self.step()
        else:
            self.fail("property")
        return t

    def class_(self, named: bool) -> None:
        self.need("class")
        if self.t == "ID":
            self.step()
        elif named:
            self.fail("class name")
        if self.take("extends"):
            self.unary_left()
        self.need("{")
        while self.t != "}":
            if not self.take(";"):
                self.class_member()
        self.step()

    def _names_member(self) -> bool:
        """Whether a word is followed by what makes it a modifier."""
        t, nl = self.ahead()
        return t in ("ID", "STR", "LIT", "PRIVATE", "[", "*", "{") or t in RESERVED

    def class_member(self) -> None:
        if self.t == "static" and self._names_member():
            self.step()
            if self.t == "{":
                self.functions += 1
                self.asynchronous.append(False)
                self.generator.append(False)
                self.block()
                self.asynchronous.pop()
                self.generator.pop()
                self.functions -= 1
                return
        self.method(True)

    def method(self, in_class: bool) -> str:
        """A member of a class or object; returns 'method', 'field' or the class of a plain name."""
        asynchronous = generator = False
        accessor = False
        if self.word("async") and self._names_member() and not self.ahead()[1] and self.ahead()[0] != "{":
            self.step()
            asynchronous = True
        if self.take("*"):
            generator = True
        if (self.word("get") or self.word("set")) and not asynchronous and not generator and self._names_member() and self.ahead()[0] not in ("*", "{"):
            self.step()
            accessor = True
        if self.t == "PRIVATE" and not in_class:
            self.fail("private name")
        t = self.property_name()
        if self.t == "(":
            self.function_rest(asynchronous, generator)
            return "method"
        if asynchronous or generator or accessor:
            self.fail("method")
        if in_class:
            if self.take("="):
                self.functions += 1
                self.asynchronous.append(False)
                self.assign()
                self.asynchronous.pop()
                self.functions -= 1
            self.semi()
            return "field"
        return t

    # expressions: the kind is name, member, pattern, call or other

    def clean(self, mark: int) -> None:
        if len(self.defaults) > mark:
            self.fail("default outside a pattern")

    def expr(self, no_in: bool = False) -> str:
        kind = self.assign(no_in)
        while self.take(","):
            self.assign(no_in)
            kind = "other"
        return kind

    def assign(self, no_in: bool = False) -> str:
        if self.t == "yield" and self.generator[-1]:
            self.step()
            if not self.nl and self.t not in (")", "]", "}", ",", ";", ":", "EOF", "in"):
                self.take("*")
                self.assign(no_in)
            return "other"
        if self.arrow():
            return "other"
        mark = len(self.defaults)
        kind = self.conditional(no_in)
        if self.t in ASSIGN:
            if kind not in ("name", "member") and not (kind == "pattern" and self.t == "="):
                self.fail("assignment target")
            if kind == "pattern":
                del self.defaults[mark:]
            self.step()
            self.assign(no_in)
            return "other"
        return kind

    def arrow(self) -> bool:
        """Reads an arrow function where one stands."""
        state = self.save()
        asynchronous = False
        if self.t == "ID":
            t, nl = self.ahead()
            if t == "=>" and not nl:
                self.step()
                self.step()
                self.arrow_body(False)
                return True
            if self.v != "async" or nl or t not in ("ID", "("):
                return False
            self.step()
            asynchronous = True
            if self.t == "ID":
                if self.ahead() == ("=>", False):
                    self.step()
                    self.step()
                    self.arrow_body(True)
                    return True
                self.back(state)
                return False
        if self.t != "(" or self.pos in self.no_arrow:
            self.back(state)
            return False
        at = self.pos
        try:
            self.asynchronous.append(asynchronous or self.asynchronous[-1])
            try:
                self.params()
            finally:
                self.asynchronous.pop()
            if self.t != "=>" or self.nl:
                self.fail()
        except Broken:
            self.no_arrow.add(at)
            self.back(state)
            return False
        self.step()
        self.arrow_body(asynchronous)
        return True

    def arrow_body(self, asynchronous: bool) -> None:
        self.asynchronous.append(asynchronous)
        self.generator.append(False)
        if self.t == "{":
            self.functions += 1
            self.block()
            self.functions -= 1
        else:
            self.assign()
        self.asynchronous.pop()
        self.generator.pop()

    def conditional(self, no_in: bool) -> str:
        kind = self.binary(1, no_in)
        if self.take("?"):
            self.assign()
            self.need(":")
            self.assign(no_in)
            return "other"
        return kind

    def binary(self, least: int, no_in: bool) -> str:
        mark = len(self.defaults)
        if self.t == "PRIVATE":
            self.step()
            if self.t != "in":
                self.fail("private name")
            kind = "other"
        else:
            kind = self.unary()
        mixed = set()
        while (p := BINARY.get(self.t, 0)) >= least:
            if self.t == "in" and no_in:
                break
            op = self.step()
            self.clean(mark)
            if op in ("??", "||", "&&"):
                mixed.add("??" if op == "??" else "|")
                if len(mixed) > 1:
                    self.fail("mixed ??")
            if op == "**" and kind == "unary":
                self.fail("unary before **")
            right = self.binary(p if op == "**" else p + 1, no_in)
            if op in ("??", "||") and right == "logical" and op == "??":
                self.fail("mixed ??")
            kind = "logical" if op in ("||", "&&") else "other"
        return kind

    def unary(self) -> str:
        t = self.t
        if t in ("!", "~", "+", "-", "typeof", "void", "delete"):
            self.step()
            kind = self.unary()
            if t == "delete" and kind == "name":
                self.fail("delete of a name")
            return "unary"
        if t in ("++", "--"):
            self.step()
            if self.unary() not in ("name", "member"):
                self.fail("increment")
            return "other"
        if t == "await" and self.asynchronous[-1]:
            self.step()
            self.unary()
            return "unary"
        kind = self.unary_left()
        if self.t in ("++", "--") and not self.nl:
            if kind not in ("name", "member"):
                self.fail("increment")
            self.step()
            return "other"
        return kind

    def unary_left(self) -> str:
        kind = self.primary()
        return self.suffixes(kind, True)

    def suffixes(self, kind: str, calls: bool) -> str:
        optional = False
        mark = len(self.defaults) - (kind == "pattern")
        while True:
            t = self.t
            if t == ".":
                self.step()
                if self.t not in ("ID", "PRIVATE") and self.t not in RESERVED:
                    self.fail("member")
                self.step()
                kind = "member"
            elif t == "?.":
                if not calls:
                    self.fail("optional chain")
                optional = True
                self.step()
                if self.t == "(":
                    self.arguments()
                elif self.t == "[":
                    self.step()
                    self.expr()
                    self.need("]")
                elif self.t == "`":
                    self.fail("template")
                else:
                    if self.t not in ("ID", "PRIVATE") and self.t not in RESERVED:
                        self.fail("member")
                    self.step()
                kind = "call"
            elif t == "[":
                self.step()
                self.expr()
                self.need("]")
                kind = "member"
            elif t == "(" and calls:
                self.arguments()
                kind = "call"
            elif t == "`":
                if optional:
                    self.fail("template")
                self.template()
                kind = "call"
            else:
                return "call" if optional else kind

    def arguments(self) -> None:
        self.need("(")
        while self.t != ")":
            self.take("...")
            mark = len(self.defaults)
            self.assign()
            self.clean(mark)
            if not self.take(","):
                break
        self.need(")")

    def template(self) -> None:
        """From the backquote, which is the token, to the end."""
        while True:
            m = _TEMPLATE.match(self.src, self.end)
            self.end = m.end()
            if self.src.startswith("`", self.end):
                self.end += 1
                self.step()
                return
            if not self.src.startswith("${", self.end):
                self.fail("template")
            self.end += 2
            self.step()
            self.expr()
            if self.t != "}":
                self.fail("template")
            self.end = self.pos + 1

    def primary(self) -> str:
        t = self.t
        if t == "ID":
            if self.v == "async" and self.ahead() == ("function", False):
                self.function(False)
                return "other"
            self.step()
            return "name"
        if t in ("LIT", "STR", "null", "true", "false", "this"):
            self.step()
            return "other"
        if t == "`":
            self.template()
            return "other"
        if t == "(":
            self.step()
            mark = len(self.defaults)
            kind = self.expr()
            self.clean(mark)
            self.need(")")
            return kind if kind in ("name", "member") else "other"
        if t == "[":
            self.step()
            while self.t != "]":
                if self.take(","):
                    continue
                self.take("...")
                self.assign()
                if self.t != "]":
                    self.need(",")
            self.step()
            return "pattern"
        if t == "{":
            self.object()
            return "pattern"
        if t == "function":
            self.function(False)
            return "other"
        if t == "class":
            self.class_(False)
            return "other"
        if t in ("/", "/="):
            m = _REGEX.match(self.src, self.pos)
            if m is None or not set(m[1]) <= set("dgimsuvy") or len(set(m[1])) < len(m[1]) or not _pattern_ok(m.group()):
                self.fail("regular expression")
            self.end = m.end()
            self.step()
            return "other"
        if t == "new":
            self.step()
            if self.take("."):
                if not self.word("target"):
                    self.fail("new.target")
                self.step()
                return "other"
            if self.t == "import":
                self.fail("new import")
            kind = self.primary()
            self.suffixes(kind, False)
            if self.t == "(":
                self.arguments()
            return "other"
        if t == "super":
            self.step()
            if self.t not in ("(", ".", "["):
                self.fail("super")
            return "other"
        if t == "import":
            self.step()
            if self.take("."):
                if not self.word("meta"):
                    self.fail("import.meta")
                self.step()
                return "other"
            if self.t != "(":
                self.fail("import")
            self.arguments()
            return "other"
        self.fail("expression")
        return ""

    def object(self) -> None:
        self.need("{")
        while self.t != "}":
            if self.take("..."):
                self.assign()
            else:
                plain = self.t == "ID" or self.t == "await" and not self.asynchronous[-1]
                kind = self.method(False)
                if kind != "method":
                    if self.take(":"):
                        self.assign()
                    elif not plain:
                        self.fail("property")
                    elif self.t == "=":
                        self.defaults.append(self.pos)
                        self.step()
                        self.assign()
            if not self.take(","):
                break
        self.need("}")


def _pattern_ok(text: str) -> bool:
    """Balanced groups, and nothing to repeat missing, in a regular expression literal."""
    body, depth, i, can = text[1 : text.rindex("/")], 0, 0, False
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 2
            can = True
            continue
        if c == "[":
            i += 1
            while body[i] != "]":
                i += 2 if body[i] == "\\" else 1
            can = True
        elif c == "(":
            depth += 1
            can = False
            if body.startswith("(?", i):
                i = i + 2
                if body[i : i + 1] == "<" and body[i + 1 : i + 2] not in ("=", "!"):
                    i = body.find(">", i)
                    if i < 0:
                        return False
                elif body[i : i + 1] == "<":
                    i += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                return False
            can = True
        elif c in "*+?":
            if not can:
                return False
            can = False
            if body[i + 1 : i + 2] == "?":
                i += 1
        elif c == "{" and can and re.match(r"\{\d+(?:,\d*)?\}", body[i:]):
            i = body.index("}", i)
            can = False
            if body[i + 1 : i + 2] == "?":
                i += 1
        else:
            can = c not in "|^$"
        i += 1
    return depth == 0


def check(src: str) -> None:
    """Raises Broken unless `src` is an ECMAScript module."""
    parser = Ecma(src)
    parser.file()
    parser.clean(0)

"""Productions of Python source, with the rules that its compiler holds names and scopes to.

``Productions`` reduces the tokens of a file by the productions of the language and
raises ``Bad`` at the first that none fits. Brackets nest as deep as the tokenizer of
the language allows; what may repeat without bound (signs, conditions, powers) is
reduced in loops.
"""

from __future__ import annotations

import io
import keyword
import re
import tokenize
import unicodedata
import warnings
from token import DEDENT, ENDMARKER, ERRORTOKEN, FSTRING_END, FSTRING_MIDDLE, FSTRING_START, INDENT, NAME, NEWLINE, NUMBER, OP, STRING

KEYWORDS = set(keyword.kwlist)
AUGMENTED = set("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
BINARY = set("+ - * / // % @ << >> & | ^ < > == >= <= !=".split())
# The features that a module may import from the future.
FEATURES = set("nested_scopes generators division absolute_import with_statement print_function unicode_literals barry_as_FLUFL generator_stop annotations".split())
DIGITS = r"[0-9](?:_?[0-9])*"
NUMBERS = re.compile(rf"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:0(?:_?0)*|[1-9](?:_?[0-9])*)|(?:{DIGITS}\.(?:{DIGITS})?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?[jJ]?|{DIGITS}[eE][+-]?{DIGITS}[jJ]?|{DIGITS}[jJ]")
ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})|N(?:\{([^}]*)\})?|[\s\S])")
#: Digits of a decimal number, at most.
LONGEST_INT = 4300
#: Statements that hold a block open, nested in one function at most so often.
NESTED_BLOCKS = 20


class Bad(Exception):
    """The text breaks a production."""


def read(text: str) -> tuple[list[tuple[int, str]], str]:
    """Tokens without comments and blank lines, and what lexical rule is broken, if any."""
    out: list[tuple[int, str]] = []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for t in tokenize.generate_tokens(io.StringIO(text).readline):
                if t.type == ERRORTOKEN or t.type == NAME and not t.string.isidentifier():
                    return out, "character"
                if t.type not in (tokenize.COMMENT, tokenize.NL, tokenize.ENCODING):
                    out.append((t.type, t.string))
    except (tokenize.TokenError, SyntaxError, ValueError) as e:
        return out, type(e).__name__
    return out, "character" if "\0" in text or any("\ud800" <= c <= "\udfff" for c in text) else ""


class Scope:
    """Names of a module, class, function or comprehension."""

    def __init__(self, kind: str, above: Scope | None, is_async: bool = False) -> None:
        self.kind, self.above, self.is_async = kind, above, is_async
        self.params: set[str] = set()
        self.bound: set[str] = set()
        self.used: set[str] = set()
        self.globals: set[str] = set()
        self.nonlocals: set[str] = set()
        self.typed: set[str] = set()
        self.targets: set[str] = set()  # of a comprehension
        self.walrus: set[str] = set()  # what is assigned within it
        self.loops, self.blocks, self.yields, self.returns = 0, 0, False, False
        self.group, self.handlers = False, 0  # directly in a block of except*, in how many at all


class Productions:
    """Kinds of expressions: ``("name", n)``, ``("tuple", [..])``, ``("list", [..])``, ``("star", x)``, ``("paren", x)``, ``(other,)``."""

    def __init__(self, tokens: list[tuple[int, str]]) -> None:
        self.toks, self.i, self.iterating = tokens, 0, 0
        self.loops_within = set()  # brackets whose content is a comprehension
        opened = []
        for j, (t, text) in enumerate(tokens):
            if t == OP and text in ("(", "[", "{"):
                opened.append(j)
            elif t == OP and text in (")", "]", "}"):
                opened = opened[:-1]
            elif t == NAME and text == "for" and opened:
                self.loops_within.add(opened[-1])
        self.scope = Scope("module", None)
        self.scopes = [self.scope]

    # Tokens

    def at(self, *texts: str) -> bool:
        t, s = self.toks[self.i]
        return s in texts and t in (OP, NAME)

    def ahead(self, k: int = 1) -> tuple[int, str]:
        return self.toks[min(self.i + k, len(self.toks) - 1)]

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise Bad(text)

    def kind(self) -> int:
        return self.toks[self.i][0]

    def is_name(self, k: int = 0) -> bool:
        t, s = self.ahead(k)
        return t == NAME and s not in KEYWORDS

    def name(self) -> str:
        if not self.is_name():
            raise Bad("name")
        self.i += 1
        return self.toks[self.i - 1][1]

    # Names and scopes

    def holder(self) -> Scope:
        """The scope that binds names: not a comprehension."""
        s = self.scope
        while s.kind == "comp":
            s = s.above
        return s

    def bind(self, name: str, scope: Scope | None = None) -> None:
        if name == "__debug__":
            raise Bad("name")
        (scope or self.scope).bound.add(unicodedata.normalize("NFKC", name))

    def enter(self, kind: str, is_async: bool = False) -> Scope:
        self.scope = Scope(kind, self.scope, is_async)
        self.scopes.append(self.scope)
        return self.scope

    def leave(self) -> None:
        s = self.scope
        if s.kind == "function" and s.is_async and s.yields and s.returns:
            raise Bad("return")
        self.scope = s.above

    def store(self, x: tuple, scope: Scope | None = None, depth: int = 0) -> None:
        """Whether something can be assigned to; its names are bound."""
        if x[0] == "name":
            self.bind(x[1], scope)
        elif x[0] == "paren":
            if x[1][0] == "star":
                raise Bad("target")
            self.store(x[1], scope, depth)
        elif x[0] in ("tuple", "list"):
            if sum(y[0] == "star" for y in x[1]) > 1:
                raise Bad("target")
            for y in x[1]:
                self.store(y[1] if y[0] == "star" else y, scope, depth + 1)
        elif x[0] not in ("attr", "sub"):
            raise Bad("target")

    def single(self, x: tuple) -> None:
        """A target of an annotation, an augmented assignment or a walrus in another form."""
        if x[0] not in ("name", "attr", "sub"):
            raise Bad("target")
        self.store(x)

    def erase(self, x: tuple) -> None:
        if x[0] in ("tuple", "list"):
            for y in x[1]:
                self.erase(y)
        elif x[0] == "paren":
            self.erase(x[1])
        elif x[0] == "name":
            self.bind(x[1])
        elif x[0] not in ("attr", "sub"):
            raise Bad("del")

    def settle(self) -> None:
        """Rules on names that need the whole file."""
        for s in self.scopes:
            for n in s.nonlocals:
                up = s.above
                if n == "__class__" and any(x == "class" for x in kinds_above(s)):
                    continue
                while up and not (up.kind == "function" and (n in up.params or n in up.bound) and n not in up.globals and n not in up.nonlocals):
                    up = up.above
                if not up:
                    raise Bad("nonlocal")
            if s.globals & s.nonlocals or (s.globals | s.nonlocals) & s.params or s.typed & (s.globals | s.nonlocals):
                raise Bad("global")

    # Statements

    def program(self) -> None:
        self.future = True
        first = True
        while self.kind() != ENDMARKER:
            if self.kind() == NEWLINE:
                self.i += 1
                continue
            if self.kind() in (INDENT, DEDENT):
                raise Bad("indent")
            here = self.kind() == STRING and self.ahead()[0] in (NEWLINE, ENDMARKER) or self.kind() == STRING and self.ahead()[1] == ";"
            if not (self.at("from") and self.ahead() == (NAME, "__future__")) and not (first and here):
                self.future = False
            first = False
            self.statement()
        self.settle()

    def statement(self) -> None:
        t, s = self.toks[self.i]
        if t == INDENT:
            raise Bad("indent")
        if t == NAME and s in KEYWORDS or s == "@" and t == OP:
            run = {"if": self.if_, "while": self.while_, "for": self.for_, "try": self.try_, "with": self.with_, "def": self.def_, "class": self.class_, "@": self.decorated, "async": self.async_}.get(s)
            if run:
                run()
                return
        elif t == NAME and s == "match" and self.is_match():
            self.match()
            return
        self.simple()

    def simple(self) -> None:
        while True:
            self.small()
            if not self.take(";"):
                break
            if self.kind() == NEWLINE:
                break
        if self.kind() != NEWLINE:
            raise Bad("statement")
        self.i += 1

    def suite(self) -> None:
        self.need(":")
        if self.kind() != NEWLINE:
            t, s = self.toks[self.i]
            if t == NAME and s in ("if", "while", "for", "try", "with", "def", "class", "async") or s == "@" and t == OP:
                raise Bad("block")
            self.simple()
            return
        self.i += 1
        if self.kind() != INDENT:
            raise Bad("block")
        self.i += 1
        while self.kind() != DEDENT:
            if self.kind() == ENDMARKER:
                raise Bad("block")
            self.statement()
        self.i += 1

    def block(self) -> None:
        """A suite of a statement that the frame of a function holds open."""
        f = self.holder()
        f.blocks += 1
        if f.blocks > NESTED_BLOCKS:
            raise Bad("nesting")
        self.suite()
        f.blocks -= 1

    def small(self) -> None:
        s = self.toks[self.i][1] if self.kind() == NAME else ""
        f = self.scope
        if s == "pass":
            self.i += 1
        elif s in ("break", "continue"):
            if not f.loops or f.group:
                raise Bad(s)
            self.i += 1
        elif s == "return":
            if f.kind != "function" or f.handlers:
                raise Bad(s)
            self.i += 1
            if self.kind() != NEWLINE and not self.at(";"):
                f.returns = True
                self.no_star(self.exprs())
        elif s == "raise":
            self.i += 1
            if self.kind() != NEWLINE and not self.at(";"):
                self.expr()
                if self.take("from"):
                    self.expr()
        elif s in ("global", "nonlocal"):
            self.i += 1
            if s == "nonlocal" and f.kind == "module":
                raise Bad(s)
            while True:
                n = unicodedata.normalize("NFKC", self.name())
                if n in f.used or n in f.bound or n in f.params:
                    raise Bad(s)
                (f.globals if s == "global" else f.nonlocals).add(n)
                if not self.take(","):
                    break
        elif s == "del":
            self.i += 1
            x = self.exprs()
            self.erase(x)
        elif s == "assert":
            self.i += 1
            self.expr()
            if self.take(","):
                self.expr()
        elif s == "import":
            self.i += 1
            while True:
                parts = self.dotted()
                if self.take("as"):
                    self.bind(self.name())
                else:
                    self.bind(parts[0])
                if not self.take(","):
                    break
        elif s == "from":
            self.from_()
        elif s == "type" and self.is_name(1) and self.ahead(2)[1] in ("=", "["):
            self.i += 1
            self.bind(self.name())
            self.enter("type")
            self.type_params()
            self.need("=")
            self.expr()
            self.leave()
        else:
            self.assignment()

    def dotted(self) -> list[str]:
        parts = [self.name()]
        while self.take("."):
            parts.append(self.name())
        return parts

    def from_(self) -> None:
        self.i += 1
        dots = False
        while self.take(".", "..."):
            dots = True
        module = [] if dots and self.at("import") else self.dotted()
        self.need("import")
        future = not dots and module == ["__future__"]
        if future and not self.future:
            raise Bad("future")
        if self.take("*"):
            if self.scope.kind != "module" or future:
                raise Bad("import")
            return
        wrapped = self.take("(")
        while True:
            n = self.name()
            if future and n not in FEATURES - {"barry_as_FLUFL"}:
                raise Bad("future")
            self.bind(self.name() if self.take("as") else n)
            if not self.take(","):
                break
            if wrapped and self.at(")"):
                break
        if wrapped:
            self.need(")")

    def assignment(self) -> None:
        x = self.yield_() if self.at("yield") else self.exprs()
        if self.take(":"):
            bare = x
            if x[0] == "paren" and x[1][0] == "name":
                bare = x[1]
            self.single(bare)
            if x[0] == "name":
                self.scope.typed.add(x[1])
            self.expr()
            if self.take("="):
                self.no_star(self.yield_() if self.at("yield") else self.exprs())
        elif self.kind() == OP and self.toks[self.i][1] in AUGMENTED:
            self.single(x[1] if x[0] == "paren" and x[1][0] in ("name", "attr", "sub") else x)
            self.i += 1
            self.no_star(self.yield_() if self.at("yield") else self.exprs())
        else:
            while self.take("="):
                if x[0] == "star":
                    raise Bad("target")
                self.store(x)
                x = self.yield_() if self.at("yield") else self.exprs()
            self.no_star(x)

    def no_star(self, x: tuple) -> None:
        if x[0] == "star":
            raise Bad("star")

    def if_(self) -> None:
        self.i += 1
        self.named()
        self.suite()
        while self.take("elif"):
            self.named()
            self.suite()
        if self.take("else"):
            self.suite()

    def looped(self) -> None:
        f = self.scope
        f.loops += 1
        group, f.group = f.group, False
        self.block()
        f.loops -= 1
        f.group = group
        if self.take("else"):
            self.suite()

    def while_(self) -> None:
        self.i += 1
        self.named()
        self.looped()

    def for_(self) -> None:
        self.i += 1
        x = self.exprs(target=True)
        self.no_star(x)
        self.store(x)
        self.need("in")
        self.no_star(self.exprs())
        self.looped()

    def try_(self) -> None:
        self.i += 1
        self.block()
        handlers, bare, group = 0, False, None
        while self.take("except"):
            starred = self.take("*")
            if bare or group is not None and group != starred:
                raise Bad("except")
            group, handlers = starred, handlers + 1
            if self.at(":"):
                if starred:
                    raise Bad("except")
                bare = True
            else:
                self.expr()
                if self.take("as"):
                    self.bind(self.name())
            f = self.scope
            held, f.group, f.handlers = f.group, f.group or starred, f.handlers + starred
            self.block()
            f.group, f.handlers = held, f.handlers - starred
        if handlers and self.take("else"):
            self.suite()
        if self.take("finally"):
            self.block()
        elif not handlers:
            raise Bad("try")

    def with_(self) -> None:
        self.i += 1
        if self.at("(") and self.items_in_brackets():
            self.i += 1
            while True:
                self.item()
                if not self.take(",") or self.at(")"):
                    break
            self.need(")")
        else:
            while True:
                self.item()
                if not self.take(","):
                    break
        self.block()

    def items_in_brackets(self) -> bool:
        depth, j, found = 0, self.i, False
        while j < len(self.toks):
            t, s = self.toks[j]
            if t == OP and s in ("(", "[", "{"):
                depth += 1
            elif t == OP and s in (")", "]", "}"):
                depth -= 1
                if not depth:
                    return found and self.toks[j + 1][1] == ":"
            elif t == NAME and s == "as" and depth == 1:
                found = True
            elif t in (NEWLINE, ENDMARKER):
                return False
            j += 1
        return False

    def item(self) -> None:
        self.expr()
        if self.take("as"):
            self.store(self.star_or(self.primary))

    def async_(self) -> None:
        self.i += 1
        if self.at("def"):
            self.def_(True)
        elif self.at("with", "for"):
            if self.scope.kind != "function" or not self.scope.is_async:
                raise Bad("async")
            (self.with_ if self.at("with") else self.for_)()
        else:
            raise Bad("async")

    def decorated(self) -> None:
        while self.take("@"):
            self.named()
            if self.kind() != NEWLINE:
                raise Bad("decorator")
            self.i += 1
        if self.take("async"):
            if not self.at("def"):
                raise Bad("async")
            self.def_(True)
        elif self.at("def"):
            self.def_()
        elif self.at("class"):
            self.class_()
        else:
            raise Bad("decorator")

    def type_params(self) -> None:
        if not self.take("["):
            return
        seen, default = set(), False
        while True:
            star = self.take("*") or self.take("**")
            n = self.name()
            if n in seen:
                raise Bad("parameter")
            seen.add(n)
            self.bind(n)
            if self.take(":"):
                if star:
                    raise Bad("parameter")
                self.expr()
            if self.take("="):
                default = True
                self.star_or(self.expr) if star else self.expr()
            elif default:
                raise Bad("parameter")
            if not self.take(",") or self.at("]"):
                break
        self.need("]")

    def def_(self, is_async: bool = False) -> None:
        self.i += 1
        self.bind(self.name())
        typed = self.at("[")
        if typed:
            self.enter("type")
            self.type_params()
        self.need("(")
        params = self.params(")", True)
        self.need(")")
        if self.take("->"):
            self.expr()
        f = self.enter("function", is_async)
        f.params = params
        self.suite()
        self.leave()
        if typed:
            self.leave()

    def params(self, end: str, annotated: bool) -> set[str]:
        seen: set[str] = set()
        default = star = slash = False

        def one() -> None:
            n = self.name()
            if n in seen or n == "__debug__":
                raise Bad("parameter")
            seen.add(n)

        while not self.at(end):
            if self.take("/"):
                if slash or star or not seen:
                    raise Bad("/")
                slash = True
            elif self.take("**"):
                one()
                if annotated and self.take(":"):
                    self.expr()
                self.take(",")
                if not self.at(end):
                    raise Bad("**")
                break
            elif self.take("*"):
                if star:
                    raise Bad("*")
                star = True
                if self.at(","):
                    if not self.is_name(1):
                        raise Bad("*")
                else:
                    one()
                    if annotated and self.take(":"):
                        self.star_or(self.expr)
            else:
                one()
                if annotated and self.take(":"):
                    self.expr()
                if self.take("="):
                    self.expr()
                    default = True
                elif default and not star:
                    raise Bad("default")
            if not self.take(","):
                break
        return seen

    def class_(self) -> None:
        self.i += 1
        self.bind(self.name())
        typed = self.at("[")
        if typed:
            self.enter("type")
            self.type_params()
        if self.take("("):
            self.args(False)
        self.enter("class")
        self.suite()
        self.leave()
        if typed:
            self.leave()

    # Patterns

    def is_match(self) -> bool:
        t, s = self.ahead()
        if t in (NEWLINE, ENDMARKER) or t == OP and s in ("=", ".", ",", ")", ":", ";") or s in AUGMENTED:
            return False
        j = self.i
        while self.toks[j][0] not in (NEWLINE, ENDMARKER):
            j += 1
        return self.toks[j - 1] == (OP, ":") and [x[0] for x in self.toks[j : j + 2]] == [NEWLINE, INDENT] and self.toks[j + 2 : j + 3] == [(NAME, "case")]

    def match(self) -> None:
        self.i += 1
        self.subject()
        self.need(":")
        self.i += 2
        open_ = False
        while self.kind() != DEDENT:
            if open_ or not self.take("case"):
                raise Bad("case")
            names: list[str] = []
            free = self.open_sequence(names)
            guarded = self.take("if")
            if guarded:
                self.named()
            if len(names) != len(set(names)):
                raise Bad("pattern")
            for n in names:
                self.bind(n)
            self.suite()
            open_ = free and not guarded
        self.i += 1

    def subject(self) -> None:
        x = self.star_or(self.named)
        if self.at(","):
            while self.take(","):
                if self.at(":"):
                    break
                self.star_or(self.named)
        else:
            self.no_star(x)

    def open_sequence(self, names: list[str]) -> bool:
        """A case's pattern; whether it takes everything."""
        stars = self.at("*")
        free = self.maybe_star(names)
        if not self.at(","):
            if stars:
                raise Bad("pattern")
            return free
        while self.take(","):
            if self.at(":", "if"):
                break
            if self.at("*"):
                if stars:
                    raise Bad("pattern")
                stars = True
            self.maybe_star(names)
        return False

    def maybe_star(self, names: list[str]) -> bool:
        if self.take("*"):
            n = self.name()
            if n != "_":
                names.append(n)
            return False
        return self.pattern(names)

    def pattern(self, names: list[str]) -> bool:
        free = self.alternatives(names)
        if self.take("as"):
            n = self.name()
            if n == "_" or free:
                raise Bad("pattern")
            names.append(n)
        return free

    def alternatives(self, names: list[str]) -> bool:
        first: list[str] = []
        free = self.closed(first)
        while self.take("|"):
            if free:
                raise Bad("pattern")
            other: list[str] = []
            free = self.closed(other)
            if set(other) != set(first):
                raise Bad("pattern")
        names += first
        return free

    def closed(self, names: list[str]) -> bool:
        t, s = self.toks[self.i]
        if t in (STRING, FSTRING_START):
            if t == FSTRING_START:
                raise Bad("pattern")
            self.strings()
        elif t == NUMBER or self.at("-"):
            self.take("-")
            self.number()
            real = not self.toks[self.i - 1][1].lower().endswith("j")
            if self.take("+", "-"):
                if not real or self.kind() != NUMBER or not self.toks[self.i][1].lower().endswith("j"):
                    raise Bad("pattern")
                self.number()
        elif self.take("None", "True", "False"):
            pass
        elif self.take("("):
            if self.take(")"):
                return False
            free = self.open_group(names)
            self.need(")")
            return free
        elif self.take("["):
            stars = 0
            while not self.at("]"):
                stars += self.at("*")
                if stars > 1:
                    raise Bad("pattern")
                self.maybe_star(names)
                if not self.take(","):
                    break
            self.need("]")
        elif self.take("{"):
            while not self.at("}"):
                if self.take("**"):
                    n = self.name()
                    if n == "_":
                        raise Bad("pattern")
                    names.append(n)
                    self.take(",")
                    if not self.at("}"):
                        raise Bad("pattern")
                    break
                if self.is_name():
                    if len(self.dotted()) < 2:
                        raise Bad("pattern")
                else:
                    self.closed_literal()
                self.need(":")
                self.pattern(names)
                if not self.take(","):
                    break
            self.need("}")
        else:
            parts = self.dotted()
            if self.take("("):
                keywords: set[str] = set()
                while not self.at(")"):
                    if self.is_name() and self.ahead() == (OP, "="):
                        n = self.name()
                        if n in keywords:
                            raise Bad("pattern")
                        keywords.add(n)
                        self.i += 1
                    elif keywords:
                        raise Bad("pattern")
                    self.pattern(names)
                    if not self.take(","):
                        break
                self.need(")")
                return False
            if len(parts) == 1:
                if parts[0] != "_":
                    names.append(parts[0])
                return True
        return False

    def closed_literal(self) -> None:
        if self.kind() in (STRING, NUMBER) or self.at("-", "None", "True", "False"):
            self.closed([])
        else:
            raise Bad("pattern")

    def open_group(self, names: list[str]) -> bool:
        stars = self.at("*")
        free = self.maybe_star(names)
        if not self.at(","):
            if stars:
                raise Bad("pattern")
            return free
        while self.take(","):
            if self.at(")"):
                break
            if self.at("*"):
                if stars:
                    raise Bad("pattern")
                stars = True
            self.maybe_star(names)
        return False

    # Expressions

    def star_or(self, one) -> tuple:
        if self.take("*"):
            return ("star", self.operand())
        return one()

    def exprs(self, target: bool = False) -> tuple:
        """Expressions with commas; as a ``target`` of a loop only what comes before ``in``."""
        one = self.operand if target else self.expr
        x = self.star_or(one)
        if not self.at(","):
            return x
        out = [x]
        while self.take(","):
            t, s = self.toks[self.i]
            if t in (NEWLINE, ENDMARKER) or s in ("=", ")", "]", "}", ":", ";", "in", "!") or s in AUGMENTED or t == FSTRING_MIDDLE:
                break
            out.append(self.star_or(one))
        return ("tuple", out)

    def yield_(self) -> tuple:
        f = self.scope
        while f.kind == "type":
            raise Bad("yield")
        if f.kind != "function":
            raise Bad("yield")
        self.i += 1
        f.yields = True
        if self.take("from"):
            if f.is_async:
                raise Bad("yield")
            self.expr()
        elif self.kind() not in (NEWLINE, ENDMARKER) and not self.at(")", "]", "}", ";", "=", "!", ":"):
            self.no_star(self.exprs())
        return ("yield",)

    def named(self) -> tuple:
        """An expression, or a name with ``:=``."""
        if self.is_name() and self.ahead() == (OP, ":="):
            n = self.name()
            self.i += 1
            if self.iterating:
                raise Bad(":=")
            s = self.scope
            while s.kind == "comp":
                s.walrus.add(n)
                s = s.above
            if self.scope.kind == "comp" and s.kind == "class":
                raise Bad(":=")
            self.bind(n, s)
            self.expr()
            return ("named",)
        return self.expr()

    def expr(self) -> tuple:
        if self.at("lambda"):
            return self.lambda_()
        x = self.operators()
        while self.take("if"):
            self.operators()
            self.need("else")
            if self.at("lambda"):
                self.lambda_()
                return ("op",)
            self.operators()
            x = ("op",)
        return x

    def lambda_(self) -> tuple:
        entered = 0
        while self.take("lambda"):
            params = self.params(":", False)
            self.need(":")
            self.enter("function").params = params
            entered += 1
        self.expr()
        for _ in range(entered):
            self.leave()
        return ("op",)

    def operators(self) -> tuple:
        """Operands with signs and operators between them; a lone operand keeps its kind."""
        x = self.signed()
        while True:
            t, s = self.toks[self.i]
            if t == OP and s in BINARY or t == NAME and s in ("and", "or", "is", "in"):
                self.i += 1
                if s == "is":
                    self.take("not")
                    self.no_not()
                elif s not in ("and", "or"):
                    self.no_not()
            elif t == NAME and s == "not" and self.ahead() == (NAME, "in"):
                self.i += 2
                self.no_not()
            else:
                return x
            self.signed()
            x = ("op",)

    def no_not(self) -> None:
        if self.at("not"):
            raise Bad("not")

    def operand(self) -> tuple:
        """An operand up to ``in``, with the operators that bind closer."""
        x = self.signed()
        while self.kind() == OP and self.toks[self.i][1] in ("|", "^", "&", "<<", ">>", "+", "-", "*", "/", "//", "%", "@"):
            self.i += 1
            self.signed()
            x = ("op",)
        return x

    def signed(self) -> tuple:
        x, tight = None, False
        while True:
            if self.at("not"):
                if tight:
                    raise Bad("not")
                self.i += 1
                x = ("op",)
            elif self.at("-", "+", "~"):
                self.i += 1
                tight, x = True, ("op",)
            else:
                y = self.awaited()
                if not self.take("**"):
                    return x or y
                tight, x = True, ("op",)

    def awaited(self) -> tuple:
        if self.take("await"):
            s = self.scope
            while s.kind == "comp":
                s = s.above
            if s.kind != "function" or not s.is_async:
                raise Bad("await")
            self.primary()
            return ("op",)
        return self.primary()

    def primary(self) -> tuple:
        x = self.atom()
        while True:
            if self.take("."):
                self.name()
                x = ("attr",)
            elif self.take("("):
                self.args(True)
                x = ("call",)
            elif self.take("["):
                self.subscripts()
                x = ("sub",)
            else:
                return x

    def subscripts(self) -> None:
        while True:
            if self.take("*"):
                self.operators()
            else:
                if not self.at(":"):
                    self.named()
                if self.take(":"):
                    if not self.at(":", ",", "]"):
                        self.expr()
                    if self.take(":") and not self.at(",", "]"):
                        self.expr()
            if not self.take(",") or self.at("]"):
                break
        self.need("]")

    def args(self, generator: bool) -> None:
        """Arguments up to and with the closing parenthesis."""
        words: set[str] = set()
        keyed = mapped = False
        count = 0
        while not self.at(")"):
            count += 1
            if self.take("**"):
                self.expr()
                mapped = True
            elif self.take("*"):
                if mapped:
                    raise Bad("argument")
                self.expr()
            elif self.kind() == NAME and self.ahead() == (OP, "="):
                n = self.name()
                if n in words or n == "__debug__":
                    raise Bad("argument")
                words.add(n)
                self.i += 1
                self.expr()
                keyed = True
            else:
                if keyed or mapped:
                    raise Bad("argument")
                if count == 1 and generator and self.i - 1 in self.loops_within:
                    self.comprehension()
                    break
                self.named()
            if not self.take(","):
                break
        self.need(")")

    def comprehension(self, pair: bool = False) -> None:
        """The element and the clauses of a comprehension."""
        outer = self.scope
        comp = self.enter("comp", outer.is_async)
        if self.at("*", "**"):
            raise Bad("comprehension")
        self.named()
        if pair and self.take(":"):
            self.expr()
        if not self.at("for", "async"):
            raise Bad("comprehension")
        first = True
        while self.at("for", "async"):
            if self.take("async"):
                s = self.holder()
                if s.kind != "function" or not s.is_async:
                    raise Bad("async")
            self.need("for")
            x = self.exprs(target=True)
            self.no_star(x)
            self.store(x, comp)
            comp.targets |= names_in(x)
            self.need("in")
            self.iterating += 1
            self.scope = outer if first else comp  # what is gone through first is read outside
            self.operators_or_if()
            self.scope, first = comp, False
            self.iterating -= 1
            while self.take("if"):
                self.condition()
        if comp.walrus & comp.targets:
            raise Bad(":=")
        self.leave()

    def operators_or_if(self) -> None:
        if self.at("lambda"):
            raise Bad("lambda")
        self.operators()

    def condition(self) -> None:
        if self.at("lambda"):
            raise Bad("lambda")
        self.named() if self.is_name() and self.ahead() == (OP, ":=") else self.operators()

    def atom(self) -> tuple:
        t, s = self.toks[self.i]
        if t == NAME:
            if s in KEYWORDS:
                if s in ("None", "True", "False"):
                    self.i += 1
                    return ("lit",)
                raise Bad(s)
            self.i += 1
            self.scope.used.add(unicodedata.normalize("NFKC", s))
            return ("name", s)
        if t == NUMBER:
            self.number()
            return ("lit",)
        if t in (STRING, FSTRING_START):
            self.strings()
            return ("lit",)
        if t != OP:
            raise Bad("expression")
        if s == "...":
            self.i += 1
            return ("lit",)
        if s == "(":
            return self.round()
        if s == "[":
            self.i += 1
            return self.listed()
        if s == "{":
            self.i += 1
            self.braced()
            return ("lit",)
        raise Bad(s)

    def round(self) -> tuple:
        self.i += 1
        if self.take(")"):
            return ("tuple", [])
        if self.at("yield"):
            self.yield_()
            self.need(")")
            return ("op",)
        if self.i - 1 in self.loops_within:
            self.comprehension()
            self.need(")")
            return ("op",)
        x = self.star_or(self.named)
        if self.at(","):
            out = [x]
            while self.take(","):
                if self.at(")"):
                    break
                out.append(self.star_or(self.named))
            self.need(")")
            return ("tuple", out)
        self.no_star(x)
        self.need(")")
        return ("paren", x)

    def listed(self) -> tuple:
        out = []
        if self.i - 1 in self.loops_within:
            self.comprehension()
            self.need("]")
            return ("op",)
        while not self.at("]"):
            out.append(self.star_or(self.named))
            if not self.take(","):
                break
        self.need("]")
        return ("list", out)

    def braced(self) -> None:
        mapping = None
        if self.i - 1 in self.loops_within:
            self.comprehension(pair=True)
            self.need("}")
            return
        while not self.at("}"):
            if self.take("**"):
                if mapping is False:
                    raise Bad("entry")
                mapping = True
                self.operators()
            elif self.at("*"):
                if mapping:
                    raise Bad("entry")
                mapping = False
                self.star_or(self.named)
            else:
                walrus = self.is_name() and self.ahead() == (OP, ":=")
                self.named()
                pair = self.take(":")
                if pair:
                    if walrus:
                        raise Bad("entry")
                    self.expr()
                if mapping is not None and mapping != pair:
                    raise Bad("entry")
                mapping = pair
            if not self.take(","):
                break
        self.need("}")

    def number(self) -> None:
        if self.kind() != NUMBER:
            raise Bad("number")
        s = self.toks[self.i][1]
        if not NUMBERS.fullmatch(s) or s.isascii() and s.replace("_", "").isdigit() and len(s.replace("_", "")) > LONGEST_INT:
            raise Bad("number")
        self.i += 1
        t, s = self.toks[self.i]
        if t in (NUMBER, NAME) and s not in KEYWORDS:
            raise Bad("number")

    def strings(self) -> None:
        """Literals side by side: all bytes or none, each with sound escapes; formatted ones with sound fields."""
        kinds = set()
        while self.kind() in (STRING, FSTRING_START):
            t, s = self.toks[self.i]
            self.i += 1
            if t == FSTRING_START:
                kinds.add("text")
                self.fields("r" not in s.lower().rstrip("\"'"))
                continue
            cut = min(s.index(q) for q in "\"'" if q in s)
            prefix, body = s[:cut].lower(), s[cut:]
            body = body[3:-3] if body[:3] in ('"""', "'''") else body[1:-1]
            kinds.add("bytes" if "b" in prefix else "text")
            if "b" in prefix and not body.isascii():
                raise Bad("bytes")
            if "r" not in prefix and "\\" in body:
                escapes(body, "b" in prefix)
        if len(kinds) > 1:
            raise Bad("bytes")

    def fields(self, cooked: bool) -> None:
        """The rest of a formatted string, or of a format within it up to its closing brace."""
        while True:
            t, s = self.toks[self.i]
            if t == FSTRING_END:
                self.i += 1
                return
            if t == OP and s == "}":
                return
            if t == FSTRING_MIDDLE:
                self.i += 1
                if cooked and "\\" in s:
                    escapes(s.replace("{", "").replace("}", "") if "\\N" not in s else s, False)
            elif t == OP and s == "{":
                self.i += 1
                self.no_star(self.yield_() if self.at("yield") else self.exprs())
                self.take("=")
                if self.take("!"):
                    if self.name() not in ("s", "r", "a"):
                        raise Bad("conversion")
                if self.take(":"):
                    self.fields(cooked)
                self.need("}")
            else:
                raise Bad("field")


def kinds_above(scope: Scope) -> list[str]:
    out = []
    while scope := scope.above:
        out.append(scope.kind)
    return out


def names_in(x: tuple) -> set[str]:
    if x[0] == "name":
        return {x[1]}
    if x[0] in ("tuple", "list"):
        return {n for y in x[1] for n in names_in(y)}
    return names_in(x[1]) if x[0] in ("star", "paren") else set()


def escapes(body: str, plain: bool) -> None:
    """Raises where an escape is cut short or names no character."""
    for m in ESCAPE.finditer(body):
        c = m[0][1]
        if c == "x" and len(m[0]) == 2 and not re.match(r"[0-9a-fA-F]{2}", body[m.end() : m.end() + 2]):
            raise Bad("escape")
        if plain:
            continue
        if c in "uU" and len(m[0]) == 2:
            width = 4 if c == "u" else 8
            code = body[m.end() : m.end() + width]
            if not re.fullmatch(rf"[0-9a-fA-F]{{{width}}}", code) or int(code, 16) > 0x10FFFF:
                raise Bad("escape")
        if c == "N":
            try:
                unicodedata.lookup(m[1] or "")
            except KeyError:
                raise Bad("escape") from None


def fault_of(tokens: list[tuple[int, str]]) -> str:
    """'' if the tokens are a module, else what they break."""
    try:
        Productions(tokens).program()
        return ""
    except Bad as e:
        return str(e) or "syntax"

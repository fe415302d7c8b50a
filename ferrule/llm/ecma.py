"""Lexer and productions of JavaScript and TypeScript.

``lex`` cuts a text into tokens; ``Productions`` reduces the tokens by the productions
of scripts and modules, with the type syntax of TypeScript where that is asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Reserved words and punctuators of the language.
RESERVED = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
BEFORE_REGEX = set("return typeof case in of delete void throw new instanceof do else await yield".split())
PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
ASSIGN = set("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = set("== != === !== < > <= >= << >> >>> + - * / % ** & | ^ && || ?? in instanceof".split())
IDENT = re.compile(r"(?:[^\W\d]|[$_‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")


class Bad(Exception):
    """The text breaks a lexical rule or a production."""


@dataclass(slots=True)
class Token:
    kind: str  # n name, d number, s string, t template, r regular expression, p punctuator, e end
    text: str
    line_before: bool
    at: int
    parts: list = field(default_factory=list)


def lex(src: str, at: int = 0, in_template: bool = False) -> tuple[list[Token], int]:
    """Tokens from ``at`` on, up to the end or, in a template, its closing brace."""
    out: list[Token] = []
    n, nl, depth = len(src), True, 0
    if at == 0 and src.startswith("﻿"):
        at = 1
    if src.startswith("#!", at) and not in_template:
        at = src.find("\n", at) if "\n" in src[at:] else n
    while at < n:
        c = src[at]
        if c in "\n\r  ":
            nl = True
            at += 1
        elif c.isspace() or c == "﻿":
            at += 1
        elif src.startswith("//", at):
            while at < n and src[at] not in "\n\r  ":
                at += 1
        elif src.startswith("/*", at):
            end = src.find("*/", at + 2)
            if end < 0:
                raise Bad("comment")
            nl = nl or "\n" in src[at:end]
            at = end + 2
        elif c in "\"'":
            j = at + 1
            while j < n and src[j] != c:
                if src[j] in "\n\r":
                    raise Bad("string")
                j += 2 if src[j] == "\\" else 1
                if src[j - 2 : j] == "\\\r" and src[j : j + 1] == "\n":
                    j += 1
            if j >= n:
                raise Bad("string")
            out.append(Token("s", src[at : j + 1], nl, at))
            at, nl = j + 1, False
        elif c == "`":
            j, parts = at + 1, []
            while True:
                if j >= n:
                    raise Bad("template")
                if src[j] == "\\":
                    j += 2
                elif src[j] == "`":
                    break
                elif src.startswith("${", j):
                    inner, j = lex(src, j + 2, True)
                    parts.append(inner)
                else:
                    j += 1
            out.append(Token("t", "`", nl, at, parts))
            at, nl = j + 1, False
        elif m := NUMBER.match(src, at) if c.isdigit() or c == "." and src[at + 1 : at + 2].isdigit() else None:
            at = m.end()
            if at < n and (src[at].isalnum() or src[at] in "_$"):
                raise Bad("number")
            out.append(Token("d", m[0], nl, m.start()))
            nl = False
        elif m := IDENT.match(src, at):
            out.append(Token("n", m[0], nl, at))
            at, nl = m.end(), False
        elif c == "/" and (not out or out[-1].kind == "p" and out[-1].text not in (")", "]", "}") or out[-1].kind == "n" and out[-1].text in BEFORE_REGEX or out[-1].text == "}" and nl):
            j, in_class = at + 1, False
            while j < n and (src[j] != "/" or in_class):
                if src[j] in "\n\r":
                    raise Bad("regular expression")
                if src[j] == "\\":
                    j += 1
                elif src[j] == "[":
                    in_class = True
                elif src[j] == "]":
                    in_class = False
                j += 1
            if j >= n:
                raise Bad("regular expression")
            flags = re.compile(r"[a-z]*").match(src, j + 1)[0]
            out.append(Token("r", src[at : j + 1], nl, at))
            at, nl = j + 1 + len(flags), False
        elif m := PUNCT.match(src, at):
            if in_template and c == "}" and depth == 0:
                out.append(Token("e", "", nl, at))
                return out, at + 1
            depth += (c == "{") - (c == "}")
            out.append(Token("p", m[0], nl, at))
            at, nl = m.end(), False
        else:
            raise Bad("character")
    if in_template:
        raise Bad("template")
    out.append(Token("e", "", nl, n))
    return out, n


class Productions:
    """Reduces tokens by the grammar; ``program`` raises ``Bad`` where no production applies."""

    def __init__(self, tokens: list[Token], types: bool) -> None:
        self.t, self.i, self.types = tokens, 0, types
        self.functions = self.loops = self.breaks = self.level = 0
        self.no_in = self.target = self.ambient = False
        self.asynchronous = True  # a module may await at its top
        self.no_types: set[int] = set()
        self.after: dict[int, Token] = {}  # of every opening bracket the token after its closing one
        opened = []
        for tok, following in zip(tokens, tokens[1:], strict=False):
            if tok.kind == "p" and tok.text in ("(", "[", "{"):
                opened.append(tok)
            elif tok.kind == "p" and tok.text in (")", "]", "}") and opened:
                self.after[id(opened.pop())] = following

    # Tokens
    def peek(self, text: str, k: int = 0) -> bool:
        j = self.i + k
        return j < len(self.t) and self.t[j].text == text and self.t[j].kind in "np"

    def any(self, *texts: str) -> bool:
        return self.t[self.i].kind in "np" and self.t[self.i].text in texts

    def take(self, text: str) -> bool:
        if self.peek(text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if text == ">" and self.t[self.i].kind == "p" and self.t[self.i].text.startswith(">") and len(self.t[self.i].text) > 1:
            tok = self.t[self.i]
            self.t = [*self.t[: self.i], Token("p", ">", tok.line_before, tok.at), Token("p", tok.text[1:], False, tok.at + 1), *self.t[self.i + 1 :]]
        if not self.take(text):
            raise Bad(text)

    def kind(self, k: int = 0) -> str:
        return self.t[min(self.i + k, len(self.t) - 1)].kind

    def fresh(self, k: int = 0) -> bool:
        return self.t[min(self.i + k, len(self.t) - 1)].line_before

    def name(self) -> str:
        tok = self.t[self.i]
        if tok.kind != "n" or tok.text in RESERVED:
            raise Bad("name")
        self.i += 1
        return tok.text

    def word(self) -> None:
        """Any name, reserved or not."""
        if self.take("#"):
            pass
        if self.kind() != "n":
            raise Bad("name")
        self.i += 1

    def end(self) -> None:
        """A semicolon, or a place where one may be missing."""
        if self.take(";") or self.peek("}") or self.kind() == "e" or self.fresh():
            return
        raise Bad("end of statement")

    def attempt(self, production) -> bool:
        at, toks = self.i, self.t
        try:
            production()
            return True
        except Bad:
            self.i, self.t = at, toks
            return False

    # Statements
    def program(self) -> None:
        while self.kind() != "e":
            self.statement(True)

    def block(self) -> None:
        self.need("{")
        self.level += 1
        while not self.peek("}"):
            if self.kind() == "e":
                raise Bad("}")
            self.statement()
        self.level -= 1
        self.need("}")

    def body(self, asynchronous: bool = False) -> None:
        saved = self.functions, self.loops, self.breaks, self.asynchronous, self.no_in
        self.functions, self.loops, self.breaks, self.asynchronous, self.no_in = self.functions + 1, 0, 0, asynchronous, False
        self.block()
        self.functions, self.loops, self.breaks, self.asynchronous, self.no_in = saved

    def statement(self, top: bool = False) -> None:
        tok = self.t[self.i]
        w = tok.text if tok.kind in "np" else ""
        nxt = self.t[min(self.i + 1, len(self.t) - 1)]
        if w == "{":
            self.block()
        elif w == ";":
            self.i += 1
        elif w in ("var", "const") or w == "let" and (nxt.kind == "n" and nxt.text not in ("in", "instanceof", "of") or nxt.text in ("[", "{")):
            if w == "const" and nxt.text == "enum" and self.types:
                self.i += 1
                self.statement()
                return
            self.i += 1
            self.declarators(w == "const")
            self.end()
        elif w == "function" or w == "async" and nxt.text == "function" and not nxt.line_before:
            self.function(True)
        elif w == "class" or w == "@":
            while self.peek("@"):
                self.decorator()
            if self.any("export", "abstract", "default"):
                self.statement(top)
            else:
                self.class_(True)
        elif w == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.take("else"):
                self.statement()
        elif w == "while":
            self.i += 1
            self.condition()
            self.looped()
        elif w == "do":
            self.i += 1
            self.looped()
            self.need("while")
            self.condition()
            self.take(";")
        elif w == "for":
            self.for_()
        elif w in ("break", "continue"):
            self.i += 1
            if self.kind() == "n" and not self.fresh() and not self.any(*RESERVED):
                self.i += 1
            elif not (self.loops if w == "continue" else self.loops + self.breaks):
                raise Bad(w)
            self.end()
        elif w == "return":
            if not self.functions:
                raise Bad("return")
            self.i += 1
            if not (self.any(";", "}") or self.kind() == "e" or self.fresh()):
                self.expression()
            self.end()
        elif w == "throw":
            self.i += 1
            if self.fresh():
                raise Bad("throw")
            self.expression()
            self.end()
        elif w == "try":
            self.i += 1
            self.block()
            caught = self.take("catch")
            if caught:
                if self.take("("):
                    self.binding()
                    self.need(")")
                self.block()
            if self.take("finally"):
                self.block()
            elif not caught:
                raise Bad("try")
        elif w == "switch":
            self.i += 1
            self.condition()
            self.need("{")
            self.breaks += 1
            defaults = 0
            while not self.take("}"):
                if self.take("case"):
                    self.expression()
                elif self.take("default"):
                    defaults += 1
                else:
                    raise Bad("case")
                self.need(":")
                while not (self.any("case", "default", "}") or self.kind() == "e"):
                    self.statement()
            self.breaks -= 1
            if defaults > 1:
                raise Bad("default")
        elif w == "with":
            self.i += 1
            self.condition()
            self.statement()
        elif w == "debugger":
            self.i += 1
            self.end()
        elif w == "import" and nxt.text not in ("(", "."):
            if not top:
                raise Bad("import")
            self.import_()
        elif w == "export":
            if not top:
                raise Bad("export")
            self.export()
        elif self.types and self.type_statement(w, nxt, top):
            pass
        elif tok.kind == "n" and w not in RESERVED and nxt.text == ":" and nxt.kind == "p":
            self.i += 2
            self.loops += 1
            self.statement()
            self.loops -= 1
        else:
            self.expression()
            self.end()

    def looped(self) -> None:
        self.loops += 1
        self.statement()
        self.loops -= 1

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def declarators(self, const: bool, header: bool = False) -> None:
        while True:
            pattern = self.any("[", "{")
            self.binding_target()
            if self.types:
                self.take("!")
                self.annotation()
            if self.take("="):
                self.assignment()
            elif (const or pattern) and not header and not self.ambient:
                raise Bad("initializer")
            if not self.take(","):
                return

    def for_(self) -> None:
        self.i += 1
        if self.take("await") and not self.asynchronous:
            raise Bad("await")
        self.need("(")
        self.no_in = True
        if self.any("var", "let", "const"):
            const = self.peek("const")
            self.i += 1
            self.declarators(const, header=True)
        elif not self.peek(";"):
            self.expression()
        self.no_in = False
        if self.take("of"):
            self.assignment()
        elif self.take("in"):
            self.expression()
        else:
            self.need(";")
            if not self.peek(";"):
                self.expression()
            self.need(";")
            if not self.peek(")"):
                self.expression()
        self.need(")")
        self.looped()

    def string(self) -> None:
        if self.kind() != "s":
            raise Bad("module name")
        self.i += 1
        if self.any("with", "assert") and not self.fresh():
            self.i += 1
            self.object()

    def specifiers(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.types and self.peek("type") and self.kind(1) in "ns" and not self.peek("as", 1):
                self.i += 1
            if self.kind() == "s":
                self.i += 1
            else:
                self.word()
            if self.take("as"):
                if self.kind() == "s":
                    self.i += 1
                else:
                    self.word()
            if not self.take(","):
                self.need("}")
                return

    def import_(self) -> None:
        self.i += 1
        if self.kind() == "s":
            self.string()
            return self.end()
        if self.types and self.peek("type") and (self.kind(1) == "n" and not self.peek("from", 1) or self.any("type") and self.t[self.i + 1].text in ("{", "*")):
            self.i += 1
        if self.kind() == "n":
            self.name()
            if self.types and self.take("="):
                self.expression()
                return self.end()
            if not self.take(","):
                self.need("from")
                self.string()
                return self.end()
        if self.take("*"):
            self.need("as")
            self.name()
        else:
            self.specifiers()
        self.need("from")
        self.string()
        return self.end()

    def export(self) -> None:
        self.i += 1
        if self.take("default"):
            if self.any("function") or self.peek("async") and self.peek("function", 1):
                self.function(True, named=False)
            elif self.any("class", "@") or self.types and self.peek("abstract"):
                while self.peek("@"):
                    self.decorator()
                self.take("abstract")
                self.class_(True, named=False)
            elif self.types and self.peek("interface"):
                self.statement()
            else:
                self.assignment()
                self.end()
        elif self.take("*"):
            if self.take("as"):
                self.word()
            self.need("from")
            self.string()
            self.end()
        elif self.peek("{") or self.types and self.peek("type") and self.peek("{", 1):
            self.take("type")
            self.specifiers()
            if self.take("from"):
                self.string()
            self.end()
        elif self.types and self.take("="):
            self.expression()
            self.end()
        elif self.types and self.take("as"):
            self.need("namespace")
            self.name()
            self.end()
        elif self.any("var", "let", "const", "function", "class", "async", "@") or self.types and self.any("type", "interface", "enum", "abstract", "declare", "namespace", "module", "import"):
            before = self.i
            self.statement(True)
            if self.i == before:
                raise Bad("export")
        else:
            raise Bad("export")

    # Functions and classes
    def function(self, statement: bool, named: bool = True) -> None:
        asynchronous = self.take("async")
        self.need("function")
        self.take("*")
        if self.kind() == "n":
            self.name()
        elif statement and named:
            raise Bad("function name")
        self.signature()
        if self.types and not self.peek("{"):
            return self.end()
        return self.body(asynchronous)

    def signature(self) -> None:
        if self.types and self.peek("<"):
            self.type_parameters()
        self.need("(")
        self.parameters()
        if self.types and self.take(":"):
            self.return_type()

    def parameters(self) -> None:
        while not self.take(")"):
            while self.peek("@"):
                self.decorator()
            if self.types:
                while self.any("public", "private", "protected", "readonly", "override") and (self.kind(1) == "n" or self.t[self.i + 1].text in "[{"):
                    self.i += 1
            rest = self.take("...")
            if self.types and self.peek("this"):
                self.i += 1
            else:
                self.binding_target()
            if self.types:
                self.take("?")
                self.annotation()
            if not rest and self.take("="):
                self.assignment()
            if not self.take(","):
                self.need(")")
                return
            if rest:
                raise Bad("rest")

    def binding(self) -> None:
        self.binding_target()
        if self.types:
            self.annotation()
        if self.take("="):
            self.assignment()

    def binding_target(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if not self.take(","):
                    self.need("]")
                    return
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.binding_target()
                else:
                    short = self.kind() == "n"
                    reserved = short and self.t[self.i].text in RESERVED
                    self.property_name()
                    if self.take(":"):
                        self.binding_target()
                    elif not short or reserved:
                        raise Bad("binding")
                    if self.take("="):
                        self.assignment()
                if not self.take(","):
                    self.need("}")
                    return
        else:
            self.name()

    def property_name(self) -> None:
        if self.take("["):
            saved, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = saved
            self.need("]")
        elif self.kind() in "sd":
            self.i += 1
        else:
            self.word()

    def decorator(self) -> None:
        self.need("@")
        if self.take("("):
            self.expression()
            self.need(")")
            return
        self.word()
        while self.take("."):
            self.word()
        if self.peek("("):
            self.arguments()

    def class_(self, statement: bool, named: bool = True) -> None:
        self.need("class")
        if self.kind() == "n" and not self.any("extends") and not (self.types and self.peek("implements")):
            self.name()
        elif statement and named:
            raise Bad("class name")
        if self.types and self.peek("<"):
            self.type_parameters()
        if self.take("extends"):
            self.operand()
            if self.types and self.peek("<"):
                self.type_arguments()
        if self.types and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        while not self.take("}"):
            if self.kind() == "e":
                raise Bad("}")
            if not self.take(";"):
                self.member()

    def member(self) -> None:
        while self.peek("@"):
            self.decorator()
        if self.peek("static") and self.peek("{", 1):
            self.i += 1
            return self.body()
        mods = {"static", "async", "get", "set", "accessor"} | ({"public", "private", "protected", "readonly", "abstract", "declare", "override"} if self.types else set())
        asynchronous = False
        while self.kind() == "n" and self.t[self.i].text in mods and not (self.t[self.i + 1].text in ("(", "=", ";", "}", ":", "?", "!", "<") and self.kind(1) == "p") and not (self.fresh(1) and self.kind(1) != "p" and self.t[self.i].text in ("async", "get", "set", "accessor")) and self.kind(1) != "e":
            asynchronous |= self.t[self.i].text == "async"
            self.i += 1
        self.take("*")
        if self.types and self.peek("[") and self.kind(1) == "n" and self.peek(":", 2):
            self.i += 2
            self.annotation()
            self.need("]")
            self.annotation()
            return self.end()
        self.property_name()
        if self.types:
            self.take("?") or self.take("!")
        if self.peek("(") or self.types and self.peek("<"):
            self.signature()
            if self.types and not self.peek("{"):
                return self.end()
            return self.body(asynchronous)
        if self.types:
            self.annotation()
        if self.take("="):
            saved = self.functions
            self.functions += 1
            self.assignment()
            self.functions = saved
        return self.end()

    # Expressions
    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def arrow_ahead(self) -> bool:
        """Whether an arrow function begins here: a name and an arrow, or parentheses that an arrow follows."""
        k = self.i + (self.peek("async") and not self.fresh(1) and (self.kind(1) == "n" or self.t[self.i + 1].text in "(<"))
        if k >= len(self.t):
            return False
        if self.t[k].kind == "n" and self.t[k].text not in RESERVED:
            return self.t[min(k + 1, len(self.t) - 1)].text == "=>"
        if self.types and self.t[k].text == "<":
            return True
        if self.t[k].text != "(" or self.t[k].kind != "p":
            return False
        after = self.after.get(id(self.t[k]))
        return after is not None and after.kind == "p" and (after.text == "=>" or self.types and after.text == ":")

    def arrow(self) -> None:
        asynchronous = self.peek("async") and not self.peek("=>", 1)
        if asynchronous:
            self.i += 1
        if self.kind() == "n":
            self.name()
        else:
            self.signature()
        if not self.peek("=>") or self.fresh():
            raise Bad("=>")
        self.i += 1
        if self.peek("{"):
            self.body(asynchronous)
        else:
            saved, self.asynchronous = self.asynchronous, asynchronous
            self.assignment()
            self.asynchronous = saved

    def assignment(self) -> None:
        self.target = False
        if self.arrow_ahead() and self.attempt_arrow():
            self.target = False
            return
        if self.take("yield"):
            self.take("*")
            if not (self.any(")", "]", "}", ",", ";", ":") or self.kind() == "e" or self.fresh()):
                self.assignment()
            return
        self.unary()
        while True:
            tok = self.t[self.i]
            if tok.kind not in "np":
                return
            if tok.text in ASSIGN and tok.kind == "p":
                if not self.target:
                    raise Bad("assignment target")
                self.i += 1
                self.assignment()
                self.target = False
                return
            if tok.text == "?" and tok.kind == "p":
                self.i += 1
                saved, self.no_in = self.no_in, False
                self.assignment()
                self.no_in = saved
                self.need(":")
                self.assignment()
                self.target = False
                return
            if tok.text in BINARY and not (tok.text == "in" and self.no_in) and (tok.kind == "p" or tok.text in ("in", "instanceof")):
                self.i += 1
                self.unary()
                self.target = False
            elif self.types and tok.text in ("as", "satisfies") and not tok.line_before and tok.kind == "n":
                self.i += 1
                self.type()
                if self.any(*ASSIGN):
                    self.target = True
            else:
                return

    def attempt_arrow(self) -> bool:
        at, toks, state = self.i, self.t, (self.functions, self.loops, self.breaks, self.asynchronous, self.no_in, self.level)
        try:
            self.arrow()
            return True
        except Bad:
            if not self.types:
                raise
            self.i, self.t = at, toks
            self.functions, self.loops, self.breaks, self.asynchronous, self.no_in, self.level = state
            return False

    def unary(self) -> None:
        prefix = False
        while self.t[self.i].kind in "np" and (self.t[self.i].text in ("!", "~", "+", "-", "++", "--", "typeof", "void", "delete") or self.peek("await") and (self.asynchronous and not self.any_end(1))):
            self.i += 1
            prefix = True
        if self.types and self.peek("<"):
            self.i += 1
            self.type()
            self.need(">")
            return self.unary()
        self.operand()
        if self.any("++", "--") and not self.fresh():
            if not self.target:
                raise Bad("target")
            self.i += 1
            self.target = False
        if prefix:
            self.target = False
        return None

    def any_end(self, k: int) -> bool:
        j = min(self.i + k, len(self.t) - 1)
        return self.t[j].kind == "e" or self.t[j].kind == "p" and self.t[j].text in (")", "]", "}", ",", ";", "=", ".", ":", "?")

    def arguments(self) -> None:
        self.need("(")
        saved, self.no_in = self.no_in, False
        while not self.take(")"):
            self.take("...")
            self.assignment()
            if not self.take(","):
                self.need(")")
                break
        self.no_in = saved

    def template(self) -> None:
        for inner in self.t[self.i].parts:
            p = Productions(inner, self.types)
            p.functions, p.asynchronous, p.loops = self.functions, self.asynchronous, self.loops
            p.expression()
            if p.kind() != "e":
                raise Bad("template")
        self.i += 1

    def operand(self) -> None:
        """A primary expression and the members, calls and marks after it."""
        tok = self.t[self.i]
        self.target = False
        if tok.kind in "dsr":
            self.i += 1
        elif tok.kind == "t":
            self.template()
        elif tok.kind == "e":
            raise Bad("operand")
        elif tok.text == "(":
            self.i += 1
            saved, self.no_in = self.no_in, False
            self.expression()
            self.no_in = saved
            simple = self.target
            self.need(")")
            self.target = simple
        elif tok.text == "[":
            self.i += 1
            saved, self.no_in = self.no_in, False
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.assignment()
                if not self.take(","):
                    self.need("]")
                    break
            self.no_in = saved
            self.target = True
        elif tok.text == "{":
            self.object()
            self.target = True
        elif tok.text == "function" or tok.text == "async" and self.peek("function", 1) and not self.fresh(1):
            self.function(False)
        elif tok.text in ("class", "@"):
            while self.peek("@"):
                self.decorator()
            self.class_(False)
        elif tok.text == "new":
            self.i += 1
            if self.take("."):
                self.word()
            else:
                self.new_target()
        elif tok.text == "import":
            self.i += 1
            if self.take("."):
                self.word()
            else:
                self.arguments()
        elif tok.text in ("this", "super", "null", "true", "false"):
            self.i += 1
        elif tok.text == "#":
            self.word()
            if not self.peek("in"):
                raise Bad("#")
        elif tok.kind == "n" and tok.text not in RESERVED:
            self.i += 1
            self.target = True
        else:
            raise Bad("operand")
        self.after_operand()

    def new_target(self) -> None:
        if self.peek("new"):
            self.i += 1
            self.new_target()
        elif self.peek("("):
            self.i += 1
            self.expression()
            self.need(")")
        elif self.any("function", "class"):
            self.operand()
            return
        else:
            tok = self.t[self.i]
            if tok.kind != "n" or tok.text in RESERVED and tok.text not in ("this", "super"):
                raise Bad("new")
            self.i += 1
        while True:
            if self.take("."):
                self.word()
            elif self.take("["):
                self.expression()
                self.need("]")
            else:
                break
        if self.types and self.peek("<"):
            self.attempt(self.type_arguments)
        if self.peek("("):
            self.arguments()

    def after_operand(self) -> None:
        while True:
            tok = self.t[self.i]
            if tok.kind == "t":
                self.template()
                self.target = False
                continue
            if tok.kind != "p":
                return
            if tok.text == ".":
                self.i += 1
                self.word()
                self.target = True
            elif tok.text == "?.":
                self.i += 1
                if self.peek("("):
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                else:
                    self.word()
                self.target = False
            elif tok.text == "(":
                self.arguments()
                self.target = False
            elif tok.text == "[":
                self.i += 1
                saved, self.no_in = self.no_in, False
                self.expression()
                self.no_in = saved
                self.need("]")
                self.target = True
            elif self.types and tok.text == "!" and not tok.line_before and not self.peek("=", 1):
                self.i += 1
            elif self.types and tok.text in ("<", "<<") and self.attempt(self.generic_call):
                self.target = False
            else:
                return

    def generic_call(self) -> None:
        self.type_arguments()
        if not (self.peek("(") or self.kind() == "t" or self.any(")", "]", ",", ";", ".", "?.")):
            raise Bad("type arguments")

    def object(self) -> None:
        self.need("{")
        saved, self.no_in = self.no_in, False
        while not self.take("}"):
            if self.take("..."):
                self.assignment()
            else:
                asynchronous = False
                while self.any("get", "set", "async") and (self.kind(1) in "nsd" or self.t[self.i + 1].text in ("[", "*")):
                    asynchronous |= self.peek("async")
                    self.i += 1
                self.take("*")
                short = self.kind() == "n"
                reserved = short and self.t[self.i].text in RESERVED
                self.property_name()
                if self.peek("(") or self.types and self.peek("<"):
                    self.signature()
                    self.body(asynchronous)
                elif self.take(":"):
                    self.assignment()
                elif not short or reserved:
                    raise Bad("property")
                elif self.take("="):
                    self.assignment()
            if not self.take(","):
                self.need("}")
                break
        self.no_in = saved

    # Types
    def annotation(self) -> None:
        if self.take(":"):
            self.type()

    def return_type(self) -> None:
        if self.peek("asserts") and self.kind(1) == "n" and not self.fresh(1):
            self.i += 2
            if self.take("is"):
                self.type()
            return
        if self.kind() == "n" and self.peek("is", 1) and not self.fresh(1):
            self.i += 2
        self.type()

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            while self.any("const", "in", "out") and self.kind(1) == "n":
                self.i += 1
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(",") or self.peek(">"):
                break
        self.need(">")

    def type_arguments(self) -> None:
        """Tried again and again from outer to inner ones; where they failed once they fail always."""
        begin = id(self.t[self.i])
        if begin in self.no_types:
            raise Bad("type arguments")
        try:
            self.type_list()
        except Bad:
            self.no_types.add(begin)
            raise

    def type_list(self) -> None:
        self.need("<")
        while True:
            self.type()
            if not self.take(","):
                break
        self.need(">")

    def type(self) -> None:
        if self.peek("(") and self.function_type_ahead() or self.peek("<") or self.peek("new") or self.peek("abstract") and self.peek("new", 1):
            self.take("abstract")
            self.take("new")
            if self.peek("<"):
                self.type_parameters()
            self.need("(")
            self.parameters()
            self.need("=>")
            return self.return_type()
        if not self.take("|"):
            self.take("&")
        self.type_operand()
        while self.any("|", "&"):
            self.i += 1
            self.type_operand()
        if self.peek("extends") and not self.fresh():
            at, toks = self.i, self.t
            try:
                self.i += 1
                self.type()
                self.need("?")
                self.type()
                self.need(":")
                self.type()
            except Bad:
                self.i, self.t = at, toks
        return None

    def function_type_ahead(self) -> bool:
        after = self.after.get(id(self.t[self.i]))
        return after is not None and after.text == "=>"

    def type_operand(self) -> None:
        tok = self.t[self.i]
        if tok.text in ("keyof", "readonly", "unique", "infer") and tok.kind == "n" and (self.kind(1) in "ns" or self.t[self.i + 1].text in ("(", "{", "[")):
            self.i += 1
            self.type_operand()
            if tok.text == "infer" and self.peek("extends"):
                self.attempt(lambda: (self.need("extends"), self.type_operand()))
            return
        if tok.text == "typeof" and tok.kind == "n":
            self.i += 1
            self.word()
            while self.take("."):
                self.word()
            if self.peek("<") and not self.fresh():
                self.type_arguments()
        elif tok.text == "import" and tok.kind == "n":
            self.i += 1
            self.need("(")
            self.type()
            self.need(")")
            while self.take("."):
                self.word()
            if self.peek("<"):
                self.type_arguments()
        elif tok.kind in "sd":
            self.i += 1
        elif tok.text == "-" and self.kind(1) == "d":
            self.i += 2
        elif tok.kind == "t":
            for inner in tok.parts:
                p = Productions(inner, True)
                p.type()
                if p.kind() != "e":
                    raise Bad("template type")
            self.i += 1
        elif tok.text == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif tok.text == "[":
            self.i += 1
            while not self.take("]"):
                self.take("...")
                if self.kind() == "n" and (self.peek(":", 1) or self.peek("?", 1) and self.peek(":", 2)):
                    self.i += 1
                    self.take("?")
                    self.need(":")
                self.type()
                self.take("?")
                if not self.take(","):
                    self.need("]")
                    break
        elif tok.text == "{":
            self.type_members()
        elif tok.kind == "n" and (tok.text not in RESERVED or tok.text in ("this", "null", "void", "true", "false")):
            self.i += 1
            while self.take("."):
                self.word()
            if self.peek("<") and not self.fresh():
                self.type_arguments()
        else:
            raise Bad("type")
        while self.peek("[") and not self.fresh():
            self.i += 1
            if not self.take("]"):
                self.type()
                self.need("]")

    def type_members(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.kind() == "e":
                raise Bad("}")
            if self.any("-", "+") and self.peek("readonly", 1):
                self.i += 1
            while self.any("readonly", "get", "set") and (self.kind(1) in "nsd" or self.t[self.i + 1].text == "["):
                self.i += 1
            if self.peek("(") or self.peek("<"):
                self.signature()
            elif self.peek("new") and self.t[self.i + 1].text in ("(", "<"):
                self.i += 1
                self.signature()
            elif self.peek("[") and self.kind(1) == "n" and (self.peek(":", 2) or self.peek("in", 2)):
                self.i += 2
                self.i += 1
                self.type()
                if self.take("as"):
                    self.type()
                self.need("]")
                if self.any("-", "+"):
                    self.i += 1
                self.take("?")
                self.annotation()
            else:
                self.property_name()
                self.take("?")
                if self.peek("(") or self.peek("<"):
                    self.signature()
                else:
                    self.annotation()
            if not (self.take(";") or self.take(",") or self.peek("}") or self.fresh()):
                raise Bad("member")

    def type_statement(self, w: str, nxt: Token, top: bool) -> bool:
        """Statements that only TypeScript has; False if none begins here."""
        if w == "interface" and nxt.kind == "n" and not nxt.line_before:
            self.i += 1
            self.name()
            if self.peek("<"):
                self.type_parameters()
            if self.take("extends"):
                self.type()
                while self.take(","):
                    self.type()
            self.type_members()
        elif w == "type" and nxt.kind == "n" and not nxt.line_before and (self.peek("=", 2) or self.peek("<", 2)):
            self.i += 1
            self.name()
            if self.peek("<"):
                self.type_parameters()
            self.need("=")
            self.type()
            self.end()
        elif w == "enum" and nxt.kind == "n":
            self.i += 1
            self.name()
            self.need("{")
            while not self.take("}"):
                self.property_name()
                if self.take("="):
                    self.assignment()
                if not self.take(","):
                    self.need("}")
                    break
        elif w == "abstract" and nxt.text == "class":
            self.i += 1
            self.class_(True)
        elif w == "declare" and nxt.kind == "n" and not nxt.line_before:
            self.i += 1
            saved, self.ambient = self.ambient, True
            if self.take("global"):
                self.block_of_module()
            elif self.any("var", "let", "const"):
                self.i += 1
                self.declarators(False)
                self.end()
            else:
                self.statement(top)
            self.ambient = saved
        elif w in ("namespace", "module") and (nxt.kind == "n" or nxt.kind == "s") and not nxt.line_before:
            self.i += 1
            if self.kind() == "s":
                self.i += 1
            else:
                self.name()
                while self.take("."):
                    self.word()
            if self.peek("{"):
                self.block_of_module()
            else:
                self.end()
        else:
            return False
        return True

    def block_of_module(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.kind() == "e":
                raise Bad("}")
            self.statement(True)


def fault_of(tokens: list[Token], types: bool, deep: bool = False) -> str:
    """'' if the tokens are a script or module, else what they break; nesting too deep to tell gives '', or raises if ``deep``."""
    try:
        Productions(tokens, types).program()
        return ""
    except Bad as e:
        return str(e) or "syntax"
    except RecursionError:
        if deep:
            raise
        return ""  # nested too deep to tell


def check(src: str, types: bool, deep: bool = False) -> str:
    """'' if the text is a script or module, else what it breaks; nesting too deep to tell gives '', or raises if ``deep``."""
    try:
        tokens, _ = lex(src)
    except Bad as e:
        return str(e) or "lexical"
    except RecursionError:
        if deep:
            raise
        return ""  # nested too deep to tell
    return fault_of(tokens, types, deep)

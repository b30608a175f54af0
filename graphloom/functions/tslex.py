"""A lexer for TypeScript and its element syntax: just enough structure to find declarations and uses.

Approximations: a slash starts a regular expression unless a value stands before it; in .tsx
files '<' before a name starts an element unless a value stands before it (so generic arrow
functions there need a comma or extends, as the language itself asks).
"""

from __future__ import annotations

from dataclasses import dataclass

_OPEN = {"(": ")", "[": "]", "{": "}"}
_VALUE_WORDS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "instanceof", "default", "extends"}
_LONG = ("===", "!==", "**=", "<<=", ">>=", "&&=", "||=", "??=", "...", "=>", "==", "!=", "<=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "**")


@dataclass
class Token:
    """kind: id, num, str, tmpl, regex, punct, element (value: its name) or prop (value: the identifier passed)."""

    kind: str
    value: str
    start: int
    end: int
    line: int
    mate: int = -1


class Lexer:
    def __init__(self, text: str, elements: bool) -> None:
        self.text, self.elements = text, elements
        self.tokens: list[Token] = []
        self.at, self.line = 0, 1

    def _add(self, kind: str, value: str, start: int) -> None:
        self.tokens.append(Token(kind, value, start, self.at, self.line))

    def _after_value(self) -> bool:
        if not self.tokens:
            return False
        t = self.tokens[-1]
        if t.kind == "id":
            return t.value not in _VALUE_WORDS
        return t.kind in ("num", "str", "tmpl", "regex") or t.value in (")", "]", "}")

    def _string(self, quote: str) -> str:
        start = self.at + 1
        self.at = start
        while self.at < len(self.text) and self.text[self.at] not in (quote, "\n"):
            self.at += 2 if self.text[self.at] == "\\" else 1
        value = self.text[start : min(self.at, len(self.text))]
        self.at = min(self.at + 1, len(self.text))
        return value

    def _template(self) -> None:
        start, line = self.at, self.line
        self.at += 1
        held: list[Token] = []
        while self.at < len(self.text) and self.text[self.at] != "`":
            c = self.text[self.at]
            if c == "\\":
                self.at += 2
            elif self.text.startswith("${", self.at):
                self.at += 2
                before, self.tokens = self.tokens, []
                self.run("}")
                held += self.tokens
                self.tokens = before
                self.at += 1
            else:
                self.line += c == "\n"
                self.at += 1
        self.at = min(self.at + 1, len(self.text))
        self.tokens.append(Token("tmpl", "", start, self.at, line))
        # expressions inside follow the template, kept apart by semicolons
        for t in held:
            self.tokens.append(t)
        if held:
            self.tokens.append(Token("punct", ";", self.at, self.at, self.line))

    def _regex(self) -> bool:
        at, inside = self.at + 1, False
        while at < len(self.text) and self.text[at] != "\n":
            c = self.text[at]
            if c == "\\":
                at += 1
            elif c == "[":
                inside = True
            elif c == "]":
                inside = False
            elif c == "/" and not inside:
                start, self.at = self.at, at + 1
                while self.at < len(self.text) and self.text[self.at].isalpha():
                    self.at += 1
                self._add("regex", "", start)
                return True
            at += 1
        return False

    def _name(self) -> str:
        start = self.at
        while self.at < len(self.text) and (self.text[self.at].isalnum() or self.text[self.at] in "_$.-:"):
            self.at += 1
        return self.text[start : self.at]

    def _blank(self) -> None:
        while self.at < len(self.text):
            c = self.text[self.at]
            if c.isspace():
                self.line += c == "\n"
                self.at += 1
            elif self.text.startswith("//", self.at):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            elif self.text.startswith("/*", self.at):
                end = self.text.find("*/", self.at + 2)
                end = len(self.text) if end < 0 else end + 2
                self.line += self.text.count("\n", self.at, end)
                self.at = end
            else:
                return

    def _braced(self) -> list[Token]:
        """Tokens of a braced expression; at stands on its opening brace."""
        self.at += 1
        before, self.tokens = self.tokens, []
        self.run("}")
        inner, self.tokens = self.tokens, before
        self.at += 1
        return inner

    def _element(self) -> None:
        start, line = self.at, self.line
        self.at += 1
        name = self._name()
        if name:
            self.tokens.append(Token("element", name, start, self.at, line))
        while self.at < len(self.text):
            self._blank()
            if self.text.startswith("/>", self.at):
                self.at += 2
                return
            c = self.text[self.at : self.at + 1]
            if c == ">":
                self.at += 1
                self._children()
                return
            if c == "{":
                self.tokens += [*self._braced(), Token("punct", ";", self.at, self.at, self.line)]
            elif c in ("'", '"'):
                self._string(c)
            elif c == "=":
                self.at += 1
                self._blank()
                if self.text[self.at : self.at + 1] == "{":
                    inner = self._braced()
                    if len(inner) == 1 and inner[0].kind == "id":
                        inner[0].kind = "prop"
                    self.tokens += [*inner, Token("punct", ";", self.at, self.at, self.line)]
                elif self.text[self.at : self.at + 1] == "<":
                    self._element()
            elif not self._name():
                self.at += 1

    def _children(self) -> None:
        while self.at < len(self.text):
            if self.text.startswith("</", self.at):
                end = self.text.find(">", self.at)
                self.at = len(self.text) if end < 0 else end + 1
                return
            c = self.text[self.at]
            if c == "{":
                self.tokens += [*self._braced(), Token("punct", ";", self.at, self.at, self.line)]
            elif c == "<":
                self._element()
            else:
                self.line += c == "\n"
                self.at += 1

    def run(self, until: str | None = None) -> None:
        """Lexes up to an unmatched `until`, which stays unread, or to the end."""
        depth = 0
        while True:
            self._blank()
            if self.at >= len(self.text):
                return
            c, start = self.text[self.at], self.at
            if c == until and depth == 0:
                return
            if c.isalpha() or c in "_$#@" or ord(c) > 127:
                self.at += 1
                while self.at < len(self.text) and (self.text[self.at].isalnum() or self.text[self.at] in "_$"):
                    self.at += 1
                self._add("id", self.text[start : self.at], start)
            elif c.isdigit():
                while self.at < len(self.text) and (self.text[self.at].isalnum() or self.text[self.at] in "._"):
                    self.at += 1
                self._add("num", "", start)
            elif c in "'\"":
                value = self._string(c)
                self._add("str", value, start)
            elif c == "`":
                self._template()
            elif c == "/" and not self._after_value() and self._regex():
                pass
            elif c == "<" and self.elements and not self._after_value() and (self.text[self.at + 1 : self.at + 2].isalpha() or self.text.startswith("<>", self.at)) and not self._generic_arrow():
                self._element()
            else:
                op = next((o for o in _LONG if self.text.startswith(o, self.at)), c)
                self.at += len(op)
                if until in ("}",):
                    depth += (op == "{") - (op == "}")
                self._add("punct", op, start)

    def _generic_arrow(self) -> bool:
        end = self.text.find(">", self.at)
        head = self.text[self.at + 1 : end] if end > 0 else ""
        return self.text[end + 1 : end + 2] == "(" and ("," in head or " extends " in head)


def lex(text: str, elements: bool = True) -> list[Token]:
    """All tokens, brackets knowing their mates; stray brackets have none."""
    lexer = Lexer(text, elements)
    lexer.run()
    tokens, stack = lexer.tokens, []
    for k, t in enumerate(tokens):
        if t.kind == "punct" and t.value in _OPEN:
            stack.append(k)
        elif t.kind == "punct" and t.value in _OPEN.values():
            while stack and _OPEN[tokens[stack[-1]].value] != t.value:
                stack.pop()
            if stack:
                t.mate = stack.pop()
                tokens[t.mate].mate = k
    return tokens

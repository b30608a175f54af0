"""Finds symbols, typed edges, imports and the skeleton of a TypeScript source, from its tokens."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field

from graphloom.functions.tslex import Token, lex

#: Names of the language and its library, never callees.
IGNORED = frozenset(
    "Array clearTimeout console Error import JSON Math Number Object parseFloat parseInt Promise require setInterval setTimeout String super toString".split()
)
#: Language and library types that make no type edge.
PLAIN_TYPES = frozenset(
    "Promise Map Set WeakMap WeakSet Array ReadonlyArray ReadonlyMap ReadonlySet Record Partial Required Readonly Pick Omit Exclude Extract NonNullable Awaited Parameters ConstructorParameters"
    " ReturnType InstanceType ThisParameterType OmitThisParameter Function Date RegExp Event EventEmitter Element Node Buffer Error TypeError RangeError".split()
)
EMIT, LISTEN, ATTACH = {"run", "runAsync", "priority"}, {"add", "addFrom"}, {"on", "once"}
SPECIAL = EMIT | LISTEN | ATTACH | {"emit", "publish", "subscribe"}
HOOKS = {"useCallback", "useMemo", "useEffectEvent", "useEvent"}
HANDLER = re.compile(r"^(on|handle)[A-Z]")
HIDDEN = "{ /* Implementation Hidden */ }"
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "with", "do", "else", "case", "in", "of", "new", "await", "throw", "delete", "void", "yield", "async", "constructor", "keyof", "extends", "as"}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "override", "async", "abstract", "declare", "get", "set", "accessor"}
_STATEMENT = {"export", "import", "const", "let", "var", "function", "class", "interface", "type", "enum", "namespace", "declare", "abstract", "async"}
_CONTINUES = {".", "?.", "?", ":", "&&", "||", "??", "+", "-", "*", "/", "=", "=>", ",", "==", "===", "!=", "!==", "|", "&", "<", ">", ")", "]", "}"}


@dataclass
class Call:
    name: str
    edge_type: str
    event: str | None = None


@dataclass
class Symbol:
    type: str
    name: str
    line: int
    exported: bool | None = None
    qualified_name: str | None = None
    calls: list[Call] = field(default_factory=list)
    body: str | None = None


@dataclass
class Source:
    symbols: list[Symbol]
    imports: list[str]
    skeleton: str


class Scanner:
    def __init__(self, text: str, path: str) -> None:
        self.text, self.path = text, path
        self.t: list[Token] = lex(text, not path.endswith(".ts"))
        self.symbols: list[Symbol] = []
        self.imports: list[str] = []
        self.hidden: list[tuple[int, int]] = []

    # small steps

    def v(self, i: int) -> str:
        return self.t[i].value if 0 <= i < len(self.t) and self.t[i].kind in ("id", "punct") else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "id"

    def skip(self, i: int) -> int:
        """The token after the one at i, or after its bracket."""
        return self.t[i].mate + 1 if self.v(i) in ("(", "[", "{") and self.t[i].mate > i else i + 1

    def skip_generic(self, i: int) -> int:
        """The token after <...> that starts at i, or i if these are no type arguments."""
        depth, k = 0, i
        while k < len(self.t):
            x = self.v(k)
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if depth == 0:
                    return k + 1
            elif x in (";", "&&", "||", "==", "===", "=", "=>") and x != "=>" or self.t[k].kind in ("num", "regex", "element"):
                return i
            elif x in ("(", "[", "{"):
                k = self.skip(k)
                continue
            elif x in (")", "]", "}"):
                return i
            k += 1
        return i

    def type_end(self, i: int, stops: tuple[str, ...]) -> int:
        """The token at which a type that starts at i ends."""
        k, first = i, True
        while k < len(self.t):
            x = self.v(k)
            if x in stops and not (first and x == "{"):
                return k
            if x == "<":
                after = self.skip_generic(k)
                k = after if after > k else k + 1
            elif x in ("(", "[", "{"):
                k = self.skip(k)
            elif x in (")", "]", "}", ";"):
                return k
            else:
                k += 1
            first = x in ("|", "&", "=>", "is", "keyof", "extends", "?", ":")
        return k

    def expression_end(self, i: int, limit: int) -> int:
        """The token after an expression without braces of its own that starts at i."""
        k = i
        while k < limit:
            x = self.v(k)
            if x in (";", ",", ")", "]", "}"):
                return k
            if k > i and self.t[k].line > self.t[k - 1].line and x not in _CONTINUES and self.v(k - 1) not in _CONTINUES - {")", "]", "}"} and (x in _STATEMENT or self.is_id(k)):
                return k
            k = self.skip(k)
        return k

    def function_at(self, i: int, limit: int) -> tuple[int, int, int, int] | None:
        """(start, body start, body end, end) of the arrow function or function expression at i; body bounds are tokens."""
        k = i
        if self.v(k) == "async" and (self.is_id(k + 1) or self.v(k + 1) in ("(", "<")):
            k += 1
        if self.v(k) == "function":
            k += 1 + (self.v(k + 1) == "*")
            k += self.is_id(k)
            k = self.skip_generic(k) if self.v(k) == "<" else k
            if self.v(k) != "(":
                return None
            k = self.skip(k)
            if self.v(k) == ":":
                k = self.type_end(k + 1, ("{",))
            return (i, k, self.skip(k), self.skip(k)) if self.v(k) == "{" else None
        if self.v(k) == "<":
            k = self.skip_generic(k)
        if self.v(k) == "(":
            k = self.skip(k)
            if self.v(k) == ":":
                k = self.type_end(k + 1, ("=>", ",", ";", "="))
        elif self.is_id(k):
            k += 1
        else:
            return None
        if self.v(k) != "=>":
            return None
        k += 1
        end = self.skip(k) if self.v(k) == "{" else self.expression_end(k, limit)
        return i, k, end, end

    def unwrapped(self, i: int, limit: int) -> tuple[int, int, int, int] | None:
        """The function at i, or the first argument of a known hook there."""
        if self.is_id(i) and self.v(i) in HOOKS:
            k = self.skip_generic(i + 1) if self.v(i + 1) == "<" else i + 1
            return self.function_at(k + 1, self.t[k].mate if self.v(k) == "(" else limit) if self.v(k) == "(" else None
        return self.function_at(i, limit)

    # uses

    def calls(self, a: int, b: int) -> list[Call]:
        found: dict[tuple, Call] = {}

        def add(name: str | None, kind: str, event: str | None = None) -> None:
            if name and len(name) > 1 and name not in IGNORED:
                found.setdefault((name, kind, event), Call(name, kind, event))

        for i in range(a, b):
            if self.is_id(i):
                k = i + 1
                k += self.v(k) == "?." and self.v(k + 1) == "("
                k = self.skip_generic(k) if self.v(k) == "<" else k
                if self.v(k) == "(" and self.t[k].mate > 0:
                    self._call(i, k, add)
        for i in range(a, b):
            if self.t[i].kind == "element" and self.t[i].value[:1].isupper():
                add(self.t[i].value, "jsx")
        for i in range(a, b):
            if self.t[i].kind == "prop":
                add(self.t[i].value, "jsx")
        for i in range(a, b):
            if self.v(i) == "new" and self.is_id(i + 1) and self.v(i + 2) != ".":
                add(self.v(i + 1), "new")
        for name in self._types(a, b):
            add(name, "type")
        return list(found.values())

    def _call(self, i: int, paren: int, add) -> None:  # type: ignore[no-untyped-def]
        name, before = self.v(i), self.v(i - 1)
        close = self.t[paren].mate
        member = before in (".", "?.")
        if not member:
            if name in _NOT_CALLED or before in ("function", "new", "class", "*") or self.v(i - 1) == "function" or (before == "." and self.v(i - 2) == "new"):
                return
            if self.v(close + 1) == "{" and before in ("{", "}", ",", ";", "", *_MODIFIERS):
                return
            if self.v(close + 1) == ":" and before in ("{", "}", ",", ";", *_MODIFIERS) and self.v(self.type_end(close + 2, ("{", "=>", ",", ";"))) == "{":
                return
            add(name, "call")
            return
        k = i - 2
        while k >= 0 and self.v(k) == ".":
            k -= 1
        if self._constructed(i):
            return
        owner, nested = self.v(i - 2) if self.is_id(i - 2) else "", self.v(i - 3) in (".", "?.")
        args = self._arguments(paren, close)
        first = args[0] if args else None
        text = self._literal(first)
        if owner == "callbacks" and name in EMIT:
            add(text, "event_emit")
        if owner == "callbacks" and name in LISTEN and text:
            handler = self._named(args[1] if len(args) > 1 else None)
            if handler:
                add(handler, "event_listen", text)
        if name == "emit":
            add(text or self._member_text(first), "event_emit")
        if name in ATTACH:
            event = text or self._member_text(first)
            if event:
                handler = self._named(args[1] if len(args) > 1 else None)
                add(handler or event, "event_listen", event if handler else None)
        if owner == "Meteor" and not nested and name in ("publish", "subscribe"):
            add(text, f"pubsub_{name}")
        if name in ("call", "callAsync"):
            add(text, "call")
        if name not in SPECIAL:
            add(name, "call")

    def _constructed(self, i: int) -> bool:
        """Whether the member name at i is that of a constructor: new a.b.C()."""
        k = i
        while self.v(k - 1) == "." and self.is_id(k - 2):
            k -= 2
        return self.v(k - 1) == "new"

    def _arguments(self, paren: int, close: int) -> list[tuple[int, int]]:
        out, start, k = [], paren + 1, paren + 1
        while k < close:
            if self.v(k) == ",":
                out.append((start, k))
                start = k + 1
            k = self.skip(k)
        if start < close:
            out.append((start, close))
        return out

    def _literal(self, span: tuple[int, int] | None) -> str | None:
        return self.t[span[0]].value if span and span[1] - span[0] == 1 and self.t[span[0]].kind == "str" else None

    def _member_text(self, span: tuple[int, int] | None) -> str | None:
        """The text of a.b.c, or None for anything else."""
        if not span or span[1] - span[0] < 3 or (span[1] - span[0]) % 2 == 0:
            return None
        if all(self.is_id(k) if (k - span[0]) % 2 == 0 else self.v(k) in (".", "?.") for k in range(*span)):
            return self.text[self.t[span[0]].start : self.t[span[1] - 1].end]
        return None

    def _named(self, span: tuple[int, int] | None) -> str | None:
        """The name of an identifier, or the last of a member access."""
        if span and span[1] - span[0] == 1 and self.is_id(span[0]):
            return self.v(span[0])
        return self.v(span[1] - 1) if self._member_text(span) else None

    def _types(self, a: int, b: int) -> list[str]:
        """Capitalised names in type positions: after the colon of a declaration, a parameter or a result, after as and
        satisfies, and among type arguments."""
        out: list[str] = []

        def collect(i: int, end: int) -> None:
            for k in range(i, min(end, b)):
                name = self.v(k)
                member = self.v(k - 1) == "." or self.v(k + 1) in (":", ".") or (self.v(k + 1) == "?" and self.v(k + 2) == ":")
                if self.is_id(k) and name[:1].isupper() and name.isidentifier() and name not in PLAIN_TYPES and not member:
                    out.append(name)

        for i in range(a, b):
            x = self.v(i)
            if x == ":" and self._annotates(i):
                collect(i + 1, self.type_end(i + 1, (",", "=", "{", "=>", ";")))
            elif x in ("as", "satisfies") and self.is_id(i + 1) and i > a and self.v(i - 1) not in (".", ",", "{"):
                collect(i + 1, self.type_end(i + 1, (",", "=", "{", "=>", ";", ".", "?", ":", "&&", "||", "??")))
            elif x == "<" and self.is_id(i - 1):
                end = self.skip_generic(i)
                if end > i:
                    collect(i + 1, end)
        return out

    def _annotates(self, i: int) -> bool:
        """Whether the colon at i starts a type and is no part of a conditional, an object, a label or a case."""
        k = i - 1 - (self.v(i - 1) in ("?", "!"))
        if self.v(k) == ")":
            after = self.type_end(i + 1, ("{", "=>", ",", ";"))
            return self.v(after) in ("{", "=>")
        if self.v(k) in ("}", "]"):
            k = self.t[k].mate
        elif not self.is_id(k):
            return False
        lead = self.v(k - 1)
        if lead in ("const", "let", "var") or (lead in _MODIFIERS and lead not in ("get", "set")):
            return True
        # a parameter: inside parentheses that a body, an arrow or a result type follows
        depth_open = next((p for p in range(k - 1, -1, -1) if self.v(p) in ("(", "[", "{") and self.t[p].mate > i), -1)
        if depth_open < 0:
            return False
        if self.v(depth_open) == "(" and lead in ("(", ",", "..."):
            return self.v(self.t[depth_open].mate + 1) in ("=>", "{", ":")
        return False

    # declarations

    def _hide(self, a: int, b: int) -> None:
        if self.v(a) == "{":
            self.hidden.append((self.t[a].start, self.t[b - 1].end))

    def _inner(self, a: int, b: int, outer: str) -> None:
        hits: list[tuple[int, str, int]] = [(k, self.v(k + 1), 1) for k in range(a, b) if self.v(k) in ("const", "let", "var") and HANDLER.match(self.v(k + 1))]
        hits += [(k, self.v(k), 0) for k in range(a, b) if self.is_id(k) and HANDLER.match(self.v(k)) and self.v(k + 1) == ":" and self.v(k - 1) in ("{", ",")]
        for k, name, declared in hits:
            at = k + 2
            if declared:
                at = self.type_end(k + 3, ("=", ";")) if self.v(k + 2) == ":" else k + 2
                if self.v(at) != "=":
                    continue
                at += 1
            found = self.unwrapped(at, b)
            if found:
                calls = self.calls(found[0], found[3])
                if calls:
                    self.symbols.append(Symbol("inner_function", name, self.t[k + declared].line, False, f"{outer}.{name}", calls))

    def _class(self, i: int, exported: bool, start: int) -> int:
        named = self.is_id(i + 1) and self.v(i + 1) not in ("extends", "implements")
        k = i + 1
        while k < len(self.t) and self.v(k) != "{":
            after = self.skip_generic(k) if self.v(k) == "<" else k
            k = after if after > k else (self.skip(k) if self.v(k) in ("(", "[") else k + 1)
        end = self.skip(k)
        if not named:
            return end
        name = self.v(i + 1)
        first = len(self.symbols)
        self.symbols.append(Symbol("class", name, self.t[i].line, exported, body=self.text[self.t[start].start : self.t[min(end, len(self.t)) - 1].end]))
        groups: dict[str, list[Symbol]] = {"method": [], "constructor": [], "property": []}
        m = k + 1
        while m < end - 1:
            begin = m
            words = []
            while self.is_id(m) and (self.v(m) in _MODIFIERS or self.v(m).startswith("@")) and self.v(m + 1) not in ("(", "=", ":", ";", "?", "<"):
                words.append(self.v(m))
                m += 1
            if self.v(m).startswith("@"):
                m = self.skip(m + 1) if self.v(m + 1) == "(" else m + 1
                continue
            m += self.v(m) == "*"
            member = self.v(m) if self.is_id(m) else (self.t[m].value if self.t[m].kind == "str" else "")
            if not member:
                m = self.skip(m)
                continue
            line = self.t[begin].line
            at = m + 1 + (self.v(m + 1) in ("?", "!"))
            at = self.skip_generic(at) if self.v(at) == "<" else at
            if self.v(at) == "(":
                body = self.skip(at)
                if self.v(body) == ":":
                    body = self.type_end(body + 1, ("{", ";"))
                stop = self.skip(body) if self.v(body) == "{" else body + (self.v(body) == ";")
                if "get" not in words and "set" not in words:
                    if member != "constructor":
                        inner = len(self.symbols)
                        self._inner(at, stop, f"{name}.{member}")
                        groups["method"] += self.symbols[inner:]
                        del self.symbols[inner:]
                    found = Symbol("method", member, line, exported, f"{name}.{member}", self.calls(at, stop))
                    groups["constructor" if member == "constructor" else "method"].append(found)
                    self._hide(body, stop)
                m = max(stop, m + 1)
            else:
                stop = at
                if self.v(stop) == ":":
                    stop = self.type_end(stop + 1, ("=", ";"))
                if self.v(stop) == "=":
                    found = self.function_at(stop + 1, end - 1)
                    stop = found[3] if found else self.expression_end(stop + 1, end - 1)
                calls = self.calls(m + 1, stop)
                if calls:
                    groups["property"].append(Symbol("class_property", member, line, exported, f"{name}.{member}", calls))
                m = max(stop + (self.v(stop) == ";"), m + 1)
        self.symbols[first + 1 :] = groups["method"] + groups["constructor"] + groups["property"]
        return end

    def scan(self) -> Source:
        classes, functions, types, enums = [], [], [], []
        i, n = 0, len(self.t)
        while i < n:
            start, exported = i, False
            while self.v(i) in ("export", "default", "declare", "abstract") and self.is_id(i + 1):
                exported |= self.v(i) == "export"
                i += 1
            mark, word = len(self.symbols), self.v(i)
            if word == "import" and self.v(i + 1) not in ("(", "."):
                k = i + 1
                while k < n and self.t[k].kind != "str" and self.v(k) != ";":
                    k = self.skip(k)
                if k < n and self.t[k].kind == "str":
                    self.imports.append(self.t[k].value)
                i = k + 1
            elif word == "class":
                i = self._class(i, exported, start)
                classes += self.symbols[mark:]
                del self.symbols[mark:]
            elif word == "function" or (word == "async" and self.v(i + 1) == "function"):
                k = i + (word == "async") + 1
                k += self.v(k) == "*"
                found = self.function_at(i, n)
                if found and self.is_id(k):
                    name = self.v(k)
                    self._inner(found[0], found[3], name)
                    self.symbols.append(Symbol("function", name, self.t[start].line, exported, None, self.calls(k + 1, found[3]), self.text[self.t[start].start : self.t[found[3] - 1].end]))
                    self._hide(found[1], found[2])
                    functions += [(0, s) for s in self.symbols[mark:]]
                    del self.symbols[mark:]
                i = found[3] if found else i + 1
            elif word in ("const", "let", "var") and self.v(i + 1) != "enum":
                i = self._variables(i, exported, start)
                functions += [(1, s) for s in self.symbols[mark:]]
                del self.symbols[mark:]
            elif word == "interface" and self.is_id(i + 1):
                k = i + 2
                while k < n and self.v(k) != "{":
                    k = self.skip_generic(k) if self.v(k) == "<" and self.skip_generic(k) > k else k + 1
                end = self.skip(k)
                types.append((0, Symbol("interface", self.v(i + 1), self.t[start].line, body=self.text[self.t[start].start : self.t[min(end, n) - 1].end])))
                i = end
            elif word == "type" and self.is_id(i + 1) and self.v(i + 2) in ("=", "<"):
                k = self.skip_generic(i + 2) if self.v(i + 2) == "<" else i + 2
                end = self.type_end(k + 1, (";",))
                nexts = [p for p in range(k + 2, end) if self.t[p].line > self.t[p - 1].line and self.v(p) in _STATEMENT]
                end = min([end, *nexts])
                types.append((1, Symbol("type", self.v(i + 1), self.t[start].line, body=self.text[self.t[start].start : self.t[min(end, n) - 1].end])))
                i = end
            elif word == "enum" or (word == "const" and self.v(i + 1) == "enum"):
                k = i + 1 + (word == "const")
                enums.append(Symbol("enum", self.v(k), self.t[start].line))
                i = self.skip(k + 1)
            else:
                i = self.skip(i)
        self.symbols = classes + [s for _, s in sorted(functions, key=lambda x: x[0])] + [s for _, s in sorted(types, key=lambda x: x[0])] + enums
        return Source(self.symbols, self.imports, self._skeleton())

    def _variables(self, i: int, exported: bool, start: int) -> int:
        k = i + 1
        while k < len(self.t):
            name, at = self.v(k) if self.is_id(k) else "", self.skip(k)
            at = self.type_end(at + 1, ("=", ";", ",")) if self.v(at) == ":" else at
            if self.v(at) != "=":
                return max(at, k + 1)
            found = self.function_at(at + 1, len(self.t))
            if found and name:
                self._inner(found[0], found[3], name)
                calls = self.calls(found[0], found[3])
                self.symbols.append(Symbol("variable_function", name, self.t[k].line, exported, None, calls, self.text[self.t[start].start : self.t[found[3] - 1].end]))
                self._hide(found[1], found[2])
            end = found[3] if found else self.expression_end(at + 1, len(self.t))
            if self.v(end) != ",":
                return max(end, k + 1)
            k = end + 1
        return k

    def _skeleton(self) -> str:
        out, at = [], 0
        for a, b in sorted(self.hidden):
            if a >= at:
                out += [self.text[at:a], HIDDEN]
                at = b
        return f"## File: {self.path}\n\n```typescript\n{''.join(out)}{self.text[at:]}\n```"


def scan_source(text: str, path: str) -> Source:
    return Scanner(text, path).scan()


def import_candidates(importer: str, module: str) -> list[str]:
    """Files a relative import may mean, in the order they are tried; none for other modules."""
    if not module.startswith("."):
        return []
    base = posixpath.normpath(posixpath.join(posixpath.dirname(importer), module))
    plain = re.sub(r"\.js$", "", base)
    return [base + ".ts", base + ".tsx", base + "/index.ts", base + "/index.tsx", plain + (".ts" if plain != base else ""), plain + (".tsx" if plain != base else "")]

"""Lexical scopes of JavaScript: which scopes keep variables for functions inside them.

A tokenizer that tells division from regular expressions and follows templates, and one
pass over the tokens that opens scopes at functions, blocks, loops and catch clauses,
notes declarations with their hoisting and references with the function they stand in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Generator
from dataclasses import dataclass, field
from typing import Any, TypeVar

_TOKEN = re.compile(
    r"""(?P<space>[\s  ]+|//[^\n]*|/\*.*?\*/|\#![^\n]*)|(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*|\#[A-Za-z_$][\w$]*)
    |(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<punct>=>|\.\.\.|\?\.(?!\d)|[-+*/%&|^!=<>?]+=?|[{}()\[\];,.:~@`])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*", re.S)
#: Fixed words of the language that are no references.
KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static null true false async await of get set".split()
)
RESERVED = KEYWORDS - frozenset("let static async await of get set yield".split())
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())


T = TypeVar("T")
#: A step that yields further steps, is sent their answers, and ends with its own.
Steps = Generator[Any, Any, T]


class SyntaxProblem(ValueError):
    pass


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    newline: bool = False


def tokenize(source: str) -> list[Token]:
    out: list[Token] = []
    stack: list[str] = []
    i, newline = 0, False
    while i < len(source):
        if stack and stack[-1] == "`":
            j = i
            while j < len(source) and source[j] != "`" and source[j : j + 2] != "${":
                j += 2 if source[j] == "\\" else 1
            if j >= len(source):
                raise SyntaxProblem("template without an end")
            if source[j] == "`":
                stack.pop()
                out.append(Token("string", source[i : j + 1], i, j + 1))
                i = j + 1
            else:
                stack.append("${")
                out.append(Token("punct", "${", j, j + 2))
                i = j + 2
            continue
        last = out[-1] if out else None
        value = last is not None and (last.kind in ("number", "string", "regex") or (last.kind == "name" and last.text not in _BEFORE_REGEX) or last.text in (")", "]", "}"))
        if source[i] == "/" and source[i : i + 2] not in ("//", "/*") and not value:
            m = _REGEX.match(source, i)
            if not m:
                raise SyntaxProblem(f"no token at {i}")
            out.append(Token("regex", m.group(), i, m.end(), newline))
            i, newline = m.end(), False
            continue
        m = _TOKEN.match(source, i)
        if not m:
            raise SyntaxProblem(f"no token at {i}")
        kind, text = m.lastgroup, m.group()
        i = m.end()
        if kind == "space":
            newline |= "\n" in text
            continue
        if text == "`":
            stack.append("`")
        elif text == "{":
            stack.append("{")
        elif text == "}":
            if not stack:
                raise SyntaxProblem("brace closed twice")
            if stack.pop() == "${":
                text = "}$"
        out.append(Token(kind, text, m.start(), i, newline))
        newline = False
    if stack:
        raise SyntaxProblem("brace or template without an end")
    return out


@dataclass
class Scope:
    kind: str
    start: int
    end: int = -1
    parent: int = -1
    function: int = -1
    names: set[str] = field(default_factory=set)
    captured: set[str] = field(default_factory=set)
    uses: set[tuple[int, str]] = field(default_factory=set)  # (scope that declares it, name)
    name: str = ""


class _Builder:
    def __init__(self, source: str) -> None:
        self.t = tokenize(source)
        self.scopes = [Scope("script", 0, len(source), -1, 0)]
        self.refs: list[tuple[str, int]] = []
        self.match = self._brackets()
        self.ends: dict[tuple[str, ...], list[int]] = {}

    def run(self) -> None:
        """Walks the program. What a step asks for is put on a stack of our own, so nesting may be as deep as it likes."""
        stack: list[Generator] = [self.walk(0, len(self.t), 0)]
        answer = None
        while stack:
            try:
                stack.append(stack[-1].send(answer))
                answer = None
            except StopIteration as e:
                stack.pop()
                answer = e.value

    def _brackets(self) -> dict[int, int]:
        pairs, open_ = {}, []
        closing = {")": "(", "]": "[", "}": "{", "}$": "${"}
        for i, t in enumerate(self.t):
            if t.kind == "punct" and t.text in ("(", "[", "{", "${"):
                open_.append(i)
            elif t.kind == "punct" and t.text in closing:
                if not open_ or self.t[open_[-1]].text != closing[t.text]:
                    raise SyntaxProblem("brackets do not match")
                pairs[open_[-1]] = i
                open_.pop()
        if open_:
            raise SyntaxProblem("bracket without an end")
        return pairs

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind in ("name", "punct") else ""

    def open(self, kind: str, start: int, parent: int, function: bool, name: str = "") -> int:
        self.scopes.append(Scope(kind, start, -1, parent, -1, name=name))
        n = len(self.scopes) - 1
        self.scopes[n].function = n if function else self.scopes[parent].function
        return n

    def pattern(self, i: int, end: int, scope: int, into: int) -> Steps[int]:
        """Declares the names of a binding that starts at ``i`` in ``into``; returns where it ends."""
        if self.text(i) in ("{", "["):
            close, at = self.match[i], i + 1
            while at < close:
                if self.text(at) in (",", "..."):
                    at += 1
                    continue
                if self.text(i) == "{":
                    if self.text(at) == "[":
                        yield self.walk(at + 1, self.match[at], scope)
                        at = self.match[at] + 2
                    elif self.text(at + 1) == ":":
                        at += 2
                    elif self.t[at].kind in ("string", "number"):
                        at += 2
                at = yield self.pattern(at, close, scope, into)
                if self.text(at) == "=":
                    stop = self.until(at + 1, close)
                    yield self.walk(at + 1, stop, scope)
                    at = stop
            return close + 1
        if i < end and self.t[i].kind == "name":
            self.scopes[into].names.add(self.t[i].text)
        return i + 1

    def until(self, i: int, end: int, stops: tuple[str, ...] = (",",)) -> int:
        """Where an expression ends: at a stop outside brackets."""
        ahead = self.ends.get(stops)
        if ahead is None:
            ahead = self.ends[stops] = self._ahead(lambda k: self.text(k) in stops)
        return min(ahead[min(i, len(self.t))], end) if i < end else min(i, end)

    def statement_end(self, i: int, end: int) -> int:
        """Where an expression without braces of its own ends, semicolons left out or not."""
        if i >= end:
            return min(i, end)
        if self.t[i].text == ";" and self.t[i].kind == "punct":
            return i
        ahead = self.ends.get(())
        if ahead is None:
            ahead = self.ends[()] = self._ahead(self._ends_statement)
        return min(ahead[self.match.get(i, i) + 1], end)

    def _ends_statement(self, i: int) -> bool:
        """Whether a statement that began before token ``i`` ends in front of it."""
        t, prev = self.t[i], self.t[i - 1]
        if t.text == ";" and t.kind == "punct":
            return True
        joins = (prev.kind == "punct" and prev.text not in (")", "]", "}", "}$", "++", "--")) or (t.kind == "punct" and t.text not in ("{", "++", "--", "!", "~", "@")) or t.text in ("in", "instanceof", "of") or prev.text in ("in", "instanceof", "of", "new", "typeof", "await")
        return t.newline and not joins

    def _ahead(self, stops: Callable[[int], bool]) -> list[int]:
        """For each token the first at or behind it, past brackets, at which ``stops`` holds; made from the back in one pass."""
        n = len(self.t)
        out = [n] * (n + 1)
        for k in range(n - 1, -1, -1):
            out[k] = k if stops(k) else out[self.match.get(k, k) + 1]
        return out

    def function(self, params: int, scope: int, kind: str, start: int, name: str = "", own_name: bool = False) -> Steps[int]:
        """A function whose parameter list opens at ``params``; returns where its body ends."""
        f = self.open(kind, start, scope, True, name)
        if own_name and name:
            self.scopes[f].names.add(name)
        close = self.match[params]
        yield self.parameters(params + 1, close, f)
        body = close + 1
        if self.text(body) != "{":
            raise SyntaxProblem("function without a body")
        yield self.walk(body + 1, self.match[body], f)
        self.scopes[f].end = self.t[self.match[body]].end
        return self.match[body] + 1

    def parameters(self, i: int, end: int, f: int) -> Steps[None]:
        while i < end:
            if self.text(i) in (",", "..."):
                i += 1
                continue
            i = yield self.pattern(i, end, f, f)
            if self.text(i) == "=":
                stop = self.until(i + 1, end)
                yield self.walk(i + 1, stop, f)
                i = stop

    def arrow(self, i: int, end: int, scope: int, start: int) -> Steps[int]:
        f = self.open("arrow", start, scope, True)
        if self.text(i) == "(":
            yield self.parameters(i + 1, self.match[i], f)
            at = self.match[i] + 2
        else:
            self.scopes[f].names.add(self.t[i].text)
            at = i + 2
        if self.text(at) == "{":
            yield self.walk(at + 1, self.match[at], f)
            stop = self.match[at] + 1
        else:
            stop = self.until(at, end, (",", ";"))
            stop = min(stop, self.statement_end(at, stop))
            yield self.walk(at, stop, f)
        self.scopes[f].end = self.t[stop - 1].end if stop > at else self.t[at - 1].end
        return stop

    def class_(self, i: int, end: int, scope: int) -> Steps[int]:
        at = i + 1
        if self.t[at].kind == "name" and self.text(at) not in ("extends",):
            self.scopes[scope].names.add(self.text(at))
            at += 1
        if self.text(at) == "extends":
            stop = self.until(at + 1, end, ("{",))
            yield self.walk(at + 1, stop, scope)
            at = stop
        close = self.match[at]
        at += 1
        while at < close:
            if self.text(at) in ("static", "async", "get", "set", "*", ";") and self.text(at + 1) not in ("(", "=", ";", "}"):
                at += 1
                continue
            if self.text(at) == "{":
                b = self.open("block", self.t[at].start, scope, True)
                yield self.walk(at + 1, self.match[at], b)
                self.scopes[b].end = self.t[self.match[at]].end
                at = self.match[at] + 1
                continue
            start, name = self.t[at].start, self.t[at].text
            if self.text(at) == "[":
                yield self.walk(at + 1, self.match[at], scope)
                at = self.match[at]
            at += 1
            if self.text(at) == "(":
                at = yield self.function(at, scope, "method", start, name)
            elif self.text(at) == "=":
                f = self.open("field", self.t[at].start, scope, True)
                stop = self.statement_end(at + 1, close)
                yield self.walk(at + 1, stop, f)
                self.scopes[f].end = self.t[max(stop - 1, at)].end
                at = stop
            elif self.text(at) == ";":
                at += 1
        return close + 1

    def declare(self, i: int, end: int, scope: int) -> Steps[int]:
        into = self.scopes[scope].function if self.text(i) == "var" else scope
        at = i + 1
        while at < end:
            at = yield self.pattern(at, end, scope, into)
            if self.text(at) == "=":
                stop = self.statement_end(at + 1, self.until(at + 1, end, (",", ";")))
                yield self.walk(at + 1, stop, scope)
                at = stop
            if self.text(at) == ",":
                at += 1
                continue
            break
        return at

    def loop(self, i: int, end: int, scope: int) -> Steps[int]:
        """A ``for`` from its word on, with its body."""
        at = i + 1 + (self.text(i + 1) == "await")
        close = self.match[at]
        inner = [self.text(k) for k in range(at + 1, close)]
        kind = "for-of" if "of" in inner else "for-in" if "in" in inner else "for"
        f = self.open(kind, self.t[i].start, scope, False)
        yield self.walk(at + 1, close, f)
        stop = yield self.body(close + 1, end, f)
        self.scopes[f].end = self.t[stop - 1].end
        return stop

    def body(self, i: int, end: int, scope: int) -> Steps[int]:
        if self.text(i) == "{":
            return (yield self.block(i, scope, "block"))
        if self.text(i) == "for":
            return (yield self.loop(i, end, scope))
        stop = self.statement_end(i, end)
        yield self.walk(i, stop, scope)
        return min(stop + 1, end) if stop < end and self.text(stop) == ";" else stop

    def block(self, i: int, scope: int, kind: str) -> Steps[int]:
        b = self.open(kind, self.t[i].start, scope, False)
        yield self.walk(i + 1, self.match[i], b)
        self.scopes[b].end = self.t[self.match[i]].end
        return self.match[i] + 1

    def is_block(self, i: int) -> bool:
        """Whether a brace opens a block rather than an object."""
        prev = self.t[i - 1] if i else None
        if prev is None:
            return True
        if prev.kind == "punct":
            return prev.text in (")", ";", "{", "}", "=>")
        return prev.text in ("else", "do", "try", "finally")

    def object(self, i: int, scope: int) -> Steps[int]:
        close, at = self.match[i], i + 1
        while at < close:
            if self.text(at) == ",":
                at += 1
                continue
            if self.text(at) == "...":
                stop = self.until(at + 1, close)
                yield self.walk(at + 1, stop, scope)
                at = stop
                continue
            while self.text(at) in ("get", "set", "async", "*") and self.text(at + 1) not in ("(", ":", ",", "}"):
                at += 1
            start, name, key = self.t[at].start, self.t[at].text, at
            if self.text(at) == "[":
                yield self.walk(at + 1, self.match[at], scope)
                at = self.match[at]
            at += 1
            if self.text(at) == "(":
                at = yield self.function(at, scope, "method", start, name)
            elif self.text(at) == ":":
                stop = self.until(at + 1, close)
                yield self.walk(at + 1, stop, scope)
                at = stop
            elif self.t[key].kind == "name":
                self.refs.append((name, scope))
                stop = self.until(at, close)
                yield self.walk(at + (self.text(at) == "="), stop, scope)
                at = stop
        return close + 1

    def walk(self, i: int, end: int, scope: int) -> Steps[None]:
        while i < end:
            t, word = self.t[i], self.text(i)
            prev = self.text(i - 1)
            member = prev in (".", "?.")
            if t.kind == "name" and not member:
                follows = self.text(i + 1)
                if word == "function" or (word == "async" and follows == "function"):
                    at = i + 1 + (word == "async")
                    at += self.text(at) == "*"
                    name = ""
                    statement = prev in ("", ";", "{", "}", ")", "else", "export", "default") or t.newline and self.t[i - 1].kind != "punct"
                    if self.text(at) != "(":
                        name = self.text(at)
                        at += 1
                    if statement and name:
                        self.scopes[scope].names.add(name)
                    i = yield self.function(at, scope, "function", t.start, name, own_name=not statement)
                    continue
                if word == "class":
                    i = yield self.class_(i, end, scope)
                    continue
                if word in ("var", "const") or (word == "let" and (self.t[i + 1].kind == "name" or follows in ("{", "[")) if i + 1 < end else False):
                    i = yield self.declare(i, end, scope)
                    continue
                if word == "for" and follows in ("(", "await"):
                    i = yield self.loop(i, end, scope)
                    continue
                if word == "catch" and follows in ("(", "{"):
                    at = i + 1
                    b = self.open("catch", t.start, scope, False)
                    if follows == "(":
                        yield self.pattern(at + 1, self.match[at], b, b)
                        at = self.match[at] + 1
                    yield self.walk(at + 1, self.match[at], b)
                    self.scopes[b].end = self.t[self.match[at]].end
                    i = self.match[at] + 1
                    continue
                if word == "import" and follows != "(" and follows != ".":
                    stop = self.statement_end(i, end)
                    for k in range(i + 1, stop):
                        if self.t[k].kind == "name" and self.text(k) not in ("from", "as") and self.text(k + 1) != "as":
                            self.scopes[scope].names.add(self.text(k))
                    i = stop
                    continue
                at = i + (word == "async" and (follows == "(" or (self.t[i + 1].kind == "name" if i + 1 < end else False)))
                if at < end and ((self.t[at].kind == "name" and self.text(at + 1) == "=>") or (self.text(at) == "(" and self.text(self.match[at] + 1) == "=>")):
                    i = yield self.arrow(at, end, scope, t.start)
                    continue
                if word not in RESERVED and not (follows == ":" and prev in ("", ";", "{", "}")):
                    self.refs.append((word, scope))
            elif word == "(" and self.text(self.match[i] + 1) == "=>":
                i = yield self.arrow(i, end, scope, t.start)
                continue
            elif word == "{":
                if self.is_block(i):
                    i = yield self.block(i, scope, "block")
                else:
                    i = yield self.object(i, scope)
                continue
            elif word in ("(", "[", "${"):
                yield self.walk(i + 1, self.match[i], scope)
                i = self.match[i] + 1
                continue
            i += 1

    def resolve(self) -> None:
        for name, at in self.refs:
            inside, s = self.scopes[at].function, at
            while s >= 0 and name not in self.scopes[s].names:
                s = self.scopes[s].parent
            if s >= 0 and self.scopes[s].function != inside:
                self.scopes[s].captured.add(name)
                f = inside
                while f != self.scopes[s].function and f > 0:
                    self.scopes[f].uses.add((s, name))
                    f = self.scopes[self.scopes[f].parent].function


def scopes(source: str) -> list[dict] | None:
    """Functions, and blocks that keep or use variables; None where the source cannot be read.

    Variables of the program itself are kept like those of a function around all others; the
    program is no row of its own. Each has kind, name, start and end in characters and in UTF-16 units, the variables that
    it keeps for inner functions (``slots``), and those that it takes from outer scopes
    (``captures``: name and how many keeping scopes lie between).
    """
    try:
        b = _Builder(source)
        b.run()
        b.resolve()
    except (SyntaxProblem, KeyError, IndexError):
        return None
    wide = [0]
    for c in source:
        wide.append(wide[-1] + (2 if ord(c) > 0xFFFF else 1))
    keeps = {i for i, s in enumerate(b.scopes) if s.captured}
    out = []
    for i, s in enumerate(b.scopes):
        if i == 0 or (s.function != i and not s.captured and not s.uses):
            continue
        captures = []
        for at, name in s.uses:
            depth, up = 0, s.parent
            while up != at:
                depth += up in keeps
                up = b.scopes[up].parent
            captures.append({"name": name, "depth": depth})
        captures.sort(key=lambda c: (c["depth"], c["name"]))
        out.append({"scope": i, "parent": s.parent, "kind": s.kind, "name": s.name, "start": s.start, "end": s.end, "start16": wide[s.start], "end16": wide[s.end], "slots": sorted(s.captured), "captures": captures})
    return out

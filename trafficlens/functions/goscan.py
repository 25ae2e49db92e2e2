"""One linear pass over a Go file's text: statements, calls and function headers, whatever lines they span.

A stack of open brackets (no nesting limit, no recursion) tells blocks, whose
lines are statements, from call arguments, indexes and composite literals,
whose lines belong to the statement around them.  A block inside a statement
stands in its text as ``{}``; its own statements follow.  Strings, runes and
comments are tokens, so brackets inside them do not count.
"""

from __future__ import annotations

import re

# A token with the spaces before it; names joined by dots are one token.
_TOKEN = re.compile(
    r"""[^\S\n]*+(?:(?P<word>[^\W\d]\w*)(?P<dotted>(?:\.[^\W\d]\w*)+)?|(?P<skip>//[^\n]*|/\*.*?\*/)"""
    r"""|(?P<text>"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\.)+')"""
    r"""|(?P<number>\d[\w.]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<line>\n)"""
    r"""|(?P<op>:=|\+\+|--|[=!<>]=|\.\.\.|.))""", re.S)
_PAIR = {"(": ")", "[": "]", "{": "}"}
_HEADS = {"func", "if", "for", "switch", "select", "else"}
_GROUPS = {"type", "var", "const", "import"}


class Unreadable(Exception):
    """The text is no Go file: brackets that do not match, or no package clause."""


class _Statement:
    """Text in pieces; what was met before which of them."""

    __slots__ = ("start", "line", "owner", "depth", "pieces", "equals", "commas")

    def __init__(self, start: int, line: int, owner: str, depth: int, lead: str):
        self.start, self.line, self.owner, self.depth = start, line, owner, depth
        self.pieces, self.equals, self.commas = [lead], -1, []

    def text(self) -> str:
        return "".join(self.pieces)


class _Level:
    """An open bracket, or the file: a block holds statements, a group is part of one."""

    __slots__ = ("block", "close", "depth", "statement", "owner", "lead", "head", "outer", "chain", "call", "receiver", "named")

    def __init__(self, block: bool, close: str, depth: int, statement=None, owner: str = "", lead: str = ""):
        self.block, self.close, self.depth, self.statement, self.owner, self.lead = block, close, depth, statement, owner, lead
        self.head = False  # a block must follow (if, for, func, ...)
        self.outer = self.chain = (0, 0)  # where the operand before the bracket began, and the current one
        self.call = None


def _cut(pieces: list[str], marks: list[int]) -> list[str]:
    """The texts of the pieces between marks, stripped; an empty last one (after a trailing comma) is none."""
    parts = ["".join(pieces[a:b]).strip(" ,") for a, b in zip(marks, marks[1:])]
    return parts[:-1] if parts and not parts[-1] else parts


def scan(content: str, wanted, finds: str = "all") -> dict | None:
    """package, statements, calls (of names that ``wanted`` accepts) and funcs of a file; None if it does not parse.

    ``finds``: "all"; "types", the type declarations and the statements inside them alone; or "calls" alone.

    statements: (block, start, line, depth, owner, text, targets, values), those below
    the file's level and type declarations; owner is the head of the type declaration around it, if
    any.  calls: (block, line, start, stop, name, args) of ``x.name(args)``,
    the line being that of x.  funcs: (block, receiver, name, params).
    """
    package, statements, calls, funcs = None, [], [], []
    with_statements, in_bodies, with_calls = finds != "calls", finds == "all", finds != "types"
    file = _Level(True, "", 0)
    stack, line, block, prev, before = [file], 1, -1, "\n", ""
    kind_before = "line"
    waiting: dict[_Statement, list] = {}  # calls by the statement that holds their text

    def finish(level: _Level) -> None:
        nonlocal package
        s, level.statement = level.statement, None
        if s is None:
            return
        pieces = s.pieces
        if s.depth == 0 and package is None:
            text = s.text().strip()
            if not text.startswith("package "):
                raise Unreadable("no package clause")
            package = text[8:].strip()
        for at, start, stop, name, marks, first_line in waiting.pop(s, ()):
            args = _cut(pieces, marks)
            if name is None:
                funcs.append((at, start, stop, args))
            else:
                calls.append((at, first_line, start, stop, name, args))
        if with_statements and (in_bodies or s.owner or not s.depth):
            text = s.text().strip()
            if text and (s.depth or text.startswith("type ")):
                values = _cut(pieces, [s.equals, *s.commas, len(pieces)]) if s.equals >= 0 else []
                targets = "".join(pieces[:s.equals]).rstrip(":= ") if s.equals >= 0 else ""
                statements.append((block, s.start, s.line, s.depth, s.owner, text, targets, values))

    try:
        for m in _TOKEN.finditer(content):
            kind, token = m.lastgroup, m[m.lastgroup]
            top = stack[-1]
            if kind == "word" or kind == "dotted":
                first, spaced = m["word"], m.start("word") > m.start()
                if (s := top.statement) is None:
                    if len(stack) == 1:
                        block += 1
                    s = top.statement = _Statement(m.start("word"), line, top.owner, top.depth, top.lead)
                elif spaced:
                    s.pieces.append(" ")
                if prev != ".":
                    top.chain = (m.start("word"), line)
                    if first in _HEADS:
                        top.head = True
                if kind == "word":
                    s.pieces.append(token)
                    before, prev, kind_before = prev, token, kind
                else:
                    s.pieces.append(first + token)
                    before, prev, kind_before = ".", token[token.rindex(".") + 1:], "word"
                continue
            if (s := top.statement) is not None and m.end() - m.start() > len(token):
                s.pieces.append(" ")
            if kind == "skip":
                if token[:2] == "/*" and "\n" in token:
                    line += token.count("\n")
                if s is not None:
                    s.pieces.append(" ")
                continue
            if kind == "line" or token == ";":
                line += kind == "line"
                if not top.block:
                    if top.statement is not None:
                        top.statement.pieces.append(" " if kind == "line" else ";")
                elif kind == "op" or kind_before in ("word", "number", "text", "close") or prev in ("++", "--", ":", "}"):
                    finish(top)
                    top.head = top.head and kind == "op"
                elif top.statement is not None:
                    top.statement.pieces.append(" ")
                if kind == "line":
                    continue
                before, prev, kind_before = prev, token, kind
                continue
            if kind == "close":
                if len(stack) == 1 or top.close != token:
                    raise Unreadable("brackets do not match")
                if top.block:
                    finish(top)
                stack.pop()
                s = stack[-1].statement
                if top.call is not None:
                    at, name, marks, first_line = top.call
                    start = top.outer[0] if name is not None else top.receiver
                    waiting.setdefault(s, []).append(
                        (at, start, m.end() if name is not None else top.named, name, [*marks, len(s.pieces)], first_line))
                s.pieces.append(token)
                stack[-1].chain = top.outer
                before, prev, kind_before = prev, token, kind
                continue
            if top.block and top.statement is None:
                if len(stack) == 1:
                    block += 1
                top.statement = _Statement(m.start(kind), line, top.owner, top.depth, top.lead)
            s = top.statement
            if kind in ("text", "number") and prev != ".":
                top.chain = (m.start(kind), line)
            if kind == "open":
                operand = kind_before in ("word", "close", "text") and prev not in ("return", "case")
                literal = not top.head and ((operand and prev != ")" and prev not in ("struct", "interface"))
                                            or (not top.block and prev not in ("struct", "interface", ")")))
                if token == "{" and not literal:
                    owner = s.text().strip()
                    owner = owner if owner.startswith("type ") else ""
                    new, top.head = _Level(True, "}", top.depth + 1, owner=owner), False
                elif token == "(" and top.block and prev in _GROUPS and before != ".":
                    new = _Level(True, ")", top.depth, lead=f"{prev} ")
                else:
                    new = _Level(False, _PAIR[token], top.depth, s)
                new.outer = top.chain if operand else (m.start(kind), line)
                s.pieces.append(token)
                if token == "(" and not new.block:
                    if not with_calls:
                        pass
                    elif kind_before == "word" and before == "." and wanted(prev):
                        new.call = (block, prev, [len(s.pieces)], new.outer[1])
                    elif len(stack) == 1 and finds == "all" and kind_before == "word" and top.head and prev != "func" \
                            and (head := re.fullmatch(r"func\s*(?:\((.*)\))?\s*(\w+)\s*\(", s.text().strip(), re.S)):
                        # the header of a function declared at the file's level
                        new.call, new.receiver, new.named = (block, None, [len(s.pieces)], line), head[1] or "", head[2]
                stack.append(new)
            else:
                if token == "," and top.call is not None:
                    top.call[2].append(len(s.pieces))
                if top.block and s.depth:
                    if token in ("=", ":=") and s.equals < 0:
                        s.equals = len(s.pieces) + 1
                    elif token == "," and s.equals >= 0:
                        s.commas.append(len(s.pieces))
                s.pieces.append(token)
                line += token.count("\n") if kind == "text" else 0
                if token == "," and not top.block:
                    top.head = False
            before, prev, kind_before = prev, token, kind
        if len(stack) > 1:
            raise Unreadable("a bracket is open")
        finish(file)
    except Unreadable:
        return None
    return None if package is None else {"package": package, "statements": statements, "calls": calls, "funcs": funcs}

"""What all language extractors share: records, line positions, nesting and relation building."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field


@dataclass
class Unit:
    """An entity of a file, with character offsets."""

    kind: str
    name: str
    start: int
    end: int
    qualified: str = ""
    signature: str = ""
    docstring: str = ""
    visibility: str = "public"
    is_async: bool = False
    bases: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()  # what an import names
    extra: dict = field(default_factory=dict)


@dataclass
class Edge:
    kind: str
    source: str
    target: str
    line: int
    context: str = ""


@dataclass
class Parsed:
    units: list[Unit]
    edges: list[Edge]
    errors: list[str] = field(default_factory=list)


class Lines:
    """Line and column (both from 1 and 0) of character offsets, and byte offsets in UTF-8."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)
        self.ascii = text.isascii()
        self.bytes = None if self.ascii else [0]
        if not self.ascii:
            total = 0
            for a, b in zip(self.starts, [*self.starts[1:], len(text)]):
                total += len(text[a:b].encode())
                self.bytes.append(total)

    def place(self, offset: int) -> tuple[int, int]:
        i = bisect.bisect_right(self.starts, offset) - 1
        return i + 1, offset - self.starts[i]

    def byte(self, offset: int) -> int:
        if self.ascii:
            return offset
        i = bisect.bisect_right(self.starts, offset) - 1
        return self.bytes[i] + len(self.text[self.starts[i] : offset].encode())


def contained(units: list[Unit]) -> list[tuple[Unit, Unit]]:
    """(inner, nearest outer) by offsets; one sweep with a stack."""
    out, stack = [], []
    for u in sorted(units, key=lambda u: (u.start, -u.end)):
        while stack and stack[-1].end < u.end:
            stack.pop()
        if stack and stack[-1] is not u:
            out.append((u, stack[-1]))
        stack.append(u)
    return out


class Nest:
    """Stretches within each other: those around an offset, the innermost first."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.spans = sorted(spans, key=lambda s: (s[0], -s[1]))
        self.starts = [a for a, _ in self.spans]
        self.outer: list[int] = []
        stack: list[int] = []
        for i, (a, _) in enumerate(self.spans):
            while stack and self.spans[stack[-1]][1] <= a:
                stack.pop()
            self.outer.append(stack[-1] if stack else -1)
            stack.append(i)

    def around(self, offset: int) -> Iterator[tuple[int, int]]:
        """Spans with start <= offset < end."""
        i = bisect.bisect_right(self.starts, offset) - 1
        while i >= 0:
            if offset < self.spans[i][1]:
                yield self.spans[i]
            i = self.outer[i]


@functools.cache
def unread(line_marks: tuple[str, ...], blocks: tuple[tuple[str, str], ...], quotes: str) -> re.Pattern:
    """A comment or a string; one that is not closed goes on to the end of the text, a string in ' or " to that of the line."""
    parts = [rf"{re.escape(m)}[^\n]*" for m in line_marks] + [rf"{re.escape(a)}(?:.*?{re.escape(z)}|.*)" for a, z in blocks]
    parts += [rf"(?P<q{i}>{re.escape(q)}(?:[^{re.escape(q)}\\{'' if q == '`' else chr(92) + 'n'}]|\\.)*+(?:[{re.escape(q)}{'' if q == '`' else chr(92) + 'n'}]|\\?\Z))" for i, q in enumerate(quotes)]
    return re.compile("|".join(parts), re.S)


def blanked(text: str, line_marks: tuple[str, ...] = ("//",), blocks: tuple[tuple[str, str], ...] = (("/*", "*/"),), quotes: str = "\"'`") -> str:
    """The text with the insides of comments and strings as spaces, at the same offsets; line feeds stay."""
    space = lambda s: " " * len(s) if "\n" not in s else re.sub(r"[^\n]", " ", s)

    def blank(m: re.Match) -> str:
        s = m[0]
        return space(s) if m.lastgroup is None else s[0] + space(s[1:-1]) + s[1:][-1:]

    return unread(line_marks, blocks, quotes).sub(blank, text)


def block_ends(code: str) -> dict[int, int]:
    """Offset after the closing brace of each opening brace; unclosed ones end with the text."""
    ends, stack = {}, []
    for i, c in enumerate(code):
        if c == "{":
            stack.append(i)
        elif c == "}" and stack:
            ends[stack.pop()] = i + 1
    return ends | {i: len(code) for i in stack}


def comment_before(text: str, start: int, marks: tuple[str, ...] = ("//",)) -> str:
    """The comment block that ends right before an offset, without its marks; attributes and annotations may stand between."""
    head = text[:start].rstrip()
    while (line := head[head.rfind("\n") + 1 :].strip()).startswith(("#[", "@")) and not line.startswith("@interface"):
        head = head[: head.rfind("\n") + 1].rstrip()
    if head.endswith("*/"):
        a = head.rfind("/*")
        return " ".join(x.strip(" *\t") for x in head[a + 2 : -2].lstrip("*").splitlines()).strip()
    lines = []
    end = len(head)
    while end >= 0:
        begin = head.rfind("\n", 0, end) + 1
        s = head[begin:end].strip()
        if not s.startswith(marks):
            break
        lines.append(s.lstrip("/#! ").strip())
        end = begin - 1
    return " ".join(reversed(lines))

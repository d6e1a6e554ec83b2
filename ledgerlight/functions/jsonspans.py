"""Edits of JSON texts by spans: what a path leads to is cut out or replaced, every other character stays as it is.

A text is read token by token; numbers, repeated names and white space are never interpreted, so nothing is rounded,
dropped or laid out anew.  A text that is no JSON is left alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

Step = str | int | None

_TOKEN = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|([{}\[\],:])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9A-Za-z.+-])|true\b|false\b|null\b|NaN\b|-?Infinity\b))')
_END = re.compile(r"[ \t\r\n]*\Z")


class _Container:
    """An open object or array: what may still match below it, and the members read so far."""

    __slots__ = ("closer", "active", "members", "key", "start", "target", "names")

    def __init__(self, opener: str, active: tuple):
        self.closer, self.active = "}" if opener == "{" else "]", active
        self.members: list[tuple[int, int, bool]] = []
        self.key, self.start, self.target = None, 0, False
        self.names: set[str] = set()


def edits(text: str, routes: Sequence[Sequence[Step]], value: str | None, insert: bool = False) -> list[tuple[int, int, str]] | None:
    """(start, end, new text) for every place the routes lead to; None for a text that is no JSON.

    *value* None cuts the member out, else it replaces the value.  *insert* also adds the last name of a route to an object
    that lacks it.  Positions in arrays are those of the text as it is.
    """
    out: list[tuple[int, int, str]] = []
    stack: list[_Container] = []
    at, wants = 0, "value"
    active: tuple = tuple((r, 0) for r in range(len(routes)))
    target, done = False, False

    def below(node: tuple, step: str | int) -> tuple[tuple, bool]:
        """What matches below a member, and whether a route ends there."""
        next_ = [(r, i + 1) for r, i in node if routes[r][i] == step or (routes[r][i] is None and isinstance(step, int))]
        ends = any(i == len(routes[r]) for r, i in next_)
        return (() if ends else tuple(next_)), ends

    def ended(end: int) -> str:
        """A value is complete: it is a member of the open container."""
        nonlocal done
        if not stack:
            done = True
            return "end"
        box = stack[-1]
        box.members.append((box.start, end, box.target))
        return "next"

    while not done:
        token = _TOKEN.match(text, at)
        if not token:
            return None
        quoted, mark, plain = token.groups()
        start, at = token.start(1 if quoted else 2 if mark else 3), token.end()
        if wants in ("value", "first value") and not (mark and mark in "}],:"):
            if stack and stack[-1].closer == "]":
                box = stack[-1]
                box.start = start
                active, target = below(box.active, len(box.members))
                box.target = target
            if mark:
                box = _Container(mark, active)
                stack.append(box)
                box.key = start
                wants = "first name" if mark == "{" else "first value"
                active, target = box.active, False
                continue
            if stack and stack[-1].target and value is not None:
                out.append((start, at, value))
            wants = ended(at)
        elif quoted and wants in ("name", "first name"):
            box = stack[-1]
            name = json.loads(quoted) if "\\" in quoted else quoted[1:-1]
            box.start = start
            box.names.add(name)
            active, target = below(box.active, name)
            box.target = target
            wants = "colon"
        elif mark == ":" and wants == "colon":
            wants = "value"
        elif mark == "," and wants == "next":
            wants = "name" if stack[-1].closer == "}" else "value"
        elif mark and stack and mark == stack[-1].closer and wants in ("next", "first name", "first value"):
            box = stack.pop()
            if stack and stack[-1].target and value is not None:
                out.append((box.key, at, value))
            elif value is None:
                out += _cut(box.members)
            elif insert and mark == "}":
                for r, i in box.active:
                    if i == len(routes[r]) - 1 and isinstance(routes[r][i], str) and routes[r][i] not in box.names:
                        out.append((start, start, ("," if box.members else "") + json.dumps(routes[r][i], ensure_ascii=False) + ":" + value))
            wants = ended(at)
        else:
            return None
    return out if _END.match(text, at) else None


def _cut(members: list[tuple[int, int, bool]]) -> list[tuple[int, int, str]]:
    """Spans to cut, with one separator each, so that what is left is a list of members again."""
    last = max((i for i, m in enumerate(members) if not m[2]), default=-1)
    out = [(start, members[i + 1][0], "") for i, (start, _, gone) in enumerate(members[:max(last, 0)]) if gone]
    if last + 1 < len(members):
        # Behind the last member that stays everything goes, the separator before it too.
        out.append((members[last][1] if last >= 0 else members[0][0], members[-1][1], ""))
    return out


def apply(text: str, changes: list[tuple[int, int, str]]) -> str:
    """The text with its changes; changes inside a span that is cut or replaced go with it."""
    out, at = [], 0
    for start, end, new in sorted(changes, key=lambda c: (c[0], -c[1])):
        if start >= at:
            out += [text[at:start], new]
            at = end
    return "".join(out) + text[at:]


def without(text: str | None, routes: Sequence[Sequence[Step]]) -> str | None:
    """The text without what the routes lead to."""
    changes = edits(text, routes, None) if text else None
    return apply(text, changes) if changes else text


def replaced(text: str | None, route: Sequence[Step], value: str, insert: bool = False) -> str | None:
    """The text with the JSON text *value* where the route leads."""
    changes = edits(text, [route], value, insert) if text else None
    return apply(text, changes) if changes else text

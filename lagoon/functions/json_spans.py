"""Where values lie in JSON text, by byte."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|[\[\]{},:"]|[^\s\[\]{},:"]+', re.S)


def value_spans(data: bytes, deepest: int, begin: int = 0) -> Iterator[tuple[int, str, int, int]]:
    """``depth, pointer, start, end`` of the values down to ``deepest`` levels below a root; an outer value comes after those inside it.

    Several roots may follow each other; the first step of a pointer is then the same. What is inside deeper values is passed over, not checked. A text that ends inside a value gives
    ``(-1, "", start, end)`` for its root at last.
    """
    stack: list[list] = []  # opening byte, start, pointer, index or key, whether a key may come
    for m in _TOKEN.finditer(data, begin):
        token = m.group()
        first = token[:1]
        at = stack[-1] if stack else None
        if first == b":" and at is not None:
            at[4] = False
            continue
        if first == b"," and at is not None:
            if at[0] == b"[":
                at[3] += 1
            else:
                at[4] = True
            continue
        if token == b'"' or (first in b"]}" and (at is None or (at[0] == b"[") != (first == b"]"))):
            break
        if first in b"]}":
            kind, start, pointer, _, _ = stack.pop()
            if len(stack) <= deepest:
                yield len(stack), pointer, start, m.end()
            continue
        if at is not None and at[0] == b"{" and at[4]:
            at[3] = token
            continue
        pointer = ""
        if at is not None and len(stack) <= deepest:
            pointer = f"{at[2]}/{at[3] if at[0] == b'[' else _key(at[3])}"
        if first in b"[{":
            stack.append([first, m.start(), pointer, 0, first == b"{"])
        elif len(stack) <= deepest:
            yield len(stack), pointer, m.start(), m.end()
    if stack:
        yield -1, "", stack[0][1], len(data)


def _key(token: bytes | int) -> str:
    try:
        name = json.loads(token) if isinstance(token, bytes) else ""
    except ValueError:
        name = token.decode("utf-8", "replace").strip('"')
    return str(name).replace("~", "~0").replace("/", "~1")

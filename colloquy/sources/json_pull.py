"""Pull reader for JSON documents of any length.

``json.JSONDecoder`` takes values off a text that arrives in pieces; only the
value being read is held. What it accepts and rejects is what ``json.load``
does: ``NaN`` and the infinities are values (given as their names, which cast
to DOUBLE), a repeated key counts with its last value.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator

_BLANK = re.compile(r"[ \t\n\r]*")
PIECE = 1 << 16


def _number(text: str):
    value = float(text)
    return value if math.isfinite(value) else str(value)


DECODER = json.JSONDecoder(parse_constant=str, parse_float=_number)


def dumps(value) -> str:
    return json.dumps(value, separators=(",", ":"))


def plain(text: str) -> str | None:
    """The document as JSON without the values JSON lacks; None if it is none."""
    try:
        return dumps(DECODER.decode(text))
    except (ValueError, RecursionError):
        return None


class _Text:
    def __init__(self, pieces: Iterable[str]):
        self.pieces, self.buf, self.at = iter(pieces), "", 0

    def more(self) -> bool:
        """Read on, at least as much as is waiting, so that long values are
        not tried again for every piece."""
        waiting = self.buf[self.at:]
        parts, length = [waiting], 0
        for piece in self.pieces:
            parts.append(piece)
            length += len(piece)
            if length >= max(PIECE, len(waiting)):
                break
        self.buf, self.at = "".join(parts), 0
        return length > 0

    def peek(self) -> str:
        while True:
            self.at = _BLANK.match(self.buf, self.at).end()
            if self.at < len(self.buf):
                return self.buf[self.at]
            if not self.more():
                return ""

    def take(self, allowed: str) -> str:
        c = self.peek()
        if not c or c not in allowed:
            raise ValueError(f"expected one of {allowed}")
        self.at += 1
        return c

    def value(self):
        self.peek()
        while True:
            try:
                value, end = DECODER.raw_decode(self.buf, self.at)
            except json.JSONDecodeError as e:
                # cut off, or wrong? Past the end no more can make it right
                cut = e.msg.startswith("Unterminated") or e.pos > len(self.buf) - PIECE // 8
                if not (cut and self.more()):
                    raise
                continue
            if end < len(self.buf) or not self.more():  # a number may go on
                self.at = end
                return value


def pull(pieces: Iterable[str]) -> Iterator[tuple[str, int | None, object]]:
    """``(key, pos, value)`` of the elements of the root object's arrays (of
    the root array: key ''), and ``(key, None, value)`` of its other values.
    Every array begins with ``(key, -1, None)``. Raises ValueError where the
    text is no JSON document."""
    text = _Text(pieces)

    def array(key: str):
        text.take("[")
        yield key, -1, None
        pos = 0
        if text.peek() == "]":
            text.take("]")
            return
        while True:
            yield key, pos, text.value()
            pos += 1
            if text.take(",]") == "]":
                return

    first = text.peek()
    if first == "[":
        yield from array("")
    elif first == "{":
        text.take("{")
        if text.peek() == "}":
            text.take("}")
        else:
            while True:
                if text.peek() != '"':
                    raise ValueError("expected a key")
                key = text.value()
                text.take(":")
                if text.peek() == "[":
                    yield from array(key)
                else:
                    yield key, None, text.value()
                if text.take(",}") == "}":
                    break
    else:
        yield "", None, text.value()
    if text.peek():
        raise ValueError("more than one document")


def document(pieces: Iterable[str], streamed: Iterable[str] = (), dropped: Iterable[str] = ()) -> Iterator[tuple]:
    """Rows ``(kind, key, nth, pos, value)`` of one document, values as JSON:
    an ``element`` for each element of the arrays named in ``streamed``
    (``nth`` counts the times the key has come), ``superseded`` for an array
    whose key came again, and last a ``doc`` with all other values but those
    of the arrays in ``dropped``; its value is None when the text is no JSON
    document."""
    streamed, dropped = set(streamed), set(dropped)
    rest: dict = {}
    root = None
    seen: dict[str, int] = {}
    arrays: dict[str, int] = {}  # streamed keys and the count at which they were arrays
    try:
        for key, pos, value in pull(pieces):
            if pos is None or pos < 0:
                seen[key] = seen.get(key, -1) + 1
                if key in arrays:
                    yield "superseded", key, arrays.pop(key), None, None
                rest.pop(key, None)
                if pos is None:
                    rest[key] = value
                elif key in streamed:
                    arrays[key] = seen[key]
                elif key not in dropped:
                    rest[key] = []
            elif key in arrays:
                yield "element", key, seen[key], pos, dumps(value)
            elif key in rest:
                rest[key].append(value)
        root = dumps(rest)
    except (ValueError, RecursionError):
        pass
    yield "doc", None, None, None, root

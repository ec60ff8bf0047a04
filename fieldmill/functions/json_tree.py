"""Small helpers on one parsed JSON value. Members keep the order they were written in; of repeated ones the last value counts."""

from __future__ import annotations

import json
from collections.abc import Iterator

#: What a text that is not exactly one JSON value is parsed to.
INVALID = object()


def parse(text: str | None) -> object:
    try:
        return INVALID if text is None else json.loads(text.removeprefix("﻿"))
    except (ValueError, RecursionError):
        return INVALID


def shape(value: object) -> str:
    return {dict: "object", list: "array"}.get(type(value)) or type(value).__name__


def display(value: object) -> str:
    """A scalar as it is shown."""
    if isinstance(value, str):
        return value
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def leaves(value: object, max_depth: int | None = None) -> Iterator[tuple[str, str, bool]]:
    """(path, text, whether it is a container below max_depth, as JSON) of every leaf. A stack holds what is open: any depth."""
    stack = [("", value, 0)]
    while stack:
        path, now, depth = stack.pop()
        if not isinstance(now, dict | list):
            yield path or "value", display(now), False
        elif now and depth == max_depth:
            yield path or "value", json.dumps(now, ensure_ascii=False, separators=(",", ":")), True
        elif isinstance(now, dict):
            stack.extend([(f"{path}.{k}" if path else k, v, depth + 1) for k, v in now.items()][::-1])
        else:
            stack.extend([(f"{path or 'records'}[{i}]", v, depth + 1) for i, v in enumerate(now)][::-1])


def opening(value: object) -> str:
    """The line that stands before the pretty-printed value."""
    if isinstance(value, list):
        return f"JSON document containing a list with {len(value)} items.\n"
    if isinstance(value, dict):
        return f"JSON document containing an object with keys: {', '.join(value)}.\n"
    return f"JSON document containing {shape(value)}.\n"


def readable(value: object, most: int | None = None) -> str:
    """The opening line and the value pretty-printed; at least the first `most` characters of it."""
    parts, size = [opening(value)], 0
    try:
        for part in json.JSONEncoder(indent=2, ensure_ascii=False).iterencode(value):
            parts.append(part)
            size += len(part)
            if most is not None and size > most:
                break
    except RecursionError:  # deeper than the printer goes: on one line
        parts[1:] = [json.dumps(value, ensure_ascii=False)]
    return "".join(parts)

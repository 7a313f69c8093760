"""Reading one model reply inside a task, where a retry has to be decided on the spot."""

from __future__ import annotations

import json
import math
import re

_FENCE = re.compile(r"```json\b(.*?)```", re.DOTALL | re.IGNORECASE)
_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'
_TOKEN = re.compile(rf"({_STRING})|//[^\n]*|\b(True|False)\b", re.DOTALL)


def _outside_strings(match: re.Match[str]) -> str:
    if match.group(1) is not None:
        return match.group(1)
    return (match.group(2) or "").lower()


def _distinct(pairs: list[tuple[str, object]]) -> dict:
    if len(dict(pairs)) < len(pairs):
        raise ValueError("a key is given twice")
    return dict(pairs)


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is no number")
    return value


def read_reply(text: str) -> dict:
    """The JSON object of a reply; raises ``ValueError`` if there is none, or if it could not
    be read as a column: with a key given twice or a number that is not finite."""
    fenced = _FENCE.search(text)
    body = (fenced.group(1) if fenced else text).strip()
    body = _TOKEN.sub(_outside_strings, body)
    value = json.loads(body, object_pairs_hook=_distinct, parse_constant=_finite, parse_float=_finite)
    if not isinstance(value, dict):
        raise ValueError("the reply is not a JSON object")
    return value

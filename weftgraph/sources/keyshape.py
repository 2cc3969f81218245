"""Shapes of composed keys (``user:{id}:profile``) and how a reader's shape fits a writer's."""

from __future__ import annotations

import re

HOLE = ""
_SEPARATORS = (":", "/", "|", ".", "-", "_")


#: What a fixed part looks like, and the longest key.
_PART = re.compile(r"[A-Za-z0-9_\-]+")
_LONGEST = 200


def shape_of(pieces: list[str | None]) -> tuple[str, tuple[str, ...]] | None:
    """(separator, parts) of a template given as literal pieces and holes (None); a hole
    is the empty part.  The separator occurs twice or more and gives the most parts.  None
    for what is no key: addresses, paths from a root, several lines, long texts, and texts
    with an empty part or with anything but letters, digits, underscores and hyphens in one."""
    text = "".join("\x00" if p is None else p for p in pieces)
    if len(text) > _LONGEST or "://" in text or "\n" in text or text.startswith(("/", "\\", "http")):
        return None
    best = None
    for s in _SEPARATORS:
        parts = text.removesuffix(s).split(s)
        whole = all(p and _PART.fullmatch(p.replace("\x00", "x")) for p in parts)
        if text.count(s) >= 2 and whole and (best is None or len(parts) > len(best[1])):
            best = (s, tuple(HOLE if "\x00" in p else p for p in parts))
    return best


def literal_shape(text: str) -> tuple[str, tuple[str, ...]] | None:
    return shape_of([text])


def template_shape(text: str) -> tuple[str, tuple[str, ...]] | None:
    """The shape of a format string: braces and percent signs are holes."""
    return shape_of([None if i % 2 else x for i, x in enumerate(re.split(r"(\{[^{}]*\}|%[sd])", text))])


def alignment(writer: tuple[str, ...], reader: tuple[str, ...]) -> tuple[int, int] | None:
    """(offset, hits) of the reader's parts on the writer's where most fixed parts agree
    and none disagrees; the least offset of equals; None if fewer than two agree."""
    best = None
    for offset in range(-len(reader) + 1, len(writer)):
        hits, fits = 0, True
        for i, part in enumerate(reader):
            k = i + offset
            if part and 0 <= k < len(writer) and writer[k]:
                hits, fits = hits + (writer[k] == part), fits and writer[k] == part
        if fits and hits >= 2 and (best is None or hits > best[1]):
            best = (offset, hits)
    return best


def fit_precision(hits: int) -> str:
    return "heuristic" if hits >= 3 else "guess"

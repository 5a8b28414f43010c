"""Immediate repetitions in texts: ``(.{2,}?)\\1+`` -> ``\\1`` without trying every length at every place.

For each place the shortest repeated part is looked up among equal pieces of
text.  A part of g to 2g-1 characters begins with a piece of g characters that
stands again g to 2g-1 places later; three such places would make the piece
itself a repetition of something shorter, so two of them are looked at.  Pieces
of doubled length get their numbers from pairs of numbers, and only pieces found
twice in a line go on: n log n at worst, near n in ordinary text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 20          # characters looked at together (at least one text)


def shortest_parts(text: str) -> np.ndarray:
    """For each place the least length (2 or more) of a part that stands there twice in a row within its line, or 0."""
    a = np.frombuffer(text.encode("utf-32-le"), np.int32)
    n, part = len(a), np.zeros(len(a), np.int64)
    end = a == 10
    for p in range(2, min(8, n // 2 + 1)):
        run = np.zeros(n - p + 1, np.int32)
        np.cumsum((a[:-p] == a[p:]) & ~end[:-p], dtype=np.int32, out=run[1:])
        hit = run[p:] - run[:-p] == p
        part[:len(hit)][hit & (part[:len(hit)] == 0)] = p
    if n < 16:
        return part
    # Numbers of equal pieces of 2, 4 and 8 characters; from 4 on, of one line.
    line = np.cumsum(end)
    chars, many = _dense(a)
    pairs, many = _dense(chars[:-1] * many + chars[1:])
    at = np.flatnonzero((line[:-3] == line[3:]) & ~end[:-3])
    lines = int(line[-1]) + 1
    four = pairs[at] * many + pairs[at + 2]
    if many * many * lines >= 1 << 62:
        four, _ = _dense(four)
    at, number = _repeated(at, four * lines + line[at], n)
    g = 4
    while len(at):
        if g >= 8:
            _longer(part, at, number, g)
        nxt = at[at + g < n]
        nxt = nxt[number[nxt + g] >= 0]
        at, number = _repeated(nxt, number[nxt] * n + number[nxt + g], n)
        g *= 2
    return part


def _dense(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal numbers for equal keys, from 0, and how many there are; by a table where the keys are small."""
    top = int(key.max()) + 1
    if top > 1 << 23:
        values, number = np.unique(key, return_inverse=True)
        return number, len(values)
    there = np.zeros(top, bool)
    there[key] = True
    number = np.cumsum(there) - 1
    return number[key], int(number[-1]) + 1


def _repeated(at: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places whose key occurs twice or more, and a number for equal keys by place (-1 elsewhere)."""
    number = np.full(n, -1, np.int64)
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], np.diff(key[order]) != 0)) if len(key) else np.zeros(0, bool)
    keep = ~(new & np.concatenate((new[1:], [True])))          # neither alone nor the only one
    number[at[order[keep]]] = np.cumsum(new)[keep]
    return np.flatnonzero(number >= 0), number


def _longer(part: np.ndarray, at: np.ndarray, number: np.ndarray, g: int) -> None:
    """Parts of ``g`` to ``2g-1`` characters, where there is no shorter one."""
    n = len(part)
    key = np.sort(number[at] * n + at)
    place = at[part[at] == 0]
    base = number[place] * n
    first = np.searchsorted(key, base + np.minimum(place + g, n))
    last = base + np.minimum(place + 2 * g, n)
    for k in (0, 1):
        found = key[np.minimum(first + k, len(key) - 1)]
        ok = np.flatnonzero((first + k < len(key)) & (found < last) & (part[place] == 0))
        i, p = place[ok], found[ok] - base[ok] - place[ok]
        fits = i + 2 * p <= n
        i, p = i[fits], p[fits]
        left, right = number[i + p - g], number[i + 2 * p - g]
        both = (left >= 0) & (left == right)
        part[i[both]] = p[both]


def _collapse(text: str) -> str:
    part = shortest_parts(text)
    places = np.flatnonzero(part)
    length, places = part[places].tolist(), places.tolist()
    out, done, k = [], 0, 0
    while (k := bisect_left(places, done, k)) < len(places):
        i, p = places[k], length[k]
        piece, stop = text[i:i + p], i + 2 * p
        while text.startswith(piece, stop):
            stop += p
        out.append(text[done:i + p])
        done = stop
    return "".join(out) + text[done:]


def collapse(texts: Iterable[str | None]) -> Iterator[str | None]:
    """The texts with every repeated part left once; line ends are kept and never part of one."""
    block: list[str | None] = []
    size = 0
    for t in texts:
        block.append(t)
        size += len(t or "") + 1
        if size >= BLOCK:
            yield from _block(block)
            block, size = [], 0
    yield from _block(block)


def _block(texts: list[str | None]) -> Iterator[str | None]:
    lines = iter(_collapse("\n".join(t or "" for t in texts)).split("\n"))
    for t in texts:
        new = "\n".join(next(lines) for _ in range((t or "").count("\n") + 1))
        yield None if t is None else new

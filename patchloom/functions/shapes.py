"""Texts that differ in their numbers alone are parsed once a worker.

Where statements, methods and calls lie in code doesn't depend on which decimal numbers it has. So
numbers of three digits or more are replaced by stand-ins of the same length, equal ones by equal
ones and different ones by different ones, and what a parser says of that shape is remembered and
has its numbers put back. Shorter numbers, and those that begin with a zero, stay what they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Container, Iterable
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_NUMBER = re.compile(r"(?<![0-9])[1-9][0-9]{2,}")
#: Cuts a text so that numbers stand at odd places.
_PARTS = re.compile(f"({_NUMBER.pattern})")
#: Where digits mean more than a number: literals of other bases, characters by number or by name.
_OTHERWISE = re.compile(r"0[bBoO]|\\[NuUx0-7]")
#: Characters of a shape that is remembered at most, and shapes of each kind.
LONGEST, SHAPES = 4096, 2048


def shape(*texts: str | None) -> tuple[tuple[str | None, ...], dict[str, str]]:
    """The texts with stand-ins, and the number that each stands for; themselves where there is nothing to replace, or too much."""
    for x in texts:
        if x and ("0" in x or "\\" in x) and _OTHERWISE.search(x):
            return texts, {}
    found: dict[str, str] = {}
    used: dict[int, int] = {}

    made = []
    for x in texts:
        cut = _PARTS.split(x) if x else ()
        for i in range(1, len(cut), 2):
            number = cut[i]
            got = found.get(number)
            if got is None:
                n = len(number)
                got = found[number] = str(10 ** (n - 1) + used.get(n, 0))
                used[n] = used.get(n, 0) + 1
            cut[i] = got
        made.append("".join(cut) if cut else x)
    if any(count > 9 * 10 ** (n - 1) for n, count in used.items()):
        return texts, {}
    return tuple(made), {stand_in: number for number, stand_in in found.items()}


def back(text: str, numbers: dict[str, str]) -> str:
    """A part of a shape with its numbers."""
    return _NUMBER.sub(lambda m: numbers[m.group()], text)


def _numbered(one: Any, restore: Callable[[Any, Callable[[str], str]], Any]) -> bool:
    """Whether any text of a result has a number to put back."""
    found = []
    restore(one, lambda x: found.append(_NUMBER.search(x) is not None) or x)
    return any(found)


def remembered(parse: Callable[..., list], restore: Callable[[Any, Callable[[str], str]], Any]) -> Callable[..., list]:
    """parse(language, *texts) by shapes; restore(one, put) is a copy of one of its results, which nobody changes, with put() applied to its texts."""

    @lru_cache(SHAPES)
    def known(language: str, *texts: str | None) -> list[tuple[Any, bool]]:
        return [(one, _numbered(one, restore)) for one in parse(language, *texts)]

    def of(language: str, *texts: str | None) -> list:
        if sum(len(x) for x in texts if x) > LONGEST:
            return parse(language, *texts)
        made, numbers = shape(*texts)

        def put(text: str) -> str:
            return back(text, numbers)

        return [restore(one, put) if numbers and numbered else one for one, numbered in known(language, *made)]

    return of


def parts(text: str) -> list[str] | None:
    """A text cut at its numbers, which stand at odd places; None if it has none."""
    found = _PARTS.split(text)
    return found if len(found) > 1 else None


class Rows:
    """Results of many rows (language, *texts): each distinct shape's result once, and where each row's is.

    known(language, *texts) is remembered by its caller and gives a result whose texts nobody changes;
    alone(language, *texts) parses what is too long to be remembered, or in one of the languages whole.
    What they raise of errors makes None.
    """

    def __init__(self, rows: Iterable[tuple], known: Callable[..., Any], alone: Callable[..., Any], whole: Container[str] = (), errors: tuple[type[Exception], ...] = ()):
        self.results: list[Any] = []
        self.numbers: list[dict[str, str]] = []
        at: list[int] = []
        places: dict[tuple, int] = {}

        def result(of: Callable[..., Any], row: tuple) -> int:
            try:
                self.results.append(of(*row))
            except errors:
                self.results.append(None)
            return len(self.results) - 1

        for language, *texts in rows:
            if language in whole or sum(len(x) for x in texts if x) > LONGEST:
                at.append(result(alone, (language, *texts)))
                self.numbers.append({})
                continue
            made, numbers = shape(*texts)
            place = places.get(key := (language, *made))
            if place is None:
                place = places[key] = result(known, key)
            at.append(place)
            self.numbers.append(numbers)
        self.at = np.array(at, dtype=np.int64)

    def put_back(self, texts: pa.Array, sizes: list[int], cells: list[list[tuple[int, list[str]]]]) -> pa.Array:
        """texts, all rows' end to end, with each row's numbers; by result: sizes, how many texts it has, and cells, (place, parts()) of those with numbers."""
        starts = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64)[self.at])]) if len(self.at) else [0]
        where, what = [], []
        for place, numbers, start in zip(self.at.tolist(), self.numbers, starts):
            if numbers:
                for i, cut in cells[place]:
                    where.append(start + i)
                    what.append("".join([numbers[x] if k & 1 else x for k, x in enumerate(cut)]))
        if not where:
            return texts
        mask = np.zeros(len(texts), dtype=bool)
        mask[where] = True
        return pc.replace_with_mask(texts, pa.array(mask), pa.array(what, texts.type))

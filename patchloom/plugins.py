"""Languages and pairing strategies from outside the package.

What is registered is looked up when a plan is built and travels to the workers with it, so that
workers need nothing but the functions themselves.
"""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import cloudpickle

from patchloom.functions import code as C
from patchloom.functions.dictionaries import ALIASES

Pieces = Callable[[str], list[str]]
Align = Callable[[list[str], list[str]], "list[tuple[str, str]] | None"]


@dataclass(frozen=True)
class Language:
    """A language: how its code falls into methods, statements and, for the statement table, a tree of nodes.

    like names the known language whose words, signs and dictionaries it shares.
    """

    name: str
    methods: Pieces
    statements: Pieces
    nodes: Callable[[str], list[C.Node]] | None = None
    like: str = "javascript"


LANGUAGES: dict[str, Language] = {}
STRATEGIES: dict[str, Align] = {}
#: Languages with dictionaries, which others may be like.
KNOWN = ("go", "python", "javascript", "php")


def _travels(f: Callable) -> Callable:
    """f, whose module is sent along with it where workers may not have it."""
    module = sys.modules.get(getattr(f, "__module__", None) or "")
    if module is not None and module.__name__ != "__main__" and not module.__name__.startswith(("patchloom", "pyspark")):
        cloudpickle.register_pickle_by_value(module)
    return f


def language(name: str, methods: Pieces, statements: Pieces, nodes: Callable[[str], list[C.Node]] | None = None, aliases: tuple[str, ...] = (), like: str = "javascript") -> Language:
    """Register a language under its name and aliases, in lower case; another registration of the name replaces it.

    A name that the package or another language has, a function that doesn't give a list for the
    empty text, or an unknown `like` is an error.
    """
    if like not in KNOWN:
        raise ValueError(f"{name} can't be like {like!r}; known: {', '.join(KNOWN)}")
    for word in (name, *aliases):
        if not word or word != word.strip().lower():
            raise ValueError(f"names of languages are in lower case: {word!r}")
        if ALIASES.get(word, name) != name or word == name and word in ALIASES and word not in LANGUAGES:
            raise ValueError(f"{word} is a name of {ALIASES[word]} already")
    for f in (methods, statements, *([nodes] if nodes else [])):
        if not isinstance(_travels(f)(""), list):
            raise TypeError(f"{f!r} gives no list of an empty text")
    LANGUAGES[name] = Language(name, methods, statements, nodes, like)
    ALIASES.update({word: name for word in (name, *aliases)})
    return LANGUAGES[name]


def strategy(name: str, align: Align) -> None:
    """Register a pairing of two lists of snippets: pairs of texts, or None where the two don't fit."""
    if name in ("aligned", "strict"):
        raise ValueError(f"{name} is a strategy of the package")
    if not isinstance(_travels(align)([], []), list | None):
        raise TypeError(f"{align!r} gives neither a list nor None")
    STRATEGIES[name] = align


def forget(name: str) -> None:
    """Undo the registration of a language or strategy."""
    LANGUAGES.pop(name, None)
    STRATEGIES.pop(name, None)
    for word in [word for word, of in ALIASES.items() if of == name]:
        del ALIASES[word]


def load(modules: list[str]) -> None:
    """Import modules that register what they bring."""
    for module in modules:
        importlib.import_module(module)


def like(name: str) -> str:
    """The language whose words and dictionaries code of this one is read by."""
    return LANGUAGES[name].like if name in LANGUAGES else name

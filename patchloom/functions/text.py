"""Column functions over code and its metadata. All are built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchloom.functions.dictionaries import ALIASES, SINKS, STDLIB

# Fixed value: the pattern of code tokens.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_language(x: Column) -> Column:
    return F.lower(strip(x))


def resolve_language(x: Column) -> Column:
    """The canonical name of a language or alias, null if it isn't known."""
    table = F.create_map(*[F.lit(v) for pair in sorted(ALIASES.items()) for v in pair])
    return F.try_element_at(table, normalize_language(F.coalesce(x, F.lit(""))))


def has_code(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?U)\S"), F.lit(False))


def unchanged(v: Column, f: Column) -> Column:
    return has_code(v) & has_code(f) & F.coalesce(strip(v) == strip(f), F.lit(False))


def or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def line_span(first: Column, last: Column) -> Column:
    """Lines of a statement."""
    return last - first + 1


def statement_id(prefix: Column, first: Column, last: Column, seq: Column) -> Column:
    """prefix:first-last#seq, the lines and the number of a statement after what its pair and side are called."""
    return F.concat(prefix, F.lit(":"), first, F.lit("-"), last, F.lit("#"), seq)


def has_php_tag(x: Column) -> Column:
    """Whether code has text around it, as a template's has."""
    return F.contains(or_empty(x), F.lit("<?php"))


def preview(x: Column, n: int = 300) -> Column:
    return F.substring(F.coalesce(x, F.lit("")), 1, n)


def to_number(x: Column) -> Column:
    """A number from text; true and false count as 1 and 0, the rest is 0."""
    s = F.lower(F.trim(x.cast("string")))
    return F.coalesce(x.try_cast("double"), F.when(s == "true", 1.0).when(s == "false", 0.0), F.lit(0.0))


def share(x: Column) -> Column:
    """A share from text: 20, 20% and 0.2 all mean a fifth."""
    n = F.regexp_replace(strip(x), "%$", "").cast("double")
    return F.when(n >= 1, n / 100).otherwise(n)


def normalize_ws(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def split_blank_lines(x: Column) -> Column:
    """array<string>: the stripped, non-empty pieces between blank lines."""
    pieces = F.split(F.regexp_replace(x, r"\r\n?", "\n"), r"\n\s*\n+")
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def code_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(TOKEN), F.lit(0))


def call_names(x: Column) -> Column:
    """Dotted names that an opening bracket follows."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\s*\("), F.lit(1))


def matches(name: Column, exact: tuple[str, ...], suffix: tuple[str, ...], within: tuple[str, ...]) -> Column:
    """Whether a call name is one of exact, ends with one of suffix, or contains one of within."""
    tests = [name.isin(*exact)] if exact else []
    tests += [name.endswith(s) for s in suffix] + [name.contains(s) for s in within]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def sink_flags(names: Column, language: str) -> dict[str, Column]:
    """A flag for each kind of sink: whether any of the call names is one."""

    def any_of(rule: tuple) -> Column:
        return F.exists(names, lambda n: matches(n, *rule))

    return {flag: any_of(rule) for flag, rule in SINKS[language].items()}


def call_target_kind(name: Column, language: str) -> Column:
    """none without a call, user_defined if unqualified, else stdlib or third_party by its first part."""
    first = F.element_at(F.split(name, r"->|::|\.", 2), 1)
    known = first.isin(*STDLIB[language]) if STDLIB[language] else F.lit(False)
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "none").when(first == name, "user_defined").when(known, "stdlib").otherwise("third_party")
    )


def only_literals(n_used: Column, n_calls: Column, kind: Column) -> Column:
    """Calls or assignments that use no variable."""
    return (n_used == 0) & ((n_calls > 0) | (kind == "assign")) & ~kind.isin("pass", "break", "continue", "fallthrough", "goto", "label", "import", "global", "nonlocal")


def output_text(raw: Column, kind: Column, language: Column) -> Column:
    """Output that is no call: PHP's echo, JavaScript's .innerHTML."""
    return (kind == "echo") | language.isin("javascript", "typescript") & raw.contains(".innerHTML")


def is_compound(n_children: Column, kind: Column) -> Column:
    return (n_children > 0) | kind.isin("if", "for", "while", "do_while", "switch", "try_catch", "function_def", "with")


def cyclomatic(kind: Column) -> Column:
    return kind.isin("if", "for", "while", "do_while", "try_catch").cast("int")


def row_index_of(statement_id: Column) -> Column:
    """The row index inside a statement id: the last number before a side."""
    found = F.regexp_extract_all(statement_id, F.lit(r":(\d+):(vulnerable|fixed|unchanged):"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).cast("long")


#: A lone method that starts with a modifier; TypeScript reads it inside a class, whose first line counts.
ISOLATED = re.compile(r"\s*(private|public|protected|readonly|static) ")


def wrap_method(code: Column) -> Column:
    """A class around a lone method that starts with a modifier, for languages whose methods need one."""
    return F.when(code.rlike("^" + ISOLATED.pattern), F.concat(F.lit("class _ {\n"), code, F.lit("\n}"))).otherwise(code)


def pair_strict(v: Column, f: Column) -> tuple[Column, Column]:
    """(status, pairs): snippets of equal number side by side; otherwise why not."""
    status = F.when(F.size(v) == 0, "no_vulnerable_code").when(F.size(v) != F.size(f), "mismatch").otherwise("success")
    zipped = F.transform(F.arrays_zip(v.alias("v"), f.alias("f")), lambda z: F.struct(z["v"].alias("vulnerable_code"), z["f"].alias("fixed_code")))
    none = F.array().cast("array<struct<vulnerable_code:string,fixed_code:string>>")
    return status, F.when(status == "success", zipped).otherwise(none)

"""URL filters: longest-prefix rules, then exact membership of a block list by a Bloom filter cascade.

The cascade: level 0 encodes the listed keys; level 1 the unlisted keys of the universe that level
0 lets through; level 2 the listed keys that level 1 lets through; and so on until nothing wrong
passes. Every key of the universe then has the right answer, with no join: a few bits a listed key
travel with the plan. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bind, cut, long_array, power_of_two

#: Bits that one cascade may have; longer lists are joined by key instead.
MAX_BITS = 1 << 24
#: False positive rates of the first and the further levels.
FIRST_RATE, NEXT_RATE = 1 / 128, 1 / 8


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column) -> Column:
    """A host and the domains above it, longest first; none for an empty host."""
    return bind(
        F.split(host, r"\."),
        lambda parts: F.when(host == "", F.array().cast("array<string>")).otherwise(
            F.transform(parts, lambda p, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
        ),
    )


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits, nulls if none does.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    bits: int
    probes: int
    words: tuple[int, ...]


def _places(key: Column, level: int, bits: int, probes: int) -> list[Column]:
    start, step = (F.pmod(F.xxhash64(key, F.lit(2 * level + i)), F.lit(bits)) for i in (0, 1))
    return [F.pmod(start + step * F.lit(j), F.lit(bits)) for j in range(probes)]


def _passes(key: Column, n: int, level: Level) -> Column:
    data = long_array(list(level.words))
    ok = F.lit(True)
    for place in _places(key, n, level.bits, level.probes):
        word = F.get(data, F.floor(place / 64).cast("int"))
        ok = ok & (word.bitwiseAND(power_of_two(F.pmod(place, F.lit(64)))) != 0)
    return ok


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed; keys outside of it may be wrongly told listed."""
        inside = F.lit(True)
        for n in reversed(range(len(self.levels))):
            inside = _passes(key, n, self.levels[n]) & (inside if n == len(self.levels) - 1 else ~inside)
        return inside if self.levels else F.lit(False)


def fit(keys: DataFrame) -> Cascade | None:
    """A cascade from the universe (key, listed), a row for each key; None if it would pass MAX_BITS.

    What comes to the driver are the filters' words, at most MAX_BITS bits.
    """
    keys = cut(keys.where("key is not null"))
    encode, against, levels, bits_left = keys.where("listed"), keys.where("not listed"), [], MAX_BITS
    while n := encode.count():
        rate = NEXT_RATE if levels else FIRST_RATE
        probes = max(1, round(math.log2(1 / rate)))
        bits = 64 * max(1, math.ceil(n * probes * 1.4427 / 64))
        bits_left -= bits
        if bits_left < 0:
            return None
        place = F.explode(F.array(*_places(F.col("key"), len(levels), bits, probes))).alias("place")
        bit = power_of_two(F.pmod("place", F.lit(64)))
        found = encode.select(place).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
        words = [0] * (bits // 64)
        for row in found:
            words[row["word"]] = row["bits"]
        level = Level(bits, probes, tuple(words))
        encode, against = cut(against.where(_passes(F.col("key"), len(levels), level))), encode
        levels.append(level)
    return Cascade(tuple(levels))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every page.

    listed: a DataFrame of keys, domains whose hosts and subdomains are to be blocked unless a rule
    says otherwise. Urls that are null or have no :// have empty host and path, fit no rule and are
    allowed. Repeated rows each keep their row.
    """
    pages = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    seen = pages.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).select("key", F.lit(False).alias("listed"))
    named = listed.select(F.col("key"), F.lit(True).alias("listed"))
    cascade = fit(seen.union(named).groupBy("key").agg(F.bool_or("listed").alias("listed")))
    if cascade is not None:
        pages = pages.withColumn("listed", F.exists(domains(F.col("host")), cascade.contains))
    else:
        hosts = pages.select("host").distinct()
        hit = hosts.select("host", F.explode(domains(F.col("host"))).alias("key")).join(listed.select("key").distinct(), "key").select("host").distinct()
        pages = pages.join(hit.withColumn("listed", F.lit(True)), "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    text, verdict = rule(F.col("host"), F.col("path"), rules)
    return pages.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")


def domains_with(pages: DataFrame, terms: list[str]) -> DataFrame:
    """A block list (key): the domains of the pages whose first label has one of the terms between hyphens."""
    label = rf"^([^.]*-)?({'|'.join(terms)})(-[^.]*)?(\.|$)"
    found = pages.select(host(F.col("url")).alias("host")).distinct().select(F.explode(domains(F.col("host"))).alias("key"))
    return found.where(F.col("key").rlike(label)).distinct()

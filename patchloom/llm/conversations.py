"""Conversation structure repair by shortest paths over small integer costs.

A conversation's rows and the states of the pattern s?(ua)+ (nothing yet, after s, after u, after a)
span a graph whose arcs are edits: keep, rerole, delete, insert. Dial's bucket queue works out each
node's distance to the end, in time linear in rows as costs are at most 6; the cheapest edits whose
letters come first in ASCII are then read off by walking tight arcs, least letter first.

Rows are sorted by ranges over the whole cluster and packed to a byte each, a segment of at most
SEGMENT of them a row. Each segment has its own distances from every state to every state, which
are chained per conversation, so that a conversation of any length is worked on by many tasks; only
its audit, one value of the result, and its rows' way into it pass through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE, crc32_sql, table

#: ASCII white space, as trim() takes it.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of a segment at most.
SEGMENT = 1 << 16
# Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
MOST = REROLE + TRUNCATED
FAR = 1 << 60

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a
#: The state after a user or assistant message, whichever may follow.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: Distances to the end of a conversation without further rows, and the inserts that lead there.
END = (0, 2 * INSERT, INSERT, 0)
LAST = ("", "II", "I", "")

# a row's byte: role initial (s, u, a, any other: 0 to 3) + 4 * fault (none, truncated, duplicate, blank: 0 to 3)


def _kept(state: int, initial: int) -> int | None:
    """The state after keeping a message with this initial, None where it may not follow."""
    if initial == 0:
        return 1 if state == 0 else None
    return initial + 1 if initial < 3 and NEXT[state] == initial + 1 else None


def _arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of the edits of a row, in ASCII order of letters."""
    initial, fault = code & 3, code >> 2
    arcs = [("D", state, DELETE)]
    if fault < 2:
        more = TRUNCATED if fault else 0
        after = _kept(state, initial)
        if after is not None:
            arcs.append(("K", after, more))
        arcs.append(("R", NEXT[state], REROLE + more))
    return arcs


# by row byte and state: edits in ASCII order, an insert among them, and the same arcs backward
FORWARD = [[sorted([*_arcs(code, q), ("I", NEXT[q], INSERT)]) for q in range(4)] for code in range(16)]
BACKWARD = [[[(p, cost) for p in range(4) for _, to, cost in _arcs(code, p) if to == q] for q in range(4)] for code in range(16)]
INSERTED = [[p for p in range(4) if NEXT[p] == q] for q in range(4)]


def distances(codes: bytes, end: tuple[int, ...]) -> list[int]:
    """Distance of node (row i, state q), at 4 i + q, to the end, whose four states lie at the given distances.

    Dial's queue: a ring of buckets, one a distance, emptied in order. No arc is longer than MOST,
    so the ring needs no more buckets than that and the spread of the ends.
    """
    n = len(codes)
    out = [FAR] * (4 * n + 4)
    reached = [d for d in end if d < FAR]
    if not reached:
        return out
    least = min(reached)
    ring: list[list[int]] = [[] for _ in range(max(MOST, max(reached) - least) + 1)]
    size, waiting = len(ring), 0
    for q, d in enumerate(end):
        if d < FAR:
            out[4 * n + q] = d
            ring[(d - least) % size].append(4 * n + q)
            waiting += 1
    d = least
    while waiting:
        bucket = ring[(d - least) % size]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if out[node] != d:
                continue  # a shorter way was found since
            i, q = node >> 2, node & 3
            for p in INSERTED[q]:
                if d + INSERT < out[4 * i + p]:
                    out[4 * i + p] = d + INSERT
                    ring[(d + INSERT - least) % size].append(4 * i + p)
                    waiting += 1
            if i:
                for p, cost in BACKWARD[codes[i - 1]][q]:
                    if d + cost < out[4 * i - 4 + p]:
                        out[4 * i - 4 + p] = d + cost
                        ring[(d + cost - least) % size].append(4 * i - 4 + p)
                        waiting += 1
        d += 1
    return out


def _transfer(codes: bytes) -> list[int]:
    """Distance from state p before the rows to state q after them, at 4 p + q."""
    ways = [distances(codes, tuple(0 if q == to else FAR for q in range(4)))[:4] for to in range(4)]
    return [ways[q][p] for p in range(4) for q in range(4)]


def _walk(codes: bytes, end: tuple[int, ...], starts: int) -> tuple[list[str | None], list[int | None]]:
    """For each of the first `starts` states before the rows: the least letters along tight arcs, and the state after."""
    least = distances(codes, end)
    letters: list[str | None] = []
    after: list[int | None] = []
    for q in range(starts):
        if least[q] >= FAR:
            letters.append(None)
            after.append(None)
            continue
        found, i = [], 0
        while i < len(codes):
            d = least[4 * i + q]
            for letter, to, cost in FORWARD[codes[i]][q]:
                if least[4 * (i + (letter != "I")) + to] + cost == d:
                    found.append(letter)
                    i += letter != "I"
                    q = to
                    break
        letters.append("".join(found))
        after.append(q)
    return letters, after


#: Rows of short segments, which are much alike: what is known of one serves the next.
SHORT = 32


@lru_cache(1 << 14)
def _short_transfer(codes: bytes) -> list[int]:
    return _transfer(codes)


@lru_cache(1 << 14)
def _short_walk(codes: bytes, end: tuple[int, ...], starts: int) -> tuple[list[str | None], list[int | None]]:
    return _walk(codes, end, starts)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a row's CRC-32 of `conv_id:turn` modulo 20 asks for.

    0 drops the row, 1 empties its text, 2 removes full stops, exclamation and question marks, 3 repeats it, 4 makes
    its role user. Null conv_id and turn count as one space in the hash, null role and text become one.
    """
    hashed = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), hashed.alias("hashed")).where("hashed <> 0")
    text = F.when(F.col("hashed") == 1, F.lit("")).when(F.col("hashed") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hashed") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("hashed") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def _faced(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _runs(rows: DataFrame) -> DataFrame:
    """Rows equal in turn, role and text stand side by side: one row for all of them, with their number, faults and whether an earlier turn has the same."""
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = rows.select("conv_id", "turn", "role", "digest", (stripped == "").alias("blank"), (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("truncated"))
    runs = light.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    first = runs.groupBy("conv_id", "role", "digest").agg(F.max(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("least"))
    first = first.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), F.when(~F.col("untimed"), F.col("least")).alias("_turn"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    initial = F.coalesce(F.element_at(F.create_map(*map(F.lit, ("s", 0, "u", 1, "a", 2))), F.substring("role", 1, 1)), F.lit(3))
    return runs.join(first, same).select("conv_id", "turn", "role", "digest", initial.alias("initial"), "blank", "truncated", F.col("turn").eqNullSafe(F.col("_turn")).alias("first"), "n")


SEGMENTS = "part int, k int, codes binary, n_turns long, first_turn long, last_turn long, transfer array<long>"


def _segments(runs: DataFrame) -> DataFrame:
    """conv_id, part and k, which order a conversation's segments, codes of the rows, what is known of their turns, and their distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        codes, conv, turns, part, k = bytearray(), None, [0, None, None], 0, 0

        def close() -> None:
            nonlocal codes, k
            if codes:
                own = bytes(codes)
                out.append((conv, part, k, own, *turns, (_short_transfer if len(own) <= SHORT else _transfer)(own)))
                codes, k = bytearray(), k + 1
                turns[:] = [0, None, None]

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                longs = [(name, pa.int64()) for name in ("n_turns", "first_turn", "last_turn")]
                schema = pa.schema([("conv_id", batch["conv_id"].type), ("part", pa.int32()), ("k", pa.int32()), ("codes", pa.binary()), *longs, ("transfer", pa.list_(pa.int64()))])
            names = ("conv_id", "turn", "initial", "blank", "truncated", "first", "n", "at")
            for own, turn, initial, blank, truncated, first, n, part in zip(*(batch[c].to_pylist() for c in names)):
                if own != conv:
                    close()
                    conv, k = own, 0
                code = initial + (12 if blank else 8 if not first else 4 if truncated else 0)
                again = code if blank or not first else initial + 8
                while n:
                    if turn is not None and turn != turns[2]:
                        turns[:] = [turns[0] + 1, turn if turns[1] is None else turns[1], turn]
                    codes.append(code)
                    more = min(n - 1, SEGMENT - len(codes))
                    codes.extend(bytes([again]) * more)
                    n, code = n - 1 - more, again
                    if len(codes) >= SEGMENT:
                        close()
            if len(out) >= 4096:
                yield flush()
        close()
        if out:
            yield flush()

    # all rows of a task are of one part; a conversation goes on in the parts after it
    sorted_ = runs.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    kind = runs.schema["conv_id"].dataType.simpleString()
    return sorted_.select("conv_id", "turn", "initial", "blank", "truncated", "first", "n", F.spark_partition_id().alias("at")).mapInArrow(run, f"conv_id {kind}, {SEGMENTS}")


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conversation, its rows) of rows that are sorted by conversation, their first value."""
    return groupby(rows, key=lambda r: r[0])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda row: 1, most: int = 4096) -> Iterator[pa.RecordBatch]:
    waiting, total = [], 0
    for row in rows:
        waiting.append(row)
        total += size(row)
        if total >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
            waiting, total = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _chained(segments: DataFrame) -> DataFrame:
    """Segments with the distances that their end states have in the whole conversation; a conversation's first one has its counts.

    What one task holds of a conversation is a byte a row, less than its audit, which is one value.
    """

    def counted(own: list[tuple]) -> list[int]:
        n = [0, 0, 0, 0]
        illegal = turns = 0
        before = last = first = None
        for _, _, _, codes, n_turns, first_turn, last_turn, _ in own:
            initials = bytes(c & 3 for c in codes)
            for fault in range(4):
                n[fault] += sum(codes.count(c + 4 * fault) for c in range(4))
            pairs = len(initials) - 1
            # such pairs don't overlap with another of their kind
            illegal += pairs - sum(initials.count(p) for p in (b"\0\1", b"\1\2", b"\2\1"))
            if before is not None:
                illegal += not _legal(before, initials[0])
            before = initials[-1]
            if n_turns:
                turns += n_turns - (first_turn == last)
                first, last = first_turn if first is None else first, last_turn
        return [last - first + 1 - turns if turns else 0, n[3], n[2], n[1], illegal]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for conv, rows in _grouped(_rows(batches)):
                own = list(rows)
                end, out = list(END), []
                for _, part, k, codes, *_, transfer in reversed(own):
                    out.append((conv, part, k, codes, end))
                    end = [min(transfer[4 * p + q] + end[q] for q in range(4)) for p in range(4)]
                    end = [min(d, FAR) for d in end]
                counts = [*counted(own), end[0]]
                for row in reversed(out):
                    yield (*row, counts)
                    counts = None

        rows = iter(batches)
        one = next(rows, None)
        if one is None:
            return
        batches = _again(one, rows)
        schema = pa.schema([("conv_id", one.schema.field("conv_id").type), ("part", pa.int32()), ("k", pa.int32()), ("codes", pa.binary()), ("end", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
        yield from _batches(found(), schema, lambda row: 1 + len(row[3]) // 256)

    kind = segments.schema["conv_id"].dataType.simpleString()
    together = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k")
    return together.mapInArrow(run, f"conv_id {kind}, part int, k int, codes binary, end array<long>, counts array<long>")


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _walked(chained: DataFrame) -> DataFrame:
    """conv_id, part, k, and for each state before a segment the letters of its edits and the state after; a conversation's first segment has one state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, after = [], []
            for codes, end, first in zip(*(batch[c].to_pylist() for c in ("codes", "end", "first"))):
                a, b = (_short_walk if len(codes) <= SHORT else _walk)(codes, tuple(end), 1 if first else 4)
                letters.append(a)
                after.append(b)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", "part", "k")), pa.array(letters, pa.list_(pa.string())), pa.array(after, pa.list_(pa.int32()))], ["conv_id", "part", "k", "letters", "after"])

    kind = chained.schema["conv_id"].dataType.simpleString()
    dealt = chained.repartition("conv_id", "part", "k").select("conv_id", "part", "k", "codes", "end", F.col("counts").isNotNull().alias("first"))
    return dealt.mapInArrow(run, f"conv_id {kind}, part int, k int, letters array<string>, after array<int>")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, faults) of conversations (conv_id, turn, role, text).

    edits: conv_id, step, edit (D, I, K or R), role and text of the message that results (null for D), in
    order within each partition, a conversation whole in one. faults: conv_id, gaps, blank, duplicate,
    truncated, illegal and cost of each conversation.

    Rows of a conversation stand by turn, null first, those of one turn by role, then by the SHA-256 of
    their text. Null role and text are one space, an empty role has no initial and fits nowhere; a null conv_id is
    a conversation; other columns don't matter.
    A conversation in which nothing can stay has deletions alone. An empty table gives no rows.
    """
    rows = _faced(conversations)
    chained = table(_chained(_segments(_runs(rows))))
    faults = chained.where(F.col("counts").isNotNull()).select("conv_id", *[F.col("counts")[i].alias(name) for i, name in enumerate(FAULTS)])
    walked = _walked(chained)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edits() -> Iterator[tuple]:
            for conv, own in _grouped(_rows(batches)):
                state, audit, step, at = 0, [], 0, 0
                row = next(own)
                while row is not None and not row[1]:
                    audit.append(row[2][state])
                    state = row[3][state]
                    row = next(own, None)
                letters, state = "".join(audit) + LAST[state], 0
                for step, letter in enumerate(letters):
                    role = text = None
                    if letter == "I":
                        state = NEXT[state]
                        role, text = ROLES[state], ""
                    else:
                        if letter == "K":
                            role, text = row[4], row[5]
                            state = 1 if role[0] == "s" else NEXT[state]
                        elif letter == "R":
                            state = NEXT[state]
                            role, text = ROLES[state], row[5]
                        row = next(own, None)
                    yield conv, step, letter, role, text

        rows = iter(batches)
        one = next(rows, None)
        if one is None:
            return
        batches = _again(one, rows)
        schema = pa.schema([("conv_id", one.schema.field("conv_id").type), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        yield from _batches(edits(), schema, lambda row: 256 + len(row[4] or ""), 1 << 20)

    plans = walked.select("conv_id", F.lit(False).alias("message"), "letters", "after", "part", "k", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))])
    messages = rows.select("conv_id", F.lit(True).alias("message"), *[F.lit(None).cast(t).alias(c) for c, t in (("letters", "array<string>"), ("after", "array<int>"), ("part", "int"), ("k", "int"))], "turn", "role", "digest", "text")
    together = plans.union(messages).repartition("conv_id").sortWithinPartitions("conv_id", "message", "part", "k", "turn", "role", "digest")
    edits = together.select("conv_id", "message", "letters", "after", "role", "text").mapInArrow(run, f"conv_id {kind}, step long, edit string, role string, text string")
    return edits, faults


def audits(edits: DataFrame) -> DataFrame:
    """conv_id, audit (the letters in order) and repaired_sha256 (of role:text of what stays, a line each) of repair()'s edits, streamed as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for conv, own in _grouped(_rows(batches)):
                hashed, letters, first = hashlib.sha256(), [], True
                for _, _, letter, role, text in own:
                    letters.append(letter)
                    if letter != "D":
                        hashed.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                        first = False
                yield conv, "".join(letters), hashed.hexdigest()

        rows = iter(batches)
        one = next(rows, None)
        if one is None:
            return
        batches = _again(one, rows)
        schema = pa.schema([("conv_id", one.schema.field("conv_id").type), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        yield from _batches(found(), schema)

    return edits.mapInArrow(run, f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string")


def report(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, faults, cost, audit and repaired_sha256 of each conv_id among ids, the rows being those of conversations; without rows zeros, no audit and the digest of nothing."""
    edits, faults = repair(conversations)
    told, counts = audits(edits).withColumnRenamed("conv_id", "_told"), faults.withColumnRenamed("conv_id", "_counted")
    every = ids.select("conv_id").distinct().join(counts, F.col("conv_id").eqNullSafe(F.col("_counted")), "left").join(told, F.col("conv_id").eqNullSafe(F.col("_told")), "left")
    nothing: Column = F.sha2(F.lit("").cast("binary"), 256)
    return every.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in FAULTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def oracle_sql() -> str:
    """report() of damaged conversations as DuckDB SQL: row by row, the least (cost, letters) of each state, by recursion."""
    inserts = []
    for q in range(4):
        at, said = q, "''"
        for j in range(4):
            inserts.append(f"({q}, {j}, {at}, '{'I' * j}', {said})")
            at = NEXT[at]
            said += f" || chr(10) || '{ROLES[at]}:'"
    hashed = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    stays, space = "coalesce(e.fault, '') IN ('blank', 'duplicate')", r"[\x20\x09-\x0D]"
    return f"""WITH RECURSIVE {CRC_TABLE},
    c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {hashed} % 20 AS h FROM conversations, crc_table),
    d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS again FROM c WHERE h <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS i FROM d),
    e AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{space[1:]}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?]{space}*$') THEN 'truncated' END AS fault,
      left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM n),
    k AS (SELECT conv_id, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
      count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM e GROUP BY conv_id),
    ins(q, j, q2, letters, said) AS (VALUES {", ".join(inserts)}),
    f AS (SELECT conv_id, 0 AS i, q2 AS q, lpad(CAST({INSERT} * j AS VARCHAR), 9, '0') || letters AS key, said FROM k, ins WHERE q = 0
      UNION ALL SELECT conv_id, i, q2, min(key), arg_min(said, key) FROM (
        SELECT o.conv_id, o.i, ins.q2, lpad(CAST(o.cost + {INSERT} * j AS VARCHAR), 9, '0') || o.audit || o.letter || ins.letters AS key, o.said || ins.said AS said FROM (
          SELECT f.conv_id, e.i, x.q2, x.letter, CAST(left(f.key, 9) AS INT) + x.cost AS cost, substr(f.key, 10) AS audit,
            f.said || CASE x.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || e.role || ':' || e.text ELSE chr(10) || CASE x.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || e.text END AS said
          FROM f JOIN e ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = f.i + 1 CROSS JOIN LATERAL (SELECT unnest([
            {{'letter': 'D', 'cost': {DELETE}, 'q2': f.q}},
            {{'letter': 'R', 'cost': {REROLE} + CASE WHEN e.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END, 'q2': CASE WHEN {stays} THEN NULL WHEN f.q = 2 THEN 3 ELSE 2 END}},
            {{'letter': 'K', 'cost': CASE WHEN e.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END,
              'q2': CASE WHEN {stays} THEN NULL WHEN e.initial = 's' AND f.q = 0 THEN 1 WHEN e.initial = 'u' AND f.q <> 2 THEN 2 WHEN e.initial = 'a' AND f.q = 2 THEN 3 END}}], recursive := true)) x
          WHERE x.q2 IS NOT NULL) o JOIN ins ON o.q2 = ins.q) GROUP BY conv_id, i, q2),
    z AS (SELECT f.conv_id, min(f.key) AS key, arg_min(f.said, f.key) AS said FROM f JOIN k ON f.conv_id IS NOT DISTINCT FROM k.conv_id AND f.i = k.rows WHERE q IN (0, 3) GROUP BY f.conv_id)
    SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(left(key, 9), '0') AS BIGINT) AS cost,
      coalesce(substr(key, 10), '') AS audit, sha256(coalesce(substr(said, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN k ON a.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id"""

"""Conversation repair, Merkle manifest and files of token ids against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("patchloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from patchloom.llm import conversations, merkle, packed_ids  # noqa: E402
from patchloom.llm.queries import vocabulary_path  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# conversations

ROWS = "conv_id long, turn long, role string, text string, _conv string, part int, letters string"


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if v is None else v for v in (role, text))
        match zlib.crc32(key.encode()) % 20:
            case 0:
                continue
            case 1:
                text = ""
            case 2:
                text = re.sub("[.!?]", "", text)
            case 3:
                out.append((conv, turn, role, text))
            case 4:
                role = "user"
        out.append((conv, turn, role, text))
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation, by trying every way row by row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        if not WORD.search(text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif WORD.findall(text)[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def prefix(initials):
        return re.fullmatch("s?(ua)*u?", initials) is not None

    # best[initials so far, reduced to what matters] = (cost, audit, messages)
    def state(messages):
        initials = "".join(m[0][:1] or "?" for m in messages)
        return initials[-1:] if prefix(initials) else None

    def settle(options):
        best = {}
        for cost, audit, messages in options:
            q = state(messages)
            if q is not None and (q not in best or (cost, audit) < best[q][:2]):
                best[q] = (cost, audit, messages)
        return list(best.values())

    def inserts(options):
        for _ in range(3):
            options = settle(options + [(c + 3, a + "I", [*m, (role, "")]) for c, a, m in options for role in ("user", "assistant")])
        return options

    options = inserts([(0, "", [])])
    for (_, _, role, text), fault in zip(rows, faults):
        more = [(c + 4, a + "D", m) for c, a, m in options]
        if fault not in ("blank", "duplicate"):
            extra = 3 if fault else 0
            more += [(c + extra, a + "K", [*m, (role, text)]) for c, a, m in options]
            more += [(c + 3 + extra, a + "R", [*m, (new, text)]) for c, a, m in options for new in ("user", "assistant")]
        options = inserts(settle(more))
    done = [o for o in options if re.fullmatch("(s?(ua)+)?", "".join(m[0][:1] or "?" for m in o[2]))]
    cost, audit, messages = min(done, key=lambda o: o[:2])
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in messages))


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    return {conv: repaired(own) if own else (0, 0, 0, 0, 0, 0, "", sha("")) for conv, own in by.items()}


def reported(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], ROWS).repartition(3)
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = conversations.report(conversations.damage(df), df).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in found}


def talk(r, conv, n):
    roles = ["user", "assistant", "system", "tool", None, "", "unicorn", "Stage"]
    out = []
    for turn in range(n):
        role = r.choice(roles) if r.random() < 0.4 else roles[turn % 2]
        text = r.choice([None, "", " \t\n", "Yes", "No.", "Well?", "a. ", "b!\n", "ü…", "x" * 50 + "."])
        out.append((conv, None if r.random() < 0.1 else turn // r.choice([1, 1, 2]) + r.choice([0, 0, 3]), role, text))
    return out


def test_repair_against_trying_every_way(spark):
    r = random.Random(11)
    rows = [row for conv in range(120) for row in talk(r, conv, r.randint(1, 9))]
    rows += [(None, t, role, text) for _, t, role, text in talk(r, 0, 7)] + rows[5:9] + [(999, 3, "user", "x.")]
    assert reported(spark, rows) == expected(rows)


def test_repair_of_long_conversations_in_many_segments(spark, monkeypatch):
    r = random.Random(12)
    rows = [(7, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["a.", "b"]) + r.choice(["", ".", f"{t}."])) for t in range(400)]
    rows += [(8, None, "user", f"{i % 30}.") for i in range(300)] + [(9, 1, "user", "same.")] * 500 + [(10, t, "assistant" if t % 2 else "user", f"very long {t} " * 20_000) for t in range(3)]
    assert reported(spark, rows) == expected(rows)
    # a conversation cut anywhere comes to the same
    codes, end = bytes(r.choice([0, 1, 2, 3, 5, 6, 9, 13]) for _ in range(300)), conversations.END
    whole = conversations.distances(codes, end)
    for cut in (1, 17, 150, 299):
        rest = tuple(conversations.distances(codes[cut:], end)[:4])
        assert conversations.distances(codes[:cut], rest)[:4] == whole[:4]
        transfer = conversations._transfer(codes[:cut])
        assert [min(transfer[4 * p + q] + rest[q] for q in range(4)) for p in range(4)] == whole[:4]
        (head, *_), (state, *_) = conversations._walk(codes[:cut], rest, 1)
        tails, _ = conversations._walk(codes[cut:], end, 4)
        assert head + tails[state] == conversations._walk(codes, end, 1)[0][0]


def test_segments_of_a_few_rows_give_the_same(spark, monkeypatch):
    r = random.Random(13)
    rows = [row for conv in range(6) for row in talk(r, conv, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    runs = conversations._runs(conversations._faced(conversations.damage(df)))
    segments = conversations._segments(runs).collect()
    assert sum(len(s["codes"]) for s in segments) == len(damaged(rows))
    # ranges over many partitions cut most conversations
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert conversations._segments(runs).groupBy("conv_id").count().where("count > 2").count() > 3
        assert reported(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_nothing_and_edits_of_messages(spark):
    nothing = spark.createDataFrame([], ROWS)
    assert conversations.report(conversations.damage(nothing), nothing).collect() == []
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hm."), (1, 2, "user", "Hm."), (1, 3, "assistant", "End")], "conv_id long, turn long, role string, text string")
    edits, faults = conversations.repair(df)
    assert [tuple(r)[2:] for r in edits.orderBy("step").collect()] == [("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Hm."), ("D", None, None), ("K", "assistant", "End")]
    assert faults.first().asDict() == {"conv_id": 1, "gaps": 0, "blank": 0, "duplicate": 1, "truncated": 1, "illegal": 1, "cost": 10}


def test_repair_sql_against_trying_every_way():
    import duckdb
    import pandas as pd

    r = random.Random(21)
    rows = [row for conv in range(150) for row in talk(r, conv, r.randint(1, 8))] + [(None, t, role, text) for _, t, role, text in talk(r, 0, 5)]
    con = duckdb.connect()
    con.register("frame", pd.DataFrame({"conv_id": pd.array([x[0] for x in rows], "Int64"), "turn": pd.array([x[1] for x in rows], "Int64"), "role": [x[2] for x in rows], "text": [x[3] for x in rows]}))
    con.sql("CREATE VIEW conversations AS SELECT * FROM frame")
    assert {row[0]: tuple(row[1:]) for row in con.sql(conversations.oracle_sql()).fetchall()} == expected(rows)


def test_manifest_sql_against_plain_trees():
    import duckdb
    import pandas as pd

    r = random.Random(23)
    rows = [(None if i == 9 else i, r.choice([None, "", "a\nb", f"text {i}\n", "ü…漢"]), r.choice(["en", None]), r.choice(["a", "b", None, "ü", ""]) if i % 3 else "hot", i) for i in range(300)]
    con = duckdb.connect()
    con.register("frame", pd.DataFrame({"doc_id": pd.array([x[0] for x in rows], "Int64"), "text": [x[1] for x in rows], "lang": [x[2] for x in rows], "source": [x[3] for x in rows], "n_chars": [x[4] for x in rows]}))
    con.sql("CREATE VIEW documents AS SELECT * FROM frame")
    assert sorted(con.sql(merkle.oracle_sql()).fetchall(), key=repr) == manifested(rows)


# Merkle trees

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, path string, _key long, tampered int"
LONG = "word \n" * 20_000


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    """(root, siblings of each leaf by level)"""
    level, at, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // 3 * 3
            proofs[k].append((level[first:i], level[i + 1 : first + 3]))
        at = [i // 3 for i in at]
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], proofs


def manifested(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append((leaf(*row[:5]), row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[name] = tree([own for own, _ in by[name]])
    root, above = tree([trees[name][0] for name in names])
    out = []
    for name, tops in zip(names, above):
        subroot, proofs = trees[name]
        for (own, row), proof in zip(by[name], proofs):
            steps = proof + tops
            doc_id, text = row[0], row[1]
            even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            folded = leaf(doc_id, text.replace("\n", "") if even and text is not None else text, *row[2:5])
            for left, right in steps:
                folded = sha("".join([*left, folded, *right]))
            out.append((doc_id, own, subroot, root, sha("".join(itertools.chain(*[a + b for a, b in steps]))), folded, folded == root))
    return sorted(out, key=repr)


def checked(df):
    found = merkle.verify(merkle.manifest(df, {"tampered": merkle.without_newlines(df)}), "tampered")
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_against_plain_trees(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, r.choice([None, "", "a\nb", f"text {i}\n", "ü…漢"]), r.choice(["en", None]), f"s{i % 3}" if i % 5 else "s0", i) for i in range(200)]
    rows += [(None, "x\n", None, None, None), (None, None, None, None, None), (3, "dup\n", "en", "s0", 1), (3, "dup\n", "en", "s0", 1), (2**62, LONG, "en", "Z", 5), (7, "a\n", "en", "", 1), (8, "b", "en", "ü", 1), (9, "c\n", "en", "😀", 1)]
    df = spark.createDataFrame([(*row, "l", "r", "p", 1, 2) for row in rows], DOCS).repartition(4)
    assert checked(df) == manifested(rows)
    monkeypatch.setattr(merkle, "PART", 20)
    assert checked(df) == manifested(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, f"t{i}\n", "en", "a", 1) for i in range(n)]
    found = checked(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert found == manifested(rows)
    apart = [(i, f"t{i}", "en", f"src{i}", 1) for i in range(n)]
    assert checked(spark.createDataFrame(apart, "doc_id long, text string, lang string, source string, n_chars long")) == manifested(apart)


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert checked(df) == [] and merkle.manifest(df).columns == ["doc_id", "source", "leaf", "subroot", "root", "path"]


def test_manifest_detects_a_changed_digest(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 2}", 1) for i in range(20)]
    found = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    wrong = found.withColumn("claimed", F.when(F.col("doc_id") == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("leaf")))
    assert [r["doc_id"] for r in merkle.verify(wrong, "claimed").where("not verified").collect()] == [7]


# token ids


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_pack_round_trip(n):
    r = np.random.default_rng(n)
    ranks = (r.integers(0, 2**32, n, np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    control, data = packed_ids.pack(ranks)
    assert len(control) == -(-n // 4) and len(data) == sum(1 + (x > 0xFF) + (x > 0xFFFF) + (x > 0xFFFFFF) for x in ranks.tolist())
    assert packed_ids.unpack(control, data, n).tolist() == ranks.tolist()


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


PIECES = ["Hello", "it's", "naïve", "é", " ", "\n", "\x1c", "\x1f", "\x85", " ", " ", "　", "​", "漢字", "😀", "ΑΣ", "ς", "İ", "ǅ", "<|endoftext|>", "<|startoftext|>", "<|", "́", "123", "½", "...", "\x00", "﻿", "ﬁ", "'S", "a" * 300, "word,", "Größe.***", "x_y", "a1b", "say\"", "ÿ~", "Ÿ", "it'S.", "end<|", "ß!<"]


def test_files_of_ids_against_the_library(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, "".join(r.choice(PIECES) + r.choice(["", " "]) for _ in range(r.randint(0, 40)))) for i in range(600)]
    rows += [(None, None), (None, "null id"), (400, None), (401, ""), (402, " \t"), (403, LONG), (5, rows[5][1]), (5, "another five"), (-3, "first"), (2**62, "last")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*row, 7, "x") for row in rows], "doc_id long, text string, ids long, start string").repartition(5)
    folder = packed_ids.save(df, vocabulary_path(), 2, file_ids=900)
    assert spark.read.parquet(f"{folder}/files").groupBy("part").count().where("count > 3").count() > 0
    found = packed_ids.read(spark, folder).collect()
    ids = [[*own, 2] for own in plain_ids([t or "" for _, t in rows])]
    key = lambda d, own: (d is not None, d or 0, own)
    want = sorted(((d, own) for (d, _), own in zip(rows, ids)), key=lambda x: key(*x))
    got = [(x["doc_id"], np.frombuffer(x["ids"], "<u4").tolist(), x["start"], x["n_tokens"]) for x in sorted(found, key=lambda x: x["start"])]
    assert sorted(((d, own) for d, own, *_ in got), key=lambda x: key(*x)) == want
    assert [d for d, *_ in got] == [d for d, _ in want]
    at = 0
    for _, own, start, n in got:
        assert start == at and n == len(own)
        at += n
    crc = {(x["doc_id"], x["start"]): x["ids_crc32"] for x in packed_ids.digests(packed_ids.read(spark, folder)).collect()}
    assert all(crc[d, start] == zlib.crc32(np.array(own, "<u4").tobytes()) for d, own, start, _ in got)


def test_frequent_ids_take_a_byte(spark, tmp_path):
    df = spark.createDataFrame([(i, "the cat sat on the mat " * 50) for i in range(20)], "doc_id long, text string")
    folder = packed_ids.save(df, vocabulary_path(), 2, str(tmp_path / "set"))
    n, size = 20 * 301, sum(f.stat().st_size for f in (tmp_path / "set").glob("ids-*.bin"))
    assert n * 1.25 <= size < n * 1.5
    assert packed_ids.read(spark, folder).agg(F.sum("n_tokens")).first()[0] == n


def test_files_and_blocks_of_a_few_ids(monkeypatch):
    monkeypatch.setattr(packed_ids, "BLOCK", 64)
    r = np.random.default_rng(4)
    docs = [None, *range(999)]
    ids = [r.zipf(1.3, n).clip(0, 49_000).astype("<u4") for n in r.integers(1, 90, 1000)]
    data = b"".join(packed_ids._file(docs, ids))
    import io

    raw = io.BytesIO(data)
    read = [(None if null else int(d), x.tolist()) for own, nulls, lengths, found in packed_ids.blocks(raw) for d, null, x in zip(own, nulls, np.split(found, np.cumsum(lengths)[:-1]))]
    assert read == list(zip(docs, (x.tolist() for x in ids)))
    ranks = np.frombuffer(data, "<u4", int.from_bytes(data[4:8], "little"), 8).tolist()
    counts = np.bincount(np.concatenate(ids))
    assert ranks == sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], i))


def test_files_of_nothing(spark):
    folder = packed_ids.save(spark.createDataFrame([], "doc_id long, text string"), vocabulary_path(), 2)
    assert packed_ids.read(spark, folder).collect() == []


def test_unnamed_and_broken_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    folder = packed_ids.save(df, vocabulary_path(), 2, str(tmp_path / "set"))
    (tmp_path / "set" / "ids-left-by-a-lost-task.bin").write_bytes(b"IDS1")
    assert packed_ids.read(spark, folder).count() == 50
    own = next(f for f in (tmp_path / "set").glob("ids-*.bin") if f.stat().st_size > 10)
    own.write_bytes(b"IDS1\0\0\0\0")
    with pytest.raises(Exception, match="lacks"):
        packed_ids.read(spark, folder).collect()


def test_old_pieces_are_forgotten():
    pieces = packed_ids.Pieces(vocabulary_path())
    text = " ".join(f"w{i}x" for i in range(2000))
    first = pieces.encode([text, "again"])
    pieces.size = packed_ids.CACHE_BYTES + 1
    assert pieces.encode([text]) == first[:1] and "again" not in pieces.known and "again" in pieces.older
    assert pieces.encode(["again"]) == first[1:] and "again" in pieces.known

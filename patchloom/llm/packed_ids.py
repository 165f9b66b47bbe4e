"""Token ids in binary files: ranks by frequency, byte-aligned variable length, control bytes apart from data bytes.

Frequent ids get small ranks. A rank takes one to four bytes, least significant first; how many is
told by two bits, four to a control byte. A block holds the control bytes of all its ids, then their
data bytes, so numpy decodes it by looking up each control byte's four lengths and adding up where
every rank begins.

A dataset is a folder in the shared file system:

    ids-*.bin     "IDS1", number of ranks (32 bits) and the ids by rank (32 bits each), then blocks:
                  n documents, n ids, n data bytes (32 bits each), doc_id (64 bits) of each document,
                  one byte each that tells whether it is null, its number of ids (64 bits), control
                  bytes, data bytes; all little-endian
    files         Parquet: name, place, documents and ids of each file, the dataset's table of contents

Spark deals documents into ranges of doc_id; a task tokenizes its range in order and closes a file
at FILE_IDS ids, ranked by their frequency in it, so a file is read without any other and what a
task holds doesn't grow. A task that is run again writes other files; only those named in the table
of contents count.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import shared_dir

MAGIC = b"IDS1"
#: A block takes whole documents until it has so many ids.
BLOCK = 1 << 16
#: A file takes whole documents until it has so many ids.
FILE_IDS = 1 << 24
#: A worker remembers the ids of pieces of text up to so many bytes, in each of two generations.
CACHE_BYTES = 48 << 20
#: What a remembered piece takes besides its characters and ids.
ENTRY_BYTES = 200
#: Texts are worked on in groups of about so many characters.
GROUP = 1 << 21
#: A piece is what stands between white space, which the vocabulary's own pattern drops as well; four control characters divide pieces for Python alone.
PIECES = re.compile(r"[^\x20\x09-\x0D]+").findall
ODD = re.compile(r"[\x1C-\x1F]").search
#: Letters that are composed already, each of which lower-cases to one, and after them ASCII marks (no quote, which may begin a contraction, and none that opens a special token).
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)").fullmatch
#: Runs of marks that a worker remembers.
MARKS = 1000

# how many bytes each of a control byte's four ranks takes
LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of uint32 ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < sizes[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of pack()."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    if n and ends[-1] != len(data):
        raise ValueError(f"{len(data)} data bytes where control bytes ask for {ends[-1]}")
    begins, padded = ends - sizes, np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = padded[begins].astype(np.uint32)
    for i in range(1, 4):
        more = sizes > i
        if not more.any():
            break
        ranks[more] |= padded[begins[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return ranks


class Pieces:
    """Ids of texts by a tokenizer file of word-end BPE, each distinct piece between white space worked out once while it is remembered.

    Words of Latin letters with punctuation after them are lower-cased, and go to the library's BPE model
    straight, as its normaliser and pre-tokenizer leave them; all other pieces go through its whole encoder.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task a core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = [letter for _, letter in sorted(byte_letters().items())]
        self.marks: dict[str, bytes] = {"": b""}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def word(self, word: str) -> bytes:
        """Ids of what the pre-tokenizer leaves whole."""
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def learn(self, new: set[str]) -> dict[str, bytes]:
        found, rest = {}, []
        marks, word, known, older = self.marks, self.word, self.known, self.older
        # lower-case words without marks, which are pieces themselves
        words: dict[str, bytes] = {}
        for x in new:
            plain = PLAIN(x)
            if plain is None:
                rest.append(x)
                continue
            own, mark = plain.groups()
            if mark not in marks:
                if len(marks) > MARKS:
                    marks.clear()
                marks[mark] = word(mark) if mark else b""
            own = own.lower()
            ids = words.get(own) or known.get(own) or older.get(own)
            if ids is None:
                ids = words[own] = word(own)
            found[x] = ids + marks[mark] if mark else ids
        if rest:
            encoded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            found.update((x, array("I", e.ids).tobytes()) for x, e in zip(rest, encoded))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """32-bit ids of each text."""
        own = [PIECES(t) if ODD(t) else t.split() for t in texts]
        if self.size > CACHE_BYTES:
            self.known, self.older, self.size = {}, self.known, 0
        known, older = self.known, self.older
        new = set()
        for pieces in own:
            new.update(filterfalse(known.__contains__, pieces))
        found = {x: older[x] for x in new if x in older} if older else {}
        new.difference_update(found)
        found.update(self.learn(new))
        known.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)
        return [b"".join(map(known.__getitem__, pieces)) for pieces in own]


_pieces: dict[str, Pieces] = {}


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with their texts, null being empty; of a batch only one slice is Python strings."""
    for batch in batches:
        column, at = batch["text"], 0
        while at < len(column):
            texts, size, first = [], 0, at
            while at < len(column) and (not texts or size < GROUP):
                texts.append(column[at].as_py() or "")
                size += len(texts[-1])
                at += 1
            yield batch.slice(first, at - first), texts


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _file(docs: list[int | None], ids: list[np.ndarray]) -> Iterator[bytes]:
    """The bytes of a file of these documents, piece by piece."""
    starts = list(range(0, len(docs), 256))
    seen = np.zeros(0, np.int64)
    for i in starts:
        own = np.bincount(np.concatenate(ids[i : i + 256]), minlength=len(seen))
        own[: len(seen)] += seen
        seen = own
    # by falling number, ties by id
    order = np.lexsort((np.arange(len(seen)), -seen))[: np.count_nonzero(seen)].astype("<u4")
    rank_of = np.zeros(len(seen), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    yield MAGIC + struct.pack("<I", len(order)) + order.tobytes()
    first = 0
    while first < len(docs):
        last, total = first, 0
        while last < len(docs) and total < BLOCK:
            total += len(ids[last])
            last += 1
        control, data = pack(rank_of[np.concatenate(ids[first:last])])
        keys = np.array([d or 0 for d in docs[first:last]], "<i8").tobytes() + bytes(d is None for d in docs[first:last])
        lengths = np.array([len(x) for x in ids[first:last]], "<i8").tobytes()
        yield struct.pack("<III", last - first, total, len(data)) + keys + lengths + control + data
        first = last


CONTENTS = "file string, part int, k int, n_docs long, n_ids long"


def save(docs: DataFrame, path: str, end_id: int, folder: str | None = None, file_ids: int = FILE_IDS) -> str:
    """Write the ids of docs (doc_id, text) by the tokenizer file at path, end_id after each, as a dataset; returns its folder.

    Documents ascend by doc_id, null first, ties by a hash of their texts. Null and empty texts have
    end_id alone. Repeated rows and null ids each keep their entry. Other columns are left out. An
    empty table gives a dataset without files of ids.
    """
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}"
    files, root = _open(folder)
    files.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _pieces:
            _pieces[path] = Pieces(path)
        pieces, end = _pieces[path], struct.pack("<I", end_id)
        files, root = _open(folder)
        own: list[int | None] = []
        ids: list[np.ndarray] = []
        part, k, total = 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal k, total
            name = f"ids-{uuid.uuid4().hex}.bin"
            with files.open_output_stream(f"{root}/{name}") as out:
                for piece in _file(own, ids):
                    out.write(piece)
            row = {"file": [name], "part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "n_docs": [len(own)], "n_ids": [total]}
            own.clear()
            ids.clear()
            k, total = k + 1, 0
            return pa.RecordBatch.from_pydict(row)

        for batch, texts in _texts(batches):
            part = batch["part"][0].as_py()
            for doc_id, found in zip(batch["doc_id"].to_pylist(), pieces.encode(texts)):
                own.append(doc_id)
                ids.append(np.frombuffer(found + end, "<u4"))
                total += len(ids[-1])
                if total >= file_ids:
                    yield close()
        if own:
            yield close()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, CONTENTS).write.parquet(f"{folder}/files")
    return folder


def blocks(raw) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, whether null, numbers of ids, ids of all of them) of each block of an open file."""
    if raw.read(4) != MAGIC:
        raise ValueError("not a file of ids")
    order = np.frombuffer(raw.read(4 * int.from_bytes(raw.read(4), "little")), "<u4")
    while head := raw.read(12):
        n_docs, n_ids, n_data = struct.unpack("<III", head)
        docs, null = np.frombuffer(raw.read(8 * n_docs), "<i8"), np.frombuffer(raw.read(n_docs), np.uint8)
        lengths = np.frombuffer(raw.read(8 * n_docs), "<i8")
        yield docs, null.astype(bool), lengths, order[unpack(raw.read(-(-n_ids // 4)), raw.read(n_data), n_ids)]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, 32 bits each) of every document of a dataset, from its files.

    start is the number of ids of all documents before it. Files are read where Spark deals them,
    a block at a time. A dataset without documents has no rows.
    """
    contents = spark.read.schema(CONTENTS).parquet(f"{folder}/files")
    # a row a file
    before = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    contents = contents.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), "n_docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for batch in batches:
            for name, base, n_docs in zip(*(batch[c].to_pylist() for c in ("file", "base", "n_docs"))):
                with files.open_input_stream(f"{root}/{name}") as f:
                    for docs, null, lengths, ids in blocks(f):
                        n_docs -= len(docs)
                        ends = np.cumsum(lengths)
                        binary = [x.tobytes() for x in np.split(ids, ends[:-1])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs, pa.int64(), mask=null), pa.array(base + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(binary, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        base += int(ends[-1])
                if n_docs:
                    raise ValueError(f"{name} lacks {n_docs} documents")

    return contents.repartition(max(1, contents.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digests(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the CRC-32 of a document's ids as 32-bit integers."""
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


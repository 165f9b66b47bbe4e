"""BPE encoding and decoding by prefix-sharing trie traversal.

For a BPE vocabulary the encoding of every prefix of a word is told by its last token: the one
token t that ends the prefix and may stand after the encoding of what precedes it, which holds if
merging (last token before t, t) anew leaves these two apart. So the distinct words of a batch go
into a trie, a depth-first walk hands each node the last tokens of the prefixes above it, and a
prefix that many words share is worked out once. A word's ids are read back along its last tokens.

Spark deals out the documents; each task handles its own batches, with no shuffle. Words are kept
in a bounded cache of the worker, half of which ends with the task.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks of text and pairs of tokens that a worker remembers, in each of two generations: full, the younger becomes the older, and what is used again comes back.
CACHE = 400_000
#: Characters that Unicode calls white space, as the vocabulary's own pattern sees them.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# Fixed value: the word pattern of this kind of vocabulary.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = regex.compile(WORD).findall
SPACES = regex.compile(SPACE)
END = "</w>"
#: Marks a special token among chunks; white space, so that no chunk of a text begins with it.
SPECIAL = "\n"


def byte_letters() -> dict[int, str]:
    """The printable character for each byte: itself, or the next unused one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ids and merge ranks of a word-end BPE file, with its special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.ids: dict[str, int] = data["model"]["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(data["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.names = {t: str(i) for t, i in self.ids.items()}
        #: the merge that makes a token: its rank and its two parts
        self.made = {a + b: (i, a, b) for (a, b), i in self.ranks.items()}
        #: every ending of every token, and whether it is one itself: a suffix scan stops where none goes on
        self.endings = dict.fromkeys((t[i:] for t in self.ids for i in range(1, len(t))), False) | dict.fromkeys(self.ids, True)
        self.letters = byte_letters()
        self.apart: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, tuple[str, str]] = {}
        self.forget()
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def forget(self) -> None:
        """Drop the older generation, so that an idle worker holds the vocabulary and the words of late alone."""
        self.older: dict[str, tuple[str, str]] = {}

    def stands(self, left: str, token: str) -> bool:
        """Whether token may follow left, so that BPE of the two texts joined gives the two again."""
        key = (left, token)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > CACHE:
                self.apart.clear()
            found = self.apart[key] = self._stands(left, token)
        return found

    def _stands(self, left: str, right: str) -> bool:
        """Undo merges from the latest to the first, looking for one across the boundary that came before them.

        A pair across the boundary merges at its rank if both its parts are whole by then and not
        yet merged further; of equal ranks the leftmost goes first.
        """
        made, ranks = self.made, self.ranks
        whole_left = whole_right = 1 << 60  # rank of the merge that ends this part's life
        while True:
            across = ranks.get((left, right))
            if across is not None and across < whole_left and across <= whole_right:
                return False
            of_left, of_right = made.get(left), made.get(right)
            if of_left is None and of_right is None:
                return True
            if of_right is None or (of_left is not None and of_left[0] > of_right[0]):
                whole_left, left = of_left[0], of_left[2]
            else:
                whole_right, right = of_right[0], of_right[1]

    def last_token(self, text: str, last: list[str], end: str) -> str:
        """The last token of text's encoding, given those of its shorter prefixes."""
        endings, found = self.endings.get, []
        token = end
        for letter in reversed(text):
            token = letter + token
            whole = endings(token)
            if whole:
                found.append(token)
            elif whole is None:
                break
        size = len(text) + len(end)
        while found:
            token = found.pop()
            if len(token) == size or self.stands(last[size - len(token)], token):
                return token
        raise ValueError(f"no token ends {text!r}")

    def encode(self, words: list[str]) -> dict[str, list[str]]:
        """The tokens of distinct words, in byte letters.

        Sorted words are their trie depth first: what a word shares with the one before it is on the path already.
        """
        found: dict[str, list[str]] = {}
        last_token, end = self.last_token, len(END)
        # last[i] is the last token of the path's first i letters; a whole word's own is left to a word that goes on from it
        last, before = [""], ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for size in range(len(last), len(word)):
                last.append(last_token(word[:size], last, ""))
            token = last_token(word, last, END)
            tokens, at = [token], len(word) - len(token) + end
            while at:
                token = last[at]
                tokens.append(token)
                at -= len(token)
            tokens.reverse()
            found[word], before = tokens, word
        return found

    def learn(self, chunks: set[str]) -> None:
        """Work out what is not yet known of these pieces between white space."""
        pieces: dict[str, list[str]] = {}
        letters = self.letters.__getitem__
        for chunk in chunks:
            if chunk.isascii() and chunk.isprintable():
                pieces[chunk] = [chunk.lower()] if chunk.isalpha() else WORDS(chunk.lower())
            else:
                text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
                pieces[chunk] = ["".join(map(letters, word.encode())) for word in WORDS(text)]
        found = self.encode(list({w for words in pieces.values() for w in words}))
        known, names = self.chunks, self.names
        for chunk, words in pieces.items():
            tokens = found[words[0]] if len(words) == 1 else [t for w in words for t in found[w]]
            known[chunk] = (" ".join([names[t] for t in tokens]), " ".join(tokens))

    def split(self, text: str) -> list[str]:
        """The chunks of a text between white space; split() alone also cuts at four control characters."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in SPACES.split(text) if x]
        return text.split()

    def encode_texts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by spaces, decoded text) of each text.

        Decoding joins the tokens of the ids by spaces, as a tokenizer file without decoder asks for.
        """
        chunks: list[list[str]] = []
        for text in texts:
            if self.special_pattern is not None and "<|" in text:
                parts = self.special_pattern.split(text)
                chunks.append([x for i, part in enumerate(parts) for x in ([SPECIAL + part] if i % 2 else self.split(part))])
            else:
                chunks.append(self.split(text))
        new = set().union(*chunks)
        if len(self.chunks) + len(new) > CACHE:
            self.chunks, self.older = {}, self.chunks
        known, older = self.chunks, self.older
        new.difference_update(known)
        back = new.intersection(older)
        known.update({x: older[x] for x in back})
        new -= back
        if special := {x for x in new if x.startswith(SPECIAL) and x.removeprefix(SPECIAL) in self.special}:
            known.update({x: (str(self.special[t]), t) for x in special for t in [x.removeprefix(SPECIAL)]})
            new -= special
        self.learn(new)
        out = []
        for own in chunks:
            found = [x for x in map(known.__getitem__, own) if x[0]]
            if found:
                ids, decoded = zip(*found)
                ids = " ".join(ids)
                out.append((ids.count(" ") + 1, ids, " ".join(decoded)))
            else:
                out.append((0, "", ""))
        return out


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """A worker reads a file once."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def decode(ids: list[int], path: str) -> str:
    tokens = vocabulary(path).tokens
    return " ".join(tokens[i] for i in ids)


#: Texts are worked on in groups of about so many characters, so that a batch of very long ones stays small.
GROUP = 1 << 21


def encode(docs: DataFrame, path: str, add: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; add names more: ids, decoded.

    path names the vocabulary file, the same on every machine. Null and empty texts have no tokens
    and the digests of the empty string. Repeated rows each keep their row; other columns are left out.
    """
    kinds = {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | {name: "string" for name in add}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        try:
            for batch in batches:
                column, at = batch["text"], 0
                while at < len(column):
                    # of a batch only one group is Python strings
                    texts, size, first = [], 0, at
                    while at < len(column) and (not texts or size < GROUP):
                        texts.append(column[at].as_py() or "")
                        size += len(texts[-1])
                        at += 1
                    found = vocab.encode_texts(texts)
                    columns = [
                        batch["doc_id"].slice(first, at - first),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([hashlib.sha256(f[1].encode()).hexdigest() for f in found]),
                        pa.array([hashlib.sha256(f[2].encode()).hexdigest() for f in found]),
                        *(pa.array([f[("ids", "decoded").index(name) + 1] for f in found]) for name in add),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, list(kinds))
        finally:
            vocab.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))

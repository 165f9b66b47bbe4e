"""Small tests of the corpus operators: brute force, and odd input in every column."""

import hashlib
import json
import math
import random
import zlib

import brute
import numpy as np
import pytest

pytest.importorskip("patchloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from patchloom.llm import bpe, classifier, fingerprints, languages, licenses, mixing, quality_rules, simhash, substrings, url_filters  # noqa: E402
from patchloom.llm.common import connected_components  # noqa: E402
from patchloom.llm.queries import OP2_SQL, URL_RULES, vocabulary_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, near string, fp string, score double"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(3000)]


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else RNG
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(20_000, 1)
ODD = [
    (None, None, None, None, None, None, None, None), (1, None, "en", "a", 0, "x", "y", 0.5), (2, "", "en", "a", 0, "x", "y", None), (3, " \t\n\x0b\x0c\r", None, None, 6, None, None, None),
    (4, "one", "en", "b", 3, None, None, None), (4, "one", "en", "b", 3, None, None, None), (5, "one two", "en", None, 7, None, None, None), (None, prose(80, 2), "en", "a", None, None, None, None),
    (6, prose(80, 2), "de", "a", None, None, None, None), (7, LONG, "en", "a", None, None, None, None), (8, "Ünïcödé … 漢字 😀 " * 30, "fr", "c", None, None, None, None), (2**62, prose(60, 3), "en", "c", None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# fingerprints


def test_fingerprints_are_the_same_for_equal_texts_and_estimate_likeness(spark):
    a, b = prose(400, 7), prose(400, 8)
    words = a.split()
    close = " ".join(words[:200] + ["changed"] + words[201:])
    df = spark.createDataFrame([(1, a), (2, a), (3, close), (4, b), (5, None), (6, "")], "doc_id long, text string")
    s = {r["doc_id"]: r["sketch"] for r in fingerprints.fingerprint(df).collect()}
    assert s[1] == s[2] and s[5] == s[6] == []
    pair = spark.createDataFrame([(s[1], s[3], s[4])], "a array<long>, b array<long>, c array<long>")
    likeness, none, contained, n = pair.select(
        fingerprints.resemblance(F.col("a"), F.col("b")), fingerprints.resemblance(F.col("a"), F.col("c")), fingerprints.containment(F.col("a"), F.col("b")), fingerprints.distinct_shingles(F.col("a"))
    ).first()
    assert likeness > 0.9 and none == 0 and contained > 0.9 and abs(n - 396) < 100


def test_fingerprint_merge_is_the_fingerprint_of_the_union(spark):
    a, b = (sorted(random.Random(i).sample(range(-(2**60), 2**60), 300))[:128] for i in (1, 2))
    merged = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(fingerprints.merge(F.col("a"), F.col("b"))).first()[0]
    assert merged == sorted({*a, *b})[:128]


def test_edited_pairs_against_brute_force(spark, odd, empty):
    plain = spark.createDataFrame([r for r in ODD if r[0] not in (None, 4)], DOCS)
    found = {r["doc_id"]: r for r in fingerprints.edited_pairs(plain).collect()}
    texts = sorted((r[0], r[1] or "") for r in ODD if r[0] not in (None, 4))

    def hashed(value, seed=42):
        import xxhash

        got = xxhash.xxh64_intdigest(value if isinstance(value, bytes) else (value & (1 << 64) - 1).to_bytes(8, "little"), seed & (1 << 64) - 1)
        return got - (1 << 64) if got >> 63 else got

    def bottom(text):
        """The k least hashes of all shingles of five words, each the hash of its words' hashes in turn."""
        import re

        words = [hashed(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        found = set()
        for at in range(max(1, len(words) - 4) if words else 0):
            h = 42
            for w in words[at : at + 5]:
                h = hashed(w, h)
            found.add(h)
        return sorted(found)[: fingerprints.K]

    def shown(sketch):
        return "".join(f"{h & (1 << 64) - 1:016x}" for h in sketch)

    def alike(a, b):
        union = sorted(set(a) | set(b))[: fingerprints.K]
        return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0

    for i, (doc, text) in enumerate(texts):
        following, m = texts[(i + 1) % len(texts)][1], len(text) // 4
        edited = text[: len(text) - m] + following[:m]
        assert found[doc]["n_chars"] == len(text)
        assert found[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[doc]["fingerprint"] == shown(bottom(text)) and found[doc]["edited_fingerprint"] == shown(bottom(edited))
        assert found[doc]["near_edited"] == pytest.approx(alike(bottom(text), bottom(edited))) and found[doc]["near_next"] == pytest.approx(alike(bottom(text), bottom(following)))
    assert fingerprints.edited_pairs(odd).count() == len(ODD)
    assert fingerprints.edited_pairs(empty).count() == 0


# url filters


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filters.fit(keys)
    assert len(cascade.levels) > 1
    assert keys.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_rules_and_listing(spark):
    urls = [
        None, "", "no scheme", "http://Example.ORG/es/x?q", "https://a.example.org/en/1/2", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/1#f",
        "http://spam.net/a", "http://my-spam.net", "http://spammy.net/", "http://org/", "http://x.com",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filters.judge(pages, URL_RULES, url_filters.domains_with(pages, ["spam"])).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == [None, None, None, "example.org/es/", "example.org/en/1", "org/", "org/", "com/fr/", "com/de/", None, None, None, "org/", None]
    assert [got[i]["verdict"] for i in range(len(urls))] == ["allow"] * 3 + ["block", "block", "allow", "allow", "allow", "block", "block", "block", "allow", "allow", "allow"]
    assert got[3]["host"] == "example.org" and got[3]["path"] == "/es/x" and got[0]["host"] == got[0]["path"] == ""


def test_longer_lists_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.b/"), (2, "http://c.b/"), (3, "http://x.y/")], "page_id long, url string")
    listed = spark.createDataFrame([("b",)], "key string")
    small = rows(url_filters.judge(pages, [], listed), "page_id", "verdict")
    monkeypatch.setattr(url_filters, "MAX_BITS", 0)
    assert rows(url_filters.judge(pages, [], listed), "page_id", "verdict") == small == [(1, "block"), (2, "block"), (3, "allow")]


def test_empty_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(none, URL_RULES, url_filters.domains_with(none, ["spam"])).count() == 0
    assert "regexp" in OP2_SQL


# BPE


def test_bpe_against_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    t = Tokenizer.from_file(path)
    vocab, r = bpe.Vocabulary(path), random.Random(3)
    letters = list("abcABC'sStTZ09 \n\t\x1c\x85 é漢字İΣς<|>_-—😀½²") + ["<|endoftext|>", "'ll", "th", "ing", " "]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        e = t.encode(text, add_special_tokens=False)
        assert vocab.encode_texts([text])[0] == (len(e.ids), " ".join(map(str, e.ids)), t.decode(e.ids, skip_special_tokens=False)), repr(text)
    got = rows(bpe.encode(odd, path), "doc_id", "n_tokens", "ids_sha256")
    want = []
    for doc, text, *_ in ODD:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode(empty, path).count() == 0


def test_bpe_generations_forget_nothing_they_need(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    small, whole = bpe.Vocabulary(vocabulary_path()), bpe.Vocabulary(vocabulary_path())
    texts = [prose(30, i % 4) for i in range(12)]
    monkeypatch.setattr(bpe, "CACHE", 20)
    got = [small.encode_texts([t])[0] for t in texts]
    monkeypatch.setattr(bpe, "CACHE", 10**6)
    assert got == [whole.encode_texts([t])[0] for t in texts]


def test_decode_is_the_inverse_of_ids():
    path = vocabulary_path()
    n, ids, decoded = bpe.vocabulary(path).encode_texts(["Hello, world! 漢字"])[0]
    assert n == len(ids.split()) and bpe.decode([int(i) for i in ids.split()], path) == decoded


# licences


def test_license_digests_ignore_case_punctuation_copyright_and_spelling(spark, empty):
    mit = licenses.TEXTS["MIT"]
    other = mit.replace("MIT License", "MIT LICENCE").replace(".", " . ").replace("MIT LICENCE\n", "MIT LICENCE\nCopyright (c) 2020 Someone\n", 1)
    df = spark.createDataFrame([(1, mit), (2, other), (3, mit + " more"), (4, "x\nReleased under the MIT License.\n"), (5, None), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [got[i]["license"] for i in range(1, 7)] == ["MIT", "MIT", None, None, None, None]
    assert got[4]["notices"] == "MIT" and got[4]["n_notices"] == 1 and got[5]["digest"] == got[6]["digest"]
    assert licenses.scan(empty).count() == 0


# SimHash


def test_whole_license_texts_are_known(spark):
    read = {f.name.split(".txt")[0].replace(".university", ""): f.read_text() for f in sorted(licenses.FOLDER.glob("*.txt"))}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "MPL-2.0"} <= set(read)
    read["MIT"] = licenses.TEXTS["MIT"]
    docs, want = [(0, "MIT License", ""), (1, None, "")], {0: None, 1: None}
    for name, text in read.items():
        title, body = text.strip().split("\n\n", 1)
        for form in (text, body, f"{title}\n\nCopyright (c) 2020 Someone\n\n{body}", text.split("END OF TERMS")[0] + "END OF TERMS AND CONDITIONS" if "END OF TERMS" in text else text, text + "\nmore"):
            want[len(docs)] = None if form.endswith("more") else name
            docs.append((len(docs), form, ""))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan(df).collect()} == want
    own = spark.createDataFrame([("Own-1", "Own License\n\nDo as you like."), ("Own-1", "Own License\n\nDo as you like.")], "license string, text string")
    mine = spark.createDataFrame([(1, "do as you LIKE"), (2, read["MPL-2.0"])], "doc_id long, text string")
    assert rows(licenses.scan(mine, own), "doc_id", "license") == [(1, "Own-1"), (2, None)]


def slow_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def slow_components(values):
    found = list(range(len(values)))

    def find(x):
        while found[x] != x:
            x = found[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 3:
                a, b = find(i), find(j)
                found[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_fingerprint_block_by_block(monkeypatch):
    texts = [None, "", "a", "A b", "x y z w", prose(50, 4)]
    want = [slow_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert [simhash.fingerprint(t) for t in texts] == want


@pytest.mark.parametrize("hot", [512, 2])
def test_simhash_links_connect_all_within_three_bits(spark, hot):
    r = random.Random(11)
    values = set()
    for _ in range(12):
        base = r.getrandbits(64)
        values |= {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(12)}
    dense = r.getrandbits(64)
    values |= {dense ^ m for m in range(0, 64, 3)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), hot)
    for a, b in found.collect():
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    named = {r["node"]: r["component"] for r in connected_components(found).collect()}
    got = [named.get(v, v) for v in signed]
    want = slow_components(values)
    assert [[i for i, x in enumerate(got) if x == g] for g in got] == [[i for i, x in enumerate(want) if x == w] for w in want]


def test_near_dedup_keeps_one_of_each_component(spark, odd, empty):
    got = simhash.components(odd)
    assert got.count() == len(ODD)
    zero = {r["component_id"] for r in got.where("fingerprint = '0000000000000000'").collect()}
    assert zero == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert rows(kept, "doc_id") == [(x,) for x in sorted([1, 4, 5, 6, 7, 8, 2**62], key=lambda x: repr((x,)))]
    assert simhash.keep_one(empty).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[150] == got[200] == got[100] == 100 and 300 not in got and got[559] == 500
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# classifier


def test_classifier_orders_grades(spark, odd, empty):
    r = random.Random(2)
    texts, grades = [], []
    for i in range(400):
        grade = i % 3
        words = [r.choice(WORDS) for _ in range(60)]
        for bad in range(2 - grade):
            words[10 * bad] = ["awful", "dreadful"][bad]
        texts.append((i, " ".join(words)))
        grades.append((i, grade))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rated = spark.createDataFrame([g for g in grades if g[0] % 4], "doc_id long, grade int")
    model = classifier.fit(docs, rated)
    assert (np.diff(model.thresholds) >= 0).all()
    got = {x["doc_id"]: x for x in classifier.rate(docs, model).collect()}
    held = [(got[i]["expected_grade"], g) for i, g in grades if i % 4 == 0]
    means = [np.mean([e for e, g in held if g == k]) for k in range(3)]
    assert means[0] + 0.3 < means[1] < means[2] - 0.3
    assert np.mean([(got[i]["tail"] >= 0.5) == (g == 2) for i, g in grades if i % 4 == 0]) > 0.9
    assert classifier.rate(odd, model).count() == len(ODD)
    assert {x["kept"] for x in classifier.rate(odd, model).where("doc_id in (1, 2, 3)").collect()} == {False}
    assert classifier.fit(empty, rated) is None and classifier.rate(odd, None).where("kept").count() == len(ODD)


def test_grades_of_ratings(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 0, 1), (5, 1, None), (1, 1, 1), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert rows(classifier.graded(labels), "doc_id", "grade") == [(1, 1), (2, 1), (3, 1), (4, 0), (5, 2)]


# mixing


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weights[s] for s in names}
        full |= over


def test_mixing_meets_targets_and_agrees_with_itself(spark, odd, empty):
    r = random.Random(9)
    docs = [(i, prose(r.randint(1, 40), i), ["a", "b", "c", "d", None, "é"][min(5, int(r.expovariate(0.7)))]) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df, block=64).collect()
    again = mixing.mix(df.repartition(7), block=64)
    assert sorted((x["doc_id"], x["copies"]) for x in got) == sorted((x["doc_id"], x["copies"]) for x in again.collect())
    sizes, taken, goal = {}, {}, {}
    for x in got:
        assert 0 <= x["copies"] <= 2
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["size"] * x["copies"]
        goal[x["source"]] = x["target"]
    want = slow_targets(sizes)
    for s in sizes:
        assert abs(goal[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 40
    applied = mixing.apply(df)
    assert applied.columns == df.columns and applied.count() == sum(x["copies"] for x in mixing.mix(df).collect())
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
    assert mixing.apply(odd).columns == odd.columns and mixing.apply(empty).count() == 0


def test_pivotal_rounding_is_unbiased():
    import pandas as pd

    total = np.zeros(5)
    for seed in range(400):
        block = pd.DataFrame({"doc_id": list("abcde"), "luck": np.random.default_rng(seed).integers(-(2**60), 2**60, 5), "size": [10, 20, 30, 40, 50], "p": 0.4})
        done = mixing._rounded(block, True).sort_values("doc_id")
        assert set(done["p"]) <= {0.0, 1.0}
        total += done["p"].to_numpy()
    assert (abs(total / 400 - 0.4) < 0.1).all()


# languages


def test_language_sets_against_all_sets(spark):
    """The penalised likelihood of the selected set is that of the best of all sets, by long EM."""
    from itertools import combinations

    r = np.random.default_rng(4)
    made = r.dirichlet(np.full(300, 0.3), 3)
    logs = np.log(np.concatenate([made, np.full((3, languages.BUCKETS - 300), 1e-9)], axis=1)).astype(np.float32)
    model = languages.Model(("a", "b", "c"), logs)
    agree = 0
    for _ in range(40):
        mix = r.dirichlet([0.4] * 3)
        counts = np.zeros(languages.BUCKETS, dtype=np.int64)
        counts[:300] = r.multinomial(r.integers(50, 600), mix @ made)
        at = np.flatnonzero(counts)
        p, w = np.exp(logs[:, at].astype(float)), counts[at].astype(float)
        best = None
        for k in (1, 2, 3):
            for own in combinations(range(3), k):
                shares = np.full(k, 1 / k)
                for _ in range(500):
                    shares = shares * (p[list(own)] @ (w / (shares @ p[list(own)]))) / w.sum()
                value = float(w @ np.log(shares @ p[list(own)])) - languages.PENALTY * np.log(1 + w.sum()) * (k - 1)
                if best is None or value > best[0]:
                    best = (value, model.names[own[int(shares.argmax())]], float(shares.max()))
        name, score = languages.infer(counts, model)
        agree += name == best[1] and abs(score - best[2]) < 0.1
    assert agree >= 38


def test_languages(spark, odd, empty):
    r = random.Random(4)
    alphabets = {"xx": "abcde", "yy": "fghij", "zz": "abfgk"}

    def say(lang, n):
        return " ".join("".join(r.choice(alphabets[lang]) for _ in range(5)) for _ in range(n))

    docs = [(i, say(lang, 40), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = languages.fit(df)
    got = {x["doc_id"]: x for x in languages.predict(df, model).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in docs)
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in docs if got[i]["held_out"]]) > 0.95
    mixed = languages.infer(languages.trigrams(say("xx", 300) + " " + say("yy", 100)), model)
    assert mixed[0] == "xx" and 0.65 < mixed[1] < 0.85
    other = {x["doc_id"]: x for x in languages.predict(odd, model).where("doc_id < 4").collect()}
    assert {(x["lang_pred"], x["score"]) for x in other.values()} == {("und", 0.0)}
    assert languages.predict(odd, model).count() == len(ODD) and languages.predict(empty, model).count() == 0
    assert {x["lang_pred"] for x in languages.predict(odd, languages.fit(empty)).collect()} == {"und"}


def test_trigrams_of_chunks_are_those_of_the_whole(monkeypatch):
    assert languages.trigrams("12 34") is None and languages.trigrams(None) is None
    whole = languages.trigrams("abc def" * 40)
    monkeypatch.setattr(languages, "CHUNK", 50)
    assert (languages.trigrams("abc def" * 40) == whole).all()


# quality rules


def test_quality_base_counts_against_brute_force(spark, empty):
    import re
    from collections import Counter

    r = random.Random(6)
    texts = [None, "", " \n", "a", "a b c d", "a b c a b c", "x " * 200, "\n".join(["same line"] * 5), "# * $ é\n\n x", prose(70, 1), " ".join(r.choice("abcd") for _ in range(300)), prose(60, 2) + " " + prose(60, 2)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {x["doc_id"]: x for x in quality_rules.judge(df, None).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + d for k in range(len(words) - 2) for d in range(3) if seen[tuple(words[k : k + 3])] > 1}
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
        ), t[:40]
        assert x["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and x["kept"] == (not x["base_failed"])
    assert quality_rules.judge(empty, None).count() == 0


def test_quality_ratio_keeps_what_looks_trusted(spark, odd, empty):
    common = WORDS[:60]
    # one generator a document: with one a word, all its words were equal and the base rules fail it
    good = [(i, " ".join(r.choice(common) for _ in range(120))) for i in range(60) for r in [random.Random(i)]]
    junk = [(100 + i, " ".join(f"zz{(i * 7 + k) % 900}" for k in range(120))) for i in range(10)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    model = quality_rules.fit(docs, spark.createDataFrame([(i,) for i in range(30)], "doc_id long"))
    kept = {x["doc_id"] for x in quality_rules.judge(docs, model).where("kept").collect()}
    assert kept == set(range(60))
    none = quality_rules.fit(empty, spark.createDataFrame([], "doc_id long"))
    assert none.threshold is None and quality_rules.judge(odd, none).count() == len(ODD)


def test_quality_ratio_against_brute_force(spark):
    """Score, threshold and kept from their definitions, in plain Python."""
    r = random.Random(11)
    rows = [(i, " ".join(r.choice(WORDS[: 40 + 10 * (i % 5)]) for _ in range(r.choice([3, 60, 80, 120])))) for i in range(60)]
    rows += [(100 + i, " ".join(f"zz{r.randrange(500)}" for _ in range(90))) for i in range(12)] + [(200, None), (201, ""), (None, rows[3][1]), (5, rows[5][1])]
    trusted = set(range(0, 60, 2))

    score, threshold = brute.quality(rows, trusted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_rules.fit(docs, spark.createDataFrame([(i,) for i in sorted(trusted)], "doc_id long"))
    assert model.threshold == pytest.approx(threshold)
    got = quality_rules.judge(docs, model).collect()
    assert len(got) == len(rows)
    for x in got:
        expected = score(x["doc_id"], x["text"])
        assert (x["score"] is None) == (expected is None) and (expected is None or x["score"] == pytest.approx(expected))
        assert x["kept"] == (not x["base_failed"] and expected is not None and expected >= threshold)
    assert {x["doc_id"] for x in got if x["kept"]}.isdisjoint(range(100, 112))


def test_quality_ratio_does_not_blur_with_many_grams(spark):
    def made(i, words):
        r = random.Random(i)
        return " ".join(r.choice(words) for _ in range(200))

    # 1,500 documents of words of their own, 300,000 distinct words
    filler = [(10_000 + i, " ".join(f"f{i}x{k}" for k in range(200))) for i in range(1500)]
    good = [(i, made(i, WORDS[:200])) for i in range(60)]
    bad = [(1000 + i, made(1000 + i, WORDS[300:500])) for i in range(60)]
    docs = spark.createDataFrame(good + bad + filler, "doc_id long, text string")
    model = quality_rules.fit(docs, spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long"))
    judged = {x["doc_id"]: x for x in quality_rules.judge(docs, model).where("doc_id < 10000").collect()}
    assert {i for i, x in judged.items() if x["kept"]} == set(range(60))


# substrings


def test_chain_prefers_ordered_matches():
    a, b = [0, 3, 6, 9, 12], [100, 3, 6, 50, 12]
    assert substrings.chain(a, b)[0] == [1, 2, 4]


def test_chain_goes_on_after_a_long_gap():
    first, second = list(range(0, 500, 9)), list(range(560, 760, 9))
    shift = [x + 3 for x in first] + [x + 40 for x in second]
    chains = substrings.chain(first + second, shift)
    assert sorted(chains) == [list(range(len(first))), list(range(len(first), len(first) + len(second)))]


def test_chain_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        points = sorted({(r.randint(0, 80), r.randint(0, 80)) for _ in range(r.randint(1, 40))})
        a, b = [x for x, _ in points], [y for _, y in points]
        score = []
        for i in range(len(a)):
            before = [score[j] - substrings.GAP * (a[i] - a[j] + b[i] - b[j]) for j in range(i) if 0 < a[i] - a[j] <= substrings.REACH and 0 < b[i] - b[j] <= substrings.REACH]
            score.append(substrings.WORTH + max([0.0, *before]))
        got = substrings.chain(a, b)
        cost = sum(substrings.GAP * (a[y] - a[x] + b[y] - b[x]) for x, y in zip(got[0], got[0][1:]))
        # the next word of a diagonal is taken at once, which may miss a word's gap
        assert sorted(i for own in got for i in own) == list(range(len(a))) and max(score) - (substrings.WORTH * len(got[0]) - cost) <= 2 * substrings.WORTH
        assert all(0 < a[y] - a[x] <= substrings.REACH and 0 < b[y] - b[x] <= substrings.REACH for own in got for x, y in zip(own, own[1:]))


def test_second_fuzzy_passage_of_a_pair(spark):
    def edited(words, tag):  # two words inserted in the middle
        return words[:28] + [f"{tag}x", f"{tag}y"] + words[28:]

    one, two = prose(300, 91).split(), prose(56, 92).split()
    docs = [(1, " ".join([*one, prose(70, 93), *two])), (2, " ".join([*edited(one, "p"), prose(60, 94), *edited(two, "q")]))]
    got = substrings.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((x["start"], x["end"]) for x in got) == [(0, 302), (362, 420)]


def test_passages_need_one_earlier_document(spark):
    a, b, c = (prose(20, 700 + i) for i in range(3))
    docs = [(i, f"{prose(60, 710 + i)} {line} {prose(60, 720 + i)}") for i, line in enumerate([a, b, c])]
    half, own = prose(30, 703), prose(30, 704)
    changed = " ".join("new" if k == 15 else w for k, w in enumerate(own.split()))
    docs += [
        (10, f"{prose(60, 730)} {a} {b} {c} {prose(60, 731)}"),  # three lines of three documents
        (11, f"{prose(40, 732)} {a} {b} {c}"),  # now document 10 has them all
        (20, f"{prose(60, 733)} {half} {prose(60, 734)}"),
        (21, f"{prose(60, 735)} {half} {own} {prose(60, 736)}"),
        (22, f"{prose(60, 737)} {half} {changed} {prose(60, 738)}"),  # 21 has it, but 20 had half of it first
    ]
    got = substrings.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["start"], x["end"], x["other_doc_id"]) for x in got) == [(11, 40, 100, 10), (22, 60, 120, 21)]


def test_seeds_of_a_shared_run_don_t_depend_on_what_surrounds_it():
    r = np.random.default_rng(1)
    run = r.integers(0, 2**63, 20).astype(np.uint64)
    for _ in range(50):
        a = np.concatenate([r.integers(0, 2**63, r.integers(5, 60)).astype(np.uint64), run, r.integers(0, 2**63, 30).astype(np.uint64)])
        b = np.concatenate([r.integers(0, 2**63, r.integers(5, 60)).astype(np.uint64), run, r.integers(0, 2**63, 40).astype(np.uint64)])
        _, found = substrings._seeds(np.concatenate([a, b]), np.array([len(a), len(a) + len(b)]))
        assert len(found) != len(set(found.tolist()))


def test_passages_exact_and_fuzzy(spark, odd, empty):
    passage = prose(60, 77).split()
    fuzzy = passage[:30] + ["changed"] + passage[31:]
    docs = [(1, prose(100, 21) + " " + " ".join(passage) + " " + prose(40, 22)), (2, prose(30, 23) + " " + " ".join(passage) + " " + prose(90, 24)), (3, prose(70, 25) + "\n" + " ".join(fuzzy)), (4, prose(200, 26)), (5, " ".join(passage[:40]) + " " + prose(80, 27))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.passages(df).collect()}
    assert set(got) == {2, 3}
    assert (got[2]["start"], got[2]["end"], got[2]["other_doc_id"], got[2]["other_start"]) == (30, 90, 1, 100)
    assert (got[3]["start"], got[3]["end"]) == (70, 130)
    cut = {r["doc_id"]: r["text"].split() for r in substrings.remove(df).collect()}
    assert cut[1] == docs[0][1].split() and cut[2] == docs[1][1].split()[:30] + docs[1][1].split()[90:] and len(cut[3]) == 70 and cut[5] == docs[4][1].split()
    assert substrings.passages(empty).count() == 0
    kept = substrings.remove(odd)
    assert kept.columns == odd.columns and substrings.remove(empty).count() == 0
    # the null id comes first, so 6 loses its copy and goes; all else stays
    assert kept.count() == len(ODD) - 1 and kept.where("doc_id = 6").count() == 0


def test_passages_with_words_changed_all_along(spark):
    r, docs, want = random.Random(31), [], set()
    for i in range(40):
        passage = prose(60, 3000 + i).split()
        every = (5, 6, 8, 10)[i % 4]
        changed = [f"new{i}x{k}" if k % every == every - 1 else w for k, w in enumerate(passage)]
        docs += [(i, f"{prose(r.randint(5, 40), 4000 + i)} {' '.join(passage)} {prose(30, 5000 + i)}"), (1000 + i, f"{prose(r.randint(5, 40), 6000 + i)} {' '.join(changed)} {prose(30, 7000 + i)}")]
        want.add((1000 + i, i))
    got = substrings.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {(x["doc_id"], x["other_doc_id"]) for x in got}
    # every fifth word changed leaves twelve windows of four words, of which a quarter are seeds
    assert found <= want and found >= {x for x in want if x[1] % 4} and len(found) >= 0.9 * len(want)
    assert all(x["n_words"] >= 50 and x["n_equal"] >= 0.8 * x["n_words"] for x in got)


def test_passages_against_all_pairs(spark):
    """Recall and precision of planted fuzzy passages, by an alignment of all pairs of texts in plain Python."""
    r, docs = random.Random(47), []
    for i in range(24):
        passage = prose(r.choice([60, 80, 110]), 8000 + i).split()
        like = (1.0, 0.95, 0.9, 0.85)[i % 4]
        changed = list(passage)
        for k in r.sample(range(len(passage)), round(len(passage) * (1 - like))):
            changed[k] = f"c{i}x{k}"
        if i % 3 == 0:  # words put in and left out
            del changed[20]
            changed.insert(40, f"in{i}")
        docs += [(i, f"{prose(r.randint(5, 60), 8100 + i)} {' '.join(passage)} {prose(20, 8200 + i)}"), (100 + i, f"{prose(r.randint(5, 60), 8300 + i)} {' '.join(changed)} {prose(30, 8400 + i)}")]
    docs += [(300 + i, f"{prose(50, 8500 + i)} {' '.join(docs[2 * i][1].split()[10:40])} {prose(50, 8600 + i)}") for i in range(4)]  # 30 words alone
    words = {d: t.split() for d, t in docs}

    def shared(a, b):
        """Most equal words of an alignment."""
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b):
                above = row[j + 1]
                row[j + 1], left = max(above, row[j], left + (x == y)), above
        return row[-1]

    want = {(b, a) for b in words for a in words if a < b and len(set(words[a]) & set(words[b])) >= 30 and shared(words[a], words[b]) >= 40}
    got = substrings.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {(x["doc_id"], x["other_doc_id"]) for x in got}
    assert found <= want and len(found) >= 0.95 * len(want) and len(want) >= 22
    for x in got:  # what a row says holds in the texts
        mine, other = words[x["doc_id"]][x["start"] : x["end"]], words[x["other_doc_id"]]
        assert x["n_words"] == len(mine) >= 50 and x["n_equal"] >= 0.8 * len(mine)
        assert shared(mine, other[max(0, x["other_start"] - 3) : x["other_start"] + len(mine) + 3]) >= x["n_equal"]


def test_passages_that_very_many_share_stay_linear(spark):
    passage = prose(60, 78)
    df = spark.createDataFrame([(i, f"{prose(20, 1000 + i)} {passage} {prose(20, 5000 + i)}") for i in range(300)], "doc_id long, text string")
    got = substrings.passages(df).collect()
    # another than the first stands for it only where it has the word beside the passage as well
    assert len(got) == 299 and {r["doc_id"] for r in got} == set(range(1, 300)) and sum(r["other_doc_id"] == 0 for r in got) >= 290
    assert all(r["other_doc_id"] == 0 or r["n_words"] > 60 for r in got)


def test_without_words(spark):
    rows = [("a b  c\nd", [(1, 3)], "a d"), (" a b ", [(0, 2)], " "), ("a b c", [(2, 3), (0, 1)], "b "), ("a", [], "a"), ("", [(0, 1)], "")]
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int>>, want string")
    assert df.where(substrings.without(F.col("text"), F.col("spans")) != F.col("want")).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11)) and "pipeline" in names
    assert json.dumps(sorted(entry.oracle_sql()))


# licences however they are laid out


def laid_out():
    """(license, text) of every bundled text by width, copyright statement and case."""
    import re
    import textwrap

    out = []
    for name, text in licenses.bundled_texts():
        for width in (60, 72, 80, 100):
            paragraphs = ["\n".join(textwrap.wrap(p, width)) for p in re.split(r"\n[ \t\r]*\n", text)]
            holder = "Copyright (c) 2019-2021 The Very Long Company of Jane Doe and Sons,\nInc. <jane@example.org>. All rights reserved."
            for own in (paragraphs, [paragraphs[0], holder, *paragraphs[1:]], ["Copyright © 2020 Jane Doe", *paragraphs]):
                out += [(name, "\n\n".join(own)), (name, "\n\n".join(own).upper())]
    return out


def test_licenses_are_known_in_any_layout(spark):
    known = laid_out()
    isc = licenses.TEXTS["ISC"].replace("THE AUTHOR", "ISC").split("\n\n")
    published = ['Copyright (c) 2004-2010 by Internet Systems Consortium, Inc. ("ISC")\nCopyright (c) 1995-2003 by Internet Software Consortium', *isc[1:]]
    known.append(("ISC", "\n\n".join(published)))
    apache, mit = dict(licenses.bundled_texts())["Apache-2.0"], licenses.TEXTS["MIT"]
    changed = [apache.replace("(c) You must retain", "(c) You must pay the author a million. You must retain"), mit.replace("free of charge", "for a charge"), mit + "\nAnd pay.", "Copyright (c) 2020 Jane Doe"]
    assert all(x not in (apache, mit) for x in changed)
    cases = known + [(None, x) for x in changed]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan(df).collect()} == {i: name for i, (name, _) in enumerate(cases)}


def test_license_sql_reads_the_same_texts(spark, odd):
    import duckdb
    import pandas as pd

    data = [(100 + i, t) for i, (_, t) in enumerate(laid_out()[::7])] + [(i, t) for i, t, *_ in ODD] + [(90, "Text.\nCopyright 2020 A. Licensed under the MIT License.\nLicensed under CC BY 4.0.\n")]
    names = "doc_id", "digest", "license", "notices", "n_notices"
    con = duckdb.connect()
    con.register("frame", pd.DataFrame({"doc_id": pd.array([d for d, _ in data], "Int64"), "text": [t for _, t in data]}))
    con.sql("CREATE VIEW documents AS SELECT * FROM frame")
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({licenses.oracle_sql()})").fetchall(), key=repr)
    # null ids can't be joined there
    found = rows(licenses.scan(spark.createDataFrame(data, "doc_id long, text string")), *names)
    assert [r for r in found if r[0] is not None] == [r for r in want if r[0] is not None] and sum(r[2] is not None for r in found) > 30
    clashing = odd.withColumns({"digest": F.lit("x"), "license": F.lit("y"), "found": F.lit(1)})
    assert licenses.scan(clashing).count() == len(ODD) and {r["license"] for r in licenses.scan(clashing).collect()} == {None}


# fuzzy passages whose short windows other documents had first


@pytest.mark.parametrize("planted", [0, 1])
def test_passages_whose_windows_occurred_elsewhere_first(spark, planted):
    r, docs, want = random.Random(71 + planted), [], {}
    for key, (n, like) in enumerate([(n, like) for n in (50, 60, 100) for like in (1.0, 0.9, 0.85, 0.8) for _ in range(12)]):
        passage = [r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n)]
        copy = list(passage)
        for k in r.sample(range(n), round(n * (1 - like))):
            copy[k] = f"c{key}x{k}"
        if planted:
            windows = [passage[j : j + 4] for j in range(n - 3)]
            r.shuffle(windows)
            docs += [(1000 * key + j, " ".join(x for w in windows[j : j + 10] for x in [*prose(12, 9 * key + j).split(), *w])) for j in range(0, len(windows), 10)]
        docs += [(10**6 + key, f"{prose(40, 20_000 + key)} {' '.join(passage)} {prose(40, 30_000 + key)}"), (2 * 10**6 + key, f"{prose(30, 40_000 + key)} {' '.join(copy)} {prose(40, 50_000 + key)}")]
        want[2 * 10**6 + key] = n
    got = substrings.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    found = {x["doc_id"] for x in got if x["start"] < 30 + want.get(x["doc_id"], 0) - 10 and x["end"] > 40}
    assert {x["doc_id"] for x in got} <= set(want) and len(found) >= 0.9 * len(want)


# the quality classifier by brute force


def plain_grades(z, thresholds):
    """(expected grade, tail) of a score."""
    above = [1 / (1 + math.exp(-(z - t))) for t in thresholds]
    return sum(above), above[-1]


def test_ratings_against_the_formula(spark, odd):
    buckets = sorted({classifier.bucket(n) for n in ("one", "two", "^ünïcö", *(classifier.shape_name("short", i) for i in range(11)))})
    model = classifier.Model(np.array(buckets), np.linspace(-1.5, 2, len(buckets)), np.array([-0.3, 0.9]))
    weights = dict(zip(buckets, model.weights))
    repeated = odd.union(odd.where("doc_id = 4"))
    for r in classifier.rate(repeated, model).join(repeated.select("doc_id", "text").distinct(), "doc_id").collect():
        found = classifier.features(r["text"])
        z = sum(weights.get(classifier.bucket(n), 0.0) * v for n, v in found.items())
        grade, tail = plain_grades(z, model.thresholds) if found else (0.0, 0.0)
        assert r["expected_grade"] == pytest.approx(grade) and r["tail"] == pytest.approx(tail) and r["kept"] == (tail >= classifier.KEEP)


def test_descent_reaches_the_greatest_likelihood():
    """Against plain ascent by differences of the penalised likelihood of cumulative links."""
    r = np.random.default_rng(6)
    x = (r.random((60, 3)) < 0.5).astype(float)
    grades = np.clip(np.digitize(x @ [2.0, -1.0, 0.3] + r.logistic(0, 1, 60), [-0.5, 1.0]), 0, 2)

    def likelihood(p):
        w, theta = p[:3], p[3:]
        above = np.concatenate([np.ones((60, 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - theta))), np.zeros((60, 1))], 1)
        i = np.arange(60)
        return np.log(np.maximum(above[i, grades] - above[i, grades + 1], 1e-12)).mean() - classifier.RIDGE / 2 * (w @ w)

    p, step = np.array([0, 0, 0, -0.5, 0.5]), 1e-5
    for _ in range(3000):
        p = p + 1.0 * np.array([(likelihood(p + step * e) - likelihood(p - step * e)) / (2 * step) for e in np.eye(5)])
    rows_ = [{7 + j: v for j, v in enumerate(row) if v} for row in x]
    start = classifier.Model(np.zeros(0, np.int64), np.zeros(0), np.array([-0.5, 0.5]))
    got = classifier.descend(rows_, grades, start, 4000)
    mine = np.concatenate([got.weights, got.thresholds])
    assert likelihood(mine) == pytest.approx(likelihood(p), abs=1e-5) and np.allclose(mine, p, atol=0.05)
    assert (np.diff(got.thresholds) > 0).all()


def test_repeated_rated_rows_fit_as_before(spark):
    r = random.Random(15)
    texts = [(i, f"{'good' if i % 3 == 2 else 'bad'} {prose(30, 900 + i)}" if r.random() < 0.95 else prose(30, 900 + i)) for i in range(120)]
    rated = spark.createDataFrame([(i, i % 3) for i in range(120)], "doc_id long, grade int")
    model = classifier.fit(spark.createDataFrame(texts + texts[:40] + [(5, "another text of one id")], "doc_id long, text string"), rated)
    got = {x["doc_id"]: x["expected_grade"] for x in classifier.rate(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    best, rest = [got[i] for i in range(120) if i % 3 == 2], [got[i] for i in range(120) if i % 3 < 2]
    assert sum(best) / len(best) > sum(rest) / len(rest) + 0.3

"""The pipeline's stages, each against what it must do to its own input."""

import pytest

pytest.importorskip("patchloom.llm")
pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    from patchloom.llm import mixing, quality_rules, simhash, substrings
    from patchloom.llm.common import table

    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "near-duplicates", "substring dedup", "source mixing", "BPE encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES:
        before, docs = docs, table(stage(spark, docs, SF))
        seen.append((name, before, docs))
        if name != "BPE encoding":
            assert docs.columns == columns
    after = {name: (before, out) for name, before, out in seen}
    before, out = after["quality rules"]
    assert quality_rules.judge(out, None).where("base_failed").count() == 0 and 0 < out.count() < before.count()
    before, out = after["near-duplicates"]
    assert out.count() == simhash.components(before).select("component_id").distinct().count()
    before, out = after["substring dedup"]
    assert substrings.passages(out).count() <= substrings.passages(before).count() // 4
    before, out = after["source mixing"]
    assert out.count() == sum(r["copies"] for r in mixing.mix(before).collect())
    before, out = after["BPE encoding"]
    assert out.count() == before.count() and out.where("n_tokens <> size(split(ids, ' '))").count() == 0


def test_run_against_brute_force(spark, tmp_path):
    """run() over a small fixture: which documents are left, with which ids, and how often each source's words are taken."""
    import hashlib
    import random
    from collections import Counter

    import brute
    import public_tokenizers
    from test_operators import WORDS, prose
    from tokenizers import Tokenizer

    r = random.Random(61)
    common = WORDS[:80]
    texts = {i: " ".join(r.choice(common) for _ in range(r.randint(60, 140))) for i in range(80)}
    texts |= {100 + i: " ".join(f"zz{r.randrange(400)}" for _ in range(90)) for i in range(10)}  # junk
    texts |= {200 + i: texts[i] for i in range(5)}  # copies
    texts |= {300 + i: texts[10 + i] + " " + r.choice(common) for i in range(3)}  # near copies, most of them
    passage = " ".join(r.choice(common) for _ in range(70))
    texts |= {400 + i: f"{' '.join(r.choice(common) for _ in range(60))}\n{passage} {' '.join(r.choice(common) for _ in range(50))}" for i in range(4)}
    texts |= {500: "", 501: None, 502: "few words", 503: prose(30, 1), 504: "same words again " * 40}
    rows = sorted(texts.items())
    source = {i: ("a", "b", None)[i % 3] for i in texts}
    docs = spark.createDataFrame([(i, t, "en", source[i], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    trusted = set(range(0, 80, 2))
    spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    score, threshold = brute.quality(rows, trusted)
    left = [(i, t) for i, t in rows if not brute.base_failed(t) and score(i, t) >= threshold]
    assert not {i for i, _ in left} & set(range(100, 110))
    left = brute.without_passages(brute.keep_one(left))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in left}
    got = pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(x["doc_id"] for x in got)
    assert set(copies) <= set(want) and max(copies.values()) <= 2
    for x in got:
        assert x["n_tokens"] == len(want[x["doc_id"]]) and x["ids_sha256"] == hashlib.sha256(" ".join(map(str, want[x["doc_id"]])).encode()).hexdigest()
    # targets: 150 % of all words by weights 5, 2, 1, none above twice its source's
    size = Counter()
    for i, t in left:
        size[source[i]] += len(t.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, open_ = dict(zip(order, (5, 2, 1))), {}, set(order)
    total = 1.5 * sum(size.values())
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        target |= {s: 2 * size[s] for s in full} if full else {s: level * weight[s] for s in open_}
        open_ = open_ - full if full else set()
    taken = Counter()
    for i, t in left:
        taken[source[i]] += copies[i] * len(t.split())
    longest = max(len(t.split()) for _, t in left)
    assert all(abs(taken[s] - target[s]) <= longest for s in order)

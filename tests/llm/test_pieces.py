"""Words that are known without their marks are not tokenized again."""

import public_tokenizers

from patchloom.llm.packed_ids import Pieces


def test_a_word_is_tokenized_once_whatever_its_case_and_marks():
    pieces, seen = Pieces(public_tokenizers.path("word_bpe_49k.json")), []
    word = pieces.word
    pieces.word = lambda x: seen.append(x) or word(x)
    got = pieces.encode(["blorpish Blorpish, blorpish.", "BLORPISH; blorpish"])
    assert seen.count("blorpish") == 1
    want = [pieces.tokenizer.encode(x, add_special_tokens=False).ids for x in ("blorpish Blorpish, blorpish.", "BLORPISH; blorpish")]
    assert got == [b"".join(i.to_bytes(4, "little") for i in x) for x in want]

"""Texts that hold the string of an added token."""

import pytest

from vacantia.llm import packing, tokens

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>\n y <|endoftext|>z", "plain text here", "", " <|endof text|>"]


@pytest.mark.parametrize("as_text", [False, True])
def test_ids_are_those_of_the_tokenizer(as_text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_path())
    plain.encode_special_tokens = as_text
    enc = tokens.Encoder(tokens.default_path(), as_text)
    want = [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert (50256 in want[0]) is not as_text
    for texts, ids in ((TEXTS, want), (TEXTS[::-1], want[::-1])):
        assert [list(memoryview(b).cast("H")) for b in enc.encode(texts)] == ids


def test_packing_follows_the_plain_call(spark):
    docs = spark.createDataFrame([(1, "<|endoftext|>")], "doc_id long, text string")
    assert [r.doc_tokens for r in packing.pack(docs).collect()] == [2]
    assert packing.pack(docs, special_as_text=True).first().doc_tokens > 2

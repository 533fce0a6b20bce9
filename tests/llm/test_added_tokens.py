"""Texts with an added token's content against the library."""

import pytest

pytest.importorskip("foliant.llm")
from foliant.llm import bitpack  # noqa: E402
from foliant.llm.queries import vocabulary  # noqa: E402


def test_added_tokens_are_encoded_like_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    whole, enc = Tokenizer.from_file(path), bitpack.Encoder(path)
    texts = ["hello <|endoftext|> a", "<|endoftext|>", "a<|endoftext|>\n b  c", "hello <|endof text|> a", "plain words\nand  more", "<|endoftext|>\tx", ""]
    for _ in range(2):
        got = [x.tolist() for x in enc.encode([t.encode() for t in texts])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [31373, 220, 50256, 257]

"""The path that production takes, encode_all, against the untouched library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fathomline.llm import tokens

PIECES = ["the", " ", "  ", "\n", "\n\n", "\t", "a1", "don't", "I'LL", "É", "ü", "naïve", "中文", "🙂", "\x85", "\xa0", "½", "²", "\x01", "\x1c", "_", "--", "...", "x" * 70, "<|endoftext|>", "<|startoftext|>", "</w>", "Ġ", "\r\n", "ﬁ", "İ", "ß", "'s", "12,345.6", ""]


@pytest.mark.parametrize("name,word_ends", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encode_all_equals_the_library(name, word_ends):
    path, r = public_tokenizers.path(name), random.Random(9)
    texts = [None, "", " ", "\n", "plain words here", "word\nword word\nend", " lead", "trail ", "a\n b"] + ["".join(r.choice(PIECES) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randrange(1, 25))) for _ in range(3000)]
    texts += [" ".join(r.choice(PIECES[:1] + ["word", "other", "it's", "end."]) for _ in range(r.randrange(1, 40))) for _ in range(2000)]
    library, mine = Tokenizer.from_file(path), tokens.Encoder(path, word_ends, limit=500)
    for at in range(0, len(texts), 250):
        part = texts[at : at + 250]
        ids, ends = mine.encode_all(pa.array(part, pa.string()))
        for k, text in enumerate(part):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert np.asarray(ids[ends[k] : ends[k + 1]]).tolist() == want, repr(text)

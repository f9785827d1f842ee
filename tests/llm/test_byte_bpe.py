import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from cases import SF_DIR, awkward, empty, given

from foliospark.llm.byte_bpe import Encoder, encode_texts, read_ranks
from foliospark.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_query_equals_the_library(spark, library):
    want = set()
    for doc_id, text in given("documents", "doc_id, text"):
        ids = packed(library.encode_ordinary(text))
        want.add((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op8_byte_bpe"](spark, SF_DIR).collect()} == want


def test_odd_texts_equal_the_library(library):
    encoder, split = Encoder(read_ranks(PATH), remember=50), regex.compile(PATTERN)
    chance = random.Random(3)
    texts = ["", " ", "a" * 3000, "ab" * 700 + " " * 600 + "x", "é" * 400, "'s 'S don't I'LL", "½ ²x ⅷ 五", "<|endoftext|>"]
    texts += ["日本語🎉👩‍👧", "\n\n  \t x  ", "\x1c a\x85b", "0" * 500, "a  b \n c", " lead", "trail "]
    texts += ["".join(chance.choice("ab é\n1'sxyz. ") for _ in range(chance.randint(1, 500))) for _ in range(200)]
    for ids, text in zip(encoder.encode(texts, split), texts):
        assert ids == packed(library.encode_ordinary(text)), text[:40]
        assert encoder.decode(ids) == text.encode()


def test_awkward_rows(spark):
    rows = encode_texts(awkward(spark), PATH, PATTERN).collect()
    assert len(rows) == 14 and all(r["round_trip"] for r in rows)
    of = {r["id"]: r for r in rows}
    assert of[3]["n_tokens"] == 0 and of[4]["ids"] == [] and of[1]["ids"] == of[2]["ids"]
    assert encode_texts(empty(spark), PATH, PATTERN).collect() == []

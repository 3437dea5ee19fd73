import os
import random

import pytest
import tiktoken

from kvlake.llm import encode

PATH = os.path.join(encode.TOKENIZERS, encode.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="the vocabulary is not there")


@pytest.fixture(scope="module")
def other():
    ranks = {t: i for i, t in enumerate(encode.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_as_an_independent_encoder(other):
    tokens = encode.read_ranks(PATH)
    own, r = encode.Encoder(tokens, encode.merges_of(tokens)), random.Random(1)
    bits = ["a", "the ", "  ", "\n", "é", "中", "ing", "tion", "0", "12", "--", "==", "😀", "ст", "'s", "XX", " ", "<|endoftext|>"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 30))) + "".join(chr(r.randrange(1, 0x3000)) for _ in range(r.randint(0, 6)))
        assert own.encode(t).tolist() == other.encode_ordinary(t)
    assert b"".join(tokens[i] for i in own.encode("ab" * 60_000)) == b"ab" * 60_000


def test_rows(spark, other):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (4, "x" * 30_000), (1, "Hello  world"), (None, "a")]
    got = [(r.doc_id, r.ids) for r in encode.encode_corpus(spark.createDataFrame(rows, "doc_id int, text string")).collect()]
    assert sorted(got, key=str) == sorted([(i, other.encode_ordinary(t or "")) for i, t in rows], key=str)
    assert encode.encode_corpus(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_ids_stand_for_the_texts(spark):
    rows = [(1, "Hello  world é 中 😀\r\n"), (2, None), (3, ""), (1, "Hello"), (None, "\x00 \t")]
    coded = encode.encode_corpus(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted(((r.doc_id, r.text) for r in encode.decode_corpus(coded).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)

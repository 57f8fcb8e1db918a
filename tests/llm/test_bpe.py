import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    own = bpe.loaded(PATH, PATTERN)
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library_and_round_trips(text):
    own = bpe.loaded(PATH, PATTERN)
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    assert own.encode(text) == lib.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_ranks_out_of_order_still_merge_like_the_library(both):
    import random

    rng = random.Random(1)
    ranks = {bytes([b]): b for b in range(256)}
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(60)}
    for i, w in enumerate(rng.sample(sorted(words), len(words))):  # parts may rank after the whole
        ranks[w] = 256 + i
    own = bpe.ByteBpe(ranks, PATTERN)
    lib = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for _ in range(400):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        assert own.encode(text) == lib.encode_ordinary(text), text
    many = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    assert own.replay([m.encode() for m in many]) == [lib.encode_ordinary(m) for m in many]


def test_table(spark, both):
    texts = [None, "", "<|endoftext|> a  b", "x" * 20000, "漢字 and 😀", "a\r\n\tb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'k' key", "1 ids")
    out = bpe.encode(df, PATH, PATTERN)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        ids = both[1].encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.data) for r in bpe.decode(out, PATH, PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.encode(df.where("doc_id > 99"), PATH, PATTERN).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "a b"), (5, "a b")], "doc_id bigint, text string")
    assert len({r.ids_sha256 for r in bpe.encode(odd, PATH, PATTERN).collect()}) == 1 and bpe.encode(odd, PATH, PATTERN).count() == 4


def test_long_pre_tokens_fill_the_memory_sooner(both):
    own = bpe.ByteBpe(both[0].ranks, PATTERN)
    own.limit = 10
    for k in range(12):
        own.encode("漢" * (100 + k))
    assert len(own.memo) + len(own.last) <= 6 and own.encode("漢字" * 100) == both[1].encode_ordinary("漢字" * 100)

import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from lakeloom.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces):
    t = Tokenizer(models.Unigram([*pieces, ("<unk>", 0.0)], unk_id=len(pieces), byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.MARK, prepend_scheme="always", split=True)
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abAB  é\n漢▁.", max_size=40), st.integers(0, 9))
def test_counts_equal_the_librarys_on_tied_vocabularies(text, seed):
    rng = random.Random(seed)
    pieces = {rng.choice(["", unigram.MARK]) + "".join(rng.choice("abé ") for _ in range(rng.randint(1, 4))).replace(" ", "") for _ in range(14)} - {""}
    pieces = [(p, float(rng.choice([-1, -2, -2, -4]))) for p in sorted(pieces)]
    assert unigram.UnigramCounter(pieces).text(text)[0] == len(library(pieces).encode(text).ids)


def test_counts_equal_the_librarys_on_the_whole_vocabulary(spark):
    pieces = unigram.sentencepiece_pieces(PATH)
    texts = [None, "", " ", "The quick  brown fox, jumped.", "Cióndoue straße 漢字😀😀 x" * 50, "a" * 3000, "tab\tand\nline "]
    want = [len(library(pieces).encode(t or "").ids) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'x' key", "1 n_tokens")
    got = {r.doc_id: r.n_tokens for r in unigram.count(df, PATH).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert unigram.count(df.where("doc_id < 0"), PATH).count() == 0


def test_repeated_rows_null_ids_and_texts_without_spaces(spark):
    texts = ["漢字" * 4000, "漢字" * 4000, "漢 字", None]
    df = spark.createDataFrame([(None, t) for t in texts] + [(7, texts[2])] * 2, "doc_id bigint, text string")
    want = [len(library(unigram.sentencepiece_pieces(PATH)).encode(t or "").ids) for t in (*texts, texts[2], texts[2])]
    assert sorted(r.n_tokens for r in unigram.count(df, PATH).collect()) == sorted(want)
    counter = unigram.UnigramCounter([("a", -1.0), ("b", -1.0)])
    counter.text("a" * 500 + " b")
    assert list(counter.memo) == ["▁b"]

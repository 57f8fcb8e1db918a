import hashlib

import public_tokenizers
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lakeloom.llm import bpe  # noqa: E402

GOOD = "the river runs past the old mill and the children play near water every morning before school starts again "
ITEM = "seven grey whales crossed the northern bay while two fishing boats waited for the tide to turn and carry them home"


def world(spark, tmp_path):
    prose = [f"{GOOD} number{i} " + " ".join(f"word{i}x{j}" for j in range(40)) + "." for i in range(40)]
    junk = [" ".join(f"x{i}y{j}###" for j in range(60)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(prose)] + [(100 + i, t) for i, t in enumerate(junk)]
    rows += [(200, prose[3]), (201, prose[3]), (0, prose[0]), (300, f"{prose[5][:200]} {ITEM}"), (301, "mail me at a.b@mail.example.com or " + " ".join(f"q{j}z" for j in range(50)))]
    rows += [(400, ""), (401, None), (None, " ".join(f"n{j}m" for j in range(50)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, predicted string")
    labels = [(i, int(i < 100), 0) for i, _ in rows if i is not None and i < 200]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_each_stage_decides_and_keeps_columns(spark, tmp_path):
    sf_dir, rows = world(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    assert not [i for i in kept[0] if i is not None and 100 <= i < 200]
    assert set(range(40)) <= set(kept[0]) and {200, 300, 301, None} <= set(kept[0])
    assert 200 not in kept[1] and 201 not in kept[1] and kept[1].count(0) == 1 and kept[1].count(3) == 1 and None in kept[1]
    assert set(kept[1]) - set(kept[2]) == {300}
    assert sorted(map(str, kept[2])) == sorted(map(str, kept[3])) == sorted(map(str, kept[4]))
    redacted = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/stage3").collect()}
    assert redacted[301].startswith("mail me at <email> or q0z") and redacted[2] == dict(rows)[2]
    tok = bpe.loaded(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tok.ranks, special_tokens={})
    out = {r.doc_id: r for r in docs.collect()}
    ids = enc.encode_ordinary(redacted[301])
    assert out[301].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and out[301].n_tokens == len(ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(kept[4])


def test_no_labels_no_benchmark_long_texts_and_maps(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(150_000))
    docs = spark.createDataFrame([(1, long, {"a": 1}), (2, GOOD, None), (3, GOOD, {}), (None, None, {"b": 2})], "doc_id bigint, text string, extra map<string,int>")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in docs.collect()) == [(0, 0), (1, len(long)), (2, len(GOOD))]


def test_empty_tables(spark, tmp_path):
    sf_dir, _ = world(spark, tmp_path)
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id > 9999")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, sf_dir).columns == none.columns and stage(spark, none, sf_dir).count() == 0

import numpy as np
import public_tokenizers
import pytest

from shoploom.llm import queries, token_counts


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
@pytest.mark.parametrize("stretch", [2, 1024])
def test_against_a_walk(spark, monkeypatch, block, stretch):
    monkeypatch.setattr(token_counts, "STRETCH", stretch)
    r = np.random.default_rng(block)
    rows, want = [], set()
    for file in range(4):
        tokens = np.where(r.random(60) < 0.3, 9, r.integers(0, 9, 60)).astype("<u2")
        if file == 3:
            tokens = tokens[:0]
        if file == 2:
            tokens = np.append(tokens, [5]).astype("<u2")
        ordinal, n = 0, 0
        for t in tokens.tolist():
            if t == 9:
                want.add((file, ordinal, n))
                ordinal, n = ordinal + 1, 0
            else:
                n += 1
        if n:
            want.add((file, ordinal, n))
        rows += [(file, i // block, tokens[i : i + block].tobytes(), "clash") for i in range(0, len(tokens), block)]
    blocks = spark.createDataFrame(rows, "file long, block long, data binary, n string")
    got = [tuple(x) for x in token_counts.count_tokens(blocks, 9).select("file", "ordinal", "n_tokens").collect()]
    assert len(got) == len(want) and set(got) == want
    assert token_counts.count_tokens(blocks.limit(0), 9).count() == 0


@pytest.mark.parametrize("together", [1, 16])
def test_query(spark, tmp_path, monkeypatch, together):
    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(token_counts, "TOGETHER", together)
    texts = [None, "", "hello world", "été " * 300, "<|endoftext|>", "a\nb"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    encode = token_counts._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    got = queries.op9_token_counts(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(encode(t or "")) for i, t in enumerate(texts)}
    assert len(got) == len(texts)


def test_flat_files_of_odd_rows(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encode = token_counts._encoding(path, pattern).encode_ordinary
    texts = {"a": "one two", "b": None, "c": "", "d": "word " * 90_000}
    rows = [(i, t, "clash", 7) for i, t in [*texts.items(), ("a", "one two"), (None, "three"), (None, None)]]
    docs = spark.createDataFrame(rows, "doc_id string, text string, data string, block int").repartition(2)
    flat = token_counts.flatten(docs, path, pattern, 50_256).cache()
    counts = token_counts.count_tokens(flat.where("data is not null"), 50_256)
    got = flat.where("ordinal is not null").select("file", "ordinal", "doc_id").join(counts, ["file", "ordinal"]).collect()
    want = [(i, len(encode(t or ""))) for i, t, _, _ in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert token_counts.flatten(docs.limit(0), path, pattern, 50_256).count() == 0

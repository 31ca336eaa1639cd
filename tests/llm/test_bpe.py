import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoploom.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def numbers(ids):
    return list(memoryview(ids).cast("i"))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@example("\u0e48\u08ca")  # in whose order editions of Unicode differ
@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs", "Cn"), max_codepoint=0x2FFF) | st.sampled_from("漢字가😀<|endoftext|>'"), max_size=60))
def test_any_text_as_the_library(text):
    library = Tokenizer.from_file(PATH)
    assert numbers(bpe.encoder(PATH).encode_batch([text], True)[0]) == library.encode(text, add_special_tokens=False).ids


def test_turnover_of_kept_pieces(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 8 * bpe.PIECE_BYTES)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 5)
    texts = [f"word{i} tionre, a{i % 3} the the" for i in range(60)]
    e = bpe.Encoder(PATH)
    got = [numbers(ids) for i in range(0, 60, 7) for ids in e.encode_batch(texts[i : i + 7], True)]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_operator_on_odd_rows(spark, library):
    texts = [None, "", " \t", "Ça <|endoftext|> va", "x" * 30_000, "ΟΔΟΣ ﬁ", "same", "same", "a\x1cb\x00c"]
    docs = spark.createDataFrame([(i, t, [9]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == (library.decode(want, skip_special_tokens=False) if want else "")
    plain = bpe.encode(docs.where("doc_id = 3"), PATH, specials=False).first().ids
    assert 49407 not in plain
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_round_trip_is_both_in_one_worker(spark):
    texts = [None, "", " \t", "Ça <|endoftext|> va", "x" * 3000, "same", "same", "a\x1cb\x00c"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    both = bpe.decode(bpe.encode(docs, PATH), PATH).drop("text")
    once = bpe.round_trip(docs, PATH)
    assert once.columns == both.columns and sorted(once.collect()) == sorted(both.collect())
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["op6_bpe_round_trip", "pipeline"])
def test_queries_run_one_worker_for_a_task(spark, tmp_path, name):
    import corpus_pipeline

    spark.createDataFrame([(1, "the text", "en", "s", 8)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op6_bpe_round_trip(spark, str(tmp_path)) if name[0] == "o" else corpus_pipeline.encode_tokens(spark, docs, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_decode_skips_unknown_ids(spark):
    df = spark.createDataFrame([(1, [518, None, 99_999_999, -1, 518]), (2, None)], "k int, ids array<int>")
    assert [r.decoded for r in bpe.decode(df, PATH).orderBy("k").collect()] == ["the</w> the</w>", ""]


def test_query(spark, library, tmp_path):
    texts = [None, "Hello, the world's 42", "été ÉTÉ"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op6_bpe_round_trip(spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False) if ids else ""
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


@pytest.mark.parametrize("change", [
    lambda s: s["model"]["vocab"].pop("a"),
    lambda s: s["model"]["vocab"].pop("~</w>"),
    lambda s: s["normalizer"]["normalizers"].pop(),
    lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex="."),
    lambda s: s["model"].update(end_of_word_suffix="_"),
    lambda s: s["model"].update(byte_fallback=True),
])
def test_other_files_are_refused(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    change(spec)
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Encoder(str(tmp_path / "t.json"))


def test_kept_pieces_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 200_000)
    own = bpe.Encoder(PATH)
    library = Tokenizer.from_file(PATH)
    size = lambda kept: sum(bpe.PIECE_BYTES + 4 * len(p) + len(ids) for p, ids in kept.items())
    for batch in range(30):
        texts = [" ".join(f"{batch}{k}x" + "ab" * 1000 for k in range(5)) for _ in range(2)] + ["and the same words"]
        got = own.encode_batch(texts, False)
        assert [np.frombuffer(g, np.int32).tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert size(own.pieces) <= own.kept_bytes <= 200_000 + 10 * 20_000 and size(own.older) <= 400_000

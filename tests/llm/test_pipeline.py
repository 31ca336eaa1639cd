import collections
import glob

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shoploom.llm import pii, simhash, toxicity
from test_mixing import brute
from test_simhash import classes
from test_toxicity import texts as labelled


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity.Network.fit, "__defaults__", (60, toxicity.SEED))
    base = labelled(50, 3)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, (t, _) in enumerate(base)]
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(300))
    rows += [(100, long, "en", "s0", len(long)), (101, long + " wab", "en", "s1", len(long) + 4), (102, "mail me at a.b@x-y.com wab waa", "en", None, 30), (103, None, None, "s9", None), (104, "", "en", "s9", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(base)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, str(tmp_path)


def test_stages_against_a_plain_version(spark, folder):
    rows, path = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    network = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    kept = {r[0]: r for r in rows if toxicity.Scorer(network).scores([r[1]])[0] < toxicity.THRESHOLD}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if number < 4:
            assert docs.columns == columns, name
            docs.write.parquet(f"{path}/stage{number}")
            docs = spark.read.parquet(f"{path}/stage{number}")
        ids = sorted(r.doc_id for r in docs.collect())
        if number == 0:
            assert ids == sorted(kept)
        if number == 1:
            order = sorted(kept)
            roots = classes([simhash.fingerprint(kept[i][1]) % 2**64 for i in order])
            kept = {order[r]: kept[order[r]] for r in set(roots)}
        assert ids == sorted(kept), name
        if number == 2:
            for r in docs.collect():
                want = kept[r.doc_id][1]
                want = want and pii.masked(want, pii.spans(want, pii.trained()))
                assert r.text == want and r.n_chars == (None if want is None else len(want))
        if number == 3:
            slots = brute([(i, r[3]) for i, r in kept.items()])[0]
            files = sorted(glob.glob(f"{path}/stage{number}/part-*"))  # the order of the mix is that of the files' names
            place = [slots[i][2] for f in files for i in pq.read_table(f).column("doc_id").to_pylist()]
            assert place == sorted(place) and len(place) == len(kept)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.collect():
        text = kept[r.doc_id][1] or ""
        text = pii.masked(text, pii.spans(text, pii.trained()))
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_is_the_stages(spark, folder):
    _, path = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 0
    assert collections.Counter(type(r.ids) for r in rows) == {list: len(rows)}


def test_stages_on_odd_rows(spark, folder):
    """Every stage on null and repeated ids, repeated rows, a very long text, an extra column and no rows at all."""
    _, path = folder
    long = "word " * 60_000
    rows = [(None, "first of no id", "en", "s0", 14, "x"), (None, "another text without any id", "en", None, 27, "x"), (7, "same words here", "en", "s1", 15, None)]
    rows += [(7, "same words here", "en", "s1", 15, None), (7, "the same id but other words altogether", None, "s1", 38, "y"), (8, long, "en", "s0", None, "y"), (9, None, None, None, None, None), (10, "", "de", "", 0, "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, position string")
    for n, docs in (("odd", odd), ("none", odd.limit(0))):
        columns = docs.columns
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.count()
            docs = stage(spark, docs, path)
            docs.write.parquet(f"{path}/{n}{number}")
            docs = spark.read.parquet(f"{path}/{n}{number}")
            after = docs.collect()
            if number < 4:
                assert docs.columns == columns, name
            if n == "none":
                assert not after
            elif number == 1:  # of the equal rows, and of the texts without words, one stays
                kept = {r.text for r in after}
                assert len(after) == before - 2 and {r[1] for r in rows} - {None, ""} <= kept
            else:
                assert len(after) == before, name

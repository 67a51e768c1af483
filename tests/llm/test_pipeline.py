"""The pipeline against plain versions of what its stages decide."""
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_simhash import brute as simhash_groups
from test_substring_dedup import brute as substring_kept
from tokenizers import Tokenizer

from tallybook.llm import bpe, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    for _, out in steps[:-1]:
        assert out.columns == COLUMNS
    for _, out in steps[:4]:
        assert out.where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_toxic_documents_go(steps, spark, sf):
    docs, out = steps[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in out.collect()}
    want = {r.doc_id for r in toxicity.score(docs, labels).collect() if r.toxic_score < toxicity.THRESHOLD}
    assert kept == want
    known = {r.doc_id: r.toxic for r in labels.collect()}
    clean = [i for i, t in known.items() if t == 0]
    assert len(kept & set(clean)) >= 0.98 * len(clean)


def test_one_of_each_group_stays(steps):
    docs, out = steps[1]
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in simhash_groups(pairs(docs))})


def test_repeated_passages_go(steps):
    docs, out = steps[2]
    want = {i: (n, lost) for i, n, lost, _ in substring_kept(pairs(docs), 50)}
    have = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.collect()}
    assert have == {i: n - lost for i, (n, lost) in want.items() if not lost or lost < n}


def test_mix_and_tokens(steps, spark):
    docs, out = steps[3]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        have = iter(texts[r.doc_id].split())
        assert all(w in have for w in r.text.split())
    encoder = Tokenizer.from_file(bpe.default_vocabulary())
    tokens = steps[4][1].collect()
    assert sorted((r.doc_id, r.text) for r in tokens) == sorted((r.doc_id, r.text) for r in out.collect())
    assert all(r.ids == encoder.encode(r.text, add_special_tokens=False).ids for r in tokens)


def test_tokens_are_decoded_and_compared(steps):
    tokens = steps[4][1]
    assert tokens.count() > 0 and tokens.where("round_trip").count() == tokens.count()


def test_a_text_that_does_not_come_back_is_told(spark, docs, sf, monkeypatch):
    df = docs([(1, "one text"), (2, None), (3, "another text")])
    encode = bpe.encode
    monkeypatch.setattr(bpe, "encode", lambda *a, **k: encode(*a, **k).withColumn("decoded", F.expr("if(doc_id = 3, 'other', decoded)")))
    assert {r.doc_id: r.round_trip for r in bpe.stage(spark, df, sf).collect()} == {1: True, 2: True, 3: False}


def test_run(steps, spark, sf):
    key = lambda r: (r.doc_id, r.text)
    assert sorted(corpus_pipeline.run(spark, sf).collect(), key=key) == sorted(steps[-1][1].collect(), key=key)

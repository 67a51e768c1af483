import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallybook.llm import bpe


@pytest.fixture(scope="module")
def path():
    return bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


def texts():
    rng = random.Random(5)
    parts = ["hello", " world", "  ", "\n\n", " \t ", "'re", "'s", " 123", "4567", "é", " naïve", "漢字", "🙂", "...", "!?", "<|endoftext|>", "<|end", " ", " ", "ẞ", "a" * 90, " " * 70, "\x00", "​"]
    return ["", "x", "<|endoftext|>", "a<|endoftext|>b", "'" * 300, "ab" * 500, " " * 999, " x" * 600, "é" * 200] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(200)]


def test_same_as_the_library(path, library):
    vocab = bpe.vocabulary(path)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert vocab.encode(t).tolist() == want
        assert vocab.decode(np.array(want, np.uint32)) == library.decode(want, skip_special_tokens=False)


def test_fast_encoder_splits_every_common_code_point_alike(path, library):
    vocab = bpe.vocabulary(path)
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000 or not bpe._COMMON.fullmatch(chr(cp)):
            continue
        if 0x4E20 < cp < 0x9F00 or 0xAC20 < cp < 0xD700:
            continue
        c = chr(cp)
        t = f"a{c}b {c}{c} 1{c}  {c}x{c}\n{c} "
        assert vocab.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, hex(cp)


@pytest.mark.parametrize("window", [1, 2, 8])
def test_join_anywhere(path, library, window):
    vocab = bpe.vocabulary(path)
    rng = random.Random(6)
    for t in texts():
        t = vocab.sections(t)[0][0]
        if len(t) < 2:
            continue
        for middle in {1, len(t) - 1, *(rng.randrange(1, len(t)) for _ in range(4))}:
            whole = vocab.encode_section(t)
            assert vocab.join(vocab.encode_section(t[:middle]), vocab.encode_section(t[middle:]), t, middle, window) == tuple(whole)
    assert library.encode("ok").ids


RUNS = {"letters": "etaoinshrdlu", "cjk": "漢字東京大学生日本語中国", "emoji": "🙂🚀😀👍é", "digits": "0123456789", "signs": "'!?.-", "space": " \t\n"}


@pytest.mark.parametrize("name", RUNS)
def test_joins_in_a_text_without_a_split(path, library, monkeypatch, name):
    """200,000 code points in one run: what is encoded anew is at most a few windows a join."""
    rng = random.Random(11)
    text = "".join(rng.choice(RUNS[name]) for _ in range(200_000))
    parts = [text[i: i + 5_000] for i in range(0, len(text), 5_000)]
    vocab, again = bpe.vocabulary(path), [0]
    made = [vocab.encode_section(p) for p in parts]
    encode_section = vocab.encode_section

    def counted(t):
        again[0] += len(t)
        return encode_section(t)
    monkeypatch.setattr(vocab, "encode_section", counted)
    ids = vocab.tree(made, parts)[0]
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert again[0] <= 4 * 2 * bpe.WINDOW * (len(parts) - 1)


def test_join_anywhere_between_runs(path):
    """Long runs of one kind beside others, joined at every border between them and near it, by the smallest window."""
    vocab, rng = bpe.vocabulary(path), random.Random(12)
    for _ in range(150):
        runs = ["".join(rng.choices(RUNS[rng.choice(list(RUNS))], k=rng.choice((1, 2, 3, 12, 60)))) for _ in range(6)]
        text = "".join(runs)
        borders = [len("".join(runs[:i])) for i in range(1, 6)]
        whole = tuple(vocab.encode_section(text))
        for middle in {m for b in borders for m in (b - 1, b, b + 1, b + 5) if 0 < m < len(text)}:
            assert vocab.join(vocab.encode_section(text[:middle]), vocab.encode_section(text[middle:]), text, middle, 1) == whole


def test_runs_of_one_letter(path, library):
    """Equal letters keep no common border with a piece that begins elsewhere: the window grows to the end, and the ids are right."""
    vocab, text = bpe.vocabulary(path), "a" * 9_001
    parts = [text[i: i + 1_001] for i in range(0, len(text), 1_001)]
    assert vocab.tree([vocab.encode_section(p) for p in parts], parts)[0] == library.encode(text, add_special_tokens=False).ids


def test_encode(spark, docs, odd, path, library):
    rows = odd + list(enumerate(texts(), 100))
    for long in (bpe.LONG, 50):
        have = bpe.encode(docs(rows), path, decoded_col="score", long=long).collect()
        want = [(i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows]
        assert sorted(((r.doc_id, tuple(r.ids), r.score) for r in have), key=str) == sorted(want, key=str)
    assert "bundle" in have[0].asDict() and "ids" not in docs(rows).columns
    assert bpe.encode(docs(rows).limit(0), path).count() == 0


def test_decode(spark, docs, odd, path):
    done = bpe.encode(docs(odd), path).drop("text")
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(done, path).collect()) == sorted((str(i), t or "") for i, t in odd)


def test_whole_table(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    have = {r.doc_id: r for r in bpe.op2_bpe(spark, sf).collect()}
    assert len(have) == len(rows)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = have[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert re.fullmatch("[0-9a-f]{64}", r.ids_sha256)

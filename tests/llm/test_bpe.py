import base64
import random

import numpy as np
import pytest
import tiktoken

from sunloom.llm import bpe

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def exact():
    with open(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", "a", " ", "\n\n", "it's we'll WE'LL don't", "aaaaaaaaaaaaaaaaaaaaaaaa", "  double  spaces \n \n\tand tabs\t", "<|endoftext|> is text", "naïve café 12345 x=1.5e-7", "评估方法与转换电路的厚度为24.5kW,",
    "Уплотнение и пороговое значение", "光電変換モジュール", "🙂🙃 emoji", "\x00\x1c\x85 \xa0 odd　space", "a\xa0 b", "x" * 3000, "the " * 2000, "ab\n" * 500, "\r\nline\r\n", "trailing   ",
]


def encode_all(texts, chunk=None):
    e = bpe.Encoder(bpe.Vocabulary.load())
    ids, sizes = e.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_equals_the_reference_encoder(exact):
    rng = random.Random(0)
    letters = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x250), *range(0x400, 0x460), *range(0x4E00, 0x4E40), 10, 9, 13, 0xA0, 0x2003, 0x1F600)]
    mixed = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(200)]
    texts = TEXTS + mixed
    assert encode_all(texts) == [exact.encode_ordinary(t) for t in texts]


def test_pieces_and_forgetting_change_nothing(exact, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    e = bpe.Encoder(bpe.Vocabulary.load())
    for t in TEXTS:
        assert e.encode([t])[0].tolist() == exact.encode_ordinary(t), t
        assert "".join(bpe.safe_pieces(t)) == t


def test_round_trip(exact):
    for t, ids in zip(TEXTS, encode_all(TEXTS)):
        assert exact.decode(ids) == t


def test_operator_on_nulls_repeats_and_clashing_columns(spark, exact):
    rows = [(1, "a b", "x", 5), (2, None, "x", 5), (3, "", "x", 5), (1, "a b", "x", 5), (None, "c", "x", 5), (4, "long " * 300_000, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, id int")
    got = bpe.encode(df).collect()
    want = {(r[0], r[1]): exact.encode_ordinary(r[1]) if r[1] else [] for r in rows}
    assert len(got) == 6
    assert sorted((str(r.doc_id), len(r.ids)) for r in got) == sorted((str(k[0]), len(v)) for k, v in [(r[:2], want[r[:2]]) for r in rows])
    assert [r.ids for r in got if r.doc_id == 4] == [exact.encode_ordinary(rows[5][1])]
    assert bpe.encode(df.limit(0)).count() == 0
    n = bpe.count_tokens(df, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in n) == sorted((str(r.doc_id), len(r.ids)) for r in got)


def test_every_vocabulary_token_is_reached_by_its_own_merges(exact):
    v = bpe.Vocabulary.load()
    words = [b" solar", b"ing", b"zz", "é".encode(), b"aaa"]
    ids, counts = v.encode_words(words)
    assert counts.sum() == len(ids)
    assert exact.decode(ids.tolist()).encode() == b"".join(words)

import hashlib

import pytest

from dunlin.llm.bpe import Bpe, default_vocabulary, encode_documents

TEXTS = ["", "  ", "Hello  World", "it's WE'LL ''s 'x", "ΣΑΣ ΟΔΥΣΣΕΥΣ", "<|endoftext|> we'll<|startoftext|>x", "\x1c\x1d a b \u0085", "İstanbul ﬁ é 日本語 ½ ٣ 👍🏽", "a" * 3000, "×÷ ²³¹¼½¾ aªb µº x\u0085y\xa0z _ß-öø", "é café"]


@pytest.fixture(scope="module")
def bpe():
    return Bpe(default_vocabulary())


def test_equals_library(bpe):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(default_vocabulary())
    for text in TEXTS:
        e = t.encode(text, add_special_tokens=False)
        assert bpe.encode(text) == e.ids
        assert bpe.decode(e.ids) == t.decode(e.ids, skip_special_tokens=False)


def test_small_cache_gives_the_same(bpe):
    small = Bpe(default_vocabulary(), cache_words=4)
    for text in ("one two three four five six seven " * 5, *TEXTS):
        assert small.encode(text) == bpe.encode(text)


def test_documents(spark, bpe):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "y"), (3, "Hello world", "y"), (None, "abc", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = encode_documents(df, digests=True).collect()
    assert len(out) == 5
    by = {(r.doc_id, r.n_tokens) for r in out}
    n = len(bpe.encode("Hello world"))
    assert by == {(1, 0), (2, 0), (3, n), (None, len(bpe.encode("abc")))}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.ids_sha256 == r.decoded_sha256 == empty for r in out if r.n_tokens == 0)
    full = {r.doc_id: r for r in encode_documents(df).collect()}
    assert full[3].token_ids == bpe.encode("Hello world") and full[3].decoded == bpe.decode(full[3].token_ids)


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_code_point_as_the_library():
    from tokenizers import Tokenizer

    tok, bpe = Tokenizer.from_file(default_vocabulary()), Bpe(default_vocabulary())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 512):
        text = " ".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in points[a : a + 512])
        ids = tok.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids, hex(points[a])
        assert bpe.decode(ids) == tok.decode(ids, skip_special_tokens=False)

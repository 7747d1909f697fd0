import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")
HARD = ["", " ", "a" * 5000, "aaa aaaa", "don't we'll I'M", "<|endoftext|>", "\r\n\r\n\t x", "é̂ 漢字かな 🙏🏽 ﷽ ​\xa0\x00", "٣٤٥ 12345", "    def f(x):\n\treturn x  \n", "x" * 30 + " " * 400 + "y"]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Encoder(f.read()), t


def test_hard_texts(both):
    mine, lib = both
    assert mine.encode(HARD) == [x.ids for x in lib.encode_batch(HARD, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=80))
def test_any_text(both, text):
    mine, lib = both
    assert mine.encode([text])[0] == lib.encode(text, add_special_tokens=False).ids


def test_corpus_and_nulls(spark, sf, both):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "\n")], "doc_id bigint, text string")
    df = docs.select("doc_id", "text").unionByName(extra).selectExpr("*", "1 as key", "2 as n_tokens")
    got = {r.doc_id: list(r.ids) for r in tokens.token_ids(df, "doc_id", "text").collect()}
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    assert got == {k: both[1].encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, ["doc_id"], "text").collect()}
    assert counts == {k: len(v) for k, v in got.items()} and got[-1] == got[-2] == []


def test_forgetting(both, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    mine, lib = both
    for t in ("one two three four", "five six", "one two seven"):
        assert mine.encode([t])[0] == lib.encode(t, add_special_tokens=False).ids


def test_empty_table(spark):
    assert tokens.token_ids(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from sievework.llm import tokens

FOLDER = "/root/testdata/sf0.01"
SMALL = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁a", -3.0), ("▁ab", -4.0), ("xy", -1.5), ("ba", -2.0), ("é", -1.0)]
BYTES = SMALL + [(f"<0x{b:02X}>", 0.0) for b in range(256)]


def reference(pieces):
    model = Tokenizer(models.Unigram(pieces, 0, byte_fallback=any(p.startswith("<0x") for p, _ in pieces)))
    model.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("pieces", [SMALL, BYTES])
def test_counts_equal_the_tokenizer(pieces):
    counter, count = tokens.Counter(pieces), reference(pieces)

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet="abxyé▁ \nz語", max_size=14))
    def check(text):
        assert counter.text(text) == count(text), text

    check()


@pytest.mark.skipif(not os.path.exists(tokens.MODEL), reason="no vocabulary file")
def test_merges_equal_the_tokenizer():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL)
    counter = tokens.MergeCounter(tokens.load_pieces())

    @settings(max_examples=600, deadline=None)
    @given(st.text(alphabet="ab the ▁☃é\n\t<s>0x1🦄.,-ing語", max_size=40) | st.text(max_size=20))
    def check(text):
        if "\0" not in text:
            assert counter.text(text) == len(model.encode(text)), text

    check()
    assert [counter.text(" " * n) for n in range(300)] == [len(model.encode(" " * n)) for n in range(300)]


@pytest.mark.skipif(not os.path.exists(f"{FOLDER}/documents.parquet"), reason="no test tables")
def test_the_query_equals_the_tokenizer_on_the_whole_table(spark):
    import sentencepiece

    from sievework.llm.queries import op3_tokens

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    out = op3_tokens(spark, FOLDER).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.n_tokens == len(model.encode(texts[r.doc_id] or "")), r.doc_id


@pytest.mark.skipif(not os.path.exists(tokens.MODEL), reason="no vocabulary file")
def test_whole_table_with_a_public_vocabulary(spark):
    pieces = tokens.load_pieces()
    count = reference([("<unk>", -1e9), *pieces])
    texts = ["Hello world, this is a test.", "  two  spaces\nand lines\t", "Größe çà va 語言 🙂 ▁", "x" * 3000, None, "", "word " * 20000, "aaaa"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "aaaa", 1)], "doc_id long, text string, n_tokens int")
    out = tokens.count_tokens(docs).collect()
    assert len(out) == 9
    for r in out:
        text = "aaaa" if r.doc_id is None else texts[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (count(text), len(text.encode()))
    assert tokens.count_tokens(docs.limit(0), pieces).count() == 0

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelog.llm.token_counts import safe_pieces, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(texts):
    tok = Tokenizer.from_file(PATH)
    return [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_all_documents_match_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in token_counts(docs, PATH).collect()}
    rows = docs.collect()
    want = brute([r.text for r in rows])
    assert [got[r.doc_id].n_tokens for r in rows] == want
    assert all(got[r.doc_id].n_bytes == len(r.text.encode()) for r in rows)


def test_odd_texts(spark):
    texts = [None, "", " \t\n", "a<|endoftext|>b", "é ́x", "x　y\x85z\x1cw", "word " * 3000, "b" * 5000, "same", "same"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    rows = sorted(token_counts(docs, PATH, limit=2048, slice_bytes=1000).collect())
    assert [r.n_tokens for r in rows] == brute(texts)
    assert [r.over_limit for r in rows] == [n > 2048 for n in brute(texts)]
    assert token_counts(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_pieces_join_to_the_text(limit):
    text = b"some words, a-very-long-word-without-space and\nlines\tmore"
    pieces = list(safe_pieces(text, limit))
    assert b"".join(pieces) == text
    assert b" ".join(pieces).split() == text.split()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_take_whole_texts(spark, name):
    docs = spark.createDataFrame([(1, "two  words"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, public_tokenizers.path(name)).collect()}
    assert got[1] > 1 and got[2] == 0


def test_only_tokenizers_that_remove_white_space_are_cut_there(tmp_path):
    from tokenizers import Regex, models, pre_tokenizers

    from tidelog.llm.token_counts import splits_at_space

    assert splits_at_space(PATH) and not splits_at_space(public_tokenizers.path("byte_bpe_50k.json"))
    for pre, want in (
        (pre_tokenizers.WhitespaceSplit(), True),
        (pre_tokenizers.Split("x", "removed"), False),  # removes something else
        (pre_tokenizers.Split(Regex(" "), "removed"), False),  # leaves line breaks
        (pre_tokenizers.Metaspace(), False),
    ):
        tok = Tokenizer(models.BPE())
        tok.pre_tokenizer = pre
        tok.save(str(tmp_path / "t.json"))
        assert splits_at_space(str(tmp_path / "t.json")) is want

"""Token counts: batch encoding in Arrow functions that return lengths only.

White space never joins tokens of the supported JSON tokenizers (their pre-tokenizer drops or splits at
it), so a text may be cut at ASCII white space. Each Arrow batch is walked in slices of about equal bytes,
a text longer than a slice is cut at the white space nearest before the limit, and each slice's words that
were not seen yet go through one ``encode_batch`` call; the counts of seen words are kept in a bounded
memo. Tokenizers for which cuts at white space are not safe (sentencepiece, byte-level BPE that glues a
space to a word) encode whole texts instead.

Null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; an empty table gives none.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MEMO_WORDS = 400_000  # words whose counts one worker keeps
MEMO_BYTES = 64  # longer words are encoded anew each time


class WordCounter:
    """Counts tokens of UTF-8 texts by their white-space-separated words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.memo: dict[bytes, int] = {}

    def _encode(self, words: list[bytes]) -> list[int]:
        texts = [w.decode("utf-8", "replace") for w in words]
        return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[bytes]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        split = [t.split() for t in texts]
        new = list({w for ws in split for w in ws if w not in memo})
        long = {w: 0 for w in new if len(w) > MEMO_BYTES}
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for w, n in zip(some, self._encode(some), strict=True):
                (long if len(w) > MEMO_BYTES else memo)[w] = n
        get = (memo | long).__getitem__ if long else memo.__getitem__
        return [sum(map(get, ws)) for ws in split]


class PieceCounter:
    """Counts tokens of whole texts by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[bytes]) -> list[int]:
        return [len(x) for x in self.model.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)]


class TextCounter(WordCounter):
    """Counts tokens of whole texts where white space belongs to tokens."""

    def count(self, texts: list[bytes]) -> list[int]:
        return self._encode(texts)


def safe_pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """The text cut at ASCII white space into pieces of at most limit bytes, longer only where a word is."""
    at, n = 0, len(text)
    while n - at > limit:
        cut = max(text.rfind(c, at + 1, at + limit) for c in (b" ", b"\n", b"\t"))
        if cut < 0:
            later = [x for x in (text.find(c, at + limit) for c in (b" ", b"\n", b"\t")) if x >= 0]
            if not later:
                break
            cut = min(later)
        yield text[at:cut]
        at = cut
    yield text[at:]


def splits_at_space(path: str) -> bool:
    """Whether every ASCII white space ends a token and is none itself, as the tokenizer's own pre-tokenizer does it."""
    from tokenizers import Tokenizer

    pre = Tokenizer.from_file(path).pre_tokenizer
    if pre is None:
        return False
    cut = lambda text: [piece for piece, _ in pre.pre_tokenize_str(text)]
    alone = cut("ab") + cut("cd")
    return all(cut(f"{before}ab{s}cd{s}") == alone for c in " \t\n\r\x0b\x0c" for s in (c, c * 3, f" {c}", f"{c} ") for before in ("", c))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, slice_bytes: int = common.CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs(doc_id, text, ...)."""

    def count(batches):
        if tokenizer_path.endswith(".model"):
            counter, cut = PieceCounter(tokenizer_path), False
        elif splits_at_space(tokenizer_path):
            counter, cut = WordCounter(tokenizer_path), True
        else:
            counter, cut = TextCounter(tokenizer_path), False
        for part, buf, off in common.parts(batches, "text", slice_bytes):
            data = buf.tobytes()
            texts = [data[off[i] : off[i + 1]] for i in range(len(off) - 1)]
            if cut and len(texts) == 1 and len(data) > slice_bytes:
                tokens = [sum(counter.count([p])[0] for p in safe_pieces(data, slice_bytes))]
            else:
                tokens = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

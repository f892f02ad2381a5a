import hashlib
import random

import numpy as np
import pytest

from tidelog.llm.repeats import cut_repeats, digest, merge_transforms, repeated_starts, suffix_order, transform


def brute(rows, length):
    """Every string's first place, in order of (doc_id, start); null ids last."""
    key = lambda i: (i is None, i or 0)
    first: dict = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            w, at = data[p : p + length], (key(i), p)
            if w not in first or at < first[w]:
                first[w] = at
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < (key(i), p):
                gone[p : p + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


def made_up(seed, n=60):
    r = random.Random(seed)
    words = ["alpha", "beta", "né", "delta", "x", "yz", "longerword"]
    text = lambda k: " ".join(r.choice(words) + str(r.randrange(60)) for _ in range(k))
    passages = [text(r.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        pieces = [text(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            pieces += [p[a : a + r.randint(20, 400)], text(r.randint(0, 5))]
        rows.append((i, " ".join(pieces)))
    rows += [(n, None), (n + 1, ""), (n + 2, "a" * 500), (n + 3, "ab" * 300 + "a" * 150), (n + 4, rows[3][1]), (n + 5, rows[3][1] + "!"), (n + 5, rows[5][1]), (None, rows[3][1]), (n + 7, "z" * 99), (n + 8, "z" * 100)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "most", "crowded"), [(1, 1 << 26, 512), (2, 0, 3)])
def test_against_brute_force(spark, seed, most, crowded):
    rows = made_up(seed)
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, t int, spans string").repartition(3)
    assert order(digest(cut_repeats(docs, map_bytes=most, crowded=crowded)).collect()) == order(brute(rows, 100))
    assert cut_repeats(docs.limit(0), map_bytes=most).count() == 0


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = order(digest(cut_repeats(docs)).collect())
    assert got == order(brute(rows, 100)) and sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("seed", range(5))
def test_merging_gives_the_order_of_all_suffixes(seed):
    g = np.random.default_rng(seed)
    texts = [g.integers(1, 4, g.integers(1, 40)) for _ in range(7)]
    shards = [[texts[0], texts[3], texts[6]], [texts[1], texts[4]], [texts[2], texts[5]]]
    lines, bwts, ends, suffixes = [], [], [], []
    for k, shard in enumerate(shards):
        s = np.concatenate([np.append(t, 0) for t in shard]).astype(np.int16)
        at, bwt = transform(s, 8, 0)
        lines.append(at)
        bwts.append(bwt.astype(np.uint16))
        ends.append(len(shard))
        for p in range(len(s)):
            stop = p + int(np.argmax(s[p:] == 0))
            suffixes.append(([*s[p:stop].tolist(), (0, k, stop)], k, p))
    flat = lambda x: tuple((0, *v[1:]) if isinstance(v, tuple) else (1, v, 0) for v in x[0][:8])
    z, lcp = merge_transforms(bwts, ends, 8, 0)
    want = sorted(suffixes, key=flat)
    assert z.tolist() == [k for _, k, _ in want]
    for i in range(1, len(want)):
        a, b = flat(want[i - 1]), flat(want[i])
        common = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), 8)
        assert lcp[i] == common


def test_small_pieces():
    s = np.array([2, 1, 2, 1, 0, 2, 1, 0], np.int16)
    assert suffix_order(s, s == 0, 8).tolist()[:2] == [4, 7]
    texts = [b"abcdefgh", b"xxabcdef", b"abcdefgh"]
    found = repeated_starts(texts, np.array([[1, 0], [2, 0], [3, 0]]), 5, shards=2)
    assert [sorted(x.tolist()) for x in found] == [[], [2, 3], [0, 1, 2, 3]]


def test_many_texts_without_an_id(spark):
    r = random.Random(6)
    passages = ["".join(r.choice("abcdefgh ") for _ in range(180)) for _ in range(4)]
    rows = [(None if i % 2 else i, f"{r.randrange(99)} {passages[i % 4][: r.randint(100, 180)]} {r.randrange(99)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [x[1:3] for x in order(digest(cut_repeats(docs)).collect()) if x[0] is not None] == [x[1:3] for x in order(brute(rows, 100)) if x[0] is not None]


def test_a_repeat_over_the_border_of_a_very_long_text(spark):
    from tidelog.llm.repeats import SLICE

    g = np.random.default_rng(3)
    letters = lambda n: bytes(g.integers(97, 123, n, dtype=np.uint8)).decode()
    passage = letters(300)
    text = letters(1000) + passage + letters(SLICE - 150 - 1300) + passage + letters(2 * SLICE)
    docs = spark.createDataFrame([(1, text), (2, letters(500) + passage + letters(500)), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in cut_repeats(docs).collect()}
    at = SLICE - 150
    assert (got[1].n_removed, got[1].n_spans, bytes(got[1].kept)) == (300, 1, (text[:at] + text[at + 300 :]).encode())
    assert (got[2].n_removed, got[2].n_spans) == (300, 1) and got[3].n_removed == 0


def test_the_merge_reads_few_rows_a_step(monkeypatch):
    """Long repeats in many texts: a step sorts the rows that may part, not all of them at each of the hundred symbols."""
    g = np.random.default_rng(8)
    passage = bytes(g.integers(97, 123, 180, dtype=np.uint8))
    texts = []
    for i in range(400):
        a = int(g.integers(0, 40))
        texts.append(bytes(g.integers(97, 123, 20, dtype=np.uint8)) + passage[a : a + int(g.integers(110, 141))])
    texts += [b"a" * 150, b"\xff" * 120 + b"\x00" * 130, bytes(range(256)), b"a" * 130]
    bwts, ends = [], []
    for k in range(4):
        s = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int16) + 1, 0) for t in texts[k::4]])
        bwts.append(transform(s, 100, 0)[1].astype(np.uint16))
        ends.append(len(texts[k::4]))
    sorted_rows, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sorted_rows.append(len(x)) or plain(x, *a, **k))
    merge_transforms(bwts, ends, 100, 0)
    monkeypatch.undo()
    assert sum(sorted_rows) < 50 * sum(map(len, bwts))  # all rows at each symbol, twice, are 200
    found = repeated_starts(texts, np.array([[i, 0] for i in range(len(texts))]), 100)
    first: dict = {}
    for t in texts:
        for p in range(len(t) - 99):
            first.setdefault(t[p : p + 100], (t, p))
    want = [[p for p in range(len(t) - 99) if first[t[p : p + 100]] != (t, p)] for t in texts]
    assert [sorted(x.tolist()) for x in found] == want and sum(map(len, want)) > 5000

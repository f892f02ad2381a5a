import re
from collections import defaultdict

import pytest

from tidelog.llm.mixing import _meet, mix_sources, repeat_documents


def water_fill(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares again, round by round, what exceeds the most that a source may give."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not above:
            return target | {s: level * w[s] for s in open_}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_copies_and_reruns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mix_sources(docs, group=16, fan_in=4).collect()
    texts = docs.collect()
    assert {(r.doc_id, r.size, r.source) for r in rows} == {(d.doc_id, size(d.text), d.source) for d in texts}
    assert len(rows) == len(texts)
    sizes = defaultdict(int)
    for d in texts:
        sizes[d.source] += size(d.text)
    want = water_fill(sizes)
    largest = max(r.size for r in rows)
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    again = mix_sources(docs.repartition(7), group=16, fan_in=4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (2, "a b c", None, 1), (3, "", "x", 1), (4, "w " * 5000, "x", 1), (4, "w " * 5000, "x", 1), (None, "q r", "é", 1), (7, "　 z", "\U0001f680", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mix_sources(docs).collect()
    assert len(got) == 7 and all(0 <= r.taken <= 2 * r.size for r in got)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += size(r[1])
    want = water_fill(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in got)
    assert mix_sources(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 as copies", "2 as row_hash", "3 as _size", "4 as h", "5 as k", "6 as m", "7 as n", "8 as `row`")
    mixed = mix_sources(clash)
    repeated = repeat_documents(clash, mixed)
    assert repeated.columns == clash.columns and repeated.count() == sum(r.copies for r in mixed.collect())
    mixed = mix_sources(docs)
    assert repeat_documents(docs, mixed).count() == sum(r.copies for r in mixed.collect())


def test_meeting_keeps_mass_and_means():
    import random

    r = random.Random(3)
    for _ in range(300):
        p, q, a, b = r.random(), r.random(), r.randint(1, 50), r.randint(1, 50)
        x, y = _meet(p, a, q, b, r.random())
        assert x in (0.0, 1.0) or y in (0.0, 1.0)
        assert a * x + b * y == pytest.approx(a * p + b * q) and -1e-9 <= min(x, y) and max(x, y) <= 1 + 1e-9
    mean = sum(_meet(0.3, 2, 0.6, 5, r.random())[0] for _ in range(20000)) / 20000
    assert mean == pytest.approx(0.3, abs=0.02)


def test_rows_of_one_id_and_size_are_told_apart(spark):
    """The same mix of texts, however the table is partitioned."""
    rows = [(i % 3, f"text {i} {'x' if i % 2 else 'y'}", f"s{i % 2}") for i in range(60)] + [(1, "text 1 x", "s1")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixes = {tuple(sorted(map(tuple, repeat_documents(d, mix_sources(d)).collect()))) for d in (docs, docs.repartition(5), docs.coalesce(1))}
    assert len(mixes) == 1 and len(next(iter(mixes))) > 60


def test_every_document_keeps_its_probability():
    """Rounding group by group over many seeds: means as the copy probabilities, sums of words nearly fixed."""
    import random

    import pyarrow as pa

    from tidelog.llm.mixing import _level

    r = random.Random(8)
    n = 24
    size, p = [r.randint(0, 30) for _ in range(n)], [r.choice([0.0, 0.2, 0.5, 0.85, 1.0]) for _ in range(n)]
    cols = {"doc_id": pa.array(range(n), pa.int64()), "src": pa.array([0] * n, pa.int32()), "size": pa.array(size, pa.int64()), "bucket": pa.array([0] * n, pa.int64()), "p": pa.array(p), "level": pa.array([0] * n, pa.int32())}
    total, seeds = [0.0] * n, 1500
    for seed in range(seeds):
        rows = pa.Table.from_batches(list(_level(seed, 32, True)(iter([pa.RecordBatch.from_pydict(cols)])))).to_pylist()
        taken = {x["doc_id"]: x["p"] for x in rows}
        assert len(rows) == n and set(taken.values()) <= {0.0, 1.0}
        assert abs(sum(taken[i] * size[i] for i in range(n)) - sum(a * b for a, b in zip(p, size, strict=True))) <= max(size)
        for i in range(n):
            total[i] += taken[i]
    assert all(abs(t / seeds - x) < 0.05 for t, x in zip(total, p, strict=True))

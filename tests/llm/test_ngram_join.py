import random
import re

import duckdb
import pytest

from tidelog.llm.components import components
from tidelog.llm.ngram_join import ORACLE_SQL, keep_one, similar_components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [(d, len(sets[i]), ids.get(find(i))) for i, (d, _) in enumerate(rows)]


def near_copies(seed, groups=6, members=30):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.randint(3, 140))]
        for _ in range(members):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 25))):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append(" ".join(t))
    rows += [None, "", " \t", "One", "one", "one two", "ONE two", "one two three four", "w1 " * 3000]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent", "split"), [(3, 90, 512), (3, 90, 4), (5, 80, 8)])
def test_near_copies_against_brute_force(spark, k, percent, split):
    rows = near_copies(split)
    rows += [(7, rows[7][1]), (None, rows[8][1]), (None, "all alone here with a null id")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, c long")
    got = similar_components(docs, k, percent, bits=12, split=split).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, k, percent), key=key)


def test_against_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(ORACLE_SQL).fetchall()
    got = similar_components(docs, 3, 90).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r[0] != r[2] for r in want) > 20


def test_keep_one_and_empty(spark):
    rows = near_copies(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, n, c in brute(rows, 5, 80) if n == 0 or i == c}
    assert {r.doc_id for r in keep_one(docs).collect()} == want
    assert similar_components(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 150)}) == 1
    assert len(set(got.values())) == 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_by_join_when_ids_are_many(spark, monkeypatch):
    from tidelog.llm import ngram_join

    monkeypatch.setattr(ngram_join, "MAP_IDS", 0)
    rows = near_copies(3, groups=2, members=12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar_components(docs, 3, 90, bits=12).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 3, 90))


def test_links_are_named_as_those_used(spark):
    """Near copies of one text are all linked in truth; the column says that it counts the links the search used."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(40)]
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "class_size", "n_links_used"]
    got = got.collect()
    assert {r.component_id for r in got} == {0} and all(1 <= r.n_links_used <= 39 for r in got)


def test_a_hot_shingle_in_a_saturated_table(spark):
    """Many texts of one frequent passage, of which a few are near copies; all cells of the table are full."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    common = "this passage stands in very many of the texts"
    rows = [f"{r.choice(words)} {common} {r.choice(words)}" for _ in range(900)]
    rows += [" ".join([common] * 3 + [r.choice(words) for _ in range(6)]) for _ in range(300)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows, 3, 80))
    for options in ({}, {"bits": 6, "split": 16, "block": 64}):
        got = similar_components(docs, 3, 80, **options).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == want


def test_strong_signatures_bound_the_difference():
    import numpy as np

    from tidelog.llm.ngram_join import _folded, _strong

    g = np.random.Generator(np.random.PCG64(1))
    for n, m in ((5, 5), (200, 230), (300, 5000), (4000, 4100)):
        both = g.integers(0, 1 << 63, n // 2, dtype=np.uint64)
        a, b = (np.concatenate([both, g.integers(0, 1 << 63, k - n // 2, dtype=np.uint64)]) for k in (n, m))
        x, y = _strong(np.concatenate([a, b]), np.array([0, n, n + m]))
        size = min(len(x), len(y)) // 8
        apart = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
        assert apart <= len(set(a) ^ set(b)) and (apart > 0 or n == m == len(both))


def test_components_with_null_ends(spark):
    edges = [(1, 2), (2, None), (None, 3), (None, None), (1, 2), (2, 1), (4, 4), (5, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got.keys() == {1, 2, 5, 6} and got[1] == got[2] != got[5] == got[6]

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from tidelog.llm.decontamination import ORACLE_SQL, FMIndex, find_contamination, remove_contamination, sort_suffixes


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = tokens(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).update([] if item is None else [str(item)])
    out = []
    for i, text in docs:
        w, hit, items = tokens(text), set(), set()
        for k, names in windows.items():
            for at in range(len(w) - len(k) + 1):
                if tuple(w[at : at + len(k)]) == k:
                    hit.update(range(at, at + len(k)))
                    items |= names
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = find_contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), shard_bytes=100_000, block_windows=300).drop("spans")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(ORACLE_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[5] for r in want) > 5


def test_small_alphabet_against_brute_force(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("aBcdé1") for _ in range(n))
    bench = [(1, text(12)), (2, "x y"), (3, "Q"), (3, "Q"), (None, "r s t"), (5, None), (6, "..."), (10, text(11))]
    docs = [(i, text(r.randint(0, 60)) + r.choice(["", " X, y", " q", " r s t " + bench[0][1], bench[7][1].upper()]) + text(4)) for i in range(60)]
    docs += [(90, None), (91, ""), (92, "x y q " * 4000), (92, "same"), (92, "same"), (None, "x y")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    key = lambda x: (x[0] is None, x)
    for shard in (50, 1 << 20):
        got = find_contamination(d, b, shard_bytes=shard).drop("spans").collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(docs, bench), key=key)
    clean = remove_contamination(d.selectExpr("doc_id", "text", "1 as spans"), b)
    assert clean.columns == ["doc_id", "text", "spans"] and clean.count() == len(docs)
    assert not any("x y" in (r.text or "").lower() for r in clean.collect())
    assert find_contamination(d.limit(0), b).count() == 0
    assert find_contamination(d, b.limit(0)).where("n_hit > 0 or contaminated").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all(seed):
    g = np.random.default_rng(seed)
    s = g.integers(0, 4, 300)
    s[-1] = 0
    sep = s == 0
    sa = sort_suffixes(s, sep)
    # separators are unique symbols that compare by position
    order = {p: k for k, p in enumerate(np.flatnonzero(sep))}
    line = [(0, order[i]) if sep[i] else (1, int(s[i])) for i in range(300)]
    assert sa.tolist() == sorted(range(300), key=lambda i: line[i:])
    index = FMIndex(s, 4)
    for n in (1, 2, 3, 5):
        patterns = np.array([s[i : i + n] for i in range(290) if s[i : i + n].all()])
        which, lo, hi = index.search(patterns)
        assert len(which) == len(patterns)
        for k, a, b in zip(which, lo, hi, strict=True):
            want = [i for i in range(301 - n) if (s[i : i + n] == patterns[k]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want

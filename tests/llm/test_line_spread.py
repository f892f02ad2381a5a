from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline as P
from tidelog.llm.line_spread import ORACLE_SQL, boilerplate, cut_lines, digest, least_sites


def brute(rows, least):
    sites = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            sites[line.strip(" \t\r")].add(source)
    gone = {k for k, v in sites.items() if k and len(v) >= least}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in gone), s) for i, t, s in rows]


def test_against_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(ORACLE_SQL).fetchall()
    assert sum(r[2] for r in want) > 10
    assert sorted(map(tuple, digest(cut_lines(docs)).collect())) == sorted(want)


@pytest.mark.parametrize("most", [1000, 0])
def test_both_ways_on_odd_rows(spark, most):
    rows = [(i, f"Header\r\nown line {i}\n\n  \nfoot{i % 4}\n", f"s{i % 12}") for i in range(40)]
    rows += [(50, None, "a"), (51, "", "b"), (52, "Header", None), (52, "Header", None), (None, "Header\nx", "c"), (54, "long\n" * 20000 + "Header", "d"), (55, "two\ntwo", None)]
    rows += [(60 + i, "edge nine", f"e{i % 9}") for i in range(18)] + [(90 + i, "edge ten", f"e{i}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("doc_id", "text", "source", "1 as pos", "'k' as h")
    got = cut_lines(docs, 10, map_hashes=most)
    assert got.columns[:5] == docs.columns
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=key) == sorted(brute(rows, 10), key=key)
    assert cut_lines(docs.limit(0), 10, map_hashes=most).count() == 0
    clash = docs.selectExpr("*", "1L as _n_lines", "'x' as _id", "2 as _t", "3 as gone", "4 as `row`")
    plain = cut_lines(clash, 10, map_hashes=most, counted=False)
    assert plain.columns == clash.columns and {r._n_lines for r in plain.collect()} == {1}
    assert sorted((tuple(r)[:3] for r in plain.collect()), key=key) == sorted(brute(rows, 10), key=key)
    assert {r._n_lines for r in cut_lines(clash, 10, map_hashes=most).collect()} != {1}


@pytest.mark.parametrize(("sites", "least"), [(2, 3), (5, 3), (9, 5), (18, 9), (20, 10), (40, 10)])
def test_few_sites_in_the_pipeline(spark, sites, least):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(s, f"own {s}\n" + "\n".join(f"{passage} {k}" for k in range(1, 13) if s < k), f"s{s}") for s in range(sites)]  # passage k is on k sites
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "cast(length(text) as long) as n_chars")
    assert least_sites(docs) == least
    got = dict(P.STAGES)["lines"](spark, docs, "").collect()
    assert sorted((r.doc_id, r.text, r.source) for r in got) == sorted(brute(rows, least))
    assert any(passage in x[1] for x in brute(rows, least)) and all(f"{passage} {k}" not in r.text.split("\n") for r in got for k in range(least, min(sites, 12) + 1))


def test_no_sites(spark):
    assert least_sites(spark.createDataFrame([], "doc_id long, text string, source string")) == 3


def test_sketches_that_estimate(spark):
    """So many sites that the small sketches estimate; near the threshold exact counts decide."""
    rows = [(1000 * k + i, f"line on {k}", f"site {i}") for k in range(60, 150, 3) for i in range(k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wide = boilerplate(docs.select("source", "text"), 100, lg_k=6)
    want = {k for k in range(60, 150, 3) if k >= 100}
    hashes = {r.h: r.line for r in docs.selectExpr("xxhash64(text) as h", "text as line").distinct().collect()}
    assert {int(hashes[r.h].split()[-1]) for r in wide.collect()} == want

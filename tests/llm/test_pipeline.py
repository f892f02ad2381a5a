import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from test_decontamination import tokens
from test_line_spread import brute as brute_lines
from test_mixing import size, water_fill
from test_ngram_join import brute as brute_components

import corpus_pipeline as P
from tidelog.llm.compression_quality import score, train


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(P.STAGES)
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    kept = stages["quality"](spark, docs, sf).cache()
    rejected = {r.doc_id for r in score(docs, train(docs, labels)).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected and kept.columns == columns

    cut = stages["lines"](spark, kept, sf).cache()
    want = brute_lines([(r.doc_id, r.text, r.source) for r in kept.collect()], 10)
    assert sorted((r.doc_id, r.text, r.source) for r in cut.collect()) == sorted(want) and cut.columns == columns
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    one = stages["near_copies"](spark, cut, sf).cache()
    want = {i for i, n, c in brute_components([(r.doc_id, r.text) for r in cut.collect()], 5, 80) if n == 0 or c == i}
    assert {r.doc_id for r in one.collect()} == want and one.columns == columns

    clean = stages["leaks"](spark, one, sf).cache()
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = tokens(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    before = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        w = tokens(r.text)
        assert not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
        old = tokens(before[r.doc_id])
        if not any(tuple(old[i : i + 10]) in windows for i in range(len(old) - 9)):
            assert r.text == before[r.doc_id]
    assert clean.columns == columns and clean.count() == one.count()

    mixed = stages["mix"](spark, clean, sf)
    copies, rows = Counter(r.doc_id for r in mixed.collect()), clean.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += copies[r.doc_id] * size(r.text)
    largest = max(size(r.text) for r in rows)
    assert max(copies.values()) <= 2 and mixed.columns == columns
    assert all(abs(taken[s] - t) <= largest for s, t in water_fill(sizes).items())


def test_run_on_an_empty_table(spark, tmp_path, sf):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_clashing_columns(spark, tmp_path, sf):
    """Nulls, repeated ids and rows, and columns named as the stages name theirs."""
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(i, f"line of document {i}\n{words} {i}", f"s{i % 4}") for i in range(12)]
    rows += [(None, None, None), (None, "all alone", None), (3, "another text of one id", "s1"), (3, "another text of one id", "s1"), (20, "", "s2"), (21, None, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "doc_id", "text", "'en' as lang", "source", "cast(length(text) as long) as n_chars", "1 as copies", "2 as _n_lines", "3 as _size", "4 as component_id", "5 as c", "6 as n", "7 as row_hash")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = P.run(spark, str(tmp_path))
    assert got.columns == docs.columns
    found = got.collect()
    texts = {(r.doc_id, r.text) for r in found}
    assert (None, "all alone") in texts or len(found) > 3
    assert all((r.copies, r._n_lines, r._size, r.component_id, r.row_hash) == (1, 2, 3, 4, 7) for r in found)
    assert len({r.doc_id for r in found if r.text and words in r.text}) <= 1

"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents with about SHARD bytes of text. Its words become symbols: the words of the
benchmark have numbers, every maximal stretch of other words (and every document end) is one separator, and
separators compare by position, so that no match crosses them. The shard's suffixes are sorted by prefix
doubling, their Burrows-Wheeler transform goes into a wavelet matrix, and all benchmark windows are searched
backwards at once through its ranks. Rows of the found ranges are located by walking back to sampled suffix
positions; a row before a separator is always sampled, so that walks never cross one. Found windows mark their
words, and runs of marked words are the spans to remove.

The benchmark is the query set: its windows go out in blocks of at most BLOCK_WINDOWS, each shard meets every
block. One block goes out with the only pass; of several, each has a pass of its own, whose hits are written out and
merged, so that what is sent out doesn't grow with the benchmark. Each task holds one shard at a time.

Nulls: a null text has no words, so it is never hit, and as an item gives no window. A null item_id marks words but
has no name in the lists of items. Repeated documents are judged each; repeated items count once. An empty
benchmark hits nothing; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import discard, materialize

WINDOW = 10
SHARD = 2 << 20
BLOCK_WINDOWS = 200_000
SAMPLE = 8  # every SAMPLE-th suffix position is kept


# ---------------------------------------------------------------- the index


def sort_suffixes(s: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """Positions of s in suffix order, where separators come first and compare by position.

    Prefix doubling: groups of equal prefixes are sorted anew by the rank behind, until all are single.
    """
    n = len(s)
    rank = np.empty(n, np.int64)
    n_sep = int(separator.sum())
    rank[separator] = np.arange(n_sep)
    rest = np.flatnonzero(~separator)
    # first by up to three symbols; what follows a separator never counts
    width = max(1, int(s.max()).bit_length()) if n else 1
    take, ended = 1, np.zeros(len(rest), bool)
    if 3 * width <= 62:
        take = 3
        one = np.minimum(rest + 1, n - 1)
        behind1 = np.where((rest + 1 < n) & ~separator[one], s[one], 0)
        two = np.minimum(rest + 2, n - 1)
        behind2 = np.where((behind1 > 0) & (rest + 2 < n) & ~separator[two], s[two], 0)
        key = (s[rest] << (2 * width)) | (behind1 << width) | behind2
        ended = behind2 == 0  # a separator follows: the stable sort has put these by position already
    else:
        key = s[rest].astype(np.int64)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ended[order][1:]
    # a group's rank is that of its first place, so later splits keep the others' ranks
    first = np.flatnonzero(new)
    group = np.repeat(first, np.diff(np.append(first, len(order))))
    sa = rest[order]
    rank[sa] = n_sep + group
    k = take
    while True:
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        many = np.repeat(size > 1, size)
        if not many.any():
            break
        at = np.flatnonzero(many)
        pos = sa[at]
        behind = np.where(pos + k < n, rank[np.minimum(pos + k, n - 1)] + 1, 0)
        key2 = np.lexsort((behind, group[at])) if n >= 1 << 31 else np.argsort((group[at] << 32) | behind, kind="stable")
        pos, behind, mine = pos[key2], behind[key2], group[at][key2]
        sa[at] = pos
        fresh = np.ones(len(at), bool)
        fresh[1:] = (mine[1:] != mine[:-1]) | (behind[1:] != behind[:-1])
        new[at] = fresh
        start = np.flatnonzero(fresh)
        group[at] = np.repeat(at[start], np.diff(np.append(start, len(at))))
        rank[pos] = n_sep + group[at]
        k *= 2
    return np.concatenate([np.flatnonzero(separator), sa])


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with running counts a level, highest bit first."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            count = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(seq) - int(count[-1]))
            high = bit.astype(bool)
            seq = np.concatenate([seq[~high], seq[high]])
        self.first = np.searchsorted(self._keys(seq), self._keys(np.arange(symbols)))

    def _keys(self, x: np.ndarray) -> np.ndarray:
        """The order of symbols at the bottom: by reversed bits."""
        out = np.zeros(len(x), np.int64)
        for b in range(self.bits):
            out = (out << 1) | ((x >> b) & 1)
        return out

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol c stands before place i."""
        i = i.astype(np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ones[i]
            i = np.where((c >> (self.bits - 1 - level)) & 1, zeros + up, i - up)
        return i - self.first[c]


class FMIndex:
    """Backward search and location over one shard's symbols (0: separator, 1..: words of the benchmark)."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = SAMPLE):
        separator = s == 0
        self.n = len(s)
        sa = sort_suffixes(s, separator)
        self.bwt = np.where(sa > 0, s[sa - 1], 0)
        self.tree = WaveletMatrix(self.bwt, symbols)
        self.c = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=symbols), out=self.c[1:])
        keep = (sa % sample == 0) | (self.bwt == 0)
        self.sampled = np.zeros(self.n + 1, np.int64)
        np.cumsum(keep, out=self.sampled[1:])
        self.kept = sa[keep]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns of one length, a row each: (indexes of those that occur, first row, row behind the last)."""
        last = patterns[:, -1]
        lo, hi, alive = self.c[last], self.c[last + 1], np.arange(len(patterns))
        for step in range(patterns.shape[1] - 2, -1, -1):
            on = hi > lo
            lo, hi, alive = lo[on], hi[on], alive[on]
            if not len(alive):
                break
            c = patterns[alive, step]
            lo, hi = self.c[c] + self.tree.rank(c, lo), self.c[c] + self.tree.rank(c, hi)
        on = hi > lo
        return alive[on], lo[on], hi[on]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out = np.full(len(rows), -1, np.int64)
        rows, at, steps = rows.copy(), np.arange(len(rows)), 0
        while len(at):
            hit = self.sampled[rows + 1] > self.sampled[rows]
            out[at[hit]] = self.kept[self.sampled[rows[hit]]] + steps
            rows, at = rows[~hit], at[~hit]
            c = self.bwt[rows]
            rows = self.c[c] + self.tree.rank(c, rows)
            steps += 1
        return out


# ---------------------------------------------------------------- benchmark windows


@dataclass
class Block:
    """Distinct windows by length, and the items of each."""

    vocabulary: np.ndarray  # sorted hashes; a word's symbol is its place + 1
    patterns: dict[int, np.ndarray] = field(default_factory=dict)  # length -> rows of symbols
    items: dict[int, list[tuple[str, ...]]] = field(default_factory=dict)


def _block(windows: dict[tuple, set]) -> Block:
    vocabulary = np.unique(np.array([h for w in windows for h in w], np.uint64))
    block = Block(vocabulary)
    for n in sorted({len(w) for w in windows}):
        some = [w for w in windows if len(w) == n]
        block.patterns[n] = np.searchsorted(vocabulary, np.array(some, np.uint64)) + 1
        block.items[n] = [tuple(sorted(windows[w])) for w in some]
    return block


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """Blocks of the benchmark's windows, built one at a time from a stream of its rows."""
    windows: dict[tuple, set] = {}
    for r in benchmark.select("item_id", "text").toLocalIterator():
        buf = np.frombuffer((r.text or "").encode("utf-8", "replace"), np.uint8)
        s, e, _ = common.words(buf, np.array([0, len(buf)]), common.ALNUM)
        if not len(s):
            continue
        h = tuple(common.word_hashes(buf, s, e).tolist())
        for i in range(max(1, len(h) - window + 1)):
            names = windows.setdefault(h[i : i + window], set())
            if r.item_id is not None:
                names.add(str(r.item_id))
        if len(windows) >= most:
            yield _block(windows)
            windows = {}
    if windows:
        yield _block(windows)


# ---------------------------------------------------------------- search


def _match(h: np.ndarray, word_offsets: np.ndarray, block: Block) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(marked words, (word, length, pattern) of each occurrence) of one block in one shard."""
    marked = np.zeros(len(h) + 1, np.int32)
    if not len(h) or not len(block.vocabulary):
        return marked[:-1].astype(bool), []
    at = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
    symbol = np.where(block.vocabulary[at] == h, at + 1, 0)
    # a separator stands before each document and for each stretch of other words
    head = np.zeros(len(h), bool)
    edge = word_offsets[:-1][np.diff(word_offsets) > 0]
    head[edge] = True
    keep = symbol > 0
    gap = np.ones(len(h), bool)
    gap[1:] = ~keep[:-1]
    lead = keep & (head | gap)
    where = np.flatnonzero(keep)
    if not len(where):
        return marked[:-1].astype(bool), []
    shift = np.cumsum(lead[where])
    s = np.zeros(len(where) + int(shift[-1]) + 1, np.int64)
    s[np.arange(len(where)) + shift] = symbol[where]
    word_at = np.full(len(s), -1, np.int64)
    word_at[np.arange(len(where)) + shift] = where
    index = FMIndex(s, len(block.vocabulary) + 1)
    found = []
    for n, patterns in block.patterns.items():
        which, lo, hi = index.search(patterns)
        if not len(which):
            continue
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
        first = word_at[index.locate(rows)]
        np.add.at(marked, first, 1)
        np.subtract.at(marked, first + n, 1)
        found.append((n, first, np.repeat(which, hi - lo)))
    return np.cumsum(marked[:-1]) > 0, found


def _shards(batches, shared, shard_bytes: int):
    """For each shard: the Arrow slice, bytes, offsets, word starts and ends, word offsets, marked words, items by document."""
    for part, buf, off in common.parts(batches, "text", shard_bytes):
        s, e, woff = common.words(buf, off, common.ALNUM)
        h = common.word_hashes(buf, s, e) if len(s) else np.zeros(0, np.uint64)
        marked = np.zeros(len(h), bool)
        items: dict[int, set] = {}
        for b in shared:
            block = b.value
            more, found = _match(h, woff, block)
            marked |= more
            for n, first, which in found:
                doc = np.searchsorted(woff, first, "right") - 1
                for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
                    items.setdefault(d, set()).update(block.items[n][w])
        yield part, buf, off, s, e, woff, marked, items


def _spans(s, e, woff, marked) -> tuple[np.ndarray, np.ndarray]:
    """First and last bytes of maximal runs of marked words that don't cross documents."""
    first = marked.copy()
    first[1:] &= ~marked[:-1]
    last = marked.copy()
    last[:-1] &= ~marked[1:]
    edge = woff[(woff > 0) & (woff < len(marked))]
    first[edge] = marked[edge]
    last[edge - 1] = marked[edge - 1]
    return s[first], e[last]


def _first_two(benchmark: DataFrame, window: int, most: int):
    """(the only block, None), or (None, all blocks one after another) where there are several."""
    rest = blocks(benchmark, window, most)
    one, two = next(rest, _block({})), next(rest, None)
    return (one, None) if two is None else (None, itertools.chain([one, two], rest))


def _key():
    """Rows of one doc_id and text are hit alike."""
    return [F.col("doc_id").cast("long").alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")]


_RUNS = "k long, h long, runs array<struct<first:long,last:long,start:long,end:long>>, items array<string>"


def _hits_by_block(docs: DataFrame, several, shard_bytes: int) -> DataFrame:
    """(k, h, runs, items) of the rows that any block hits: a pass over the documents for each, one block at a time."""
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))
    rows, parts = docs.select(*_key(), "text"), []
    for block in several:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            for part, _, off, s, e, woff, marked, items in _shards(batches, [shared], shard_bytes):
                runs: dict[int, list] = {}
                if marked.any():
                    for a, b in zip(*_spans(s, e, woff, marked), strict=True):
                        i = int(np.searchsorted(off, a, "right")) - 1
                        first, last = int(np.searchsorted(s, a)), int(np.searchsorted(s, b))
                        runs.setdefault(i, []).append({"first": first - int(woff[i]), "last": last - int(woff[i]), "start": int(a - off[i]), "end": int(b - off[i])})
                at = pa.array(list(runs), pa.int64())
                names = pa.array([sorted(items.get(i, ())) for i in runs], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part["k"].take(at), part["h"].take(at), pa.array(list(runs.values()), run_type), names], names=["k", "h", "runs", "items"])

        parts.append(materialize(rows.mapInArrow(search, _RUNS), "leaks-block"))
        shared.destroy()
    every = functools.reduce(DataFrame.unionByName, parts)

    def unite(batches):
        for batch in batches:
            out = []
            for runs in batch["runs"].to_pylist():
                kept: list[dict] = []
                for r in sorted(runs, key=lambda r: (r["first"], r["last"])):
                    if kept and r["first"] <= kept[-1]["last"]:
                        kept[-1] |= {c: max(kept[-1][c], r[c]) for c in ("last", "end")}
                    else:
                        kept.append(dict(r))
                out.append(kept)
            yield pa.RecordBatch.from_arrays([batch["k"], batch["h"], pa.array(out, run_type), batch["items"]], names=["k", "h", "runs", "items"])

    # repeated rows come as one: a row's runs are as many as its text allows
    once = every.distinct().groupBy("k", "h").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    united = materialize(once.mapInArrow(unite, _RUNS), "leaks-hits")
    discard(*parts)
    return united


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans (byte ranges to remove).

    A benchmark of over block_windows windows takes a pass over the documents for each block of them, so that no more than
    one block is on the driver or a worker at a time.
    """
    only, several = _first_two(benchmark, window, block_windows)
    if several is not None:
        hits = _hits_by_block(docs, several, shard_bytes)
        n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
        rows = docs.select(*_key(), n_words.alias("n_words"))
        joined = rows.join(hits.withColumnRenamed("k", "hk").withColumnRenamed("h", "hh"), rows.k.eqNullSafe(F.col("hk")) & (rows.h == F.col("hh")), "left")
        runs, items = F.coalesce("runs", F.array().cast(hits.schema["runs"].dataType)), F.coalesce("items", F.array().cast("array<string>"))
        n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
        spans = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
        return joined.select(
            F.col("k").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), spans.alias("spans"))
    shared = [docs.sparkSession.sparkContext.broadcast(only)]
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for part, _, off, s, e, woff, marked, items in _shards(batches, shared, shard_bytes):
            n = len(off) - 1
            count = np.concatenate([[0], np.cumsum(marked)])
            hit = count[woff[1:]] - count[woff[:-1]]
            names = [sorted(items.get(i, ())) for i in range(n)]
            spans: list[list] = [[] for _ in range(n)]
            if marked.any():
                for a, b in zip(*_spans(s, e, woff, marked), strict=True):
                    i = int(np.searchsorted(off, a, "right")) - 1
                    spans[i].append({"start": int(a - off[i]), "end": int(b - off[i])})
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"], pa.array(np.diff(woff), pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                    pa.array([common.sha256_hex(",".join(x).encode()) for x in names]), pa.array(hit > 0), pa.array(spans, pa.list_(pair)),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs with the spans cut out of text (a line break stands in for each); other columns as they are."""
    only, several = _first_two(benchmark, window, block_windows)
    if several is not None:
        hits = _hits_by_block(docs, several, shard_bytes)
        hits = hits.select(F.col("k").alias("hk"), F.col("h").alias("hh"), F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"))
        # the row is one column, so that its names can't clash with those here
        rows = docs.select(*_key(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        joined = rows.join(hits, rows.k.eqNullSafe(hits.hk) & (rows.h == hits.hh), "left")

        def cut(batches):
            for batch in batches:
                texts = []
                for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                    if spans:
                        data, pieces, here = text.encode("utf-8", "replace"), [], 0
                        for r in spans:
                            pieces.append(data[here : r["start"]])
                            here = r["end"]
                        text = b"\n".join([*pieces, data[here:]]).decode("utf-8", "replace")
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], names=["row", "text"])

        kept = joined.select("row", F.col("row.text").alias("text"), "spans").mapInArrow(cut, T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType())]))
        return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
    shared = [docs.sparkSession.sparkContext.broadcast(only)]

    def run(batches):
        for part, buf, off, s, e, woff, marked, _ in _shards(batches, shared, shard_bytes):
            if not marked.any():
                yield part
                continue
            at = part.schema.get_field_index("text")
            texts = part.column(at).to_pylist()
            starts, ends = _spans(s, e, woff, marked)
            doc = np.searchsorted(off, starts, "right") - 1
            for i in np.unique(doc):
                data, pieces, here = buf[off[i] : off[i + 1]].tobytes(), [], 0
                for a, b in zip(starts[doc == i] - off[i], ends[doc == i] - off[i], strict=True):
                    pieces.append(data[here:a])
                    here = b
                texts[i] = b"\n".join([*pieces, data[here:]]).decode("utf-8", "replace")
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.column(at).type))

    return docs.mapInArrow(run, docs.schema)


ORACLE_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM lowered, lens, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT p.rid, p.i, p.n, b.item_id FROM places p JOIN wins b ON p.n = b.n AND p.g = b.g),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS name FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

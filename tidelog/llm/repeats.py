"""Suffix-array dedup: repeated byte strings found by merging Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes over it also starts earlier. Strings of all corpora can't meet in one task, so
they are dealt out first, by content and without loss:

1. Each LENGTH-byte window belongs to the least of its GRAM-byte hashes (the rightmost of equals): equal windows have
   equal owners at equal distances. Neighbouring windows of one owner make a run. Runs whose owner stands nowhere
   else have no repeated window; of runs with equal bytes all but the earliest go whole.
2. What is left is the earliest run of each content, where its owner has several contents: a repeat that ends or
   begins inside the run. The bytes of these contexts meet by owner in tasks of bounded size.
3. In a task, contexts fall into shards; each shard's suffixes are sorted to LENGTH symbols and give its Burrows-Wheeler
   transform. The transforms are merged by interleave refinement: from the order by h symbols, a stable distribution
   of the merged transform's rows by their symbols gives the order by h + 1, until LENGTH. Nothing is sorted again: only
   the transforms are read. Rows that part at step h + 1 have a common prefix of h, so after LENGTH steps the blocks
   that haven't parted are the repeated strings. All rows of a block but the earliest start a string that goes.

Owners that crowd a batch are salted before the shuffle (a marker row keeps the count right). Windows fall into blocks of
BLOCK distances to their owner; a context none of whose blocks' common cores (LENGTH - BLOCK + 1 bytes) stands in another
context has no repeated window and is left out before step 3, which decides for itself. Where more than CROWDED
contexts of one owner are left, a task would have to hold them all: their windows are reduced to the earliest by
hash instead, with partial sums before the shuffle. There, and where whole runs are told equal in step 1 (owner and run
by 64 bits each), hashes have the last word on bytes.

Nulls: a null text is empty. Rows that share a doc_id count as one document: of equal strings the one of smaller start is
earlier, at one start neither is. A null doc_id is behind all others. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U, discard, materialize

LENGTH = 100
GRAM = 24
SHARDS = 4  # transforms that a task merges
BIN = 2 << 20  # bytes of contexts that a task merges at once, more only where one owner has more
CROWD = 64  # rows of one owner in a batch that make it a hot one
SALTS = 64
BLOCK = 8  # distances to the owner whose windows share a core
CROWDED = 15_000  # contexts of one owner that are merged in a task: as many as a bin holds
SLICE = 4 << 20  # of a long text, handled at once
LAST = (1 << 63) - 1  # stands for a null doc_id
MAP_BYTES = 64 << 20  # of spans that may go to every worker; beyond that they are joined


# ---------------------------------------------------------------- runs


def _runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(row, start in the row, windows, distance to the owner, owner's hash, run's hash) of each run."""
    n = len(buf)
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if n < length:
        return none
    c, q = common.rolling(buf)
    g = common.mix((c[gram:] - c[:-gram]) * q[: n - gram + 1])
    low = U((1 << 24) - 1)
    m = (g & ~low) | (low - np.arange(len(g), dtype=np.uint64))
    width, w = length - gram + 1, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if width > w:
        m = np.minimum(m[: len(m) - (width - w)], m[width - w :])
    owner = (low - (m & low)).astype(np.int64)
    size = np.diff(off)
    step = np.zeros(n + 2, np.int32)
    long = size >= length
    np.add.at(step, off[:-1][long], 1)
    np.add.at(step, off[1:][long] - length + 1, -1)
    valid = np.cumsum(step[: len(owner)]) > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (owner[1:] != owner[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | first[1:]
    at = np.flatnonzero(first)
    if not len(at):
        return none
    count = np.flatnonzero(last) - at + 1
    d = owner[at] - at
    end = at + count + length - 1
    h = common.mix((c[end] - c[at]) * q[at] + count.astype(np.uint64) * U(0x9E3779B97F4A7C15) + d.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
    row = np.searchsorted(off, at, "right") - 1
    return [row, at - off[row], count, d, g[owner[at]], h]


def _slices(part, buf, off):
    """A long text in overlapping slices, others as they are: (bytes, offsets, first row, start of the slice in its row)."""
    if len(off) == 2 and off[1] > SLICE + LENGTH:
        for lo in range(0, int(off[1]) - LENGTH + 1, SLICE):
            hi = min(lo + SLICE + LENGTH - 1, int(off[1]))
            yield buf[lo:hi], np.array([0, hi - lo]), lo
    else:
        yield buf, off, 0


_RUN = "a long, salt int, h long, doc_id long, t int, p int, m int, d int"


def _find_runs(length: int, gram: int):
    def run(batches):
        from xxhash import xxh32_intdigest

        for part, buf, off in common.parts(batches, "text"):
            ids = part["doc_id"].fill_null(LAST).to_numpy()
            t = np.array([xxh32_intdigest(buf[off[i] : off[i + 1]]) for i in range(len(ids))], np.uint32).view(np.int32)
            for piece, poff, base in _slices(part, buf, off):
                row, p, m, d, a, h = _runs(piece, poff, length, gram)
                if not len(row):
                    continue
                names, place, count = np.unique(a, return_inverse=True, return_counts=True)
                hot = count > CROWD
                salt = np.where(hot[place], 1 + (common.mix(ids[row].astype(np.uint64)) % U(SALTS)).astype(np.int64), 0)
                k = int(hot.sum())
                tail = lambda x, v: np.concatenate([x, np.full(k, v, x.dtype)])  # noqa: E731  a marker for each hot owner
                cols = [np.concatenate([a, names[hot]]).view(np.int64), tail(salt, 0).astype(np.int32), tail(h, 0).view(np.int64), tail(ids[row], 0), tail(t[row], 0), tail(p + base, -1).astype(np.int32), tail(m, 0).astype(np.int32), tail(d, 0).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a", "salt", "h", "doc_id", "t", "p", "m", "d"])

    return run


def _tables(batches, key: tuple, most: int):
    """Whole groups of sorted batches, many at a time, as columns (lists for bytes) and where groups begin."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.nbytes < most:
            continue
        edges = _edges(held, key)
        if len(edges) > 1:
            yield held.slice(0, edges[-1]).combine_chunks()
            held = held.slice(edges[-1]).combine_chunks()
    if held is not None:
        yield held.combine_chunks()


def _edges(table: pa.Table, key: tuple) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in key:
        x = table[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _repeated(batches):
    """Rows whose owner stands twice at least; markers go."""
    for table in _tables(batches, ("a", "salt"), 4 << 20):
        edges = _edges(table, ("a", "salt"))
        size = np.repeat(np.diff(np.append(edges, table.num_rows)), np.diff(np.append(edges, table.num_rows)))
        keep = ((size > 1) | (table["salt"].to_numpy() > 0)) & (table["p"].to_numpy() >= 0)
        if keep.any():
            yield from table.filter(pa.array(keep)).drop_columns(["salt"]).to_batches()


# ---------------------------------------------------------------- transforms


def suffix_order(s: np.ndarray, unique: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of s ordered by their first depth symbols, ties by position; unique places differ from all others.

    Prefix doubling: rank by one symbol, then by pairs of ranks, for what isn't single yet.
    """
    n = len(s)
    rank = np.zeros(n, np.int64)
    k = int(unique.sum())
    rank[unique] = np.arange(k)
    rest = np.flatnonzero(~unique)
    order = rest[np.argsort(s[rest], kind="stable")]
    key = s[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    group = np.repeat(first, np.diff(np.append(first, len(order))))
    rank[order] = k + group
    h = 1
    while h < depth and len(order):
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        at = np.flatnonzero(np.repeat(size > 1, size))
        if not len(at):
            break
        pos = order[at]
        behind = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        turn = np.argsort((group[at] << 32) | behind, kind="stable")
        pos, behind, mine = pos[turn], behind[turn], group[at]
        order[at] = pos
        fresh = np.ones(len(at), bool)
        fresh[1:] = (mine[1:] != mine[:-1]) | (behind[1:] != behind[:-1])
        new[at] = fresh
        start = np.flatnonzero(fresh)
        group[at] = np.repeat(at[start], np.diff(np.append(start, len(at))))
        rank[pos] = k + group[at]
        h *= 2
    return np.concatenate([np.flatnonzero(unique), order])


def transform(s: np.ndarray, depth: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix positions, Burrows-Wheeler transform) of texts that each end in the symbol end, ordered to depth symbols."""
    order = suffix_order(s, s == end, depth)
    return order, s[order - 1]  # the text before the first one ends too: s[-1] is an end


def merge_transforms(bwts: list[np.ndarray], ends: list[int], depth: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each row of the merged order, length of the common prefix with the row before, depth at most).

    end is the least symbol; a shard has ends[s] of them, and no two are equal. A step reads the rows whose order it may
    refine: those one symbol before the rows of blocks that the last step parted.
    """
    n, k = sum(map(len, bwts)), sum(ends)
    symbols = np.concatenate(bwts)
    code = np.cumsum(np.bincount(symbols, minlength=end + 1) > 0) - 1  # symbols by rank: a byte where there are 256 at most
    symbols = code.astype(np.uint8 if code[-1] < 256 else np.uint16)[symbols]
    # a row stands in its shard's order; before[r] is the row of the suffix that begins one symbol earlier
    at = np.cumsum([0, *map(len, bwts)])
    before = np.empty(n, np.int32)
    head = np.empty(n, symbols.dtype)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        turn = np.argsort(symbols[lo:hi], kind="stable")
        before[lo + turn] = np.arange(lo, hi, dtype=np.int32)
        head[lo:hi] = symbols[lo:hi][turn]
    # the order by one symbol; blocks are told by the place of their first row, and their rows keep the order of the shards
    rows = np.argsort(head, kind="stable").astype(np.int32)
    place = np.empty(n, np.int32)
    place[rows] = np.arange(n, dtype=np.int32)
    new = np.ones(n, bool)
    new[1:] = head[rows][1:] != head[rows][:-1]
    new[: k + 1] = True  # an end is a block by itself, in the order of the texts
    block = np.empty(n, np.int32)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    block[rows] = np.repeat(first, size)
    alone = np.zeros(n, bool)  # rows that are a block by themselves stay where they are
    alone[rows[first[size == 1]]] = True
    lcp = np.full(n, depth, np.int16)
    lcp[first] = 0
    parted = rows
    for h in range(1, depth):
        # only blocks whose suffixes without the first symbol parted in the step before can part in this one
        parted = parted[(symbols[parted] != 0) & ~alone[before[parted]]]
        if not len(parted):
            break
        parted = parted[np.argsort(symbols[parted], kind="stable")]
        to = before[parted]
        old, source = block[to], block[parted]
        outer = np.ones(len(to), bool)
        outer[1:] = old[1:] != old[:-1]
        inner = outer.copy()
        inner[1:] |= source[1:] != source[:-1]
        whole, piece = np.flatnonzero(outer), np.flatnonzero(inner)
        sizes, pieces = np.diff(np.append(whole, len(to))), np.diff(np.append(piece, len(to)))
        shift = old - np.repeat(whole, sizes)  # of a block all rows are here, one behind the other
        place[to] = shift + np.arange(len(to))
        block[to] = shift + np.repeat(piece, pieces)
        alone[to[piece[pieces == 1]]] = True
        lcp[block[to[inner & ~outer]]] = h
        parted = to[np.repeat(np.add.reduceat(inner, whole, dtype=np.int64) > 1, sizes)]
    z = np.empty(n, np.uint8)
    z[place] = np.repeat(np.arange(len(bwts), dtype=np.uint8), np.diff(at))
    return z, lcp


def repeated_starts(texts: list[bytes], where: np.ndarray, length: int, shards: int = SHARDS) -> list[np.ndarray]:
    """For each text the starts of its strings of the length that another text, or place, of smaller `where` has.

    where: for each text (document, first byte), compared as pairs; a string's place is its text's plus its start.
    """
    n = len(texts)
    share = [range(i, n, shards) for i in range(min(shards, n))]
    end, parts, lines, ends = 0, [], [], []
    for texts_of in share:
        s = np.concatenate([np.concatenate([np.frombuffer(texts[i], np.uint8).astype(np.int16) + 1, [end]]) for i in texts_of]).astype(np.int16)
        order, bwt = transform(s, length, end)
        size = np.array([len(texts[i]) + 1 for i in texts_of])
        text = np.repeat(np.array(list(texts_of)), size)
        start = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
        parts.append(bwt.astype(np.uint16))
        lines.append((text[order], start[order]))
        ends.append(len(texts_of))
    z, lcp = merge_transforms(parts, ends, length, end)
    # rows of a shard come in its order, so each merged row knows its text and start
    text, start = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
    at = np.argsort(z, kind="stable")
    text[at], start[at] = (np.concatenate([x[i] for x in lines]) for i in (0, 1))
    block = np.cumsum(lcp < length)
    many = np.bincount(block)[block] > 1
    block, text, start = block[many], text[many], start[many]
    doc, place = where[text, 0], where[text, 1] + start
    order = np.lexsort((place, doc, block))
    block, text, start, doc, place = block[order], text[order], start[order], doc[order], place[order]
    first = np.ones(len(block), bool)
    first[1:] = block[1:] != block[:-1]
    lead = np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(block))))
    later = (doc > doc[lead]) | (place > place[lead]) if len(block) else np.zeros(0, bool)
    text, start = text[later], start[later]
    by = np.argsort(text, kind="stable")
    return np.split(start[by], np.searchsorted(text[by], np.arange(1, n)))


# ---------------------------------------------------------------- contexts


def _contexts(length: int):
    """The bytes of runs, cut from their documents; rows (doc_id, t, z, runs)."""

    def run(batches):
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor()
        names = ["a", "doc_id", "t", "p", "m", "d", "ctx"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            out, weight = [], 0
            for doc_id, t, z, runs in zip(batch["doc_id"].to_pylist(), batch["t"].to_pylist(), batch["z"], batch["runs"].to_pylist(), strict=True):
                data = unpack.decompress(z.as_buffer())
                for r in runs:
                    out.append((r["a"], doc_id, t, r["p"], r["m"], r["d"], data[r["p"] : r["p"] + r["m"] + length - 1]))
                    weight += len(out[-1][-1])
                if weight > BIN:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, weight = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _shared(table: pa.Table, length: int) -> np.ndarray:
    """Which contexts hold a window whose hash, at its owner and distance, another context holds too."""
    buf, off = common.text_buffer(table["ctx"])
    c, q = common.rolling(buf)
    m, d, a = (table[k].to_numpy().astype(np.int64) for k in ("m", "d", "a"))
    at = np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum()))
    text = np.repeat(np.arange(len(m)), m)
    distance = d[text] - (at - off[text])
    key = common.mix(common.mix((c[at + length] - c[at]) * q[at]) + a[text].view(np.uint64) * U(0x9E3779B97F4A7C15) + distance.astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twin = np.zeros(len(key), bool)
    twin[order[1:]] |= same
    twin[order[:-1]] |= same
    keep = np.zeros(len(m), bool)
    keep[text[twin]] = True
    return keep


def _offsets(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each range, its places): starts[i], starts[i] + 1, ... counts[i] of them."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))


def _cores(length: int):
    """(core's hash, context) for each block of a context's windows."""

    def run(batches):
        for part, buf, off in common.parts(batches, "ctx"):
            m, d, a = (part[k].to_numpy().astype(np.int64) for k in ("m", "d", "a"))
            c, q = common.rolling(buf)
            # the windows of a run stand at distances d, d - 1, ... d - m + 1 before their owner
            low, high = (d - m + 1) // BLOCK, d // BLOCK
            which, j = _offsets(low, high - low + 1)
            # what all windows of a block's distances have in common; it lies inside the context for each block of the run
            start = off[:-1][which] + d[which] - BLOCK * j
            stop = start - (BLOCK - 1) + length
            key = common.mix(common.mix((c[stop] - c[start]) * q[start]) + a[which].view(np.uint64) * U(0x9E3779B97F4A7C15) + j.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part["cid"].take(pa.array(which))], names=["k", "cid"])

    return run


def _windows(length: int):
    """(hash, doc_id, t, start) of each window of each context."""

    def run(batches):
        for part, buf, off in common.parts(batches, "ctx", common.CHUNK // 8):
            m, d, a, p = (part[k].to_numpy().astype(np.int64) for k in ("m", "d", "a", "p"))
            c, q = common.rolling(buf)
            which, x = _offsets(np.zeros(len(m), np.int64), m)
            at = off[:-1][which] + x
            key = common.mix(common.mix((c[at + length] - c[at]) * q[at]) + a[which].view(np.uint64) * U(0x9E3779B97F4A7C15) + (d[which] - x).astype(np.uint64))
            pick = pa.array(which)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part["doc_id"].take(pick), part["t"].take(pick), pa.array(p[which] + x)], names=["w", "doc_id", "t", "start"])

    return run


def _merge_contexts(length: int, shards: int):
    def run(batches):
        for table in _tables(batches, ("a",), BIN):
            table = table.filter(pa.array(_shared(table, length)))
            if not table.num_rows:
                continue
            texts = table["ctx"].to_pylist()
            doc, t, p = (table[k].to_numpy().astype(np.int64) for k in ("doc_id", "t", "p"))
            found = repeated_starts(texts, np.stack([doc, p], 1), length, shards)
            text, start = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
            if not len(start):
                continue
            order = np.lexsort((start, text))
            text, start = text[order], start[order]
            new = np.ones(len(start), bool)
            new[1:] = (text[1:] != text[:-1]) | (np.diff(start) > length)
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(start)) - 1
            i = text[lo]
            cols = [pa.array(doc[i], pa.int64()), pa.array(t[i], pa.int32()), pa.array(p[i] + start[lo], pa.int64()), pa.array(p[i] + start[hi] + length, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "t", "start", "end"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shards: int = SHARDS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, t, start, end): byte spans to remove, overlapping as they come; t tells rows of one doc_id apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") >= length)
    with common.small_batches(docs.sparkSession, 2000):
        runs = docs.mapInArrow(_find_runs(length, gram), _RUN)
        met = runs.repartition("a", "salt").sortWithinPartitions("a", "salt").mapInArrow(_repeated, "a long, h long, doc_id long, t int, p int, m int, d int")
        met = materialize(met, "repeats-runs")
        first = materialize(met.groupBy("a", "h").agg(F.min(F.struct("doc_id", "p", "t", "m", "d")).alias("f")), "repeats-first")
        later = met.join(first.select("a", "h", F.col("f.doc_id").alias("fd"), F.col("f.p").alias("fp")), ["a", "h"]).where((F.col("doc_id") > F.col("fd")) | (F.col("p") > F.col("fp")))
        whole = later.select("doc_id", "t", F.col("p").cast("long").alias("start"), (F.col("p") + F.col("m") + length - 1).cast("long").alias("end"))

        several = first.groupBy("a").count().where("count > 1").select("a")
        open_ = first.join(several, "a").select("a", "f.*").groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "p", "m", "d")).alias("runs"))  # of one text
        texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text").mapInArrow(_zip, "doc_id long, t int, z binary")
        contexts = texts.join(open_, ["doc_id", "t"]).select("doc_id", "t", "z", "runs").mapInArrow(_contexts(length), "a long, doc_id long, t int, p int, m int, d int, ctx binary")
        contexts = materialize(contexts.withColumn("cid", F.monotonically_increasing_id()), "repeats-contexts")
        cores = materialize(contexts.mapInArrow(_cores(length), "k long, cid long"), "repeats-cores")
        twins = cores.groupBy("k").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select("k")
        live = materialize(contexts.join(cores.join(twins, "k").select("cid").distinct(), "cid", "left_semi"), "repeats-live")
        discard(contexts, cores)
        crowds = materialize(live.groupBy("a").count().where(F.col("count") > crowded).select("a"), "repeats-crowds")
        apart = live.join(crowds, "a", "left_anti")
        merged = apart.repartition("a").sortWithinPartitions("a").mapInArrow(_merge_contexts(length, shards), "doc_id long, t int, start long, end long")
        windows = materialize(live.join(crowds, "a", "left_semi").mapInArrow(_windows(length), "w long, doc_id long, t int, start long"), "repeats-windows")
        least = windows.groupBy("w").agg(F.min(F.struct("doc_id", "start")).alias("f"))
        later = windows.join(least, "w").where((F.col("doc_id") > F.col("f.doc_id")) | (F.col("start") > F.col("f.start")))
        crowd = later.select("doc_id", "t", "start", (F.col("start") + length).alias("end"))
        spans = materialize(whole.unionByName(merged).unionByName(crowd), "repeats-spans")
        discard(met, first, live, crowds, windows)
        return spans


def _zip(batches):
    from xxhash import xxh32_intdigest
    from zstandard import ZstdCompressor

    z = ZstdCompressor(level=3)
    for part, buf, off in common.parts(batches, "text"):
        texts = [buf[off[i] : off[i + 1]] for i in range(len(off) - 1)]
        t = np.array([xxh32_intdigest(x) for x in texts], np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(t), pa.array([z.compress(x) for x in texts], pa.binary())], names=["doc_id", "t", "z"])


# ---------------------------------------------------------------- removal


def _union(starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of sorted or unsorted ones."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def _by_document(batches):
    """Spans of (doc_id, t) sorted rows joined to maximal ones, packed."""
    for table in _tables(batches, ("doc_id", "t"), 4 << 20):
        edges = _edges(table, ("doc_id", "t"))
        s, e, doc, t = (table[k].to_numpy() for k in ("start", "end", "doc_id", "t"))
        packed = []
        for lo, hi in zip(edges, np.append(edges[1:], len(s)), strict=True):
            packed.append(np.stack(_union(s[lo:hi], e[lo:hi])).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(doc[edges]), pa.array(t[edges]), pa.array(packed, pa.binary())], names=["doc_id", "t", "spans"])


def _cut(data: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """(remaining bytes, removed, maximal runs removed)."""
    if not spans:
        return data, 0, 0
    s, e = np.frombuffer(spans, "<i8").reshape(2, -1)
    pieces, at = [], 0
    for x, y in zip(s.tolist(), e.tolist(), strict=True):
        pieces.append(data[at:x])
        at = y
    kept = b"".join([*pieces, data[at:]])
    return kept, len(data) - len(kept), len(s)


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _result(ids, texts, spans):
    rows = [_cut(x, y) for x, y in zip(texts, spans, strict=True)]
    cols = [ids, pa.array([len(x) for x in texts], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def cut_repeats(docs: DataFrame, length: int = LENGTH, map_bytes: int = MAP_BYTES, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes, maybe not whole characters) of each row of docs."""
    spans = repeated_spans(docs, length, **options)
    packed = materialize(spans.repartition("doc_id", "t").sortWithinPartitions("doc_id", "t").mapInArrow(_by_document, "doc_id long, t int, spans binary"), "repeats-cuts")
    discard(spans)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = packed.agg(F.sum(F.octet_length("spans") + 16)).first()[0] or 0
    if size <= map_bytes:
        shared = docs.sparkSession.sparkContext.broadcast([b.serialize().to_pybytes() for b in packed.toArrow().to_batches()])
        schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int32()), ("spans", pa.binary())])

        def run(batches):
            from xxhash import xxh32_intdigest

            known: dict = {}
            for x in shared.value:
                b = pa.ipc.read_record_batch(x, schema)
                known |= dict(zip(zip(b["doc_id"].to_pylist(), b["t"].to_pylist(), strict=True), b["spans"].to_pylist(), strict=True))
            for part, buf, off in common.parts(batches, "text"):
                data = buf.tobytes()
                texts = [data[off[i] : off[i + 1]] for i in range(len(off) - 1)]
                keys = part["doc_id"].fill_null(LAST).to_pylist()
                yield _result(part["doc_id"], texts, [known.get((k, int(np.uint32(xxh32_intdigest(x)).view(np.int32)))) for k, x in zip(keys, texts, strict=True)])

        return docs.mapInArrow(run, _CUT)

    def tag(batches):
        from xxhash import xxh32_intdigest

        for part, buf, off in common.parts(batches, "text"):
            texts = [buf[off[i] : off[i + 1]].tobytes() for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["doc_id"].fill_null(LAST), pa.array(np.array([xxh32_intdigest(x) for x in texts], np.uint32).view(np.int32)), pa.array(texts, pa.binary())], names=["own", "doc_id", "t", "data"])

    def join(batches):
        for b in batches:
            yield _result(b["own"], b["data"].to_pylist(), b["spans"].to_pylist())

    tagged = docs.mapInArrow(tag, "own long, doc_id long, t int, data binary")
    return tagged.join(packed, ["doc_id", "t"], "left").select("own", "data", "spans").mapInArrow(join, _CUT)


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Document frequencies of all shingle hashes, of all documents, are counted in a table of cells that is sized by
   the corpus (LOAD shingles a cell, 2^MOST_BITS cells at most); the cell's count class (then the hash) is the
   global order, rare first. Any fixed order gives right results.
2. Every document gets its set size, a 128-bit digest of its set, its prefix (the first n - ceil(t n) + 1 shingles
   in the order), a 128-bit parity signature and a strong one of about n bits. Documents of one digest are one class
   from here on.
3. Prefix entries of classes meet by shingle; those of hot cells are dealt out by salts. Two classes of a shingle are
   a candidate pair if sizes allow the similarity (length filter), if the shingles around the common place allow the
   overlap (positional filter), and if their signatures differ in no more bits than the sets may differ in shingles
   (suffix filter: a bound on the differences of all that is left), first the short ones, then the strong ones.
4. Groups of up to SMALL classes give all their candidates at once. Larger ones (and salted ones) give only each
   class's nearest candidate or a spanning forest first; those pairs, and each class's nearest of small groups, are
   verified and contracted. Then the pairs of small groups that still join two components follow, and all candidates
   between different components of the larger groups, dealt out by the exact number of their members and compared by
   signatures of MIDDLE bits as well before they leave their group. So a
   group of near copies yields about as many pairs as members, and no link between components is lost.
5. Each pair is verified once on the full sets. Components of the links give each document's class id.

Nulls: a null or empty text, or one without words, has an empty set, is linked with nothing and is its own
component (component_id is its doc_id). Rows with a null doc_id take part; they don't give a component its id
unless all its ids are null. Repeated rows are one class. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U, discard, materialize
from .components import components

LOAD = 32  # shingles a cell of the count table, on average, by which it is sized
LEAST_BITS, MOST_BITS = 16, 24  # of the count table: one byte a cell goes to every worker, four while it counts
HASHES = 1 << 21  # that are gathered before they are counted
BLOCKS = 64  # at most, in which the cells are summed
SPLIT = 512  # members of a frequent shingle that meet in one group of the first wave
BLOCK = 8192  # and in the second, whose groups are dealt out in pairs of blocks
TILE = 512  # rows that are compared with as many at once
WHOLE = 1024  # rows of a larger group that are compared all with all to find their forest
FAR = 1 << 14  # no distance of signatures
MIDDLE = 1024  # bits of a strong signature, at least; those that the second wave's groups compare
SMALL = 32  # members of groups that are compared many groups at once
PIECE = 1 << 18  # bytes of text that are hashed at once
PAIR_BYTES = PIECE  # of texts whose pairs are verified at once
MAP_IDS = 2_000_000  # ids that may go to every worker; beyond that they are joined


def sets_of(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row, one after another, and the row offsets."""
    s, e, woff = common.words(buf, off, common.NOT_SPACE)
    h, soff = common.shingle_hashes(common.word_hashes(buf, s, e) if len(s) else np.zeros(0, np.uint64), woff, k)
    row = np.repeat(np.arange(len(off) - 1), np.diff(soff))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.searchsorted(row[keep], np.arange(len(off)))


def _bits(docs: DataFrame) -> int:
    """Bits of the count table: some LOAD shingles a cell, taking six bytes of text for one."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(1 + total / 6 / LOAD))))


def _cell_counts(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """Document frequencies by cell (hash modulo 2^bits), over all documents."""
    blocks = min(BLOCKS, max(1, (1 << bits) >> LEAST_BITS))
    per = (1 << bits) // blocks

    def packed(which, counts):
        from zstandard import ZstdCompressor

        z = ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([z.compress(x.tobytes()) for x in counts], pa.binary())], names=["block", "cells"])

    def unpacked(cells: bytes) -> np.ndarray:
        from zstandard import ZstdDecompressor

        return np.frombuffer(ZstdDecompressor().decompress(cells), "<u4")

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        held: list[np.ndarray] = []

        def add():
            cell, times = np.unique(np.concatenate(held), return_counts=True)
            total[cell] += times.astype(np.uint32)
            held.clear()

        for _, buf, off in common.parts(batches, "text", PIECE):
            held.append((sets_of(buf, off, k)[0] & U((1 << bits) - 1)).astype(np.uint32))
            if sum(map(len, held)) >= HASHES:
                add()
        if held:
            add()
        yield packed(range(blocks), [total[i * per : (i + 1) * per] for i in range(blocks)])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch["block"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                x = unpacked(cells)
                sums[block] = np.minimum(sums[block].astype(np.uint64) + x, U(2**32 - 1)).astype(np.uint32) if block in sums else x
        if sums:
            yield packed(list(sums), sums.values())

    schema = "block int, cells binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition(blocks, "block").mapInArrow(add, schema).collect()
    out = np.zeros(1 << bits, np.uint32)
    for r in parts:
        out[r.block * per : (r.block + 1) * per] = unpacked(r.cells)
    return out


def _strong(h: np.ndarray, off: np.ndarray) -> list[bytes]:
    """As the signature, of about as many bits as the set has shingles: the next power of two, MIDDLE at least.

    One of 2m bits folds to that of m bits by xor of its halves, so those of sets of unlike sizes compare.
    """
    n = np.diff(off)
    bits = 1 << np.maximum(MIDDLE.bit_length() - 1, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    row = np.repeat(np.arange(len(n)), n)
    start = np.concatenate([[0], np.cumsum(bits)])
    at = start[:-1][row] + ((h >> U(24)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8)
    data = np.packbits(odd, bitorder="little").tobytes()
    return [data[start[i] // 8 : start[i + 1] // 8] for i in range(len(n))]


def _signature(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of how many of a set's hashes fall on each of 128 bits."""
    bit = (h >> U(50)) & U(127)
    out = []
    for half in (0, 1):
        value = np.where((bit >> U(6)) == half, U(1) << (bit & U(63)), U(0))
        c = np.concatenate([[U(0)], np.bitwise_xor.accumulate(value)]) if len(value) else np.zeros(1, np.uint64)
        out.append((c[off[1:]] ^ c[off[:-1]]).view(np.int64))
    return out[0], out[1]


_ROWS = "doc_id long, n long, c binary, prefix array<long>, salts array<int>, s1 long, s2 long, strong binary, middle binary"


def _describe(docs: DataFrame, k: int, percent: int, bits: int | None, split: int) -> DataFrame:
    bits = _bits(docs) if bits is None else bits
    cells = _cell_counts(docs, k, bits)
    order = np.minimum(255, np.round(8 * np.log2(1 + cells.astype(np.float32)))).astype(np.uint8)
    most = cells.mean() + 6 * math.sqrt(cells.mean())  # what many rare shingles may add up to
    hot = np.flatnonzero(cells > most + split).astype(np.int64)
    salts = np.ceil((cells[hot] - most) / split).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((order, hot, salts))  # 1 to 13 bytes a cell

    def run(batches):
        from xxhash import xxh3_128_digest

        order, hot, hot_salts = shared.value
        for part, buf, off in common.parts(batches, "text", PIECE):
            h, soff = sets_of(buf, off, k)
            n = np.diff(soff)
            cell = (h & U((1 << bits) - 1)).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            ranked = np.lexsort((h, order[cell], row))
            size = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            poff = np.concatenate([[0], np.cumsum(size)])
            at = ranked[np.repeat(soff[:-1] - poff[:-1], size) + np.arange(poff[-1])]
            salt = np.ones(len(at), np.int32)
            if len(hot) and len(at):
                place = np.minimum(np.searchsorted(hot, cell[at]), len(hot) - 1)
                salt = np.where(hot[place] == cell[at], hot_salts[place], 1).astype(np.int32)
            has = np.zeros(len(n), bool)  # rows without salted entries name no salts
            has[np.repeat(np.arange(len(n)), size)[salt > 1]] = True
            salt, salted = salt[np.repeat(has, size)], np.concatenate([[0], np.cumsum(np.where(has, size, 0))])
            s1, s2 = _signature(h, soff)
            digests = [xxh3_128_digest(h[soff[i] : soff[i + 1]].tobytes()) for i in range(len(n))]
            strong = _strong(h, soff)
            middle = [None if 8 * len(x) == MIDDLE else _folded(x, MIDDLE // 64).tobytes() for x in strong]
            to = pa.array(poff, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(to, pa.array(h[at].view(np.int64))), pa.ListArray.from_arrays(pa.array(salted, pa.int32()), pa.array(salt)), pa.array(s1), pa.array(s2), pa.array(strong, pa.binary()), pa.array(middle, pa.binary())],
                names=["doc_id", "n", "c", "prefix", "salts", "s1", "s2", "strong", "middle"],
            )

    return docs.mapInArrow(run, _ROWS)


# ---------------------------------------------------------------- candidates


def _met(batches):
    """Prefix entries whose shingle another class has in its prefix too; frequent ones may be in other salts."""
    for table in _tables(batches, ("token", "salt"), pieces=True):
        size = np.bincount(table["group"])
        keep = (size[table["group"]] > 1) | (table["salts"] > 1)
        if keep.any():
            yield pa.RecordBatch.from_pydict({k: v[keep] for k, v in table.items() if k != "group"})


def _allowed(a: dict, b: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs of rows of a and b, as numpy broadcasts them, pass the filters; their signatures' distances)."""
    na, nb, at_a, at_b = a["n"], b["n"], a["pos"], b["pos"]
    need = (percent * (na + nb) + percent + 99) // (100 + percent)  # the least overlap of a link
    ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(at_a, at_b) + 1 + np.minimum(na - at_a - 1, nb - at_b - 1) >= need)
    ok &= a["cid"] != b["cid"]
    if "label" in a:
        ok &= a["label"] != b["label"]
    apart = sum(np.bitwise_count(a[s].view(np.uint64) ^ b[s].view(np.uint64)).astype(np.int16) for s in ("s1", "s2"))
    return ok & (apart <= na + nb - 2 * need), apart


def _middling(a: dict, b: dict, percent: int) -> np.ndarray:
    """Which pairs' middle signatures differ in no more bits than linked sets may in shingles."""
    ok = np.zeros(len(a["n"]), bool)
    for lo in range(0, len(ok), 1 << 16):
        x, y = (np.frombuffer(b"".join(v["middle"][lo : lo + (1 << 16)]), np.uint64).reshape(-1, MIDDLE // 64) for v in (a, b))
        n = a["n"][lo : lo + (1 << 16)].astype(np.int64) + b["n"][lo : lo + (1 << 16)]
        ok[lo : lo + (1 << 16)] = np.bitwise_count(x ^ y).sum(1) <= n - 2 * ((percent * n + percent + 99) // (100 + percent))
    return ok


def _tiles(n: np.ndarray, m: np.ndarray, percent: int, same: bool):
    """Slices of rows sorted by size that the length filter lets meet."""
    for i in range(0, len(n), TILE):
        for j in range(i if same else 0, len(m), TILE):
            if 100 * n[min(i + TILE, len(n)) - 1] >= percent * m[j] and 100 * m[min(j + TILE, len(m)) - 1] >= percent * n[i]:
                yield slice(i, i + TILE), slice(j, j + TILE)


def _tree(apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a least spanning forest over pairs nearer than FAR, grown from row after row."""
    n = len(apart)
    out, near, via = np.zeros(n, bool), np.full(n, FAR, apart.dtype), np.zeros(n, np.int64)
    ends: list[tuple[int, int]] = []
    for _ in range(n):
        i = int(np.where(out, FAR + 1, near).argmin())
        if near[i] < FAR:
            ends.append((int(via[i]), i))
        out[i] = True
        closer = apart[i] < near
        near[closer], via[closer] = apart[i][closer], i
    pairs = np.array(ends, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _candidates(tables, percent: int, dealt: bool = False, trees: bool = False):
    """(large, a, b, apart): arrays of the pairs that pass the filters within the groups of tables.

    With trees, groups of over SMALL rows (large) give only the edges of a least spanning forest of each WHOLE rows,
    in order of size, and else the pairs of tiles. Small groups are compared all at once, row by row with the row k places on. Where groups are dealt,
    rows of one salt meet only those of the other. Where rows have a middle signature, pairs must pass by it as well.
    """

    def compare(a, b):
        ok, apart = _allowed(a, b, percent)
        if dealt:
            ok &= (a["salt"] != b["salt"]) | (a["x"] == a["y"])
        return ok, apart

    for table in tables:
        order = np.lexsort((table["n"], table["group"]))
        t = {k: v[order] for k, v in table.items()}
        edges = np.flatnonzero(np.concatenate([[True], t["group"][1:] != t["group"][:-1], [True]]))
        size = np.diff(edges)
        small = np.repeat(size <= SMALL, size)
        behind = np.repeat(edges[1:], size)  # where each row's group ends
        row = np.flatnonzero(small)
        for k in range(1, int(size[size <= SMALL].max(initial=1))):
            row = row[row + k < behind[row]]
            if not len(row):
                break
            a, b = ({c: v[row + d] for c, v in t.items()} for d in (0, k))
            ok, apart = compare(a, b)
            if "middle" in t:
                ok[ok] = _middling({c: v[ok] for c, v in a.items()}, {c: v[ok] for c, v in b.items()}, percent)
            if ok.any():
                yield False, a["cid"][ok], b["cid"][ok], apart[ok]
        for g in np.flatnonzero(size > SMALL):
            whole = {c: v[edges[g] : edges[g + 1]] for c, v in t.items()}
            if trees:
                for lo in range(0, size[g], WHOLE):
                    some = {c: v[lo : lo + WHOLE] for c, v in whole.items()}
                    ok, apart = compare({c: v[:, None] for c, v in some.items()}, {c: v[None, :] for c, v in some.items()})
                    i, j = _tree(np.where(ok, apart, FAR).astype(np.int16))
                    yield True, some["cid"][i], some["cid"][j], apart[i, j]
                continue
            for i, j in _tiles(whole["n"], whole["n"], percent, True):
                a, b = {c: v[i][:, None] for c, v in whole.items()}, {c: v[j][None, :] for c, v in whole.items()}
                ok, apart = compare(a, b)
                if i == j:
                    ok = np.triu(ok, 1)
                r, c = np.nonzero(ok)
                if "middle" in t and len(r):
                    near = _middling({x: whole[x][i][r] for x in ("n", "middle")}, {x: whole[x][j][c] for x in ("n", "middle")}, percent)
                    r, c = r[near], c[near]
                if len(r):
                    yield True, whole["cid"][i][r], whole["cid"][j][c], apart[r, c]


def _tables(batches, keys: tuple, most: int = 50_000, pieces: bool = False):
    """Whole groups of sorted batches, many at a time, as numpy columns with a running number in "group".

    With pieces, a group of over 8 * most rows comes in several, each of over SMALL rows.
    """
    held: dict | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch[n].to_numpy(zero_copy_only=False) for n in batch.schema.names}
        held = cols if held is None else {n: np.concatenate([held[n], cols[n]]) for n in cols}
        if len(held["n"]) < most:
            continue
        change = np.zeros(len(held["n"]), bool)
        for k in keys:
            change[1:] |= held[k][1:] != held[k][:-1]
        last = np.flatnonzero(change)
        cut = last[-1] if len(last) else len(change) - SMALL - 1 if pieces and len(change) >= 8 * most else 0
        if cut:
            done = {n: v[:cut] for n, v in held.items()}
            held = {n: v[cut:] for n, v in held.items()}
            yield done | {"group": np.cumsum(change[:cut])}
    if held is not None:
        change = np.zeros(len(held["n"]), bool)
        for k in keys:
            change[1:] |= held[k][1:] != held[k][:-1]
        yield held | {"group": np.cumsum(change)}


_FOUND = "kind int, a long, b long, apart int, token long, n int, pos int, s1 long, s2 long"
_SMALL_PAIR, _LARGE_PAIR, _ENTRY = 0, 1, 2  # kinds of rows


def _unique(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (a, b, apart) with a < b, each once."""
    a, b, apart = (np.concatenate(x) for x in zip(*held, strict=True))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b, apart = a[order], b[order], apart[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], apart[new]


def _first_wave(percent: int, most: int = 200_000):
    """All pairs of small groups, the forests of larger ones, and the latter's entries for the second wave."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in _FOUND.split(", ")]

    def rows(kind: int, cols: dict) -> pa.RecordBatch:
        many = len(cols["a"])
        cols["kind"] = np.full(many, kind)
        return pa.RecordBatch.from_arrays([pa.array(cols[c]).cast(t) if c in cols else pa.nulls(many, t) for c, t in zip(names, types, strict=True)], names=names)

    def run(batches):
        held: dict[bool, list] = {False: [], True: []}
        entries: list[pa.RecordBatch] = []

        def pairs(large):
            a, b, apart = _unique(held[large])
            held[large] = []
            return rows(_LARGE_PAIR if large else _SMALL_PAIR, {"a": a, "b": b, "apart": apart})

        def tables():
            for t in _tables(batches, ("token", "salt"), pieces=True):
                size = np.bincount(t["group"])
                left = (size[t["group"]] > SMALL) | (t["salts"] > 1)
                if left.any():
                    entries.append(rows(_ENTRY, {"a": t["cid"][left]} | {k: t[k][left] for k in ("token", "n", "pos", "s1", "s2")}))
                yield t

        for large, *found in _candidates(tables(), percent, trees=True):
            yield from entries
            entries.clear()
            held[large].append(found)
            if sum(len(x[0]) for x in held[large]) > most:
                yield pairs(large)
        yield from entries
        for large in (False, True):
            if held[large]:
                yield pairs(large)

    return run


def _across(percent: int, most: int = 200_000):
    """All candidates of different components in a group: salt x against salt y, or within one."""

    def run(batches):
        held: list[tuple] = []

        def pairs():
            a, b, _ = _unique(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for _, *found in _candidates(_tables(batches, ("token", "x", "y")), percent, dealt=True):
            held.append(found)
            if sum(len(x[0]) for x in held) > most:
                yield pairs()
        if held:
            yield pairs()

    return run


# ---------------------------------------------------------------- verification


def _texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, packed text) of the classes in wanted(cid, c, doc_id), each from one of its documents."""
    shared = None
    if wanted.count() <= MAP_IDS:
        ids = np.array(sorted({r.doc_id for r in wanted.where("doc_id is not null").select("doc_id").toLocalIterator()}), np.int64)
        shared = docs.sparkSession.sparkContext.broadcast(ids)
    else:
        docs = docs.join(wanted.select("doc_id").distinct(), docs.doc_id.eqNullSafe(wanted.doc_id), "left_semi")

    def only(batches):
        import pyarrow.compute as pc

        known = pa.array(shared.value)
        for batch in batches:
            yield batch.filter(pc.or_(pc.is_in(batch["doc_id"], value_set=known), pc.is_null(batch["doc_id"])))

    def pack(batches):
        from xxhash import xxh3_128_digest
        from zstandard import ZstdCompressor

        z = ZstdCompressor(level=1)
        for _, buf, off in common.parts(only(batches) if shared else batches, "text", PIECE):
            h, soff = sets_of(buf, off, k)
            n = len(off) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxh3_128_digest(h[soff[i] : soff[i + 1]].tobytes()) for i in range(n)], pa.binary()), pa.array([z.compress(buf[off[i] : off[i + 1]].tobytes()) for i in range(n)], pa.binary())],
                names=["c", "z"],
            )

    packed = docs.mapInArrow(pack, "c binary, z binary").groupBy("c").agg(F.first("z").alias("z"))
    return materialize(packed.join(wanted.select("c", "cid"), "c").select("cid", "z"), "ngram-texts", "none")


def _folded(sig: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(sig, np.uint64)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _near_enough(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose strong signatures differ in no more bits than linked sets may in shingles."""

    def run(batches):
        for batch in batches:
            apart = []
            for x, y in zip(batch["xs"].to_pylist(), batch["ys"].to_pylist(), strict=True):
                size = min(len(x), len(y)) // 8
                apart.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()))
            n = batch["xn"].to_numpy() + batch["yn"].to_numpy()
            apart = np.array(apart, np.int64)
            ok = apart <= n - 2 * ((percent * n + percent + 99) // (100 + percent))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["kind"], pa.array(apart)], names=["a", "b", "kind", "apart"]).filter(pa.array(ok))

    side = lambda k, p: classes.select(F.col("cid").alias(k), F.col("strong").alias(f"{p}s"), F.col("n").alias(f"{p}n"))
    return pairs.select("a", "b", "kind").join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(run, "a long, b long, kind int, apart long")


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    texts = _texts(docs, classes.join(members, "cid", "left_semi").select("cid", "c", "doc_id"), k)

    def run(batches):
        from zstandard import ZstdDecompressor

        z = ZstdDecompressor()

        def similar(data: list[bytes]) -> list[bool]:
            off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
            h, soff = sets_of(np.frombuffer(b"".join(data), np.uint8), off, k)
            keep = []
            for i in range(0, len(data), 2):
                a, b = h[soff[i] : soff[i + 1]], h[soff[i + 1] : soff[i + 2]]
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            return keep

        for batch in batches:
            keep, data, weight = [], [], 0
            for x, y in zip(batch["za"], batch["zb"], strict=True):
                data += [z.decompress(x.as_buffer()), z.decompress(y.as_buffer())]
                weight += len(data[-1]) + len(data[-2])
                if weight >= PAIR_BYTES:
                    keep += similar(data)
                    data, weight = [], 0
            keep += similar(data) if data else []
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("cid").alias("a"), F.col("z").alias("za")), "a")
    both = left.join(texts.select(F.col("cid").alias("b"), F.col("z").alias("zb")), "b")
    links = materialize(both.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long"), "ngram-links")
    discard(texts)
    return links


# ---------------------------------------------------------------- the join


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80, bits: int | None = None, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, class_size, n_links_used and component_id of each row of docs(doc_id, text, ...).

    class_size counts the rows with the row's set; n_links_used those verified links of its class that the search needed
    (links inside what was already one component are not looked for).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with common.small_batches(docs.sparkSession):
        rows, classes, links, roots = _search(docs, k, percent, bits, split, block)
    degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").count()
    known = classes.select("c", "cid", "doc_id", "size").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = known.join(least, "root").join(degree, "cid", "left").select("c", "size", "component_id", "count")
    return rows.select("doc_id", "n", "c").join(found, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("size", F.lit(1)).alias("class_size"), F.coalesce("count", F.lit(0)).alias("n_links_used"))


def _search(docs: DataFrame, k: int, percent: int, bits: int | None, split: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows with their sets' sizes and digests, the classes, the links that tell the components, and each linked class's root."""
    rows = materialize(_describe(docs, k, percent, bits, split), "ngram-rows")
    firsts = [F.first(c).alias(c) for c in ("n", "prefix", "salts", "s1", "s2", "strong", "middle")]
    grouped = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("size"), *firsts)
    full = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")
    slim = materialize(rows.select("doc_id", "n", "c"), "ngram-sets")
    discard(rows)
    zipped = F.posexplode(F.when(F.size("salts") > 0, F.arrays_zip("prefix", "salts")).otherwise(F.transform("prefix", lambda t: F.struct(t.alias("prefix"), F.lit(1).alias("salts"))))).alias("pos", "e")
    entries = full.select("cid", "n", zipped).select(
        F.col("e.prefix").alias("token"), F.pmod(F.xxhash64("cid", "e.prefix"), F.col("e.salts").cast("long")).cast("int").alias("salt"), F.col("e.salts").alias("salts"), "cid", F.col("n").cast("int").alias("n"), "pos")
    met = materialize(_dealt(entries, "token", "salt").mapInArrow(_met, entries.schema), "ngram-met")
    signed = materialize(met.join(full.select("cid", "s1", "s2"), "cid"), "ngram-signed")
    discard(met)

    found = materialize(_dealt(signed, "token", "salt").mapInArrow(_first_wave(percent), _FOUND), "ngram-found")
    discard(signed)
    pairs = found.where(F.col("kind") != _ENTRY).groupBy("a", "b").agg(F.min("kind").alias("kind"))
    near = materialize(_near_enough(full, pairs, percent), "ngram-near")
    small = near.where(F.col("kind") == _SMALL_PAIR)
    mates = small.select("a", "b", "apart").unionByName(small.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    best = mates.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b"))
    first = materialize(best.unionByName(near.where(F.col("kind") == _LARGE_PAIR).select("a", "b")).distinct(), "ngram-first")
    ids = materialize(full.select("cid", "c", "doc_id", "size"), "ngram-ids")
    links = _verify(docs, ids, first, k, percent)
    roots = components(links, "ngram-first")

    label = lambda on: F.coalesce(F.col(f"{on}_root"), F.col(on))
    root = lambda on: roots.select(F.col("node").alias(on), F.col("root").alias(f"{on}_root"))
    open_ = small.select("a", "b").join(root("a"), "a", "left").join(root("b"), "b", "left").where(label("a") != label("b")).select("a", "b")
    labelled = found.where(F.col("kind") == _ENTRY).select(F.col("a").alias("cid"), "token", "n", "pos", "s1", "s2").join(root("cid"), "cid", "left").withColumn("label", label("cid")).drop("cid_root")
    labelled = materialize(labelled.join(full.select("cid", F.coalesce("middle", "strong").alias("middle")), "cid"), "ngram-labelled")
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").select("token", F.ceil(F.col("members") / F.lit(block)).cast("int").alias("salts"))
    # the blocks of a token meet in pairs: a row goes to each pair that holds its block
    salted = labelled.join(mixed, "token").withColumn("salt", F.pmod(F.xxhash64("cid", "token"), F.col("salts").cast("long")).cast("int"))
    dealt = salted.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("x", F.least("salt", "o")).withColumn("y", F.greatest("salt", "o")).drop("o", "salts")
    across = materialize(_dealt(dealt, "token", "x", "y").mapInArrow(_across(percent), "a long, b long"), "ngram-across")
    more = across.distinct().join(near.select("a", "b"), ["a", "b"], "left_anti").withColumn("kind", F.lit(_LARGE_PAIR))
    second = materialize(open_.unionByName(_near_enough(full, more, percent).select("a", "b")).join(first, ["a", "b"], "left_anti"), "ngram-second")
    discard(labelled, roots, found, near, across, first, full)
    links = links.unionByName(_verify(docs, ids, second, k, percent))
    discard(second)
    return slim, ids, links, components(links, "ngram-all")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "n")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but for near copies: of each component only the row whose doc_id is its id (once, if repeated).

    Rows with a null doc_id can't be told apart and all stay.
    """
    found = similar_components(docs, k, percent).where("n_shingles > 0")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


ORACLE_SQL = r"""
WITH RECURSIVE lowered AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM lowered),
grams AS (SELECT rid, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.rid AS x, b.rid AS y FROM grams a JOIN grams b ON a.g = b.g AND a.rid < b.rid AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(x, y) AS (SELECT rid, rid FROM lowered UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
ids AS (SELECT r.x AS rid, min(l.doc_id) AS component_id FROM reach r JOIN lowered l ON l.rid = r.y GROUP BY r.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN ids USING (rid)
"""

"""Line dedup by distinct-site spread.

A line (stripped of spaces, tabs and carriage returns) that stands on many distinct sites is boilerplate and is
cut from every document. HyperLogLog sketches of the sites, one per line hash, merge by aggregation on both
sides of the shuffle. An estimate well off the threshold decides by itself; lines within ERRORS standard errors
(and at least one site) of it get exact distinct counts, so that the outcome is that of exact counting.

The cut itself is a map over documents while the boilerplate has at most MAP_HASHES lines (8 bytes each, counted
first); beyond that, the positions to cut are joined by line hash, gathered per document and joined to it.

Nulls: a null text stays null and has no lines; a null source is one site of its own. Empty lines are never
boilerplate. Repeated rows are cut alike. A document all of whose lines go keeps an empty text. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_SITES = 10
FEWEST = 3  # sites, however few a corpus has
LG_K = 12  # sketches of 2^LG_K registers at most; few sites take a few bytes
ERRORS = 4
MAP_HASHES = 1_000_000
STRIP = " \t\r"


def _site():
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))


def least_sites(docs: DataFrame) -> int:
    """A threshold for corpora of few sites: half of the measured ones, FEWEST at least and MIN_SITES at most."""
    sites = docs.select(_site().alias("site")).distinct().count()
    return min(MIN_SITES, max(FEWEST, -(-sites // 2)))


def _lines(docs: DataFrame, *keys) -> DataFrame:
    """(keys, site, pos, h): one row a line that isn't empty."""
    lines = docs.select(*keys, _site().alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = F.btrim("line", F.lit(STRIP))
    return lines.where(bare != "").select(*keys, "site", "pos", F.xxhash64(bare).alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Hashes (h) of the lines that stand on min_sites distinct sites or more."""
    lines = _lines(docs)
    error = ERRORS * 1.04 / 2 ** (lg_k / 2)
    band = max(1.0, min_sites * error)
    sites = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    spread = sites.select("h", F.hll_sketch_estimate("sketch").alias("n"))
    candidates = materialize(spread.where(F.col("n") >= min_sites - band), "line-spread")
    sure = candidates.where(F.col("n") > min_sites + band).select("h")
    near = candidates.where(F.col("n") <= min_sites + band).select("h")
    exact = lines.join(near, "h", "left_semi").select("h", "site").distinct().groupBy("h").count().where(F.col("count") >= min_sites).select("h")
    return materialize(sure.unionByName(exact), "boilerplate")


def _cut_by_map(docs: DataFrame, hashes: DataFrame, counted: bool) -> DataFrame:
    gone = np.sort(np.array([r.h for r in hashes.collect()], np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(gone)

    def run(batches):
        from xxhash import xxh64_intdigest

        drop = set(shared.value.astype(np.uint64).tolist())
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            at = batch.schema.get_field_index("text")
            texts, counts = batch.column(at).to_pylist(), []
            for i, text in enumerate(texts):
                if text is None:
                    counts.append((0, 0))
                    continue
                lines = text.split("\n")
                keys = [x.strip(STRIP).encode("utf-8", "replace") for x in lines]
                kept = [x for x, k in zip(lines, keys, strict=True) if not k or xxh64_intdigest(k, 42) not in drop]  # 42: the seed of F.xxhash64
                counts.append((len(lines), len(lines) - len(kept)))
                if len(kept) < len(lines):
                    texts[i] = "\n".join(kept)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if not counted:
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                continue
            n, k = (pa.array(c, pa.int64()) for c in (zip(*counts, strict=True) if counts else ([], [])))
            yield pa.RecordBatch.from_arrays([*columns, n, k], names=[*batch.schema.names, "_n_lines", "_n_removed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, _n_lines long, _n_removed long" if counted else fields)


def _cut_by_join(docs: DataFrame, hashes: DataFrame, counted: bool) -> DataFrame:
    """Rows of one doc_id and text are cut alike, so those two (the text by its hash) are the key."""
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_t")]
    gone = _lines(docs.select(*keys, "text", "source"), "_id", "_t").join(hashes, "h").groupBy("_id", "_t").agg(F.collect_set("pos").alias("gone"))
    # the row is one column, so that its names can't clash with those here
    joined = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(gone, ["_id", "_t"], "left")
    text = F.col("row")["text"]
    parts = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n")
    counts = [F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("_n_lines"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("_n_removed")]
    return joined.select(*[F.when(F.col("gone").isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], *(counts if counted else []))


def cut_lines(docs: DataFrame, min_sites: int = MIN_SITES, map_hashes: int = MAP_HASHES, counted: bool = True) -> DataFrame:
    """docs with boilerplate lines cut from text and, if counted, _n_lines and _n_removed behind the other columns.

    Where docs has columns of those two names, they give way to the counts; not counted, all columns stay.
    """
    hashes = boilerplate(docs.select("source", "text"), min_sites)
    docs = docs.drop("_n_lines", "_n_removed") if counted else docs
    return (_cut_by_map if hashes.count() <= map_hashes else _cut_by_join)(docs, hashes, counted)


def digest(cut: DataFrame) -> DataFrame:
    return cut.select(F.col("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce('s' || source, 'null') AS site FROM documents),
lines AS (
  SELECT rid, site, i, parts[i] AS line, trim(parts[i], chr(32) || chr(9) || chr(13)) AS bare
  FROM (SELECT rid, site, string_split(text, chr(10)) AS parts FROM docs WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS t(i)),
boilerplate AS (SELECT bare FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 10),
kept AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE b.bare IS NOT NULL) AS n_removed,
         string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.bare IS NULL) AS text
  FROM lines LEFT JOIN boilerplate b USING (bare) GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

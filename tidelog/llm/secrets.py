"""Secret scans: patterns, and a battery of randomness tests on the strings the patterns don't know.

Maximal runs of [A-Za-z0-9+/_=-] are split behind every "=" that isn't padding at their end (the name in NAME=value, the
value that follows), and each piece of MIN_RUN characters or more is tested. Its encoding is inferred as the
smallest known alphabet that holds it (hex in either case, base 32, letters and digits, base 64 in either
form). Under the hypothesis that it is random in that encoding, three tests look for deviations: chi-squared
uniformity of the alphabet, runs above and below its middle, and lag-1 serial correlation; the least of the three
p-values (Bonferroni) is the battery's. Under the opposite hypothesis, that it is text as this corpus has it, the
likelihood ratio of the uniform against a first-order character model of all documents bounds the p-value (Markov's
inequality). Benjamini-Hochberg control decides twice over the runs of all documents, by stratum of length since long
runs are easier to tell: which runs the battery sets aside as not random (at most VETO_FDR of those random in
truth), and which of the others are reported (at most FDR of those text in truth).

Passes: one that counts character pairs (a table of fixed size), one that scans, then small tables only.
A null or empty text has no spans. Repeated rows are scanned each. Long texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import materialize

MIN_RUN = 20
FDR = 0.01  # share of false reports accepted among those of a length stratum
VETO_FDR = 0.003  # share of random ones accepted among those of a length stratum that the battery sets aside
STRATA = (20, 24, 32, 48, 80)
PRIOR = 1000  # pairs drawn from the single characters that smooth each row of the character model
BINS = 400  # of 0.1 in -log10 p
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_SYMBOLS = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-="
_CODE = np.full(256, len(_SYMBOLS), np.int64)
_CODE[np.frombuffer(_SYMBOLS, np.uint8)] = np.arange(len(_SYMBOLS))
_RUN = np.array([b in _SYMBOLS for b in range(256)])
_HEX = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
N = len(_SYMBOLS)

_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": _DIGIT + "abcdef",
    "HEX": _DIGIT + "ABCDEF",
    "base32": _UPPER + "234567",
    "lower36": _DIGIT + _LOWER,
    "alnum62": _DIGIT + _LOWER + _UPPER,
    "base64": _UPPER + _LOWER + _DIGIT + "+/",
    "base64url": _UPPER + _LOWER + _DIGIT + "-_",
}


# ---------------------------------------------------------------- character model


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(symbol | symbol before it) in runs of all documents; the last row is for a run's first symbol."""

    def count(batches):
        total = np.zeros((N + 1) * N, np.int64)
        for _, buf, off in common.parts(batches, "text"):
            if not len(buf):
                continue
            code = _CODE[buf]
            before = np.concatenate([[N], code[:-1]])
            before[off[:-1][off[:-1] < len(buf)]] = N
            inside = code < N
            total += np.bincount((before * N + code)[inside], minlength=(N + 1) * N)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    pairs = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((N + 1) * N)
    for r in pairs:
        table[r.pair] = r.n
    table = table.reshape(N + 1, N)
    single = (table.sum(0) + 1) / (table.sum() + N)
    return np.log((table + PRIOR * single) / (table.sum(1, keepdims=True) + PRIOR))


# ---------------------------------------------------------------- the battery


def _upper_tail_chi2(x: float, k: int) -> float:
    """P(chi-squared with k degrees > x), by the Wilson-Hilferty cube root."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def infer_encoding(run: str) -> str | None:
    body = set(run.rstrip("="))
    if len(body) < 2 or body <= set(_DIGIT) or "=" in body:
        return None
    return next((k for k, alphabet in ENCODINGS.items() if body <= set(alphabet)), None)


def pieces(run: bytes) -> list[tuple[int, int]]:
    """The parts of a run between "=", with the padding at its end kept to the last one."""
    body = len(run.rstrip(b"="))
    out, at = [], 0
    for part in run[:body].split(b"="):
        if part:
            out.append((at, at + len(part)))
        at += len(part) + 1
    if out:
        out[-1] = (out[-1][0], len(run))
    return out


def battery(run: str, encoding: str) -> dict[str, float]:
    """p-values of the three tests under randomness in the encoding."""
    alphabet = ENCODINGS[encoding]
    x = np.array([alphabet.index(c) for c in run.rstrip("=")], float)
    n, k = len(x), len(alphabet)
    counts = np.bincount(x.astype(int), minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    high = x >= k / 2
    above = int(high.sum())
    below = n - above
    turns = 1 + int((high[1:] != high[:-1]).sum())
    # runs given fair halves: mean and variance of the number of turns
    runs_p = _two_sided((turns - 1 - (n - 1) / 2) / math.sqrt((n - 1) / 4)) if n > 1 else 1.0
    balance = _two_sided((above - below) / math.sqrt(n))
    centred = x - (k - 1) / 2
    serial = float((centred[1:] * centred[:-1]).sum()) / ((k * k - 1) / 12) / math.sqrt(max(1, n - 1))
    return {"chi": _upper_tail_chi2(chi, k - 1), "runs": min(1.0, 2 * min(runs_p, balance)), "serial": _two_sided(serial)}


def text_evidence(run: str, encoding: str, model: np.ndarray) -> float:
    """-log10 of the p-value under the text hypothesis, at least 0."""
    code = _CODE[np.frombuffer(run.rstrip("=").encode(), np.uint8)]
    fit = model[np.concatenate([[N], code[:-1]]), code].sum()
    return max(0.0, (-len(code) * math.log(len(ENCODINGS[encoding])) - fit) / math.log(10))


# ---------------------------------------------------------------- scans


def base_spans(data: bytes, lower: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the pattern matches of a text, hex ones aside."""
    lower = data.lower() if lower is None else lower
    out = []
    if any(k in lower for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 18]
    return out


_FOUND = "doc_id long, base array<struct<start:long,kind:int,end:long>>, runs array<struct<start:long,end:long,stratum:int,veto:int,bin:int>>"


def _scan(model: np.ndarray):
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    tested = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("veto", pa.int32()), ("bin", pa.int32())])

    def run(batches):
        for part, buf, off in common.parts(batches, "text"):
            data, n = buf.tobytes(), len(off) - 1
            base: list[list] = [[] for _ in range(n)]
            runs: list[list] = [[] for _ in range(n)]
            s, e, _ = common.words(buf, off, _HEX)
            long = e - s >= 16
            for a, b in zip(s[long], e[long], strict=True):
                base[int(np.searchsorted(off, a, "right")) - 1].append((a, 2, b))
            lower = data.lower()
            if b"AKIA" in data or any(k in lower for k in _KEYWORDS):
                for i in range(n):
                    a, b = off[i], off[i + 1]
                    base[i] += [(a + x, kind, a + y) for x, kind, y in base_spans(data[a:b], lower[a:b])]
            s, e, _ = common.words(buf, off, _RUN)
            long = e - s >= MIN_RUN
            for a, b in ((a + x, a + y) for a, b in zip(s[long], e[long], strict=True) for x, y in pieces(data[a:b])):
                if b - a < MIN_RUN:
                    continue
                i = int(np.searchsorted(off, a, "right")) - 1
                if any(x < b and a < y for x, _, y in base[i]):
                    continue
                word = data[a:b].decode()
                encoding = infer_encoding(word)
                if encoding is None:
                    continue
                p = min(1.0, 3 * min(battery(word, encoding).values()))
                stratum = sum(b - a >= x for x in STRATA) - 1
                runs[i].append((a, b, max(0, stratum), min(BINS - 1, int(-10 * math.log10(max(p, 1e-300)))), min(BINS - 1, int(10 * text_evidence(word, encoding, model)))))
            for i in range(n):
                if base[i] or runs[i]:
                    lead = np.concatenate([[0], np.cumsum((buf[off[i] : off[i + 1]] & 0xC0) != 0x80)])
                    at = lambda x, o=off[i], c=lead: int(c[x - o])  # noqa: E731  bytes to code points
                    base[i] = [(at(x), kind, at(y)) for x, kind, y in sorted(base[i])]
                    runs[i] = [(at(x), at(y), *more) for x, y, *more in runs[i]]
            to = lambda rows, t: pa.array([[dict(zip(t.names, r, strict=True)) for r in x] for x in rows], pa.list_(t))
            yield pa.RecordBatch.from_arrays([part["doc_id"], to(base, span), to(runs, tested)], names=["doc_id", "base", "runs"])

    return run


def thresholds(histogram: dict[tuple[int, int], int], fdr: float = FDR) -> dict[int, int]:
    """Benjamini-Hochberg by stratum on binned p-values: the least bin (of -log10 p) that is rejected."""
    out = {}
    for stratum in {k for k, _ in histogram}:
        counts = np.array([histogram.get((stratum, b), 0) for b in range(BINS)], float)
        reported = counts[::-1].cumsum()[::-1]
        p = 10.0 ** (-np.arange(BINS) / 10)  # a bin's p-values are this at most
        good = np.flatnonzero((reported > 0) & (p * counts.sum() <= fdr * reported))
        out[stratum] = int(good[0]) if len(good) else BINS
    return out


def find_secrets(docs: DataFrame, fdr: float = FDR, veto_fdr: float = VETO_FDR) -> DataFrame:
    """doc_id and spans, an ordered array of (start, kind, end) in code points with kind an index of KINDS."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(rows.mapInArrow(_scan(character_model(rows)), _FOUND), "secrets")
    counts = found.select(F.explode("runs").alias("r")).groupBy("r.stratum", "r.veto", "r.bin").count().collect()  # a table of fixed size
    tested, left = Counter(), Counter()
    for r in counts:
        tested[r.stratum, r.veto] += r["count"]
    vetoes = thresholds(tested, veto_fdr)
    for r in counts:
        if r.veto < vetoes[r.stratum]:
            left[r.stratum, r.bin] += r["count"]
    least = thresholds(left, fdr)
    at = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    kept = F.filter("runs", lambda r: (r["veto"] < at(vetoes)[r["stratum"]]) & (r["bin"] >= at(least)[r["stratum"]])) if least else F.filter("runs", lambda r: F.lit(False))
    added = F.transform(kept, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")))
    return found.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Per document: the counts of pattern matches, the digest of their spans and the string of all spans."""
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), of(3).alias("n_random"))


def redact(text: str | None, spans: list[tuple[int, int]], mark: str = "[secret]") -> str | None:
    """The text with the spans (code points) replaced."""
    if text is None:
        return None
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            out += [text[at : max(start, at)], mark if start >= at else ""]
            at = end
    return "".join([*out, text[at:]])

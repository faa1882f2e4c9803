"""Secret spans: three fixed kinds, and tokens that pass a battery of randomness tests.

A token (16 characters or more of an encoding's alphabet) is tested under the
encoding that its characters suggest.  Two questions are asked of it.

* Could it be written text?  Null hypothesis: it comes from the corpus's own
  character pairs, counted over all documents, each distinct token once.  The likelihood ratio of uniform
  draws to that model has mean 1 at most under the null, so its inverse is a
  valid p-value, and longer tokens carry more evidence by themselves.
* Could it be uniform draws?  Chi-squared uniformity over the alphabet, the runs
  test about the alphabet's middle, and lag-one serial correlation, combined into
  one p-value by the Cauchy combination, which holds for dependent tests.

A secret is a token that is not written text and passes for uniform draws.  Both
answers are under false-discovery control (Benjamini-Hochberg) within strata of
length, each with the number of all tokens tested in it: the battery's p-values
settle which tokens are dismissed as not random (a false discovery there is a
secret lost), the likelihood ratio's which of the others are reported (a false
discovery there is a text reported).  Both run on histograms of log p-values:
bounded counts, whatever the corpus.  Found tokens that touch a span of a fixed
kind are left to it.

Defined results: null texts are ''; positions are code points, ends exclusive;
repeated rows are scanned each; empty texts have no spans; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import slices, texts_of, written

# The base kinds' names, order, patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
PIECE = re.compile(r"[A-Za-z0-9]{2,}")
#: Least lengths of the strata.
STRATA = (16, 24, 32, 48, 64, 128)
#: Share of false discoveries in each stratum: among reported tokens, and among those that the battery dismisses.
FDR, DISMISSED_FDR = 0.01, 0.01
#: Histogram bins of -log10 p: width and number; the last is open.
BIN, BINS = 0.25, 160

_ALPHABET = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"
_CODE = np.zeros(256, dtype=np.int64)
_CODE[list(_ALPHABET)] = np.arange(1, len(_ALPHABET) + 1)
CODES = len(_ALPHABET) + 1
#: Codes from 1 to this are letters and digits.
PLAIN = 62
# flags: digit 0-1 and 8-9, digit 2-7, a-f, g-z, A-F, G-Z, +/, -_
_FLAG = np.zeros(256, dtype=np.int64)
for _chars, _bit in ((b"0189", 1), (b"234567", 2), (b"abcdef", 4), (b"ghijklmnopqrstuvwxyz", 8), (b"ABCDEF", 16), (b"GHIJKLMNOPQRSTUVWXYZ", 32), (b"+/", 64), (b"-_", 128)):
    _FLAG[list(_chars)] = _bit


def _alphabet_of(flags: int) -> bytes:
    """The smallest usual alphabet with all characters flagged."""
    digits, upper = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = upper.lower()
    if flags & 128 and flags & 64:
        return upper + lower + digits + b"+/-_"
    if flags & 128:
        return upper + lower + digits + b"-_"
    if flags & 64:
        return upper + lower + digits + b"+/"
    if not flags & ~3:
        return digits
    if not flags & (8 | 16 | 32):
        return digits + b"abcdef" if flags & 3 else lower
    if not flags & (4 | 8 | 32):
        return digits + b"ABCDEF" if flags & 3 else upper
    if not flags & (16 | 32):
        return lower + digits if flags & 3 else lower
    if not flags & (4 | 8):
        return upper if not flags & 3 else upper + b"234567" if not flags & 1 else upper + digits
    return upper + lower + digits if flags & 3 else upper + lower


ALPHABETS = [_alphabet_of(f) for f in range(256)]
_SIZES = np.array([len(a) for a in ALPHABETS], dtype=float)
#: Place of each byte in each alphabet.
_PLACES = np.zeros((256, 256), dtype=np.int64)
for _f, _a in enumerate(ALPHABETS):
    _PLACES[_f, list(_a)] = np.arange(len(_a))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _tail(z: np.ndarray) -> np.ndarray:
    """Two-sided p-values of standard normal statistics."""
    return _erfc(np.abs(z) / math.sqrt(2)).astype(float)


class Values:
    """Tokens as the places of their characters in their alphabets, laid end to end."""

    def __init__(self, tokens: list[str], flags: np.ndarray):
        self.n = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.owner = np.repeat(np.arange(len(tokens)), self.n)
        self.value = _PLACES[flags[self.owner], np.frombuffer("".join(tokens).encode(), dtype=np.uint8)]
        self.size = _SIZES[flags]
        self.inner = self.owner[1:] == self.owner[:-1]

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=x, minlength=len(self.n))

    def pair_sums(self, x: np.ndarray) -> np.ndarray:
        """Sums of x over neighbours within a token."""
        return np.bincount(self.owner[1:][self.inner], weights=x[self.inner], minlength=len(self.n))


def chi_squared_p(v: Values) -> np.ndarray:
    """Upper tails of the chi-squared statistics of uniform draws, by the cube-root normal approximation."""
    cell, times = np.unique(v.owner * 256 + v.value, return_counts=True)
    x = np.bincount(cell // 256, weights=times.astype(float) ** 2, minlength=len(v.n)) * v.size / v.n - v.n
    d = v.size - 1
    z = (np.cbrt(np.maximum(x, 0) / d) - (1 - 2 / (9 * d))) / np.sqrt(2 / (9 * d))
    return 0.5 * _erfc(z / math.sqrt(2)).astype(float)


def runs_p(v: Values) -> np.ndarray:
    """Two-sided Wald-Wolfowitz tests of runs below and above the alphabet's middle."""
    up = v.value * 2 >= v.size[v.owner]
    a = v.sums(up)
    b = v.n - a
    runs = v.pair_sums((up[1:] != up[:-1]).astype(float)) + 1
    mean = 2 * a * b / v.n + 1
    var = (mean - 1) * (mean - 2) / np.maximum(v.n - 1, 1)
    p = _tail(np.where(var > 0, runs - mean, 0) / np.sqrt(np.where(var > 0, var, 1)))
    return np.where((a == 0) | (b == 0), 2.0 ** (1.0 - v.n), p)


def serial_p(v: Values) -> np.ndarray:
    """Two-sided tests of lag-one correlation."""
    x = v.value - (v.sums(v.value) / v.n)[v.owner]
    d = v.sums(x * x)
    return np.where(d > 0, _tail(v.pair_sums(x[1:] * x[:-1]) / np.where(d > 0, d, 1) * np.sqrt(v.n)), 0.0)


def battery_p(tokens: list[str], flags: np.ndarray) -> np.ndarray:
    """One p-value a token for uniform draws from its alphabet: the Cauchy combination of the three tests."""
    v = Values(tokens, flags)
    p = np.clip(np.stack([chi_squared_p(v), runs_p(v), serial_p(v)]), 1e-290, 1 - 1e-12)
    return np.arctan2(1.0, (1 / np.tan(np.pi * p)).mean(axis=0)) / np.pi


def _pairs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of neighbouring characters (pair), and whether both are letters or digits."""
    code = _CODE[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    plain = (code > 0) & (code <= PLAIN)
    return code[:-1] * CODES + code[1:], plain[:-1] & plain[1:]


def _counted(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def pair_counts(rows: DataFrame) -> np.ndarray:
    """Corpus counts of neighbouring characters by code (0: any other character), CODES x CODES.

    What lies outside tokens counts as often as it occurs.  A token counts once
    however many rows hold it, and so does each piece of letters and digits, in
    whatever tokens it stands: copies do not turn a secret into written text.
    """

    def outside(batches):
        total = np.zeros(CODES * CODES, dtype=np.int64)
        for part in slices(batches):
            pair, _ = _pairs("\n" + "\n".join(TOKEN.sub("\n", t) for t in part.column("text").to_pylist()))
            total += np.bincount(pair, minlength=len(total))
        yield _counted(total)

    def tokens(batches):
        for part in slices(batches):
            once = {m for t in part.column("text").to_pylist() for m in TOKEN.findall(t)}
            yield pa.RecordBatch.from_arrays([pa.array(once, pa.string())], ["text"])

    def pieces(batches):
        for part in slices(batches):
            once = {m for t in part.column("text").to_pylist() for m in PIECE.findall(t)}
            yield pa.RecordBatch.from_arrays([pa.array(once, pa.string())], ["text"])

    def inside(plain: bool):
        def run(batches):
            total = np.zeros(CODES * CODES, dtype=np.int64)
            for part in slices(batches):
                pair, both = _pairs("\n" + "\n".join(part.column("text").to_pylist()) + "\n")
                total += np.bincount(pair[both == plain], minlength=len(total))
            yield _counted(total)

        return run

    kind = "pair long, n long"
    texts = rows.select("text")
    distinct = written(texts.mapInArrow(tokens, "text string").distinct(), "tokens")
    inner = distinct.mapInArrow(pieces, "text string").distinct().mapInArrow(inside(True), kind)
    every = texts.mapInArrow(outside, kind).unionByName(distinct.mapInArrow(inside(False), kind)).unionByName(inner)
    # of a piece, only pairs of letters and digits count; its ends are counted with the token
    got = every.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CODES * CODES)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(CODES, CODES)


def text_evidence(tokens: list[str], logq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 likelihood ratio of uniform draws to text, flags) of each token; ``logq`` is log10 P(next | code)."""
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    raw = np.frombuffer("".join(tokens).encode(), dtype=np.uint8)
    first = np.cumsum(size) - size
    code = _CODE[raw]
    before = np.append(0, code[:-1])
    before[first] = 0
    text = np.add.reduceat(logq[before, code], first)
    flags = np.bitwise_or.reduceat(_FLAG[raw], first)
    return -size * np.log10(_SIZES[flags]) - text, flags


def _bins(score: np.ndarray) -> np.ndarray:
    """Histogram bins of -log10 p."""
    return np.clip(np.floor(score / BIN), 0, BINS - 1).astype(np.int64)


def _thresholds(tested: np.ndarray, counts: np.ndarray, fdr: float) -> list[float]:
    """Per stratum the least -log10 p that is a discovery, by Benjamini-Hochberg over histogram bins."""
    out = []
    for m, row in zip(tested, counts):
        found = np.cumsum(row[::-1])[::-1]
        ok = [b for b in range(BINS) if found[b] and 10 ** (-b * BIN) <= fdr * found[b] / max(m, 1)]
        out.append(ok[0] * BIN if ok else math.inf)
    return out


FOUND = "doc_id {id}, base array<struct<start:int,kind:int,end:int>>, more array<struct<start:int,end:int,stratum:int,score:double,odd:double>>, tested array<int>, base_sha256 string"


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows = texts_of(docs, id_col, text_col)
    # one less of each pair: a token is not evidence of being text by itself
    pairs = np.maximum(pair_counts(rows) - 1, 0) + 0.5
    shared = docs.sparkSession.sparkContext.broadcast(np.log10(pairs / pairs.sum(axis=1, keepdims=True)))
    least = np.array(STRATA)

    def run(batches):
        logq = shared.value
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            where, tokens = [], []
            for k, t in enumerate(texts):
                for m in TOKEN.finditer(t):
                    where.append((k, m.start(), m.end()))
                    tokens.append(m.group())
            more: list[list] = [[] for _ in texts]
            tested: list[list] = [[] for _ in texts]
            if tokens:
                score, flags = text_evidence(tokens, logq)
                odd = -np.log10(battery_p(tokens, flags))
                stratum = np.searchsorted(least, np.fromiter(map(len, tokens), dtype=np.int64), side="right") - 1
                for (k, _, _), b in zip(where, (stratum * BINS + _bins(odd)).tolist()):
                    tested[k].append(b)
                for i in np.flatnonzero(score >= -math.log10(FDR)):
                    k, s, e = where[i]
                    if not any(a < e and s < b for a, _, b in base[k]):
                        more[k].append((s, e, int(stratum[i]), float(score[i]), float(odd[i])))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in b] for b in base], pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
                    pa.array([[{"start": s, "end": e, "stratum": q, "score": x, "odd": y} for s, e, q, x, y in m] for m in more], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("score", pa.float64()), ("odd", pa.float64())]))),
                    pa.array(tested, pa.list_(pa.int32())),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]),
                ],
                ["doc_id", "base", "more", "tested", "base_sha256"],
            )

    found = written(rows.mapInArrow(run, FOUND.format(id=rows.schema["doc_id"].dataType.simpleString())), "secrets")

    def limits(bins, tested, fdr: float):
        counts = np.zeros((len(STRATA), BINS))
        for r in bins.groupBy("at").count().collect():  # len(STRATA) * BINS rows at most
            counts[r["at"] // BINS, r["at"] % BINS] = r["count"]
        tested = counts.sum(axis=1) if tested is None else tested
        return F.array(*[F.lit(float(x)) for x in _thresholds(tested, counts, fdr)]), tested

    dismissed, tested = limits(found.select(F.explode("tested").alias("at")), None, DISMISSED_FDR)
    # what the battery dismisses is in no stratum's count of reports
    random = F.filter("more", lambda m: m["odd"] < F.get(dismissed, m["stratum"]))
    bins = found.select(F.explode(random).alias("m")).select((F.col("m.stratum") * BINS + F.least(F.floor(F.col("m.score") / BIN), F.lit(BINS - 1))).alias("at"))
    limit, _ = limits(bins, tested, FDR)
    kept = F.filter(random, lambda m: m["score"] >= F.get(limit, m["stratum"]))
    every = F.array_sort(F.concat("base", F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))))
    named = F.array(*[F.lit(k) for k in KINDS])

    def count(kind: int):
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256",
        F.concat_ws(",", F.transform(every, lambda s: F.concat(F.get(named, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))).alias("spans"),
        F.size(kept).cast("long").alias("n_random"),
    )

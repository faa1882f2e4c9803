"""Removal of repeated byte strings with sharded suffix arrays.

A byte goes if some string of ``length`` bytes over it also starts anywhere else
in the corpus.  Every such string ("window") is assigned by its content to one
shard, so that its repeats meet there:

1. Each window is named by the least hash among its ``gram``-byte substrings,
   the leftmost of equals; windows of neighbouring starts with the same least
   substring form a *segment*.  Equal windows have equal names wherever they
   stand.  Names that occur once need nothing more.
2. Segments of equal bytes are folded with their number.  A name with a single
   folded segment of several copies repeats as a whole; the segments of other
   repeated names are fetched, one copy each.
3. A shard holds the segments of its names.  It sorts their suffixes by
   Larsson-Sadakane refinement (ranks at doubling depth, settled groups left
   alone) and finds common prefixes by Kasai's walk, in lanes; suffixes that
   share ``length`` bytes are repeats.
4. A name with many different segments is dealt over several shards.  Each
   sends its sorted window digests, cut by binary search into ranges, one for
   every RANGE_SHARDS shards; in a range the shards' lists are merged pairwise by
   binary search, round by round, and what two of them hold goes back to both.
5. Repeated starts return to their documents and become byte spans.

Texts travel only in one exchange by document, which the fetch and the final
join share.  Nothing but counts depends on group sizes.

Defined results: null is ''; texts shorter than ``length`` bytes keep all; rows
equal in id and text are different documents (and so repeat each other); an
empty table gives no rows; other columns are ignored.  Digests identify
segments by 128 bits, and windows of step 4 by 64 bits within their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import texts_of, written

#: Bytes of a repeated string, and of the substring that names a window.
LENGTH, GRAM = 400, 128
#: Bytes that are named, and sorted, at a time.
NAME_BYTES, SHARD_BYTES = 1 << 21, 3 << 20
#: Different segments of one name in a shard, at most, and shards whose digests meet in one range.
SHARD_SEGMENTS, RANGE_SHARDS = 500, 8
#: Lanes of Kasai's walk.
LANES = 2048

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any substrings of an array, after one pass over it."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def load(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(self.up) < n:
            size = max(n, NAME_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _BACK)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_BYTES[data] * self.up[: n - 1], out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def segments(data: np.ndarray, ends: np.ndarray, hasher: Hasher, length: int = LENGTH, gram: int = GRAM):
    """(start, number of window starts, name's place, name) of each segment of texts that end at ``ends``."""
    wide = length - gram + 1
    n = len(data) - gram + 1
    none = np.empty(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    hasher.load(data)
    at = np.arange(n)
    named = hasher(at, at + gram)
    key = (named & ~_PLACE) | at.astype(np.uint64)
    blocks = -(-n // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, wide)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = len(data) - length + 1
    least = (np.minimum(back[:starts], ahead[wide - 1 : wide - 1 + starts]) & _PLACE).astype(np.int64)
    begin = np.append(0, ends[:-1])
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    ok = ends - begin >= length
    np.add.at(inside, begin[ok], 1)
    np.add.at(inside, ends[ok] - length + 1, -1)
    valid = np.cumsum(inside)[:starts] > 0
    new = np.append(True, (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]))
    doc_start = np.zeros(starts, dtype=bool)
    doc_start[begin[begin < starts]] = True
    first = np.flatnonzero(new | doc_start)
    count = np.diff(np.append(first, starts))
    keep = valid[first]
    first, count = first[keep], count[keep]
    place = least[first]
    return first, count, place, named[place]


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The suffix array of ``data``."""
    n = len(data)
    padded = np.append(data, np.zeros(8, dtype=np.uint8)).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(7):
        key = (key << np.uint64(8)) | padded[k : k + n]
    # of equal bytes the suffix that ends sooner comes first
    key = (key << np.uint64(8)) | np.minimum(n - np.arange(n), 7).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(head, n))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = np.repeat(head, size) + 1
    rank[n] = 0
    slot = np.flatnonzero(np.repeat(size > 1, size))
    h = 7
    while len(slot):
        at = order[slot]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + h, n)].astype(np.uint64)
        sort = np.argsort(key)
        at, key = at[sort], key[sort]
        order[slot] = at
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(at)))
        rank[at] = np.repeat(slot[head], size) + 1
        slot = slot[np.repeat(size > 1, size)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before it; Kasai's walk.

    Each lane walks its own stretch of the text, in which the prefix shrinks by
    one byte at most from one position to the next.
    """
    n = len(order)
    padded = np.append(data, np.zeros(16, dtype=np.uint8))
    word = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=np.int64)
    step = max(1, -(-n // lanes))
    lane = np.arange(0, n, step)
    have = np.zeros(len(lane), dtype=np.int64)
    for k in range(step):
        at = lane + k
        if at[-1] >= n:
            at, have = at[:-1], have[:-1]
            lane = lane[:-1]
            if not len(at):
                break
        other = before[at]
        have = np.maximum(have - 1, 0)
        live = np.flatnonzero(other >= 0)
        have[other < 0] = 0
        while len(live):
            h = have[live]
            diff = word[at[live] + h] ^ word[other[live] + h]
            same = diff == 0
            low = diff & (~diff + np.uint64(1))
            more = np.where(same, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
            # nothing may match past the end of the text
            more = np.minimum(more, n - np.maximum(at[live], other[live]) - h)
            have[live] = h + more
            live = live[more == 8]
        out[at] = have
    return out[order]


def repeated_starts(parts: list[bytes], starts: np.ndarray, copies: np.ndarray, length: int = LENGTH):
    """Of segments with so many window starts each: (mask of repeated starts, their positions, first position of each)."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    begin = np.cumsum(size) - size
    weight = np.zeros(len(data), dtype=np.int64)
    owner = np.repeat(np.arange(len(parts)), starts)
    at = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    weight[at] = copies[owner]
    order = suffix_order(data)
    prefix = common_prefixes(data, order)
    group = np.cumsum(prefix < length)
    total = np.bincount(group, weights=weight[order])
    again = np.zeros(len(data), dtype=bool)
    again[order] = total[group] >= 2
    return again[at], at, data


def _runs(mask: np.ndarray, owner: np.ndarray, first: np.ndarray):
    """(owner, from, to) of maximal runs of True within each owner, relative to its first."""
    edge = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.empty(0, bool)
    on = mask & (edge | ~np.append(False, mask[:-1]))
    last = np.append(edge[1:], True) if len(owner) else edge
    off = mask & (last | ~np.append(mask[1:], False))
    a, b = np.flatnonzero(on), np.flatnonzero(off)
    return owner[a], a - first[owner[a]], b - first[owner[a]]


def _shards(batches: Iterator[pa.RecordBatch]):
    """Rows of whole (name, part) groups, about SHARD_BYTES of segments at a time, as columns."""
    held: list[dict] = []
    size = 0
    last = None
    for b in batches:
        for row in b.to_pylist():
            mark = (row["name"], row["part"])
            if size >= SHARD_BYTES and mark != last:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row["bytes"])
            last = mark
    if held:
        yield held


def _window_digests(rows: list[dict], length: int):
    """Digest of each window of segment rows, after the bytes are laid end to end."""
    data = np.frombuffer(b"".join(r["bytes"] for r in rows), dtype=np.uint8)
    size = np.fromiter((len(r["bytes"]) for r in rows), dtype=np.int64)
    starts = np.fromiter((r["starts"] for r in rows), dtype=np.int64)
    begin = np.cumsum(size) - size
    at = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    hasher = Hasher()
    hasher.load(data)
    return hasher(at, at + length)


def _send_digests(length: int):
    """Step 4, out: per name and part the sorted digests of its windows, cut into ranges."""

    def run(batches):
        for rows in _shards(batches):
            i = 0
            while i < len(rows):
                j = i
                while j < len(rows) and (rows[j]["name"], rows[j]["part"]) == (rows[i]["name"], rows[i]["part"]):
                    j += 1
                d = np.unique(_window_digests(rows[i:j], length))
                ranges = -(-rows[i]["parts"] // RANGE_SHARDS)
                cut = np.searchsorted(d, np.array([k * (1 << 64) // ranges for k in range(1, ranges)], dtype=np.uint64))
                pieces = np.split(d, cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[i]["name"]] * ranges), pa.array(range(ranges), pa.int64()), pa.array([rows[i]["part"]] * ranges, pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())],
                    ["name", "range", "part", "digests"],
                )
                i = j

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4, back: of the lists of one name and range, the digests that another part holds too."""

    def done(name, lists):
        every = [np.frombuffer(x, dtype=np.uint64) for _, x in lists]
        level, met = every, [np.empty(0, dtype=np.uint64)]
        while len(level) > 1:  # each round merges neighbours
            merged = []
            for x, y in zip(level[::2], level[1::2]):
                at = np.searchsorted(x, y)
                both = (at < len(x)) & (x[np.minimum(at, len(x) - 1)] == y) if len(x) else np.zeros(len(y), dtype=bool)
                met.append(y[both])
                merged.append(np.insert(x, at[~both], y[~both]))
            level = merged + level[len(level) & ~1 :]
        shared = np.unique(np.concatenate(met))
        back = [x[shared[np.minimum(np.searchsorted(shared, x), len(shared) - 1)] == x] if len(shared) else shared for x in every]
        parts = [p for (p, _), x in zip(lists, back) if len(x)]
        found = [x.tobytes() for x in back if len(x)]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.int64()), pa.array(parts, pa.int64()), pa.array(found, pa.binary())], ["name", "part", "found"])

    held, mark = [], None
    for b in batches:
        for row in b.to_pylist():
            if mark is not None and mark != (row["name"], row["range"]):
                yield done(mark[0], held)
                held = []
            mark = (row["name"], row["range"])
            held.append((row["part"], row["digests"]))
    if held:
        yield done(mark[0], held)


def _find(length: int):
    """Step 3: per segment the runs of repeated starts; rows with ``found`` bring what other parts hold."""

    def run(batches):
        for rows in _shards(batches):
            found = [r for r in rows if r["found"] is not None]
            rows = [r for r in rows if r["found"] is None]
            if not rows:
                continue
            starts = np.fromiter((r["starts"] for r in rows), dtype=np.int64)
            again, _, _ = repeated_starts([r["bytes"] for r in rows], starts, np.fromiter((r["copies"] for r in rows), dtype=np.int64), length)
            owner = np.repeat(np.arange(len(rows)), starts)
            if found:
                group: dict[tuple, list[int]] = {}
                for i, r in enumerate(rows):
                    group.setdefault((r["name"], r["part"]), []).append(i)
                digest = _window_digests(rows, length)
                first = np.cumsum(starts) - starts
                brought: dict[tuple, list[bytes]] = {}
                for r in found:
                    brought.setdefault((r["name"], r["part"]), []).append(r["found"])
                for mark, blobs in brought.items():
                    mine = np.concatenate([np.arange(first[i], first[i] + starts[i]) for i in group[mark]])
                    again[mine] |= np.isin(digest[mine], np.frombuffer(b"".join(blobs), dtype=np.uint64))
            who, lo, hi = _runs(again, owner, np.cumsum(starts) - starts)
            yield pa.RecordBatch.from_arrays([pa.array([rows[i]["name"] for i in who], pa.int64()), pa.array([rows[i]["digest"] for i in who], pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["name", "digest", "lo", "hi"])

    return run


def _name(length: int, gram: int):
    """Step 1: rows (name, digest, k1, k2, start, starts) of each text's segments."""

    def run(batches):
        hasher = Hasher()

        def done(texts, keys, offsets):
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
            first, count, place, name = segments(data, ends, hasher, length, gram)
            digest = hasher(first, first + count + length - 1) if len(first) else name
            doc = np.searchsorted(ends, first, side="right")
            begin = np.append(0, ends)[doc]
            k = np.array(keys, dtype=np.int64).reshape(-1, 2)[doc]
            start = first - begin + np.array(offsets, dtype=np.int64)[doc]
            # where in the segment its name stands is part of what it is
            digest = _mix(digest + (place - first).astype(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(start), pa.array(count)], ["name", "digest", "k1", "k2", "start", "starts"])

        texts, keys, offsets, size = [], [], [], 0
        for b in batches:
            for text, k1, k2 in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("k1").to_pylist(), b.column("k2").to_pylist()):
                if len(text) < length:
                    continue
                # long texts in pieces whose window starts follow on one another
                for at in range(0, len(text) - length + 1, NAME_BYTES - length + 1):
                    piece = text if len(text) <= NAME_BYTES else text[at : at + NAME_BYTES]
                    if size and size + len(piece) > NAME_BYTES:
                        yield done(texts, keys, offsets)
                        texts, keys, offsets, size = [], [], [], 0
                    texts.append(piece)
                    keys.append((k1, k2))
                    offsets.append(at)
                    size += len(piece)
        if texts:
            yield done(texts, keys, offsets)

    return run


def _cut(length: int):
    """Step 2: bytes of the segments wanted of each text."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for text, wanted in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("wanted").to_pylist()):
                out += [(w["name"], w["digest"], w["parts"], w["starts"], w["copies"], text[w["start"] : w["start"] + w["starts"] + length - 1]) for w in wanted]
                if len(out) > 5000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["name", "digest", "parts", "starts", "copies", "bytes"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = texts_of(docs, id_col, text_col)
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("2"), "text", "doc_id").alias("k2"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, spans): per keyed row its runs of repeated window starts, as array of (lo, hi) start positions."""
    named = written(rows.mapInArrow(_name(length, gram), "name long, digest long, k1 long, k2 long, start long, starts long"), "segments")
    # written, so that both sides of the join are plain exchanges and a frequent name's rows can be split
    twice = written(named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name"), "names")
    named = written(named.join(twice, "name", "left_semi"), "repeated")
    folded = named.groupBy("name", "digest").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("k1", "k2", "start", "starts")])
    folded = written(folded, "folded")
    sizes = written(folded.groupBy("name").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "contested")
    contested = folded.join(sizes, "name").withColumn("parts", F.ceil(F.col("kinds") / SHARD_SEGMENTS))
    wanted = contested.groupBy("k1", "k2").agg(F.collect_list(F.struct("name", "digest", "parts", "start", "starts", "copies")).alias("wanted"))
    fetched = rows.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("text", "wanted").mapInArrow(_cut(length), "name long, digest long, parts long, starts long, copies long, bytes binary")
    # rows equal in id and text deliver the same segment once each
    shard = fetched.withColumn("part", F.pmod("digest", "parts"))
    split = shard.filter("parts > 1").repartition("name", "part").sortWithinPartitions("name", "part").mapInArrow(_send_digests(length), "name long, range long, part long, digests binary")
    met = split.repartition("name", "range").sortWithinPartitions("name", "range", "part").mapInArrow(_meet, "name long, part long, found binary")
    columns = ["name", "part", "digest", "starts", "copies", "bytes", "found"]
    single = shard.withColumn("found", F.lit(None).cast("binary")).select(columns)
    brought = met.select("name", "part", *[F.lit(0).cast("long").alias(c) for c in ("digest", "starts", "copies")], F.lit(b"").alias("bytes"), "found")
    runs = single.unionByName(brought).repartition("name", "part").sortWithinPartitions("name", "part").mapInArrow(_find(length), "name long, digest long, lo long, hi long")
    whole = folded.filter("copies > 1").select("name", "digest", F.lit(0).cast("long").alias("lo"), (F.col("starts") - 1).alias("hi"))
    some = runs.join(folded.filter("copies = 1").select("name", "digest"), ["name", "digest"], "left_semi")
    back = named.select("name", "digest", "k1", "k2", "start").join(whole.unionByName(some), ["name", "digest"])
    return back.groupBy("k1", "k2").agg(F.collect_list(F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))).alias("spans"))


def byte_spans(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal (from, to) byte runs covered by windows at the given start runs."""
    out: list[list[int]] = []
    for s in sorted((s["lo"], s["hi"] + length) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([*s])
    return [(a, b) for a, b in out]


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _joined(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    rows = _keyed(docs, id_col, text_col)
    return rows.join(repeated_spans(rows, length, gram).hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "spans")


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    joined = _joined(docs, id_col, text_col, length, gram)

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                cut = byte_spans(spans, length)
                out.append((len(text), sum(e - a for a, e in cut), len(cut), hashlib.sha256(kept_bytes(text, cut)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in zip(*out))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, text (kept bytes; characters cut in two are dropped), spans removed."""
    joined = _joined(docs, id_col, text_col, length, gram)

    def run(batches):
        for b in batches:
            cuts = [byte_spans(s, length) for s in b.column("spans").to_pylist()]
            kept = [kept_bytes(t, c).decode("utf-8", "ignore") for t, c in zip(b.column("text").cast(pa.binary()).to_pylist(), cuts)]
            spans = pa.array([[{"from": a, "to": e} for a, e in c] for c in cuts], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string()), spans], ["doc_id", "text", "spans"])

    return joined.mapInArrow(run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, text string, spans array<struct<from:long,to:long>>")

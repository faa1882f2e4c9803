"""Order-preserving packing of token streams by dynamic programming.

Each partition of the documents is one stream of ids, in the order in which it
is stored.  Cuts may fall at the ends of documents, lines and sentences (a mark that
white space or the text's end follows), and inside a sentence only where it alone exceeds the window.  The cost of a cutting is the padding of its
windows plus a penalty for each cut inside a document; a window whose length is
a power of two is not padded.  With b the position of a
boundary,

    best[j] = penalty[j] + min over i with b[j] - b[i] <= size of
              best[i] + (0 if b[j] - b[i] is a power of two else size - (b[j] - b[i]))

The padded part is a sliding-window minimum of best[i] + b[i], held in a
monotone queue; the few transitions at powers of two are found beforehand.  The
stream is cut block by block, the last TAIL windows' worth of a block opening the
next, so memory does not grow with the partition and no exchange takes place.

Defined results: a null or empty text is its end id alone; repeated rows are
packed each; sequence ids are (partition << 40) + counter, unique but not
gapless across partitions; empty tables give no pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from noteloom.llm.common import slices, texts_of

#: Ids in a sequence.
SIZE = 1024
#: Ids that are cut at a time.
BLOCK = 400_000
#: Windows' worth of ids at a block's end that are cut anew with the next block, when what follows is known.
TAIL = 16
#: Cost, in padded ids, of a cut at a sentence's end and inside a sentence.
SENTENCE_CUT, HARD_CUT = 1.0, 8.0
#: Cost of each window, so that short unpadded ones are not made for nothing.
EACH = 4.0
#: Id after each document.
END = 0


# What an id's bytes show: they end with a sentence's mark, or with a line break; they begin with white space.
MARK, LINE, BLANK = 1, 2, 4
BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


class Encoder:
    """Byte-level BPE over a public rank file; strings of special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.signs = np.zeros(max(ranks.values()) + 1, dtype=np.uint8)
        for piece, rank in ranks.items():
            self.signs[rank] = MARK * (piece[-1:] in (b".", b"!", b"?")) | LINE * (piece[-1:] == b"\n") | BLANK * (piece[:1] in BLANKS)

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype=np.uint32)


def default_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the rank file with the ids of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def sentence_ends(ids: np.ndarray, doc_ends: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Positions behind a line break, or behind a mark (. ! ?) that white space or the text's end follows: not inside numbers and addresses."""
    own = signs[ids]
    follows = np.append(own[1:] & BLANK > 0, False)
    follows[doc_ends[doc_ends > 1] - 2] = True  # the id at a document's end is no text
    return np.flatnonzero((own & LINE > 0) | ((own & MARK > 0) & follows)) + 1


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, signs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and the penalty of cutting there; 0 comes first."""
    sentence = sentence_ends(ids, doc_ends, signs)
    at = np.unique(np.concatenate([[0], sentence, doc_ends, [len(ids)]]))
    gap = np.diff(at)
    wide = np.flatnonzero(gap > size)
    hard = [np.arange(at[i] + size, at[i + 1], size) for i in wide]
    natural = at
    at = np.unique(np.concatenate([at, *hard]))
    penalty = np.full(len(at), HARD_CUT)
    penalty[np.searchsorted(at, natural)] = SENTENCE_CUT
    penalty[np.searchsorted(at, doc_ends)] = 0.0
    return at, penalty + EACH


def cuts(at: np.ndarray, penalty: np.ndarray, size: int, free_tail: bool) -> list[int]:
    """Indexes into ``at`` of the cheapest cutting; ``free_tail``: the last window costs no padding (it goes on)."""
    m = len(at)
    base = int(at[0])
    place = np.full(int(at[-1]) - base + 1, -1, dtype=np.int64)
    place[at - base] = np.arange(m)
    ends, starts = [], []  # transitions at powers of two
    p = size
    while p:
        j = np.flatnonzero(at >= base + p)
        i = place[at[j] - base - p]
        ends.append(j[i >= 0])
        starts.append(i[i >= 0])
        p >>= 1
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[order], np.arange(m + 1)).tolist()
    free = starts[order].tolist()
    b, pen = at.tolist(), penalty.tolist()
    best, back = [0.0] * m, [0] * m
    queue: deque[int] = deque()
    value = [0.0] * m  # best[i] + b[i]
    for j in range(1, m):
        v = value[j - 1]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j - 1)
        low = b[j] - size
        while b[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        cost = value[i] + size - b[j]
        for q in range(first[j], first[j + 1]):
            k = free[q]
            if best[k] <= cost:
                cost, i = best[k], k
        best[j], back[j] = cost + pen[j], i
        value[j] = best[j] + b[j]
    j = m - 1
    if free_tail:
        low = int(np.searchsorted(at, at[-1] - size))
        back[j] = min(range(min(low, m - 2), m - 1), key=best.__getitem__) if m > 1 else 0
    out = []
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


class Packer:
    """Packs a stream of documents; ``add`` and ``finish`` yield pieces as they are settled."""

    def __init__(self, signs: np.ndarray, size: int = SIZE, block: int = BLOCK, first_id: int = 0):
        self.signs, self.size, self.block, self.next_id = signs, size, block, first_id
        self.docs: list[list] = []  # [doc_id, ids, ids already settled]
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids)
        if self.held >= self.block:
            yield from self._settle(False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._settle(True)

    def _settle(self, last: bool) -> Iterator[tuple]:
        stream = np.concatenate([d[1][d[2] :] for d in self.docs])
        ends = np.cumsum([len(d[1]) - d[2] for d in self.docs])
        at, penalty = boundaries(stream, ends, self.signs, self.size)
        places = [int(at[j]) for j in cuts(at, penalty, self.size, not last)]
        if not last:
            places = [p for p in places if p <= len(stream) - TAIL * self.size]
        k, begin = 0, 0
        for end in places:
            offset = 0
            while begin < end:
                doc_id, ids, done = self.docs[k]
                n = min(len(ids) - done, end - begin)
                yield doc_id, done, n, zlib.crc32(ids[done : done + n].astype("<u4").tobytes()), len(ids), self.next_id, offset
                offset, begin = offset + n, begin + n
                self.docs[k][2] = done + n
                if done + n == len(ids):
                    k += 1
            self.next_id += 1
        self.docs = self.docs[k:]
        self.held -= places[-1] if places else 0


SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece of a document in a sequence; see the module for the rule."""
    rows = texts_of(docs, id_col, text_col)
    path, pattern = vocabulary or default_vocabulary()
    kind = rows.schema["doc_id"].dataType

    def run(batches):
        encode = Encoder(path, pattern)
        packer = Packer(encode.signs, size, first_id=TaskContext.get().partitionId() << 40)
        out: list[tuple] = []
        arrow = None

        def batch():
            cols = list(zip(*out)) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        end = np.array([END], dtype=np.uint32)
        for part in slices(batches):
            arrow = part.column("doc_id").type
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                out.extend(packer.add(doc_id, np.concatenate([encode(text), end])))
            if len(out) > 20_000:
                yield batch()
                out = []
        out.extend(packer.finish())
        if out:
            yield batch()

    return rows.mapInArrow(run, SCHEMA.format(id=kind.simpleString()))

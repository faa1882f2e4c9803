"""Repair against a search over edit strings, by hand and in blocks."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from noteloom.llm import conversation as cv

SPACE = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """Rows (conv, turn, role, text) after the contract's damage, by conversation."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        act = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        out[c]  # noqa: B018
        if act == 0:
            continue
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        out[c] += [(t, "user" if act == 4 else role, text)] * (2 if act == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def cheapest(rows, must, cut):
    """(cost, audit, lines) by a best-first search over (cost, audit); states are role strings reduced to what the pattern still needs."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}  # after nothing, s, u, a
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, last, lines = heapq.heappop(heap)
        if (k, last) in done:
            continue
        done.add((k, last))
        if k == len(rows) and last in ("", "a"):
            return cost, audit, lines
        new = "u" if last in ("", "s", "a") else "a"
        full = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(heap, (cost + 2, audit + "I", k, new, (*lines, f"{full}:")))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, last, lines))
            if not must[k]:
                if role[:1] and role[:1] in allowed[last]:
                    heapq.heappush(heap, (cost + cut[k], audit + "K", k + 1, role[:1], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + cut[k], audit + "R", k + 1, new, (*lines, f"{full}:{text}")))


def expected(rows):
    out = Counter()
    for c, v in damage(rows).items():
        seen, kinds = set(), []
        for _, role, text in v:
            ink = SPACE.findall(text)
            kinds.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in v if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:]))
        cost, audit, lines = cheapest(v, [k in ("blank", "duplicate") for k in kinds], [k == "truncated" for k in kinds])
        out[(c, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], "conv_id long, turn long, role string, text string, block string, seq int").repartition(3)


def made_up(seed, conversations, longest):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "a user"]
    texts = ["Yes.", "No!", "and then", "", " \t", None, "Why?", "é. ", "x. \n", "a\nb.", "Yes. "]
    rows = []
    for c in range(conversations):
        for t in range(r.randrange(1, longest + 1)):
            turn = None if r.random() < 0.05 else t + r.choice((0, 0, 0, 1, 5))
            rows.append((c or None, turn, r.choice(roles[:3] if r.random() < 0.8 else roles), r.choice(texts) if r.random() < 0.5 else f"text {r.random()}."))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed):
    rows = made_up(seed, 150, 14)
    assert Counter(map(tuple, cv.repair_report(table(spark, rows)).collect())) == expected(rows)


def test_long_ones_in_blocks(spark):
    """Conversations over many blocks, the null one and one with all rows equal among them, give what whole ones give."""
    rows = made_up(3, 12, 60) + [(99, 7, "user", "again.")] * 150 + [(98, t, "user", f"{t}.") for t in range(90)]
    want = expected(rows)
    assert Counter(map(tuple, cv.repair_report(table(spark, rows)).collect())) == want
    assert Counter(map(tuple, cv.repair_report(table(spark, rows), long=20, block=7).collect())) == want
    assert Counter(map(tuple, cv.repair_report(table(spark, rows), long=1, block=1).collect())) == want


def test_by_hand(spark):
    # ids whose turns the damage leaves alone
    calm = [c for c in range(2000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(4))][:4]
    a, b, c, d = calm
    rows = [
        (a, 0, "system", "Be brief."), (a, 1, "user", "Hi."), (a, 2, "assistant", "Hello."),
        (b, 0, "user", "Hi."), (b, 1, "user", "There?"),
        (c, 0, "assistant", "Hi"), (c, 3, "tool", "x."),
        (d, 0, "system", "Only."),
    ]
    got = {r.conv_id: r for r in cv.repair_report(table(spark, rows)).collect()}
    assert (got[a].cost, got[a].audit, got[a].illegal) == (0, "KKK", 0)
    assert (got[b].cost, got[b].audit, got[b].illegal) == (2, "KR", 1)
    # the second row of c becomes an assistant behind an inserted user, or a user before the first is renamed: the least string wins
    assert (got[c].gaps, got[c].truncated) == (2, 1) and got[c].cost == cheapest([(0, "assistant", "Hi"), (3, "tool", "x.")], [0, 0], [1, 0])[0]
    assert (got[d].cost, got[d].audit, got[d].repaired_sha256) == (3, "D", hashlib.sha256(b"").hexdigest())


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row, = cv.repair_report(table(spark, [(gone, 0, "user", "Hi.")])).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cv.repair_report(table(spark, [])).collect() == []


def test_blocks_of_costs():
    """Costs through block matrices are those of the whole, for random codes."""
    r = np.random.default_rng(5)
    codes = r.integers(0, 4, (60, 1)) + r.choice([0, cv.MUST_GO, cv.CUT_OFF], (60, 1))
    whole = cv.backward(codes, cv.FINISHED[None, :])
    parts = [codes[k : k + 9] for k in range(0, 60, 9)]
    ends = cv.behind(np.stack([cv.crossing(p)[0] for p in parts]))
    assert ends.tolist() == [whole[min(k + 9, 60), 0].tolist() for k in range(0, 60, 9)]


def test_buckets():
    lengths = np.array([3, 1, 0, 9, 8, 5000, 2, 7])
    got = list(cv.by_length(lengths, 16))
    assert sorted(np.concatenate(got).tolist()) == list(range(8))
    assert all(len(b) == 1 or len(b) * lengths[b].max() <= 16 for b in got)

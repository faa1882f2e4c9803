"""Alignment of two tokenizers against a token-by-token rendering with the libraries that the contract names."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from noteloom.llm import alignment
from tests.llm.conftest import prose


def _byte_of_char():
    """Characters of byte-level entries: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for c, b in [*zip(plain, plain), *((256 + k, b) for k, b in enumerate(rest))]}


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    of = _byte_of_char()
    spell_a = lambda i: bytes(of[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids, spell_a), (b.encode, spell_b)


def _ranges(ids, spell):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(spell(i)), i))
        at = out[-1][1]
    return out


def rendered(pairs, tools):
    (enc_a, spell_a), (enc_b, spell_b) = tools
    seen, per = Counter(), []
    for i, t in pairs:
        t = t or ""
        a, b = (enc_a(t), enc_b(t)) if t else ([], [])
        whole = (" " + t).encode()
        if not t or b"".join(map(spell_a, a)) != whole or b"".join(map(spell_b, b)) != whole:
            per.append((i, 0, 0, 0, [], ""))
            continue
        ra, rb = _ranges(a, spell_a), _ranges(b, spell_b)
        links, k = [], 0
        for s, e, x in ra:
            while k < len(rb) and rb[k][1] <= s:
                k += 1
            j = k
            while j < len(rb) and rb[j][0] < e:
                links.append((x, rb[j][2]))
                j += 1
        groups, last = [], 0
        for c in sorted({e for _, e, _ in ra} & {e for _, e, _ in rb}):
            groups.append("|".join(",".join(str(x) for s, e, x in r if last < e <= c) for r in (ra, rb)))
            last = c
        seen.update(links)
        per.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, y), n in seen.items():
        most[y] = max(most[y], n)
    return Counter((i, a, b, g, len(ls), sum(seen[p] == most[p[1]] for p in ls), sum(seen[p] for p in ls), h) for i, a, b, g, ls, h in per)


def rows(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


ODD = [(31, "a▁b"), (32, "  two  spaces "), (33, "\x00\t\n"), (34, "<s>hi</s><unk> <|endoftext|>"), (35, "<0x41>"), (36, "ﬁ ｆ é 　"), (37, "😀" * 40), (38, "日本語 and Ünïcode"), (39, " ")]


@pytest.mark.parametrize("limit", [alignment.HEAVY, 40, 0])
def test_aligned(docs_of, awkward, tools, limit):
    """With all pairs broadcast, with a few, and with none."""
    pairs = [(i, t if t is None or len(t) < 20_000 else t[:4000]) for i, t in awkward] + ODD + [(50 + k, prose(k, 30)) for k in range(20)]
    got = alignment.aligned(docs_of(pairs), limit=limit)
    assert rows(got) == rendered(pairs, tools)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_slices_do_not_matter(docs_of, awkward, monkeypatch):
    """One text a slice, or all in one."""
    d = docs_of(awkward)
    want = rows(alignment.aligned(d))
    spark = d.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert rows(alignment.aligned(d)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(docs_of):
    assert alignment.aligned(docs_of([])).collect() == []
    assert rows(alignment.aligned(docs_of([(None, None), (1, "")]))) == Counter([(None, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")])


def test_align_by_hand():
    """abc|d e against a|bcd e and, as a second document, xy against xy."""
    al = alignment.align(np.array([3, 2, 2]), np.array([1, 4, 2]), np.array([2, 1]), np.array([2, 1]))
    assert al.cut_a.tolist() == [False, True, True] and al.cut_b.tolist() == [False, True, True]
    assert al.groups.tolist() == [1, 1] and al.links.tolist() == [3, 1]
    assert list(zip(al.link_a.tolist(), al.link_b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]
    assert alignment.spelled_groups(np.array([7, 8, 9]), np.array([1, 2, 3]), al, np.array([2, 1]), np.array([2, 1]), 10) == ["7,8|1,2", "9|3"]


def test_frequent_keeps_to_the_limit(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1] * 50 + [2] * 20 + [9, 40, 40, 1000])], "pair long, n long")
    for limit in (0, 1, 3, 4, 24, 73, 74):
        least, whole = alignment.frequent(counts, limit)
        held = counts.filter(f"n >= {least}").count()
        assert held <= limit and whole == (held == 74)
    assert alignment.frequent(counts.filter("n > 5000"), 5) == (1, True)

"""The plan over lines against the sequential rendering, on random notes and on the test tables' texts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from noteloom.operators import sections
from tests import plain_chunks

SF = "/root/testdata/sf0.001"


def made_up(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "be#ta", "#tag/x", "[[Link one]]", "é", "longer-word", "#t", "1.", "x"])

    def line():
        k = r.random()
        text = " ".join(word() for _ in range(r.randrange(1, 14)))
        if k < 0.08:
            return "#" * r.randrange(1, 8) + r.choice([" ", "  ", "", "\t"]) + text
        if k < 0.14:
            return r.choice(["```", "```py", " ```"])
        if k < 0.2:
            return r.choice(["- ", "* ", "12. ", "  + ", "-"]) + text
        if k < 0.24:
            return r.choice(["> ", "  >"]) + text
        if k < 0.28:
            return "| " + text + r.choice([" |", " | ", ""])
        if k < 0.31:
            return r.choice(["---", "***", "___", "--- "])
        if k < 0.42:
            return r.choice(["", "", " "])
        return text * r.choice([1, 1, 1, 6])

    return "\n".join(line() for _ in range(r.choice([1, 3, 20, 60, 200])))


def rows_of(chunks):
    return sorted((c["note_id"], c["position"], c["seq"], c["chunk_id"], c["chunk_type"], c["content"], c["header_text"], c["header_level"], tuple(c["parent_headers"]), c["start_line"], c["end_line"], tuple(c["contains_tags"]), tuple(c["contains_links"])) for c in chunks)


def test_random_notes(spark):
    notes = [(f"n{k}", made_up(k), r) for k, r in zip(range(60), ["", None, "title: x\ntags: [[a]] #b"] * 20)]
    notes += [("empty", "", ""), ("null", None, ""), ("front", "", "only: front"), ("open", "```\n# no header\n" + "text " * 40, ""), ("rules", "\n---\n---\n---\n".join("para " * 200 for _ in range(5)), "")]
    got = sections.chunk_notes(spark.createDataFrame(notes, "note_id string, text string, front string").repartition(3), front_col="front").collect()
    want = [c for i, t, f in notes for c in plain_chunks.semantic_chunks(i, t or "", f or "")]
    assert rows_of(r.asDict() for r in got) == rows_of(want)


def test_splits(spark):
    r = random.Random(1)
    texts = [r.choice(["\n", "\n\n", "\n---\n", " "]).join("w" * r.randrange(900) for _ in range(r.randrange(1, 14))) for _ in range(60)] + ["", "\n\n".join(["", "a" * 2990, " ", "b" * 20, ""]), "a" * 4000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sections.split_large(F.col("t")).alias("p")).collect()
    for row in got:
        assert row.p == plain_chunks.split_large(texts[row.i]), row.i


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = [c for r in docs.collect() for c in plain_chunks.semantic_chunks(str(r.doc_id), r.text or "")]
    got = sections.chunk_notes(docs, "doc_id").collect()
    assert rows_of(r.asDict() for r in got) == rows_of(want)

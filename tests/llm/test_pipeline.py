"""The pipeline's stages on the smallest tables, each against what it was given."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def least_of_near(texts):
    """Least id of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    words = {i: (t or "").translate({c: c + 32 for c in range(65, 91)}).split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {top(i) for i in texts}


def test_stages(spark):
    import corpus_pipeline as cp
    from noteloom.llm import decontaminate, exact_dedup, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    checks = {
        "toxicity": lambda d: {r.doc_id for r in toxicity.toxicity_scores(d, labels).collect() if not r.predicted},
        "exact_dedup": lambda d: {r.doc_id for r in exact_dedup.duplicate_report(d).collect() if r.kept},
        "near_dedup": lambda d: least_of_near({r.doc_id: r.text for r in d.collect()}),
        "decontamination": lambda d: {r.doc_id for r in decontaminate.contamination_report(d, bench).collect() if not r.contaminated},
    }
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        assert ids(out) == checks[name](docs)
        docs = out
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == ids(docs)
    # where a text is cut depends on its neighbours in storage, its ids do not
    tokens = lambda rows: {(p.doc_id, p.doc_tokens) for p in rows}
    assert tokens(cp.run(spark, SF).collect()) == tokens(pieces)
    assert sum(p.length for p in pieces) == sum(n for _, n in tokens(pieces))


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)

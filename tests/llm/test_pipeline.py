"""Every stage of the pipeline on its own input."""

from __future__ import annotations

import itertools

import corpus_pipeline
from clickloom.llm import chat, stages, warc
from clickloom.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
            sizes.append(out.count())
        else:
            assert out.select("doc_id").distinct().count() == sizes[-1]
        docs = out
    assert all(0 < b <= a for a, b in zip(sizes, sizes[1:]))
    assert sizes[2] == sizes[3]


def test_near_copies_stage_links_at_five_words_and_four_fifths(spark):
    def near(name, n, at):
        words = [f"{name}{k}" for k in range(n)]
        return " ".join(words), " ".join([*words[:at], "other", *words[at + 1 :]])

    rows = [(10 * i + k, t) for i, (n, at) in enumerate([(49, 20), (48, 20), (120, 60), (30, 29), (12, 11), (20, 3)]) for k, t in enumerate(near(f"w{i}x", n, at))]
    rows += [(100, rows[0][1].upper()), (101, ""), (102, None), (103, "one two")]

    def shingles(text, n):
        words = (text or "").lower().split()
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())

    def copies(n, percent):
        sets, root = {i: shingles(t, n) for i, t in rows}, {i: i for i, _ in rows}
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
        return {i for i, r in root.items() if i == r}

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in stages.first_of_near_copies(spark, docs, "").collect()}
    assert kept == copies(5, 80) != copies(4, 85)


def test_sql_is_registered():
    from clickloom.llm.registry import ORACLE

    assert ORACLE["op2_chat_format"] == chat.SQL and ORACLE["op9_warc"] == warc.SQL

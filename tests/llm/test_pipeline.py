"""The corpus pipeline, stage by stage, next to brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from usageweave.llm import byte_bpe, quality  # noqa: E402
from usageweave.llm.shared import stored  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_stages(spark, tmp_path):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = df.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, df, FOLDER)
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        df = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = df.collect()
        assert df.columns == columns or name == "byte-level BPE"
    quality, lines, single, mixed, tokens = seen.values()
    assert 0 < len(quality) < 200 and len(lines) == len(quality)
    sets = [shingles(r.text) for r in lines]
    left = {r.doc_id for r in single}
    for r, own in zip(lines, sets):
        near = [s.doc_id for s, other in zip(lines, sets) if alike(own, other)]
        # What went has something like it that stays or that went for something else.
        assert r.doc_id in left or len(near) > 1
        assert min(near) < r.doc_id or r.doc_id in left
    kept = [s for r, s in zip(lines, sets) if r.doc_id in left]
    assert not any(alike(a, b) for i, a in enumerate(kept) for b in kept[:i])
    words = {r.doc_id: len(r.text.encode().split()) for r in single}
    reads = Counter()
    for r in mixed:
        reads[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert all(n <= 3 * words[k] for k, n in reads.items())
    assert abs(sum(reads.values()) - sum(words.values())) <= 20
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text))) for r in mixed)
    assert want == Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in tokens)
    assert all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in tokens)


def test_a_large_group_of_copies_ends_as_one_document(spark):
    from conftest import prose

    def page(i, n_lines=20, menu=True):
        return ["menu one two three"] * menu + [prose(1000 * i + j, 30) for j in range(n_lines)]

    rows = [(i, "\n".join(page(i)), "s") for i in range(12)]
    original = page(50, menu=False)
    rows += [(100 + i, "\n".join(original), "s") for i in range(30)]
    for i in range(30):
        near = list(original)
        for k in (i % 20, (7 * i + 3) % 20):
            near[k] = near[k].replace(near[k].split()[15], f"other{i}", 1)
        rows.append((200 + i, "\n".join(near), "s"))
    docs = spark.createDataFrame(
        [(i, t, "en", s, len(t)) for i, t, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).repartition(3)
    lines = pipeline.drop_common_lines(spark, docs, FOLDER)
    before = {i: t for i, t, _ in rows}
    for r in lines.collect():
        want = before[r.doc_id].replace("menu one two three\n", "")
        assert r.text == want, r.doc_id
    left = {r.doc_id for r in pipeline.drop_near_duplicates(spark, lines, FOLDER).collect()}
    assert left == {*range(12), 100}


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names, stage by
    stage, each on the whole odd table and on none.
    """
    rows = odd_docs.collect()
    for name, stage in pipeline.STAGES:
        got, none = stage(spark, odd_docs, FOLDER), stage(spark, no_docs, FOLDER)
        assert none.count() == 0 and got.columns == none.columns
        out = got.collect()
        if name == "byte-level BPE":
            assert len(out) == len(rows) and all(r.round_trip for r in out)
            assert sum(r.n_tokens == 0 for r in out) == sum(not r.text for r in rows)
            continue
        assert got.columns == odd_docs.columns
        if name == "quality rules":
            short = {r.doc_id for r in rows if len((r.text or "").split()) < 50}
            assert not {r.doc_id for r in out if r.text and len(r.text.split()) < 50}
            assert short and out and {tuple(r) for r in out} <= {tuple(r) for r in rows}
        elif name == "line dedup":
            assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in rows)
        elif name == "n-gram Jaccard join":
            assert sum(not (r.text or "").split() for r in out) == 3
            assert {tuple(r) for r in out} <= {tuple(r) for r in rows}
        else:
            assert all(r.text.split() for r in out)
            assert {r.doc_id for r in out} <= {r.doc_id for r in rows}


def test_quality_stores_no_documents(spark, tmp_path, monkeypatch):
    """What is stored of a document is its key and its counts; it stays for the stages after."""
    seen = []

    def watched(df, name):
        seen.append((name, df))
        return stored(df, name)

    monkeypatch.setattr(quality, "stored", watched)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = pipeline.quality_rules(spark, docs, FOLDER)
    assert 0 < out.count() and out.columns == docs.columns
    assert "quality-features" in [name for name, _ in seen]
    longest = docs.agg(F.max(F.length("text"))).first()[0]
    for _, df in seen:
        assert "n_chars" not in df.schema.simpleString()
        if "_row" in df.columns:
            assert df.agg(F.max(F.length(F.to_json("_row")))).first()[0] < longest / 9

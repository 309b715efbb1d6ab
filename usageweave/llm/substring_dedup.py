"""Substring dedup by compacting a De Bruijn graph of repeated word windows.

Each window of ``k`` words is an edge of the graph, from its first k - 1 words to its last
k - 1. Edges are counted over all documents, and with each count comes whether all
occurrences of the edge have the same edge before them, and behind. Only edges that occur
more than once stay. A stretch of a document along which no edge branches is one row, and
rows of the same words are joined: if they are as many as their edges' count, the stretch
is one compacted path with all its source coordinates, and these prove that it repeats.
Any other stretch is taken apart again, and its windows are compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from usageweave.llm.blocks import (
    MIXED,
    MOST,
    count_keys,
    in_blocks,
    mix,
    whole_windows,
    window_hashes,
    with_totals,
    word_hashes,
)
from usageweave.llm.shared import stored, words


@dataclass(frozen=True)
class SubstringOptions:
    #: Words in a window.
    k: int = 35


STRETCHES = "array<struct<start:int,edges:int,count:int,digest:binary>>"


def _edges(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows in order of texts and words; their ones, and as a tag a short
    fingerprint of the edge behind, or mixed at a text's end.
    """
    hashes, counts = word_hashes(texts)
    whole = whole_windows(counts, k)
    keys = window_hashes(hashes, k)[whole]
    values = np.ones((2, len(keys)), np.uint8)
    values[1, :-1] = (mix(keys[1:]) % np.uint64(MIXED)).astype(np.uint8)
    windows = np.maximum(counts - k + 1, 0)
    values[1, np.cumsum(windows)[windows > 0] - 1] = MIXED
    return keys, values


def _kept(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    """Words removed, and the others joined; spans are sorted by start."""
    out, at, removed = [], 0, 0
    for start, end in spans:
        start = max(start, at)
        if end > start:
            out += words[at:start]
            removed, at = removed + end - start, end
    return removed, b" ".join(out + words[at:])


def _walk(k: int):
    """The work on a block: a row for each document with its stretches."""

    def work(rows, texts, keys, totals):
        counts, behind = totals
        repeated = counts > 1
        n_words, removed, digests, stretches = [], [], [], []
        at = 0
        for text in texts:
            own = text.split()
            size = max(0, len(own) - k + 1)
            places = np.flatnonzero(repeated[at : at + size])
            found = []
            if len(places):
                g = places + at
                # Cut where edges are not neighbours, or the path branches between them.
                cut = (np.diff(places) > 1) | (behind[g[:-1]] == MIXED)
                cut |= counts[g[:-1]] != counts[g[1:]]
                first = np.concatenate(([0], np.flatnonzero(cut) + 1))
                for i, n in zip(first, np.diff(first, append=len(places))):
                    start = int(places[i])
                    content = b" ".join(own[start : start + n + k - 1])
                    found.append(
                        {
                            "start": start,
                            "edges": int(n),
                            "count": int(counts[at + start]),
                            "digest": hashlib.blake2b(content, digest_size=16).digest(),
                        }
                    )
            spans = [(s["start"], s["start"] + s["edges"] + k - 1) for s in found]
            gone, kept = _kept(own, spans)
            n_words.append(len(own))
            removed.append(gone)
            digests.append(hashlib.sha256(kept).hexdigest())
            stretches.append(found)
            at += size
        kind = pa.list_(
            pa.struct(
                [("start", pa.int32()), ("edges", pa.int32()), ("count", pa.int32()), ("digest", pa.binary())]
            )
        )
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "text_key": rows.column("text_key"),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
                "stretches": pa.array(stretches, kind),
            }
        )

    return work


def repeats(docs: DataFrame, options: SubstringOptions = SubstringOptions()) -> DataFrame:
    """For each document of ``docs`` (doc_id, text): doc_id, text_key (a hash of doc_id
    and text), n_words, n_removed (words in windows that start elsewhere, too),
    kept_sha256 (of the other words joined by single spaces) and ``stretches``: where its
    repeated paths begin, how many windows they have and how often they occur (up to 255).

    Null texts have no words; texts shorter than a window have nothing to repeat. Repeated
    rows are documents of their own, so all of their windows repeat. An empty table gives
    an empty one; other columns are left behind.
    """
    k = options.k
    key = F.xxhash64("doc_id", "text")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), key.alias("text_key"))
    blocks, groups = in_blocks(rows, ["doc_id"])
    totals = count_keys(blocks, groups, lambda texts: _edges(texts, k))
    found = stored(
        with_totals(
            blocks,
            totals,
            groups,
            lambda texts: _edges(texts, k),
            _walk(k),
            f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, n_words long, n_removed long, kept_sha256 string,"
            f" stretches {STRETCHES}",
        ),
        "substring-walks",
    )
    each = found.select("text_key", F.explode("stretches").alias("s")).select("text_key", "s.*")
    # Rows with the same words, joined: paths with the coordinates of one occurrence.
    paths = each.groupBy("digest").agg(
        F.count("*").alias("found"),
        F.max("count").alias("most"),
        F.min(F.struct("text_key", "start", "edges")).alias("at"),
    )
    # An edge whose occurrences are spread over several paths has none with its count.
    paths = stored(
        paths.where((F.col("found") != F.col("most")) | (F.col("most") == MOST)).select(
            "found", "at.*"
        ),
        "substring-unproven",
    )
    if paths.where("found = 1").isEmpty():
        return found
    return _compared(rows, found, paths, k)


def _compared(rows: DataFrame, found: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """``found`` without the windows of paths found once that are nowhere else, neither in
    their own nor in another of ``paths``, word by word.
    """
    windows = paths.select(
        "text_key", "found", F.explode(F.expr("sequence(start, start + edges - 1)")).alias("place")
    )
    held = rows.join(paths.select("text_key").distinct(), "text_key", "left_semi")
    held = held.select("text_key", "text").distinct()
    own = held.select("text_key", words(F.col("text")).alias("own"))
    content = F.sha2(F.array_join(F.slice("own", F.col("place") + 1, F.lit(k)), " "), 256)
    each = windows.join(own, "text_key")
    each = stored(
        each.select("text_key", "place", "found", content.alias("content")), "substring-windows"
    )
    alone = each.groupBy("content").agg(F.sum("found").alias("found")).where("found = 1")
    bad = each.join(alone.select("content"), "content", "left_semi")
    bad = stored(
        bad.groupBy("text_key").agg(F.collect_set("place").alias("bad")), "substring-alone"
    )
    if bad.isEmpty():
        return found
    again = (
        found.join(bad, "text_key")
        .join(held, "text_key")
        .select("doc_id", "text_key", "n_words", "text", "stretches", "bad")
    )
    schema = found.schema

    def redo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = (row["text"] or "").encode().split()
                drop = set(row["bad"])
                spans = [
                    (i, i + k)
                    for s in row["stretches"]
                    for i in range(s["start"], s["start"] + s["edges"])
                    if i not in drop
                ]
                gone, kept = _kept(own, spans)
                left = [
                    s
                    for s in row["stretches"]
                    if not drop >= set(range(s["start"], s["start"] + s["edges"]))
                ]
                row |= {"n_removed": gone, "stretches": left}
                row["kept_sha256"] = hashlib.sha256(kept).hexdigest()
                out.append({n: row[n] for n in schema.names})
            if out:
                yield pa.RecordBatch.from_pylist(out, to_arrow_schema(schema))

    fine = found.join(bad, "text_key", "left_anti").select(*schema.names)
    return fine.unionByName(again.mapInArrow(redo, schema))


def remove_repeats(docs: DataFrame, found: DataFrame, k: int = SubstringOptions().k) -> DataFrame:
    """``docs`` with repeated words taken out of ``text`` by the stretches of ``found``, that
    is :func:`repeats` of the same rows.

    Texts without repeats come back with their words joined by single spaces, as all others;
    null and empty texts as empty ones. Repeated rows are all treated alike, and all columns
    come back, whatever their names.
    """
    spans = found.select(F.col("text_key").alias("_key"), "stretches").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.xxhash64("doc_id", "text").alias("_key"))
    kept = F.filter(
        words(F.col("_row.text")),
        lambda w, i: ~F.exists(
            F.col("stretches"),
            lambda s: (i >= s["start"]) & (i < s["start"] + s["edges"] + (k - 1)),
        ),
    )
    joined = rows.join(spans, "_key").withColumn("_text", F.array_join(kept, " "))
    return joined.select(
        *[F.col("_text" if c == "text" else f"_row.`{c}`").alias(c) for c in docs.columns]
    )

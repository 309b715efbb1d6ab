"""Counting hashed keys of whole texts, block by block.

Texts hold many more keys (word windows) than fit a row each. Documents are dealt into
blocks of a few MB; a task turns its block into one sorted array of distinct keys with
their counts, and sends each stretch of it to the group that owns that range of keys. The
groups add up what all blocks sent and send the totals back to the blocks, where the same
keys, worked out again from the same texts, meet them. A key that is in a third of all
texts so takes one entry of each block, and no group grows beyond its share of the keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text in a block, and of text whose keys one group counts.
BLOCK_BYTES = 3_000_000
GROUP_BYTES = 6_000_000
#: Bits of a key. Different windows share one with a chance of one in 2 ** KEY_BITS.
KEY_BITS = 56
#: Totals are counted up to this; a tag that differs between occurrences becomes this.
MOST = MIXED = 255

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.full(1024, _BASE, np.uint64), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _BASE, np.uint64), dtype=np.uint64)
    return _POWERS


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts in order, and how many words each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~_SPACE[data]
    kept = data[inside]
    if lower:
        kept = _LOWER[kept]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # of each word, among kept bytes
    lengths = np.diff(first, append=len(kept))
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    powers = _powers(int(lengths.max()))
    hashes = mix(np.add.reduceat((kept + np.uint64(1)) * powers[place], first))
    ends = np.cumsum([len(t) + 1 for t in texts])
    words = np.searchsorted(at[first], ends)
    return hashes, np.diff(words, prepend=0)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each word on; one less than n words give none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    done, total, power = 0, None, _STEP
    size, part = 1, words
    while size <= n:
        if n & size:
            if total is None:
                total = part
            else:
                m = len(words) - done - size + 1
                total = total[:m] * power + part[done : done + m]
            done += size
        part = part[: len(part) - size] * power + part[size:] if len(part) > size else part[:0]
        power, size = (power.reshape(1) * power)[0], 2 * size
    return mix(total) >> np.uint64(64 - KEY_BITS)


def whole_windows(counts: np.ndarray, n: int) -> np.ndarray:
    """Which of the words that begin a window of ``n`` do so within their own text."""
    total = int(counts.sum())
    if total < n:
        return np.zeros(0, bool)
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(total - n + 1) + n <= ends[: total - n + 1]


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all ``n``-word shingles of the lower-cased texts, and the text each is of, in
    order of texts. A text of fewer words is one shingle as a whole.
    """
    hashes, counts = word_hashes(texts, lower=True)
    whole = whole_windows(counts, n)
    keys = window_hashes(hashes, n)[whole]
    owner = np.repeat(np.arange(len(texts)), np.maximum(counts - n + 1, 0))
    ends = np.cumsum(counts)
    for size in range(1, n):
        (of,) = np.nonzero(counts == size)
        if len(of):
            short = window_hashes(hashes, size)[ends[of] - size]
            short = mix(short + np.uint64(size)) >> np.uint64(64 - KEY_BITS)
            keys, owner = np.concatenate([keys, short]), np.concatenate([owner, of])
    order = np.argsort(owner, kind="stable")
    return keys[order], owner[order]


def set_marks(keys: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """16 bytes for each set, equal for equal sets: two sums of its scrambled keys."""
    ends = np.cumsum(sizes)
    sums = [
        np.concatenate(([0], np.cumsum(mix(keys + np.uint64(k)), dtype=np.uint64)))
        for k in (1, 2)
    ]
    marks = np.stack([s[ends] - s[ends - sizes] for s in sums], axis=1)
    return [m.tobytes() for m in marks]


def in_blocks(docs: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``docs`` (with ``text``) and their ``block``, and the number of key groups.

    Both follow from the bytes of all texts. Documents are dealt out by a hash of
    ``keys`` and the text.
    """
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1
    blocks, groups = -(-size // BLOCK_BYTES), -(-size // GROUP_BYTES)
    block = F.pmod(F.xxhash64(*keys, "text"), F.lit(blocks))
    return docs.withColumn("block", block), groups


def _texts(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def _group_starts(keys: np.ndarray, groups: int) -> np.ndarray:
    """Where each group's stretch of the sorted keys begins, and the end."""
    bounds = [(g << KEY_BITS) // groups for g in range(1, groups)]
    inner = np.searchsorted(keys, np.array(bounds, np.uint64)) if bounds else []
    return np.concatenate(([0], inner, [len(keys)])).astype(np.int64)


def packed(keys: np.ndarray, dropped: int = 0) -> bytes:
    """Keys without their ``dropped`` lowest bytes."""
    return keys.view(np.uint8).reshape(-1, 8)[:, dropped : KEY_BITS // 8].tobytes()


def unpacked(data: bytes, dropped: int = 0) -> np.ndarray:
    width = KEY_BITS // 8 - dropped
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, dropped : KEY_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their values summed up, and where each key went.

    The first row of ``values`` is a count; of any other row a key keeps the common
    value, or :data:`MIXED` where there are several.
    """
    if not len(keys):
        return keys, values, np.zeros(0, np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = np.flatnonzero(new)
    out = np.empty((len(values), len(first)), np.uint8)
    counts = np.add.reduceat(values[0][order].astype(np.int64), first)
    out[0] = np.minimum(counts, MOST)
    for row in range(1, len(values)):
        tags = values[row][order]
        low, high = np.minimum.reduceat(tags, first), np.maximum.reduceat(tags, first)
        out[row] = np.where(low == high, low, MIXED)
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[first], out, at


def _planes(keys: np.ndarray, dropped: int) -> bytes:
    """:func:`packed` sorted keys, all highest bytes first, then all next ones: these hardly
    change from key to key, so what is shuffled shrinks when Spark compresses it.
    """
    return keys.view(np.uint8).reshape(-1, 8)[:, dropped : KEY_BITS // 8].T[::-1].tobytes()


def _from_planes(data: bytes, dropped: int) -> np.ndarray:
    width = KEY_BITS // 8 - dropped
    out = np.zeros((len(data) // width, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out[:, dropped : KEY_BITS // 8] = planes[::-1].T
    return out.view(np.uint64).ravel()


Keys = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def count_keys(docs: DataFrame, groups: int, keys_of: Keys, dropped: int = 0) -> DataFrame:
    """(block, key_group, totals): what all blocks together have of each key of a block,
    one column for each of the block's keys in this group, in their order.

    ``keys_of`` gives the keys of a block's texts, repeats included, and their values:
    a row of counts (ones) and any rows of tags, all unsigned bytes. Counts add up to at
    most :data:`MOST`; of tags the common one or :data:`MIXED` remains. The ``dropped``
    lowest bytes of keys are not sent; they must be zero.
    """

    def send(table: pa.Table) -> pa.Table:
        keys, values, _ = _summed(*keys_of(_texts(table)))
        starts = _group_starts(keys, groups)
        full = np.flatnonzero(np.diff(starts))
        parts = [slice(starts[g], starts[g + 1]) for g in full]
        block = table.column("block")[0].as_py()
        columns = {
            "key_group": pa.array(full, pa.int64()),
            "block": pa.array([block] * len(full), pa.int64()),
            "keys": pa.array([_planes(keys[p], dropped) for p in parts], pa.binary()),
            "values": pa.array([values[:, p].tobytes() for p in parts], pa.binary()),
        }
        return pa.table(columns)

    def add_up(table: pa.Table) -> pa.Table:
        parts = [_from_planes(k, dropped) for k in table.column("keys").to_pylist()]
        sizes = [len(p) for p in parts]
        values = np.concatenate(
            [
                np.frombuffer(v, np.uint8).reshape(-1, n)
                for v, n in zip(table.column("values").to_pylist(), sizes)
            ],
            axis=1,
        )
        _, sums, at = _summed(np.concatenate(parts), values)
        ends = np.cumsum(sizes)
        totals = [sums[:, at[e - n : e]].tobytes() for e, n in zip(ends, sizes)]
        columns = {
            "block": table.column("block"),
            "key_group": table.column("key_group"),
            "totals": pa.array(totals, pa.binary()),
        }
        return pa.table(columns)

    sent = docs.groupBy("block").applyInArrow(
        send, "key_group long, block long, keys binary, values binary"
    )
    return sent.groupBy("key_group").applyInArrow(
        add_up, "block long, key_group long, totals binary"
    )


def with_totals(
    docs: DataFrame,
    totals: DataFrame,
    groups: int,
    keys_of: Keys,
    work: Callable[[pa.Table, list[bytes], np.ndarray, np.ndarray], pa.Table],
    schema: StructType | str,
) -> DataFrame:
    """``work(rows, texts, keys, totals)`` for each block: its rows, their texts, the keys
    that ``keys_of`` gives, and a column of totals for each of them.
    """

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        texts = _texts(rows)
        keys, values = keys_of(texts)
        distinct, _, at = _summed(keys, values)
        sizes = np.diff(_group_starts(distinct, groups))
        found = [values[:, :0]]
        for part in sent.sort_by("key_group").select(["key_group", "totals"]).to_pylist():
            row = np.frombuffer(part["totals"], np.uint8)
            found.append(row.reshape(-1, sizes[part["key_group"]]))
        found = np.concatenate(found, axis=1)
        if found.shape[1] != len(distinct):
            raise ValueError("a block's keys are not those that were counted")
        return work(rows, texts, keys, found[:, at])

    blocks = docs.groupBy("block").cogroup(totals.groupBy("block"))
    return blocks.applyInArrow(run, schema)

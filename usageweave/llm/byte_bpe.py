"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece of text exactly one token can end its encoding. Knowing
the last tokens of all shorter prefixes, the one of the next prefix is the only
vocabulary entry that ends there and may follow the last token before it, so one pass
over the bytes finds the encoding without a merge queue. The table of last tokens makes
appends and edits exact: an append goes on with the table, an edit recomputes it from the
changed byte until it agrees with the old one again.

Spark deals out the documents; each task encodes its rows on its own, in small slices.
The vocabulary is broadcast: its size is that of the rank file, whatever the data.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StructField, StructType

#: Rows a task encodes at a time, and entries of its tables of known texts and pairs.
SLICE_ROWS = 128
KNOWN_TEXTS = 200_000
KNOWN_PAIRS = 500_000
#: Bytes of rows that Spark hands to a task's Python at a time. Ids take several times the
#: space of their text, so a number of rows alone is no bound.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A piece may depend on so many characters behind its end (``'re``; spaces and a word).
REACH = 2
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    """Tokens by id, and for each longer token the two tokens it was merged from."""

    def __init__(self, tokens: list[bytes], left: list[int], right: list[int]) -> None:
        self.tokens, self.left, self.right = tokens, left, right
        self.longest = max(map(len, tokens))
        #: Ids of the tokens that merges can make; -1 in ``left`` marks the others.
        self.ids = {t: i for i, t in enumerate(tokens) if left[i] >= 0}
        self.merged = {
            (a, b): i for i, (a, b) in enumerate(zip(left, right)) if b >= 0 <= a
        }
        #: Tokens as a tree: a token's id or -1, and the branches by their next byte.
        self.tree: tuple[int, dict] = (-1, {})
        nodes = {b"": self.tree[1]}
        for token in sorted(self.ids, key=len):
            at = b""
            for end in range(1, len(token) + 1):
                part = token[:end]
                if part not in nodes:
                    nodes[part] = {}
                    nodes[at][part[-1]] = (self.ids.get(part, -1), nodes[part])
                at = part
        self._pairs: dict[int, bool] = {}

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Vocabulary:
        tokens = [b""] * len(ranks)
        for token, rank in ranks.items():
            tokens[rank] = token
        left, right = [-1] * len(tokens), [-1] * len(tokens)
        for rank, token in enumerate(tokens):
            if len(token) == 1:
                left[rank] = rank
                continue
            parts = [bytes([b]) for b in token]
            while len(parts) > 2:
                found = [
                    (r, i)
                    for i in range(len(parts) - 1)
                    if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank
                ]
                if not found:
                    break
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                left[rank], right[rank] = (ranks[p] for p in parts)
        return cls(tokens, left, right)

    def follows(self, first: int, second: int) -> bool:
        """Whether ``second`` may stand right after ``first`` in an encoding.

        The bytes of both, taken apart again merge by merge from the latest, must never
        show two neighbours that would have been merged earlier.
        """
        pair = first << 32 | second
        known = self._pairs.get(pair)
        if known is not None:
            return known
        if len(self._pairs) >= KNOWN_PAIRS:
            self._pairs.clear()
        a, b, bound = first, second, len(self.tokens)
        while True:
            if self.merged.get((a, b), bound) < bound:
                answer = False
                break
            # Undo the later merge of the two; on a tie the right one was made later.
            a_whole, b_whole = self.right[a] < 0, self.right[b] < 0
            if a_whole and b_whole:
                answer = True
                break
            if b_whole or (not a_whole and a > b):
                bound, a = a, self.right[a]
            else:
                bound, b = b + 1, self.left[b]
        self._pairs[pair] = answer
        return answer


class Piece:
    """Encoding of one piece of text, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _last_of(self, end: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        for start in range(max(0, end - v.longest), end):
            token = v.ids.get(data[start:end])
            if token is not None and (not start or v.follows(last[start], token)):
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def append(self, more: bytes) -> None:
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self._last_of(end))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start`` to ``stop``; the number of prefixes
        whose last token was looked up again.
        """
        old, self.data = self.last, self.data[:start] + new + self.data[stop:]
        self.last, moved, agree = old[: start + 1], stop - start - len(new), 0
        for end in range(start + 1, len(self.data) + 1):
            if agree == self.vocabulary.longest:
                # So many equal last tokens in unchanged bytes settle all that follow.
                self.last += old[end + moved :]
                return end - 1 - start
            self.last.append(self._last_of(end))
            unchanged = end > start + len(new)
            agree = agree + 1 if unchanged and self.last[end] == old[end + moved] else 0
        return len(self.data) - start

    def ids(self) -> list[int]:
        return _walk_back(self.vocabulary, self.last)


def _walk_back(vocabulary: Vocabulary, last: list[int]) -> list[int]:
    out, end, tokens = [], len(last) - 1, vocabulary.tokens
    while end:
        token = last[end]
        out.append(token)
        end -= len(tokens[token])
    return out[::-1]


def encode_piece(vocabulary: Vocabulary, data: bytes) -> list[int]:
    """Ids of a piece, by the same table as :class:`Piece`, filled from the front.

    Once a prefix's last token is known, the tokens that begin behind it are offered to
    the prefixes they end; the first offer that may follow settles a prefix.
    """
    size, follows, root = len(data), vocabulary.follows, vocabulary.tree[1]
    last = [-1] * (size + 1)
    for start in range(size):
        before, branches, end = last[start], root, start
        while end < size and (node := branches.get(data[end])) is not None:
            token, branches = node
            end += 1
            if token >= 0 and last[end] < 0 and (not start or follows(before, token)):
                last[end] = token
    return _walk_back(vocabulary, last)


class _Known(dict):
    """Packed ids by text, for texts met lately: those of this and the last generation."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        packed = self.older.get(text)
        if packed is None:
            packed = self.make(text)
        if len(text) <= 64:
            if len(self) >= KNOWN_TEXTS:
                self.older = dict(self)
                self.clear()
            self[text] = packed
        return packed


class Encoder:
    """Encodes whole texts; each match of ``pattern`` is a piece of its own.

    ``cut_at_spaces`` says that the pattern begins a piece at every space between two
    characters that are not white space, looks at nothing before it, and takes a space
    and letters as one piece, and one mark behind them as another. What lies between such
    spaces is then encoded once for each spelling.
    """

    def __init__(
        self, vocabulary: Vocabulary, pattern: str, cut_at_spaces: bool = True
    ) -> None:
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.cut_at_spaces = cut_at_spaces
        self.pieces = _Known(self._encode_piece)
        self._units = _Known(self._encode_unit)

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ids.get(data)
        ids = [whole] if whole is not None else encode_piece(self.vocabulary, data)
        return np.array(ids, "<u4").tobytes()

    def _encode_unit(self, unit: str) -> bytes:
        """Ids of a space and what follows it up to the next."""
        if unit.isalpha():
            return self.pieces[" " + unit]
        if unit[:-1].isalpha() and unit[-1] in ".,;:!?":
            return self.pieces[" " + unit[:-1]] + self.pieces[unit[-1]]
        return self.encode_pieces(" " + unit)

    def encode_pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not self.cut_at_spaces:
            return self.encode_pieces(text)
        if any(c in text and (c + " " in text or " " + c in text) for c in SPACES):
            first, *units = SINGLE_SPACE.split(text)
        else:
            first, *units = text.split(" ")
        return self.encode_pieces(first) + b"".join(map(self._units.__getitem__, units))

    def decode(self, packed: bytes) -> bytes:
        return Decoder(self.vocabulary.tokens).decode(packed)


class Decoder:
    """Decodes ids; it needs the tokens only, so a task that decodes has no tree and no tables."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.tokens.__getitem__, ids))


class EncodedText:
    """A text with its pieces and ids; edits re-encode the pieces near them only."""

    def __init__(self, encoder: Encoder, text: str) -> None:
        self.encoder, self.text = encoder, text
        self.ends, self.packed = [], []
        for m in encoder.pattern.finditer(text):
            self.ends.append(m.end())
            self.packed.append(encoder.pieces[m[0]])

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.packed), "<u4").tolist()

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> int:
        """Edit the text; the number of pieces encoded again."""
        moved = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        first = bisect_left(self.ends, start - REACH + 1)  # the first that may change
        at = self.ends[first - 1] if first else 0
        ends, packed, old = [], [], len(self.ends)
        for m in self.encoder.pattern.finditer(self.text, at):
            k = bisect_left(self.ends, m.start() - moved)
            if m.start() >= start + len(new) and k < len(self.ends):
                if self.ends[k] == m.start() - moved and k + 1 > first:
                    old = k + 1  # from a common border on, the pieces are the old ones
                    break
            ends.append(m.end())
            packed.append(self.encoder.pieces[m[0]])
        self.ends[first:] = ends + [e + moved for e in self.ends[old:]]
        self.packed[first:] = packed + self.packed[old:]
        return len(ends)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Bpe:
    """The vocabulary at ``path``, with encoding and decoding of DataFrames.

    Batches that Spark hands to Python are bounded by :data:`BATCH_BYTES` from here on in this
    session, unless it sets a bound itself: DataFrames read that setting when they run.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        v = Vocabulary.of_ranks(read_ranks(path))
        self._merges = spark.sparkContext.broadcast((v.tokens, v.left, v.right, pattern))
        self._tokens = spark.sparkContext.broadcast(v.tokens)
        if spark.conf.get(_BATCH, None) is None:
            spark.conf.set(_BATCH, BATCH_BYTES)

    def encode(self, docs: DataFrame, column: str = "text", to: str = "ids") -> DataFrame:
        """``docs`` and the ids of ``column``, packed as little-endian 32-bit integers.

        Null and empty texts have no ids. Each row is encoded for itself, so repeated
        rows stay, an empty table stays empty, and an own column named ``to`` is replaced.
        """
        merges = self._merges
        return self._with(docs, column, to, lambda: _made(merges, _encoder).encode)

    def decode(self, docs: DataFrame, column: str = "ids", to: str = "bytes") -> DataFrame:
        """``docs`` and the bytes of the packed ids in ``column``; null gives none."""
        tokens = self._tokens
        return self._with(docs, column, to, lambda: _made(tokens, Decoder).decode)

    def _with(self, docs: DataFrame, column: str, to: str, made) -> DataFrame:
        kept = [c for c in docs.columns if c != to]
        fields = [docs.schema[c] for c in kept]
        empty = "" if docs.schema[column].dataType.simpleString() == "string" else b""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = made()
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    values = part.column(column).to_pylist()
                    out = [work(empty if x is None else x) for x in values]
                    columns = [part.column(c) for c in kept]
                    names = [*kept, to]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(out, pa.binary())], names=names
                    )

        return docs.mapInArrow(run, StructType([*fields, StructField(to, BinaryType())]))


_made_of: list[tuple[object, object]] = []


def _made(shared, make):
    """What ``make`` makes of a broadcast value: once for each Python worker, and anew for
    another value.
    """
    value = shared.value
    if not _made_of or _made_of[0][0] is not value:
        _made_of[:] = [(value, make(value))]
    return _made_of[0][1]


def _encoder(value) -> Encoder:
    tokens, left, right, pattern = value
    return Encoder(Vocabulary(tokens, left, right), pattern)

"""Secret scan: fixed patterns, and formats learned from what they find.

The patterns of :data:`BASE` label credentials. From a bounded sample of their values, one
probabilistic automaton is inferred for each kind over classes of characters, and one for
ordinary long tokens. Every other long token is scored by all of them: it is reported as
``format`` if it is as likely under a credential's automaton as the labelled ones are,
and far more likely than as an ordinary token.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from usageweave.llm.grammar import Automaton

# Patterns of the base kinds, in the order in which ties are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
BASE = ("assign", "access", "hex")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
TOKEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
HEX = "0123456789abcdef"
#: Symbols of the automata: capitals, hexadecimal and other small letters, digits, signs.
ALPHABET = "UhL0+/_.=-"
CLASSES = str.maketrans(
    TOKEN, "U" * 26 + "h" * 6 + "L" * 20 + "0" * 10 + "+/_.=-"
)
ORDINARY, FORMAT = "ordinary", "format"


@dataclass(frozen=True)
class SecretOptions:
    #: Values the automata are inferred from, for each kind at most, and their length.
    sample: int = 300
    sample_chars: int = 128
    alpha: float = 0.05
    #: Shortest token that is a candidate.
    candidate_chars: int = 12
    #: Labelled values that may be less likely than a candidate, and the least natural
    #: logarithm of the odds against an ordinary token.
    tail: float = 0.01
    least_odds: float = 12.0


def _member(chars: str) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in chars]] = True
    return table


_TOKEN_TABLE, _HEX_TABLE = _member(TOKEN), _member(HEX)


def _runs(inside: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``length``, as (start, end)."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= length
    return list(zip(starts[long].tolist(), ends[long].tolist()))


Span = tuple[int, int, str, int, int]  # start, end, kind, and where its value lies


def scan(text: str, candidate_chars: int) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans by start and kind, and the long tokens that touch none of them."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    spans: list[tuple[int, int, Span]] = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LENGTH:
                spans.append((m.start(), 0, (*m.span(), "assign", *m.span(2))))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LENGTH:
                spans.append((m.start(), 1, (*m.span(), "access", *m.span())))
    # A match is a whole run, so short ones can be passed over.
    for start, end in _runs(_HEX_TABLE[codes], HEX_LENGTH):
        spans.append((start, 2, (start, end, "hex", start, end)))
    found = [s for _, _, s in sorted(spans)]
    return found, _clear_of(found, _runs(_TOKEN_TABLE[codes], candidate_chars))


def _clear_of(spans: list[Span], tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The tokens that touch none of the spans; both by start, looked at in one sweep."""
    if not spans or not tokens:
        return tokens
    left, furthest, i = [], 0, 0
    for start, end in tokens:
        # How far the spans reach that begin before the token's end.
        while i < len(spans) and spans[i][0] < end:
            furthest = max(furthest, spans[i][1])
            i += 1
        if furthest <= start:
            left.append((start, end))
    return left


class Model:
    """Automata of the credential kinds, each with its lowest usual likelihood a symbol."""

    def __init__(self, samples: dict[str, list[str]], options: SecretOptions) -> None:
        self.options = options
        classed = {k: [v.translate(CLASSES) for v in vs] for k, vs in samples.items() if vs}
        made = {k: Automaton.learn(vs, ALPHABET, options.alpha) for k, vs in classed.items()}
        self.ordinary = made.pop(ORDINARY, None)
        self.kinds = []
        for kind, automaton in sorted(made.items()):
            usual = sorted(automaton.log_likelihood(v) / (len(v) + 1) for v in classed[kind])
            self.kinds.append((automaton, usual[int(options.tail * len(usual))]))
        self._known: dict[str, bool] = {}

    def is_secret(self, token: str) -> bool:
        """Whether the token, of whatever characters, has a learned format."""
        classes = token.translate(CLASSES)
        known = self._known.get(classes)
        if known is None:
            if len(self._known) >= 200_000:
                self._known.clear()
            known = self._known[classes] = self._judge(classes)
        return known

    def _judge(self, classes: str) -> bool:
        length = len(classes) + 1
        plain = None if self.ordinary is None else self.ordinary.log_likelihood(classes)
        for automaton, usual in self.kinds:
            found = automaton.log_likelihood(classes)
            if found / length >= usual:
                if plain is None or found - plain >= self.options.least_odds:
                    return True
        return False


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def learn(docs: DataFrame, options: SecretOptions = SecretOptions()) -> Model:
    """Automata from the values that the base patterns find in all of ``docs`` (text).

    The sample of each kind are the distinct values with the smallest checksums, found in
    every task first. Without a labelled value nothing is added to the base spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[str, int]] = {}

        def keep(kind: str, value: str) -> None:
            if len(value) <= options.sample_chars:
                of = least.setdefault(kind, {})
                of[value] = zlib.crc32(value.encode())
                if len(of) > 20 * options.sample:
                    trim(of)

        def trim(of: dict[str, int]) -> None:
            best = sorted((h, v) for v, h in of.items())[: options.sample]
            of.clear()
            of.update((v, h) for h, v in best)

        for batch in batches:
            for text in _texts(batch, "text"):
                spans, tokens = scan(text, options.candidate_chars)
                for span in spans:
                    keep(span[2], text[span[3] : span[4]])
                for start, end in tokens:
                    keep(ORDINARY, text[start:end])
        for of in least.values():
            trim(of)
        rows = [(k, v, h) for k, of in least.items() for v, h in of.items()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            names=["kind", "value", "place"],
        )

    found = docs.select("text").mapInArrow(run, "kind string, value string, place long")
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("place", "value"))
    sample = found.distinct().withColumn("nth", nth).where(F.col("nth") <= options.sample)
    samples: dict[str, list[str]] = {}
    for row in sample.orderBy("kind", "nth").collect():
        samples.setdefault(row["kind"], []).append(row["value"])
    return Model(samples, options)


SPANS = ArrayType(
    StructType(
        [
            StructField("kind", StringType()),
            StructField("start", IntegerType()),
            StructField("end", IntegerType()),
            StructField("text", StringType()),
        ]
    )
)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and ``secrets``: spans of all secrets by start, then kind, with their text.

    Offsets are code points, ends exclusive. Kinds are those of :data:`BASE`, whose spans
    of different kinds may overlap, and ``format``, which overlaps none of them. Null and
    empty texts have none; repeated rows stay, and an own column ``secrets`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "secrets"]
    kind = pa.list_(
        pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        order = {k: i for i, k in enumerate((*BASE, FORMAT))}
        for batch in batches:
            out = []
            for text in _texts(batch, "text"):
                spans, tokens = scan(text, model.options.candidate_chars)
                all_spans = [s[:3] for s in spans]
                all_spans += [
                    (a, b, FORMAT) for a, b in tokens if model.is_secret(text[a:b])
                ]
                all_spans.sort(key=lambda s: (s[0], order[s[2]]))
                out.append(
                    [
                        {"kind": k, "start": a, "end": b, "text": text[a:b]}
                        for a, b, k in all_spans
                    ]
                )
            columns = [*[batch.column(c) for c in kept], pa.array(out, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "secrets"])

    fields = [docs.schema[c] for c in kept]
    return docs.mapInArrow(run, StructType([*fields, StructField("secrets", SPANS)]))

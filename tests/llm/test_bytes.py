"""Byte-level BPE and secrets, next to libraries and plain patterns."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from usageweave.llm import byte_bpe, secret_scan  # noqa: E402
from usageweave.llm.grammar import Automaton  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def encoder(ranks):
    return byte_bpe.Encoder(byte_bpe.Vocabulary.of_ranks(ranks), PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(rnd: random.Random) -> str:
    pools = ["ab", "aab ", "etaoin  \n\t'sre", "0123 ", "éß日😀 \x85 \x1c", "<|endoftext|>"]
    return "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(80)))


def test_ids_are_the_librarys(encoder, library):
    rnd = random.Random(5)
    for _ in range(1500):
        text = random_text(rnd)
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text), text
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_edits_and_appends_equal_encoding_anew(encoder, library):
    rnd = random.Random(6)
    for _ in range(400):
        text, new = random_text(rnd), random_text(rnd)[:9]
        start = rnd.randint(0, len(text))
        stop = rnd.randint(start, len(text))
        edited = byte_bpe.EncodedText(encoder, text)
        edited.replace(start, stop, new)
        edited.append(" end")
        assert edited.text == text[:start] + new + text[stop:] + " end"
        assert edited.ids() == library.encode_ordinary(edited.text)


def test_an_edit_of_a_piece_looks_up_only_what_is_near(encoder):
    data = b"abcde" * 400
    piece = byte_bpe.Piece(encoder.vocabulary, data)
    assert piece.replace(100, 101, b"zz") < 400
    again = byte_bpe.Piece(encoder.vocabulary, data[:100] + b"zz" + data[101:])
    assert piece.last == again.last
    assert piece.ids() == byte_bpe.encode_piece(encoder.vocabulary, piece.data)


def test_frames_keep_rows_and_columns(spark, odd_docs, no_docs, library):
    bpe = byte_bpe.Bpe(spark, PATH, PATTERN)
    out = bpe.decode(bpe.encode(odd_docs), to="size")
    assert out.columns == [*[c for c in odd_docs.columns if c != "size"], "ids", "size"]
    rows = out.select("text", "ids", "size").collect()
    assert len(rows) == odd_docs.count()
    for text, ids, data in rows:
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text or "")
        assert bytes(data) == (text or "").encode()
    assert bpe.encode(no_docs).count() == 0


def brute_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in secret_scan.ASSIGN.finditer(text):
        out += [(m.start(), 0, m.end(), "assign")] if len(m[2]) >= 12 else []
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        out += [(m.start(), 1, m.end(), "access")] if len(m[0]) >= 18 else []
    for m in re.finditer(r"[0-9a-f]+", text):
        out += [(m.start(), 2, m.end(), "hex")] if len(m[0]) >= 16 else []
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(7)
    parts = ["token", "ToKeN", "api_key", "toKen", " = ", ":", '"', "'", "AKIA", "AKIAABCD12345678Z9"]
    parts += ["deadbeef01", "0123456789abcdef", "ABCDEF", "é", "😀", " ", "\n", "passwd", "==", "x"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert [s[:3] for s in secret_scan.scan(text, 12)[0]] == brute_spans(text), text


def test_automaton_prefers_the_format_it_learned():
    rnd = random.Random(8)
    made = ["".join(rnd.choice("0hh") for _ in range(20)) for _ in range(200)]
    a = Automaton.learn(made, secret_scan.ALPHABET)
    assert len(a.table) < 40  # the prefix tree has thousands of states
    assert a.log_likelihood("0hh0" * 5) > a.log_likelihood("LULU" * 5) + 20
    assert Automaton.learn([""], "ab").log_likelihood("") > -1


def test_learned_formats_add_spans(spark, odd_docs, no_docs):
    rnd = random.Random(9)
    keys = ["".join(rnd.choice("abcdefXYZ0123456789") for _ in range(24)) for _ in range(60)]
    rows = [(i, f"some words here token = {k} and internationalisation") for i, k in enumerate(keys)]
    rows.append((99, "bare " + "aX9b3Z0c1Y7d2e4X8f5Za6b1" + " internationalisation"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.learn(docs)
    found = {r.doc_id: r.secrets for r in secret_scan.find(docs, model).collect()}
    assert [s.kind for s in found[3]] == ["assign"]
    assert [(s.kind, s.start, s.text) for s in found[99]] == [("format", 5, rows[-1][1].split()[1])]
    out = secret_scan.find(odd_docs, secret_scan.learn(odd_docs))
    assert out.columns == [*odd_docs.columns, "secrets"]
    for r in out.collect():
        base = [s for s in r.secrets if s.kind != "format"]
        assert [(s.start, s.end, s.kind) for s in base] == brute_spans(r.text or "")
    assert secret_scan.find(no_docs, secret_scan.learn(no_docs)).count() == 0


def test_formats_of_letters_or_digits_only_are_found(spark):
    import string

    rnd = random.Random(10)

    def key(letters, n=14):
        return "".join(rnd.choice(letters) for _ in range(n))

    words = [key(string.ascii_lowercase, 12 + i % 9) for i in range(150)]
    words += [f"{1900 + i}-{1901 + i}-{1902 + i}" for i in range(50)]
    labelled = [key(string.ascii_letters + string.digits) for _ in range(150)]
    labelled += [key(string.digits) for _ in range(50)]
    rows = [(i, f"token = {k} and {words[i]}") for i, k in enumerate(labelled)]
    bare = ["qHVzKdWbYmRXcT", "83920174659201"]
    rows += [(900, f"bare {bare[0]} internationalisation"), (901, f"bare {bare[1]} 1950-1951-1952")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.learn(docs.where("doc_id < 900"))
    found = {r.doc_id: r.secrets for r in secret_scan.find(docs, model).collect()}
    for i, want in zip((900, 901), bare):
        assert [(s.kind, s.start, s.text) for s in found[i]] == [("format", 5, want)]
    assert all([s.kind for s in found[i]] == ["assign"] for i in range(200))

"""Very long texts in the secret scan."""

from __future__ import annotations

import random
import time

from usageweave.llm import secret_scan


def test_tokens_clear_of_spans_equal_brute_force():
    rnd = random.Random(8)
    for _ in range(200):
        spans = sorted((s, s + rnd.randrange(1, 30), "k", 0, 0) for s in rnd.choices(range(300), k=8))
        cuts = sorted(rnd.sample(range(320), 20))
        tokens = list(zip(cuts[::2], cuts[1::2]))
        want = [t for t in tokens if not any(s[0] < t[1] and t[0] < s[1] for s in spans)]
        assert secret_scan._clear_of(spans, tokens) == want


def test_hex_dump_of_five_megabytes():
    rnd = random.Random(9)
    line = "".join(rnd.choice("0123456789abcdef") for _ in range(32))
    text = f"{line} token_{line[:20].upper()}\n" * 85_000
    began = time.monotonic()
    spans, tokens = secret_scan.scan(text, 12)
    assert len(text) > 5_000_000 and len(spans) == 85_000 and len(tokens) == 85_000
    assert time.monotonic() - began < 60

import hashlib
import math

import numpy as np
import pytest
from logsluice.llm import digest


def test_counts_are_the_plain_ones():
    rng = np.random.default_rng(0)
    for n in (0, 4, 5, 6, 300):
        data = rng.integers(0, 256, n).astype(np.uint8)
        plain = [0] * 256
        for i in range(max(0, n - 4)):
            for salt, (a, b, c) in enumerate(digest.TRIPLETS):
                x = int(data[i + a]) | int(data[i + b]) << 8 | int(data[i + c]) << 16
                x = (x + salt * 0x2545F491) * 0x9E3779B1 % (1 << 32)
                x = (x ^ x >> 15) * 0x85EBCA77 % (1 << 32)
                plain[x >> 24] += 1
        assert digest.counts(data).tolist() == plain


def test_blocks_change_nothing(monkeypatch):
    data = np.frombuffer(b"some longer text, some longer text" * (1 << 14), np.uint8)
    assert digest.counts(data).sum() == 6 * (len(data) - 4)


def test_likeness():
    a = digest.digest("the quick brown fox jumps over the lazy dog " * 20)
    assert digest.likeness(a, a) == 1.0
    b = digest.digest("Voici un tout autre texte, écrit dans une autre langue. " * 20)
    assert 0 <= digest.likeness(a, b) < 0.5 and digest.likeness(a, b) == digest.likeness(b, a)
    assert digest.digest(None) == digest.digest("")


@pytest.mark.parametrize("count", [0, 1, 2, 100])
def test_neighbours_against_plain(spark, documents, corpus, count):
    rows = (corpus + [(5000, None), (5001, ""), (5002, "é" * 9), (5003, "word " * 9000)])[-count:] if count else []
    found = {r.doc_id: r for r in digest.with_neighbours(documents(rows)).collect()}
    rows.sort()
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        r = found.pop(key)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digest.digest(text), digest.digest(edited))
        assert r.near_edited == digest.likeness(digest.digest(text), digest.digest(edited))
        assert r.near_next == digest.likeness(digest.digest(text), digest.digest(after))
    assert not found


def test_digest_against_a_plain_one(corpus):
    """Quartiles from a sorted list, codes and digits written out."""
    for text in ["", "a", "abcd", "abcde", "x" * 300, *(t for _, t in corpus[:40])]:
        data = np.frombuffer(text.encode(), np.uint8)
        total = [int(x) for x in digest.counts(data)]
        q1, q2, q3 = (sorted(total)[k] for k in (63, 127, 191))
        length = min(255, round(8 * math.log(1 + len(data))))
        codes = [0 if t <= q1 else 1 if t <= q2 else 2 if t <= q3 else 3 for t in total]
        body = "".join(f"{64 * codes[k] + 16 * codes[k + 1] + 4 * codes[k + 2] + codes[k + 3]:02x}" for k in range(0, 256, 4))
        assert digest.digest(text) == f"{length:02x}{min(15, 16 * q1 // (q3 + 1)):x}{min(15, 16 * q2 // (q3 + 1)):x}{body}"
    assert digest.likeness(digest.digest("a"), digest.digest("b")) == 1.0 and digest.digest("a") == digest.digest("z") != digest.digest("abcdefgh")

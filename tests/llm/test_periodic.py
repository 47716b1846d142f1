import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from logsluice.llm import periodic


def plain(words, least=24, times=3):
    """All maximal stretches of each period; those with a smaller period and the same bounds are out."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def numbers(text):
    ids = {}
    return np.array([ids.setdefault(w, len(ids)) for w in text], np.int64)


def nested(rng, depth, alphabet):
    """A repetition of repetitions, with a change here and there."""
    if depth == 0:
        return [rng.randrange(alphabet) for _ in range(rng.randint(1, 30))]
    part = [w for _ in range(rng.randint(1, 3)) for w in nested(rng, depth - 1, alphabet)]
    out = part * rng.randint(1, 6) + part[: rng.randint(0, len(part))]
    if rng.random() < 0.3:
        out[rng.randrange(len(out))] = rng.randrange(alphabet)
    return out[:1500]


def test_runs_equal_all_stretches():
    rng = random.Random(1)
    for trial in range(250):
        text = nested(rng, rng.randint(1, 3), rng.choice([1, 2, 3, 50]))
        assert periodic.runs(numbers(text), len(text)) == plain(text), trial
    for alphabet in (1, 2):
        for n in (0, 1, 23, 24, 25, 300):
            text = [rng.randrange(alphabet) for _ in range(n)]
            assert periodic.runs(numbers(text), n) == plain(text)


def test_long_periods_of_every_kind():
    rng = random.Random(2)
    for p in [*range(46, 112, 3), 143, 144, 162, 243, 364, 365, 500]:
        for unit in ([*range(p)], [0] * (p - 1) + [1], [0, 1] * (p // 2) + [2], [rng.randrange(2) for _ in range(p)], [0] * (p // 2) + [1] * (p - p // 2)):
            text = [7, 8] + unit * 3 + unit[: rng.randint(0, 3)] + [9]
            assert periodic.runs(numbers(text), len(text)) == plain(text), (p, unit[:5])


def test_equal_hashes_only_propose(monkeypatch):
    """With a hash of few values most proposals are wrong; the runs stay right."""
    real = periodic.SpanHash

    class Poor(real):
        def of(self, starts, ends):
            return super().of(starts, ends) & np.uint64(63)

    monkeypatch.setattr(periodic, "SpanHash", Poor)
    rng = random.Random(3)
    for _ in range(25):
        text = [rng.randrange(9) for _ in range(60)] * 4 + nested(rng, 2, 3)
        assert periodic.runs(numbers(text), len(text)) == plain(text)
    # a sequence on which sums of powers collide for every base
    text = [bin(k).count("1") % 2 for k in range(2048)] * 3
    monkeypatch.undo()
    assert [r for r in periodic.runs(numbers(text), len(text)) if r[2] > 40] == [(0, 6144, 2048)]


def test_bounds_of_parameters():
    with pytest.raises(ValueError, match="24 words"):
        periodic.runs(np.zeros(30, np.int64), 30, least=10)
    assert periodic.sliding_min(np.array([3, 1, 2, 5, 4]), 2).tolist() == [1, 1, 2, 4]


def expected(rows):
    out, sha = [], lambda s: hashlib.sha256(s.encode()).hexdigest()
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = plain(words) if n < 5000 else [(0, n, 1)]
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        out.append((str(key), len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return sorted(out, key=str)


def test_query_and_odd_rows(spark, documents, corpus, odd, tmp_path):
    rng = random.Random(4)
    built = [(1000 + k, " ".join(map(str, nested(rng, 3, 4)))) for k in range(40)]
    rows = [(k, t) for k, t in corpus if len(t or "") < 8000][:80] + built + [r for r in odd if r[1] is None or len(r[1]) < 100] + [(4, "word " * 6000)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic.op11_runs(spark, str(tmp_path)).collect()
    got = sorted(((str(r.doc_id), r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in found), key=str)
    assert got == expected(rows)
    assert periodic.periodic(documents([])).count() == 0

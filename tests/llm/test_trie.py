import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from logsluice.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """All nodes, from rebuilt conversations themselves."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[x] for x in children[p])
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def made(rng, n, longest, texts):
    rows = []
    for c in rng.sample(range(0, 8 * n), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn if rng.random() > 0.02 or turn else None, rng.choice(["user", "assistant"]) if rng.random() > 0.05 else None, rng.choice(texts)))
    return rows


TEXTS = ["a", "b c", "d  e\tf", "", None, "x y z"]


@pytest.mark.parametrize("parts", [1, 13])
def test_nodes_equal_the_rebuilt_texts(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(parts)
        # a long conversation over many ranges, in the middle of a group and as a base
        long = [(c, k, "user", rng.choice(TEXTS)) for c in (41, 60) for k in range(120)]
        copies = [(900 + k, t, "user", x) for k in range(30) for t, x in enumerate(["s", "q"])]
        rows = made(rng, 90, 6, TEXTS) + long + copies + [(60 + k, t, "user", f"{k % 3} {t}") for k in range(1, 20) for t in range(k % 5)]
        df = spark.createDataFrame(rows, SCHEMA).dropDuplicates(["conv_id", "turn"])
        once = [tuple(r) for r in df.collect()]
        assert found(trie.trie(spark.createDataFrame(once, SCHEMA).repartition(3))) == plain(once)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_given_conversations(spark):
    import pandas as pd

    table = pd.read_parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(trie.op13_trie(spark, "/root/testdata/sf0.001")) == plain(list(table.itertuples(index=False, name=None)))


def test_odd_rows(spark, monkeypatch):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    # repeated rows are turns one after the other; columns with names of ours are ignored
    rows = [(c, None, None, None) for c in (0, 0, 7)] + [(7, 1, "user", "a b"), (7, 1, "user", "a b"), (None, 1, "user", "x")] + [(3, 0, "user", "only")] + [(c, 0, "user", "a b") for c in range(100, 140)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS f", "'clash' AS depth", "1 AS words", "'x' AS t", "0 AS n")
    monkeypatch.setattr(trie, "CHUNK", 4)
    assert found(trie.trie(df)) == plain(rows)


def test_equal_hashes_of_different_turns_are_found(spark, monkeypatch):
    """With hashes that tell two turns apart by one seed only, the first seeds are given up."""
    real, seeds = trie._turns, []

    def poor(conversations, heads, seed):
        seeds.append(seed)
        out = real(conversations, heads, seed)
        return out.withColumns({"t": trie.F.lit(5).cast("long"), "u": trie.F.lit(6).cast("long")}) if seed < 2 else out

    monkeypatch.setattr(trie, "_turns", poor)
    rows = [(c, t, "user", f"{c % 4} {t}") for c in range(12) for t in range(3)]
    assert found(trie.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert max(seeds) == 2


def test_chain_of_ranges():
    """Products over any cut of a conversation are those of the whole."""
    rng = random.Random(9)
    turns = [(rng.randrange(-(2**63), 2**63), rng.randrange(-(2**63), 2**63), rng.randrange(9)) for _ in range(40)]
    whole = trie._products(turns)
    for cut in (1, 2, 3, 20, 39):
        said = [{"part": k, "first": 5, "last": 5, "n": len(x), "product": trie._products(x)[-1], "own": x[:3], "first_base": [], "last_n": len(x), "last_product": trie._products(x)[-1], "last_own": x[:3], "last_base": [], "group": 0, "first_group": 0} for k, x in enumerate((turns[:cut], turns[cut:], turns[:1]))]
        chain = trie.chained(said, 3)
        assert tuple(chain[1]["product"]) == whole[cut] and chain[1]["n"] == cut and chain[0]["goes_on"] and chain[1]["own"] == turns[:3]
        assert tuple(chain[2]["product"]) == whole[40]

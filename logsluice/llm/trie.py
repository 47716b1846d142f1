"""The prefix trie of rebuilt conversations, by fingerprints that compose.

A conversation c is rebuilt from the first turns of a base conversation (its head) and its own later turns. No rebuilt text is
ever made: a prefix is a product of turn hashes in a monoid (sum of hash * power of its place, with the length; three
residues of 31 bits), so a rebuilt prefix is head product * own suffix product, and the suffix is own prefix / skipped prefix.

1. Turns become narrow rows (two 64-bit hashes, number of words) and are sorted by range on conversation and turn: a base comes
   right before the conversations that use it, and a long conversation spreads over many ranges. Each range multiplies its
   own turns; the driver chains one product a range and hands each range what came before it.
2. Every prefix of every rebuilt conversation is a row. Nodes are the groups of equal depth and fingerprint. Each row keeps
   a reference to its stored turn; a group must agree in parent and turn hashes, and where its rows refer to turns of different
   conversations, the texts of all turns with these hashes are compared. If two differ, all is done again with another seed.
3. Sums over subtrees need no walk: a node's smallest member never falls from parent to child, so each conversation
   owns the tail of its own path (perhaps none), and every node has one owner. A subtree's nodes are then the tails of its
   members, which is a sum over the members of a node, from one number a conversation.
4. Digests of members that end at a node: sorted by range, joined to chunks, and one hash over the chunks of a node in order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

EVERY, HEADS = 20, 4
#: Residues and multipliers of the three products.
PRIMES, FACTORS = (2147483647, 2147483629, 2147483587), (1103515245, 1664525, 69069)
#: Distinct turn hashes up to which those to be compared are broadcast (16 bytes each).
FEW = 1_000_000
#: Conversation ids in a chunk of a node's list.
CHUNK = 8192
_KEY = ["depth", "f", "g"]


def _power(m: int, k: np.ndarray, p: int) -> np.ndarray:
    out, base, k = np.ones(len(k), np.int64), m, k.copy()
    while k.any():
        out = np.where(k & 1, out * base % p, out)
        base, k = base * base % p, k >> 1
    return out


def _residues(t: np.ndarray, u: np.ndarray) -> list[np.ndarray]:
    return [np.mod(x, p) for x, p in zip((t, u, t ^ (u >> 7)), PRIMES)]


def _products(turns: list[tuple[int, int, int]]) -> list[tuple[int, ...]]:
    """Of the first 0, 1, ... of a few turns: the three products, and the words."""
    out = [(0, 0, 0, 0)]
    for k, (t, u, w) in enumerate(turns):
        v = [int(x[0]) for x in _residues(np.array([t]), np.array([u]))]
        out.append((*[(a + x * pow(m, k, p)) % p for a, x, m, p in zip(out[-1], v, FACTORS, PRIMES)], out[-1][3] + w))
    return out


def _turns(conversations: DataFrame, heads: int, seed: int) -> DataFrame:
    """(conv_id, turn, role, text, h, t, u, words), without rows that belong to no conversation."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role").alias("role"), empty("text").alias("text"))
    hashes = {x: F.xxhash64(F.lit(2 * seed + k), "role", "text") for k, x in enumerate("tu")}
    return out.withColumns({"h": (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int"), **hashes, "words": F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")})


_LOCAL = "part int, conv_id long, h int, k long, t long, u long, words long, l1 long, l2 long, l3 long, lw long, s1 long, s2 long, s3 long, sw long, bn int, b1 long, b2 long, b3 long, bw long, open boolean, last boolean, head_t array<long>, head_u array<long>, head_w array<long>, summary string"
_ARROW = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("h", pa.int32()), *[(c, pa.int64()) for c in ("k", "t", "u", "words", "l1", "l2", "l3", "lw", "s1", "s2", "s3", "sw")], ("bn", pa.int32()), *[(c, pa.int64()) for c in ("b1", "b2", "b3", "bw")], ("open", pa.bool_()), ("last", pa.bool_()), *[(c, pa.list_(pa.int64())) for c in ("head_t", "head_u", "head_w")], ("summary", pa.string())])


class _Range:
    """Goes over one range in order. What depends on earlier ranges is marked open, and told in a summary."""

    def __init__(self, part: int, every: int, most: int) -> None:
        self.part, self.every, self.most = part, every, most
        self.conv: int | None = None
        self.first: int | None = None

    def _enter(self, conv: int) -> None:
        group = conv - conv % self.every
        if self.conv is None:
            self.first, self.first_group = conv, group
        if self.conv is None or group != self.group:
            self.group, self.base = group, []
        self.conv, self.n, self.product, self.own = conv, 0, (0, 0, 0, 0), []

    def _leave(self) -> None:
        if self.conv == self.first:
            self.first_said = {"n": self.n, "product": self.product, "own": self.own}
        if self.group == self.first_group:
            self.first_base = self.base

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        conv, h, t, u, w = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
        n = len(conv)
        new = np.flatnonzero(np.concatenate([[self.conv is None or conv[0] != self.conv], conv[1:] != conv[:-1]]))
        starts = new if len(new) and new[0] == 0 else np.concatenate([[0], new])
        sizes = np.diff(np.concatenate([starts, [n]]))
        before = np.zeros((len(starts), 5), np.int64)  # rows, products and words before the batch
        skip, base = np.zeros((len(starts), 4), np.int64), np.zeros((len(starts), 5), np.int64)
        opened = np.zeros(len(starts), bool)
        heads: list[list[tuple[int, int, int]]] = []
        k = np.arange(n) - np.repeat(starts, sizes)
        if not (len(new) and new[0] == 0):
            before[0] = [self.n, *self.product]
            k[: sizes[0]] += self.n
        values = [*_residues(t, u), w]
        terms = [v * _power(m, k, p) % p for v, m, p in zip(values, FACTORS, PRIMES)] + [w]
        sums = []
        for x, (term, p) in enumerate(zip(terms, [*PRIMES, 0])):
            whole = np.cumsum(term)
            whole = whole - np.repeat(whole[starts] - term[starts], sizes) + np.repeat(before[:, 1 + x], sizes)
            sums.append(whole % p if p else whole)
        for j, (at, size) in enumerate(zip(starts.tolist(), sizes.tolist())):
            if self.conv is None or int(conv[at]) != self.conv:
                if self.conv is not None:
                    self._leave()
                self._enter(int(conv[at]))
            for i in range(at, min(at + size, at + max(0, self.most - len(self.own)))):
                self.own.append((int(t[i]), int(u[i]), int(w[i])))
                if self.conv == self.group:
                    self.base = self.own
            self.n += size
            self.product = tuple(int(x[at + size - 1]) for x in sums)
            own, theirs = _products(self.own[: int(h[at])]), _products(self.base[: int(h[at])])
            skip[j], base[j] = own[-1], (len(theirs) - 1, *theirs[-1])
            opened[j] = self.group == self.first_group
            heads.append(self.base[: int(h[at])])
        last = np.zeros(n, bool)
        ends = (starts + sizes - 1)[:-1]
        last[ends] = True
        last[n - 1] = True  # unless the conversation goes on: the next batch or range tells
        listed = [[None] * n for _ in range(3)]
        for at, turns in zip((starts + sizes - 1).tolist(), heads):
            for x in range(3):
                listed[x][at] = [turn[x] for turn in turns]
        spread = lambda x: np.repeat(x, sizes)
        columns = [np.full(n, self.part), conv, h, k, t, u, w, *sums, *[spread(x) for x in skip.T], *[spread(x) for x in base.T], spread(opened), last, *listed, [None] * n]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ARROW)], schema=_ARROW)

    def summary(self) -> pa.RecordBatch:
        self._leave()
        said = {"part": self.part, "first": self.first, **self.first_said, "first_base": self.first_base, "last": self.conv, "last_n": self.n, "last_product": self.product, "last_own": self.own, "last_base": self.base, "group": self.group, "first_group": self.first_group}
        row = [{f.name: None for f in _ARROW} | {"part": self.part, "summary": json.dumps(said)}]
        return pa.RecordBatch.from_pylist(row, _ARROW)


def _local(every: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, held = _Range(TaskContext.get().partitionId(), every, most), None
        for batch in batches:
            if not batch.num_rows:
                continue
            goes_on = one.conv is not None and one.conv == batch.column(0)[0].as_py()
            if held is not None:
                yield _goes_on(held) if goes_on else held
            held = one.rows(batch)
        if held is not None:
            yield held
            yield one.summary()

    return run


def _goes_on(batch: pa.RecordBatch) -> pa.RecordBatch:
    at = batch.schema.get_field_index("last")
    last = batch.column(at).to_numpy(zero_copy_only=False).copy()
    last[-1] = False
    return batch.set_column(at, _ARROW.field("last"), pa.array(last))


def chained(summaries: list[dict], most: int) -> dict[int, dict]:
    """For each range what came before it: rows, products and first turns of its first conversation, first turns of its base,
    and whether its last conversation goes on in the next range. One small step a range."""
    out: dict[int, dict] = {}
    conv = group = before = None
    n, product, own, base = 0, (0, 0, 0, 0), [], []
    for s in sorted(summaries, key=lambda s: s["part"]):
        if s["first"] != conv:
            n, product, own = 0, (0, 0, 0, 0), []
        elif before is not None:
            out[before]["goes_on"] = True
        if s["first_group"] != group:
            base = []
        whole_own, whole_base = (own + s["own"])[:most], (base + s["first_base"])[:most]
        out[s["part"]] = {"first": s["first"], "n": n, "product": product, "own": whole_own, "base": whole_base, "goes_on": False}
        if s["first"] == s["last"]:
            product = (*[(a + b * pow(m, n, p)) % p for a, b, m, p in zip(product, s["product"], FACTORS, PRIMES)], product[3] + s["product"][3])
            n, own = n + s["n"], whole_own
        else:
            n, product, own = s["last_n"], tuple(s["last_product"]), s["last_own"]
        base = whole_base if s["group"] == s["first_group"] else s["last_base"]
        conv, group, before = s["last"], s["group"], s["part"]
    return out


_PREFIX = "conv_id long, depth long, f long, g long, pf long, pg long, t long, u long, ref long, words long, before long, ends boolean"
_PREFIX_NAMES = [x.split()[0] for x in _PREFIX.split(", ")]


def _prefixes(chain: dict[int, dict], every: int):
    def key(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return x[0] << 31 | x[1], x[2]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = {f: batch.column(k).to_numpy(zero_copy_only=False) for k, f in enumerate(_ARROW.names[:20])}
        part, conv, h, k, t, u, w, bn = (c[x].astype(np.int64) for x in ("part", "conv_id", "h", "k", "t", "u", "words", "bn"))
        sums, skip, base = ([c[f"{x}{y}"].astype(np.int64) for y in (1, 2, 3, "w")] for x in "lsb")
        opened, last = (batch.column(x).to_numpy(zero_copy_only=False).copy() for x in (20, 21))
        heads = {i: list(zip(*(batch.column(x)[i].as_py() for x in (22, 23, 24)))) for i in np.flatnonzero(last).tolist()}
        for p in np.unique(part[opened]).tolist():
            said = chain[p]
            ours = np.flatnonzero(opened & (part == p))
            goes = ours[conv[ours] == said["first"]]
            # own * what follows: the earlier rows' product comes first
            for x, (m, q) in enumerate(zip(FACTORS, PRIMES)):
                sums[x][goes] = (said["product"][x] + sums[x][goes] * pow(m, said["n"], q)) % q
            sums[3][goes] += said["product"][3]
            k[goes] += said["n"]
            own, theirs = _products(said["own"]), _products(said["base"])
            for x in range(4):
                skip[x][goes] = np.array([own[min(i, len(own) - 1)][x] for i in h[goes].tolist()], np.int64)
                base[x][ours] = np.array([theirs[min(i, len(theirs) - 1)][x] for i in h[ours].tolist()], np.int64)
            bn[ours] = np.minimum(h[ours], len(theirs) - 1)
            for i in ours[last[ours]].tolist():
                heads[i] = said["base"][: int(h[i])]
        for p in np.unique(part).tolist():
            if chain[p]["goes_on"]:  # only the last row of a range, which is of its last conversation, can be meant
                last &= ~((part == p) & (conv == chain[p]["last_conv"]) & last)
        mine = k >= h
        powers = [_power(m, k, q) for m, q in zip(FACTORS, PRIMES)]
        upto, above = [], []
        for x, (m, q) in enumerate(zip(FACTORS, PRIMES)):
            shift = _power(m, bn, q) * _power(pow(m, -1, q), h, q) % q
            whole = (sums[x] - skip[x]) % q
            less = (whole - _residues(t, u)[x] * powers[x]) % q
            upto.append((base[x] + whole * shift) % q)
            above.append((base[x] + less * shift) % q)
        (f, g), (pf, pg) = key(upto), key(above)
        depth, before = bn + k - h + 1, base[3] + sums[3] - w - skip[3]
        first = depth == 1
        pf, pg = np.where(first, 0, pf), np.where(first, 0, pg)
        own = [x[mine] for x in (conv, depth, f, g, pf, pg, t, u, conv, w, before, last)]
        more: list[tuple] = []
        for i in np.flatnonzero(last).tolist():
            turns, whole = heads[i], bool(k[i] < h[i])  # no own turn is left: the head is all there is
            of = _products(turns)
            code = [(a[0] << 31 | a[1], a[2]) for a in of]
            cid = int(conv[i])
            more.append((cid, 0, 0, 0, -1, -1, 0, 0, -1, 0, 0, whole and not turns))
            for d, (tt, uu, ww) in enumerate(turns, 1):
                more.append((cid, d, *code[d], *code[d - 1], tt, uu, cid - cid % every, ww, of[d - 1][3], whole and d == len(turns)))
        columns = [np.concatenate([a, np.array(b, a.dtype)]) for a, b in zip(own, zip(*more))] if more else own
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], _PREFIX_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(batch)

    return run


def prefixes(conversations: DataFrame, every: int = EVERY, heads: int = HEADS, seed: int = 0) -> DataFrame:
    """A written row for each prefix of each rebuilt conversation, the empty one included."""
    spark, most = conversations.sparkSession, heads - 1
    order = ["conv_id", "turn", "role", "t", "n"]
    narrow = written(_turns(conversations, heads, seed).drop("text").withColumn("n", F.monotonically_increasing_id()), "turns")
    ranges = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "h", "t", "u", "words")
    local = written(ranges.mapInArrow(_local(every, most), _LOCAL), "ranges")
    said = [json.loads(r.summary) for r in local.filter("summary IS NOT NULL").select("summary").collect()]  # one a range
    chain = chained(said, most)
    for s in said:
        chain[s["part"]]["last_conv"] = s["last"]
    return written(local.filter("summary IS NULL").mapInArrow(_prefixes(chain, every), _PREFIX), "prefixes") if said else spark.createDataFrame([], _PREFIX)


def _equal(nodes: DataFrame, conversations: DataFrame, heads: int, seed: int) -> bool:
    """Whether all members of each node agree: in parent and turn hashes, and where they refer to several conversations, in the
    words of all turns with these hashes."""
    if not nodes.filter("pf <> pf2 OR pg <> pg2 OR t <> t2 OR u <> u2").isEmpty():
        return False
    asked = written(nodes.filter("ref <> ref2").select("t", "u").distinct(), "asked")
    turns = _turns(conversations, heads, seed).select("t", "u", "role", "text")
    if asked.count() <= FEW:
        turns = turns.join(F.broadcast(asked), ["t", "u"], "left_semi")
    ends = turns.groupBy("t", "u").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("a", F.min), ("z", F.max)) for c in ("role", "text")])
    return ends.filter("a_role <> z_role OR a_text <> z_text").isEmpty()


def _digests(rows: DataFrame) -> DataFrame:
    """(depth, f, g, ends_sha256): of each node's conversation ids in order, joined by commas. Ids are joined to chunks range by
    range; what reaches one node's hash is a row a chunk, read one after the other."""
    schema = "depth long, f long, g long, first long, ids string"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d, f, g, conv = (batch.column(k).to_numpy() for k in range(4))
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (f[1:] != f[:-1]) | (g[1:] != g[:-1])]))
            new = np.unique(np.concatenate([new, np.arange(0, len(d), CHUNK)]))
            ids = conv.tolist()
            joined = [",".join(map(str, ids[a:b])) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(d)])]
            yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (d, f, g, conv)] + [pa.array(joined, pa.string())], ["depth", "f", "g", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        out: list[tuple] = []
        for batch in batches:
            for d, f, g, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if (d, f, g) == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (d, f, g), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*_KEY, "ends_sha256"])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], [*_KEY, "ends_sha256"])

    order = [*_KEY, "conv_id"]
    pieces = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, schema)
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(hashed, "depth long, f long, g long, ends_sha256 string")


def trie(conversations: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Conversation c is rebuilt from the first h turns of conversation c - c % every (all if fewer, none if absent) and its own turns
    after its first h, where h is crc32(decimal c) % heads. Turns go by turn, nulls first; equal ones by role, then by a hash of
    their text, and repeated rows one after the other. A null role or text is empty; rows without a conv_id belong
    to no conversation. Every conversation is a member of the root, even without turns. An empty table has no nodes.
    Extra columns are ignored.
    """
    for seed in range(8):
        paths = prefixes(conversations, every, heads, seed)
        several = ("pf", "pg", "t", "u", "ref")
        groups = paths.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), (F.count("*") == F.count_if("ends")).alias("leaf"), F.max("words").alias("words"), *[F.min(c).alias(c) for c in several], *[F.max(c).alias(f"{c}2") for c in several])
        nodes = written(groups, "nodes")
        if _equal(nodes, conversations, heads, seed):
            break
    else:
        raise RuntimeError("different turns had equal hashes with every seed")
    # What a conversation owns: the tail of its path whose nodes have it as smallest member.
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.sum("words").alias("own_words"), F.count_if("leaf").alias("leaves"))
    convs = paths.filter("ends").select("conv_id", (F.col("depth") + 1).alias("times"), (F.col("before") + F.col("words")).alias("all_words"))
    convs = written(convs.join(owned, "conv_id", "left"), "convs")
    total = convs.agg(F.sum("times")).first()[0] or 0
    rows = join_counted(paths.select("conv_id", *_KEY, "pf", "pg", "before"), convs, ["conv_id"], total)
    foreign = F.when(F.col("since").isNull() | (F.col("depth") < F.col("since")), F.col("all_words") - F.col("before") - F.coalesce("own_words", F.lit(0))).otherwise(0)
    sums = written(rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.min("pf").alias("pf"), F.min("pg").alias("pg"), F.count("*").alias("n_convs"), F.sum(F.coalesce("leaves", F.lit(0))).alias("n_leaves"), F.sum(foreign).alias("saved_tokens")), "sums")
    children = sums.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pf").alias("f"), F.col("pg").alias("g")).agg(F.count("*").alias("n_children"))
    parents = written(sums.select(*_KEY, F.col("conv_id").alias("parent_conv_id")).join(children, _KEY), "parents")
    up = parents.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("pf"), F.col("g").alias("pg"), "parent_conv_id", F.col("n_children").alias("times"))
    below = join_counted(sums.filter("depth > 0"), up, ["depth", "pf", "pg"], sums.count())
    every_node = below.unionByName(sums.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = every_node.join(parents.select(*_KEY, "n_children"), _KEY, "left").join(_digests(paths.filter("ends")), _KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

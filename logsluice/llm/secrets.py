"""Secret scans: exact base patterns, and a linear-chain conditional random field over the text's tokens.

Tokens are runs without white space, quotes and separating punctuation. Each is tagged B (a secret begins), I (inside) or
O. A token's features are categories: its shape (length, kinds of characters, how often digits and letters or small letters and
capitals take turns, vowels, hexadecimal digits alone), what stands right before and after it, the shapes of its neighbours, where the
nearest telling word is among the three tokens before and the two after it, and its file (how much of the text is digits and
signs, whether telling words occur at all). What speaks for B against O, and for I against O, is the sum of a weight of its own
for each feature; states follow each other by a transition table in which I never follows O. So two secrets side by side
are two spans where the second looks like a beginning.

There are no labels for secrets. The field is fitted to a bounded sample of texts (SAMPLE with a telling word, SAMPLE without, the
least by a hash of the text), in which the base patterns' finds are tagged, and secrets of other kinds (llm/planted.py) are set at
random places or side by side in lists, as are numbers, names and phrases that look like secrets and are none. In half of the base finds the telling
word is replaced by another, so that the shape of what follows has to do. So the field goes on to secrets that the patterns miss.

Decoding is Viterbi's and exact, and cheap: where no stretch of tokens around one could gain anything over O, it is O, and only
the stretches between such tokens need the dynamic program.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches, texts_of, written
from .planted import LISTED, SECRETS, planted

KINDS = ("assign", "access", "hex", "crf")
SAMPLE = 1500
B, I, O, UNKNOWN = 0, 1, 2, 3  # noqa: E741
# Fixed values of the base patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
TELLING = ("passw", "secret", "token", "apikey", "api_key", "api key", "credential", "private key", "bearer", "pwd", "passphrase", "passcode", "auth_key", "access_key", "access key", "client key", "authorization")
_TELLS = re.compile("|".join(TELLING))
#: Windows of tokens that the field is fitted on, at most.
WINDOWS = 6000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind, in order of start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    points = _points(text)
    hexes = _HEX[np.minimum(points, 255)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hexes, [0]]).astype(np.int8)))
    long = edges[1::2] - edges[::2] >= LEAST["hex"]
    found += [(int(a), int(b), "hex") for a, b in zip(edges[::2][long], edges[1::2][long])]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def _table(chars: str, size: int = 256) -> np.ndarray:
    found = np.zeros(size, bool)
    found[[ord(c) for c in chars]] = True
    return found


_HEX = _table("0123456789abcdef")
_PARTS = _table("".join(map(chr, range(33))) + "\"'`,;:(){}[]<>|!#$%&*?=@\x7f\x85\xa0")
_QUOTE, _ASSIGN, _LINE = _table("\"'`"), _table("=:"), _table("\n\r")
_DIGIT, _UPPER, _LOWER = _table("0123456789"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
#: By character, in 32-bit lanes: digits and capitals; small letters and signs; vowels and the letters A to F. Others (over 255) count as none.
_LANES = np.zeros((3, 256), np.uint64)
_LANES[0, _DIGIT] = 1
_LANES[0, _UPPER] = 1 << 32
_LANES[1, _LOWER] = 1
_LANES[1, _table("+/_-.~^")] = 1 << 32
_LANES[2, _table("aeiouyAEIOUY")] = 1
_LANES[2, _table("bcdfBCDF")] = 1 << 32
_LANES[2, _table("aeAE")] |= np.uint64(1 << 32)
_HALF, _MASK = np.uint64(32), np.uint64((1 << 32) - 1)

#: Values of each feature: length, kinds of characters, turns of digits, turns of case, vowels, hexadecimal, before, after, telling
#: word before, telling word after, class of the token before, of the one after, file, own class with what tells of it.
SIZES = (9, 32, 5, 4, 4, 2, 5, 5, 4, 2, 6, 6, 4, 24)


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, and their feature values (tokens x features)."""
    points = _points(text)
    low = np.minimum(points, 255).astype(np.uint8)
    parts = _PARTS[low]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], parts, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        return starts, ends, np.zeros((0, len(SIZES)), np.int64)
    lanes = [np.add.reduceat(_LANES[k][low], starts) for k in range(3)]
    size = ends - starts
    digits, capitals, small, signs, vowels, to_f = (x.astype(np.int64) for lane in lanes for x in (lane & _MASK, lane >> _HALF))
    letters = capitals + small
    turn = np.zeros(len(points), np.uint64)
    digit = _DIGIT[low]
    turn[1:] = (digit[1:] != digit[:-1]).astype(np.uint64) + ((_UPPER[low[1:]] & _LOWER[low[:-1]]).astype(np.uint64) << _HALF)
    turn[parts] = 0
    turn[starts] = 0
    turns = np.add.reduceat(turn, starts)
    swings = (turns >> _HALF).astype(np.int64)
    turns = (turns & _MASK).astype(np.int64)
    found = np.zeros((n, len(SIZES)), np.int64)
    found[:, 0] = np.digitize(size, [4, 6, 8, 12, 16, 20, 32, 48])
    found[:, 1] = (digits > 0) + 2 * (capitals > 0) + 4 * (small > 0) + 8 * (signs > 0) + 16 * (digits + letters + signs < size)
    found[:, 2] = np.digitize(turns, [1, 2, 4, 7])
    found[:, 3] = np.minimum(swings, 3)
    found[:, 4] = np.where(letters == 0, 0, 1 + np.digitize(vowels / np.maximum(letters, 1), [0.16, 0.3]))
    found[:, 5] = (digits > 0) & (to_f > 0) & (digits + to_f == size)
    padded = np.concatenate([[10] * 3, low, [10]]).astype(np.uint8)
    one, two, three = (padded[starts + k] for k in (2, 1, 0))
    quoted = _QUOTE[one] | _QUOTE[two] & (one == 32)
    assigned = _ASSIGN[one] | _ASSIGN[two] & (quoted | (one == 32)) | _ASSIGN[three] & quoted & (two == 32)
    found[:, 6] = np.where(_LINE[one], 4, quoted + 2 * assigned)
    after = padded[ends + 3]
    found[:, 7] = np.select([after == 32, _QUOTE[after], after == 64, _LINE[after]], [0, 1, 2, 3], 4)
    mixed = (digits > 0) & (letters > 0)
    own = np.select([mixed & (size >= 20), mixed & (size >= 8), mixed, digits > 0, (swings > 1) | (signs > 0) & (size >= 16) | (letters >= 24)], [4, 3, 2, 1, 5], 0)
    found[1:, 10], found[:-1, 11] = own[:-1], own[1:]
    folded = text.lower()
    folded = folded if len(folded) == len(text) else text
    telling = np.zeros(n + 5, bool)
    tells = any(w in folded for w in TELLING)
    if tells:
        at = [m.end() - 1 for m in _TELLS.finditer(folded)]
        telling[3 + np.searchsorted(starts, at, side="right") - 1] = True
        found[:, 8] = np.select([telling[2 : n + 2], telling[1 : n + 1], telling[:n]], [1, 2, 3], 0)
        found[:, 9] = telling[4 : n + 4] | telling[5 : n + 5]
    odd = (digits.sum() + signs.sum()) * 20 > size.sum()
    found[:, 12] = int(odd) + 2 * tells
    found[:, 13] = 4 * own + 2 * (found[:, 8] > 0) + (assigned | quoted)
    return starts, ends, found


_CLOSED = -1e9  # the score of what may not be


class Field:
    """weights: for each feature, values x 2, the weights of each value for B and for I against O; links: 3 x 3, from a state to the next; first: 3."""

    def __init__(self, weights: list[np.ndarray], links: np.ndarray, first: np.ndarray) -> None:
        self.weights, self.links, self.first = weights, links, first
        # A stretch of states other than O between two O gains no more over O than the greater of score + inner (of B, of I) for each token, and outer once.
        enter = max(float(links[O, B] - links[O, O]), float(first[B] - first[O]))  # I never begins one
        self.inner = links[:2, :2].max(axis=0) - links[O, O]
        self.outer = enter + max(float((links[:2, O] - links[O, O]).max()), 0.0) - float(self.inner[B])

    def scores(self, found: np.ndarray) -> np.ndarray:
        """How much speaks for B and for I, by token."""
        return sum(w[found[:, k]] for k, w in enumerate(self.weights))

    def viterbi(self, scores: np.ndarray, first: np.ndarray, last: np.ndarray | None = None) -> list[int]:
        own = np.column_stack([scores, np.zeros(len(scores))])
        best, back = first + own[0], []
        for s in own[1:]:
            step = best[:, None] + self.links
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + s
        if last is not None:
            best = best + last
        state = [int(best.argmax())]
        for b in reversed(back):
            state.append(int(b[state[-1]]))
        return state[::-1]

    def tags(self, found: np.ndarray) -> np.ndarray:
        """The best sequence of states."""
        tags = np.full(len(found), O)
        scores = self.scores(found)
        # The most that any stretch with a token in it can gain: sums up to it and from it on, less the least sum before or after.
        sums = np.concatenate([[0.0], np.cumsum((scores + self.inner).max(axis=1))])
        most = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
        open_ = np.flatnonzero(most + self.outer >= -1e-6)
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []:
            a, b = int(run[0]), int(run[-1]) + 1
            tags[a:b] = self.viterbi(scores[a:b], self.links[O] if a else self.first, self.links[:, O] if b < len(found) else None)
        return tags

    def spans(self, text: str) -> list[tuple[int, int]]:
        starts, ends, found = tokens(text)
        if not len(found):
            return []
        tags, out = self.tags(found), []
        for i in np.flatnonzero(tags != O).tolist():
            if tags[i] == I and out and out[-1][2] == i - 1:
                out[-1] = (out[-1][0], int(ends[i]), i)
            else:
                out.append((int(starts[i]), int(ends[i]), i))
        return [(a, b) for a, b, _ in out]


def windows_of(sequences: list[tuple[np.ndarray, np.ndarray]], width: int, most: int) -> dict[bytes, int]:
    """How often each window of width tokens comes: those with secrets first, then those with odd or told tokens; most of them, in order.

    Windows with a token of an unknown tag do not count.
    """
    parts: tuple[dict[bytes, int], dict[bytes, int]] = {}, {}
    for found, tags in sequences:
        if not len(found):
            continue
        odd = (tags != O) | (found[:, 13] >= 4) | (found[:, 8] > 0)
        odd[1:] |= tags[:-1] != O
        at = np.unique(np.append(np.flatnonzero(odd) // (width // 2), 0)) * (width // 2)
        begins = np.maximum.accumulate(np.where(tags == I, 0, np.arange(len(tags))))
        for i in np.unique(begins[at]):  # a window that would begin inside a secret begins with it
            w = np.full((width, len(SIZES) + 1), -1, np.int64)
            part = np.column_stack([found, tags])[i : i + width]
            if (part[:, -1] == UNKNOWN).any():
                continue
            w[: len(part)] = part
            into = parts[int((part[:, -1] == O).all())]
            key = w.tobytes()
            if key in into or len(into) < most // 2:
                into[key] = into.get(key, 0) + 1
    return parts[0] | parts[1]


def likelihood(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, live: np.ndarray, times: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The windows' log likelihood under weights, links and first (params, in this order), and its gradients, by forward-backward."""
    *weights, links, first = params
    width, eye = x.shape[1], np.eye(3)
    s = np.zeros((*x.shape[:2], 3))
    s[:, :, :2] = sum(w[x[:, :, k]] for k, w in enumerate(weights)) * live[:, :, None]
    logsum = lambda v, axis: np.log(np.exp(v - v.max(axis=axis, keepdims=True)).sum(axis=axis)) + v.max(axis=axis)
    ahead, behind = [first + s[:, 0]], [np.zeros((len(x), 3))]
    for t in range(1, width):
        ahead.append(np.where(live[:, t, None], logsum(ahead[-1][:, :, None] + links, 1) + s[:, t], ahead[-1]))
    for t in range(width - 1, 0, -1):
        behind.append(np.where(live[:, t, None], logsum(links + (s[:, t] + behind[-1])[:, None, :], 2), behind[-1]))
    behind.reverse()
    whole = logsum(ahead[-1], 1)
    each = np.stack([np.exp(a + b - whole[:, None]) for a, b in zip(ahead, behind)], 1)
    gap = np.where(live[:, :, None], eye[y] - each, 0) * times[:, None, None]
    grads = [np.column_stack([np.bincount(x[:, :, k].ravel(), gap[:, :, state].ravel(), len(w)) for state in (B, I)]) for k, w in enumerate(weights)]
    g, score = np.zeros((3, 3)), first[y[:, 0]] + np.take_along_axis(s[:, 0], y[:, :1], 1)[:, 0]
    for t in range(1, width):
        pair = np.exp(ahead[t - 1][:, :, None] + links + (s[:, t] + behind[t])[:, None, :] - whole[:, None, None])
        real = eye[y[:, t - 1]][:, :, None] * eye[y[:, t]][:, None, :]
        g += ((real - pair) * (live[:, t] * times)[:, None, None]).sum(axis=0)
        score = score + np.where(live[:, t], links[y[:, t - 1], y[:, t]] + np.take_along_axis(s[:, t], y[:, t : t + 1], 1)[:, 0], 0)
    return float(((score - whole) * times).sum()), [*grads, g, gap[:, 0].sum(axis=0)]


def arranged(windows: dict[bytes, int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, tags, whether a place has a token, and counts, by window."""
    data = np.array([np.frombuffer(w, np.int64).reshape(width, -1) for w in windows])
    return np.maximum(data[:, :, :-1], 0), np.maximum(data[:, :, -1], 0), data[:, :, 0] >= 0, np.array([*windows.values()], float)


def fitted(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 200, rate: float = 0.4, decay: float = 2e-5, width: int = 16, most: int = WINDOWS) -> Field:
    """Maximum likelihood by Adam on forward-backward expectations, over windows of width tokens around anything but plain words."""
    windows = windows_of(sequences, width, most)
    weights, links, first = [np.full((n, 2), -0.5) for n in SIZES], np.zeros((3, 3)), np.zeros(3)  # a value never seen speaks for O
    links[O, I] = first[I] = _CLOSED
    if windows:
        data = arranged(windows, width)
        params = [*weights, links, first]
        means, squares, start = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], [p.copy() for p in params]
        for step in range(1, steps + 1):
            _, grads = likelihood(params, *data)
            for p, g, m, v, z in zip(params, grads, means, squares, start):
                g = g / data[3].sum() - decay * (p - z) * (p > -1e8)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += np.where(p > -1e8, rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6), 0)
    return Field(weights, links, first)


#: What takes a telling word's place: words of the same length.
_NEUTRAL = {5: "place", 6: "number", 7: "section", 8: "headline"}


def tagged(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features, and tags of the tokens of each span."""
    starts, ends, found = tokens(text)
    tags = np.full(len(found), O)
    for a, b in spans:
        inside = np.flatnonzero((starts < b) & (ends > a))
        tags[inside] = I
        tags[inside[:1]] = B
    return found, tags


def example(text: str, rng: random.Random, kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A text to fit on: up to two planted secrets of these kinds, or a list of some side by side, harmless things beside them, and what the base patterns find, half of it untold.

    What else in the text itself looks like a secret may be one: long tokens of letters and digits, and told tokens with digits,
    have no known tag.
    """
    bare = [k for k in kinds if k in LISTED]
    listed = rng.choices(bare, k=rng.randint(2, 4)) if bare and rng.random() < 0.2 else []
    text, secrets_, regions = planted(text, rng, rng.sample(kinds, min(len(kinds), rng.choice((0, 1, 1, 2)))), rng.randrange(4), listed)
    spans = [(a, b) for a, b, _ in secrets_]
    for a, b, kind in base_spans(text):
        if kind == "assign":
            m = ASSIGN.match(text, a)
            if rng.random() < 0.5:
                text = text[:a] + _NEUTRAL[len(m[1])] + text[a + len(m[1]) :]
            regions.append((a, b))
            a = m.start(2)
        spans.append((a, b))
    starts, ends, found = tokens(text)
    tags = tagged(text, spans)[1]
    own = found[:, 13] // 4
    maybe = (tags == O) & ((own == 4) | (own > 0) & (found[:, 8] > 0))
    for a, b in regions:
        maybe &= (starts >= b) | (ends <= a)
    return found, np.where(maybe, UNKNOWN, tags)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most sample texts with a telling word and sample without, the least by a hash of the text. Nulls do not count."""
    text = F.col("text").cast("string")
    telling = F.lower(text)
    hit = text.contains("AKIA")
    for word in ("passw", "secret", "token", "apikey", "api_key"):
        hit = hit | telling.contains(word)
    marks = written(docs.select(F.xxhash64(text).alias("h"), hit.alias("hit")).filter(hit.isNotNull()), "marks")
    few = [marks.filter(F.col("hit") == b).select("h").distinct().orderBy("h").limit(sample) for b in (True, False)]
    small_batches(docs.sparkSession)
    # 2 * sample rows of one number are broadcast
    texts = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).join(F.broadcast(few[0].unionByName(few[1])), "h").dropDuplicates(["h"])

    def run(batches):
        kept = []
        for batch in batches:
            kept += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        field = fitted([example(t, random.Random(h), [*SECRETS]) for h, t in sorted(kept)])
        flat = np.concatenate([*[w.ravel() for w in field.weights], field.links.ravel(), field.first])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], ["flat"])

    found = texts.repartition(1).mapInArrow(run, "flat array<double>").first()  # none if there are no texts
    if found is None:
        return fitted([])
    flat = np.array(found.flat)
    ends = np.cumsum([*(2 * n for n in SIZES), 9, 3])
    *weights, links, first = np.split(flat, ends[:-1])
    return Field([w.reshape(-1, 2) for w in weights], links.reshape(3, 3), first)


def all_spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    """Base spans and the field's; one that lies within a base span is left out."""
    base = base_spans(text)
    more = [(a, b, "crf") for a, b in field.spans(text) if not any(x <= a and b <= y for x, y, _ in base)]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]))) if more else base


def secrets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs; offsets are code points.

    Null texts count as empty and have no spans; null ids and repeated rows stay. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))  # some two hundred numbers

    def make():
        field = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts_of(batch.column(1)):
                spans = all_spans(text, field)
                written = lambda kinds: ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in kinds)
                count = [sum(k == kind for *_, k in spans) for kind in KINDS[:3]]
                rows.append((*count, hashlib.sha256(written(KINDS[:3]).encode()).hexdigest(), written(KINDS)))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret in text replaced, and n_chars counted anew where there is such a column.

    Null and empty texts stay as they are. Spans that overlap are replaced as one, adjacent ones each on its own. Null ids and
    repeated rows stay, each masked alike; extra columns are kept as they are. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        field = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                spans = all_spans(text, field) if text else []
                for a, b, _ in reversed(_merged(spans)):
                    texts[i] = texts[i][:a] + mask + texts[i][b:]
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in schema.names:
                k = schema.names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in texts], batch.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for a, b, k in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), k)
        else:
            out.append((a, b, k))
    return out


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

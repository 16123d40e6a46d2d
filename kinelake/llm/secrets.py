"""Secret scans: rules, and a character convolutional network over every candidate.

One pass over the texts finds the rules' spans and every candidate: a run of
key-like characters of which 12 or more with a digit, or 24 or more, lie
outside the rules' spans, so that a long key is one though a rule finds a part
of it. What the rules found trains the network as secrets; runs of plain form
(words, identifiers, host names, numbers) train it as none: candidates, and,
from a second pass, every distinct shorter run of six characters or more.
Candidates of any other form teach nothing, for they are what it is to judge.

All of them train it: they are dealt by hash into shards, each of which trains
the network on its own rows, and the networks' mean begins the next pass. A
fifth of the runs is left out of the fit, calibrates its score, and sets its
threshold: the highest that finds a required share of the findings left out,
without the words before them, whatever that score is. Candidates that reach
it are added; the rules' spans are scored too, and stay.
"""

from __future__ import annotations

import copy
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibration import calibrate_rows, logistic
from .shared import arrow_schema, discard, materialise, table
from .text import CHUNK_BYTES, column, raw, runs, slices, span_hashes

KINDS = ("assign", "access", "hex", "cnn")
# The patterns of the base rules.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: A run whose pieces between separators are words in one case or capitalised, with up to four digits behind, or numbers.
PLAIN = re.compile(rb"[+/_.=-]*(?:(?:(?:[a-z]{1,20}|[A-Z]{1,20}|[A-Z][a-z]{1,19})[0-9]{0,4}|[0-9]+)(?:[+/_.=-]+|$))+")
#: Labels of runs: plain, found by a rule, to be judged, neither (a plain number that a rule found).
PLAIN_RUN, FOUND_RUN, OPEN_RUN, NO_LABEL = range(4)
#: Plain runs of so many bytes or more that are too short for a candidate are examples too.
SHORT_LEAST = 6
#: A task hands on its distinct short runs whenever it has so many.
SHORT_HELD = 1 << 18
#: A shard has about so many windows, and of each label at least LEAST_EACH runs (all, if fewer), some of which other shards have too.
SHARD_WINDOWS, LEAST_EACH = 1 << 15, 64
#: Passes over all shards, and over a single one; windows of a batch, and the fewest of the rarer label in it.
PASSES, ONE_SHARD_PASSES, BATCH, RARER = 3, 6, 128, 16

_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
_KEYLIKE = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", np.uint8))
_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BEFORE, INSIDE, AFTER = 24, 32, 8
WINDOW = BEFORE + INSIDE + AFTER

FOUND = "doc_id long, kind array<int>, start array<int>, end array<int>, c_start array<int>, c_end array<int>, c_label array<int>, c_text array<binary>"
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long, scores array<double>"


def _documents_with(data: bytes, needles, offsets: np.ndarray) -> list[int]:
    at = set()
    for needle in needles:
        i = data.find(needle)
        while i >= 0:
            d = int(np.searchsorted(offsets, i, "right")) - 1
            at.add(d)
            i = data.find(needle, max(i + 1, int(offsets[d + 1]) - len(needle) + 1))
    return sorted(at)


def _base(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list]:
    """(document, kind, start, end) rows of the rules' spans by byte, and (document, label, start, end) of what they found."""
    found, values = [], []
    whole = data.tobytes()
    a, b = runs(_HEX[data], offsets)
    keep = b - a >= HEX_LEAST
    found += [(int(np.searchsorted(offsets, x, "right")) - 1, 2, int(x), int(y)) for x, y in zip(a[keep], b[keep])]
    for pattern, kind, text, needles in ((ASSIGN, 0, _LOWER[data].tobytes(), KEYWORDS), (ACCESS, 1, whole, (b"AKIA",))):
        for d in _documents_with(text, needles, offsets):
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            for m in pattern.finditer(whole[lo:hi]):
                if len(m[2]) >= ASSIGN_LEAST if kind == 0 else len(m[0]) >= ACCESS_LEAST:
                    found.append((d, kind, lo + m.start(), lo + m.end()))
                    values.append((d, FOUND_RUN, lo + m.start(2), lo + m.end(2)) if kind == 0 else (d, FOUND_RUN, lo + m.start(), lo + m.end()))
    base = np.array(sorted(found, key=lambda s: (s[2], s[1])), np.int64).reshape(-1, 4)
    named = _covered(base[base[:, 1] < 2], len(data))
    for d, _, x, y in base[base[:, 1] == 2]:
        if named[y] == named[x]:  # not the value of an assignment
            values.append((d, NO_LABEL if whole[x:y].isdigit() else FOUND_RUN, x, y))
    return base, values


def _keylike(data: np.ndarray, offsets: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends of the runs of key-like characters, which of them are candidates, and which have nothing of a rule's span."""
    a, b = runs(_KEYLIKE[data], offsets)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    covered = _covered(base, len(data))
    # What the rules leave of a run must do.
    left, numbers, free = b - a - (covered[b] - covered[a]), digits[b] - digits[a], covered[b] == covered[a]
    for i in np.flatnonzero(~free):
        numbers[i] -= (_DIGIT[data[a[i] : b[i]]] & (np.diff(covered[a[i] : b[i] + 1]) > 0)).sum()
    return a, b, (left >= 12) & (numbers > 0) | (left >= 24), free


def _scan(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """(document, kind, start, end) rows by byte: the base spans, and runs with their labels as kind."""
    base, values = _base(data, offsets)
    whole, out = data.tobytes(), [(x, label, y) for _, label, x, y in values]
    a, b, candidate, free = _keylike(data, offsets, base)
    for x, y, alone in zip(a[candidate].tolist(), b[candidate].tolist(), free[candidate].tolist()):
        # A run that a rule found a part of is no example of either.
        out.append((x, PLAIN_RUN if alone and PLAIN.fullmatch(whole, x, y) else OPEN_RUN, y))
    cand = np.array(sorted(out), np.int64).reshape(-1, 3)
    return [base, np.stack([np.searchsorted(offsets, cand[:, 0], "right") - 1, cand[:, 1], cand[:, 0], cand[:, 2]], 1)]


def _covered(spans: np.ndarray, n: int) -> np.ndarray:
    """How many bytes before each place lie in a span."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, spans[:, 2], 1)
    np.add.at(step, spans[:, 3], -1)
    return np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])


def _in_context(data: np.ndarray, offsets: np.ndarray, cand: np.ndarray) -> list[bytes]:
    """BEFORE bytes before, the whole run, AFTER bytes behind; zero outside the document."""
    out, whole = [], data.tobytes()
    for doc, _, a, b in cand.tolist():
        lo, hi = max(int(offsets[doc]), a - BEFORE), min(int(offsets[doc + 1]), b + AFTER)
        out.append(b"\0" * (BEFORE - (a - lo)) + whole[lo:hi] + b"\0" * (AFTER - (hi - b)))
    return out


def windows(text: bytes) -> np.ndarray:
    """Windows over a run in its context, half a window apart: each has what is before the run, a part of it, and what is behind it."""
    x = np.frombuffer(text, np.uint8)
    if len(text) <= WINDOW:
        return np.frombuffer(text[: len(text) - AFTER].ljust(BEFORE + INSIDE, b"\0") + text[len(text) - AFTER :], np.uint8)[None]
    inside = x[BEFORE : len(x) - AFTER]
    starts = range(0, max(len(inside) - INSIDE // 2, 1), INSIDE // 2)
    out = np.zeros((len(starts), WINDOW), np.uint8)
    out[:, :BEFORE], out[:, BEFORE + INSIDE :] = x[:BEFORE], x[len(x) - AFTER :]
    for i, s in enumerate(starts):
        part = inside[s : s + INSIDE]
        out[i, BEFORE : BEFORE + len(part)] = part
    return out


def _find(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    data_all, offsets_all = raw(column(batch, "text"))
    rows = {n: [] for n in ("kind", "start", "end", "c_start", "c_end", "c_label", "c_text")}
    for rows_of in slices(offsets_all, CHUNK_BYTES):
        base = offsets_all[rows_of.start]
        data, offsets = data_all[base : offsets_all[rows_of.stop]], offsets_all[rows_of.start : rows_of.stop + 1] - base
        spans, cand = _scan(data, offsets)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        text = _in_context(data, offsets, cand)
        for d, (s0, s1, c0, c1) in enumerate(zip(*(np.searchsorted(x[:, 0], np.arange(len(offsets) - 1), side) for x in (spans, cand) for side in ("left", "right")))):
            s, c = spans[s0:s1], cand[c0:c1]
            own = points[offsets[d]]
            rows["kind"].append(s[:, 1]), rows["start"].append(points[s[:, 2]] - own), rows["end"].append(points[s[:, 3]] - own)
            rows["c_start"].append(points[c[:, 2]] - own), rows["c_end"].append(points[c[:, 3]] - own)
            rows["c_label"].append(c[:, 1]), rows["c_text"].append(text[c0:c1])
    ids = batch.column(batch.schema.get_field_index("doc_id"))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(rows[f.name], f.type) for f in schema if f.name != "doc_id")], schema=schema)


SHORT = "run binary, c long, t binary"


def _bytes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The bytes from starts to ends, zero where they lie before lo or from hi on."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    values = data[np.clip(at, 0, len(data) - 1)]
    values[(at < np.repeat(lo, sizes)) | (at >= np.repeat(hi, sizes))] = 0
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _first_of_each(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where the smallest c of each h is."""
    order = np.lexsort((c, h))
    return order[np.concatenate([[True], np.diff(h[order]) != 0])] if len(order) else order


def _short(batches):
    """Distinct plain runs too short for a candidate, each with the hash of the context whose hash is smallest, and the run in it."""
    held: list[tuple] = []  # (hash of the run, hash of the context, run, run in context)

    def merge():
        h, c = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        first = _first_of_each(h, c)
        held[:] = [(h[first], c[first], *(pa.concat_arrays([x[i] for x in held]).take(pa.array(first)) for i in (2, 3)))]
        return len(first)

    def plain():
        _, c, run, t = held.pop()
        keep = pa.array([PLAIN.fullmatch(r) is not None for r in run.to_pylist()], pa.bool_())
        return pa.RecordBatch.from_arrays([run.filter(keep), pa.array(c).filter(keep), t.filter(keep)], names=["run", "c", "t"])

    for batch in batches:
        data_all, offsets_all = raw(column(batch, "text"))
        for rows_of in slices(offsets_all, CHUNK_BYTES):
            begin = offsets_all[rows_of.start]
            data, offsets = data_all[begin : offsets_all[rows_of.stop]], offsets_all[rows_of.start : rows_of.stop + 1] - begin
            a, b, candidate, free = _keylike(data, offsets, _base(data, offsets)[0])
            keep = ~candidate & free & (b - a >= SHORT_LEAST)
            a, b = a[keep], b[keep]
            doc = np.searchsorted(offsets, a, "right") - 1
            lo, hi = np.maximum(offsets[doc], a - BEFORE), np.minimum(offsets[doc + 1], b + AFTER)
            h, c = (x.view(np.int64) for x in span_hashes(data, (a, b), (lo, hi)))
            for i in range(0, len(a), SHORT_HELD):  # more than one piece only of a very long text
                at = i + _first_of_each(h[i : i + SHORT_HELD], c[i : i + SHORT_HELD])
                x, y = a[at], b[at]
                held.append((h[at], c[at], _bytes_of(data, x, y, x, y), _bytes_of(data, x - BEFORE, y + AFTER, lo[at], hi[at])))
                if sum(len(x[0]) for x in held) >= 2 * SHORT_HELD and merge() >= SHORT_HELD:
                    yield plain()
    if held and merge():
        yield plain()


def short_runs(docs: DataFrame) -> DataFrame:
    """(run, t): every distinct plain run too short for a candidate, once, in the context of one of its places (the smallest by hash)."""
    return docs.select("text").mapInArrow(_short, SHORT).groupBy("run").agg(F.min_by("t", "c").alias("t"))


class CharNetwork:
    """Character embeddings, filters of two widths, max pooling over context and candidate, logistic output."""

    WIDTHS, FILTERS, DIM = (3, 5), 12, 8

    def __init__(self, seed: int = 5):
        self.scale, self.shift = 1.0, 0.0
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(0, 1 / np.sqrt(np.prod(s[:-1])), s).astype(np.float32)
        self.p = {"e": rng.normal(0, 0.5, (256, self.DIM)).astype(np.float32)}
        for k in self.WIDTHS:
            self.p |= {f"w{k}": w(k * self.DIM, self.FILTERS), f"b{k}": np.zeros(self.FILTERS, np.float32)}
        self.p |= {"o": np.zeros(2 * len(self.WIDTHS) * self.FILTERS, np.float32), "c": np.zeros(1, np.float32)}

    def _filters(self) -> np.ndarray:
        """All filters' rows by width, place and filter."""
        return np.concatenate([self.p[f"w{k}"].reshape(k, self.DIM, self.FILTERS).transpose(0, 2, 1).reshape(-1, self.DIM) for k in self.WIDTHS])

    def _forward(self, x: np.ndarray):
        # Each character's products with all filters, then the filters' sums, shifted by place.
        each = (self._filters() @ self.p["e"][x.ravel()].T).reshape(sum(self.WIDTHS), self.FILTERS, len(x), WINDOW)
        pooled, keep, first = [], [], 0
        for k in self.WIDTHS:
            n = WINDOW - k + 1
            y = each[first, :, :, :n] + self.p[f"b{k}"][:, None, None]
            for j in range(1, k):
                y += each[first + j, :, :, j : j + n]
            first += k
            for part in (slice(0, BEFORE), slice(BEFORE, None)):
                at = y[:, :, part].argmax(2) + (part.start or 0)
                pooled.append(np.maximum(np.take_along_axis(y, at[:, :, None], 2)[:, :, 0], 0).T)
                keep.append((k, at.T))
        h = np.concatenate(pooled, 1)
        return h @ self.p["o"] + self.p["c"], h, keep

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [self._forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1 for each run in its context."""
        return logistic(self.scale * self.largest(texts).astype(float) + self.shift)

    def largest(self, texts: list[bytes]) -> np.ndarray:
        """The logit of each run in its context: the largest over its windows."""
        each = [windows(t) for t in texts]
        if not each:
            return np.zeros(0)
        z = self.logits(np.concatenate(each))
        return np.maximum.reduceat(z, np.cumsum([0, *map(len, each)])[:-1])

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        z, h, keep = self._forward(x)
        dz = ((logistic(z) - y) * weight).astype(np.float32)
        g = {k: np.zeros_like(a) for k, a in self.p.items()}
        g["o"], g["c"] = h.T @ dz, np.array([dz.sum()], np.float32)
        dh = dz[:, None] * self.p["o"] * (h > 0)
        # Sums by place, character and filter: all that embedding and filters need.
        start, cells, parts = np.arange(len(x))[:, None] * WINDOW, [], []
        for i, (k, at) in enumerate(keep):
            d = dh[:, i * self.FILTERS : (i + 1) * self.FILTERS]
            g[f"b{k}"] += d.sum(0)
            first = sum(w for w in self.WIDTHS if w < k)
            place = np.arange(k)[:, None, None]
            chars = x.ravel()[(start + at)[None] + place].astype(np.int64)
            cells.append((((first + place) * 256 + chars) * self.FILTERS + np.arange(self.FILTERS)).ravel())
            parts.append(np.broadcast_to(d, (k, *d.shape)).ravel())
        shape = (sum(self.WIDTHS), 256, self.FILTERS)
        sums = np.bincount(np.concatenate(cells), np.concatenate(parts), int(np.prod(shape))).astype(np.float32).reshape(shape)
        flat, filters = sums.transpose(0, 2, 1).reshape(-1, 256), self._filters()
        g["e"], all_filters = flat.T @ filters, (flat @ self.p["e"]).reshape(shape[0], self.FILTERS, self.DIM)
        for k in self.WIDTHS:
            first = sum(w for w in self.WIDTHS if w < k)
            g[f"w{k}"] = all_filters[first : first + k].transpose(0, 2, 1).reshape(k * self.DIM, self.FILTERS)
        return g

    def learn(self, none: np.ndarray, secret: np.ndarray, seed: int | list[int], rate: float = 0.01) -> "CharNetwork":
        """One pass over all windows of both labels, those of the rarer one repeated; each label has half of a batch's weight."""
        rng, t = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        steps = -(-max(len(none), len(secret)) // BATCH)
        order = [np.array_split(np.concatenate([rng.permutation(len(x)) for _ in range(-(-steps * RARER // max(len(x), 1)))]), steps) for x in (none, secret)]
        for i, j in zip(*order):
            xb, y = np.concatenate([none[i], secret[j]]), np.repeat([0, 1], [len(i), len(j)])
            # More than half without what stands around them, or with what stands around another run: the candidate must do.
            chance, other = rng.random(len(xb)), xb[rng.permutation(len(xb))]
            for part in (slice(0, BEFORE), slice(BEFORE + INSIDE, None)):
                xb[:, part] = np.where((chance < 0.2)[:, None], 0, np.where((chance < 0.6)[:, None], other[:, part], xb[:, part]))
            g, t = self.gradient(xb, y, 0.5 / np.where(y == 1, max(len(j), 1), max(len(i), 1))), t + 1
            for k, a in self.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                a -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)
        return self

    def numbers(self) -> np.ndarray:
        """All parameters in units of 2**-32, whose sums don't depend on their order."""
        return np.concatenate([np.rint(a.ravel().astype(float) * 2.0**32).astype(np.int64) for a in self.p.values()])

    def set_mean(self, total: np.ndarray, n: int) -> None:
        at = 0
        for k, a in self.p.items():
            self.p[k] = (total[at : at + a.size] / (n * 2.0**32)).astype(np.float32).reshape(a.shape)
            at += a.size


def in_context_of(text: bytes, other: bytes) -> bytes:
    return other[:BEFORE] + text[BEFORE : len(text) - AFTER] + other[len(other) - AFTER :]


def shards_of(counts: dict[int, tuple[int, int]]) -> int:
    return -(-sum(w for _, w in counts.values()) // SHARD_WINDOWS)


def _shards(rows: DataFrame, counts: dict[int, tuple[int, int]], name: str) -> DataFrame:
    """Rows (y, t) in shards of bounded size, dealt by the text's hash; ``counts`` has the runs and windows of each label.

    Where a label has fewer than LEAST_EACH runs a shard, each of its runs goes
    to as many shards as that takes, equally many for all of them.
    """
    parts = shards_of(counts)
    times = [min(parts, -(-LEAST_EACH * parts // counts[label][0])) for label in (0, 1)]
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == 0, times[0] - 1).otherwise(times[1] - 1)))
    dealt = rows.select("y", "t", copies.alias("i")).select("y", "t", ((F.pmod(F.xxhash64("t"), F.lit(parts)) + F.col("i")) % parts).alias("part"))
    own = lambda label: F.sort_array(F.collect_list(F.when(F.col("y") == label, F.col("t"))))
    dealt = dealt.repartition(parts, "part").groupBy("part").agg(own(0).alias("none"), own(1).alias("secret"))
    return materialise(dealt.select("part", F.array(*map(F.lit, times)).alias("times"), "none", "secret"), name)


def _texts(batch: pa.RecordBatch):
    """(part, times, texts of label 0, texts of label 1) of each shard."""
    for i in range(batch.num_rows):
        yield tuple(batch.column(j)[i].as_py() for j in range(4))


def _one_pass(shards: DataFrame, net: CharNetwork, number: int) -> CharNetwork:
    """The mean of the networks that each shard makes of ``net``; only sums of parameters reach the driver, one a task."""
    given = shards.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        total, n = 0, 0
        for batch in batches:
            for part, _, *texts in _texts(batch):
                none, secret = (np.concatenate([windows(t) for t in ts]) if ts else np.zeros((0, WINDOW), np.uint8) for ts in texts)
                own = copy.deepcopy(given.value).learn(none, secret, seed=[number, part], rate=0.01 * 0.6**number)
                total, n = total + own.numbers(), n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

    sums = materialise(shards.mapInArrow(run, "n long, total binary"), "networks")
    rows = sums.collect()
    out = copy.deepcopy(net)
    out.set_mean(sum(np.frombuffer(r.total, np.int64) for r in rows), sum(r.n for r in rows))
    discard(sums)
    given.destroy()
    return out


def _left_out(shards: DataFrame, net: CharNetwork) -> DataFrame:
    """(y, weight, z): the logit of each run left out, with the words around a plain one about it; weights undo that shards share runs."""
    given = shards.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for _, times, none, secret in _texts(batch):
                around = none or [b"\0" * (BEFORE + AFTER)]
                for y, texts in ((0, none), (1, secret)):
                    z = given.value.largest([in_context_of(t, around[i % len(around)]) for i, t in enumerate(texts)]).astype(np.float32)
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, y, np.int32)), pa.array(np.full(n, 1 / times[y])), pa.array(z)], names=["y", "weight", "z"])

    return materialise(shards.mapInArrow(run, "y int, weight double, z float"), "left-out")


def nth_smallest(rows: DataFrame, column: str, n: int) -> float:
    """The value of a float column that ``n`` others come before, exactly: counted by the upper, then the lower half of its bits."""
    bits = F.col("__bits")

    def run(batches):
        for batch in batches:
            x = np.frombuffer(np.asarray(batch.column(0), np.float32).tobytes(), np.int32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(x < 0, -(x & 0x7FFFFFFF), x) + (1 << 31))], names=["__bits"])

    rows = rows.select(F.col(column).cast("float")).mapInArrow(run, "__bits long")
    high, before = None, 0
    for key in (F.shiftright(bits, 16), bits.bitwiseAND(0xFFFF)):
        of = rows if high is None else rows.filter(F.shiftright(bits, 16) == high)
        for value, count in sorted(of.groupBy(key.alias("k")).count().collect()):  # at most 65,536 rows
            if before + count > n:
                break
            before += count
        if high is None:
            high = value
    x = (high << 16) + value - (1 << 31)
    return float(np.array([x if x >= 0 else (-x) | (1 << 31)], np.uint32).view(np.float32)[0])


def fit_network(found: DataFrame, short: DataFrame | None = None, recall: float = 0.95) -> tuple[CharNetwork, float] | None:
    """Network and threshold from all distinct findings and plain runs in their contexts, and all short runs of ``short``; None without any of either.

    A fifth of them, by hash, is left out of the fit; the runs of a label are
    all fitted on and calibrated with where that would leave none on one side.
    The threshold is the highest score that ``recall`` of the findings left out
    reach with the words around a plain run about them: the recall decides,
    however low the score.
    """
    each = found.select(F.explode(F.arrays_zip("c_label", "c_text")).alias("c")).filter(F.col("c.c_label").isin(PLAIN_RUN, FOUND_RUN))
    each = each.select((F.col("c.c_label") == FOUND_RUN).cast("int").alias("y"), F.col("c.c_text").alias("t")).distinct()
    if short is not None:
        each = each.unionByName(short.select(F.lit(0).alias("y"), "t"))
    each = materialise(each.withColumn("held", F.pmod(F.xxhash64("t", F.lit(1)), F.lit(5)) == 0), "runs")
    n_windows = F.greatest(F.ceil((F.length("t") - BEFORE - AFTER - INSIDE // 2) / (INSIDE // 2)), F.lit(1))
    counts = {(r.y, r.held): (r.n, r.w) for r in each.groupBy("y", "held").agg(F.count(F.lit(1)).alias("n"), F.sum(n_windows).alias("w")).collect()}
    if {y for y, _ in counts} != {0, 1}:
        discard(each)
        return None
    few = [y for y in (0, 1) if (y, True) not in counts or (y, False) not in counts]
    own = lambda held: {y: next(counts[k] for k in ((y, held), (y, not held)) if k in counts) for y in (0, 1)}
    shards = {held: _shards(each.filter((F.col("held") == held) | F.col("y").isin(few)), own(held), "shards") for held in (False, True)}
    discard(each)
    net = CharNetwork()
    for number in range(PASSES if shards_of(own(False)) > 1 else ONE_SHARD_PASSES):
        net = _one_pass(shards[False], net, number)
    left = _left_out(shards[True], net)
    net.scale, net.shift = calibrate_rows(left)
    findings = left.filter("y = 1")
    z = nth_smallest(findings, "z", int(np.floor((1 - recall) * findings.count())))
    discard(left, *shards.values())
    return net, float(logistic(net.scale * np.float64(z) + net.shift))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the rules' spans, all spans, and a score for each of them, null without a network.

    Null texts count as empty: no spans, the digest of the empty string.
    Repeated rows give repeated rows. The texts are read twice; only spans and
    runs with a few bytes around them go on. In a corpus without any finding
    of the rules there is nothing to learn from, and nothing is added.
    """
    spark = docs.sparkSession
    found_schema = arrow_schema(spark.createDataFrame([], FOUND).schema)
    found = materialise(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            lambda batches: (_find(b, found_schema) for b in batches if b.num_rows), FOUND
        ),
        "findings",
    )
    fitted = spark.sparkContext.broadcast(fit_network(found, short_runs(docs)))
    result_schema = arrow_schema(spark.createDataFrame([], RESULT).schema)
    return found.mapInArrow(lambda batches: (_describe(b, fitted.value, result_schema) for b in batches if b.num_rows), RESULT)


def _describe(batch: pa.RecordBatch, fitted, schema: pa.Schema) -> pa.RecordBatch:
    rows = batch.to_pylist()
    runs_of = [(i, j) for i, r in enumerate(rows) for j in range(len(r["c_label"]))]
    scored: list[list[tuple[int, int, int, float]]] = [[] for _ in rows]
    if fitted and runs_of:
        for (i, j), score in zip(runs_of, fitted[0].score([rows[i]["c_text"][j] for i, j in runs_of])):
            scored[i].append((rows[i]["c_start"][j], rows[i]["c_end"][j], rows[i]["c_label"][j], float(score)))
    out = []
    for r, own in zip(rows, scored):
        base = sorted(zip(r["start"], r["kind"], r["end"]))
        more = [(a, 3, b) for a, b, label, score in own if label in (PLAIN_RUN, OPEN_RUN) and score >= fitted[1]]
        spans = sorted(base + more)
        # A span has the largest score of the runs that it meets.
        scores = [max((score for a, b, _, score in own if a < end and start < b), default=None) for start, _, end in spans]
        say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        n = [sum(k == kind for kind in r["kind"]) for k in range(3)]
        out.append((r["doc_id"], *n, hashlib.sha256(say(base).encode()).hexdigest(), say(spans), len(more), scores))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))

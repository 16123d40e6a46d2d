"""Toxicity: a convolutional text classifier over hashed word embeddings.

Every word has the sum of hashed embeddings of the word and of its first
bytes. Filters of several widths run over them. Each filter keeps its maximum
in each of PARTS equal parts of the whole text, and of these maxima the KEPT
largest, so that a word that many texts have once tells less than several in
one; a logistic layer turns them into a score. The embeddings start from log-odds of the training labels and are trained with the
rest in numpy, on a bounded sample of labelled rows. Labels held back from the
fit calibrate the score and a decision threshold for each language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibration import calibrate, logistic
from .shared import arrow_schema, first_by_hash, materialise, table
from .text import PUNCTUATION, column, token_batches

BUCKETS, DIM = 1 << 18, 4
WIDTHS, FILTERS = (1, 2, 3), 4
PARTS, KEPT = 8, 3
#: Each word also has an embedding of its first 4 and of its first 5 bytes, which its inflected forms share.
PREFIXES = (4, 5)
TABLES = 1 + len(PREFIXES)
LEAST, PRIOR = 3, 6.0
RESULT = "doc_id long, held_out boolean, score double"


def hashed(words) -> np.ndarray:
    """Rows of the word table and of the prefix tables, by word."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.stack([words.hashes >> shift, *(words.prefixes(n) >> shift for n in PREFIXES)], 1).astype(np.int32)


@dataclass
class TextNetwork:
    tables: np.ndarray = field(default_factory=lambda: np.zeros((TABLES, BUCKETS, DIM), np.float32))
    p: dict = field(default_factory=dict)
    known: np.ndarray | None = None

    def __post_init__(self):
        if not self.p:
            rng = np.random.default_rng(17)
            for k in WIDTHS:
                w = rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32)
                w[:, 0, :2] = 1.0 / k  # two filters of each width begin as a mean of the log-odds
                self.p |= {f"w{k}": w, f"b{k}": np.zeros(FILTERS, np.float32)}
            self.p |= {"o": np.full(len(WIDTHS) * FILTERS * KEPT, 0.1, np.float32), "c": np.zeros(1, np.float32)}

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        x = self.tables[0][rows[..., 0]]
        for t in range(1, TABLES):
            x += self.tables[t][rows[..., t]]
        return x

    def pooled(self, rows: np.ndarray, bounds: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest maxima of the parts by document, width, rank and filter; with ``places`` also the words they begin at.

        A part without words has maximum 0, as every filter has at least. A
        text shorter than a filter is padded with zeros.
        """
        n, out, where = len(bounds) - 1, [], []
        size = np.diff(bounds)
        cuts = (bounds[:-1, None] + size[:, None] * np.arange(PARTS) // PARTS).ravel()
        full = np.flatnonzero(np.diff(np.append(cuts, bounds[-1])) > 0)
        part = np.repeat(full, np.diff(np.append(cuts[full], bounds[-1]))) if len(full) else full
        x, doc = self.embedded(rows), np.repeat(np.arange(n), size)
        for k in WIDTHS:
            y = x @ self.p[f"w{k}"][0] + self.p[f"b{k}"]
            for j in range(1, k):
                y[:-j] += (x[j:] @ self.p[f"w{k}"][j]) * (doc[j:] == doc[:-j])[:, None]
            best = np.zeros((n * PARTS, FILTERS), np.float32)
            if len(full):
                best[full] = np.maximum.reduceat(y, cuts[full])
            if places:
                at = np.repeat(np.minimum(cuts, max(len(rows) - 1, 0))[:, None], FILTERS, 1)
                for f in range(FILTERS):
                    hit = np.flatnonzero(y[:, f] == best[part, f])[::-1]
                    at[part[hit], f] = hit
                at = at.reshape(n, PARTS, FILTERS)
            best = np.maximum(best, 0).reshape(n, PARTS, FILTERS)
            if places:
                order = np.argsort(-best, axis=1, kind="stable")[:, :KEPT]
                best = np.take_along_axis(best, order, 1)
                where.append(np.take_along_axis(at, order, 1).reshape(n, -1))
            else:
                best = -np.sort(-best, axis=1)[:, :KEPT]
            out.append(best.reshape(n, -1))
        return np.concatenate(out, 1), where

    def logits(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.pooled(rows, bounds)[0] @ self.p["o"] + self.p["c"]

    def start(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """Log-odds of a row occurring in documents of label 1, shrunk to 0 where few have it, as the first dimension; small noise in the others.

        Rows of fewer than LEAST documents stay zero, in the fit as well, like those of words never seen.
        """
        rng = np.random.default_rng(23)
        n0, n1 = (y == 0).sum() + 1.0, (y == 1).sum() + 1.0
        prior = PRIOR / (n0 + n1)
        self.known = np.zeros((TABLES, BUCKETS), bool)
        for t in range(TABLES):
            seen = np.zeros((2, BUCKETS))
            for d, label in zip(docs, y):
                seen[label, np.unique(d[:, t])] += 1
            odds = np.log(seen[1] / n1 + prior) - np.log(seen[0] / n0 + prior)
            known = self.known[t] = seen.sum(0) >= LEAST
            self.tables[t, known, 0] = np.clip(odds[known], -4, 4) / 2
            self.tables[t, known, 1:] = rng.normal(0, 0.05, (int(known.sum()), DIM - 1))

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.03) -> None:
        rng = np.random.default_rng(29)
        weight = np.where(y == 1, len(y) / (2 * max((y == 1).sum(), 1)), len(y) / (2 * max((y == 0).sum(), 1)))
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        size = np.full((TABLES, BUCKETS), 1e-4, np.float32)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 64)):
                rows = np.concatenate([docs[i] for i in batch])
                bounds = np.concatenate([[0], np.cumsum([len(docs[i]) for i in batch])])
                h, where = self.pooled(rows, bounds, True)
                z = h @ self.p["o"] + self.p["c"]
                dz = ((1 / (1 + np.exp(-z)) - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
                g = {"o": h.T @ dz, "c": dz.sum(keepdims=True)}
                dh = dz[:, None] * self.p["o"] * (h > 0)
                for i, k in enumerate(WIDTHS):
                    d = dh[:, i * FILTERS * KEPT : (i + 1) * FILTERS * KEPT]
                    g[f"b{k}"], g[f"w{k}"] = d.reshape(-1, FILTERS).sum(0), np.zeros_like(self.p[f"w{k}"])
                    for j in range(k):
                        at = where[i] + j
                        ok = (at < bounds[1:, None]) & (np.diff(bounds) > 0)[:, None]
                        at = np.minimum(at, max(len(rows) - 1, 0))
                        x = self.embedded(rows[at]) * ok[:, :, None]
                        g[f"w{k}"][j] = np.einsum("bkf,bkfd->df", d.reshape(-1, KEPT, FILTERS), x.reshape(len(d), KEPT, FILTERS, DIM))
                        back = (d * ok)[:, :, None] * np.tile(self.p[f"w{k}"][j].T, (KEPT, 1))
                        for s in range(TABLES):
                            own = rows[at, s].ravel()
                            flat = back.reshape(-1, DIM)
                            np.add.at(size[s], own, (flat**2).mean(1))
                            np.add.at(self.tables[s], own, -rate * flat * self.known[s][own][:, None] / np.sqrt(size[s][own])[:, None])
                t += 1
                for k, a in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    a -= (rate / 2) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)


@dataclass
class Scorer:
    """A network with its calibration, and thresholds by language."""

    network: TextNetwork
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """0 to 1 for each text; null and empty texts get the score of a text without words."""
        out = []
        for words in token_batches(texts, lower=True, space=PUNCTUATION):
            z = self.network.logits(hashed(words), words.bounds)
            out.append(1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30))))
        return np.concatenate(out).astype(float) if out else np.zeros(0)


def sample(docs: DataFrame, labels: DataFrame, most: int = 3000) -> list:
    """(label, lang, hashed words) of at most ``most`` documents of label 1 and twice as many of label 0, first by a hash of doc_id.

    They come whole, as 12 bytes a word. A document with two labels, or rows
    that repeat, counts once, with its highest label.
    """
    labels = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select("doc_id").distinct().join(labels, "doc_id").withColumn("h", F.xxhash64("doc_id", F.lit(1)))
    ids = materialise(ids, "labelled")
    picked = first_by_hash(ids.filter("toxic = 1"), most).unionByName(first_by_hash(ids.filter("toxic <> 1"), 2 * most))
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])  # at most 3 * most ids

    def run(batches):
        for batch in batches:
            found, at = {"doc_id": [], "toxic": [], "lang": [], "words": []}, 0
            for words in token_batches(column(batch, "text"), lower=True, space=PUNCTUATION):
                own = hashed(words)
                for d in range(len(words.bounds) - 1):
                    for n in ("doc_id", "toxic", "lang"):
                        found[n].append(batch.column(batch.schema.get_field_index(n))[at].as_py())
                    found["words"].append(own[words.bounds[d] : words.bounds[d + 1]].tobytes())
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(found["doc_id"], pa.int64()), pa.array(found["toxic"], pa.int32()), pa.array(found["lang"], pa.string()), pa.array(found["words"], pa.binary())], names=list(found))

    rows = rows.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "lang", "text")
    got = rows.mapInArrow(run, "doc_id long, toxic int, lang string, words binary").collect()
    return [(int(r.toxic == 1), r.lang, np.frombuffer(r.words, np.int32).reshape(-1, TABLES)) for r in sorted(got, key=lambda r: r.doc_id)]


def train(rows: list, default: float = 0.7, precision: float = 0.95) -> Scorer:
    """Fit on four fifths of the sample; the rest calibrates the score (Platt) and the thresholds.

    The threshold of a language is the lowest score, at 0.5 or above, from
    which on at least ``precision`` of its left-out rows are toxic; ``default``
    where fewer than 10 toxic rows tell. Without both labels every score is
    the share of label 1.
    """
    y = np.array([r[0] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Scorer(TextNetwork(), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    out, fit = np.zeros(len(y), bool), np.ones(len(y), bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        out[own[::5]] = True
        if len(own) >= 5:  # fewer rows are both fitted on and calibrated with
            fit[own[::5]] = False
    net = TextNetwork()
    docs = [d for d, f in zip((r[2] for r in rows), fit) if f]
    net.start(docs, y[fit])
    net.fit(docs, y[fit])
    net.known = None
    held = [r[2] for r, o in zip(rows, out) if o]
    z = np.concatenate([net.logits(d, np.array([0, len(d)])) for d in held])
    truth = y[out].astype(float)
    a, b = calibrate(z, truth)
    scorer = Scorer(net, float(a), float(b))
    scores = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    langs = np.array([str(r[1]) for r, o in zip(rows, out) if o])
    for lang in sorted(set(langs)):
        s, t = scores[langs == lang], truth[langs == lang]
        good = [c for c in np.unique(s) if c >= 0.5 and t[s >= c].mean() >= precision]
        scorer.thresholds[lang] = float(min(good)) if t.sum() >= 10 and good else default
    return scorer


def train_scorer(docs: DataFrame, labels: DataFrame) -> Scorer:
    return train(sample(docs, labels))


def score(docs: DataFrame, scorer: Scorer, held_out=None) -> DataFrame:
    """doc_id, held_out, score for each row; null and empty texts too, repeated rows repeated."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(scorer)
    schema = arrow_schema(spark.createDataFrame([], RESULT).schema)

    def run(batches):
        for b in batches:
            if b.num_rows:
                ids, held = (b.column(b.schema.get_field_index(n)) for n in ("doc_id", "held_out"))
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(model.value.scores(column(b, "text")))], schema=schema)

    held_out = F.lit(False) if held_out is None else held_out
    return docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out")).mapInArrow(run, RESULT)


def keep_clean(docs: DataFrame, scorer: Scorer, default: float = 0.7) -> DataFrame:
    """Documents that score under the threshold of their language, with all their columns."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(scorer)

    def run(batches):
        for b in batches:
            if b.num_rows:
                langs = b.column(b.schema.get_field_index("lang")).to_pylist()
                limits = np.array([model.value.thresholds.get(str(x), default) for x in langs])
                yield b.filter(pa.array(model.value.scores(column(b, "text")) < limits))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scorer = train_scorer(docs.filter(~held), table(spark, sf_dir, "labels"))
    scored = score(docs, scorer, held)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))

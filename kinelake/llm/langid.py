"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood is the sum over all its segmentations into pieces, by a
forward pass over its bytes; a text's is the product over its words. The piece
probabilities come from expectation-maximisation over a bounded sample of
labelled documents; the vocabulary is never trained.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_schema, materialise, table
from .text import Powers, column, mix, raw, slices, tokenize

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 1  # the byte that stands for a word's beginning
#: Scaled probabilities keep forward sums within the range of doubles for RESCALE bytes; then a word's sums are divided by their largest.
GAIN, RESCALE = 64.0, 24
CHUNK = 1 << 22
#: Doubles of a forward table: fewer words at once, the longer they are and the more languages there are.
TABLE = 1 << 22
#: Places of words that are matched to pieces in one go.
PLACES = 1 << 18
#: Words whose scores a task keeps.
CACHED = 100_000
_POWERS = Powers(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces as bytes, the word mark as one byte; every single byte is one, so no text is without a segmentation."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            piece = sp.id_to_piece(i)
            body = piece.removeprefix("▁")
            if "▁" not in body:
                found.add((chr(MARK) if piece != body else "").encode() + body.encode())
    return sorted(p for p in found if p)


def _hash_pieces(pieces: list[bytes]) -> np.ndarray:
    up, _ = _POWERS.get(max(map(len, pieces), default=0))
    return np.array([mix(np.array([(_BYTE[np.frombuffer(p, np.uint8)] * up[: len(p)]).sum(dtype=np.uint64)]))[0] for p in pieces], np.uint64)


@dataclass
class PieceModel:
    """Sorted piece hashes, and scaled probabilities by piece and language."""

    hashes: np.ndarray
    lengths: np.ndarray
    probs: np.ndarray
    langs: list[str]

    def __post_init__(self):
        self.sizes = [int(k) for k in np.unique(self.lengths)]
        self.longest = max(self.sizes, default=1)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.hashes >> np.uint64(42)] = True

    def scaled(self) -> np.ndarray:
        return self.probs * (GAIN ** self.lengths)[:, None]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and which piece each of these is."""
        maybe = np.flatnonzero(self.filter[h >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        ok = self.hashes[at] == h[maybe]
        return maybe[ok], at[ok]


def _matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte hashes of words laid side by side, each behind its mark; and lengths."""
    n = ends - starts
    at = starts[:, None] + np.arange(int(n.max()))
    body = np.where(at < ends[:, None], data[np.minimum(at, len(data) - 1)], 0)
    marked = np.concatenate([np.full((len(n), 1), MARK, np.uint8), body], 1)
    total = np.zeros((len(n), marked.shape[1] + 1), np.uint64)
    np.cumsum(_BYTE[marked] * _POWERS.get(marked.shape[1])[0], axis=1, out=total[:, 1:])
    return total, n + 1


def _matches(model: PieceModel, total: np.ndarray, n: np.ndarray):
    """(end, length, rows, pieces) of the pieces in words that are sorted by length, longest first: by end, then length; rows in order."""
    down, end, last = _POWERS.get(total.shape[1])[1], 1, int(n.max(initial=0))
    while end <= last:
        active = int(np.searchsorted(-n, -end, "right"))  # words of ``end`` bytes or more
        to = min(last, end + max(1, PLACES // active) - 1)
        found = []
        for k in model.sizes:
            first = max(end, k)
            if first > to:
                break
            h = mix((total[:active, first : to + 1] - total[:active, first - k : to + 1 - k]) * down[first - k : to + 1 - k])
            at, piece = model.find(h.ravel())
            row, place = at // h.shape[1], at % h.shape[1] + first
            ok = place <= n[row]
            found.append(np.stack([place[ok], np.full(int(ok.sum()), k), row[ok], piece[ok]]))
        place, size, row, piece = np.concatenate(found, 1)
        order = np.lexsort((row, size, place))
        place, size, row, piece = place[order], size[order], row[order], piece[order]
        cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (size[1:] != size[:-1])])) if len(place) else np.zeros(0, int)
        for a, b in zip(cut, [*cut[1:], len(place)]):
            yield int(place[a]), int(size[a]), row[a:b], piece[a:b]
        end = to + 1


def _blocks(starts: np.ndarray, ends: np.ndarray, each: int):
    """Words of like length, longest first, as many at once as a table of bounded size holds, with ``each`` doubles for a word's byte."""
    n = ends - starts + 2
    order, at = np.argsort(-n, kind="stable"), 0
    while at < len(order):
        to = at + max(1, TABLE // (int(n[order[at]]) * max(each, 1)))
        yield order[at:to]
        at = to


def word_scores(model: PieceModel, scaled: np.ndarray, data, starts, ends) -> np.ndarray:
    """Log likelihoods by word and language, over all segmentations of whole words.

    Only the forward sums that a longest piece can reach back to are held, and
    they are scaled as they go, so a word may have any length.
    """
    out, ring = np.zeros((len(starts), len(model.langs))), model.longest + 1
    for own in _blocks(starts, ends, 1 + len(model.langs)):
        total, n = _matrix(data, starts[own], ends[own])
        forward, logs, at = np.zeros((ring, len(own), len(model.langs))), np.zeros((len(own), len(model.langs))), 0
        forward[0] = 1

        def close(i):
            """What place i completes."""
            lo, hi = np.searchsorted(-n, [-i, -i + 1])
            out[own[lo:hi]] = np.log(forward[i % ring, lo:hi]) + logs[lo:hi] - i * np.log(GAIN)
            if i % RESCALE == 0:
                top = forward[:, :hi].max(0)
                forward[:, :hi] /= top
                logs[:hi] += np.log(top)

        for i, k, rows, piece in _matches(model, total, n):
            if i > at:
                if at:
                    close(at)
                forward[i % ring], at = 0, i
            forward[i % ring, rows] += forward[(i - k) % ring, rows] * scaled[piece]
        close(at)
    return out


def train(words: list[tuple[str, bytes, int]], pieces: list[bytes], rounds: int = 4, smoothing: float = 20.0) -> PieceModel:
    """EM over (language, word, count) rows. Languages share a smoothed common distribution with a floor for every piece."""
    langs = sorted({w[0] for w in words}, key=lambda s: s.encode())
    hashes = _hash_pieces(pieces)
    order = np.argsort(hashes)
    lengths = np.array([len(p) for p in pieces])[order]
    model = PieceModel(hashes[order], lengths, np.full((len(pieces), len(langs)), 1 / len(pieces)), langs)
    index = {w: i for i, w in enumerate(sorted({w[1] for w in words}))}
    counts, column_of = np.zeros((len(index), len(langs))), {lang: i for i, lang in enumerate(langs)}
    for lang, word, n in words:
        counts[index[word], column_of[lang]] += n
    data = np.frombuffer(b"".join(index), np.uint8)
    ends = np.cumsum([len(w) for w in index]) if index else np.zeros(0, np.int64)
    starts = ends - np.array([len(w) for w in index], np.int64)
    for _ in range(rounds if len(index) else 0):
        expected, scaled = np.zeros_like(model.probs), model.scaled()
        for own in _blocks(starts, ends, 2 * len(langs)):
            total, n = _matrix(data, starts[own], ends[own])
            forward = np.zeros((int(n.max()) + 1, len(own), len(langs)))
            backward, seen = np.zeros_like(forward), list(_matches(model, total, n))
            forward[0] = 1
            # Sums of RESCALE places have one scale, that of the largest of the places before; so a word may have any length.
            scales = [np.zeros(forward.shape[1:])]

            def step(i, k, rows, piece):
                """A piece's probability, and what brings the scale of its beginning to that of its end."""
                to, of = (i - 1) // RESCALE, max(i - k - 1, 0) // RESCALE
                return scaled[piece] if to == of else scaled[piece] * np.exp(scales[of][rows] - scales[to][rows])

            for i, k, rows, piece in seen:
                while len(scales) <= (i - 1) // RESCALE:
                    at = (len(scales) - 1) * RESCALE + 1
                    top = forward[at : at + RESCALE].max(0)
                    scales.append(scales[-1] + np.log(np.where(top > 0, top, 1)))
                forward[i, rows] += forward[i - k, rows] * step(i, k, rows, piece)
            each = np.arange(len(own))
            backward[n, each] = counts[own] / forward[n, each]
            for i, k, rows, piece in reversed(seen):
                share = backward[i, rows] * step(i, k, rows, piece)
                np.add.at(expected, piece, share * forward[i - k, rows])
                backward[i - k, rows] += share
        common = expected.sum(1) + 0.01
        common = 0.99 * common / common.sum() + 0.01 / len(common)
        model.probs = (expected + smoothing * common[:, None] * 50) / (expected.sum(0) + smoothing * 50)
    return model


def sample_words(docs: DataFrame, most_docs: int = 200) -> list[tuple[str, bytes, int]]:
    """(lang, word, count): all words of a bounded sample of each language's documents.

    About ``most_docs`` documents of each language, drawn by a hash of doc_id
    at that language's own rate, so the sample stays the same size as the
    table grows. Words are counted before the shuffle.
    """
    ids = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL")
    # A row a language, of which there are some thousands at most; the hashes are spread evenly, so a share of them is about most_docs documents.
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(most_docs / r.n, 1.0)))) if counts else None
    if share is None:
        return []
    drawn = (F.xxhash64(F.col("doc_id"), F.lit(3)) / F.lit(2.0**64) + 0.5) <= F.element_at(share, F.col("lang"))
    words = ids.filter(drawn).select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("w")).filter("w <> ''")
    counted = materialise(words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")), "words")
    return sorted((r.lang, r.w.encode("utf-8", "replace"), r.n) for r in counted.toLocalIterator())


class WordScores:
    """Scores of words, those of the first CACHED different ones kept for the task's next texts."""

    def __init__(self, model: PieceModel):
        self.model, self.scaled = model, model.scaled()
        self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)))

    def of(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Scores of a batch's distinct words, and which of them each word is."""
        hashes, one, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        out = np.zeros((len(hashes), len(self.model.langs)))
        out[known] = self.scores[at[known]]
        new = np.flatnonzero(~known)
        out[new] = word_scores(self.model, self.scaled, words.data, words.starts[one[new]], words.ends[one[new]])
        keep = new[: CACHED - len(self.hashes)]
        if len(keep):
            all_, scores = np.concatenate([self.hashes, hashes[keep]]), np.concatenate([self.scores, out[keep]])
            order = np.argsort(all_)
            self.hashes, self.scores = all_[order], scores[order]
        return out, back


def identify(docs: DataFrame, training: DataFrame, held_out, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    ``training`` has doc_id, text, lang; rows without a language teach
    nothing. The score is the posterior of the predicted language under equal
    priors. A text that is null or has no letter is ``und`` with score 0, as
    is every text if nothing was learned; ties go to the first language by
    code point. Repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(sample_words(training), load_pieces(vocabulary)))
    schema = arrow_schema(spark.createDataFrame([], RESULT).schema)

    def run(batches):
        scores = WordScores(model.value)
        for batch in batches:
            if batch.num_rows:
                yield _predict(batch, scores, schema)

    return docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out")).mapInArrow(run, RESULT)


def _predict(batch: pa.RecordBatch, scores: WordScores, schema: pa.Schema) -> pa.RecordBatch:
    texts, langs = column(batch, "text"), scores.model.langs
    letters = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
    data, offsets = raw(texts)
    score = np.zeros((len(texts), max(len(langs), 1)))
    for rows in slices(offsets, CHUNK) if langs else ():
        words = tokenize(data, offsets, rows)
        if not len(words.hashes):
            continue
        each, back = scores.of(words)
        doc = words.doc_of_word()
        for k in range(each.shape[1]):
            score[rows, k] = np.bincount(doc, each[back, k], rows.stop - rows.start)
    best = score.argmax(1)
    post = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
    known = letters & bool(langs)
    said = [langs[k] if ok else "und" for k, ok in zip(best, known)]
    held = batch.column(batch.schema.get_field_index("held_out"))
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.get_field_index("doc_id")), held, pa.array(said, pa.string()), pa.array(np.where(known, post, 0.0))], schema=schema
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, docs.filter(~held).select("doc_id", "text", "lang"), held)

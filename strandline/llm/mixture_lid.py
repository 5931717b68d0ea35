"""Language identification by a mixture of language models per document.

Each language has a smoothed distribution over hashed letter trigrams, learnt
from all training rows.  A document's words are drawn from a mixture of the
languages: expectation-maximisation estimates the proportions from each word's
trigram likelihoods.  The languages are ranked by proportion, the mixture is
fitted again to the first one, two, ... of them, and the set with the best
likelihood less half the logarithm of the word count per language is taken.
Sets grow, to all languages if need be, while any document of the block can
still gain by a bound on its likelihood under any mixture.

Scale: training counts are summed per task over ``BINS`` bins, then by Spark;
the model takes 256 KB per language, whatever the input's size, and is sent to
each executor once.  More than ``MAX_LANGUAGES`` values of the training column
are an error that names them, not languages to be left out in silence.  Scoring
is one pass without a shuffle, in blocks of bounded size.  A long text is read
piece by piece, and its words of equal likelihoods are one row with their number,
so what is held of it grows with its different words.  Expectation-maximisation
goes on until no proportion moves by 0.001 in a round, or for ``ROUNDS`` rounds.

Defined results: of equal proportions the first language by name counts; ``und`` with score 0 for a null text, a text without a letter,
or an empty training set; a null id is in no held-out part; repeated rows are
scored alike; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import slices

BINS = 1 << 16
SMOOTHING = 0.5
#: Rounds after which a document whose proportions still move by 0.001 and more a round is taken as it is.
ROUNDS = 200
UNKNOWN = "und"
#: A model of so many languages takes 256 MB in each worker.
MAX_LANGUAGES = 1024
_BLOCK = 400_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def word_trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each letter's trigram, first trigram of each word, text of each word)."""
    lowered = [t.lower() for t in texts]
    lengths = np.array([len(t) + 1 for t in lowered])
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    padded = np.where(letter, codes, np.uint32(32))
    at = np.nonzero(letter)[0]
    h = padded[at - 1] * np.uint32(0x9E3779B1) ^ padded[at] * np.uint32(0x85EBCA77) ^ padded[at + 1] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    first = np.nonzero(~letter[at - 1])[0]
    text = np.searchsorted(np.cumsum(lengths), at[first] - 1, "right")
    return (h >> np.uint32(16)).astype(np.int64), first, text


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``_BLOCK`` characters: (index of the first, texts)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _BLOCK:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _split_at_spaces(text: str) -> list[str]:
    out, start = [], 0
    while len(text) - start > 2 * _BLOCK:
        cut = text.find(" ", start + _BLOCK)
        if cut < 0:
            break
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_p: np.ndarray  # (BINS, languages), float32

    def word_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages likelihoods over each word's best, text of each word)."""
        bins, first, text = word_trigrams(texts)
        if not len(first):
            return np.zeros((0, len(self.languages)), np.float32), text
        logs = np.add.reduceat(self.log_p[bins], first, axis=0)
        return np.exp(logs - logs.max(axis=1, keepdims=True)), text


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows of ``train`` that have a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = (batch.column(i).to_pylist() for i in (0, 1))
            by: dict[str, list[str]] = {}
            for t, x in zip(texts, langs, strict=True):
                by.setdefault(x, []).extend(_split_at_spaces(t))
            for x, ts in by.items():
                for _, block in _blocks(ts):
                    bins, _, _ = word_trigrams(block)
                    sums[x] = sums.get(x, 0) + np.bincount(bins, minlength=BINS)
        for x, n in sums.items():
            i = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(n[i].astype(np.int64))],
                ["lang", "bin", "n"],
            )

    known = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    values = train.where(F.col(lang).isNotNull()).select(lang).distinct().limit(MAX_LANGUAGES + 1).collect()
    if len(values) > MAX_LANGUAGES:
        some = ", ".join(sorted(repr(r[0]) for r in values)[:5])
        raise ValueError(f"more than {MAX_LANGUAGES} languages in column {lang}, such as {some}: clean it first")
    counts = known.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most BINS rows per language
    names = table["lang"].to_pylist()
    languages = tuple(sorted(set(names)))
    n = np.full((BINS, len(languages)), SMOOTHING)
    if languages:
        column = np.array([languages.index(x) for x in names])
        n[table["bin"].to_numpy(), column] += table["n"].to_numpy()
    return Model(languages, np.log(n / n.sum(axis=0)).astype(np.float32))


def _em(p: np.ndarray, starts: np.ndarray, counts: np.ndarray, active: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Proportions over ``active`` languages and log-likelihood, for every document at once.

    A row of ``p`` stands for one word, or for ``times`` words of equal likelihoods.
    A document is done when its own proportions settle, or after ``ROUNDS``; the others go on.
    """
    share = active / active.sum(axis=1, keepdims=True)
    floor = np.float32(1e-30)
    going, words, rows, first, t = np.arange(len(starts)), p, counts, starts, times
    n = counts if t is None else np.add.reduceat(t, starts)
    for _ in range(ROUNDS):
        part = words * np.repeat(share[going], rows, axis=0)
        part /= part.sum(axis=1, keepdims=True) + floor
        new = np.add.reduceat(part if t is None else part * t[:, None], first, axis=0) / n[:, None]
        moving = np.abs(new - share[going]).max(axis=1) >= 1e-3
        share[going] = new
        if not moving.any():
            break
        if not moving.all():
            kept = np.repeat(moving, rows)
            words, t = words[kept], None if t is None else t[kept]
            going, rows, n = going[moving], rows[moving], n[moving]
            first = np.cumsum(rows) - rows
    total = np.log(((p * np.repeat(share, counts, axis=0)).sum(axis=1) + floor).astype(np.float64))
    return share, np.add.reduceat(total if times is None else total * times, starts)


def _bound(p: np.ndarray, starts: np.ndarray, counts: np.ndarray, share: np.ndarray, likelihood: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """A log-likelihood that no mixture of a document exceeds.

    The log-likelihood is concave in the proportions, so the best one is at most
    its tangent's greatest value over all mixtures, which a single language takes.
    """
    total = (p * np.repeat(share, counts, axis=0)).sum(axis=1, keepdims=True) + np.float32(1e-30)
    ratio = (p / total).astype(np.float64)
    slope = np.add.reduceat(ratio if times is None else ratio * times[:, None], starts, axis=0)
    n = counts if times is None else np.add.reduceat(times, starts)
    return likelihood + np.maximum(slope.max(axis=1) - n, 0) + 1e-4 * n


def proportions(p: np.ndarray, starts: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Documents x languages: the chosen mixture of each document; rows of ``p`` are words, or stand for ``times`` words each."""
    counts = np.diff(np.append(starts, len(p)))
    words = counts if times is None else np.add.reduceat(times, starts)
    n = p.shape[1]
    share, likelihood = _em(p, starts, counts, np.ones((len(starts), n), np.float32), times)
    most = _bound(p, starts, counts, share, likelihood, times)
    place = np.empty_like(share, np.int64)
    np.put_along_axis(place, np.argsort(-share, axis=1, kind="stable"), np.arange(n)[None, :], axis=1)
    best, best_score = None, None
    for k in range(1, n + 1):
        if best is not None and (most - 0.5 * k * np.log(words + 1) <= best_score).all():
            break
        fitted, likelihood = _em(p, starts, counts, (place < k).astype(np.float32), times)
        score = likelihood - 0.5 * k * np.log(words + 1)
        if best is None:
            best, best_score = fitted, score
        else:
            better = score > best_score
            best = np.where(better[:, None], fitted, best)
            best_score = np.where(better, score, best_score)
    return best


#: Rows of one text that are kept apart; more are folded, and again when they have doubled.
_FOLD = 1 << 15


def _folded(p: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal likelihoods as one, with the number of their words."""
    unique, of = np.unique(p, axis=0, return_inverse=True)
    return unique, np.bincount(of.ravel(), times, len(unique))


def _long_text(text: str, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(likelihoods, words that have them) of a text of several pieces: what is held grows with its different words."""
    p, times = np.zeros((0, len(model.languages)), np.float32), np.zeros(0)
    limit = _FOLD
    for piece in _split_at_spaces(text):
        more, _ = model.word_likelihoods([piece])
        p, times = np.concatenate([p, more]), np.concatenate([times, np.ones(len(more))])
        if len(p) > limit:
            p, times = _folded(p, times)
            limit = max(_FOLD, 2 * len(p))
    return _folded(p, times)


def identify(texts: list[str], model: Model) -> tuple[list[str], list[float], list[str]]:
    """(language, its proportion, the whole mixture as text) for each text."""
    out = [(UNKNOWN, 0.0, "")] * len(texts)
    if not model.languages:
        return tuple(list(x) for x in zip(*out, strict=True))
    for start, block in _blocks(texts):
        # a block is a run of shorter texts, its last one may be long
        ends = len(block) - (len(block[-1]) > 2 * _BLOCK)
        p, owner_of = model.word_likelihoods(block[:ends])
        times = np.ones(len(p))
        if ends < len(block):
            more, words = _long_text(block[-1], model)
            p, owner_of, times = np.concatenate([p, more]), np.append(owner_of, np.full(len(more), ends)), np.append(times, words)
        if not len(p):
            continue
        starts = np.concatenate([[0], np.nonzero(np.diff(owner_of))[0] + 1])
        share = proportions(p, starts, times if ends < len(block) else None)
        for i, row in zip((start + owner_of[starts]).tolist(), share, strict=True):
            k = int(row.argmax())
            some = sorted(((float(v), x) for v, x in zip(row, model.languages, strict=True) if v >= 0.01), reverse=True)
            out[i] = (model.languages[k], float(min(1.0, row[k])), ",".join(f"{x}:{v:.2f}" for v, x in some))
    return tuple(list(x) for x in zip(*out, strict=True))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, mixture) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 500):
                lang, score, mixture = identify([t or "" for t in part.column(1).to_pylist()], shipped.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang), pa.array(score), pa.array(mixture)], [key, "lang_pred", "score", "mixture"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, lang_pred string, score double, mixture string")


def held_out(key: Column) -> Column:
    """One row in three, by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def train_and_predict(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))

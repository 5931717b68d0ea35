"""Quality classification by co-training of a text view and a metadata view.

The text view sees only what is written: hashed words and word pairs, whose
log-odds between good and bad documents are one part of it, and counts of
character classes, lines and repeats, which are the other; a logistic regression
weighs them.  The metadata view sees only source and language, alone and
together, and nothing that follows from the text.  In every round each view
labels the documents it is confident about for the other view, both are fitted
again, and in the end each view is calibrated on labelled documents that no fit
has seen; the calibrated log-odds are added, less the prior that both hold.

Log-odds of words are learnt on two halves of the documents, and a document is
always measured by those of the other half, so they never know it.  All pseudo-
labels together weigh at most as much as all labels, however many there are.

Scale: features are computed once into a table in the shared folder.  A round is
one pass over the words for their log-odds, one that writes the text view's few
numbers per document, Newton steps over those, and one count per value of the
metadata, on which that view is fitted without another pass.  All sums are over
all labelled and pseudo-labelled documents, with no sample; what reaches the
driver is one number per hash bin, coefficient pair or metadata value, whatever
the input's size.

Defined results: a null text counts as empty; null metadata is a value of its
own; labels that disagree about a document are not used; repeated rows and ties
are scored alike; a very long text is read whole, its bins being no more than
``GRAMS``; a score of exactly one half is kept; extra columns are not read;
without labels of both kinds every score is the prior, one half; an empty table
gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import discard, sent, slices, written

ROUNDS = 3
#: Newton steps after which a fit that has not met its tolerance is an error, and the most that one may move a coefficient.
STEPS, LONGEST_STEP = 50, 4.0
RIDGE = 1.0
SURE_GOOD, SURE_BAD = 0.98, 0.02
#: Weight of a pseudo-label beside a label's 1, before the bound on their sum.
PSEUDO_WEIGHT = 0.25
#: Hash bins of words and word pairs.
GRAMS = 1 << 16
#: Documents that each kind is taken to have beside those that have a word.
PRIOR_DOCUMENTS = 1.0
SOURCE_BINS, LANG_BINS, BOTH_BINS = 32, 16, 64

#: The most frequent function words of four languages.
STOPS = frozenset("the of and to in a is that le la les de et un une der die und el los y en que das est ist".split())

COUNTS = 18
TEXT_DIM, META_DIM = COUNTS + 2, 1 + SOURCE_BINS + LANG_BINS + BOTH_BINS
METAS = SOURCE_BINS * LANG_BINS * BOTH_BINS


def text_features(text: str) -> list[float]:
    raw = text.encode()
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    k, size = max(1, len(words)), max(1, len(raw))
    upper, lower, digit = int(n[65:91].sum()), int(n[97:123].sum()), int(n[48:58].sum())
    marks = int(n[[35, 36, 37, 38, 42, 60, 62, 124]].sum())
    punctuation = int(n[[33, 44, 46, 58, 59, 63]].sum())
    lines = [x for x in text.split("\n") if x]
    return [
        1.0,
        np.log1p(len(words)) / 10,
        min(20.0, len(text) / k) / 10,
        upper / max(1, upper + lower),
        upper / size,
        lower / size,
        digit / size,
        marks / k,
        min(5.0, float(n[33]) / k),
        min(5.0, float(n[124]) / k),
        punctuation / k,
        len(set(words)) / k,
        sum(map(eq, words, words[1:])) / k,
        sum(w in STOPS for w in words) / k,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)) / 10,
        float(len(words) < 50),
        float(not words),
    ]


def grams(text: str) -> np.ndarray:
    """Sorted hash bins of a text's words (A-Z lower-cased) and neighbouring pairs, each once."""
    words = text.encode().lower().split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.unique(np.concatenate([h, pair]) % np.uint64(GRAMS)).astype(np.uint16)


def meta_value(source: str | None, lang: str | None) -> int:
    """Hash bins of source, language and both as one number."""
    s, x = ("\0" if v is None else v for v in (source, lang))
    place = lambda v, bins: xxhash.xxh32_intdigest(v) % bins
    return (place(s, SOURCE_BINS) * LANG_BINS + place(x, LANG_BINS)) * BOTH_BINS + place(f"{s}\1{x}", BOTH_BINS)


def meta_matrix(values: np.ndarray) -> np.ndarray:
    """The metadata view's features of each value: a constant and three marks."""
    out = np.zeros((len(values), META_DIM))
    out[:, 0] = 1
    row = np.arange(len(values))
    out[row, 1 + values // (LANG_BINS * BOTH_BINS)] = 1
    out[row, 1 + SOURCE_BINS + values // BOTH_BINS % LANG_BINS] = 1
    out[row, 1 + SOURCE_BINS + LANG_BINS + values % BOTH_BINS] = 1
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_x, grams, meta) of every row: raw doubles, 16-bit bins, and a metadata value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                t, s, x = (part.column(i).to_pylist() for i in range(1, 4))
                one = [np.array(text_features(v or ""), "<f8").tobytes() for v in t]
                bins = [grams(v or "").tobytes() for v in t]
                meta = [meta_value(*v) for v in zip(s, x, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(one), pa.array(bins, pa.binary()), pa.array(meta, pa.int32())], ["doc_id", "text_x", "grams", "meta"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    return cols.mapInArrow(run, "doc_id long, text_x binary, grams binary, meta int")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """A batch of documents as arrays; ``name`` is the column of ``dim`` raw doubles."""

    def __init__(self, batch: pa.RecordBatch, name: str, dim: int):
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        self.x = np.frombuffer(b"".join(column(name).to_pylist()), "<f8").reshape(-1, dim)
        self.meta = column("meta").to_numpy().astype(np.int64)
        self.y = column("y").cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.part = column("part").to_numpy()
        if "grams" in batch.schema.names:
            self.half = column("half").to_numpy().astype(np.int64)
            raw = column("grams").to_pylist()
            self.n = np.array([len(x) // 2 for x in raw], np.int64)
            self.bins = np.frombuffer(b"".join(raw), np.uint16).astype(np.int64)
            self.of = np.repeat(np.arange(len(self.n)), self.n)

    def targets(self, verdict: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(target, whether a label gives it, whether the other view's confident log-odds do)."""
        known = ~np.isnan(self.y) & (self.part == 0)
        target, sure = np.nan_to_num(self.y), np.zeros(len(known), bool)
        if verdict is not None:
            p = _sigmoid(verdict)
            sure = np.isnan(self.y) & ((p >= SURE_GOOD) | (p <= SURE_BAD))
            target = np.where(sure, p >= 0.5, target)
        return target.astype(np.int64), known, sure


#: Tasks whose sums may meet in one group; more are added up in so many groups first.
MEET = 256


def _summed(table: DataFrame, size: int, gather: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """``gather(batch)``, ``size`` numbers, summed over a table.

    Each task sends its sums in blocks of 8 KB.  Where more than ``MEET`` tasks
    send them, a block's copies are added up in ``MEET`` groups before those sums
    meet, so no group holds more than tasks / ``MEET`` copies, or ``MEET``.
    """
    block = 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-size // block) * block)
        for batch in batches:
            total[:size] += gather(batch).ravel()
        rows = total.reshape(-1, block)
        i = np.nonzero(rows.any(axis=1))[0]
        of = pa.array([TaskContext.get().partitionId() % MEET] * len(i), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), of, pa.array([rows[k].tobytes() for k in i.tolist()], pa.binary())], ["i", "of", "v"])

    def add(part: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(part["v"].to_pylist()), "<f8").reshape(-1, block).sum(axis=0)
        return part.slice(0, 1).set_column(2, "v", pa.array([v.tobytes()], pa.binary()))

    kinds = "i int, of int, v binary"
    sums = table.mapInArrow(run, kinds)
    if table.rdd.getNumPartitions() > MEET:
        sums = sums.groupBy("i", "of").applyInArrow(add, kinds)
    got = sums.groupBy("i").applyInArrow(add, kinds).toArrow()
    out = np.zeros((-(-size // block), block))
    for i, v in zip(got["i"].to_pylist(), got["v"].to_pylist(), strict=True):
        out[i] = np.frombuffer(v, "<f8")
    return out.ravel()[:size]


def _weighed(labels: np.ndarray, pseudo: np.ndarray, n_labels: float, n_pseudo: float) -> np.ndarray:
    """Sums over labels and, scaled down, over pseudo-labels, which weigh no more than the labels altogether."""
    return labels + pseudo * min(PSEUDO_WEIGHT, n_labels / n_pseudo if n_pseudo else 0.0)


def fit_words(table: DataFrame, meta_z: np.ndarray | None) -> np.ndarray:
    """Log-odds of every bin, for each half of the documents, from how many good and bad documents have it.

    ``meta_z`` holds the metadata view's log-odds of each value, if it teaches.
    """
    bins, spare = 2 * 2 * GRAMS, 4

    def gather(batch: pa.RecordBatch) -> np.ndarray:
        rows = Rows(batch, "text_x", COUNTS)
        target, known, sure = rows.targets(None if meta_z is None else meta_z[rows.meta])
        out = np.zeros((2, bins + spare))
        kind = rows.half * 2 + target
        for k, chosen in enumerate((known, sure)):
            here = chosen[rows.of]
            out[k, :bins] = np.bincount(kind[rows.of[here]] * GRAMS + rows.bins[here], minlength=bins)
            out[k, bins:] = np.bincount(kind[chosen], minlength=spare)
        return out

    used = table if meta_z is not None else table.where("y IS NOT NULL AND part = 0")
    labels, pseudo = _summed(used, 2 * (bins + spare), gather).reshape(2, -1)
    total = _weighed(labels, pseudo, labels[bins:].sum(), pseudo[bins:].sum())
    have, all_ = total[:bins].reshape(2, 2, GRAMS), total[bins:].reshape(2, 2, 1)
    share = np.log((have + PRIOR_DOCUMENTS) / (all_ + 2 * PRIOR_DOCUMENTS))
    return np.where(have.sum(axis=1) > 0, share[:, 1] - share[:, 0], 0.0)


def text_view(table: DataFrame, odds: np.ndarray) -> DataFrame:
    """(doc_id, x, meta, y, part): the text view's numbers of each document, with the other half's word log-odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows(batch, "text_x", COUNTS)
            total = np.bincount(rows.of, odds[1 - rows.half[rows.of], rows.bins], len(rows.n))
            n = np.maximum(1, rows.n)
            x = np.column_stack([rows.x, np.clip(total / n, -4, 4), np.clip(total / np.sqrt(n), -40, 40) / 10])
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "meta", "y", "part")]
            yield pa.RecordBatch.from_arrays([keep[0], pa.array([v.tobytes() for v in x], pa.binary()), *keep[1:]], ["doc_id", "x", "meta", "y", "part"])

    return written(table.mapInArrow(run, "doc_id long, x binary, meta int, y int, part int"), "text-view")


def _step(w: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    step = np.linalg.solve(curve + RIDGE * np.eye(len(w)), slope - RIDGE * w)
    return step * min(1.0, LONGEST_STEP / max(np.abs(step).max(), LONGEST_STEP))


def fit_text(seen: DataFrame, start: np.ndarray, meta_z: np.ndarray | None) -> np.ndarray:
    """Newton steps of a ridge logistic regression; sums over all rows with a target."""
    used, w, dim = (seen if meta_z is not None else seen.where("y IS NOT NULL AND part = 0")), start, TEXT_DIM
    for _ in range(STEPS):
        now = w

        def gather(batch: pa.RecordBatch, now: np.ndarray = now) -> np.ndarray:
            rows = Rows(batch, "x", dim)
            target, known, sure = rows.targets(None if meta_z is None else meta_z[rows.meta])
            p = _sigmoid(rows.x @ now)
            out = np.zeros((2, dim + 1, dim + 1))
            for k, chosen in enumerate((known, sure)):
                out[k, 0, :dim] = rows.x.T @ (chosen * (target - p))
                out[k, 1:, :dim] = (rows.x * (chosen * p * (1 - p))[:, None]).T @ rows.x
                out[k, 0, dim] = chosen.sum()
            return out

        labels, pseudo = _summed(used, 2 * (dim + 1) ** 2, gather).reshape(2, dim + 1, dim + 1)
        total = _weighed(labels, pseudo, labels[0, dim], pseudo[0, dim])
        step = _step(w, total[0, :dim], total[1:, :dim])
        w = w + step
        if np.abs(step).max() < 1e-3:
            return w
    raise RuntimeError("the text view's fit does not settle")


def fit_meta(seen: DataFrame, text: np.ndarray | None) -> np.ndarray:
    """The metadata view's log-odds of each value: one count of targets per value, then Newton steps on those counts.

    ``text`` holds the text view's coefficients, if it teaches.
    """

    def gather(batch: pa.RecordBatch) -> np.ndarray:
        rows = Rows(batch, "x", TEXT_DIM)
        target, known, sure = rows.targets(None if text is None else rows.x @ text)
        return np.stack([np.bincount(target[c] * METAS + rows.meta[c], minlength=2 * METAS) for c in (known, sure)])

    used = seen if text is not None else seen.where("y IS NOT NULL AND part = 0")
    labels, pseudo = _summed(used, 4 * METAS, gather).reshape(2, -1)
    bad, good = _weighed(labels, pseudo, labels.sum(), pseudo.sum()).reshape(2, METAS)
    at = np.nonzero(bad + good)[0]
    x, n, w = meta_matrix(at), (bad + good)[at], np.zeros(META_DIM)
    for _ in range(STEPS):
        p = _sigmoid(x @ w)
        step = _step(w, x.T @ (good[at] - n * p), (x * (n * p * (1 - p))[:, None]).T @ x)
        w = w + step
        if np.abs(step).max() < 1e-3:
            return meta_matrix(np.arange(METAS)) @ w
    raise RuntimeError("the metadata view's fit does not settle")


def _scores(seen: DataFrame, text: np.ndarray, meta_z: np.ndarray) -> DataFrame:
    """(doc_id, text_z, meta_z, y, part): each view's log-odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows(batch, "x", TEXT_DIM)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "y", "part")]
            yield pa.RecordBatch.from_arrays([keep[0], pa.array(rows.x @ text), pa.array(meta_z[rows.meta]), *keep[1:]], ["doc_id", "text_z", "meta_z", "y", "part"])

    return seen.mapInArrow(run, "doc_id long, text_z double, meta_z double, y int, part int")


BIN = 0.25


def _calibrate(scored: DataFrame, z: str) -> tuple[float, float]:
    """Platt's scale and shift, from the counts of good and bad per bin of log-odds."""
    held = scored.where("y IS NOT NULL AND part = 1")
    bins = held.groupBy(F.round(F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col(z))) / BIN).cast("int").alias("b"))
    rows = bins.agg(F.count("*").alias("n"), F.sum("y").alias("good")).collect()  # at most 281
    if not rows:
        return 1.0, 0.0
    x = np.array([[r.b * BIN, 1.0] for r in rows])
    n, good = np.array([r.n for r in rows], float), np.array([r.good for r in rows], float)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ w)
        pull = np.diag([1.0, 0.01])
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull, x.T @ (good - n * p) - pull @ (w - [1.0, 0.0]))
        w = w + np.clip(step, -2, 2)
    return max(0.0, float(w[0])), float(w[1])


def classify(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score, kept."""
    agreed = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"))
    agreed = agreed.agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").select("_id", F.col("y").cast("int"))
    # one labelled document in four is left for calibration
    part = (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).cast("int")
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)).cast("int")
    raw = features(docs)
    agreed = written(agreed, "labels", labels.count())
    told = raw.join(sent(agreed, agreed.count()), raw.doc_id == agreed._id, "left")
    table = written(told.select("doc_id", "text_x", "grams", "meta", "y", part.alias("part"), half.alias("half")), "views")
    count = {(r.y, r.part): r.n for r in table.where("y IS NOT NULL").groupBy("y", "part").agg(F.count("*").alias("n")).collect()}
    good, bad = (sum(n for (y, _), n in count.items() if y == v) for v in (1, 0))
    text, meta_z = np.zeros(TEXT_DIM), np.zeros(METAS)
    if good and bad:
        seen = text_view(table, fit_words(table, None))
        text, meta_z = fit_text(seen, text, None), fit_meta(seen, None)
        for _ in range(rounds):
            # the text view's words and weights learn from the metadata view, then that view from the text view
            discard(seen)
            seen = text_view(table, fit_words(table, meta_z))
            text = fit_text(seen, text, meta_z)
            meta_z = fit_meta(seen, text)
    else:
        seen = text_view(table, np.zeros((2, GRAMS)))
    scored = _scores(seen, text, meta_z)
    prior = float(np.log(good / bad)) if good and bad else 0.0
    out = []
    for z in ("text_z", "meta_z"):
        a, b = _calibrate(scored, z) if good and bad else (1.0, 0.0)
        out.append(F.lit(a) * F.col(z) + F.lit(b))
    logistic = lambda c: 1 / (1 + F.exp(-c))
    both = logistic(out[0] + out[1] - F.lit(prior))
    return scored.select(
        "doc_id", logistic(out[0]).alias("text_score"), logistic(out[1]).alias("meta_score"), both.alias("score"), (both >= 0.5).alias("kept")
    )

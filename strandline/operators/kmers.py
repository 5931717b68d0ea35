"""k-mer joins, screens and statistics (FLT01-FLT03, FLT14, JN01-JN04, JN14-JN17, AG41, AG43, RM17, RM37, RM38, ST13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.alignment import seed_extension
from strandline.functions.sequence import kmer_array, kmers
from strandline.operators import bloom
from strandline.storage import TASK_ROWS, written


def counts(reads: DataFrame, seq: str, k: int) -> DataFrame:
    """AG41: (kmer, n) over all reads."""
    return kmers(reads.select(seq), seq, k).groupBy("kmer").agg(F.count("*").alias("n"))


#: Reference k-mers up to this many are sent to every task; of more a Bloom filter is sent.
BROADCAST_KEYS = 1_000_000
#: Pieces that a Bloom filter may have, each a pass over the reads; beyond that all k-mers are shuffled.
PIECES = 16


#: Tables under this size are dealt over all cores first: a small file may be a single split.
SPREAD_BYTES = 1 << 30


def _spread(reads: DataFrame) -> DataFrame:
    """``reads`` over as many partitions as there are cores if moving them costs little; large tables have splits enough."""
    size = int(str(reads._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return reads.repartition(reads.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else reads


#: For each byte a base's two bits; 4 for what is no base.
_BASE = np.full(256, 4, np.uint8)
_BASE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
#: Bytes of sequence that are packed at once.
_BLOCK = 1 << 17
#: Bases that a task turns into a direct filter at most, if the splits allow; not many fewer, as it may send all of the filter.
_DIRECT_BASES = 1 << 29


def packed_windows(raw: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, packed k-mer) of every window of valid bases, k up to 31.

    Codes of 1, 2, 4, ... bases are joined pairwise, so a window costs the
    logarithm of k and no string is made.
    """
    base = _BASE[np.frombuffer(raw, np.uint8)]
    n = len(base) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(base == 4)])
    code, width = (base & 3).astype(np.int64), 1
    out, have = np.zeros(n, np.int64), 0
    while True:
        if k & width:
            out = out << (2 * width) | code[have : have + n]
            have += width
        if have == k:
            break
        code = code[:-width] << (2 * width) | code[width:]
        width *= 2
    at = np.nonzero(bad[k:] == bad[:-k])[0]
    return at, out[at]


class _Known:
    """Membership in a sorted array of packed k-mers, through a table of bits that most strangers fail."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(16, min(26, int(16 * max(1, len(keys))).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self._slot(keys)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def among(self, codes: np.ndarray) -> np.ndarray:
        i = np.nonzero(self.bits[self._slot(codes)])[0]
        if not len(self.keys) or not len(i):
            return i[:0]
        at = np.minimum(np.searchsorted(self.keys, codes[i]), len(self.keys) - 1)
        return i[self.keys[at] == codes[i]]


_PAIRS, _NIBBLES = np.int64(0x3333333333333333), np.int64(0x0F0F0F0F0F0F0F0F)


def reverse_complements(codes: np.ndarray, k: int) -> np.ndarray:
    """Packed reverse complements of packed k-mers: A and T, C and G are 3 apart, so bases turn by NOT; they swap by pairs, fours and bytes."""
    out = ~codes
    out = out >> 2 & _PAIRS | (out & _PAIRS) << 2
    out = out >> 4 & _NIBBLES | (out & _NIBBLES) << 4
    return (out.byteswap().view(np.uint64) >> np.uint64(64 - 2 * k)).view(np.int64)


def window_minima(at: np.ndarray, codes: np.ndarray, w: int, mask: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(start, minimizer) of every full window of ``w`` neighbouring k-mers and of each shorter run.

    The least of a window is the one with the least code XOR ``mask``.
    """
    if not len(at):
        return at, codes
    first = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
    ends = np.append(first[1:], len(at))
    run = np.repeat(np.arange(len(first)), ends - first)
    order = codes ^ mask
    short = np.flatnonzero(ends - first < w)
    low = order.copy()
    have = 1  # low[i]: the least of the next ``have`` codes, wherever they are
    while have < w:
        step = min(have, w - have)
        low[: len(low) - step] = np.minimum(low[: len(low) - step], low[step:])
        have += step
    full = np.flatnonzero(np.arange(len(at)) + w <= ends[run])
    least = np.minimum.reduceat(order, first)[short]
    start, value = np.concatenate([at[full], at[first[short]]]), np.concatenate([low[full], least])
    by = np.argsort(start, kind="stable")
    return start[by], value[by] ^ mask


def _windows(batch: pa.RecordBatch, k: int, w: int = 1, both_strands: bool = False, mask: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(start, k-mer, ends of the rows, the first row) of blocks of rows (key, sequence); with ``both_strands`` each also turned."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + _BLOCK, "right")))
        texts = [(t or "").encode() for t in batch.column(1).slice(start, stop - start).to_pylist()]
        at, codes = packed_windows(b" ".join(texts), k)
        if w > 1:
            at, codes = window_minima(at, codes, w, mask)
        if both_strands:
            at, codes = np.concatenate([at, at]), np.concatenate([codes, reverse_complements(codes, k)])
        yield at, codes, np.cumsum([len(t) + 1 for t in texts]), start
        start = stop


def _distinct(at: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, k-mer), each once."""
    row = np.searchsorted(ends, at, "right")
    order = np.lexsort((codes, row))
    row, codes = row[order], codes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])
    return row[new], codes[new]


def _keys(k: int, w: int = 1, both_strands: bool = False, mask: int = 0, least: bool = False) -> bloom.Keys:
    """The k-mers of rows (key, sequence) as keys of a filter; with ``least`` the lesser of each k-mer and the turned one."""

    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, codes, _, _ in _windows(batch, k, w, both_strands, mask):
            yield np.minimum(codes, reverse_complements(codes, k)) if least else codes

    return run


def packed_kmers(
    reads: DataFrame, key: str, seq: str, k: int, known: np.ndarray | bloom.Piece | Broadcast | None = None, w: int = 1, both_strands: bool = False, mask: int = 0,
) -> DataFrame:
    """(key, kmer): each row's distinct valid k-mers as packed longs, only those among ``known`` where it is given.

    Packing runs over Arrow batches, several bases at a time for all reads of a
    block: a window costs no string.  ``known``, the keys or a piece of a Bloom
    filter, goes to each executor once.  With ``w`` above 1 only minimizers count;
    with ``both_strands`` the reverse complements count too.
    """
    if isinstance(known, np.ndarray):
        known = np.sort(known)
    shipped = known if known is None or isinstance(known, Broadcast) else reads.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None if shipped is None else shipped.value
        have = _Known(have) if isinstance(have, np.ndarray) else have
        for batch in batches:
            for at, codes, ends, start in _windows(batch, k, w, both_strands, mask):
                if have is not None:
                    i = have.among(codes)
                    at, codes = at[i], codes[i]
                row, codes = _distinct(at, codes, ends)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + start)), pa.array(codes)], [key, "kmer"])

    return reads.select(key, seq).mapInArrow(run, f"{key} {reads.schema[key].dataType.simpleString()}, kmer long")


def may_meet(
    reads: DataFrame, known: DataFrame, key: str, seq: str, k: int, exact: int | None = None, w: int = 1, mask: int = 0, both_strands: bool = False,
    keys: bloom.Keys | None = None,
) -> DataFrame:
    """FLT01: (key, kmer), written, of the reads' k-mers that may be in ``known``, a written table.

    ``known`` has the packed k-mers as they are, or ``keys`` packs them from its
    rows in the tasks; repeated ones do no harm.  Up to ``exact`` distinct
    ones (8 MB for a million) are sent as they are; of more a Bloom filter of
    ``bloom.BITS_PER_KEY`` bits each is sent, so what comes out is the true hits
    and ``bloom.false_positive_rate`` of all others.  A filter of several pieces is
    a pass over both sides for each, one at a time; only where it would have more
    than ``PIECES`` (a billion k-mers) do all k-mers come out.
    """
    exact = BROADCAST_KEYS if exact is None else exact
    known, keys = (known.select("kmer"), bloom.column) if keys is None else (known, keys)
    n = bloom.distinct(known, keys)
    if n <= exact:
        sent = bloom.listed(known, keys).toArrow()["kmer"].to_numpy().astype(np.int64)
        return written(packed_kmers(reads, key, seq, k, sent, w, both_strands, mask), "met")
    words = bloom.words_for(n)
    if words * 8 > PIECES * bloom.PIECE_BYTES:
        return written(packed_kmers(reads, key, seq, k, None, w, both_strands, mask), "met")
    passes = []
    for piece in bloom.built(known, words, keys):
        shipped = reads.sparkSession.sparkContext.broadcast(piece)
        passes.append(written(packed_kmers(reads, key, seq, k, shipped, w, both_strands, mask), "met"))
        shipped.destroy()
    return reduce(DataFrame.unionByName, passes)


def _sequences(rows: DataFrame, key: str, seq: str) -> tuple[DataFrame, int]:
    """The rows' keys and sequences, written, so that each further pass reads no more than them; and their bases."""
    table = written(_spread(rows.select(key, seq)), "sequences", "zstd")
    return table, table.agg(F.sum(F.length(seq).cast("long"))).first()[0] or 0


def _met(
    reads: DataFrame, reference: DataFrame, k: int, read_id: str, ref_id: str, seq: str,
    exact: int | None = None, w: int = 1, both_strands: bool = False, mask: int = 0, sizes: tuple[int, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(read, kmer) and (reference, kmer), written, that the other side may have; ``sizes`` are the bases of both where they have been written.

    The side with fewer bases is sent first, as keys or filter, and screens the
    other; what of that is left screens the first.  So neither side shuffles or
    writes what the other cannot have.  A k-mer comes out once for each row.
    """
    if sizes is None:
        (reads, of_reads), (reference, of_reference) = _sequences(reads, read_id, seq), _sequences(reference, ref_id, seq)
        sizes = of_reads, of_reference
    sides = [(reads, read_id, False), (reference, ref_id, both_strands)]
    (small, small_id, small_both), (large, large_id, large_both) = sides if sizes[0] < sizes[1] else sides[::-1]
    from_large = may_meet(large, small, large_id, seq, k, exact, w, mask, large_both, _keys(k, w, small_both, mask))
    from_small = may_meet(small, from_large, small_id, seq, k, exact, w, mask, small_both)
    return (from_small, from_large) if sizes[0] < sizes[1] else (from_large, from_small)


def matches(
    reads: DataFrame, reference: DataFrame, k: int, read_id: str, ref_id: str, seq: str = "seq", least: int = 1, exact: int | None = None,
) -> DataFrame:
    """JN01: (read, reference) with the number of distinct k-mers they share, at least ``least``; k up to 31.

    Each side is screened by the other where it is packed: by its k-mers, up to
    ``exact`` (a million) of them, or a Bloom filter, so that only k-mers the other
    has, or that the filter lets through, are ever shuffled; the join is exact
    either way, in a task for every ``TASK_ROWS`` of both sides.
    """
    a, b = _met(reads, reference, k, read_id, ref_id, seq, exact)
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, -(-(a.count() + b.count()) // TASK_ROWS))
    once = lambda rows: rows.repartition(tasks, "kmer").distinct()
    met = once(a).join(once(b), "kmer")  # each (read, k-mer) and (reference, k-mer) once, so each triple too
    return met.repartition(tasks, read_id, ref_id).groupBy(read_id, ref_id).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def _counted(reads: DataFrame, piece: bloom.Piece, key: str, seq: str, k: int, w: int, both_strands: bool, mask: int) -> DataFrame:
    """(key, found), written: the distinct k-mers that a direct filter has, counted where they are packed; only keys of several rows are shuffled by k-mer."""
    shipped = reads.sparkSession.sparkContext.broadcast(piece)

    def hits(rows: DataFrame, each: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = shipped.value
            for batch in batches:
                for at, codes, ends, start in _windows(batch, k, w, False, mask):
                    i = have.among(np.minimum(codes, reverse_complements(codes, k)) if both_strands else codes)
                    row, value = _distinct(at[i], codes[i], ends)
                    if not each:
                        row, value = np.unique(row, return_counts=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + start)), pa.array(value)], [key, name])

        name = "kmer" if each else "found"
        return rows.select(key, seq).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {name} long")

    several = written(reads.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("_key")), "repeated")
    if several.isEmpty():
        found = written(hits(reads, False), "found")
    else:
        here = F.col(key).eqNullSafe(F.col("_key"))
        rest = hits(reads.join(several, here, "left_semi"), True).distinct().groupBy(key).agg(F.count("*").alias("found"))
        found = written(hits(reads.join(several, here, "left_anti"), False).unionByName(rest), "found")
    shipped.destroy()
    return found


def _screened(
    reads: DataFrame, reference: DataFrame, k: int, read_id: str, seq: str, least: int, exact: int | None, w: int = 1, both_strands: bool = False, mask: int = 0,
) -> DataFrame:
    """Reads with at least ``least`` distinct k-mers of the reference, and how many.

    Where a filter of the reference's k-mers would have more bits than there are
    possible k-mers (k up to 15), each gets a bit of its own: that filter is exact,
    so reads are counted where they are packed and no k-mer is shuffled.  With
    ``both_strands`` it then has the lesser of each k-mer and its reverse complement.
    """
    key = reference.columns[0]
    (reads, of_reads), (reference, of_reference) = _sequences(reads, read_id, seq), _sequences(reference, key, seq)
    if 64 <= 4**k <= min(8 * bloom.PIECE_BYTES, bloom.BITS_PER_KEY * of_reference * 2 // (w + 1)):
        cores = reads.sparkSession.sparkContext.defaultParallelism
        rows = reference.select(key, seq).coalesce(cores * max(1, -(-of_reference // (cores * _DIRECT_BASES))))
        (piece,) = bloom.built(rows, 4**k // 64, _keys(k, w, False, mask, both_strands), direct=True)
        found = _counted(reads, piece, read_id, seq, k, w, both_strands, mask)
    else:
        a, b = _met(reads, reference, k, read_id, key, seq, exact, w, both_strands, mask, (of_reads, of_reference))
        found = a.join(b.select("kmer").distinct(), "kmer", "left_semi").distinct().groupBy(read_id).agg(F.count("*").alias("found"))
    return found.where(F.col("found") >= least)


def screen(
    reads: DataFrame, reference: DataFrame, k: int, read_id: str, seq: str = "seq", least: int = 3, exact: int | None = None, both_strands: bool = False,
) -> DataFrame:
    """FLT02: reads with at least ``least`` distinct k-mers of the reference, k up to 31; exact, so there are no false positives.

    With ``both_strands`` a k-mer also counts where the reference has its reverse complement.
    """
    return _screened(reads, reference, k, read_id, seq, least, exact, both_strands=both_strands)


def minimizer_screen(
    reads: DataFrame, reference: DataFrame, k: int, w: int, read_id: str, seq: str = "seq", exact: int | None = None, mask: int = 0,
) -> DataFrame:
    """FLT03: reads with any minimizer of the reference, and how many; the least k-mer of each ``w`` in a row, by code XOR ``mask``."""
    return _screened(reads, reference, k, read_id, seq, 1, exact, w, mask=mask)


def specificity(index: DataFrame, *owners: str) -> DataFrame:
    """RM37: distinct owners of each k-mer."""
    return index.groupBy("kmer").agg(*(F.count_distinct(o).alias(f"n_{o}") for o in owners))


def frequent_removed(index: DataFrame, owner: str, share: float = 0.75) -> DataFrame:
    """FLT14: the index without k-mers of more than ``share`` of all owners."""
    total = index.agg(F.count_distinct(owner).alias("_all"))
    per = index.groupBy("kmer").agg(F.count_distinct(owner).alias("_n"))
    keep = per.crossJoin(F.broadcast(total)).where(F.col("_n") <= share * F.col("_all")).select("kmer")
    return index.join(keep, "kmer", "left_semi")


def lost_kmers(before: DataFrame, after: DataFrame, key: str, k: int, seq: str = "seq") -> DataFrame:
    """RM38: k-mers of a sequence that its changed form lacks, counted per key."""
    a = kmers(before.select(key, seq), seq, k).select(key, "kmer").distinct()
    b = kmers(after.select(key, seq), seq, k).select(key, "kmer").distinct()
    return a.join(b, [key, "kmer"], "left_anti").groupBy(key).agg(F.count("*").alias("lost"))


def first_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """WN08: the first ``n`` rows of each group, for parity with fixed capacities."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(over)).where(F.col("_rank") <= n).drop("_rank")


def best_with_ties(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """WN07: every row with the best score of its group."""
    over = Window.partitionBy(*keys).orderBy(F.desc(score))
    return rows.withColumn("_rank", F.rank().over(over)).where(F.col("_rank") == 1).drop("_rank")


def looked_up(hits: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """JN14-JN17: left lookup, 0 where the table has no such key."""
    return hits.join(table, key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def seeds(frames: DataFrame, proteins: DataFrame, k: int = 8) -> DataFrame:
    """JN02: (read_id, frame, start, protein_id, q, t) where the words of an open stretch and a protein agree."""
    word = lambda df, seq, name: df.select(
        "*", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k)))).alias(name, "word")
    )
    a = word(frames.where(F.length("peptide") >= k), F.col("peptide"), "q").select("read_id", "frame", "start", "q", "word")
    b = word(proteins.where(F.length("protein") >= k), F.col("protein"), "t").select("protein_id", "t", "word")
    return a.join(b, "word").drop("word")


def protein_matches(
    frames: DataFrame, proteins: DataFrame, k: int = 8, least_seeds: int = 1, identity: float = 0.8, length: int = 20,
    most: int = 2, side: int = 50, positive: bool = False,
) -> DataFrame:
    """JN03, JN04: the first seed of each open stretch (read, frame, start) and protein, extended, if good enough.

    ``frames`` is (read_id, frame, start, peptide).  Seeds are grouped by ids;
    the texts join in afterwards, for the pairs that are left.
    """
    key = ["read_id", "frame", "start"]
    first = seeds(frames, proteins, k).groupBy(*key, "protein_id").agg(F.min(F.struct("q", "t")).alias("s"), F.count("*").alias("n_seeds"))
    pairs = first.where(F.col("n_seeds") >= least_seeds).join(frames.select(*key, "peptide").dropDuplicates(key), key)
    pairs = pairs.join(proteins.select("protein_id", "protein"), "protein_id")
    grown = pairs.withColumn("m", seed_extension(k, most, side, positive)(F.col("peptide"), F.col("protein"), F.col("s.q"), F.col("s.t")))
    out = grown.select(*key, "protein_id", "n_seeds", "m.*")
    return out.where((F.col("identity") >= identity) & (F.col("length") >= length))


def sampled(rows: DataFrame, key: str, rate: float, buckets: int = 10_000) -> DataFrame:
    """ST13: a share of the keys, by the first 32 bits of their MD5, so the same in every run and in any engine."""
    name = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return rows.where(F.pmod(name, F.lit(buckets)) < int(rate * buckets))


def candidates(hits: DataFrame) -> DataFrame:
    """RM14: each hit of a minimizer (kmer, taxon) as a candidate for an LCA, counted once."""
    return hits.select("kmer", "taxon", F.lit(1).alias("n"))


def kmer_set(seq: Column, k: int) -> Column:
    """Distinct valid k-mers of a sequence, as an array."""
    return F.array_distinct(F.transform(kmer_array(seq, k), lambda w: w["kmer"]))

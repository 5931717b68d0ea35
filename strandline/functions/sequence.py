"""Sequence scalar functions as Spark columns (inventory FN01-FN10, FN15-FN19, FN29-FN31, FN44).

All but ``dna_of_long_text`` are built-in expressions; null in, null out.  Bases are upper case;
packed k-mers are longs of two bits a base (A 0, C 1, G 2, T 3), null where a
base is none of these.
"""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BASES = "ACGT"

#: The standard genetic code (table 1), codons in T, C, A, G order.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
GENETIC_CODE = dict(zip(map("".join, product("TCAG", repeat=3)), AMINO_ACIDS, strict=True))

#: Fixed value: the order of residues in scoring tables; anything else counts as X.
RESIDUES = "ARNDCQEGHILKMFPSTWYVBZX*"


def encode_base(base: Column) -> Column:
    """FN01: 0 to 3, null for anything but A, C, G, T."""
    at = F.instr(F.lit(BASES), F.upper(base))
    return F.when((at > 0) & (F.length(base) == 1), at - 1)


def decode_base(code: Column) -> Column:
    """FN02."""
    return F.when(code.between(0, 3), F.substring(F.lit(BASES), code + 1, F.lit(1)))


def reverse_complement(seq: Column) -> Column:
    """FN03; U counts as T, other letters stay."""
    return F.reverse(F.translate(seq, "ACGTUacgtu", "TGCAAtgcaa"))


def is_dna(seq: Column) -> Column:
    return seq.rlike("^[ACGT]+$")


def pack(kmer: Column) -> Column:
    """FN05: packed k-mer for k up to 31."""
    return F.when(is_dna(kmer), F.conv(F.translate(kmer, BASES, "0123"), 4, 10).cast("long"))


def unpack(code: Column, k: int) -> Column:
    """FN07."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", BASES)


def pack_both(kmer: Column) -> Column:
    """FN06: struct of the packed k-mer and its packed reverse complement."""
    return F.struct(pack(kmer).alias("fwd"), pack(reverse_complement(kmer)).alias("rc"))


def reverse_complement_packed(code: Column, k: int) -> Column:
    """FN04."""
    return pack(reverse_complement(unpack(code, k)))


def canonical(kmer: Column) -> Column:
    """FN10: the lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def kmer_array(seq: Column, k: int, step: int = 1) -> Column:
    """FN08: array of (pos from 0, kmer) over valid windows."""
    starts = F.when(F.length(seq) >= k, F.sequence(F.lit(0), F.length(seq) - k, F.lit(step)))
    windows = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.substring(seq, i + 1, F.lit(k)).alias("kmer")))
    return F.filter(windows, lambda w: is_dna(w["kmer"]))


#: Windows are cut from blocks of this many starts: a substring walks its string from the front.
BLOCK = 256


def kmers(reads: DataFrame, seq: str, k: int, step: int = 1) -> DataFrame:
    """FN08 as a table function: ``reads`` without ``seq``, with pos and kmer."""
    rest = [c for c in reads.columns if c != seq]
    s, span = F.col(seq), BLOCK // step * step or step
    cut = lambda i: F.struct(i.alias("at"), F.substring(s, i + 1, F.lit(span - step + k)).alias("b"))
    blocks = F.explode(F.transform(F.when(F.length(s) >= k, F.sequence(F.lit(0), F.length(s) - k, F.lit(span))), cut)).alias("_b")
    b = F.col("_b.b")
    windows = F.transform(
        F.sequence(F.lit(0), F.length(b) - k, F.lit(step)),
        lambda i: F.struct((F.col("_b.at") + i).alias("pos"), F.substring(b, i + 1, F.lit(k)).alias("kmer")),
    )
    fine = F.when(is_dna(b), windows).otherwise(F.filter(windows, lambda w: is_dna(w["kmer"])))
    return reads.select(*rest, blocks).select(*rest, F.explode(fine).alias("_w")).select(*rest, "_w.pos", "_w.kmer")


def kmers_both_strands(reads: DataFrame, seq: str, k: int) -> DataFrame:
    """FN09: k-mers of both strands; places on the reverse strand are given on the original (n - i - k)."""
    forward = kmers(reads, seq, k).withColumn("strand", F.lit("+"))
    rest = [c for c in reads.columns if c != seq]
    turned = reads.select(*rest, F.length(seq).alias("_n"), reverse_complement(F.col(seq)).alias(seq))
    back = kmers(turned, seq, k).withColumn("pos", F.col("_n") - F.col("pos") - k).withColumn("strand", F.lit("-"))
    return forward.unionByName(back.drop("_n"))


def spaced(kmer: Column, spaces: int) -> Column:
    """FN15: the k-mer without every (spaces + 1)-th base."""
    if spaces < 1:
        return kmer
    kept = F.filter(F.split(kmer, ""), lambda c, i: (i + 1) % (spaces + 1) != 0)
    return F.array_join(kept, "")


def is_ambiguous(seq: Column) -> Column:
    """FN16."""
    return seq.rlike("[^ACGTacgt]")


def _code_map() -> Column:
    return F.create_map(*(F.lit(x) for kv in GENETIC_CODE.items() for x in kv))


def translate_codon(codon: Column) -> Column:
    """FN17: the amino acid, X for an invalid codon."""
    return F.coalesce(F.try_element_at(_code_map(), F.upper(codon)), F.lit("X"))


def translate_frame(seq: Column, frame: int) -> Column:
    """The peptide of forward frame 0, 1 or 2; stops are ``*``."""
    # codons are cut by one pass of a pattern: a substring would walk the sequence from its front each time
    code, whole = _code_map(), F.substring(seq, F.lit(frame + 1), F.greatest(F.length(seq), F.lit(1)))
    codons = F.regexp_extract_all(whole, F.lit("(?s)..."), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")


def open_stretches(peptide: Column) -> Column:
    """Array of (start from 0, peptide) between the stops of a frame, in order."""
    stops = F.filter(F.transform(F.split(peptide, ""), lambda c, i: F.when(c == "*", i)), lambda i: i.isNotNull())
    starts = F.concat(F.array(F.lit(0)), F.transform(stops, lambda i: i + 1))
    return F.arrays_zip(starts.alias("start"), F.split(peptide, r"\*").alias("peptide"))


def six_frames(reads: DataFrame, seq: str, min_length: int = 20) -> DataFrame:
    """FN18: open stretches of all six frames: frame (1..3, -1..-3), start (aa) and peptide.

    All of it happens inside a row, so repeated reads keep their own stretches and nothing is shuffled.
    """
    rest = [c for c in reads.columns if c != seq]
    up, down = F.upper(F.col(seq)), reverse_complement(F.upper(F.col(seq)))
    frames = F.array(
        *(F.struct(F.lit(s * (f + 1)).alias("frame"), translate_frame(x, f).alias("peptide")) for s, x in ((1, up), (-1, down)) for f in range(3))
    )
    each = reads.select(*rest, F.explode(frames).alias("_f")).select(*rest, "_f.frame", F.explode(open_stretches(F.col("_f.peptide"))).alias("_p"))
    return each.select(*rest, "frame", "_p.start", "_p.peptide").where(F.length("peptide") >= min_length)


def residue_index(residue: Column) -> Column:
    """FN19: place in ``RESIDUES``, that of X for anything else."""
    at = F.instr(F.lit(RESIDUES), residue)
    return F.when(at > 0, at - 1).otherwise(F.lit(RESIDUES.index("X")))


def gc_percent(seq: Column) -> Column:
    """FN29: share of G and C among A, C, G, T in per cent; null without any."""
    known = F.length(F.regexp_replace(seq, "[^ACGT]", ""))
    return 100.0 * F.length(F.regexp_replace(seq, "[^GC]", "")) / F.nullif(known, F.lit(0))


def clean(seq: Column) -> Column:
    """FN30: upper case; X, *, - and . become N, other characters go."""
    return F.regexp_replace(F.translate(F.upper(seq), "X*-.", "NNNN"), "[^ACGTN]", "")


def valid_fraction(seq: Column) -> Column:
    """FN30: share of A, C, G, T in the cleaned sequence; null where it is empty."""
    c = clean(seq)
    return F.length(F.regexp_replace(c, "N", "")) / F.nullif(F.length(c), F.lit(0))


def is_homopolymer(kmer: Column, k: int, share: float = 0.7) -> Column:
    """FN31: a run of one base longer than ``share`` of the k-mer."""
    return kmer.rlike(rf"(.)\1{{{int(k * share)},}}")


def transitions(kmer: Column) -> Column:
    """FN31: places where neighbouring bases differ."""
    return F.size(F.filter(F.sequence(F.lit(1), F.length(kmer) - 1), lambda i: F.substring(kmer, i, F.lit(1)) != F.substring(kmer, i + 1, F.lit(1))))


def is_low_complexity(kmer: Column, least: int = 8) -> Column:
    return transitions(kmer) < least


def residues_to_bases(seq: Column, first: int, last: int) -> Column:
    """FN44: the bases of residues ``first`` to ``last`` (from 1, inclusive)."""
    return F.substring(seq, (first - 1) * 3 + 1, (last - first + 1) * 3)


def mean_quality(qual: Column, offset: int = 33) -> Column:
    """FLT16: mean Phred quality of a quality string."""
    total = F.aggregate(F.split(qual, ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.ascii(c) - offset))
    return total / F.nullif(F.length(qual), F.lit(0))


#: Stand-in for reads in tables of prose: letters become bases by their place in the alphabet.
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def dna_of_text(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), ALPHABET, (BASES * 7)[:26]), "[^ACGT]", "")


_LETTERS = (ALPHABET + ALPHABET.upper()).encode()
_AS_BASES, _OTHERS = bytes.maketrans(_LETTERS, ((BASES * 7)[:26] * 2).encode()), bytes(set(range(256)) - set(_LETTERS))


@F.arrow_udf(StringType())
def dna_of_long_text(text: pa.Array) -> pa.Array:
    """``dna_of_text`` byte by byte over Arrow batches, for tables of which the letters are most of the work."""

    def bases(t: bytes | None) -> bytes | None:
        if t is None:
            return None
        if not t.isascii():  # the two other characters that have lower case in ASCII
            t = t.replace("\u212a".encode(), b"k").replace("\u0130".encode(), b"i")
        return t.translate(_AS_BASES, _OTHERS)

    return pa.array([bases(t) for t in text.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())

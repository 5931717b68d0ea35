"""Gene name functions (inventory FN22-FN28, FN39, FN43, FN45)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes (lower case, after a leading ``bla``) and their families, most specific first.
FAMILY_PREFIXES = (
    ("ctx-m", "CTX-M"), ("tem", "TEM"), ("shv", "SHV"), ("oxa", "OXA"), ("kpc", "KPC"), ("ndm", "NDM"),
    ("vim", "VIM"), ("imp", "IMP"), ("qep", "qepA"), ("aac(6')-ib-cr", "aac6-Ib-cr"), ("aac(6')", "aac6"),
    ("aac(3)", "aac3"), ('ant(2")', "ant2"), ('ant(3")', "ant3"), ("aph(3')", "aph3"), ("aph(6)", "aph6"),
    ("arma", "armA"), ("rmta", "rmtA"), ("rmtb", "rmtB"), ("erm", "erm"), ("mef", "mef"), ("mph", "mph"),
    ("mcr", "mcr"), ("sul", "sul"),
)

#: The phylogenetic group of each CTX-M variant.
CTXM_GROUPS = {
    "1": 1, "2": 2, "3": 1, "4": 2, "5": 2, "6": 2, "7": 2, "8": 3, "9": 4, "10": 1, "11": 1, "12": 1, "13": 4, "14": 4,
    "15": 1, "16": 4, "17": 4, "18": 4, "19": 4, "20": 2, "21": 4, "23": 1, "25": 5, "26": 5, "27": 5, "28": 1, "39": 5,
    "40": 3, "41": 3, "42": 5,
}

#: Prior weights by variant.
VARIANT_PRIORS = {
    "CTX-M-15": 3.0, "CTX-M-1": 2.5, "CTX-M-14": 2.0, "CTX-M-27": 1.8, "CTX-M-3": 1.5, "CTX-M-2": 1.3,
    "TEM-1": 2.5, "TEM-52": 1.8, "TEM-116": 1.5, "TEM-135": 1.3,
    "SHV-1": 2.0, "SHV-12": 1.5, "SHV-5": 1.3, "SHV-2": 1.2,
    "KPC-2": 2.0, "KPC-3": 1.8, "NDM-1": 2.2, "NDM-5": 1.5, "OXA-48": 1.8, "OXA-181": 1.3, "VIM-1": 1.5, "IMP-1": 1.3,
    "qnrA1": 1.5, "qnrB1": 1.8, "qnrB2": 1.3, "qnrB4": 1.2, "qnrB6": 1.1, "qnrC": 1.0, "qnrS1": 1.4,
    "aac(6')-Ib": 1.8, "aac(6')-Ib-cr": 1.5, "aac(3)-Ia": 1.3, 'ant(2")-Ia': 1.2, "aph(3')-Ia": 1.4, "armA": 1.6, "rmtB": 1.3,
    "mcr-1": 0.8, "mcr-2": 0.3, "mcr-3": 0.2, "vanA": 0.5, "vanB": 0.3, "vanC": 0.2,
}

#: Prior weights by family.
FAMILY_PRIORS = {
    "CTX-M": 1.5, "TEM": 1.3, "SHV": 1.2, "KPC": 1.0, "NDM": 1.0, "OXA": 1.1, "VIM": 0.8, "IMP": 0.7,
    "qnrA": 1.0, "qnrB": 1.2, "qnrC": 0.8, "qnrS": 1.0, "aac6": 1.2, "aac3": 1.0, "ant2": 0.9, "ant3": 0.8,
    "aph3": 1.0, "armA": 1.0, "rmtA": 0.8, "rmtB": 0.9, "tet": 1.1, "sul": 1.0, "erm": 0.9, "mef": 0.8,
    "mcr": 0.3, "vanA": 0.3, "vanB": 0.2,
}


def bare_name(name: Column) -> Column:
    """The name without a leading ``bla``."""
    return F.regexp_replace(name, "^(?i)bla(?=[A-Za-z])", "")


def gene_family(name: Column) -> Column:
    """FN22: family by prefix, else the lower-case name up to a dash or digit."""
    low = F.lower(bare_name(name))
    rest = F.when(low.contains("-"), F.substring_index(low, "-", 1)).when(low.rlike("^[^0-9]+[0-9]"), F.regexp_extract(low, "^[^0-9]+", 0)).otherwise(low)
    letter = lambda p, i: F.concat(F.lit(p), F.upper(F.substring(low, i, 1)))
    out = F.when(low.rlike(r"^qnr[^a-z]?[a-z]"), F.concat(F.lit("qnr"), F.upper(F.regexp_extract(low, "^qnr[^a-z]?([a-z])", 1))))
    out = out.when(low.startswith("qnr"), "qnr").when(low.rlike(r"^tet\(.*\)"), F.concat(F.lit("tet"), F.regexp_extract(low, r"\([^)]*\)", 0)))
    out = out.when(low.startswith("tet("), "tet").when(low.rlike("^van."), letter("van", 4)).when(low == "van", "van")
    for prefix, family in FAMILY_PREFIXES:
        out = out.when(low.startswith(prefix), family)
    return out.otherwise(rest)


def gene_variant(name: Column) -> Column:
    """FN23: what follows the family, without one separator; empty if nothing does."""
    bare = bare_name(name)
    return F.regexp_replace(F.substring(bare, F.length(gene_family(name)) + 1, F.length(bare)), "^[-_]", "")


def name_similarity(a: Column, b: Column) -> Column:
    """FN24: similarity of two gene names by family and variant."""
    groups = F.create_map(*(F.lit(x) for kv in CTXM_GROUPS.items() for x in kv))

    def rule(p: Column) -> Column:
        fa, fb, va, vb = (p[c] for c in ("fa", "fb", "va", "vb"))
        ga, gb = F.try_element_at(groups, va), F.try_element_at(groups, vb)
        ctxm = F.when(ga.isNull() | gb.isNull(), 0.7).when(ga == gb, 0.9).otherwise(0.6)
        return (
            F.when(p["a"] == p["b"], 1.0)
            .when(fa != fb, 0.05)
            .when((va == "") | (vb == ""), 0.7)
            .when(va == vb, 0.95)
            .when(fa == "CTX-M", ctxm)
            .when(fa == "TEM", F.when((va == "1") | (vb == "1"), 0.8).otherwise(0.75))
            .when(fa.isin("qnrA", "qnrB", "qnrC"), 0.8)
            .otherwise(0.7)
        )

    # families and variants are long expressions: bound once, they do not multiply in the rule
    parts = F.struct(a.alias("a"), b.alias("b"), gene_family(a).alias("fa"), gene_family(b).alias("fb"), gene_variant(a).alias("va"), gene_variant(b).alias("vb"))
    return F.transform(F.array(parts), rule)[0]


def _lookup(values: dict[str, float], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def prior_weight(name: Column) -> Column:
    """FN25: prior by variant, else by family, else 1."""
    return F.coalesce(_lookup(VARIANT_PRIORS, bare_name(name)), _lookup(FAMILY_PRIORS, gene_family(name)), F.lit(1.0))


def assignment_score(identity: Column, coverage: Column, length: Column, concordant: Column, frame: Column) -> Column:
    """FN26: identity and coverage, less for short hits, more for concordant ones."""
    return (
        identity * coverage * F.least(F.lit(1.0), length / 50.0) * F.when(concordant, 1.2).otherwise(1.0) * F.when(F.abs(frame) <= 3, 1.0).otherwise(0.9)
    )


def normalised_species(name: Column) -> Column:
    """FN27: blanks become underscores."""
    return F.regexp_replace(F.trim(name), r"\s+", "_")


def mutation_code(wild: Column, pos: Column, mutant: Column) -> Column:
    """FN28: such as S83L."""
    return F.concat(wild, pos.cast("string"), mutant)


def parse_mutation(code: Column) -> Column:
    """FN45: struct(wild, pos, mutant); null for anything else."""
    shape = "^([A-Z])([0-9]+)([A-Z])$"
    part = lambda i: F.regexp_extract(code, shape, i)
    return F.when(code.rlike(shape), F.struct(part(1).alias("wild"), part(2).cast("int").alias("pos"), part(3).alias("mutant")))


#: Quinolone resistance determining regions, in residues.
QRDR = {"gyrA": (67, 106), "gyrB": (426, 464), "parC": (64, 102), "parE": (410, 450), "grlA": (64, 102), "grlB": (410, 450)}

#: Positions known for resistance.
KNOWN_POSITIONS = {"gyrA": (83, 87), "parC": (80, 84), "gyrB": (426, 447), "parE": (416, 420)}


def in_qrdr(gene: Column, pos: Column) -> Column:
    """FLT11."""
    out = F.lit(False)
    for g, (lo, hi) in QRDR.items():
        out |= (gene == g) & pos.between(lo, hi)
    return F.coalesce(out, F.lit(False))


def resistance_confidence(gene: Column, mutations: Column, identity: Column, length: Column) -> Column:
    """FN39: the best known-position mutation's weight; mutations: array of struct(pos, blosum)."""
    known = F.lit(False)
    at = lambda m: F.coalesce(
        *(F.when((gene == g) & m["pos"].isin(*ps), F.lit(True)) for g, ps in KNOWN_POSITIONS.items()), known
    )
    each = F.transform(F.filter(mutations, at), lambda m: 2.0 * ((m["blosum"] + 4.0) / 8.0) * identity * F.least(F.lit(1.0), length / 30.0))
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(each), F.lit(0.0)))


def sequence_quality(seq: Column, priority: Column) -> Column:
    """FN43: score for choosing a wild-type sequence."""
    n = F.length(seq)
    count = lambda chars: n - F.length(F.translate(seq, chars, ""))
    return (
        F.when(n.between(50, 1000), 10.0).when(n.between(20, 50) | n.between(1001, 2000), 5.0).otherwise(0.0)
        + F.when(count("WCM") / F.nullif(n, F.lit(0)) < 0.1, 5.0).otherwise(0.0)
        + F.when(priority, 20.0).otherwise(0.0)
        - F.when(count("*") > 1, 10.0).otherwise(0.0)
        - F.when(seq.contains("XX"), 5.0).otherwise(0.0)
    )

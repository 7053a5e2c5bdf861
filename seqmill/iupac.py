"""Nucleotide wildcard codes and the tables derived from them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Bases that each nucleotide code stands for.
BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
#: The code of a set of bases, written in alphabetical order.
CODE_OF = {bases: code for code, bases in BASES.items()}
WILDCARDS = "RYKMSWBDHVN"
# Fixed value: complement of each code, in both cases.
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTURYKMBVDHacgturykmbvdh", "TGCAAYRMKVBHDtgcaayrmkvbhd"
#: Twelfths of a vote that a code gives to each of its bases.
TWELFTHS = {code: 12 // len(bases) for code, bases in BASES.items()}
# Fixed value: a third as the reference behaviour rounds it.
LEGACY_THIRD = 0.33333


def code_map(values: dict[str, object]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def same(a: str, b: str) -> float:
    """Chance that two codes stand for the same base; gaps match nothing."""
    x, y = BASES.get(a), BASES.get(b)
    if x is None or y is None:
        return 0.0
    return len(set(x) & set(y)) / (len(x) * len(y))


#: Equality scores of all ordered pairs of codes.
PAIR_SCORE = {a + b: same(a, b) for a in BASES for b in BASES}


def vote_weights(legacy: bool = False) -> dict[str, dict[str, float]]:
    """Votes per base of each code; with ``legacy`` a third is 0.33333."""
    third = LEGACY_THIRD if legacy else 1 / 3
    return {code: {b: third if len(bases) == 3 else 1 / len(bases) for b in bases} for code, bases in BASES.items()}

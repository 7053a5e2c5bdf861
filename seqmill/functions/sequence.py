"""Column expressions over sequences, headers, names and coordinates.

All are built-in JVM expressions: null in, null out, unless said otherwise.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, functions as F

from ..iupac import COMPLEMENT_FROM, COMPLEMENT_TO, WILDCARDS

# ---------------------------------------------------------------- headers


def accession_of(description: Column, stop_at_blank: bool = True) -> Column:
    """Accession at the head of ``ACC:start-end|organism|title``."""
    head = F.substring_index(description, " ", 1) if stop_at_blank else description
    return F.substring_index(F.substring_index(head, "|", 1), ":", 1)


def hit_id_accession(hit_id: Column) -> Column:
    """Accession of a ``gi|..|gb|ACC|`` identifier; a last part of one or two
    characters (a chain) is appended."""
    parts = F.split(hit_id, r"\|")
    last, acc = F.element_at(parts, -1), F.element_at(parts, -2)
    return F.when(F.size(parts) < 2, hit_id).when(F.length(last).between(1, 2), F.concat_ws("_", acc, last)).otherwise(acc)


def header_of(accession: Column, start: Column, seq: Column, reverse: Column, organism: Column, title: Column) -> Column:
    """FASTA header of a fetched region, with the start clamped to 1."""
    first = F.greatest(start, F.lit(1))
    last = first + F.length(seq) - 1
    name = F.replace(organism, F.lit(" "), F.lit("_"))
    return F.concat(accession, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.when(reverse, F.lit("_reverse_complement")).otherwise(F.lit("")), F.lit("|"), name, F.lit("|"), title)


def rewrite_coordinates(description: Column, start: Column, end: Column) -> Column:
    """Replace the first ``digits-digits`` of a header."""
    new = F.concat(F.lit("$1"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.regexp_replace(description, F.lit(r"^(.*?)\d+-\d+"), new)


def encodable(text: Column, charset: str = "gbk") -> Column:
    """True if ``text`` can be written in ``charset`` (Arrow UDF; the charset is
    not among those Spark encodes to)."""

    def check(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else _fits(v, charset)).astype("object")

    return F.pandas_udf(check, "boolean")(text)


def _fits(text: str, charset: str) -> bool:
    try:
        text.encode(charset)
        return True
    except UnicodeEncodeError:
        return False


# ------------------------------------------------------------------ names

# Rank tokens below species, in the order in which they cut.
RANKS = {"subsp": (" subsp. ", " subsp ", " ssp. ", " ssp "), "var": (" var. ", " var "), "f": (" f. ", " f ")}
# Marks of uncertain names between underscores or blanks.
UNCERTAIN = ("sp", "cf", "aff", "x")


def combine_species(organism: Column, subsp: bool = True, var: bool = True, f: bool = True) -> Column:
    """Species name of an infraspecific one: cut at each rank token in turn."""
    on = {"subsp": subsp, "var": var, "f": f}
    tokens = [t for rank, ts in RANKS.items() if on[rank] for t in ts]
    return functools.reduce(lambda c, t: F.substring_index(c, t, 1), tokens, organism)


def is_uncertain(organism: Column, kinds: tuple[str, ...] = UNCERTAIN) -> Column:
    """``_sp._``, ``_sp_`` and the like anywhere in the underscored name."""
    if not kinds:
        return F.lit(False)
    return F.replace(organism, F.lit(" "), F.lit("_")).rlike(f"_({'|'.join(kinds)})\\.?_")


def underscored(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def without_apostrophes(name: Column) -> Column:
    return F.replace(name, F.lit("'"), F.lit(""))


def taxonomy_path(taxonomy: Column) -> Column:
    return F.split(taxonomy, r"\|")


def genus_of(path: Column) -> Column:
    """Last element of a lineage array without a blank."""
    return F.try_element_at(F.filter(path, lambda x: ~F.contains(x, F.lit(" "))), F.lit(-1))


def upper_taxon(path: Column, name: Column) -> Column:
    """First element without a blank above ``name``, from its end upwards."""
    at = F.array_position(path, name)
    above = F.when(at > 1, F.slice(path, 1, F.greatest(at - 1, F.lit(1)).cast("int")))
    return F.try_element_at(F.filter(above, lambda x: ~F.contains(x, F.lit(" "))), F.lit(-1))


# -------------------------------------------------------------- sequences


def ungapped(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def length_without_wildcards(seq: Column) -> Column:
    """Length without wildcard codes; gaps count."""
    return F.length(F.translate(F.upper(seq), WILDCARDS, "")).cast("long")


def acgt_count(seq: Column) -> Column:
    return F.regexp_count(F.upper(seq), F.lit("[ACGT]")).cast("long")


def strip_wildcards(seq: Column) -> Column:
    return F.translate(F.upper(seq), WILDCARDS, "")


def trim_residues(seq: Column, start: Column, end: Column) -> Column:
    """Residues start..end, from 1, both included."""
    return F.substring(seq, start.cast("int"), (end - start + 1).cast("int"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def missing_ends(seq: Column) -> tuple[Column, Column]:
    """Characters before the first and after the last of A, C, G, T."""
    text = F.upper(seq)
    left = F.length(F.regexp_extract(text, "^([^ACGT]*)", 1)).cast("long")
    right = F.length(F.regexp_extract(text, "([^ACGT]*)$", 1)).cast("long")
    return left, right


def residue_span(seq: Column) -> tuple[Column, Column]:
    """Indexes, from 0, of the first and last character that is no gap."""
    left = F.length(F.regexp_extract(seq, "^(-*)", 1))
    right = F.length(seq) - 1 - F.length(F.regexp_extract(seq, "(-*)$", 1))
    return left.cast("long"), right.cast("long")


def blank_end_gaps(seq: Column) -> Column:
    """Leading and trailing gaps become blanks."""
    left = F.length(F.regexp_extract(seq, "^(-*)", 1))
    body = F.regexp_replace(seq, "^-+|-+$", "")
    return F.rpad(F.concat(F.repeat(F.lit(" "), left), body), F.length(seq), F.lit(" "))


def aligned_position(seq: Column, raw: Column) -> Column:
    """Column, from 1, of the ``raw``-th residue; 0 for 0, null if there is none."""
    found = F.aggregate(
        F.split(seq, ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("at")),
        lambda s, c: F.struct(
            (s["i"] + 1).alias("i"),
            (s["n"] + (c != "-").cast("int")).alias("n"),
            F.when(s["at"].isNull() & (c != "-") & (s["n"] + 1 == raw), s["i"] + 1).otherwise(s["at"]).alias("at"),
        ),
    )["at"]
    return F.when(raw == 0, F.lit(0)).otherwise(found).cast("long")


def raw_position(seq: Column, aligned: Column) -> Column:
    """Residues up to column ``aligned`` (from 1)."""
    return F.length(ungapped(F.substring(seq, F.lit(1), aligned.cast("int")))).cast("long")


def infer_alphabet(seq: Column) -> Column:
    """DNA, RNA or AA of one sequence by its first 100 letters."""
    head = F.substring(ungapped(seq), 1, 100)
    n = F.length(head)
    dna, rna = (F.regexp_count(head, F.lit(p)) / n for p in ("[AGCTN]", "[AGCUN]"))
    return F.when((dna < 0.95) & (rna < 0.95), "AA").when(rna > dna, "RNA").otherwise("DNA")


# ------------------------------------------------------------------ k-mers


def kmers(seq: Column, k: int) -> Column:
    """All words of ``k`` letters, step 1; an empty array for shorter ones."""
    n = F.length(seq)
    at = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
    words = F.transform(at, lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(n >= k, words).otherwise(F.array().cast("array<string>"))


def kmer_index(word: Column) -> Column:
    """Base-4 number of a word, digits A, C, G, T; null with another letter."""
    value = F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("long")
    return F.when(word.rlike("^[ACGT]+$"), value)


def expand_wildcards(word: Column) -> Column:
    """All words a word with wildcard codes stands for, in order."""
    from ..iupac import BASES, code_map

    options = code_map({c: b for c, b in BASES.items()})

    def grow(words: Column, c: Column) -> Column:
        letters = F.split(F.coalesce(F.try_element_at(options, c), c), "")
        return F.flatten(F.transform(words, lambda w: F.transform(letters, lambda b: F.concat(w, b))))

    return F.aggregate(F.split(word, ""), F.array(F.lit("")), grow)


# --------------------------------------------------------------- predicates


def covers(seq: Column, start: Column, end: Column, most: float = 0.2) -> Column:
    """Whether at most a share ``most`` of the columns from ``start`` (from 0) up to
    but not including ``end`` are gaps; an empty span is covered."""
    part = F.substring(seq, (start + 1).cast("int"), (end - start).cast("int"))
    return F.length(part) - F.length(F.replace(part, F.lit("-"), F.lit(""))) <= most * F.length(part)


def annotation_ok(features: Column, keys: list[str], excludes: list[str]) -> Column:
    """Annotation check over an array of texts: false if one holds an excluded
    part, else whether one holds a key. Blanks and case are ignored."""
    clean = F.transform(F.filter(features, lambda x: x.isNotNull()), lambda x: F.lower(F.replace(x, F.lit(" "), F.lit(""))))

    def holds(word: str) -> Column:
        part = F.lit(word.replace(" ", "").lower())
        return F.exists(clean, lambda x: F.contains(x, part))

    def has(words: list[str]) -> Column:
        return functools.reduce(lambda a, b: a | b, map(holds, words), F.lit(False))

    return ~has(excludes) & has(keys)

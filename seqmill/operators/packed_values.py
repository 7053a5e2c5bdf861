"""Several values packed in one field.

A field such as ``taxonomy`` holds several values in one text, with uneven
delimiters and quoting. Each field kind has a parsing expression grammar: an
ordered list of alternatives, of which the first that matches wins. At the
level of a value the alternatives are *quoted*, *bracketed* and *bare*; a quote
that is not closed before a delimiter makes the parser go back and read the
value as bare text, with the error flag ``open_quote``. At the level of a list
they are *one delimiter throughout* for each delimiter in turn, and *mixed
delimiters* as the last resort. Terminals use atomic groups, so matching is
linear and has the semantics of a PEG.

Defined results: null, blank and ``unknown`` texts have no values; empty pieces
neither count nor take a position; a lone delimiter gives nothing; repeated
values are kept, each with its position; other columns of the input are
ignored. Texts of any length are parsed whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import spread

OK, OPEN_QUOTE, OPEN_BRACKET = 0, 1, 2
ERRORS = {OK: None, OPEN_QUOTE: "open_quote", OPEN_BRACKET: "open_bracket"}

#: What may follow a delimiter sign that belongs to the value itself.
_TAIL = r"[;,]\s+aggr\.|(?<=\)),\s*\d{4}\b|(?<=\b[A-Z])/(?=[A-Z]\b)"
_LINEAGE_SIGNS = "\t|>;,/\n"
_UNESCAPE = re.compile(r"\\(.)", re.S)


def _item(signs: str, tail: str = _TAIL) -> re.Pattern:
    """value <- ws (double-quoted / single-quoted / bare) ws (delimiter / end)"""
    s = re.escape(signs)
    end = rf"(?=[^\S\t\n]*+(?:[{s}]|\Z))"
    return re.compile(
        rf"""[^\S\t\n]*+(?:"(?P<d>(?>(?:[^"\\]|""|\\.)*))"{end}"""
        rf"""|'(?P<s>(?>(?:[^'\\]|''|\\.)*))'{end}"""
        rf"""|(?P<b>(?>(?:\\.|{tail}|\([^()]*+\)|\[[^\[\]]*+\]|\{{[^{{}}]*+\}}|[^{s}\\]|\\\Z)*)))"""
        rf"""[^\S\t\n]*(?:[{s}]|\Z)""",
        re.S,
    )


def _bare(text: str) -> tuple[str, int]:
    text = text.strip()
    flag = OPEN_QUOTE if text[:1] in "\"'" and text else OK
    if not flag and any(text.count(a) != text.count(b) for a, b in ("()", "[]", "{}")):
        flag = OPEN_BRACKET
    return (_UNESCAPE.sub(r"\1", text) if "\\" in text else text), flag


def _value(m: re.Match) -> tuple[str, int]:
    kind = m.lastgroup
    if kind == "b":
        return _bare(m.group("b"))
    quote, text = ('"', m.group("d")) if kind == "d" else ("'", m.group("s"))
    text = text.replace(quote * 2, quote)
    return (_UNESCAPE.sub(r"\1", text) if "\\" in text else text).strip(), OK


def _scan(pattern: re.Pattern, text: str) -> list[tuple[str, int]]:
    out, pos, n = [], 0, len(text)
    match = pattern.match
    while pos < n:
        m = match(text, pos)
        if m.end() == pos:
            break
        pos = m.end()
        v = _value(m)
        if v[0]:
            out.append(v)
    return out


_QUOTING = re.compile(r"""["'\\()\[\]{}]|(?<=\b[A-Z])/(?=[A-Z]\b)|;\s+aggr""")
_SIGNS = re.compile(rf"[{re.escape(_LINEAGE_SIGNS)}]")
_ONE = {sign: _item(sign) for sign in _LINEAGE_SIGNS}
_MIXED = _item(_LINEAGE_SIGNS)
_ITEM_RAW = {
    sign: re.compile(
        rf"""(?>(?:\\.|{_TAIL}|[;,]\s+[a-z]+\.(?=\s*(?:{re.escape(sign)}|\Z))|\([^()]*+\)|\[[^\[\]]*+\]|[^{re.escape(_LINEAGE_SIGNS)}\\]|\\\Z)*+)\Z""",
        re.S,
    )
    for sign in _LINEAGE_SIGNS
}


def _uniform(sign: str, text: str) -> list[tuple[str, int]] | None:
    """list <- value (sign value)*; fails on a bare value with another
    delimiter outside of brackets, escapes and known tails."""
    out, pos, n = [], 0, len(text)
    match, proper = _ONE[sign].match, _ITEM_RAW[sign].match
    while pos < n:
        m = match(text, pos)
        if m.end() == pos:
            break
        pos = m.end()
        if m.lastgroup == "b" and not proper(m.group("b")):
            return None
        v = _value(m)
        if v[0]:
            out.append(v)
    return out


def lineage(text: str) -> list[tuple[str, int]]:
    """Names of a lineage path."""
    text = text.strip(" \r\n\v\f")
    if not _QUOTING.search(text) and len(signs := set(_SIGNS.findall(text))) == 1:
        # one delimiter and nothing that could hold it: the grammar is a split
        return [(v, OK) for v in map(str.strip, text.split(signs.pop())) if v]
    for sign in _LINEAGE_SIGNS:
        if sign in text and (got := _uniform(sign, text)) is not None and (len(got) > 1 or not got):
            return got
    return _scan(_MIXED, text)


# A delimiter between cross references is followed by a database name, a quote,
# another delimiter or the end; elsewhere it belongs to the value.
_XREF_NEXT = r"""(?=\s*+(?:["']|[|;,\n\t]|\Z|[A-Za-z][\w.\-]*:))"""
_XREF_SEP = rf"(?:[|\n\t]|[;,]{_XREF_NEXT}|\ {_XREF_NEXT})"
_XREF = re.compile(
    rf"""\s*+(?:"(?P<d>(?>(?:[^"\\]|""|\\.)*))"(?=\s*+(?:[|;,\n\t]|\Z)|\s)"""
    rf"""|'(?P<s>(?>(?:[^'\\]|''|\\.)*))'(?=\s*+(?:[|;,\n\t]|\Z)|\s)"""
    rf"""|(?P<b>(?>(?:\\.|(?!{_XREF_SEP})[^\\]|\\\Z)*)))(?:{_XREF_SEP}|\Z)?""",
    re.S,
)


def cross_references(text: str) -> list[tuple[str, int]]:
    """``database:id`` values, also where only blanks stand between them."""
    return _scan(_XREF, text.strip())


_PARTICLE = r"(?:(?!and\b|und\b|et\b|y\b|e\b)[a-z]{1,5}\.?\ +)*"
_WORD = r"(?:[A-Z]['’])?[^\W\d_a-z][\w'’]*"
_NAME = rf"{_PARTICLE}{_WORD}(?:-{_WORD})*"
_INITIALS = r"[A-Z]\.(?:\ ?-?[A-Z]\.)*"
_SUFFIX = r"(?:,?\ +(?:(?:Jr|Sr)\b\.?|(?:III|II|IV)\b))?"
_STOP = r"(?=\ *+(?:[;|,\n\t&]|\Z)|\s+(?:and|und|et|y)\b|\s+\")"
_PERSON = re.compile(
    rf"""(?:"(?P<d>(?>(?:[^"\\]|""|\\.)*))"{_STOP}"""
    rf"""|(?P<p>{_NAME}\ *,\ *{_INITIALS}{_SUFFIX}{_STOP}"""
    rf"""|{_INITIALS}\ *{_NAME}{_SUFFIX}{_STOP}"""
    rf"""|{_NAME}\ +[A-Z]{{1,4}}\b{_SUFFIX}{_STOP})"""
    rf"""|(?P<b>(?>(?:\\.|\([^()]*+\)|(?!\s+(?:and|und|et|&)\s)[^;|,\n\t\\])+)))""",
    re.S,
)
_LINK = re.compile(r"(?:\s|[;|,&]|(?:and|und|et|y)\b)*+")


def persons(text: str) -> list[tuple[str, int]]:
    """person <- quoted / surname, initials / initials surname / surname
    INITIALS / bare; link words between persons belong to none."""
    out, n = [], len(text)
    skip, match = _LINK.match, _PERSON.match
    pos = skip(text, 0).end()
    while pos < n:
        m = match(text, pos)
        if m is None:  # a lone backslash or the like
            pos = skip(text, pos + 1).end()
            continue
        if m.lastgroup == "d":
            v = m.group("d").replace('""', '"'), OK
            v = (_UNESCAPE.sub(r"\1", v[0]).strip(), OK)
        elif m.lastgroup == "p":
            v = m.group("p").strip(), OK
        else:
            v = _bare(m.group("b"))
        if v[0]:
            out.append(v)
        pos = skip(text, max(m.end(), pos + 1)).end()
    return out


GRAMMARS: dict[str, Callable[[str], list[tuple[str, int]]]] = {
    "taxonomy": lineage,
    "db_xref": cross_references,
    "authors": persons,
}

_SCHEMA = "values array<string>, flags array<tinyint>"
#: Parsed texts are remembered up to this many per task; more start anew.
_MEMO = 20_000


def split_packed(
    df: DataFrame,
    id_col: str = "info_id",
    fields: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per value: ``id_col``, ``field``, ``pos`` (from 1), ``value``, ``error``.

    ``fields`` maps column names to grammar names (default: the three packed
    fields, each with its own grammar). Narrow: one Arrow pass over the
    projected columns and an explode in the JVM, no shuffle (but for a small input of few splits).
    """
    fields = dict(fields or {k: k for k in GRAMMARS})
    if id_col in ("field", "pos", "value", "error"):
        raise ValueError(f"the id column may not be called {id_col}")
    names = list(fields)
    grammars = [GRAMMARS[fields[f]] for f in names]
    src = df.select(F.col(id_col).alias("_id"), *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(names)])
    id_type = src.schema["_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for i, grammar in enumerate(grammars):
                rows, values, flags = [], [], []
                for row, text in enumerate(batch.column(i + 1).to_pylist()):
                    if not text:
                        continue
                    got = memo.get((i, text))
                    if got is None:
                        bare = text.strip()
                        got = grammar(text) if bare and bare.lower() != "unknown" else []
                        got = ([v for v, _ in got], [e for _, e in got])
                        if len(memo) >= _MEMO:
                            memo.clear()
                        memo[i, text] = got
                    if got[0]:
                        rows.append(row)
                        values.append(got[0])
                        flags.append(got[1])
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(rows, pa.int32())),
                            pa.array([i] * len(rows), pa.int32()),
                            pa.array(values, pa.list_(pa.string())),
                            pa.array(flags, pa.list_(pa.int8())),
                        ],
                        names=["_id", "f", "values", "flags"],
                    )

    parsed = spread(src).mapInArrow(parse, f"_id {id_type}, f int, {_SCHEMA}")
    labels = F.array(*[F.lit(f) for f in names])
    return (
        parsed.select("_id", "f", "flags", F.posexplode("values").alias("p", "value"))
        .select(
            F.col("_id").alias(id_col),
            labels[F.col("f")].alias("field"),
            (F.col("p") + 1).cast("long").alias("pos"),
            "value",
            F.when(F.get("flags", F.col("p")) == OPEN_QUOTE, "open_quote")
            .when(F.get("flags", F.col("p")) == OPEN_BRACKET, "open_bracket")
            .alias("error"),
        )
    )

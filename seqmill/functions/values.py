"""Which texts stand for no value, and accessions however written."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that stand for no value, in small letters with single blanks.
PLACEHOLDER = (
    r"^(?:[\s?.*/_–—\-]*|n/?a|n\.a\.?|nan|nil|null|none|unknown|missing(?:\s*[:;,].*)?|unspecified|undetermined|no voucher|no data"
    r"|not (?:applicable|available|collected|recorded|provided|known|determined|given|stated|specified|reported|assigned)(?:\s*[:;,].*)?)$"
)
# Journals that only say that a record is not published.
UNPUBLISHED = (
    r"^(?:(?:un|not |not yet |never )published(?:\s*\(\d{4}\))?(?:\s*[:;,.].*)?|published only in\s+(?:an? |the )?(?:online |public )?databases?\b[\s.;]*.*|in (?:preparation|prep\.?))$"
)


def usable(value: Column, journal: bool = False) -> Column:
    """True for a text that is neither null, blank nor a placeholder; of a
    ``journal`` also none that only says it is not published."""
    text = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    ok = ~text.rlike(PLACEHOLDER)
    return F.coalesce(ok & ~text.rlike(UNPUBLISHED) if journal else ok, F.lit(False))


def usable_sql(value: str, journal: bool = False) -> str:
    """The same as SQL."""
    text = rf"lower(trim(regexp_replace({value}, '\s+', ' ', 'g')))"
    ok = f"NOT regexp_matches({text}, '{PLACEHOLDER}')"
    if journal:
        ok += f" AND NOT regexp_matches({text}, '{UNPUBLISHED}')"
    return f"coalesce({ok}, false)"


def accession_key(acc: Column) -> Column:
    """Accession without version, however written: blanks, case, ``gb|...|``;
    null where there is none."""
    bare = F.regexp_extract(F.upper(acc), r"([^|\s]+)[|\s]*$", 1)
    key = F.regexp_replace(bare, r"\.\d+$", "")
    return F.when(key != "", key)


def accession_key_sql(acc: str) -> str:
    """The same as SQL."""
    return rf"nullif(regexp_replace(regexp_extract(upper({acc}), '([^|\s]+)[|\s]*$', 1), '\.\d+$', ''), '')"

"""Row rules used in curation: keyword tests, labels, lookups, defaults.

Keyword lists and lookup maps are arguments; none is built in. Column arguments
are names of columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a column as naming an organism.
TAXON_WORDS = ("organism", "species", "taxon")


def any_pattern(patterns: Iterable[str]) -> str:
    """One case-insensitive regular expression out of many."""
    return "(?iu)" + "|".join(f"(?:{p})" for p in patterns)


def keyword_match(
    columns: Sequence[str],
    keywords: Sequence[str],
    id_columns: Sequence[str] = ("DMS_id", "UniProt_ID"),
    id_patterns: Sequence[str] = (),
) -> Column:
    """True where any keyword occurs in an id column or in a taxon column.

    Keywords are regular expressions and are searched without regard to case.
    `id_patterns` are searched in the id columns only. Null ids never match; a
    null in a taxon column is read as the text `nan`.
    """
    tests = []
    in_ids = [*id_patterns, *keywords]
    if in_ids:
        tests += [
            F.coalesce(F.col(c).rlike(any_pattern(in_ids)), F.lit(False))
            for c in id_columns if c in columns
        ]
    if keywords:
        tests += [
            F.coalesce(F.col(c).cast("string"), F.lit("nan")).rlike(any_pattern(keywords))
            for c in columns if any(w in c.lower() for w in TAXON_WORDS)
        ]
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def contains_any(text: str, words: Sequence[str]) -> Column:
    """True where any of the words occurs literally in the lower-cased text."""
    if not words:
        return F.lit(False)
    pattern = "|".join(re.escape(w) for w in words)
    return F.coalesce(F.lower(text).rlike(pattern), F.lit(False))


def held_out(group: str, names: Sequence[str]) -> Column:
    """True where the group contains one of the names, without regard to case."""
    return contains_any(group, [n.lower() for n in names])


def has_score(score: str) -> Column:
    """True for a score that is neither null nor NaN."""
    return F.col(score).isNotNull() & ~F.isnan(score)


def threshold_label(z: str, low: float = 1.0, high: float = 1.0) -> Column:
    """0 below `-low`, 2 above `high`, else 1; the cuts themselves, null and NaN give 1."""
    return F.expr(f"CASE WHEN isnan({z}) THEN 1 WHEN {z} < {-low!r}D THEN 0 WHEN {z} > {high!r}D THEN 2 ELSE 1 END")


def is_changed_pair(ref: str, var: str) -> Column:
    """True where the variant is not empty and differs from the reference."""
    return (F.length(var) > 0) & (F.col(var) != F.col(ref))


def not_empty(*texts: str) -> Column:
    """True where every text holds something; null does not."""
    return F.expr(" AND ".join(f"length({t}) > 0" for t in texts))


def _map(names: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))


def first_known_token(text: str, names: Mapping[str, str], separator: str = "_") -> Column:
    """Name of the first token found in the map, upper-cased first; `''` if none is."""
    if not names:
        return F.lit("")
    tokens = F.split(F.upper(text), re.escape(separator))
    hit = F.get(F.filter(tokens, lambda t: t.isin(*names)), 0)
    return F.coalesce(F.try_element_at(_map(names), hit), F.lit(""))


def code_label(code: str, labels: Mapping[str, str], default: str) -> Column:
    """Label of a code, or the default for a code the map does not hold."""
    if not labels:
        return F.lit(default)
    return F.coalesce(F.try_element_at(_map(labels), F.col(code)), F.lit(default))


def score_or_zero(columns: Sequence[str], score: str) -> Column:
    """The score, 0.0 for null or NaN and where the column is missing."""
    if score not in columns:
        return F.lit(0.0)
    return F.expr(f"coalesce(nanvl(CAST({score} AS double), 0D), 0D)")

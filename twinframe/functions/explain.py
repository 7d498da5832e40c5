"""Column expressions that explain a prediction through its edit events.

Arguments are SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import EXTENSION, MISSENSE, NONSENSE, READTHROUGH, TRUNCATION

# Impact of each kind of edit, strongest impact first.
IMPACTS = ("high", "moderate", "low", "unknown")
HIGH_SCORE, OTHER_SCORE = 1.0, 0.5
TOP_POSITIONS, TOP_IN_SUMMARY = 10, 3
NO_EDITS = "No mutations detected — wildtype sequence."


def impact_sql(kind: str) -> str:
    return (
        f"CASE WHEN {kind} IN ('{NONSENSE}', '{TRUNCATION}') THEN 'high'"
        f" WHEN {kind} IN ('{MISSENSE}', '{READTHROUGH}') THEN 'moderate'"
        f" WHEN {kind} = '{EXTENSION}' THEN 'low' ELSE 'unknown' END"
    )


def impact(kind: str) -> Column:
    """Impact class of a kind of edit."""
    return F.expr(impact_sql(kind))


def annotate_edits(edits: str) -> Column:
    """Edit events with their impact class."""
    return F.expr(
        f"transform({edits}, e -> named_struct('position', e.position, 'ref', e.ref, 'var', e.var,"
        f" 'type', e.type, 'impact', {impact_sql('e.type')}))"
    )


def top_edits(annotated: str, n: int = TOP_POSITIONS) -> Column:
    """The `n` strongest edits; equal impact keeps the order of the input."""
    levels = ", ".join(f"filter({annotated}, e -> e.impact = '{level}')" for level in IMPACTS)
    return F.expr(f"slice(concat({levels}), 1, {n})")


def position_scores(ref: str, var: str, annotated: str, given: str | None = None) -> Column:
    """One score per position of the longer text, at least one.

    Given scores are cut or padded with zeros to that length. Without them an
    edit scores by its impact and every other position is zero.
    """
    n = f"greatest(length({ref}), length({var}), 1)"

    def zeros(count: str) -> str:
        return f"array_repeat(0D, CAST(greatest({count}, 0) AS int))"

    # Events come in order of position, one at most for each, so the scores are
    # runs of zeros with one value after every run.
    gap = zeros(f"edit__.position - coalesce(get({annotated}, at__ - 1).position, 0) - 1")
    own = f"array(if(edit__.impact = 'high', {HIGH_SCORE}D, {OTHER_SCORE}D))"
    last = f"coalesce(try_element_at({annotated}, -1).position, 0)"
    ruled = f"concat(flatten(transform({annotated}, (edit__, at__) -> concat({gap}, {own}))), {zeros(f'{n} - {last}')})"
    if given is None:
        return F.expr(ruled)
    scores = f"CAST({given} AS array<double>)"
    fitted = f"slice(concat({scores}, {zeros(f'{n} - size({scores})')}), 1, {n})"
    return F.expr(f"CASE WHEN {given} IS NOT NULL THEN {fitted} ELSE {ruled} END")


def _percent_sql(share: str, digits: int) -> str:
    return f"format_string('%.{digits}f%%', bround(CAST({share} AS double) * 100, {digits}))"


def summary(name: str, prediction: str, confidence: str, ref: str, var: str, annotated: str) -> Column:
    """One line of text that names the call, its strongest edits and the rest."""
    head = f"concat({name}, ': ', {prediction}, ' (confidence=', {_percent_sql(confidence, 2)}, ')')"
    lost = _percent_sql(f"1 - length({var}) / greatest(length({ref}), 1)", 0)
    lines = (
        f"transform(slice(filter({annotated}, e -> e.impact = 'high'), 1, {TOP_IN_SUMMARY}), edit__ ->"
        f" CASE WHEN edit__.type = '{NONSENSE}'"
        f" THEN concat('Premature stop at position ', edit__.position, ' (', edit__.ref, '→*)')"
        f" ELSE concat('Truncation: ', {lost}, ' of protein lost') END)"
    )
    moderate = f"size(filter({annotated}, e -> e.impact = 'moderate'))"
    rest = f"CASE WHEN {moderate} > 0 THEN concat({moderate}, ' missense mutation(s)') END"
    return F.expr(
        f"CASE WHEN size({annotated}) = 0 THEN concat_ws(' | ', {head}, '{NO_EDITS}')"
        f" ELSE concat_ws(' | ', {head}, {lines}, {rest}) END"
    )

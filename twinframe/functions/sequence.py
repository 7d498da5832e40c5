"""Column expressions on strings and on pairs of strings.

Everything here is a native Spark expression: nothing crosses into Python at
run time, so the functions work in batch, in SQL projections and on streams.
Only `translated` is plain Python, for texts that are in a Python task anyway.

Arguments are SQL text, mostly the name of a column; where one is used inside a
lambda, the lambda's own names end in two underscores to stay apart. Each expression is written
as one piece of SQL, which Spark parses in one step; built up call by call, the
nested array lambdas would take seconds of driver time. The `*_sql` functions
give the text itself, to be put together with others.

Positions in edit events are 1-based; positions taken by the editing functions
(`substitute_char`, `insert_text`, `delete_span`) are 0-based.
"""

from __future__ import annotations

from functools import cache
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

EDIT_TYPE = "array<struct<position:int,ref:string,var:string,type:string>>"

# Kinds of edit event, and the two marker characters.
MISSENSE, NONSENSE, READTHROUGH = "missense", "nonsense", "readthrough"
TRUNCATION, EXTENSION = "truncation", "extension"
STOP, GAP = "*", "-"

# The order of the four bases in the public codon tables, the 64
# products of table 11 in that order, and what each ambiguity letter stands for.
BASES = "TCAG"
CODON_PRODUCTS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
AMBIGUITY = {
    "A": "A", "B": "CGT", "C": "C", "D": "AGT", "G": "G", "H": "ACT", "K": "GT", "M": "AC",
    "N": "ACGT", "R": "AG", "S": "CG", "T": "T", "V": "ACG", "W": "AT", "Y": "CT",
}
AMBIGUOUS_PRODUCTS = {"DN": "B", "EQ": "Z", "IL": "J"}
UNKNOWN_PRODUCT = "X"

# Texts are compared in blocks of this many characters, and only blocks that
# differ are opened up character by character.
BLOCK = 32


def find_edits_sql(ref: str, var: str) -> str:
    r, v = f"coalesce({ref}, '')", f"coalesce({var}, '')"
    blocks = f"R'(?s).{{1,{BLOCK}}}'"
    # The fields of a zipped array are named by their place.
    zipped = (
        f"arrays_zip(regexp_extract_all({r}, {blocks}, 0), regexp_extract_all({v}, {blocks}, 0),"
        f" sequence(0, greatest(length({r}), length({v})), {BLOCK}))"
    )
    # Where one text has ended the comparison is null, which drops the place.
    opened = (
        f"filter(arrays_zip(split(b.`0`, ''), split(b.`1`, ''), sequence(b.`2` + 1, b.`2` + {BLOCK})),"
        f" p -> p.`0` <> p.`1`)"
    )
    inner = (
        f"transform(flatten(transform(filter({zipped}, b -> b.`0` <> b.`1`), b -> {opened})),"
        f" p -> named_struct('position', p.`2`, 'ref', p.`0`, 'var', p.`1`, 'type',"
        f" CASE WHEN p.`1` = '{STOP}' THEN '{NONSENSE}' WHEN p.`0` = '{STOP}' THEN '{READTHROUGH}'"
        f" ELSE '{MISSENSE}' END))"
    )
    none = f"CAST(array() AS {EDIT_TYPE})"
    tail = (
        f"CASE WHEN length({v}) < length({r}) THEN array(named_struct('position', length({v}) + 1,"
        f" 'ref', substr({r}, length({v}) + 1, 1), 'var', '{GAP}', 'type', '{TRUNCATION}'))"
        f" WHEN length({v}) > length({r}) THEN array(named_struct('position', length({r}) + 1,"
        f" 'ref', '{GAP}', 'var', substr({v}, length({r}) + 1, 1), 'type', '{EXTENSION}'))"
        f" ELSE {none} END"
    )
    return f"CASE WHEN {r} = {v} THEN {none} ELSE concat(CAST({inner} AS {EDIT_TYPE}), {tail}) END"


def find_edits(ref: str, var: str) -> Column:
    """Typed edit events between two strings compared position by position.

    One event per differing position, then at most one event for the tail: a
    truncation where the variant is shorter, an extension where it is longer.
    Null counts as the empty string.
    """
    return F.expr(find_edits_sql(ref, var))


def premature_stop_sql(ref: str, var: str) -> str:
    return (
        f"(instr({var}, '{STOP}') > 0 AND (instr({ref}, '{STOP}') = 0"
        f" OR instr({var}, '{STOP}') < instr({ref}, '{STOP}')))"
    )


def has_premature_stop(ref: str, var: str) -> Column:
    """True where the variant has a stop before the first one of the reference."""
    return F.expr(premature_stop_sql(ref, var))


def effective_length_sql(text: str) -> str:
    return f"if(instr({text}, '{STOP}') > 0, instr({text}, '{STOP}') - 1, length({text}))"


def effective_length(text: str) -> Column:
    """Length up to the first stop, or the whole length without one."""
    return F.expr(effective_length_sql(text))


def truncation_fraction_sql(ref: str, var: str) -> str:
    n_ref, n_var = effective_length_sql(ref), effective_length_sql(var)
    return f"CASE WHEN {n_var} < {n_ref} THEN ({n_ref} - {n_var}) / {n_ref} ELSE 0D END"


def truncation_fraction(ref: str, var: str) -> Column:
    """Share of the reference lost in the variant, counted up to the first stop."""
    return F.expr(truncation_fraction_sql(ref, var))


def sequence_identity_sql(ref: str, var: str, edits: str | None = None) -> str:
    r, v = f"coalesce({ref}, '')", f"coalesce({var}, '')"
    events = find_edits_sql(ref, var) if edits is None else edits
    differing = f"size(filter({events}, e -> e.type NOT IN ('{TRUNCATION}', '{EXTENSION}')))"
    return (
        f"CASE WHEN greatest(length({r}), length({v})) = 0 THEN 1D"
        f" ELSE (least(length({r}), length({v})) - {differing}) / greatest(length({r}), length({v})) END"
    )


def sequence_identity(ref: str, var: str, edits: str | None = None) -> Column:
    """Matching positions over the longer length; two empty strings are identical.

    Pass `edits` where they are at hand, so that the texts are compared once.
    """
    return F.expr(sequence_identity_sql(ref, var, edits))


def region_sql(position: str, length: str) -> str:
    return (
        f"CASE WHEN {length} = 0 THEN 'none' WHEN {position} / {length} <= 0.2D THEN 'N-terminal'"
        f" WHEN {position} / {length} >= 0.8D THEN 'C-terminal' ELSE 'middle' END"
    )


def region(position: str, length: str) -> Column:
    """Which part of a text a 1-based position falls in: first or last fifth, or between."""
    return F.expr(region_sql(position, length))


def strip_blanks_sql(text: str) -> str:
    return rf"regexp_replace({text}, R'^\s+|\s+$', '')"


def strip_blanks(text: str) -> Column:
    """Drop white space of every kind at both ends (`trim` drops blanks only)."""
    return F.expr(strip_blanks_sql(text))


def apply_edit_codes_sql(ref: str, codes: str) -> str:
    # The integer may carry a sign and blanks around it, which a cast reads, and
    # single underscores between digits, which it does not.
    middle = "substr(c, 2, length(c) - 2)"
    number = (
        f"CASE WHEN NOT contains({middle}, '_') THEN try_cast({middle} AS int)"
        rf" WHEN {middle} RLIKE R'^\s*[+-]?\d+(_\d+)*\s*$'"
        f" THEN try_cast(replace({middle}, '_', '') AS int) END"
    )
    # A separator of one plain character is split at without a regular expression.
    parts = (
        f"transform(split(replace(coalesce({codes}, ''), ';', ':'), ':'), c -> btrim(c, ' \\t\\n\\r\\u000B\\u000C'))")
    parsed = (
        f"transform(filter({parts}, c -> length(c) >= 3), c -> named_struct("
        f"'old', left(c, 1), 'new', right(c, 1), 'at', {number}))"
    )
    return (
        f"aggregate(filter({parsed}, code__ -> code__.at BETWEEN 1 AND length({ref})), {ref}, (t, e) ->"
        f" if(substr(t, e.at, 1) = e.old, overlay(t PLACING e.new FROM e.at FOR 1), t))"
    )


def apply_edit_codes(ref: str, codes: str) -> Column:
    """Apply edit codes such as `A23T:G45R` one after the other.

    A code is left out where it is shorter than three characters, its middle is
    no integer, its position lies outside the text, or its first character is
    not what the text, as edited so far, holds there. `;` separates as `:` does.
    """
    return F.expr(apply_edit_codes_sql(ref, codes))


def build_variant(ref: str, codes: str, given: str | None = None) -> Column:
    """The variant text: the given one where there is one, else the edited reference."""
    edited = apply_edit_codes_sql(ref, codes)
    return F.expr(edited if given is None else f"coalesce({given}, {edited})")


def _product_of(codon: str) -> str:
    plain = ("".join(p) for p in product(*(AMBIGUITY[base] for base in codon)))
    index = ((BASES.index(a), BASES.index(b), BASES.index(c)) for a, b, c in plain)
    products = "".join(sorted({CODON_PRODUCTS[16 * a + 4 * b + c] for a, b, c in index}))
    return products if len(products) == 1 else AMBIGUOUS_PRODUCTS.get(products, UNKNOWN_PRODUCT)


def translate_sql(dna: str, to_stop: bool = False) -> str:
    # Letters of one byte each are upper-cased by the same lookup, which `upper` takes far longer for.
    known = "".join(AMBIGUITY) + "U"
    plain = f"translate({dna}, '{known.lower()}U', '{known[:-1]}TT')"
    once = f"if(octet_length({dna}) = length({dna}), {plain}, translate(upper({dna}), 'U', 'T'))"
    text = "text__"
    letters = "".join(AMBIGUITY)

    def products(alphabet: str, table: str) -> str:
        n = len(alphabet)
        a, b, c = (f"instr('{alphabet}', substr(c, {i}, 1))" for i in (1, 2, 3))
        codons = f"regexp_extract_all({text}, '(?s).{{3}}', 0)"
        place = f"({a} - 1) * {n * n} + ({b} - 1) * {n} + {c}"
        return f"array_join(transform({codons}, c -> substr('{table}', {place}, 1)), '')"

    # The large table only serves texts that do hold ambiguity letters.
    small = products(BASES, CODON_PRODUCTS)
    large = products(letters, "".join(_product_of("".join(c)) for c in product(letters, repeat=3)))
    complete = f"left({text}, length({text}) - length({text}) % 3)"
    protein = (
        rf"CASE WHEN {complete} RLIKE R'\A[{BASES}]*\z' THEN {small}"
        rf" WHEN {complete} RLIKE R'\A[{letters}]*\z' THEN {large}"
        rf" WHEN {text} IS NOT NULL THEN '' END"
    )
    ended = f"substring_index({protein}, '{STOP}', 1)" if to_stop else protein
    # A lambda names the text, so that it is worked out once.
    return f"transform(array({once}), text__ -> {ended})[0]"


def translate(dna: str, to_stop: bool = False) -> Column:
    """Translate codons to one-letter products, `*` for a stop.

    Upper-cases, reads U as T and drops an incomplete last codon. Ambiguity
    letters are resolved where every reading gives the same product. A letter
    outside the alphabet makes the result empty. Null stays null.
    """
    return F.expr(translate_sql(dna, to_stop))


@cache
def _codons() -> dict[str, str]:
    return {"".join(c): _product_of("".join(c)) for c in product(AMBIGUITY, repeat=3)}


def translated(dna: str | None, to_stop: bool = False) -> str | None:
    """What `translate` gives, for one text."""
    if dna is None:
        return None
    text = dna.upper().replace("U", "T")
    try:
        protein = "".join(map(_codons().__getitem__, map("".join, zip(*[iter(text)] * 3))))
    except KeyError:
        return ""
    return protein.partition(STOP)[0] if to_stop else protein


def is_nucleotide_sql(text: str, first: int = 100) -> str:
    return rf"(left({text}, {first}) RLIKE R'\A[ATGCN]*\z')"


def is_nucleotide(text: str, first: int = 100) -> Column:
    """True where the first characters are all of `ATGCN`; true for the empty string."""
    return F.expr(is_nucleotide_sql(text, first))


def _checked_sql(ok: str, value: str, position: str, text: str, strict: bool) -> str:
    if not strict:
        return f"CASE WHEN {ok} THEN {value} END"
    # A null position or text gives null; only a real position can be out of range.
    return (
        f"CASE WHEN {ok} THEN {value} WHEN NOT ({ok}) THEN CAST(raise_error(format_string("
        f"'No position %d in a text of %d characters', CAST({position} AS bigint),"
        f" length({text}))) AS string) END"
    )


def substitute_char_sql(text: str, position: str, new: str, strict: bool = True) -> str:
    at = f"CAST({position} AS int)"
    edited = f"concat(left({text}, {at}), upper({new}), substr({text}, {at} + 2))"
    ok = f"{position} >= 0 AND {position} < length({text})"
    return _checked_sql(ok, edited, position, text, strict)


def insert_text_sql(text: str, position: str, new: str, strict: bool = True) -> str:
    at = f"CAST({position} AS int)"
    edited = f"concat(left({text}, {at}), upper({new}), substr({text}, {at} + 1))"
    ok = f"{position} >= 0 AND {position} <= length({text})"
    return _checked_sql(ok, edited, position, text, strict)


def delete_span_sql(text: str, start: str, length: str, strict: bool = True) -> str:
    at = f"CAST({start} AS int)"
    edited = f"concat(left({text}, {at}), substr({text}, {at} + CAST({length} AS int) + 1))"
    ok = f"{start} >= 0 AND {start} < length({text})"
    return _checked_sql(ok, edited, start, text, strict)


def substitute_char(text: str, position: str, new: str, strict: bool = True) -> Column:
    """Replace the character at a 0-based position by `new`, upper-cased.

    Out of range raises an error, or gives null with `strict=False`.
    """
    return F.expr(substitute_char_sql(text, position, new, strict))


def insert_text(text: str, position: str, new: str, strict: bool = True) -> Column:
    """Insert `new`, upper-cased, before a 0-based position; the end is allowed."""
    return F.expr(insert_text_sql(text, position, new, strict))


def delete_span(text: str, start: str, length: str, strict: bool = True) -> Column:
    """Delete `length` characters from a 0-based position, at most to the end."""
    return F.expr(delete_span_sql(text, start, length, strict))


def content_key(text: str, digits: int = 16) -> Column:
    """Hex digits of the SHA-256 of a text.

    16 digits are the compact form for reports and file names. Joins on many
    texts should take all 64, which cannot collide in practice.
    """
    return F.expr(f"left(sha2({text}, 256), {digits})" if digits < 64 else f"sha2({text}, 256)")


def clip_sql(text: str, max_length: int = 1024) -> str:
    return f"left(coalesce({text}, ''), {max_length})"


def clip(text: str, max_length: int = 1024) -> Column:
    """The first `max_length` characters; null counts as the empty string."""
    return F.expr(clip_sql(text, max_length))


def drop_stops_sql(text: str) -> str:
    return f"replace({text}, '{STOP}', '')"


def drop_stops(text: str) -> Column:
    """Remove stop markers, as the last step before encoding and never before features."""
    return F.expr(drop_stops_sql(text))

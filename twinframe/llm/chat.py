"""Chat formatting with DataFrame functions only.

Records come in many layouts. The nested field paths that a record fills are
hashed to a fingerprint, and the fingerprint selects a declarative mapping to
canonical turns `(key, n, role, text)`. A template renders the turns of a
conversation to one text; control strings inside roles and texts are escaped so
that they can be told from the template's own and be restored. A loss mask holds
the places of the assistant's text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, STOP = "<|im_start|>", "<|im_end|>"
# Strings that chat templates give a meaning; none may come from a text.
CONTROL = r"<(?=\|(?:im_start|im_end|endoftext)\|>|/?s>|</?SYS>>)|\[(?=/?INST\])"
ASSISTANT = "assistant"
# What other layouts call the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A known layout: the field paths that it fills, and where its turns stand.

    turns: (role, field) in order, for layouts with a field per turn; a role that
    starts with '$' names the field that holds it. messages: (array, role, text)
    for layouts with an array of turns. rows: (order, role, text) for tables with
    a row per turn.
    """

    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None


_KNOWN = (
    Layout(("turn", "role", "text"), rows=("turn", "role", "text")),
    Layout(("messages[].role", "messages[].content"), messages=("messages", "role", "content")),
    Layout(("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value")),
    Layout(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout(("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Layout(("question", "answer"), (("user", "question"), ("assistant", "answer"))),
    Layout(("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout(("instruction", "input", "output"),
           (("user", "instruction+input"), ("assistant", "output"))),
)
# Layouts with a field per turn may have a system text before the first.
LAYOUTS = _KNOWN + tuple(
    Layout(("system", *known.paths), (("system", "system"), *known.turns)) for known in _KNOWN if known.turns)


def fingerprint(paths) -> str:
    """The hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves of a type, arrays marked by []."""
    if isinstance(kind, StructType):
        dot = prefix + "." if prefix else ""
        return [p for f in kind.fields for p in field_paths(f.dataType, dot + f.name)]
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def row_fingerprint(records: DataFrame) -> Column:
    """Per row the hash of those known paths that the schema has and the row fills."""
    known = {p for layout in LAYOUTS if not layout.rows for p in layout.paths}
    there = sorted(known & set(field_paths(records.schema)))
    filled = [
        F.when(F.col(f"`{p.split('[')[0].split('.')[0]}`").isNotNull(), F.lit(p)) for p in there]
    return F.sha2(F.concat_ws("\n", *filled).cast("binary"), 256)


def _turn(role: Column, text: Column) -> Column:
    named = F.coalesce(role.cast("string"), F.lit(""))
    plain = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.struct(
        F.coalesce(plain[named], named).alias("role"),
        F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _messages(layout: Layout) -> Column:
    """The turns of a record as an array of (role, text)."""
    if layout.messages:
        array, role, text = layout.messages
        return F.transform(F.col(array), lambda m: _turn(m[role], m[text]))

    def field(names: str) -> Column:
        filled = [F.when(F.col(n) != "", F.col(n)) for n in names.split("+")]
        return filled[0] if len(filled) == 1 else F.concat_ws("\n\n", *filled)

    return F.array(*[_turn(F.lit(role), field(name)) for role, name in layout.turns])


def canonical_turns(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """`(key, n, role, text)`: the turns of records in any known layout, n from 1.

    The fingerprint of the schema tells a table with a row per turn; otherwise
    each row's fingerprint selects its mapping, and for a row without a known
    fingerprint the mapping of which it fills most fields, then that with fewest
    missing. Null texts and roles read as empty. Fields of other layouts that the
    row fills too follow as turns, fields of one text as turns of the role
    `unknown`. Columns of no known layout are ignored. Turns with equal
    numbers are ordered by role and text; repeated rows stay repeated turns. A
    record without any text or turn gives one turn of the role `unknown` and no
    text, so that none is lost; an empty table gives no turns.
    """
    names = set(field_paths(records.schema))
    for layout in LAYOUTS:
        if layout.rows and fingerprint(names & set(layout.paths)) == fingerprint(layout.paths):
            order, role, text = layout.rows
            role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
            rows = records.select(
                F.col(key).alias("key"), F.col(order).alias("o"), role_.alias("role"), text_.alias("text"))
            return rows.select(
                "key", F.row_number().over(Window.partitionBy("key").orderBy("o", "role", "text")).alias("n"),
                "role", "text")
    kind = "array<struct<role:string,text:string>>"
    known = [layout for layout in LAYOUTS if not layout.rows and set(layout.paths) <= names]
    plain = sorted({p for layout in LAYOUTS if not layout.rows for p in layout.paths if "[" not in p} & names)

    def rest(used: Layout | None) -> list[Column]:
        """Turns of what a row fills beside a layout."""
        fields = [p for p in plain if used is None or p not in used.paths]
        turns = [F.when(F.col(f"`{p}`") != "", F.array(_turn(F.lit("unknown"), F.col(f"`{p}`")))) for p in fields]
        turns += [_messages(layout) for layout in known if layout.messages and layout is not used]
        return [F.coalesce(t.cast(kind), F.array().cast(kind)) for t in turns]

    def filled(layout: Layout) -> Column:
        """Fields of a layout that a row fills, then few missing ones, as one number."""
        there = [F.col(f"`{p.split('[')[0]}`").isNotNull().cast("int") for p in layout.paths]
        count = sum(there[1:], there[0])
        return F.when(count > 0, 100 * count - len(layout.paths)).otherwise(0)

    chosen = F.concat(F.array().cast(kind), *rest(None))
    best = F.greatest(F.lit(0), F.lit(0), *map(filled, known))
    for layout in reversed(known):
        made = F.concat(F.coalesce(_messages(layout).cast(kind), F.array().cast(kind)), *rest(layout))
        chosen = F.when((best > 0) & (filled(layout) == best), made).otherwise(chosen)
    for layout in known:
        chosen = F.when(F.col("_fingerprint") == fingerprint(layout.paths), _messages(layout).cast(kind)).otherwise(chosen)
    none = F.array(F.struct(F.lit("unknown").alias("role"), F.lit("").alias("text")))
    chosen = F.when(F.size(chosen) > 0, chosen).otherwise(none.cast(kind))
    marked = records.withColumn("_fingerprint", row_fingerprint(records))
    each = marked.select(F.col(key).alias("key"), F.posexplode(chosen).alias("n", "turn"))
    return each.select("key", (F.col("n") + 1).alias("n"), "turn.role", "turn.text")


def escaped(text: Column) -> Column:
    """Backslashes doubled, and one put into every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def restored(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """`(key, formatted, loss)`: one text per conversation, and the places of the assistant's texts in it.

    `loss` is an array of (start, length) in code points. Places are running sums
    over a conversation's turns. A conversation is one row of the result, so
    one task holds its text, as long as that is.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    pieces = turns.select(
        "key", "n", (F.col("role") == ASSISTANT).alias("own"), head.alias("head"), escaped(F.col("text")).alias("body"))
    tail = STOP + "\n"
    order = Window.partitionBy("key").orderBy("n")
    width = F.length("head") + F.length("body") + len(tail)
    placed = pieces.withColumn("stop", F.sum(width).over(order))
    turn = F.struct(
        "n", F.concat("head", "body", F.lit(tail)).alias("piece"), "own",
        (F.col("stop") - F.length("body") - len(tail)).alias("start"), F.length("body").alias("width"))
    whole = placed.groupBy("key").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    loss = F.transform(F.filter("t", lambda t: t["own"]), lambda t: F.struct(t["start"], t["width"]))
    return whole.select("key", F.array_join("t.piece", "").alias("formatted"), loss.alias("loss"))


def read_back(formatted_: Column) -> Column:
    """Array of (role, text), parsed from a formatted text alone."""
    pieces = F.split(formatted_, r"<\|im_end\|>\n", -1)
    bodies = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, len(START) + 1, F.length(p)))
    head = r"(?s)^((?:[^\\\n]|\\.)*+)\n"

    def turn(body: Column) -> Column:
        role = F.regexp_extract(body, head, 1)
        return F.struct(
            restored(role).alias("role"),
            restored(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(bodies, turn)


def under_mask(formatted_: Column, loss: Column) -> Column:
    """All text under the loss mask, restored, without anything between."""
    return F.array_join(F.transform(
        loss, lambda s: restored(F.substring(
            formatted_, (s["start"] + 1).cast("int"), s["width"].cast("int")))), "")

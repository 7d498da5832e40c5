"""Language identification by compression.

Every language has a raw-content zstandard dictionary of labelled text. A text
belongs to the language whose dictionary compresses it to the fewest bytes. The
text is compressed in pieces, so that a long text is measured against the
dictionary all along and not against its own beginning.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


UNKNOWN = "und"
# Parts of a label's documents that a sample is chosen from one by one.
SLICES = 64
# Characters that are compressed at once; shorter pieces take more search to tell apart.
PIECE = 1000
SHORT = 200
LEVEL = 6
SHORT_LEVEL = 12
# Words of a fragment: long enough for common turns, too short for whole repeated passages.
FRAGMENT_WORDS = 8
_NO_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Fit:
    """How a model is fitted: the bounds on its labelled sample, and the narrow margin.

    docs: labelled documents per language at most, those with the smallest hash
    of their id; min_chars, max_chars: documents of this length are preferred,
    others fill what these leave of the bounds, and longer ones are cut to
    max_chars; dictionary_bytes: text in a dictionary; languages: more than so
    many labels are an error, because each needs a dictionary in every task;
    margin: share of bytes by which the best language must beat the second;
    judged_chars: letters and spaces from which a narrow margin means anything.
    """

    docs: int = 1000
    min_chars: int = 200
    max_chars: int = 20_000
    dictionary_bytes: int = 200_000
    languages: int = 500
    margin: float = 0.002
    judged_chars: int = 40


@dataclass
class Model:
    dictionaries: dict[str, bytes] = field(default_factory=dict)
    docs: dict[str, int] = field(default_factory=dict)  # documents of each label that were not held out
    margin: float = Fit.margin
    judged_chars: int = Fit.judged_chars


def letters(text: str) -> str:
    """Lower-case words of letters only, one space between."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


def held_out(key: Column) -> Column:
    """crc32 of the key as text, modulo 4, is 2; such documents are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, bounds: Fit = Fit(), key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> Model:
    """A dictionary for every label of documents that are not held out.

    The sample is bounded by `bounds` whatever the input's size: ids are chosen
    first, by a limit per label that Spark applies before it shuffles; of their
    texts at most `dictionary_bytes` a label, and one fragment more, reach the
    driver. Documents in the length range come first;
    shorter ones, and pieces of longer ones, fill the dictionary of a label that
    has too few, so that every label with a document with a letter is learned.
    How many documents of any length have a learned label is counted over all of
    them.
    """
    learnable = docs.select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(
        F.col("l").isNotNull() & F.col("k").isNotNull() & ~held_out(F.col("k")))
    labelled = learnable.filter(F.col("t").rlike(r"\p{L}")).withColumn(
        "o", ~F.length("t").between(bounds.min_chars, bounds.max_chars))
    # Labels are counted before anything else, so all that follows has a bound.
    if learnable.select("l").distinct().limit(bounds.languages + 1).count() > bounds.languages:
        raise ValueError(f"Over {bounds.languages} languages, which is the bound")
    chosen = labelled.select("l", "k", F.xxhash64("t").alias("h"), "o")
    # By slices of a label first, so that what meets in one task is bounded too.
    for parts in (["l", F.pmod(F.xxhash64("h"), F.lit(SLICES))], ["l"]):
        first = Window.partitionBy(*parts).orderBy("o", F.xxhash64("k"), "k", "h")
        chosen = chosen.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= bounds.docs).drop("n")
    chosen = chosen.drop("o").distinct()
    sample = labelled.withColumn("h", F.xxhash64("t")).join(
        F.broadcast(chosen), ["l", "k", "h"], "left_semi").dropDuplicates(["l", "k", "h"])
    # A piece of a long text starts at its first letter or, by its hash, further on.
    room = F.length("t") - bounds.max_chars
    letter = F.regexp_instr("t", F.lit(r"\p{L}"))
    start = F.greatest(letter, F.when(room > 0, F.pmod("h", room + 1) + 1).otherwise(1))
    piece = F.col("t").substr(start.cast("int"), F.lit(bounds.max_chars))
    piece = F.when(piece.rlike(r"\p{L}"), piece).otherwise(F.col("t").substr(letter, F.lit(bounds.max_chars)))
    cut = F.when(room > 0, piece).otherwise(F.col("t")).alias("t")
    texts: dict[str, list[str]] = {}
    for row in _fragments(sample.select("l", "o", cut), bounds.dictionary_bytes).orderBy("l", "before").collect():
        texts.setdefault(row.l, []).append(row.f)
    counts = learnable.filter(F.col("l").isin(list(texts))).groupBy("l").agg(F.count("*").alias("n"))
    return Model({
        name: "\n".join(own).encode()[:bounds.dictionary_bytes] for name, own in texts.items()
    }, {r.l: r.n for r in counts.collect()}, bounds.margin, bounds.judged_chars)


def _fragments(sample: DataFrame, size: int) -> DataFrame:
    """`(l, f, before)`: of each label's distinct short fragments those that begin within `size` bytes.

    They come in the order of a hash, those of preferred texts first. A passage
    of another language that many documents repeat counts once. Texts are cut up
    where they lie; only the fragments of the dictionaries reach the driver.
    """
    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = letters(text).split()
                found = {" ".join(words[j:j + FRAGMENT_WORDS]) for j in range(0, len(words), FRAGMENT_WORDS)}
                rows = pa.array([i] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(list(found), pa.string())],
                    ["l", "o", "f"])

    kind = sample.schema["l"].dataType.simpleString()
    found = sample.mapInArrow(run, f"l {kind}, o boolean, f string").groupBy("l", "f").agg(F.min("o").alias("o"))
    order = Window.partitionBy("l").orderBy("o", F.crc32(F.col("f").cast("binary")), "f")
    before = F.coalesce(
        F.sum(F.octet_length("f") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", before).filter(F.col("before") < size).select("l", "f", "before")


class Classifier:
    """Sizes of texts under every dictionary of a model."""

    def __init__(self, model: Model):
        # The first of equal sizes wins, so more frequent languages come first.
        self.names = sorted(model.dictionaries, key=lambda name: (-model.docs.get(name, 0), name))
        self.margin, self.judged_chars = model.margin, model.judged_chars
        self.long, self.short = (
            [self._compress(model.dictionaries[name], level) for name in self.names]
            for level in (LEVEL, SHORT_LEVEL))

    @staticmethod
    def _compress(dictionary: bytes, level: int):
        content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        return zstandard.ZstdCompressor(
            dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin between 0 and 1, and whether the margin is too narrow.

        The margin is the share of bytes that the best dictionary saves against
        the second. Of equal sizes the language with more labelled documents
        wins, of equally many the first name. A few words compress to
        about the same size whatever the language: their margin tells nothing
        and they are not rejected for it. Without a letter, or without any
        dictionary, the language is `und`, the margin 0, rejected.
        """
        plain = letters(text) if text else ""
        if not self.names or not any(map(str.isalpha, plain)):
            return UNKNOWN, 0.0, True
        pieces = [plain[i:i + PIECE].encode() for i in range(0, len(plain), PIECE)]
        last = [pieces.pop()] if len(plain) % PIECE in range(1, SHORT) else []
        sizes = [
            sum(map(len, map(long, pieces))) + sum(map(len, map(short, last)))
            for long, short in zip(self.long, self.short)]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sizes[:best] + sizes[best + 1:]
        margin = 1.0 if not others else (min(others) - sizes[best]) / min(others)
        return self.names[best], margin, margin < self.margin and len(plain) >= self.judged_chars


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score` and `rejected`, one row per row.

    Columns of these names are replaced. Whole texts are read; null, empty and
    letterless ones are `und` with score 0, rejected. Repeated rows, ties and
    empty tables need no special care, as rows are judged one by one.
    """
    own = ("lang_pred", "score", "rejected")
    kept = docs.drop(*own)
    at = kept.columns.index(text)

    def run(batches):
        judge = Classifier(model)
        for batch in batches:
            found = [judge.classify(t.as_py()) for t in batch.column(at)]
            names, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rejected, pa.bool_())], [*batch.schema.names, *own])

    schema = StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double").add(
        "rejected", "boolean")
    return kept.mapInArrow(run, schema)

"""Substring dedup by hashing lines, paragraphs, or the parts of lines between punctuation marks.

A text falls into units. Units are normalised, their digests grouped over all documents, the earliest
ranked occurrence stays and the others are removed, with the place each had in the original text.

``repeated_units`` takes each unit by itself. ``repeated_passages`` takes parts of lines, so that a
copy with a changed word loses only that part, and of these removes runs: neighbouring units that
earlier documents have, together long enough to be a passage and not a common phrase.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, staged, strings, with_columns

LINE, PARAGRAPH = "\n", "\n\n"
# A run of this length is a passage. Planted passages of over 50 words lose parts at both ends, where a
# unit takes in words around them; of the runs that documents share by chance few are as long.
PASSAGE_WORDS = 40
# Eight characters count as a word at least, for scripts without spaces and for long strings.
WORD_CHARS = 8
# A unit ends behind these marks and at the end of a line.
MARKS = ".!?,;:。！？，；：、"
# A digest of this share of all units is dealt to several tasks, so that none gets more than the share.
SHARE = 0.005
_UNIT = re.compile(f"[^{MARKS}\n]*[{MARKS}\n]+|[^{MARKS}\n]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def normalised(unit: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(unit), r"\s+", " "))


def units(docs: DataFrame, doc_id: str, text: str, separator: str) -> DataFrame:
    """One row per unit: ``doc_id``, ``copy`` (of the text), ``unit`` number, ``part``, ``digest``, ``n_words``."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("copy"), F.split("text", separator).alias("parts"))
    rows = whole.select("doc_id", "copy", F.posexplode("parts").alias("unit", "part"))
    plain = normalised(F.col("part"))
    return rows.select(
        "doc_id", "copy", "unit", F.char_length("part").cast("long").alias("n_chars"), plain.alias("plain")
    ).select("doc_id", "copy", "unit", "n_chars", F.md5("plain").alias("digest"),
             F.when(F.col("plain") == "", 0).otherwise(F.size(F.split("plain", " "))).alias("n_words"))


def _repeated(docs: DataFrame, doc_id: str, text: str, separator: str, min_words: int) -> DataFrame:
    """``repeated_units`` with ``copy``, which tells the texts of one id apart."""
    rows = units(docs, doc_id, text, separator)
    place = Window.partitionBy("doc_id", "copy").orderBy("unit")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    # Equal rows are one document.
    rows = rows.dropDuplicates(["doc_id", "copy", "unit"]).withColumn(
        "start", F.coalesce(F.sum(F.col("n_chars") + len(separator)).over(before), F.lit(0)))
    rows = rows.filter(F.col("n_words") >= max(min_words, 1))
    rank = F.struct(F.col("doc_id"), F.col("copy"), F.col("unit"))
    first = rows.groupBy("digest").agg(F.min(rank).alias("keep"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(first, "digest").filter(~rank.eqNullSafe(F.col("keep"))).select(
        "doc_id", "copy", "unit", "start", "n_chars", "digest",
        F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.unit").alias("keep_unit"))


def repeated_units(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = LINE, min_words: int = 1,
) -> DataFrame:
    """One row per removed unit: its place in the original text, and the occurrence that stays.

    ``start`` and ``n_chars`` count code points; ``unit``, ``keep_unit`` number the units of a
    text from 0. Occurrences rank by id (null first), then by place. Blank units always stay; so
    do, if the caller asks for a minimum, units of under ``min_words`` words. Words are parted by
    spaces, so a text in a script without them is one word at any length. Null texts have no units, empty
    ones a blank unit. Rows of one id and one text are one document; of one id and other texts,
    each for itself. An empty table gives no rows. Other columns are not read.

    Digests are 128-bit. Groups are counted before they shuffle, and a digest that a third of
    the rows share only meets its one kept row, so that its rows can be split among tasks.
    """
    return _repeated(docs, doc_id, text, separator, min_words).drop("copy")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = LINE, min_words: int = 1) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated units taken out of the texts."""
    gone = _repeated(docs, doc_id, text, separator, min_words)
    # The unit numbers of one text are as bounded as the text.
    gone = gone.groupBy(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).agg(F.collect_set("unit").alias("__gone"))
    parts = F.split(text, separator)
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone")), lambda k: F.get(parts, k))
    joined = docs.join(gone, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__copy")), "left")
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, separator))
    return joined.withColumn(text, new).select(*docs.columns)


def parts(text: str) -> Iterator[tuple[int, int, int, bytes]]:
    """Start, length, words and digest of the units of a text that are not blank; A-Z count as a-z, white space as a space."""
    for found in _UNIT.finditer(text):
        part = found[0]
        words = part.encode("utf-8", "replace").translate(_LOWER).split()
        if words:
            yield found.start(), len(part), max(len(words), len(part) // WORD_CHARS), hashlib.md5(b" ".join(words)).digest()


_PARTS = pa.schema([
    ("doc_id", pa.int64()), ("copy", pa.int64()), ("unit", pa.int32()), ("start", pa.int64()), ("n_chars", pa.int32()),
    ("n_words", pa.int32()), ("digest", pa.binary())])
_PARTS_SQL = "doc_id long, copy long, unit int, start long, n_chars int, n_words int, digest binary"


def _parted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row per unit of ``parts``; ``copy`` tells the texts of one id apart."""
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text", 1 << 20):
                columns = [[] for _ in _PARTS]
                for name, copy, body in zip(cut.column("doc_id").to_pylist(), cut.column("copy").to_pylist(), strings(cut.column("text"))):
                    for unit, found in enumerate(parts(body)):
                        for column, value in zip(columns, (name, copy, unit, *found)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS)

    return whole.mapInArrow(run, _PARTS_SQL)


def _passages(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """``repeated_passages`` with ``copy``."""
    units_ = _parted(docs, doc_id, text)
    # Counted in each task before the shuffle: a row per digest and task, however many documents share it.
    seen = units_.groupBy("digest").agg(
        F.min(F.struct("doc_id", "copy", "unit")).alias("keep"), F.max(F.struct("doc_id", "copy")).alias("last"), F.count("*").alias("n"))
    many = seen.filter("NOT (keep.doc_id <=> last.doc_id AND keep.copy = last.copy)").select("digest", "keep", "n")
    many = staged(many, "passages-digests")
    total = many.agg(F.sum("n")).first()[0] or 0
    # At most 1 / SHARE digests hold such a share each.
    heavy = {bytes(r.digest): int(r.n / (SHARE * total)) + 1 for r in many.filter(F.col("n") > SHARE * total).select("digest", "n").collect()}
    salts = F.lit(1)
    for digest, count in heavy.items():
        salts = F.when(F.col("digest") == F.lit(digest), F.lit(count)).otherwise(salts)
    left = units_.withColumn("salt", F.pmod(F.xxhash64("doc_id", "copy", "unit"), salts).cast("int"))
    right = many.select("digest", "keep", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    again = left.join(right, ["digest", "salt"]).filter("NOT (doc_id <=> keep.doc_id AND copy = keep.copy)")
    # The units of one text are as bounded as the text; equal rows are one document.
    own = again.repartition("doc_id", "copy").dropDuplicates(["doc_id", "copy", "unit"])
    order = Window.partitionBy("doc_id", "copy").orderBy("unit")
    own = own.withColumn("island", F.col("unit") - F.row_number().over(order))
    run = Window.partitionBy("doc_id", "copy", "island")
    own = own.withColumn("run_words", F.sum("n_words").over(run)).withColumn("run", F.min("unit").over(run))
    return own.filter(F.col("run_words") >= words).select(
        "doc_id", "copy", "unit", "start", "n_chars", F.hex("digest").alias("digest"), F.col("keep.doc_id").alias("keep_doc_id"),
        F.col("keep.unit").alias("keep_unit"), "run", "run_words")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per removed unit of a repeated passage: its place in the original text, and the occurrence that stays.

    All units that are not blank are grouped, whatever their length. A unit is repeated if a document
    of a lower id has it (null ranks first), whose occurrences all stay; a text's neighbouring repeated
    units are a run, ``run`` the number of its first unit, and runs of ``words`` words or more are
    removed. Blank units do not part a run. What a text repeats of itself alone stays. ``start`` and
    ``n_chars`` count code points; ``unit`` and ``keep_unit`` number the units of a text that are not
    blank. Null and empty texts have no units. Rows of one id and one text are one document; of one
    id and other texts, each for itself. An empty table gives no rows. Other columns are not read.
    """
    return _passages(docs, doc_id, text, words).drop("copy")


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, size in sorted(spans):
        kept.append(text[at:start])
        at = start + size
    return "".join([*kept, text[at:]])


def passage_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated passages taken out of the texts."""
    gone = _passages(docs, doc_id, text, words).groupBy(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).agg(
        F.collect_list(F.struct("start", "n_chars")).alias("__gone"))
    joined = docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__copy")), "left")
    joined, names = joined.select(*docs.columns, "__gone"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, text):
                spans = [[(s["start"], s["n_chars"]) for s in g or []] for g in cut.column("__gone").to_pylist()]
                column = cut.column(text)
                new = [None if t is None else _without(t, s) for t, s in zip(column.to_pylist(), spans)]
                yield with_columns(cut, **{text: pa.array(new, column.type)}).select(names)

    return joined.mapInArrow(run, docs.schema)


# All lines that are not blank, each by itself.
ALL_UNITS = """
WITH parts AS (
  SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
units AS (
  SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS unit FROM parts),
plain AS (
  SELECT doc_id, unit, length(part) AS n_chars, trim(regexp_replace(lower(part), '\\s+', ' ', 'g')) AS t,
         coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY unit
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM units),
ranked AS (
  SELECT *, md5(t) AS digest,
         row_number() OVER (PARTITION BY md5(t) ORDER BY doc_id, unit) AS k,
         first_value(doc_id) OVER (PARTITION BY md5(t) ORDER BY doc_id, unit) AS keep_doc_id,
         first_value(unit) OVER (PARTITION BY md5(t) ORDER BY doc_id, unit) AS keep_unit
  FROM plain WHERE t <> '')
SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(start AS BIGINT) AS start, n_chars, digest,
       keep_doc_id, CAST(keep_unit AS INTEGER) AS keep_unit
FROM ranked WHERE k > 1"""

ORACLE = f"""
WITH parts AS (
  SELECT doc_id, regexp_extract_all(text, '[^{MARKS}' || chr(10) || ']*[{MARKS}' || chr(10) || ']+|[^{MARKS}' || chr(10) || ']+') AS p
  FROM documents),
pieces AS (
  SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS piece FROM parts),
plain AS (
  SELECT doc_id, piece, length(part) AS n_chars,
         coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+', ' ', 'g'), ' ') AS t
  FROM pieces),
units AS (
  SELECT *, md5(t) AS digest, row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS unit,
         greatest(len(string_split(t, ' ')), n_chars // {WORD_CHARS}) AS n_words
  FROM plain WHERE t <> ''),
kept AS (
  SELECT digest, min(doc_id) AS keep_doc_id, arg_min(unit, doc_id * 10000000 + unit) AS keep_unit
  FROM units GROUP BY digest),
again AS (
  SELECT u.*, k.keep_doc_id, k.keep_unit, u.unit - row_number() OVER (PARTITION BY u.doc_id ORDER BY u.unit) AS island
  FROM units u JOIN kept k USING (digest) WHERE u.doc_id <> k.keep_doc_id),
runs AS (
  SELECT *, sum(n_words) OVER w AS run_words, min(unit) OVER w AS run FROM again WINDOW w AS (PARTITION BY doc_id, island))
SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(start AS BIGINT) AS start, CAST(n_chars AS INTEGER) AS n_chars, upper(digest) AS digest,
       keep_doc_id, CAST(keep_unit AS INTEGER) AS keep_unit, CAST(run AS INTEGER) AS run, CAST(run_words AS BIGINT) AS run_words
FROM runs WHERE run_words >= {PASSAGE_WORDS}"""

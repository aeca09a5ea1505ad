"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

Each line has a hash. A rolling hash over a line and the one before it (the earlier hash moved
one bit to the left, xor the later) decides where chunks end: after a line whose rolling hash
is lower than that of both its neighbours. That depends on four lines and no more, so an
insertion moves no boundary further away, and two boundaries are never adjacent: chunks have at
least two lines, save the last of a text. Chunks of several lines that occur again anywhere are
removed but for their first occurrence, after their bytes are compared.

What moves: hashes of chunks; then the documents once, to meet the numbers of the chunks
whose hash repeats; then only those chunks' bytes, grouped where they are before they shuffle.

Boundaries depend on the lines around a passage, so chunks alone miss or cut short many of them.
``repeated_passages`` looks at every two neighbouring lines, and every long line, wherever chunks
end: those that occur before, by their bytes, are merged into runs. What moves is as for chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged

# A passage has more words than this, or more characters: not all scripts part words by spaces.
WORDS, CHARS = 50, 250
_SPELLED = r"[^ \t\x0b\f\r\n]+"


def _chunked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__lines`` of ``__text`` and ``__ends``: the lines before each chunk's end."""
    return _with_ends(rows.withColumn("__lines", F.split("__text", "\n")).drop("__text"))


def _with_ends(rows: DataFrame) -> DataFrame:
    """Adds ``__ends``. Each step is a projection of its own, so that no array is made twice.

    For the same reason arrays made here are taken apart by ``explode_outer``: a plain explode
    is given a filter on the array's size, into which all these steps would be copied.
    """
    # 60 bits of a line's digest, so that moving them by one bit cannot overflow.
    hashed = rows.withColumn("__hashes", F.transform(
        "__lines", lambda line: F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")))
    rolled = hashed.withColumn("__rolling", F.zip_with(
        "__hashes", F.expr("concat(array(0L), slice(__hashes, 1, size(__hashes) - 1))"),
        lambda line, earlier: F.shiftleft(earlier, 1).bitwiseXOR(line)))
    return rolled.withColumn("__ends", F.expr("""
        filter(sequence(1, size(__rolling)), i -> i = size(__rolling) OR (
          i > 1 AND get(__rolling, i - 1) < get(__rolling, i - 2) AND get(__rolling, i - 1) < get(__rolling, i)))"""))


def _body(k: str) -> str:
    """SQL of chunk ``k`` of a row with ``__lines`` and ``__ends``: its bytes."""
    start = f"coalesce(get(__ends, {k} - 1), 0)"
    return f"array_join(slice(__lines, {start} + 1, get(__ends, {k}) - {start}), '\n')"


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the document, null ids included; the right side's key columns are dropped."""
    key = [F.col(k).eqNullSafe(F.col("r" + k)) for k in ("__id", "__copy")]
    other = right.select(*[F.col(k).alias("r" + k) for k in ("__id", "__copy")],
                         *[c for c in right.columns if c not in ("__id", "__copy")])
    joined = left.join(other, key, how)
    return joined.drop("r__id", "r__copy")


def repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per removed chunk: ``__id``, ``__copy``, ``chunk``, its lines, and the one that stays."""
    whole = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__copy"), F.col(text).alias("__text"))
    whole = whole.filter("__text IS NOT NULL")
    # A chunk of several lines is two or more: all but, perhaps, the last.
    hashes = _chunked(whole).select("__id", "__copy", F.expr(f"""
        transform(filter(sequence(0, size(__ends) - 1), k -> get(__ends, k) - coalesce(get(__ends, k - 1), 0) > 1),
                  k -> struct(k AS chunk, xxhash64({_body("k")}) AS hash))""").alias("c"))
    # Equal rows are one document.
    hashes = hashes.select("__id", "__copy", F.explode_outer("c").alias("c")).filter("c IS NOT NULL").select(
        "__id", "__copy", "c.*").distinct()
    again = hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    candidates = hashes.join(again, "hash", "left_semi")
    of_doc = candidates.groupBy("__id", "__copy").agg(F.collect_list("chunk").alias("mine"))
    bodies = _chunked(_same(whole, of_doc, "inner")).select("__id", "__copy", F.explode_outer(F.expr(f"""
        transform(mine, k -> struct(k AS chunk, coalesce(get(__ends, k - 1), 0) AS first_line,
          get(__ends, k) - coalesce(get(__ends, k - 1), 0) AS n_lines, {_body("k")} AS body))""")).alias("b")
    ).filter("b IS NOT NULL").select("__id", "__copy", "b.*")
    bodies = staged(bodies, "chunk-bodies")
    # Grouped by the bytes themselves; the digest only names a group in the join.
    rank = F.struct("__id", "__copy", "chunk")
    groups = bodies.groupBy("body").agg(F.min(rank).alias("keep"), F.count("*").alias("n")).filter("n > 1")
    groups = groups.select(F.sha2("body", 256).alias("digest"), "keep")
    rows = bodies.select("__id", "__copy", "chunk", "first_line", "n_lines", F.char_length("body").cast("long").alias("n_chars"),
                         F.sha2("body", 256).alias("digest"))
    gone = rows.join(groups, "digest").filter(~rank.eqNullSafe(F.col("keep")))
    return gone.dropDuplicates(["__id", "__copy", "chunk"])


def chunk_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per removed chunk: its document and lines, and the occurrence that stays.

    Occurrences rank by id (null first), then by place. Lines end at ``\\n`` and count from 0.
    Null texts have no lines; empty ones a blank line, which is no chunk of several lines. Rows
    of one id and one text are one document; of one id and other texts, each for itself. An
    empty table gives no rows. Other columns are not read.
    """
    return repeated_chunks(docs, doc_id, text).select(
        F.col("__id").alias("doc_id"), "chunk", "first_line", "n_lines", "n_chars",
        F.col("keep.__id").alias("keep_doc_id"), F.col("keep.chunk").alias("keep_chunk"))


def chunk_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the repeated chunks taken out of the texts.

    Other lines stay as they are, in order; a text of which all is removed is ''.
    """
    # The chunk numbers of one text are as bounded as the text.
    gone = repeated_chunks(docs, doc_id, text).groupBy("__id", "__copy").agg(F.collect_list("chunk").alias("__gone"))
    rows = docs.select(*docs.columns, F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__copy"))
    joined = _same(rows, gone, "left")
    same = joined.filter("__gone IS NULL").select(*docs.columns)
    cut = _with_ends(joined.filter("__gone IS NOT NULL").withColumn("__lines", F.split(text, "\n")))
    cut = cut.withColumn("__kept", F.expr(f"""
        array_join(transform(array_except(sequence(0, size(__ends) - 1), __gone), k -> {_body("k")}), '\n')"""))
    return same.unionByName(cut.select(*[F.col("__kept").alias(c) if c == text else c for c in docs.columns]))


def repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, chars: int = CHARS,
) -> DataFrame:
    """One row per run of lines that occur before: ``__id``, ``__copy``, its lines, and its size.

    A pair of neighbouring lines, or a line of more than ``words`` words or ``chars`` characters,
    is repeated if an earlier place has the same bytes. Repeated ones that share a line make a run;
    runs of more than ``words`` words or ``chars`` characters are passages. The first occurrence of
    a line is in no passage, since a pair with it is the first of its kind too.
    """
    whole = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__copy"), F.col(text).alias("__text"))
    whole = whole.filter("__text IS NOT NULL").withColumn("__lines", F.split("__text", "\n")).drop("__text")
    spelled = F.lit(_SPELLED)
    # Words are counted only where the characters leave room for so many.
    long_line = lambda line: (F.char_length(line) > chars) | (
        (F.char_length(line) > 2 * words) & (F.regexp_count(line, spelled) > words))
    place = F.sequence(F.lit(0), F.size("__lines") - 1)
    pairs = F.transform(F.filter(place, lambda i: i > 0), lambda i: F.struct(
        (i - 1).alias("line"), F.lit(2).alias("n"), F.xxhash64(F.get("__lines", i - 1), F.get("__lines", i)).alias("hash")))
    longs = F.transform(F.filter(place, lambda i: long_line(F.get("__lines", i))), lambda i: F.struct(
        i.alias("line"), F.lit(1).alias("n"), F.xxhash64(F.get("__lines", i)).alias("hash")))
    hashes = whole.select("__id", "__copy", F.explode_outer(F.concat(pairs, longs)).alias("w"))
    hashes = hashes.filter("w IS NOT NULL").select("__id", "__copy", "w.*")
    # Equal rows are one document, but here they only make more candidates.
    again = hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    candidates = hashes.join(again, "hash", "left_semi")
    of_doc = candidates.groupBy("__id", "__copy").agg(F.collect_set(F.struct("line", "n")).alias("mine"))
    bodies = _same(whole, of_doc, "inner").select("__id", "__copy", F.explode_outer(F.expr("""
        transform(mine, w -> struct(w.line AS line, w.n AS n, array_join(slice(__lines, w.line + 1, w.n), '\n') AS body))""")
    ).alias("b")).filter("b IS NOT NULL").select("__id", "__copy", "b.*")
    bodies = staged(bodies, "passage-bodies")
    # Grouped by the bytes themselves, as chunks are; a pair has a line break, a long line none.
    rank = F.struct("__id", "__copy", "line")
    groups = bodies.groupBy("body").agg(F.min(rank).alias("keep"), F.count("*").alias("copies")).filter("copies > 1")
    groups = groups.select(F.sha2("body", 256).alias("digest"), "keep")
    last = F.substring_index("body", "\n", -1)
    rows = bodies.select(
        "__id", "__copy", "line", "n", F.sha2("body", 256).alias("digest"),
        F.regexp_count("body", spelled).cast("long").alias("n_words"), F.char_length("body").cast("long").alias("n_chars"),
        F.regexp_count(last, spelled).cast("long").alias("last_words"), F.char_length(last).cast("long").alias("last_chars"))
    gone = rows.join(groups, "digest").filter(~rank.eqNullSafe(F.col("keep")))
    gone = gone.dropDuplicates(["__id", "__copy", "line", "n"])
    # The rows of one text are as bounded as the text.
    order = Window.partitionBy("__id", "__copy").orderBy("line", F.desc("n"))
    end = F.col("line") + F.col("n")
    gone = gone.withColumn("reach", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    gone = gone.withColumn("starts", F.col("reach").isNull() | (F.col("line") >= F.col("reach")))
    gone = gone.withColumn("run", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    added = lambda all_, more: F.sum(F.when(F.col("starts"), all_).when(end > F.col("reach"), more).otherwise(0))
    runs = gone.groupBy("__id", "__copy", "run").agg(
        F.min("line").alias("first_line"), (F.max(end) - F.min("line")).alias("n_lines"),
        added(F.col("n_words"), F.col("last_words")).alias("n_words"),
        added(F.col("n_chars"), F.col("last_chars") + 1).alias("n_chars"),
        F.min_by("keep", 2 * F.col("line") - F.col("n")).alias("keep"))
    return runs.filter((F.col("n_words") > words) | (F.col("n_chars") > chars)).drop("run")


def passage_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, chars: int = CHARS) -> DataFrame:
    """One row per repeated passage, and where its first two lines (or its long line) occur first.

    Order, lines, null and empty texts and equal rows are as in ``chunk_report``.
    """
    return repeated_passages(docs, doc_id, text, words, chars).select(
        F.col("__id").alias("doc_id"), "first_line", "n_lines", "n_words", "n_chars",
        F.col("keep.__id").alias("keep_doc_id"), F.col("keep.line").alias("keep_line"))


def repeat_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, chars: int = CHARS) -> DataFrame:
    """All rows and columns of ``docs``, repeated chunks and repeated passages taken out of the texts.

    Both are found in the texts as given. The first occurrence of every line stays, and other lines
    stay as they are, in order; a text of which all is removed is ''.
    """
    spans = repeated_chunks(docs, doc_id, text).select("__id", "__copy", "first_line", "n_lines").unionByName(
        repeated_passages(docs, doc_id, text, words, chars).select("__id", "__copy", "first_line", "n_lines"))
    gone = spans.groupBy("__id", "__copy").agg(F.collect_list(F.struct("first_line", "n_lines")).alias("__gone"))
    rows = docs.select(*docs.columns, F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__copy"))
    joined = _same(rows, gone, "left")
    same = joined.filter("__gone IS NULL").select(*docs.columns)
    cut = joined.filter("__gone IS NOT NULL").withColumn("__lines", F.split(text, "\n"))
    cut = cut.withColumn("__kept", F.expr("""
        array_join(transform(array_except(sequence(0, size(__lines) - 1),
          flatten(transform(__gone, s -> sequence(s.first_line, s.first_line + s.n_lines - 1)))), i -> get(__lines, i)), '\n')"""))
    return same.unionByName(cut.select(*[F.col("__kept").alias(c) if c == text else c for c in docs.columns]))


ORACLE = """
WITH parts AS (
  SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
lines AS (
  SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS i, len(p) AS n FROM parts),
hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) AS h FROM lines),
rolled AS (
  SELECT *, xor(h, 2 * coalesce(lag(h) OVER w, 0)) AS r FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ended AS (
  SELECT *, CASE WHEN i = n - 1 OR (r < lag(r) OVER w AND r < lead(r) OVER w) THEN 1 ELSE 0 END AS e
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM ended),
chunks AS (
  SELECT doc_id, chunk, min(i) AS first_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS body
  FROM numbered GROUP BY doc_id, chunk HAVING count(*) > 1),
ranked AS (
  SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_doc_id, first_value(chunk) OVER w AS keep_chunk
  FROM chunks WINDOW w AS (PARTITION BY body ORDER BY doc_id, chunk))
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(first_line AS INTEGER) AS first_line, CAST(n_lines AS INTEGER) AS n_lines,
       length(body) AS n_chars, keep_doc_id, CAST(keep_chunk AS INTEGER) AS keep_chunk
FROM ranked WHERE k > 1"""

PASSAGES = rf"""
WITH parts AS (
  SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
lines AS (
  SELECT doc_id, unnest(p) AS body, unnest(range(len(p))) AS line FROM parts),
windows AS (
  SELECT doc_id, line, 2 AS n, body || chr(10) || after AS body, after AS tail
  FROM (SELECT *, lead(body) OVER (PARTITION BY doc_id ORDER BY line) AS after FROM lines) WHERE after IS NOT NULL
  UNION ALL
  SELECT doc_id, line, 1, body, body FROM lines
  WHERE length(body) > {CHARS} OR len(regexp_extract_all(body, '{_SPELLED}')) > {WORDS}),
ranked AS (
  SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_doc_id, first_value(line) OVER w AS keep_line
  FROM windows WINDOW w AS (PARTITION BY body ORDER BY doc_id, line)),
reached AS (
  SELECT *, max(line + n) OVER (PARTITION BY doc_id ORDER BY line, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM ranked WHERE k > 1),
numbered AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR line >= reach THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY line, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
    CASE WHEN reach IS NULL OR line >= reach THEN body WHEN line + n > reach THEN chr(10) || tail ELSE '' END AS added
  FROM reached),
runs AS (
  SELECT doc_id, min(line) AS first_line, max(line + n) - min(line) AS n_lines, string_agg(added, '' ORDER BY line, n DESC) AS body,
         arg_min(keep_doc_id, 2 * line - n) AS keep_doc_id, arg_min(keep_line, 2 * line - n) AS keep_line
  FROM numbered GROUP BY doc_id, run)
SELECT doc_id, CAST(first_line AS INTEGER) AS first_line, CAST(n_lines AS INTEGER) AS n_lines,
       CAST(len(regexp_extract_all(body, '{_SPELLED}')) AS BIGINT) AS n_words, length(body) AS n_chars,
       keep_doc_id, CAST(keep_line AS INTEGER) AS keep_line
FROM runs WHERE length(body) > {CHARS} OR len(regexp_extract_all(body, '{_SPELLED}')) > {WORDS}"""

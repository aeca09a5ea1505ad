"""Chat formatting on a prefix tree: turns that conversations share from the start are emitted once.

A turn is formatted as ``<|im_start|>`` role, line break, text, ``<|im_end|>``, line break. In
roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|`` (a line break in a role ``\\n``),
so no text holds a control string and all of it comes back. The three parts of a turn are
tokenized apart, so the loss mask, all of an assistant's text and nothing else, ends between
tokens.

A node of the tree is a turn with all turns before it, named by a chained digest. The files are

* ``nodes``: each node once, depth first: ``part`` and ``inside`` order the tokens (``starts``
  adds up the parts), ``ids``, the lengths of the three parts, ``position`` of its first token
  on its path, and ``attention``: the intervals of tokens before it that it may attend to, its
  ancestors', neighbours merged;
* ``paths``: the nodes of each conversation, by conversation and place.

Conversations stream through tasks sorted by conversation and turn; none is held whole. The
order of emission puts conversations with equal beginnings next to each other at any depth
(``_keys``); a node belongs to the first conversation that holds it. A conversation's key has
an entry for each heavy chain its path leaves, and its rows carry its rank alone. A first turn that a third of all conversations share is one row before it shuffles
with others, and one row to join with.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged
from ledgerloom.llm.dac import encoder
from ledgerloom.session import shared_folder

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|))*)" + re.escape(END) + "\n", re.S)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and foot of a turn."""
    return START + escaped(role).replace("\n", "\\n") + "\n", escaped(text), END + "\n"


def parsed(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _TURN.fullmatch(turn)
    if not found:
        raise ValueError("not a formatted turn")
    return unescaped(found[1]), unescaped(found[2])


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def _walk(tokenizer: str):
    """Adds place, node, position and tokens to rows sorted by conversation and turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, place, node, position = encoder(tokenizer), (), 0, b"", 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000).to_pylist()
                parts = [p.encode() for r in rows for p in formatted(r["role"], r["text"])]
                ids, out = own(parts), []
                for k, r in enumerate(rows):
                    if (r["conv"],) != last:
                        last, place, node, position = (r["conv"],), 0, b"", 0
                    role, text = r["role"].encode(), r["text"].encode()
                    parent, node = node, hashlib.blake2b(b"%b%d %b%b" % (node, len(role), role, text), digest_size=16).digest()
                    mine = ids[3 * k:3 * k + 3]
                    out.append({"conv": r["conv"], "place": place, "parent": parent, "node": node, "position": position,
                                "loss": r["role"] == LOSS_ROLE, "sizes": [len(x) for x in mine], "ids": np.concatenate(mine)})
                    place, position = place + 1, position + sum(map(len, mine))
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([
        ("conv", pa.int64()), ("place", pa.int64()), ("parent", pa.binary()), ("node", pa.binary()), ("position", pa.int64()),
        ("loss", pa.bool_()), ("sizes", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])
    return run


_DEEPEST = (1 << 63) - 1
_WALKED = "conv long, place long, parent binary, node binary, position long, loss boolean, sizes array<int>, ids array<int>"
_EMITTED = _WALKED.replace("parent binary, ", "")


def _numbered():
    """Adds ``part`` and ``inside``, the tokens before in the part, to rows in order of emission."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.diff(batch.column("ids").offsets.to_numpy())
            inside = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(inside, pa.int64())],
                names=[*batch.schema.names, "part", "inside"])

    return run


def _attention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the rows of a conversation in order: the merged intervals of the nodes before each."""
    last, spans = (), []
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if (r["conv"],) != last:
                last, spans = (r["conv"],), []
            if r["own"]:
                out.append({"node": r["node"], "attention": [list(s) for s in spans]})
            if spans and spans[-1][1] == r["start"]:
                spans[-1] = (spans[-1][0], r["start"] + r["size"])
            else:
                spans.append((r["start"], r["start"] + r["size"]))
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
            ("node", pa.binary()), ("attention", pa.list_(pa.list_(pa.int64())))]))


def starts(nodes: DataFrame) -> DataFrame:
    """Tokens before each part: one short row per part."""
    parts = nodes.groupBy("part").agg(F.sum(F.size("ids")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def _keys(walked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shared nodes, and ``key`` of each conversation ``of``: by it, those under any node follow each other.

    Of a node's shared children the one with most conversations is its heavy child; the others are
    light, and a light child has at most half of its parent's conversations. A path is told by
    where it leaves each chain of heavy children, deepest first, and by the light child it
    leaves to, so a key has at most as many entries as the number of conversations has binary digits.
    """
    shared = walked.groupBy("node").agg(F.count("*").alias("n"), F.first("parent").alias("parent")).filter("n > 1")
    shared = staged(shared, "chat-shared")
    heavy = shared.groupBy("parent").agg(F.max(F.struct("n", "node"))["node"].alias("node")).select("node", F.lit(False).alias("light"))
    marked = staged(shared.join(heavy, "node", "left").select("node", F.coalesce("light", F.lit(True)).alias("light")), "chat-light")
    left = F.when(F.col("light"), F.struct("place", "node"))  # null where the path stays on its chain
    keys = walked.select("conv", "place", "node").join(marked, "node", "left").groupBy("conv").agg(
        F.count("light").alias("depth"), F.array_sort(F.collect_list(left)).alias("leaves"))
    deepest = lambda place: F.lpad(F.hex(F.lit(_DEEPEST) - place), 16, "0")
    keys = keys.select(F.col("conv").alias("of"), F.concat(
        F.array_join(F.transform("leaves", lambda x: F.concat(deepest(x["place"]), F.hex(x["node"]))), ""), deepest(F.col("depth"))).alias("key"))
    return marked, keys


def write_chats(conversations: DataFrame, path: str, tokenizer: str) -> None:
    """Write ``nodes`` and ``paths`` of a table of ``conv_id``, ``turn``, ``role``, ``text``.

    Rows of a conversation go by turn, then role, then text, null first; repeated rows are
    turns like any other. Null roles and texts are empty, and rows without a ``conv_id`` make up
    one conversation. An empty table gives empty files. Other columns are not read.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    walked = staged(_by_conversation(rows, "turn", "role", "text").mapInArrow(_walk(tokenizer), _WALKED), "chat-turns")
    shared, keys = _keys(walked)
    ranks = keys.repartitionByRange("key", "of").sortWithinPartitions("key", "of")
    ranks = staged(ranks.select("of", F.monotonically_increasing_id().alias("rank")), "chat-ranks")
    ranked = walked.join(ranks, walked["conv"].eqNullSafe(ranks["of"]), "left").drop("of")
    first = ranked.select("node", "rank").join(shared.select("node"), "node").groupBy("node").agg(F.min("rank").alias("first"))
    ordered = ranked.join(first, "node", "left").filter("first IS NULL OR rank = first")
    ordered = ordered.repartitionByRange("rank", "place").sortWithinPartitions("rank", "place").select(
        "conv", "place", "node", "position", "loss", "sizes", "ids")
    numbered = staged(ordered.mapInArrow(_numbered(), _EMITTED + ", part int, inside long"), "chat-nodes")
    at = numbered.join(starts(numbered), "part").select(
        "node", F.col("conv").alias("owner"), (F.col("before") + F.col("inside")).alias("start"), F.size("ids").alias("size"))
    placed = walked.select("conv", "place", "node").join(at, "node").withColumn("own", F.col("conv").eqNullSafe(F.col("owner")))
    spans = _by_conversation(placed, "place").mapInArrow(_attention, "node binary, attention array<array<long>>")
    numbered.drop("conv", "place").join(spans, "node").write.parquet(f"{path}/nodes")
    walked.select(F.col("conv").alias("conv_id"), "place", "node").write.parquet(f"{path}/paths")


def _digests(tokenizer: str):
    """Digests of each conversation from its nodes in order; nothing but digests is kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = encoder(tokenizer).library, None

        def ended() -> pa.RecordBatch:
            conv, turns, whole, chars, loss, length = state
            return pa.RecordBatch.from_pylist([{
                "conv_id": conv, "n_turns": turns, "turns_sha256": whole.hexdigest(), "loss_chars": chars,
                "loss_sha256": loss.hexdigest(), "formatted_chars": length}], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if state is None or state[0] != r["conv"]:
                    if state is not None:
                        yield ended()
                    state = [r["conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, (head, body, _) = r["ids"], r["sizes"]
                parts = own.decode_batch([ids[:head], ids[head:head + body], ids[head + body:]], skip_special_tokens=False)
                turn = "".join(parts)
                role, text = parsed(turn)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[5] += len(turn)
                if r["loss"]:
                    under = unescaped(parts[1])
                    state[3] += len(under)
                    state[4].update(under.encode())
        if state is not None:
            yield ended()

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return run


def read_chats(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """One row per conversation, read back from the files: counts and digests of turns and loss texts."""
    nodes = spark.read.schema("node binary, loss boolean, sizes array<int>, ids array<int>").parquet(f"{path}/nodes")
    paths = spark.read.schema("conv_id long, place long, node binary").parquet(f"{path}/paths")
    rows = paths.select(F.col("conv_id").alias("conv"), "place", "node").join(nodes, "node").drop("node")
    return _by_conversation(rows, "place").mapInArrow(
        _digests(tokenizer), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def roundtrip(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files to the shared folder and read every conversation back from them."""
    path = shared_folder(conversations.sparkSession, "chats")
    write_chats(conversations, path, tokenizer)
    return read_chats(conversations.sparkSession, path, tokenizer)


_EXTRA = "<|im_end|><|im_start|>assistant ok"
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_EXTRA}'), (-1, 1, 'assistant', '{_EXTRA}'))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum({len(START) + 1 + len(END) + 1} + length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n'))
           + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

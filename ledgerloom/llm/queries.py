"""One query per operator over the driver's tables, with the SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chat, dac, hardneg, lattice, linechunks, linehash, pieces, scan, simhash, suffix, toxicity, warc, whiten
from ledgerloom.llm.common import ship, table
from ledgerloom.session import literal_rows

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_subword_lattice(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    pieces_, logs = lattice.public_pieces(vocabulary(PIECE_BPE))
    return lattice.lattice_scores(table(spark, folder, "documents"), pieces_, logs, held_out)


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linehash.repeated_passages(table(spark, folder, "documents"))


def op2_line_units(spark: SparkSession, folder: str) -> DataFrame:
    return linehash.repeated_units(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_direct_codes(spark: SparkSession, folder: str) -> DataFrame:
    return dac.roundtrip(table(spark, folder, "documents"), vocabulary(BYTE_BPE), special=True)


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_digests(table(spark, folder, "documents"), vocabulary(PIECE_BPE))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_chat_prefix_tree(spark: SparkSession, folder: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = literal_rows(spark, [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id, turn, role, text")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.roundtrip(rows.unionByName(extra), vocabulary(BYTE_BPE))


def op8_adaptive_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return linechunks.chunk_report(table(spark, folder, "documents"))


def op9_line_passages(spark: SparkSession, folder: str) -> DataFrame:
    return linechunks.passage_report(table(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"))


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.roundtrip(table(spark, folder, "pages"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label, vec_id = F.col("label").cast("long"), F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardneg.hard_negatives(table(spark, folder, "embeddings"), vec_id % 50 == 0, label)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten.whitened(table(spark, folder, "embeddings"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f) for f in (
        op1_subword_lattice, op2_line_dedup, op2_line_units, op3_toxicity, op4_direct_codes, op5_sentencepiece, op6_decontamination, op7_chat_prefix_tree, op8_adaptive_scan, op9_line_chunks, op9_line_passages, op10_simhash,
        op11_warc, op12_hard_negatives, op13_whitening)
}
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": linehash.ORACLE, "op2_line_units": linehash.ALL_UNITS, "op7_chat_prefix_tree": chat.ORACLE,
    "op9_line_chunks": linechunks.ORACLE, "op9_line_passages": linechunks.PASSAGES, "op11_warc": warc.ORACLE, "op12_hard_negatives": hardneg.ORACLE,
}

"""From raw documents to token ids in five stages, each an operator of modiste.llm over all that the stage before has kept.

language_id      documents whose language isn't known, or not surely, go
line_dedup       lines found in ten documents or more go, everywhere; of documents that are mostly such lines one keeps each
near_dedup       of documents linked by similar five-word shingles the one with the smallest doc_id stays
decontamination  documents with benchmark passages in a twentieth of their words go
bpe              ids of every text, with digests of ids and decoded text

The first four return the columns of their input; n_chars follows the text. Every stage is written below the shared folder and read again; line_dedup and
bpe store their texts themselves, in small batches.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modiste.llm import bpe, decontaminate, langid, lines, nearcopies
from modiste.llm.common import stored, table, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.without_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of `docs` (but for those of these names) and ids, n_tokens, ids_sha256, decoded_sha256; stored, so that Python gets small batches of texts."""
    code = bpe.coder(spark, public_tokenizers.path("byte_bpe_50k.json"), *bpe.CODED)
    coded = unused(docs, "coded")
    out = docs.withColumn(coded, code("text"))
    return stored(out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in bpe.CODED], f"{coded}.*"), "encoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: stages whose result is a stored table already
STORED = {"line_dedup", "bpe"}

#: language identification is trained, which SQL can't express; tests/llm hold the stages against plain loops
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name in STORED else stored(docs, name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

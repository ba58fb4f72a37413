"""The corpus pipeline: five stages over `documents`, each a table of documents but the last, which is of packed pieces.

Defined cases: a row is a document, also where its id is null or repeated. Null and empty texts fail the quality rules and
go; of equal rows and of near copies near-dedup keeps one, that of the least id (rows with a null id all stay); a null
source is a source of its own. Texts are whole in every stage, however long. Columns beyond those of documents are carried
through all stages but the last, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import mixing, near_dups, packing, quality, secret_scan
from graphloom.llm.common import documents, free_name, stored
from graphloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    return quality.reject(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least id."""
    return near_dups.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return secret_scan.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources get equal shares in the mean, in a global random order."""
    return mixing.mix(docs, copy=free_name(docs, "copy"), mix_key=free_name(docs, "mix_key")).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows; the pieces' places in them."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("source_mixing", source_mixing), ("pack", pack)]

#: Tokenizing, and the darts, have no SQL form; a test holds the rows against a plain version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

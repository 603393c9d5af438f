"""The corpus pipeline: documents in, packed training pieces out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and rereads it as the
next stage's docs, so a lost executor costs a stage at most.
1. language_id: documents without a recognisable language go: those without a letter, and those whose shortest code under the trees of all
   languages is far longer than usual (halfway from the 99th percentile of training texts to 8 bits a byte, and 256 bits beyond).
2. near_duplicates: one document of each class of near copies stays, the one with the least id (rows without an id come after all ids).
3. decontamination: documents that the contamination rule holds against go.
4. secret_scan: secrets are cut out of the texts, which stay.
5. packing: what is left is packed into sequences of 2048 tokens, sources in their proportions.

Edge cases, for each stage. Null, empty and letterless texts go at the first stage; the others take them too: near_duplicates keeps one
of each class of equal texts (null and empty texts are a class each), decontamination and secret_scan keep them, packing gives them their end
token. Very long texts are whole in every stage, one in a task's memory at a time. Ties: the least id of a class stays, a language is the
first in string order, sources are served by name. Repeated rows are copies of each other, so one stays; null ids come after all others.
Empty tables give empty tables. Columns beside those of documents go at the first stage, whatever their names; missing benchmark
rows or null ones hold nothing against a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmark.llm import decontaminate, langid, neardup, packing, secrets
from leafmark.llm.common import crc_mod, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, training = docs.select(COLUMNS), crc_mod("doc_id", 5) != 0
    trees = langid.fit(docs.select("doc_id", "text", "lang"), training)
    found = written(langid.predict(docs, trees), "pipeline-languages")
    return found.where(~langid.rejected(langid.usual_cost(found, training))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_copies(docs.select(COLUMNS), null_ids_stay=False, weight="count")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs.select(COLUMNS), length="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).drop("piece_ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: SQL has neither the trees, the signatures nor the tokenizer; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""From raw documents to token ids: the stages that turn a crawl into a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of documents.

Defined results, of all stages: other columns pass through the first four, whatever their names; an empty
table stays empty; a null doc_id is kept like any other id; rows that repeat a doc_id are decided on alike
by the first, third and fourth stage, and by their own text by the second.

``ORACLE_SQL`` is None: language filters, fingerprints and segmentations are beyond SQL. The tests hold
``run`` against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import langid, line_dedup, mixing, pieces, simhash
from tidewatch.session import checkpoint_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; the others go, those with a null text or one without letters among them."""
    return langid.language_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines, n_chars counted anew.

    A text of such lines alone stays whole, as op8 would leave nothing of it: it is one of many copies, for
    the next stage (``line_dedup`` with counts marks such rows as ``spared``). A line on exactly the ratio of
    the source's texts stays; a null source is a source; a null text stays null.
    """
    out = line_dedup.line_dedup(docs, spare_whole=True, counts=False)
    return out.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by op9's contract (3-word shingles, 3 bits), which misses many edited ones: see README.

    The smallest doc_id stays, with all rows that have it; rows with a null id stay. Texts without a word are one group.
    """
    return simhash.simhash_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its target, repeated where the target asks for more than there is.

    Rows with the same doc_id and source are taken together; a text without a word counts nothing, so whether it is taken does not matter to the mix.
    """
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and its best segmentations with their scores. A null or empty text has no ids, and one segmentation."""
    out = pieces.encode(docs.select("doc_id", "source", "lang", "text"), best=True)
    return out.select("doc_id", "source", "lang", "n_tokens", "ids", "score", "nbest_scores", "nbest", "ids_crc32", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    at = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From documents to token ids, in five stages.

Toxic documents go; of each group of near duplicates one document stays; personal data is replaced; sources are mixed to target weights;
the mix is encoded. Each stage works on all that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fenestra.llm import bpe, jaccard_join, mixing, pii, toxicity
from fenestra.llm.common import apart, cut, read


def _own(docs: DataFrame) -> list[str]:
    """The columns that stages use; others are put aside meanwhile, whatever their names."""
    return [c for c in docs.columns if c in ("doc_id", "text", "source", "n_chars")]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a machine fitted to the labelled ones scores below 0.5."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, toxicity.learning_labels(read(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group."""
    return jaccard_join.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return apart(docs, _own(docs), lambda d: pii.redact(pii.detect(d, pii.fit(docs))).select(*d.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each repetition of a document."""
    return apart(docs, _own(docs), lambda d: mixing.materialize(d, mixing.mix(d)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them, for every row of the mix."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Fitted models and seeded hashes decide what stays, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage but the last is written to the shared folder and read again.

    Null and empty texts, null ids and repeated rows pass every stage: they are not toxic without a toxic term, have no near duplicates unless their ids are equal, and a text without words adds none to the
    mix. An empty table gives no rows. Columns other than doc_id, text, source and n_chars are carried along.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

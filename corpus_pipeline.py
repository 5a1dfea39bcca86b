"""Cleaning a corpus: toxicity, language, near-duplicates, mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; `run` writes each stage's rows as Parquet in the
shared folder and reads them again for the next. All but the last return the columns of documents.

In every stage null texts and ids are rows like others, a text counts whole however long, columns of other names come
through (under whatever names), and an empty table gives an empty table; repeated rows and ties are told of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import op06_language, op07_toxicity, op08_mixing, op09_prefix_bpe, op10_setsketch
from graphloom.llm.common import materialize, table, tokenizer_file


def _guarded(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """docs under names that no operator uses, the names, and that of the text."""
    names = [f"_in{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; learns from the labelled ones among those it is given.

    Null and empty texts score like a text that says nothing; repeated rows score alike and go or stay together. Without
    labels of both classes nothing is learned, and all stay unless every label is toxic.
    """
    fitted = op07_toxicity.learn(docs, table(spark, sf_dir, "labels"))
    guarded, names, text = _guarded(docs)
    return op07_toxicity.score(guarded, fitted, names, text).where("predicted = 0").select(*names).toDF(*docs.columns)


#: Bits a character that the phrases of the predicted language may cost. Text in a script that no reference has costs about 16; the
#: dearest clean text of the test tables, one of a few characters, costs 7.9, and clean ones of some length 2 to 3.
MOST_BITS = 10.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no learned language explains: null or letterless texts, and those whose cross-parsing by the
    predicted language costs more than MOST_BITS a character. Clean text in any learned language stays.

    Repeated rows go or stay together. Without labelled texts nothing is known of languages, and texts with a letter stay.
    """
    learned = op06_language.learn(docs)
    if not learned:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    guarded, names, text = _guarded(docs)
    judged = op06_language.predict(guarded, learned, names, text)
    return judged.where((F.col("lang_pred") != op06_language.UND) & (F.col("bits") <= MOST_BITS)).select(*names).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of the smallest id, of each group; rows that repeat a kept doc_id are one document.

    Texts without words and rows without an id are similar to nothing and stay.
    """
    found = op10_setsketch.near_duplicates(docs)
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources meet their target weights.

    A null source is one of its own; of rows that share id and size as many are taken as fit; texts without words have size 0
    and are taken as long as their rank comes before the cut-off.
    """
    names = [f"_in{k}" for k in range(len(docs.columns))]
    own = [F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)]
    sized = op08_mixing.row_tag(docs).select(*own, "doc_id", "source", op08_mixing.size_of(F.col("text")).alias("size"), "_tag")
    plan = op08_mixing.plan_of(materialize(sized.select("doc_id", "source", "size", "_tag"), "mix-sizes"))
    mixed = op08_mixing.copies(sized, plan).where("copies > 0")
    return mixed.select(*names, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(*names).toDF(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mixture; null texts have no ids, repeated rows repeat."""
    import public_tokenizers

    return op09_prefix_bpe.token_digests(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("language", language), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts get the score of the class shares. Null and repeated ids and repeated rows are
    scored row by row. Without labelled documents of both classes nothing is learnt, and all stay. All
    columns stay as they are, also those named like the classifier's results.
    """
    from tidings.llm.toxicity import score, train

    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.learnt:
        return docs
    inside = docs.select(*(docs[f"`{c}`"].alias(c if c in ("doc_id", "text") else f"_of_{c}") for c in docs.columns))
    kept = score(inside, model).filter("predicted = 0")
    return kept.select(*(kept[f"`{c if c in ('doc_id', 'text') else f'_of_{c}'}`"].alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; ``n_chars`` counts what stays, where there is such a column.

    Each row is a document, whatever its id, so repeated rows count their lines each. A null text stays
    null and an empty one empty; documents that lose all lines stay with an empty text. Other columns stay
    as they are, also those named like the operator's results.
    """
    from pyspark.sql import functions as F

    from tidings.llm.linededup import dedup_lines

    names = [c if c == "text" else f"_of_{c}" for c in docs.columns]
    inside = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names)), docs["text"].isNull().alias("_of_no_text"))
    done = dedup_lines(inside, min_docs=10, min_chars=1)
    text = F.when(~F.col("_of_no_text"), F.col("text"))
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*(made.get(c, F.col(f"`{n}`")).alias(c) for c, n in zip(docs.columns, names)))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id.

    Rows of one id are one document and stay or go together; rows without an id, and null or empty texts,
    are linked with nothing and stay. All columns stay as they are.
    """
    from tidings.llm.minhash import near_duplicates
    from tidings.operators.storage import materialize

    gone = materialize(near_duplicates(docs, size=5, percent=80).filter("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go.

    Rows are judged one by one by their whole text, so null and repeated ids do not matter; null and empty
    texts hold nothing and stay. All columns stay as they are.
    """
    from tidings.llm.decontam import drop_leaks

    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the decoded text, for each row.

    A null text counts as empty. Null and repeated ids and repeated rows are encoded row by row, very long texts
    whole; an empty table gives an empty one. Columns but the id and the text are not read.
    """
    import public_tokenizers

    from tidings.llm.bpe import encode

    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash", minhash), ("decontamination", decontamination), ("bpe", bpe)]
#: Stages 1, 3 and 5 (a trained classifier, sketches, a tokenizer) are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.operators.storage import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs

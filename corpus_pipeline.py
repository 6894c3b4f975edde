"""The corpus pipeline: stages that each take documents and return the documents they keep.

Each stage works on all that the one before has kept. STAGES are written as Parquet between them
by whoever runs them one by one; run() writes them to the shared folder itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.llm import bpe, decontaminate, langid, secrets, simhash
from fingerloom.llm.common import keep, remainder, table

#: Languages with a lower score than this are rejected as unknown.
LEAST_SCORE = 0.3
TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters of a language that the classifier knows.

    The classifier learns from the documents' own labels; a document goes if its text is null or
    has no letter (`und`), or if no language reaches LEAST_SCORE. Without any label all stay that
    have a letter.
    """
    model = langid.learned(docs.select("doc_id", "text", "lang"), remainder(F.col("doc_id"), 3) != 1)
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    carried = docs.select("text", *[F.col(c).alias(n) for c, n in names.items()])
    judged = langid.predict_languages(carried, model, *names.values())
    good = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE) if model.languages else F.col(names["text"]).rlike(r"\p{L}")
    return judged.filter(good).select(*[F.col(n).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates (five words, 0.8)."""
    return simhash.first_of_groups(docs, simhash.similar_groups(docs.select("doc_id", "text")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    text = F.coalesce("text", F.lit(""))
    marked = docs.withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(1), text)})
    keys = docs.select(F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).alias("doc"), "text")
    found = decontaminate.contaminations(keys.select(F.col("doc.a").alias("a"), F.col("doc.b").alias("b"), "text").withColumn("doc_id", F.concat_ws(":", "a", "b")), table(spark, sf_dir, "benchmark", "item_id", "text"))
    parts = F.split("doc_id", ":")
    # A written table has a known size: where it is small the documents aren't shuffled.
    gone = keep(found.select(parts[0].cast("long").alias("__a"), parts[1].cast("long").alias("__b")).distinct(), "contaminated")
    return marked.join(gone, ["__a", "__b"], "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by [SECRET] and n_chars counted anew where one was."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    carried = docs.select("text", *[F.col(c).alias(n) for c, n in names.items()])
    scanned = secrets.scan(carried, *names.values(), words=secrets.vocabulary_path())
    hit = F.col("spans") != ""
    made = {c: F.col(n) for c, n in names.items()} | {"text": F.col("redacted")}
    if "n_chars" in names:
        made["n_chars"] = F.when(hit, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"]))
    return scanned.select(*[made[c].alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and the digests of the ids and of the decoded text."""
    import public_tokenizers

    return bpe.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", encoded),
]

#: None of these stages can be expressed in SQL as a whole; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Bounded samples of labelled rows, on which the classifiers are fitted by the driver.

Rows are taken in the order of a hash of their id (ties by id and text), so the sample is the same
at every run. Texts over MAX_CHARS characters are no training rows (they are scored like all others), which together
with the number of rows bounds what comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fingerloom.llm.common import keep

MAX_CHARS = 20_000
#: Training texts of all classes together at most, unless there are more classes; each class has the same share.
MAX_TEXTS = 20_000
#: A table of more classes than these isn't broadcast.
FEW_CLASSES = 10_000
SCALE = 1 << 30


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> list[tuple[bytes, int]]:
    """Up to per_class (text, label) of each label value in 0 and 1; `learn` says which ids may be learned from."""
    short = docs.filter(F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS))
    rows = labels.filter(F.col(label).isin(0, 1) & learn).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    picked = []
    for y in (0, 1):
        picked.append(rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    chosen = picked[0].unionByName(picked[1])  # at most 2 * per_class rows of two numbers
    found = short.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("h"))
    found = found.orderBy("h", "text").limit(4 * per_class).collect()
    return [(r.text.encode(), r.y) for r in found]


def texts_by_class(docs: DataFrame, label: str, learn: Column, per_class: int) -> list[tuple[str, str]]:
    """Up to per_class (text, class) of each non-null value of a column of `docs`, all values included.

    A class's rows are counted first; then only rows whose id's hash is below a bound that lets
    about twice as many of the class through as are wanted are ordered, so that what is shuffled
    doesn't grow with the table. Ties of the hash go by id and then by text.
    """
    rows = docs.filter(F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS) & F.col(label).isNotNull() & learn)
    counts = keep(rows.groupBy(label).agg(F.count("*").alias("rows")), "classes")
    classes = counts.count()
    wanted = max(1, min(per_class, MAX_TEXTS // max(1, classes)))
    share = F.least(F.lit(1.0), F.lit(2.0 * wanted + 30) / F.col("rows"))  # 30: so that none of a few is missed by chance
    bounds = counts.select(label, F.floor(share * SCALE).alias("bound"))
    order = Window.partitionBy(label).orderBy("h", "doc_id", "text")
    hashed = rows.select("doc_id", "text", label, F.xxhash64("doc_id").alias("h"))
    few = hashed.join(F.broadcast(bounds) if classes <= FEW_CLASSES else bounds, label).filter(F.pmod("h", F.lit(SCALE)) < F.col("bound"))
    ranked = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= wanted)
    return [(r.text, r[label]) for r in ranked.select("text", label, "n").orderBy("n", label).collect()]

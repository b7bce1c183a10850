"""Document fingerprints: threshold-scaled sketches. Operator 5, of DataFrame functions alone.

A sketch holds every 40-bit hash of a text's five-word shingles below a fixed share, one quarter (SCALED), of the hash space: the same threshold for all texts, so a long
text has a long sketch and a sketch is complete below it. The share of the smaller sketch that the other has estimates containment, however unequal the texts' lengths. Sketches
merge by union: the union is the sketch of the joined texts. A text of few shingles may have an empty sketch; it is like other empty ones and unlike the rest.

The next document, by descending doc_id, is found without a global order in one task: ids are range-partitioned, each partition orders its own,
and only the partitions' first rows are ordered among themselves.

Null text counts as empty; texts without words have the empty fingerprint. Fewer than five words are one shingle.
Rows that repeat doc_id and text take one place in the order and get the same result each. A null doc_id is the last in
descending order, equal ids follow their texts' hashes. A single document is its own next one. Further columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.llm import _spark

BITS, SCALED, SHINGLE = 40, 4, 5
SPACE = " \t\n\x0b\x0c\r"
ID_PARTITION_ROWS = 500_000
MOST_FIRSTS = 100_000


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds column `name`, the ascending hashes of the sketch of column `text`."""
    words, hashes = (f"__{x}_{name}" for x in ("words", "hashes"))
    df = df.withColumn(words, F.split(F.btrim(F.col(text), F.lit(SPACE)), "[\\x20\\x09-\\x0D]+"))
    short = lambda *columns: F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS)
    n = F.size(words)
    whole = F.when((n == 1) & (F.element_at(words, 1) == ""), F.array().cast("array<bigint>")).otherwise(F.array(short(F.array_join(words, " "))))
    several = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: short(*[F.col(words)[i + k] for k in range(SHINGLE)]))
    df = df.withColumn(hashes, F.when(n >= SHINGLE, several).otherwise(whole))
    return df.withColumn(name, F.sort_array(F.array_distinct(F.filter(hashes, lambda x: x < (1 << BITS) // SCALED)))).drop(words, hashes)


def merged(a: str, b: str) -> Column:
    """The sketch of both texts together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: str, b: str) -> Column:
    """Share of the smaller set that lies in the other one."""
    smaller = F.least(F.size(a), F.size(b))
    found = F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(0.0)
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(found)


def as_text(sketch: str) -> Column:
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), ""))


def successors(ids: DataFrame, n_rows: int) -> DataFrame:
    """ids (doc_id, hash, n) with next, a struct of the same, by descending doc_id; after the last comes the first."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash")]
    parted = _spark.cut(ids.repartitionByRange(max(1, -(-n_rows // ID_PARTITION_ROWS)), *order).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy(*order)
    row = F.struct("doc_id", "hash", "n")
    led = parted.select("doc_id", "hash", "n", "part", F.lead(row).over(own).alias("follows"), F.row_number().over(own).alias("nth"))
    firsts = _spark.cut(led.where("nth = 1").select("part", row.alias("first")))  # a row for each partition
    parts = Window.partitionBy(F.lit(0)).orderBy("part")
    beyond = firsts.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("beyond"))
    return _spark.join_small(led, beyond, ["part"], MOST_FIRSTS).select("doc_id", "hash", "n", F.coalesce("follows", "beyond").alias("next"))


def same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["to_id"]) & (a["hash"] == b["to_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Operator 5: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    ids = _spark.cut(texts.select("doc_id", "hash", F.char_length("text").alias("n")).groupBy("doc_id", "hash").agg(F.first("n").alias("n"), F.count("*").alias("copies")))
    rows, copies = ids.agg(F.count("*"), F.max("copies")).first()
    linked = _spark.cut(successors(ids.drop("copies"), rows))
    repeated = (copies or 0) > 1
    asked = linked.select(F.col("next.doc_id").alias("to_id"), F.col("next.hash").alias("to_hash"), F.col("doc_id").alias("for_id"), F.col("hash").alias("for_hash"), F.floor(F.col("n") / 3).cast("int").alias("asked"))
    texts = with_sketch(texts, "text", "sketch")
    if repeated:
        texts = texts.groupBy("doc_id", "hash").agg(F.first("text").alias("text"), F.first("sketch").alias("sketch"), F.count("*").cast("int").alias("copies"))
    else:
        texts = texts.withColumn("copies", F.lit(1))
    texts = texts.join(asked, same(texts, asked)).drop("to_id", "to_hash")
    heads = texts.select(F.col("for_id").alias("to_id"), F.col("for_hash").alias("to_hash"), F.expr("substring(text, 1, asked)").alias("head"), F.col("sketch").alias("next_sketch"))
    both = texts.select("doc_id", "hash", "text", "sketch", "copies")
    both = both.join(heads, same(both, heads)).withColumn("n", F.char_length("text"))
    both = both.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.concat(F.expr("substring(text, 1, n - cast(floor(n / 3) as int))"), "head").alias("edited"), "sketch", "next_sketch", "copies")
    both = with_sketch(both, "edited", "edited_sketch")
    found = both.select("copies", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
                       containment("sketch", "edited_sketch").alias("near_edited"), containment("sketch", "next_sketch").alias("near_next"))
    if repeated:
        found = found.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies")))
    return found.drop("copies")

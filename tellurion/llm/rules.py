"""Quality rules with thresholds that adapt to each language and source. Operator 2.

Every document is measured in one pass over its text. Each measure's values are summarised per language and source in a
quantile sketch of logarithmic buckets (every value is known within 2 %; sketches merge by adding their counts, so those of a
language, and of all, come from the sketches of the sources). A document is rejected if a measure lies above the fence of its
language and source,

    median + width * max(upper quartile - median, events / median size),

all quantiles of that group's own sketch. The upper quartile sets the scale, so up to a quarter of a source may be junk before its fences move. Where it equals
the median, the scale is what so many `events` (one symbol, say) are of the group's median document: a share below that can't be told from none.

Sources with few rows lean on their language: its distribution joins their sketch with the weight of `prior` rows, as that of all rows joins a language's.
Nothing switches at a size.

Null text counts as empty, without words, and fails the base rules; a null language or source counts as the empty string.
Repeated rows get the same verdict, each for itself. Empty tables give no rows. Further columns are ignored, or kept by filter_documents().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellurion.llm import _spark, _text

GAMMA = 1.02
LEAST_VALUE = 1e-6
#: Measure: its value for a row, and the events that count as one step of it.
MEASURES = {
    "symbol_share": ("n_symbols / n_words", 1.0),
    "mark_share": ("n_marks / n_words", 1.0),
    "upper_share": ("n_upper / word_chars", 1.0),
    "dup_line_share": ("n_dup_lines / n_lines", 0.25),
    "repeat_share": ("n_repeat_words / n_words", 4.0),
    "echo_share": ("n_echoes / n_words", 1.0),
}
SIZES = ["n_words", "word_chars", "n_lines"]
WIDTH, PRIOR = 12.0, 50.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_echoes"]
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
#: Groups whose fences are sent to all executors; with more, they are joined by a shuffle.
MOST_GROUPS = 20_000

MARK = np.zeros(256, np.int32)
MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-"]] = 1
UPPER = np.zeros(256, np.int32)
UPPER[65:91] = 1
NOT_CONTINUED = np.ones(256, np.int32)
NOT_CONTINUED[0x80:0xC0] = 0


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of rows that lie one behind the other from offset 0."""
    w = _text.words(data, offsets)
    n_words, n = np.diff(w.first), len(offsets) - 1
    solid = ~_text.SPACE[data]

    def total(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[offsets])

    row = np.repeat(np.arange(n), np.maximum(n_words - 7, 0))
    start = np.arange(len(row)) + np.repeat(w.first[:-1] - (np.cumsum(np.maximum(n_words - 7, 0)) - np.maximum(n_words - 7, 0)), np.maximum(n_words - 7, 0))
    repeated = np.zeros(len(w), bool)
    if len(start):
        key = _text.window_hash(w.hash, 8)[start] ^ _text.mix(row.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        repeated = _text.covered(len(w), start[order[twice]], 8)
    seen = np.concatenate(([0], np.cumsum(repeated)))
    raw, dups, lines = data.tobytes(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        own = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        lines[i] = len(own)
        if len(own) > 1:
            dups[i] = len(own) - len(set(own))
    echo = np.concatenate(([False], w.hash[1:] == w.hash[:-1]))[: len(w)]
    echo[w.first[:-1][n_words > 0]] = False
    echoes = np.concatenate(([0], np.cumsum(echo)))
    upper = UPPER[data].astype(np.int64)
    if len(data) > 1:  # the capital letters of Latin-1 are C3 80 to C3 9E
        upper[1:] += (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return {
        "n_words": n_words, "word_chars": total(solid * NOT_CONTINUED[data]), "n_symbols": total(_text.SYMBOL[data]), "n_dup_lines": dups,
        "n_repeat_words": seen[w.first[1:]] - seen[w.first[:-1]], "n_lines": lines, "n_marks": total(MARK[data]), "n_upper": total(upper),
        "n_echoes": echoes[w.first[1:]] - echoes[w.first[:-1]],
    }


def measured(docs: DataFrame, whole: bool = False) -> DataFrame:
    """COUNTS of every row, with its doc_id, lang and source; or with the struct `row` of all its columns."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if whole else docs.select("doc_id", "lang", "source", "text")
    keep = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.buffers(batch.column(0).field("text") if whole else batch.column(3))
            for i, j in _text.groups(offsets, 2 << 20):
                part = offsets[i : j + 1]
                found = measures(data[part[0] : part[-1]], part - part[0])
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*own.columns[: len(keep)], *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], [*(f.name for f in keep), *COUNTS])

    return docs.mapInArrow(_text.tidy(run), T.StructType([*keep, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def _value(measure: str) -> F.Column:
    over, under = MEASURES[measure][0].split(" / ")
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(0.0)


def fences(rows: DataFrame, width: float = WIDTH, prior: float = PRIOR) -> DataFrame:
    """g_lang, g_source and a fence for each measure, from rows with COUNTS, g_lang and g_source."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _value(m).alias("value")) for m in MEASURES], *[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in SIZES]))
    bucket = F.when(F.col("v.value") < LEAST_VALUE, -1_000_000).otherwise(F.ceil(F.log(F.col("v.value")) / float(np.log(GAMMA)))).cast("int")
    sketch = rows.where(~F.expr(BASE_FAILED)).select("g_lang", "g_source", values.alias("v")).select("g_lang", "g_source", "v.measure", bucket.alias("bucket"))
    sketch = _spark.cut(sketch.groupBy("g_lang", "g_source", "measure", "bucket").agg(F.count("*").cast("double").alias("n")))

    def shares(counts: DataFrame, *keys: str) -> DataFrame:
        """Each bucket's share of the `prior` rows by which it leans on its neighbours."""
        return counts.join(counts.groupBy(*keys, "measure").agg(F.sum("n").alias("total")), [*keys, "measure"]).select(*keys, "measure", "bucket", (F.col("n") * prior / F.col("total")).alias("n"))

    def leaning(counts: DataFrame, upon: DataFrame, by: list[str], *keys: str) -> DataFrame:
        """counts of the groups `keys`, each with the shares of what it leans upon."""
        lent = counts.select(*keys, "measure").distinct().join(upon, [*by, "measure"]).select(*keys, "measure", "bucket", "n")
        return counts.unionByName(lent).groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))

    everything = shares(sketch.groupBy("measure", "bucket").agg(F.sum("n").alias("n")))
    languages = leaning(sketch.groupBy("g_lang", "measure", "bucket").agg(F.sum("n").alias("n")), everything, [], "g_lang")
    own = leaning(sketch, shares(_spark.cut(languages), "g_lang"), ["g_lang"], "g_lang", "g_source")
    by = ["g_lang", "g_source", "measure"]
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    reached = own.select(*by, "bucket", upto.alias("upto"), F.sum("n").over(Window.partitionBy(*by)).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q - 1e-6, F.col("bucket")))
    value = lambda b: F.when(b == -1_000_000, 0.0).otherwise(F.pow(F.lit(GAMMA), b.cast("double")) * (2 / (1 + GAMMA)))
    levels = reached.groupBy(*by).agg(value(at(0.5)).alias("mid"), value(at(0.75)).alias("high"))
    level = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    of = levels.groupBy("g_lang", "g_source").agg(*[level(m, c).alias(f"{m}_{c}") for m in MEASURES for c in ("mid", "high")], *[level(c, "mid").alias(c) for c in SIZES])

    def fence(m: str) -> F.Column:
        (expression, events), mid = MEASURES[m], F.col(f"{m}_mid")
        return mid + width * F.greatest(F.col(f"{m}_high") - mid, events / F.greatest(F.col(expression.split(" / ")[1]), F.lit(1.0)))

    return of.select("g_lang", "g_source", *[fence(m).alias(f"fence_{m}") for m in MEASURES])


def _grouped(df: DataFrame) -> DataFrame:
    return df.withColumns({"g_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "g_source": F.coalesce(F.col("source").cast("string"), F.lit(""))})


def _judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    fine = F.lit(True)
    for m in MEASURES:
        fine = fine & (_value(m) <= F.coalesce(F.col(f"fence_{m}"), F.lit(float("inf"))))
    joined = _spark.join_small(_grouped(rows), limits, ["g_lang", "g_source"], MOST_GROUPS, "left")
    return joined.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & fine)


def quality_rules(docs: DataFrame, width: float = WIDTH, prior: float = PRIOR) -> DataFrame:
    """Operator 2: doc_id, COUNTS, base_failed and kept of every document."""
    rows = _spark.cut(measured(docs))
    return _judged(rows, _spark.cut(fences(_grouped(rows), width, prior))).select("doc_id", *COUNTS, "base_failed", "kept")


def filter_documents(docs: DataFrame, width: float = WIDTH, prior: float = PRIOR) -> DataFrame:
    """The documents that are kept, with their columns. The texts are measured twice rather than shuffled or stored."""
    limits = _spark.cut(fences(_grouped(measured(docs)), width, prior))
    rows = measured(docs, whole=True)
    return _judged(rows.withColumns({"lang": F.col("row.lang"), "source": F.col("row.source")}), limits).where("kept").select("row.*")

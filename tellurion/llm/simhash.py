"""SimHash fingerprints and near-duplicate groups by pivot distance tables. Operator 3.

Fingerprints: of the XXH64 hashes of a text's word shingles (A-Z lower-cased), a bit is set where more than half of them have it.

Groups: equal fingerprints are one node, however many documents carry them. The nodes' Hamming distances to a fixed set of
reference fingerprints, the pivots, are tabulated. By the triangle inequality two nodes within `radius` bits differ by
`radius` at most in every coordinate of the table, so pairs are discarded by their largest coordinate difference before
the survivors' distance is verified. Pairs meet in cells: where two fingerprints differ in `radius` bits at most, they agree
in all but `radius` of the blocks that their bits are cut into; a cell is such a choice of blocks together with a band of each of the first KEY_PIVOTS
coordinates, where one side of a pair is in all bands that `radius` reaches. So a crowded choice is split by the table itself. All pairs within the radius are found. Links are then
closed to components, rounds of joins that each write their state to the shared folder.

copy_groups() links texts by the likeness of their shingle sets and uses a pivot table of sets: the reference sets are the shingles whose hash has a
given bit, so a set's Hamming distance to one of them is, but for a constant, its number of shingles less twice SimHash's vote for that bit. Two sets of sizes m and n that
are alike by s differ in (m + n)(1 - s)/(1 + s) shingles at most, and so in every coordinate: what differs by more is discarded before whole sets are compared.
Of large sets that have little in common the table says nothing, as all their votes are near nought; their parities do, a bit or two a shingle, which differ in no more places than the sets do.

Null text counts as empty: fingerprint zero, linked like any other. A null doc_id is a document of its own that is never the
representative of one with an id. Repeated rows fall into one component. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.llm import _spark, _text

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: The reference fingerprints: fixed, spread at random, so that every cluster and every run has the same table.
PIVOTS = [int(x) for x in np.random.Generator(np.random.PCG64(64)).integers(-(2**63), 2**63 - 1, 16)]
BAND, KEY_PIVOTS = 8, 2
#: Reference sets of copy_groups(): one for each of so many bits of a shingle's hash.
SET_PIVOTS = 32
#: Smallest hashes, one for each of so many orders of all shingles, by which copy_groups() first meets crowds of copies.
LEAST_SALTS = [np.uint64(x) for x in np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, 8)]
#: Bytes of a shingle's hash that whole sets are compared by.
SET_BYTES = 5
#: Texts that the common shingles are counted in, and how many shingles are held; an order, right whatever they are.
COMMON_SAMPLE, MOST_COMMON = 16_000, 1 << 18
MARK_BITS = 24


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each row's word shingles, repeats included, and n + 1 offsets."""
    w = _text.words(data, offsets)
    first, n_words = w.first, np.diff(w.first)
    length = w.end - w.start + 1
    begin = np.cumsum(length) - length
    total = int(begin[-1] + length[-1]) if len(w) else 0
    flat = np.full(total + 1, 0x20, np.uint8)
    inside = np.ones(total, bool)
    inside[begin + length - 1] = False
    source = np.repeat(w.start - begin, length) + np.arange(total)
    flat[:total][inside] = data[source[inside]]
    raw = flat.tobytes().translate(LOWER)
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    counts = np.concatenate(([0], np.cumsum(n_shingles)))
    at = np.repeat(first[:-1] - counts[:-1], n_shingles) + np.arange(counts[-1])
    last = np.minimum(at + size, np.repeat(first[1:], n_shingles)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(raw[a:b], SEED) for a, b in zip(begin[at].tolist(), (begin[last] + length[last] - 1).tolist())], np.uint64, len(at)), counts


def votes_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each row's hashes have each bit. Eight bits of a hash are counted in the bytes of one word, 255 hashes at a time."""
    n = np.diff(counts)
    out = np.zeros((len(n), 64), np.int64)
    rows = np.flatnonzero(n)
    if not len(rows):
        return out
    blocks = -(-n[rows] // 255)
    owner = np.repeat(np.arange(len(rows)), blocks)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = counts[rows][owner] + 255 * within
    first = np.cumsum(blocks) - blocks
    for k in range(8):
        lane = (hashes >> np.uint64(k)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lane, starts).view(np.uint8).reshape(-1, 8)
        out[rows, k::8] = np.add.reduceat(sums.astype(np.int64), first, axis=0)
    return out


def fingerprints_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bits of each row's hashes."""
    bits = 2 * votes_of(hashes, counts) > np.diff(counts)[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.buffers(batch.column(1))
            for i, j in _text.groups(offsets, 2 << 20):
                part = offsets[i : j + 1]
                found = fingerprints_of(*shingle_hashes(data[part[0] : part[-1]], part - part[0], shingle))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(_text.tidy(run), f"doc_id {kind}, fp bigint")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def blocks(radius: int, extra: int = 2, bits: int = 64) -> list[tuple[int, ...]]:
    """Masks of blocks to agree in: `radius` + `extra` blocks, of which `extra` are the same in any pair within the radius."""
    n = radius + extra
    edges = [bits * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(x) - ((1 << 64) if sum(x) >> 63 else 0) for x in combinations(masks, extra)]


def near_pairs(nodes: DataFrame, radius: int, band: int = BAND) -> DataFrame:
    """fp_a < fp_b for all pairs of the different fingerprints in column fp within `radius` bits, by the pivot table."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(blocks(radius))]))
    cells = nodes.select("fp", keys.alias("key")).select("fp", "key.*")
    names = [f"band_{k}" for k in range(KEY_PIVOTS)]
    one, other = cells.withColumnRenamed("fp", "fp_a"), cells.withColumnRenamed("fp", "fp_b")
    for name, pivot in zip(names, PIVOTS):
        one = one.withColumn(name, F.floor(distance(F.col("fp_a"), F.lit(pivot)) / band).cast("int"))
        at = distance(F.col("fp_b"), F.lit(pivot))
        other = other.withColumn(name, F.explode(F.sequence(F.floor(F.greatest(at - radius, F.lit(0)) / band).cast("int"), F.floor((at + radius) / band).cast("int"))))
    # a coordinate of the table costs less to form anew than to carry through the shuffle
    apart = reduce(F.greatest, [F.abs(distance(F.col("fp_a"), F.lit(p)) - distance(F.col("fp_b"), F.lit(p))) for p in PIVOTS])
    close = (F.col("fp_a") < F.col("fp_b")) & (apart <= radius) & (distance(F.col("fp_a"), F.col("fp_b")) <= radius)
    return one.join(other, ["choice", "bits", *names]).where(close).select("fp_a", "fp_b").distinct()


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node and root (the least node reachable) of every node that has an edge (columns a, b).

    Large-star and small-star rounds: each keeps the number of edges, at most, and the distance to the root falls by a
    constant factor, so chains of any length end. No round looks at more than the links of the round before it.
    """
    edges = _spark.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        # large star: the larger neighbours of each node go to the least of its neighbourhood
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours go to the least of them
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(m.select("a", F.col("m").alias("b")))
        edges = _spark.cut(small.distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components have not settled")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(prints: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach. `prints` must be a table that reads the same each time."""
    nodes = _spark.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_pairs(nodes, radius).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
    return prints.join(_owners(nodes, "fp", roots), "fp").select("doc_id", "fp", "component_id")


def _owners(nodes: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """key and component_id of every node, from its `least` doc_id and the roots of those with links."""
    owned = _spark.cut(nodes.join(roots, nodes[key] == roots["node"], "left").select(key, "least", F.coalesce("root", key).alias("root")))
    return owned.join(owned.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(key, "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, **columns: str) -> DataFrame:
    """Operator 3: doc_id, fp and component_id of every document."""
    return near_groups(_spark.cut(fingerprints(docs, shingle, **columns)), radius)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the sorted 64-bit hashes of its different word shingles, and n + 1 offsets. A text of fewer words is one shingle."""
    plain = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    w = _text.words(plain, offsets)
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, 0)
    counts = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(w.first[:-1] - counts[:-1], count) + np.arange(counts[-1])
    found = _text.mix(_text.window_hash(w.hash, size)[at])
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.array([_text.mix(_text.window_hash(w.hash[w.first[k] : w.first[k + 1]], int(n[k])))[0] for k in short], np.uint64)
        found, count = np.insert(found, counts[short], whole), np.where(n >= size, count, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    found = found[np.lexsort((found, row))]
    new = np.concatenate(([True], (found[1:] != found[:-1]) | (row[1:] != row[:-1])))[: len(found)]
    return found[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(n)))))


def _by_sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch, whose last column is the text, with their shingle sets."""
    data, offsets = _text.buffers(batch.column(batch.num_columns - 1))
    for i, j in _text.groups(offsets, 2 << 20):
        part = offsets[i : j + 1]
        yield i, j, *shingle_sets(data[part[0] : part[-1]], part - part[0], shingle)


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample hold, sorted, and in how many. They only set the order in which shingles are looked up."""
    n = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64("text", F.lit("common")), F.lit(1 << 30)) < int(min(1.0, COMMON_SAMPLE / max(n, 1)) * (1 << 30))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, _ in _by_sets(batch, shingle):
                found, many = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(many)], ["token", "n"])

    counted = drawn.mapInArrow(_text.tidy(run), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 3")
    top = counted.orderBy(F.desc("n"), "token").limit(MOST_COMMON).toArrow()
    tokens, many = top["token"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    order = np.argsort(tokens)
    return tokens[order], many[order]


def parities(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Of each row's different hashes: for each value of their low bits whether an odd number has it. A row has as many values as hashes, rounded up to a power of two, 8 at least."""
    n = np.diff(counts)
    width = 1 << np.maximum(3, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.concatenate(([0], np.cumsum(width)))
    slot = np.repeat(ends[:-1], n) + (hashes & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(slot, minlength=int(ends[-1])) & 1).astype(bool), bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip((ends[:-1] // 8).tolist(), (ends[1:] // 8).tolist())]


def least_apart(a: bytes, b: bytes) -> int:
    """In how many hashes the sets of two parities() differ at least."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) != len(y):  # the longer one is folded: the parity of fewer low bits
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_length(n, share: float):
    """How many of the first of n shingles one of at least share * n common ones must be among. Rounding errors only lengthen it."""
    return np.where(n > 0, n - np.ceil(share * n - 1e-9).astype(np.int64) + 1, 0)


def prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id; mark, of the text; key, of the shingle set: equal for equal sets; n, its size; coords, its row of the pivot table; least, its smallest hashes; parity, its parities; prefix, its first shingles: the rare before the common."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))
    docs = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, many = sent.value
        for batch in batches:
            for i, j, hashes, counts in _by_sets(batch, shingle):
                n = np.diff(counts)
                raw = hashes.astype("<u8").tobytes()
                keys = np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(counts[:-1].tolist(), counts[1:].tolist())], np.uint64)
                parity = parities(hashes, counts)
                if len(tokens) and len(hashes):
                    at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
                    level = np.where(tokens[at] == hashes, many[at], 0)
                    hashes = hashes[np.lexsort((level, np.repeat(np.arange(len(n)), n)))]
                coords = (n[:, None] - 2 * votes_of(hashes, counts)[:, :: 64 // SET_PIVOTS]).astype(np.int32)
                coords = pa.ListArray.from_arrays(pa.array(np.arange(0, coords.size + 1, SET_PIVOTS, dtype=np.int32)), pa.array(coords.ravel()))
                some = np.flatnonzero(n)
                smallest = np.stack([np.minimum.reduceat(_text.mix(hashes ^ salt), counts[some]) for salt in LEAST_SALTS], 1) if len(some) else np.zeros((0, len(LEAST_SALTS)), np.uint64)
                bounds = np.concatenate(([0], np.cumsum(np.where(n > 0, len(LEAST_SALTS), 0))))
                least = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(smallest.ravel().view(np.int64)))
                taken = prefix_length(n, similarity)
                ends = np.concatenate(([0], np.cumsum(taken)))
                first = hashes[np.repeat(counts[:-1] - ends[:-1], taken) + np.arange(ends[-1])]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(first.view(np.int64)))
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(keys.view(np.int64)), pa.array(n), coords, least, pa.array(parity, pa.binary()), lists], ["doc_id", "mark", "key", "n", "coords", "least", "parity", "prefix"])

    return docs.mapInArrow(_text.tidy(run), f"doc_id {kind}, mark bigint, key bigint, n bigint, coords array<int>, least array<bigint>, parity binary, prefix array<bigint>")


def first_candidates(nodes: DataFrame) -> DataFrame:
    """a and b: each set with the first of those that share a smallest hash with it, so a crowd costs a pair for each of its members."""
    rows = nodes.select("key", F.posexplode("least").alias("at", "value"))
    heads = rows.groupBy("at", "value").agg(F.min("key").alias("b"), F.count("*").alias("many")).where("many > 1").drop("many")
    return rows.join(heads, ["at", "value"]).where("key <> b").select(F.col("key").alias("a"), "b").distinct()


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """a and b for all pairs of sets of different `root` that may be alike by `similarity` or more, from columns key, root, n and prefix.

    The smaller set of such a pair holds a common shingle among its first n - 2s/(1+s) n + 1, the larger among its first n - s n + 1.
    What lies behind a common shingle bounds the number of common ones. Shingles that only sets of one root hold are left out first.
    """
    share = similarity / (1 + similarity)
    rows = nodes.select("key", "root", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token"))
    mixed = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    rows = _spark.table(rows.join(mixed, "token"))
    one = rows.where(F.col("at") <= F.col("n") - F.ceil(2 * share * F.col("n") - 1e-9)).select("token", F.col("key").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    other = rows.select("token", F.col("key").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    sizes = (F.col("n_a") >= similarity * F.col("n_b") - 1e-9) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= share * (F.col("n_a") + F.col("n_b")) - 1e-9
    return one.join(other, "token").where(sizes & rest & (F.col("root_a") != F.col("root_b"))).select("a", "b").distinct()


def by_pivots(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs that no coordinate of the pivot table tells apart."""
    side = lambda k: nodes.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("coords").alias(f"at_{k}"))
    apart = F.array_max(F.zip_with("at_a", "at_b", lambda x, y: F.abs(x - y)))
    most = (F.col("n_a") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= most).select("a", "b")


def by_parities(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs that their parities don't tell apart. Of large sets, they take a twentieth of the bytes of the whole sets, or less."""
    side = lambda k: nodes.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"parity_{k}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * ((1 - similarity) / (1 + similarity)) + 1e-6
            apart = np.fromiter((least_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(apart <= most, pa.bool_()))

    return held.mapInArrow(_text.tidy(run), "a bigint, b bigint")


def sets_of(docs: DataFrame, marks: DataFrame, shingle: int) -> DataFrame:
    """key and whole, the first SET_BYTES of the sorted shingle hashes, once for each set of the texts with those marks, and of some others.

    Which texts to look at travels as 2**MARK_BITS bits, whatever the number of texts; it saves work and decides nothing.
    """
    bits = np.zeros(1 << MARK_BITS, bool)
    for r in marks.select(F.col("mark").bitwiseAND((1 << MARK_BITS) - 1).cast("int").alias("slot")).distinct().toArrow().to_batches():
        bits[r.column(0).to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy() & ((1 << MARK_BITS) - 1)
            for _, _, hashes, counts in _by_sets(batch.filter(pa.array((sent.value[slot >> 3] >> (slot & 7)) & 1 == 1)), shingle):
                raw = hashes.astype("<u8").tobytes()
                keys = np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(counts[:-1].tolist(), counts[1:].tolist())], np.uint64)
                short = np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]).tobytes()
                whole = [short[SET_BYTES * a : SET_BYTES * b] for a, b in zip(counts[:-1].tolist(), counts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(whole, pa.binary())], ["key", "whole"])

    return docs.select(F.xxhash64("text").alias("mark"), "text").mapInArrow(_text.tidy(run), "key bigint, whole binary").groupBy("key").agg(F.first("whole").alias("whole"))


def likeness(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets as sets_of() has them."""
    x, y = (np.zeros((len(v) // SET_BYTES, 8), np.uint8) for v in (a, b))
    for rows, raw in ((x, a), (y, b)):
        rows[:, :SET_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SET_BYTES)
    both = len(np.intersect1d(x.view(">u8").ravel(), y.view(">u8").ravel(), True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Of the pairs a, b those whose whole sets are alike, after the pivot table and the parities have discarded what they can."""
    pairs = _spark.cut(by_parities(by_pivots(pairs, nodes, similarity), nodes, similarity))
    met = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    sets = sets_of(docs, nodes.select("key", "mark").join(met, "key"), shingle)
    held = pairs.join(sets.select(F.col("key").alias("a"), F.col("whole").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("whole").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [likeness(x.as_py(), y.as_py()) >= similarity for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return _spark.cut(held.mapInArrow(_text.tidy(run), "a bigint, b bigint"))


def copy_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, mark (of the text) and root of every document; equal roots are one group.

    All texts link whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Texts of equal sets are one node. Crowds of near copies
    are met first, each member with the first one that shares a smallest hash with it; what that links needs no further pairs. Then candidates of different groups share a shingle of their
    prefixes, which no such pair can avoid. In both, the pivot table and the parities discard those that they tell apart, and each that is left is verified on the whole sets.
    Null texts count as empty; texts without words are alike and link with each other. A null doc_id is a document of its own.
    """
    prints = _spark.table(prefixes(docs, shingle, similarity))
    nodes = _spark.table(prints.groupBy("key").agg(*[F.first(c).alias(c) for c in ("mark", "n", "coords", "least", "parity", "prefix")]))
    links = verified(docs, nodes, first_candidates(nodes), similarity, shingle)
    known = components(links)
    rooted = nodes.join(known, nodes["key"] == known["node"], "left").select("key", "n", "prefix", F.coalesce("root", "key").alias("root"))
    links = links.union(verified(docs, nodes, candidates(rooted, similarity), similarity, shingle))
    roots = components(links)
    return prints.select("doc_id", "mark", "key").join(roots, prints["key"] == roots["node"], "left").select("doc_id", "mark", F.coalesce("root", "key").alias("root"))


def near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of its group, of every document."""
    groups = _spark.cut(copy_groups(docs, **parameters))
    return groups.join(groups.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """Of each group of copy_groups() one row: the first by doc_id (null behind all others), then by the text's and the row's hash."""
    groups = _spark.cut(copy_groups(docs, **parameters))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"))
    rows = groups.groupBy(F.col("doc_id").alias("kept"), F.col("mark").alias("kept_mark")).agg(F.count("*").alias("many"))
    kept = _spark.cut(first.join(rows, F.col("first.doc_id").eqNullSafe(F.col("kept")) & (F.col("first.mark") == F.col("kept_mark"))).select("kept", "kept_mark", "many"))
    held = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept"]) & (F.xxhash64(docs["text"]) == kept["kept_mark"]))
    # rows that share doc_id and text are few; of them the one with the least hash of all columns
    least = Window.partitionBy("kept", "kept_mark").orderBy(F.xxhash64(*[docs[c] for c in docs.columns]))
    again = held.where("many > 1").withColumn("nth", F.row_number().over(least)).where("nth = 1").select(*docs.columns)
    return held.where("many = 1").select(*docs.columns).union(again)

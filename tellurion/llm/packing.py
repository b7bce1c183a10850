"""Packing of documents into sequences of a fixed number of tokens. Operators 4 and 8.

Both cut a document's ids (its tokens, then the separator id) into pieces of at most `capacity` tokens, count the pieces of
each length, plan on that histogram (at most `capacity` rows, however many documents there are) and look every piece's place up by
its length and its rank among the pieces of that length. Ranks need no sort: a task numbers its own pieces of each length as
it writes them, and the counts of the tasks before it are added.

Null texts count as empty and give the separator alone. Repeated rows are packed each for itself; a null doc_id stays null.
Documents of any length are cut losslessly. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellurion.llm import _spark, _text, plans
from tellurion.llm.encoding import encoded

#: Rows of the table of ranks that are sent to all executors; with more, it is joined by a shuffle.
MOST_RANKS = 200_000
#: Bytes of text that are encoded and cut together.
PART_BYTES = 1 << 19
#: Pieces that are put together to matrices at once.
PIECES_AT_ONCE = 500
#: Sequences in a file of write_matrices().
ROWS_A_FILE = 2048


def cut_up(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, separator: int, with_ids: bool, part: int) -> Iterator[pa.RecordBatch]:
    """The pieces of one task's documents, doc_id and text."""
    seen = np.zeros(capacity + 1, np.int64)
    for rows, ids, counts in encoded(tokenizer, batches, "text", group=PART_BYTES):
        n = len(counts) - 1
        ids = np.insert(ids, counts[1:], separator).astype("<u4")
        counts = counts + np.arange(n + 1)
        sizes = np.diff(counts)
        each = -(-sizes // capacity)
        row = np.repeat(np.arange(n), each)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        start = piece * capacity
        length = np.minimum(capacity, sizes[row] - start)
        order = np.argsort(length, kind="stable")
        runs = length[order]
        first = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
        nth = np.empty(len(row), np.int64)
        nth[order] = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) + seen[runs]
        seen += np.bincount(length, minlength=capacity + 1)
        raw = ids.tobytes()
        at = 4 * (counts[row] + start)
        cut = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
        columns = [rows.column(0).take(pa.array(row)), *map(pa.array, (piece.astype(np.int32), start, length, np.fromiter(map(zlib.crc32, cut), np.int64, len(cut)), np.full(len(row), part, np.int32), nth))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
        if with_ids:
            columns, names = [*columns, pa.array(cut, pa.binary())], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, separator: int = 0, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part and nth (the piece is the nth of its length in its task), perhaps ids."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut_up(batches, tokenizer, capacity, separator, with_ids, TaskContext.get().partitionId())

    return docs.mapInArrow(_text.tidy(run, "encoding"), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + ", ids binary" * with_ids)


def place(found: DataFrame, plan: Callable[[dict[int, int], int], plans.Plan], capacity: int) -> DataFrame:
    """Adds sequence_id and offset. `found` must be a table that reads the same each time."""
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = _spark.cut(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    histogram = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = plans.Slots(plan(histogram, capacity))
    kept = [c for c in found.columns if c not in ("part", "nth")]
    ranked = _spark.join_small(found, base.drop("n"), ["part", "length"], MOST_RANKS).select(*kept, (F.col("base") + F.col("nth")).alias("rank"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(_text.tidy(run), ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def pack_by_configurations(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False, **columns: str) -> DataFrame:
    """Operator 8: the configuration linear program over lengths. A row for each piece."""
    save = _spark.table if with_ids else _spark.cut
    return place(save(pieces(docs, tokenizer, capacity, separator, with_ids, **columns)), plans.configuration_lp, capacity)


def pack_matrices(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, padding: int = 0, **columns: str) -> DataFrame:
    """Operator 4: best-fit-decreasing. A row for each sequence.

    sequence_id; n_tokens; ids: `capacity` ids, little-endian unsigned 32 bit, filled up with `padding`; cu_seqlens: 0 and the end of each
    segment; position_resets: where the position starts anew from 0, the start of each segment and of the padding, if any; of each
    segment doc_id, piece and start (of its ids in the document's).
    """
    placed = place(_spark.table(pieces(docs, tokenizer, capacity, separator, True, **columns)), plans.best_fit_decreasing, capacity)
    kind = placed.schema["doc_id"].dataType.simpleString()
    placed = placed.select("sequence_id", "offset", "length", "doc_id", "piece", "start", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    names = ["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def rows(table: pa.Table) -> pa.RecordBatch:
            sequence, length = table["sequence_id"].to_numpy(), table["length"].to_numpy()
            first = np.flatnonzero(np.concatenate(([True], sequence[1:] != sequence[:-1])))
            bounds = np.append(first, len(sequence)).tolist()
            ids, lengths = table["ids"].to_pylist(), np.add.reduceat(length, first)
            matrix, cumulative, resets = [], [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                ends = np.concatenate(([0], np.cumsum(length[a:b])))
                fill = capacity - int(ends[-1])
                matrix.append(b"".join(ids[a:b]) + np.full(fill, padding, "<u4").tobytes())
                cumulative.append(ends.astype(np.int32))
                resets.append((ends if fill else ends[:-1]).astype(np.int32))
            offsets = pa.array(np.array(bounds, np.int32))
            lists = [pa.ListArray.from_arrays(offsets, table[c].combine_chunks()) for c in ("doc_id", "piece", "start")]
            return pa.RecordBatch.from_arrays([pa.array(sequence[first]), pa.array(lengths), pa.array(matrix, pa.binary()), pa.array(cumulative, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), *lists], names)

        for batch in batches:
            for at in range(0, batch.num_rows, PIECES_AT_ONCE):
                part = pa.Table.from_batches([batch.slice(at, PIECES_AT_ONCE)])
                held = pa.concat_tables([held, part]) if held is not None else part
                last = held["sequence_id"].to_numpy()
                whole = int(np.searchsorted(last, last[-1], "left"))
                if whole:
                    yield rows(held.slice(0, whole).combine_chunks())
                    held = held.slice(whole)
        if held is not None:
            yield rows(held.combine_chunks())

    return placed.mapInArrow(_text.tidy(run), f"sequence_id bigint, n_tokens bigint, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, pieces array<int>, starts array<bigint>")


def write_matrices(packed: DataFrame, folder: str, capacity: int = 2048) -> DataFrame:
    """Writes what pack_matrices returns into a folder that all executors share: of each task an id matrix, the cumulative
    lengths and the position resets, as .npy files of ROWS_A_FILE sequences. Returns their manifest. A task that is run again writes the same names anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        held: list[pa.RecordBatch] = []
        n_files = 0

        def write() -> pa.RecordBatch:
            nonlocal n_files
            rows = pa.Table.from_batches(held)
            os.makedirs(folder, exist_ok=True)
            name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{n_files:05d}"
            n_files += 1
            ends, resets = rows["cu_seqlens"].combine_chunks(), rows["position_resets"].combine_chunks()
            ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), "<u4").reshape(-1, capacity)
            for kind, array in (("ids", ids), ("cu_seqlens", ends.flatten()), ("position_resets", resets.flatten()), ("sequences", rows["sequence_id"]), ("segments", pc.subtract(pc.list_value_length(ends), 1))):
                temporary = f"{name}.{kind}.{TaskContext.get().taskAttemptId()}.tmp"
                with open(temporary, "wb") as f:
                    np.save(f, array if kind == "ids" else array.to_numpy(zero_copy_only=False) if isinstance(array, pa.Array) else array.to_numpy())
                os.replace(temporary, f"{name}.{kind}.npy")
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64())], ["file", "sequences"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, ROWS_A_FILE - sum(x.num_rows for x in held)))
                at += held[-1].num_rows
                if sum(x.num_rows for x in held) == ROWS_A_FILE:
                    yield write()
        if held:
            yield write()

    return packed.mapInArrow(_text.tidy(run), "file string, sequences bigint")

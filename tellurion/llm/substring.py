"""Substring dedup by recompression. Operator 1.

Every word gets a 64-bit name. Rounds of recompression then shorten each document: first runs of one name, then pairs of a
"left" name followed by a "right" one become new names, where a bit of the name says which of the two it is. New names are hashes
of what they stand for, so Spark names globally without a dictionary to share, and equal substrings get equal names inside,
whatever stands around them.

1. Reveal. Symbols whose name is a local minimum, each with its two neighbours, are the anchors; of each the kernel tracks which words decided it.
   A window of 13 words that holds an anchor which no other document has can't be repeated, so anchors go by their name to shards, which tell
   which of them several documents have.
2. Verify. The other windows are named by their own recompression: what its edges alone would decide is popped, round by round, and the
   symbols between are those that the document already has. Equal windows have equal sequences of popped and inner symbols, different windows
   different ones; a window's name is 96 bits of that sequence. Names go to shards, which find the smallest document of each.
3. What the shards found goes back to the documents, where words are removed.

Documents are spread over homes of some megabytes. A home sends a name once, however many of its documents hold it, with the least of their
ids, and gets it back once: a hot passage, a hot source or a group of thousands of copies costs its shard one entry a home, not one an occurrence.

Null text counts as empty. A document without doc_id comes after all others. Ids that are no integers are ranked first, in their own order. Rows that repeat a
doc_id count as one document: a window that both hold isn't removed from either, as neither has the smaller id; rows that repeat id and text share a home.
Empty tables give no rows. Further columns, whatever their names, are ignored, or kept by remove_repeats().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellurion.llm import _spark, _text

#: Rounds of pairs below the anchors, and below the symbols that name a window.
LEVELS, NAME_LEVELS = 1, 2
NO_ID = np.iinfo(np.int64).max
RUN_SALT, PAIR_SALT, ANCHOR_SALT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
SHARD_BYTES, KEYS_A_SHARD = 6 << 20, 8
#: Bytes of text whose windows a home looks at together: some twenty numbers a word are held at once.
PART_BYTES = 1 << 20


def recompress(name: np.ndarray, row: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, rows, and the first and last word that decided each symbol: runs of words, then so many rounds of pairs.

    The end of a row decides as well; it counts as one word beyond.
    """
    low, high = np.arange(len(name)), np.arange(len(name))
    if not len(name):
        return name, row, low, high
    # runs: each symbol, single or not, is decided by the words beside it, which differ
    first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (row[1:] != row[:-1]))))
    length = np.diff(np.append(first, len(name)))
    name = np.where(length > 1, _text.mix(name[first] ^ (length.astype(np.uint64) * RUN_SALT)), name[first])
    row, low, high = row[first], first - 1, first + length
    for level in range(levels):
        # pairs: a left name before a right one. A left name that stays single was decided by the next symbol, a right one by the one before
        left = (_text.mix(name + np.uint64(level)) >> np.uint64(63)).astype(bool)
        same = row[1:] == row[:-1]
        joins = np.concatenate((left[:-1] & ~left[1:] & same, [False]))
        keep = ~np.concatenate(([False], joins[:-1]))
        next_low, next_high = np.append(np.where(same, low[1:], low[:-1]), low[-1]), np.append(np.where(same, high[1:], high[:-1] + 1), high[-1] + 1)
        last_low, last_high = np.insert(np.where(same, low[:-1], low[1:] - 1), 0, low[0] - 1), np.insert(np.where(same, high[:-1], high[1:]), 0, high[0])
        ahead = joins | left
        low, high = np.minimum(low, np.where(ahead, next_low, last_low)), np.maximum(high, np.where(ahead, next_high, last_high))
        pair = _text.mix(name + PAIR_SALT * _text.mix(np.append(name[1:], np.uint64(0)) + np.uint64(level + 1)))
        name, row, low, high = np.where(joins, pair, name)[keep], row[keep], low[keep], high[keep]
    return name, row, low, high


def anchors(words: _text.Words, width: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, row, and first and last deciding word (within all words) of each anchor that fits a window of `width` words."""
    name, row, low, high = recompress(words.hash, words.row, levels)
    if len(name) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = _text.mix(name ^ ANCHOR_SALT)
    middle = np.flatnonzero((order[1:-1] < order[:-2]) & (order[1:-1] <= order[2:]) & (row[1:-1] == row[:-2]) & (row[1:-1] == row[2:])) + 1
    key = _text.mix(name[middle - 1] + PAIR_SALT * _text.mix(name[middle] + PAIR_SALT * _text.mix(name[middle + 1])))
    first = np.minimum(np.minimum(low[middle - 1], low[middle]), low[middle + 1])
    last = np.maximum(np.maximum(high[middle - 1], high[middle]), high[middle + 1])
    row = row[middle]
    fits = (last - first < width) & (first >= words.first[row]) & (last < words.first[row + 1])
    return key[fits], row[fits], first[fits], last[fits]


class Names:
    """Names of windows, by the symbols of their own recompression."""

    def __init__(self, words: _text.Words, levels: int = NAME_LEVELS):
        name, row, n = words.hash, words.row, len(words)
        self.words = words
        first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (row[1:] != row[:-1])))) if n else np.zeros(0, np.int64)
        length = np.diff(np.append(first, n))
        self.run, self.begin, self.end = np.repeat(np.arange(len(first)), length), first, first + length
        name, row = np.where(length > 1, _text.mix(name[first] ^ (length.astype(np.uint64) * RUN_SALT)), name[first]), row[first]
        #: Of each round: names, which of them are left ones, and how many symbols of the next round begin before each.
        self.rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(levels):
            left = (_text.mix(name + np.uint64(level)) >> np.uint64(63)).astype(bool)
            joins = np.concatenate((left[:-1] & ~left[1:] & (row[1:] == row[:-1]), [False]))[: len(name)]
            keep = ~np.concatenate(([False], joins[:-1]))[: len(name)]
            self.rounds.append((name, left, np.concatenate(([0], np.cumsum(keep)))))
            pair = _text.mix(name + PAIR_SALT * _text.mix(np.append(name[1:], np.uint64(0))[: len(name)] + np.uint64(level + 1)))
            name, row = np.where(joins, pair, name)[keep], row[keep]
        self.top = name

    def of(self, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits for the window of `width` words, within one row, at each place."""
        sums = [[np.full(len(start), salt, np.uint64) for salt in (s, s + 1)] for s in (11, 23)]

        def absorb(side: int, x: np.ndarray, where: np.ndarray | None = None) -> None:
            for acc, factor in zip(sums[side], (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))):
                new = (acc ^ x if where is None else acc[where] ^ x) * factor
                new ^= new >> np.uint64(29)
                acc[slice(None) if where is None else where] = new

        h, last = self.words.hash, start + width - 1
        first_run, last_run = self.run[start], self.run[last]
        # the runs at the edges may go on outside: they count as far as they lie in the window
        absorb(0, _text.mix(h[start] + (np.minimum(self.end[first_run], last + 1) - start).astype(np.uint64)))
        absorb(1, _text.mix(h[last] + (last + 1 - np.maximum(self.begin[last_run], start)).astype(np.uint64)))
        p, q = np.minimum(first_run + 1, last_run), last_run
        for name, left, up in self.rounds:
            # a right name at the front may belong to what stands before it, a left one at the end to what follows
            pop = np.flatnonzero((p < q) & ~left[np.minimum(p, len(left) - 1)])
            absorb(0, name[p[pop]], pop)
            p[pop] += 1
            pop = np.flatnonzero((p < q) & left[np.maximum(q - 1, 0)])
            q = q.copy()
            absorb(1, name[q[pop] - 1], pop)
            q[pop] -= 1
            for side in (0, 1):  # what was popped in this round is told from what is popped in the next
                absorb(side, np.uint64(7))
            p, q = up[p], np.maximum(up[q], up[p])
        inner = np.flatnonzero(p < q)
        while len(inner):
            absorb(0, self.top[p[inner]], inner)
            p[inner] += 1
            inner = inner[p[inner] < q[inner]]
        name = _text.mix(sums[0][0] + PAIR_SALT * _text.mix(sums[1][0]))
        return name, (_text.mix(sums[0][1] + RUN_SALT * _text.mix(sums[1][1])) >> np.uint64(32)).astype("<u4")


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all lowest bytes first: what is mostly small is then mostly zeros, which the shuffle compresses."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


SENT = pa.schema([("shard", pa.int32()), ("home", pa.int32()), *((c, pa.binary()) for c in ("keys", "checks", "ids", "who", "more"))])
SENT_SQL = "shard int, home int, keys binary, checks binary, ids binary, who binary, more binary"
FOUND_SQL = "home int, keys binary, checks binary, ids binary"


def _packed(home: int, n_shards: int, key: np.ndarray, check: np.ndarray | None, ids: np.ndarray) -> pa.Table:
    """A row for each shard: the home's different names, the least id that has each, and whether others have it as well."""
    order = np.lexsort((ids, key) if check is None else (ids, check, key))
    key, check, ids = key[order], None if check is None else check[order], ids[order]
    new = key[1:] != key[:-1] if check is None else (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(np.concatenate(([True], new))[: len(key)])
    more = ids[first] != ids[np.append(first[1:], len(key)) - 1] if len(key) else np.zeros(0, bool)
    key, check, ids = key[first], None if check is None else check[first], ids[first]
    shard = (key % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(n_shards + 1))
    rows: list[dict] = []
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        own = order[bounds[s] : bounds[s + 1]]
        known, who = np.unique(ids[own], return_inverse=True)
        rows.append({"shard": s, "home": home, "keys": key[own].tobytes(), "checks": None if check is None else check[own].tobytes(), "ids": known.astype("<i8").tobytes(), "who": _planes(who), "more": np.packbits(more[own]).tobytes()})
    return pa.Table.from_pylist(rows, SENT)


def _received(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """All that a shard was sent, in the order of names: home, key, check, least id, whether others have it; and where a name begins."""
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for r in batch.to_pylist():
            key = np.frombuffer(r["keys"], "<u8")
            check = np.frombuffer(r["checks"], "<u4") if r["checks"] else np.zeros(len(key), "<u4")
            parts.append((np.full(len(key), r["home"], np.int32), key, check, np.frombuffer(r["ids"], "<i8")[_numbers(r["who"])], np.unpackbits(np.frombuffer(r["more"], np.uint8), count=len(key)).astype(bool)))
    if not parts:
        return None
    # column by column, so that no more than one of them is held twice
    columns = list(map(list, zip(*parts)))
    parts.clear()
    whole: list[np.ndarray] = []
    while columns:
        whole.append(np.concatenate(columns.pop(0)))
    order = np.lexsort((whole[2], whole[1]))
    for i, x in enumerate(whole):
        whole[i] = x[order]
    home, key, check, ids, more = whole
    return home, key, check, ids, more, np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1]))))


def _returned(home: np.ndarray, key: np.ndarray, check: np.ndarray | None = None, ids: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each home."""
    order = np.argsort(home, kind="stable")
    homes, first = np.unique(home[order], return_index=True)
    parts = [[None] * len(homes) if v is None else [x.tobytes() for x in np.split(v[order], first[1:])][: len(homes)] for v in (key, check, ids)]
    return pa.RecordBatch.from_arrays([pa.array(homes.astype(np.int32)), *(pa.array(x, pa.binary()) for x in parts)], ["home", "keys", "checks", "ids"])


def match_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard: to each home those of its anchors that several documents have."""
    got = _received(batches)
    if got is not None:
        home, key, check, ids, more, first = got
        several = np.logical_or.reduceat(more, first) | (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first))
        back = np.repeat(several, np.diff(np.append(first, len(key))))
        yield _returned(home[back], key[back])


def match_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard: to each home those of its windows of which an earlier document is known, with its id."""
    got = _received(batches)
    if got is not None:
        home, key, check, ids, more, first = got
        least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(key))))
        back = more | (ids > least)
        yield _returned(home[back], key[back], check[back], least[back])


def _ordered(docs: DataFrame) -> DataFrame:
    """row, a struct of the columns, and ord, a number for each doc_id that keeps their order; NO_ID for null."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"))
    ids = docs.select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    ranked = _spark.cut(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("ord", F.monotonically_increasing_id()))
    rows = docs.select(row)
    return rows.join(ranked, F.col("row.doc_id") == ranked["id"], "left").select("row", F.coalesce("ord", F.lit(NO_ID)).alias("ord"))


def _parts(own: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and ids of groups of rows."""
    row = own["row"].combine_chunks()
    text = pa.concat_arrays([x.field("text") for x in row.chunks]) if isinstance(row, pa.ChunkedArray) else row.field("text")
    data, offsets = _text.buffers(text)
    ids = own["ord"].to_numpy()
    for i, j in _text.groups(offsets, PART_BYTES):
        part = offsets[i : j + 1]
        yield data[part[0] : part[-1]], part - part[0], ids[i:j]


def _starts(w: _text.Words, width: int) -> np.ndarray:
    """Where windows begin."""
    count = np.maximum(np.diff(w.first) - width + 1, 0)
    return np.repeat(w.first[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _column(found: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(found[name].to_pylist()), kind)


def repeats(docs: DataFrame, width: int = 13, levels: int = LEVELS, name_levels: int = NAME_LEVELS, n_shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents with their homes; for each home the names of windows to remove, with the id of the first document of each."""
    n = n_shards or _spark.shards(_spark.text_bytes(docs), SHARD_BYTES)
    n_keys = max(min(n, 12), n // KEYS_A_SHARD)
    texts = _ordered(docs).select("row", "ord", F.pmod(F.xxhash64("ord", "row.text"), F.lit(n)).cast("int").alias("home"))

    def find_anchors(home: tuple, own: pa.Table) -> pa.Table:
        keys, ids = [], []
        for data, offsets, order in _parts(own):
            key, row, _, _ = anchors(_text.words(data, offsets), width, levels)
            keys.append(key)
            ids.append(order[row])
        key = _joined(keys, "<u8")
        return _packed(home[0].as_py(), n_keys, key, None, _joined(ids, "<i8"))

    def name_windows(home: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        shared = np.unique(_column(found, "keys", "<u8"))
        keys, checks, ids = [], [], []
        for data, offsets, order in _parts(own):
            w = _text.words(data, offsets)
            key, row, first, last = anchors(w, width, levels)
            lone = np.ones(len(key), bool)
            if len(shared):
                lone = shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] != key
            # a lone anchor rules out the windows that begin from last - width + 1 to first
            change = np.bincount(np.maximum(last[lone] - width + 1, w.first[row[lone]]), minlength=len(w) + 1)
            change -= np.bincount(first[lone] + 1, minlength=len(w) + 1)
            start = _starts(w, width)
            start = start[np.cumsum(change)[start] == 0]
            if len(start):
                name, check = Names(w, name_levels).of(start, width)
                keys.append(name)
                checks.append(check)
                ids.append(order[np.searchsorted(w.first, start, "right") - 1])
        return _packed(home[0].as_py(), n_keys, _joined(keys, "<u8"), _joined(checks, "<u4"), _joined(ids, "<i8"))

    sent = texts.groupBy("home").applyInArrow(_whole(find_anchors), SENT_SQL)
    known = sent.repartitionById(n_keys, "shard").mapInArrow(_text.tidy(match_anchors), FOUND_SQL)
    windows = texts.groupBy("home").cogroup(known.groupBy("home")).applyInArrow(_whole(name_windows), SENT_SQL)
    return texts, windows.repartitionById(n_keys, "shard").mapInArrow(_text.tidy(match_windows), FOUND_SQL)


def _whole(f):
    """A function of a group that gives memory back when it is done."""

    def run(*arguments):
        try:
            return f(*arguments)
        finally:
            _text.give_back()

    # Spark tells the two kinds of functions apart by their number of arguments
    return (lambda key, own: run(key, own)) if f.__code__.co_argcount == 2 else (lambda key, own, found: run(key, own, found))


def _keep_words(own: pa.Table, found: pa.Table, width: int, name_levels: int) -> Iterator[tuple[np.ndarray, np.ndarray, _text.Words, np.ndarray]]:
    """Of groups of rows: bytes, offsets, words, and which words are removed."""
    key, check, least = (_column(found, c, k) for c, k in (("keys", "<u8"), ("checks", "<u4"), ("ids", "<i8")))
    order = np.argsort(key, kind="stable")
    key, check, least = key[order], check[order], least[order]
    for data, offsets, ids in _parts(own):
        w = _text.words(data, offsets)
        gone = np.zeros(len(w), bool)
        start = _starts(w, width)
        if len(start) and len(key):
            name, own_check = Names(w, name_levels).of(start, width)
            at, to = np.searchsorted(key, name, "left"), np.searchsorted(key, name, "right")
            here = np.flatnonzero(at < to)
            at, to, owner = at[here], to[here], ids[np.searchsorted(w.first, start[here], "right") - 1]
            hit = np.zeros(len(here), bool)
            for k in range(int((to - at).max()) if len(here) else 0):
                i = np.minimum(at + k, len(key) - 1)
                hit |= (at + k < to) & (check[i] == own_check[here]) & (owner > least[i])
            gone = _text.covered(len(w), start[here[hit]], width)
        yield data, offsets, w, gone


def removed(docs: DataFrame, width: int = 13, name_levels: int = NAME_LEVELS, **parameters) -> DataFrame:
    """Operator 1: of every document doc_id, n_words, n_removed and kept (what is left of the text, joined by single spaces)."""
    docs = docs.select("doc_id", "text")
    texts, gone = repeats(docs, width, name_levels=name_levels, **parameters)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(home: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        counts, losses, kept = [], [], []
        for data, _, w, lost in _keep_words(own, found, width, name_levels):
            raw = data.tobytes()
            losses.append(np.diff(np.concatenate(([0], np.cumsum(lost)))[w.first]))
            counts.append(np.diff(w.first))
            words = np.array([raw[a:b] for a, b in zip(w.start[~lost].tolist(), w.end[~lost].tolist())], object)
            left = np.concatenate(([0], np.cumsum(~lost)))[w.first].tolist()
            kept += [b" ".join(words[a:b]).decode() for a, b in zip(left[:-1], left[1:])]
        ids = pa.chunked_array([x.field("doc_id") for x in own["row"].chunks], type=own.schema.field("row").type.field("doc_id").type)
        return pa.table([ids, pa.array(_joined(counts, "<i8")), pa.array(_joined(losses, "<i8")), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return texts.groupBy("home").cogroup(gone.groupBy("home")).applyInArrow(_whole(finish), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def remove_repeats(docs: DataFrame, width: int = 13, name_levels: int = NAME_LEVELS, **parameters) -> DataFrame:
    """docs with the repeated passages cut out of text and n_chars counted anew. Texts that lose nothing stay as they are; one that loses all words is empty."""
    texts, gone = repeats(docs, width, name_levels=name_levels, **parameters)
    names = docs.columns

    def finish(home: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        kind = own.schema.field("row").type
        out = pa.Table.from_batches([pa.RecordBatch.from_arrays(x.flatten(), names) for x in own["row"].chunks], pa.schema([pa.field(n, kind.field(n).type) for n in names]))
        given, result = out["text"].to_pylist(), []
        for data, offsets, w, lost in _keep_words(own, found, width, name_levels):
            n_lost, n_words = np.diff(np.concatenate(([0], np.cumsum(lost)))[w.first]), np.diff(w.first)
            raw = data.tobytes()
            for r in range(len(offsets) - 1):
                if not n_lost[r] or n_lost[r] == n_words[r]:
                    result.append("" if n_lost[r] else given[len(result)])
                    continue
                # ranges of removed words go, with the white space behind them
                a, b = int(w.first[r]), int(w.first[r + 1])
                parts, at = [], int(offsets[r])
                edges = np.flatnonzero(np.diff(np.concatenate(([False], lost[a:b], [False])).astype(np.int8)))
                for x, y in edges.reshape(-1, 2).tolist():
                    parts.append(raw[at : int(w.start[a + x])])
                    at = int(w.start[a + y]) if a + y < b else int(w.end[b - 1])
                parts.append(raw[at : int(offsets[r + 1])])
                result.append(b"".join(parts).decode())
        out = out.set_column(names.index("text"), "text", pa.array(result, out.schema.field("text").type))
        if "n_chars" in names:
            out = out.set_column(names.index("n_chars"), "n_chars", pa.array([None if x is None else len(x) for x in result], pa.int64()).cast(out.schema.field("n_chars").type))
        return out

    return texts.groupBy("home").cogroup(gone.groupBy("home")).applyInArrow(_whole(finish), docs.schema)

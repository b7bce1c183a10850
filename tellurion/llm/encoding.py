"""Exact encoding with a public tokenizers file, by tables of words and of content-defined chunks.

Operator 10. A text is cut where a rolling hash of 16 bytes has its low bits zero, so equal passages are cut alike in
whichever document they stand. The inside of a chunk, between its first and its last white space, is encoded once
and reused wherever the chunk returns; what touches a join is re-encoded as whole words, which is where both sides agree
exactly: with this tokenizer no merge, match of its pattern, composition or case rule reaches across ASCII white space.
A tokenizers file of another make has no such guarantee; its texts go to the library whole.

Words and chunks are known by two independent 64-bit hashes of their bytes, both of which must agree.

Null texts count as empty; empty texts give no ids. Repeated rows are encoded alike. Columns other than the named ones are
not looked at. The tables of a Python worker hold about MOST_WORDS words, MOST_CHUNKS chunks and MOST_IDS ids each, then start anew.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.llm import _text

MOST_WORDS, MOST_CHUNKS, MOST_IDS, MOST_PIECES = 1 << 20, 1 << 17, 4 << 20, 300_000
#: Bytes that decide a cut, and the logarithm of a chunk's mean length.
ROLLING, CHUNK_BITS = 16, 7
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)
GROUP = 2 << 20
PLAIN = regex.compile(r"[\n\x21-\x7e¡-ɏ]*")
MERGE_BITS, NEVER, GOLDEN = 18, 2**31 - 1, np.uint64(0x9E3779B97F4A7C15)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each row's start, and where the ROLLING bytes before, of the same row, say so."""
    found = [offsets[:-1]]
    for at in range(0, len(data), _text.SEGMENT):
        h = GEAR[data[max(0, at - ROLLING + 1) : at + _text.SEGMENT]]
        width = 1
        while width < ROLLING:
            h = h[width:] + (h[:-width] << np.uint64(width)) if len(h) > width else h[:0]
            width *= 2
        edge = np.flatnonzero(h >> np.uint64(64 - CHUNK_BITS) == 0) + max(0, at - ROLLING + 1) + ROLLING
        found.append(edge[edge - offsets[np.searchsorted(offsets, edge, "right") - 1] >= ROLLING])
    begin = np.unique(np.concatenate(found))
    return begin[begin < len(data)]


class Table:
    """From pairs of 64-bit keys to runs of ids. Open addressing, looked up by whole arrays."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.bits, self.count, self.n_ids = 16, 0, 0
        self._slots()
        self.offset, self.length, self.ids = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32), np.zeros(1 << 16, np.uint32)

    def _slots(self) -> None:
        self.key, self.check, self.value = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The entry of each pair, -1 where there is none."""
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.value[slot]
        rest = np.flatnonzero((out >= 0) & ((self.key[slot] != keys) | (self.check[slot] != checks)))
        while len(rest):
            at = (slot[rest] + 1) & mask
            slot[rest] = at
            out[rest] = v = self.value[at]
            rest = rest[(v >= 0) & ((self.key[at] != keys[rest]) | (self.check[at] != checks[rest]))]
        return out

    def _place(self, keys: np.ndarray, checks: np.ndarray, entries: np.ndarray) -> None:
        """Pairs differ from each other and from those that are there."""
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(slot):
            free = self.value[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            own = np.flatnonzero(free)[one]
            self.key[slot[own]], self.check[slot[own]], self.value[slot[own]] = keys[own], checks[own], entries[own]
            left = np.ones(len(slot), bool)
            left[own] = False
            keys, checks, entries, slot = keys[left], checks[left], entries[left], (slot[left] + 1) & mask

    def add(self, keys: np.ndarray, checks: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """New pairs, each once, with their runs one behind the other."""
        n, total = len(keys), len(ids)
        entries = np.arange(self.count, self.count + n, dtype=np.int32)
        while self.count + n > len(self.offset):
            self.offset, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.offset, self.length))
        while self.n_ids + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.length[entries] = lengths
        self.offset[entries] = self.n_ids + np.cumsum(lengths) - lengths
        self.ids[self.n_ids : self.n_ids + total] = ids
        self.n_ids += total
        self.count += n
        if 2 * self.count > len(self.key):
            there = self.value >= 0
            held, known, checked = self.value[there], self.key[there], self.check[there]
            while 2 * self.count > 1 << self.bits:
                self.bits += 1
            self._slots()
            self._place(known, checked, held)
        if n:
            self._place(keys, checks, entries)

    def runs(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries one behind the other, and how many each has."""
        lengths = self.length[entries].astype(np.int64)
        total = np.cumsum(lengths)
        shift = self.offset[entries] - (total - lengths)
        n = int(total[-1]) if len(total) else 0
        return self.ids[np.repeat(shift, lengths) + np.arange(n)], lengths


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        split = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_words = (
            spec["model"]["type"] == "BPE" and len(split) == 1 and split[0]["pattern"].get("Regex") == PATTERN and kinds == ["NFC", "Replace", "Lowercase"]
            and spec["model"].get("dropout") is None and all(not x["lstrip"] and not x["rstrip"] and not any(c.isspace() for c in x["content"]) for x in spec["added_tokens"])
        )
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.pattern, self.letters = regex.compile("\\n|" + PATTERN), byte_letters()
        self.table, self.chunks = Table(), Table()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.token[i] = token
        self.joins_by_space = spec["decoder"] is None
        if self.by_words:
            self._merges(spec)

    def fresh_pieces(self, pieces: list[str]) -> None:
        """Encodes pieces that the cache lacks: all at once, a merge in each a round, the lowest rank first, leftmost first."""
        pieces.sort(key=len)
        for i in range(0, len(pieces), 16_384):
            part = pieces[i : i + 16_384]
            raw = [x.encode() for x in part]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            wide, n = int(sizes.max()), len(raw)
            if wide > 96:
                found = [[t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in r]))] for r in raw]
                ids, lengths = np.fromiter((t for x in found for t in x), np.uint32), np.fromiter(map(len, found), np.int32, n)
            else:
                # a row for each piece: its symbols, the rank of each with the next one, and links past the symbols merged away
                symbol = np.full((n, wide + 1), -1, np.int32)
                flat = np.frombuffer(b"".join(raw), np.uint8)
                symbol[:, :wide][np.arange(wide) < sizes[:, None]] = self.first_id[flat]
                symbol[np.arange(n), sizes - 1] = self.last_id[flat[np.cumsum(sizes) - 1]]
                rank = np.full((n, wide + 1), NEVER, np.int32)
                rank[:, :wide] = self.merge(symbol[:, :-1], symbol[:, 1:])
                follows = np.tile(np.arange(1, wide + 2, dtype=np.int16), (n, 1))
                before = np.tile(np.arange(-1, wide, dtype=np.int16), (n, 1))
                live = np.arange(n)
                while len(live):
                    at = rank[live].argmin(1)
                    r = rank[live, at]
                    go = r < NEVER
                    live, at, r = live[go], at[go], r[go]
                    right = follows[live, at]
                    merged = self.merged[r]
                    symbol[live, at], symbol[live, right], rank[live, right] = merged, -1, NEVER
                    follows[live, at] = beyond = follows[live, right]
                    before[live, beyond] = at
                    rank[live, at] = self.merge(merged, symbol[live, beyond])
                    left = before[live, at]
                    some = left >= 0
                    rows, left = live[some], left[some]
                    rank[rows, left] = self.merge(symbol[rows, left], merged[some])
                kept = symbol >= 0
                ids, lengths = symbol[kept].astype(np.uint32), kept.sum(1, dtype=np.int32)
            first = len(self.piece_offset)
            self.pieces.update(zip(part, range(first, first + n)))
            self.piece_offset = np.concatenate((self.piece_offset, self.piece_offset[-1] + self.piece_length[-1] + np.cumsum(lengths) - lengths))
            self.piece_length = np.concatenate((self.piece_length, lengths))
            self.piece_ids = np.concatenate((self.piece_ids, ids))

    def no_pieces(self) -> None:
        """Entry 0 is the line break between words, which has no ids."""
        self.pieces = {"\n": 0}
        self.piece_offset, self.piece_length, self.piece_ids = np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(0, np.uint32)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER where there is none."""
        key = left.astype(np.int64) * len(self.token) + right
        slot = ((key.astype(np.uint64) * GOLDEN) >> np.uint64(64 - MERGE_BITS)).astype(np.int64)
        found = self.merge_value[slot]
        rest = np.flatnonzero(((found < NEVER) & (self.merge_key[slot] != key)).ravel())
        flat_slot, flat_key, flat = slot.ravel(), key.ravel(), found.ravel()
        while len(rest):
            flat_slot[rest] = at = (flat_slot[rest] + 1) & ((1 << MERGE_BITS) - 1)
            flat[rest] = v = self.merge_value[at]
            rest = rest[(v < NEVER) & (self.merge_key[at] != flat_key[rest])]
        found = flat.reshape(key.shape)
        found[(left < 0) | (right < 0)] = NEVER
        return found

    def _merges(self, spec: dict) -> None:
        vocabulary = spec["model"]["vocab"]
        self.first_id = np.array([vocabulary[x] for x in self.letters], np.int32)
        self.last_id = np.array([vocabulary[x + "</w>"] for x in self.letters], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocabulary[a] * len(self.token) + vocabulary[b] for a, b in pairs])
        self.merge_key, self.merge_value = np.zeros(1 << MERGE_BITS, np.int64), np.full(1 << MERGE_BITS, NEVER, np.int32)
        slots = ((keys.astype(np.uint64) * GOLDEN) >> np.uint64(64 - MERGE_BITS)).tolist()
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots)):
            while self.merge_value[slot] < NEVER:
                slot = (slot + 1) & ((1 << MERGE_BITS) - 1)
            self.merge_key[slot], self.merge_value[slot] = key, rank
        self.no_pieces()

    def words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without ASCII white space one behind the other, and how many each has."""
        text = b"\n".join(raw).decode()
        odd: dict[int, list[int]] = {}
        if not PLAIN.fullmatch(text) or any(x in text for x in self.special):
            each = text.split("\n")
            odd = {i: self.tokenizer.encode(x, add_special_tokens=False).ids for i, x in enumerate(each) if not PLAIN.fullmatch(x) or any(y in x for y in self.special)}
            text = "\n".join("" if i in odd else x for i, x in enumerate(each))
        pieces = self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        new = set(pieces) - self.pieces.keys()
        if new:
            if len(self.pieces) + len(new) > MOST_PIECES:
                self.no_pieces()
                new = set(pieces) - self.pieces.keys()
            self.fresh_pieces(list(new))
        entry = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        lengths = self.piece_length[entry].astype(np.int64)
        total = np.cumsum(lengths)
        shift = np.repeat(self.piece_offset[entry] - (total - lengths), lengths)
        ids = self.piece_ids[shift + np.arange(len(shift))]
        bounds = np.concatenate(([0], np.concatenate(([0], total))[np.flatnonzero(entry == 0)], total[-1:] if len(total) else [0]))
        counts = np.diff(bounds)
        if odd:
            runs = [odd.get(i, run) for i, run in enumerate(np.split(ids, bounds[1:-1]))]
            counts = np.fromiter(map(len, runs), np.int64, len(runs))
            ids = np.concatenate([np.asarray(x, np.uint32) for x in runs])
        return ids, counts

    def entries(self, data: np.ndarray, w: _text.Words, take: np.ndarray | None = None) -> np.ndarray:
        """The table's entry of each word; those that are new are encoded, each once."""
        start, end, key, check = (w.start, w.end, w.hash, w.check) if take is None else (w.start[take], w.end[take], w.hash[take], w.check[take])
        out = self.table.find(key, check)
        new = np.flatnonzero(out < 0)
        if len(new):
            one = new[once(key[new], check[new])]
            all_bytes = data.tobytes()
            ids, lengths = self.words([all_bytes[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())])
            self.table.add(key[one], check[one], lengths, ids)
            out[new] = self.table.find(key[new], check[new])
        return out

    def _room(self) -> None:
        for table, most in ((self.table, MOST_WORDS), (self.chunks, MOST_CHUNKS)):
            if table.count > most or table.n_ids > MOST_IDS:
                table.clear()

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        found = self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], add_special_tokens=False)
        counts = np.concatenate(([0], np.cumsum([len(x.ids) for x in found]))).astype(np.int64)
        return np.fromiter((i for x in found for i in x.ids), np.uint32), counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows one behind the other, and n + 1 offsets. By the table of words."""
        if not self.by_words:
            return self.whole(data, offsets)
        self._room()
        w = _text.words(data, offsets, True)
        ids, lengths = self.table.runs(self.entries(data, w))
        return ids, np.concatenate(([0], np.cumsum(lengths)))[w.first]

    def encode_chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same ids, by chunks that documents share."""
        if not self.by_words:
            return self.whole(data, offsets)
        self._room()
        w = _text.words(data, offsets, True)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        begin = cuts(data, offsets)
        end = np.append(begin[1:], len(data))
        raw = data.tobytes()
        content = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        key = np.fromiter(map(xxhash.xxh64_intdigest, content), np.uint64, len(content))
        check = np.fromiter(map(xxhash.xxh3_64_intdigest, content), np.uint64, len(content))
        lies = np.searchsorted(begin, w.start, "right") - 1
        inner = (w.start > begin[lies]) & (w.end < end[lies])
        known = self.chunks.find(key, check)
        new = np.flatnonzero(known < 0)
        if len(new):
            one = np.sort(new[once(key[new], check[new])])
            owner = np.full(len(begin), -1)
            owner[one] = np.arange(len(one))
            mine = np.flatnonzero(inner & (owner[lies] >= 0))
            ids, lengths = self.table.runs(self.entries(data, w, mine))
            sizes = np.bincount(owner[lies[mine]], lengths, len(one)).astype(np.int64)
            self.chunks.add(key[one], check[one], sizes.astype(np.int32), ids)
            known[new] = self.chunks.find(key[new], check[new])
        joins = np.flatnonzero(~inner)
        # the runs of chunks and of the words at joins, in the order of the text: a chunk's inside goes where its first inner word stands
        inside = np.flatnonzero(inner)
        place = begin.copy()
        place[lies[inside][::-1]] = w.start[inside][::-1]
        filled = np.flatnonzero(self.chunks.length[known] > 0)
        chunk_ids, chunk_lengths = self.chunks.runs(known[filled])
        word_ids, word_lengths = self.table.runs(self.entries(data, w, joins))
        place = np.concatenate((place[filled], w.start[joins]))
        order = np.argsort(place, kind="stable")
        lengths = np.concatenate((chunk_lengths, word_lengths))
        begun = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        total = np.cumsum(lengths)
        ids = np.concatenate((chunk_ids, word_ids))[np.repeat(begun - (total - lengths), lengths) + np.arange(int(total[-1]) if len(total) else 0)]
        return ids, np.concatenate(([0], total))[np.searchsorted(place[order], offsets, "left")]

    def decode(self, ids: list[int]) -> str:
        if not self.joins_by_space:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.token.__getitem__, ids))


def once(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The first place of each pair."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    return order[np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))]


_encoders: dict[str, Encoder] = _text.kept("encoding")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(path: str, batches: Iterator[pa.RecordBatch], text: str, chunks: bool = False, group: int = GROUP) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, each with its ids and their offsets."""
    tool = encoder(path)
    for batch in batches:
        data, offsets = _text.buffers(batch.column(batch.schema.get_field_index(text)))
        for i, j in _text.groups(offsets, group):
            part = offsets[i : j + 1]
            ids, counts = (tool.encode_chunks if chunks else tool.encode)(data[part[0] : part[-1]], part - part[0])
            yield batch.slice(i, j - i), ids, counts


def encode_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each of docs: its id, n_tokens, the ids (little-endian unsigned 32 bit) and what they decode to.

    with_ids=False leaves out ids and decoded and gives their SHA-256 alone, so that neither leaves its worker.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "ids binary, decoded string" if with_ids else "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for rows, ids, counts in encoded(tokenizer, batches, "text", chunks=True):
            ids = ids.astype("<u4")
            raw, plain = ids.tobytes(), ids.tolist()
            bounds = counts.tolist()
            texts = [tool.decode(plain[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            runs = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:])]
            if not with_ids:
                runs = [hashlib.sha256(x).hexdigest() for x in runs]
                texts = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
            names = ["doc_id", "n_tokens", *(x.split()[0] for x in rest.split(", "))]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(counts), pa.int64()), pa.array(runs, pa.binary() if with_ids else pa.string()), pa.array(texts, pa.string())], names)

    return docs.mapInArrow(_text.tidy(run, "encoding"), f"doc_id {kind}, n_tokens bigint, {rest}")

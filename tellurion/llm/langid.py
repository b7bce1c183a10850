"""Language identification by prediction by partial matching. Operator 9.

For each language a tree of byte contexts up to order 3 is counted from a bounded sample. A byte's code length in a context is that
of its share there; where the context never had the byte, that of an escape (method C: as likely as the context has
different bytes), then its length in the next shorter context; at the end all 256 bytes are equally likely. The statistics are
frozen, so the length of a byte depends on it and three bytes before alone: a worker keeps the lengths of the sequences of four that it
met and a text costs a look-up a byte and language. The language that codes the text shortest is predicted.

Bytes are folded first: A-Z and the Latin-1 capitals to lower case, digits to 0, white space to one blank, other ASCII marks to one.

Learnt are rows with a language, text and crc32(doc_id as text) mod 5 not 0 alone: of every language at most SAMPLE rows, whole, until they reach its share of
SAMPLE_BYTES (LANGUAGE_BYTES at most); the first row of a language counts even if it is longer. Text that is null or has no letter is `und` with score 0; so is every text if there is nothing to learn from. A null doc_id is
not held out and not learnt from. Ties go to the language that is first by name. Repeated rows get equal results. Further columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.llm import _sample, _text

ORDER, BITS = 3, 8
SAMPLE, SAMPLE_BYTES, LANGUAGE_BYTES = 300, 96 << 20, 1 << 20
#: Lengths that a worker keeps, of all languages together; with more it starts anew.
MOST_LENGTHS = 8 << 20
#: Bits of difference that count as one when the score is formed: neighbouring bytes don't err independently.
TEMPER = 8.0

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48
for _c in range(128):
    if _text.SPACE[_c]:
        FOLD[_c] = 32
    elif not (48 <= _c < 58 or 97 <= FOLD[_c] < 123):
        FOLD[_c] = 46
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def folded(data: np.ndarray) -> np.ndarray:
    out = FOLD[data]
    if len(data) > 1:
        after = data[:-1] == 0xC3
        out[1:][after & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32
    return out


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with ORDER blanks before each row, and where the rows with their blanks begin."""
    n = len(offsets) - 1
    begin = offsets + ORDER * np.arange(n + 1)
    out = np.full(len(data) + ORDER * n, 32, np.uint8)
    inside = np.ones(len(out), bool)
    for k in range(ORDER):
        inside[begin[:-1] + k] = False
    out[inside] = folded(data)
    return out, begin


class Model:
    """Frozen statistics. `counts[language][k]`: codes of k + 1 bytes, sorted, and how often each occurred."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        self.counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for language in self.languages:
            own = texts[language]
            d, begin = padded(np.frombuffer(b"".join(own), np.uint8), np.concatenate(([0], np.cumsum([len(y) for y in own]))).astype(np.int64))
            inside = np.ones(len(d), bool)
            for k in range(ORDER):
                inside[begin[:-1] + k] = False
            code, n = np.unique(codes(d)[inside], return_counts=True)
            found = [(code, n)]
            for k in range(ORDER - 1, -1, -1):
                code = code & np.uint32((1 << BITS * (k + 1)) - 1)
                code, place = np.unique(code, return_inverse=True)
                n = np.bincount(place, n).astype(np.int64)
                found.insert(0, (code, n))
            self.counts[language] = found
        self.key = hashlib.sha1(repr(self.languages).encode() + b"".join(x.tobytes() + n.tobytes() for c in self.counts.values() for x, n in c)).hexdigest()

    def lengths(self, wanted: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code, by language."""
        out = np.empty((len(self.languages), len(wanted)), np.float64)
        for row, language in zip(out, self.languages):
            at = np.ones(len(wanted), bool)  # not coded yet
            cost = np.zeros(len(wanted))
            for k in range(ORDER, -1, -1):
                seen, n = self.counts[language][k]
                contexts, first = np.unique(seen >> np.uint32(BITS), return_index=True)
                total, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(seen)))
                code = wanted & np.uint32((1 << BITS * (k + 1)) - 1)
                i = np.minimum(np.searchsorted(contexts, code >> np.uint32(BITS)), len(contexts) - 1)
                there = contexts[i] == code >> np.uint32(BITS)
                j = np.minimum(np.searchsorted(seen, code), len(seen) - 1)
                hit = there & (seen[j] == code) & at
                row[hit] = cost[hit] + np.log2(total[i[hit]] + kinds[i[hit]]) - np.log2(n[j[hit]])
                at &= ~hit
                miss = at & there
                cost[miss] += np.log2(total[i[miss]] + kinds[i[miss]]) - np.log2(kinds[i[miss]])
            row[at] = cost[at] + 8.0
        return out


def codes(d: np.ndarray) -> np.ndarray:
    """The byte in the lowest bits, above it the bytes before."""
    c = d.astype(np.uint32)
    code = c.copy()
    for k in range(1, ORDER + 1):
        code[k:] |= c[:-k] << np.uint32(BITS * k)
    return code


class Table:
    """A worker's lengths of the sequences that it met. Open addressing, looked up by whole arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.most = max(1 << 10, MOST_LENGTHS // len(model.languages))
        self.clear()

    def clear(self) -> None:
        self.bits, self.count = 16, 0
        self._slots()
        self.known = np.zeros(0, np.uint32)
        self.length = np.zeros((len(self.model.languages), 0), np.float32)

    def _slots(self) -> None:
        self.slot = np.full(1 << self.bits, -1, np.int32)

    def _first(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, code: np.ndarray) -> np.ndarray:
        if not self.count:
            return np.full(len(code), -1, np.int32)
        at = self._first(code)
        out = self.slot[at]
        rest = np.flatnonzero((out >= 0) & (self.known[out] != code))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            out[rest] = v = self.slot[at[rest]]
            rest = rest[(v >= 0) & (self.known[v] != code[rest])]
        return out

    def _place(self, code: np.ndarray, entry: np.ndarray) -> None:
        at = self._first(code)
        while len(at):
            free = self.slot[at] < 0
            _, one = np.unique(at[free], return_index=True)
            own = np.flatnonzero(free)[one]
            self.slot[at[own]] = entry[own]
            left = np.ones(len(at), bool)
            left[own] = False
            code, entry, at = code[left], entry[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def add(self, new: np.ndarray) -> None:
        """Codes that are not known, each once."""
        entry = np.arange(self.count, self.count + len(new), dtype=np.int32)
        self.known = np.concatenate((self.known, new))
        self.length = np.concatenate((self.length, self.model.lengths(new).astype(np.float32)), 1)
        self.count += len(new)
        if 2 * self.count > len(self.slot):
            while 2 * self.count > 1 << self.bits:
                self.bits += 1
            self._slots()
            new, entry = self.known, np.arange(self.count, dtype=np.int32)
        self._place(new, entry)

    def bits_of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row by language. Texts are taken in stretches, so that few languages or many need the same memory."""
        d, begin = padded(data, offsets)
        code = codes(d)
        real = np.ones(len(d), bool)
        real[(begin[:-1, None] + np.arange(ORDER)).ravel()] = False
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
        out = np.zeros((len(self.model.languages), len(offsets) - 1))
        step = max(1 << 10, min(1 << 20, self.most // 2))
        for a in range(0, len(d), step):
            own = np.flatnonzero(real[a : a + step]) + a
            part = code[own]
            place = self.find(part)
            new = np.unique(part[place < 0])
            if len(new):
                if self.count + len(new) > self.most:
                    self.clear()
                    new = np.unique(part)
                self.add(new)
                place = self.find(part)
            for total, length in zip(out, self.length):
                total += np.bincount(row[own], length[place], len(total))
        return out


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learns every language; what comes to the driver is sample_bytes at most, and the end of each language's last text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_sample.remainder(F.col("doc_id"), 5) != 0)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    drawn, n = _sample.sample(known, "lang", F.xxhash64("doc_id", "text"), sample)
    if not n:
        return None
    rows = _sample.within(drawn, "lang", [F.xxhash64("doc_id", F.lit("order")), F.xxhash64("text")], sample, min(LANGUAGE_BYTES, sample_bytes // n)).select("doc_id", "lang", "text").collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    texts = {k: v for k, v in texts.items() if any(v)}
    return Model(texts) if texts else None


_tables: dict[str, Table] = _text.kept("langid")


def _table(model: Model) -> Table:
    if model.key not in _tables:
        _tables.clear()
        _tables[model.key] = Table(model)
    return _tables[model.key]


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode())


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Operator 9: doc_id, held_out, lang_pred, score of every document. score: the language's share of 2 ** -(code length / TEMPER)."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))  # statistics of the bounded sample
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.buffers(batch.column(1))
            for i, j in _text.groups(offsets, 1 << 20):
                n = j - i
                best, score = ["und"] * n, np.zeros(n)
                if sent.value is not None:
                    part = offsets[i : j + 1] - offsets[i]
                    own = data[offsets[i] : offsets[j]]
                    bits = _table(sent.value).bits_of(own, part)
                    share = np.exp2(-(bits - bits.min(0)) / TEMPER)
                    pick = bits.argmin(0)
                    plain = np.diff(np.concatenate(([0], np.cumsum(LETTER[own])))[part]) > 0
                    for k in np.flatnonzero(~plain).tolist():
                        plain[k] = has_letter(own[part[k] : part[k + 1]].tobytes())
                    score = np.where(plain, 1 / share.sum(0), 0.0)
                    best = [sent.value.languages[p] if ok else "und" for p, ok in zip(pick.tolist(), plain.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    held_out = F.coalesce(_sample.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    found = docs.select("doc_id", "text").mapInArrow(_text.tidy(run, "langid"), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

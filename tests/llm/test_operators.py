"""The operators against brute force, over a small fixture of the cases that are easy to get wrong."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tellurion.llm import _spark, chat, classifier, encoding, langid, packing, plans, rules, simhash, sketch, substring

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")
PASSAGE = " ".join(f"w{i}" for i in range(40))
TEXTS = [
    "The quick brown fox jumps over the lazy dog. " * 3, PASSAGE, "before " + PASSAGE + " after", "x " * 60, "ab " * 30 + "c", None, "", "   ", "one", "don't İstanbul ΑΣ <|endoftext|>x ﬁ é ́a 日本 ½²ª x\x1cy z",
    "a b c d e f g h i j k l m n o p", "Z a b c d e f g h i j k l m n o p q", "line one is here\nline one is here\nother line", "### $$$ a|b <c> #", " ".join(f"word{i % 7} item{i}" for i in range(4000)), PASSAGE,
]


@pytest.fixture(scope="module")
def docs(spark):
    """With ties, a repeated row, a missing id and a column whose name clashes with the operators' own."""
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", None][i % 2], len(t or ""), "x") for i, t in enumerate(TEXTS)]
    rows += [rows[1], (None, PASSAGE, "en", "s0", 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string").repartition(3)


def empty(docs):
    return docs.where("false")


def words(text):
    return WORD.findall(text or "")


def test_encoding_is_the_library_s(docs):
    tool = Tokenizer.from_file(TOKENIZER)
    found = encoding.encode_documents(docs, TOKENIZER).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(found) == len(TEXTS) + 1  # the repeated row
    for r in found:
        want = tool.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == tool.decode(want, skip_special_tokens=False)
    assert encoding.encode_documents(empty(docs), TOKENIZER).count() == 0


def brute_repeats(rows, width=13):
    split = [(i if i is not None else 1 << 62, words(t)) for i, t in rows]
    least = {}
    for i, w in split:
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            least[key] = min(least.get(key, 1 << 63), i)
    out = []
    for i, w in split:
        gone = {k for j in range(len(w) - width + 1) if least[tuple(w[j : j + width])] < i for k in range(j, j + width)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_substring_dedup(spark, docs):
    def shown(df):
        return sorted((r.doc_id if r.doc_id is not None else 1 << 62, r.n_words, r.n_removed, r.kept) for r in substring.removed(df).collect())

    assert shown(docs) == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    draw = np.random.default_rng(5)
    rows = [(int(draw.integers(0, 150)), " ".join(draw.choice(list("abcd"[: draw.integers(1, 5)]), draw.integers(0, 70)))) for _ in range(200)]
    assert shown(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)
    assert substring.removed(empty(docs)).count() == 0
    cut = substring.remove_repeats(docs)
    assert cut.columns == docs.columns
    for r in cut.collect():
        if r.doc_id == 2:
            assert r.text == "before after" and r.n_chars == 12
        if r.doc_id == 0:
            assert r.text == TEXTS[0]


def test_quality_rules(docs):
    found = rules.quality_rules(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        text = next((t for i, t in enumerate(TEXTS) if i == r.doc_id), PASSAGE) or ""
        w = words(text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert rules.quality_rules(empty(docs)).count() == 0 and rules.filter_documents(docs).columns == docs.columns


def test_quality_rules_reject_what_stands_out(spark):
    fine = [(i, "en", " ".join(f"common{(i * 7 + k) % 97} words{k}" for k in range(40)) + ".") for i in range(300)]
    junk = [(1000 + i, "en", " ".join(f"a{k}### b{i}$$$" for k in range(40))) for i in range(20)]
    df = spark.createDataFrame(fine + junk, "doc_id long, lang string, text string").withColumn("source", F.lit("s"))
    kept = {r.doc_id for r in rules.quality_rules(df).where("kept").collect()}
    assert kept == {i for i, _, _ in fine}


def test_simhash_groups(spark, docs):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 40, dtype=np.uint64)
    prints = [int(x) for x in base] + [int(x) ^ (1 << int(draw.integers(64))) ^ (1 << int(draw.integers(64))) for x in np.repeat(base, 4)] + [0, 3, 15, 63]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    found = {r.doc_id: r.component_id for r in simhash.near_groups(_spark.cut(spark.createDataFrame(rows, "doc_id long, fp long")), 2).collect()}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert found == {i: root(i) for i in range(len(prints))}
    by_id = simhash.near_duplicates(docs).collect()
    assert len(by_id) == docs.count() and {r.fp for r in by_id if r.doc_id in (5, 6, 7)} == {0}
    assert {r.component_id for r in by_id if r.doc_id in (1, 15, None)} == {1}
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_a_long_chain_is_one_component(spark):
    n = 200
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(range(n), range(1, n))], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_near_copies(spark):
    draw = np.random.default_rng(1)
    texts = []
    for _ in range(12):
        w = [f"t{x}" for x in draw.integers(0, 5000, 300)]
        texts += [" ".join(w), " ".join([*w[:150], "changed", *w[151:]]), " ".join([*w[:-3], "other", "end"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == list(range(0, 36, 3))


def check_packed(rows, capacity):
    where = {}
    for r in rows:
        where.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in where.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(where)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(docs, capacity):
    tool = Tokenizer.from_file(TOKENIZER)
    coded = {i: [*tool.encode(t or "", add_special_tokens=False).ids, 0] for i, t in [*enumerate(TEXTS), (None, PASSAGE)]}
    found = packing.pack_by_configurations(docs, TOKENIZER, capacity).collect()
    total = 0
    for r in found:
        ids = coded[r.doc_id]
        total += r.length
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.start == r.piece * capacity
    assert check_packed(found, capacity) <= -(-total // capacity) + 1
    matrices = packing.pack_matrices(docs, TOKENIZER, capacity).collect()
    assert sum(m.n_tokens for m in matrices) == total
    for m in matrices:
        ids = np.frombuffer(m["ids"], "<u4")
        assert len(ids) == capacity and m.cu_seqlens[-1] == m.n_tokens and m.position_resets == m.cu_seqlens[: None if m.n_tokens < capacity else -1]
        for i, (doc, start) in enumerate(zip(m.doc_ids, m.starts)):
            a, b = m.cu_seqlens[i : i + 2]
            assert ids[a:b].tolist() == coded[doc][start : start + b - a]
    assert packing.pack_by_configurations(empty(docs), TOKENIZER).count() == 0


def test_matrices_are_written(docs, tmp_path):
    manifest = packing.write_matrices(packing.pack_matrices(docs, TOKENIZER, 64), str(tmp_path), 64).collect()
    ids = np.concatenate([np.load(m.file + ".ids.npy") for m in manifest])
    assert ids.shape == (sum(m.sequences for m in manifest), 64)


def test_best_fit_is_best_fit():
    draw = np.random.default_rng(2)
    for _ in range(50):
        capacity = int(draw.integers(5, 50))
        lengths = draw.integers(1, capacity + 1, draw.integers(1, 150)).tolist()
        free = []
        for x in sorted(lengths, reverse=True):
            fits = [(f, i) for i, f in enumerate(free) if f >= x]
            if fits:
                free[min(fits)[1]] -= x
            else:
                free.append(capacity - x)
        for plan in (plans.best_fit_decreasing(Counter(lengths), capacity), plans.configuration_lp(Counter(lengths), capacity)):
            held = Counter()
            for many, fill in plan:
                assert sum(x * k for x, k in fill) <= capacity
                for x, k in fill:
                    held[x] += many * k
            assert held == Counter(lengths)
        assert sum(m for m, _ in plans.best_fit_decreasing(Counter(lengths), capacity)) == len(free)


def test_fingerprints(docs):
    found = {r.doc_id: r for r in sketch.fingerprints(docs).collect()}
    order = [(i, t or "") for i, t in sorted(enumerate(TEXTS), reverse=True)] + [(None, PASSAGE)]
    assert len(found) == len(order)
    for k, (i, text) in enumerate(order):
        n, after = len(text) // 3, order[(k + 1) % len(order)][1]
        edited = text[: len(text) - n] + after[:n]
        assert found[i].n_chars == len(text) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
    assert found[1].fingerprint == found[15].fingerprint and found[14].near_edited > 0.4
    assert sketch.fingerprints(empty(docs)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 2, "ann", None), (2, 0, "system", "x"), (None, 0, "ann", "lost"), (3, None, None, "é"), (3, 5000, "ann", "late")]
    found = {(r.conv_id, r.part, r.perspective): r for r in chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(found) == {(1, 0, "ann"), (1, 0, "bob"), (3, 0, ""), (3, 0, "ann"), (3, 1, ""), (3, 1, "ann")}
    r = found[1, 0, "ann"]
    assert r.rendered == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|assistant|>\n<|end|>\n<|user:bob|>\nhello<|end|>\n"
    assert [r.rendered[m.start : m.end] for m in r["mask"]] == ["hi<|end|>", "<|end|>"] and (r.n_turns, r.n_learnt) == (4, 2)


def test_what_is_learnt_holds_for_what_is_held_out(spark):
    table, labels = _spark.documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.95 * len(found)
    scored = classifier.classify(table, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in scored) > 0.9 * len(scored)
    good = [r for r in scored if r.quality == 1]
    assert sum(r.predicted == 1 for r in good) > 0.95 * len(good)


def test_a_separable_sample_keeps_the_calibration_finite():
    x = np.concatenate([np.random.default_rng(0).normal(1, 0.1, (500, 3)), np.random.default_rng(1).normal(-1, 0.1, (500, 3))])
    w = classifier._logistic(x, np.array([1.0] * 500 + [0.0] * 500))
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(w).max() < 100 and (p[:500] > 0.9).all() and (p[500:] < 0.1).all()


def test_learners_meet_odd_rows(spark, docs):
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert found[5].lang_pred == found[6].lang_pred == "und" and found[5].score == 0
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.classify(docs, labels).collect()} == {0.5}
    assert langid.identify(empty(docs)).count() == 0 and classifier.classify(empty(docs), labels).count() == 0


def test_a_sample_is_drawn_without_its_texts(spark, monkeypatch):
    rows = [(i, f"{['bad', 'good'][i % 2]} text {i} " * (i % 50 + 1)) for i in range(600)]
    table = spark.createDataFrame([*rows, *rows[:40]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    seen, within = [], classifier._sample.within
    monkeypatch.setattr(classifier._sample, "within", lambda rows, *rest: seen.append(rows.columns) or within(rows, *rest))
    model = classifier.fit(table, labels, sample=100, sample_bytes=20_000)
    assert seen and all("text" not in columns for columns in seen)
    assert model == classifier.fit(table.distinct(), labels, sample=100, sample_bytes=20_000)

"""The near-dedup stage against brute force over whole shingle sets, where a wrong decision is easy."""

import numpy as np

from tellurion.llm import simhash


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def linked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}


def border(seed, n_words, n_texts, replaced, boilerplate=""):
    """Texts and, behind each, itself with one run replaced."""
    draw = np.random.default_rng(seed)
    texts = []
    for i in range(n_texts):
        w = [f"t{x}" for x in draw.integers(0, 50_000, n_words)]
        at, long = int(draw.integers(5, n_words - max(replaced) - 5)), int(draw.integers(min(replaced), max(replaced) + 1))
        other = [*w[:at], *(f"r{x}" for x in draw.integers(0, 50_000, long)), *w[at + long :]]
        texts += [" ".join(w) + boilerplate, " ".join(other) + boilerplate]
    return texts


def check(spark, texts):
    found = linked(spark, texts)
    alike = [jaccard(a, b) >= 0.8 for a, b in zip(texts[::2], texts[1::2])]
    assert 0.2 < np.mean(alike) < 0.9  # on both sides of the border
    assert [found[2 * i + 1] == 2 * i for i in range(len(alike))] == alike


def test_all_pairs_at_the_border_are_found(spark):
    shared = " " + " ".join(f"license{i}" for i in range(30))
    check(spark, border(5, 240, 150, (15, 30)) + border(6, 200, 40, (10, 30), shared))


def test_a_line_repeated_many_times_makes_no_other_set(spark):
    draw = np.random.default_rng(8)
    texts = []
    for i in range(20):
        text, line = (" ".join(f"t{x}" for x in draw.integers(0, 50_000, n)) for n in (400, 10))
        texts += [text, text + f" {line}" * 15]
    assert all(jaccard(a, b) > 0.9 for a, b in zip(texts[::2], texts[1::2]))
    found = linked(spark, texts)
    assert all(found[i + 1] == i for i in range(0, len(texts), 2))


def test_long_texts_are_decided_on_whole_sets(spark):
    check(spark, border(7, 1500, 80, (140, 180)))


def test_one_row_of_each_group_is_kept(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(None, a), (None, a + " end"), (3, b), (3, b), (3, "alone here"), (4, b + " end"), (4, "other words"), (None, None), (None, "")]
    found = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 5 and {(r.doc_id, r.text) for r in found} >= {(3, b), (3, "alone here"), (4, "other words")}


def test_long_texts_with_little_in_common_are_told_apart_without_their_sets(spark, monkeypatch):
    draw = np.random.default_rng(9)
    passages = [" ".join(f"p{x}" for x in draw.integers(0, 50_000, 30)) for _ in range(4)]
    texts = [" ".join([*(f"t{x}" for x in draw.integers(0, 50_000, 3000)), *passages]) for _ in range(30)]
    asked, sets_of = [], simhash.sets_of
    monkeypatch.setattr(simhash, "sets_of", lambda docs, marks, shingle: asked.append(marks.count()) or sets_of(docs, marks, shingle))
    assert linked(spark, texts) == {i: i for i in range(30)} and sum(asked) == 0
    asked.clear()
    assert linked(spark, [*texts, texts[3] + " and more"])[30] == 3 and 0 < sum(asked) <= 4


def test_parities_never_exceed_the_true_difference():
    draw = np.random.default_rng(10)
    for n, m, same in ((0, 5, 0), (3, 9, 2), (200, 900, 150), (1000, 1030, 900), (40_000, 70_000, 10_000)):
        both = np.unique(draw.integers(0, 2**63, n + m, dtype=np.uint64))
        a, b = both[:n], np.concatenate((both[:same], both[n:]))
        x, y = simhash.parities(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        assert simhash.least_apart(x, y) <= len(np.setxor1d(a, b)) and simhash.least_apart(x, x) == 0
        assert simhash.least_apart(x, y) == simhash.least_apart(y, x)

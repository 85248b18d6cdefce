"""Substring dedup, Jaccard join and decontamination against plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from data import SCHEMA, alnum_words, corpus, lower, space_words

from tracemill.llm import contamination, hashcount, jaccard, substring_dedup


@pytest.fixture(scope="module")
def docs(spark):
    # more columns, with the names that the operators use inside
    rows = [(*r, i, "x", b"y") for i, r in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA + ", slot int, payload string, keys binary").repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def expected_cut(rows, width):
    split = [space_words(r[1]) for r in rows]
    seen = Counter(tuple(w[i:i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for row, words in zip(rows, split, strict=True):
        cut = {j for i in range(len(words) - width + 1) if seen[tuple(words[i:i + width])] > 1 for j in range(i, i + width)}
        kept = " ".join(w for j, w in enumerate(words) if j not in cut)
        out.append((row[0], len(words), len(cut), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_substring_dedup(spark, docs):
    key = lambda r: tuple(str(x) for x in r)
    for width in (substring_dedup.WIDTH, 4):
        got = substring_dedup.remove_repeats(docs, width=width, carry=["payload", "slot"])
        assert got.columns == ["doc_id", "text", "n_words", "n_removed", "removed", "kept_sha256", "payload", "slot"]
        rows = got.collect()
        want = expected_cut(corpus(), width)
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in rows], key=key) == sorted(want, key=key)
        for r in rows:  # maximal intervals: in order, apart from each other, as many words as removed
            assert all(a[1] < b[0] for a, b in zip(r.removed, r.removed[1:], strict=False)) and sum(b - a for a, b in r.removed) == r.n_removed
        assert {r.slot for r in rows} == set(range(len(want))) and {r.payload for r in rows} == {"x"}
    assert any(w[2] for w in want)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def shingles(text):
    words = space_words(lower(text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected_components(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                label[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    return [(a, len(x), None if a is None else least[find(i)]) for i, (a, x) in enumerate(sets)]


def test_jaccard_components(spark, docs):
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(expected_components(corpus()), key=key)
    for rare in (jaccard.RARE, 2):  # with 2 nearly all shared shingles are indexed in pairs
        got = jaccard.jaccard_components(docs, rare=rare, carry=["keys"])
        rows = got.collect()
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in rows], key=key) == want
        assert all(bytes(r["keys"]) == b"y" for r in rows)
    assert len({w[2] for w in want}) < len(want) - 15
    assert jaccard.jaccard_components(empty(spark)).count() == 0


@pytest.mark.parametrize("rare", [1, 3, 64])
def test_similar_sets_share_a_key_whose_bound_holds(rare):
    rng = np.random.default_rng(rare)
    base = rng.integers(1, 1 << 62, 600).astype(np.uint64)
    frequency = {int(v): int(f) for v, f in zip(base, rng.integers(1, 9, 600), strict=True)}
    near = 0
    for _ in range(400):
        size = int(rng.integers(1, 260))
        own = rng.choice(base, size, replace=False)
        other = own[rng.random(size) < rng.choice([0.8, 0.9, 0.97])]
        x, y = np.unique(own), np.unique(np.append(other, rng.choice(base, int(rng.integers(0, 1 + size // 12)))))
        both = len(np.intersect1d(x, y))
        totals = [np.array([2 + frequency[int(v)] for v in s]) for s in (x, y)]
        with np.errstate(over="ignore"):
            (a, most_a), (b, most_b) = jaccard.prefix_keys(x, totals[0], rare=rare + 2), jaccard.prefix_keys(y, totals[1], rare=rare + 2)
        if 100 * both >= 75 * (len(x) + len(y) - both):
            near += 1
            shared, i, j = np.intersect1d(a, b, return_indices=True)
            assert len(shared) and np.minimum(most_a[i], most_b[j]).max() >= both
    assert near > 100


def test_counts_come_back_to_their_places():
    hashes = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    with np.errstate(over="ignore"):
        sent = hashcount.pack(4, hashes, np.where(np.arange(1000) % 10 == 0, 3, 1), 7, np.uint64)
    parts = [hashcount.count_range(np.uint64, True)(sent.slice(i, 1)) for i in range(sent.num_rows)]
    import pyarrow as pa

    back = hashcount.unpack(pa.concat_tables(parts), hashes, 7, totals=True)
    assert (back == np.where(np.arange(1000) % 10 == 0, 3, 1)).all()
    with pytest.raises(RuntimeError):
        hashcount.unpack(pa.concat_tables(parts[1:]), hashes, 7)


def expected_hits(rows, items, width=13):
    phrases = {}
    for item, text in items:
        words = alnum_words(text)
        k = min(width, len(words))
        if item is not None and words:
            for i in range(len(words) - k + 1):
                phrases.setdefault(tuple(words[i:i + k]), set()).add(str(item))
    sizes, out = {len(p) for p in phrases}, []
    for row in rows:
        words, hit, found = alnum_words(row[1]), set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                got = phrases.get(tuple(words[i:i + k]))
                if got:
                    hit |= set(range(i, i + k))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((row[0], len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def test_decontamination(spark, docs, monkeypatch):
    texts = {r[0]: r[1] for r in corpus()}
    items = [(1, " ".join(texts[5].split()[:40])), (10, texts[95][30:400]), (2, texts[95][30:300].upper()), (3, "one two"), (4, None), (None, "one"), (5, ""), (6, "日本語 OK"), (1, texts[204])]
    table = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(expected_hits(corpus(), items), key=key)
    got = contamination.decontaminate(docs, table, carry=["payload"])
    assert sorted([tuple(r) for r in got.select(*columns).collect()], key=key) == want
    assert {r.payload for r in got.collect()} == {"x"} and sum(w[5] for w in want) > 20
    monkeypatch.setattr(contamination, "PASS_CHARS", 300)  # several passes give the same
    assert sorted([tuple(r) for r in contamination.decontaminate(docs, table).select(*columns).collect()], key=key) == want
    assert contamination.decontaminate(empty(spark), table).count() == 0
    assert not contamination.decontaminate(docs, table.limit(0)).where("n_hit > 0 OR contaminated").count()


def test_proximity():
    lists = {7: np.array([3, 20, 40]), 8: np.array([4, 23, 60]), 9: np.array([6, 24])}
    assert list(contamination.phrase_starts(lists, [7, 8], [1, 0])) == [3]
    assert list(contamination.phrase_starts(lists, [7, 8], [0, 1], slack=2)) == [3, 20]
    assert list(contamination.phrase_starts(lists, [7, 8, 9], [2, 0, 1], slack=2)) == [4, 22] or list(contamination.phrase_starts(lists, [7, 8, 9], [0, 1, 2], slack=2)) == [3, 20]

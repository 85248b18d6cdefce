"""Cross-tokenizer alignment against whole-text encoding and pairwise comparison of byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from data import SCHEMA

from tracemill.llm import alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.TokenPair(*alignment.default_paths())


def whole(pair, text):
    """Ids of the whole text by both libraries, none where the bytes differ."""
    if not text:
        return [], []
    ids = pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text)
    same = all(b"".join(known[i] for i in own) == f" {text}".encode() for own, known in zip(ids, (pair.bytes_a, pair.bytes_b), strict=True))
    return ids if same else ([], [])


def spans(ids, known):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(known[i])))
        at += len(known[i])
    return out


def brute(pair, rows):
    linked, shown = [], []
    for _, text, *_ in rows:
        a, b = whole(pair, text)
        sa, sb = spans(a, pair.bytes_a), spans(b, pair.bytes_b)
        links, at = [], 0
        for i, (x, y) in zip(a, sa, strict=True):
            while at and sb[at][0] > x:
                at -= 1
            while at < len(b) and sb[at][1] <= x:
                at += 1
            k = at
            while k < len(b) and sb[k][0] < y:
                links.append((i, b[k]))
                k += 1
        common, groups = sorted({y for _, y in sa} & {y for _, y in sb}), []
        for ids, own in ((a, sa), (b, sb)):
            cut, cuts = [], []
            for i, (_, y) in zip(ids, own, strict=True):
                cut.append(str(i))
                if y == common[len(cuts)]:
                    cuts.append(",".join(cut))
                    cut = []
            groups.append(cuts)
        groups = ["|".join(g) for g in zip(*groups, strict=True)]
        linked.append(links)
        shown.append((len(a), len(b), groups))
    count = Counter(p for links in linked for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [
        (row[0], n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for row, links, (n_a, n_b, groups) in zip(rows, linked, shown, strict=True)
    ]


ODD = list("abcXYZ 019   \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 é日本語🎉'’.,!<>|_-\x00") + ["<|endoftext|>", "<s>", "</s>", "'s", "'re", "<0x0A>", "  ", "\n\n", "word", "The "]


def odd_texts(count, seed=2):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 30))) for _ in range(count)]
    return [t + "▁ x" if i % 20 == 0 else t for i, t in enumerate(made)] + ["", None, " ", "  ", "\n", "a ", "a  ", " a", "\n a \n", "▁", "supercalifragilistic"]


def test_parts_give_the_ids_of_whole_texts(pair):
    assert pair.by_unit
    for text in odd_texts(4000):
        found = pair.encode(list(dict.fromkeys(pair.split(text))))
        by_part = dict(zip(dict.fromkeys(pair.split(text)), found, strict=True))
        ids = [b"".join(by_part[p][k] for p in pair.split(text)) for k in (0, 1)]
        good = all(f[2] for f in found)
        assert ([np.frombuffer(x, "<u4").tolist() for x in ids] if good else [[], []]) == list(map(list, whole(pair, text))), text


def test_gallop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        long = np.unique(rng.integers(0, 400, rng.integers(1, 120)))
        short = np.sort(rng.choice(long[-1] + 1, rng.integers(1, 40)))
        begin = rng.integers(0, len(long), len(short))
        assert (alignment.gallop(short, long, begin) == np.searchsorted(long, short)).all()


def test_align_tokens(spark, pair):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(odd_texts(300))]
    rows += [(7, "the same words again", None, None, None), (7, "the same words again", None, None, None), (None, "no id here", "x", "y", 1)]
    rows += [(1000 + i, "tokens overlap here and there, unbelievably often " * (1 + i % 3), "en", "hot", 0) for i in range(60)]
    rows.append((2000, " ".join(f"Wörter{i % 997} andéquite{i}long" for i in range(20_000)), "de", "long", 0))
    docs = spark.createDataFrame([(*r, f"p{i}", b"x") for i, r in enumerate(rows)], SCHEMA + ", slot string, groups binary").repartition(5)
    got = alignment.align_tokens(docs, *alignment.default_paths(), groups=True, carry=["slot"])
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups", "slot"]
    got = {r.slot: r for r in got.collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(brute(pair, rows)):
        r = got[f"p{i}"]
        assert (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, rows[i][1]
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
    assert alignment.align_tokens(spark.createDataFrame([], SCHEMA), *alignment.default_paths()).count() == 0

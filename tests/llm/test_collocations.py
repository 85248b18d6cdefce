"""Collocations against counting in plain Python, and the paths of the graph."""

import random
import re
from collections import Counter

import pytest
from data import SCHEMA, lower

from tracemill.llm import collocations


def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["É", "日本", "x%2E", "don't"]
    made = []
    for i in range(160):
        words = [rng.choice(vocabulary[:rng.choice([8, 64])]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!? "]) for w in words)
        made.append((i, text, rng.choice(["en", "en", "de", None, "und", "a\tb.%"]), "s", 0))
    passage = " ".join(f"P{i}q{i % 7}" for i in range(90))
    made += [(1000 + i, f"{passage} end{i}; la la la la la la la la la la la la la", "en", "hot", 0) for i in range(14)]
    made += [(2000, None, "en", None, 0), (2001, "", "en", None, 0), (2002, " \n,", "fr", None, 0), (None, passage, "en", None, 0)] + [(2003, passage, "en", None, 0)] * 2
    made.append((3000, " ".join(f"long{i % 3000}" for i in range(36_000)), "es", None, 0))
    return made


def counts(data):
    found, total = Counter(), Counter()
    for _, text, lang, *_ in data:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und" if lang is None else lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    found[("und" if lang is None else lang, tuple(words[i:i + k]))] += 1
    return found, total


def expected(data, least, cover, top):
    found, total = counts(data)
    best = {}
    for (lang, words), a in found.items():
        if len(words) == 3 and a >= least:
            for part in (words[:2], words[1:]):
                best[lang, part] = max(best.get((lang, part), 0), a)
    out = {}
    for (lang, words), a in found.items():
        if len(words) < 2 or a < least or (len(words) == 2 and 100 * best.get((lang, words), 0) >= cover * a):
            continue
        cuts = [(1_000_000 * a * a // (found[lang, words[:k]] * found[lang, words[k:]]), k, found[lang, words[:k]], found[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, made in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(made)[:top], 1)
    )


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, i, "x", "y") for i, r in enumerate(rows())], SCHEMA + ", w1 int, a string, phrase string").repartition(6)


@pytest.mark.parametrize(("least", "cover", "top"), [(10, 50, 2000), (3, 80, 25), (2, 50, 2000)])
def test_collocations(docs, least, cover, top):
    got = [tuple(r) for r in collocations.collocations(docs, least, cover, top).collect()]
    want = expected(rows(), least, cover, top)
    assert sorted(got) == want and len(want) > 40


def test_paths(docs):
    edges = collocations.build_graph(docs, 10).where("kind = 'edge'").drop("kind")
    paths = collocations.unary_paths(edges).collect()
    longest = max(paths, key=lambda r: len(r.words) if r.lang == "en" else 0)
    assert list(longest.words) == [f"p{i}q{i % 7}" for i in range(90)] and longest.a == 17
    assert max(len(r.words) for r in paths if r.lang == "es") > 2900
    assert sum(len(r.words) - 2 for r in paths) == edges.count()
    found, _ = counts(rows())
    for r in paths:
        if r.lang == "en":
            assert all(found["en", tuple(r.words[i:i + 3])] == r.a for i in range(len(r.words) - 2)) and found["en", tuple(r.words[:2])] == r.first_pair


def test_no_texts(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, 0), (2, "a", None, None, 0)], SCHEMA), least=1).count() == 0

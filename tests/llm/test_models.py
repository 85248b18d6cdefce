"""Language, toxicity and quality: defined results for odd rows, and accuracy on documents that were not learned from."""

import numpy as np
import pytest
from data import LONG, SCHEMA

from tracemill.llm import langid, quality, toxicity, words

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 !?"), (5, LONG), (5, LONG), (None, "text without id"), (6, "日本語"), (7, "😀 x".encode("utf-16", "surrogatepass").decode("utf-16"))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "lang?", 0.5) for r in ODD], "doc_id long, text string, lang_pred string, score double")


def judged(spark, frame, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = frame.where("held_out").join(labels, "doc_id").select(column, "predicted").collect()
    return np.mean([r[0] == r[1] for r in rows])


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 150 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97 and all(0 <= r.score <= 1 for r in found)
    profiles = langid.learned(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, profiles).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and got[5][0] != "und" and got[6] == ("de", 0.0) and None in got
    assert langid.identify(odd, profiles, carry=["score"], keep_text=True).columns == ["doc_id", "text", "lang_pred", "score", "score"] and langid.identify(odd, profiles).count() == len(ODD)
    none = langid.learned(spark.createDataFrame([], SCHEMA))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def test_out_of_place_distance():
    symbol = langid._symbols([ord("a"), ord("b")])
    base = 4
    codes, counts = langid.ngrams(langid.letters_of("ab, AB!"), symbol, base)
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {
        1: 2, 2: 2, base + 1: 2, base + base + 2: 2, base + 2 * base: 2, base + base ** 2 + base + 2: 2, base + base ** 2 + (base + 2) * base: 2,
    }
    profiles = langid.Profiles([ord("a"), ord("b")], {"x": langid.ranked(codes, counts), "y": np.array([2, 1])})
    profiles.prepare()
    assert profiles.predict("ab") == ("x", 1.0)


def test_toxicity(spark, odd):
    found = toxicity.op5_toxicity(spark, SF)
    assert judged(spark, found, "toxic") > 0.85
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.train(docs, labels.limit(0)).scores(odd.toArrow()["text"].combine_chunks())[0] == pytest.approx(0, abs=1e-9)
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_features_count_once_and_stay_in_words():
    import pyarrow as pa

    one, two, none = toxicity.features(pa.array(["Badword", "badword badword, badword", None]))
    assert set(one) == set(two) and len(none) == 0 and len(one) == 1 + 4 + 2


def test_pu_risk_separates_what_unlabelled_text_hides():
    rng = np.random.default_rng(0)
    truth = np.concatenate([np.ones(300, bool), rng.random(2000) < 0.2])
    rows = [np.flatnonzero(np.append(rng.random(6) < (0.7 if t else 0.02), rng.random(6) < 0.4)) for t in truth]
    positive = np.arange(2300) < 300
    weights, bias = toxicity.nnpu_fit(rows, positive, 0.2, 12)
    chance = np.array([1 / (1 + np.exp(-weights[r].sum() - bias)) for r in rows])
    assert ((chance > 0.5) == truth)[300:].mean() > 0.95 and abs(chance[300:].mean() - 0.2) < 0.08


def test_quality(spark, odd):
    found = quality.op6_quality(spark, SF)
    assert judged(spark, found, "quality") > 0.9
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = quality.train(docs, labels, sample=60)
    got = quality.score(odd, network).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.train(docs, labels.limit(0)) is None and {r.score for r in quality.score(odd, None).collect()} == {0.5}


def test_responses_are_those_of_the_filters_and_cover_the_text():
    import pyarrow as pa

    network = quality.Network(seed=1, filters=3)
    network.prepare()
    data = np.frombuffer(b"some bytes \xc3\xa9 here", np.uint8)
    slow = np.array([[sum(network.filters[k, data[i + k], f] for k in range(quality.WIDTH)) for f in range(3)] for i in range(len(data) - quality.WIDTH + 1)])
    assert np.allclose(network.responses(data), slow, atol=1e-5)
    text = "plain text " * 4000
    changed = text[:30_000] + "#$%&@!" * 4 + text[30_024:]
    assert network.values(pa.array([text]))[0] != network.values(pa.array([changed]))[0]


def test_words_of_blocks_match_plain_python():
    import pyarrow as pa
    from data import alnum_words, corpus, space_words

    texts = pa.array([r[1] for r in corpus()])
    with np.errstate(over="ignore"):
        for table, plain in ((words.NOT_SPACE, space_words), (words.ALNUM, alnum_words)):
            for begin, end in words.blocks(texts, 2000):
                data, offsets = words.flat_bytes(texts[begin:end])
                starts, ends, bounds = words.spans(data, offsets, table)
                got = [[bytes(data[a:b]).decode().lower() for a, b in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                assert got == [[w.lower() for w in plain(t.as_py())] for t in texts[begin:end]]


def test_languages_of_several_scripts(spark):
    rng = np.random.default_rng(8)
    scripts = {"cyrillic-a": (0x430, 30), "cyrillic-b": (0x430, 30), "greek-a": (0x3B1, 24), "greek-b": (0x3B1, 24), "han-a": (0x4E00, 900), "han-b": (0x4E00, 900), "latin": (0x61, 26)}
    shares = {name: rng.dirichlet(np.full(n, 0.5)) for name, (_, n) in scripts.items()}

    def text(name):
        first, n = scripts[name]
        return " ".join("".join(chr(first + i) for i in rng.choice(n, rng.integers(2, 8), p=shares[name])) for _ in range(80))

    rows = [(i * 10 + k, text(name), name) for k, name in enumerate(scripts) for i in range(40)]
    profiles = langid.learn(spark.createDataFrame(rows[::2], "doc_id long, text string, lang string"))
    assert len(profiles.alphabet) > 300
    got = langid.identify(spark.createDataFrame(rows[1::2], "doc_id long, text string, lang string").drop("lang"), profiles).collect()
    want = {i: name for i, _, name in rows}
    assert sum(r.lang_pred == want[r.doc_id] for r in got) >= 0.97 * len(got)

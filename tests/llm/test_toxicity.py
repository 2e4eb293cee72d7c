import itertools
import math
import random
import zlib

import numpy as np
import pytest

from foliant.llm import toxicity as T
from foliant.llm.queries import op11_toxicity

SLURS = "moron idiot trash loser scum clown pathetic stupid worthless disgusting".split()


def plain_counts(texts):
    out = np.zeros(T.N**3, np.int64)
    for t in texts:
        s = [0]
        for c in t or "":
            x = T.CODE.get(c.lower(), T.OTHER) if c.isalpha() else 0
            if x or s[-1]:
                s.append(x)
        s += [0] if s[-1] else []
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            out[(a * T.N + b) * T.N + c] += 1
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = ["the", "of", "and", "which", "known", "well", "mail", "over", "there", "in", "it", "a", "was", "theme", "thin", "path", "stun", "mood", "pain", "lose", "tras", *SLURS]
    return [" ".join(rng.choice(words) for _ in range(60)) + "." for _ in range(300)] + ["Öl für Straße\nŁódź 日本 x1y", "", "a" * 50]


@pytest.fixture(scope="module")
def channel(texts):
    return T.Channel(T.costs(plain_counts(texts)))


def test_counts_cover_whole_texts(spark, texts):
    blocks = lambda t, n: np.bincount(np.concatenate([*T.trigrams(t, n), np.zeros(0, np.int32)]), minlength=T.N**3)
    for t in texts[-5:]:
        for n in (1, 2, 3, 7, 1000):
            assert (blocks(t, n) == plain_counts([t])).all(), (t, n)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").repartition(5)
    assert np.allclose(T.language_model(docs), T.costs(plain_counts(texts)))


def test_costs_are_probabilities(texts):
    cost = T.costs(plain_counts(texts))
    assert np.allclose(np.exp(-cost).sum(1), 1, atol=1e-4)


def test_viterbi_finds_the_least_of_all_readings(channel):
    rng = random.Random(2)
    for _ in range(300):
        span = "".join(rng.choice("aithes$10 -.!mo*") for _ in range(rng.randrange(1, 8)))
        ways = channel.lattice(span)
        if not ways:
            assert channel.decode(span) == ()
            continue
        best = {}
        for path in itertools.product(*ways, [("\0", 0.0)]):
            at, price = 0, sum(p for _, p in path)
            for x in "".join(r for r, _ in path):
                code = T.CODE[x]
                if code != T.EDGE or at % T.N != T.EDGE:
                    price += channel.cost[at][code]
                    at = at % T.N * T.N + code
            words = tuple("".join(r for r, _ in path).replace("\0", " ").split())
            best[words] = min(price, best.get(words, math.inf))
        assert best[channel.decode(span)] == pytest.approx(min(best.values())), span


@pytest.mark.parametrize("written, word", [("1d10t", "idiot"), ("$tup1d", "stupid"), ("L0$ER", "loser"), ("m0r0n!!!", "moron"), ("p.a.t.h.e.t.i.c", "pathetic"), ("traaaash", "trash"), ("ssttuuppiidd", "stupid"), ("cl0wn,", "clown"), ("###scum###", "scum"), ("m-o-r-o-n", "moron"), ("w0rthle$$", "worthless"), ("tr@sh", "trash"), ("5cum", "scum"), ("sc​um", "scum"), ("ｉｄｉｏｔ", "idiot")])
def test_disguises(channel, written, word):
    assert channel.token(written) == (word,)
    assert word in channel.words(f"the {written} was")


def test_spaced_words_and_plain_text(channel):
    assert channel.restored("it was of s t u p i d  c l o w n there") == ("it was of stupid clown there", 1)
    assert "stupid" in channel.words("of s t u p i d over") and "moron" in channel.words("m o r o n")
    text = "The well was known, over (in) the path!!\nAnd of&&& which*** it, 1999 - 2024."
    assert channel.restored(text) == (text, 0)


def test_regression_keeps_what_explains():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 6)) < 0.2
    y = x[:, 1] | x[:, 4]
    r, c = np.nonzero(x)
    w, b = T.regression(r, c, y.astype(float), 6)
    assert b < 0 and min(w[1], w[4]) > 5 and max(w[[0, 2, 3, 5]]) < 0.2
    w, b = T.regression(np.zeros(0, int), np.zeros(0, int), np.array([0.0, 1.0, 0.0]), 0)
    assert len(w) == 0 and 1 / (1 + math.exp(-b)) == pytest.approx(1 / 3, abs=0.02)


def test_held_out_accuracy(spark):
    """Labels of two thirds are learnt; the others show what the scores are worth."""
    folder = "/root/testdata/sf0.1"
    rows = op11_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) > 0.8 * len(toxic) and sum(r.predicted for r in clean) < 0.005 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_disguised_documents_are_found(spark, texts):
    """Labels of plainly written documents catch documents whose slurs are all disguised."""
    rng = random.Random(4)
    clean = [" ".join(w for w in t.split() if w.strip(".") not in SLURS) for t in texts[:300]]
    plain = [f"{c} {rng.choice(SLURS)} and {rng.choice(SLURS)} it" for c in clean]
    hide = {"i": "1", "o": "0", "s": "$", "a": "@", "e": "3"}
    disguised = lambda w: rng.choice([" ".join(w), "".join(hide.get(c, c) for c in w), w[:2] + w[2] * 4 + w[3:]])
    hidden = [f"{c} {disguised(rng.choice(SLURS))} and {disguised(rng.choice(SLURS))} it" for c in clean]
    rows = [(i, t) for i, t in enumerate([*plain, *clean, *hidden])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(600)], "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in T.classify(docs, labels).collect()}
    assert sum(found[i] for i in range(600, 900)) >= 285 and sum(found[i] for i in range(300, 600)) <= 3


def test_cases(spark):
    rows = [(1, "moron"), (1, "moron"), (2, None), (3, ""), (4, " 12 !! "), (None, "x y"), (5, "a" * 300_000), (6, "a " * 50_000), (7, "$" * 5000 + "x1" * 5000)]
    docs = spark.createDataFrame([(*r, 0.5, "z") for r in rows], "doc_id long, text string, score double, key string")  # clashing names
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = T.classify(docs, none).collect()
    assert len(out) == len(rows) and {(r.score, r.predicted) for r in out} == {(0.0, 0)} and [r.held_out for r in out if r.doc_id is None] == [False]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    many = spark.createDataFrame([(i, "moron it is" if i % 4 == 0 else "well it is") for i in ids] + rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids] + [(None, 1), (ids[0], 0), (3, None)], "doc_id long, toxic int")
    assert T.classify(many, labels).count() == len(ids) + len(rows)
    assert T.classify(docs.where("false"), labels).count() == 0


def test_only_learnable_labels_and_the_sample_teach(spark):
    """Held-out labels, and those beyond the sample, change no score."""
    ids = list(range(400))
    docs = spark.createDataFrame([(i, f"{'moron' if i % 3 == 0 else 'well'} it is {i}") for i in ids], "doc_id long, text string")
    true = [(i, int(i % 3 == 0)) for i in ids]
    flipped = [(i, 1 - x if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, x in true]
    score = lambda rows: sorted(map(tuple, T.classify(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()))
    assert score(true) == score(flipped)
    cost = T.language_model(docs)
    assert T.fit(docs, spark.createDataFrame(true, "doc_id long, toxic int"), cost, most=60) is not None


def test_restored_texts(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, "the m0r0n was"), (901, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in T.restore(docs).collect()}
    assert out[900].restored == "the moron was" and out[900].n_restored == 1 and out[901].restored == ""
    assert sum(out[i].restored == t for i, t in enumerate(texts)) >= 300

"""The trained models: gradients, held-out accuracy, forbidden inputs, awkward rows."""

import zlib

import numpy as np
import pandas as pd
import pytest

from galley.llm import language_id, quality_model

SF = "/root/testdata/sf0.01"


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    net = language_id.fresh(["a", "b", "c"], 3, 7)
    for k, w in enumerate(net.weights()):
        w += 0.1 * rng.normal(size=w.shape).astype(np.float32)
    data, valid, label = rng.integers(97, 102, (7, 5)).astype(np.uint8), np.ones((7, 5), np.float32), np.array([0, 1, 2, 1, 0])
    valid[5:, 2] = 0
    _, grads = language_id._gradients(net, data, valid, label)
    for w, g in zip(net.weights(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if w.shape[-1] == 256:
                at = (at[0], int(data[rng.integers(0, 5), rng.integers(0, 5)]))
            old, losses = w[at], []
            for step in (1e-2, -1e-2):
                w[at] = old + step
                losses.append(language_id._gradients(net, data, valid, label)[0])
            w[at] = old
            assert abs((losses[0] - losses[1]) / 2e-2 - g[at]) < 2e-3


def test_stretches_cover_all_bytes():
    texts = [b"", b"abc", bytes(range(64)), b"x" * 129]
    body, sizes, owner = language_id.cut(texts, 64)
    assert [b"".join(bytes(b[:n]) for b, n, o in zip(body, sizes, owner) if o == k) for k in range(4)] == texts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_accuracy_and_awkward_rows(spark, frame, docs):
    net = language_id.fit(docs, steps=120)
    got = language_id.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.95 and got.score.between(0, 1).all()
    rows = [(1, None), (2, ""), (3, "12 %% 34"), (None, "the and of the thing is with that"), (4, "x" * 200_000), (4, "the")]
    out = language_id.identify(frame(rows), net).collect()
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and [r.score for r in out[:3]] == [0.0] * 3
    assert out[3].lang_pred == "en" and out[3].held_out is False and len(out) == 6
    assert language_id.identify(frame([]), net).count() == 0
    nothing = language_id.fit(frame([(1, "text", None)]))
    assert nothing is None and language_id.identify(frame([(1, "text")]), nothing).first().lang_pred == "und"


def slow_probabilities(net, raw):
    """The network walked a byte at a time: mean probabilities over all positions."""
    logistic = lambda x: 1 / (1 + np.exp(-x))
    total = np.zeros(len(net.langs))
    for lo in range(0, len(raw), net.span):
        piece = raw[lo : lo + net.span].ljust(net.span, b" ")
        states = []
        for x, u, order in ((net.x[0], net.u[0], range(net.span)), (net.x[1], net.u[1], range(net.span - 1, -1, -1))):
            h, s, out = net.hidden, np.zeros(net.hidden), {}
            for t in order:
                into = x[:, piece[t]].astype(float)
                z, r = logistic(into[:h] + u[:h] @ s), logistic(into[h : 2 * h] + u[h : 2 * h] @ s)
                cand = np.tanh(into[2 * h :] + r * (u[2 * h :] @ s))
                s = z * s + (1 - z) * cand
                out[t] = s
            states.append(out)
        for t in range(min(net.span, len(raw) - lo)):
            e = net.v @ np.concatenate([states[0][t], states[1][t]]) + net.c[:, 0]
            e = np.exp(e - e.max())
            total += e / e.sum()
    return total / max(1, len(raw))


def test_number_signs_are_no_letters_and_every_label_is_learned(frame, spark):
    net = language_id.fresh(["es", "en"], 2, 8)
    net.usual = np.full(2, 0.5)
    out = language_id.identify(frame([(1, "½ ² ①"), (2, "Ⅷ"), (3, "٣ 12 _"), (4, "½ a"), (5, "ⁿ")]), net).collect()
    assert [r.lang_pred != "und" for r in out] == [False, False, False, True, True]
    rows = [(i, f"word{i % 130} " * 20, f"l{i % 130:03}") for i in range(900)]
    *_, langs = language_id.sample(frame(rows), 600, 2, 64, 260, "doc_id", "text", "lang")
    assert langs == sorted({lang for _, _, lang in rows})


def test_network_equals_a_slow_walk():
    net = language_id.fresh(["a", "b", "c"], 4, 16)
    texts = [b"", b"some bytes", bytes(range(100, 151))]
    assert np.allclose(language_id.probabilities(net, texts), [slow_probabilities(net, t) for t in texts], atol=1e-4)


def test_predictions_do_not_read_labels(frame, docs):
    net = language_id.fit(docs, steps=20)
    texts = [r.text for r in docs.limit(20).collect()]
    a = language_id.identify(frame([(i, t, "en", "a") for i, t in enumerate(texts)]), net).collect()
    b = language_id.identify(frame([(i + 100, t, "fr", "b") for i, t in enumerate(texts)]), net).collect()
    assert [(r.lang_pred, r.score) for r in a] == [(r.lang_pred, r.score) for r in b]


def test_forest_equals_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality_model.NAMES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    forest = quality_model.grow(x, y, trees=30)
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.97

    def walk(row):
        total = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.limit[t, node])
            total += forest.leaf[t, node - forest.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], forest.score(x[:50]))


def test_quality_on_held_out_rows(spark, frame, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_model.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    odd = spark.createDataFrame(pd.DataFrame({"doc_id": [1.0, None, 2.0, 9.0], "quality": [1.0, 0.0, None, 7.0]}))
    out = quality_model.classify(frame([(1, "a b"), (1, "a b"), (2, None), (None, "")]), odd).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out}) == 1
    assert quality_model.classify(frame([]), labels).count() == 0

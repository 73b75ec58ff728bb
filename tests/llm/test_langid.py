import random

import numpy as np
import pytest

from auditloom.llm import langid
from auditloom.llm.langid import UND, BiGRU
from tests.llm.cases import docs, plain, prose

SYLLABLES = {"aa": "ka to mi ra lu ne so".split(), "bb": "sch ung ein der tz och ich".split(), "cc": "ño que ción el los ará".split()}


def sentence(lang: str, n: int, seed: int) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_gradients_agree_with_differences():
    model = BiGRU(["a", "b", UND], hidden=3, seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1])
    _, grad = model.gradients(x, y)
    for k, v in model.p.items():
        picks = [tuple(rng.integers(0, s) for s in v.shape) for _ in range(6)]
        if k == "table":
            picks = [(d, g, int(x[t, 0]), h) for d in (0, 1) for g in range(3) for t, h in ((0, 0), (3, 1))]
        for at in picks:
            old, eps = v[at], 1e-5
            v[at] = old + eps
            up = model.gradients(x, y)[0]
            v[at] = old - eps
            down = model.gradients(x, y)[0]
            v[at] = old
            assert abs((up - down) / (2 * eps) - grad[k][at]) < 1e-6, (k, at)


def test_a_short_window_leaves_the_others_whole(monkeypatch):
    model = BiGRU(["a", "b"], hidden=3, seed=1)
    read = []
    whole = BiGRU.gradients
    monkeypatch.setattr(BiGRU, "gradients", lambda self, x, y, *mask: (read.append((x.shape, *[m.sum() for m in mask])), whole(self, x, y, *mask))[1])
    model.fit([b"k" * 72, b"z" * 24], [0, 1], steps=2, batch=4)
    assert read == [((72, 4), 2 * 72 + 2 * 24)] * 2
    # padding changes neither the loss nor the gradients
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = np.random.default_rng(0).integers(0, 256, (9, 2)), np.array([0, 1])
    mask = np.ones((9, 2))
    mask[5:, 1] = 0
    loss, grad = model.gradients(x, y, mask)
    (one, g), (two, h) = model.gradients(x[:, :1], y[:1]), model.gradients(x[:5, 1:], y[1:])
    assert abs(loss - (9 * one + 5 * two) / 14) < 1e-9 and all(np.allclose(grad[k], (9 * g[k] + 5 * h[k]) / 14) for k in grad)


@pytest.fixture(scope="module")
def labelled():
    return [(i, sentence(lang, 60, i), lang) for i, lang in enumerate(sorted(SYLLABLES) * 120)]


@pytest.fixture(scope="module")
def model(spark, labelled):
    df = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    return langid.train(df)


def test_held_out_accuracy_and_noise(model):
    held = [(sentence(lang, 60, 10_000 + i), lang) for i, lang in enumerate(sorted(SYLLABLES) * 50)]
    lang, _, good, *_ = langid.verdicts(model, [t for t, _ in held])
    assert np.mean([a == b for a, (_, b) in zip(lang, held)]) >= 0.97 and all(good)
    junk = [b.decode("latin-1") for b in langid.noise(60, 600, seed=99)]
    assert np.mean(langid.verdicts(model, junk)[2]) <= 0.1


def test_every_position_is_labelled_and_windows_don_t_mix_texts(model):
    texts = [sentence("aa", 7, 1), "", None, sentence("bb", 900, 2), "x", sentence("cc", 33, 3)]
    lang, prob, good, size, ends, labels = langid.verdicts(model, texts)
    assert size == [len((t or "").encode()) for t in texts]
    assert [e[-1] if len(e) else 0 for e in ends] == size
    for i, t in enumerate(texts):
        alone = langid.verdicts(model, [t])
        assert alone[0][0] == lang[i] and np.array_equal(alone[4][0], ends[i]) and np.array_equal(alone[5][0], labels[i])
        assert prob[i] is None or abs(alone[1][0] - prob[i]) < 1e-5


def test_same_weights_for_any_partitioning(spark, labelled, model):
    df = spark.createDataFrame(labelled, "doc_id long, text string, lang string").repartition(5)
    again = langid.train(df)
    assert all(np.array_equal(again.p[k], model.p[k]) for k in model.p)


def test_all_cases(spark, model):
    df = docs(spark)
    got = langid.identify(df, model).collect()
    assert len(got) == df.count()
    empty = [r for r in got if r.doc_id in (4, 5, 6)]
    assert all(r.lang_id == UND and r.probability is None and not r.accepted and r.n_bytes == 0 for r in empty)
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and not {4, 5, 6} & {r.doc_id for r in kept.select("doc_id").collect()}


def test_training_rows_may_be_missing_or_odd(spark):
    none = plain(spark, [(1, prose(1, 20)), (2, None)]).withColumn("lang", langid.F.lit(None).cast("string"))
    assert [r.lang_id for r in langid.identify(none).collect()] == [UND, UND]
    assert langid.keep_identified(none).count() == 0
    assert langid.identify(docs(spark, [])).count() == 0 and langid.keep_identified(docs(spark, [])).count() == 0


def _plain_forward(model, raw):
    """Byte by byte, in both directions, with scalars' formulas written out."""
    table, u, w, c = (model.p[k].astype(np.float64) for k in ("table", "u", "w", "c"))
    hidden = u.shape[-1]
    both = []
    for way, order in ((0, raw), (1, raw[::-1])):
        h, states = np.zeros(hidden), []
        for byte in order:
            r = 1 / (1 + np.exp(-(table[way, 0, byte] + h @ u[way, 0])))
            z = 1 / (1 + np.exp(-(table[way, 1, byte] + h @ u[way, 1])))
            n = np.tanh(table[way, 2, byte] + r * (h @ u[way, 2]))
            h = n + z * (h - n)
            states.append(h)
        both.append(states if way == 0 else states[::-1])
    out = []
    for a, b in zip(*both):
        x = np.exp(a @ w[0] + b @ w[1] + c)
        out.append(x / x.sum())
    return np.array(out)


def test_labels_and_pooling_against_a_plain_forward_pass():
    model = langid.BiGRU(["aa", "bb", "und"], seed=3)
    texts = [b"short", b"x" * 128, bytes(range(256)) * 2, "é ß text of some length, more than a window of one hundred and twenty-eight bytes, so that it is cut into several".encode() * 2, b"q"]
    labels, pooled, size = langid.label_batch(model, texts)
    at = 0
    for k, raw in enumerate(texts):
        want = np.concatenate([_plain_forward(model, raw[i : i + langid.WINDOW]) for i in range(0, len(raw), langid.WINDOW)])
        assert size[k] == len(raw) and np.allclose(pooled[k], want.sum(0), rtol=1e-4)
        sure = np.sort(want, 1)[:, -1] - np.sort(want, 1)[:, -2] > 1e-4
        assert (labels[at : at + len(raw)][sure] == want.argmax(1)[sure]).all()
        at += len(raw)

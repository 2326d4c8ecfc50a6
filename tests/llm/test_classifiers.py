"""The classifiers against plain Python, and on rows that took no part in the fit."""

import zlib

import numpy as np

from kmeridian.llm import quality, toxicity

M64 = (1 << 64) - 1
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_slots(text, bits):
    """Slots of distinct words, neighbours and pairs with a word between, by whole numbers."""
    mix = 0x9E3779B97F4A7C15
    found = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in (text or "").lower()).split()
    hashes = []
    for w in found:
        h = 0xCBF29CE484222325
        for b in w.encode():
            h = (h ^ b) * 0x100000001B3 & M64
        hashes.append(h * mix & M64)
    pairs = [(a ^ b >> 7) * mix & M64 for a, b in zip(hashes, hashes[1:], strict=False)]
    skips = [(a ^ b >> 13) * mix & M64 for a, b in zip(hashes, hashes[2:], strict=False)]
    return {0} | {max(1, x >> (64 - bits)) for x in hashes + pairs + skips}


def test_slots_by_whole_numbers():
    rng = np.random.default_rng(1)
    texts = [None, "", "one", "Two  words", "été ÉTÉ x_y-z 12!", *(" ".join(rng.choice(list("abcdé!7"), int(n))) for n in rng.integers(1, 60, 30))]
    for t in texts:
        for bits in (8, 20):
            assert set(toxicity.features(t, bits).tolist()) == plain_slots(t, bits)


def test_ftrl_by_its_rule():
    """Coordinate by coordinate: z gathers gradients less the rate's change times the weight, and L1 keeps small ones at zero."""
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 50, 8)), int(rng.random() < 0.4)) for _ in range(300)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.8, 0.1
    model = toxicity.Ftrl(50, alpha, beta, l1, l2)
    z, n = [0.0] * 50, [0.0] * 50
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)
    for at, y in rows:
        model.learn(at, y)
        w = {int(i): weight(i) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in w:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
            n[i] += g * g
    want = [weight(i) for i in range(50)]
    assert np.allclose(model.weights(), want) and 0 < sum(w == 0 for w in want) < 50


def tables(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(700):
        w, bad = list(rng.choice(words, 60)), int(i % 4 == 0)
        if bad:
            at = int(rng.integers(58))
            w[at], w[at + 1 + i % 2] = "you", "vermin"  # a pair, or one with a word between
        elif i % 3 == 0:
            w[int(rng.integers(60))] = "you"
        shouts = int(rng.integers(3, 9)) if bad else int(rng.integers(0, 2))
        rows.append((i, " ".join(x + "!" if j < shouts else x for j, x in enumerate(w)), "en", "s", 0))
        labels.append((i, bad, 1 - bad))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), {i: b for i, b, _ in labels}


def auc(scores, truth):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    good = np.array(truth, bool)
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_rows_held_out_are_told_apart(spark):
    docs, labels, bad = tables(spark)
    for module, folds, fold, flip in ((toxicity, 4, 2, False), (quality, 5, 0, True)):
        scores = {r["doc_id"]: r["score"] for r in module.score(docs, module.fit(docs, labels, folds, fold)).collect()}
        out = [i for i in scores if zlib.crc32(str(i).encode()) % folds == fold]
        assert 80 < len(out) < 300
        truth = [bad[i] ^ flip for i in out]
        assert auc([scores[i] for i in out], truth) > 0.95
        assert np.mean([(scores[i] >= 0.3) == bool(t) for i, t in zip(out, truth, strict=True)]) > 0.9


def test_held_out_labels_are_never_read(spark):
    docs, labels, _ = tables(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = (toxicity.fit(docs, x, 4, 2) for x in (labels, turned))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    c, d = (quality.fit(docs, x, 5, 0) for x in (labels, turned))
    assert all(np.array_equal(c[k], d[k]) for k in c)


def test_pairwise_loss_is_low_and_the_threshold_a_quantile(spark):
    docs, labels, bad = tables(spark)
    m = quality.fit(docs, labels, 5, 0)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    strength = quality._coded(np.array([quality.measures(t) for _, t in rows]), m["edges"]) @ m["w"]
    is_bad = np.array([bad[i] for i, _ in rows], bool)
    gaps = strength[~is_bad][:, None] - strength[is_bad][None]
    assert np.log1p(np.exp(-gaps)).mean() < 0.35 and (gaps > 0).mean() > 0.9
    assert abs(np.quantile(strength, is_bad.mean()) - m["cut"]) < 1e-9

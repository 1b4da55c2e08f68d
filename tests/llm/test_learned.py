import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import common as C
from tidegauge.llm import masked_lm, mixing, subword_quality, toxicity

rng = random.Random(2)
WORDS = ["ba", "co", "du", "fe", "gi", "ho", "ju", "ka", "lo", "mi"]


def text(kind):
    w = ["".join(rng.choice(WORDS) for _ in range(2)) for _ in range(40)]
    if kind == "toxic":
        w[5] = w[20] = "idiot"
    return " ".join(x + "***" for x in w) if kind == "junk" else " ".join(w)


KINDS = ["clean", "clean", "toxic", "junk"]
DATA = [(k, text(KINDS[k % 4]), KINDS[k % 4]) for k in range(480)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in DATA] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(kind != "junk"), int(kind == "toxic")) for k, _, kind in DATA] + [(901, None, None), (5555, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


@pytest.mark.parametrize("operator,positive", [(toxicity.toxicity, {"toxic"}), (subword_quality.quality_scores, {"clean", "toxic"})])
def test_held_out_accuracy(tables, operator, positive):
    got = {r.doc_id: r for r in operator(*tables).collect()}
    assert len(got) == len(DATA) + 2 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == held(k) for k, r in got.items())
    out = [(got[k].predicted, int(kind in positive)) for k, _, kind in DATA if held(k)]
    assert np.mean([a == b for a, b in out]) > 0.95


def test_without_labels(spark, tables):
    none = tables[1].limit(0)
    assert {r.score for r in toxicity.toxicity(tables[0], none).collect()} == {0.5}
    assert {r.score for r in subword_quality.quality_scores(tables[0], none).collect()} == {0.5}
    assert toxicity.toxicity(tables[0].limit(0), tables[1]).count() == 0


def test_mixture_reaches_its_targets(tables):
    rows = mixing.mix(*tables, {"clean": 0.6, "toxic": 0.3, "junk": 0.1}).collect()
    total = sum(r.n_tokens for r in rows)
    for domain, share in (("clean", 0.6), ("toxic", 0.3), ("junk", 0.1)):
        got = sum(r.n_tokens * r["p_" + domain] * r.rate for r in rows)
        assert got == pytest.approx(share * total, rel=0.02)
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)


def test_thinning_keeps_clean_documents(tables):
    kept = {r.doc_id for r in mixing.thin(*tables, {"clean": 0.94, "toxic": 0.05, "junk": 0.01}).collect()}
    clean = {k for k, _, kind in DATA if kind == "clean"}
    assert clean <= kept and len(kept) < len(DATA)


def test_calibration_moves_the_threshold():
    s = np.array([-3.0, -2.0, -2.0, -1.0, -0.5, -0.4])
    scale, offset = toxicity.calibration(s, np.array([0.0, 0, 0, 0, 1, 1]))
    assert scale * -0.4 + offset > 0 > scale * -3 + offset


def test_masked_lm_prefers_the_order_it_has_seen(spark):
    cycle = ["a", "b", "c", "d", "e", "f"]
    seen = [(k, " ".join(cycle[(k + j) % 6] for j in range(60))) for k in range(300)]
    shuffled = [(1000 + k, " ".join(rng.sample(cycle * 10, 60))) for k in range(5)]
    docs = spark.createDataFrame(seen + shuffled + [(5000, None), (5001, "...")], "doc_id long, text string")
    got = {r.doc_id: r for r in masked_lm.pseudo_likelihood(docs, masked_lm.WindowLm(rounds=3, batch=64)).collect()}
    assert got[5000].n_tokens == 0 and got[5000].sum_log_prob == 0 and got[5001].mean_log_prob is None
    assert np.mean([got[k].mean_log_prob for k, _ in seen]) > np.mean([got[k].mean_log_prob for k, _ in shuffled]) + 0.3


def coded_texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").mapInArrow(masked_lm._encode, "doc_id long, words binary")


def test_training_takes_every_window_however_it_is_dealt(spark):
    cfg, sc = masked_lm.WindowLm(part_windows=50), spark.sparkContext
    coded = coded_texts(spark, ["a b c"[: 2 * (k % 3) + 1] for k in range(60)])
    found, tokens = masked_lm.vocabulary(coded, cfg)
    counts, flat = sc.broadcast(found), sc.broadcast(masked_lm.Net(cfg).flat)
    rows = masked_lm.dealt(coded, cfg, tokens).mapInArrow(masked_lm._train(cfg, counts, flat, 0), masked_lm.SUMS).filter("slot = 0").collect()
    assert cfg.rounds >= 1 and tokens == 120 and sum(r.weight for r in rows) == 120 and len(rows) == 3
    docs = spark.createDataFrame([(k, text(KINDS[k % 4])) for k in range(40)], "doc_id long, text string")
    score = lambda df: {r.doc_id: r.sum_log_prob for r in masked_lm.pseudo_likelihood(df, masked_lm.WindowLm(part_windows=500)).collect()}
    one, other = score(docs.repartition(5)), score(docs.coalesce(1))
    assert one == pytest.approx(other, rel=1e-5)


def some_places(cfg, n, seed=0):
    rng = np.random.default_rng(seed)
    cls = rng.integers(0, cfg.classes, n)
    own = cls < cfg.own_classes
    places = np.where(own, cls * cfg.width + rng.integers(0, cfg.width, n), cfg.own_words + rng.integers(0, cfg.shared, n)).astype(np.uint16)
    return places, cls.astype(np.uint8), np.where(own, 0, -rng.random(n)).astype(np.float32)


def test_scores_are_a_literal_log_softmax():
    cfg = masked_lm.WindowLm()
    net, rows = masked_lm.Net(cfg), [some_places(cfg, n, n) for n in (3, 0, 40)]
    net.flat += np.random.default_rng(1).normal(0, 0.3, len(net.flat)).astype(np.float32)
    for scale in (1, 400):  # at the second, exp() of the outputs overflows
        net.cls *= scale
        for most in (1 << 19, 7):
            owner, got = [], []
            for ids, context, cls, tail, k in masked_lm.windows(cfg, rows, most):
                got += net.log_probs(ids, context, cls, tail).tolist()
                owner += k.tolist()
            assert owner == [0] * 3 + [2] * 40
            want = []
            for places, cls, tail in rows:
                line = [cfg.pad] * 2 + places.tolist() + [cfg.pad] * 2
                for j in range(len(places)):
                    around = [line[j], line[j + 1], line[j + 3], line[j + 4]]
                    h = np.append(np.tanh(sum(net.embed[w].astype(float) * net.place[i] for i, w in enumerate(around)) + net.bias), 1)
                    s = net.cls.astype(float) @ h
                    value = s[cls[j]] - s.max() - np.log(np.exp(s - s.max()).sum()) + tail[j]
                    if cls[j] < cfg.own_classes:
                        t = net.word[cls[j]].astype(float) @ h
                        value += t[places[j] % cfg.width] - t.max() - np.log(np.exp(t - t.max()).sum())
                    want.append(value)
            assert np.isfinite(got).all() and got == pytest.approx(want, abs=2e-3 * scale)


def test_a_step_follows_the_gradient():
    cfg = masked_lm.WindowLm(own_words=128, width=16, bands=4, shared=50, dim=4)
    places, cls, tail = some_places(cfg, 30)
    ids, context, cls, tail, _ = next(masked_lm.windows(cfg, [(places, cls, tail)]))
    loss = lambda flat: -float(masked_lm.Net(cfg, flat).log_probs(ids, context, cls, tail).astype(float).mean())
    net = masked_lm.Net(cfg)
    before, rate = net.flat.copy(), 1e-3
    net.step(ids, context, cls, rate)
    faster = {"embed": 16, "cls": 8, "word": 16}
    at = 0
    for name in ("embed", "place", "bias", "cls", "word"):
        n = getattr(net, name).size
        moved = (before - net.flat)[at : at + n].astype(float) / rate / faster.get(name, 1)
        k = at + int(np.abs(moved).argmax())
        up, down = before.copy(), before.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(moved[k - at], rel=0.05, abs=1e-4), name
        at += n


def test_shares_of_counts_sum_to_one_in_each_band():
    cfg = masked_lm.WindowLm()
    found = masked_lm.Counts.of(cfg, np.zeros(0, np.uint32), np.random.default_rng(0).zipf(1.5, 5000).clip(1, 10**6))
    for band in np.unique(found.band):
        assert np.exp(found.share[found.band == band].astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_units_of_long_words_and_surrogates():
    units = subword_quality.Units(subword_quality.Subwords())
    assert len(units.of("x" * 5000)[0]) > 0 and C.WordHashes(2).of(["a", "b", "c", "a"])[0] == C.WordHashes().of(["a"])[0]


def test_units_are_those_of_whole_words():
    cfg, head, junk = subword_quality.Subwords(), "x" * 64, "".join(rng.choice("abcdefghij日") for _ in range(3000))
    number = lambda x: int(C.mix(np.array([x], np.uint64))[0]) & ((1 << cfg.bits) - 1)
    weights = np.random.default_rng(0).normal(size=1 << cfg.bits)
    one, many = subword_quality.Units(cfg), subword_quality.Units(cfg, block=100)
    scored = [subword_quality.Units(cfg, weights), subword_quality.Units(cfg, weights, block=100)]
    for text in ("ab", "добрый день", "日本語の文", head + "tail", head + "liat", f"a {junk} b {junk} {junk}", f"{head} {head}y a", head + "tail"):
        words, n = text.split(), np.zeros(1 << cfg.bits)
        for w in words:
            n[number(zlib.crc32(w.encode()) + (1 << 32) + 7)] += 1
            for g in cfg.grams:
                for j in range(len(w) + 3 - g):
                    code = g
                    for c in f"<{w}>"[j : j + g]:
                        code = (code * int(subword_quality.FOLD) + ord(c)) % 2**64
                    n[number(code)] += 1
        for a, b in zip(words[:-1], words[1:]):
            h = [zlib.crc32(x.encode()) + (1 << 32) for x in (a, b)]
            n[1 if a == b else number(h[0] * 3 + h[1])] += 1
        for units in (one, many):
            places, shares = units.of(text)
            assert places.tolist() == np.flatnonzero(n).tolist() and np.allclose(shares, n[places] / n.sum(), atol=1e-6)
            assert all(len(w) <= units.longest for w in set(units.place) - set(words))
        for units in scored:
            assert units.mean(text) == pytest.approx(float(n @ weights / n.sum()), abs=1e-9)


def test_features_of_texts_together_are_those_of_each_alone():
    texts = [None, "", "a", "You IDIOT, you", "b c", "x! " * 500, *[t for _, t, _ in DATA[:20]]]
    used = np.arange(1 << 12) % 3 == 0
    for mark in (None, used):
        owner, places, sizes = toxicity.Features(12, mark).of(texts)
        for k, t in enumerate(texts):
            alone = toxicity.Features(12, mark).of([t])
            assert places[owner == k].tolist() == alone[1].tolist() and sizes[k] == alone[2][0]
    everything = toxicity.Features(12).of(texts)
    marked = used[everything[1]]
    assert everything[0][marked].tolist() == owner.tolist() and everything[1][marked].tolist() == places.tolist()
    groups = list(toxicity.together(texts, 50))
    assert [t for _, g in groups for t in g] == texts and [a for a, _ in groups] == np.cumsum([0, *[len(g) for _, g in groups[:-1]]]).tolist()


def test_places_of_hashed_words():
    cfg = masked_lm.WindowLm()
    own = np.array([70, 5, 4_000_000_000], np.uint32)
    counts = masked_lm.Counts.of(cfg, own, np.array([3, 1, 1, 1]))
    places, cls, tail = masked_lm.Places(cfg, counts).of(np.array([5, 70, 4_000_000_000, 6], np.uint32).tobytes())
    assert places[:3].tolist() == [1, 0, 2] and cfg.own_words <= places[3] < cfg.pad
    assert cls[:3].tolist() == [0, 0, 0] and cls[3] == cfg.own_classes + counts.band[2] and tail[:3].tolist() == [0, 0, 0]
    assert tail[3] == pytest.approx(np.log(1 / 3))
    nothing = masked_lm.Places(cfg, masked_lm.Counts.of(cfg, own[:0], np.zeros(1, np.int64))).of(b"")
    assert [len(x) for x in nothing] == [0, 0, 0]


def test_scores_do_not_depend_on_the_rows_at_once():
    cfg, rng = masked_lm.WindowLm(), np.random.default_rng(3)
    flat = masked_lm.Net(cfg).flat * 5
    plain, net, n = masked_lm.Net(cfg, flat), masked_lm.Net(cfg, flat).for_scoring(), 700
    ids, context = rng.integers(0, cfg.own_words, n).astype(np.uint16), rng.integers(0, cfg.pad + 1, (4, n)).astype(np.uint16)
    cls, tail = (ids // cfg.width).astype(np.uint8), np.zeros(n, np.float32)
    whole = net.log_probs(ids, context, cls, tail)
    for m in (1, 2, 3, 5, 16, 33, 699):
        assert net.log_probs(ids[:m], context[:, :m], cls[:m], tail[:m]).tolist() == whole[:m].tolist()
    assert np.abs(whole - plain.log_probs(ids, context, cls, tail)).max() < 0.02


def test_masked_lm_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, "x " * 30_000)], "doc_id long, text string").withColumn("words", F.lit(0))
    got = masked_lm.pseudo_likelihood(docs).collect()
    assert len(got) == 5 and len({r.sum_log_prob for r in got if r.n_tokens == 2}) == 1 and max(r.n_tokens for r in got) == 30_000
    assert masked_lm.pseudo_likelihood(docs.limit(0)).count() == 0


def nonnegative_least_squares(n, p, targets, most=np.inf, passes=60_000):
    """Plain projected gradient on the rates."""
    a = (n[:, None] * p).T
    r, rate = np.ones(len(n)), 1 / np.linalg.eigvalsh(a @ a.T).max()
    for _ in range(passes):
        r = np.clip(r - rate * (a.T @ (a @ r - targets)), 0, most)
    return a @ r


@pytest.mark.parametrize("weights,most", [((0.5, 0.3, 0.2), None), ((0.1, 0.8, 0.1), 1.0), ((0.0, 1.0, 0.0), None), ((1.0, 0.0, 0.0), 2.0)])
def test_rates_are_those_of_plain_least_squares(spark, weights, most):
    r = np.random.default_rng(3)
    n, p = r.integers(1, 50, 80).astype(float), r.dirichlet([1, 0.5, 0.3], 80)
    table = spark.createDataFrame([(int(x), *map(float, y)) for x, y in zip(n, p)], "n_tokens long, p_clean double, p_toxic double, p_junk double")
    targets = np.array(weights) * n.sum()
    rate, got = mixing.fit_rates(table, targets, most)
    want = nonnegative_least_squares(n, p, targets, most or np.inf)
    assert np.linalg.norm(got - targets) <= np.linalg.norm(want - targets) * 1.05 + 2e-3 * n.sum()
    rows = table.withColumn("rate", rate).collect()
    assert sum(x.rate * x.n_tokens * x.p_toxic for x in rows) == pytest.approx(got[1]) and all(0 <= x.rate <= (most or np.inf) for x in rows)


def test_out_of_reach_targets_are_told(tables):
    rows = mixing.mix(*tables, {"clean": 0.0, "toxic": 1.0}, total_tokens=10**6, most=1.0).collect()
    assert {round(r.off_toxic, 2) for r in rows} == {round(sum(r.n_tokens * r.p_toxic * r.rate for r in rows) / 10**6 - 1, 2)} and rows[0].off_toxic < -0.5
    met = mixing.mix(*tables, {"clean": 0.6, "toxic": 0.3, "junk": 0.1}).first()
    assert max(abs(met[f"off_{d}"]) for d in mixing.DOMAINS) < 0.01


def test_weights_are_those_of_a_literal_ftrl():
    r = np.random.default_rng(0)
    cfg = toxicity.Ftrl(bits=5, l1=0.3, epochs=2, least_rows=1, calibrate=7)
    rows = [(int(r.random() < 0.5), np.unique(r.integers(0, 32, 6))) for _ in range(60)]
    w, bias = toxicity.train(rows, 1, cfg)
    kept, learnt = rows[::7], [x for k, x in enumerate(rows) if k % 7]
    z, n, b, bn, order = [0.0] * 32, [0.0] * 32, 0.0, 0.0, np.random.default_rng(5)
    weight = lambda j: 0.0 if abs(z[j]) <= cfg.l1 else -(z[j] - np.sign(z[j]) * cfg.l1) / ((cfg.beta + n[j] ** 0.5) / cfg.alpha + cfg.l2)
    for _ in range(2):
        for k in order.permutation(len(learnt)):
            y, f = learnt[k]
            g = 1 / (1 + np.exp(-(sum(weight(j) for j in f) + b))) - (y == 0)
            for j in f:
                was = weight(j)
                z[j] += g - ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / cfg.alpha * was
                n[j] += g * g
            bn += g * g
            b -= cfg.alpha / (cfg.beta + bn**0.5) * g
    want = np.array([weight(j) for j in range(32)])
    scale, offset = toxicity.calibration(np.array([want[f].sum() + b for _, f in kept]), np.array([float(y == 0) for y, _ in kept]))
    assert np.allclose(w[0], want * scale) and bias[0] == pytest.approx(b * scale + offset)


def test_a_quality_step_follows_the_gradient():
    """One row, one epoch: the layer and the bias move along the gradient of the softmax's loss, by the stated rates."""
    cfg = subword_quality.Subwords(bits=6, dim=3, epochs=1)
    units, share = np.array([2, 9, 40]), np.array([0.5, 0.25, 0.25], np.float32)
    vectors, layer, bias = subword_quality.train([(1, units, share)], 2, cfg)
    r = np.random.default_rng(3)
    v0 = r.uniform(-1 / 3, 1 / 3, (64, 3)).astype(np.float32)
    l0 = r.normal(0, 0.3, (3, 2)).astype(np.float32)
    mean = share @ v0[units]
    p = np.exp(mean @ l0)
    p = p / p.sum() - [0, 1]
    assert np.allclose(bias, -cfg.rate * 0.05 * p, atol=1e-6)
    moved = v0[units] - cfg.rate * np.outer(share / (share @ share), l0 @ p)
    assert np.allclose(vectors[units], moved, atol=1e-5) and np.allclose(layer, l0 - cfg.rate * 0.2 * np.outer(mean, p), atol=1e-5)


@pytest.mark.parametrize("operator", [lambda d, l: toxicity.toxicity(d, l), lambda d, l: subword_quality.quality_scores(d, l), lambda d, l: mixing.mix(d, l, {"clean": 1.0})])
def test_odd_tables(spark, tables, operator):
    """Repeated rows are scored each, a labelled id is learnt from once, very long texts are whole, columns may clash."""
    docs, labels = tables[0].drop("score"), tables[1]
    more = docs.union(docs.filter("doc_id < 100")).union(spark.createDataFrame([(7000, text("clean") * 3000), (None, "a b")], "doc_id long, text string"))
    got = operator(more.withColumn("n_tokens", F.lit("x")).withColumn("p", F.lit(1)).withColumn("y", F.lit(2)), labels).collect()
    assert len(got) == len(DATA) + 104
    seen = {}
    assert all(seen.setdefault(r.doc_id, r) == r for r in got)
    alone = {r.doc_id: r for r in operator(docs, labels).collect()}
    name = "score" if "score" in got[0] else "p_toxic"
    assert all(alone[k][name] == pytest.approx(seen[k][name]) for k in alone)
    assert operator(docs.limit(0), labels).count() == 0

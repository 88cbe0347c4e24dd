import math
import random
import time

import numpy as np

from quarry.llm import maxent_lm as M
from quarry.llm import quality as Q
from tests.llm import brute
from tests.llm.conftest import BIG, prose


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    good = np.array(label) == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def corpus(n, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = prose(r, r.randint(20, 120))
        bad = r.random() < 0.3
        if bad:
            text = random.Random(i).choice([" ".join(w.upper() + "!!" for w in text.split()), text.replace(" ", " | "), " ".join(w + "$$$" for w in text.split())])
        out.append((i, text, 0 if bad else 1))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 1 - q) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.quality(docs, labels).collect()}
    assert all(got[i].held_out == (brute.crc(i, 5) == 0) for i, *_ in rows)
    held = [(got[i].score, q) for i, _, q in rows if got[i].held_out]
    assert auc([s for s, _ in held], [q for _, q in held]) > 0.99
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    kept = Q.quality_filter(docs.withColumnRenamed("doc_id", "doc_id"), labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_held_out_labels_are_not_learned(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    f = lambda flip: spark.createDataFrame([(i, 1 - q if flip and brute.crc(i, 5) == 0 else q) for i, _, q in rows], "doc_id long, quality int")
    scores = [[r.score for r in Q.quality(docs, f(x)).orderBy("doc_id").collect()] for x in (False, True)]
    assert scores[0] == scores[1]


def test_quality_edges(spark, docs, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.quality(empty, none).count() == 0
    assert {r.score for r in Q.quality(docs, none).collect()} == {0.5}
    nulls = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    got = Q.quality(odd, nulls).collect()
    assert len(got) == 6 and all(r.held_out for r in got if r.doc_id is None)


def test_shapes_collapse():
    assert Q.shapes(b"Hello WORLD!! x12 ***") == b"Aa A! a0 *"


def test_scores_are_dot_products():
    texts = [b"One two THREE!! three", b"", b"   ", b"a | b | c", b"same same"]
    w = np.random.default_rng(2).normal(size=Q.DIM + 1)
    direct = [Q.sigmoid(float(w[k] @ v) + w[-1]) for k, v in Q.features(texts)]
    assert np.allclose(Q.scores(texts, w), direct, atol=1e-6)


def test_ftrl_equals_a_plain_version():
    """Per coordinate: z += g - sigma w, n += g^2, w from z and n; the bias has no L1."""
    r = np.random.default_rng(6)
    model, z, n = Q.Ftrl(12), {}, {}

    def weight(k):
        l1 = 0.0 if k == 12 else Q.L1
        zk = z.get(k, 0.0)
        return 0.0 if abs(zk) <= l1 else -(zk - math.copysign(l1, zk)) / ((Q.BETA + math.sqrt(n.get(k, 0.0))) / Q.ALPHA + Q.L2)

    for _ in range(300):
        at = np.sort(r.choice(12, r.integers(0, 6), replace=False))
        x, label = r.random(len(at)), int(r.random() < 0.5)
        model.step(at, x, label)
        row = [*zip(at.tolist(), x.tolist(), strict=True), (12, 1.0)]
        w = {k: weight(k) for k, _ in row}
        p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in row)))
        for k, v in row:
            g = (p - label) * v
            sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / Q.ALPHA
            z[k], n[k] = z.get(k, 0.0) + g - sigma * w[k], n.get(k, 0.0) + g * g
    assert np.allclose(model.weights(np.arange(13)), [weight(k) for k in range(13)], atol=1e-9)


# ---- language model ----


def language_rows():
    r = random.Random(9)
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    return [(i, " ".join(r.choice(a if i % 2 else b) for _ in range(r.randint(1, 160)))) for i in range(1200)] + [(1200, None), (1201, ""), (1202, "unseen words only here"), (1203, "x\ty\nz | x")]


def test_base_is_exact_and_the_model_beats_it(spark):
    rows = language_rows()
    got = {r.doc_id: r for r in M.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    for i, (n, known, total, base) in brute.unigram(rows).items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, brute.crc(i, 7) == 2)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 100


def with_weights(model):
    r = np.random.default_rng(1)
    model.cls[:-1] = r.normal(size=model.cls[:-1].shape) / 3
    model.word[: 2 * M.WORD_ROWS] = r.normal(size=(2 * M.WORD_ROWS, M.WIDTH)) / 3
    return model


def test_a_gradient_step_equals_brute_force():
    """One mini-batch, in plain loops: gradients of both factors by row, their mean square added up, a step of RATE over its root."""
    r = np.random.default_rng(4)
    words = np.arange(1, 1400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    heads = np.append(words[:1023], M.END)
    order = np.argsort(heads)
    vocab = M.Vocabulary(heads[order], order, np.arange(1024, 0, -1).astype(float), np.full(M.TAILS, 30.0), np.full(M.TAILS, 20.0), 10**6, 1400)
    model, plain = with_weights(M.Model(vocab)), with_weights(M.Model(vocab))
    numbers = vocab.look_up(r.choice(np.append(words, M.END), 300))
    begins = np.array([0, 1, 3, 120, 300])
    trainer = model.trainer()
    trainer.fit(numbers, begins)
    gradient = [{}, {}]
    for a, b in zip(begins[:-1], begins[1:]):
        for i in range(a, b):
            x = int(numbers[i])
            one, two = (int(numbers[i - k]) if i - k >= a else M.FEATURES - 1 for k in (1, 2))
            cls = x // M.WIDTH if x < M.HEAD else M.HEAD_CLASSES + (x - M.HEAD) % M.TAILS
            rows = [int(q[0]) for q in plain.class_rows(np.array([one]), np.array([two]))]
            z = plain.cls[rows].astype(float).sum(0) + plain.cls[-1]
            g = np.exp(z) / np.exp(z).sum() - np.eye(M.CLASSES)[cls]
            for k in rows:
                gradient[0][k] = gradient[0].get(k, 0) + g
            if x < M.HEAD:
                rows = [int(q[0]) for q in plain.word_rows(np.array([cls]), np.array([one]), np.array([two]))]
                z = plain.word[rows].astype(float).sum(0) + plain.word[2 * M.WORD_ROWS + cls]
                g = np.exp(z) / np.exp(z).sum() - np.eye(M.WIDTH)[x % M.WIDTH]
                for k in rows:
                    gradient[1][k] = gradient[1].get(k, 0) + g
    for layer, (got, was) in enumerate(((model.cls, plain.cls), (model.word, plain.word))):
        due = was.astype(float)
        for k, g in gradient[layer].items():
            due[k] -= M.RATE / np.sqrt(M.START + (g * g).mean()) * g
        assert np.allclose(got, due, atol=2e-5) and set(np.flatnonzero(trainer.uses[layer]).tolist()) == set(gradient[layer])


def test_probabilities_add_up_to_one():
    words = np.arange(1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    count = np.arange(3000, 1, -1).astype(float)
    tail = (words[1023:] & M._LOW).astype(int)
    heads = np.append(words[:1023], M.END)
    order = np.argsort(heads)
    counts = np.append(count[:1023], 5.0)
    vocab = M.Vocabulary(heads[order], order, counts, np.bincount(tail, count[1023:], M.TAILS), np.bincount(tail, minlength=M.TAILS).astype(float), int(count.sum() + 5), 3000)
    model = with_weights(M.Model(vocab))
    every = np.concatenate([heads, words[1023:], np.arange(M.TAILS, dtype=np.uint64) | np.uint64(1 << 63)])  # and an unseen word of each tail class
    known = np.concatenate([counts, count[1023:], np.zeros(M.TAILS)])
    numbers = vocab.look_up(every)
    total = 0.0
    for k in range(0, len(every), 500):  # each after the same two words
        part = numbers[k : k + 500]
        text = np.stack([np.full(len(part), 3), np.full(len(part), 7), part], 1).ravel()
        got = model.log10(text, np.repeat(known[k : k + 500], 3), np.arange(0, 3 * len(part) + 1, 3))
        total += (10.0 ** got[2::3]).sum()
    assert abs(total - 1) < 1e-4


def chained_rows():
    """Three thousand words, far more than the head, each of which says which word is next."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for i in range(1500):
        at = r.randrange(3000)
        out.append((i, " ".join(words[(at + k) % 3000] for k in range(r.randint(5, 60)))))
    return out


def test_words_outside_the_head_have_contexts(spark):
    got = M.lm_scores(spark.createDataFrame(chained_rows(), "doc_id long, text string").repartition(3)).where("held_out").collect()
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > -1.2  # a word's share alone is about -3.5


def test_ngrams_are_exact_and_keep_the_sum():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 5, n).tolist() for n in rng.integers(0, 8, 200)]
    after = {k: {} for k in range(3)}
    for t in texts:
        for i, w in enumerate([*t, "end"]):
            one, two = t[i - 1] if i else "begin", (t[i - 2] if i > 1 else "begin") if i else None
            for k, c in enumerate((two, one, (two, one))):
                if k == 1 or i:
                    after[k].setdefault(c, {}).setdefault(w, 0)
                    after[k][c][w] += 1
    weights = np.random.default_rng(1).random((3, M.BINS))
    weights[:, 0] = 0
    for two, one in [*after[2], (0, "new")]:
        words = [*range(5), "end", "unseen"]
        counts = np.array([[after[k].get(c, {}).get(w, 0) for w in words] for k, c in enumerate((two, one, (two, one)))])
        contexts = np.array([[sum(after[k].get(c, {}).values())] * len(words) for k, c in enumerate((two, one, (two, one)))])
        assert math.isclose(M.mixed(np.full(len(words), 1 / len(words)), counts, contexts, weights).sum(), 1)
    # and what a block finds in its totals is the same
    name = lambda w: np.uint64((w + 1) * 0x9E3779B97F4A7C15 % 2**64) if w != "end" else M.END
    tokens = [(i, t, w) for t in texts for i, w in enumerate([*t, "end"])]
    hashes, begins = np.array([name(w) for *_, w in tokens], np.uint64), np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    words, stream = np.unique(hashes, return_inverse=True)
    every, at = np.unique(M.grams(hashes, begins, words, 48), return_inverse=True)
    parts = M.pd.DataFrame({"bucket": [0, -1], "totals": [M.pack(np.bincount(stream)), M.pack(np.bincount(at[: 3 * len(hashes)], minlength=len(every)))], "digest": [M.digest(words), M.digest(every)]})
    vocab = M.Vocabulary(np.array([M.END]), np.array([0]), np.array([200.0]), *[None] * 4)
    count, counts, contexts = M.counts_of(parts, words, stream, begins, vocab, 48)
    for j, (i, t, w) in enumerate(tokens):
        one, two = t[i - 1] if i else "begin", (t[i - 2] if i > 1 else "begin") if i else None
        for k, c in enumerate((two, one, (two, one))):
            if k == 1 or i:
                assert (counts[k, j], contexts[k, j]) == (after[k][c][w], sum(after[k][c].values()))
            else:
                assert contexts[k, j] == 0


def test_ranks_and_packed_keys():
    r = np.random.default_rng(2)
    for n, top, bits in ((0, 10, 64), (1, 10, 64), (5000, 50, 64), (5000, 2**63, 64), (70_000, 2**20, 40), (5000, 2**40, 40)):
        keys = r.integers(0, top, n, dtype=np.int64).astype(np.uint64)
        if top == 2**63:
            keys = np.concatenate([keys, keys[:100] ^ np.uint64(1), keys[:50]])  # alike but for their last bits
        every, at = M.ranked(keys, bits)
        due = np.unique(keys, return_inverse=True)
        assert (every == due[0]).all() and (at == due[1]).all()
        assert (M.wide(M.narrow(every)) == every).all()
        marks = r.random(len(keys) // 2) < 0.5
        if n and bits == 40:
            kinds, counts = M.marked(keys.copy(), marks)
            assert (kinds == every).all() and (counts == np.bincount(at[: len(marks)], marks, len(every))).all()


def test_lm_clashing_names(spark, docs, rows):
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in M.lm_scores(docs.withColumns({"train": docs.text, "held_out": docs.text, "block": docs.text, "bucket": docs.text})).collect()}
    assert got == {i: x[:3] for i, x in brute.unigram(rows).items()}


def test_lm_edges(spark, odd, empty, big_ids):
    assert {r.doc_id for r in M.lm_scores(big_ids).collect()} == {None, BIG, -BIG}
    assert M.lm_scores(empty).count() == 0
    got = {(r.doc_id, r.n_tokens) for r in M.lm_scores(odd).collect()}
    assert got == {(None, 11), (1, 11), (2, 1), (None, 1), (3, 2)}
    held = spark.createDataFrame([(i, "a b") for i in range(200) if brute.crc(i, 7) == 2][:3], "doc_id long, text string")
    assert all((r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) for r in M.lm_scores(held).collect())


def test_ngram_weights_are_fitted_to_every_training_token(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", 4096)  # many blocks
    seen, real = [], M.settled
    monkeypatch.setattr(M, "settled", lambda tally: (seen.append(tally), real(tally))[1])
    docs = spark.createDataFrame([(i, prose(random.Random(i), 60)) for i in range(200)], "doc_id long, text string").repartition(2)
    got = M.lm_scores(docs).collect()
    trained = {r.train_tokens for r in got}
    assert len(seen) == 1 and trained == {n for tally in seen for n in tally.sum((1, 2))} and trained != {0}


def shuffled(spark):
    """The shuffled files that are on disk."""
    every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {x for x in every if "/shuffle_" in x}


def test_shuffles_are_freed_before_the_next_step(spark, monkeypatch):
    """Each step finds no file that an earlier one shuffled; the session's setting is as before."""
    left, old, key = [], shuffled(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def watch(name):
        real = getattr(M, name)

        def run(*args):
            end = time.monotonic() + 10  # executors delete them a little later
            while shuffled(spark) - old and time.monotonic() < end:
                time.sleep(0.1)
            left.append((name, len(shuffled(spark) - old)))
            return real(*args)

        monkeypatch.setattr(M, name, run)

    for name in ("train", "weights_of", "scored"):
        watch(name)
    setting = spark.conf.get(key)
    docs = spark.createDataFrame([(i, prose(random.Random(i), 60)) for i in range(200)], "doc_id long, text string").repartition(2)
    result = M.lm_scores(docs)
    assert left == [("train", 0), ("weights_of", 0), ("scored", 0)] and spark.conf.get(key) == setting
    assert result.count() == result.count() == 200  # it may run twice


def test_gathered_gradients_equal_plain_sums():
    """Rows that occur once, a few times and very often."""
    rng = np.random.default_rng(5)
    for n in (1, 40, 4096):
        rows = np.minimum(rng.zipf(1.3, n), 5000).astype(np.int64)
        gradient = rng.normal(size=(n, 32)).astype(np.float32)
        at, uses, got = M.gathered(rows, gradient)
        due = np.zeros((5001, 32))
        np.add.at(due, rows, gradient)
        assert sorted(at.tolist()) == np.unique(rows).tolist() and (uses == np.bincount(rows)[at]).all()
        assert np.allclose(got, due[at], atol=1e-3)


def test_places_in_order_give_each_key_its_value():
    """Also keys whose bits and places don't fit in one number."""
    rng = np.random.default_rng(7)
    for bits, top in ((40, 1 << 12), (62, 1 << 62)):
        keys = rng.integers(0, top, 5000).astype(np.uint64)
        keys = np.concatenate([keys, keys[:200], keys[:100] ^ np.uint64(1)])
        every, order, new = M.in_order(keys, bits)
        assert (every == np.unique(keys)).all() and (keys[order] == np.sort(keys)).all() and new.sum() == len(every)
        assert (M.spread(every, order, new) == keys).all()


def test_tallies_give_the_weights_of_plain_em():
    rng = np.random.default_rng(3)
    contexts = rng.integers(0, 50, (3, 20_000))
    counts = rng.binomial(contexts, rng.random((3, 20_000)) ** 4)
    p = 10 ** -(1 + 3 * rng.random(20_000))
    got, plain = M.settled(M.tallies(p, counts, contexts)), p
    for k in range(3):
        at, share, w = M.bins(contexts[k]), counts[k] / np.maximum(contexts[k], 1), np.full(M.BINS, 0.5)
        w[0] = 0
        for _ in range(40):
            own = w[at] * share
            w = np.bincount(at, own / (own + (1 - w[at]) * plain), M.BINS) / (np.bincount(at, minlength=M.BINS) + 5)
        assert np.abs(got[k] - w)[: at.max() + 1].max() < 0.002
        plain = M.mixed(plain, counts[k : k + 1], contexts[k : k + 1], got[k : k + 1])

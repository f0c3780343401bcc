"""The learned operators against direct formulas: the draw of op3, the expectation-maximisation of op6, features and fit of op7, recall of near dedup."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polyseq.llm import lang_id, lm_score, quality, simhash
from polyseq.llm._shared import mix

FRAME = "doc_id long, text string"


def test_quality_is_the_ratio_of_two_models_and_a_gumbel_draw(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(40)], int(rng.integers(1, 60)))) for _ in range(150)] + [" ".join(rng.choice([f"z{k}" for k in range(40)], 30)) for _ in range(50)] + [None, "", "w1"]
    df = spark.createDataFrame(list(enumerate(texts)), FRAME)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 200, 2)], "doc_id long, quality int")
    parts = {r.id: r.p for r in labels.select(F.col("doc_id").alias("id"), F.pmod(F.xxhash64("doc_id", F.lit(1)), 4).alias("p")).collect()}
    grams = [Counter(quality._grams(pa.array([t], pa.string()))[0].tolist()) for t in texts]
    every = sum(grams, Counter())
    good = sum((grams[i] for i, p in parts.items() if p > 0 and i < 150), Counter())
    share = good.total() / every.total()
    prior = min(quality.PRIOR, quality.PRIOR_BUCKETS * share * every.total() / len(every))
    ratio = [sum(n * math.log((good[b] + prior) / (every[b] * share + prior)) for b, n in g.items()) for g in grams]
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    noise = lambda h: -math.log(-math.log(((h % (1 << 64) >> 11) + 0.5) / (1 << 53)))
    keys = {i: ratio[i] + noise(h) for i, h in hashes.items()}
    held = [i for i, p in parts.items() if p == 0]
    cut = quality.best_cut(np.array([ratio[i] for i in held]), np.array([i < 150 for i in held]))
    for k in (None, 17, 0, 1000):
        found = {r.doc_id: r for r in quality.judge(df, labels, sample=1000, k=k).collect()}
        assert all(found[i].log_ratio == pytest.approx(ratio[i], abs=1e-9) and found[i].key == pytest.approx(keys[i], abs=1e-9) for i in keys)
        n = min(len(texts), sum(r > cut for r in ratio) if k is None else k)
        assert {i for i, r in found.items() if r.kept} == set(sorted(keys, key=keys.get, reverse=True)[:n])


def em(ratios, rounds=2000):
    x = 0.5
    for _ in range(rounds):
        x = sum(x * r / (x * r + 1 - x) for r in ratios) / len(ratios)
    return x


def test_lm_scores_are_deleted_interpolation(spark):
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(400):
        w, t = 0, []
        for _ in range(int(rng.integers(0, 25))):  # each word likely followed by the next
            w = (w + 1) % 12 if rng.random() < 0.6 else int(rng.integers(0, 12))
            t.append(f"w{w}")
        texts.append(" ".join(t))
    part = [0 if zlib.crc32(str(i).encode()) % 5 == 1 else 2 if zlib.crc32(str(i).encode()) // 5 % 10 == 0 else 1 for i in range(len(texts))]
    tokens = [[*t.split(), "END"] for t in texts]

    def counts(which):
        one, two = Counter(), Counter()
        for t, p in zip(tokens, part, strict=True):
            if p in which:
                one.update(t)
                one["START"] += 1
                two.update(zip(["START", *t[:-1]], t, strict=True))
        return one, two, sum(v for k, v in one.items() if k != "START"), len(one) - 1

    one, two, n, v = counts({1})
    deleted = [(h, w) for t, p in zip(tokens, part, strict=True) if p == 2 for h, w in zip(["START", *t[:-1]], t, strict=True)]
    m = em([one[w] / n * (v + 1) for _, w in deleted])
    lower = lambda w, one=one, n=n, v=v: m * one[w] / n + (1 - m) / (v + 1)
    bucket = lambda c: int(math.floor(math.log2(c)))
    by_bucket: dict[int, list[float]] = {}
    for h, w in deleted:
        if one[h]:
            by_bucket.setdefault(bucket(one[h]), []).append(two[h, w] / one[h] / lower(w))
    weights = lm_score._by_bucket({k: em(r) for k, r in by_bucket.items()})
    one, two, n, v = counts({1, 2})
    p = lambda h, w: (x := weights[bucket(one[h]) + 1] if one[h] else 0.0) * two[h, w] / max(one[h], 1) + (1 - x) * (m * one[w] / n + (1 - m) / (v + 1))
    found = {r.doc_id: r.score for r in lm_score.score_texts(spark.createDataFrame(list(enumerate(texts)), FRAME)).collect()}
    for i, t in enumerate(tokens):
        assert found[i] == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["START", *t[:-1]], t, strict=True)), rel=5e-3)


def test_ftrl_step_is_the_dense_one():
    rng = np.random.default_rng(2)
    size, classes = 30, 3
    model = lang_id.Ftrl(classes, l1=0.02)
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    dense_w = lambda: np.where(np.abs(z) <= model.l1, 0.0, -(z - np.sign(z) * model.l1) / ((model.beta + np.sqrt(n)) / model.rate + model.l2))
    for _ in range(20):
        x = rng.normal(size=(8, size)) * (rng.random((8, size)) < 0.3)
        y = rng.integers(0, classes, 8)
        row, col = np.nonzero(x)
        model.step(col, x[row, col], row, y)
        w = dense_w()
        p = np.exp(x @ w)
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - np.eye(classes)[y]) / len(y)
        z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / model.rate * w
        n += g * g
        assert model.weights(np.arange(size)) == pytest.approx(dense_w(), abs=1e-12)
    assert (model.weights(np.arange(size)) == 0).any()


def folded(text):
    """Characters as they are compared: of one case, ASCII but for letters as spaces."""
    one = lambda c: next(x for x in (c.casefold(), c.lower(), c) if len(x) == 1)
    return "".join(" " if c < "\x80" and not c.isalpha() else one(c) for c in text or "")


def test_language_features_are_shares_of_n_grams():
    texts = ["Ab, ab É", "", "x", "ééé 123 ΣΊΣΥΦΟΣ ß ẞ İ", "a" * 300, "ЖЖ𝒳 日本 ж!􏿿"]

    def code(gram):
        number = 0
        for c in gram:
            number = (number << 21 | ord(c)) & ((1 << 64) - 1)
        return int(mix(mix(np.array([number], np.uint64)) + np.uint64(len(gram)))[0]) % lang_id.BUCKETS

    grams = [Counter(code(folded(t)[k : k + n]) for n in (1, 2, 3) for k in range(len(folded(t)) - n + 1)) for t in texts]
    batch = pa.record_batch({"text": pa.array(texts), "key": pa.array(range(6)), "lang": pa.array(["x"] * 6), "times": pa.array([1] * 6)})
    out = next(lang_id._vectors(iter([batch])))
    for k, g in enumerate(grams):
        assert dict(zip(out["buckets"][k].as_py(), out["shares"][k].as_py(), strict=True)) == pytest.approx({b: c / g.total() for b, c in g.items()}, rel=1e-6)
    seen = next(lang_id._document_frequencies(iter([batch.select(["text"])])))
    found = dict(zip(seen["bucket"].to_pylist(), seen["n"].to_pylist(), strict=True))
    assert found.pop(-1) == 6 and found == dict(sum((Counter(set(g)) for g in grams), Counter()))


def test_temperature_makes_the_held_out_likeliest():
    rng = np.random.default_rng(3)
    true = rng.normal(size=(3000, 4))
    y = np.array([rng.choice(4, p=np.exp(t) / np.exp(t).sum()) for t in true])
    assert lang_id.fit_temperature(true * 5, y) == pytest.approx(5, rel=0.15)


@pytest.mark.parametrize("share", [0.8, 0.85, 0.9, 0.95])
def test_recall_of_near_dedup_among_strangers(spark, share):
    """Pairs a little above each similarity, among texts that share passages with many others: none is lost."""
    rng = np.random.default_rng(int(share * 100))
    own = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 40, n)]
    passages, texts = [own(40) for _ in range(5)], []
    for k in range(40):
        d = passages[k % 5] + own(200)
        cut = int((1 - share) * (len(d) - 4) + 1e-9)
        texts += [" ".join(d), " ".join(d[: len(d) - cut])]
    texts += [" ".join(passages[k % 5] + own(100)) for k in range(300)]
    kept = {r.doc_id for r in simhash.drop_similar(spark.createDataFrame(list(enumerate(texts)), FRAME)).collect()}
    assert kept == {i for i in range(len(texts)) if i >= 80 or i % 2 == 0}


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(5)
    for n in (1, 5, 100, 3000):
        for _ in range(50):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            k = int(0.2 / 1.8 * n + 1e-9)
            b = np.concatenate([a[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])
            x, y = (np.frombuffer(simhash._sketch(v), np.uint64) for v in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_tally_decides_and_loses_no_link(spark):
    """Lists hold pairs that share only five bytes; the tally drops them before any bits are compared, and no pair within two bits."""
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    pairs = []
    for p in prints.tolist():
        for bits in (1, 2, 3, 3, 4):
            q = p ^ sum(1 << int(b) for b in rng.choice(63, bits, replace=False))
            pairs.append((p, q))
    df = spark.createDataFrame(pairs, "u long, v long")
    same = lambda a, b: sum(x == y for x, y in zip(a.to_bytes(8), b.to_bytes(8), strict=True))
    kept = {(r.u, r.v) for r in simhash._retained(df).collect()}
    assert kept == {(u, v) for u, v in pairs if same(u, v) >= 6} and 0 < len(kept) < len(set(pairs))
    assert {(u, v) for u, v in pairs if (u ^ v).bit_count() <= 2} <= kept
    assert all(any(a in left and b in left for left in simhash.LEFT_OUT) for a in range(8) for b in range(8))


@pytest.mark.parametrize("most", [0, 1000])
def test_members_of_lists(spark, monkeypatch, most):
    """Through a sieve so narrow that it lets others through, with the lists broadcast or not."""
    monkeypatch.setattr(simhash, "SIEVE_WORDS", 2)
    monkeypatch.setattr(simhash, "BROADCAST_LISTS", most)
    rng = np.random.default_rng(7)
    hs = rng.integers(-(1 << 63), (1 << 63) - 1, 60).tolist()
    rows = [(int(s), h) for s in range(30) for h in hs if rng.random() < 0.5] * 2
    found = simhash._members(spark.createDataFrame(rows, "set long, h long"), spark.createDataFrame([(h, 5) for h in hs[:20]], "h long, n long")).collect()
    assert sorted((r.h, r.set, r.n) for r in found) == sorted({(h, s, 5) for s, h in rows if h in hs[:20]})


def test_near_dedup_goes_by_the_index_of_fingerprints(spark, monkeypatch):
    """The closest pairs are proposed by SimHash, sets of equal fingerprints included, before any list of shingles; strangers of one fingerprint stay."""
    seen, links = [], simhash._links
    monkeypatch.setattr(simhash, "_links", lambda prints: seen.append(prints.count()) or links(prints))
    rng = np.random.default_rng(11)
    own = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 40, n)]
    line, body = own(21), own(3000)
    texts = [" ".join(line * 200 + own(100)), " ".join(line * 200 + own(100)), " ".join(body), " ".join([*body, "more"])]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert max((prints[a] ^ prints[b]).bit_count() for a, b in ((0, 1), (2, 3))) <= simhash.MOST_BITS
    signed = [simhash._signed(p) for p in prints]
    found = simhash._linked_sets(spark.createDataFrame([*enumerate(signed), (9, signed[2])], "set long, fp long")).collect()
    assert {(0, 1), (2, 3), (2, 9)} == {(r.u, r.v) for r in found}
    kept = {r.doc_id for r in simhash.drop_similar(spark.createDataFrame(list(enumerate(texts)), FRAME)).collect()}
    assert kept == {0, 1, 2} and seen[-1] == len(set(prints))


def test_a_pair_is_not_a_row_for_each_list_that_it_shares(spark):
    """Two sets that share 40 lists, as near copies do, are proposed by the first of them only, and by none beyond whose place they can't share enough."""
    sketch = [0] * simhash.FOLDED
    members = spark.createDataFrame([(h, s, h, s) for h in range(40) for s in (1, 2, 3)], "h long, set long, p int, label long")
    main = spark.createDataFrame([(h, 1, 9) for h in range(40)], "h long, main long, work long")
    sketches = spark.createDataFrame([(s, 200, sketch) for s in (1, 2, 3)], "set long, n int, folded array<long>")
    found = sorted((r.u, r.v) for r in simhash._all_between(members, main, sketches, 0.8).collect())
    assert set(found) == {(1, 2), (1, 3), (2, 3)} and len(found) <= 6
    assert simhash._all_between(members.filter("h > 30"), main, sketches, 0.8).count() == 0

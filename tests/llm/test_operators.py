"""The corpus operators against brute force, on texts with nulls, repeats, ties and odd characters."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from polyseq.llm import bpe, decontaminate, exact_dedup, lang_id, license_scan, lm_score, quality, secret_scan, simhash, token_counts
from polyseq.llm._shared import pack_sorted, unpack_sorted, word_hashes

PATH = public_tokenizers.path("byte_bpe_50k.json")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", None, "a", "  ", "a  b", "a \n\n b\n", "it's we'll they're '' 's''s", "<|endoftext|>", "x <|endoftext|>  <|endoftext|>y", " <|endof", "日本語 テキスト 123४५", " x　y", "𝒳𝒴 a𝒳", "͸abc d", "é" * 300, "a" * 500, "\x00\x01", "ﬁ ½²", "🎉 👩‍👩‍👧", "a\n\nb \t\tc", "token = abcdefgh", "token = abcdefgh"]
EXTRA = "text string, doc_id long, lang string, source string, block string, node long, fp long, digest string, kept boolean, spans string"


def frame(spark, texts, ids=None):
    """A table whose other columns have names that the operators use themselves; a null id and a repeated row among them."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(t, i, "en", None, "b", 1, 2, "d", True, "s") for t, i in zip(texts, ids, strict=True)], EXTRA)


def words(text, pattern="[^\x20\x09-\x0d]+"):
    return re.findall(pattern, (text or "").translate(AZ))


def test_word_hashes_tell_words_apart():
    texts = ["Ab ab  x", None, "", " q", "q\tAB\x0b", "é É", "x"]
    import pyarrow as pa

    for chunk in (3, 1 << 20):
        hashes, sizes = word_hashes(pa.array(texts), chunk=chunk)
        flat = [w for t in texts for w in words(t)]
        assert sizes.tolist() == [len(words(t)) for t in texts]
        assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_packed_numbers_come_back(n):
    keys = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    assert (unpack_sorted(pack_sorted(keys)) == keys).all()


def test_bpe_is_the_librarys(spark):
    tokenizer = Tokenizer.from_file(PATH)
    df = frame(spark, [*ODD, "x", "x"], [*range(len(ODD)), None, None])
    found = bpe.encode_and_decode(df, PATH, block_words=7).collect()
    assert len(found) == len(ODD) + 2
    for r in found:
        text = "x" if r.doc_id is None else ODD[r.doc_id] or ""
        assert r.ids == tokenizer.encode(text, add_special_tokens=False).ids and r.text == text
    assert bpe.encode_and_decode(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("cells", [1, 3, 5_000])
def test_bpe_cells_grow_with_the_words_asked(spark, monkeypatch, cells):
    monkeypatch.setattr(bpe, "CELLS", cells)
    monkeypatch.setattr(bpe, "ASKED_BYTES", 90)
    tokenizer = Tokenizer.from_file(PATH)
    texts = [f"word{k} of{k % 7} the same" for k in range(60)]
    found = {r.doc_id: r for r in bpe.encode_and_decode(frame(spark, texts), PATH, block_words=20).collect()}
    assert all(found[k].ids == tokenizer.encode(t, add_special_tokens=False).ids and found[k].text == t for k, t in enumerate(texts)) and len(found) == len(texts)


def test_token_counts_of_every_prefix(spark):
    tokenizer = Tokenizer.from_file(PATH)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    df = frame(spark, ODD)
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, PATH).collect()} == {i: (len((t or "").encode()), count(t or "")) for i, t in enumerate(ODD)}
    for r in token_counts.truncate(df, PATH, 3).collect():
        text = ODD[r.doc_id] or ""
        assert list(r.prefix_counts) == [count(text[:k]) for k in range(1, len(text) + 1)]
        assert r.kept == text[: max((k for k in range(len(text) + 1) if count(text[:k]) <= 3), default=0)]
    m = token_counts.merges(PATH)
    some = [w.encode() for w in ("thhation", "aaaaaaaa", "--------------------", "    ", "ünïcödé")]
    assert [c.tolist() for c in m.all_prefix_counts(some)] == [m.prefix_counts(w) for w in some]
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0


def test_exact_dedup(spark):
    texts = ["a b", "a  b", "a\tb", "A b", None, "", "x"] + ["hot text"] * 60 + ["a b"]
    ids = [5, 3, 9, 1, 20, 2, None, *range(100, 160), 3]
    found = exact_dedup.group_copies(frame(spark, texts, ids).repartition(3), counters=4).collect()
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for t, i in zip(texts, ids, strict=True):
        groups.setdefault(hashlib.sha256(norm(t).encode()).digest(), []).append(i)
    assert len(found) == len(texts)
    for r in found:
        own = groups[bytes(r.digest)]
        assert r.group_size == len(own) and r.keep_id == min((i for i in own if i is not None), default=None)
    assert Counter(bytes(r.digest) for r in found if r.kept) == Counter(dict.fromkeys(groups, 1))
    kept = exact_dedup.drop_copies(frame(spark, texts, ids))
    assert kept.count() == len(groups) and kept.columns == frame(spark, texts, ids).columns
    assert exact_dedup.group_copies(frame(spark, texts, ids).limit(0)).count() == 0


def test_quality_parts_good_from_bad(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(vocabulary, 60)) for _ in range(300)] + [" ".join(f"{w}!!" for w in rng.choice(vocabulary, 60)) for _ in range(60)] + [None, ""]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.kept for r in quality.judge(df, labels).collect()}
    assert sum(found[i] for i in range(300)) >= 298 and not any(found[i] for i in range(300, 360))
    kept = quality.keep_good(df, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, k in found.items() if k} and kept.columns == df.columns
    assert quality.keep_good(df, labels.limit(0)).count() == len(texts)
    assert quality.judge(df.limit(0), labels).count() == 0


def test_gumbel_keys_draw_in_proportion(spark):
    keys = spark.range(200000).select(quality.gumbel(F.xxhash64("id")).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert keys[0] == pytest.approx(0.5772, abs=0.02) and keys[1] == pytest.approx(1.2825, abs=0.03)
    assert quality._least_key(spark.range(1000).select(F.col("id").cast("double").alias("key")), 10) == pytest.approx(990, abs=1e-3)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secret_scan(spark):
    rng = np.random.default_rng(1)
    parts = ["token", "secret", "api_key", "apikey", "PassWord", "passwd", " ", "=", ":", "'", '"', "abc", "ABCDEF12", "AKIA", "0123456789abcdef", "\n", ".", "é", "AKIA" * 3, "x", "-"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 40)))) for _ in range(1500)] + [None, "", "a" * 100_000, "ghp_" + "Z9" * 18 + " ", "token = token = abcdefgh"]
    found = {r.doc_id: r.spans for r in secret_scan.find_secrets(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in found[i] if s.kind in ("assign", "access", "hex")] == base_spans(t), t
    assert [(s.kind, s.start, s.end) for s in found[1503]] == [("github", 0, 40)]
    assert secret_scan.find_secrets(frame(spark, texts).limit(0)).count() == 0


def test_lm_scores(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"W{k % 40}" for k in range(60)], int(rng.integers(0, 30)))) for _ in range(300)] + [None, "never seen Words"]
    found = lm_score.score_texts(frame(spark, texts)).collect()
    tokens = [[*words(t), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    assert len(found) == len(texts)
    for r in found:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) and -1000 < r.score < 0
    assert lm_score.score_texts(frame(spark, texts).limit(0)).count() == 0
    assert lm_score.mixture_weight(np.array([0.0, 4.0]), np.array([50, 50])) == pytest.approx(1 / 3, abs=1e-3)  # 0.5 / (1 - x) = 1.5 / (1 + 3 x)


def test_lm_contexts_in_a_bucket_that_the_deleted_part_never_met(spark):
    part = lambda i: 0 if zlib.crc32(str(i).encode()) % 5 == 1 else 2 if zlib.crc32(str(i).encode()) // 5 % 10 == 0 else 1
    n = next(n for n in range(50, 1000) if sum(part(i) == 1 for i in range(n)) < 128 <= sum(part(i) > 0 for i in range(n)))
    found = lm_score.score_texts(frame(spark, ["alpha"] * n)).collect()
    assert all(r.score > -0.1 for r in found)  # by single words alone it is 2 log10(1/2)
    assert lm_score._by_bucket({2: 0.5, 4: 0.25})[:8].tolist() == [0.0, 0.5, 0.5, 0.5, 0.5, 0.25, 0.25, 0.25]


def test_lm_ranges_summed_by_part_first(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = frame(spark, [" ".join(rng.choice([f"w{int(k**1.5)}" for k in range(40)], int(rng.integers(0, 30)))) for _ in range(200)] + [None])
    by_id = lambda: sorted(map(tuple, lm_score.score_texts(df).collect()))
    whole = by_id()
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 100)
    one_part = by_id()
    monkeypatch.setattr(lm_score, "PART_BLOCKS", 5)
    monkeypatch.setattr(lm_score, "RANGE_HASHES", 200)
    in_parts = by_id()
    for found in (one_part, in_parts):
        assert [r[:5] for r in found] == [r[:5] for r in whole]
        assert np.array([r[5:] for r in found]) == pytest.approx(np.array([r[5:] for r in whole]))


def test_lm_model_is_the_interpolation(spark):
    texts = ["a b a b a c", "a b", "b a c a", "c a b"] * 30
    df = frame(spark, texts)
    found = {r.doc_id: r for r in lm_score.score_texts(df).collect()}
    one = lambda t: [found[i].score for i in range(len(texts)) if texts[i] == t]
    assert all(max(one(t)) == pytest.approx(min(one(t))) for t in set(texts))
    assert one("a b")[0] > one("c a b")[0] and one("a b")[0] > found[1].base_score


def test_language_id(spark):
    rng = np.random.default_rng(3)
    pools = {"aa": "ka lo mi ren tal", "bb": "žu brž čtvr šrt dně", "cc": "ou eaux tion ment el"}
    langs = [list(pools)[k % 3] for k in range(600)]
    texts = ["".join(rng.choice(pools[x].split(), 40)) + " " + " ".join(rng.choice(pools[x].split(), 20)) for x in langs]
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(texts, langs, strict=True))] + [(600, None, "aa"), (601, "12 34 !", "bb"), (602, "ka lo mi", None), (None, "ka lo", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    found = {r.doc_id: r for r in lang_id.identify(df).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out for i in held)
    assert sum(found[i].lang_pred == langs[i] for i in held) >= 0.98 * len(held)
    assert found[600].lang_pred == found[601].lang_pred == "und" and all(0 <= r.score <= 1 for r in found.values())
    assert lang_id.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in lang_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    model = lang_id.fit(df.filter("doc_id < 600"), F.col("lang"), F.xxhash64("doc_id"))
    assert (model.weights == 0).mean() > 0.9  # sparse


def test_license_scan(spark):
    mit, apache = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["Apache-2.0"]
    whole = license_scan.TEMPLATES["BSD-3-Clause-text"]
    texts = [f"é x {mit} y", f"{apache}\n{apache}", "Released under the old MIT License.", "released UNDER the mit licence", "nothing here", None, "", "under the MIT", "z " * 5000 + mit, "Copyright X\n" + whole.replace(" ", "\n "), mit]
    ids = [*range(10), None]
    rows = license_scan.find_licenses(frame(spark, texts, ids)).collect()
    found = {r.doc_id: [(x.license, round(x.coverage, 2), x.start, x.end) for x in r.licenses] for r in rows}
    assert len(rows) == len(texts)
    assert found[0] == [("MIT", 1.0, 4, 4 + len(mit) - 1)] and texts[0][4 : 4 + len(mit) - 1] == mit[:-1]
    assert [x[0] for x in found[1]] == ["Apache-2.0"] * 2 and found[2] == [("MIT", 1.0, 0, 34)] and found[3] == [("MIT", 0.8, 0, 22)]
    assert not any(found[i] for i in (4, 5, 6, 7)) and [x[0] for x in found[8]] == [x[0] for x in found[None]] == ["MIT"]
    assert {x[:2] for x in found[9]} >= {("BSD-3-Clause-text", 1.0), ("BSD", 1.0)} and not any("MIT" in x[0] for x in found[9])
    assert license_scan.find_licenses(frame(spark, texts).limit(0)).count() == 0


def test_license_scan_finds_notices_that_lack_a_run_of_words():
    import pyarrow as pa

    index = license_scan.Index.build(license_scan.TEMPLATES, 0.8)
    for x in index.templates:
        w, most = [w.decode() for w in x.words], len(x.words) - math.ceil(0.8 * len(x.words))
        sizes, step = (range(1, most + 1), 1) if len(w) < 60 else ((1, most // 2, most), 29)
        texts = [" ".join(["before", *w[:k], *w[k + n :], "after"]) for n in sizes for k in range(0, len(w) - n + 1, step)]
        found = index.candidates(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert x.name in [m["license"] for m in index.find(t.encode(), found.get(i, []))], t


def best_alignment(template, words, diagonal, band):
    """Every chain of matches, by place in the template and in the text: how many, and of equal ones the shortest, then the first."""
    best = {}
    for i, w in enumerate(template):
        for j in range(max(0, diagonal + i - band), min(len(words), diagonal + i + band + 1)):
            if words[j] == w:
                before = [v for (a, b), v in best.items() if a < i and b < j]
                n, start = max(before, default=(0, j))
                best[i, j] = (n + 1, start)
    if not best:
        return 0, 0, 0
    n = max(v[0] for v in best.values())
    length, end = min((j + 1 - v[1], j + 1) for (_, j), v in best.items() if v[0] == n)
    return n, end - length, end


def test_license_alignment_is_the_full_dynamic_program():
    rng = np.random.default_rng(11)
    for _ in range(300):
        template, words_ = ([bytes([97 + int(x)]) for x in rng.integers(0, int(rng.integers(2, 6)), int(n))] for n in rng.integers(1, 14, 2))
        diagonal, band = int(rng.integers(-5, 8)), int(rng.integers(0, 6))
        assert license_scan.align(template, words_, diagonal, band) == best_alignment(template, words_, diagonal, band)


def test_license_candidates_lose_no_match():
    """Words left out here and there, as many as may be missing: each template is still found with the counts that its index asks for."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    index = license_scan.Index.build(license_scan.TEMPLATES, 0.8)
    for x in index.templates:
        w = [y.decode() for y in x.words]
        most = len(w) - math.ceil(0.8 * len(w))
        texts = [" ".join(["so", *[y for k, y in enumerate(w) if k not in gone], "on"]) for gone in (set(rng.choice(len(w), most, replace=False).tolist()) for _ in range(20))] + [" ".join(y for k, y in enumerate(w) if k % 5 != 4 or k // 5 >= most)]
        found = index.candidates(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert x.name in [m["license"] for m in index.find(t.encode(), found.get(i, []))], t


def simhash_of(text):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def component_of(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            m = min(label[i], label[j])
            changed |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    return label


def test_simhash_links_of_two_bits(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 62, 30)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 4)), replace=False)) for b in base for _ in range(30)} | {base[0] ^ k for k in range(1, 200)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    label = {r.v: r.label for r in simhash.components(simhash._links(df)).collect()}
    linked = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = component_of(len(prints), linked)
    groups = lambda of: sorted(sorted(g) for g in {k: [i for i in range(len(of)) if of[i] == k] for k in set(of)}.values())
    assert groups([label.get(s, s) for s in signed]) == groups(want)


def test_simhash_of_texts(spark):
    texts = ["A b c d", "a b c d", "a\tb", "x", None, "", " \n", "q r s t u v", "a b c d e"]
    ids = [7, 3, 11, 5, 6, 2, None, 1, 9]
    found = {(r.doc_id): (r.fp, r.component_id) for r in simhash.near_duplicates(frame(spark, texts, ids)).collect()}
    for t, i in zip(texts, ids, strict=True):
        assert found[i][0] % (1 << 64) == simhash_of(t)
    assert found[7][1] == found[3][1] == 3 and found[6][1] == found[None][1] == found[2][1] == 2
    assert simhash.near_duplicates(frame(spark, texts, ids).limit(0)).count() == 0


def test_similar_texts_leave_one(spark):
    rng = np.random.default_rng(5)
    docs = [[f"w{k}" for k in rng.integers(0, 5000, 120)] for _ in range(40)]
    texts = []
    for d in docs:
        texts.append(" ".join(d))
        near = list(d)
        near[60] = "changed"
        texts += [" ".join(near), " ".join(d[:60] + [f"z{k}" for k in rng.integers(0, 5000, 60)])]
    df = frame(spark, [*texts, None, ""])
    kept = sorted(r.doc_id for r in simhash.drop_similar(df).collect())
    assert kept == [i for i in range(120) if i % 3 != 1] + [120]
    assert simhash.drop_similar(df).columns == df.columns and simhash.drop_similar(df.limit(0)).count() == 0


def shingles_of(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_of(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def first_of_similar(texts):
    sets = [shingles_of(t) for t in texts]
    label = component_of(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if jaccard_of(sets[i], sets[j]) >= 0.8])
    return [i for i in range(len(texts)) if label[i] == i]


@pytest.mark.parametrize("few", [0, 4])
def test_similar_texts_among_strangers(spark, monkeypatch, few):
    """Strangers that share most of their text, pairs among them, and chains of copies; few: whether lists are held against one member first."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = np.random.default_rng(8)
    own = lambda n: [f"w{k}" for k in rng.integers(0, 100000, n)]
    template, texts = own(150), []
    for _ in range(60):
        d = template + own(60)
        near = list(d)
        near[int(rng.integers(150, 205))] = "changed"
        texts += [" ".join(d), " ".join(near)]
    for _ in range(3):
        d = own(200)
        for _ in range(25):
            d = list(d)
            d[int(rng.integers(0, 200))] = own(1)[0]
            texts.append(" ".join(d))
    kept = sorted(r.doc_id for r in simhash.drop_similar(frame(spark, texts)).collect())
    assert kept == first_of_similar(texts) and len(kept) < 70


def test_similar_texts_at_the_least_similarity(spark):
    rng = np.random.default_rng(9)
    texts, shares = [], []
    for n, k in [(104, 20), (94, 18), (184, 36), (84, 15), (49, 9)] * 40:  # n - 4 shingles, of which the cut text has all but k
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
        texts += [" ".join(w), " ".join(w[: n - k])]
        shares.append(jaccard_of(*map(shingles_of, texts[-2:])))
    assert min(shares) == 0.8 and max(shares) < 0.85
    kept = sorted(r.doc_id for r in simhash.drop_similar(frame(spark, texts)).collect())
    assert kept == list(range(0, len(texts), 2))


def test_similar_texts_by_sets_not_by_repeats(spark):
    rng = np.random.default_rng(10)
    own = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 40, n)]
    line, body, cycle = own(13), own(200), own(12)
    texts = [" ".join(line * 50 + own(304)), " ".join(line * 50 + own(304)), " ".join(body + cycle * 2), " ".join(body + cycle * 40)]
    assert jaccard_of(*map(shingles_of, texts[:2])) < 0.1 and jaccard_of(*map(shingles_of, texts[2:])) == 1
    assert sorted(r.doc_id for r in simhash.drop_similar(frame(spark, texts)).collect()) == [0, 1, 2]


def overlaps(text, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(AZ))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        x = split(t)
        n = min(10, len(x))
        for k in range(len(x) - n + 1 if x else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    rng = np.random.default_rng(6)
    item = lambda n: " ".join(rng.choice([f"v{k}" for k in range(50)], n))
    items = [(k, item(int(n))) for k, n in enumerate([30, 12, 10, 9, 4, 1, 25])] + [(7, None), (8, ""), (9, "Été, deux-TROIS")]
    items += [(10, items[0][1])]
    texts = []
    for k in range(120):
        w = items[k % 11][1] or ""
        part = w.split()
        a = int(rng.integers(0, max(1, len(part) - 3)))
        texts.append(item(int(rng.integers(0, 20))) + ". " + " - ".join(part[a:]).upper() + " " + item(5))
    texts += [None, "", "été deux trois", "ÉTÉ deux trois", items[0][1] + " " + items[0][1]]
    df, bench = frame(spark, [*texts, texts[0]], [*range(len(texts)), 0]), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    found = decontaminate.find_overlaps(df, bench).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert (r.n_words, r.n_hit, r["items"]) == overlaps(texts[r.doc_id], items)
        assert r.n_items == len(r["items"])
    clean = decontaminate.drop_contaminated(df, bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(texts) if not overlaps(t, items)[1]} and clean.columns == df.columns
    assert decontaminate.find_overlaps(df.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.find_overlaps(df, bench.limit(0)).collect())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(400)]
    good = [" ".join(rng.choice(vocabulary, 80)) for _ in range(120)]
    bad = [" ".join(f"{w}%%%" for w in rng.choice(vocabulary, 80)) for _ in range(30)]
    near = [g.replace(g.split()[40], "other", 1) for g in good[:5]]
    bench = " ".join(rng.choice(vocabulary, 20))
    texts = [*good, *bad, good[0], good[1], *near, bench + " " + good[9]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(PATH)
    assert sorted(r.doc_id for r in found) == list(range(120))
    assert all(r.ids == tokenizer.encode(texts[r.doc_id]).ids and r.text == texts[r.doc_id] for r in found)

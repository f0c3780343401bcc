"""Toxicity, clusters and the manifest against brute force, planted cases and DuckDB; odd rows, and none."""

import hashlib
import itertools
import math
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from polyseq.llm import clusters, manifest, queries, toxicity

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DATA = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# the manifest

DOCS = "doc_id long, text string, lang string, n_chars long, source string"


def climbed(rows, fan_out=16):
    """doc_id, leaf, subroot, root, digest of the siblings, root by the row with its text lower-cased where 5 divides the crc."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda r: sha("".join(enc(r[c]) for c in manifest.FIELDS))

    def tree(leaves):
        nodes, paths = [([k], d) for k, d in enumerate(leaves)], [[] for _ in leaves]
        while len(nodes) > 1:
            above = []
            for run in itertools.batched(nodes, fan_out):
                for j, (own, _) in enumerate(run):
                    for k in own:
                        paths[k].append(("".join(d for _, d in run[:j]), "".join(d for _, d in run[j + 1 :])))
                above.append((sum((own for own, _ in run), []), sha("".join(d for _, d in run))))
            nodes = above
        return nodes[0][1], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"], digest(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in groups[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order]) if order else ("", [])
    for s, top in zip(order, tops, strict=True):
        for (i, leaf, r), path in zip(groups[s], trees[s][1], strict=True):
            own = dict(r)
            if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and own["text"] is not None:
                own["text"] = own["text"].translate(AZ)
            own = digest(own)
            for left, right in path + top:
                own = sha(left + own + right)
            yield i, leaf, trees[s][0], root, sha("".join(a + b for a, b in path + top)), own, own == root


def checked(df):
    text = F.when(F.crc32(df["doc_id"].cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(df["text"])
    found = manifest.manifest(df, found={"text": text})
    return found.select("doc_id", "leaf", "subroot", "root", manifest.path_digest(F.col("path")), "folded_root", "verified")


ODD = [(k % 7 if k % 3 else None, "T" if k % 2 else None, None, k if k % 2 else None, [None, "", "é", "S", "s2"][k % 5]) for k in range(300)] + [(1, "X" * 300_000, "en", 3, "lone")] + [(5, "Dup", "en", 1, "s")] * 40
MANY = [(k, f"Text {k}", None, 1, f"s{k % 37}") for k in range(330)]


@pytest.mark.parametrize("rows", [ODD, MANY, MANY[:1], [], [(k, "A", None, 1, "one") for k in range(300)]], ids=["odd", "sources", "lone", "none", "one source of three levels"])
def test_manifest_is_the_tree_by_hand(spark, rows):
    df = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in ("g", "lo", "hi", "n", "path", "node", "bucket", "digest", "id", "rid")])
    found = sorted(map(tuple, checked(df).collect()), key=repr)
    assert found == sorted(climbed([r.asDict() for r in df.collect()]), key=repr)
    if rows:
        assert {r[6] for r in found if r[0] is None} <= {True}


def test_manifest_ranks_across_ranges(spark, monkeypatch):
    """Ranges of a few rows, so that a source spans many of them."""
    monkeypatch.setattr(manifest, "RANGE_ROWS", 20)
    rows = [(k, f"T{k}", "x", k, "hot" if k % 3 else f"s{k}") for k in range(200)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    assert sorted(map(tuple, checked(df).collect())) == sorted(climbed([r.asDict() for r in df.collect()]))


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["op12_clusters", "op13_manifest"])
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, DATA)
    relation = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in relation.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(relation.fetchall())


# clusters


def lloyd(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: (r[0] is None, sha(f"2:{r[0]}"), r[1])
    x, c = np.array([v for _, v in kept], dtype=object), [v for _, v in sorted(kept, key=key)[:k]]

    def nearest():
        d = [((x - np.array(row, dtype=object)) ** 2).sum(axis=1) for row in c]
        return [min((d[j][i], j) for j in range(len(c))) for i in range(len(x))]

    for _ in range(rounds):
        best = nearest()
        for j in range(len(c)):
            own = [x[i] for i in range(len(x)) if best[i][1] == j]
            c[j] = [int(s) // len(own) for s in sum(own)] if own else c[j]
    best, inertia = nearest(), defaultdict(int)
    for d, j in best:
        inertia[j] += d
    return [(kept[i][0], j, int(d), int(inertia[j]), int(sum(inertia.values())), c[j]) for i, (d, j) in enumerate(best)]


@pytest.mark.parametrize("rows", [400, 12, 0])
@pytest.mark.parametrize("shards", [1, 2, 5])
def test_clusters_are_lloyds(spark, monkeypatch, rows, shards):
    """Ties, repeated ids and vectors, null ids, vectors that don't count, components of very different size, empty centroids."""
    monkeypatch.setattr(clusters, "BLOCK", 30)
    rng = np.random.default_rng(rows)
    data = [(int(k % 90) if k % 11 else None, [float(v) for v in rng.integers(-3, 4, 64) / 256]) for k in range(rows)]
    if rows == 400:
        data += [(1, None), (2, [1.0] * 63), (3, [1.0] * 65), (4, [None] + [1.0] * 63), (5, [float("nan")] * 64), (6, [float("-inf")] * 64), (7, [])]
        data += [(7, [0.1] * 64)] * 60 + [(8, [500_000.0] * 64), (9, [-500_000.0] * 64), (10, [300.25] * 64)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in ("block", "shard", "ids", "x", "cluster", "distance", "best")])
    found = [tuple(r) for r in clusters.cluster(df, shards=shards).collect()]
    assert sorted(found, key=repr) == sorted(lloyd([(r.vec_id, r.embedding) for r in df.collect()]), key=repr)


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="a component lies beyond"):
        clusters.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_distances_beyond_floats_are_exact():
    x = np.array([[clusters.LARGEST, -clusters.LARGEST + 1] * 32, [0, 1] * 32], np.int64)
    assert clusters.squared_distances(x, -x).tolist() == [[sum((a + b) ** 2 for a, b in zip(p, q, strict=True)) for q in x.tolist()] for p in x.tolist()]


# toxicity


def apart(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours between two words, no letter twice."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return int(d[-1, -1])


def test_automaton_is_the_distance():
    rng = np.random.default_rng(5)
    word = lambda least, most: "".join(rng.choice(list("abc"), int(rng.integers(least, most))))
    terms = [toxicity.Term(t, False) for t in {word(3, 12) for _ in range(60)}] + [toxicity.Term("abc", True), toxicity.Term("abcab", True)]
    automaton = toxicity.Automaton(terms, kept=300)
    for w in [word(1, 13) for _ in range(1500)]:
        wanted = {(k, d) for k, t in enumerate(terms) if not t.stem and (d := apart(w, t.text)) <= toxicity.errors_allowed(t.text)}
        wanted |= {(k, 0) for k, t in enumerate(terms) if t.stem and w.startswith(t.text) and len(w) > len(t.text)}
        best = {}
        for k, e in automaton.matches(w):
            best[k] = min(e, best.get(k, 9))
        assert set(best.items()) == wanted, w


BAD = ("blockhead", "nitwit", "rotter", "scoundrel", "grumbolian")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    plain = ["".join(rng.choice(list("aeioulmnrst"), int(rng.integers(2, 9)))) for _ in range(400)]
    docs, labels = [], []
    for k in range(900):
        words = list(rng.choice(plain, int(rng.integers(20, 200))))
        toxic = k % 6 == 0
        if toxic:
            for _ in range(int(rng.integers(2, 6))):
                own = BAD[int(rng.integers(5))]
                words.insert(int(rng.integers(len(words))), f"grumbo{rng.choice(list('abcde'))}{rng.choice(plain)}" if own == "grumbolian" else own)
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    clean = " ".join(plain[:60])
    docs += [(5000, f"{clean} nitwitt rottre {clean}"), (5001, f"{clean} N1TWIT and bl0ckhead {clean}"), (5002, f"{clean} scouuuuundrel nit*wit {clean}"), (5003, f"{clean} grumbozz grumboyy {clean}")]
    docs += [(6000, clean), (6001, None), (6002, ""), (6003, "  \n"), (6004, f'{clean} he said "nitwit" to none {clean}'), (6005, f"{clean} nitwit {clean}"), (6006, clean + " rotten grumb " + clean), (None, clean), (6000, clean)]
    docs += [(7000, "x" * 400_000 + " nitwit rotter blockhead scoundrel"), (7001, "nitwit rotter blockhead scoundrel " + f"{clean} " * 3)]
    spark_docs = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("rid", "toxic", "id", "score", "hits", "h0", "term")])
    return spark_docs, spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (4, 1, 7), (99_999, 1, 1)], "doc_id long, quality int, toxic int").withColumn("id", F.lit(2))


def test_toxicity_of_planted_texts(spark, corpus):
    docs, labels = corpus
    rows = toxicity.judge(docs, labels.filter("doc_id is null or doc_id % 5 <> 0")).collect()
    assert len(rows) == docs.count()
    score = {r.doc_id: r.score for r in rows}
    held = [k for k in range(0, 900, 5)]
    assert all((score[k] >= 0.5) == (k % 6 == 0) for k in held)
    assert all(score[k] >= 0.5 for k in (5000, 5001, 5002, 5003, 7000, 7001)), {k: score[k] for k in score if k and k >= 5000}
    assert all(score[k] < 0.5 for k in (6000, 6001, 6002, 6003, 6006, None))
    assert score[6004] < score[6005] and score[6001] == score[6002] == score[6000]
    hits = {r.doc_id: r.hits for r in rows}
    assert [h.word for h in hits[5000]] == ["nitwitt", "rottre"] and hits[6004][0].context < 0.5 < hits[6005][0].context
    assert len([r for r in rows if r.doc_id == 6000]) == 2


def test_toxicity_without_labels_or_rows(spark, corpus):
    docs, labels = corpus
    none = labels.filter("toxic = 0")
    assert {(r.score, len(r.hits)) for r in toxicity.judge(docs.limit(9), none).collect()} == {(0.0, 0)}
    assert toxicity.judge(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.judge(docs.limit(3), labels.limit(0)).collect()} == {0.0}


def test_copies_of_a_toxic_text_teach_no_words(spark, corpus):
    """A third of the labelled texts are near copies of one toxic text; its plain words are no terms."""
    docs, labels = corpus
    base = docs.filter("doc_id = 0").first().text + " " + docs.filter("doc_id = 1").first().text
    copies = spark.range(10_000, 10_450).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " tail"), F.col("id")).alias("text"))
    more = labels.select("doc_id", "toxic").union(copies.select("doc_id", F.lit(1)))
    model = toxicity.fit(docs.select("doc_id", "text").union(copies), more)
    assert {t.text for t in model.lexicon.terms if not t.stem} == set(BAD[:4])
    assert [t.text for t in model.lexicon.terms if t.stem] == ["grumbo"]


def test_quotation_learned_from_labels(spark, corpus):
    """Where labelled texts quote terms and aren't toxic, quotation marks take more off than before."""
    docs, labels = corpus
    quotes = spark.range(20_000, 20_120).select(F.col("id").alias("doc_id"), F.concat(F.lit("the minutes of day "), F.col("id"), F.lit(' say "nitwit" and "rotter" were words of '), F.col("id") * 7, F.lit(" of the clerk "), F.col("id") * 3).alias("text"))
    both = docs.select("doc_id", "text").union(quotes)
    model = toxicity.fit(both, labels.select("doc_id", "toxic").union(quotes.select("doc_id", F.lit(0))))
    before = toxicity.fit(docs, labels)
    assert model.lexicon.quoted > before.lexicon.quoted


def test_query_scores_held_out_labels(spark):
    found = queries.op11_toxicity(spark, "/root/testdata/sf0.1") if Path("/root/testdata/sf0.1").exists() else None
    if found is None:
        pytest.skip("no test tables here")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.97 * len(rows) and sum(r.predicted and r.toxic for r in rows) >= 0.85 * sum(r.toxic for r in rows)

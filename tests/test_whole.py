"""Measures of whole documents and networks made from sequences, against maps, direct sums and searches by hand."""

import itertools
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyseq.functions.residues import ALPHABET, STICKERS, energy_matrix
from polyseq.operators import fitting, maps, moments, networks, sequences
from polyseq.operators.moments import dealt


@pytest.fixture(scope="module")
def seqs(spark):
    rng = np.random.default_rng(4)
    rows = [(f"r{n}", "".join(rng.choice(list(ALPHABET), n))) for n in (1, 2, 3, 7, 20, 60, 133)]
    rows += [("flat", "A" * 40), ("none", "GGSSGG"), ("one", "GYG"), ("repeat", "YGRGS" * 12), ("dense", "YFWRK" * 9)]
    return spark.createDataFrame(rows, "name string, seq string").cache()


@pytest.fixture(scope="module")
def rows(spark, seqs):
    return maps.map_rows(seqs, energy_matrix(spark)).cache()


@pytest.fixture(params=[4096, 10])
def parts(request, monkeypatch):
    """Whole sequences at a time, and a few places."""
    monkeypatch.setattr(moments, "STEP", request.param)
    monkeypatch.setattr(moments, "CELLS", 40 * request.param)


def by_name(df):
    return {r.name: r for r in df.collect()}


def test_moments_are_the_maps(spark, seqs, rows, parts):
    found, masked = (by_name(moments.map_moments(seqs, energy_matrix(spark), mask=k)) for k in (None, 5))
    banded = {r.name: r for r in maps.map_statistics(maps.map_rows(seqs, energy_matrix(spark), mask=5)).collect()}
    for r in maps.map_statistics(rows).collect():
        x, y = found[r.name], masked[r.name]
        assert (x.mean, x.std, x.total, x.off_diagonal_mean) == tuple(pytest.approx(v, abs=1e-10) for v in (r.mean, r.std, r.total, r.off_diagonal_mean))
        assert (x.shift, x.scale) == (pytest.approx(r.mean, abs=1e-12), pytest.approx(r.std, abs=1e-10))
        assert (y.shift, y.scale) == (pytest.approx(banded[r.name].mean, abs=1e-12), pytest.approx(banded[r.name].std, abs=1e-8))
    assert found["flat"].std < 1e-12


def test_sums_by_separation(spark, seqs):
    raw = maps.map_rows(seqs, energy_matrix(spark), 0.0).cache()
    found = by_name(moments.separation_energies(seqs, energy_matrix(spark)))
    wanted = {}
    for r in maps.energy_by_separation(raw).collect():
        wanted.setdefault(r.name, {})[r.d] = r.energy
    for name, x in found.items():
        assert x.by_separation == pytest.approx([wanted[name][d] for d in sorted(wanted.get(name, {}))], abs=1e-9)
    for r in maps.chain_energy(raw).collect():
        assert found[r.name].chain == pytest.approx(r.energy, abs=1e-9)
    for r in maps.contact_energy(raw).collect():
        assert found[r.name].contact == pytest.approx(r.energy, abs=1e-9)


def test_local_densities(spark, seqs, rows, parts):
    found = by_name(moments.local_densities(seqs, energy_matrix(spark), window=3))
    for r in maps.local_density(rows, 3).collect():
        assert found[r.name].density[r.c] == pytest.approx(r.density, abs=1e-12)
    assert all(len(x.density) == len(s.seq) for x, s in zip(found.values(), seqs.collect(), strict=True))


@pytest.mark.parametrize("change", ["all", "one", "none"])
def test_differences_are_those_of_maps(spark, seqs, rows, parts, change):
    y = F.col("seq") if change == "none" else F.regexp_replace("seq", "Y", "S") if change == "all" else F.concat(F.lit("W"), F.expr("substring(seq, 2)"))
    both = seqs.select("name", y.alias("seq"), F.col("seq").alias("reference"))
    d = maps.differences(maps.map_rows(both.select("name", "seq"), energy_matrix(spark)), rows).cache()
    found = moments.map_differences(both, energy_matrix(spark)).cache()
    x = by_name(found)
    for r in maps.perturbation(d).collect():
        assert {c: x[r.name][c] for c in ("total", "rmsd", "low", "high", "mean_abs", "changed")} == {c: pytest.approx(r[c], abs=1e-9) for c in ("total", "rmsd", "low", "high", "mean_abs", "changed")}, r.name
    for r in maps.profile_array(d).collect():
        assert x[r.name].profile == pytest.approx(r.p, abs=1e-12)
    top = {(r.name, r.rank): r.i for r in maps.top_perturbed(d, 4).collect()}
    assert {(r.name, r.rank): r.i for r in moments.top_places(found, 4).collect()} == top


def test_differences_of_unequal_lengths_raise(spark):
    df = spark.createDataFrame([("a", "YS", "YSS")], "name string, seq string, reference string")
    with pytest.raises(Exception, match="maps of different size"):
        moments.map_differences(df, energy_matrix(spark)).collect()


def test_projections(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list(ALPHABET), int(rng.integers(5, 90)), p=rng.dirichlet(np.ones(20)))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "name int, seq string")
    f = np.array([[t.count(a) / len(t) for a in ALPHABET] for t in texts])
    centred = f - f.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    vt = vt[:3] * np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])[:, None]
    found = {r.name: r.projection for r in fitting.composition_projections(df).collect()}
    assert all(found[k] == pytest.approx(list(centred[k] @ vt.T), abs=1e-9) for k in found) and len(found) == 80
    assert [r.explained for r in fitting.composition_components(df).orderBy("component").collect()] == pytest.approx(list(s[:3] ** 2 / (s**2).sum()))
    assert fitting.composition_projections(df.limit(0)).count() == 0


def graph_of(energies, places, threshold, separation=4):
    """Neighbours by hand."""
    n = len(places)
    return {i: [j for j in range(n) if abs(places[i] - places[j]) >= separation and round(energies[places[i], places[j]], 12) < round(threshold, 12)] for i in range(n)}


def walk(near, s):
    steps, todo = {s: 0}, deque([s])
    while todo:
        x = todo.popleft()
        for y in near[x]:
            if y not in steps:
                steps[y] = steps[x] + 1
                todo.append(y)
    return steps


def shortest(near, a, b, steps):
    if a == b:
        return [[b]]
    return [[a, *p] for y in near[a] if steps[a].get(b) == 1 + steps[y].get(b, -9) for p in shortest(near, y, b, steps)]


@pytest.fixture(scope="module")
def energies(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.name, np.zeros((r.n, r.n)))[r.i] = r.e
    return out


@pytest.fixture(params=["whole", "blocks"])
def sizes(request, monkeypatch):
    if request.param == "blocks":
        monkeypatch.setattr(networks, "BLOCK", 5)
        monkeypatch.setattr(networks, "CELLS", 30)
        monkeypatch.setattr(networks, "WHOLE", 9)


@pytest.mark.parametrize("stickers", [True, False])
def test_searches_triangles_and_flows_by_hand(spark, seqs, energies, sizes, stickers):
    m = energy_matrix(spark)
    chosen = seqs.filter("length(seq) <= 60")
    limit = networks.auto_threshold(chosen, m)
    found = networks.searches(limit, m, stickers=stickers, flows=True).cache()
    paths, between = by_name(networks.path_statistics(found)), {(r.name, r.i): r.betweenness for r in networks.betweenness(found).collect()}
    histogram = {(r.name, r.steps): r.pairs for r in networks.distance_histogram(found).collect()}
    near_by = {(r.name, r.i): r for r in networks.neighbours(limit, m, stickers=stickers).collect()}
    closed = by_name(networks.clustering_coefficient(networks.neighbours(limit, m, stickers=stickers)))
    for r in limit.collect():
        places = [i for i, a in enumerate(r.seq) if a in STICKERS or not stickers]
        if not places:
            assert r.name not in paths
            continue
        near = graph_of(energies[r.name], places, r.threshold)
        steps = {s: walk(near, s) for s in near}
        roots = {s: min(steps[s]) for s in near}
        sizes_ = {k: [s for s in near if roots[s] == k] for k in set(roots.values())}
        big = max(sizes_.values(), key=lambda x: (len(x), -x[0]))
        lengths = [d for s in big for d in steps[s].values() if d]
        x = paths[r.name]
        assert (x.n_components, x.largest, x.path_length) == (len(sizes_), len(big), pytest.approx(np.mean(lengths) if lengths else 0.0))
        counts = {}
        for s in near:
            for v, d in steps[s].items():
                if v > s:
                    counts[d] = counts.get(d, 0) + 1
        assert {k: c for (name, k), c in histogram.items() if name == r.name} == counts
        triangles = {i: sum(k in near[j] for j, k in itertools.combinations(near[i], 2)) for i in near}
        assert {places[i]: (len(near[i]), triangles[i]) for i in near} == {i: (y.degree, y.triangles) for (name, i), y in near_by.items() if name == r.name}
        triples = sum(len(x) * (len(x) - 1) / 2 for x in near.values())
        assert closed[r.name].clustering == pytest.approx(sum(triangles.values()) / triples if triples else 0.0)
        if len(places) <= 30:
            score = dict.fromkeys(near, 0.0)
            for a, b in itertools.permutations(near, 2):
                if b in steps[a]:
                    ways = shortest(near, a, b, steps)
                    for way in ways:
                        for i in way[1:-1]:
                            score[i] += 1 / len(ways)
            n = len(places)
            for i in near:
                assert between[r.name, places[i]] == pytest.approx(score[i] / ((n - 1) * (n - 2)) if n > 2 else 0.0, abs=1e-12)


def test_thresholds_and_entropies(spark, seqs, energies, sizes):
    m = energy_matrix(spark)
    limit, entropy = by_name(networks.auto_threshold(seqs, m)), by_name(networks.interaction_entropy(seqs, m))
    for s in seqs.collect():
        places = [i for i, a in enumerate(s.seq) if a in STICKERS]
        pairs = [(i, j) for i, j in itertools.combinations(places, 2)]
        far = [energies[s.name][i, j] for i, j in pairs if j - i >= 4]
        assert limit[s.name].threshold == pytest.approx(np.percentile(far, 25) if far else 0.0, abs=1e-12)
        e = [energies[s.name][i, j] for i, j in pairs]
        if len({round(x, 9) for x in e}) > 20:
            p = np.histogram(e, 20)[0] / len(e)
            assert entropy[s.name].entropy == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum(), abs=0.02)
        elif len(e) < 2:
            assert entropy[s.name].entropy == 0.0


@pytest.mark.parametrize("held", [1, 50, 10_000])
def test_selection_is_sorting(held):
    rng = np.random.default_rng(held)
    for x in (rng.normal(size=5000), rng.integers(0, 4, 5000).astype(float), np.full(300, 0.1), np.concatenate([rng.normal(size=999), [1e9]])):
        ranks = [0, 1, len(x) // 4, len(x) // 2, len(x) - 2, len(x) - 1]
        assert networks.selected(lambda x=x: iter(np.array_split(x, 7)), ranks, held, 16) == np.sort(x)[ranks].tolist()


def diagram(d):
    """Deaths of components and (birth, death) of loops, by sorted edges, and by all third nodes."""
    n = len(d)
    label, edges, deaths, tree = list(range(n)), sorted((d[i][j], i, j) for i, j in itertools.combinations(range(n), 2)), [], set()
    for x, i, j in edges:
        if label[i] != label[j]:
            deaths.append(x)
            tree.add((i, j))
            old, new = label[j], label[i]
            label = [new if k == old else k for k in label]
    loops = []
    for x, i, j in edges:
        if (i, j) not in tree and n > 2:
            death = min(max(x, d[i][k], d[j][k]) for k in range(n) if k not in (i, j))
            if death > x:
                loops.append((x, death))
    return sorted(deaths), sorted(loops)


def test_trees_and_loops_by_hand(sizes):
    class Given:
        def __init__(self, d):
            self.d, self.net = np.array(d, float), type("N", (), {"n": len(d)})

        def rows(self, a, b, first=0):
            return self.d[a:b, first:]

        def tree(self):
            return networks.spanning_tree(len(self.d), lambda i: self.d[i])

    rng = np.random.default_rng(8)
    square = [[0, 1, 2, 1], [1, 0, 1, 2], [2, 1, 0, 1], [1, 2, 1, 0]]
    cases = [square, [[0, 1, 1], [1, 0, 1], [1, 1, 0]], [[0, 1, 3], [1, 0, 2], [3, 2, 0]], [[0.0]], [[0, 5], [5, 0]]]
    for n in (6, 11, 17):
        for top in (3, 100):
            x = rng.integers(0, top, (n, n)).astype(float)
            cases.append(np.minimum(x, x.T))
    for case in cases:
        given = Given(case)
        deaths, loops = diagram(case)
        assert sorted(given.tree()[2].tolist()) == deaths
        births, ends = np.concatenate([networks.closing(given, a, min(a + 4, len(case))) for a in range(0, len(case), 4)], axis=1)
        assert sorted(zip(births.tolist(), ends.tolist(), strict=True)) == loops
    assert diagram(square)[1] == [(1, 2)]


def test_diagrams_of_sequences(spark, seqs, energies, sizes):
    for method in networks.METHODS:
        found = {}
        for r in networks.persistence_diagrams(seqs, energy_matrix(spark), method=method).collect():
            found.setdefault(r.name, ([], []))[r.dim].append(r.death if r.dim == 0 else (r.birth, r.death))
        spans = by_name(networks.distance_spans(seqs, energy_matrix(spark), method=method))
        for s in seqs.collect():
            places = [i for i, a in enumerate(s.seq) if a in STICKERS]
            if not places:
                assert s.name not in found
                continue
            e = np.round(energies[s.name][np.ix_(places, places)], 12)
            d = -e if method == "negated" else e - e.min()
            if method == "rank":
                order = sorted((e[i, j], i, j) for i, j in itertools.combinations(range(len(places)), 2))
                d = np.zeros(e.shape)
                for k, (_, i, j) in enumerate(order):
                    d[i, j] = d[j, i] = k
            far = np.abs(np.subtract.outer(places, places)) >= 4
            most = d.max() if method != "rank" else len(places) * (len(places) - 1) / 2 - 1
            d = np.where(far, d, most + 1)
            deaths, loops = diagram(d.tolist())
            assert sorted(found[s.name][0]) == pytest.approx([*deaths, float("inf")])
            assert sorted(found[s.name][1]) == [pytest.approx(x) for x in loops]
            upper = d[np.triu_indices(len(places), 1)]
            if (upper > 0).any():
                assert (spans[s.name].low, spans[s.name].high) == (pytest.approx(upper[upper > 0].min()), pytest.approx(upper.max()))


def test_a_document_of_a_hundred_thousand_letters(spark):
    """Linear measures of a very long text, and the quantile and entropy of its sticker pairs, of which there are millions."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("long", "".join(rng.choice(list(ALPHABET), 100_000, p=np.r_[np.full(19, 0.0515), 0.0215])))], "name string, seq string")
    m = energy_matrix(spark)
    x = moments.linear_energies(df, m).first()
    y = moments.map_moments(df, m, mask=5).first()
    assert x.n == 100_000 and len(x.profile) == 100_000 and y.mean == pytest.approx(np.mean(x.profile)) and y.scale > 0
    g = moments.separation_energies(df, m).first()
    counts = np.array([df.first().seq.count(a) for a in ALPHABET], float)
    assert sum(g.by_separation) == pytest.approx((counts @ np.array(m) @ counts - counts @ np.diag(m)) / 2, rel=1e-9)
    some = df.select("name", F.expr("substring(seq, 1, 20000)").alias("seq"))
    limit = networks.auto_threshold(some, m).first().threshold
    net = networks.Network(some.first().seq, np.array(m), maps.gaussian_weights(2.0))
    below, total = (sum(int(f(e)) for e in net.pairs(4)) for f in (lambda e: (e < limit).sum(), lambda e: e.size))
    assert abs(below - 0.25 * (total - 1)) <= 1.5 and total > 10_000_000


def test_inputs_of_few_partitions_are_dealt_out(spark):
    df = spark.range(100).select(F.col("id").alias("name"), F.lit("Y").alias("seq"))
    n = spark.sparkContext.defaultParallelism
    assert dealt(df.coalesce(1), "name", "seq").rdd.getNumPartitions() == n and dealt(df.repartition(2 * n), "name").rdd.getNumPartitions() == 2 * n
    assert sequences.with_counts(df).count() == 100


def test_trees_take_few_rounds():
    """All nodes' rows are asked for together, again only where needed: not a call for each node; with ties, loops but for rounding, and parts that hang together by nothing."""
    rng = np.random.default_rng(3)
    for top, holes in ((10**9, 0), (3, 0), (50, 0.98)):
        x = rng.integers(0, top, (300, 300)).astype(float)
        x = np.where(rng.random(x.shape) < holes, np.inf, x)
        x, calls = np.minimum(x, x.T), []
        u, v, d = networks.spanning_tree(300, lambda i, x=x, calls=calls: calls.append(len(i)) or x[i])
        label, edges = list(range(300)), []
        for w, i, j in sorted((x[i, j], i, j) for i, j in itertools.combinations(range(300), 2) if np.isfinite(x[i, j])):
            if label[i] != label[j]:
                edges.append((i, j, w))
                label = [label[i] if k == label[j] else k for k in label]
        assert list(zip(u.tolist(), v.tolist(), d.tolist(), strict=True)) == edges
        assert len(calls) < 15 and sum(calls) < 8 * 300
    noisy = np.ones((60, 60)) + rng.random((60, 60)) * 1e-15  # an edge isn't quite alike from both ends
    assert len(networks.spanning_tree(60, lambda i: noisy[i])[0]) == 59
    assert networks._forest(np.array([0, 1, 2]), np.array([1, 2, 0]), np.array([2, 0, 1])).tolist() == [2, 0]


def test_sweeps_of_one_pair(spark):
    """A single energy spans nothing, whichever end it is made from."""
    rng = np.random.default_rng(6)
    other = [a for a in ALPHABET if a not in STICKERS]
    texts = ["".join(rng.choice(other, 8)) + "Y" + "".join(rng.choice(other, 6)) + "K" + "".join(rng.choice(other, 9)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "name int, seq string")
    x = networks.percolation_curve(df, energy_matrix(spark)).groupBy("name").agg((F.max("threshold") - F.min("threshold")).alias("span"))
    assert [r.span for r in x.collect()] == pytest.approx([0.2] * 40)


def test_thresholds_make_pairs_once(spark, monkeypatch):
    """Energies that can be held are made once, and pairs are counted without them."""
    net = networks.Network("YGRGSKWFAYYRK" * 5, np.array(energy_matrix(spark)), maps.gaussian_weights(2.0))
    assert [net.count(k) for k in (1, 4, 9, 99)] == [sum(e.size for e in net.pairs(k)) for k in (1, 4, 9, 99)]
    assert net.span(4) == pytest.approx(networks._extremes(net.pairs(4))[1:])
    df, m = spark.createDataFrame([("a", "YGRGSKWFAYYRK" * 5)], "name string, seq string"), energy_matrix(spark)
    whole = networks.auto_threshold(df, m).first().threshold
    monkeypatch.setattr(networks, "CELLS", 50)
    assert networks.auto_threshold(df, m).first().threshold == pytest.approx(whole, abs=1e-12)


def test_representations_are_one_pass(spark):
    """No joins of representations: all entries lie in one row; they are those of the tables of each representation."""
    from polyseq.operators import segments

    df, m = spark.createDataFrame([("a", "YGRGSKWFAYDDEERK"), ("b", "ACDEFGHIKLMNPQRSTVWYYY")], "name string, seq string"), energy_matrix(spark)
    x = fitting.representations(df, m)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    rows = [np.array(r.x) for r in x.collect()]
    tables = [by_name(t) for t in (fitting.composition_theta(df), segments.theta_sticker(df), segments.theta_classes(df), fitting.pair_theta(df), segments.uniform_energy(df, m))]
    for row, s in zip(rows, df.collect(), strict=True):
        parts = [tables[0][s.name].theta, tables[1][s.name][1:], tables[2][s.name][1:], tables[3][s.name].theta, tables[4][s.name][1:]]
        assert row * len(s.seq) ** 2 == pytest.approx([v for p in parts for v in p], abs=1e-9)


def test_middle_changed_stays_in_its_row(spark):
    from polyseq.operators import variants

    df = spark.createDataFrame([(k, s) for k, s in enumerate(["Y", "AYGYCY", "AAA", "YY", "YYAYYA", "GY"])], "name int, seq string")
    x = variants.middle_changed(df)
    assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
    base = {(r.name, r.variant): r.seq for r in variants.base_variants(df).collect()}
    assert all((r.seq, r.reference) == (base[r.name, "MidY_to_S"], base[r.name, "WT"]) for r in x.collect())


def test_texts_are_cleaned_once(spark):
    """The condition on rows doesn't make the sequence a second time."""
    from polyseq.sources import feeds

    df = spark.createDataFrame([(1, "a b.c"), (2, None), (3, "?! 12 jou"), (4, ""), (5, "\näY")], "doc_id int, text string")
    x = feeds.sequences(df, "doc_id")
    assert {r.name: r.seq for r in x.collect()} == {1: "AC", 5: "Y"}
    assert x._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace") == 1


def test_soft_rows_of_vectors(seqs):
    """Local densities weight the residues' entries of the energies' eigenvectors, of which there are fewer than residues, and hand arrays on as such."""
    vectors = np.random.default_rng(2).normal(size=(20, 6))
    for s in seqs.collect():
        idx, w = maps._numbered(s.seq), maps.gaussian_weights(2.0)
        assert moments.soft_rows(idx, w, 0, len(idx), 3, vectors) == pytest.approx(moments.soft_rows(idx, w, 0, len(idx), 3) @ vectors, abs=1e-12)
    assert moments._lists((np.array([1.0, 2.0]), np.zeros(0), np.array([3.0]))).to_pylist() == [[1.0, 2.0], [], [3.0]]


@pytest.mark.parametrize("cells", [1, 1_000_000])
def test_transforms_are_little_longer_than_needed(monkeypatch, cells):
    monkeypatch.setattr(moments, "CELLS", cells)
    assert all(n <= moments.transform_size(n) <= max(1.2 * n, n + 2) for n in range(2, 3000))
    rng = np.random.default_rng(12)
    m = rng.normal(size=(20, 20))
    values, vectors = np.linalg.eigh(m + m.T)
    for n in (1, 2, 33, 130):
        s = "".join(rng.choice(list(ALPHABET), n))
        idx = maps._numbered(s)
        wanted = [sum((m + m.T)[idx[k], idx[k + d]] for k in range(n - d)) for d in range(n)]
        assert moments.separation_sums(s, values, vectors) == pytest.approx(wanted, abs=1e-9)

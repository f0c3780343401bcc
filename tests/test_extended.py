"""Known values and small cases of graphs, persistence, factors, representations, registries and the network."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyseq.functions.residues import ALPHABET, energy_matrix
from polyseq.operators import fitting, graph, hamiltonian, maps, moments, networks, segments, sequences, variants
from polyseq.sources import feeds

TOPOLOGY = {
    "n_contacts": 1539, "graph_density": 0.06752665525865473, "mean_degree": 14.383177570093459, "max_degree": 100, "sticker_n_contacts": 94, "sticker_graph_density": 0.24867724867724866, "sticker_clustering_coefficient": 0.5782442748091603, "sticker_mean_degree": 6.714285714285714,
    "sticker_avg_path_length": 1.5052631578947369, "sticker_n_components": 9, "percolation_threshold": -0.04409675584667565, "giant_component_onset": -0.04265833536940686, "max_betweenness": 0.07161311818174564, "mean_betweenness": 0.009768009768009771,
}


@pytest.fixture(scope="module")
def wt(spark):
    seqs = feeds.registry(spark).filter("name = 'WT'").select("name", F.col("sequence").alias("seq")).cache()
    return seqs, maps.map_rows(seqs, energy_matrix(spark)).cache()


def test_topology_metrics(spark, wt):
    found = hamiltonian.topology_metrics(wt[0], energy_matrix(spark)).first().asDict()
    assert {k: found[k] for k in TOPOLOGY} == {k: pytest.approx(v) for k, v in TOPOLOGY.items()}


def test_factors_are_the_map(spark, wt):
    """Sums by factors against sums over the map, also of one residue and of sequences without stickers."""
    seqs = wt[0].unionByName(spark.createDataFrame([("a", "Y"), ("b", "GG"), ("c", "YG"), ("d", "RKDEYFW" * 5)], "name string, seq string"))
    rows = maps.map_rows(seqs, energy_matrix(spark)).cache()
    found = {r.name: r for r in moments.linear_energies(seqs, energy_matrix(spark)).collect()}
    for r in maps.delta_g(rows).join(maps.total_energy(rows), "name").collect():
        x = found[r.name]
        assert (x.ss, x.ll, x.cross, x.total, x.mean) == tuple(pytest.approx(r[c], abs=1e-12) for c in ("ss", "ll", "cross", "total", "mean"))
    for r in maps.profile_array(rows).collect():
        assert found[r.name].profile == pytest.approx(r.p, abs=1e-12)


@pytest.mark.parametrize("method", ["zscore", "minmax", "symmetric"])
def test_normalised_maps(spark, wt, method):
    rows = maps.map_rows(wt[0].unionByName(spark.createDataFrame([("flat", "A" * 9)], "name string, seq string")), energy_matrix(spark), mask=5, method=method)
    found = {r.name: r for r in maps.map_statistics(rows).collect()}
    assert (found["flat"].low, found["flat"].high, found["flat"].std) == (0.0, 0.0, 0.0)
    want = {"zscore": ("std", 1.0), "minmax": ("high", 1.0), "symmetric": ("low", -1.0)}[method]
    assert found["WT"][want[0]] == pytest.approx(want[1])
    with pytest.raises(ValueError):
        maps.map_rows(wt[0], energy_matrix(spark), method="other")
    with pytest.raises(ValueError):
        maps.map_rows(wt[0], energy_matrix(spark), edges="other")


def test_clamped_edges(spark):
    """Rows, then columns, each place weighted over seven sigma-thirds to both sides, outermost values going on; sigma 0 leaves the map."""
    seq, m = "YGRDSWK", np.array(energy_matrix(spark))
    df = spark.createDataFrame([("s", seq)], "name string, seq string")
    idx = [ALPHABET.index(a) for a in seq]
    raw = m[np.ix_(idx, idx)]
    w = np.exp(-0.5 * (np.arange(-6, 7) / 2.0) ** 2)
    smooth = np.array([[sum(w[k + 6] * (i == min(max(j + k, 0), 6)) for k in range(-6, 7)) / w.sum() for i in range(7)] for j in range(7)])
    found = np.array([r.e for r in maps.map_rows(df, m.tolist(), edges="clamp").orderBy("i").collect()])
    assert found == pytest.approx(smooth @ raw @ smooth.T) and np.array([r.e for r in maps.map_rows(df, m.tolist(), 0, edges="clamp").orderBy("i").collect()]) == pytest.approx(raw)


def pairs(spark, d):
    """A matrix of distances as pairs of a sequence s."""
    return spark.createDataFrame([("s", i, j, float(d[i][j])) for i in range(len(d)) for j in range(i + 1, len(d))], "name string, u int, v int, d double")


def test_forests_of_parts_are_one_forest(spark):
    rng = np.random.default_rng(0)
    d = rng.integers(0, 6, (30, 30))
    x = pairs(spark, np.minimum(d, d.T))
    forest = {(r.u, r.v, r.d) for r in graph.spanning_forest(x.repartition(7)).collect()}
    rows = x.collect()
    whole = graph.spanning_edges(*(np.array([r[c] for r in rows]) for c in ("u", "v", "d")))
    assert forest == {(rows[k].u, rows[k].v, rows[k].d) for k in whole}


def test_percolation_curve_against_components_at_each_threshold(spark, wt):
    found = networks.percolation_curve(wt[0], energy_matrix(spark)).orderBy("step").collect()
    e = {(r.u, r.v): r.e for r in graph.sticker_pairs(wt[1]).collect() if r.v - r.u >= 4}
    nodes = [r.i for r in graph.sticker_nodes(wt[1]).collect()]
    assert len(found) == 50
    for r in found:
        label = {i: i for i in nodes}
        for _ in nodes:
            for (u, v), x in e.items():
                if x < r.threshold:
                    label[u] = label[v] = min(label[u], label[v])
        sizes = [list(label.values()).count(k) for k in set(label.values())]
        assert (r.n_components, r.largest, r.fraction) == (len(sizes), max(sizes), max(sizes) / len(nodes))


def test_distances_by_method(spark, wt):
    for method in ("negated", "shifted", "rank"):
        d = graph.distances(wt[1], method=method).collect()
        near = {r.d for r in d if r.v - r.u < 4}
        far = [r.d for r in d if r.v - r.u >= 4]
        assert len(near) == 1 and near.pop() > max(far) and (method == "negated" or min(far) >= 0)
        assert sorted(r.d for r in graph.merge_tree(wt[1], method=method).collect()) == pytest.approx(sorted(r.d for r in graph.spanning_forest(graph.distances(wt[1], method=method)).collect()))
        zero = networks.persistence_diagrams(wt[0], energy_matrix(spark), method=method, loops=False).filter("death < double('inf')")
        assert sorted(r.death for r in zero.collect()) == pytest.approx(sorted(r.d for r in graph.merge_tree(wt[1], method=method).collect()))
    with pytest.raises(ValueError):
        graph.distances(wt[1], method="other")
    with pytest.raises(ValueError):
        networks.persistence_diagrams(wt[0], energy_matrix(spark), method="other")


def test_model_comparison(spark):
    seqs = variants.expanded_registry(spark).cache()
    metrics = hamiltonian.variant_metrics(seqs.select("name", "seq"), energy_matrix(spark)).cache()
    table = fitting.calibration_table(metrics, variants.measured(spark)).cache()
    fitted = hamiltonian.Couplings(2.0, 1.0, 0.5, 8.292618910377954, 4.751926251580603, 3.058884405607401, 0.5322066429727808, 43.742403603530185)
    found = {r.model: (r.rank_correlation, r.rmse_log) for r in fitting.compare_models(table, fitted).collect()}
    assert found["chemistry"] == (pytest.approx(1.0), pytest.approx(2.2387739478641757)) and found["full"] == (pytest.approx(1.0), pytest.approx(0.0, abs=1e-8))
    assert hamiltonian.decode([1.0, 2.0, 3.0, 4.0, 5.0]) == hamiltonian.Couplings(2.0, 1.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0)
    rows = fitting.training_rows(metrics, variants.measured(spark).select("name", "csat_relative", "phase_separates"))
    by_name = {r.name: r for r in rows.collect()}
    assert (by_name["WT"].phase_target, by_name["AllY_to_S"].phase_target, by_name["AllY_to_A"].phase_target, by_name["R213K"].phase_target) == (1.0, 0.0, 0.0, 1.0)
    assert by_name["WT"].csat_target == 1.0 and by_name["R213K"].csat_target is None and all(r.h_eff_target is None for r in by_name.values())
    out = {r.name: r for r in fitting.train_and_predict(rows, epochs=1500).collect()}
    assert len(out) == 20 and out["AllY_to_S"].csat == pytest.approx(50, rel=0.3) and out["WT"].phase > 0.9 > 0.1 > out["AllY_to_A"].phase and out["WT"].h_chem == pytest.approx(by_name["WT"].h_chem_target, abs=0.05)
    assert fitting.train_and_predict(rows.limit(0)).count() == 0


def test_representations(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, "".join(rng.choice(list(ALPHABET), 60))) for k in range(400)], "name int, seq string")
    found = {r.theta: r for r in fitting.minimal_representation(df, energy_matrix(spark)).collect()}
    assert {k: r["size"] for k, r in found.items()} == {"composition": 20, "sticker": 5, "interaction_class": 7, "pair_counts": 210}
    assert found["pair_counts"].r2 == pytest.approx(1.0, abs=1e-6)  # the energy is linear in the pairs
    theta = np.array([r.theta for r in fitting.composition_theta(df).orderBy("name").collect()]) / 3600
    energy = np.array([r.energy for r in segments.uniform_energy(df, energy_matrix(spark)).orderBy("name").collect()]) / 3600
    w = np.linalg.lstsq(theta, energy, rcond=None)[0]
    assert found["composition"].r2 == pytest.approx(1 - ((energy - theta @ w) ** 2).sum() / ((energy - energy.mean()) ** 2).sum(), abs=1e-6)
    assert sum(r.minimal for r in found.values()) == 1


def test_counts_of_odd_sequences(spark):
    df = spark.createDataFrame([("a", "Y"), ("b", "ACDEFGHIKLMNPQRSTVWY" * 3), ("c", "R" * 5 + "D" * 5)], "name string, seq string")
    counts = {r.name: r.c for r in sequences.with_counts(df).collect()}
    assert sum(counts["a"]) == 1 and counts["b"] == [3] * 20 and counts["c"][ALPHABET.index("R")] == 5
    kappa = {r.name: r.kappa for r in sequences.kappa_charge(df).collect()}
    assert kappa["a"] == 0.0 and kappa["c"] == pytest.approx(min(1.0, np.mean([((5 - k) - k) ** 2 / 25 for k in range(6)])))
    x = df.filter("name = 'c'")
    assert [x.select(sequences.residue_at(F.col("seq"), F.lit(p))).first()[0] for p in (0, 1, 10, 11)] == [None, "R", "D", None]


def test_registries(spark, tmp_path):
    base = variants.base_variants(spark.createDataFrame([("s", "AYGYCY"), ("t", "AAA")], "name string, seq string")).collect()
    assert {(r.name, r.variant): (r.seq, r.mutations) for r in base if r.name == "s"} == {
        ("s", "WT"): ("AYGYCY", []), ("s", "MidY_to_S"): ("AYGSCY", ["Y4S"]), ("s", "AllY_to_S"): ("ASGSCS", ["Y2S", "Y4S", "Y6S"]), ("s", "AllY_to_A"): ("AAGACA", ["Y2A", "Y4A", "Y6A"]), ("s", "AllY_to_F"): ("AFGFCF", ["Y2F", "Y4F", "Y6F"]),
    }
    assert all(r.seq == "AAA" and r.mutations == [] for r in base if r.name == "t")
    assert variants.expanded_registry(spark, ("charge",)).count() == 7 and variants.expanded_registry(spark, ()).count() == 5
    with pytest.raises(ValueError):
        variants.expanded_registry(spark, ("other",))
    registry = feeds.registry(spark)
    feeds.write_variants_json(registry, str(tmp_path / "v"))
    text = next((tmp_path / "v").glob("part-*")).read_text()
    assert set(json.loads(text)) == {r.name for r in registry.collect()} and json.loads(text)["WT"]["parent"] is None
    assert {r.name: r.sequence for r in feeds.read_variants_json(spark, str(tmp_path / "v")).collect()} == {r.name: r.sequence for r in registry.collect()}
    feeds.write_summary_csv(spark.createDataFrame([("x", 1234.5, 2.0)], "name string, a double, b double"), str(tmp_path / "c"), ["a"], ["b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().asDict() == {"name": "x", "a": "1234.5000", "b": "2.00"}
    feeds.write_masks(spark.createDataFrame([("x", 0, True)], "name string, i int, mask boolean"), str(tmp_path / "m"))
    assert feeds.read_maps(spark, str(tmp_path / "m")).count() == 1


def test_shuffles_keep_the_composition(spark):
    df = spark.createDataFrame([("s", "ACDEFGHIKLMNPQRSTVWY" * 5), ("t", "A")], "name string, seq string")
    rows = variants.shuffled(df, 4).collect()
    assert len(rows) == 8 and all(sorted(r.seq) == sorted("ACDEFGHIKLMNPQRSTVWY" * 5 if r.name == "s" else "A") for r in rows)
    assert len({r.seq for r in rows if r.name == "s"}) == 4 and rows == variants.shuffled(df, 4).collect()


def test_ranks_over_many_parts(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 50, 500).tolist(), rng.normal(size=500).tolist()
    df = spark.createDataFrame(list(zip(x, y, strict=True)), "x long, y double")
    ranks = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    assert hamiltonian.spearman(df, "x", "y").first().rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])


def test_slices_contacts_and_differences(spark):
    df = spark.createDataFrame([("s", "WT", "YGYRDEKF"), ("s", "X", "SGSRDEKF"), ("t", "X", "AAA")], "item string, variant string, seq string")
    seqs = df.select(F.struct("item", "variant").alias("name"), "seq")
    rows = maps.map_rows(seqs, energy_matrix(spark)).select("name.item", "name.variant", "name", "n", "idx", "i", "e").cache()
    e = {(r.item, r.variant, r.i): r.e for r in rows.collect()}
    d = maps.all_differences(rows, "item", "variant", "WT").collect()
    assert len(d) == 8 and all(r.e == pytest.approx([a - b for a, b in zip(e["s", "X", r.i], e["s", "WT", r.i], strict=True)]) for r in d)
    one = rows.filter("item = 's' and variant = 'WT'")
    for r in maps.row_slices(one, F.lit(2)).collect():
        assert r.by_row == e["s", "WT", 2][r.i] and r.by_column == e["s", "WT", r.i][2]
    for mode, test in (("attractive", lambda v: v < -0.1), ("repulsive", lambda v: v > -0.1), ("both", lambda v: abs(v) > 0.1)):
        found = {(r.i, r.j) for r in maps.contacts(one, -0.1, mode).collect()}
        assert found == {(i, j) for i in range(8) for j in range(i, 8) if test(e["s", "WT", i][j])}
    with pytest.raises(ValueError):
        maps.contacts(one, 0.1, "other")
    bags = {r.pair_class: r.n for r in maps.value_bags(one).groupBy("pair_class").agg(F.count("e").alias("n")).collect()}
    assert bags == {"ss": 25, "ll": 9, "cross": 30}

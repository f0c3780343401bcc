"""Known values of the five base variants and of small cases."""

import pytest
from pyspark.sql import functions as F

from polyseq.functions.residues import energy_matrix
from polyseq.operators import hamiltonian, maps, networks, segments, sequences
from polyseq.sources import feeds

NAMES = ("WT", "Y143S", "AllY_to_S", "AllY_to_A", "AllY_to_F")
METRICS = {
    "fcr": (0.028037383177570093,) * 5, "ncpr": (-0.018691588785046728,) * 5, "kappa": (1.0,) * 5,
    "sticker_fraction": (0.1308411214953271, 0.1261682242990654, 0.004672897196261682, 0.004672897196261682, 0.1308411214953271),
    "mean_length": (6.666666666666667, 6.961538461538462, 0.0, 0.0, 6.666666666666667), "kappa_linker": (1.8206913871032138, 1.8091860493754837, None, None, 1.8206913871032138),
    "omega": (0.4776016537183791, 0.4833091298529164, None, None, 0.4776016537183791), "total_energy": (-285.3437364457841, -276.5785966218357, -251.17455185005616, -82.5640301606523, -367.765755007664),
    "delta_g": (-0.07531084711919633, -0.07360793353650645, -0.03218011487222917, -0.02656294670871724, -0.10222684159109625), "ss": (-0.026874918450508004, -0.02642808201208912, -0.012094541181972857, -0.011916847996479605, -0.03688769724436801),
    "clustering": (0.5782442748091603, 0.5637149028077754, 0.0, 0.0, 0.5079962370649106), "path_length": (1.5052631578947369, 1.5473684210526315, 0.0, 0.0, 1.5974025974025974), "n_components": (9, 8, 1, 1, 7),
    "threshold": (-0.04409675584667565, -0.04409675584667565, 0.0, 0.0, -0.05602280782740055), "onset": (-0.04265833536940686, -0.039781494414869265, 0.0, 0.0, -0.05448195001096909),
    "h0_total": (0.32100414054630577, 0.30568408106576683, 0.0, 0.0, 0.6121467424436534), "spacing_entropy": (2.438986575756772, 2.363713275750189, 0.0, 0.0, 2.438986575756772),
    "normalized_spacing_entropy": (0.8129955252522573, 0.8419716570848635, 0.0, 0.0, 0.8129955252522573), "block_entropy": (2.5056558248337484, 2.4861755626027757, 0.9182958340544896, 0.9182958340544896, 2.5056558248337484),
    "composition_entropy": (0.222284830685688, 0.228538143953528, 0.0, 0.0, 0.222284830685688),
}
ENERGY = {"h_chemistry": METRICS["delta_g"], "h_topology": (-0.04700331687726475, -0.046053086179726144, 0.02, 0.02, -0.06209742348613986), "h_eff": (-0.12231416399646108, -0.1196610197162326, -0.012180114872229166, -0.006562946708717241, -0.16432426507723613)}
SENSITIVITY = {"e_ss": 0.3011763564218807, "e_cross": 0.12659309622587614, "e_ll": 0.027293074410697015, "phi_clustering": 0.21201303198690008, "phi_connectivity": 0.04101578289368785, "phi_percolation": 0.3754883537051805, "phi_arrangement": 0.046585516883048524, "phi_homology": 0.06453638920964445}
C_SAT = (1.0, 1.0026566669822377, 1.1164277165863576, 1.122716524924152, 0.9588600950002957)


@pytest.fixture(scope="module")
def base(spark):
    seqs = feeds.registry(spark).select("name", F.col("sequence").alias("seq"))
    rows = maps.map_rows(seqs, energy_matrix(spark)).cache()
    return seqs, rows, hamiltonian.variant_metrics(seqs, energy_matrix(spark)).cache()


def by_name(df):
    return {r.name: r.asDict() for r in hamiltonian.finite(df).collect()}


def check(found, expected):
    for column, values in expected.items():
        for name, value in zip(NAMES, values, strict=True):
            assert found[name][column] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-12)), (column, name)


def test_metrics_of_the_base_variants(base):
    check(by_name(base[2]), METRICS)


def test_effective_energy(base):
    energies = hamiltonian.effective_energy(base[2]).cache()
    check(by_name(energies), ENERGY)
    assert {r.term: r.sensitivity for r in hamiltonian.sensitivity(energies).collect()} == {k: pytest.approx(v, rel=1e-8) for k, v in SENSITIVITY.items()}
    check(by_name(hamiltonian.saturation(energies, "WT")), {"c_sat": C_SAT})


def persistence(spark, seqs):
    m = energy_matrix(spark)
    return by_name(networks.persistence(networks.distance_spans(seqs, m), networks.persistence_diagrams(seqs, m)))


def test_persistence(spark, base):
    found = persistence(spark, base[0])
    assert found["WT"]["n_features"] == 28 and found["AllY_to_S"]["n_features"] == 1
    assert found["WT"]["h0_longest"] == pytest.approx(0.02526610033243113) and found["WT"]["h0_mean_death"] == pytest.approx(0.01188904224245577)
    assert found["WT"]["b0_auc"] == pytest.approx(1.6213306225993276) and found["Y143S"]["b0_auc"] == pytest.approx(1.6216282591403808)
    assert all(r["h1_features"] == 0 for r in found.values())


def test_betweenness(spark, base):
    m = energy_matrix(spark)
    searches = networks.searches(networks.auto_threshold(base[0], m), m, flows=True)
    found = {r.name: r.m for r in networks.betweenness(searches).groupBy("name").agg(F.max("betweenness").alias("m")).collect()}
    assert found["WT"] == pytest.approx(0.07161311818174564) and found["Y143S"] == pytest.approx(0.12415201465201466) and found["AllY_to_S"] == 0.0


def test_energies_of_the_raw_map(spark, base):
    raw = maps.map_rows(base[0], energy_matrix(spark), 0)
    assert by_name(maps.chain_energy(raw))["WT"]["energy"] == pytest.approx(-273.3345)
    assert by_name(maps.contact_energy(raw))["WT"]["energy"] == pytest.approx(-27.728517046917574)
    assert by_name(segments.uniform_energy(base[0], energy_matrix(spark)))["WT"]["energy"] == pytest.approx(-278.4905)
    assert by_name(maps.map_statistics(base[1]))["WT"]["total"] == pytest.approx(-574.5745)
    assert by_name(sequences.charge_decoration(base[0]))["WT"]["scd"] == pytest.approx(0.2821454964161737)


def test_mutations(spark):
    df = spark.createDataFrame([(feeds.CANONICAL,)], "seq string")
    status = lambda code: df.select(sequences.parse_mutation(F.lit(code), F.col("seq"))["status"]).first()[0]
    assert {c: status(c) for c in ("Y143S", "y143s", "Y144S", "Y28S", "Y0S", "Y215S", "YS", "YxS", "B5A")} == {"Y143S": "ok", "y143s": "ok", "Y144S": "mismatch", "Y28S": "mismatch", "Y0S": "range", "Y215S": "range", "YS": "format", "YxS": "position", "B5A": "residue"}
    twice = F.array(F.struct(F.lit(1).alias("pos"), F.lit("A").alias("new")), F.struct(F.lit(1).alias("pos"), F.lit("C").alias("new")))
    assert df.select(sequences.apply_mutations(F.col("seq"), twice)).first()[0] is None
    single = [r.pos for r in sequences.single_site_variants(df.select(F.lit("WT").alias("name"), "seq")).orderBy("pos").collect()]
    assert single == [6, 38, 66, 100, 143, 208]
    assert [sequences.fraction_mutated(df.select(F.lit("WT").alias("name"), "seq"), f).first().n for f in (0.25, 0.5, 0.75)] == [7, 14, 20]
    clustered, spaced = df.select(sequences.clustered(F.col("seq")), sequences.evenly_spaced(F.col("seq"))).first()
    assert clustered.startswith("MASNDYTQQATQSYYAYPTQPYQYYSQQSSQPYYQQ") and spaced.startswith("YASNDGTQYATQSGGAYPTQPGQGYSQQSSQPYGQQ")


def test_short_and_uniform_sequences(spark):
    df = spark.createDataFrame([("a", "Y"), ("b", "YY"), ("c", "GGG"), ("d", "YGYGY"), ("e", "A" * 7)], "name string, seq string")
    rows = maps.map_rows(df, energy_matrix(spark))
    assert {r.name: round(r.t, 9) for r in rows.groupBy("name").agg(F.sum(F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).alias("t")).collect()} == {"a": -0.5265, "b": -2.106, "c": 0.0, "d": -4.7385, "e": 0.0}
    assert by_name(segments.omega(df)) == {"a": {"name": "a", "omega": None}, "b": {"name": "b", "omega": 0.0}, "c": {"name": "c", "omega": None}, "d": {"name": "d", "omega": 0.0}, "e": {"name": "e", "omega": None}}
    kappa = {r.name: r.kappa for r in segments.linker_statistics(df).collect()}
    assert kappa["d"] == float("inf") and kappa["b"] != kappa["b"]
    assert by_name(networks.percolation(networks.percolation_curve(df, energy_matrix(spark))))["a"]["threshold"] == 0.0
    found = persistence(spark, df)
    assert "c" not in found and found["a"]["h0_total"] == 0.0 and (found["a"]["n_features"], found["d"]["n_features"], found["d"]["h1_features"]) == (1, 3, 0)
    empty = df.filter("name = 'z'")
    assert maps.map_statistics(maps.map_rows(empty, energy_matrix(spark))).count() == 0 and segments.omega(empty).count() == 0


def test_fasta_and_files(spark, tmp_path):
    df = spark.createDataFrame([("x", "A" * 61)], "name string, seq string")
    assert df.select(feeds.fasta(F.col("name"), F.col("seq"))).first()[0] == ">x\n" + "A" * 60 + "\nA"
    feeds.write_json(spark.createDataFrame([(1.0,), (float("nan"),)], "v double"), str(tmp_path / "j"))
    assert sorted(str(r.v) for r in spark.read.schema("v double").json(str(tmp_path / "j")).collect()) == ["1.0", "None"]
    rows = maps.map_rows(df, energy_matrix(spark))
    feeds.write_maps(rows, str(tmp_path / "m"))
    assert feeds.read_maps(spark, str(tmp_path / "m")).count() == rows.count() == 61
    text = '{"WT": {"name": "WT", "sequence": "MA", "mutations": [], "description": "d", "parent": null}}'
    (tmp_path / "variants.json").write_text(text)
    assert feeds.read_variants_json(spark, str(tmp_path / "variants.json")).first().sequence == "MA"
    feeds.write_fasta(df, str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).count() == 3
    feeds.write_summary_csv(spark.createDataFrame([("x", 1.23456, 2.0)], "name string, a double, b double"), str(tmp_path / "c"), ["a"], ["b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().asDict() == {"name": "x", "a": "1.2346", "b": "2.00"}
    with pytest.raises(KeyError):
        feeds.get_variant(feeds.registry(spark), "none")


FITTED = dict(zip(("clustering", "connectivity", "percolation", "arrangement", "homology"), (8.292618910377954, 4.751926251580603, 3.058884405607401, 0.5322066429727808, 43.742403603530185), strict=True))
EXPANDED = {
    "WT": -3.4119964745708646, "Y143S": -3.393715100808699, "AllY_to_S": 0.5000265281005516, "Y6S": -3.4219065613236297, "Y38S": -4.23722213721061, "Y208S": -3.3816219924261564, "7Y_to_S": -3.4833872259881296, "14Y_to_S": -3.897830193662225,
    "20Y_to_S": -4.633959655622433, "Shuffled_1": -4.564748114306507, "Shuffled_2": -4.340683506229472, "Shuffled_3": -4.761584881656265, "R213Q": -3.4289994160225774, "R213K": -3.4119964745708646, "Y_Clustered": -4.526379530684454, "Y_EvenSpaced": -5.132084604126934,
}


def test_expanded_variants_and_calibration(spark):
    from polyseq.operators import fitting, variants

    seqs = variants.expanded_registry(spark).cache()
    assert seqs.count() == 20 and sorted(r.ordinal for r in seqs.collect()) == list(range(20))
    metrics = hamiltonian.variant_metrics(seqs.select("name", "seq"), energy_matrix(spark)).cache()
    fitted = hamiltonian.Couplings(2.0, 1.0, 0.5, **FITTED)
    found = {r.name: r.h_eff for r in hamiltonian.effective_energy(metrics, fitted).collect()}
    assert {k: found[k] for k in EXPANDED} == {k: pytest.approx(v, rel=1e-8) for k, v in EXPANDED.items()}
    table = fitting.calibration_table(metrics, variants.measured(spark)).cache()
    assert table.count() == 3
    assert fitting.calibration_loss(table) == pytest.approx(14.514714353582983)
    assert fitting.calibration_loss(table, fitting.calibrate(table)) == pytest.approx(0, abs=1e-12)
    sweep = fitting.robustness(table, fitted)
    stable = {r.parameter: r.s for r in sweep.groupBy("parameter").agg((F.avg((F.col("rho") > 0.7).cast("int")) > 0.8).alias("s")).collect()}
    assert stable == {"clustering": False, "connectivity": False, "percolation": True, "arrangement": True, "homology": True}
    x = fitting.features(metrics)
    rows = x.join(variants.measured(spark), "name", "left").collect()
    import numpy as np

    net = fitting.Network(1)
    y = np.array([[np.log(r.csat_relative) if r.csat_relative else np.nan] for r in rows])
    losses = net.fit(np.array([r.features for r in rows]), y, epochs=1500)
    assert losses[-1] < 1e-3 * losses[0]
    out = {r.name: r.outputs[0] for r in net.predict(x).collect()}
    assert len(out) == 20 and out["AllY_to_S"] == pytest.approx(np.log(50), rel=0.05)

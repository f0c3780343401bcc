"""Further queries: graphs, persistence, metrics and energies of the items with recursive SQL, and linear energies of the documents.

The SQL finds trees by Prim's rule, components and distances by breadth-first rounds, and loops by self-joins, where
the operators merge forests of parts or run kernels; sums over maps are taken pair by pair there and by factors here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseq.functions.residues import ALPHABET, FORCE_FIELD_SQL, RESIDUES_SQL, STICKERS, energy_matrix, force_field, stickiness
from polyseq.operators import fitting, graph, hamiltonian, maps, moments, networks, segments, sequences, variants
from polyseq.operators.maps import gaussian_weights
from polyseq.plans import catalog
from polyseq.plans.catalog import _DOCS, _MAP, _RAW, _RUNS, _SIDES, _SITES, _SP, _ALL, _contacts, _in, _item_maps, _metrics, _r, _register, _seqs, _smooth
from polyseq.sources import feeds
from polyseq.sources.store import kept


def _items_sql(name: str) -> str:
    """The SQL of a query over documents as one over items, unrounded, to be used as a table."""
    sql = catalog.oracle_sql()[name].replace("FROM documents", "FROM benchmark").replace("doc_id", "item_id")
    return "(" + sql.replace(", 6) + 0.0", ", 15) + 0.0") + ")"


# trees, components and distances in SQL

def _tree_sql(out: str, source: str) -> str:
    """The edges (name, u, v, d) of the least spanning trees of complete graphs, from their pairs."""
    return f"""{out}_grown AS (SELECT name, [min(u)] AS tree, {{'d': 0.0::DOUBLE, 'u': -1::INT, 'v': -1::INT}} AS b FROM {source} GROUP BY name
  UNION ALL SELECT name, list_append(tree, CASE WHEN list_contains(tree, b.u) THEN b.v ELSE b.u END), b FROM (
    SELECT p.name, any_value(p.tree) AS tree, min({{'d': x.d::DOUBLE, 'u': x.u::INT, 'v': x.v::INT}}) AS b FROM {out}_grown p JOIN {source} x ON x.name = p.name AND list_contains(p.tree, x.u) <> list_contains(p.tree, x.v) GROUP BY p.name)),
{out} AS (SELECT name, b.u AS u, b.v AS v, b.d AS d FROM {out}_grown WHERE b.u >= 0)"""


def _steps_sql(out: str, nodes: str, edges: str) -> str:
    """(name, src, v, d): in how many steps which node is reached from which, itself included."""
    return f"""{out}_both AS (SELECT name, u, v FROM {edges} UNION ALL SELECT name, v, u FROM {edges}),
{out}_front AS (SELECT name, i AS src, [i] AS seen, [i] AS front, 0 AS d FROM {nodes}
  UNION ALL SELECT b.name, b.src, list_concat(any_value(b.seen), list(DISTINCT a.v)), list(DISTINCT a.v), any_value(b.d) + 1
    FROM (SELECT *, unnest(front) AS u FROM {out}_front) b JOIN {out}_both a ON a.name = b.name AND a.u = b.u WHERE NOT list_contains(b.seen, a.v) GROUP BY b.name, b.src),
{out} AS (SELECT name, src, unnest(front) AS v, d FROM {out}_front)"""


def _paths_sql(out: str, steps: str) -> str:
    """name, n_components, largest, path_length from what :func:`_steps_sql` gives."""
    return f"""{out}_of AS (SELECT name, src, min(v) AS root, count(*) AS size, sum(d) AS total FROM {steps} GROUP BY name, src),
{out}_part AS (SELECT name, root, any_value(size) AS size, sum(total) AS total FROM {out}_of GROUP BY name, root),
{out} AS (SELECT name, count(*) AS n_components, max(size) AS largest, coalesce(arg_max(CASE WHEN size > 1 THEN total / (size * (size - 1)) ELSE 0 END, size * 1000000 - root), 0)::DOUBLE AS path_length FROM {out}_part GROUP BY name)"""


_MAP_R = _MAP.replace("WITH ", "WITH RECURSIVE ", 1)
_SP_R = _SP.replace("WITH ", "WITH RECURSIVE ", 1)
_GRAPH = f"{_MAP_R}, no AS (SELECT name, i FROM sites), ed AS (SELECT name, i AS u, j AS v FROM m WHERE j - i >= 4 AND e < -0.1)"
_LIMIT = "li AS (SELECT s.name, coalesce(t, 0) AS t FROM seqs s LEFT JOIN (SELECT name, quantile_cont(e, 0.25) AS t FROM sp WHERE j - i >= 4 GROUP BY name) q ON q.name = s.name)"
_STICKER_GRAPH = f"{_SP_R}, {_LIMIT}, sg AS (SELECT sp.name, i AS u, j AS v FROM sp JOIN li USING (name) WHERE j - i >= 4 AND round(e, 12) < round(t, 12))"
_STICKER_PATHS = f"{_steps_sql('ss', 'sti', 'sg')}, {_paths_sql('pa', 'ss')}"
_CURVE = f"""{_SP_R}, pd AS (SELECT name, i AS u, j AS v, CASE WHEN j - i >= 4 THEN e ELSE 1000 END AS d FROM sp), {_tree_sql('pt', 'pd')}, kn AS (SELECT name, count(*) AS n FROM sti GROUP BY name),
sw AS (SELECT name, min(e) - mg AS lo, max(e) + mg AS hi FROM (SELECT *, CASE WHEN max(e) OVER w - min(e) OVER w = 0 THEN 0.1 ELSE 0.1 * (max(e) OVER w - min(e) OVER w) END AS mg FROM sp WHERE j - i >= 4 WINDOW w AS (PARTITION BY name)) GROUP BY name, mg),
gr AS (SELECT kn.name, n, k AS step, CASE WHEN k = 49 THEN coalesce(hi, 0) ELSE coalesce(lo, -1) + k * ((coalesce(hi, 0) - coalesce(lo, -1)) / 49) END AS t FROM kn LEFT JOIN sw USING (name), range(50) r(k) WHERE n > 1),
lf AS (SELECT gr.name, step, gr.t, pt.u, pt.v FROM gr JOIN pt ON pt.name = gr.name AND pt.d < gr.t),
lb AS (SELECT name, step, u, v FROM lf UNION ALL SELECT name, step, v, u FROM lf),
re AS (SELECT gr.name, step, i AS src, i AS v FROM gr JOIN sti USING (name) UNION SELECT re.name, re.step, src, lb.v FROM re JOIN lb ON lb.name = re.name AND lb.step = re.step AND lb.u = re.v),
rs AS (SELECT name, step, src, count(*) AS size, min(v) AS root FROM re GROUP BY ALL),
cu AS (SELECT gr.name, gr.step, any_value(t) AS threshold, count(*) FILTER (src = root) AS n_components, max(size) AS largest, max(size) / any_value(n)::DOUBLE AS fraction FROM gr JOIN rs ON rs.name = gr.name AND rs.step = gr.step GROUP BY gr.name, gr.step
  UNION ALL SELECT name, 0, 0.0, n, n, 1.0 FROM kn WHERE n < 2)"""
_PERCOLATION = f"""{_CURVE}, gw AS (SELECT *, coalesce(lead(fraction) OVER (PARTITION BY name ORDER BY step) - fraction, -1) AS growth FROM cu),
pe AS (SELECT name, first(threshold ORDER BY growth DESC, step) AS threshold, coalesce(first(threshold ORDER BY step) FILTER (fraction >= 0.5), first(threshold ORDER BY step)) AS onset FROM gw GROUP BY name)"""
#: Distances are minus energies, to twelve decimals.
_DISTANCES = f"""{_SP_R}, far AS (SELECT m.name, max(round(-m.e, 12)) AS most FROM m SEMI JOIN sti a ON a.name = m.name AND a.i = m.i SEMI JOIN sti b ON b.name = m.name AND b.i = m.j GROUP BY m.name),
hd AS (SELECT sp.name, i AS u, j AS v, CASE WHEN j - i >= 4 THEN round(-e, 12) ELSE most + 1 END AS d FROM sp JOIN far USING (name)), {_tree_sql('ht', 'hd')},
hb AS (SELECT name, u AS a, v AS k, d FROM hd UNION ALL SELECT name, v, u, d FROM hd),
lo AS (SELECT x.name, x.d AS birth, min(greatest(x.d, p.d, q.d)) AS death FROM (SELECT * FROM hd ANTI JOIN ht USING (name, u, v)) x JOIN hb p ON p.name = x.name AND p.a = x.u AND p.k <> x.v JOIN hb q ON q.name = x.name AND q.a = x.v AND q.k = p.k GROUP BY x.name, x.u, x.v, x.d),
dg AS (SELECT name, 0 AS dim, 0.0::DOUBLE AS birth, d AS death FROM ht UNION ALL SELECT DISTINCT name, 0, 0.0, 'inf'::DOUBLE FROM sti UNION ALL SELECT name, 1, birth, death FROM lo WHERE death > birth)"""
_BETTI = f"""{_DISTANCES}, hs AS (SELECT name, min(d) FILTER (d > 0) AS low, greatest(max(d), 0) AS high FROM hd GROUP BY name),
be AS (SELECT hs.name, k AS step, CASE WHEN k = 49 THEN high ELSE low + k * ((high - low) / 49) END AS t FROM hs, range(50) r(k) WHERE low IS NOT NULL),
bc AS (SELECT be.name, step, t, count(*) FILTER (dim = 0 AND birth <= t AND t < death) AS b0, count(*) FILTER (dim = 1 AND birth <= t AND t < death) AS b1 FROM be JOIN dg ON dg.name = be.name GROUP BY ALL)"""
_HOMOLOGY = f"""{_BETTI}, au AS (SELECT name, sum(b0 * w) AS b0_auc, sum(b1 * w) AS b1_auc FROM (SELECT *, lead(t) OVER (PARTITION BY name ORDER BY step) - t AS w FROM bc) GROUP BY name),
ho AS (SELECT name, count(*) FILTER (dim = 0) AS n_features, coalesce(sum(death) FILTER (dim = 0 AND death < 'inf'), 0) AS h0_total, coalesce(max(death) FILTER (dim = 0 AND death < 'inf'), 0) AS h0_longest, coalesce(avg(death) FILTER (dim = 0 AND death < 'inf'), 0) AS h0_mean_death,
  count(*) FILTER (dim = 1) AS h1_features, coalesce(sum(death - birth) FILTER (dim = 1 AND death < 'inf'), 0) AS h1_total, coalesce(max(death - birth) FILTER (dim = 1 AND death < 'inf'), 0) AS h1_longest FROM dg GROUP BY name)"""


def _rest(cte: str) -> str:
    """The CTEs of a chain beyond those of the sticker pairs."""
    return cte[len(_SP_R) + 2 :]


_RECURSIVE = {
    "graph_components": f"{_GRAPH}, {_steps_sql('st', 'no', 'ed')}, {_paths_sql('pa', 'st')} SELECT name, n_components, largest, {_r('path_length', 'path_length')} FROM pa",
    "percolation": f"{_PERCOLATION} SELECT name, {_r('threshold', 'threshold')}, {_r('onset', 'onset')} FROM pe",
    "homology_metrics": f"{_HOMOLOGY} SELECT name, n_features, {_r('h0_total', 'h0_total')}, {_r('h0_longest', 'h0_longest')}, {_r('h0_mean_death', 'h0_mean_death')}, h1_features, {_r('h1_total', 'h1_total')}, {_r('h1_longest', 'h1_longest')}, {_r('coalesce(b0_auc, 0)', 'b0_auc')}, {_r('coalesce(b1_auc, 0)', 'b1_auc')} FROM ho LEFT JOIN au USING (name)",
}
catalog._SQL.update(_RECURSIVE)


@_register("graph_distances", f"{_GRAPH}, {_steps_sql('st', 'no', 'ed')} SELECT name, d::BIGINT AS steps, count(*) AS pairs FROM st WHERE v > src GROUP BY ALL")
def graph_distances(spark, sf_dir):
    """How many pairs of residues of an item's contact graph are how many steps apart."""
    return networks.distance_histogram(networks.searches(_contacts(spark, sf_dir), energy_matrix(spark), **_ALL))


@_register("percolation_curve", f"{_CURVE} SELECT name, step::BIGINT AS step, {_r('threshold', 'threshold')}, n_components, largest, {_r('fraction', 'fraction')} FROM cu")
def percolation_curve(spark, sf_dir):
    return networks.percolation_curve(feeds.items(spark, sf_dir), energy_matrix(spark))


@_register("persistence_diagrams", f"{_DISTANCES} SELECT name, dim::BIGINT AS dim, {_r('birth', 'birth')}, CASE WHEN death < 'inf' THEN round(death, 6) + 0.0 END AS death, count(*) AS features FROM dg GROUP BY ALL")
def persistence_diagrams(spark, sf_dir):
    """Births and deaths, to six decimals, and how many features have them; no death for what stays."""
    x = networks.persistence_diagrams(feeds.items(spark, sf_dir), energy_matrix(spark))
    return x.groupBy("name", "dim", F.round("birth", 6).alias("birth"), F.round("death", 6).alias("death")).agg(F.count(F.lit(1)).alias("features"))


@_register("betti_curves", f"{_BETTI} SELECT name, step::BIGINT AS step, {_r('t', 't')}, b0, b1 FROM bc")
def betti_curves(spark, sf_dir):
    seqs, m = feeds.items(spark, sf_dir), energy_matrix(spark)
    return networks.betti_curves(networks.distance_spans(seqs, m), networks.persistence_diagrams(seqs, m))


_BY_METHOD = f"""{_SP}, al AS (SELECT m.name, min(m.e) AS least, max(m.e) AS top, max(-m.e) AS most FROM m SEMI JOIN sti a ON a.name = m.name AND a.i = m.i SEMI JOIN sti b ON b.name = m.name AND b.i = m.j GROUP BY m.name),
rk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(e, 12), i, j) - 1 AS r, count(*) OVER (PARTITION BY name) - 1 AS last FROM sp)
SELECT name, {_r('sum(CASE WHEN j - i < 4 THEN most + 1 ELSE -e END)', 'negated')}, {_r('sum(CASE WHEN j - i < 4 THEN top - least + 1 ELSE e - least END)', 'shifted')}, sum(CASE WHEN j - i < 4 THEN last + 1 ELSE r END)::DOUBLE AS ranked FROM rk JOIN al USING (name) GROUP BY name"""


@_register("energy_distances", _BY_METHOD)
def energy_distances(spark, sf_dir):
    """The sum over sticker pairs of each of the three distances that energies are made into."""
    rows = kept(_item_maps(spark, sf_dir), "maps")
    parts = [graph.distances(rows, method=m).groupBy("name").agg(F.sum("d").alias(c)) for m, c in (("negated", "negated"), ("shifted", "shifted"), ("rank", "ranked"))]
    return parts[0].join(parts[1], "name").join(parts[2], "name")


_BETWEEN = f"""{_STICKER_GRAPH}, {_steps_sql('ss', 'sti', 'sg')}, pc AS (SELECT name, i AS src, i AS v, 0 AS d, 1.0::DOUBLE AS c FROM sti
  UNION ALL SELECT p.name, p.src, a.v, any_value(p.d) + 1, sum(p.c) FROM pc p JOIN ss_both a ON a.name = p.name AND a.u = p.v JOIN ss t ON t.name = p.name AND t.src = p.src AND t.v = a.v AND t.d = p.d + 1 GROUP BY p.name, p.src, a.v),
bt AS (SELECT a.name, a.v AS i, sum(a.c * b.c / t.c) AS b FROM pc a JOIN pc b ON b.name = a.name AND b.src = a.v AND b.v <> a.v AND a.src <> a.v JOIN pc t ON t.name = a.name AND t.src = a.src AND t.v = b.v AND t.src <> t.v AND t.d = a.d + b.d GROUP BY ALL),
kn AS (SELECT name, count(*) AS n FROM sti GROUP BY name), bw AS (SELECT s.name, s.i, CASE WHEN n > 2 THEN coalesce(b, 0) / ((n - 1) * (n - 2)) ELSE 0 END AS b FROM sti s JOIN kn USING (name) LEFT JOIN bt ON bt.name = s.name AND bt.i = s.i)"""


@_register("sticker_betweenness", f"{_BETWEEN} SELECT name, i::BIGINT AS i, {_r('b', 'betweenness')} FROM bw")
def sticker_betweenness(spark, sf_dir):
    m = energy_matrix(spark)
    return networks.betweenness(networks.searches(networks.auto_threshold(feeds.items(spark, sf_dir), m), m, flows=True))


_FULL = f"""fe AS (SELECT m.name, i AS u, j AS v FROM m JOIN li USING (name) WHERE j - i >= 4 AND round(e, 12) < round(t, 12)), fd AS (SELECT s.name, s.i, count(o) AS k FROM sites s LEFT JOIN (SELECT name, u AS i, v AS o FROM fe UNION ALL SELECT name, v, u FROM fe) USING (name, i) GROUP BY s.name, s.i),
fm AS (SELECT name, (sum(k) // 2)::BIGINT AS n_contacts, CASE WHEN count(*) > 1 THEN sum(k)::DOUBLE / (count(*) * (count(*) - 1)) ELSE 0 END AS graph_density, avg(k) AS mean_degree, max(k) AS max_degree FROM fd GROUP BY name)"""
_STICKER_STATS = """sd AS (SELECT s.name, s.i, count(o) AS k FROM sti s LEFT JOIN (SELECT name, u AS i, v AS o FROM sg UNION ALL SELECT name, v, u FROM sg) USING (name, i) GROUP BY s.name, s.i),
sm AS (SELECT name, (sum(k) // 2)::BIGINT AS n_contacts, CASE WHEN count(*) > 1 THEN sum(k)::DOUBLE / (count(*) * (count(*) - 1)) ELSE 0 END AS density, avg(k) AS mean_degree, sum(k * (k - 1) / 2) AS triples FROM sd GROUP BY name),
tr AS (SELECT a.name, count(*) AS t FROM sg a JOIN sg b ON b.name = a.name AND b.u = a.v JOIN sg c ON c.name = a.name AND c.u = a.u AND c.v = b.v GROUP BY a.name),
sc AS (SELECT sm.*, CASE WHEN triples > 0 THEN 3.0 * coalesce(t, 0) / triples ELSE 0 END AS clustering FROM sm LEFT JOIN tr USING (name))"""
_TOPOLOGY = f"{_BETWEEN}, {_paths_sql('pa', 'ss')}, {_FULL}, {_STICKER_STATS}, {_rest(_PERCOLATION).replace('kn AS (SELECT name, count(*) AS n FROM sti GROUP BY name),', '', 1)}, bm AS (SELECT name, max(b) AS mx, avg(b) AS mn FROM bw GROUP BY name)"


@_register("topology_metrics", f"""{_TOPOLOGY} SELECT seqs.name, fm.n_contacts, {_r('graph_density', 'graph_density')}, {_r('fm.mean_degree', 'mean_degree')}, max_degree, coalesce(sc.n_contacts, 0) AS sticker_n_contacts, {_r('coalesce(density, 0)', 'sticker_graph_density')}, {_r('coalesce(clustering, 0)', 'sticker_clustering_coefficient')}, {_r('coalesce(sc.mean_degree, 0)', 'sticker_mean_degree')},
 {_r('coalesce(path_length, 0)', 'sticker_avg_path_length')}, coalesce(n_components, 0) AS sticker_n_components, {_r('coalesce(threshold, 0)', 'percolation_threshold')}, {_r('coalesce(onset, 0)', 'giant_component_onset')}, {_r('coalesce(mx, 0)', 'max_betweenness')}, {_r('coalesce(mn, 0)', 'mean_betweenness')}
 FROM seqs JOIN fm ON fm.name = seqs.name LEFT JOIN sc ON sc.name = seqs.name LEFT JOIN pa ON pa.name = seqs.name LEFT JOIN pe ON pe.name = seqs.name LEFT JOIN bm ON bm.name = seqs.name""")
def topology_metrics(spark, sf_dir):
    return hamiltonian.topology_metrics(feeds.items(spark, sf_dir), energy_matrix(spark))


# metrics of the items in one row, and what is built on them

_WIDE = f"""{_STICKER_GRAPH}, {_STICKER_PATHS}, {_STICKER_STATS}, {_rest(_PERCOLATION)}, {_rest(_DISTANCES)}, h0 AS (SELECT name, sum(d) AS h0_total FROM ht GROUP BY name),
vm AS (SELECT s.name, s.n, n_stickers, n_linker_residues, sticker_fraction, fcr, ncpr, hydropathy, c.kappa, l.mean_length, l.kappa AS kappa_linker, omega, se.entropy AS spacing_entropy, se.normalized AS normalized_spacing_entropy, bk.entropy AS block_entropy, co.entropy AS composition_entropy,
  te.total AS total_energy, te.mean AS mean_energy, ss, ll, "cross", delta_g, li.t AS auto_threshold, coalesce(clustering, 0) AS clustering, coalesce(n_components, 1) AS n_components, coalesce(path_length, 0) AS path_length, coalesce(pe.threshold, 0) AS threshold, coalesce(onset, 0) AS onset, coalesce(h0_total, 0) AS h0_total
 FROM {_items_sql('sticker_mask')} s JOIN {_items_sql('charge_metrics')} q ON q.name = s.name JOIN {_items_sql('kappa_charge')} c ON c.name = s.name JOIN {_items_sql('linker_stats')} l ON l.name = s.name JOIN {_items_sql('omega')} o ON o.name = s.name JOIN {_items_sql('entropy_spacing')} se ON se.name = s.name
 JOIN {_items_sql('entropy_block')} bk ON bk.name = s.name JOIN {_items_sql('entropy_composition')} co ON co.name = s.name JOIN {_items_sql('total_energy')} te ON te.name = s.name JOIN {_items_sql('delta_g')} dl ON dl.name = s.name JOIN li ON li.name = s.name
 LEFT JOIN sc ON sc.name = s.name LEFT JOIN pa ON pa.name = s.name LEFT JOIN pe ON pe.name = s.name LEFT JOIN h0 ON h0.name = s.name)"""
_ENERGY = f"""{_WIDE}, te0 AS (SELECT name, 2*ss AS e_ss, "cross" AS e_cross, 0.5*ll AS e_ll, -0.05*clustering AS phi_clustering, CASE WHEN n_stickers > 1 THEN 0.02*(n_components - 1)/(n_stickers - 1) ELSE 0 END AS phi_connectivity, threshold AS phi_percolation,
  0.02*(normalized_spacing_entropy + coalesce(omega, 1)) AS phi_arrangement, CASE WHEN n_stickers > 1 THEN -0.5*h0_total/n_stickers ELSE 0 END AS phi_homology FROM vm),
en AS (SELECT *, h_chemistry + h_topology AS h_eff, CASE WHEN abs(h_chemistry + h_topology) < 1e-15 THEN 0 ELSE abs(h_topology)/(abs(h_chemistry) + abs(h_topology)) END AS topology_fraction FROM (SELECT *, e_ss + e_cross + e_ll AS h_chemistry, phi_clustering + phi_connectivity + phi_percolation + phi_arrangement + phi_homology AS h_topology FROM te0))"""
_WIDE_COLUMNS = ["sticker_fraction", "fcr", "ncpr", "hydropathy", "kappa", "mean_length", "kappa_linker", "omega", "spacing_entropy", "normalized_spacing_entropy", "block_entropy", "composition_entropy", "total_energy", "mean_energy", "ss", "ll", "cross", "delta_g", "auto_threshold", "clustering", "path_length", "threshold", "onset", "h0_total"]
_rounded = lambda names: ", ".join(_r(f'"{c}"', f'"{c}"') for c in names)
_ENERGY_COLUMNS = [*hamiltonian.TERMS, "h_chemistry", "h_topology", "h_eff", "topology_fraction"]
_FEATURE = lambda c: _r('coalesce(omega, 1)' if c == "omega" else f'"{c}"::DOUBLE', f'"{c}"')
catalog._SQL.update({
    "variant_metrics": f"{_WIDE} SELECT name, n, n_stickers, n_linker_residues, n_components, {_rounded(_WIDE_COLUMNS)} FROM vm",
    "h_eff": f"{_ENERGY} SELECT name, {_rounded(_ENERGY_COLUMNS)} FROM en",
    "sensitivity": f"{_ENERGY}, sp0 AS (SELECT " + ", ".join(f"stddev_pop({t}) AS {t}" for t in (*hamiltonian.TERMS, "h_eff")) + " FROM en) " + " UNION ALL ".join(f"SELECT '{t}' AS term, {_r(f'CASE WHEN h_eff < 1e-15 THEN 0 ELSE {t} / h_eff END', 'sensitivity')} FROM sp0" for t in hamiltonian.TERMS),
    "features": f"{_WIDE} SELECT name, {', '.join(_FEATURE(c) for c in fitting.FEATURES)} FROM vm",
})


@_register("c_sat", f"{_ENERGY} SELECT name, {_r('exp(h_eff + 0.075)', 'c_sat')} FROM en")
def c_sat(spark, sf_dir):
    return hamiltonian.saturation(hamiltonian.effective_energy(_metrics(spark, sf_dir)))


@_register("entropy_metrics", f"""{_SP}, s AS (SELECT name, min(e) AS lo, max(e) AS hi, count(*) AS n FROM sp GROUP BY name), b AS (SELECT name, s.n, CASE WHEN hi - lo <= 0 THEN 10 ELSE least(floor((e - lo) / ((hi - lo) / 20)), 19) END AS bin, count(*) AS c FROM sp JOIN s USING (name) GROUP BY ALL),
ie AS (SELECT name, coalesce(-sum(c / n * log2(c / n)), 0) AS h FROM seqs LEFT JOIN b USING (name) GROUP BY name)
SELECT ie.name, {_r('se.entropy', 'spacing_entropy')}, {_r('se.normalized', 'normalized_spacing_entropy')}, {_r('bk.entropy', 'block_entropy')}, {_r('ie.h', 'interaction_entropy')}, {_r('co.entropy', 'composition_entropy')}
 FROM ie JOIN {_items_sql('entropy_spacing')} se ON se.name = ie.name JOIN {_items_sql('entropy_block')} bk ON bk.name = ie.name JOIN {_items_sql('entropy_composition')} co ON co.name = ie.name""")
def entropy_metrics(spark, sf_dir):
    return hamiltonian.entropy_metrics(feeds.items(spark, sf_dir), energy_matrix(spark))


# maps

@_register("map_slices", f"{_MAP} SELECT a.name, (a.n // 2)::BIGINT AS k, a.j::BIGINT AS i, {_r('a.e', 'by_row')}, {_r('b.e', 'by_column')} FROM m a JOIN m b ON b.name = a.name AND a.i = a.n // 2 AND b.j = b.n // 2 AND b.i = a.j")
def map_slices(spark, sf_dir):
    return maps.row_slices(_item_maps(spark, sf_dir), F.floor(F.col("n") / 2).cast("int"))


@_register("contact_pairs", " UNION ALL ".join(f"SELECT '{mode}' AS mode, name, i::BIGINT AS i, j::BIGINT AS j FROM m WHERE {test} AND j >= i" for mode, test in (("attractive", "e < -0.1"), ("repulsive", "e > 0.02"), ("both", "abs(e) > 0.1"))).join([f"{_MAP} ", ""]))
def contact_pairs(spark, sf_dir):
    rows = _item_maps(spark, sf_dir)
    parts = [maps.contacts(rows, t, mode).select(F.lit(mode).alias("mode"), "name", "i", "j") for mode, t in (("attractive", -0.1), ("repulsive", 0.02), ("both", 0.1))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SIGMAS = (0.5, 1.0, 2.0, 3.0)


@_register("sigma_sweep", f"{_RAW}, " + ", ".join(_smooth("raw", f"m{k}", s, s) for k, s in enumerate(_SIGMAS)) + " " + " UNION ALL ".join(f"SELECT name, {s}::DOUBLE AS sigma, {_r('avg(e)', 'mean')}, {_r('stddev_pop(e)', 'std')}, {_r('min(e)', 'low')}, {_r('max(e)', 'high')} FROM m{k} GROUP BY name" for k, s in enumerate(_SIGMAS)))
def sigma_sweep(spark, sf_dir):
    """How the width of smoothing changes the maps."""
    parts = [maps.map_statistics(_item_maps(spark, sf_dir, s)).select("name", F.lit(s).alias("sigma"), "mean", "std", "low", "high") for s in _SIGMAS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_BASE = _MAP.replace("seqs AS (", "seqs0 AS (").replace(f", {_SITES}", f""", seqs AS (SELECT name * 5 AS name, seq FROM seqs0 UNION ALL SELECT name * 5 + 1, CASE WHEN contains(seq, 'Y') THEN concat(seq[1:yp - 1], 'S', seq[yp + 1:length(seq)]) ELSE seq END FROM (SELECT *, (list_filter(range(1, length(seq) + 1), lambda k: seq[k] = 'Y'))[(length(seq) - length(replace(seq, 'Y', '')) + 1) // 2] AS yp FROM seqs0)
  UNION ALL SELECT name * 5 + 2, replace(seq, 'Y', 'S') FROM seqs0 UNION ALL SELECT name * 5 + 3, replace(seq, 'Y', 'A') FROM seqs0 UNION ALL SELECT name * 5 + 4, replace(seq, 'Y', 'F') FROM seqs0), {_SITES}""")
_VARIANT = "CASE name % 5 WHEN 0 THEN 'WT' WHEN 1 THEN 'MidY_to_S' WHEN 2 THEN 'AllY_to_S' WHEN 3 THEN 'AllY_to_A' ELSE 'AllY_to_F' END"


@_register("variant_differences", f"""{_BASE}, d AS (SELECT b.name, b.e - a.e AS e FROM m a JOIN m b ON a.name % 5 = 0 AND b.name // 5 = a.name // 5 AND b.name % 5 > 0 AND a.i = b.i AND a.j = b.j)
SELECT (name // 5)::BIGINT AS item, {_VARIANT} AS variant, {_r('sum(e) / 2', 'total')}, {_r('sqrt(avg(e * e))', 'rmsd')}, {_r('avg(abs(e))', 'mean_abs')} FROM d GROUP BY name""")
def variant_differences(spark, sf_dir):
    """The maps of the base variants of each item less that of the item itself; sequences are joined, not maps."""
    x = variants.base_variants(feeds.items(spark, sf_dir))
    own = x.filter("variant = 'WT'").select("name", F.col("seq").alias("reference"))
    both = x.filter("variant <> 'WT'").join(own, "name").select(F.struct("name", "variant").alias("name"), "seq", "reference")
    found = moments.map_differences(both, energy_matrix(spark))
    return found.select(F.col("name.name").alias("item"), F.col("name.variant").alias("variant"), "total", "rmsd", "mean_abs")


@_register("base_variants", f"""WITH {_seqs('documents', 'doc_id')}, y AS (SELECT name, seq, (list_filter(range(1, length(seq) + 1), lambda k: seq[k] = 'Y')) AS ys, ys[(len(ys) + 1) // 2] AS yp FROM seqs), v AS (
SELECT name, 'WT' AS variant, 0 AS ordinal, seq AS s, 0 AS n_mutations FROM y UNION ALL SELECT name, 'MidY_to_S', 1, CASE WHEN len(ys) > 0 THEN concat(seq[1:yp - 1], 'S', seq[yp + 1:length(seq)]) ELSE seq END, least(len(ys), 1) FROM y
UNION ALL SELECT name, 'AllY_to_S', 2, replace(seq, 'Y', 'S'), len(ys) FROM y UNION ALL SELECT name, 'AllY_to_A', 3, replace(seq, 'Y', 'A'), len(ys) FROM y UNION ALL SELECT name, 'AllY_to_F', 4, replace(seq, 'Y', 'F'), len(ys) FROM y)
SELECT name, variant, ordinal::BIGINT AS ordinal, n_mutations::BIGINT AS n_mutations, md5(s) AS digest FROM v""")
def base_variants(spark, sf_dir):
    """The registry of base variants of every document."""
    x = variants.base_variants(feeds.documents(spark, sf_dir))
    return x.select("name", "variant", "ordinal", F.size("mutations").cast("long").alias("n_mutations"), F.md5("seq").alias("digest"))


@_register("slide_gauss", f"{_MAP}, p AS (SELECT name, n, i, avg(e) AS v FROM m GROUP BY ALL), kg AS (SELECT * FROM (VALUES " + ", ".join(f"({d - 8}, {x!r}::DOUBLE)" for d, x in enumerate(gaussian_weights(2.0))) + f") AS k(d, w)), f AS (SELECT name, n, i, w, ((i + d) % (2*n) + 2*n) % (2*n) AS f FROM p, kg) SELECT f.name, f.i::BIGINT AS i, {_r('sum(w * v)', 'v')} FROM f JOIN p ON p.name = f.name AND p.i = CASE WHEN f < f.n THEN f ELSE 2*f.n-1-f END GROUP BY f.name, f.i")
def slide_gauss(spark, sf_dir):
    return maps.smoothed_profile(_item_maps(spark, sf_dir), 2, "gaussian").select("name", "i", "v")


@_register("profile_smooth", f"{_MAP}, p AS (SELECT name, n, i, avg(e) AS v FROM m GROUP BY ALL), kg AS (SELECT * FROM (VALUES " + ", ".join(f"({d - 20}, {x!r}::DOUBLE)" for d, x in enumerate(gaussian_weights(5.0))) + f") AS k(d, w)), f AS (SELECT name, n, i, w, ((i + d) % (2*n) + 2*n) % (2*n) AS f FROM p, kg) SELECT f.name, f.i::BIGINT AS i, {_r('sum(w * v)', 'v')} FROM f JOIN p ON p.name = f.name AND p.i = CASE WHEN f < f.n THEN f ELSE 2*f.n-1-f END GROUP BY f.name, f.i")
def profile_smooth(spark, sf_dir):
    """Interaction profiles smoothed with the default method, whose window is the sigma of a gaussian."""
    return maps.smoothed_profile(_item_maps(spark, sf_dir)).select("name", "i", "v")


_BAGS = _SIDES[: _SIDES.index(", c AS (")]


@_register("value_bags", f"{_BAGS} SELECT name, CASE WHEN si AND sj THEN 'ss' WHEN NOT si AND NOT sj THEN 'll' ELSE 'cross' END AS pair_class, count(*) AS n, {_r('avg(e)', 'mean')}, {_r('min(e)', 'low')}, {_r('max(e)', 'high')}, {_r('quantile_cont(e, 0.5)', 'median')} FROM x GROUP BY ALL")
def value_bags(spark, sf_dir):
    x = maps.value_bags(_item_maps(spark, sf_dir)).groupBy("name", "pair_class")
    return x.agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"), F.min("e").alias("low"), F.max("e").alias("high"), F.percentile("e", F.lit(0.5)).alias("median"))


@_register("pair_masks", f"{_BAGS} SELECT name, i::BIGINT AS i, count(*) FILTER (si AND sj) AS ss, count(*) FILTER (NOT si AND NOT sj) AS ll, count(*) FILTER (si <> sj) AS \"cross\" FROM x GROUP BY name, i")
def pair_masks(spark, sf_dir):
    x = maps.masks(_item_maps(spark, sf_dir))
    return x.select("name", "i", *[F.size(F.filter(c, lambda v: v)).cast("long").alias(c) for c in ("ss", "ll", "cross")])


@_register("criteria_overlap", f"""{_MAP}, p AS (SELECT name, i, avg(e) AS v FROM m GROUP BY ALL), q AS (SELECT name, quantile_cont(v, 0.25) AS t FROM p GROUP BY name), c AS (SELECT p.name, aa IN {_in(STICKERS)} AS a, v < -0.01 AS b, v <= t + 1e-12 AS c FROM p JOIN q ON q.name = p.name JOIN sites s ON s.name = p.name AND s.i = p.i)
SELECT name, count(*) FILTER (a) AS chemistry, count(*) FILTER (b) AS energy, count(*) FILTER (c) AS percentile, count(*) FILTER (a AND b) AS chemistry_energy, count(*) FILTER (a AND c) AS chemistry_percentile, count(*) FILTER (b AND c) AS energy_percentile, count(*) FILTER (a AND b AND c) AS all_three FROM c GROUP BY name""")
def criteria_overlap(spark, sf_dir):
    return maps.criteria_overlap(_item_maps(spark, sf_dir), -0.01, 0.25)


# documents: what is linear in the sequence

@_register("residue_at", f"WITH {_seqs('documents', 'doc_id')} SELECT name, seq[1] AS first, seq[(length(seq) + 1) // 2] AS middle, seq[length(seq)] AS last, NULL::VARCHAR AS beyond FROM seqs")
def residue_at(spark, sf_dir):
    n, at = F.length("seq"), lambda p: sequences.residue_at(F.col("seq"), p)
    return feeds.documents(spark, sf_dir).select("name", at(F.lit(1)).alias("first"), at(F.floor((n + 1) / 2).cast("int")).alias("middle"), at(n).alias("last"), at(n + 1).alias("beyond"))


@_register("numeric_mask", f"{_DOCS} SELECT name, sum((aa IN {_in(STICKERS)})::INT)::DOUBLE AS total, md5(string_agg(CASE WHEN aa IN {_in(STICKERS)} THEN '1' ELSE '0' END, '' ORDER BY i)) AS digest FROM sites GROUP BY name")
def numeric_mask(spark, sf_dir):
    x = feeds.documents(spark, sf_dir).select("name", segments.numeric_mask(F.col("seq")).alias("mask"))
    return x.select("name", sequences.total(F.col("mask")).alias("total"), F.md5(F.array_join(F.transform("mask", lambda v: v.cast("int").cast("string")), "")).alias("digest"))


_PARTS = """fp AS (SELECT a.aa AS aa_i, b.aa AS aa_j, a.ar*b.ar*-0.65::DOUBLE AS aromatic, (a.ca*b.ar + b.ca*a.ar)*-0.5::DOUBLE AS cation_pi, CASE WHEN a.q*b.q < 0 THEN -0.3::DOUBLE WHEN a.q*b.q > 0 THEN 0.2::DOUBLE ELSE 0 END AS electrostatic FROM res a, res b)"""


@_register("ff_components", f"""{_DOCS}, {RESIDUES_SQL}, {FORCE_FIELD_SQL}, {_PARTS}, p AS (SELECT name, aa AS aa_i, lead(aa) OVER (PARTITION BY name ORDER BY i) AS aa_j FROM sites), c AS (SELECT name, aa_i, aa_j, count(*) AS c FROM p WHERE aa_j IS NOT NULL GROUP BY ALL)
SELECT name, sum(c)::BIGINT AS pairs, {_r('sum(c * aromatic)', 'aromatic')}, {_r('sum(c * cation_pi)', 'cation_pi')}, {_r('sum(c * electrostatic)', 'electrostatic')}, {_r('sum(c * e)', 'energy')} FROM c JOIN fp USING (aa_i, aa_j) JOIN ff USING (aa_i, aa_j) GROUP BY name""")
def ff_components(spark, sf_dir):
    """The energy of all pairs of neighbouring residues of a document, and its pure terms."""
    a = sequences.letters(F.col("seq"))
    pair = F.zip_with(F.slice(a, F.lit(1), F.length("seq") - 1), F.slice(a, F.lit(2), F.length("seq")), lambda x, y: F.concat(x, y))
    x = feeds.documents(spark, sf_dir).filter(F.length("seq") > 1).select("name", F.explode(pair).alias("p")).groupBy("name", "p").agg(F.count(F.lit(1)).alias("c"))
    terms = F.broadcast(force_field(spark).select(F.concat("aa_i", "aa_j").alias("p"), "aromatic", "cation_pi", "electrostatic", F.col("e").alias("energy")))  # 400 rows
    total = lambda c: F.sum(F.col("c") * F.col(c)).alias(c)
    return x.join(terms, "p").groupBy("name").agg(F.sum("c").alias("pairs"), *[total(c) for c in ("aromatic", "cation_pi", "electrostatic", "energy")])


@_register("ff_lookup", f"WITH {_seqs('documents', 'doc_id')}, {RESIDUES_SQL}, {FORCE_FIELD_SQL} SELECT name, idx_i::BIGINT AS idx_first, idx_j::BIGINT AS idx_last, {_r('e', 'energy')} FROM seqs JOIN ff ON aa_i = seq[1] AND aa_j = seq[length(seq)]")
def ff_lookup(spark, sf_dir):
    """The energy of the first residue of a document with its last, and their places in the alphabet."""
    x = feeds.documents(spark, sf_dir).select("name", F.substring("seq", 1, 1).alias("aa_i"), F.substring("seq", -1, 1).alias("aa_j"))
    ff = F.broadcast(force_field(spark).select("aa_i", "aa_j", F.col("idx_i").alias("idx_first"), F.col("idx_j").alias("idx_last"), F.col("e").alias("energy")))
    return x.join(ff, ["aa_i", "aa_j"]).select("name", "idx_first", "idx_last", "energy")


@_register("ff_rows", f"{_DOCS}, {RESIDUES_SQL}, {FORCE_FIELD_SQL}, u AS (SELECT aa, count(*) AS n FROM sites GROUP BY aa) SELECT aa_i, aa_j, {_r('e', 'energy')}, n AS occurrences FROM ff JOIN u ON u.aa = aa_i")
def ff_rows(spark, sf_dir):
    """The row of energies of each residue that the documents have."""
    x = sequences.composition(feeds.documents(spark, sf_dir)).groupBy("aa").agg(F.sum("n").alias("occurrences"))
    return force_field(spark).join(F.broadcast(x), F.col("aa_i") == F.col("aa")).select("aa_i", "aa_j", F.col("e").alias("energy"), "occurrences")  # 20 rows at most


@_register("ff_ranking", f"{_DOCS}, {RESIDUES_SQL}, {FORCE_FIELD_SQL}, u AS (SELECT aa, count(*) AS n FROM sites GROUP BY aa), k AS (SELECT aa_i AS aa, round(avg(e), 12) AS v, min(idx_i) AS idx FROM ff GROUP BY aa_i) SELECT aa, row_number() OVER (ORDER BY v, idx) AS rank, {_r('v', 'stickiness')}, n AS occurrences FROM k JOIN u USING (aa)")
def ff_ranking(spark, sf_dir):
    """The residues that the documents have, the stickiest first, equal ones by the alphabet."""
    from pyspark.sql import Window

    x = sequences.composition(feeds.documents(spark, sf_dir)).groupBy("aa").agg(F.sum("n").alias("occurrences"))
    k = stickiness(force_field(spark)).join(x, "aa")  # 20 rows at most
    return k.select("aa", F.row_number().over(Window.orderBy(F.round("stickiness", 12), F.instr(F.lit(ALPHABET), F.col("aa")))).alias("rank"), "stickiness", "occurrences")


@_register("theta_composition", f"{_DOCS}, k AS (SELECT name, aa, count(*) AS c FROM sites GROUP BY ALL) SELECT name, sum(c)::DOUBLE AS total, sum(c * c)::DOUBLE AS squares, max(c)::DOUBLE AS largest, count(*) AS used FROM k GROUP BY name")
def theta_composition(spark, sf_dir):
    x, t = fitting.composition_theta(feeds.documents(spark, sf_dir)), F.col("theta")
    return x.select("name", sequences.total(t).alias("total"), sequences.total(t, lambda v: v * v).alias("squares"), F.array_max(t).alias("largest"), F.size(F.filter(t, lambda v: v > 0)).cast("long").alias("used"))


_KERNEL = "kw(d, w) AS (VALUES " + ", ".join(f"({d - 8}, {x!r}::DOUBLE)" for d, x in enumerate(gaussian_weights(2.0))) + ")"
_SOFT = f"""{_DOCS}, {RESIDUES_SQL}, {FORCE_FIELD_SQL}, {_KERNEL}, fo AS (SELECT name, n, i, s, w, CASE WHEN f < n THEN f ELSE 2*n-1-f END AS src FROM (SELECT name, n, i, aa IN {_in(STICKERS)} AS s, w, ((i + d) % (2*n) + 2*n) % (2*n) AS f FROM sites, kw)),
cl AS (SELECT fo.name, any_value(fo.n) AS n, fo.s, b.aa, sum(w) AS w FROM fo JOIN sites b ON b.name = fo.name AND b.i = fo.src GROUP BY fo.name, fo.s, b.aa), kn AS (SELECT name, any_value(n) AS n, count(*) FILTER (aa IN {_in(STICKERS)}) AS k FROM sites GROUP BY name),
pr AS (SELECT a.name, a.s AS si, b.s AS sj, sum(a.w * b.w * e) AS e FROM cl a JOIN cl b ON b.name = a.name JOIN ff ON aa_i = a.aa AND aa_j = b.aa GROUP BY ALL),
pm AS (SELECT kn.name, any_value(n) AS n, any_value(k) AS k, coalesce(sum(e) FILTER (si AND sj) / any_value(k * k), 0) AS ss, coalesce(sum(e) FILTER (NOT si AND NOT sj) / any_value((n - k) * (n - k)), 0) AS ll, CASE WHEN any_value(k) > 0 AND any_value(k) < any_value(n) THEN coalesce(sum(e) FILTER (si <> sj), 0) / any_value(2 * k * (n - k)) ELSE 0 END AS cr FROM kn LEFT JOIN pr USING (name) GROUP BY kn.name)"""


def _linear(spark: SparkSession, sf_dir: str, want: str = "classes") -> DataFrame:
    x = moments.linear_energies(feeds.documents(spark, sf_dir), energy_matrix(spark), want=(want,))
    return x.withColumn("delta_g", 2.0 * F.col("ss") + 0.5 * F.col("ll") + F.col("cross")) if want == "classes" else x


@_register("delta_g_documents", f"{_SOFT} SELECT name, {_r('ss', 'ss')}, {_r('ll', 'll')}, {_r('cr', 'cross')}, {_r('2*ss + 0.5*ll + cr', 'delta_g')} FROM pm")
def delta_g_documents(spark, sf_dir):
    """The partitioned energies of whole documents, by factors."""
    return _linear(spark, sf_dir).select("name", "ss", "ll", "cross", "delta_g")


@_register("valency_documents", f"{_SOFT}, rg AS (SELECT name, len(regexp_extract_all(seq, '[{STICKERS}]+'))::BIGINT AS valency FROM seqs) SELECT name, valency, CASE WHEN k > 0 THEN round((2*ss + 0.5*ll + cr) / k, 6) + 0.0 END AS per_sticker FROM pm JOIN rg USING (name)")
def valency_documents(spark, sf_dir):
    x = segments.regions(feeds.documents(spark, sf_dir)).select("name", F.col("n_regions").alias("valency")).join(_linear(spark, sf_dir), "name")
    return x.select("name", "valency", F.when(F.col("n_stickers") > 0, F.col("delta_g") / F.col("n_stickers")).alias("per_sticker"))


@_register("linfit_delta_g", f"{_SOFT}, xy AS (SELECT k / n::DOUBLE AS x, 2*ss + 0.5*ll + cr AS y FROM pm) SELECT {_r('regr_slope(y, x)', 'slope')}, {_r('regr_intercept(y, x)', 'intercept')}, {_r('regr_r2(y, x)', 'r2')} FROM xy")
def linfit_delta_g(spark, sf_dir):
    """How the share of stickers tells delta G, over all documents."""
    x = _linear(spark, sf_dir).withColumn("x", F.col("n_stickers") / F.col("n"))
    return x.agg(F.regr_slope("delta_g", "x").alias("slope"), F.regr_intercept("delta_g", "x").alias("intercept"), F.regr_r2("delta_g", "x").alias("r2"))


@_register("profile_documents", f"""{_SOFT}, tt AS (SELECT name, any_value(n) AS n, aa, sum(w) AS w FROM cl GROUP BY name, aa), gg AS (SELECT tt.name, aa_i AS aa, sum(e * tt.w) / any_value(tt.n) AS g FROM tt JOIN ff ON aa_j = tt.aa GROUP BY tt.name, aa_i),
pv AS (SELECT fo.name, fo.i, sum(fo.w * g) AS v FROM fo JOIN sites b ON b.name = fo.name AND b.i = fo.src JOIN gg ON gg.name = fo.name AND gg.aa = b.aa GROUP BY fo.name, fo.i)
SELECT name, {_r('avg(v)', 'mean')}, {_r('min(v)', 'low')}, {_r('max(v)', 'high')}, {_r('stddev_pop(v)', 'std')} FROM pv GROUP BY name""")
def profile_documents(spark, sf_dir):
    """The mean, extremes and spread of the interaction profiles of whole documents, by factors."""
    x = _linear(spark, sf_dir, "profile")
    mean = sequences.total(F.col("profile")) / F.col("n")
    spread = sequences.let(mean, lambda m: F.sqrt(sequences.total(F.col("profile"), lambda v: F.pow(v - m, 2)) / F.col("n")))
    return x.select("name", mean.alias("mean"), F.array_min("profile").alias("low"), F.array_max("profile").alias("high"), spread.alias("std"))


_GRAM = f"""{_DOCS}, {RESIDUES_SQL}, {FORCE_FIELD_SQL}, {_KERNEL},
fo AS (SELECT name, i, w, CASE WHEN f < n THEN f ELSE 2*n-1-f END AS src FROM (SELECT name, n, i, w, ((i + d) % (2*n) + 2*n) % (2*n) AS f FROM sites, kw)),
so AS (SELECT fo.name, fo.i, b.aa, sum(w) AS w FROM fo JOIN sites b ON b.name = fo.name AND b.i = fo.src GROUP BY ALL),
gr AS (SELECT a.name, a.aa AS x, b.aa AS y, sum(a.w * b.w) AS g FROM so a JOIN so b ON b.name = a.name AND b.i = a.i GROUP BY ALL),
eg AS MATERIALIZED (SELECT gr.name, aa_i AS x, y, sum(e * g) AS h FROM gr JOIN ff ON aa_j = gr.x GROUP BY ALL),
sq AS (SELECT a.name, sum(a.h * b.h) AS q, sum(a.h) FILTER (a.x = a.y) AS d FROM eg a JOIN eg b ON b.name = a.name AND b.x = a.y AND b.y = a.x GROUP BY a.name),
nc AS (SELECT name, any_value(n)::DOUBLE AS n, aa, count(*) AS c FROM sites GROUP BY name, aa),
tm AS (SELECT a.name, any_value(a.n) AS n, sum(a.c * b.c * e) AS t FROM nc a JOIN nc b ON b.name = a.name JOIN ff ON aa_i = a.aa AND aa_j = b.aa GROUP BY a.name)"""


@_register("total_energy_documents", f"{_GRAM} SELECT name, {_r('(t - d) / 2', 'total')}, CASE WHEN n > 1 THEN round((t - d) / (n * (n - 1)), 6) + 0.0 ELSE 0 END AS mean FROM tm JOIN sq USING (name)")
def total_energy_documents(spark, sf_dir):
    """Total and mean pair energy of whole documents, by factors; in SQL by the Gram matrix of the soft compositions."""
    return _linear(spark, sf_dir, "total").select("name", "total", "mean")


# variants of the documents, training rows and the network

@_register("shuffled_documents")
def shuffled_documents(spark, sf_dir):
    """Three shuffles of each document: their composition stays, their order goes."""
    x = variants.shuffled(feeds.documents(spark, sf_dir), 3)
    return x.select("name", "k", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = _metrics(spark, sf_dir)
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("name"), (F.col("quality") == 1).alias("phase_separates"), F.lit(None).cast("double").alias("csat_relative")).dropDuplicates(["name"])
    return fitting.training_rows(metrics, known)


_TRAINING_SQL = f"""{_ENERGY}, lb0 AS (SELECT doc_id AS name, any_value(quality) AS quality FROM labels GROUP BY doc_id)
SELECT vm.name, {_r('h_chemistry', 'h_chem_target')}, NULL::DOUBLE AS csat_target, CASE WHEN quality IS NOT NULL THEN (quality = 1)::INT::DOUBLE ELSE (n_stickers > 5)::INT::DOUBLE END AS phase_target, NULL::DOUBLE AS h_eff_target, {_r('sticker_fraction', 'f_sticker')} FROM vm JOIN en ON en.name = vm.name LEFT JOIN lb0 ON lb0.name = vm.name"""


@_register("training_rows", _TRAINING_SQL)
def training_rows(spark, sf_dir):
    """Targets of each item, where there are any; the labels of documents of the same number stand for measured ones."""
    x = _training(spark, sf_dir)
    return x.select("name", "h_chem_target", "csat_target", "phase_target", "h_eff_target", F.get("features", 1).alias("f_sticker"))


@_register("mtl_predictions")
def mtl_predictions(spark, sf_dir):
    """Four heads, fitted on a bounded sample of the training rows, for every item."""
    return fitting.train_and_predict(_training(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return catalog.queries()


def oracle_sql() -> dict[str, str]:
    return catalog.oracle_sql()

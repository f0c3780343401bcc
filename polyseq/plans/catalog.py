"""Query ids to Spark queries, and to the same results in DuckDB SQL.

The SQL goes the direct way - a row for each residue or pair, windows and joins - where the operators go by
expressions, compositions or factors, so a comparison sets two derivations against each other. Texts are prose used as
residue strings. Operators with a row for each pair of positions read ``benchmark``, others ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseq.functions.residues import ALPHABET, ANIONIC, AROMATIC, CATIONIC, FORCE_FIELD_SQL, HYDROPHOBIC, POLAR, RESIDUES_SQL, STICKERS, energy_matrix, force_field, most_attractive, stickiness
from polyseq.operators import fitting, graph, hamiltonian, maps, moments, networks, segments, sequences
from polyseq.operators.maps import gaussian_weights
from polyseq.sources import feeds
from polyseq.sources.store import kept

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _in(letters: str) -> str:
    return "(" + ",".join(f"'{a}'" for a in letters) + ")"


_CLEAN = f"[^{ALPHABET}{ALPHABET.lower()}]"


def _seqs(table: str, name: str) -> str:
    return f"seqs AS (SELECT * FROM (SELECT {name} AS name, upper(regexp_replace(text, '{_CLEAN}', '', 'g')) AS seq FROM {table}) WHERE length(seq) > 0)"


_SITES = "sites AS (SELECT name, length(seq) AS n, unnest(range(length(seq)))::INT AS i, unnest(string_split(seq, '')) AS aa FROM seqs)"
_DOCS = f"WITH {_seqs('documents', 'doc_id')}, {_SITES}"
_STICKERS = f"st AS (SELECT *, i - lag(i) OVER (PARTITION BY name ORDER BY i) AS gap FROM sites WHERE aa IN {_in(STICKERS)})"
_RUNS = f"""runs AS (SELECT name, s, min(i) AS a, count(*) AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY name, s ORDER BY i) AS g FROM (SELECT *, aa IN {_in(STICKERS)} AS s FROM sites)) GROUP BY name, s, g)"""
_RAW = f"""WITH {_seqs('benchmark', 'item_id')}, {_SITES}, {RESIDUES_SQL}, {FORCE_FIELD_SQL},
raw AS (SELECT a.name, a.n, a.i, b.i AS j, a.aa AS aa_i, b.aa AS aa_j, e FROM sites a JOIN sites b ON a.name = b.name JOIN ff ON aa_i = a.aa AND aa_j = b.aa)"""


def _smooth(source: str, out: str, sigma_i: float, sigma_j: float, radius: int | None = None) -> str:
    """CTEs that smooth a map by rows and then by columns, with weights by (length, place, source); edges reflected or, with a radius, clamped."""
    def kernel(sigma: float, name: str) -> str:
        w = gaussian_weights(sigma, radius=radius)
        values = ", ".join(f"({d - len(w) // 2}, {x!r}::DOUBLE)" for d, x in enumerate(w))
        place = "((o + d) % (2*n) + 2*n) % (2*n)" if radius is None else "least(greatest(o + d, 0), n - 1)"
        return f"""{name} AS (SELECT n, o, CASE WHEN f < n THEN f ELSE 2*n-1-f END AS src, sum(w) AS w FROM (
  SELECT n, o, w, {place} AS f FROM (SELECT n, unnest(range(n))::INT AS o FROM (SELECT DISTINCT n FROM sites)), (VALUES {values}) AS k(d, w)) GROUP BY ALL)"""

    return f"""{kernel(sigma_i, 'ki_' + out)}, {kernel(sigma_j, 'kj_' + out)},
h_{out} AS (SELECT name, r.n, k.o AS i, j, sum(w * e) AS e FROM {source} r JOIN ki_{out} k ON k.n = r.n AND k.src = r.i GROUP BY ALL),
{out} AS (SELECT h.name, h.n, h.i, k.o AS j, sum(w * e) AS e FROM h_{out} h JOIN kj_{out} k ON k.n = h.n AND k.src = h.j GROUP BY ALL)"""


_MAP = f"{_RAW}, {_smooth('raw', 'm', 2.0, 2.0)}"
_SP = f"{_MAP}, sti AS (SELECT name, i FROM sites WHERE aa IN {_in(STICKERS)}), sp AS (SELECT m.* FROM m SEMI JOIN sti a ON a.name = m.name AND a.i = m.i SEMI JOIN sti b ON b.name = m.name AND b.i = m.j WHERE m.j > m.i)"


def _register(name: str, sql: str | None = None):
    """Rounded to six decimals on both sides, NaN and infinities null."""

    def wrap(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = hamiltonian.finite(f(spark, sf_dir))
            return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])

        _QUERIES[name] = query
        if sql:
            _SQL[name] = sql
        return f

    return wrap


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def _count(letters: str, name: str) -> str:
    return f"count(*) FILTER (aa IN {_in(letters)}) AS {name}"


def _item_maps(spark: SparkSession, sf_dir: str, sigma: float = 2.0, sigma_j: float | None = None) -> DataFrame:
    return maps.map_rows(feeds.items(spark, sf_dir), energy_matrix(spark), sigma, sigma_j)


# sequences

@_register("seq_validate", f"SELECT doc_id, length(regexp_replace(text, '[{ALPHABET}{ALPHABET.lower()}]', '', 'g'))::BIGINT AS n_other, regexp_full_match(text, '[{ALPHABET}{ALPHABET.lower()}]*') AS valid FROM documents")
def seq_validate(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select("doc_id", (F.length("text") - F.length(feeds.residues_of(F.col("text")))).cast("long").alias("n_other"), sequences.is_valid(F.col("text")).alias("valid"))


@_register("composition", f"{_DOCS} SELECT name, aa, count(*) AS n FROM sites GROUP BY ALL")
def composition(spark, sf_dir):
    return sequences.composition(feeds.documents(spark, sf_dir))


@_register("seq_properties", f"""{_DOCS}, y AS (SELECT name, min(i) AS first_y, avg(gap) AS mean_y_spacing FROM (SELECT *, i - lag(i) OVER (PARTITION BY name ORDER BY i) AS gap FROM sites WHERE aa = 'Y') GROUP BY name)
SELECT name, count(*) AS n, {_count('Y', 'n_tyrosine')}, {_count(AROMATIC, 'n_aromatic')}, {_count(CATIONIC, 'n_cationic')}, {_count(ANIONIC, 'n_anionic')}, {_count(POLAR, 'n_polar')}, {_count(HYDROPHOBIC, 'n_hydrophobic')},
  count(*) FILTER (aa IN {_in(CATIONIC)}) - count(*) FILTER (aa IN {_in(ANIONIC)}) AS net_charge, {_r("avg((aa = 'Y')::INT)", 'tyrosine_fraction')}, {_r(f"avg((aa IN {_in(AROMATIC)})::INT)", 'aromatic_fraction')},
  any_value(first_y)::BIGINT AS first_y, {_r('any_value(mean_y_spacing)', 'mean_y_spacing')} FROM sites LEFT JOIN y USING (name) GROUP BY name""")
def seq_properties(spark, sf_dir):
    return sequences.sequence_properties(feeds.documents(spark, sf_dir))


@_register("charge_metrics", f"{_DOCS}, {RESIDUES_SQL} SELECT name, {_r('avg(abs(q))', 'fcr')}, {_r('avg(q)', 'ncpr')}, {_r('avg(kd)', 'hydropathy')} FROM sites JOIN res USING (aa) GROUP BY name")
def charge_metrics(spark, sf_dir):
    return sequences.charge_metrics(feeds.documents(spark, sf_dir))


@_register("kappa_charge", f"""{_DOCS}, {RESIDUES_SQL}, w AS (SELECT name, n, i, q, sum(q) OVER (PARTITION BY name ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM sites JOIN res USING (aa)),
g AS (SELECT name, any_value(n) AS n, avg(abs(q)) AS fcr, avg((s/5.0::DOUBLE)*(s/5.0::DOUBLE)) FILTER (i <= n - 5) AS d FROM w GROUP BY name)
SELECT name, {_r('CASE WHEN n < 5 OR fcr < 1e-10 THEN 0 ELSE least(1.0, d / (fcr*fcr + 1e-10)) END', 'kappa')} FROM g""")
def kappa_charge(spark, sf_dir):
    return sequences.kappa_charge(feeds.documents(spark, sf_dir))


@_register("scd", f"""WITH {_seqs('benchmark', 'item_id')}, {_SITES}, {RESIDUES_SQL}, c AS (SELECT name, i, q FROM sites JOIN res USING (aa) WHERE q <> 0),
p AS (SELECT a.name, sum(a.q*b.q*sqrt(b.i-a.i)) AS s FROM c a JOIN c b ON a.name = b.name AND a.i < b.i GROUP BY a.name) SELECT name, {_r('coalesce(s, 0) / length(seq)', 'scd')} FROM seqs LEFT JOIN p USING (name)""")
def scd(spark, sf_dir):
    return sequences.charge_decoration(feeds.items(spark, sf_dir))


@_register("scd_documents")
def scd_documents(spark, sf_dir):
    return sequences.charge_decoration(feeds.documents(spark, sf_dir))


@_register("find_positions", f"{_DOCS} SELECT name, string_agg(i + 1, ',' ORDER BY i) AS tyrosines FROM sites WHERE aa = 'Y' GROUP BY name")
def find_positions(spark, sf_dir):
    x = feeds.documents(spark, sf_dir).select("name", F.array_join(F.transform(sequences.positions(F.col("seq"), "Y"), lambda i: (i + 1).cast("string")), ",").alias("tyrosines"))
    return x.filter("tyrosines <> ''")


@_register("mutation_validate", f"""WITH {_seqs('documents', 'doc_id')}, c AS (SELECT name, seq, unnest([concat(seq[length(seq)//2+1], length(seq)//2+1, 'S'), concat('Y', length(seq)//2+1, 's'), 'Y0S', 'YS', 'YxS', concat('B', '1', 'A'), concat('A', length(seq)+1, 'G')]) AS code FROM seqs),
p AS (SELECT *, upper(code[1]) AS old, upper(code[-1:]) AS new, TRY_CAST(code[2:length(code)-1] AS INT) AS pos FROM c)
SELECT name, code, CASE WHEN length(code) < 3 THEN 'format' WHEN pos IS NULL THEN 'position' WHEN NOT contains('{ALPHABET}', old) OR NOT contains('{ALPHABET}', new) THEN 'residue' WHEN pos < 1 OR pos > length(seq) THEN 'range' WHEN seq[pos] <> old THEN 'mismatch' ELSE 'ok' END AS status FROM p""")
def mutation_validate(spark, sf_dir):
    mid = F.floor(F.length("seq") / 2).cast("int") + 1
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    codes = F.array(text(F.substring(F.col("seq"), mid, F.lit(1)), mid, "S"), text("Y", mid, "s"), F.lit("Y0S"), F.lit("YS"), F.lit("YxS"), F.lit("B1A"), text("A", F.length("seq") + 1, "G"))
    x = feeds.documents(spark, sf_dir).select("name", "seq", F.explode(codes).alias("code"))
    return x.select("name", "code", sequences.parse_mutation(F.col("code"), F.col("seq"))["status"].alias("status"))


@_register("mutation_apply", f"WITH {_seqs('documents', 'doc_id')} SELECT name, md5(concat(seq[:length(seq)//2], 'S', seq[length(seq)//2+2:])) AS mutated FROM seqs")
def mutation_apply(spark, sf_dir):
    mid = F.floor(F.length("seq") / 2).cast("int") + 1
    return feeds.documents(spark, sf_dir).select("name", F.md5(sequences.apply_mutation(F.col("seq"), mid, F.lit("S"))).alias("mutated"))


@_register("mutation_apply_multi", f"{_DOCS} SELECT name, md5(string_agg(CASE WHEN i = 0 THEN 'W' WHEN i = n//2 THEN 'S' WHEN i = n - 1 THEN 'K' ELSE aa END, '' ORDER BY i)) AS mutated FROM sites WHERE n > 2 GROUP BY name")
def mutation_apply_multi(spark, sf_dir):
    change = lambda pos, new: F.struct(pos.cast("int").alias("pos"), F.lit(new).alias("new"))
    changes = F.array(change(F.lit(1), "W"), change(F.floor(F.length("seq") / 2) + 1, "S"), change(F.length("seq"), "K"))
    return feeds.documents(spark, sf_dir).filter(F.length("seq") > 2).select("name", F.md5(sequences.apply_mutations(F.col("seq"), changes)).alias("mutated"))


@_register("mutate_all", f"""{_DOCS}, y AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY i) AS k FROM sites WHERE aa = 'Y')
SELECT s.name, md5(string_agg(CASE WHEN k > 1 THEN 'S' ELSE s.aa END, '' ORDER BY s.i)) AS mutated, md5(coalesce(string_agg(CASE WHEN k > 1 THEN concat('Y', s.i + 1, 'S') END, ',' ORDER BY s.i), '')) AS codes FROM sites s LEFT JOIN y USING (name, i) GROUP BY s.name""")
def mutate_all(spark, sf_dir):
    first = F.array(F.instr("seq", "Y"))
    changed, codes = sequences.mutate_all(F.col("seq"), "Y", "S", exclude=first)
    return feeds.documents(spark, sf_dir).select("name", F.md5(changed).alias("mutated"), F.md5(F.array_join(codes, ",")).alias("codes"))


@_register("fasta_format", f"WITH {_seqs('documents', 'doc_id')} SELECT name, md5(concat('>', name, chr(10), array_to_string([seq[k:k+59] FOR k IN range(1, length(seq)+1, 60)], chr(10)))) AS record FROM seqs")
def fasta_format(spark, sf_dir):
    return feeds.documents(spark, sf_dir).select("name", F.md5(feeds.fasta(F.col("name"), F.col("seq"))).alias("record"))


@_register("gen_progressive", f"""{_DOCS}, y AS (SELECT name, i, row_number() OVER (PARTITION BY name ORDER BY i) AS k, count(*) OVER (PARTITION BY name) AS c FROM sites WHERE aa = 'Y')
SELECT s.name, count(*) FILTER (k <= round_even(0.25 * c, 0)) AS n, md5(string_agg(CASE WHEN k <= round_even(0.25 * c, 0) THEN 'S' ELSE aa END, '' ORDER BY s.i)) AS mutated FROM sites s LEFT JOIN y USING (name, i) GROUP BY s.name""")
def gen_progressive(spark, sf_dir):
    return sequences.fraction_mutated(feeds.documents(spark, sf_dir), 0.25).select("name", "n", F.md5("seq").alias("mutated"))


@_register("gen_single_site", f"""{_DOCS}, y AS (SELECT name, i, row_number() OVER (PARTITION BY name ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY name) AS c FROM sites WHERE aa = 'Y'),
q AS (SELECT DISTINCT name, y.i FROM y, range(6) r(x) WHERE k = floor(x * (c - 1) / 5.0)) SELECT name, (q.i + 1)::BIGINT AS pos, md5(concat(seq[:q.i], 'S', seq[q.i+2:])) AS mutated FROM q JOIN seqs USING (name)""")
def gen_single_site(spark, sf_dir):
    return sequences.single_site_variants(feeds.documents(spark, sf_dir)).select("name", "pos", F.md5("seq").alias("mutated"))


@_register("gen_blocks", f"""{_DOCS}, p AS (SELECT name, i, CASE WHEN aa = 'Y' THEN 'G' ELSE aa END AS aa, count(*) FILTER (aa = 'Y') OVER (PARTITION BY name) AS c FROM sites),
g AS (SELECT *, count(*) FILTER (aa = 'G') OVER (PARTITION BY name ORDER BY i) AS k FROM p)
SELECT name, md5(string_agg(CASE WHEN aa = 'G' AND k <= c THEN 'Y' ELSE aa END, '' ORDER BY i)) AS clustered FROM g GROUP BY name""")
def gen_blocks(spark, sf_dir):
    return feeds.documents(spark, sf_dir).select("name", F.md5(sequences.clustered(F.col("seq"))).alias("clustered"))


# segments

@_register("sticker_mask", f"{_DOCS} SELECT name, count(*) AS n, {_count(STICKERS, 'n_stickers')}, count(*) FILTER (aa NOT IN {_in(STICKERS)}) AS n_linker_residues, {_r(f'avg((aa IN {_in(STICKERS)})::INT)', 'sticker_fraction')} FROM sites GROUP BY name")
def sticker_mask(spark, sf_dir):
    return segments.sticker_mask(feeds.documents(spark, sf_dir))


@_register("chain_segments", f"{_DOCS}, {_RUNS} SELECT name, (row_number() OVER (PARTITION BY name ORDER BY a) - 1)::BIGINT AS seg, CASE WHEN s THEN 'sticker' ELSE 'linker' END AS kind, a::BIGINT AS start, (a + k)::BIGINT AS \"end\", seq[a+1:a+k] AS seq FROM runs JOIN seqs USING (name)")
def chain_segments(spark, sf_dir):
    return segments.segments(feeds.documents(spark, sf_dir))


@_register("chain_string", f"{_DOCS}, {_RUNS} SELECT name, md5(string_agg(concat(CASE WHEN s THEN 'S(' ELSE 'L(' END, k, ')'), '-' ORDER BY a)) AS chain FROM runs GROUP BY name")
def chain_string(spark, sf_dir):
    return feeds.documents(spark, sf_dir).select("name", F.md5(segments.chain_string(F.col("seq"))).alias("chain"))


@_register("regions_filtered", f"{_DOCS}, {_RUNS} SELECT name, count(*) FILTER (s AND k >= 2) AS n_regions, coalesce(max(k) FILTER (s AND k >= 2), 0)::BIGINT AS longest, coalesce(sum(k) FILTER (s AND k >= 2), 0)::BIGINT AS n_residues FROM runs GROUP BY name")
def regions_filtered(spark, sf_dir):
    return segments.regions(feeds.documents(spark, sf_dir), 2)


@_register("linker_stats", f"""{_DOCS}, {_STICKERS}, g AS (SELECT name, gap - 1 AS k FROM st WHERE gap > 1), a AS (SELECT name, count(*) AS n_gaps, avg(k) AS m, stddev_pop(k) AS s, min(k) AS lo, max(k) AS hi, sum(k) AS t FROM g GROUP BY name)
SELECT name, coalesce(n_gaps, 0) AS n_gaps, {_r('coalesce(m, 0)', 'mean_length')}, {_r('coalesce(s, 0)', 'std_length')}, coalesce(lo, 0)::BIGINT AS shortest, coalesce(hi, 0)::BIGINT AS longest, coalesce(t, 0)::BIGINT AS total_length,
  CASE WHEN n_gaps > 1 AND s >= 1e-10 THEN round(m / s, 6) + 0.0 END AS kappa FROM seqs LEFT JOIN a USING (name)""")
def linker_stats(spark, sf_dir):
    return segments.linker_statistics(feeds.documents(spark, sf_dir))


@_register("omega", f"{_DOCS}, {_STICKERS} SELECT name, CASE WHEN count(*) = 2 THEN 0 WHEN count(*) > 2 THEN round(stddev_pop(gap) / avg(gap), 6) + 0.0 END AS omega FROM seqs LEFT JOIN st USING (name) GROUP BY name")
def omega(spark, sf_dir):
    return segments.omega(feeds.documents(spark, sf_dir))


@_register("sticker_clustering", f"""{_DOCS}, {_STICKERS}, x AS (SELECT name, gap, lead(gap) OVER (PARTITION BY name ORDER BY i) AS nxt FROM st)
SELECT name, {_r('CASE WHEN count(x.name) < 2 THEN 0 ELSE avg((coalesce(gap, 99) <= 3 OR coalesce(nxt, 99) <= 3)::INT) END', 'clustering')} FROM seqs LEFT JOIN x USING (name) GROUP BY name""")
def sticker_clustering(spark, sf_dir):
    return segments.clustering(feeds.documents(spark, sf_dir))


@_register("entropy_spacing", f"""{_DOCS}, {_STICKERS}, g AS (SELECT name, gap, max(gap) OVER (PARTITION BY name) AS top FROM st WHERE gap IS NOT NULL),
b AS (SELECT name, least(floor((gap - 1) / (top / 10.0::DOUBLE)), 9) AS bin, count(*) AS c FROM g GROUP BY ALL), p AS (SELECT name, c / sum(c) OVER (PARTITION BY name) AS p FROM b), h AS (SELECT name, -sum(p * log2(p)) AS h, count(*) AS k FROM p GROUP BY name)
SELECT name, {_r('coalesce(h, 0)', 'entropy')}, {_r('CASE WHEN k > 1 THEN h / log2(k) ELSE 0 END', 'normalized')} FROM seqs LEFT JOIN h USING (name)""")
def entropy_spacing(spark, sf_dir):
    return segments.spacing_entropy(feeds.documents(spark, sf_dir))


@_register("entropy_block", f"{_DOCS}, {_RUNS}, p AS (SELECT name, c / sum(c) OVER (PARTITION BY name) AS p FROM (SELECT name, k, count(*) AS c FROM runs GROUP BY name, k)) SELECT name, {_r('-sum(p * log2(p))', 'entropy')} FROM p GROUP BY name")
def entropy_block(spark, sf_dir):
    return segments.block_entropy(feeds.documents(spark, sf_dir))


@_register("entropy_composition", f"{_DOCS}, p AS (SELECT name, c / sum(c) OVER (PARTITION BY name) AS p FROM (SELECT name, aa, count(*) AS c FROM sites WHERE aa IN {_in(STICKERS)} GROUP BY name, aa)) SELECT name, {_r('coalesce(-sum(p * log2(p)), 0)', 'entropy')} FROM seqs LEFT JOIN p USING (name) GROUP BY name")
def entropy_composition(spark, sf_dir):
    return segments.composition_entropy(feeds.documents(spark, sf_dir))


@_register("sticker_pair_dist", f"{_DOCS}, {_STICKERS} SELECT (b.i - a.i)::BIGINT AS d, count(*) AS pairs FROM st a JOIN (SELECT unnest(range(1, 30)) AS d) k ON true JOIN st b ON b.name = a.name AND b.i = a.i + k.d GROUP BY ALL")
def sticker_pair_dist(spark, sf_dir):
    return segments.sticker_pairs_by_separation(feeds.documents(spark, sf_dir))


@_register("theta_sticker", f"{_DOCS}, k AS (SELECT name, {_count(STICKERS, 's')}, count(*) FILTER (aa NOT IN {_in(STICKERS)}) AS l FROM sites GROUP BY name) SELECT name, s AS n_s, l AS n_l, (s*(s-1)//2)::BIGINT AS ss, (l*(l-1)//2)::BIGINT AS ll, (s*l)::BIGINT AS sl FROM k")
def theta_sticker(spark, sf_dir):
    return segments.theta_sticker(feeds.documents(spark, sf_dir))


_KIND = """CASE WHEN {0} IN ('Y','F','W') AND {1} IN ('Y','F','W') THEN 'pipi' WHEN ({0} IN ('R','K') AND {1} IN ('Y','F','W')) OR ({1} IN ('R','K') AND {0} IN ('Y','F','W')) THEN 'catpi'
 WHEN ({0} IN ('R','K') AND {1} IN ('D','E')) OR ({1} IN ('R','K') AND {0} IN ('D','E')) THEN 'elec_att' WHEN ({0} IN ('R','K') AND {1} IN ('R','K')) OR ({0} IN ('D','E') AND {1} IN ('D','E')) THEN 'elec_rep'
 WHEN {0} IN ('A','V','L','I','M','F','W') AND {1} IN ('A','V','L','I','M','F','W') THEN 'hydro' WHEN {0} IN ('S','T','N','Q','C','Y') AND {1} IN ('S','T','N','Q','C','Y') THEN 'polar' ELSE 'other' END""".format("a.aa", "b.aa")


@_register("theta_classes", f"WITH {_seqs('benchmark', 'item_id')}, {_SITES}, p AS (SELECT a.name, {_KIND} AS kind FROM sites a JOIN sites b ON a.name = b.name AND a.i < b.i) SELECT name, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("pipi", "catpi", "elec_att", "elec_rep", "hydro", "polar", "other")) + " FROM p GROUP BY name")
def theta_classes(spark, sf_dir):
    return segments.theta_classes(feeds.items(spark, sf_dir).filter(F.length("seq") > 1))


@_register("energy_uniform", f"{_RAW} SELECT name, {_r('coalesce(sum(e) FILTER (i < j), 0)', 'energy')} FROM raw GROUP BY name")
def energy_uniform(spark, sf_dir):
    return segments.uniform_energy(feeds.items(spark, sf_dir), energy_matrix(spark))


@_register("spearman", f"{_DOCS}, k AS (SELECT name, count(*) AS n, {_count(STICKERS, 's')} FROM sites GROUP BY name), r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS b FROM k) SELECT {_r('corr(a, b)', 'rho')} FROM r")
def spearman(spark, sf_dir):
    return hamiltonian.spearman(segments.sticker_mask(feeds.documents(spark, sf_dir)), "n", "n_stickers")


@_register("linfit", f"{_DOCS}, {RESIDUES_SQL}, k AS (SELECT name, avg((aa IN {_in(STICKERS)})::INT) AS x, avg(kd) AS y FROM sites JOIN res USING (aa) GROUP BY name) SELECT {_r('regr_slope(y, x)', 'slope')}, {_r('regr_intercept(y, x)', 'intercept')} FROM k")
def linfit(spark, sf_dir):
    seqs = feeds.documents(spark, sf_dir)
    x = seqs.select((sequences.count_of(F.col("seq"), STICKERS) / F.length("seq")).alias("x"), "seq", "name")
    y = sequences.charge_metrics(seqs)
    return x.join(y, "name").agg(F.regr_slope("hydropathy", "x").alias("slope"), F.regr_intercept("hydropathy", "x").alias("intercept"))


@_register("ff_neighbours", f"""{_DOCS}, {RESIDUES_SQL}, {FORCE_FIELD_SQL}, p AS (SELECT aa AS aa_i, lead(aa) OVER (PARTITION BY name ORDER BY i) AS aa_j FROM sites)
SELECT aa_i, aa_j, count(*) AS n, {_r('any_value(e)', 'energy')} FROM p JOIN ff USING (aa_i, aa_j) GROUP BY aa_i, aa_j""")
def ff_neighbours(spark, sf_dir):
    """Energies of the pairs of neighbours that occur, and how often."""
    a = sequences.letters(F.col("seq"))
    pair = F.zip_with(F.slice(a, F.lit(1), F.length("seq") - 1), F.slice(a, F.lit(2), F.length("seq")), lambda x, y: F.concat(x, y))
    x = feeds.documents(spark, sf_dir).filter(F.length("seq") > 1).select(F.explode(pair).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    x = x.select(F.substring("p", 1, 1).alias("aa_i"), F.substring("p", 2, 1).alias("aa_j"), "n")
    return x.join(F.broadcast(force_field(spark).select("aa_i", "aa_j", F.col("e").alias("energy"))), ["aa_i", "aa_j"])


# maps

_ROW = "SELECT name, i::BIGINT AS i, {0}, {1}, {2}, {3} FROM {{}} GROUP BY name, i".format(_r("sum(e)", "total"), _r("sum(e * (j + 1))", "moment"), _r("min(e)", "low"), _r("max(e)", "high"))


def _row_digest(rows: DataFrame) -> DataFrame:
    """name, i and, of each row of a map, its sum, its sum weighted by place, and its extremes."""
    add = lambda a, x: a + x
    return rows.select("name", "i", F.aggregate("e", F.lit(0.0), add).alias("total"), F.aggregate(F.transform("e", lambda v, j: v * (j + 1)), F.lit(0.0), add).alias("moment"), F.array_min("e").alias("low"), F.array_max("e").alias("high"))


@_register("map_smooth", f"{_MAP} {_ROW.format('m')}")
def map_smooth(spark, sf_dir):
    return _row_digest(_item_maps(spark, sf_dir))


@_register("map_raw", f"{_RAW} {_ROW.format('raw')}")
def map_raw(spark, sf_dir):
    return _row_digest(_item_maps(spark, sf_dir, 0))


@_register("map_smooth_aniso", f"{_RAW}, {_smooth('raw', 'm', 1.0, 3.0)} SELECT name, i::BIGINT AS i, {_r('avg(e)', 'mean')}, {_r('min(e)', 'low')} FROM m GROUP BY name, i")
def map_smooth_aniso(spark, sf_dir):
    x = _item_maps(spark, sf_dir, 1.0, 3.0)
    return x.select("name", "i", (F.aggregate("e", F.lit(0.0), lambda a, v: a + v) / F.col("n")).alias("mean"), F.array_min("e").alias("low"))


@_register("map_smooth_clamped", f"{_RAW}, {_smooth('raw', 'm', 2.0, 2.0, 6)} {_ROW.format('m')}")
def map_smooth_clamped(spark, sf_dir):
    """The smoothing with weights up to three sigma, the outermost residues going on beyond the edges."""
    return _row_digest(maps.map_rows(feeds.items(spark, sf_dir), energy_matrix(spark), edges="clamp"))


_STATS = "SELECT name, {0}, {1}, {2}, {3} FROM z GROUP BY name".format(_r("avg(e)", "mean"), _r("stddev_pop(e)", "std"), _r("min(e)", "low"), _r("max(e)", "high"))
for _method, _e in {"zscore": "CASE WHEN stddev_pop(e) OVER w < 1e-10 THEN 0 ELSE (e - avg(e) OVER w) / stddev_pop(e) OVER w END", "minmax": "CASE WHEN max(e) OVER w - min(e) OVER w < 1e-10 THEN 0 ELSE (e - min(e) OVER w) / (max(e) OVER w - min(e) OVER w) END", "symmetric": "CASE WHEN max(abs(e)) OVER w < 1e-10 THEN 0 ELSE e / max(abs(e)) OVER w END"}.items():

    @_register(f"map_normalize_{_method}", f"{_MAP}, k AS (SELECT name, i, j, CASE WHEN abs(i - j) <= 5 THEN 0 ELSE e END AS e FROM m), z AS (SELECT name, {_e} AS e FROM k WINDOW w AS (PARTITION BY name)) {_STATS}")
    def map_normalize(spark, sf_dir, method=_method):
        """Smoothed, masked, then normalised, so the masked zeros count."""
        rows = maps.map_rows(feeds.items(spark, sf_dir), energy_matrix(spark), mask=5, method=method)
        return maps.map_statistics(rows).select("name", "mean", "std", "low", "high")


@_register("map_stats", f"""{_MAP} SELECT name, {_r('avg(e)', 'mean')}, {_r('stddev_pop(e)', 'std')}, {_r('min(e)', 'low')}, {_r('max(e)', 'high')}, {_r('coalesce(avg(e) FILTER (i <> j), 0)', 'off_diagonal_mean')}, {_r('sum(e)', 'total')},
 count(*) FILTER (e < 0) AS n_attractive, count(*) FILTER (e > 0) AS n_repulsive, {_r('avg((e < 0)::INT)', 'attractive_fraction')} FROM m GROUP BY name""")
def map_stats(spark, sf_dir):
    return maps.map_statistics(_item_maps(spark, sf_dir))


@_register("profile_mean", f"{_MAP} SELECT name, i::BIGINT AS i, {_r('avg(e)', 'v')} FROM m GROUP BY name, i")
def profile_mean(spark, sf_dir):
    return maps.profile(_item_maps(spark, sf_dir)).select("name", "i", "v")


@_register("slide_mean", f"""{_MAP}, p AS (SELECT name, n, i, avg(e) AS v FROM m GROUP BY ALL), o AS (SELECT name, n, i, unnest(range(-2, 3)) AS d FROM p), f AS (SELECT name, n, i, ((i + d) % (2*n) + 2*n) % (2*n) AS f FROM o)
SELECT f.name, f.i::BIGINT AS i, {_r('sum(v) / 5', 'v')} FROM f JOIN p ON p.name = f.name AND p.i = CASE WHEN f < f.n THEN f ELSE 2*f.n-1-f END GROUP BY f.name, f.i""")
def slide_mean(spark, sf_dir):
    return maps.smoothed_profile(_item_maps(spark, sf_dir), 5, "uniform").select("name", "i", "v")


@_register("sticker_percentile", f"{_MAP}, p AS (SELECT name, i, avg(e) AS v FROM m GROUP BY ALL), q AS (SELECT name, quantile_cont(v, 0.25) AS t FROM p GROUP BY name) SELECT name, {_r('any_value(t)', 'threshold')}, count(*) FILTER (v <= t + 1e-12) AS n_low, count(*) FILTER (v < -0.01) AS n_energy FROM p JOIN q USING (name) GROUP BY name")
def sticker_percentile(spark, sf_dir):
    p = maps.profile(_item_maps(spark, sf_dir))
    t = p.groupBy("name").agg(F.percentile("v", F.lit(0.25)).alias("threshold"))
    return p.join(t, "name").groupBy("name").agg(F.max("threshold").alias("threshold"), F.count_if(F.col("v") <= F.col("threshold") + 1e-12).alias("n_low"), F.count_if(F.col("v") < -0.01).alias("n_energy"))


_SIDES = f"{_MAP}, x AS (SELECT m.*, a.aa IN {_in(STICKERS)} AS si, b.aa IN {_in(STICKERS)} AS sj FROM m JOIN sites a ON a.name = m.name AND a.i = m.i JOIN sites b ON b.name = m.name AND b.i = m.j), c AS (SELECT name, coalesce(avg(e) FILTER (si AND sj), 0) AS ss, coalesce(avg(e) FILTER (NOT si AND NOT sj), 0) AS ll, coalesce(avg(e) FILTER (si <> sj), 0) AS cr FROM x GROUP BY name)"


@_register("delta_g", f"{_SIDES} SELECT name, {_r('ss', 'ss')}, {_r('ll', 'll')}, {_r('cr', 'cross')}, {_r('2*ss + 0.5*ll + cr', 'delta_g')} FROM c")
def delta_g(spark, sf_dir):
    return maps.delta_g(_item_maps(spark, sf_dir))


@_register("total_energy", f"{_MAP} SELECT name, {_r('coalesce(sum(e) FILTER (j > i), 0)', 'total')}, {_r('coalesce(avg(e) FILTER (j > i), 0)', 'mean')} FROM m GROUP BY name")
def total_energy(spark, sf_dir):
    return maps.total_energy(_item_maps(spark, sf_dir))


_MUTANT = _MAP.replace("seqs AS (", "seqs0 AS (").replace(f", {_SITES}", f", seqs AS (SELECT name * 2 AS name, seq FROM seqs0 UNION ALL SELECT name * 2 + 1, replace(seq, 'Y', 'S') FROM seqs0), {_SITES}")


@_register("diff_metrics", f"""{_MUTANT}, d AS (SELECT b.name // 2 AS name, b.e - a.e AS e FROM m a JOIN m b ON a.name % 2 = 0 AND b.name = a.name + 1 AND a.i = b.i AND a.j = b.j)
SELECT name::BIGINT AS name, {_r('sum(e) / 2', 'total')}, {_r('sqrt(avg(e * e))', 'rmsd')}, {_r('min(e)', 'low')}, {_r('max(e)', 'high')}, {_r('avg(abs(e))', 'mean_abs')}, {_r('avg((abs(e) > 0.01)::INT)', 'changed')} FROM d GROUP BY ALL""")
def diff_metrics(spark, sf_dir):
    seqs, m = feeds.items(spark, sf_dir), energy_matrix(spark)
    variant = seqs.select("name", sequences.mutate_all(F.col("seq"), "Y", "S")[0].alias("seq"), F.col("seq").alias("reference"))
    return moments.map_differences(variant, m).drop("n", "profile")


@_register("local_density", f"{_MAP}, c AS (SELECT DISTINCT name, i AS c FROM m) SELECT c.name, c::BIGINT AS c, {_r('avg(e)', 'density')} FROM c JOIN m ON m.name = c.name AND m.i BETWEEN c - 3 AND c + 3 AND m.j BETWEEN c - 3 AND c + 3 GROUP BY ALL")
def local_density(spark, sf_dir):
    return maps.local_density(_item_maps(spark, sf_dir), 3)


@_register("contact_map", f"{_MAP} SELECT name, i::BIGINT AS i, count(*) FILTER (e < -0.02) AS contacts FROM m GROUP BY name, i")
def contact_map(spark, sf_dir):
    return maps.contact_counts(_item_maps(spark, sf_dir), -0.02)


@_register("energy_contact", f"{_RAW} SELECT name, {_r('coalesce(sum(e * power((j - i) / 5.0::DOUBLE, -1.5)) FILTER (j - i >= 3), 0)', 'energy')} FROM raw GROUP BY name")
def energy_contact(spark, sf_dir):
    return maps.contact_energy(_item_maps(spark, sf_dir, 0))


@_register("energy_by_sep", f"{_RAW} SELECT name, (j - i)::BIGINT AS d, {_r('sum(e)', 'energy')} FROM raw WHERE j > i GROUP BY ALL")
def energy_by_sep(spark, sf_dir):
    return maps.energy_by_separation(_item_maps(spark, sf_dir, 0))


@_register("ham_energy", f"{_RAW} SELECT name, {_r('coalesce(sum(e) FILTER (j - i >= 4), 0)', 'energy')} FROM raw GROUP BY name")
def ham_energy(spark, sf_dir):
    return maps.chain_energy(_item_maps(spark, sf_dir, 0))


@_register("ham_gradient", f"{_RAW} SELECT name, i::BIGINT AS i, {_r('coalesce(sum(e) FILTER (abs(j - i) >= 4), 0)', 'gradient')} FROM raw WHERE aa_i IN {_in(STICKERS)} GROUP BY name, i")
def ham_gradient(spark, sf_dir):
    return maps.chain_gradient(_item_maps(spark, sf_dir, 0))


@_register("ff_stickiness", f"{_DOCS}, {RESIDUES_SQL}, {FORCE_FIELD_SQL}, k AS (SELECT aa_i AS aa, avg(e) AS v FROM ff GROUP BY aa_i) SELECT name, {_r('avg(v)', 'stickiness')} FROM sites JOIN k USING (aa) GROUP BY name")
def ff_stickiness(spark, sf_dir):
    """The mean stickiness of the residues of each document."""
    rank = F.broadcast(stickiness(force_field(spark)))
    x = sequences.composition(feeds.documents(spark, sf_dir)).join(rank, "aa").groupBy("name")
    return x.agg((F.sum(F.col("n") * F.col("stickiness")) / F.sum("n")).alias("stickiness"))


@_register("ff_topk", f"{_DOCS}, {RESIDUES_SQL}, {FORCE_FIELD_SQL}, t AS (SELECT aa_i, aa_j, e FROM ff WHERE idx_i <= idx_j ORDER BY e, idx_i, idx_j LIMIT 10), c AS (SELECT name, aa, count(*) AS c FROM sites GROUP BY ALL) SELECT aa_i, aa_j, {_r('any_value(e)', 'e')}, sum(CASE WHEN aa_i = aa_j THEN a.c * (a.c - 1) // 2 ELSE a.c * b.c END)::BIGINT AS pairs FROM t JOIN c a ON a.aa = aa_i JOIN c b ON b.aa = aa_j AND b.name = a.name GROUP BY aa_i, aa_j")
def ff_topk(spark, sf_dir):
    """The most attractive pairs of residues, and how many such pairs the documents have."""
    c = sequences.composition(feeds.documents(spark, sf_dir))
    top = F.broadcast(most_attractive(force_field(spark)))
    a, b = (c.select("name", F.col("aa").alias(f"aa_{s}"), F.col("n").alias(f"n_{s}")) for s in "ij")
    pairs = F.when(F.col("aa_i") == F.col("aa_j"), F.expr("n_i * (n_i - 1) div 2")).otherwise(F.col("n_i") * F.col("n_j"))
    return a.join(top, "aa_i").join(b, ["name", "aa_j"]).groupBy("aa_i", "aa_j").agg(F.max("e").alias("e"), F.sum(pairs).alias("pairs"))


@_register("diff_topk", f"""{_MUTANT}, d AS (SELECT b.name // 2 AS name, b.i, avg(b.e - a.e) AS v FROM m a JOIN m b ON a.name % 2 = 0 AND b.name = a.name + 1 AND a.i = b.i AND a.j = b.j GROUP BY ALL)
SELECT name::BIGINT AS name, rank, i::BIGINT AS i, {_r('v', 'v')} FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(abs(v), 12) DESC, i DESC) AS rank FROM d) WHERE rank <= 5""")
def diff_topk(spark, sf_dir):
    seqs, m = feeds.items(spark, sf_dir), energy_matrix(spark)
    variant = seqs.select("name", sequences.mutate_all(F.col("seq"), "Y", "S")[0].alias("seq"), F.col("seq").alias("reference"))
    return moments.top_places(moments.map_differences(variant, m), 5)


@_register("sticker_hybrid", f"{_MAP}, p AS (SELECT name, i, avg(e) AS v FROM m GROUP BY ALL) SELECT name, i::BIGINT AS i, {_r('v', 'v')} FROM p JOIN sites USING (name, i) WHERE v < -0.01 AND aa IN {_in(STICKERS)}")
def sticker_hybrid(spark, sf_dir):
    return maps.stickers_hybrid(_item_maps(spark, sf_dir), -0.01)


@_register("sticker_sweep", f"{_MAP}, p AS (SELECT name, i, avg(e) AS v FROM m GROUP BY ALL) SELECT name, {_r('t', 'threshold')}, count(*) FILTER (v < t) AS n_stickers FROM p JOIN (SELECT unnest([-0.03, -0.02, -0.01, 0.0])::DOUBLE AS t) ON true GROUP BY name, t")
def sticker_sweep(spark, sf_dir):
    p = maps.profile_array(_item_maps(spark, sf_dir))
    limits = F.array(*[F.lit(t) for t in (-0.03, -0.02, -0.01, 0.0)])
    p = p.select("name", F.explode(limits).alias("threshold"), "p")
    return p.select("name", "threshold", F.size(F.filter("p", lambda v: v < F.col("threshold"))).cast("long").alias("n_stickers"))


@_register("valency", f"{_SIDES}, r AS (SELECT name, len(regexp_extract_all(seq, '[{STICKERS}]+'))::BIGINT AS valency, length(regexp_replace(seq, '[^{STICKERS}]', '', 'g')) AS k FROM seqs) SELECT name, valency, CASE WHEN k > 0 THEN round((2*ss + 0.5*ll + cr) / k, 6) + 0.0 END AS per_sticker FROM c JOIN r USING (name)")
def valency(spark, sf_dir):
    seqs = feeds.items(spark, sf_dir)
    k = sequences.count_of(F.col("seq"), STICKERS)
    x = segments.regions(seqs).select("name", F.col("n_regions").alias("valency")).join(seqs.select("name", k.alias("k")), "name")
    return x.join(maps.delta_g(_item_maps(spark, sf_dir)), "name").select("name", "valency", F.when(F.col("k") > 0, F.col("delta_g") / F.col("k")).alias("per_sticker"))


# graphs: the contacts of all residues below -0.1, four or more apart

_EDGES = f"{_MAP}, ed AS (SELECT name, i AS u, j AS v FROM m WHERE j - i >= 4 AND e < -0.1), bo AS (SELECT name, u AS i, v AS o FROM ed UNION ALL SELECT name, v, u FROM ed), dg AS (SELECT s.name, s.i, count(o) AS k FROM sites s LEFT JOIN bo USING (name, i) GROUP BY s.name, s.i), tr AS (SELECT a.name, a.u AS a, b.u AS b, b.v AS c FROM ed a JOIN ed b ON a.name = b.name AND a.v = b.u JOIN ed c ON c.name = a.name AND c.u = a.u AND c.v = b.v)"


def _contacts(spark, sf_dir):
    """The items with the threshold of their contacts."""
    return feeds.items(spark, sf_dir).withColumn("threshold", F.lit(-0.1))


#: All places are nodes, and energies are compared as they are.
_ALL = {"stickers": False, "digits": None}


def _neighbours(spark, sf_dir, triangles: bool = False):
    return networks.neighbours(_contacts(spark, sf_dir), energy_matrix(spark), triangles=triangles, **_ALL)


@_register("contact_graph", f"{_EDGES} SELECT name, u::BIGINT AS u, v::BIGINT AS v FROM ed")
def contact_graph(spark, sf_dir):
    return graph.contact_edges(_item_maps(spark, sf_dir), -0.1).select("name", "u", "v")


@_register("graph_degree", f"{_EDGES} SELECT name, count(*) AS n_nodes, (sum(k) / 2)::BIGINT AS n_edges, {_r('avg(k)', 'mean_degree')}, {_r('stddev_pop(k)', 'std_degree')}, max(k) AS max_degree, min(k) AS min_degree, {_r('CASE WHEN count(*) > 1 THEN sum(k)::DOUBLE / (count(*) * (count(*) - 1)) ELSE 0 END', 'density')} FROM dg GROUP BY name")
def graph_degree(spark, sf_dir):
    return networks.degree_statistics(_neighbours(spark, sf_dir))


@_register("graph_clustering", f"{_EDGES}, t AS (SELECT name, count(*) AS t FROM tr GROUP BY name), q AS (SELECT name, sum(k * (k - 1) / 2) AS q FROM dg GROUP BY name) SELECT name, {_r('CASE WHEN q > 0 THEN 3.0 * coalesce(t, 0) / q ELSE 0 END', 'clustering')} FROM q LEFT JOIN t USING (name)")
def graph_clustering(spark, sf_dir):
    return networks.clustering_coefficient(_neighbours(spark, sf_dir, True))


@_register("graph_local_clustering", f"{_EDGES}, t AS (SELECT name, i, count(*) AS t FROM (SELECT name, unnest([a, b, c]) AS i FROM tr) GROUP BY ALL) SELECT name, i::BIGINT AS i, {_r('CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END', 'clustering')} FROM dg LEFT JOIN t USING (name, i)")
def graph_local_clustering(spark, sf_dir):
    return networks.local_clustering(_neighbours(spark, sf_dir, True))


@_register("entropy_degree", f"{_EDGES}, c AS (SELECT name, k, count(*) AS c FROM dg GROUP BY ALL), p AS (SELECT name, c / sum(c) OVER (PARTITION BY name) AS p FROM c) SELECT name, {_r('-sum(p * log2(p))', 'entropy')} FROM p GROUP BY name")
def entropy_degree(spark, sf_dir):
    c = _neighbours(spark, sf_dir).groupBy("name", "degree").agg(F.count(F.lit(1)).alias("c")).groupBy("name")
    return c.agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c") + 0.0).alias("entropy"))


@_register("sticker_graph", f"{_SP}, q AS (SELECT name, quantile_cont(e, 0.25) AS t FROM sp WHERE j - i >= 4 GROUP BY name) SELECT name, i::BIGINT AS u, j::BIGINT AS v FROM sp JOIN q USING (name) WHERE j - i >= 4 AND round(e, 12) < round(t, 12)")
def sticker_graph(spark, sf_dir):
    rows = _item_maps(spark, sf_dir)
    x = graph.sticker_pairs(rows).filter("v - u >= 4").join(networks.auto_threshold(feeds.items(spark, sf_dir), energy_matrix(spark)).drop("seq"), "name")
    return x.filter(F.round("e", 12) < F.round("threshold", 12)).select("name", "u", "v")


@_register("graph_components")
def graph_components(spark, sf_dir):
    return networks.path_statistics(networks.searches(_contacts(spark, sf_dir), energy_matrix(spark), **_ALL))


@_register("graph_betweenness")
def graph_betweenness(spark, sf_dir):
    return networks.betweenness(networks.searches(_contacts(spark, sf_dir), energy_matrix(spark), flows=True, **_ALL))


@_register("auto_threshold", f"{_SP}, q AS (SELECT name, quantile_cont(e, 0.25) AS t FROM sp WHERE j - i >= 4 GROUP BY name) SELECT name, {_r('coalesce(t, 0)', 'threshold')} FROM seqs LEFT JOIN q USING (name)")
def auto_threshold(spark, sf_dir):
    return networks.auto_threshold(feeds.items(spark, sf_dir), energy_matrix(spark)).drop("seq")


@_register("entropy_interaction", f"""{_SP}, s AS (SELECT name, min(e) AS lo, max(e) AS hi, count(*) AS n FROM sp GROUP BY name), b AS (SELECT name, s.n, CASE WHEN hi - lo <= 0 THEN 10 ELSE least(floor((e - lo) / ((hi - lo) / 20)), 19) END AS bin, count(*) AS c FROM sp JOIN s USING (name) GROUP BY ALL)
SELECT name, {_r('coalesce(-sum(c / n * log2(c / n)), 0)', 'entropy')} FROM seqs LEFT JOIN b USING (name) GROUP BY name""")
def entropy_interaction(spark, sf_dir):
    return networks.interaction_entropy(feeds.items(spark, sf_dir), energy_matrix(spark))


@_register("percolation")
def percolation(spark, sf_dir):
    return networks.percolation(networks.percolation_curve(feeds.items(spark, sf_dir), energy_matrix(spark)))


@_register("homology_metrics")
def homology_metrics(spark, sf_dir):
    seqs, m = feeds.items(spark, sf_dir), energy_matrix(spark)
    return networks.persistence(networks.distance_spans(seqs, m), kept(networks.persistence_diagrams(seqs, m), "diagrams"))


def _metrics(spark, sf_dir):
    return hamiltonian.variant_metrics(feeds.items(spark, sf_dir), energy_matrix(spark))


@_register("variant_metrics")
def variant_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@_register("h_eff")
def h_eff(spark, sf_dir):
    return hamiltonian.effective_energy(_metrics(spark, sf_dir))


@_register("sensitivity")
def sensitivity(spark, sf_dir):
    return hamiltonian.sensitivity(hamiltonian.effective_energy(_metrics(spark, sf_dir)))


# representations

@_register("theta_pairs", f"WITH {_seqs('benchmark', 'item_id')}, {_SITES}, p AS (SELECT a.name, least(a.aa, b.aa) AS x, greatest(a.aa, b.aa) AS y, count(*) AS c FROM sites a JOIN sites b ON a.name = b.name AND a.i < b.i GROUP BY ALL) SELECT name, sum(CASE WHEN x = y THEN 2*c ELSE c END)::DOUBLE AS total, max(CASE WHEN x = y THEN 2*c ELSE c END)::DOUBLE AS largest, count(*) AS used FROM p GROUP BY name")
def theta_pairs(spark, sf_dir):
    x = fitting.pair_theta(feeds.items(spark, sf_dir).filter(F.length("seq") > 1))
    return x.select("name", sequences.total(F.col("theta")).alias("total"), F.array_max("theta").alias("largest"), F.size(F.filter("theta", lambda t: t > 0)).cast("long").alias("used"))


@_register("pca_composition")
def pca_composition(spark, sf_dir):
    return fitting.composition_components(feeds.documents(spark, sf_dir))


@_register("theta_r2")
def theta_r2(spark, sf_dir):
    """How well composition, stickers, classes and pair counts tell the uniform energy of the documents, and the smallest that does."""
    return fitting.minimal_representation(feeds.documents(spark, sf_dir), energy_matrix(spark))


@_register("features")
def features(spark, sf_dir):
    return fitting.features(_metrics(spark, sf_dir)).select("name", *[F.get("features", k).alias(f) for k, f in enumerate(fitting.FEATURES)])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

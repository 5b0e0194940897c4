"""The operators as queries over the driver's tables, and the same in DuckDB's SQL.

The tables hold no RNA, so the inputs are derived: a document's letters A, C, G,
T and U are its sequence; suppliers stand for lncRNAs, brands for diseases,
nations and regions for an ontology.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.alphabet import DINUCLEOTIDES, NUCLEOTIDES, canonical_words, reverse_complement, words
from helixframe.operators import association, cleaning, composition, correlation, embedding, kernels, similarity
from helixframe.plans.lineage import settle
from helixframe.sources import readers

Query = Callable[[SparkSession, str], DataFrame]

#: A supplier is associated with a brand when it sold more than this of it.
SOLD = 700.0
EDGE_WEIGHT = 0.8
#: Multiples of a quarter, so that every sum is exact in any order.
PROPS = {d: (0.25 * NUCLEOTIDES.index(d[0]), 0.5 * NUCLEOTIDES.index(d[1])) for d in DINUCLEOTIDES}
#: Places that default covariances are compared to. Their sums differ from SQL's by some 1e-14, and with quarters over short
#: lengths a value may end in a 5 at the fifth place, where the two would round apart; at the eighth none here does.
DIGITS = 8
PARTIAL_PROPS = {d: v for d, v in PROPS.items() if d not in ("GG", "CA")}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table over all cores, where its files give fewer splits than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTUacgtu]", "")
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").cast("string").alias("sample_id"), letters.alias("seq"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def _rounded_pairs(df: DataFrame) -> DataFrame:
    """Values of many pairs, 0 and above, at six places, halves up as in SQL; F.round makes a decimal of each."""
    scaled = F.col("value") * 1e6
    whole = F.rint(scaled)
    return df.withColumn("value", F.when(scaled - whole == 0.5, whole + 1).otherwise(whole) / 1e6)


def _sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sums = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy("l_suppkey", "p_brand").agg(F.sum("l_quantity").alias("value"))
    return sums.select(F.col("l_suppkey").cast("string").alias("lnc"), F.col("p_brand").alias("disease"), "value")


def _lncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("lnc"))


def _diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_brand").alias("disease")).distinct()


def _binary(spark: SparkSession, sf_dir: str, sold: DataFrame | None = None) -> DataFrame:
    return (sold or _sold(spark, sf_dir)).where(F.col("value") > SOLD).select("lnc", "disease", F.lit(1.0).alias("value"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    key, group = F.col("n_nationkey"), F.col("n_nationkey") % 3
    parts = [
        nation.select(name("N", key).alias("child"), name("R", F.col("n_regionkey")).alias("parent")),
        nation.select(name("N", key).alias("child"), name("G", group).alias("parent")),
        nation.select(name("G", group).alias("child"), name("R", group).alias("parent")),
        region.select(name("R", F.col("r_regionkey")).alias("child"), F.lit("WORLD").alias("parent")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _disease_terms(spark: SparkSession, sf_dir: str, sold: DataFrame | None = None) -> DataFrame:
    where = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("lnc"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("term"))
    return _binary(spark, sf_dir, sold).join(where, "lnc").select("disease", "term").distinct()


def _features(make: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, sf_dir: _rounded(make(sequences(spark, sf_dir)), digits)


def dag_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similarity.ancestor_values(_edges(spark, sf_dir), EDGE_WEIGHT))


def term_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similarity.term_similarity(similarity.ancestor_values(_edges(spark, sf_dir), EDGE_WEIGHT)))


def _bma(spark: SparkSession, sf_dir: str, sold: DataFrame | None = None) -> DataFrame:
    values = similarity.ancestor_values(_edges(spark, sf_dir), EDGE_WEIGHT)
    return similarity.disease_similarity(_diseases(spark, sf_dir), _disease_terms(spark, sf_dir, sold), values)


def _functional(limit: float) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Each is needed more than once, and is small beside what it is made from.
        sold = settle(_sold(spark, sf_dir))
        return _rounded_pairs(similarity.functional_similarity(sold, _lncs(spark, sf_dir), settle(_bma(spark, sf_dir, sold)), limit))

    return query


def disease_terms_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.group_terms(_disease_terms(spark, sf_dir)).select("disease", F.array_join("terms", ",").alias("terms"))


def svd_lnc(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sorted(r[0] for r in _diseases(spark, sf_dir).collect())
    return kernels.svd_features(_binary(spark, sf_dir), _lncs(spark, sf_dir), names, 8)[0]


def svd_disease(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sorted(r[0] for r in _diseases(spark, sf_dir).collect())
    return kernels.svd_features(_binary(spark, sf_dir), _lncs(spark, sf_dir), names, 8)[1]


def svd_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All factors multiplied give the matrix back."""
    names = sorted(r[0] for r in _diseases(spark, sf_dir).collect())
    left, right = kernels.svd_features(_binary(spark, sf_dir), _lncs(spark, sf_dir), names)
    dot = F.aggregate(F.zip_with("features", "g", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = left.select(F.col("id").alias("lnc"), "features").crossJoin(F.broadcast(right.select(F.col("id").alias("disease"), F.col("features").alias("g"))))
    return pairs.select("lnc", "disease", (F.round(dot, 6) + 0.0).alias("value"))


def _mean(name: str) -> Column:
    """Mean of a double column, added up as decimals, so that a mean at a limit does not hang on the order of the rows.

    Where a value is not finite or 10**10 and more, the mean is that of doubles.
    """
    x = F.col(name)
    return F.when(F.max(F.abs(x)) >= 1e10, F.avg(x)).otherwise(F.avg(x.try_cast("decimal(28,18)")).cast("double"))


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Suppliers as rows, part types as 0/1 columns D0, D1, ..., as raw label tables come, and the types of the columns."""
    lines = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_discount")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_type")
    cells = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy(F.col("l_suppkey").cast("string").alias("lnc"), F.col("p_type").alias("disease"))
    raw = cells.agg((_mean("l_discount") > 0.05).cast("int").alias("value"))
    # Types may be null, alike but for case, or named like other columns; so the columns are numbered.
    types = sorted((r[0] for r in raw.select("disease").distinct().collect()), key=lambda t: (t is not None, t))
    names = F.array(*[F.lit(t) for t in types]).cast("array<string>")
    number = F.coalesce(F.array_position(names, F.col("disease")), F.lit(1)) - 1  # a null, sorted first, has no position
    wide = association.to_wide(raw.withColumn("disease", F.concat(F.lit("D"), number.cast("string"))), [f"D{k}" for k in range(len(types))])
    return wide.withColumnRenamed("lnc", "ID").withColumns({"seqs": F.lit("ACGU"), "Unnamed: 0": F.lit(0)}), names


def _cells_of_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, names = _wide(spark, sf_dir)
    return association.from_wide(wide).select("lnc", F.get(names, F.substring("disease", 2, 9).cast("int")).alias("disease"), "value")


def y_from_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _binary(spark, sf_dir).select(F.col("lnc").alias("ID"), F.col("disease").alias("Disease Name"))
    y = association.from_pairs(raw)
    return association.full_grid(y).select("lnc", "disease", F.col("value").cast("int").alias("value"))


def y_from_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells_of_wide(spark, sf_dir)


def y_merge_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.full_grid(association.merge_or(_cells_of_wide(spark, sf_dir), _binary(spark, sf_dir)))


def y_restrict_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("lnc")).distinct()
    raw = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), (F.col("s_suppkey") % 40).cast("string")).alias("ID"), F.col("s_nationkey").cast("string").alias("Disease Name"))
    return association.from_pairs(raw, valid_ids=customers)


def clean_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_sequences(sequences(spark, sf_dir))


def preprocess_drop_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of conversations as candidate sequences; most have other letters and go."""
    parts = _table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sample_id"), F.explode(F.split("text", " ")).alias("seq")
    )
    return cleaning.preprocess(parts).groupBy("sample_id", "seq").agg(F.count("*").alias("n"))


def sequence_zip_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = _table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    seqs = order.select(F.col("doc_id").alias("pos"), F.regexp_replace("text", "[^ACGU]", "").alias("seq"))
    return cleaning.zip_ids(seqs, order.select(F.col("doc_id").alias("pos"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("sample_id")))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.chunk_table(sequences(spark, sf_dir), 128, 64)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("label", "embedding")


def _pool(how: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pooled = embedding.pool_vectors(_vectors(spark, sf_dir), how, "label", "embedding")
        return _rounded(pooled.select("label", F.posexplode("features").alias("dim", "value")))

    return query


def token_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = embedding.token_embeddings(sequences(spark, sf_dir), "toy")
    return tokens.groupBy("sample_id").agg(F.count("*").alias("tokens"), *[F.sum(F.col("features")[i]).alias(f"f{i}") for i in range(3)])


def encoder_toy_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = embedding.sequence_embeddings(sequences(spark, sf_dir), "toy")
    return _rounded(made.select("sample_id", *[F.col("features")[i].alias(f"f{i}") for i in range(3)]))


def encoder_toy_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = embedding.chunked_embeddings(sequences(spark, sf_dir), "toy", 128, 64, "max")
    return _rounded(made.select("sample_id", *[F.col("features")[i].alias(f"f{i}") for i in range(3)]))


def gip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_pairs(kernels.interaction_profile(_binary(spark, sf_dir), _lncs(spark, sf_dir), "lnc", "disease"))


def gip_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(kernels.interaction_profile(_binary(spark, sf_dir), _diseases(spark, sf_dir), "disease", "lnc"))


def queries() -> dict[str, Query]:
    c, r = composition, correlation
    return {
        "kmer_k1": _features(lambda s: c.kmer(s, 1)),
        "kmer_k2": _features(lambda s: c.kmer(s, 2)),
        "kmer_k3": _features(lambda s: c.kmer(s, 3)),
        "kmer_counts_k2": _features(lambda s: c.kmer(s, 2, normalize=False)),
        "kmer_long_k4": _features(lambda s: c.kmer_long(s, 4)),
        "rc_kmer_k2": _features(lambda s: c.canonical_kmer(s, 2)),
        "rc_kmer_k3": _features(lambda s: c.canonical_kmer(s, 3)),
        "psednc_lam2": _features(lambda s: r.pse_dnc(s, PROPS, 2)),
        "psednc_partial_props": _features(lambda s: r.pse_dnc(s, PARTIAL_PROPS, 2)),
        "dac_lag2": _features(lambda s: r.auto_covariance(s, PROPS, 2, exact_sums=True)),
        "dcc_lag2": _features(lambda s: r.cross_covariance(s, PROPS, 2, exact_sums=True)),
        "dacc_lag2": _features(lambda s: r.auto_cross_covariance(s, PARTIAL_PROPS, 2, exact_sums=True)),
        "dac_default": _features(lambda s: r.auto_covariance(s, PROPS, 2), DIGITS),
        "dcc_default": _features(lambda s: r.cross_covariance(s, PROPS, 2), DIGITS),
        "dacc_default": _features(lambda s: r.auto_cross_covariance(s, PARTIAL_PROPS, 2), DIGITS),
        "mono_comp": _features(c.mono_composition),
        "di_comp": _features(c.di_composition),
        "tri_comp": _features(c.tri_composition),
        "zcurve": _features(c.zcurve),
        "zcurve_raw": _features(lambda s: c.zcurve(s, normalize=False)),
        "mono_mono_gap0": _features(lambda s: c.mono_mono_gap(s, 0)),
        "mono_mono_gap1": _features(lambda s: c.mono_mono_gap(s, 1)),
        "mono_mono_gap2": _features(lambda s: c.mono_mono_gap(s, 2)),
        "mono_di_gap0": _features(lambda s: c.mono_di_gap(s, 0)),
        "mono_di_gap1": _features(lambda s: c.mono_di_gap(s, 1)),
        "clean_sequences": clean_sequences,
        "preprocess_drop_invalid": preprocess_drop_invalid,
        "sequence_zip_ids": sequence_zip_ids,
        "dag_closure": dag_closure,
        "term_similarity": term_similarity,
        "disease_terms_grouped": disease_terms_grouped,
        "disease_bma": lambda spark, sf_dir: _rounded(_bma(spark, sf_dir)),
        "lnc_functional_sim": _functional(SOLD),
        "lnc_functional_sim_thr": _functional(750.0),
        "gip_rows": gip_rows,
        "gip_cols": gip_cols,
        "svd_lnc": svd_lnc,
        "svd_disease": svd_disease,
        "svd_reconstruct": svd_reconstruct,
        "y_from_pairs": y_from_pairs,
        "y_from_wide": y_from_wide,
        "y_merge_or": y_merge_or,
        "y_restrict_ids": y_restrict_ids,
        "chunk_windows": chunk_windows,
        "pool_mean": _pool("mean"),
        "pool_max": _pool("max"),
        "token_long": token_long,
        "encoder_toy_sequence": encoder_toy_sequence,
        "encoder_toy_chunked": encoder_toy_chunked,
    }


# --- the same in SQL -----------------------------------------------------------------------------

_SEQS = """seqs AS (
  SELECT CAST(doc_id AS VARCHAR) AS sample_id,
         translate(upper(regexp_replace(coalesce(text, ''), '[^ACGTUacgtu]', '', 'g')), 'T', 'U') AS seq
  FROM documents)"""
_Y = f"""sold AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS lnc, p_brand AS disease, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
y AS (SELECT lnc, disease FROM sold WHERE value > {SOLD}),
lncs AS (SELECT CAST(s_suppkey AS VARCHAR) AS lnc FROM supplier),
diseases AS (SELECT DISTINCT p_brand AS disease FROM part)"""
_DAG = f"""edges AS (
  SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation
  UNION SELECT 'N' || n_nationkey, 'G' || (n_nationkey % 3) FROM nation
  UNION SELECT 'G' || (n_nationkey % 3), 'R' || (n_nationkey % 3) FROM nation
  UNION SELECT 'R' || r_regionkey, 'WORLD' FROM region),
terms AS (SELECT child AS term FROM edges UNION SELECT parent FROM edges),
walk AS (
  SELECT term, term AS ancestor, CAST(1 AS DOUBLE) AS s FROM terms
  UNION ALL SELECT walk.term, parent, s * CAST({EDGE_WEIGHT} AS DOUBLE) FROM walk JOIN edges ON ancestor = child),
closure AS (SELECT term, ancestor, max(s) AS s FROM walk GROUP BY ALL),
totals AS (SELECT term, sum(s) AS total FROM closure GROUP BY ALL),
sim AS (
  SELECT a.term AS term1, b.term AS term2,
         CASE WHEN a.term = b.term THEN CAST(1 AS DOUBLE) ELSE sum(a.s + b.s) / (any_value(t.total) + any_value(u.total)) END AS sim
  FROM closure a JOIN closure b USING (ancestor) JOIN totals t ON t.term = a.term JOIN totals u ON u.term = b.term
  GROUP BY a.term, b.term)"""
_TERMS = """dt AS (
  SELECT DISTINCT disease, 'N' || s_nationkey AS term FROM y JOIN supplier ON lnc = CAST(s_suppkey AS VARCHAR))"""


def _average(name: str, groups: str, key: str, members: str, item: str, sims: str) -> str:
    """CTEs that end in ``name(id1, id2, value)``: the best-match average, straight from its definition."""
    return f"""{name}_pairs AS (
  SELECT a.{key} AS id1, b.{key} AS id2, a.{item} AS d, max(coalesce(s.value, 0)) AS best
  FROM {members} a CROSS JOIN {members} b LEFT JOIN {sims} s ON s.i1 = a.{item} AND s.i2 = b.{item}
  GROUP BY ALL),
{name}_half AS (SELECT id1, id2, avg(best) AS half FROM {name}_pairs GROUP BY ALL),
{name} AS (
  SELECT g.{key} AS id1, h.{key} AS id2,
         CASE WHEN g.{key} = h.{key} THEN CAST(1 AS DOUBLE) ELSE (coalesce(p.half, 0) + coalesce(q.half, 0)) / 2 END AS value
  FROM {groups} g CROSS JOIN {groups} h
  LEFT JOIN {name}_half p ON p.id1 = g.{key} AND p.id2 = h.{key}
  LEFT JOIN {name}_half q ON q.id1 = h.{key} AND q.id2 = g.{key})"""


_BMA = f"{_Y}, {_DAG}, {_TERMS}, ts AS (SELECT term1 AS i1, term2 AS i2, sim AS value FROM sim), " + _average("bma", "diseases", "disease", "dt", "term", "ts")


def _counted(width: int, unit: str, labels: dict[str, list[str]], normalize: bool = True) -> str:
    """Windows of ``width`` letters; a label counts the windows whose ``unit`` is among its values."""
    cells = []
    for name, values in labels.items():
        count = f"count(*) FILTER (WHERE u IN ({', '.join(repr(v) for v in values)}))"
        value = f"CASE WHEN length(seq) >= {width} THEN {count} / CAST(length(seq) - {width - 1} AS DOUBLE) ELSE 0 END" if normalize else count
        cells.append(f'round(CAST({value} AS DOUBLE), 6) AS "{name}"')
    return f"""WITH {_SEQS}, spots AS (
  SELECT sample_id, seq, unnest(range(1, greatest(length(seq) - {width - 2}, 1))) AS i FROM seqs),
units AS (SELECT sample_id, {unit} AS u FROM spots)
SELECT seqs.sample_id, {', '.join(cells)} FROM seqs LEFT JOIN units USING (sample_id) GROUP BY seqs.sample_id, seq"""


def _kmers(k: int, normalize: bool = True) -> str:
    return _counted(k, f"substr(seq, i, {k})", {w: [w] for w in words(k)}, normalize)


def _canonical(k: int) -> str:
    return _counted(k, f"substr(seq, i, {k})", {w: sorted({w, reverse_complement(w)}) for w in canonical_words(k)})


def _gap(seconds: list[str], g: int) -> str:
    m = len(seconds[0])
    return _counted(g + 1 + m, f"substr(seq, i, 1) || substr(seq, i + {g + 1}, {m})", {f"{a}_{b}_gap{g}": [a + b] for a in NUCLEOTIDES for b in seconds})


def _tracks(props: dict) -> str:
    known = ", ".join(repr(d) for d in props)
    value = lambda at, scale: f"{scale} * CAST(strpos('ACGU', substr(d, {at}, 1)) - 1 AS DOUBLE)"
    return f"""{_SEQS}, spots AS (
  SELECT sample_id, seq, unnest(range(1, greatest(length(seq), 1))) AS i FROM seqs),
steps AS (SELECT sample_id, i, substr(seq, i, 2) AS d FROM spots),
kept AS (
  SELECT sample_id, row_number() OVER w AS p, count(*) OVER (PARTITION BY sample_id) AS n, {value(1, 0.25)} AS v0, {value(2, 0.5)} AS v1
  FROM steps WHERE d IN ({known}) WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
ahead AS (
  SELECT *, lead(v0, 1) OVER w AS v0_1, lead(v0, 2) OVER w AS v0_2, lead(v1, 1) OVER w AS v1_1, lead(v1, 2) OVER w AS v1_2
  FROM kept WINDOW w AS (PARTITION BY sample_id ORDER BY p))"""


def _pse(props: dict) -> str:
    theta = [f"coalesce(CASE WHEN any_value(n) > {lag} THEN (coalesce(sum(v0 * v0_{lag}), 0) + coalesce(sum(v1 * v1_{lag}), 0)) / (any_value(n) - {lag}) END, 0) AS t{lag}" for lag in (1, 2)]
    shares = ", ".join(f"count(*) FILTER (WHERE d = '{d}') AS \"{d}\"" for d in DINUCLEOTIDES)
    half = "CAST(0.5 AS DOUBLE)"
    cells = [f'round(CASE WHEN length(seq) >= 2 THEN (coalesce(c."{d}", 0) / CAST(length(seq) - 1 AS DOUBLE)) / s ELSE 0 END, 6) AS "{d}"' for d in DINUCLEOTIDES]
    cells += [f"round(CASE WHEN length(seq) >= 2 THEN {half} * coalesce(t{lag}, 0) / s ELSE 0 END, 6) AS theta_{lag}" for lag in (1, 2)]
    return f"""WITH {_tracks(props)},
t AS (SELECT sample_id, {', '.join(theta)} FROM ahead GROUP BY sample_id),
c AS (SELECT sample_id, {shares} FROM steps GROUP BY sample_id),
j AS (SELECT seqs.sample_id, seq, t1, t2, 1 + {half} * (coalesce(t1, 0) + coalesce(t2, 0)) AS s FROM seqs LEFT JOIN t USING (sample_id))
SELECT j.sample_id, {', '.join(cells)} FROM j LEFT JOIN c USING (sample_id)"""


def _cov(props: dict, auto: bool, cross: bool, digits: int = 6) -> str:
    pairs = [(m, m, f"AUTO_p{m}") for m in (0, 1)] * auto + [(a, b, f"CROSS_p{a}_p{b}") for a, b in ((0, 1), (1, 0))] * cross
    cells = []
    for a, b, name in pairs:
        for lag in (1, 2):
            k, seen = f"(any_value(n) - {lag})", f"FILTER (WHERE p + {lag} <= n)"
            total = f"sum(v{a} * v{b}_{lag}) {seen} - any_value(m{b}) * sum(v{a}) {seen} - any_value(m{a}) * sum(v{b}_{lag}) {seen} + {k} * any_value(m{a}) * any_value(m{b})"
            cells.append(f"round(coalesce(CASE WHEN any_value(n) > {lag} THEN ({total}) / {k} END, 0), {digits}) + 0 AS {name}_lag{lag}")
    return f"""WITH {_tracks(props)},
means AS (SELECT sample_id, sum(v0) / any_value(n) AS m0, sum(v1) / any_value(n) AS m1 FROM kept GROUP BY sample_id),
j AS (SELECT * FROM ahead JOIN means USING (sample_id))
SELECT seqs.sample_id, {', '.join(cells)} FROM seqs LEFT JOIN j USING (sample_id) GROUP BY seqs.sample_id"""


def _zcurve(normalize: bool) -> str:
    n = {x: f"(length(seq) - length(replace(seq, '{x}', '')))" for x in NUCLEOTIDES}
    axes = {"ZC_x": "AGCU", "ZC_y": "ACGU", "ZC_z": "AUCG"}
    over = lambda v: f"CASE WHEN length(seq) > 0 THEN {v} / CAST(length(seq) AS DOUBLE) ELSE 0 END" if normalize else v
    cells = [f"round(CAST({over(f'(({n[o[0]]} + {n[o[1]]}) - ({n[o[2]]} + {n[o[3]]}))')} AS DOUBLE), 6) AS {a}" for a, o in axes.items()]
    return f"WITH {_SEQS} SELECT sample_id, {', '.join(cells)} FROM seqs"


def _functional_sql(limit: float) -> str:
    average = _average("lfs", "lncs", "lnc", "sets", "disease", "ds")
    return f"""WITH RECURSIVE {_BMA}, ds AS (SELECT id1 AS i1, id2 AS i2, value FROM bma),
sets AS (SELECT lnc, disease FROM sold WHERE value > {limit}), {average}
SELECT id1 AS lnc1, id2 AS lnc2, round(value, 6) AS value FROM lfs"""


def _gip(key: str, other: str, ids: str) -> str:
    return f"""WITH {_Y}, q AS (SELECT g.{key} AS id, CAST(count(y.{other}) AS DOUBLE) AS q FROM {ids} g LEFT JOIN y USING ({key}) GROUP BY g.{key}),
gamma AS (SELECT CASE WHEN avg(q) > 0 THEN 1 / avg(q) ELSE 1 END AS gamma FROM q),
dots AS (SELECT a.{key} AS id1, b.{key} AS id2, CAST(count(*) AS DOUBLE) AS dot FROM y a JOIN y b USING ({other}) GROUP BY ALL)
SELECT a.id AS id1, b.id AS id2, round(exp(-gamma * greatest(a.q + b.q - 2 * coalesce(dot, 0), 0)), 6) AS value
FROM q a CROSS JOIN q b CROSS JOIN gamma LEFT JOIN dots ON id1 = a.id AND id2 = b.id"""


_WIDE = """w AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS lnc, p_type AS disease, CAST(avg(l_discount) > 0.05 AS INT) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def _grid(cells: str) -> str:
    return f"""SELECT l.lnc, d.disease, coalesce(value, 0) AS value
FROM (SELECT DISTINCT lnc FROM {cells}) l CROSS JOIN (SELECT DISTINCT disease FROM {cells}) d LEFT JOIN {cells} USING (lnc, disease)"""


def _toy(window: int | None) -> str:
    value = "strpos('ACGU', substr(seq, i, 1))"
    table = _SEQS
    if window:
        table += f""", pieces AS (SELECT sample_id, seq AS whole, unnest(range(0, greatest(length(seq) - {window}, 0) + 1, {window // 2})) AS start FROM seqs),
chunks AS (SELECT sample_id, start, substr(whole, start + 1, {window}) AS seq FROM pieces)"""
    source, keys = ("chunks", "sample_id, start") if window else ("seqs", "sample_id")
    how = "max" if window else "any_value"
    return f"""WITH {table}, spots AS (SELECT {keys}, seq, unnest(range(1, length(seq) + 1)) AS i FROM {source}),
v AS (SELECT {keys}, CAST({value} AS DOUBLE) AS v, CAST((i - 1) % 2 AS DOUBLE) AS o FROM spots),
m AS (SELECT {keys}, avg(v) AS f0, avg(v * v) AS f1, avg(o) AS f2 FROM v GROUP BY ALL)
SELECT seqs.sample_id, round({how}(f0), 6) AS f0, round({how}(f1), 6) AS f1, round({how}(f2), 6) AS f2
FROM seqs {'JOIN' if window else 'LEFT JOIN'} m USING (sample_id) GROUP BY seqs.sample_id"""


def _pool_sql(how: str) -> str:
    return f"""WITH c AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings)
SELECT label, CAST(dim AS INT) AS dim, round({how}(CAST(x AS DOUBLE)), 6) AS value FROM c GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    di = list(DINUCLEOTIDES)
    mono = list(NUCLEOTIDES)
    return {
        "kmer_k1": _kmers(1),
        "kmer_k2": _kmers(2),
        "kmer_k3": _kmers(3),
        "kmer_counts_k2": _kmers(2, normalize=False),
        "kmer_long_k4": f"""WITH {_SEQS}, spots AS (
  SELECT sample_id, seq, unnest(range(1, greatest(length(seq) - 2, 1))) AS i FROM seqs)
SELECT sample_id, substr(seq, i, 4) AS kmer, round(count(*) / CAST(any_value(length(seq)) - 3 AS DOUBLE), 6) AS value FROM spots GROUP BY ALL""",
        "rc_kmer_k2": _canonical(2),
        "rc_kmer_k3": _canonical(3),
        "psednc_lam2": _pse(PROPS),
        "psednc_partial_props": _pse(PARTIAL_PROPS),
        "dac_lag2": _cov(PROPS, True, False),
        "dcc_lag2": _cov(PROPS, False, True),
        "dacc_lag2": _cov(PARTIAL_PROPS, True, True),
        "dac_default": _cov(PROPS, True, False, DIGITS),
        "dcc_default": _cov(PROPS, False, True, DIGITS),
        "dacc_default": _cov(PARTIAL_PROPS, True, True, DIGITS),
        "mono_comp": _kmers(1),
        "di_comp": _kmers(2),
        "tri_comp": _kmers(3),
        "zcurve": _zcurve(True),
        "zcurve_raw": _zcurve(False),
        "mono_mono_gap0": _gap(mono, 0),
        "mono_mono_gap1": _gap(mono, 1),
        "mono_mono_gap2": _gap(mono, 2),
        "mono_di_gap0": _gap(di, 0),
        "mono_di_gap1": _gap(di, 1),
        "clean_sequences": f"WITH {_SEQS} SELECT sample_id, seq FROM seqs",
        "preprocess_drop_invalid": r"""WITH p AS (
  SELECT conv_id || '-' || turn AS sample_id, unnest(string_split(text, ' ')) AS w FROM conversations),
c AS (SELECT sample_id, replace(upper(regexp_replace(w, '^\s+|\s+$', '', 'g')), 'T', 'U') AS seq FROM p)
SELECT sample_id, seq, count(*) AS n FROM c WHERE translate(seq, 'ACGUN', '') = '' GROUP BY ALL""",
        "sequence_zip_ids": """SELECT doc_id AS pos, concat_ws('-', source, CAST(doc_id AS VARCHAR)) AS sample_id,
  regexp_replace(coalesce(text, ''), '[^ACGU]', '', 'g') AS seq FROM documents""",
        "dag_closure": f"WITH RECURSIVE {_DAG} SELECT term, ancestor, round(s, 6) AS s FROM closure",
        "term_similarity": f"WITH RECURSIVE {_DAG} SELECT term1, term2, round(sim, 6) AS sim FROM sim",
        "disease_terms_grouped": f"WITH {_Y}, {_TERMS} SELECT disease, string_agg(term, ',' ORDER BY term) AS terms FROM dt GROUP BY disease",
        "disease_bma": f"WITH RECURSIVE {_BMA} SELECT id1 AS disease1, id2 AS disease2, round(value, 6) AS value FROM bma",
        "lnc_functional_sim": _functional_sql(SOLD),
        "lnc_functional_sim_thr": _functional_sql(750.0),
        "gip_rows": _gip("lnc", "disease", "lncs"),
        "gip_cols": _gip("disease", "lnc", "diseases"),
        "svd_reconstruct": f"""WITH {_Y} SELECT l.lnc, d.disease, CAST(CASE WHEN y.lnc IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS value
FROM lncs l CROSS JOIN diseases d LEFT JOIN y USING (lnc, disease)""",
        "y_from_pairs": f"WITH {_Y}, c AS (SELECT lnc, disease, 1 AS value FROM y) {_grid('c')}",
        "y_from_wide": f"""WITH {_WIDE} SELECT l.lnc, d.disease, CAST(coalesce(value, 0) AS DOUBLE) AS value
FROM (SELECT DISTINCT lnc FROM w) l CROSS JOIN (SELECT DISTINCT disease FROM w) d LEFT JOIN w USING (lnc, disease)""",
        "y_merge_or": f"""WITH {_Y}, {_WIDE}, g AS ({_grid('w')}),
c AS (SELECT lnc, disease, max(value) AS value FROM (SELECT * FROM g UNION ALL SELECT lnc, disease, 1 FROM y) GROUP BY ALL) {_grid('c')}""",
        "y_restrict_ids": """SELECT DISTINCT 'C' || (s_suppkey % 40) AS lnc, CAST(s_nationkey AS VARCHAR) AS disease, 1 AS value
FROM supplier WHERE 'C' || (s_suppkey % 40) IN (SELECT 'C' || c_nationkey FROM customer)""",
        "chunk_windows": f"""WITH {_SEQS}, p AS (SELECT sample_id, seq, unnest(range(0, greatest(length(seq) - 128, 0) + 1, 64)) AS start FROM seqs)
SELECT sample_id, CAST(start / 64 AS INT) AS piece, substr(seq, start + 1, 128) AS seq FROM p""",
        "pool_mean": _pool_sql("avg"),
        "pool_max": _pool_sql("max"),
        "token_long": f"""WITH {_SEQS}, spots AS (SELECT sample_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs),
v AS (SELECT sample_id, CAST(strpos('ACGU', substr(seq, i, 1)) AS DOUBLE) AS v, CAST((i - 1) % 2 AS DOUBLE) AS o FROM spots)
SELECT sample_id, count(*) AS tokens, sum(v) AS f0, sum(v * v) AS f1, sum(o) AS f2 FROM v GROUP BY sample_id""",
        "encoder_toy_sequence": _toy(None),
        "encoder_toy_chunked": _toy(128),
    }

"""Queries on scores: thresholds, calibration, bootstrap, rank statistics, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import calibration, clustering, resampling, scoring, thresholds
from fieldloom.plans import hosts
from fieldloom.plans.hosts import sql
from fieldloom.sources.tables import table

DRAWS = 40


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, t in df.dtypes if t == "double"})


def auroc_tieaware(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(resampling.auroc(hosts.scored(spark, d), "s", "y", ["lang"]))


def ece_width(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thresholds.ece(thresholds.reliability(hosts.scored(spark, d), "s", "y")))


def ece_mass(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thresholds.reliability(hosts.scored(spark, d), "s", "y", mass=True, tie="doc"))


def coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thresholds.coverage_curve(hosts.scored(spark, d), "s", "y", "doc"))


def select_tau(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thresholds.select_tau(hosts.scored(spark, d), "s", "y", 0.9, ["lang"]))


def nested_tau(spark: SparkSession, d: str) -> DataFrame:
    acc = thresholds.nested_accept(hosts.scored(spark, d), "s", "y", "fold", [0, 1, 2], 0.9)
    return _rounded(thresholds.review_counts(acc, "accept", "y", "lang"))


def precision_at_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thresholds.precision_at_coverage(hosts.scored(spark, d), "s", "y", 0.5))


def review_flags(spark: SparkSession, d: str) -> DataFrame:
    s = hosts.scored(spark, d).withColumn("emitted", F.col("doc") % 4 != 0)
    s = s.withColumn("flag", thresholds.flags(s, "lang", "s", "emitted", {"en": 0.5, "de": 0.8, "fr": None}))
    return s.groupBy("lang", "flag").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("right"))


def doc_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thresholds.doc_features(hosts.scored(spark, d), "lang", "s"))


def calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    s, y = F.col("s"), F.col("y").cast("double")
    return _rounded(hosts.scored(spark, d).groupBy("lang").agg(resampling.log_loss(s, y).alias("log_loss"), F.avg((s - y) * (s - y)).alias("brier"), F.avg(y).alias("base_rate")))


def cross_fit_scores(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities; fitted, so without SQL."""
    s = hosts.scored(spark, d).withColumn("n_chars", F.col("n_chars").cast("double"))
    return calibration.cross_fit(s, ["s", "n_chars"], "y", "fold", [0, 1, 2]).select("doc", "fold", F.round("p", 6).alias("p"))


def portable_scores(spark: SparkSession, d: str) -> DataFrame:
    m = calibration.PortableModel(("s", "n_chars"), (0.5, 1000.0), (0.5, 2000.0), (0.25, 1500.0), (1.5, -0.25), 0.75)
    return hosts.scored(spark, d).select("doc", F.round(m.probability(), 6).alias("p"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("l_returnflag") == "R"
    q = F.round(F.col("l_quantity")).cast("long")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.sum(q).alias("n"), F.sum(F.when(r, q).otherwise(0)).alias("a"), F.sum(F.when(F.col("l_linestatus") == "F", q).otherwise(0)).alias("b"))


def hash_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    drawn = resampling.draws(_units(spark, d), "doc", ["a", "b", "n"], DRAWS)
    return _rounded(resampling.intervals(drawn, {"returned": F.try_divide(F.col("a").cast("double"), F.col("n").cast("double")), "filled": F.try_divide(F.col("b").cast("double"), F.col("n").cast("double"))}))


def paired_bootstrap_delta(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(resampling.paired_delta(_units(spark, d), "doc", ("a", "n"), ("b", "n"), DRAWS))


def wilson_rates(spark: SparkSession, d: str) -> DataFrame:
    s = hosts.scored(spark, d).groupBy("lang").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    return s.select("lang", "k", "n", resampling.wilson(F.col("k"), F.col("n")).alias("w")).select("lang", "k", "n", F.round("w.lo", 6).alias("lo"), F.round("w.hi", 6).alias("hi"))


def ks_two_sample(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(resampling.ks_distance(table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R"))


def ols_latency(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("tokens", F.col("event_id") % 100 + F.col("value"))
    return _rounded(resampling.least_squares(e, "tokens", "value", ["event_type"]))


def spearman_rank(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(resampling.spearman(table(spark, d, "part"), "p_size", "p_retailprice", ["p_brand"]))


def latency_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.distribution(table(spark, d, "events"), ["event_type"], "value"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("fold", F.col("vec_id") % 3)


def nearest_centre(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    out = clustering.nearest_centre(v, "embedding", clustering.centres(v, ["label"], "embedding", 64), "label")
    return out.select("vec_id", "label", "nearest", F.round("distance", 3).alias("distance"))


def purity_ari(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    out = clustering.nearest_centre(v, "embedding", clustering.centres(v.where("fold <> 0"), ["label"], "embedding", 64), "label")
    return _rounded(clustering.agreement(out.withColumn("cluster", F.col("nearest") % 4), "label", "cluster"))


def novelty_by_fold(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the nearest centre of the other folds, by fold."""
    v, parts = _vectors(spark, d), []
    for k in range(3):
        ref = clustering.centres(v.where(F.col("fold") != k), ["label"], "embedding", 64)
        parts.append(clustering.nearest_centre(v.where(F.col("fold") == k), "embedding", ref, "label"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 3).alias("mean"), F.round(F.max("distance"), 3).alias("max"))


def layout_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Fitted clusters; without SQL, as the fit depends on the engine."""
    v = _vectors(spark, d)
    return clustering.assign_clusters(clustering.fit_clusters(v, "embedding", 8), v, "embedding").select("vec_id", "label", "cluster")


def printed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Filled share of a column by group and what that says of the print."""
    g = hosts.gold_rows(spark, d).join(hosts.groups(spark, d).select("doc", "grp"), "doc").groupBy("grp").agg(F.count("po").alias("filled"), F.count("*").alias("rows"))
    return g.select("grp", "filled", "rows", scoring.column_state("filled", "rows").alias("state"), F.round(F.col("filled") / F.col("rows"), 6).alias("share"))


QUERIES = {f.__name__: f for f in (
    auroc_tieaware, ece_width, ece_mass, coverage_curve, select_tau, nested_tau, precision_at_coverage, review_flags, doc_features, calibration_summary, cross_fit_scores, portable_scores, hash_bootstrap_ci,
    paired_bootstrap_delta, wilson_rates, ks_two_sample, ols_latency, spearman_rank, latency_distribution, nearest_centre, purity_ari, novelty_by_fold, layout_clusters, printed_fields,
)}

_TIES = "SELECT *, sum(n) OVER w AS accepted, sum(k) OVER w AS right_ FROM t WINDOW w AS ({by}ORDER BY s DESC)"
_U = "SELECT l_orderkey AS doc, CAST(sum(round(l_quantity)) AS BIGINT) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN round(l_quantity) ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN l_linestatus = 'F' THEN round(l_quantity) ELSE 0 END) AS BIGINT) AS b FROM lineitem GROUP BY 1"
_CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
_D = (
    f"SELECT draw, {' + '.join(f'(u >= {c})::INT' for c in _CUTS)} AS m, a, b, n FROM (SELECT draw, a, b, n, CAST('0x' || substr(md5(draw || '|' || doc), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM u, (SELECT unnest(range(1, {DRAWS + 1})) AS draw))"
)
_DR = "SELECT draw, sum(m * a)::DOUBLE AS a, sum(m * b)::DOUBLE AS b, sum(m * n)::DOUBLE AS n FROM d GROUP BY draw"
_CENTRES = "SELECT label AS c_label, list(x ORDER BY i) AS centre FROM (SELECT label, i, avg(v::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings WHERE {where}) GROUP BY label, i) GROUP BY label"
_NEAREST = "SELECT vec_id, label, arg_min(c_label, (dist, c_label)) AS nearest, min(dist) AS distance FROM (SELECT e.vec_id, e.label, c.c_label, sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], centre), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS dist FROM embeddings e, c WHERE {where}) GROUP BY vec_id, label"
SQL = {
    "auroc_tieaware": sql(("sc",), "SELECT lang, round(sum(p * (below + 0.5 * q)) / (sum(p) * sum(q))::DOUBLE, 6) AS auroc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t) GROUP BY lang", t="SELECT lang, s, sum((y = 1)::INT) AS p, sum((y <> 1)::INT) AS q FROM sc GROUP BY lang, s"),
    "ece_width": sql(("sc",), "SELECT round(sum(n * abs(p - r)) / sum(n), 6) AS ece FROM b", b="SELECT least(floor(s * 15), 14) AS bin, count(*) AS n, avg(s) AS p, avg(y) AS r FROM sc GROUP BY 1"),
    "ece_mass": sql(("sc",), "SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(s), 6) AS mean_p, round(avg(y), 6) AS rate FROM (SELECT *, ntile(15) OVER (ORDER BY s, doc) - 1 AS bin FROM sc) GROUP BY bin"),
    "coverage_curve": sql(("sc",), "SELECT CAST(point AS INT) AS point, r.k::INT AS k, round(accuracy, 6) AS accuracy FROM r JOIN (SELECT point, greatest(1, round_even(point * n / 50.0::DOUBLE, 0))::INT AS k FROM (SELECT unnest(range(1, 51)) AS point), (SELECT count(*) AS n FROM sc)) w USING (k)", r="SELECT row_number() OVER (ORDER BY s DESC, doc) AS k, avg(y) OVER (ORDER BY s DESC, doc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS accuracy FROM sc"),
    "select_tau": sql(("sc",), "SELECT lang, round(min(CASE WHEN right_ / accepted::DOUBLE >= 0.9 THEN s END), 6) AS tau FROM x GROUP BY lang", t="SELECT lang, s, count(*) AS n, sum(y) AS k FROM sc GROUP BY lang, s", x=_TIES.format(by="PARTITION BY lang ")),
    "nested_tau": sql(
        ("sc",), "SELECT round(sum((acc AND y = 1)::INT) / nullif(sum(acc::INT), 0)::DOUBLE, 6) AS precision, round(sum((NOT acc AND y = 0)::INT) / nullif(sum((y = 0)::INT), 0)::DOUBLE, 6) AS error_recall, round(1 - sum(acc::INT) / count(*)::DOUBLE, 6) AS review_rate, round((SELECT avg(w::INT) FROM (SELECT bool_and(acc) AS w FROM a GROUP BY lang)), 6) AS docs_accepted FROM a",
        t="SELECT f, s, count(*) AS n, sum(y) AS k FROM sc, (SELECT unnest([0, 1, 2]) AS f) WHERE fold <> f GROUP BY f, s", x=_TIES.format(by="PARTITION BY f "),
        u="SELECT f, min(CASE WHEN right_ / accepted::DOUBLE >= 0.9 THEN s END) AS tau FROM x GROUP BY f", a="SELECT sc.*, coalesce(s >= tau, false) AS acc FROM sc LEFT JOIN u ON fold = f",
    ),
    "precision_at_coverage": sql(("sc",), "SELECT round(s, 6) AS tau, round(right_ / accepted::DOUBLE, 6) AS precision, round(accepted / (SELECT count(*) FROM sc)::DOUBLE, 6) AS coverage FROM x WHERE accepted >= 0.5 * (SELECT count(*) FROM sc) ORDER BY right_ / accepted::DOUBLE DESC, accepted DESC LIMIT 1", t="SELECT s, count(*) AS n, sum(y) AS k FROM sc GROUP BY s", x=_TIES.format(by="")),
    "review_flags": sql(("sc",), "SELECT lang, CASE WHEN doc % 4 = 0 THEN 'unscored' WHEN (lang = 'en' AND s >= 0.5) OR (lang = 'de' AND s >= 0.8) THEN 'accept' ELSE 'review' END AS flag, count(*) AS n, CAST(sum(y) AS BIGINT) AS \"right\" FROM sc GROUP BY 1, 2"),
    "doc_features": sql(("sc",), f"SELECT lang, count(*) AS n, round(min(s), 6) AS min_p, round(avg(s), 6) AS mean_p, round(sum(1 - s), 6) AS expected_errors, {', '.join(f'CAST(sum((s < {c})::INT) AS BIGINT) AS below_{round(100 * c)}' for c in (0.5, 0.7, 0.8, 0.9, 0.95))} FROM sc GROUP BY lang"),
    "calibration_summary": sql(("sc",), "SELECT lang, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg((s - y) * (s - y)), 6) AS brier, round(avg(y), 6) AS base_rate FROM (SELECT *, least(greatest(s, 1e-15), 1 - 1e-15) AS q FROM sc) GROUP BY lang"),
    "portable_scores": sql(("sc",), "SELECT doc, round(1 / (1 + exp(-(0.75 + (s - 0.5) / 0.25 * 1.5 + (n_chars - 2000.0::DOUBLE) / 1500.0::DOUBLE * -0.25))), 6) AS p FROM sc"),
    "hash_bootstrap_ci": sql((), "SELECT 'returned' AS metric, round(quantile_cont(a / n, 0.025), 6) AS lo, round(quantile_cont(a / n, 0.975), 6) AS hi FROM r UNION ALL SELECT 'filled', round(quantile_cont(b / n, 0.025), 6), round(quantile_cont(b / n, 0.975), 6) FROM r", u=_U, d=_D, r=_DR),
    "paired_bootstrap_delta": sql((), "SELECT round(quantile_cont(b / n - a / n, 0.025), 6) AS lo, round(quantile_cont(b / n - a / n, 0.975), 6) AS hi, round(avg((b / n - a / n <= 0)::INT), 6) AS share_not_better FROM r", u=_U, d=_D, r=_DR),
    "wilson_rates": sql(("sc",), "SELECT lang, CAST(k AS BIGINT) AS k, n, round(greatest((k + z * z / 2) / (n + z * z) - h, 0), 6) AS lo, round(least((k + z * z / 2) / (n + z * z) + h, 1), 6) AS hi FROM (SELECT *, z * sqrt(k * (n - k) / n::DOUBLE + z * z / 4) / (n + z * z) AS h FROM (SELECT lang, sum(y)::DOUBLE AS k, count(*) AS n, 1.959963984540054::DOUBLE AS z FROM sc GROUP BY lang))"),
    "ks_two_sample": "SELECT round(max(abs(a / sa::DOUBLE - b / sb::DOUBLE)), 6) AS ks FROM (SELECT sum(a) OVER (ORDER BY x) AS a, sum(b) OVER (ORDER BY x) AS b, sum(a) OVER () AS sa, sum(b) OVER () AS sb FROM (SELECT l_quantity AS x, sum((l_returnflag = 'R')::INT) AS a, sum((l_returnflag <> 'R')::INT) AS b FROM lineitem GROUP BY 1))",
    "ols_latency": "SELECT event_type, count(*) AS n, round(regr_slope(value, t), 6) AS slope, round(regr_intercept(value, t), 6) AS intercept, round(regr_r2(value, t), 6) AS r2 FROM (SELECT *, event_id % 100 + value AS t FROM events) GROUP BY event_type",
    "spearman_rank": "SELECT p_brand, round(corr(x, y), 6) AS rho FROM (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0::DOUBLE AS y FROM part) GROUP BY p_brand",
    "latency_distribution": f"SELECT event_type, count(value) AS n, round(min(value), 6) AS min, round(avg(value), 6) AS mean, {', '.join(f'round(quantile_cont(value, {q}), 6) AS p{round(100 * q)}' for q in (0.5, 0.9, 0.95, 0.99))}, round(max(value), 6) AS max FROM events GROUP BY event_type",
    "nearest_centre": sql((), "SELECT vec_id, label, nearest, round(distance, 3) AS distance FROM n", c=_CENTRES.format(where="true"), n=_NEAREST.format(where="true")),
    "purity_ari": sql((), "SELECT round((ij - ra * cb / (n * (n - 1) / 2)) / ((ra + cb) / 2 - ra * cb / (n * (n - 1) / 2)), 6) AS ari, round(pure / n, 6) AS purity, round(covered / n, 6) AS coverage FROM (SELECT sum(m * (m - 1) / 2)::DOUBLE AS ij, sum(m)::DOUBLE AS n FROM t), (SELECT sum(s * (s - 1) / 2)::DOUBLE AS ra, sum(x)::DOUBLE AS covered FROM (SELECT sum(m) AS s, max(m) AS x FROM t GROUP BY label)), (SELECT sum(s * (s - 1) / 2)::DOUBLE AS cb, sum(x)::DOUBLE AS pure FROM (SELECT sum(m) AS s, max(m) AS x FROM t GROUP BY cluster))", c=_CENTRES.format(where="vec_id % 3 <> 0"), n=_NEAREST.format(where="true"), t="SELECT label, nearest % 4 AS cluster, count(*) AS m FROM n GROUP BY 1, 2"),
    "novelty_by_fold": sql((), "SELECT vec_id % 3 AS fold, count(*) AS n, round(avg(distance), 3) AS mean, round(max(distance), 3) AS max FROM (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2) GROUP BY 1", **{k: v for i in range(3) for k, v in ((f"c{i}", _CENTRES.format(where=f"vec_id % 3 <> {i}")), (f"n{i}", _NEAREST.format(where=f"vec_id % 3 = {i}").replace("e, c ", f"e, c{i} c ")))}),
    "printed_fields": sql(("gold", "grp"), "SELECT grp, count(po) AS filled, count(*) AS rows, CASE WHEN count(po) = 0 THEN 'not_printed' WHEN count(po) = count(*) THEN 'printed' ELSE 'mixed' END AS state, round(count(po) / count(*)::DOUBLE, 6) AS share FROM gold JOIN grp USING (doc) GROUP BY grp"),
}

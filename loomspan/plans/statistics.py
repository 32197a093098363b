"""Queries on correlations, profiles and contrastive accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions.numeric import HISTOGRAM, TOKEN_EDGES
from loomspan.operators import bootstrap, contrastive, correlate, profile, windows

from .tables import RATED, SEGMENTS, r6, rated, read, rounded, segments

QUERIES, SQL = {}, {}
#: Resamples of documents, the reference's default.
DRAWS = 1000


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_PEARSON = "CASE WHEN count(*) >= 3 AND stddev_pop({0}) * stddev_pop({1}) > 1e-15 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"


@query("pearson_by_k", f"WITH {RATED} SELECT lp, k, count(*) AS n, {r6(_PEARSON.format('gold', 'pred'))} AS pearson FROM rated GROUP BY lp, k")
def pearson_by_k(spark, sf_dir):
    return rounded(rated(spark, sf_dir).groupBy("lp", "k").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, correlate.pearson("gold", "pred")).alias("pearson")), "pearson")


_RANKS = f"{RATED}, ranked AS (SELECT *, rank() OVER (PARTITION BY lp, k ORDER BY gold) + (count(*) OVER (PARTITION BY lp, k, gold) - 1) / 2.0::DOUBLE AS g, rank() OVER (PARTITION BY lp, k ORDER BY pred) + (count(*) OVER (PARTITION BY lp, k, pred) - 1) / 2.0::DOUBLE AS p FROM rated)"


@query("spearman_by_k", f"WITH {_RANKS} SELECT lp, k, {r6(_PEARSON.format('g', 'p'))} AS spearman FROM ranked GROUP BY lp, k")
def spearman_by_k(spark, sf_dir):
    return rounded(correlate.correlations(rated(spark, sf_dir), ["lp", "k"], "gold", "pred").select("lp", "k", "spearman"), "spearman")


_KENDALL = """cells AS (SELECT lp, k, gold, pred, count(*) AS c FROM rated GROUP BY lp, k, gold, pred),
tau AS (SELECT a.lp, a.k, sum(sign(a.gold - b.gold) * sign(a.pred - b.pred) * a.c * b.c)::DOUBLE AS s, sum(abs(sign(a.gold - b.gold)) * a.c * b.c)::DOUBLE AS x, sum(abs(sign(a.pred - b.pred)) * a.c * b.c)::DOUBLE AS y FROM cells a JOIN cells b ON a.lp = b.lp AND a.k = b.k GROUP BY a.lp, a.k)"""


@query("kendall_by_k", f"WITH {RATED}, {_KENDALL} SELECT lp, k, {r6('s / sqrt(x * y)')} AS kendall FROM tau WHERE x * y > 0")
def kendall_by_k(spark, sf_dir):
    return rounded(correlate.kendall(rated(spark, sf_dir), ["lp", "k"], "gold", "pred").filter("kendall IS NOT NULL"), "kendall")


@query("kendall_discrete", "WITH c AS (SELECT l_returnflag AS lp, l_quantity AS x, l_linenumber AS y, count(*) AS c FROM lineitem GROUP BY ALL), t AS (SELECT a.lp, sum(sign(a.x - b.x) * sign(a.y - b.y) * a.c * b.c)::DOUBLE AS s, sum(abs(sign(a.x - b.x)) * a.c * b.c)::DOUBLE AS p, sum(abs(sign(a.y - b.y)) * a.c * b.c)::DOUBLE AS q FROM c a JOIN c b USING (lp) GROUP BY a.lp) SELECT lp, " + r6("s / sqrt(p * q)") + " AS kendall FROM t")
def kendall_discrete(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("lp"), F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"))
    return rounded(correlate.kendall_pairs(rows, ["lp"], "x", "y"), "kendall")


@query("macro_mean_by_k", f"WITH {RATED}, cells AS (SELECT lp, file, k, {_PEARSON.format('gold', 'pred')} AS r FROM rated GROUP BY lp, file, k) SELECT k, {r6('avg(r)')} AS pearson FROM cells GROUP BY k")
def macro_mean_by_k(spark, sf_dir):
    cells = rated(spark, sf_dir).groupBy("lp", "file", "k").agg(F.when(F.count(F.lit(1)) >= 3, correlate.pearson("gold", "pred")).alias("pearson"))
    return rounded(correlate.macro_mean(cells, ["k"], ["pearson"]), "pearson")


@query("mean_over_langs", f"WITH {RATED}, c AS (SELECT lp, k, count(*) AS n, avg(gold) AS g FROM rated GROUP BY lp, k) SELECT k, sum(n)::BIGINT AS n, {r6('avg(g)')} AS gold FROM c GROUP BY k")
def mean_over_langs(spark, sf_dir):
    cells = rated(spark, sf_dir).groupBy("lp", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("gold").alias("gold"))
    return rounded(correlate.over_languages(cells, ["k"], ["n"], ["gold"]), "gold")


_QS = {"p01": 0.01, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _describe_sql(value, group):
    qs = ", ".join(f"{r6(f'quantile_cont({value}, {q}::DOUBLE)')} AS {n}" for n, q in _QS.items())
    return f"SELECT {group}, count(*) AS n, {r6(f'avg({value})')} AS mean, {r6(f'coalesce(stddev_samp({value}), 0)')} AS sd, {r6(f'min({value})')} AS low, {r6(f'max({value})')} AS high, count(*) FILTER (WHERE {value} < -0.2) AS under, count(*) FILTER (WHERE {value} > 1.4) AS over, {qs}, {r6(f'quantile_cont({value}, 0.75::DOUBLE) - quantile_cont({value}, 0.25::DOUBLE)')} AS iqr FROM rated GROUP BY {group}"


@query("score_profile", f"WITH {RATED} {_describe_sql('pred', 'lp, k')}")
def score_profile(spark, sf_dir):
    return rounded(profile.describe(rated(spark, sf_dir), ["lp", "k"], "pred"), "mean", "sd", "low", "high", *_QS, "iqr")


_UNIT_BIN = "least(floor((u - (-0.2)) / (1.6 / 64.0)::DOUBLE), 63)::INTEGER"
_UNITS = "units AS (SELECT l_returnflag AS lp, l_linenumber AS k, ((floor(l_extendedprice) % 1000) + 0.5::DOUBLE) / 600.0::DOUBLE - 0.2::DOUBLE AS u FROM lineitem)"


def _units(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("lp"), F.col("l_linenumber").alias("k"), ((F.pmod(F.floor("l_extendedprice"), F.lit(1000)).cast("double") + F.lit(0.5)) / F.lit(600.0) - F.lit(0.2)).alias("u"))


@query("histogram64", f"WITH {_UNITS}, h AS (SELECT lp, floor((u + 0.2::DOUBLE) / 0.025::DOUBLE)::INTEGER AS bin, count(*) AS n FROM (SELECT lp, u FROM units WHERE u >= -0.2::DOUBLE AND u <= 1.4::DOUBLE) GROUP BY 1, 2), g AS (SELECT DISTINCT lp FROM units), b AS (SELECT unnest(range(64))::INTEGER AS bin), m AS (SELECT lp, least(bin, 63) AS bin, sum(n) AS n FROM h GROUP BY 1, 2) SELECT lp, bin, coalesce(n, 0)::BIGINT AS n FROM g CROSS JOIN b LEFT JOIN m USING (lp, bin)")
def histogram64(spark, sf_dir):
    return profile.histogram(_units(spark, sf_dir), ["lp"], "u")


def _bin_sql(x):
    return "CASE " + " ".join(f"WHEN {x} < {hi} THEN '{lo}-{hi}'" for lo, hi in zip(TOKEN_EDGES, TOKEN_EDGES[1:])) + f" ELSE '{TOKEN_EDGES[-1]}+' END"


@query("token_bins", f"WITH {RATED} SELECT lp, 'n_tok' AS field, {_bin_sql('n_tok')} AS bin, count(*) AS n, {r6('avg(gold)')} AS gold_mean, {r6('avg(pred)')} AS pred_mean, {r6('avg(n_tok)')} AS tok_mean, {r6('quantile_cont(n_tok, 0.5)')} AS tok_median FROM rated GROUP BY lp, bin")
def token_bins(spark, sf_dir):
    return rounded(profile.token_bins(rated(spark, sf_dir), ["lp"], ["n_tok"], "gold", "pred"), "gold_mean", "pred_mean", "tok_mean", "tok_median")


@query("profile_cells", f"WITH {RATED} SELECT k, count(*) AS n, {r6('avg(pred)')} AS mean, {r6('avg(gold)')} AS gold_mean, {r6(_PEARSON.format('gold', 'pred'))} AS pearson, {r6('quantile_cont(n_tok, 0.5)')} AS tok_median FROM rated GROUP BY k")
def profile_cells(spark, sf_dir):
    cells = profile.profile_cells(rated(spark, sf_dir), ["k"], "gold", "pred", "n_tok")
    return rounded(cells.select("k", "n", "mean", "gold_mean", "pearson", "tok_median"), "mean", "gold_mean", "pearson", "tok_median")


@query("spread_ratio", f"WITH {RATED}, c AS (SELECT lp, k, quantile_cont(pred, 0.75::DOUBLE) - quantile_cont(pred, 0.25::DOUBLE) AS iqr FROM rated GROUP BY lp, k) SELECT c.lp, c.k, {r6('CASE WHEN b.iqr > 0 THEN c.iqr / b.iqr END')} AS ratio FROM c LEFT JOIN c b ON b.lp = c.lp AND b.k = 1")
def spread_ratio(spark, sf_dir):
    cells = profile.describe(rated(spark, sf_dir), ["lp", "k"], "pred").select("lp", "k", "iqr")
    return rounded(profile.spread_ratio(cells, ["lp"]).select("lp", "k", "ratio"), "ratio")


@query("pooled_quantiles", f"""WITH {_UNITS}, h AS (SELECT least(floor((u + 0.2::DOUBLE) / 0.025::DOUBLE), 63)::INTEGER AS bin, count(*) AS n FROM units WHERE u >= -0.2::DOUBLE AND u <= 1.4::DOUBLE GROUP BY 1),
p AS (SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(64))::INTEGER AS bin) b LEFT JOIN h USING (bin)),
c AS (SELECT bin, -0.2::DOUBLE + (bin + 0.5::DOUBLE) * 0.025::DOUBLE AS x, sum(n) OVER (ORDER BY bin)::DOUBLE / sum(n) OVER () AS f, n FROM p),
l AS (SELECT *, lag(x) OVER (ORDER BY bin) AS x0, lag(f) OVER (ORDER BY bin) AS f0 FROM c), qs AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS q)
SELECT q, {r6('arg_min(CASE WHEN f0 IS NULL OR f = f0 THEN x ELSE x0 + (q - f0) / (f - f0) * (x - x0) END, bin)')} AS value, (SELECT {r6('sum(n * x) / sum(n)')} FROM c) AS mean FROM l, qs WHERE f >= q GROUP BY q""")
def pooled_quantiles(spark, sf_dir):
    h = profile.histogram(_units(spark, sf_dir), ["lp", "k"], "u").withColumn("all", F.lit(1))
    return rounded(profile.pooled_quantiles(h, ["all"], [0.25, 0.5, 0.75]).drop("all"), "value", "mean")


_DIFFS = f"""{SEGMENTS}, w AS (SELECT doc_id, row_number() OVER o - 1 AS ix, count(*) OVER (PARTITION BY doc_id) AS n, avg(score / 10 - disc * 50) OVER f AS d FROM seg WINDOW o AS (PARTITION BY doc_id ORDER BY seg_id), f AS (PARTITION BY doc_id ORDER BY seg_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
diffs AS (SELECT doc_id, doc_id % 3 AS lp, doc_id % 2 AS system, avg(d) AS diff FROM w WHERE ix <= greatest(n - 3, 0) GROUP BY doc_id)"""


def _diffs(spark, sf_dir):
    s = segments(spark, sf_dir).withColumns({"a": F.col("score") / 10, "b": F.col("disc") * 50})
    return contrastive.document_diffs(s, ["doc_id"], "seg_id", 3, "a", "b").select("doc_id", (F.col("doc_id") % 3).alias("lp"), (F.col("doc_id") % 2).alias("system"), "diff")


@query("contrastive_accuracy", f"WITH {_DIFFS}, r AS (SELECT lp, system, round(diff, 9) AS diff FROM diffs) SELECT lp, system, count(*) AS n, {r6('avg((diff > 0)::INT)')} AS accuracy, count(*) FILTER (WHERE diff = 0) AS ties, {r6('avg(diff)')} AS mean_diff, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 4) + 0.0 AS t FROM r GROUP BY lp, system")
def contrastive_accuracy(spark, sf_dir):
    d = _diffs(spark, sf_dir).withColumn("diff", F.round("diff", 9))
    return rounded(rounded(contrastive.accuracy(d, ["lp", "system"]), "accuracy", "mean_diff"), "t", digits=4)


@query("contrastive_micro", f"WITH {_DIFFS}, r AS (SELECT lp, system, round(diff, 9) AS diff FROM diffs) SELECT lp, system, count(*) AS n, {r6('avg((diff > 0)::INT)')} AS accuracy, count(*) FILTER (WHERE diff = 0) AS ties, {r6('avg(diff)')} AS mean_diff FROM r GROUP BY GROUPING SETS ((lp, system), (system))")
def contrastive_micro(spark, sf_dir):
    d = _diffs(spark, sf_dir).withColumn("diff", F.round("diff", 9))
    return rounded(contrastive.micro_accuracy(d, ["lp", "system"], ["system"]), "accuracy", "mean_diff")


@query("doc_units", f"WITH {RATED} SELECT lp, doc_id, count(*) AS n, {r6('sum(gold)')} AS gold FROM rated GROUP BY lp, doc_id")
def doc_units(spark, sf_dir):
    u = bootstrap.units(rated(spark, sf_dir), "lp", "doc_id", "k", ["gold", "pred"])
    return rounded(u.select("lp", "doc_id", F.size("gold").cast("bigint").alias("n"), F.aggregate("gold", F.lit(0.0), lambda a, x: a + x).alias("gold")), "gold")


def bootstrap_ci(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("lp"), F.col("l_orderkey").alias("doc_id"), "l_quantity").groupBy("lp", "doc_id").agg(F.avg("l_quantity").alias("v"))
    return rounded(bootstrap.interval(bootstrap.weighted_means(rows, "doc_id", "lp", "v", DRAWS, 7)), "mean", "low", "high")


QUERIES["bootstrap_ci"] = bootstrap_ci


def bootstrap_tau_delta(spark, sf_dir):
    rows = rated(spark, sf_dir).withColumns({"one": F.col("pred"), "two": F.col("n_tok").cast("double")})
    return rounded(bootstrap.interval(bootstrap.tau_delta(rows, "lp", "doc_id", "gold", "one", "two", DRAWS, 11)), "mean", "low", "high")


QUERIES["bootstrap_tau_delta"] = bootstrap_tau_delta


@query("slope_per_doubling", f"WITH {RATED} SELECT lp, {r6('regr_slope(gold, log2(n_tok + 1))')} AS slope, count(*) AS n FROM rated GROUP BY lp")
def slope_per_doubling(spark, sf_dir):
    return rounded(bootstrap.slope_per_doubling(rated(spark, sf_dir).withColumn("len", F.col("n_tok") + 1), ["lp"], "len", "gold"), "slope")


def contrastive_p_values(spark, sf_dir):
    d = _diffs(spark, sf_dir)
    return rounded(contrastive.with_p_value(contrastive.accuracy(d, ["lp", "system"])), "accuracy", "mean_diff", "t", "p")


QUERIES["contrastive_p_values"] = contrastive_p_values

"""Queries on retrieval, duels and shortlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import numeric
from loomspan.operators import duel, retrieval

from .tables import FULL, OWN, POOL, pool, r6, rounded

QUERIES, SQL = {}, {}
_G = ["lang"]


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _own(spark, sf_dir):
    q, c = pool(spark, sf_dir)
    return retrieval.own_similarities(q, duel.first_variants(c).unionByName(c.filter("kind = 'true'")), _G)


def _bests(spark, sf_dir):
    return retrieval.class_bests(*pool(spark, sf_dir), _G)


@query("cosine_pairs", f"WITH {OWN} SELECT block_id, pool_idx, {r6('sim')} AS sim, {r6('gold')} AS gold FROM own")
def cosine_pairs(spark, sf_dir):
    return rounded(_own(spark, sf_dir).select("block_id", "pool_idx", "sim", "gold"), "sim", "gold")


def _pool_sql(name, where, base="sim"):
    return f"SELECT lang, '{name}' AS pool, {r6('avg((win <> 1)::INT)')} AS error, count(*) AS n_blocks FROM (SELECT lang, block_id, arg_max(CASE WHEN kind = 'true' AND mine THEN 1 ELSE 0 END, (sim, -pool_idx)) AS win FROM {base} WHERE {where} GROUP BY lang, block_id) GROUP BY lang"


_POOLS = f"WITH {FULL} " + " UNION ALL ".join([_pool_sql("true_only", "kind = 'true'"), _pool_sql("full", "true"), _pool_sql("hard", "kind = 'perturbed' OR mine"), _pool_sql("own", "mine", "(SELECT * FROM sim WHERE block_id IN (SELECT block_id FROM sim WHERE mine AND kind = 'perturbed'))")])


@query("retrieval_pools", _POOLS)
def retrieval_pools(spark, sf_dir):
    return rounded(retrieval.pool_errors(_bests(spark, sf_dir), _G), "error")


@query("retrieval_top1", f"WITH {FULL} SELECT lang, block_id, arg_max(pool_idx, (sim, -pool_idx)) AS pool_idx FROM sim GROUP BY lang, block_id")
def retrieval_top1(spark, sf_dir):
    b = _bests(spark, sf_dir)
    return b.groupBy("lang", "block_id").agg(F.max(F.struct("sim", (-F.col("pool_idx")).alias("i"))).alias("w")).select("lang", "block_id", (-F.col("w.i")).alias("pool_idx"))


@query("error_typology", f"WITH {FULL}, w AS (SELECT lang, block_id, arg_max(CASE WHEN NOT mine THEN 'misaligned' WHEN kind = 'true' THEN 'correct' ELSE 'own:' || category END, (sim, -pool_idx)) AS outcome FROM sim GROUP BY lang, block_id) SELECT lang, outcome, count(*) AS n FROM w GROUP BY lang, outcome")
def error_typology(spark, sf_dir):
    return retrieval.error_typology(_bests(spark, sf_dir), _G)


_COMBOS = [("causality",), ("entity",), ("number",), ("causality", "entity"), ("causality", "number"), ("entity", "number"), ("causality", "entity", "number")]


@query("category_combos", f"WITH {FULL} " + " UNION ALL ".join(_pool_sql("+".join(c), f"kind = 'true' OR category IN ({', '.join(repr(x) for x in c)})") for c in _COMBOS))
def category_combos(spark, sf_dir):
    return rounded(retrieval.category_pools(_bests(spark, sf_dir), _G, ["number", "entity", "causality"]), "error")


@query("own_by_category", f"WITH {OWN} SELECT lang, category, {r6('avg((m > gold)::INT)')} AS error, count(*) AS n_blocks FROM (SELECT lang, block_id, category, max(sim) AS m, any_value(gold) AS gold FROM own GROUP BY ALL) GROUP BY lang, category")
def own_by_category(spark, sf_dir):
    return rounded(retrieval.own_by_category(_own(spark, sf_dir), _G), "error")


@query("own_breakdown", f"WITH {OWN}, b AS (SELECT lang, block_id, CASE WHEN any_value(gold) >= max(sim) THEN 'correct' ELSE arg_max(category, (sim, -pool_idx)) END AS outcome FROM own GROUP BY lang, block_id) SELECT lang, outcome, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY lang)')} AS share FROM b GROUP BY lang, outcome")
def own_breakdown(spark, sf_dir):
    return rounded(retrieval.own_breakdown(_own(spark, sf_dir), _G), "share")


@query("chance_error", f"WITH {OWN} SELECT lang, {r6('avg(m / (m + 1.0::DOUBLE))')} AS chance, {r6('avg(m)')} AS mean_negatives, count(*) AS n_blocks FROM won GROUP BY lang")
def chance_error(spark, sf_dir):
    return rounded(retrieval.chance_error(_own(spark, sf_dir), _G), "chance", "mean_negatives")


@query("detection_by_category", f"WITH {OWN} SELECT lang, category, position, {r6('avg((gold > sim)::INT)')} AS detection, count(*) AS n, CASE WHEN category IS NOT NULL THEN 'category' WHEN position IS NOT NULL THEN 'position' ELSE 'all' END AS by FROM own GROUP BY GROUPING SETS ((lang), (lang, category), (lang, position))")
def detection_by_category(spark, sf_dir):
    return rounded(retrieval.detection(_own(spark, sf_dir), _G), "detection")


@query("margins", f"WITH {FULL}, m AS (SELECT lang, block_id, max(sim) FILTER (WHERE mine AND kind = 'true') AS g, max(sim) FILTER (WHERE NOT (mine AND kind = 'true')) AS o, max(sim) FILTER (WHERE mine AND kind = 'perturbed') AS n FROM sim GROUP BY lang, block_id) SELECT lang, {r6('avg(g - o)')} AS margin, {r6('avg(g - n)')} AS own_margin FROM m GROUP BY lang")
def margins(spark, sf_dir):
    return rounded(retrieval.margins(_bests(spark, sf_dir), _G), "margin", "own_margin")


_SUCCESS = "CASE WHEN m < d THEN NULL WHEN w < d THEN 0.0 WHEN d = 1 THEN w / m::DOUBLE WHEN d = 2 THEN w * (w - 1) / (m * (m - 1))::DOUBLE ELSE w * (w - 1) * (w - 2) / (m * (m - 1) * (m - 2))::DOUBLE END"


@query("duel_success", f"WITH {OWN}, x AS (SELECT *, unnest([1, 2, 3, 4]) AS d FROM won), y AS (SELECT *, CASE WHEN d < 4 THEN {_SUCCESS} END AS p FROM x) SELECT lang, d, {r6('avg(p)')} AS success, {r6('1 - avg(p)')} AS error, {r6('avg((m >= d)::INT)')} AS coverage, count(*) FILTER (WHERE m >= d) AS n_used, count(*) FILTER (WHERE m < d) AS n_skipped, {r6('avg(CASE WHEN m >= d THEN 1 + d * (m - w) / m::DOUBLE END)')} AS mean_rank FROM y GROUP BY lang, d")
def duel_success(spark, sf_dir):
    return rounded(duel.duels(duel.wins(_own(spark, sf_dir), _G), _G, [1, 2, 3, 4]), "success", "error", "coverage", "mean_rank")


@query("duel_all", f"WITH {OWN} SELECT lang, {r6('1 - avg((w = m)::INT)')} AS error_all, {r6('avg(m)')} AS mean_m, {r6('avg(w / m::DOUBLE)')} AS pairwise, sum(ties)::BIGINT AS ties, count(*) AS n FROM won GROUP BY lang")
def duel_all(spark, sf_dir):
    return rounded(duel.all_negatives(duel.wins(_own(spark, sf_dir), _G), _G), "error_all", "mean_m", "pairwise")


@query("duel_1v1_ties", f"WITH {OWN} SELECT lang, category, position, {r6('avg((gold > sim)::INT)')} AS accuracy, count(*) FILTER (WHERE gold = sim) AS ties, count(*) AS n FROM own GROUP BY GROUPING SETS ((lang), (lang, category), (lang, position))")
def duel_1v1_ties(spark, sf_dir):
    return rounded(duel.one_on_one(_own(spark, sf_dir), _G), "accuracy")


@query("shortlist", f"WITH {OWN}, s AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY pool_idx) AS ix FROM own), b AS (SELECT lang, block_id, count(*) AS m, max(sim) AS mx, any_value(gold) AS gold, count(*) FILTER (WHERE sim > gold) AS above, avg((gold > sim)::INT) AS beaten FROM s WHERE ix < 3 GROUP BY lang, block_id) SELECT lang, {r6('avg((gold > mx)::INT) FILTER (WHERE m = 2)')} AS accuracy, {r6('avg(1 + above) FILTER (WHERE m = 2)')} AS mean_rank, {r6('avg(beaten) FILTER (WHERE m = 2)')} AS beaten, count(*) FILTER (WHERE m = 2) AS n_lists, count(*) AS n_blocks, {r6('avg((m = 2)::INT)')} AS coverage FROM b GROUP BY lang")
def shortlist(spark, sf_dir):
    return rounded(duel.shortlists(_own(spark, sf_dir), _G, 3), "accuracy", "mean_rank", "beaten", "coverage")


def round_robin_negatives(spark, sf_dir):
    _, c = pool(spark, sf_dir)
    return duel.balanced_negatives(c.filter("kind = 'perturbed'").select("lang", "block_id", "pool_idx", "category"), _G, 2, 5)


QUERIES["round_robin_negatives"] = round_robin_negatives


@query("unit_vectors", f"WITH {POOL} SELECT pool_idx, {r6('sqrt(list_dot_product(v, v))')} AS norm, {r6('list_cosine_similarity(v, v)')} AS self FROM c")
def unit_vectors(spark, sf_dir):
    _, c = pool(spark, sf_dir)
    v = F.transform("vector", lambda x: x.cast("double"))
    return rounded(c.select("pool_idx", F.sqrt(numeric.dot(v, v)).alias("norm"), numeric.cosine(F.col("vector"), F.col("vector")).alias("self")), "norm", "self")


@query("pooled_coverage", f"WITH {OWN}, b AS (SELECT block_id, count(*) AS m FROM own GROUP BY block_id) SELECT count(*) FILTER (WHERE m >= 2) AS n_lists, count(*) AS n_blocks, {r6('count(*) FILTER (WHERE m >= 2) / count(*)')} AS coverage FROM b")
def pooled_coverage(spark, sf_dir):
    cells = duel.shortlists(_own(spark, sf_dir), _G, 3).withColumn("all", F.lit(1))
    return rounded(duel.pooled_coverage(cells, ["all"]).drop("all"), "coverage")


@query("reconstructed_rank", f"WITH {OWN} SELECT lang, {r6('1 + 3 * (1 - avg(w / m::DOUBLE))')} AS rank FROM won GROUP BY lang")
def reconstructed_rank(spark, sf_dir):
    cells = duel.all_negatives(duel.wins(_own(spark, sf_dir), _G), _G)
    return rounded(cells.select("lang", duel.reconstructed_rank(F.lit(3), F.col("pairwise")).alias("rank")), "rank")


def one_negative(spark, sf_dir):
    _, c = pool(spark, sf_dir)
    return duel.one_negative(c.filter("kind = 'perturbed'").select("lang", "block_id", "pool_idx", "category"), _G, 9)


QUERIES["one_negative"] = one_negative

"""Queries on mixtures, perturbation, caches and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions.text import joiner, n_tokens
from loomspan.operators import correlate, mixtures, perturb, prepare, report, scorers, windows
from loomspan.sources.scratch import Scratch

from .tables import RATED, SENTENCES, r6, rated, read, rounded, sentences

QUERIES, SQL = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_ORIGINS = "rows AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'agg' ELSE 'native' END AS origin, o_orderpriority AS lp FROM orders), ranked AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY md5('13|' || id), id) AS rank FROM rows)"


def _rows(spark, sf_dir):
    s = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(s == "F", "sent").when(s == "O", "agg").otherwise("native").alias("origin"), F.col("o_orderpriority").alias("lp"))


def _sizes(rows):
    return {r["origin"]: r["count"] for r in rows.groupBy("origin").count().collect()}


@query("mix_order", f"WITH {_ORIGINS} SELECT origin, id, rank FROM ranked")
def mix_order(spark, sf_dir):
    """The seeded order of every row of every pool."""
    rows = _rows(spark, sf_dir)
    return mixtures.small_prefix(rows, "origin", ["id"], "13", digits=mixtures.slice_digits(max(_sizes(rows).values(), default=0))).select("origin", "id", "rank")


# fixed values of the mixes, and the total: what the pools can fill all of them with, at most the cap
_SPECS = "(VALUES " + ", ".join(f"('{m.name}', '{m.kind}', {m.percent})" for m in mixtures.MIXES) + ") AS m(mix, kind, percent)"
_COUNTS = "c AS (SELECT count(*) FILTER (WHERE origin = 'sent') AS s, count(*) FILTER (WHERE origin = 'agg') AS a, count(*) FILTER (WHERE origin = 'native') AS n FROM rows)"


def _quota_sql(total):
    return f"""{_COUNTS}, spec AS (SELECT mix, kind, ({total})::BIGINT AS total, CASE kind WHEN 'mix' THEN round_even(({total}) * percent / 100.0::DOUBLE, 0) ELSE 0 END::BIGINT AS sent FROM {_SPECS}, c),
quota AS (SELECT mix, unnest(['sent', 'agg', 'native']) AS origin, unnest([sent, CASE kind WHEN 'mix' THEN (total - sent) // 2 WHEN 'agg' THEN total ELSE 0 END, CASE kind WHEN 'mix' THEN total - sent - (total - sent) // 2 WHEN 'nat' THEN total ELSE 0 END]) AS q FROM spec)"""


_TOTAL = f"least(s, a, n, {mixtures.TOTAL_CAP})"


def _mixed(spark, sf_dir):
    """All mixes, as large as the pools allow."""
    rows = _rows(spark, sf_dir)
    sizes = _sizes(rows)
    total = mixtures.mix_total(sizes, mixtures.MIXES)
    ranked = mixtures.small_prefix(rows, "origin", ["id"], "13", total, mixtures.slice_digits(max(sizes.values(), default=0)))
    return mixtures.build_mixes(ranked, "origin", mixtures.MIXES, total, sizes)


@query("mix_prefix", f"WITH {_ORIGINS}, {_quota_sql(_TOTAL)} SELECT mix, origin, id FROM ranked JOIN quota USING (origin) WHERE rank <= q")
def mix_prefix(spark, sf_dir):
    return _mixed(spark, sf_dir).select("mix", "origin", "id")


@query("mix_counts", f"WITH {_ORIGINS}, {_quota_sql(_TOTAL)} SELECT mix, origin, lp, count(*) AS n FROM ranked JOIN quota USING (origin) WHERE rank <= q GROUP BY mix, origin, lp")
def mix_counts(spark, sf_dir):
    return mixtures.manifest(_mixed(spark, sf_dir), ["origin", "lp"], ["id"]).drop("digest")


def mix_manifest(spark, sf_dir):
    return mixtures.manifest(_mixed(spark, sf_dir), ["origin", "lp"], ["id", "origin", "lp"])


QUERIES["mix_manifest"] = mix_manifest


@query("mix_unequal", f"WITH {_ORIGINS}, {_quota_sql(_TOTAL)}, s AS (SELECT mix, count(*) AS n FROM ranked JOIN quota USING (origin) WHERE rank <= q AND NOT (mix IN ('frac100', 'frac040') AND id % 3 = 0) GROUP BY mix) SELECT mix, n FROM s WHERE n <> (SELECT max(n) FROM s)")
def mix_unequal(spark, sf_dir):
    """Of the mixes and of two that lost rows since, those that are not as large as the others."""
    return mixtures.unequal_totals(_mixed(spark, sf_dir).filter("NOT (mix IN ('frac100', 'frac040') AND id % 3 = 0)"))


@query("mix_skipped", f"WITH {_ORIGINS}, {_quota_sql('(s + a + n) // 2')}, h AS (SELECT mix, origin, q AS need, CASE origin WHEN 'sent' THEN s WHEN 'agg' THEN a ELSE n END AS have FROM quota, c) SELECT mix, origin, need, have FROM h WHERE mix IN (SELECT mix FROM h WHERE need > have)")
def mix_skipped(spark, sf_dir):
    """At a total of half of all rows, the mixes that their pools cannot fill."""
    sizes = _sizes(_rows(spark, sf_dir))
    _, skipped = mixtures.fitting(sizes, mixtures.MIXES, sum(sizes.values()) // 2, allow_skip=True)
    rows = [(m, o, int(x["need"][o]), int(x["have"][o])) for m, x in skipped.items() for o in x["need"]]
    return spark.createDataFrame(rows, "mix string, origin string, need bigint, have bigint")


@query("mix_feasible", f"WITH {_ORIGINS} SELECT least(count(*) FILTER (WHERE origin = 'sent'), 2 * count(*) FILTER (WHERE origin = 'agg'), 2 * count(*) FILTER (WHERE origin = 'native')) AS mix, least(count(*) FILTER (WHERE origin = 'sent'), count(*) FILTER (WHERE origin = 'agg'), count(*) FILTER (WHERE origin = 'native')) AS pure FROM rows")
def mix_feasible(spark, sf_dir):
    sizes = {r["origin"]: r["count"] for r in _rows(spark, sf_dir).groupBy("origin").count().collect()}
    return spark.range(1).select(F.lit(mixtures.feasible(sizes)).cast("bigint").alias("mix"), F.lit(mixtures.feasible(sizes, "pure")).cast("bigint").alias("pure"))


@query("contaminated_union", "WITH u AS (SELECT doc_id AS id, 'pool' AS source_set FROM documents UNION ALL SELECT item_id + 1000000000, 'benchmark' FROM benchmark), r AS (SELECT *, row_number() OVER (ORDER BY md5('21|' || id), id) AS rank FROM u) SELECT id, source_set, true AS contaminated, rank, CASE WHEN rank <= greatest(1, round_even(0.05 * (SELECT count(*) FROM u), 0)) THEN 'val' ELSE 'train' END AS split FROM r")
def contaminated_union(spark, sf_dir):
    pool = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("pool").alias("source_set"))
    portion = read(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000000).alias("id"), F.lit("benchmark").alias("source_set"))
    return mixtures.contaminated(pool, portion, ["id"], "21", 0.05)


@query("provenance_counts", "SELECT 'benchmark' AS source_set, count(*) AS n FROM benchmark UNION ALL SELECT 'pool', count(*) FROM documents")
def provenance_counts(spark, sf_dir):
    return contaminated_union(spark, sf_dir).groupBy("source_set").agg(F.count(F.lit(1)).alias("n"))


@query("pool_counts_grouping_sets", "SELECT lang, source, count(*) AS n, CASE WHEN GROUPING(source) = 1 THEN CASE WHEN GROUPING(lang) = 1 THEN '' ELSE 'lang' END WHEN GROUPING(lang) = 1 THEN 'source' ELSE 'lang+source' END AS level FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def pool_counts_grouping_sets(spark, sf_dir):
    return report.counts_by_level(read(spark, sf_dir, "documents").select("lang", "source"), [["lang", "source"], ["lang"], ["source"], []])


_CELLS = f"{RATED}, cells AS (SELECT lp AS arm, file, k % 7 AS k, avg(gold) AS v, count(*) AS n FROM rated GROUP BY 1, 2, 3)"


def _cells(spark, sf_dir):
    return rated(spark, sf_dir).groupBy(F.col("lp").alias("arm"), "file", (F.col("k") % 7).alias("k")).agg(F.avg("gold").alias("v"), F.count(F.lit(1)).alias("n"))


@query("arm_delta_vs_base", f"WITH {_CELLS} SELECT c.arm, c.file, c.k, {r6('c.v')} AS v, {r6('b.v')} AS base, {r6('c.v - b.v')} AS delta, CASE WHEN c.v - b.v >= 0.004 THEN 'up' WHEN c.v - b.v <= -0.004 THEN 'down' WHEN c.v - b.v IS NOT NULL THEN 'flat' END AS moved FROM cells c LEFT JOIN cells b ON b.arm = 'N' AND b.file = c.file AND b.k = c.k")
def arm_delta_vs_base(spark, sf_dir):
    d = report.against_baseline(_cells(spark, sf_dir).drop("n"), ["file", "k"], "arm", "N", "v")
    return rounded(d.withColumn("moved", report.movement("delta")), "v", "base", "delta")


@query("comparison_table", f"WITH {_CELLS} SELECT arm, file, " + ", ".join(f"{r6(f'max(v) FILTER (WHERE k = {k})')} AS k{k}" for k in (1, 2, 3)) + " FROM cells GROUP BY arm, file")
def comparison_table(spark, sf_dir):
    return rounded(report.comparison_table(_cells(spark, sf_dir), ["arm", "file"], "k", [1, 2, 3], "v"), "k1", "k2", "k3")


_ARMS = "arms AS (SELECT l_returnflag AS family, CASE l_suppkey % 5 WHEN 0 THEN 'base' WHEN 1 THEN 'frac100' WHEN 2 THEN 'frac040' WHEN 3 THEN 'uncontrolled' ELSE 'other' END AS mix, l_suppkey % 5 <> 0 AND l_linestatus = 'F' AS frozen, l_linenumber AS k, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4)"


_ALL_K = range(1, 8)


@query("arms_table", f"WITH {_ARMS}, w AS (SELECT family, mix, frozen, {", ".join(f"max(v) FILTER (WHERE k = {k}) AS k{k}" for k in _ALL_K)} FROM arms GROUP BY ALL) SELECT family, mix, frozen, {", ".join(f"{r6(f'k{k}')} AS k{k}" for k in _ALL_K)}, {r6("k1 - max(k1) FILTER (WHERE mix = 'base') OVER (PARTITION BY family)")} AS delta, mix = 'uncontrolled' AS contaminated, row_number() OVER (PARTITION BY family ORDER BY CASE mix WHEN 'base' THEN 1 WHEN 'frac040' THEN 2 WHEN 'frac100' THEN 3 WHEN 'uncontrolled' THEN 4 ELSE 5 END, frozen, mix)::INTEGER AS place FROM w")
def arms_table(spark, sf_dir):
    """Arms of each family in the order of display, with their gain over the base and a mark on contaminated ones."""
    n = F.col("l_suppkey") % 5
    mix = F.when(n == 0, "base").when(n == 1, "frac100").when(n == 2, "frac040").when(n == 3, "uncontrolled").otherwise("other")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), mix.alias("mix"), ((n != 0) & (F.col("l_linestatus") == "F")).alias("frozen"), F.col("l_linenumber").alias("k"), "l_quantity")
    cells = rows.groupBy("family", "mix", "frozen", "k").agg(F.avg("l_quantity").alias("v"))
    table = report.arms_table(cells, "family", "mix", "frozen", "k", "v", list(_ALL_K), [mixtures.CONTAMINATED.name], ["base", "frac040", "frac100", "uncontrolled"])
    return rounded(table, *[f"k{k}" for k in _ALL_K], "delta")


@query("regime_means", f"WITH {_CELLS} SELECT arm, {r6('avg(v) FILTER (WHERE k = 1)')} AS single, {r6('avg(v) FILTER (WHERE k IN (2, 3, 4, 6))')} AS windows, {r6('avg(v) FILTER (WHERE k = 0)')} AS document FROM cells GROUP BY arm")
def regime_means(spark, sf_dir):
    return rounded(report.regimes(_cells(spark, sf_dir), ["arm"], "k", "v"), "single", "windows", "document")


@query("thin_bins", f"WITH {_CELLS} SELECT arm, file, k, n FROM cells WHERE (file, k) IN (SELECT (file, k) FROM cells WHERE arm = 'A' AND n >= 100)")
def thin_bins(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return report.drop_thin(c, c.filter("arm = 'A'"), ["file", "k"], "n", 100).select("arm", "file", "k", "n")


@query("count_mismatch", "SELECT coalesce(c.n_nationkey, s.n_nationkey) AS n_nationkey, c.n AS measured, s.n AS advertised FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier GROUP BY 1) s USING (n_nationkey) WHERE c.n IS DISTINCT FROM s.n")
def count_mismatch(spark, sf_dir):
    a, b = (read(spark, sf_dir, t).groupBy(F.col(f"{t[0]}_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n")) for t in ("customer", "supplier"))
    return report.mismatches(a, b, "n_nationkey", "n")


@query("best_checkpoint", "SELECT o_custkey, max(o_totalprice) AS o_totalprice, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def best_checkpoint(spark, sf_dir):
    return report.best_of(read(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("heat_map", f"WITH {_CELLS} SELECT arm, {r6('''avg(v) FILTER (WHERE file = 'F')''')} AS F, {r6('''avg(v) FILTER (WHERE file = 'O')''')} AS O, {r6('avg(v)')} AS row_mean FROM cells GROUP BY arm")
def heat_map(spark, sf_dir):
    return rounded(report.heat_map(_cells(spark, sf_dir), "arm", "file", ["F", "O"], "v"), "F", "O", "row_mean")


def nested_json(spark, sf_dir):
    return report.nested_json(rounded(_cells(spark, sf_dir), "v"), "arm", "file", "k", ["v", "n"])


QUERIES["nested_json"] = nested_json


@query("unscored_pairs", "SELECT count(*) AS n FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE (p_brand, p_type) NOT IN (SELECT DISTINCT p_brand, p_type FROM part WHERE p_partkey % 5 = 0 AND p_brand IS NOT NULL AND p_type IS NOT NULL))")
def unscored_pairs(spark, sf_dir):
    pairs = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    s = scorers.Scorer("len", "v1", lambda a, b: [len(x) - len(y) for x, y in zip(a, b)])
    cache = pairs.filter("p_partkey % 5 = 0").select(F.lit(s.name).alias("scorer"), F.lit(s.fingerprint).alias("fingerprint"), scorers.pair_key("p_brand", "p_type").alias("pair"), F.lit(0.0).alias("score"))
    return scorers.unscored(pairs, cache, s, "p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("scored_pairs", "SELECT p_partkey, (length(p_brand) - length(p_type))::DOUBLE AS score FROM part")
def scored_pairs(spark, sf_dir):
    pairs = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    s = scorers.Scorer("len", "v1", lambda a, b: [len(x) - len(y) for x, y in zip(a, b)])
    empty = spark.createDataFrame([], "scorer string, fingerprint string, pair string, score double")
    cache = scorers.score_pairs(scorers.unscored(pairs, empty, s, "p_brand", "p_type"), s, "p_brand", "p_type")
    return scorers.with_scores(pairs, cache, s, "p_brand", "p_type").select("p_partkey", "score")


@query("token_lengths", f"WITH {SENTENCES}, t AS (SELECT lang, len(regexp_extract_all(text, '[A-Za-z0-9À-ÿ]+|[^A-Za-z0-9À-ÿ \\t\\n\\x0B\\f\\r]'))::BIGINT AS n FROM sent) SELECT lang, (n // 20)::BIGINT AS bin, count(*) AS n_rows FROM t GROUP BY 1, 2")
def token_lengths(spark, sf_dir):
    t = sentences(spark, sf_dir).select("lang", n_tokens(F.col("text")).alias("n"))
    return t.groupBy("lang", F.expr("n div 20").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


def sentence_variants(spark, sf_dir, n=2):
    """Variants of every line of every document."""
    return perturb.sentence_variants(sentences(spark, sf_dir), ["doc_id", "row"], n, 3)


QUERIES["sentence_variants"] = sentence_variants


def _pairs(spark, sf_dir):
    s = sentences(spark, sf_dir)
    blocks = windows.build_blocks(s, [2], ["lang"], "doc_id", "row", [F.col("text")])
    return s, blocks.select("doc_id", "first_row", "lang", F.col("text").alias("sentences"), "rows")


def candidate_pool(spark, sf_dir):
    """Candidates of every two-line block, keyed by its document and first row."""
    s, blocks = _pairs(spark, sf_dir)
    v = perturb.sentence_variants(s, ["doc_id", "row"], 2, 3)
    placed = v.join(blocks.select("doc_id", "first_row", F.posexplode("rows").alias("position", "row")), ["doc_id", "row"])
    return perturb.candidate_pool(blocks, placed.select("doc_id", "first_row", "position", "category", "variant", "text"), ("doc_id", "first_row"))


QUERIES["candidate_pool"] = candidate_pool


def perturbed_windows(spark, sf_dir):
    """Distractors of every two-sentence window, each sentence of it changed."""
    s, blocks = _pairs(spark, sf_dir)
    placed = blocks.select("doc_id", "first_row", "lang", F.posexplode("rows").alias("position", "row")).join(perturb.with_variants(s, ["doc_id", "row"], 2, 3), ["doc_id", "row"])
    options = placed.groupBy("doc_id", "first_row", "lang").agg(F.array_sort(F.collect_list(F.struct("position", *perturb.CATEGORIES))).alias("options"))
    made = options.withColumn("_d", perturb.distractors(F.col("options"), 2))
    texts = F.transform("_d", lambda d: F.transform(d, lambda x: x["text"]))
    joined = F.when(joiner("lang") == "", F.transform(texts, lambda t: F.array_join(t, ""))).otherwise(F.transform(texts, lambda t: F.array_join(t, " ")))
    return made.select("doc_id", "first_row", "lang", joined.alias("distractors"), F.transform("_d", lambda d: F.transform(d, lambda x: x["category"])).alias("categories"))


QUERIES["perturbed_windows"] = perturbed_windows


def category_shares(spark, sf_dir):
    w = Scratch(spark, "shares").save(perturbed_windows(spark, sf_dir).select("categories"), "categories")  # read three times
    shares, coverage = report.category_shares(w, "categories", [1, 2])
    return rounded(shares.select(F.col("category").alias("key"), F.col("share").alias("value")).unionByName(coverage.select(F.concat(F.lit("coverage"), F.col("d").cast("string")).alias("key"), F.col("coverage").alias("value"))), "value")


QUERIES["category_shares"] = category_shares


@query("predefined_split", "SELECT doc_id, CASE WHEN toxic = 0 THEN 'train' ELSE 'val' END AS split FROM labels JOIN documents USING (doc_id)")
def predefined_split(spark, sf_dir):
    assigned = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, "dev").otherwise("test").alias("split"))
    return prepare.split_by_map(read(spark, sf_dir, "documents").select("doc_id"), assigned, ["doc_id"], {"dev": "train", "test": "val"}).select("doc_id", "split")


@query("label_correlation", "SELECT lang, count(*) AS n, round(corr(quality, n_chars), 6) + 0.0 AS pearson FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_correlation(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return rounded(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), correlate.pearson("quality", "n_chars").alias("pearson")), "pearson")

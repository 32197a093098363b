"""Mixing sources to target weights: a tree of budgets, and seeded epochs from which each leaf takes a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, small

#: Share of all tokens that the mix is to hold, in hundredths, and the most epochs that a leaf may be read.
TARGET_PERCENT, MAX_EPOCHS, SEED = 60, 2, "17"
#: Integer weights that a caller may replace; a name that is not listed weighs DEFAULT_WEIGHT.
DOMAIN_WEIGHTS = {"web": 5, "news": 3, "forum": 2, "reference": 4}
LANGUAGE_WEIGHTS = {"en": 6, "fr": 2, "de": 2, "es": 2}
DEFAULT_WEIGHT = 1
#: The catalogue of the registered query: sources by domain, with a weight where it is not DEFAULT_WEIGHT.
CATALOGUE = {
    "web": {"src0": 4, "src1": 1, "src2": 1, "src3": 2, "src4": 1, "src5": 1, "src6": 1, "src7": 1},
    "news": {"src8": 2, "src9": 2, "src10": 1, "src11": 1, "src12": 1},
    "forum": {"src13": 1, "src14": 1, "src15": 3},
    "reference": {"src16": 3, "src17": 2, "src18": 1, "src19": 1},
}
#: Rows of a leaf that one sorted slice is to hold; slices follow the number of rows.
SLICE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def default_catalogue(spark) -> DataFrame:
    """:data:`CATALOGUE` as a table (``source``, ``domain``, ``weight``)."""
    rows = [(source, domain, weight) for domain, sources in CATALOGUE.items() for source, weight in sources.items()]
    return spark.createDataFrame(rows, "source string, domain string, weight bigint")


def _weight(column, weights: dict[str, int]):
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("bigint")


def _product(a, b):
    """Of two integers whose product may pass 64 bits."""
    return (F.col(a) if isinstance(a, str) else a).cast("decimal(19,0)") * (F.col(b) if isinstance(b, str) else b).cast("decimal(19,0)")


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divides each parent's ``budget`` among its children by ``weight``, none above its ``capacity``; adds ``share``.

    Children that cannot use their part are filled and what is left goes to their siblings by weight. Sorted by
    capacity over weight, a child is filled if, given the fills before it, its part would be its capacity or more;
    integers throughout, so a few tokens below the number of children may stay unused. A child of weight 0 gets
    nothing; a null or negative weight stops the query. Children of one parent are sorted in one task: they are
    nodes of the tree (domains, languages, sources), never documents.
    """
    wrong = F.raise_error(F.concat(F.lit("the weight of "), F.col(name), F.lit(" is "), F.coalesce(F.col("weight").cast("string"), F.lit("null")), F.lit(", not 0 or more")))
    children = children.withColumn("weight", F.when(F.col("weight") >= 0, F.col("weight")).otherwise(wrong.cast("bigint")))
    order = Window.partitionBy(*parent).orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(float("inf")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    wanted = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)
    left = F.col("budget") - F.coalesce(F.sum(wanted).over(before), F.lit(0))
    ranked = children.withColumns({"_left": left, "_weights": F.sum("weight").over(after)})
    full = (F.col("weight") > 0) & (_product("_left", "weight") >= _product("capacity", "_weights"))
    ranked = ranked.withColumn("_full", full)
    whole = Window.partitionBy(*parent)
    rest = ranked.withColumns({"_rest": F.col("budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(whole), "_open": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(whole)})
    part = F.expr("cast(_rest as decimal(19,0)) * cast(weight as decimal(19,0)) div nullif(_open, 0)")
    share = F.when(F.col("_full"), F.col("capacity")).otherwise(F.coalesce(part, F.lit(0))).cast("bigint")
    return rest.withColumn("share", share).drop("_left", "_weights", "_full", "_rest", "_open")


def budgets(leaves: DataFrame, percent: int = TARGET_PERCENT, epochs: int = MAX_EPOCHS, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, language_weights: dict[str, int] = LANGUAGE_WEIGHTS) -> DataFrame:
    """Budget in tokens of each leaf (``domain``, ``lang``, ``source``, ``tokens``, ``n_docs``, ``weight`` of the source).

    A budget goes down the tree level by level and each node's capacity is the sum of its leaves' epochs, so a
    shortage is made up by siblings first and reaches an ancestor's siblings only when those are full.
    """
    one = leaves.withColumn("capacity", F.col("tokens") * epochs)
    total = one.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_all")).select(F.expr(f"_all * {percent} div 100").alias("budget"))
    domains = one.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight("domain", domain_weights))
    domains = fill(domains.crossJoin(F.broadcast(total)).withColumn("_root", F.lit(0)), ["_root"], "domain").select("domain", F.col("share").alias("budget"))
    langs = one.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight("lang", language_weights))
    langs = fill(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    return fill(one.join(langs, ["domain", "lang"]), ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "n_docs", F.col("share").alias("budget"))


def mix_sources(
    docs: DataFrame,
    percent: int = TARGET_PERCENT,
    epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    catalogue: DataFrame | None = None,
    domain_weights: dict[str, int] = DOMAIN_WEIGHTS,
    language_weights: dict[str, int] = LANGUAGE_WEIGHTS,
) -> DataFrame:
    """The mix: ``doc_id``, ``domain``, ``lang``, ``source``, ``epoch`` (from 0) and ``n_tokens``, a row for each reading of a document.

    ``catalogue`` has a row (``source``, ``domain``, ``weight``) for each source; one that it lacks is in the domain "" with
    DEFAULT_WEIGHT, and so are all without a catalogue.

    Tokens are words. In every epoch a leaf's documents come in the order of md5(seed, epoch, id); a leaf takes
    documents while the tokens before them are fewer than its budget, so it passes it by less than one document.
    Null texts have no tokens, null languages and sources are "" and null ids are ordered as "". Repeated rows are
    documents of their own. An empty table gives an empty mix.

    A leaf may hold a third of all rows, so it is never sorted as a whole: sums over slices of the hash decide which
    slices are taken entirely, and only the one slice in which the budget ends is sorted.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"))
    if catalogue is None:
        placed = texts.withColumns({"domain": F.lit(""), "_weight": F.lit(DEFAULT_WEIGHT).cast("bigint")})
    else:
        known = catalogue.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.min(F.struct("domain", "weight")).alias("_c"))
        known = scratch.save(known.select("source", F.col("_c.domain").alias("domain"), F.col("_c.weight").cast("bigint").alias("_weight")), "catalogue")
        placed = texts.join(small(known, known.count()), "source", "left").withColumns({"domain": F.coalesce("domain", F.lit("")), "_weight": F.coalesce("_weight", F.lit(DEFAULT_WEIGHT)).cast("bigint")})
    base = scratch.save(placed, "tokens")
    leaf = ["domain", "lang", "source"]
    counted = base.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("_weight").alias("weight"))
    leaves = scratch.save(budgets(counted, percent, epochs, domain_weights, language_weights), "budgets")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    read = base.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("_key", key)
    rows = leaves.agg(F.coalesce(F.max("n_docs"), F.lit(0)).alias("n")).head()["n"]
    digits = 1
    while 16**digits * SLICE_ROWS < rows:
        digits += 1
    sliced = read.withColumn("_slice", F.substring("_key", 1, digits))
    order = Window.partitionBy(*leaf).orderBy("epoch", "_slice")
    sums = sliced.groupBy(*leaf, "epoch", "_slice").agg(F.sum("n_tokens").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(order) - F.col("_sum")).join(leaves.select(*leaf, "budget"), leaf)
    sums = scratch.save(sums.filter(F.col("_before") < F.col("budget")).select(*leaf, "epoch", "_slice", "_before", "budget", (F.col("_before") + F.col("_sum") <= F.col("budget")).alias("_whole")), "slices")
    chosen = sliced.join(sums, [*leaf, "epoch", "_slice"])
    out = ["doc_id", "domain", "lang", "source", "epoch", "n_tokens"]
    inside = Window.partitionBy(*leaf, "epoch", "_slice").orderBy("_key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = chosen.filter(~F.col("_whole")).withColumn("_until", F.col("_before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return chosen.filter("_whole").select(*out).unionByName(edge.filter(F.col("_until") < F.col("budget")).select(*out))


def mix_query(spark, sf_dir: str) -> DataFrame:
    """op7: the mix of all ``documents``, by :data:`CATALOGUE`."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text"), catalogue=default_catalogue(spark))


def _case(column: str, weights: dict[str, int]) -> str:
    return "(CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {DEFAULT_WEIGHT} END)"


def _fill_sql(table: str, parent: str, name: str) -> str:
    return f"""(SELECT *, CASE WHEN _full THEN capacity ELSE (budget - sum(CASE WHEN _full THEN capacity ELSE 0 END) OVER (PARTITION BY {parent})) * weight // nullif(sum(CASE WHEN _full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}), 0) END AS share
  FROM (SELECT *, (budget - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
    >= capacity * sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _full FROM {table}))"""


_LISTED = ", ".join(f"('{source}', '{domain}', {weight})" for domain, sources in CATALOGUE.items() for source, weight in sources.items())
SQL = rf"""
WITH listed(source, domain, weight) AS (VALUES {_LISTED}
), base AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens,
    coalesce(domain, '') AS domain, coalesce(weight, {DEFAULT_WEIGHT})::BIGINT AS source_weight FROM documents LEFT JOIN listed USING (source)
), leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, {MAX_EPOCHS} * sum(n_tokens)::BIGINT AS capacity, max(source_weight) AS source_weight FROM base GROUP BY domain, lang, source
), d0 AS (SELECT domain, sum(capacity)::BIGINT AS capacity, {_case("domain", DOMAIN_WEIGHTS)} AS weight, (SELECT sum(tokens)::BIGINT * {TARGET_PERCENT} // 100 FROM leaf) AS budget FROM leaf GROUP BY domain
), d AS (SELECT domain, share AS budget FROM {_fill_sql("d0", "1", "domain")}
), l0 AS (SELECT domain, lang, sum(capacity)::BIGINT AS capacity, {_case("lang", LANGUAGE_WEIGHTS)} AS weight, any_value(d.budget) AS budget FROM leaf JOIN d USING (domain) GROUP BY domain, lang
), l AS (SELECT domain, lang, share AS budget FROM {_fill_sql("l0", "domain", "lang")}
), s0 AS (SELECT domain, lang, source, capacity, source_weight AS weight, l.budget FROM leaf JOIN l USING (domain, lang)
), s AS (SELECT domain, lang, source, share AS budget FROM {_fill_sql("s0", "domain, lang", "source")}
), read AS (
  SELECT doc_id, domain, lang, source, epoch, n_tokens, budget, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, md5(concat('{SEED}|', epoch, '|', doc_id)), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS before
  FROM base JOIN s USING (domain, lang, source), (SELECT unnest(range({MAX_EPOCHS}))::INTEGER AS epoch)
) SELECT doc_id, domain, lang, source, epoch, n_tokens FROM read WHERE before < budget
"""

"""Queries on sequences and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import hashing, text
from loomspan.operators import annotations, normalize, prepare, windows

from .tables import RATED, SEGMENTS, SENTENCES, r6, rated, read, rounded, segments, sentences

QUERIES, SQL = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_BLOCKS = f"""WITH {SENTENCES}, ks AS (SELECT unnest([2, 3, 4, 5]) AS k), b AS (
  SELECT doc_id, lang, k, row // k AS chunk, count(*) AS n, string_agg(text, ' ' ORDER BY row) AS block FROM sent, ks GROUP BY doc_id, lang, k, row // k HAVING count(*) = k)"""


def _blocks(spark, sf_dir, sizes):
    b = windows.build_blocks(sentences(spark, sf_dir), sizes, ["lang"], "doc_id", "row", [F.col("text")])
    return b.withColumn("block", text.join_with(F.col("text"), text.joiner("lang")))


@query("blocks_all_k", _BLOCKS + " SELECT lang, k, count(*) AS n_blocks, sum(length(block))::BIGINT AS n_chars, min(md5(block)) AS least FROM b GROUP BY lang, k")
def blocks_all_k(spark, sf_dir):
    return _blocks(spark, sf_dir, [2, 3, 4, 5]).groupBy("lang", "k").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("block")).alias("n_chars"), F.min(F.md5(F.col("block").cast("binary"))).alias("least"))


@query("blocks_k2", _BLOCKS + " SELECT doc_id, (chunk * 2)::INTEGER AS first_row, md5(block) AS digest FROM b WHERE k = 2")
def blocks_k2(spark, sf_dir):
    return _blocks(spark, sf_dir, [2]).select("doc_id", "first_row", F.md5(F.col("block").cast("binary")).alias("digest"))


def _windows_sql(k, stride):
    return f"""WITH {SEGMENTS}, w AS (SELECT doc_id, seg_id, row_number() OVER o - 1 AS ix, list(seg_id) OVER f AS s, list(mt) OVER f AS m, avg(score) OVER f AS score FROM seg WINDOW o AS (PARTITION BY doc_id ORDER BY seg_id), f AS (PARTITION BY doc_id ORDER BY seg_id ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING))
SELECT doc_id, seg_id AS seg_start, {k}::INTEGER AS k, array_to_string(m, ' ') AS mt, {r6("score")} AS score FROM w WHERE len(s) = {k} AND s[{k}] - s[1] = {k - 1} AND ix % {stride} = 0"""


@query("windows_stride1", _windows_sql(3, 1))
def windows_stride1(spark, sf_dir):
    return rounded(windows.windows(segments(spark, sf_dir), ["doc_id"], "seg_id", 3, 1, ["mt"], "score"), "score")


@query("windows_stride_k", _windows_sql(2, 2))
def windows_stride_k(spark, sf_dir):
    return rounded(windows.windows(segments(spark, sf_dir), ["doc_id"], "seg_id", 2, 2, ["mt"], "score"), "score")


@query("slide_docmean", f"""WITH {SEGMENTS}, w AS (SELECT doc_id, row_number() OVER o - 1 AS ix, count(*) OVER (PARTITION BY doc_id) AS n, avg(score) OVER f AS score FROM seg WINDOW o AS (PARTITION BY doc_id ORDER BY seg_id), f AS (PARTITION BY doc_id ORDER BY seg_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT doc_id, {r6("avg(score)")} AS score, count(*) AS n_windows FROM w WHERE ix <= greatest(n - 3, 0) GROUP BY doc_id""")
def slide_docmean(spark, sf_dir):
    w = windows.slide(segments(spark, sf_dir), ["doc_id"], "seg_id", 3, ["mt"], "score")
    return rounded(windows.document_means(w, ["doc_id"], ["score"]), "score")


@query("prefix_blocks", _BLOCKS + ", p AS (SELECT doc_id, chunk, unnest([1, 2, 3, 4]) AS k2 FROM b WHERE k = 4) SELECT doc_id, k2 AS k, (chunk * 4)::INTEGER AS first_row, (chunk * 4 + k2 - 1)::INTEGER AS last_row FROM p")
def prefix_blocks(spark, sf_dir):
    b = windows.build_blocks(sentences(spark, sf_dir), [4], ["lang"], "doc_id", "row").drop("k")
    return windows.prefix_blocks(b, "rows", [1, 2, 3, 4]).select("doc_id", "k", "first_row", F.get("rows", F.size("rows") - 1).alias("last_row"))


@query("row_position", f"WITH {SENTENCES} SELECT doc_id, row, row_number() OVER (PARTITION BY doc_id ORDER BY length(text), row)::INTEGER AS position FROM sent")
def row_position(spark, sf_dir):
    return windows.row_position(sentences(spark, sf_dir).select("doc_id", "row", F.length("text").alias("n")), ["doc_id"], ["n", "row"]).drop("n")


@query("prefix_distinct", f"WITH {SENTENCES} SELECT doc_id, min(row) AS row, text FROM sent GROUP BY doc_id, text")
def prefix_distinct(spark, sf_dir):
    return windows.prefix_distinct(sentences(spark, sf_dir), ["doc_id"], "row", "text").select("doc_id", "row", "text")


@query("global_window_ids", "SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS window_id FROM documents")
def global_window_ids(spark, sf_dir):
    return windows.global_ids(read(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id").select("doc_id", "window_id")


_SPLIT = "((('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT::HUGEINT % 10000) * 1616 + ('0x' || substr(md5(doc_id::VARCHAR), 17, 16))::UBIGINT::HUGEINT % 10000) % 10000"


@query("hash_split", f"SELECT doc_id, CASE WHEN {_SPLIT} < 1000 THEN 'val' ELSE 'train' END AS split, ({_SPLIT})::BIGINT AS bucket FROM documents")
def hash_split(spark, sf_dir):
    return prepare.split_by_document(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").withColumn("bucket", hashing.md5_bucket(F.col("doc_id")))


@query("split_disjoint_check", f"WITH {SENTENCES}, s AS (SELECT doc_id, CASE WHEN {_SPLIT} < 1000 THEN 'val' ELSE 'train' END AS split FROM sent) SELECT split, count(*) AS n, count(DISTINCT doc_id) AS docs, (SELECT count(*) FROM (SELECT doc_id FROM s GROUP BY doc_id HAVING count(DISTINCT split) > 1)) AS torn FROM s GROUP BY split")
def split_disjoint_check(spark, sf_dir):
    s = prepare.split_by_document(sentences(spark, sf_dir).select("doc_id"), "doc_id")
    per = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("split"), (F.count_distinct("split") > 1).alias("torn"))
    torn = per.agg(F.count_if("torn").alias("torn"))
    return per.groupBy("split").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).join(F.broadcast(torn))


@query("dedupe_mean", f"WITH {SEGMENTS} SELECT doc_id, seg_id, {r6('score')} AS score, mt, {r6('disc')} AS disc FROM seg")
def dedupe_mean(spark, sf_dir):
    return rounded(segments(spark, sf_dir), "score", "disc")


_WEIGHT = "CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linestatus = 'F' THEN 25.0 ELSE 5.0 END WHEN 'N' THEN CASE WHEN l_linestatus = 'F' THEN 0.1 ELSE 1.0 END ELSE 0.0 END::DOUBLE"


@query("two_level_rollup", f"WITH r AS (SELECT l_orderkey, l_suppkey, sum({_WEIGHT}) AS w FROM lineitem GROUP BY l_orderkey, l_suppkey) SELECT l_orderkey, {r6('0.0 - avg(w)')} AS score FROM r GROUP BY l_orderkey")
def two_level_rollup(spark, sf_dir):
    severity = F.when(F.col("l_returnflag") == "A", "Major").when(F.col("l_returnflag") == "N", " minor").otherwise("neutral")
    category = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "A", "Non-translation").otherwise("Fluency/Punctuation")).otherwise("accuracy")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", annotations.error_weight(severity, category).alias("w"))
    return rounded(annotations.two_level_rollup(rows, ["l_orderkey"], "l_suppkey", "w"), "score")


@query("severity_penalty", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN -25.0 WHEN '2-HIGH' THEN -5.0 WHEN '5-LOW' THEN 0.0 ELSE -1.0 END::DOUBLE AS penalty FROM orders")
def severity_penalty(spark, sf_dir):
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "MAJOR").when(p == "5-LOW", "neutral").when(p == "4-NOT SPECIFIED", F.lit(None)).otherwise(p)
    return read(spark, sf_dir, "orders").select("o_orderkey", annotations.penalties(F.array(F.struct(severity.alias("severity")))).alias("penalty"))


@query("numeric_filter", f"WITH {SENTENCES}, w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS value FROM sent) SELECT doc_id, value::DOUBLE AS value, count(*) AS n FROM w WHERE regexp_matches(value, '{annotations.NUMBER}') GROUP BY 1, 2")
def numeric_filter(spark, sf_dir):
    """The words of all documents that are numbers."""
    words = sentences(spark, sf_dir).select("doc_id", F.explode(F.split("text", " ")).alias("value"))
    return annotations.numeric_only(words, ["value"]).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("score_range", "SELECT c_nationkey, count(*) AS n, " + r6("min(c_acctbal)") + " AS low, " + r6("max(c_acctbal)") + " AS high FROM customer GROUP BY c_nationkey")
def score_range(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("c_acctbal", annotations.checked_range("c_acctbal", -1e6, 1e6))
    return rounded(rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high")), "low", "high")


def _z(mu, sd):
    return r6(f"1.0 / (1.0 + exp(-((s - {mu}) / coalesce(nullif({sd}, 0), 1))))")


@query("zscore_train_fit", f"WITH d AS (SELECT c_custkey, c_mktsegment AS g, c_acctbal AS s, c_custkey % 5 <> 0 AS t FROM customer), f AS (SELECT g, avg(s) AS mu, stddev_samp(s) AS sd FROM d WHERE t GROUP BY g) SELECT c_custkey, g, {_z('mu', 'sd')} AS s FROM d JOIN f USING (g)")
def zscore_train_fit(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("s"), (F.col("c_custkey") % 5 != 0).alias("t"))
    return rounded(normalize.fit_on_train(rows, ["g"], "s", "t").select("c_custkey", "g", "s"), "s")


@query("zscore_self", f"WITH d AS (SELECT c_custkey, c_nationkey AS g, c_mktsegment AS f, c_acctbal AS s FROM customer) SELECT c_custkey, g, CASE WHEN min(s) OVER (PARTITION BY f) < 0 OR max(s) OVER (PARTITION BY f) > 1 THEN {_z('avg(s) OVER (PARTITION BY g)', 'stddev_samp(s) OVER (PARTITION BY g)')} ELSE s END AS s FROM d")
def zscore_self(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("f"), F.col("c_acctbal").alias("s"))
    return rounded(normalize.fit_on_self(rows, ["g"], "s", ["f"]).select("c_custkey", "g", "s"), "s")


@query("zscore_const_half", f"WITH d AS (SELECT s_suppkey, s_suppkey // 3 AS g, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal ELSE 1.0 END AS s FROM supplier), w AS (SELECT *, avg(s) OVER (PARTITION BY g) AS mu, stddev_samp(s) OVER (PARTITION BY g) AS sd FROM d) SELECT s_suppkey, g, CASE WHEN sd = 0 THEN 0.5 ELSE {r6('1.0 / (1.0 + exp(-((s - mu) / nullif(sd, 0))))')} END AS s FROM w")
def zscore_const_half(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.expr("s_suppkey div 3").alias("g"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).otherwise(1.0).alias("s"))
    return rounded(normalize.constant_half(rows, ["g"], "s"), "s")


@query("freq_filter", "SELECT lang, source, count(*) AS n FROM documents WHERE (lang, source) IN (SELECT (lang, source) FROM documents GROUP BY lang, source HAVING count(*) >= 30) GROUP BY lang, source")
def freq_filter(spark, sf_dir):
    rows = prepare.frequent_groups(read(spark, sf_dir, "documents").select("lang", "source"), ["lang", "source"], 30)
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


_TOK = "len(regexp_extract_all(text, '[A-Za-z0-9À-ÿ]+|[^A-Za-z0-9À-ÿ \\t\\n\\x0B\\f\\r]'))::BIGINT"


@query("token_budget", f"SELECT doc_id, {_TOK} AS n_text, {_TOK.replace('text', 'lang')} AS n_lang FROM documents WHERE {_TOK} <= 480 AND {_TOK} + {_TOK.replace('text', 'lang')} <= 400")
def token_budget(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return prepare.token_budget(rows, ["text", "lang"], ("text", "lang"), 480, 400).select("doc_id", "n_text", "n_lang")


@query("unfitted_groups", "WITH g AS (SELECT source, lang, (length(coalesce(text, '')) // 1000)::INTEGER AS size, doc_id % 7 <> 0 AS t FROM documents) SELECT DISTINCT source, lang, size FROM g WHERE NOT t AND NOT EXISTS (SELECT 1 FROM g h WHERE h.t AND h.source = g.source AND h.lang = g.lang AND h.size = g.size)")
def unfitted_groups(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("source", "lang", F.expr("length(coalesce(text, '')) div 1000").cast("int").alias("size"), (F.col("doc_id") % 7 != 0).alias("t"))
    return normalize.unfitted_groups(rows, ["source", "lang", "size"], "t")


@query("coverage_shared_keys", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation")
def coverage_shared_keys(spark, sf_dir):
    tables = {t: read(spark, sf_dir, t).select(F.col(f"{t[0]}_nationkey").alias("nation")) for t in ("customer", "supplier", "nation")}
    return prepare.shared_keys(tables, "nation")


@query("complete_ids", "SELECT doc_id, turn_role FROM (SELECT conv_id AS doc_id, role AS turn_role FROM conversations) WHERE doc_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) = 3)")
def complete_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("turn_role"))
    return prepare.complete_ids(rows, ["doc_id"], "turn_role", 3)


@query("first_ids", "WITH d AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_partkey ELSE p_partkey::VARCHAR END AS id FROM part), o AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN id[1] = 'x' THEN 1 ELSE 0 END, TRY_CAST(id AS BIGINT), id) AS r FROM (SELECT DISTINCT id FROM d)) SELECT id FROM o WHERE r <= 150")
def first_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string")).alias("id"))
    return prepare.first_ids(rows, "id", 150)


@query("first_per_group", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 10")
def first_per_group(spark, sf_dir):
    return prepare.first_per_group(read(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 10)


@query("reference_join", "WITH r AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS ref FROM orders GROUP BY o_custkey) SELECT c_custkey, ref FROM customer JOIN r ON c_custkey = o_custkey WHERE ref <> 'P'")
def reference_join(spark, sf_dir):
    refs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("ref"), "o_orderkey")
    return prepare.with_references(read(spark, sf_dir, "customer").select("c_custkey"), refs, ["c_custkey"], "ref", ["o_orderkey"])


@query("reference_missing", "SELECT count(*) AS n, count(*) FILTER (WHERE o_custkey IS NULL) AS dropped FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey")
def reference_missing(spark, sf_dir):
    refs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderkey")
    rows = prepare.with_references(read(spark, sf_dir, "customer").select("c_custkey"), refs, ["c_custkey"], "o_orderstatus", ["o_orderkey"], keep_missing=True)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus").isNull()).alias("dropped"))


@query("changed_documents", "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE text <> replace(text, 'the', 'THE'))")
def changed_documents(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.replace("text", F.lit("the"), F.lit("THE")).alias("b"))
    return prepare.changed_documents(rows, ["conv_id"], "a", "b").select("conv_id", "turn")


@query("paired_keys", "SELECT l.doc_id, 'b' AS missing_in FROM labels l WHERE l.doc_id % 3 = 0 AND l.doc_id % 2 <> 0 UNION ALL SELECT doc_id, 'a' FROM labels WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def paired_keys(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select("doc_id")
    return prepare.assert_paired(rows.filter("doc_id % 3 = 0"), rows.filter("doc_id % 2 = 0"), ["doc_id"])


@query("splice_first", f"WITH {SENTENCES}, w AS (SELECT doc_id, string_agg(text, ' ' ORDER BY row) AS ref, min(text) FILTER (WHERE row = 0) AS f FROM sent GROUP BY doc_id) SELECT doc_id, md5('<' || f || '>' || substr(ref, length(f) + 1)) AS spliced FROM w")
def splice_first(spark, sf_dir):
    s = sentences(spark, sf_dir)
    longer = s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), " ").alias("reference"))
    single = s.filter("row = 0").select("doc_id", F.col("text").alias("reference"), F.array(F.concat(F.lit("<"), "text", F.lit(">"))).alias("distractors"))
    return prepare.splice_first(longer, single, ["doc_id"], "distractors", "reference").select("doc_id", F.md5(F.get("distractors", F.lit(0)).cast("binary")).alias("spliced"))


def _collapsed(sql):
    return f"trim(regexp_replace({sql}, '{text.SPACE}', ' ', 'g'))"


_BARE = "replace(replace(replace(replace(replace(html, '<p>', '<v>'), '</p>', '</v>'), '<v>', ''), '</v>', ''), chr(92) || 'n', ' ')"


@query("normalize_text", f"SELECT page_id, md5({_collapsed(_BARE)}) AS digest FROM pages")
def normalize_text(spark, sf_dir):
    """Pages whose paragraphs are marked as error spans are."""
    marked = F.replace(F.replace("html", F.lit("<p>"), F.lit("<v>")), F.lit("</p>"), F.lit("</v>"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_markup(marked).cast("binary")).alias("digest"))


@query("tidy_text", rf"SELECT doc_id, md5(regexp_replace({_collapsed('text')}, ' +([,.;:!?])', '\1', 'g')) AS digest FROM documents")
def tidy_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.tidy(F.col("text")).cast("binary")).alias("digest"))


@query("join_nonblank", f"WITH {SENTENCES} SELECT doc_id, md5(string_agg(trim(text), ' ' ORDER BY row) FILTER (WHERE trim(text) <> '')) AS digest FROM sent GROUP BY doc_id")
def join_nonblank(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.join_nonblank(F.split("text", "\n", -1)).cast("binary")).alias("digest"))


@query("word_case", "SELECT p_partkey, strip, CASE WHEN length(strip) > 1 AND strip = upper(strip) AND strip <> lower(strip) THEN 'XYZ' WHEN regexp_matches(strip, '^[A-Z]') THEN 'Xyz' ELSE 'xyz' END AS cased FROM (SELECT p_partkey, trim(string_split(p_name, ' ')[1], '.,;:!?') AS strip FROM part)")
def word_case(spark, sf_dir):
    word = text.strip_punctuation(F.get(F.split("p_name", " "), F.lit(0)))
    return read(spark, sf_dir, "part").select("p_partkey", word.alias("strip"), text.match_case(F.lit("xyz"), word).alias("cased"))


@query("id_parsing", "SELECT doc_id, lang || '-xx' AS lp, source AS domain, lang || '-w' || lpad(doc_id::VARCHAR, greatest(3, length(doc_id::VARCHAR))::INTEGER, '0') || '-k2' AS id FROM documents")
def id_parsing(spark, sf_dir):
    full = F.concat("lang", F.lit("-xx_YY_#_"), "source", F.lit("_#_1"))
    return read(spark, sf_dir, "documents").select("doc_id", text.pair_of(full).alias("lp"), text.domain_of(full).alias("domain"), text.window_id(F.col("lang"), F.col("doc_id"), F.lit(2)).alias("id"))


@query("arm_labels", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'qe' ELSE 'ref' END AS family, 'frac' || s_suppkey AS mix, s_suppkey % 3 = 0 AS frozen, (CASE WHEN s_suppkey % 2 = 0 THEN 'qe' ELSE 'ref' END) || '-frac' || s_suppkey || (CASE WHEN s_suppkey % 3 = 0 THEN '-frozen' ELSE '' END) AS label FROM supplier")
def arm_labels(spark, sf_dir):
    k = F.col("s_suppkey")
    name = text.arm_to_file(F.when(k % 2 == 0, "qe").otherwise("ref"), F.concat(F.lit("frac"), k.cast("string")), k % 3 == 0)
    back = read(spark, sf_dir, "supplier").select("s_suppkey", text.file_to_arm(name).alias("a")).select("s_suppkey", "a.family", "a.mix", "a.frozen")
    return back.withColumn("label", text.arm_to_label(F.col("family"), F.col("mix"), F.col("frozen")))


@query("event_props", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE props IS NOT NULL GROUP BY event_type")
def event_props(spark, sf_dir):
    return read(spark, sf_dir, "events").filter("props IS NOT NULL").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("url_host", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY host")
def url_host(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"))

"""Queries that go through files: rows of the tables are written in a format, read by its reader, and held against SQL on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import contrastive
from loomspan.sources import aligned_source, readers, writers
from loomspan.sources.scratch import Scratch

from .tables import r6, read, rounded

QUERIES, SQL = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _folder(spark, tag):
    return Scratch(spark, "files").folder(tag)


def _md5(column):
    return F.md5(F.col(column).cast("binary")) if isinstance(column, str) else F.md5(column.cast("binary"))


def _write_tsv(rows, path):
    """Tab-separated with a header, no quoting at all."""
    rows.write.option("sep", "\t").option("quote", "").option("header", True).csv(path)


@query("tsv_ratings", "SELECT o_orderstatus AS system, chr(34) || o_orderpriority AS doc, o_orderkey::VARCHAR AS seg_id, " + r6("o_totalprice") + " AS score FROM orders WHERE o_orderkey % 7 <> 0")
def tsv_ratings(spark, sf_dir):
    """Ratings as TSV: an unpaired quote is text, header names are padded, scores that are no numbers go."""
    score = F.when(F.col("o_orderkey") % 7 == 0, "None").otherwise(F.col("o_totalprice").cast("string"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("system"), F.concat(F.lit('"'), "o_orderpriority").alias(" doc "), F.col("o_orderkey").alias("seg_id"), score.alias("score"))
    path = _folder(spark, "ratings")
    _write_tsv(rows, path)
    return rounded(readers.read_ratings(spark, path).select("system", "doc", "seg_id", "score"), "score")


def _write_lines(rows, short, path):
    """Tab-separated lines under a header, without quoting; where ``short`` holds the last field is not written at all."""
    whole = F.concat_ws("\t", *rows.columns)
    cut = F.concat_ws("\t", *rows.columns[:-1])
    name = "\t".join(rows.columns)
    rows.select(F.when(short, cut).otherwise(whole).alias(name)).write.option("sep", "\x01").option("quote", "").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


@query("tsv_errors", "SELECT l_returnflag AS severity, CASE l_partkey % 10 WHEN 1 THEN '' ELSE 's' || l_partkey END AS source, CASE l_suppkey % 6 WHEN 1 THEN '' ELSE 't' || l_suppkey END AS target, l_orderkey || ':' || l_linenumber AS seg FROM lineitem WHERE l_partkey % 10 <> 0 AND l_suppkey % 6 <> 0")
def tsv_errors(spark, sf_dir):
    """Error rows as TSV: marked canary rows and lines without a target go, empty fields stay, docSegId comes before seg_id."""
    line = read(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_partkey") % 10 == 1, "").otherwise(F.concat(F.when(F.col("l_partkey") % 10 == 0, "a CANARY row ").otherwise(""), F.lit("s"), F.col("l_partkey").cast("string")))
    target = F.when(F.col("l_suppkey") % 6 == 1, "").otherwise(F.concat(F.lit("t"), F.col("l_suppkey").cast("string")))
    rows = line.select(F.col("l_returnflag").alias("severity"), source.alias("source"), F.lit("none").alias("seg_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("docSegId"), target.alias("target"))
    path = _folder(spark, "errors")
    _write_lines(rows, F.col("target").rlike("^t") & (F.substring("target", 2, 20).try_cast("long") % 6 == 0), path)
    return readers.read_errors(spark, path).select("severity", "source", "target", "seg")


@query("tsv_error_segments", "WITH e AS (SELECT l_returnflag AS system, l_orderkey // 8 AS doc, l_orderkey % 8 AS seg, l_linestatus || (l_partkey % 7) AS rater, CASE l_linenumber % 4 WHEN 0 THEN 'Major' WHEN 1 THEN 'minor' WHEN 2 THEN ' MINOR ' ELSE '' END AS severity, CASE l_suppkey % 3 WHEN 0 THEN 'Fluency/Punctuation' WHEN 1 THEN 'Non-translation!' ELSE '' END AS category FROM lineitem), r AS (SELECT system, doc, seg, rater, sum(CASE lower(trim(severity)) WHEN 'major' THEN CASE WHEN category LIKE 'Non-%' THEN 25.0 ELSE 5.0 END WHEN 'minor' THEN CASE WHEN category LIKE 'Flu%' THEN 0.1 ELSE 1.0 END ELSE 0.0 END::DOUBLE) AS w FROM e GROUP BY ALL) SELECT system, doc::VARCHAR AS doc, seg::VARCHAR AS seg, 's' || (8 * doc + seg) AS source, '' AS target, " + r6("0.0 - avg(w)") + " AS score FROM r GROUP BY system, doc, seg")
def tsv_error_segments(spark, sf_dir):
    """From error lines to scored segments: penalties by category and severity, summed by rater, averaged over raters."""
    n, c = F.col("l_linenumber") % 4, F.col("l_suppkey") % 3
    severity = F.when(n == 0, "Major").when(n == 1, "minor").when(n == 2, " MINOR ").otherwise("")
    category = F.when(c == 0, "Fluency/Punctuation").when(c == 1, "Non-translation!").otherwise("")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias(" system "), F.expr("l_orderkey div 8").cast("string").alias("doc"), (F.col("l_orderkey") % 8).cast("string").alias("seg_id"), F.concat("l_linestatus", (F.col("l_partkey") % 7).cast("string")).alias("rater"), severity.alias("severity"), category.alias("category"), F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("source"), F.lit("").alias("target"))
    path = _folder(spark, "errors")
    _write_lines(rows, F.lit(False), path)
    return rounded(readers.error_segments(readers.read_errors(spark, path)), "score")


@query("json_document_scores", "SELECT 'en-de_DE_#_' || lower(o_orderpriority[1:1]) || '_#_' || o_orderkey AS doc_id, l_returnflag AS system, true AS has_mt, " + r6("avg(l_quantity)") + " AS score, 'en-de' AS lp, lower(o_orderpriority[1:1]) AS domain FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' AND o_orderkey % 5 <> 0 GROUP BY o_orderkey, o_orderpriority, l_returnflag")
def json_document_scores(spark, sf_dir):
    """Nested scores as JSON lines: systems named ref*, documents without a reference and scores that are no numbers go."""
    line = read(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.struct(F.col("l_quantity").cast("string").alias("score"))).alias("s"))
    each = line.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", F.concat("s", F.array(F.struct(F.lit("None").alias("score")))).alias("s"))).alias("all"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.substring("o_orderpriority", 1, 1)).alias("d"))
    rows = each.join(orders, each["l_orderkey"] == orders["o_orderkey"])
    scores = F.concat("all", F.array(F.struct(F.lit("refA").alias("l_returnflag"), F.array(F.struct(F.lit("1").alias("score"))).alias("s"))))
    doc = rows.select(F.concat(F.lit("en-de_DE_#_"), "d", F.lit("_#_"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.lit("src").alias("src_text"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise("ref").alias("ref_text"), F.map_from_entries(F.transform("all", lambda x: F.struct(x["l_returnflag"], F.lit("mt")))).alias("tgt_text"), F.map_from_entries(scores).alias("scores"))
    path = _folder(spark, "scores")
    writers.write_json(doc, path)
    found = readers.document_scores(readers.read_json(spark, path, readers.DOCUMENT_SCORES))
    return rounded(found.select("doc_id", "system", F.col("mt").isNotNull().alias("has_mt"), "score", "lp", "domain"), "score")


@query("json_annotations", "SELECT 'n' || s_nationkey AS system, s_name AS doc_id, s_suppkey::VARCHAR AS seg_id, CASE s_suppkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN -25.0 ELSE -6.0 END::DOUBLE AS penalty FROM supplier")
def json_annotations(spark, sf_dir):
    """One JSON array of annotated segments per system, each a file."""
    error = lambda *names: F.array(*[F.struct(F.lit(n).alias("severity")) for n in names]).cast("array<struct<severity:string>>")
    errors = F.when(F.col("s_suppkey") % 3 == 0, error()).when(F.col("s_suppkey") % 3 == 1, error("critical")).otherwise(error("Major", "minor"))
    each = F.struct(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("MT_Engine"), F.col("s_name").alias("DOC_ID"), F.col("s_suppkey").cast("string").alias("SEG_ID"), errors.alias("target_errors"))
    path = _folder(spark, "annotations")
    read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(each)).alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return readers.read_annotations(spark, [path]).select("system", "doc_id", "seg_id", "penalty")


@query("aligned_lines", "WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row, p_name, p_brand FROM part) SELECT row::INTEGER AS row, lang, CASE lang WHEN 'en' THEN p_name ELSE upper(p_name) END AS text, p_brand AS url FROM p, (SELECT unnest(['en', 'fr']) AS lang)")
def aligned_lines(spark, sf_dir):
    """Two line-aligned files and the TSV that says what article each line is of."""
    path, files = _folder(spark, "lines"), {}
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.upper("p_name").alias("upper"), "p_brand").orderBy("p_partkey").coalesce(1)
    for lang, column in (("en", "p_name"), ("fr", "upper")):
        files[lang] = f"{path}/{lang}"
        part.select(column).write.text(files[lang])
    part.select(F.col("p_brand").alias("url"), "p_partkey").write.option("sep", "\t").option("header", True).csv(f"{path}/urls")
    return readers.load_aligned(spark, "lines", files=files, split="dev", urls=f"{path}/urls").select("row", "lang", "text", "url")


@query("aligned_records", "WITH p AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_partkey ELSE p_partkey::VARCHAR END AS id, p_partkey, p_name FROM part WHERE p_partkey % 4 <> 0), n AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN id[1] = 'x' THEN 1 ELSE 0 END, TRY_CAST(id AS BIGINT), id) - 1 AS row FROM p) SELECT row, id, CASE WHEN p_partkey % 5 = 0 THEN id ELSE 'u' || p_partkey END AS url, lang, lang || p_name AS text FROM n, (SELECT unnest(['en', 'de']) AS lang)")
def aligned_records(spark, sf_dir):
    """Sentences keyed by id, as JSON lines: ids that both languages have, in numeric-then-text order."""
    key = F.col("p_partkey")
    ids = F.when(key % 3 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string"))
    rows = read(spark, sf_dir, "part").select(ids.alias("id"), key, "p_name", F.explode(F.array(F.lit("en"), F.lit("de"), F.lit("fr"))).alias("lang")).filter("NOT (p_partkey % 4 = 0 AND lang = 'de')")
    path = _folder(spark, "records")
    writers.write_json(rows.select("id", "lang", F.concat("lang", "p_name").alias("text"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("u"), key.cast("string"))).alias("url")), path)
    return readers.load_aligned(spark, "records", rows=readers.read_json(spark, path, "id string, lang string, text string, url string"), langs=["en", "de"]).select("row", "id", "url", "lang", "text")


_POOL = "SELECT doc_id::VARCHAR AS doc_id, md5(text || chr(34) || chr(10) || chr(34)) AS src, lang || '-xx' AS lp, source AS domain, " + r6("n_chars / 7.0::DOUBLE") + " AS score FROM documents WHERE text IS NOT NULL"


def _pool_rows(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    src = F.concat("text", F.lit('"\n"'))
    return d.select(src.alias("src"), F.lit("mt").alias("mt"), F.lit("").alias("ref"), (F.col("n_chars") / F.lit(7.0)).alias("score"), F.concat("lang", F.lit("-xx")).alias("lp"), F.lit(1).alias("k"), F.lit("s").alias("system"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("seg_start"), F.col("source").alias("domain"), F.lit("set").alias("source_set"), F.lit("sent").alias("origin"))


@query("csv_pool", _POOL)
def csv_pool(spark, sf_dir):
    """Pool rows as CSV with newlines and quotes in their texts, read back and checked."""
    rows = _pool_rows(spark, sf_dir)
    path = _folder(spark, "pool")
    writers.write_csv(rows, path)
    back = writers.verified(spark, path, readers.POOL_ROW, rows.count(), ["score"])
    return rounded(back.select("doc_id", _md5("src").alias("src"), "lp", "domain", "score"), "score")


@query("csv_groups", "SELECT lang || '-xx' AS lp, source AS domain, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def csv_groups(spark, sf_dir):
    """One folder of CSV files per language pair, written twice: only what is written again is replaced."""
    rows = _pool_rows(spark, sf_dir)
    path = _folder(spark, "groups")
    writers.write_partitioned(rows, path, ["lp"], "csv")
    writers.write_partitioned(rows.filter("lp = 'en-xx'"), path, ["lp"], "csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.groupBy("lp", "domain").agg(F.count(F.lit(1)).alias("n"))


@query("csv_portion", "SELECT o_orderkey::VARCHAR AS src, " + r6("o_totalprice") + " AS score, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 3 END::INTEGER AS k, '' AS ref, 'wmt' AS source_set, 'eval_portion' AS origin FROM orders")
def csv_portion(spark, sf_dir):
    """A foreign CSV with required columns only: the others get defaults, a k that is no number is 0."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("src"), F.lit("m").alias("mt"), F.col("o_totalprice").alias("score"), F.lit("en-de").alias("lp"), F.when(F.col("o_orderkey") % 2 == 0, "many").otherwise("3").alias("k"))
    path = _folder(spark, "portion")
    writers.write_csv(rows, path)
    found = readers.eval_portion(spark.read.option("header", True).csv(path), "wmt")
    return rounded(found.select("src", "score", "k", "ref", "source_set", "origin"), "score")


@query("csv_rows", "SELECT count(*) AS n FROM documents WHERE text IS NOT NULL")
def csv_rows(spark, sf_dir):
    """Logical rows of a CSV whose texts hold newlines."""
    path = _folder(spark, "count")
    writers.write_csv(_pool_rows(spark, sf_dir).select("src", "doc_id"), path)
    return spark.range(1).select(F.lit(readers.count_rows(spark, path)).cast("bigint").alias("n"))


@query("json_blocks", "SELECT l_orderkey AS block_id, 'dev' AS split, 'u' || l_orderkey AS url, count(*)::INTEGER AS k, array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS rows FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey")
def json_blocks(spark, sf_dir):
    """Blocks with nested rows, written as JSON and read with their schema; other fields are ignored."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    blocks = lines.groupBy(F.col("l_orderkey").alias("block_id")).agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("rows"))
    path = _folder(spark, "blocks")
    writers.write_json(blocks.select("block_id", F.lit("dev").alias("split"), F.concat(F.lit("u"), F.col("block_id").cast("string")).alias("url"), F.size("rows").alias("k"), "rows", F.lit(1).alias("other")), path)
    return readers.read_json(spark, path, readers.BLOCK).withColumn("rows", F.array_join(F.col("rows").cast("array<string>"), ","))


@query("json_split_map", "SELECT 'd' || doc_id AS doc_id, lang AS lp, CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'test' END AS split FROM documents WHERE lang IS NOT NULL")
def json_split_map(spark, sf_dir):
    """A split map as nested JSON, one row per language, read as rows of documents."""
    d = read(spark, sf_dir, "documents").filter("lang IS NOT NULL").select("lang", F.when(F.col("doc_id") % 3 == 0, "dev").otherwise("test").alias("split"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"))
    inner = d.groupBy("lang", "split").agg(F.collect_list("doc").alias("docs")).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("split", "docs"))).alias("m"))
    path = _folder(spark, "splits")
    writers.write_json(inner.select(F.create_map("lang", "m").alias("value")), path)
    return readers.split_map(readers.read_json(spark, path, "value map<string,map<string,array<string>>>")).select("doc_id", "lp", "split")


@query("markdown_counts", "SELECT lower(p_type) AS category, count(*) * 1000 AS n FROM part GROUP BY p_type")
def markdown_counts(spark, sf_dir):
    """Counts advertised in a Markdown table, with marks, thousands separators and lines of other kinds."""
    made = read(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    lines = made.select(F.explode(F.array(F.format_string("| **%s** | %s |", F.col("p_type"), F.format_number(F.col("n") * 1000, 0)), F.format_string("* %s 7", F.col("p_type")), F.lit("| other | 5 |"), F.lit("|---|---|"))).alias("value"))
    path = _folder(spark, "markdown")
    lines.write.text(path)
    names = [r["c"] for r in read(spark, sf_dir, "part").select(F.lower("p_type").alias("c")).distinct().collect()]
    return readers.table_counts(spark.read.text(path), names)


@query("envelope_cells", "SELECT l_returnflag AS model, l_linenumber AS k, count(*) AS n, 'demo' AS experiment, true AS dated FROM lineitem GROUP BY ALL")
def envelope_cells(spark, sf_dir):
    """The fact table of a run with the row that says what it is, read back together."""
    cells = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    path = _folder(spark, "envelope")
    writers.write_envelope(cells, path, "demo", {"seed": "1"})
    told = readers.read_json(spark, f"{path}/envelope", "experiment string, timestamp string, config map<string,string>")
    dated = F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT") & (F.col("config")["seed"] == "1")
    return spark.read.parquet(f"{path}/cells").join(F.broadcast(told.select("experiment", dated.alias("dated"))))


@query("heldout_report", "WITH r AS (SELECT l_returnflag AS set, l_shipmode AS system, l_orderkey AS doc_id, l_quantity AS score, l_linestatus = 'F' AS ok FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem)) SELECT set, count(*) FILTER (WHERE ok) AS rows, count(DISTINCT system) FILTER (WHERE ok) AS systems, count(DISTINCT doc_id) FILTER (WHERE ok) AS docs, " + r6("avg(score) FILTER (WHERE ok)") + " AS mean_score, count(*) FILTER (WHERE NOT ok) AS dropped FROM r GROUP BY set HAVING count(*) FILTER (WHERE ok) > 0")
def heldout_report(spark, sf_dir):
    """What a build kept and dropped, by set."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("set"), F.col("l_linestatus").alias("system"), F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("score"))
    report = writers.build_report(rows.filter("system = 'F'"), rows.filter("system <> 'F'"), ["set"])
    return rounded(report.select("set", "rows", "systems", "docs", "mean_score", "dropped"), "mean_score")


@query("references_by_line", "WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, l_shipdate FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_shipdate::VARCHAR AS l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_shipdate) = 1)) SELECT o_orderkey AS doc_id, s.i::VARCHAR AS seg_id, n.l_shipdate AS ref FROM orders JOIN (SELECT unnest([1, 2, 3, 9]) AS i) s ON true LEFT JOIN n ON n.l_orderkey = o_orderkey AND n.i = s.i")
def references_by_line(spark, sf_dir):
    """Segment n of a document has the n-th of its reference lines; segments beyond them have none."""
    first = F.min(F.struct("l_partkey", F.col("l_shipdate").cast("string").alias("d")))
    refs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no")).agg(first.alias("f")).select("doc_id", "line_no", F.col("f.d").alias("ref"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*map(F.lit, ("1", "2", "3", "9")))).alias("seg_id"))
    return readers.reference_by_line(rows, refs).select("doc_id", "seg_id", "ref")


@query("references_by_source", "WITH r AS (SELECT p_type || ' x' AS key, max_by(p_name, p_partkey) AS ref FROM part WHERE p_size < 40 GROUP BY p_type) SELECT p_partkey, ref FROM part LEFT JOIN r ON p_type || ' x' = key")
def references_by_source(spark, sf_dir):
    """The last reference of the same source text, error marks and white space aside."""
    part = read(spark, sf_dir, "part")
    refs = part.filter("p_size < 40").select(F.concat(F.lit(" <v>"), "p_type", F.lit("</v>\t\\nx")).alias("src"), F.col("p_name").alias("ref"), "p_partkey")
    return readers.reference_by_source(part.select("p_partkey", F.concat("p_type", F.lit("  x ")).alias("src")), refs, "p_partkey").select("p_partkey", "ref")


@query("json_length_histogram", "SELECT l_returnflag AS set, l_linenumber::INTEGER AS k, 'n_mt' AS field, (least(floor(l_quantity / 20), 2) * 20)::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def json_length_histogram(spark, sf_dir):
    """Histograms of lengths as one nested JSON document, read as rows; empty bins are left aside here."""
    h = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(*[F.count_if(F.least(F.floor(F.col("l_quantity") / 20), F.lit(2)) == i).alias(f"h{i}") for i in range(3)])
    value = F.map_from_arrays(F.array(F.lit("n_mt"), F.lit("n")), F.array(F.to_json(F.struct(F.array("h0", "h1", "h2").alias("hist"))), F.lit("7")))
    per_k = h.groupBy("l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), value))).alias("per_k"))
    sets = per_k.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.struct(F.array(*map(F.lit, (0, 20, 40))).alias("bins"), "per_k"))))).alias("value"))
    path = _folder(spark, "lengths")
    sets.coalesce(1).write.text(path)
    return readers.length_histogram(spark, path).filter("n > 0")


@query("contrastive_files", "WITH r AS (SELECT l_returnflag AS lp, l_linestatus AS system, 'p' || (l_suppkey % 4) AS perturbation, l_extendedprice - 1000 * l_quantity AS diff FROM lineitem) SELECT lp, system, perturbation, count(*) AS n, " + r6("avg((diff > 0)::INT)") + " AS accuracy, count(*) FILTER (WHERE diff = 0) AS ties, perturbation = 'p3' AS sparse FROM r GROUP BY lp, system, perturbation")
def contrastive_files(spark, sf_dir):
    """Contrastive sets as a folder of JSON lines for each pair and system: both scores of every item, read back with the folders' names."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("lp"), F.col("l_linestatus").alias("system"), F.concat(F.lit("p"), (F.col("l_suppkey") % 4).cast("string")).alias("perturbation"), F.col("l_extendedprice").alias("original"), (F.col("l_quantity") * 1000).alias("perturbed"))
    path = _folder(spark, "contrastive")
    writers.write_json(rows, path, ["lp", "system"])
    back = readers.read_contrastive(spark, path, "perturbation string, original double, perturbed double")
    cells = contrastive.accuracy(back.withColumn("diff", F.col("original") - F.col("perturbed")), ["lp", "system", "perturbation"])
    return rounded(cells.select("lp", "system", "perturbation", "n", "accuracy", "ties", (F.col("perturbation") == "p3").alias("sparse")), "accuracy")


@query("aligned_format", "WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row, p_name FROM part) SELECT 'dev' AS split, lang, row::INTEGER AS row, CASE lang WHEN 'en' THEN p_name ELSE upper(p_name) END AS text FROM p, (SELECT unnest(['en', 'fr']) AS lang) WHERE row >= 3")
def aligned_format(spark, sf_dir):
    """A corpus of three languages read as a format; the language and the first rows are left out by pushed filters."""
    path = _folder(spark, "corpus")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.upper("p_name").alias("upper"), F.reverse("p_name").alias("reversed")).orderBy("p_partkey").coalesce(1)
    for lang, column in (("en", "p_name"), ("fr", "upper"), ("de", "reversed")):
        part.select(column).write.text(f"{path}/dev/{lang}.dev")
    aligned_source.register(spark)
    return spark.read.format("aligned_lines").load(path).filter("lang IN ('en', 'fr') AND row >= 3")

"""Readers: explicit schemas, lenient where the data are, and no order taken from files that Spark may split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.text import arm_to_label, domain_of, file_to_arm, pair_of
from loomspan.operators.annotations import error_weight, penalties, two_level_rollup


def _fields(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


POOL_ROW = "src string, mt string, ref string, score double, lp string, k int, system string, doc_id string, seg_start int, domain string, source_set string, origin string"
HELDOUT_ROW = "src string, mt string, ref string, score double, lp string, k int, system string, doc_id string, seg_start string"
ANNOTATED_ROW = "src string, mt string, ref string, score double, lp string, system string, doc_id string, seg_id string"
BLOCK = "block_id bigint, split string, url string, k int, rows array<int>"
PERTURBED_BLOCK = "id string, lang_pair string, window int, k int, split string, url string, rows array<int>, source string, source_n_tokens int, reference string, distractors array<string>, categories array<array<string>>"
CANDIDATE = "lang string, k int, pool_idx bigint, block_id bigint, kind string, category string, position int, variant int, text string"


def need(spark: SparkSession, path: str, made_by: str) -> None:
    """An error that names what makes a missing input."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p):
        raise FileNotFoundError(f"{path} is missing; {made_by} makes it")


def first_with(spark: SparkSession, candidates: list[str], inside: str = "devtest") -> str | None:
    """The first of the candidate folders (patterns too, in name order) that has a folder of that name in it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in filter(None, candidates):
        p = jvm.org.apache.hadoop.fs.Path(c)
        for found in sorted(str(x.getPath()) for x in p.getFileSystem(conf).globStatus(p) or ()):
            inner = jvm.org.apache.hadoop.fs.Path(found, inside)
            if inner.getFileSystem(conf).exists(inner):
                return found
    return None


def read_lines(spark: SparkSession, path: str, lang: str, split: str) -> DataFrame:
    """One sentence per line, ``row`` from 0 in each file; an empty file has none.

    A large file is read in blocks by many tasks: lines are numbered inside each block, and counts of lines per block,
    a small table, shift them.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", r"\r\z", "").alias("text"))
    sizes = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_file", "_block", (F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")) - 1
    numbered = lines.withColumn("_inside", inside).join(before, ["_file", "_block"])
    return numbered.select(F.lit(split).alias("split"), (F.col("_before") + F.col("_inside")).cast("int").alias("row"), "text", F.lit(lang).alias("lang"))


def aligned_lines(spark: SparkSession, files: dict[str, str], split: str, urls: str | None = None) -> DataFrame:
    """Line-aligned files of several languages, with the article of each row from a TSV's first column.

    Files of different lengths abort; with too few urls every row is an article of its own.
    """
    rows = None
    for lang, path in files.items():
        one = read_lines(spark, path, lang, split)
        rows = one if rows is None else rows.unionByName(one)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("a"), F.max("n").alias("b")).head()
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"files differ in length: {sizes['a']} and {sizes['b']} lines")
    own = F.concat_ws(":", F.lit(split), F.col("row").cast("string"))
    if urls is None:
        return rows.withColumn("url", own)
    named = read_lines(spark, urls, "", split).filter("row > 0").select((F.col("row") - F.lit(1)).alias("row"), F.split("text", "\t").getItem(0).alias("url"))
    if named.count() < sizes["a"]:
        return rows.withColumn("url", own)
    return rows.join(named, "row")


def aligned_records(rows: DataFrame, langs: list[str], n: int | None = None) -> DataFrame:
    """Sentences keyed by id in several languages: ids that all languages have, in numeric-then-text order.

    The url is the first language's, or the id where it has none. Returns ``row`` from 0, ``id``, ``url``, ``lang``, ``text``.
    """
    from loomspan.operators.prepare import complete_ids, first_ids, id_order

    known = rows.filter(F.col("lang").isin(*langs))
    kept = complete_ids(known, ["id"], "lang", len(langs))
    if n is not None:
        kept = first_ids(kept, "id", n)
    url = kept.filter(F.col("lang") == langs[0]).groupBy("id").agg(F.coalesce(F.nullif(F.max("url"), F.lit("")), F.col("id")).alias("url"))
    # numbers by thousands, other ids by their first characters: slices that follow the order, so no task sorts all ids
    number = F.when(F.col("id").rlike(r"^\d+$"), F.col("id").try_cast("bigint"))
    sliced = url.withColumns({"_kind": id_order("id")[0], "_thousand": F.floor(number / 1000), "_head": F.when(number.isNull(), F.substring("id", 1, 3))})
    part = ["_kind", "_thousand", "_head"]
    sizes = sliced.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.struct(*part).alias("_part"), (F.sum("_n").over(Window.orderBy(*part)) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(*id_order("id"))) - 1
    numbered = sliced.withColumn("_inside", inside).withColumn("_part", F.struct(*part)).join(before, "_part")
    return kept.select("id", "lang", "text").join(numbered.select("id", "url", (F.col("_before") + F.col("_inside")).alias("row")), "id")


def load_aligned(spark: SparkSession, kind: str, **options) -> DataFrame:
    """``records`` (a table keyed by id) or ``lines`` (one file per language)."""
    if kind == "records":
        return aligned_records(**options)
    if kind == "lines":
        return aligned_lines(spark, **options)
    raise ValueError(f"no such kind of corpus: {kind}")


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """JSON lines, or a JSON document or array with ``multiline``; other fields are ignored."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_contrastive(spark: SparkSession, path: str, schema: str, by: tuple[str, ...] = ("lp", "system")) -> DataFrame:
    """Contrastive sets, a folder of JSON lines for each pair and system (``lp=../system=..``); the folders' names are columns, as text."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    folder = F.col("_metadata.file_path")
    return rows.withColumns({c: F.url_decode(F.regexp_extract(folder, rf"/{c}=([^/]*)/", 1)) for c in by})


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lines under a header, quotes meaning nothing; header names are stripped.

    An empty field is an empty text; one that a short line lacks is null. The files of a folder have one header each, the same.
    """
    lines = spark.read.text(path)
    header = lines.first()
    names = [c.strip() for c in header[0].split("\t")] if header else []
    fields = F.split("value", "\t", -1)
    rows = lines.filter(F.col("value") != header[0]) if header else lines
    return rows.select(*[F.get(fields, i).alias(c) for i, c in enumerate(names)])


def read_ratings(spark: SparkSession, path: str, score: str = "score") -> DataFrame:
    """A TSV of ratings; rows whose score is no number are skipped."""
    return read_tsv(spark, path).withColumn(score, F.col(score).try_cast("double")).na.drop(subset=[score])


#: Fields without which a line of an error-level file is passed over.
ERROR_FIELDS = ("system", "doc", "seg", "rater", "source", "target", "category", "severity")


def read_errors(spark: SparkSession, path: str, canary: str = "CANARY") -> DataFrame:
    """Error-level TSV in the order of its lines (``line``): docSegId is taken for ``seg`` where there is one, else seg_id.

    Rows whose source has the canary mark go, and lines too short for a field that the header has. Full lines with empty fields stay.
    """
    raw = read_tsv(spark, path).withColumn("line", F.monotonically_increasing_id())
    seg = next(c for c in ("docSegId", "seg_id") if c in raw.columns)
    rows = raw.select(*[c for c in raw.columns if c not in ("docSegId", "seg_id")], F.col(seg).alias("seg"))
    rows = rows.na.drop(subset=[c for c in ERROR_FIELDS if c in rows.columns])
    return rows.filter(~F.col("source").contains(canary)) if canary else rows


#: Error rows that a task takes, about: it sorts them, so this bounds its memory whatever the size of the file.
SEGMENT_ROWS = 500_000


def error_segments(errors: DataFrame) -> DataFrame:
    """system, doc, seg, source, target, score of error rows: the first texts of a segment, penalties summed by rater, averaged and negated.

    Rows are counted and then dealt once by segment, to as many tasks as that takes; no task's share grows with the file.
    """
    keys = ["system", "doc", "seg"]
    weighed = errors.na.drop(subset=keys).select(*keys, "rater", F.struct("line", "source", "target").alias("_first"), error_weight(F.col("severity"), F.col("category")).alias("weight"))
    dealt = weighed.repartition(1 + errors.count() // SEGMENT_ROWS, *keys)
    segments = two_level_rollup(dealt, keys, "rater", "weight", first="_first")
    return segments.select(*keys, "_first.source", "_first.target", "score")


DOCUMENT_SCORES = "doc_id string, src_text string, ref_text string, tgt_text map<string,string>, scores map<string,array<struct<score:string>>>"


def document_scores(docs: DataFrame) -> DataFrame:
    """One row per document and system from nested scores; systems named ref*, documents without reference and empty lists go."""
    flat = docs.filter(F.length(F.trim("ref_text")) > 0).select("doc_id", F.col("src_text").alias("src"), F.col("ref_text").alias("ref"), "tgt_text", F.explode("scores").alias("system", "_s"))
    numbers = F.filter(F.transform("_s", lambda x: x["score"].try_cast("double")), lambda v: v.isNotNull())
    scored = flat.filter(~F.col("system").startswith("ref")).withColumn("_n", numbers).filter(F.size("_n") > 0)
    mean = F.aggregate("_n", F.lit(0.0), lambda a, v: a + v) / F.size("_n")
    return scored.select("doc_id", "system", "src", F.col("tgt_text")[F.col("system")].alias("mt"), "ref", mean.alias("score"), pair_of(F.col("doc_id")).alias("lp"), domain_of(F.col("doc_id")).alias("domain"))


ANNOTATIONS = "DOC_ID string, SEG_ID string, MT_Engine string, Annotator_ID string, source string, target string, target_errors array<struct<severity:string>>"


def read_annotations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON arrays of annotated segments; broken files are skipped, a missing system is the file's stem."""
    raw = spark.read.schema(ANNOTATIONS).option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(paths)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return raw.select(F.coalesce("MT_Engine", stem).alias("system"), F.col("DOC_ID").alias("doc_id"), F.col("SEG_ID").alias("seg_id"), F.coalesce("Annotator_ID", F.lit("")).alias("annotator"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target", F.lit("")).alias("target"), penalties(F.col("target_errors")).alias("penalty"))


def system_files(paths: list[str]) -> list[str]:
    """Files of systems: no references, no hidden files."""
    return sorted(p for p in paths if not p.rsplit("/", 1)[-1].startswith((".", "reference")))


def reference_by_line(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Segment n of a document has the document's n-th reference line, counted from 1."""
    numbered = refs.withColumn("seg_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).cast("string")).select("doc_id", "seg_id", "ref")
    return rows.join(numbered, ["doc_id", "seg_id"], "left")


def reference_by_source(rows: DataFrame, refs: DataFrame, order: str) -> DataFrame:
    """The last reference given for the normalised source text."""
    from loomspan.functions.text import strip_markup

    last = refs.groupBy(strip_markup(F.col("src")).alias("_key")).agg(F.max_by("ref", order).alias("ref"))
    return rows.withColumn("_key", strip_markup(F.col("src"))).join(last, "_key", "left").drop("_key")


def split_map(table: DataFrame) -> DataFrame:
    """{lp: {split: [doc]}} as rows (lp, split, doc_id)."""
    return table.select(F.explode("value").alias("lp", "_m")).select("lp", F.explode("_m").alias("split", "_d")).select("lp", "split", F.explode("_d").alias("doc_id"))


def read_csv(spark: SparkSession, paths, schema: str = POOL_ROW, strict: bool = False) -> DataFrame:
    """CSV whose texts may hold newlines and quotes, with ``file`` the name without _val.csv."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(paths)
    return rows.withColumn("file", F.regexp_replace(F.col("_metadata.file_name"), r"(_val)?\.csv$", ""))


def eval_portion(rows: DataFrame, name: str) -> DataFrame:
    """A foreign CSV as pool rows: required columns must exist, others get defaults, a k that is no number is 0."""
    missing = {"src", "mt", "score", "lp"} - set(rows.columns)
    if missing:
        raise ValueError(f"{name} lacks {sorted(missing)}")
    text = {c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("") for c in ("ref", "system", "doc_id", "domain")}
    k = F.coalesce(F.col("k").try_cast("int"), F.lit(0)) if "k" in rows.columns else F.lit(0)
    seg = F.coalesce(F.col("seg_start").try_cast("int"), F.lit(0)) if "seg_start" in rows.columns else F.lit(0)
    return rows.withColumns({**text, "k": k, "seg_start": seg, "score": F.col("score").try_cast("double"), "source_set": F.lit(name), "origin": F.lit("eval_portion")})


def table_counts(lines: DataFrame, categories: list[str]) -> DataFrame:
    """Counts of a Markdown table whose first cell is a known category; marks are stripped, what is no number is 0."""
    cells = F.transform(F.split(F.btrim("value", F.lit("| ")), r"\|"), lambda x: F.trim(x))
    name = F.lower(F.regexp_replace(F.get(cells, F.lit(0)), r"[*]", ""))
    n = F.coalesce(F.regexp_replace(F.get(cells, F.lit(1)), r"[,*]", "").try_cast("bigint"), F.lit(0))
    return lines.filter(F.col("value").startswith("|")).select(name.alias("category"), n.alias("n")).filter(F.col("category").isin(*categories))


def length_histogram(spark: SparkSession, path: str) -> DataFrame:
    """Rows (``set``, ``k``, ``field``, ``bin``, ``n``) of a nested JSON document of length histograms.

    set -> bins and per_k; per_k -> k -> field -> quantiles and counts per bin; what is no histogram is left aside.
    """
    text = spark.read.text(path, wholetext=True)
    sets = text.select(F.explode(F.from_json("value", "map<string,struct<bins:array<int>,per_k:map<string,map<string,string>>>>")).alias("set", "_s"))
    fields = sets.select("set", "_s.bins", F.explode("_s.per_k").alias("k", "_f")).select("set", "bins", "k", F.explode("_f").alias("field", "_v"))
    counts = fields.withColumn("_h", F.from_json("_v", "struct<hist:array<bigint>>")["hist"]).filter(F.size("_h") > 0)
    return counts.select("set", F.col("k").cast("int").alias("k"), "field", F.posexplode("_h").alias("_at", "n"), "bins").select("set", "k", "field", F.get("bins", F.col("_at")).alias("bin"), "n")


def count_rows(spark: SparkSession, path: str) -> int:
    """Logical rows of a CSV, newlines inside quotes respected."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).count()


def checkpoints(spark: SparkSession, path: str, contains: str = "", newer_than: str | None = None) -> DataFrame:
    """Files of a tree with their modification times and the metric in their names; newest and best by ``best_of``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"))
    named = files.filter(F.col("path").contains(contains)).withColumn("metric", F.regexp_extract("path", r"=(-?\d+(?:\.\d+)?)\.ckpt$", 1).try_cast("double"))
    return named.filter(F.col("modified") > newer_than) if newer_than else named


def checkpoint_lines(files: DataFrame, best: bool = True) -> DataFrame:
    """One ``line`` label=path per run (the folder above the files): the best by metric, or the last written.

    The label is the arm's where the folder's name is one, else the name itself. Files without a metric are no candidates for best.
    """
    named = files.withColumn("run", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    chosen = named.filter("metric IS NOT NULL") if best else named
    last = chosen.groupBy("run").agg(F.max_by("path", F.struct("metric", "path") if best else F.struct("modified", "path")).alias("path"))
    arm = file_to_arm(F.col("run"))
    label = F.coalesce(F.when(F.col("run").rlike(r"^(kiwi-)?mix-."), arm_to_label(arm["family"], arm["mix"], arm["frozen"])), F.col("run"))
    return last.select("run", F.concat(label, F.lit("="), "path").alias("line"))

"""Chat formatting: nested field paths are fingerprinted, a declarative mapping makes turns, a template makes text.

One registry of layouts serves tables of any of them (:func:`turn_rows`, :func:`format_rows`) and columns of JSON (:func:`canonical_turns`).

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Turn marks of the template and control strings of common chat templates, none of which may occur inside a text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPES = {"<": "&lt;", "[": "&lb;"}
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def escape(text):
    """Reversible: & first, then the first character of every control string. No control string is left."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(_ESCAPES[c[0]] + c[1:]))
    return out


def unescape(text):
    """The inverse of :func:`escape` and :func:`escape_role`."""
    out = F.replace(text, F.lit("&nl;"), F.lit("\n"))
    for char, name in _ESCAPES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def escape_role(role):
    """As :func:`escape`; a newline would end the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


# --- layouts ---------------------------------------------------------------------------------------------------


def shape_of(schema: T.DataType) -> str:
    """All nested field paths of a schema, whatever their order, as one text; types of leaves do not count."""
    if isinstance(schema, T.StructType):
        return "OBJECT<" + ", ".join(f"{_quoted(f.name)}: {shape_of(f.dataType)}" for f in sorted(schema.fields, key=lambda f: f.name)) + ">"
    if isinstance(schema, T.ArrayType):
        return f"ARRAY<{shape_of(schema.elementType)}>"
    return "VARIANT" if isinstance(schema, (T.MapType, T.VariantType)) else "*"


def _quoted(name: str) -> str:
    return name if name.isascii() and name.replace("_", "a").isalnum() else "`" + name.replace("`", "``") + "`"


def json_shape(payload):
    """:func:`shape_of` the JSON in a column, to any depth; null if it is broken.

    Fields of all elements of an array count. A string is a leaf, whatever it holds; what is a leaf in one element and none in another
    is of a kind of its own, which no layout has.
    """
    schema = F.schema_of_variant(F.try_parse_json(payload))
    return F.regexp_replace(schema, r"(: |ARRAY<)(?!OBJECT<|ARRAY<|VARIANT)[A-Z][A-Z_ ]*(?:\([0-9, ]+\))?(?=[,>])", "$1*")


def fingerprint(shape: str) -> str:
    import hashlib

    return hashlib.sha256(shape.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """How one layout becomes turns: fixed (role, path) pairs that are used if not blank, a list of messages, or a turn a row.

    ``paths`` are all of its fields, arrays as []; those that no turn uses are declared there too.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None  # (array path, role field, text field)
    row: tuple[str, str, str, str] | None = None  # paths of conversation, turn, role and text

    @property
    def fingerprint(self) -> str:
        return fingerprint(shape_of(layout_schema(self)))

    @property
    def columns(self) -> list[str]:
        """The columns of a table of this layout."""
        return layout_schema(self).names

    def canonical(self, record):
        """Column of turns from a struct column of this layout."""
        if self.messages:
            array, role, text = self.messages
            return F.transform(record[array], lambda m: F.struct(_role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
        if self.row:
            return F.array(F.struct(_role(_at(record, self.row[2])).alias("role"), F.coalesce(_at(record, self.row[3]), F.lit("")).alias("text")))
        turns = F.array(*[F.struct(F.lit(role).alias("role"), _at(record, path).alias("text")) for role, path in self.turns])
        kept = F.filter(turns, lambda t: F.coalesce(F.length(t["text"]) > 0, F.lit(False)))
        return F.transform(kept, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _at(record, path: str):
    for name in path.split("."):
        record = record[name]
    return record


#: Names that data sets give to roles, and ours.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _role(role):
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(known[F.coalesce(role, F.lit(""))], role, F.lit(""))


LAYOUTS = (
    Layout("prompt", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("instruction", "input", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question", ("system_prompt", "question", "response"), (("system", "system_prompt"), ("user", "question"), ("assistant", "response"))),
    Layout("messages", ("messages[].role", "messages[].content"), messages=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value")),
    Layout("dialogue", ("data.prompt", "data.answer"), (("user", "data.prompt"), ("assistant", "data.answer"))),
    Layout("rows", ("conv_id", "turn", "role", "text"), row=("conv_id", "turn", "role", "text")),
)


def layout_schema(layout: Layout) -> T.StructType:
    """A schema of strings with the layout's paths."""

    def put(tree: dict, path: str) -> None:
        head, _, rest = path.partition(".")
        put(tree.setdefault(head, {}), rest) if rest else tree.setdefault(head, {})

    def made(tree: dict) -> T.DataType:
        if not tree:
            return T.StringType()
        return T.StructType([T.StructField(k.removesuffix("[]"), T.ArrayType(made(v)) if k.endswith("[]") else made(v)) for k, v in tree.items()])

    tree: dict = {}
    for p in layout.paths:
        put(tree, p)
    return made(tree)


def canonical_turns(records: DataFrame, json_col: str, layouts=LAYOUTS) -> DataFrame:
    """Adds ``layout`` (name; null where no mapping has the fingerprint) and ``turns`` to rows of JSON objects.

    The hash of a row's field paths selects the mapping. Rows of unknown layouts, nulls and broken JSON keep a
    null layout and null turns; no row is lost.
    """
    marked = records.withColumn("fingerprint", F.substring(F.sha2(json_shape(F.col(f"`{json_col}`")), 256), 1, 16))
    name = F.lit(None).cast("string")
    turns = F.lit(None).cast(TURNS)
    for x in layouts:
        hit = F.col("fingerprint") == x.fingerprint
        name = F.when(hit, F.lit(x.name)).otherwise(name)
        turns = F.when(hit, x.canonical(F.from_json(F.col(f"`{json_col}`"), layout_schema(x))).cast(TURNS)).otherwise(turns)
    return marked.withColumns({"layout": name, "turns": turns})


def table_layout(schema: T.StructType, layouts=LAYOUTS) -> Layout:
    """The layout that has the fingerprint of a table's schema, or else that of the columns of it that the layout names.

    So columns that belong to no layout are left aside, but fields inside a layout's columns must all be declared. Of several layouts
    the one with the most fields is taken; a table that has none is an error that shows its fields.
    """
    whole = fingerprint(shape_of(schema))

    def fits(x: Layout) -> bool:
        own = [f for f in schema.fields if f.name in x.columns]
        return x.fingerprint in (whole, fingerprint(shape_of(T.StructType(own))))

    found = max((x for x in layouts if fits(x)), key=lambda x: len(x.paths), default=None)
    if found is None:
        raise ValueError(f"no layout has the fingerprint {whole} of {shape_of(schema)}")
    return found


def turn_rows(rows: DataFrame, layouts=LAYOUTS, conversation: str = "conv_id") -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` of a table of any layout.

    Tables with a row for each conversation have its id in the column ``conversation``; rows of it that have none are numbered, by
    negative numbers from -1000 on. Conversations without any turn have no row.
    """
    layout = table_layout(rows.schema, layouts)
    names = ("conv_id", "turn", "role", "text")
    if layout.row:
        return rows.select(*[F.col(".".join(f"`{x}`" for x in p.split("."))).alias(n) for p, n in zip(layout.row, names, strict=True)])
    number = F.lit(-1000) - F.monotonically_increasing_id()
    of = F.coalesce(F.col(f"`{conversation}`"), number) if conversation in rows.columns else number
    whole = F.struct(*[F.col(f"`{c}`") for c in layout.columns])
    turns = rows.select(of.alias("conv_id"), layout.canonical(whole).cast(TURNS).alias("_turns"))
    return turns.select("conv_id", F.posexplode("_turns").alias("turn", "_t")).select("conv_id", "turn", "_t.role", "_t.text")


def json_turn_rows(records: DataFrame, json_col: str, layouts=LAYOUTS, conversation: str = "conv_id", unknown: str = "error") -> DataFrame:
    """As :func:`turn_rows`, of a column of JSON objects that may each have another layout.

    Rows that no layout has the fingerprint of stop the query with their fields, or are left out with ``unknown="skip"``.
    """
    known = canonical_turns(records.select(F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{json_col}`").alias("json")), "json", layouts)
    shape = F.coalesce(json_shape(F.col("json")), F.lit("no JSON"))
    stop = F.raise_error(F.concat(F.lit("no layout has the fingerprint of "), shape)).cast(TURNS)
    turns = F.when(F.col("layout").isNotNull(), F.col("turns")).otherwise(stop if unknown == "error" else F.lit(None).cast(TURNS))
    return known.select("conv_id", F.posexplode(turns).alias("turn", "_t")).select("conv_id", "turn", "_t.role", "_t.text")


# --- template --------------------------------------------------------------------------------------------------


def format_rows(rows: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """Formats conversations of any layout; the fingerprint of the table's schema finds the mapping (:func:`table_layout`).

    Returns ``conv_id``, ``formatted`` and ``loss_spans``: for every turn of the role to learn from, the code
    points (``start``, ``length``) of its escaped text in ``formatted``, the turn's number and where it begins.
    A null text or role is empty; turns are ordered by turn, then role, then text, null turns first; repeated rows
    stay repeated turns. Rows with a null conv_id form one conversation. Other columns are left aside. Text offsets
    come from a running sum over rows, so that the longest conversation costs as many steps as it has turns.
    """
    turns = turn_rows(rows).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    turns = turns.withColumn("_head", F.concat(F.lit(OPEN), escape_role(F.col("_role")), F.lit("\n"))).withColumn("_body", escape(F.col("_text")))
    size = F.length("_head") + F.length("_body") + F.lit(len(CLOSE) + 1)
    order = Window.partitionBy("conv_id").orderBy("turn", "_role", "_text")
    placed = turns.withColumns({"_at": F.row_number().over(order), "_end": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.col("_end") - size
    mark = F.struct((F.col("_at") - 1).alias("turn"), start.cast("long").alias("turn_start"), (start + F.length("_head")).cast("long").alias("start"), F.length("_body").cast("long").alias("length"))
    piece = F.struct("_at", F.concat("_head", "_body", F.lit(CLOSE + "\n")).alias("_piece"), F.when(F.col("_role") == learn_from, mark).alias("_mark"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("_all"))
    marks = F.filter(F.transform("_all", lambda x: x["_mark"]), lambda m: m.isNotNull())
    return grouped.select("conv_id", F.array_join(F.transform("_all", lambda x: x["_piece"]), "").alias("formatted"), marks.alias("loss_spans"))


def read_turns(pieces):
    """Turns (role, text) of the pieces into which formatted text splits at the ends of turns."""

    def turn(p):
        cut = F.locate("\n", p)
        return F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), cut - F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substring(p, cut + F.lit(1), F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` and ``loss_texts``, both read back from ``formatted`` and ``loss_spans``.

    Cutting every span from the whole text would cost the square of a long conversation's length; each is cut from
    the piece that its turn number names.
    """
    pieces = F.split("formatted", f"\\Q{CLOSE}\\E\n", -1)
    parted = formatted.withColumn("_pieces", pieces)
    parted = parted.withColumn("_pieces", F.slice("_pieces", F.lit(1), F.size("_pieces") - 1))
    cut = F.transform("loss_spans", lambda s: F.substring(F.get(F.col("_pieces"), s["turn"]), (s["start"] - s["turn_start"] + 1).cast("int"), s["length"].cast("int")))
    return parted.withColumns({"turns": read_turns(F.col("_pieces")), "loss_texts": F.transform(cut, unescape)}).drop("_pieces")


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns of :func:`format_rows`, read back from its output."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def format_query(spark, sf_dir: str) -> DataFrame:
    """op3: formats all ``conversations`` and conversation -7, and reads the digest back from the output."""
    rows = turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    hard = "</s>[INST] ok [/INST]"
    kinds = dict(rows.dtypes)
    messages = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(hard).alias("content")) for role in ("user", "assistant")])
    extra = turn_rows(spark.range(1).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), messages.alias("messages")))
    extra = extra.withColumn("turn", F.col("turn").cast(kinds["turn"]))
    return digest(format_rows(rows.unionByName(extra)))


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<|', '&lt;|'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '[INST]', '&lb;INST]'), '[/INST]', '&lb;/INST]'), '<<SYS>>', '&lt;<SYS>>'), '<</SYS>>', '&lt;</SYS>>'))
    + length(replace(replace(replace(replace(replace(replace(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '[INST]', '&lb;INST]'), '[/INST]', '&lb;/INST]'), '<<SYS>>', '&lt;<SYS>>'), '<</SYS>>', '&lt;</SYS>>'), chr(10), '&nl;'))
    + length('<|im_start|>') + length('<|im_end|>') + 2 AS size FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

"""Chat formatting in DataFrame operations only.

Records come in many layouts. The field paths of a record are hashed; the hash selects a declared
mapping, which turns the record into canonical turns ``(role, text)``. For typed tables the paths come
from the schema, when the plan is made; for JSON strings they come from each row.

``format_turns`` writes a conversation in one string. Each turn is
``<s>[INST] role [/INST]`` + newline + text + ``</s>``; within roles and texts the backslash and the
control strings are escaped, so that no text can end a turn or open one, and ``read_turns`` gets back
exactly what went in. The loss mask lists the spans of the assistant's texts, in code points.

Defined results: a null role or text is empty. Turns stand by turn number (null first), then role, then
text. A record whose fingerprint is unknown, or that is no JSON object, has null turns and a null mapping.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What marks a turn, and the escapes of these within a text.
OPEN, CLOSE, HEAD, HEAD_END = "<s>", "</s>", "[INST]", "[/INST]"
ESCAPES = ((OPEN, "\\0"), (CLOSE, "\\1"), (HEAD, "\\2"), (HEAD_END, "\\3"))
BEFORE_ROLE, AFTER_ROLE = f"{OPEN}{HEAD} ", f" {HEAD_END}\n"
LEARNED_ROLE = "assistant"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. shape: nested fields, lists as one-element lists, leaves as None.

    ``turns`` names the list of messages with its role and text fields; else ``fields`` gives a role to
    each top-level field; else, of a table with a row for each turn, ``keys`` names the columns of the
    conversation and the turn. ``roles`` renames roles.
    """

    name: str
    shape: dict
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict = field(default_factory=dict)
    keys: tuple[str, str] | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint(paths(self.shape))


def paths(shape, at: str = "") -> list[str]:
    """Nested field paths; ``[]`` stands for the items of a list."""
    if isinstance(shape, dict):
        return [p for k, v in shape.items() for p in paths(v, f"{at}.{k}" if at else k)] or [f"{at}{{}}"]
    if isinstance(shape, list):
        return paths(shape[0] if shape else None, f"{at}[]")
    return [at]


def schema_shape(kind: T.DataType):
    if isinstance(kind, T.StructType):
        return {f.name: schema_shape(f.dataType) for f in kind.fields}
    return [schema_shape(kind.elementType)] if isinstance(kind, T.ArrayType) else None


def fingerprint(found: list[str]) -> str:
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


#: Of tables with a row for each turn.
TABLE_MAPPINGS = (
    Mapping("turn rows", {"conv_id": None, "turn": None, "role": None, "text": None}, text="text", keys=("conv_id", "turn")),
    Mapping("from and value rows", {"conv_id": None, "turn": None, "from": None, "value": None}, role="from", text="value", keys=("conv_id", "turn"), roles={"human": "user", "gpt": "assistant"}),
)
MAPPINGS = (
    Mapping("messages", {"messages": [{"content": None, "role": None}]}, turns="messages"),
    Mapping("conversations", {"conversations": [{"from": None, "value": None}]}, turns="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt", {"completion": None, "prompt": None}, fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("prompt and response", {"prompt": None, "response": None}, fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping("instruction", {"instruction": None, "output": None}, fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction with input", {"input": None, "instruction": None, "output": None}, fields=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("system prompt", {"prompt": None, "response": None, "system": None}, fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("question", {"answer": None, "question": None}, fields=(("question", "user"), ("answer", "assistant"))),
)


def json_fingerprint(record: Column) -> Column:
    """Of each JSON record. A record's schema string is cut at its brackets; a field's path is the fields left open before it."""
    schema = F.schema_of_variant(record)
    tokens = F.regexp_extract_all(schema, F.lit(r"((?:`(?:[^`]|``)*`|[^<>:, `]+): |OBJECT<|ARRAY<|>|[A-Z]+(?:\([0-9, ]+\))?)"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("found"), F.lit("").alias("name"))

    def step(a: Column, t: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(t, ": $", ""), "^`|`$", "")
        top = F.coalesce(F.try_element_at(a["open"], F.lit(-1)), F.lit(""))
        here = F.when(a["name"] == "", top).when(top == "", a["name"]).otherwise(F.concat(top, F.lit("."), a["name"]))
        is_field, is_object, is_list, is_end = t.endswith(": "), t == "OBJECT<", t == "ARRAY<", t == ">"
        opened = F.when(is_list, F.concat(here, F.lit("[]"))).otherwise(here)
        stack = F.when(is_object | is_list, F.concat(a["open"], F.array(opened))).when(is_end, F.slice(a["open"], F.lit(1), F.greatest(F.size(a["open"]) - 1, F.lit(0)))).otherwise(a["open"])
        leaf = ~(is_field | is_object | is_list | is_end)
        return F.struct(stack.alias("open"), F.when(leaf, F.concat(a["found"], F.array(here))).otherwise(a["found"]).alias("found"), F.when(is_field, name).otherwise(F.lit("")).alias("name"))

    found = F.aggregate(tokens, start, step, lambda a: a["found"])
    return F.md5(F.array_join(F.array_sort(found), "\n").cast("binary"))


def _renamed(role: Column, m: Mapping) -> Column:
    return F.coalesce(*[F.when(role == a, F.lit(b)) for a, b in m.roles.items()], role)


def turn_rows(df: DataFrame, mappings: tuple[Mapping, ...] = TABLE_MAPPINGS) -> DataFrame:
    """``conv_id, turn, role, text`` by the mapping that the fingerprint of the table's schema selects."""
    m = {m.fingerprint: m for m in mappings}.get(fingerprint(paths(schema_shape(df.schema))))
    if m is None:
        raise ValueError("no mapping for these fields")
    conv, turn = m.keys
    return df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), _renamed(F.col(m.role), m).alias("role"), F.col(m.text).alias("text"))


def _made(record: Column, m: Mapping) -> Column:
    """The turns of a record in the layout of m."""
    if not m.turns:
        return F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.try_variant_get(record, f"$.{f}", "string"), F.lit("")).alias("text")) for f, r in m.fields])

    def turn(i: Column) -> Column:
        return F.struct(F.coalesce(_renamed(i[m.role], m), F.lit("")).alias("role"), F.coalesce(i[m.text], F.lit("")).alias("text"))

    return F.transform(F.try_variant_get(record, f"$.{m.turns}", f"array<struct<`{m.role}`:string,`{m.text}`:string>>"), turn)


def canonical_turns(df: DataFrame, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds ``mapping`` and ``turns``, an array of (role, text), to records in JSON strings."""
    v = F.col("_record")
    x = df.withColumn("_record", F.try_parse_json(F.col(json_col))).withColumn("_print", json_fingerprint(v))
    turns, name = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit(None).cast("string")
    for m in mappings:
        is_it = F.col("_print") == m.fingerprint
        made = _made(v, m)
        turns, name = F.when(is_it, made).otherwise(turns), F.when(is_it, F.lit(m.name)).otherwise(name)
    return x.withColumns({"mapping": name, "turns": turns}).drop("_record", "_print")


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for plain, code in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """The pieces between doubled backslashes hold only whole escapes."""

    def piece(p: Column) -> Column:
        for plain, code in ESCAPES:
            p = F.replace(p, F.lit(code), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, formatted, loss_spans`` from a table of turn rows.

    A span has its turn (from 0), its place within that turn's string, its place in the whole string,
    and its length.
    """
    x = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    one = F.struct("turn", "role", "text")
    x = x.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    head = lambda t: F.concat(F.lit(BEFORE_ROLE), escape(t["role"]), F.lit(AFTER_ROLE))
    x = x.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("p"))
    sizes = F.transform("p", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE))
    x = x.withColumn("formatted", F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")).withColumn("sizes", sizes)
    # a running sum of the sizes, as pairs of turn and start
    rows = x.select("conv_id", "formatted", F.posexplode(F.arrays_zip("p", "sizes")).alias("turn", "z"))
    start = F.coalesce(F.sum(F.col("z.sizes").cast("long")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.select("conv_id", "turn", "z", start.alias("at"))
    span = F.struct("turn", F.length("z.p.head").alias("offset"), (F.col("at") + F.length("z.p.head")).alias("start"), F.length("z.p.body").alias("length"))
    spans = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("z.p.role") == LEARNED_ROLE, span))).alias("loss_spans"))
    return x.select("conv_id", "formatted").withColumnRenamed("conv_id", "_c").join(spans, F.col("_c").eqNullSafe(F.col("conv_id"))).select("conv_id", "formatted", "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: an array of (role, text)."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        halves = F.split(p, r" \[/INST\]\n", 2)
        return F.struct(unescape(F.substr(halves[0], F.lit(len(BEFORE_ROLE) + 1))).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped, in order. A span is cut from its own turn, so the cost stays linear."""
    pieces = F.split(formatted, CLOSE)
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(F.element_at(pieces, s["turn"] + 1), s["offset"] + 1, s["length"]))), "")


def digest(formatted: DataFrame) -> DataFrame:
    x = formatted.withColumns({"turns": read_turns(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

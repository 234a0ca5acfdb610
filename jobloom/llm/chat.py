"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a VARIANT, or a row of a typed table. Its nested field paths, without types, are hashed; the hash selects
a declarative mapping that turns the record's layout into canonical turns (conversation, position, role, text).
Turns are rendered as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

with an escape that can be undone: inside texts `<`, any number of `%`, `|` gets one more `%`, so no text can hold
a control string; in roles `%`, line feed and `<` are percent-encoded. loss_spans marks the assistant texts.

A conversation is rendered in blocks of BLOCK turn numbers first and then joined, so that a hot conversation is
sorted and concatenated piece by piece before its blocks meet; what remains is the string that is asked for, one
row in one task, which Spark bounds by 2 GB. Formatting and reading back take time in proportion to turns and text.

Defined results: null role and text count as empty; equal turn numbers are ordered by role and text, a null turn
comes first; a null conversation id is a conversation of its own; repeated rows are repeated turns; a record of
unknown layout appears in unmapped() and nowhere else; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 64
START, END = "<|im_start|>", "<|im_end|>"


def shape(example) -> str:
    """The path notation of a record given by example: objects in {}, arrays in [], fields sorted, no types."""
    if isinstance(example, dict):
        inner = [f"{k}: {v}" if (v := shape(example[k])) else k for k in sorted(example)]
        return "{" + ", ".join(inner) + ">"
    if isinstance(example, list):
        return "[" + (shape(example[0]) if example else "") + ">"
    return ""


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: from an array at `turns` with paths inside, or from fixed (role, path) pairs."""

    name: str
    examples: tuple
    turns: str | None = None
    role: str = ""
    text: str = ""
    pairs: tuple[tuple[str, str], ...] = ()
    row: tuple[str, str, str] | None = None  # paths of position, role and text where a record is one turn
    aliases: dict = field(default_factory=dict)

    @property
    def fingerprints(self) -> list[str]:
        return [hashlib.sha256(shape(e).encode()).hexdigest() for e in self.examples]


_HUMAN = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}
MAPPINGS = (
    Mapping("turn_rows", ({"conv_id": 0, "turn": 0, "role": "", "text": ""},), row=("$.turn", "$.role", "$.text")),
    Mapping("nested_rows", ({"conv_id": 0, "index": 0, "message": {"role": "", "content": ""}},), row=("$.index", "$.message.role", "$.message.content")),
    Mapping("speaker_rows", ({"conv_id": 0, "position": 0, "speaker": "", "utterance": ""},), row=("$.position", "$.speaker", "$.utterance")),
    Mapping("event_rows", ({"conv_id": 0, "event": {"n": 0, "from": "", "body": {"value": ""}}},), row=("$.event.n", "$.event.from", "$.event.body.value")),
    Mapping("messages", ({"messages": [{"role": "", "content": ""}]}, {"messages": []}), "$.messages", "$.role", "$.content"),
    Mapping("shared", ({"conversations": [{"from": "", "value": ""}]}, {"conversations": []}), "$.conversations", "$.from", "$.value", aliases=_HUMAN),
    Mapping("dialog", ({"dialog": {"turns": [{"speaker": "", "text": ""}]}},), "$.dialog.turns", "$.speaker", "$.text", aliases=_HUMAN),
    Mapping("instruction", ({"instruction": "", "input": "", "output": ""},), pairs=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping("instruction_only", ({"instruction": "", "output": ""},), pairs=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("prompt", ({"prompt": "", "completion": ""},), pairs=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("nested_prompt", ({"data": {"prompt": "", "response": ""}},), pairs=(("user", "$.data.prompt"), ("assistant", "$.data.response"))),
    Mapping("question", ({"question": "", "answer": ""},), pairs=(("user", "$.question"), ("assistant", "$.answer"))),
)


def fingerprint(record: Column) -> Column:
    """SHA-256 of the nested field paths of a VARIANT."""
    paths = F.regexp_replace(F.schema_of_variant(record), "OBJECT<", "{")
    paths = F.regexp_replace(paths, "ARRAY<", "[")
    paths = F.regexp_replace(paths, r"(^|: |\[)(?:[A-Z_]+(?:\([0-9,]+\))?)(?=[,>]|$)", "$1")
    return F.sha2(F.regexp_replace(paths, r": (?=[,>])", ""), 256)


def _get(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def _renamed(role: Column, aliases: dict) -> Column:
    out = role
    for old, new in aliases.items():
        out = F.when(F.lower(role) == old, F.lit(new)).otherwise(out)
    return out


def _turns(m: Mapping, record: Column) -> Column:
    """array<struct<pos long, role string, text string>> of a record in layout m."""
    if m.row:
        return F.array(F.struct(F.try_variant_get(record, m.row[0], "bigint").alias("pos"), _get(record, m.row[1]).alias("role"), _get(record, m.row[2]).alias("text")))
    if m.turns:
        items = F.coalesce(F.try_variant_get(record, m.turns, "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(items, lambda x, i: F.struct(i.cast("long").alias("pos"), _renamed(_get(x, m.role), m.aliases).alias("role"), _get(x, m.text).alias("text")))
    # an optional part that is empty makes no turn, unless it is the reply
    every = F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), F.lit(role).alias("role"), _get(record, path).alias("text")) for i, (role, path) in enumerate(m.pairs)])
    return F.filter(every, lambda t: (t["text"] != "") | (t["role"] == "assistant"))


def canonical_turns(records: DataFrame, conv: str = "conv_id", record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """Rows conv_id, turn, role, text of all records with a known layout."""
    marked = records.select(F.col(conv).alias("conv_id"), F.col(record).alias("record"), fingerprint(F.col(record)).alias("fp"))
    chosen = F.lit(None).cast("array<struct<pos:bigint,role:string,text:string>>")
    for m in mappings:
        chosen = F.when(F.col("fp").isin(m.fingerprints), _turns(m, F.col("record"))).otherwise(chosen)
    return marked.select("conv_id", F.explode(chosen).alias("t")).select("conv_id", F.col("t.pos").alias("turn"), "t.role", "t.text")


def unmapped(records: DataFrame, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """Records whose layout no mapping knows, with their fingerprint."""
    known = [x for m in mappings for x in m.fingerprints]
    fp = fingerprint(F.col(record))
    return records.withColumn("fingerprint", fp).where(~F.coalesce(F.col("fingerprint").isin(known), F.lit(False)))


def escape_text(c) -> Column:
    return F.regexp_replace(c, r"<(%*)\|", "<%$1|")


def unescape_text(c) -> Column:
    return F.regexp_replace(c, r"<%(%*)\|", "<$1|")


def escape_role(c) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(c) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (1-based start and length in code points).

    Places are running sums over the rows of a block and over the blocks of a conversation, so the work grows with the turns.
    """
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape_text(F.coalesce("text", F.lit("")))
    row = turns.select("conv_id", F.floor(F.col("turn") / BLOCK).cast("long").alias("block"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("raw"), F.concat(head, body, F.lit(END + "\n")).alias("piece"), F.char_length(head).cast("long").alias("skip"), F.char_length(body).cast("long").alias("size"))
    long = F.col("skip") + F.col("size") + F.lit(len(END) + 1)
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "raw")
    row = row.withColumn("place", F.row_number().over(order)).withColumn("ends", F.sum(long).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("ends") - F.col("size") - F.lit(len(END) + 1)).alias("at"), F.col("size").alias("length")))
    blocks = row.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("p"), F.sort_array(F.collect_list(span)).alias("spans"), F.max("ends").alias("chars"))
    before = F.coalesce(F.sum("chars").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).select("conv_id", "block", F.array_join(F.col("p.piece"), "").alias("text"), F.transform("spans", lambda s: F.struct((s["at"] + F.col("before") + 1).alias("start"), s["length"].alias("length"))).alias("spans"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "text", "spans"))).alias("b"))
    return whole.select("conv_id", F.array_join(F.col("b.text"), "").alias("formatted"), F.flatten(F.col("b.spans")).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations again: adds turns array<struct<role, text>> and loss_text (unescaped text under the mask).

    One walk over the turns and one over the mask show whether the mask's spans are the places of the assistant texts, one after the
    other, by a 64-bit hash chained over both; then those are the text under it. Any other mask is cut out span by span.
    """
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    at = lambda p: F.locate("\n", p)
    size = lambda p: F.char_length(p) - at(p) - F.lit(len(END) + 1)
    raw = F.transform(pieces, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), F.substring(p, at(p) + 1, size(p)).alias("text")))
    # an aggregate copies what it carries at each step, so it carries numbers only: the chained hash of the spans
    start = F.struct(F.lit(1).cast("long").alias("place"), F.lit(0).cast("long").alias("chain"))

    def step(acc, t):
        text_at, chars = acc["place"] + len(START) + F.char_length(t["role"]) + 1, F.char_length(t["text"]).cast("long")
        chain = F.when(t["role"] == "assistant", F.xxhash64(acc["chain"], text_at, chars)).otherwise(acc["chain"])
        return F.struct((text_at + chars + F.lit(len(END) + 1)).alias("place"), chain.alias("chain"))

    of_mask = F.aggregate("loss_spans", F.lit(0).cast("long"), lambda acc, s: F.xxhash64(acc, s["start"].cast("long"), s["length"].cast("long")))
    met = F.aggregate("raw", start, step, lambda acc: acc["chain"]) == of_mask
    learned = F.array_join(F.transform(F.filter("raw", lambda t: t["role"] == "assistant"), lambda t: unescape_text(t["text"])), "")
    cut = F.array_join(F.transform("loss_spans", lambda s: unescape_text(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))), "")
    turns = F.transform("raw", lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape_text(t["text"]).alias("text")))
    back = formatted.withColumn("raw", raw).withColumn("met", met)
    return back.withColumn("turns", turns).withColumn("loss_text", F.when(F.col("met"), learned).otherwise(cut)).drop("raw", "met")


def digest(formatted: DataFrame) -> DataFrame:
    """The facts of each conversation, taken from the formatted output."""
    back = read_back(formatted)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def schema_shape(kind: T.DataType) -> str:
    """The path notation of a typed column, as shape() gives it for a record."""
    if isinstance(kind, T.StructType):
        inner = sorted((f.name, schema_shape(f.dataType)) for f in kind.fields)
        return "{" + ", ".join(f"{name}: {rest}" if rest else name for name, rest in inner) + ">"
    if isinstance(kind, T.ArrayType):
        return "[" + schema_shape(kind.elementType) + ">"
    return ""


def _typed(row: str, path: str) -> Column:
    return F.col(f"{row}.`" + path.removeprefix("$.").replace(".", "`.`") + "`")


def canonical_rows(table: DataFrame, conv: str = "conv_id", mappings=MAPPINGS) -> DataFrame:
    """Rows conv_id, turn, role, text of a typed table, whose schema is its records' one layout.

    The schema is fingerprinted like a record and selects the mapping, so no record is made a VARIANT and texts
    may be as long as a string can be. An unknown layout is an error.
    """
    fp = hashlib.sha256(schema_shape(table.schema).encode()).hexdigest()
    m = next((m for m in mappings if fp in m.fingerprints), None)
    if m is None:
        raise ValueError(f"no mapping for {schema_shape(table.schema)}")
    own = table.select(F.col(conv).cast("long").alias("conv_id"), F.struct("*").alias("r"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if m.row:
        return own.select("conv_id", _typed("r", m.row[0]).cast("long").alias("turn"), text(_typed("r", m.row[1])).alias("role"), text(_typed("r", m.row[2])).alias("text"))
    if m.turns:
        items = F.transform(_typed("r", m.turns), lambda x, i: F.struct(i.cast("long").alias("pos"), _renamed(text(x[m.role.removeprefix("$.")]), m.aliases).alias("role"), text(x[m.text.removeprefix("$.")]).alias("text")))
    else:
        items = F.filter(F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), F.lit(role).alias("role"), text(_typed("r", path)).alias("text")) for i, (role, path) in enumerate(m.pairs)]), lambda t: (t["text"] != "") | (t["role"] == "assistant"))
    return own.select("conv_id", F.explode(items).alias("t")).select("conv_id", F.col("t.pos").alias("turn"), "t.role", "t.text")


def canonical_tables(tables: list[DataFrame], conv: str = "conv_id", mappings=MAPPINGS) -> DataFrame:
    """Canonical rows of several typed tables, each in a layout of its own."""
    return reduce(DataFrame.unionByName, [canonical_rows(t, conv, mappings) for t in tables])


def rows_as_records(conversations: DataFrame) -> DataFrame:
    """Turn rows as VARIANT records of the layout turn_rows; other columns are left out."""
    own = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    return conversations.select(*own).select("conv_id", F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))

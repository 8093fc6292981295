"""Chat formatting: schema fingerprints select declarative mappings into canonical turns.

A record is a JSON text, or a struct made of turn rows.  Its *schema fingerprint* is the hash of its sorted
nested field paths, which ``schema_of_variant`` yields without types or values.  ``LAYOUTS`` states for each known layout its
field paths and which paths hold the turns; the fingerprint of a record picks the layout.  All
conversion is DataFrame expressions.  A struct has the fingerprint of its JSON, but its turns are taken from the
struct itself, since Spark parses no string of more than 20,000,000 characters and no variant of more than 128 MiB.

Template, per turn: ``### <role>: <text></turn>`` and a line feed.  Inside a role or text ``\\``, ``#``
and ``<`` become ``\\s``, ``\\h`` and ``\\l`` (in a role also ``:`` becomes ``\\c``), so no control string can
occur there and unescaping is exact.

Defined results: a null text is empty; a null role is the empty role; turns are ordered by turn, nulls
first, ties by role, then text; repeated rows are turns of their own; a conversation without turns
formats to the empty string; rows of a null conv_id form one conversation; a record that is no JSON
object or matches no layout gets a null ``layout`` and no turns; a JSON text of more than ``PARSED`` characters that
does not parse raises an error, since it may be a record that is too large.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TURN = "array<struct<role:string,text:string>>"
END = "</turn>\n"
LEAD = "### "
#: Characters of a JSON text that no limit of the parser stops: neither that of a string nor that of a variant.
PARSED = 20_000_000
#: Lengths summed in one run.
RUN = 256


@dataclass(frozen=True)
class Layout:
    """``paths``: the field paths of a record.  Either ``turns`` (path of an array, with the names of its
    role and text fields) or ``fixed`` ((role, paths joined by a blank line) in order).  ``aliases``: do other
    names of roles become the canonical ones?"""

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    aliases: bool = True


#: The known layouts and the role names that mean the canonical roles.
LAYOUTS = (
    Layout("turn_rows", ("turns[].role", "turns[].text"), ("turns", "role", "text"), aliases=False),
    Layout("messages", ("messages[].content", "messages[].role"), ("messages", "role", "content")),
    Layout("sharegpt", ("conversations[].from", "conversations[].value"), ("conversations", "from", "value")),
    Layout("prompt", ("completion", "prompt"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("answer", "question"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout(
        "system_question", ("question", "response", "system_prompt"),
        fixed=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",))),
    ),
    Layout("instruction", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout(
        "instruction_input", ("input", "instruction", "output"),
        fixed=(("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
)
ROLE_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(variant: Column) -> Column:
    """Sorted nested field paths, arrays as ``[]``, joined by line feeds; null for what is no object.

    The schema text of a variant nests as ``OBJECT<a: ARRAY<OBJECT<b: STRING>>>``; reading it from the
    left, a stack of open names turns each leaf into its path.
    """
    schema = F.schema_of_variant(variant)
    # marks: name-open, array-open, close, leaf
    tokens = F.regexp_extract_all(schema, F.lit(r"(`(?:[^`]|``)*`|[^<>,: ]+): |(OBJECT<|ARRAY<)|(>)|([A-Z]+(?:\([0-9,]+\))?)"), 0)
    start = F.struct(
        F.array().cast("array<string>").alias("stack"),
        F.array().cast("array<string>").alias("leaves"),
    )

    def step(acc: Column, tok: Column) -> Column:
        stack, leaves = acc["stack"], acc["leaves"]
        is_name, is_open, is_close = tok.endswith(": "), tok.endswith("<"), tok == ">"
        top = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        # names stay on the stack until their value ends; OBJECT pushes a marker that adds nothing
        pushed = (
            F.when(is_name, F.array_append(stack, F.concat(F.lit("."), F.regexp_replace(tok, ": $", ""))))
            .when(tok == "ARRAY<", F.array_append(stack, F.lit("[]")))
            .when(tok == "OBJECT<", F.array_append(stack, F.lit("")))
        )
        closed = F.when(is_close, top).otherwise(stack)
        # a value (leaf or closed bracket) ends the name above it
        popped = F.when(
            F.element_at(F.concat(F.array(F.lit("-")), closed), -1).startswith("."),
            F.slice(closed, 1, F.greatest(F.size(closed) - 1, F.lit(0))),
        ).otherwise(closed)
        leaf = F.when(is_name | is_open | is_close, leaves).otherwise(
            F.array_append(leaves, F.ltrim(F.array_join(stack, ""), F.lit(".")))
        )
        return F.struct(F.when(is_name | is_open, pushed).otherwise(popped).alias("stack"), leaf.alias("leaves"))

    paths = F.aggregate(tokens, start, step, lambda acc: F.array_join(F.array_sort(F.array_distinct(acc["leaves"])), "\n"))
    return F.when(schema.startswith("OBJECT<"), paths)


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def canonical_role(role: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in ROLE_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(aliases, role), role, F.lit(""))


def _turn_of(role: str, body: str, aliases: bool) -> Callable[[Column], Column]:
    def turn(t: Column) -> Column:
        name = canonical_role(t[role]) if aliases else F.coalesce(t[role], F.lit(""))
        return F.struct(name.alias("role"), F.coalesce(t[body], F.lit("")).alias("text"))

    return turn


def _always(value: Column) -> Callable[[Column], Column]:
    return lambda _: value


def from_json(records: DataFrame, json: str = "record") -> DataFrame:
    """Adds ``schema_fingerprint``, ``layout`` and ``turns`` to records of a JSON text column, or of a struct column as
    ``records_of_rows`` makes it."""
    record, typed = F.col(f"`{json}`"), records.schema[json].dataType
    fields = typed.names if isinstance(typed, StructType) else []
    if fields:
        # all turns have one type and no nulls, so an emptied one shows the field paths of the record
        empty = {f: F.struct(*[F.lit("").alias(n) for n in typed[f].dataType.elementType.names]) for f in fields}
        shown = [F.transform(F.slice(record[f], 1, 1), _always(empty[f])).alias(f) for f in fields]
        parsed = F.try_parse_json(F.to_json(F.struct(*shown)))
    else:
        too_large = F.concat(F.lit("a record does not parse, maybe for its size: characters "), F.char_length(record).cast("string"))
        parsed = F.coalesce(F.try_parse_json(record), F.when(F.char_length(record) > PARSED, F.raise_error(too_large)).cast("variant"))
    out = records.withColumn("_v", parsed)
    out = out.withColumn("schema_fingerprint", fingerprint(field_paths(F.col("_v"))))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURN)
    text = lambda path: F.try_variant_get(F.col("_v"), path, "string")
    for known in reversed(LAYOUTS):
        here = F.col("schema_fingerprint") == fingerprint(F.lit("\n".join(sorted(known.paths))))
        if known.turns:
            where, role, body = known.turns
            if where in fields and {role, body} <= set(typed[where].dataType.elementType.names):
                raw = record[where]
            elif fields:
                continue
            else:
                raw = F.try_variant_get(F.col("_v"), f"$.{where}", f"array<struct<`{role}`:string,`{body}`:string>>")
            made = F.transform(raw, _turn_of(role, body, known.aliases))
        elif fields:
            continue
        else:
            made = F.array(*[
                F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.nullif(text(f"$.{p}"), F.lit("")) for p in parts]).alias("text"))
                for role, parts in known.fixed
            ])
        layout = F.when(here, F.lit(known.name)).otherwise(layout)
        turns = F.when(here, made.cast(TURN)).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns).drop("_v")


def records_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turn rows -> one record ``{"turns": [{"role":, "text":}, ...]}`` a conversation, as a struct."""
    # the schema names both fields in every turn, whatever is null
    one = F.struct(
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    return (
        rows.groupBy(F.col(f"`{conv}`").alias("conv_id"))
        .agg(F.array_sort(F.collect_list(one)).alias("t"))
        .select("conv_id", F.struct(
            F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")
        ).alias("record"))
    )


def escape(text: Column) -> Column:
    out = text
    for raw, code in (("\\", "\\s"), ("#", "\\h"), ("<", "\\l")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """Exact: an escaped text has a backslash only where a code begins; the backslash itself comes last."""
    out = text
    for raw, code in (("<", "\\l"), ("#", "\\h"), (":", "\\c"), ("\\", "\\s")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return F.when(F.contains(text, F.lit("\\")), out).otherwise(text)  # most texts hold none


def running(lens: Column) -> Column:
    """The sum of all lengths before each; in runs, since an array that grows by one is copied each time."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / RUN).cast("int")), lambda j: F.slice(lens, j * RUN + 1, RUN))

    def sums(some: Column, first: Column) -> Column:
        start = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(some, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])

    totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda acc, n: acc + n))
    out = F.flatten(F.zip_with(runs, sums(totals, F.lit(0)), sums))
    return F.when(F.size(lens) > 0, out).otherwise(F.array().cast("array<bigint>"))


def format_turns(records: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``: (turn index, start, length) in code points of each assistant text, escaped."""
    def head(t: Column) -> Column:
        return F.concat(F.lit(LEAD), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(": "))

    pieces = F.transform(
        F.col("turns"),
        lambda t: F.struct(
            head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")
        ),
    )
    out = records.withColumn("_pieces", pieces)
    out = out.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    lens = F.transform("_pieces", lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + F.lit(len(END)))
    # lengths are a column of their own, and starts an argument: in a lambda they would be made again for each turn
    out = out.withColumn("_lens", lens)
    spans = F.transform(
        F.arrays_zip(F.col("_pieces").alias("p"), running(F.col("_lens")).alias("at")),
        lambda x, i: F.struct(
            i.alias("turn"), x["p"]["loss"].alias("loss"),
            (x["at"] + F.char_length(x["p"]["head"])).alias("start"), F.char_length(x["p"]["body"]).alias("length"),
        ),
    )
    return out.withColumn(
        "loss_spans", F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["turn"], s["start"], s["length"]))
    ).drop("_pieces", "_lens")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``read_turns``, as parsed from ``formatted``, and ``loss_text``, what ``loss_spans`` marks in it, unescaped.

    A span is cut out by its start and length; its turn only says where to look, and a span that is not inside
    that turn raises an error.
    """
    whole = F.split("formatted", END.replace("\n", r"\n"), -1)
    def parts(s: Column) -> Column:
        colon = F.instr(s, ": ")  # the first, as a role holds none
        role = F.substring(s, F.lit(len(LEAD) + 1), colon - F.lit(len(LEAD) + 1))
        return F.struct(role.alias("role"), F.substring(s, colon + 2, F.char_length(s)).alias("text"))

    raw = F.transform(F.filter(whole, lambda s: s != ""), parts)
    turns = F.transform(raw, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    out = formatted.withColumn("read_turns", turns).withColumn("_segments", whole)
    out = out.withColumn("_lens", F.transform("_segments", lambda s: F.char_length(s) + F.lit(len(END))))
    out = out.withColumn("_starts", running(F.col("_lens")))

    def cut(span: Column) -> Column:
        segment, at = F.get(F.col("_segments"), span["turn"]), span["start"] - F.get(F.col("_starts"), span["turn"])
        inside = (at >= 0) & (span["length"] >= 0) & (at + span["length"] <= F.char_length(segment))
        outside = F.raise_error(F.lit("a loss span that is not inside its turn")).cast("string")
        return F.when(inside, F.substring(segment, (at + 1).cast("int"), span["length"].cast("int"))).otherwise(outside)

    return out.withColumn("loss_text", F.array_join(F.transform(F.transform("loss_spans", cut), unescape), "")).drop("_segments", "_lens", "_starts")

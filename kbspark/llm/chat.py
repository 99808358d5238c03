"""Chat formatting by schema fingerprints.

Records come as JSON in whatever layout their source uses. The nested field paths of a
record, hashed, are its fingerprint; a table of declarative mappings says for every known
fingerprint where its turns are. All layouts become canonical (role, text) turns, which one
template renders, with a mask over what a model is to be trained on.

Defined results: a null text is an empty one, a null role an empty role; an object with other
fields keeps its layout as long as a known set of paths is among its paths; a record of an
unknown layout fails the job with its paths; repeated turns are kept, in the order of turn,
role and text; rows without a turn come first in their conversation; rows without conv_id are one
conversation; given rows of conversation -1 are one conversation with the probe's two turns; no
rows give no conversations but the probe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import staged

# The template's control strings, and control strings of other common templates.
TURN, END = "<|im_start|>", "<|im_end|>"
TAILS = r"\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>"
TRAINED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """Where the turns of one layout are.

    ``paths`` are the field paths that identify the layout; ``turns`` lists (role, path) of
    single texts; ``list_at`` with ``role_at`` and ``text_at`` describes a list of messages.
    ``aliases`` translates role names.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    list_at: str = ""
    role_at: str = ""
    text_at: str = ""
    aliases: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("prompt", ("prompt",), (("user", "prompt"),)),
    Mapping("completion", ("completion",), (("assistant", "completion"),)),
    Mapping("prompt-completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt-response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", ("instruction",), (("system", "instruction"),)),
    Mapping("instruction-output", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction-input-output", ("input", "instruction", "output"),
            (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("messages", ("messages[].content", "messages[].role"), list_at="messages", role_at="role", text_at="content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), list_at="conversations", role_at="from",
            text_at="value", aliases=(("human", "user"), ("gpt", "assistant"))),
)


def field_paths(record: Column) -> Column:
    """Sorted nested paths of a JSON record's fields, two levels deep: ``a``, ``a[].b``, ``a.b``."""

    def below(key: Column) -> Column:
        value = F.call_function("get_json_object", record, F.concat(F.lit("$['"), key, F.lit("']")))
        head = F.substring(F.ltrim(value), 1, 1)
        inner = F.when(head == "[", F.json_object_keys(F.get_json_object(value, "$[0]"))).when(
            head == "{", F.json_object_keys(value))
        mark = F.when(head == "[", "[].").otherwise(".")
        named = F.transform(inner, lambda k: F.concat(key, mark, k))
        return F.when(F.coalesce(F.size(inner), F.lit(0)) > 0, named).otherwise(F.array(key))

    return F.array_sort(F.flatten(F.transform(F.json_object_keys(record), below)))


def fingerprint(paths: Column) -> Column:
    """Hash of a sorted list of field paths."""
    return F.sha2(F.array_join(paths, "\n"), 256)


def _turns(record: Column, mapping: Mapping) -> Column:
    """Canonical turns of a record in one layout."""
    if mapping.list_at:
        schema = f"{mapping.list_at} array<struct<{mapping.role_at}: string, {mapping.text_at}: string>>"
        items = F.from_json(record, schema)[mapping.list_at]
        named = F.create_map(*[F.lit(x) for pair in mapping.aliases for x in pair]) if mapping.aliases else None

        def turn(m: Column) -> Column:
            role = F.coalesce(m[mapping.role_at], F.lit(""))
            role = F.coalesce(named[role], role) if named is not None else role
            return F.struct(role.alias("role"), F.coalesce(m[mapping.text_at], F.lit("")).alias("text"))

        return F.transform(items, turn)
    fields = F.from_json(record, ", ".join(f"{path} string" for _, path in mapping.turns))
    return F.array(*[
        F.struct(F.lit(role).alias("role"), F.coalesce(fields[path], F.lit("")).alias("text"))
        for role, path in mapping.turns])


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns of every record: the columns of ``records`` with ``layout`` and ``turns`` for ``record``.

    The fingerprint is taken over those of a record's paths that any mapping knows, so
    additional fields do not matter. The mapping is picked by comparing fingerprints.
    """
    known = F.array(*[F.lit(p) for p in sorted({p for m in mappings for p in m.paths})])
    prints = records.withColumn("_paths", field_paths(F.col("record"))).withColumn(
        "_print", fingerprint(F.array_sort(F.array_intersect("_paths", known))))
    unknown = F.raise_error(F.concat(F.lit("unknown layout: "), F.array_join("_paths", ", ")))
    layout, turns = unknown.cast("string"), unknown.cast("array<struct<role: string, text: string>>")
    for m in mappings:
        same = F.col("_print") == fingerprint(F.array(*[F.lit(p) for p in sorted(m.paths)]))
        layout = F.when(same, F.lit(m.name)).otherwise(layout)
        turns = F.when(same, _turns(F.col("record"), m)).otherwise(turns)
    return prints.select(
        *[c for c in records.columns if c != "record"], F.col("_print").alias("fingerprint"),
        layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    """Break every control string by one backslash after its bracket; one more where some are."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({TAILS})", "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role on one line, without control strings."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: Column) -> Column:
    """Pieces (text, loss) of a conversation: joined they are the text, the flags are its mask."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.concat(F.lit(TURN), escape_role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("text"), (t["role"] == TRAINED).alias("loss")),
        F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))))


def format_conversations(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, pieces (text, loss) and layouts of every conversation.

    ``records`` has conv_id, turn (the order of records) and record. The text of a
    conversation is one value, as it is in training; nothing else is gathered.
    """
    rows = canonical_turns(records.select("conv_id", "turn", "record"), mappings)
    every = rows.select("conv_id", "turn", "layout", F.posexplode("turns").alias("at", "one"))
    row = F.struct("turn", "at", F.col("one.role").alias("role"), F.col("one.text").alias("text"))
    return every.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(row)).alias("turns"), F.array_sort(F.collect_set("layout")).alias("layouts")
    ).select("conv_id", render(F.col("turns")).alias("pieces"), "layouts")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, text, turns (role, text) and loss texts, parsed from the rendered output."""
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    masked = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"]))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - F.lit(2 + len(END)))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    parts = F.slice(F.split("text", r"<\|im_start\|>"), F.lit(2), F.length("text"))
    return formatted.select("conv_id", text.alias("text"), masked.alias("loss")).select(
        "conv_id", "text", F.transform(parts, turn).alias("turns"), "loss")


def layout_rows(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation table as JSON records in the layouts their roles suggest."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    one = F.struct(role.alias("role"), text.alias("content"))
    record = (
        F.when(F.col("role") == "user", F.to_json(F.struct(text.alias("prompt"))))
        .when(F.col("role") == "system", F.to_json(F.struct(text.alias("instruction"))))
        .otherwise(F.to_json(F.struct(F.array(one).alias("messages")))))
    return conversations.select("conv_id", "turn", record.alias("record"))


def digests(parsed: DataFrame) -> DataFrame:
    """Counts and digests of parsed conversations."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"))


PROBE = "</s>[INST] ok [/INST]"


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """All conversations and the probe conversation -1: format, write, read back, digest."""
    kinds = dict(conversations.dtypes)
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    ).select(F.col("conv_id").cast(kinds["conv_id"]), F.col("turn").cast(kinds["turn"]), "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(read_back(staged(format_conversations(layout_rows(rows)), "chat")))

"""Chat formatting: records of many layouts become canonical turns, and turns become text with a loss mask.

A record's layout is told by its fingerprint, the hash of the sorted paths of its nested fields (arrays as ``[]``), which
Spark computes from the record's variant schema. A :class:`Mapping` says for a set of paths where turns, roles and texts
lie; the fingerprint picks the mapping, so that records of different layouts can stand in one table. Records that no
mapping knows are kept apart (:func:`unknown_layouts`).

Template: ``### role: text </turn>\\n`` for each turn. Within roles and texts ``\\`` becomes ``\\\\``, ``###`` becomes
``\\###`` (each ``#`` with two more behind it) and ``</turn>`` becomes ``\\</turn>``; in roles ``:`` becomes ``\\:`` too.
A backslash thus always shields the next character and no bare control string comes from a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions

TURNS = "array<struct<role:string,text:string>>"
#: role names of other layouts and the canonical ones
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """A declarative mapping. ``required`` and ``optional``: the leaf paths of the layout.

    Either ``items`` is an array's path with ``role`` and ``text`` within its elements, or ``parts`` lists
    (role, path or role in brackets, joined with a line break if there are several paths) for single fields.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def fingerprints(self) -> list[str]:
        """The fingerprint of every combination of the optional paths (ten of them at most)."""
        if len(self.optional) > 10:
            raise ValueError("too many optional paths")
        sets = [[]]
        for path in self.optional:
            sets += [[*s, path] for s in sets]
        return sorted({fingerprint_of([*self.required, *s]) for s in sets})

    def turns(self, record: str) -> str:
        """SQL for the canonical turns of the variant ``record``."""
        if self.items:
            fields = ", ".join(sorted({f"{f.split('.')[0]}:string" for f in (self.role, self.text)}))
            get = f"variant_get({record}, '$.{self.items}', 'array<struct<{fields}>>')"
            return f"transform({get}, x -> named_struct('role', x.{self.role}, 'text', x.{self.text}))"
        turns = []
        for role, paths in self.parts:
            value = ", ".join(f"try_variant_get({record}, '$.{p}', 'string')" for p in paths)
            given = f"try_variant_get({record}, '$.{role[1:-1]}', 'string')" if role.startswith("<") else f"'{role}'"
            optional = set(paths) <= set(self.optional) and not role.startswith("<")
            turn = f"array(named_struct('role', {given}, 'text', concat_ws('\\n', {value})))"
            turns.append(f"IF(coalesce({value}) IS NULL, CAST(array() AS {TURNS}), {turn})" if optional else turn)
        return f"concat({', '.join(turns)})"


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = (
    Mapping("turn rows", ("role", "turn"), ("text",), parts=(("<role>", ("text",)),)),
    Mapping("messages", ("messages[].content", "messages[].role"), items="messages", role="role", text="content"),
    Mapping("messages with text", ("messages[].role", "messages[].text"), items="messages", role="role", text="text"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value"),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt", ("completion", "prompt"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question", ("answer", "question"), ("system",), parts=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
)


def paths_of(schema: Column) -> Column:
    """Sorted leaf paths of a variant schema text such as ``OBJECT<a: ARRAY<OBJECT<b: STRING>>>``."""
    # one path for each name that is followed by a scalar; the open names around it are found by a fold over the tokens
    tokens = F.regexp_extract_all(schema, F.lit(r"`[^`]*`: |[^\s<>,:`]+: |OBJECT<|ARRAY<|>|, |[A-Z]+(?:\([0-9, ]*\))?"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit("").alias("name"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, t: Column) -> Column:
        top = F.coalesce(F.try_element_at(acc["stack"], F.lit(-1)), F.lit(""))
        name = acc["name"]
        joined = F.when(top == "", name).when(name == "", top).otherwise(F.concat(top, F.lit("."), name))
        is_name, opens, array_, closes = t.endswith(": "), t == "OBJECT<", t == "ARRAY<", t == ">"
        stack = F.when(opens, F.array_append(acc["stack"], joined)).when(array_, F.array_append(acc["stack"], F.concat(joined, F.lit("[]")))).when(closes, F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))).otherwise(acc["stack"])
        next_name = F.when(is_name, F.regexp_replace(t, "^`?(.*?)`?: $", "$1")).otherwise(F.lit(""))
        leaf = ~(is_name | opens | array_ | closes | (t == ", "))
        paths = F.when(leaf, F.array_append(acc["paths"], joined)).otherwise(acc["paths"])
        return F.struct(stack.alias("stack"), next_name.alias("name"), paths.alias("paths"))

    return F.aggregate(tokens, start, step, lambda acc: F.array_sort(F.array_distinct(acc["paths"])))


def _known(records: DataFrame, mappings: tuple[Mapping, ...]) -> DataFrame:
    """``records`` (…, record: JSON text) with ``_v``, the variant, and ``_layout``, the number of its mapping or null."""
    parsed = records.withColumn("_v", F.try_parse_json("record")).withColumn("_schema", F.expr("schema_of_variant(_v)"))
    # few layouts, many records: a known schema text needs no fold
    printed = parsed.withColumn("_print", F.sha2(F.array_join(paths_of(F.col("_schema")), "\n"), 256))
    of = {p: i for i, m in reversed(list(enumerate(mappings))) for p in m.fingerprints()}
    return printed.withColumn("_layout", F.expr("CASE _print " + " ".join(f"WHEN '{p}' THEN {i}" for p, i in of.items()) + " END"))


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns of ``records`` (conv_id, turn, record: JSON text): conv_id, turn, part, role, text.

    ``turn`` orders the records of a conversation and ``part`` the turns within a record. Null texts and roles are empty;
    role names are made canonical by ``ROLES``; records without a known layout are left out, see :func:`unknown_layouts`.
    """
    known = _known(records.select("conv_id", "turn", "record"), mappings).where("_layout IS NOT NULL")
    turns = F.expr("CASE _layout " + " ".join(f"WHEN {i} THEN {m.turns('_v')}" for i, m in enumerate(mappings)) + " END")
    out = known.select("conv_id", "turn", F.posexplode(turns).alias("part", "t"))
    role = F.coalesce("t.role", F.lit(""))
    for other, name in ROLES.items():
        role = F.when(F.col("t.role") == other, name).otherwise(role)
    return out.select("conv_id", "turn", "part", role.alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def unknown_layouts(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """How many of ``records`` have each layout without a mapping: paths, fingerprint, n."""
    known = _known(records.select("conv_id", "turn", "record"), mappings).where("_layout IS NULL")
    return known.groupBy(F.array_join(paths_of(F.col("_schema")), ",").alias("paths"), F.col("_print").alias("fingerprint")).agg(F.count("*").alias("n"))


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(text, r"#(?=##)|</turn>", r"\\$0")


def format_turns(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Each turn's stretch of the formatted text: conv_id, turn, part, stretch, loss_start, loss_end (code points in it).

    A conversation's text is its stretches by turn and part, in a row; the loss mask covers the assistant's texts, from
    loss_start to loss_end (equal elsewhere). Row by row, without a shuffle, whatever the length of a conversation.
    """
    head = F.concat(F.lit("### "), F.regexp_replace(escape(F.col("role")), ":", r"\\:"), F.lit(": "))
    body = escape(F.col("text"))
    rows = turns.select("conv_id", "turn", "part", "role", head.alias("head"), body.alias("body"))
    start = F.length("head").cast("long")
    return rows.select("conv_id", "turn", "part", F.concat("head", "body", F.lit(" </turn>\n")).alias("stretch"), start.alias("loss_start"), (start + F.when(F.col("role") == assistant, F.length("body")).otherwise(0)).alias("loss_end"))


_TURN = regex.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", regex.S)
_SHIELD = regex.compile(r"\\(.)", regex.S)


def unescape(text: str) -> str:
    return _SHIELD.sub(r"\1", text) if "\\" in text else text


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}: {text[at : at + 60]!r}")
        out.append((unescape(m[1]), unescape(m[2][:-1])))
        at = m.end()
    return out


def turn_digests(formatted: DataFrame) -> DataFrame:
    """What formatted text says of each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    One shuffle by conversation; each task then streams over its sorted stretches and keeps nothing but running digests,
    so that a conversation may be of any length. Empty texts count as turns; rows without a conv_id are one conversation;
    rows that stand twice are turns of their own, ties in order of their stretch; an empty table gives an empty table.
    """
    ordered = formatted.repartition(shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "part", "stretch")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, stretch, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "stretch", "loss_start", "loss_end")), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(stretch):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(stretch[a:b])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(stretch)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return ordered.select("conv_id", "stretch", "loss_start", "loss_end").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as JSON records of the layout "turn rows"; other columns are ignored."""
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.col("text"), F.coalesce("turn", F.lit(-1)).alias("turn")))
    return conversations.select("conv_id", "turn", record.alias("record"))


CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all conversations and of conversation -7; null texts and roles are empty."""
    import json

    own = json.dumps({"messages": [{"role": r, "content": CONTROL_TEXT} for r in ("user", "assistant")]})
    rows = conversation_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(own).alias("record"))
    return turn_digests(format_turns(canonical_turns(rows.unionByName(more))))


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
        + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS n FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + length(role) + 15) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id
"""

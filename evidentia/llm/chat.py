"""Chat formatting: records of many layouts become canonical turns, and turns one formatted text with a loss mask.

A record is JSON. Its schema fingerprint is the hash of its sorted nested field paths (list positions left out). A
registry of declarative mappings, each from field paths to roles, is keyed by fingerprint; a record is converted by the
mapping of its own fingerprint, else by the one with most field paths, the first of ties, of those whose paths it has all;
a record that no mapping fits is returned with no turns and its fingerprint, to be mapped. A template then marks turns: control strings inside roles and texts are escaped, reversibly.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Escapes: a backslash is doubled, ``<|`` becomes
``<\\|``, so no text holds a control string; a newline in a role becomes ``\\n``.

Defined results: a null text is empty, a null role is empty; turns of equal number are ordered by role and text; repeated
rows are repeated turns; a conversation without turns doesn't exist in a table of turns. Turn and conversation numbers
may be null: null turns come first, null conversations are one group. Further columns are ignored by the query; convert()
and format_turns() keep them and put their own columns in the place of columns of the same name. One conversation is one
row, as its formatted text is.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. `turns`: (role, paths) in order, several paths joined by a blank line, empty ones
    left out. Or `items`: the path of a list of turns, with the fields of role and text, and other names of roles."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


#: Other names for the canonical roles.
ALIASES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: The layouts that are known from the start.
MAPPINGS = (
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), items="messages", role="role", text="content"),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", roles=ALIASES),
    Mapping("prompt_completion", ("completion", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", ("answer", "question"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction_output", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction", ("input", "instruction", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system_instruction", ("input", "instruction", "output", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("nested_prompt", ("prompt", "prompt.text", "response", "response.text"), turns=(("user", ("prompt.text",)), ("assistant", ("response.text",)))),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """All nested field paths of a JSON value; ``[]`` stands for any position of a list."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in ({f"{at}.{k}".lstrip(".")} | field_paths(v, f"{at}.{k}".lstrip(".")))}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")}
    return set()


def look_up(value: object, path: str) -> str:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def apply_mapping(m: Mapping, record: dict) -> list[tuple[str, str]]:
    if m.items:
        names = dict(m.roles)
        return [(names.get(r := look_up(x, m.role), r), look_up(x, m.text)) for x in record.get(m.items) or []]
    turns = [(role, "\n\n".join(filter(None, (look_up(record, p) for p in paths)))) for role, paths in m.turns]
    return [(role, text) for role, text in turns if text or role != "system"]


def convert(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """`records` with fingerprint, layout (null if unknown) and turns (array of role, text). Null or broken JSON has a null fingerprint."""
    known = {m.fingerprint: m for m in mappings}

    @F.pandas_udf("fingerprint string, layout string, turns array<struct<role:string,text:string>>")
    def turns_of(column: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in column:
            try:
                record = json.loads(raw)
            except (TypeError, ValueError):
                rows.append((None, None, []))
                continue
            # a list's own fields count as its mapping's however many items it has, none included
            print_ = fingerprint_of(sorted(paths)) if (paths := field_paths(record)) else fingerprint_of(())
            fitting = [x for x in mappings if paths >= set(x.paths)] or [x for x in mappings if x.items and paths >= {x.items} and not record[x.items]]
            m = known.get(print_) or max(fitting, key=lambda x: len(x.paths), default=None)
            rows.append((print_, m.name if m else None, [{"role": r, "text": t} for r, t in apply_mapping(m, record)] if m else []))
        return pd.DataFrame(rows, columns=["fingerprint", "layout", "turns"])

    own, new = free_name(records), ("fingerprint", "layout", "turns")
    return records.withColumn(own, turns_of(F.col(column))).select(*[F.col(f"`{c}`") for c in records.columns if c not in new], *[F.col(own)[c].alias(c) for c in new])


def free_name(df: DataFrame) -> str:
    """A column name that `df` doesn't have."""
    return "_" * (1 + max(map(len, df.columns), default=0))


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\|\|)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    # "\\n" as written: an escape followed by n; a doubled backslash before an n is no newline, so pairs go first
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))), "\\")


def format_turns(turns: DataFrame, column: str = "turns") -> DataFrame:
    """Adds `formatted` and `loss_spans`: for each assistant turn begin (from 0) and length of its escaped text."""
    part = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    pieces = F.transform(F.col(column), lambda t: F.struct((t["role"] == "assistant").alias("loss"), part(t).alias("part"), (F.length(F.lit(START)) + F.length(escape_role(t["role"])) + 1).alias("skip"), F.length(escape(t["text"])).alias("size")))
    own = free_name(turns)
    out = turns.withColumn(own, pieces).withColumn("formatted", F.array_join(F.col(own)["part"], ""))
    folded = F.aggregate(
        own,
        F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<begin:int,size:int>>").alias("spans")),
        lambda a, p: F.struct((a["at"] + F.length(p["part"])).cast("int").alias("at"), F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["skip"]).cast("int").alias("begin"), p["size"].cast("int").alias("size"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"],
    )
    return out.withColumn("loss_spans", folded).drop(own)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped: array of role, text."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 2_000_000_000)
    body = lambda p: F.substring(p, 1, F.length(p) - len(END) - 1)
    cut_at = lambda p: F.instr(p, "\n")
    return F.transform(parts, lambda p: F.struct(unescape_role(F.substring(p, F.lit(1), cut_at(p) - 1)).alias("role"), unescape(F.substring(body(p), cut_at(p) + 1, F.length(p))).alias("text")))


#: The layouts that single exchanges are dealt to, by conversation number.
EXCHANGES = ("prompt_response", "question_answer", "instruction_output", "nested_prompt")


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id and a JSON record of each conversation of a table of turns, in a layout that can hold it.

    A user's and an assistant's turn are dealt to EXCHANGES; with a system's in front, not empty, they are an instruction;
    of the others the odd ones list `from` and `value`, if their roles have no other names there, the rest are messages."""
    item = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    said = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    number, roles = F.coalesce("conv_id", F.lit(0)), F.col("t.role")
    text = lambda k: F.col("t")[k]["content"]
    is_pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    is_system = (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & (text(0) != "")
    renamed = {new: old for old, new in reversed(ALIASES)}
    other = F.exists(roles, lambda r: r.isin([old for old, _ in ALIASES]))
    layout = F.when(is_pair, F.element_at(F.array(*map(F.lit, EXCHANGES)), (F.pmod(number, F.lit(len(EXCHANGES))) + 1).cast("int"))).when(is_system, "system_instruction").when((F.pmod(number, F.lit(2)) == 1) & ~other, "conversations").otherwise("messages")
    name = lambda r: F.when(r == "user", renamed["user"]).when(r == "assistant", renamed["assistant"]).otherwise(r)
    shapes = {
        "prompt_response": F.struct(text(0).alias("prompt"), text(1).alias("response")),
        "question_answer": F.struct(text(0).alias("question"), text(1).alias("answer")),
        "instruction_output": F.struct(text(0).alias("instruction"), text(1).alias("output")),
        "nested_prompt": F.struct(F.struct(text(0).alias("text")).alias("prompt"), F.struct(text(1).alias("text")).alias("response")),
        "system_instruction": F.struct(text(0).alias("system"), text(1).alias("instruction"), F.lit("").alias("input"), text(2).alias("output")),
        "conversations": F.struct(F.transform("t", lambda x: F.struct(name(x["role"]).alias("from"), x["content"].alias("value"))).alias("conversations")),
        "messages": F.struct(F.transform("t", lambda x: F.struct(x["role"], x["content"])).alias("messages")),
    }
    record = F.coalesce(*[F.when(layout == key, F.to_json(shape)) for key, shape in shapes.items()])
    return said.select("conv_id", record.alias("record"))

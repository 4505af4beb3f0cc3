"""Chat formatting, with DataFrame functions only.

A JSON record's nested field paths, as far as any mapping knows them, are hashed; the hash selects the
mapping that turns the record into canonical turns (role, text). Turns are then written between control
strings. Inside roles and texts a backslash is doubled, and one is put behind the first character of every
control string, so that the reader can split at control strings and restore the texts exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, ROLE_END, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that steer common chat templates, and so must not stand in a text.
CONTROL = (START, ROLE_END, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: Containers of message objects that the mappings know.
LISTS = ("messages", "conversations", "dialog")


@dataclass(frozen=True)
class Mapping:
    """fields: top-level text fields and the role that each takes, in order. items: (list, role field, text field)."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()

    def layouts(self) -> list[tuple[str, ...]]:
        """The sets of paths that select this mapping."""
        need = [k for k, _ in self.fields if k not in self.optional]
        if self.items:
            need += [self.items[0], *(f"{self.items[0]}[].{x}" for x in self.items[1:])]
        return [tuple(sorted([*need, *extra])) for n in range(len(self.optional) + 1) for extra in combinations(self.optional, n)]


#: Later entries never share a set of paths with earlier ones.
MAPPINGS = (
    Mapping("messages", items=("messages", "role", "content"), fields=(("system", "system"),), optional=("system",)),
    Mapping("conversations", items=("conversations", "from", "value"), fields=(("system", "system"),), optional=("system",)),
    Mapping("dialog", items=("dialog", "speaker", "text"), fields=(("system", "system"),), optional=("system",)),
    Mapping("prompt", fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Mapping("response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Mapping("question", fields=(("system", "system"), ("question", "user"), ("answer", "assistant")), optional=("system",)),
    Mapping("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
)
#: Other names of the canonical roles, outside layouts that name them "role".
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

_TEXTS = sorted({k for m in MAPPINGS for k, _ in m.fields})
_ITEMS = sorted({x for m in MAPPINGS if m.items for x in m.items[1:]})
_SCHEMA = ", ".join([*(f"`{k}` STRING" for k in _TEXTS), *(f"`{k}` ARRAY<STRUCT<{', '.join(f'`{x}`: STRING' for x in _ITEMS)}>>" for k in LISTS)])


def path_hash(paths: list[str] | tuple[str, ...]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def fingerprint(record: Column | str) -> Column:
    """The hash of a JSON record's known nested paths: its top-level names, and those of the first object in each list of messages."""
    record = F.col(record) if isinstance(record, str) else record
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))

    def inside(name: str) -> Column:
        names = F.json_object_keys(F.get_json_object(record, f"$.{name}[0]"))
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{name}[]."), x))

    nested = [inside(k) for k in LISTS]
    known = sorted({p for m in MAPPINGS for layout in m.layouts() for p in layout})
    paths = F.array_intersect(F.concat(keys, *nested), F.array(*map(F.lit, known)))
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def canonical_turns(df: DataFrame, record: str = "record", turns: str = "turns") -> DataFrame:
    """Adds the mapping's name (layout; null if none fits, or the record is no JSON object) and the canonical turns, an array of role and text.

    Null texts in a message are empty; an optional field that is null gives no turn. An empty list of messages
    has no nested paths, and so no layout. Fields that no mapping knows are ignored. Columns that bear the
    names layout, turns, _record and _mark are replaced."""
    df = df.drop("layout", turns, "_record", "_mark").withColumns({"_record": F.from_json(record, _SCHEMA), "_mark": fingerprint(record)})
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def items(where: str, role: str, text: str) -> Column:
        return F.transform(F.col(f"_record.{where}"), lambda x: turn(x[role] if role == "role" else F.coalesce(roles[x[role]], x[role]), x[text]))

    name, value = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in MAPPINGS:
        fits = F.col("_mark").isin([F.xxhash64(F.lit("\n".join(x))) for x in m.layouts()])
        whole = F.array(*[F.when(F.lit(k not in m.optional) | F.col(f"_record.{k}").isNotNull(), turn(F.lit(r), F.col(f"_record.{k}"))) for k, r in m.fields])
        parts = [F.filter(whole, lambda x: x.isNotNull())]
        if m.items:
            parts.append(F.coalesce(items(*m.items), F.array().cast("array<struct<role:string,text:string>>")))
        name, value = F.when(fits, F.lit(m.name)).otherwise(name), F.when(fits, F.concat(*parts)).otherwise(value)
    return df.withColumns({"layout": name, turns: value}).drop("_record", "_mark")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\|[]()<>/." else c for c in text)


_CONTROL = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in CONTROL)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"\\")


def unescape(text: Column) -> Column:
    """A pair of backslashes stands for one; a single one was put there."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(turns: Column | str) -> Column:
    turns = F.col(turns) if isinstance(turns, str) else turns
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(ROLE_END), escape(t["text"]), F.lit(END))), "\n")


def loss_spans(turns: Column | str, role: str = "assistant") -> Column:
    """Where the texts of a role stand in the formatted string: start (from 0) and length, in code points."""
    turns = F.col(turns) if isinstance(turns, str) else turns
    fixed = len(START) + len(ROLE_END)
    sizes = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.length(escape(t["role"])).alias("r"), F.length(escape(t["text"])).alias("t")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, x):
        here = acc["at"] + fixed + x["r"]
        spans = F.when(x["role"] == role, F.concat(acc["spans"], F.array(F.struct(here.alias("start"), x["t"].alias("length"))))).otherwise(acc["spans"])
        return F.struct((here + x["t"] + len(END) + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(sizes, start, step)["spans"]


def parse(text: Column | str) -> Column:
    """The turns of a formatted string."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.split(text, _quoted(START)), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(unescape(F.substring_index(x, ROLE_END, 1)).alias("role"), unescape(F.substring_index(F.substring_index(x, ROLE_END, -1), END, 1)).alias("text")))


def masked(text: Column | str, spans: Column | str) -> Column:
    """The texts under the spans, restored."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    return F.transform(spans, lambda s: unescape(F.substr(text, s["start"] + 1, s["length"])))


def format_records(df: DataFrame, record: str = "record") -> DataFrame:
    """Adds layout, turns, formatted and loss_spans to rows that hold a JSON record; records that no mapping fits have nulls there."""
    out = canonical_turns(df.drop("formatted", "loss_spans"), record)
    return out.withColumns({"formatted": formatted("turns"), "loss_spans": loss_spans("turns")})


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id and record, a JSON object, from rows by turn. Turns are sorted by turn, role and text; repeated rows stay.

    The layout follows from the conversation: a user and an assistant turn alone take the prompt layout,
    others a list of messages, under names that depend on conv_id. Null conv_ids are one conversation."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    held = rows.groupBy("conv_id").agg(turns.alias("t"))
    pair = (F.size("t") == 2) & (F.col("t")[0]["role"] == "user") & (F.col("t")[1]["role"] == "assistant")
    plain = lambda name: F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias(name)))
    other = F.to_json(F.struct(F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")))
    named = F.exists("t", lambda x: x["role"].isin(list(ROLES)))  # such roles would not come back as they were
    prompt = F.to_json(F.struct(F.col("t")[0]["text"].alias("prompt"), F.col("t")[1]["text"].alias("completion")))
    instruction = F.to_json(F.struct(F.col("t")[0]["text"].alias("instruction"), F.col("t")[1]["text"].alias("output")))
    odd = F.coalesce(F.col("conv_id") % 2 != 0, F.lit(False))
    record = F.when(pair & odd, prompt).when(pair, instruction).when(odd & ~named, other).otherwise(plain("messages"))
    return held.select("conv_id", record.alias("record"), named.alias("named"))


#: A conversation of control strings, which every formatting run carries along.
PROBE = "</s>[INST] ok [/INST]"


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Digests of all conversations and the probe (conv_id -1), read back from the formatted strings."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    probe = rows.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = format_records(conversation_records(rows.unionByName(probe))).select("conv_id", "formatted", "loss_spans")
    back, loss = parse("formatted"), F.array_join(masked("formatted", "loss_spans"), "")
    got = done.select("conv_id", back.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")

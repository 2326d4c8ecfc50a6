"""Chat formatting by schema fingerprints.

A record is JSON in any layout that MAPPINGS describes. Its fingerprint is a hash of its nested field paths (array
items as `[]`); the fingerprint selects a declarative mapping, which lists where turns come from, and every layout ends
as the same canonical turns. Turns are then written with one template: marks around role and text, control strings
inside both escaped by a backslash after their first character, backslashes doubled, so that reading back is exact.
The loss mask covers what the assistant says. Roles stay as the record has them, but where a layout has names of its own
for user and assistant, its mapping translates them.

Defined results: null role and null text count as empty; turns stand in order of turn, null last, ties by role and
then text; repeated rows are repeated turns; a null conv_id is a conversation of its own; a conversation without rows does
not exist; an empty or null list of turns and a null record have no turns; texts of any length are written whole; an empty
table gives no rows. A record that is no JSON object, whose fields fit no mapping, or whose role or text is not a string, is
rejected: its formatted text and mask are null and `problem` says why; all other records go on. Kept columns come first, by
the names given, and may not be called formatted, mask or problem. A conversation is one output row, so its turns meet in
one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmeridian.session import ship

Turn = tuple[str, str]
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|over|>\n"
LEARNED = "assistant"
#: Control strings of common chat templates, ours included: each is cut by a backslash wherever a text has it.
CONTROL = re.compile(r"[<\[](?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)")


def fingerprint(record: object) -> str:
    """A hash of the sorted nested field paths of a record; values do not matter."""
    return hashlib.sha256("\n".join(sorted(paths(record))).encode()).hexdigest()[:16]


def paths(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}") for k, v in value.items())) if value else {at + ".{}"}
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[0]"}
    return {at}


#: Roles as the layouts of shared chats call them.
SHARED = {"human": "user", "gpt": "assistant"}
#: Layout: an example that has its fields, its mapping: (role or role field, text field), or an array of such, and the names
#: that it has for roles. A field in front of `[]` is an array of turns.
MAPPINGS: tuple[tuple[dict, tuple[tuple[str, str], ...], dict[str, str]], ...] = (
    ({"messages": [{"role": "", "content": ""}]}, (("messages[].role", "messages[].content"),), {}),
    ({"messages": []}, (), {}),
    ({"messages": None}, (), {}),
    ({"conversations": [{"from": "", "value": ""}]}, (("conversations[].from", "conversations[].value"),), SHARED),
    ({"conversations": []}, (), {}),
    ({"conversations": None}, (), {}),
    ({"system": "", "messages": [{"role": "", "content": ""}]}, (("=system", "system"), ("messages[].role", "messages[].content")), {}),
    ({"system": "", "messages": []}, (("=system", "system"),), {}),
    ({"prompt": "", "response": ""}, (("=user", "prompt"), ("=assistant", "response")), {}),
    ({"prompt": "", "completion": ""}, (("=user", "prompt"), ("=assistant", "completion")), {}),
    ({"instruction": "", "output": ""}, (("=user", "instruction"), ("=assistant", "output")), {}),
    ({"instruction": "", "input": "", "output": ""}, (("=user", "instruction"), ("=user", "input"), ("=assistant", "output")), {}),
)
BY_PRINT = {fingerprint(example): (mapping, names) for example, mapping, names in MAPPINGS}


def _said(value: object, what: str) -> str:
    if value is not None and not isinstance(value, str):
        raise ValueError(f"{what} is not a string")
    return value or ""


def canonical(record: object) -> list[Turn]:
    """The turns of a record, by the mapping that its fingerprint selects."""
    found = BY_PRINT.get(fingerprint(record)) if isinstance(record, dict) else None
    if found is None:
        raise ValueError(f"no mapping for a record with the fields {sorted(paths(record))}")
    mapping, names = found
    if not mapping and any(record.values()):
        raise ValueError(f"no list of turns in the fields {sorted(paths(record))}")
    turns: list[Turn] = []
    for role, text in mapping:
        array, _, field = text.rpartition("[].")
        for item in record[array] if array else [record]:
            said = role[1:] if role[0] == "=" else _said(item[role.rpartition("[].")[2]], role)
            turns.append((names.get(said, said), _said(item[field], text)))
    return turns


def _turns(record: str | None) -> tuple[list[Turn] | None, str | None]:
    """(turns, None), or (None, why there are none)."""
    try:
        return (canonical(json.loads(record)) if record else []), None
    except (ValueError, RecursionError) as problem:
        return None, str(problem)


def escape(text: str) -> str:
    return CONTROL.sub(r"\g<0>\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask: (start, end) in code points of each assistant text."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = OPEN + escape(role) + MIDDLE, escape(text)
        if role == LEARNED:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), mask


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        role, _, text = part.partition(MIDDLE)
        turns.append((unescape(role), unescape(text[: -len(CLOSE)])))
    return turns


def _kept(df: DataFrame, keep: tuple[str, ...]) -> tuple[list[str], str, list[Column]]:
    """Plain names for columns to be kept, their part of a schema, and the columns."""
    plain = [f"k{i}" for i in range(len(keep))]
    return plain, "".join(f"{p} {df.schema[n].dataType.simpleString()}, " for p, n in zip(plain, keep, strict=True)), [F.col(f"`{n}`").alias(p) for p, n in zip(plain, keep, strict=True)]


def formatted(records: DataFrame, record: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, the formatted text, its loss mask, and what is wrong with a record that has neither."""
    ship(records.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, masks, problems = [], [], []
            for r in b.column(b.num_columns - 1).to_pylist():
                turns, problem = _turns(r)
                text, mask = render(turns) if turns is not None else (None, None)
                texts.append(text)
                masks.append(mask if mask is None else [{"start": x, "end": y} for x, y in mask])
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(masks, span), pa.array(problems, pa.string())], [*plain, "formatted", "mask", "problem"])

    plain, kept, chosen = _kept(records, keep)
    rows = records.select(*chosen, F.col(f"`{record}`").alias("record"))
    return rows.mapInArrow(write, f"{kept}formatted string, mask array<struct<start:long,end:long>>, problem string").toDF(*keep, "formatted", "mask", "problem")


def read_back(chats: DataFrame, keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """What formatted conversations say, read from the text and its mask alone; nulls for a rejected one."""
    ship(chats.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, mask in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True):
                if text is None:
                    rows.append((None,) * 5)
                    continue
                turns = parse(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                said = "".join(f"{role}\n{what}\n" for role, what in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, columns, kinds)], [*plain, *names])

    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    plain, kept, chosen = _kept(chats, keep)
    rows = chats.select(*chosen, "formatted", "mask")
    return rows.mapInArrow(read, f"{kept}n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").toDF(*keep, *names)


def records_of(conversations: DataFrame) -> DataFrame:
    """conv_id and a JSON record for each conversation. Conversations come in three layouts, as they would from
    different sources: a first system turn stands apart, two turns user and assistant are prompt and response."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn"), text("role").alias("role"), text("text").alias("content"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    message = lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))
    at = lambda i: F.get(F.col("t"), F.lit(i))
    plain = lambda t: F.transform(t, message).alias("messages")
    rest = F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))
    pair = (F.size("t") == 2) & (at(0)["role"] == "user") & (at(1)["role"] == "assistant")
    system = (F.size("t") > 1) & (at(0)["role"] == "system")
    json_of = F.when(pair, F.to_json(F.struct(at(0)["content"].alias("prompt"), at(1)["content"].alias("response")))).when(system, F.to_json(F.struct(at(0)["content"].alias("system"), plain(rest)))).otherwise(F.to_json(F.struct(plain(F.col("t")))))
    return turns.select("conv_id", json_of.alias("record"))

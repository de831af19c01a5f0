"""Chat formatting: records of many layouts become canonical turns, and turns become marked text.

A record's schema fingerprint is a hash of its nested field paths. It selects a declarative mapping,
which says where roles and texts lie. In the text every turn stands between control strings; control
strings inside texts and roles are escaped reversibly, so that reading back gives the same turns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def paths(value: object, prefix: str = "") -> set[str]:
    """The nested field paths of a parsed record; list items share the path ``[]``."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{prefix}.{k}") for k, v in value.items())) if value else {f"{prefix}{{}}"}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{prefix}[]") for v in value)) if value else {f"{prefix}[]"}
    return {prefix}


def fingerprint(names: set[str]) -> str:
    """Of field paths; null fields count like others, values don't."""
    return xxhash.xxh64_hexdigest("\n".join(sorted(names)))


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns`` are (role, field paths joined by a blank line) for layouts with a field per turn; ``items``
    is the path of a list of messages ('' for a record that is a message), with the fields ``role`` and
    ``text``. ``optional`` fields may be missing. ``names`` renames roles.
    """

    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str | None = None
    role: str = ""
    text: str = ""
    optional: tuple[str, ...] = ()
    names: dict[str, str] = field(default_factory=dict)

    def layouts(self) -> list[set[str]]:
        if self.items is not None:
            base = {f"{self.items}.{self.role}", f"{self.items}.{self.text}"}
        else:
            base = {f".{p}" for _, fields in self.turns for p in fields}
        out = [base]
        for name in self.optional:
            out += [[*x, f".{name}"] if isinstance(x, list) else x ^ {f".{name}"} for x in out]
        return out

    def apply(self, record: dict) -> list[tuple[str, str]]:
        say = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        if self.items == "":
            found = [(say(record.get(self.role)), say(record.get(self.text)))]
        elif self.items is not None:
            found = [(say(x.get(self.role)), say(x.get(self.text))) for x in record.get(self.items[1:-2]) or []]
            if record.get("system"):
                found.insert(0, ("system", say(record["system"])))
        else:
            found = []
            for role, fields in self.turns:
                texts = [say(record.get(p)) for p in fields]
                if role == "system" and not any(texts):
                    continue
                found.append((role, "\n\n".join(x for x in texts if x)))
        return [(self.names.get(r, r), t) for r, t in found]


MAPPINGS = (
    Mapping(items="", role="role", text="text"),
    Mapping(items="", role="role", text="content"),
    Mapping(items=".messages[]", role="role", text="content", optional=("system",)),
    Mapping(items=".messages[]", role="role", text="text", optional=("system",)),
    Mapping(items=".conversations[]", role="from", text="value", optional=("system",), names={"human": "user", "gpt": "assistant"}),
    Mapping(turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping(turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping(turns=(("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input",)),
)


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    out: dict[str, Mapping] = {}
    for m in mappings:
        for layout in m.layouts():
            out.setdefault(fingerprint(set(layout)), m)
    return out


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records(conv_id, turn, record)`` -> (conv_id, turn, step, role, text, layout): a row per turn.

    ``record`` is JSON; a record may be one message of a conversation, ordered by ``turn``, or hold many,
    ordered by ``step``. A record whose fingerprint has no mapping, or that is no JSON object, gives one
    row with the role 'unmapped' and itself as text; a null one gives such a row with an empty text. A
    layout with an empty list of messages has no turns.
    """
    known = registry(mappings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for conv, turn, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    record = json.loads(text or "")
                except ValueError:
                    record = None
                mark = fingerprint(paths(record)) if isinstance(record, dict) else ""
                if isinstance(record, dict) and any(record.get(k) == [] for k in ("messages", "conversations")):
                    turns: list[tuple[str, str]] = []
                elif mark in known:
                    turns = known[mark].apply(record)
                else:
                    turns = [("unmapped", text or "")]
                rows += [(conv, turn, i, role, said, mark) for i, (role, said) in enumerate(turns)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "step", "role", "text", "layout"])

    return records.select("conv_id", "turn", "record").mapInArrow(run, "conv_id long, turn long, step long, role string, text string, layout string")


def escaped(text: Column) -> Column:
    """One more backslash in every ``<\\\\...|``, so that no ``<|`` is left; ``unescape`` takes it out."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """A role on one line: backslashes and newlines are spelled out first."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    out, i = [], 0
    while (j := text.find("<\\", i)) >= 0:
        k = j + 1
        while k < len(text) and text[k] == "\\":
            k += 1
        out.append(text[i : j + 1] + text[j + 2 : k] if k < len(text) and text[k] == "|" else text[i:k])
        i = k
    return "".join(out) + text[i:]


def unescape_role(role: str) -> str:
    out, text, i = [], unescape(role), 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            out.append("\n" if text[i + 1] == "n" else text[i + 1])
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, step, role, text)`` -> a row per turn: conv_id, turn, step, formatted, loss_start, loss_end.

    A conversation's text is its rows' ``formatted`` in the order of turn, step and formatted; the loss mask
    of a row is the range of characters of an assistant's escaped text, else empty. Null roles and texts
    are empty.
    """
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), escaped_role(role), F.lit("\n"))
    loss = role == "assistant"
    # 4.x: char_length counts code points
    begin = F.char_length(head)
    rows = turns.select("conv_id", "turn", "step", head.alias("head"), text.alias("said"), loss.alias("loss"), begin.alias("begin"))
    return rows.select(
        "conv_id", "turn", "step", F.concat("head", "said", F.lit(END)).alias("formatted"),
        F.when(F.col("loss"), F.col("begin")).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("loss"), F.col("begin") + F.char_length("said")).otherwise(0).cast("long").alias("loss_end"),
    )


def parse_turn(formatted: str) -> tuple[str, str]:
    """The role and the text of one formatted turn."""
    if not formatted.startswith(START) or not formatted.endswith(END):
        raise ValueError("not a formatted turn")
    head, _, said = formatted[len(START) : -len(END)].partition("\n")
    return unescape_role(head), unescape(said)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Read formatted turns back, streaming over each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        open_, state = False, None
        done: list[tuple] = []

        def close() -> None:
            conv, n, turns, chars, loss, length = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for conv, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if not open_ or conv != state[0]:
                    if open_:
                        close()
                    open_, state = True, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                masked = unescape(text[a:b])
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(text)
            yield out()
        if open_:
            close()
        yield out()

    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "step", "formatted")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)

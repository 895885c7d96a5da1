"""Chat formatting: records of many layouts become canonical turns by the fingerprint of their fields.

A record is JSON. Its fingerprint is the hash of its sorted field paths ("messages[].role", ...). A table of mappings, one for
each known layout, says declaratively where the turns, roles and texts are; the fingerprint selects the mapping. A layout not
yet seen is matched once by the mappings' required paths, most of them first, and its fingerprint remembered; records that no mapping fits come
out with layout null and no turns.

The template puts a turn as `<|im_start|>role`, newline, text, `<|im_end|>`, newline. In roles and texts a backslash is doubled
and every place where a control string begins gets `\\.` after its first character, so no text can end a turn or open one, and
unescaping gives back every character. Loss spans cover the texts of assistant turns.

Turns are formatted one by one, without grouping. Reading back streams each conversation's pieces in order and holds one
piece at a time, so a conversation of any length needs no more memory than its longest turn.

Records that cannot be read come out as those of no known layout: what is not JSON or nested too deep, turn numbers that are no
64-bit integers, turns that are no objects. Half of a surrogate pair becomes U+FFFD.

Nulls: a null text or role is empty; a null id is a conversation of its own. Turns with the same number follow one another by
role and text. Empty tables: the given extra conversation, or nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrid.llm.common import cut, table

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|im_sep|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPED = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPED = re.compile(r"\\([\\.])")
_SURROGATE = re.compile("[\ud800-\udfff]")


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\.", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\.n])", lambda m: {"\\": "\\", ".": "", "n": "\n"}[m[1]], role)


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns. parts: (role, path) in order; or each: the path of a list, with the names of role and text."""

    name: str
    parts: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def required(self) -> set[str]:
        if self.each:
            return {f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"}
        return {p for p in (self.role, self.text) if p} if self.text else {p for r, p in self.parts if r != "system" and p not in ("input",)}


ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "prompter": "user"}
LAYOUTS = (
    Layout("turn_row", role="role", text="text", turn="turn"),
    Layout("messages", each="messages", role="role", text="content", roles=ROLES),
    Layout("conversations", each="conversations", role="from", text="value", roles=ROLES),
    Layout("dialog", each="data.turns", role="speaker", text="utterance", roles=ROLES),
    Layout("instruction", parts=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt_response", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", parts=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", parts=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
)


def field_paths(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _at(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return _SURROGATE.sub("\ufffd", text)


def _turn(value: object) -> int:
    if value is None:
        return 0
    if isinstance(value, bool) or not isinstance(value, (int, float, str)) or isinstance(value, float) and not value.is_integer():
        raise ValueError("a turn is numbered by an integer")
    if not -(1 << 63) <= int(value) < 1 << 63:
        raise ValueError("a turn's number has 64 bits")
    return int(value)


class Mapper:
    """Selects a mapping by fingerprint and applies it."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.layouts, self.known = layouts, {}

    def layout(self, record: object) -> Layout | None:
        paths = field_paths(record)
        key = fingerprint(paths)
        if key not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            fit = [x for x in self.layouts if x.required() <= paths or x.each and f"{x.each}[]" in paths]
            self.known[key] = max(fit, key=lambda x: len(x.required()), default=None)
        return self.known[key]

    def turns(self, record: object) -> tuple[str | None, list[tuple[int, str, str]]]:
        found = self.layout(record)
        if found is None:
            return None, []
        if found.each:
            items = _at(record, found.each) or []
            if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
                raise ValueError("turns are objects in a list")
            own = [(_text(_at(i, found.role)), _text(_at(i, found.text))) for i in items]
            return found.name, [(k, found.roles.get(r.lower(), r), t) for k, (r, t) in enumerate(own)]
        if found.text:
            return found.name, [(_turn(_at(record, found.turn)), _text(_at(record, found.role)), _text(_at(record, found.text)))]
        merged: list[tuple[str, str]] = []
        for role, path in found.parts:
            value = _at(record, path)
            if value is None or value == "" and path in ("system", "input"):
                continue
            if merged and merged[-1][0] == role:
                merged[-1] = (role, f"{merged[-1][1]}\n\n{_text(value)}")
            else:
                merged.append((role, _text(value)))
        return found.name, [(k, r, t) for k, (r, t) in enumerate(merged)]


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text, layout from conv_id and record (JSON). Records of no known layout, or not JSON, give one row with layout null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper(layouts)
        for batch in batches:
            rows = []
            for conv_id, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    name, turns = mapper.turns(json.loads(record or "null"))
                except (ValueError, RecursionError):
                    name, turns = None, []
                rows += [(conv_id, t, r, x, name) for t, r, x in turns] if name else [(conv_id, None, None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col("conv_id").cast("long"), "record").mapInArrow(read, "conv_id long, turn long, role string, text string, layout string")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, piece (the turn in the template), loss_start and loss_stop (code points of the piece that count for the loss; both 0 if none)."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, starts, stops = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                head, body = f"{START}{escape_role(role or '')}\n", escape(text or "")
                pieces.append(f"{head}{body}{END}\n")
                counts = role == "assistant"
                starts.append(len(head) if counts else 0)
                stops.append(len(head) + len(body) if counts else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], ["conv_id", "turn", "piece", "loss_start", "loss_stop"])

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(put, "conv_id long, turn long, piece string, loss_start long, loss_stop long")


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not piece.startswith(START) or not piece.endswith(f"{END}\n"):
        raise ValueError("not a turn")
    role, _, body = piece[len(START) : -len(END) - 1].partition("\n")
    if START in body or END in body:
        raise ValueError("a control string inside a turn")
    return unescape_role(role), unescape(body)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list | None = None

        def out(done: list) -> list:
            return [*done[:2], done[2].hexdigest(), done[3], done[4].hexdigest(), done[5]]

        for batch in batches:
            rows = []
            for conv_id, piece, start, stop in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if own is None or own[0] != conv_id:
                    if own:
                        rows.append(out(own))
                    own = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_piece(piece)
                own[1] += 1
                own[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(piece[start:stop])
                own[3] += len(loss)
                own[4].update(loss.encode("utf-8", "surrogatepass"))
                own[5] += len(piece)
            yield _digests(rows)
        if own:
            yield _digests([out(own)])

    placed = formatted.select("conv_id", "piece", "loss_start", "loss_stop", "turn").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "piece")
    return placed.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    both = rows.unionByName(extra)
    records = both.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return read_back(cut(format_turns(canonical_turns(records)), "chat"))


QUERIES = {"op4_chat": op4_chat}

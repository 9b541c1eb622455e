"""Chat formatting with typed content parts.

A turn is a role and an array of parts (kind, text, ref, width, height, seconds, pages). A visitor
flattens the parts in order: text is escaped, an image, audio or document part becomes a placeholder,
and its reference and the number of tokens it will expand to are recorded. The template marks turns
with control strings. A control string inside a text is escaped by a backslash after its first
character (and a backslash by another), so the output holds no control string but the template's own
and can be read back.

Formatted turns are rows, in order, of which a conversation is the concatenation; nothing gathers a
conversation in memory. One shuffle by conversation and one sort serve the writing and the reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Control strings of common chat templates, escaped wherever a text has them.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
CONTROL = (TURN, BODY, END, *PLACEHOLDERS.values(), *FOREIGN)

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<number:long,kind:string,ref:string,at:long,tokens:long>"

_STARTS = re.compile(r"\\|(?=" + "|".join(map(re.escape, CONTROL)) + r").", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_HOLDERS = re.compile("(" + "|".join(map(re.escape, PLACEHOLDERS.values())) + ")")


def escape(text: str) -> str:
    return _STARTS.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits the parts of a turn in order. ``at`` is the code point of the body where a placeholder stands."""

    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 256
    body: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        if kind not in ("text", *PLACEHOLDERS):
            raise ValueError(f"unknown part kind {kind!r}")
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach(part, ceil((part.get("width") or 0) / self.patch) * ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 0) * self.page_tokens)

    def _add(self, text: str) -> None:
        self.body.append(text)
        self.length += len(text)

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": part["kind"], "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self._add(PLACEHOLDERS[part["kind"]])


def read_turn(formatted: str) -> tuple[str, list[dict]]:
    """Role and parts of a formatted turn; the parts of a placeholder have no reference (see the attachments)."""
    if not (formatted.startswith(TURN) and formatted.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    role, body = formatted[len(TURN) : -len(END) - 1].split(BODY)
    kinds = {v: k for k, v in PLACEHOLDERS.items()}
    parts = [{"kind": kinds[x]} if x in kinds else {"kind": "text", "text": unescape(x)} for x in _HOLDERS.split(body) if x]
    return unescape(role), parts


def in_order(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, parts_col: str) -> DataFrame:
    """(conv, role, parts): conversations together, their turns in order."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.col(parts_col).alias("parts"))
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", F.to_json("parts")).select("conv", "role", "parts")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn, conversations together and in order: conv, position, role, formatted, offset (code
    points of the conversation before it), loss_start and loss_end (code points of the conversation under
    the loss mask, null outside ``loss_roles``), attachments (numbered through the conversation), tokens.

    Defined results: a null role or text is empty and an empty or null array of parts an empty body; a
    null conversation is one of its own; ties of the turn number go by role and content; rows alike each
    stay; a conversation of any length streams through; an empty table gives an empty result; other
    columns are ignored, whatever their names."""
    schema = f"conv {dict(turns.dtypes)[conv_col]}, position long, role string, formatted string, offset long, loss_start long, loss_end long, attachments array<{ATTACHMENT}>, tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, offset, number = object(), 0, 0, 0
        kinds = None
        for batch in batches:
            rows = []
            for c, role, parts in zip(*(col.to_pylist() for col in batch.columns)):
                if c != conv:
                    conv, position, offset, number = c, 0, 0, 0
                flat = Flattener()
                for part in parts or []:
                    flat.visit(part or {})
                head, body = f"{TURN}{escape(role)}{BODY}", "".join(flat.body)
                formatted = f"{head}{body}{END}\n"
                start = offset + len(head)
                loss = (start, start + len(body)) if role in loss_roles else (None, None)
                found = [{"number": number + k, **a} for k, a in enumerate(flat.attachments)]
                rows.append((c, position, role, formatted, offset, *loss, found, sum(a["tokens"] for a in found)))
                position, offset, number = position + 1, offset + len(formatted), number + len(found)
            kinds = kinds or [
                batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
                pa.list_(pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])),
                pa.int64(),
            ]
            for lo in range(0, len(rows), 1000):
                columns = [pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 1000]), kinds)]
                names = ["conv", "position", "role", "formatted", "offset", "loss_start", "loss_end", "attachments", "tokens"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_order(turns, conv_col, turn_col, role_col, parts_col).mapInArrow(run, schema)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted turns back (as ``format_turns`` leaves them: together and in order) and sums each
    conversation up: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments.

    Roles and texts come out of the formatted string, the loss text out of its masked code points."""
    schema = f"conv {dict(formatted.dtypes)['conv']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments"]
        kind, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((state["conv"], state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["attached"]))

        def flush() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, position, text, offset, start, end, attached in zip(*(col.to_pylist() for col in batch.columns)):
                if position == 0:
                    close()
                    state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "attached": 0}
                role, parts = read_turn(text)
                body = "".join(p.get("text", "") for p in parts)
                state["all"].update(f"{role}\n{body}\n".encode())
                state["turns"] += 1
                state["chars"] += len(text)
                state["attached"] += attached
                if start is not None:
                    masked = unescape(_HOLDERS.sub("", text[start - offset : end - offset]))
                    state["loss"].update(masked.encode())
                    state["loss_chars"] += len(masked)
            if len(done) >= 1000:
                yield flush()
                done = []
        close()
        if done:
            yield flush()

    read = formatted.select("conv", "position", "formatted", "offset", "loss_start", "loss_end", F.size("attachments").cast("long").alias("n"))
    return read.mapInArrow(run, schema)


def text_parts(text_col: str):
    """The parts column of a plain text."""
    empty = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), F.coalesce(text_col, F.lit("")).alias("text"), empty.cast("string").alias("ref"), empty.cast("int").alias("width"),
            empty.cast("int").alias("height"), empty.cast("double").alias("seconds"), empty.cast("int").alias("pages"),
        )
    )

"""Conversations from event logs, rendered for training.

A log holds events of messages: ``message`` opens one with its role (and text, if any), ``delta`` appends to it,
``edit`` replaces its text, ``regenerate`` clears what was streamed so far, ``delete`` takes it back. Logs are
partitioned by conversation and sorted by sequence; events then stream through a fold that holds one
conversation at a time, whose messages stand in the order in which they were opened.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.frames import shuffle_partitions

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that steer common chat formats; none of them may come out of a text as it stands.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_SPECIAL = re.compile("|".join(re.escape(x) for x in ("\\", *CONTROL)))
_SLASHES = re.compile(r"\\(\\?)")
_PARTS = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)
#: Conversations per batch are cut at about this many characters.
FLUSH = 4 << 20


def escaped(text: str) -> str:
    """A backslash is doubled; inside a control string one is put after the first character."""
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescaped(text: str) -> str:
    return _SLASHES.sub(r"\1", text)


def rendered(turns: list[tuple[str, str]], learned: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the ranges under the loss mask: the texts of the roles to learn."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        opening, body = f"{TURN}{escaped(role)}{TEXT}", escaped(text)
        if role in learned:
            spans.append((at + len(opening), at + len(opening) + len(body)))
        parts += [opening, body, END]
        at += len(opening) + len(body) + len(END)
    return "".join(parts), spans


def turns_of(formatted: str) -> list[tuple[str, str]]:
    return [(unescaped(role), unescaped(text)) for role, text in _PARTS.findall(formatted)]


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[dict] = []
    weight = 0
    current: object = Ellipsis
    messages: dict[str | None, list] = {}

    def closed() -> dict:
        text, spans = rendered([(role or "", "".join(parts)) for role, parts in messages.values()])
        return {"conv_id": current, "formatted": text, "loss": [{"start": a, "end": b} for a, b in spans]}

    for batch in batches:
        for conv, message, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "message", "kind", "role", "text"))):
            if conv != current:
                if current is not Ellipsis:
                    done.append(closed())
                    weight += len(done[-1]["formatted"])
                current, messages = conv, {}
                if weight > FLUSH:
                    yield pa.RecordBatch.from_pylist(done, _FORMATTED)
                    done, weight = [], 0
            own = messages.setdefault(message, [None, []])
            if kind == "message":
                own[0] = role
            if kind in ("edit", "regenerate"):
                own[1] = []
            if kind in ("message", "delta", "edit") and text:
                own[1].append(text)
            if kind == "delete":
                del messages[message]
    if current is not Ellipsis:
        done.append(closed())
    if done:
        yield pa.RecordBatch.from_pylist(done, _FORMATTED)


def format_chats(events: DataFrame, order: list[str]) -> DataFrame:
    """conv_id, formatted, loss (character ranges to learn from) of every conversation in an event log.

    events: conv_id, message, kind, role, text and the columns of ``order``, which sort a conversation's events.
    A null text is empty and a null role is the empty role; an event of a message that was not opened opens it
    without a role; unknown kinds change nothing. A null conv_id is a conversation of its own. Events that tie
    in ``order`` are sorted by message, kind and text, so reruns agree. An empty log gives no rows.
    """
    chosen = events.select(F.col("conv_id").cast("long").alias("conv_id"), *[F.col(c) for c in order if c not in ("conv_id", "message", "kind", "role", "text")],
                           F.col("message").cast("string").alias("message"), "kind", "role", "text")
    dealt = chosen.repartition(shuffle_partitions(events.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order, "message", "kind", "text")
    return dealt.select("conv_id", "message", "kind", "role", "text").mapInArrow(
        _folded, "conv_id long, formatted string, loss array<struct<start: int, end: int>>")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[dict] = []
        for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
            turns = turns_of(text)
            whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for role, said in turns:
                whole.update(f"{role}\n{said}\n".encode())
            for span in spans:
                said = unescaped(text[span["start"] : span["end"]])
                loss.update(said.encode())
                chars += len(said)
            out.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": whole.hexdigest(), "loss_chars": chars,
                        "loss_sha256": loss.hexdigest(), "formatted_chars": len(text)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text of formatted conversations, as digests."""
    return formatted.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(rows: DataFrame) -> DataFrame:
    """The log of finished conversations (conv_id, turn, role, text): each row's message is opened, streams a
    draft, is regenerated and streams its text in two deltas; a user's message is edited once instead.

    Columns turn, text_order and step sort the events. Rows that share a turn are messages side by side, ordered
    by role and the beginning of the text; wholly equal rows are told apart by their number in the row.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("role").cast("string")
    counted = (rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
               .groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("n"))
               .withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))))
    half = F.floor(F.length("text") / 2).cast("int")

    def event(step: int, kind: str, text: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))

    head, tail = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text") - half)
    none = F.lit(None).cast("string")
    typed = F.array(event(0, "message", tail), event(1, "edit", F.col("text")))
    streamed = F.array(event(0, "message", none), event(1, "delta", tail), event(2, "regenerate", none), event(3, "delta", head), event(4, "delta", tail))
    opened = counted.withColumn("e", F.explode(F.when(F.col("role") == "user", typed).otherwise(streamed)))
    digest = F.concat_ws(" ", F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.md5(F.concat_ws("\n", F.coalesce("role", F.lit("")), F.col("text"))), F.col("copy").cast("string"))
    return opened.select("conv_id", "turn", F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.substring("text", 1, 200)).alias("text_order"), "copy", "e.step",
                         digest.alias("message"), "e.kind", "role", "e.text")


ORDER = ["turn", "text_order", "message", "step"]

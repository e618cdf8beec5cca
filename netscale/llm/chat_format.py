"""Chat formatting by prefix-target expansion: each assistant turn is an example of its own, with all turns before it as context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's marks.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What follows the first character of a control string of any chat template: up to 60 characters in angle or square brackets, as in
#: <|im_end|>, <|reserved_special_token_12|>, <start_of_turn>, <eos>, </s>, [/INST], <<SYS>>. None stands unescaped inside a turn.
_CONTROL = r"[^\\<>\[\] \t\n\r][^<>\[\]\n]{0,59}[>\]]"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
#: Characters of examples that a task holds before it sends them.
HELD = 4_000_000


def escape(text: str) -> str:
    """A backslash more after the first character of each control string, and of those that have backslashes there already."""
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def read_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


_NAMES = ["conv_id", "example", "text", "mask_start", "mask_end", "final"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    for batch in batches:
        for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns"), strict=True):
            turns, text, n = turns.as_py(), "", 0
            for i, turn in enumerate(turns):
                body = escape(turn["text"])
                text += f"{OPEN}{_role(turn['role'])}\n"
                start = len(text)
                text += body + CLOSE
                last = i == len(turns) - 1
                reply = turn["role"] == "assistant"
                if reply or last:
                    rows.append((conv, n, text, start if reply else len(text), start + len(body) if reply else len(text), last))
                    n, held = n + 1, held + len(text)
                    if held > HELD:
                        yield made()
                        rows, held = [], 0
    if rows:
        yield made()


def chat_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, mask_start, mask_end, final) of each assistant turn of conversations (conv_id, turn, role, text).

    text is the whole formatted prefix up to the turn; characters [mask_start, mask_end) are its reply, escaped, and the only ones to
    train on. A conversation that doesn't end with an assistant turn has one more example, with nothing to train on, so that no turn is
    lost; `final` marks the example that holds the whole conversation. Turns go by turn number (null first), then role and text, and
    repeated rows are a turn each. A null role or text is empty; any role is kept, and only `assistant` is trained on. A null conv_id is a
    conversation of its own. Other columns aren't read. An empty table gives no examples. A conversation is formatted in one task.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    gathered = gathered.select(F.col("conv_id").cast("long"), F.expr("transform(turns, t -> struct(t.role, t.text))").alias("turns"))
    return gathered.mapInArrow(_expand, "conv_id long, example long, text string, mask_start long, mask_end long, final boolean")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "example", "n_turns", "turns_sha256", "reply", "chars"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for conv, example, text, a, b, final in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
            n, said = None, None
            if final:
                found = [(read_role(role), unescape(body)) for role, body in _TURN.findall(text)]
                n, said = len(found), hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in found).encode()).hexdigest()
            rows.append((conv, example, n, said, unescape(text[a:b]), len(text)))
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def digests(examples: DataFrame) -> DataFrame:
    """What can be read back from examples, of each conversation."""
    read = examples.mapInArrow(_read, "conv_id long, example long, n_turns long, turns_sha256 string, reply string, chars long")
    replies = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "")
    read = read.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), replies.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")

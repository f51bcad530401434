"""Chat formatting: turns to text segments with loss flags, by a declarative template, and the way back.

A finite-state machine over roles checks the order of turns; its state is the last role, so it is a ``lag`` over the
conversation. Formatting is a per-row expression. The only step that needs a conversation in one place is the order of
its turns, which is a sort that spills: no conversation is ever held in memory, however long.

Defined cases. NULL text: empty. NULL role: the empty role. NULL conv_id: one conversation of its own. Equal turn
numbers: ordered by role, then text. Repeated rows: repeated turns. A role that the template does not list is written
with the ``other`` marks and is never under the loss. A turn out of order is formatted all the same, with
``valid = false``. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ESCAPE = "\\"


@dataclass(frozen=True)
class Marks:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """What stands before and after the text of each role, which roles may follow which, and the control strings.

    ``follows[role]`` are the states from which ``role`` may come; "" is the start. Every control string begins with a
    character of its own kind of bracket, which no other control string contains further on.
    """

    begin: str = "<s>"
    roles: dict[str, Marks] = field(
        default_factory=lambda: {
            "system": Marks("[SYS] ", " [/SYS]"),
            "user": Marks("[INST] ", " [/INST]"),
            "assistant": Marks("[OUT] ", "</s>", loss=True),
        }
    )
    other_open: str = "[ROLE]"
    other: Marks = Marks("[TURN] ", " [/TURN]")
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "system": ("",),
            "user": ("", "system", "assistant"),
            "assistant": ("user",),
        }
    )

    def controls(self) -> list[str]:
        """Strings that may not occur in an escaped text."""
        marks = [m for r in [*self.roles.values(), self.other] for m in (r.before, r.after)]
        return list(dict.fromkeys(m.strip() for m in [self.begin, self.other_open, *marks]))


def escape(text: Column, template: Template) -> Column:
    """Double the escape character, then put one behind the first character of each control string."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in template.controls():
        text = F.replace(text, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
    return text


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    out, at = [], 0
    while (hit := text.find(ESCAPE, at)) >= 0:
        out += [text[at:hit], text[hit + 1 : hit + 2]]
        at = hit + 2
    return "".join([*out, text[at:]])


def format_chat(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) -> one row per turn, in order within its conversation and partition:
    ``conv_id, place int, role, valid boolean, segments array<struct<text string, loss boolean>>``.

    The segments of a conversation, in order, are its training text; ``loss`` marks what a model is trained to emit.
    """
    template = template or Template()
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartition("conv_id").sortWithinPartitions(*order)
    window = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    state = F.coalesce(F.lag("role").over(window), F.lit(""))
    place = F.row_number().over(window) - 1

    valid = F.lit(False)
    for role, before in template.follows.items():
        valid = F.when(F.col("role") == role, state.isin(*before)).otherwise(valid)

    def segment(text: Column | str, loss: bool = False) -> Column:
        text = F.lit(text) if isinstance(text, str) else text
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    body = escape(F.col("text"), template)
    named = F.concat(F.lit(template.other_open), escape(F.col("role"), template), F.lit(template.other.before))
    segments = F.array(segment(named), segment(body), segment(template.other.after))
    for role, marks in template.roles.items():
        own = F.array(segment(marks.before), segment(body, marks.loss), segment(marks.after))
        segments = F.when(F.col("role") == role, own).otherwise(segments)
    first = F.array(segment(template.begin))
    segments = F.when(place == 0, F.concat(first, segments)).otherwise(segments)
    return rows.select("conv_id", place.cast("int").alias("place"), "role", valid.alias("valid"), segments.alias("segments"))


def read_turn(text: str, template: Template) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    text = text.removeprefix(template.begin) if text.startswith(template.begin) else text
    for role, marks in template.roles.items():
        if text.startswith(marks.before):
            return role, unescape(text[len(marks.before) : text.rindex(marks.after)])
    marks = template.other
    role, _, rest = text.removeprefix(template.other_open).partition(marks.before)
    return unescape(role), unescape(rest[: rest.rindex(marks.after)])


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "valid boolean"
)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of the conversations, read from the formatted text alone (see ``DIGESTS``).

    Streams over the ordered turns with one hash state, so memory does not grow with a conversation.
    """
    template = template or Template()
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def read(batches):
        conv, state, out = None, None, []

        def close():
            n, turns, chars, loss, formatted_chars, valid = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars, valid))

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != conv:
                    if state is not None:
                        close()
                    conv, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                whole = "".join(s["text"] for s in row["segments"])
                role, text = read_turn(whole, template)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                for s in row["segments"]:
                    if s["loss"]:
                        plain = unescape(s["text"])
                        state[2] += len(plain)
                        state[3].update(plain.encode())
                state[4] += len(whole)
                state[5] &= row["valid"]
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)
                out = []
        if state is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)

    return formatted.select("conv_id", "valid", "segments").mapInArrow(read, DIGESTS)

"""Chat examples by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.
``written`` gives these examples with their whole ``text`` and the characters of it that are trainable (``loss_start``,
``loss_end``); ``read_written`` reads them back. Together they grow with the square of a conversation's turns.

For storage there is a smaller form, ``prefix_examples``: a row holds only what it adds to the example before it
(``added``: the turns since then, and its reply) and where that starts in the example (``context_chars``). The text of
an example is the ``added`` of all examples of its conversation up to it; ``full_text`` writes that out again, and
``read_back`` reads the stored form. Turns after the last reply stand in a last row that is no example (its ``loss_end``
is its end) and, in both forms, holds only these turns, so that nothing of a conversation is lost.

Template: each turn is ``<|turn|>role`` + newline + text + ``<|end|>`` + newline. Control strings of this and of other
common templates inside texts are escaped by a backslash after their first character (``<\\|end|>``); one that already has
backslashes there gets one more, so unescaping takes exactly one away and gives the text back. Roles are escaped for
newlines and backslashes as well.

The rows of a conversation are sorted within their partition and read as a stream; a task holds one batch of rows and the
turns since the last reply, and for whole texts the longest example of the conversation at hand.

Rows: a null text or role is empty; rows with a null conversation form one of their own; null turns come first, equal
turns by role and text; repeated rows are turns of their own. Empty tables give an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Control strings that a text must not contain unescaped.
CONTROLS = ["<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>",
            "<|assistant|>", "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>",
            "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>"]
_RAW = re.compile("|".join(f"{re.escape(c[0])}(\\\\*){re.escape(c[1:])}" for c in CONTROLS))
_TURN = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)

EXAMPLE = ("conv_id long, example int, target_turn long, added string, context_chars long, "
           "loss_start long, loss_end long, n_chars long")


def escape(text: str) -> str:
    return _RAW.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _RAW.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def ordered(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    c = conversations.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, number, length, waiting, started = None, 0, 0, [], False
    out: list[tuple] = []

    def close(target, reply: str | None) -> None:
        nonlocal number, length, waiting
        context = "".join(waiting)
        if reply is None:
            added, mask = context, (length + len(context),) * 2
        else:
            head = f"{TURN}assistant\n"
            mask = (length + len(context) + len(head), length + len(context) + len(head) + len(reply))
            added = f"{context}{head}{reply}{END}\n"
        out.append((conv, number, target, added, length, *mask, length + len(added)))
        number, length, waiting = number + 1, length + len(added), []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(KINDS), KINDS)], names=NAMES)
        out.clear()
        return batch

    size = 0
    for b in batches:
        for c, turn, role, text in zip(*[b.column(k).to_pylist() for k in range(4)]):
            if started and c != conv and waiting:
                close(None, None)
            if not started or c != conv:
                conv, number, length, waiting, started = c, 0, 0, [], True
            if role == "assistant":
                close(turn, escape(text))
            else:
                waiting.append(f"{TURN}{escape_role(role)}\n{escape(text)}{END}\n")
            size += len(text)
            if size > 1 << 22:
                yield flush()
                size = 0
        yield flush()
    if waiting:
        close(None, None)
    yield flush()


NAMES = [c.split()[0] for c in EXAMPLE.split(", ")]
KINDS = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in EXAMPLE.split(", ")]


def prefix_examples(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """One row per assistant turn, and one for turns after the last of them (``target_turn`` null)."""
    return ordered(conversations, conv, turn, role, text).mapInArrow(_expand, EXAMPLE)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the context before what each example adds; rows come by conversation and number."""
    started, conv, text, size = False, None, "", 0
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(KINDS), KINDS)], names=WHOLE_NAMES)
        out.clear()
        return batch

    for b in batches:
        columns = [b.column(b.schema.get_field_index(n)).to_pylist() for n in NAMES]
        for c, number, target, added, context, start, end, n_chars in zip(*columns):
            if not started or c != conv:
                started, conv, text = True, c, ""
            if len(text) != context:
                raise ValueError(f"conversation {c}: an example is missing before number {number}")
            text += added
            out.append((c, number, target, text if end < n_chars else added, context, start, end, n_chars))
            size += len(out[-1][3])
            if size > 1 << 22:
                yield flush()
                size = 0
        yield flush()


WHOLE = EXAMPLE.replace("added", "text")
WHOLE_NAMES = [c.split()[0] for c in WHOLE.split(", ")]


def written(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """One row per assistant turn with the whole ``text`` of its example, and one for turns after the last of them.

    The rows of a partition come by conversation and number; nothing is shuffled but the turns.
    """
    return prefix_examples(conversations, conv, turn, role, text).mapInArrow(_whole, WHOLE)


def full_text(examples: DataFrame) -> DataFrame:
    """Stored examples with their whole ``text``: context, then the reply.

    This writes the prefix of every example out, so its size is that of the training file.
    """
    return (examples.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(_whole, WHOLE)
            .where("loss_end < n_chars"))


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, n_examples long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses examples sorted by conversation and number, and digests turns and trainable text.

    A whole text must begin with the example before it, whose turns were parsed there.
    """
    state, out, started, conv, before = None, [], False, None, ""

    def fresh() -> dict:
        return {"turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "examples": 0}

    def done() -> None:
        out.append((conv, state["turns"], state["sha"].hexdigest(), state["loss"], state["loss_sha"].hexdigest(),
                    state["chars"], state["examples"]))

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)],
            names=[c.split()[0] for c in DIGEST.split(", ")])
        out.clear()
        return batch

    for b in batches:
        whole = "text" in b.schema.names
        columns = [b.column(b.schema.get_field_index(n)).to_pylist()
                   for n in ("conv_id", "text" if whole else "added", "context_chars", "loss_start", "loss_end", "n_chars")]
        for c, text, context, start, end, n_chars in zip(*columns):
            if started and c != conv:
                done()
            if not started or c != conv:
                state, conv, started, before = fresh(), c, True, ""
            example = end < n_chars
            added = text
            if whole and example:
                if not text.startswith(before) or len(text) != n_chars:
                    raise ValueError(f"conversation {c}: an example without its context")
                added, loss, before = text[len(before):], text[start:end], text
            else:
                loss = added[start - context:end - context]
            at = 0
            for m in _TURN.finditer(added):
                if m.start() != at:
                    raise ValueError(f"conversation {c}: text outside of turns")
                at = m.end()
                state["turns"] += 1
                state["sha"].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            if at != len(added):
                raise ValueError(f"conversation {c}: an unfinished turn")
            loss = unescape(loss)
            state["loss"] += len(loss)
            state["loss_sha"].update(loss.encode("utf-8", "surrogatepass"))
            state["chars"] += n_chars if example else 0
            state["examples"] += example
        yield flush()
    if started:
        done()
    yield flush()


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation: turns, trainable text and sizes as found in the stored examples.

    ``formatted_chars`` is the size of all examples with their context.
    """
    return (examples.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(_read_back, DIGEST))


def read_written(examples: DataFrame) -> DataFrame:
    """The same of examples with their whole text, in the order of ``written``, which is not shuffled again."""
    return examples.mapInArrow(_read_back, DIGEST)

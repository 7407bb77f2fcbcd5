"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all turns before it are its context, and its reply alone is
trainable. A conversation is rendered once, turn by turn; then each reply is exploded into an example whose
text is the rendering up to it. As each context begins with the one before, the examples' texts grow with
the square of a conversation's length; whoever can't afford that keeps the rendered turns, which name the
stretches that an example uses: [0, context_end) and its loss stretch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import common

ASSISTANT = "assistant"
OPEN, ROLE_END, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: Strings that steer a model; none of them stays whole inside a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(ROLE_END) + r"(.*?)" + re.escape(CLOSE), re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


PIECE = "conv_id {conv}, seq bigint, rendered string, start bigint, example bigint, context_end bigint, loss_start bigint, loss_end bigint"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by conversation and turn; of a conversation only counters are kept."""
    current: tuple | None = None
    seq = at = example = 0
    for batch in common.slices(batches):
        out: list[tuple] = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if current != (conv,):
                current, seq, at, example = (conv,), 0, 0, 0
            head = OPEN + escape(role) + ROLE_END
            body = escape(text)
            begin, end = at + len(head), at + len(head) + len(body)
            target = role == ASSISTANT
            out.append((seq, head + body + CLOSE, at, example if target else None, begin if target else None, begin if target else None, end if target else None))
            example += target
            seq += 1
            at = end + len(CLOSE)
        kinds = (pa.int64(), pa.string(), *(pa.int64(),) * 5)
        yield pa.record_batch([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["conv_id", "seq", "rendered", "start", "example", "context_end", "loss_start", "loss_end"])


def _ordered(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    rows = turns.select(F.col(conv_column).alias("conv_id"), F.col(turn_column).alias("turn"), common.text_of(role_column).alias("role"), common.text_of(text_column).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def rendered_turns(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row for each turn, sorted by conversation and turn: its rendering, where that starts, and the example whose target it is.

    Null roles and texts are empty. Rows come by turn, null turns first; equal turns by role, then text, and
    repeated rows stay. Null ids are one conversation. A conversation without an assistant turn has pieces
    and no example; turns after the last reply are pieces that no example reaches. An empty table gives no
    rows, extra columns are not read. Rows of a conversation pass through one task as a stream, whatever
    their number: the memory used is that of a batch.
    """
    return _ordered(turns, conv_column, turn_column, role_column, text_column).mapInArrow(_render, PIECE.format(conv=turns.schema[conv_column].dataType.simpleString()))


EXAMPLE = ("conv_id", "example", "n_turns", "text", "loss_start", "loss_end")
EXAMPLE_SCHEMA = "conv_id {conv}, example bigint, n_turns bigint, text string, loss_start bigint, loss_end bigint"
#: Characters of texts that a batch of examples holds, at about the least.
BATCH_CHARS = 1 << 20


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, text, done, turns, rows, size = None, "", 0, 0, [], 0

    def made(id_type: pa.DataType) -> pa.RecordBatch:
        kinds = (id_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], EXAMPLE)

    id_type = None
    for batch in common.slices(batches):
        id_type = batch.schema.field("conv_id").type
        for conv, rendered, example, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "example", "loss_start", "loss_end")), strict=True):
            if current != (conv,):
                if done < len(text):
                    rows.append((current[0], None, turns, text[done:], None, None))
                current, text, done, turns = (conv,), "", 0, 0
            text += rendered
            turns += 1
            if example is not None:
                rows.append((conv, example, turns, text, start, end))
                size += len(text)
                done = len(text)
            if size >= BATCH_CHARS:
                yield made(id_type)
                rows, size = [], 0
    if done < len(text):
        rows.append((current[0], None, turns, text[done:], None, None))
    if rows:
        yield made(id_type)


def examples(pieces: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, text, loss_start, loss_end: an example for each reply, its whole text written out.

    pieces as rendered_turns() returns them. Turns after a conversation's last reply, which are no reply's
    context, follow in a row whose example is null; so do all turns of one without a reply. Characters from
    loss_start to loss_end are trainable. A task holds the text of one conversation.
    """
    return pieces.mapInArrow(_examples, EXAMPLE_SCHEMA.format(conv=pieces.schema["conv_id"].dataType.simpleString()))


def format_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """The examples of conversations; see rendered_turns() and examples()."""
    return examples(rendered_turns(turns, **columns))


DIGESTS = "conv_id {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state = None, None

    def done() -> pa.RecordBatch:
        values = [state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["examples"]]
        return pa.record_batch([pa.array([current[0]], kind), *(pa.array([v]) for v in values)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"])

    for batch in common.slices(batches, 64):
        kind = batch.schema.field("conv_id").type
        ended = []
        for row in batch.to_pylist():
            if current != (row["conv_id"],):
                if current is not None:
                    ended.append(done())
                current = (row["conv_id"],)
                state = {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "examples": 0, "before": ""}
            text, new = row["text"], 0
            state["chars"] += len(text)
            if row["example"] is not None:
                if not text.startswith(state["before"]):
                    raise ValueError(f"example {row['example']} of conversation {current[0]} doesn't begin with its context")
                new, state["before"] = len(state["before"]), text
                loss = unescape(text[row["loss_start"] : row["loss_end"]])
                state["loss"].update(loss.encode())
                state["loss_chars"] += len(loss)
                state["examples"] += 1
            for found in _TURN.finditer(text, new):
                state["turns"].update(f"{unescape(found[1])}\n{unescape(found[2])}\n".encode())
                state["n"] += 1
        yield from ended
    if current is not None:
        yield done()


def read_back(made: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the texts of its examples alone; made as examples() returns it.

    Each example has to begin with the one before it: that is checked, and only what is new is parsed.
    formatted_chars counts the texts of all rows.
    """
    return made.mapInArrow(_read_back, DIGESTS.format(conv=made.schema["conv_id"].dataType.simpleString()))


def digests(turns: DataFrame) -> DataFrame:
    """What read_back() gives of format_conversations(), batch after batch in one pass: examples aren't held beyond a batch."""
    return _ordered(turns).mapInArrow(lambda batches: _read_back(_examples(_render(batches))), DIGESTS.format(conv=turns.schema["conv_id"].dataType.simpleString()))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of control strings."""
    turns = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, ASSISTANT, hostile)], "conv_id long, turn long, role string, text string")
    return digests(turns.unionByName(extra))

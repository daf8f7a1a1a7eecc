"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context, and
only that reply is trainable. Turns after the last reply, or a conversation without one, end
in an example with nothing trainable, so that no turn is lost.

A user's turn reads ``[INST] text</s>``, a reply ``[/INST] text</s>``, and a turn of another
role ``[TURN role]text</s>``. Control strings inside a text or role get a backslash after their first character, and one more where they have
some already, which ``unescape`` takes away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_CONTROL = r"/?s>|/?INST\b|/?TURN\b"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
_TURN = re.compile(r"\[TURN ((?:[^\]\\]|\\.)*)\](.*?)</s>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role(role: str) -> str:
    """A role inside the turn's mark: backslashes, closing brackets and control strings are escaped."""
    return re.sub(r"([\\\]<\[])", r"\\\1", role)


def opening(role: str) -> str:
    return {"user": "[INST] ", "assistant": "[/INST] "}.get(role) or f"[TURN {_role(role)}]"


def examples(turns: list[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(formatted text, trainable spans of characters) of each example of a conversation."""
    done, at, told = [], 0, False
    for role, text in turns:
        mark, body = opening(role), escape(text)
        done.append(mark + body + "</s>")
        told = role == "assistant"
        if told:
            yield "".join(done), [(at + len(mark), at + len(mark) + len(body))]
        at += len(done[-1])
    if turns and not told:
        yield "".join(done), []


def read(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    out, at = [], 0
    while at < len(formatted):
        end = formatted.index("</s>", at)
        if formatted.startswith("[INST] ", at):
            role, start = "user", at + 7
        elif formatted.startswith("[/INST] ", at):
            role, start = "assistant", at + 8
        else:
            m = _TURN.match(formatted, at)
            role, start, end = re.sub(r"\\(.)", r"\1", m[1], flags=re.S), m.start(2), m.end(2)
        out.append((role, unescape(formatted[start:end])))
        at = end + 4
    return out


EXAMPLES = "conv_id long, example int, n_examples int, formatted string, loss array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _conversations(batches):
    """(conv_id, turns) over batches that hold each conversation's turns in a row."""
    own, turns = None, None
    for b in batches:
        for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
            if turns is None or c != own:
                if turns:
                    yield own, turns
                own, turns = c, []
            turns.append((role or "", text or ""))
    if turns:
        yield own, turns


def _expand(batches, most: int = 4 << 20):
    rows, held = [], 0
    for conv, turns in _conversations(batches):
        last = sum(r == "assistant" for r, _ in turns) + (turns[-1][0] != "assistant")
        for k, (text, loss) in enumerate(examples(turns)):
            rows.append((conv, k, last, text, [{"start": a, "end": b} for a, b in loss]))
            held += len(text)
            if held > most:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows):
    types = [pa.int64(), pa.int32(), pa.int32(), pa.large_string(), _SPANS]
    cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
    cols[3] = cols[3].cast(pa.string())
    return pa.RecordBatch.from_arrays(cols, ["conv_id", "example", "n_examples", "formatted", "loss"])


def expand(conversations: DataFrame) -> DataFrame:
    """The examples of all conversations (conv_id, turn, role, text): (conv_id, example,
    n_examples, formatted, loss spans of characters), a conversation's in a row within a
    partition.

    Turns go by turn, ties and repeated rows by role and text; null turns first, null roles
    and texts as empty ones, a null conv_id as a conversation of its own. An empty table gives
    no rows; columns other than the four are not looked at. Turns are sorted
    and streamed, so a long conversation takes memory for its own text only.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    sorted_turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_turns.select("conv_id", "role", "text").mapInArrow(_expand, EXAMPLES)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches):
    own, loss, n, chars = None, None, 0, 0
    out = []
    for b in batches:
        for conv, k, last, text, spans in zip(*(b.column(i).to_pylist() for i in range(5))):
            if k == 0:
                own, loss, n, chars = conv, hashlib.sha256(), 0, 0
            chars += len(text)
            for s in spans:
                reply = unescape(text[s["start"]:s["end"]])
                loss.update(reply.encode("utf-8", "surrogatepass"))
                n += len(reply)
            if k == last - 1:
                turns = read(text)
                told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
                out.append((own, len(turns), told.hexdigest(), n, loss.hexdigest(), chars))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], [f.split()[0] for f in DIGEST.split(", ")])
            out = []


def digest(formatted: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read back from them."""
    return formatted.mapInArrow(_read_back, DIGEST)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') v(t, r)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digest(expand(rows))

"""Chat formatting with a grammar round trip (operator 2).

Grammar of the formatted text::

    conversation = turn*
    turn = "### " role ":\\n" body "\\n</turn>\\n"

Each turn is first rendered as it is and parsed again; if the parser does not
give back role and text, the body is escaped (one backslash more before every
control string, whatever backslashes stand there already) and the round trip
is repeated.  Escaping is undone by the parser alone.

Rendering needs one row only.  Reading back follows the formatted text of a
conversation turn by turn in one sorted pass, so a conversation may be of any
size; memory holds one turn.

Defined results: a null role or text is an empty one.  Turns are ordered by
turn (null first), then role, then text, so equal turn numbers and repeated
rows have one order.  Rows with a null conversation id form one conversation.
An empty table gives an empty result.  Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "### ", "</turn>"
#: Roles whose text bears the loss.
LOSS_ROLES = ("assistant",)

_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_ESCAPED = re.compile(r"\\(\\*)(### |</turn>)")
_TURN = re.compile(r"### ([^\n]*):\n")
_BARE = re.compile(r"(?<!\\)(?:### |</turn>)")
_ROLE_CODES = {"%": "%25", "\n": "%0A"}


def _escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """Turns as (role, text, start and end of the body), or None if the text
    is not of the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        head = _TURN.match(formatted, at)
        if head is None:
            return None
        end = _BARE.search(formatted, head.end())
        if end is None or not formatted.startswith(TAIL + "\n", end.start()) or end.start() == head.end() or formatted[end.start() - 1] != "\n":
            return None
        stop = end.start() - 1
        if stop < head.end():
            return None
        role = head[1].replace("%0A", "\n").replace("%25", "%")
        turns.append((role, unescape(formatted[head.end():stop]), head.end(), stop))
        at = end.end() + 1
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text and the place of its body in it."""
    for c, code in _ROLE_CODES.items():
        role = role.replace(c, code)
    plain_role = role.replace("%0A", "\n").replace("%25", "%")
    for body in (text, _escape(text)):
        formatted = f"{HEAD}{role}:\n{body}\n{TAIL}\n"
        back = parse(formatted)
        if back is not None and [(r, t) for r, t, _, _ in back] == [(plain_role, text)]:
            return formatted, back[0][2], back[0][3]
    raise AssertionError("an escaped turn must read back")


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, loss_from, loss_to.  The
    ``formatted`` values of a conversation in ``conversation_order`` are its
    text; the loss mask is [loss_from, loss_to) in code points of the turn,
    null for turns without loss."""
    kind = "struct<formatted:string,loss_from:int,loss_to:int>"
    fields = pa.struct([("formatted", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32())])

    @F.arrow_udf(kind)
    def rendered(roles: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for r, t in zip(roles, texts):
            r, t = r.as_py() or "", t.as_py() or ""
            f, a, b = render_turn(r, t)
            out.append({"formatted": f, "loss_from": a if r in loss_roles else None, "loss_to": b if r in loss_roles else None})
        return pa.array(out, fields)

    return (turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                         F.coalesce(text, F.lit("")).alias("text"))
            .withColumn("r", rendered(F.col("role"), F.col("text"))).select("conv_id", "turn", "role", "text", "r.*"))


def conversation_order(formatted: DataFrame) -> DataFrame:
    """Every conversation whole in one partition, its turns in order."""
    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "formatted", "loss_from", "loss_to"))


class _Digest:
    """Sums up one conversation, read back from its formatted text."""

    def __init__(self) -> None:
        self.turns, self.turn_hash = 0, hashlib.sha256()
        self.loss, self.loss_hash, self.chars = 0, hashlib.sha256(), 0

    def add(self, formatted: str, loss_from: int | None, loss_to: int | None) -> None:
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.turn_hash.update(f"{role}\n{text}\n".encode())
        self.chars += len(formatted)
        if loss_from is not None:
            text = unescape(formatted[loss_from:loss_to])
            self.loss += len(text)
            self.loss_hash.update(text.encode())


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation of the formatted turns alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches):
        key, now, done = None, None, []

        def batch():
            rows = [(k, d.turns, d.turn_hash.hexdigest(), d.loss, d.loss_hash.hexdigest(), d.chars) for k, d in done]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        for b in batches:
            for conv, text, a, z in zip(*b.columns):
                if now is None or conv.as_py() != key:
                    key, now = conv.as_py(), _Digest()
                    done.append((key, now))
                now.add(text.as_py(), a.as_py(), z.as_py())
            last = done.pop() if done else None  # may go on in the next batch
            yield batch()
            done = [last] if last else []
        yield batch()

    return conversation_order(formatted).mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                                          "loss_sha256 string, formatted_chars long")

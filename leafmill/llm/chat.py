"""Chat formatting from an event log.

Events are (conversation, turn, sequence, kind, role, text). They are partitioned by conversation and turn, sorted by sequence, and
folded into final messages: "message" begins one, with role and text; "delta" appends a streamed piece; "edit" replaces the text;
"regenerate" empties it for the deltas that follow; "delete" removes the message. Messages stream in order of conversation and
turn and are rendered; memory holds a message, never a conversation, so a hot conversation is one sequential pass.

The template: an assistant's message is <s>text</s>, any other [INST]role, line feed, text[/INST]. Inside roles and texts every control
string gets a backslash after its first character (and one more if it has some already), so no text can imitate a
mark, and taking one backslash away restores it. A loss mask covers assistants' texts, neither marks nor roles.

Defined results: null text or role is empty; events of equal sequence are taken in order of kind, role and text; other events than
"message" change the turn's last message (or begin one); rows that repeat a (conversation, turn) are messages each; null conversation ids form one conversation; very long texts are formatted whole, one at a time; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_PLAIN = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\](.*?)\n(.*?)\[/INST\]", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """Roles end at a line feed, so theirs are written as a backslash and n (and backslashes doubled)."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """The turn's part of the output, and where in it the loss mask lies (code points)."""
    if role == "assistant":
        body = escape(text)
        return f"<s>{body}</s>", (3, 3 + len(body))
    return f"[INST]{escape_role(role)}\n{escape(text)}[/INST]", None


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, read from the output alone."""
    return [("assistant", unescape(m[1])) if m[1] is not None else (unescape_role(m[2]), unescape(m[3])) for m in _TURN.finditer(formatted)]


def from_rows(rows: DataFrame) -> DataFrame:
    """An event per row of a table (conv_id, turn, role, text): whole messages."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log (conv_id, turn, seq, kind, role, text), in order within each
    partition; a conversation lies in one."""

    def run(batches):
        now: list | None = None  # conv, turn, role, pieces of text
        for b in batches:
            done: list[tuple] = []

            def close(done=done):
                if now is not None:
                    done.append((now[0], now[1], now[2], "".join(now[3])))

            for c, t, kind, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                role, text = role.as_py() or "", text.as_py() or ""
                if now is None or kind == "message" or (c, t) != (now[0], now[1]):
                    close()
                    now = None if kind == "delete" else [c, t, role, [text]]
                elif kind == "delete":
                    now = None
                else:
                    now[2] = role or now[2]
                    if kind == "delta":
                        now[3].append(text)
                    else:
                        now[3] = [text] if kind == "edit" else []
            if done:
                yield _messages(done)
        if now is not None:
            yield _messages([(now[0], now[1], now[2], "".join(now[3]))])

    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "regenerate", 1).otherwise(2)
    ordered = events.select("conv_id", "turn", "seq", "kind", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", rank, "kind", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, turn long, role string, text string")


def _messages(done: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "turn", "role", "text"])


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, nth, role, formatted, loss_from, loss_to): each turn's part of the output, in order within its conversation.

    messages: as fold() leaves them, each conversation in order in one partition. The output is the parts joined by nth."""

    def run(batches):
        import pyarrow as pa

        conv, nth = object(), 0
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                nth = nth + 1 if c == conv else 0
                conv = c
                part, mask = render_turn(role.as_py() or "", text.as_py() or "")
                for col, v in zip(cols, (nth, part, *(mask or (None, None))), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), b.column(2), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["conv_id", "nth", "role", "formatted", "loss_from", "loss_to"])

    return messages.select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, nth long, role string, formatted string, loss_from long, loss_to long")


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation, read back from render()'s output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    parts: as render() leaves them; parts that were written and read again need restored() first."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        conv: object = names  # no conversation yet
        state: list = []
        done: list[tuple] = []

        def close():
            if conv is not names:
                done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return made

        for b in batches:
            for c, part, lo, hi in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if c != conv or conv is names:
                    close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = part.as_py()
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if lo is not None:
                    said = unescape(text[lo:hi])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield out()
        close()
        if done:
            yield out()

    return parts.select("conv_id", "nth", "formatted", "loss_from", "loss_to").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def restored(parts: DataFrame) -> DataFrame:
    """Written parts, dealt and sorted as render() left them."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "nth")

"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and of the example's text
only that reply is trainable. Turns after the last reply are kept in a record without a target, so that nothing of a
conversation is lost. A turn reads BEGIN role \\n text END \\n; control strings inside roles and texts get a backslash
behind their first character, one more if they have some already, which unescape() takes away again.

Defined results: rows are ordered by turn, then role and text, so ties and repeated rows are kept and have one order;
null text and null role count as empty; a null conv_id is a conversation like others; an empty table gives no rows;
other columns are not read. Turns arrive sorted and are written as they come; of a conversation only its own text so
far is held, and the size of its examples is by nature the sum of its prefixes.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Strings that a template or a common tokenizer takes as control marks.
CONTROL = [BEGIN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ADD = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in CONTROL))
_DROP = re.compile("|".join(rf"({re.escape(c[0])})\\(\\*)({re.escape(c[1:])})" for c in CONTROL))
EXAMPLES = "conv_id long, example int, target_turn long, text string, loss_start long, loss_end long, last boolean"
#: Characters of text in one Arrow batch of examples.
BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    if "<" not in text and "[" not in text:
        return text
    return _ADD.sub(lambda m: (g := [x for x in m.groups() if x is not None])[0] + "\\" + g[1] + g[2], text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _DROP.sub(lambda m: "".join(x for x in m.groups() if x is not None), text)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out = []
    for part in text.split(BEGIN)[1:]:
        role, _, body = part.partition("\n")
        out.append((re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)), unescape(body[: -len(END) - 1])))
    return out


def _role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def expand(conversations: DataFrame) -> DataFrame:
    """One row for each assistant turn, and one without target for the turns after the last; see EXAMPLES.

    text[loss_start:loss_end] (code points) is the escaped reply; last marks the record that holds all turns.
    """

    def run(batches):
        held: list[list] = []
        done, size = [], 0
        conv, prefix, tail, n = None, [], False, 0
        started = False

        def flush():
            nonlocal done, size
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["conv_id", "example", "target_turn", "text", "loss_start", "loss_end", "last"])
            done, size = [], 0
            return out

        def close():
            """The conversation's last record goes out."""
            if tail:
                if held:
                    done.append(tuple(held.pop()))
                done.append((conv, n, None, "".join(prefix), None, None, True))
            elif held:
                held[0][-1] = True
                done.append(tuple(held.pop()))

        for b in batches:
            for c, turn, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if not started or c != conv:
                    if started:
                        close()
                    conv, prefix, tail, n, started = c, [], False, 0, True
                head, body = f"{BEGIN}{_role(role or '')}\n", escape(text or "")
                if role == "assistant":
                    if held:
                        done.append(tuple(held.pop()))
                    context = "".join(prefix) + head
                    prefix = [context, body, f"{END}\n"]
                    whole = "".join(prefix)
                    prefix = [whole]
                    held.append([c, n, turn, whole, len(context), len(context) + len(body), False])
                    size += len(whole)
                    n, tail = n + 1, False
                else:
                    prefix += [head, body, f"{END}\n"]
                    tail = True
                if size > BATCH_CHARS and done:
                    yield flush()
        if started:
            close()
        if done:
            yield flush()

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, EXAMPLES)


def read_back(examples: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of what expand() wrote, from its text and loss spans alone: one row per conversation.

    in_order: the rows come as expand() gives them; those of a table are brought into that order first.
    """
    if not in_order:
        examples = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")

    def run(batches):
        out, conv, open_ = [], None, False
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for b in batches:
            for c, text, start, end, last in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5, 6))):
                if not open_:
                    conv, open_, chars, loss, total = c, True, 0, hashlib.sha256(), 0
                total += len(text)
                if start is not None:
                    reply = unescape(text[start:end])
                    chars += len(reply)
                    loss.update(reply.encode())
                if last:
                    turns = read_turns(text)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                    out.append((conv, len(turns), digest.hexdigest(), chars, loss.hexdigest(), total))
                    open_ = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
                out = []

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Chat formatting with a grammar round trip.

A turn renders as ``[INST] role\\ntext [/INST]`` or, for the assistant, as
``<s>text</s>``.  The rendered turn is parsed back by the deterministic parser and
compared with its source; while they differ, control strings in the text (then in
the role) are escaped and the turn is rendered again.  An escape puts one more
backslash after the opening character of anything that looks like a control
string, however many it has already, so unescaping is exact.

Turns delimit themselves, so rendering is a map over rows; only the digest of a
whole conversation needs its rows in order, and it streams over sorted rows, so
a conversation of any length takes bounded memory.

Defined results: a null role or text is an empty one; rows of one conversation
with equal turns are ordered by role, then text; an empty table gives no rows;
a null conv_id is a conversation of its own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import only, small_batches

ASSISTANT = "assistant"
_CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|/?s>)")
_ROLE_BREAK = re.compile(r"(\\*)(\n|\\n)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text) if "\\" in text else text


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    if "\\" not in role:
        return role
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The turn's text under the template, and where its payload starts in it."""
    if role == ASSISTANT:
        return f"<s>{text}</s>", 3
    head = f"[INST] {role}\n"
    return f"{head}{text} [/INST]", len(head)


def parse_turns(rendered: str) -> list[tuple[str, str, int, int]]:
    """Deterministic parser: (role, text, start and end of the payload) of each turn; ValueError if malformed."""
    out, at = [], 0
    while at < len(rendered):
        if rendered.startswith("<s>", at):
            start, stop = at + 3, rendered.find("</s>", at + 3)
            role, after = ASSISTANT, stop + 4
        elif rendered.startswith("[INST] ", at):
            cut = rendered.find("\n", at)
            start, stop = cut + 1, rendered.find(" [/INST]", cut + 1)
            if cut < 0:
                raise ValueError("role without end")
            role, after = _unescape_role(rendered[at + 7 : cut]), stop + 8
        else:
            raise ValueError(f"no turn at {at}")
        if stop < 0:
            raise ValueError("turn without end")
        out.append((role, unescape(rendered[start:stop]), start, stop))
        at = after
    return out


def _recovers(rendered: str, role: str, text: str) -> bool:
    try:
        found = parse_turns(rendered)
    except ValueError:
        return False
    return len(found) == 1 and found[0][:2] == (role, text)


def format_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """Rendered turn, payload start and end, and how many escape rounds it took."""
    tries = ((role, text), (role, escape(text)), (_escape_role(role), escape(text)))
    for rounds, (r, t) in enumerate(tries):
        if rounds == 2 and role == ASSISTANT:
            break
        # A role other than the assistant's must not turn into it, and the reverse.
        rendered, start = render_turn(r, t)
        if _recovers(rendered, role, text):
            return rendered, start, start + len(t), rounds
    raise AssertionError("a fully escaped turn always parses back")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, rendered, loss_start, loss_end, escape_rounds.

    A conversation's formatted text is its ``rendered`` strings in order; the loss
    mask of a turn is the code points ``[loss_start, loss_end)`` of its rendered text
    (both 0 where the turn is not the assistant's).
    """
    src = only(conversations, conv_id="long", turn="long", role="string", text="string")
    src = src.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    small_batches(src.sparkSession)

    def run(batches):
        for b in batches:
            out = [format_turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            mask = [r == ASSISTANT for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:4],
                    pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] * m for x, m in zip(out, mask, strict=True)], pa.int64()),
                    pa.array([x[2] * m for x, m in zip(out, mask, strict=True)], pa.int64()),
                    pa.array([x[3] for x in out], pa.int32()),
                ],
                names=["conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end", "escape_rounds"],
            )

    return src.mapInArrow(
        run,
        "conv_id long, turn long, role string, text string, rendered string, loss_start long, loss_end long, escape_rounds int",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, taken from the rendered text alone.

    The rows are dealt by conversation and sorted; each task streams them, so no
    conversation is held in memory.
    """
    rows = formatted.select("conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end")
    # The order ties break on role and text, which are shuffled only as far as sorting needs them.
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", "rendered", "loss_start", "loss_end")

    def run(batches):
        cols: list[list] = [[] for _ in range(6)]
        key, state = object(), None

        def close():
            if state is not None:
                for c, v in zip(cols, (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), strict=True):
                    c.append(v)

        def flush():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            for c in cols:
                c.clear()
            return batch

        for b in batches:
            for conv, rendered, lo, hi in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse_turns(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                under = unescape(rendered[lo:hi])
                state[2] += len(under)
                state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(rendered)
            if cols[0]:
                yield flush()
        close()
        if cols[0]:
            yield flush()

    return rows.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op1_query(spark, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, ASSISTANT, probe)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(table.unionByName(extra)))


#: The same digests, straight from the source rows (formatted_chars: template length, escapes of conversation -7 added).
ORACLE = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(text) + CASE WHEN role = 'assistant' THEN 7 ELSE 16 + length(role) END
      + CASE WHEN conv_id = -7 THEN 3 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM src GROUP BY conv_id
"""

r"""Chat formatting with a grammar round trip.

The template marks a turn as ``<|im_start|>role\ntext<|im_end|>\n``. A deterministic parser reads what was rendered;
every turn that does not come back as it was gets its conflicting content escaped (a backslash after the first
character of a control string, before the backslashes that stand there already), and the whole is rendered and
parsed again until all turns are identical. The parser takes one such backslash away and accepts no bare control
string in a text. A role stands on one line: its backslashes are doubled and its line breaks are ``\\n``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that no text may hold bare: the template's own and those of other common templates.
CONTROLS = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
#: A conversation is rendered and reparsed in runs of about so many characters; runs follow one another in the output.
RUN_CHARS = 1 << 20

_BODIES = "|".join(sorted((re.escape(c[1:]) for c in CONTROLS), key=len, reverse=True))
_HEADS = "".join(sorted({"\\" + c[0] for c in CONTROLS}))
#: A control string with any number of escapes after its first character.
CONFLICT = re.compile(rf"([{_HEADS}])({re.escape(ESCAPE)}*)(?={_BODIES})")


def _is_control(head: str, text: str, at: int) -> bool:
    return any(c[0] == head and text.startswith(c[1:], at) for c in CONTROLS)


def escaped(text: str) -> str:
    return CONFLICT.sub(lambda m: m[1] + ESCAPE + m[2] if _is_control(m[1], m.string, m.end()) else m[0], text)


def unescaped(text: str) -> str:
    return CONFLICT.sub(lambda m: m[1] + m[2][len(ESCAPE) :] if m[2] and _is_control(m[1], m.string, m.end()) else m[0], text)


class GrammarError(ValueError):
    def __init__(self, turn: int):
        super().__init__(f"turn {turn} can't be parsed")
        self.turn = turn


def rendered_turn(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def on_one_line(role: str) -> str:
    return role.replace(ESCAPE, ESCAPE * 2).replace("\n", ESCAPE + "n")


def _role_of(line: str, turn: int) -> str:
    """The role that stands on a line; raises where a backslash stands before anything else than a backslash or n."""
    if re.search(r"(?<!\\)(?:\\\\)*\\(?![\\n])", line):
        raise GrammarError(turn)
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else ESCAPE, line)


def parsed(output: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end delimit the text as it stands in the output."""
    turns, at = [], 0
    while at < len(output):
        line = output.find("\n", at)
        end = output.find(END, line + 1)
        if not output.startswith(START, at) or line < 0 or end < 0 or output[end + len(END) : end + len(END) + 1] != "\n":
            raise GrammarError(len(turns))
        role, body = output[at + len(START) : line], output[line + 1 : end]
        for part in (role, body):
            if any(not m[2] and _is_control(m[1], m.string, m.end()) for m in CONFLICT.finditer(part)):
                raise GrammarError(len(turns))
        turns.append((_role_of(unescaped(role), len(turns)), unescaped(body), line + 1, end))
        at = end + len(END) + 1
    return turns


def _comes_back(turn: tuple[str, str], shown: str) -> bool:
    try:
        return [t[:2] for t in parsed(shown)] == [turn]
    except GrammarError:
        return False


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The rendered turns and what the parser reads from them, which is the same turns.

    A turn that comes back by itself also does among others, as the parser looks at nothing beyond its end. So every turn
    is tried once, those that fail are escaped, and the whole is parsed once.
    """
    shown = [rendered_turn(on_one_line(r), t) for r, t in turns]
    for k, turn in enumerate(turns):
        if not _comes_back(turn, shown[k]):
            shown[k] = rendered_turn(escaped(on_one_line(turn[0])), escaped(turn[1]))
    output = "".join(shown)
    back = parsed(output)
    if [b[:2] for b in back] != turns:
        raise ValueError("the rendered turns don't come back")
    return output, back


def formatted(turns: list[tuple[str, str]]) -> str:
    """The rendered turns, each escaped only if it needs it."""
    return rendered(turns)[0]


_OUT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))])
OUT_DDL = "conv_id long, part int, formatted string, loss array<struct<first: long, end: long>>"


def _format(batches: Iterator[pa.RecordBatch], learned: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn; a long conversation goes out in several parts."""
    held: list[tuple[str, str]] = []
    now, part, chars, rows, size = object(), 0, 0, [], 0

    def flush() -> None:
        text, back = rendered(held)
        loss = [{"first": a, "end": b} for role, _, a, b in back if role == learned]
        rows.append({"conv_id": now, "part": part, "formatted": text, "loss": loss})
        held.clear()

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != now or chars > RUN_CHARS:
                if held:
                    flush()
                    size += chars
                part, chars, now = part + 1 if conv == now else 0, 0, conv
            held.append((role or "", text or ""))
            chars += len(role or "") + len(text or "") + len(rendered_turn("", ""))
            if len(rows) >= 256 or size > 4 * RUN_CHARS:
                yield pa.RecordBatch.from_pylist(rows, schema=_OUT)
                rows, size = [], 0
    if held:
        flush()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_OUT)


def format_conversations(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, part, formatted, loss) from turns (conv_id, turn, role, text); loss has the spans of the learned role's texts.

    Turns go by (turn, role, text), null turn first; null role and text are empty; rows without conv_id are one
    conversation with a null id; repeated rows are repeated turns. Parts of a conversation follow one another, and
    come in order within a partition. No row of a conversation is held longer than its part; a part has about RUN_CHARS rendered
    characters, whatever its turns hold. A conversation is the work of one task, which reads it as a stream.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return rows.select("conv_id", "role", "text").mapInArrow(lambda it: _format(it, learned), OUT_DDL)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state, rows = object(), None, []

    def close() -> None:
        if state:
            rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for r in batch.to_pylist():
            if r["conv_id"] != now:
                close()
                now, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, *_ in parsed(r["formatted"]):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in r["loss"]:
                text = unescaped(r["formatted"][span["first"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(r["formatted"])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)
        rows = []
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_back(output: DataFrame) -> DataFrame:
    """Digests of each conversation from the output of format_conversations, whose order it relies on."""
    return output.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation that always comes with the table.
PROBE = "</s>[INST] ok [/INST]"


def op4_chat_format(spark, sf_dir) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{PROBE}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return read_back(format_conversations(turns.unionByName(probe)))


#: The same rows in DuckDB; a turn adds 12 + 1 + 10 + 1 characters, one for each control string in it and one for each backslash or line break in its role.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, len(regexp_extract_all(role || chr(10) || text, '<\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])')) AS marks FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(role) - length(translate(role, chr(92) || chr(10), '')) + length(text) + marks)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

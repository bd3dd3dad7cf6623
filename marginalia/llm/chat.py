"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns.  Prefix sums of turn tokens choose
the spans: a window takes turns while its system turn, its history and its own turns
fit the budget; a turn that does not fit alone is a window by itself, the only kind
over the budget.  Later windows repeat the system turn and the last ``history`` turns
before their own, as far as these leave room for their first own turn: the oldest
turns of the history go first, the system turn last.  The loss
mask covers assistant texts of a window's own turns only, so that repeated targets
are masked and every assistant text counts once.

Template: ``[INST]role\\ntext[/INST]`` for user turns, ``<s>role\\ntext</s>`` for all
others.  Inside roles and texts a control string gets a backslash after its first
character, and one more if it already had some, so that it can be taken back; a line
end in a role becomes ``\\n`` written out, its backslashes doubled.

Windows stream: turns are dealt by conversation and sorted on disk, and a task holds
the system turn, the history and one window at a time.

Defined results.  Null role, text and turn count as empty, empty and first; rows with
a null ``conv_id`` form one conversation.  Equal turns are ordered by role, then text;
repeated rows are turns of their own.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 2

_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_TOKEN = re.compile(r"[^\x00-\x20]+")
_TURN = re.compile(r"(?:\[INST\](.*?)\[/INST\]|<s>(.*?)</s>)", re.S)

SCHEMA = "conv_id long, window int, text string, loss array<struct<start:int,end:int>>, n_repeated int"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def n_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text starts and ends."""
    first, last = ("[INST]", "[/INST]") if role == "user" else ("<s>", "</s>")
    head, body = f"{first}{_role(role)}\n", escape(text)
    return f"{head}{body}{last}", len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """Roles and texts of a window's turns, read back from the template."""
    turns = []
    for m in _TURN.finditer(window):
        role, _, text = (m[1] if m[1] is not None else m[2]).partition("\n")
        turns.append((_unrole(role), unescape(text)))
    return turns


def windows_of(turns: Iterator[tuple[str, str]], budget: int, history: int) -> Iterator[tuple[int, str, list[dict], int]]:
    """``window, text, loss, n_repeated`` over the ordered turns of one conversation."""
    system: tuple[str, str] | None = None
    before: deque = deque(maxlen=history)
    own: list[tuple[str, str]] = []
    carried: list[tuple[str, str]] = []
    # Tokens of all turns so far, and what of them lies before the window less what it repeats.
    total, opened, number, seen = 0, 0, 0, 0

    def close() -> tuple[int, str, list[dict], int]:
        parts, loss, at = [], [], 0
        for i, (role, text) in enumerate([*carried, *own]):
            piece, lo, hi = render(role, text)
            if i >= len(carried) and role == "assistant":
                loss.append({"start": at + lo, "end": at + hi})
            parts.append(piece)
            at += len(piece)
        return number, "".join(parts), loss, len(carried)

    for role, text in turns:
        size = n_tokens(text)
        if own and total + size - opened > budget:
            yield close()
            before.extend(own)
            number += 1
            recent = list(before)
            # The system turn comes first, also when the history still reaches it.
            kept = [system] if system is not None else []
            recent = recent[1:] if kept and seen <= len(recent) else recent
            carried = [*kept, *recent]
            while carried and sum(n_tokens(t) for _, t in carried) + size > budget:
                carried.pop(len(kept) if len(carried) > len(kept) else 0)
            own, opened = [], total - sum(n_tokens(t) for _, t in carried)
        if seen == 0 and role == "system":
            system = (role, text)
        own.append((role, text))
        total += size
        seen += 1
    if own:
        yield close()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _by_first(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``key, iterator of its rows`` for rows that come grouped by their first field."""
    held = next(rows, None)
    while held is not None:
        key = held[0]

        def same(key=key):
            nonlocal held
            while held is not None and held[0] == key:
                yield held[1:]
                held = next(rows, None)

        mine = same()
        yield key, mine
        for _ in mine:
            pass


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most about ``most`` characters."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, window, text, loss, n_repeated``: loss spans are code points of ``text``, ends exclusive."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss", span), ("n_repeated", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((conv, *w) for conv, mine in _by_first(_groups(batches)) for w in windows_of(mine, budget, history))
        yield from _batches(made, schema)

    return dealt.mapInArrow(run, SCHEMA)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say when read back: turn and loss digests, lengths."""
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "text", "loss", "n_repeated")
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
             ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, mine in _by_first(_groups(batches)):
            turns, targets, n, chars, size, count = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for text, loss, repeated in mine:
                for role, said in parse(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for s in loss:
                    target = unescape(text[s["start"] : s["end"]])
                    targets.update(target.encode("utf-8", "surrogatepass"))
                    chars += len(target)
                size += len(text)
                count += 1
            yield conv, n, turns.hexdigest(), chars, targets.hexdigest(), size, count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(read(batches), pa.schema(kinds))

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")

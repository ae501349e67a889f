"""Chat formatting at the level of tokens: segments are encoded alone, reserved ids are spliced between them.

Every turn becomes TURN role BODY text END (ANSWER in place of BODY for an assistant). The markers are ids above the
vocabulary, so no text can produce them; control strings inside a text are escaped as well, reversibly, so that the
rendered form is safe too. The loss mask is derived from the finished ids by prefix sums: +1 at an ANSWER, -1 at the
END that closes it. A conversation is written as chunks of whole turns, so a conversation of any length is assembled
and read back as a stream in bounded memory.

Defined results: null role or text is empty; turns with the same number are ordered by role and a hash of the text; a null conv_id is
a conversation of its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.tokens import encoder

# Strings that mark turns in this or other common templates.
CONTROL = [
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|body|>", "<|answer|>", "<|end|>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
]
MARKERS = ["<|turn|>", "<|body|>", "<|answer|>", "<|end|>"]
#: Turns are gathered into a chunk up to this many tokens (a longer turn is a chunk of its own).
CHUNK_TOKENS = 200_000

_RUN = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True)))


def escape(text: str) -> str:
    """A backslash behind the first character of each control string; one more where there are some."""
    return _RUN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _RUN.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def reserved_ids(tokenizer: str) -> dict[str, int]:
    first = encoder(tokenizer, True).plain.get_vocab_size()
    return {m: first + k for k, m in enumerate(MARKERS)}


def loss_mask(ids: np.ndarray, reserved: dict[str, int]) -> np.ndarray:
    """True on the ids between an ANSWER and its END."""
    opens = ids == reserved["<|answer|>"]
    ends = np.flatnonzero(ids == reserved["<|end|>"])
    answered = opens[np.flatnonzero(opens | (ids == reserved["<|body|>"]))]
    step = opens.astype(np.int64)
    step[ends[answered[: len(ends)]]] -= 1
    return (np.cumsum(step) > 0) & ~opens


def _encoded(turns: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, role, hash of the text, ids of the whole turn with its markers (little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, reserved = encoder(tokenizer, True), reserved_ids(tokenizer)
        turn, body, answer, end = (np.array([reserved[m]], np.uint32) for m in MARKERS)
        for batch in batches:
            for part in slices(batch):
                roles = [r or "" for r in part.column("role").to_pylist()]
                ids, at = coder.encode(pa.array([escape(t or "") for t in part.column("text").to_pylist()], pa.string()))
                names, name_at = coder.encode(pa.array([escape(r) for r in roles], pa.string()))
                out = [
                    np.concatenate((turn, names[name_at[k] : name_at[k + 1]], answer if r == "assistant" else body, ids[at[k] : at[k + 1]], end)).tobytes()
                    for k, r in enumerate(roles)
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv_id", "turn", "role", "_h")), pa.array(out, pa.binary())], ["conv_id", "turn", "role", "_h", "ids"])

    sent = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text", F.xxhash64("text").alias("_h"))
    return sent.mapInArrow(run, "conv_id long, turn long, role string, _h long, ids binary")


def format_chats(turns: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, chunk, input_ids, loss_mask: whole turns in order, chunk after chunk."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reserved = reserved_ids(tokenizer)
        conv, chunk, held, size, begun = None, 0, [], 0, False
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal held, size, chunk
            if held:
                ids = np.frombuffer(b"".join(held), np.uint32)
                rows.append((conv, chunk, ids.astype(np.int32), loss_mask(ids, reserved)))
                held, size, chunk = [], 0, chunk + 1

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "chunk", "input_ids", "loss_mask"])

        for batch in batches:
            for own, ids in zip(batch.column("conv_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if not begun or own != conv or size + len(ids) // 4 > CHUNK_TOKENS:
                    flush()
                    chunk = chunk if begun and own == conv else 0
                    conv, begun = own, True
                held.append(ids)
                size += len(ids) // 4
                if sum(len(r[2]) for r in rows[-64:]) > CHUNK_TOKENS or len(rows) >= 1000:
                    yield batch_of()
                    rows.clear()
        flush()
        if rows:
            yield batch_of()

    placed = _encoded(turns, tokenizer).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "_h")
    return placed.select("conv_id", "ids").mapInArrow(assemble, "conv_id long, chunk int, input_ids array<int>, loss_mask array<boolean>")


def digests(chats: DataFrame, tokenizer: str) -> DataFrame:
    """Reads formatted chats back: the turns' and the masked text's SHA-256, sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, reserved = encoder(tokenizer, True), reserved_ids(tokenizer)
        turn, body, answer, end = (reserved[m] for m in MARKERS)
        text = lambda ids: coder.plain.decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""
        state, rows = None, []

        def close() -> None:
            if state:
                rows.append((state["conv"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

        def done() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for k in range(batch.num_rows):
                conv = batch.column("conv_id")[k].as_py()
                ids = batch.column("input_ids")[k].values.to_numpy()
                mask = batch.column("loss_mask")[k].values.to_numpy(zero_copy_only=False)
                if state is None or state["conv"] != conv:
                    close()
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0}
                starts, bodies, ends = np.flatnonzero(ids == turn), np.flatnonzero((ids == body) | (ids == answer)), np.flatnonzero(ids == end)
                for a, b, c in zip(starts.tolist(), bodies.tolist(), ends.tolist(), strict=True):
                    role, said = text(ids[a + 1 : b]), text(ids[b + 1 : c])
                    state["turns"].update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                    state["n"] += 1
                    state["all"] += len(role) + len(said) + sum(len(MARKERS[int(ids[x]) - turn]) for x in (a, b, c))
                edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    said = unescape(text(ids[a:b]))
                    state["loss"].update(said.encode())
                    state["chars"] += len(said)
            if len(rows) >= 1000:
                yield done()
                rows.clear()
        close()
        if rows:
            yield done()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, schema)


def render(ids: list[int], tokenizer: str) -> str:
    """The formatted text of a chunk of ids."""
    coder, reserved = encoder(tokenizer, True), {v: k for k, v in reserved_ids(tokenizer).items()}
    out, held = [], []
    for i in [*ids, -1]:
        if i in reserved or i == -1:
            out += [coder.plain.decode(held, skip_special_tokens=False) if held else "", reserved.get(i, "")]
            held = []
        else:
            held.append(i)
    return "".join(out)

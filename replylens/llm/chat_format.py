r"""Chat formatting with a loss mask aligned to token offsets.

A turn is rendered as ``### Role: text </turn>`` and a line feed. Inside roles and texts
a backslash, ``###`` and ``</turn>`` get a backslash in front (in roles a colon as
well), so control strings can be told from text and everything can be read back.

A conversation is rendered whole and encoded once. Token offsets are the running sums
of token lengths in bytes; the spans of the turns are known from rendering. Binary
search in the sorted offsets finds the tokens of each span. A token that sticks out of
a span (white space may join text and markup) is in the mask with the bytes inside.

Conversations stream through their task. One that is longer than ``PIECE`` becomes several
rows, cut between turns where tokens part anyway, so its pieces joined are what encoding
it in one go gives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import ByteBPE, shared_encoder

OPEN, CLOSE = "### ", " </turn>\n"
LEARNED = "assistant"
#: code points that are encoded at once; a conversation is cut at a turn's end, where a
#: line feed and "#" always part tokens
PIECE = 1 << 20
#: conversations that are encoded together
HELD = 1 << 9
_ESCAPE = re.compile(r"\\|###|</turn>")
_ESCAPE_ROLE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*?) </turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, byte spans of the learned turns' texts, in order) of (role, text) turns."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{OPEN}{_ESCAPE_ROLE.sub(lambda m: chr(92) + m[0], role or '')}: "
        body = escape(text or "")
        start = at + len(head.encode())
        end = start + len(body.encode())
        if role == LEARNED:
            spans.append((start, end))
        at = end + len(CLOSE)
        parts += (head, body, CLOSE)
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(text):
        match = _TURN.match(text, at)
        if not match:
            raise ValueError(f"no turn at code point {at}")
        turns.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    return turns


def loss_mask(lengths: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Rows (token, first byte, last byte + 1) for every token of every span, the bytes
    counted in the conversation and cut to the span."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    span = np.array(spans, np.int64).reshape(-1, 2)
    span = span[span[:, 1] > span[:, 0]]
    first = np.searchsorted(ends, span[:, 0], "right")
    last = np.searchsorted(starts, span[:, 1], "left")
    count = last - first
    owner = np.repeat(np.arange(len(span)), count)
    token = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    return np.stack(
        [token, np.maximum(starts[token], span[owner, 0]), np.minimum(ends[token], span[owner, 1])], 1
    )


def encode(
    bpe: ByteBPE, rendered: list[tuple[str, list[tuple[int, int]]]]
) -> list[tuple[list[int], np.ndarray]]:
    """(ids, loss mask) of each of some rendered conversations."""
    out = []
    for ids, (_, spans) in zip(bpe.encode([text for text, _ in rendered]), rendered):
        lengths = np.fromiter((len(bpe.tokens[i]) for i in ids), np.int64, len(ids))
        out.append((ids, loss_mask(lengths, spans)))
    return out


def masked_bytes(bpe: ByteBPE, ids: list[int], mask: np.ndarray) -> bytes:
    """What the mask covers, out of the tokens themselves."""
    starts = np.cumsum([0, *(len(bpe.tokens[i]) for i in ids)])
    return b"".join(
        bpe.tokens[ids[t]][a - starts[t] : b - starts[t]] for t, a, b in mask.tolist()
    )


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, number, its turns, their size) of the pieces of sorted conversations."""
    now, number, turns, size = None, 0, [], 0
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
            if turns and (conv_id != now or size >= PIECE):
                yield now, number, turns, size
                number, turns, size = number + 1, [], 0
            if conv_id != now:
                now, number = conv_id, 0
            turns.append((role, text))
            size += len(text or "")
    if turns:
        yield now, number, turns, size


def format_conversations(turns: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """One row per conversation, or several for long ones: conv_id, piece (from 0),
    formatted (text), ids, and the loss mask as mask_tokens (places in ids) with
    mask_starts and mask_ends (bytes of formatted).

    Rows are ordered by turn, then role and text (ties, repeated rows all count); nulls
    come first. A null role or text is empty; null conv_ids are one conversation. Only
    texts of role ``assistant`` are in the mask. Extra columns are ignored, an empty table
    gives no rows. A piece ends with the turn that brings it to ``PIECE`` code points, so
    a row holds that and one text at most. Pieces come out in order, those of one
    conversation next to each other in one partition.
    """
    encoder = shared_encoder(turns.sparkSession, rank_path, pattern)
    rows = (
        turns.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    kinds = [
        to_arrow_type(rows.schema["conv_id"].dataType),
        *(pa.int32(), pa.string(), pa.list_(pa.int32())),
        *[pa.list_(pa.int64())] * 3,
    ]
    names = ["conv_id", "piece", "formatted", "ids", "mask_tokens", "mask_starts", "mask_ends"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder.load()

        def flush(held: list[tuple]) -> pa.RecordBatch:
            rendered = [render(said) for _, _, said in held]
            out = [
                (conv_id, piece, text, ids, *mask.T)
                for (conv_id, piece, _), (text, _), (ids, mask) in zip(held, rendered, encode(bpe, rendered))
            ]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

        held, total = [], 0
        for conv_id, number, said, size in _pieces(batches):
            held.append((conv_id, number, said))
            total += size
            if total >= PIECE or len(held) >= HELD:
                yield flush(held)
                held, total = [], 0
        if held:
            yield flush(held)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"conv_id {kind}, piece int, formatted string, ids array<int>, mask_tokens array<bigint>, "
        "mask_starts array<bigint>, mask_ends array<bigint>",
    )


class _Digests:
    """What the pieces of one conversation say, as they pass by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.loss_chars = self.formatted = self.n_turns = self.n_tokens = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, bpe: ByteBPE, ids: list[int], mask: np.ndarray) -> None:
        back = bpe.decode(ids).decode()
        for role, said in parse(back):
            self.all.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        learned = unescape(masked_bytes(bpe, ids, mask).decode())
        self.loss.update(learned.encode())
        self.loss_chars += len(learned)
        self.formatted += len(back)
        self.n_tokens += len(ids)

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.all.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.formatted, self.n_tokens)


def read_back(formatted: DataFrame, rank_path: str, pattern: str, in_order: bool = False) -> DataFrame:
    """What the token ids and loss masks of formatted conversations say, one row per
    conv_id: n_turns, turns_sha256 (role, line feed, text, line feed per turn), loss_chars,
    loss_sha256 (text under the mask, unescaped), formatted_chars, n_tokens.

    ``formatted`` has the columns of ``format_conversations``; its texts are not read, only
    ids and masks. With ``in_order`` the rows are as that function gives them, otherwise
    they are sorted first. Null conv_ids are one conversation; no rows give no rows.
    """
    encoder = shared_encoder(formatted.sparkSession, rank_path, pattern)
    masks = ["mask_tokens", "mask_starts", "mask_ends"]
    rows = formatted.select("conv_id", "piece", "ids", *masks)
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    kind = rows.schema["conv_id"].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["conv_id"].dataType)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
    kinds = [id_type, *[pa.int64(), pa.string()] * 2, pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder.load()
        now: _Digests | None = None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names)

        for batch in batches:
            for i, conv_id in enumerate(batch.column("conv_id").to_pylist()):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Digests(conv_id)
                mask = np.stack([batch.column(x)[i].values.to_numpy() for x in masks], 1)
                now.add(bpe, batch.column("ids")[i].values.to_pylist(), mask)
            if done:
                yield out()
                done = []
        if now is not None:
            done.append(now.row())
            yield out()

    return rows.mapInArrow(
        run,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint, n_tokens bigint",
    )

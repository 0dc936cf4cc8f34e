"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn stands between control strings on
lines of its own, and control strings inside texts are escaped so that they can
be told apart and restored. The rendered text is encoded once with offsets. A
turn's text is a span of characters; the spans of assistant turns and those of
tokens are both sorted, so the tokens under the loss mask are found by binary
search.

Turns are dealt by conversation, sorted, and streamed through the tasks. A very
long conversation passes in runs of whole turns, so that it is never held whole.
A run ends with the newline after a turn and the next begins with "<": byte-level
tokenizers split a text there before they look for tokens, so the ids and the
mask of the runs are, put together, those of the whole text encoded once. One
conversation's digests are one sequential pass over its turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings around the turns of each role; other roles are named in
#: a [TURN] mark.
OPEN = {"user": "<s>[INST] ", "assistant": "<s>[ANSWER] ", "system": "<s>[SYS] "}
CLOSE = {"user": " [/INST]", "assistant": " [/ANSWER]</s>", "system": " [/SYS]"}
_OTHER = ("<s>[TURN ", "] ", " [/TURN]")
_NAMES = r"(?:s>|/s>|INST\]|/INST\]|ANSWER\]|/ANSWER\]|SYS\]|/SYS\]|TURN |/TURN\])"
_CONTROL = re.compile(rf"([<\[])(\\*)(?={_NAMES})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_NAMES})")
_TURN = re.compile(r"<s>\[(INST|ANSWER|SYS)\] (.*?) \[/\1\](?:</s>)?|<s>\[TURN (.*?)\] (.*?) \[/TURN\]", re.S)
_ROLE = {"INST": "user", "ANSWER": "assistant", "SYS": "system"}

#: Turns are held together up to this many characters.
RUN_CHARS = 200_000


def escape(text: str) -> str:
    """Puts a backslash into each control string, after its first character; one
    more where backslashes stand there already, so nothing is lost."""
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """One turn, and where its text begins and ends in it."""
    body = escape(text or "")
    if role in OPEN:
        head, tail = OPEN[role], CLOSE[role]
    else:
        name = json.dumps(role)
        for c in "<[]":
            name = name.replace(c, f"\\u{ord(c):04x}")
        head, tail = _OTHER[0] + name + _OTHER[1], _OTHER[2]
    return head + body + tail + "\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """The (role, text) turns of a rendered conversation."""
    out = []
    for m in _TURN.finditer(formatted):
        if m[1]:
            out.append((_ROLE[m[1]], unescape(m[2])))
        else:
            out.append((json.loads(m[3]), unescape(m[4])))
    return out


def loss_tokens(ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie, with any character, in one of the sorted spans. A token
    reaches from the end of the one before to its own end, so tokens cover the
    text even where an encoder leaves white space out of its offsets."""
    starts = np.r_[0, ends[:-1]]
    mask = np.zeros(len(ends), bool)
    first = np.searchsorted(ends, spans[:, 0], side="right")
    stop = np.searchsorted(starts, spans[:, 1], side="left")
    edge = np.zeros(len(ends) + 1, np.int64)
    some = stop > first
    np.add.at(edge, first[some], 1)
    np.add.at(edge, stop[some], -1)
    mask[:] = np.cumsum(edge[:-1]) > 0
    return mask


def masked_text(text: str, ends: np.ndarray, mask: np.ndarray, spans: np.ndarray) -> list[str]:
    """What the masked tokens hold of each span."""
    starts = np.r_[0, ends[:-1]]
    out = []
    for lo, hi in spans:
        i, j = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(starts, hi, side="left"))
        out.append("".join(text[max(lo, starts[k]) : min(hi, ends[k])] for k in range(i, j) if mask[k]) if not mask[i:j].all() else text[max(lo, starts[i]) : min(hi, ends[j - 1])] if j > i else "")
    return out


class _Encoder:
    def __init__(self, path: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True

    def ends(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        out = []
        for text, e in zip(texts, self.tok.encode_batch(texts, add_special_tokens=False), strict=True):
            ends = np.maximum.accumulate(np.array([b for _, b in e.offsets], np.int64)) if e.ids else np.empty(0, np.int64)
            if len(ends):
                ends[-1] = len(text)
            out.append((e.ids, ends))
        return out


_RUN = "conv_id {kind}, run long, formatted string, ids array<int>, loss array<boolean>, loss_texts array<string>"


def _format(path: str | None, run_chars: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        now, run, held, size, made = object(), 0, [], 0, []

        def emit() -> None:
            nonlocal held, size, run
            if held:
                made.append((now, run, held))
                held, size, run = [], 0, run + 1

        def out() -> pa.RecordBatch:
            nonlocal enc, made
            enc = enc or _Encoder(path)
            rows = []
            for conv, number, turns in made:
                text, spans, at = [], [], 0
                for role, body in turns:
                    shown, lo, hi = render(role, body)
                    if role == "assistant" and hi > lo:
                        spans.append((at + lo, at + hi))
                    text.append(shown)
                    at += len(shown)
                rows.append((conv, number, "".join(text), np.array(spans, np.int64).reshape(-1, 2)))
            ids, masks, texts = [], [], []
            for (token_ids, ends), r in zip(enc.ends([r[2] for r in rows]), rows, strict=True):
                mask = loss_tokens(ends, r[3])
                ids.append(token_ids)
                masks.append(mask.tolist())
                texts.append(masked_text(r[2], ends, mask, r[3]))
            made = []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())), pa.array(texts, pa.list_(pa.string()))],
                ["conv_id", "run", "formatted", "ids", "loss", "loss_texts"],
            )

        kind = pa.int64()
        total = 0
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if conv != now or (size and size + len(text or "") > run_chars):
                    emit()
                    if conv != now:
                        now, run = conv, 0
                    if total > 2_000_000:
                        yield out()
                        total = 0
                held.append((role, text))
                size += len(text or "") + 32
                total += len(text or "") + 32
        emit()
        if made:
            yield out()

    return go


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer_path: str | None = None, run_chars: int = RUN_CHARS) -> DataFrame:
    """One row per run of a conversation (nearly always the whole one): conv_id,
    run (from 0), formatted, ids (tokens), loss (per token, whether it is under
    the loss mask) and loss_texts (what the masked tokens hold of each assistant
    text, still escaped).

    Turns are ordered by turn, nulls first, then role and text, which settles
    ties; repeated rows are turns of their own. A null text is empty; an empty
    assistant text has no token under the mask. Roles other than user, assistant
    and system, also null, are kept in a mark of their own. Null conversation
    ids are one conversation. A conversation beyond `run_chars` characters comes
    in runs of whole turns, which together are its formatted text, ids and mask
    (for tokenizers that split at the newline between turns, as byte-level ones
    do; for others give a run_chars that no conversation has). Other
    columns are ignored. An empty table gives an empty result. tokenizer_path
    names a tokenizers JSON file that every executor can read; by default the
    public byte-level one is used.
    """
    kind = dict(turns.select(conv_col).dtypes)[conv_col]
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format(tokenizer_path, run_chars), _RUN.format(kind=kind)).withColumnRenamed("conv_id", conv_col)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the runs back, in order, and sums each conversation up."""
    done, state, now = [], None, object()

    def close() -> None:
        if state:
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5], state[6]))

    def out() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
        return pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else None) for i, c in enumerate(cols)], names)

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, formatted, loss_texts, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_texts", "loss")), strict=True):
            if conv != now:
                close()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role or ''}\n{text}\n".encode("utf-8", "surrogatepass"))
            for text in loss_texts:
                text = unescape(text)
                state[2] += len(text)
                state[3].update(text.encode("utf-8", "surrogatepass"))
            state[4] += len(formatted)
            state[5] += len(loss)
            state[6] += sum(loss)
        if len(done) >= 5000:
            yield out()
            done = []
    close()
    if done:
        yield out()


def chat_digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation of format_chats, read back from its output: n_turns,
    turns_sha256 (role, newline, text, newline per turn), loss_chars and
    loss_sha256 (all text under the mask, unescaped), formatted_chars, n_tokens
    and n_loss_tokens. A null role is hashed as the empty one."""
    kind = dict(formatted.select(conv_col).dtypes)[conv_col]
    rows = formatted.withColumnRenamed(conv_col, "conv_id").repartition("conv_id").sortWithinPartitions("conv_id", "run")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    return rows.select("conv_id", "formatted", "loss_texts", "loss").mapInArrow(_digests, schema).withColumnRenamed("conv_id", conv_col)


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], turns.schema)
    return chat_digests(format_chats(turns.unionByName(extra)))



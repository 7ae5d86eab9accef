"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one text, encoded once with offsets, and the loss mask of
its tokens comes from intersecting the sorted spans of assistant texts with the sorted
spans of tokens by binary search.

The template: each turn is ``### `` role ``<turn>`` text ``</turn>``.  So that control
strings inside roles and texts can't be taken for the template's own, backslashes break them
up: before each backslash, before each ``#`` of a run of three or more, and after the ``<`` of
``<turn>`` and ``</turn>``.  Taking the backslashes away gives the text back.  Marks are tokens
of their own (added to the tokenizer as it is loaded; nothing is trained), so no token lies
across the edge of a turn's text.

A conversation is one row of the result, so its turns are gathered; that is the operator's
unit, as a mask needs the whole text before it.  Turns are grouped by a shuffle on the conversation, no text goes anywhere else, and
each goes to Python once.

Cases: a null text or role is empty; turns with the same number are in the order of role,
then text; repeated rows are repeated turns; an empty assistant text has no tokens; a null
conversation id is a conversation of its own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, MIDDLE, CLOSE = "### ", "<turn>", "</turn>"
LEARNT = "assistant"
CONTROL = re.compile(r"\\|#{3,}|</?turn>")
ESCAPED = re.compile(r"\\(.)", re.S)
#: An escape or a mark, for reading back.
MARK = re.compile(r"\\.|(### )|(<turn>)|(</turn>)", re.S)


def _broken(m: re.Match) -> str:
    return m[0][0] + "\\" + m[0][1:] if m[0][0] == "<" else "".join("\\" + c for c in m[0])


def escape(text: str) -> str:
    return CONTROL.sub(_broken, text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The text, and for each turn the span of its text and whether it is learnt."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + MIDDLE, escape(text)
        out += [head, body, CLOSE]
        spans.append((at + len(head), at + len(head) + len(body), role == LEARNT))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    turns, role, at = [], "", 0
    for m in MARK.finditer(formatted):
        if m[1]:
            at = m.end()
        elif m[2]:
            role, at = unescape(formatted[at : m.start()]), m.end()
        elif m[3]:
            turns.append((role, unescape(formatted[at : m.start()])))
    return turns


@lru_cache(4)
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = False
    made.add_tokens([AddedToken(x, normalized=False, single_word=False) for x in (OPEN, MIDDLE, CLOSE)])
    return made


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, bool]]) -> np.ndarray:
    """Which tokens meet a learnt span.  Tokens and spans are in order; each span's tokens are found by binary search."""
    mask = np.zeros(len(starts), bool)
    for a, z, learnt in spans:
        if learnt and z > a:
            mask[np.searchsorted(ends, a, "right") : np.searchsorted(starts, z, "left")] = True
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of text that masked tokens cover; tokens that are parts of one character count once."""
    out, a, z = [], None, None
    for s, e in zip(starts[mask].tolist(), ends[mask].tolist()):
        if z is None or s > z:
            if z is not None:
                out.append(formatted[a:z])
            a, z = s, e
        z = max(z, e)
    return out if z is None else [*out, formatted[a:z]]


SCHEMA = "conv_id long, n_turns long, formatted string, token_ids array<int>, loss_mask array<boolean>, starts array<int>, ends array<int>"
ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def as_row(conv_id, n_turns, formatted, ids, mask, starts, ends):
    return conv_id, n_turns, formatted, ids, mask, starts, ends


def digest(conv_id, n_turns, formatted, ids, mask, starts, ends):
    """What can be read back from a formatted text, its tokens' offsets and its mask."""
    turns = read_back(formatted)
    loss = "".join(map(unescape, masked_text(formatted, starts, ends, mask)))
    whole = "".join(f"{role}\n{text}\n" for role, text in turns)
    return conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), len(mask), int(mask.sum())


def _format(batches, vocabulary, row_of, schema, at_once=64):
    """Turns of a conversation are joined as they come: (conv_id, roles, texts)."""
    made = tokenizer(vocabulary)
    for batch in batches:
        ids, roles, texts = (c.to_pylist() for c in batch.columns)
        for k in range(0, len(ids), at_once):
            turns = [list(zip(r, t)) for r, t in zip(roles[k : k + at_once], texts[k : k + at_once])]
            rendered = [render(x) for x in turns]
            encoded = made.encode_batch([text for text, _ in rendered], add_special_tokens=False)
            rows = []
            for i, x, (text, spans), e in zip(ids[k : k + at_once], turns, rendered, encoded):
                offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                starts, ends = offsets[:, 0], offsets[:, 1]
                rows.append(row_of(i, len(x), text, e.ids, loss_mask(starts, ends, spans), starts, ends))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _conversations(rows, conv_id, turn, role, text):
    named = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    turns = named.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return turns.select("conv_id", "turns.role", "turns.text")


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a conversation: its formatted text, token ids, loss mask and the tokens' offsets."""
    return _conversations(rows, conv_id, turn, role, text).mapInArrow(lambda it: _format(it, vocabulary, as_row, ARROW), SCHEMA)


def format_digests(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a conversation: what :func:`digest` reads back from what :func:`format_chats` gives, in the same pass."""
    return _conversations(rows, conv_id, turn, role, text).mapInArrow(lambda it: _format(it, vocabulary, digest, DIGESTS), DIGEST_SCHEMA)

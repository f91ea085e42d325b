"""Chat formatting with offset-aligned loss masks.

A conversation's turns are rendered whole into one string between three markers that the tokenizer knows as special tokens;
control strings inside texts and roles are escaped reversibly. The string is encoded once with offsets, and the turns' spans,
in order, are intersected with the tokens' spans by binary search: a token is under the loss mask if it lies in an
assistant's text. Markers are tokens of their own, so tokens end where turns do.

Defined results: turns are in the order of turn (null last), then role and text; repeated rows are turns like others; a null
text or role is empty; rows with a null conversation form one; an empty table gives an empty result; other columns are
ignored. A conversation is one string and so one row: its length bounds a task's memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_BLOCK = 1 << 20


def escape(x: str) -> str:
    return x.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(x: str) -> str:
    return _ESCAPED.sub(r"\1", x)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """(the formatted conversation, spans of the texts of trained roles)."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = OPEN + escape(role) + BODY, escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([OPEN, BODY, END])
    return t


def masked(begin: np.ndarray, end: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of tokens that lie in each span, by binary search in the tokens' offsets."""
    low = np.searchsorted(begin, [a for a, _ in spans])
    high = np.maximum(np.searchsorted(end, [b for _, b in spans], side="right"), low)
    return list(zip(low.tolist(), high.tolist()))


def chat_format(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant", model: str = MODEL) -> DataFrame:
    """One row for each conversation: its id, formatted, ids, loss_mask, and read back from these: turns, loss (array of the texts under the mask)."""
    empty = F.lit("")
    one = F.struct(F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    talks = rows.groupBy(F.col(conversation).alias("id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    talks = talks.select("id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    @released
    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = tokenizer(model)
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for b in batches:
            told = [render(list(zip(r, t)), trained) for r, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            part = np.cumsum([len(f) for f, _ in told]) // _BLOCK
            edge = np.flatnonzero(np.diff(np.r_[-1, part]))
            for f, t in zip(edge.tolist(), [*edge[1:].tolist(), len(told)]):
                out = {"ids": [], "mask": [], "turns": [], "loss": []}
                for (formatted, spans), code in zip(told[f:t], known.encode_batch([x for x, _ in told[f:t]], add_special_tokens=False)):
                    begin, end = np.array(code.offsets, dtype=np.int64).reshape(-1, 2).T
                    mask, loss = np.zeros(len(begin), dtype=bool), []
                    for i, j in masked(begin, end, spans):
                        mask[i:j] = True
                        loss.append(unescape(formatted[begin[i] : end[j - 1]]) if j > i else "")
                    out["ids"].append(code.ids)
                    out["mask"].append(mask)
                    out["turns"].append([{"role": x, "text": y} for x, y in parse(formatted)])
                    out["loss"].append(loss)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(f, t - f), pa.array([x for x, _ in told[f:t]], pa.string()), pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["mask"], pa.list_(pa.bool_())), pa.array(out["turns"], kind), pa.array(out["loss"], pa.list_(pa.string()))],
                    ["id", "formatted", "ids", "loss_mask", "turns", "loss"],
                )

    kind = dict(talks.dtypes)["id"]
    out = talks.mapInArrow(each, f"id {kind}, formatted string, ids array<int>, loss_mask array<boolean>, turns array<struct<role:string,text:string>>, loss array<string>")
    return out.withColumnRenamed("id", conversation)

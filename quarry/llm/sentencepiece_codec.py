"""SentencePiece encoding and decoding by streaming Viterbi.

A text is spelled with spaces shown and one before the first word, as the vocabulary's pieces are. The best segmentation by
the pieces' scores is found left to right with a window of the longest piece's characters; ids are committed whenever all
surviving paths converge on one boundary. No piece crosses the space before a word, so paths converge there at the latest: a
text falls into units, equal units have equal ids, and a bounded memory of units saves repeating them. Characters that are no
piece are spelled in byte pieces, so decoding gives back every text exactly.

Defined results: a null text has null ids and decodes to null; an empty one has none; of equally good segmentations the one
with the longer last piece wins; repeated rows are rows like others; very long texts are whole, each unit in a window; an empty
table gives an empty result; a column of the result's name is replaced, other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import blocks, released, text_sizes
from .pieces import MODEL, gather, viterbi, vocabulary

#: Units remembered at once by a worker.
MEMORY = 100_000
_BLOCK = 1 << 19


class Encoder:
    def __init__(self, path: str = MODEL, memory: int = MEMORY):
        self.vocab, self.memory = vocabulary(path), memory
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.spans = np.zeros(0, dtype=np.int32), np.zeros((0, 2), dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's begin, one more than texts)."""
        if len(self.number) > self.memory:
            self.forget()
        find, number, known = self.vocab.unit.findall, self.number, len(self.number)
        units = [find(self.vocab.spaced(x)) if x else () for x in texts]
        flat = np.array([number.setdefault(x, len(number)) for row in units for x in row], dtype=np.int64)
        if len(number) > known:
            ids, spans = viterbi(self.vocab, list(number)[known:])
            self.spans = np.concatenate([self.spans, spans + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        spans = self.spans[flat]
        places = np.cumsum(np.r_[0, spans[:, 1] - spans[:, 0]])
        return gather(self.ids, spans[:, 0], spans[:, 1]), places[np.cumsum([0, *map(len, units)])]


def decode(vocab, ids: np.ndarray, begin: np.ndarray) -> list[str]:
    """Texts of ids laid end to end."""
    data, at = vocab.spelled
    body = gather(data, at[ids], at[ids + 1]).tobytes()
    places = np.r_[0, np.cumsum(at[ids + 1] - at[ids])][begin]
    # the first byte is the space before the first word
    return [body[a + 1 : b].decode("utf-8", "surrogatepass") for a, b in zip(places[:-1].tolist(), places[1:].tolist())]


def sentencepiece_encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """docs with a column of ids (array of int), in place of any of that name."""
    docs = docs.drop(ids)

    @released
    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder(model)
        for b in batches:
            col = b.column(b.schema.get_field_index(text))
            for f, t in blocks(text_sizes(col), _BLOCK):
                texts = col.slice(f, t - f).to_pylist()
                flat, begin = encoder.encode(texts)
                own = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in texts]))
                yield pa.RecordBatch.from_arrays([*(c.slice(f, t - f) for c in b.columns), own], [*b.schema.names, ids])

    return docs.mapInArrow(each, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def sentencepiece_decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """docs with a column of texts, in place of any of that name."""
    docs = docs.drop(text)

    @released
    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocab = vocabulary(model)
        for b in batches:
            col = b.column(b.schema.get_field_index(ids))
            size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for f, t in blocks(4 * size, _BLOCK):
                part = col.slice(f, t - f)
                texts = decode(vocab, part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(np.r_[0, size[f:t]]))
                own = pa.array([x if ok else None for x, ok in zip(texts, part.is_valid().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(f, t - f) for c in b.columns), own], [*b.schema.names, text])

    return docs.mapInArrow(each, T.StructType([*docs.schema.fields, T.StructField(text, T.StringType())]))

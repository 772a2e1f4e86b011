"""SentencePiece encoding and decoding by a table of distinct chunks.

When no piece of the model holds a whitespace marker behind another character, no merge crosses
the point before a marker run. A text is then cut there, each distinct chunk (its markers and the
word behind them) is segmented once, and the ids are joined back by position. The table of chunks is a task's: it
grows over all that the task reads. One table for the corpus would have to move each block's distinct chunks
to it and back, which is more than the texts themselves (figures in the README).
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_slices, tidy

MARK = "▁"
#: Distinct chunks, and letters of them, that a task keeps; the table starts anew beyond either, so its memory is bounded.
TABLE_SIZE = 400_000
TABLE_LETTERS = 8 << 20
#: Bytes of text whose chunks are looked up at a time; a longer text is taken in segments that end before a space.
SLICE_BYTES = 1 << 20


class ChunkTable:
    """Distinct chunks, numbered, with the ids of all of them end to end."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.mark_id = self.sp.piece_to_id(MARK)
        self.anchor = self.sp.piece_to_id(MARK + "a")
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()
        self.find = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends, self.letters = array("I"), array("q", [0]), 0

    def add(self, chunks: list[str]) -> None:
        """Segment chunks that the table does not hold, each once."""
        for chunk, ids in zip(chunks, self.sp.encode([c[1:] for c in chunks], num_threads=1), strict=True):
            self.number[chunk] = len(self.number)
            self.ids.extend(ids or [self.mark_id])  # the library gives nothing for an empty text, not even its marker
            self.ends.append(len(self.ids))
            self.letters += len(chunk)

    def lookup(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks end to end, and how many each has: the distinct ones are segmented, then joined back by position."""
        distinct = dict.fromkeys(chunks)
        missing = [c for c in distinct if c not in self.number]
        if missing:
            if len(self.number) + len(missing) > TABLE_SIZE or self.letters > TABLE_LETTERS:
                self.clear()
                missing = list(distinct)
            self.add(missing)
        at = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        ends, ids = np.array(self.ends), np.array(self.ids, np.uint32)
        begin = ends[at]
        count = ends[at + 1] - begin
        place = np.cumsum(count) - count
        return ids[np.repeat(begin - place, count) + np.arange(count.sum())], count

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text without begin and end."""
        if not self.splits:
            return [np.array(x, np.uint32) for x in self.sp.encode(texts, num_threads=1)]
        chunks: list[str] = []
        upto = [0]
        for text in texts:
            if text:
                chunks += self.find(MARK + text.replace(" ", MARK))
            upto.append(len(chunks))
        ids, count = self.lookup(chunks)
        cuts = np.concatenate([[0], np.cumsum(count)])[upto]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def segments(self, text: str):
        """Parts of a long text that begin with a space behind another character, where no piece crosses."""
        at = 0
        while self.splits and len(text) - at > SLICE_BYTES:
            cut = text.find(" ", at + SLICE_BYTES)
            while cut > 0 and text[cut - 1] in (" ", MARK):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode_long(self, text: str) -> tuple[np.ndarray, str]:
        """Ids with begin and end, and the decoded text, of a text taken in segments."""
        out, decoded = [np.array([self.bos], np.uint32)], []
        for i, part in enumerate(self.segments(text)):
            # a later segment already begins with its marker
            ids = self.encode_all([part if not i else part[1:]])[0]
            out.append(ids)
            decoded.append(self.sp.decode(ids.tolist()) if not i else self.sp.decode([self.anchor, *ids.tolist()])[1:])
        return np.concatenate([*out, np.array([self.eos], np.uint32)]), "".join(decoded)

    def encode(self, texts: list[str], decoded: bool = True) -> list[tuple[np.ndarray, str | None]]:
        """Ids with begin and end of each text, and the text that they decode to."""
        if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
            return [self.encode_long(texts[0])]
        found = self.encode_all(texts)
        ends = [np.concatenate([[self.bos], x, [self.eos]]).astype(np.uint32) for x in found]
        return list(zip(ends, self.sp.decode([x.tolist() for x in ends]) if decoded and ends else [None] * len(ends), strict=True))


@lru_cache(maxsize=2)
def _table(model: str) -> ChunkTable:
    return ChunkTable(model)


def encode_documents(df: DataFrame, model: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``ids_u32`` (little-endian unsigned 32-bit ids, begin and end included) and,
    if asked, ``decoded``, the text that the ids decode to.

    Rows keep all their other columns; columns of these names are replaced. A null or empty text has the
    begin and end ids only and decodes to an empty text. Repeated rows stay repeated; an empty
    table gives an empty table. ``model`` is a path that every executor can open.
    """
    import pyarrow as pa

    kept = [c for c in df.columns if c not in ("n_tokens", "ids_u32", "decoded")]
    out = df.select(*kept)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields),
                        "n_tokens bigint", "ids_u32 binary", *["decoded string"] * decoded])

    def run(batches):
        table = _table(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for i, j in batch_slices(column, SLICE_BYTES):
                part = batch.slice(i, j - i)
                got = table.encode([x.as_py() or "" for x in part.column(part.schema.get_field_index(text))], decoded)
                cols = [*part.columns, pa.array([len(x) for x, _ in got], pa.int64()), pa.array([x.astype("<u4").tobytes() for x, _ in got], pa.binary())]
                names = [*part.schema.names, "n_tokens", "ids_u32"]
                if decoded:
                    cols.append(pa.array([t for _, t in got], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)
        table.clear()  # the worker may wait, or serve other stages next

    return out.mapInArrow(tidy(run), schema)


def ids_array(packed: str = "ids_u32"):
    """The ids as an array column, for users who need numbers rather than packed bytes."""
    @F.pandas_udf("array<int>")
    def unpack(col: pd.Series) -> pd.Series:
        return col.map(lambda x: None if x is None else np.frombuffer(x, "<u4").astype("int32"))

    return unpack(packed)


def decode_ids(model: str, column: str = "ids_u32"):
    """Column of texts decoded by the library itself from packed ids."""
    @F.pandas_udf("string")
    def decode(col: pd.Series) -> pd.Series:
        sp = _table(model).sp
        return col.map(lambda x: None if x is None else sp.decode(np.frombuffer(x, "<u4").tolist()))

    return decode(column)

"""What the text operators share: chunked Arrow reading, word tests, blobs, distributed prefix sums."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the only characters that end a word.
WHITE = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


_lean = False


def lean() -> None:
    """Once a Python worker: large arrays go back to the system when they are freed, not to a heap that keeps its peak.

    Workers serve many tasks of different operators, and each would hold the most that any of them took.
    """
    global _lean
    if _lean:
        return
    _lean = True
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        for option, value in ((-3, 4 << 20), (-1, 8 << 20), (-8, 2)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
            libc.mallopt(option, value)
    except OSError:  # another C library
        pass


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, in the JVM; pure ASCII (as many bytes as characters) takes the quick way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    lean()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _contiguous(column: pa.Array, lower: bool) -> pa.Array:
    """The texts in buffers of their own that begin at 0, null as empty, A-Z lower-cased if ``lower``.

    Arrow 23's ascii_lower mistakes the offsets of a slice that was cast to large strings; bytes are mapped here instead.
    """
    text = column.cast(pa.large_string()).fill_null("")
    _, ends, data = text.buffers()
    ends = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    own = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    own = _LOWER[own] if lower else own
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(ends - ends[0]), pa.py_buffer(np.ascontiguousarray(own)))


def split_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all words after each other; null has none.  A-Z are lower-cased if ``lower``.

    Runs in Arrow: no Python object a word.
    """
    lean()
    lists = pc.ascii_split_whitespace(_contiguous(column, lower))
    words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(words), 0)
    if pc.any(empty).as_py():  # white space at either end of a text leaves an empty word there
        owner = np.repeat(np.arange(len(counts)), counts)
        full = ~empty.to_numpy(zero_copy_only=False)
        counts = np.bincount(owner[full], minlength=len(counts))
        words = words.filter(pa.array(full))
    return counts, words


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of about ``limit`` bytes of text (one text at least), so that a record batch needn't be taken at once."""
    lean()
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut and join record batches to about ``limit`` bytes of ``text`` each (one row at least).

    Whole texts stay together, so a single long text may exceed the limit by itself.
    """
    lean()
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths):
            if size + n > limit and (held or i > start):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield flush()
                held, size, start = [], 0, i
            size += int(n)
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield flush()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, and where each starts (one more at the end)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def packed(df: DataFrame, name: str = "__row") -> Column:
    """All columns of ``df`` as one struct, so that columns of any name pass through an operator unharmed."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "__row", **new: Column) -> DataFrame:
    """The columns of the struct again; those named in ``new`` are replaced."""
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{name}`.`{c}`").alias(c) for c in columns])


def with_lengths(columns: list[str], text: Column) -> dict[str, Column]:
    """What changes in a document when its text does."""
    return {"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in columns else {})

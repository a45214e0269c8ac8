"""Texts of an Arrow column as the bytes they lie in, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 4 << 20


def text_blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(UTF-8 bytes, offsets) of whole texts in a row, at most ``most`` bytes or one text each; null texts are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(at, dtype="<i8" if wide else "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield whole[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high

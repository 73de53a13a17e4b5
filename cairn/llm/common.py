"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.shared import materialize, release

__all__ = ["SPACE_CLASS", "carried", "let", "materialize", "n_words", "pieces", "release", "unused", "words"]

#: The white space that separates words, as a Java character class; everything else belongs to a word.
SPACE_CLASS = "[ \\x09-\\x0D]"
#: Bytes of text that a task works on at once, but for one longer text.
PIECE_BYTES = 2 << 20


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def n_words(text: Column) -> Column:
    """The number of words, without the empty string that split() leaves at either end."""
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def carried(df: DataFrame, *replaced: str) -> list[str]:
    """The columns of df but those that an operator reads away or adds; names differ by more than case."""
    return [c for c in df.columns if c.lower() not in {r.lower() for r in replaced}]


def unused(name: str, columns: Iterable[str]) -> str:
    """A name like this one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows whose texts (or bytes) in a column have ``most`` bytes together; a longer one is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends, first = np.concatenate([[0], np.cumsum(sizes)]), 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last

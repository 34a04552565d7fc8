"""Fill-in-the-middle by in-place block rotation.

A text is cut into prefix, middle and suffix at the ends of two units (a unit is a word with the blanks
before it, or the blanks behind the last word). Sentinels are inserted into a bytearray of the text, and
the segments are exchanged in place by three reversals: block AB becomes BA as reverse(reverse(A) reverse(B)).
Restoring finds the sentinels, turns the rotation back and takes the sentinels out. Where the cuts fall
follows from the seed and the doc_id alone, so a task that is run again gives the same bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, small_batches, unused

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Where each unit of the bytes ends. Blanks are ASCII, so bytes and code points have the same units."""
    word = _WORD[raw]
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    return np.append(ends, len(raw)) if len(raw) else ends


def rotate(data: bytearray, start: int, at: int, end: int) -> None:
    """Exchanges data[start:at] and data[at:end] in place by three reversals."""
    view = np.frombuffer(data, np.uint8)
    for a, b in ((start, at), (at, end), (start, end)):
        part = view[a:b]
        half = len(part) // 2
        left = part[:half].copy()
        part[:half] = part[len(part) - half :][::-1]
        part[len(part) - half :] = left[::-1]


def fill_middle(text: bytes, first: int, second: int, form: str) -> bytes:
    """psm: prefix, suffix, middle; spm: suffix, prefix, middle, each behind its sentinel. ``first`` and ``second``
    are byte positions; the text must hold no sentinel."""
    data = bytearray(text)
    data[second:second] = SUFFIX
    data[first:first] = MIDDLE
    data[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(data, middle if form == "psm" else 0, suffix, len(data))
    return bytes(data)


def restore_middle(output: bytes, form: str) -> bytes:
    """The exact text of ``fill_middle``'s output."""
    data = bytearray(output)
    middle, other = output.index(MIDDLE), output.index(SUFFIX if form == "psm" else PREFIX)
    start, at = (other, middle) if form == "psm" else (0, other)
    rotate(data, start, at, len(data))
    for mark in (SUFFIX, MIDDLE, PREFIX):  # from the last to the first
        place = data.index(mark)
        del data[place : place + len(mark)]
    return bytes(data)


def _characters(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _spans(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def _transform(batches: Iterator[pa.RecordBatch], text: str, kind: str, draws: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, text):
        rows = []
        for data, form, a, b in zip(_spans(batch.column(text)), *(batch.column(c).to_pylist() for c in (kind, *draws)), strict=True):
            raw = np.frombuffer(data, np.uint8)
            ends = unit_ends(raw)
            n = len(ends)
            if form == "plain" or not n or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
                rows.append((n, "plain", None, None, data.decode()))
                continue
            cuts = sorted((a % (n + 1), b % (n + 1)))
            first, second = (int(ends[c - 1]) if c else 0 for c in cuts)
            rows.append((n, form, _characters(raw[:first]), _characters(raw[first:second]), fill_middle(data, first, second, form).decode()))
        kept = [c for c in batch.schema.names if c not in (kind, *draws)]
        made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "units", "form", "prefix", "middle", "out"])


def _undo(batches: Iterator[pa.RecordBatch], output: str, form: str) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, output):
        pairs = zip(_spans(batch.column(output)), batch.column(form).to_pylist(), strict=True)
        texts = pa.array([(data if kind == "plain" else restore_middle(data, kind)).decode() for data, kind in pairs], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "restored"])


def _draw(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with fim_units, fim_form, fim_prefix_chars, fim_middle_chars and fim_text, all other columns
    kept (names that clash get underscores behind them).

    ``percent`` of the documents are transformed, of these ``spm_percent`` in the order suffix, prefix, middle.
    Null and empty texts and texts that hold a sentinel stay as they are (form ``plain``, a null text as an
    empty one; both counts null), as does a null doc_id's text. Segments may be empty. Repeated rows are cut
    alike; an empty table gives no rows. A text is held by one task at a time, however long.
    """
    columns = docs.columns
    d, form, one, two = unused(columns, "_digest", "_form", "_one", "_two")
    out = unused(columns, "fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text")
    keyed = docs.withColumn(d, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256))
    kind = F.when(F.coalesce(_draw(F.col(d), 2) % 100 >= percent, F.lit(True)), "plain").when(_draw(F.col(d), 3) % 100 < spm_percent, "spm").otherwise("psm")
    keyed = keyed.withColumn(form, kind).withColumn(one, _draw(F.col(d), 0)).withColumn(two, _draw(F.col(d), 1)).drop(d)
    names, schema = numbered(docs.schema)
    for name, t in zip(("units", "form", "prefix", "middle", "out"), ("long", "string", "long", "long", "string"), strict=True):
        schema.add(name, t)
    how = partial(_transform, text=names[columns.index("text")], kind="kind", draws=("one", "two"))
    return keyed.toDF(*names, "kind", "one", "two").mapInArrow(how, schema).toDF(*columns, *out)


def restore(transformed: DataFrame, output: str = "fim_text", form: str = "fim_form", restored: str = "fim_restored") -> DataFrame:
    """``transformed`` with the exact text rebuilt from ``output`` and ``form`` alone."""
    names, schema = numbered(transformed.schema)
    how = partial(_undo, output=names[transformed.columns.index(output)], form=names[transformed.columns.index(form)])
    return transformed.toDF(*names).mapInArrow(how, schema.add("restored", "string")).toDF(*transformed.columns, restored)

"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy, mark the characters that lie inside
n-grams found twice or more in their text; line hashes mark the characters of repeated
lines.  A text whose covered share exceeds the bound of any length is rejected.

Cases: a null or empty text has no words and fails the base rule; a null ``doc_id`` is
passed on; repeated rows give one result each; an empty table gives no rows; other columns
of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .scratch import modest

SYMBOLS = K.byte_class(lambda b: b in b"#*$%&|<>")
LEADS = K.byte_class(lambda b: b & 0xC0 != 0x80)
NOT_NEWLINE = K.byte_class(lambda b: b != 0x0A)


@dataclass(frozen=True)
class Rules:
    """Bounds of the verdict.

    ``grams`` maps an n-gram length to the largest allowed share of word characters inside
    n-grams that occur twice or more; ``line_chars`` bounds the share inside lines equal to
    an earlier one.
    """

    min_words: int = 10
    window: int = 5
    window_percent: int = 20
    grams: dict[int, float] = field(default_factory=lambda: {3: 0.5, 5: 0.3, 8: 0.28, 13: 0.25})
    line_chars: float = 0.3


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, dup_gram_share double, dup_line_share double, kept boolean"
)


def _lines(texts: K.Texts, word_sums: np.ndarray, char_sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the number of lines with a word that equal an earlier line, and the word characters in them."""
    n = len(texts.offsets) - 1
    breaks = np.flatnonzero(~NOT_NEWLINE[texts.data])
    starts = np.concatenate([texts.offsets[:-1], breaks + 1])
    group = np.concatenate([np.arange(n), np.searchsorted(texts.offsets, breaks, "right") - 1])
    order = np.lexsort((starts, group))
    starts, group = starts[order], group[order]
    last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
    ends = np.where(last, texts.offsets[group + 1], np.append(starts[1:], 0) - 1)
    filled = word_sums[ends] > word_sums[starts]
    starts, ends, group = starts[filled], ends[filled], group[filled]
    keys = K.byte_hash(texts.data, starts, ends)
    _, again = K.repeated(keys, group)
    chars = char_sums[ends] - char_sums[starts]
    return np.bincount(group[again], minlength=n), np.bincount(group[again], chars[again], minlength=n).astype(np.int64)


def measure(texts: K.Texts, rules: Rules) -> dict[str, np.ndarray]:
    """The measures and verdicts of a chunk of texts."""
    found = K.words(texts, K.SPACED)
    hashes = K.word_hashes(texts.data, found)
    group, first = K.owner(found.first), found.first
    inside = K.SPACED[texts.data]
    word_sums = np.zeros(len(inside) + 1, np.int64)
    np.cumsum(inside, out=word_sums[1:])
    char_sums = np.zeros(len(inside) + 1, np.int64)
    np.cumsum(inside & LEADS[texts.data], out=char_sums[1:])
    chars = char_sums[found.ends] - char_sums[found.starts]

    n_words = np.diff(first)
    word_chars = np.diff(char_sums[texts.offsets])
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": K.totals(SYMBOLS[texts.data], texts.offsets)}
    out["n_dup_lines"], line_chars = _lines(texts, word_sums, char_sums)

    some = np.maximum(word_chars, 1)
    worst, bad = np.zeros(len(n_words)), np.zeros(len(n_words), bool)
    for width in sorted({rules.window, *rules.grams}):
        ok = np.flatnonzero(K.window_starts(first, width))
        twice, _ = K.repeated(K.window_hashes(hashes, width)[ok], group[ok])
        hit = K.covered(ok[twice], width, len(hashes))
        if width == rules.window:
            out["n_repeat_words"] = K.totals(hit, first)
        if width in rules.grams:
            share = K.totals(np.where(hit, chars, 0), first) / some
            worst, bad = np.maximum(worst, share), bad | (share > rules.grams[width])
    share = line_chars / some
    failed = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.window_percent * n_words)
    return out | {
        "base_failed": failed,
        "dup_gram_share": worst,
        "dup_line_share": share,
        "kept": ~failed & ~bad & ~(share > rules.line_chars),
    }


def _batches(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    """The last column is the text; its place is taken by the measures."""
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        for texts in K.chunks(text):
            part = batch.slice(texts.rows.start, texts.rows.stop - texts.rows.start)
            found = measure(texts, rules)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], *map(pa.array, found.values())], [*part.schema.names[:-1], *found]
            )


def quality(docs: DataFrame, rules: Rules | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measures and verdict of every text: ``doc_id`` and the columns of ``FIELDS``."""
    modest(docs.sparkSession)
    rules = rules or Rules()
    some = docs.select(id_column, text_column)
    kind = some.schema[0].dataType.simpleString()
    return some.mapInArrow(lambda it: _batches(it, rules), f"`{id_column}` {kind}, {FIELDS}")


def accepted(docs: DataFrame, rules: Rules | None = None, text_column: str = "text") -> DataFrame:
    """The rows, whole and unchanged, whose text the rules keep; one pass, no shuffle."""
    modest(docs.sparkSession)
    rules, at = rules or Rules(), docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in K.chunks(batch.column(at)):
                part = batch.slice(texts.rows.start, texts.rows.stop - texts.rows.start)
                yield part.filter(pa.array(measure(texts, rules)["kept"]))

    return docs.toDF(*map(str, range(len(docs.columns)))).mapInArrow(keep, docs.schema)

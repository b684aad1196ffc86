"""Token counts of whole texts, however long, by overlap resynchronisation.

A long text is encoded in overlapping chunks with offsets.  Two neighbours are
spliced at a boundary that is proven stable: a place between a character that
is no white space and a white-space character, where both encodings begin a
token.  The pre-tokeniser of a byte-level vocabulary never joins text across
such a place and looks at nothing before it, so what follows is encoded alike
whatever came before; special strings hold no white space, so none crosses it.
Where an overlap holds no such place, it is doubled, up to the rest of the
text; a text without any white space is thus encoded whole.

Texts of one chunk are cut at all such places, and before a mark after an ASCII
letter: no match of the pre-tokeniser and no special string holds a letter
before one of MARKS.  What lies between two cuts is a unit.  Equal units of a
slice of texts are encoded once, by the library, and a text has the tokens of
its units; texts whose units hardly repeat are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import SPACE_BYTES, text_of
from ticketloom.session import ship_by_value, spread

CHUNK = 1 << 15
OVERLAP = 1 << 10
SPACES = " \t\n\r\x0b\x0c"
# Bytes of text that a task takes at once, and of units that the library encodes at once: both bound memory.
SLICE = 1 << 24
ENCODED = 1 << 17
# Occurrences of a unit, on average, from which it pays to encode units by themselves.
REPEATS = 3
MARKS = np.zeros(256, bool)
MARKS[list(b'.,;:!?)"')] = True
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True
# Last two bytes of the white space that is not in SPACES, after which no unit ends.
ODD_SPACES = np.zeros((256, 256), bool)
ODD_SPACES[:, 0x1C:0x20] = True
for _c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000":
    ODD_SPACES[tuple(_c.encode()[-2:])] = True

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[path] = loaded
    return _LOADED[path]


def splice_point(text: str, low: int, high: int, left: set[int], right: set[int]) -> int | None:
    """The last stable boundary in [low, high) at which both encodings begin a token."""
    for at in range(high - 1, low, -1):
        if text[at] in SPACES and text[at - 1] not in SPACES and not text[at - 1].isspace() and at in left and at in right:
            return at
    return None


def count_long(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long text; `encode` gives the start offset of every token of a string."""
    total, begin = 0, 0
    while True:
        end = begin + chunk
        if end >= len(text):
            return total + len(encode(text[begin:]))
        wide = overlap
        while True:
            # The left chunk ends at `end`; the right one begins `wide` before it.
            starts = encode(text[begin:end])
            begin_right = max(begin + 1, end - wide)
            right = encode(text[begin_right : min(len(text), end + overlap)])
            at = splice_point(text, begin_right, end, {begin + x for x in starts}, {begin_right + x for x in right})
            if at is not None:
                total += sum(1 for x in starts if begin + x < at)
                begin = at
                break
            if begin_right == begin + 1:
                # No place in the whole chunk: a longer chunk, then a wider overlap again.
                end += chunk
                if end >= len(text):
                    return total + len(encode(text[begin:]))
            wide *= 2


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, first row and number, of at most so many bytes together; a longer row is alone."""
    at, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and size + n > most:
            yield at, i - at
            at, size = i, 0
        size += n
    if len(sizes):
        yield at, len(sizes) - at


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the units of joined texts begin, and the end of the last one; `bounds` are the texts' bounds."""
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = MARKS[data[1:]] & LETTERS[data[:-1]]
    space = SPACE_BYTES[data]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    begins[at[~ODD_SPACES[data[np.maximum(at - 2, 0)], data[at - 1]]]] = True
    begins[bounds] = True
    return np.flatnonzero(begins)


def encoded_sizes(loaded, strings: pa.Array) -> np.ndarray:
    """Tokens of every string, each encoded by itself."""
    sizes = np.zeros(len(strings), np.int64)
    for at, n in slices(pc.binary_length(strings).to_numpy(zero_copy_only=False), ENCODED):
        part = loaded.encode_batch_fast(strings.slice(at, n).to_pylist(), add_special_tokens=False)
        sizes[at : at + n] = [len(e) for e in part]
    return sizes


def count_by_units(loaded, texts: list[str]) -> list[int]:
    """Tokens of each text; equal units of all the texts are encoded once, unless they repeat too little to gain by it."""
    encoded = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, encoded)])
    data = np.frombuffer(b"".join(encoded), np.uint8)
    starts = unit_starts(data, bounds).astype(np.int64)
    buffers = [None, pa.py_buffer(starts), pa.py_buffer(data)]
    units = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, buffers).dictionary_encode()
    if REPEATS * len(units.dictionary) > len(units):
        return encoded_sizes(loaded, pa.array(texts, pa.large_string())).tolist()
    sizes = encoded_sizes(loaded, units.dictionary.cast(pa.large_string()))
    before = np.concatenate([[0], np.cumsum(sizes[units.indices.to_numpy()])])
    return np.diff(before[np.searchsorted(starts, bounds)]).tolist()


def counts_of(texts: list[str], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    loaded = tokenizer(path)

    def starts(piece: str) -> list[int]:
        return [a for a, _ in loaded.encode(piece, add_special_tokens=False).offsets]

    short = [i for i, t in enumerate(texts) if len(t) <= chunk]
    counts = [0] * len(texts)
    for i, n in zip(short, count_by_units(loaded, [texts[i] for i in short]), strict=True):
        counts[i] = n
    for i in set(range(len(texts))) - set(short):
        counts[i] = count_long(starts, texts[i], chunk, overlap)
    return counts


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    `path` is the tokenizer's file on every machine.  A null text counts as
    empty: 0 bytes, 0 tokens.  Special strings in a text are one token each,
    as the library's default has it.  Other columns are not read; repeated
    rows and null ids are counted one by one.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in slices(batch.column(2).to_numpy(zero_copy_only=False), SLICE):
                part = batch.slice(at, rows)
                n = counts_of(part.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    whole = text_of(text)
    lean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    return spread(lean).mapInArrow(count, schema)


ship_by_value(__name__)

"""Fill-in-the-middle: texts cut in two places and put together in another order, by a wavelet matrix.

The UTF-8 bytes of many texts in a row are mapped to eight classes, kept as a wavelet matrix: three levels of bits, each
stably sorted by the level above, with counts of ones before every word of 64. The rank of a class up to a place is then
a few look-ups, and sums of ranks count whatever the classes are enough to tell: units are ended by the characters of
some classes (line ends; line ends and sentence marks; white space; every character), so the number of units that end
before a place is a sum of ranks, and bisection on that sum finds where the k-th unit of a text ends. Characters are
bytes less continuation bytes, which are a class too. All texts of a batch are queried at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces_of, texts

NEWLINE, SPACE, STOP, DIGIT, LETTER, OTHER, LEAD, CONTINUATION = range(8)
LEVELS = 3
#: Classes whose characters end a unit. What follows the last of them in a text is a unit too.
UNITS = {
    "line": (NEWLINE,),
    "sentence": (NEWLINE, STOP),
    "word": (NEWLINE, SPACE),
    "character": (NEWLINE, SPACE, STOP, DIGIT, LETTER, OTHER, LEAD),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _class_table() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[[9, 11, 12, 13, 32]] = SPACE
    table[10] = NEWLINE
    table[[ord(c) for c in ".!?"]] = STOP
    table[48:58] = DIGIT
    table[65:91] = table[97:123] = LETTER
    table[128:192] = CONTINUATION
    table[192:] = LEAD
    return table


CLASS_OF = _class_table()


class Bits:
    """A bit string with the number of ones before every place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, place: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Ranks of the values below 2^LEVELS in a string of them."""

    def __init__(self, values: np.ndarray):
        self.size, self.levels = len(values), []
        for shift in range(LEVELS - 1, -1, -1):
            bit = (values >> shift) & 1
            self.levels.append(Bits(bit))
            one = bit.astype(bool)
            values = np.concatenate([values[~one], values[one]])

    def rank(self, value: int, place: np.ndarray) -> np.ndarray:
        """How often ``value`` occurs before each place."""
        start, end = np.zeros(1, np.int64), place
        for shift, bits in zip(range(LEVELS - 1, -1, -1), self.levels, strict=True):
            a, b = bits.ones(start), bits.ones(end)
            start, end = (bits.zeros + a, bits.zeros + b) if value >> shift & 1 else (start - a, end - b)
        return end - start

    def count(self, values: tuple[int, ...], place: np.ndarray) -> np.ndarray:
        return sum((self.rank(v, place) for v in values), np.zeros(len(place), np.int64))

    def select(self, values: tuple[int, ...], start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place after the k-th of ``values`` from ``start`` on; ``end`` if there are fewer, ``start`` for k = 0."""
        goal = self.count(values, start) + k
        low, high = start.copy(), end.copy()  # the answer is in low..high
        for _ in range(int((end - start).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            enough = self.count(values, middle) >= goal
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return low


@dataclass(frozen=True)
class Cuts:
    """``unit`` of :data:`UNITS`; shares in percent of documents that are rearranged, and of those that begin with
    the suffix; ``seed`` of the numbers drawn for a document."""

    unit: str = "line"
    rearranged: int = 100
    suffix_first: int = 50
    seed: int = 7


def drawn(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document, from its id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def _arranged(raw: bytes, i: int, j: int, form: str) -> bytes:
    if form == "plain":
        return raw
    prefix, middle, suffix = raw[:i], raw[i:j], raw[j:]
    if form == "psm":
        return b"<P>%b<S>%b<M>%b" % (prefix, suffix, middle)
    return b"<S>%b<P>%b<M>%b" % (suffix, prefix, middle)


def _marked(raw: bytes) -> bool:
    return b"<P>" in raw or b"<S>" in raw or b"<M>" in raw


def _transform(rule: Cuts):
    ends = UNITS[rule.unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            raws = batch["text"].cast(pa.large_binary()).to_pylist()
            sizes = np.array([len(r) for r in raws], np.int64)
            end = np.cumsum(sizes)
            start = end - sizes
            classes = CLASS_OF[np.frombuffer(b"".join(raws), np.uint8)]
            matrix = WaveletMatrix(classes)
            # Continuation bytes follow the character that ends a unit, so they belong to it.
            units = matrix.count(ends, end) - matrix.count(ends, start)
            tail = sizes > 0
            last = classes[end[tail] - 1]
            if rule.unit != "character":
                units[tail] += ~np.isin(last, ends)
            h = np.array([drawn(d, rule.seed) for d in batch["doc_id"].to_pylist()], np.int64).reshape(-1, 4)
            first, second = h[:, 0] % (units + 1), h[:, 1] % (units + 1)
            cut = [matrix.select(ends, start, end, np.minimum(first, second)), matrix.select(ends, start, end, np.maximum(first, second))]
            if LEAD in ends:
                cut = [_past_continuation(classes, c, end) for c in cut]
            chars = [c - matrix.rank(CONTINUATION, c) for c in (start, *cut)]
            plain = (sizes == 0) | (h[:, 2] % 100 >= rule.rearranged) | np.fromiter(map(_marked, raws), bool, len(raws))
            form = np.where(plain, "plain", np.where(h[:, 3] % 100 < rule.suffix_first, "spm", "psm")).tolist()
            i, j = (cut[0] - start).tolist(), (cut[1] - start).tolist()
            out = [_arranged(*each) for each in zip(raws, i, j, form, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(units),
                    pa.array(form),
                    pa.array(chars[1] - chars[0], mask=plain),
                    pa.array(chars[2] - chars[1], mask=plain),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def _past_continuation(classes: np.ndarray, place: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places moved behind the continuation bytes they stand before, three at most."""
    for _ in range(3):
        inside = place < end
        inside[inside] = classes[place[inside]] == CONTINUATION
        place = place + inside
    return place


def fill_in_middle(docs: DataFrame, rule: Cuts | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_units, form, prefix_chars, middle_chars, output) of every row.

    The text is cut after two numbers of units, both drawn from the document's id and from 0 to all of them, and
    rearranged: ``psm`` is prefix, suffix, middle and ``spm`` suffix, prefix, middle, each behind its mark. ``plain`` is
    the text itself, for empty texts, those that hold a mark already, and the share that is not rearranged; its two
    lengths are missing. A missing text is an empty one, a missing id draws like an empty id. Texts of any length are
    cut whole; a batch holds one text or about four megabytes of shorter ones. Repeated rows give repeated results.
    Other columns are left out, whatever their names; an empty table gives an empty result.
    """
    rule = rule or Cuts()
    if rule.unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")
    shape = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)]
        + T.StructType.fromDDL("n_units long, form string, prefix_chars long, middle_chars long, output string").fields
    )
    return texts(docs, id_col, text_col).mapInArrow(_transform(rule), shape)


def restored(output: Column, form: Column) -> Column:
    """The text of a rearranged document. Only the three marks put there occur in it, so each is found by search."""
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)

    def parts(mark: str) -> tuple[Column, Column]:
        return F.substring_index(rest, mark, 1).substr(F.lit(4), F.lit(2**31 - 1)), F.substring_index(rest, mark, -1)

    prefix_first, suffix_last = parts(SUFFIX)
    suffix_first, prefix_last = parts(PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix_first, middle, suffix_last))
        .when(form == "spm", F.concat(prefix_last, middle, suffix_first))
        .otherwise(output)
    )

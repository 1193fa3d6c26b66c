"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

The vocabulary and its scores come from a given model file. An encoding is found without a merge queue: at each
position the longest vocabulary piece is looked up (one Aho-Corasick pass finds all of them), a piece is accepted
when it is compatible with the piece before it, and a shorter prefix is tried otherwise. Two adjacent pieces are
compatible when merging their characters anew gives exactly these two pieces. Positions from which no continuation
exists are kept in a bitfield, so none is tried twice.

Texts are cut before each word mark, which no merge can cross when the vocabulary has the mark only at the start of
its pieces; this is verified when the model is loaded, and a model that breaks it is encoded by plain merging.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, texts

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words kept per Python worker, in two generations. A speed setting: results do not depend on it.
CACHED_WORDS = 400_000
CACHED_PAIRS = 400_000


class Pieces:
    """A merge-type model: its pieces, the plain merging rule, and the backtracking encoder."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Only what this encoder states itself is accepted; the library is asked for the vocabulary, not for results.
        probe = "a  Bﬁ１  c "
        if sp.decode(sp.encode(probe)) != probe or sp.encode_as_pieces("a")[:1][0][0] != MARK:
            raise ValueError("the model must keep text as it is and put a word mark first")
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes_at = {int(n[1:-1], 16): i for i, n in enumerate(self.names) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        self.unknown = sp.unk_id()
        self.silent = {i for i in range(len(self.names)) if sp.is_control(i)}
        self.special = frozenset({self.unknown, *self.byte_of, *self.silent})
        normal = [
            i
            for i in range(len(self.names))
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        if any(sp.is_unused(i) for i in range(len(self.names))):
            raise ValueError("models with unused pieces are not supported")
        self.ids = {self.names[i]: i for i in normal}
        self.score = {self.names[i]: sp.get_score(i) for i in normal}
        runs = [p for p in self.ids if set(p) == {MARK} and p != MARK]
        words = [p for p in self.ids if set(p) != {MARK} or p == MARK]
        low = min((self.score[p] for p in words if len(p) > 1), default=0.0)
        many = [self.score[p] for p in words if len(p) > 1]
        self.cuttable = (
            all(MARK not in p[1:] for p in words)
            and all(c in self.ids for p in words for c in p)
            and len(set(many)) == len(many)
            and all(self.score[p] < low for p in runs)
        )
        self.lines_part = self.cuttable and not any("\n" in p for p in self.ids)
        self.line_end = array("i", self._named(["\n"])).tobytes()
        self.lengths = [len(n) for n in self.names]
        self.shorter: list[int] = [-1] * len(self.names)
        self.pairs: dict[int, bool] = {}  # by one number of both ids
        self.size = len(self.names)
        self.words = Words(self)
        self.automaton = ahocorasick.Automaton()
        reachable = {p for p in words if self.merge(p) == [p]}
        for p in reachable:
            self.automaton.add_word(p, self.ids[p])
            cut = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in reachable), None)
            self.shorter[self.ids[p]] = self.ids[cut] if cut else -1
        if reachable:
            self.automaton.make_automaton()

    def merge(self, text: str) -> list[str]:
        """Plain merging: the adjacent pair with the highest score first, the leftmost of equals."""
        if len(text) <= 40:
            return self._merge_short(list(text))
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if 0 <= i and j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-s, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _merge_short(self, parts: list[str]) -> list[str]:
        """The same rule by scanning a list of pair scores, which beats a queue on a few characters."""
        score, none = self.score.get, -math.inf
        gains = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while gains and (best := max(gains)) > none:
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def _named(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            if (k := self.ids.get(p)) is not None:
                out.append(k)
            elif self.bytes_at:
                out += [self.bytes_at[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def compatible(self, a: int, b: int) -> bool:
        """True if merging the two pieces' text anew gives the two pieces."""
        key = a * self.size + b
        known = self.pairs.get(key)
        if known is None:
            known = self.merge(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of a stretch without runs of marks; characters outside the vocabulary become bytes."""
        size = len(text)
        longest = [-1] * size
        lengths, shorter, pairs, pieces = self.lengths, self.shorter, self.pairs, self.size
        for end, k in self.automaton.iter(text):
            longest[end - lengths[k] + 1] = k  # ends ascend, so the last one kept is the longest
        out: list[int] = []
        start = 0
        while start < size:
            if longest[start] < 0:  # no piece holds this character: nothing merges across it
                out += self._named([text[start]])
                start += 1
                continue
            stop = start
            while stop < size and longest[stop] >= 0:
                stop += 1
            failed = bytearray((stop - start >> 3) + 1)
            stack: list[int] = []
            pos, token, last = start, longest[start], -1
            while pos < stop:
                while token >= 0:
                    end = pos + lengths[token]
                    at = end - start
                    if not failed[at >> 3] >> (at & 7) & 1:
                        if last < 0:
                            break
                        fits = pairs.get(last * pieces + token)
                        if fits or (fits is None and self.compatible(last, token)):
                            break
                    token = shorter[token]
                if token >= 0:
                    stack.append(token)
                    last, pos = token, end
                    token = longest[pos] if pos < stop else -1
                else:
                    at = pos - start
                    failed[at >> 3] |= 1 << (at & 7)
                    token = stack.pop()
                    last = stack[-1] if stack else -1
                    pos -= lengths[token]
            out += stack
            start = stop
        return out

    def unit(self, text: str) -> list[int]:
        """Ids of one unit: a run of marks and what follows up to the next mark."""
        word = text.lstrip(MARK)
        marks = len(text) - len(word)
        if marks < 2 and word:
            return self.backtrack(text)
        ids = self.backtrack(MARK + word) if word else []
        # A run has lower scores than any word piece: the last mark goes to the word if a piece takes it.
        if ids and ids[0] != self.ids[MARK]:
            marks -= 1
        elif ids:
            ids = ids[1:]
        return self._named(self.merge(MARK * marks)) + ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text)[0], "<i4").tolist()

    def spell(self, ids: list[int], text: str) -> bool:
        """True if the ids are pieces alone, no bytes or controls, that make ``text`` as they stand."""
        return self.special.isdisjoint(ids) and "".join([self.names[k] for k in ids]) == text

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte runs as UTF-8, marks as spaces, the first mark left out."""
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()

        first = True
        for k in ids:
            if k in self.byte_of:
                raw.append(self.byte_of[k])
                first = False
                continue
            flush()
            if k in self.silent:
                continue
            piece = " ⁇ " if k == self.unknown else self.names[k].replace(MARK, " ")
            if first and piece[:1] == " ":
                piece = piece[1:]
            out.append(piece)
            first = False
        flush()
        return "".join(out)

    def _packed(self, unit: str) -> bytes:
        return array("i", self.unit(unit)).tobytes()

    def encode_packed(self, text: str) -> tuple[bytes, str]:
        """Little-endian ids of a text, and what they decode to."""
        if not text:
            return b"", ""
        if not self.cuttable:
            packed = np.array(self._named(self.merge(MARK + text.replace(" ", MARK))), "<i4").tobytes()
            return packed, self.decode(np.frombuffer(packed, "<i4").tolist())
        if MARK in text:
            text = text.replace(MARK, " ")
        parts = text.split(" ")
        if "" not in parts:
            packed = b"".join(map(self.words.__getitem__, parts))
            if not self.words.odd or self.words.odd.isdisjoint(parts):
                return packed, text
        else:
            units = UNIT.findall(MARK + text.replace(" ", MARK))
            packed = b"".join([self.words[u[1:]] if u[1:] and u[1] != MARK else self._packed(u) for u in units])
        return packed, self.decode(np.frombuffer(packed, "<i4").tolist())


class Words(dict):
    """Packed ids of words seen lately, in two generations; ``odd`` holds those that decode to something else."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.before, self.odd, self.tails = pieces, {}, set(), Tails(pieces)

    def __missing__(self, word: str) -> bytes:
        got = self.before.get(word)
        if got is None:
            if self.pieces.lines_part and "\n" in word:
                got = self._lines(word)
            else:
                ids = self.pieces.unit(MARK + word)
                got = array("i", ids).tobytes()
                if not self.pieces.spell(ids, MARK + word) and self.pieces.decode(ids) != word:
                    self.odd.add(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = got
        return got


    def _lines(self, word: str) -> bytes:
        """A word with line ends, which no piece holds: the words around them, of which all but the first have no mark."""
        first, *rest = word.split("\n")
        parts = [self[first], *map(self.tails.__getitem__, rest)]
        if first in self.odd or not self.tails.odd.isdisjoint(rest):
            self.odd.add(word)
        return self.pieces.line_end.join(parts)


class Tails(dict):
    """Packed ids of what follows a line end up to the next space or line end."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.odd = pieces, set()

    def __missing__(self, text: str) -> bytes:
        ids = self.pieces.backtrack(text)
        got = array("i", ids).tobytes()
        if not self.pieces.spell(ids, text) and self.pieces.decode([self.pieces.ids[MARK], *ids]) != text:
            self.odd.add(text)
        if len(text) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[text] = got
        return got


def _utf8(raw: bytes) -> str:
    """UTF-8, each byte that starts no valid character as one replacement mark."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


_LOADED: dict[str, Pieces] = {}


def load(model: bytes) -> Pieces:
    """One copy of a model per Python process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def model_bytes(path: str) -> bytes:
    """The model file, read where the job is submitted; it travels with the tasks (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def _encoder(model: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in pieces_of(batches, "text"):
            packed, decoded = zip(*map(pieces.encode_packed, batch["text"].to_pylist()), strict=True)
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
            )

    return run


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row.

    A missing or empty text has no ids and decodes to the empty string. Repeated rows and missing ids give one
    output row each; other columns of ``docs`` are left out. An empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encoder(model_bytes(model_path)), f"doc_id {kind}, ids array<int>, decoded string")


def decode_ids(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with a column ``decoded``: the text of the ids in ``ids_col`` (missing ids: missing text)."""
    model = model_bytes(model_path)

    @F.pandas_udf("string")
    def text_of(column):
        pieces = load(model)
        return column.map(lambda ids: None if ids is None else pieces.decode([int(i) for i in ids]))

    return rows.withColumn("decoded", text_of(F.col(ids_col)))

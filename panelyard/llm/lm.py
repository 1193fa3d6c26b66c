"""Language-model scoring with word pairs, counted over the whole corpus and looked up in Elias-Fano tries.

Documents are taken in chunks of a few million words, written once in buckets and joined with what comes back where
they lie. A chunk sends each distinct word once to be counted and numbered, in one packed message for each range of
word hashes, and each distinct pair once to the shard that holds its context; the same message carries the pair's count
and asks for its probability. A shard adds the counts of all chunks, smooths them, builds its trie and answers every
chunk. So only distinct pairs per chunk travel, there and back, and neither the vocabulary nor the model is ever held
in one place. A frequent context is spread over ``SPREAD`` shards by its successor.

Smoothing has a Dirichlet prior: P(w | v) = (c(v w) + m P(w)) / (c(v) + m) with P(w) = (c(w) + 1) / (N + V + 1).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.session import shared_path

from .common import pieces_of
from .trie import U64, PairTrie, dequantise, quantise

SPREAD = 16


@dataclass(frozen=True)
class PairModel:
    """``prior``: weight of the single-word probability, in words. Sizes steer memory per task alone."""

    prior: float = 32.0
    chunk_bytes: int = 14 << 20
    words_per_part: int = 500_000
    tokens_per_shard: int = 1_500_000


def _pack(a: np.ndarray) -> bytes:
    """An array in byte planes, compressed; the element size and count in front."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return np.array([len(a), a.itemsize], "<i8").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    n, size = np.frombuffer(raw[:16], "<i8").tolist()
    if not n:
        return np.empty(0, kind)
    planes = pa.decompress(raw[16:], n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def _pack_words(words: Sequence[bytes]) -> bytes:
    """At least one word; none holds white space."""
    joined = b"\n".join(words)
    return np.array([len(joined)], "<i8").tobytes() + pa.compress(joined, codec="zstd", asbytes=True)


def _unpack_words(raw: bytes) -> list[bytes]:
    size = int(np.frombuffer(raw[:8], "<i8")[0])
    return (pa.decompress(raw[8:], size, codec="zstd", asbytes=True) if size else b"").split(b"\n")


def _hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def _hash_order(words: Sequence[bytes]) -> np.ndarray:
    """Places of distinct words in the order of their hashes; words that share one by themselves."""
    hashes = _hashes(words)
    order = np.argsort(hashes, kind="stable")
    if (np.diff(hashes[order]) == 0).any():
        order = np.array(sorted(range(len(words)), key=lambda k: (hashes[k], words[k])), np.int64)
    return order


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(most_bytes: int):
    """One row per chunk: its documents, their tokens as numbers of the chunk's own words, and these words and their
    training counts in the order of hashes, ``place`` being their numbers. The end of a document is the empty word,
    number 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in pieces_of(batches, "text", most_bytes):
            if not batch.num_rows:
                continue
            numbers, parts = _Numbers({b"": 0}), []
            for text in batch["text"].to_pylist():
                words = text.encode().lower().split()
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                parts.append(np.zeros(1, np.uint32))
            lengths = np.array([len(p) + 1 for p in parts[::2]], np.int64)
            tokens = np.concatenate(parts)
            training = np.repeat(batch["training"].to_numpy(zero_copy_only=False), lengths)
            counts = np.bincount(tokens[training], minlength=len(numbers))
            words = list(numbers)
            place = _hash_order(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 32 | k], pa.int64()),
                    pa.array([batch["doc_id"].to_pylist()], pa.list_(batch["doc_id"].type)),
                    pa.array([_pack(lengths)], pa.binary()),
                    pa.array([_pack(tokens)], pa.binary()),
                    pa.array([_pack(training)], pa.binary()),
                    pa.array([_pack(place.astype(np.uint32))], pa.binary()),
                    pa.array([_pack_words([words[i] for i in place])], pa.binary()),
                    pa.array([_pack(counts[place])], pa.binary()),
                    pa.array([len(words)], pa.int64()),
                    pa.array([int(counts.sum())], pa.int64()),
                ],
                ["chunk", "doc_ids", "lengths", "tokens", "training", "place", "words", "counts", "n_words", "trained"],
            )
            k += 1

    return run


def _sent_words(parts: int):
    """The words of a chunk and their counts: one row for each range of hashes that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                words, counts = _unpack_words(row["words"]), _unpack(row["counts"], np.int64)
                part = ((_hashes(words) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
                begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                ranges = list(zip(begin.tolist(), [*begin[1:].tolist(), len(words)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[begin], pa.int64()),
                        pa.array([row["chunk"]] * len(ranges), pa.int64()),
                        pa.array([_pack_words(words[a:b]) for a, b in ranges], pa.binary()),
                        pa.array([_pack(counts[a:b]) for a, b in ranges], pa.binary()),
                    ],
                    ["part", "chunk", "words", "counts"],
                )

    return run


def _numbered(parts: int):
    """Numbers and counts over all chunks for the words of each (chunk, part), in the order in which they were sent.
    Numbers follow the order of hashes, so a message holds rising ones. One message of a part has its known words."""

    def part(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        asked = [r for batch in held for r in batch.to_pylist()]
        numbers = _Numbers()
        lists = []
        for r in asked:
            words = _unpack_words(r["words"])
            lists.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        totals = np.zeros(len(numbers), np.int64)
        for own, r in zip(lists, asked, strict=True):
            totals[own] += _unpack(r["counts"], np.int64)
        ids = np.empty(len(numbers), U64)
        ids[_hash_order(list(numbers))] = np.arange(1, len(numbers) + 1, dtype=U64) * U64(parts) + U64(asked[0]["part"])
        known = [int((totals > 0).sum()), *[0] * (len(asked) - 1)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r["chunk"] for r in asked], pa.int64()),
                pa.array([r["part"] for r in asked], pa.int64()),
                pa.array([_pack(np.diff(ids[own], prepend=U64(0))) for own in lists], pa.binary()),
                pa.array([_pack(totals[own]) for own in lists], pa.binary()),
                pa.array(known, pa.int64()),
            ],
            ["chunk", "part", "gaps", "totals", "known"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_first_column(batches, part)

    return run


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (chunk, part) to one row per chunk: numbers and counts of its words in the order of hashes."""

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        parts = [r for batch in held for r in batch.to_pylist()]
        ids = np.concatenate([np.cumsum(_unpack(r["gaps"], U64), dtype=U64) for r in parts])
        totals = np.concatenate([_unpack(r["totals"], np.int64) for r in parts])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([parts[0]["chunk"]], pa.int64()),
                pa.array([_pack(ids)], pa.binary()),
                pa.array([_pack(totals)], pa.binary()),
                pa.array([sum(r["known"] for r in parts)], pa.int64()),
            ],
            ["chunk", "ids", "totals", "known"],
        )

    yield from _by_first_column(batches, row)


def _by_first_column(batches: Iterator[pa.RecordBatch], row) -> Iterator[pa.RecordBatch]:
    """``row`` of each run of equal values in the first column; batches may cut a run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column(0)[0].as_py() != int(keys[a]):
                yield row(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield row(held)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them in four bytes."""
    order = np.argsort(keys)
    keys = keys[order]
    fresh = np.r_[True, keys[1:] != keys[:-1]]
    inverse = np.empty(len(keys), np.uint32)
    inverse[order] = np.cumsum(fresh, dtype=np.uint32) - np.uint32(1)
    return keys[fresh], inverse


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time: rows are chunks, and only one of them is unpacked. What it took goes back after it."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]
        pa.default_memory_pool().release_unused()


class _Pairs:
    """Distinct pairs of a chunk in the order in which they are sent: by shard, context, word."""

    def __init__(self, row: dict, shards: int):
        self.tokens = _unpack(row["tokens"], np.uint32)
        place, ids = _unpack(row["place"], np.uint32), np.empty(row["n_words"], U64)
        ids[place] = _unpack(row["ids"], U64)
        self.totals = np.empty(row["n_words"], np.int64)
        self.totals[place] = _unpack(row["totals"], np.int64)
        before = np.r_[np.zeros(1, np.uint32), self.tokens[:-1]]
        unique, self.inverse = _distinct(before.astype(U64) << U64(32) | self.tokens)
        left, right = (unique >> U64(32)).astype(np.uint32), unique.astype(np.uint32)
        context, word = ids[left], ids[right]
        mixed = (context * U64(SPREAD) + word % U64(SPREAD)) * U64(0x9E3779B97F4A7C15)
        shard = ((mixed ^ (mixed >> U64(29))) % U64(shards)).astype(np.int64)
        self.order = np.lexsort((word, context, shard))
        self.shard, self.context, self.word = shard[self.order], context[self.order], word[self.order]
        self.context_total, self.word_total = self.totals[left][self.order], self.totals[right][self.order]
        self.begin = np.flatnonzero(np.r_[True, self.shard[1:] != self.shard[:-1]])
        self.end = np.r_[self.begin[1:], len(self.shard)]


def _requests(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                pairs = _Pairs(row, shards)
                training = _unpack(row["training"], np.bool_)
                counts = np.bincount(pairs.inverse[training], minlength=len(pairs.order))[pairs.order]
                sent = []
                for a, b in zip(pairs.begin, pairs.end, strict=True):
                    context = pairs.context[a:b]
                    gaps = np.r_[context[:1], context[1:] - context[:-1]]
                    columns = (gaps, pairs.word[a:b], counts[a:b].astype(np.uint32), pairs.context_total[a:b], pairs.word_total[a:b])
                    sent.append([_pack(c) for c in columns])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pairs.shard[pairs.begin], pa.int64()),
                        pa.array([row["chunk"]] * len(sent), pa.int64()),
                        *(pa.array([s[k] for s in sent], pa.binary()) for k in range(5)),
                    ],
                    ["shard", "chunk", "gaps", "word", "count", "context_total", "word_total"],
                )

    return run


def _answers(model: PairModel, trained: int, known: int):
    """Codes of all pairs that chunks ask a shard for; a shard's trie lives as long as its task needs it."""

    def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        asked = [r for part in parts for r in part.to_pylist()]

        def column(name: str, kind: type) -> np.ndarray:
            return np.concatenate([_unpack(r.pop(name), kind) for r in asked])

        contexts = [np.cumsum(_unpack(r.pop("gaps"), U64), dtype=U64) for r in asked]
        end = np.cumsum([len(c) for c in contexts]).tolist()
        context = np.concatenate(contexts)
        del contexts
        word, count = column("word", U64), column("count", np.uint32)
        order = np.lexsort((word, context))
        fresh = np.r_[True, (np.diff(context[order]) != 0) | (np.diff(word[order]) != 0)]
        first = np.flatnonzero(fresh)
        total = np.add.reduceat(count[order], first, dtype=np.int64)
        at = order[first[total > 0]]
        total = total[total > 0]
        del order, fresh, first, count
        single = (column("word_total", np.int64)[at] + 1.0) / (trained + known + 1.0)
        logs = np.log10((total + model.prior * single) / (column("context_total", np.int64)[at] + model.prior))
        trie = PairTrie(context[at], word[at], quantise(logs))
        codes = [_pack(trie.lookup(context[a:b], word[a:b])) for a, b in zip([0, *end], end, strict=False)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r["chunk"] for r in asked], pa.int64()), pa.array([r["shard"] for r in asked], pa.int64()), pa.array(codes, pa.binary())],
            ["chunk", "shard", "codes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_first_column(batches, shard)

    return run


def _scored(model: PairModel, trained: int, known: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(_rows(batch)):
                pairs = _Pairs(row, shards)
                codes = np.concatenate([_unpack(a["codes"], np.uint16) for a in sorted(row["answers"], key=lambda a: a["shard"])])
                single = (pairs.word_total + 1.0) / (trained + known + 1.0)
                unseen = np.log10(model.prior * single / (pairs.context_total + model.prior))
                value = np.empty(len(codes))
                value[pairs.order] = np.where(codes > 0, dequantise(codes), unseen)
                base = np.log10((pairs.totals + 1.0) / (trained + known + 1.0))
                lengths = _unpack(row["lengths"], np.int64)
                start = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_ids"].slice(k, 1).flatten(),
                        pa.array(lengths),
                        pa.array(np.add.reduceat((pairs.totals > 0)[pairs.tokens].astype(np.int64), start)),
                        pa.array(np.add.reduceat(base[pairs.tokens], start)),
                        pa.array(np.add.reduceat(value[pairs.inverse], start)),
                    ],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def held_out(doc_id: Column) -> Column:
    """Documents that the model does not learn from: one in seven by the checksum of their id's text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bucketed(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder in buckets of chunks and read it again. Its name leaves the catalog at
    once; the files stay."""
    spark = df.sparkSession
    name = f"panelyard_{uuid.uuid4().hex}"
    df.write.bucketBy(_buckets(spark), "chunk").option("path", shared_path(spark, label)).saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return found


def score_documents(
    docs: DataFrame, model: PairModel | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A missing or empty text is its end alone. Missing ids count as an empty id text and are trained on. Repeated
    rows are counted and scored as often as they occur. Words never trained on get the single-word probability of a
    count of zero. Other columns are left out; an empty table gives an empty result.
    """
    model = model or PairModel()
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (~held_out(F.col(id_col))).alias("training"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"chunk long, doc_ids array<{id_kind}>, lengths binary, tokens binary, training binary, place binary, words binary, counts binary, n_words long, trained long"
    chunks = _bucketed(rows.mapInArrow(_chunks(model.chunk_bytes), shape), "lm-chunks")
    trained, word_rows = (n or 0 for n in chunks.agg(F.sum("trained"), F.sum("n_words")).first())
    parts = max(1, math.ceil(word_rows / model.words_per_part))
    shards = max(1, math.ceil(trained / model.tokens_per_shard))
    sent = chunks.select("chunk", "words", "counts").mapInArrow(
        _sent_words(parts), "part long, chunk long, words binary, counts binary"
    )
    numbered = sent.repartition("part").sortWithinPartitions("part").mapInArrow(
        _numbered(parts), "chunk long, part long, gaps binary, totals binary, known long"
    )
    by_chunk = numbered.repartition(_buckets(docs.sparkSession), "chunk").sortWithinPartitions("chunk", "part")
    maps = _bucketed(by_chunk.mapInArrow(_maps, "chunk long, ids binary, totals binary, known long"), "lm-maps")
    known = maps.agg(F.sum("known")).first()[0] or 0
    # Both tables lie in the same buckets: a hash table of the short side in each, and no row of a chunk moves.
    payload = chunks.select("chunk", "doc_ids", "lengths", "tokens", "training", "place", "n_words")
    mapped = payload.join(maps.drop("known").hint("shuffle_hash"), "chunk")
    asked = mapped.drop("doc_ids", "lengths").mapInArrow(
        _requests(shards),
        "shard long, chunk long, gaps binary, word binary, count binary, context_total binary, word_total binary",
    )
    answers = (
        asked.repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_answers(model, trained, known), "chunk long, shard long, codes binary")
    )
    grouped = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "codes")).alias("answers"))
    scored = mapped.drop("training").join(grouped.hint("shuffle_hash"), "chunk").mapInArrow(
        _scored(model, trained, known, shards),
        f"doc_id {id_kind}, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(trained).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )

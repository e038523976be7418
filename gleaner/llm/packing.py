"""Best-fit packing of tokenized documents by patterns of lengths.

A document is its token ids and the end id. Longer ones than a sequence are cut
into whole sequences, the first piece holding the rest. Only a histogram of
piece lengths, at most one row a length, goes to the driver. There, patterns of
few lengths are enumerated: all pairs and triples that fill a sequence, and
those of up to four that best fit makes. Their repeats are fitted to the
histogram by non-negative least squares and rounded down, and what is left is
packed by best fit, longest first, whole counts at a time. The plan is some
intervals of places for each length, whatever the number of documents; pieces
are numbered within their length and take the places of their number.

Numbers within a length are the piece's number in its task of the tokenizing
stage and an offset of that task, so no length gathers in one place, however
many documents share it.

Defined results: null and empty texts are the end id alone; repeated rows are
packed each, under their own doc_id, null too; an empty table gives no rows;
other columns are ignored; special tokens' strings in a text are what the
tokenizer file makes of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.byte_bpe import ByteLevel
from gleaner.llm.common import Stages, pieces, table, trimmed

CAPACITY, END = 1024, 2
#: Documents of a pattern at most, steps of the fit, and what a sequence costs in it.
FEW, STEPS, THRIFT = 4, 100, 0.005


@dataclass
class Plan:
    """Places by length: pieces of `length` numbered from `first` on take `each` places of one sequence at `offset` and on, then of the next."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        # lengths and first numbers rise together, so both fit one search: a length's numbers follow those of the one before
        starts = np.append(np.flatnonzero(np.diff(self.length, prepend=-1)), len(self.length))
        of = np.searchsorted(self.length[starts[:-1]], length)
        i = np.empty(len(length), np.int64)
        for k in np.unique(of):
            here = of == k
            i[here] = starts[k] + np.searchsorted(self.first[starts[k] : starts[k + 1]], number[here], side="right") - 1
        nth = number - self.first[i]
        return self.sequence[i] + nth // self.each[i], self.offset[i] + nth % self.each[i] * length


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Pairs and triples of the lengths that fill a sequence, longest first, 0 for none."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    near = (a >= b) & (a + b <= capacity)
    a, b = a[near], b[near]
    rest = capacity - a - b
    full = (rest <= b) & there[rest]
    return np.stack([a[full], b[full], rest[full]], 1)


def fitted(made: np.ndarray, counts: np.ndarray, start: np.ndarray, steps: int = STEPS, thrift: float = THRIFT) -> np.ndarray:
    """Repeats x >= 0 of patterns that bring the uses of each length near its count.

    Least squares by projected gradients with momentum, from `start` on; each
    repeat costs `thrift` of the largest count, so that of equal fits the one
    of fewer sequences is sought.
    """
    width = made.shape[1]

    def uses(x: np.ndarray) -> np.ndarray:
        out = np.bincount(made.ravel(), np.repeat(x, width), minlength=len(counts))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[made].sum(1)

    x, y, momentum = start, start, 1.0
    # no eigenvalue of the squared problem is above its largest row sum
    step, cost = 1.0 / back(uses(np.ones(len(made)))).max(), thrift * counts.max()
    for _ in range(steps):
        new = np.maximum(0.0, y - step * (back(uses(y) - counts) + cost))
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        x, y, momentum = new, new + (momentum - 1) / after * (new - x), after
    return x


def rounded(made: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole repeats, rounded down, that use no length more often than it occurs; frequent patterns first."""
    repeats, left = np.zeros(len(x), np.int64), counts.copy()
    for p in np.argsort(-x, kind="stable"):
        if x[p] < 1:
            break
        own, times = np.unique(made[p][made[p] > 0], return_counts=True)
        repeats[p] = min(int(x[p]), int((left[own] // times).min()))
        left[own] -= repeats[p] * times
    return repeats


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their repeats by best fit, longest first; sequences that are alike are filled together."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = min((r for r, bins in room.items() if r >= length and bins), default=None)
            if fits is None:
                each = capacity // length
                full, some = divmod(left, each)
                if full:
                    room.setdefault(capacity - each * length, []).append(((length,) * each, full))
                if some:
                    room.setdefault(capacity - some * length, []).append(((length,) * some, 1))
                break
            held, many = room[fits].pop()
            # as many of them into each of these sequences as best fit would put there one by one
            each = min(fits // length, -(-left // many))
            take = min(many, left // each)
            room.setdefault(fits - each * length, []).append((held + (length,) * each, take))
            if take < many:
                room[fits].append((held, many - take))
            left -= take * each
    return [x for bins in room.values() for x in bins]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Places for all pieces of a histogram of lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    chosen: list[tuple[tuple[int, ...], int]] = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    lengths = np.flatnonzero(left)
    if len(lengths):
        full = patterns(lengths, capacity)
        known = [x for x in best_fit({int(x): int(left[x]) for x in lengths}, capacity) if len(x[0]) <= FEW]
        made = np.zeros((len(full) + len(known), FEW), np.int64)
        made[: len(full), :3] = full
        start = np.zeros(len(made))
        for i, (pattern, repeats) in enumerate(known, len(full)):
            made[i, : len(pattern)] = pattern
            start[i] = repeats
        # sequences of many short pieces are best fit's: the patterns are fitted to the others
        share = np.bincount(made.ravel(), np.repeat(start, FEW), minlength=capacity + 1)
        share[0] = 0
        if len(made):
            repeats = rounded(made, fitted(made, share, start), left)
            for p in np.flatnonzero(repeats):
                pattern = tuple(int(x) for x in made[p] if x)
                chosen.append((pattern, int(repeats[p])))
                for x in pattern:
                    left[x] -= repeats[p]
    chosen += best_fit({int(x): int(left[x]) for x in np.flatnonzero(left)}, capacity)

    rows, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, repeats in chosen:
        offset = 0
        for length in dict.fromkeys(pattern):
            each = pattern.count(length)
            rows.append((length, taken[length], each, sequence, offset))
            taken[length] += each * repeats
            offset += each * length
        sequence += repeats
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequence)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth, and ids where asked for): nth numbers the pieces of one length in a task."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteLevel(file.value)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 21):
                ids, n = bpe.encode(batch.column(1))
                rows = len(n)
                size = n + 1
                all_ids = np.full(int(size.sum()), end, "<u4")
                last = np.cumsum(size) - 1
                mine = np.ones(len(all_ids), bool)
                mine[last] = False
                all_ids[mine] = ids
                many = -(-size // capacity)
                row = np.repeat(np.arange(rows), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                head = size - (many - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                begin = (last - n)[row] + start
                # the number of each piece among those of its length: its place in a stable sort, less the length's first
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.searchsorted(sorted_, sorted_)
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                raw = memoryview(all_ids.tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + z)]) for a, z in zip(begin.tolist(), length.tolist())), np.int64, len(row))
                columns = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int64)), pa.array(crc), pa.array(np.full(len(row), task, np.int64)), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if keep_ids:
                    # pieces stand end to end in the order of their documents
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(all_ids)).astype(np.int32)), pa.array(all_ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """One row a piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids where asked for)."""
    spark = docs.sparkSession
    stages = Stages(spark, "packing")
    cut = stages.put(tokenized_pieces(docs, tokenizer_path, capacity, end, keep_ids), "pieces")
    tasks = stages.put(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "tasks")
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length, at most `capacity`
    places = spark.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = cut.join(offsets.hint("merge"), ["task", "length"]).withColumn("number", F.col("nth") + F.col("before"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"
    return numbered.select(*kept, "number").mapInArrow(run, schema)


def op13_best_fit_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

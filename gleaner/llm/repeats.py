"""Windows of a fixed length that occur more than once in a collection, found exactly and without comparing all pairs.

Every window of `window` units (bytes or words) picks an anchor: of the
`anchor`-unit sequences in it, the first of lowest hash. Equal windows pick
equal anchors at the same place, so only passages around anchors that occur
twice need a closer look. Neighbouring windows with one anchor form a passage
of window + n - 1 units, which travels as one row instead of n.

1. Anchors are counted; those that occur once are dropped.
2. Passages around the rest are cut from the texts. Equal ones (by a 128-bit
   cryptographic digest) are merged into one with its first place and the
   number of its places; a passage that has one place and its anchor to itself
   can't repeat and is dropped.
3. The merged passages go, grouped by anchor, to an exact matcher. It decides
   about every window of every passage: where in the collection that window
   stands first. Without its word nothing is removed.
4. All places of a passage take what the matcher said of it: a window that
   stands after its first place is a repeat.

An anchor with more than `hot` different passages is dealt out by window: its
passages are cut into single windows, merged and matched in the same way, so
one frequent phrase never lands in one task.

Documents stand in the order of doc_id. Rows that share a doc_id and differ in
text are documents of their own, in the order of a hash of their texts; rows
equal in both are one document, and come out alike.

Each step is a written table. What grows with the input is shuffled by hash
and sorted, never broadcast, and joins on frequent keys can be split by AQE.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Stages, pieces, trimmed, utf8
from gleaner.llm.words import BYTE_VALUES, mixed, prefix_hash, span_hash, word_hashes, word_spans

#: The place of documents without doc_id.
LAST = (1 << 63) - 1
#: Where the numbers of rows begin that doc_id doesn't tell apart.
OTHER_IDS = 1 << 61
PLACE_BITS = 20
STRIDE = 1 << 19


@dataclass(frozen=True)
class Units:
    """How texts are cut: by byte or by word; how long a window and an anchor are; whether an earlier place in the same document counts."""

    words: bool
    window: int
    anchor: int
    within: bool

    def values(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each unit of a text column, and where each row starts."""
        data, at = utf8(column)
        if not self.words:
            return BYTE_VALUES[data], at
        starts, ends, n = word_spans(data, at)
        return word_hashes(data, starts, ends), np.concatenate([[0], np.cumsum(n)])

    def cut(self, text: str | None) -> bytes | list[bytes]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return raw.split() if self.words else raw

    def passage(self, units: bytes | list[bytes], start: int, n: int) -> bytes:
        part = units[start : start + n + self.window - 1]
        return b" ".join(part) if self.words else part


def anchored_runs(values: np.ndarray, at: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: row, first window's start in the row, number of windows, hash of the anchor."""
    rows, starts, counts, hashes = [], [], [], []
    sizes = np.diff(at)
    ends = np.repeat(at[1:], sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    span = window - anchor + 1
    for lo in range(0, max(0, len(values) - window + 1), STRIDE):
        part = values[lo : lo + STRIDE + window - 1]
        n = len(part) - anchor + 1
        prefix = prefix_hash(part)
        place = np.arange(n)
        grams = mixed(span_hash(prefix, place, place + anchor))
        key = (grams & ~mask) | place.astype(np.uint64)
        size, low = 1, key
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        m = n - span + 1
        low = np.minimum(low[:m], low[span - size : span - size + m])
        here = np.arange(lo, lo + m)
        fits = np.flatnonzero(ends[lo : lo + m] - here >= window)
        if not len(fits):
            continue
        chosen = (low[fits] & mask).astype(np.int64)
        new = np.ones(len(fits), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (fits[1:] != fits[:-1] + 1)
        first = np.flatnonzero(new)
        row = owner[lo + fits[first]]
        rows.append(row)
        starts.append(lo + fits[first] - at[row])
        counts.append(np.diff(np.append(first, len(fits))))
        hashes.append(grams[chosen[first]].view(np.int64))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, starts, counts, hashes))


def keyed(docs: DataFrame, stages: Stages) -> DataFrame:
    """docs with doc, tie and again.

    doc and tie tell documents apart and put them in order: doc_id (those
    without come last), and a hash of the text where doc_id has several texts
    or is missing. again: other rows may have the same doc and tie.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = docs.withColumn("doc", doc)
    ids = stages.put(rows.groupBy("doc").agg(F.count("*").alias("n")).where(f"n > 1 or doc = {LAST}").select("doc"), "repeated_ids")
    if ids.isEmpty():
        return rows.withColumns({"tie": F.lit(0).cast("long"), "again": F.lit(False)})
    # written tables: Spark broadcasts them only where their real size is below the threshold
    texts = rows.select("doc", F.xxhash64("text").alias("x")).join(ids, "doc", "left_semi").distinct().groupBy("doc").agg(F.count("*").alias("texts"))
    texts = stages.put(texts, "texts_of_ids")
    told = (F.col("texts") > 1) | ((F.col("doc") == LAST) & F.col("texts").isNotNull())
    return rows.join(texts, "doc", "left").withColumns({"tie": F.when(told, F.xxhash64("text")).otherwise(F.lit(0).cast("long")), "again": F.col("texts").isNotNull()}).drop("texts")


def without_equal_rows(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of keyed, each key once; only rows that may have others like them are compared."""
    return rows.where(~F.col("again")).unionByName(rows.where("again").dropDuplicates(list(key)))


def row_ids(docs: DataFrame, stages: Stages) -> DataFrame:
    """docs with row_id and again: doc_id where it has one text, else a number of 2**61 or more (2**62 without doc_id) from doc_id and text. Only equal rows share one."""
    rows = keyed(docs, stages)
    low = F.when(F.col("doc") == LAST, F.lit(2 * OTHER_IDS)).otherwise(F.lit(OTHER_IDS))
    other = low + F.pmod(F.xxhash64("doc", "tie"), low)
    return rows.withColumn("row_id", F.when(F.col("tie") == 0, F.col("doc")).otherwise(other)).drop("doc", "tie")


def anchors(docs: DataFrame, units: Units, places: bool) -> DataFrame:
    """(h), or with places (h, doc, tie, run), of every run of windows; run packs its start and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                values, at = units.values(batch.column(2))
                row, start, n, h = anchored_runs(values, at, units.window, units.anchor)
                if not places:
                    yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])
                else:
                    doc, tie = (batch.column(i).to_numpy()[row] for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, doc, tie, start * 256 + n)], names=["h", "doc", "tie", "run"])

    return docs.mapInArrow(trimmed(run), "h long, doc long, tie long, run long" if places else "h long")


def digest(passage: bytes) -> bytes:
    return hashlib.blake2b(passage, digest_size=16).digest()


def cut(docs: DataFrame, runs: DataFrame, units: Units, how: str) -> DataFrame:
    """The passages of runs(doc, tie, h, run, copies).

    how: "digests" gives (h, sk, doc, tie, start, n); "windows" the same for
    every window of them alone; "passages" gives (h, sk, doc, tie, start,
    copies, passage).
    """
    lists = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("h", "run", "copies")).alias("runs"))
    source = docs.join(lists.hint("merge"), ["doc", "tie"]).select("doc", "tie", "text", "runs")
    whole = how == "passages"
    names = ["h", "sk", "doc", "tie", "start", "copies", "passage"] if whole else ["h", "sk", "doc", "tie", "start", "n"]
    kinds = {"sk": pa.binary(), "passage": pa.binary()}

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(name, pa.int64())) for name, x in zip(names, zip(*out))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, tie, text, runs in zip(*batch.columns):
                parts = units.cut(text.as_py())
                doc, tie, runs = doc.as_py(), tie.as_py(), runs.values
                for h, packed, copies in zip(*[runs.field(i).to_pylist() for i in range(3)]):
                    start, n = packed >> 8, packed & 255
                    passage = units.passage(parts, start, n)
                    if whole:
                        out.append((h, digest(passage), doc, tie, start, copies, passage))
                        size += len(passage) + 50
                    elif how == "digests":
                        out.append((h, digest(passage), doc, tie, start, n))
                        size += 60
                    else:
                        inside = units.cut(passage.decode("utf-8", "surrogatepass")) if units.words else passage
                        for i in range(n):
                            out.append((h, digest(units.passage(inside, i, 1)), doc, tie, start + i, 1))
                        size += 60 * n
                    if size > 1 << 22:
                        yield batch_of(out)
                        out, size = [], 0
            if out:
                yield batch_of(out)

    schema = ", ".join(f"{x} {'binary' if x in kinds else 'long'}" for x in names)
    return source.mapInArrow(trimmed(run), schema)


@dataclass
class Block:
    """Different passages, grouped by anchor: their bytes, how often each stands in the collection, and its first place (doc, tie, start)."""

    passages: list[bytes]
    copies: np.ndarray
    places: np.ndarray


#: Tells of runs of windows where each of them stands first: passage, offset in units, number of windows, and passage and
#: offset of the run's first place. Windows of a passage with one place may be left out where they stand there first.
Matcher = Callable[[Block], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def earliest(group: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each row the row of its group with the least place."""
    order = np.lexsort((places[:, 2], places[:, 1], places[:, 0], group))
    g = group[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    out = np.empty(len(g), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]
    return out


def joined_runs(passage: np.ndarray, offset: np.ndarray, n: np.ndarray, first_passage: np.ndarray, first_offset: np.ndarray) -> list[np.ndarray]:
    """Runs that continue one another, here and at their first places, as one."""
    order = np.lexsort((offset, passage))
    p, o, n, fp, fo = (x[order] for x in (passage, offset, n, first_passage, first_offset))
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1] + n[:-1]) | (fp[1:] != fp[:-1]) | (fo[1:] != fo[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return [p[at], o[at], np.add.reduceat(n, at) if len(at) else n, fp[at], fo[at]]


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of about `size` passages from rows sorted by h; the passages of one h stay together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            edges = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
            done = 0
            while n - done >= size and (later := edges[(edges >= done + size) & (edges < len(h))]).size:
                yield table.slice(done, int(later[0]) - done)
                done = int(later[0])
            held = table.slice(done).combine_chunks().to_batches()
            n -= done
    if n:
        yield pa.Table.from_batches(held)


def repeated_spans(docs: DataFrame, units: Units, matcher: Matcher, stages: Stages, hot: int = 8_000, block: int = 2_000) -> DataFrame:
    """(doc, tie, start, end), in units, of runs of windows that also start earlier in the collection; runs of a document may overlap.

    docs: (doc_id, text). A null text has no windows.
    """
    window = units.window
    docs = without_equal_rows(keyed(docs.select("doc_id", "text"), stages).where("text is not null"), "doc", "tie").select("doc", "tie", "text")
    common = stages.put(anchors(docs, units, False).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "common")
    found = stages.put(anchors(docs, units, True).join(common.hint("merge"), "h", "left_semi").withColumn("copies", F.lit(1).cast("long")), "found")
    stages.drop("common")
    places = stages.put(cut(docs, found, units, "digests"), "places")

    def merged_passages(rows: DataFrame) -> DataFrame:
        first = F.min(F.struct("doc", "tie", "start")).alias("first")
        return rows.groupBy("sk").agg(first, F.count("*").alias("copies"), F.first("h").alias("h"), F.first("n").alias("n"))

    kinds = stages.put(merged_passages(places), "kinds")
    several = stages.put(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    frequent = stages.put(several.where(F.col("kinds") > hot).select("h"), "frequent")
    chosen = kinds.join(several.hint("merge"), "h", "left").where((F.col("copies") > 1) | F.col("kinds").isNotNull()).where(F.coalesce("kinds", F.lit(0)) <= hot)
    runs = chosen.select("first.*", "h", "n", "copies")
    if not frequent.isEmpty():
        again = found.join(frequent, "h", "left_semi")
        single = stages.put(cut(docs, again, units, "windows"), "single")
        places = places.unionByName(single)
        # windows that occur twice; each is matched alone, so they spread by their own digest
        runs = runs.unionByName(merged_passages(single).where("copies > 1").select("first.*", F.xxhash64("sk").alias("h"), "n", "copies"))
    runs = runs.select("doc", "tie", "h", (F.col("start") * 256 + F.col("n")).alias("run"), "copies")
    passages = cut(docs, runs, units, "passages").repartition("h").sortWithinPartitions("h", "doc", "tie", "start")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, block):
            place = np.stack([table.column(c).to_numpy() for c in ("doc", "tie", "start")], axis=1)
            copies = table.column("copies").to_numpy()
            p, o, n, fp, fo = matcher(Block(table.column("passage").to_pylist(), copies, place))
            use = np.flatnonzero((copies[p] > 1) | (fp != p) | (fo != o))
            if not len(use):
                continue
            p, o, n, fp, fo = joined_runs(*(x[use] for x in (p, o, n, fp, fo)))
            sk = table.column("sk").combine_chunks().take(pa.array(p))
            rows = [pa.array(x.astype(np.int64)) for x in (o, n, place[fp, 0], place[fp, 1], place[fp, 2] + fo)]
            yield pa.RecordBatch.from_arrays([sk, *rows], names=["sk", "offset", "windows", "first_doc", "first_tie", "first_start"])

    said = stages.put(passages.mapInArrow(trimmed(match), "sk binary, offset long, windows long, first_doc long, first_tie long, first_start long"), "said")
    start = F.col("start") + F.col("offset")
    here, first = [F.col("doc"), F.col("tie")], [F.col("first_doc"), F.col("first_tie")]
    if units.within:
        here, first = [*here, start.alias("start")], [*first, F.col("first_start").alias("start")]
    late = F.struct(*[x.alias(f"x{i}") for i, x in enumerate(first)]) < F.struct(*[x.alias(f"x{i}") for i, x in enumerate(here)])
    spans = places.select("sk", "doc", "tie", "start").join(said.hint("merge"), "sk").where(late).select("doc", "tie", start.alias("start"), (start + F.col("windows") - 1 + window).alias("end"))
    spans = stages.put(spans, "spans")
    for name in ("found", "places", "kinds", "several", "frequent", "single", "said"):
        stages.drop(name)
    return spans


def merged(spans: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs, as rows of start and end, of spans clipped to length."""
    spans = np.clip(spans.reshape(-1, 2), 0, length)
    spans = spans[spans[:, 0] < spans[:, 1]]
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def with_spans(docs: DataFrame, spans: DataFrame, stages: Stages) -> DataFrame:
    """docs with spans array<struct<start, end>>, null where a document has none."""
    lists = spans.groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return keyed(docs, stages).join(lists.hint("merge"), ["doc", "tie"], "left").drop("doc", "tie", "again")


def rows_of(batch: pa.RecordBatch, column: str = "spans") -> Iterator[np.ndarray]:
    """The spans of each row as an array of start and end."""
    for x in batch.column(batch.schema.get_field_index(column)):
        if not x.is_valid:
            yield np.empty((0, 2), np.int64)
        else:
            yield np.stack([x.values.field("start").to_numpy(), x.values.field("end").to_numpy()], axis=1)


"""Suffix-array dedup: byte strings that also start earlier in the collection are removed.

The passages that may repeat (see repeats.py) are sorted by a column-wise
multi-document construction: round j inserts the j-th last symbol of every
document, so after each round the files hold the Burrows-Wheeler transform of
all suffixes so far and the common prefix of each with the one before it. New
suffixes find their places by counting equal symbols before them, and new
common prefixes are one more than the minimum over the stretch between
neighbours. Files are read and written from start to end once a round.
Afterwards suffixes that share `window` bytes stand together, and the first of
them in the collection is known; that alone decides what is removed.

A symbol is four bytes. A passage is four documents then, one for each
alignment of its bytes, so every byte starts a suffix, and the rounds are a
quarter as many. A run of windows that shares none of them with another run of
the block, by a hash, can only repeat as a whole: it is one document.

Defined results: a null text counts as empty; texts shorter than the window
lose nothing; rows without doc_id take no part and keep everything (with
`unnamed` they come after all others); rows that share a doc_id and differ in
text are documents of their own, in the order of a hash of their texts, and
rows equal in both get equal results; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Stages, table, trimmed
from gleaner.llm.repeats import Block, Units, earliest, merged, repeated_spans, rows_of, with_spans
from gleaner.llm.words import BYTE_VALUES, prefix_hash, span_hash

#: Bytes of a symbol.
SYMBOL = 4


class Column:
    """One file of the collection; each round reads it from start to end and writes its successor."""

    def __init__(self, folder: str, name: str, kind: type):
        self.folder, self.name, self.kind, self.round = folder, name, kind, 0

    def path(self) -> str:
        return os.path.join(self.folder, f"{self.name}.{self.round}")

    def read(self) -> np.ndarray:
        return np.fromfile(self.path(), self.kind)

    def write(self, values: np.ndarray) -> None:
        # a new name each round: replacing a file in place would make the file system flush it
        if self.round:
            os.remove(self.path())
        self.round += 1
        values.astype(self.kind, copy=False).tofile(self.path())


def aligned(passages: list[bytes], width: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages as documents of symbols of `width` bytes, one for each alignment, or the first alone where `whole` is true.

    Symbols of all documents end to end, as ranks from 1; each document's
    number of symbols, passage and first byte. Bytes that fill no symbol are left out.
    """
    n = len(passages)
    lengths = np.fromiter(map(len, passages), np.int64, n)
    data = np.frombuffer(b"".join(passages) + bytes(width), np.uint8).astype(np.uint64)
    word = np.zeros(len(data) - width, np.uint64)
    for i in range(width):
        word = (word << np.uint64(8)) | data[i : i + len(word)]
    shift = np.tile(np.arange(width), n)
    owner = np.repeat(np.arange(n), width)
    use = (shift == 0) | ~whole[owner]
    owner, shift = owner[use], shift[use]
    sizes = np.maximum((lengths[owner] - shift) // width, 0)
    first = (np.cumsum(lengths) - lengths)[owner] + shift
    place = np.repeat(first - width * (np.cumsum(sizes) - sizes), sizes) + width * np.arange(sizes.sum())
    used, rank = np.unique(word[place], return_inverse=True)
    return (rank + 1).astype(np.uint16 if len(used) < 65_535 else np.uint32), sizes, owner, shift


def collection_order(passages: list[bytes], width: int = 1, most: int = 65_535, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of the passages in sorted order: passage, first byte, and bytes in common with the suffix before (up to `most` symbols).

    width: bytes of a symbol. whole: passages with one alignment only.
    Symbols stand as ranks from 1; 0 in the transform marks a document's start.
    """
    data, lengths, passage, shift = aligned(passages, width, np.zeros(len(passages), bool) if whole is None else whole)
    n = len(lengths)
    ends = np.cumsum(lengths)
    some = lengths > 0
    with tempfile.TemporaryDirectory() as folder:
        bwt, lcp = Column(folder, "bwt", data.dtype.type), Column(folder, "lcp", np.uint8 if most < 256 else np.uint16)
        bwt.write(np.where(some, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0))
        lcp.write(np.zeros(n))
        latest = np.arange(n)  # where each document's longest suffix so far stands
        active = np.flatnonzero(some)
        for j in range(1, int(lengths.max(initial=0)) + 1):
            active = active[lengths[active] >= j]
            symbols, shared = bwt.read(), lcp.read()
            order = np.argsort(symbols, kind="stable")
            # the new suffixes in their order: by symbol, then by the place of the suffix that they extend
            p = latest[active]
            moved = np.zeros(len(symbols), bool)
            moved[p] = True
            r = np.flatnonzero(moved[order])
            by = np.argsort(p)
            by = by[np.argsort(symbols[p[by]], kind="stable")]
            active, p = active[by], p[by]
            done = int(np.count_nonzero(symbols == 0))
            to = n + r - done
            before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(order) - 1)]
            has_before = (r > 0) & (symbols[before] == symbols[p])
            has_after = (r + 1 < len(order)) & (symbols[after] == symbols[p])
            breaks = np.cumsum(shared == 0, dtype=np.int32)
            up = np.zeros(len(p), shared.dtype)
            up[has_before] = extended(shared, breaks, before[has_before], p[has_before], most)
            down = extended(shared, breaks, p[has_after], after[has_after], most)
            old = np.ones(len(symbols) + len(active), bool)
            old[to] = False

            def grown(values: np.ndarray, new: np.ndarray) -> np.ndarray:
                out = np.empty(len(old), values.dtype)
                out[old] = values
                out[to] = new
                return out

            at = ends[active] - j
            bwt.write(grown(symbols, np.where(lengths[active] == j, 0, data[np.maximum(at - 1, 0)])))
            shared = grown(shared, up)
            shared[to[has_after] + 1] = down
            lcp.write(shared)
            latest[active] = to
        symbols, shared = bwt.read(), lcp.read()
    # each document read back from its end: a suffix stands at the rank of the symbol before the one that is shorter by one
    rank = np.empty(len(symbols), np.int64)
    rank[np.argsort(symbols, kind="stable")] = np.arange(len(symbols))
    owner, start = np.empty(len(symbols), np.int64), np.empty(len(symbols), np.int64)
    owner[:n], start[:n] = np.arange(n), lengths
    p, live, j = np.arange(n), np.flatnonzero(some), 0
    while len(live):
        j += 1
        p[live] = rank[p[live]]
        owner[p[live]], start[p[live]] = live, lengths[live] - j
        live = live[lengths[live] > j]
    return passage[owner], shift[owner] + start * width, shared.astype(np.int64) * width


def extended(shared: np.ndarray, breaks: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> np.ndarray:
    """One more than the minimum of shared over (lo, hi], at most `most`. breaks: the zeros of shared, counted; most stretches hold one."""
    out = np.ones(len(lo), shared.dtype)
    inside = np.flatnonzero(breaks[hi] == breaks[lo])
    if len(inside):
        a, b = lo[inside] + 1, hi[inside] + 1
        order = np.argsort(a, kind="stable")
        edges = np.stack([a[order], b[order]], axis=1).ravel()
        least = np.minimum.reduceat(np.append(shared, shared[-1:]), edges)[::2]
        out[inside[order]] = np.minimum(least, most - 1) + 1
    return out


def shared_windows(window: int):
    """The matcher of repeats.py that sorts a block's suffixes."""
    width = SYMBOL if window % SYMBOL == 0 and window // SYMBOL < 256 else 1

    def match(block: Block) -> tuple[np.ndarray, ...]:
        passage, offset, n, alike = runs_to_sort(block, window)
        nothing = np.empty(0, np.int64)
        if not len(passage):
            return (nothing,) * 5
        # equal runs are one string
        number: dict[bytes, int] = {}
        texts = (block.passages[i][o : o + k + window - 1] for i, o, k in zip(passage.tolist(), offset.tolist(), n.tolist()))
        string = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(passage))
        place = block.places[passage]
        place[:, 2] += offset
        lead = np.unique(earliest(string, place))
        lead = lead[np.argsort(string[lead])]  # the earliest run of each string
        owner, start, common = collection_order(list(number), width, window // width, ~alike[lead])
        group = np.cumsum(common < window)
        use = (n[lead][owner] > start) & (alike[lead][owner] | (start == 0))
        owner, start, group = owner[use], start[use], group[use]
        place = block.places[passage[lead[owner]]]
        place[:, 2] += offset[lead[owner]] + start
        first = earliest(group, place)
        first_passage, first_offset = passage[lead[owner[first]]], offset[lead[owner[first]]] + start[first]
        # every run takes what the sort says of its string: window by window, or as a whole
        base = np.cumsum(n[lead]) - n[lead]
        row = np.zeros(int(n[lead].sum()), np.int64)
        row[base[owner] + start] = np.arange(len(owner))
        whole, parts = np.flatnonzero(~alike), np.flatnonzero(alike)
        each = np.repeat(parts, n[parts])
        inside = np.arange(len(each)) - np.repeat(np.cumsum(n[parts]) - n[parts], n[parts])
        rows = np.concatenate([row[base[string[whole]]], row[base[string[each]] + inside]])
        return (
            np.concatenate([passage[whole], passage[each]]), np.concatenate([offset[whole], offset[each] + inside]), np.concatenate([n[whole], np.ones(len(each), np.int64)]),
            first_passage[rows], first_offset[rows],
        )

    return match


def runs_to_sort(block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that may repeat: passage, first offset, number of windows, and whether their hashes occur twice in the block.

    Windows of a passage with one place are left out where their hash occurs once.
    """
    lengths = np.fromiter(map(len, block.passages), np.int64, len(block.passages))
    at = np.cumsum(lengths) - lengths
    n = np.maximum(lengths - window + 1, 0)
    passage = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = at[passage] + offset
    prefix = prefix_hash(BYTE_VALUES[np.frombuffer(b"".join(block.passages), np.uint8)])
    return window_runs(span_hash(prefix, start, start + window), passage, offset, block.copies)


def window_runs(hashes: np.ndarray, passage: np.ndarray, offset: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows, in order, the runs that may repeat (see runs_to_sort)."""
    _, kind, count = np.unique(hashes, return_inverse=True, return_counts=True)
    alike = count[kind] > 1
    likely = np.flatnonzero(alike | (copies[passage] > 1))
    new = np.ones(len(likely), bool)
    new[1:] = (likely[1:] != likely[:-1] + 1) | (passage[likely[1:]] != passage[likely[:-1]]) | (alike[likely[1:]] != alike[likely[:-1]])
    first = np.flatnonzero(new)
    return passage[likely[first]], offset[likely[first]], np.diff(np.append(first, len(likely))), alike[likely[first]]


UNITS = Units(words=False, window=100, anchor=24, within=True)


def removal_spans(docs: DataFrame, units: Units = UNITS, unnamed: bool = False) -> DataFrame:
    """(doc, tie, start, end): byte runs to remove (see repeats.py); runs of a document may overlap. unnamed: rows without doc_id take part."""
    rows = docs.select("doc_id", "text") if unnamed else docs.select("doc_id", "text").where("doc_id is not null")
    return repeated_spans(rows, units, shared_windows(units.window), Stages(docs.sparkSession, "suffix"))


def without(raw: bytes, runs: np.ndarray) -> bytes:
    """The bytes outside the runs."""
    at, kept = 0, []
    for start, end in runs.tolist():
        kept.append(raw[at:start])
        at = end
    return b"".join(kept) + raw[at:]


def deduplicated(docs: DataFrame, spans: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, and of each text: n_bytes, n_removed, n_spans, kept_sha256, and text without the removed bytes.

    A character of which bytes are gone is left out of that text; kept_sha256 is of the bytes.
    """
    source = docs.select("doc_id", *[c for c in keep if c != "doc_id"], *[c for c in ("text",) if c not in keep])
    kept = [c for c in keep if c != "text"]
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, n, sums, texts = [], [], [], [], []
            for text, spans in zip(batch.column(batch.schema.get_field_index("text")), rows_of(batch)):
                text = text.as_py()
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs = merged(spans, len(raw))
                rest = without(raw, runs) if len(runs) else raw
                sizes.append(len(raw))
                gone.append(len(raw) - len(rest))
                n.append(len(runs))
                sums.append(hashlib.sha256(rest).hexdigest())
                texts.append(rest.decode("utf-8", "ignore") if len(runs) else text)
            rows = [batch.column(batch.schema.get_field_index(k)) for k in kept]
            made = [pa.array(x, pa.int64()) for x in (sizes, gone, n)] + [pa.array(sums, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(rows + made, names=[*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return with_spans(source, spans, Stages(docs.sparkSession, "suffix")).mapInArrow(trimmed(run), schema)


def op1_suffix_array_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return deduplicated(docs, removal_spans(docs)).drop("text")


OP1_SQL = r"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
win as (select doc_id, i, substr(h, 2 * i + 1, 200) as key from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as i from b where length(h) >= 200)),
early as (select key, min(struct_pack(d := doc_id, i := i)) as f from win group by key having count(*) > 1),
late as (select win.doc_id, win.i from win join early using (key) where early.f <> struct_pack(d := win.doc_id, i := win.i)),
edge as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt, lag(i) over (partition by doc_id order by i) as prv from late),
runs as (select doc_id, i, sum(case when prv is null or i > prv + 100 then 1 else 0 end) over (partition by doc_id order by i) as run from edge),
span as (select doc_id, run, min(i) as s, max(i) + 100 as e from runs group by all),
cuts as (select doc_id, list(struct_pack(s := s, e := e) order by s) as xs from span group by doc_id),
kept as (select b.doc_id, h, coalesce(xs, []) as xs from b left join cuts using (doc_id)),
pieces as (select doc_id, h, xs, list_transform(range(0, len(xs) + 1), lambda k: substr(h, 2 * (case when k = 0 then 0 else xs[k].e end) + 1, 2 * ((case when k = len(xs) then length(h) // 2 else xs[k + 1].s end) - (case when k = 0 then 0 else xs[k].e end)))) as ps from kept)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(list_sum(list_transform(xs, lambda x: x.e - x.s)), 0) as bigint) as n_removed, cast(len(xs) as bigint) as n_spans, sha256(unhex(array_to_string(ps, ''))) as kept_sha256 from pieces
"""

"""Substring dedup by repeated-phrase automata.

Passages that may recur (see repeats.py) are grouped by the phrase that
anchors them, which routes every passage of every document to the shard that
can know it. In each shard the recurring phrases are confirmed, compiled into
one Aho-Corasick automaton over word numbers, and every passage is streamed
through it to locate all occurrences. A phrase is a window that stands in two
passages, or a run of windows of a passage that recurs as a whole. What the
automaton locates alone decides: a word goes when a located window that covers
it also starts in a document of smaller doc_id.

Defined results: a null text has no words; texts with fewer words than the
window lose nothing; rows without doc_id take no part and keep everything (with
`unnamed` they come after all others); rows that share a doc_id and differ in
text are documents of their own, in the order of a hash of their texts, and
rows equal in both get equal results; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Stages, table, trimmed
from gleaner.llm.repeats import Block, Units, earliest, merged, repeated_spans, rows_of, with_spans
from gleaner.llm.suffix_dedup import window_runs
from gleaner.llm.words import mixed, prefix_hash, span_hash

UNITS = Units(words=True, window=50, anchor=10, within=False)


def numbered(passages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The passages' words as numbers, end to end (equal words, equal numbers), and where each passage starts."""
    numbers: dict[bytes, int] = {}
    words = [p.split(b" ") for p in passages]
    flat = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for p in words for w in p), np.int64)
    return flat, np.concatenate([[0], np.cumsum([len(p) for p in words])])


def located_windows(window: int):
    """The matcher of repeats.py that compiles a shard's recurring phrases and streams its passages through them."""

    def match(block: Block) -> tuple[np.ndarray, ...]:
        flat, at = numbered(block.passages)
        n = np.maximum(np.diff(at) - window + 1, 0)
        passage = np.repeat(np.arange(len(n)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = at[passage] + offset
        prefix = prefix_hash(mixed(flat.astype(np.uint64)))
        run, first, size, alike = window_runs(span_hash(prefix, start, start + window), passage, offset, block.copies)
        if not len(run):
            return (np.empty(0, np.int64),) * 5
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        phrases = 0
        for p, o, k, a in zip((at[run] + first).tolist(), first.tolist(), size.tolist(), alike.tolist()):
            # windows that other passages may hold are phrases of their own; other runs recur as one
            for i, k in [(p + j, 1) for j in range(k)] if a else [(p, k)]:
                key = tuple(flat[i : i + k + window - 1].tolist())
                if key not in automaton:
                    automaton.add_word(key, (phrases, k))
                    phrases += 1
        automaton.make_automaton()
        found: list[tuple[int, int, int, int]] = []
        for p in np.unique(run).tolist():  # the others hold no phrase: equal windows have equal hashes
            found += [(phrase, p, end - window - k + 2, k) for end, (phrase, k) in automaton.iter(tuple(flat[at[p] : at[p + 1]].tolist()))]
        phrase, where, place, k = np.array(found, np.int64).reshape(-1, 4).T
        places = block.places[where]
        places[:, 2] += place
        lead = earliest(phrase, places)
        return where, place, k, where[lead], place[lead]

    return match


def removal_spans(docs: DataFrame, units: Units = UNITS, unnamed: bool = False) -> DataFrame:
    """(doc, tie, start, end): runs of words to remove (see repeats.py); runs of a document may overlap. unnamed: rows without doc_id take part."""
    rows = docs.select("doc_id", "text") if unnamed else docs.select("doc_id", "text").where("doc_id is not null")
    return repeated_spans(rows, units, located_windows(units.window), Stages(docs.sparkSession, "phrase"), block=1_000)


def deduplicated(docs: DataFrame, spans: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, and of each text: n_words, n_removed, kept_sha256, and text as its kept words joined by one space."""
    source = docs.select("doc_id", *[c for c in keep if c != "doc_id"], *[c for c in ("text",) if c not in keep])
    kept = [c for c in keep if c != "text"]
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept) + ", n_words long, n_removed long, kept_sha256 string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sums, texts = [], [], [], []
            for text, spans in zip(batch.column(batch.schema.get_field_index("text")), rows_of(batch)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                runs = merged(spans, len(words))
                n.append(len(words))
                gone.append(int((runs[:, 1] - runs[:, 0]).sum()))
                at, rest = 0, []
                for start, end in runs.tolist():
                    rest += words[at:start]
                    at = end
                joined = b" ".join(rest + words[at:])
                sums.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode("utf-8", "surrogatepass"))
            rows = [batch.column(batch.schema.get_field_index(k)) for k in kept]
            made = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(rows + made, names=[*kept, "n_words", "n_removed", "kept_sha256", "text"])

    return with_spans(source, spans, Stages(docs.sparkSession, "phrase")).mapInArrow(trimmed(run), schema)


def op6_phrase_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return deduplicated(docs, removal_spans(docs)).drop("text")


OP6_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as key from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)),
early as (select key, min(doc_id) as d from win group by key),
late as (select win.doc_id, win.i from win join early using (key) where early.d < win.doc_id),
gone as (select distinct doc_id, i + o as p from late, range(0, 50) t(o)),
word as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from w),
rest as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as kept from word anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(rest.n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join rest using (doc_id)
"""

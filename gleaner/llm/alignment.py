"""Cross-tokenizer alignment of byte-level BPE (A) with SentencePiece BPE (B).

Neither tokenizer joins anything over the space before a word, nor over a line
break, if no piece of B holds one: there every text is cut, and what the tokens
of a chunk are, how they group and which of them overlap is worked out once for
each distinct chunk and remembered.

Nearly all groups are one token of A and one of B, with the same bytes. An
array gives for each A id the B id of the same bytes, so such a pair is known by
its A id: documents with it are counted in a vector as long as A's vocabulary,
and only other pairs, of irregular groups, are shuffled and counted by key.
Then each document needs the counts of its own pairs. The vector and the most
frequent pairs (at most `TABLE`) are broadcast; the rest, which are rare, come
by a join.

Defined results: null and empty texts, and texts whose tokens don't give their
bytes back (a literal U+2581), have no tokens: zeros and ''; repeated rows are
documents each, whatever their doc_id, null too; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.byte_bpe import BREAK, CLASS, MARK, SPACE, ByteLevel, Chunks, before_words, row_starts, spread
from gleaner.llm.common import Stages, pieces, table, trimmed, utf8

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Irregular pairs whose counts are broadcast, the most frequent ones: 16 bytes each.
TABLE = 400_000
#: A pair's key: A id times this, plus B id.
SHIFT = 1 << 24
#: Chunks remembered in a worker.
REMEMBER = 250_000


class Pieces:
    """The SentencePiece model: ids of chunks that start with a space or a line break, and the bytes of its tokens."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE_MARK, " ").encode() for p in proto.pieces]
        self.is_byte = [p.type == 6 for p in proto.pieces]
        self.lead = next((i for i, p in enumerate(proto.pieces) if p.piece == SPACE_MARK), -1)
        plain = not proto.normalizer_spec.precompiled_charsmap and not proto.normalizer_spec.remove_extra_whitespaces and proto.normalizer_spec.add_dummy_prefix
        #: Whether tokens end before each space that follows something else, and before each line break.
        self.cut_words = plain and not any(SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in proto.pieces)
        self.cut_lines = self.cut_words and self.lead >= 0 and not any("\t" <= c <= "\r" for p in proto.pieces if p.type != 6 for c in p.piece)

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks: the library puts a space before a text, which here is the chunk's own, or is taken off before a line break."""
        ids = self.sp.encode([c[1:] if c[0] == " " else c for c in chunks])
        return [x if c[0] == " " else x[1:] for c, x in zip(chunks, ids)]


def identity(a_raw: list[bytes], pieces_: Pieces) -> np.ndarray:
    """For each A id the B id of the same bytes, a piece rather than a byte, or -1."""
    same: dict[bytes, int] = {}
    for i, raw in enumerate(pieces_.raw):
        if raw and (raw not in same or pieces_.is_byte[same[raw]] and not pieces_.is_byte[i]):
            same[raw] = i
    return np.array([same.get(raw, -1) if raw else -1 for raw in a_raw], np.int64)


class Aligner:
    """Both tokenizers, and what is known of the chunks met so far."""

    def __init__(self, a_file: bytes, b_model: bytes, remember: int = REMEMBER):
        self.a, self.b, self.limit = ByteLevel(a_file, plain_specials=True), Pieces(b_model), remember
        self.a.remember = 0  # chunks are remembered here, with both tokenizers' results
        self.b_width = np.array([len(x) for x in self.b.raw], np.int64)
        self.same = identity(self.a.raw, self.b)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[bytes] = []
        #: Of each chunk: tokens of A and of B, groups, links, whether bytes come back, and where its pairs are.
        self.facts = np.empty((0, 5), np.int64)
        self.keys, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        a_ids, a_n = self.a.encode(pa.array(chunks, pa.string()))
        coded = self.b.encode(chunks)
        b_n = np.fromiter(map(len, coded), np.int64, len(coded))
        b_ids = np.fromiter((i for x in coded for i in x), np.int64, int(b_n.sum()))
        length = np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks))
        to = np.cumsum(length)
        a_end, b_end = np.cumsum(self.a.width[a_ids]), np.cumsum(self.b_width[b_ids])
        a_row, b_row = np.repeat(np.arange(len(chunks)), a_n), np.repeat(np.arange(len(chunks)), b_n)
        # bytes come back: compared chunk by chunk, since one of them may differ in length as well
        a_at, b_at = np.concatenate([[0], np.cumsum(a_n)]), np.concatenate([[0], np.cumsum(b_n)])
        a_raw, b_raw = self.a.raw, self.b.raw
        al, bl = a_ids.tolist(), b_ids.tolist()
        right = np.zeros(len(chunks), bool)
        for i, c in enumerate(chunks):
            raw = c.encode()
            right[i] = b"".join([b_raw[x] for x in bl[b_at[i] : b_at[i + 1]]]) == raw and b"".join([a_raw[x] for x in al[a_at[i] : a_at[i + 1]]]) == raw
        if not right.all():
            a_keep, b_keep = right[a_row], right[b_row]
            a_ids, a_row, b_ids, b_row = a_ids[a_keep], a_row[a_keep], b_ids[b_keep], b_row[b_keep]
            a_n, b_n = np.where(right, a_n, 0), np.where(right, b_n, 0)
            a_end, b_end = np.cumsum(self.a.width[a_ids]), np.cumsum(self.b_width[b_ids])
        # groups end where tokens of both end
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        a_size, b_size = np.bincount(a_group, minlength=len(both)), np.bincount(b_group, minlength=len(both))
        group_row = a_row[np.cumsum(a_size) - 1] if len(both) else np.empty(0, np.int64)
        # links: each token of A with the tokens of B from the one that ends behind its start to the one that starts before its end
        first = np.searchsorted(b_end, a_end - self.a.width[a_ids], side="right")
        last = np.searchsorted(b_end, a_end, side="left")
        links = last - first + 1
        left = np.repeat(np.arange(len(a_ids)), links)
        right_ = np.arange(len(left)) - np.repeat(np.cumsum(links) - links, links) + np.repeat(first, links)
        n_links = np.bincount(a_row[left], minlength=len(chunks))
        self.keys = np.concatenate([self.keys, a_ids[left].astype(np.int64) * SHIFT + b_ids[right_]])
        self.size = np.concatenate([self.size, n_links])
        self.start = np.cumsum(self.size) - self.size
        n_groups = np.bincount(group_row, minlength=len(chunks))
        self.facts = np.concatenate([self.facts, np.stack([a_n, b_n, n_groups, n_links, right], 1)])
        # a group is `a1,a2|b1`, groups of a chunk are joined by ;
        al, bl = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        a_cut, b_cut = np.concatenate([[0], np.cumsum(a_size)]).tolist(), np.concatenate([[0], np.cumsum(b_size)]).tolist()
        said = [f"{','.join(al[a_cut[g] : a_cut[g + 1]])}|{','.join(bl[b_cut[g] : b_cut[g + 1]])}" for g in range(len(both))]
        g_at = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        self.text += [";".join(said[g_at[i] : g_at[i + 1]]).encode() for i in range(len(chunks))]
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))

    def look_up(self, chunks: list[str]) -> np.ndarray:
        new = [c for c in chunks if c not in self.known]
        if new and len(self.known) + len(new) > self.limit:
            self.forget()
            new = chunks
        if new:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places before a single space and before a line break, where what stands before is visible."""
        kind = CLASS[data]
        out = np.zeros(len(data), bool)
        if self.b.cut_words and self.a.cuttable:
            out = before_words(kind, at)
            out[1:] &= kind[:-1] != SPACE
            if self.b.cut_lines:
                out[1:] |= (kind[:-1] <= MARK) & (kind[1:] == BREAK)
        out[row_starts(at)] = True
        return out

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each row n_a, n_b, n_groups, n_links and groups_sha256; then its distinct pairs with their numbers, and how many distinct ones it has."""
        data, at = utf8(texts)
        n = len(texts)
        # the space that both put before a text
        full = np.diff(at) > 0
        starts = at[:-1][full]
        data = np.insert(data, starts, 32)
        at = at + np.concatenate([[0], np.cumsum(full)])
        facts, digests = np.zeros((n, 5), np.int64), [""] * n
        if not len(data):
            return facts[:, :4], digests, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(n, np.int64)
        chunks = Chunks(data, at, self.cuts(data, at))
        which = self.look_up(chunks.distinct.to_numpy(zero_copy_only=False).tolist())[chunks.flat]
        to = np.concatenate([[0], np.cumsum(chunks.n)])
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.facts[which], axis=0)])
        facts = sums[to[1:]] - sums[to[:-1]]
        good = full & (facts[:, 4] == chunks.n)
        facts[~good] = 0
        said = self.text
        order = which.tolist()
        for i in np.flatnonzero(good):
            digests[i] = hashlib.sha256(b";".join([said[c] for c in order[to[i] : to[i + 1]]])).hexdigest()
        # pairs: equal chunks of a row first, then equal pairs of a row
        row = np.repeat(np.arange(n), chunks.n)
        keep = good[row]
        width = len(self.text)
        seen, times = np.unique(row[keep] * width + which[keep], return_counts=True)
        c = seen % width
        keys = spread(self.keys, self.start, self.size, c)
        rows, times = np.repeat(seen // width, self.size[c]), np.repeat(times, self.size[c])
        order = np.lexsort((keys, rows))
        keys, rows, times = keys[order], rows[order], times[order]
        new = np.ones(len(keys), bool)
        new[1:] = (np.diff(keys) != 0) | (np.diff(rows) != 0)
        first = np.flatnonzero(new)
        total = np.add.reduceat(times, first) if len(first) else np.empty(0, np.int64)
        return facts[:, :4], digests, keys[first], total, np.bincount(rows[first], minlength=n)


FACTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, a_path: str, b_path: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct pairs of a document.

    same and same_times: A ids linked with the B id of the same bytes, and how
    often; pairs and pair_times: keys of all other pairs (see pair_ids).
    """
    spark = docs.sparkSession
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                facts, digests, keys, times, n = aligner.align(batch.column(1))
                row = np.repeat(np.arange(len(n)), n)
                a = keys // SHIFT
                regular = aligner.same[a] == keys % SHIFT
                columns = [batch.column(0), *[pa.array(facts[:, i]) for i in range(4)], pa.array(digests)]
                for own, values in ((regular, a.astype(np.int32)), (~regular, keys)):
                    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=len(n)))]).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(offsets, pa.array(values[own])), pa.ListArray.from_arrays(offsets, pa.array(times[own].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *FACTS, "groups_sha256", "same", "same_times", "pairs", "pair_times"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_times array<int>, pairs array<long>, pair_times array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)


def same_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Documents with each A id's pair of the same bytes: each task sums a vector as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["a", "n"])

    sums = rows.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    found = sums.toPandas()  # a row an id of the vocabulary at most
    out[found["a"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def pair_counts(rows: DataFrame) -> DataFrame:
    """(key, n): documents with each irregular pair."""
    return rows.select(F.explode("pairs").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys in order and counts of the most frequent pairs, at most `limit`, and the count from which on a pair is among them."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("pairs")).orderBy(F.desc("n")).limit(limit).collect()
    least, total = 1, 0
    for r in sizes:
        total += r["pairs"]
        if total > limit:
            least = r["n"] + 1
            break
    top = counts.where(F.col("n") >= least).orderBy("key").toPandas()
    return top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64), least


def alignment(docs: DataFrame, a_path: str, b_path: str = PIECES, limit: int = TABLE) -> tuple[DataFrame, DataFrame]:
    """A row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and (a_id, b_id, n_docs) of every linked pair of ids."""
    spark = docs.sparkSession
    stages = Stages(spark, "alignment")
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        # the map alone: no tokenizer stays on the driver
        bpe = ByteLevel(f.read())
        same = identity(bpe.raw, Pieces(g.read()))
        del bpe
    rows = stages.put(aligned(docs, a_path, b_path).withColumn("row_id", F.monotonically_increasing_id()), "rows")
    counts = stages.put(pair_counts(rows), "pairs")
    vector = same_counts(rows, len(same))
    # the highest count of each A id: a row an id of the vocabulary at most
    highest = vector.copy()
    for r in counts.groupBy(F.floor(F.col("key") / SHIFT).alias("a")).agg(F.max("n").alias("n")).toPandas().itertuples():
        highest[r.a] = max(highest[r.a], r.n)
    keys, n, least = frequent(counts, limit)
    known = spark.sparkContext.broadcast((vector, highest, keys, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, highest, keys, n = known.value
        for batch in batches:
            size = batch.num_rows
            best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
            at = np.arange(size)

            def add(row: np.ndarray, a: np.ndarray, count: np.ndarray, times: np.ndarray) -> None:
                np.add.at(total, row, count * times)
                np.add.at(best, row, np.where(count == highest[a], times, 0))

            lists = batch.column("same")
            ids = lists.flatten().to_numpy().astype(np.int64)
            add(np.repeat(at, lists.value_lengths().to_numpy()), ids, vector[ids], batch.column("same_times").flatten().to_numpy().astype(np.int64))
            lists = batch.column("pairs")
            row, own, times = np.repeat(at, lists.value_lengths().to_numpy()), lists.flatten().to_numpy(), batch.column("pair_times").flatten().to_numpy().astype(np.int64)
            place = np.searchsorted(keys, own)
            here = np.zeros(len(own), bool)
            inside = place < len(keys)
            here[inside] = keys[place[inside]] == own[inside]
            add(row[here], own[here] // SHIFT, n[place[here]], times[here])
            rare = ~here
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[rare], minlength=size))]).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(own[rare])), pa.ListArray.from_arrays(offsets, pa.array(times[rare].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row_id", "doc_id", *FACTS, "groups_sha256")], pa.array(best), pa.array(total), *rest], names=[*kept, "best", "total", "rare", "rare_times"])

    kept = ["row_id", "doc_id", *FACTS, "groups_sha256"]
    schema = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best long, total long, rare array<long>, rare_times array<int>"
    scored = stages.put(rows.mapInArrow(trimmed(run), schema), "scored")
    # rare pairs: each stands in fewer than `least` documents, so no key of this join is hot
    rare = scored.select("row_id", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row_id", F.col("x.rare").alias("key"), F.col("x.rare_times").alias("times"))
    top = spark.createDataFrame([(int(a), int(highest[a])) for a in np.flatnonzero(highest)], "a long, highest long")
    low = counts.where(F.col("n") < least).withColumn("a", F.floor(F.col("key") / SHIFT)).join(F.broadcast(top), "a")
    more = rare.join(low.hint("merge"), "key").groupBy("row_id").agg(
        F.sum(F.col("n") * F.col("times")).alias("more_total"), F.sum(F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)).alias("more_best")
    )
    out = scored.drop("rare", "rare_times").join(more.hint("merge"), "row_id", "left")
    out = out.select("doc_id", *FACTS, (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("total") + F.coalesce("more_total", F.lit(0))).alias("count_sum"), "groups_sha256")
    regular = spark.createDataFrame([(int(a), int(same[a]), int(vector[a])) for a in np.flatnonzero(vector)], "a_id long, b_id long, n_docs long")
    irregular = counts.select(F.floor(F.col("key") / SHIFT).alias("a_id"), F.pmod("key", F.lit(SHIFT)).alias("b_id"), F.col("n").alias("n_docs"))
    return out, regular.unionByName(irregular)


def op12_tokenizer_alignment(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))[0]

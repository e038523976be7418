"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf gives the pieces and their scores, the normaliser, the
dummy prefix and byte fallback; from these the tokenizers library gets an
equal BPE or unigram model. Where no piece holds the white-space marker after
another character, a text's tokens are those of its space-separated chunks, so
each batch encodes its distinct chunks once. The sentencepiece library encodes
every text whole and the two results are compared (`parity`), so an error of
cutting shows as well.

Defined results: a null or empty text has no tokens and decodes to the empty
text; runs of spaces stay together in one chunk; a character outside the
vocabulary becomes byte tokens; a literal marker U+2581 decodes to a space, so
its row has round_trip false; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import pieces, table, trimmed, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Piece types of the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Threads that encode a batch, in each worker. A worker has one core of Spark's; the second fills its pauses.
THREADS = 2


class Codec:
    """One model, for encoding and decoding batches in one process."""

    def __init__(self, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, pieces_ = proto.normalizer_spec, proto.pieces
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.prefix = spec.add_dummy_prefix
        vocab = {p.piece: i for i, p in enumerate(pieces_)}
        fallback = proto.trainer_spec.byte_fallback
        unknown = next((p.piece for p in pieces_ if p.type == UNKNOWN), None)

        def build():
            if proto.trainer_spec.model_type == 1:
                return models.Unigram([(p.piece, p.score) for p in pieces_], vocab.get(unknown), fallback)
            merges = []
            for i, p in enumerate(pieces_):
                if p.type in (NORMAL, USER_DEFINED) and len(p.piece) > 1:
                    halves = [(p.piece[:k], p.piece[k:]) for k in range(1, len(p.piece))]
                    merges += [(-p.score, i, vocab[a], vocab[b], a, b) for a, b in halves if a in vocab and b in vocab]
            return models.BPE(vocab, [x[4:] for x in sorted(merges)], unk_token=unknown, fuse_unk=True, byte_fallback=fallback)

        steps = []
        if spec.precompiled_charsmap:
            steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
        if spec.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        #: Normalisation other than the marker may join or drop spaces, so texts are then encoded whole.
        self.plain_text = not steps
        self.normalizer = normalizers.Sequence(steps) if steps else None
        self.build = lambda: Tokenizer(build())
        self.split = self.build()
        self.split.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="never", split=True)
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.by_chunk = self.plain_text and spec.escape_whitespaces and self.prefix and not any(inner.search(p.piece) for p in pieces_)
        self.starts = np.array([p.piece.startswith(MARK) for p in pieces_])
        self.is_byte = np.array([p.type == BYTE for p in pieces_])
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else p.piece.replace(MARK, " ").encode() for p in pieces_]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)[:-1]])

    @cached_property
    def whole(self):
        """For texts that aren't cut into chunks by the library; most batches have none."""
        return self.build()

    def marked(self, text: str) -> str:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def chunk_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of marker + word for each word (without spaces and markers): all ids, and how many each word has."""
        blocks = [MARK + MARK.join(words[i : i + 512]) for i in range(0, len(words), 512)]
        ids = [np.asarray(e.ids, np.int32) for e in self.split.encode_batch_fast(blocks, add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        at = np.flatnonzero(self.starts[flat])
        return flat, np.diff(np.append(at, len(flat)))

    def encode_one(self, text: str) -> np.ndarray:
        """A text whose spaces come in runs, or that holds a marker."""
        marked = self.marked(text)
        parts = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if self.by_chunk else [marked] if marked else []
        if not parts:
            return np.empty(0, np.int32)
        ids = [np.asarray(e.ids, np.int32) for e in self.whole.encode_batch_fast(parts, add_special_tokens=False)]
        return np.concatenate(ids) if ids else np.empty(0, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows end to end, tokens of each row, and whether sentencepiece gives the same."""
        texts = texts.fill_null("") if texts.null_count else texts
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, MARK))).to_numpy(zero_copy_only=False)
        odd = odd | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        if not self.by_chunk:
            odd[:] = True
        plain = texts.filter(pa.array(~odd))
        parts: list[np.ndarray] = []
        n = np.zeros(len(texts), np.int64)
        flat = np.empty(0, np.int32)
        if len(plain):
            lists = pc.split_pattern(plain, " ")
            coded = lists.flatten().dictionary_encode()
            words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            per_chunk, size = self.chunk_ids(words)
            at = np.concatenate([[0], np.cumsum(size)])
            chunks = np.diff(lists.offsets.to_numpy())
            row_at = np.concatenate([[0], np.cumsum(chunks)[:-1]])
            tokens = size[index]
            take = np.repeat(at[index] - np.concatenate([[0], np.cumsum(tokens)[:-1]]), tokens) + np.arange(tokens.sum())
            flat = per_chunk[take]
            n[~odd] = np.add.reduceat(tokens, row_at)
        if odd.any():
            each = {}
            for i in np.flatnonzero(odd):
                text = texts[int(i)].as_py()
                each[i] = self.encode_one(text)
                n[i] = len(each[i])
            done = 0
            for i in range(len(texts)):
                if odd[i]:
                    parts.append(each[i])
                else:
                    parts.append(flat[done : done + n[i]])
                    done += n[i]
            flat = np.concatenate(parts)
        return flat, n, self.agrees(texts, flat, n)

    def agrees(self, texts: pa.Array, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether sentencepiece, which gets every text whole, gives a row the same ids."""
        same = np.zeros(len(texts), bool)
        to = np.concatenate([[0], np.cumsum(n)])
        for i in range(0, len(texts), 64):
            theirs = self.reference.encode(texts[i : i + 64].to_pylist())
            for k, ids in enumerate(theirs, i):
                same[k] = len(ids) == n[k] and np.array_equal(flat[to[k] : to[k + 1]], ids)
        return same

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows end to end, and where each row starts; the dummy prefix's space is gone."""
        size = self.raw_len[ids]
        to = np.cumsum(size)
        take = np.repeat(self.raw_at[ids] - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)
        out = self.raw[take]
        ends = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(n)])]
        if self.prefix:
            full = np.flatnonzero(n > 0)
            lead = ends[:-1][full]
            lead = lead[out[lead] == 32]
            keep = np.ones(len(out), bool)
            keep[lead] = False
            out = out[keep]
            gone = np.zeros(len(ends), np.int64)
            np.add.at(gone, np.searchsorted(ends, lead, side="right"), 1)
            ends = ends - np.cumsum(gone)
        return out, ends


def encode(docs: DataFrame, model_path: str = MODEL, keep_ids: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and, of each text: n_tokens, n_bytes_fallback, ids_sha256 (of little-endian 32-bit ids), parity, round_trip, and ids where asked for."""
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    source = docs.select(*keep, *[c for c in ("text",) if c not in keep])
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", n_tokens long, n_bytes_fallback long, ids_sha256 string, parity boolean, round_trip boolean" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(model.value)  # for this partition only: a worker at rest holds none
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 21):
                texts = batch.column(batch.schema.get_field_index("text"))
                ids, n, same = c.encode(texts)
                data, at = utf8(texts)
                out, ends = c.decode(ids, n)
                to = np.concatenate([[0], np.cumsum(n)])
                spent = np.concatenate([[0], np.cumsum(c.is_byte[ids])])
                little = ids.astype("<i4")
                rows = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                rows += [pa.array(n), pa.array(spent[to[1:]] - spent[to[:-1]])]
                rows.append(pa.array([hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(to[:-1], to[1:])], pa.string()))
                rows.append(pa.array(same))
                rows.append(pa.array([np.array_equal(out[a:b], data[p:q]) for a, b, p, q in zip(ends[:-1], ends[1:], at[:-1], at[1:])], pa.bool_()))
                if keep_ids:
                    rows.append(pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids)))
                names = [*keep, "n_tokens", "n_bytes_fallback", "ids_sha256", "parity", "round_trip", *["ids"] * keep_ids]
                yield pa.RecordBatch.from_arrays(rows, names=names)

    return source.mapInArrow(trimmed(run), schema)


def decode(tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids array<int>); null ids give an empty text, invalid UTF-8 from byte tokens U+FFFD."""
    spark = tokens.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(model.value)  # for this partition only: a worker at rest holds none
        for batch in batches:
            lists = batch.column(1)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            out, ends = c.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
            texts = [out[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(trimmed(run), "doc_id long, text string")


def op8_sentencepiece(spark, sf_dir) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_ids=False)

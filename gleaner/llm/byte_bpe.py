"""Byte-level BPE on the tokenizers library, in batches.

The pre-tokenizer's pattern never takes a space or line break into the word
before it, and takes one space into the word behind it. So the tokens of a text
are those of its chunks, if it is cut there; each distinct chunk is encoded
once, and a bounded number of them is remembered from batch to batch.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleaner.llm.common import utf8

#: Classes of bytes: letter, digit, other visible ASCII (control characters too), white space but the space, space. Beyond ASCII: surely visible as a first byte, and the rest (among it all bytes that a Unicode space starts with).
LETTER, DIGIT, MARK, BREAK, SPACE, SHOWN, OTHER = range(7)
CLASS = np.full(256, MARK, np.uint8)
for _bytes, _kind in ((range(0x41, 0x5B), LETTER), (range(0x61, 0x7B), LETTER), (range(0x30, 0x3A), DIGIT), (range(0x09, 0x0E), BREAK), ((0x20,), SPACE), (range(0x1C, 0x20), OTHER), (range(0x80, 0x100), SHOWN), (range(0x80, 0xC3), OTHER), ((0xE1, 0xE2, 0xE3), OTHER)):
    CLASS[list(_bytes)] = _kind
#: What the tokenizer file must hold for texts to be cut (fixed values).
CUTTABLE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible in Latin-1, else the next one from U+0100."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def row_starts(at: np.ndarray) -> np.ndarray:
    """Where rows that aren't empty start."""
    return at[:-1][np.diff(at) > 0]


def before_words(kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places before a space that something visible follows in the same row."""
    shown = (kind <= MARK) | (kind == SHOWN)
    out = np.zeros(len(kind), bool)
    out[:-1] = (kind[:-1] == SPACE) & shown[1:]
    ends = at[1:][np.diff(at) > 0] - 1
    out[ends] = False
    return out


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places where the pre-tokenizer's pattern surely starts a new piece, whatever stands around them."""
    kind = CLASS[data]
    out = before_words(kind, at)
    if len(kind) > 1:
        before, here = kind[:-1], kind[1:]
        # a word ends before whatever isn't a letter; a line break starts after anything visible
        out[1:] |= (before == LETTER) & (here != LETTER) & (here < SHOWN)
        out[1:] |= (before <= MARK) & (here == BREAK)
        # and a word starts after a single line break
        out[2:] |= (kind[:-2] <= MARK) & (kind[1:-1] == BREAK) & (kind[2:] <= MARK)
    out[row_starts(at)] = True
    return out


class Chunks:
    """The chunks of a batch: each distinct one once, which ones stand in each row in order, and how many a row has."""

    def __init__(self, data: np.ndarray, at: np.ndarray, cut: np.ndarray):
        starts = np.flatnonzero(cut)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        self.distinct: pa.Array = coded.dictionary
        self.flat = coded.indices.to_numpy()
        self.n = np.diff(np.searchsorted(starts, at))


def spread(values: np.ndarray, start: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + size[i]] for each i of index, end to end."""
    many = size[index]
    to = np.cumsum(many)
    return values[np.repeat(start[index] - (to - many), many) + np.arange(int(to[-1]) if len(to) else 0)]


class ByteLevel:
    """One tokenizer file, for encoding batches in one process. plain_specials: special tokens' strings are text. remember: chunks kept at most."""

    def __init__(self, file: bytes, plain_specials: bool = False, remember: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(file)
        self.tokenizer = Tokenizer.from_buffer(file)
        self.tokenizer.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else [t["content"] for t in spec["added_tokens"]]
        before = spec["pre_tokenizer"] or {}
        self.cuttable = spec["normalizer"] is None and all(before.get(k) == v for k, v in CUTTABLE.items())
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        alphabet, added = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
        #: The bytes of each token.
        self.raw: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.raw[i] = token.encode() if token in added else bytes(alphabet[c] for c in token)
        self.width = np.array([len(b) for b in self.raw], np.int64)
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.size = np.empty(0, np.int32), np.empty(0, np.int64)

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks end to end, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def look_up(self, chunks: list[str]) -> np.ndarray:
        """The place of each chunk in `start` and `size`; new ones are encoded."""
        known = self.known
        new = [c for c in chunks if c not in known]
        if new and len(known) + len(new) > self.remember:
            self._forget()
            known, new = self.known, chunks
        if new:
            # a space and a word are cut off from whatever stands before: such chunks are encoded end to end, and a token ends where a chunk does
            words = [c for c in new if c[0] == " " and len(c) > 1 and not c[1].isspace()] if self.cuttable else []
            words_ids, _ = self._encoded(["".join(words[i : i + 512]) for i in range(0, len(words), 512)])
            ends = np.cumsum(np.fromiter((len(c.encode()) for c in words), np.int64, len(words)))
            words_size = np.diff(np.searchsorted(np.cumsum(self.width[words_ids]), ends) + 1, prepend=0)
            seen = set(words)
            others = [c for c in new if c not in seen]
            others_ids, others_size = self._encoded(others)
            known.update(zip(chain(words, others), range(len(known), len(known) + len(new))))
            self.ids, self.size = np.concatenate([self.ids, words_ids, others_ids]), np.concatenate([self.size, words_size, others_size])
            self.start = np.cumsum(self.size) - self.size
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and how many each row has. Null has none."""
        data, at = utf8(texts)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        cut = cuts(data, at) if self.cuttable else np.zeros(len(data), bool)
        cut[row_starts(at)] = True
        for special in self.specials:
            for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, special), False).to_numpy(zero_copy_only=False)):
                cut[at[i] + 1 : at[i + 1]] = False
        chunks = Chunks(data, at, cut)
        which = self.look_up(chunks.distinct.to_numpy(zero_copy_only=False).tolist())[chunks.flat]
        row = np.concatenate([[0], np.cumsum(self.size[which])])
        return spread(self.ids, self.start, self.size, which), np.diff(row[np.concatenate([[0], np.cumsum(chunks.n)])])

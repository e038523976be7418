"""Operators 1 and 6 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from gleaner.llm import phrase_dedup, suffix_dedup
from gleaner.llm.common import Stages
from gleaner.llm.repeats import Block, Units, merged, repeated_spans

BYTES = Units(words=False, window=20, anchor=6, within=True)
WORDS = Units(words=True, window=8, anchor=3, within=False)
SCHEMA = "doc_id long, text string, h long, sk long, start long, spans string"


def brute_bytes(rows, w):
    first, out = {}, {}
    texts = {d: (t or "").encode() for d, t in rows if d is not None}
    for d in sorted(texts):
        for i in range(len(texts[d]) - w + 1):
            first.setdefault(texts[d][i : i + w], (d, i))
    for d, b in texts.items():
        mask = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if first[b[i : i + w]] != (d, i):
                mask[i : i + w] = b"\1" * w
        kept = bytes(x for x, m in zip(b, mask) if not m)
        out[d] = (len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, w):
    first, out = {}, {}
    texts = {d: (t or "").encode().split() for d, t in rows if d is not None}
    for d in sorted(texts):
        for i in range(len(texts[d]) - w + 1):
            first.setdefault(tuple(texts[d][i : i + w]), d)
    for d, words in texts.items():
        mask = [0] * len(words)
        for i in range(len(words) - w + 1):
            if first[tuple(words[i : i + w])] < d:
                mask[i : i + w] = [1] * w
        kept = b" ".join(x for x, m in zip(words, mask) if not m)
        out[d] = (len(words), sum(mask), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(60)]

    def text(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    passage, line = text(30), text(6)
    rows = [(i, text(rnd.randint(0, 60))) for i in range(20)]
    rows += [(20 + i, text(5) + " " + passage + " " + text(rnd.randint(0, 9))) for i in range(6)]
    rows += [(30 + i, f"{text(12)} {line}\n{text(12)}") for i in range(12)]
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, rows[20][1].replace("a", "b", 1)), (53, None), (54, ""), (55, "  \t "), (56, "short"), (57, "ab" * 200), (58, "x" * 300), (None, passage)]
    rows += [(60, text(400)), (60 + 1, passage + "  " + passage)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_is_exact(spark, seed):
    rows = corpus(seed)
    docs = frame(spark, rows)
    out = suffix_dedup.deduplicated(docs, suffix_dedup.removal_spans(docs, BYTES)).collect()
    assert len(out) == len(rows)
    want = brute_bytes(rows, 20)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out if r.doc_id is not None} == want
    assert [r.n_removed for r in out if r.doc_id is None] == [0]


def test_phrase_dedup_is_exact(spark):
    rows = corpus(3)
    docs = frame(spark, rows)
    out = phrase_dedup.deduplicated(docs, phrase_dedup.removal_spans(docs, WORDS)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out if r.doc_id is not None} == brute_words(rows, 8)


@pytest.mark.parametrize("units,module,brute", [(BYTES, suffix_dedup, brute_bytes), (WORDS, phrase_dedup, brute_words)])
def test_frequent_anchors_and_small_blocks(spark, units, module, brute):
    """Frequent anchors are dealt out by window, and blocks cut between anchors; the result stays."""
    rows = corpus(4)
    docs = frame(spark, rows)
    matcher = suffix_dedup.shared_windows(20) if module is suffix_dedup else phrase_dedup.located_windows(8)
    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    spans = repeated_spans(known, units, matcher, Stages(spark, "test"), hot=3, block=5)
    out = module.deduplicated(docs, spans).collect()
    want = brute(rows, units.window)
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    assert {d: got[d].kept_sha256 for d in want} == {d: v[-1] for d, v in want.items()}


def test_default_windows(spark):
    rows = corpus(5)
    docs = frame(spark, rows)
    out = suffix_dedup.deduplicated(docs, suffix_dedup.removal_spans(docs)).collect()
    assert {r.doc_id: r.kept_sha256 for r in out if r.doc_id is not None} == {d: v[-1] for d, v in brute_bytes(rows, 100).items()}
    out = phrase_dedup.deduplicated(docs, phrase_dedup.removal_spans(docs)).collect()
    assert {r.doc_id: r.kept_sha256 for r in out if r.doc_id is not None} == {d: v[-1] for d, v in brute_words(rows, 50).items()}


def test_repeated_rows_of_a_document(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdef") for _ in range(300))
    docs = frame(spark, [(1, text), (1, text), (2, text)])
    out = suffix_dedup.deduplicated(docs, suffix_dedup.removal_spans(docs, BYTES)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(1, 0), (1, 0), (2, 300)]


@pytest.mark.parametrize("units,module", [(BYTES, suffix_dedup), (WORDS, phrase_dedup)])
def test_rows_that_share_a_doc_id_and_differ(spark, units, module):
    """They are documents of their own: short ones lose nothing, copies among other ids go whole, and nothing crashes."""
    rnd = random.Random(7)
    a, b = (" ".join("".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, "short text"), (1, "tiny"), (1, ""), (1, None), (2, a), (2, b), (2, "tiny"), (3, b + " " + a), (3, b)]
    out = module.deduplicated(frame(spark, rows), module.removal_spans(frame(spark, rows), units), ("doc_id", "text")).collect()
    assert len(out) == len(rows)
    total = "n_bytes" if units is BYTES else "n_words"
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r[total], r.n_removed))
    size = len(a) if units is BYTES else 60
    assert sorted(got[1]) == sorted([(size, 0), (10 if units is BYTES else 2, 0), (4 if units is BYTES else 1, 0), (0, 0), (0, 0)])
    assert sorted(got[2]) == sorted([(size, size), (size, 0), (4 if units is BYTES else 1, 0)])
    (n1, r1), (n2, r2) = sorted(got[3])
    assert (n1, r1) == (size, size) and n2 - r2 <= 1


@pytest.mark.parametrize("units,module", [(BYTES, suffix_dedup), (WORDS, phrase_dedup)])
def test_the_matcher_alone_decides(spark, units, module):
    """With a matcher that finds nothing, nothing is removed, copies of whole documents included."""
    docs = frame(spark, corpus(8))
    none = lambda block: (np.empty(0, np.int64),) * 5
    spans = repeated_spans(docs.select("doc_id", "text").where("doc_id is not null"), units, none, Stages(spark, "test"))
    assert spans.count() == 0
    assert {r.n_removed for r in module.deduplicated(docs, spans).collect()} == {0}


@pytest.mark.parametrize("units,module", [(BYTES, suffix_dedup), (WORDS, phrase_dedup)])
def test_rows_without_doc_id_come_last_where_they_take_part(spark, units, module):
    rnd = random.Random(9)
    a = " ".join("".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(60))
    docs = frame(spark, [(5, a), (None, a), (None, "other")])
    out = module.deduplicated(docs, module.removal_spans(docs, units, unnamed=True)).collect()
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in out) == [(0, False), (0, True), (5, False)]


@pytest.mark.parametrize("width", [1, 2, 4])
def test_shared_windows_of_a_block(width):
    """The first place of every window of a block, against a plain search."""
    rnd = random.Random(width)
    window = 8 if width > 1 else 7
    texts = list(dict.fromkeys("".join(rnd.choice("ab") for _ in range(rnd.randint(window, 30))).encode() for _ in range(60)))
    places = np.array([(rnd.randint(0, 9), 0, 100 * i) for i in range(len(texts))])
    copies = np.array([rnd.randint(1, 2) for _ in texts])
    first = {}
    for i in np.lexsort((places[:, 2], places[:, 0])).tolist():
        for o in range(len(texts[i]) - window + 1):
            first.setdefault(texts[i][o : o + window], (i, o))
    p, o, n, fp, fo = suffix_dedup.shared_windows(window)(Block(texts, copies, places))
    seen = {}
    for row in zip(p.tolist(), o.tolist(), n.tolist(), fp.tolist(), fo.tolist()):
        for k in range(row[2]):
            seen[row[0], row[1] + k] = (row[3], row[4] + k)
    for i, text in enumerate(texts):
        for k in range(len(text) - window + 1):
            want = first[text[k : k + window]]
            if (i, k) in seen:
                assert seen[i, k] == want
            else:
                assert want == (i, k) and copies[i] == 1


def test_empty_table(spark):
    docs = frame(spark, [])
    assert suffix_dedup.deduplicated(docs, suffix_dedup.removal_spans(docs)).collect() == []
    assert phrase_dedup.deduplicated(docs, phrase_dedup.removal_spans(docs)).collect() == []


def test_collection_order():
    rnd = random.Random(1)
    passages = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randint(1, 30))) for _ in range(40)]
    passages += passages[:5]
    owner, start, shared = suffix_dedup.collection_order(passages)
    suffixes = [passages[i][k:] for i, k in zip(owner, start)]
    assert len(set(zip(owner.tolist(), start.tolist()))) == sum(map(len, passages)) + len(passages)
    for a, b, n in zip(suffixes, suffixes[1:], shared[1:]):
        common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert a <= b and n == common


def test_merged_runs():
    assert merged(np.array([[5, 9], [0, 3], [3, 5], [20, 99]]), 30).tolist() == [[0, 9], [20, 30]]
    assert merged(np.empty((0, 2), int), 5).tolist() == []

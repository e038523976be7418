"""Divergence audit, tokenizer alignment and packing against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from gleaner.llm.byte_bpe import ByteLevel, byte_alphabet

DOCS = "doc_id long, text string, lang string, source string"
ODD = [None, "", " ", "  ", "\n", "a▁b", "a\n b\n\nc  d", "<|endoftext|> <s> </s>", " <unk>", "a\x00b", "it's 'll DON'T\t two   ", "\x1c b\x0b c", "中文 文字　x", "“quoted” text — dash", "x.\n\ty ", "word " * 3000]


def odd_texts(n=400):
    rng, signs = random.Random(3), list(" \n\t\x1c\x0bab1.'sé中  “ABtrem▁́😀")
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabularies():
    return pytest.importorskip("public_tokenizers")


def test_byte_level_ids_are_the_librarys(vocabularies):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = vocabularies.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        file = f.read()
    for plain in (False, True):
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = plain
        texts = odd_texts(3000)
        ours = ByteLevel(file, plain_specials=plain, remember=500)
        ids, n = ours.encode(pa.array(texts, pa.string()))
        theirs = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert n.tolist() == [len(t) for t in theirs]
        assert ids.tolist() == [i for t in theirs for i in t]


def aligned_plainly(texts, tokenizer, pieces):
    alphabet = byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in tokenizer.get_vocab(with_added_tokens=False).items()}
    b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.get_piece_size())]
    rows, documents = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a, b, whole = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text), (" " + text).encode()
            if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
                a = b = []
        a_end, b_end = np.cumsum([0] + [len(a_bytes[i]) for i in a]), np.cumsum([0] + [len(b_bytes[i]) for i in b])
        links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if max(a_end[i], b_end[j]) < min(a_end[i + 1], b_end[j + 1])] if len(a) < 200 else list(zip(a, b))
        groups, low = [], 0
        for high in sorted(set(a_end[1:]) & set(b_end[1:])):
            groups.append(",".join(str(x) for i, x in enumerate(a) if low < a_end[i + 1] <= high) + "|" + ",".join(str(y) for j, y in enumerate(b) if low < b_end[j + 1] <= high))
            low = high
        documents.update(set(links))
        rows.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in documents.items():
        best[x] = max(best[x], n)
    return [(na, nb, len(g), len(ls), sum(documents[x] == best[x[0]] for x in ls), sum(documents[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, ls in rows], documents


@pytest.mark.parametrize("limit", [400_000, 40, 1])
def test_alignment(spark, vocabularies, limit):
    import sentencepiece
    from tokenizers import Tokenizer

    from gleaner.llm.alignment import PIECES, alignment

    texts = odd_texts() + ["the same words here, and again the same words"] * 5
    docs = spark.createDataFrame([(i if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_a int")
    rows, pairs = alignment(docs.repartition(3), vocabularies.path("byte_bpe_50k.json"), limit=limit)
    tokenizer = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    wanted, documents = aligned_plainly(texts, tokenizer, sentencepiece.SentencePieceProcessor(model_file=PIECES))
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows.collect())
    assert got == Counter((i if i % 7 else None, *w) for i, w in enumerate(wanted))
    assert {(r.a_id, r.b_id): r.n_docs for r in pairs.collect()} == dict(documents)


def test_alignment_of_nothing(spark, vocabularies):
    from gleaner.llm.alignment import alignment

    rows, pairs = alignment(spark.createDataFrame([], "doc_id long, text string"), vocabularies.path("byte_bpe_50k.json"))
    assert rows.count() == pairs.count() == 0


def sound(rows, capacity):
    """Sequences without gap or overlap, and how many there are."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


def test_packing(spark, vocabularies):
    from tokenizers import Tokenizer

    from gleaner.llm.packing import packed

    path = vocabularies.path("byte_bpe_50k.json")
    rng = random.Random(5)
    texts = odd_texts(150) + [" ".join(rng.choice(["alpha", "bet", "gamma"]) for _ in range(int(rng.expovariate(1 / 150)))) for _ in range(300)] + ["one long text " * 900, "same"] + ["same"] * 40
    docs = spark.createDataFrame([(i if i != 3 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packed(docs.repartition(5), path, keep_ids=True).collect()
    wanted, total = [], 0
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        first = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate([(0, first), *[(x, x + 1024) for x in range(first, len(ids), 1024)]]):
            wanted.append((i if i != 3 else None, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == Counter(wanted)
    assert sound(rows, 1024) <= 1.01 * -(-total // 1024) + 1
    assert packed(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


@pytest.mark.parametrize("kind", ["even", "many", "short", "long", "one"])
def test_plans_use_few_sequences(kind):
    from gleaner.llm.packing import best_fit, plan

    rng = np.random.default_rng(1)
    counts = {
        "even": dict(zip(*np.unique(rng.integers(1, 1025, 20_000), return_counts=True))),
        "many": {x: 50_000 + 37 * x for x in range(1, 1025)},
        "short": {3: 10**9, 7: 5},
        "long": {x: 100 for x in range(600, 900)},
        "one": {1024: 7},
    }[kind]
    counts = {int(x): int(n) for x, n in counts.items()}
    made = plan(counts)
    least = -(-sum(x * n for x, n in counts.items()) // 1024)
    assert least <= made.sequences <= 1.001 * sum(n for _, n in best_fit(counts, 1024)) + 1
    for length, first, each, sequence, offset in zip(made.length, made.first, made.each, made.sequence, made.offset):
        assert made.place(np.array([length]), np.array([first])) == (sequence, offset) and offset + each * length <= 1024


def group_terms(rows, least=3):
    """The audit in plain Python."""
    import re

    words = [(i, lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for i, (text, lang, source) in enumerate(rows)]
    out = []
    for lang in {w[1] for w in words}:
        mine = [w for w in words if w[1] == lang]
        docs = Counter(t for w in mine for t in set(w[3]))
        kept = {t for t, n in docs.items() if n >= least}
        every = Counter(t for w in mine for t in w[3] if t in kept)
        groups = {s: Counter(t for w in mine if w[2] == s for t in w[3] if t in kept) for s in {w[2] for w in mine}}

        def p(count, t):
            return 1 + 10**9 * (count[t] + 1) // (sum(count.values()) + len(kept))

        for s, count in groups.items():
            pairs = [(-sum((p(count, t) - p(other, t)) ** 2 // p(other, t) for t in kept), o.encode(), o) for o, other in groups.items() if o != s]
            terms = [(-((p(count, t) - p(every, t)) ** 2 // p(every, t)), t.encode(), t) for t in count if p(count, t) > p(every, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    from gleaner.llm import divergence

    rng = random.Random(2)
    vocabulary = ["the", "Of", "ÉTÉ", "été", "naïve", "ab1cd", "x", "日本", "zz", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]]
    rows = [(" ".join(rng.choice(vocabulary[: 10 + 7 * (i % 20)]) for _ in range(rng.randint(0, 60))) if i % 31 else None, rng.choice(["en", "fr", None]), f"s{min(i % 9, rng.randint(0, 8))}") for i in range(400)]
    rows += [("lone words", "xx", "only"), ("", "yy", "a"), (None, "yy", None), ("two words two", "yy", "b")] + [("copied text here", "en", "s0")] * 5
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], DOCS + ", term int").repartition(4)
    wanted = group_terms(rows)
    assert sorted(tuple(r) for r in divergence.divergence(docs).collect()) == wanted
    # small blocks and stripes, and totals that are joined by sorting
    for name, value in (("BLOCK_ROWS", 50), ("SMALL", 1), ("STRIPE", 2)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(tuple(r) for r in divergence.divergence(docs).collect()) == wanted
    con = duckdb.connect()
    documents = docs.toPandas()
    con.register("documents", documents)
    assert sorted(con.sql(f"select lang, source, part, item, value, rank from ({divergence.OP11_SQL})").fetchall()) == wanted
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_forest_prices_equal_nodes_once():
    from gleaner.llm.divergence import Forest, shares

    counts = np.zeros((5, 1000), np.int64)
    counts[1, 3], counts[2, 3], counts[3, 900:] = 2, 2, 1
    forest = Forest(counts)
    assert forest.roots[1] == forest.roots[2] and forest.roots[0] == forest.roots[4]
    below = counts.sum(1) + 1000
    # two trees that are nearly all zeros meet in a few kinds of pairs, not in a thousand
    other, mine, theirs, times = forest.pairs(1)
    assert len(other) <= 5 * 4 and times.sum() == 5 * 1024
    for g in range(5):
        plain = [(lambda p, q: int(((p - q) ** 2 // q).sum()))(shares(counts[g], below[g]), shares(counts[h], below[h])) for h in range(5)]
        assert forest.prices(g, below).tolist() == plain


def test_shares_are_exact():
    from gleaner.llm.divergence import shares

    rng = random.Random(0)
    for _ in range(500):
        below = rng.randint(1, 9 * 10**15)
        n = rng.randint(0, below - 1)
        assert shares(np.array([n]), np.array([below])).tolist() == [1 + 10**9 * (n + 1) // below]

"""The pipeline on the smallest tables, stage by stage, against plain versions of each decision."""

import hashlib
import importlib
import re

import pytest

pipeline = importlib.import_module("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [("documents", docs.select(*pipeline.COLUMNS).collect())]
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, DATA)
        out.append((name, made.collect()))
        docs = spark.createDataFrame(out[-1][1], made.schema)
    return dict(out)


def test_stages_return_the_columns_of_documents(kept):
    for name in list(kept)[:-1]:
        assert set(pipeline.COLUMNS) == set(kept[name][0].asDict()), name


def test_near_duplicates_leave_one_each(kept):
    from tests.llm.test_near_duplicates import plain_fingerprint, union

    rows = sorted(kept["toxicity"], key=lambda r: r.doc_id)
    prints = [plain_fingerprint(r.text) for r in rows]
    low = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert {r.doc_id for r in kept["simhash_near_dedup"]} == {r.doc_id for i, r in enumerate(rows) if low[i] == i}


def test_repeats_are_removed(kept):
    from tests.llm.test_repeats import brute_bytes

    want = brute_bytes([(r.doc_id, r.text) for r in kept["simhash_near_dedup"]], 100)
    assert len(want) == len(kept["suffix_array_dedup"])
    whole = {r.doc_id: r.text for r in kept["simhash_near_dedup"]}
    for r in kept["suffix_array_dedup"]:
        assert r.n_chars == len(r.text)
        if want[r.doc_id][1] == 0:
            assert r.text == whole[r.doc_id]
        elif whole[r.doc_id].isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3]


def test_benchmark_passages_are_gone(spark, kept):
    before = {r.doc_id: r.text for r in kept["suffix_array_dedup"]}
    after = {r.doc_id for r in kept["benchmark_decontamination"]}
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for doc, text in before.items():
        flat = re.sub(r"\s+", " ", text)
        assert (doc in after) == (not any(i in flat for i in items))


def test_tokens_are_of_the_kept_texts(kept):
    import sentencepiece

    from gleaner.llm.sentencepiece_codec import MODEL

    ref = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r.doc_id for r in kept["sentencepiece"]} == {r.doc_id for r in kept["benchmark_decontamination"]}
    assert all(r.ids == ref.encode(r.text) and r.parity and r.round_trip for r in kept["sentencepiece"])


def test_run_gives_the_last_stage(spark, kept):
    out = pipeline.run(spark, DATA).select("doc_id", "ids_sha256").collect()
    assert {(r.doc_id, r.ids_sha256) for r in out} == {(r.doc_id, r.ids_sha256) for r in kept["sentencepiece"]}


def written(spark, folder, docs, labels, items):
    clash = "h long, sk long, doc long, tie long, row_id long, score double, fp long, seed long, runs string, spans string"
    extra = (1, 2, 3, 4, 5, 0.5, 6, 7, "x", "y")
    spark.createDataFrame([(*d, "en", "web", 3, *extra) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, " + clash).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, rows without doc_id and clashing columns."""
    import random

    rnd = random.Random(5)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    a, b, c, d, item, other = text(80), text(80), text(80), text(80), text(30), text(30)
    docs = [(1, a), (1, a), (2, a), (3, None), (4, ""), (5, b), (5, c), (None, b), (None, d), (None, d), (6, f"{text(9)} {item} {text(9)}"), (None, f"{text(9)} {other}"), (7, d[:200] + " " + text(60))]
    folder = written(spark, tmp_path / "odd", docs, [(1, 1, 0), (99, 0, 1), (None, 1, 1)], [(1, item), (8, other), (2, None), (3, ""), (None, "x")])
    out = pipeline.run(spark, folder).collect()
    left = sorted(((r.doc_id or 0), (r.text or "")[:20]) for r in out)
    assert left == sorted([(1, a[:20]), (3, ""), (5, b[:20]), (5, c[:20]), (7, d[:20]), (0, next(r.text for r in out if r.doc_id is None)[:20])])
    rest = next(r.text for r in out if r.doc_id is None)
    assert rest and rest in d and len(rest) <= len(d) - 200 + 8  # what row 7 holds of it is gone
    assert all(r.parity and len(r.ids) == r.n_tokens for r in out)


def test_empty_tables(spark, tmp_path):
    out = pipeline.run(spark, written(spark, tmp_path / "none", [], [], []))
    assert out.collect() == [] and "ids" in out.columns

"""Operators 3, 4, 5, 7, 8 and 9."""

import collections
import gzip
import itertools
import random

import numpy as np
import pytest

from gleaner.llm import decontamination, html_extraction, quality_gam, sentencepiece_codec, toxicity, warc

DATA = "/root/testdata/sf0.01"
PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="cookie-notice">We use cookies. Accept them all.</div>
<div id="wrap"><article><h1>A title &amp; more</h1><p>First&nbsp;paragraph   with <b>bold</b> and <a href="x">a link</a>.<p>Second one,
unclosed &lt;tag&gt;.<script>var x = "<p>no</p>";</script><ul><li>Item one.</li><li>Item two.</li></ul><!-- <p>gone</p> --></article>
<aside><p>Read also this long and well written sentence, which is no part of the article.</p></aside>
<section class="comments"><p>A reader says that this was a fine article, and says so at length.</p></section></div>
<form><p>Subscribe to our letter for more.</p><input name=q></form><footer>&copy; Someone. All rights reserved.</footer></body></html>"""


def test_article_of_a_page(spark):
    want = "A title & more\nFirst paragraph with bold and a link.\nSecond one, unclosed <tag>.\nItem one.\nItem two."
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "", 5), (4, "w", "<p>", 5), (4, "w", PAGE, 5), (5, "x", "<article><p>" + "word. " * 60_000 + "</p></article>", 5)]
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    got = [(r.page_id, r.text, r.n_chars) for r in out]
    assert got[0] == (1, want, len(want)) and got[4][1] == want
    assert [x[1] for x in got[1:4]] == ["", "", ""]
    assert got[5][2] == 60_000 * 6 - 1
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_minimum_cut_is_minimal():
    rnd = random.Random(2)
    for _ in range(150):
        n = rnd.randint(1, 8)
        scores = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rnd.uniform(0, 1.5) for i, j in itertools.combinations(range(n), 2) if rnd.random() < 0.5}

        def cost(side):
            return sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(scores, side)) + sum(w for (a, b), w in edges.items() if side[a] != side[b])

        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert cost(html_extraction.minimum_cut(scores, edges)) == pytest.approx(best)


def test_articles_of_the_test_pages(spark):
    """The article elements of the generated pages hold all of the article and nothing else."""
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_extraction.extract(pages).collect():
        article = re.search("<article>(.*?)</article>", html[r.page_id], re.S)[1]
        want = " ".join(__import__("html").unescape(re.sub("<[^>]*>", " ", article)).split())
        assert " ".join(r.text.split()) == want


def test_learned_weights_extract_the_same_articles(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    weights = html_extraction.train(pages)
    assert weights["length"] != html_extraction.STATED["length"] and weights[".comments"] == pytest.approx(html_extraction.STATED[".comments"])
    text = lambda w: {(r.page_id, r.text) for r in html_extraction.extract(pages, w).collect()}
    assert text(weights) == text(None)
    assert html_extraction.train(pages.limit(0)) == html_extraction.STATED == html_extraction.train(spark.createDataFrame([(1, "<p>no article</p>"), (2, None)], "page_id long, html string"))


LONG = "A paragraph of some length, which is plainly part of the main text, as its words tell."
WITHOUT_ARTICLE = f"""<html><body><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="page"><div class="col"><p>{LONG}</p><p>No</p><p>{LONG}</p><p>1999</p><p>{LONG}</p></div>
<div><a href=/c>More</a></div></div><div class="cookie-notice"><p>{LONG}</p></div><footer><p>{LONG}</p></footer></body></html>"""


@pytest.mark.parametrize("page", [WITHOUT_ARTICLE, WITHOUT_ARTICLE.replace('<div class="col">', "<article>"), WITHOUT_ARTICLE.replace('<div class="page">', "<main>")])
def test_the_cut_corrects_the_classifier(spark, page):
    """Short lines that the classifier alone takes for boilerplate stay with their neighbours, with stated and with learned weights."""
    learned = html_extraction.train(spark.read.parquet(f"{DATA}/pages.parquet"))
    want = "\n".join([LONG, "No", LONG, "1999", LONG])
    for weights in (html_extraction.STATED, learned):
        found = html_extraction.blocks(page)
        alone = [b.text for b in found if html_extraction.block_score(b, weights) > 0]
        assert "No" not in alone and "1999" not in alone
        assert html_extraction.main_text(page, weights) == want


def test_the_cut_corrects_blocks_of_the_test_pages(spark):
    """With the stated weights the classifier alone errs on many blocks of the generated articles; after the cut none is wrong."""
    wrong = moved = 0
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        found = html_extraction.blocks(r.html)
        side = html_extraction.content_blocks(found, html_extraction.STATED)
        inside = [b.hub is not None for b in found]
        wrong += sum(a != b for a, b in zip(side, inside))
        moved += sum(a != (html_extraction.block_score(b, html_extraction.STATED) > 0) for a, b in zip(side, found))
    assert wrong == 0 and moved > 50


def test_the_query_against_plain_search(spark):
    """op4_html_extraction on all pages of the smallest tables: text, breaks between blocks and lengths."""
    import html as h
    import re

    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = html_extraction.op4_html_extraction(spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = re.split("</?(?:p|h1)>", inner.replace("<br>", " "))
        lines = [" ".join(h.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_warc_derivatives_keep_their_source(spark):
    rows = [(1, "http://a.example/x", PAGE, 1), (2, None, None, 1), (None, "http://b.example/", "<p>ü</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind int")
    responses = warc.responses_of(pages)
    source = {r.key: list(warc.records(r.warc))[0] for r in responses.collect()}
    out = warc.derive(responses).collect()
    assert len(out) == 6
    for r in out:
        (headers, block), = warc.records(r.record)
        head, body = source[r.key]
        assert headers["warc-refers-to"] == head["warc-record-id"] == r.refers_to
        assert headers["warc-target-uri"] == head["warc-target-uri"] and headers["warc-date"] == head["warc-date"]
        assert headers["warc-payload-digest"] == warc.digest(warc.http_parts(body)[1])
        assert headers["warc-block-digest"] == warc.digest(block) and int(headers["content-length"]) == len(block) == r.content_length
        assert headers["warc-type"] == r.kind
    text = {r.kind: list(warc.records(r.record))[0][1].decode() for r in out if r.key == "1"}
    assert "title: Not this" in text["metadata"] and "outlink: http://a.example/a a" in text["metadata"] and "http-header-content-type: text/html; charset=utf-8" in text["metadata"]
    assert "First paragraph with bold and a link." in text["conversion"] and "var x" not in text["conversion"]


def test_warc_reading(spark, tmp_path):
    one, two = warc.response("1", "http://a/", b"<p>a</p>", "2024-01-01T00:00:00Z"), warc.response("2", "http://b/", b"<p>b</p>", "2024-01-01T00:00:00Z")
    other = warc.record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:1>")], b"GET / HTTP/1.1\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(one + other + two[:-9])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(two) + gzip.compress(one))
    out = warc.derive(warc.read_warc(spark, str(tmp_path / "*.warc*")))
    assert out.count() == 2 + 4  # the cut-off record and the request give nothing
    warc.write_warc(out, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("kind=*/*.warc.gz"))
    assert {f.parent.name for f in files} == {"kind=metadata", "kind=conversion"}
    back = [r for f in files for r in warc.records(f.read_bytes())]
    assert sorted(h["warc-record-id"] for h, _ in back) == sorted(r.record_id for r in out.collect())
    again = warc.read_warc(spark, str(tmp_path / "out" / "*" / "*.warc.gz")).collect()
    assert sorted(bytes(r.warc) for r in again) == sorted(bytes(r.record) for r in out.collect())
    assert warc.derive(spark.createDataFrame([], "key string, warc binary")).collect() == []


def test_damaged_and_large_warc_files(spark, tmp_path):
    """Cut-off gzip members, bytes that are no UTF-8, empty records, and a file of many records, which is read record by record."""
    body = bytes(range(256)) * 40 + b"<p>end</p>"
    one, two = warc.response("1", "http://a/", body, "2024-01-01T00:00:00Z"), warc.response("2", "http://b/", b"", "2024-01-01T00:00:00Z")
    packed = gzip.compress(one)
    for cut in (1, 9, len(packed) // 2):
        assert [h["warc-target-uri"] for h, _ in warc.records(gzip.compress(two) + packed[:cut])] == ["http://b/"]
    assert list(warc.records(packed[:20])) == [] == list(warc.records(b"\x1f\x8bno gzip")) == list(warc.records(b""))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(two) + packed[: len(packed) // 2])
    (tmp_path / "many.warc").write_bytes((one + two) * 200)
    rows = warc.read_warc(spark, str(tmp_path / "*")).collect()
    many = [bytes(r.warc) for r in rows if r.key.endswith("many.warc")]
    assert len(many) == 400 and set(many) == {one, two}
    assert warc.derive(spark.createDataFrame([r for r in rows if r.key.endswith(".gz")] or [("", b"")], "key string, warc binary")).count() <= 2


def test_warc_of_odd_pages(spark):
    """Null and repeated page_id, null and empty pages, and a long one."""
    long = "<p>" + "word " * 400_000 + "</p>"
    rows = [(None, "http://a/", "<p>a</p>"), (None, "http://a/", "<p>a</p>"), (1, None, None), (1, "http://b/", ""), (2, "http://c/", long)]
    out = warc.derive(warc.responses_of(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(out) == 10 and len({r.record_id for r in out}) == 8
    assert max(r.content_length for r in out) == 400_000 * 5 - 1


def plain_page(page):
    """Title, language, links and visible lines of a page, by the standard library's parser."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.lines, self.links, self.title, self.lang, self.hidden = [""], [], None, None, 0

        def handle_starttag(self, tag, attrs):
            attrs = dict(attrs)
            if tag in ("head", "script", "style", "noscript", "template"):
                self.hidden += 1
            if tag == "html":
                self.lang = attrs.get("lang")
            if tag == "title":
                self.title = ""
            if tag in warc.BREAKS:
                self.lines.append("")
            for name in ("href", "src"):
                if tag in ("a", "area", "link", "img", "script", "iframe") and name in attrs and not self.hidden:
                    self.links.append((attrs[name], tag))

        def handle_endtag(self, tag):
            if tag in ("head", "script", "style", "noscript", "template"):
                self.hidden -= 1
            if tag in warc.BREAKS:
                self.lines.append("")

        def handle_data(self, data):
            if self.title == "":
                self.title = " ".join(data.split())
            if not self.hidden:
                self.lines[-1] += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    return reader, "\n".join(x for x in (" ".join(line.split()) for line in reader.lines) if x), urljoin


def test_the_warc_query_against_another_parser(spark):
    """op3_warc_derivatives on all pages of the smallest tables: text, fields, digests and references."""
    import base64
    import hashlib

    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = warc.op3_warc_derivatives(spark, DATA).collect()
    assert len(rows) == 2 * len(pages)
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    refers = {}
    for r in rows:
        page = pages[r.page_id]
        reader, text, urljoin = plain_page(page.html)
        raw = r.content.encode()
        assert (r.target_uri, r.payload_digest, r.block_digest, r.content_length) == (page.url, sha(page.html.encode()), sha(raw), len(raw))
        assert refers.setdefault(r.page_id, r.refers_to) == r.refers_to != r.record_id
        if r.kind == "conversion":
            assert r.content == text
        else:
            fields = [line.partition(": ")[::2] for line in r.content.split("\r\n") if line]
            assert [v for k, v in fields if k == "title"] == [reader.title] and [v for k, v in fields if k == "languages"] == [reader.lang]
            assert [v for k, v in fields if k == "outlink"] == [f"{urljoin(page.url, x)} {tag}" for x, tag in reader.links]
            assert ("http-header-content-length", str(len(page.html.encode()))) in fields


def learned(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = learned(spark)
    model = toxicity.train(docs, labels.where(toxicity.third() != 1), toxicity.Stages(spark, "t"))
    rows = toxicity.score(docs, model).join(labels.where(toxicity.third() == 1), "doc_id").collect()
    toxic = [r.score >= 0.7 for r in rows if r.toxic == 1]
    clean = [r.score >= 0.7 for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.02
    dodged = ["you are an idiot", "you i.d.i.o.t you", "what an id*iot", "such an i d i o t here", "IDIOT!", "an idxiot"]
    clear = ["a kind and quiet person", "", None, "ideas of note", "!!! ... 123", "x" * 9000]
    rows = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(dodged + clear)], "doc_id long, text string, decision double")
    got = {r.doc_id: r.score for r in toxicity.score(rows, model).collect()}
    assert all(got[i] >= 0.7 for i in range(len(dodged))), got
    assert all(got[i] < 0.7 for i in range(len(dodged), len(got))), got


def test_insults_of_few_letters(spark):
    """Words of two and three letters are learnt, found in other documents, spelt apart too, and don't spread to their neighbours."""
    rnd = random.Random(3)
    plain = ["".join(rnd.choice("abcdefghimnoprstu") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    insults = ["zyx", "jw", "kéß", "vqzw"]

    def text(*extra):
        return ". ".join(" ".join([*(rnd.choice(plain) for _ in range(8)), *([x] if x else []), *(rnd.choice(plain) for _ in range(4))]) for x in (None, *extra, None))

    rows = [(i, text(insults[i % 4]), 1) for i in range(160)] + [(1000 + i, text(), 0) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"), toxicity.Stages(spark, "t"))
    new = [*insults, "ZYX!", "zy.x", "(jw)"] + ["xyz", "w", "zone", "j", "none", "kind"]
    rows = spark.createDataFrame([(i, text(x)) for i, x in enumerate(new)], "doc_id long, text string")
    assert [new[r.doc_id] for r in toxicity.score(rows, model).orderBy("doc_id").collect() if r.score >= 0.7] == new[:7]


def test_insults_that_share_a_stem(spark):
    """No form of the insult is frequent; documents hold several, clean ones now and then one by chance."""
    rnd = random.Random(5)
    plain = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    ends = [a + b for a in ("a", "e", "io", "u") for b in ("ra", "ñe", "ci", "to", "l", "ja")]

    def text(n):
        words = [rnd.choice(plain) for _ in range(30)] + ["zuvake" + rnd.choice(ends) for _ in range(n)]
        rnd.shuffle(words)
        return " ".join(words)

    rows = [(i, text(4), 1) for i in range(60)] + [(1000 + i, text(int(i % 20 == 0)), 0) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"), toxicity.Stages(spark, "t"))
    new = spark.createDataFrame([(i, text(4 if i < 40 else 0)) for i in range(200)], "doc_id long, text string")
    found = {r.doc_id for r in toxicity.score(new, model).collect() if r.score >= 0.7}
    assert len(found & set(range(40))) >= 36 and len(found - set(range(40))) <= 3


def test_insults_in_texts_without_spaces(spark):
    """Texts of signs without spaces: the insult is three of them."""
    rnd = random.Random(6)
    signs, insult = [chr(0x4E00 + 7 * k) for k in range(300)], "\u5e9f\u7269\u72d7"

    def text(bad):
        x = [rnd.choice(signs) for _ in range(200)]
        return "".join(x[:100]) + insult * bad + "".join(x[100:])

    rows = [(i, text(i % 8 == 0), int(i % 8 == 0)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"), toxicity.Stages(spark, "t"))
    new = spark.createDataFrame([(i, text(i < 30)) for i in range(200)], "doc_id long, text string")
    found = {r.doc_id for r in toxicity.score(new, model).collect() if r.score >= 0.7}
    assert len(found & set(range(30))) >= 28 and len(found - set(range(30))) <= 3


def plain_vector(word):
    """The kernel's features by going through all places of four symbols, and the length that scales them."""
    symbols, out, size = "<|" + word + "|", collections.Counter(), 0.0
    for at in itertools.combinations(range(len(symbols)), 4):
        x = "".join(symbols[k] for k in at)
        if at[3] - at[0] >= toxicity.SPAN or not all(c in "<|" or "a" <= c <= "z" for c in x):
            continue
        # a front edge counts only next to the symbol behind it, the last edge only without gaps
        if any(x[k] in "<|" and at[k + 1] != at[k] + 1 for k in (0, 1)) or (x[3] == "|" and at[3] - at[0] > 3):
            continue
        weight = toxicity.DECAY ** (at[3] - at[0] + 1)
        out[x] += weight
        size += weight**2
    return out, max(size**0.5, 1e-9)


def test_scores_like_brute_force(spark):
    """Kernel, decision and evidence against a plain version, for words of Latin letters."""
    words = ["idiot", "idxiot", "i*diot", "trash", "thrash", "nation", "ab", "a"]
    plain = {w: plain_vector(w) for w in words}

    def k(a, b):
        return sum(v * plain[b][0][x] for x, v in plain[a][0].items()) / (plain[a][1] * plain[b][1])

    assert np.allclose(toxicity.kernel(words, words), [[k(a, b) for b in words] for a in words], atol=1e-5)
    model = toxicity.Model(["idiot", "trash", "nation"], np.array([0.9, 0.8, -0.7]), -0.1, 0.1, ((np.array([-1.0, 1.0]), np.array([0.0, 0.9])), (np.array([0.0, 2.0]), np.array([0.0, 1.0]))))
    decided = {w: float(np.clip(sum(a * k(w, m) for a, m in zip(model.alpha, model.landmarks)) + model.bias, toxicity.FLOOR, toxicity.CEILING)) for w in words}
    texts = ["idiot", "nation a ab", "thrash idxiot idiot idiot", "trash thrash idiot idxiot i*diot", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.decide(frame, model, ("doc_id",)).collect():
        values = sorted({w: decided[w] for w in texts[r.doc_id].split()}.values(), reverse=True)
        total = sum(-np.log(1 - max(0, v) ** 2) for v in values[: toxicity.TELLING])
        assert r.decision == pytest.approx(max(values, default=toxicity.FLOOR), abs=1e-4) and r.total == pytest.approx(total, abs=1e-3)


def test_toxicity_without_evidence(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "some text", "a"), (2, None, "b")], "doc_id long, text string, score string")
    model = toxicity.train(docs, none, toxicity.Stages(spark, "t"))
    assert all(r.score < 0.01 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_kernel_tolerates_gaps():
    k = toxicity.kernel(["idiot", "i.d.i.o.t", "idxiot", "nation", "abc"], ["idiot"])[:, 0]
    assert k[0] == pytest.approx(1, abs=0.05) and k[1] > 0.5 and k[2] > 0.4 and k[3] < 0.2 and k[4] == 0


def test_quality_on_held_out_documents(spark):
    docs, labels = learned(spark)
    rows = quality_gam.feature_table(docs)
    model = quality_gam.train(rows, labels.where(quality_gam.fifth() != 0))
    out = quality_gam.score(rows, model).join(labels.where(quality_gam.fifth() == 0), "doc_id").collect()
    right = np.mean([(r.score >= 0.3) == (r.quality == 1) for r in out])
    assert right > 0.9
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (2, "", 1.0), (None, "ü" * 40_000, 1.0)], "doc_id long, text string, features double")
    scores = [r.score for r in quality_gam.score(quality_gam.feature_table(odd), model).collect()]
    assert len(scores) == 4 and scores[1] == scores[2] and all(0 <= s <= 1 for s in scores)
    assert quality_gam.train(quality_gam.feature_table(odd), labels.limit(0)).score(np.zeros((1, len(quality_gam.FEATURES))))[0] == 0.5


def test_additive_model_finds_an_interaction():
    rnd = np.random.default_rng(0)
    x = rnd.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == (y > 0.5)) > 0.95


TEXTS = ["Hello world", "", None, " leading", "two  spaces   three", "trailing ", "line\nbreak\ttab", "naïve — ünï 漢字 🙂", "<s> </s> <0x0A> <unk>", "a▁b", "x" * 3000, "word " * 5000, "​  odd", "Hello world", "  ", "\x00\x01"]


def test_tokens_equal_sentencepiece(spark):
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int").coalesce(1)
    out = {r.doc_id: r for r in sentencepiece_codec.encode(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert out[i].ids == ref.encode(t or ""), t
        assert out[i].parity and out[i].n_tokens == len(out[i].ids)
        assert out[i].round_trip == ("▁" not in (t or "")), t
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS))
    assert sentencepiece_codec.encode(docs.limit(0)).collect() == []
    assert sentencepiece_codec.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()[0].text == ""


def test_unigram_models_are_rebuilt():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(sentencepiece_codec.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        p.score = -1.0 - 0.0007 * i
    codec = sentencepiece_codec.Codec(proto.SerializeToString())
    for t in ("hello there world", "some  more", "ünï 漢"):
        assert codec.encode_one(t).tolist() == codec.reference.encode(t)


def brute_leaks(docs, items, window=20, share=0.8):
    import re

    def cut(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    out = set()
    for d, t in docs:
        a = cut(t)
        for k, s in items:
            b = cut(s)
            if not b:
                continue
            w = min(window, len(b))
            for shift in range(-len(b), len(a)):
                eq = [0 <= shift + p < len(a) and a[shift + p] == b[p] for p in range(len(b))]
                if any(sum(eq[s : s + w]) >= share * w for s in range(len(b) - w + 1)):
                    out.add((d, k))
    return out


def test_leaks_are_found_with_substitutions(spark):
    rnd = random.Random(8)
    words = ["t%d" % i for i in range(3000)]

    def text(n):
        return [rnd.choice(words) for _ in range(n)]

    items = [(i, " ".join(text(rnd.choice([5, 12, 25, 40])))) for i in range(12)]
    docs = []
    for i, (k, s) in enumerate(items):
        for changes in (0, 1, 2):
            part = s.split()
            for p in rnd.sample(range(len(part)), min(changes, len(part) // 8)):
                part[p] = "changed"
            docs.append((100 * i + changes, ", ".join(text(10)) + ". " + " ".join(part).upper() + "! " + " ".join(text(15))))
    docs += [(5000, None), (5001, ""), (5002, " ".join(text(3000))), (5003, items[3][1]), (5003, items[3][1]), (None, items[3][1])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, seed int")
    bench = spark.createDataFrame([*items, (None, "x " * 20), (90, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, bench).collect()}
    assert got == brute_leaks([r for r in docs if r[0] is not None], items)
    assert decontamination.contaminated(frame.limit(0), bench).collect() == []
    assert decontamination.contaminated(frame, bench.limit(0)).collect() == []


def test_masks_miss_no_substitutions():
    for width, masks in decontamination.MASKS.items():
        ones = [sum(1 << (at + i) for i, x in enumerate(m) if x == "1") for m in masks for at in range(width - len(m) + 1)]
        for places in itertools.combinations(range(width), width // 5):
            changed = sum(1 << p for p in places)
            assert any(not changed & o for o in ones), (width, places)


def test_leaks_are_found_with_every_fifth_word_replaced(spark):
    rnd = random.Random(9)
    items = [(n, " ".join("t%d" % rnd.randrange(3000) for _ in range(n))) for n in (*range(5, 21), 25, 40)]
    docs = []
    for n, s in items:
        for first in range(5):
            part = s.split()
            part[first::5] = ["changed"] * len(part[first::5])
            docs.append((10 * n + first, " ".join(part)))
        for k in range(5, 10):
            part = s.split()
            for p in rnd.sample(range(n), n // 5):
                part[p] = "changed"
            docs.append((10 * n + k, "before it. " + " ".join(part) + ", after it"))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, bench).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 100
    with pytest.raises(ValueError):
        decontamination.contaminated(frame, bench, similarity=0.7)


def test_short_items_are_found_where_asked_for(spark):
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(1, 10)]
    docs = [(10 * n, "before it, " + s + ", after it") for n, s in items]
    for n, s in items[4:]:
        docs += [(10 * n + 1 + p, " ".join([*s.split()[:p], "changed", *s.split()[p + 1 :]])) for p in range(n)]
    docs += [(200, items[3][1].replace("w4x1", "changed")), (201, items[8][1].replace("w9x1", "changed").replace("w9x5", "changed")), (202, "")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, bench).collect()}
    # of nine tokens eight must agree, of five four, below five all
    assert got == {(d, d // 10) for d, _ in docs if d < 200}
    assert got == brute_leaks(docs, items)
    assert {r.item_id for r in decontamination.contaminated(frame, bench, shortest=6).collect()} == {6, 7, 8, 9}
    # many seeds are joined by sorting, with the same result
    assert got == {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, bench, few=0).collect()}


def test_the_pipeline_drops_copies_of_short_items(spark, tmp_path):
    pipeline = __import__("corpus_pipeline")
    spark.createDataFrame([(1, "what is osmosis")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "Tell me: what is osmosis?", "en", "s", 25), (2, "what is rain", "en", "s", 12)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()] == [2]


def test_warc_keeps_text_with_bare_signs_and_pages_with_an_open_head():
    assert warc.plain_text('<p>if a < b and c > d then <b title="x>y">stop</b></p>') == "if a < b and c > d then stop"
    assert warc.plain_text('<p>An <a title="open>end</a> of it</p>') == "An end of it"
    assert warc.plain_text("<p>5 < 6 holds here.</p><p>Second paragraph.</p><p>Third <b>bold</b> end.</p>") == "5 < 6 holds here.\nSecond paragraph.\nThird bold end."
    for close in ("<body>", "", "</head><body>"):
        page = f"<html><head lang=x><meta content='a > b'><title>T</title><style>p {{}}</style><script>'</head>'</script>{close}<p>Text <a href=/x>of</a> it.</p><header>Top</header></html>"
        assert warc.plain_text(page) == "Text of it.\nTop"
        fields = warc.derivatives({"warc-type": "response", "warc-target-uri": "http://a.example/", "warc-block-digest": "x"}, page.encode())[0][2].decode()
        assert "outlink: http://a.example/x a" in fields


@pytest.mark.parametrize("start", ["<head><title>T</title><body>", "<head><title>T</title>", "<head><meta content='>'><noscript><img></head><body>", "<head></head><body><div><svg><path d=1></div>", "<body><div><select><option>Any</div>", "<body><div><noscript>Turn it on</div>", "<body><div><template><p>No</p></div>", "<body><svg class=x /><p><template><p>No</p></template></p>"])
def test_elements_without_end_tag_end_with_their_parent(start):
    article = "<article><h1>A title</h1><p>The first paragraph of it, <svg><title>No</title><a><path d=1></a></svg>which is whole.<p>The second paragraph of it.</article>"
    want = "A title\nThe first paragraph of it, which is whole.\nThe second paragraph of it."
    assert html_extraction.main_text(f"<html>{start}{article}</html>") == want


@pytest.mark.parametrize(
    "before,after",
    [
        ('<body class="single-post has-sidebar comments-open"><div>', "</div></body>"),
        ('<body class="sidebar" id=search><main id="search-results" role=main>', "</main></body>"),
        ('<body><div class="search-page with-comments" data-id="comments" title="a hidden class = comments">', "</div></body>"),
        ('<body><div class="sidebar">', "</div></body>"),
    ],
)
def test_names_on_what_holds_the_article_do_not_empty_the_page(before, after):
    rest = '<div class="comments"><p>A reader says that this was fine, and says so at length.</p><article class="comment-body"><p>Another reader says the same at length.</p></article></div>'
    hidden = '<aside><article><p>A teaser of some other article, at length.</p></article></aside><div hidden><article><p>Never seen by any reader of the page.</p></article></div>'
    page = f"<html>{before}<article class='post comments-open'><h1>A title</h1><p>The first paragraph of it, at some length.</p></article>{rest}{hidden}{after}</html>"
    assert html_extraction.main_text(page) == "A title\nThe first paragraph of it, at some length."

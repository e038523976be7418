"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

Kernel: two words are alike by the subsequences of four symbols that they
share, each weighted by decay to the length that it spans. Symbols are letters
and the word's edges (two in front, one behind), so a word of one or two
letters has a vector too; other characters may stand between, so i-d-i-o-t and
idxiot stay near idiot. Spans end at `SPAN` characters. A word's vector is
scaled by its own length.

Training takes labelled sentences: distinct sentences of a bounded sample of
documents, toxic only if no other document says the same. Which word of a
toxic sentence makes it so is not labelled, so words are chosen that, with the
words near them in the kernel (at either of two radii), stand in toxic
sentences of far more documents than their share (multiple-instance SVM). An
insult that varies from document to document is so found by its stem. Words
far from one another among the surest are the landmarks; Nystroem features
K(x, L) K(L, L)^-1/2 go to a linear SVM in which a word counts for either class
by the share of its neighbourhood. It is fitted anew with the clean words
nearest to its border, and its decision is folded back into one weight per
subsequence.

A document's evidence is its highest decision, and the noisy or of its
`TELLING` highest decisions above zero, of different words: one sure insult is
enough, and so are several words of which one alone tells little. Its score is
the higher of two rising functions of them, fitted to the sample. Words of more than
`LONG_WORD` characters are read in overlapping windows. Letters without case
(scripts that may leave out spaces) are read, in training and in scoring, as
every run of two to four of them besides the word itself, each as two symbols. Defined
results: null, empty and wordless texts get the score of the lowest decision;
without labels, or without words that tell the classes apart, every score is
the share of toxic documents (zero without labels); each row is scored alone,
so repeated rows score alike; further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import string
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Stages, pieces, table, trimmed

LETTERS, LENGTH, SPAN, DECAY = 32, 4, 7, 0.7
EDGES = "\x02\x03"
LONG_WORD, LONG_STEP = 24, 12
#: Signs and digits that don't count where a word begins or ends.
BESIDE = string.punctuation + string.digits + "«»„“”‘’‚‹›…¿¡–—·•"
FLOOR, CEILING = -3.0, 0.95
#: Words of a text whose decisions add up, and the most that they can reach.
TELLING = 4
MOST = -TELLING * float(np.log1p(-(CEILING**2)))
#: Kernel values from which words are neighbours, and the least share of toxic documents of a neighbourhood.
RADII, NEAR_SHARE = (0.65, 0.8), 0.5
#: Documents' worth of a wider neighbourhood in the share of a narrower one.
DRAWN = 10
#: Lengths of the runs of letters without case.
RUNS = (2, 3, 4)
GAPS = [(0, *rest) for rest in itertools.combinations(range(1, SPAN), LENGTH - 1)]
#: Letters told apart by a space, dot or dash each.
SPELT_OUT = r"(?:\b\pL\b[ .\-_*]){3,}\pL\b"
#: Java's class of letters without case.
CASELESS, CASELESS_SQL = r"\p{Lo}", r"\\p{Lo}"
_spelt = re.compile(r"(?:\b[^\W\d_]\b[ .\-_*]){3,}[^\W\d_]\b")


def letter_codes(text: str) -> np.ndarray:
    """0 for what is no letter, 1-26 for a-z, 27-29 for others, 30 and 31 for a word's edges; -1 for the line break between words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = np.zeros(128, np.int32)
    ascii_[ord("a") : ord("z") + 1] = np.arange(1, 27)
    ascii_[[ord(x) for x in EDGES]] = LETTERS - 2, LETTERS - 1
    ascii_[10] = -1
    return np.where(points < 128, ascii_[np.minimum(points, 127)], 27 + (points % 3).astype(np.int32))


def caseless(x: str) -> bool:
    return unicodedata.category(x) == "Lo"


def spelt(word: str) -> str:
    """The word with two Latin letters for each letter without case."""
    if word.isascii() or not any(map(caseless, word)):
        return word
    return "".join([chr(97 + ord(x) // 26 % 26) + chr(97 + ord(x) % 26) if caseless(x) else x for x in word])


def runs(word: str) -> list[str]:
    """Every run of `RUNS` letters of a word with letters without case; the word itself is none of them."""
    if word.isascii() or not any(map(caseless, word)):
        return []
    return [word[k : k + n] for n in RUNS if n < len(word) for k in range(len(word) - n + 1) if all(map(caseless, word[k : k + n]))]


class Letters:
    """The symbols of words end to end: word of each symbol, and the subsequences of LENGTH symbols that start at each."""

    def __init__(self, words: list[str]):
        codes = letter_codes("".join([f"{EDGES}{spelt(w)}{EDGES[1]}\n" for w in words]))
        ends = np.flatnonzero(codes < 0)
        word = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=-1))
        left = (ends[word] - np.arange(len(codes))).astype(np.int32)
        codes = np.maximum(codes, 0).astype(np.int32)
        at = np.flatnonzero(codes > 0)
        self.n = len(words)
        self.word, left = word[at], left[at]
        padded = np.concatenate([codes, np.zeros(SPAN, np.int32)])
        self.shifted = [np.where(d < left, padded[at + d], np.int32(0)) for d in range(SPAN)]

    def by_gaps(self) -> Iterator[tuple[np.ndarray, np.float32]]:
        """For each pattern of gaps the subsequence at each symbol (0: none), and its weight."""
        edge = LETTERS - len(EDGES)
        for gaps in GAPS:
            a, b, c, d = (self.shifted[g] for g in gaps)
            fits = (b > 0) & (c > 0) & (d > 0)
            # a front edge counts only next to the symbol behind it, the last edge only without gaps
            for x, near in ((a, gaps[1] == 1), (b, gaps[2] == gaps[1] + 1), (d, gaps[-1] == LENGTH - 1)):
                if not near:
                    fits &= x < edge
            yield np.where(fits, ((a * LETTERS + b) * LETTERS + c) * LETTERS + d, 0), np.float32(DECAY ** (gaps[-1] + 1))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, values, self.n)


def decisions(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The SVM's decision on each word, from FLOOR to CEILING: beyond its margin a word is no more toxic."""
    letters = Letters(words)
    total, norm = np.zeros(len(letters.word), np.float32), np.zeros(len(letters.word), np.float32)
    for code, weight in letters.by_gaps():
        total += weights[code] * weight
        norm += (code > 0) * (weight * weight)
    norm = np.sqrt(letters.sums(norm))
    return np.clip(np.divide(letters.sums(total), norm, out=np.zeros(len(words)), where=norm > 0) + bias, FLOOR, CEILING)


def feature_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scaled feature vectors as (word, subsequence, value)."""
    letters = Letters(words)
    found = list(letters.by_gaps())
    norm = np.sqrt(letters.sums(sum((code > 0) * (weight * weight) for code, weight in found)))
    rows = np.concatenate([letters.word] * len(found))
    codes = np.concatenate([c for c, _ in found])
    values = np.concatenate([np.full(len(letters.word), w) for _, w in found]) / np.maximum(norm[rows], 1e-9)
    keep = codes > 0
    return rows[keep], codes[keep], values[keep]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    rows, codes, values = feature_rows(words)
    out = np.empty((len(words), len(landmarks)))
    r, c, v = feature_rows(landmarks)
    for j in range(len(landmarks)):
        dense = np.zeros(LETTERS**LENGTH)
        np.add.at(dense, c[r == j], v[r == j])
        out[:, j] = np.bincount(rows, values * dense[codes], len(words))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5, steps: int = 30) -> np.ndarray:
    """Squared hinge loss by Newton steps; the last component is the bias. y: -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        margin = 1 - y * (x @ w)
        on = margin > 0
        xs = x[on] * weight[on, None]
        grad = -(xs.T @ (y[on] * margin[on])) + ridge * w
        step = np.linalg.solve(xs.T @ x[on] + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def with_insertions(word: str) -> list[str]:
    """The word as it is dodged: one character put in, or all letters apart."""
    middle = range(1, len(word))
    return [word[:i] + x + word[i:] for i in middle for x in ("*", "q")] + [".".join(word)]


def rising_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve nearest to y over x (pooled adjacent violators), each pool's share smoothed towards a half.

    Toxic documents whose words tell nothing lower the curve's low end only.
    """
    values, where = np.unique(np.round(x, 3), return_inverse=True)
    kept: list[tuple[float, float, float, float]] = []  # least and greatest x, rows, toxic rows
    for v, n, k in zip(values.tolist(), np.bincount(where).tolist(), np.bincount(where, y).tolist()):
        kept.append((v, v, n, k))
        while len(kept) > 1 and kept[-2][3] / kept[-2][2] >= kept[-1][3] / kept[-1][2]:
            (lo, _, n1, k1), (_, hi, n2, k2) = kept[-2:]
            kept[-2:] = [(lo, hi, n1 + n2, k1 + k2)]
    share = [(k + 0.5) / (n + 1) for _, _, n, k in kept]
    return np.array([x for p in kept for x in p[:2]]), np.maximum.accumulate(np.repeat(share, 2))


@dataclass
class Model:
    """Decision of a word: the sum of its subsequences' weights, scaled, plus bias. Score: the higher of two rising curves through knots, and a little of the decision itself."""

    landmarks: list[str] = field(default_factory=list)
    alpha: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = FLOOR
    base: float = 0.0
    curves: tuple[tuple[np.ndarray, np.ndarray], ...] = ()

    def weights(self) -> np.ndarray:
        dense = np.zeros(LETTERS**LENGTH, np.float32)
        if self.landmarks:
            r, c, v = feature_rows(self.landmarks)
            np.add.at(dense, c, (v * self.alpha[r]).astype(np.float32))
        return dense

    def score(self, most: np.ndarray, total: np.ndarray) -> np.ndarray:
        own = ((most - FLOOR) / (CEILING - FLOOR) + total / MOST) / 2
        shares = [np.interp(x, *curve) for x, curve in zip((most, total), self.curves)] or [np.full(len(own), self.base)]
        return 0.99 * np.maximum.reduce(shares) + 0.01 * own


def gain(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """Log likelihood that a word's documents are toxic more often than `share`; 0 if they aren't."""
    rate = pos / np.maximum(pos + neg, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(rate > share, pos * np.log(rate / share) + np.where(neg > 0, neg * np.log((1 - rate) / (1 - share)), 0), 0)


def shares_near(words: pd.DataFrame, pooled: pd.DataFrame) -> np.ndarray:
    """Share of toxic documents of each word, drawn to that of its neighbourhood, and this to that of the wider one."""
    rate = np.full(len(words), NEAR_SHARE)
    levels = [pooled[pooled["radius"] == r].set_index("centre").reindex(range(len(words))).fillna(0) for r in np.argsort(RADII)]
    for level in (*levels, words):
        pos, neg = level["pos"].to_numpy(float), level["neg"].to_numpy(float)
        rate = (pos + DRAWN * rate) / (pos + neg + DRAWN)
    return rate


def neighbours(counts: DataFrame, centres: list[str]) -> DataFrame:
    """(word, centre, radius): the words of `counts` near each centre, by number, at each radius that they are within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, code, value = feature_rows(centres)
        order = np.argsort(code, kind="stable")
        centre, code, value = centre[order].astype(np.int64), code[order], value[order]
        known, first = np.unique(code, return_index=True)
        size = np.diff(first, append=len(code))
        for whole in batches:
            for batch in pieces(whole, "word", 1 << 12):
                words = batch.column(0).to_pylist()
                row, found, v = feature_rows(words)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hit = known[at] == found
                row, at, v = row[hit], at[hit], v[hit]
                n = size[at]
                of = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                near = np.bincount(np.repeat(row, n) * np.int64(len(centres)) + centre[of], np.repeat(v, n) * value[of], len(words) * len(centres))
                for radius, least in enumerate(RADII):
                    pair = np.flatnonzero(near >= least)
                    columns = [pa.array([words[i] for i in pair // len(centres)], pa.string()), pa.array(pair % len(centres), pa.int32()), pa.array(np.full(len(pair), radius), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["word", "centre", "radius"])

    return counts.select("word").mapInArrow(trimmed(run), "word string, centre int, radius int")


def spread(words: list[str], n: int) -> list[str]:
    """n of the words, surest first: those far from all taken before them, then the rest."""
    words = words[: 4 * n]
    k = kernel(words, words)
    far: list[int] = []
    for i in range(len(words)):
        if all(k[i, j] < RADII[-1] for j in far):
            far.append(i)
    rest = [i for i in range(len(words)) if i not in set(far)]
    return [words[i] for i in (far + rest)[:n]]


def fit_words(toxic: list[str], rate: np.ndarray, clean: list[str], landmarks: int, hard: list[str]) -> Model:
    """toxic: the words chosen, surest first, and the share of toxic documents of each. hard: clean words near the border."""
    first = spread(toxic, landmarks)
    marks = first + [w for w in hard[:landmarks] if w not in set(first)]  # the clean words nearest to the toxic ones tell what sets them apart
    k = kernel(marks, marks)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    chosen = set(toxic)
    clean = [w for w in dict.fromkeys(hard + clean) if w not in chosen]
    share = dict(zip(toxic, rate.tolist()))
    dodged = [(v, share[w]) for w in first for v in with_insertions(w)]
    units = toxic + [v for v, _ in dodged] + clean
    share_of = np.concatenate([rate, [r for _, r in dodged], np.zeros(len(clean))])
    x = kernel(units, marks) @ root
    each = 1 / (len(toxic) + len(dodged))
    # a unit stands on both sides, with the weight of its share
    weight = np.concatenate([each * share_of, each * (1 - share_of)])
    on = weight > 0
    w = linear_svm(np.vstack([x, x])[on], np.repeat([1.0, -1.0], len(units))[on], weight[on])
    return Model(marks, root @ w[:-1], float(w[-1]))


def noisy_or(decision: np.ndarray) -> np.ndarray:
    """What a decision above zero adds to a text's evidence; near the border next to nothing."""
    return -np.log1p(-(np.clip(decision, 0, CEILING) ** 2))


def evidence(texts: pa.Array, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """The highest decision of each text, and the noisy or of its highest ones above zero of different words."""
    texts = pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    words = pc.utf8_trim(coded.dictionary, BESIDE).to_pylist()
    # each word with what it is read as: itself, windows of long ones, runs of letters without case
    extra = [(i, u) for i, w in enumerate(words) if len(w) > LONG_WORD for u in (w[k : k + LONG_WORD] for k in range(0, len(w) - LONG_STEP, LONG_STEP))]
    extra += [(i, u) for i, w in enumerate(words) for u in set(runs(w))]
    units, number = [], {}
    for u in itertools.chain(words, (u for _, u in extra)):
        if u not in number:
            number[u] = len(units)
            units.append(u)
    value = np.concatenate([decisions(units[k : k + 50_000], weights, bias) for k in range(0, len(units), 50_000)] or [np.empty(0)])
    if "" in number:
        value[number[""]] = FLOOR
    unit = np.array([number[w] for w in words], np.int64)
    if extra:  # a long word is told by the surest of what it is read as
        at, reads = np.array([i for i, _ in extra]), np.array([number[u] for _, u in extra])
        order = np.lexsort((value[reads], at))
        last = order[np.append(np.diff(at[order]) > 0, True)]
        better = value[reads[last]] > value[unit[at[last]]]
        unit[at[last][better]] = reads[last][better]
    out = np.full(len(texts), FLOOR)
    n = np.diff(lists.offsets.to_numpy())
    full = np.flatnonzero(n > 0)
    told = unit[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])[full]
        out[full] = np.maximum.reduceat(value[told], starts)
    apart = pc.match_substring_regex(texts, SPELT_OUT).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), n)
    above = np.flatnonzero(value[told] > 0)
    pairs = np.unique(np.stack([doc[above], told[above]]), axis=1) if len(above) else np.empty((2, 0), np.int64)
    order = np.lexsort((-value[pairs[1]], pairs[0]))
    of, adds = pairs[0][order], noisy_or(value[pairs[1][order]])
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    total = np.bincount(of[rank < TELLING], adds[rank < TELLING], len(texts))
    for i in np.flatnonzero(apart):
        letters = [re.sub(r"\W|_", "", m) for m in _spelt.findall(texts[int(i)].as_py())]
        if letters:
            most = decisions(letters, weights, bias).max()
            out[i], total[i] = max(out[i], most), max(total[i], noisy_or(most))
    return out, total


def decide(docs: DataFrame, model: Model, keep: tuple[str, ...], as_score: bool = False) -> DataFrame:
    """Columns `keep` and the evidence, `decision` and `total` (or score), of every whole text."""
    names = ["score"] if as_score else ["decision", "total"]
    source = docs.select(*keep, *[c for c in ("text",) if c not in keep])
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + "".join([f", {name} double" for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights()
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                found = evidence(batch.column(batch.schema.get_field_index("text")), weights, model.bias)
                rows = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                given = (model.score(*found),) if as_score else found
                yield pa.RecordBatch.from_arrays([*rows, *[pa.array(x, pa.float64()) for x in given]], names=[*keep, *names])

    return source.mapInArrow(trimmed(run), schema)


def nearest(counts: DataFrame, model: Model, n: int) -> list[str]:
    """The n words of highest decision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights()
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decisions(words, weights, model.bias) if words else [], pa.float64())], names=["word", "decision"])

    ranked = counts.select("word").mapInArrow(trimmed(run), "word string, decision double").orderBy(F.desc("decision"), "word").limit(n)
    return [r.word for r in ranked.collect()]


@dataclass(frozen=True)
class Bounds:
    """How much of the labelled sample a model is fitted on, so that a fit takes the same memory at every size of the corpus.

    sample: labelled documents, those of the lowest hash of doc_id. toxic: words
    with the most evidence, each in toxic sentences of at least `seen` documents.
    clean: words in no more toxic sentences than others, of the lowest hash. hard:
    clean words nearest to the border, in each of two rounds.
    """

    sample: int = 8_000
    toxic: int = 2_000
    seen: int = 3
    clean: int = 8_000
    hard: int = 4_000


def train(docs: DataFrame, labels: DataFrame, stages: Stages, bounds: Bounds = Bounds(), landmarks: int = 96, alarm: float = 6.0) -> Model:
    """Learn from (doc_id, toxic) rows. alarm: the evidence that a toxic word needs, above the log of the words tried."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = stages.put(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bounds.sample), "chosen")
    # at most bounds.sample rows, so the texts need not be shuffled for them
    texts = stages.put(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null"), "sample")
    lines = texts.select("doc_id", "toxic", F.explode(F.split(F.lower("text"), r"[.!?\n。！？]+")).alias("line"))
    lines = lines.groupBy("line").agg(F.min("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    word = F.regexp_replace("word", r"^[^\p{L}]+|[^\p{L}]+$", "")
    words = lines.select("doc_id", "toxic", F.explode(F.array_distinct(F.split("line", r"\s+"))).alias("word")).select("doc_id", "toxic", word.alias("word")).where("word <> ''")
    windows = F.expr(f"transform(sequence(0, length(word) - {LONG_STEP} - 1, {LONG_STEP}), k -> substring(word, k + 1, {LONG_WORD}))")
    short = [F.expr(f"regexp_extract_all(word, '(?=({CASELESS_SQL}{{{n}}}))', 1)") for n in RUNS]
    units = F.concat(
        F.when(F.length("word") > LONG_WORD, windows).otherwise(F.array("word")),
        F.when(F.col("word").rlike(CASELESS + "{3}"), F.concat(*short)).otherwise(F.array().cast("array<string>")),
    )
    # many sentences of one document are one piece of evidence
    held = stages.put(words.select("doc_id", "toxic", F.explode(F.array_distinct(units)).alias("word")).distinct(), "held")
    counts = held.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("neg"))
    counts = stages.put(counts, "words")
    seen = F.col("pos") >= bounds.seen
    total = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count_if(seen).alias("tried")).first()
    toxic = counts.where(seen & (F.col("pos") >= 3 * F.col("neg"))).orderBy(F.desc(F.col("pos") - 3 * F.col("neg")), "word").limit(bounds.toxic).toPandas()
    clean = [r.word for r in counts.where("neg >= pos").orderBy(F.xxhash64("word"), "word").limit(bounds.clean).collect()]
    share = chosen.agg(F.avg("toxic")).first()[0]
    model = None
    if len(toxic):
        near = stages.put(neighbours(counts, toxic["word"].tolist()), "near")
        pooled = near.join(held.hint("merge"), "word").groupBy("centre", "radius", "doc_id").agg(F.max("toxic").alias("toxic"))
        pooled = pooled.groupBy("centre", "radius").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg")).toPandas()
        base = total.pos / max(total.pos + total.neg, 1)
        # the more words and radii are tried, the more evidence one needs
        alarm += float(np.log(max(total.tried, 1) * (1 + len(RADII))))
        own = toxic.assign(centre=range(len(toxic)))[["centre", "pos", "neg"]]
        tried = pd.concat([own, pooled[["centre", "pos", "neg"]]], ignore_index=True).astype({"pos": float, "neg": float})
        tried["gain"] = gain(tried["pos"].to_numpy(), tried["neg"].to_numpy(), base)
        tried["rate"] = tried["pos"] / (tried["pos"] + tried["neg"])
        told = tried[(tried["gain"] > alarm) & (tried["rate"] >= NEAR_SHARE)].sort_values(["gain", "centre"], ascending=[False, True], kind="stable").drop_duplicates("centre")
        told = told.assign(rate=shares_near(toxic, pooled)[told["centre"]])
        if len(told) and clean:
            bad, rate = toxic["word"].to_numpy(object)[told["centre"]].tolist(), told["rate"].to_numpy()
            model = fit_words(bad, rate, clean, landmarks, [])
            hard: list[str] = []
            for _ in range(2):  # the clean words nearest to the toxic side join the training set
                hard += nearest(counts.where("neg >= pos and neg > 0"), model, bounds.hard)
                model = fit_words(bad, rate, clean, landmarks, hard)
    if model is None:
        return Model(base=float(share or 0))
    found = decide(texts, model, ("toxic",)).toPandas()
    model.curves = tuple(rising_fit(found[x].to_numpy(float), found["toxic"].to_numpy(float)) for x in ("decision", "total"))
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and score, of every whole text."""
    return decide(docs, model, keep, as_score=True)


def third(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 3


def op5_toxicity(spark, sf_dir, threshold: float = 0.7) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(third() != 1), Stages(spark, "toxicity"))
    return score(docs, model).select(
        "doc_id", F.coalesce(third() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

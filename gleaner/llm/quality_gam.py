"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting goes round the features in
turn, fitting to the gradient a tree of at most four leaves over one feature's
bins with a small step, so every feature ends with one lookup table; then the
pairs of features that a four-cell split explains best get two-dimensional
tables in the same way. A score is the logistic function of the sum of the
table entries, looked up for whole batches at once.

Features come from the bytes and words of the whole text; labels, lang,
source and doc_id are none. Defined results: null, empty and blank texts have
features of zero and are scored like any other; without labelled rows every
score is 0.5, with rows of one class near that class; each row is scored
alone; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Stages, pieces, table, trimmed, utf8
from gleaner.llm.words import word_hashes, word_spans

FEATURES = (
    "log_bytes", "upper", "digit", "symbol", "exclaim", "pipe", "stop", "comma", "other_punct", "non_ascii", "space", "line_break",
    "word_length", "distinct_words", "repeats", "short_words", "long_words", "capital_words", "words_per_line", "log_words",
)
#: Byte classes: 0 lower and others, 1 upper, 2 digit, 3 symbol, 4 !, 5 |, 6 sentence end, 7 comma, 8 other punctuation, 9 non-ASCII lead, 10 blank, 11 line break, 12 continuation.
CLASSES = 13


def byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for chars, k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"#$%&*+<=>@^~\\_{}[]", 3), (b"!", 4), (b"|", 5), (b".?", 6), (b",", 7), (b"\"'()-/:;`", 8), (b" \t\r\x0b\x0c", 10), (b"\n", 11)):
        out[list(chars)] = k
    out[0x80:0xC0], out[0xC0:] = 12, 9
    return out


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a buffer."""
    rows = len(at) - 1
    sizes = np.diff(at)
    doc = np.repeat(np.arange(rows), sizes)
    kinds = byte_classes()[data]
    count = np.bincount(doc * CLASSES + kinds, minlength=rows * CLASSES).reshape(rows, CLASSES).astype(float)
    chars = np.maximum(sizes - count[:, 12], 1)
    starts, ends, n = word_spans(data, at)
    owner = np.repeat(np.arange(rows), n)
    length = ends - starts
    some = np.maximum(n, 1)
    hashes = word_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])

    def per_word(flag: np.ndarray) -> np.ndarray:
        return np.bincount(owner, flag, rows) / some

    columns = [np.log1p(sizes), *[count[:, k] / chars for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)]]
    columns += [per_word(length), np.bincount(owner[order], fresh, rows) / some, per_word(again), per_word(length <= 2), per_word(length >= 15)]
    columns += [per_word(kinds[starts] == 1) if len(starts) else np.zeros(rows), n / (count[:, 11] + 1), np.log1p(n)]
    return np.stack(columns, axis=1)


def feature_table(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and features array<double>, of every whole text."""
    source = docs.select(*keep, *[c for c in ("text",) if c not in keep])
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                found = features(*utf8(batch.column(batch.schema.get_field_index("text"))))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in keep], lists], names=[*keep, "features"])

    return source.mapInArrow(trimmed(run), schema)


@dataclass
class Model:
    """Cuts and a table for each feature; pairs with coarser cuts and tables; the sum's constant."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cuts, x[:, j], side="right")]
        for (a, b), values in zip(self.pairs, self.pair_tables):
            total += values[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton leaf values for each bin, of a tree of depth two over ordered bins (g, h: gradient and curvature by bin)."""

    def best(lo: int, hi: int) -> int | None:
        gs, hs = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        gain = gs[:-1] ** 2 / (hs[:-1] + ridge) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
        return lo + 1 + int(np.argmax(gain)) if len(gain) and gain.max() > 1e-9 else None

    leaves = [(0, len(g))]
    for _ in range(2):
        parts = []
        for lo, hi in leaves:
            k = best(lo, hi)
            parts += [(lo, hi)] if k is None else [(lo, k), (k, hi)]
        leaves = parts
    out = np.zeros(len(g))
    for lo, hi in leaves:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def quarters(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best split of a two-dimensional table of bins into four cells: its gain, and the leaf values by bin."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total_g, total_h = gs[-1, -1], hs[-1, -1]
    a = [(gs[:-1, :-1], hs[:-1, :-1]), (gs[:-1, -1:] - gs[:-1, :-1], hs[:-1, -1:] - hs[:-1, :-1])]
    a += [(gs[-1:, :-1] - gs[:-1, :-1], hs[-1:, :-1] - hs[:-1, :-1])]
    a += [(total_g - sum(x for x, _ in a), total_h - sum(y for _, y in a))]
    gain = sum(x**2 / (y + ridge) for x, y in a) - total_g**2 / (total_h + ridge)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    out = np.zeros_like(g)
    for (x, y), rows, columns in zip(a, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2):
        out[rows, columns] = x[i, j] / (y[i, j] + ridge)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, step: float = 0.15, pairs: int = 8, pair_bins: int = 12) -> Model:
    """x: features; y: 0 or 1."""
    if not len(y):
        return Model()
    share = np.clip(y.mean(), 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1))
    model = Model(float(np.log(share / (1 - share))))
    width = x.shape[1]
    model.cuts = [quantile_cuts(x[:, j], bins) for j in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    total = np.full(len(y), model.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = gradient()
            n = len(model.tables[j])
            add = step * shallow_tree(np.bincount(binned[j], g, n), np.bincount(binned[j], h, n))
            model.tables[j] += add
            total += add[binned[j]]
    model.coarse = [quantile_cuts(x[:, j], pair_bins) for j in range(width)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]

    def cells(a: int, b: int, values: np.ndarray) -> np.ndarray:
        na, nb = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return np.bincount(coarse[a] * nb + coarse[b], values, na * nb).reshape(na, nb)

    g, h = gradient()
    gains = sorted(((quarters(cells(a, b, g), cells(a, b, h))[0], a, b) for a, b in itertools.combinations(range(width), 2)), key=lambda t: (-t[0], t[1:]))
    model.pairs = [(a, b) for gain, a, b in gains[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(rounds // 2):
        for k, (a, b) in enumerate(model.pairs):
            g, h = gradient()
            add = step * quarters(cells(a, b, g), cells(a, b, h))[1]
            model.pair_tables[k] += add
            total += add[coarse[a], coarse[b]]
    return model


def train(rows: DataFrame, labels: DataFrame, sample: int = 12_000) -> Model:
    """rows: (doc_id, features); labels: (doc_id, quality). At most `sample` labelled rows, those of the lowest hash of doc_id, are fitted."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "features", "quality").toPandas().sort_values("doc_id", kind="stable")
    if not len(found):
        return Model()
    return fit(np.stack(found["features"].to_numpy()), found["quality"].to_numpy(float))


def score(rows: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and score, from columns `keep` and features."""
    source = rows.select(*keep, "features")
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("features")).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in keep], pa.array(model.score(x))], names=[*keep, "score"])

    return source.mapInArrow(trimmed(run), schema)


def fifth(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5


def op7_quality(spark, sf_dir, threshold: float = 0.3) -> DataFrame:
    rows = Stages(spark, "quality").put(feature_table(table(spark, sf_dir, "documents")), "features")
    model = train(rows, table(spark, sf_dir, "labels").where(fifth() != 0))
    return score(rows, model).select(
        "doc_id", F.coalesce(fifth() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

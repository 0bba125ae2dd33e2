"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

A text is described by ``FEATURES``, statistics of its characters, words and lines. They are scaled
by their mean and deviation over all documents and sent through ``n_waves`` random cosines, whose
inner products approximate a Gaussian kernel. Three parts in four of the labelled training rows give
the normal equations of a ridge regression, the fourth part calibrates: ridge scores go to ``BINS``
bins, and pooling adjacent violators over the bins' label shares gives a rising curve with values
from 0 to 1, which is read by linear interpolation between its pools.

Features are fixed-point integers and cosines are rounded to 2**-14, so each task sums its share of
the normal equations exactly and the order in which Spark adds them up changes nothing. The driver
solves a system of ``n_waves`` + 1 unknowns and holds BINS label counts. Texts are read once and
never shuffled; labels meet the features by id.

Defined results: a null or empty text has all statistics 0 and a score like any other; a null id has
no label and isn't held out; an id that repeats in the labels has the label of most of its rows (0
at a tie), null labels don't count; repeated rows are scored each on its own, and train each on its
own; without any label in the calibrating part the ridge score is cut to 0 to 1, without any label
at all every score is 0.5; an empty table gives an empty table; all input columns of any name stay
(the text only with_text), apart from those that a result column of the same name replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylink.llm import textarrays as ta
from keylink.sources.workspace import Workspace

FEATURES = (
    "log_chars", "log_words", "word_chars", "symbols", "marks", "upper", "digits", "points",
    "other_punctuation", "non_ascii", "bare_words", "symbol_ends", "mark_ends", "upper_words",
    "distinct_words", "same_as_before", "repeat_words", "dup_lines", "line_words", "long_words",
)
UNIT = 1 << 12  # fixed point of the features
WAVE = 1 << 14  # fixed point of the cosines
CEILING = 1 << 20  # features end here
BINS = 4096
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4


@dataclass(frozen=True)
class KernelModel:
    """What scoring needs: scales, waves, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def waves(self, features: np.ndarray) -> np.ndarray:
        """Rounded cosines and a last column of ones, as whole numbers."""
        z = np.clip((features - self.mean) / self.scale, -6.0, 6.0)
        out = np.empty((len(features), len(self.phases) + 1))
        out[:, :-1] = np.rint(np.cos(z @ self.frequencies + self.phases) * WAVE)
        out[:, -1] = WAVE
        return out

    def ridge(self, features: np.ndarray) -> np.ndarray:
        return self.waves(features) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge(features), self.knots, self.values)


_ASCII = np.arange(256)
_ALNUM = np.isin(_ASCII, list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) | (_ASCII >= 128)
_KINDS = {
    "symbols": np.isin(_ASCII, list(b"#*$%&|<>")),
    "marks": np.isin(_ASCII, list(b"!?")),
    "upper": np.isin(_ASCII, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    "digits": np.isin(_ASCII, list(b"0123456789")),
    "points": np.isin(_ASCII, list(b".,;:")),
    "non_ascii": _ASCII >= 0xC0,  # first bytes of characters beyond ASCII
}
_SOLID = ~ta.WHITE & ((_ASCII & 0xC0) != 0x80)
_KINDS["other_punctuation"] = (
    _SOLID & ~_ALNUM & ~_KINDS["symbols"] & ~_KINDS["marks"] & ~_KINDS["points"]
)


def _again(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which entries equal another entry of their group that comes before them."""
    order = np.lexsort((values, groups))
    same = (groups[order][1:] == groups[order][:-1]) & (values[order][1:] == values[order][:-1])
    out = np.zeros(len(values), dtype=bool)
    out[order[1:][same]] = True
    return out


def features_of(c: ta.Chunk) -> np.ndarray:
    """Fixed-point statistics, one row per document of the chunk."""
    docs = c.hi - c.lo
    data, (starts, ends) = c.data, c.word_bounds

    def add(groups, weights=None):
        return np.bincount(groups, weights, docs).astype(np.float64)

    byte_doc = np.repeat(np.arange(docs), np.diff(c.offsets))
    words = np.diff(c.first_word).astype(np.float64)
    word_doc = np.repeat(np.arange(docs), np.diff(c.first_word))
    chars = add(byte_doc, (data & 0xC0) != 0x80)
    solid_before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_SOLID[data], out=solid_before[1:])
    length = solid_before[ends] - solid_before[starts]
    alnum_before, upper_before = np.zeros_like(solid_before), np.zeros_like(solid_before)
    np.cumsum(_ALNUM[data], out=alnum_before[1:])
    np.cumsum(_KINDS["upper"][data], out=upper_before[1:])
    alnum = alnum_before[ends] - alnum_before[starts]
    upper = upper_before[ends] - upper_before[starts]
    last = data[ends - 1] if len(ends) else data[:0]
    hashes = c.word_hashes()
    follows = np.zeros(len(hashes), dtype=bool)
    follows[1:] = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    three, three_doc, at = c.shingles(3, hashes, whole=False)
    repeated = np.zeros(len(hashes), dtype=bool)
    begin = (c.first_word[three_doc] + at)[_again(three_doc, three)]
    for k in range(3):
        repeated[begin + k] = True
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[c.offsets] = True
    cut[1:] |= np.append(data, 0)[: len(data)] == 0x0A
    line_at = np.flatnonzero(cut[: len(data)])
    first = np.searchsorted(starts, line_at)
    line_words = np.diff(np.append(first, len(starts)))
    full = line_words > 0
    first, line_words = first[full], line_words[full]
    line_doc = word_doc[first] if len(first) else word_doc[:0]
    lines = add(line_doc)
    line_again = _again(line_doc, ta.window_hashes(hashes, first, first + line_words))

    solid = np.maximum(add(byte_doc, _SOLID[data]), 1)
    n = np.maximum(words, 1)
    stats = {name: add(byte_doc, kind[data]) / solid for name, kind in _KINDS.items()}
    stats |= {
        "log_chars": np.log1p(chars) / 4,
        "log_words": np.log1p(words) / 4,
        "word_chars": add(word_doc, length) / n / 8,
        "bare_words": add(word_doc, alnum == 0) / n,
        "symbol_ends": add(word_doc, _KINDS["symbols"][last]) / n,
        "mark_ends": add(word_doc, _KINDS["marks"][last]) / n,
        "upper_words": add(word_doc, (upper > 1) & (2 * upper > length)) / n,
        "distinct_words": add(word_doc, ~_again(word_doc, hashes)) / n,
        "same_as_before": add(word_doc, follows) / n,
        "repeat_words": add(word_doc, repeated) / n,
        "dup_lines": add(line_doc, line_again) / np.maximum(lines, 1),
        "line_words": np.log1p(words / np.maximum(lines, 1)) / 4,
        "long_words": add(word_doc, length > 20) / n,
    }
    table = np.stack([stats[name] for name in FEATURES], axis=1)
    return np.clip(np.rint(table * UNIT), 0, CEILING).astype(np.int32)


def _measure(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in ta.chunks(batch.column(batch.num_columns - 1)):
            own = [batch.column(i)[c.lo : c.hi] for i in range(batch.num_columns - 1)]
            table = features_of(c)
            listed = ta.lists(table.ravel(), np.full(len(table), len(FEATURES)), pa.int32())
            yield pa.RecordBatch.from_arrays([*own, listed], [*batch.schema.names[:-1], "_f"])


def _features(batch: pa.RecordBatch) -> np.ndarray:
    flat = np.asarray(batch.column(batch.num_columns - 1).flatten())
    return flat.reshape(batch.num_rows, len(FEATURES)).astype(np.float64)


def _moments(batches) -> Iterator[pa.RecordBatch]:
    """Number, sums and sums of squares of a task's features; all whole numbers."""
    total = np.zeros(1 + 2 * len(FEATURES), dtype=np.int64)
    for batch in batches:
        f = _features(batch).astype(np.int64)
        total += np.concatenate([[len(f)], f.sum(axis=0), (f * f).sum(axis=0)])
    yield pa.RecordBatch.from_arrays([ta.lists(total, np.array([len(total)]), pa.int64())], ["_sums"])


# Rows whose products are added in doubles at once: 2**28 * 2**20 is still exact.
_ROWS_AT_ONCE = 1 << 20


def _equations(batches, model: KernelModel) -> Iterator[pa.RecordBatch]:
    """A task's share of the normal equations, row by row: waves * waves, then waves * label."""
    size = len(model.phases) + 1
    total = np.zeros((size, size + 1), dtype=np.int64)
    for batch in batches:
        label = np.asarray(batch.column(0)).astype(np.float64)
        features = _features(batch)
        for lo in range(0, len(label), _ROWS_AT_ONCE):
            z = model.waves(features[lo : lo + _ROWS_AT_ONCE])
            both = np.concatenate([z, label[lo : lo + _ROWS_AT_ONCE, None]], axis=1)
            total += (z.T @ both).astype(np.int64)
    yield pa.RecordBatch.from_arrays([ta.lists(total.ravel(), np.array([total.size]), pa.int64())], ["_sums"])


def _ridge_bins(batches, model: KernelModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.floor((model.ridge(_features(batch)) + 0.5) * (BINS / 2))
        bins = np.clip(at, 0, BINS - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins)], ["_y", "_bin"])


def _scores(batches, model: KernelModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        score = np.full(n, 0.5) if model is None else model.score(_features(batch))
        cols = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*cols, pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"]
        )


def _added(sums: DataFrame) -> np.ndarray:
    """The arrays of ``_sums`` added up place by place."""
    rows = (
        sums.select(F.posexplode("_sums").alias("_at", "_part")).groupBy("_at")
        .agg(F.sum(F.col("_part").cast("decimal(20,0)")).alias("_sum")).collect()
    )
    out = np.zeros(len(rows))
    for row in rows:
        out[row["_at"]] = float(row["_sum"])
    return out


def isotonic(bins: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean bin and share of ones of each pool, both rising, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for b, y, n in zip(bins.tolist(), ones.tolist(), counts.tolist(), strict=True):
        pools.append([b * n, y, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            for i, x in enumerate(pools.pop()):
                pools[-1][i] += x
    table = np.array(pools, dtype=np.float64).reshape(len(pools), 3)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def _labels_by_id(labels: DataFrame, id_column: str, label: str) -> DataFrame:
    is_one = F.col(f"`{label}`").cast("int")
    votes = labels.filter(is_one.isNotNull() & F.col(f"`{id_column}`").isNotNull()).groupBy(
        F.col(f"`{id_column}`").alias("_lid")
    ).agg(F.sum(F.when(is_one == 1, 1).otherwise(-1)).alias("_votes"))
    return votes.select("_lid", (F.col("_votes") > 0).cast("int").alias("_y"))


def fold_of(id_column: Column) -> Column:
    """The part an id belongs to; null for a null id."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(FOLDS))


def fit(
    measured: DataFrame, labels: DataFrame, label: str, id_column: str, n_waves: int, width: float,
    penalty: float, seed: int, space: Workspace,
) -> KernelModel | None:
    """Model from the labelled rows of ``measured`` (_id, _f) that aren't held out."""
    moments = _added(measured.select("_f").mapInArrow(_moments, "_sums array<long>"))
    known = space.save(
        measured.join(_labels_by_id(labels, id_column, label), F.col("_id") == F.col("_lid"))
        .withColumn("_fold", fold_of(F.col("_id")))
        .filter(F.col("_fold") != HELD_OUT)
        .select("_fold", "_y", "_f"),
        "labelled",
    )
    n = moments[0] if len(moments) else 0.0
    if not n or known.isEmpty():
        return None
    mean, squares = np.split(moments[1:] / n, 2)
    scale = np.sqrt(np.maximum(squares - mean * mean, 0.0))
    rng = np.random.default_rng(seed)
    model = KernelModel(
        mean=mean,
        scale=np.where(scale > 0, scale, 1.0),
        frequencies=rng.standard_normal((len(FEATURES), n_waves)) / width,
        phases=rng.uniform(0.0, 2 * np.pi, n_waves),
        weights=np.zeros(n_waves + 1),
        knots=np.array([0.0, 1.0]),
        values=np.array([0.0, 1.0]),
    )
    training = known.filter(F.col("_fold") != CALIBRATION).select("_y", "_f")
    sums = _added(training.mapInArrow(partial(_equations, model=model), "_sums array<long>"))
    if len(sums):
        size = n_waves + 1
        table = sums.reshape(size, size + 1)
        gram = table[:, :size] + penalty * WAVE * WAVE * np.eye(size)
        model = _changed(model, weights=np.linalg.solve(gram, table[:, size]))
    held = (
        known.filter(F.col("_fold") == CALIBRATION).select("_y", "_f")
        .mapInArrow(partial(_ridge_bins, model=model), "_y int, _bin int")
        .groupBy("_bin").agg(F.sum("_y").alias("_ones"), F.count("*").alias("_n"))
        .orderBy("_bin").collect()
    )
    if held:
        bins, ones, counts = (np.array([r[i] for r in held], dtype=np.float64) for i in range(3))
        knots, values = isotonic((bins + 0.5) * (2 / BINS) - 0.5, ones, counts)
        model = _changed(model, knots=knots, values=values)
    return model


def _changed(model: KernelModel, **fields) -> KernelModel:
    return KernelModel(**{**model.__dict__, **fields})


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_column: str = "doc_id",
    text: str = "text",
    threshold: float = 0.3,
    n_waves: int = 256,
    width: float = 4.0,
    penalty: float = 0.1,
    seed: int = 7,
    with_text: bool = True,
    space: Workspace | None = None,
) -> DataFrame:
    """Every row with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    ``width`` is that of the Gaussian kernel over features scaled to deviation 1, ``penalty`` that
    of the ridge regression in labelled rows.
    """
    out = ("held_out", "score", "predicted")
    own = [c for c in docs.columns if c != text and c not in out]
    if with_text:
        own.append(text)
    space = space or Workspace(docs.sparkSession)
    # the columns travel under numbers, so that no name of theirs can clash with a name used here
    plain = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)],
        F.col(f"`{id_column}`").alias("_id"),
        F.col(f"`{text}`").alias("_text"),
    )
    ahead = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    measured = space.save(plain.mapInArrow(_measure, f"{ahead}, _f array<int>"), "features")
    model = fit(
        measured.select("_id", "_f"), labels, label, id_column, n_waves, width, penalty, seed, space
    )
    scored = measured.mapInArrow(partial(_scores, model=model), f"{ahead}, score double")
    return scored.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)],
        F.coalesce(fold_of(F.col("_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

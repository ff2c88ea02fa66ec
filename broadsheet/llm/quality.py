"""Quality classifier by co-training of a text-content view and a page-metadata view.

The content view sees what the text is made of: transitions between classes of bytes (letters, digits,
punctuation, separators) and how often words and lines repeat. The metadata view sees only what is known of a
page without reading it: its recorded length (in fine steps, and in coarse ones by language), language and source. Each
view is a logistic regression. In every round each view scores all unlabelled documents and hands those it is surest of,
labelled by itself with its probability, to the other's training set, where they stay: of each class the first by rank, if the view is at
least a quarter of the way from the prior to certainty (a view that knows little is never near it). After every round both views are calibrated on held-out labels and combined:
a document's log-odds are the prior's plus what each view adds to it, times a weight. Of the rounds (the one before any
exchange included) that with the least log loss on other held-out labels counts; the weights are those of the better view
alone, unless a mixture saves clearly more there, so that the combination is no worse than its better view.

Only the labelled sample (at most ``max_labelled`` rows, by hash of the key) and the pseudo-labels (at most
``grow`` per view, class and round, sought among ``rounds`` times as many) reach the driver, as short vectors. Features,
candidate search and scores cover all documents.

Defined results: null and empty texts, null language, source or length are feature values like others; labels that
are null or whose key has no document are ignored, repeated labels of a key count as their minimum; with labels
of fewer than two classes every document scores the share of good ones (0.5 without labels); rows that repeat
are scored alike; an empty table gives an empty result; extra columns pass through, but one named like the
result's column of scores is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.scratch import all_columns, materialize, unused

#: Bounds of what training takes: labelled rows, pseudo-labels (good, bad) a round and view, rounds.
MAX_LABELLED, GROW, ROUNDS = 6_000, (600, 150), 2
#: A view hands over documents whose label it puts at least so far from the prior to certainty.
CONFIDENT = 0.25
#: Weights of content and metadata that are tried.
WEIGHTS = ((1.0, 0.0), (1.0, 0.25), (1.0, 0.5), (1.0, 0.75), (1.0, 1.0), (0.0, 1.0))
#: Documents scoring below are rejected.
THRESHOLD = 0.5
#: Rows whose vectors a task unpacks at once.
SLICE = 500
_LENGTHS, _STEPS, _LANGS, _SOURCES, _NORMS = 16, 4, 16, 64, 64

#: Byte classes: lower, upper, digit, space, newline, each frequent mark by itself, other marks, beyond ASCII.
_MARKS = b".,!?|#$%&*-:;'\"/<>"
_CLASS = np.full(256, 5 + len(_MARKS), np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0D]] = 0, 1, 2, 3, 4
for _i, _b in enumerate(_MARKS):
    _CLASS[_b] = 5 + _i
_CLASS[0x80:] = 6 + len(_MARKS)
_N = 7 + len(_MARKS)


def content_features(text: str) -> np.ndarray:
    """Square roots of byte class and class transition shares, and word repetition."""
    data = text.encode("utf-8", "surrogatepass")
    c = _CLASS[np.frombuffer(data, np.uint8)]
    singles = np.bincount(c, minlength=_N) / max(len(c), 1)
    turns = c[1:] != c[:-1]
    pairs = np.bincount((c[:-1] * _N + c[1:])[turns], minlength=_N * _N) / max(int(turns.sum()), 1)
    words = data.split()
    n = len(words)
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in data.split(b"\n") if x.strip()]
    extra = [
        len(set(words)) / max(n, 1), twice / max(n - 1, 1), len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1),
        len(set(lines)) / max(len(lines), 1), min(len(data) / max(n, 1), 50) / 50, 1 / (1 + n),
    ]
    return np.concatenate([np.sqrt(singles), np.sqrt(pairs), extra]).astype(np.float16)


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """The length, and one-hot buckets of it (_STEPS to each of _LENGTHS), of language, of source, and of length by language."""
    out = np.zeros(2 + _LENGTHS * _STEPS + _LANGS + _SOURCES + _NORMS, np.float16)
    size = np.log1p(max(n_chars or 0, 0))
    out[:2] = [size / 10, n_chars is None]
    buckets = (
        (_LENGTHS * _STEPS, min(int(size * _STEPS), _LENGTHS * _STEPS - 1)), (_LANGS, xxhash.xxh32_intdigest(repr(lang))),
        (_SOURCES, xxhash.xxh32_intdigest(repr(source))), (_NORMS, xxhash.xxh32_intdigest(repr((lang, int(size * 2))))),
    )
    at = 2
    for number, bucket in buckets:
        out[at + bucket % number] = 1
        at += number
    return out


def _views(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    content = [content_features(t.as_py() or "") for t in texts]
    return content, [metadata_features(g.as_py(), s.as_py(), n.as_py()) for g, s, n in zip(langs, sources, sizes, strict=True)]


def features(text: Column, lang: Column, source: Column, n_chars: Column) -> Column:
    """struct<content binary, metadata binary> of half-precision vectors."""

    @F.arrow_udf(T.StructType().add("content", T.BinaryType()).add("metadata", T.BinaryType()))
    def extract(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> pa.Array:
        views = _views(texts, langs, sources, sizes)
        return pa.StructArray.from_arrays([pa.array([v.tobytes() for v in view], pa.binary()) for view in views], ["content", "metadata"])

    return extract(text, lang, source, n_chars.cast("long"))


@dataclass
class View:
    """A logistic regression on standardized features with Platt calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        slopes = self.weights / self.scale
        return x @ slopes + (self.bias - self.mean @ slopes)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


@dataclass
class Model:
    content: View | None
    metadata: View | None
    prior: float
    #: What a view's log-odds beyond the prior's count in the combination.
    skills: tuple[float, float] = (1.0, 1.0)
    #: The rounds of exchange before this fit, and the documents that each view handed over in them.
    rounds: int = 0
    handed: dict[str, int] | None = None

    def log_odds(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds of both views and of their combination."""
        prior = float(np.log(self.prior / (1 - self.prior)))
        if self.content is None:
            same = np.full(len(content), prior)
            return same, same, same
        a, b = self.content.log_odds(content), self.metadata.log_odds(metadata)
        return a, b, prior + self.skills[0] * (a - prior) + self.skills[1] * (b - prior)


def row_losses(log_odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, np.where(y > 0, -log_odds, log_odds))


def chosen_weights(losses: dict[tuple[float, float], np.ndarray]) -> tuple[float, float]:
    """The better view alone, unless a mixture saves more than a standard error of what it saves."""
    best = alone = min(((1.0, 0.0), (0.0, 1.0)), key=lambda w: losses[w].mean())
    for weights, found in losses.items():
        saved = losses[alone] - found
        if saved.mean() > saved.std() / np.sqrt(len(saved)) and found.mean() < losses[best].mean():
            best = weights
    return best


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights of ridge logistic regression; the last column of ``x`` is the constant, unpenalized."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray, ridge: float = 5.0) -> View:
    mean, scale = x.mean(0), x.std(0) + 0.02
    w = _newton(np.column_stack([(x - mean) / scale, np.ones(len(x))]), y, ridge)
    return View(mean, scale, w[:-1], float(w[-1]))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on held-out rows, with his smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    view.slope, view.shift = map(float, _newton(np.column_stack([view.raw(x), np.ones(len(x))]), target, 1e-3))
    if view.slope < 0:  # it has learnt nothing: the prior of these rows, whatever the document
        view.slope, view.shift = 0.0, float(np.log((good + 1) / (bad + 1)))


def _vectors(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float16) for v in column]).astype(np.float64)


_SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("content", "metadata", "quality")])


def _scores(model: Model, vectors: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """The probabilities by both views and their combination, of slices of feature vectors."""
    parts = [np.empty((3, 0)), *(np.stack(model.log_odds(*some)) for some in vectors)]
    return pa.StructArray.from_arrays([pa.array(p) for p in _sigmoid(np.concatenate(parts, axis=1))], _SCORES.names)


def _feature_scores(model: Model, content: Column, metadata: Column) -> Column:
    """struct<content, metadata, quality> of probabilities, from packed features."""

    @F.arrow_udf(_SCORES)
    def scores(contents: pa.Array, metadatas: pa.Array) -> pa.Array:
        lows = range(0, len(contents), SLICE)
        return _scores(model, (tuple(_vectors(c.slice(low, SLICE).to_pylist()) for c in (contents, metadatas)) for low in lows))

    return scores(content, metadata)


def _document_scores(model: Model, text: Column, lang: Column, source: Column, n_chars: Column) -> Column:
    """struct<content, metadata, quality> of probabilities, from the document itself."""

    @F.arrow_udf(_SCORES)
    def scores(*columns: pa.Array) -> pa.Array:
        lows = range(0, len(columns[0]), SLICE)
        views = (_views(*[c.slice(low, SLICE) for c in columns]) for low in lows)
        return _scores(model, (tuple(np.stack(v).astype(np.float64) for v in pair) for pair in views))

    return scores(text, lang, source, n_chars.cast("long"))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, grow: tuple[int, int] = GROW,
          rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the feature table (_key, _content, _metadata, _label) of all rows of ``docs``."""
    found = docs.select(F.col("doc_id").alias("_key"), features(*[F.col(c) for c in ("text", "lang", "source", "n_chars")]).alias("_f"))
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label"))
    joined = found.join(known, found["_key"] == known["doc_id"], "left")
    table = materialize(joined.select("_key", F.col("_f.content").alias("_content"), F.col("_f.metadata").alias("_metadata"), "_label"), "features")
    labelled = table.filter("_label IS NOT NULL")
    n, good = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0))).first()
    prior = min(max(good / n, 1e-6), 1 - 1e-6) if n else 0.5
    if not 0 < good < n:
        return Model(None, None, prior), table
    in_sample = F.pmod(F.xxhash64(F.lit("sample"), "_key"), F.lit(1 << 32)) < int(min(1.0, max_labelled / n) * (1 << 32))
    rows = labelled.filter(in_sample).orderBy("_key").limit(max_labelled).collect()
    part = np.array([xxhash.xxh32_intdigest(str(r["_key"])) % 8 for r in rows])
    y = np.array([float(r["_label"]) for r in rows])
    if not len(rows) or min(y.sum(), (1 - y).sum()) < 1:
        return Model(None, None, prior), table
    groups = [part > 1, part == 0, part == 1]  # taught, for calibration, for choices
    if any(len(set(y[g])) < 2 for g in groups):
        groups = [np.ones(len(rows), bool)] * 3  # too few labels to hold any out
    learn, adjust, choose = groups
    x = {"content": _vectors(r["_content"] for r in rows), "metadata": _vectors(r["_metadata"] for r in rows)}
    taught = {name: (x[name][learn], y[learn]) for name in x}
    handed = dict.fromkeys(x, 0)

    def fit(turn: int) -> tuple[float, Model]:
        """A model of what is taught so far, and its log loss on the labels for choices."""
        views = {name: fit_view(*taught[name]) for name in x}
        for name, view in views.items():
            calibrate(view, x[name][adjust], y[adjust])
        model = Model(views["content"], views["metadata"], prior, rounds=turn, handed=dict(handed))

        def losses(weights: tuple[float, float]) -> np.ndarray:
            model.skills = weights
            return row_losses(model.log_odds(x["content"][choose], x["metadata"][choose])[2], y[choose])

        model.skills = chosen_weights({w: losses(w) for w in WEIGHTS})
        return float(losses(model.skills).mean()), model

    fitted = [fit(0)]
    sure_good, sure_bad = prior + CONFIDENT * (1 - prior), prior - CONFIDENT * prior
    pool = table.filter("_label IS NULL")
    given: set = set()
    for turn in range(rounds):
        scored = pool.withColumn("_p", _feature_scores(fitted[-1][1], F.col("_content"), F.col("_metadata")))
        picks = None
        for teacher in x:
            p = F.col(f"_p.{teacher}")
            for label, count, sure, order in ((1.0, grow[0], p >= sure_good, p.desc()), (0.0, grow[1], p <= sure_bad, p.asc())):
                some = scored.filter(sure).orderBy(order, "_key").limit(count * (turn + 1))
                some = some.select("_key", "_content", "_metadata", F.lit(teacher).alias("_by"), F.lit(label).alias("_y"), p.alias("_sure"))
                picks = some if picks is None else picks.union(some)
        chosen, taken = [], dict.fromkeys([(teacher, label) for teacher in x for label in (1.0, 0.0)], 0)
        for r in picks.collect():
            kind = r["_by"], r["_y"]
            if (r["_key"], r["_by"]) not in given and taken[kind] < grow[r["_y"] == 0]:
                given.add((r["_key"], r["_by"]))
                taken[kind] += 1
                chosen.append(r)
        for teacher, pupil in (("content", "metadata"), ("metadata", "content")):
            own = [r for r in chosen if r["_by"] == teacher]
            handed[teacher] += len(own)
            if own:
                more = _vectors(r[f"_{pupil}"] for r in own), np.array([r["_sure"] for r in own])
                taught[pupil] = tuple(np.concatenate(pair) for pair in zip(taught[pupil], more, strict=True))
        fitted.append(fit(turn + 1))
    return min(fitted, key=lambda f: f[0])[1], table


def score(docs: DataFrame, model: Model, scores: str = "_scores") -> DataFrame:
    """``docs`` with ``scores``, a struct of the probabilities content, metadata and quality."""
    return docs.withColumn(scores, _document_scores(model, *[F.col(c) for c in ("text", "lang", "source", "n_chars")]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more."""
    model, _ = train(docs, labels, **options)
    scores = unused(docs.columns, "_scores")[0]
    return score(docs, model, scores).filter(F.col(f"{scores}.quality") >= threshold).select(*all_columns(docs))

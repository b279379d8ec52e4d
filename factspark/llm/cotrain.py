"""Quality classifier by co-training: a view of the text's content and a view of the page's metadata.

Each view is a logistic regression of its own, fitted on labelled documents. In each round both look at all unlabelled
documents: those that one view is confident about are pseudo-labelled, and the other learns from them how much each of
its own features speaks for a label, by counts over the whole corpus. That evidence is a figure that its regression then
weighs. At last both views are calibrated on labelled documents that neither has learnt from, and a document's score
combines the two calibrated views. All documents are scored.

Only labelled rows are sampled (LABELLED, by a hash of the id); the unlabelled side is the whole corpus, however large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import cut, discard, pieces, release, small_batches

LABELLED, ROUNDS = 20_000, 3
CONFIDENT, LEAST_DOCUMENTS, HELD_OUT = 0.97, 4, 5
BUCKETS, META_BUCKETS = 1 << 20, 1 << 12
#: Evidence is counted by the highest bits of a text bucket.
EVIDENCE_BITS = 16
_RANGE = 1 << 30
DENSE = ("signs", "marks", "bars", "repeats", "distinct", "length", "letters", "size")


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words of each text (row numbers and buckets), and dense figures of each text."""
    n = len(texts)
    words = textkit.Words(texts, textkit.LETTERS)
    row = np.repeat(np.arange(n, dtype=np.int64), words.counts())
    pairs = np.unique(row << 20 | (words.hashes >> np.uint64(44)).astype(np.int64))
    w = textkit.Words(texts, textkit.SPACED)
    count = np.maximum(w.counts(), 1).astype(np.float64)
    row = np.repeat(np.arange(n), w.counts())
    last = w.data[np.maximum(w.end - 1, 0)]
    share = lambda flags: np.bincount(row, flags, minlength=n) / count
    signs = share(np.isin(last, np.frombuffer(b"*#$%&@^~=", np.uint8)))
    marks = share(last == ord("!"))
    bars = share((w.end - w.begin == 1) & (last == ord("|")))
    again = np.zeros(len(w.hashes))
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((w.hashes, row))
    sorted_, of = w.hashes[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]) | (of[1:] != of[:-1])
    distinct = np.bincount(of[new], minlength=n) / count
    length = np.bincount(row, w.end - w.begin, minlength=n) / count
    letters = np.concatenate(([0], np.cumsum(textkit.LETTERS[w.data])))
    letters = (letters[w.offsets[1:]] - letters[w.offsets[:-1]]) / np.maximum(np.diff(w.offsets), 1)
    dense = np.stack([np.sqrt(signs), np.sqrt(marks), np.sqrt(bars), np.sqrt(share(again)), distinct, length / 10, letters, np.log1p(w.counts()) / 5], axis=1)
    return pairs >> 20, pairs & (BUCKETS - 1), dense


def metadata_features(lang: list, source: list, sizes: list) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and buckets of language, source, length class and their pairs."""
    out = []
    for x, y, n in zip(lang, source, sizes):
        size = int(n or 0).bit_length()
        out += [xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) % META_BUCKETS for k in (f"l{x}", f"s{y}", f"n{size}", f"l{x}|n{size}", f"l{x}|s{y}")]
    return np.repeat(np.arange(len(lang)), 5), np.array(out, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Linear:
    """Logistic regression over hashed presence and dense figures."""

    sparse: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def score(self, row: np.ndarray, bucket: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.sparse[bucket], minlength=n) + ((dense - self.mean) / self.scale) @ self.dense + self.bias


def fit(row: np.ndarray, bucket: np.ndarray, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, buckets: int, least: int = 1, l2: float = 0.3, steps: int = 120) -> Linear:
    """Full-batch gradient steps of adaptive size; a bucket of fewer than `least` documents has no weight."""
    n = len(y)
    common = np.flatnonzero(np.bincount(bucket, minlength=buckets) >= least)
    place = np.full(buckets, -1, np.int64)
    place[common] = np.arange(len(common))
    keep = place[bucket] >= 0
    row, at = row[keep], place[bucket[keep]]
    mean, scale = dense.mean(0), np.maximum(dense.std(0), 1e-3)
    z = (dense - mean) / scale
    p = np.clip((weight @ y) / weight.sum(), 1e-3, 1 - 1e-3)
    w, v, b = np.zeros(len(common)), np.zeros(dense.shape[1]), float(np.log(p / (1 - p)))
    sums = [np.full(len(common), 1e-8), np.full(dense.shape[1], 1e-8), 1e-8]
    for _ in range(steps):
        error = weight * (_sigmoid(np.bincount(row, w[at], minlength=n) + z @ v + b) - y)
        grads = [np.bincount(at, error[row], minlength=len(common)) + l2 * w, error @ z + l2 * v, error.sum()]
        sums = [s + g * g for s, g in zip(sums, grads)]
        w, v, b = (x - 0.4 * g / np.sqrt(s) for x, g, s in zip((w, v, b), grads, sums))
    full = np.zeros(buckets, np.float32)
    full[common] = w
    return Linear(full, v, mean, scale, float(b))


def _platt(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of columns of scores and a bias: logistic regression on softened labels, drawn to equal weights, by
    Newton steps that are halved until they help."""
    x = np.column_stack([np.clip(scores, -30, 30), np.ones(len(y))])
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    prior = np.append(np.full(scores.shape[1], 1.0 / scores.shape[1]), 0.0)
    ridge = np.append(np.full(scores.shape[1], 2.0), 0.01)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - goal @ z + ridge @ (w - prior) ** 2 / 2)

    w = prior.copy()
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (p - goal) + ridge * (w - prior))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


@dataclass
class View:
    """A regression and, for each evidence bucket, how much it speaks for the label by the other view's pseudo-labels."""

    model: Linear
    evidence: np.ndarray
    shift: int  # from feature buckets to evidence buckets

    def dense(self, row: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """The dense figures with the mean evidence of each document's features."""
        n = len(dense)
        mean = np.bincount(row, self.evidence[bucket >> self.shift], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)
        return np.column_stack([dense, mean])

    def score(self, row: np.ndarray, bucket: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
        return self.model.score(row, bucket, self.dense(row, bucket, dense), n)


@dataclass
class CoTrained:
    text: View
    meta: View
    calibration: tuple[np.ndarray, np.ndarray]  # of each view alone
    combination: np.ndarray
    exchanged: list[tuple[int, int]]  # labels that text, metadata gave in each round

    def score(self, text: tuple, meta: tuple, n: int) -> np.ndarray:
        """Calibrated probability of each document."""
        views = [self.text.score(*text, n), self.meta.score(*meta, np.zeros((n, 0)), n)]
        calibrated = np.column_stack([v * c[0] + c[1] for v, c in zip(views, self.calibration)])
        return _sigmoid(calibrated @ self.combination[:-1] + self.combination[-1])


@dataclass
class Constant:
    """Where labels are of one kind only: the share of ones, drawn to a half, for all documents."""

    share: float

    def score(self, text: tuple, meta: tuple, n: int) -> np.ndarray:
        return np.full(n, self.share)


def _take(row: np.ndarray, bucket: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of some documents, numbered anew in their order."""
    new = np.full(n, -1, np.int64)
    new[docs] = np.arange(len(docs))
    keep = new[row] >= 0
    return new[row[keep]], bucket[keep]


def _views(text: tuple, meta: tuple) -> list[tuple]:
    """Row numbers, buckets, dense figures, and number of buckets of each view."""
    return [(*text, BUCKETS), (*meta, np.zeros((len(text[2]), 0)), META_BUCKETS)]


def _evidence_size(buckets: int) -> tuple[int, int]:
    bits = min(EVIDENCE_BITS, buckets.bit_length() - 1)
    return 1 << bits, buckets.bit_length() - 1 - bits


def fit_views(text: tuple, meta: tuple, y: np.ndarray, evidence: list[np.ndarray] | None = None) -> list[View]:
    """Both views, fitted on documents labelled 1 or 0 (-1: not)."""
    out, docs = [], np.flatnonzero(y >= 0)
    for i, (row, bucket, dense, buckets) in enumerate(_views(text, meta)):
        size, shift = _evidence_size(buckets)
        view = View(None, np.zeros(size) if evidence is None else evidence[i], shift)
        figures = view.dense(row, bucket, dense)
        view.model = fit(*_take(row, bucket, docs, len(y)), figures[docs], y[docs].astype(float), np.ones(len(docs)), buckets, LEAST_DOCUMENTS)
        out.append(view)
    return out


def pseudo_counts(views: list[View], text: tuple, meta: tuple, n: int, confident: float) -> list[np.ndarray]:
    """For each view, how many documents that the other is confident about hold each evidence bucket: rows of counts for
    label 0 and label 1, whose last column has the number of documents."""
    data = _views(text, meta)
    p = [_sigmoid(v.score(row, bucket, dense, n)) for v, (row, bucket, dense, _) in zip(views, data)]
    out = []
    for me, other in ((0, 1), (1, 0)):
        size = len(views[me].evidence)
        counts = np.zeros((2, size + 1), np.int64)
        for label, sure in enumerate((p[other] <= 1 - confident, p[other] >= confident)):
            row, bucket = data[me][:2]
            counts[label, :size] = np.bincount(bucket[sure[row]] >> views[me].shift, minlength=size)
            counts[label, size] = sure.sum()
        out.append(counts)
    return out


def evidence_of(counts: np.ndarray) -> np.ndarray:
    """Log odds of a label for each bucket; nothing where a kind of label is missing."""
    held, docs = counts[:, :-1], counts[:, -1]
    if not docs.all():
        return np.zeros(held.shape[1])
    share = (held + 1) / (docs[:, None] + 2)
    return np.log(share[1] / share[0])


def combine(views: list[View], text: tuple, meta: tuple, y: np.ndarray, held_out: np.ndarray, exchanged: list[tuple[int, int]]) -> CoTrained:
    """Views calibrated, alone and together, on the labelled documents of held_out (on all if those are under ten)."""
    test = np.flatnonzero((y >= 0) & held_out)
    if len(test) < 10:
        test = np.flatnonzero(y >= 0)
    truth = y[test].astype(float)
    raw = [v.score(row, bucket, dense, len(y))[test] for v, (row, bucket, dense, _) in zip(views, _views(text, meta))]
    calibration = tuple(_platt(r[:, None], truth) for r in raw)
    calibrated = np.column_stack([r * c[0] + c[1] for r, c in zip(raw, calibration)])
    return CoTrained(views[0], views[1], calibration, _platt(calibrated, truth), exchanged)


@dataclass
class Classifier:
    heads: dict[str, CoTrained | Constant]

    def score(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """Probabilities by target; batch has columns text, lang and source."""
        text = text_features(batch.column("text"))
        meta = metadata_features(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _sizes(batch))
        return {name: head.score(text, meta, batch.num_rows) for name, head in self.heads.items()}


def _sizes(batch: pa.RecordBatch) -> list:
    import pyarrow.compute as pc

    return pc.utf8_length(batch.column("text")).to_pylist()


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, place (a hash of it) and both views' features of every row."""
    schema = "doc_id long, place long, buckets array<int>, dense array<float>, meta array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                row, bucket, dense = text_features(part.column("text"))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                meta = metadata_features(part.column("lang").to_pylist(), part.column("source").to_pylist(), _sizes(part))[1]
                lists = lambda v, o, t: pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, t))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("place"), lists(bucket, ends, pa.int32()), lists(dense.ravel(), np.arange(part.num_rows + 1) * len(DENSE), pa.float32()), lists(meta, np.arange(part.num_rows + 1) * 5, pa.int32())],
                    [x.split()[0] for x in schema.split(", ")],
                )

    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(_RANGE))
    return docs.select("doc_id", place.alias("place"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).mapInArrow(run, schema)


def _unpacked(found: pa.RecordBatch | pa.Table) -> tuple[tuple, tuple]:
    """Both views' features of rows of `_features`."""
    n = found.num_rows

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = found.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.repeat(np.arange(n), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy()

    row, bucket = flat("buckets")
    meta = flat("meta")
    return (row, bucket.astype(np.int64), flat("dense")[1].astype(np.float64).reshape(n, len(DENSE))), (meta[0], meta[1].astype(np.int64))


def train(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), labelled: int = LABELLED, rounds: int = ROUNDS, confident: float = CONFIDENT) -> Classifier:
    """Co-train a classifier for each target column (0 or 1; null: no label) of labels.

    docs: doc_id, text, lang, source. Labels without id or of unknown documents are ignored; of several label rows of an
    id the largest values count; rows of one id are documents with one label. About `labelled` labelled rows are fitted
    on, those whose id's hash is lowest; all other documents are unlabelled. A target whose labels are of one kind only,
    or none, gives every document the share of ones, drawn to a half.
    """
    spark = docs.sparkSession
    small_batches(spark)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)), F.lit(_RANGE))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(t).cast("int").alias(t) for t in targets))
    reach = int(_RANGE * min(1.0, labelled / max(marks.count(), 1)))
    features = cut(_features(docs), "features")
    some = features.where(F.col("doc_id").isNotNull() & (F.col("place") < reach)).join(F.broadcast(marks.where(place < reach)), "doc_id")
    found = some.toArrow().combine_chunks().sort_by([("place", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    text, meta = _unpacked(found)
    held_out = found["place"].to_numpy() % HELD_OUT == 0
    ids = np.unique(found["doc_id"].to_numpy())
    labels_of = {t: found[t].fill_null(-1).to_numpy().astype(np.int64) for t in targets}
    del found
    release()
    open_ = [t for t in targets if {0, 1} <= set(labels_of[t][~held_out].tolist())]
    known = {t: np.where(held_out, -1, labels_of[t]) for t in open_}
    views = {t: fit_views(text, meta, known[t]) for t in open_}
    exchanged: dict[str, list[tuple[int, int]]] = {t: [] for t in open_}
    for _ in range(rounds if open_ else 0):
        counts = _all_counts(features, views, ids, confident)
        for t in open_:
            exchanged[t].append(tuple(int(counts[t][i][:, -1].sum()) for i in (1, 0)))
            views[t] = fit_views(text, meta, known[t], [evidence_of(c) for c in counts[t]])
        release()
        if not any(any(x[-1]) for x in exchanged.values()):
            break
    discard(spark, features)
    heads: dict = {}
    for t in targets:
        y = labels_of[t]
        heads[t] = combine(views[t], text, meta, y, held_out, exchanged[t]) if t in open_ else Constant(float(((y == 1).sum() + 1) / ((y >= 0).sum() + 2)))
    del text, meta, views
    release()
    return Classifier(heads)


def _all_counts(features: DataFrame, views: dict[str, list[View]], ids: np.ndarray, confident: float) -> dict[str, list[np.ndarray]]:
    """pseudo_counts of each target over all documents but those with these ids, added up where the documents are."""
    shared = features.sparkSession.sparkContext.broadcast((views, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, known = shared.value
        sums = {t: [np.zeros((2, len(v.evidence) + 1), np.int64) for v in both] for t, both in models.items()}
        for batch in batches:
            batch = batch.filter(pa.array(~np.isin(batch.column("doc_id").fill_null(-1).to_numpy(), known) | batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)))
            text, meta = _unpacked(batch)
            for t, both in models.items():
                for total, new in zip(sums[t], pseudo_counts(both, text, meta, batch.num_rows, confident)):
                    total += new
        for number, t in enumerate(models):
            for view, total in enumerate(sums[t]):
                label, bucket = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(bucket * 8 + number * 4 + view * 2 + label), pa.array(total[label, bucket])], ["key", "n"])

    if len(views) > 2:
        raise ValueError("two targets at most")
    found = features.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    shared.unpersist()
    key, n = found["key"].to_numpy(), found["n"].to_numpy()
    out = {t: [np.zeros((2, len(v.evidence) + 1), np.int64) for v in both] for t, both in views.items()}
    for number, t in enumerate(views):
        for view, total in enumerate(out[t]):
            mine = (key & 6) == number * 4 + view * 2
            total[key[mine] & 1, key[mine] >> 3] = n[mine]
    return out


def _scored(docs: DataFrame, model: Classifier, columns: list[str], schema, emit) -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield emit(part, shared.value.score(part))

    return docs.select(*columns).mapInArrow(run, schema)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id and p_<target> of every row; null texts and metadata are scored as they are."""
    names = list(model.heads)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def emit(part: pa.RecordBatch, found: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[t]) for t in names)], ["doc_id", *(f"p_{t}" for t in names)])

    return _scored(docs, model, ["doc_id", "text", "lang", "source"], f"doc_id {kind}, " + ", ".join(f"p_{t} double" for t in names), emit)


def accepted(p: dict[str, np.ndarray]) -> np.ndarray:
    """Bad quality and toxicity are both no likelier than not."""
    return (p["quality"] >= 0.5) & (p["toxic"] <= 0.5)


def keep_accepted(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier accepts."""
    return _scored(docs, model, docs.columns, docs.schema, lambda part, p: part.filter(pa.array(accepted(p))))

"""Toxicity by a convolutional text classifier, trained in numpy.

A word is embedded as the sum of two hashed tables, one by the word and one by its first ``STEM`` letters
(so inflected forms that training never saw are known), filters of widths 1 to 3 slide over the whole text,
each filter's maximum over the text is kept, and a logistic layer reads the maxima. One embedding
dimension starts as the shrunken log odds of its bucket, the rest small and random; buckets that training
never saw stay zero, so unknown words are inert. The logit is shifted so that the global threshold is
0.3. The shift and the thresholds by language come from counts of (language, score bin, label) over all labelled
rows, those that were fitted left out; they fall back to all rows, then to the global threshold, where toxic rows are
few. Thresholds by language decide only ``rejected``, never the score.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.3
TRAIN_ROWS = 4000  # bound of the labelled sample that is fitted on the driver
BUCKETS = 1 << 17
STEM = 4
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 6
BATCH = 64
RATE = 0.05
LEAST_POSITIVE = 25  # labelled toxic rows that a language needs for its own threshold
WORD = re.compile(r"[^\W_]+")
CACHE = 300_000
SLICE = 100_000  # words embedded at once
BINS = 64  # score bins of one unit of the logit, for calibration
WIDEST = 40  # logits beyond this are in the last bin


def _bucket(part: str) -> int:
    h = int.from_bytes(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return 1 + h % (BUCKETS - 1)


class _Buckets(dict):
    """word -> two bucket numbers in one integer; bucket 0 is kept for padding."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = _bucket(word) << 32 | _bucket(word[:STEM])
        return found


_BUCKETS = _Buckets()
PAD = max(WIDTHS) - 1


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both bucket numbers of all words, each text padded, and where each text starts."""
    parts = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    get = _BUCKETS.__getitem__
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        own = np.zeros(len(words) + PAD + 1, dtype=np.int64)
        own[: len(words)] = np.fromiter(map(get, words), np.int64, len(words))
        parts += [(own >> 32).astype(np.int32), (own & 0xFFFFFFFF).astype(np.int32)]
        starts[i + 1] = starts[i] + len(own)
    none = np.zeros(0, np.int32)
    return np.concatenate(parts[0::2] or [none]), np.concatenate(parts[1::2] or [none]), starts


@dataclass
class Model:
    """Weights, the shift that puts the threshold at 0.3, and thresholds by language."""

    e1: np.ndarray
    e2: np.ndarray
    filters: list[np.ndarray]  # one (width, DIM, FILTERS) for each width
    bias: np.ndarray  # (len(WIDTHS), FILTERS)
    out: np.ndarray
    base: float
    shift: float = 0.0
    by_lang: dict[str, float] = field(default_factory=dict)

    def maps(self, e: np.ndarray) -> list[np.ndarray]:
        """Each width's responses at every position; positions past the end are padding."""
        n = len(e) - PAD
        return [sum(e[j : n + j] @ w[j] for j in range(len(w))) + b for w, b in zip(self.filters, self.bias, strict=True)]

    def logits(self, h1: np.ndarray, h2: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Logits of all texts, some at a time."""
        out, begin = [np.zeros(0)], 0
        while begin < len(starts) - 1:
            end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + SLICE, "right")) - 1)
            lo, hi = starts[begin], starts[end]
            out.append(self._logits(h1[lo:hi], h2[lo:hi], starts[begin : end + 1] - lo))
            begin = end
        return np.concatenate(out)

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """Logits of texts, encoded some at a time; null is the empty text."""
        z = np.zeros(len(texts))
        begin, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > 1_500_000 or i + 1 == len(texts):
                z[begin : i + 1] = self.logits(*encode([x or "" for x in texts[begin : i + 1]]))
                begin, size = i + 1, 0
        return z

    def _logits(self, h1: np.ndarray, h2: np.ndarray, starts: np.ndarray) -> np.ndarray:
        e = self.e1[h1] + self.e2[h2]
        e = np.concatenate([e, np.zeros((PAD, DIM), dtype=np.float32)])
        spans = np.stack([starts[:-1], starts[1:] - PAD], axis=1).ravel()  # the last windows would reach into the next text
        pooled = np.concatenate([np.maximum.reduceat(m, spans)[::2] for m in self.maps(e)], axis=1)
        return np.maximum(pooled, 0) @ self.out + self.base


def train(texts: list[str], labels: np.ndarray, seed: int = 11) -> Model:
    """Fit on labelled texts; without both labels among them every score is 0."""
    rng = np.random.default_rng(seed)
    e1, e2 = np.zeros((2, BUCKETS, DIM), dtype=np.float32)
    filters = [(rng.normal(0, 0.3, (w, DIM, FILTERS)) / w).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0, : FILTERS // 2] = 1.0 / len(w)
    bias = np.zeros((len(WIDTHS), FILTERS), dtype=np.float32)
    out = np.full(len(WIDTHS) * FILTERS, 0.2, dtype=np.float32)
    model = Model(e1, e2, filters, bias, out, -2.0)
    if not len(labels) or labels.min() == labels.max():
        model.out[:] = 0
        model.base = -100.0
        return model
    h1, h2, starts = encode(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    texts = None
    prior = np.log(labels.mean() / (1 - labels.mean()))
    for table, h in ((e1, h1), (e2, h2)):
        seen = np.unique(row * BUCKETS + h)
        positive = labels[seen // BUCKETS] > 0.5
        yes = np.bincount((seen % BUCKETS)[positive], minlength=BUCKETS)
        no = np.bincount((seen % BUCKETS)[~positive], minlength=BUCKETS)
        odds = np.log((yes + 4 * labels.mean()) / (no + 4 * (1 - labels.mean()))) - prior
        used = yes + no > 0
        table[used] = rng.normal(0, 0.02, (used.sum(), DIM))
        table[used, 0] = odds[used] * 0.5
        table[0] = 0
    del row, seen
    sums = [np.full_like(x, 1e-3) for x in (e1, e2, *filters, bias, out)]
    base_sum = 1e-3
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            lengths = starts[docs + 1] - starts[docs]
            local = np.r_[0, np.cumsum(lengths)]
            where = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs])
            b1, b2 = h1[where], h2[where]
            e = np.concatenate([e1[b1] + e2[b2], np.zeros((PAD, DIM), dtype=np.float32)])
            b1, b2 = np.r_[b1, [0] * PAD], np.r_[b2, [0] * PAD]
            maps = model.maps(e)
            tops = [np.stack([a + m[a : b - PAD].argmax(0) for a, b in zip(local[:-1], local[1:], strict=True)]) for m in maps]
            pooled = [np.take_along_axis(m, t, 0) for m, t in zip(maps, tops, strict=True)]
            z = np.concatenate(pooled, axis=1)
            p = 1 / (1 + np.exp(-np.clip(np.maximum(z, 0) @ out + model.base, -30, 30)))
            g = ((p - labels[docs]) / len(docs)).astype(np.float32)
            d_out = np.maximum(z, 0).T @ g
            d_z = g[:, None] * out[None, :] * (z > 0)
            grads, d_bias = [], np.zeros_like(bias)
            rows1, rows2, values = [], [], []
            for k, width in enumerate(WIDTHS):
                dz = d_z[:, k * FILTERS : (k + 1) * FILTERS]
                d_bias[k] = dz.sum(0)
                d_w = np.zeros_like(filters[k])
                for j in range(width):
                    place = tops[k] + j
                    d_w[j] = np.einsum("bfd,bf->df", e[place], dz)
                    rows1.append(b1[place].ravel())
                    rows2.append(b2[place].ravel())
                    values.append((dz[:, :, None] * filters[k][j].T[None]).reshape(-1, DIM))
                grads.append(d_w)
            values = np.concatenate(values)
            for x, s, d in ((out, sums[-1], d_out), (bias, sums[-2], d_bias), *zip(filters, sums[2:-2], grads, strict=True)):
                s += d * d
                x -= RATE * d / np.sqrt(s)
            base_sum += g.sum() ** 2
            model.base -= RATE * g.sum() / base_sum**0.5
            for table, s, rows in ((e1, sums[0], np.concatenate(rows1)), (e2, sums[1], np.concatenate(rows2))):
                touched, place = np.unique(rows, return_inverse=True)
                d = np.zeros((len(touched), DIM), dtype=np.float32)
                np.add.at(d, place, values)
                d[touched == 0] = 0
                s[touched] += d * d
                table[touched] -= RATE * d / np.sqrt(s[touched])
    return model


def best_cut(bins: np.ndarray, rows: np.ndarray, hits: np.ndarray, near: int = 0) -> int:
    """The lower edge of a bin that gives the best F1 over counts by bin: ``near`` if it does, else the nearest to it midway between bins."""
    bins, place = np.unique(bins, return_inverse=True)
    rows, hits = np.bincount(place, rows)[::-1], np.bincount(place, hits)[::-1]
    bins = bins[::-1]
    f1 = 2 * np.cumsum(hits) / (np.cumsum(rows) + hits.sum())
    cuts = (bins + np.r_[bins[1:], bins[-1] - BINS] + 1) // 2
    above = bins >= near
    own = 2 * hits[above].sum() / max(1, rows[above].sum() + hits.sum())
    if own >= f1.max() - 1e-12:
        return near
    best = cuts[f1 >= f1.max() - 1e-12]
    return int(best[np.argmin(np.abs(best - near))])


def calibrate(model: Model, docs: DataFrame, known: DataFrame, fitted: DataFrame) -> None:
    """Set the shift and the thresholds by language from the counts of all ``known`` (doc_id, label) rows.

    ``docs`` has doc_id, text and lang. Rows of a bounded number of bins come to the driver for each language
    that has ``LEAST_POSITIVE`` toxic rows. Of repeated ids one row counts, as in the fit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            z = m.of_texts(batch.column(1).to_pylist())
            bins = np.clip(np.floor(z * BINS), -WIDEST * BINS, WIDEST * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bins)], names=["doc_id", "lang", "bin"])

    source = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("bin", T.IntegerType())])
    scored = source.mapInArrow(run, schema).groupBy("doc_id").agg(F.min(F.struct("bin", "lang")).alias("s"))
    one = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    marked = one.join(F.broadcast(fitted.select("doc_id", F.lit(True).alias("fitted")).distinct()), "doc_id", "left")
    met = marked.join(scored, "doc_id").select("s.lang", "s.bin", "label", F.col("fitted").isNotNull().alias("fitted"))
    counts = met.groupBy("lang", "bin", "fitted").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).persist()
    columns = lambda df: [df[k].to_numpy(zero_copy_only=False) for k in ("bin", "fitted", "n", "hits")]

    def chosen(bins, fitted, n, hits, near):
        free = ~fitted
        if hits[free].sum() >= LEAST_POSITIVE:
            bins, n, hits = bins[free], n[free], hits[free]
        return best_cut(bins, n, hits, near)

    try:
        total = counts.groupBy("bin", "fitted").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow()
        if not total.num_rows:
            return
        cut = chosen(*columns(total), 0)
        model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut / BINS)
        large = counts.groupBy("lang").agg(F.sum("hits").alias("hits")).filter((F.col("hits") >= LEAST_POSITIVE) & F.col("lang").isNotNull()).select("lang")
        by_lang = counts.join(large, "lang", "left_semi").toArrow().combine_chunks()
    finally:
        counts.unpersist()
        shared.unpersist()
    for lang in sorted(set(by_lang["lang"].to_pylist())):
        own = by_lang.filter(pc.equal(by_lang["lang"], lang))
        model.by_lang[lang] = float(1 / (1 + np.exp(-(chosen(*columns(own), cut) / BINS + model.shift))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Train on at most ``rows`` of ``labels`` (doc_id, label), those whose hashed id is least; calibrate on all.

    Null ids, null labels and labels without a document are passed over; of rows that repeat an id the one with
    the least label, then the least text, is fitted. Very long texts are read whole.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).select("doc_id", (F.col("label") > 0).cast("int").alias("label")).distinct()
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string")), "label").limit(rows)
    texts = docs.select("doc_id", "text", "lang") if "lang" in docs.columns else docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("s")).select("doc_id", "s.text", "s.label").toArrow().sort_by("doc_id")
    columns = [found.column(c).to_pylist() for c in ("text", "label")]
    del found
    fitted = np.array(columns[1], dtype=np.float64)
    model = train([t or "" for t in columns[0]], fitted)
    if len(fitted) and fitted.min() != fitted.max():
        calibrate(model, texts, known, sample)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) and ``rejected`` (score reaches the threshold of its language) to ``docs``.

    A null text is the empty text, which has a score; a null or unknown language has the global
    threshold; a very long text is read whole, in slices; repeated rows are scored each; columns of these names
    are replaced; an empty table gives an empty table.
    """
    docs = docs.drop("score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    lang_at = docs.columns.index("lang") if "lang" in docs.columns else None
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            z = m.of_texts(batch.column(at).to_pylist()) + m.shift
            scores = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * len(z)
            cuts = np.array([m.by_lang.get(x, THRESHOLD) for x in langs])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(scores >= cuts, pa.bool_())], names=schema.names)

    return docs.mapInArrow(run, schema)

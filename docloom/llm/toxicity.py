"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j): the pair term learns that two
terms together mean more than each alone, such as an insult with the mention of a group. Terms are a
document's distinct words and word beginnings, hashed into buckets; x is how rare the bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, collect_driver, filter_rows, give_back, small_batches, text_rows
from .decontaminate import _BASE, _CHUNK, _VALUE, _WORD, _mix, _power

_U = np.uint64
#: The driver gets what it learns from in so many parts, one after the other.
PARTS = 16
#: Terms that are counted and renumbered at once.
_PART = 1 << 18


@dataclass(frozen=True)
class Settings:
    """What training may use; every bound is stated here."""

    toxic_rows: int = 4_000  #: most labelled rows of label 1 that a model is fitted on
    other_rows: int = 12_000  #: most labelled rows of label 0
    text_bytes: int = 32 << 20  #: most bytes of text that these rows may hold, a half for each label
    bucket_bits: int = 20
    prefixes: tuple[int, ...] = (3, 4, 5, 6)  #: bytes of a word's beginnings that are terms, too
    factors: int = 4
    epochs: int = 6  #: at least; small tables are gone through until there were `steps` batches
    steps: int = 500
    toxic_weight: float = 3.0  #: of an error on a row of label 1
    rate: float = 0.5
    least_pull: float = 2.0  #: a weight leaves its start once the errors of its rows add up to more than so many rows in a pass (an L1 penalty)
    pair_rate: float = 0.5
    least_pair_pull: float = 0.5  #: the same for factors, whose errors are weighted by the row's other factors
    spread: float = 0.03  #: of factors at the start
    seed: int = 7


def term_buckets(data: bytes, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first byte of its word) of every term of the text, repeats included."""
    raw = np.frombuffer(data, np.uint8)
    buckets, firsts, at = [], [], 0
    shift = _U(64 - settings.bucket_bits)
    inverse = pow(_BASE, -1, 1 << 64)
    while at < len(raw):
        end = min(len(raw), at + _CHUNK)
        while end < len(raw) and _WORD[raw[end]] and _WORD[raw[end - 1]]:
            end += 1
        word = _WORD[raw[at:end]]
        edge = np.diff((word > 0).view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(_VALUE[word] * _power(_BASE, len(word)), out=sums[1:])
        unshift = _power(inverse, len(word) + 1)
        buckets.append(_mix((sums[ends] - sums[starts]) * unshift[starts]) >> shift)
        firsts.append(starts + at)
        for k in settings.prefixes:
            longer = starts[ends - starts > k]
            buckets.append(_mix((sums[longer + k] - sums[longer]) * unshift[longer] + _U(k)) >> shift)
            firsts.append(longer + at)
        at = end
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(firsts)


def _distinct(texts: list[bytes | None], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket), each pair once, in order of rows."""
    starts = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    buckets, firsts = term_buckets(b"\n".join(t or b"" for t in texts), settings)
    row = np.searchsorted(starts, firsts, "right") - 1
    both = np.unique((row << 32) | buckets)
    return both >> 32, both & 0xFFFFFFFF


@dataclass
class Model:
    """Weights of every bucket; those of buckets that training has not seen are 0, and are not sent with it."""

    settings: Settings
    x: np.ndarray  # value of each bucket in a row that has it
    bias: float
    w: np.ndarray
    v: np.ndarray

    def __getstate__(self) -> tuple:
        used = np.flatnonzero((self.x != 0) | (self.w != 0) | self.v.any(axis=1)).astype(np.int32)
        return self.settings, self.bias, used, self.x[used], self.w[used], self.v[used]

    def __setstate__(self, state: tuple) -> None:
        self.settings, self.bias, used, *given = state
        self.x, self.w, self.v = (np.zeros((1 << self.settings.bucket_bits, *a.shape[1:]), a.dtype) for a in given)
        for all_of, a in zip((self.x, self.w, self.v), given, strict=True):
            all_of[used] = a

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        row, bucket = _distinct(texts, self.settings)
        return 1 / (1 + np.exp(-np.clip(margins(row, bucket, len(texts), self.x, self.bias, self.w, self.v)[0], -40, 40)))


def margins(row: np.ndarray, bucket: np.ndarray, n: int, x: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds of each of n rows, sums of their factors); rows are in order."""
    value = x[bucket]
    first = np.searchsorted(row, np.arange(n + 1))
    filled = np.flatnonzero(np.diff(first))
    linear, total, pairs = np.zeros(n), np.zeros((n, v.shape[1])), np.zeros(n)
    if len(filled):
        at = first[filled]
        part = v[bucket] * value[:, None]
        linear[filled] = np.add.reduceat(w[bucket] * value, at)
        total[filled] = np.add.reduceat(part, at, axis=0)
        pairs[filled] = (total[filled] ** 2).sum(1) - np.add.reduceat((part * part).sum(1), at)
    return bias + linear + 0.5 * pairs, total


def fit(rows: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """A model of all buckets from each row's distinct buckets and its label; a constant one below 0.5 where there is one label only, or none."""
    lengths = np.array([len(r) for r in rows], np.int64)
    return fit_in_place(np.concatenate([np.zeros(0, np.uint32), *rows]).astype(np.uint32, copy=False), np.cumsum(lengths) - lengths, lengths, labels, settings)


def fit_in_place(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray, labels: np.ndarray, settings: Settings) -> Model:
    """The same of rows whose buckets (32 bits, unsigned) are lengths[i] from flat[first[i]] on; flat is overwritten, for it is most of what the driver holds."""
    n, toxic, size = len(labels), int(labels.sum()), 1 << settings.bucket_bits
    if toxic in (0, n):
        return Model(settings, np.zeros(size, np.float32), -3.0, np.zeros(size, np.float32), np.zeros((size, 1), np.float32))
    parts = [flat[at : at + _PART] for at in range(0, len(flat), _PART)]
    seen = np.zeros(size, np.int64)
    for part in parts:
        seen += np.bincount(part, minlength=size)
    used = np.flatnonzero(seen)
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    feature = flat.view(np.int32)
    for part in parts:
        part[:] = place[part]
    x = (np.log((n + 1) / (seen[used] + 1)) / np.log(n + 1)).astype(np.float32)
    del seen, place

    rng = np.random.default_rng(settings.seed)
    k, m, share = settings.factors, max(1, len(used)), toxic / n
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(m, np.float32), rng.normal(0, settings.spread, (m, k)).astype(np.float32)
    start, pulled_w, pulled_v = v.copy(), np.zeros(m, np.float32), np.zeros((m, k), np.float32)
    sum_w, sum_v, sum_b = np.full(m, 1e-6, np.float32), np.full((m, k), 1e-6, np.float32), 1e-6
    batch_rows = 128

    def lead(pulled: np.ndarray, squares: np.ndarray, at: np.ndarray, g: np.ndarray, now: np.ndarray, rate: float, least: float) -> np.ndarray:
        """Follow the regularised leader: how far weights are from their start after another gradient."""
        before = np.sqrt(squares[at])
        squares[at] += g * g
        root = np.sqrt(squares[at])
        pulled[at] += g - (root - before) / rate * now
        beyond = np.abs(pulled[at]) - least * passes
        return -np.sign(pulled[at]) * np.maximum(beyond, 0) * rate / (1 + root)

    passes = max(settings.epochs, -(-settings.steps * batch_rows // n))
    weight = np.where(labels > 0, settings.toxic_weight, 1.0)
    for _ in range(passes):
        order = rng.permutation(n)
        for at in range(0, n, batch_rows):
            batch = order[at : at + batch_rows]
            many = lengths[batch]
            own = np.repeat(np.arange(len(batch)), many)
            f = feature[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[batch], many)]
            margin, total = margins(own, f, len(batch), x, bias, w, v)
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[batch]) * weight[batch]
            by_feature = np.argsort(f, kind="stable")  # the batch's terms, those of one bucket together
            f, own = f[by_feature], own[by_feature]
            starts = np.flatnonzero(np.diff(f, prepend=-1))
            if len(f):
                touched, push = f[starts], (error[own] * x[f]).astype(np.float32)
                g = np.add.reduceat(push, starts)
                w[touched] = lead(pulled_w, sum_w, touched, g, w[touched], settings.rate, settings.least_pull)
                pull = push[:, None] * (total[own].astype(np.float32) - v[f] * x[f][:, None])
                g = np.add.reduceat(pull, starts, axis=0)
                v[touched] = start[touched] + lead(pulled_v, sum_v, touched, g, v[touched] - start[touched], settings.pair_rate, settings.least_pair_pull)
            g = error.mean()
            sum_b += g * g
            bias -= settings.rate * g / np.sqrt(sum_b)
    out = Model(settings, np.zeros(size, np.float32), float(bias), np.zeros(size, np.float32), np.zeros((size, k), np.float32))
    out.x[used], out.w[used], out.v[used] = x, w[: len(used)], v[: len(used)]
    return out


def held_out(doc_id: str = "doc_id"):
    """Rows that no label may be learnt from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text, toxic): labelled documents outside the held-out fold, a bounded sample by a hash of the id.

    A document with several labels is toxic if one of them says so; null labels and ids say nothing.
    Rows that repeat an id and its text are one. The sample is cut twice, so that both what is
    broadcast and what is learnt from is bounded by the settings: ids by their number, then the rows
    that these ids have by their number and their texts' bytes. A row whose text does not fit into what
    is left of its label's bytes is passed over.
    """
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(settings.seed)), F.col("doc_id")]
    toxic = known.where("toxic = 1").orderBy(*order).limit(settings.toxic_rows)
    other = known.where("toxic = 0").orderBy(*order).limit(settings.other_rows)
    texts = as_binary(docs).withColumn("text_hash", F.xxhash64("text"))
    sizes = texts.select("doc_id", "text_hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    sized = sizes.join(F.broadcast(toxic.unionByName(other)), "doc_id").groupBy("doc_id", "text_hash", "toxic").agg(F.max("size").alias("size"))
    chosen = []
    for label, most in ((1, settings.toxic_rows), (0, settings.other_rows)):
        left = settings.text_bytes // 2
        for row in sized.where(F.col("toxic") == label).orderBy(*order, "text_hash").limit(most).collect():  # four numbers from each of a bounded number of rows
            if row["size"] <= left:  # a row that does not fit is passed over, and not those after it
                left -= row["size"]
                chosen.append((row["doc_id"], row["text_hash"], label))
    mine = docs.sparkSession.createDataFrame(chosen, "doc_id long, text_hash long, toxic int")
    return texts.join(F.broadcast(mine), ["doc_id", "text_hash"]).select("doc_id", "text", "toxic", "text_hash")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Terms are made on the executors; the driver gets each sampled row's buckets and fits the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 18):
            row, bucket = _distinct(text_rows(batch), settings)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [bucket[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(packed, pa.binary())], ["doc_id", "toxic", "text_hash", "buckets"])

    rows = training_rows(docs, labels, settings).mapInArrow(run, "doc_id long, toxic int, text_hash long, buckets binary")
    flat, ids, toxic, lengths = bytearray(), [], [], []
    for row in rows.dropDuplicates(["doc_id", "text_hash"]).repartition(PARTS).toLocalIterator():
        flat += row["buckets"]
        ids.append((row["doc_id"], row["text_hash"]))
        toxic.append(row["toxic"])
        lengths.append(len(row["buckets"]) // 4)
    by = np.array(sorted(range(len(ids)), key=ids.__getitem__), np.int64)  # not the order in which rows happen to come
    size = np.array(lengths, np.int64)
    del ids, lengths
    collect_driver(docs.sparkSession)  # the driver's Python has most while it fits, and its JVM nothing to do
    model = fit_in_place(np.frombuffer(flat, "<u4"), (np.cumsum(size) - size)[by], size[by], np.array(toxic, float)[by], settings)
    del flat
    give_back()
    return model


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text).

    Null and empty texts get the score of a text without terms; equal texts get equal scores, and a
    score of exactly 0.5 is predicted 1. A row with a null doc_id is scored and is not held out. An
    empty table gives no rows. Without labels, or with one label only, nothing can be told apart and
    all scores are one prior below 0.5.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 18):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(text_rows(batch)))], ["doc_id", "score"])

    scored = as_binary(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold; all of them where labels tell nothing."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, settings))
    return filter_rows(docs, lambda texts: model.value.scores(texts) < threshold)

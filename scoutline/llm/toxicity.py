"""A toxicity classifier that is indifferent to which group a text mentions.

Logistic regression on the presence of words.  For each labelled text counterfactuals are made: its
identity terms are swapped for others, and a term is put into texts without one.  The loss has a
term for the squared change of the logit between a text and its counterfactual, so that a mention of a
group moves no score, whatever the labels of texts that mention it.

The model is fitted on the driver from a bounded sample of labelled rows: at most ``sample`` of each label, in
the order of a hash of the id, of whole texts of at most ``sample_bytes`` each.  Only hashes of those words travel that
MIN_TEXTS of these texts or more have.  So the driver holds at most 2 * sample * sample_bytes / 2 hashes, however large the
table is.  Scoring covers every whole text.

Edge cases: a null or empty text has no words and gets the score of the intercept; labels without a
value, of missing documents or of a single kind are coped with (one kind gives that kind's base rate);
several labels of an id count as toxic if one is; of several texts of an id the first in byte order is fitted; repeated rows are scored each; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm.common import WordHasher, slices, string_buffers, word_hash, written

#: Words that name groups of people; a parameter of ``fit``.
IDENTITY_TERMS = tuple(
    "women men woman man girls boys muslim muslims christian christians jewish jews hindu hindus buddhist atheist gay lesbian bisexual "
    "transgender trans queer straight black white asian african european latino hispanic american mexican indian chinese arab immigrant immigrants "
    "refugee refugees disabled blind deaf elderly old young teenage frauen männer musulmans femmes hommes mujeres hombres inmigrantes".split()
)
#: Labelled rows of each kind that are fitted at most, bytes of such a text at most; texts that a word of the model must be in.
SAMPLE, SAMPLE_BYTES, MIN_TEXTS = 5_000, 32_768, 5
#: A sample that is still sent to all executors as ids and labels.
LARGEST_SAMPLE = 100_000
STEPS, RATE, L1, L2, COUNTERFACTUAL = 250, 0.5, 2e-4, 1e-4, 2.0
TEXT_BYTES = 2_000_000


@dataclass
class Model:
    """Sorted word hashes, their weights, the intercept."""

    words: np.ndarray
    weights: np.ndarray
    intercept: float

    def logits(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One logit per text; a word counts once per text."""
        n = len(starts) - 1
        out = np.full(n, self.intercept)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == hashes)
            text = np.searchsorted(starts, hit, "right") - 1
            once = np.unique(text * len(self.words) + at[hit])
            out += np.bincount(once // len(self.words), self.weights[once % len(self.words)], n)
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Objective:
    """Smooth part of the loss: weighted log loss, L2, and the squared change of logits between texts and counterfactuals."""

    row: np.ndarray  # text of each occurrence
    col: np.ndarray  # its word
    labels: np.ndarray
    weight: np.ndarray  # of each text
    lost: np.ndarray  # words that a counterfactual loses, and
    gained: np.ndarray  # those that it gains instead
    added: np.ndarray  # words that a text without identity terms gains
    penalty: float

    @property
    def swaps(self) -> int:
        return len(self.lost) + len(self.added)

    def value(self, w: np.ndarray, b: float) -> float:
        z = np.bincount(self.row, w[self.col], len(self.labels)) + b
        loss = (self.weight * (np.logaddexp(0, z) - self.labels * z)).mean() + L2 / 2 * w @ w
        changes = ((w[self.gained] - w[self.lost]) ** 2).sum() + (w[self.added] ** 2).sum()
        return float(loss + self.penalty / 2 * changes / max(1, self.swaps))

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        n, k = len(self.labels), len(w)
        error = self.weight * (sigmoid(np.bincount(self.row, w[self.col], n) + b) - self.labels) / n
        out = np.bincount(self.col, error[self.row], k) + L2 * w
        if self.swaps:
            change = w[self.gained] - w[self.lost]
            out += self.penalty / self.swaps * (np.bincount(self.gained, change, k) - np.bincount(self.lost, change, k) + np.bincount(self.added, w[self.added], k))
        return out, float(error.sum())


def objective(bags: list[np.ndarray], labels: np.ndarray, terms=IDENTITY_TERMS, penalty: float = COUNTERFACTUAL, seed: int = 1) -> tuple[np.ndarray, Objective]:
    """The words of the model, and what is minimised over their weights."""
    flat = np.concatenate(bags)
    words, counts = np.unique(flat, return_counts=True)
    groups = np.array(sorted({word_hash(t) for t in terms}), np.uint64)
    words = np.union1d(words[counts >= MIN_TEXTS], groups)
    n, k = len(bags), len(words)
    at = np.minimum(np.searchsorted(words, flat), k - 1)
    hit = words[at] == flat
    row, col = np.repeat(np.arange(n), [len(b) for b in bags])[hit], at[hit]
    # Counterfactuals as the words that they lose and gain: each term of a text is swapped for another one, a text without gains one.
    rng = np.random.default_rng(seed)
    group = np.searchsorted(words, groups)
    is_group = np.zeros(k, bool)
    is_group[group] = True
    lost = col[is_group[col]]
    gained = rng.choice(group, len(lost)) if len(group) else lost
    bare = np.setdiff1d(np.arange(n), row[is_group[col]])
    added = rng.choice(group, len(bare)) if len(group) else np.zeros(0, int)
    positive = labels.sum() / n
    weight = np.where(labels > 0, 0.5 / positive, 0.5 / (1 - positive))  # both kinds count alike
    return words, Objective(row, col, labels, weight, lost, gained, added, penalty)


def fit(bags: list[np.ndarray], labels: np.ndarray, terms=IDENTITY_TERMS, penalty: float = COUNTERFACTUAL, seed: int = 1) -> Model:
    """bags: distinct word hashes of each text.  Accelerated proximal steps, since L1 is not smooth."""
    labels = np.asarray(labels, float)
    if not len(bags) or labels.min() == labels.max():
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))))
    words, loss = objective(bags, labels, terms, penalty, seed)
    k = len(words)
    w, b = np.zeros(k), 0.0
    previous_w, previous_b, t = w, b, 1.0
    scale = 1 / np.sqrt(np.maximum(np.bincount(loss.col, minlength=k), 1) / len(bags))  # frequent words get smaller steps
    for _ in range(STEPS):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, yb = w + (t - 1) / t_next * (w - previous_w), b + (t - 1) / t_next * (b - previous_b)
        gradient, slope = loss.gradient(y, yb)
        previous_w, previous_b, t = w, b, t_next
        step = y - RATE * scale * gradient
        w = np.sign(step) * np.maximum(np.abs(step) - RATE * scale * L1, 0)
        b = yb - RATE * slope
    used = w != 0
    return Model(words[used], w[used], float(b))


def bags(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and the distinct word hashes of every text."""

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for i, j in slices(offsets, TEXT_BYTES):
                hashes, starts = hasher(data, offsets[i : j + 1], letters=True)
                sets = [np.unique(hashes[a:z]).view(np.int64) for a, z in zip(starts, starts[1:])]
                yield pa.record_batch([*(batch.column(c)[i:j] for c in keep), pa.array(sets, pa.list_(pa.int64()))], names=[*keep, "bag"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)
    return docs.mapInArrow(run, f"{fields}, bag array<long>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms=IDENTITY_TERMS, penalty: float = COUNTERFACTUAL, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """docs: id, text; labels: id, toxic.  At most ``sample`` labelled rows of each kind are used."""
    if sample > LARGEST_SAMPLE:
        raise ValueError(f"a sample has at most {LARGEST_SAMPLE} rows of each kind")
    known = labels.where("toxic is not null and id is not null").groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    fitting = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
    known = known.join(fitting.where("id is not null").select("id").distinct(), "id", "left_semi")
    order = F.xxhash64("id")
    chosen = known.where("toxic = 1").orderBy(order, "id").limit(sample).unionByName(known.where("toxic = 0").orderBy(order, "id").limit(sample))
    # At most 2 * LARGEST_SAMPLE rows of two numbers: small enough to broadcast.
    texts = fitting.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    held = written(bags(texts, ["id", "toxic"]), "bags")
    often = held.select(F.explode("bag").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TEXTS).select("word")
    groups = F.array(*(F.lit(int(np.uint64(word_hash(t)).astype(np.int64))) for t in terms)) if terms else F.array().cast("array<bigint>")
    each = held.select("id", F.explode("bag").alias("word"))
    used = each.join(often, "word", "left_semi").unionByName(each.where(F.array_contains(groups, F.col("word")))).distinct()
    thin = held.select("id", "toxic").join(used.groupBy("id").agg(F.sort_array(F.collect_list("word")).alias("bag")), "id", "left")
    rows = thin.orderBy("id").collect()
    as_bag = lambda r: np.unique(np.array(r.bag or [], np.int64).view(np.uint64))
    return fit([as_bag(r) for r in rows], np.array([r.toxic for r in rows], float), terms, penalty)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Append score (0 to 1) and predicted to id and text's other columns; the model's words are bounded by the sample."""
    kept = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for i, j in slices(offsets, TEXT_BYTES):
                hashes, starts = hasher(data, offsets[i : j + 1], letters=True)
                p = sigmoid(shared.value.logits(hashes, starts))
                yield pa.record_batch([*(batch.column(c)[i:j] for c in kept), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5

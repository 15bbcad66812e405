"""Toxicity (operator 9): a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel compares two words by the three-letter subsequences that they share, gaps allowed: an occurrence that spans s
letters (seven at most) weighs DECAY ** s, and the vector of sums is brought to length 1. So a gap or an inserted letter costs
weight, not the match. Words are framed by marks for start and end, which are letters like others. The kernel's third power
is a kernel too, and parts a word from its neighbours more sharply.

The machine is linear in the Nyström map k(x, L) K^(-1/2) of landmarks L. Every stretch of every word is compared with all
landmarks: an altered insult shares little with the plain one, so no share of the weight tells that a word can be skipped.

Training is on sentences whose labels are their documents' (multiple instances). All sentences of a clean document are clean,
so every stretch of their words is a negative instance. A toxic document has a toxic sentence, and which one is not labelled:
a sentence's value is that of its highest word, a document's that of its highest sentence, and the words that give a toxic
document its value are its witnesses, the positive instances. The machine is trained and witnesses are chosen by it, in turn,
until they stay. Positive instances are learnt in plain and in disguised spelling, with one and two characters put in.
Negative ones join the working set when they score near the border, until none outside does.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations, groupby
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written
from .hashing import mixed
from .labelled import held_out, training_rows
from .neardup import Shingler
from .tokens import kept_by_worker, slices

LETTERS, SPAN, DECAY = 3, 7, 0.8
PATTERNS = [(0, *rest) for rest in combinations(range(1, SPAN), LETTERS - 1)]
#: Power of the kernel.
POWER = 3
#: Longest stretch of a word that is compared at once, marks included, and the step between stretches.
STRETCH, STEP = 16, 8
TABLE_BITS = 20
REMEMBERED = 600_000

#: Minimum hashes by which copies among training rows are found, and the similarity in percent at which one goes.
MINIMA, COPY = 4, 80
#: Witnesses of a toxic document at most; beyond the first they have to lie above the border.
WITNESSES = 3
#: Positive words of one machine, landmarks of one if few words are positive, and disguised spellings with characters put in.
POSITIVES, LANDMARKS, VARIANTS = 600, 256, 16
#: Value from which on a word is as toxic as can be.
SURE = 2.0
#: Negative words to begin with, how many join in a round at most, from which value on, and rounds at most.
NEGATIVES, JOINING, NEAR, ROUNDS = 3000, 4000, -0.3, 4

_MARKS = ".,;:!?#*$%&|'\"()[]{}<>-"
_PIECES = re.compile(r"[^\W_]+").findall


def units(text: str) -> set[str]:
    """The words of a text that are scored: lower case, without marks around them; a word with marks inside counts joined
    and in its pieces; runs of single letters count joined."""
    words = text.lower().split()
    out, single = set(), 0
    for w in set(words):
        if not w.isalnum() and not (w := w.strip(_MARKS)).isalnum():  # noqa: PLW2901
            pieces = _PIECES(w)
            if len(pieces) > 1:
                out.update(p for p in pieces if len(p) > 2)
            w = "".join(pieces)  # noqa: PLW2901
        if len(w) > 1:
            out.add(w)
        else:
            single += 1
    if single > 1:
        for one, run in groupby(words, lambda w: len(w) == 1):
            if one and len(run := list(run)) >= LETTERS:  # noqa: PLW2901
                out.add("".join(run))
    return out


def stretches(word: str) -> list[str]:
    framed = f"\x01{word}\x02"
    return [framed] if len(framed) <= STRETCH else [framed[i : i + STRETCH] for i in range(0, len(framed) - STRETCH + STEP, STEP)]


def _hashed(parts: list[str]):
    """(pattern, table places, which of them are there) for each pattern of gaps, over stretches as rows. Patterns share the
    work of their beginnings."""
    sizes = np.array([len(p) for p in parts])
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.zeros((len(parts), STRETCH), np.uint64)
    codes[np.arange(STRETCH)[None, :] < sizes[:, None]] = points + np.uint64(1)
    there = codes > 0
    begun: dict[tuple, np.ndarray] = {}
    with np.errstate(over="ignore"):
        for p in PATTERNS:
            for k in range(1, LETTERS):
                if p[:k] not in begun:
                    width = STRETCH - p[k - 1]
                    before = begun[p[: k - 1]][:, :width] if k > 1 else np.uint64(0)
                    h = (before + codes[:, p[k - 1] :]) * np.uint64(0x9E3779B97F4A7C15)
                    begun[p[:k]] = h ^ (h >> np.uint64(29))
            h = (begun[p[:-1]][:, : STRETCH - p[-1]] + codes[:, p[-1] :]) * np.uint64(0x9E3779B97F4A7C15)
            yield p, ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - TABLE_BITS), there[:, p[-1] :]


def subsequences(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, table place, weight) of every subsequence occurrence in the stretches."""
    rows, places, weights = [], [], []
    for p, h, there in _hashed(parts):
        r, c = np.nonzero(there)
        rows.append(r)
        places.append(h[r, c])
        weights.append(np.full(len(r), DECAY ** (p[-1] + 1)))
    return np.concatenate(rows), np.concatenate(places).astype(np.int64), np.concatenate(weights)


def normed(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, weight), sorted by row: occurrences of one subsequence added up, each row of length 1."""
    row, place, weight = subsequences(parts)
    key, inverse = np.unique(row.astype(np.int64) << TABLE_BITS | place, return_inverse=True)
    total = np.bincount(inverse, weight, len(key))
    row, place = key >> TABLE_BITS, key & (1 << TABLE_BITS) - 1
    length = np.sqrt(np.bincount(row, total**2, len(parts)))
    return row, place, (total / length[row]).astype(np.float32)


class Landmarks:
    """Kernel values of stretches against fixed ones, of which the first ``positive`` are of the positive class. Only the
    strings travel to the tasks; the tables are made there."""

    def __init__(self, parts: list[str], positive: int):
        row, place, weight = normed(parts)
        used, inverse = np.unique(place, return_inverse=True)
        self.parts, self.positive = parts, positive
        self.where = np.full(1 << TABLE_BITS, -1, np.int32)
        self.where[used] = np.arange(len(used))
        #: A row for each subsequence that a landmark has.
        self.table = np.zeros((len(used), len(parts)), np.float32)
        self.table[inverse, row] = weight

    def __reduce__(self):
        return Landmarks, (self.parts, self.positive)

    def kernel(self, parts: list[str]) -> np.ndarray:
        out = np.zeros((len(parts), len(self.parts)), np.float32)
        for at in range(0, len(parts), 1024):
            row, place, weight = normed(parts[at : at + 1024])
            k = self.where[place]
            row, k, weight = row[k >= 0], k[k >= 0], weight[k >= 0]
            bounds = np.searchsorted(row, np.arange(len(parts[at : at + 1024]) + 1)).tolist()
            for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), at):
                if hi > lo:
                    out[i] = weight[lo:hi] @ self.table[k[lo:hi]]
        return out.astype(float) ** POWER


@dataclass
class ToxicityModel:
    """``more`` are machines for further positive words; a word's value is that of the machine that gives the highest."""

    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    calibration: np.ndarray | None = None
    more: list[ToxicityModel] = field(default_factory=list)

    def words(self, words: list[str]) -> np.ndarray:
        """Decision value of each word: that of its highest stretch."""
        parts = [stretches(w) for w in words]
        owner = np.repeat(np.arange(len(words)), [len(p) for p in parts])
        highest = np.full(len(words), -np.inf)
        np.maximum.at(highest, owner, self.landmarks.kernel([s for p in parts for s in p]) @ self.weights)
        return np.max([highest + self.bias, *(m.words(words) for m in self.more)], 0)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.calibration, -30, 30)))


class Reader:
    """Highest decision value of texts; each distinct word is computed once in a task."""

    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}

    def values(self, texts: list[str]) -> list[set[str]]:
        """The words of each text; ``known`` has the values of all of them."""
        asked = [units(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list(set().union(*asked) - known.keys())
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            known.update(zip(part, self.model.words(part).tolist(), strict=True))
        return asked

    def evidence(self, texts: list[str]) -> np.ndarray:
        """For each text: 1, its highest value (bounded by ``SURE``, so that a disguised word that is clearly beyond the border
        counts as a plain one), and how often words beyond the border occur, as a logarithm. What else a text says, and how long it
        is, does not count: a sentence is as toxic in a long text as by itself."""
        asked = self.values(texts)
        known = self.known
        out = np.zeros((len(texts), 3))
        for i, (text, words) in enumerate(zip(texts, asked, strict=True)):
            top = max(map(known.__getitem__, words), default=self.model.bias)
            out[i, :2] = 1, min(max(top, -1.5), SURE)
            if top > 0:
                low = text.lower()
                out[i, 2] = np.log1p(sum(max(1, low.count(w)) for w in words if known[w] > 0))
        return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 100.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3

    def loss(v):
        return 0.5 * (ridge * v * v).sum() + cost * (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()

    for _ in range(50):
        margin = 1 - y * (x @ w)
        on = margin > 0
        grad = ridge * w - 2 * cost * x[on].T @ (weight[on] * y[on] * margin[on])
        hess = np.diag(ridge) + 2 * cost * (x[on].T * weight[on]) @ x[on]
        step = np.linalg.solve(hess, grad)
        size, before = 1.0, loss(w)
        while loss(w - size * step) > before and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _disguised(word: str) -> list[str]:
    """The word in other spellings, the same ones at every run: with one or two characters put in, one replaced, one left out
    and one doubled."""
    rng = random.Random(zlib.crc32(word.encode()))

    def put_in(w: str) -> str:
        k = rng.randint(1, len(w) - 1)
        return w[:k] + rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") + w[k:]

    out = [put_in(word) if n % 2 else put_in(put_in(word)) for n in range(VARIANTS)]
    i, j, k = rng.randint(1, len(word) - 2), rng.randint(1, len(word) - 2), rng.randint(1, len(word) - 1)
    return [*out, word[:i] + rng.choice("0123456789x") + word[i + 1 :], word[:j] + word[j + 1 :], word[:k] + word[k - 1] + word[k:]]


def train_words(positive: dict[str, int], negative: dict[str, int]) -> ToxicityModel:
    """The machine for words of both classes, each with the number of documents it speaks for; a machine for each ``POSITIVES``
    words if more are positive."""
    plain = list(positive)
    first, *more = [_one_machine({w: positive[w] for w in plain[at : at + POSITIVES]}, positive, negative) for at in range(0, len(plain), POSITIVES)]
    first.more = more
    return first


def _one_machine(positive: dict[str, int], all_positive: dict[str, int], negative: dict[str, int]) -> ToxicityModel:
    """Every stretch of a positive word is a landmark; the other landmarks, half of ``LANDMARKS`` at least, are negative words in
    the order given. Of a positive word's stretches the highest should be positive; as one does not know which, each speaks
    with its share of the weight."""
    instances: list[tuple[str, float, float]] = []
    for w, n in positive.items():
        parts = stretches(w)
        instances += [(p, 1.0, n / len(parts)) for p in parts]
        spelt = [d for d in dict.fromkeys(_disguised(w)) if d not in negative and d not in all_positive] if len(w) > 3 else []
        instances += [(stretches(d)[0], 1.0, n / len(spelt)) for d in spelt]
    for w, n in negative.items():
        instances += [(p, -1.0, float(n)) for p in stretches(w)]
    parts, y, weight = ([i[k] for i in instances] for k in range(3))
    own = list(dict.fromkeys(p for w in positive for p in stretches(w)))
    known = set(own)
    other = [p for p in dict.fromkeys(p for w in negative for p in stretches(w)) if p not in known]
    marks = Landmarks(own + other[: max(LANDMARKS - len(own), LANDMARKS // 2)], len(own))
    values, vectors = np.linalg.eigh(marks.kernel(marks.parts))
    good = values > 1e-5 * max(values.max(), 1e-9)
    root = vectors[:, good] / np.sqrt(values[good])
    w, bias = _machine(marks.kernel(parts) @ root, np.array(y), np.sqrt(np.array(weight)))
    return ToxicityModel(marks, root @ w, bias)


def _counted(rows: DataFrame) -> DataFrame:
    """(key, toxic, clean): in how many documents of each label a word occurs."""
    def run(batches):
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for part in slices(batches):
            for label, data in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                found[label > 0].update(units(data.decode("utf-8", "replace")))
        keys = list(found[0].keys() | found[1].keys())
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([found[1][k] for k in part], pa.int64()), pa.array([found[0][k] for k in part], pa.int64())], ["key", "toxic", "clean"])

    return rows.mapInArrow(run, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _without_copies(rows: DataFrame) -> DataFrame:
    """``rows`` without copies, exact or near, so that a text speaks once however often it was copied. Rows of a label that share
    one of ``MINIMA`` minimum hashes of their five-word shingles are compared on whole sets, and one goes if it is similar by
    ``COPY`` percent to one with a smaller id. The rows are a bounded sample, which bounds a group. Only the texts of rows
    that share a minimum with another are shuffled."""
    def minima(batches):
        shingle = Shingler(5)
        for part in slices(batches, 64):
            sets = shingle.sets(part.column(2).to_pylist())
            some = [i for i, s in enumerate(sets) if len(s)]
            with np.errstate(over="ignore"):
                low = [int(mixed(sets[i] + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)).min().view(np.int64)) for i in some for k in range(MINIMA)]
            take = pa.array(np.repeat(np.array(some, np.int32), MINIMA))
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(low, pa.int64())], ["id", "label", "low"])

    def copies(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        stay, gone = [], []
        for i, one in enumerate(Shingler(5).sets(group.column("text").to_pylist())):
            for other in stay:
                if 100 * min(len(one), len(other)) >= COPY * max(len(one), len(other)):
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    if 100 * common >= COPY * (len(one) + len(other) - common):
                        gone.append(i)
                        break
            else:
                stay.append(one)
        return group.select(["id"]).take(pa.array(gone, pa.int64()))

    kind = rows.schema["id"].dataType.simpleString()
    lows = written(rows.mapInArrow(minima, f"id {kind}, label int, low long"), "minima")
    shared = lows.groupBy("label", "low").count().where("count > 1").drop("count")
    alike = lows.join(shared, ["label", "low"]).join(rows.select("id", "text"), "id").groupBy("label", "low")
    return rows.join(F.broadcast(alike.applyInArrow(copies, f"id {kind}").distinct()), "id", "left_anti").select("id", "label", "text")


def _first_witnesses(rows: DataFrame, counts: DataFrame, toxic: int, clean: int) -> dict[str, int]:
    """Witnesses before there is a machine: a toxic document's words that are the most toxic by share of documents, with three
    more documents as prior."""
    def run(batches):
        for part in slices(batches):
            met = [(i, w) for i, t in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True) for w in units(t.decode("utf-8", "replace"))]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in met], part.schema.field(0).type), pa.array([m[1] for m in met], pa.string())], ["id", "key"])

    kind = rows.schema["id"].dataType.simpleString()
    share = F.col("toxic") / (F.col("toxic") + F.col("clean") * (toxic / clean) + 3)
    words = rows.where("label > 0").mapInArrow(run, f"id {kind}, key string").join(counts.where("toxic > 0").select("key", share.alias("share")), "key")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("share"), "key"))
    top = words.withColumn("place", place).where((F.col("place") == 1) | (F.col("place") <= WITNESSES) & (F.col("share") > 0.5))
    return {r[0]: r[1] for r in top.groupBy("key").count().orderBy("key").collect()}


def _witnesses(rows: DataFrame, model: ToxicityModel) -> dict[str, int]:
    """For each word that is a witness by the machine, of how many toxic documents: ``WITNESSES`` words a row at most."""
    def run(batches):
        reader = Reader(model)
        for part in slices(batches):
            met = []
            for words in reader.values([t.decode("utf-8", "replace") for t in part.column(2).to_pylist()]):
                top = sorted(words, key=lambda w: (-reader.known[w], w))[:WITNESSES]
                met += [w for n, w in enumerate(top) if n == 0 or reader.known[w] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.string())], ["key"])

    return {r[0]: r[1] for r in rows.where("label > 0").mapInArrow(run, "key string").groupBy("key").count().orderBy("key").collect()}


def _near_border(clean: DataFrame, model: ToxicityModel) -> DataFrame:
    """(key, clean, value) of the words of clean documents that score ``NEAR`` the border or above."""
    def run(batches):
        for part in slices(batches, 4096):
            value = model.words(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(value)], ["key", "clean", "value"])

    return clean.select("key", "clean").mapInArrow(run, "key string, clean long, value double").where(F.col("value") > NEAR)


def trained(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel | None:
    """None without labelled rows of both classes, or if no toxic row has a word. What reaches the driver is bounded by the sample:
    ``WITNESSES`` words of each toxic row, the working set of negative words, and three numbers for each row."""
    with scratch():
        rows = written(training_rows(docs, labels, "toxic", most_labelled, id_col, text_col), "labelled")
        rows = written(_without_copies(rows), "labelled")
        sizes = {bool(r[0]): r[1] for r in rows.groupBy(F.col("label") > 0).count().collect()}
        if len(sizes) < 2:
            return None
        counts = written(_counted(rows), "words")
        positive = _first_witnesses(rows, counts, sizes[True], sizes[False])
        if not positive:
            return None
        # so many words that every core has some: each is compared with all landmarks in every round
        clean = written(counts.where("clean > 0").select("key", "clean").repartition(max(8, rows.sparkSession.sparkContext.defaultParallelism)), "clean")
        begin = [*clean.orderBy(F.desc("clean"), "key").limit(NEGATIVES // 2).collect(), *clean.orderBy(F.xxhash64("key"), "key").limit(NEGATIVES // 2).collect()]
        negative = {r["key"]: min(r["clean"], 30) for r in begin}
        model = train_words(positive, negative)
        for _ in range(ROUNDS):
            near = {r[0]: min(r[1], 30) for r in _near_border(clean, model).orderBy(F.desc("value"), "key").limit(len(negative) + JOINING).collect()}
            following = _witnesses(rows, model)
            joined = [w for w in near if w not in negative][:JOINING]
            if not joined and following.keys() == positive.keys():
                break
            allowed = {*negative, *joined}
            # words near the border come first: landmarks are taken from there
            negative = {w: n for w, n in near.items() if w in allowed} | {w: n for w, n in negative.items() if w not in near}
            positive = following
            model = train_words(positive, negative)
        label, evidence = _evidence(rows, model)
        model.calibration = _logistic(evidence, label)
        return model


def _evidence(rows: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        reader = Reader(model)
        for part in slices(batches):
            got = reader.evidence([t.decode("utf-8", "replace") for t in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(got), pa.list_(pa.float64()))], ["label", "x"])

    got = sorted((r[0], list(r[1])) for r in rows.mapInArrow(run, "label int, x array<double>").collect())
    return np.array([r[0] for r in got], float), np.array([r[1] for r in got], float).reshape(len(got), 3)


def _logistic(x: np.ndarray, label: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic calibration with Platt's smoothed targets, by Newton steps that never raise the loss."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(x.shape[1])

    def loss(v):
        z = x @ v
        return np.logaddexp(0, z).sum() - target @ z + ridge / 2 * v @ v

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - target) + ridge * w)
        size, before = 1.0, loss(w)
        while loss(w - size * step) > before and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.5, most_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text", model: ToxicityModel | None = None) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``.

    ``model`` is trained on at most ``most_labelled`` labelled rows (the documented bound of the sample) unless it is given.
    A null text scores as the empty one; repeated rows stay; an empty table gives an empty one; without labelled rows of
    both classes every score is 0. Whole texts are read where they are; there is no shuffle.
    """
    model = model or trained(docs, labels, most_labelled, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid4().hex

    def run(batches):
        model = shared.value
        reader = kept_by_worker("reader", name, lambda: Reader(model)) if model else None
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            score = model.probability(reader.evidence(texts)) if reader else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))

"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are a fixed lexicon, words and word beginnings mined from labelled rows, patterns, and the absence
of all these. The label model is a tree of voters for each class: a voter's vote depends on the class and
on the vote of the voter that it is most correlated with within the classes, where that correlation is
beyond chance. Structure, accuracies and correlations are estimated by expectation maximisation over the
votes on all documents, in which labelled rows keep their labels. A logistic regression is then trained
on the posterior labels, and its probability is the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, small_batches, staged

#: Common English insults.
INSULTS = frozenset("idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile loser losers clown pathetic worthless trash garbage scum scumbag disgusting bastard bitch asshole shit crap fuck fucking whore slut retard jerk".split())
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT, _NOISE = re.compile(r"!{2,}"), re.compile(r"[%&$#*]{3,}")
_MARKED = "doc_id long, held_out boolean, known int, marks array<int>"
BEGINNINGS = (4, 5)


def terms(text: str) -> tuple[set[str], list[str]]:
    """(distinct words and word beginnings of a text, its distinct words); a beginning ends in ``*``."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for k in BEGINNINGS for w in words if len(w) > k}, list(words)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for batch in small_batches(batches, "text"):
        for text, known in zip(batch.column("text").to_pylist(), batch.column("known").to_pylist(), strict=True):
            counts[known].update(terms(text)[0])
    for known, own in enumerate(counts):
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([known] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())], ["term", "known", "n"])


def mine(sample: DataFrame, weight: float, share: float, least: int = 6, precision: float = 0.95, chance: float = 0.05) -> list[str]:
    """All terms found in ``least`` toxic rows or more, ``precision`` of them toxic, that are no chance finds.

    ``weight``: clean rows that a clean row of the sample stands for, over the same of toxic rows; ``share``:
    of toxic rows in the sample. A term's rows must be toxic more often than that, by Chernoff's bound with
    ``chance`` divided by the number of terms tested: a floor that does not grow with the sample."""
    if not 0 < share < 1:
        return []
    of = lambda known: F.sum(F.when(F.col("known") == known, F.col("n")).otherwise(0))
    counted = sample.mapInArrow(_count_terms, "term string, known int, n long").groupBy("term").agg(of(1).alias("n"), of(0).alias("c")).where(F.col("n") >= least)
    counted = staged(sample.sparkSession, counted, "toxic-terms")
    own = F.col("n") / (F.col("n") + F.col("c"))
    bound = F.col("n") * F.log(own / F.lit(share)) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - own) / (1 - share))).otherwise(0.0)
    kept = counted.where((F.col("n") >= precision * (F.col("n") + F.col("c") * weight)) & (own > share) & (bound >= float(np.log(max(1, counted.count()) / chance))))
    return [r["term"] for r in kept.orderBy(F.desc("n"), "term").select("term").collect()]


def _mark(batches: Iterator[pa.RecordBatch], vocabulary: list[str]) -> Iterator[pa.RecordBatch]:
    """Numbers of the terms and patterns in each text; patterns come after the terms."""
    place, base = {t: i for i, t in enumerate(vocabulary)}, len(vocabulary)
    for batch in small_batches(batches, "text"):
        rows = []
        for text in batch.column("text").to_pylist():
            words = set(_WORD.findall(text.lower()))
            own = {place[w] for w in words if w in place}
            for k in BEGINNINGS:
                own |= {place[b] for b in {w[:k] + "*" for w in words if len(w) > k} if b in place}
            own |= {base + i for i, hit in enumerate((not words.isdisjoint(INSULTS), bool(_SHOUT.search(text)), bool(_NOISE.search(text)))) if hit}
            rows.append(sorted(own))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "known")), pa.array(rows, pa.list_(pa.int32()))], [x.split()[0] for x in _MARKED.split(", ")])


class Votes:
    """The first ``terms`` mined terms, three patterns, and the absence of all terms and insults."""

    def __init__(self, vocabulary: int, terms: int):
        self.base, self.terms = vocabulary, min(terms, vocabulary)
        self.n = self.terms + 4

    def table(self, marks: pa.ListArray) -> np.ndarray:
        out, n = np.zeros((len(marks), self.n), bool), np.diff(marks.offsets.to_numpy())
        row, mark = np.repeat(np.arange(len(marks)), n), marks.flatten().to_numpy(zero_copy_only=False)
        fits = mark < self.terms
        out[row[fits], mark[fits]] = True
        for i in range(3):
            out[row[mark == self.base + i], self.terms + i] = True
        any_term = np.zeros(len(marks), bool)
        any_term[row[mark <= self.base]] = True  # terms and insults
        out[:, -1] = ~any_term
        return out


class Tree:
    """The label model: ``n`` rows, ``joint`` (2 x voters x voters) votes of pairs (on the diagonal: of one voter)
    by class, and each voter's parent (-1: none)."""

    def __init__(self, n: np.ndarray, joint: np.ndarray, parent: np.ndarray, smooth: float = 0.5):
        m = joint.shape[1]
        self.parent, self.prior = parent, float(np.clip(n[1] / max(n.sum(), 1e-9), 1e-4, 0.5))
        own, at = np.einsum("cii->ci", joint), np.maximum(parent, 0)
        both, of_parent = joint[:, np.arange(m), at], own[:, at]
        rate = (own + 0.05 * smooth) / (n[:, None] + 0.1 * smooth)
        # Chance of a vote if the parent votes and if it does not, drawn towards the voter's own rate.
        yes = np.where(parent < 0, rate, (both + smooth * rate) / (of_parent + smooth))
        no = np.where(parent < 0, rate, (own - both + smooth * rate) / (n[:, None] - of_parent + smooth))
        yes, no = np.clip(yes, 1e-5, 1 - 1e-5), np.clip(no, 1e-5, 1 - 1e-5)
        # The log odds are linear in votes, votes of parents and their products.
        lone, quiet = np.log(no[1] / no[0]), np.log((1 - no[1]) / (1 - no[0]))
        led, idle = np.log(yes[1] / yes[0]), np.log((1 - yes[1]) / (1 - yes[0]))
        self.base = float(np.log(self.prior / (1 - self.prior)) + quiet.sum())
        self.single, self.pair = lone - quiet, np.where(parent < 0, 0, led - idle - lone + quiet)
        np.add.at(self.single, at[parent >= 0], (idle - quiet)[parent >= 0])

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of the toxic class."""
        led = np.flatnonzero(self.parent >= 0)
        return self.base + votes @ self.single + (votes[:, led] & votes[:, self.parent[led]]) @ self.pair[led]


def structure(n: np.ndarray, joint: np.ndarray, chance: float = 0.01) -> np.ndarray:
    """Each voter's parent: the spanning forest of most information between votes within the classes, of the
    pairs whose information is beyond ``chance`` divided by the number of pairs, by the likelihood ratio test."""
    m, own, info = joint.shape[1], np.einsum("cii->ci", joint), np.zeros(joint.shape[1:])
    for c in (0, 1):
        a, b, both, size = own[c][:, None], own[c][None], joint[c], max(n[c], 1e-9)
        for votes, p, q in ((both, a, b), (a - both, a, size - b), (b - both, size - a, b), (size - a - b + both, size - a, size - b)):
            votes, even = np.maximum(votes, 0), np.maximum(p * q / size, 1e-12)
            info += np.where(votes > 1e-9, votes * np.log(np.maximum(votes, 1e-12) / even), 0)
    # 2 * info is chi-square with two degrees of freedom by chance: its tail is exp(-info).
    np.fill_diagonal(info, 0)
    parent, inside, least = np.full(m, -1), np.zeros(m, bool), math.log(max(1, m * (m - 1) / 2) / chance)
    gain, by = np.zeros(m), np.full(m, -1)
    for _ in range(m):
        i = int(np.argmax(np.where(inside, -1.0, gain)))
        parent[i], inside[i] = by[i], True
        closer = ~inside & (info[i] > np.maximum(gain, least))
        gain[closer], by[closer] = info[i][closer], i
    return parent


def _votes(batches: Iterator[pa.RecordBatch], how: Votes, tree: Tree | None) -> Iterator[pa.RecordBatch]:
    """Sums over rows by class: of ones and of votes in pairs. Labelled rows have their label, others the
    posterior of ``tree``, or no part without one."""
    m = how.n
    total = np.zeros(2 + 2 * m * m)
    for batch in batches:
        for part in (batch.slice(i, 8192) for i in range(0, batch.num_rows, 8192)):
            known = part.column("known").fill_null(-1).to_numpy()
            known = np.where(part.column("held_out").to_numpy(zero_copy_only=False), -1, known)
            votes = how.table(part.column("marks"))
            p = np.where(known >= 0, known, 1 / (1 + np.exp(-np.clip(tree.log_odds(votes), -30, 30)))) if tree else (known == 1).astype(float)
            rest = 1 - p if tree else (known == 0).astype(float)
            for c, w in enumerate((rest, p)):
                total[c] += w.sum()
                total[2 + c * m * m :][: m * m] += ((votes * w[:, None]).T @ votes.astype(float)).reshape(-1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "x"])


def label_model(marked: DataFrame, how: Votes, rounds: int = 4) -> Tree:
    """The tree after expectation maximisation over all rows of ``marked``; it starts from the labelled rows,
    and its structure is found again in every round. The driver gets the sums of each round: 2 + 2 * voters^2."""
    m, tree = how.n, None
    for _ in range(rounds + 1):
        total = np.zeros(2 + 2 * m * m)
        summed = marked.select("marks", "known", "held_out").mapInArrow(partial(_votes, how=how, tree=tree), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        total[summed["at"].to_numpy()] = summed["x"].to_numpy()
        n, joint = total[:2], total[2:].reshape(2, m, m)
        tree = Tree(n, joint, structure(n, joint))
    return tree


class Columns:
    """Sparse: a column per term and pattern; dense: the number of terms by its logarithm, and one."""

    def __init__(self, marks: pa.ListArray, base: int):
        n = np.diff(marks.offsets.to_numpy())
        self.n, self.width = len(n), base + 3
        self.row, self.mark = np.repeat(np.arange(self.n), n), marks.flatten().to_numpy(zero_copy_only=False)
        self.dense = np.stack([np.log1p(np.bincount(self.row[self.mark <= base], minlength=self.n)), np.ones(self.n)], axis=1)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.mark], minlength=self.n) + self.dense @ w[self.width :]

    def back(self, v: np.ndarray, power: int = 1) -> np.ndarray:
        return np.concatenate([np.bincount(self.mark, v[self.row], minlength=self.width), (self.dense**power).T @ v])


def fit_linear(x: Columns, y: np.ndarray, decay: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps, each solved by conjugate gradients."""
    w = np.zeros(x.width + 2)
    ridge = np.full(len(w), decay * max(1, x.n))
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        d = p * (1 - p) + 1e-9
        scale, left, step = x.back(d, 2) + ridge, x.back(y - p) - ridge * w, np.zeros(len(w))
        z = left / scale
        way, size = z, left @ z
        goal = 1e-16 * size
        for _ in range(500):
            if size <= goal or size == 0:
                break
            ahead = x.back(d * x.times(way)) + ridge * way
            far = size / (way @ ahead)
            step, left = step + far * way, left - far * ahead
            z = left / scale
            was, size = size, left @ z
            way = z + size / was * way
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _score(batches: Iterator[pa.RecordBatch], base: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = 1 / (1 + np.exp(-np.clip(Columns(batch.column("marks"), base).times(weights), -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, most: int = 12_000, voters: int = 96) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs`` (doc_id, text).

    Labels (doc_id, toxic) are used for documents whose crc32 of the id's decimal text modulo ``folds`` is
    not ``held``; null labels and ids are not. All terms that are no chance finds are mined from up to ``most`` labelled documents of
    each class, those of the smallest hashes. The ``voters`` most frequent of them vote one by one in the
    label model, the others only in its voter for the absence of all; the model reads the votes on all
    documents. The classifier has a weight for every term and is fitted on up to ``most`` rows. Null texts
    count as empty and are scored as such; without any toxic label every score is 0. Repeated rows each get
    a row; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (remainder(F.col("doc_id"), folds) == held).alias("held_out"))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("known")).where("doc_id IS NOT NULL AND known IN (0, 1)")
    usable = usable.where(remainder(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("known").alias("known"))
    classes = {r["known"]: r["n"] for r in usable.groupBy("known").agg(F.count("*").alias("n")).collect()}
    if not classes.get(1):
        return docs.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    few = lambda c: usable.where(F.col("known") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = staged(spark, few(1).unionByName(few(0)), "toxic-sample")  # at most 2 * most rows: sent to all tasks
    labelled = staged(spark, docs.where("not held_out").join(F.broadcast(sample), "doc_id").select("text", "known").distinct(), "toxic-texts")
    toxic, clean = min(most, classes[1]), min(most, classes.get(0, 0))
    texts = {r["known"]: r["n"] for r in labelled.groupBy("known").agg(F.count("*").alias("n")).collect()}  # copies tell nothing new
    words = mine(labelled, (classes.get(0, 0) / max(clean, 1)) / (classes[1] / toxic), texts.get(1, 0) / max(1, sum(texts.values())))
    with_labels = docs.join(F.broadcast(sample), "doc_id", "left")
    marked = staged(spark, with_labels.mapInArrow(partial(_mark, vocabulary=words), _MARKED), "toxic-marks")

    how = Votes(len(words), voters)
    tree = label_model(marked, how)

    # Rows for the classifier: the smallest hashes with and without any mark, so that both kinds are there.
    any_mark = F.size("marks") > 0
    picked = [marked.where(kind).select("marks", F.xxhash64("doc_id", "marks").alias("h")).orderBy("h").limit(most // 2).select("marks") for kind in (any_mark, ~any_mark)]
    rows = picked[0].unionByName(picked[1]).toArrow()["marks"].combine_chunks()
    odds = tree.log_odds(how.table(rows))
    weights = fit_linear(Columns(rows, len(words)), 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return marked.mapInArrow(partial(_score, base=len(words), weights=weights), "doc_id long, held_out boolean, score double, predicted int")

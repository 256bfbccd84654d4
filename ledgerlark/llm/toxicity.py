"""Toxicity by the nearest labelled examples in exact TF-IDF cosine, over a block-max inverted index.

Terms are lower-case words of letters and their first 3 to 6 letters, so one entry covers a stem
with many endings. Every term that occurs in at least `least_df` examples counts, and examples of both labels are
indexed. A term weighs (1 + ln count) * idf * (chi-square with the label + 0.05) ** `told`: the last factor is what a
labelled collection adds to TF-IDF; it is small for terms that say nothing of the label and never 0. Postings lie
by term, in blocks of examples with the largest weight of each block; the most common terms, which have most of the
postings, lie in a dense matrix. A batch of queries goes through the matrix at once; each then scores the blocks whose upper bound
reaches the k-th best of the matrix alone, so its k nearest are exact; among equal cosines the earlier example wins. The neighbours
vote by squared cosine against a constant, so far ones hardly count; leave-one-out votes on the
examples calibrate the vote to a share (isotonic).

The examples are a bounded sample of labelled rows (max_examples, by a seeded hash of doc_id), the
same at every size; equal texts count once. Null and empty texts, and texts without any term, get the toxic share of examples
without terms. Labels that are null don't count; a doc_id labelled twice is toxic if one label says
so. Rows that repeat a doc_id are scored each. Without labels all scores are 0. Empty tables give
empty tables; extra columns don't matter. Very long texts are read whole.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import map_arrow
from ledgerlark.llm.interned import Interned, ranges, split

_LETTERS = re.compile(r"[^\W\d_]+")
#: The same in words with a space after each.
_PIECES = re.compile(r"[^\W\d_]+| ")
#: Words kept by one model, with their terms.
_CACHE_WORDS = 300_000
#: Texts taken apart at once; queries multiplied at once.
_TEXTS, _BATCH = 256, 64


@dataclass(frozen=True)
class Settings:
    max_examples: int = 3_000
    least_df: int = 5
    told: float = 0.35
    k: int = 15
    far: float = 1.0
    block: int = 256
    seed: int = 5


def terms_of(word: str) -> list[str]:
    """The terms of what stands between two white spaces: words, and '^' with the first letters of longer ones."""
    out, low = [], word.lower()
    for w in (low,) if low.isalpha() and low.isascii() else _LETTERS.findall(low):
        out.append(w)
        out += ["^" + w[:n] for n in range(3, min(7, len(w)))]
    return out


Vector = tuple[np.ndarray, np.ndarray]


class Index:
    """Unit vectors (terms, weights) of examples by term, in blocks; the most common terms in a matrix."""

    #: Terms in the matrix, of 8 bytes an example.
    DENSE = 2048

    def __init__(self, rows: list[Vector], labels: list[int], names: list[int | None], block: int, n_terms: int) -> None:
        order = sorted(range(len(rows)), key=lambda i: (labels[i], int(rows[i][0][rows[i][1].argmax()]), i))
        self.rows = [rows[i] for i in order]
        self.labels = np.array([labels[i] for i in order], dtype=np.int64)
        self.names = [names[i] for i in order]
        n = len(rows)
        self.starts = np.arange(0, n, block)
        term = np.concatenate([t for t, _ in self.rows])
        at = np.repeat(np.arange(n), [len(t) for t, _ in self.rows])
        weight = np.concatenate([w for _, w in self.rows])
        common = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[: self.DENSE]
        self.column = np.full(n_terms, -1)
        self.column[common] = np.arange(len(common))
        own = self.column[term] >= 0
        self.dense = self.column[term[own]], at[own], weight[own]
        self.matrix = self._matrix()
        term, at, weight = term[~own], at[~own], weight[~own]
        order = np.lexsort((at, term))
        term, self.at, self.weight = term[order], at[order], weight[order]
        n_blocks = len(self.starts)
        both = term * n_blocks + self.at // block
        self.lists = np.searchsorted(both, np.arange(n_terms * n_blocks + 1))
        self.most = np.zeros(n_terms * n_blocks)
        np.maximum.at(self.most, both, self.weight)
        self.most = self.most.reshape(n_terms, n_blocks)

    def _matrix(self) -> np.ndarray:
        out = np.zeros((int(self.column.max(initial=-1)) + 1, len(self.labels)))
        out[self.dense[0], self.dense[1]] = self.dense[2]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "matrix"} | {"at": self.at.astype(np.int32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"at": state["at"].astype(np.int64)}
        self.matrix = self._matrix()

    def _best(self, terms: np.ndarray, q: np.ndarray, start: np.ndarray, k: int) -> Vector:
        """Cosines above 0 and numbers of the k nearest; start: what the matrix gives each example."""
        n_blocks = len(self.starts)
        least = np.partition(start, -k)[-k] if len(start) > k else 0.0
        bound = np.maximum.reduceat(start, self.starts) + q @ self.most[terms]
        blocks = np.flatnonzero(bound >= least - 1e-9)
        if len(blocks) == n_blocks:
            first, last = self.lists[terms * n_blocks], self.lists[terms * n_blocks + n_blocks]
        else:
            own = (terms[:, None] * n_blocks + blocks).ravel()
            first, last, q = self.lists[own], self.lists[own + 1], np.repeat(q, len(blocks))
        rows = ranges(first, last)
        score = start + np.bincount(self.at.take(rows), np.repeat(q, last - first) * self.weight.take(rows), len(start))
        found = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
        found = found[score[found] > 0]
        found = found[np.lexsort((found, -score[found]))[:k]]
        return score[found], found

    def nearest(self, queries: list[Vector], k: int) -> list[Vector]:
        q = np.zeros((len(queries), len(self.matrix)))
        rest = []
        for i, (t, w) in enumerate(queries):
            column = self.column[t]
            own = column >= 0
            q[i, column[own]] = w[own]
            rest.append((t[~own], w[~own]))
        return [self._best(t, w, s, k) for (t, w), s in zip(rest, q @ self.matrix, strict=True)]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising least-squares fit, each pool's mean drawn to 1/2 by one example."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for v, label in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([float(label), 1.0, v, v])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    at, to = [], []
    for total, n, low, high in pools:
        share = (total + 0.5) / (n + 1)
        at += [low, high]
        to += [share, share]
    return np.array(at), np.maximum.accumulate(np.array(to))


class Model:
    def __init__(self, terms: dict[str, int], weight: np.ndarray, settings: Settings) -> None:
        self.terms, self.weight, self.k, self.far = terms, weight, settings.k, settings.far
        self.none = 0.0
        self.index: Index | None = None
        self.knots: tuple[np.ndarray, np.ndarray] | None = None
        self._words = Interned()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": Interned()}

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of words, as terms_of() gives them, and how many each has."""
        get, starts, flat, length, done = self.terms.get, {}, [], [], 0
        for piece in _PIECES.findall(" ".join([*words, ""]).lower()):
            if piece == " ":
                length.append(len(flat) - done)
                done = len(flat)
                continue
            if (own := get(piece)) is not None:
                flat.append(own)
            start = piece[:-1][:6]
            if (more := starts.get(start)) is None:
                found = (get("^" + start[:n]) for n in range(3, len(start) + 1))
                more = starts[start] = [t for t in found if t is not None]
            flat += more
        return np.array(flat, dtype=np.uint32), np.array(length, dtype=np.int64)

    def counts(self, texts: list[str]) -> list[Vector]:
        """The terms of each text, ascending, and how often each occurs."""
        self._words.bound(_CACHE_WORDS)
        words, of_word, at = split(pa.array(texts, pa.large_string()))
        codes = self._words.codes(words.to_pylist(), self._learn)[of_word]
        terms, ends = self._words.gather(codes)
        n = max(1, len(self.terms))
        found = np.repeat(np.arange(len(texts)) * n, np.diff(ends[at])) + terms
        found.sort()
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, dtype=np.int64)
        size, found = np.diff(np.append(first, len(found))), found[first]
        ends = np.searchsorted(found, np.arange(len(texts) + 1) * n).tolist()
        return [(found[a:z] - i * n, size[a:z]) for i, (a, z) in enumerate(itertools.pairwise(ends))]

    def vector(self, counts: Vector) -> Vector:
        raw = (1 + np.log(counts[1])) * self.weight[counts[0]]
        return counts[0], raw / np.sqrt((raw * raw).sum())

    def vote(self, near: Vector) -> float:
        square = near[0] ** 2
        return float((square * self.index.labels[near[1]]).sum() / (square.sum() + self.far))

    def fit(self, rows: list[tuple[int | None, int, Vector]], n_none: int, toxic_none: int, block: int) -> Model:
        self.none = toxic_none / n_none if n_none else 0.0
        if rows:
            self.index = Index([self.vector(c) for _, _, c in rows], [y for _, y, _ in rows], [d for d, _, _ in rows], block, len(self.terms))
            votes, labels = [], []
            for at in range(0, len(rows), _BATCH):
                for i, (score, near) in enumerate(self.index.nearest(self.index.rows[at : at + _BATCH], self.k + 1), at):
                    others = near != i
                    if others.any():
                        votes.append(self.vote((score[others][: self.k], near[others][: self.k])))
                        labels.append(int(self.index.labels[i]))
            self.knots = isotonic(np.array(votes), np.array(labels)) if votes else None
            self.index.rows = []  # the postings have them; the model goes to every task
        return self

    def score(self, texts: list[str]) -> list[tuple[float, str]]:
        """Share of toxic texts among those with such neighbours, and the three nearest as doc_id:cosine:label."""
        out = [(self.none, "")] * len(texts)
        if self.index is None or self.knots is None:
            return out
        vectors = [(i, self.vector(c)) for i, c in enumerate(self.counts(texts)) if len(c[0])]
        near = (x for at in range(0, len(vectors), _BATCH) for x in self.index.nearest([v for _, v in vectors[at : at + _BATCH]], self.k))
        for (i, _), near in zip(vectors, near, strict=True):
            if len(near[0]):
                seen = ",".join(f"{self.index.names[j]}:{s:.4f}:{self.index.labels[j]}" for s, j in zip(near[0][:3].tolist(), near[1][:3].tolist(), strict=True))
                out[i] = float(np.interp(self.vote(near), *self.knots)), seen
        return out


def sampled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, n: int, seed: int) -> DataFrame:
    """doc_id, text, label of at most about n labelled documents, by a seeded hash of doc_id.

    The sample is a row of (long, int) for each label, n at most, so it is small enough to broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().where(usable)
    once = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    bound = once.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n).withColumnRenamed("doc_id", "of")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(bound), F.col("doc_id") == F.col("of")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings = Settings()) -> Model:
    examples = sampled(docs, labels, "toxic", usable, settings.max_examples, settings.seed)
    examples = examples.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).select("doc_id", "text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(n: Counter, toxic: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(n.values(), pa.int64()), pa.array([toxic[t] for t in n], pa.int64())], ["term", "n", "toxic"])

        n, toxic = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                own = {t for w in set(text.as_py().split()) for t in terms_of(w)} | {""}
                n.update(own)
                if y:
                    toxic.update(own)
                if len(n) > 500_000:
                    yield out(n, toxic)
                    n, toxic = Counter(), Counter()
        if n:
            yield out(n, toxic)

    sums = map_arrow(examples, count, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").cast("double").alias("n"), F.sum("toxic").cast("double").alias("toxic"))
    sums = sums.where(F.col("n") >= settings.least_df)
    whole = map_arrow(examples, lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "t": pa.array([sum(b.column(2).to_pylist())], pa.int64())}) for b in bs), "n long, t long").agg(F.sum("n"), F.sum("t")).first()
    total, positive = float(whole[0] or 0), float(whole[1] or 0)
    if not positive or positive == total:
        model = Model({}, np.zeros(0), settings)
        model.none = positive / total if total else 0.0
        return model
    a, b, p, q = F.col("toxic"), F.col("n") - F.col("toxic"), F.lit(positive), F.lit(total - positive)
    chi = F.lit(total) * (a * (q - b) - b * (p - a)) ** 2 / ((a + b) * (F.lit(total) - a - b) * p * q)
    known = sums.where((F.col("term") != "") & (F.col("n") < total)).withColumn("chi", chi).orderBy("term").toPandas()
    terms = {t: i for i, t in enumerate(known["term"].tolist())}
    idf = 1 + np.log((1 + total) / (1 + known["n"].to_numpy()))
    model = Model(terms, idf * (known["chi"].to_numpy() + 0.05) ** settings.told, settings)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, _TEXTS):
                own = b.slice(at, _TEXTS)
                for d, y, (t, c) in zip(own.column(0).to_pylist(), own.column(2).to_pylist(), model.counts(own.column(1).to_pylist()), strict=True):
                    rows.append((d, y, t.astype("<i4").tobytes(), c.astype("<i4").tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["doc_id", "label", "t", "c"])

    rows = map_arrow(examples, vectors, "doc_id long, label long, t binary, c binary").collect()
    some = [(r.doc_id, r.label, tuple(np.frombuffer(x, dtype="<i4").astype(np.int64) for x in (r.t, r.c))) for r in sorted(rows, key=lambda r: r.doc_id) if r.t]
    bare = [r.label for r in rows if not r.t]
    return model.fit(some, len(bare), sum(bare), settings.block)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for at in range(0, b.num_rows, _TEXTS):
                got += model.score([x or "" for x in b.column(1).slice(at, _TEXTS).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.string())], ["doc_id", "score", "evidence"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, evidence string")

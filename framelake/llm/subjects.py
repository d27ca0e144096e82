"""Subject areas of documents by seeded non-negative factorisation.

Texts are cut into sentences; markup, headers, logs and number dumps are left
out and digits dropped.  The document-term matrix over words and word pairs
(Chinese: character pairs and triples) is written once in coordinate form and
factored with one anchored component per subject, seeded by the readers' labels:
alternating multiplicative updates (Kullback-Leibler) give the documents'
mixtures from the terms that are specific for a subject, and the components from
all terms.  Updates run over all documents in parallel and read numbers only.

The vocabulary holds every term that stands in at least three sentences and in
``share`` of all: a sentence has some twenty terms, so it cannot have more than
about ``20 / share`` of them, whatever the corpus.  Only sums per component and
term reach the driver.

The components directly yield each document's mixture and each sentence's
subject: a specific word counts unless a frequent word pair it stands in is
specific for nothing, so that a subject's word in an everyday phrase does not
count.  A document treats a subject that takes at least a quarter of its
sentences that treat any.

Defined results: null, empty and blank texts treat none; labels with unknown or
null subjects are left out; repeated labels count once; without any label the
areas' descriptions are the seeds; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.leakage import _TAG, fold
from framelake.runtime import materialize, spread

_NOISE = re.compile(r"^\s*(\[\d\d:\d\d|Lattice=|From:|Subject:|To:|Date:|Re:|#|```|\|)|Properties=species")
_SPLIT = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])")
_ITEM = re.compile(r"^\s*(?:[>*\-•]+\s*|\d{1,2}\.\s+)+")
_HAN = re.compile("[㐀-鿿]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d+")
_WORD = re.compile("[a-z]{2,}")


_SHARES = "doc_id bigint, subject string, share double, sentences bigint, mixture double"

#: Weight of the labelled seeds in every pass.
ANCHOR = 3.0


def prose(text: str | None) -> list[str]:
    """Sentences as they stand; lines that are no prose are left out."""
    out = []
    for line in _TAG.sub("", text or "").splitlines():
        if _NOISE.search(line):
            continue
        line = _ITEM.sub("", line)
        if len(_LETTERS.sub("", line)) * 2 > len(line.replace(" ", "")):
            continue
        out += [s for s in _SPLIT.split(line) if s]
    return out


def sentences(text: str | None) -> list[str]:
    """Normalised sentences without digits."""
    # sentences hold no line breaks, so they can be folded together
    folded = fold("\n".join(s.replace("-", " ") for s in prose(text)))
    out = []
    for s in folded.split("\n"):
        if not s.strip():
            continue
        if not s.isalpha() and _DIGIT.search(s):
            s = _DIGIT.sub("", " ".join(w for w in s.split() if not _DIGIT.search(w) or _HAN.search(w)))
        clean = " ".join(s.split())
        if clean:
            out.append(clean)
    return out


def runs(sentence: str) -> list[str]:
    """The sentence's words as one run, and each run of Chinese characters."""
    words = _WORD.findall(sentence)
    han = [] if sentence.isascii() else [r for r in _HAN.findall(sentence) if len(r) > 1]
    return ([" ".join(words)] if words else []) + han


def links(run: str) -> tuple[list[str], list[str]]:
    """Single terms of a run, and the terms that join each with the next."""
    if _HAN.match(run):
        return [run[i : i + 2] for i in range(len(run) - 1)], [run[i : i + 3] for i in range(len(run) - 2)]
    words = run.split(" ")
    return words, [f"{a} {b}" for a, b in zip(words, words[1:])]


def terms(sentence: str) -> set[str]:
    """All terms of a sentence."""
    return {t for r in runs(sentence) for part in links(r) for t in part}


class Model:
    """Components and what follows from them: specificity and subject of each term."""

    #: Parts of the largest possible information gain from which a term is specific, and below which a pair
    #: seen TRUST times vetoes its words; prior weight.
    GAIN, VETO, TRUST, PRIOR = 0.2, 0.1, 8, 4.0

    def __init__(self, plain: np.ndarray, shared: np.ndarray) -> None:
        """``plain`` spreads each term by its documents' mixtures alone, ``shared`` by the components as well.

        The first shows which terms are specific (it does not reinforce chance), the second for what.
        """
        total = plain.sum(1)
        self.base = (total + 1e-9) / (total + 1e-9).sum()
        self.count = plain.sum(0)
        smooth = lambda x: (x + self.PRIOR * self.base[:, None]) / (x.sum(0) + self.PRIOR)
        self.p, p = smooth(shared), smooth(plain)
        self.gain = (p * np.log(p / self.base[:, None])).sum(0) / np.log(max(2, len(p)))
        self.h = (shared + 1e-6) / (shared + 1e-6).sum(1, keepdims=True)

    def votes(self, sent: np.ndarray, own: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sentences (``sent`` ascending) that treat a subject, and which.

        ``own`` are single terms in their order, ``link`` the term that joins each
        with the next of its run (-1: none or not in the vocabulary).
        """
        # a run's last term joins nothing, so the link before a run's first is -1 as well
        before = np.r_[-1, link[:-1]] if len(link) else link
        clear = np.ones(len(own), bool)
        for at in (before, link):
            clear &= (at < 0) | (self.count[at] < self.TRUST) | (self.gain[at] >= self.VETO)
        use = np.flatnonzero((own >= 0) & clear & (self.gain[own] > self.GAIN))
        if not len(use):
            return sent[:0], own[:0]
        first = np.r_[0, np.flatnonzero(np.diff(sent[use])) + 1]
        score = np.add.reduceat((self.gain[own[use]] * self.p[:, own[use]]).T, first)
        return sent[use][first], score.argmax(1)


def update(model: Model, rows: np.ndarray, cols: np.ndarray, weight: np.ndarray, anchors: np.ndarray, steps: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One alternation for a block of documents (``rows`` ascending): mixtures, terms, and the sums of the terms.

    Mixtures from the specific terms; then each term's share by mixtures alone and by mixtures and components.
    """
    n, k = anchors.shape
    sure = model.gain[cols] > model.GAIN
    r, hc, own_weight = rows[sure], model.h[:, cols[sure]].T, weight[sure]
    w = np.zeros((n, k))
    if len(r):
        start = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
        own = r[start]
        v, at = anchors[own], np.repeat(np.arange(len(own)), np.diff(np.r_[start, len(r)]))
        for _ in range(steps):
            y = np.maximum(np.einsum("ij,ij->i", v[at], hc), 1e-300)
            v = v * (np.add.reduceat(hc * (own_weight / y)[:, None], start) + 1e-12)
            v /= np.maximum(v.sum(1, keepdims=True), 1e-300)
        w[own] = v
    plain = w[rows] * weight[:, None]
    shared = plain * model.h[:, cols].T
    shared *= plain.sum(1, keepdims=True) / np.maximum(shared.sum(1, keepdims=True), 1e-300)
    return (w, *collect(cols, np.concatenate([plain, shared], axis=1)))


def collect(cols: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns and, for each, the sums of its rows of ``values``."""
    if not len(cols):
        return cols, values.T
    order = np.argsort(cols, kind="stable")
    c = cols[order]
    first = np.r_[0, np.flatnonzero(np.diff(c)) + 1]
    return c[first], np.add.reduceat(values[order], first).T


def _labels(labels: DataFrame, areas: list[str]) -> DataFrame:
    """``doc_id, subjects``: cleaned and distinct."""
    name = F.regexp_replace(F.lower(F.trim("subject")), r"\W+", "_")
    place = F.create_map(*(F.lit(x) for i, a in enumerate(areas) for x in (a, i)))
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.try_element_at(place, name).alias("k"))
    return rows.where(F.col("k").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_set("k")).alias("subjects"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every element of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


class _Places(dict):
    """Places of terms, -1 for what is not in the vocabulary."""

    def __missing__(self, term: str) -> int:
        return -1


def coordinates(docs: DataFrame, labels: DataFrame, names: list[str], share: float) -> tuple[DataFrame, dict[str, int]]:
    """``doc_id, subjects, term, n, sent, own, link`` of every document with a sentence, and the vocabulary.

    ``n`` counts the sentences with a term; ``sent, own, link`` are the single terms in order and what joins them.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            flat = [[(i, r) for i, s in enumerate(sentences(t.as_py())) for r in runs(s)] for t in b["text"]]
            yield pa.record_batch([b["doc_id"], pa.array([[i for i, _ in x] for x in flat], pa.list_(pa.int32())), pa.array([[r for _, r in x] for x in flat], pa.list_(pa.string()))], ["doc_id", "at", "runs"])

    texts = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")
    cut_up = materialize(texts.mapInArrow(cut, "doc_id bigint, at array<int>, runs array<string>").where(F.size("runs") > 0), "subject-runs")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter[str] = Counter()
            total = 0
            for at, mine in zip(b["at"].to_pylist(), b["runs"].to_pylist()):
                for _, group in groupby(zip(at, mine), key=lambda x: x[0]):
                    c.update({t for _, r in group for part in links(r) for t in part})
                    total += 1
            c[""] = total  # the number of sentences
            yield pa.record_batch([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["term", "n"])

    counted = materialize(cut_up.mapInArrow(spell, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("count")).where("count >= 3"), "subject-terms")
    total = counted.where("term = ''").agg(F.max("count")).first()[0] or 0
    kept = counted.where((F.col("term") != "") & (F.col("count") >= share * total))
    place = {r["term"]: i for i, r in enumerate(kept.orderBy("term").toLocalIterator())}
    shipped = spark.sparkContext.broadcast(place)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Places(shipped.value).__getitem__
        kinds = [pa.list_(pa.int32())] * 5
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            out: list[list] = [[] for _ in kinds]
            for at, mine in zip(b["at"].to_pylist(), b["runs"].to_pylist()):
                c: Counter[int] = Counter()
                sent, own, link = [], [], []
                for i, group in groupby(zip(at, mine), key=lambda x: x[0]):
                    held: set[int] = set()
                    for _, r in group:
                        one, two = (list(map(find, part)) for part in links(r))
                        held.update(one, two)
                        sent += [i] * len(one)
                        own += one
                        link += [*two, -1]
                    c.update(held)
                c.pop(-1, None)
                for x, values in zip(out, (list(c), list(c.values()), sent, own, link)):
                    x.append(values)
            yield pa.record_batch([b["doc_id"], *(pa.array(x, t) for x, t in zip(out, kinds))], ["doc_id", "term", "n", "sent", "own", "link"])

    coded = cut_up.mapInArrow(encode, "doc_id bigint, term array<int>, n array<int>, sent array<int>, own array<int>, link array<int>")
    return materialize(coded.join(_labels(labels, names), "doc_id", "left"), "subject-coordinates"), place


def subject_shares(docs: DataFrame, labels: DataFrame, areas: list[tuple[str, str]], *, passes: int = 3, share: float = 2e-6) -> DataFrame:
    """``doc_id, subject, share, sentences, mixture``: part of the document's treating sentences that each subject takes, and its weight in the factorisation."""
    names = [a for a, _ in areas]
    k = len(names)
    spark = docs.sparkSession
    areas = [(a, t or "") for a, t in areas]
    prepared, place = coordinates(docs, labels, names, share)
    if not place:
        return spark.createDataFrame([], _SHARES)

    def gather(function) -> np.ndarray:
        """Sums of ``function``'s blocks, plain and shared components x terms, over all documents."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros((2 * k, len(place))), np.zeros(len(place), bool)
            for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
                rows, cols = _flat(b["term"])
                t, sums = function(rows, cols, _flat(b["n"])[1].astype(float), b["subjects"].to_pylist())
                total[:, t] += sums
                seen[t] = True
            at = np.flatnonzero(seen)
            yield pa.record_batch([pa.array(at), *(pa.array(total[j, at]) for j in range(2 * k))], ["t", *(f"v{j}" for j in range(2 * k))])

        schema = "t bigint, " + ", ".join(f"v{j} double" for j in range(2 * k))
        got = prepared.select("term", "n", "subjects").mapInArrow(run, schema).groupBy("t").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(2 * k))).toArrow()
        out = np.zeros((2 * k, len(place)))
        at = got["t"].to_numpy()
        for j in range(2 * k):
            out[j, at] = got[f"v{j}"].to_numpy()
        return out

    def seed(rows: np.ndarray, cols: np.ndarray, weight: np.ndarray, subjects: list) -> tuple[np.ndarray, np.ndarray]:
        w = np.zeros((len(subjects), k))
        for i, s in enumerate(subjects):
            if s:
                w[i, s] = 1 / len(s)
        mine = w.any(1)[rows]
        part = w[rows[mine]] * weight[mine][:, None]
        return collect(cols[mine], np.concatenate([part, part], axis=1))

    def anchored(now: Model, subjects: list) -> np.ndarray:
        anchors = np.tile(now.base, (len(subjects), 1))
        for i, s in enumerate(subjects):
            if s:  # labels are incomplete and partly wrong, so they only favour
                anchors[i] *= 0.2
                anchors[i, s] += 0.8 / len(s)
        return anchors

    first = gather(seed)
    for j, (name, text) in enumerate(areas):
        for t in terms(fold(f"{name.replace('_', ' ')} {text}")):
            if t in place:
                first[[j, k + j], place[t]] += 1
    model = Model(first[:k], first[k:])
    for _ in range(passes):
        shipped = spark.sparkContext.broadcast(model)

        def alternate(rows, cols, weight, subjects, shipped=shipped) -> tuple[np.ndarray, np.ndarray]:
            return update(shipped.value, rows, cols, weight, anchored(shipped.value, subjects))[1:]

        sums = gather(alternate)
        sums += ANCHOR * first
        model = Model(sums[:k], sums[k:])
    last = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last.value
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            rows, cols = _flat(b["term"])
            w = update(now, rows, cols, _flat(b["n"])[1].astype(float), anchored(now, b["subjects"].to_pylist()))[0]
            doc, own = _flat(b["own"])
            sent, what = now.votes(doc * 2**32 + _flat(b["sent"])[1], own, _flat(b["link"])[1])
            votes = np.bincount((sent >> 32) * k + what, minlength=b.num_rows * k).reshape(-1, k)
            i, j = np.nonzero(votes)
            n = votes[i, j]
            yield pa.record_batch(
                [b["doc_id"].take(pa.array(i)), pa.array([names[x] for x in j], pa.string()), pa.array(n / votes.sum(1)[i]), pa.array(n), pa.array(w[i, j])],
                ["doc_id", "subject", "share", "sentences", "mixture"],
            )

    return prepared.select("doc_id", "term", "n", "subjects", "sent", "own", "link").mapInArrow(judge, _SHARES)

"""Problem 9: abusive, hateful or sexually explicit passages, scored for every document, with rates per source.

Method: non-negative positive-unlabelled learning. A page is toxic through one passage among many, so its windows
(sentences, in reading order) are the instances: those of confirmed toxic pages that speak most for it are the
positives; all windows of all labelled pages, their labels left aside, are the unlabelled set. A linear classifier is
trained in numpy on the class-prior-corrected non-negative risk, the positives are chosen again with it, and
the prior is taken from its own predictions. A document's score is that of its highest window.

Features are words and pairs of neighbours that give evidence - they are on far more confirmed pages than their
count over all documents lets expect - and, in windows with any evidence, the words beside it, which tell a report,
a defence or a trade from abuse. A window without evidence has the classifier's bias as its score; such windows
are all alike and enter the risk by their number.

One bounded sample, a parameter: about MAX_LABELLED labelled documents are used for fitting. The counts of features
cover all documents, and every document is scored, whole.

Defined results: null, empty and blank texts score 0 and are no cases; a document with differing labels counts as
toxic when at least half of its labels say so; without a positive label, or with so few that no feature gives
evidence, nothing is found and a warning is logged.
"""

from __future__ import annotations

import logging
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import scratch_path
from inkloom.llm.confusions import skeleton
from inkloom.llm.leaks import _columns, page_texts

MAX_LABELLED = 4_000
ROUNDS, EPOCHS, RATE, L2 = 3, 120, 0.05, 3e-6
#: A feature speaks for the class when it is on so many times the expected number of confirmed pages, at least on
#: so many, and the chance (Poisson) of that many is below one in the number of features tried.
RATIO, LEAST_PAGES = 5.0, 3
#: The least class prior.
LEAST_PRIOR = 5e-4
#: How much of the best F1 on held-out pages may be given up for a higher threshold.
SLACK = 0.012
#: A threshold is not taken below this share of the usual score of confirmed pages.
LEAST_SHARE = 0.2
NUMBER = re.compile(r"(?<!\w)[£$€]?\d[\d,.]*(?:st|nd|rd|th|s|d)?(?!\w)")
SENTENCE = re.compile(r"[^.!?]+[.!?]*")
WORD = re.compile(r"[^\W_]+")
#: Letters parted or replaced by signs inside a word, as disguised abuse has them.
DISGUISED = re.compile(r"\b[^\W\d_]+(?:[*@$#]+[^\W_]*)+|\b[^\W\d_]+[01345][^\W_]*[01345@$][^\W_]*")
#: A word spelt in single letters; the sign behind its last letter is not part of it.
SPELT = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-*][^\W_]){2,}(?![^\W_])")
LONG, STEP = 36, 24
#: A part of fewer letters, or of one word, is no window of its own.
LEAST = 12


def _joined(m: re.Match) -> str:
    """A spelt word put together; of four letters and more it is marked as disguised, shorter ones are mostly abbreviations."""
    word = re.sub(r"[.\-*]", "", m[0])
    return word + "*" if len(word) > 3 or "*" in m[0] else word


def windows(text: str) -> list[list[str]]:
    """Word lists of a text's windows: sentences, long ones cut with overlap, each word folded to its skeleton.

    A short sentence, or one of a single word, goes with the next one, at the end of the text with the one before.
    """
    parts: list[list[str]] = []
    short, size = [], 0
    for m in SENTENCE.finditer(SPELT.sub(_joined, text)):
        part = m[0]
        words = short + skeleton(NUMBER.sub(" ", part)).split()
        if DISGUISED.search(part):
            words.append("*")
        size += len(part)
        if size < LEAST or len(words) < 2:
            short = words
        else:
            parts.append(words)
            short, size = [], 0
    if short and parts:
        parts[-1] = parts[-1] + short
    elif short:
        parts.append(short)
    out: list[list[str]] = []
    for words in parts:
        if len(words) <= LONG:
            out.append(words)
        else:
            out.extend(words[a : a + LONG] for a in range(0, len(words) - LONG + STEP, STEP))
    return out


def features(words: list[str]) -> set[str]:
    """Words and pairs of neighbours."""
    out = set(words)
    out.update(map(" ".join, zip(words, words[1:])))
    return out


class Vocabulary:
    """Features by number, and which of them a window has."""

    def __init__(self, names: list[str]):
        self.index = {f: i for i, f in enumerate(names)}
        self.firsts = {f.split(" ", 1)[0] for f in names if " " in f}

    def of(self, words: list[str]) -> set[int]:
        index, firsts = self.index, self.firsts
        out = {index[w] for w in words if w in index}
        for a, b in zip(words, words[1:]):
            if a in firsts and (k := index.get(f"{a} {b}")) is not None:
                out.add(k)
        return out


#: The score of a text without any window.
NO_CASE = -50.0


class Model:
    """Feature weights, which of the features give evidence, a bias and the score from which a document is a case."""

    def __init__(self, weights: dict[str, float], speaking: set[str], bias: float, threshold: float = 0.0):
        self.vocabulary = Vocabulary(list(weights))
        self.weights = list(weights.values())
        self.speaking = frozenset(i for f, i in self.vocabulary.index.items() if f in speaking)
        self.bias, self.threshold = bias, threshold

    def score(self, words: list[str]) -> float:
        own = self.vocabulary.of(words)
        return self.bias + (0.0 if self.speaking.isdisjoint(own) else sum(self.weights[i] for i in own))

    def page(self, page: list[list[str]]) -> float:
        """Logit of the highest of a page's windows."""
        return max(map(self.score, page), default=NO_CASE)


def _sparse(rows: list[set[str]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    cols, at = [], [0]
    for r in rows:
        cols.extend(index[f] for f in r if f in index)
        at.append(len(cols))
    return np.array(cols, np.int64), np.array(at, np.int64)


def _logits(data: tuple[np.ndarray, np.ndarray], w: np.ndarray, bias: float) -> np.ndarray:
    cols, at = data
    sums = np.concatenate([[0.0], np.cumsum(w[cols])])
    return sums[at[1:]] - sums[at[:-1]] + bias


def _push(data: tuple[np.ndarray, np.ndarray], g: np.ndarray, n: int) -> np.ndarray:
    cols, at = data
    return np.bincount(cols, np.repeat(g, np.diff(at)), n)


def fit_nnpu(pos: tuple[np.ndarray, np.ndarray], unl: tuple[np.ndarray, np.ndarray], plain: int, n: int, prior: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Linear weights minimising the non-negative PU risk with logistic loss, by full-batch Adam.

    The unlabelled set are the rows of unl and as many without any feature as plain says.
    """
    w, bias = np.zeros(n), -3.0
    m, v, t = np.zeros(n + 1), np.zeros(n + 1), 0
    n_pos, n_unl = len(pos[1]) - 1, len(unl[1]) - 1 + plain
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        zp, zu = _logits(pos, w, bias), _logits(unl, w, bias)
        sp, su, s0 = sigmoid(zp), sigmoid(zu), plain * sigmoid(bias)
        risk_unl = (np.logaddexp(0, zu).sum() + plain * np.logaddexp(0, bias)) / n_unl
        # Where the estimated risk of the negatives falls below zero its gradient is turned round.
        sign = 1 if risk_unl >= prior * np.mean(np.logaddexp(0, zp)) else -1
        gp = prior * ((sp - 1) - sign * sp) / n_pos
        gu = sign * su / n_unl
        grad = np.append(_push(pos, gp, n) + _push(unl, gu, n) + L2 * w, gp.sum() + gu.sum() + sign * s0 / n_unl)
        t += 1
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        bias -= step[-1]
    return w, float(bias)


#: A page is the word lists of its windows.
Page = list[list[str]]


def page_counts(pages: list[Page]) -> Counter:
    """On how many pages each feature is."""
    out: Counter = Counter()
    for p in pages:
        out.update(set().union(*map(features, p)))
    return out


def speaking_features(on_pos: Counter, n_pos: int, on_all: dict[str, int], n_all: int, tried: int) -> dict[str, float]:
    """Features on far more pages of the class than their count on all other pages lets expect, with the log of the excess."""
    out: dict[str, float] = {}
    for f, n in on_pos.items():
        expected = n_pos * (max(0, on_all.get(f, 0) - n) + 0.5) / max(1, n_all - n_pos)
        if n >= LEAST_PAGES and n > RATIO * expected and n * math.log(expected) - expected - math.lgamma(n + 1) < -math.log(max(2, tried)):
            out[f] = math.log(n / expected)
    return out


def train(positives: list[Page], unlabelled: list[Page], speaks: dict[str, float]) -> Model | None:
    """A model from the pages confirmed as toxic and the windows of unlabelled ones."""
    keys = speaks.keys()
    with_evidence = lambda page: [r for r in map(features, page) if not keys.isdisjoint(r)]
    pages = [p for p in map(with_evidence, positives) if p]
    rows = [r for p in unlabelled for r in with_evidence(p)]
    n_all = sum(map(len, unlabelled))
    if not pages:
        return None
    value = [[sum(sorted((speaks[f] for f in r if f in speaks), reverse=True)[:5]) for r in p] for p in pages]
    beside = Counter(f for r in rows for f in r)
    index = {f: i for i, f in enumerate(dict.fromkeys([*speaks, *(f for f, n in beside.items() if n >= 6)]))}
    data_unl = _sparse(rows, index)
    used = prior = max(LEAST_PRIOR, 0.1 * len(rows) / max(1, n_all))
    w, bias, last = None, 0.0, []
    for turn in range(ROUNDS):
        chosen = []
        if turn:
            value = [_logits(_sparse(p, index), w, bias).tolist() for p in pages]
        for p, v in zip(pages, value, strict=True):
            top = max(v)
            if top > 0:  # a page without any is most likely labelled wrongly
                chosen.extend(r for r, x in zip(p, v, strict=True) if x == top or x > 0.6 * top)
        if not chosen and not last:
            return None
        if not chosen:
            # The class is more frequent in the unlabelled set than was taken: again with a higher prior.
            chosen, prior = last, min(0.9, 4 * used)
        last, used = chosen, prior
        w, bias = fit_nnpu(_sparse(chosen, index), data_unl, n_all - len(rows), len(index), prior)
        prior = min(0.6, max(LEAST_PRIOR, float(np.sum(_logits(data_unl, w, bias) > 0)) / max(1, n_all)))
    return Model({f: float(w[i]) for f, i in index.items() if f in speaks or abs(w[i]) > 0.02}, set(speaks), bias)


def window_table(docs: DataFrame) -> DataFrame:
    """(doc_id, source, windows): the folded windows of every document, written once, as counts and scores both read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            rows = [[" ".join(w) for w in windows(t)] for t in page_texts(batch.select(range(n - 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(n - 1), pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "source", "windows"])

    data = _with_source(docs) if "source" in docs.columns else _columns(docs).withColumn("source", F.lit(None).cast("string"))
    schema = "doc_id long, source string, windows array<string>"
    path = scratch_path(docs.sparkSession, "p9-windows")
    data.mapInArrow(run, schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def corpus_counts(table: DataFrame, names: list[str]) -> dict[str, int]:
    """On how many of all documents each of the named features is: counted by partition, then added up by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(names)
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for page in batch.column(0).to_pylist():
                seen: set[int] = set()
                for w in page:
                    seen |= known.of(w.split(" "))
                if seen:
                    total[list(seen)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["feature", "n"])

    rows = table.select("windows").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    return {names[r[0]]: r[1] for r in rows}


def hash_sample(df: DataFrame, key: str, n_rows: int, most: int) -> DataFrame:
    """About the most rows, those of the smallest hashes of the key: the same on every run, without a sort of all rows."""
    if n_rows <= most:
        return df
    below = int(-(2**63) + 2**64 * most / n_rows)
    return df.where(F.xxhash64(key) < F.lit(below))


def fit(table: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """The model and its threshold, from the window table and a bounded sample of the labelled documents."""
    votes = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("toxic"))
    labelled = {r[0]: r[1] >= 0.5 for r in hash_sample(votes, "doc_id", labels.count(), max_labelled).collect()}
    ids = table.sparkSession.createDataFrame([(k,) for k in labelled], "doc_id long")
    pages = {r[0]: [w.split(" ") for w in r[1]] for r in table.where("size(windows) > 0").join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "windows").collect()}
    pos = [pages[k] for k in sorted(pages) if labelled[k]]
    neg = [pages[k] for k in sorted(pages) if not labelled[k]]
    candidates = [f for f, n in page_counts(pos).items() if n >= LEAST_PAGES]
    model = fit_pages(pos, neg, corpus_counts(table, candidates), table.where("size(windows) > 0").count()) if candidates else None
    if model is None:
        logging.getLogger(__name__).warning("p9: %d confirmed pages give no feature that speaks for the class; nothing will be found", len(pos))
    return model


def fit_pages(pos: list[Page], neg: list[Page], on_all: dict[str, int], n_all: int) -> Model | None:
    """The model with its threshold, which is taken from documents that the scoring model has not seen: two halves."""
    part = lambda x, half: [t for i, t in enumerate(x) if i % 2 != half]
    counts = [page_counts(part(pos, h)) for h in (0, 1)]
    tried = len(on_all)
    held: list[tuple[float, bool]] = []
    for half in (0, 1):
        speaks = speaking_features(counts[half], len(part(pos, half)), on_all, n_all, tried)
        model = train(part(pos, half), part(neg, half) + part(pos, half), speaks)
        if model:
            held += [(model.page(p), y) for own, y in ((pos, True), (neg, False)) for i, p in enumerate(own) if i % 2 == half]
    model = train(pos, neg + pos, speaking_features(counts[0] + counts[1], len(pos), on_all, n_all, tried))
    if model:
        own = sorted(x for x in map(model.page, pos) if x > model.bias)
        usual = own[len(own) // 2] if own else 0.0
        model.threshold = max(best_threshold(held, model.bias), LEAST_SHARE * usual)
    return model


def best_threshold(held: list[tuple[float, bool]], least: float = NO_CASE, slack: float = SLACK) -> float:
    """The highest score at which the F1 on held-out documents is within the slack of its best.

    Highest, as labelled documents are richer in cases than the corpus, where false ones weigh more; the
    threshold lies midway to the next lower score.
    """
    order = sorted(held, reverse=True)
    total = sum(y for _, y in held)
    curve, hit = [], 0
    for i, (s, y) in enumerate(order):
        hit += y
        nxt = order[i + 1][0] if i + 1 < len(order) else s - 1
        if s > least and s > nxt:
            curve.append((2 * hit / (i + 1 + total), (s + max(nxt, s - 2)) / 2))
    best = max((f for f, _ in curve), default=0.0)
    return next((at for f, at in curve if f >= best - slack), 0.0)


def toxicity_scores(table: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, source, score, toxic) of every document of the window table; score is between 0 and 1, one half at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = ([w.split(" ") for w in p] for p in batch.column(2).to_pylist())
            raw = [model.page(p) - model.threshold if model and p else -60.0 for p in pages]
            score = [0.0 if r < -50 else float(1 / (1 + np.exp(-r))) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array([r >= 0 for r in raw])], names=["doc_id", "source", "score", "toxic"])

    return table.select("doc_id", "source", "windows").mapInArrow(run, "doc_id long, source string, score double, toxic boolean")


def _with_source(docs: DataFrame) -> DataFrame:
    if "boxes" in docs.columns and "n_columns" in docs.columns:
        return docs.select("doc_id", "text", "n_columns", docs["boxes.x0"].alias("x0"), docs["boxes.x1"].alias("x1"), docs["boxes.y0"].alias("y0"), "source")
    return docs.select("doc_id", "text", "source")


def source_rates(scores: DataFrame) -> DataFrame:
    """Documents, cases and rate of each source (null is a source of its own)."""
    return scores.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("toxic").cast("long")).alias("n_toxic"), F.avg(F.col("toxic").cast("double")).alias("rate"))

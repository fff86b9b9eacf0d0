"""Toxicity (10): a linear-chain conditional random field tags toxic words.

A chain is a sentence; labels are 0 and 1. A word's score for label 1 sums weights of its hashed features: itself, prefixes and
a suffix. Forward-backward gives each word's marginal; marginals aggregate to a document's score by a logistic fit, and words
with a marginal of a half or more are the offending spans.

Only documents carry labels, so words are labelled first: all words of clean documents are 0, and a word of a toxic document is 1
if a word or prefix feature of it stands, over distinct sentences, in toxic documents nearly always and too often for chance. Copies share their
sentences, so they count once.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkwise.llm import common

#: Labelled documents, clean and toxic, that the model is fitted on at most: those of the smallest hash of doc_id.
SAMPLE = (2_000, 2_000)
#: Bytes of their texts at most; a document that doesn't fit in what is left is passed over.
SAMPLE_BYTES = 24_000_000
#: Words whose scores a worker keeps (about 200 bytes each); longer words are not kept.
KEPT_WORDS, KEPT_LENGTH = 100_000, 64
FOLDS, HELD_OUT = 5, 0
_SIZE = 1 << 18
_TOKENS = re.compile(r"[^\W_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")
#: A feature labels words if that share of its sentences is toxic, and if chance would do so with a probability below CHANCE.
PURITY, CHANCE = 0.9, 1e-5


def features(word: str) -> list[str]:
    """A word's feature names; those before the suffix may label it."""
    return ["w" + word, *[f"p{word[:n]}" for n in (4, 5, 6) if len(word) > n], "s" + word[-3:]]


def slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) & (_SIZE - 1) for f in features(word)]


def lowered(text: str) -> str:
    """Lower case, code point by code point, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def sentences(text: str) -> list[list[str]]:
    out, own = [], []
    for token in _TOKENS.findall(lowered(text)):
        if token in _ENDS:
            if own:
                out.append(own)
                own = []
        else:
            own.append(token)
    return [*out, own] if own else out


def marginals(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over padded chains (longest first). emit: chains x positions, the score of label 1 above that of 0.

    Gives each position's probability of label 1 and, for fitting, that of each pair of neighbouring labels (chains x
    positions - 1 x 4). No position past a chain's end means anything.
    """
    n, most = emit.shape
    ahead = np.zeros((n, most, 2))
    back = np.zeros((n, most, 2))
    live = [int((lengths > i).sum()) for i in range(most)]  # chains are sorted, so those that go on come first
    ahead[:, 0] = start
    ahead[:, 0, 1] += emit[:, 0]
    for i in range(1, most):
        k = live[i]
        a = ahead[:k, i - 1]
        ahead[:k, i, 0] = np.logaddexp(a[:, 0] + trans[0, 0], a[:, 1] + trans[1, 0])
        ahead[:k, i, 1] = np.logaddexp(a[:, 0] + trans[0, 1], a[:, 1] + trans[1, 1]) + emit[:k, i]
    for i in range(most - 2, -1, -1):
        k = live[i + 1]
        one = back[:k, i + 1, 1] + emit[:k, i + 1]
        zero = back[:k, i + 1, 0]
        back[:k, i, 0] = np.logaddexp(zero + trans[0, 0], one + trans[0, 1])
        back[:k, i, 1] = np.logaddexp(zero + trans[1, 0], one + trans[1, 1])
    at_end = ahead[np.arange(n), lengths - 1]
    total = np.logaddexp(at_end[:, 0], at_end[:, 1])
    with np.errstate(over="ignore"):
        prob = np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None])
        if not with_pairs:
            return prob, None
        pairs = np.zeros((n, most - 1, 4))
        for x in (0, 1):
            for y in (0, 1):
                pairs[:, :, 2 * x + y] = np.exp(ahead[:, :-1, x] + trans[x, y] + y * emit[:, 1:] + back[:, 1:, y] - total[:, None])
    return prob, pairs


@dataclass
class Model:
    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray
    fit: np.ndarray  # of a document's score: constant, log of 1 + sum, greatest marginal
    share: float  # of toxic labels; the score of all where there is nothing to learn

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """Word scores met so far; emptied when it is full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        value = float("nan") if word in _ENDS else float(self.model.weights[slots(word)].sum())
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value

    def word_marginals(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, its words' probabilities of being toxic."""
        tokens, sizes = [], []
        for text in texts:
            own = _TOKENS.findall(lowered(text))
            tokens += own
            tokens.append("\n")
            sizes.append(len(own) + 1)
        values = np.fromiter(map(self.__getitem__, tokens), np.float64, len(tokens))
        word = ~np.isnan(values)  # sentence ends have no score
        words = np.add.reduceat(word, np.cumsum([0, *sizes[:-1]]), dtype=np.int64) if sizes else np.empty(0, int)
        flat = values[word]
        if not len(flat):
            return [np.empty(0) for _ in texts]
        before = np.concatenate([[False], word[:-1]])
        starts = (np.cumsum(word) - 1)[word & ~before]
        lengths = np.diff(np.append(starts, len(flat)))
        out = np.empty(len(flat))
        order = np.argsort(-lengths, kind="stable")
        for part in like_lengths(lengths[order]):
            rows = order[part]
            longest = lengths[rows[0]]
            index = starts[rows][:, None] + np.arange(longest)
            inside = np.arange(longest) < lengths[rows][:, None]
            padded = np.where(inside, flat[np.minimum(index, len(flat) - 1)], 0.0)
            prob = marginals(padded, lengths[rows], self.model.start, self.model.trans, with_pairs=False)[0]
            out[index[inside]] = prob[inside]
        return np.split(out, np.cumsum(words)[:-1])

    def score(self, probs: np.ndarray) -> float:
        if self.model.fit is None:
            return self.model.share
        x = np.array([1.0, np.log1p(probs.sum()), probs.max(initial=0.0)])
        return float(1 / (1 + np.exp(-np.clip(x @ self.model.fit, -30, 30))))


def like_lengths(lengths: np.ndarray, cells: int = 200_000) -> Iterator[slice]:
    """Slices of chains, longest first, that are padded to at most twice a chain's length (8 words at least) and `cells` words in all."""
    at = 0
    while at < len(lengths):
        longest = max(1, int(lengths[at]))
        end = at + max(1, cells // longest)
        if longest > 8:
            end = min(end, at + int(np.searchsorted(-lengths[at:], -longest / 2, "left")))
        end = min(len(lengths), max(end, at + 1))
        yield slice(at, end)
        at = end


def label_words(texts: list[str], toxic: list[int]) -> tuple[list[list[str]], list[list[int]]]:
    """Distinct sentences and their words' labels."""
    seen: dict[str, int] = {}
    for text, y in zip(texts, toxic, strict=True):
        for s in sentences(text):
            key = " ".join(s)
            seen[key] = min(seen.get(key, 1), int(y))  # a sentence that clean documents have is clean
    names = lambda key: {f for w in set(key.split(" ")) for f in features(w)[:-1]}
    bad, clean = Counter(), Counter()
    for key, y in seen.items():
        if y:
            bad.update(names(key))
    share = (sum(seen.values()) + 1) / (len(seen) + 2)
    least = np.log(CHANCE) / np.log(share)
    bad = {f: n for f, n in bad.items() if n >= least}
    for key, y in seen.items():
        if not y:
            clean.update(names(key) & bad.keys())
    pure = {f for f, n in bad.items() if n >= PURITY * (n + clean[f])}
    chains, labels = [], []
    once: dict[str, str] = {}  # one string object a word
    told = {w: any(f in pure for f in features(w)[:-1]) for w in {w for key, y in seen.items() if y for w in key.split(" ")}}
    while seen:
        key, y = seen.popitem()
        words = [once.setdefault(w, w) for w in key.split(" ")]
        chains.append(words)
        labels.append([int(told[w]) for w in words] if y else [0] * len(words))
    return chains, labels


def fit_field(chains: list[list[str]], labels: list[list[int]], epochs: int = 4, batch: int = 512, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, start scores and transitions by AdaGrad on the log likelihood of all chains."""
    rng = np.random.RandomState(7)
    use = np.arange(len(chains))
    known: dict[str, tuple[int, ...]] = {}
    weights, start, trans = np.zeros(_SIZE), np.zeros(2), np.zeros((2, 2))
    squares = [np.full(_SIZE, 1e-6), np.full(2, 1e-6), np.full((2, 2), 1e-6)]
    for _ in range(epochs):
        rng.shuffle(use)
        for at in range(0, len(use), batch):
            rows = sorted(use[at : at + batch], key=lambda i: -len(chains[i]))
            steps, used = [np.zeros(_SIZE), np.zeros(2), np.zeros((2, 2))], np.zeros(_SIZE, bool)
            for part in like_lengths(np.array([len(chains[i]) for i in rows])):
                own_rows = rows[part]
                lengths = np.array([len(chains[i]) for i in own_rows])
                inside = np.arange(lengths[0]) < lengths[:, None]
                own = [known.get(w) or known.setdefault(w, tuple(slots(w))) for i in own_rows for w in chains[i]]
                flat = np.array([x for s in own for x in s])
                word = np.repeat(np.arange(len(own)), [len(s) for s in own])
                emit = np.zeros(inside.shape)
                emit[inside] = np.bincount(word, weights[flat], len(own))
                y = np.zeros(inside.shape, int)
                y[inside] = [v for i in own_rows for v in labels[i]]
                prob, pairs = marginals(emit, lengths, start, trans)
                steps[0] += np.bincount(flat, ((y - prob) * inside)[inside][word], _SIZE)
                used[flat] = True
                steps[1] += np.bincount(y[:, 0], minlength=2) - np.array([(1 - prob[:, 0]).sum(), prob[:, 0].sum()])
                both = inside[:, 1:]
                steps[2] += (np.bincount((2 * y[:, :-1] + y[:, 1:])[both], minlength=4) - pairs[both].sum(axis=0)).reshape(2, 2)
            steps[0] -= 1e-3 * weights * used
            for value, square, step in zip((weights, start, trans), squares, steps, strict=True):
                square += step**2
                value += rate * step / np.sqrt(square)
    return weights.astype(np.float32), start, trans


def fit_model(texts: list[str], toxic: list[int], weights: list[float], share: float) -> Model:
    """weights: how many labelled documents each text stands for. Every third text is kept from the field, for the logistic fit."""
    if len(set(toxic)) < 2:
        return Model(np.zeros(_SIZE, np.float32), np.zeros(2), np.zeros((2, 2)), None, share)
    of_field = [i for i in range(len(texts)) if i % 3]
    of_fit = [i for i in range(len(texts)) if not i % 3]
    model = Model(*fit_field(*label_words([texts[i] for i in of_field], [toxic[i] for i in of_field])), np.zeros(3), share)
    scorer, rows = model.scorer(), []
    for at in range(0, len(of_fit), 256):
        rows += [(1.0, np.log1p(p.sum()), p.max(initial=0.0)) for p in scorer.word_marginals([texts[i] for i in of_fit[at : at + 256]])]
    x, y, w = np.array(rows), np.array([toxic[i] for i in of_fit], float), np.array([weights[i] for i in of_fit])
    fit = np.zeros(3)
    for _ in range(25):  # Newton's method on a ridge logistic likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        slope = x.T @ (w * (y - p)) - 0.1 * fit
        fit += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), slope)
    model.fit = fit
    return model


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits the model on `sample` labelled documents (clean, toxic) and most_bytes of text at most, none of the held-out fold.

    Labels are 0 and 1; null ids, null labels and other labels are passed over, and so are labels without a document. Rows that
    share a doc_id are documents of its label; null and empty texts are documents without words; repeated labels count once;
    other columns are not read. Without labels all scores are 0, with one label alone that label.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter((fold() != HELD_OUT) & F.col("toxic").isin(0, 1)).distinct()
    counts = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if not counts:
        return fit_model([], [], [], 0.0)
    by = F.xxhash64(F.col("doc_id"))
    picked = [usable.filter(F.col("toxic") == y).orderBy(by, "doc_id").limit(sample[y]).collect() for y in (0, 1)]
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for rows in picked for r in rows], T.StructType([usable.schema["doc_id"], T.StructField("toxic", T.IntegerType())]))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # as many ids as the sample has
    rows = common.stored(rows.select("doc_id", "text", "toxic", by.alias("by"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("mark")), "labelled")
    listed = rows.select("by", "doc_id", "mark", "toxic", "size").orderBy("by", "doc_id", "mark", "toxic").limit(sum(sample)).collect()  # an id may have many rows
    left, taken = most_bytes, []
    for r in listed:
        if r["size"] <= left:
            left -= r["size"]
            taken.append((r.doc_id, r.mark, r.toxic))
    fits = docs.sparkSession.createDataFrame(sorted(set(taken)), T.StructType([usable.schema["doc_id"], T.StructField("mark", T.LongType()), T.StructField("toxic", T.IntegerType())]))
    texts = {(r.doc_id, r.mark, r.toxic): r.text for r in rows.join(F.broadcast(fits), ["doc_id", "mark", "toxic"]).dropDuplicates(["doc_id", "mark", "toxic"]).collect()}
    taken.sort(key=lambda k: (k[0], texts[k]))
    mine = Counter(y for *_, y in taken)
    return fit_model([texts[k] for k in taken], [y for *_, y in taken], [counts[y] / mine[y] for *_, y in taken], counts.get(1, 0) / sum(counts.values()))


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("marginal", T.DoubleType())])
_OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.ArrayType(SPAN))])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1), predicted (1 from a score of a half) and spans, the offending words' offsets in code points.

    The whole text is scored, and nothing else. A null or empty text has the score of a text without toxic words. Columns of
    these names are replaced, others pass; repeated rows get equal scores; an empty table gives an empty result.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(scorer, texts):
        texts = [t or "" for t in texts]
        found = scorer.word_marginals(texts)
        scores = [scorer.score(p) for p in found]
        spans = []
        for text, p in zip(texts, found, strict=True):
            own = []
            if p.max(initial=0.0) >= 0.5:
                places = (m.span() for m in _TOKENS.finditer(lowered(text)) if m[0] not in _ENDS)
                own = [{"start": a, "end": b, "marginal": float(v)} for (a, b), v in zip(places, p, strict=True) if v >= 0.5]
            spans.append(own)
        return [scores, [int(s >= 0.5) for s in scores], spans]

    return common.map_columns(docs, _OUT, ["text"], run, rows=128, model=(name, lambda: sent.value.scorer()))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold() == HELD_OUT, F.lit(False))  # a row without an id is in no fold
    out = score_documents(docs, learn(docs, common.table(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", spans.alias("spans"))


def brute_marginals(emit: list[float], start, trans) -> list[float]:
    """Marginals of one chain by summing over all label sequences, for tests."""
    from itertools import product

    total, ones = 0.0, [0.0] * len(emit)
    for y in product((0, 1), repeat=len(emit)):
        v = np.exp(start[y[0]] + sum(e for e, b in zip(emit, y, strict=True) if b) + sum(trans[a][b] for a, b in zip(y, y[1:])))
        total += v
        ones = [o + v * b for o, b in zip(ones, y, strict=True)]
    return [o / total for o in ones]

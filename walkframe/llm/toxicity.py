"""Toxicity: a linear-chain conditional random field tags toxic tokens.

``labels`` marks whole documents, so tokens are labelled first: of a bounded
sample of training documents, a word is a cue if it is in far more toxic than
other documents (near copies counted once), and a token is toxic if it is a cue
in a toxic document. The CRF is trained on those token labels by the gradient
of its likelihood, and its two-state forward-backward marginals are what scores
documents and gives offsets.

Words that the model has no weight for share one emission, so a run of them is a
power of one 2x2 matrix: scoring is exact and costs little where no cue occurs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.functions import ArrowUDFType

from walkframe.llm.common import slices

#: Training reads at most so many labelled documents of each label.
SAMPLE = 1200
#: and so many bytes of their texts, half for each label.
SAMPLE_BYTES = 12 << 20
#: Tokens a training sequence; longer documents are several sequences.
SEGMENT = 96
#: Words whose weight a task remembers before it forgets all.
MEMORY = 300_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)


@dataclass(frozen=True)
class Tagger:
    """State 1 is toxic. Log potentials: start, bias and feature weights of state 1, and transitions."""

    weights: dict[str, float]
    start: float
    bias: float
    transitions: tuple[tuple[float, float], tuple[float, float]]
    calibration: tuple[float, float, float]


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, held_in: bool, n: int, size: int = SAMPLE_BYTES) -> DataFrame:
    """``(doc_id, text, y)``: at most ``n`` training documents of each label and ``size / 2`` bytes of their texts, by a hash of their id.

    Texts are whole: in the order of the hash, a document that no longer fits in what is left of the bytes is passed over.
    Rows that share their id are one document, of the smallest text.
    """
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    ids = labels.where(F.col(label).isNotNull()).where(rest != held_out if held_in else rest == held_out)
    ids = ids.select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    few = [ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y in (0, 1)]
    text = F.coalesce("text", F.lit(""))
    of = docs.select("doc_id", text.alias("text")).join(F.broadcast(few[0].union(few[1])), "doc_id")  # 2n rows of two integers at most
    # 2n rows of three integers at most
    found = of.groupBy("doc_id", "y").agg(F.max(F.octet_length("text")).alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    left, chosen = [size // 2, size // 2], []
    for r in found:
        if r.bytes <= left[r.y]:
            left[r.y] -= r.bytes
            chosen.append((r.doc_id, r.y))
    picked = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("y", T.IntegerType())]))
    return docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def tokens(text: str) -> list[str]:
    """The words of ``text`` as they are cut there, in lower case."""
    low = text.lower()
    return TOKEN.findall(low) if len(low) == len(text) else [w.lower() for w in TOKEN.findall(text)]


def without_near_copies(sample: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """Leave out texts whose eight smallest word hashes mostly occur together before."""
    seen: Counter = Counter()
    kept = []
    for words, y in sample:
        low = sorted({hash_of(w) for w in words if len(w) > 4})[:8]
        if low and sum(seen[h, y] > 0 for h in low) > len(low) // 2:
            continue
        seen.update((h, y) for h in low)
        kept.append((words, y))
    return kept


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode()) * 2654435761 % (1 << 32)


def features(word: str) -> list[str]:
    """The word itself, and what it begins with (toxic stems take many endings)."""
    return [f"{word}$"] + [word[:k] for k in PREFIXES if len(word) > k]


def cues(sample: list[tuple[list[str], int]], least: int = 3, odds: float = 1.5, depth: int = 3) -> set[str]:
    """Features that tell toxic documents from others, by their smoothed log odds.

    They are taken greedily, by log odds times the toxic documents that have fewer
    than ``depth`` cues so far, until no feature adds any.
    """
    n, of = Counter(y for _, y in sample), []
    df = (Counter(), Counter())
    for words, y in sample:
        own = {f for w in set(words) for f in features(w)}
        df[y].update(own)
        if y:
            of.append(own)
    rate = lambda y, f: (df[y][f] + 0.5) / (n[y] + 1)
    odds_of = {f: math.log(rate(1, f) / rate(0, f)) for f, c in df[1].items() if c >= max(least, 0.01 * n[1])}
    odds_of = {f: o for f, o in odds_of.items() if o > odds}
    having: dict[str, list[int]] = {f: [] for f in odds_of}
    for i, own in enumerate(of):
        for f in own & odds_of.keys():
            having[f].append(i)
    short, chosen = np.full(len(of), depth), set()
    while having:
        gain = {f: odds_of[f] * np.count_nonzero(short[at]) for f, at in having.items()}
        best = max(gain, key=lambda f: (gain[f], f))
        if gain[best] < least:
            break
        chosen.add(best)
        short[having.pop(best)] -= 1
        np.maximum(short, 0, out=short)
    return chosen


def train_chain(sequences: np.ndarray, labels: np.ndarray, lengths: np.ndarray, has: np.ndarray, steps: int = 60) -> np.ndarray:
    """Maximum likelihood of (start, bias, 4 transitions, feature weights) by Adam with a small L2 penalty.

    ``sequences`` holds word numbers, 0 for a word without feature, padded to one
    length; ``has`` tells which features (columns) each word (row) has.
    """
    theta, m, v = np.zeros((3, 6 + has.shape[1]))
    n, width = sequences.shape
    live = np.arange(width)[None, :] < lengths[:, None]
    total = live.sum()
    seen = np.zeros_like(theta)
    y = labels * live
    pair = live[:, 1:]
    seen[0], seen[1] = y[:, 0].sum(), y.sum()
    for a in (0, 1):
        for b in (0, 1):
            seen[2 + 2 * a + b] = ((labels[:, :-1] == a) & (labels[:, 1:] == b) & pair).sum()
    seen[6:] = np.bincount(sequences[y > 0], minlength=len(has)) @ has
    for step in range(1, steps + 1):
        weight, of_word = has @ theta[6:], np.zeros(len(has))
        up = np.exp(np.clip(theta[1] + weight[sequences], -30, 30))
        a = np.exp(theta[2:6].reshape(2, 2))
        alpha, scale = np.zeros((width, n, 2)), np.ones((width, n))
        alpha[0, :, 0], alpha[0, :, 1] = 1, up[:, 0] * math.exp(theta[0])
        for t in range(width):
            if t:
                alpha[t] = alpha[t - 1] @ a
                alpha[t, :, 1] *= up[:, t]
                alpha[t] = np.where(live[:, t, None], alpha[t], alpha[t - 1])
            scale[t] = alpha[t].sum(1)
            alpha[t] /= scale[t][:, None]
        beta, want = np.ones((n, 2)), np.zeros_like(theta)
        for t in range(width - 1, -1, -1):
            p = alpha[t] * beta
            p1 = np.where(live[:, t], p[:, 1] / p.sum(1), 0)
            want[1] += p1.sum()
            of_word += np.bincount(sequences[:, t], p1, len(has))
            if t == 0:
                want[0] = p1.sum()
            else:
                e = np.stack([beta[:, 0], beta[:, 1] * up[:, t]], 1)
                joint = alpha[t - 1][:, :, None] * a[None] * e[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                want[2:6] += (joint * live[:, t, None, None]).sum(0).ravel()
                new = e @ a.T
                beta = np.where(live[:, t, None], new / new.sum(1, keepdims=True), beta)
        want[6:] = of_word @ has
        grad = (want - seen) / total * 100 + 0.002 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def fit(sample: Iterable[tuple[str | None, int]]) -> Tagger:
    """Train on whole texts with a document label each."""
    read = [(tokens(text or ""), int(y)) for text, y in sample]
    read = without_near_copies(read)
    number = {f: i for i, f in enumerate(sorted(cues(read)))}
    active = {w: on for w in {w for words, _ in read for w in words} if (on := [number[f] for f in features(w) if f in number])}
    word_no = {w: i + 1 for i, w in enumerate(sorted(active))}
    has = np.zeros((len(active) + 1, len(number)))
    for w, i in word_no.items():
        has[i, active[w]] = 1
    rows, marks, lengths, idle = [], [], [], 0
    for words, y in read:
        ids = np.array([word_no.get(w, 0) for w in words], dtype=np.int64)
        for at in range(0, len(ids), SEGMENT):
            part = ids[at : at + SEGMENT]
            if not part.any():
                idle += 1
                if idle > len(read):
                    continue  # segments without a cue teach only the bias: one a document is enough
            rows.append(np.pad(part, (0, SEGMENT - len(part))))
            marks.append(np.pad((part > 0) & (y == 1), (0, SEGMENT - len(part))))
            lengths.append(len(part))
    if not rows or not number:
        return Tagger({}, -8.0, -8.0, ((0.0, 0.0), (0.0, 0.0)), (-3.0, 0.0, 0.0))
    theta = train_chain(np.stack(rows), np.stack(marks).astype(np.int64), np.array(lengths), has)
    weights = {f: float(theta[6 + i]) for f, i in number.items()}
    tagger = Tagger(weights, float(theta[0]), float(theta[1]), tuple(map(tuple, theta[2:6].reshape(2, 2).tolist())), (0.0, 0.0, 0.0))
    lookup = Weights(tagger)
    x = np.array([evidence([p for _, p in marginals(tagger, t, lookup)]) for t, _ in read])
    return Tagger(*(getattr(tagger, f) for f in ("weights", "start", "bias", "transitions")), calibrate(x, np.array([y for _, y in read])))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on a document's evidence, by Newton steps with a ridge."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + 0.05 * np.eye(3)
        w += np.linalg.solve(h, a.T @ (y - p) - 0.05 * w)
    return tuple(map(float, w))


def evidence(p: list[float]) -> tuple[float, float]:
    """What a document is scored by: its largest marginal, and how many toxic tokens to expect."""
    return (max(p), math.log1p(sum(p))) if p else (0.0, 0.0)


class Weights:
    """Looks up what words weigh in a tagger, quickly where most weigh nothing."""

    def __init__(self, tagger: Tagger) -> None:
        self.of_feature = tagger.weights
        self.stems = sorted({f.rstrip("$") for f in tagger.weights}, key=len)
        self.stems = [s for i, s in enumerate(self.stems) if not any(t in s for t in self.stems[:i])]
        self.starts = {f.rstrip("$")[:4] for f in tagger.weights}
        self.of_word: dict[str, float] = {}

    def touches(self, low: str) -> bool:
        """Whether any feature can occur in the lower-cased text."""
        return any(s in low for s in self.stems)

    def of(self, word: str) -> float:
        if word not in self.of_word:
            if len(self.of_word) > MEMORY:
                self.of_word.clear()
            self.of_word[word] = sum(self.of_feature.get(f, 0.0) for f in features(word))
        return self.of_word[word]


def marginals(tagger: Tagger, words: list[str], weights: Weights) -> list[tuple[int, float]]:
    """(token, probability that it is toxic) of each token with a weight, by forward-backward over all tokens."""
    starts = weights.starts
    at = [i for i, w in enumerate(words) if w[:4] in starts and weights.of(w)]
    if not at:
        return []
    a = np.exp(np.array(tagger.transitions))
    plain = a @ np.diag([1.0, math.exp(tagger.bias)])  # one step onto a word without weight
    values, left = np.linalg.eig(plain)
    values, left = values.real, left.real
    right = np.linalg.inv(left)
    top = values.max()

    def run(k: int) -> np.ndarray:
        """k such steps, scaled by the largest eigenvalue."""
        return (left * (values / top) ** k) @ right

    ups = [math.exp(min(30.0, tagger.bias + weights.of(words[i]))) for i in at]
    alphas = []
    for j, i in enumerate(at):
        if j == 0 and i == 0:
            x = np.array([1.0, math.exp(tagger.start) * ups[0]])
        else:
            if j == 0:
                x = np.array([1.0, math.exp(tagger.start + tagger.bias)]) @ run(i - 1)
            else:
                x = alphas[-1] @ run(i - at[j - 1] - 1)
            x = x @ a * np.array([1.0, ups[j]])
        alphas.append(x / x.sum())
    beta, found = run(len(words) - 1 - at[-1]) @ np.ones(2), []
    for j in range(len(at) - 1, -1, -1):
        p = alphas[j] * beta
        found.append((at[j], float(p[1] / p.sum())))
        if j:
            beta = run(at[j] - at[j - 1] - 1) @ (a @ (np.array([1.0, ups[j]]) * beta))
            beta /= beta.sum()
    return found[::-1]


def score_text(tagger: Tagger, text: str, weights: Weights) -> tuple[float, list[tuple[int, int, float]]]:
    """Score of one whole text, and (start, end, probability) of the tokens that are more likely toxic than not."""
    found = marginals(tagger, tokens(text), weights) if weights.touches(text.lower()) else []
    b, w1, w2 = tagger.calibration
    top, count = evidence([p for _, p in found])
    score = 1 / (1 + math.exp(-max(-30.0, min(30.0, b + w1 * top + w2 * count))))
    bad = {i: p for i, p in found if p >= 0.5}
    return score, [(m.start(), m.end(), bad[i]) for i, m in enumerate(TOKEN.finditer(text)) if i in bad] if bad else []


SCORED = "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def toxicity_scores(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``(doc_id, score, spans)``: of every row, whole texts.

    * null and empty texts get the score of a text without toxic tokens, and no spans;
    * repeated rows each come back; a null ``doc_id`` stays null;
    * an empty table gives an empty result; other columns are ignored, whatever their names.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(tagger)
        for whole in batches:
            for b in slices(whole, 256):
                of = [score_text(tagger, text.as_py() or "", weights) for text in b.column(1)]
                spans = [[{"start": s, "end": e, "p": p} for s, e, p in found] for _, found in of]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in of], pa.float64()), pa.array(spans, SPANS)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Fit on at most ``sample`` labelled documents of each label that aren't held out (a bounded read to the driver)."""
    rows = bounded_sample(docs, labels, "toxic", FOLDS, HELD_OUT, True, sample).collect()
    rows.sort(key=lambda r: (hash_of(str(r.doc_id)), r.doc_id))
    return fit((r.text, r.y) for r in rows)


def score_column(text: Column, tagger: Tagger) -> Column:
    """The score of each text; only the texts go to Python, and one number comes back."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = Weights(tagger)
        for part in texts:
            yield pa.array((score_text(tagger, x.as_py() or "", weights)[0] for x in part), pa.float64())

    return F.arrow_udf(run, "double", ArrowUDFType.SCALAR_ITER)(text)


def without_toxic(docs: DataFrame, tagger: Tagger, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, with all their columns.

    * rows are judged one by one, by their text alone: repeated rows stay or go together, whatever their ids;
    * null and empty texts have the score of a text without toxic tokens;
    * an empty table gives an empty result; columns may have any other names.
    """
    return docs.where(score_column(F.col("text"), tagger) < threshold)


def op5_toxicity(spark, sf_dir):
    from walkframe.llm.common import table

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans"
    )


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}

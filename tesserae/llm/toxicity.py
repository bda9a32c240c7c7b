"""Toxicity: undo obfuscation with a noisy channel, then score the restored words.

A word that mixes letters with look-alike symbols, repeats letters, or is spaced out is a lattice: each character may
stand for itself, for a letter it looks like, or (a separator or a repeat) for nothing; a space may also stand between
words. A Viterbi search takes the path that a character trigram model and the channel find likeliest, whatever the
length. A word with letters left to the reader (`*`) has too many readings for that: its lattice is intersected with the
cues, and the greatest one counts if as many letters are shown as hidden. Other words stand for themselves.

The scorer knows cues: whole words and beginnings of words that are far commoner in texts labelled toxic, by a
likelihood-ratio test; a cue weighs the log odds of the label where it occurs. A logistic curve over a text's cues gives
the probability of label 1. Cues, curve and character model are learned from all labelled rows that aren't held out:
features are counted by Spark, the curve's Newton steps sum partitions, and only the model itself meets in one place (its
cues, and the trigrams of words that LEAST_WORD texts hold). Every text is scored whole.

Defined cases: a null or empty text has no cue and the score of a text without cues; without rows of both labels every
score is the rate of label 1 (0 without any row); repeated rows and ids each get a row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import crc_mod, discard, frugal, session, texts, written

#: A cue occurs in at least so many toxic texts and has this likelihood ratio (2 ln).
LEAST_TEXTS, LEAST_RATIO = 6, 30.0
#: The character model is over words of letters that at least so many texts hold.
LEAST_WORD = 3
#: Features that a task counts before it hands the counts on.
HELD_FEATURES = 500_000
PREFIXES = (4, 5, 6)
#: Words whose weights a worker remembers at once.
KNOWN_WORDS = 150_000
#: Letters that a symbol may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = set(".-_*~'`^,;:#%&/\\ ")
STRIPPED = ".,;:?\"'()[]{}<>-_*~&%#^/\\"
#: Logarithms of what the channel does.
SUBSTITUTED, DROPPED, REPEATED, KEPT_SYMBOL = math.log(0.2), math.log(0.2), math.log(0.3), math.log(0.02)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|])(?:[ .\-_*]{1,2}[^\W_]|[ .\-_*]{1,2}[@$!|]){3,}(?!\S)")
ODD = re.compile(r"[^\W\d_][0-9@$!|+(€.\-_*~'`^#%&]+[^\W\d_]|^[0-9@$!|+(€]+[^\W\d_]{2,}|[0-9@$!|+(€][^\W\d_]+[0-9@$!|+(€]|([^\W\d_])\1\1|(?:([^\W\d_])\2){3}")


@dataclass
class CharModel:
    """Interpolated character trigrams over words; the edges of a word are spaces."""

    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.above: Counter[str] = Counter()
        for gram, n in self.counts.items():
            self.above[gram[:-1]] += n

    @classmethod
    def of(cls, words: Counter[str]) -> CharModel:
        return cls(dict(grams_of(words.items())))

    def log(self, context: str, c: str) -> float:
        p = 1 / 5000
        for size in (0, 1, 2):
            before = context[len(context) - size :]
            if n := self.above.get(before, 0):
                p = (self.counts.get(before + c, 0) + 4 * p) / (n + 4)
        return math.log(p)


def grams_of(words: Iterable[tuple[str, int]]) -> Counter[str]:
    """Counts of up to three characters that follow each other in words, from the words' counts."""
    grams: Counter[str] = Counter()
    for word, n in words:
        padded = f"  {word} "
        for k in range(2, len(padded)):
            for size in (1, 2, 3):
                grams[padded[k + 1 - size : k + 1]] += n
    return grams


def restore_word(word: str, model: CharModel) -> str:
    """The likeliest text behind an obfuscated one; words that it runs together are separated by spaces.

    A Viterbi search: a state is what the next letter's odds depend on, and of each state the likeliest path goes on.
    All states are kept, some two dozen at a time, so the search is linear in the length.
    """
    states: dict[tuple[str, str], tuple[float, tuple]] = {("  ", ""): (0.0, ())}
    for c in word:
        following: dict[tuple[str, str], tuple[float, tuple]] = {}

        def offer(context: str, last: str, cost: float, path: tuple) -> None:
            key = context, last
            if key not in following or cost > following[key][0]:
                following[key] = cost, path

        for (context, last), (cost, path) in states.items():
            if c == last and last:
                offer(context, last, cost + REPEATED, path)
            if c in SEPARATORS:
                offer(context, "", cost + DROPPED, path)
                if c == " " and context != "  ":
                    offer("  ", "", cost + DROPPED + model.log(context, " "), (path, " "))
                continue
            for letter in LOOKS.get(c, ""):
                offer(context[1] + letter, c, cost + SUBSTITUTED + model.log(context, letter), (path, letter))
            kept = 0.0 if c.isalpha() else KEPT_SYMBOL
            offer(context[1] + c, c, cost + kept + model.log(context, c), (path, c))
        states = following
    path = max(((cost + model.log(key[0], " "), path) for key, (cost, path) in states.items()), key=lambda x: x[0])[1]
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def masked_weight(word: str, cues: CueTree) -> float:
    """The greatest weight of a cue among the words that a masked one may be, where it shows as many letters as it hides.

    The lattice is intersected with the tree of cues: a state is a node, the last symbol and how many more letters were
    shown than hidden. Every reading is followed, and no text is written out.
    """
    best = 0.0
    states = {(0, "", 0)}
    for c in word:
        following: set[tuple[int, str, int]] = set()
        for node, last, shown in states:
            if c == last and last:
                following.add((node, last, shown))
            if c in SEPARATORS:
                following.add((node, "", shown))
            letters = LETTERS if c == "*" and node else "" if c in SEPARATORS else LOOKS.get(c, "") + c
            after = shown + (-1 if c == "*" else 1)
            if letters and shown >= 0:  # one more letter: the node's beginning is that of a longer word
                best = max(best, cues.begins[node])
            for letter, child in cues.next[node].items():
                if letter in letters:
                    following.add((child, "" if c == "*" else c, after))
        states = following
    return max([best, *(cues.whole[node] for node, _, shown in states if shown >= 0)])


class CueTree:
    """The cues by their letters: weights of whole words and of beginnings at each node."""

    def __init__(self, cues: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.whole, self.begins = [0.0], [0.0]
        for cue, weight in cues.items():
            node = 0
            for letter in cue.removesuffix("$"):
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.whole.append(0.0)
                    self.begins.append(0.0)
                node = self.next[node][letter]
            (self.whole if cue.endswith("$") else self.begins)[node] = weight


def features_of(word: str) -> list[str]:
    """The whole word and its beginnings."""
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) > n)]


def plain_words(text: str) -> set[str]:
    return {w.strip(STRIPPED) for w in text.lower().split()}


@dataclass
class Model:
    cues: dict[str, float]
    weights: tuple[float, ...]
    rate: float
    chars: CharModel

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}
        self.tree = CueTree(self.cues)

    def cue(self, word: str) -> float:
        """The weight of a word as it stands in a text; obfuscated words are restored first."""
        bare = word.strip(STRIPPED + "!")
        found = self._best(bare)
        if not found:
            word = word.lstrip(STRIPPED).rstrip(STRIPPED + "!")
            if "*" in word:
                found = masked_weight(word, self.tree)
            elif ODD.search(word):
                found = self._best(restore_word(word, self.chars))
        return found

    def _best(self, word: str) -> float:
        return max((self.cues.get(x, 0.0) for x in features_of(word)), default=0.0)

    def evidence(self, text: str) -> tuple[float, float, int]:
        """The greatest weight of a word, the sum of all, and how many different words are cues."""
        text = text.lower()
        words = set(text.split())
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words.difference(known):
            known[w] = self.cue(w)
        found = [v for v in map(known.__getitem__, words) if v]
        for m in SPACED.finditer(text):
            found += filter(None, map(self._best, restore_word(m[0], self.chars).split()))
        return max(found, default=0.0), sum(found), len(found)

    def score(self, text: str) -> float:
        if not self.weights:
            return self.rate
        z = float(np.dot(self.weights, row(self.evidence(text))))
        return 1 / (1 + math.exp(-min(max(z, -40.0), 40.0)))


def row(evidence: tuple[float, float, int]) -> list[float]:
    """What the curve is over: a single strong cue and many weak ones are told apart."""
    best, total, n = evidence
    return [1.0, float(n > 0), best, best * best / 5, min(total, 30.0) / 5, math.log1p(n)]


def _ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Twice the log likelihood ratio of a feature's counts by label against one common rate."""

    def term(k: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = (pos + neg) / (n_pos + n_neg)
    return 2 * (term(pos, n_pos, pos / n_pos) + term(neg, n_neg, neg / n_neg) - term(pos, n_pos, both) - term(neg, n_neg, both))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: feature (empty: any text), texts by label."""
    total: list[Counter[str]] = [Counter(), Counter()]

    def counted() -> Iterator[pa.RecordBatch]:
        keys = list(total[0].keys() | total[1].keys())
        for k in range(0, len(keys), 50_000):
            part = keys[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([t[x] for x in part], pa.int64()) for t in total)], ["feature", "neg", "pos"])

    for batch in batches:
        for text, label in zip(texts(batch), batch.column("label").to_pylist()):
            words = plain_words(text.decode())
            total[label].update({f for w in words for f in features_of(w)})
            total[label][""] += 1
            if len(total[0]) + len(total[1]) > HELD_FEATURES:
                yield from counted()
                total[0].clear(), total[1].clear()
    yield from counted()


def _cues(n_pos: int, n_neg: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The features that are cues, and their weights."""
        for batch in batches:
            pos, neg = (batch.column(c).to_numpy().astype(float) for c in ("pos", "neg"))
            ratio = _ratio(pos, neg, n_pos, n_neg)
            commoner = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
            odds = np.maximum(np.log(pos + 0.5) - np.log(neg + 0.5), 0.1)
            found = pa.RecordBatch.from_arrays([batch.column("feature"), pa.array(odds)], ["feature", "odds"])
            yield found.filter(pa.array((ratio >= LEAST_RATIO) & (commoner > 1.5)))

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = zip(batch.column("word").to_pylist(), batch.column("n").to_pylist())
        grams = grams_of((w, n) for w, n in words if w.isalpha())
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])


def _learn(rows: DataFrame, base: float | None) -> Model:
    """The model without its curve, from all rows (label, text); without rows of both labels it has no cues."""
    counts = rows.mapInArrow(frugal(_counts), "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counts = written(counts, "toxicity-counts")
    size = counts.where("feature = ''").first()
    if base is None or not size or not size.pos or not size.neg:
        discard(counts)
        return Model({}, (), float(base or 0.0), CharModel())
    n_pos, n_neg = size.pos, size.neg
    # Features that at least LEAST_TEXTS toxic texts hold, and commoner there.
    found = counts.where((F.col("feature") != "") & (F.col("pos") >= LEAST_TEXTS) & (F.col("pos") / n_pos > 2 * F.col("neg") / n_neg))
    cues = found.mapInArrow(_cues(n_pos, n_neg), "feature string, odds double").orderBy("feature").collect()
    n = F.col("pos") + F.col("neg")
    whole = counts.where(F.col("feature").endswith("$") & (n >= LEAST_WORD)).select(F.expr("left(feature, length(feature) - 1)").alias("word"), n.alias("n"))
    grams = whole.mapInArrow(frugal(_grams), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").collect()
    discard(counts)
    return Model({r.feature: r.odds for r in cues}, (1.0,), float(base), CharModel({r.gram: r.n for r in grams}))


def _evidence(rows: DataFrame, model: Model, column: str) -> DataFrame:
    """The column and x, what the curve is over, a row per row (column, text)."""
    shared = session(rows.sparkSession).sparkContext.broadcast(model)
    rows = rows.select(column, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[float]] = {}
            out = []
            for text in texts(batch):
                if (x := seen.get(text)) is None:
                    x = seen[text] = row(shared.value.evidence(text.decode()))
                out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(column), pa.array(out, pa.list_(pa.float64()))], [column, "x"])

    return rows.mapInArrow(frugal(run), f"{column} {rows.schema[column].dataType.simpleString()}, x array<double>")


def _curve(found: DataFrame, base: float, ridge: float = 0.1, steps: int = 50) -> tuple[float, ...]:
    """Weights of the logistic curve over all rows (label, x), by Newton's method; label 1 is weighted to the share base.

    Each step sums up the partitions of the distinct rows, so no row meets the driver.
    """
    seen = written(found.groupBy("label", "x").count(), "toxicity-seen")
    sizes = {r.label: r.n for r in seen.groupBy("label").agg(F.sum("count").alias("n")).collect()}
    share = sizes[1] / (sizes[0] + sizes[1])
    by_label = np.array([(1 - base) / (1 - share), base / share])

    def sums(w: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, hessian = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for batch in batches:
                y, n = batch.column("label").to_numpy(), batch.column("count").to_numpy()
                x = batch.column("x").flatten().to_numpy().reshape(-1, len(w))
                weight, p = by_label[y] * n, 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
                gradient += x.T @ (weight * (y - p))
                hessian += (x * (weight * p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in (gradient, hessian)], ["gradient", "hessian"])

        return run

    w = np.zeros(len(row((0.0, 0.0, 0))))
    for _ in range(steps):
        # Summed in an order of their own, whichever partition comes first.
        parts = sorted((r.gradient, r.hessian) for r in seen.mapInArrow(sums(w), "gradient array<double>, hessian array<double>").collect())
        gradient, hessian = (np.sum([p[k] for p in parts], axis=0) for k in (0, 1))
        step = np.linalg.solve(hessian.reshape(len(w), -1) + ridge * np.eye(len(w)), gradient - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    discard(seen)
    return tuple(w.tolist())


def _known(labels: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """The labels to learn from, as a table whose size Spark knows: a join to few of them shuffles no texts."""
    return written(labelled.known(labels, "toxic", modulus, held_out), "toxicity-known")


def _share(labels: DataFrame, modulus: int, held_out: int) -> float | None:
    return labels.where(crc_mod("doc_id", modulus) != held_out).agg(F.avg(F.col("toxic").cast("int"))).first()[0]


def _within(rate: float) -> float:
    return min(max(rate, 1e-3), 1 - 1e-3)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> Model:
    """The model of all labelled rows that aren't held out."""
    session(docs.sparkSession)
    known = _known(labels, modulus, held_out)
    rows = written(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known, "doc_id").select("label", "text"), "toxicity-rows")
    model = _learn(rows, _share(labels, modulus, held_out))
    if model.weights:
        model.weights = _curve(_evidence(rows, model, "label"), _within(model.rate))
    discard(rows, known)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, a row per row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = session(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, float] = {}
            out = []
            for text in texts(batch):
                if (s := seen.get(text)) is None:
                    s = seen[text] = shared.value.score(text.decode())
                out.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), f"doc_id {kind}, score double")


def classified(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score reaches the threshold); the model is that of `fit`.

    Evidence is taken once a text, for the curve and for the score.
    """
    session(docs.sparkSession)
    docs, known = docs.select("doc_id", "text"), _known(labels, modulus, held_out)
    model = _learn(docs.withColumn("text", F.col("text").cast("string")).join(known, "doc_id").select("label", "text"), _share(labels, modulus, held_out))
    if model.weights:
        found = written(_evidence(docs, model, "doc_id"), "toxicity-evidence")
        model.weights = _curve(found.join(known, "doc_id").select("label", "x"), _within(model.rate))
        discard(known)
        z = sum((F.get("x", F.lit(k)) * w for k, w in enumerate(model.weights)), F.lit(0.0))
        scored = found.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0)))))
    else:
        scored = docs.select("doc_id", F.lit(model.rate).alias("score"))
    return scored.select("doc_id", (crc_mod("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score at least the threshold."""
    shared = session(docs.sparkSession).sparkContext.broadcast(fit(docs, labels))
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*(docs[c] for c in rest)).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.decode()) < threshold for t in texts(batch)], pa.bool_()))

    kept = packed.mapInArrow(frugal(run), packed.schema)
    return kept.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))

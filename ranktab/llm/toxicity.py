"""Toxicity scores by weak supervision: voters, a generative label model, a linear classifier.

Voters look at words. Some hold a fixed list of insults, some a stem (word beginning) that the
labelled rows show almost only in toxic texts, some a pattern; most abstain on most texts. The label
model estimates how often each voter speaks on toxic and on clean texts, and how much voters agree
beyond that, by expectation maximisation; a voter that repeats others weighs less. The classifier
is a logistic model of word statistics, fitted to the label model's posteriors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktab.llm.arrowtext import content, sliced, word_spans, words
from ranktab.llm.labelled import FIT_ROWS, held_out, training_rows

# Common English insults, one voter each.
INSULTS = (
    "bastard", "clown", "creep", "cretin", "disgusting", "dumb", "fool", "freak", "garbage", "idiot", "imbecile",
    "jerk", "loser", "lunatic", "moron", "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin", "worthless",
)
STEM_LENGTHS = (4, 5, 6)
STEMS = 96  # learnt stems, at most
LEAST_TEXTS = 4  # toxic texts that must hold a stem, near copies taken as one
LEAST_SHARE = 0.02  # share of the toxic texts that must hold it
LEAST_RATIO = 12.0  # times as frequent in toxic as in clean texts, smoothed
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LIMIT = 30.0


def _distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as written, the code of each word, its document, and words per document."""
    data, offsets = content(texts)
    starts, ends, first = word_spans(data, offsets, LETTER)
    coded = words(data, starts, ends, LETTER)
    n = np.diff(first)
    return [w.decode("utf-8", "replace") for w in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n), n


def _stems(word: str) -> list[str]:
    word = word.lower()
    return [word[:n] for n in STEM_LENGTHS if len(word) >= n]


def _sketches(distinct: list[str], code: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """The least hash of the four-word shingles of each text: near copies mostly share it. Of a text
    with fewer words, a hash of them all in order; of one without words, 0."""
    import xxhash

    out = np.zeros(size, np.uint64)
    if not len(code):
        return out
    h = np.array([xxhash.xxh64_intdigest(w.lower()) for w in distinct], np.uint64)[code]
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
    n = np.bincount(doc, minlength=size)
    first = np.cumsum(n) - n
    for k in (1, 2, 3):
        short = np.flatnonzero(n == k)
        for i in range(k):
            out[short] = (out[short] + h[first[short] + i]) * odd[i]
            out[short] ^= out[short] >> np.uint64(31)
    if len(code) < 4:
        return out
    mixed = h[:-3] * odd[0] + h[1:-2] * odd[1] + h[2:-1] * odd[2] + h[3:] * odd[3]
    mixed ^= mixed >> np.uint64(31)
    inside = doc[:-3] == doc[3:]
    mixed, own = mixed[inside] * odd[1], doc[:-3][inside]
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    if len(own):
        out[own[starts]] = np.minimum.reduceat(mixed, starts)
    return out


def stem_counts(rows: DataFrame) -> DataFrame:
    """How many texts of each label hold each stem: ``stem``, ``clean``, ``toxic``. Whole texts are
    read; toxic near copies count as one, lest what a copied text says looks like usage. The stem ``""``
    stands for all texts, those without words too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                distinct, code, doc, n = _distinct_words(texts)
                toxic = part.column(part.schema.get_field_index("label")).to_numpy() == 1
                sketch = _sketches(distinct, code, doc, len(n)).view(np.int64).tolist()
                clean: dict[str, int] = {}
                held: dict[str, set[int]] = {}
                bounds = np.concatenate([[0], np.cumsum(n)]).tolist()
                stems = [_stems(w) for w in distinct]
                for d, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    own = {"", *(s for c in set(code[a:b].tolist()) for s in stems[c])}
                    for s in own:
                        if toxic[d]:
                            held.setdefault(s, set()).add(sketch[d])
                        else:
                            clean[s] = clean.get(s, 0) + 1
                names = list(clean.keys() | held.keys())
                columns = [pa.array(names, pa.string()), pa.array([clean.get(s, 0) for s in names], pa.int64()), pa.array([list(held.get(s, ())) for s in names], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["stem", "clean", "held"])

    found = rows.mapInArrow(run, "stem string, clean long, held array<long>")
    toxic = F.size(F.array_distinct(F.flatten(F.collect_list("held"))))  # bounded by the sample
    return found.groupBy("stem").agg(F.sum("clean").alias("clean"), toxic.cast("long").alias("toxic"))


@dataclass
class Voters:
    """Words and stems with a voter each, then the patterns' voters."""

    stems: list[str]
    by_stem: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.by_stem = {s: len(INSULTS) + i for i, s in enumerate(self.stems)}
        self.by_word = {w: i for i, w in enumerate(INSULTS)}
        self.words = len(INSULTS) + len(self.stems)
        self.size = self.words + 3

    def _of(self, word: str) -> list[int]:
        low = word.lower()
        found = [self.by_stem[s] for s in _stems(low) if s in self.by_stem]
        plain = low[:-1] if low.endswith("s") else low
        for w in (low, plain):
            if w in self.by_word:
                return [self.by_word[w], *found]
        return found

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How often each word voter's words stand in each text; then words, upper-case words, and
        the most occurrences of one hit word."""
        distinct, code, doc, n = _distinct_words(texts)
        out = np.zeros((len(n), self.words + 3))
        of_word = [self._of(w) for w in distinct]
        hit = np.array([bool(v) for v in of_word], bool)
        at = np.flatnonzero(hit[code]) if len(code) else np.zeros(0, np.int64)
        for d, c in zip(doc[at].tolist(), code[at].tolist()):
            for v in of_word[c]:
                out[d, v] += 1
        out[:, self.words] = n
        upper = np.array([len(w) > 2 and w.isupper() for w in distinct], bool)
        out[:, self.words + 1] = np.bincount(doc[upper[code]], minlength=len(n)) if len(code) else 0
        out[:, self.words + 2] = out[:, : self.words].max(axis=1, initial=0)
        return out

    def votes(self, counts: np.ndarray) -> np.ndarray:
        """Whether each voter speaks: words and stems that occur, shouting, one word again and
        again, and (for clean) no insult at all."""
        w, n = self.words, np.maximum(counts[:, self.words], 1)
        patterns = [counts[:, w + 1] > 0.5 * n, counts[:, w + 2] >= 3, counts[:, :w].sum(axis=1) == 0]
        return np.concatenate([counts[:, :w] > 0, np.stack(patterns, axis=1)], axis=1)

    def features(self, counts: np.ndarray) -> np.ndarray:
        """What the classifier sees."""
        w, n = self.words, np.log1p(counts[:, self.words])
        hits = counts[:, :w]
        total = hits.sum(axis=1)
        several = (hits > 0).sum(axis=1)
        return np.concatenate(
            [np.log1p(hits), np.stack([np.log1p(total), np.log1p(several), np.log1p(total) - n / 4, n / 8, counts[:, w + 1] / np.maximum(counts[:, w], 1)], axis=1)], axis=1
        )


@dataclass
class LabelModel:
    """Rates at which voters speak on clean and toxic texts, and how much each one's word counts."""

    prior: float
    rates: np.ndarray  # class, voter
    weight: np.ndarray  # voter: 1 over the root of how many voters say the same

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        spoke = np.log(self.rates[1] / self.rates[0]) * self.weight
        silent = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * self.weight
        odds = np.log(self.prior / (1 - self.prior)) + votes @ spoke + (~votes) @ silent
        return 1 / (1 + np.exp(-np.clip(odds, -LIMIT, LIMIT)))


def fit_label_model(votes: np.ndarray, labels: np.ndarray, trust: float = 0.98, rounds: int = 25) -> LabelModel:
    """Expectation maximisation from the labelled rows, each label taken as one more voter that is
    right with probability ``trust``. Correlations are those that the classes leave unexplained."""
    given = np.log(trust / (1 - trust)) * (2 * labels - 1)
    p = 1 / (1 + np.exp(-given))
    for _ in range(rounds):
        mass = np.stack([1 - p, p])
        rates = (mass @ votes + 0.5 * votes.mean(axis=0) + 0.01) / (mass.sum(axis=1)[:, None] + 0.52)
        prior = float(np.clip((p.sum() + 0.5) / (len(p) + 1), 1e-4, 1 - 1e-4))
        rest = votes - np.stack([1 - p, p], axis=1) @ rates
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
        together = (rest.T @ rest) / len(rest) / np.outer(spread, spread)
        np.fill_diagonal(together, 0)
        weight = 1 / np.sqrt(1 + np.where(together > 0.1, together, 0).sum(axis=1))
        model = LabelModel(prior, np.clip(rates, 1e-5, 1 - 1e-5), weight)
        odds = model.posterior(votes)
        odds = np.log(odds / (1 - odds)) + given
        after = 1 / (1 + np.exp(-np.clip(odds, -LIMIT, LIMIT)))
        if np.abs(after - p).max() < 1e-5:
            break
        p = after
    return model


@dataclass
class Classifier:
    voters: Voters
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    label_model: LabelModel | None

    def score(self, texts: pa.Array) -> np.ndarray:
        x = (self.voters.features(self.voters.counts(texts)) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -LIMIT, LIMIT)))


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights (the last is the intercept) for targets between 0 and 1."""
    design = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, pull = np.zeros(design.shape[1]), np.full(design.shape[1], ridge)
    pull[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return float((np.logaddexp(0, z) - p * z).sum() + (pull * v * v).sum() / 2)

    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(design @ w, -LIMIT, LIMIT)))
        bend = (design * (q * (1 - q))[:, None]).T @ design + np.diag(pull + 1e-9)
        step = np.linalg.solve(bend, design.T @ (p - q) - pull * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def choose_stems(counts: DataFrame, toxic: int, clean: int) -> list[str]:
    """Stems that speak for toxic texts, at most ``STEMS``: by log odds times evidence.

    ``toxic`` counts as ``stem_counts`` does: near copies once. Of a stem and a longer one that starts with it, the shorter stays if it is as pure, and the
    longer if it holds four fifths of the toxic texts and less than half of the clean ones.
    """
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    value = F.log(ratio) * F.sqrt("toxic")
    least = max(LEAST_TEXTS, LEAST_SHARE * toxic)
    found = counts.where((F.col("stem") != "") & (F.col("toxic") >= least) & (ratio >= LEAST_RATIO)).orderBy(value.desc(), "stem").limit(8 * STEMS).collect()
    out = {r["stem"] for r in found}
    for long in found:
        for short in found:
            if len(short["stem"]) < len(long["stem"]) and long["stem"].startswith(short["stem"]):
                purer = 2 * long["clean"] < short["clean"] and long["toxic"] >= 0.8 * short["toxic"]
                out.discard(short["stem"] if purer else long["stem"])
    return [r["stem"] for r in found if r["stem"] in out][:STEMS]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Classifier | float:
    """Fit on about ``rows`` labelled documents that are not held out.

    Only counts of voters' words (about a kilobyte a row) come to the driver. Without labels of both
    classes the result is a constant score: class 1's share, or 0 without rows.
    """
    from ranktab.sources.staging import stage

    sample = stage(training_rows(docs, labels, label, rows))
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return float(n.get(1, 0) > 0)
    counted = stage(stem_counts(sample))
    every = counted.where(F.col("stem") == "").first()
    voters = Voters(choose_stems(counted, every["toxic"], every["clean"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(voters.counts(texts)), pa.list_(pa.float64()))], names=["label", "x"])

    found = sample.select("text", "label").mapInArrow(run, "label int, x array<double>").toPandas()
    counts, y = np.stack(found["x"].to_list()), found["label"].to_numpy()
    model = fit_label_model(voters.votes(counts), y)
    soft = model.posterior(voters.votes(counts))
    x = voters.features(counts)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    return Classifier(voters, centre, scale, fit_linear((x - centre) / scale, soft), model)


def toxicity_scores(docs: DataFrame, model: Classifier | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: more likely toxic) of every row's whole text.

    A null text counts as empty and gets the score of an empty one. Repeated rows stay; null ids
    stay null; an empty table gives an empty one; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in sliced(batch, "text"):
                score = np.full(len(texts), model) if isinstance(model, float) else model.score(texts)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """Fit and score: ``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from ``least`` on)."""
    scores = toxicity_scores(docs, fit_toxicity(docs, labels))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))

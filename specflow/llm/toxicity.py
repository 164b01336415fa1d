"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of two lexicons (a short fixed one, and one of words and beginnings of words learned
from labelled texts by the log-odds of document frequencies), how near their words stand to second-person words, capitals, punctuation, and signs of
obfuscation (look-alike characters, drawn-out and spaced-out letters, and lexicon words found only after undoing them).

Labels come from about ``SAMPLE`` labelled texts at most, a documented bound: if there are more, a share of the labelled ids,
and then of the different texts that they have, is taken by hash; a text that repeats under its id is learned from once. Trees are
grown on histograms of the features in numpy. Margins of the texts of each fold, by a lexicon and trees that the other folds
made, are calibrated by pool adjacent violators, and scores are interpolated between the pools. Where the sample has no two
classes, every score is the smoothed share of label 1.

Null and empty texts are scored like any other, as texts without words. A document with contradicting labels counts as
toxic. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch

#: Most labelled rows that the model is fitted on, and most words and word beginnings of the learned lexicon.
#: Beginnings (stems of inflected words) are kept with a * behind them, and have these lengths.
SAMPLE, LEXICON, STEMS, FOLDS = 20_000, 400, (6, 5, 4, 3), 3
#: Insults, and words of the second person, in four languages.
INSULTS = frozenset(
    """idiot idiots moron morons stupid dumb dumbass fool imbecile loser losers clown scum trash garbage filth worthless pathetic disgusting
    vile coward liar ugly creep freak jerk bastard bitch whore slut asshole retard dirtbag lowlife vermin parasite pig
    dummkopf trottel arschloch schwein abschaum dreckig wertlos erbärmlich ekelhaft hurensohn idiotin vollidiot
    imbécile connard connasse salaud salope ordure minable dégoûtant crétin abruti raclure pourriture
    idiota estúpido estúpida imbécil basura escoria asqueroso cabrón puta gilipollas inútil patético payaso""".split()
)
SECOND = frozenset("you your yours yourself youre u ur du dich dir dein deine deiner ihr euch euer sie tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vos vuestro vuestra".split())
STRIP = ".,;:!?\"'()[]{}<>*#-_~`«»„“”‘’…|/\\"
LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "_": None, "-": None, ".": None, "+": "t"})
DRAWN = re.compile(r"(\w)\1{2,}")
SPACED = re.compile(r"(?<!\w)\w(?:[ ._*-]\w){3,}(?!\w)")
NEAR = 5
NAMES = (
    "log_words", "fixed_share", "fixed_count", "fixed_kinds", "learned_share", "learned_weight", "learned_count", "learned_kinds", "second_share", "near_second", "near_gap",
    "capital_share", "shouted_share", "exclaim_rate", "question_rate", "repeat_marks", "symbol_rate", "mixed_share", "drawn_share", "spaced", "undone_count", "digit_rate",
)


def words_of(text: str) -> list[str]:
    return [w for w in (t.strip(STRIP).lower() for t in text.split()) if w]


def stems_of(text: str) -> set[str]:
    words = {w for w in words_of(text) if len(w) < 64}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


class Lexicon:
    """Weights of words, by the word itself or else its longest listed beginning; words looked up are remembered."""

    def __init__(self, weights: dict[str, float], most: int = 300_000):
        self.weights, self.most, self.seen = weights, most, {}

    def get(self, word: str) -> float:
        if (known := self.seen.get(word)) is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            keys = (word, *(word[:k] + "*" for k in STEMS if len(word) > k))
            known = self.seen[word] = next((self.weights[k] for k in keys if k in self.weights), 0.0)
        return known

    def __reduce__(self):
        return Lexicon, (self.weights, self.most)


def undone(token: str) -> str:
    return DRAWN.sub(r"\1", token.lower().translate(LOOKS).strip(STRIP))


def features(text: str, learned: Lexicon) -> list[float]:
    tokens = text.split()
    low = [t.strip(STRIP).lower() for t in tokens]
    n = max(1, len(low))
    fixed = [i for i, w in enumerate(low) if w in INSULTS]
    weights = list(map(learned.get, low))
    own = [i for i, x in enumerate(weights) if x]
    second = [i for i, w in enumerate(low) if w in SECOND]
    hits = np.array(sorted({*fixed, *own}))
    gap, near = 50.0, 0
    if len(hits) and second:
        s = np.array(second)
        at = np.searchsorted(s, hits)
        gaps = np.minimum(np.abs(hits - s[np.minimum(at, len(s) - 1)]), np.abs(hits - s[np.maximum(at - 1, 0)]))
        gap, near = float(min(50, gaps.min())), int((gaps <= NEAR).sum())
    odd = [t for t in tokens if not t.isalpha() and not t.strip(STRIP).isalpha() and any(c.isalpha() for c in t)]
    drawn = [t for t in low if DRAWN.search(t)] if DRAWN.search(text) else []
    spaced = SPACED.findall(text)
    known = lambda w: w in INSULTS or learned.get(w) > 0
    found = sum(known(undone(t)) and not known(t.strip(STRIP).lower()) for t in {*odd, *drawn}) + sum(known(re.sub(r"\W|_", "", t).lower()) for t in spaced)
    size = max(1, len(text))
    letters = max(1, sum(map(len, low)))
    capitals = sum(map(str.isupper, text)) if text != text.lower() else 0
    return [
        np.log1p(len(low)), len(fixed) / n, np.log1p(len(fixed)), len({low[i] for i in fixed}), len(own) / n, sum(weights) / n, np.log1p(len(own)), len({low[i] for i in own}),
        len(second) / n, near / max(1, len(hits)), gap, capitals / letters, sum(len(t) > 2 and t.isupper() for t in tokens) / n, text.count("!") / n, text.count("?") / n,
        (text.count("!!") + text.count("??")) / n, sum(map(text.count, "#$%&*@")) / size, len(odd) / n, len(drawn) / n, float(len(spaced)), float(found), sum(map(text.count, "0123456789")) / size,
    ]


@dataclass
class Trees:
    """Boosted trees of equal depth; node k of a level has the nodes 2k and 2k + 1 below it."""

    depth: int
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    limit: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                inner = (1 << level) - 1 + at
                at = 2 * at + (x[rows, f[inner]] > limit[inner])
            out += value[at]
        return out


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Trees:
    """Logistic loss, second-order gains over histograms."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    out = Trees(depth, float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # code c: x <= edges[c]
    margin = np.full(len(x), out.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), np.int64)
        feature, limit = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            nodes = 1 << level
            best = np.zeros(nodes)
            total_g, total_h = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
            pick, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = at * (len(e) + 1) + coded[:, j]
                left_g = np.bincount(cell, g, nodes * (len(e) + 1)).reshape(nodes, -1).cumsum(1)[:, :-1]
                left_h = np.bincount(cell, h, nodes * (len(e) + 1)).reshape(nodes, -1).cumsum(1)[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                gain[(left_h < 1) | (right_h < 1)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                better = top > best + 1e-9
                best[better], pick[better], cut[better] = top[better], j, e[k[better]]
            inner = slice(nodes - 1, 2 * nodes - 1)
            feature[inner], limit[inner] = pick, cut
            at = 2 * at + (x[np.arange(len(x)), pick[at]] > cut[at])
        leaves = 1 << depth
        value = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        margin += value[at]
        out.feature.append(feature)
        out.limit.append(limit)
        out.value.append(value)
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean margins and label shares of the pools, both ascending."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, label in zip(margin[order], y[order], strict=True):
        pools.append([label, 1.0, m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class Model:
    learned: Lexicon
    trees: Trees | None
    at: np.ndarray
    share: np.ndarray
    prior: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.prior)
        margin = self.trees.margin(np.array([features(t or "", self.learned) for t in texts]))
        calibrated = np.interp(margin, self.at, self.share)
        return np.clip(0.99 * calibrated + 0.01 / (1 + np.exp(-margin)), 0, 1)  # the second part only orders equal scores


def labelled(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, most: int) -> DataFrame:
    """y, t and fold of a bounded sample of labelled texts, written to the shared folder. Ids are sampled first, so the side that is
    broadcast is bounded; then their texts, of which an id may have any number."""

    def share(rows: DataFrame, n: int, *columns: str) -> DataFrame:
        return rows if n <= most else rows.where(F.pmod(F.xxhash64(*columns, F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * most / n))

    ids = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    ids = share(ids, ids.count(), "k")
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(ids), F.col("id") == F.col("k"))
    rows = rows.select("k", "y", F.xxhash64("t").alias("h"), "t")
    at = scratch(docs.sparkSession, "labelled")
    rows = share(rows, rows.select("k", "h").distinct().count(), "k", "h").dropDuplicates(["k", "h"])
    rows.select("y", "t", F.pmod(F.xxhash64("k", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def lexicons(sample: DataFrame, sizes: dict[tuple[int, int], int]) -> list[Lexicon]:
    """The lexicon that all folds but one make, for each fold, and the one of all; sizes: texts by (fold, whether label 1)."""

    def kinds(stream):
        for batch in stream:
            rows = [(w, y, k) for y, t, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for w in stems_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=["w", "y", "fold"])

    sums = [x for k in range(FOLDS) for x in (F.count_if((F.col("fold") == k) & (F.col("y") == 1)).alias(f"b{k}"), F.count_if(F.col("fold") == k).alias(f"n{k}"))]
    at = scratch(sample.sparkSession, "words")
    sample.select("y", "t", "fold").mapInArrow(kinds, "w string, y int, fold int").groupBy("w").agg(*sums).where("+".join(f"b{k}" for k in range(FOLDS)) + " >= 3").write.parquet(at)
    counts, out = sample.sparkSession.read.parquet(at), []
    for left in [*range(FOLDS), None]:
        folds = [k for k in range(FOLDS) if k != left]
        bad, good = (sum(sizes.get((k, c), 0) for k in folds) for c in (1, 0))
        b, n = sum(F.col(f"b{k}") for k in folds), sum(F.col(f"n{k}") for k in folds)
        rows = counts.select("w", b.alias("b"), n.alias("n"))
        odds = F.log((F.col("b") + 0.5) / (bad - F.col("b") + 0.5)) - F.log((F.col("n") - F.col("b") + 0.5) / (F.lit(good + 0.5) - (F.col("n") - F.col("b"))))
        spread = F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("n") - F.col("b") + 0.5))
        top = rows.where(F.col("b") >= 3).withColumn("odds", odds).withColumn("z", F.col("odds") / spread).where("odds > 1.5 and z > 3.5").orderBy(F.desc("z"), "w").limit(LEXICON)
        out.append(Lexicon({r["w"]: float(r["odds"]) for r in top.collect()}))
    return out


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> Model:
    """Fits on the documents that ``labels`` has; its rows are taken as given, so held-out ones must not be in it."""
    bounded_batches(docs.sparkSession)
    sample = labelled(docs, labels, key=key, text=text, label=label, most=most)
    sizes = {(r["fold"], r["bad"]): r["n"] for r in sample.groupBy("fold", (F.col("y") == 1).cast("int").alias("bad")).agg(F.count("*").alias("n")).collect()}
    bad, good = (sum(n for (_, c), n in sizes.items() if c == kind) for kind in (1, 0))
    prior = (bad + 1) / (bad + good + 20)
    if not bad or not good:
        return Model(Lexicon({}), None, np.zeros(1), np.zeros(1), prior)
    learned = lexicons(sample, sizes)
    names = [f"{n}_{k}" for k in range(FOLDS + 1) for n in NAMES]

    def dense(stream):
        for batch in stream:
            texts = batch.column(1).to_pylist()
            x = np.concatenate([np.array([features(t, lexicon) for t in texts], np.float64).reshape(-1, len(NAMES)) for lexicon in learned], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x[:, j]) for j in range(len(names)))], names=["y", "fold", *names])

    table = sample.select("y", "t", "fold").mapInArrow(dense, "y int, fold int, " + ", ".join(f"{n} double" for n in names)).toPandas().sort_values(["fold", *names], kind="stable")
    y, fold = (table["y"].to_numpy() == 1).astype(float), table["fold"].to_numpy()
    by = [table[names[k * len(NAMES) : (k + 1) * len(NAMES)]].to_numpy() for k in range(FOLDS + 1)]
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        inside = fold == k
        if inside.any():
            margin[inside] = grow(by[k][~inside], y[~inside]).margin(by[k][inside]) if (~inside).any() else 0
    at, share = isotonic(margin, y)
    return Model(learned[FOLDS], grow(by[FOLDS], y), at, share, prior)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def batches(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(batch.column(1).to_pylist()), pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(batches, f"`{key}` {dict(docs.dtypes)[key]}, score double")

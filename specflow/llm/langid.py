"""Language identification by a linear-chain conditional random field over the words of a text.

Every word (a run of letters, lower-cased) is labelled with a language. Its features are hashed into one table of weights:
the word itself (lexicon), prefixes and suffixes of one to three characters (affixes), and character bigrams and trigrams
with the word's edges. Transitions between the labels of neighbouring words are learned too, from sequences that switch
between documents of different languages. Forward-backward gives each word's distribution in its whole text; a text's
prediction is the language with the highest mean over its words, its score that mean.

Fitting uses about ``SAMPLE`` documents of each language at most, a documented bound: a share of them is taken by the hash of
their id and text, equal ones once; they are learned from in runs of ``RUN`` words. A language's documents of more than ``BYTES`` bytes
together give a share of their runs, from all over their texts, by a hash: so what the driver gets of a language is bounded, long texts or not. Beyond ``LANGUAGES`` languages each has fewer documents and the table
of weights fewer slots, ``LEAST`` documents and 2 ** 12 slots at least: no language is left out. Texts are scored whole. Texts are packed by time step and
processed together, so a step serves all texts that are that long.

Null texts and texts without a letter are ``und`` with score 0, as is every text if there was nothing to learn from.
Repeated rows get equal results. Rows come back in no particular order.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, slices

#: Documents of a language, words of a run, languages from which each has fewer documents, and how many it has then at least.
SAMPLE, RUN, LANGUAGES, LEAST = 400, 64, 64, 16
#: Bytes of a language's sampled texts from which runs are sampled too, and letters of a word that are learned from: its first and last.
BYTES, LETTERS = 6 << 20, 64
#: Characters that are cut into words at once.
PIECE = 1 << 20
BITS = 17
WORD, SPACE = re.compile(r"[^\W\d_]+"), re.compile(r"\s")
UNKNOWN = "und"


def word_runs(text: str):
    """The words of a text in runs of ``RUN``; of a long text only a piece, cut at white space, is words at a time."""
    held, begin = [], 0
    while begin < len(text):
        space = SPACE.search(text, begin + PIECE)
        end = space.end() if space else len(text)
        held += words_of(text[begin:end])
        whole = len(held) - len(held) % RUN
        yield from (held[i : i + RUN] for i in range(0, whole, RUN))
        held, begin = held[whole:], end
    if held:
        yield held


def words_of(text: str | None) -> list[str]:
    found = WORD.findall((text or "").lower())
    return found if not found or "".join(found).isalpha() else [w for w in found if any(map(str.isalpha, w))]


def indices(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places in words, feature slots): one pair for each length of word, a row of slots for each word of it."""
    length = np.array([len(w) for w in words])
    out = []
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        c = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), "<u4").reshape(len(at), n).astype(np.uint64)
        edge = np.ones((len(at), 1), np.uint64)
        c = np.concatenate([edge, c, edge], 1)
        mix = lambda a, tag: (a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tag * 0x632BE59BD9B4E019 & (2**64 - 1))) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(64 - BITS)
        two = c[:, :-1] * np.uint64(1000003) + c[:, 1:]
        parts = [mix(two, 2)]
        if n > 1:
            parts.append(mix(two[:, :-1] * np.uint64(1000003) + c[:, 2:], 3))
        head, tail, word = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for k in range(1, min(3, n) + 1):
            head = head * np.uint64(1000003) + c[:, k]
            tail = tail * np.uint64(1000003) + c[:, n + 1 - k]
            parts += [mix(head, 10 + k)[:, None], mix(tail, 20 + k)[:, None]]
        for k in range(1, n + 1):
            word = word * np.uint64(1000003) + c[:, k]
        parts.append(mix(word, 30)[:, None])
        out.append((at, np.concatenate(parts, 1).astype(np.int64)))
    return out


def packed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences in descending order of length: how many are active at each step, where each step begins, and the place
    of every word, sequence by sequence."""
    steps = int(lengths[0]) if len(lengths) else 0
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), "right")
    begin = np.append(0, np.cumsum(active))
    step = np.arange(lengths.sum()) - np.repeat(np.append(0, np.cumsum(lengths[:-1])), lengths)
    return active, begin, begin[step] + np.repeat(np.arange(len(lengths)), lengths)


def forward_backward(emit: np.ndarray, move: np.ndarray, active: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """emit: scores of packed words. Returns scaled forward and backward terms and exponentiated emissions."""
    e = np.exp(emit - emit.max(1, keepdims=True))
    t = np.exp(move)
    a, b = np.empty_like(e), np.ones_like(e)
    for k, n in enumerate(active):
        here = slice(begin[k], begin[k] + n)
        x = e[here] if k == 0 else (a[begin[k - 1] : begin[k - 1] + n] @ t) * e[here]
        a[here] = x / x.sum(1, keepdims=True)
    for k in range(len(active) - 2, -1, -1):
        n = active[k + 1]
        x = (e[begin[k + 1] : begin[k + 1] + n] * b[begin[k + 1] : begin[k + 1] + n]) @ t.T
        b[begin[k] : begin[k] + n] = x / x.sum(1, keepdims=True)
    return a, b, e


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    move: np.ndarray

    def __post_init__(self):
        self.clear()

    def __getstate__(self):
        return self.languages, self.weights, self.move

    def __setstate__(self, state):
        self.languages, self.weights, self.move = state
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.scores = np.empty((1 << 14, len(self.languages)), np.float32)

    @property
    def shift(self) -> int:
        """Feature slots are numbered for the largest table: how many bits fewer this one has."""
        return BITS - (len(self.weights).bit_length() - 1)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)), np.float32)
        for at, slots in indices(words):
            step = max(1, (1 << 20) // (slots.shape[1] * max(1, len(self.languages) // LANGUAGES)))
            for i in range(0, len(at), step):
                out[at[i : i + step]] = self.weights[slots[i : i + step] >> self.shift].sum(1)
        return out

    def rows(self, words: list[str], most: int = 400_000) -> np.ndarray:
        """Emission rows of words, remembered by word."""
        if len(self.known) > most:
            self.clear()
        new = list(set(words).difference(self.known))
        if new:
            first = len(self.known)
            while first + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            self.scores[first : first + len(new)] = self.emissions(new)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in found], np.int64)
        labels, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order) or not self.languages:
            return labels, score
        rows = self.rows([w for i in order for w in found[i]])
        active, begin, place = packed(lengths[order])
        emit = np.empty((len(rows), len(self.languages)), np.float32)
        emit[place] = self.scores[rows]
        a, b, _ = forward_backward(emit, self.move, active, begin)
        p = a * b
        p /= p.sum(1, keepdims=True)
        sequence = np.repeat(np.arange(len(order)), lengths[order])
        mean = np.stack([np.bincount(sequence, p[place, j], len(order)) for j in range(p.shape[1])], 1) / lengths[order][:, None]
        best = mean.argmax(1)
        for i, k in zip(order, best, strict=True):
            labels[i] = self.languages[k]
        score[order] = np.clip(mean.max(1), 0, 1)
        return labels, score


def sequences(runs: list[list[str]], label: np.ndarray, rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Runs of one document, and runs that switch from one document to another and back."""
    out = [(w, [y] * len(w)) for w, y in zip(runs, label, strict=True)]
    for _ in range(len(runs) // 2):
        i, j = rng.integers(0, len(runs), 2)
        a, b = runs[i], runs[j]
        k, m = int(rng.integers(0, len(a) + 1)), int(rng.integers(1, min(len(b), 16) + 1))
        out.append((a[:k] + b[:m] + a[k:], [label[i]] * k + [label[j]] * m + [label[i]] * (len(a) - k)))
    return [x for x in out if x[0]]


def train(runs: list[list[str]], label: np.ndarray, languages: list[str], epochs: int = 4, batch: int = 192, rate: float = 0.15, ridge: float = 1e-6) -> Model:
    """Maximum conditional likelihood by Adagrad."""
    rng = np.random.default_rng(23)
    made, n = sequences(runs, label, rng), len(languages)
    size = 1 << max(12, BITS - (max(0, n - 1) // LANGUAGES).bit_length())
    model = Model(languages, np.zeros((size, n), np.float32), np.zeros((n, n)))
    square, move_square = np.full((size, n), 1e-4, np.float32), np.full((n, n), 1e-4)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(made)), max(1, -(-len(made) // batch))):
            chosen = sorted((made[i] for i in part), key=lambda x: -len(x[0]))
            lengths = np.array([len(x[0]) for x in chosen])
            words, back = np.unique([w for x in chosen for w in x[0]], return_inverse=True)
            words = words.tolist()
            active, begin, place = packed(lengths)
            y = np.empty(len(back), np.int64)
            y[place] = [c for x in chosen for c in x[1]]
            slots = [(at, s >> model.shift) for at, s in indices(words)]
            score = np.empty((len(words), n), np.float32)
            for at, s in slots:
                score[at] = model.weights[s].sum(1)
            emit = np.empty((len(back), n))
            emit[place] = score[back]
            a, b, e = forward_backward(emit, model.move, active, begin)
            p = a * b
            p /= p.sum(1, keepdims=True)
            grad = -p
            grad[np.arange(len(y)), y] += 1
            move_grad, t = np.zeros((n, n)), np.exp(model.move)
            for k in range(1, len(active)):
                now, before = slice(begin[k], begin[k] + active[k]), slice(begin[k - 1], begin[k - 1] + active[k])
                left, right = a[before], e[now] * b[now]
                move_grad -= t * ((left / ((left @ t) * right).sum(1, keepdims=True)).T @ right)
                np.add.at(move_grad, (y[before], y[now]), 1)
            by_word = np.stack([np.bincount(back, grad[place, j], len(words)) for j in range(n)], 1)
            flat = np.concatenate([s.ravel() for _, s in slots])
            share = np.concatenate([np.repeat(by_word[at], s.shape[1], axis=0) for at, s in slots])
            total = np.stack([np.bincount(flat, share[:, j], size) for j in range(n)], 1) / len(chosen) - ridge * model.weights
            square += total**2
            model.weights += (rate * total / np.sqrt(square)).astype(np.float32)
            move_grad /= len(chosen)
            move_square += move_grad**2
            model.move += rate * move_grad / np.sqrt(move_square)
    return model


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> Model:
    """Fits on the rows that it is given; held-out ones must not be among them."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((1, 0), np.float32), np.zeros((0, 0)))
    each = min(most, max(LEAST, most * LANGUAGES // len(counts)))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "_of string, _share double")
    hashed = F.xxhash64(F.col(key), F.col(text), F.lit(29))
    chosen = rows.select(F.col(lang).alias("lang"), F.col(text).alias("t"), hashed.alias("at")).join(F.broadcast(shares), F.col("lang") == F.col("_of"))
    chosen = chosen.where(F.pmod("at", F.lit(1 << 30)) / (1 << 30) < F.col("_share")).select("lang", "t", "at")

    # equal rows count once; a language's share of runs is by the bytes that its sample has
    chosen = checkpointed(chosen.dropDuplicates(["lang", "at"]))
    sizes = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.sum(F.octet_length("t")).alias("n")).collect()}
    part = {k: int((1 << 32) * min(1.0, BYTES * each / most / max(1, n))) for k, n in sizes.items()}

    def runs(stream):
        for batch in stream:
            for lang, t, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = [(lang, at, i, [w if len(w) <= LETTERS else w[: LETTERS // 2] + w[-LETTERS // 2 :] for w in run]) for i, run in enumerate(word_runs(t)) if zlib.crc32(b"%d %d" % (at, i)) < part.get(lang, 0)]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())], strict=True)], names=["lang", "at", "i", "w"])

    found = chosen.mapInArrow(runs, "lang string, at bigint, i int, w array<string>")
    table = sorted(found.collect(), key=lambda r: (r["lang"], r["at"], r["i"]))
    languages = sorted({r["lang"] for r in table})
    if not languages:
        return Model([], np.zeros((1, 0), np.float32), np.zeros((0, 0)))
    return train([r["w"] for r in table], np.array([languages.index(r["lang"]) for r in table]), languages)


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def batches(stream):
        for batch in stream:
            texts = batch.column(1).to_pylist()
            for a, b in slices([t or "" for t in texts], 6 << 20):
                labels, score = held.value.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(labels, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(batches, f"`{key}` {dict(docs.dtypes)[key]}, lang_pred string, score double")

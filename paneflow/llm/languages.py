"""Language identification by a linear-chain conditional random field over words (operator 10)."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

UNKNOWN = "und"
#: Documents of each language that the model is fitted on at most, one for each value of a hash.
PER_LANGUAGE = 400
#: Characters taken from each of them, from a place that its hash gives.
SAMPLE_CHARS = 400
#: Hashed features.
FEATURES = 1 << 15
#: Words of one chain; longer texts are cut into chains of this length.
CHAIN = 128
#: Letters of one position of a chain at most: longer words, as scripts without spaces have, are several positions.
LONGEST_WORD = 64
#: Most frequent words of each language's sample that make its lexicon.
LEXICON = 300
#: Different words whose scores a worker keeps, and chains that it labels at once; fewer where languages are more than MANY.
CACHED, AT_ONCE = 300_000, 1024
MANY = 200


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the doc_id as text is divisible by 5. False for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _core(word: str) -> str:
    """The word in lower case from its first letter to its last; empty if it has none."""
    if word.isalpha():
        return word.lower()
    letters = [i for i, c in enumerate(word) if c.isalpha()]
    return word[letters[0] : letters[-1] + 1].lower() if letters else ""


def _words(text: str) -> list[str]:
    """The words of a text; those over LONGEST_WORD as pieces of their cores."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST_WORD:
        return words
    out = []
    for w in words:
        if len(w) <= LONGEST_WORD:
            out.append(w)
        else:
            core = _core(w)
            out += [core[i : i + LONGEST_WORD] for i in range(0, len(core), LONGEST_WORD)]
    return out


_KIND = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64)  # one fixed number for each kind of feature


def _feature(kind: int, *letters: np.ndarray) -> np.ndarray:
    h = np.full(len(letters[0]), _KIND[kind])
    for x in letters:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(40)).astype(np.int64) % FEATURES


def features(cores: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, and for each feature the word that it is of.

    A word has its prefixes and suffixes of 1 to 4 letters, its 2- and 3-grams with the word's ends, the lexica that list it,
    and if one does, itself. Words over LONGEST_WORD have none.
    """
    letters = np.frombuffer(("\n" + "\n".join(cores) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    end = letters == 10
    at = np.flatnonzero(end)
    starts, ends = at[:-1] + 1, at[1:]
    size = ends - starts
    word = np.repeat(np.arange(len(cores)), size + 1)
    out, owner = [_feature(0, letters[:-1], letters[1:])], [word]
    inside = np.flatnonzero(~end[1:-1])
    out.append(_feature(1, letters[inside], letters[inside + 1], letters[inside + 2]))
    owner.append(word[inside])
    for n in range(1, 5):
        some = np.flatnonzero(size >= n)
        for kind, first in ((n + 1, starts[some]), (n + 5, ends[some] - n)):
            out.append(_feature(kind, *(letters[first + i] for i in range(n))))
            owner.append(some)
    listed = [(i, found, zlib.crc32(x.encode("utf-8", "surrogatepass"))) for i, x in enumerate(cores) if (found := lexicon.get(x))]
    if listed:
        where, value = (np.array(x, np.uint64) for x in zip(*((i, v) for i, found, own in listed for v in (own, *(1 << 40 | n for n in range(found.bit_length()) if found >> n & 1)))))
        out.append(_feature(10, value))
        owner.append(where.astype(np.int64))
    return np.concatenate(out), np.concatenate(owner)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # a row for each feature and one of zeros, a column for each language
    moves: np.ndarray  # from a language to the next word's
    lexicon: dict[str, int]  # word: the languages that list it, as bits

    def emissions(self, cores: list[str]) -> np.ndarray:
        """Scores of words in each language."""
        if not cores:
            return np.zeros((0, len(self.languages)))
        feature, word = features(cores, self.lexicon)
        return np.stack([np.bincount(word, self.weights[feature, i], len(cores)) for i in range(len(self.languages))], 1)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, joint: bool = False):
    """Marginals of the labels of chains: scores (time, chain, label), chains from the longest to the shortest.

    Also, if joint, the expected number of moves from each label to each.
    """
    steps, chains, labels = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    a = np.exp(moves - moves.max())
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps)]  # chains longer than t
    alpha = np.zeros_like(e)
    alpha[0] = e[0] / e[0].sum(1, keepdims=True)
    for t in range(1, steps):
        n = active[t]
        x = (alpha[t - 1, :n] @ a) * e[t, :n]
        alpha[t, :n] = x / x.sum(1, keepdims=True)
    beta = np.ones((chains, labels))
    marginals, expected = np.zeros_like(e), np.zeros_like(a)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        x = alpha[t, :n] * beta[:n]
        marginals[t, :n] = x / x.sum(1, keepdims=True)
        if t:
            y = e[t, :n] * beta[:n]
            if joint:
                z = alpha[t - 1, :n, :, None] * a * y[:, None, :]
                expected += (z / z.sum((1, 2), keepdims=True)).sum(0)
            y = y @ a.T
            beta[:n] = y / y.sum(1, keepdims=True)
    return (marginals, expected) if joint else marginals


def fit(samples: list[tuple[str, str]], rounds: int = 8, seed: int = 5) -> Model:
    """A model from (language, words in a row) by stochastic gradients of the likelihood of the label sequences.

    Chains join the words of two samples, half of the time of two languages, as code-switched text does.
    """
    languages = sorted({x for x, _ in samples})
    index = {x: i for i, x in enumerate(languages)}
    texts = [(index[x], [c for w in _words(text) if (c := _core(w))]) for x, text in samples]
    texts = [x for x in texts if x[1]]
    counts: list[dict[str, int]] = [{} for _ in languages]
    for label, words in texts:
        for w in words:
            counts[label][w] = counts[label].get(w, 0) + 1
    lexicon: dict[str, int] = {}
    for label, seen in enumerate(counts):
        for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if n > 2:
                lexicon[w] = lexicon.get(w, 0) | 1 << label
    model = Model(languages, np.zeros((FEATURES, len(languages))), np.zeros((len(languages),) * 2), lexicon)
    rng = np.random.default_rng(seed)
    place = {w: i for i, w in enumerate(sorted({w for _, words in texts for w in words}))}
    feature, word = features(list(place), lexicon)
    order = np.argsort(word, kind="stable")
    feature, edges = feature[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(place)))))
    square, square_moves = np.full(model.weights.shape, 1e-3), np.full(model.moves.shape, 1e-3)
    for _ in range(rounds if len(languages) > 1 else 0):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            pair = [texts[i] for i in order[at : at + 32]]
            chains = []
            for (a, x), other in zip(pair, pair[1:] + pair[:1]):
                b, y = other if rng.random() < 0.5 else (a, x)
                i, j = rng.integers(0, len(x)), rng.integers(0, len(y))
                x, y = x[i : i + 40], y[j : j + 40]
                chains.append(([*x, *y], [a] * len(x) + [b] * len(y)))
            chains.sort(key=lambda x: -len(x[0]))
            lengths = np.array([len(x[0]) for x in chains])
            scores = np.zeros((lengths[0], len(chains), len(languages)))
            hot = np.zeros_like(scores)
            rows = np.array([place[w] for words, _ in chains for w in words])
            sizes = edges[rows + 1] - edges[rows]
            word = np.repeat(np.arange(len(rows)), sizes)
            flat = feature[np.repeat(edges[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(word))]
            chain = np.repeat(np.arange(len(chains)), lengths)
            time = np.concatenate([np.arange(n) for n in lengths])
            label = np.concatenate([x[1] for x in chains])
            scores[time, chain] = np.stack([np.bincount(word, model.weights[flat, i], len(rows)) for i in range(len(languages))], 1)
            hot[time, chain, label] = 1
            marginals, expected = forward_backward(scores, lengths, model.moves, joint=True)
            inside = time > 0
            seen = np.zeros_like(model.moves)
            np.add.at(seen, (label[np.flatnonzero(inside) - 1], label[inside]), 1)
            error = (hot - marginals)[time, chain]
            used, which = np.unique(flat, return_inverse=True)
            slope = np.stack([np.bincount(which, error[word, i], len(used)) for i in range(len(languages))], 1)
            slope -= 0.01 * model.weights[used]
            square[used] += slope**2
            model.weights[used] += 0.1 * slope / np.sqrt(square[used])
            slope = seen - expected - 0.01 * model.moves
            square_moves += slope**2
            model.moves += 0.1 * slope / np.sqrt(square_moves)
    return model


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from docs (doc_id, text, lang) outside the held-out fifth; None if no row has a language and a letter.

    Fitted on a bounded sample: of each language and each of `per_language` hash values one document, and of that a
    passage of SAMPLE_CHARS characters from a place that its hash gives. Null ids are hashed like a doc_id of "null".
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    mark = F.crc32(F.concat(F.lit("sample:"), key).cast("binary"))
    place = F.greatest(F.lit(1), (mark % F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int"))
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", (mark % per_language).alias("slot"), mark.alias("mark"), F.substring(F.col("text"), place, F.lit(SAMPLE_CHARS)).alias("part"))
    sums = rows.groupBy("lang", "slot").agg(F.min(F.struct("mark", "part")).alias("least"))
    found = sums.select("lang", "slot", "least.part")
    samples = [(x["lang"], x["part"]) for x in sorted(found.collect(), key=lambda x: (x["lang"], x["slot"]))]
    samples = [(lang, part) for lang, part in samples if any(c.isalpha() for c in part)]
    return fit(samples) if samples else None


class Labeller:
    """Predicts languages of texts; keeps the scores of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        share = min(1.0, MANY / len(model.languages))
        self.cached, self.at_once = int(CACHED * share), max(1, int(AT_ONCE * share))
        self.scores = np.zeros((self.cached, len(model.languages)), np.float32)
        self.used = 0

    def _look_up(self, words: list[str]) -> np.ndarray:
        """A row of the scores for each word, -1 for words without a letter."""
        new = [w for w in {*words} if w not in self.place]
        if len(self.place) + len(new) > self.cached:
            self.place, self.used = {}, 0
            new = list({*words})
            if len(new) > len(self.scores):
                self.scores = np.zeros((len(new), self.scores.shape[1]), np.float32)
        cores = [_core(w) for w in new]
        some = [c for c in cores if c]
        if some:
            self.scores[self.used : self.used + len(some)] = self.model.emissions(some)
        for w, c in zip(new, cores):
            self.place[w] = self.used if c else -1
            self.used += bool(c)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        languages = self.model.languages
        sums = np.zeros((len(texts), len(languages)))
        words, counts, first = [], [], 0
        for i, text in enumerate(texts):
            mine = _words(text or "")
            words += mine
            counts.append(len(mine))
            if len(words) >= 1 << 17 or i + 1 == len(texts):
                row = self._look_up(words)
                owner = np.repeat(np.arange(first, i + 1), counts)
                self._add(row[row >= 0], owner[row >= 0], sums)
                words, counts, first = [], [], i + 1
        best = sums.argmax(1)
        total = sums.sum(1)
        return [(languages[b], min(1.0, float(x[b] / t))) if t > 0 else (UNKNOWN, 0.0) for x, b, t in zip(sums, best, total)]

    def _add(self, row: np.ndarray, owner: np.ndarray, sums: np.ndarray) -> None:
        """Adds the marginals of the words, given by their rows of scores, to the sums of their texts."""
        if not len(row):
            return
        new = np.ones(len(row), bool)
        new[1:] = owner[1:] != owner[:-1]
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        time = (np.arange(len(row)) - start) % CHAIN
        head = np.flatnonzero(time == 0)
        lengths = np.diff(head, append=len(row))
        order = np.argsort(-lengths, kind="stable")
        for at in range(0, len(order), self.at_once):
            part = order[at : at + self.at_once]
            n = lengths[part]
            chain = np.repeat(np.arange(len(part)), n)
            step = np.arange(len(chain)) - np.repeat(np.cumsum(n) - n, n)
            scores = np.zeros((n[0], len(part), len(self.model.languages)))
            scores[step, chain] = self.scores[row[head[part][chain] + step]]
            np.add.at(sums, owner[head[part]], forward_backward(scores, n, self.model.moves).sum(0))


_LABEL_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text, lang).

    The model is learned from the rows outside the held-out fifth that have a language; predictions see the text only.
    Each word with a letter is labelled by forward-backward in chains of CHAIN words; a text's language is the one with the
    highest mean probability over all of its words, and that mean is the score. A text that is null or has no letter, or any
    text where nothing could be learned, is `und` with score 0. Repeated rows give equal rows; a null doc_id isn't held out.
    """
    model = learn(docs, per_language)

    def run(batches):
        labeller = Labeller(model) if model else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = labeller.label(texts) if labeller else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), _LABEL_SCHEMA)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with their columns, whose text has one language with a score of at least `least`."""
    model = learn(docs)

    def run(batches):
        labeller = Labeller(model) if model else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = labeller.label(texts) if labeller else [(UNKNOWN, 0.0)] * len(texts)
            yield batch.filter(pa.array([x != UNKNOWN and score >= least for x, score in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))

"""Packing of token sequences by non-negative least squares (operator 5)."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import cache, lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table, tidy

WINDOW = 2048
END = 1
#: Lengths are planned in this many steps of a window.
STEPS = 32
#: Most pieces of a planned combination.
DEPTH = 4
#: Tokens that a worker gathers before it packs them.
BLOCK_TOKENS = 1 << 21
#: Different chunks between spaces, and words, whose ids a worker keeps: twice as many at most.
CACHED = 500_000
#: Characters of text that a worker encodes at once.
AT_ONCE = 1 << 19

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Recent(dict):
    """A bounded dictionary of two generations: when it is full its content becomes the old one, which is looked up last.

    Looking up a key that neither has gives an empty bytearray, which is filled when its value is learned.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old, self.holes = size, {}, {}

    def __missing__(self, key: str) -> bytes | bytearray:
        if (value := self.old.get(key)) is None:
            value = self.holes[key] = bytearray()
        self[key] = value
        return value

    def look_up(self, keys: list[list[str]], learn: Callable[[list[str]], Iterable[tuple[str, bytes]]]) -> list[list[bytes | bytearray]]:
        """The values of some lists of keys; learn gives those of new keys."""
        if len(self) > self.size:
            self.old = self.copy()
            self.clear()
        out = [list(map(self.__getitem__, x)) for x in keys]
        if self.holes:
            holes, self.holes = self.holes, {}
            for key, value in learn(list(holes)):
                holes[key] += value
                self[key] = value
        return out


class Encoder:
    """Token ids of texts as bytes (little-endian, 32 bits each).

    The tokenizer drops white space and joins nothing across it, so chunks between spaces and line feeds are encoded
    apart, each different one once. Chunks of Latin letters, digits and signs are cut into words as the tokenizer cuts them,
    since these repeat more; their new words are encoded many at a time and told apart by the tokens that end a word. Any
    other chunk goes through the tokenizer as it is.
    """

    # Fixed value: the tokenizer's pattern of words, over texts in lower case; and the space that divides chunks here.
    _WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| ")
    _PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u017e]*")
    # The model's letters for bytes that are none in print; a space divides words.
    _BYTES = dict(zip([*range(0x20), *range(0x7F, 0xA1), 0xAD], [*range(0x100, 0x120), *range(0x121, 0x144)]))

    def __init__(self, path: str, known: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)  # for words as the tokenizer cuts them, in the model's letters
        self.bare.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.chunks, self.words = Recent(known), Recent(known)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, new: list[str]) -> Iterable[tuple[str, bytes]]:
        for at in range(0, len(new), 512):
            part = new[at : at + 512]
            letters = " ".join(part).encode().decode("latin-1").translate(self._BYTES)
            raw = np.asarray(self.bare.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4").tobytes()
            edges = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)).tolist()
            if len(edges) == len(part) and edges[-1] == len(raw):
                yield from zip(part, (raw[a:b] for a, b in zip([0, *edges], edges)))
            else:
                yield from zip(part, self._encode(part))

    def _learn_chunks(self, new: list[str]) -> Iterable[tuple[str, bytes]]:
        plain = [c for c in new if (c.isascii() or self._PLAIN.fullmatch(c)) and "<|" not in c and c.isprintable()]
        words = self._WORD.findall(" ".join(plain).lower())
        cut = [i for i, w in enumerate(words) if w == " "]  # a space ends a chunk
        self.words[" "] = b""
        ids = self.words.look_up([words], self._learn_words)[0]
        raw = b"".join(ids)
        upto = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        ends = [*upto[cut].tolist(), len(raw)]
        yield from zip(plain, (raw[i:j] for i, j in zip([0, *ends], ends)))
        if len(plain) < len(new):
            known = set(plain)
            other = [c for c in new if c not in known]
            yield from zip(other, self._encode(other))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [x.lower() if x.isascii() and "<|" not in x else x for x in texts]  # the tokenizer does so, and fewer chunks differ
        found = self.chunks.look_up([x.replace("\n", " ").split(" ") for x in plain], self._learn_chunks)
        return [b"".join(x) for x in found]


@lru_cache(maxsize=1)
def _kept(path: str, known: int) -> Encoder:
    """The encoder that a worker keeps for its next tasks, which meet the same words."""
    return Encoder(path, known)


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * n):
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        if used.all() or slope.max() <= 1e-9 * scale:
            break
        used[int(np.argmax(slope))] = True
        while True:
            trial = np.zeros(n)
            trial[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if trial[used].min() > 0:
                break
            low = used & (trial <= 0)
            step = min(1.0, float(np.min(x[low] / (x[low] - trial[low] + 1e-300))))
            x = x + step * (trial - x)
            used &= x > 1e-12 * scale
            x[~used] = 0
            if not used.any():
                return x
        x = trial
    return x


@cache
def combinations(steps: int, depth: int) -> tuple[tuple[tuple[int, ...], ...], np.ndarray]:
    """The multisets of up to `depth` lengths (in steps, below a window) that fill a window, and how often each has each length."""
    found = [c for n in range(2, depth + 1) for c in combinations_with_replacement(range(1, steps), n) if sum(c) == steps]
    counts = np.zeros((steps - 1, len(found)))
    for j, c in enumerate(found):
        for length in c:
            counts[length - 1, j] += 1
    return tuple(found), counts


def plan(histogram: np.ndarray, steps: int = STEPS, depth: int = DEPTH, rounds: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often to fill one, for a histogram of the lengths 1 to steps - 1; never more than there are."""
    found, counts = combinations(steps, depth)
    left = histogram.astype(np.int64).copy()
    out = []
    for _ in range(rounds):  # what rounding leaves is solved for again
        x = nonnegative_least_squares(counts, left.astype(float))
        before = len(out)
        for j in np.argsort(-x, kind="stable"):
            need = counts[:, j].astype(np.int64)
            times = min(int(round(x[j])), int(np.min(left[need > 0] // need[need > 0])))
            if times > 0:
                left -= times * need
                out.append((found[j], times))
        if len(out) == before:
            break
    return out


def pack(lengths: list[int], window: int = WINDOW, steps: int = STEPS, depth: int = DEPTH) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full sequences of pieces (document, start, length), and the pieces left for less than a window.

    Whole windows are cut off first. Of each rest the part that is whole steps fills planned combinations; what
    the plan leaves over, and the bits below a step, follow one another greedily and are cut where a window is full.
    """
    step = window // steps
    full, rests, residual = [], defaultdict(list), []
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= window:
            full.append([(doc, at, window)])
            at += window
        whole = (n - at) // step
        if whole:
            rests[whole].append((doc, at, whole * step))
        if (n - at) % step:
            residual.append((doc, at + whole * step, (n - at) % step))
    histogram = np.array([len(rests[i]) for i in range(1, steps)])
    if histogram.any():
        for lengths_, times in plan(histogram, steps, depth):
            for _ in range(times):
                full.append([rests[i].pop() for i in lengths_])
    residual += [x for i in sorted(rests, reverse=True) for x in rests[i]]
    return _greedy(residual, full, window)


def _greedy(pieces: list, full: list, window: int) -> tuple[list, list]:
    """Adds to full the windows that the pieces fill in their order, cut where one is full; returns what is left too."""
    now, room = [], window
    for doc, start, n in pieces:
        while n >= room:
            full.append([*now, (doc, start, room)])
            start, n, now, room = start + room, n - room, [], window
        if n:
            now.append((doc, start, n))
            room -= n
    return full, now


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces as sequences whose lengths are powers of two, largest first: these need no padding."""
    total, out, queue = sum(n for _, _, n in pieces), [], list(pieces)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        now = []
        while size:
            doc, start, n = queue.pop(0)
            cut = min(n, size)
            now.append((doc, start, cut))
            size -= cut
            if n > cut:
                queue.insert(0, (doc, start + cut, n - cut))
        out.append(now)
    return out


def _pack_partition(path: str, window: int, end: int, block_tokens: int, known: int = CACHED, keep: bool = False):
    def run(batches):
        encoder = _kept(path, known) if keep else Encoder(path, known)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        last = np.asarray([end], "<u4").tobytes()
        docs: list = []  # id, all token ids, ids before the part that is still to be packed
        held: list = []

        def rows(sequences):
            nonlocal sequence
            out = {c.split()[0]: [] for c in _SCHEMA.split(", ")}
            for pieces in sequences:
                offset = 0
                for doc, start, n in pieces:
                    doc_id, ids = docs[doc]
                    for c, v in zip(out, (doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, sequence, offset)):
                        out[c].append(v)
                    offset += n
                sequence += 1
            kinds = [pa.binary() if c == "ids" else pa.int64() for c in out]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

        def settle(lengths_from):
            """Packs the documents after the held ones; what is left is held, with its documents only."""
            nonlocal docs, held
            full, left = pack([0] * lengths_from + [len(x) // 4 for _, x in docs[lengths_from:]], window)
            full, left = _greedy(held + left, full, window)
            yield from (rows(full[i : i + 256]) for i in range(0, len(full), 256))
            used = sorted({d for d, _, _ in left})
            place = {d: i for i, d in enumerate(used)}
            docs, held = [docs[d] for d in used], [(place[d], s, n) for d, s, n in left]

        done, tokens = 0, 0
        for batch in portions(batches, AT_ONCE):
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            try:
                codes = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
            except BaseException:
                _kept.cache_clear()  # it may hold chunks without their ids
                raise
            for doc_id, code in zip(ids, codes):
                docs.append((doc_id, code + last))
                tokens += len(code) // 4 + 1
            if tokens >= block_tokens:
                yield from settle(done)
                done, tokens = len(docs), 0
        yield from settle(done)
        if held:
            yield rows(powers_of_two(held))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, block_tokens: int = BLOCK_TOKENS, known: int = CACHED, keep: bool = False) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most `window` tokens, and returns a row for each piece.

    A document is the tokenizer's ids of its whole text (null: none) and then `end`; pieces lie side by side in it, and
    in their sequence from offset 0. Every partition packs its own documents, in blocks of `block_tokens`, so nothing is
    shuffled; only a partition's last tokens don't fill a window, and go to sequences whose lengths are powers of two.
    Rows that repeat a doc_id, or have none, are documents of their own. sequence_id is unique but has gaps.
    tokenizer: a file of the library tokenizers, which every executor can read. known: chunks and words, each, whose ids a worker
    keeps; fewer cost time, and results are the same. keep: a worker keeps its tokenizer and these ids for its next task, which saves
    time and holds the memory as long as the worker lives. An empty table gives an empty table.
    """
    return docs.select("doc_id", "text").mapInArrow(tidy(_pack_partition(tokenizer, window, end, block_tokens, known, keep)), _SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

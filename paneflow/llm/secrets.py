"""Secret scans: fixed patterns, and a battery of randomness tests on what else looks drawn at random (operator 4)."""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

KINDS = ("assign", "access", "hex", "random")
# The patterns of secrets that have a form.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("passw", "secret", "token", "api")
#: Candidates of the randomness tests: as long as this at least.
LEAST = 20
# In the letters of base64 and of base64url, with padding at the end only: `=` between a name and a value parts them.
_CANDIDATES = [re.compile(r"[A-Za-z0-9%s]{%d,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?" % (more, LEAST)) for more in ("+/", "_-")]
# Alphabets in the order in which an encoding is inferred.
_ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alphanumeric", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in _ALPHABETS}
#: Share of false reports among the tokens that are reported as random.
RATE = 0.001
#: A test with a p-value below this rejects by itself that a token is drawn at random.
NOT_RANDOM = 2e-5
# Words and endings of which ordinary long tokens are made (names in code, files, titles, products, long words).
_WORDS = (
    "a about account after all and any api app archive article auto back base before blue book box build by cache case chapter check class client code column config "
    "content control count create data date day default delete description edition email end error event export field file final find first for form format from full "
    "function get group hash header home house id image import in index info input item key label last layout left length level library line link list local log login "
    "main manager max message method min model module month name network new next node not number object of on open option order output page parameter part party path phone "
    "photo plan plus policy post price pro product project query rate raw read record report request result right root row run sample save schema search section select send "
    "server service session set size social sort source start state status step store string style system table target temp test text the time title to total type "
    "update upload url user value version view water week window with word work world write year zone "
    "arbeit bericht der die und haus jahr stadt strasse zeit zug avec eau est jour les maison pour rue ville casa con del fecha libro los para tiempo"
).split()
_ENDINGS = "able ation ational ed er ers es ing isation ism ist ity ization ly ment ness ological s tion ung".split()
#: Ordinary tokens that the tests are calibrated on, for each of some lengths.
CALIBRATED, LENGTHS = 200, (20, 24, 28, 32, 40, 56, 80, 128)


def _normal_tail(z: float) -> float:
    """Probability that a standard normal number lies as far from 0 as z."""
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, n: int) -> float:
    """Probability of at least x under chi-squared with n degrees of freedom (Wilson and Hilferty)."""
    z = ((max(x, 1e-9) / n) ** (1 / 3) - (1 - 2 / (9 * n))) / math.sqrt(2 / (9 * n))
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(token: str) -> str | None:
    """The first alphabet that holds the token, without padding at its end; None if there is none."""
    letters = set(token.rstrip("="))
    return next((name for name, places in _PLACES.items() if letters <= places.keys()), None)


def uniformity(codes: np.ndarray, size: int) -> float:
    """Chi-squared test that all letters are as likely, over as many equal classes as the length supports."""
    classes = max(2, min(size, 1 << int(math.log2(max(2, len(codes) // 4)))))
    seen = np.bincount(codes * classes // size, minlength=classes)
    share = np.bincount(np.arange(size) * classes // size, minlength=classes) / size
    wanted = share * len(codes)
    return _chi_tail(float(((seen - wanted) ** 2 / wanted).sum()), classes - 1)


def runs_test(codes: np.ndarray, size: int) -> float:
    """Wald and Wolfowitz's test of the runs of letters in the upper and the lower half of the alphabet."""
    high = codes * 2 >= size
    a, b = int(high.sum()), int((~high).sum())
    n = a + b
    if a == 0 or b == 0:
        return 2.0 ** (1 - n)
    mean = 1 + 2 * a * b / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return _normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial_test(codes: np.ndarray) -> float:
    """Test that each letter is uncorrelated with the one before it."""
    x = codes - codes.mean()
    total = float(x @ x)
    n = len(x)
    if total == 0:
        return 0.0
    return _normal_tail((float(x[1:] @ x[:-1]) / total + 1 / n) * math.sqrt(n))


def ordinary_token(rng: random.Random, length: int) -> str:
    """An ordinary token of at least `length` characters: words, numbers, dates and codes in one of the usual spellings."""
    spelling = rng.choice(("camel", "Camel", "_", "-", "/", "UPPER_", "", "UPPER", "long", "number"))
    if spelling == "number":
        mark = rng.choice(("", "", "-", "_", "/"))
        out = str(rng.randrange(1, 10**6))
        while len(out) < length:
            out += mark + rng.choice((f"{rng.randrange(1990, 2030)}{rng.randrange(1, 13):02}{rng.randrange(1, 29):02}", str(rng.randrange(10 ** rng.randrange(1, 9))), str(rng.randrange(10)) * 6))
        return out
    parts: list[str] = []
    while sum(map(len, parts)) < length:
        word = rng.choice(_WORDS) + (rng.choice(_ENDINGS) if rng.random() < (0.8 if spelling == "long" else 0.2) else "")
        parts.append(word.capitalize() if spelling.lower() == "camel" and (parts or spelling == "Camel") else word.upper() if "UPPER" in spelling else word)
        draw = rng.random()
        if draw < 0.25 and spelling != "long":
            parts.append(str(rng.randrange(10 ** rng.randrange(1, 5))))
        elif draw < 0.3 and spelling != "long":
            parts.append("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randrange(1, 4))) + str(rng.randrange(10 ** rng.randrange(2, 5))))
    return spelling[-1:].join(parts) if spelling in ("_", "-", "/", "UPPER_") else "".join(parts)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@cache
def _ordinary_pairs() -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of how likely in ordinary tokens a kind follows a kind, and a letter follows a letter (26: no letter)."""
    rng = random.Random(3)
    kinds, letters = np.full((4, 4), 0.5), np.full((27, 26), 0.3)
    for _ in range(4000):
        token = ordinary_token(rng, 20)
        for a, b in zip(token, token[1:]):
            kinds[_kind(a), _kind(b)] += 1
            if b.isalpha():
                letters[ord(a.lower()) - 97 if a.isalpha() else 26, ord(b.lower()) - 97] += 1
    return tuple(np.log(x / x.sum(1, keepdims=True)) for x in (kinds, letters))


def _letter(c: str) -> int:
    return ord(c.lower()) - 97 if c.isalpha() else 26


@cache
def _pair_scores(name: str) -> dict[str, dict[str, float]]:
    """Of an encoding: how much more likely a character after another is in ordinary tokens than at random (logarithm)."""
    kinds, letters = _ordinary_pairs()
    count = np.bincount([_kind(c) for c in _PLACES[name]], minlength=4)
    out: dict = {}
    for a in _PLACES[name]:
        out[a] = {b: kinds[_kind(a), k := _kind(b)] - math.log(count[k] / count.sum()) + (letters[_letter(a), _letter(b)] + math.log(count[k]) if k < 2 else 0) for b in _PLACES[name]}
    return out


def pairs_test(token: str, name: str) -> float:
    """How much more likely the characters of a token, each after the one before, are in ordinary tokens than at random in the encoding."""
    scores = _pair_scores(name)
    return float(sum(scores[a][b] for a, b in zip(token, token[1:])))


def departure(token: str) -> tuple[float, float]:
    """How far a token is from being drawn at random in its encoding, by all tests (infinite where it has no encoding), and the
    least p-value of a single one.

    Uniformity, runs, serial correlation and the shares of kinds of letters count by the logarithm of their p-value, up to 12
    each, and pairs of characters by their logarithm of likelihoods.
    """
    token = token.rstrip("=")
    name = encoding(token)
    if name is None or len(token) < LEAST:
        return math.inf, 0.0
    places = _PLACES[name]
    codes = np.array([places[c] for c in token], np.int64)
    tests = [uniformity(codes, len(places)), runs_test(codes, len(places)), serial_test(codes)]
    shares = [(sum(map(str.isdigit, token)), sum(map(str.isdigit, places)))]
    if name not in ("hex", "HEX", "base32"):
        shares.append((sum(map(str.isupper, token)), 26))
    for seen, of in shares:
        share, wanted = seen / len(token), of / len(places)
        tests.append(_normal_tail((share - wanted) * math.sqrt(len(token) / (wanted * (1 - wanted)))))
    return sum(min(12.0, -math.log(max(p, 1e-9))) for p in tests) + pairs_test(token, name), min(tests)


@cache
def _calibration() -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the departure of ordinary tokens, for each of LENGTHS."""
    rng = random.Random(4)
    out = []
    for length in LENGTHS:
        found = [departure(ordinary_token(rng, length)[:length])[0] for _ in range(CALIBRATED)]
        found = [x for x in found if x < math.inf]
        out.append((np.mean(found), np.std(found)))
    return tuple(np.array(x) for x in zip(*out))


def randomness(token: str) -> float:
    """A p-value for the hypothesis that the token is an ordinary one: how likely such a token of its length departs as little from
    randomness. 1 for a token that a single test finds not random, as one of a few characters in turn."""
    seen, least = departure(token)
    if least < NOT_RANDOM:
        return 1.0
    mean, spread = _calibration()
    n = len(token.rstrip("="))
    z = (seen - np.interp(n, LENGTHS, mean) * max(1.0, n / LENGTHS[-1])) / (np.interp(n, LENGTHS, spread) * max(1.0, n / LENGTHS[-1]))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def reported(p: list[float], lengths: list[int], rate: float = RATE) -> list[bool]:
    """Which tokens are random, at a false-discovery rate over the tokens of a text.

    Benjamini and Hochberg's rule on p-values divided by weights with mean 1. The weights grow with the square root of the
    length, as the tests see more in longer tokens.
    """
    if not p:
        return []
    weights = np.sqrt(np.array(lengths, float))
    q = np.array(p) / (weights / weights.mean())
    order = np.argsort(q, kind="stable")
    under = np.flatnonzero(q[order] <= rate * np.arange(1, len(q) + 1) / len(q))
    out = np.zeros(len(q), bool)
    if len(under):
        out[order[: under[-1] + 1]] = True
    return out.tolist()


def _candidates(text: str) -> list[tuple[int, int]]:
    """Spans of what the tests look at: runs of base64's and of base64url's letters, each span once."""
    return sorted({m.span() for pattern in _CANDIDATES for m in pattern.finditer(text)})


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text in code points, by start and then kind as listed.

    The three fixed kinds are found as their patterns say. Other long tokens of an encoding's letters, outside those spans,
    are of kind `random` if the tests reject that they are ordinary; one within another kept one is left out.
    """
    spans = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found = [(a, b) for a, b in _candidates(text) if not any(x < b and a < y for _, x, y in spans)]
    tokens = [text[a:b] for a, b in found]
    kept = [x for x, yes in zip(found, reported([randomness(x) for x in tokens], [len(x) for x in tokens])) if yes]
    upto = -1
    for a, b in sorted(kept, key=lambda x: (x[0], -x[1])):
        if b > upto:
            spans.append(("random", a, b))
            upto = b
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str = "[secret]") -> str:
    """text with every span, merged where they overlap, replaced by mask."""
    parts, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if a >= at:
            parts += [text[at:a], mask]
        at = max(at, b)
    return "".join([*parts, text[at:]])


_SCAN = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def _scan(batches):
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        out = {c.split()[0]: [] for c in _SCAN.split(", ")[1:]}
        for text in batch.column("text").to_pylist():
            spans = find_secrets(text or "")
            kinds = [x[0] for x in spans]
            base = _joined([x for x in spans if x[0] != "random"])
            row = (*(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), _joined(spans))
            for c, v in zip(out, row):
                out[c].append(v)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(out.values(), kinds))], ["doc_id", *out])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets in each row of docs (doc_id, text), as find_secrets finds them.

    Returns a row for each row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256 (of the fixed kinds' spans),
    spans (all, kind:start:end, comma-joined). A null or empty text has none. Rows are looked at one by one, so repeated
    rows, null ids and other columns make no difference.
    """
    return docs.select("doc_id", "text").mapInArrow(tidy(_scan), _SCAN)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with its columns, the secrets in `text` masked; `n_chars`, if there is one, follows.

    A null text stays null, an empty one empty. Rows are looked at one by one and only the text is read, so null ids, repeated
    rows and other columns make no difference; texts may be of any length. An empty table gives an empty table.
    """
    schema = docs.schema
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = [x if x is None else masked(x, find_secrets(x)) for x in batch.column("text").to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[names.index("text")] = pa.array(texts, batch.column("text").type)
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([None if x is None else len(x) for x in texts], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")

"""Exact search for repeated windows: the part that substring dedup by words and by bytes have in common.

A window is k consecutive units (words or bytes) of one document. The smallest hash among the grams of g units in a
window is its minimiser; equal windows have equal minimisers. Consecutive windows with the same minimiser travel as
one packed string (a super-k-mer), so the strings that could be equal meet in one bucket:

1. `_census`: each document's minimisers go to hash buckets, as 32 bits beside the bucket's number; those that occur once can't belong to
   a repeated window and are dropped, which keeps what travels later in proportion to what repeats.
2. `_pack`: packed strings with the other minimisers go to buckets. A string that repeats within an Arrow batch
   travels once, so that a passage in a third of all documents costs one string a batch. A minimiser of more than `hot_strings`
   different strings is dealt by the hash of each whole window instead, so no bucket holds them all. The list of these is
   broadcast: the HOT_MOST with the most strings, so any other has at most that part of all strings.
3. `resolve` (given by the operator) sorts the windows of a bucket's strings and says which of them are to be removed.
4. The windows found are brought back to their documents.

These hashes only choose what travels; windows are compared in full, so a collision costs time and no result.
Documents meet their windows again by the shuffle key `rid32`, 31 bits of a hash of doc_id and text, so copies of a text
are dealt apart; the joins share one exchange of the texts. Rows that repeat a doc_id with another text are told apart by it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, groups_of, mix, portions, powers, text_volume, tidy, word_hashes

_LOW = np.uint64((1 << 24) - 1)
#: Units handled at once; bounds a worker's memory, also for very long texts.
SLICE = 1 << 18
#: Text bytes for each hash bucket of packed strings, and of minimisers; and how many buckets there are at least.
BUCKET_BYTES, CENSUS_BYTES = 3 << 20, 10 << 20
BUCKETS = 64
#: Parts of a bucket, and bytes of those that are sorted together.
PARTS, SORTED_BYTES = 16, 1 << 20
#: Strings that a minimiser may have before its windows are dealt one by one; about as many as a bucket holds.
HOT_STRINGS = 8192
#: Minimisers dealt so at most, those with the most strings: 8 MB that every task gets.
HOT_MOST = 1 << 20
#: Parts in which the copies of one text are looked for.
SALTS = 32
_CENSUS_SCHEMA = "bucket int, a binary, b binary, strings binary"
_PACK_SCHEMA = "bucket int, part byte, packed binary, doc long, rid32 int, start long, many boolean, flags binary"


class Words:
    """Units are words; a packed string holds words joined by one space."""

    def __init__(self, texts: list[bytes]):
        found = [word_hashes(x) for x in texts]
        self.sizes = [len(x[0]) for x in found]
        self.hashes = np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.uint64)
        self.length = np.concatenate([b - a for a, b, _ in found]) if found else np.zeros(0, np.int64)
        self.texts = texts

    def codes(self, start: int, end: int) -> np.ndarray:
        return self.hashes[start:end]

    def packed(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """The strings of units from start to end, counted over all texts."""
        data = np.frombuffer(b" ".join(y for x in self.texts if (y := b" ".join(x.split()))), np.uint8)
        at = np.cumsum(self.length + 1) - self.length - 1
        return slices(data, at[start], at[end - 1] + self.length[end - 1])


class Bytes:
    """Units are bytes; a packed string is a slice of the text."""

    def __init__(self, texts: list[bytes]):
        self.sizes = [len(x) for x in texts]
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def codes(self, start: int, end: int) -> np.ndarray:
        return BYTE_CODES[self.data[start:end]]

    def packed(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        return slices(self.data, start, end)


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] of each pair as an array of byte strings."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(offsets[-1], np.uint8)
    for a, b in groups_of(size.tolist(), 1 << 20):
        at = np.arange(offsets[b] - offsets[a]) + np.repeat(start[a:b] - offsets[a:b] + offsets[a], size[a:b])
        out[offsets[a] : offsets[b]] = data[at]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of byte strings, and where each starts, with the end of the last."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def parted(data: np.ndarray, offsets: np.ndarray, mark: int) -> np.ndarray:
    """The strings that start at offsets, with a byte `mark` after each."""
    size = np.diff(offsets)
    out = np.full(len(data) + len(size), mark, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
    return out


def occurrences(code: np.ndarray, of: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string number in `wanted` the rows among `of` with that code: indices into wanted, and rows."""
    order = of[np.argsort(code[of], kind="stable")]
    low, high = (np.searchsorted(code[order], wanted, side) for side in ("left", "right"))
    n = high - low
    which = np.repeat(np.arange(len(wanted)), n)
    return which, order[np.arange(len(which)) + np.repeat(low - np.cumsum(n) + n, n)]


def _slice_runs(codes: np.ndarray, doc_end: np.ndarray, k: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, window after the last, minimiser, and hash of each window, of the runs of windows with one minimiser."""
    n = len(codes)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * up[:n], out=sums[1:])
    grams = mix((sums[g:] - sums[:-g]) * down[: n - g + 1])
    least = (grams & ~_LOW) | np.arange(n - g + 1, dtype=np.uint64)  # ties go to the leftmost
    span, width = 1, k - g + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    m = n - k + 1
    valid = np.arange(k, n + 1) <= doc_end[:m]
    change = np.ones(m + 1, bool)
    change[1:m] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    at = np.flatnonzero(change)
    first, last = at[:-1], at[1:]
    keep = valid[first]
    first, last = first[keep], last[keep]
    return first, last, grams[(least[first] & _LOW).astype(np.int64)], (sums, down)


def runs(units, k: int, g: int) -> Iterator[tuple]:
    """(document, first window, window after the last, minimiser) as arrays, and a function for the hashes of strings, slice by slice.

    That function takes numbers of runs, and of each the first unit and the one after the last.
    """
    offsets = np.concatenate(([0], np.cumsum(units.sizes))).astype(np.int64)
    parts = []
    for a, b in groups_of(units.sizes, SLICE):
        if b == a + 1 and units.sizes[a] > SLICE:
            for at in range(0, units.sizes[a] - k + 1, SLICE):
                parts.append((offsets[a] + at, min(offsets[a] + at + SLICE + k - 1, offsets[b])))
        else:
            parts.append((offsets[a], offsets[b]))
    for start, end in parts:
        if end - start < k:
            continue
        codes = units.codes(start, end)
        docs = np.arange(np.searchsorted(offsets, start, "right") - 1, np.searchsorted(offsets, end, "left"))
        edges = np.clip(offsets[docs[0] : docs[-1] + 2] - start, 0, end - start)
        doc_end = np.repeat(edges[1:], np.diff(edges))
        first, last, minimiser, (sums, down) = _slice_runs(codes, doc_end, k, g)
        doc = docs[np.searchsorted(edges, first, "right") - 1]
        shift = start - offsets[doc]

        def string_hash(run, a, b, sums=sums, down=down, shift=shift):
            return mix((sums[b - shift[run]] - sums[a - shift[run]]) * down[a - shift[run]])

        yield doc, first + shift, last + shift, minimiser, string_hash


def _tokens(minimiser: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high half, 32 bits of hash in the low half."""
    bucket = (minimiser >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return bucket << np.uint64(32) | (minimiser & np.uint64(0xFFFFFFFF))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _census(kind: type, k: int, g: int, buckets: int, once_a_doc: bool) -> Callable:
    """Minimisers by bucket: a (their low halves, in order) with b (their documents), or with the number of different strings that
    a minimiser has here where it repeats; then it also goes back at once, under its documents' rid32 (all 64 bits)."""

    def run(batches):
        for batch in batches:
            units = kind(_texts(batch))
            rid32 = np.asarray(batch.column("rid32").to_numpy(zero_copy_only=False)).astype(np.int32)
            docs, tokens, strings = [], [], []
            for doc, first, last, minimiser, string_hash in runs(units, k, g):
                docs.append(doc.astype(np.int32))
                tokens.append(_tokens(minimiser, buckets))
                strings.append(string_hash(np.arange(len(doc)), first, last + (k - 1)))
            if not docs:
                continue
            docs, tokens, strings = np.concatenate(docs), np.concatenate(tokens), np.concatenate(strings)
            order = np.argsort(tokens, kind="stable")  # documents come in order
            docs, tokens, strings = docs[order], tokens[order], strings[order]
            starts = _starts(tokens)
            sizes = np.diff(starts, append=len(tokens))
            again = np.repeat(sizes > 1, sizes)
            new = np.ones(len(docs), bool)
            if once_a_doc:
                new[1:] = (docs[1:] != docs[:-1]) | (tokens[1:] != tokens[:-1])
            times = np.add.reduceat(new.astype(np.int64), starts) if len(starts) else sizes
            many = np.repeat(times > 1, sizes)
            token, first = tokens[starts], docs[starts]
            different = np.ones(len(starts), np.int64)
            some = np.flatnonzero(again)
            some = some[np.lexsort((strings[some], tokens[some]))]
            if len(some):
                other = np.ones(len(some), np.int64)
                other[1:] = (tokens[some][1:] != tokens[some][:-1]) | (strings[some][1:] != strings[some][:-1])
                different[sizes > 1] = np.add.reduceat(other, _starts(tokens[some]))
            out = defaultdict(list)

            def put(bucket, a, b, n=None, out=out):
                for c, v in zip(("bucket", "a", "b", "strings"), (int(bucket), a, b, n)):
                    out[c].append(v)

            # what repeats in this batch goes back to its documents at once, and on to its bucket without them
            here = many & new
            order = np.argsort(docs[here], kind="stable")
            for doc, part in zip(*_split(docs[here][order], tokens[here][order])):
                put(rid32[doc] % buckets, part.tobytes(), rid32[doc : doc + 1].tobytes())
            bucket = (token >> np.uint64(32)).astype(np.int64)
            alone = (times == 1) & (different == 1)
            for b, part in zip(*_split(bucket[alone], np.flatnonzero(alone))):
                put(b, token[part].astype(np.uint32).tobytes(), rid32[first[part]].tobytes())
            single = (times == 1) & ~alone  # in one document, by several strings
            for b, part in zip(*_split(bucket[single], np.flatnonzero(single))):
                put(b, token[part].astype(np.uint32).tobytes(), rid32[first[part]].tobytes(), different[part].astype(np.uint32).tobytes())
            for b, part in zip(*_split(bucket[times > 1], np.flatnonzero(times > 1))):
                put(b, token[part].astype(np.uint32).tobytes(), None, different[part].astype(np.uint32).tobytes())
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(("bucket", "a", "b", "strings"), kinds)], ["bucket", "a", "b", "strings"])

    return run


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _split(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Values by key; keys are sorted."""
    if not len(keys):
        return [], []
    at = np.flatnonzero(np.diff(keys)) + 1
    return [keys[i] for i in np.concatenate(([0], at))], np.split(values, at)


def _repeated(hot_strings: int) -> Callable:
    """Of one bucket: for each document the tokens that occur again; what repeated within a batch passes through.

    Tokens of more than hot_strings different strings are given, each with their number, under a key below 0 that no
    document has.
    """

    def run(t: pa.Table) -> pa.Table:
        rid, tokens, found, owners, strings = [], [], [], [], []
        bucket = t.column("bucket")[0].as_py()
        high = np.uint64(bucket) << np.uint64(32)
        for batch in t.to_batches():
            for a, b, n in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "strings"))):
                if b is not None and len(a) > len(b):  # 64-bit tokens of one document
                    rid.append(int(np.frombuffer(b, np.int32)[0]))
                    tokens.append(a)
                else:
                    found.append(np.frombuffer(a, np.uint32))
                    owners.append(np.frombuffer(b, np.int32) if b is not None else np.full(len(a) // 4, -1, np.int32))
                    strings.append(np.frombuffer(n, np.uint32) if n is not None else np.ones(len(a) // 4, np.uint32))
        if found:
            found, owners, strings = np.concatenate(found), np.concatenate(owners), np.concatenate(strings)
            order = np.argsort(found, kind="stable")
            found, owners, strings = found[order], owners[order], strings[order]
            starts = _starts(found)
            sizes = np.diff(starts, append=len(found))
            total = np.add.reduceat(strings, starts, dtype=np.int64)
            hot = np.stack([found[starts].astype(np.uint64) | high, total.astype(np.uint64)], 1)[total > hot_strings]
            mine = np.repeat(sizes > 1, sizes) & (owners >= 0)
            found, owners = found[mine], owners[mine]
            order = np.argsort(owners, kind="stable")
            for r, part in zip(*_split(owners[order], found[order])):
                rid.append(int(r))
                tokens.append((part.astype(np.uint64) | high).tobytes())
            if len(hot):
                rid.append(-1 - bucket)
                tokens.append(hot.tobytes())
        return pa.table({"rid32": pa.array(rid, pa.int32()), "tokens": pa.array(tokens, pa.binary())})

    return run


def _pairs(batches):
    """The tokens below key 0 and how many strings each has."""
    for batch in batches:
        found = np.frombuffer(b"".join(x for some in batch.column("tokens").to_pylist() for x in some), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(x.copy()) for x in found.T], ["token", "n"])


def merged(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Ranges merged where they meet: the owners, numbers from 0, and each one's ranges as pairs of 64-bit numbers."""
    if not len(owner):
        return owner, pa.array([], pa.binary())
    order = np.lexsort((first, owner))
    owner = owner[order]
    apart = owner.astype(np.int64) << 40
    a, b = first[order] + apart, np.maximum.accumulate(last[order] + apart)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    ends = np.concatenate((at[1:], [len(a)])) - 1
    pairs = np.stack([a[at], b[ends]], 1) - apart[at, None]
    heads = _starts(owner[at])
    offsets = 16 * np.concatenate((heads, [len(at)]))
    return owner[at][heads], pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(pairs))])


def _pack(kind: type, k: int, g: int, lists_by: int, buckets: int, settle: Callable) -> Callable:
    """Packed strings of the minimisers that occur again.

    settle(string numbers, doc_ids) says which occurrences in a batch are found at once, which still travel, and which of
    these only tell that there is such a string.
    """

    def run(batches):
        hot = None
        for batch in batches:
            rid = np.asarray(batch.column("rid32").to_numpy(zero_copy_only=False)).astype(np.int32)
            ids = pc.fill_null(batch.column("doc"), 0).to_numpy(zero_copy_only=False)
            if hot is None:  # a partition's first row has the list
                hot = np.array(batch.column("hot")[0].as_py() or [], np.int64).astype(np.uint64)
            lists = [np.frombuffer(b"".join(x), np.uint64) for x in batch.column("tokens").to_pylist()]
            wanted = _with_doc(np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            units = kind(_texts(batch))
            offsets = np.concatenate(([0], np.cumsum(units.sizes))).astype(np.int64)
            parts: list[tuple] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
            for doc, first, last, minimiser, string_hash in runs(units, k, g):
                token = _tokens(minimiser, lists_by)
                mine = np.flatnonzero(np.isin(_with_doc(token, doc), wanted))
                dealt = np.isin(token[mine], hot) if len(hot) else np.zeros(len(mine), bool)
                one = mine[~dealt]
                parts.append((doc[one], first[one], last[one], mix(token[one])))
                if len(one := mine[dealt]):
                    n = last[one] - first[one]
                    run_ = np.repeat(one, n)
                    window = np.arange(len(run_)) + np.repeat(first[one] - np.cumsum(n) + n, n)
                    parts.append((doc[run_], window, window + 1, mix(string_hash(run_, window, window + k))))
            doc, first, last, route = (np.concatenate(x) for x in zip(*parts))
            strings = units.packed(offsets[doc] + first, offsets[doc] + last + k - 1) if len(doc) else pa.array([], pa.binary())
            code = strings.dictionary_encode().indices.to_numpy()
            now, travel, tells = settle(code, ids[doc])
            owner, found = merged(doc[now], first[now], last[now])
            at = np.flatnonzero(travel)
            none = len(owner)
            columns = [
                np.concatenate(((route[at] % np.uint64(buckets)).astype(np.int32), rid[owner] % buckets)),
                pa.concat_arrays([pa.array((route[at] >> np.uint64(40) & np.uint64(PARTS - 1)).astype(np.int8)), pa.nulls(none, pa.int8())]),
                pa.concat_arrays([strings.take(pa.array(at)), pa.nulls(none, pa.binary())]),
                np.concatenate((ids[doc[at]], ids[owner])),
                np.concatenate((rid[doc[at]], rid[owner])),
                pa.concat_arrays([pa.array(first[at]), pa.nulls(none, pa.int64())]),
                pa.concat_arrays([pa.array(tells[at]), pa.nulls(none, pa.bool_())]),
                pa.concat_arrays([pa.nulls(len(at), pa.binary()), found]),
            ]
            out = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [x.split()[0] for x in _PACK_SCHEMA.split(", ")])
            yield from (out.slice(i, 1 << 14) for i in range(0, out.num_rows, 1 << 14))

    return run


def _with_doc(token: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(token + mix(doc.astype(np.uint64)))


def _bucket(resolve: Callable) -> Callable:
    """Of one bucket: the repeated windows of each document; what was found before passes through.

    resolve gets the different strings of a part, and of each occurrence the string's number, doc, start, and whether it only
    tells that there is such a string. It returns occurrences with their windows to be removed: (rows, firsts, lasts).
    """

    def run(t: pa.Table) -> pa.Table:
        names = ["rid32", "doc", "flags"]
        out = [t.filter(pc.is_null(t.column("packed"))).select(names)]
        t = t.filter(pc.is_valid(t.column("packed")))
        part = t.column("part").to_numpy().astype(np.int64)
        size = np.bincount(part, pc.binary_length(t.column("packed")).to_numpy(), PARTS)
        owners = []
        for low, high in groups_of(size.tolist(), SORTED_BYTES):
            rows = t.filter(pa.array((low <= part) & (part < high)))
            if not rows.num_rows:
                continue
            found = rows.column("packed").combine_chunks().dictionary_encode()
            rid, doc, start = (rows.column(c).to_numpy() for c in ("rid32", "doc", "start"))
            at, first, last = resolve(found.dictionary, found.indices.to_numpy(), doc, start, rows.column("many").to_numpy(zero_copy_only=False))
            owners.append((rid[at], doc[at], first, last))
        if owners:
            rid, doc, first, last = (np.concatenate(x) for x in zip(*owners))
            order = np.lexsort((doc, rid))
            new = np.ones(len(order), bool)
            new[1:] = (rid[order][1:] != rid[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            own = np.empty(len(order), np.int64)
            own[order] = np.cumsum(new) - 1
            owner, flags = merged(own, first, last)
            head = order[new][owner]
            out.append(pa.table([pa.array(rid[head]), pa.array(doc[head]), flags], names))
        return pa.concat_tables(out)

    return run


def _without_copies(batches):
    """Rows with empty texts for those that take no part: copies of smaller documents, and rows without doc_id."""
    for batch in portions(batches):
        texts, ids, copies = (batch.column(c).to_pylist() for c in ("text", "doc", "copies"))
        if any(i is None or c for i, c in zip(ids, copies)):
            texts = ["" if i is None or c and i in c else x for x, i, c in zip(texts, ids, copies)]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column("text").type))
        yield batch


def _copies(d: DataFrame) -> DataFrame:
    """rid32 and `copies`, the doc_ids under it whose text a smaller doc_id has as well; no text is shuffled.

    The copies of one text are looked for in SALTS parts, so a text that very many documents have isn't one task.
    """
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt")
    rows = d.filter("doc IS NOT NULL").select("rid32", "doc", F.unhex(F.sha1("text")).alias("digest"), salt)
    parts = rows.groupBy("digest", "salt").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n"))
    texts = parts.groupBy("digest").agg(F.min("least").alias("least"), F.sum("n").alias("n")).filter("n > 1")
    texts = texts.select("digest", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.join(texts, ["digest", "salt"]).filter("doc > least").groupBy("rid32").agg(F.collect_set("doc").alias("copies"))


def repeated_windows(docs: DataFrame, kind: type, k: int, g: int, settle: Callable, resolve: Callable, first_stays: bool, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """docs (doc_id, text) as rid32, doc, text with `found`, a list of (doc, flags) of the windows to be removed, and `copies`.

    first_stays: only what occurs in a smaller doc_id is removed. Then a text that a smaller doc_id has as well takes no
    part, as all of it goes: `copies` lists such doc_ids. A row whose doc_id is null takes no part and finds nothing.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.select(F.shiftrightunsigned(F.xxhash64("doc", "text"), 33).cast("int").alias("rid32"), "doc", "text")
    _, volume = text_volume(docs)
    buckets, lists_by = (max(BUCKETS, -(-volume // x)) for x in (BUCKET_BYTES, CENSUS_BYTES))
    d = d.join(_copies(d), "rid32", "left") if first_stays else d.withColumn("copies", F.lit(None).cast("array<long>"))
    census = d.mapInArrow(_after(_without_copies, _census(kind, k, g, lists_by, first_stays)), _CENSUS_SCHEMA)
    again = census.groupBy("bucket").applyInArrow(tidy(_repeated(hot_strings)), "rid32 int, tokens binary")
    again = again.filter("rid32 IS NOT NULL").groupBy("rid32").agg(F.collect_list("tokens").alias("tokens"))
    hot = again.filter("rid32 < 0").select("tokens").mapInArrow(_pairs, "token long, n long").orderBy(F.desc("n"), "token").limit(HOT_MOST)
    hot = hot.agg(F.collect_list("token").alias("all"))  # one row of HOT_MOST numbers at most
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    told = d.join(again, "rid32").crossJoin(F.broadcast(hot)).withColumn("hot", F.when(first, F.col("all"))).drop("all")
    packs = told.mapInArrow(_after(_without_copies, _pack(kind, k, g, lists_by, buckets, settle)), _PACK_SCHEMA)
    flags = packs.groupBy("bucket").applyInArrow(tidy(_bucket(resolve)), "rid32 int, doc long, flags binary")
    flags = flags.groupBy("rid32").agg(F.collect_list(F.struct("doc", "flags")).alias("found"))
    return d.join(flags, "rid32", "left")


def _after(first: Callable, then: Callable) -> Callable:
    """Both steps in one worker."""
    def run(batches):
        yield from then(first(batches))

    return tidy(run)


def covered(found: list | None, doc: int | None, k: int) -> np.ndarray:
    """Unit ranges (start, end) that a row's repeated windows cover, merged where they overlap or touch."""
    mine = [np.frombuffer(x["flags"], np.int64).reshape(-1, 2) for x in found or () if x["doc"] == doc]
    if not mine:
        return np.zeros((0, 2), np.int64)
    pairs = np.concatenate(mine)
    ranges = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1] + k - 1)[1]
    return np.frombuffer(ranges[0].as_py(), np.int64).reshape(-1, 2)

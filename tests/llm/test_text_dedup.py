"""Word and byte repeats, and near-duplicates, against brute force on small tables with every odd case."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paneflow.llm import common, minhash, repeats, substrings, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Rows of (doc_id, text), with the other columns of documents, and one whose name clashes with the operators' own."""
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)
    return df.withColumn("flags", F.lit(1)).withColumn("rid32", F.lit("x")).withColumn("packed", F.lit(None).cast("string"))


def corpus(seed, n=60, words=400):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["é", "ñandú", "日本", "A", "a"]
    passage = [rng.choice(vocab) for _ in range(70)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 20, 34, 35, 36, 90, words]))]
        if rng.random() < 0.5:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(20) : rng.randrange(50, 71)]
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, rows[9][1] + " more"), (1003, None), (1004, ""), (1005, " \n "), (1006, "x" * 200), (1007, "ab" * 300)]
    rows += [(1008, " ".join(passage * 3)), (None, rows[5][1]), (None, None), (7777, "same id"), (7777, "same id"), (7777, " ".join(passage[:60]))]
    return rows


def words_of(text):
    return (text or "").encode().split()


def brute_words(rows, k):
    taking_part = [(i, words_of(t)) for i, t in rows if i is not None]
    count = Counter(tuple(w[a : a + k]) for _, w in taking_part for a in range(len(w) - k + 1))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for a in range(len(w) - k + 1):
            if i is not None and count[tuple(w[a : a + k])] > 1:
                gone |= set(range(a, a + k))
        out.append((i, len(w), len(gone), b" ".join(x for a, x in enumerate(w) if a not in gone).decode()))
    return sorted(out, key=str)


def brute_bytes(rows, k):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - k + 1 if i is not None else 0):
            first[b[a : a + k]] = min(first.get(b[a : a + k], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - k + 1 if i is not None else 0):
            if first[b[a : a + k]] < i:
                gone[a : a + k] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, hot", [(1, None), (2, 1)])
def test_repeated_words(spark, seed, hot):
    rows = corpus(seed)
    df = frame(spark, rows).repartition(5)
    got = substrings.remove_repeated_words(df, hot_strings=hot).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute_words(rows, 35)


@pytest.mark.parametrize("seed, hot", [(1, None), (2, 1)])
def test_repeated_bytes(spark, seed, hot):
    rows = corpus(seed, n=30, words=150)
    df = frame(spark, rows).repartition(5)
    got = suffixes.remove_repeated_bytes(df, hot_strings=hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute_bytes(rows, 50)


def test_a_text_longer_than_a_slice(spark, monkeypatch):
    rng = random.Random(4)
    long = " ".join("w%d" % rng.randrange(10**6) for _ in range(3000))
    rows = [(1, long), (2, "start " + long[7000:9000] + " end"), (3, long[:400])]
    codes = list(repeats.runs(repeats.Bytes([r[1].encode() for r in rows]), 50, 25))
    monkeypatch.setattr(repeats, "SLICE", 512)
    cut = list(repeats.runs(repeats.Bytes([r[1].encode() for r in rows]), 50, 25))

    def windows(found):
        return sorted((int(d), w, int(m)) for doc, a, b, mm, _ in found for d, s, e, m in zip(doc, a, b, mm) for w in range(s, e))

    assert len(cut) > len(codes) and windows(cut) == windows(codes)
    assert len(windows(codes)) == sum(len(r[1]) - 49 for r in rows)
    assert [x.tolist() for x in common.word_hashes(long.encode(), 100)] == [x.tolist() for x in common.word_hashes(long.encode())]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substrings.remove_repeated_words(none).count() == 0
    assert suffixes.remove_repeated_bytes(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.keep_one_of_each(none).columns == none.columns


def test_sql_agrees(spark):
    rows = [r for r in corpus(8, n=25, words=120) if r[0] is not None and r[0] < 7777]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    df = frame(spark, rows)
    got = substrings.remove_repeated_words(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(substrings.OP2_SQL).fetchall())
    got = suffixes.remove_repeated_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(suffixes.OP9_SQL).fetchall())
    got = minhash.near_duplicates(df).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(minhash.OP7_SQL).fetchall())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\x00é", max_size=40), min_size=1, max_size=8), st.integers(2, 12))
def test_suffix_array_sorts(texts, depth):
    codes = np.frombuffer(b"\xff".join(x.encode() for x in texts) + b"\xff", np.uint8) + np.uint8(1)
    order = suffixes.suffix_array(codes, depth)
    assert sorted(order.tolist()) == list(range(len(codes)))

    def head(i):
        s = codes[i : i + depth].tolist()
        return s[: s.index(0) + 1] if 0 in s else s

    heads = [head(i) for i in order.tolist()]
    assert heads == sorted(heads)
    shared = suffixes.common_prefixes(codes, order, depth)
    for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), shared[1:].tolist()):
        x, y = codes[a : a + depth].tolist(), codes[b : b + depth].tolist()
        x, y = x + [0] * (depth - len(x)), y + [0] * (depth - len(y))
        assert n == next((i for i in range(depth) if x[i] != y[i]), depth)


def test_only_suffixes_below_their_successor_are_sorted_directly():
    codes = np.frombuffer(b"banana\x00", np.uint8)
    smaller = suffixes.smaller_than_successor(codes)
    text = bytes(codes)
    assert smaller.tolist() == [text[i:] < text[i + 1 :] if i + 1 < len(text) else True for i in range(len(text))]


def test_hash_collisions_do_not_merge_windows():
    words = [b"a", b"b", b"c", b"a", b"b", b"d"]
    text = b" ".join(words)
    starts, ends, _ = common.word_hashes(text)
    labels = substrings._same_windows(text, starts, ends, np.arange(5), np.zeros(5, np.uint64), 2)
    seen = defaultdict(set)
    for i, label in enumerate(labels.tolist()):
        seen[label].add((words[i], words[i + 1]))
    assert all(len(x) == 1 for x in seen.values()) and len(seen) == 4


# ---- near-duplicates


def brute_near(rows, n, num=80, den=100):
    table = bytes(range(256)).replace(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(table).split()
        m = min(n, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set())
    ids = [i for i, _ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    least = {}
    for a, i in enumerate(ids):
        if i is not None:
            least[top(a)] = min(least.get(top(a), i), i)
    out = []
    for a, i in enumerate(ids):
        c = None if i is None else least[top(a)] if sets[a] else i
        out.append((i, len(sets[a]), c, i is None or c == i))
    return sorted(out, key=str)


def near_corpus(seed):
    """Families of copies with one to many edits, families without the text they stem from, and odd rows."""
    rng = random.Random(seed)
    rows = []
    for family in range(6):
        base = ["f%dw%d" % (family, rng.randrange(500)) for _ in range(rng.choice([8, 40, 150]))]
        for copy in range(14):
            w = list(base)
            for _ in range(0 if copy == 0 and family % 2 else rng.choice([0, 1, 2, len(w) // 12, len(w) // 9, len(w) // 7])):
                w[rng.randrange(len(w))] = "e%d" % rng.randrange(10**6)
            rows.append((rng.randrange(10**9), " ".join(w).upper() if rng.random() < 0.1 else "\n".join(w)))
    rows += [(5, None), (6, ""), (7, "  "), (8, "One"), (9, "one"), (10, "one two"), (11, "ONE  two"), (12, "one two three"), (13, "É two"), (14, "é two")]
    rows += [(None, rows[0][1]), (None, None), (20, rows[3][1]), (20, rows[3][1]), (20, "another text under this id that is long enough to have a set")]
    return rows


@pytest.mark.parametrize("seed, words, block", [(1, 2, 512), (2, 2, 3), (3, 5, 5)])
def test_near_duplicates(spark, seed, words, block):
    rows = near_corpus(seed)
    got = minhash.near_duplicates(frame(spark, rows).repartition(3), words=words, block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute_near(rows, words)


def test_no_link_of_a_chain_is_lost(spark):
    """Each text differs from the next by a few words; all are one component though the ends share nothing."""
    words = ["c%d" % i for i in range(400)]
    rows = [(100 - i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)]
    got = minhash.near_duplicates(frame(spark, rows), block=4).collect()
    assert {r.component_id for r in got} == {61}


def test_one_of_each_stays(spark):
    rows = near_corpus(4)
    df = frame(spark, rows)
    kept = minhash.keep_one_of_each(df, words=5)
    assert kept.columns == df.columns
    expect = Counter(i for i, _, _, stays in brute_near(rows, 5) if stays)
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter({i: n if i is None else 1 for i, n in expect.items()})


@pytest.mark.parametrize("seed", range(6))
def test_merged_lists_connect_what_all_pairs_connect(seed, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS", [5, 1 << 17][seed % 2])
    rng = np.random.default_rng(seed)
    n, coordinates, matches = 80, 12, 5
    base = rng.integers(0, 6, (8, coordinates))
    node = np.sort(rng.integers(0, 50, n))
    signature = np.where(rng.random((50, coordinates)) < 0.5, base[rng.integers(0, 8, 50)], rng.integers(0, 9, (50, coordinates)))
    values = signature[node].astype(np.uint16)
    own = rng.integers(0, coordinates, n)
    _, group = np.unique(np.stack([own, values[np.arange(n), own]], 1), axis=0, return_inverse=True)
    root = rng.integers(0, 20, 50)
    a, b = minhash.merge_lists(values, group.reshape(-1), own, root[node], node, lambda x, y: (node[x] + node[y]) % 7 > 0, matches)

    def joined(pairs):
        parent = list(range(20))

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in pairs:
            parent[top(root[x])] = top(root[y])
        return {frozenset(y for y in range(20) if top(y) == top(x)) for x in range(20)}

    same = lambda x, y: int((values[x] == values[y]).sum())
    every = [(node[x], node[y]) for x in range(n) for y in range(x) if group.reshape(-1)[x] == group.reshape(-1)[y] and (node[x] + node[y]) % 7 > 0 and same(x, y) >= matches]
    assert joined(zip(a.tolist(), b.tolist())) == joined(every)
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist())} <= {frozenset(map(int, x)) for x in every}


@pytest.mark.parametrize("seed", range(6))
def test_merged_lists_connect_the_nodes_of_all_pairs(seed, monkeypatch):
    """Two roots that one pair connects may have other pairs, which only are links if the first isn't."""
    monkeypatch.setattr(minhash, "PAIRS", [5, 1 << 17][seed % 2])
    same, nodes = np.arange(12), 6 if seed < 2 else 60
    rng = np.random.default_rng(seed)
    base = np.stack([same, same + 100, same + 200])
    base[:, 0] = 7  # all are in one post
    signature = base[np.arange(nodes) % 3] if seed < 2 else np.where(rng.random((nodes, 12)) < 0.6, base[rng.integers(0, 3, nodes)], rng.integers(0, 400, (nodes, 12)))
    signature[:, 0] = 7
    root, node = (np.arange(nodes) // 3 if seed < 2 else rng.integers(0, 5, nodes)), np.arange(nodes)
    a, b = minhash.merge_lists(signature.astype(np.uint16), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), root, node, lambda x, y: x >= 0, 5)
    every = [(x, y) for x in range(nodes) for y in range(x) if root[x] != root[y] and (signature[x] == signature[y]).sum() >= 5]
    parent = minhash.Roots(nodes)
    parent.join(a, b)
    assert every and all(parent.of[x] == parent.of[y] for x, y in every)


def test_no_link_between_two_groups_is_lost(spark):
    """Runs of texts that differ by a few words each: neighbours are linked, those further apart only look alike."""
    rng, rows = random.Random(8), []
    for family in range(60):
        words = ["f%dw%d" % (family, i) for i in range(400)]
        at = 0
        for _ in range(12):
            rows.append((rng.randrange(10**9), " ".join(words[at : at + 100])))
            at += rng.choice([3, 8, 10, 11, 11])
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_near(rows, 2)


def test_of_equal_ids_the_same_row_stays(spark):
    rows = [(1, "the first text of this id"), (1, "the second text of this id"), (1, None), (2, "else"), (2, "else")]
    df = frame(spark, rows)
    got = [tuple(r) for r in minhash.keep_one_of_each(df).collect()]
    again = [tuple(r) for r in minhash.keep_one_of_each(df.orderBy(F.desc("text")).repartition(3)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again)) and sorted(r[0] for r in got) == [1, 2]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 240)]
    got = {r.a: r.b for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert got == {x: top(x) for x in parent if top(x) != x}


def test_signatures_estimate_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    m = minhash.signature_matrix([common.mix(a), common.mix(b), a[:0]], 256)
    assert abs((m[0] == m[1]).mean() - 900 / 1100) < 0.08 and (m[2] == -1).all()


def test_digest_of_an_empty_text_is_that_of_no_bytes(spark):
    got = suffixes.remove_repeated_bytes(frame(spark, [(1, None)])).select(F.sha2("kept", 256).alias("h")).first()
    assert got.h == hashlib.sha256(b"").hexdigest()

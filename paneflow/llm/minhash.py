"""MinHash near-duplicates by an inverted join of signature coordinates (operator 7)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, filter_bits, filter_place, groups_of, mix, passes, portions, table, tidy, word_hashes

SHINGLE = 2
#: Similarity of linked sets, as a fraction of whole numbers.
ALIKE = (80, 100)
#: Coordinates of a signature, and how many two signatures share at least: of pairs with similarity 0.8 six in a thousand
#: million shares less, and ever fewer of more similar ones.
COORDINATES = 56
MATCHES = 26
#: Nodes of a block where all are compared.
BLOCK = 512
#: Rows of posts that are merged in one task, about.
MERGED_ROWS = 1 << 14
#: Pairs whose signatures are compared at once.
PAIRS = 1 << 17
_LOWER = bytes(range(256)).replace(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FACTORS = np.random.default_rng(77).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes: runs of `words` words, or all words if there are fewer."""
    hashes = word_hashes((text or "").encode().translate(_LOWER))[2]
    n = min(words, len(hashes))
    if n == 0:
        return hashes
    out = hashes[: len(hashes) - n + 1]
    for i in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i])
    return np.unique(mix(out ^ np.uint64(n)))


def signature_matrix(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """For each set the least of each of `coordinates` hashes of its elements; -1 for an empty set."""
    out = np.full((len(sets), coordinates), -1, np.int32)
    some = [i for i, x in enumerate(sets) if len(x)]
    for a, b in groups_of([len(sets[i]) for i in some], 1 << 16):
        part = some[a:b]
        flat = np.concatenate([sets[i] for i in part])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in part])[:-1]))
        for k in range(coordinates):
            h = (flat * _FACTORS[0, k] + _FACTORS[1, k]) >> np.uint64(32)
            out[part, k] = np.minimum.reduceat(h, starts).astype(np.uint32).view(np.int32)
    return out


def _identity(found: np.ndarray) -> int:
    """64 bits of a cryptographic hash of a set."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sign(words: int, coordinates: int):
    def run(batches):
        for whole in portions(batches, 1 << 20):
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles(x, words) for x in batch.column("text").to_pylist()]
                matrix = signature_matrix(sets, coordinates)
                signature = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * coordinates, pa.int32()), pa.array(matrix.ravel(), pa.int32()))
                columns = [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(map(_identity, sets), pa.int64()), signature]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "signature"])

    return run


def _least_linkable(alike: tuple[int, int]) -> int:
    """Smallest size of a set that can be linked to a different one."""
    return next(n for n in range(1, 10_000) if alike[1] * n >= alike[0] * (n + 1))


def _squeeze(bits: np.ndarray):
    """Compressed texts of the rows that pass the filter."""

    def run(batches):
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(passes(bits, at)))
            packer = zstandard.ZstdCompressor(level=3)
            texts = [packer.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "packed"])

    return run


def _texts(d: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, packed) of the nodes in wanted (node, doc_id); what the others have isn't shuffled, but for a few of them."""
    rows = d.filter("doc_id IS NOT NULL").select("doc_id", "text", filter_place(F.col("doc_id")).alias("at"))
    packed = rows.mapInArrow(tidy(_squeeze(filter_bits(wanted, "doc_id"))), "doc_id long, packed binary")
    return packed.join(wanted, "doc_id").select("node", "packed")


def _alike_signatures(matches: int):
    """Pairs whose signatures agree in at least `matches` coordinates."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(1) >= matches))

    return run


def _confirm(words: int, alike: tuple[int, int]):
    """Pairs of nodes whose full sets are alike; texts whose set isn't the node's (another row with its doc_id) link nothing."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        known: dict[int, np.ndarray] = {}

        def of(node, packed):
            if node not in known:
                if len(known) > 256:
                    known.clear()
                known[node] = shingles(unpack.decompress(packed).decode(), words)
            return known[node]

        for batch in batches:
            out = ([], [])
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "packed_a", "packed_b"))):
                x, y = shingles(unpack.decompress(x).decode(), words), of(b, y)
                if _identity(x) != a or _identity(y) != b:
                    known.pop(b, None)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if alike[1] * both >= alike[0] * (len(x) + len(y) - both):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(a, b) with b the least node that a is connected to, for each other node of edges (a, b).

    Rounds of large stars and small stars: each node hands its least neighbour to its greater ones, and then to its smaller
    ones, until nothing changes. Every round is cut by a checkpoint; nothing is collected but a count and a checksum.
    """
    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(found) == mark or found[0] == 0:
            return now
        mark = tuple(found)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = cut(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct())


def _size_class(alike: tuple[int, int]):
    """The class of a set's size: sets whose classes lie apart by more than 1 aren't alike. Very large sets are one class."""
    step = float(np.log(alike[1] / alike[0]))
    return F.least(F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(step)), F.lit(62)).cast("int")


def _posts(nodes: DataFrame, matches: int, alike: tuple[int, int]) -> DataFrame:
    """(node, class, post, weight): coordinate values under which nodes are posted, and how many postings a node's values have.

    Values that no other node near in size has can't collide; the classes of a value's nodes are bits of one number. A node
    with fewer others than `matches` has no partner. Of the rest, two nodes that share `matches` values share one among the
    rarest of either, all but matches - 1: the prefix.
    """
    values = F.transform(F.col("signature"), lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    posts = nodes.select("node", _size_class(alike).alias("class"), F.explode(values).alias("post"))
    counts = posts.groupBy("post").agg(F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1L, class)")).alias("classes")).filter("n > 1")
    near = F.expr("n > bit_count(classes) OR (classes & (shiftleft(1L, class + 1) | shiftleft(1L, class - 1))) <> 0")
    lists = posts.join(counts, "post").filter(near).groupBy("node", "class").agg(F.sort_array(F.collect_list(F.struct("n", "post"))).alias("posts"))
    lists = lists.filter(F.size("posts") >= matches)
    weight = F.aggregate("posts", F.lit(0).cast("long"), lambda total, x: total + x["n"]).alias("weight")
    prefix = F.explode(F.slice("posts", F.lit(1), F.size("posts") - (matches - 1))).alias("p")
    return lists.select("node", "class", weight, prefix).select("node", "class", "p.post", "weight")


def _links_between(words: int, alike: tuple[int, int]):
    """Of one block of nodes that ask and one of nodes that are asked: links that join their roots, by their full sets.

    Each asking set is compared with all asked ones at once, by counting its elements among theirs.
    """

    def run(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        node, root, asks = (t.column(c).to_pylist() for c in ("node", "root", "asks"))
        sets = [shingles(unpack.decompress(x).decode(), words) for x in t.column("packed").to_pylist()]
        right = [_identity(x) == n for x, n in zip(sets, node)]
        asking = [i for i, a in enumerate(asks) if a and right[i]]
        asked = [i for i, a in enumerate(asks) if not a and right[i]]
        parent: dict[int, int] = {}

        def top(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = ([], [])
        if asking and asked:
            sizes = np.array([len(sets[i]) for i in asked])
            flat = np.concatenate([sets[i] for i in asked])
            starts = np.cumsum(sizes) - sizes
            known, place = np.unique(flat, return_inverse=True)
            mark = np.zeros(len(known) + 1, np.int32)
            for i in asking:
                at = np.searchsorted(known, sets[i])
                at = at[known[np.minimum(at, len(known) - 1)] == sets[i]]
                mark[at] = 1
                shared = np.add.reduceat(mark[place], starts)
                mark[at] = 0
                for j in np.flatnonzero(alike[1] * shared >= alike[0] * (len(sets[i]) + sizes - shared)).tolist():
                    x, y = top(root[i]), top(root[asked[j]])
                    if x != y:
                        parent[x] = y
                        out[0].append(node[i])
                        out[1].append(node[asked[j]])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


class Roots:
    """Which numbers are connected, by the least of them."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins pairs; says which were needed."""
        needed = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = sorted((self._top(x), self._top(y)))
            if x != y:
                self.of[y] = x
                needed[i] = True
        while (up := self.of[self.of] != self.of).any():
            self.of[up] = self.of[self.of[up]]
        return needed

    def _top(self, x: int) -> int:
        while (y := int(self.of[x])) != x:
            x = y
        return x


def merge_lists(values: np.ndarray, group: np.ndarray, own: np.ndarray, root: np.ndarray, node: np.ndarray, allowed, matches: int):
    """Of the rows of some posts: pairs of a post's rows with different roots that agree in `matches` coordinates, as many as
    connect the same nodes as all such pairs do. Connecting the same roots wouldn't do: a pair that isn't a link in the end
    would stand for others of its roots that are.

    values: signatures. group: the post, whose coordinate is `own`; root and node: numbers from 0. allowed(rows, rows) says
    which pairs count. In each post every other coordinate's values make lists. Pairs that agree in `matches` coordinates
    meet in a list of any all - matches + 1 of them: the coordinates whose lists have the fewest pairs (the prefix) are merged, the
    others' long lists are skipped. What is connected already is skipped too, and a pair is given up when it can't reach
    `matches` any more.
    """
    coordinates, group = values.shape[1], group.astype(np.int64)
    joined = Roots(int(node.max()) + 1)

    def ordered(rows: np.ndarray, of: np.ndarray, label: np.ndarray):
        """Rows by list and label, and of each the rows further on in its list that have another label, from start to end; where lists begin."""
        key = of * (int(label.max()) + 1) + label
        order = np.argsort(key)
        rows, of, key = rows[order], of[order], key[order]
        new, other = np.ones((2, len(rows)), bool)
        new[1:], other[1:] = of[1:] != of[:-1], key[1:] != key[:-1]
        start, end = (np.append(np.flatnonzero(x)[1:], len(rows))[np.cumsum(x) - 1] for x in (other, new))
        return rows, start, end, new

    def lists(k: int, fresh: bool = False):
        """Rows, starts and ends of a coordinate's lists, each by root or by what is connected, whichever leaves fewer pairs; fresh: nothing is."""
        rows = np.flatnonzero(own != k)
        if not len(rows):
            return rows, rows, rows
        of = group[rows] << 16 | values[rows, k]
        by_root, start, end, new = ordered(rows, of, root[rows])
        if fresh:
            return by_root, start, end
        by_joined, after, _, _ = ordered(rows, of, joined.of[node[rows]])
        fewer = np.add.reduceat(after - start, np.flatnonzero(new)) > 0
        fewer = fewer[np.cumsum(new) - 1]
        return np.where(fewer, by_joined, by_root), np.where(fewer, after, start), end

    pairs = np.array([int((end - start).sum()) for _, start, end in (lists(k, True) for k in range(coordinates))])
    tested = np.zeros(0, np.int64)
    nodes = int(node.max()) + 1
    found = [], []
    for k in np.argsort(pairs, kind="stable")[: coordinates - matches + 2].tolist():
        rows, start, end = lists(k)
        for a, b in groups_of((end - start).tolist(), PAIRS):
            n = end[a:b] - start[a:b]
            i = np.repeat(rows[a:b], n)
            j = rows[np.arange(len(i)) + np.repeat(start[a:b] - np.cumsum(n) + n, n)]
            good = (root[i] != root[j]) & (joined.of[node[i]] != joined.of[node[j]]) & allowed(i, j)
            i, j = i[good], j[good]
            key, first = np.unique(np.minimum(node[i], node[j]) * nodes + np.maximum(node[i], node[j]), return_index=True)
            new = ~np.isin(key, tested, assume_unique=True)
            i, j = i[first[new]], j[first[new]]
            tested = np.union1d(tested, key[new])
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                half = coordinates - matches // 2
                some = (values[x, :half] == values[y, :half]).sum(1)
                may = some + coordinates - half >= matches
                x, y, some = x[may], y[may], some[may]
                alike = some + (values[x, half:] == values[y, half:]).sum(1) >= matches
                x, y = x[alike], y[alike]
                needed = joined.join(node[x], node[y])
                found[0].append(node[x[needed]])
                found[1].append(node[y[needed]])
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in found)


def _collisions(matches: int, alike: tuple[int, int]):
    """Of the rows of some posts: links between nodes that collide, are of sizes that allow a link and have different roots."""

    def run(t: pa.Table) -> pa.Table:
        post, size_class, i, j, side, node, root, size = (t.column(c).to_numpy() for c in ("post", "class", "i", "j", "side", "node", "root", "n_shingles"))
        home = t.column("home").to_numpy(zero_copy_only=False)
        values = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint16).reshape(t.num_rows, -1)
        _, group = np.unique(np.stack([post, size_class, i, j], 1), axis=0, return_inverse=True)
        nodes, number = np.unique(node, return_inverse=True)

        def allowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            return ((i[x] == j[x]) | (side[x] != side[y])) & (home[x] | home[y]) & (alike[1] * low >= alike[0] * high)

        a, b = merge_lists(values, group.reshape(-1), post >> 32, np.unique(root, return_inverse=True)[1], number, allowed, matches)
        a, b = nodes[np.minimum(a, b)], nodes[np.maximum(a, b)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _families(placed: DataFrame, nodes: DataFrame, matches: int, alike: tuple[int, int], block: int) -> DataFrame:
    """(a, b): links of nodes that could be alike and have different roots; their components hold every such pair.

    A post is split by size, as sets of which one is much larger aren't alike: a node stands in its size class and the next.
    Posts of more than four times `block` nodes are dealt in pairs of blocks of that size, which hold no texts. Posts of one
    family mostly have one greatest root, so they come to one task, which connects them once; where they have very many rows,
    to several. The number of tasks follows the number of posts.
    """
    sized = placed.withColumnRenamed("class", "own").withColumn("class", F.explode(F.array("own", F.col("own") + 1)))
    sized = sized.select("post", "class", "node", "root", (F.col("own") == F.col("class")).alias("home"))
    groups = sized.groupBy("post", "class").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.max("home").alias("homes"))
    groups = cut(groups.filter("low < high AND homes").select("post", "class", "high", "n"))  # two nodes that are both guests meet in their own class
    rows = groups.agg(F.sum("n")).first()[0] or 0
    tasks = max(64, rows // MERGED_ROWS)
    slices = groups.groupBy("high").agg(F.ceil(F.sum("n") / MERGED_ROWS).alias("slices")).filter("slices > 1")  # MERGED_ROWS rows each: few
    groups = groups.join(slices, "high", "left").withColumn("slice", F.pmod(F.xxhash64("post"), F.coalesce("slices", F.lit(1))))
    groups = groups.select("post", "class", "high", "slice", F.ceil(F.col("n") / (4 * block)).cast("int").alias("blocks"))
    rows = sized.join(groups, ["post", "class"]).withColumn("side", F.pmod(F.xxhash64(F.col("node"), F.lit(2)), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("post", "class", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "home", "high", "slice", "node", "root")
    rows = rows.join(nodes.select("node", "n_shingles", "bits"), "node")
    rows = rows.withColumn("task", F.pmod(F.xxhash64("high", "slice", "i", "j"), F.lit(tasks)).cast("int")).drop("high", "slice")
    return rows.groupBy("task").applyInArrow(tidy(_collisions(matches, alike)), "a long, b long").distinct()


def _missing_links(posts: DataFrame, links: DataFrame, nodes: DataFrame, d: DataFrame, words: int, alike: tuple[int, int], matches: int, block: int) -> DataFrame:
    """Links between nodes of different roots that share a post and collide at `matches` coordinates.

    Nodes that do so are joined to families. In a family all nodes outside its largest root are compared with all nodes, in
    blocks: tasks are as large as two blocks, and give only links that join roots.
    """
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = posts.select("node", "class", "post").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    family = components(_families(placed, nodes, matches, alike, block))
    members = family.select(F.col("a").alias("node"), F.col("b").alias("family")).unionByName(family.select(F.col("b").alias("node"), F.col("b").alias("family")).distinct())
    members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = members.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("family").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main"))
    sizes = sizes.select("family", "main", F.ceil(F.col("all") / block).cast("int").alias("asked_blocks"), F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("asking_blocks"))
    members = members.join(sizes, "family").join(nodes.select("node", "doc_id"), "node")
    members = members.join(_texts(d, members.select("node", "doc_id")), "node")
    own = F.xxhash64(F.col("node"), F.lit(1))
    asked = members.withColumn("asks", F.lit(False)).withColumn("j", F.pmod(own, "asked_blocks")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("asking_blocks") - 1)))
    asking = members.filter("root <> main").withColumn("asks", F.lit(True)).withColumn("i", F.pmod(own, "asking_blocks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("asked_blocks") - 1)))
    columns = ["family", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "node", "root", "asks", "packed"]
    both = asked.select(*columns).unionByName(asking.select(*columns))
    return both.groupBy("family", "i", "j").applyInArrow(tidy(_links_between(words, alike)), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, alike: tuple[int, int] = ALIKE, coordinates: int = COORDINATES, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text); other columns aren't read.

    A text's set holds its shingles of `words` words in lower case (A-Z only); two documents are linked if the sizes of
    intersection and union are at least as alike[0] to alike[1]. component_id is the least doc_id that links lead to, and
    kept says that it is the row's own. Texts that are null or have no words have an empty set and no link. A row with
    a null doc_id takes no part: its component_id is null and it is kept. Rows that repeat a doc_id are linked by it.

    Documents with one set are one node from the start. Nodes are posted under their coordinates' values; each is first
    confirmed against a centre, the most widely posted node of those it shares most posts with, which joins groups of copies
    without their pairs. Nodes under a common post that these links left apart are then all compared, so no link is lost.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(d.mapInArrow(tidy(_sign(words, coordinates)), "doc_id long, n_shingles long, node long, signature array<int>"))
    known = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = known.filter(F.col("n_shingles") >= _least_linkable(alike)).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    posts = cut(_posts(nodes, matches, alike))
    bits = F.transform("signature", lambda v: F.lpad(F.hex(v.bitwiseAND(0xFFFF)), 4, "0"))
    nodes = nodes.join(posts.select("node").distinct(), "node")
    nodes = cut(nodes.select("node", "doc_id", "n_shingles", F.unhex(F.array_join(bits, "")).alias("bits")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = (nodes.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}")) for c in "ab")
        pairs = cut(pairs.join(x, "a").join(y, "b").mapInArrow(tidy(_alike_signatures(matches)), "a long, b long"))
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = _texts(d, nodes.join(asked, "node").select("node", "doc_id"))
        x, y = (texts.select(F.col("node").alias(c), F.col("packed").alias(f"packed_{c}")) for c in "ab")
        return pairs.join(x, "a").join(y, "b").mapInArrow(tidy(_confirm(words, alike)), "a long, b long")

    centres = posts.groupBy("post").agg(F.max_by(F.struct("node", "class"), F.struct("weight", "node")).alias("centre"), F.max("weight").alias("of"))
    shared = posts.join(centres, "post").filter("node != centre.node AND abs(class - centre.class) <= 1")
    shared = shared.groupBy("node", F.col("centre.node").alias("centre")).agg(F.count(F.lit(1)).alias("n"), F.first("of").alias("of"))
    stars = shared.groupBy(F.col("node").alias("a")).agg(F.max_by("centre", F.struct("n", "of", "centre")).alias("b"))
    links = components(confirmed(stars))
    more = cut(_missing_links(posts, links, nodes, d, words, alike, matches, block))
    if not more.isEmpty():
        links = components(links.unionByName(more))

    least = known.groupBy("node").agg(F.min("doc_id").alias("least"))
    least = least.join(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = least.groupBy("root").agg(F.min("least").alias("component"))
    least = least.join(roots, "root").select("node", "component")
    out = rows.select("doc_id", "n_shingles", "node").join(least, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, words: int = 5, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """The rows of docs, with their columns, without those whose near-duplicate with a smaller doc_id stays.

    Of rows that repeat a doc_id that stays, which are linked by it, the one with the least hash of its text stays, and of equal
    texts the one with the least hash of all columns, so reruns agree. Rows without doc_id stay. A null or empty text is
    linked with nothing and stays. An empty table gives an empty table.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    gone = near_duplicates(docs, words, alike).filter("NOT kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(every)
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    least = F.min_by(F.struct(*every), F.struct(F.sha2("text", 256), F.xxhash64(*every))).alias("row")
    once = kept.join(repeated, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("of")).agg(least).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(every).unionByName(once)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), reach AS (
  SELECT a AS doc_id, a AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
), c AS (
  SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.doc_id
"""

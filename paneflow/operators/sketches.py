"""Sketches whose state doesn't depend on the order of the packets, as aggregations.

A sketch is a DataFrame in long form: a row for each counter or set bit that is in use, with the columns `by` (pane or window)
first. Inserting is a groupBy with partial sums, merging is the same groupBy over panes, and a query is a join by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import fold, position, position_sql, trailing_ones_sql, trailing_zeros_sql

# ---- Count-Min


def _positions(df: DataFrame, keys: list[str], depth: int, width: int) -> DataFrame:
    """df once for each row of a sketch, with row and pos."""
    places = F.array(*(F.struct(F.lit(i).alias("row"), position("folded", i, width).alias("pos")) for i in range(depth)))
    return df.withColumn("folded", fold(*keys)).withColumn("place", F.explode(places)).select("*", "place.row", "place.pos").drop("place", "folded")


def count_min(df: DataFrame, keys: list[str], value: str, depth: int = 4, width: int = 1021, by: list[str] | None = None) -> DataFrame:
    """Counters (by, row, pos, val); keys are summed before they are hashed."""
    by = by or []
    sums = df.groupBy(*by, *keys).agg(F.sum(value).alias("val"))
    return _positions(sums, keys, depth, width).groupBy(*by, "row", "pos").agg(F.sum("val").alias("val"))


def count_min_query(sketch: DataFrame, keys_df: DataFrame, keys: list[str], depth: int = 4, width: int = 1021, by: list[str] | None = None) -> DataFrame:
    """est of each of keys_df (by, keys): the least of its counters, 0 if one isn't there."""
    by = by or []
    asked = _positions(keys_df.select(*by, *keys), keys, depth, width)
    found = asked.join(sketch, [*by, "row", "pos"], "left")
    return found.groupBy(*by, *keys).agg(F.min(F.coalesce("val", F.lit(0))).alias("est"))


def merge_counters(sketch: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of the counters of several panes."""
    return sketch.groupBy(*(by or []), "row", "pos").agg(F.sum("val").alias("val"))


def first_keys(df: DataFrame, keys: list[str], depth: int, width: int, by: list[str]) -> DataFrame:
    """Keys that a switch would record: those that met a counter at 0, as the first packet of a position in any row."""
    order = W.partitionBy(*by, "row", "pos").orderBy("us", "seq")
    first = df.groupBy(*by, *keys).agg(F.min(F.struct("us", "seq")).alias("at")).select(*by, *keys, "at.us", "at.seq")
    return _positions(first, keys, depth, width).withColumn("n", F.row_number().over(order)).filter("n = 1").select(*by, *keys).distinct()


def data_plane_reduce(df: DataFrame, keys: list[str], value: str, depth: int, width: int, by: list[str]) -> DataFrame:
    """Count-Min with a key list: recorded keys with their estimates (by, keys, est); keys that collided in all rows are lost."""
    recorded = first_keys(df, keys, depth, width, by)
    return count_min_query(count_min(df, keys, value, depth, width, by), recorded, keys, depth, width, by)


# ---- Bloom filter


def bloom_first(df: DataFrame, element: list[str], hashes: int, bits: int, by: list[str]) -> DataFrame:
    """The packets of df (with us, seq) that a Bloom filter of `hashes` rows of bits / hashes bits calls new.

    A packet is new if one of its bits isn't set yet: if it is the first packet at that position. So only the first
    packet of each element can be, and of these the first at a position of any row.
    """
    at = F.min(F.struct("us", "seq"))
    first = df.groupBy(*by, *element).agg(at.alias("at"))
    placed = _positions(first.select(*by, *element, "at"), element, hashes, bits // hashes)
    heads = placed.groupBy(*by, "row", "pos").agg(F.min("at").alias("at")).select(*by, "at").distinct()
    return df.join(heads.select(*by, "at.us", "at.seq"), [*by, "us", "seq"], "left_semi")


# ---- cardinalities


def linear_bits(df: DataFrame, element: list[str], width: int, by: list[str]) -> DataFrame:
    """Set bits (by, pos) of linear counting; a union of bitmaps is distinct()."""
    return df.select(*by, fold(*element).alias("folded")).select(*by, position("folded", 0, width).alias("pos")).distinct()


def linear_estimate(bits: DataFrame, width: int, by: list[str]) -> DataFrame:
    """-w ln(z / w) of the zeros z, as a whole number; null when no bit is left."""
    zeros = F.nullif(F.lit(width) - F.count(F.lit(1)), F.lit(0)).cast("double")
    return bits.groupBy(*by).agg(F.floor(-width * F.log(zeros / width)).cast("long").alias("est"))


def registers(df: DataFrame, element: list[str], width: int, by: list[str]) -> DataFrame:
    """Registers (by, pos, rank) of HyperLogLog: the most trailing zeros, plus 1, of a second hash; a merge takes the maximum."""
    hashed = df.select(*by, fold(*element).alias("folded")).distinct().select(*by, position("folded", 0, width).alias("pos"), position("folded", 1, 2**31 - 1).alias("x"))
    return hashed.groupBy(*by, "pos").agg(F.max(F.expr(f"{trailing_zeros_sql('x')} + 1")).alias("rank"))


def alpha(width: int) -> float:
    return 0.7213 / (1 + 1.079 / width)


def hyperloglog_estimate(regs: DataFrame, width: int, by: list[str]) -> DataFrame:
    """The estimate with corrections for small and large counts, as a whole number."""
    sums = regs.groupBy(*by).agg(F.count(F.lit(1)).alias("used"), F.sum(F.pow(F.lit(0.5), "rank")).alias("power"))
    return sums.select(*by, F.expr(hyperloglog_sql(width)).alias("est"))


def hyperloglog_sql(width: int) -> str:
    """SQL of the estimate, of `used` registers whose powers of one half add up to `power`."""
    w, top = f"{float(width)}E0", "4294967296.0E0"
    raw = f"({alpha(width)!r}E0 * {w} * {w} / (power + {width} - used))"
    small = f"{w} * ln({w} / ({width} - used))"
    return (
        f"CAST(floor(CASE WHEN {raw} < {2.5 * width}E0 THEN CASE WHEN used = {width} THEN {raw} ELSE {small} END "
        f"WHEN {raw} <= {top} / 30 THEN {raw} ELSE -{top} * ln(1 - {raw} / {top}) END) AS BIGINT)"
    )


# ---- multi-resolution bitmap


class MultiResolution:
    """c levels; bits of the levels below the last, and of the last; share of set bits up to which a level is used."""

    def __init__(self, levels: int = 3, bits: int = 104, last: int = 208, share: float = 0.9311):
        self.levels, self.bits, self.last = levels, bits, last
        self.most = int(bits * share + 0.5)

    def level_sql(self, x: str) -> str:
        return f"least({trailing_ones_sql(x)}, {self.levels - 1})"

    def bit_sql(self, x: str, level: str) -> str:
        return f"CASE WHEN {level} = {self.levels - 1} THEN {x} % {self.last} ELSE {x} % {self.bits} END"

    def estimate_sql(self, used: list[str]) -> str:
        """SQL of the estimate for the number of set bits of each level."""
        n = self.levels - 1
        part = [f"{float(self.bits)} * (ln({float(self.bits)}) - ln(greatest({self.bits} - {used[i]}, 1)))" for i in range(n)]
        end = f"{float(self.last)} * (ln({float(self.last)}) - ln(greatest({self.last} - {used[n]}, 1)))"
        cases = []
        for base in range(n):  # the first level with few enough bits, and the last after it with too many
            for over in range(n - 1, base, -1):
                rest = " + ".join([*part[over + 1 :], end])
                cases.append(f"WHEN {used[base]} <= {self.most} AND {used[over]} > {self.most} THEN {2 ** (over + 1)} * ({rest})")
            cases.append(f"WHEN {used[base]} <= {self.most} THEN {2**base} * ({' + '.join([*part[base:], end])})")
        return f"CAST(floor(CASE {' '.join(cases)} ELSE {2**n} * ({end}) END + 0.5) AS BIGINT)"


def resolution_bits(df: DataFrame, element: list[str], shape: MultiResolution, by: list[str]) -> DataFrame:
    """Set bits (by, level, bit)."""
    x = df.select(*by, fold(*element).alias("folded")).select(*by, position("folded", 2, 2**31 - 1).alias("x"))
    x = x.withColumn("level", F.expr(shape.level_sql("x")))
    return x.select(*by, F.col("level").cast("int").alias("level"), F.expr(shape.bit_sql("x", "level")).alias("bit")).distinct()


def resolution_estimate(bits: DataFrame, shape: MultiResolution, by: list[str]) -> DataFrame:
    used = [F.sum(F.when(F.col("level") == i, 1).otherwise(0)).alias(f"s{i}") for i in range(shape.levels)]
    sums = bits.groupBy(*by).agg(*used)
    return sums.select(*by, F.expr(shape.estimate_sql([f"s{i}" for i in range(shape.levels)])).alias("est"))


# ---- superspreaders


def spread_places(df: DataFrame, source: str, dst: str, depth: int, width: int, shape: MultiResolution, by: list[str]) -> DataFrame:
    """What packets set (by, source, level, bit, at, row, pos); at: when this last happened."""
    x = df.select(*by, source, dst, "us", "seq", fold(source, dst).alias("pair")).withColumn("x", position("pair", 2, 2**31 - 1))
    x = x.withColumn("level", F.expr(shape.level_sql("x")).cast("int")).withColumn("bit", F.expr(shape.bit_sql("x", "level")))
    latest = x.groupBy(*by, source, "level", "bit").agg(F.max(F.struct("us", "seq")).alias("at"))
    return _positions(latest, [source], depth, width)


def spread_cells(placed: DataFrame, source: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Bits (by, row, pos, level, bit), and the candidate of each bucket: the source with the highest level, the latest of these."""
    bits = placed.select(*by, "row", "pos", "level", "bit").distinct()
    candidates = placed.groupBy(*by, "row", "pos").agg(F.max_by(source, F.struct("level", "at")).alias(source))
    return bits, candidates


def spread_sketch(df: DataFrame, source: str, dst: str, depth: int, width: int, shape: MultiResolution, by: list[str]) -> tuple[DataFrame, DataFrame]:
    return spread_cells(spread_places(df, source, dst, depth, width, shape, by), source, by)


def spread_query(bits: DataFrame, candidates: DataFrame, source: str, depth: int, width: int, shape: MultiResolution, by: list[str], threshold: int = 0) -> DataFrame:
    """est of each candidate above the threshold: the least estimate of its buckets."""
    buckets = resolution_estimate(bits, shape, [*by, "row", "pos"]).withColumnRenamed("est", "one")
    asked = _positions(candidates.select(*by, source).distinct(), [source], depth, width)
    found = asked.join(buckets, [*by, "row", "pos"]).groupBy(*by, source).agg(F.min("one").alias("est"))
    return found.filter(F.col("est") > threshold)


def slice_rows(key: str, rows: int) -> list[str]:
    """SQL of the five rows of a key in a vector Bloom filter: four overlapping 12-bit slices of the address, and a hash."""
    folded = f"(({key}) % {2**31 - 1})"
    slices = [f"(({key} << {8 * i}) & 4294967295) >> 20" for i in range(3)]
    slices.append(f"(({key} & 255) << 4) | ({key} >> 28)")
    return [f"({s}) % {rows}" for s in slices] + [position_sql(folded, 3, rows)]


def _words(width: int) -> list[str]:
    """Columns with the bits of a row of a vector Bloom filter, 64 in each."""
    return [f"b{i}" for i in range(-(-width // 64))]


def vector_bits(df: DataFrame, source: str, dst: str, rows: int, width: int, by: list[str]) -> DataFrame:
    """Rows in use (by, array, row, b0, b1, ...) of a vector Bloom filter, each with its set bits in words of 64."""
    places = F.array(*(F.struct(F.lit(i).alias("array"), F.expr(e).alias("row")) for i, e in enumerate(slice_rows(source, rows))))
    pairs = df.select(*by, source, fold(source, dst).alias("pair")).withColumn("col", position("pair", 4, width)).withColumn("p", F.explode(places))
    words = [F.expr(f"bit_or(CASE WHEN col div 64 = {i} THEN shiftleft(1L, CAST(col % 64 AS INT)) ELSE 0L END)").alias(w) for i, w in enumerate(_words(width))]
    return pairs.select(*by, "p.array", "p.row", "col").groupBy(*by, "array", "row").agg(*words)


def merge_vectors(bits: DataFrame, width: int, by: list[str]) -> DataFrame:
    """The union of the rows of several vector Bloom filters."""
    return bits.groupBy(*by, "array", "row").agg(*(F.bit_or(w).alias(w) for w in _words(width)))


def vector_query(bits: DataFrame, sources: DataFrame, source: str, rows: int, width: int, by: list[str], threshold: int = 10) -> DataFrame:
    """est of the sources whose five rows have so many bits in common that their number exceeds the threshold.

    The bits that strangers leave in common, delta, are estimated from the hashed array. All words of a filter are one array,
    whose size is fixed; a source is one row, which looks its words up there.
    """
    words, n = _words(width), len(_words(width))
    ones = " + ".join(f"bit_count({w})" for w in words)
    cells = bits.select(*by, "array", (F.col("array") * rows + F.col("row")).alias("at"), F.array(*words).alias("words"), F.expr(f"CASE WHEN array = 4 THEN {ones} ELSE 0 END").alias("ones"))
    filters = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("cells"), F.sum("ones").alias("ones"))
    v = (F.lit(width * rows) - F.col("ones")).cast("double") / (width * rows)
    gap = f"array_repeat(0L, CAST((x.at - coalesce(get(cells, i - 1).at + 1, 0)) * {n} AS INT))"
    filters = filters.select(*by, F.expr(f"flatten(transform(cells, (x, i) -> concat({gap}, x.words)))").alias("words"), (-width * F.log(v * (2 - v))).alias("delta"))
    places = [F.expr(f"CAST(({i * rows} + {e}) * {n} AS INT)").alias(f"p{i}") for i, e in enumerate(slice_rows(source, rows))]
    asked = sources.select(*by, source).distinct()
    joined = asked.join(filters.hint("shuffle_hash"), by) if by else asked.crossJoin(F.broadcast(filters))  # filters is one row
    common = [" & ".join(f"get(words, p{i} + {w})" for i in range(len(places))) for w in range(n)]
    used = F.expr(" + ".join(f"coalesce(bit_count({c}), 0)" for c in common)).alias("used")
    found = joined.select(*by, source, "delta", "words", *places).select(*by, source, "delta", used).filter("used > 0")
    zeros = F.lit(width) - F.col("used")
    limit = F.floor(width * F.exp(-(threshold + F.col("delta")) / width))
    est = F.floor(width * F.log(F.lit(float(width)) / F.greatest(zeros, F.lit(1))) - F.col("delta")).cast("long")
    return found.filter(zeros < limit).select(*by, source, est.alias("est"))


# ---- loss digest


def digest(df: DataFrame, ident: str, cells: int, hashes: int) -> DataFrame:
    """Cells (row, pos, count, ids) of an invertible digest of packets by a whole number below 2**31; rows have cells / hashes cells each."""
    rows = df.select(ident)
    return _positions(rows, [ident], hashes, cells // hashes).groupBy("row", "pos").agg(F.count(F.lit(1)).alias("count"), F.bit_xor(ident).alias("ids"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """The digest of what a has and b lacks (b is part of a); empty cells are left out."""
    both = a.select("row", "pos", "count", "ids").unionByName(b.select("row", "pos", (-F.col("count")).alias("count"), "ids"))
    return both.groupBy("row", "pos").agg(F.sum("count").alias("count"), F.bit_xor("ids").alias("ids")).filter("count <> 0 OR ids <> 0")


def peel(cells: DataFrame, ident: str, size: int, hashes: int) -> tuple[DataFrame, DataFrame]:
    """The packets of a digest, and the cells that are left when no cell holds one packet any more.

    Every round takes all cells with one packet at once; the digest has a fixed size, and rounds are few.
    """
    from .lineage import cut

    found = None
    cells = cut(cells)
    while True:
        pure = cells.filter("count = 1").select(F.col("ids").alias(ident)).distinct()
        pure = pure.filter(F.col(ident) >= 0)
        taken = cut(pure if found is None else pure.join(found, ident, "left_anti"))
        if taken.isEmpty():
            return (found if found is not None else taken), cells
        found = taken if found is None else cut(found.unionByName(taken))
        cells = cut(subtract(cells, digest(taken, ident, size, hashes)))


def lost_ids(sent: DataFrame, received: DataFrame, ident: str, size: int, hashes: int) -> DataFrame:
    """All packets of sent that received, a part of it, lacks: decoded from digests of both, of at least `size` cells.

    What is lost is counted first, and the digest has half as many cells again. Should cells be left over all the same, as
    when ids repeat, the rows are compared themselves.
    """
    lost = sent.count() - received.count()
    size = max(size, -(-lost * 3 // (2 * hashes)) * hashes)
    found, left = peel(subtract(digest(sent, ident, size, hashes), digest(received, ident, size, hashes)), ident, size, hashes)
    if left.isEmpty():
        return found
    return sent.select(ident).join(received.select(ident), ident, "left_anti")


# ---- sliding sketches


def rotate(cells: DataFrame, turn: str, panes: int) -> DataFrame:
    """cells, with `pane`, once for each window `win` in which a sliding sketch with a new and an old copy of each cell holds them.

    With each pane a share of 1 / panes of the cells is aged in turn: the old copy takes the new one's value, and the new one
    starts empty. A query takes both together, so it covers between one and two windows; a cell is aged at the end of pane p
    where p % panes is `turn`, an SQL expression. Where cells have `closed`, the number of closed panes, windows end with the
    last of them.
    """
    last = F.col("pane") + (2 * panes - 1)
    last = F.least(last, F.col("closed") - 1) if "closed" in cells.columns else last
    spread = cells.withColumn("turn", F.expr(turn)).withColumn("win", F.explode(F.sequence(F.col("pane"), last)))
    # last ageing at or before the end of window w: l = w - (w - turn) mod panes; panes from l - panes + 1 to w still count
    start = F.col("win") - F.pmod(F.col("win") - F.col("turn"), F.lit(panes)) - (panes - 1)
    return spread.filter(F.col("pane") >= start).drop("turn", "pane", "closed")


def rotating_counters(df: DataFrame, keys: list[str], value: str, depth: int, width: int, panes: int) -> DataFrame:
    """Counters (win, row, pos, val) of a sliding Count-Min; cells of a row are aged in the order of pos."""
    cells = count_min(df, keys, value, depth, width, ["pane", "closed"] if "closed" in df.columns else ["pane"])
    return rotate(cells, f"pos * {panes} div {width}", panes).groupBy("win", "row", "pos").agg(F.sum("val").alias("val"))

"""Document fingerprints from spot signatures, in DataFrame operations only (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

# Common words of English, German, French and Spanish that anchor signatures.
ANCHORS = (
    "a an and are as at be by for from had has have he in is it of on or that the this to was were which with you "
    "aber als am auch auf aus bei das dem den der des die ein eine einer er es für im ist mit nicht sich sie sind und von war wie zu "
    "au aux avec ce dans de du elle en est et il la le les mais ne nous ou par pas plus pour que qui se sur un une "
    "al como con del el esta las los lo más no para pero por se si sin su sus y"
).split()
#: Content words of a signature.
CHAIN = 3
#: Rows of one window group, about, and quantiles of doc_id between which groups are of equal width.
GROUP_ROWS = 2000
QUANTILES = 128


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The distinct signatures of a text as sorted 32-bit hashes.

    Letters and digits in lower case make words. After each anchor, and from the start of the text, the next `chain`
    content words (those that are no anchors) are a signature; near the end of the text it may be shorter. A null text or one
    without content words has none.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    marked = F.regexp_replace(plain, f" (?:{'|'.join(sorted(set(ANCHORS)))})(?= )", "\x01")
    between = F.filter(F.transform(F.split(marked, "\x01"), lambda x: F.trim(x)), lambda x: x != "")  # content words between anchors: at least one each

    def chains(pieces):
        return F.transform(pieces, lambda _, i: F.substring_index(F.array_join(F.slice(pieces, i + 1, chain), " "), " ", chain))

    found = F.transform(F.array(between), chains)[0]  # a lambda's variable is evaluated once
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.hash(x))))


def digest(found: Column) -> Column:
    """A set of signatures as text: eight hexadecimal digits each, in order."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(F.lit(1.0))


def spot_fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, n_chars and signatures of each row of docs (doc_id, text); a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), signatures(text, chain).alias("signatures"))


def spot_links(docs: DataFrame, alike: float = 0.8, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Pairs of sets of signatures (a, b, similarity) that are alike, and the rows' memberships (doc_id, set_id).

    A set is named by its least doc_id, so copies are one set and aren't expanded into pairs; rows without signatures or
    doc_id are in no set. Sets are partitioned by length, where only neighbouring classes meet, as a set that is much
    longer can't be alike; within these, two alike sets share one of the rarest signatures of either (the prefix), and only
    such pairs are compared in full.
    """
    found = spot_fingerprints(docs, chain).filter("doc_id IS NOT NULL AND size(signatures) > 0").select("doc_id", "signatures")
    sets = found.groupBy("signatures").agg(F.min("doc_id").alias("set_id"))
    members = found.join(sets, "signatures").select("doc_id", "set_id")
    posts = sets.select("set_id", F.size("signatures").alias("n"), F.explode("signatures").alias("signature"))
    counts = posts.groupBy("signature").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = posts.join(counts, "signature").groupBy("set_id", "n").agg(F.sort_array(F.collect_list(F.struct("rows", "signature"))).alias("list"))
    # signatures that no other set has come first in the prefix of n - ceil(alike * n) + 1
    kept = F.col("n") - F.ceil(F.col("n") * alike - 1e-9) + 1 - (F.col("n") - F.size("list"))
    length = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / alike)))
    prefix = shared.filter(kept > 0).select("set_id", "n", length.alias("class"), F.explode(F.slice("list", F.lit(1), kept.cast("int"))).alias("p"))
    prefix = prefix.select("set_id", "n", "class", "p.signature")
    shorter = prefix.select(F.col("set_id").alias("a"), F.col("n").alias("m"), F.explode(F.array("class", F.col("class") + 1)).alias("class"), "signature")
    pairs = shorter.join(prefix.withColumnRenamed("set_id", "b"), ["signature", "class"])
    pairs = pairs.filter((F.col("m") >= F.col("n") * alike - 1e-9) & ((F.col("m") < F.col("n")) | (F.col("m") == F.col("n")) & (F.col("a") < F.col("b")))).select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("signatures").alias("x")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("signatures").alias("y")), "b")
    pairs = pairs.withColumn("similarity", likeness(F.col("x"), F.col("y"))).filter(F.col("similarity") >= alike)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"), members


def _between(limits: list[int], low: int = 0) -> Column:
    """How many of the limits, in order, doc_id has reached: a search by halves."""
    if not limits:
        return F.lit(low)
    at = len(limits) // 2
    return F.when(F.col("doc_id") < limits[at], _between(limits[:at], low)).otherwise(_between(limits[at + 1 :], low + at + 1))


def _grouped(d: DataFrame, group_rows: int) -> DataFrame:
    """d with `part` and `place`, which put it into groups of about group_rows rows in the order of doc_id.

    Between quantiles of doc_id, of which there are QUANTILES at most, groups are of equal width, so ids far from all others
    don't leave the rest in one group. Rows without doc_id are a group before all others.
    """
    ids = d.filter("doc_id IS NOT NULL")
    least, most, rows = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if not rows:
        return d.withColumn("part", F.lit(-1)).withColumn("place", F.lit(0).cast("long"))
    n = min(QUANTILES, -(-rows // group_rows))
    found = ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    limits = sorted({x for x in map(int, found) if least < x <= most})
    edges = [least, *limits, most + 1]
    widths = [min(2**62, max(1, (b - a) * group_rows * (len(edges) - 1) // rows)) for a, b in zip(edges, edges[1:])]
    width = F.element_at(F.array(*(F.lit(x).cast("long") for x in widths)), F.col("part") + 1)
    d = d.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(_between(limits)))
    return d.withColumn("place", F.when(F.col("part") >= 0, F.call_function("div", "doc_id", width)).otherwise(0).cast("long"))


def with_next(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, text, signatures of each row, and as next_text, next_signatures those of the next row in descending doc_id.

    After the last row comes the first. Rows with the same doc_id follow in the order of their texts, and those with a
    null doc_id come last; a null text counts as empty. No task sorts all rows: groups of about `group_rows` rows
    are sorted apart, and only the first row of each is looked at across groups. Many rows with one doc_id or none share a group.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = _grouped(d, group_rows)
    group = ["part", "place"]
    order = W.partitionBy(*group).orderBy(F.col("doc_id").desc_nulls_last(), F.col("text"))
    heads = d.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(*group, F.col("text").alias("head"))
    down = W.orderBy(F.col("part").desc(), F.col("place").desc())
    after = d.select(*group).distinct().withColumn("follows", F.lead(F.struct(*group)).over(down))  # one narrow row a group
    first = F.max(F.struct(*group)).over(W.partitionBy())
    after = after.withColumn("follows", F.coalesce("follows", first)).select(F.col("part").alias("of_part"), F.col("place").alias("of_place"), "follows.*")
    heads = after.join(heads, group).select(F.col("of_part").alias("part"), F.col("of_place").alias("place"), F.struct(F.col("head").alias("text"), signatures(F.col("head")).alias("signatures")).alias("head"))
    d = d.withColumn("signatures", signatures(F.col("text")))
    d = d.withColumn("next", F.lead(F.struct("text", "signatures")).over(order))
    d = d.join(heads, group, "left").withColumn("next", F.coalesce("next", "head"))
    return d.select("doc_id", "text", "signatures", F.col("next.text").alias("next_text"), F.col("next.signatures").alias("next_signatures"))


def edited(text: Column, following: Column) -> Column:
    """text with its last third (code points, rounded down) replaced by as many from the start of the following text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def op8_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_next(table(spark, sf_dir, "documents"))
    d = d.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    d = d.withColumn("edited_signatures", signatures(F.col("edited")))
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("signatures")).alias("fingerprint"),
        digest(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )

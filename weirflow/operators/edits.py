"""Texts within an edit distance of each other, without a blocking key and exact.

Cut a text into k + 1 segments: k edits leave one of them whole, so it stands in the other text, at most k places away. Each right text goes out under its segments, each left text under
the pieces of it that can be one, by the length of the right text and the segment's number; what meets is verified by its distance. A segment that very many texts share (a common beginning) says little: its
texts go on with what is left of them when the segment is taken out, whose distance is at most k as well. Short rests meet under what is left of them with k characters deleted or blanked, where no others meet; longer ones
are cut again, level by level; only texts of which nothing is left to cut meet in parts of bounded size. Equal texts are folded first, so copies cost nothing until the pairs of rows are written.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.bands import _on_bins
from weirflow.shared import materialised

#: Right texts of a segment from which on it is cut further, and levels of cutting at most.
HOT = 200
DEEPEST = 8
#: Ways at most to delete or blank up to k characters of a rest that is not cut again.
VARIANTS = 300


def _segments(rest: Column, k: int) -> Column:
    """Of each of k + 1 segments: number, place, length; the last ones are longer by one where the length does not divide."""
    n = F.length(rest)
    short = F.floor(n / (k + 1)).cast("int")
    longer = n - short * (k + 1)
    first = k + 1 - longer  # from this number on segments are longer
    each = lambda i: F.struct(i.alias("i"), (i * short + F.greatest(i - first, F.lit(0))).alias("p"), (short + (i >= first).cast("int")).alias("l"))
    return F.transform(F.sequence(F.lit(0), F.lit(k)), each)


def _taken(rest: Column, start: Column, length: Column) -> Column:
    """What is left when a piece is taken out."""
    return F.concat(F.substring(rest, F.lit(1), start), F.substring(rest, start + length + 1, F.length(rest)))


def _right_keys(df: DataFrame, k: int) -> DataFrame:
    s = F.col("_s")
    out = df.withColumn("_s", F.explode(_segments(F.col("_rest"), k)))
    key = F.concat_ws("|", "_key", F.length("_rest"), s["i"], F.substring("_rest", s["p"] + 1, s["l"]))
    return out.select("_id", "_text", key.alias("_key"), _taken(F.col("_rest"), s["p"], s["l"]).alias("_rest")).distinct()


def _left_keys(df: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """``lengths``: column ``_n``, those of the right rests; others are not asked for."""
    n = F.length("_rest")
    out = df.withColumn("_n", F.explode(F.sequence(F.greatest(n - k, F.lit(0)), n + k))).join(lengths, "_n", "left_semi")
    out = out.withColumn("_s", F.explode(_segments(F.repeat(F.lit("x"), F.col("_n")), k)))
    s = F.col("_s")
    low, high = F.greatest(s["p"] - k, F.lit(0)), F.least(s["p"] + k, F.length("_rest") - s["l"])
    out = out.where(low <= high).withColumn("_at", F.explode(F.sequence(low, high)))
    key = F.concat_ws("|", "_key", "_n", s["i"], F.substring("_rest", F.col("_at") + 1, s["l"]))
    return out.select("_id", "_text", key.alias("_key"), _taken(F.col("_rest"), F.col("_at"), s["l"]).alias("_rest")).distinct()


def _edited(df: DataFrame, k: int) -> DataFrame:
    """Each rest with up to k characters deleted (``_d``) or blanked (``_b``)."""
    now = df.withColumns({"_n": F.length("_rest"), "_at": F.lit(0), "_d": F.lit(0), "_b": F.lit(0)})
    parts = [now]
    for _ in range(k):
        now = now.where(F.length("_rest") > F.col("_at")).withColumn("_at", F.explode(F.sequence("_at", F.length("_rest") - 1)))
        gone = now.withColumns({"_rest": _taken(F.col("_rest"), F.col("_at"), F.lit(1)), "_d": F.col("_d") + 1})
        blank = now.withColumns({"_rest": F.overlay("_rest", F.lit("\x00"), F.col("_at") + 1, F.lit(1)), "_b": F.col("_b") + 1, "_at": F.col("_at") + 1})
        now = gone.unionByName(blank)
        parts.append(now)
    return reduce(DataFrame.unionByName, parts)


def _right_edited(df: DataFrame, k: int) -> DataFrame:
    return _edited(df, k).select("_id", "_text", F.xxhash64("_key", "_n", "_d", "_b", "_rest").alias("_key")).distinct()


def _left_edited(df: DataFrame, k: int) -> DataFrame:
    """Left deletions, right deletions and blanks of both are k together: what meets is within the distance."""
    out = _edited(df, k).withColumn("_o", F.explode(F.sequence(F.lit(0), k - F.col("_d") - F.col("_b"))))
    return out.select("_id", "_text", F.xxhash64("_key", F.col("_n") - F.col("_d") + F.col("_o"), "_o", "_b", "_rest").alias("_key")).distinct()


def _near(l: DataFrame, r: DataFrame, most: int, part: int) -> DataFrame:  # noqa: E741
    """Numbers (_l, _r) of the texts that share a key and are within the distance."""
    pairs = _on_bins(l.select(F.col("_id").alias("_l"), F.col("_text").alias("_lt"), "_key").distinct(), r.select(F.col("_id").alias("_r"), F.col("_text").alias("_rt"), "_key").distinct(), ["_key"], part)
    return pairs.select("_l", "_r", F.levenshtein("_lt", "_rt", most).alias("distance")).where("distance >= 0")


def _numbered(df: DataFrame) -> DataFrame:
    """The different texts (_text) and a number of each (_id)."""
    return materialised(materialised(df.select(F.col("text").alias("_text")).where("_text is not null").distinct()).withColumn("_id", F.monotonically_increasing_id()))


def _pairs(left: DataFrame, right: DataFrame, most: int, hot: int, deepest: int) -> DataFrame:
    """Numbers (_l, _r) and ``distance`` of numbered texts that are near."""
    if most < 0:
        raise ValueError("a distance is not negative")
    longest = 0  # length of a rest whose edits are listed
    while sum(comb(longest + 1, j) * 2**j for j in range(most + 1)) <= VARIANTS and longest < VARIANTS:
        longest += 1
    ready = lambda d: d.select("_id", "_text", F.lit("").alias("_key"), F.col("_text").alias("_rest"))
    l, r = ready(left), ready(right)  # noqa: E741
    hits = []
    for level in range(deepest):
        lengths = materialised(r.select(F.length("_rest").alias("_n")).distinct())
        l, r = materialised(_left_keys(l, lengths, most)), materialised(_right_keys(r, most))  # noqa: E741
        many = materialised(r.groupBy("_key").count().where(F.col("count") > hot).select("_key"))
        if level + 1 == deepest or many.isEmpty():
            hits.append(_near(l, r, most, 100 * hot))
            break
        la, ra = l.join(many, "_key", "left_anti"), r.join(many, "_key", "left_anti")
        lb, rb = l.join(many, "_key", "left_semi"), r.join(many, "_key", "left_semi")
        if longest >= 2 * most:
            # short rests of a hot segment meet by their edits, longer ones are cut again
            hits.append(_near(la, ra, most, 100 * hot))
            hits.append(_near(_left_edited(lb.where(F.length("_rest") <= longest + most), most), _right_edited(rb.where(F.length("_rest") <= longest), most), most, 100 * hot))
            l, r = lb.where(F.length("_rest") > longest - most), rb.where(F.length("_rest") > longest)  # noqa: E741
            if r.isEmpty():
                break
        else:
            # of a hot segment the texts with something left are cut again; those without meet in parts: a short rest on one side meets the rests of the other that are within reach of its length
            short = lambda d: d.where(F.length("_rest") <= most)
            reach = lambda d: d.where(F.length("_rest") <= 2 * most)
            for a, b in ((la, ra), (short(lb), reach(rb)), (reach(lb), short(rb))):
                hits.append(_near(a, b, most, 100 * hot))
            l, r = lb, rb  # noqa: E741
    return reduce(DataFrame.unionByName, hits).distinct()


def similar_texts(left: DataFrame, right: DataFrame, most: int, hot: int = HOT, deepest: int = DEEPEST) -> DataFrame:
    """Pairs (left_text, right_text, distance) of the different texts in column ``text`` of either side."""
    l, r = _numbered(left), _numbered(right)  # noqa: E741
    pairs = _pairs(l, r, most, hot, deepest)
    return pairs.join(l.withColumnRenamed("_id", "_l"), "_l").withColumnRenamed("_text", "left_text").join(r.withColumnRenamed("_id", "_r"), "_r").select("left_text", F.col("_text").alias("right_text"), "distance")


def similar_rows(left: DataFrame, right: DataFrame, left_text: str, right_text: str, most: int, hot: int = HOT, least: int = 0) -> DataFrame:
    """Pairs of rows whose texts are at most ``most`` and at least ``least`` edits apart, with the ``distance``; columns of other names on either side. Null texts are near nothing."""
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    l, r = (_numbered(d.select(F.col(c).alias("text"))) for d, c in ((left, left_text), (right, right_text)))  # noqa: E741
    pairs = _pairs(l, r, most, hot, DEEPEST).where(F.col("distance") >= least)
    own = lambda d, c, t, name: d.join(t.withColumnRenamed("_id", name), F.col(c) == F.col("_text")).drop("_text")
    return own(left, left_text, l, "_l").join(pairs, "_l").join(own(right, right_text, r, "_r"), "_r").select(*left.columns, *right.columns, "distance")

"""Mixing sources to target weights (operator 7): entropy balancing.

The mix gives document d a rate w_d in [0, MOST] and minimises sum of size_d * (w_d ln w_d - w_d + 1), the
entropy against taking every token once, such that each source's sum of size_d * w_d is its target and, over
all sources, the mix keeps the corpus's mean length band (the binary digits of a document's size). The second
constraint is shared by all documents and, as it need not be attainable, has a slack: SLACK scales the price
of missing it. The optimum tilts exponentially,
    w_d = min(MOST, exp(lambda of d's source + theta * (band_d - mean band))),
and (lambda, theta) minimises the convex dual. Its Hessian is an arrowhead: given theta, every source's lambda
follows in its own row, so Newton's method runs on the dual with the lambdas eliminated. A step sums its
gradient and its curvature (the Schur complement) over the documents of all sources, pre-aggregated once to a
source's tokens by band; the gradient rises with theta, so a step that leaves the bracket is halved. The
steps end on the gradient. Sources at their cap stand at MOST and only shift the shared constraint.

Rates become copies by systematic rounding: in a source, documents stand in the order of a hash of the id
less the rate's fraction, and the first of them, up to the sum of the fractions' tokens, get one copy more.
So a source's tokens miss its target by less than one document, and a document is taken floor(w) or ceil(w)
times. What decides is a source's cut in that order, found from the tokens of RANGES ranges and an exact order
in the one range that holds the cut; a document's copies then follow from its own row, and no text moves.

Null source is a source of its own, last in order. Null or empty text has size 0 and takes nothing; a table
without words has targets 0, an empty one gives no rows. Every row counts, repeated ones too; rows equal in id
and size are taken alike. Long texts count whole. Other columns are kept only by take_copies, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import once
from .common import SPACE_WORD, few, materialize

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often.
MOST = 3.0
#: Price of missing the shared constraint: the smaller, the closer the mix keeps to the mean length band.
SLACK = 0.1
NEWTON_STEPS, TOLERANCE = 60, 1e-13
#: Ranges of the rounding order a source is cut into.
RANGES = 1 << 14
#: Rates are rounded to so many digits, so that sums in another order give the same copies.
RATE_DIGITS = 9


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def band_of(size: Column) -> Column:
    """Binary digits of a size above 0."""
    return F.length(F.bin(size))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target, full (at its cap): shares of all sizes by weight, none above most *
    source_size, the excess reshared by weight. Sources are ranked by range partitions, whose counts come to the
    driver; a round of resharing is one sum over the sources."""
    spark = sizes.sparkSession
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = total.repartitionByRange(parts, F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    ranked = materialize(ranked.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "mix-sources")
    before, at = [], 0
    for part, n in sorted(ranked.groupBy("part").count().collect()):
        before.append((part, at))
        at += n
    before = F.create_map(*[F.lit(x) for pair in before for x in pair]) if before else F.create_map().cast("map<int,int>")
    rank = F.col("nth") + F.element_at(before, F.col("part"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    level, full = 0.0, F.lit(False)
    while True:
        left = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)), F.count_if(full)).first()
        if left[0] is None or not left[2]:
            break
        level = (left[0] - left[1]) / left[2]
        full = F.col("cap") < level * F.col("weight")
        if ranked.where(full).count() == left[3]:
            break
    return ranked.select("source", "source_size", F.when(full, F.col("cap")).otherwise(level * F.col("weight")).alias("target"), full.alias("full"))


@dataclass
class Mix:
    """What a document's copies follow from: a row a source, and the shared multiplier."""

    sources: DataFrame  # of_source, source_size, target, lam (null: rate 0), full, cut_range, cut
    theta: float
    mean: float
    most: float

    def rate(self) -> Column:
        """Of a row with size and the columns of its source."""
        tilted = F.least(F.lit(self.most), F.exp(F.col("lam") + self.theta * (band_of(F.col("size")) - self.mean)))
        rate = F.when(F.col("full"), F.lit(self.most)).otherwise(F.round(tilted, RATE_DIGITS))
        return F.when(F.col("size") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(0.0)

    def joined(self, rows: DataFrame) -> DataFrame:
        """rows (source, size) with its source's columns and rate, share (its fraction), place and range. Up to a
        million sources are broadcast; beyond, a source's rows are dealt over 32 salts."""
        same = F.col("source").eqNullSafe(F.col("of_source"))
        if few(self.sources, 1_000_000):
            out = rows.join(F.broadcast(self.sources), same, "left")
        else:
            salted = self.sources.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
            out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int"))
            out = out.join(salted, same & (F.col("salt") == F.col("of_salt")), "left").drop("salt", "of_salt")
        out = out.withColumn("rate", self.rate()).withColumn("share", F.col("rate") - F.floor("rate"))
        uniform = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
        out = out.withColumn("place", uniform - F.col("share"))
        return out.withColumn("range", F.floor((F.col("place") + 1) * (RANGES // 2)).cast("int"))


ORDER = ("place", "doc_id", "size")


def source_multiplier(theta: float, mean: float, most: float) -> Column:
    """lambda of a row with target and cells: sum of tokens * min(most, exp(lambda + theta * (band - mean))) is the
    target. Bands that reach `most` are fixed there and the rest is solved again, at most once a band."""
    tilt = lambda c: F.exp(theta * (c["band"] - mean))
    over = lambda f: F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + f(c))

    def again(lam, _):
        full = lambda c: F.exp(lam) * tilt(c) >= most
        rest = over(lambda c: F.when(full(c), 0.0).otherwise(c["tokens"] * tilt(c)))
        return F.when(rest > 0, F.ln((F.col("target") - over(lambda c: F.when(full(c), most * c["tokens"]).otherwise(0.0))) / rest)).otherwise(lam)

    return F.aggregate("cells", F.ln(F.col("target") / over(lambda c: c["tokens"] * tilt(c))), again)


def balance(sources: DataFrame, cells: DataFrame, most: float = MOST, slack: float = SLACK, steps: int = NEWTON_STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float, float]:
    """sources (source, source_size, target, full) with lam, then theta and the mean band. cells: source, band,
    tokens. A step's sums over all documents come to the driver as one row."""
    by_band = cells.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("band", "tokens"))).alias("cells"))  # 63 bands at most
    by_band = by_band.withColumnRenamed("source", "of_source")
    found = sources.join(by_band, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    found = materialize(found.withColumn("free", ~F.col("full") & (F.col("target") > 0) & (F.col("source_size") > 0)), "mix-state")
    total, mean = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("band")) / F.sum("tokens")).first()
    if not total:
        return sources.withColumn("lam", F.lit(None).cast("double")), 0.0, 0.0
    total, mean = float(total), float(mean)
    fixed = found.where("full").select(F.explode("cells").alias("c")).agg(F.sum(most * F.col("c.tokens") * (F.col("c.band") - mean))).first()[0] or 0.0
    theta, low, high = 0.0, float("-inf"), float("inf")
    for _ in range(steps):
        eta = lambda c: F.exp(F.col("lam") + theta * (c["band"] - mean))  # noqa: E731, B023
        curve = lambda c: F.when(eta(c) < most, c["tokens"] * eta(c)).otherwise(0.0)  # noqa: E731, B023
        off = lambda c: c["band"] - mean
        over = lambda f: F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + f(c))
        state = once(found.where("free").select("target", "cells"), lam=source_multiplier(theta, mean, most))
        sums = state.select(
            over(lambda c: c["tokens"] * F.least(F.lit(most), eta(c)) * off(c)).alias("q"),  # noqa: B023
            over(curve).alias("d"),
            over(lambda c: curve(c) * off(c)).alias("c"),  # noqa: B023
            over(lambda c: curve(c) * off(c) * off(c)).alias("e"),  # noqa: B023
        )
        q, bend = sums.agg(F.sum("q"), F.sum(F.col("e") - F.when(F.col("d") > 0, F.col("c") * F.col("c") / F.col("d")).otherwise(0.0))).first()
        if q is None:
            break
        gradient = q + fixed + slack * total * theta
        if abs(gradient) <= tolerance * total:
            break
        low, high = (theta, high) if gradient < 0 else (low, theta)
        theta = max(theta - 1, min(theta + 1, theta - gradient / (bend + slack * total)))
        if not low < theta < high:
            theta = (low + high) / 2
        if high - low <= 1e-15 * max(1.0, abs(theta)):
            break
    return found.select(*sources.columns, F.when(F.col("free"), source_multiplier(theta, mean, most)).alias("lam")), theta, mean


def plan_mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, slack: float = SLACK) -> Mix:
    """sizes: doc_id, source, size."""
    cells = materialize(sizes.where("size > 0").groupBy("source", band_of(F.col("size")).alias("band")).agg(F.sum("size").alias("tokens")), "mix-cells")
    goal = materialize(targets(sizes, weights, most), "mix-targets")
    solved, theta, mean = balance(goal, cells, most, slack)
    solved = materialize(solved.withColumnRenamed("source", "of_source"), "mix-solved")
    mix = Mix(solved, theta, mean, most)
    rows = mix.joined(sizes)
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("in_range"), F.sum(F.col("size") * F.col("share")).alias("extra"))
    source = Window.partitionBy("source")
    upto = F.sum("in_range").over(source.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.withColumn("extra", F.round(F.sum("extra").over(source), 3)).withColumn("upto", upto)
    # The first range that passes the extra tokens holds the cut.
    cuts = ranges.where("upto > extra").groupBy("source").agg(F.min(F.struct("range", (F.col("upto") - F.col("in_range")).alias("ahead"), "extra")).alias("c"))
    cuts = materialize(cuts.select(F.col("source").alias("c_source"), F.col("c.range").alias("cut_range"), "c.ahead", "c.extra"), "mix-cuts")
    near = F.broadcast(cuts) if few(cuts, 1_000_000) else cuts
    inside = rows.join(near, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("range") == F.col("cut_range"))).select("source", "ahead", "extra", *ORDER)
    within = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("before", F.col("ahead") + within).where(F.col("before") + F.col("size") / 2 < F.col("extra"))
    last = inside.groupBy("source").agg(F.max(F.struct(*ORDER)).alias("cut")).withColumnRenamed("source", "l_source")
    found = solved.join(cuts.select("c_source", "cut_range"), F.col("of_source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    found = found.join(last, F.col("of_source").eqNullSafe(F.col("l_source")), "left").drop("l_source")
    return Mix(materialize(found, "mix-plan"), theta, mean, most)


def _with_copies(rows: DataFrame, mix: Mix) -> DataFrame:
    out = mix.joined(rows)
    first = (F.col("range") < F.col("cut_range")) | ((F.col("range") == F.col("cut_range")) & (F.struct(*ORDER) <= F.col("cut")))
    copies = F.floor("rate") + F.when((F.col("share") > 0) & F.coalesce(first, F.lit(False)), 1).otherwise(0)
    return out.withColumn("copies", F.when(F.col("size") > 0, F.least(copies, F.lit(int(mix.most)))).otherwise(0).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, slack: float = SLACK) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken; one row a row of docs."""
    sizes = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    out = _with_copies(sizes, plan_mix(sizes, weights, most, slack))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, slack: float = SLACK) -> DataFrame:
    """docs with all its columns, each row standing as often as the mix takes it; rows never taken go. Sizes are
    counted once for the plan and once more where the rows are written, which moves no text."""
    sizes = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    mix = plan_mix(sizes, weights, most, slack)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"))
    out = _with_copies(rows, mix).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")

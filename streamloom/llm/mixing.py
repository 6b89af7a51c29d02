"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document's copies are its source's target over the source's size, rounded up or down. Rounding
is dependent: the fractional parts of two documents are pooled, and a draw gives the pool to one
of them, until one of the two is whole; what is left goes on to the next. This runs as a reduction
tree: nodes of about FAN documents of one source and about one size, then nodes of FAN residuals,
and so on; each level decides all but one document of every node.

The tree keeps the number of copies, not of words, so two steps beside it keep the words. Documents
that hold more than SHARE of their source's words (at most 1 / SHARE of them) are decided before it,
largest first, each with the share that is still needed of the words that are left; and so are,
after it, the last residuals (one for each size class). One is never taken where that overshoots by
more than leaving it falls short. What they add or lack goes to the rate of those that follow. So
documents of the tree get their exact expectation for the rate that is left, while those two groups
are biased to what fits: the mix is not unbiased for each of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.names import set_aside
from streamloom.session import ready, stage

#: Documents or residuals that a node of the tree joins, about.
FAN = 64
#: Share of its source's words above which a document is decided before the tree.
SHARE = 1 / 512
_WORD = r"[^\x20\x09-\x0D]+"
_UNIT = "struct<size:bigint,h:bigint,doc_id:bigint,occ:int,p:double>"
_TINY = 1e-12


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources by code point, null last, have the weights in turn and share the sum of all sizes; no
    target is above cap times its source's size, and what is over goes to the others by weight.
    The windows run over one row for each source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(turn - 1, F.lit(len(weights))) + 1)
    ranked = totals.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("r", F.col("most") / F.col("w"))
    order = Window.orderBy("r", F.col("source").isNull(), "source")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - before) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", F.col("source").isNull().alias("z"), "source", "level"))).over(everything)
    return levelled.withColumn("fit", fits["level"]).select(
        "source", "source_size", F.coalesce(F.least("most", F.col("fit") * F.col("w")), F.lit(0.0)).cast("double").alias("target")
    )


def _draw(seed: int, *parts: str) -> str:
    """A number in [0, 1) that depends on the parts alone."""
    return f"(shiftrightunsigned(xxhash64({seed}L, {', '.join(parts)}), 11) / 9007199254740992D)"


def _fold(units: str, seed: int) -> Column:
    """struct(done, left) of an array of units: those decided with p 0 or 1, and the one left."""
    a, b = "s.left", "x"
    total = f"({a}.p + {b}.p)"
    draw = _draw(seed, f"{a}.h", f"{b}.h")
    first = f"if({total} < 1D, {draw} * {total} >= {a}.p, {draw} * (2D - {total}) < 1D - {b}.p)"  # a is decided
    unit = lambda u, p: f"named_struct('size', {u}.size, 'h', {u}.h, 'doc_id', {u}.doc_id, 'occ', {u}.occ, 'p', {p})"
    whole, rest = f"if({total} < 1D, 0D, 1D)", f"if({total} < 1D, {total}, {total} - 1D)"
    step = f"""named_struct('done', array_append(s.done, if({first}, {unit(a, whole)}, {unit(b, whole)})),
                            'left', if({first}, {unit(b, rest)}, {unit(a, rest)}))"""
    start = f"named_struct('done', cast(array() as array<{_UNIT}>), 'left', {units}[0])"
    return F.expr(f"aggregate(slice({units}, 2, greatest(size({units}) - 1, 0)), {start}, (s, x) -> {step})")


def _settle(units: str, need: str, seed: int) -> Column:
    """struct(need, left, done) of an array of units by falling size, of which about `need` words are to be taken.

    Each is taken with the probability need / left, left being the words of it and all that follow,
    and those behind the array, too, if the column `words` counts them; where one choice misses the
    need, or what is left misses it, by less than the other, that choice is made.
    """
    take_miss, leave_miss = "greatest(x.size - s.need, 0D)", "greatest(s.need - (s.left - x.size), 0D)"
    by_draw = f"{_draw(seed, 'x.h')} * s.left < s.need"
    taken = f"if({take_miss} = {leave_miss}, {by_draw}, {take_miss} < {leave_miss})"
    unit = f"named_struct('size', x.size, 'h', x.h, 'doc_id', x.doc_id, 'occ', x.occ, 'p', if({taken}, 1D, 0D))"
    step = f"named_struct('need', s.need - if({taken}, x.size, 0L), 'left', s.left - x.size, 'done', array_append(s.done, {unit}))"
    start = f"named_struct('need', cast({need} as double), 'left', cast(words as double), 'done', cast(array() as array<{_UNIT}>))"
    return F.expr(f"aggregate({units}, {start}, (s, x) -> {step})")


def copies(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, share: float = SHARE) -> DataFrame:
    """(doc_id, source, size, occ, source_size, target, copies) for every row (doc_id, source, size).

    Rows that agree in all three are numbered by occ. copies lies within one of target over
    source_size and is 0 where the source has no words; a document never gets more than cap
    copies. The result depends on the rows and the seed alone. Null ids and sources are values like
    others and a null size is 0; an empty table gives an empty result. Documents above `share` of their source's words,
    at most 1 / share of a source, are decided in one fold for each source.
    """
    spark = ready(rows.sparkSession)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    units = stage(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "units")
    targets = stage(source_targets(units.select("source", (F.col("size") * F.col("m")).alias("size")), weights, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = targets.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + _TINY)).withColumn(
        "p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))
    )
    known = known.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("z"), "source_size", "target", "whole", F.when(F.col("p") > _TINY, F.col("p")).otherwise(0.0).alias("p"))
    each = units.select(
        "doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("occ"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("z")
    )
    each = each.withColumn("class", F.floor(F.log2(F.col("size") + 1) * 2).cast("int")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "occ", "s", "z", "size"))
    each = each.join(known.select("s", "z", "source_size", "p"), ["s", "z"])
    outsized = F.col("size") > F.col("source_size") * share
    unit = lambda p: F.struct("size", "h", "doc_id", "occ", p.alias("p")).cast(_UNIT)
    falling = lambda: F.sort_array(F.collect_list("u"), asc=False)

    # Outsized documents of each source, by falling size; need and left go on to the rest.
    large = each.where(outsized).select("s", "z", "source_size", "p", unit(F.lit(0.0)).alias("u")).groupBy("s", "z", F.col("source_size").alias("words"), "p").agg(falling().alias("us"))
    large = stage(large.select("s", "z", _settle("us", "p * words", seed - 1).alias("f")), "large")
    rest = known.join(large.select("s", "z", "f.need", "f.left"), ["s", "z"], "left")
    rest = rest.select("s", "z", F.coalesce("need", F.col("p") * F.col("source_size")).alias("need"), F.coalesce("left", F.col("source_size").cast("double")).alias("left"))
    rate = F.when(F.col("left") > 0, F.least(F.greatest(F.col("need") / F.col("left"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    rest = stage(rest.withColumn("q", rate), "rest")
    each = each.where(~outsized)
    crowd = stage(each.groupBy("s", "z", "class").agg(F.ceil(F.count("*") / FAN).cast("long").alias("nodes")), "crowd")
    widest = crowd.agg(F.max("nodes")).first()[0] or 0

    placed = each.join(rest, ["s", "z"]).join(crowd, ["s", "z", "class"])
    level = placed.select("s", "z", "class", F.pmod("h", "nodes").alias("node"), unit(F.col("q")).alias("u"))
    decided, number = [large.select("s", "z", F.explode("f.done").alias("u"))], 0
    while True:
        keys = ["s", "z", "class", "node"]
        nodes = level.groupBy(*keys).agg(F.sort_array(F.collect_list("u")).alias("us"))
        folded = stage(nodes.select(*keys, _fold("us", seed + number).alias("f")), f"level{number}")
        decided.append(folded.select("s", "z", F.explode("f.done").alias("u")))
        number += 1
        if widest <= 1:
            break
        widest = -(-widest // FAN)
        level = folded.select("s", "z", "class", F.floor(F.col("node") / FAN).alias("node"), F.col("f.left").alias("u"))
    # One residual of each source and size class is left; they are decided by the words still needed.
    got = reduce(DataFrame.union, decided[1:]).groupBy("s", "z").agg(F.sum(F.col("u.size") * F.col("u.p")).alias("got"))
    last = folded.groupBy("s", "z").agg(F.sum("f.left.size").alias("words"), F.sort_array(F.collect_list("f.left"), asc=False).alias("us"))
    last = last.join(rest, ["s", "z"]).join(got, ["s", "z"], "left").withColumn("need", F.col("need") - F.coalesce("got", F.lit(0.0)))
    last = stage(last.select("s", "z", _settle("us", "need", seed - 2).alias("f")), "last")
    decided.append(last.select("s", "z", F.explode("f.done").alias("u")))
    out = reduce(DataFrame.union, decided).join(known.drop("p"), ["s", "z"])
    return out.select(
        "u.doc_id", F.when(~F.col("z"), F.col("s")).alias("source"), "u.size", "u.occ", "source_size", "target", (F.col("whole") + F.round("u.p")).cast("long").alias("copies")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, or not at all.

    Documents have doc_id, source and text; the size is the text's words (null: 0). Rows that
    agree in id, source and size share their copies, the first ones getting one more. All columns
    are kept, whatever their names. An empty table gives an empty result.
    """
    docs, back = set_aside(docs, ("_size", "_id", "_source", "_n", "_m", "_total", "_copies", "_copy"))
    sized = docs.withColumn("_size", word_count(F.col("text")))
    taken = copies(sized.select("doc_id", "source", F.col("_size").alias("size")), weights, cap, seed)
    taken = stage(taken.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_m"), F.sum("copies").alias("_total")).where("_total > 0"), "taken")
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_n"), "_m", "_total")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_n"))
    # Hashing the counts of a partition spares sorting its texts; a count is one row of five numbers.
    found = sized.join(taken.hint("shuffle_hash"), same)
    one = found.where("_m = 1").withColumn("_copies", F.col("_total"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy("text"))
    many = found.where("_m > 1").withColumn("_copies", F.floor(F.col("_total") / F.col("_m")) + (turn <= F.col("_total") % F.col("_m")).cast("long"))
    rows = one.unionByName(many).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*back)

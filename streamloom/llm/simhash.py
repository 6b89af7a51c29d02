"""Document fingerprints by SimHash, in DataFrame operations only.

A text's terms are its five-word shingles after lower-casing, each weighted by how often it
occurs. Every term's 64-bit hash (the first half of the MD5 of its words, a space between them)
votes on 64 signed bits; a fingerprint's bit is set where more
than half of the weight votes for it. Votes are summed 3 to a long, in lanes of 22, 22 and 20
bits, over parts of at most 2**18 terms of one row, which the sign bit leaves room for.

`within_radius` finds fingerprints by permuted block tables: 64 bits are cut into blocks, and for
each choice of blocks that must agree there is a table keyed by them.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.session import ready, stage

WORDS = 5
_LANES, _WIDTH = 22, 22
_MASK = (1 << 22) - 1
_PART = 1 << 18
_SPACE = r"[\x20\x09-\x0D]+"
_FIRST_ID = -(1 << 63)


def _words() -> Column:
    """Lower-cased words of the column _text."""
    stripped = F.btrim("_text", F.lit(" \t\n\x0b\f\r"))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(stripped), _SPACE))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(*keys, n_terms, fp) of rows (*keys, text); fp is 0 where there is no term.

    Rows of the same keys are taken as one text given several times, which leaves its fingerprint
    as it is. Null texts are empty.
    """
    rows = texts.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select(*keys, F.monotonically_increasing_id().alias("_row"), _words().alias("_w"))
    n = F.size("_w")
    shifted = [F.col("_w"), *[F.slice("_w", i + 1, F.greatest(n, F.lit(1))) for i in range(1, WORDS)]]
    zipped = F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)])
    rows = rows.select(*keys, "_row", n.alias("_n"), F.posexplode_outer(zipped).alias("_at", "_t"))
    names = rows.schema["_t"].dataType.fieldNames()
    last = F.col("_t")[names[-1]]
    rows = rows.where((F.col("_n") == 0) | last.isNotNull() | ((F.col("_n") < WORDS) & (F.col("_at") == 0)))
    term = F.md5(F.concat_ws(" ", *[F.col("_t")[x] for x in names]).cast("binary"))
    h = F.conv(F.substring(term, 1, 16), 16, -10).cast("long")
    rows = rows.select(*keys, "_row", F.coalesce(F.floor(F.col("_at") / _PART), F.lit(0)).alias("_part"), F.when(F.col("_n") > 0, h).otherwise(0).alias("_h"), (F.col("_n") > 0).cast("long").alias("_one"))
    lanes = sum(1 << (_WIDTH * i) for i in range(3))
    sums = [F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(F.lit(lanes))).alias(f"_s{j}") for j in range(_LANES)]
    parts = rows.groupBy(*keys, "_row", "_part").agg(F.sum("_one").alias("_k"), *sums)
    bits = [(j, i) for i in range(3) for j in range(_LANES) if j + _WIDTH * i < 64]
    votes = [F.sum(F.shiftrightunsigned(f"_s{j}", _WIDTH * i).bitwiseAND(F.lit(_MASK))).alias(f"_b{j + _WIDTH * i}") for j, i in bits]
    whole = parts.groupBy(*keys).agg(F.sum("_k").alias("n_terms"), *votes)
    fp = reduce(
        lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"_b{b}") * 2 > F.col("n_terms"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    )
    return whole.select(*keys, "n_terms", fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of bits that two fingerprints agree in."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def written(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def tables(fp: Column, radius: int, spare: int = 2) -> Column:
    """The keys of a fingerprint in all tables: radius + spare blocks, of which `spare` must agree."""
    blocks = radius + spare
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for k, chosen in enumerate(combinations(range(blocks), spare)):
        mask = sum(masks[i] for i in chosen)
        out.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*out)


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(query_fp, fp) of all distinct fingerprints within the radius of a query, itself included.

    Two fingerprints that differ in at most radius bits agree in at least `spare` of the radius +
    spare blocks, so that one table at least brings them together: none is missed.
    """
    every = fps.select("fp").where("fp is not null").distinct().select("fp", F.explode(tables(F.col("fp"), radius)).alias("key"))
    asked = queries.select(F.col("fp").alias("query_fp")).where("query_fp is not null").distinct().select("query_fp", F.explode(tables(F.col("query_fp"), radius)).alias("key"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("query_fp"))) <= radius
    return asked.join(every.hint("merge"), (asked.key == every.key) & near).select("query_fp", "fp").distinct()


def _following(docs: DataFrame) -> DataFrame:
    """(k, th, n, m, nk, nth): distinct documents in order with the one that follows each.

    Documents are ordered by id (null first) and then by the hash of their text; the first follows
    the last. Keys alone are dealt out by range; what crosses partitions is one row for each.
    """
    spark = docs.sparkSession
    keys = docs.groupBy("k", "th").agg(F.max(F.char_length("text")).cast("long").alias("n"), F.count("*").alias("m"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = stage(keys.repartitionByRange(parts, "k", "th").withColumn("pid", F.spark_partition_id()), "keys")
    inside = Window.partitionBy("pid").orderBy("k", "th")
    keys = keys.withColumn("nk", F.lead("k").over(inside)).withColumn("nth", F.lead("th").over(inside))
    heads = keys.groupBy("pid").agg(F.min(F.struct("k", "th")).alias("head"))
    order = Window.orderBy("pid")
    first = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("pid", F.coalesce(F.lead("head").over(order), first).alias("after"))
    return keys.join(heads, "pid").select("k", "th", "n", "m", F.coalesce("nk", "after.k").alias("nk"), F.when(F.col("nk").isNotNull(), F.col("nth")).otherwise(F.col("after.th")).alias("nth"))


def edited_fingerprints(docs: DataFrame, radius: int = 3, every: int = 20) -> DataFrame:
    """Fingerprints of documents and of their edited texts, for every row of docs.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document's. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next and, for ids divisible by `every`, n_near: how many
    rows' fingerprints lie within the radius of its own. Null texts are empty; rows with a null id
    come first; repeated rows are one document and give as many equal rows; of rows with one id
    and several texts the next is the next text in order of the texts' hashes. A single document
    follows itself. Empty tables give an empty result; other columns are ignored.
    """
    ready(docs.sparkSession)
    t = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("th", F.xxhash64("text"))
    order = stage(_following(t), "order")
    before = order.select(F.col("nk").alias("k"), F.col("nth").alias("th"), F.col("k").alias("pk"), F.col("th").alias("pth"), F.floor(F.col("n") / 4).cast("int").alias("cut"))
    t = t.groupBy("k", "th").agg(F.min("text").alias("text"))  # repeats would meet repeats below; m gives them back
    heads = t.join(before.hint("merge"), ["k", "th"]).select(F.col("pk").alias("k"), F.col("pth").alias("th"), "cut", F.expr("substring(text, 1, cut)").alias("head"))
    both = t.join(heads.hint("merge"), ["k", "th"]).select(
        "k", "th", "text", F.concat(F.expr("substring(text, 1, char_length(text) - cut)"), "head").alias("edited")
    )
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))))
    rows = both.select("k", "th", F.sha2(F.encode("edited", "utf-8"), 256).alias("sha"), kinds.alias("x")).select("k", "th", "sha", "x.kind", "x.text")
    prints = fingerprints(rows, ["k", "th", "sha", "kind"])
    prints = prints.groupBy("k", "th", "sha").agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("efp"))
    prints = stage(prints, "prints")
    following = prints.select(F.col("k").alias("nk"), F.col("th").alias("nth"), F.col("fp").alias("nfp"))
    out = order.join(prints.hint("merge"), ["k", "th"]).join(following.hint("merge"), ["nk", "nth"])
    out = stage(out.select("k", "n", "m", "sha", "fp", "efp", "nfp"), "likeness")
    asked = out.where((F.col("k") % every == 0) & (F.col("k") != _FIRST_ID))
    sizes = out.groupBy("fp").agg(F.sum("m").alias("rows"))
    found = within_radius(out, asked, radius).join(sizes.hint("merge"), "fp").groupBy("query_fp").agg(F.sum("rows").alias("near"))
    found = stage(found, "near")  # read anew, so that the join can split a fingerprint of many documents
    out = out.join(found.withColumnRenamed("query_fp", "fp").hint("merge"), "fp", "left")
    own = (F.col("k") % every == 0) & (F.col("k") != _FIRST_ID)
    return out.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).select(
        F.when(F.col("k") != _FIRST_ID, F.col("k")).alias("doc_id"),
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        written(F.col("fp")).alias("fingerprint"),
        written(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
        F.when(own, F.col("near")).alias("n_near"),
    )

"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of band hashes are computed per document, A and B, of `bands` entries of
`rows` minhashes each. Table (i, j) is keyed by the pair (A_i, B_j), so bands**2 tables cost only
2 * bands * rows minhashes. A pair of similarity s meets in some table with probability
(1 - (1 - s**rows)**bands)**2: 0.9998 at 0.8 for the defaults, rising fast above.

Candidates are confirmed on full shingle sets (64-bit hashes of shingles). No group is expanded
into pairs: in each table entry every member is compared with the smallest member. Where an entry
then still holds several components, and shingles don't prove that no link can join them, those
outside its commonest component are compared with other members of that one, for a few rounds; only
those that are left outside then meet the rest in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.components import connected_components
from streamloom.llm.hashing import U64, mix, shingle_set, text_bytes, word_hashes
from streamloom.session import ready, stage

#: Members compared with a leader within one task group; more members are dealt over more groups.
FAN = 256
#: Shingles of the texts held at once, and of those streamed past them, where components of one leader meet.
BLOCK, SLICE = 1 << 20, 1 << 20
#: Rounds in which entries of several components get another leader, before the rest meets one by one.
ROUNDS = 3


@lru_cache(maxsize=8)
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return seeds[:n] | U64(1), seeds[n:]


def minhashes(items: np.ndarray, n: int) -> np.ndarray:
    """n minhashes of a set of 64-bit hashes."""
    factors, masks = _coefficients(n)
    out = np.full(n, np.iinfo(U64).max, U64)
    for at in range(0, len(items), 1 << 14):
        part = items[at : at + (1 << 14)]
        np.minimum(out, ((part[None, :] ^ masks[:, None]) * factors[:, None]).min(axis=1), out=out)
    return out


def half_keys(items: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The 2 * bands band hashes of a set: first collection A, then B."""
    signature = minhashes(items, 2 * bands * rows).reshape(2 * bands, rows)
    out = np.arange(1, 2 * bands + 1, dtype=U64)
    for r in range(rows):
        out = mix(out * U64(0x9E3779B97F4A7C15) + signature[:, r])
    return out


def _features(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, first, second, halves = [], [], [], []
            for raw in text_bytes(batch.column(1)):
                items = shingle_set(word_hashes(raw), words)
                count.append(len(items))
                first.append(items.sum(dtype=U64))
                second.append(mix(items).sum(dtype=U64))
                halves.append(half_keys(items, bands, rows) if len(items) else np.empty(0, U64))
            sizes = [0, *np.cumsum([len(x) for x in halves])]
            flat = np.concatenate(halves).view(np.int64) if halves else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(count, pa.int64()),
                    pa.array(np.array(first, U64).view(np.int64)),
                    pa.array(np.array(second, U64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)),
                ],
                names=["doc_id", "n_shingles", "s1", "s2", "halves"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(word_hashes(raw), words) for raw in text_bytes(batch.column(1))]
            first = np.array([x.sum(dtype=U64) for x in sets], U64).view(np.int64)
            second = np.array([mix(x).sum(dtype=U64) for x in sets], U64).view(np.int64)
            sizes = [0, *np.cumsum([len(x) for x in sets])]
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(first),
                    pa.array(second),
                    pa.LargeListArray.from_arrays(pa.array(sizes, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64())),
                ],
                names=["n_shingles", "s1", "s2", "items"],
            )

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by leader and group, the leader's set first; one set is held at a time."""
    held, items = None, None
    for batch in batches:
        leaders, groups, members = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        heads = batch.column(3).to_numpy(zero_copy_only=False)
        column = batch.column(4)
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy().view(U64)
        out = []
        for i in range(len(leaders)):
            mine = values[offsets[i] : offsets[i + 1]]
            if heads[i] == 0:
                held, items = (leaders[i], groups[i]), mine.copy()
                continue
            if held != (leaders[i], groups[i]):
                raise RuntimeError("a member came without its leader")
            at = np.searchsorted(items, mine)
            at[at == len(items)] = 0
            common = int(np.count_nonzero(items[at] == mine))
            out.append((leaders[i], members[i], common, len(items) + len(mine) - common))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["leader", "member", "common", "total"])


def _verify(pairs: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """(leader, member, common, total) of each pair, on full sets.

    The members of a leader are dealt over groups of about FAN rows, each with a copy of the
    leader's set, so that a leader of many members doesn't land in one task.
    """
    pairs = stage(pairs, "found", rows=rows)
    counts = stage(pairs.groupBy("leader").agg(F.count("*").alias("k")), "counts", rows=rows)  # read anew, as crowds are
    dealt = stage(
        pairs.join(counts.hint("merge"), "leader").select("leader", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("k") / FAN)).alias("g")), "pairs", rows=rows
    )
    member_rows = dealt.join(sets.hint("merge"), dealt.member == sets.rep).select("leader", "g", "member", F.lit(1).alias("head"), "items")
    groups = dealt.select("leader", "g").distinct()
    leader_rows = groups.join(sets.hint("merge"), groups.leader == sets.rep).select(
        "leader", "g", F.col("leader").alias("member"), F.lit(0).alias("head"), "items"
    )
    return (
        leader_rows.union(member_rows)
        .repartition("leader", "g")
        .sortWithinPartitions("leader", "g", "head", "member")
        .mapInArrow(_compare, "leader long, member long, common long, total long")
    )


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    bands: int = 9,
    rows: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    A text's set is its distinct `words`-word shingles after lower-casing A-Z; a shorter text is
    one shingle; null and blank texts have empty sets and are linked with nothing. Texts are
    linked if their sets' Jaccard similarity is at least threshold (compared in whole hundredths
    of a percent). component_id is the smallest id reachable. Rows with a null id are linked with
    nothing and have a null component; repeated ids are one document if their texts agree, and
    otherwise one document with several texts. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = ready(docs.sparkSession)
    bar = round(threshold * 10_000)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = stage(
        slim.mapInArrow(_features(words, bands, rows), "doc_id long, n_shingles long, s1 long, s2 long, halves array<long>"), "features"
    )
    same = ["n_shingles", "s1", "s2"]
    # Equal sets are one content, whatever ids have it; links are sought between contents.
    content = F.xxhash64(*same)
    usable = features.where("n_shingles > 0 and doc_id is not null").withColumn("rep", content)
    contents = usable.groupBy("rep").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves"))
    contents = stage(contents, "contents")
    reps = contents.select("rep", "n_shingles", "halves")

    # Halves that only one document has can be in no shared table entry.
    halves = reps.select("rep", "n_shingles", F.posexplode("halves").alias("at", "h"))
    shared = halves.groupBy("at", "h").agg(F.count("*").alias("k")).where("k > 1").select("at", "h")
    shared = stage(shared, "shared")
    kept_halves = halves.join(shared.hint("merge"), ["at", "h"])
    pieces = kept_halves.groupBy("rep", "n_shingles").agg(F.collect_list(F.struct("at", "h")).alias("hs"))
    a_side = F.filter("hs", lambda x: x.at < bands)
    b_side = F.filter("hs", lambda x: x.at >= bands)
    keys = (
        pieces.select("rep", "n_shingles", F.explode(a_side).alias("x"), b_side.alias("ys"))
        .select("rep", "n_shingles", "x", F.explode("ys").alias("y"))
        .select("rep", "n_shingles", F.xxhash64("x.at", "x.h", "y.at", "y.h").alias("key"))
    )
    keys = stage(keys, "keys")
    entry = (
        keys.groupBy("key")
        .agg(
            F.count("*").alias("k"),
            F.min("rep").alias("leader"),
            F.max("rep").alias("top"),
            F.sum(F.shiftright(F.xxhash64("rep"), 16)).alias("sum1"),
            F.sum(F.shiftright(F.xxhash64(F.lit(7), "rep"), 16)).alias("sum2"),
        )
        .where("k > 1")
    )
    # Tables that hold the same members are kept once.
    entry = entry.groupBy("k", "leader", "top", "sum1", "sum2").agg(F.min("key").alias("key")).select("key", "leader")
    buckets = stage(keys.join(entry.hint("merge"), "key"), "buckets")

    pairs = buckets.where("rep != leader").select("leader", F.col("rep").alias("member")).distinct()
    members = buckets.select("rep").distinct()
    # The least id of a content gives its set, once; other texts of that id are in no pair.
    givers = contents.select("rep", "doc_id").join(members.hint("merge"), "rep", "left_semi").select("doc_id").distinct()
    given = slim.join(givers.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(words), "n_shingles long, s1 long, s2 long, items array<long>")
    sets = stage(given.select(content.alias("rep"), "items").groupBy("rep").agg(F.first("items").alias("items")), "sets")
    met = buckets.count()  # of all tables below that pair contents, none has more rows
    checked = stage(_verify(pairs, sets, met), "checked")
    is_link = F.col("common") * 10_000 >= F.col("total") * bar
    links = checked.where(is_link).select(F.col("leader").alias("a"), F.col("member").alias("b"))
    found = connected_components(links)

    rows = _open(buckets, found, sets, threshold, met)
    joined = found if rows.isEmpty() else _rejoined(rows, found, sets, threshold, met)
    joined = joined.withColumnRenamed("id", "rep")
    # Each component of contents goes by its least id; an id of several contents joins theirs.
    parts = contents.select("rep", "doc_id").join(joined.hint("merge"), "rep", "left").select("rep", "doc_id", F.coalesce("component", "rep").alias("c"))
    known = contents.count()
    parts = stage(parts, "parts", rows=known)
    names = stage(parts.groupBy("c").agg(F.min("doc_id").alias("name")), "names", rows=known)  # read anew, so that the join can split a large one
    named = stage(parts.join(names.hint("merge"), "c").select("rep", "name"), "named", rows=known)
    final = usable.select("doc_id", "rep").join(named.hint("merge"), "rep").select(F.col("doc_id").alias("a"), F.col("name").alias("b"))
    several = usable.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi")
    if several.isEmpty():
        final = final.select(F.col("a").alias("id"), F.col("b").alias("component")).distinct()
    else:
        final = connected_components(final)
    out = features.select("doc_id", "n_shingles").join(final.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _rejoined(rows: DataFrame, found: DataFrame, sets: DataFrame, threshold: float, most: int) -> DataFrame:
    """found with the components joined that links among rows (_open) join."""
    is_link = F.col("common") * 10_000 >= F.col("total") * round(threshold * 10_000)
    edges = lambda found: found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    for number in range(ROUNDS):
        fresh = stage(_led(_mixed(rows, found, most), number, most), "led", rows=most)
        if fresh.isEmpty():
            return found
        more = stage(_verify(fresh, sets, most), "checked").where(is_link).select(F.col("leader").alias("a"), F.col("member").alias("b"))
        if more.isEmpty():
            break
        found = stage(connected_components(edges(found).union(more)), "components", rows=most)
    again = stage(_residual(_mixed(rows, found, most), sets, threshold, most), "again")
    return found if again.isEmpty() else connected_components(edges(found).union(again))


def _open(buckets: DataFrame, found: DataFrame, sets: DataFrame, threshold: float, most: int) -> DataFrame:
    """(key, leader, rep, n_shingles) of the members of table entries that a link may join to another component there.

    A shingle that only one component has is in no link to another one, which bounds what a text can
    share outside its own; those that fall short are left out, and the bound is exact. It stays so
    when components grow.
    """
    low = threshold - 1e-9
    rows = stage(_mixed(buckets.select("key", "leader", "rep", "n_shingles"), found, most), "mixed", rows=most)
    docs = rows.select("rep", "n_shingles", "c").distinct()
    items = docs.join(sets.hint("merge"), "rep").select("rep", "n_shingles", "c", F.explode("items").alias("item"))
    several = items.groupBy("item").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("item")
    bound = (
        items.join(several.hint("merge"), "item")
        .groupBy("rep", "n_shingles")
        .agg(F.count("*").alias("common_most"))
        .where(F.col("common_most") >= F.col("n_shingles") * low)
        .select("rep")
    )
    return stage(rows.join(bound.hint("merge"), "rep").select("key", "leader", "rep", "n_shingles"), "open")


def _mixed(rows: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """rows (key, rep, ...) with their component c, of the entries that hold several components."""
    labelled = rows.join(found.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    labelled = stage(labelled, "labelled", rows=most)
    spread = stage(labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key"), "spread", rows=most)
    return labelled.join(spread.hint("merge"), "key")


def _led(mixed: DataFrame, number: int, most: int) -> DataFrame:
    """(leader, member): members outside the commonest component of their entry, and a member of that component, drawn anew each round."""
    drawn = F.xxhash64(F.lit(number), "rep")
    per = mixed.groupBy("key", "c").agg(F.count("*").alias("k"), F.min_by("rep", drawn).alias("lead"))
    major = per.groupBy("key").agg(F.max_by(F.struct("lead", "c"), F.struct("k", "c")).alias("m"))
    major = stage(major.select("key", F.col("m.lead").alias("lead"), F.col("m.c").alias("major")), "major", rows=most)
    return mixed.join(major.hint("merge"), "key").where("c != major").select(F.col("lead").alias("leader"), F.col("rep").alias("member")).distinct()


def _residual(mixed: DataFrame, sets: DataFrame, threshold: float, most: int) -> DataFrame:
    """Links (a, b) between different components among the members of one leader.

    All that ever met in a table entry share that entry's leader, so that members of one leader
    cover all candidates. All outside a leader's most common component (in blocks, held in memory as
    one) meet all its members (streamed), each block and slice of members in a group of its own.
    Blocks and slices are of about BLOCK and SLICE shingles, so that few texts are dealt twice.
    """
    left = stage(mixed.select("leader", "rep", "n_shingles", "c").distinct(), "left", rows=most)
    per = left.groupBy("leader", "c").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("n"))
    size = per.groupBy("leader").agg(F.sum("k").alias("m"), F.sum("n").alias("n"), F.max(F.struct("k", "c", "n")).alias("top")).where("m > top.k")
    size = stage(size.select("leader", "n", F.col("top.c").alias("major"), (F.col("n") - F.col("top.n")).alias("apart")), "size", rows=most)
    dealt = left.drop("n_shingles").join(size.hint("merge"), "leader").select(
        "leader", "rep", "c", (F.col("c") != F.col("major")).alias("outside"), F.ceil(F.col("apart") / BLOCK).alias("blocks"), F.ceil(F.col("n") / SLICE).alias("slices")
    )
    dealt = stage(dealt, "dealt", rows=most)
    held = dealt.where("outside").select(
        "leader", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("head"), "rep", "c"
    )
    streamed = dealt.select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(1), "rep"), "slices").alias("slice"), F.lit(1).alias("head"), "rep", "c"
    )
    return (
        held.union(streamed)
        .join(sets.hint("merge"), "rep")
        .select("leader", "block", "slice", "head", "rep", "c", "items")
        .repartition("leader", "block", "slice")
        .sortWithinPartitions("leader", "block", "slice", "head", "rep")
        .mapInArrow(_meet(threshold), "a long, b long")
    )


def _meet(threshold: float):
    bar = round(threshold * 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, index = None, [], None
        for batch in batches:
            keys = [tuple(x) for x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            heads, reps, comps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            offsets, values = batch.column(6).offsets.to_numpy(), batch.column(6).values.to_numpy().view(U64)
            out = []
            for i, key in enumerate(keys):
                mine = values[offsets[i] : offsets[i + 1]]
                if key != group:
                    group, block, index = key, [], None
                if heads[i] == 0:
                    block.append((reps[i], comps[i], mine.copy()))
                    continue
                if not block and index is None:
                    continue
                if index is None:  # the block's shingles in order, each with the number of its text
                    sizes = np.array([len(x[2]) for x in block])
                    flat = np.concatenate([x[2] for x in block])
                    order = np.argsort(flat, kind="stable")
                    index = (flat[order], np.repeat(np.arange(len(block)), sizes)[order], sizes, np.array([x[0] for x in block]), np.array([x[1] for x in block]))
                    block = []
                flat, owners, sizes, names, parts = index
                start, end = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                many = end - start
                at = np.arange(many.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
                common = np.bincount(owners[at], minlength=len(sizes))
                linked = (common * 10_000 >= (sizes + len(mine) - common) * bar) & (parts != comps[i])
                out += [(names[j], reps[i]) for j in np.flatnonzero(linked)]
            columns = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "b"])

    return run

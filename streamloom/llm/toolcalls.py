"""Tool-call linking for chat records, in DataFrame operations only.

Calls and results meet in a hash join by conversation, call identifier and turn among equal
identifiers; calls are put in topological order of the calls they depend on; arguments are
validated against field schemas; and every record is written as canonical JSON: keys sorted, no
white space, absent fields left out, and one text for equal numbers, however they are written and
whatever their size. No conversation is gathered into one row: records carry their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.session import ready, stage

#: JSON kinds that a schema may name, and what the kind of a parsed value must match.
_KINDS = {"string": "^STRING$", "integer": "^INTEGER$", "number": "^(INTEGER|NUMBER)$", "boolean": "^BOOLEAN$", "array": "^ARRAY.*$", "object": "^OBJECT.*$"}
#: Marks of a number, and of a string that starts with this control character itself, while JSON is parsed.
_NUMBER, _STRING = r"\u0001n", r"\u0001s"
_TOKEN = r"^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][-+]?[0-9]+)?$"


def json_text(value: Column) -> Column:
    """A string as a JSON string; null stays null."""
    wrapped = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(wrapped, F.lit(2), F.char_length(wrapped) - 2))


def canonical_number(token: Column) -> Column:
    """The one text of a JSON number: digits as they are, without sign, zeros or exponent that aren't needed.

    Plain digits where the point lies within or near them (whole numbers of up to 21 digits, at most
    five zeros behind the point), else one digit before the point and an exponent. Digits are never
    rounded, and only whole numbers have a positive exponent.
    """
    parts = F.split(F.lower(F.regexp_replace(token, "^-", "")), "e")
    mantissa = F.split(parts[0], "[.]")
    fraction = F.when(F.size(mantissa) > 1, F.get(mantissa, F.lit(1))).otherwise("")
    power = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("long")).otherwise(F.lit(0).cast("long"))
    digits = F.regexp_replace(F.concat(mantissa[0], fraction), "^0+", "")
    bare = F.regexp_replace(digits, "0+$", "")
    n = F.char_length(bare).cast("long")
    point = power - F.char_length(fraction) + F.char_length(digits)  # digits of bare before the point
    whole = F.concat(bare, F.repeat(F.lit("0"), (point - n).try_cast("int")))
    split = F.concat(F.substring(bare, F.lit(1), point.try_cast("int")), F.lit("."), F.substring(bare, (point + 1).try_cast("int"), n.try_cast("int")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), (-point).try_cast("int")), bare)
    tail = F.when(n > 1, F.concat(F.lit("."), F.substring(bare, F.lit(2), n.try_cast("int")))).otherwise("")
    science = F.concat(F.substring(bare, 1, 1), tail, F.lit("e"), F.when(point > 0, "+").otherwise(""), (point - 1).cast("string"))
    text = (
        F.when(point.isNull(), F.lower(token))  # an exponent beyond 64 bits
        .when((point >= n) & (point <= 21), whole)
        .when((point > 0) & (point < n), split)
        .when((point > -6) & (point <= 0), small)
        .otherwise(science)
    )
    return F.when(bare == "", F.lit("0")).otherwise(F.concat(F.when(token.startswith("-"), "-").otherwise(""), text))


def _marked(text: Column) -> Column:
    """JSON text with every number as a marked string of its canonical text, so that parsing keeps it."""
    hidden = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x02")), F.lit('\\"'), F.lit("\x03"))

    def outside(part: Column) -> Column:
        tokens = F.regexp_extract_all(part, F.lit("[-+0-9.eE]+|[^-+0-9.eE]+"), F.lit(0))
        return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(_TOKEN), F.concat(F.lit(f'"{_NUMBER}'), canonical_number(t), F.lit('"'))).otherwise(t)), "")

    def inside(part: Column) -> Column:
        return F.when(part.startswith(r"\u0001"), F.concat(F.lit(_STRING), part)).otherwise(part)

    parts = F.transform(F.split(hidden, '"', -1), lambda p, i: F.when(i % 2 == 1, inside(p)).otherwise(outside(p)))
    shown = F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x03"), F.lit('\\"')), F.lit("\x02"), F.lit("\\\\"))
    return F.when(~text.rlike("[\\x00-\\x03]"), shown)


def _unmarked(text: Column) -> Column:
    """Canonical JSON of what _marked gave, parsed and written again."""
    numbers = F.regexp_replace(text, r'(?<!\\)"\\u0001n([^"]*)"', "$1")
    return F.regexp_replace(numbers, r'(?<!\\)"\\u0001s', '"')


def _parsed(text: Column) -> Column:
    """The variant of JSON text with marked numbers; null for what is no JSON.

    The parser stops behind the first value, so the text is parsed as the first of two elements.
    """
    both = F.try_parse_json(F.concat(F.lit("["), _marked(text), F.lit(r',"\u0001e"]'))).cast("array<variant>")
    whole = (F.size(both) == 2) & F.coalesce(F.try_variant_get(F.get(both, F.lit(1)), "$", "string") == "\x01e", F.lit(False))
    return F.when(whole, F.get(both, F.lit(0)))


def canonical_json(text: Column) -> Column:
    """JSON text in canonical form: keys sorted, no white space, equal numbers alike; null for what is no JSON."""
    return _unmarked(F.to_json(_parsed(text)))


def _kind(value: str) -> str:
    """SQL of the kind of a parsed value: INTEGER, NUMBER, or what the schema of a variant says."""
    text = f"variant_get({value}, '$', 'string')"
    number = f"schema_of_variant({value}) = 'STRING' and startswith({text}, '\\u0001n')"
    return f"case when {number} then if({text} rlike '^[^.]*$|e[+]' and instr({text}, 'e-') = 0, 'INTEGER', 'NUMBER') else schema_of_variant({value}) end"


def _jumps(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, to, dist, open) of calls (conv_id, call_id, to) with one dependency each.

    to is where the chain of single dependencies ends, dist steps away. Every round doubles the
    steps, so that a chain of n calls takes log2(n) rounds; chains that are open after that many
    rounds run into a cycle.
    """
    ends = single.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("open"))
    now = single.withColumn("dist", F.lit(1).cast("long")).join(ends.hint("merge"), ["conv_id", "to"], "left")
    now = stage(now.select("conv_id", "call_id", "to", "dist", F.coalesce("open", F.lit(False)).alias("open")), "jumps")
    longest = now.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length()):
        on = now.where("open")
        if on.isEmpty():
            break
        there = now.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"), F.col("open").alias("goes_on"))
        moved = on.drop("open").join(there.hint("merge"), ["conv_id", "to"]).select(
            "conv_id", "call_id", F.col("next").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), F.col("goes_on").alias("open")
        )
        now = stage(now.where("not open").union(moved), "jumps")
    return now


def _joint_levels(joints: DataFrame, done: DataFrame) -> DataFrame:
    """done (conv_id, call_id, level) with the calls of joints (conv_id, call_id, to, steps) added.

    A call's level is the highest of steps + the level of to. One round for each level of calls
    that depend on several; those that reach a cycle never come up.
    """
    waiting, fresh = stage(joints.withColumn("got", F.lit(None).cast("long")), "waiting"), done
    while not waiting.isEmpty():
        met = fresh.select("conv_id", F.col("call_id").alias("to"), "level")
        met = stage(
            waiting.join(met.hint("merge"), ["conv_id", "to"], "left").select("conv_id", "call_id", "to", "steps", F.coalesce("got", F.col("steps") + F.col("level")).alias("got")), "met"
        )
        per = met.groupBy("conv_id", "call_id").agg(F.max("got").alias("level"), (F.count("got") == F.count("*")).alias("whole"))
        fresh = stage(per.where("whole").drop("whole"), "level")
        if fresh.isEmpty():
            break
        waiting = stage(met.join(fresh.select("conv_id", "call_id").hint("merge"), ["conv_id", "call_id"], "left_anti"), "waiting")
        done = stage(done.union(fresh), "levels")
    return done


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, depends_on).

    A call with no known dependency has level 0, any other one more than the highest that it
    depends on. Calls in or behind a cycle have no row; nor have those without a conversation or
    an identifier. Unknown identifiers are no dependencies. Chains of single dependencies are
    followed by doubling, whatever their length; calls that depend on several wait for each other
    a level at a time.
    """
    known = calls.select("conv_id", "call_id").where("conv_id is not null and call_id is not null").distinct()
    edges = calls.select("conv_id", "call_id", F.explode("depends_on").alias("dep")).where("call_id is not null").distinct()
    edges = stage(edges.join(known.withColumnRenamed("call_id", "dep").hint("merge"), ["conv_id", "dep"], "left_semi"), "edges")
    degree = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("dep").alias("to"))
    jumps = _jumps(degree.where("n = 1").drop("n"))
    done = stage(known.join(degree.hint("merge"), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    several = stage(degree.where("n > 1").select("conv_id", "call_id"), "joints")
    if not several.isEmpty():
        ends = jumps.select("conv_id", F.col("call_id").alias("dep"), "to", "dist")
        joints = edges.join(several.hint("merge"), ["conv_id", "call_id"], "left_semi").join(ends.hint("merge"), ["conv_id", "dep"], "left")
        done = _joint_levels(joints.select("conv_id", "call_id", F.coalesce("to", "dep").alias("to"), (F.coalesce("dist", F.lit(0)) + 1).alias("steps")), done)
    behind = jumps.join(done.select("conv_id", F.col("call_id").alias("to"), "level").hint("merge"), ["conv_id", "to"])
    return done.union(behind.select("conv_id", "call_id", F.col("dist") + F.col("level")))


def _turns(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with occ added: 1, 2, ... in the given order among rows of one conversation and identifier.

    Identifiers that come once are not sorted. The others are dealt out by range of identifier and
    order, so that one of very many rows is numbered by many tasks; a task's numbers go on from
    the counts of the tasks before it.
    """
    key = ["conv_id", "call_id"]
    several = stage(rows.groupBy(*key).agg(F.count("*").alias("_k")).where("_k > 1").drop("_k"), "repeated")
    once = rows.join(several.hint("merge"), key, "left_anti").withColumn("occ", F.lit(1).cast("long"))
    sort = [F.col(c).asc_nulls_last() for c in (*key, *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(rows.join(several.hint("merge"), key, "left_semi").repartitionByRange(parts, *sort).withColumn("_pid", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("_pid", *key).agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.partitionBy(*key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stage(counts.select("_pid", *key, F.coalesce(before, F.lit(0)).alias("_before")), "offsets")
    inside = Window.partitionBy("_pid", *key).orderBy(*sort)
    found = dealt.withColumn("_n", F.row_number().over(inside)).join(offsets.hint("merge"), ["_pid", *key])
    return once.unionByName(found.withColumn("occ", (F.col("_n") + F.col("_before")).cast("long")).drop("_pid", "_n", "_before"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, result_turn, level, status, record) of every call and stray result.

    calls: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of call ids, may
    be null). results: conv_id, turn, call_id, content. schemas: name, field, kind (string,
    integer, number, boolean, array, object), required; field names of one name must differ.

    status is the first that applies of: no_id (no conversation or no call id), no_call (a result
    without its call), bad_json (arguments that are no JSON object), no_schema, missing_field,
    wrong_kind, unknown_field, cycle, no_result, ok. Of repeated calls and results with one
    identifier the i-th call by turn (null last; ties by name, arguments, content) has the i-th
    result; those left over are no_result or no_call. An integer is a number without a fraction,
    whatever its size or form. record is canonical JSON; arguments that don't parse are written as
    a JSON string. Empty tables are fine on any side; other columns are ignored.
    """
    ready(calls.sparkSession)
    c = calls.select("conv_id", "turn", "call_id", "name", "arguments")
    c = c.withColumn("parsed", _parsed(F.col("arguments")))
    is_object = F.expr("coalesce(schema_of_variant(parsed) like 'OBJECT%', false)")
    c = c.withColumn("fine", is_object).withColumn("fields", F.expr("if(fine, cast(parsed as map<string,variant>), cast(map() as map<string,variant>))"))
    per = schemas.groupBy("name").agg(F.collect_list(F.struct("field", "kind", "required")).alias("spec"))
    c = c.join(per, "name", "left")
    matches = " when ".join(f"f.kind = '{k}' then {_kind('fields[f.field]')} rlike '{p}'" for k, p in _KINDS.items())
    c = c.withColumn("missing", F.expr("exists(spec, f -> f.required and not array_contains(map_keys(fields), f.field))"))
    c = c.withColumn("wrong", F.expr(f"exists(spec, f -> array_contains(map_keys(fields), f.field) and not (case when {matches} else false end))"))
    c = c.withColumn("strange", F.expr("exists(map_keys(fields), k -> not exists(spec, f -> f.field = k))"))
    written = F.when(F.col("fine"), _unmarked(F.to_json("parsed"))).when(F.col("arguments").isNotNull(), json_text(F.col("arguments")))
    c = c.select("conv_id", "call_id", "turn", "name", "fine", "missing", "wrong", "strange", F.col("spec").isNotNull().alias("known"), written.alias("args"), F.lit(True).alias("is_call"))
    c = stage(c, "calls")
    r = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(True).alias("is_result"))
    named = "conv_id is not null and call_id is not null"
    known = _turns(c.where(named), ["turn", "name", "args"]).join(levels(calls).hint("merge"), ["conv_id", "call_id"], "left")
    met = known.join(_turns(r.where(named), ["result_turn", "content"]).hint("shuffle_merge"), ["conv_id", "call_id", "occ"], "full_outer").drop("occ")
    # Rows without an identifier are linked with nothing, and meet in no join.
    both = met.unionByName(c.where(f"not ({named})"), allowMissingColumns=True).unionByName(r.where(f"not ({named})"), allowMissingColumns=True)
    status = (
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no_id")
        .when(F.col("is_call").isNull(), "no_call")
        .when(~F.col("fine"), "bad_json")
        .when(~F.col("known"), "no_schema")
        .when(F.col("missing"), "missing_field")
        .when(F.col("wrong"), "wrong_kind")
        .when(F.col("strange"), "unknown_field")
        .when(F.col("level").isNull(), "cycle")
        .when(F.col("is_result").isNull(), "no_result")
        .otherwise("ok")
    )
    both = both.withColumn("status", status)
    return both.select("conv_id", "call_id", "turn", "result_turn", "level", "status", record(
        [("arguments", F.col("args")), ("content", json_text(F.col("content"))), ("id", json_text(F.col("call_id"))), ("name", json_text(F.col("name"))), ("status", json_text(F.col("status")))]
    ).alias("record"))


def record(fields: list[tuple[str, Column]]) -> Column:
    """A JSON object of fields that are JSON text already, null ones left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

"""Registered queries over the driver's tables, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from streamloom.functions.predicates import all_of, any_of, compare
from streamloom.functions.text import parse_delimited
from streamloom.operators.cep import ANY, RELAXED, STRICT, Pattern
from streamloom.operators.stream import Stream
from streamloom.operators.windows import CountWindow, SessionWindow, TimeWindow
from streamloom.plans.builders import CepQuery, RuleQuery, TextInput
from streamloom.plans.rules import Action, Condition, stateful_rules, stateless_rules
from streamloom.session import ready, table
from streamloom.streaming.watermark import drop_late, punctuated

DAY = 86_400_000
QUERIES: dict = {}
ORACLE: dict = {}

_E = "e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS cents FROM events)"


def query(sql: str):
    """Register a query under its name with its SQL; e there is the events table as below."""

    def add(function):
        QUERIES[function.__name__] = function
        ORACLE[function.__name__] = f"WITH RECURSIVE {_E}{sql}" if sql.lstrip().startswith(",") else f"WITH {_E} {sql}"
        return function

    return add


def epoch_ms(df: DataFrame, column: str = "ts") -> Column:
    """Milliseconds since 1970 of a time, whatever zone the session has."""
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        day, rest = f"unix_date(cast({column} as date)) * 86400000L", f"(hour({column}) * 3600 + minute({column}) * 60) * 1000L + cast(floor(extract(second from {column}) * 1000) as bigint)"
        return F.expr(f"{day} + {rest}")
    return F.expr(f"unix_millis({column})")


def events(spark: SparkSession, sf_dir: str) -> Stream:
    """Events as (ts ms, seq, user_id, event_type, cents); times without a zone are read as UTC."""
    ready(spark)
    df = table(spark, sf_dir, "events")
    return Stream(
        df.select(
            epoch_ms(df).alias("ts"),
            F.col("event_id").alias("seq"),
            "user_id",
            "event_type",
            F.floor(F.col("value") * 100).cast("bigint").alias("cents"),
        )
    )


def _is(kind: str):
    return F.col("event_type") == kind


@query("SELECT event_id, upper(event_type) AS kind, cents * 2 AS twice FROM e WHERE event_type = 'purchase'")
def filter_map(spark, sf_dir) -> DataFrame:
    s = events(spark, sf_dir).filter(_is("purchase"))
    return s.map(kind=F.upper("event_type"), twice=F.col("cents") * 2).df.select(F.col("seq").alias("event_id"), "kind", "twice")


@query(", w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word")
def flat_map_words(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ts"), F.col("doc_id").alias("seq"), "text")
    return Stream(docs).flat_map(word=F.split("text", " ")).df.groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN cents > 20000 THEN 1 WHEN cents > 5000 THEN 2 WHEN event_type = 'view' THEN 3 END AS branch FROM e WHERE cents > 5000 OR event_type = 'view'")
def route_if(spark, sf_dir) -> DataFrame:
    s = events(spark, sf_dir).routed(F.col("cents") > 20000, F.col("cents") > 5000, _is("view"))
    return s.df.select(F.col("seq").alias("event_id"), "branch")


@query("SELECT event_id, cents FROM e WHERE event_type = 'purchase' UNION ALL SELECT event_id, cents FROM e WHERE cents > 5000")
def union_streams(spark, sf_dir) -> DataFrame:
    s = events(spark, sf_dir)
    return s.filter(_is("purchase")).union(s.filter(F.col("cents") > 5000)).df.select(F.col("seq").alias("event_id"), "cents")


@query("SELECT event_id FROM e WHERE (event_type = 'purchase' AND cents >= 1000) OR NOT event_type <> 'error' OR cents < 100")
def predicates(spark, sf_dir) -> DataFrame:
    s = events(spark, sf_dir)
    p = lambda f, op, v: compare(s.df, f, op, v)
    wanted = any_of(all_of(p("event_type", "EQ", "purchase"), p("cents", "GE", 1000)), ~p("event_type", "NEQ", "error"), p("cents", "LT", 100))
    return s.filter(wanted).df.select(F.col("seq").alias("event_id"))


@query("SELECT event_id, user_id, sum(cents) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cents FROM e")
def reduce_by_key_running(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).reduce_by_key("user_id", "cents").select(F.col("seq").alias("event_id"), "user_id", "cents")


@query("SELECT user_id, sum(cents)::BIGINT AS cents FROM e GROUP BY user_id")
def reduce_by_key_final(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).reduce_by_key("user_id", "cents", mode="final")


@query("SELECT event_id, max(cents) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS result FROM e")
def apply_stateful_max(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).running("cents", "max", key_by="user_id").select(F.col("seq").alias("event_id"), "result")


class _Spread:
    """Difference of the largest and smallest amounts so far."""

    columns = ("cents",)

    def initialize(self):
        return None

    def update(self, state, row):
        low, high = state or (row["cents"], row["cents"])
        return min(low, row["cents"]), max(high, row["cents"])

    def produce(self, state):
        return state[1] - state[0]


@query("SELECT event_id, max(cents) OVER w - min(cents) OVER w AS result FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)")
def apply_stateful_custom(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).apply_stateful(_Spread(), "long", key_by="user_id").select(F.col("seq").alias("event_id"), "result")


def _windows(point: str, first: str, last: str, size: int, interval: int, closed: str, key: str = "") -> str:
    """SQL with x: e's rows once for each closed window that holds them.

    Windows are listed one by one from their definition, and rows looked up in them by their bounds.
    """
    part, keys, same = (f"PARTITION BY {key}", f"{key}, ", f" AND b.{key} = w.{key}") if key else ("", "", "")
    start, end = (f"greatest({first}, {first} + j * {interval} - {size})", f"{first} + j * {interval} - 1") if interval <= size else (f"{first} + j * {interval}", f"{first} + j * {interval} + {size} - 1")
    return f""", b AS (SELECT *, row_number() OVER ({part} ORDER BY ms, event_id) AS n, min(ms) OVER ({part}) AS t0, max(ms) OVER ({part}) AS t1, count(*) OVER ({part}) AS k FROM e),
      a AS (SELECT {keys}min({first}) AS z, max({last}) AS l FROM b {f"GROUP BY {key}" if key else ""}),
      w AS (SELECT {keys}{start.replace(first, "z")} AS win_start, {end.replace(first, "z")} AS win_end FROM (SELECT *, unnest(range({int(interval <= size)}, (l - z + {size}) // {interval} + 2)) AS j FROM a) WHERE {end.replace(first, "z")} {closed} l),
      x AS (SELECT b.*, win_start, win_end FROM b JOIN w ON b.{point} >= w.win_start AND b.{point} <= w.win_end{same})"""


def _counted(s, spec) -> DataFrame:
    return s.window(spec).summarise(n_rows="count", cents=("sum", "cents"))


_SUMS = " SELECT win_start, win_end, count(*) AS n_rows, sum(cents)::BIGINT AS cents FROM x GROUP BY 1, 2"


@query(_windows("ms", "t0", "t1", DAY, DAY, "<") + _SUMS)
def time_window_tumbling(spark, sf_dir) -> DataFrame:
    return _counted(events(spark, sf_dir), TimeWindow(DAY, DAY))


@query(_windows("ms", "t0", "t1", DAY, DAY // 4, "<") + _SUMS)
def time_window_sliding(spark, sf_dir) -> DataFrame:
    return _counted(events(spark, sf_dir), TimeWindow(DAY, DAY // 4))


@query(_windows("ms", "t0", "t1", DAY // 4, DAY, "<") + _SUMS)
def time_window_hopping(spark, sf_dir) -> DataFrame:
    return _counted(events(spark, sf_dir), TimeWindow(DAY // 4, DAY))


@query(_windows("n", "1::BIGINT", "k", 50, 50, "<=") + _SUMS)
def count_window_tumbling(spark, sf_dir) -> DataFrame:
    return _counted(events(spark, sf_dir), CountWindow(50, 50))


@query(_windows("n", "1::BIGINT", "k", 50, 30, "<=") + _SUMS)
def count_window_sliding(spark, sf_dir) -> DataFrame:
    return _counted(events(spark, sf_dir), CountWindow(50, 30))


@query(_windows("n", "1::BIGINT", "k", 30, 50, "<=") + _SUMS)
def count_window_hopping(spark, sf_dir) -> DataFrame:
    return _counted(events(spark, sf_dir), CountWindow(30, 50))


_GAP = 6 * 3_600_000


def _session_sql(key: str) -> str:
    part, keys = (f"PARTITION BY {key} ", f"{key}, ") if key else ("", "")
    return f""", g AS (SELECT *, CASE WHEN ms - lag(ms) OVER ({part}ORDER BY ms, event_id) > {_GAP} THEN 1 ELSE 0 END AS f FROM e),
      h AS (SELECT *, sum(f) OVER ({part}ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g), t AS (SELECT *, max(s) OVER ({part}) AS top FROM h)
      SELECT {keys}min(ms) AS win_start, max(ms) AS win_end, count(*) AS n_rows FROM t WHERE s < top GROUP BY {keys}s"""


@query(_session_sql("user_id"))
def session_window_user(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).window(SessionWindow(_GAP), key_by="user_id").summarise(n_rows="count")


@query(_session_sql("").replace(str(_GAP), str(_GAP // 36)))
def session_window_global(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).window(SessionWindow(_GAP // 36)).summarise(n_rows="count")


@query(
    _windows("ms", "t0", "t1", DAY, DAY // 2, "<").replace("FROM e)", "FROM e WHERE event_type IN ('purchase', 'error'))", 1)
    + """ SELECT p.win_start, p.win_end, p.event_id AS purchase, q.event_id AS error FROM x p JOIN x q ON p.win_start = q.win_start AND p.win_end = q.win_end
      AND p.user_id = q.user_id AND p.cents > q.cents WHERE p.event_type = 'purchase' AND q.event_type = 'error'"""
)
def window_join_purchase_error(spark, sf_dir) -> DataFrame:
    s = events(spark, sf_dir)
    found = s.filter(_is("purchase")).join(s.filter(_is("error")), lambda a, b: (a("user_id") == b("user_id")) & (a("cents") > b("cents")), TimeWindow(DAY, DAY // 2))
    return found.select("win_start", "win_end", F.col("l_seq").alias("purchase"), F.col("r_seq").alias("error"))


@query(_windows("ms", "t0", "t1", DAY, DAY // 2, "<") + " SELECT win_start, win_end, user_id, sum(cents)::BIGINT AS cents FROM x GROUP BY 1, 2, 3")
def reduce_by_key_window(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).window(TimeWindow(DAY, DAY // 2)).reduce_by_key_window("user_id", "cents")


@query(_windows("ms", "t0", "t1", DAY, DAY, "<") + " SELECT win_start, win_end, max(cents) - min(cents) AS result FROM x GROUP BY 1, 2")
def apply_stateful_window(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).window(TimeWindow(DAY, DAY)).apply_stateful_window(_Spread(), "long")


@query(_windows("n", "1::BIGINT", "k", 20, 20, "<=") + " SELECT win_start, win_end, list(event_id ORDER BY ms, event_id)::VARCHAR AS data, max(ms) AS ts FROM x GROUP BY 1, 2")
def window_collect(spark, sf_dir) -> DataFrame:
    out = events(spark, sf_dir).window(CountWindow(20, 20)).collect("seq")
    return out.select("win_start", "win_end", F.concat(F.lit("["), F.concat_ws(", ", F.col("data").cast("array<string>")), F.lit("]")).alias("data"), "ts")


_MACHINE = """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS rn FROM e),
  m(user_id, rn, event_id, state) AS (
    SELECT user_id, 0::BIGINT, NULL::BIGINT, 'idle' FROM o WHERE rn = 1
    UNION ALL SELECT m.user_id, o.rn, o.event_id, CASE
      WHEN m.state = 'idle' AND o.event_type = 'view' THEN 'seen'
      WHEN m.state = 'seen' AND o.event_type = 'purchase' THEN 'bought'
      WHEN m.state = 'seen' AND o.event_type = 'error' THEN 'idle'
      WHEN m.state = 'bought' AND o.cents < 2000 THEN 'idle' ELSE m.state END
    FROM m JOIN o ON o.user_id = m.user_id AND o.rn = m.rn + 1)"""


@query(_MACHINE + " SELECT event_id, user_id, state FROM m WHERE event_id IS NOT NULL AND state IN ('bought', 'seen')")
def state_transition(spark, sf_dir) -> DataFrame:
    moves = {"idle": [(_is("view"), "seen")], "seen": [(_is("purchase"), "bought"), (_is("error"), "idle")], "bought": [(F.col("cents") < 2000, "idle")]}
    out = events(spark, sf_dir).state_transition("idle", {"bought", "seen"}, moves, key_by="user_id")
    return out.select(F.col("seq").alias("event_id"), "user_id", "state")


@query(_MACHINE + " SELECT m.event_id, state, 'user ' || m.user_id || ' is ' || CASE state WHEN 'bought' THEN 'buying at ' || e.cents ELSE 'looking' END AS message FROM m JOIN e ON e.event_id = m.event_id WHERE state IN ('bought', 'seen')")
def rule_stateful_alarm(spark, sf_dir) -> DataFrame:
    moves = [
        ("idle", Condition("EQ", "event_type", "view"), "seen"),
        ("seen", Condition("EQ", "event_type", "purchase"), "bought"),
        ("seen", Condition("EQ", "event_type", "error"), "idle"),
        ("bought", Condition("LT", "cents", 2000), "idle"),
    ]
    actions = {"bought": Action(("user $user_id is", "buying at $cents"), " "), "seen": Action(("user $user_id is", "looking"), " ")}
    out = stateful_rules(events(spark, sf_dir).df, "idle", moves, actions, key_by="user_id")
    return out.select(F.col("seq").alias("event_id"), "state", "message")


@query("""SELECT event_id, 1 AS rule, 'high,' || user_id || ',' || cents AS message FROM e WHERE cents > 10000 AND event_type = 'purchase'
  UNION ALL SELECT event_id, 2, 'odd,' || event_type FROM e WHERE event_type = 'error' OR cents < 200""")
def rule_stateless_alarm(spark, sf_dir) -> DataFrame:
    rules = [
        (Condition("AND", parts=(Condition("GT", "cents", 10000), Condition("EQ", "event_type", "purchase"))), Action(("high", "$user_id", "$cents"))),
        (Condition("OR", parts=(Condition("EQ", "event_type", "error"), Condition("LT", "cents", 200))), Action(("odd", "$event_type"))),
    ]
    return stateless_rules(events(spark, sf_dir).df, rules).select(F.col("seq").alias("event_id"), "rule", "message")


@query(", r AS (SELECT *, lead(event_id) OVER w AS b, lead(event_type) OVER w AS bt, lead(ms) OVER w AS bm FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)) SELECT event_id AS a, b FROM r WHERE event_type = 'view' AND bt = 'purchase' AND bm - ms <= 86400000")
def cep_strict_pair(spark, sf_dir) -> DataFrame:
    return _pairs(spark, sf_dir, STRICT)


@query("SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND (b.ms, b.event_id) > (a.ms, a.event_id) AND b.ms - a.ms <= 86400000 WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def cep_ndr_pair(spark, sf_dir) -> DataFrame:
    return _pairs(spark, sf_dir, ANY)


@query("SELECT a.event_id AS a, min_by(b.event_id, (b.ms, b.event_id)) AS b FROM e a JOIN e b ON a.user_id = b.user_id AND (b.ms, b.event_id) > (a.ms, a.event_id) AND b.ms - a.ms <= 86400000 WHERE a.event_type = 'view' AND b.event_type = 'purchase' GROUP BY a.event_id")
def cep_relaxed_pair(spark, sf_dir) -> DataFrame:
    return _pairs(spark, sf_dir, RELAXED)


def _pairs(spark, sf_dir, contiguity: str) -> DataFrame:
    patterns = [Pattern("look", _is("view")), Pattern("buy", _is("purchase"), contiguity)]
    found = events(spark, sf_dir).cep(patterns, DAY, key_by="user_id")
    return found.select(F.col("events")[0].alias("a"), F.col("events")[1].alias("b"))


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM e),
  i AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS island FROM r WHERE event_type = 'view')
  SELECT a.event_id AS a, b.event_id AS b, b.n - a.n + 1 AS n_rows FROM i a JOIN i b ON a.user_id = b.user_id AND a.island = b.island AND b.n > a.n AND b.ms - a.ms <= 864000000""")
def cep_times_loop(spark, sf_dir) -> DataFrame:
    found = events(spark, sf_dir).cep([Pattern("look", _is("view")).at_least(2).within_loop(STRICT)], 10 * DAY, key_by="user_id")
    n = F.size("events")
    return found.select(F.col("events")[0].alias("a"), F.element_at("events", n).alias("b"), n.cast("long").alias("n_rows"))


@query("SELECT event_id, trim(split_part(event_type || ' ; ' || cents, ';', 1)) AS kind, cents AS amount FROM e")
def parse_text(spark, sf_dir) -> DataFrame:
    s = events(spark, sf_dir).df.select("seq", F.concat("event_type", F.lit(" ; "), F.col("cents").cast("string")).alias("line"))
    return parse_delimited(s, "line", [("kind", "STRING"), ("amount", "LONG")], ";").select(F.col("seq").alias("event_id"), "kind", "amount")


@query(""", a AS (SELECT *, (event_id * 7919) % 100 + event_id AS arrival FROM e),
  w AS (SELECT *, max(CASE WHEN event_type = 'error' THEN ms END) OVER (ORDER BY arrival * 1000000000 + event_id ROWS UNBOUNDED PRECEDING) AS watermark FROM a)
  SELECT event_id, watermark FROM w WHERE event_type <> 'error' AND (watermark IS NULL OR ms > watermark)""")
def punctuated_late_drop(spark, sf_dir) -> DataFrame:
    arrival = ((F.col("seq") * 7919) % 100 + F.col("seq")) * 1_000_000_000 + F.col("seq")
    s = events(spark, sf_dir).df.withColumn("event_id", F.col("seq")).withColumn("seq", arrival)
    return punctuated(s, _is("error"), F.col("ts")).select("event_id", "watermark")


@query(""" SELECT row_number() OVER (ORDER BY ms, side, event_id) AS place, event_id, cents FROM (
  SELECT *, 0 AS side FROM e WHERE event_type = 'error' UNION ALL SELECT *, 1 FROM e WHERE cents > 5000)""")
def union_ordered(spark, sf_dir) -> DataFrame:
    s = Stream(events(spark, sf_dir).df.withColumn("event_id", F.col("seq")))
    both = s.filter(_is("error")).union(s.filter(F.col("cents") > 5000), ordered=True)
    return both.df.select(F.col("seq").alias("place"), "event_id", "cents")


@query(" SELECT event_id, event_type || '/' || (cents % 7) AS kind, cents // 7 AS part FROM e")
def map_function(spark, sf_dir) -> DataFrame:
    s = events(spark, sf_dir).map(lambda row: {"kind": f"{row['event_type']}/{row['cents'] % 7}", "part": row["cents"] // 7}, "kind string, part long")
    return s.df.select(F.col("seq").alias("event_id"), "kind", "part")


@query(" SELECT event_id, unnest(range(0, cents % 4)) AS i FROM e")
def flat_map_function(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).flat_map(lambda row: list(range(row["cents"] % 4)), "i long").df.select(F.col("seq").alias("event_id"), "i")


@query(" SELECT event_id FROM e WHERE length(event_type) % 2 = 0 AND cents % 3 = 1")
def filter_function(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).filter(lambda row: len(row["event_type"]) % 2 == 0 and row["cents"] % 3 == 1).df.select(F.col("seq").alias("event_id"))


def _fold(a: int, b: int) -> int:
    """A reduction that depends on the order."""
    return (a * 31 + b) % 1_000_003


_FOLDED = "list_reduce(list(cents ORDER BY ms, event_id), lambda a, b: (a * 31 + b) % 1000003)::BIGINT AS cents"


@query(f" SELECT user_id, {_FOLDED} FROM e GROUP BY user_id")
def reduce_by_key_function(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).reduce_by_key("user_id", "cents", _fold, mode="final")


@query(_windows("ms", "t0", "t1", DAY, DAY // 2, "<") + f" SELECT win_start, win_end, event_type, {_FOLDED} FROM x GROUP BY 1, 2, 3")
def reduce_by_key_window_function(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).window(TimeWindow(DAY, DAY // 2)).reduce_by_key_window("event_type", "cents", _fold)


@query(_windows("n", "1::BIGINT", "k", 40, 25, "<=") + """ SELECT win_start, win_end, max(ms) AS ts,
  win_start || '-' || win_end || ': ' || arg_min(event_type, (ms, event_id)) || ' to ' || arg_max(event_type, (ms, event_id)) || ', ' || count(*) AS result FROM x GROUP BY 1, 2""")
def aggregate_window_function(spark, sf_dir) -> DataFrame:
    tell = lambda a, b, data: f"{a}-{b}: {data[0]['event_type']} to {data[-1]['event_type']}, {len(data)}"
    return events(spark, sf_dir).window(CountWindow(40, 25)).aggregate_function(tell, "string", "event_type")


@query(_windows("ms", "t0", "t1", DAY, DAY // 4, "<", "user_id") + " SELECT win_start, win_end, user_id, count(*) AS n_rows, max(cents) AS top, min(cents) AS low FROM x GROUP BY 1, 2, 3")
def time_window_user(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).window(TimeWindow(DAY, DAY // 4), key_by="user_id").summarise(n_rows="count", top=("max", "cents"), low=("min", "cents"))


@query(_windows("n", "1::BIGINT", "k", 8, 5, "<=", "user_id") + " SELECT win_start, win_end, user_id, event_id FROM x")
def count_window_user(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).window(CountWindow(8, 5), key_by="user_id").df.select("win_start", "win_end", "user_id", F.col("seq").alias("event_id"))


@query(_session_sql("user_id").replace("GROUP BY user_id, s", "GROUP BY user_id, s, event_type").replace("user_id, min(ms) AS win_start, max(ms) AS win_end, count(*) AS n_rows FROM t", "user_id, event_type, min(lo) AS win_start, max(hi) AS win_end, count(*) AS n_rows FROM (SELECT *, min(ms) OVER (PARTITION BY user_id, s) AS lo, max(ms) OVER (PARTITION BY user_id, s) AS hi FROM t)"))
def session_window_kinds(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).window(SessionWindow(_GAP), key_by="user_id").summarise(keys=("event_type",), n_rows="count")


@query(_session_sql("user_id").rpartition("SELECT user_id")[0] + "SELECT event_id, min(ms) OVER (PARTITION BY user_id, s) AS win_start, max(ms) OVER (PARTITION BY user_id, s) AS win_end FROM t WHERE s < top")
def session_window_rows(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).window(SessionWindow(_GAP), key_by="user_id").df.select(F.col("seq").alias("event_id"), "win_start", "win_end")


def _lines(spark, sf_dir) -> DataFrame:
    """Events as lines `user;kind;cents`."""
    return events(spark, sf_dir).df.select(F.concat_ws("; ", "user_id", "event_type", "cents").alias("value"), "ts", "seq")


_FIELDS = (("user", "LONG"), ("kind", "STRING"), ("amount", "LONG"))


@query(""", r AS (SELECT *, lead(event_id) OVER w AS b, lead(event_type) OVER w AS bt, lead(ms) OVER w AS bm, lead(cents) OVER w AS bc FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
  SELECT event_id AS a, b, user_id || ' paid ' || bc || ' after ' || cents || ' at ' || bm AS message FROM r WHERE event_type = 'view' AND bt = 'purchase' AND bm - ms <= 86400000 AND bc > cents""")
def cep_query(spark, sf_dir) -> DataFrame:
    kind = lambda k: F.col("kind") == k
    paid = Action(("$look.user paid", "$buy.amount", "after", "$look.amount", "at $ts"), " ")
    more = lambda match: match["buy"][0]["amount"] > match["look"][0]["amount"]
    query = CepQuery("shop").read(TextInput(_lines(spark, sf_dir), _FIELDS, ";"), key_by="user").sequence(Pattern("look", kind("view")), Pattern("buy", kind("purchase"), STRICT))
    return query.within(DAY).qualify(more).action(paid).result(spark).select(F.col("events")[0].alias("a"), F.col("events")[1].alias("b"), "message")


@query("""SELECT event_id, 1 AS rule, 'dear: ' || cents AS message FROM e WHERE cents >= 9000 UNION ALL SELECT event_id, 2, 'not ' || event_type || ' by ' || user_id FROM e WHERE event_type <> 'view' AND cents < 1000""")
def rule_query(spark, sf_dir) -> DataFrame:
    dear, other = Condition("GE", "amount", 9000), Condition("AND", parts=(Condition("NEQ", "kind", "view"), Condition("LT", "amount", 1000)))
    query = RuleQuery("shop", TextInput(_lines(spark, sf_dir), _FIELDS, ";")).rule(dear, Action(("dear", "$amount"), ": ")).rule(other, Action(("not $kind", "$user"), " by "))
    return query.result(spark).select(F.col("seq").alias("event_id"), "rule", "message")


@query(_MACHINE + " SELECT m.event_id, state, CASE state WHEN 'bought' THEN 'paid ' || e.cents ELSE 'looking' END AS message FROM m JOIN e ON e.event_id = m.event_id WHERE state IN ('bought', 'seen')")
def rule_query_states(spark, sf_dir) -> DataFrame:
    query = RuleQuery("shop", TextInput(_lines(spark, sf_dir), _FIELDS, ";")).states("idle", key_by="user")
    query = query.move("idle", Condition("EQ", "kind", "view"), "seen").move("seen", Condition("EQ", "kind", "purchase"), "bought").move("seen", Condition("EQ", "kind", "error"), "idle")
    query = query.move("bought", Condition("LT", "amount", 2000), "idle").final("bought", Action(("paid", "$amount"), " ")).final("seen", Action(("looking",)))
    return query.result(spark).select(F.col("seq").alias("event_id"), "state", "message")


@query(""", a AS (SELECT *, (event_id * 7919) % 100 + event_id AS arrival FROM e),
  w AS (SELECT *, max(CASE WHEN event_type = 'error' THEN ms END) OVER (PARTITION BY user_id ORDER BY arrival * 1000000000 + event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
  SELECT event_id FROM w WHERE event_type = 'error' OR seen IS NULL OR ms > seen""")
def late_drop_user(spark, sf_dir) -> DataFrame:
    arrival = ((F.col("seq") * 7919) % 100 + F.col("seq")) * 1_000_000_000 + F.col("seq")
    s = events(spark, sf_dir).df.withColumn("event_id", F.col("seq")).withColumn("seq", arrival).withColumn("mark", _is("error"))
    return drop_late(s, "mark", key_by="user_id").select("event_id")


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM e),
  s AS (SELECT a.event_id AS a, a.user_id, a.ms, min(b.n) AS n FROM r a JOIN r b ON b.user_id = a.user_id AND b.n > a.n AND b.event_type = 'error' WHERE a.event_type = 'view' GROUP BY ALL)
  SELECT a AS a, r.event_id AS b FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n WHERE r.ms - s.ms <= 86400000 UNION ALL SELECT event_id, NULL FROM e WHERE event_type = 'view'""")
def cep_optional_pair(spark, sf_dir) -> DataFrame:
    patterns = [Pattern("look", _is("view")), Pattern("fail", _is("error"), RELAXED).optional()]
    found = events(spark, sf_dir).cep(patterns, DAY, key_by="user_id")
    return found.select(F.col("events")[0].alias("a"), F.get("events", F.lit(1)).alias("b"))

"""Queries of interval algebra, frames and splitting, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators import intervals as iv
from ..operators import splitting
from ..operators.carried import numbered
from ..functions import units, vectors
from .common import HOURLY, UTTERANCES, depth_sql, hourly, table, union_sql, utterances

MINUTE = 60_000_000


def overlap_free_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone = iv.exclusive(utterances(spark, sf_dir), ["session"], "speaker")
    return alone.groupBy("session", "speaker").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("e") - F.col("s")).alias("micros"))


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.union(utterances(spark, sf_dir), ["session", "speaker"], within=60 * MINUTE)


def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.col("session").cast("date")).cast("bigint") * 86_400_000_000
    return iv.complement(utterances(spark, sf_dir), ["session", "speaker"], day, day + 86_400_000_000)


def interval_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir)
    pick = lambda t: u.where(F.col("speaker") == t).select("session", "s", "e")
    return iv.combine([pick("click"), pick("view")], ["session"])


def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir)
    pick = lambda t: u.where(F.col("speaker") == t).select("session", "s", "e")
    return iv.subtract(pick("click"), pick("view"), ["session"])


def overlap_depth_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = iv.depths(utterances(spark, sf_dir), ["session"], within=60 * MINUTE)
    return rows.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("micros"))


def active_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = iv.union(utterances(spark, sf_dir), ["session", "speaker"])
    return spans.groupBy("session", "speaker").agg(F.round(F.sum(F.col("e") - F.col("s")) / (F.max("e") - F.min("s")), 9).alias("ratio"))


def gap_islands_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = utterances(spark, sf_dir).select("user_id", F.floor(F.col("s") / (60 * MINUTE)).alias("frame"))
    return iv.at_least(iv.islands(hours, ["user_id"]), 2)


def dilated_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.unix_date(F.col("session").cast("date")).cast("bigint") * 1440
    minutes = utterances(spark, sf_dir).select("session", "speaker", (F.floor(F.col("s") / MINUTE) - base).alias("frame"))
    return iv.dilated_islands(minutes, ["session", "speaker"], 21, 1440)


def _hour_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = hourly(spark, sf_dir)
    first = grid.groupBy("speaker").agg(F.min("frame").alias("base"))
    rows = grid.join(first, "speaker").select("speaker", (F.col("frame") - F.col("base")).alias("frame"), (F.col("p") >= 3).alias("active"))
    return iv.islands(rows, ["speaker", "active"]).select("speaker", "active", "s", "e")


def hysteresis_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.hysteresis(_hour_runs(spark, sf_dir), ["speaker"], 3, 2)


def closing_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = fr.closing(hourly(spark, sf_dir), ["speaker"], 5, 3, 3).where("active")
    return iv.islands(active, ["speaker"])


def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.median_filter(hourly(spark, sf_dir), ["speaker"], 5)


def max_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return fr.max_normalised(rows, ["event_type"], "value").withColumn("value", F.round("value", 9))


def chunk_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = utterances(spark, sf_dir).groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return fr.tiles(sizes, 100, 30, F.lit(0).cast("bigint"), F.col("n")).drop("n")


def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a session by the tile that keeps their place, which follows from place and length."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").cast("string").alias("session"), "ts")
    placed = numbered(rows, ["session"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "frame")
    sizes = rows.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    tile = fr.tile_of(F.col("frame"), 100, 30, F.col("n"))
    return placed.join(sizes, "session").groupBy("session", tile.alias("s")).agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


def consecutive_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    return fr.differences(rows, ["conv_id"], "n", F.lit(0).cast("bigint"), "turn").select("conv_id", "turn", "diff")


def sorted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return fr.is_sorted(rows, ["conv_id"], "n", "turn")


def context_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.col("session").cast("date")).cast("bigint") * 86_400_000_000
    wide = iv.with_context(iv.union(utterances(spark, sf_dir), ["session", "speaker"]), 2 * MINUTE)
    return iv.clip(wide, day + 60 * MINUTE, day + 23 * 60 * MINUTE)


def noise_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = iv.union(utterances(spark, sf_dir), ["session", "speaker"])
    rows = iv.with_always_on(spans, ["session"], "speaker", "noise")
    return rows.groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("micros"))


def frame_to_sample_to_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", units.first_sample(F.col("event_id")).alias("start_sample"), units.last_sample(F.col("event_id") + 3).alias("end_sample"))
    return rows.select("*", units.seconds(F.col("start_sample")).alias("start_time"), units.seconds(F.col("end_sample")).alias("end_time"), units.frame_of(F.col("start_sample")).alias("frame"))


def three_roundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("l_tax").cast("decimal(18,7)") + F.col("l_linenumber").cast("decimal(10,0)") * F.lit("0.00003125").cast("decimal(9,8)")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t.cast("decimal(18,7)").alias("t"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", units.samples_by_float(F.col("t")).alias("by_float"), units.samples_by_decimal(F.col("t")).alias("by_decimal"), units.samples_by_half_even(F.col("t")).alias("half_even"))


def sox_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = iv.union(utterances(spark, sf_dir), ["session", "speaker"])
    packed = spans.groupBy("session", "speaker").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("i"))
    path = F.concat(F.lit("/audio/"), "session", F.lit("_"), "speaker", F.lit(".wav"))
    return packed.select("session", "speaker", vectors.trim_command(path, F.col("i")).alias("command"))


def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minutes of each day at which a speaker's track can be cut: centres of quiet stretches."""
    day = F.unix_micros(F.col("session").cast("timestamp"))
    counts = utterances(spark, sf_dir).groupBy("session", "speaker", F.floor((F.col("s") - day) / MINUTE).alias("frame")).agg(F.count(F.lit(1)).alias("p"))
    minutes = counts.select("session", "speaker").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1439).cast("bigint"))))
    track = minutes.join(counts, ["session", "speaker", "frame"], "left").withColumn("p", F.coalesce("p", F.lit(0)))
    return splitting.quiet_centres(track, ["session", "speaker"], kernel=3)


def _split(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return splitting.split_long(split_candidates(spark, sf_dir), 90, method=method, margin=1)


def split_long_segments_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, "optimal")


def split_long_segments_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, "greedy")


def split_long_segments_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, "partial")


QUERIES = {
    f.__name__: f
    for f in (
        overlap_free_activity, interval_union, interval_complement, interval_and, interval_subtract, overlap_depth_profile, active_ratio,
        gap_islands_per_user, dilated_islands, hysteresis_runs, closing_threshold, median_filter, max_normalise, chunk_tiles, tile_assign,
        consecutive_differences, sorted_turns, context_clip, noise_class, frame_to_sample_to_second, three_roundings, sox_command, split_candidates,
        split_long_segments_optimal, split_long_segments_greedy, split_long_segments_partial,
    )
}

_DAY = "(epoch_us(CAST(session AS TIMESTAMP)))"
_BY_SPEAKER = union_sql("u", "session, speaker", "x")
_ISLANDS = lambda source, keys: f"""i1 AS (SELECT DISTINCT {keys}, frame FROM {source}),
i2 AS (SELECT *, frame - row_number() OVER (PARTITION BY {keys} ORDER BY frame) AS g FROM i1),
islands AS (SELECT {keys}, CAST(min(frame) AS BIGINT) AS s, CAST(max(frame) + 1 AS BIGINT) AS e FROM i2 GROUP BY {keys}, g)"""  # noqa: E731
_TILES = """sizes AS (SELECT session, count(*) AS n FROM u GROUP BY session),
k AS (SELECT session, n, CAST(greatest(0, ceil((n - 100) / 30.0)) AS BIGINT) AS m, unnest(generate_series(0, CAST(greatest(0, ceil((n - 100) / 30.0)) AS BIGINT))) AS k FROM sizes),
t AS (SELECT session, CASE WHEN k = m THEN greatest(n - 100, 0) ELSE 30 * k END AS s, CASE WHEN k = m THEN n ELSE 30 * k + 100 END AS e,
  CASE WHEN k = 0 THEN 0 ELSE (k - 1) * 30 + 85 END AS s_ins, CASE WHEN k = m THEN n ELSE k * 30 + 85 END AS e_ins FROM k)"""

ORACLE_SQL = {
    "overlap_free_activity": f"""WITH {UTTERANCES}, {_BY_SPEAKER},
names AS (SELECT speaker, CAST(row_number() OVER (ORDER BY speaker) AS BIGINT) AS code FROM (SELECT DISTINCT speaker FROM u)),
coded AS (SELECT session, s, e, code FROM x JOIN names USING (speaker)), {depth_sql("coded", "session", "d", "code")},
alone AS (SELECT session, speaker, s, e FROM d JOIN names ON code = who WHERE depth = 1), {union_sql("alone", "session, speaker", "y")}
SELECT session, speaker, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS micros FROM y GROUP BY ALL""",
    "interval_union": f"WITH {UTTERANCES}, {_BY_SPEAKER} SELECT * FROM x",
    "interval_complement": f"""WITH {UTTERANCES}, c AS (SELECT session, speaker, greatest(s, {_DAY}) AS s, least(e, {_DAY} + 86400000000) AS e FROM u),
c2 AS (SELECT * FROM c WHERE s < e), {union_sql("c2", "session, speaker", "x")},
g AS (SELECT session, speaker, coalesce(lag(e) OVER w, {_DAY}) AS s, s AS e FROM x WINDOW w AS (PARTITION BY session, speaker ORDER BY s)
  UNION ALL SELECT session, speaker, max(e), any_value({_DAY}) + 86400000000 FROM x GROUP BY session, speaker)
SELECT * FROM g WHERE s < e""",
    "interval_and": f"""WITH {UTTERANCES}, p AS (SELECT session, speaker, s, e FROM u WHERE speaker IN ('click', 'view')), {union_sql("p", "session, speaker", "x")},
{depth_sql("x", "session", "d")}, two AS (SELECT session, s, e FROM d WHERE depth >= 2), {union_sql("two", "session", "y")} SELECT * FROM y""",
    "interval_subtract": f"""WITH {UTTERANCES}, p AS (SELECT session, speaker, s, e FROM u WHERE speaker IN ('click', 'view')), {union_sql("p", "session, speaker", "x")},
{depth_sql("x", "session", "d", "CASE WHEN speaker = 'click' THEN 1 ELSE 0 END")}, only_a AS (SELECT session, s, e FROM d WHERE depth = 1 AND who = 1), {union_sql("only_a", "session", "y")} SELECT * FROM y""",
    "overlap_depth_profile": f"WITH {UTTERANCES}, {depth_sql('u', 'session', 'd')} SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS micros FROM d GROUP BY ALL",
    "active_ratio": f"WITH {UTTERANCES}, {_BY_SPEAKER} SELECT session, speaker, round(CAST(sum(e - s) AS DOUBLE) / CAST(max(e) - min(s) AS DOUBLE), 9) AS ratio FROM x GROUP BY ALL",
    "gap_islands_per_user": f"WITH {UTTERANCES}, h AS (SELECT user_id, CAST(floor(s / 3600000000) AS BIGINT) AS frame FROM u), {_ISLANDS('h', 'user_id')} SELECT * FROM islands WHERE e - s >= 2",
    "dilated_islands": f"""WITH {UTTERANCES}, m AS (SELECT session, speaker, CAST(floor((s - {_DAY}) / 60000000) AS BIGINT) AS f FROM u),
wide AS (SELECT DISTINCT session, speaker, unnest(generate_series(greatest(0, f - 10), least(1439, f + 10))) AS frame FROM m), {_ISLANDS('wide', 'session, speaker')} SELECT * FROM islands""",
    "hysteresis_runs": f"""WITH {HOURLY}, r AS (SELECT speaker, p >= 3 AS active, frame - min(frame) OVER (PARTITION BY speaker) AS frame FROM hourly), {_ISLANDS('r', 'speaker, active')},
st AS (SELECT *, last_value(CASE WHEN s = 0 OR e - s >= CASE WHEN active THEN 3 ELSE 2 END THEN active END IGNORE NULLS) OVER (PARTITION BY speaker ORDER BY s ROWS UNBOUNDED PRECEDING) AS state FROM islands),
onn AS (SELECT speaker, s, e FROM st WHERE state), {union_sql("onn", "speaker", "y")} SELECT * FROM y""",
    "closing_threshold": f"""WITH {HOURLY}, a AS (SELECT speaker, frame, max(p) OVER (PARTITION BY speaker ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS p FROM hourly),
b AS (SELECT speaker, frame, min(p) OVER (PARTITION BY speaker ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS p FROM a), c AS (SELECT * FROM b WHERE p >= 3), {_ISLANDS('c', 'speaker')} SELECT * FROM islands""",
    "median_filter": f"WITH {HOURLY} SELECT speaker, frame, quantile_disc(p, 0.5) OVER (PARTITION BY speaker ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS p FROM hourly",
    "max_normalise": "SELECT event_id, event_type, round(coalesce(abs(value) / nullif(max(abs(value)) OVER (PARTITION BY event_type), 0), 0), 9) AS value FROM events",
    "chunk_tiles": f"WITH {UTTERANCES}, {_TILES} SELECT session, s::BIGINT AS s, e::BIGINT AS e, s_ins::BIGINT AS s_ins, e_ins::BIGINT AS e_ins, (s_ins - s)::BIGINT AS s_cut, (e_ins - s)::BIGINT AS e_cut FROM t",
    "tile_assign": f"""WITH {UTTERANCES}, {_TILES}, p AS (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS session, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS frame FROM events)
SELECT p.session, t.s::BIGINT AS s, count(*) AS n_events, min(event_id) AS first_event FROM p JOIN t ON p.session = t.session AND frame >= s_ins AND frame < e_ins GROUP BY ALL""",
    "consecutive_differences": "SELECT conv_id, turn, CAST(length(text) - coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS BIGINT) AS diff FROM conversations",
    "sorted_turns": "SELECT conv_id, bool_and(up) AS sorted FROM (SELECT conv_id, coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) <= length(text), true) AS up FROM conversations) GROUP BY conv_id",
    "context_clip": f"""WITH {UTTERANCES}, {_BY_SPEAKER}, w AS (SELECT session, speaker, greatest(0, s - 120000000) AS s, e + 120000000 AS e, {_DAY} + 3600000000 AS a, {_DAY} + 82800000000 AS b FROM x)
SELECT session, speaker, greatest(s, a) - a AS s, least(e, b) - a AS e FROM w WHERE greatest(s, a) < least(e, b)""",
    "noise_class": f"""WITH {UTTERANCES}, {_BY_SPEAKER}, n AS (SELECT session, 'noise' AS speaker, min(s) AS s, max(e) AS e FROM x GROUP BY session UNION ALL SELECT session, speaker, s, e FROM x)
SELECT speaker, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS micros FROM n GROUP BY speaker""",
    "frame_to_sample_to_second": """WITH r AS (SELECT event_id, greatest(0, 256 * event_id - 768)::BIGINT AS a, (256 * (event_id + 3) + 255)::BIGINT AS b FROM events)
SELECT event_id, a AS start_sample, b AS end_sample, (a * 625)::DECIMAL(25, 0) * 0.0000001 AS start_time, (b * 625)::DECIMAL(25, 0) * 0.0000001 AS end_time, CAST(floor((a + 768) / 256) AS BIGINT) AS frame FROM r""",
    "three_roundings": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_tax AS DECIMAL(18, 7)) + CAST(l_linenumber * 3125 AS DECIMAL(18, 0)) * 0.00000001 AS DECIMAL(18, 7)) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(CAST(t AS DOUBLE) * 16000.0::DOUBLE) AS BIGINT) AS by_float, CAST(trunc(t * 16000) AS BIGINT) AS by_decimal,
  CAST(round_even(CAST(t * 16000 AS DOUBLE), 0) AS BIGINT) AS half_even FROM r""",
    "split_candidates": f"""WITH {UTTERANCES}, c AS (SELECT session, speaker, CAST(floor((s - {_DAY}) / 60000000) AS BIGINT) AS f, count(*) AS p FROM u GROUP BY ALL),
m AS (SELECT session, speaker, unnest(generate_series(0, 1439)) AS f FROM (SELECT DISTINCT session, speaker FROM c)),
t AS (SELECT m.session, m.speaker, m.f, coalesce(p, 0) AS p FROM m LEFT JOIN c ON c.session = m.session AND c.speaker = m.speaker AND c.f = m.f),
w AS (SELECT session, speaker, f AS frame, max(p) OVER (PARTITION BY session, speaker ORDER BY f ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS p FROM t),
low AS (SELECT session, speaker, frame FROM w WHERE p <= 0.2), {_ISLANDS('low', 'session, speaker')},
k AS (SELECT session, speaker, list(CAST((s + e) // 2 AS BIGINT) ORDER BY s) AS candidates FROM islands WHERE s >= 20 AND 1440 - e >= 20 GROUP BY ALL)
SELECT session, speaker, 0::BIGINT AS s, 1440::BIGINT AS e, coalesce(candidates, CAST([] AS BIGINT[])) AS candidates FROM (SELECT DISTINCT session, speaker FROM c) LEFT JOIN k USING (session, speaker)""",
    "sox_command": f"""WITH {UTTERANCES}, {_BY_SPEAKER}, c AS (SELECT session, speaker, string_agg('=' || s || 's =' || e || 's', ' ' ORDER BY s) AS p FROM x GROUP BY ALL)
SELECT session, speaker, 'sox -t wav /audio/' || session || '_' || speaker || '.wav -t wav - trim ' || p || ' |' AS command FROM c""",
}

_MAX_LEN = 90
_SEGMENTS = "seg AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (" + ORACLE_SQL["split_candidates"] + "))"
#: greedy(id, splits): the state after each candidate is how far the next one may be, and the splits so far.
_GREEDY = f"""steps(id, i, reach, splits) AS (
  SELECT id, 1::BIGINT, s + {_MAX_LEN}, []::BIGINT[] FROM seg
  UNION ALL
  SELECT id, i + 1, CASE WHEN c[i + 1] > reach THEN c[i] + {_MAX_LEN} ELSE reach END, CASE WHEN c[i + 1] > reach THEN splits || [c[i]] ELSE splits END
  FROM (SELECT steps.*, seg.candidates AS c FROM steps JOIN seg USING (id)) WHERE i < len(c)),
greedy AS MATERIALIZED (
  SELECT id, CASE WHEN len(candidates) > 0 AND e > reach THEN splits || [candidates[-1]] ELSE splits END AS splits
  FROM steps JOIN seg USING (id) WHERE i = greatest(len(candidates), 1))"""


def _optimal_sql(source: str) -> str:
    """optimal(id, splits) of ``source(id, points)``: best has number, cost and splits up to each point."""
    inner = "j < len(p)"
    choice = f"""list_sort(list_transform(list_filter(range(1, j), lambda i: p[j] - p[i] <= {_MAX_LEN} OR j - i = 1),
      lambda i: {{'n': best[i].n + CASE WHEN {inner} THEN 1 ELSE 0 END, 'cost': best[i].cost + (p[j] - p[i]) * (p[j] - p[i]), 'at': best[i].at || CASE WHEN {inner} THEN [p[j]] ELSE []::BIGINT[] END}}))[1]"""
    return f"""reached(id, p, j, best) AS (
  SELECT id, points, 2::BIGINT, [{{'n': 0::BIGINT, 'cost': 0::BIGINT, 'at': []::BIGINT[]}}] FROM {source}
  UNION ALL
  SELECT id, p, j + 1, best || [{choice}] FROM reached WHERE j <= len(p)),
optimal AS MATERIALIZED (SELECT id, CASE WHEN p[-1] - p[1] <= {_MAX_LEN} THEN []::BIGINT[] ELSE best[-1].at END AS splits FROM reached WHERE j = len(p) + 1)"""


def _pieces_sql(source: str) -> str:
    return f"""SELECT session, speaker, unnest([s] || list_transform(splits, lambda x: x + 1)) AS s, unnest(list_transform(splits, lambda x: x - 1) || [e]) AS e FROM {source} JOIN seg USING (id)"""


ORACLE_SQL |= {
    "split_long_segments_greedy": f"WITH RECURSIVE {_SEGMENTS}, {_GREEDY} {_pieces_sql('greedy')}",
    "split_long_segments_optimal": f"WITH RECURSIVE {_SEGMENTS}, whole AS (SELECT id, [s] || candidates || [e] AS points FROM seg), {_optimal_sql('whole')} {_pieces_sql('optimal')}",
    "split_long_segments_partial": f"""WITH RECURSIVE {_SEGMENTS}, {_GREEDY},
kept AS MATERIALIZED (SELECT id, splits[1 : len(splits) - 2] AS fixed FROM greedy),
ends AS (SELECT id, [low] || list_filter(candidates, lambda c: c > low) || [e] AS points FROM (SELECT seg.*, coalesce(fixed[-1], s) AS low FROM kept JOIN seg USING (id))),
{_optimal_sql('ends')}, joined AS (SELECT id, fixed || splits AS splits FROM kept JOIN optimal USING (id)) {_pieces_sql('joined')}""",
}

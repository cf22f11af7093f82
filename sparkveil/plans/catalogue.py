"""Every query of the engine by name, with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookups, textpii
from ..operators import boxes, parsers, pixels, reports, speech, summary, tracks
from ..sources import adapters, readers
from ..sources.readers import shared_dir
from ..streaming import streams
from .inputs import CARRY, KIND_OF, MARGIN, TOTAL, boxed_tracks, event_kind, event_tracks, line_boxes, raw_events, spoken_numbers, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL building blocks ------------------------------------------------------------------

ET = """et AS (SELECT DISTINCT 'clip' AS media_id, event_type || ':' || user_id AS track_key,
  CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS INTEGER) AS frame FROM events)"""
NEXT = f"""{ET}, nx AS (SELECT *, lead(frame) OVER (PARTITION BY track_key ORDER BY frame) AS nxt FROM et)"""
KIND_CASE = "CASE split_part(track_key, ':', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_OF.items()) + " END"


def severity_case(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({expr}), '{k}') THEN '{v}'" for k, v in lookups.SEVERITY_OF) + " ELSE 'medium' END"


WEIGHT_CASE = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lookups.WEIGHTS.items()) + " END"
ELEMENTS = f"""{ET}, g AS (SELECT media_id, track_key, {KIND_CASE} AS kind, count(*) AS frames_detected, min(frame) AS first_frame, max(frame) AS last_frame FROM et GROUP BY 1, 2, 3),
s AS (SELECT *, {severity_case("kind")} AS severity, round(frames_detected / {TOTAL}::DOUBLE, 3) AS share_of_clip FROM g),
el AS (SELECT *, {WEIGHT_CASE} AS severity_weight FROM s)"""
CLEAN = "coalesce(text, '')"
LUHN = "list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[length(d) - i] AS INTEGER) ELSE (CASE WHEN 2 * CAST(d[length(d) - i] AS INTEGER) > 9 THEN 2 * CAST(d[length(d) - i] AS INTEGER) - 9 ELSE 2 * CAST(d[length(d) - i] AS INTEGER) END) END)) % 10 = 0"


def found_sql(name: str, source: str, key: str, body: str) -> str:
    """Matches of the four kinds that the tables hold, as a CTE; patterns without look-around are
    anchored at each place whose left neighbour allows a start."""
    at = lambda pattern, width, first: f"""SELECT {key}, i - 1 AS start, regexp_extract(substr(t, i, {width}), '^({pattern})(?:[^0-9]|$)', 1) AS m
      FROM (SELECT {key}, t, unnest(range(1, length(t) + 1)) AS i FROM {name}_t WHERE regexp_matches(t, '[0-9]{{3}}')) WHERE regexp_matches(substr(t, i, 1), '{first}') AND NOT regexp_matches(substr(t, i - 1, CASE WHEN i = 1 THEN 0 ELSE 1 END), '[0-9]')"""  # noqa: E731
    return f"""{name}_t AS (SELECT {key}, coalesce({body}, '') AS t FROM {source}),
{name}_e AS (SELECT {key}, list_sum(list_transform(seg[:k], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[:k - 1], lambda s: length(s))), 0) AS start, ms[k] AS m
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT {key}, regexp_extract_all(t, '{textpii.EMAIL}') AS ms, regexp_split_to_array(t, '{textpii.EMAIL}') AS seg FROM {name}_t WHERE contains(t, '@')))),
{name}_c0 AS (SELECT * FROM ({at("(?:[0-9][ -]?){12,18}[0-9]", 60, "[0-9]")}) WHERE m <> ''),
{name}_c1 AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM {name}_c0 a WHERE NOT EXISTS (SELECT 1 FROM {name}_c0 b WHERE b.{key} = a.{key} AND b.start < a.start AND b.start + length(b.m) > a.start)),
{name}_c AS (SELECT {key}, start, m FROM {name}_c1 WHERE {LUHN}),
{name}_p0 AS (SELECT * FROM ({at("(?:[+]?1[ .-]?)?[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}", 40, "[0-9+(]")}) WHERE m <> ''),
{name}_p AS (SELECT * FROM {name}_p0 a WHERE NOT EXISTS (SELECT 1 FROM {name}_p0 b WHERE b.{key} = a.{key} AND b.start < a.start AND b.start + length(b.m) > a.start)),
{name}_all AS (SELECT *, 'email' AS kind, 1 AS rank FROM {name}_e UNION ALL SELECT *, 'credit card number', 4 FROM {name}_c UNION ALL SELECT *, 'phone number', 5 FROM {name}_p),
{name} AS (SELECT {key}, kind, CAST(start AS INTEGER) AS start, m AS text FROM {name}_all a WHERE NOT EXISTS (SELECT 1 FROM {name}_all b WHERE b.{key} = a.{key} AND b.rank < a.rank AND a.start < b.start + length(b.m) AND a.start + length(a.m) > b.start))"""


DOCS = found_sql("f", "documents", "doc_id", "text")


# --- text -----------------------------------------------------------------------------------


def doc_hits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", F.explode(textpii.find_pii(F.col("text"))).alias("h")).select("doc_id", "source", "h.*")


def one_kind(pattern: str, ok=None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = textpii.matches(F.coalesce("text", F.lit("")), pattern)
        found = found if ok is None else F.filter(found, lambda s: ok(s["text"]))
        return table(spark, sf, "documents").select("doc_id", F.explode(found).alias("h")).select("doc_id", "h.start", "h.text")

    return run


for _name, _run, _cte in (("pii_email", one_kind(textpii.EMAIL), "f_e"), ("pii_card", one_kind(textpii.CARD, textpii.luhn_ok), "f_c"), ("pii_phone", one_kind(textpii.PHONE), "f_p")):
    QUERIES[_name] = _run
    SQL[_name] = f"WITH {DOCS} SELECT doc_id, CAST(start AS INTEGER) AS start, m AS text FROM {_cte}"
SSN_SPARK = "concat('no ', lpad(o_orderkey * 7919 % 1000, 3, '0'), '-', lpad(o_orderkey * 31 % 100, 2, '0'), '-', lpad(o_orderkey * 37 % 10000, 4, '0'), if(o_orderkey % 7 = 0, '5 x', ', x'))"


@query("""WITH n AS (SELECT o_orderkey, o_orderkey * 7919 % 1000 AS a, o_orderkey * 31 % 100 AS g, o_orderkey * 37 % 10000 AS s FROM orders)
SELECT o_orderkey, 3 AS start, lpad(CAST(a AS VARCHAR), 3, '0') || '-' || lpad(CAST(g AS VARCHAR), 2, '0') || '-' || lpad(CAST(s AS VARCHAR), 4, '0') AS text FROM n WHERE o_orderkey % 7 <> 0 AND a NOT IN (0, 666) AND a < 900 AND g <> 0 AND s <> 0""")
def pii_ssn(spark, sf):
    """A number for each order, some out of range, some run into by another digit."""
    found = F.filter(textpii.matches(F.expr(SSN_SPARK), textpii.SSN), lambda s: textpii.ssn_ok(s["text"]))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(found).alias("h")).select("o_orderkey", "h.start", "h.text")


@query(f"WITH {DOCS} SELECT doc_id, kind, start, CAST(start + length(text) AS INTEGER) AS \"end\", text FROM f")
def pii_hits_all(spark, sf):
    return doc_hits(spark, sf).select("doc_id", "kind", "start", "end", "text")


@query(f"WITH {DOCS} SELECT d.source, f.kind, {severity_case('f.kind')} AS severity, count(*) AS hits, count(DISTINCT f.doc_id) AS docs FROM f JOIN documents d USING (doc_id) GROUP BY ALL")
def pii_counts_by_source(spark, sf):
    return doc_hits(spark, sf).withColumn("severity", lookups.severity(F.col("kind"))).groupBy("source", "kind", "severity").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


@query(f"WITH {found_sql('f', 'pages', 'page_id', 'html')} SELECT kind, count(*) AS hits, count(DISTINCT page_id) AS pages FROM f GROUP BY ALL")
def pii_counts_pages(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(textpii.find_pii(F.col("html"))).alias("h"))
    return rows.groupBy(F.col("h.kind").alias("kind")).agg(F.count("*").alias("hits"), F.countDistinct("page_id").alias("pages"))


DIGITS_SQL = "right(lpad(CAST(('0x' || substr(sha256(k), 1, 15))::UBIGINT AS VARCHAR), 20, '0'), {n})"
STAND_IN = f"""r AS (SELECT doc_id, kind, start, text, kind || ':' || text AS k FROM f), q AS (SELECT *, '4242' || {DIGITS_SQL.format(n=11)} AS b, {DIGITS_SQL.format(n=6)} AS six FROM r),
u AS (SELECT *, b || CAST((10 - list_sum(list_transform(range(15), lambda i: CASE WHEN i % 2 = 1 THEN CAST(b[15 - i] AS INTEGER) ELSE (CASE WHEN 2 * CAST(b[15 - i] AS INTEGER) > 9 THEN 2 * CAST(b[15 - i] AS INTEGER) - 9 ELSE 2 * CAST(b[15 - i] AS INTEGER) END) END)) % 10) % 10 AS VARCHAR) AS c FROM q),
st AS (SELECT doc_id, start, start + length(text) AS stop, CASE kind WHEN 'email' THEN 'person@example.com' WHEN 'phone number' THEN '555-01' || CAST(10 + CAST(six AS INTEGER) % 90 AS VARCHAR) ELSE c[1:4] || ' ' || c[5:8] || ' ' || c[9:12] || ' ' || c[13:16] END AS made FROM u)"""


@query(f"""WITH {DOCS}, {STAND_IN}, pc AS (SELECT st.*, d.text AS t, coalesce(lag(stop) OVER (PARTITION BY st.doc_id ORDER BY start), 0) AS back FROM st JOIN documents d USING (doc_id)),
j AS (SELECT doc_id, count(*) AS hits, string_agg(substr(t, back + 1, start - back) || made, '' ORDER BY start) || substr(any_value(t), max(stop) + 1) AS masked FROM pc GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(hits, 0) AS INTEGER) AS hits, md5(coalesce(masked, d.text)) AS masked_md5 FROM documents d LEFT JOIN j USING (doc_id)""")
def pii_mask_documents(spark, sf):
    docs = table(spark, sf, "documents")
    found = docs.withColumn("found", textpii.find_pii(F.col("text")))
    return found.select("doc_id", F.size("found").alias("hits"), F.md5(textpii.mask(F.col("text"), F.col("found"))).alias("masked_md5"))


@query(f"""WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 AS VARCHAR), 16, '4') AS d FROM orders)
SELECT o_orderkey, d AS digits, {LUHN} AS ok FROM n""")
def luhn_check_numbers(spark, sf):
    digits = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 16, "4")
    return table(spark, sf, "orders").select("o_orderkey", digits.alias("digits"), textpii.luhn_ok(digits).alias("ok"))


@query("""WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 104729 AS VARCHAR), 15, '4242') AS b FROM orders),
d AS (SELECT o_orderkey, b, (10 - list_sum(list_transform(range(15), lambda i: CASE WHEN i % 2 = 1 THEN CAST(b[15 - i] AS INTEGER) ELSE (CASE WHEN 2 * CAST(b[15 - i] AS INTEGER) > 9 THEN 2 * CAST(b[15 - i] AS INTEGER) - 9 ELSE 2 * CAST(b[15 - i] AS INTEGER) END) END)) % 10) % 10 AS c FROM n)
SELECT o_orderkey, b || CAST(c AS VARCHAR) AS number FROM d""")
def luhn_complete_numbers(spark, sf):
    body = F.lpad((F.col("o_orderkey") * 104729).cast("string"), 15, "4242")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(body, textpii.luhn_digit(body)).alias("number"))


GPS_A, GPS_B = "(o_orderkey * 7919 % 2400000 - 1200000)", "(o_orderkey * 104729 % 4400000 - 2200000)"
GPS_TEXT = "if({0} < 0, '-', '') || cast(floor(abs({0}) / 10000) as bigint) || '.' || lpad(abs({0}) % 10000, 4, '0')"


@query(f"""WITH n AS (SELECT o_orderkey, {GPS_A} AS a, {GPS_B} AS b FROM orders),
w AS (SELECT *, CASE WHEN a < 0 THEN '-' ELSE '' END || CAST(abs(a) // 10000 AS VARCHAR) || '.' || lpad(CAST(abs(a) % 10000 AS VARCHAR), 4, '0') AS x, CASE WHEN b < 0 THEN '-' ELSE '' END || CAST(abs(b) // 10000 AS VARCHAR) || '.' || lpad(CAST(abs(b) % 10000 AS VARCHAR), 4, '0') AS y FROM n)
SELECT o_orderkey, 'gps coordinates' AS kind, x || ', ' || y AS text, 3 AS start, CAST(3 + length(x || ', ' || y) AS INTEGER) AS "end" FROM w WHERE ((abs(a) <= 900000 AND abs(b) <= 1800000) OR (abs(a) <= 1800000 AND abs(b) <= 900000)) AND NOT (a = 0 AND b = 0)""")
def pii_gps(spark, sf):
    """A pair of numbers for each order, some of which are no coordinates."""
    text = F.expr(f"'at ' || {GPS_TEXT.format(GPS_A)} || ', ' || {GPS_TEXT.format(GPS_B)} || ' now'")
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(textpii.find_pii(text)).alias("h"))
    return rows.select("o_orderkey", "h.kind", "h.text", "h.start", "h.end")


# --- tracks -----------------------------------------------------------------------------------


@query(f"WITH {ELEMENTS} SELECT severity, count(*) AS tracks, sum(frames_detected)::BIGINT AS frames FROM el GROUP BY 1")
def severity_distribution(spark, sf):
    e = summary.elements(event_tracks(spark, sf), TOTAL, event_kind())
    return e.groupBy("severity").agg(F.count("*").alias("tracks"), F.sum("frames_detected").alias("frames"))


@query(f"WITH {ELEMENTS} SELECT media_id, track_key AS track, kind, severity, severity_weight, frames_detected, first_frame, last_frame, share_of_clip FROM el")
def track_elements(spark, sf):
    return summary.order_elements(summary.elements(event_tracks(spark, sf), TOTAL, event_kind()))


SUMMARY_COLUMNS = """media_id, count(*) AS elements_found, count_if(severity = 'critical')::BIGINT AS critical, count_if(severity = 'high')::BIGINT AS high, count_if(severity = 'medium')::BIGINT AS medium, count_if(severity = 'low')::BIGINT AS low,
round(sum(severity_weight * greatest(0.2::DOUBLE, share_of_clip)), 1) AS exposure_score"""


@query(f"WITH {ELEMENTS}, fr AS (SELECT media_id, count(DISTINCT frame) AS frames_with_elements FROM et GROUP BY 1), x AS (SELECT {SUMMARY_COLUMNS} FROM el GROUP BY media_id) SELECT x.*, frames_with_elements, round(frames_with_elements / {TOTAL}::DOUBLE, 3) AS share_of_frames, 0::BIGINT AS kept_visible FROM x JOIN fr USING (media_id)")
def run_summary(spark, sf):
    return summary.summaries(event_tracks(spark, sf), TOTAL, event_kind()).drop("elements", "mode", "audio_note", "mask_source")


@query(f"WITH {ELEMENTS}, fr AS (SELECT media_id, count(DISTINCT frame) AS frames_with_sensitive_elements FROM et GROUP BY 1), x AS (SELECT {SUMMARY_COLUMNS} FROM el GROUP BY media_id) SELECT elements_found, critical, high, medium, low, frames_with_sensitive_elements, exposure_score FROM x JOIN fr USING (media_id)")
def summary_round_trip(spark, sf):
    """Summaries written as documents and read again."""
    path = shared_dir(spark, "summaries")
    readers.write_summaries(readers.summary_documents(summary.summaries(event_tracks(spark, sf), TOTAL, event_kind())), path)
    return readers.read_summaries(spark, f"{path}/*.json").select("elements_found", "severity_counts.*", "frames_with_sensitive_elements", "exposure_score")


@query(f"WITH {ELEMENTS} SELECT kind, round(sum(severity_weight * greatest(0.2::DOUBLE, share_of_clip)), 1) AS exposure FROM el GROUP BY 1")
def exposure_score(spark, sf):
    return summary.elements(event_tracks(spark, sf), TOTAL, event_kind()).groupBy("kind").agg(summary.exposure().alias("exposure"))


@query(f"WITH {NEXT} SELECT media_id, track_key, frame, 'detected' AS origin FROM et UNION ALL SELECT media_id, track_key, frame + 1, 'filled' FROM nx WHERE nxt - frame - 1 = 1")
def gap_fill(spark, sf):
    return tracks.fill_gaps(event_tracks(spark, sf).withColumn("origin", F.lit("detected")))


CARRIED = f"""{NEXT}, cf AS (SELECT media_id, track_key, frame, 'detected' AS origin FROM et UNION ALL
SELECT media_id, track_key, CAST(unnest(generate_series(frame + 1, CASE WHEN nxt IS NULL THEN least(frame + {CARRY}, {TOTAL - 1}) WHEN nxt - frame - 1 BETWEEN 1 AND {CARRY} THEN nxt - 1 ELSE frame END)) AS INTEGER), 'carried' FROM nx)"""


@query(f"WITH {CARRIED} SELECT * FROM cf")
def carry_forward(spark, sf):
    return tracks.carry_forward(event_tracks(spark, sf).withColumn("origin", F.lit("detected")), CARRY, TOTAL)


@query(f"WITH {NEXT} SELECT media_id, track_key, frame + 1 AS gap_start, nxt - 1 AS gap_end, nxt - frame - 1 AS gap_len FROM nx WHERE nxt - frame - 1 > {CARRY}")
def coverage_gaps(spark, sf):
    return tracks.coverage_gaps(event_tracks(spark, sf), CARRY)


REPORT = f"""{NEXT}, rp AS (SELECT media_id, track_key, count(*) AS detected, min(frame) AS first_frame, max(frame) AS last_frame, coalesce(max(nxt - frame - 1), 0) AS longest_gap, count_if(nxt - frame - 1 > {CARRY})::BIGINT AS open_gaps FROM nx GROUP BY 1, 2)"""


@query(f"WITH {REPORT} SELECT *, last_frame - first_frame + 1 AS span, greatest(0, last_frame - first_frame + 1 - detected) AS carried_est, CASE WHEN open_gaps > 0 THEN 'NEEDS REVIEW' ELSE 'OK' END AS status FROM rp")
def coverage_report_rows(spark, sf):
    return tracks.coverage_report(event_tracks(spark, sf), CARRY)


@query(f"WITH {REPORT} SELECT media_id, max(longest_gap) AS longest_gap, sum(detected)::BIGINT AS detected, sum(open_gaps)::BIGINT AS open_gaps FROM rp GROUP BY 1")
def longest_gap(spark, sf):
    return tracks.coverage_report(event_tracks(spark, sf), CARRY).groupBy("media_id").agg(F.max("longest_gap").alias("longest_gap"), F.sum("detected").alias("detected"), F.sum("open_gaps").alias("open_gaps"))


@query(f"""WITH {ET}, one AS (SELECT DISTINCT split_part(track_key, ':', 1) AS media_id, frame FROM et), sp AS (SELECT media_id, unnest(range(0, {TOTAL})) AS frame FROM (SELECT DISTINCT media_id FROM one)),
c AS (SELECT sp.media_id, sp.frame, one.frame IS NOT NULL AS c FROM sp LEFT JOIN one ON sp.media_id = one.media_id AND sp.frame = one.frame),
n AS (SELECT *, lag(c) OVER (PARTITION BY media_id ORDER BY frame) AS b, lead(c) OVER (PARTITION BY media_id ORDER BY frame) AS a FROM c)
SELECT media_id, CAST(frame AS INTEGER) AS frame, c OR (CASE WHEN b IS NULL THEN coalesce(a, false) WHEN a IS NULL THEN b ELSE a AND b END) AS covered FROM n""")
def frame_coverage_smoothed(spark, sf):
    """All tracks; each event type is a clip of its own."""
    every = by_type(event_tracks(spark, sf)).select("media_id", "frame").distinct()
    return smoothed_coverage(every, clips(every))


def by_type(rows):
    return rows.withColumn("media_id", F.split("track_key", ":")[0])


def clips(rows):
    return rows.select("media_id").distinct().withColumn("total_frames", F.lit(TOTAL))


def smoothed_coverage(covered, media):
    unit = F.array(F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(1).alias("x2"), F.lit(1).alias("y2")))
    empty = F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>")
    frames = tracks.spine(media).join(covered.withColumn("boxes", unit), ["media_id", "frame"], "left").withColumn("boxes", F.coalesce("boxes", empty))
    return tracks.smooth(frames).select("media_id", "frame", (F.size("boxes") > 0).alias("covered"))


BOXED = f"""bx AS (SELECT event_type || ':' || user_id AS track_key, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS INTEGER) AS frame, CAST(min(user_id) % 100 AS INTEGER) AS x, CAST(floor(min(value) % 100) AS INTEGER) AS y FROM events GROUP BY 1, 2),
pd AS (SELECT DISTINCT frame, greatest(0, x - {MARGIN}) AS x1, greatest(0, y - {MARGIN}) AS y1, least(100, x + 10 + {MARGIN}) AS x2, least(100, y + 10 + {MARGIN}) AS y2 FROM bx)"""


@query(f"WITH {BOXED} SELECT frame, count(*) AS n_boxes, sum((x2 - x1) * (y2 - y1))::BIGINT AS area, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM pd WHERE x2 > x1 AND y2 > y1 GROUP BY 1")
def boxes_padded_merged(spark, sf):
    padded = boxed_tracks(spark, sf).withColumn("boxes", tracks.pad(F.col("boxes"), MARGIN, 100, 100))
    rows = tracks.merge_frames(padded).select("frame", F.explode("boxes").alias("b")).select("frame", "b.*")
    return rows.groupBy("frame").agg(F.count("*").alias("n_boxes"), F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


MASKS = f"""WITH b0 AS (SELECT event_type AS media_id, event_type || ':' || user_id AS track_key, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS INTEGER) AS frame, CAST(min(user_id) % 100 AS INTEGER) AS x, CAST(floor(min(value) % 100) AS INTEGER) AS y FROM events GROUP BY 1, 2, 3),
n0 AS (SELECT *, lead(frame) OVER (PARTITION BY track_key ORDER BY frame) AS nxt FROM b0),
b1 AS (SELECT media_id, track_key, x, y, unnest(generate_series(frame, CASE WHEN nxt - frame - 1 = 1 THEN nxt - 1 ELSE frame END)) AS frame FROM n0),
n1 AS (SELECT *, lead(frame) OVER (PARTITION BY track_key ORDER BY frame) AS nxt FROM b1),
b2 AS (SELECT media_id, x, y, unnest(generate_series(frame, CASE WHEN nxt IS NULL THEN least(frame + 2, {TOTAL - 1}) WHEN nxt - frame - 1 BETWEEN 1 AND 2 THEN nxt - 1 ELSE frame END)) AS frame FROM n1),
b AS (SELECT DISTINCT media_id, frame, greatest(0, x - {MARGIN}) AS x1, greatest(0, y - {MARGIN}) AS y1, least(100, x + 10 + {MARGIN}) AS x2, least(100, y + 10 + {MARGIN}) AS y2 FROM b2),
c AS (SELECT * FROM b WHERE x2 > x1 AND y2 > y1),
m AS (SELECT * FROM c UNION SELECT media_id, 0, x1, y1, x2, y2 FROM c WHERE frame = 1 UNION SELECT media_id, {TOTAL - 1}, x1, y1, x2, y2 FROM c WHERE frame = {TOTAL - 2}
  UNION SELECT p.media_id, p.frame + 1, greatest(p.x1, q.x1), greatest(p.y1, q.y1), least(p.x2, q.x2), least(p.y2, q.y2) FROM c p JOIN c q ON p.media_id = q.media_id AND q.frame = p.frame + 2 WHERE p.x1 < q.x2 AND q.x1 < p.x2 AND p.y1 < q.y2 AND q.y1 < p.y2)
SELECT s.media_id, CAST(s.frame AS INTEGER) AS frame, CAST(count(m.x1) AS INTEGER) AS n_boxes FROM (SELECT DISTINCT media_id, unnest(range(0, {TOTAL})) AS frame FROM b0) s LEFT JOIN m ON m.media_id = s.media_id AND m.frame = s.frame GROUP BY 1, 2"""


@query(MASKS)
def per_frame_masks(spark, sf):
    """All tracks; each event type is a clip of its own."""
    every = by_type(boxed_tracks(spark, sf))
    return tracks.per_frame_masks(every, clips(every), TOTAL, 2, MARGIN, 100, 100, count=True)


@query(f"""WITH t AS (SELECT DISTINCT user_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS INTEGER) AS frame, event_id FROM events),
e AS (SELECT user_id, min(frame) AS a, max(frame) AS b FROM t GROUP BY 1), sp AS (SELECT user_id, CAST(unnest(generate_series(a, b)) AS INTEGER) AS frame FROM e),
m AS (SELECT sp.user_id, sp.frame, p.frame IS NOT NULL AS hit FROM sp LEFT JOIN (SELECT DISTINCT user_id, frame FROM t WHERE event_id % 3 <> 0) p USING (user_id, frame)),
i AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, hit ORDER BY frame) AS isl FROM m), l AS (SELECT user_id, hit, isl, count(*) AS n FROM i GROUP BY 1, 2, 3)
SELECT CAST(user_id AS VARCHAR) AS media_id, sum(n)::BIGINT AS span, coalesce(sum(n) FILTER (hit), 0)::BIGINT AS covered, coalesce(max(n) FILTER (NOT hit), 0)::BIGINT AS longest_gap,
round(coalesce(sum(n) FILTER (hit), 0) / sum(n)::DOUBLE, 4) AS coverage, (sum(n) - coalesce(sum(n) FILTER (hit), 0))::BIGINT AS gap_frames FROM l GROUP BY 1""")
def continuity_stats(spark, sf):
    e = raw_events(spark, sf).withColumn("media_id", F.col("user_id").cast("string"))
    return tracks.continuity(e, e.where("event_id % 3 <> 0"))


@query(f"WITH {ET} SELECT track_key, CASE WHEN track_key GLOB 'error:1*' THEN 'kept' WHEN track_key GLOB 'view:*' OR track_key GLOB '*:[5-7]?' THEN 'excluded' ELSE 'redacted' END AS decision FROM (SELECT DISTINCT track_key FROM et)")
def select_tracks_keep_exclude(spark, sf):
    return tracks.select_tracks(event_tracks(spark, sf).select("track_key").distinct(), ["error:1*"], ["view:*", "*:[5-7]?"])


@query(f"WITH {ET}, p AS (SELECT * FROM (VALUES (0, 'error:1*'), (1, 'missing:*'), (2, 'view:*'), (3, 'Error:*')) t(pos, pattern)) SELECT CAST(pos AS INTEGER) AS pos, pattern FROM p WHERE NOT EXISTS (SELECT 1 FROM et WHERE track_key GLOB pattern)")
def unmatched_patterns(spark, sf):
    return tracks.unmatched_patterns(event_tracks(spark, sf).select("track_key").distinct(), ["error:1*", "missing:*"], ["view:*", "Error:*"])


BY_MEDIA = ELEMENTS.replace("'clip' AS media_id", "CAST(user_id % 5 AS VARCHAR) AS media_id")


@query(f"WITH {BY_MEDIA}, fr AS (SELECT media_id, count(DISTINCT frame) AS n FROM et GROUP BY 1), x AS (SELECT {SUMMARY_COLUMNS} FROM el GROUP BY media_id) SELECT count(*) AS files_processed, sum(elements_found)::BIGINT AS elements_found, sum(critical)::BIGINT AS critical, sum(high)::BIGINT AS high, sum(medium)::BIGINT AS medium, sum(low)::BIGINT AS low, sum(n)::BIGINT AS frames_with_elements, 0::BIGINT AS kept_visible_count FROM x JOIN fr USING (media_id)")
def batch_rollup(spark, sf):
    t = event_tracks(spark, sf, (F.col("user_id") % 5).cast("string"))
    return summary.rollup(summary.summaries(t, TOTAL, event_kind()))


@query(f"WITH {ELEMENTS} SELECT CASE WHEN count_if(severity IN ('critical', 'high')) > 0 THEN 1 ELSE 0 END AS exit_code, count_if(severity IN ('critical', 'high'))::BIGINT AS findings FROM el")
def audit_gate(spark, sf):
    return summary.gate(summary.elements(event_tracks(spark, sf), TOTAL, event_kind()).withColumn("error", F.lit(None).cast("string")), "high")


@query(f"""WITH {ELEMENTS}, ex AS (SELECT 'clip' AS media_id, unnest(generate_series(700, 730)) AS frame) SELECT media_id, count(DISTINCT frame) AS frames_with_elements FROM (SELECT media_id, frame FROM et UNION ALL SELECT media_id, frame FROM ex) GROUP BY 1""")
def affected_frames_with_extras(spark, sf):
    extra = spark.createDataFrame([("clip", 700, 730)], "media_id string, first_frame int, last_frame int")
    return summary.affected_frames(event_tracks(spark, sf), extra)


@query("""WITH e AS (SELECT CAST(user_id % 7 AS VARCHAR) AS media_id, event_type, count(*) AS objects, CASE WHEN min(event_id) % 3 = 0 THEN 'pixel' WHEN min(event_id) % 3 = 1 THEN 'box' ELSE 'mixed' END AS s FROM events GROUP BY 1, 2)
SELECT media_id, CASE WHEN count_if(objects > 0) = 0 THEN 'none' WHEN min(s) = max(s) THEN min(s) ELSE 'mixed' END AS mask_source FROM e GROUP BY 1""")
def run_mask_source(spark, sf):
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 7).cast("string").alias("media_id"), "event_type").agg(F.count("*").alias("objects"), F.min("event_id").alias("first"))
    kind = F.when(F.col("first") % 3 == 0, "pixel").when(F.col("first") % 3 == 1, "box").otherwise("mixed")
    return summary.mask_source(e.withColumn("mask_source", kind))


@query(f"""WITH {BY_MEDIA}, fr AS (SELECT media_id, count(DISTINCT frame) AS n FROM et GROUP BY 1), x AS (SELECT {SUMMARY_COLUMNS} FROM el GROUP BY media_id), a AS (SELECT CAST(i AS VARCHAR) AS media_id FROM range(8) t(i))
SELECT a.media_id, coalesce(elements_found, 0) AS elements_found, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(exposure_score, 0) AS exposure_score, coalesce(n, 0) AS frames_with_elements, round(coalesce(n, 0) / {TOTAL}::DOUBLE, 3) AS share_of_frames, 0::BIGINT AS kept_visible
FROM a LEFT JOIN x USING (media_id) LEFT JOIN fr USING (media_id)""")
def summaries_without_finds(spark, sf):
    """Five media with tracks, and three in which nothing was found."""
    media = spark.range(8).select(F.col("id").cast("string").alias("media_id"))
    t = event_tracks(spark, sf, (F.col("user_id") % 5).cast("string"))
    return summary.summaries(t, TOTAL, event_kind(), media=media).drop("elements", "mode", "audio_note", "mask_source")


@query(f"""WITH {BY_MEDIA}
SELECT 2 AS exit_code, CAST((SELECT count(*) FROM el WHERE severity IN ('critical', 'high')) AS BIGINT) AS findings""")
def gate_with_errors(spark, sf):
    """A media that could not be read decides over all findings."""
    t = event_tracks(spark, sf, (F.col("user_id") % 5).cast("string"))
    errors = spark.createDataFrame([("9", "no such file")], "media_id string, error string")
    return summary.gate_summaries(summary.summaries(t, TOTAL, event_kind()), "high", errors)


# --- boxes ------------------------------------------------------------------------------------

PAIRS = """l AS (SELECT l_orderkey AS frame, l_linenumber % 2 AS side, CAST(l_partkey % 50 AS INTEGER) AS x1, CAST(l_suppkey % 50 AS INTEGER) AS y1, CAST(trunc(l_quantity + 10) AS INTEGER) AS s,
  CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS seq FROM lineitem),
b AS (SELECT frame, side, seq, x1, y1, x1 + s AS x2, y1 + s AS y2 FROM l),
pr AS (SELECT t.frame, t.seq AS i, p.seq AS j, greatest(0, least(t.x2, p.x2) - greatest(t.x1, p.x1)) * greatest(0, least(t.y2, p.y2) - greatest(t.y1, p.y1)) AS c, (t.x2 - t.x1) * (t.y2 - t.y1) AS ta, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa FROM (SELECT * FROM b WHERE side = 1) t JOIN (SELECT * FROM b WHERE side = 0) p USING (frame)),
io AS (SELECT frame, i, j, CASE WHEN ta + pa - c > 0 THEN c / (ta + pa - c)::DOUBLE ELSE 0 END AS iou FROM pr)"""


@query(f"WITH {PAIRS} SELECT frame, i AS truth, j AS found, round(iou, 6) AS iou FROM io")
def iou_pairs(spark, sf):
    """All lines: odd ones are true boxes, even ones predictions of the same frame."""
    truth, found = line_boxes(spark, sf)
    side = lambda df, seq, name: df.select("frame", F.col("seq").alias(seq), F.struct("x1", "y1", "x2", "y2").alias(name))
    return side(truth, "truth", "t").join(side(found, "found", "p"), "frame").select("frame", "truth", "found", F.round(boxes.iou(F.col("t"), F.col("p")), 6).alias("iou"))


@query(f"""WITH RECURSIVE {PAIRS}, cand AS (SELECT frame, i, list({{'j': j, 'iou': iou}} ORDER BY iou DESC, j) FILTER (iou > 0) AS cs FROM io GROUP BY 1, 2),
tr AS (SELECT b.frame, b.seq AS i, coalesce(cs, []) AS cs FROM b LEFT JOIN cand ON b.frame = cand.frame AND b.seq = cand.i WHERE side = 1),
g AS (SELECT frame, i, CASE WHEN len(cs) > 0 AND cs[1].iou >= 0.5 THEN [cs[1].j] ELSE []::INTEGER[] END AS used, CASE WHEN len(cs) > 0 THEN cs[1].iou ELSE 0 END AS best FROM tr WHERE i = 0
  UNION ALL SELECT frame, i, CASE WHEN top.iou >= 0.5 THEN list_append(used, top.j) ELSE used END, coalesce(top.iou, 0) FROM (SELECT tr.frame, tr.i, g.used, list_filter(tr.cs, lambda x: NOT list_contains(g.used, x.j))[1] AS top FROM g JOIN tr ON tr.frame = g.frame AND tr.i = g.i + 1))
SELECT 'clip' AS media_id, count(*) AS gt_boxes, count_if(best >= 0.5)::BIGINT AS hits, round(avg(CASE WHEN best >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall, round(avg(best), 4) AS mean_iou FROM g""")
def eval_recall(spark, sf):
    return boxes.recall(boxes.match_boxes(*line_boxes(spark, sf)))


CARD = "CAST(p_partkey * 37 % 101 AS DOUBLE) / 100 AS recall, CAST(p_size AS BIGINT) AS gt_boxes, CAST(p_partkey * 53 % 101 AS DOUBLE) / 100 AS mean_iou, CAST(p_partkey % 101 AS DOUBLE) / 100 AS coverage, CAST(p_size % 7 AS BIGINT) AS longest_gap"


@query(f"""WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS clip, p_partkey % 4 = 0 AS none, {CARD} FROM part)
SELECT clip, 0 AS section, 0 AS pos, CASE WHEN none THEN 'Not scored: no frames' ELSE printf('Recall at IoU 0.5: %.2f over %d boxes', recall, gt_boxes) END AS line FROM s
UNION ALL SELECT clip, 0, 1, printf('Mean best IoU: %.2f', mean_iou) FROM s WHERE NOT none UNION ALL SELECT clip, 0, 2, printf('Frames covered in the span: %.2f, longest gap %d', coverage, longest_gap) FROM s WHERE NOT none
UNION ALL SELECT clip, 1, 0, CASE WHEN none THEN 'not scored' ELSE printf('recall %.2f is below its floor 0.50', recall) END FROM s WHERE none OR recall < 0.5::DOUBLE
UNION ALL SELECT clip, 1, CASE WHEN recall < 0.5::DOUBLE THEN 1 ELSE 0 END, printf('mean iou %.2f is below its floor 0.25', mean_iou) FROM s WHERE NOT none AND mean_iou < 0.25::DOUBLE""")
def eval_report(spark, sf):
    """Report card of a clip for each part; a quarter were never scored."""
    p = table(spark, sf, "part").selectExpr("cast(p_partkey as string) AS clip", "p_partkey", *CARD.split(", "))
    none = F.col("p_partkey") % 4 == 0
    scores = p.select("clip", *[F.when(~none, F.col(c)).alias(c) for c in ("recall", "gt_boxes", "mean_iou", "coverage", "longest_gap")], F.when(none, "no frames").alias("status"))
    return reports.report_card(scores, p.select("clip", F.lit(0.5).alias("floor_recall"), F.lit(0.25).alias("floor_iou")))


SCORED = "CAST(p_partkey * 37 % 101 AS DOUBLE) / 100 AS recall, CAST(p_partkey * 53 % 101 AS DOUBLE) / 100 AS coverage, CAST(p_partkey % 250 AS DOUBLE) / 100 AS leakage"


@query(f"""SELECT p_partkey, recall, coverage, leakage, CASE WHEN g >= 0.9::DOUBLE THEN 'A' WHEN g >= 0.8::DOUBLE THEN 'B' WHEN g >= 0.65::DOUBLE THEN 'C' WHEN g >= 0.5::DOUBLE THEN 'D' ELSE 'F' END AS grade
FROM (SELECT *, 0.45::DOUBLE * recall + 0.35::DOUBLE * coverage + 0.2::DOUBLE * (1 - least(1.0::DOUBLE, leakage)) AS g FROM (SELECT p_partkey, {SCORED} FROM part))""")
def eval_grade(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey", *SCORED.split(", "))
    return df.withColumn("grade", boxes.grade(F.col("recall"), F.col("coverage"), F.col("leakage")))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS clip FROM (SELECT p_partkey, p_size, {SCORED} FROM part) WHERE p_partkey % 3 = 0 OR recall < p_size / 50::DOUBLE OR coverage < 0.3::DOUBLE")
def eval_floors(spark, sf):
    """A third of the clips were never scored."""
    p = table(spark, sf, "part").selectExpr("cast(p_partkey as string) AS clip", "p_partkey", "p_size", *SCORED.split(", "))
    return boxes.below_floors(p.where("p_partkey % 3 <> 0").select("clip", "recall", F.col("coverage").alias("mean_iou")), p.select("clip", (F.col("p_size") / 50.0).alias("floor_recall"), F.lit(0.3).alias("floor_iou")))


@query()
def iou_tracker(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    x, y = (F.col("l_partkey") % 40).cast("int"), (F.col("l_suppkey") % 40).cast("int")
    d = l.select((F.col("l_orderkey") % 64).cast("string").alias("media_id"), F.lit("box").alias("phrase"), (F.col("l_orderkey") / 64).cast("int").alias("frame"), F.col("l_linenumber").alias("seq"), x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 20).alias("y2"))
    return boxes.track_boxes(d)


@query("""WITH p AS (SELECT p_partkey, p_size * 12 AS size FROM part), k AS (SELECT *, CAST(ceil(size * 0.75::DOUBLE) AS INTEGER) AS c FROM p), n AS (SELECT *, c + (1 - c % 2) AS need FROM k)
SELECT p_partkey, size, CASE WHEN need <= 21 THEN 21 WHEN need <= 41 THEN 41 WHEN need <= 81 THEN 81 WHEN need <= 161 THEN 161 ELSE 301 END AS kernel FROM n""")
def blur_kernel_by_size(spark, sf):
    size = F.col("p_size") * 12
    return table(spark, sf, "part").select("p_partkey", size.alias("size"), boxes.blur_kernel(size, F.lit(20)).alias("kernel"))


SIZED = """sz AS (SELECT event_type AS track_key, CAST(floor(value % 97) AS INTEGER) + 1 AS w FROM events), ty AS (SELECT track_key, CAST(trunc(median(w)) AS INTEGER) AS typical FROM sz GROUP BY 1)"""


def sized_tracks(spark, sf):
    w = F.floor(F.col("value") % 97).cast("int") + 1
    box = F.array(F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), w.alias("x2"), F.lit(200).alias("y2")))
    return table(spark, sf, "events").select(F.lit("clip").alias("media_id"), F.col("event_type").alias("track_key"), F.col("event_id").cast("int").alias("frame"), box.alias("boxes"))


@query(f"WITH {SIZED} SELECT track_key, typical FROM ty")
def typical_min_dim(spark, sf):
    return boxes.typical_size(sized_tracks(spark, sf)).select("track_key", "typical")


@query(f"WITH {SIZED}, k AS (SELECT track_key, CAST(ceil(typical * 0.75::DOUBLE) AS INTEGER) AS c FROM ty), n AS (SELECT track_key, c + (1 - c % 2) AS need FROM k), m AS (SELECT track_key, CASE WHEN need <= 9 THEN 9 WHEN need <= 41 THEN 41 WHEN need <= 81 THEN 81 WHEN need <= 161 THEN 161 ELSE 301 END AS kernel FROM n) SELECT kernel, count(DISTINCT event_id) AS frames FROM events JOIN m ON event_type = track_key GROUP BY 1")
def blur_layers(spark, sf):
    return boxes.blur_layers(sized_tracks(spark, sf), 8).groupBy("kernel").agg(F.count("*").alias("frames"))


# --- speech -----------------------------------------------------------------------------------


def document_words(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("media_id"), F.posexplode(F.split("text", "[ \n]+")).alias("pos", "word"))
    clean = rows.withColumn("word", speech.clean_word(F.col("word")))
    return clean.withColumn("start", F.round(F.col("pos") * 0.3, 1)).withColumn("end", F.round(F.col("pos") * 0.3 + 0.25, 2))


WORDS_SQL = r"""w AS (SELECT CAST(doc_id AS VARCHAR) AS media_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS raw FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS ws FROM documents)),
v AS (SELECT media_id, pos, trim(trim(raw, '.,!?;:"''-')) AS word FROM w),
g AS (SELECT *, CASE WHEN lower(word) IN ('zero', 'oh') THEN '0' WHEN lower(word) = 'one' THEN '1' WHEN regexp_matches(word, '^[0-9\s.,\-()+]+$') AND regexp_matches(word, '[0-9]') THEN regexp_replace(word, '[^0-9]', '', 'g') END AS d FROM v),
i AS (SELECT *, sum(CASE WHEN d IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY pos) AS isl FROM g)"""


@query(f"WITH {WORDS_SQL} SELECT media_id, string_agg(d, '' ORDER BY pos) AS digits, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last FROM i WHERE d IS NOT NULL GROUP BY media_id, isl")
def speech_digit_runs(spark, sf):
    return speech.digit_runs(document_words(spark, sf)).select("media_id", "digits", "first", "last")


@query("""WITH h AS (SELECT event_type AS media_id, event_id, CAST(event_id AS DOUBLE) AS s, user_id % 3 AS k FROM events),
x AS (SELECT *, greatest(0::DOUBLE, s - 2.5::DOUBLE) AS a, s + 1.0::DOUBLE + 2.5::DOUBLE AS b FROM h), r AS (SELECT *, max(b) OVER (PARTITION BY media_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
n AS (SELECT *, CASE WHEN a <= reach THEN 0 ELSE 1 END AS nw FROM r), p AS (SELECT *, sum(nw) OVER (PARTITION BY media_id ORDER BY s) AS part, nw = 1 OR lag(k) OVER (PARTITION BY media_id ORDER BY s) <> k AS ch FROM n)
SELECT media_id, 'k' || CAST(arg_max(k, s) AS VARCHAR) AS kind, min(a) AS start, max(b) AS "end", string_agg(CAST(event_id AS VARCHAR), ' / ' ORDER BY s) FILTER (ch) AS text FROM p GROUP BY media_id, part""")
def speech_merge_intervals(spark, sf):
    return merged_events(table(spark, sf, "events"))


def merged_events(e):
    s = F.col("event_id").cast("double")
    return speech.merge_intervals(e.select(F.col("event_type").alias("media_id"), F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")).alias("kind"), s.alias("start"), (s + 1.0).alias("end"), F.col("event_id").cast("string").alias("text")), 2.5)


SPOKEN = """sp AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 1000003 AS VARCHAR), [9, 10, 11, 16, 13][c_custkey % 5 + 1], '42') AS d FROM customer),
sk AS (SELECT *, length(d) AS n FROM sp),
hit AS (SELECT CAST(c_custkey AS VARCHAR) AS media_id, d AS text, n, CASE WHEN n BETWEEN 13 AND 19 THEN CASE WHEN @LUHN THEN 'credit card number' END WHEN n = 9 THEN CASE WHEN d[1:3] NOT IN ('000', '666') AND d[1:3] < '900' AND d[4:5] <> '00' AND d[6:9] <> '0000' THEN 'ssn' END ELSE 'phone number' END AS kind,
  greatest(0::DOUBLE, round(0.3 - 0.35, 2)::DOUBLE) AS start, round(n * 0.3 + 0.25 + 0.35, 2)::DOUBLE AS "end" FROM sk)""".replace("@LUHN", LUHN)


@query(f'WITH {SPOKEN} SELECT media_id, kind, text, start, "end" FROM hit WHERE kind IS NOT NULL')
def spoken_pii(spark, sf):
    """A number of each customer, spoken digit by digit; some are a number of no kind."""
    return speech.find_speech_pii(spoken_numbers(spark, sf)).select("media_id", "kind", "text", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))


@query(f"""WITH {SPOKEN} SELECT media_id, printf('volume=enable=''between(t,%.2f,%.2f)'':volume=0', start, "end") AS filter FROM hit WHERE kind IS NOT NULL""")
def speech_mute_filters(spark, sf):
    return speech.mute_filter(speech.find_speech_pii(spoken_numbers(spark, sf)))


@query("""WITH h AS (SELECT event_type AS media_id, event_id, value AS s, value + 0.5::DOUBLE AS e FROM events)
SELECT media_id, 'speech:x:' || row_number() OVER (PARTITION BY media_id ORDER BY s, event_id) AS track, CAST(trunc(s * 29.97::DOUBLE) AS INTEGER) AS first_frame, CAST(trunc(e * 29.97::DOUBLE) AS INTEGER) AS last_frame FROM h""")
def speech_cover_frames(spark, sf):
    hits = table(spark, sf, "events").select(F.col("event_type").alias("media_id"), F.lit("x").alias("kind"), F.col("value").alias("start"), (F.col("value") + 0.5).alias("end"))
    return speech.cover_frames(hits, F.lit(29.97)).drop("kind")


@query("""WITH h AS (SELECT event_type AS media_id, event_id, CAST(trunc(value * 25) AS BIGINT) AS a, CAST(trunc((value + 0.5::DOUBLE) * 25) AS BIGINT) AS b FROM events)
SELECT media_id, count(*) AS n, sum(greatest(1, b - a))::BIGINT AS frames_detected, round(sum(round(greatest(1, b - a) / 20::DOUBLE, 3)), 3) AS share FROM h GROUP BY 1""")
def speech_elements(spark, sf):
    """Speech in a clip of 20 frames: it runs past the end, and so do the shares."""
    hits = table(spark, sf, "events").select(F.col("event_type").alias("media_id"), F.lit("ssn").alias("kind"), F.col("value").alias("start"), (F.col("value") + 0.5).alias("end"))
    e = speech.elements(hits, F.lit(25.0), 20)
    return e.groupBy("media_id").agg(F.count("*").alias("n"), F.sum("frames_detected").alias("frames_detected"), F.round(F.sum("share_of_clip"), 3).alias("share"))


# --- parsers ----------------------------------------------------------------------------------


def token_text(spark, sf):
    """One line of detection tokens per order; only the first of its lines has a header."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    n = lambda c: F.col(c).cast("string")
    x2, y2 = (F.col("l_partkey") + 5).cast("string"), (F.col("l_suppkey") + 5).cast("string")
    box = F.concat(F.when(F.col("l_linenumber") == 1, F.concat(F.lit("<"), (F.col("l_orderkey") % 9).cast("string"), F.lit("f>"), (F.col("l_orderkey") % 3).cast("string"))).otherwise(F.lit("")), F.lit("<|box;x1="), n("l_partkey"), F.lit(";y1="), n("l_suppkey"), F.lit(";x2="), x2, F.lit(";y2="), y2, F.lit(";w=9;h=9|>"))
    return l.groupBy(F.col("l_orderkey").alias("media_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", box.alias("t")))), lambda s: s["t"]), " ").alias("text"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS seq FROM lineitem),
g AS (SELECT *, max(CASE WHEN l_linenumber = 1 THEN seq END) OVER (PARTITION BY l_orderkey ORDER BY seq) AS hd FROM o)
SELECT l_orderkey AS media_id, CAST(seq AS INTEGER) AS seq, CASE WHEN hd IS NULL THEN 0 ELSE CAST(l_orderkey % 9 AS INTEGER) END AS frame, CAST(CASE WHEN hd IS NULL THEN seq ELSE l_orderkey % 3 + seq - hd END AS VARCHAR) AS track_id, CAST(l_partkey AS INTEGER) AS x1, CAST(l_suppkey AS INTEGER) AS y1, CAST(l_partkey + 5 AS INTEGER) AS x2, CAST(l_suppkey + 5 AS INTEGER) AS y2 FROM g""")
def parse_tokens(spark, sf):
    return parsers.parse_tokens(token_text(spark, sf)).drop("mask_h", "mask_w", "mask_payload")


JSON_LINE = """case l_linenumber % 6 when 0 then concat('{"frame": ', l_suppkey, ', "track_id": "', l_partkey, '", "box": [', l_suppkey, ',', l_partkey, ',', l_suppkey + 7, ',', l_partkey + 9, ']}')
 when 1 then concat('{"frame_index": "', l_suppkey, '", "id": ', l_partkey, ', "box": [', l_suppkey, '.7, "', l_partkey, '", ', l_suppkey + 7, '.2, ', l_partkey + 9, ']}')
 when 2 then concat('{"frame": ', l_suppkey, '.9, "box": [1, 2]}') when 3 then concat('not json ', l_partkey) when 4 then concat('{"id": "x', l_partkey, '", "box": "none"}') else '{"broken": ' end"""


def by_order(spark, sf, line: str):
    """One text per order, a line for each of its items in a total order."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.expr(line).alias("t"))))
    return l.groupBy(F.col("l_orderkey").alias("media_id")).agg(F.transform(rows, lambda s: s["t"]).alias("lines"))


ITEMS = "o AS (SELECT l_orderkey AS media_id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INTEGER) AS seq FROM lineitem)"


@query(f"""WITH {ITEMS} SELECT media_id, seq, CAST(CASE WHEN n % 6 = 4 THEN 0 ELSE s END AS INTEGER) AS frame, CASE n % 6 WHEN 2 THEN '0' WHEN 4 THEN 'x' || p ELSE CAST(p AS VARCHAR) END AS track_id,
CAST(CASE WHEN n % 6 < 2 THEN s ELSE 0 END AS INTEGER) AS x1, CAST(CASE WHEN n % 6 < 2 THEN p ELSE 0 END AS INTEGER) AS y1, CAST(CASE WHEN n % 6 < 2 THEN s + 7 ELSE 64 END AS INTEGER) AS x2, CAST(CASE WHEN n % 6 < 2 THEN p + 9 ELSE 48 END AS INTEGER) AS y2 FROM o WHERE n % 6 NOT IN (3, 5)""")
def parse_jsonl(spark, sf):
    """Fields as numbers, strings or with fractions; boxes that are none; lines that are no JSON."""
    return parsers.parse_json_lines(by_order(spark, sf, JSON_LINE).select("media_id", F.array_join("lines", "\n").alias("text")), width=64, height=48)


EVENT_LINE = """case l_linenumber when 1 then concat('data: {"type": "response.output_text.delta", "delta": "d', l_partkey, '"}') when 2 then concat('data: {"type": "response.completed", "response": {"output": [{}, {"content": [{"text": ""}, {"text": "c', l_partkey, '"}, {"text": "no"}]}]}}')
 when 3 then concat('data: raw', l_partkey) when 4 then concat('data: {"type": "other", "text": "t', l_partkey, '"}') when 5 then concat('{"output": [{"content": [{"text": "o', l_partkey, '"}, {"text": "p"}]}]}') when 6 then concat('plain', l_partkey) else 'data: [DONE]' end"""


@query(f"""WITH {ITEMS}, d AS (SELECT media_id, min(seq) FILTER (n > 6) AS done FROM o GROUP BY 1), v AS (SELECT o.*, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS r, done IS NULL OR seq < done AS live FROM o JOIN d USING (media_id))
SELECT media_id, coalesce(string_agg(CASE WHEN NOT live THEN '' ELSE CASE n WHEN 1 THEN 'd' || p WHEN 2 THEN CASE WHEN r = 1 THEN 'c' || p ELSE '' END WHEN 3 THEN 'raw' || p WHEN 4 THEN 't' || p WHEN 5 THEN 'o' || p || 'p' ELSE 'plain' || p END END, '' ORDER BY seq), '') AS text FROM v GROUP BY 1""")
def parse_sse(spark, sf):
    """An order's items as the lines of an event stream; a seventh item ends it."""
    lines = by_order(spark, sf, EVENT_LINE).select("media_id", F.posexplode("lines").alias("pos", "line"))
    return parsers.parse_events(lines)


VERDICT = """case c_custkey % 8 when 0 then concat('sure: {"lat": ', c_custkey % 210 - 105, '.12345, "lon": ', c_custkey % 400 - 200, ', "country": "C', c_nationkey, '", "city": "', c_mktsegment, '", "confidence_25km": ', c_custkey % 120, ', "cues": ["sign", " ", " bus "]} bye')
 when 1 then concat('{"lat": "', c_custkey % 90, '.5", "lon": "-7.25", "cues": "one cue"}') when 2 then '{"lat": 1, "lon": 2, "city": 5}' when 3 then '{"lon": 2}' when 4 then '{"lat": 1, "lon": 2, "cues": [1]}' when 5 then 'no json'
 when 6 then concat('{"lat": 1.00005, "lon": 2, "cues": [', array_join(transform(sequence(1, c_nationkey + 1), i -> concat('"q', i, '"')), ','), ']}') else '{"lat": "x", "lon": 2}' end"""
VERDICTS = """c AS (SELECT c_custkey, c_custkey % 8 AS k, c_nationkey, c_mktsegment, c_custkey % 210 - 105 AS la, c_custkey % 400 - 200 AS lo, c_custkey % 120 AS sure FROM customer),
v AS (SELECT *, CASE k WHEN 0 THEN abs(la) < 90 AND abs(lo) <= 180 AND sure <= 100 ELSE k IN (1, 6) END AS ok FROM c),
e AS (SELECT *, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, CASE WHEN ok THEN CASE k WHEN 0 THEN CASE WHEN la < 0 THEN la - 0.1235::DOUBLE ELSE la + 0.1235::DOUBLE END WHEN 1 THEN c_custkey % 90 + 0.5::DOUBLE ELSE 1.0001::DOUBLE END END AS lat, CASE WHEN ok THEN CASE k WHEN 0 THEN lo::DOUBLE WHEN 1 THEN -7.25::DOUBLE ELSE 2::DOUBLE END END AS lon,
  CASE WHEN ok THEN CASE k WHEN 0 THEN round(sure / 100::DOUBLE, 2) ELSE 0::DOUBLE END END AS confidence, CASE WHEN ok THEN CASE k WHEN 0 THEN 'C' || c_nationkey ELSE '' END END AS country, CASE WHEN ok THEN CASE k WHEN 0 THEN c_mktsegment ELSE '' END END AS city,
  CASE WHEN ok THEN CASE k WHEN 0 THEN ['sign', 'bus'] WHEN 1 THEN ['one cue'] ELSE list_transform(range(1, least(c_nationkey + 1, 12) + 1), lambda i: 'q' || i) END END AS cues FROM v)"""


def verdicts(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", parsers.parse_verdict(F.expr(VERDICT)).alias("v"))


@query(f"WITH {VERDICTS} SELECT c_custkey, status, round(lat, 4) AS lat, lon, confidence, country, city, array_to_string(cues, '|') AS cues FROM e")
def parse_verdict(spark, sf):
    """Estimates in and out of range, with fields as strings, missing or of the wrong kind."""
    return verdicts(spark, sf).select("c_custkey", "v.status", "v.lat", "v.lon", "v.confidence", "v.country", "v.city", F.array_join("v.cues", "|").alias("cues"))


TAG_NAMES = ["location-eng", "creation_time", "Make", "title", "encoder", "com.apple.quicktime.model", "DATE", "album"]
TAGGED = f"tg AS (SELECT CAST(p_partkey AS VARCHAR) AS media_id, p_size, unnest({TAG_NAMES}) AS name, unnest(range(0, 8)) AS i FROM part), has AS (SELECT media_id, p_size, CASE WHEN i = 0 THEN 1 WHEN i IN (1, 6) THEN 2 WHEN i IN (2, 5) THEN 3 WHEN i IN (3, 7) THEN 4 END AS pos, i FROM tg WHERE (p_size >> (i % 5)) % 2 = 1)"
LABELS = "[" + ", ".join(f"'{x}'" for x in summary.METADATA_ORDER) + "]"


def part_tags(spark, sf, probe: bool = False):
    """Tags of a container by the bits of the part's size; in a probe's JSON the odd ones are a stream's."""
    each = ", ".join(f"if(shiftright(p_size, {i % 5}) % 2 = 1, named_struct('key', '{n}', 'value', '{i}'), null)" for i, n in enumerate(TAG_NAMES))
    some = f"filter(array({each}), x -> x is not null)"
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("media_id"), F.expr(f"map_from_entries({some})").alias("tags"), "p_size")
    if not probe:
        return p
    half = lambda n: F.map_filter("tags", lambda _, v: v.cast("int") % 2 == n)
    stream = F.array(F.struct(F.lit("video").alias("codec_type"), half(1).alias("tags")), F.struct(F.lit("audio").alias("codec_type"), F.lit(None).cast("map<string,string>").alias("tags")))
    return p.select("media_id", F.to_json(F.struct(F.struct(half(0).alias("tags")).alias("format"), stream.alias("streams"))).alias("probe_json"))


@query(f"WITH {TAGGED} SELECT DISTINCT media_id, {LABELS}[pos] AS label, CASE WHEN pos = 1 THEN 'high' ELSE 'medium' END AS severity, CAST(pos AS INTEGER) AS pos FROM has WHERE pos IS NOT NULL")
def metadata_classify(spark, sf):
    return summary.metadata_findings(part_tags(spark, sf))


@query("""WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS media_id, [34853, 306, 271, 272, 36867, 999][p_size % 6 + 1] AS a, p_size % 5 = 0 AS b FROM part),
l AS (SELECT media_id, CASE WHEN a = 34853 THEN 1 WHEN a IN (306, 36867) THEN 2 WHEN a IN (271, 272) THEN 3 END AS pos FROM t UNION SELECT media_id, 5 FROM t WHERE b)
SELECT media_id, ['GPS location', 'creation time', 'device info', 'title and description', 'embedded text'][pos] AS label, CASE WHEN pos = 1 THEN 'high' ELSE 'medium' END AS severity, CAST(pos AS INTEGER) AS pos FROM l WHERE pos IS NOT NULL""")
def photo_tags(spark, sf):
    """Photos by the numbers of their tags, some with a text chunk."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("media_id"), "p_size")
    numbered = p.select("media_id", F.expr("element_at(array(34853, 306, 271, 272, 36867, 999), p_size % 6 + 1)").alias("tag"), F.lit(False).alias("embedded"))
    return summary.photo_findings(numbered.unionByName(p.where("p_size % 5 = 0").select("media_id", F.lit(None).cast("int").alias("tag"), F.lit(True).alias("embedded"))))


@query(f"WITH {TAGGED} SELECT media_id, count(*) AS tags, min(lower({TAG_NAMES}[i + 1])) AS first FROM has GROUP BY 1")
def container_tag_union(spark, sf):
    """Tags of the container and of its streams as one map, names in lower case."""
    tags = summary.container_tags(part_tags(spark, sf, probe=True))
    return tags.select("media_id", F.size("tags").cast("long").alias("tags"), F.array_min(F.map_keys("tags")).alias("first")).where("tags > 0")


# --- sampling and options ---------------------------------------------------------------------


@query(f"""WITH {ET}, s AS (SELECT *, split_part(track_key, ':', 1) AS kind FROM et WHERE frame % 10 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY frame, track_key) AS n FROM s)
SELECT media_id, kind || ':' || n AS track_key, CAST(unnest(range(frame, least(frame + 10, {TOTAL}))) AS INTEGER) AS frame FROM n""")
def sample_hold(spark, sf):
    return tracks.sample_hold(event_tracks(spark, sf).withColumn("kind", F.split("track_key", ":")[0]), 10, TOTAL)


@query(f"WITH {ET} SELECT frame, count(*) AS tracks FROM et WHERE frame < 90 GROUP BY 1")
def preview_frames(spark, sf):
    n = tracks.preview_frames(30.0, TOTAL)
    return event_tracks(spark, sf).where(F.col("frame") < n).groupBy("frame").agg(F.count("*").alias("tracks"))


@query(f"WITH {ET}, c AS (SELECT CAST(trunc(i * {TOTAL} / 9) AS INTEGER) AS frame FROM range(9) t(i)) SELECT c.frame, count(track_key) AS tracks FROM c LEFT JOIN et USING (frame) GROUP BY 1")
def contact_sheet_frames(spark, sf):
    frames = spark.createDataFrame([(i,) for i in tracks.contact_frames(TOTAL)], "frame int")
    return frames.join(event_tracks(spark, sf), "frame", "left").groupBy("frame").agg(F.count("track_key").alias("tracks"))


@query(f"WITH {ET} SELECT track_key FROM et WHERE frame = {TOTAL // 2}")
def middle_frame(spark, sf):
    return event_tracks(spark, sf).where(F.col("frame") == TOTAL // 2).select("track_key")


PRESET_ROWS = ", ".join(f"('{n}', '{m}', {a}, {b}, {c}, {len(t)})" for n, t, m, a, b, c in lookups.PRESETS)
PRESET_NAMES = [n for n, *_ in lookups.PRESETS] + ["nope"]


@query(f"""WITH o AS (SELECT p_partkey, {PRESET_NAMES}[p_partkey % 6 + 1] AS preset, CASE WHEN p_size % 2 = 0 THEN 'blur' ELSE 'pixelate' END AS mode, CASE WHEN p_size % 3 = 0 THEN 21 ELSE p_size END AS strength, CASE WHEN p_size % 5 = 0 THEN 10 ELSE p_size END AS margin, 4 AS carry FROM part),
s AS (SELECT * FROM (VALUES {PRESET_ROWS}) t(preset, m, a, b, c, n))
SELECT p_partkey, o.preset, CASE WHEN mode = 'blur' THEN coalesce(m, mode) ELSE mode END AS mode, CAST(CASE WHEN strength = 21 THEN coalesce(a, strength) ELSE strength END AS INTEGER) AS strength, CAST(CASE WHEN margin = 10 THEN coalesce(b, margin) ELSE margin END AS INTEGER) AS mask_margin, CAST(coalesce(c, carry) AS INTEGER) AS carry_frames, n AS n_targets FROM o LEFT JOIN s USING (preset)""")
def presets_resolved(spark, sf):
    names = "array(" + ", ".join(f"'{n}'" for n in PRESET_NAMES) + ")"
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"element_at({names}, cast(p_partkey % 6 + 1 as int)) AS preset", "if(p_size % 2 = 0, 'blur', 'pixelate') AS mode", "if(p_size % 3 = 0, 21, p_size) AS strength", "if(p_size % 5 = 0, 10, p_size) AS mask_margin", "4 AS carry_frames")
    out = lookups.apply_preset(rows)
    return out.select("p_partkey", "preset", "mode", "strength", "mask_margin", "carry_frames", F.when(F.col("targets").isNotNull(), F.size("targets")).alias("n_targets"))


@query(f"""WITH c AS (SELECT c_custkey, c_custkey % 4 AS k, c_mktsegment AS m, {lookups.DEFAULT_TARGETS} AS df FROM customer)
SELECT c_custkey, array_to_string(CASE WHEN k = 0 THEN df WHEN k = 1 THEN ['dog', m, 'dog'] WHEN k = 2 THEN list_concat(df, CASE WHEN m = 'face' THEN [] ELSE [m] END) ELSE list_concat(df, ['bag', m]) END, ',') AS targets FROM c""")
def targets_resolved(spark, sf):
    t = F.expr("case c_custkey % 4 when 0 then ' ; ' when 1 then concat('dog; ', c_mktsegment, ',dog') when 2 then concat(c_mktsegment, ',face') else c_mktsegment end")
    a = F.expr("if(c_custkey % 4 = 3, 'bag,face', null)")
    return table(spark, sf, "customer").select("c_custkey", F.array_join(lookups.resolve_targets(lookups.split_targets(t), lookups.split_targets(a), F.col("c_custkey") % 4 == 2), ",").alias("targets"))


@query(f"WITH {ET}, k AS (SELECT split_part(track_key, ':', 1) AS kind, track_key, count(*) AS frames FROM et GROUP BY 1, 2) SELECT kind, CAST(bucket AS INTEGER) AS bucket, count(*) AS tracks FROM (SELECT *, frames // 2 AS bucket FROM k) GROUP BY ALL")
def track_length_histogram(spark, sf):
    k = event_tracks(spark, sf).groupBy(F.split("track_key", ":")[0].alias("kind"), "track_key").agg(F.count("*").alias("frames"))
    return k.groupBy("kind", F.floor(F.col("frames") / 2).cast("int").alias("bucket")).agg(F.count("*").alias("tracks"))


# --- reports ----------------------------------------------------------------------------------


@query(f"""WITH {REPORT}, t AS (SELECT media_id, sum(detected)::BIGINT AS detected, max(longest_gap) AS longest_gap, sum(open_gaps)::BIGINT AS open_gaps FROM rp GROUP BY 1),
gp AS (SELECT media_id, track_key, frame + 1 AS a, nxt - 1 AS b, nxt - frame - 1 AS n FROM nx WHERE nxt - frame - 1 > {CARRY})
SELECT media_id, 0 AS section, 1 AS pos, 'Frames: {TOTAL}, carry window: {CARRY}' AS line FROM t
UNION ALL SELECT media_id, 1, CAST(row_number() OVER (PARTITION BY media_id ORDER BY track_key) AS INTEGER), format('Track {{}}: {{}} frames detected, span {{}} to {{}}, about {{}} filled or carried', track_key, detected, first_frame, last_frame, greatest(0, last_frame - first_frame + 1 - detected)) FROM rp
UNION ALL SELECT media_id, 2, 1, format('Detections: {{}}, longest gap: {{}}, open gaps: {{}}', detected, longest_gap, open_gaps) FROM t
UNION ALL SELECT media_id, 3, CAST(row_number() OVER (PARTITION BY media_id ORDER BY track_key, a) AS INTEGER), format('{{}}: frames {{}} to {{}}, {{}} long, NEEDS REVIEW', track_key, a, b, n) FROM gp
UNION ALL SELECT media_id, 4, 1, CASE WHEN open_gaps > 0 THEN 'Result: look at those frames before sharing' ELSE 'Result: covered throughout the tracks'' spans' END FROM t""")
def coverage_text(spark, sf):
    return reports.coverage_lines(event_tracks(spark, sf), TOTAL, CARRY)


@query(f"""WITH {ELEMENTS}, fr AS (SELECT media_id, count(DISTINCT frame) AS n FROM et GROUP BY 1), x AS (SELECT {SUMMARY_COLUMNS} FROM el GROUP BY media_id), h AS (SELECT * FROM x JOIN fr USING (media_id))
SELECT media_id, 0 AS section, 0 AS pos, format('Frames affected: {{}} of {TOTAL} ({{}}%)', n, CAST(round(100 * round(n / {TOTAL}::DOUBLE, 3)) AS INTEGER)) AS line FROM h
UNION ALL SELECT media_id, 0, 1, format('Elements: {{}}, critical {{}}, high {{}}, medium {{}}, low {{}}', elements_found, critical, high, medium, low) FROM h
UNION ALL SELECT media_id, 0, 2, format('Exposure: {{:.1f}}', exposure_score) FROM h
UNION ALL SELECT media_id, 1, CAST(row_number() OVER (PARTITION BY media_id ORDER BY severity_weight DESC, frames_detected DESC, track_key) AS INTEGER), format('[{{}}] {{}}: {{}} frames, {{}} to {{}}', upper(severity), track_key, frames_detected, first_frame, last_frame) FROM el""")
def audit_text(spark, sf):
    t = event_tracks(spark, sf)
    return reports.audit_lines(summary.summaries(t, TOTAL, event_kind()), summary.elements(t, TOTAL, event_kind()), TOTAL)


@query(f"""WITH {VERDICTS}, l AS (SELECT c_custkey, status, 'Location: near ' || city || ', ' || country || ' (' || CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '%)' AS a, array_to_string(cues[1:6], '; ') AS q FROM e)
SELECT c_custkey, 0 AS pos, CASE WHEN status = 'ok' THEN a ELSE 'Location: no estimate, not checked' END AS line FROM l UNION ALL SELECT c_custkey, 1, 'Cues: ' || q FROM l WHERE status = 'ok' AND q <> ''""")
def location_text(spark, sf):
    return verdicts(spark, sf).select("c_custkey", F.posexplode(reports.location_lines(F.col("v"))).alias("pos", "line"))


# --- readers, recognised text, boxes from providers -------------------------------------------


PROBE = """case p_partkey % 3 when 0 then concat('{"streams": [{"codec_type": "video", "width": ', p_size, ', "height": 480, "r_frame_rate": "', 1000 * p_size, '/1001", "nb_frames": "', p_partkey, '", "duration": "', p_size, '.5"}, {"codec_type": "audio"}]}')
 when 1 then concat('{"streams": [{"codec_type": "video", "width": 10, "height": ', p_size, ', "r_frame_rate": "0/0", "nb_frames": "', p_size, '"}]}') else concat('{"streams": [{"codec_type": "audio"}], "format": {"duration": "', p_size, '.5"}}') end"""


@query("""WITH p AS (SELECT p_partkey, p_size, p_partkey % 3 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN p_size WHEN 1 THEN 10 END AS width, CASE k WHEN 0 THEN 480 WHEN 1 THEN p_size END AS height, round(CASE k WHEN 0 THEN 1000 * p_size / 1001::DOUBLE ELSE 30 END, 6) AS fps, CAST(CASE k WHEN 0 THEN p_partkey WHEN 1 THEN p_size ELSE trunc((p_size + 0.5::DOUBLE) * 30) END AS INTEGER) AS frame_count,
round(CASE k WHEN 1 THEN p_size / 30::DOUBLE ELSE p_size + 0.5::DOUBLE END, 6) AS duration, k <> 1 AS has_audio FROM p""")
def probe_media(spark, sf):
    out = readers.probe(table(spark, sf, "part").select("p_partkey", F.expr(PROBE).alias("probe_json")))
    return out.select("p_partkey", "width", "height", F.round("fps", 6).alias("fps"), "frame_count", F.round("duration", 6).alias("duration"), "has_audio")


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS media_id, p_name AS w, p_size AS s FROM part)
SELECT media_id, 0 AS pos, w AS word, s::DOUBLE AS start, s + 1::DOUBLE AS "end" FROM p UNION ALL SELECT media_id, 2, 'w' || s, s + 2::DOUBLE, s + 2.5::DOUBLE FROM p WHERE s % 2 = 0""")
def transcript_table(spark, sf):
    """Words at the top or in segments; blank and malformed ones go."""
    word = lambda w, a, b: f"""'{{"word": "', {w}, '", "start": ', {a}, ', "end": ', {b}, '}}'"""
    words = f"""concat('[', {word("concat(' ', p_name, ', ')", "p_size", "p_size + 1")}, ',', {word("'...'", "1", "2")}, ',', {word("concat('w', p_size, '.')", "if(p_size % 2 = 0, cast(p_size + 2 as string), '\"?\"')", "concat(p_size + 2, '.5')")}, ']')"""
    both = F.expr(f"""if(p_partkey % 2 = 0, concat('{{"words": ', {words}, ', "segments": [{{"words": [{{"word": "no", "start": 0, "end": 1}}]}}]}}'), concat('{{"segments": [{{"words": ', {words}, '}}, {{}}]}}'))""")
    return readers.transcript_words(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("media_id"), both.alias("json")))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.lang = 'en' AND c.text = d.text)")
def cache_lookup(spark, sf):
    """Documents whose key (content, phrase, model) a cache of the English ones does not hold."""
    d = table(spark, sf, "documents").withColumn("cache_key", readers.cache_key(F.encode("text", "UTF-8"), F.lit("face"), "model-1"))
    return readers.cache_misses(d.select("doc_id", "cache_key"), d.where("lang = 'en'").select("cache_key").distinct()).select("doc_id")


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 90 AS INTEGER) AS x, 'u' || o_orderkey || '@example.com' AS mail FROM orders)
SELECT CAST(k AS VARCHAR) AS media_id, 0 AS frame, 'email' AS kind, mail AS text, 5 AS start, x + 40 AS x1, 0 AS y1, x + 160 AS x2, 12 AS y2 FROM o
UNION ALL SELECT CAST(k AS VARCHAR), 10, 'credit card number', '4242 4242 4242 4242', 0, x, 20, x + 195, 33 FROM o WHERE k % 3 = 0""")
def ocr_findings(spark, sf):
    """Recognised words of two frames for each order; blank words and words of no confidence go."""
    at = "cast(o_orderkey % 90 as int)"
    word = lambda frame, pos, text, conf, x1, y1, x2, y2: f"named_struct('frame', {frame}, 'block', 1, 'par', 1, 'line', 1, 'pos', {pos}, 'word', {text}, 'conf', {conf}D, 'x1', {at} + {x1}, 'y1', {y1}, 'x2', {at} + {x2}, 'y2', {y2})"
    mail = [word(0, 0, "'mail'", 90, 0, 2, 38, 11), word(0, 1, "concat('u', o_orderkey, '@example.com')", 90, 40, 0, 160, 12), word(0, 2, "' '", 90, 0, 0, 500, 500), word(0, 3, "'now'", 90, 162, 1, 180, 10)]
    card = [word(10, i, "if(i_ok, '4242', '4243')".replace("i_ok", "o_orderkey % 3 = 0"), 88, 50 * i, 20 + i, 50 * i + 45, 30 + i) for i in range(4)] + [word(10, 4, "'x@y.org'", -1, 0, 0, 9, 9)]
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("media_id"), F.explode(F.expr(f"array({', '.join(mail + card)})")).alias("w")).select("media_id", "w.*")
    return readers.line_findings(readers.group_words(rows)).select("media_id", "frame", "kind", "text", "start", "box.*")


@query("""SELECT l_orderkey, l_linenumber, greatest(0, least(50, round_even(l_quantity / 2 - 5, 0)::INTEGER)) AS x1, greatest(0, least(30, round_even(l_suppkey % 40 - 4.5::DOUBLE, 0)::INTEGER)) AS y1, least(50, greatest(0, round_even(l_quantity / 2 - 5 + l_linenumber, 0)::INTEGER)) AS x2, least(30, greatest(0, round_even(l_suppkey % 40 + 2.5::DOUBLE, 0)::INTEGER)) AS y2
FROM lineitem WHERE least(50, greatest(0, round_even(l_quantity / 2 - 5 + l_linenumber, 0)::INTEGER)) > greatest(0, least(50, round_even(l_quantity / 2 - 5, 0)::INTEGER)) AND least(30, greatest(0, round_even(l_suppkey % 40 + 2.5::DOUBLE, 0)::INTEGER)) > greatest(0, least(30, round_even(l_suppkey % 40 - 4.5::DOUBLE, 0)::INTEGER))""")
def clean_boxes(spark, sf):
    x, y = F.col("l_quantity") / 2 - 5, (F.col("l_suppkey") % 40).cast("double")
    box = boxes.clean_box(x, y - 4.5, x + F.col("l_linenumber"), y + 2.5, F.lit(50), F.lit(30))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).where("b is not null").select("l_orderkey", "l_linenumber", "b.*")


@query("SELECT p_partkey, CAST(trunc(p_size + 0.5::DOUBLE) AS INTEGER) AS x1, CAST(p_size AS INTEGER) AS y1, CAST(p_size + 9 AS INTEGER) AS x2, CAST(p_size + 7 AS INTEGER) AS y2 FROM part")
def points_boxes(spark, sf):
    at = lambda x, y: F.array((F.col("p_size") + x).cast("double"), (F.col("p_size") + y).cast("double"))
    corners = F.array(at(0.5, 3.25), at(4.75, 0.0), at(9.5, 4.0), at(5.0, 7.75))
    return table(spark, sf, "part").select("p_partkey", boxes.points_box(corners).alias("b")).select("p_partkey", "b.*")


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS media_id, p_partkey AS k, CAST(p_size AS INTEGER) AS s FROM part)
SELECT media_id, 'face' AS phrase, 2 * CAST(i AS INTEGER) AS frame, CAST(i AS INTEGER) AS seq, CASE WHEN i = 0 THEN CAST(s AS VARCHAR) END AS track_id, s AS x1, 2 AS y1, s + 3 AS x2, 9 AS y2 FROM p, range(3) t(i) WHERE i < k % 4""")
def provider_boxes(spark, sf):
    class BySize:
        def detect(self, path, phrase):
            key, size = map(int, path.split("/"))
            return [(2 * i, size if i == 0 else None, size, 2, size + 3, 9) for i in range(min(3, key % 4))] if phrase == "face" else []

    media = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("media_id"), F.concat_ws("/", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("path"))
    return adapters.detect(media, ["face", "screen"], BySize()).unionByName(adapters.detect(media, ["face"], adapters.Nothing()))


@query("SELECT CAST(p_partkey AS VARCHAR) AS media_id, 'face' AS phrase, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_size % 4 = 2 THEN 'cached ' || p_size ELSE 'seen ' || p_size || ' face' END AS text, p_size % 4 = 3 AS failed FROM part")
def remote_answers(spark, sf):
    """Replies of a client, line by line; some come from the cache, some requests fail."""

    class Client:
        def send(self, phrase, content):
            size = int(bytes(content).decode())
            if size % 4 != 1 and size % 4 != 0:
                raise OSError("no answer")
            yield 'data: {"type": "response.output_text.delta", "delta": "seen %d "}' % size
            yield 'data: {"type": "response.output_text.delta", "delta": "%s"}' % phrase
            yield "data: [DONE]"

    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("media_id"), F.lit("face").alias("phrase"), F.encode(F.col("p_size").cast("string"), "UTF-8").alias("content"), "p_size")
    cache = p.where("p_size % 4 = 2").select(readers.cache_key(F.col("content"), F.col("phrase"), "m").alias("cache_key"), F.lit(0).alias("pos"), F.concat(F.lit("data: cached "), F.col("p_size").cast("string")).alias("line")).distinct()
    some = p.select("content", "phrase").distinct().withColumn("media_id", F.lit("x"))
    replies = adapters.answers(some, Client(), cache, "m")
    texts = parsers.parse_events(replies, key="cache_key")
    failed = replies.where("error is not null").select("cache_key").distinct().withColumn("failed", F.lit(True))
    keyed = p.withColumn("cache_key", readers.cache_key(F.col("content"), F.col("phrase"), "m"))
    return keyed.join(texts, "cache_key", "left").join(failed, "cache_key", "left").select("media_id", "phrase", "text", F.coalesce("failed", F.lit(False)).alias("failed"))


@query(f"WITH {TAGGED} SELECT DISTINCT media_id, {LABELS}[pos] AS label FROM has WHERE pos < 3")
def metadata_survivors(spark, sf):
    """Outputs that lost all tags but places and times."""
    tags = part_tags(spark, sf)
    after = tags.withColumn("tags", F.map_filter("tags", lambda k, _: F.lower(k).startswith("location") | F.lower(k).isin("creation_time", "date")))
    return summary.survivors(summary.metadata_findings(tags), summary.metadata_findings(after)).select("media_id", "label")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN '' WHEN 2 THEN 'rubberband=pitch=' || CAST((p_size % 7 + 1) / 4::DOUBLE AS VARCHAR) END AS filter FROM part")
def audio_filters(spark, sf):
    mode = F.expr("element_at(array('keep', 'mute', 'pitch'), cast(p_partkey % 3 + 1 as int))")
    return table(spark, sf, "part").select("p_partkey", speech.audio_filter(mode, (F.col("p_size") % 7 + 1) / F.lit(4.0)).alias("filter"))


@query("""WITH w AS (SELECT p_partkey AS k, 'out/' || p_name || '-' || p_partkey || '.mp4' AS path, p_size % 4 AS n FROM part)
SELECT path, CASE WHEN n = 0 THEN path ELSE 'out/' || p_name || '-' || p_partkey || '-' || n || '.mp4' END AS unique_path FROM w JOIN part ON p_partkey = k""")
def unique_output_paths(spark, sf):
    """Paths of which the first few by number are taken."""
    p = table(spark, sf, "part").select(F.concat(F.lit("out/"), "p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("stem"), "p_size")
    taken = p.where("p_size % 4 > 0").select("stem", F.explode(F.sequence(F.lit(0), F.col("p_size") % 4 - 1)).alias("i")).select(F.concat("stem", F.when(F.col("i") > 0, F.concat(F.lit("-"), F.col("i").cast("string"))).otherwise(F.lit("")), F.lit(".mp4")).alias("path"))
    return readers.unique_paths(p.select(F.concat("stem", F.lit(".mp4")).alias("path")), taken).select("path", "unique_path")


@query(f"""WITH f AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS media_id, CAST(l_orderkey % {TOTAL} AS INTEGER) AS frame, CAST(l_partkey % 50 AS INTEGER) AS x1, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY frame, seq) AS n FROM f WHERE frame % 10 = 0), h AS (SELECT media_id, n, x1, unnest(range(frame, least(frame + 10, {TOTAL}))) AS frame FROM n)
SELECT media_id, frame::INTEGER AS frame, count(*) AS codes, min(n) AS first, sum(x1)::BIGINT AS x FROM h GROUP BY 1, 2""")
def code_tracks(spark, sf):
    """Codes found on every tenth frame, held until the next one that is looked at."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x1 = (F.col("l_partkey") % 50).cast("int")
    found = l.select((F.col("l_suppkey") % 5).cast("string").alias("media_id"), (F.col("l_orderkey") % TOTAL).cast("int").alias("frame"), order.alias("seq"), F.struct(x1.alias("x1"), F.lit(0).alias("y1"), (x1 + 5).alias("x2"), F.lit(5).alias("y2")).alias("box"))
    held = tracks.secure_tracks(tracks.scan_boxes(found, "code", 10, TOTAL))
    return held.groupBy("media_id", "frame").agg(F.count("*").alias("codes"), F.min(F.split("track_key", ":")[1].cast("long")).alias("first"), F.sum(F.col("boxes")[0]["x1"]).alias("x"))


ACTIONS = "CASE WHEN kind = 'face' THEN 'avatar' WHEN kind IN ('license plate', 'credit card number') THEN 'patch' ELSE 'fill' END"


@query(f"WITH {ELEMENTS} SELECT track_key, {ACTIONS} AS action, {ACTIONS} = 'patch' AS has_text FROM el")
def replacements(spark, sf):
    """What covers each track in replace mode."""
    tracks_ = event_tracks(spark, sf).select("track_key").distinct()
    made = textpii.replacement(F.concat_ws(":", event_kind(), "track_key")).alias("r")
    return tracks_.select("track_key", made).select("track_key", "r.action", F.col("r.text").isNotNull().alias("has_text"))


# --- streams ----------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/{name}.parquet*")


def _finished(df: DataFrame) -> DataFrame:
    """Runs a stream over all there is into the shared folder, and reads what came out."""
    spark = df.sparkSession
    base = shared_dir(spark, "stream")
    df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query(SQL["pii_hits_all"])
def stream_pii(spark, sf):
    return _finished(streams.pii_stream(_stream(spark, sf, "documents"), "doc_id", "text"))


@query("""WITH t AS (SELECT event_type, user_id, ts, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS n FROM t),
g AS (SELECT event_type, user_id, min(ts) AS a, max(ts) + INTERVAL 12 HOUR AS b, count(*) AS detections FROM s GROUP BY event_type, user_id, n)
SELECT event_type, user_id, count(*) AS sessions, sum(detections)::BIGINT AS detections FROM g WHERE b <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def stream_carry_sessions(spark, sf):
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = _finished(streams.carry_sessions(events, "ts", ["event_type", "user_id"], "12 hours"))
    return sessions.groupBy("event_type", "user_id").agg(F.count("*").alias("sessions"), F.sum("detections").alias("detections"))


@query()
def stream_tracker(spark, sf):
    l = _stream(spark, sf, "lineitem")  # noqa: E741
    x, y = (F.col("l_partkey") % 40).cast("int"), (F.col("l_suppkey") % 40).cast("int")
    d = l.select((F.col("l_orderkey") % 64).cast("string").alias("media_id"), F.lit("box").alias("phrase"), (F.col("l_orderkey") / 64).cast("int").alias("frame"), F.col("l_linenumber").alias("seq"), x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 20).alias("y2"))
    return _finished(streams.tracker_stream(d))


# --- pixels -----------------------------------------------------------------------------------


@query("""SELECT p_partkey, o AS orientation, CASE WHEN o IN (2, 3) THEN 100 - x - 9 WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN 60 - y - 5 ELSE x END AS x1, CASE WHEN o IN (3, 4) THEN 60 - y - 5 WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN 100 - x - 9 ELSE y END AS y1
FROM (SELECT p_partkey, CAST(1 + p_partkey % 8 AS INTEGER) AS o, CAST(p_partkey % 90 AS INTEGER) AS x, CAST(p_size AS INTEGER) AS y FROM part)""")
def orient_boxes(spark, sf):
    x, y = (F.col("p_partkey") % 90).cast("int"), F.col("p_size")
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 9).alias("x2"), (y + 5).alias("y2"))
    o = (1 + F.col("p_partkey") % 8).cast("int")
    out = table(spark, sf, "part").select("p_partkey", o.alias("orientation"), pixels.orient_box(box, o, F.lit(100), F.lit(60)).alias("b"))
    return out.select("p_partkey", "orientation", "b.x1", "b.y1")


@query()
def cover_pixels(spark, sf):
    """A synthetic picture for each part, covered in its box: how much detail is left there."""
    side = 48
    # keys are few bytes and pictures many: a small file is one partition, the pictures are dealt to all cores
    p = table(spark, sf, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    noise = F.concat(*[F.sha2(F.concat_ws(":", "p_partkey", F.lit(i)).cast("binary"), 512) for i in range(side * side * 3 // 128)])
    box = F.array(F.struct(F.lit(8).alias("x1"), F.lit(8).alias("y1"), F.lit(40).alias("x2"), F.lit(40).alias("y2")))
    frames = p.select("p_partkey", F.lit(side).alias("height"), F.lit(side).alias("width"), noise.cast("binary").alias("pixels"), box.alias("boxes"))
    after = pixels.cover_frames(frames, "blur", 21)
    size = F.lit(side), F.lit(side * 3)
    return after.select("p_partkey", pixels.detail(*size, F.col("pixels")).alias("detail"))

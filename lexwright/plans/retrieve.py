"""Vector search, jobs and ordered computations over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexwright.operators import jobs, series, vectors
from lexwright.plans import standins as S


def _query(spark, d):
    """The query vector: that of the smallest vec_id, one row."""
    return S.table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def vector_top_k(spark, d):
    return vectors.top_k(S.table(spark, d, "embeddings"), _query(spark, d), 20).select("vec_id", "label", "score")


def vector_best_per_label(spark, d):
    hits = vectors.top_k(S.table(spark, d, "embeddings"), _query(spark, d), 100).select("vec_id", "label", "score")
    return vectors.best_per(hits, "label")


def vector_scores(spark, d):
    """All scores of a query, as a summary by label."""
    q = F.array(*[F.lit(float(x)) for x in _query(spark, d)])
    e = S.table(spark, d, "embeddings").withColumn("score", F.round(vectors.cosine(F.col("embedding"), q), 4))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def vector_top_k_distinct(spark, d):
    return vectors.top_k_distinct(S.table(spark, d, "embeddings"), _query(spark, d), 8, "label")


def vector_merged(spark, d):
    e = S.table(spark, d, "embeddings")
    qs = [r[0] for r in e.orderBy("vec_id").limit(3).select("embedding").collect()]  # three query vectors
    return vectors.merged_hits([vectors.top_k(e, q, 15) for q in qs])


_COS = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4)"
_HITS = f"(SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q)"


def _events(spark, d):
    kinds = F.create_map(*[F.lit(x) for p in (("view", "nodes"), ("click", "titles"), ("purchase", "planned"), ("signup", "error"), ("logout", "abort")) for x in p])
    e = S.table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("seq"),
        F.when(F.col("event_id") % 29 == 0, "abort").when(F.col("event_id") % 31 == 0, "plan_failed").when(F.col("event_id") % 7 == 0, "planned").when(F.col("event_id") % 5 == 0, "error").when(F.col("event_id") % 2 == 0, "titles").otherwise("nodes").alias("kind"),
        (F.col("event_id") % 4).alias("n"), (F.col("event_id") % 15 == 0).alias("final"),
    )


def job_fold(spark, d):
    return jobs.fold_jobs(_events(spark, d))


_KIND = "CASE WHEN event_id % 29 = 0 THEN 'abort' WHEN event_id % 31 = 0 THEN 'plan_failed' WHEN event_id % 7 = 0 THEN 'planned' WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 2 = 0 THEN 'titles' ELSE 'nodes' END"
_LIVE = "s.status IN ('planning', 'running', 'completed_with_errors')"
_TERMINAL = "CASE WHEN s.error_count > 0 THEN 'completed_with_errors' ELSE 'completed' END"
JOB_FOLD_SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, {_KIND} AS kind, event_id % 4 AS n, event_id % 15 = 0 AS final FROM events),
s(job_id, k, status, total_titles, processed_titles, error_count, processed_nodes, dropped) AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT), 'planning', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM e
  UNION ALL
  SELECT s.job_id, e.k,
    CASE WHEN kind = 'planned' AND s.status = 'planning' THEN CASE WHEN n = 0 THEN 'completed' WHEN s.processed_titles >= n THEN {_TERMINAL} ELSE 'running' END
      WHEN kind = 'titles' AND {_LIVE} AND s.status <> 'planning' AND s.processed_titles + n >= s.total_titles THEN {_TERMINAL}
      WHEN kind = 'error' AND {_LIVE} AND final THEN 'failed' WHEN kind = 'plan_failed' THEN 'failed'
      WHEN kind = 'abort' AND s.status IN ('planning', 'running') THEN 'aborted' ELSE s.status END,
    CASE WHEN kind = 'planned' AND s.status = 'planning' THEN n ELSE s.total_titles END,
    s.processed_titles + CASE WHEN kind = 'titles' AND {_LIVE} THEN n ELSE 0 END,
    s.error_count + CASE WHEN kind = 'plan_failed' OR kind = 'error' AND {_LIVE} THEN 1 ELSE 0 END,
    s.processed_nodes + CASE WHEN kind = 'nodes' THEN n ELSE 0 END,
    s.dropped + CASE WHEN kind = 'planned' AND s.status <> 'planning' OR kind IN ('titles', 'error') AND NOT {_LIVE} OR kind = 'abort' AND s.status NOT IN ('planning', 'running') THEN 1 ELSE 0 END
  FROM s JOIN e ON e.job_id = s.job_id AND e.k = s.k + 1)
SELECT job_id, status, total_titles, processed_titles, error_count, processed_nodes, dropped FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY k DESC) = 1"""


def _units(spark, d):
    """Every event once more as one of a unit: seven units a job."""
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("created", "running", "nodes", "done")]), (i % 4 + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("completed", "error", "skipped")]), (i % 3 + 1).cast("int"))
    return S.table(spark, d, "events").select(
        F.col("user_id").alias("job_id"), (i % 7).alias("unit_id"), F.struct("ts", "event_id").alias("seq"), kind.alias("kind"), (i % 10).alias("n"), status.alias("status"),
        F.when(i % 3 == 1, F.concat(F.lit("e"), F.expr("repeat('x', CAST(event_id % 1500 AS INT))"))).alias("error"),
    )


def job_units(spark, d):
    u = jobs.fold_units(_units(spark, d), _events(spark, d))
    return u.select("job_id", "unit_id", "status", "total_nodes", "processed_nodes", F.length("error").alias("error_chars"), F.substring("error", 1, 11).alias("error_head")).orderBy("job_id", "unit_id")


def job_unit_totals(spark, d):
    return jobs.job_totals(_units(spark, d), _events(spark, d))


_ENDED = """, ended AS (SELECT job_id, min(k) AS k, arg_min(status, k) AS status FROM s WHERE status NOT IN ('planning', 'running', 'completed_with_errors') GROUP BY job_id),
u AS (SELECT user_id AS job_id, event_id % 7 AS unit_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, ['created', 'running', 'nodes', 'done'][event_id % 4 + 1] AS kind, event_id % 10 AS n,
  ['completed', 'error', 'skipped'][event_id % 3 + 1] AS status, CASE WHEN event_id % 3 = 1 THEN 'e' || repeat('x', CAST(event_id % 1500 AS INTEGER)) END AS error FROM events),
v AS (SELECT u.*, ended.status AS final, ended.k IS NULL OR u.k <= ended.k AS live FROM u LEFT JOIN ended USING (job_id))"""


def _unit_sql() -> tuple[str, str]:
    head = JOB_FOLD_SQL[: JOB_FOLD_SQL.rindex("SELECT job_id, status")].rstrip() + _ENDED
    one = f"""{head},
    w AS (SELECT job_id, unit_id, bool_or(kind = 'created') AS made, any_value(final) AS final, coalesce(arg_max(CASE kind WHEN 'done' THEN status ELSE 'running' END, k) FILTER (live AND kind IN ('running', 'done')), 'pending') AS status,
      arg_max_null(left(error, 1000), k) FILTER (live AND kind = 'done') AS error, coalesce(arg_max(n, k) FILTER (live AND kind = 'running'), 0) AS total_nodes, CAST(coalesce(sum(n) FILTER (kind = 'nodes'), 0) AS BIGINT) AS processed_nodes FROM v GROUP BY 1, 2),
    x AS (SELECT *, final = 'aborted' AND status IN ('pending', 'running') AS stopped FROM w WHERE made),
    y AS (SELECT job_id, unit_id, CASE WHEN stopped THEN 'aborted' ELSE status END AS status, total_nodes, processed_nodes, CASE WHEN stopped THEN coalesce(error, 'job aborted') ELSE error END AS error FROM x)
    SELECT job_id, unit_id, status, total_nodes, processed_nodes, CAST(length(error) AS INTEGER) AS error_chars, left(error, 11) AS error_head FROM y"""
    two = f"""{head}
    SELECT job_id, count(DISTINCT unit_id) FILTER (kind = 'created') AS units, CAST(coalesce(sum(n) FILTER (live AND kind = 'running'), 0) AS BIGINT) AS running_total FROM v GROUP BY 1"""
    return one, two


def job_list(spark, d):
    """The newest jobs, at most 100."""
    j = S.table(spark, d, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("updated_at"), F.count("*").alias("n_events"))
    return j.orderBy(F.desc("updated_at"), "job_id").limit(100)


def carried(spark, d):
    """The last purchase before or at each event of a user."""
    e = S.table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_id") % 6 == 0, F.col("value")).alias("law"))
    return e.select("event_id", series.carry_forward(F.col("law"), "user_id", ["ts", "event_id"]).alias("carried"))


def running_offsets(spark, d):
    l = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_partkey") % 97 + 1).alias("size"))
    return l.select("l_orderkey", "l_linenumber", series.running_before(F.col("size"), "l_orderkey", _LINE).alias("offset"), (F.col("size") - F.lag("size").over(_by_line())).alias("delta"))


def _by_line():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy(*_LINE)


#: Line numbers repeat within an order; these make the order of lines total.
_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def context_rows(spark, d):
    l = S.table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", series.in_context(F.col("l_quantity") > 48, "l_orderkey", _LINE).alias("visible"))


def _spans(spark, d):
    return S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("by"), (F.col("l_orderkey") % 5000).alias("start"), (F.col("l_orderkey") % 5000 + F.col("l_linenumber") * 3).alias("end"))


def merged_spans(spark, d):
    return series.merge_spans(_spans(spark, d), "by", "start", "end")


def as_of(spark, d):
    p = S.table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("by"), (F.col("l_orderkey") * 3).alias("at"), F.col("l_orderkey").alias("point"))
    m = S.table(spark, d, "lineitem").where("l_linenumber = 2").groupBy(F.col("l_suppkey").alias("by"), (F.col("l_orderkey") * 3 - 1).alias("start")).agg(F.max("l_partkey").alias("mark"))
    return series.as_of(p, m, "by", "at", "start", "mark").select("point", "by", "mark")


def range_join(spark, d):
    """Each line in the span of its order's first two lines."""
    spans = S.table(spark, d, "orders").select(F.col("o_orderkey"), F.lit(1).alias("first"), (F.col("o_orderkey") % 4).cast("int").alias("last"))
    hit = series.explode_ranges(spans, "first", "last", "l_linenumber").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber")
    return S.table(spark, d, "lineitem").join(hit, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(F.count("*").alias("inside"))


def overlap_join(spark, d):
    s = _spans(spark, d)
    a = s.where("start % 2 = 0").select("by", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = s.where("start % 2 = 1").select("by", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return series.overlaps(a, b, "by", 64).groupBy("by").agg(F.count("*").alias("pairs"))


def line_ends(spark, d):
    t = S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("by"), F.col("l_extendedprice").alias("end"))
    p = series.percentile_at(t, "by", "end", 0.75).withColumnRenamed("end", "p75")
    return p.join(t.groupBy("by").agg(F.median("end").alias("middle"), (F.avg((F.col("end") > 30000).cast("int")) > 0.5).alias("mostly_long")), "by")


def classification(spark, d):
    """A fixed-width table built from order lines, the law given on each order's first line only."""
    l = S.table(spark, d, "lineitem")
    text = F.concat(
        F.rpad(F.when(F.col("l_linenumber") == 3, "").otherwise((F.col("l_partkey") % 54).cast("string")), 6, " "), F.rpad(F.col("l_suppkey").cast("string"), 13, " "), F.rpad(F.col("l_returnflag"), 17, " "),
        F.rpad(F.when(F.col("l_linenumber") == 1, F.concat(F.lit("117-"), (F.col("l_orderkey") % 300).cast("string"))).otherwise(""), 9, " "), F.rpad(F.col("l_linestatus"), 21, " "), F.lit("rest"),
    )
    return series.classification_rows(l.select("l_orderkey", "l_linenumber", text.alias("line")), "l_orderkey", "l_linenumber", "line")


_SP = '(SELECT l_suppkey AS "by", l_orderkey % 5000 AS s, l_orderkey % 5000 + l_linenumber * 3 AS e FROM lineitem)'
QUERIES = {
    "vector_top_k": (vector_top_k, f"SELECT vec_id, label, score FROM {_HITS} ORDER BY score DESC, vec_id LIMIT 20"),
    "vector_best_per_label": (vector_best_per_label, f"SELECT label, score, vec_id FROM (SELECT * FROM {_HITS} ORDER BY score DESC, vec_id LIMIT 100) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1"),
    "vector_scores": (vector_scores, f"SELECT label, count(*) AS n, max(score) AS best FROM {_HITS} GROUP BY label"),
    "vector_top_k_distinct": (vector_top_k_distinct, f"SELECT label, score, vec_id FROM (SELECT * FROM {_HITS} QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1) ORDER BY score DESC, vec_id LIMIT 8"),
    "vector_merged": (vector_merged, f"""SELECT vec_id, max(score) AS score, count(*) AS n_searches FROM (SELECT e.vec_id, {_COS} AS score, q.vec_id AS qid FROM embeddings e, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 3) q
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) <= 15) GROUP BY vec_id"""),
    "job_fold": (job_fold, JOB_FOLD_SQL),
    "job_units": (job_units, _unit_sql()[0]),
    "job_unit_totals": (job_unit_totals, _unit_sql()[1]),
    "job_list": (job_list, "SELECT user_id AS job_id, max(ts) AS updated_at, count(*) AS n_events FROM events GROUP BY 1 ORDER BY updated_at DESC, job_id LIMIT 100"),
    "carry_forward": (carried, "SELECT event_id, last_value(CASE WHEN event_id % 6 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events"),
    "running_offsets": (running_offsets, """SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size - lag(size) OVER w AS delta
        FROM (SELECT *, l_partkey % 97 + 1 AS size FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"""),
    "context_rows": (context_rows, "SELECT l_orderkey, l_linenumber, bool_or(l_quantity > 48) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS visible FROM lineitem"),
    "merged_spans": (merged_spans, f"""SELECT "by", min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(f) OVER (PARTITION BY "by" ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY "by" ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM {_SP})) GROUP BY "by", g"""),
    "as_of": (as_of, """WITH m AS (SELECT l_suppkey AS by, l_orderkey * 3 - 1 AS start, max(l_partkey) AS mark FROM lineitem WHERE l_linenumber = 2 GROUP BY 1, 2)
        SELECT l_orderkey AS point, l_suppkey AS by, mark FROM lineitem l ASOF LEFT JOIN m ON m.by = l.l_suppkey AND l.l_orderkey * 3 >= m.start WHERE l_linenumber = 1"""),
    "range_join": (range_join, "SELECT l_orderkey, count(*) AS inside FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND l_linenumber BETWEEN 1 AND o_orderkey % 4 GROUP BY 1"),
    "overlap_join": (overlap_join, f"SELECT a.by, count(*) AS pairs FROM {_SP} a JOIN {_SP} b ON a.by = b.by AND a.s < b.e AND b.s < a.e WHERE a.s % 2 = 0 AND b.s % 2 = 1 GROUP BY 1"),
    "line_ends": (line_ends, """SELECT l_suppkey AS by, list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.75) AS BIGINT) + 1] AS p75, median(l_extendedprice) AS middle, avg(CAST(l_extendedprice > 30000 AS INTEGER)) > 0.5 AS mostly_long FROM lineitem GROUP BY 1"""),
    "classification_table": (classification, """SELECT l_orderkey, l_linenumber, CAST(l_partkey % 54 AS VARCHAR) AS usc_title, CAST(l_suppkey AS VARCHAR) AS usc_section, l_returnflag AS description, l_linestatus AS pub_law_sec,
        last_value(CASE WHEN l_linenumber = 1 THEN '117-' || (l_orderkey % 300) END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS public_law_number FROM lineitem QUALIFY l_linenumber <> 3"""),
}

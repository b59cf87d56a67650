"""Queries of the report job and of the text helpers, over logs made from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import reports, screens
from quire.plans.registry import query
from quire.sources import files as F_
from quire.sources import layouts as L


def log(spark, d):
    """A test log a user: events as lines in the order of their ids."""
    e = L.table(spark, d, "events")
    test, suite = F.concat(F.lit('Test "t'), (F.col("event_id") % 17).cast("string"), F.lit('"')), F.concat(F.lit('Suite "s'), (F.col("event_id") % 3).cast("string"), F.lit('"'))
    kind = F.col("event_type")
    line = (
        F.when(kind == "view", F.concat(F.lit("  ◇ "), suite, F.lit(" started."))).when(kind == "signup", F.concat(F.lit("✔ "), suite, F.lit(" passed.")))
        .when(kind == "click", F.concat(F.lit("✔ "), test, F.lit(" passed after 0.1 seconds."))).when(kind == "error", F.concat(F.lit("✘ "), test, F.lit(" failed.")))
        .otherwise(F.concat(F.lit("✘ "), test, F.lit(" recorded an issue: Expectation failed: v"), (F.col("event_id") % 7).cast("string")))
    )
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line"))


LOG = """WITH lg AS (SELECT user_id AS run_id, event_id AS line_no, event_type AS et, 't'||(event_id%17) AS tn, 's'||(event_id%3) AS sn, 'Expectation failed: v'||(event_id%7) AS msg FROM events),
sp AS (SELECT run_id, line_no, sn, (SELECT min(e.line_no) FROM lg e WHERE e.run_id=s.run_id AND e.sn=s.sn AND e.et='signup' AND e.line_no>s.line_no) AS till FROM lg s WHERE et='view'),
ts AS (SELECT run_id, line_no, tn, CASE et WHEN 'click' THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY run_id, tn ORDER BY line_no) AS rn FROM lg WHERE et IN ('click','error','purchase')) WHERE rn=1),
ms AS (SELECT run_id, tn, string_agg(msg, '; ' ORDER BY line_no) AS message FROM lg WHERE et='purchase' GROUP BY 1,2),
tests AS (SELECT ts.run_id, ts.line_no, ts.tn AS name, coalesce((SELECT arg_max(sn, sp.line_no) FROM sp WHERE sp.run_id=ts.run_id AND sp.line_no<ts.line_no AND (till IS NULL OR till>ts.line_no)), '') AS suite, status, CASE WHEN status='FAIL' THEN message END AS message FROM ts LEFT JOIN ms USING (run_id, tn)) """
ENRICHED = LOG + ", cat(key, category) AS (VALUES ('t1','core'),('t2','ocr'),('s0/t3','export'),('s1/t3','ui')), en AS (SELECT tests.*, coalesce(a.category, b.category) AS category FROM tests LEFT JOIN cat a ON a.key=name LEFT JOIN cat b ON b.key=CASE WHEN suite='' THEN '/'||name ELSE suite||'/'||name END) "


LINES = """CASE event_type WHEN 'view' THEN '  ◇ Suite "s'||(event_id%3)||'" started.' WHEN 'signup' THEN '✔ Suite "s'||(event_id%3)||'" passed.' WHEN 'click' THEN '✔ Test "t'||(event_id%17)||'" passed after 0.1 seconds.' WHEN 'error' THEN '✘ Test "t'||(event_id%17)||'" failed.' ELSE '✘ Test "t'||(event_id%17)||'" recorded an issue: Expectation failed: v'||(event_id%7) END"""


@query("s10_read_log", f"SELECT user_id::VARCHAR AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS line_no, {LINES} AS line FROM events")
def read_log(spark, d):
    """Logs written as a file a run and read back; the last file line is empty and is no line of the log."""
    path = F_.shared_path(spark, "logs")
    F_.write_logs(log(spark, d), path)
    return F_.read_log(spark, path).where("line <> ''")


@query("s12_read_catalog", "SELECT n_name AS key, r_name AS category, 'nation '||n_nationkey AS description FROM nation JOIN region ON r_regionkey=n_regionkey")
def read_catalog(spark, d):
    path = F_.shared_path(spark, "catalog")
    n, r = L.table(spark, d, "nation"), L.table(spark, d, "region")
    entries = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("key"), F.col("r_name").alias("category"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("description"))
    F_.write_catalog(entries, path)
    return F_.read_catalog(spark, path)


def tests(spark, d):
    return reports.parsed(log(spark, d))


def catalog(spark):
    return spark.createDataFrame([("t1", "core"), ("t2", "ocr"), ("s0/t3", "export"), ("s1/t3", "ui")], "key string, category string")


@query("u1_parse_log", LOG + "SELECT * FROM tests")
def parse_log(spark, d):
    return tests(spark, d)


@query("u2_enrich", ENRICHED + "SELECT run_id, name, suite, category FROM en")
def enrich(spark, d):
    return reports.enriched(tests(spark, d), catalog(spark)).select("run_id", "name", "suite", "category")


@query("u3_summary", LOG + "SELECT run_id, count(*) AS total, sum((status='PASS')::INT)::BIGINT AS pass, sum((status='FAIL')::INT)::BIGINT AS fail, 0::BIGINT AS skip FROM tests GROUP BY 1")
def summary(spark, d):
    return reports.summary(tests(spark, d))


def files(spark, d):
    p = L.table(spark, d, "lineitem")
    return p.select((F.col("l_orderkey") % 100).alias("run_id"), F.concat(F.when(F.col("l_partkey") % 3 == 0, "/a/Tests/").otherwise("/a/Sources/"), F.col("l_suppkey").cast("string"), F.lit(".x")).alias("path"), (F.col("l_partkey") % 90).alias("covered"), F.lit(100).cast("long").alias("count"))


FILES = "(SELECT l_orderkey%100 AS run_id, CASE WHEN l_partkey%3=0 THEN '/a/Tests/' ELSE '/a/Sources/' END||l_suppkey||'.x' AS path, l_partkey%90 AS covered, 100 AS count FROM lineitem)"


@query("u4_coverage", f"SELECT run_id, sum(covered)::BIGINT AS covered, sum(count)::BIGINT AS count, round(100.0::DOUBLE*sum(covered)/sum(count),6) AS percent, round(100.0::DOUBLE*sum(covered)/sum(count),6)>=44 AS enough FROM {FILES} WHERE contains(path,'/Sources/') GROUP BY 1")
def coverage(spark, d):
    return reports.coverage(files(spark, d), 44.0)


@query("s11_coverage_files", f"SELECT run_id::VARCHAR AS run_id, path, split_part(path,'/Sources/',2) AS relative, covered, count::BIGINT AS count, covered::DOUBLE AS percent FROM {FILES} WHERE contains(path,'/Sources/')")
def coverage_files(spark, d):
    """Coverage exports written as a file a run and read back."""
    path = F_.shared_path(spark, "coverage")
    F_.write_coverage(files(spark, d), path)
    return F_.read_coverage(spark, path).select("run_id", "path", reports.relative_path(F.col("path")).alias("relative"), "covered", "count", "percent")


def runs(spark, d):
    o = L.table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 10).alias("series"), F.col("o_orderkey").alias("run_no"), (F.col("o_custkey") * 37 % 1000 / 10.0).alias("percent"))


RUNS = "(SELECT o_custkey%10 AS series, o_orderkey AS run_no, (o_custkey*37%1000)/10.0::DOUBLE AS percent FROM orders)"


@query("u5_history", f"SELECT series, run_no, percent, back FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY run_no DESC) AS back FROM {RUNS}) WHERE back<=50")
def history(spark, d):
    return reports.history(runs(spark, d)).withColumn("back", F.col("back").cast("long"))


@query("u5_history_view", f"SELECT series, run_no, percent, delta, back, CASE WHEN delta>0.01 THEN 'up' WHEN delta<-0.01 THEN 'down' ELSE 'same' END AS trend FROM (SELECT *, round(percent-lead(percent) OVER w,6) AS delta, row_number() OVER w AS back FROM {RUNS} WINDOW w AS (PARTITION BY series ORDER BY run_no DESC)) WHERE back<=20")
def history_view(spark, d):
    return reports.history_view(runs(spark, d)).withColumn("back", F.col("back").cast("long"))


@query("u6_board", ENRICHED + "SELECT run_id, suite, coalesce(category, nullif(suite,''), 'Uncategorized') AS category, count(*) AS tests FROM en WHERE status='FAIL' GROUP BY 1,2,3")
def board(spark, d):
    return reports.board(reports.enriched(tests(spark, d), catalog(spark)), status="FAIL")


@query("u7_coverage_color", f"SELECT series, run_no, CASE WHEN percent>=85 THEN 'green' WHEN percent>=75 THEN 'orange' ELSE 'red' END AS color FROM {RUNS}")
def coverage_color(spark, d):
    return runs(spark, d).select("series", "run_no", reports.coverage_color(F.col("percent")).alias("color"))


@query("u8_failing", LOG + "SELECT DISTINCT run_id, tn AS name FROM lg WHERE et='error'")
def failing(spark, d):
    return reports.failing(log(spark, d))


@query("t7_first_quoted", "SELECT event_id, CASE WHEN event_type IN ('view','signup') THEN 's'||(event_id%3) ELSE 't'||(event_id%17) END AS name FROM events")
def first_quoted(spark, d):
    return log(spark, d).select(F.col("line_no").alias("event_id"), reports.first_quoted(F.col("line")).alias("name"))


@query("t8_log_lines", "SELECT event_id, event_type IN ('click','signup') AS ok, event_type NOT IN ('view','signup') AS is_test FROM events")
def log_lines(spark, d):
    t = F.trim("line")
    return log(spark, d).select(F.col("line_no").alias("event_id"), F.startswith(t, F.lit("✔")).alias("ok"), F.contains(t, F.lit('Test "')).alias("is_test"))


@query("t9_formats", "SELECT event_id, printf('%.1f', event_id/8.0)||'%' AS percent, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def formats(spark, d):
    return L.table(spark, d, "events").select("event_id", reports.percent_text(F.col("event_id") / 8.0).alias("percent"), reports.iso_text(F.col("ts")).alias("iso"))


@query("t5_status_text", "SELECT event_id, CASE event_type WHEN 'view' THEN 'No capture' WHEN 'click' THEN 'Capturing...' WHEN 'signup' THEN 'Captured '||user_id||'×'||event_id WHEN 'purchase' THEN 'Analyzed · '||user_id||' words · '||event_id||' figures' ELSE 'Error: '||event_id END AS status FROM events")
def status_text(spark, d):
    names = {"view": "idle", "click": "capturing", "signup": "captured", "purchase": "analyzed", "error": "error"}
    state = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("event_type")]
    n = F.col("event_id")
    return L.table(spark, d, "events").select("event_id", screens.status_text(state, F.col("user_id"), n, F.col("user_id"), n, n.cast("string")).alias("status"))


@query("k3_dashboard_json", LOG + """SELECT run_id, '{"fail":'||sum((status='FAIL')::INT)||',"pass":'||sum((status='PASS')::INT)||',"run_id":'||run_id||',"skip":0,"total":'||count(*)||'}' AS value FROM tests GROUP BY run_id""")
def dashboard_json(spark, d):
    s = reports.summary(tests(spark, d))
    return s.select("run_id", F.to_json(F.struct(*sorted(s.columns))).alias("value"))


@query("k4_appended_history", f"SELECT series, run_no, percent FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY run_no DESC) AS back FROM (SELECT * FROM {RUNS} WHERE run_no<=1000 UNION ALL SELECT * FROM {RUNS} WHERE run_no>1000)) WHERE back<=50")
def appended_history(spark, d):
    old, new = runs(spark, d).where("run_no <= 1000"), runs(spark, d).where("run_no > 1000")
    return reports.history(old.unionByName(new)).drop("back")

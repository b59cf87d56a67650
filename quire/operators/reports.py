"""Test logs, coverage and history as a small report job."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_quoted(line: Column) -> Column:
    """The text between the first two double quotes; null without them."""
    return F.when(line.rlike('"[^"]*"'), F.regexp_extract(line, '"([^"]*)"', 1))


def percent_text(value: Column) -> Column:
    """A number with one decimal and a percent sign; values half-way go to the even digit."""
    return F.concat(F.format_string("%.1f", F.bround(value, 1)), F.lit("%"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _with_suites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run_id, line_no, kind, name, status), sorted, as a stream: tests with the suite that is open around them.

    An end closes all open suites of its name. Open suites stand on a stack with the number of their start; one
    that was closed since is dropped when it comes to the top, so every row costs a constant time on average.
    """
    run, stack, closed, nth = object(), [], {}, 0
    for batch in batches:
        out = {"line_no": [], "name": [], "suite": [], "status": []}
        runs = []
        for of, line_no, kind, name, status in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != run:
                run, stack, closed = of, [], {}
            nth += 1
            if kind == "start":
                stack.append((name, nth))
            elif kind == "end":
                closed[name] = nth
            else:
                while stack and closed.get(stack[-1][0], 0) > stack[-1][1]:
                    stack.pop()
                runs.append(of)
                for k, v in zip(out, (line_no, name, stack[-1][0] if stack else "", status), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(runs, batch.schema.types[0]), pa.array(out["line_no"], pa.int64()), *(pa.array(out[k], pa.string()) for k in ("name", "suite", "status"))], ["run_id", *out])


def parsed(log: DataFrame) -> DataFrame:
    """``run_id, line_no, name, suite, status, message`` of each test, from ``log`` (run_id, line_no, line).

    A test counts where its name first has a result. Its suite is the last one started and not ended before
    it. Failed tests carry all their recorded failures, joined by semicolons. The lines about suites and tests
    of a run pass in order as a stream, once; no two lines of a run are joined.
    """
    d = log.withColumn("t", F.trim("line")).withColumn("name", first_quoted(F.col("t"))).where("name IS NOT NULL")
    says = lambda part: F.contains("t", F.lit(part))
    suite, glyph = says('Suite "'), F.substr("t", F.lit(1), F.lit(1))
    status = F.when(glyph == "➜", "SKIP").when(says("passed"), "PASS").when(says("failed"), "FAIL").when(says("skipped"), "SKIP")
    test = glyph.isin("➜", "✔", "✘") & says('Test "') & status.isNotNull()
    kind = F.when(suite & says("started"), "start").when(suite & (says("passed") | says("failed")), "end").when(~suite & test, "test")
    rows = d.select("run_id", F.col("line_no").cast("long").alias("line_no"), kind.alias("kind"), "name", status.alias("status")).where("kind IS NOT NULL")
    found = rows.repartition("run_id").sortWithinPartitions("run_id", "line_no").mapInArrow(_with_suites, f"run_id {log.schema['run_id'].dataType.simpleString()}, line_no long, name string, suite string, status string")
    tests = found.groupBy("run_id", "name").agg(F.min(F.struct("line_no", "suite", "status")).alias("m")).select("run_id", "name", "m.line_no", "m.suite", "m.status")
    issue = d.where((glyph == "✘") & says("recorded an issue") & says("Expectation failed:"))
    told = issue.select("run_id", "name", "line_no", F.expr("substr(t, instr(t, 'Expectation failed:'))").alias("said"))
    told = told.groupBy("run_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda s: s["said"]), "; ").alias("message"))
    out = tests.join(told, ["run_id", "name"], "left")
    return out.select("run_id", "line_no", "name", "suite", "status", F.when(F.col("status") == "FAIL", F.col("message")).alias("message"))


def enriched(tests: DataFrame, catalog: DataFrame) -> DataFrame:
    """``tests`` with the catalog's category, found by name or else by "suite/name"."""
    by = lambda key, c: catalog.select(F.col("key").alias(key), F.col("category").alias(c))
    d = tests.withColumn("node", F.concat_ws("/", "suite", "name")).join(by("name", "c1"), "name", "left").join(by("node", "c2"), "node", "left")
    return d.withColumn("category", F.coalesce("c1", "c2")).drop("c1", "c2")


def summary(tests: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return tests.groupBy("run_id").agg(F.count("*").alias("total"), n("PASS"), n("FAIL"), n("SKIP"))


def coverage(files: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Covered and counted lines of source files, their percentage (0 without lines), and whether it is enough."""
    s = files.where(F.contains("path", F.lit("/Sources/"))).groupBy("run_id").agg(F.sum("covered").alias("covered"), F.sum("count").alias("count"))
    percent = F.when(F.col("count") > 0, F.round(100.0 * F.col("covered") / F.when(F.col("count") > 0, F.col("count")), 6)).otherwise(F.lit(0.0))
    return s.withColumn("percent", percent).withColumn("enough", F.col("percent") >= threshold)


def relative_path(path: Column) -> Column:
    return F.substring_index(path, "/Sources/", -1)


def coverage_color(percent: Column, threshold: float = 85.0) -> Column:
    return F.when(percent >= threshold, "green").when(percent >= threshold - 10, "orange").otherwise("red")


def history(runs: DataFrame, keep: int = 50) -> DataFrame:
    """The last ``keep`` runs of each series."""
    w = Window.partitionBy("series").orderBy(F.desc("run_no"))
    return runs.withColumn("back", F.row_number().over(w)).where(F.col("back") <= keep)


def history_view(runs: DataFrame, show: int = 20, dead: float = 0.01) -> DataFrame:
    """The newest runs with the change against the run before; changes within ``dead`` count as none."""
    w = Window.partitionBy("series").orderBy(F.desc("run_no"))
    d = runs.withColumn("delta", F.round(F.col("percent") - F.lead("percent").over(w), 6)).withColumn("back", F.row_number().over(w))
    return d.withColumn("trend", F.when(F.col("delta") > dead, "up").when(F.col("delta") < -dead, "down").otherwise("same")).where(F.col("back") <= show)


def board(tests: DataFrame, status: str | None = None, category: str | None = None) -> DataFrame:
    """Tests by suite after the board's filters; the category falls back to the suite, then to Uncategorized."""
    c = F.coalesce("category", F.when(F.col("suite") != "", F.col("suite")), F.lit("Uncategorized"))
    d = tests.withColumn("category", c)
    d = d if status is None else d.where(F.col("status") == status)
    d = d if category is None else d.where(F.col("category") == category)
    return d.groupBy("run_id", "suite", "category").agg(F.count("*").alias("tests"))


def failing(log: DataFrame) -> DataFrame:
    """Names of failing tests, straight from the lines."""
    return log.where(F.trim("line").rlike('^✘ Test "[^"]*" failed')).select("run_id", first_quoted(F.col("line")).alias("name")).distinct()

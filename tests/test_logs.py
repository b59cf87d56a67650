"""Logs read in splits, suites by one ordered pass, and prefixes by grapheme cluster."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions.text import prefix
from quire.operators import reports
from quire.sources import files


@pytest.mark.parametrize("split", [64, 1000, 10**8])
def test_lines_are_numbered_whatever_the_splits(spark, tmp_path, split):
    rng = random.Random(split)
    logs = {}
    for run, (n, end) in enumerate([(500, "\n"), (1, ""), (0, ""), (300, "\r\n"), (40, "\r")]):
        logs[f"run-{run}.txt"] = [("x" * rng.randrange(80)) + str(i) if rng.random() < 0.8 else "" for i in range(n - 1)] + (["é end"] if n else [])
        (tmp_path / f"run-{run}.txt").write_bytes((end or "\n").join(logs[f"run-{run}.txt"]).encode() + end.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        read = files.read_log(spark, str(tmp_path))
        got = {}
        for r in read.collect():
            got.setdefault(r.run_id, {})[r.line_no] = r.line
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {k: dict(enumerate(v)) for k, v in logs.items() if v}


def plain(lines):
    """The parser written line by line."""
    active, seen, messages, out = [], {}, {}, []
    for no, line in enumerate(lines):
        t = line.strip(" ")
        quoted = t.split('"')[1] if t.count('"') > 1 else None
        if 'Suite "' in t:
            if quoted is not None and "started" in t:
                active.append(quoted)
            elif quoted is not None and ("passed" in t or "failed" in t):
                active = [a for a in active if a != quoted]
            continue
        status = "SKIP" if t[:1] == "➜" else next((s for w, s in (("passed", "PASS"), ("failed", "FAIL"), ("skipped", "SKIP")) if w in t), None)
        if t[:1] in ("➜", "✔", "✘") and 'Test "' in t and quoted is not None and status and quoted not in seen:
            seen[quoted] = (no, active[-1] if active else "", status)
        if t[:1] == "✘" and "recorded an issue" in t and "Expectation failed:" in t and quoted is not None:
            messages.setdefault(quoted, []).append(t[t.index("Expectation failed:") :])
    return {(n, *s, "; ".join(messages[n]) if s[2] == "FAIL" and n in messages else None) for n, s in seen.items()}


def test_suites_match_a_plain_parser(spark):
    rng = random.Random(7)
    logs = {}
    for run in range(12):
        lines = []
        for _ in range(200):
            s, t = f'Suite "s{rng.randrange(5)}"', f'Test "t{rng.randrange(90)}"'
            lines.append(rng.choice([f"◇ {s} started.", f"  ◇ {s} started.", f"✔ {s} passed after 1 s.", f"✘ {s} failed.", f"✔ {t} passed.", f"✘ {t} failed.", f"➜ {t} skipped.", f"✘ {t} recorded an issue: Expectation failed: v", "noise", f"✔ {t} ran", 'x "']))
        logs[run] = lines
    table = spark.createDataFrame([(run, i, line) for run, lines in logs.items() for i, line in enumerate(lines)], "run_id int, line_no long, line string")
    got = {}
    for r in reports.parsed(table.repartition(5)).collect():
        got.setdefault(r.run_id, set()).add((r.name, r.line_no, r.suite, r.status, r.message))
    assert got == {run: plain(lines) for run, lines in logs.items()}
    assert reports.parsed(table.limit(0)).count() == 0


def test_prefix_keeps_clusters_whole(spark):
    cases = {"abc": "ab", "éé": "éé", "é́x": "é́x", "🇳🇱🇩🇪🇫🇷": "🇳🇱🇩🇪", "👨‍👩‍👧x!": "👨‍👩‍👧x", "": "", "a": "a", "👍🏽👍🏽👍🏽": "👍🏽👍🏽", "각나다": "각나"}
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", prefix(F.col("t"), 2).alias("p"))
    assert {r.t: r.p for r in d.collect()} == cases

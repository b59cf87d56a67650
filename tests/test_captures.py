"""Work per capture in pieces: results are handed on before a whole Arrow batch of captures is done."""

from quire.operators import captures


def test_lines_of_many_captures_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(captures, "ROWS", 3)
    texts = {c: ["wörd" * (1 + (c + i) % 5) for i in range(c % 4 * 9)] for c in range(40)}
    words = spark.createDataFrame([(c, i, w) for c, t in texts.items() for i, w in enumerate(t)], "capture_id long, word_no long, word string").coalesce(1)
    got = {(r.capture_id, r.word_no): (r.line_no, r.x) for r in captures.flow_lines(words, "word", "word_no", 600.0, 8.0, 4.0).collect()}
    want = {}
    for c, t in texts.items():
        x, line = 0.0, 0
        for i, w in enumerate(t):
            if x > 0 and x + 8 * len(w) > 600:
                x, line = 0.0, line + 1
            want[c, i] = (line, x)
            x += 8 * len(w) + 4
    assert got == want
    assert max(n for (n,) in captures.per_capture(words, ["word_no"], [], lambda rows: [(len(rows),)], "n long").select("n").collect()) == 27

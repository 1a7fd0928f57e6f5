import html
import random
import re

from pyspark.sql import functions as F

from lexispan.operators import markup, reconcile
from lexispan.sources import files


def segments(content, names):
    """Inner texts of the elements of these names outside tables, by counting depth."""
    depth, begun, out = 0, None, []
    for piece in re.split(r"(<[^>]*>)", content):
        m = re.fullmatch(r"(?i)<(/?)(table|tr|td|th)\b[^>]*>", piece)
        name = m[2].lower() if m else None
        if name == "table":
            depth += -1 if m[1] else 1
        if begun is not None and not (name in names and depth <= 0):
            begun.append(piece)
        if name in names and depth <= 0:
            if m[1] and begun is not None:
                out.append("".join(begun))
                begun = None
            elif not m[1]:
                begun = []
    return out


def test_spans_equal_counting_depth(spark):
    rng = random.Random(2)
    parts = ["<table>", "</table>", "<tr>", "</tr>", "<TD x=1>", "</td>", "<th>", "</th>", "a", "é😀", "<b>", "<br>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(1000, None), (1001, "")], "id int, t string")
    got = {}
    for r in markup.grid(df, "id", "t", depth=0).orderBy("id", "row").collect():
        assert r["row"] == len(got.setdefault(r["id"], []))
        got[r["id"]].append(r["cells"])
    for k, t in enumerate(texts):
        # a row's own tables count from its start
        want = [segments(row, {"td", "th"}) for row in segments(t, {"tr"})]
        assert got.get(k, []) == want, t
    assert 1000 not in got and 1001 not in got


def test_nested_tables_stay_in_their_cell(spark):
    t = "<table><tr><td>a<table><tr><td>x</td></tr></table></td><th>b</th></tr><tr></tr></table><table><tr><td>c</td></tr></table>"
    df = spark.createDataFrame([("k", t)], "id string, t string")
    got = [r["cells"] for r in markup.grid(df, "id", "t").orderBy("row").collect()]
    assert got == [["a<table><tr><td>x</td></tr></table>", "b"], [], ["c"]]


FRAMED = " <table> <tr><th><table><tr><td>제1장 총칙</td></tr>\n<tr><td>제1조 &lt;목적&gt;&nbsp;<br>이<table><tr><td>1</td><td>2</td></tr></table>끝</td><td> </td></tr></table></th></tr></table>\n"


def test_frames_are_taken_off(spark, tmp_path):
    df = spark.createDataFrame([(1, FRAMED), (2, "<table><tr><td>no frame</td></tr></table>"), (3, None)], "id int, t string")
    got = [(r["id"], r["line_no"], r["line"]) for r in markup.framed_lines(df, "id", "t").orderBy("line_no").collect()]
    flat = re.sub(r"<[^>]+>", " ", "이<table><tr><td>1</td><td>2</td></tr></table>끝")
    assert got == [(1, 0, "제1장 총칙"), (1, 1, html.unescape("제1조 &lt;목적&gt;")), (1, 2, flat)]
    (tmp_path / "f.md").write_text(FRAMED)
    (tmp_path / "g.md").write_text("# 제1조\n<table><tr><td>x</td></tr></table>")
    lines = files.read_markdown_lines(spark, str(tmp_path))
    assert [r["line"] for r in lines.where(F.col("doc").endswith("f.md")).orderBy("line_no").collect()] == [x for _, _, x in got]
    assert lines.where(F.col("doc").endswith("g.md")).count() == 2


def test_next_edition_without_a_key(spark):
    import datetime as dt

    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    rng = random.Random(6)
    at = [rng.randrange(400) for _ in range(300)] + [7] * 500 + [None]  # one day holds most events
    editions = sorted(rng.sample(range(420), 25)) + [50, 50]
    events = spark.createDataFrame([(k, None if n is None else day(n)) for k, n in enumerate(at)], "id int, d date").repartition(5)
    eds = spark.createDataFrame([(day(n),) for n in editions] + [(None,)], "e date")

    def slow(n, tolerance):
        later = [e for e in editions if n is not None and e >= n]
        return day(min(later)) if later and min(later) - n <= tolerance else None

    for tolerance in (3, 400):
        got = {r["id"]: r["next"] for r in reconcile.next_edition(events, eds, "d", "e", tolerance).collect()}
        assert got == {k: slow(n, tolerance) for k, n in enumerate(at)}
    keyed = events.withColumn("g", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2))
    both = eds.withColumn("g", F.explode(F.array(F.lit(0), F.lit(1), F.lit(None).cast("int"))))
    got = {r["id"]: r["next"] for r in reconcile.next_edition(keyed, both, "d", "e", 400, "g").collect()}
    assert got == {k: slow(n, 400) for k, n in enumerate(at)}
    assert reconcile.next_edition(events, eds.limit(0), "d", "e", 9).where("next IS NOT NULL").count() == 0

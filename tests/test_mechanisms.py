"""Operators that need more than one plain step: against loops, at borders of blocks and batches."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from glossalake.functions import text as T
from glossalake.functions import translate as X
from glossalake.operators import rules as R
from glossalake.operators import slides as S
from glossalake.operators import tasks as K
from glossalake.operators import terms

# terms in texts


@pytest.mark.parametrize("lane", [1, 3, 1024])
def test_automata_find_what_in_finds(monkeypatch, lane):
    monkeypatch.setattr(terms, "LANE", lane)
    rng = random.Random(lane)
    for _ in range(60):
        letters = rng.choice(["ab", "a", "你é ab", "abcd"])
        wanted = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, rng.choice([3, 7, 25])))).encode() for _ in range(rng.randrange(1, 25))})
        texts = ["".join(rng.choice(letters + "z\n") for _ in range(rng.randrange(0, 70))).encode() for _ in range(rng.randrange(1, 12))]
        text, which = terms.search(terms.automaton(wanted), texts)
        assert sorted(zip(text.tolist(), which.tolist(), strict=True)) == sorted((i, j) for i, t in enumerate(texts) for j, w in enumerate(wanted) if w in t)


def test_one_automaton_or_many_find_the_same(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh 你好") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    texts = [(k, "".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for k in range(80)] + [(900, None), (901, ""), (5, "ab ab")]
    df = spark.createDataFrame(texts, "id int, body string")
    wanted = spark.createDataFrame([(w,) for w in [*words, words[0], "", None, "x" * 500]], "word string")
    want = sorted((k, w) for k, t in texts for w in {*words, "x" * 500} if t and w in t)
    assert len(list(terms.automata(wanted, "word", 20_000))) > 5
    monkeypatch.setattr(terms, "TOGETHER", 100)  # texts are cut, so that terms lie over borders
    for size in (terms.TABLE_BYTES, 20_000):
        found = terms.terms_in_texts(df, wanted, "id", "body", "word", size)
        assert found.columns == ["id", "word"] and sorted(map(tuple, found.collect())) == want
    assert terms.terms_in_texts(df, wanted.limit(0), "id", "body", "word").collect() == []


def test_terms_are_searched_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "abc")], "id int, body string")
    plan = terms.terms_in_texts(df, df.select(F.lit("b").alias("word")), "id", "body", "word")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan


# admission


def plain_admissions(rows, most):
    live, out = [], {}
    for key, start, end in rows:
        live = [t for t in live if t > start]
        out[key] = len(live) < most
        if out[key]:
            live.append(float("inf") if end is None else end)
    return out


def test_admissions_by_busy_periods(spark):
    rng = random.Random(2)
    rows = []
    for queue, gap in (("a", 50), ("b", 400), (None, 3000)):
        at = 0
        for k in range(400):
            at += rng.randrange(0, gap)
            rows.append((queue, f"{queue}{k:04}", at, at + rng.choice([-5, 0, 1, 300, 900]) if queue or k < 390 else None))
    df = spark.createDataFrame(rows, "queue string, task_id string, created_at long, finished_at long").repartition(7)
    got = {r.task_id: r.admitted for r in K.admissions(df, most=2, block=F.floor(F.col("created_at") / 500)).collect()}
    for queue in ("a", "b", None):
        want = plain_admissions([(k, s, e) for q, k, s, e in rows if q == queue], 2)
        assert {k: got[k] for k in want} == want
    assert K.admissions(df.limit(0)).count() == 0


def test_one_queue_is_spread_over_tasks(spark):
    n = 100_000
    start = F.col("id") * 10 + F.when(F.col("id") % 50 < 40, 0).otherwise(300)
    df = spark.range(n).select(F.lit("only").alias("queue"), F.col("id").alias("task_id"), start.alias("created_at"), (start + F.pmod(F.xxhash64("id"), F.lit(150))).alias("finished_at"))
    rows = sorted((r.created_at, r.task_id, r.finished_at) for r in df.collect())
    done = K.admissions(df, most=5).withColumn("part", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = done.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.task_id: r.admitted for r in got} == plain_admissions([(k, s, e) for s, k, e in rows], 5)
    assert len({r.part for r in got}) > 2
    assert K.busy_periods(df).select("period").distinct().count() > 1000


# the first rows of hot keys


def test_first_rows_in_two_phases(spark):
    rows = [("hot" if k % 10 else f"k{k % 7}", k * 7919 % 1000, k) for k in range(1000)] + [(None, 1, 5000), (None, 0, 5001)]
    df = spark.createDataFrame(rows, "key string, at int, id int")
    for salts in (1, 4, 32):
        got = K.top_rows(df, ["key"], [F.col("at"), F.col("id")], 5, "k", salts).collect()
        for key in {r[0] for r in rows}:
            want = sorted((at, i) for k, at, i in rows if k == key)[:5]
            assert [(r.at, r.id, r.k) for r in sorted((r for r in got if r.key == key), key=lambda r: r.k)] == [(*x, n) for n, x in enumerate(want, 1)]


# runs of one format


def plain_runs(characters):
    """As the application goes through a text, character by character."""
    out, held, start, last = [], "", None, None
    for at, c, fmt in characters:
        broken = c in "\n\r"
        if last == (fmt,) and not broken:
            held, start = held + c, at if not held else start
        else:
            if held.strip():
                out.append((held, last[0], start))
            held, start = ("", None) if broken else (c, at)
        last = (fmt,)
    if held.strip():
        out.append((held, last[0], start))
    return out


@pytest.mark.parametrize("size", [1, 3, 10, 4096])
def test_runs_are_stitched_at_borders(spark, size):
    rng = random.Random(size)
    texts = {g: [(k * 2 if g else k, rng.choice("ab \n\r　" if g else "ab"), rng.choice([None, 1, 1, 1, 2]) if g != 2 else 1) for k in range(60)] for g in range(3)}
    texts[3] = [(0, "\n", 1), (1, "a", 1), (2, "\r", 1), (3, " ", 1)]
    df = spark.createDataFrame([(g, k, c, f, 0) for g, t in texts.items() for k, c, f in t], "g int, k int, c string, font int, run int").drop("run")
    got = S.runs_by_format(df, ["g"], "k", "c", ["font"], F.floor(F.col("k") / size))
    assert got.columns == ["g", "run", "font", "c", "start"]
    rows = got.collect()
    for g, t in texts.items():
        assert [(r.c, r.font, r.start) for r in sorted((r for r in rows if r.g == g), key=lambda r: r.run)] == plain_runs(t)


def test_carriage_returns_end_runs_and_blank_runs_go(spark):
    df = spark.createDataFrame([(1, k, c, 1) for k, c in enumerate("a\rb c")] + [(2, 0, " ", 1)], "g int, k int, c string, font int")
    assert [(r.g, r.c) for r in S.runs_by_format(df, ["g"], "k", "c", ["font"]).orderBy("start").collect()] == [(1, "a"), (1, "b c")]


# translation


def flaky():
    """A translator whose class goes to the workers by value."""

    class Flaky:
        """Fails always on 'bad', once on 'late'; counts what runs side by side."""

        def __init__(self):
            self.lock, self.now, self.most, self.calls = threading.Lock(), 0, 0, []

        def __getstate__(self):
            return {}

        def __setstate__(self, state):
            self.__init__()

        def translate(self, texts, source, target):
            with self.lock:
                self.now += 1
                self.most = max(self.most, self.now)
                self.calls += texts
            time.sleep(0.01)
            with self.lock:
                self.now -= 1
            (text,) = texts
            if text == "bad" or text == "late" and self.calls.count("late") == 1:
                raise ValueError(f"no {text}")
            return [None if text == "unknown" else text.upper()]

    return Flaky()


def test_at_most_three_calls_side_by_side():
    model = flaky()
    got = X.answered(model, ["bad", "late", "unknown", *"abcdefghij"], "English", "Dutch", delay=0)
    assert got == [(None, "no bad"), ("LATE", None), (None, None), *((c.upper(), None) for c in "abcdefghij")]
    assert model.most == 3 and model.calls.count("bad") == X.ATTEMPTS and model.calls.count("late") == 2


def test_a_failing_text_leaves_the_rest_of_its_batch(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "late"), (4, None), (5, "a"), (6, "unknown")], "id int, text string").coalesce(1)
    got = {r.id: (r.text, r.translation, r.error) for r in X.translate(df, flaky(), "English", "Dutch", delay=0).collect()}
    assert got == {1: ("a", "A", None), 2: ("bad", "bad", "no bad"), 3: ("late", "LATE", None), 4: (None, "", None), 5: ("a", "A", None), 6: ("unknown", "unknown", None)}


# import and sign-on


def test_import_rows_as_the_application_takes_them(spark):
    rows = [(1, " a ", "b", None, None, "2"), (2, None, " ", "nl", "c", "1"), (3, "x", None, None, None, "是"), (4, "", "y", None, None, " TRUE "), (5, "p", "q", "", "k", "True")]
    schema = "row int, english string, chinese string, dutch string, category string, is_public string"
    parsed = R.parse_import(spark.createDataFrame(rows, schema), admin=True)
    assert [(r.row, r.is_public, r.error is None) for r in parsed.orderBy("row").collect()] == [(1, False, True), (3, True, False), (4, True, False), (5, True, True)]
    only = parsed.where("row in (1, 5)")
    assert R.import_report(only).first()[:2] == (2, 0)
    alone = R.parse_import(spark.createDataFrame([(1, "a", "b", None, None, "1"), (2, None, None, "nl", "c", "1")], schema), admin=True)
    assert R.import_report(alone).first()[:2] == (1, 0)


def test_cells_count_by_their_kind(spark):
    cell = "struct<text:string,number:double,flag:boolean,at:timestamp>"
    cells = [("2", None, None, None), (None, 2.0, None, None), (None, 0.0, None, None), (None, None, True, None), (None, None, False, None), None, (" Yes ", None, None, None), (None, 1.5, None, None)]
    rows = [(k, (None, 7.0, None, None), ("z", None, None, None), (None, 1.5, None, None), None, c) for k, c in enumerate(cells)] + [(90, (None, 0.0, None, None), None, None, None, None), (91, (None, 0.0, None, None), ("z", None, None, None), None, None, None)]
    df = spark.createDataFrame(rows, f"row int, english {cell}, chinese {cell}, dutch {cell}, category {cell}, is_public {cell}")
    got = {r.row: r for r in R.parse_import(df, admin=True).collect()}
    assert [got[k].is_public for k in range(8)] == [False, True, False, True, False, False, True, True]
    assert (got[0].english, got[0].chinese, got[0].dutch, got[0].error) == ("7", "z", "1.5", None)
    assert 90 not in got and got[91].error
    flags = spark.createDataFrame([(1.0,), (0.0,), (None,)], "x double").select(R.parse_flag(F.col("x"), DoubleType()))
    assert [r[0] for r in flags.collect()] == [True, False, False]


def test_logins_make_one_account(spark):
    users = spark.createDataFrame([(4, "ann", "a@x", "Ann", "pending"), (6, "ann", "a@x", "Other", "pending"), (9, "bob", None, "Bob", "approved")], "id int, username string, email string, display_name string, status string")
    users = users.selectExpr("*", "cast(null as string) AS sso_provider", "cast(null as string) AS sso_subject", "cast(null as timestamp) AS last_login")
    logins = [("ann", "a@x", "A1", "s1", 1), ("ann", "a@x", "", None, 2), ("bob", None, "B", "s3", 3), ("cy", "c@x", "Cy", "s4", 5), ("cy", "c@x", "Cyril", "s5", 6), ("cy", "c@x", "", "s6", 7), ("dee", None, "D", "s7", 8), ("dee", None, "", "s8", 9), (None, "n@x", "N", "s9", 10), ("", "n@x", "N", "s9", 11)]
    df = spark.createDataFrame(logins, "username string, email string, display_name string, sub string, at int")
    now = F.lit("2024-01-01").cast("timestamp")
    once = R.upserted(users, df, ["display_name"], provider="oidc", as_of=now, order="at")
    rows = {r.id: r for r in once.collect()}
    assert (rows[4].display_name, rows[4].sso_subject, rows[4].status) == ("A1", "", "pending")
    assert (rows[6].display_name, rows[6].sso_provider) == ("Other", None)
    assert (rows[9].display_name, rows[9].email, rows[9].sso_subject) == ("B", None, "s3")
    assert sorted((r.username, r.email, r.display_name, r.sso_subject, r.status) for r in rows.values() if r.id > 9) == [("cy", "c@x", "Cyril", "s6", "approved"), ("dee", None, "D", "s8", "approved")]
    assert sorted(rows) == [4, 6, 9, 10, 11]
    again = R.upserted(once, df, ["display_name"], provider="oidc", as_of=now, order="at")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.values()))


def test_numbers_of_all_scripts_are_not_translated(spark):
    texts = ["１２ ３４", "٣٤", "12.5 %", "１２　３４", "a1", "你好", "1", "...", "- +", "１a", " ７ ８"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, a string").orderBy("k").select(T.is_translatable_paragraph(F.col("a"))).collect()]
    assert got == [False, False, False, False, True, True, False, False, False, True, False]


def workbook(path, rows, late=False):
    """A workbook with text, number, flag and date cells, as spreadsheet programs write it: (type, value, style) of each cell."""
    import zipfile

    cell = lambda r, k, c: "" if c is None else f'<c r="{"ABCDE"[k]}{r}" t="{c[0]}" s="{c[2]}">' + (f"<is><t>{c[1]}</t></is>" if c[0] == "inlineStr" else f"<v>{c[1]}</v>") + "</c>"
    body = "".join(f'<row r="{r}">' + "".join(cell(r, k, c) for k, c in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook><workbookPr date1904="{int(late)}"/></workbook>')
        z.writestr("xl/styles.xml", '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")


def test_cells_of_a_sheet_keep_their_kind(spark, tmp_path):
    from datetime import datetime

    from glossalake.sources import office

    text = lambda t: ("inlineStr", t, 0)
    head = [text(h.upper()) for h in R.HEADER]
    rows = [head, [text("a"), text("b"), ("n", "1.5", 3), ("n", "45292", 1), text("2")], [text("c"), text("d"), ("b", "1", 0), ("n", "45292.5", 2), ("n", "2", 0)], [None, None, text("nl"), None, text("1")], [text("e"), text("f"), None, None, ("b", "1", 0)], [("n", "7", 0), text("g"), None, None, ("n", "45292", 1)]]
    workbook(tmp_path / "one.xlsx", rows)
    workbook(tmp_path / "two.xlsx", [[text("other")], *rows[1:]])
    workbook(tmp_path / "late.xlsx", [head, [text("x"), text("y"), None, ("n", "0", 1), None]], late=True)
    found = office.typed_sheets(spark, str(tmp_path))
    cells = found.where("file = 'one.xlsx' and row = 2").first()["cells"]
    assert (cells[2]["number"], cells[3]["at"], cells[4]["text"], cells[3]["number"]) == (1.5, datetime(2024, 1, 1), "2", None)
    parsed = R.parse_import(office.with_header(found, R.HEADER), admin=True)
    got = {(r.file, r.row): (r.english, r.chinese, r.dutch, r.is_public, r.error) for r in parsed.collect()}
    assert got == {
        ("one.xlsx", 2): ("a", "b", "1.5", False, None), ("one.xlsx", 3): ("c", "d", "true", True, None),
        ("one.xlsx", 5): ("e", "f", None, True, None), ("one.xlsx", 6): ("7", "g", None, False, None), ("late.xlsx", 2): ("x", "y", None, False, None),
    }
    assert office.sheets(spark, str(tmp_path)).where("file = 'one.xlsx' and row = 3").first()["cells"][4] == "2"
    assert {r.file: r.at for r in found.where("row = 2").select("file", F.col("cells")[3]["at"].alias("at")).collect()}["late.xlsx"] == datetime(1904, 1, 1)


@pytest.mark.parametrize("floor", [None, 0.6])
def test_the_closest_of_all_others(spark, floor):
    from glossalake.operators import similarity as E

    rng = random.Random(10)
    texts = {k: "".join(rng.choice("abAB ") for _ in range(rng.randrange(0, 12))) for k in range(40)} | {50: "", 51: "zzzz"}
    df = spark.createDataFrame([*texts.items(), (60, None)], "id long, text string")
    got = {r.id: r.best for r in E.best_of_all(df, "id", "text", floor, block=7).collect()}
    assert got == {k: E.most_similar(t, [o for j, o in texts.items() if j != k], floor) for k, t in texts.items()} | {60: None}
    alone = E.best_of_all(df.where("id = 3"), "id", "text", floor).collect()
    assert [r.best for r in alone] == [None if floor is None else texts[3]]


def test_shapes_meet_by_text_or_by_length(spark):
    from glossalake.operators import similarity as E

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcAB") for _ in range(rng.randrange(0, 9)))
    left = [(g, k, word()) for g in range(4) for k in range(15)] + [(0, 20, None)]
    right = [(g, k, word()) for g in range(4) for k in range(15)] + [(1, 20, " a\r\nb "), (5, 0, "x")]
    left += [(1, 20, "a\nb"), (6, 0, "x")]
    got = {(r.slide, r.place): r["shape"] for r in E.match_shape(*(spark.createDataFrame(x, "slide int, place int, text string") for x in (left, right)), "slide").collect()}
    want = {}
    for g, k, t in left:
        best = max(((2.0 if t == b else E.weighted(t, b) if b else 0.0, -j) for h, j, s in right if h == g and t is not None for b in [s.replace("\r\n", "\n").strip()]), default=(0, 0))
        if best[0] > 0.7:
            want[g, k] = -best[1]
    assert got == want and (1, 20) in want

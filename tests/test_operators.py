"""Cases that the SQL can't reach: fixtures of the survey, ordered state, difflib, files."""

import io
import zipfile
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossalake.functions import text as T
from glossalake.functions import values as V
from glossalake.operators import logs as L
from glossalake.operators import rules as R
from glossalake.operators import similarity as E
from glossalake.operators import slides as S
from glossalake.operators import tasks as K
from glossalake.sources import office, readers, writers


def one(spark, column, *values, types="a string"):
    return spark.createDataFrame([values or (None,)], types).select(column.alias("x")).first()["x"]


def test_log_line_shapes(spark):
    lines = ["2023-05-01 12:34:56,789 - app - INFO - m", "2023-05-01 12:34:56 - app.x - ERROR - m - n", "2023-05-01T12:34:56Z - app - INFO - z", "free text", "  ", "2023-05-01 12:34:56 - a-b - INFO - m"]
    rows = {r.raw_line: r for r in L.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert len(rows) == 5
    assert rows[lines[0]].timestamp is None and rows[lines[0]].logger == "app"
    assert str(rows[lines[1]].timestamp) == "2023-05-01 04:34:56" and rows[lines[1]].message == "m - n"
    assert str(rows[lines[2]].timestamp) == "2023-05-01 12:34:56"
    assert (rows[lines[3]].logger, rows[lines[3]].level) == ("unknown", "INFO")
    assert rows[lines[5]].logger == "unknown"
    read = L.parse(spark.createDataFrame([(lines[0],)], "value string"), strict_compat=False).first()
    assert str(read.timestamp) == "2023-05-01 04:34:56"


def test_lines_without_a_time_pass_time_filters(spark):
    parsed = L.parse(spark.createDataFrame([("x",), ("2023-05-01 12:34:56 - app - INFO - m",)], "value string"))
    start = F.lit("2030-01-01").cast("timestamp")
    assert [r.message for r in parsed.where(L.selected(start=start)).collect()] == ["x"]


def test_whitelist_beats_noise(spark):
    rules = L.NoiseFilter.preset("development")
    assert one(spark, rules.category(F.col("a")), "任务 SELECT a FROM b") == "whitelist"
    assert one(spark, rules.category(F.col("a")), "select a from b") == "sql"
    assert one(spark, rules.keeps(F.col("a")), "plain") is True
    assert len(L.SQL_PATTERNS) == 43 and len(L.HTTP_PATTERNS) == 5 and len(L.STATIC_PATTERNS) == 10


def test_dates(spark):
    assert str(one(spark, V.parse_datetime(F.col("a")), "2023-5-1 1:2:3")) == "2023-04-30 17:02:03"
    assert str(one(spark, V.parse_datetime(F.col("a")), "2023-05-01T01:02:03Z")) == "2023-05-01 01:02:03"
    assert one(spark, V.parse_datetime(F.col("a")), "nonsense") is None
    assert one(spark, V.format_datetime(V.parse_datetime(F.col("a"))), None) == ""


def test_text_edges(spark):
    assert one(spark, T.strip(F.col("a")), "　 a b \n") == "a b"
    assert one(spark, T.normalize_hard(F.col("a")), "Ä-b 中文!") == "äb中文"
    assert one(spark, T.sentences(F.col("a")), "Hello there. 12. 你好世界！") == ["Hello there", "你好世界"]
    assert one(spark, T.is_page_number(F.col("a")), "99999") is False
    assert one(spark, T.block_parts(F.col("a")), " a [block][block]b") == ["a", "b"]
    assert one(spark, T.int_list(F.col("a")), "1, 2,x") == []
    assert one(spark, T.valid_utf8(F.unhex(F.col("a"))), "41FF42") == "AB"
    assert one(spark, T.image_format(F.unhex(F.col("a"))), "89504E470D0A1A0A00").asDict() == {"format": "PNG", "media_type": "image/png"}
    assert one(spark, T.clean_food_name(F.col("a")), "糕点备案入20") == "糕点"
    assert one(spark, T.tokens(F.col("a"), "zh"), "你 好") == ["你", "好"]
    assert one(spark, V.top_ingredients(F.col("a")), "a, b,c,d") == "a、b、c等"
    assert one(spark, V.top_ingredients(F.col("a")), "") == "无成分信息"
    assert one(spark, V.annotation_note(F.col("a"), F.lit("t"), F.col("a")), "o") == "OCR: o\n翻译: t"


@pytest.mark.parametrize(("raw", "n"), [('[{"source_language":"a","target_language":"b"}]', 1), ('```json\n{"source_language":"a","target_language":"b"}\n```', 1), ('see {"source_language":"a","target_language":"b"} ok', 1), ("nothing", 0), (None, 0), ('[{"source_language":"a"}]', 0)])
def test_model_answers(spark, raw, n):
    assert len(one(spark, S.model_items(F.col("a")), raw)) == n


def test_model_answer_fixture(spark):
    raw = '[{"box_index":1,"paragraph_index":1,"source_language":"x","target_language":"你好[block]世界"},{"box_index":1,"paragraph_index":2,"source_language":"y","target_language":"这是[block]一个测试"}]'
    got = S.translations(spark.createDataFrame([("d", 0, raw)], "deck string, page_index int, answer string")).collect()
    assert {r.place: r.translated for r in got} == {"1_1": ["你好", "世界"], "1_2": ["这是", "一个测试"]}


def test_slide_fixture(spark):
    frag = "named_struct('fragment_id','f','text','{}','color',0,'underline',false,'bold',false,'escapement',0,'font_size',12.0D)"
    tree = f"array(named_struct('page_index',0,'total_boxes',1,'total_paragraphs',1,'text_boxes',array(named_struct('box_index',0,'box_id','textbox_0','box_type','t','total_paragraphs',1,'paragraphs',array(named_struct('paragraph_index',0,'paragraph_id','para_0_0','text_fragments',array({frag.format('Hello')},{frag.format(' world')})))))))"
    decks = spark.sql(f"SELECT 'd' AS deck, {tree} AS pages")
    row = S.paragraphs(S.fragments(decks)).first()
    assert (row.texts, row.combined_text, row.global_index) == (["Hello", " world"], "Hello[block] world", 0)
    assert S.deck_statistics(decks).first()[1:] == (1, 1, 1, 2)


@settings(max_examples=60, deadline=None)
@given(st.text("abcXY 12.", max_size=30), st.text("abcXY 12.", max_size=30))
def test_similarity_bounds(a, b):
    assert E.ratio(a, b) <= E.bound(a, b) + 1e-9 or not (a or b)
    for f in (E.normalized, E.penalised, E.weighted, E.characters_and_words):
        assert 0 <= f(a, b) <= 1


def test_similarity_in_spark_is_difflib(spark):
    rows = [("The quick brown fox", "The brown fox"), ("Same", "same"), ("", ""), (None, "x")]
    got = spark.createDataFrame(rows, "a string, b string").select(E.similarity()("a", "b").alias("r")).collect()
    assert [r.r for r in got] == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c", max_size=5), max_size=6), st.lists(st.text("ab c", max_size=5), max_size=6))
def test_matching_is_one_to_one(a, b):
    boxes = E.assign_boxes(a, b)
    shapes = [j for j, _ in boxes.values()]
    assert len(set(shapes)) == len(shapes) and len(boxes) == min(len(a), len(b))
    got = E.assign_paragraphs(a, [(x, f"t{k}") for k, x in enumerate(b)])
    used = [t for t, _ in got.values()]
    assert len(set(used)) == len(used)


def test_stages_of_matching():
    got = E.assign_paragraphs(["Hello", "Good day!", "The brown fox jumps"], [("Hello", "1"), ("good day", "2"), ("The quick brown fox jumps", "3")])
    assert got == {0: ("1", "exact"), 1: ("2", "normalized"), 2: ("3", "similar")}
    assert E.most_similar("abc", ["xyz", "abd"]) == "abd" and E.most_similar("abc", ["xyz"]) == "abc"
    assert E.most_similar("abc", [], None) is None and E.most_similar("abc", ["xyz"], None) == "xyz"


def test_admissions_against_a_plain_loop(spark):
    rows = [(q, k, k * 10, k * 10 + 1 + (k * 37) % 200) for q in ("a", "b") for k in range(60)]
    df = spark.createDataFrame(rows, "queue string, task_id long, created_at long, finished_at long")
    got = {(r.queue, r.task_id): r.admitted for r in K.admissions(df, most=3).collect()}
    for q in ("a", "b"):
        live = []
        for _, k, start, end in (r for r in rows if r[0] == q):
            live = [t for t in live if t > start]
            assert got[q, k] == (len(live) < 3)
            if len(live) < 3:
                live.append(end)


def test_import_rules(spark):
    rows = [(1, "a ", "b", None, None, "是"), (2, None, None, None, None, "0"), (3, "x", " ", None, None, "YES")]
    parsed = R.parse_import(spark.createDataFrame(rows, "row int, english string, chinese string, dutch string, category string, is_public string"), admin=False)
    assert [(r.row, r.is_public, r.error is None) for r in parsed.orderBy("row").collect()] == [(1, False, True), (3, False, False)]
    assert R.import_report(parsed).first()[:2] == (0, 1)
    assert R.valid_header(["English", " chinese", "dutch", "category", "is_public"]) and not R.valid_header(["a"])


def test_sheet_and_slides(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>english</t></si><si><t>你好</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(raw.getvalue())
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("ppt/slides/slide1.xml", "<sld><sp><p><r><t>Hi</t></r></p><p><r><t>you</t></r></p></sp></sld>")
    (tmp_path / "a.pptx").write_bytes(raw.getvalue())
    rows = office.sheets(spark, str(tmp_path / "*.xlsx")).orderBy("row").collect()
    assert [r.cells for r in rows] == [["english", None, "2"], ["你好"]]
    assert office.slides(spark, str(tmp_path / "*.pptx")).first().text == "Hi\nyou"


def workbook(path, sheets, order=()):
    """sheets: number -> rows of texts; order: the numbers as the workbook lists them."""
    with zipfile.ZipFile(path, "w") as z:
        for n, rows in sheets.items():
            cells = "".join(f'<row r="{k}">' + "".join(f'<c t="inlineStr"><is><t>{t}</t></is></c>' for t in row) + "</row>" for k, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")
        if order:
            z.writestr("xl/workbook.xml", '<workbook xmlns:r="x"><sheets>' + "".join(f'<sheet name="s{n}" r:id="r{n}"/>' for n in order) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{n}" Target="worksheets/sheet{n}.xml"/>' for n in order) + "</Relationships>")


def test_the_first_sheet_is_that_of_the_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {2: [["two"]], 10: [["ten"]]})
    workbook(tmp_path / "b.xlsx", {2: [["two"]], 10: [["ten"]]}, (10, 2))
    workbook(tmp_path / "c.xlsx", {})
    workbook(tmp_path / "d.xlsx", {1: [R.HEADER, ("hello", "你好", "Hallo", "x", "1")]})
    found = office.sheets(spark, str(tmp_path / "*.xlsx"))
    assert {r.file: r.cells for r in found.where("row = 1 and file < 'd'").collect()} == {"a.xlsx": ["two"], "b.xlsx": ["ten"]}
    rows = office.with_header(found, R.HEADER).collect()
    assert [(r.file, r.row, r.english, r.is_public) for r in rows] == [("d.xlsx", 2, "hello", "1")]


def test_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"p": {"ingredient": "a", "path": "x\\\\y"}}')
    assert readers.catalogue(spark, str(tmp_path / "c.json")).first().product == "p"
    assert readers.storage_used(spark, str(tmp_path)).first().files == 1
    (tmp_path / "ocr" / "img1").mkdir(parents=True)
    (tmp_path / "ocr" / "img1" / "z_content_list.json").write_text('[{"type":"text","text":"t"},{"type":"image","text":""}]')
    found = readers.ocr_results(spark, str(tmp_path / "ocr")).first()
    assert found.name == "img1" and len(found["items"]) == 2
    df = spark.createDataFrame([(2, "b\nc", "y"), (1, "a", "x")], "id int, e string, c string")
    writers.parallel_text(df, "id", "e", "c", str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out" / "e")).collect()] == ["a", "b c"]


def test_streaming_states(spark, tmp_path):
    from glossalake.streaming.tasks import task_states

    src = tmp_path / "in"
    spark.createDataFrame([("t1", 1, "processing"), ("t1", 2, "failed"), ("t2", 1, "completed")], "task_id string, seq long, status string").write.parquet(str(src))
    stream = spark.readStream.schema("task_id string, seq long, status string").parquet(str(src))
    q = task_states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.task_id, r.status, r.retry_count) for r in spark.table("states").collect()} == {("t1", "waiting", 1), ("t2", "completed", 0)}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "english", "chinese", "is_public", "username"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def events(spark, tmp_path, n=400):
    rows = [(k, k * 7919 % n, k % 7) for k in range(n)]
    df = spark.createDataFrame(rows, "event_id long, m long, user_id long")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 3600).cast("timestamp_ntz")
    df.select("event_id", ts.alias("ts"), "user_id", F.lit("click").alias("event_type"), F.lit(1.0).alias("value")).write.parquet(str(tmp_path / "events.parquet"))
    return {k: (m, u) for k, m, u in rows}


def test_task_queries_read_every_event(spark, tmp_path):
    from glossalake.plans.tasks import QUERIES as Q

    n = events(spark, tmp_path)
    d = str(tmp_path)
    status = {k: "completed" if k % 10 == 6 else K.STATUSES[k % 5] for k in n}
    of = {u: [k for k in n if n[k][1] == u] for u in range(7)}
    busy = {u: sum(status[k] == "processing" for k in of[u]) for u in of}
    waiting = {u: sorted((k for k in of[u] if status[k] == "waiting"), key=lambda k: (k % 3, n[k][0], k)) for u in of}
    want = {u: (max(10 - busy[u], 0), busy[u] + len(waiting[u]) >= 10) for u in of}
    assert {r.queue: (r.available_slots, r.queue_full) for r in Q["queue_summaries"](spark, d).collect()} == want
    assert sorted(r.task_id for r in Q["next_tasks"](spark, d).collect()) == sorted(k for u in of for k in waiting[u][: want[u][0]])
    assert {r.task_id: r.record_id for r in Q["task_records"](spark, d).collect()} == {k: None if k % 4 == 3 else k for k in n}
    order = sorted(n, key=lambda k: ((3, 2, 1, 0)[k % 4], k % 3, n[k][0], k))
    assert {r.task_id: r.place for r in Q["scheduled_tasks"](spark, d).collect()} == {k: p for p, k in enumerate(order, 1)}
    fails = {t: [k * 37 % 101 < 35 for k in range(10 * t, 10 * t + 10)] for t in range(40)}
    got = {r.task_id: (r.status, r.retry_count) for r in Q["task_retries"](spark, d).collect()}
    assert got == {t: (("waiting" if sum(f) <= 3 else "failed") if f[-1] else "processing", min(sum(f), 3)) for t, f in fails.items()}
    assert len({s for s, _ in got.values()}) == 3


def test_matching_reads_whole_texts_and_all_items(spark, tmp_path):
    from glossalake.plans.matching import QUERIES as Q

    d, same = str(tmp_path), "one sentence after another " * 10
    items = [(k, f"{same[: 60 + k % 3]}{'xyzuvw'[k % 6] * (20 + k)}") for k in range(70)] + [(99, same), (150, same + "!")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    want = {k: E.most_similar(t, [x for j, x in items if j != k], 0.3) for k, t in items}
    assert {r.item_id: r.best for r in Q["most_similar_item"](spark, d).collect()} == want
    assert want[99] == same + "!"  # far from it in the ids
    turns = [(1, 0, same + "left"), (1, 1, same + "right"), (1, 2, "zzzz" + same + "right"), (1, 3, same)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{d}/conversations.parquet")
    source = [turns[0][2], turns[1][2].upper(), turns[2][2][4:], same]
    texts = [t for *_, t in turns]
    boxes = {k: v for k, v in E.assign_boxes(texts, source).items()}
    assert {r.box: (r.shape, r.stage) for r in Q["matched_boxes"](spark, d).collect()} == boxes
    assert boxes[1] == (2, "exact")  # by what stands after 200 characters
    got = {r.place: (r.translation, r.stage) for r in Q["matched_paragraphs"](spark, d).collect()}
    assert got == E.assign_paragraphs(texts, [(x, f"T{k}") for k, x in enumerate(source)]) and got[1] == ("T2", "exact")
    assert {r.place: r.shape for r in Q["matched_shapes"](spark, d).collect()}[1] == 2


def entries(spark, rows):
    return spark.createDataFrame(rows, "id int, english string, chinese string, dutch string, category string, user_id int, is_public boolean")


OLD = [(1, "a", "x", None, None, 7, False), (2, "b", "x", None, None, 7, True), (3, "c", "x", None, None, 8, False), (4, "d", "x", None, None, 8, True), (5, "b", "x", None, None, 7, False)]


@pytest.mark.parametrize(("user", "admin", "ids"), [(7, False, {1, 5}), (8, False, {3}), (9, False, set()), (7, True, {1, 5, 2, 4}), (9, True, {2, 4})])
def test_who_may_delete(spark, user, admin, ids):
    assert {r.id for r in R.deletable(entries(spark, OLD), user, admin).collect()} == ids


@pytest.mark.parametrize(
    ("user", "admin", "change", "status"),
    [
        (7, False, (1, "z", "y", None), "changed"), (8, False, (1, "z", "y", None), "forbidden"), (8, True, (1, "z", "y", None), "forbidden"),
        (7, False, (2, "z", "y", None), "forbidden"), (9, True, (2, "z", "y", None), "changed"), (9, True, (2, "d", "y", None), "exists"),
        (9, True, (2, "a", "y", None), "changed"), (7, False, (1, "b", "y", None), "exists"), (7, False, (1, "c", "y", None), "changed"),
        (7, False, (1, "a", "y", None), "changed"), (7, False, (1, "z", "", None), "incomplete"), (7, False, (1, None, "y", None), "incomplete"),
        (7, False, (1, "z", "y", True), "forbidden"), (7, False, (1, "z", "y", False), "changed"), (7, True, (1, "d", "y", True), "exists"),
        (7, True, (1, "z", "y", True), "changed"), (9, True, (2, "z", "y", False), "changed"),
    ],
)
def test_who_may_change_what(spark, user, admin, change, status):
    asked = spark.createDataFrame([(*change[:3], None, None, change[3])], "id int, english string, chinese string, dutch string, category string, is_public boolean")
    got = {r.id: r for r in R.updated(entries(spark, OLD), asked, user, admin).collect()}
    assert got[change[0]].status == status and len(got) == len(OLD)
    old = {r[0]: r for r in OLD}
    for k, r in got.items():
        if k != change[0] or status != "changed":
            assert tuple(r)[:7] == old[k]
        else:
            assert (r.english, r.chinese) == change[1:3] and r.is_public == (old[k][6] if change[3] is None else change[3])


def test_additions_come_one_after_another(spark):
    new = [
        (1, "x", "", 9, False, False), (2, "x", "y", 9, False, False), (3, "x", "y", 9, False, False), (4, "x", "y", 8, True, False),
        (5, "p", "y", 9, True, True), (6, "p", "y", 9, False, True), (7, "p", "y", 8, False, False), (8, "p", "y", 8, True, True),
        (9, "b", "y", 9, True, True), (10, "b", "y", 9, False, False), (11, "a", "y", 7, False, False), (12, "q", "y", 6, False, True), (13, "q", "y", 6, True, True),
    ]
    rows = spark.createDataFrame(new, "row int, english string, chinese string, user_id int, is_public boolean, admin boolean")
    got = {r.row: (r.status, r.is_public) for r in R.accepted(rows, entries(spark, OLD), admin="admin").collect()}
    held = [(e, u, p) for _, e, _, _, _, u, p in OLD]
    for row, english, chinese, user, public, admin in new:  # as the application adds them
        public = public and admin
        clash = any(e == english and (p if public else u == user) for e, u, p in held)
        want = "incomplete" if not chinese else "accepted" if not clash else "exists" if any(e == english and (p if public else u == user) for _, e, _, _, _, u, p in OLD) else "repeated"
        assert got[row] == (want, public), row
        if want == "accepted":
            held.append((english, user, public))


def test_new_users_get_the_next_ids(spark):
    users = spark.createDataFrame([(4, "ann", "a@x", "Ann", "pending"), (9, "bob", "b@x", "Bob", "approved")], "id int, username string, email string, display_name string, status string")
    users = users.selectExpr("*", "cast(null as string) AS sso_provider", "cast(null as string) AS sso_subject", "cast(null as timestamp) AS last_login")
    logins = spark.createDataFrame([("ann", "a@x", "", "s1"), ("cy", "c@x", "Cy", None), ("bob", "other@x", "B", "s3")], "username string, email string, display_name string, sub string")
    got = {(r.username, r.email): r for r in R.upserted(users, logins, ["display_name"], provider="oidc").collect()}
    assert sorted(r.id for r in got.values()) == [4, 9, 10, 11]
    assert got["ann", "a@x"].display_name == "Ann" and got["ann", "a@x"].sso_subject == "s1" and got["ann", "a@x"].status == "pending"
    assert got["cy", "c@x"].status == "approved" and got["cy", "c@x"].sso_subject == "" and got["cy", "c@x"].last_login is not None
    assert got["bob", "b@x"].sso_provider is None and got["bob", "other@x"].id in (10, 11)


def test_patterns_that_java_reads_otherwise(spark):
    found = lambda text, *patterns: one(spark, L.any_pattern(F.col("a"), patterns), text)
    assert found("xaa", r"(?P<c>a)(?P=c)") and not found("xab", r"(?P<c>a)(?P=c)")
    assert found("aXbXb", r"(a)x", r"(b)x\1") and found("select x from 表", *L.SQL_PATTERNS)
    assert found("1 [abc", "[ABC") and not found("abc", "[abc")
    assert found("a{,2}", "a{,2}") in (True, False)  # runs, whichever way it is read
    assert not found(None, "a")


def test_places_over_large_groups(spark):
    from glossalake.operators.numbering import numbered

    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 500).alias("at"), "id")
    got = numbered(df, ["g"], ["at", "id"], F.floor(F.col("at") / 40)).collect()
    for g in range(3):
        rows = sorted((r.at, r.id, r.place) for r in got if r.g == g)
        assert [p for *_, p in rows] == list(range(1, len(rows) + 1))


def test_shapes_and_paragraphs_as_the_application_matches_them(spark):
    texts = spark.createDataFrame([(1, 0, "a\nb"), (1, 1, ""), (1, 2, "some longer text")], "slide int, place int, text string")
    shapes = spark.createDataFrame([(1, 0, ""), (1, 1, " a\r\nb "), (1, 2, "some longer texts")], "slide int, place int, text string")
    assert {r.place: r.shape for r in E.match_shape(texts, shapes, "slide").collect()} == {0: 1, 1: 0, 2: 2}
    left = spark.createDataFrame([(1, 0, "12.5 %"), (1, 1, "a text")], "slide int, place int, text string")
    right = spark.createDataFrame([(1, 0, "12.5 %", "t0"), (1, 1, "a text", "t1")], "slide int, place int, source string, target string")
    assert [(r.place, r.translation) for r in E.match_paragraphs(left, right, "slide").collect()] == [(1, "t1")]


def test_unknown_models_are_refused():
    from glossalake.functions.translate import DictionaryTranslator, Dispatcher

    models = Dispatcher({"a": DictionaryTranslator({"x": "y"})}, ("stop",), {"own": "mine"})
    assert models.by("a").translate(["x", "stop", "own", "z"], "English", "Dutch") == ["y", "stop", "mine", None]
    with pytest.raises(ValueError, match="unknown model"):
        models.by("b")


def test_more_text_edges(spark):
    assert one(spark, T.is_page_number(F.col("a")), "１２") and one(spark, T.is_page_number(F.col("a")), "٣٤") and not one(spark, T.is_page_number(F.col("a")), "０")
    assert one(spark, T.image_format(F.unhex(F.col("a"))), "424D").asDict() == {"format": "unknown", "media_type": "unknown"}
    assert one(spark, T.image_format(F.unhex(F.col("a"))), "524946460574542505000000")["format"] == "unknown"
    assert one(spark, T.valid_utf8(F.unhex(F.col("a"))), "41FFEFBFBD42C3") == "A\ufffdB"
    odd = L.parse(spark.createDataFrame([("\x01a\x01b\x01c\x01d",)], "value string")).first()
    assert (odd.logger, odd.level) == ("unknown", "INFO")


def test_texts_are_compared_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    try:
        for use in (lambda: E.similarity("weighted"), E.find_most_similar, E.skip_insertion):
            spark.conf.set(key, "10000")
            use()
            assert int(spark.conf.get(key)) <= 500
    finally:
        spark.conf.set(key, before)


def test_ocr_folders_hold_many_conversations_each(spark, duck, tmp_path, monkeypatch):
    from glossalake.plans import files

    rows = [(k, t, f"{k} {t}\nline two, \"quoted\"") for k in [*range(-3, 401), 10**12, 10**12 + 3] for t in (0, 1)]
    rows += [(5, None, "no turn"), (6, -2, "12 34 numbers first"), (8, 3, "  "), (9, 3, ""), (None, 0, "no conversation"), (10, 4, None), (12, 0, "12 0 a second one")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(files, "folder", lambda spark, name: str(tmp_path / name))
    got = sorted(map(tuple, files.ocr_folders(spark, str(tmp_path)).collect()), key=repr)
    sql = files.ORACLES["ocr_folders"].replace("conversations", f"'{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(duck.sql(sql).fetchall(), key=repr) and len(got) > 600
    assert len(list((tmp_path / "ocr").glob("key=*/*.txt"))) < 20  # of 406 conversations

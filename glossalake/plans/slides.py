"""Slide-tree queries over conversations (a conversation is a deck, a turn a page, a line a paragraph, a word a fragment) and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossalake.functions import literals
from glossalake.functions import values as V
from glossalake.operators import slides as S
from glossalake.plans.base import read, registry

QUERIES, ORACLES, query = registry()
_ROWS = r"""(SELECT conv_id AS deck, CAST(turn AS INTEGER) AS page_index, CAST(q.k % 2 AS INTEGER) AS box_index, CAST(q.k // 2 AS INTEGER) AS paragraph_index, CAST(w.j AS INTEGER) AS pos, w.word AS text
FROM conversations, LATERAL (SELECT unnest(string_split(text, '. ')) AS line, generate_subscripts(string_split(text, '. '), 1) - 1 AS k) q, LATERAL (SELECT unnest(string_split(q.line, ' ')) AS word, generate_subscripts(string_split(q.line, ' '), 1) - 1 AS j) w)"""
_PARAS = rf"(SELECT deck, page_index, box_index, paragraph_index, list(text ORDER BY pos) AS texts FROM {_ROWS} WHERE text <> '' GROUP BY ALL HAVING regexp_replace(string_agg(text, ''), '\s', '', 'g') <> '')"


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "conversations").select(F.col("conv_id").alias("deck"), F.col("turn").cast("int").alias("page_index"), F.posexplode(F.split("text", r"\. ")).alias("k", "line"))
    at = line.select("deck", "page_index", (F.col("k") % 2).alias("box_index"), F.floor(F.col("k") / 2).cast("int").alias("paragraph_index"), F.posexplode(F.split("line", " ")).alias("pos", "text"))
    return at.withColumns({"box_id": F.format_string("textbox_%d", "box_index"), "paragraph_id": F.format_string("para_%d_%d", "box_index", "paragraph_index"), "fragment_id": F.format_string("frag_%d", "pos"), "color": F.lit(0), "underline": F.lit(False), "bold": F.lit(False), "escapement": F.lit(0), "font_size": F.lit(12.0)})


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return S.paragraphs(_fragments(spark, d))


@query(f"SELECT deck, page_index, box_index, paragraph_index, array_to_string(texts, '[block]') AS combined_text, row_number() OVER (PARTITION BY deck ORDER BY page_index, box_index, paragraph_index) - 1 AS global_index FROM {_PARAS}")
def slide_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d).select("deck", *S.PLACE, "combined_text", F.col("global_index").cast("bigint").alias("global_index"))


@query(f"SELECT deck, page_index, '第' || (page_index + 1) || '页内容（PPT原始页面索引：' || page_index || '）：' || chr(10) || chr(10) || string_agg('【文本框' || (box_index + 1) || '-段落' || (paragraph_index + 1) || '】' || chr(10) || array_to_string(texts, '[block]') || chr(10) || chr(10), '' ORDER BY box_index, paragraph_index) AS prompt FROM {_PARAS} GROUP BY deck, page_index")
def slide_prompts(spark: SparkSession, d: str) -> DataFrame:
    return S.prompts(_paragraphs(spark, d))


@query(f"SELECT page_index, box_index, count(*) AS paragraphs, CAST(sum(len(texts)) AS BIGINT) AS fragments, avg(len(texts)) AS avg_fragments FROM {_PARAS} GROUP BY GROUPING SETS ((page_index), (page_index, box_index), ())")
def paragraph_statistics(spark: SparkSession, d: str) -> DataFrame:
    return S.paragraph_statistics(_paragraphs(spark, d))


_TREE = f"(SELECT deck, count(DISTINCT page_index) AS total_pages, count(DISTINCT (page_index, box_index)) AS total_boxes, count(DISTINCT (page_index, box_index, paragraph_index)) AS total_paragraphs, count(*) AS total_fragments FROM {_ROWS} GROUP BY deck)"


@query(f"SELECT * FROM {_TREE}")
def deck_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Over the tree that is built from fragments."""
    n = S.deck_statistics(S.rebuilt(_fragments(spark, d)))
    return n.select("deck", *(F.col(c).cast("bigint").alias(c) for c in n.columns[1:]))


@query(f"SELECT deck, page_index, box_index, paragraph_index, pos, text FROM {_ROWS}")
def tree_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Fragments to JSON trees and back."""
    trees = S.rebuilt(_fragments(spark, d)).select("deck", F.to_json("pages").alias("json"))
    return S.fragments(trees.select("deck", S.pages_of(F.col("json")).alias("pages"))).select("deck", *S.PLACE, "pos", "text")


_ANSWERS = "(SELECT conv_id AS deck, CAST(turn AS INTEGER) AS page_index, CASE conv_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'fence' ELSE 'prose' END AS form, turn FROM conversations WHERE turn % 4 <> 3)"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    item = F.to_json(F.struct(F.lit(1).alias("box_index"), F.lit(1).alias("paragraph_index"), F.lit("x").alias("source_language"), F.lit("a[block] b ").alias("target_language")))
    extra = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(","), F.replace(item, F.lit('"paragraph_index":1'), F.lit('"paragraph_index":90')))).otherwise("")
    body = F.concat(item, extra)
    k = F.col("conv_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("["), body, F.lit("]"))).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: ["), body, F.lit("] done")))
    return read(spark, d, "conversations").where("turn % 4 <> 3").select(F.col("conv_id").alias("deck"), F.col("turn").cast("int").alias("page_index"), raw.alias("answer"))


@query("SELECT deck, page_index, unnest(CASE WHEN turn % 2 = 0 THEN ['1_1', '1_90'] ELSE ['1_1'] END) AS place, 2 AS n FROM " + _ANSWERS)
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    return S.translations(_answers(spark, d)).select("deck", "page_index", "place", F.size("translated").alias("n"))


def _coverage_sql(pages: str = "true") -> str:
    """Of the pages that a condition names."""
    return f"""WITH e AS (SELECT deck, page_index, (box_index + 1) || '_' || (paragraph_index + 1) AS place, len(texts) AS n FROM {_PARAS} WHERE {pages}), a AS (SELECT deck, page_index, unnest(CASE WHEN turn % 2 = 0 THEN ['1_1', '1_90'] ELSE ['1_1'] END) AS place FROM {_ANSWERS} WHERE {pages}),
s AS (SELECT CASE WHEN a.place IS NULL THEN 'missing' WHEN e.place IS NULL THEN 'extra' WHEN e.n <> 2 THEN 'mismatch' ELSE 'ok' END AS s FROM e FULL JOIN a ON e.deck = a.deck AND e.page_index = a.page_index AND e.place = a.place)
SELECT count(*) FILTER (WHERE s <> 'extra') AS expected, count(*) FILTER (WHERE s IN ('ok', 'mismatch')) AS translated, count(*) FILTER (WHERE s = 'missing') AS missing, count(*) FILTER (WHERE s = 'extra') AS extra, count(*) FILTER (WHERE s = 'mismatch') AS mismatched, count(*) FILTER (WHERE s IN ('ok', 'mismatch')) * 100.0::DOUBLE / count(*) FILTER (WHERE s <> 'extra') AS coverage FROM s"""


def _places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Paragraphs that should be translated, and those that the answers hold, with their fragments."""
    place = F.concat_ws("_", F.col("box_index") + 1, F.col("paragraph_index") + 1)
    expected = _paragraphs(spark, d).select("deck", "page_index", place.alias("place"), F.size("texts").alias("n"))
    return expected, S.translations(_answers(spark, d)).select("deck", "page_index", "place", F.size("translated").alias("n"))


@query(_coverage_sql())
def translation_coverage(spark: SparkSession, d: str) -> DataFrame:
    return S.coverage(S.comparison(*_places(spark, d), ["deck", "page_index", "place"], "n", "n"))


@query(_coverage_sql("NOT (deck % 5 = 0 AND page_index % 2 = 0)"))
def translation_coverage_of_good_pages(spark: SparkSession, d: str) -> DataFrame:
    """What lies on a page that failed is neither missing nor extra."""
    failed = read(spark, d, "conversations").where("conv_id % 5 = 0 and turn % 2 = 0").select(F.col("conv_id").alias("deck"), F.col("turn").cast("int").alias("page_index")).distinct()
    return S.coverage(S.comparison(*_places(spark, d), ["deck", "page_index", "place"], "n", "n", failed))


@query(f"SELECT r.deck, r.page_index, r.box_index, r.paragraph_index, r.pos, CASE WHEN a.deck IS NOT NULL AND r.box_index = 0 AND r.paragraph_index = 0 AND r.pos < 2 THEN ['a', 'b'][r.pos + 1] ELSE r.text END AS text FROM {_ROWS} r LEFT JOIN {_ANSWERS} a ON r.deck = a.deck AND r.page_index = a.page_index")
def translations_applied(spark: SparkSession, d: str) -> DataFrame:
    return S.applied(_fragments(spark, d), S.translations(_answers(spark, d))).select("deck", *S.PLACE, "pos", "text")


_CHARACTERS = "(SELECT user_id, event_id, event_type, CASE WHEN event_id % 11 = 0 THEN chr(10) WHEN event_id % 13 = 0 THEN chr(13) WHEN event_id % 3 = 0 THEN ' ' ELSE 'x' END AS c FROM events)"


# a break, a character behind one and a change of format begin a run; breaks and blank runs go
@query(f"""WITH m AS (SELECT *, c IN (chr(10), chr(13)) AS broken, CASE WHEN lag(event_type) OVER w = event_type AND c NOT IN (chr(10), chr(13)) AND lag(c) OVER w NOT IN (chr(10), chr(13)) THEN 0 ELSE 1 END AS f FROM {_CHARACTERS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
SELECT user_id, event_type, min(event_id) AS start, string_agg(c, '' ORDER BY event_id) AS text FROM r WHERE NOT broken GROUP BY user_id, run, event_type HAVING trim(string_agg(c, '')) <> ''""")
def format_runs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    c = F.when(k % 11 == 0, "\n").when(k % 13 == 0, "\r").when(k % 3 == 0, " ").otherwise("x")
    runs = S.runs_by_format(read(spark, d, "events").withColumn("c", c), ["user_id"], "event_id", "c", ["event_type"])
    return runs.select("user_id", "event_type", "start", F.col("c").alias("text"))


@query("SELECT user_id, coalesce(string_agg(event_type, ' ' ORDER BY event_id) FILTER (WHERE value > 10), '') AS text, coalesce(avg(value) FILTER (WHERE value > 10), 0) AS confidence FROM events GROUP BY user_id")
def region_texts(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("text"), F.col("value").alias("confidence"))
    return S.region_text(words, "user_id", "event_id", 10)


_IMAGES = "(SELECT event_id, event_id % 3 <> 0 AS has, event_id % 3 = 1 AS done FROM events)"


def _images(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 3 != 0, F.create_map(F.lit("text1"), F.col("event_type"), F.lit("text2"), F.lit(" ")))
    done = F.when(k % 3 == 1, F.create_map(F.lit("text1"), F.upper("event_type")))
    return read(spark, d, "events").select("event_id", text.alias("all_text"), done.alias("translated_text"), F.concat(F.lit("img"), k.cast("string"), F.lit(".png")).alias("filename"))


@query(f"SELECT count(*) AS images, count(*) FILTER (WHERE has) AS with_text, count(*) FILTER (WHERE done) AS with_translation, CAST(sum(CASE WHEN has THEN 2 ELSE 0 END) AS BIGINT) AS texts, CAST(sum(CASE WHEN done THEN 1 ELSE 0 END) AS BIGINT) AS translations, sum(CASE WHEN done THEN 1 ELSE 0 END) * 100.0::DOUBLE / greatest(sum(CASE WHEN has THEN 2 ELSE 0 END), 1) AS rate FROM {_IMAGES}")
def ocr_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.ocr_summary(_images(spark, d))


@query("SELECT event_id, event_type AS original, CASE WHEN event_id % 3 = 1 THEN upper(event_type) ELSE '' END AS translation FROM events WHERE event_id % 3 <> 0")
def ocr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.paired_texts(_images(spark, d), ["event_id"]).select("event_id", "original", "translation")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'full' WHEN event_id % 5 = 0 THEN 'stem' END AS ocr_text FROM events")
def ocr_attached(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    name = F.concat(F.lit("img"), k.cast("string"))
    e = read(spark, d, "events")
    results = e.where(k % 2 == 0).select(F.concat(name, F.lit(".png")).alias("name"), F.lit("full").alias("ocr_text")).unionByName(e.where(k % 5 == 0).select(name.alias("name"), F.lit("stem").alias("ocr_text")))
    return S.attach_ocr(_images(spark, d), results).select("event_id", "ocr_text")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey % 10 <> 0 AND p_partkey % 4 = 0) AS changed, count(*) FILTER (WHERE p_partkey % 10 <> 0 AND p_partkey % 4 <> 0) AS unchanged, count(*) FILTER (WHERE p_partkey % 10 <> 0 AND p_partkey % 4 <> 0) * 100.0::DOUBLE / count(*) AS rate FROM part")
def size_preservation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    before = read(spark, d, "part").select(k.alias("box"), *(F.lit(v).alias(c) for c, v in (("left", 1), ("top", 2), ("width", 3), ("height", 4))))
    after = before.where("box % 10 <> 0").withColumn("width", F.when(F.col("box") % 4 == 0, 5).otherwise(F.col("width")))
    return S.preservation(S.size_changes(before, after))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE p_size > 25) AS yes, count(*) FILTER (WHERE NOT p_size > 25) AS no, count(*) FILTER (WHERE p_size > 25) * 100.0::DOUBLE / count(*) AS percentage FROM part")
def autofit_status(spark: SparkSession, d: str) -> DataFrame:
    return S.autofit_status(read(spark, d, "part").withColumn("autofit", F.col("p_size") > 25))


@query("SELECT min(event_id) AS pos, list_sort([event_type, CAST(user_id % 5 AS VARCHAR)]) AS key FROM events GROUP BY key")
def distinct_combinations(spark: SparkSession, d: str) -> DataFrame:
    pair = F.when(F.col("event_id") % 2 == 0, F.array("event_type", (F.col("user_id") % 5).cast("string"))).otherwise(F.array((F.col("user_id") % 5).cast("string"), "event_type"))
    found = S.distinct_combinations(read(spark, d, "events").select(F.col("event_id").alias("pos"), pair.alias("langs")), "langs", "pos")
    return found.select("pos", F.array_sort("langs").alias("key"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE [0, event_id % 3 + 1] END AS pages FROM events")
def selected_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    asked = F.when(k == 0, F.array(F.lit(0).cast("bigint"), F.lit(-3).cast("bigint"))).otherwise(F.array(k + 2, F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), k + 2))
    return read(spark, d, "events").select("event_id", S.selected_pages(asked).alias("pages"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT conv_id, list_slice(list_concat(list(text ORDER BY turn), ['', '', '', '', '']), 1, 5) AS texts FROM conversations GROUP BY conv_id")
def fitted_texts(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return read(spark, d, "conversations").groupBy("conv_id").agg(S.fitted(ordered, F.lit(5)).alias("texts"))


@query(f"""WITH t AS (SELECT r.deck, r.page_index, r.box_index, a.deck IS NOT NULL AND r.box_index = 0 AND r.paragraph_index = 0 AND r.pos < 2 AS done FROM {_ROWS} r LEFT JOIN {_ANSWERS} a ON r.deck = a.deck AND r.page_index = a.page_index)
SELECT deck, count(DISTINCT page_index) FILTER (WHERE page_index <> 0) AS success, count(DISTINCT page_index) FILTER (WHERE page_index = 0) AS failed, count(*) FILTER (WHERE done) AS updated, count(DISTINCT (page_index, box_index)) AS boxes FROM t GROUP BY deck""")
def page_results(spark: SparkSession, d: str) -> DataFrame:
    done = S.applied(_fragments(spark, d), S.translations(_answers(spark, d)))
    failed = done.where("page_index = 0").select("deck", "page_index").distinct()
    return S.page_results(done, failed)


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'paragraph_only' WHEN 1 THEN 'legacy_only' WHEN 2 THEN 'mixed' WHEN 3 THEN 'empty' ELSE 'invalid' END AS structure,
CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS total_pages, CASE p_partkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 0 END AS total_fragments FROM part""")
def deck_structures(spark: SparkSession, d: str) -> DataFrame:
    """By what the boxes of JSON trees hold."""
    new = '{"text_boxes": [{"box_index": 0, "paragraphs": [{"text_fragments": [{"text": "a"}, {"text": "b"}]}, {"text_fragments": [{"text": "c"}]}]}]}'
    old = '{"text_boxes": [{"box_index": 0, "text_fragments": [{"text": "a"}, {"text": "b"}]}, {"box_index": 1}]}'
    forms = (f'{{"pages": [{new}]}}', f'{{"pages": [{old}]}}', f'{{"pages": [{new}, {old}]}}', '{"pages": [{"text_boxes": []}]}', f"[{new}]", "no JSON")
    raw = F.get(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 6).cast("int"))
    found = S.structure(read(spark, d, "part").select("p_partkey", raw.alias("json")), key="p_partkey")
    return found.select("p_partkey", "structure", "total_pages", "total_fragments")


@query("SELECT event_id % 2 = 0 AS listed, count(*) AS n FROM events GROUP BY 1")
def tree_forms(spark: SparkSession, d: str) -> DataFrame:
    """A deck and a bare list of pages read alike; anything else gives no pages."""
    page = '{"page_index": 3, "text_boxes": [{"box_index": 0, "paragraphs": [{"paragraph_index": 0, "text_fragments": [{"text": "a"}]}]}]}'
    k = F.col("event_id")
    raw = F.when(k % 2 == 0, f" [{page}]").otherwise(f'{{"presentation_path": "x", "pages": [{page}]}}')
    trees = read(spark, d, "events").select(k.alias("deck"), S.pages_of(raw).alias("pages")).unionByName(spark.createDataFrame([(-1, '"text"')], "deck long, raw string").select("deck", S.pages_of(F.col("raw")).alias("pages")))
    return S.fragments(trees).where("text = 'a' and page_index = 3").groupBy((F.col("deck") % 2 == 0).alias("listed")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS current_slide_paragraphs, count(*) FILTER (WHERE turn % 3 <> 0) AS translatable_paragraphs FROM conversations GROUP BY conv_id")
def page_translator_counts(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, "12.5 %").otherwise(F.concat(F.lit("w "), F.col("role")))
    return S.page_translator_counts(read(spark, d, "conversations").select("conv_id", text.alias("text")), ["conv_id"])


@query("SELECT p_partkey % 10 AS slide, CASE WHEN p_partkey % 3 = 0 THEN 'table-' || (p_size + 1) || '-1' ELSE CAST(p_size AS VARCHAR) END AS shape, CASE WHEN p_partkey % 3 = 0 THEN 'table_cell' ELSE 'textbox' END AS type, p_partkey % 2 = 0 AS is_autofit FROM part")
def autofit_details(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    size = F.when(k % 2 == 0, "TEXT_TO_FIT_SHAPE").when(k % 5 == 0, "NONE")
    boxes = read(spark, d, "part").select((k % 10).alias("slide"), F.col("p_size").alias("shape"), F.when(k % 3 == 0, F.col("p_size")).alias("row"), F.when(k % 3 == 0, 0).alias("col"), size.alias("auto_size"), F.lit(True).alias("word_wrap"))
    return S.autofit_details(boxes).select("slide", "shape", "type", "is_autofit")


@query("SELECT user_id, event_type AS source, max_by('t' || event_id, event_id) AS target FROM events WHERE event_id % 3 <> 0 GROUP BY user_id, event_type")
def source_pairs(spark: SparkSession, d: str) -> DataFrame:
    """What items say of a source, the last one winning; no target is none."""
    k = F.col("event_id")
    items = read(spark, d, "events").select("user_id", k.alias("pos"), F.col("event_type").alias("source"), F.when(k % 3 != 0, F.concat(F.lit("t"), k.cast("string"))).alias("target"))
    return S.pairs_by_source(items, "user_id")


@query("SELECT user_id, event_type AS source, max_by('t' || event_id, event_id) AS target FROM events WHERE event_id % 3 <> 0 GROUP BY user_id, event_type")
def source_pairs_filled(spark: SparkSession, d: str) -> DataFrame:
    """The same where blank sides count as none."""
    k = F.col("event_id")
    items = read(spark, d, "events").select("user_id", k.alias("pos"), F.col("event_type").alias("source"), F.when(k % 3 != 0, F.concat(F.lit("t"), k.cast("string"))).otherwise("").alias("target"))
    return S.pairs_by_source(items, "user_id", both=True)


@query("SELECT event_id, event_id % 4 = 0 AS valid FROM events")
def valid_answers(spark: SparkSession, d: str) -> DataFrame:
    """Some items, all of them with both languages."""
    good, half = '{"source_language": "a", "target_language": "b"}', '{"source_language": "a"}'
    k = F.col("event_id") % 4
    raw = F.when(k == 0, f"[{good}, {good}]").when(k == 1, f"[{good}, {half}]").when(k == 2, "[]").otherwise("nothing")
    return read(spark, d, "events").select("event_id", S.valid_items(F.from_json(raw, S.ITEMS)).alias("valid"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7.0 ELSE 12.0 END AS font_size, CASE WHEN event_id % 2 = 0 THEN 255 ELSE 0 END AS color, event_id % 2 = 0 AS bold, false AS italic, event_id % 5 = 1 AS escapement, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS text FROM events")
def fragment_formats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    even = lambda c: F.when(k % 2 == 0, c)
    raw = F.struct(F.when(k % 3 == 0, "7pt").alias("font_size"), even(F.lit(255)).alias("color"), even(F.lit(True)).alias("bold"), F.lit(None).cast("boolean").alias("italic"), F.lit(None).cast("boolean").alias("underline"), F.when(k % 5 == 1, -3).alias("escapement"), even(F.col("event_type")).alias("text"), F.lit(None).cast("string").alias("translated_text"))
    return read(spark, d, "events").select("event_id", V.fragment_defaults(raw).alias("f")).select("event_id", "f.font_size", "f.color", "f.bold", "f.italic", "f.escapement", "f.text")


@query("SELECT user_id, sum(n)::BIGINT AS runs FROM (SELECT user_id, 1 + count(*) FILTER (WHERE event_id % 10 = 0 AND event_id > lo AND event_id < hi) AS n FROM events JOIN (SELECT user_id, min(event_id) FILTER (WHERE event_id % 10 <> 0) AS lo, max(event_id) FILTER (WHERE event_id % 10 <> 0) AS hi FROM events GROUP BY user_id) USING (user_id) GROUP BY user_id, lo, hi HAVING lo IS NOT NULL) GROUP BY user_id")
def line_runs(spark: SparkSession, d: str) -> DataFrame:
    """Equal formats throughout: only line feeds, every tenth character, end a run. Two of them in a row leave none between."""
    e = read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 10 == 0, "\n").otherwise("x").alias("c"), F.lit(1).alias("font"))
    runs = S.runs_by_format(e, ["user_id"], "event_id", "c", ["font"])
    gaps = e.withColumn("next", F.lead("c").over(Window.partitionBy("user_id").orderBy("event_id")))
    twice = gaps.where("c = '\n' and next = '\n'").join(runs.groupBy("user_id").agg(F.min("start").alias("lo"), F.max("start").alias("hi")), "user_id").where("event_id > lo and event_id < hi").groupBy("user_id").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.count("*").alias("n1")).join(twice, "user_id", "left").select("user_id", (F.col("n1") + F.coalesce("n", F.lit(0))).alias("runs"))


@query("SELECT p_partkey, p_size % 3 <> 0 AS font_size, p_size % 2 = 0 AS bold FROM part")
def format_matches(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    p = read(spark, d, "part").select("p_partkey", F.struct(F.lit(12).alias("font_size"), F.lit(True).alias("bold")).alias("e"), F.struct(F.when(s % 3 == 0, 9).otherwise(12).alias("font_size"), (s % 2 == 0).alias("bold")).alias("a"))
    return p.select("p_partkey", S.format_match("e", "a").alias("m")).select("p_partkey", "m.*")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN [event_type, 'x'] ELSE [event_type] END AS texts FROM events")
def organised_texts(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array("event_type", F.lit(" "), F.lit("x")))).otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", S.organised_texts(raw).alias("texts"))


@query("SELECT event_id, [event_type, 'b'] AS texts FROM events")
def recognised_texts(spark: SparkSession, d: str) -> DataFrame:
    """Python literals, JSON and plain text."""
    e = F.col("event_type")
    raw = F.when(F.col("event_id") % 2 == 0, F.format_string("[{'text': '%s'}, 'b', ' ']", e)).otherwise(F.format_string('see {"text": ["%s", "b"]} ok', e))
    return read(spark, d, "events").select("event_id", literals.recognised_texts(raw).alias("texts"))


@query("SELECT event_id, 1 AS items, event_type AS target FROM events")
def literal_answers(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    raw = F.when(F.col("event_id") % 2 == 0, F.format_string("[{'source_language': 'a', 'target_language': '%s'}]", e)).otherwise(F.format_string('[{"source_language": "a", "target_language": "%s"}]', e))
    found = read(spark, d, "events").select("event_id", literals.model_items_any(raw).alias("x"))
    return found.select("event_id", F.size("x").alias("items"), F.get("x", F.lit(0))["target_language"].alias("target"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'CLICK' ELSE event_type END AS value FROM events")
def translated_map_values(spark: SparkSession, d: str) -> DataFrame:
    m = S.translated_values(F.create_map(F.lit("text1"), F.col("event_type")), lambda v: F.when(v == "click", F.upper(v)))
    return read(spark, d, "events").select("event_id", F.element_at(m, "text1").alias("value"))


@query("SELECT event_id, ['text1'] AS keys FROM events WHERE event_id % 2 = 0")
def content_lists(spark: SparkSession, d: str) -> DataFrame:
    item = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    items = F.array(item("image", F.col("event_type")), item("text", F.lit(" ")), item("text", F.when(F.col("event_id") % 2 == 0, F.col("event_type"))))
    found = read(spark, d, "events").select("event_id", F.transform(S.content_texts(items), lambda x: x["key"]).alias("keys"))
    return found.where(F.size("keys") > 0)

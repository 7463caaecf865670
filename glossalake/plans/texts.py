"""Text functions over documents, conversations and pages; dates and numbers over events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossalake.functions import text as T
from glossalake.functions import values as V
from glossalake.functions.segment import segmenter, word_counts
from glossalake.functions.translate import Dispatcher, translate, with_domain
from glossalake.operators import domains
from glossalake.operators import glossary as G
from glossalake.plans.base import read, registry

QUERIES, ORACLES, query = registry()
_W = r"\p{L}\p{N}_"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^{_W}\s]', '', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def text_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.normalize_for_comparison(F.col("text")).cast("binary")).alias("h"))


@query(rf"SELECT doc_id, md5(regexp_replace(lower(text), '[^{_W}]', '', 'g')) AS h FROM documents")
def text_normalized_hard(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.normalize_hard(F.col("text")).cast("binary")).alias("h"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '[.,!?;:()\[\]{}"''`~]', '', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents""")
def text_normalized_translation(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.normalize_for_translation(F.col("text")).cast("binary")).alias("h"))


@query(r"SELECT a.doc_id, regexp_replace(lower(a.text), '\s+', '', 'g') = regexp_replace(lower(b.text), '\s+', '', 'g') AS same, replace(a.text, ' ', '') = replace(b.text, ' ', '') AS same_blanks FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def text_equality(spark: SparkSession, d: str) -> DataFrame:
    a = _docs(spark, d).select("doc_id", F.col("text").alias("x"))
    b = _docs(spark, d).select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "doc_id").select("doc_id", T.equal_ignoring_white_space(x, y).alias("same"), T.equal_ignoring_blanks(x, y).alias("same_blanks"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g')) AS slides, length(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '^\s+|\s+$', '', 'g')) AS translation, length(regexp_replace(text, '[\x00-\x1F\x7F\x{200B}-\x{200D}\x{FEFF}\p{Cf}]', '', 'g')) AS model, length(replace(replace(text, '【', ''), '】', '')) AS brackets FROM documents")
def text_cleaned(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    n = {"slides": T.clean_for_slides(t), "translation": T.clean_translation(t), "model": T.clean_model_output(t), "brackets": T.clean_brackets(t)}
    return _docs(spark, d).select("doc_id", *(F.length(c).cast("bigint").alias(k) for k, c in n.items()))


_REF = r"regexp_matches({0}, '^\p{{Nd}}+$|^[A-Za-z]+\s*\d+$|^\d+\s*[A-Za-z]+$|^[IVXivx]+$')"
_PAGE = r"CASE WHEN regexp_matches({0}, '^\d+$') THEN coalesce(TRY_CAST({0} AS BIGINT) BETWEEN 1 AND 9999, false) ELSE regexp_matches({0}, '^[IVXivx]+$') END"
_GOOD = rf"(length({{0}}) >= 2 AND NOT regexp_matches({{0}}, '^\p{{{{Nd}}}}+$') AND NOT regexp_matches({{0}}, '^[^\p{{{{L}}}}\p{{{{N}}}}_\s]+$') AND NOT ({_PAGE}) AND NOT {_REF} AND NOT regexp_matches({{0}}, '^https?://') AND NOT regexp_matches({{0}}, '^\S+@\S+\.\S+'))"
_TOKENS = r"(SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.explode(F.split("text", " ")).alias("w")).distinct()


@query(rf"SELECT {_REF.format('s')} AS reference, {_PAGE.format('s')} AS page, {_GOOD.format('s')} AS translatable, count(*) AS n FROM (SELECT {_STRIP.format('w')} AS s FROM {_TOKENS}) GROUP BY ALL")
def word_classes(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("w")
    return _words(spark, d).groupBy(T.is_reference(w).alias("reference"), T.is_page_number(w).alias("page"), T.is_translatable(w).alias("translatable")).agg(F.count("*").alias("n"))


_PARAGRAPH = rf"length({{0}}) > 1 AND NOT regexp_matches({{0}}, '^[\p{{{{Nd}}}}\p{{{{Z}}}}\s.,\-%]+$') AND NOT regexp_matches({{0}}, '^[^{_W}\s]+$') AND NOT regexp_matches({{0}}, '^[\s\-_=+*#@$%^&()]+$')".replace(_W, _W.replace("{", "{{").replace("}", "}}"))


@query(rf"SELECT {_PARAGRAPH.format('s')} AS translatable, regexp_matches(w, '^\d{{1,3}}$') AS short_number, regexp_matches(w, '^\d+\s*[A-Za-z&\s.\-]+,\s*\d{{4}}') AS citation, count(*) AS n FROM (SELECT w, {_STRIP.format('w')} AS s FROM {_TOKENS}) GROUP BY ALL")
def word_classes_legacy(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("w")
    return _words(spark, d).groupBy(T.is_translatable_paragraph(w).alias("translatable"), T.is_short_number(w).alias("short_number"), T.is_citation(w).alias("citation")).agg(F.count("*").alias("n"))


_WIDE = "translate({}, '0123456789', '０１２３４５６７８９')"


@query(rf"SELECT {_PARAGRAPH.format('s')} AS translatable, length(s) > 1 AND regexp_matches(s, '^[０-９.,%\-]+$') AS wide_number, count(*) AS n FROM (SELECT {_STRIP.format(_WIDE.format('w'))} AS s FROM {_TOKENS}) GROUP BY ALL")
def word_classes_wide(spark: SparkSession, d: str) -> DataFrame:
    """Every word with its digits in full width: numbers are no more worth translating for that."""
    wide = T.strip(F.translate("w", "0123456789", "０１２３４５６７８９"))
    number = (F.length(wide) > 1) & wide.rlike("^[０-９.,%\\-]+$")
    return _words(spark, d).groupBy(T.is_translatable_paragraph(wide).alias("translatable"), number.alias("wide_number")).agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id, len(x) AS n, md5(array_to_string(x, '|')) AS h FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？]+\s*'), lambda s: {_STRIP.format('s')}), lambda s: s <> '' AND {_GOOD.format('s')}) AS x FROM documents)")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    found = _docs(spark, d).select("doc_id", T.sentences(F.col("text")).alias("x"))
    return found.select("doc_id", F.size("x").cast("bigint").alias("n"), F.md5(F.array_join("x", "|").cast("binary")).alias("h"))


@query(rf"SELECT conv_id, turn, CASE WHEN {_GOOD.format('s')} THEN s ELSE '' END AS text FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM conversations)")
def meaningful_turns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", T.meaningful(F.col("text")).alias("text"))


@query("SELECT count(*) AS total_pairs, " + ", ".join(f"coalesce({f}(length({c})), 0) AS {f}_{side}_length" for side, c in (("source", "text"), ("target", "role")) for f in ("avg", "max", "min")) + " FROM conversations")
def pair_length_statistics(spark: SparkSession, d: str) -> DataFrame:
    return G.length_statistics(read(spark, d, "conversations"), "text", "role")


@query("SELECT count(*) AS n FROM conversations WHERE length(text) BETWEEN 1 AND 1000 AND length(role) BETWEEN 1 AND 1000")
def pairs_within_length(spark: SparkSession, d: str) -> DataFrame:
    return G.within_lengths(read(spark, d, "conversations"), "text", "role").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '12' WHEN 1 THEN 'q' ELSE '１２' END AS text, event_id % 3 <> 1 AS page, event_id % 3 <> 1 AS reference FROM events")
def wide_digits(spark: SparkSession, d: str) -> DataFrame:
    """Digits of other scripts are digits."""
    k = F.col("event_id") % 3
    t = read(spark, d, "events").select("event_id", F.when(k == 0, "12").when(k == 1, "q").otherwise("１２").alias("text"))
    return t.select("*", T.is_page_number(F.col("text")).alias("page"), T.is_reference(F.col("text")).alias("reference"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || chr(65533) || 'z' ELSE event_type || 'z' END AS text FROM events")
def valid_texts(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that aren't UTF-8 go; a replacement character that is there itself stays."""
    odd = F.when(F.col("event_id") % 2 == 0, F.unhex(F.lit("FFEFBFBD"))).otherwise(F.unhex(F.lit("C3")))
    raw = F.concat(F.col("event_type").cast("binary"), odd, F.lit("z").cast("binary"))
    return read(spark, d, "events").select("event_id", T.valid_utf8(raw).alias("text"))


@query("SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'GIF' WHEN 3 THEN 'BMP' WHEN 4 THEN 'TIFF' WHEN 5 THEN 'WebP' WHEN 6 THEN 'WMF' WHEN 7 THEN 'unknown' ELSE 'EMF' END AS format FROM events")
def image_formats(spark: SparkSession, d: str) -> DataFrame:
    heads = ("89504E470D0A1A0A", "FFD8FFE000104A46", "4749463839610000", "424D000000000000", "49492A0000000000", "524946460000000057454250", "D7CDC69A00000000", "424D", "01000000" + "00" * 36 + "20454D46")
    raw = F.unhex(F.get(F.array(*map(F.lit, heads)), (F.col("event_id") % 9).cast("int")))
    return read(spark, d, "events").select("event_id", T.image_format(raw)["format"].alias("format"))


@query("SELECT event_id, event_type AS food, [event_type, 'b'] AS words, CASE WHEN event_id % 2 = 0 THEN [event_type, 'b', 'c'] ELSE ['中', '文'] END AS tokens, 'ab' AS flat FROM events")
def food_names(spark: SparkSession, d: str) -> DataFrame:
    """Names without their filing note, lines of stop words, tokens, vertical tabs."""
    e, k = F.col("event_type"), F.col("event_id")
    tokens = F.when(k % 2 == 0, T.tokens(F.concat(e, F.lit(" b\tc")))).otherwise(T.tokens(F.lit(" 中 文 "), "zh"))
    return read(spark, d, "events").select("event_id", T.clean_food_name(F.concat(e, F.lit("备案入\n2020"))).alias("food"), T.stop_word_lines(F.concat(e, F.lit(" \n\n b"))).alias("words"), tokens.alias("tokens"), T.clean_vertical_tabs(F.lit("a\x0b_x000B_b")).alias("flat"))


@query(r"SELECT event_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1') AS stem FROM (SELECT page_id AS event_id, url || '.tar.gz' AS url FROM pages)")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.concat("url", F.lit(".tar.gz"))
    return read(spark, d, "pages").select(F.col("page_id").alias("event_id"), T.dirname(u).alias("dir"), T.stem(u).alias("stem"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN props || chr(10) || event_type ELSE event_type END AS cell FROM events")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("event_id") % 4 == 0, "1").when(F.col("event_id") % 4 == 1, "paragraph_up").otherwise("0")
    return read(spark, d, "events").select("event_id", V.table_cell(F.col("props"), F.col("event_type"), mode).alias("cell"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '医学' WHEN 1 THEN '金融' ELSE '其他' END AS domain FROM events")
def text_domains(spark: SparkSession, d: str) -> DataFrame:
    words = {"医学": ["doctor", "drug"], "金融": ["bank"], "法律": ["court", "law"]}
    k = F.col("event_id") % 3
    text = F.when(k == 0, "a drug, a doctor, a bank").when(k == 1, "bank and court, bank").otherwise(F.concat(F.repeat(F.lit(" "), 1000), F.lit("law")))
    return with_domain(read(spark, d, "events").select("event_id", text.alias("text")), words).select("event_id", "domain")


_DOMAIN_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+')"
_LEARNT = "doc_id % 2 = 0"


@query(f"""WITH t AS (SELECT doc_id, lang AS domain, {_DOMAIN_WORDS} AS w FROM documents), known AS (SELECT * FROM t WHERE domain IS NOT NULL AND {_LEARNT}),
c AS MATERIALIZED (SELECT domain, word, count(*) AS n FROM (SELECT domain, unnest(w) AS word FROM known) GROUP BY ALL),
s AS MATERIALIZED (SELECT domain, ln(count(*) / (SELECT count(*) FROM known)) AS prior, coalesce((SELECT sum(n) FROM c WHERE c.domain = known.domain), 0) + (SELECT count(DISTINCT word) FROM c) AS total FROM known GROUP BY domain),
v AS (SELECT DISTINCT word FROM c), words AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM t) JOIN v USING (word) GROUP BY ALL),
scores AS (SELECT doc_id, s.domain, prior + coalesce(sum(words.n * ln((coalesce(c.n, 0) + 1) / total)), 0) AS score FROM (SELECT DISTINCT doc_id FROM t) d CROSS JOIN s LEFT JOIN words USING (doc_id) LEFT JOIN c ON c.domain = s.domain AND c.word = words.word GROUP BY doc_id, s.domain, prior)
SELECT doc_id, arg_max(domain, score) AS domain FROM scores GROUP BY doc_id""")
def fitted_domains(spark: SparkSession, d: str) -> DataFrame:
    """Learnt from the documents of even id, with their language as domain, and told for all."""
    docs = read(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("domain"))
    return domains.predict(docs, domains.fit(docs.where(_LEARNT))).select("doc_id", "domain")


@query()
def segmented_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose blanks are gone, in words again: by the words of the benchmark and their counts."""
    segment = segmenter(word_counts(read(spark, d, "benchmark"), "text"), everything=True)
    bare = F.regexp_replace("text", r"(?U)\s+", "").alias("text")
    words = read(spark, d, "documents").select("doc_id", bare).select("doc_id", segment("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_words"), F.sha2(F.array_join("w", " ").cast("binary"), 256).alias("words_sha256"))


class _Upper:
    """A model that answers in capitals and fails on one kind of text."""

    def translate(self, texts: list[str], source: str, target: str) -> list[str | None]:
        if "error" in texts:
            raise ValueError("refused")
        return [t.upper() for t in texts]


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'own' WHEN 'error' THEN 'error' ELSE upper(event_type) END AS translation, CASE WHEN event_type = 'error' THEN 'refused' END AS error FROM events")
def dispatched_translations(spark: SparkSession, d: str) -> DataFrame:
    """By the model asked for; stop words stay, custom translations come first; where the model fails, that text alone stays as it was."""
    models = Dispatcher({"upper": _Upper()}, ("click",), {"view": "own"})
    return translate(read(spark, d, "events").select("event_id", F.col("event_type").alias("text")), models.by("upper"), "English", "Chinese", delay=0).select("event_id", "translation", "error")


@query(rf"SELECT conv_id, list_filter(list_transform(string_split(string_agg(text, '[block]' ORDER BY turn), '[block]'), lambda s: {_STRIP.format('s')}), lambda s: s <> '') AS parts FROM conversations GROUP BY conv_id")
def block_parts(spark: SparkSession, d: str) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "[block]")
    return read(spark, d, "conversations").groupBy("conv_id").agg(joined.alias("t")).select("conv_id", T.block_parts(F.col("t")).alias("parts"))


@query(rf"SELECT doc_id, CASE WHEN s = '' THEN '空白' WHEN length(s) > 30 THEN '''' || substr(s, 1, 30) || '...''' ELSE '''' || s || '''' END AS summary, substr(text, 1, 500) AS head FROM (SELECT doc_id, text, {_STRIP.format('text')} AS s FROM documents)")
def text_summaries(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.summary(F.col("text")).alias("summary"), T.truncated(F.col("text"), 500).alias("head"))


@query(r"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, contains(url, '.') AND lower(regexp_extract(url, '([^.]*)$', 1)) IN ('html', 'htm') AS allowed, regexp_replace('mysql://root:x@' || url, '://([^:/@]+):[^@]*@', '://\1:***@') AS masked FROM pages")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", T.basename(u).alias("base"), T.extension_allowed(u, ("html", "htm")).alias("allowed"), T.mask_url(F.concat(F.lit("mysql://root:x@"), u)).alias("masked"))


@query("SELECT page_id, length(html) - length(replace(html, chr(10), '')) + 1 AS lines, string_split(html, chr(10))[1] AS first FROM pages WHERE html <> ''")
def split_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "pages").where("html <> ''").select("page_id", T.split_lines(F.array("html", F.lit(""))).alias("x"))
    return rows.select("page_id", F.size("x").cast("bigint").alias("lines"), F.get("x", F.lit(0))["value"].alias("first"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN [] ELSE [p_size, p_size + 1] END AS numbers FROM part")
def int_lists(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat_ws(",", F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string"), F.when(F.col("p_partkey") % 7 == 0, "x"))
    return read(spark, d, "part").select("p_partkey", T.int_list(raw).alias("numbers"))


@query("SELECT p_partkey, p_name AS source, p_type AS target FROM part")
def dictionary_lines(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.col("p_name"), F.lit("->"), F.col("p_type"), F.lit("\nno arrow\na->b->c"))
    return read(spark, d, "part").select("p_partkey", F.explode(T.dictionary_lines(raw)).alias("x")).select("p_partkey", "x.*")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s > 3600 THEN printf('%d小时%d分钟', CAST(floor(s / 3600) AS BIGINT), CAST(floor((floor(s) % 3600) / 60) AS BIGINT)) WHEN s > 60 THEN printf('%d分钟%d秒', CAST(floor(s / 60) AS BIGINT), CAST(floor(s) % 60 AS BIGINT)) ELSE printf('%.2f秒', s) END AS took FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity * l_linenumber * 30 AS DOUBLE) AS s FROM lineitem WHERE l_quantity * l_linenumber * 30 <> 0)")
def durations(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_quantity") * F.col("l_linenumber") * 30
    return read(spark, d, "lineitem").where(s != 0).select("l_orderkey", "l_linenumber", V.duration_text(s).alias("took"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber > 0 THEN floor(l_tax / l_linenumber * 100) ELSE 0 END AS INTEGER) AS progress, CASE WHEN l_quantity > 0 THEN round_even(l_linenumber * 100.0::DOUBLE / l_quantity, 2) ELSE 0 END AS share FROM lineitem")
def percentages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.progress(F.col("l_tax"), F.col("l_linenumber")).alias("progress"), V.share(F.col("l_linenumber"), F.col("l_quantity"), 2).alias("share"))


@query("SELECT p_partkey, p_size * 65536 + (p_size * 3) * 256 + 7 AS packed, [p_size, p_size * 3, 7] AS parts, CAST(greatest(p_size - 10, 1) AS DOUBLE) AS font FROM part")
def colors_and_fonts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    hexed = F.format_string("#%02X%02X%02X", s, s * 3, F.lit(7))
    return read(spark, d, "part").select("p_partkey", V.color_from_hex(hexed).alias("packed"), V.color_parts(V.color_from_parts(F.array(s, s * 3, F.lit(7)))).alias("parts"), V.font_size(F.concat(F.greatest(s - 10, F.lit(0)).cast("string"), F.lit(" pt"))).alias("font"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || chr(10) || props WHEN 1 THEN props || chr(10) || event_type WHEN 2 THEN props ELSE event_type END AS text, CASE WHEN event_id % 2 = 0 THEN 'OCR: ' || event_type || chr(10) || '备注: ' || props ELSE '注释' END AS note FROM events")
def bilingual_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    mode = F.when(k % 4 == 0, "paragraph_up").when(k % 4 == 1, "paragraph_down").when(k % 4 == 2, "translation_only").otherwise("none")
    even = lambda c: F.when(k % 2 == 0, F.col(c))
    return read(spark, d, "events").select("event_id", V.bilingual(F.col("event_type"), F.col("props"), mode).alias("text"), V.annotation_note(even("event_type"), F.lit(""), even("props")).alias("note"))


_FORMS = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') END"


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00' WHEN 3 THEN '' ELSE replace({_FORMS}, 'T', ' ') END AS shown, CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d') || ' 23:59:59' END AS last FROM events")
def time_forms(spark: SparkSession, d: str) -> DataFrame:
    """A day, a local ISO time, one with an offset, and none; an end at midnight means the day's end."""
    k, iso = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, iso).when(k == 2, F.concat(iso, F.lit("Z"))).otherwise("no time")
    at = V.parse_datetime(raw)
    local = F.from_utc_timestamp(at, "Asia/Shanghai")
    return read(spark, d, "events").select("event_id", V.format_datetime(at).alias("shown"), F.when(k == 0, F.date_format(V.widened_end(local), "yyyy-MM-dd HH:mm:ss")).alias("last"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS shown, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+08:00') AS iso, CASE WHEN ts = date_trunc('day', ts) THEN true ELSE false END AS midnight FROM events")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    local = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    back = V.parse_datetime(local)
    midnight = V.widened_end(F.col("ts")) != F.col("ts")
    return read(spark, d, "events").select("event_id", V.format_datetime(back).alias("shown"), V.iso_datetime(back).alias("iso"), midnight.alias("midnight"))

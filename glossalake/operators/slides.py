"""The slide tree: pages, boxes, paragraphs and fragments; flattening, prompts, results and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossalake.functions.text import blank, block_parts, is_translatable_paragraph, strip
from glossalake.functions.values import share

FRAGMENT = "struct<fragment_id:string,text:string,color:int,underline:boolean,bold:boolean,escapement:int,font_size:double>"
PARAGRAPH = f"struct<paragraph_index:int,paragraph_id:string,text_fragments:array<{FRAGMENT}>>"
BOX = f"struct<box_index:int,box_id:string,box_type:string,total_paragraphs:int,paragraphs:array<{PARAGRAPH}>>"
PAGE = f"struct<page_index:int,total_boxes:int,total_paragraphs:int,text_boxes:array<{BOX}>>"
DECK = f"struct<presentation_path:string,statistics:struct<total_pages:int,total_boxes:int,total_paragraphs:int,total_fragments:int>,pages:array<{PAGE}>>"
ITEMS = "array<struct<box_index:int,paragraph_index:int,source_language:string,target_language:string>>"


def pages_of(raw: Column) -> Column:
    """Pages from JSON that is a deck or a bare list of pages; null for anything else."""
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, f"array<{PAGE}>")).otherwise(F.from_json(raw, DECK)["pages"])


def fragments(decks: DataFrame, pages: str = "pages", key: str = "deck") -> DataFrame:
    """One row a fragment with its page, box, paragraph and place."""
    page = decks.select(key, F.explode(pages).alias("p"))
    box = page.select(key, F.col("p.page_index").alias("page_index"), F.explode("p.text_boxes").alias("b"))
    para = box.select(key, "page_index", F.col("b.box_index").alias("box_index"), F.col("b.box_id").alias("box_id"), F.explode("b.paragraphs").alias("q"))
    return para.select(key, "page_index", "box_index", "box_id", F.col("q.paragraph_index").alias("paragraph_index"), F.col("q.paragraph_id").alias("paragraph_id"), F.posexplode("q.text_fragments").alias("pos", "f")).select("*", "f.*").drop("f")


PLACE = ("page_index", "box_index", "paragraph_index")


def paragraphs(fragment_rows: DataFrame, key: str = "deck") -> DataFrame:
    """Paragraphs with a text: texts in order, joined by [block], and a running index within the deck."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    rows = fragment_rows.where(~blank(F.col("text"))).groupBy(key, *PLACE).agg(F.min("box_id").alias("box_id"), F.min("paragraph_id").alias("paragraph_id"), texts.alias("texts"))
    rows = rows.where(strip(F.array_join("texts", "")) != "").withColumn("combined_text", F.array_join("texts", "[block]"))
    return rows.withColumn("global_index", F.row_number().over(Window.partitionBy(key).orderBy(*PLACE)) - 1)


def joined_text(rows: DataFrame, group: list[str], order: list[str], text: str = "text", by: str = "") -> DataFrame:
    """Texts of a group in order, as one."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text])
    return rows.groupBy(*group).agg(F.array_join(ordered, by).alias(text))


def prompts(paragraph_rows: DataFrame, key: str = "deck") -> DataFrame:
    """One text a page: a heading, then the paragraphs by box and paragraph, numbered from 1."""
    line = F.format_string("【文本框%d-段落%d】\n%s\n\n", F.col("box_index") + 1, F.col("paragraph_index") + 1, F.col("combined_text"))
    lines = joined_text(paragraph_rows.withColumn("line", line), [key, "page_index"], ["box_index", "paragraph_index"], "line")
    head = F.format_string("第%d页内容（PPT原始页面索引：%d）：\n\n", F.col("page_index") + 1, F.col("page_index"))
    return lines.select(key, "page_index", F.concat(head, F.col("line")).alias("prompt"))


def deck_statistics(decks: DataFrame, pages: str = "pages", key: str = "deck") -> DataFrame:
    """Pages, boxes, paragraphs and fragments of each deck, counted within the row."""
    boxes = F.flatten(F.transform(pages, lambda p: p["text_boxes"]))
    paras = F.flatten(F.transform(boxes, lambda b: b["paragraphs"]))
    frags = F.flatten(F.transform(paras, lambda q: q["text_fragments"]))
    n = {"total_pages": F.col(pages), "total_boxes": boxes, "total_paragraphs": paras, "total_fragments": frags}
    return decks.select(key, *(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(k) for k, c in n.items()))


def paragraph_statistics(paragraph_rows: DataFrame) -> DataFrame:
    """Paragraphs and fragments a page, a box and in all, by grouping sets."""
    return paragraph_rows.groupingSets([[F.col("page_index")], [F.col("page_index"), F.col("box_index")], []], F.col("page_index"), F.col("box_index")).agg(
        F.count("*").alias("paragraphs"), F.sum(F.size("texts")).alias("fragments"), F.avg(F.size("texts")).alias("avg_fragments")
    )


#: Characters that one task looks through for runs, if their order is a number.
RUN_BLOCK = 4096


def runs_by_format(characters: DataFrame, group: list[str], order: str, text: str, formats: list[str], block: Column | None = None) -> DataFrame:
    """Runs of neighbouring characters with equal format (nulls are equal): run, their text and where it starts. A line feed or carriage return ends one and belongs to none; runs of blanks alone are left out.

    Runs are found within blocks of the order, which ``block`` must rise with; at the border of two blocks they are stitched
    if the last format of one is the first of the other. Only one row a block meets beyond its block. ``run`` rises within a group, with gaps.
    """
    broken = F.coalesce(F.col(text).isin("\n", "\r"), F.lit(False))
    rows = characters.select(*group, F.col(order).alias("__at"), F.col(text).alias("__c"), broken.alias("__broken"), F.struct(*formats).alias("__format"), (block if block is not None else F.floor(F.col(order) / RUN_BLOCK)).alias("__block"))
    w = Window.partitionBy(*group, "__block").orderBy("__at")
    same = F.col("__format").eqNullSafe(F.lag("__format").over(w)) & ~F.lag("__broken").over(w) & ~F.col("__broken")
    marked = rows.withColumn("__new", F.when(F.coalesce(same & F.lag("__at").over(w).isNotNull(), F.lit(False)), 0).otherwise(1)).withColumn("__k", F.sum("__new").over(w))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__c"))), lambda x: x["__c"])  # of a block's run
    pieces = marked.groupBy(*group, "__block", "__k", "__format", "__broken").agg(F.array_join(texts, "").alias("__c"), F.min("__at").alias("__at"))

    edge = F.struct("__at", "__format", "__broken")
    blocks = pieces.groupBy(*group, "__block").agg(F.max("__k").alias("__n"), F.min_by(edge, "__k").alias("__first"), F.max_by(edge, "__k").alias("__last"))
    along = Window.partitionBy(*group).orderBy("__block")
    last = F.lag("__last").over(along)
    goes_on = last.isNotNull() & last["__format"].eqNullSafe(F.col("__first.__format")) & ~last["__broken"] & ~F.col("__first.__broken")
    blocks = blocks.withColumn("__joined", F.when(F.coalesce(goes_on, F.lit(False)), 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("__n") - F.col("__joined")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__joined")
    names = [*group, "__block"]
    offsets = blocks.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(names)), before.alias("__before"))
    numbered = pieces.join(offsets, [F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(names)]).withColumn("run", F.col("__k") + F.col("__before"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__c"))), lambda x: x["__c"]), "").alias(text)
    runs = numbered.where("not __broken").groupBy(*group, "run", "__format").agg(whole, F.min("__at").alias("start"))
    return runs.where(strip(F.col(text)) != "").select(*group, "run", "__format.*", text, "start")


def model_items(raw: Column) -> Column:
    """Items of a model's answer: plain JSON, JSON in a fence, with missing brackets, or somewhere in a text; an empty array otherwise."""
    plain = F.from_json(raw, ITEMS)
    bare = strip(F.regexp_replace(F.regexp_replace(raw, r"```json\s*", ""), r"```\s*$", ""))
    closed = F.concat(F.when(bare.startswith("["), "").otherwise("["), bare, F.when(bare.endswith("]"), "").otherwise("]"))
    inside = F.regexp_extract(raw, r"(?s)(\[.*\]|\{.*\})", 1)
    inside = F.when(inside.startswith("{"), F.concat(F.lit("["), inside, F.lit("]"))).otherwise(inside)
    usable = lambda c: F.filter(F.from_json(c, ITEMS), lambda x: x["source_language"].isNotNull() & x["target_language"].isNotNull())
    found = F.coalesce(*(F.when(F.size(x) > 0, x) for x in (F.filter(plain, lambda x: x["source_language"].isNotNull() & x["target_language"].isNotNull()), usable(closed), usable(inside))))
    return F.coalesce(found, F.array().cast(ITEMS))


def valid_items(items: Column) -> Column:
    return F.coalesce((F.size(items) > 0) & F.forall(items, lambda x: x["source_language"].isNotNull() & x["target_language"].isNotNull()), F.lit(False))


def translations(answers: DataFrame, raw: str = "answer", key: str = "deck") -> DataFrame:
    """box_para key and fragments of each item with both indexes; the last one of a key wins."""
    items = answers.select(key, "page_index", F.posexplode(model_items(F.col(raw))).alias("pos", "x")).where("x.box_index is not null and x.paragraph_index is not null")
    name = F.concat_ws("_", F.col("x.box_index"), F.col("x.paragraph_index"))
    return items.groupBy(key, "page_index", name.alias("place")).agg(F.max_by(block_parts(F.col("x.target_language")), "pos").alias("translated"))


def pairs_by_source(items: DataFrame, key: str, both: bool = False) -> DataFrame:
    """source -> target of exploded items, the last one winning; with both, blank sides go."""
    rows = items.where(~blank(F.col("source")) & ~blank(F.col("target"))) if both else items.where("source is not null and target is not null")
    return rows.groupBy(key, "source").agg(F.max_by("target", "pos").alias("target"))


def fitted(texts: Column, n: Column) -> Column:
    """texts cut or filled with '' to n."""
    return F.slice(F.concat(texts, F.array_repeat(F.lit(""), n)), F.lit(1), n)


def applied(fragment_rows: DataFrame, translated: DataFrame, key: str = "deck") -> DataFrame:
    """Fragments with the translation at their place: original_text, text, is_translated."""
    place = F.concat_ws("_", F.col("box_index") + 1, F.col("paragraph_index") + 1)
    met = fragment_rows.withColumn("place", place).join(translated, [key, "page_index", "place"], "left")
    found = F.get("translated", F.col("pos"))
    return met.withColumns({"original_text": F.col("text"), "text": F.coalesce(found, F.col("text")), "is_translated": found.isNotNull()}).drop("translated", "place")


def rebuilt(fragment_rows: DataFrame, key: str = "deck") -> DataFrame:
    """The tree again from fragment rows, every level in order."""

    def up(df: DataFrame, group: list[str], index: str, child: str, name: str) -> DataFrame:
        return df.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index), F.col(child)))), lambda x: x[child]).alias(name))

    leaf = fragment_rows.withColumn("f", F.struct("fragment_id", "text", "color", "underline", "bold", "escapement", "font_size"))
    para = up(leaf, [key, *PLACE, "box_id", "paragraph_id"], "pos", "f", "text_fragments").withColumn("q", F.struct("paragraph_index", "paragraph_id", "text_fragments"))
    box = up(para, [key, "page_index", "box_index", "box_id"], "paragraph_index", "q", "paragraphs").withColumn("b", F.struct("box_index", "box_id", "paragraphs"))
    page = up(box, [key, "page_index"], "box_index", "b", "text_boxes").withColumn("p", F.struct("page_index", "text_boxes"))
    return up(page, [key], "page_index", "p", "pages")


def comparison(expected: DataFrame, actual: DataFrame, on: list[str], n_expected: str, n_actual: str, failed: DataFrame | None = None) -> DataFrame:
    """A row for each key of either side: missing, extra, mismatch (another count) or ok. With ``failed`` (some of the keys), what lies on a failed page isn't compared."""
    if failed is not None:
        expected, actual = (x.join(failed, failed.columns, "left_anti") for x in (expected, actual))
    a, b = expected.select(*on, F.col(n_expected).alias("__e")), actual.select(*on, F.col(n_actual).alias("__a"))
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "extra").when(F.col("__a") != F.col("__e"), "mismatch").otherwise("ok")
    return a.join(b, on, "full").select(*on, status.alias("status"))


def coverage(compared: DataFrame) -> DataFrame:
    """expected, translated, missing, extra, mismatched and the share translated (0 of nothing)."""
    n = {s: F.count_if(F.col("status") == s) for s in ("ok", "missing", "extra", "mismatch")}
    return compared.agg(*(c.alias(s) for s, c in n.items())).select(
        (F.col("ok") + F.col("missing") + F.col("mismatch")).alias("expected"), (F.col("ok") + F.col("mismatch")).alias("translated"), "missing", "extra", F.col("mismatch").alias("mismatched"),
        share(F.col("ok") + F.col("mismatch"), F.col("ok") + F.col("missing") + F.col("mismatch")).alias("coverage"),
    )


#: A tree in which boxes may hold paragraphs or, as old ones do, bare fragments.
LOOSE = f"struct<pages:array<struct<text_boxes:array<struct<box_index:int,paragraphs:array<{PARAGRAPH}>,text_fragments:array<{FRAGMENT}>>>>>>"


def structure(decks: DataFrame, raw: str = "json", key: str = "deck") -> DataFrame:
    """structure and counts of each deck, from its JSON: whether boxes hold paragraphs (paragraph_only), bare fragments (legacy_only), both kinds (mixed) or neither (empty).

    A box with both counts as one with paragraphs. JSON that is no object with a list of pages is invalid.
    """
    pages = F.from_json(raw, LOOSE)["pages"]
    missing = F.get_json_object(raw, "$").isNull() | F.ltrim(F.col(raw)).startswith("[") | (F.get_json_object(raw, "$.pages").isNotNull() & pages.isNull())
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    held = lambda c: F.coalesce(c, F.array())
    new = lambda b: b["paragraphs"].isNotNull()
    old = lambda b: b["paragraphs"].isNull() & b["text_fragments"].isNotNull()
    boxes = F.flatten(F.transform("__p", lambda p: F.coalesce(p["text_boxes"], F.array())))
    paras = F.flatten(F.transform(F.filter("__b", new), lambda b: b["paragraphs"]))
    bare = F.aggregate(F.filter("__b", old), F.lit(0), lambda s, b: s + F.size(b["text_fragments"]))
    inside = F.aggregate("__q", F.lit(0), lambda s, q: s + n(q["text_fragments"]))
    read = decks.select(key, missing.alias("__bad"), F.coalesce(pages, F.array().cast(LOOSE.removeprefix("struct<pages:")[:-1])).alias("__p"))
    read = read.withColumn("__b", boxes).withColumn("__q", paras)
    count = lambda test: F.size(F.filter("__p", lambda p: F.exists(F.coalesce(p["text_boxes"], F.array()), test)))
    out = read.select(
        key, "__bad", F.size("__p").alias("total_pages"), F.size("__b").alias("total_text_boxes"), F.size("__q").alias("total_paragraphs"),
        (bare + inside).alias("total_fragments"), count(new).alias("paragraph_structure_pages"), count(old).alias("legacy_structure_pages"),
    )
    a, b = F.col("paragraph_structure_pages") > 0, F.col("legacy_structure_pages") > 0
    kind = F.when(F.coalesce("__bad", F.lit(True)), "invalid").when(a & b, "mixed").when(a, "paragraph_only").when(b, "legacy_only").otherwise("empty")
    return out.withColumn("structure", kind).drop("__bad")


def content_texts(items: Column) -> Column:
    """Texts of a content list (type, text) that are of type text and not blank, numbered text1 ..."""
    kept = F.filter(items, lambda x: (x["type"] == "text") & (strip(F.coalesce(x["text"], F.lit(""))) != ""))
    return F.transform(kept, lambda x, k: F.struct(F.concat(F.lit("text"), (k + 1).cast("string")).alias("key"), x["text"].alias("value")))


def organised_texts(raw: Column) -> Column:
    """A JSON list of texts, or the text itself as the only one; without blank ones."""
    listed = F.from_json(raw, "array<string>")
    return F.filter(F.when(listed.isNotNull(), listed).otherwise(F.array(raw)), lambda t: strip(F.coalesce(t, F.lit(""))) != "")


def paired_texts(images: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each non-blank original of all_text with its translation ('' if there is none)."""
    rows = images.select(*keys, F.posexplode(F.map_entries("all_text")).alias("pos", "e"), "translated_text")
    return rows.where(strip(F.coalesce("e.value", F.lit(""))) != "").select(*keys, "pos", F.col("e.key").alias("key"), F.col("e.value").alias("original"), F.coalesce(F.try_element_at("translated_text", F.col("e.key")), F.lit("")).alias("translation"))


def translated_values(texts: Column, translate) -> Column:
    """Map values translated one by one; where translate gives null, the original stays."""
    return F.transform_values(texts, lambda k, v: F.coalesce(translate(v), v))


def ocr_summary(images: DataFrame) -> DataFrame:
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    total = images.agg(F.count("*").alias("images"), F.count_if(n("all_text") > 0).alias("with_text"), F.count_if(n("translated_text") > 0).alias("with_translation"), F.coalesce(F.sum(n("all_text")), F.lit(0)).alias("texts"), F.coalesce(F.sum(n("translated_text")), F.lit(0)).alias("translations"))
    return total.withColumn("rate", F.col("translations") * 100.0 / F.greatest("texts", F.lit(1)))


def attach_ocr(images: DataFrame, results: DataFrame) -> DataFrame:
    """Images with the OCR text under their file name, else under its stem, else that of the folder named like the file.

    results: name and ocr_text, and ``folder`` if the folder may be named otherwise than the result; blank texts of a folder don't count.
    """
    def named(rows: DataFrame, name: str, k: int) -> DataFrame:
        return rows.groupBy(F.col(name).alias(f"n{k}")).agg(F.max("ocr_text").alias(f"t{k}"))

    cut = F.regexp_replace("filename", r"(?<=.)\.[^.]*$", "")
    met = images.join(named(results, "name", 1), images["filename"] == F.col("n1"), "left").join(named(results, "name", 2), cut == F.col("n2"), "left")
    found = [F.col("t1"), F.col("t2")]
    if "folder" in results.columns:
        met = met.join(named(results.where(~blank(F.col("ocr_text"))), "folder", 3), images["filename"] == F.col("n3"), "left")
        found.append(F.col("t3"))
    return met.withColumn("ocr_text", F.coalesce(*found)).drop(*(f"{c}{k}" for c in "nt" for k in (1, 2, 3)))


def on_page(annotations: DataFrame, number: int) -> DataFrame:
    """The annotations of one page (1-based)."""
    return annotations.where(F.col("page") == number)


def on_real_pages(annotations: DataFrame, documents: DataFrame, key: str = "file") -> DataFrame:
    """Annotations, without those on a page that their document (key, page_count) doesn't have; no page means the first."""
    page = F.coalesce("page", F.lit(1))
    d = documents.select(F.col(key).alias("__doc"), F.col("page_count").alias("__n"))
    met = annotations.join(d, F.col(key) == F.col("__doc"))
    return met.where(page.between(1, F.col("__n"))).drop("__doc", "__n")


def page_translator_counts(paragraph_rows: DataFrame, group: list[str], text: str = "text") -> DataFrame:
    """Paragraphs of a slide and how many of them are worth translating."""
    good = is_translatable_paragraph(F.col(text))
    return paragraph_rows.groupBy(*group).agg(F.count("*").alias("current_slide_paragraphs"), F.count_if(good).alias("translatable_paragraphs"))


def region_text(words: DataFrame, key: str, order: str, least: float = 0.1) -> DataFrame:
    """Recognised words above a confidence, in order, and the average confidence (0.0 without any)."""
    good = words.where(F.col("confidence") > least)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, strip(F.col("text")).alias("text")))), lambda x: x["text"])
    found = good.groupBy(key).agg(F.array_join(ordered, " ").alias("text"), F.avg("confidence").alias("confidence"))
    return words.select(key).distinct().join(found, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def distinct_combinations(df: DataFrame, column: str, position: str) -> DataFrame:
    """Arrays that differ as sets, each as it came first."""
    return df.groupBy(F.array_sort(column).alias("__key")).agg(F.min_by(column, position).alias(column), F.min(position).alias(position)).drop("__key").orderBy(position)


def selected_pages(numbers: Column) -> Column:
    """1-based page numbers as sorted distinct 0-based ones; below 1 they go. Null (all pages) if none is left."""
    kept = F.array_sort(F.array_distinct(F.transform(F.filter(numbers, lambda n: n >= 1), lambda n: n - 1)))
    return F.when(F.size(kept) > 0, kept)


def size_changes(before: DataFrame, after: DataFrame, key: str = "box") -> DataFrame:
    """Deltas of left, top, width and height; ``changed`` is null for boxes that are gone."""
    names = ("left", "top", "width", "height")
    b = after.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in names), F.lit(True).alias("__there"))
    met = before.join(b, key, "left")
    differs = F.lit(False)
    for c in names:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return met.select(key, *((F.col(f"__{c}") - F.col(c)).alias(f"delta_{c}") for c in names), F.when(F.col("__there"), differs).alias("changed"))


def preservation(changes: DataFrame) -> DataFrame:
    out = changes.agg(F.count("*").alias("total"), F.count_if(F.col("changed")).alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"))
    return out.withColumn("rate", share(F.col("unchanged"), F.col("total")))


def autofit_status(boxes: DataFrame, flag: str = "autofit") -> DataFrame:
    out = boxes.agg(F.count("*").alias("total"), F.count_if(F.col(flag)).alias("yes"), F.count_if(~F.coalesce(F.col(flag), F.lit(False))).alias("no"))
    return out.withColumn("percentage", share(F.col("yes"), F.col("total")))


def autofit_details(boxes: DataFrame) -> DataFrame:
    """One row a text box or table cell: boxes (slide, shape; row and col, 0-based, for a cell; auto_size, word_wrap) with their type, a name and whether they fit their text."""
    cell = F.col("row").isNotNull()
    name = F.when(cell, F.format_string("table-%d-%d", F.col("row") + 1, F.col("col") + 1)).otherwise(F.col("shape").cast("string"))
    fits = F.coalesce(F.col("auto_size") == "TEXT_TO_FIT_SHAPE", F.lit(False))
    return boxes.select("slide", name.alias("shape"), F.when(cell, "table_cell").otherwise("textbox").alias("type"), "auto_size", fits.alias("is_autofit"), "word_wrap")


def format_match(expected: str, actual: str, fields: tuple[str, ...] = ("font_size", "bold")) -> Column:
    """Per field, whether two format structs agree."""
    return F.struct(*(F.col(f"{expected}.{f}").eqNullSafe(F.col(f"{actual}.{f}")).alias(f) for f in fields))


def page_results(fragment_rows: DataFrame, failed: DataFrame, key: str = "deck") -> DataFrame:
    """Per deck after translation: pages that worked and failed, fragments updated, distinct boxes."""
    bad = failed.select(key, "page_index", F.lit(True).alias("__failed"))
    pages = fragment_rows.groupBy(key, "page_index").agg(F.count_if(F.col("is_translated")).alias("updated"), F.collect_set("box_index").alias("boxes"))
    met = pages.join(bad, [key, "page_index"], "left")
    return met.groupBy(key).agg(F.count_if(F.col("__failed").isNull()).alias("success"), F.count_if(F.col("__failed")).alias("failed"), F.sum("updated").alias("updated"), F.sum(F.size("boxes")).alias("boxes"))

"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Emails, addresses, cards and phone numbers are the protected entities. A term in the text of
an entity discloses it by its pointwise mutual information, estimated from how many
documents of the corpus hold the term, the entity, and both. As a share of the entity's own
information, a disclosure over one threshold has the term generalised, over a higher one
removed, wherever it stands in a text that holds the entity. Only positions and 64-bit hashes of
entities and terms are written down, never their text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossalake.llm.common import inputs, stored, unused

#: kind -> pattern. Possessive, and anchored to where a run begins or the last match ended, so that
#: neither the stack nor the time grows out of proportion on long runs; the matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
REMOVED, GENERALISED = "removed", "generalised"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: Matches that are placed at a time.
_BLOCK = 128
_SPAN = "array<struct<kind:string,order:int,start:int,end:int>>"


@dataclass(frozen=True)
class Disclosure:
    """support: documents that must hold a term and an entity; shares of the entity's information from which a term goes;
    shortest: letters and digits that a term has at least."""

    support: int = 3
    shortest: int = 1
    generalise: float = 0.6
    remove: float = 0.8

    @property
    def term(self) -> str:
        return rf"[\p{{L}}\p{{N}}]{{{self.shortest},}}+"


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as value, start and end (code points): the pieces between them tell where they stand.

    They are placed in blocks, as adding to an array copies it: the work for n matches stays far below n squared.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<value:string,start:int,end:int>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["before"])
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(pair["value"].alias("value"), start.alias("start"), end.alias("end")))).alias("out"))

    def whole(state: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(state["at"].alias("at"), empty.alias("out")), step, lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], s["out"]).alias("out")))

    pairs = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda value, before: F.struct(value.alias("value"), before.alias("before")))
    # the array of pairs is made once and handed to a lambda, which cuts it
    blocks = F.flatten(F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(_BLOCK)), lambda k: F.slice(p, k, F.lit(_BLOCK)))))
    placed = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), empty.alias("out")), whole, lambda s: s["out"])
    return F.when(F.size(found) > 0, placed).otherwise(empty)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Entities of all kinds by start, then in the order of KINDS, with a hash of kind and value in lower case; none for a null text."""
    all_kinds = [_of_kind(text, order, kind, pattern) for order, (kind, pattern) in enumerate(PATTERNS.items())]
    return F.array_sort(F.concat(*all_kinds), _before)


def _of_kind(text: Column, order: int, kind: str, pattern: str) -> Column:
    kept = F.filter(located(F.coalesce(text, F.lit("")), pattern), lambda m: _valid(kind, m["value"]))
    value = lambda m: F.xxhash64(F.lit(kind), F.lower(m["value"])).alias("entity")
    return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("order"), m["start"].alias("start"), m["end"].alias("end"), value(m)))


def _terms(text: Column, pattern: str) -> Column:
    """The hash and place of each term of a text."""
    return F.transform(located(text, pattern), lambda m: F.struct(F.xxhash64(F.lower(m["value"])).alias("term"), m["start"].alias("start"), m["end"].alias("end")))


def _before(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["order"] - b["order"])


def _same_documents() -> list[Column]:
    """What tells a set of documents (id_hash, text_hash) from others, without their order: their number and two exclusive ors of 64-bit hashes."""
    return [F.count("*").alias("held"), F.bit_xor(F.xxhash64("id_hash", "text_hash")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "text_hash", "id_hash")).alias("y")]


def _entity_classes(some: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """id_hash, text_hash, m (rows of such a document), e_class and n_e for the classes of entities in support rows or more, and the documents among these with their m.

    Entities of the very same documents are one class: whatever they tell of a term they tell alike, so that a text with hundreds of them costs what one does.
    """
    key = ["id_hash", "text_hash"]
    pairs = some.select(*key, F.explode("entities").alias("entity")).groupBy(*key, "entity").agg(F.count("*").alias("m"))
    often = pairs.groupBy("entity").agg(F.sum("m").alias("n_e"), *_same_documents()).where(F.col("n_e") >= support)
    often = often.select("entity", "n_e", F.xxhash64("n_e", "held", "x", "y").alias("e_class"))
    near = stored(pairs.join(often, "entity").select(*key, "m", "e_class", "n_e").distinct(), "near")
    return near, near.select(*key, "m").distinct()


def _term_classes(held: DataFrame, weights: DataFrame, frequency: DataFrame, support: int) -> DataFrame:
    """id_hash, text_hash, term, t_class and n_t for the terms of texts with frequent entities, if support rows or more of these hold the term; likewise, those of the very same documents are one class."""
    key = ["id_hash", "text_hash"]
    terms = held.select(*key, F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("term"))
    often = terms.join(weights, key).groupBy("term").agg(F.sum("m").alias("n_near"), *_same_documents()).where(F.col("n_near") >= support)
    often = often.join(frequency, "term").select("term", "n_t", F.xxhash64("n_t", "n_near", "held", "x", "y").alias("t_class"))
    return stored(terms.join(often, "term").select(*key, "term", "t_class", "n_t"), "terms")


def find(df: DataFrame, rule: Disclosure | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and spans (kind, order, start, end) for every row of df, by start, then order.

    The kinds of terms, after the base ones, are ``generalised`` and ``removed``. A null text counts as empty;
    a null id is an id of its own. A repeated row counts as another document in the corpus counts. Words
    inside an entity are no spans of their own.
    """
    rule = rule or Disclosure()
    rows = inputs(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    based = rows.withColumn("base", base_spans(F.col("text")))
    entity = F.array_distinct(F.transform("base", lambda s: s["entity"]))
    terms = F.when(F.size("base") > 0, _terms(F.col("text"), rule.term))  # only those of texts with entities are needed again
    found = stored(based.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("base"), entity.alias("entities"), terms.alias("terms")), "entities")
    docs = found.count()
    key = ["id_hash", "text_hash"]
    found = found.withColumn("id_hash", F.xxhash64("doc_id"))
    some = found.where(F.size("base") > 0)
    near, weights = _entity_classes(some, rule.support)
    # the texts of frequent entities are found by their keys first, so that terms of other texts don't move
    held = some.join(weights.select(*key), key).dropDuplicates(key).select(*key, "terms")
    distinct = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(rule.term), F.lit(0)), lambda t: F.xxhash64(F.lower(t))))
    frequency = rows.select(F.explode(distinct).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    classed = _term_classes(held, weights, frequency, rule.support)
    of_docs = classed.select(*key, "t_class", "n_t").distinct()
    joint = near.join(of_docs, key).groupBy("e_class", "n_e", "t_class", "n_t").agg(F.sum("m").alias("n_te")).where(F.col("n_te") >= rule.support)
    own = F.log2(F.lit(docs) / F.col("n_e"))
    share = F.when(own > 0, F.log2(F.lit(docs) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / own).otherwise(0.0)
    told = joint.select("e_class", "t_class", share.alias("share")).where(F.col("share") >= rule.generalise)
    told = told.select("e_class", "t_class", (F.col("share") >= rule.remove).alias("removed"))
    hits = near.join(told, "e_class").join(of_docs.select(*key, "t_class"), [*key, "t_class"]).groupBy(*key, "t_class").agg(F.max("removed").alias("removed"))
    gone = classed.join(hits, [*key, "t_class"]).select(*key, "term", "removed")
    places = held.select(*key, F.explode("terms").alias("t")).select(*key, "t.term", "t.start", "t.end")
    hit = places.join(gone, [*key, "term"])
    kind = F.when(F.col("removed"), REMOVED).otherwise(GENERALISED)
    order = F.when(F.col("removed"), len(KINDS) + 1).otherwise(len(KINDS))
    marked = hit.select(*key, F.struct(kind.alias("kind"), order.alias("order"), "start", "end").alias("span"))
    marked = marked.groupBy(*key).agg(F.collect_list("span").cast(_SPAN).alias("marked"))  # of a text's own terms
    both = found.join(marked, key, "left")
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["order"].alias("order"), s["start"].alias("start"), s["end"].alias("end"))).cast(_SPAN)
    outside = F.filter("marked", lambda t: ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])))
    spans = F.array_sort(F.concat(base, F.coalesce(outside, F.array().cast(_SPAN))), _before)
    return both.select("doc_id", "text_hash", spans.alias("spans"))


def sanitise(df: DataFrame, rule: Disclosure | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, columns unchanged, with entities replaced by [KIND], generalised terms by [TERM], and removed terms left out.

    Where spans overlap, all that they cover goes, under the tag of the first. Null texts stay null, empty ones empty;
    repeated rows and rows with a null id are treated like any other.
    """
    found = find(df, rule, id_col, text_col).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    id_, hash_, spans = (unused(df, c) for c in ("pii_id", "pii_hash", "pii_spans"))
    found = found.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("spans").alias(spans))
    text = F.col(text_col)
    same = df[id_col].eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(df[text_col], F.lit(""))) == F.col(hash_))

    def step(state: Column, s: Column) -> Column:
        tag = F.when(s["kind"] == REMOVED, "").when(s["kind"] == GENERALISED, "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        piece = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), tag)
        longer = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] < state["at"], longer).otherwise(F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(piece)).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    joined = df.join(found, same, "left")
    return joined.select(*(F.when(F.col(spans).isNull(), text).otherwise(clean).alias(c) if c == text_col else df[c] for c in df.columns))

"""Glossary, catalogue, lookups and rules over parts, customers and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from glossalake.functions import text as T
from glossalake.functions import values as V
from glossalake.operators import glossary as G
from glossalake.operators import rules as R
from glossalake.operators import terms
from glossalake.plans.base import TRANSLATIONS, USERS, read, registry, translations, users
from glossalake.sources.writers import aligned

QUERIES, ORACLES, query = registry()
_SEEN = "(is_public OR user_id = 7)"


@query(f"""SELECT t.id, t.english, t.chinese, t.is_public, coalesce(u.username, 'unknown') AS username FROM {TRANSLATIONS} t LEFT JOIN {USERS} u ON t.user_id = u.uid
WHERE {_SEEN} AND (english ILIKE '%an%' OR chinese ILIKE '%an%' OR dutch ILIKE '%an%' OR coalesce(category ILIKE '%an%', false)) ORDER BY t.id DESC LIMIT 20 OFFSET 20""")
def glossary_search_page(spark: SparkSession, d: str) -> DataFrame:
    found = translations(spark, d).where(G.visible(7) & G.matches("an", "english", "chinese", "dutch", "category"))
    one = G.page(found, [F.desc("id")], 2, 20)
    named = G.with_lookup(one, users(spark, d), "user_id", "uid", {"username": "username"}, {"username": "unknown"})
    return named.select("id", "english", "chinese", "is_public", "username")


@query(f"SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM {TRANSLATIONS} WHERE {_SEEN} AND (english ILIKE '%an%' OR chinese ILIKE '%an%')")
def glossary_page_info(spark: SparkSession, d: str) -> DataFrame:
    return G.page_info(translations(spark, d).where(G.visible(7) & G.matches("an", "english", "chinese")), 20)


@query(f"SELECT 'private' AS scope, count(*) AS n FROM {TRANSLATIONS} WHERE user_id = 7 AND NOT is_public UNION ALL SELECT 'public', count(*) FROM {TRANSLATIONS} WHERE is_public UNION ALL SELECT 'all', count(*) FROM {TRANSLATIONS} WHERE {_SEEN}")
def glossary_visibility(spark: SparkSession, d: str) -> DataFrame:
    flags = {s: G.visible(7, s) for s in ("private", "public", "all")}
    one = translations(spark, d).agg(*(F.count_if(c).alias(s) for s, c in flags.items()))
    return one.select(F.explode(F.create_map(*(x for s in flags for x in (F.lit(s), F.col(s))))).alias("scope", "n"))


@query(f"SELECT id, english FROM {TRANSLATIONS} WHERE english ILIKE '%a_e%'")
def glossary_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return translations(spark, d).where(G.matches("a_e", "english")).select("id", "english")


@query(f"SELECT english AS source, max_by(chinese, id) AS target FROM {TRANSLATIONS} WHERE id IN (3, 8, 21, 34, 55, 89, 144, 157, 307) AND {_SEEN} AND coalesce(english, '') <> '' AND coalesce(chinese, '') <> '' GROUP BY english")
def custom_dictionary(spark: SparkSession, d: str) -> DataFrame:
    rows = translations(spark, d).where(F.col("id").isin(3, 8, 21, 34, 55, 89, 144, 157, 307) & G.visible(7))
    return G.last_wins(G.language_pair(rows, "English", "Chinese"), "source", "target", "id")


_LANGUAGES = ("english", "chinese", "dutch")


@query(" UNION ALL ".join(f"SELECT '{a}-{b}' AS pair, count(*) AS n, count(DISTINCT {a}) AS sources, count(DISTINCT {b}) AS targets FROM {TRANSLATIONS} WHERE coalesce({a}, '') <> '' AND coalesce({b}, '') <> ''" for a in _LANGUAGES for b in _LANGUAGES if a != b) + " UNION ALL SELECT 'english-german', 0, 0, 0")
def language_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All six directions, and one of an unknown language, which has no rows."""
    t = translations(spark, d)
    names = [(a, b) for a in _LANGUAGES for b in _LANGUAGES if a != b] + [("english", "german")]
    parts = [G.language_pair(t, a.capitalize(), b.capitalize()).agg(F.lit(f"{a}-{b}").alias("pair"), F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets")) for a, b in names]
    return reduce(DataFrame.unionByName, parts)


@query(f"SELECT id, dutch AS source, english AS target FROM {TRANSLATIONS}")
def dictionary_dutch_english(spark: SparkSession, d: str) -> DataFrame:
    return G.language_pair(translations(spark, d), "Dutch", "English").select("id", "source", "target")


@query(f"SELECT user_id, count(*) AS n FROM {TRANSLATIONS} GROUP BY user_id")
def count_per_owner(spark: SparkSession, d: str) -> DataFrame:
    return translations(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, coalesce(c.c_name, '未知用户') AS username FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) c ON o_custkey = c_custkey")
def file_owners(spark: SparkSession, d: str) -> DataFrame:
    some = read(spark, d, "customer").where("c_custkey % 3 = 0")
    return G.with_lookup(read(spark, d, "orders"), some, "o_custkey", "c_custkey", {"username": "c_name"}, {"username": "未知用户"}).select("o_orderkey", "username")


@query(f"SELECT u.uid, u.username, a.username AS approved_by FROM {USERS} u LEFT JOIN {USERS} a ON u.approver = a.uid")
def approvers(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d)
    return G.with_lookup(u, u, "approver", "uid", {"approved_by": "username"}).select("uid", "username", "approved_by")


@query(f"SELECT uid FROM {USERS} WHERE role_id IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def permission_holders(spark: SparkSession, d: str) -> DataFrame:
    bridge = read(spark, d, "nation").select(F.col("n_nationkey").alias("role_id"), F.col("n_regionkey").alias("permission_id"))
    permissions = read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return G.holders_of(users(spark, d), bridge, permissions, "ASIA").select("uid")


@query("SELECT count(*) AS n FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = (SELECT min(n_name) FROM nation))")
def scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: read(spark, d, t) for t in ("customer", "nation")}
    return spark.sql("SELECT count(*) AS n FROM {customer} WHERE c_nationkey = (SELECT n_nationkey FROM {nation} WHERE n_name = (SELECT min(n_name) FROM {nation}))", **tables)


_UNION = """(SELECT p_name AS product, p_type AS ingredient, p_partkey AS pos, 'registration' AS data_source FROM part WHERE p_partkey % 2 = 0 UNION ALL
SELECT CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0) THEN p_name || '(备案)' ELSE p_name END, p_type, p_partkey, 'filing' FROM part WHERE p_partkey % 2 = 1)"""


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_name").alias("product"), F.col("p_type").alias("ingredient"), F.col("p_partkey").alias("pos"))
    return G.tagged_union(p.where("pos % 2 = 0"), p.where("pos % 2 = 1"), "product", ("registration", "filing"), "(备案)")


@query(f"SELECT data_source, count(*) AS n, count(*) FILTER (WHERE product LIKE '%(备案)') AS renamed FROM {_UNION} GROUP BY data_source")
def catalogue_union(spark: SparkSession, d: str) -> DataFrame:
    return _catalogue(spark, d).groupBy("data_source").agg(F.count("*").alias("n"), F.count_if(F.col("product").endswith("(备案)")).alias("renamed"))


@query(f"SELECT product, ingredient, pos FROM {_UNION} WHERE data_source = 'filing' AND (contains(lower(ingredient), 'e') OR contains(lower(product), 'e')) ORDER BY pos LIMIT 15 OFFSET 15")
def catalogue_search_page(spark: SparkSession, d: str) -> DataFrame:
    return G.page(_catalogue(spark, d).where(G.holds_keyword("E") & (F.col("data_source") == "filing")), [F.col("pos")], 2, 15).select("product", "ingredient", "pos")


@query("SELECT strict, count(*) AS n FROM (SELECT true AS strict, p_partkey FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 UNION ALL SELECT false, p_partkey FROM part) GROUP BY strict")
def empty_keyword(spark: SparkSession, d: str) -> DataFrame:
    """An empty keyword is in every text, but strictly not in an empty one."""
    k = F.col("p_partkey")
    p = read(spark, d, "part").select(F.when(k % 2 == 0, "x").otherwise("").alias("ingredient"), F.when(k % 3 == 0, F.col("p_name")).otherwise("").alias("product"))
    both = [p.where(G.holds_keyword("", strict=strict)).agg(F.lit(strict).alias("strict"), F.count("*").alias("n")) for strict in (True, False)]
    return both[0].unionByName(both[1])


@query("SELECT p_partkey, CASE WHEN len(x) > 3 THEN array_to_string(x[1:3], '、') || '等' ELSE array_to_string(x, '、') END AS ingredients FROM (SELECT p_partkey, string_split(replace(p_name || ' ' || p_type || ' x', ' ', ','), ',') AS x FROM part)")
def top_ingredients(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", V.top_ingredients(F.replace(F.concat_ws(" ", "p_name", "p_type", F.lit("x")), F.lit(" "), F.lit(","))).alias("ingredients"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 OR page_id % 5 = 1 THEN NULL ELSE '/images/' || replace(replace(url, '://', '/'), '\\', '/') END AS image FROM pages")
def image_urls(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("page_id") % 5 == 0, "无截图路径").when(F.col("page_id") % 5 == 1, F.concat(F.lit("/"), "url")).otherwise(F.replace("url", F.lit("://"), F.lit("\\")))
    return read(spark, d, "pages").select("page_id", V.image_url(path).alias("image"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(trim(p_name)) = (SELECT lower(trim(max(p_name))) FROM part) ORDER BY p_partkey LIMIT 1")
def product_lookup_exact(spark: SparkSession, d: str) -> DataFrame:
    """A whole name beats names that contain it."""
    p = read(spark, d, "part")
    name = p.agg(F.max("p_name")).first()[0]
    longer = p.select((F.col("p_partkey") - 10_000_000).alias("p_partkey"), F.concat("p_name", F.lit(" x")).alias("p_name"))
    return G.best_match(p.select("p_partkey", "p_name").unionByName(longer), f" {name.upper()} ", "p_name", "p_partkey").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(trim(p_name)), 'a') ORDER BY lower(trim(p_name)) <> 'a', p_partkey LIMIT 1")
def product_lookup(spark: SparkSession, d: str) -> DataFrame:
    return G.best_match(read(spark, d, "part"), " A ", "p_name", "p_partkey").select("p_partkey", "p_name")


@query("SELECT k AS k, max_by(v, CAST(t AS BIGINT) * 1000000000 + pos) AS v FROM (SELECT p_brand AS k, p_name AS v, p_partkey AS pos, 0 AS t FROM part UNION ALL SELECT p_brand, p_type, p_partkey, 1 FROM part WHERE p_size < 10) GROUP BY k")
def merge_right_wins(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    a = p.select(F.col("p_brand").alias("k"), F.col("p_name").alias("v"), F.col("p_partkey").alias("pos"))
    b = p.where("p_size < 10").select(F.col("p_brand").alias("k"), F.col("p_type").alias("v"), F.col("p_partkey").alias("pos"))
    return G.merged("pos", "k", "v", a, b)


@query("SELECT c.conv_id * 1000 + c.turn AS id, t.term FROM conversations c JOIN (SELECT DISTINCT string_split(text, ' ')[1] AS term FROM benchmark) t ON contains(c.text, t.term) WHERE length(t.term) > 0")
def terms_in_texts(spark: SparkSession, d: str) -> DataFrame:
    wanted = read(spark, d, "benchmark").select(F.get(F.split("text", " "), F.lit(0)).alias("term"))
    texts = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return terms.terms_in_texts(texts, wanted, "id", "text", "term")


@query("SELECT text, min(turn * 1000000 + conv_id) AS first FROM conversations GROUP BY text")
def first_seen_texts(spark: SparkSession, d: str) -> DataFrame:
    return G.first_seen(read(spark, d, "conversations").withColumn("at", F.col("turn") * 1000000 + F.col("conv_id")), "text", "at")


@query("SELECT trim(regexp_replace(p_name, '\\r?\\n', ' ', 'g')) AS english, trim(p_type) AS chinese FROM part")
def export_pairs(spark: SparkSession, d: str) -> DataFrame:
    return aligned(translations(spark, d), "id", "english", "chinese")


_NEW = "(SELECT p_partkey + 1000000 AS row, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' new' WHEN p_partkey % 7 = 1 THEN '' ELSE p_name END AS english, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_type END AS chinese, p_partkey % 40 AS user_id, p_partkey % 4 = 0 AND p_partkey % 40 < 20 AS is_public FROM part)"


@query(f"""WITH f AS (SELECT n.*, english <> '' AND chinese <> '' AS complete, CASE WHEN is_public THEN english IN (SELECT english FROM {TRANSLATIONS} WHERE is_public) ELSE (user_id, english) IN (SELECT (user_id, english) FROM {TRANSLATIONS}) END AS held FROM {_NEW} n),
p AS (SELECT english, min(row) AS first_row, arg_min(user_id, row) AS first_user FROM f WHERE complete AND NOT held AND is_public GROUP BY english),
b AS (SELECT f.*, p.first_row, coalesce(p.first_user = f.user_id AND p.first_row < f.row, false) AS behind FROM f LEFT JOIN p USING (english)),
m AS (SELECT user_id, english, min(row) AS mine FROM b WHERE complete AND NOT held AND NOT is_public AND NOT behind GROUP BY user_id, english)
SELECT row, is_public, CASE WHEN NOT complete THEN 'incomplete' WHEN held THEN 'exists' WHEN is_public AND first_row = row OR NOT is_public AND NOT behind AND mine = row THEN 'accepted' ELSE 'repeated' END AS status FROM b LEFT JOIN m USING (user_id, english)""")
def import_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Users 0 to 19 are admins; what others ask to be public becomes private."""
    k = F.col("p_partkey")
    english = F.when(k % 3 == 0, F.concat("p_name", F.lit(" new"))).when(k % 7 == 1, "").otherwise(F.col("p_name"))
    new = read(spark, d, "part").select((k + 1000000).alias("row"), english.alias("english"), F.when(k % 11 == 0, "").otherwise(F.col("p_type")).alias("chinese"), (k % 40).alias("user_id"), (k % 4 == 0).alias("is_public"), (k % 40 < 20).alias("admin"))
    return R.accepted(new, translations(spark, d), admin="admin").select("row", "is_public", "status")


# rows with neither english nor chinese are skipped, whatever else they hold; with one of them they are errors
@query("SELECT CASE WHEN count(*) FILTER (WHERE bad) = 0 THEN count(*) ELSE 0 END AS success, count(*) FILTER (WHERE bad) AS errors, array_to_string(list_slice(list('row ' || k || ': english and chinese are required' ORDER BY k) FILTER (WHERE bad), 1, 10), '|') AS messages FROM (SELECT p_partkey AS k, p_partkey % 50 = 0 AS bad FROM part WHERE p_partkey % 7 <> 0)")
def import_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(k.cast("int").alias("row"), F.when((k % 50 == 0) | (k % 7 == 0), " ").otherwise(F.col("p_name")).alias("english"), F.when(k % 7 != 0, F.col("p_type")).alias("chinese"), F.col("p_brand").alias("dutch"), F.lit(None).cast("string").alias("category"), F.lit("是").alias("is_public"))
    return R.import_report(R.parse_import(rows, admin=True)).select("success", "errors", F.array_join("messages", "|").alias("messages"))


@query("SELECT CAST(p_partkey AS INTEGER) AS row, p_name AS english, p_type AS chinese, CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS VARCHAR) ELSE '0' END AS dutch, p_partkey % 3 = 1 AS is_public, CASE WHEN p_name IS NULL OR p_type IS NULL THEN 'error' END AS error FROM part WHERE p_partkey % 9 <> 0 ")
def import_rows(spark: SparkSession, d: str) -> DataFrame:
    """Flags as numbers, a column of numbers, and rows that hold neither text: only Dutch and a category don't make a row."""
    k = F.col("p_partkey")
    text = lambda c: F.when(k % 9 != 0, F.concat(F.lit(" "), c, F.lit("\n"))).otherwise("")
    dutch = F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("double")).otherwise(F.lit(0.0))
    flag = F.when(k % 3 == 1, 2.0).when(k % 3 == 2, 0.0)
    rows = read(spark, d, "part").select(k.cast("int").alias("row"), text("p_name").alias("english"), text("p_type").alias("chinese"), dutch.alias("dutch"), F.lit("c").alias("category"), flag.alias("is_public"))
    return R.parse_import(rows, admin=True).select("row", "english", "chinese", "dutch", "is_public", "error")


# a text counts by its words alone: 2.0 is no number there
@query("SELECT f IN ('1', 'yes', '是') AS flag, n IN (1, 2.5, -1) AS number_flag, count(*) AS n FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN '1' WHEN 1 THEN 'yes' WHEN 2 THEN '是' WHEN 3 THEN '0' WHEN 4 THEN '2.0' ELSE 'no' END AS f, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2.5 WHEN 3 THEN -1 ELSE 0 END AS n FROM part) GROUP BY 1, 2")
def import_flags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    f = F.when(k % 6 == 0, "1").when(k % 6 == 1, " YES").when(k % 6 == 2, "是").when(k % 6 == 3, "0").when(k % 6 == 4, "2.0").otherwise("no")
    number = F.when(k % 5 == 1, 1.0).when(k % 5 == 2, 2.5).when(k % 5 == 3, -1.0).when(k % 5 == 0, 0.0)
    return read(spark, d, "part").groupBy(R.parse_flag(f).alias("flag"), R.parse_flag(number, DoubleType()).alias("number_flag")).agg(F.count("*").alias("n"))


_DELETABLE = f"SELECT 'user' AS who, id FROM {TRANSLATIONS} WHERE NOT is_public AND user_id = 7 UNION ALL SELECT 'admin', id FROM {TRANSLATIONS} WHERE is_public OR user_id = 20"


@query(_DELETABLE)
def deletable_entries(spark: SparkSession, d: str) -> DataFrame:
    """What user 7, and what user 20 as an admin, may delete."""
    t = translations(spark, d)
    own, admins = R.deletable(t, 7, admin=False), R.deletable(t, 20, admin=True)
    return own.select(F.lit("user").alias("who"), "id").unionByName(admins.select(F.lit("admin").alias("who"), "id"))


@query(f"SELECT id FROM {TRANSLATIONS} WHERE NOT (is_public AND coalesce(category = 'large', false))")
def entries_left(spark: SparkSession, d: str) -> DataFrame:
    """After an admin has deleted the public entries of a category."""
    t = translations(spark, d)
    return R.without(t, R.deletable(t, 20, admin=True).where("is_public and category = 'large'")).select("id")


_CHANGES = f"(SELECT id, CASE id % 5 WHEN 0 THEN english WHEN 1 THEN '' WHEN 2 THEN english || ' (2)' WHEN 3 THEN (SELECT min(english) FROM {TRANSLATIONS} WHERE is_public) ELSE (SELECT min(english) FROM {TRANSLATIONS} WHERE user_id = 20) END AS english, 'c' AS chinese, CASE WHEN id % 3 = 0 THEN true WHEN id % 3 = 1 THEN false END AS is_public FROM {TRANSLATIONS})"


def _update_sql(admin: str) -> str:
    return f"""SELECT {admin} AS admin, t.id, CASE WHEN NOT CASE WHEN t.is_public THEN {admin} ELSE t.user_id = 20 END OR (coalesce(c.is_public <> t.is_public, false) AND NOT {admin}) THEN 'forbidden' WHEN c.english = '' THEN 'incomplete'
WHEN EXISTS (SELECT 1 FROM {TRANSLATIONS} o WHERE o.english = c.english AND o.id <> t.id AND CASE WHEN t.is_public OR coalesce(c.is_public, t.is_public) THEN o.is_public ELSE o.user_id = 20 END) THEN 'exists' ELSE 'changed' END AS status, coalesce(c.is_public, t.is_public) AS asked, c.english AS wanted, t.english, t.is_public FROM {TRANSLATIONS} t JOIN {_CHANGES} c USING (id)"""


@query(f"SELECT admin, id, status, CASE WHEN status = 'changed' THEN wanted ELSE english END AS english, CASE WHEN status = 'changed' THEN asked ELSE is_public END AS is_public FROM ({_update_sql('false')} UNION ALL {_update_sql('true')})")
def entry_updates(spark: SparkSession, d: str) -> DataFrame:
    """User 20 changes every entry, once as a user and once as an admin."""
    t = translations(spark, d)
    least = lambda rows: F.lit(rows.agg(F.min("english")).first()[0])
    k = F.col("id")
    english = F.when(k % 5 == 0, F.col("english")).when(k % 5 == 1, "").when(k % 5 == 2, F.concat("english", F.lit(" (2)"))).when(k % 5 == 3, least(t.where("is_public"))).otherwise(least(t.where("user_id = 20")))
    changes = t.select("id", english.alias("english"), F.lit("c").alias("chinese"), "dutch", "category", F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("is_public"))
    done = [R.updated(t, changes, 20, admin).select(F.lit(admin).alias("admin"), "id", "status", "english", "is_public") for admin in (False, True)]
    return done[0].unionByName(done[1])


# of two logins the later one counts, but an empty name in it leaves the earlier one's; users without a mail are found too
@query(f"""SELECT uid, username, CASE WHEN uid % 3 <> 0 THEN username END AS email, CASE WHEN uid % 4 = 0 THEN 'renamed' WHEN uid % 6 = 0 THEN 'early' ELSE segment END AS segment, CASE WHEN uid % 2 = 0 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN uid % 2 = 0 THEN 'oidc' END AS sso_provider, CASE WHEN uid % 4 = 0 THEN 's' || uid WHEN uid % 2 = 0 THEN '' END AS sso_subject, CASE WHEN uid % 2 = 0 THEN TIMESTAMP '2024-01-01' END AS last_login FROM {USERS} WHERE uid % 10 <> 0
UNION ALL SELECT (SELECT max(uid) FROM {USERS} WHERE uid % 10 <> 0) + row_number() OVER (ORDER BY username), NULL, NULL, NULL, 'approved', 'oidc', NULL, TIMESTAMP '2024-01-01' FROM {USERS} WHERE uid % 10 = 0""")
def login_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Every second customer logs in, some of them twice; one in ten isn't known yet and gets a new id. Which of them gets which is left open, so their names and subjects aren't shown."""
    mail = F.when(F.col("uid") % 3 != 0, F.col("username")).alias("email")
    u = users(spark, d)
    known = u.where("uid % 10 <> 0").select("uid", "username", mail, "segment", F.when(F.col("uid") % 2 == 0, "approved").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("sso_provider"), F.lit(None).cast("string").alias("sso_subject"), F.lit(None).cast("timestamp").alias("last_login"))
    early = u.where("uid % 6 = 0").select("username", mail, F.lit("early").alias("segment"), F.lit("e").alias("sub"), F.lit(1).alias("at"))
    late = u.where("uid % 2 = 0").select("username", mail, F.when(F.col("uid") % 4 == 0, "renamed").otherwise("").alias("segment"), F.when(F.col("uid") % 4 == 0, F.concat(F.lit("s"), F.col("uid").cast("string"))).alias("sub"), F.lit(2).alias("at"))
    done = R.upserted(known, late.unionByName(early), ["segment"], "uid", "oidc", F.lit("2024-01-01 00:00:00").cast("timestamp"), "at")
    last = known.agg(F.max("uid").alias("last"))
    shown = lambda c: F.when(F.col("uid") <= F.col("last"), F.col(c)).alias(c)
    out = done.crossJoin(F.broadcast(last))
    return out.select("uid", shown("username"), shown("email"), shown("segment"), "status", "sso_provider", shown("sso_subject"), F.col("last_login").cast("timestamp_ntz").alias("last_login"))


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS role_id FROM customer WHERE c_custkey % 5 <> 0")
def group_roles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    groups = F.when(k % 5 == 0, F.array(F.lit("none"))).when(k % 3 == 0, F.array(F.lit("none"), F.lit("admins"), F.lit("staff"))).otherwise(F.array(F.lit("staff"), F.lit("admins")))
    mapping = spark.createDataFrame([("admins", 1), ("staff", 2)], "group string, role_id int")
    return R.roles_from_groups(read(spark, d, "customer").select(k.alias("user_id"), groups.alias("groups")), mapping)


@query("SELECT role, count(*) AS n, max(length(description)) AS longest FROM (SELECT unnest(['admin', 'user']) AS role), (SELECT unnest(['管理员权限', '用户管理', '文件上传', '翻译功能', 'PDF注释', '查看日志', '词库管理', '停翻词管理', '成分搜索', '批量处理', 'SSO登录', '文件下载']) AS description) WHERE role = 'admin' OR description IN ('文件上传', '翻译功能', 'PDF注释', '词库管理', '停翻词管理', '成分搜索', '文件下载') GROUP BY role")
def seeded_grants(spark: SparkSession, d: str) -> DataFrame:
    """Seeding twice gives the rows of one seeding."""
    grants = R.seed_grants(spark).withColumn("key", F.concat_ws("/", "role", "permission"))
    return R.seeded(R.seeded(grants.limit(0), grants, "key"), grants, "key").groupBy("role").agg(F.count("*").alias("n"), F.max(F.length("description")).alias("longest"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, NULL AS note FROM part")
def evolved_schema(spark: SparkSession, d: str) -> DataFrame:
    """A column added, some dropped, one of another type; what is there or gone already is left."""
    p = read(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    out = R.evolved(p, add={"note": "string", "p_partkey": "int"}, drop=("p_brand", "absent"), change={"p_size": "string", "absent": "int"})
    return out.select("p_partkey", "p_size", F.col("note").cast("int").alias("note"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 1000, 'ATLANTIS'")
def idempotent_seed(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    first = nation.orderBy("id").limit(1).select(F.lit(999).alias("id"), "name")
    return R.seeded(nation, first.unionByName(spark.createDataFrame([(1000, "ATLANTIS")], "id int, name string")), "name")


@query("SELECT min(p_partkey) AS id, p_name AS word FROM part WHERE p_name NOT IN (SELECT split_part(n_name, ' ', 1) FROM nation) GROUP BY p_name")
def stop_words_added(spark: SparkSession, d: str) -> DataFrame:
    """Every part's name as a word, beside the nations' that are there."""
    there = read(spark, d, "nation").select(F.substring_index("n_name", " ", 1).alias("word"))
    return R.added_once(there, read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("word")), ["word"], "id").select("id", "word")


@query(f"SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN is_public END, false) AS is_public FROM {TRANSLATIONS}")
def backfilled_flags(spark: SparkSession, d: str) -> DataFrame:
    t = translations(spark, d).withColumn("is_public", F.when(F.col("id") % 2 == 0, F.col("is_public")))
    return R.backfilled(t).select("id", "is_public")


@query(f"SELECT uid, CASE WHEN uid % 3 = 0 THEN segment WHEN uid % 3 = 1 THEN 'Ann ' || username ELSE username END AS shown FROM {USERS}")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("uid") % 3
    return users(spark, d).select("uid", V.display_name(F.when(k == 0, F.col("segment")).otherwise(""), F.when(k == 1, "Ann"), F.col("username"), F.col("username")).alias("shown"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'zh' ELSE 'German' END || '_nl_' || regexp_replace(url, '[\\\\/:\"*?<>|]+', '_', 'g') AS stored FROM pages")
def stored_filenames(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 3
    source = F.when(k == 0, "English").when(k == 1, "Chinese").otherwise("German")
    return read(spark, d, "pages").select("page_id", V.stored_filename(source, F.lit("Dutch"), F.col("url")).alias("stored"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS token FROM part")
def ingredient_tokens(spark: SparkSession, d: str) -> DataFrame:
    first = F.get(F.split("p_name", " "), F.lit(0))
    listed = F.concat(F.lit("水（又名"), F.lit("x），"), first, F.lit("、油"))
    return read(spark, d, "part").select("p_partkey", T.ingredient_token(listed, first).alias("token"))

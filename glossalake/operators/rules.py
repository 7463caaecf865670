"""State changes as pure transforms: what is accepted, what is rejected and why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, NumericType, StringType, StructType

from glossalake.functions.text import blank, strip
from glossalake.operators.numbering import numbered

HEADER = ("english", "chinese", "dutch", "category", "is_public")
TEMPLATE = [HEADER, ("hello", "你好", "Hallo", "日常；问候", "1"), ("sorry", "抱歉", "Pardon", "日常；问候", "0")]
# The permissions, the roles, and what a user may do (an admin may do all).
PERMISSIONS = (
    ("admin", "管理员权限"), ("user_management", "用户管理"), ("file_upload", "文件上传"), ("translation", "翻译功能"),
    ("pdf_annotation", "PDF注释"), ("view_logs", "查看日志"), ("dictionary_management", "词库管理"), ("stop_words_management", "停翻词管理"),
    ("ingredient_search", "成分搜索"), ("batch_process", "批量处理"), ("sso_login", "SSO登录"), ("download_files", "文件下载"),
)
ROLES = ("admin", "user")
USER_PERMISSIONS = ("file_upload", "translation", "pdf_annotation", "dictionary_management", "stop_words_management", "ingredient_search", "download_files")


def cell_kinds(kind: DataType) -> dict[str, DataType]:
    """The columns that a cell may stand in: those of a typed cell (a struct), or the one column itself ('')."""
    return {f.name: f.dataType for f in kind.fields} if isinstance(kind, StructType) else {"": kind}


def _first(c: Column, kind: DataType, each: Callable[[Column, DataType], Column]) -> Column:
    """each over the field of a cell that is there; null for an empty cell."""
    parts = [c[name] if name else c for name in cell_kinds(kind)]
    return F.coalesce(*(F.when(p.isNotNull(), each(p, k)) for p, k in zip(parts, cell_kinds(kind).values(), strict=True)))


def parse_flag(c: Column, kind: DataType = StringType()) -> Column:
    """Of a text whether it is 1, true, yes or 是 (any case), of a number or flag whether it isn't 0; false for any other cell."""

    def one(p: Column, k: DataType) -> Column:
        if isinstance(k, StringType):
            return F.lower(strip(p)).isin("1", "true", "yes", "是")
        return p.cast("double") != 0 if isinstance(k, NumericType | BooleanType) else F.lit(False)

    return F.coalesce(_first(c, kind, one), F.lit(False))


def parse_text(c: Column, kind: DataType = StringType(), zero: bool = True) -> Column:
    """A cell as text: stripped, whole numbers without a point; null if empty, and for a number 0 or a flag false unless ``zero``."""

    def one(p: Column, k: DataType) -> Column:
        if isinstance(k, StringType):
            return F.when(strip(p) != "", strip(p))
        text = F.when(p == F.floor(p), p.cast("decimal(38,0)").cast("string")).otherwise(p.cast("string")) if isinstance(k, DoubleType | FloatType) else p.cast("string")
        return text if zero or not isinstance(k, NumericType | BooleanType) else F.when(p.cast("double") != 0, text)

    return _first(c, kind, one)


def parse_import(rows: DataFrame, admin: bool, position: str = "row") -> DataFrame:
    """Import rows with stripped texts, flag and ``error``; only an admin's rows may be public.

    A row needs english and chinese: with one of them it is an error, with neither it is skipped, whatever else it holds.
    Columns are texts, numbers or flags, or typed cells as ``sources.office`` reads them.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    cols = {c: parse_text(F.col(c), kinds[c], zero=c not in ("english", "chinese")) for c in HEADER[:4]}
    out = rows.withColumns(cols | {"is_public": parse_flag(F.col("is_public"), kinds["is_public"]) & F.lit(admin)})
    out = out.where(F.coalesce("english", "chinese").isNotNull())
    return out.withColumn("error", F.when(F.col("english").isNull() | F.col("chinese").isNull(), F.format_string("row %d: english and chinese are required", F.col(position))))


def valid_header(header: list[str]) -> bool:
    return tuple(h.strip().lower() for h in header) == HEADER


def import_report(parsed: DataFrame, position: str = "row", most: int = 10) -> DataFrame:
    """success, errors and the first messages; one bad row rejects the file, so success is 0 then."""
    bad = F.col("error").isNotNull()
    first = F.slice(F.array_sort(F.collect_list(F.when(bad, F.struct(position, "error")))), 1, most)
    out = parsed.agg(F.count("*").alias("n"), F.count_if(bad).alias("errors"), F.transform(first, lambda x: x["error"]).alias("messages"))
    return out.select(F.when(F.col("errors") == 0, F.col("n")).otherwise(0).alias("success"), "errors", "messages")


def accepted(new: DataFrame, existing: DataFrame, order: str = "row", fold_case: bool = False, admin: str | None = None) -> DataFrame:
    """New translations with ``status``: accepted, or the reason against (incomplete, exists, repeated).

    ``admin`` names a flag of new rows: what others add is private, whatever they ask for. A public english must be new
    among the public ones, a private one among all of the user's own. Of those that come together and are complete and
    new, the first counts: for a private row also against the public row of its own user.
    """
    key = F.lower if fold_case else F.col
    public = F.col("is_public") & F.col(admin) if admin else F.col("is_public")
    rows = new.withColumns({"is_public": F.coalesce(public, F.lit(False)), "__key": key("english")})
    rows = rows.withColumn("__user", F.col("user_id"))
    old = existing.select(F.col("user_id").alias("__user"), "is_public", key("english").alias("__key"))
    shown = old.where("is_public").select("__key").distinct().withColumn("__shown", F.lit(True))
    own = old.select("__user", "__key").distinct().withColumn("__own", F.lit(True))
    rows = rows.join(shown, "__key", "left").join(own, ["__user", "__key"], "left")
    complete = ~blank(F.col("english")) & ~blank(F.col("chinese"))
    held = F.coalesce(F.when(F.col("is_public"), F.col("__shown")).otherwise(F.col("__own")), F.lit(False))
    rows = rows.withColumns({"__fit": complete & ~held, "__held": held})
    # first ones by key are counts that merge before the shuffle, and join back: no window over a key
    first = rows.where("__fit and is_public").groupBy("__key").agg(F.min(F.struct(F.col(order).alias("at"), F.col("user_id").alias("by"))).alias("__first"))
    rows = rows.join(first, "__key", "left")
    behind = F.coalesce((F.col("__first.by") == F.col("user_id")) & (F.col("__first.at") < F.col(order)), F.lit(False))
    mine = rows.where(F.col("__fit") & ~F.col("is_public") & ~behind).groupBy("__user", "__key").agg(F.min(order).alias("__mine"))
    rows = rows.join(mine, ["__user", "__key"], "left")
    leads = F.when(F.col("is_public"), F.col("__first.at") == F.col(order)).otherwise(~behind & (F.col("__mine") == F.col(order)))
    status = F.when(~complete, "incomplete").when(F.col("__held"), "exists").when(leads, "accepted").otherwise("repeated")
    return rows.withColumn("status", status).select(*new.columns, "status")


def editable(user_id: int, admin: bool) -> Column:
    """Public rows are for admins alone, private ones for their owner alone."""
    return F.coalesce(F.when(F.col("is_public"), F.lit(admin)).otherwise(F.col("user_id") == user_id), F.lit(False))


def updated(existing: DataFrame, changes: DataFrame, user_id: int, admin: bool) -> DataFrame:
    """existing with one user's changes by id (english, chinese, dutch, category, and is_public if given and not null) applied where allowed.

    ``status`` is null for rows without a change, else changed, forbidden (not editable, or a change of is_public by
    somebody who is no admin), incomplete, or exists: a row that is or becomes public must have an english that no other
    public row has, a private one that no other row of the user has. All changes are judged by the rows as they were.
    """
    fields = ("english", "chinese", "dutch", "category")
    asked = F.col("is_public") if "is_public" in changes.columns else F.lit(None).cast("boolean")
    new = changes.select("id", *(F.col(c).alias(f"__{c}") for c in fields), asked.alias("__public"), F.lit(True).alias("__asked"))

    def taken(rows: DataFrame, name: str) -> DataFrame:
        ids = rows.groupBy(F.col("english").alias("__english")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
        return ids.select("__english", F.struct("low", "high").alias(name))

    met = existing.join(new, "id", "left").join(taken(existing.where("is_public"), "__shown"), "__english", "left").join(taken(existing.where(F.col("user_id") == user_id), "__own"), "__english", "left")
    becomes = F.coalesce("__public", "is_public")
    other = lambda c: F.coalesce((F.col(f"{c}.low") != F.col("id")) | (F.col(f"{c}.high") != F.col("id")), F.lit(False))
    moved = F.coalesce(F.col("__public") != F.col("is_public"), F.lit(False))
    status = (
        F.when(F.col("__asked").isNull(), None)
        .when(~editable(user_id, admin) | (moved & ~F.lit(admin)), "forbidden")
        .when(blank(F.col("__english")) | blank(F.col("__chinese")), "incomplete")
        .when(F.when(F.col("is_public") | becomes, other("__shown")).otherwise(other("__own")), "exists")
        .otherwise("changed")
    )
    done = met.withColumn("status", status)
    ok = F.coalesce(F.col("status") == "changed", F.lit(False))
    cols = {c: F.when(ok, F.col(f"__{c}")).otherwise(F.col(c)) for c in fields} | {"is_public": F.when(ok, becomes).otherwise(F.col("is_public"))}
    return done.withColumns(cols).select(*existing.columns, "status")


def deletable(df: DataFrame, user_id: int, admin: bool) -> DataFrame:
    """The rows that a user may delete: public ones as an admin, private ones as their owner."""
    return df.where(editable(user_id, admin))


def without(df: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def added_once(existing: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """New rows whose key neither exists nor came before; the first ones merge before the shuffle."""
    rest = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*key, "__r.*").select(*new.columns)
    return first.join(existing.select(*key).distinct(), key, "left_anti")


def upserted(users: DataFrame, logins: DataFrame, fields: list[str], key: str = "id", provider: str | None = None, as_of: Column | None = None, order: str | None = None) -> DataFrame:
    """Users after single-sign-on logins: matched by name and mail (two without a mail match too), non-empty fields replace; others are new and approved, with the next ids.

    Of several logins of one name and mail, which make one account, the last non-empty value of a field counts; ``order`` names the column that tells
    which is last (without it, the greatest row). Logins without a name are refused. Where accounts share name and mail, the one of the least id logs in.
    With a provider, sso_provider, sso_subject (the last login's ``sub``, '' without one) and last_login are set for all that logged in.
    """
    at = F.col(order) if order else F.struct(*sorted(logins.columns))
    subject = F.coalesce(F.col("sub"), F.lit("")) if "sub" in logins.columns else F.lit("")
    filled = {c: ~blank(F.col(c)) for c in fields}
    values = [F.max_by(F.when(ok, F.col(c)), F.when(ok, at)).alias(f"__{c}") for c, ok in filled.items()]  # max_by passes over rows without an order
    seen = logins.where(~blank(F.col("username"))).groupBy(F.col("username").alias("__name"), F.col("email").alias("__mail")).agg(*values, F.max_by(subject, at).alias("__sub"))
    owners = users.groupBy("username", "email").agg(F.min(key).alias("__key"))
    met = seen.join(owners, F.col("__name").eqNullSafe(F.col("username")) & F.col("__mail").eqNullSafe(F.col("email")), "left").drop("username", "email")

    def logged_in(rows: DataFrame, came: Column) -> DataFrame:
        cols = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in fields}
        if provider is not None:
            now = {"sso_provider": F.lit(provider), "sso_subject": F.col("__sub"), "last_login": as_of if as_of is not None else F.current_timestamp()}
            cols |= {c: F.when(came, v).otherwise(F.col(c)) for c, v in now.items()}
        return rows.withColumns(cols).select(*users.columns)

    old = users.join(met.where(F.col("__key").isNotNull()), F.col(key) == F.col("__key"), "left")
    last = users.agg(F.coalesce(F.max(key), F.lit(0)).alias("__last"))
    fresh = numbered(met.where(F.col("__key").isNull()).crossJoin(F.broadcast(last)), [], ["__name", "__mail"], F.pmod(F.xxhash64("__name", "__mail"), F.lit(64)), "__n")  # last is one row
    given = {key: (F.col("__last") + F.col("__n")), "username": F.col("__name"), "email": F.col("__mail"), "status": F.lit("approved")}
    fresh = fresh.withColumns({f.name: given.get(f.name, F.lit(None)).cast(f.dataType) for f in users.schema})
    return logged_in(old, F.col("__key").isNotNull()).unionByName(logged_in(fresh, F.lit(True)))


def roles_from_groups(users: DataFrame, mapping: DataFrame) -> DataFrame:
    """user_id and role_id: the role of the first group that has one."""
    groups = users.select("user_id", F.posexplode("groups").alias("pos", "group"))
    return groups.join(mapping, "group").groupBy("user_id").agg(F.min_by("role_id", "pos").alias("role_id"))


def seeded(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with those rows whose key it lacks."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def seed_grants(spark) -> DataFrame:
    """role, permission and description of the rows that a new system starts with."""
    rows = [(r, p, text) for r in ROLES for p, text in PERMISSIONS if r == "admin" or p in USER_PERMISSIONS]
    return spark.createDataFrame(rows, "role string, permission string, description string")


def backfilled(df: DataFrame, column: str = "is_public") -> DataFrame:
    return df.withColumn(column, F.coalesce(column, F.lit(False)))


def evolved(df: DataFrame, add: dict[str, str] | None = None, drop: tuple[str, ...] = (), change: dict[str, str] | None = None) -> DataFrame:
    """Columns added as null, dropped, or cast; each step only where it applies."""
    out = df.withColumns({c: F.lit(None).cast(t) for c, t in (add or {}).items() if c not in df.columns})
    out = out.drop(*drop)
    return out.withColumns({c: F.col(c).cast(t) for c, t in (change or {}).items() if c in out.columns})


def template(spark) -> DataFrame:
    return spark.createDataFrame(TEMPLATE[1:], list(TEMPLATE[0]))

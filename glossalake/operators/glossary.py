"""Glossary search, paging, lookups and dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossalake.functions.text import blank


def visible(user_id: int, scope: str = "all", owner: str = "user_id", public: str = "is_public") -> Column:
    """Rows a user may see: ``private`` (own, not public), ``public``, or both for any other scope."""
    own = (F.col(owner) == user_id) & ~F.col(public)
    return own if scope == "private" else F.col(public) if scope == "public" else own | F.col(public)


def matches(term: str | None, *columns: str) -> Column:
    """term within any column, in either case; % and _ in it stay wild; an empty term matches all rows."""
    if not term:
        return F.lit(True)
    return F.coalesce(reduce(Column.__or__, (F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in columns)), F.lit(False))


def equals_unless_all(column: str, value: str | None, everything: str = "all") -> Column:
    return F.lit(True) if value in (None, "", everything) else F.col(column) == value


def user_list(users: DataFrame, status: str | None = None) -> DataFrame:
    """Approved and disabled users, of one of these states or all."""
    return users.where(F.col("status").isin("approved", "disabled") & equals_unless_all("status", status))


def sso_users(users: DataFrame) -> DataFrame:
    """Users who came by single sign-on."""
    return users.where(F.col("sso_provider").isNotNull())


def holds_keyword(keyword: str, ingredient: str = "ingredient", name: str = "product", strict: bool = False) -> Column:
    """Whether either column contains the keyword in either case; strict: an empty one holds nothing, not even an empty keyword."""
    held = [F.contains(F.lower(c), F.lit(keyword.lower())) & (~blank(F.col(c)) if strict else F.lit(True)) for c in (ingredient, name)]
    return F.coalesce(held[0], F.lit(False)) | F.coalesce(held[1], F.lit(False))


def page(df: DataFrame, order: list[Column], number: int, per_page: int) -> DataFrame:
    """One page, in order: a top-k of number * per_page rows, never a full sort. End order with a unique key."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * per_page).limit(per_page)


def page_info(df: DataFrame, per_page: int) -> DataFrame:
    """total and pages, as one row."""
    return df.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / per_page).cast("bigint").alias("pages"))


def with_lookup(df: DataFrame, other: DataFrame, key: str, other_key: str, columns: dict[str, str], defaults: dict[str, str] | None = None) -> DataFrame:
    """df with columns of other (new name -> name) where key meets other_key; a missing partner gives null, or a default. Spark chooses to broadcast by size."""
    right = other.select(F.col(other_key).alias("__key"), *(F.col(c).alias(n) for n, c in columns.items()))
    out = df.join(right, df[key] == F.col("__key"), "left").drop("__key")
    return out.withColumns({c: F.when(blank(F.col(c)), v).otherwise(F.col(c)) for c, v in (defaults or {}).items()})


def holders_of(users: DataFrame, role_permissions: DataFrame, permissions: DataFrame, name: str) -> DataFrame:
    """Users whose role has a permission."""
    roles = role_permissions.join(permissions.where(F.col("name") == name), F.col("permission_id") == permissions["id"], "left_semi")
    return users.join(roles.select("role_id"), "role_id", "left_semi")


PAIRS = {(a.capitalize(), b.capitalize()): (a, b) for a in ("english", "chinese", "dutch") for b in ("english", "chinese", "dutch") if a != b}


def language_pair(df: DataFrame, source: str, target: str, columns: dict[str, str] | None = None) -> DataFrame:
    """(source, target) of the rows that have both; no row for an unknown pair of languages."""
    names = {x: x for x in ("english", "chinese", "dutch")} | (columns or {})
    if (source, target) not in PAIRS:
        return df.limit(0).select(F.lit("").alias("source"), F.lit("").alias("target"))
    a, b = (F.col(names[x]) for x in PAIRS[source, target])
    return df.where(~blank(a) & ~blank(b)).select(*(c for c in df.columns if c not in ("source", "target")), a.alias("source"), b.alias("target"))


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value for each key: that of the last row by order. Partial results merge before the shuffle."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def tagged_union(first: DataFrame, second: DataFrame, key: str, tags: tuple[str, str], suffix: str) -> DataFrame:
    """Both tables with their tag; a key of the second that the first has too gets a suffix."""
    taken = first.select(F.col(key).alias("__key")).distinct()
    met = second.join(taken, second[key] == F.col("__key"), "left")
    renamed = met.withColumn(key, F.when(F.col("__key").isNotNull(), F.concat(F.col(key), F.lit(suffix))).otherwise(F.col(key))).drop("__key")
    return first.withColumn("data_source", F.lit(tags[0])).unionByName(renamed.withColumn("data_source", F.lit(tags[1])))


def merged(order: str, key: str, value: str, *tables: DataFrame) -> DataFrame:
    """Union of tables by key, the rightmost one winning, and within it the last row by order."""
    parts = [t.select(key, value, F.struct(F.lit(k).alias("table"), F.col(order).alias("at")).alias("__at")) for k, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.max_by(value, "__at").alias(value))


def best_match(df: DataFrame, name: str, column: str, position: str) -> DataFrame:
    """The row whose column equals name (without case and outer blanks), else the first that contains it; one row at most."""
    low = F.lower(F.trim(F.col(column)))
    wanted = name.strip().lower()
    rank = F.when(low == wanted, 0).when(F.contains(low, F.lit(wanted)), 1)
    return df.withColumn("match_rank", rank).where("match_rank is not null").orderBy("match_rank", position).limit(1)


def length_statistics(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """One row: pairs, and the average, longest and shortest length of either side; 0 of nothing."""
    n = {"source": F.length(source), "target": F.length(target)}
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    out = [F.count("*").alias("total_pairs")]
    for side, c in n.items():
        out += [zero(F.avg(c), "double").alias(f"avg_{side}_length"), zero(F.max(c), "bigint").alias(f"max_{side}_length"), zero(F.min(c), "bigint").alias(f"min_{side}_length")]
    return pairs.agg(*out)


def within_lengths(pairs: DataFrame, source: str, target: str, least: int = 1, most: int = 1000) -> DataFrame:
    """Pairs of which both sides have a length within bounds."""
    return pairs.where(F.length(source).between(least, most) & F.length(target).between(least, most))


def file_users(files: DataFrame, position: str) -> DataFrame:
    """user_id and username of the users who have files; of several names the last one counts, files without an id or a name don't."""
    named = files.where(F.col("user_id").isNotNull() & (F.col("user_id") != 0) & ~blank(F.col("username")))
    return last_wins(named, "user_id", "username", position)


def first_seen(df: DataFrame, text: str, position: str) -> DataFrame:
    """Distinct texts in the order of their first place."""
    return df.groupBy(text).agg(F.min(position).alias("first")).orderBy("first")

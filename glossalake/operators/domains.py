"""Domains of texts by a fitted classifier: multinomial likelihoods of words, with every count and weight a table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossalake.shared import shared_dir

#: Weights that are broadcast at most.
MOST_ENTRIES = 1 << 18


def _words(c: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: whatever reads it, and how often, it is made once."""
    path = f"{shared_dir(df.sparkSession)}/domains-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit(df: DataFrame, domain: str = "domain", text: str = "text") -> DataFrame:
    """domain, word, weight: the logarithm of a word's share in a domain, with one added to every count; of the words of the whole table, the likelihood in a domain that lacks it
    stands in the row with a null word, which also holds ``prior``, that of the domain among the rows. Rows without a domain play no part.

    Counts merge before the shuffle; the table has a row for each word of a domain.
    """
    known = df.where(F.col(domain).isNotNull()).select(F.col(domain).alias("domain"), _words(F.col(text)).alias("words"))
    docs = known.groupBy("domain").agg(F.count("*").alias("docs"))
    counts = known.select("domain", F.explode("words").alias("word")).groupBy("domain", "word").agg(F.count("*").alias("n"))
    totals = docs.join(counts.groupBy("domain").agg(F.sum("n").alias("total")), "domain", "left")
    whole = docs.agg(F.sum("docs").alias("all")).crossJoin(counts.agg(F.countDistinct("word").alias("size")))  # one row
    sums = totals.crossJoin(F.broadcast(whole)).select("domain", (F.coalesce("total", F.lit(0)) + F.col("size")).alias("of"), F.log(F.col("docs") / F.col("all")).alias("prior"))
    weights = counts.join(F.broadcast(sums), "domain").select("domain", "word", F.log((F.col("n") + 1) / F.col("of")).alias("weight"), F.lit(None).cast("double").alias("prior"))  # a row a domain
    rest = sums.select("domain", F.lit(None).cast("string").alias("word"), F.log(1 / F.greatest("of", F.lit(1))).alias("weight"), "prior")
    return weights.unionByName(rest)


def predict(df: DataFrame, weights: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, domain and margin (to the next likely domain, of log-likelihoods; null with one domain) for each key: the likeliest domain, of equally likely ones the first by name.

    Words that no domain has play no part, so that a text without known words, a null one too, goes by the priors. Rows of one key count as one text.
    The weights are written down once. Frequent words, ``MOST_ENTRIES`` weights at most, are looked up where the texts are read, so that a text
    shuffles a row a domain; the others meet their weights in a join.
    """
    weights = _written(weights)
    base = weights.where(F.col("word").isNull()).select("domain", F.col("weight").alias("least"), "prior")
    gains = weights.where(F.col("word").isNotNull()).join(F.broadcast(base), "domain")  # a row a domain
    entry = F.struct("domain", (F.col("weight") - F.col("least")).alias("gain"))
    # of a word: its gain in each domain, and under no domain the one that it adds to a text's length
    known = gains.groupBy("word").agg(F.max(entry["gain"]).alias("most"), F.collect_list(entry).alias("entries"))
    known = known.select("word", F.floor(F.col("most") * 8).alias("most"), F.array_append("entries", F.struct(F.lit(None).cast("string").alias("domain"), F.lit(1.0).alias("gain"))).alias("entries"))
    room, least = MOST_ENTRIES, None
    for r in known.groupBy("most").agg(F.sum(F.size("entries")).alias("n")).orderBy(F.desc("most")).collect():  # eight rows for each power of e that counts reach
        if (room := room - r["n"]) < 0:
            break
        least = r["most"]
    often = F.col("most") >= F.lit(least).cast("bigint") if least is not None else F.lit(False)
    frequent, rare = known.where(often).select("word", "entries"), known.where(~often).select("word", "entries")
    words = df.select(F.col(key).alias("key"), F.explode(_words(F.col(text))).alias("word"))
    met = words.join(F.broadcast(frequent), "word").select("key", F.inline("entries"))
    if room < 0:
        left = words.join(F.broadcast(frequent.select("word")), "word", "left_anti")
        met = met.unionByName(left.join(rare, "word").select("key", F.inline("entries")))
    met = met.unionByName(df.select(F.col(key).alias("key"), F.lit(None).cast("string").alias("domain"), F.lit(0.0).alias("gain")))  # every key
    sums = met.groupBy("key", "domain").agg(F.sum("gain").alias("gain")).groupBy("key").agg(
        F.sum(F.when(F.col("domain").isNull(), F.col("gain"))).alias("length"), F.map_from_entries(F.collect_list(F.when(F.col("domain").isNotNull(), F.struct("domain", "gain")))).alias("gains")
    )
    every = base.agg(F.collect_list(F.struct("domain", "least", "prior")).alias("base")).where(F.size("base") > 0)  # one row, of all domains
    loss = lambda x: -(x["prior"] + F.col("length") * x["least"] + F.coalesce(F.try_element_at("gains", x["domain"]), F.lit(0.0)))
    best = sums.crossJoin(F.broadcast(every)).select("key", F.array_sort(F.transform("base", lambda x: F.struct(loss(x).alias("loss"), x["domain"].alias("domain")))).alias("r"))
    return best.select(F.col("key").alias(key), F.col("r")[0]["domain"].alias("domain"), (F.get("r", F.lit(1))["loss"] - F.col("r")[0]["loss"]).alias("margin"))

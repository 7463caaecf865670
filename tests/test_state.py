"""Commits of two writers, tasks that fall silent, fitted domains, words without blanks."""

import math
import os
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossalake.functions import segment
from glossalake.operators import domains
from glossalake.sources import versions


def numbers(spark, *n):
    return spark.createDataFrame([(k,) for k in n], "id int")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "store")
    with versions.session(spark, path) as s:
        s.put("a", numbers(spark, 1))
        s.put("b", numbers(spark, 10))
    one, two = versions.Session(spark, path), versions.Session(spark, path)
    one.put("a", one.read("a").union(numbers(spark, 2)))
    two.put("a", numbers(spark, 9))
    two.put("b", numbers(spark, 99))
    assert ids(versions.state(spark, path, "a")) == [1]  # nothing shows before a commit
    assert one.commit() == 2
    lost = two.folder
    with pytest.raises(versions.Conflict):
        two.commit()
    assert not os.path.exists(f"{path}/{lost}")
    assert ids(versions.state(spark, path, "a")) == [1, 2] and ids(versions.state(spark, path, "b")) == [10]
    assert ids(versions.state(spark, path, "a", 1)) == [1]
    assert versions.Session(spark, path).commit() == 2  # nothing changed, no version


def test_an_error_rolls_back(spark, tmp_path):
    path = str(tmp_path / "store")
    with versions.session(spark, path) as s:
        s.put("a", numbers(spark, 1))
    before = sorted(os.listdir(path))
    with pytest.raises(KeyError), versions.session(spark, path) as s:
        s.put("a", numbers(spark, 2))
        assert ids(s.read("a")) == [2]
        s.read("missing")
    assert sorted(os.listdir(path)) == before and ids(versions.state(spark, path, "a")) == [1]


def test_a_version_is_claimed_once(spark, tmp_path):
    store = versions._Store(spark, str(tmp_path / "store"))
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if store.claim(1, {"t": str(k)}) else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store.tables(1) == {"t": str(won[0])} and store.versions() == [1]


def test_half_a_marker_is_no_state(spark, tmp_path):
    path = str(tmp_path / "store")
    with versions.session(spark, path) as s:
        s.put("a", numbers(spark, 1))
    (tmp_path / "store" / "markers" / f"{2:012d}").touch()  # of a writer at work
    assert versions.Session(spark, path).base == 1 and ids(versions.state(spark, path, "a")) == [1]


def test_silent_tasks_time_out(spark, tmp_path):
    from glossalake.streaming.lifecycle import task_lifecycle

    src, schema = str(tmp_path / "in"), "task_id string, seq long, status string, at timestamp"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def events(*rows):
        df = spark.createDataFrame([(t, k, s, f"2024-01-01 {at}") for t, k, s, at in rows], "task_id string, seq long, status string, at string")
        df.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(src)

    try:
        events(("silent", 1, "processing", "00:00:00"), ("done", 1, "processing", "00:00:00"), ("done", 2, "completed", "00:10:00"), ("again", 1, "failed", "00:05:00"))
        q = task_lifecycle(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("life").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        first = {(r.task_id, r.status, r.retry_count, r.reason) for r in spark.table("life").collect()}
        assert first == {("silent", "processing", 0, None), ("done", "completed", 0, None), ("again", "waiting", 1, None)}
        events(("again", 2, "processing", "00:50:00"))  # puts its timer off
        q.processAllAvailable()
        events(("other", 1, "processing", "01:30:00"))  # the watermark passes 01:00
        q.processAllAvailable()
        events(("other", 2, "completed", "01:31:00"))
        q.processAllAvailable()
        later = {(r.task_id, r.status, r.retry_count, r.reason) for r in spark.table("life").collect()} - first
        assert ("silent", "failed", 0, "timeout") in later and not any(t == "again" and r for t, _, _, r in later)
        rows = {p["numRowsTotal"] for p in q.lastProgress["stateOperators"]}
        assert rows == {1} or max(rows) <= 4  # only again (its value and timers) is left
        q.stop()
        left = spark.read.format("statestore").option("stateVarName", "task").load(str(tmp_path / "cp"))
        assert [r["key"]["task_id"] for r in left.collect()] == ["again"]
    finally:
        spark.conf.set(key, before)


def plain_domains(train, texts):
    import re

    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    counts, docs = {}, Counter()
    for t, d in train:
        if d is not None:
            counts.setdefault(d, Counter()).update(words(t))
            docs[d] += 1
    known = set().union(*counts.values())
    out = {}
    for k, t in texts:
        score = {d: math.log(docs[d] / sum(docs.values())) + sum(math.log((c[w] + 1) / (sum(c.values()) + len(known))) for w in words(t) if w in known) for d, c in counts.items()}
        out[k] = min(score, key=lambda d: (-score[d], d))
    return out


def test_domains_are_those_of_plain_counts(spark):
    rng = random.Random(6)
    vocabulary = {d: [f"{d}{'abcdef'[k]}" for k in range(6)] + ["the", "of", "Über"] for d in ("law", "art", "it")}
    text = lambda d: " ".join(rng.choice(vocabulary[d]) for _ in range(rng.randrange(0, 9)))
    train = [(text(d), d) for d in rng.choices(["law", "art", "art", "it"], k=60)] + [("words of none", None), (None, "it")]
    texts = [(k, f"{text(rng.choice(list(vocabulary)))} 12 new {text('it')}") for k in range(50)] + [(100, None), (101, ""), (102, "unknown words")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    weights = domains.fit(spark.createDataFrame(train, "text string, domain string"))
    assert {r.doc_id: r.domain for r in domains.predict(df, weights).collect()} == plain_domains(train, texts)
    assert domains.predict(df.limit(0), weights).count() == 0


def test_domains_of_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("lang is not null").select("doc_id", "text", F.col("lang").alias("domain"))
    told = domains.predict(docs.where("doc_id % 2 = 1"), domains.fit(docs.where("doc_id % 2 = 0")))
    right = told.withColumnRenamed("domain", "told").join(docs, "doc_id").agg(F.avg((F.col("told") == F.col("domain")).cast("double"))).first()[0]
    assert right > 0.9


def test_domains_are_the_same_however_many_words_are_looked_up(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", F.col("lang").alias("domain"))
    weights, told = domains.fit(docs.where("doc_id % 2 = 0")), []
    for most in (0, 3000, 1 << 18):
        monkeypatch.setattr(domains, "MOST_ENTRIES", most)
        told.append({r.doc_id: (r.domain, round(r.margin, 6)) for r in domains.predict(docs, weights).collect()})
    assert told[0] == told[1] == told[2] and len(told[0]) == docs.count()


def test_the_likeliest_words_of_all(spark):
    rng = random.Random(3)
    for _ in range(200):
        counts = {"".join(rng.choice("中国人民") for _ in range(rng.randrange(1, 4))): rng.randrange(1, 50) for _ in range(rng.randrange(1, 12))}
        own, total = segment.Dictionary(counts), math.log(sum(counts.values()))
        text = "".join(rng.choice("中国人民大") for _ in range(rng.randrange(0, 9)))

        def score(words, counts=counts, total=total):
            return sum(math.log(counts.get(w, 1)) - total for w in words)

        paths = [[]]
        for c in text:  # all ways to cut the text into dictionary words and single characters
            paths = [p + [c] for p in paths] + [p[:-1] + [p[-1] + c] for p in paths if p]
        allowed = [p for p in paths if all(len(w) == 1 or w in counts for w in p)]
        got = own.words(text)
        assert "".join(got) == text and got in allowed or not text
        assert math.isclose(score(got), max(map(score, allowed)), abs_tol=1e-9)


def test_segmented_texts(spark):
    words = spark.createDataFrame([("我们", 5), ("喜欢", 3), ("喜欢", 1), ("苹果", 2), ("", 4), (None, 1), ("我", 0)], "word string, n int")
    df = spark.createDataFrame([(1, "我们喜欢苹果, don't we? 3.5 kg"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.w for r in df.select("id", segment.segmenter(words)("text").alias("w")).collect()}
    assert got == {1: ["我们", "喜欢", "苹果", ",", "don't", "we", "?", "3.5", "kg"], 2: [], 3: []}


class Read(str):
    """Counts how often its characters are asked for."""

    times = 0

    def __getitem__(self, k):
        Read.times += 1
        return str.__getitem__(self, k)


def test_segmenting_reads_each_character_once_however_long_words_are():
    own = segment.Dictionary({"a" * 300 + "b": 3, "a": 2, "aa": 1})
    Read.times, text = 0, Read("a" * 600 + "b")
    assert own.words(text)[-1] == "a" * 300 + "b"
    assert Read.times <= 2 * len(text)  # and once more for each word found

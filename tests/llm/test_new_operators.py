"""Repetition rules, token alignment and centroid clusters against plain versions, through the queries, and at their edges."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossalake.llm import alignment, centroids, queries, repetition

BLANKS = r"[^\x20\x09-\x0D]+"
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (None, "a b"), (7, "x" * 30_000), (8, "word " * 4000)]


def documents(spark, rows):
    """With columns whose names an operator might use itself."""
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n_words long, batch string, kept int")


# repetition rules


def plain_rules(text):
    text = text or ""
    words = re.findall(BLANKS, text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    seen, again = set(), []
    for line in text.split("\n"):
        if re.search(BLANKS, line):
            if line in seen:
                again.append(line)
            seen.add(line)
    out |= {"n_dup_lines": len(again), "dup_line_chars": sum(len(w) for line in again for w in re.findall(BLANKS, line))}
    for n in repetition.NGRAMS:
        starts = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        held, seen = Counter(starts), set()
        twice, later = set(), set()
        for k, w in enumerate(starts):
            if held[w] > 1:
                twice |= set(range(k, k + n))
            if w in seen:
                later |= set(range(k, k + n))
            seen.add(w)
        if n == 5:
            out["n_repeat_words"] = len(twice)
        out[f"dup_chars_{n}"] = sum(len(words[k]) for k in later)
    out["base_failed"] = len(words) < 10 or 100 * out["n_repeat_words"] > 20 * len(words)
    over = 100 * out["dup_line_chars"] > 30 * out["word_chars"] or any(100 * out[f"dup_chars_{n}"] > most * out["word_chars"] for n, most in repetition.NGRAMS.items())
    return out | {"kept": not out["base_failed"] and not over}


def repetitive(seed):
    rng = random.Random(seed)
    words = [f"wörd{k}" for k in range(6 if seed % 3 else 400)]
    out = []
    for _ in range(rng.randrange(1, 30)):
        out.append(rng.choice(out) if out and rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))))
    return rng.choice(["\n", "\r\n", "\n\n", "\v"]).join(out) + rng.choice(["", "#|%", "  x　y"])


def test_repetition_is_that_of_plain_windows():
    texts = [repetitive(seed) for seed in range(150)] + ["", " ", "a", "a b a b a b a b a b a b"]
    got = repetition.measures(pa.array(texts))
    failed, kept = repetition.judged(got)
    for k, text in enumerate(texts):
        assert {**{c: int(got[c][k]) for c in repetition.COUNTS}, "base_failed": bool(failed[k]), "kept": bool(kept[k])} == plain_rules(text)


def test_a_collision_draws_other_values(monkeypatch):
    codes, of = np.array([0, 1, 0, 1, 2, 3, 0, 1, 2, 3]), np.zeros(10, np.int64)
    want = repetition.repeats(codes, of, [2, 3])
    drawn = []

    def generator(seed):
        drawn.append(seed)
        rng = np.random.Generator(np.random.PCG64(seed))
        if seed > 2:
            return rng

        class Same:
            def integers(self, low, high, size=None, dtype=np.int64):
                return rng.integers(low, high) if size is None else np.zeros(size, dtype)  # all words have one value

        return Same()

    monkeypatch.setattr(np.random, "default_rng", generator)
    got = repetition.repeats(codes, of, [2, 3])
    assert drawn == [1, 2, 3]
    assert all(np.array_equal(np.sort(a), np.sort(b)) for n in (2, 3) for a, b in zip(want[n], got[n], strict=True))


def test_repetition_query_against_the_plain_rules(spark, tmp_path):
    rows = [(k, repetitive(k)) for k in range(40)] + EDGES
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_quality_rules(spark, str(tmp_path))
    assert found.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(str((i, sorted(plain_rules(t).items()))) for i, t in rows)
    assert sorted(str((r.doc_id, sorted((k, v) for k, v in r.asDict().items() if k != "doc_id"))) for r in found.collect()) == want


def test_texts_are_measured_in_portions():
    texts = pa.array(["a" * n for n in (3, 3, 50, 0, 0, 3)])
    assert [p.to_pylist() for p in repetition.portions(texts, 6)] == [["aaa", "aaa"], ["a" * 50], ["", "", "aaa"]]
    assert list(repetition.portions(pa.array([], pa.string()))) == []
    assert [len(p) for p in repetition.portions(texts.slice(1, 4), 6)] == [1, 1, 2]


def test_rules_filter_rows(spark):
    good = " ".join(f"w{k}" for k in range(30))
    docs = documents(spark, [(1, good), (2, "again and again it says this " * 9), (3, None), (1, good)])
    kept = repetition.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [1, 1]
    assert repetition.keep_good(documents(spark, [])).count() == repetition.rate(documents(spark, [])).count() == 0
    assert repetition.rate(spark.createDataFrame([("k", good)], "name string, body string"), "name", "body").first()["kept"]


# token alignment


@pytest.fixture(scope="module")
def sides():
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    import sentencepiece

    return one, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


PAIR = alignment.Pair(public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model"))


def plain_alignment(rows, one, two):
    """By sets of ends and all pairs of tokens that end together."""
    letters = alignment._byte_letters()
    docs, pairs = [], Counter()
    for i, text in rows:
        whole = f" {text}".encode()
        a = one.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        of_a = [bytes(letters[c] for c in one.id_to_token(x)) for x in a]
        of_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := two.id_to_piece(x)) else p.replace("▁", " ").encode() for x in b]
        if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
            docs.append((i, [], [], [], ""))
            continue
        end = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ends_a, ends_b = end(of_a), end(of_b)
        links = [(a[x], b[y]) for x in range(len(a)) for y in range(len(b)) if ends_a[x] == ends_b[y]]
        groups, low = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(v) for v, e in zip(a, ends_a, strict=True) if low < e <= cut) + "|" + ",".join(str(v) for v, e in zip(b, ends_b, strict=True) if low < e <= cut))
            low = cut
        pairs.update(links)
        docs.append((i, a, b, links, ";".join(groups)))
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(n, most.get(b, 0))
    return sorted(str((i, len(a), len(b), g.count(";") + bool(g), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), g)) for i, a, b, links, g in docs)


def mixed_texts():
    rng = random.Random(5)
    parts = ["the", "Größe", "naïve", "你好", "こんにちは", "  ", "\n\n", "\t", "123456", "don't", "<|endoftext|>", "<0x41>", "<s>", "🙂🙂", "▁", "​", "é", "é", "\x00", "ﬁ", "x" * 40, ".", "!!", " "]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]


def test_alignment_is_that_of_all_pairs_of_ends(spark, sides):
    rows = [(k, t) for k, t in enumerate(mixed_texts())] + [(i, t and t[:600]) for i, t in EDGES] + [(900, "the cat"), (900, "the cat"), (901, "a▁b")]
    want = plain_alignment(rows, *sides)
    for size in (1 << 20, 200):  # one batch a task, and a few texts a batch
        found = alignment.align(documents(spark, rows), PAIR, batch_bytes=size)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        assert sorted(str(tuple(r)) for r in found.collect()) == want
    assert alignment.align(documents(spark, []), PAIR).count() == 0
    assert [tuple(r) for r in alignment.align(documents(spark, [(1, None), (2, "")]), PAIR).orderBy("doc_id").collect()] == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_alignment_query_gives_digests(spark, sides, tmp_path):
    rows = [(k, t) for k, t in enumerate(mixed_texts()[:20])] + [(100, None), (101, "a▁b")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    whole = {int(eval(w)[0]): eval(w) for w in plain_alignment(rows, *sides)}
    for r in queries.op12_token_alignment(spark, str(tmp_path)).collect():
        *counts, groups = whole[r.doc_id]
        assert tuple(r) == (*counts, hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_every_character_is_split_alike_by_both_libraries(sides):
    """The faster library stands for the vocabulary's own one: each character between letters, digits, blanks and signs."""
    one, fast = sides[0], alignment.byte_level(PAIR.first, PAIR.pattern)
    there = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for shape in ("a{0}b 1{0}2", " {0}{0} .{0}"):
        for at in range(0, len(there), 4000):
            texts = [shape.format(c) for c in there[at : at + 4000 : 1 if at < 70_000 else 40]]
            assert fast.encode(texts) == [e.ids for e in one.encode_batch(texts, add_special_tokens=False)]


def test_words_end_where_neither_side_goes_on():
    assert alignment.words("a b") == ["a", "b"] and alignment.words("") == [""]
    assert alignment.words(" a  b\n c ") == [" a  b\n c "]
    assert alignment.words("a\u3000 b c") == ["a\u3000 b", "c"]
    for text in mixed_texts():
        assert " ".join(alignment.words(text)) == text


def test_two_pointers_meet_at_common_ends():
    assert alignment.merged([1, 3, 4, 9], [2, 3, 7, 9]) == ([2, 4], [2, 4])
    assert alignment.merged([], [1]) == ([], [])
    assert alignment.grouped(list("abcd"), list("wxyz"), np.array([2, 3, 4]), np.array([2, 3, 4])) == ["a,b|w,x", "c|y", "d|z"]


# centroid clusters


def plain_clusters(rows, k=8, rounds=10, dim=64):
    """In Python's integers, vector by vector."""
    from fractions import Fraction
    from math import floor, isfinite

    kept = [(i, [floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), [x / 1024 for x in v], v) for i, v in kept if i is not None)
    centres = [v for *_, v in first[:k]]
    if not centres:
        return []

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, v in kept:
            members[near(v)[1]].append(v)
        centres = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else old for m, old in zip(members, centres, strict=True)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    long = lambda n: n if n < 1 << 63 else None
    return sorted(str((i, c, long(d), long(inertia[c]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())) for i, c, d in found)


def vectors(seed, n, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((5, 64))
    return [(int(k), [float(np.float32(x)) for x in (middle[k % 5] + rng.standard_normal(64) * 0.4) * spread]) for k in range(n)]


def embeddings(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, flat string")


@pytest.mark.parametrize("spread", [1.0, 3e3, 5e9, 1e30])
def test_clusters_are_those_of_plain_integers(spark, spread):
    """Of floats that product, 64-bit and arbitrary integers settle."""
    rows = vectors(1, 120, spread)
    got = centroids.cluster(embeddings(spark, rows).repartition(5))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_clusters(rows)


def test_clusters_of_mixed_magnitudes_and_unsound_vectors(spark, tmp_path):
    rows = vectors(2, 60)
    rows += [(1000 + k, [0.5] * 63 + [x]) for k, x in enumerate((1e15, -3e25, 1e300, 1.7e308, 8.8e12, -8.8e12))]
    bad = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [1.0] * 63 + [float("nan")]), (2005, [float("-inf")] * 64), (2006, [1.0] * 65)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (7, [0.25] * 64), *bad]
    embeddings(spark, rows, "double").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op13_centroid_clusters(spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in found.collect()) == plain_clusters(rows)


def test_few_or_no_vectors(spark):
    for rows in ([], [(1, None)], [(None, [1.0] * 64)], vectors(3, 3), [(k, [0.5] * 64) for k in range(12)]):
        assert sorted(str(tuple(r)) for r in centroids.cluster(embeddings(spark, rows)).collect()) == plain_clusters(rows)


def test_distances_at_the_bounds_are_exact():
    rng = random.Random(9)
    for most in (1, 2**22 - 1, 2**23, 2**28, 2**29, 2**40, 2**70):
        x = [[rng.choice((-most, most, most - 1, rng.randrange(-most, most + 1))) for _ in range(64)] for _ in range(20)]
        c = tuple(tuple(rng.choice((-most, most, 0)) for _ in range(64)) for _ in range(3))
        got = centroids.distances(np.array(x, np.int64 if most < 2**62 else object), c)
        assert [[int(v) for v in row] for row in got] == [[sum((p - q) ** 2 for p, q in zip(row, z, strict=True)) for z in c] for row in x]


def test_blocks_survive_being_small(spark, monkeypatch):
    rows = vectors(4, 50)
    monkeypatch.setattr(centroids, "BLOCK", 7)
    assert sorted(str(tuple(r)) for r in centroids.cluster(embeddings(spark, rows).coalesce(1)).collect()) == plain_clusters(rows)


@pytest.mark.parametrize("name", ["op11_quality_rules", "op13_centroid_clusters"])
def test_sql_gives_the_same(spark, duck, data, name):
    found = queries.QUERIES[name](spark, data)
    order = sorted(found.columns)
    want = duck.sql(queries.ORACLES[name]).select(*order)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in found.select(*order).collect())


def test_query_of_alignment_covers_every_document(spark, data):
    found = queries.op12_token_alignment(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert found.count() == docs.count()
    assert found.where("n_groups = 0").join(docs.where(F.length("text") > 0), "doc_id").count() < docs.count() // 100


# sharding and decontamination: what the last round's verdict found


@pytest.mark.parametrize("hot", [0, 0.02, 0.045, 0.3])
def test_few_stretches_are_opened_beside_a_hot_text(hot):
    from glossalake.llm import sharding

    rng = random.Random(7)
    groups = sorted((rng.getrandbits(64) - (1 << 63), rng.randrange(9, 4000)) for _ in range(150_000))
    if hot:
        k = rng.randrange(len(groups))
        groups[k] = groups[k][0], int(sum(b for _, b in groups) * hot / (1 - hot))
    places = np.array([h for h, _ in groups])
    opened = []

    def sums(rows, bits):
        held = {}
        for h, b in rows:
            held.setdefault(h >> (64 - bits), []).append(b)
        return [sharding.Stretch(at << (64 - bits), bits, sum(x), len(x) == 1 or bits == 64) for at, x in sorted(held.items())]

    def closer(wanted):
        opened.extend(wanted)
        out = []
        for p in wanted:
            a, b = np.searchsorted(places, p.start), np.searchsorted(places, p.start + (1 << (64 - p.bits)) - 1, "right")
            out += sums(groups[a:b], min(64, p.bits + 8))
        return out

    parts = sharding.settled(sums(groups, 16), 24, closer)
    assert sharding.capacity([p.bytes for p in parts], 24) == sharding.capacity([b for _, b in groups], 24)
    assert len(opened) < 2000


def test_both_ways_of_decontamination_agree(spark):
    from glossalake.llm import decontamination

    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    items = [(f"i{k}", words(rng.randrange(1, 30))) for k in range(20)]
    items += [("r", "a b c d e f g h i j"), ("r", "zz"), ("s", "a b c d e f g h i j"), ("s", "A b"), ("n", None), (None, "a b c d e f g h i j"), ("t", None), ("t", "k l m n o p q r s t"), ("e", "")]
    docs = [(k, f"{words(10)} {rng.choice(items)[1] or ''} {words(5)}") for k in range(60)] + [(100, "x a b c d e f g h i j y"), (101, "k l m n o p q r s t"), (102, None), (103, ""), (100, "x a b c d e f g h i j y")]
    df = documents(spark, docs)
    bench = spark.createDataFrame(items, "item_id string, text string")
    one, two = (sorted(map(str, decontamination.contaminations(df, bench, broadcast_bytes=n).collect())) for n in (1 << 20, 0))
    assert one == two and any("'t'" in r for r in one) and not any("'r'" in r for r in one)
    assert sum("doc_id=100" in r and "item_id='s'" in r for r in one) == 2


# texts with many frequent entities


def test_many_shared_addresses_cost_what_one_does(spark):
    import time

    from glossalake.llm import pii

    words = " ".join(f"word{k}" for k in range(2500))
    filler = [(k, f"nothing to see {k}") for k in range(100, 160)]

    def taken(address):
        rows = [(d, f"{words} " + " ".join(address(d, k) for k in range(500))) for d in range(4)] + filler
        start = time.perf_counter()
        found = pii.find(documents(spark, rows)).select("doc_id", F.size("spans").alias("n")).collect()
        return time.perf_counter() - start, {r.doc_id: r.n for r in found}

    taken(lambda d, k: "a@b.org")
    alone, some = taken(lambda d, k: f"a{k}.{d}@b.org")
    shared, all_told = taken(lambda d, k: f"a{k}@b.org")
    assert some[0] == 500 and all_told[0] == 500 + 2500 and all_told[100] == 0  # words of those four texts alone tell the addresses
    assert shared < 2 * alone + 10


def test_classes_of_entities_and_terms_give_what_single_ones_do(spark):
    """Entities with the same, overlapping and different documents, repeated rows, null ids: against counting by pairs."""
    import math

    from glossalake.llm import pii

    rng = random.Random(12)
    names, places = [f"n{k}@x.org" for k in range(8)], [f"place{k}" for k in range(12)]
    rows = []
    for k in range(90):
        held = sorted({rng.choice(names[:2] if k % 3 else names) for _ in range(rng.randrange(3))} | ({"n5@x.org", "n6@x.org"} if k % 9 == 0 else set()))
        rows.append((k if k % 10 else None, " ".join([*held, *rng.sample(places, 3), *(["hideout"] if "n5@x.org" in held else []), f"u{k}"])))
    rows += rows[:7]
    docs = [(set(re.findall(r"n\d@x\.org", t)), {w.lower() for w in re.findall(r"[^\W_]+", t)}) for _, t in rows]
    n_e, n_t, both = Counter(e for es, _ in docs for e in es), Counter(w for _, ws in docs for w in ws), Counter((e, w) for es, ws in docs for e in es for w in ws)

    def share(e, w):
        own = math.log2(len(rows) / n_e[e])
        return math.log2(len(rows) * both[e, w] / (n_t[w] * n_e[e])) / own if both[e, w] >= 3 and n_e[e] >= 3 and own > 0 else 0

    want = []
    for (i, t), (es, _) in zip(rows, docs, strict=True):
        marked = []
        for m in re.finditer(r"[^\W_]+", t):
            most = max((share(e, m[0].lower()) for e in es), default=0)
            if most >= 0.6 and not any(a.start() <= m.start() and m.end() <= a.end() for a in re.finditer(r"n\d@x\.org", t)):
                marked.append((m.start(), m.end(), "removed" if most >= 0.8 else "generalised"))
        want.append(str((i, t, marked)))
    found = pii.find(documents(spark, rows)).collect()
    texts = {r.h: r.text for r in documents(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
    got = [str((r.doc_id, texts[r.text_hash], [(s.start, s.end, s.kind) for s in r.spans if s.kind not in pii.KINDS])) for r in found]
    assert sorted(got) == sorted(want) and any("hideout" in w and "[(" in w for w in want)


# digests and statistics of earlier queries against plain ones


def test_token_query_against_the_library(spark, data):
    """Every document of the smallest tables."""
    import tiktoken

    from glossalake.llm import byte_bpe

    ranks = byte_bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        ids = other.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(other.decode_bytes(ids))))
    assert sorted(tuple(r) for r in queries.op4_byte_bpe(spark, data).collect()) == sorted(want)


def test_language_statistics_and_query(spark, data, tmp_path):
    import zlib

    from glossalake.llm import language_id

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    freq, n = language_id.document_frequencies(docs.select("text"))
    held = [set(language_id.sparse(r.text)[0].tolist()) for r in rows]
    assert n == sum(map(bool, held)) and Counter(b for h in held for b in h) == {k: int(v) for k, v in enumerate(freq) if v}
    got = {r.doc_id: r for r in queries.op10_language_id(spark, data).collect()}
    assert {i: r.held_out for i, r in got.items()} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    assert {r.lang_pred for r in got.values()} <= {r.lang for r in rows} - {None} | {"und"} and all(0 <= r.score <= 1 for r in got.values())
    assert all((got[r.doc_id].lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    learnt = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    learnt.write.parquet(f"{tmp_path}/documents.parquet")  # without the held-out rows the predictions of the others are the same
    again = {r.doc_id: (r.lang_pred, r.score) for r in queries.op10_language_id(spark, str(tmp_path)).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in got.items() if not r.held_out}

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import common as C
from tidegauge.llm import decontaminate, jaccard_join, quality_rules, sharding, token_counts, url_filter

rng = random.Random(4)
WORDS = ["w%d" % k for k in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = [prose(60) for _ in range(12)]
NEAR = [" ".join(w if k not in (7, 30) else "changed" for k, w in enumerate(t.split())) for t in BASE[:4]]
TEXTS = [None, "", "  \n ", "one two", "one two", *BASE, *BASE[:3], *NEAR, BASE[0].upper(), prose(4000), "É" + BASE[1], "\n\nx  y \n", "▁a  b", prose(3)]
ROWS = [(k, t, "de" if k % 3 else None, "hot" if k % 2 else None, -1) for k, t in enumerate(TEXTS)]
#: Extra columns with the names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_words int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def words_of(t):
    return re.findall(C.FOLDED_WORD, (t or "").lower())


def test_jaccard_join_against_all_pairs(spark, docs):
    sets = {}
    for k, t, *_ in ROWS:
        w = words_of(t)
        sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links = {k: {j for j, s in sets.items() if j != k and s and len(s & sets[k]) >= 0.8 * len(s | sets[k])} for k in sets}
    root = {}
    for k in sets:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        root[k] = min(seen)
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(docs).collect()}
    assert {k: (r.class_id, r.n_links) for k, r in got.items()} == {k: (root[k], len(links[k])) for k in sets}
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {k for k in sets if root[k] == k}


def test_jaccard_join_splits_and_blocks(spark, docs):
    small = jaccard_join.ChosenPaths(split_above=3, block=2)
    key = lambda df: sorted((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in df.collect())
    assert key(jaccard_join.jaccard_join(docs, small)) == key(jaccard_join.jaccard_join(docs))


@pytest.mark.parametrize("operator", [lambda d: jaccard_join.jaccard_join(d), lambda d: sharding.interleave(d)])
def test_empty_tables(docs, operator):
    assert operator(docs.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark, docs):
    lower = lambda t: re.findall(C.FOLDED_WORD, (t or "").translate({k: k + 32 for k in range(65, 91)}))
    items = [(1, " ".join(BASE[0].split()[5:25])), (2, BASE[0].title()), (3, "one two"), (4, None), (5, ""), (6, " ".join(BASE[1].split()[:10])), (7, "é" + " ".join(BASE[1].split()[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit(0)).withColumn("words", F.lit(0))
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, broadcast_bytes=0).collect()}
    again = decontaminate.decontaminate(docs.union(docs).withColumn("row", F.lit(1)), bench).collect()
    assert sorted(map(str, again)) == sorted(map(str, [*got.values(), *got.values()]))
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    for k, t, *_ in ROWS:
        w, hit, ids = lower(t), set(), set()
        for i, x in items:
            b = lower(x)
            n = min(10, len(b))
            for p in range(len(b) - n + 1) if b else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == b[p : p + n]:
                        hit |= set(range(s, s + n))
                        ids.add(i)
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(ids), sha, bool(hit))
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count() == 0


def test_rules_counts_and_risk(spark, docs):
    bad = [(1000 + k, "!? ".join(["#%d" % (k * j) for j in range(30)]), "de", None, 0) for k in range(40)]
    good = [(2000 + k, prose(20), "de", None, 0) for k in range(900)]
    all_docs = docs.union(spark.createDataFrame(bad + good, SCHEMA))
    labels = spark.createDataFrame([(d[0], int(d[0] >= 2000), 0) for d in bad + good] + [(99999, 1, None), (0, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(all_docs, labels).collect()}
    assert not any(got[d[0]].kept for d in bad) and all(got[d[0]].kept for d in good)
    for k, t, *_ in ROWS:
        w = re.findall(C.SPACED_WORD, t or "")
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        count = Counter(grams)
        rep = {q for j, g in enumerate(grams) if count[g] > 1 for q in range(j, j + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(C.SPACED_WORD, x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(rep), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))
    again = quality_rules.quality_rules(all_docs.union(docs).withColumn("words", F.lit(0)).withColumn("broken", F.lit(0)), labels).collect()
    assert len(again) == len(got) + len(ROWS) and all(r.kept == got[r.doc_id].kept for r in again)
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).filter("kept and base_failed or size(broken) > 0").count() == 0


def test_rules_judge_doubled_neighbours(spark):
    doubled = lambda t: " ".join(f"{w} {w}" for w in t.split())
    bad = [(k, doubled(prose(20)), "de") for k in range(40)]
    good = [(2000 + k, prose(40), "de") for k in range(1200)]
    docs = spark.createDataFrame(bad + good, "doc_id long, text string, lang string")
    share = {r.doc_id: r.same_neighbour_share for r in quality_rules.features(C.intake(docs, doc_id="doc_id", text="text", stratum="lang")).collect()}
    for k, t, _ in bad + good:
        w = t.split()
        assert share[k] == sum(a == b for a, b in zip(w, w[1:])) / len(w)
    labels = spark.createDataFrame([(k, int(k >= 2000)) for k, *_ in bad + good], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert all("same_neighbour_share" in got[k].broken and not got[k].kept and not got[k].base_failed for k, *_ in bad)
    assert sum(got[k].kept for k, *_ in good) >= 0.99 * len(good)


def test_interleaving(spark, docs):
    many = spark.createDataFrame([(k, "x" * (k % 7), None, "hot" if k % 3 == 0 else "s%d" % (k % 5), 0) for k in range(1003)], SCHEMA)
    rows = sharding.interleave(many, shards=8, rows_per_cell=10).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert len(rows) == 1003 and max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for source in {r.source for r in rows}:
        per = [sum(r.shard == s and r.source == source for r in rows) for s in range(8)]
        assert max(per) - min(per) <= 2
    assert all(r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 7)) and r.size == r.doc_id % 7 + 16 for r in rows)
    assert sharding.interleave(docs).count() == len(ROWS)


def test_url_rules(spark):
    urls = [(1, "http://a.example.org/es/1?q"), (2, "http://EXAMPLE.org/en/12"), (3, "x"), (4, None), (5, "https://spam-x.net/a.html#t"), (6, "https://www.spam-x.net/a/"), (7, "https://spam-x.net/b"), (8, "http://com/de/"), (9, "http://xcom/de/"), (10, "a://b.com?/de/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS canon")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, spark.createDataFrame([("http://spam-x.net/a",), (None,)], "url string")).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5][3] == got[6][3] == "block" and got[7][3] == "allow" and got[8][2:] == ("com/de/", "block") and got[9][2] is None and got[10] == ("b.com", "", None, "allow")


def test_bloom_has_no_false_negatives():
    import numpy as np

    h = np.random.default_rng(0).integers(-(2**62), 2**62, 5000)
    words = np.zeros((118, 8), np.uint64)
    block, masks = url_filter.BlockedBloom.places(h, 118)
    for k in range(8):
        np.bitwise_or.at(words[:, k], block, masks[:, k])
    bloom = url_filter.BlockedBloom(words)
    assert bloom.may_hold(h).all() and bloom.may_hold(np.random.default_rng(1).integers(-(2**62), 2**62, 5000)).mean() < 0.1


def test_token_counts_are_the_library_s(spark, docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    alphabet = [" ", "  ", "\n", "▁", "a", "the", "é", "<s>", "\t", "日", "😀", "\r\n", "<0x0A>", "\x00"]
    odd = [(100 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))), None, None, 0) for k in range(400)]
    for head in (250_000, 3):
        rows = token_counts.token_counts(docs.union(spark.createDataFrame(odd, SCHEMA)), path, head_keys=head).collect()
        text = {d[0]: d[1] or "" for d in ROWS + odd}
        assert len(rows) == len(text)
        for r in rows:
            assert (r.n_bytes, r.n_tokens) == (len(text[r.doc_id].encode()), len(sp.encode(text[r.doc_id]))), repr(text[r.doc_id])


def test_token_head_is_above_a_cutoff(spark):
    rows = [("k%d" % k, 1 + k % 50, 2) for k in range(500)]
    pieces = spark.createDataFrame(rows, "key string, freq long, pieces long")
    for most in (0, 1, 20, 333, 500, 10_000):
        got = {r.key for r in token_counts.head(pieces, most).collect()}
        assert len(got) <= most and (most < 500 or len(got) == 500)
        kept, left = [f for k, f, _ in rows if k in got], [f for k, f, _ in rows if k not in got]
        assert not kept or not left or min(kept) > max(left)


@pytest.mark.parametrize("most_bytes", [64 << 20, 64])
def test_listed_at_any_filter_size(spark, most_bytes):
    urls = spark.createDataFrame([(k, "h%d/p" % (k % 700)) for k in range(1500)] + [(9999, None)], "n int, canon string")
    entries = spark.createDataFrame([("h%d/p" % (3 * k),) for k in range(2000)] + [(None,)], "canon string")
    got = {r.n: r.is_listed for r in url_filter.listed(urls, entries, most_bytes).collect()}
    assert got == {**{k: k % 700 % 3 == 0 for k in range(1500)}, 9999: False}
    assert len(url_filter.BlockedBloom.build(spark.range(1000).select(F.xxhash64("id").alias("h")), 1000, most_bytes=128).words) == 2


def test_urls_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (2, "http://a.net/" + "y" * 100_000)], "page_id long, url string").withColumn("is_listed", F.lit("?"))
    listed = spark.createDataFrame([("http://a.net/x",), ("http://never.seen/",)], "url string")
    assert sorted((r.page_id, r.verdict) for r in url_filter.filter_urls(pages, listed).collect()) == [(1, "block"), (1, "block"), (2, "allow")]
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, listed.limit(0)).collect()} == {"allow"}


def interleaved(rows, shards, seed="tidegauge"):
    """The same by sorting everything."""
    import hashlib as H

    md5 = lambda *p: H.md5(":".join([seed, *["" if x is None else str(x) for x in p]]).encode()).hexdigest()
    out, by = [], {}
    for k, t, source in rows:
        crc = zlib.crc32((t or "").encode())
        by.setdefault(source, []).append((md5(k, crc, None), k, crc))
    for source, own in by.items():
        u = (int(md5("start", source)[:8], 16) + 0.5) / 2**32
        out += [((r + u) / len(own), (source is not None, source or ""), r, k, crc) for r, (_, k, crc) in enumerate(sorted(own, key=lambda x: x[0]))]
    n, found = len(out), {}
    for g, (*_, k, crc) in enumerate(sorted(out)):
        shard = g * shards // n
        found[k, crc] = (shard, g - -(-shard * n // shards))
    return found


def test_interleaving_is_one_sort(spark):
    rows = [(k if k % 9 else None, "t%d" % k, None if k % 11 == 0 else "hot" if k % 3 == 0 else "s%d" % (k % 200)) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit(1)).withColumn("size", F.lit("x"))
    got = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in sharding.interleave(docs, shards=7, rows_per_cell=20).collect()}
    assert got == interleaved(rows, 7)


def test_interleaving_in_sql(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_words INTEGER)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r) for r in ROWS])
    found = con.sql(sharding.oracle(shards=7))
    rows = sharding.interleave(docs, shards=7, rows_per_cell=5).select(*found.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(found.fetchall())


def test_no_cell_is_hot(spark, monkeypatch):
    """One-row sources, null ids and rows that repeat id and text don't meet in one task."""
    rows = [(k, "x", "s%d" % k) for k in range(3000)] + [(None, "t%d" % k, "a") for k in range(3000)] + [(7, "same", "b")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cells, real = [], sharding._ranked

    def seen(df, within, cell, order, name):
        cells.append(max(r["count"] for r in df.groupBy(*within, cell.alias("cell")).count().collect()))
        return real(df, within, cell, order, name)

    monkeypatch.setattr(sharding, "_ranked", seen)
    out = sharding.interleave(docs, shards=10, rows_per_cell=100).collect()
    assert len(out) == 9000 and len(cells) == 2 and max(cells) < 400
    singles = [sum(r.shard == s and str(r.source).startswith("s") for r in out) for s in range(10)]
    assert max(singles) < 2 * min(singles)


def test_jaccard_join_of_repeated_ids(spark):
    """Two different texts under one id, and a near copy of one of them: the link is found whichever row comes first."""
    rows = []
    for k in range(30):
        a, b = prose(60), prose(60)
        near = " ".join([*a.split()[:-1], "other"])
        rows += [(k, b), (k, a), (1000 + k, near)] if k % 2 else [(k, a), (k, b), (1000 + k, near)]
        rows += [(2000 + k, a)] * (k % 3) + [(k, a)] * (k % 4 == 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("x")).withColumn("h", F.lit(0))
    got = jaccard_join.jaccard_join(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id >= 1000}
    assert [by[1000 + k].class_id for k in range(30)] == list(range(30))
    assert [by[1000 + k].n_links for k in range(30)] == [1 + k % 3 + (k % 4 == 1) for k in range(30)]
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(kept) == sorted({(k, t) for k, t in rows if k < 1000})


def test_jaccard_join_of_odd_tables(spark):
    far = " ".join("v%d" % k for k in range(50_000))
    docs = spark.createDataFrame([(1, far), (2, far + " end"), (None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = jaccard_join.jaccard_join(docs, jaccard_join.ChosenPaths(block_shingles=1000)).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.n_links) for r in got) == [(0, 3, 2), (0, 3, 2), (1, 1, 1), (2, 1, 1), (3, 3, 2)]
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0

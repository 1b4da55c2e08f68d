"""Benchmark decontamination by a prefix-filtered set join, with built-in expressions only.

Every item is cut into windows of `window` consecutive words; a document word is a shingle of one word. A window occurs
in a document only if all its shingles do, so its necessary prefix is a single one: the rarest over the whole corpus.
Only document words that equal a prefix word are joined; the position of the prefix word in its window fixes where the
window must begin and end (length and positional bounds), and the candidate stretch is then compared word for word.

Texts are cut twice in all: once to count the benchmark's words, once to look prefix words up, which also counts each
document's words. Where the prefix is too large to broadcast, (word, row, position) alone is dealt out, and the words of
the rows with candidates are fetched afterwards, so no word array goes through a shuffle.

Defined results: null and wordless texts have no words and are clean; null and wordless items have no window;
items that share a window all count; rows that repeat a document are each judged; very long texts are taken whole, a
text's words in one row; an empty table gives no rows; columns other than the named ones are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """Words in their own case; a word's boundaries don't depend on case. Splitting at what lies between words takes an
    eighth of the time of extracting them."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), C.NO_WORD, -1), "")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(win, item_id, len, words): the windows of every item, lower-cased in A-Z; items of fewer words are one window."""
    words = items.select("item_id", raw_words(F.translate("text", UPPER, LOWER)).alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("len", F.least(F.size("words"), F.lit(window)))
    cut = words.select("item_id", "len", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"))
    return cut.select("item_id", "len", F.slice("words", F.col("at"), F.col("len")).alias("words")).withColumn("win", F.array_join("words", " "))


def _code(word: Column) -> Column:
    """What words are counted and joined by: 64-bit hashes, folded for all letters. Both only admit more candidates; the
    exact case rule and the words themselves come last."""
    return F.xxhash64(F.lower(word))


def _small(df: DataFrame, most_bytes: int, text: Column | None = None) -> bool:
    """Whether a table of a few numbers and one column of text may be broadcast: its bytes are summed first."""
    each = F.lit(64) if text is None else F.octet_length(text) + 64
    return (df.agg(F.sum(each)).first()[0] or 0) <= most_bytes


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """((row, n_words, start, len, win): one row without `win` for each document, and one for each occurrence of a window;
    (win, item_id)). `docs` has row and text."""
    windows = C.materialize(item_windows(items, window), "windows")
    owners = windows.select("win", "item_id").distinct()
    terms = windows.select("win", "len", F.posexplode("words").alias("off", "word")).distinct().withColumn("code", _code(F.col("word"))).drop("word")
    vocabulary = C.materialize(terms.select("code").distinct(), "vocabulary")
    seen = docs.select(F.explode_outer(raw_words(F.col("text"))).alias("w")).select(_code(F.col("w")).alias("code"))
    if _small(vocabulary, broadcast_bytes):
        seen = seen.join(F.broadcast(vocabulary), "code", "left_semi").groupBy("code").agg(F.count(F.lit(1)).alias("freq"))
    else:
        seen = seen.groupBy("code").agg(F.count(F.lit(1)).alias("freq")).join(vocabulary, "code", "left_semi")
    ranked = terms.join(C.materialize(seen, "rarity"), "code", "left")
    # A window with a word that the corpus never uses cannot occur.
    prefix = ranked.groupBy("win", "len").agg(F.min(F.struct(F.coalesce("freq", F.lit(0).cast("long")).alias("freq"), "code", "off")).alias("p"))
    prefix = C.materialize(prefix.filter("p.freq > 0").select(F.col("p.code").alias("key"), F.col("p.off").alias("off"), "win", "len"), "prefix")
    words = docs.select("row", raw_words(F.col("text")).alias("words"))
    # Place 0 of each document is its own row; no candidate begins there.
    placed = words.select("row", "words", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(F.concat(F.array(F.lit("")), "words")).alias("pos", "w"))
    start = F.col("pos") - F.col("off")
    inside = (start >= 1) & (start + F.col("len") - 1 <= F.col("n_words"))
    same = F.translate(F.array_join(F.slice("words", start, F.col("len")), " "), UPPER, LOWER) == F.col("win")
    columns = ["row", "n_words", F.when(F.col("pos") > 0, start).alias("start"), "len", "win"]
    if _small(prefix, broadcast_bytes, F.col("win")):
        met = placed.join(F.broadcast(prefix), _code(F.col("w")) == F.col("key"), "left")
        return met.filter((F.col("pos") == 0) | F.coalesce(inside & same, F.lit(False))).select(*columns), owners
    heads = words.select("row", F.size("words").cast("long").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("string").alias("win"))
    met = placed.filter("pos > 0").select("row", "n_words", "pos", _code(F.col("w")).alias("code")).join(prefix, F.col("code") == F.col("key")).filter(inside)
    met = C.materialize(met.select(*columns).distinct(), "candidates").select(F.col("row").alias("c_row"), "start", "len", "win")
    checked = words.dropDuplicates(["row"]).join(met, F.col("row").eqNullSafe(F.col("c_row")))
    same = F.translate(F.array_join(F.slice("words", F.col("start"), F.col("len")), " "), UPPER, LOWER) == F.col("win")
    return heads.union(checked.filter(same).select("row", F.size("words").cast("long").alias("n_words"), "start", "len", "win")), owners


def _named(docs: DataFrame) -> DataFrame:
    """Equal ids with equal texts give equal rows, so the id and the text's hash name the row."""
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("text")).alias("row"), "text")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256,
    contaminated, spans (merged [start, end] word positions, from 1, of what was hit)."""
    items = C.intake(items, item_id=item_id, text=item_text)
    all_found, owners = occurrences(_named(C.intake(docs, doc_id=doc_id, text=text)), items, window, broadcast_bytes)
    all_found = C.materialize(all_found, "found")
    sized, found = all_found.filter("win is null").select("row", "n_words"), all_found.filter("win is not null").select("row", "start", "len", "win").distinct()
    spans = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len") - 1).alias("end")))).alias("runs"))
    merged = F.expr("""aggregate(slice(runs, 2, size(runs)), array(runs[0]), (done, x) ->
        if(x.start <= done[size(done) - 1].end + 1,
           concat(slice(done, 1, size(done) - 1), array(named_struct('start', done[size(done) - 1].start, 'end', greatest(x.end, done[size(done) - 1].end)))),
           concat(done, array(x))))""")
    spans = spans.select("row", merged.alias("spans"))
    hits = found.join(owners, "win").groupBy("row").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    result = spans.join(hits, "row", "left").select(F.col("row").alias("hit_row"), "spans", "ids")
    full = sized.join(result, F.col("row").eqNullSafe(F.col("hit_row")), "left")
    n_hit = F.coalesce(F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start + 1)"), F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return full.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents that no benchmark window occurs in, with all their columns."""
    found, _ = occurrences(_named(docs), C.intake(items, item_id="item_id", text="text"), window)
    hit = C.materialize(found.filter("win is not null").select("row").distinct().select(F.col("row.doc_id").alias("hit_id"), F.col("row.text").alias("hit_text")), "hit")
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_text")), "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks)),
hit AS (SELECT dw.doc_id, dw.p, dw.k, win.item_id FROM dw JOIN win ON dw.s = win.s AND dw.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

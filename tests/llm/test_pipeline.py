import random
import re

import pytest

import corpus_pipeline
from tidegauge.llm import common as C

rng = random.Random(8)
WORDS = ["%s%s" % (a, b) for a in ("ba", "co", "du", "fe", "gi", "ho", "ju", "ka") for b in ("la", "mi", "no", "pu", "ra", "si")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def junk():
    return " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(30).split())


CLEAN = [prose() for _ in range(300)]
TOXIC = [" ".join(["idiot" if k % 11 == 3 else w for k, w in enumerate(prose().split())]) for _ in range(120)]
JUNK = [junk() for _ in range(120)]
ITEM = prose(25)
LEAK = [prose(20) + " " + ITEM + " " + prose(20) for _ in range(5)]
COPIES = [CLEAN[k] for k in range(20)] + [CLEAN[k][:-4] + "tail" for k in range(20, 30)]
TEXTS = [*CLEAN, *TOXIC, *JUNK, *LEAK, *COPIES, None, ""]
KIND = ["clean"] * 300 + ["toxic"] * 120 + ["junk"] * 120 + ["leak"] * 5 + ["copy"] * 30 + ["empty"] * 2


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(k, t, "en", "s%d" % (k % 3), len(t or "")) for k, t in enumerate(TEXTS)]
    # An id that two texts share: what happens to one doesn't happen to the other.
    rows += [(3, JUNK[0] + " " + JUNK[1], "en", "s", 1), (5, CLEAN[5], "en", "s", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(KIND[k] != "junk"), int(KIND[k] == "toxic")) for k in range(540)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = C.materialize(stage(spark, docs, folder), "t")
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, folder):
    good, single, clear, mixed, placed = stages(spark, folder)
    columns = [c.split()[0] for c in COLUMNS.split(", ")]
    assert all(df.columns == columns for df in (good, single, clear, mixed))
    rows = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())
    kept = rows(good)
    assert not {t for _, t in kept} & set(JUNK) and {t for _, t in kept} >= {*CLEAN, *TOXIC, *LEAK, *COPIES}
    assert (3, CLEAN[3]) in kept and not any("###" in t for k, t in kept if k == 3)

    words = lambda t: re.findall(C.FOLDED_WORD, t.lower())
    grams = lambda t: {tuple(words(t)[j : j + 5]) for j in range(max(1, len(words(t)) - 4))} if words(t) else set()
    sets = [grams(t) for _, t in kept]
    first = [next((j for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])), None) for i in range(len(kept))]
    want = [r for r, j in zip(kept, first) if j is None]
    assert rows(single) == want

    windows = {tuple(words(ITEM)[j : j + 10]) for j in range(16)}
    want = [(k, t) for k, t in want if not windows & {tuple(words(t)[j : j + 10]) for j in range(len(words(t)))}]
    assert rows(clear) == want

    final = rows(mixed)
    assert set(final) <= set(want) and {r for r in want if r[1] in CLEAN} <= set(final)
    assert sum(t in TOXIC for _, t in final) < 0.5 * len(TOXIC)
    assert sorted(r.doc_id for r in placed.collect()) == sorted(k for k, _ in final)


def test_run_is_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() == stages(spark, folder)[-1].count()


def test_stages_of_an_empty_table(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert [stage(spark, empty, folder).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5

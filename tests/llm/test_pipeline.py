"""Stages of the corpus pipeline on repeated and null ids, against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

from snpweave.llm.common import materialize

from .conftest import WORDS, shingles, smallest_reachable


def test_near_duplicates_with_repeated_and_null_ids(spark):
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))
    a, b, c, d, e = (prose(100) for _ in range(5))
    rows = [(5, a), (7, a), (7, b), (8, c), (8, c + " tail"), (None, c), (9, d), (None, d), (None, d), (None, e), (None, e), (None, e + " tail")]
    rows += [(12, prose(3)), (12, ""), (12, None), (13, ""), (None, ""), (14, prose(80)), (14, prose(80))] + [(15, prose(90))] * 3
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and x and 100 * len(x & y) >= 75 * len(x | y)]
    groups = {}
    for i, top in smallest_reachable(range(len(rows)), links).items():
        groups.setdefault(top if sets[i] else ("none", rows[i][0]), set()).add((rows[i][0], rows[i][1] or ""))
    rank = lambda x: (x[0] is None, x[0] or 0)

    kept = materialize(corpus_pipeline.near_duplicate_stage(spark, docs, ""), "kept")
    got = Counter((x.doc_id, x.text or "") for x in kept.collect())
    assert set(got.values()) == {1} and sum(got.values()) == len(groups)
    for members in groups.values():
        stays = [x for x in members if got[x]]
        assert len(stays) == 1 and rank(stays[0]) == min(map(rank, members)), members

    cut = Counter((x.doc_id, x.text or "") for x in corpus_pipeline.repeated_passage_stage(spark, kept, "").collect())
    assert cut == got  # no passage stands at two places any more


def test_stages_against_plain_python(spark):
    """Every stage on the smallest tables does what brute force says, on all that the one before it kept."""
    import re

    from snpweave.llm.quality import score_quality

    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    of = lambda df: {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, where), name)
        steps[name] = before, docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = steps["quality_classifier"]
    rejected = {r.doc_id for r in score_quality(before, spark.read.parquet(f"{where}/labels.parquet")).where("predicted = 0").collect()}
    texts, left = of(before), of(after)
    assert left == {i: t for i, t in texts.items() if i not in rejected}

    texts, left = left, of(steps["ngram_join"][1])
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = smallest_reachable(list(sets), links)
    assert left == {i: t for i, t in texts.items() if top[i] == i}

    texts, left = left, of(steps["suffix_dedup"][1])
    seen = Counter(t.encode()[k : k + 400] for t in texts.values() for k in range(len(t.encode()) - 399))
    for i, t in texts.items():
        raw, gone = t.encode(), set()
        for k in range(len(raw) - 399):
            if seen[raw[k : k + 400]] > 1:
                gone.update(range(k, k + 400))
        assert left[i] == bytes(b for k, b in enumerate(raw) if k not in gone).decode("utf-8", "ignore")

    texts, left = left, of(steps["secret_scan"][1])
    keys = [r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(?=[A-Za-z0-9+/_.=-]{6})[A-Za-z0-9+/_.=-]+""", r"AKIA[A-Z0-9]{16,}", r"(?<![0-9a-f])[0-9a-f]{24,}"]
    assert set(left) == set(texts)
    for i, t in texts.items():
        hit = any(re.search(k, t) for k in keys)
        assert not any(re.search(k, left[i]) for k in keys) and (("[SECRET]" in left[i]) or not hit) and (left[i] == t or "[SECRET]" in left[i])

    pieces = steps["packing"][1]
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(left)
    bad = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count()
    assert bad == 0 and pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_on_an_empty_table_and_extra_columns(spark):
    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    extra = docs.limit(20).withColumns({c: F.lit(7) for c in ("text_key", "n", "h", "component", "spans", "kind")})
    for table in (docs.limit(0), extra):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = materialize(stage(spark, now, where), name)
        assert (now.count() > 0) == (table is extra)

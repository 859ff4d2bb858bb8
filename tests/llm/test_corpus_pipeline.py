"""The pipeline's stages against plain Python, each on its own input."""

import random

import corpus_pipeline as P
from support import DATA
from test_corpus_operators import brute_join, docs, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark):
    rng = random.Random(20)
    passage = prose(rng, 70, 10**6)
    texts = [(i, prose(rng, 100, 10**5)) for i in range(30)]
    texts += [(30, texts[0][1]), (31, texts[1][1] + " more"), (32, f"{prose(rng, 40, 10**5)}\n{passage}"), (33, f"{passage}\n{prose(rng, 40, 10**5)}"), (34, None), (35, "")]
    return texts, docs(spark, texts, lang="en", source="s").selectExpr("*", "cast(length(text) as long) n_chars")


def test_stages_keep_columns_and_clean_documents(spark):
    texts, df = corpus(spark)
    out = P.line_dedup(spark, df, DATA)
    assert out.columns == COLUMNS and out.count() == len(texts)
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["text"] == t for i, t in texts if i not in (30, 33))
    assert got[30]["text"] == "" and got[30]["n_chars"] == 0 and got[33]["text"] == dict(texts)[33].split("\n")[1]


def test_near_duplicates_keep_one_of_each(spark):
    texts, df = corpus(spark)
    out = P.near_duplicates(spark, df, DATA)
    assert out.columns == COLUMNS and sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, c, _ in brute_join(texts).values()})


def test_decontamination_drops_leaks(spark):
    texts, df = corpus(spark)
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 100").first()["text"]
    leak = df.limit(1).selectExpr("cast(99 as long) doc_id", f"concat(text, ' ', '{item.replace(chr(39), '')}') text", "lang", "source", "n_chars")
    out = P.decontamination(spark, df.unionByName(leak), DATA)
    assert out.columns == COLUMNS and sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _ in texts)


def test_stages_on_odd_rows(spark):
    """Null keys, nulls in any column, empty, repeated and very long texts, clashing column names, and empty tables."""
    rng = random.Random(21)
    long = prose(rng, 30_000, 10**6)
    rows = [(i, prose(rng, 80, 10**6), "en", "s", 7) for i in range(8)]
    rows += [(None, "a text of its own without any key at all", None, None, None), (20, None, "en", None, 0), (21, "", None, "s", 0), (22, long, "en", "s", None), (23, rows[0][1], "en", "s", 7), (23, rows[0][1], "en", "s", 7)]
    extra = ["k", "t", "score", "toxicity", "leaks", "repeats", "class_id", "offset", "best"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'clash' as {c}" for c in extra])
    columns = COLUMNS + extra
    keys = lambda out: sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect())
    every = keys(df)
    for stage in (P.toxicity, P.line_dedup, P.near_duplicates, P.decontamination):
        out = stage(spark, df, DATA)
        assert out.columns == columns and out.filter("k <> 'clash' or score <> 'clash'").count() == 0
        # copies are the only rows that may go, and only where one of each group stays: 23 is 0, and 21 (empty) is 20 (null)
        assert keys(out) == ([k for k in every if k not in (21, 23)] if stage is P.near_duplicates else every), stage.__name__
        assert out.filter("doc_id = 22").first()["text"] == long and out.filter("doc_id = 20").first()["text"] is None
        assert out.filter("doc_id is null").first()["text"] == rows[8][1]
        assert stage(spark, df.limit(0), DATA).count() == 0
    packed = P.packing(spark, df, DATA).collect()
    pieces = lambda k: [r for r in packed if r["doc_id"] == k]
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows} and [r["length"] for r in pieces(20) + pieces(21)] == [1, 1]
    assert len(pieces(23)) == 2 * len(pieces(0)) and sorted(r["piece"] for r in pieces(22)) == list(range(len(pieces(22))))
    assert P.packing(spark, df.limit(0), DATA).count() == 0


def test_toxicity_stage_follows_the_scores(spark):
    from cohortlake.llm import toxicity

    df, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score(df, toxicity.fit(df, labels)).select("doc_id", "toxicity").collect()}
    assert {r["doc_id"] for r in P.toxicity(spark, df, DATA).collect()} == {k for k, s in scores.items() if s < 0.5}


def test_toxicity_stage_learns_from_all_labels(spark, tmp_path):
    """400,000 more labels, of keys that no document has, change nothing."""
    from cohortlake.llm import toxicity

    df, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.select("doc_id", "toxic")
    more = labels.unionByName(spark.range(10**9, 10**9 + 400_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic"))
    few, many = toxicity.fit(df, labels), toxicity.fit(df, more)
    assert (few.scores == many.scores).all()
    assert [few.rate, few.scale, few.slope, few.offset] == [many.rate, many.scale, many.slope, many.offset]
    more.write.parquet(f"{tmp_path}/labels.parquet")
    kept = lambda sf: sorted(r["doc_id"] for r in P.toxicity(spark, df, str(sf)).select("doc_id").collect())
    assert kept(tmp_path) == kept(DATA)


def test_line_dedup_stage_aligns_long_repetitions(spark):
    """All 2,000 lines of the later text stand in the earlier one in order: 3,000,000 pairs of equal lines."""
    df = docs(spark, [(0, "\n".join(["this", "this", "that"] * 1000)), (1, "\n".join(["this", "that"] * 1000))], lang="en", source="s").selectExpr("*", "cast(length(text) as long) n_chars")
    assert {r["doc_id"]: r["n_chars"] for r in P.line_dedup(spark, df, DATA).collect()} == {0: df.filter("doc_id = 0").first()["n_chars"], 1: 0}


def test_whole_run(spark):
    out = P.run(spark, DATA)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]

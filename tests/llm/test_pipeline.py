"""Each stage of the pipeline against a plain version, on the small tables."""

import corpus_pipeline as cp
from streetloom.llm import quality, secrets
from streetloom.llm.shared import written

from . import brute

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark):
    import public_tokenizers
    import tiktoken

    from streetloom.llm.bpe import load_ranks

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in cp.STAGES:
        steps[name] = (docs, written(stage(spark, docs, SMALL), "test"))
        docs = steps[name][1]
    assert all(out.columns == columns for _, out in list(steps.values())[:-1])

    before, after = steps["quality classifier"]
    net = quality.fit(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(before, net, keep=["doc_id"]).collect() if r["score"] >= cp.REJECTED}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if r[0] in good)

    before, after = steps["n-gram Jaccard join"]
    first = {i for i, _, c in brute.jaccard([(r["doc_id"], r["text"]) for r in before.collect()]) if i == c}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if r[0] in first)

    before, after = steps["secret scans"]
    clean = {r["doc_id"]: r for r in after.collect()}
    assert len(clean) == before.count()
    for r in before.collect():
        got = clean[r["doc_id"]]
        if not any(x[1] for x in [(0, secrets.scan(r["text"]))]):
            assert tuple(got) == tuple(r)
        assert not [m for m in brute.secrets(got["text"]) if m[1] != 0] and got["n_chars"] == len(got["text"])

    before, after = steps["mixing sources to target weights"]
    assert {tuple(r) for r in rows(after)} == set(rows(before)) and after.count() >= before.count()

    before, after = steps["byte-level BPE encoding"]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((r["doc_id"], library.encode_ordinary(r["text"])) for r in before.collect())
    assert sorted((r["doc_id"], r["ids"]) for r in after.collect()) == want


def test_what_the_classifier_predicts_as_junk_goes(spark, monkeypatch):
    import numpy as np

    docs = spark.createDataFrame([(1, "some text"), (2, "")], "doc_id long, text string")
    for score, kept in ((0.3, 0), (0.49, 0), (0.51, 2)):
        net = quality.Network.fresh([])
        net.base = float(np.log(score / (1 - score)))  # no weights, so it is every text's score
        monkeypatch.setattr(quality, "fit", lambda *_, net=net: net)
        assert cp.keep_quality(spark, docs, SMALL).count() == kept


def test_final_rows_keep_the_mix(spark, tmp_path, monkeypatch):
    import random

    from streetloom.llm import mixing

    rnd = random.Random(4)
    rows = []
    for n in range(240):  # lengths that leave part files of different sizes
        words = [f"{rnd.choice('abcdefgh')}{rnd.randrange(10 ** rnd.randint(1, 6))}" for _ in range(rnd.randint(20, 3000))]
        rows.append((n, " ".join(words), f"s{n % 4 if n % 3 else 0}", "en"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(cp, "STAGES", cp.STAGES[-2:])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).select("__slot", "__offset", "doc_id", "source").collect()
        got = [tuple(r) for r in cp.run(spark, str(tmp_path)).select("doc_id", "source", "position").collect()]
        names = written(cp.mix_sources(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), ""), "test").inputFiles()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(names) > 3
    want = [(r["doc_id"], r["source"], k) for k, r in enumerate(sorted(mixed, key=lambda r: (r["__slot"], r["__offset"])))]
    assert got == want

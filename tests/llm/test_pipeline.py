"""The pipeline end to end on a small corpus with planted cases."""

import random

import corpus_pipeline


def test_planted_cases(spark, tmp_path):
    r = random.Random(9)
    text = lambda n: "\n".join(" ".join(f"w{r.randrange(5000)}" for _ in range(25)) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        body = text(3)
        if bad:
            body += "\n" + " ".join(f"v{r.randrange(900)} blockhead" for _ in range(4))
        rows.append((i, body, "en", "s", len(body)))
        labels.append((i, 1, int(bad)))
    exact = (500, rows[1][1], "en", "s", 5)
    words = text(1).split()
    near_a = (600, " ".join(words * 1), "en", "s", 5)
    near_b = (601, "\n".join([" ".join(words[:12]), " ".join(words[12:])]), "en", "s", 5)
    docs = spark.createDataFrame([*rows, exact, near_a, near_b, (700, None, None, None, None), (701, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
    kept = {x["doc_id"] for x in step.collect()}
    assert not kept & {i for i, _, bad in labels if bad} and 500 not in kept
    assert {i for i, _, bad in labels if not bad} <= kept and {700, 701} <= kept
    assert len(kept & {600, 601}) == 1
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in packed.collect()} == kept
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, str(tmp_path))
    assert empty.count() == 0

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long"
TONGUES = {"aa": ["ka", "ri", "to", "men"], "bb": ["sch", "un", "eit", "ver"]}


def tables(spark, folder):
    rng = random.Random(12)
    speak = lambda lang, n: " ".join("".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    docs = [[i, speak("ab"[i % 2] * 2, rng.randint(80, 160)), "ab"[i % 2] * 2, "src0" if i % 3 else "src1"] for i in range(60)]
    item = speak("aa", 30)
    shared = "this line of text stands in many of the documents"
    for i in range(10, 20):
        docs[i][1] = shared + "\n" + docs[i][1]
    docs.append([100, docs[3][1], "bb", "src0"])  # an exact copy
    words = docs[4][1].split()
    docs.append([101, " ".join([*words[:-1], "changed"]), "aa", "src0"])  # a near copy, perhaps
    docs.append([102, docs[5][1] + " " + item, "bb", "src0"])  # holds a benchmark item
    docs += [[103, None, "aa", "src0"], [104, "12345 !!", "aa", "src0"], [105, "", None, "src0"]]
    rows = [(*d, len(d[1] or ""), 7) for d in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r for r in rows}, shared


def test_pipeline_end_to_end(spark, tmp_path):
    rows, shared = tables(spark, str(tmp_path))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {103, 104, 105, 102, 100} & set(out) == set()  # no language, a leak, a copy
    assert set(range(60)) <= set(out)  # clean documents stay
    assert [i for i in range(10, 20) if shared in out[i].text] == [19]
    for i in range(10):
        assert out[i].text == rows[i][1] and out[i].lang == rows[i][2] and out[i].fp == 7
    assert all(r.n_chars == len(r.text) and r.mix_rate >= 0 for r in out.values())


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns + ["mix_rate"] * (n == 4)


def test_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path / "full"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

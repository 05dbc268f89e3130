from corpora import prose

import corpus_pipeline as pipeline


def test_stages_in_order_with_effect(spark, tmp_path):
    rows = [(k, prose(1000 + k, 150), "en", "s", 1) for k in range(40)]
    item = prose(5000, 25)
    rows += [(100, rows[3][1], "en", "s", 1), (101, rows[4][1].replace(rows[4][1].split()[50], "edited", 1), "en", "s", 1)]
    rows += [(102, prose(1102, 80) + " " + item + " " + prose(1103, 80), "en", "s", 1), (103, "too short", "en", "s", 1)]
    rows += [(104, " ".join(w + "%%%" for w in prose(1104, 150).split()), "en", "s", 1), (105, None, None, None, None)]
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_templates", "near_duplicates", "decontamination", "best_fit_packing"]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == pipeline.COLUMNS
        kept.append({r["doc_id"] for r in docs.collect()})
    clean = set(range(40))
    assert kept[0] == clean | {100, 101, 102} and kept[1] == kept[0]
    assert kept[2] == clean | {102} and kept[3] == clean
    assert {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()} == clean


def test_null_and_repeated_ids_keep_their_texts(spark, tmp_path):
    rows = [(k, prose(1000 + k, 150), "en", "s", 1) for k in range(40)]
    rows += [(None, prose(1200, 150), "en", "s", 1), (None, prose(1201, 150), "en", "s", 1), (None, "too short", "en", "s", 1)]
    rows += [(7, prose(1202, 150), "en", "s", 1), (8, "too short", "en", "s", 1), (None, rows[5][1], "en", "s", 1)]
    rows = [(i, text.replace("\n", " "), *rest) for i, text, *rest in rows]  # no line recurs
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, prose(5000, 25))], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    expected = [r[:2] for r in rows if r[1] != "too short"][:-1]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=key) == sorted(expected, key=key)


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0

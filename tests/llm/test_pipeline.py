"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import corpus_pipeline
from crossweave.llm import langid, mixing, ngram_join, packing


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    named = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).cache()
    assert named.columns == columns
    und = langid.identify(docs).where("lang_pred = 'und'").count()
    assert named.count() == before - und
    single = corpus_pipeline.STAGES[1][1](spark, named, sf_dir).cache()
    assert single.columns == columns
    roots = {r["component_id"] for r in ngram_join.join(named).collect()}
    assert sorted(r["doc_id"] for r in single.select("doc_id").collect()) == sorted(roots)
    mixed = corpus_pipeline.STAGES[2][1](spark, single, sf_dir)
    assert mixed.columns == columns
    assert mixed.count() == sum(r["copies"] for r in mixing.mix(single).collect())
    packed = corpus_pipeline.STAGES[3][1](spark, mixed, sf_dir)
    whole = packing.pack(single).groupBy("doc_id").sum("length").collect()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(single).collect()}
    got = {r[0]: r[1] for r in packed.groupBy("doc_id").sum("length").collect()}
    assert got == {r[0]: r[1] * copies[r[0]] for r in whole if copies[r[0]]}


def test_run_is_the_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = ["doc_id", "start", "length", "ids_crc32"]
    got = sorted(tuple(r[k] for k in key) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted(tuple(r[k] for k in key) for r in docs.collect())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SAME = "this is the one text of which there are several copies in the table"
AWKWARD = [
    (1, SAME, "en", "a", 1), (2, SAME, "en", "a", 1), (2, "der zweite text mit dieser nummer ist ein anderer", "de", None, 1), (3, None, "en", "a", None), (4, "", None, None, 0),
    (5, "123 456", "en", "b", 7), (6, "le mot " * 40_000, "fr", "b", 1), (None, SAME, "en", "a", 1), (7, "that", None, "c", 4), (2, SAME, "en", "a", 1),
]


def folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Null and empty texts go in the first stage; of the copies the smallest id stays, other texts of its id too, rows without an id too."""
    path = folder(spark, tmp_path, AWKWARD)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    named = corpus_pipeline.STAGES[0][1](spark, docs, path)
    key = lambda df: sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in df.collect()), key=str)
    assert key(named) == sorted([(1, SAME[:9]), (2, SAME[:9]), (2, SAME[:9]), (2, "der zweit"), (6, "le mot le"), (7, "that"), (None, SAME[:9])], key=str)
    single = corpus_pipeline.STAGES[1][1](spark, named, path)
    assert key(single) == sorted([(1, SAME[:9]), (2, "der zweit"), (6, "le mot le"), (7, "that"), (None, SAME[:9])], key=str)
    mixed = corpus_pipeline.STAGES[2][1](spark, single, path)
    n = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(single).collect()}
    assert mixed.columns == docs.columns and mixed.count() == sum(n.values())
    packed = corpus_pipeline.STAGES[3][1](spark, mixed, path).collect()
    assert sum(r["start"] == 0 for r in packed) == sum(n.values())
    again = sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, path).collect()), key=str)
    assert again == sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed), key=str)


def test_run_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).count() == 0

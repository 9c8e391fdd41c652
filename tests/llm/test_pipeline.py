import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import helpers  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from lodestack.llm import decontaminate, pii, simhash  # noqa: E402


@pytest.fixture
def corpus(spark, tmp_path):
    rows = [(i, helpers.prose(i, 80), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, " ".join(w + "***" for w in helpers.prose(i, 80).split()), "en", "s", 1) for i in range(60)]
    rows += [(200, rows[0][1], "en", "s", 1), (201, rows[1][1] + " mail a.b@c.example now", "en", "s", 1), (202, helpers.prose(900, 40), "de", None, None), (203, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows[:120]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, helpers.prose(900, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, str(tmp_path)


def test_stages_keep_columns_and_take_effect(spark, corpus):
    docs, sf = corpus
    columns = docs.columns
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and set(range(60)) <= ids and not ids & set(range(100, 160))
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and 0 in ids and 200 not in ids
    kept = corpus_pipeline.decontamination_stage(spark, docs, sf)
    match = decontaminate.Matcher([(1, helpers.prose(900, 40))])
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if not match(r.text or "")}
    kept = corpus_pipeline.pii_stage(spark, docs, sf)
    assert kept.columns == columns and kept.count() == docs.count()
    assert all(not pii.detect(r.text or "") and (r.text is None or r.n_chars == len(r.text)) for r in kept.collect())


def test_edge_cases_of_every_stage(spark, corpus):
    _, sf = corpus
    long = helpers.prose(7, 30_000)
    rows = [(1, None), (2, ""), (3, " \n"), (4, helpers.prose(1, 60)), (4, helpers.prose(1, 60)), (4, helpers.prose(50, 60)), (5, helpers.prose(1, 60)), (6, long), (None, helpers.prose(1, 60)), (None, None), (8, "ß 字 \x00")]
    docs = spark.createDataFrame([(*r, None, "s", 3, 0.5, 7, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, component_id int, kind string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).collect()
        ids = sorted((r.doc_id for r in out), key=str)
        if name == "near_duplicates":
            texts = {(r.doc_id, r.text) for r in out}
            assert len(out) == len(texts) == 7 and {(4, helpers.prose(1, 60)), (4, helpers.prose(50, 60)), (None, None), (1, None), (6, long)} <= texts and 5 not in ids and 2 not in ids
        elif name == "pii":
            assert ids == sorted((r[0] for r in rows), key=str) and {r.text for r in out} == {r[1] for r in rows}
        elif name == "packing":
            assert sum(r.length for r in out if r.doc_id == 6) == next(r.doc_tokens for r in out if r.doc_id == 6)
        elif name == "decontamination":
            assert len(out) == len(rows)


def test_run_is_the_stages_in_turn(spark, corpus):
    docs, sf = corpus
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    df = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame(stage(spark, df, sf).collect(), docs.schema)
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in df.collect()}
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
    assert b"".join(r.ids for r in out) and all(len(r.ids) == 4 * r.length for r in out)


def test_empty_documents(spark, corpus):
    docs, sf = corpus
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_everything_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_near_duplicates_come_from_the_fingerprint_index(spark, monkeypatch):
    def nothing_in_common(least):
        return np.random.default_rng().integers(-(1 << 62), 1 << 62, size=simhash.BANDS)

    whole = helpers.prose(1, 900)
    filler = "spam " * 300
    rows = [(1, whole), (2, whole + " and one"), (3, whole), (4, helpers.prose(2, 900)), (5, filler + helpers.prose(3, 60)), (6, filler + helpers.prose(4, 60)), (None, whole)]
    fps = {i: simhash.fingerprint(t) for i, t in rows}
    assert (fps[1] ^ fps[2]).bit_count() <= 3 and fps[5] == fps[6]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(simhash, "band_keys", nothing_in_common)
    kept = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == [1, 4, 5, 6, None]  # 5 and 6 have one fingerprint, but not similar shingles

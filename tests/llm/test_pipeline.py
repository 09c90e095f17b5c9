"""The pipeline's stages on a small corpus of its own, each judged on what it was given."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkgraph.llm import packing

from .test_corpus_operators import plain_components, plain_contamination

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng, n=9):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(i, sentence(rng, 25)) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        text = "\n".join(sentence(rng) for _ in range(6))
        kind = i % 10
        if kind == 0:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        elif kind == 1:
            text += " you horrible vermin " + sentence(rng, 4)
        elif kind == 2:
            text = f"{sentence(rng)}\n{items[i % 5][1]}\n{sentence(rng)}"
        elif kind == 3:
            text += f"\nAll rights of this page reserved 20{i:02d}"
        elif kind == 4 and i > 10:
            text = docs[i - 5][1] if i % 20 == 4 else " ".join([*docs[i - 5][1].split()[:-1], "changed"])
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        if i < 200:
            labels.append((i, int(kind != 0), int(kind == 1)))
    docs += [(1000, None, "en", None, None), (1001, "", None, "s", 0), (None, sentence(rng, 40), "en", "s", 5)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, after = pairs(docs), stage(spark, docs, folder)
        if name != "packing":
            assert after.columns == docs.columns
            after.write.parquet(f"{tmp_path}/{i}")
            after = spark.read.parquet(f"{tmp_path}/{i}")
        given[name] = (before, after)
        docs = after
    before, after = given["quality"]
    kept = {r.doc_id for r in after.collect()}
    clean = {i for i, _ in before if i is not None and i < 300 and i % 10 > 1}
    assert len(clean - kept) <= 0.05 * len(clean)
    assert len({i for i, _ in before if i is not None and i < 300 and i % 10 < 2} & kept) <= 6
    before, after = given["line dedup"]
    assert sum("rights of this page" in (t or "") for _, t in pairs(after)) == 1
    assert {i for i, _ in pairs(after)} == {i for i, _ in before}
    before, after = given["near-duplicates"]
    want = sorted(str(r[0]) for r in plain_components(before, 5, 80) if r[3])
    assert sorted(str(i) for i, _ in pairs(after)) == want
    before, after = given["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = sorted(str(r[0]) for r in plain_contamination(before, items) if not r[5])
    assert sorted(str(i) for i, _ in pairs(after)) == want and len(want) < len(before)
    before, after = given["packing"]
    import public_tokenizers

    encode = packing.load_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert after.agg(F.sum("length")).first()[0] == sum(len(encode([t or ""])[0]) + 1 for _, t in before)


def test_stages_take_no_rows(spark, folder):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_stages_leave_columns_of_the_corpus_alone(spark, folder):
    """Whatever a stage adds for itself has no clash with a column of that name."""
    own = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("p_top", "expected_grade", "n_lines", "n_dropped", "n_words", "hit_items", "kept", "component_id", "gone", "row")}
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns(own)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.count() > 100, name
        for c, value in own.items():
            assert docs.where(~F.col(c).eqNullSafe(value)).isEmpty(), (name, c)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() > 150

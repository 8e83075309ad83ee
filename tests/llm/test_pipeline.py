import corpus_pipeline
import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, entities string, k1 long"
BODY = " ".join(f"plain{i}" for i in range(90))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    long = " ".join(f"shared{i}" for i in range(80))
    tail = " ".join(f"own{i}" for i in range(40))
    rows = [(i, f"gentle note number{i} about garden{i * 7} and river{i * 3} walks" + " calm" * (i % 5), "en", "a", 1, f"e{i}", i) for i in range(1, 60)]
    rows += [(i, f"vile{i % 5} scum{i % 3} hateful rotten person number{i} vile{i % 5} scum{i % 3}", "en", "a", 1, None, i) for i in range(100, 140)]
    rows += [(200, BODY, "en", "b", 1, "x", 0), (201, BODY + " extra", None, "b", 1, "y", 0), (202, f"alpha start {long} omega end", "en", "b", 1, "z", 0), (203, f"other begin {long} {tail} close and more", "en", "b", 1, "z", 0)]
    rows += [(300, None, None, None, None, None, None), (301, "", "en", "b", 0, "", 1), (302, "mail ann.lee@example.org soon", "en", "b", 29, "keep", 2), (302, "mail ann.lee@example.org soon", "en", "b", 29, "keep", 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 0) for i in range(1, 60)] + [(i, 1) for i in range(100, 140)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def stages(spark, at):
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        yield name, docs


def test_every_stage(spark, folder):
    seen = {}
    for name, docs in stages(spark, folder):
        seen[name] = docs
        if name != "packing":
            assert sorted(docs.columns) == sorted(SCHEMA.split()[0::2]), name
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["toxicity"] == set(range(1, 60)) | {200, 201, 202, 203, 300, 301, 302}
    assert ids["near_duplicates"] == ids["toxicity"] - {201}
    assert seen["near_duplicates"].where("doc_id = 302").count() == 1
    texts = {r.doc_id: r for r in seen["repeated_passages"].collect()}
    assert "shared40" not in texts[202].text + texts[203].text
    assert texts[202].text.startswith("alpha start") and texts[203].text.endswith("close and more")
    assert texts[202].n_chars == len(texts[202].text) and texts[202].entities == "z" and texts[200].text == BODY
    last = {r.doc_id: r for r in seen["personal_data"].collect()}
    assert "ann.lee" not in last[302].text and last[302].text.startswith("mail ") and last[302].k1 == 2 and last[302].entities == "keep"
    assert last[300].text == "" and last[301].text == ""
    pieces = seen["packing"].groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == ids["near_duplicates"]
    assert min(r[1] for r in pieces) == 1


def test_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    for name, docs in stages(spark, at):
        assert docs.count() == 0, name


def test_run_applies_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == 59 + 6
    assert isinstance(corpus_pipeline.run(spark, folder).first(), Row)


def test_near_duplicates_from_a_similarity_of_four_fifths(spark, tmp_path):
    words = [f"w{i}" for i in range(204)]
    edited = [f"n{i}" if i in (20, 60, 100, 140) else w for i, w in enumerate(words)]  # 180 of 220 shingles: 0.818
    far = [f"n{i}" if i in (15, 45, 75, 105, 135, 165) else w for i, w in enumerate(words)]  # 170 of 230 with the first: 0.739
    docs = spark.createDataFrame([(1, " ".join(words), "e"), (2, " ".join(edited), "e"), (3, " ".join(far), "e")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()} == {1, 3}


def test_shared_passages_of_51_short_words_go(spark, tmp_path):
    passage, fifty = " ".join(f"s{i}" for i in range(51)), " ".join(f"t{i}" for i in range(50))
    rows = [(i, f"start{i} {passage} between{i} {fifty} end{i} .", "e") for i in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, docs, str(tmp_path)).collect()}
    assert texts == {i: f"start{i} between{i} {fifty} end{i} ." for i in (1, 2)}

"""Each stage of the corpus pipeline on planted cases, and the whole."""

import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

STAGES = dict(corpus_pipeline.STAGES)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    item = prose(rng, 40)
    passage = prose(rng, 60)
    texts = [prose(rng, 120) for _ in range(120)]
    for i in range(0, 120, 5):
        words = texts[i].split()
        for _ in range(5):
            words[rng.randrange(len(words))] = rng.choice(["vileword", "nastyfolk"])
        texts[i] = " ".join(words)
    texts[11] = texts[1]
    texts[12] = texts[2].replace(" ", "  ")
    texts[21], texts[22] = f"{prose(rng, 40)} {passage} {prose(rng, 40)}", f"{prose(rng, 50)} {passage} {prose(rng, 30)}"
    texts[31] = f"{prose(rng, 30)} {item} {prose(rng, 30)}"
    texts += [None, ""]
    at = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    everything = ids(docs)
    clean = STAGES["toxicity"](spark, docs, folder)
    assert clean.schema == docs.schema and everything - ids(clean) == set(range(0, 120, 5))
    one = STAGES["near_duplicates"](spark, docs, folder)
    assert set(one.columns) == set(docs.columns) and everything - ids(one) == {11, 12, 121}
    cut = STAGES["repeated_passages"](spark, docs, folder)
    assert ids(cut) == everything and {r["doc_id"]: len((r["text"] or "").split()) for r in cut.collect()}[22] == 80
    assert everything - ids(STAGES["decontamination"](spark, docs, folder)) == {31}


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    gone = {*range(0, 120, 5), 11, 12, 121, 31}
    assert {r["doc_id"] for r in rows} == set(range(122)) - gone
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)

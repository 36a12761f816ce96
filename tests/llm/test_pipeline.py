"""The pipeline over a small corpus with planted cases, and the registry."""

import hashlib
import random

import corpus_pipeline
from test_operators import DOCS, edited, plain_spans, prose


def test_stages_keep_clean_documents_and_catch_the_others(spark, tmp_path):
    draw = random.Random(21)
    texts = {i: prose(draw, 70, 3000) for i in range(300)}
    toxic = {i for i in texts if i % 5 == 0}
    for i in toxic:
        w = texts[i].split()
        for _ in range(5):
            w[draw.randrange(70)] = draw.choice(["scum", "idiot", "trash"])
        texts[i] = " ".join(w)
    item = prose(draw, 30, 3000)
    copies = {1000 + k: texts[1] for k in range(20)} | {1100 + k: edited(draw, texts[2], 1) for k in range(5)}
    tainted = {1200 + k: f"{prose(draw, 40, 3000)} {item} {prose(draw, 40, 3000)}" for k in range(4)}
    private = {1300: f"{prose(draw, 40, 3000)} ann@ex.org 10.1.2.3", 1301: f"+1 (555) 123-4567 {prose(draw, 40, 3000)}"}
    rest = {1400: None, 1401: "", 1402: "<|endoftext|> x"}
    everything = texts | copies | tainted | private | rest
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in everything.items()], DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    schema, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == schema
    assert kept[0] == set(everything) - toxic
    # Null and empty texts are copies of each other; an edited copy stays with its original.
    assert kept[1] == kept[0] - set(copies) - {1401}
    assert kept[2] == kept[1] - set(tainted)
    assert kept[4] == kept[3] == kept[2]
    clean = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/out-pii").collect()}
    for i, r in clean.items():
        assert not plain_spans(r["text"] or "") and (r["text"] is None or r["n_chars"] == len(r["text"]))
        if i not in private:
            assert r["text"] == everything[i]
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256((clean[r["doc_id"]]["text"] or "").encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() and r["n_tokens"] == len(r["ids"])


def test_without_labels_or_benchmark_all_clean_documents_stay(spark, tmp_path):
    draw = random.Random(22)
    texts = {i: prose(draw, 60, 3000) for i in range(60)} | {100: None}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    one_sided = [[], [(i, 1, 0) for i in range(60)], [(i, 1, 1) for i in range(60)]]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for labels in one_sided:
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        assert corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)).count() == len(texts)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(texts)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    import __spark_entry__ as entry

    known = entry.queries()
    assert {k.partition("_")[0] for k in known if k.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in known and set(entry.oracle_sql()) <= set(known)

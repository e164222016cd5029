import random

import tiktoken

import corpus_pipeline
from clustral.llm import decontamination, jaccard_join, pii, queries


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        kept, before = {r["doc_id"] for r in out.collect()}, {r["doc_id"] for r in docs.collect()}
        assert kept <= before and out.count() == len(kept)
        if name == "near_duplicates":
            found = jaccard_join.classes(docs, "doc_id", "text", 5, 80).collect()
            assert kept == {r["component_id"] for r in found}
        if name == "decontamination":
            items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert decontamination.contained(out, "doc_id", "text", items, "item_id", "text").count() == 0
        if name == "pii":
            assert not any(any(pii.base_spans(r["text"] or "").values()) for r in out.collect())
        if name == "bpe":
            assert kept == before and all(len(r["ids"]) == r["n_tokens"] for r in out.collect())
        else:
            assert out.columns == names
        docs = out


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, copies, near copies, benchmark items, personal data, toxic texts; against plain versions."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, prose(rng.randint(20, 60)) + (" vile grumblewort vile" if i % 4 == 0 else "")) for i in range(1, 161)]
    item = prose(30)
    near = prose(200).split()
    rows += [(200, " ".join(near)), (201, " ".join([*near[:100], "other", *near[101:]])), (202, " ".join(near)), (203, None), (204, ""), (205, "   "), (206, prose(20) + " " + item + " " + prose(5)), (207, prose(20) + " a@b.co and +358 40 123 4567"), (None, prose(25)), (208, prose(9)), (208, None)]
    rows[-1] = rows[-2]
    frame = spark.createDataFrame([(i, t, "x", 1, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, content string, node int, n_chars int")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 161)] + [(None, 1), (5, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, docs = dict(corpus_pipeline.STAGES), frame
    after = {}
    for name in stages:
        docs = stages[name](spark, docs, str(tmp_path)).cache()
        after[name] = docs.collect()
    ids = {n: sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in r_) for n, r_ in after.items()}
    plain = [i for i in range(1, 161) if i % 4] + [200, 201, 202, 203, 204, 205, 206, 207, 208, 208, -1]
    assert ids["toxicity"] == sorted(plain)
    assert ids["near_duplicates"] == sorted({*plain} - {201, 202})
    assert ids["decontamination"] == ids["pii"] == ids["bpe"] == sorted({*plain} - {201, 202, 206})
    texts = dict(rows)
    cleaned = {r["doc_id"]: r for r in after["pii"]}
    assert cleaned[207]["text"] == texts[207].replace("a@b.co", "<EMAIL>").replace("+358 40 123 4567", "<PHONE>") and cleaned[207]["n_chars"] == len(cleaned[207]["text"])
    assert all(cleaned[k]["text"] == texts[k] for k in cleaned if k != 207)
    ranks, pattern = queries.tokenizer()
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert all(list(r["ids"]) == coder.encode_ordinary(cleaned[r["doc_id"]]["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in after["bpe"])
    for name, stage in stages.items():
        assert stage(spark, frame.where("false"), str(tmp_path)).count() == 0, name

"""The stages of the corpus pipeline: what each drops and keeps."""

import hashlib
import struct

import public_tokenizers
from pyspark.sql import functions as F
from test_near_copies import least_of
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tripmarts.llm.common import read_table

SF = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    docs = read_table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema], name
        old, new = {r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in after.collect()}
        assert set(new) <= set(old)
        if name == "simhash":
            assert sorted(map(repr, new)) == least_of(list(old.values()))
        if name == "decontamination":
            items = [" ".join(r["text"].lower().split()) for r in read_table(spark, SF, "benchmark").collect()]
            holds = {i for i, r in old.items() if any(t in " ".join((r["text"] or "").lower().split()) for t in items)}
            assert holds and not holds & set(new) and len(old) - len(new) <= len(holds) + 2
        if name == "pii":
            assert set(new) == set(old) and all("@mail" not in (r["text"] or "") for r in new.values()) and any(new[i]["text"] != old[i]["text"] for i in old)
            assert all(r["n_chars"] == len(r["text"]) for r in new.values())
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in read_table(spark, SF, "labels").collect()}
            gone = set(old) - set(new)
            wrong = sum(labels.get(i) == 0 for i in gone)
            assert gone and wrong <= 0.1 * len(gone)
        after = spark.createDataFrame(list(new.values()), docs.schema)
        before = after
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in corpus_pipeline.STAGES[-1][1](spark, before, SF).collect():
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_awkward_documents_pass(spark, docs):
    small = docs.select(docs["doc_id"], docs["text"], "lang", "source", F.length("text").alias("n_chars"), docs["fp"], docs["score"])
    for table in (small, small.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SF)
            table.count()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))

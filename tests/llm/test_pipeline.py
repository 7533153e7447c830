"""The pipeline, stage by stage, against plain counterparts on each stage's own input."""

import random

import numpy as np
import public_tokenizers
from brute import contamination, doc_frame, gone_lines, jaccard_components, quality_measures

import corpus_pipeline
from spanmill.llm import decontaminate
from spanmill.llm.tokenizing import encoder
from spanmill.session import cut_lineage, work_path

DRAW = random.Random(11)
VOCABULARY = ["".join(DRAW.choices("abcdefghijklmnop", k=DRAW.randint(2, 7))) for _ in range(500)]


def sentence(n):
    return " ".join(DRAW.choice(VOCABULARY) for _ in range(n)) + "."


def tables(spark):
    item = sentence(30)
    clean = ["\n".join(sentence(20) for _ in range(6)) for _ in range(40)]
    texts = [None, "", "too short", *clean, clean[0], clean[1].replace("a", "e", 1), clean[2] + "\n" + clean[3].split("\n")[0]]
    texts += [" ".join(w + "###$$$" for w in sentence(90).split()), "SHOUT!! " * 40 + "LOUD!! " * 40, "same same " * 100]
    texts += [f"{sentence(60)} {item} {sentence(50)}", " ".join([item] * 3), clean[4] + " " + sentence(2), clean[4]]
    docs = list(enumerate(texts))
    sf_dir = work_path(spark, "tables")
    doc_frame(spark, docs, extra=True).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, item), (2, sentence(12))], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    return docs, [(1, item)], sf_dir


def test_stages(spark):
    docs, items, sf_dir = tables(spark)
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = dict(docs)
    for name, stage in corpus_pipeline.STAGES:
        now = cut_lineage(stage(spark, now, sf_dir))
        if name == "packing":
            break
        assert now.columns == columns
        rows = now.select("doc_id", "text", "n_chars").collect()
        after = {r.doc_id: r.text for r in rows}
        assert all(r.n_chars == len(r.text) for r in rows) and len(after) == len(rows)
        if name == "quality_rules":
            junk = {i for i, t in docs if quality_measures(t)[5] or (t and ("###" in t or "SHOUT" in t))}
            assert set(after) == set(before) - junk and all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            gone = gone_lines(list(before.items()))
            left = {i: "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[i]) for i, t in before.items()}
            assert after == {i: t for i, t in left.items() if t}
        elif name == "ngram_jaccard_join":
            component = jaccard_components(list(before.items()))
            assert after == {i: t for i, t in before.items() if component[i][1] == i}
        else:
            hits = {i: contamination(t, items) for i, t in before.items()}
            assert set(after) == {i for i, (n, hit, _) in hits.items() if hit <= decontaminate.COVERAGE * n}
            assert any(hit for _, hit, _ in hits.values())
            for i, text in after.items():
                assert (text == before[i]) == (hits[i][1] == 0)
                assert contamination(text, items)[0] == hits[i][0] - hits[i][1]
        before = after
    own = encoder(public_tokenizers.path("byte_bpe_50k.json"), True).tokenizer
    pieces = now.collect()
    for i, text in before.items():
        size = len(own.encode(text, add_special_tokens=False).ids) + 1
        mine = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert sum(n for _, n in mine) == size and np.all(np.cumsum([0, *(n for _, n in mine)])[:-1] == [s for s, _ in mine])
    assert {p.doc_id for p in pieces} == set(before)


def test_run_and_an_empty_table(spark):
    _, _, sf_dir = tables(spark)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    empty = work_path(spark, "empty")
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_shared_and_missing_ids(spark):
    """A text that only shares its id with a copy stays; of rows with the same id and text one stays."""
    a, b = ("\n".join(sentence(20) for _ in range(6)) for _ in range(2))
    docs = doc_frame(spark, [(1, a), (2, a), (2, b), (5, b + " end"), (None, a), (6, "x"), (6, "x")], extra=True)
    kept = corpus_pipeline.ngram_jaccard_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (2, b), (6, "x")]

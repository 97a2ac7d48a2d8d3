"""The pipeline on a small corpus, stage by stage against plain versions, and on odd and empty tables."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline as P
from tidemark.llm import mixing, quality

from .test_exact import plain_lines, plain_links, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    corpus[0].write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int(len(r[1] or "") > 3), 0) for r in corpus[1][::2]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {}
    for name, stage in P.STAGES:
        held = {r.doc_id: r for r in docs.collect()} if name != "tokens" else {}
        docs_before = docs
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name != "tokens":
            assert docs.columns == COLUMNS
        if name == "quality":
            source = spark.read.parquet(f"{folder}/documents.parquet")
            keep = {r.doc_id for r in quality.classify(source, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
            assert {r.doc_id for r in rows} == keep
        elif name == "line_dedup":
            gone = plain_lines([tuple(r) for r in held.values()], 2, 50)
            want = {}
            for i, r in held.items():
                if r.text is None:
                    want[i] = None
                    continue
                out_lines = gone[(False, i, r.text)]
                text = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in out_lines)
                if not out_lines or re.sub(r"\s+", "", text):
                    want[i] = text
            assert {r.doc_id: r.text for r in rows} == want
            assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        elif name == "near_duplicates":
            sets = {i: shingles(r.text, 5, True) for i, r in held.items()}
            kept = {r.doc_id for r in rows}
            for a in kept:
                for b in kept:
                    if a < b and sets[a] and sets[b]:
                        assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
            assert all(i in kept for i in held if not sets[i])
            links = plain_links([(i, r.text) for i, r in held.items()], 5, 80)
            assert kept == {i for i, (n, least) in links.items() if not n or least == i}
        elif name == "mixing":
            before = {r.doc_id: r.text for r in rows}
            assert all(held[r.doc_id].text == r.text for r in rows)
            copies = {r.doc_id: r.copies for r in mixing.mix(docs_before).collect()}
            assert Counter(r.doc_id for r in rows) == Counter({i: n for i, n in copies.items() if n})
        else:
            import sentencepiece

            from tidemark.llm.tokens import default_model

            library = sentencepiece.SentencePieceProcessor(model_file=default_model())
            for r in rows:
                ids = library.encode(before[r.doc_id] or "")
                assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_one_row_of_a_component_stays(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(None, words), (None, words + " x"), (None, words), (4, "other words here"), (4, words + " y"), (None, ""), (None, ""), (None, None), (9, " \t")]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or -1, r.text or "") for r in P.near_duplicates(spark, docs, "").collect())
    assert got == sorted([(4, words + " y"), (4, "other words here"), (-1, ""), (-1, ""), (-1, ""), (9, " \t")])
    nulls = docs.where("doc_id is null")
    assert P.near_duplicates(spark, nulls, "").where("text like 'w%'").count() == 1


def test_run(spark, folder):
    assert P.run(spark, folder).count() > 50


def test_odd_and_empty(spark, odd, empty, folder):
    for df in (odd[0], empty):
        for name, stage in P.STAGES:
            if name == "quality":
                docs = df
            out = stage(spark, docs, folder)
            if name != "tokens":
                docs = spark.createDataFrame(out.collect(), out.schema)
            else:
                assert out.count() >= 0

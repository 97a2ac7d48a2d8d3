"""Tokens, personal data, quality, mixing and nearest neighbours."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, neighbours, pii, quality, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())


def test_encoding_equals_the_library(corpus, library):
    df, data = corpus
    texts = {i: t or "" for i, t, *_ in data}
    for r in tokens.encode_documents(df, tokens.default_model(), with_ids=True).collect():
        ids = library.encode(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encoding_of_odd_strings(library):
    with open(tokens.default_model(), "rb") as f:
        model = tokens.MergeModel(f.read())
    rng = np.random.default_rng(4)
    letters = list("abcdethinguors  \n\t▁é𝄞中<s></s><0x0A>.,0123﻿\x00")
    for _ in range(600):
        text = "".join(rng.choice(letters, rng.integers(0, 50)))
        assert model.encode(text) == library.encode(text), repr(text)
        assert model.decode(model.encode(text)) == library.decode(library.encode(text))


def test_pre_tokens():
    rng = np.random.default_rng(7)
    for _ in range(2000):
        text = "".join(rng.choice(list("ab ▁\n\té"), rng.integers(0, 12)))
        assert tokens.pre_tokens(text) == (tokens.PRE_TOKEN.findall(f" {text}".replace("▁", " ")) if text else []), repr(text)


def test_pairs_follow_the_merge_procedure():
    with open(tokens.default_model(), "rb") as f:
        model = tokens.MergeModel(f.read())
    rng = np.random.default_rng(5)
    ids = np.array(sorted(model.tokens))
    made = model.pair[rng.choice(len(model.pair), 3000)]  # pairs that some piece is made of
    spaces = ids[model.tied[ids]]
    a, b = (np.concatenate([rng.choice(ids, 3000), m, rng.choice(spaces, 300), rng.choice(ids, 300)]) for m in (made >> 20, made & 0xFFFFF))
    a, b = np.concatenate([a, b[-300:]]), np.concatenate([b, a[-600:-300]])
    some = np.isin(a, ids) & np.isin(b, ids)
    a, b = a[some], b[some]
    got = model.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        two = [model.pieces[x], model.pieces[y]]
        assert (model.merges("".join(two))[0] == two) == ok, two
    assert 0.1 < got.mean() < 0.9


@pytest.mark.parametrize("remembered", [0, 50])
def test_forgetting_changes_nothing(corpus, remembered):
    df, _ = corpus
    got = {tuple(r) for r in tokens.encode_documents(df, tokens.default_model(), remembered=remembered).collect()}
    assert got == {tuple(r) for r in tokens.encode_documents(df, tokens.default_model(), keep=True).collect()}


def test_a_long_text(spark, library):
    text = "a long text of 5 MB, 中文. " * 200_000 + "x" * 20_000
    r = tokens.encode_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokens.default_model()).first()
    ids = library.encode(text)
    assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert tokens.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokens.default_model()).first().n_tokens == len(ids)


def test_counts_equal_the_library(corpus, library):
    df, data = corpus
    texts = {i: t or "" for i, t, *_ in data}
    for r in tokens.count_tokens(df, tokens.default_model(), limit=100).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 100)


def test_other_models_are_refused():
    with pytest.raises(Exception):  # noqa: B017
        tokens.MergeModel(b"no model")


def test_tokens_odd(odd, empty):
    for f in (tokens.encode_documents, tokens.count_tokens):
        assert f(empty, tokens.default_model()).count() == 0
        assert f(odd[0], tokens.default_model()).count() == len(odd[1])


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(BASE[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_identifiers():
    rng = np.random.default_rng(6)
    for letters, size, times in (("a1.2@+- ()0 5b.@é", 40, 4000), ("0123456789 -..+", 50, 4000)):
        for _ in range(times):
            text = "".join(rng.choice(list(letters), rng.integers(0, size)))
            assert pii.identifiers(text) == plain_base(text), repr(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("write to jane at mail dot example dot com please", "email", "jane at mail dot example dot com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("at one nine two dot one six eight dot one dot two five", "ip", "one nine two dot one six eight dot one dot two five"),
        ("é jоhn@example.com", "email", "jоhn@example.com"),
        ("john＠example．com", "email", "john＠example．com"),
        ("４９４４３３９４９０４２９６０５", "card", "４９４４３３９４９０４２９６０５"),
        ("four nine four four three three nine four nine zero four two nine six zero five", "card", "four nine four four three three nine four nine zero four two nine six zero five"),
        ("card 4944 three 394 9042 nine 605 now", "card", "4944 three 394 9042 nine 605"),
        ("jo​hn@exa​mple.com", "email", "jo​hn@exa​mple.com"),
    ],
)
def test_disguises(text, kind, found):
    base = pii.identifiers(text)
    assert (kind, found) in [(pii.KINDS[k], text[s:e]) for s, k, e in pii.disguised(text, base)]


@pytest.mark.parametrize("text", ["", "one two three", "we met at noon. dot the i", "the cat sat at a table", "three four five people at ten", "Größe – und “Zitate” mit 123.45"])
def test_clean_texts_have_no_spans(text):
    assert pii.identifiers(text) == [] and pii.disguised(text, []) == []


def test_pii_table(spark, odd, empty, corpus):
    text = "a@b.co, 10.0.0.1 and x [at] y [dot] org"
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_email, r.n_ip, r.n_added) == (1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(b"email:0:6,ip:8:16").hexdigest()
    assert r.spans == f"email:0:6,ip:8:16,email:21:{len(text)}"
    assert pii.find_pii(empty).count() == 0 and pii.find_pii(odd[0]).count() == len(odd[1])
    long = "1" * 300_000 + " " + "a" * 300_000 + "@" * 1000 + "one " * 50_000 + "at dot " * 20_000
    assert pii.identifiers(long) == [] and isinstance(pii.disguised(long, []), list)


def labelled(spark, n=600):
    """Prose and shouting, in turn; some of both have labels."""
    rng = np.random.default_rng(8)
    data, marks = [], []
    for k in range(n):
        good = k % 4 != 0
        words = ["".join(rng.choice(["an", "er", "in", "th"], rng.integers(1, 4))) for _ in range(80)]
        text = " ".join(words) + "." if good else "!! ".join(w.upper() for w in words[:40])
        data.append((k, text, "en", "s", len(text)))
        if k % 2 == 0 or k % 5 == 0:
            marks.append((k, int(good), 0))
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


def test_quality(spark):
    docs, labels, marks = labelled(spark)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q, _ in marks if got[i].held_out]
    assert len(held) > 30 and np.mean([p == q for p, q in held]) > 0.95


def test_held_out_labels_and_other_columns_don_t_matter(spark):
    docs, labels, _ = labelled(spark, 200)
    one = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    two = {r.doc_id: r.score for r in quality.classify(docs.withColumn("source", F.lit("zz")).withColumn("lang", F.lit(None).cast("string")), turned).collect()}
    assert one == two


def test_quality_odd(spark, odd, empty):
    _, labels, _ = labelled(spark, 40)
    assert quality.classify(empty, labels).count() == 0
    got = quality.classify(odd[0], labels.limit(0)).collect()
    assert len(got) == len(odd[1]) and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}


def test_non_negative_risk_separates():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (900, 6)), rng.normal(-1, 1, (300, 6))
    model = quality.fit(good[:300], np.vstack([good[300:], bad]), 600 / 900)
    assert model.scores(good).mean() > 0.8 > 0.3 > model.scores(bad).mean()


def fill(sizes, weights, total, most):
    """Share by weight, cut at the limit and share the excess again, until none is above."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / w > most * sizes[k]}
        if not over:
            for k in open_:
                target[k] = left * weights[k] / w
            break
        for k in over:
            target[k] = most * sizes[k]
        left -= sum(target[k] for k in over)
        open_ -= over
    return target


def test_mixing(corpus):
    df, data = corpus
    got = mixing.mix(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in data)
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in data}
    names = sorted({r[3] for r in data if r[3] is not None}) + [None]
    total = [sum(sizes[r[0]] for r in data if r[3] == s) for s in names]
    want = dict(zip(names, fill(total, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(total), 2.0), strict=True))
    taken, biggest = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    for r in got:
        assert r.size == sizes[r.doc_id] and r.source_size == total[names.index(r.source)] and r.taken == r.copies * r.size <= 2 * r.size
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
    for s in names:
        assert abs(taken[s] - want[s]) <= 2 * biggest[s]
    again = {r.doc_id: r.copies for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in got)


def test_blocks_fill_evenly_under_any_ids(spark):
    for ids in ([k * 1024 for k in range(3000)], [None] * 3000):
        rows = [(i, f"some words of document {k}", "s") for k, i in enumerate(ids)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        assert got.count() == 3000 and got.agg(F.sum("taken")).first()[0] == 1.5 * 5 * 3000


def test_mixed_rows_are_those_that_the_mix_drew(spark):
    rows = [(None if k % 2 else 5, f"text {k // 3 % 40} of some words", "a" if k % 5 else None, k % 2) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").withColumns({c: F.lit("x") for c in ("_id", "_source", "_size", "_copies", "_copy", "row", "copies", "hash")})
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want = mixing.mix(df).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()
    got = {(r.doc_id, r.source): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    assert got == {(r.doc_id, r.source): r.n for r in want if r.n}
    most = out.groupBy("doc_id", "source", "text").count().agg(F.max("count")).first()[0]
    times = df.groupBy("doc_id", "source", "text").count().agg(F.max("count")).first()[0]
    assert most <= 2 * times


def test_mixing_odd(spark, odd, empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd[0]).count() == len(odd[1])
    nothing = spark.createDataFrame([(1, "", None), (2, None, "a")], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(nothing).collect()} == {(0, 0.0, 0)}


def vectors(spark, n=1500, dim=16):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, dim)) * 3
    x = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim))).astype(np.float32)
    x[50:90] = x[50] if n > 50 else 0  # one very common vector
    rows = [(k, x[k].tolist(), 0) for k in range(n)]
    rows += [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [float("nan")] * dim, 0), (n + 3, [None, *[1.0] * (dim - 1)], 0), (n + 4, [float("inf"), *[1.0] * (dim - 1)], 0), (n + 5, [], 0), (None, [1.0] * dim, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), x.astype(np.float64)


def test_nearest(spark):
    df, x = vectors(spark)
    got = neighbours.nearest(df, df.where("vec_id % 25 = 0")).toPandas()
    assert set(got["query_id"]) == {k for k in range(1500) if k % 25 == 0}
    hits = total = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g["score"], d[g["vec_id"]], rtol=1e-13)
        assert list(zip(g["score"], g["vec_id"], strict=True)) == sorted(zip(g["score"], g["vec_id"], strict=True))
        hits += len(set(g["vec_id"]) & set(best))
        total += 10
    assert hits / total >= 0.9
    ties = got[got["query_id"] == 50].sort_values("rank")
    assert ties["vec_id"].tolist() == list(range(51, 61)) and (ties["score"] == 0).all()


def test_nearest_odd(spark):
    df, _ = vectors(spark, 30)
    few = neighbours.nearest(df.where("vec_id < 4"), df.where("vec_id = 0")).toPandas()
    assert sorted(few["vec_id"]) == [1, 2, 3] and sorted(few["rank"]) == [1, 2, 3]
    assert neighbours.nearest(df.limit(0), df).count() == 0
    assert neighbours.nearest(df.where("vec_id >= 30"), df).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    twice = df.where("vec_id < 3").union(df.where("vec_id < 3")).withColumn("part", F.lit("x"))
    assert sorted(neighbours.nearest(twice, twice.where("vec_id = 0")).toPandas()["vec_id"]) == [1, 1, 2, 2]


def test_nearest_in_levels(spark):
    """Parts above the leaf's size are cut again, by routers of their own; recall is measured on 50,000 rows."""
    n, dim = 50_000, 24
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(300, dim))[rng.integers(0, 300, n)] * 2 + rng.normal(size=(n, dim))).astype(np.float32).astype(np.float64)
    x[:1500] = x[0]  # a vector so common that only its first ids can be found
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float64()))}))
    got = neighbours.nearest(df, df.where("vec_id % 250 = 0"), leaf=600).toPandas()
    hits = 0
    for q in range(0, n, 250):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(n), d))[:10]
        g = got[got["query_id"] == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g["score"], d[g["vec_id"]], rtol=1e-13)
        if q < 1500:
            assert g["vec_id"].tolist() == best.tolist()
        hits += len(set(g["vec_id"]) & set(best))
    print("recall", hits / (10 * n / 250))
    assert hits / (10 * n / 250) >= 0.9


def test_nearest_tops_up(spark):
    """A query far from all rows, whose parts may hold fewer than k rows, still gets k."""
    df, x = vectors(spark, 700)
    far = spark.createDataFrame([(10_000, [100.0] * 16), (10_001, [-100.0] * 16)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, far, k=400).toPandas()
    assert got.groupby("query_id").size().to_dict() == {10_000: 400, 10_001: 400}


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(640, 8))
    part = neighbours.balanced_parts(x, neighbours.graph(x, 8), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.1 * 80)

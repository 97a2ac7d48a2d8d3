"""Fingerprints, line dedup, substring dedup and the Jaccard join against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, fingerprints, induced, jaccard, lines, substrings
from tidemark.llm import shingles as shingles_of
from tidemark.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = WORD.findall(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_fingerprints(corpus):
    df, data = corpus
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df).collect()}
    order = sorted(data, key=lambda r: -r[0])
    errors, by_text = [], {}
    for k, (i, text, *_) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        own, other = shingles(text, 5), shingles(edited, 5)
        errors.append(abs(likeness(own, other) - got[i].near_edited))
        if len(own | other) <= fingerprints.K:
            assert errors[-1] < 1e-12
        assert abs(likeness(own, shingles(following, 5)) - got[i].near_next) < 0.2
        assert len(own) >= fingerprints.K or got[i].n_shingles == len(own)
    assert np.mean(errors) < 0.03 and max(errors) < 0.2


@pytest.mark.parametrize("case", ["outlier", "range", "multiples", "one", "null", "few"])
def test_next_documents_by_any_ids(spark, case):
    rng = random.Random(9)
    n = 900
    ids = {
        "outlier": [*range(n - 1), 2**62], "range": [-(2**63), 2**63 - 1, *(rng.randrange(-(2**63), 2**63) for _ in range(n - 2))], "multiples": [k * 2**40 + k % 3 for k in range(n)],
        "one": [7] * n, "null": [None] * n, "few": [[1, 2, None][k % 3] for k in range(n)],
    }[case]
    rows = [(i, f"text number {k} " * (k % 5)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    near = fingerprints.neighbours(df)
    assert near.where("guest = 0").count() == n
    sizes = {tuple(r.bucket): r["count"] for r in near.where("guest = 0").groupBy("bucket").count().collect()}
    assert max(sizes.values()) <= 4 * 64 + 180  # equal rows, here the empty texts of one id, stay together
    got = fingerprints.fingerprint_documents(df).collect()
    assert len(got) == n
    if case in ("outlier", "range", "multiples"):
        order = sorted(rows, key=lambda r: -r[0])
        want = {}
        for k, (i, text) in enumerate(order):
            half = len(text) // 2
            want[i] = hashlib.sha256((text[: len(text) - half] + order[(k + 1) % n][1][:half]).encode()).hexdigest()
        assert {r.doc_id: r.edited_sha256 for r in got} == want


def test_containment_of_parts(spark):
    words = [f"w{k}" for k in range(400)]
    pairs = [(" ".join(words[:a]), " ".join(words[b:c])) for a, b, c in ((100, 0, 400), (400, 0, 100), (200, 100, 300), (50, 60, 90))]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprints.sketch(F.col("a")).alias("x"), fingerprints.sketch(F.col("b")).alias("y"))
    for r in df.select("a", "b", fingerprints.containment(F.col("x"), F.col("y")).alias("c")).collect():
        x, y = shingles(r.a, 5), shingles(r.b, 5)
        assert abs(r.c - len(x & y) / len(x)) < 0.15


def test_sketches_merge(spark):
    rng = random.Random(2)
    a, b = (" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 300)) for _ in range(3000)) for _ in range(2))
    s = fingerprints.sketch
    df = spark.createDataFrame([(a, b)], "a string, b string").select(s(F.col("a")).alias("a"), s(F.col("b")).alias("b"))
    one = df.select(fingerprints.merged(F.col("a"), F.col("b")).alias("u"), fingerprints.distinct_shingles(F.col("a")).alias("n"), fingerprints.containment(F.col("a"), F.col("a")).alias("c")).first()
    parts = df.select(F.lit("k").alias("k"), F.explode(F.array("a", "b")).alias("sketch"))
    assert fingerprints.merge_parts(parts, ["k"]).first()["sketch"] == one.u
    assert abs(one.n / len(shingles(a, 5)) - 1) < 0.3 and one.c == 1.0


def test_fingerprints_odd(odd, empty):
    assert fingerprints.fingerprint_documents(empty).count() == 0
    got = fingerprints.fingerprint_documents(odd[0]).collect()
    assert len(got) == len(odd[1])
    assert len({r.fingerprint for r in got if r.n_chars > 100}) == 1
    one = fingerprints.fingerprint_documents(odd[0].limit(1)).first()
    assert one.near_next == 1.0


def plain_lines(data, run, long_line):
    """(doc_id, text) -> numbers of the lines that go."""
    docs = {(i is None, i or 0, t): None for i, t, *_ in data if t is not None}
    seen, gone = {}, {}
    for key in sorted(docs):
        full = [(k, x.strip(" \t\v\f\r")) for k, x in enumerate(key[2].split("\n")) if x.strip(" \t\v\f\r")]
        out = gone[key] = set()
        for k in range(len(full)):
            windows = [full[k : k + run]] if k + run <= len(full) else []
            if len(WORD.findall(full[k][1])) >= long_line:
                windows.append([full[k]])
            for w in windows:
                if seen.setdefault(tuple(x for _, x in w) + (len(w),), (key, k)) != (key, k):
                    out.update(n for n, _ in w)
    return gone


@pytest.mark.parametrize("run", [2, 3])
def test_lines(corpus, run):
    df, data = corpus
    want = plain_lines(data, run, 50)
    removed = 0
    for r in lines.dedup_lines(df, run).collect():
        text = next(t for i, t, *_ in data if i == r.doc_id)
        if text is None:
            assert r.text is None and r.n_lines == 0
            continue
        gone = want[(False, r.doc_id, text)]
        assert r.text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        assert (r.n_lines, r.n_removed) == (text.count("\n") + 1, len(gone))
        removed += len(gone)
    assert removed > 50


def test_line_fingerprints_are_fewer_than_windows_and_span_edges(spark):
    """One position for each window minimum; runs that begin, end or meet at a fingerprint, and equal lines in a row."""
    rng = random.Random(3)
    names = [f"line number {k}" for k in range(12)]
    data = [(k, "\n".join(rng.choice(names) for _ in range(rng.randint(0, 14)))) for k in range(60)]
    data += [(60, "a\na\na\na"), (61, "a\na"), (62, "a"), (63, "\n\n a \n\na"), (64, " ".join(["w"] * 50)), (65, "x\n" + " ".join(["w"] * 50) + "\ny")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for run in (2, 3, 4):
        want = plain_lines(data, run, 50)
        got = {r.doc_id: r for r in lines.dedup_lines(df, run).collect()}
        for i, text in data:
            gone = want[(False, i, text)]
            assert got[i].text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone), (run, i)
        windows = sum(max(0, len([x for x in t.split("\n") if x.strip()]) - run + 1) for _, t in data)
        assert lines.fingerprints(df.withColumn("same", F.xxhash64("text")), run, 50).count() < windows


def test_lines_end_in_carriage_returns(spark):
    data = [(1, "one line\nanother line\nlast"), (2, "first\r\none line\r\nanother line\r\n\r\n\r\nend"), (3, "q\r\n\r\n\t\r\n\r\nr"), (4, "s\r\n\r\n\t\r\n\r\nt")]
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: (0, data[0][1]), 2: (2, "first\r\n\r\n\r\nend"), 3: (0, data[2][1]), 4: (0, data[3][1])}


def test_lines_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "z\na\nb")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_id", "_text", "_removed", "_same", "row", "at", "fp", "window")})
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert got[2].text == "z" and got[1].text == "a\nb\nc" and got[2]["_same"] == "x" and set(got[1].asDict()) == {*df.columns, "n_lines", "n_removed"}


def test_lines_odd(odd, empty):
    assert lines.dedup_lines(empty).count() == 0
    got = lines.dedup_lines(odd[0]).collect()
    assert len(got) == len(odd[1])
    assert sorted(r.n_removed for r in got if r.n_lines == 2) == [0, 0, 2]  # equal rows are one document
    assert set(got[0].asDict()) == set(odd[0].columns)


def plain_links(data, n, percent):
    sets = [shingles(t, n, True) for _, t, *_ in data]
    top = list(range(len(sets)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            top[find(a)] = find(b)
    least = {}
    for k, row in enumerate(data):
        least[find(k)] = min(least.get(find(k), row[0]), row[0])
    return {row[0]: (len(sets[k]), least[find(k)]) for k, row in enumerate(data)}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (3, 50), (1, 100)])
def test_jaccard(corpus, n, percent):
    df, data = corpus
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(df, n, percent).collect()}
    assert got == plain_links(data, n, percent)


def test_jaccard_with_a_large_group(spark):
    """More near copies than a small group has, with likeness on both sides of the limit."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    data = []
    for k in range(jaccard.LARGE * 2 + 40):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"e{rng.randint(0, 30)}"
        data.append((k, " ".join(own)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(df, 3, 90).collect()}
    assert got == plain_links(data, 3, 90)


def test_words_of_one_polynomial_hash_are_told_apart(spark):
    """A Thue-Morse string and its complement agree under any polynomial modulo 2^64."""
    data = []
    for k in range(9, 13):
        a = "a"
        for _ in range(k):
            a += a.translate(str.maketrans("ab", "ba"))
        data += [(4 * k, a), (4 * k + 1, a.translate(str.maketrans("ab", "ba"))), (4 * k + 2, f"x {a} y"), (4 * k + 3, a)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(spark.createDataFrame(data, "doc_id long, text string"), 3, 90).collect()}
    assert got == {i: (1, i - 3 if i % 4 == 3 else i) for i, _ in data}


def test_classes_with_one_first_half_go_by_the_second():
    s = shingle_sets([b"a b c d"], 3)[0]
    first, second = jaccard.halves(s)
    assert jaccard.class_of(s, frozenset()) == first and jaccard.class_of(s, frozenset([first])) == second
    assert jaccard.halves(s[:0]) == (0, 0)
    double = np.array([(1, 2), (1, 3), (2, 2)], s.dtype)
    assert shingles_of.common(double, double[1:]) == 2 and shingles_of.common(double[1:], double[::2]) == 1


def test_a_crowded_key_is_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "CROWD", 3)
    rows = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(60)], "u long, x long")
    of = rows.groupBy("u").agg(F.count("*").alias("of"), F.max("x").alias("m"))
    assert sorted(map(tuple, common.joined(rows, of, ["u"], 60).collect())) == sorted(map(tuple, rows.join(of.drop("of"), "u").collect()))


def test_jaccard_odd(odd, empty):
    assert jaccard.similar_components(empty).count() == 0
    got = jaccard.similar_components(odd[0]).collect()
    assert len(got) == len(odd[1])
    assert {r.component_id for r in got if r.n_shingles > 15} == {1}


def test_shingle_hashes_follow_words():
    texts = ["A b  c\td", "a B c d", "a b c e", "", " ", "x", "X", "a b"]
    sets = shingle_sets([t.encode() for t in texts], 3)
    assert np.array_equal(sets[0], sets[1]) and len(np.intersect1d(sets[0], sets[2])) == 1
    assert [len(s) for s in sets] == [2, 2, 2, 0, 0, 1, 1, 1] and np.array_equal(sets[5], sets[6])


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for k in range(150):
        t = rng.integers(0, [2, 3, 20, 250][k % 4], rng.integers(0, 120))
        if k % 3 == 0:
            t = np.concatenate([t[: len(t) // 2]] * 3)
        if k % 5 == 0:
            t = np.repeat(t[:15], rng.integers(1, 12, len(t[:15])))
        order, common = induced.suffix_array(t, 10, [1 << 20, 300][k % 2])
        plain = sorted(range(len(t)), key=lambda i: tuple(t[i:].tolist()))
        assert order.tolist() == plain
        for a, b, c in zip(plain, plain[1:], common[1:].tolist(), strict=False):
            x, y = t[a:].tolist(), t[b:].tolist()
            assert c == min(10, next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))))


def plain_repeats(rows, length):
    """(n_bytes, n_removed, n_spans, digest) in the order of rows, which is that of documents."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
        out.append((len(raw), int(gone.sum()), edges, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("length", [64, 100, 150])
def test_substrings(corpus, length):
    df, data = corpus
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(df, length, memory=10_000).collect()}
    want = plain_repeats([t for _, t, *_ in data], length)
    assert [got[i] for i, *_ in data] == want
    assert sum(w[1] for w in want) > 1000


def test_substrings_odd(odd, empty):
    assert substrings.remove_repeats(empty).count() == 0
    got = substrings.remove_repeats(odd[0], with_text=True).collect()
    order = sorted(odd[1], key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert sorted(tuple(r)[1:5] for r in got) == sorted(plain_repeats([t for _, t, *_ in order], 100))
    assert sum(len(r.kept) for r in got) == sum(r.n_bytes - r.n_removed for r in got)
    with pytest.raises(ValueError):
        substrings.remove_repeats(empty, 10)


@pytest.fixture(scope="module")
def crowded():
    """Texts around two phrases: contexts of few anchors, some strings longer than the phrase shared, one very often."""
    rng = random.Random(8)
    phrase, long_one = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (70, 98))
    tails = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(12)]
    word = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    rows = []
    for k in range(400):
        a, b = rng.choice(tails) if k % 3 else word(60), rng.choice(tails) if k % 4 else word(60)
        rows.append(word(rng.randint(0, 90)) + a + phrase + b + word(20) + ("xy" + long_one + "z" if k % 2 else long_one) + word(80))
    return rows


@pytest.mark.parametrize(("most", "crowd"), [(2000, 1000), (2000, 20), (700, 5)])
def test_substrings_split_crowded_anchors(spark, crowded, most, crowd):
    df = spark.createDataFrame(list(enumerate(crowded)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(df, 100, most=most, crowd=crowd).collect()}
    assert [got[k] for k in range(len(crowded))] == plain_repeats(crowded, 100)


def test_no_crowded_anchor_is_sorted_at_once(spark, crowded):
    docs = spark.createDataFrame(list(enumerate(crowded)), "key long, text string")
    most, parts = 2000, 4
    compared = substrings.compare_contexts(substrings.find_contexts(docs, 100, parts, 20), parts, most)
    hot = np.unique(np.concatenate([np.frombuffer(r.data, "<u8") for r in compared.where("kind = 3").collect()]))
    packed = substrings.find_contexts(docs, 100, parts, 20, hot).where("kind = 3").cache()
    split, known = substrings.split_hot(packed, 100, parts, most)
    before, after = ([substrings._unpack(r.data)[0] for r in d.collect()] for d in (packed, split))
    sizes = []
    for wants in (before, after):
        want = np.concatenate(wants)
        _, which = np.unique(want["h"], return_inverse=True)
        sizes.append(np.bincount(which, want["size"]).max())
    assert sizes[0] > 10 * most and sizes[1] <= most and known.count()

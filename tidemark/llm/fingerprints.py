"""Bottom-k fingerprints of documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

#: Words in a shingle, and hashes in a fingerprint.
SHINGLE, K = 5, 256


def sketch(text: Column, k: int = K, words: int = SHINGLE) -> Column:
    """The k smallest distinct hashes, ascending, of a text's shingles of ``words`` words.

    A text with fewer words has its whole sequence as one shingle; one without words, or null, has none.
    """
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(split, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(runs)), 1, k))

    # an array of one, so that the words are split and hashed once
    return F.element_at(F.transform(F.array(hashed), shingles), 1)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets; exact while the union has at most k; 1 for two empty ones."""
    return F.element_at(
        F.transform(F.array(F.struct(merged(a, b, k).alias("u"), F.array_intersect(a, b).alias("i"))), lambda s: F.when(F.size(s["u"]) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(s["u"], s["i"])) / F.size(s["u"]))), 1
    )


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + float(2**63)) / float(2**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 where a has none."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (n + m) / (1 + j) / n))


def merge_parts(parts: DataFrame, keys: list[str], sketch_column: str = "sketch", k: int = K, salts: int = 32) -> DataFrame:
    """One merged sketch for each key: salted bottom-k first, so a key with very many parts stays spread."""
    hashes = parts.select(*keys, F.explode(sketch_column).alias("_h")).withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(salts))).distinct()
    small = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("_h"))).where(F.col("_r") <= k)
    return small.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(sketch_column))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def neighbours(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with hash, bucket, guest: each bucket of ids with the document that follows its last one.

    The order is descending doc_id, nulls last, equal ids by the text's hash and the text; after the last comes the
    first. Buckets are equal stretches of the ids, of about sqrt(rows) / 4 rows each; one that turns out more than four
    times as full is cut into stretches of its own, and again until none is, and one of a single id, or of none, by
    the texts' hashes. So neither a bucket nor the list of buckets grows beyond what a task holds (equal rows stay
    together). A bucket's key is the list of its places, level by level. Only each bucket's first document is
    copied, to the one before.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    per_bucket = max(64, int(n**0.5) // 4)
    parts = F.ceil(F.col("n") / per_bucket).cast("decimal(38,0)")

    def place(low: Column, high: Column, parts: Column) -> Column:
        low, high = (x.cast("decimal(38,0)") for x in (low, high))  # two ids may lie more than 2^63 apart
        return F.call_function("div", F.col("doc_id").cast("decimal(38,0)") - low, F.ceil((high - low + 1) / parts).cast("decimal(38,0)"))

    first = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(place(F.lit(low or 0), F.lit(high or 0), F.lit(max(1, -(-n // per_bucket)))))
    placed = docs.select("doc_id", "text", F.lit(0).cast("long").alias("hash"), F.array(first).alias("bucket"))
    by_text = False
    while True:
        cells = cut(placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "hash")).alias("first"), F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
        count, full, single = cells.agg(F.count("*"), F.max(F.col("n") * (F.col("low") < F.col("high")).cast("int")), F.max(F.col("n") * (~F.coalesce(F.col("low") < F.col("high"), F.lit(False))).cast("int"))).first()
        most = 4 * per_bucket
        if (full or 0) > most:
            more = cells.where((F.col("n") > most) & (F.col("low") < F.col("high")))
            sub = place(F.col("low"), F.col("high"), parts)
        elif not by_text and (single or 0) > most:
            by_text, placed = True, placed.withColumn("hash", F.xxhash64("text"))
            more = cells.where(F.col("n") > most)
            sub = F.call_function("div", F.col("hash").cast("decimal(38,0)") + F.lit(str(2**63)).cast("decimal(38,0)"), F.ceil(F.lit(str(2**64)).cast("decimal(38,0)") / parts).cast("decimal(38,0)"))
        else:
            break
        more = F.broadcast(more.select("bucket", "n", "low", "high"))  # fewer than rows / most, which is sqrt(rows)
        placed = placed.join(more, "bucket", "left").select("doc_id", "text", "hash", F.when(F.col("n").isNull(), F.col("bucket")).otherwise(F.concat("bucket", F.array(sub))).alias("bucket"))
    down = Window.orderBy(F.col("bucket").desc())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = cells.select(F.col("bucket").alias("own"), "first", F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(every)).alias("to"))
    if count <= 1_000_000:  # some 60 bytes each
        firsts = F.broadcast(firsts)
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    guests = placed.join(firsts, (F.col("bucket") == F.col("own")) & is_first).select("doc_id", "text", "hash", F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    return placed.select("doc_id", "text", "hash", "bucket", F.lit(0).alias("guest")).unionByName(guests)


def fingerprint_documents(docs: DataFrame, k: int = K, words: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_shingles.

    One row for each row of docs. The edited text has the last half of the characters replaced by the first as
    many of the next document (see ``neighbours``; of a table with one row, the document itself). Null texts
    are empty; equal texts have equal fingerprints; two texts without words are alike (1.0). Other columns
    are ignored, and an empty table gives an empty result. Ids may be of the whole 64-bit range, repeat or be null.
    Texts are shuffled once, by bucket; a long one is held with its words' hashes.
    """
    rows = neighbours(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), "text")
    half = F.expr("cast(char_length(text) div 2 as int)")
    both = (
        rows.withColumn("next_text", F.lead("text").over(order))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
        .select("doc_id", "hash", "bucket", "guest", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text"), k, words).alias("a"), sketch(F.when(F.col("guest") == 0, F.col("edited")), k, words).alias("e"))
        .withColumn("b", F.lead("a").over(order))
        .where("guest = 0")
    )
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("e"), k).alias("near_edited"), resemblance(F.col("a"), F.col("b"), k).alias("near_next"), distinct_shingles(F.col("a"), k).alias("n_shingles"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and how alike these are."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLES: dict[str, str] = {}

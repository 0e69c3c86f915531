"""Benchmark decontamination: a prefix-filtered set join of shingles, verified on whole windows. DataFrame functions only.

A window of an item occurs in a document only if all its shingles do, so its prefix for full containment is one shingle:
the rarest over all documents. Every document word position is tested against a bit filter of the benchmark's shingles
(of bounded size, so that it can sit in the plan; it can only pass too many), the positions that pass are joined exactly,
counted for the rarity order, and only the anchors' positions are joined with windows: the positional bound (the window
has to start in the document) and the length bound (it has to end there) come first, then its words are compared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm.common import Scratch, row_number, table

WINDOW = 13
SHINGLE = 4
#: The filter has two to this many bits at least, sixteen for each shingle, and two to the second at most; a fuller one passes more.
FILTER_BITS, MOST_BITS = 20, 24
#: What separates words; A-Z are lower-cased after the split.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def folded_words(text: Column) -> Column:
    """Words lower-cased with no regard to ASCII: equal wherever the exact words are, and cheap. A capital sigma
    depends on its neighbours, so texts with one are folded word by word."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit("Σ")), F.transform(split_words(text), F.lower)).otherwise(F.array_remove(F.split(F.lower(text), SEPARATORS), ""))


def positions(n: Column, size: int) -> Column:
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: str, size: int) -> Column:
    w = F.col(words)
    return F.transform(positions(F.size(w), size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))


def places(h: Column, bits: int) -> tuple[Column, Column]:
    mask = (1 << bits) - 1
    return h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)


def bit_filter(hashes: DataFrame, bits: int) -> Column:
    """A foldable array of 2 ** bits bits in which both places of each hash are set."""
    spots = hashes.select(F.explode(F.array(*places(F.col("h"), bits))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int"))
    got = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("b")).collect()
    words = np.zeros(1 << (bits - 6), np.int64)
    for x in got:
        words[x["w"]] = x["b"]
    return F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<long>")


def is_set(marks: Column, place: Column) -> Column:
    word = F.get(marks, F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftright", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def found_of(size: int, hashes: Column, n: Column, marks: Column, bits: int) -> Column:
    """The word positions where the filter knows the shingle."""
    near = F.filter(positions(n, size), lambda i: is_set(marks, places(F.get(hashes, i), bits)[0]))
    both = F.filter(near, lambda i: is_set(marks, places(F.get(hashes, i), bits)[1]))
    return F.transform(both, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20, filter_bits: int = FILTER_BITS, row: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, row.

    Contaminated: some word is hit and hit words are at least one in `share`. A null or empty text has no words and hits
    nothing. An item without words has no window; the windows of an item without item_id hit words, but it is in no
    list of items. Texts are read whole, however long. Rows with one doc_id (or none) are judged each for itself; items with one item_id count once. Other
    columns are ignored; an empty table on either side gives no rows, or no hits.
    """
    spark = docs.sparkSession
    with Scratch(spark) as s:
        items = benchmark.select("item_id", F.transform(split_words(F.col("text")), lambda w: F.translate(w, UPPER, LOWER)).alias("words")).where(F.size("words") > 0)
        length = F.least(F.size("words"), F.lit(window))
        starts = F.sequence(F.lit(0), F.size("words") - length)
        items = items.withColumn("len", length).withColumn("win", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, F.col("len")), " "))))
        items = s.save(items.select("item_id", "len", "win").distinct(), "windows")
        wins = items.select("win", "len").distinct().withColumn("size", F.least("len", F.lit(shingle)))
        parts = F.split("win", " ")
        of_window = s.save(
            wins.select("win", "len", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("len") - F.col("size")), lambda i: F.array_join(F.slice(parts, i + 1, F.col("size")), " "))).alias("off", "shingle")),
            "shingles",
        )
        sizes = [x["size"] for x in of_window.select("size").distinct().orderBy("size").collect()]

        base = docs.select(row_number(row).alias("row"), F.col("doc_id"), "text").withColumn("folded", folded_words(F.col("text")))
        n = F.size("folded")
        found = F.array().cast("array<struct<pos:int,size:int>>")
        for size in sizes:
            known = of_window.where(F.col("size") == size).select("shingle").distinct()
            bits = max(filter_bits, min(MOST_BITS, (16 * known.count()).bit_length()))
            marks = bit_filter(known.select(F.xxhash64(*[F.lower(F.get(F.split("shingle", " "), j)) for j in range(size)]).alias("h")), bits)
            base = base.withColumn(f"h{size}", shingle_hashes("folded", size))
            found = F.concat(found, found_of(size, F.col(f"h{size}"), n, marks, bits))
        base = base.select("row", "doc_id", n.cast("long").alias("n_words"), "text", found.alias("found"))
        base = base.withColumn("words", F.when(F.size("found") > 0, split_words(F.col("text"))))
        left = window - 1

        def context(x: Column) -> Column:
            first = F.greatest(x["pos"] - left, F.lit(0))
            text = F.array_join(F.slice("words", first + 1, F.lit(2 * window + shingle)), " ")
            return F.struct(x["pos"].alias("pos"), x["size"].alias("size"), (x["pos"] - first).alias("left"), F.translate(text, UPPER, LOWER).alias("context"))

        rows = s.save(base.select("row", "doc_id", "n_words", F.transform("found", context).alias("found")), "rows")
        near = rows.select("row", "n_words", F.explode("found").alias("x")).select("row", "n_words", "x.*")
        near = near.withColumn("shingle", F.array_join(F.slice(F.split("context", " "), F.col("left") + 1, F.col("size")), " "))
        known = of_window.select("shingle", "size").distinct()
        occurring = s.save(near.join(known, ["shingle", "size"], "left_semi"), "occurring")
        rarity = occurring.groupBy("shingle").agg(F.count("*").alias("n"))
        # a window with a shingle that no document has can't occur
        anchors = of_window.join(rarity, "shingle", "left").groupBy("win", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "off")).alias("a")).where("a.n > 0")
        anchors = anchors.select("win", "len", F.col("a.shingle").alias("shingle"), F.col("a.off").alias("off"))
        at = occurring.join(anchors, "shingle").where((F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("n_words")))
        same = F.array_join(F.slice(F.split("context", " "), F.col("left") - F.col("off") + 1, F.col("len")), " ") == F.col("win")
        hits = s.save(at.where(same).select("row", (F.col("pos") - F.col("off")).alias("start"), "len", "win").distinct(), "hits")

        spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))))
        begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        hit = F.aggregate(spans, begin, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).cast("long").alias("n"), F.greatest(a["end"], x["end"]).alias("end")), lambda a: a["n"])
        by_row = hits.groupBy("row").agg(hit.alias("n_hit"))
        named = hits.select("row", "win").distinct().join(items.where("item_id IS NOT NULL").select("win", F.col("item_id").cast("string").alias("item")), "win")
        named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
        done = rows.select("row", "doc_id", "n_words").join(by_row, "row", "left").join(named, "row", "left")
        n_hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
        done = done.select(
            "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "row",
        )
        return s.keep(done)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (win, n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

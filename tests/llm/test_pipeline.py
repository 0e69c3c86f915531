"""The pipeline: what each stage keeps, on planted rows and on odd ones."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as p
from tripstrata.llm import op1


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    item = " ".join(f"word{i}" for i in range(20))
    text = "the quick brown fox jumps over the lazy dog and runs into the deep green forest to hide from the hunters"
    rows = [(1, text, "en"), (2, text.replace(" ", "  "), "en"), (3, "...", "en"), (4, item, "en"), (5, None, "en"), (6, "der schnelle braune fuchs und der faule hund gehen in den wald", "de"), (7, "le renard brun et le chien vont dans la forêt pour se cacher", "fr")]
    rows += [(100 + i, f"{text} number {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]} once more", "en") for i in range(30)]
    df = docs(*rows)
    kept = p.language_id(spark, df, str(tmp_path))
    assert kept.columns == df.columns and {3, 5}.isdisjoint(r["doc_id"] for r in kept.collect())
    kept = p.exact_dedup(spark, df, str(tmp_path))
    ids = {r["doc_id"] for r in kept.collect()}
    assert 2 in ids and 1 not in ids and kept.columns == df.columns
    near = p.near_dedup(spark, df, str(tmp_path))
    first = {r["component_id"] for r in op1.simhash_components(df).collect()}
    assert {r["doc_id"] for r in near.collect()} == first and near.columns == df.columns
    clean = p.decontaminate(spark, df, str(tmp_path))
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {4}
    assert p.pack(spark, clean, str(tmp_path)).count() == len(rows) - 1


def test_run(spark):
    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns) and p.ORACLE_SQL is None and [k for k, _ in p.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "pack"]


def test_repeated_rows(spark, docs, odd):
    out = p.exact_dedup(spark, docs(*odd), "")
    assert [r["doc_id"] for r in out.collect()].count(4) == 1


def test_other_splits(spark, docs, tmp_path):
    """The rows that a stage drops don't depend on how a later plan cuts the input."""
    word = lambda i: f"word{i} other{i * 7} third{i * 13} last{i * 31}"
    docs(*((i, word(i % 40), "en") for i in range(60))).coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs(*((60 + i, word(20 + i), "en") for i in range(40))).repartition(5).write.mode("append").parquet(str(tmp_path / "docs"))
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {k: spark.conf.get(k) for k in (size, cost)}
    try:
        kept = p.exact_dedup(spark, spark.read.parquet(str(tmp_path / "docs")), "")
        spark.conf.set(size, "3000")
        spark.conf.set(cost, "1")
        assert sorted(r["doc_id"] for r in kept.collect()) == [*range(40), *range(80, 100)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_near_copies(spark, docs):
    """Texts of a 5-word similarity of 0.8 or more are found at any number of differing bits, others stay; a large group too."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(120):
        base = [word() for _ in range(rnd.randint(60, 200))]
        rows.append((1000 * i, " ".join(base)))
        for k in range(40 if i == 0 else 2):
            copy = list(base)
            for _ in range(rnd.choice([1, 2, len(base) // 60 + 1, len(base) // 20])):
                copy[rnd.randrange(len(base))] = word()
            rows.append((1000 * i + 1 + k, " ".join(copy)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    part = {d: d for d in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if a // 1000 == b // 1000 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    first = {min(x for x in part if part[x] == c) for c in part.values()}
    out = [r["doc_id"] for r in p.near_dedup(spark, docs(*rows).repartition(3), "").collect()]
    assert len(first) < len(rows) - 80 and sorted(out) == sorted(first)


def test_shuffled_input_and_clashing_columns(spark, docs):
    """Stages on a shuffle's result, with columns of the names that numbers and keys have here."""
    rows = [(i, f"some words {i % 50} and more of them {i % 50}") for i in range(200)]
    df = docs(*rows).withColumn("__at", F.lit("mine")).withColumn("__AT_", F.col("doc_id")).repartition(7, "doc_id")
    kept = p.exact_dedup(spark, df, "")
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(50)) and {r["__at"] for r in kept.collect()} == {"mine"}
    assert sorted(r["doc_id"] for r in p.near_dedup(spark, kept, "").select("doc_id").collect())[0] == 0

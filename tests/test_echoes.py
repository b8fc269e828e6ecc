"""Echoes in a batch and over fragments."""

import random

from pyspark.sql import functions as F

from marginalia.streaming import echoes as E
from marginalia.streaming import jobs as J

CASES = [
    ("a", "One. Two is here.", "Three. Two  is\there. Four.", "Three."),
    ("b", "甲。乙。", "丙。丁！丙。戊", "丙。丁！"),
    ("c", "x", "new... more?! new. more?!  end", "new... more?! new."),
    ("d", None, "\n\n a. \n\n b.\n a.", "\n\n a. \n\n b.\n"),
    ("e", "tail", "more. tail", "more."),
    ("f", "Same.", "Same. rest", ""),
    ("g", "k", "", ""),
]


def test_echoes_in_a_batch(spark):
    df = spark.createDataFrame(CASES, "id string, context string, text string, wanted string")
    got = {r["id"]: r["g"] for r in df.select("id", E.without_echo(F.col("context"), F.col("text")).alias("g")).collect()}
    assert got == {c[0]: c[3] for c in CASES}
    assert spark.createDataFrame([("c", None)], "c string, t string").select(E.without_echo(F.col("c"), F.col("t"))).first()[0] is None


def test_fragments_cut_anywhere_give_what_the_batch_gives(spark, tmp_path):
    J.with_store(spark)
    rng, rows = random.Random(7), []
    for trial in range(6):
        for name, context, text, _ in CASES:
            cuts = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randint(0, 6)))) if len(text) > 1 else []
            parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            rows += [(f"{name}{trial}", k, p, (context or "") if k == 0 else None, k == len(parts) - 1) for k, p in enumerate(parts)]
    schema = "id string, at long, text string, context string, last boolean"
    first = [r for r in rows if r[1] == 0]
    rest = [r for r in rows if r[1] > 0]
    rng.shuffle(rest)
    for chunk in (first, rest[::2], rest[1::2]):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = E.echoes_cut(stream).writeStream.format("memory").queryName("echoes").option("checkpointLocation", f"file://{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {}
    for r in spark.table("echoes").collect():  # in the order in which it was given
        got[r["id"]] = got.get(r["id"], "") + r["text"]
    assert {k: v for k, v in got.items() if v} == {f"{c[0]}{t}": c[3] for c in CASES for t in range(6) if c[3]}

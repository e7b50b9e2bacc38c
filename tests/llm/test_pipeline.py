"""The pipeline's stages, each against what it says it does."""

from collections import Counter

import pytest
from fixtures import near_classes
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import decontaminate, toxicity
from tidewire.llm.mixing import mix
from tidewire.llm.sharding import jump_shard

SF = "/root/testdata/sf0.01"


def by_id(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]

    clean = stages["toxicity"](spark, docs, SF)
    scored = toxicity.scored(docs, toxicity.learn(docs, labels), ["doc_id"])
    assert clean.columns == docs.columns
    assert by_id(clean) == by_id(scored.filter(F.col("score") < toxicity.THRESHOLD))

    single = stages["near_dedup"](spark, clean, SF)
    assert single.columns == docs.columns
    assert set(by_id(single)) == set(near_classes([(r.doc_id, r.text) for r in clean.collect()]).values())
    assert max(by_id(single).values()) == 1

    safe = stages["decontamination"](spark, single, SF)
    leaks = set(by_id(decontaminate.overlaps(single, spark.read.parquet(f"{SF}/benchmark.parquet"))))
    assert safe.columns == docs.columns
    assert set(by_id(safe)) == set(by_id(single)) - leaks and leaks

    mixed = stages["mixing"](spark, safe, SF)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mix(safe).collect() if r.copies}
    assert by_id(mixed) == copies

    sharded = stages["sharding"](spark, mixed, SF)
    assert by_id(sharded) == copies
    assert sharded.filter(F.col("shard") != jump_shard(F.col("doc_id"), 40)).isEmpty()
    assert sharded.filter((F.col("grown_shard") != F.col("shard")) & (F.col("grown_shard") != 40)).isEmpty()
    assert by_id(corpus_pipeline.run(spark, SF)) == copies


@pytest.mark.parametrize("which", ["odd_dir", "clashing_dir", "empty_dir"])
def test_odd_tables(spark, request, which):
    folder = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == [c for c in docs.columns], name
    out = corpus_pipeline.run(spark, folder)
    assert (out.count() > 0) == (which != "empty_dir")


def test_mix_comes_near_its_targets(spark):
    rows = mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))

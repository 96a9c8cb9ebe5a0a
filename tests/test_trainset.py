from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scribemill.operators import trainset
from scribemill.plans.training import load_training_set, ordered_training_set, pack_folder
from scribemill.sources.writers import write_numbered


def texts(spark, sizes):
    return spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(n))) for i, n in enumerate(sizes)], "k long, text string").repartition(4)


def test_slices_cover_every_token_once(spark):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 5, 15, 16, 17, 40, 100]) for _ in range(200)]
    df = texts(spark, sizes)
    stream = [t for i, n in enumerate(sizes) for t in [f"w{i}_{j}" for j in range(n)] + ["</s>"]]
    blocks = trainset.packed_blocks(df, "k", block_tokens=16).orderBy("block").collect()
    assert [b.block for b in blocks] == list(range(-(-len(stream) // 16)))
    assert [t for b in blocks for t in b.tokens] == stream
    assert all(len(b.tokens) == 16 for b in blocks[:-1])
    slices = trainset.packed_slices(df, "k", block_tokens=16).collect()
    assert sum(s.hi - s.lo for s in slices) == len(stream)
    full = trainset.packed_blocks(df, "k", block_tokens=16, keep_partial=False)
    assert full.count() == len(stream) // 16


def test_tokenizer_is_a_parameter_and_may_be_python(spark):
    @F.pandas_udf("int")
    def chars(s):
        return s.str.len()

    df = texts(spark, [3, 4])
    got = trainset.packed_slices(df, "k", lambda c: chars(c), block_tokens=10)
    assert {tuple(r) for r in got.collect()} == {(0, 0, 0, 10), (1, 0, 10, 15), (1, 1, 0, 5), (2, 1, 5, 15), (3, 1, 15, 20)}


@pytest.mark.parametrize("n, verdict", [(0, "too few"), (12, "too few"), (13, "below the wanted size"), (500, "enough"), (1000, "comfortable"), (10001, "diminishing returns")])
def test_readiness(spark, n, verdict):
    assert tuple(trainset.readiness(spark.range(n)).first()) == (n, verdict)


def test_loading_a_file_and_a_folder(spark, tmp_path):
    line = '{{"instruction": "q{0}", "input": "", "output": "a{0}"}}\n'
    (tmp_path / "00001.jsonl").write_text(line.format(2))
    (tmp_path / "00000.jsonl").write_text(line.format(0) + "\n   \n" + line.format(1))
    (tmp_path / "readme.txt").write_text("not json")
    df, n = load_training_set(spark, str(tmp_path))
    assert n == 3 and df.columns == ["text"]
    assert {r.text for r in df.collect()} == {f"<s>[INST] q{i} [/INST] a{i}</s>" for i in range(3)}
    one, n = load_training_set(spark, str(tmp_path / "00000.jsonl"))
    assert n == 2
    packed = pack_folder(spark, str(tmp_path), block_tokens=4)
    # Six tokens each with the separator: "<s>[INST]", "q", "[/INST]", "a</s>".
    assert {tuple(r) for r in packed.collect()} == {(0, 0, 0, 4), (1, 0, 4, 5), (1, 1, 0, 3), (2, 1, 3, 5), (2, 2, 0, 2), (3, 2, 2, 5)}


def test_a_pair_without_output_fails_the_load(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"instruction": "q"}\n')
    with pytest.raises(PySparkException, match="without output"):
        load_training_set(spark, str(tmp_path))[0].collect()


def test_written_pairs_are_read_back_in_order(spark, tmp_path):
    path = str(tmp_path / "pairs")
    pairs = spark.range(130).select(
        F.col("id").alias("position"), F.concat(F.lit("q"), "id").alias("instruction"), F.lit("").alias("input"), F.lit("a").alias("output")
    )
    write_numbered(pairs.repartition(5), path, per_bucket=10)
    texts, n = load_training_set(spark, path)
    assert n == texts.count() == 130
    got = [r.text for r in ordered_training_set(spark, path).orderBy("position").collect()]
    assert got == [f"<s>[INST] q{i} [/INST] a</s>" for i in range(130)]
    assert pack_folder(spark, path).count() >= 130
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        load_training_set(spark, str(tmp_path / "other"))


def test_blocks_of_one_very_long_text(spark):
    words = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(0, words)], "k long, text string")
    blocks = trainset.packed_blocks(df, "k").orderBy("block").collect()
    assert [t for b in blocks for t in b.tokens] == [*words.split(), "</s>"]


def test_readiness_thresholds_are_arguments(spark):
    df = spark.range(30).toDF("k")
    assert trainset.readiness(df, too_few=30).first().verdict == "too few"
    assert trainset.readiness(df, too_few=1, wanted=5, comfortable=10, diminishing=20).first().verdict == "diminishing returns"

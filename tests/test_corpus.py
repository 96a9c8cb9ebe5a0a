from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scribemill.functions.text import title_matches
from scribemill.operators import corpus
from scribemill.operators.extract import CardListing, TableListing
from scribemill.operators.prefix import dense_index, dense_index_by, order_rows, running_sums
from scribemill.operators.skew import small_enough, spread_join
from scribemill.plans.corpus import Source, build_corpus, numbered


def test_first_title_wins_across_sources(spark):
    rows = [(0, "Remarks by the President", "app"), (1, "REMARKS BY THE PRESIDENT", "wh"),
            (2, "Remarks by the President!", "wh"), (3, "A Different Speech", "wh"), (4, "***", "a"), (5, "!!", "a")]
    df = spark.createDataFrame(rows, "seq long, title string, source string").repartition(5)
    once = corpus.first_per_title(df)
    placed = corpus.numbered_first_per_title(df)
    assert {(r.seq, r.position) for r in placed.collect()} == {(0, 0), (3, 1), (4, 2)}
    assert sorted(r.seq for r in once.collect()) == [0, 3, 4]
    assert sorted(r.seq for r in corpus.first_per_title(once).collect()) == [0, 3, 4]


def test_order_key_sorts_like_its_parts_and_rejects_what_does_not_fit(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(128), rng.randrange(2**35), rng.randrange(2**20)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, b long, c long").withColumn("k", corpus.order_key(F.col("a"), F.col("b"), F.col("c")))
    assert [tuple(r)[:3] for r in df.orderBy("k").collect()] == sorted(rows)
    assert df.agg(F.min("k")).first()[0] >= 0
    bad = spark.createDataFrame([(0, 0, 2**20)], "a int, b long, c long")
    with pytest.raises(PySparkException, match="out of range"):
        bad.select(corpus.order_key(F.col("a"), F.col("b"), F.col("c"))).collect()


def test_sample_has_exactly_n_rows(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").repartition(7)
    picked = {n: {r.k for r in corpus.exact_sample(df, n, 42, "k").collect()} for n in (1, 37, 4999, 5000, 6000)}
    assert [len(s) for s in picked.values()] == [1, 37, 4999, 5000, 5000]
    assert picked[1] < picked[37] < picked[4999]
    assert corpus.exact_sample(df, 0, 42, "k").count() == 5000
    assert corpus.exact_sample(df, -3, 42, "k").count() == 5000
    assert {r.k for r in corpus.exact_sample(df, 37, 43, "k").collect()} != picked[37]
    assert corpus.exact_sample(df.limit(0), 5, 42, "k").count() == 0


def test_both_sample_forms_pick_the_same_rows(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    a = {r.k for r in corpus.exact_sample(df, 200, 5, "k").collect()}
    assert a == {r.k for r in corpus.exact_sample(df, 200, 5, "k").collect()}


def test_ordered_rows_of_any_width(spark):
    rng = random.Random(8)
    wide = [None, -(2**63), -1, 0, 127, 128, 2**35, 2**63 - 1]
    rows = [(f"s{rank:04d}", rng.choice(wide), row) for rank in range(300) for row in rng.sample([*wide[1:], None], 5)]
    df = spark.createDataFrame(rows, "a string, b long, c long").repartition(7)
    ordered = order_rows(df, ["a", "b", "c"], "k")
    known = lambda v: (v is not None, v or 0)
    got = [tuple(r) for r in sorted(ordered.collect(), key=lambda r: r.k)]
    assert len({r[3] for r in got}) == len(rows)
    assert [r[:3] for r in got] == sorted(rows, key=lambda r: (r[0], known(r[1]), known(r[2])))
    placed = {r.k: r.position for r in dense_index(ordered, "k").collect()}
    assert [placed[r[3]] for r in got] == list(range(len(rows)))
    assert order_rows(df.limit(0), ["a", "b"], "k").count() == 0


@pytest.mark.parametrize("key_bits", [45, 63])
def test_running_sums_over_sparse_keys_and_partitions(spark, key_bits):
    rng = random.Random(2)
    keys = rng.sample(range(2 ** (key_bits - 1)), 400) + list(range(400))
    rows = [("hot" if i % 3 else f"p{i % 5}", k, rng.randrange(10)) for i, k in enumerate(dict.fromkeys(keys))]
    df = spark.createDataFrame(rows, "p string, k long, v long").repartition(6)
    got = running_sums(df, "k", {"before": F.col("v"), "pos": F.lit(1)}, partition=["p"], totals={"all": "before"}, key_bits=key_bits)
    expected = set()
    for p in {r[0] for r in rows}:
        total = sum(v for q, _, v in rows if q == p)
        before = 0
        for pos, (k, v) in enumerate(sorted((k, v) for q, k, v in rows if q == p)):
            expected.add((p, k, v, before, pos, total))
            before += v
    assert {tuple(r) for r in got.collect()} == expected


def test_dense_positions(spark):
    df = spark.createDataFrame([(k,) for k in (5, 900_000, 7, 2**40, 8191, 8192)], "k long")
    assert {(r.k, r.position) for r in dense_index(df, "k").collect()} == {
        (5, 0), (7, 1), (8191, 2), (8192, 3), (900_000, 4), (2**40, 5)
    }
    words = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("w"), "id").repartition(9)
    placed = dense_index_by(words, ["w"]).orderBy("position").collect()
    assert [r.w for r in placed] == sorted(r.w for r in placed)
    assert [r.position for r in placed] == list(range(2000))


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_join(spark, how, no_broadcast):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("k"), "id")
    right = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = sorted(map(tuple, left.join(right, ["k"], how).select("k", "id", "v").collect()), key=str)
    spread = spread_join(left, right, ["k"], how, spread_by="id", hot_rows=200, salts=8)
    assert sorted(map(tuple, spread.select("k", "id", "v").collect()), key=str) == plain
    assert not small_enough(right)


def test_only_small_tables_are_broadcast(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "small"))
    spark.range(3_000_000).select("id", F.rand(1).alias("r")).write.parquet(str(tmp_path / "large"))
    small, large = (spark.read.parquet(str(tmp_path / n)) for n in ("small", "large"))
    assert small_enough(small) and not small_enough(large)
    assert not small_enough(large.where("r < 0.1").groupBy("id").count())


def test_the_smaller_side_is_broadcast(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 10).alias("k"), "id").write.parquet(str(tmp_path / "left"))
    spark.range(2_000_000).select(F.col("id").alias("k"), F.rand(1).alias("v")).write.parquet(str(tmp_path / "right"))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in ("left", "right"))
    joined = spread_join(left, right, ["k"], spread_by="id")
    assert joined.count() == 1000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" in plan and "SortMergeJoin" not in plan
    outer = spread_join(left, right, ["k"], "left", spread_by="id")
    assert outer.count() == 1000 and "SortMergeJoin" in outer._jdf.queryExecution().executedPlan().toString()


def test_lookup_keeps_duplicates_and_loses_missing_pages(spark):
    index = spark.createDataFrame([(0, "u1"), (1, "u1"), (2, "u2"), (3, "u9")], "seq long, url string")
    texts = spark.createDataFrame([("u1", "one"), ("u2", "two")], "url string, text string")
    assert {tuple(r) for r in corpus.attach_text(index, texts).select("seq", "text").collect()} == {(0, "one"), (1, "one"), (2, "two")}
    pages = spark.createDataFrame([(4, "u1"), (2, "u1"), (3, "u2")], "page_id long, url string")
    assert {tuple(r) for r in corpus.first_captures(pages).collect()} == {("u1", 2), ("u2", 3)}


def test_report_caps_titles(spark):
    df = spark.createDataFrame([(0, 2, "t" * 80, ["x"]), (1, 2, None, None)], "position long, total long, title string, pairs array<string>")
    assert [tuple(r) for r in corpus.document_report(df).orderBy("position").collect()] == [(1, 2, 1, "t" * 60), (2, 2, 0, "")]


def test_corpus_build_follows_the_stages(spark):
    long = "word " * 60
    row = lambda n, title: f"<tr><td>May {n}</td><td>p</td><td><a href='/d/{n}'>{title}</a></td></tr>"
    table = "<table class='views-table x'><tbody>{}</tbody></table>"
    first = spark.createDataFrame(
        [(0, table.format(row(1, "One") + row(2, "Two") + row(3, "Short"))), (1, table.format(row(4, "one!"))),
         (2, table.format("")), (3, table.format(row(5, "After the stop")))], "page_no long, html string")
    card = lambda n, title: f"<div class='views-row'><h3><a href='/d/{n}'>{title}</a></h3><time>June</time></div>"
    second = spark.createDataFrame([(0, card(6, "The ONE") + card(7, "the two") + card(8, "Other") + card(9, "the lost"))], "page_no long, html string")
    body = lambda n, t: (n, f"https://a.example/d/{n}", f"<div class='b'>{t}</div>")
    articles = spark.createDataFrame(
        [body(n, f"{n} {long}") for n in (1, 2, 4, 5, 6, 7, 8)] + [body(3, "Very short.")] + [(99, "https://a.example/d/1", f"<div class='b'>later {long}</div>")],
        "page_id long, url string, html string")
    result = build_corpus([
        Source("a", first, TableListing("https://a.example", "table.views-table tbody tr"), "div.b"),
        Source("b", second, CardListing("https://a.example", "div.views-row", "h3 a", "time"), "div.x, div.b", lambda t: title_matches(t, ["the "])),
    ], articles)
    rows = [(r.position, r.title, r.date, r.source) for r in numbered(result).orderBy("position").collect()]
    assert rows == [(0, "One", "May 1", "a"), (1, "Two", "May 2", "a"), (2, "The ONE", "June", "b"), (3, "the two", "June", "b")]
    assert {tuple(r) for r in result.counts.collect()} == {("a", 4, 0), ("b", 4, 1)}
    assert tuple(result.totals.first()) == (5, 4)
    assert result.unique.where("title = 'One'").first().text.startswith("1 word")


def test_samples_by_the_smallest_and_by_counting_are_the_same(spark):
    df = spark.range(3000).withColumnRenamed("id", "k").repartition(5)
    for n in (1, 200, 2999, 3000, 4000):
        one, two = ({r.k for r in corpus.exact_sample(df, n, 5, "k", top_rows=top).collect()} for top in (10_000, 0))
        assert one == two and len(one) == min(n, 3000)


@pytest.mark.parametrize("top_rows", [10_000, 0])
def test_sample_keys_must_be_known_and_unique(spark, top_rows):
    df = spark.range(100).withColumnRenamed("id", "k")
    with pytest.raises(Exception, match="is null"):
        corpus.exact_sample(df.unionByName(spark.createDataFrame([(None,)], "k long")), 5, 1, "k", top_rows=top_rows).collect()
    same = spark.createDataFrame([(1,)] * 9, "k long")
    with pytest.raises(Exception, match="not unique"):
        corpus.exact_sample(same, 5, 1, "k", top_rows=top_rows).collect()


def test_a_long_list_of_wanted_pages_filters_the_html_where_it_is_read(spark, tmp_path):
    from scribemill.plans.corpus import wanted_pages

    spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 30).alias("html")).write.parquet(f"{tmp_path}/pages")
    spark.range(200).select((F.col("id") * 19).alias("page_id"), F.array(F.lit("a")).alias("wanted")).write.parquet(f"{tmp_path}/wanted")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = wanted_pages(spark.read.parquet(f"{tmp_path}/pages"), spark.read.parquet(f"{tmp_path}/wanted"))
        assert df.count() == 200
        assert "might_contain" in df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)

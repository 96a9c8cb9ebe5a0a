"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scribemill.llm import bpe_automaton, chat, fingerprints, licenses, mixing, neardup, quality, secrets, sharding, token_counts
from scribemill.llm.components import component_labels
from scribemill.llm.vocabulary import read_vocabulary
from tests.llm.conftest import PROSE, prose, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_quality(awkward, nothing, awkward_rows):
    rows = quality.quality_rules(awkward, prefix="q_").collect()
    assert len(rows) == len(awkward_rows)
    for r in rows:
        words = (r.text or "").split()
        assert r.kept == "x"
        assert r.q_base_failed == (r.q_n_words < 50 or 100 * r.q_n_repeat_words > 50 * r.q_n_words)
        if r.text is None:
            assert r.q_clean_text is None and r.q_n_words == 0 and not r.q_kept
        elif " " not in r.text:
            assert (r.q_n_words, r.q_word_chars) == (len(words), sum(map(len, words)))
    assert quality.quality_rules(nothing).count() == 0
    assert quality.quality_rules(awkward).where("kept").count() == 9


def test_quality_lines(spark):
    menu = "Home | About | Contact"
    text = "\n".join([PROSE * 4, menu, "Read more about it here.", "$$$ ### %%% &&& ***."])
    row = quality.quality_rules(table(spark, [(1, text, "en", "a"), (2, "\n".join([menu] * 30), "en", "a")])).orderBy("doc_id").collect()
    assert row[0].clean_text == PROSE * 4
    assert row[0].n_lines_removed == 3
    assert not row[1].kept


def test_repeated_windows_with_one_hash(spark, monkeypatch):
    """The exact count takes over when windows of different words meet under one hash."""
    texts = ["a b c d a b c e f g", "a a a a", "x y z", "p q r s t u v p q r s t u v w"]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    plain = [r.n_repeat_words for r in quality.quality_rules(docs).orderBy("doc_id").collect()]
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.length(F.concat(*c)).cast("long") % 2)
    assert [r.n_repeat_words for r in quality.quality_rules(docs).orderBy("doc_id").collect()] == plain == [6, 4, 0, 14]


def test_sharding(spark, awkward, nothing, awkward_rows):
    rows = sharding.shard_by_bytes(awkward, shards=4, range_rows=2).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len((t or "").encode()) + 16) for i, t, _, _ in awkward_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(nothing).count() == 0
    # One group of equal texts holds nearly all rows and still spreads evenly.
    hot = table(spark, [(i, "same text" if i % 10 else prose(i, 5), "en", "a") for i in range(2000)])
    sizes, n = Counter(), Counter()
    for r in sharding.shard_by_bytes(hot, shards=10, tolerance=0.01).collect():
        sizes[r.shard] += r.size
        n[r.shard] += 1
    assert len(sizes) == 10
    assert max(sizes.values()) - min(sizes.values()) <= 0.03 * sum(sizes.values()) / 10 + 60


def test_encoding(spark, awkward, nothing, awkward_rows):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t, _, _ in awkward_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe_automaton.encode_documents(awkward, WORDS).collect()) == want
    assert bpe_automaton.encode_documents(nothing, WORDS).count() == 0
    automaton = bpe_automaton.broadcast_automaton(spark, WORDS)
    ids = awkward.select("text", bpe_automaton.encoded_ids(F.col("text"), automaton).alias("ids"))
    for r in ids.withColumn("back", bpe_automaton.decoded_text(F.col("ids"), automaton)).collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.back == library.decode(r.ids, skip_special_tokens=False)


def test_automaton_accepts_only_what_merging_gives():
    """On a small vocabulary: of all token sequences for a word, exactly the merged one has all its arcs."""
    import itertools

    from scribemill.llm.vocabulary import Vocabulary

    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "ba"), ("b", "b"), ("aba", "b")]
    names = ["a", "b", *["".join(m) for m in merges]]
    automaton = bpe_automaton.TokenAutomaton(Vocabulary({t: i for i, t in enumerate(names)}, merges, {}, ""))

    def merged(word):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return parts

    for n in range(1, 9):
        for letters in itertools.product("ab", repeat=n):
            word = "".join(letters)
            assert [names[i] for i in automaton.tokens(word)] == merged(word), word


def test_token_counts(awkward, nothing, awkward_rows):
    library = Tokenizer.from_file(BYTES)
    got = Counter(tuple(r) for r in token_counts.count_tokens(awkward, BYTES).collect())
    want = Counter()
    for i, t, _, _ in awkward_rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want
    assert token_counts.count_tokens(nothing, BYTES).count() == 0
    assert read_vocabulary(BYTES).word_end == ""


def test_mixing(spark, awkward, nothing, awkward_rows):
    rows = mixing.mix_sources(awkward).collect()
    assert len(rows) == len(awkward_rows)
    total, by_source = sum(r["size"] for r in rows), defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by_source[r.source].append(r)
    targets = {s: x[0].target for s, x in by_source.items()}
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    assert all(t <= 3 * by_source[s][0].source_size + 1e-6 for s, t in targets.items())
    for s, x in by_source.items():
        assert abs(sum(r.taken for r in x) - targets[s]) <= max(r["size"] for r in x)
    assert mixing.mix_sources(nothing).count() == 0
    again = mixing.mix_sources(awkward.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_near_duplicates(spark, awkward, nothing):
    rows = neardup.near_duplicates(awkward).collect()
    assert len(rows) == 18
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert {by_id[i][0].component_id for i in (6, 7, 8, 9)} == {6}
    assert [r.kept for r in by_id[9]] == [False, False]
    assert all(by_id[i][0].kept and by_id[i][0].n_shingles == n for i, n in ((1, 0), (2, 0), (3, 0), (4, 1), (10, 1)))
    assert sorted((r.component_id is None, r.kept) for r in by_id[None]) == [(False, False), (True, True)]
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_duplicates_in_tiles(spark, monkeypatch):
    """A group far larger than a block: all members meet, wherever they fall."""
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 8)
    base = prose(1, 200).split(" ")
    docs = []
    for i in range(60):
        words = list(base)
        words[(i * 3) % 190] = f"new{i}"
        docs.append((i, " ".join(words), "en", "a"))
    docs += [(100 + i, " ".join(base[: 100 - i] + prose(50 + i, 100).split(" ")), "en", "a") for i in range(5)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, docs)).collect()}
    assert {got[i] for i in range(60)} == {0}
    assert all(got[i] == i for i in range(100, 105))


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in component_labels(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_fingerprints(spark, awkward, nothing, awkward_rows):
    rows = fingerprints.fingerprints(awkward).collect()
    ordered = sorted(((i if i is not None else -(2**63), t or "", i) for i, t, _, _ in awkward_rows), key=lambda r: r[:2])
    want = Counter()
    for (_, t, i), (_, following, _) in zip(ordered, [*ordered[1:], ordered[0]]):
        new = fingerprints.edited(t, following)
        want[i, len(t), hashlib.sha256(new.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    by_text = {}
    for r, t in ((r, t) for r in rows for i, t, _, _ in awkward_rows if r.doc_id == i and i in (6, 7, 9)):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.fingerprints(nothing).count() == 0
    alone = fingerprints.fingerprints(table(spark, [(7, "abcd efgh", "en", "a")])).collect()[0]
    assert alone.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest() and alone.near_next == 1.0


def test_lexicon_counts_all_documents(spark):
    docs = table(spark, [(i, f"common rare{i // 2} only{i}", "en", "a") for i in range(40)]).repartition(5)
    counts = {r.place: r.n for r in fingerprints.term_counts(docs.select("text")).collect()}
    place = lambda t: fingerprints.term_hash(t) & fingerprints.PLACE
    assert (counts[-1], counts[place("common")], counts[place("rare3")], counts[place("only7")]) == (40, 40, 2, 1)
    inside = fingerprints.lexicon_bits(docs.select("text"), 2, 0.5)
    assert [inside[place(t)] for t in ("common", "rare3", "only7")] == [0, 1, 0]


def test_chats(spark):
    schema = "conv_id long, turn long, role string, text string, id string, at string, n_turns string"
    rows = []
    for conv, texts in ((1, "ab"), (2, "abc"), (3, "abc"), (4, "b"), (5, "abd"), (None, "zz"), (7, "a")):
        rows += [(conv, k, "user", t, "x", "x", "x") for k, t in enumerate(texts)]
    rows += [(8, None, None, None, "x", "x", "x"), (9, 0, "user", "", "x", "x", "x"), (9, 0, "user", "", "x", "x", "x")]
    rows += [(10, k, "user", f"turn {k}", "x", "x", "x") for k in range(3000)] + [(11, k, "user", f"turn {k}", "x", "x", "x") for k in range(2999)]
    df = spark.createDataFrame(rows, schema).repartition(4)
    got = defaultdict(dict)
    for r in chat.format_chats(df).collect():
        got[r.conv_id][r.part] = (r.n_turns, r.rendered)
    assert set(got) == {2, 4, 5, None, 8, 9, 10}
    assert got[2] == {0: (3, "".join(f"<|user|>\n{t}<|end|>\n" for t in "abc"))}
    assert got[8][0] == (1, "<||>\n<|end|>\n") and got[9][0][0] == 1
    assert "".join(got[10][p][1] for p in range(47)) == "".join(f"<|user|>\nturn {k}<|end|>\n" for k in range(3000))
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_chats_spread_rows_without_id_or_number(spark):
    texts = [f"{(i * 7919) % 20011:05d} " + "long " * (20_000 if i == 5 else 1) for i in range(12_000)]
    rows = [(None, None, "user", t) for t in texts] + [(k, 0, "user", texts[k]) for k in range(300)] + [(None, 3, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would become one task
    try:
        ordered = chat.sorted_turns(df, "conv_id", "turn", "role", "text")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    nobody = ordered.where(F.col("id") == chat.NO_ID)
    assert nobody.select(F.shiftright("row", 33)).distinct().count() > 1
    assert ordered.groupBy("id", "block").count().agg(F.max("count")).first()[0] <= chat.BUCKET_TURNS
    placed = chat.placed_turns(ordered, chat.block_shifts(ordered)).where(F.col("id") == chat.NO_ID)
    assert [r.text for r in sorted(placed.select("at", "text").collect())] == [None, *sorted(texts)]
    assert sorted(r.at for r in placed.select("at").collect()) == list(range(1, 12_002))
    got = {(r.conv_id, r.part): r for r in chat.format_chats(df).collect()}
    assert len(got) == 188 + 300 and {r.n_turns for r in got.values()} == {1, 12_001}
    whole = "".join(got[None, part].rendered for part in range(188))
    assert whole == "".join(f"<|user|>\n{t}<|end|>\n" for t in ["", *sorted(texts)])


def test_licenses(spark, awkward, nothing):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 500)
    changed = "Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-licence").replace(",", " ;").upper() + "\n"
    docs = table(spark, [(1, changed, "en", "a"), (2, "Some text.\nReleased under the MIT License\nMore.", "en", "a"), (3, mit + " And more.", "en", "a"), (4, None, "en", "a")])
    got = {r.doc_id: (r.license, r.line_licenses, r.n_license_lines) for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: ("MIT", "", 0), 2: (None, "MIT", 1), 3: (None, "", 0), 4: (None, "", 0)}
    assert licenses.scan_licenses(awkward).count() == 18
    assert licenses.scan_licenses(nothing).count() == 0


@pytest.fixture(scope="module")
def forest(spark):
    labelled = secrets.labelled_findings(spark)
    return secrets.train_forest(labelled.where("id % 5 < 4")), labelled.where("id % 5 = 4")


def test_forest_on_held_out_findings(forest):
    model, held_out = forest
    scored = secrets.score(held_out, model).select("label", "score").collect()
    right = sum((r.score >= secrets.THRESHOLD) == (r.label == 1.0) for r in scored)
    assert len(scored) == 1200 and right >= 0.97 * len(scored)


def test_secrets(spark, awkward, nothing):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    docs = table(spark, [
        (1, f'Before token = "{key}" after, see https://www.example.com/index/page2024 now.', "en", "a"),
        (1, "same id", "en", "a"),
        (2, f"commit {key} was merged", "en", "a"),
        (None, f'api_key: "{key}"', "en", None),
        (3, None, "en", "a"),
        (4, f'token = "{key}" and again token = "{key}"', "en", "a"),
    ])
    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert got[1].secrets == got[None].secrets == got[4].secrets == [key]
    assert got[2].n_secrets == 0 and got[2].n_candidates == 1
    masked = secrets.redact_documents(docs)
    assert masked.columns == docs.columns
    texts = [r.text for r in masked.orderBy("doc_id", "text").collect()]
    assert len(texts) == 6 and sum(t is not None and key in t for t in texts) == 1
    assert secrets.scan_secrets(awkward).where("n_secrets > 0").count() == 0
    assert secrets.redact_documents(nothing).count() == 0


def test_pipeline_stages(spark, awkward, nothing):
    for start in (awkward, nothing):
        docs, ids = start, {}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "").cache()
            assert docs.columns == start.columns, name
            ids[name] = Counter(r.doc_id for r in docs.collect())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
        if start is awkward:
            assert ids["quality_rules"] == Counter([5, 6, 7, 8, 9, 9, None, -5, 2**62])
            # A row without an id is never taken out as a copy.
            assert ids["minhash_near_dedup"] == ids["secret_scans"] == Counter([5, 6, None, -5, 2**62])
            assert set(ids["mixing_sources"]) <= set(ids["secret_scans"])


@pytest.mark.parametrize("symbols", [0, 1])
def test_mix_buckets_stay_even_for_any_weight(spark, symbols):
    key = -F.log(mixing.uniform(F.col("id"))) / mixing.quality_weight(F.lit("# " * symbols + "w"), F.lit(1))
    even = F.lit(1.0) - F.exp(-key * mixing.LEAST_WEIGHT)
    counts = spark.range(200_000).groupBy(F.floor(even * 100)).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert counts[0] <= 2.2 * 2_000 and counts[1] == 100


def test_mix_adds_up_buckets_on_two_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    monkeypatch.setattr(mixing, "FAN", 7)
    docs = table(spark, [(i, "# " * (i % 3) + "word " * (1 + i % 9), "en", "ab"[i % 5 == 0]) for i in range(4_000)])
    taken = {tuple(r) for r in mixing.mix_sources(docs).collect()}
    monkeypatch.undo()
    assert taken == {tuple(r) for r in mixing.mix_sources(docs).collect()}
    for source in "ab":
        of = [r for r in spark.createDataFrame(sorted(taken), mixing.mix_sources(docs).schema).where(F.col("source") == source).collect()]
        assert abs(sum(r.taken for r in of) - of[0].target) <= max(r["size"] for r in of)


def test_masking_leaves_columns_of_any_name(spark):
    text = 'token = "' + "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" + '"'
    rows = [(1, text, "mine", 7), (2, "nothing here", None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __secrets string, __id long")
    out = secrets.redact_documents(df, path=None)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1]["__secrets"], got[1]["__id"], got[2].text) == ("mine", 7, "nothing here")
    assert got[1].text == f'token = "{secrets.MASK}"'

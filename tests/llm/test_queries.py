"""Registered queries: against their SQL, or against brute force over the whole small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from scribemill.llm.catalog import ORACLES, QUERIES
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").orderBy("doc_id").collect()


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_points.queries())
    assert "pipeline" in entry_points.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    same, message = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert same, message


def test_shards(spark, sf_dir, docs):
    rows = QUERIES["op2_histogram_shards"](spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in docs)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(sizes.values()), max(r.size for r in rows)
    # A border lies within half a document of its target.
    assert all(abs(sizes[s] - total / 40) <= largest + 0.01 * total / 40 for s in range(40))


def test_encoding_and_counts_match_the_library(spark, sf_dir, docs):
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = {r.doc_id: r for r in QUERIES["op3_bpe_automaton"](spark, sf_dir).collect()}
    counts = {r.doc_id: r for r in QUERIES["op10_token_counts"](spark, sf_dir).collect()}
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in docs:
        ids = words.encode(d.text, add_special_tokens=False).ids
        decoded = words.decode(ids, skip_special_tokens=False)
        got = own[d.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        n = len(plain.encode(d.text, add_special_tokens=False).ids)
        assert (counts[d.doc_id].n_tokens, counts[d.doc_id].n_bytes, counts[d.doc_id].over_limit) == (n, len(d.text.encode()), n > 512)


def word_sets(text, words):
    """Distinct shingles of a text by plain Python; ASCII letters lower-cased, ASCII white space between words."""
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute_components(docs, words=2):
    sets = {d.doc_id: word_sets(d.text, words) for d in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(spark, sf_dir, docs):
    want = brute_components(docs)
    got = {r.doc_id: r for r in QUERIES["op5_tensored_minhash"](spark, sf_dir).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_fingerprints(spark, sf_dir, docs):
    got = {r.doc_id: r for r in QUERIES["op7_imatch_fingerprints"](spark, sf_dir).collect()}
    by_text = defaultdict(set)
    nearer = 0
    for d, following in zip(docs, [*docs[1:], docs[0]]):
        r, half = got[d.doc_id], len(d.text) // 2
        new = d.text[: len(d.text) - half] + following.text[:half]
        assert (r.n_chars, r.edited_sha256) == (len(d.text), hashlib.sha256(new.encode()).hexdigest())
        by_text[d.text].add(r.fingerprint)
        nearer += r.near_edited > r.near_next
    assert all(len(f) == 1 for f in by_text.values())
    assert nearer > 0.8 * len(docs)


def test_secrets(spark, sf_dir, docs):
    got = {r.doc_id: r for r in QUERIES["op9_secret_forest"](spark, sf_dir).collect()}
    planted = {d.doc_id: sorted(set(re.findall(r'(?i)token = "([0-9a-f]{40})"', d.text))) for d in docs}
    for i, values in planted.items():
        assert got[i].n_secrets == len(values)
        assert got[i].secrets_sha256 == (hashlib.sha256("\n".join(values).encode()).hexdigest() if values else None)


def test_pipeline(spark, sf_dir, docs):
    """Stage by stage against plain Python; every stage is judged on what the one before left."""
    import corpus_pipeline as p
    from scribemill.llm.quality import quality_rules

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    verdict = {r.doc_id: r for r in quality_rules(table).collect()}
    (_, quality), (_, dedup), (_, secrets), (_, mixing), (_, encoding) = p.STAGES
    one = quality(spark, table, sf_dir).cache()
    assert one.columns == table.columns
    assert {r.doc_id: r.text for r in one.collect()} == {i: r.clean_text for i, r in verdict.items() if r.kept}
    two = dedup(spark, one, sf_dir).cache()
    assert {r.doc_id for r in two.collect()} == {i for i, (_, c) in brute_components(one.collect(), 5).items() if i == c}
    three = secrets(spark, two, sf_dir).cache()
    before = {r.doc_id: r for r in two.collect()}
    for r in three.collect():
        masked = re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1<SECRET>"', before[r.doc_id].text)
        assert (r.text, r.n_chars, r.source) == (masked, len(masked), before[r.doc_id].source)
    four = mixing(spark, three, sf_dir).cache()
    taken, sizes = Counter(), Counter()
    for r in four.collect():
        taken[r.source] += len(r.text.split())
    for r in three.collect():
        sizes[r.source] += len(r.text.split())
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    targets, open_ = {}, dict(weights)
    while True:
        left = sum(sizes.values()) - sum(targets.values())
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            targets[s] = 3 * sizes[s]
            del open_[s]
    targets |= share
    largest = max(len(r.text.split()) for r in three.collect())
    assert all(abs(taken[s] - targets[s]) <= largest for s in sizes)
    five = encoding(spark, four, sf_dir)
    assert five.count() == four.count()
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}

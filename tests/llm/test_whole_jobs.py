"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from scribemill.llm import fingerprints, secrets
from tests.llm.conftest import PROSE, prose, table


def test_lexicon_tells_terms_apart_that_share_low_bits(spark):
    """A term of one document stays out, and a rare one in, whatever other term has the same last 22 bits."""
    seen, pairs = {}, []
    for i in range(20_000):
        term, low = f"term{i}", fingerprints.term_hash(f"term{i}") & (2**22 - 1)
        if low in seen:
            pairs.append((seen.pop(low), term))
        else:
            seen[low] = term
    (single, other), (rare, frequent) = pairs[:2]
    texts = [single, other] + [f"{rare} {frequent}"] * 2 + [frequent] * 36
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).repartition(5)
    inside = fingerprints.lexicon_bits(docs.select("text"), 2, 0.5)
    place = lambda t: fingerprints.term_hash(t) & fingerprints.PLACE
    assert [inside[place(t)] for t in (single, other, rare, frequent)] == [0, 0, 1, 0]


def test_counts_in_several_rounds(spark, monkeypatch):
    docs = table(spark, [(i, f"common rare{i // 2}", "en", "a") for i in range(40)]).coalesce(1)
    whole = {r.place: r.n for r in fingerprints.term_counts(docs.select("text")).collect()}
    monkeypatch.setattr(fingerprints, "COUNTED_TERMS", 5)
    assert {r.place: r.n for r in fingerprints.term_counts(docs.select("text")).collect()} == whole
    assert sorted(whole.values()) == [2] * 20 + [40, 40]


def test_texts_without_terms_in_the_band_have_their_own_fingerprints():
    """More texts than 16 bits can tell apart; two of them share next to no cell."""
    maker = fingerprints.Fingerprinter(fingerprints.Lexicon(np.empty(0, dtype=np.int64)))
    made = [maker.of(f"Text number {i}.") for i in range(70_000)]
    assert {len(f) for f in made} == {4 * fingerprints.DRAWS * fingerprints.RATES}
    assert len(set(made)) == len(made)
    assert maker.of("Text number 5.") == made[5]
    assert max(fingerprints.likeness(a, b) for a, b in zip(made[:2000], made[1:])) < 0.1


def test_unquoted_assignments(spark):
    """The value of NAME=value is judged and masked without its name; padding stays part of a value."""
    key, padded = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "q83vEjRWeJq7zN3u/wARIg=="
    texts = [f"password={key}", f"# settings\nAPI_TOKEN={key}\nDEBUG=1", f"GET /v1/list?page=2&access_key={key} was sent", f"secret_key={padded} set"]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    found = {r.id: r for r in secrets.candidates(docs, "doc_id", "text", None).where("value like '9f%' or value like 'q8%'").collect()}
    assert [found[i].value for i in range(4)] == [key, key, key, padded]
    assert found[0].left == "password=" and found[1].left.endswith("API_TOKEN=")
    masked = [r.text for r in secrets.redact_documents(docs).orderBy("doc_id").collect()]
    assert masked == [t.replace(key, "<SECRET>").replace(padded, "<SECRET>") for t in texts]


def test_values_are_judged_at_every_place(spark):
    """A value shown first in a harmless place, or inside a longer run, and later as a token is a secret."""
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    later = f'The value is set as token = "{key}" here.'
    texts = [f"commit {key} was merged. {later}", f"see build/{key}/log.txt of the day. {later}", f"commit {key} was merged and commit {key} was not"]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert [got[i].secrets for i in range(3)] == [[key], [key], []]
    assert [got[i].n_candidates for i in range(3)] == [1, 2, 1]
    for r in secrets.candidates(docs, "doc_id", "text", None).collect():
        assert r.left + r.value + r.right in texts[r.id]
        assert len(r.left) == 32 or texts[r.id].startswith(r.left + r.value)
    close = " ".join(f"a{i}bcdefghijklmno" for i in range(5))
    for r in secrets.candidates(table(spark, [(1, close, "en", "a")]), "doc_id", "text", None).collect():
        at = close.index(r.value)
        assert (r.left, r.right) == (close[max(0, at - 32) : at], close[at + 16 : at + 48])


def test_pipeline_keeps_long_lines_with_a_phrase(spark):
    """A clean document in one line that names a phrase once stays whole; a short line of furniture goes."""
    long = prose(4, 80) + " The minister asked for a privacy policy and everyone could read more. " + prose(6, 80)
    docs = table(spark, [(1, long, "en", "a"), (2, PROSE + prose(8, 80) + "\nRead more about it here.", "en", "a")])
    got = {r.doc_id: r.text for r in corpus_pipeline.quality_stage(spark, docs, "").collect()}
    assert got == {1: long, 2: PROSE + prose(8, 80)}


def test_pipeline_stage_takes_longer_shingles(spark):
    """Two texts that are near copies by two words, not by five."""
    words = prose(3, 300).split(" ")
    changed = [f"other{i}" if i % 20 == 7 else w for i, w in enumerate(words)]
    docs = table(spark, [(1, " ".join(words), "en", "a"), (2, " ".join(changed), "en", "a")])
    left = lambda **n: sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "", **n).collect())
    assert (left(shingle_words=2), left()) == ([1], [1, 2])


def test_pipeline_keeps_rows_of_one_id_with_different_texts(spark):
    texts = [(1, prose(3, 200)), (1, prose(40, 200)), (2, prose(77, 200)), (2, prose(3, 200)), (3, prose(40, 200)), (3, prose(40, 200)), (None, prose(3, 200))]
    docs = table(spark, [(i, t, "en", "a") for i, t in texts]).repartition(3)
    left = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.text) for r in left), key=str) == sorted(
        [(False, 1, prose(3, 200)), (False, 1, prose(40, 200)), (False, 2, prose(77, 200)), (True, None, prose(3, 200))], key=str
    )


def test_pipeline_mixes_rows_without_an_id_by_their_own_count(spark):
    rows = [(None if i % 2 else i // 10, prose(i, 20 + i), "en", "a" if i < 20 else "b") for i in range(60)]
    docs = table(spark, rows)
    taken, sizes = {"a": 0, "b": 0}, {"a": 0, "b": 0}
    for r in corpus_pipeline.mixing_stage(spark, docs, "").collect():
        taken[r.source] += len(r.text.split())
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    first = min(3 * sizes["a"], sum(sizes.values()) * 5 / 7)
    want = {"a": first, "b": sum(sizes.values()) - first}
    assert all(abs(taken[s] - want[s]) <= 80 for s in want)


def test_broadcast_objects_need_no_package_on_workers(spark):
    """What is broadcast loads in a process that cannot import this library."""
    import pickle
    import subprocess
    import sys

    import public_tokenizers

    from scribemill.llm.bpe_automaton import TokenAutomaton
    from scribemill.llm.common import ByValue
    from scribemill.llm.token_counts import MergeCounter
    from scribemill.llm.vocabulary import read_vocabulary

    code = (
        "import sys, pickle; sys.modules['scribemill'] = None; own = pickle.load(sys.stdin.buffer);"
        "print(own.text('some words here') if hasattr(own, 'text') else len(own.cells('some words here')) if hasattr(own, 'cells') else type(own).__name__)"
    )
    made = [
        (MergeCounter(read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))), "3"),
        (fingerprints.Fingerprinter(fingerprints.Lexicon(np.arange(5, dtype=np.int64))), str(fingerprints.DRAWS * fingerprints.RATES)),
        (TokenAutomaton(read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))), "TokenAutomaton"),
    ]
    for value, want in made:
        run = subprocess.run([sys.executable, "-c", code], input=pickle.dumps(ByValue(value)), capture_output=True, cwd="/", env={"PATH": "/usr/bin"}, timeout=60)
        assert run.stdout.decode().strip() == want, run.stderr.decode()[-500:]


def test_lexicon_edge_grows_with_the_corpus(spark):
    docs = table(spark, [(i, f"common rare{i // 2} some{i // 10}", "en", "a") for i in range(40)])
    place = lambda t: fingerprints.term_hash(t) & fingerprints.PLACE
    for share, want in ((1e-4, [1, 1, 0]), (0.1, [0, 1, 0]), (0.3, [0, 0, 0])):
        inside = fingerprints.lexicon_bits(docs.select("text"), 2, 0.5, share)
        assert [inside[place(t)] for t in ("rare3", "some2", "common")] == want

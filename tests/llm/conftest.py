"""A documents table with the awkward cases every operator has to take."""

from __future__ import annotations

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id string, size string, kept string, key string, shard string, score string, path string, n string, value string, rep string, words string"
)
PROSE = "The old mill stood by the river, and every autumn its wheel turned slowly under the weight of brown water. "


def prose(seed: int, words: int) -> str:
    """Made-up sentences that never repeat a window of three words."""
    out = []
    for i in range(words):
        x = (seed * 7919 + i * i * 31 + i * 17) % 99991
        out.append(f"w{x:x}" + ("." if i % 11 == 10 else ""))
    return " ".join(out) + "."


def table(spark, rows):
    full = [(i, t, lang, s, None if t is None else len(t), *["x"] * 11) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="package")
def awkward_rows():
    near = prose(3, 300)
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t \r\n", "en", None),
        (4, "word", None, "b"),
        (5, prose(5, 30_000), "en", "a"),
        (6, near, "en", "b"),
        (7, near, "de", "a"),
        (8, near + " Extra end.", "en", "c"),
        (9, near, "en", "b"),
        (9, near, "en", "b"),
        (10, "two words", "en", None),
        (11, "Two words naïve 日本語 🙂 ΣΑΣ <|endoftext|> x", "en", "d"),
        (None, near, "en", "a"),
        (None, "no id here at all", None, None),
        (12, "x" * 50_000, "en", "a"),
        (13, "\n".join(["same line here."] * 60), "en", "a"),
        (-5, prose(9, 120), "en", "a"),
        (2**62, prose(10, 80), "en", "b"),
    ]


@pytest.fixture(scope="package")
def awkward(spark, awkward_rows):
    return table(spark, awkward_rows).repartition(3).cache()


@pytest.fixture(scope="package")
def nothing(spark):
    return table(spark, [])

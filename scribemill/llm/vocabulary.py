"""Reading public tokenizer files and the byte alphabet they are written in."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Vocabulary:
    """Merges in rank order, ids of the tokens, and the strings that a text is cut at before anything else."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    word_end: str


def read_vocabulary(path: str) -> Vocabulary:
    """A BPE vocabulary from a tokenizers JSON file on the driver."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    return Vocabulary(model["vocab"], pairs, special, model.get("end_of_word_suffix") or "")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 letters for themselves, the other bytes from U+0100 on."""
    letters, other = [], 0x100
    for byte in range(256):
        if 0x21 <= byte <= 0x7E or (0xA1 <= byte <= 0xFF and byte != 0xAD):
            letters.append(chr(byte))
        else:
            letters.append(chr(other))
            other += 1
    return letters


def letters_of(text: str, table: list[str]) -> str:
    return "".join([table[b] for b in text.encode("utf-8", "replace")])


def special_pattern(special: dict[str, int]) -> re.Pattern | None:
    """Matches the special strings, the longest first; a capturing group keeps them when splitting."""
    if not special:
        return None
    return re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")

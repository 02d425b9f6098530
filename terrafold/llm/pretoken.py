"""Byte-level pre-tokenisation of many texts at once, each distinct piece handled once.

A text is cut at spaces and line ends into units (a unit starts with its blank), the distinct units of a batch are
cut into pieces by the byte-level pattern, and texts become lists of piece numbers. Cutting first at blanks gives
the same pieces unless a blank stands inside a longer run of white space, or the text holds an added token; such
texts are cut by the pattern as a whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The byte-level pre-tokeniser's pattern (a fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}"
INNER_BLANK = rf"[{WHITE}][ \n]([{WHITE}]|\z)"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form."""

    text: str

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            vocabulary = cls(f.read())
        spec = vocabulary.spec
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model["type"] != "BPE" or model.get("dropout"):
            raise ValueError("only a plain byte-level BPE vocabulary is understood")
        return vocabulary

    @cached_property
    def spec(self) -> dict:
        return json.loads(self.text)

    @cached_property
    def added(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in self.spec.get("added_tokens", [])}


def take_ragged(offsets: np.ndarray, flat: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``index``, as offsets and flat values."""
    lengths = np.diff(offsets)[index]
    out = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    at = np.repeat((offsets[:-1][index] - out[:-1]).astype(np.int32), lengths)
    at += np.arange(out[-1], dtype=np.int32)
    return out, flat[at]


@dataclass
class Pieces:
    """Texts as lists of numbers of distinct pieces; ``added[k]`` is the id of piece k if that is an added token, else -1."""

    offsets: np.ndarray
    numbers: np.ndarray
    distinct: list[str]
    added: np.ndarray


def units(text: pa.Array, added: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Which texts must be cut as a whole (these have one empty unit); then the texts as offsets and numbers of distinct units, and the units."""
    whole = pc.match_substring_regex(text, INNER_BLANK)
    for token in added:
        whole = pc.or_(whole, pc.match_substring(text, token))
    split = pc.split_pattern(pc.replace_substring(pc.if_else(whole, pa.scalar("", pa.large_string()), text), "\n", " \n"), " ")
    at = split.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2
    codes[at[:-1]] += 1  # a text's first unit has no blank before it
    used = np.zeros(2 * len(coded.dictionary), bool)
    used[codes] = True
    number, kept = np.cumsum(used) - 1, np.flatnonzero(used)
    names = coded.dictionary.take(pa.array(kept >> 1))
    plain = pc.or_(pa.array(kept & 1 == 1), pc.starts_with(names, "\n"))
    blank, empty = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return whole.to_numpy(zero_copy_only=False), at, number[codes], pc.if_else(plain, names, pc.binary_join_element_wise(blank, names, empty))


def cut(text: pa.Array, added: dict[str, int]) -> Pieces:
    find = regex.compile(PATTERN).findall
    whole, at, codes, names = units(text, added)
    lists = [find(u) for u in names.to_pylist()]
    place: dict[str, int] = {}
    flat = np.fromiter((place.setdefault(p, len(place)) for x in lists for p in x), np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]).astype(np.int64)
    unit_at, numbers = take_ragged(bounds, flat, codes)
    offsets = unit_at[at]
    ids = [-1] * len(place)
    if whole.any():
        offsets, numbers, ids = with_whole(text, whole, added, find, place, offsets, numbers)
    return Pieces(offsets, numbers, list(place), np.array(ids, np.int64))


def with_whole(text: pa.Array, whole: np.ndarray, added: dict[str, int], find, place: dict[str, int], offsets: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Put in the texts that must be cut as a whole. An added token gets a number of its own, under its text after a NUL mark."""
    tokens = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    marks: dict[int, int] = {}
    rows = []
    for k in range(len(whole)):
        if not whole[k]:
            rows.append(numbers[offsets[k] : offsets[k + 1]])
            continue
        found: list[int] = []
        for part in tokens.split(text[k].as_py()) if tokens else [text[k].as_py()]:
            if part in added:
                found.append(place.setdefault(f"\0added\0{part}", len(place)))
                marks[found[-1]] = added[part]
            else:
                found += [place.setdefault(p, len(place)) for p in find(part)]
        rows.append(np.array(found, np.int64))
    ids = [-1] * len(place)
    for k, token in marks.items():
        ids[k] = token
    return np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64), np.concatenate(rows), ids

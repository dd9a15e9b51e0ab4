"""Texts as chunks between blanks, whose token ids are remembered by a Python worker.

For tokenizers that drop white space before they split, so that a chunk's ids do not depend on what
stands around it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, models, pre_tokenizers

#: The only normalizer and splitter for which the short ways below hold; others raise ValueError.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII marks that make one run of their own after letters (an apostrophe may begin "'s" and the like).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A mark that alone follows a letter; what may stand there comes first, so that the search is fast.
_MARK = re.compile(r"[.,](?=[ \n])(?<=[a-z\xdf-\xf6\xf8-\xff].)")
REMEMBER = 200_000


def load(path: str) -> tuple[Tokenizer, dict]:
    """The tokenizer of a file, and the file's model part."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
    splits = [x.get("pattern", {}).get("Regex") for x in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
    if steps != NORMALIZERS or splits[:1] != [SPLIT] or told["model"]["end_of_word_suffix"] != "</w>":
        raise ValueError(f"{path}: not a lower-casing word BPE with </w> ends that drops white space")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer, told["model"]


def added_tokens(tokenizer: Tokenizer) -> dict[str, int]:
    """Added tokens and their ids; ValueError if one is not looked for in the raw text, or stands across chunks."""
    found = tokenizer.get_added_tokens_decoder()
    if odd := [t.content for t in found.values() if t.normalized or len(t.content.split()) != 1]:
        raise ValueError(f"added tokens that need other ways: {odd}")
    return {t.content: i for i, t in found.items()}


def packed(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()


def _is_plain(chunk: str) -> bool:
    """One piece that no step of the normalizer changes."""
    return chunk.isalpha() and chunk.islower() and (chunk.isascii() or max(chunk) <= "\xff")


class Chunks:
    """``encode(texts)`` gives the packed ids of each text.

    ``words`` encodes plain lower-case words, ``others`` any other chunks; both take and return lists.
    ``added`` are the added tokens, which are looked for before letters are made lower-case.
    The first ``remember`` chunks seen stay in memory, later ones only for one call, so a worker's
    memory is bounded and frequent chunks, which come early, are there.
    """

    def __init__(self, words: Callable, others: Callable, remember: int = REMEMBER, added: Iterable[str] = ()):
        self.words, self.others, self.remember = words, others, remember
        self.known: dict[str, bytes] = {"": b""}
        self.added = sorted({x.lower() for x in added})

    def _chunks(self, text: bytes) -> list[str]:
        told = text.decode("utf-8")
        if not told.isascii():
            try:
                told.encode("latin-1")
            except UnicodeEncodeError:
                return told.replace("\n", " ").split(" ")
        # in Latin-1, lower case does not depend on the place in a word or on the version of Unicode
        small = told.lower()
        # but what is an added token only in lower case must not become one
        if not any(x in small for x in self.added):
            told = small
        return _MARK.sub(r" \g<0>", told).replace("\n", " ").split(" ")

    def _learn(self, new: list[str], into: dict[str, bytes]) -> None:
        known = self.known
        plain = list(filter(_is_plain, new))
        rest, split = set(new).difference(plain), []
        for chunk in rest:
            stem = chunk.rstrip(MARKS)
            if stem in known and _is_plain(stem):
                split.append((chunk, known[stem], chunk[len(stem):]))
        rest.difference_update([x for x, _, _ in split])
        rest.update({tail for _, _, tail in split} - known.keys())
        rest = list(rest)
        into.update(zip(plain, self.words(plain), strict=True))
        into.update(zip(rest, self.others(rest), strict=True))
        into.update([(chunk, ids + (into.get(tail) or known[tail])) for chunk, ids, tail in split])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        get = self.known.get
        rows = list(map(self._chunks, texts))
        found = [list(map(get, row)) for row in rows]
        missing = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        into = self.known if len(self.known) < self.remember else {}
        self._learn(list({row[i] for row, at in zip(rows, missing) for i in at}), into)
        for row, ids, at in zip(rows, found, missing):
            for i in at:
                ids[i] = into[row[i]]
        return list(map(b"".join, found))


def byte_letters() -> list[str]:
    """The printable letter for each byte value in byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


_LETTERS = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})


def as_letters(word: str) -> str:
    """The bytes of a word as letters of byte-level vocabularies."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)


@lru_cache(maxsize=1)
def library_chunks(path: str, remember: int = REMEMBER) -> Chunks:
    """Chunks encoded by the tokenizers library, add_special_tokens=False; kept for a worker's next task."""
    tokenizer, model = load(path)
    # the same model without the steps that plain words don't need, and without a cache, as each comes once
    bare = Tokenizer(models.BPE(
        vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]], cache_capacity=0,
        end_of_word_suffix=model["end_of_word_suffix"]))
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    ends = np.zeros(tokenizer.get_vocab_size() + 1, dtype=bool)
    for token, i in model["vocab"].items():
        ends[i] = token.endswith("</w>")

    def words(plain: list[str]) -> list[bytes]:
        if not plain:
            return []
        # one call for all: each word is one piece, and a piece's last token has the end mark
        text = " ".join(map(as_letters, plain))
        ids = np.array(bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (np.flatnonzero(ends[ids]) + 1).tolist()
        if len(cuts) != len(plain):
            return others(plain)
        flat = ids.tobytes()
        return [flat[4 * a:4 * b] for a, b in zip([0, *cuts], cuts)]

    def others(chunks: list[str]) -> list[bytes]:
        return [packed(e.ids) for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)] if chunks else []

    return Chunks(words, others, remember, added_tokens(tokenizer))

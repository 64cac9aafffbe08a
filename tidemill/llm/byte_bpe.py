"""Byte-level BPE files: vocabulary, merges and how texts split into pre-tokens.

Whole-text encoding (`encoder`) is for operators that only need ids as input; token counting
does its own merges on top of `ByteBpe`.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np

#: Fixed values of the format: the pattern that splits texts before merges.
PRE_TOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: In these characters Python's classes and Unicode's categories agree; other texts go to the library's own pre-tokenizer.
#: ASCII without the four separators, Latin letters up to U+017F but the dotted capital I, and marks of General Punctuation.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-įı-ž‐-‧€]")
USUAL_PRE_TOKEN = re.compile(r"""'(?:[stmd]|re|ve|ll)| ?(?:[^\W\d_]+|\d+|(?:[^\s\w]|_)+)|\s+(?!\S)|\s+""")


@cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def check_ranks(merges: list[tuple[int, int, int]], letters: set[int], path: str) -> None:
    """Merging rank by rank is right only if each merge's parts are letters or made by merges of lower ranks."""
    made = set(letters)
    for rank, (left, right, whole) in enumerate(merges):
        if left not in made or right not in made:
            raise ValueError(f"{path}: merge {rank} has a part that no lower rank makes")
        made.add(whole)


class ByteBpe:
    """A tokenizer file's vocabulary. pairs: sorted keys left * size + right; ranks, merged: by place in pairs."""

    def __init__(self, path: str):
        said = json.loads(open(path, encoding="utf-8").read())
        self.path, vocab = path, said["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        of_byte = {c: b for b, c in enumerate(byte_letters())}
        self.token_bytes = {i: bytes(of_byte[c] for c in t) for t, i in vocab.items()}
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        split = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        check_ranks([(vocab[a], vocab[b], vocab[a + b]) for a, b in split], set(self.byte_ids.tolist()), path)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in split], dtype=np.int64)
        order = np.argsort(keys)
        self.pairs, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in split], dtype=np.int64)[order]
        #: Ranks in the order of ids: then merging by id of the result is merging by rank.
        self.ranks_follow_ids = bool((np.diff(self.merged[np.argsort(self.ranks)]) > 0).all())
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None


@cache
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


@cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pre_tokens(text: str, bpe: ByteBpe) -> list[str]:
    """The pre-tokens of a text without special strings, as the library splits it."""
    if UNUSUAL.search(text) is None:
        return USUAL_PRE_TOKEN.findall(text)
    return [text[a:b] for _, (a, b) in library(bpe.path).pre_tokenizer.pre_tokenize_str(text)]


@cache
def encoder(path: str):
    """text -> numpy ids as the tokenizers library gives them for the file (special strings in texts parsed, none added).

    The file's vocabulary runs in tiktoken, five times as fast with equal ids; where that refuses a text, or where
    ranks do not follow ids, the library itself encodes it.
    """
    import tiktoken

    bpe = load(path)
    fast = None
    if bpe.ranks_follow_ids:
        fast = tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks={t: i for i, t in bpe.token_bytes.items()}, special_tokens=bpe.special)
    allowed = set(bpe.special)

    def encode(text: str) -> np.ndarray:
        if fast is not None:
            try:
                return fast.encode_to_numpy(text, allowed_special=allowed)
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # the pattern engine may give up on very long runs, with an error of its own kind
                pass
        return np.array(library(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode

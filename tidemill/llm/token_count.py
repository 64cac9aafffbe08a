"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import byte_bpe
from .common import texts_of, to_batch

_NONE = np.iinfo(np.int64).max
#: Counts that a worker remembers; beyond it begins anew. Words of over LONGEST characters are not remembered, so that
#: the memory is bounded in bytes too. Only speed depends on both.
REMEMBERED, LONGEST = 800_000, 48
_COUNTS: dict[str, dict[str, int]] = {}


def _lookup(bpe: byte_bpe.ByteBpe, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged symbol of pairs; rank _NONE where the file has no such merge."""
    keys = left * bpe.size + right
    at = np.minimum(np.searchsorted(bpe.pairs, keys), len(bpe.pairs) - 1)
    known = bpe.pairs[at] == keys
    return np.where(known, bpe.ranks[at], _NONE), bpe.merged[at]


def surviving(bpe: byte_bpe.ByteBpe, words: list[bytes]) -> np.ndarray:
    """Symbols that remain of each word after all merges.

    The words lie one behind another in flat arrays. In each round every word applies its own
    lowest-ranked pair at all its places at once; words without a pair left leave the arrays.
    """
    counts = np.array([len(w) for w in words], dtype=np.int64)
    which = np.flatnonzero(counts > 1)
    if not len(which):
        return counts
    symbols = bpe.byte_ids[np.frombuffer(b"".join(words[i] for i in which), dtype=np.uint8)]
    lengths = counts[which]
    word = np.repeat(np.arange(len(which)), lengths)
    last = np.zeros(len(symbols), dtype=bool)
    last[np.cumsum(lengths) - 1] = True
    rank, merged = _lookup(bpe, symbols, np.roll(symbols, -1))
    rank[last] = _NONE
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        done = lowest == _NONE
        if done.any():
            counts[which[word[starts[done]]]] = sizes[done]
            stay = np.repeat(~done, sizes)
            symbols, word, last, rank, merged = symbols[stay], word[stay], last[stay], rank[stay], merged[stay]
            lowest, sizes = lowest[~done], sizes[~done]
            if not len(symbols):
                break
        hit = rank == np.repeat(lowest, sizes)
        # In a run such as a a a a each second place only can merge, from the left.
        run = hit & np.r_[False, hit[:-1]]
        if run.any():
            place = np.arange(len(hit))
            begin = np.maximum.accumulate(np.where(hit & ~run, place, 0))
            hit &= (place - begin) % 2 == 0
        at = np.flatnonzero(hit)
        symbols[at] = merged[at]
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        new = np.cumsum(keep)[at] - 1
        symbols, word, last, rank, merged = symbols[keep], word[keep], last[keep], rank[keep], merged[keep]
        changed = np.zeros(len(symbols), dtype=bool)
        changed[new] = True
        changed[np.maximum(new - 1, 0)] = True
        fresh = np.flatnonzero(changed)
        rank[fresh], merged[fresh] = _lookup(bpe, symbols[fresh], symbols[np.minimum(fresh + 1, len(symbols) - 1)])
        rank[fresh[last[fresh]]] = _NONE
    return counts


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, special strings of the file counted as one token each."""
    bpe = byte_bpe.load(path)
    known = _COUNTS.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    split, specials = [], []
    for text in texts:
        parts = bpe.special_split.split(text) if bpe.special_split and any(s in text for s in bpe.special) else [text]
        words: list[str] = []
        for part in parts[::2]:
            words += byte_bpe.pre_tokens(part, bpe)
        split.append(words)
        specials.append(len(parts) // 2)
    found = [list(map(known.get, words)) for words in split]
    new = list({w for words, ns in zip(split, found) if None in ns for w, n in zip(words, ns) if n is None})
    if new:
        made = dict(zip(new, surviving(bpe, [w.encode() for w in new]).tolist()))
        known.update((w, n) for w, n in made.items() if len(w) <= LONGEST)
        found = [[made[w] if n is None else n for w, n in zip(words, ns)] if None in ns else ns for words, ns in zip(split, found)]
    return [sum(ns) + n for ns, n in zip(found, specials)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs, by its whole text.

    Map only. Texts are counted in blocks of about block_chars characters, so memory is bounded by a block and the
    longest text. Null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null; repeated rows each get a
    row; an empty table gives an empty result; other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, at = texts_of(batch), [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= block_chars):
                    chars += len(texts[end])
                    end += 1
                counts += count_texts(texts[at:end], tokenizer_path)
                at = end
            yield to_batch(
                {
                    "doc_id": (pa.int64(), batch.column(0)),
                    "n_bytes": (pa.int64(), [len(t.encode()) for t in texts]),
                    "n_tokens": (pa.int64(), counts),
                    "over_limit": (pa.bool_(), [n > limit for n in counts]),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

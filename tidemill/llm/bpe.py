"""BPE encoding and decoding by a pair occurrence index."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import UNUSUAL, byte_letters, check_ranks, library
from .common import texts_of, to_batch

#: Words whose ids a worker remembers; beyond it begins anew. Words of over LONGEST characters are not remembered, so that
#: the memory is bounded in bytes too. Only speed depends on both.
REMEMBERED, LONGEST = 800_000, 48
#: The file's own split, for characters on which Python's classes and Unicode's categories agree.
USUAL_WORD = re.compile(r"""'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+""")
_IDS: dict[str, dict[str, tuple[int, ...]]] = {}


class WordBpe:
    """A BPE file with word ends: lower-cased words, each last symbol marked by the end suffix, white space dropped."""

    def __init__(self, path: str):
        said = json.loads(open(path, encoding="utf-8").read())
        vocab, end = said["model"]["vocab"], said["model"]["end_of_word_suffix"] or ""
        self.path = path
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        letters = byte_letters()
        self.inner, self.final = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        split = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        self.by_rank = [(vocab[a], vocab[b], vocab[a + b]) for a, b in split]
        check_ranks(self.by_rank, {*self.inner, *self.final}, path)
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(self.by_rank)}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")


@cache
def load(path: str) -> WordBpe:
    return WordBpe(path)


def merge_words(bpe: WordBpe, words: list[bytes]) -> list[tuple[int, ...]]:
    """The ids of each word.

    All words lie in one sequence, linked both ways, ends marked by -1. `places` maps the rank of each pair that occurs
    to all its places; the ranks come off a heap in ascending order, each is applied to its whole list at once, and the
    pairs that its merges make join the lists of their own ranks. A place whose pair has gone meanwhile is passed over.
    """
    symbols: list[int] = [-1]
    begins = []
    inner, final = bpe.inner, bpe.final
    for w in words:
        begins.append(len(symbols))
        symbols += [inner[b] for b in w[:-1]]
        symbols.append(final[w[-1]])
        symbols.append(-1)
    begins.append(len(symbols))
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    rank_of = bpe.ranks.get
    places: dict[int, list[int]] = {}
    for i, rank in enumerate(map(rank_of, zip(symbols, symbols[1:]))):
        if rank is not None:
            if rank in places:
                places[rank].append(i)
            else:
                places[rank] = [i]
    active = list(places)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        left, right, merged = bpe.by_rank[rank]
        found = places.pop(rank)
        found.sort()  # merges of one rank go from the left
        for i in found:
            if symbols[i] != left:
                continue
            j = after[i]
            if symbols[j] != right:
                continue
            symbols[i], symbols[j] = merged, -2
            after[i] = k = after[j]
            before[k] = i
            p = before[i]
            for at, made in ((i, rank_of((merged, symbols[k]))), (p, rank_of((symbols[p], merged)))):
                if made is not None:
                    if made in places:
                        places[made].append(at)
                    else:
                        places[made] = [at]
                        heapq.heappush(active, made)
    return [tuple([s for s in symbols[a : b - 1] if s >= 0]) for a, b in zip(begins, begins[1:])]


def _words(bpe: WordBpe, text: str) -> list[str]:
    """Byte-level words of a text without special strings, as raw strings where that is cheap."""
    if UNUSUAL.search(text) is None:  # such texts are in normal form C, and lower() has no context in them
        return USUAL_WORD.findall(text.lower())
    tokenizer = library(bpe.path)
    normal = tokenizer.normalizer.normalize_str(text)
    return [normal[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(normal)]


def encode_texts(texts: list[str], path: str) -> list[list[int]]:
    """Ids of each text; special strings in a text become their own ids, none is added."""
    bpe = load(path)
    known = _IDS.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    split: list[list[str]] = []
    for text in texts:
        words: list[str] = []
        if any(s in text for s in bpe.special):
            for k, part in enumerate(bpe.special_split.split(text)):
                if k % 2:
                    known[part] = (bpe.special[part],)  # no other word is such a string: words hold no two kinds of characters
                    words.append(part)
                else:
                    words += _words(bpe, part)
        else:
            words = _words(bpe, text)
        split.append(words)
    found = [list(map(known.get, words)) for words in split]
    new = list({w for words, ids in zip(split, found) if None in ids for w, i in zip(words, ids) if i is None})
    if new:
        made = dict(zip(new, merge_words(bpe, [w.encode() for w in new])))
        known.update((w, ids) for w, ids in made.items() if len(w) <= LONGEST)
        found = [[made[w] if i is None else i for w, i in zip(words, ids)] if None in ids else ids for words, ids in zip(split, found)]
    return [list(chain.from_iterable(ids)) for ids in found]


def decode_ids(ids: list[int], path: str) -> str:
    """The file names no decoder, so a decoded text is its tokens joined by spaces."""
    return " ".join(map(load(path).tokens.__getitem__, ids))


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, ids (array of int), decoded of every row of docs.

    Map only; blocks of about block_chars characters share one pair index. Null and empty texts give no ids and an empty
    decoded text; a null doc_id stays null; repeated rows each get a row; an empty table gives an empty result; other
    columns are not read.
    """
    return _mapped(docs, tokenizer_path, block_chars, digests=False)


def bpe_digests(docs: DataFrame, tokenizer_path: str, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what bpe_round_trip gives, taken in the same tasks."""
    return _mapped(docs, tokenizer_path, block_chars, digests=True)


def _mapped(docs: DataFrame, path: str, block_chars: int, digests: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts, at = batch.column(0), texts_of(batch), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= block_chars):
                    chars += len(texts[end])
                    end += 1
                encoded = encode_texts(texts[at:end], path)
                decoded = [decode_ids(ids, path) for ids in encoded]
                if digests:
                    rest = {
                        "n_tokens": (pa.int64(), [len(ids) for ids in encoded]),
                        "ids_sha256": (pa.string(), [hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest() for ids in encoded]),
                        "decoded_sha256": (pa.string(), [hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                    }
                else:
                    rest = {"ids": (pa.list_(pa.int32()), encoded), "decoded": (pa.string(), decoded)}
                yield to_batch({"doc_id": (pa.int64(), doc_ids[at:end])} | rest)
                at = end

    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {kinds}")

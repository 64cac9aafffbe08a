"""SimHash fingerprints, and links between them by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import group_starts, materialize, passing_tables, slices, texts_of, to_batch, whole_groups
from .graph import Forest, components_of, connected_components

SEED = 42
#: A trie node pair is compared fingerprint by fingerprint once it has no more pairs than this.
LEAF_PAIRS = 64
#: Node pairs, and pairs of fingerprints, that are held at once.
CHUNK = 1 << 16


def words_of(text: str) -> list[bytes]:
    """A-Z in lower case, split at ASCII white space."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of all n-word shingles, repeats included; fewer words make one shingle, none make none."""
    if len(words) < n:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(n))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)


def fingerprint(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Bit k is set if it is set in over half of the hashes, by weight; of none: zero. As a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts, total = np.zeros(64, dtype=np.int64), len(hashes) if weights is None else int(weights.sum())
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[at : at + CHUNK] @ bits
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def trie_links(keys: np.ndarray, tops: list[tuple[int, int, int, int, int, int]], radius: int, forest: Forest, verify: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
    """Joins in forest what lies within radius bits, of the node pairs in tops.

    keys: sorted uint64. A trie node is a range of keys with equal upper bits. tops: (from, to, from, to, depth,
    differing bits) of node pairs; a node paired with itself stands for the pairs inside it. Node pairs go down a bit at
    a time, both halves with both halves; a pair of unlike halves adds a differing bit, and what exceeds the radius goes.
    So do node pairs that lie within one tree of the forest already: their links add nothing. Neighbours in the order of
    keys are tried first, so dense groups are one tree before any node pair goes down. verify says of pairs of indices
    which count as links.
    """
    inside = np.zeros(len(keys), dtype=bool)
    for a, b, c, d, _, _ in tops:
        inside[a : b - 1] |= a == c
    i = np.flatnonzero(inside)
    _try(keys, i, i + 1, radius, forest, verify)
    ones: dict[int, np.ndarray] = {}
    stack = []
    by_depth: dict[int, list] = {}
    for a, b, c, d, depth, bits in tops:
        by_depth.setdefault(depth, []).append((a, b, c, d, bits))
    for depth, own in by_depth.items():
        stack.append((depth, np.array(own, dtype=np.int64).T))
    while stack:
        depth, nodes = stack.pop()
        if nodes.shape[1] > CHUNK:
            half = nodes.shape[1] // 2
            stack += [(depth, nodes[:, half:]), (depth, nodes[:, :half])]
            continue
        a, b, c, d, bits = nodes
        change = np.r_[0, np.cumsum(forest.root[1:] != forest.root[:-1])]
        joined = (change[b - 1] == change[a]) & (change[d - 1] == change[c]) & (forest.root[a] == forest.root[c])
        nodes = nodes[:, (bits <= radius) & ~joined]
        a, b, c, d, bits = nodes
        leaf = (b - a) * (d - c) <= LEAF_PAIRS
        if leaf.any():
            _compare(keys, nodes[:, leaf], radius, forest, verify)
            nodes = nodes[:, ~leaf]
            a, b, c, d, bits = nodes
        if depth >= 64:
            for a, b, c, d, _ in nodes.T.tolist():
                _across(keys, a, b, c, d, radius, forest, verify)
            continue
        if not nodes.shape[1]:
            continue
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1))].astype(np.int64)
        count = ones[depth]
        m, n = b - (count[b] - count[a]), d - (count[d] - count[c])  # where the halves with the bit set begin
        own = a == c
        parts = [
            np.array([a, m, c, n, bits]),
            np.array([m, b, n, d, bits]),
            np.array([a, m, n, d, bits + 1]),
            np.array([m, b, c, n, bits + 1])[:, ~own],
        ]
        down = np.concatenate(parts, axis=1)
        down = down[:, (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= radius)]
        if down.shape[1]:
            stack.append((depth + 1, down))


def _try(keys, i, j, radius, forest, verify) -> None:
    """Joins those of the pairs i, j that lie within the radius and count as links."""
    near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= radius)
    i, j = i[near], j[near]
    step = CHUNK // 8 if verify else CHUNK
    for k in range(0, len(i), step):
        x, y = i[k : k + step], j[k : k + step]
        if verify:
            apart = forest.root[x] != forest.root[y]
            x, y = x[apart], y[apart]
            same = verify(x, y)
            x, y = x[same], y[same]
        forest.join(x, y)


def _compare(keys, nodes, radius, forest, verify) -> None:
    a, b, c, d, _ = nodes
    sizes = (b - a) * (d - c)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * CHUNK, side="right")))
        own = sizes[at:stop]
        place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        width = np.repeat((d - c)[at:stop], own)
        _try(keys, np.repeat(a[at:stop], own) + place // width, np.repeat(c[at:stop], own) + place % width, radius, forest, verify)
        at = stop


class Coordinates:
    """Says of pairs of rows whether so large a share of their signatures' coordinates is equal."""

    def __init__(self, own: np.ndarray, similarity: float):
        self.own, self.least = own, similarity * own.shape[1]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.own[i] == self.own[j]).sum(axis=1) >= self.least

    def neighbours(self, rows: np.ndarray, width: int = 6):
        """Pairs of rows next to each other in the order of each of several bands of coordinates, those that agree in a whole band among them."""
        for at in range(0, self.own.shape[1], width):
            order = rows[np.lexsort(self.own[rows, at : at + width].T)]
            yield order[:-1], order[1:]


def _across(keys, a: int, b: int, c: int, d: int, radius, forest, verify) -> None:
    """Two large nodes at the end of the trie, all keys of each alike.

    Where verify knows neighbours, those in the order of bands are tried, so work grows as rows and not as their square.
    Otherwise each key of the side's smaller trees meets the other side once; keys of the largest tree do not meet each other.
    """
    if isinstance(verify, Coordinates):
        for i, j in verify.neighbours(np.unique(np.r_[a:b, c:d])):
            _try(keys, i, j, radius, forest, verify)
        return
    roots, counts = np.unique(forest.root[np.r_[a:b, c:d]], return_counts=True)
    largest = roots[counts.argmax()]
    left, right = np.arange(a, b), np.arange(c, d)
    for few, all_ in ((left[forest.root[a:b] != largest], right), (right[forest.root[c:d] != largest], left)):
        for i in few.tolist():
            other = all_[forest.root[all_] != forest.root[i]]
            _try(keys, np.full(len(other), i), other, radius, forest, verify)


def block_bits(radius: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of radius + 1 blocks: fingerprints within radius bits agree in one of them at least."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(x, y - x) for x, y in zip(edges, edges[1:])]


#: Bits of the trie that a hot node is split by at once.
SPLIT = 6


def _split(rows: DataFrame, hot: DataFrame, radius: int) -> DataFrame:
    """rows with those of hot buckets dealt to buckets SPLIT bits further down: a key goes to the pairs of its node with
    each node within what is left of the radius."""
    rows = rows.join(hot.withColumn("_hot", F.lit(True)), "bucket", "left")
    masks = sorted((m for m in range(1 << SPLIT) if m.bit_count() <= radius), key=int.bit_count)
    left = F.lit(radius) - F.col("used")
    fit = F.filter(F.array(*map(F.lit, masks)), lambda m: F.bit_count(m) <= left)
    rows = rows.withColumn("_m", F.explode(F.when(F.col("_hot"), fit).otherwise(F.array(F.lit(-1)))))
    mine = F.expr(f"cast(shiftrightunsigned(shiftleft(key, depth), {64 - SPLIT}) as int)")
    apart = mine.bitwiseXOR(F.col("_m"))
    p = F.when(F.col("same"), F.least(mine, apart)).when(F.col("side") == 0, mine).otherwise(apart)
    q = F.when(F.col("same"), F.greatest(mine, apart)).when(F.col("side") == 0, apart).otherwise(mine)
    deeper = F.col("_m") >= 0
    changed = {
        "bucket": F.when(deeper, F.concat_ws("/", "bucket", F.concat_ws("-", p.cast("string"), q.cast("string")))).otherwise(F.col("bucket")),
        "side": F.when(deeper & F.col("same"), (mine != p).cast("int")).otherwise(F.col("side")),
        "used": F.when(deeper, F.col("used") + F.bit_count("_m")).otherwise(F.col("used")),
        "depth": F.when(deeper, F.col("depth") + SPLIT).otherwise(F.col("depth")),
        "same": F.when(deeper, F.col("same") & (F.col("_m") == 0)).otherwise(F.col("same")),
    }
    return rows.withColumns(changed).drop("_hot", "_m")


def links(prints: DataFrame, radius: int, *, similarity: float | None = None, hot: int = 100_000) -> DataFrame:
    """a, b: edges that join all prints (node, fp) within radius bits, and nothing else.

    With similarity, prints have a form (of minhash.features) too, and pairs count only if so large a share of their
    coordinates is equal; equal fingerprints whose forms differ are then compared with their neighbours only.

    radius + 1 tries hold each fingerprint turned so that another of its blocks comes first; links agree in a first
    block, so each block value, the top of a trie, is a bucket of its own. Of each set of fingerprints that a task joins it
    returns a spanning tree of links, so rows stay below radius + 2 for each fingerprint, however dense a group is.

    Buckets of over `hot` rows are dealt out by pairs of nodes further down the trie, and those again, as deep as the
    keys go. Rows come sorted, so a task holds one bucket at a time. Nodes are not null and each once, as are their fps; no
    prints give no rows.
    """
    fp = F.col("fp")

    def turned(by: int):
        return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))

    tops = [F.struct(F.concat_ws(":", F.lit(str(k)), F.hex(F.shiftrightunsigned(turned(by), 64 - w))).alias("bucket"), turned(by).alias("key"), F.lit(w).alias("depth")) for k, (by, w) in enumerate(block_bits(radius))]
    rows = prints.select("node", *(["form"] if similarity else []), F.explode(F.array(*tops)).alias("_t")).select("*", "_t.*").drop("_t")
    rows = rows.select("*", F.lit(0).alias("used"), F.lit(0).alias("side"), F.lit(True).alias("same"))
    for _ in range(64 // SPLIT):
        large = materialize(rows.filter(F.col("depth") + SPLIT <= 64).groupBy("bucket").count().filter(F.col("count") > hot).drop("count"), "hot")
        if large.isEmpty():
            break
        rows = _split(rows, large, radius)
    kind = dict(prints.dtypes)["node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"]):
            bounds = np.r_[group_starts(table, ["bucket"]), table.num_rows]
            get = lambda c: table.column(c).to_numpy()
            keys, depth, used, side, same = get("key").view(np.uint64), get("depth"), get("used"), get("side"), get("same")
            found = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s < 2:
                    continue
                m = s + int(np.searchsorted(side[s:e], 1))
                if same[s]:
                    found.append((s, e, s, e, int(depth[s]), int(used[s])))
                elif s < m < e:
                    found.append((s, m, m, e, int(depth[s]), int(used[s])))
            if not found:
                continue
            forest, verify = Forest(table.num_rows), None
            if similarity:
                own = np.ascontiguousarray(minhash.fixed_rows(table.column("form").chunk(0), minhash.FORM)[:, : minhash.COORDS])
                verify = Coordinates(own, similarity)
            trie_links(keys, found, radius, forest, verify)
            i, j = (np.concatenate(side) for side in zip(*forest.edges))
            if len(i):
                nodes = table.column("node").chunk(0)
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(i)), nodes.take(pa.array(j))], names=["a", "b"])

    # One bucket's keys may follow another's in a task: trie_links needs order inside each range only.
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "side", "key")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit integer) of every row; null and empty texts have zero, null and repeated
    doc_ids are kept. Map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(shingle_hashes(words_of(t), shingle)) for t in texts_of(batch)]
            yield to_batch({"doc_id": (pa.int64(), batch.column(0)), "fp": (pa.int64(), prints)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links of at most radius bits reach.

    Equal fingerprints are one node, so copies cost nothing in the trie join. Texts without words have fingerprint zero
    and link like others. A null doc_id is never a component_id unless its component has no other (then null); rows that
    repeat a doc_id each get a row; an empty table gives an empty result; other columns are not read.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(links(distinct.select(F.col("fp").alias("node"), "fp"), radius))
    named = components_of(distinct, "fp", roots)
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_print(damping: float):
    """Fingerprints of hashed words by count ** damping, so that common words do not decide most bits."""

    def of(words: np.ndarray) -> int:
        own, counts = np.unique(words, return_counts=True)
        return fingerprint(own, np.rint(64 * counts.astype(np.float64) ** damping).astype(np.int64))

    return of


def grouped(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, radius: int = 5, damping: float = 0.8, margin: float = 0.1) -> DataFrame:
    """doc_id, key, text_key, root of every row, written: rows of one component have one root. See near_duplicates."""
    with passing_tables(docs.sparkSession) as keep:
        told = materialize(minhash.features(docs, shingle, word_print(damping)), "features")
        distinct = minhash.distinct_sets(told)
        close = materialize(links(distinct.select(F.col("id").alias("node"), "fp", "form"), radius, similarity=similarity - margin), "close")
        roots = connected_components(minhash.links(docs, distinct, shingle, similarity, proposals=close))
        rooted = distinct.select("node", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("node", F.coalesce("root", "id").alias("root"))
        # No node has the empty set: rows without words are one component.
        keep.append(materialize(told.select("doc_id", "key", "text_key", "node").join(rooted, "node", "left").select("doc_id", "key", "text_key", F.coalesce("root", F.lit(-1)).alias("root")), "grouped"))
    return keep[0]


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, component_id of near copies: texts whose sets of 5-word shingles have a similarity of 0.8 or more.

    Edits of a few words in a hundred change most bits' votes of shingles but few of single words: fingerprints of the
    words, by damped count so that common words do not decide most bits, within `radius` bits are what the trie join
    proposes. Its tasks try each pair that is not joined yet by the sets' MinHash signatures, from similarity - margin.
    That only proposes: a link counts if the whole sets have the similarity.

    A fingerprint of 64 bits leaves pairs out, more so of short texts and where a stretch was added or cut off. The
    signature join (minhash.links) finds these among sets that are not in one component yet, checked in the same way.
    Texts with equal sets of shingles are one node, told apart by 128-bit digests.

    Options and their defaults are those of grouped. Rows as in simhash_components: null and empty texts have the empty
    set and are copies of one another; a null doc_id is never a component_id unless its component has no other (then
    null); rows that repeat a doc_id each get a row; an empty table gives an empty result; other columns are not read.
    """
    rows = grouped(docs, **options)
    least = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.select("doc_id", "root").join(least, "root").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component of near copies, all columns as they were.

    The row with the least doc_id stays; a row with a null doc_id only where its component has no other, and of several
    texts with that id (or null) one. Rows of other components all stay, whatever their ids: null and repeated doc_ids are
    no copies by themselves. Null and empty texts are one component; an empty table gives an empty result.
    """
    key, text = "_key", "_text_key"
    while {key, text} & set(docs.columns):
        key, text = "_" + key, "_" + text
    keep = grouped(docs, **options).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "key", "text_key")).alias("s"))
    keep = materialize(keep.select(F.col("s.key").alias(key), F.col("s.text_key").alias(text)), "keep")
    # Equal rows meet in their own task first, so that many copies of one row are no hot group behind the exchange.
    own = docs.withColumns(dict(zip((key, text), minhash.row_key()))).dropDuplicates([key, text])
    return own.join(keep, [key, text], "left_semi").select(*docs.columns)

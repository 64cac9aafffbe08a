"""Near copies by an inverted index of MinHash signatures: texts posted under coordinate-value pairs, collisions counted, matches checked on whole sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_starts, materialize, passing_tables, slices, texts_of, to_batch, whole_groups
from .graph import Forest, components_of, connected_components

#: Coordinates of a signature, and how many of two signatures must be equal for their sets to be compared. Sets of a
#: similarity of 0.8 have fewer in 2.4 of 10 ** 11 cases.
COORDS, MATCHES = 48, 18
#: Cells of the parity bits.
BITS = 512
#: Bytes of a form: a byte for each coordinate, then the parity bits.
FORM = COORDS + BITS // 8
#: Pairs that are compared at once.
CHUNK = 1 << 16
_ODD = np.random.default_rng(12).integers(0, 1 << 63, size=COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of sets that a share of a group may hold, 8 bytes each; a task holds two shares.
SHARE = 1 << 20
#: Stands for a null doc_id in joins; text_key tells it from the number itself.
NO_ID = -(1 << 63)


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


#: A number for each byte: the same for A-Z as for a-z, zero for white space.
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, size=256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACES = (9, 10, 11, 12, 13, 32)
_BYTE[list(_SPACES)] = 0
_GAP = _BYTE == 0
_POWERS = np.ones(1, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, at least."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * np.uint64(pow(_BASE, len(_POWERS), 1 << 64))])
    return _POWERS


def word_hashes(text: str, block: int = 1 << 14) -> np.ndarray:
    """64-bit hashes of the words of a text in their order: A-Z in lower case, split at ASCII white space.

    A word's hash is a polynomial over numbers of its bytes. Texts are taken in blocks that end with a word.
    """
    data, out, at = np.frombuffer(text.encode() + b" ", dtype=np.uint8), [], 0
    while at < len(data):
        stop = at + block
        while stop < len(data) and data[stop - 1] not in _SPACES:
            stop += int(_GAP.take(data[stop : stop + block]).argmax()) + 1 if _GAP.take(data[stop : stop + block]).any() else block
        part, at = data[at:stop], stop
        gap = _GAP.take(part)
        ends = np.flatnonzero(gap)  # each byte of white space ends a word or an empty one
        starts = np.empty_like(ends)
        starts[:1], starts[1:] = 0, ends[:-1] + 1
        place = np.arange(len(part), dtype=np.int32) - np.repeat(starts.astype(np.int32), ends + 1 - starts)
        values = _BYTE.take(part) * powers(int((ends - starts).max()) + 1).take(place)
        out.append(mixed(np.add.reduceat(values, starts)[ends > starts]))
    return out[0] if len(out) == 1 else np.concatenate(out)


def distinct_of(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles of a sequence of word hashes, as 64-bit hashes in ascending order; fewer words make one, none make none."""
    width = min(n, len(words))
    if not width:
        return words
    total, power = np.zeros(len(words) - width + 1, dtype=np.uint64), 1
    for k in range(width):
        power = power * _BASE % (1 << 64)
        total += words[k : len(words) - width + 1 + k] * np.uint64(power)
    return distinct_of(mixed(total))


def signature(kept: np.ndarray) -> np.ndarray:
    """A 64-bit key for each coordinate and its value, which is the least of the set's hashes under the coordinate's multiplier."""
    least = np.full(COORDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(kept), 1024):
        np.minimum(least, np.multiply.outer(_ODD, kept[at : at + 1024]).min(axis=1), out=least)
    return mixed(least ^ mixed(np.arange(1, COORDS + 1, dtype=np.uint64)))


def parity_bits(kept: np.ndarray) -> np.ndarray:
    """For each of 512 cells whether an odd number of the set's members falls to it. Two sets differ in at least as many
    members as their bits do, which bounds their similarity from above."""
    return np.packbits(np.bincount((kept >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS).astype(np.uint8) & 1, bitorder="little")


def row_key():
    """(key, text_key): which rows are the same, by doc_id and by a 128-bit digest of the text and of whether there is a doc_id."""
    said = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id").isNull(), "0").otherwise("1"))
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.unhex(F.md5(said)).alias("text_key")


def features(docs: DataFrame, shingle: int, word_print=None) -> DataFrame:
    """doc_id, key, text_key, node (128-bit digest of the set of shingles), n (its size), form, tokens (see signature), fp of every row. Map only.

    A task gives form, tokens and fp for the first row of each set that is not empty, and nulls for its other rows.
    word_print makes fp of the hashes of a text's words; without it, it is null. Null and empty texts have the empty set;
    null and repeated doc_ids each keep their rows; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            node, sizes, forms, tokens, prints = [], [], [], [], []
            for text in texts_of(batch):
                words = word_hashes(text)
                kept = shingle_set(words, shingle)
                node.append(hashlib.md5(kept.tobytes()).digest())
                sizes.append(len(kept))
                if not len(kept) or node[-1] in seen:
                    forms.append(None), tokens.append(None), prints.append(None)
                    continue
                seen.add(node[-1])
                own = signature(kept)
                forms.append(own.astype(np.uint8).tobytes() + parity_bits(kept).tobytes())
                tokens.append(own.view(np.int64))
                prints.append(word_print(words) if word_print else None)
            told = {c: (t, batch.column(batch.schema.get_field_index(c))) for c, t in (("doc_id", pa.int64()), ("key", pa.int64()), ("text_key", pa.binary()))}
            yield to_batch(told | {"node": (pa.binary(), node), "n": (pa.int64(), sizes), "form": (pa.binary(), forms), "tokens": (pa.list_(pa.int64()), tokens), "fp": (pa.int64(), prints)})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text")
    return own.mapInArrow(run, "doc_id long, key long, text_key binary, node binary, n long, form binary, tokens array<long>, fp long")


def distinct_sets(told: DataFrame) -> DataFrame:
    """id, node, n, form, tokens, fp, key and text_key of a row, for each set of features that is not empty, written. Rows of
    equal sets, however many, are one."""
    return materialize(told.filter("tokens IS NOT NULL").drop("doc_id").dropDuplicates(["node"]).withColumn("id", F.monotonically_increasing_id()), "distinct")


def postings(distinct: DataFrame) -> DataFrame:
    """id, n, form, own (count, token): the tokens under which a set is posted, written.

    Two sets with MATCHES equal coordinates share one of the COORDS - MATCHES + 1 rarest tokens of each, under any order
    that all follow: by number of sets, then token. What no other set has needs no posting, and a set that shares fewer
    than MATCHES tokens with all others together none at all.
    """
    posted = distinct.select("id", F.explode("tokens").alias("token"))
    counts = posted.groupBy("token").agg(F.count("*").alias("count")).filter("count > 1")
    own = posted.join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("own"))
    rare = own.filter(F.size("own") >= MATCHES).select("id", F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1)).alias("own"))
    return materialize(rare.join(distinct.select("id", "n", "form"), "id"), "postings")


def fixed_rows(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of one length, as rows of bytes."""
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[column.offset * width :][: len(column) * width].reshape(-1, width)


class Lists:
    """Lists of a table whose rows are sorted by list (keys), then size: which pairs of a list may be similar.

    Merging skips what lies beyond a row's bounds of size, then pairs under one root or in one tree, then those that
    collide in fewer than MATCHES coordinates, then those whose parity bits rule the similarity out.
    """

    #: Of rows; whoever sets it joins what it has no further pairs of.
    tree: Forest | None = None

    def __init__(self, table: pa.Table, p: int, keys: list[str]):
        column = lambda c: table.column(c).chunk(0)
        self.ids, self.n = column("id").to_numpy(), column("n").to_numpy()
        self.root, self.home = column("root").to_numpy(), column("home").to_numpy(zero_copy_only=False)
        self.p, form = p, fixed_rows(column("form"), FORM)
        self.coords, self.bits = np.ascontiguousarray(form[:, :COORDS]), np.ascontiguousarray(form[:, COORDS:]).view(np.uint64)
        starts = group_starts(table, keys)
        self.group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(self.ids)]))

    def matches(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs i, j that may be similar, and how many coordinates they share."""
        keep = self.root[i] != self.root[j]
        if self.tree:
            keep &= self.tree.root[i] != self.tree.root[j]
        i, j = i[keep], j[keep]
        same = (self.coords[i] == self.coords[j]).sum(axis=1)
        keep = same >= MATCHES
        i, j, same = i[keep], j[keep], same[keep]
        unlike = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1, dtype=np.int64)
        keep = (1000 + self.p) * unlike <= (1000 - self.p) * (self.n[i] + self.n[j])
        return i[keep], j[keep], same[keep]

    def leaders(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row with the first of its list and class of sizes."""
        size = (np.log(self.n) / np.log(1.1)).astype(np.int64)
        first = np.r_[True, (self.group[1:] != self.group[:-1]) | (size[1:] != size[:-1])]
        leader = np.flatnonzero(first)[np.cumsum(first) - 1]
        i, j, _ = self.matches(np.arange(len(size)), leader)
        return i, j

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs with a row that is at home and that may be similar, by chunks; a row's pairs are in one chunk.

        Rows meet those before them; where some rows are not at home, only the others look, at rows on both sides."""
        step, at_home, place = np.int64(1) << 40, self.home.all(), np.arange(len(self.n))
        keys = self.group * step + self.n
        low = np.searchsorted(keys, self.group * step + -(-self.p * self.n // 1000))
        high = place if at_home else np.searchsorted(keys, self.group * step + 1000 * self.n // self.p, side="right")
        width = np.where(self.home, high - low, 0)
        ends, at = np.cumsum(width), 0
        while at < len(low):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            own = width[at:stop]
            i = np.repeat(place[at:stop], own)
            j = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(low[at:stop], own)
            if not at_home:
                once = (j < i) | ~self.home[j]
                i, j = i[once], j[once]
            if len(i):
                yield self.matches(i, j)
            at = stop


def meet(rows: DataFrame, similarity: float, mode: str) -> DataFrame:
    """a, b: pairs of ids that may be similar, from rows of lists (token, salt, id, n, form, root, home, busy).

    mode "screen": each row with its list's first row of a like size and with the best match before it, and (id, null) for
    every row that is in no such pair, but has a match or is of a busy list; so two rows for each at most. "all": those
    matches that join all rows with a match in one list, so fewer than its rows, however many match; busy is not read.
    """
    p, keys = permille(similarity), ["token", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            lists = Lists(table, p, keys)
            if mode == "all":
                lists.tree = Forest(table.num_rows)
                for i, j, _ in lists.pairs():
                    lists.tree.join(i, j)
                found = lists.tree.edges
            else:
                found, some = [lists.leaders()], np.zeros(table.num_rows, dtype=bool)
                for i, j, same in lists.pairs():
                    some[i] = some[j] = True
                    if len(i):
                        best = np.lexsort((-same, i))
                        best = best[np.r_[True, np.diff(i[best]) != 0]]
                        found.append((i[best], j[best]))
            i, j = (np.concatenate(side) for side in zip(*found))
            a, b = np.minimum(lists.ids[i], lists.ids[j]), np.maximum(lists.ids[i], lists.ids[j])
            once = np.unique(np.stack([a, b]), axis=1)
            yield to_batch({"a": (pa.int64(), once[0]), "b": (pa.int64(), once[1])})
            if mode == "screen":
                told = np.setdiff1d(lists.ids[some | table.column("busy").chunk(0).to_numpy(zero_copy_only=False)], once)
                yield to_batch({"a": (pa.int64(), told), "b": (pa.int64(), [None] * len(told))})

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "n", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def permille(similarity: float) -> int:
    """Bounds are compared in whole numbers."""
    return round(1000 * similarity)


def screen(posted: DataFrame, similarity: float, hot: int) -> DataFrame:
    """meet's first round over all lists, written; a list of over `hot` rows is dealt by a salt, all its rows count as matched."""
    rows = posted.select("id", "n", "form", F.explode("own").alias("o")).select("*", "o.token", "o.count").drop("o")
    salts = F.ceil(F.col("count") / hot).cast("int")
    rows = rows.select("token", F.pmod(F.xxhash64("id", "token"), salts).cast("int").alias("salt"), "id", "n", "form", F.col("id").alias("root"), F.lit(True).alias("home"), (salts > 1).alias("busy"))
    return materialize(meet(rows, similarity, "screen"), "screen")


def apart(posted: DataFrame, roots: DataFrame, hot: int) -> DataFrame:
    """token, salt, id, root, home: the rows of lists that hold several roots, written. Rows under a list's largest root do
    not meet each other: of a list of over `hot` rows they are dealt by a salt, and the other rows go to each salt, at home
    in one."""
    rows = posted.select("id", F.explode("own.token").alias("token")).join(roots.withColumnRenamed("node", "id"), "id", "left")
    rows = materialize(rows.select("token", "id", F.coalesce("root", "id").alias("root")), "rooted")
    per = rows.groupBy("token", "root").agg(F.count("*").alias("own"))
    lists = per.groupBy("token").agg(F.sum("own").alias("total"), F.max_by("root", F.struct("own", "root")).alias("largest"), F.count("*").alias("roots")).filter("roots > 1")
    own = rows.join(lists.select("token", "largest", F.ceil(F.col("total") / hot).cast("int").alias("salts")), "token")
    own = own.withColumn("at", F.pmod(F.xxhash64("id", "token"), F.col("salts")).cast("int"))
    every = F.when(F.col("root") == F.col("largest"), F.array("at")).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    dealt = own.select("token", "id", "root", "at", F.explode(every).alias("salt"))
    return materialize(dealt.select("token", "salt", "id", "root", (F.col("salt") == F.col("at")).alias("home")), "apart")


#: Texts are looked up by so many places of their digests, first: what is broadcast is as large at most, at any size of the tables.
PLACES = 1 << 20


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """id, members (ascending 64-bit hashes, packed) of the sets that wanted (id, key, text_key of a row) names, written.

    Texts whose place none of wanted has leave before the exchange, so that few others are moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield to_batch({"id": (pa.int64(), batch.column(1)), "members": (pa.binary(), [shingle_set(word_hashes(t), shingle).tobytes() for t in texts_of(batch)])})

    place = F.pmod(F.xxhash64("text_key"), F.lit(PLACES)).cast("int")
    places = F.broadcast(wanted.select(place.alias("place")).distinct())  # PLACES rows at most
    some = docs.select(*row_key(), "text").withColumn("place", place).join(places, "place", "left_semi")
    own = some.drop("place").dropDuplicates(["key", "text_key"]).join(wanted.select("key", "text_key", "id"), ["key", "text_key"])
    return materialize(own.select("text", "id").mapInArrow(run, "id long, members binary"), "sets")


def alike(u: pa.BinaryScalar, v: pa.BinaryScalar, p: int) -> bool:
    """Whether two packed sets have a Jaccard similarity of p thousandths or more."""
    u, v = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (u, v))
    shared = len(np.intersect1d(u, v, assume_unique=True))
    return 1000 * shared >= p * (len(u) + len(v) - shared)


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs whose whole sets have such a Jaccard similarity or more, written."""
    p = permille(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = [alike(u, v, p) for u, v in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    a, b = (sets.select(F.col("id").alias(c), F.col("members").alias(f"{c}_members")) for c in "ab")
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "a_members", "b_members")
    return materialize(both.mapInArrow(run, "a long, b long"), "similar")


def blocks(matched: DataFrame, roots: DataFrame, forms: DataFrame, hot: int) -> DataFrame:
    """group, x, y, id, root, home of the sets that matched (a, b) joins, written: groups in which any two may be similar.

    A group is dealt into shares of about `hot` rows and SHARE members at most: first shares of its largest root, whose rows
    do not meet each other, then shares of the others. A block is for two shares, x < y; the rows of y, at home, meet each
    other and those of x. So a task holds two shares, however large a group is.
    """
    rows = connected_components(matched).select(F.col("node").alias("id"), F.col("root").alias("group"))
    rows = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").join(forms.select("id", "n"), "id")
    rows = materialize(rows.select("group", "id", F.coalesce("root", "id").alias("root"), "n"), "matched")
    per = rows.groupBy("group", "root").agg(F.count("*").alias("own"), F.sum("n").alias("members"))
    sums = per.groupBy("group").agg(F.max(F.struct("own", "members", "root")).alias("l"), F.sum("own").alias("own"), F.sum("members").alias("members"))
    shares = lambda own, members: F.ceil(F.greatest(F.lit(1), own / hot, members / SHARE)).cast("int")
    sums = sums.select("group", F.col("l.root").alias("largest"), shares(F.col("l.own"), F.col("l.members")).alias("first"), shares(F.col("own") - F.col("l.own"), F.col("members") - F.col("l.members")).alias("rest"))
    own, place, first, last = rows.join(sums, "group"), F.xxhash64("id"), F.col("first"), F.col("first") + F.col("rest") - 1
    inner = F.col("root") == F.col("largest")
    own = own.withColumn("at", F.when(inner, F.pmod(place, first)).otherwise(first + F.pmod(place, "rest")).cast("int"))
    met = own.select("group", "id", "root", "at", F.explode(F.when(inner, F.sequence(first, last)).otherwise(F.sequence(F.lit(0), last))).alias("other")).filter("at <> other")
    return materialize(met.select("group", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"), "id", "root", (F.col("at") > F.col("other")).alias("home")), "blocks")


def settle(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: links of such a similarity that join all roots which any link of a block joins, written; from rows of blocks
    (group, x, y, id, root, home, n, form, members). Whole sets are compared in the tasks, so a block gives fewer links than
    it has roots, however many of its pairs have to be compared."""
    p, keys = permille(similarity), ["group", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 256):
            lists, members = Lists(table, p, keys), table.column("members").chunk(0)
            names, own = np.unique(lists.root, return_inverse=True)
            joined, found = Forest(len(names)), []
            for i, j, same in lists.pairs():
                order = np.argsort(-same, kind="stable")
                for u, v in zip(i[order].tolist(), j[order].tolist()):
                    if joined.root[own[u]] != joined.root[own[v]] and alike(members[u], members[v], p):
                        joined.join(own[[u]], own[[v]])
                        found.append((u, v))
            i, j = np.array(found, dtype=np.int64).reshape(-1, 2).T
            yield to_batch({"a": (pa.int64(), lists.ids[i]), "b": (pa.int64(), lists.ids[j])})

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "n", "id")
    return materialize(dealt.mapInArrow(run, "a long, b long"), "settled")


def links(docs: DataFrame, distinct: DataFrame, shingle: int, similarity: float, *, proposals: DataFrame | None = None, hot: int = 2000) -> DataFrame:
    """a, b: links between ids of distinct that join all pairs of sets of such a similarity, and no others. Written.

    Sets are posted under their rarest coordinate-value pairs. A first round goes through each list and proposes pairs
    that grow with its rows, not with their square, and says which sets have any match; only these are looked at further.
    Then lists whose sets lie in several components say which sets match across components, by matches that join them, and
    the whole sets of each group that these join meet in blocks of bounded size, where every match between different
    components is compared. No round gives more rows than grow with the rows of its lists or blocks. What makes a link is
    the similarity of the whole sets. proposals (a, b) are compared in the first round too.
    """
    posted = postings(distinct)
    told = screen(posted, similarity, hot)
    pairs = told.filter("b IS NOT NULL")
    ids = told.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    if proposals is not None:
        pairs = pairs.unionByName(proposals.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
        ids = ids.unionByName(proposals.select(F.explode(F.array("a", "b")).alias("id")))
    wanted = materialize(distinct.select("id", "key", "text_key", "n", "form").join(ids.distinct(), "id", "left_semi"), "wanted")
    sets, forms = whole_sets(docs, wanted, shingle), wanted.select("id", "n", "form")
    found = similar(pairs, sets, similarity)
    roots = connected_components(found)
    rows = apart(posted.join(wanted.select("id"), "id", "left_semi"), roots, hot)
    if rows.isEmpty():
        return found
    matched = materialize(meet(rows.join(forms, "id"), similarity, "all"), "matches")
    met = blocks(matched, roots, forms, hot).join(forms, "id").join(sets, "id")
    return materialize(found.unionByName(settle(met, similarity)), "links")


def near_components(docs: DataFrame, *, shingle: int = 2, similarity: float = 0.8, hot: int = 2000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: components of texts whose sets of shingles have such a similarity or more.

    component_id is the smallest doc_id that links reach, the row's own included; kept says that it is the row's own. Rows
    with equal sets are one node, known by 128-bit digests, so copies cost nothing further. Null texts and texts without
    words have the empty set and are linked with nothing: each such row stands for itself. A null doc_id is a component_id
    only where its component has no other (then null, and kept); rows that repeat a doc_id each get a row; an empty table
    gives an empty result; other columns are not read.
    """
    with passing_tables(docs.sparkSession) as keep:
        told = materialize(features(docs, shingle), "features")
        distinct = distinct_sets(told)
        roots = connected_components(links(docs, distinct, shingle, similarity, hot=hot))
        first = told.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")).join(distinct.select("node", "id"), "node")
        keep += [told, components_of(first, "id", roots, out="node")]
    rows = keep[0].select("doc_id", "node", F.col("n").alias("n_shingles")).join(keep[1], "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

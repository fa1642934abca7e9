"""Exact Jaccard self-join of word n-gram sets by prefix trees, as linked components.

1. **Sets.** Every text becomes the set of hashes of its n-grams. Texts with one and the same
   set are one node from here on, found by a digest of the set.
2. **Dealing.** Two sets of sizes a <= b with a similarity of at least num/den differ in at most
   d = (den-num)(a+b)/(den+num) elements. Elements are dealt to m > d parts by hash; one part at
   least is then the same in both, so a hash of each part is a key that linked sets share. Sizes
   are cut into steps so that linked sets lie in one step or in neighbouring ones, which fixes m
   for both. A few parts more than d + 1 let empty parts go without a key; a set with more empty
   parts than that keeps their keys.
3. **Neighbourhoods.** Keys that one set holds are dropped, and of keys with the same sets one is
   kept. What is left is a small share of all keys; the sets of each are told apart by profiles,
   counts of their elements by hash, whose overlap bounds that of the sets: sets whose profiles
   overlap too little cannot be linked. The components of the ties that remain are the groups to
   compare. Sets of a key that more than ``MANY`` have are all tied, untested. A group with more
   than ``cell`` elements is cut by size step and hash into blocks, and pairs of blocks that can
   hold linked sets are tasks of their own, so no task grows with a group and no pair is left out.
4. **Prefix tree.** A task orders the n-grams of its group, rare ones first, and stores the
   ordered sets in a trie, so that sets share the path of their common start and unlike sets are
   left soon. Linked sets share an n-gram among the first of either's order, so a set is laid
   along the paths to sets that share one, once: nodes add to the overlap of their parent, and a
   subtree is left when its overlap so far plus the least of what remains of the set and of the
   subtree's longest set cannot reach what its shortest set demands. Links are joined in place,
   and a task returns a spanning forest, never the pairs.
5. **Components** of all links, by least doc_id.

Words are runs of anything but ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a text of fewer than n words has one
n-gram, the whole sequence. N-grams are compared as 64-bit hashes.

Defined results: a text without words, empty or null has an empty set and is linked with
nothing. A row without doc_id takes no part; its component_id is null. Rows that repeat a doc_id
are one document, whose links are those of all its texts. Empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.components import components
from lorebase.llm.frames import tidy
from lorebase.llm.words import Words, as_bytes, mix, pieces
from lorebase.session import broadcast_if_small, materialize

CELL = 1 << 18
"""Elements of all sets that one trie task holds."""
MANY = 4096
"""Sets of one key up to which a task tests their profiles."""
LARGE_TRIE = 1 << 15
"""From so many elements on, nodes of a trie are cut into links of at most ``LINK``."""
LINK = 64


# -- sets and keys -------------------------------------------------------------------------


def gram_sets(texts: pa.Array, n: int):
    """The sorted set of n-gram hashes of every text, in order."""
    data, offsets = as_bytes(texts)
    for lo, hi in pieces(offsets):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        grams, at = words.grams(n)
        cut = np.searchsorted(at, words.first)
        for k in range(hi - lo):
            count = int(words.count[k])
            if count >= n:
                yield np.unique(grams[cut[k] : cut[k + 1]])
            elif count:
                whole = words.hash[words.first[k] : words.first[k + 1]]
                yield mix(np.array([sum(int(h) * (j + 3) for j, h in enumerate(whole)) % 2**64 + count], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


class Dealer:
    """Keys of a set for a similarity of num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.steps = [1]

    def step(self, size: int) -> int:
        """The size step of ``size``: linked sets are in one step or in neighbouring ones."""
        while self.steps[-1] <= size:
            self.steps.append(self.steps[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.steps, size, "right")) - 1

    @lru_cache(maxsize=4096)  # noqa: B019
    def parts(self, step: int) -> tuple[int, int]:
        """(parts, empty parts that may go without a key) for a set of ``step`` and one of it or the next step."""
        while len(self.steps) <= step + 2:
            self.steps.append(self.steps[-1] * self.den // self.num + 1)
        most = self.steps[step + 1] + self.steps[step + 2] - 2  # elements of two sets, one of either step
        differ = (self.den - self.num) * most // (self.den + self.num)
        if not differ:
            return 0, 0  # only equal sets are similar enough
        spare = 1 + differ // 12
        return differ + 1 + spare, spare

    def keys(self, grams: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.zeros(0, np.int64)
        here, found = self.step(len(grams)), []
        low, high = (grams & np.uint64(0xFFFFFFFF)).astype(float), (grams >> np.uint64(32)).astype(float)
        for step in (here - 1, here):
            if step < 0 or not (parts := self.parts(step))[0]:
                continue
            m, spare = parts
            part = (mix(grams + np.uint64(step + 1)) % np.uint64(m)).astype(np.int64)
            size = np.bincount(part, minlength=m)
            total = np.bincount(part, low, m).astype(np.uint64) + (np.bincount(part, high, m).astype(np.uint64) << np.uint64(32))
            key = mix(mix(total + size.astype(np.uint64)) + np.uint64(step * 0x10000001) + (np.arange(m, dtype=np.uint64) << np.uint64(24)))
            empty = size == 0
            found.append(key[~empty] if empty.sum() <= spare else key)
        return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def profile(grams: np.ndarray) -> bytes:
    """How many elements each of 2^k hash classes has, about three on average; nothing if a byte can't hold that."""
    if not len(grams):
        return b""
    classes = 1 << min(12, max(4, (len(grams) // 3).bit_length()))
    counts = np.bincount((mix(grams) >> np.uint64(40)).astype(np.int64) & (classes - 1), minlength=classes)
    return counts.astype(np.uint8).tobytes() if counts.max() < 255 else b""


def digest(grams: np.ndarray) -> bytes:
    return blake2b(grams.tobytes(), digest_size=16).digest()


def mark(grams: np.ndarray) -> int:
    """The first half of the digest. Sets with one mark are candidates together; what they are is seen by the digest."""
    return int.from_bytes(digest(grams)[:8], "little", signed=True)


def set_table(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, step, digest, mark, profile) of every row."""

    def make(batches):
        dealer = Dealer(num, den)
        for batch in batches:
            rows = [(len(g), dealer.step(len(g)) if len(g) else -1, digest(g), mark(g), profile(g)) for g in gram_sets(batch.column("text"), n)]
            sizes, steps, digests, marks, profiles = zip(*rows) if rows else ((),) * 5
            kinds = (sizes, pa.int64()), (steps, pa.int32()), (digests, pa.binary()), (marks, pa.int64()), (profiles, pa.binary())
            arrays = [batch.column("doc_id"), *[pa.array(values, kind) for values, kind in kinds]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "step", "digest", "mark", "profile"])

    return docs.mapInArrow(tidy(make), "doc_id long, n_shingles long, step int, digest binary, mark long, profile binary")


def shared_keys(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(key, mark) of the keys that several sets have. One shuffle moves each key of a set once a batch."""

    def make(batches):
        dealer = Dealer(num, den)
        for batch in batches:
            held = {mark(grams): dealer.keys(grams) for grams in gram_sets(batch.column("text"), n) if len(grams)}
            marks = np.repeat(np.fromiter(held, np.int64, len(held)), [len(k) for k in held.values()])
            keys = np.concatenate([*held.values(), np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(marks)], names=["key", "mark"])

    rows = docs.mapInArrow(tidy(make), "key long, mark long")
    by_key = Window.partitionBy("key").orderBy("mark")
    beside = rows.withColumns({"before": F.lag("mark").over(by_key), "after": F.lead("mark").over(by_key)})
    return beside.filter("before != mark OR after != mark").select("key", "mark").distinct()


def tied_by_profile(sizes: np.ndarray, profiles: list[bytes], num: int, den: int) -> np.ndarray:
    """Numbers that are the same for sets which may be linked, directly or by others."""
    root = np.arange(len(sizes))
    classes = min((len(p) for p in profiles if p), default=1)
    table = np.stack([np.frombuffer(p, np.uint8).astype(np.int32).reshape(-1, classes).sum(axis=0) if p else np.full(classes, 1 << 30, np.int32) for p in profiles])
    step = max(1, (1 << 20) // classes)
    for k in range(len(sizes) - 1):
        others = k + 1 + np.flatnonzero(root[k + 1 :] != root[k])
        overlap = np.zeros(len(others), np.int64)
        for lo in range(0, len(others), step):
            overlap[lo : lo + step] = np.minimum(table[others[lo : lo + step]], table[k]).sum(axis=1)
        may = others[(num + den) * overlap >= num * (sizes[others] + sizes[k])]
        if len(may):
            root[np.isin(root, root[may])] = root[k]
    return root


def neighbours(shared: DataFrame, nodes: DataFrame, num: int, den: int, many: int = MANY) -> DataFrame:
    """(a, b): marks of sets that share a key and, where that was tested, enough of their profiles."""
    members = [F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("mark", F.lit(k))).alias(f"x{k}") for k in (1, 2)]]
    alike = shared.groupBy("key").agg(*members).groupBy("n", "x1", "x2").agg(F.min("key").alias("key"))
    alike = materialize(alike.select("key", "n"), "gram-keys")
    groups = shared.join(alike, "key")
    large = groups.filter(F.col("n") > many)
    hubs = large.join(large.groupBy("key").agg(F.min("mark").alias("a")), "key").select("a", F.col("mark").alias("b")).filter("a != b")
    known = nodes.select("mark", "n_shingles", "profile")
    rows = groups.filter(F.col("n") <= many).join(known, "mark").repartition("key").sortWithinPartitions("key")

    def test(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            if table.num_rows:
                rest = yield from groups_of(table, False)
        if rest is not None:
            yield from groups_of(rest, True)

    def groups_of(table, last):
        """Test the groups of a table; the last one waits for its further rows. Returns what waits."""
        table = table.combine_chunks()
        keys, marks, sizes = (table.column(c).to_numpy() for c in ("key", "mark", "n_shingles"))
        profiles = table.column("profile").to_pylist()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        found = []
        for lo, hi in zip(cuts[:-1], cuts[1:] if last else cuts[1:-1]):
            root = tied_by_profile(sizes[lo:hi], profiles[lo:hi], num, den)
            _, first = np.unique(root, return_index=True)
            hub = marks[lo:hi][first][np.searchsorted(root[first], root)]
            found.append(np.stack([hub, marks[lo:hi]])[:, hub != marks[lo:hi]])
        a, b = np.concatenate([*found, np.zeros((2, 0), np.int64)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        return None if last else table.slice(cuts[-2])

    tested = rows.select("key", "mark", "n_shingles", "profile").mapInArrow(tidy(test), "a long, b long")
    return tested.unionByName(hubs).distinct()


# -- prefix tree ---------------------------------------------------------------------------


class Trie:
    """Ordered sets in a path-compressed prefix tree, nodes in order of their depth."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        ordered = [np.sort(x) for x in np.split(rank[token], np.cumsum(sizes)[:-1])]
        by_content = sorted(range(len(sets)), key=lambda k: ordered[k].astype(">i8").tobytes())
        self.sets, self.has = ordered, np.zeros(len(count), np.int64)  # which n-grams the set in hand has
        parent, begin, end, holder = [-1], [0], [0], np.zeros(len(sets), np.int64)
        stack = [0]  # nodes on the path of the set before
        flat, before = [], None
        for k in by_content:
            s = ordered[k]
            same = 0
            if before is not None:
                both = min(len(s), len(before))
                differ = np.flatnonzero(s[:both] != before[:both])
                same = int(differ[0]) if len(differ) else both
            last = None
            while end[stack[-1]] > same:
                last = stack.pop()
            if last is not None and begin[last] < same:  # the common path ends inside this node
                upper = len(parent)
                parent.append(parent[last])
                begin.append(begin[last])
                end.append(same)
                flat.append((upper, before, begin[last], same))
                parent[last], begin[last] = upper, same
                stack.append(upper)
            if len(s) > end[stack[-1]]:
                new = len(parent)
                parent.append(stack[-1])
                begin.append(end[stack[-1]])
                end.append(len(s))
                flat.append((new, s, 0, 0))
                stack.append(new)
            holder[k] = stack[-1]
            before = s
        self._finish(*self._cut(parent, begin, end, {node: s for node, s, *_ in flat}, holder, sizes.sum()), sizes)

    @staticmethod
    def _cut(parent, begin, end, source, holder, elements):
        """In a large trie long nodes become chains, so that a set can leave them early."""
        if elements < LARGE_TRIE:
            return np.array(parent), np.array(begin), np.array(end), source, holder
        out, last, sources = ([], [], []), np.zeros(len(parent), np.int64), {}
        for node in np.argsort(end, kind="stable"):  # parents end before their children
            above = last[parent[node]] if parent[node] >= 0 else -1
            for at in range(begin[node], max(end[node], begin[node] + 1), LINK):
                if node in source:
                    sources[len(out[0])] = source[node]
                for field, value in zip(out, (above, at, min(at + LINK, end[node]))):
                    field.append(value)
                above = len(out[0]) - 1
            last[node] = above
        return *map(np.array, out), sources, last[holder]

    def _finish(self, parent, begin, end, source, holder, sizes):
        depth = np.zeros(len(parent), np.int64)
        for node in np.argsort(end, kind="stable"):  # parents end before their children
            depth[node] = depth[parent[node]] + 1 if parent[node] >= 0 else 0
        order = np.argsort(depth, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.parent = np.where(parent[order] >= 0, place[parent[order]], 0)
        self.end = end[order]
        segments = [source[v][begin[v] : end[v]] if v in source else np.zeros(0, np.int64) for v in order]
        self.flat = np.concatenate(segments)
        self.segment = np.concatenate([[0], np.cumsum([len(x) for x in segments])])
        self.last = np.array([x[-1] if len(x) else -1 for x in segments])
        self.level = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        self.holder, self.sizes = place[holder], sizes
        self.overlap, self.starts = np.full(len(order), -1), None
        by_holder = np.argsort(self.holder, kind="stable")
        self.by_holder = by_holder, self.holder[by_holder]
        self.shortest, self.longest = np.full(len(order), np.iinfo(np.int64).max), np.zeros(len(order), np.int64)
        np.minimum.at(self.shortest, self.holder, sizes)
        np.maximum.at(self.longest, self.holder, sizes)
        for node in range(len(order) - 1, 0, -1):
            p = self.parent[node]
            self.shortest[p] = min(self.shortest[p], self.shortest[node])
            self.longest[p] = max(self.longest[p], self.longest[node])

    def _starting(self, num: int, den: int) -> None:
        """Which sets have an n-gram among their first, of which linked sets share one."""
        first = [s[: len(s) - -(-num * len(s) // den) + 1] for s in self.sets]
        token, owner = np.concatenate(first), np.repeat(np.arange(len(first)), [len(f) for f in first])
        order = np.argsort(token, kind="stable")
        self.starts = num, den, first, owner[order], np.searchsorted(token[order], np.arange(len(self.has) + 1))

    def _paths(self, k: int) -> np.ndarray:
        """Nodes on the paths to the sets that share one of the first n-grams of set ``k``, in order."""
        _, _, first, owner, cut = self.starts
        lo, hi = cut[first[k]], cut[first[k] + 1]
        size = hi - lo
        begin = np.cumsum(size) - size
        nodes = np.unique(self.holder[np.unique(owner[np.repeat(lo - begin, size) + np.arange(size.sum())])])
        found = [nodes]
        while len(nodes) > 1 or nodes[0]:
            nodes = np.unique(self.parent[nodes])
            found.append(nodes)
        return np.unique(np.concatenate(found))

    def similar(self, k: int, num: int, den: int) -> np.ndarray:
        """Sets whose similarity to set ``k`` is at least num/den, itself included."""
        if self.starts is None or self.starts[:2] != (num, den):
            self._starting(num, den)
        s, has, overlap, paths = self.sets[k], self.has, self.overlap, self._paths(k)
        has[s] = 1
        overlap[0] = 0
        level = np.searchsorted(paths, self.level)
        for lo, hi in zip(level[1:-1], level[2:]):
            above = overlap[self.parent[paths[lo:hi]]]
            here = paths[lo:hi][above >= 0]
            if not len(here):
                break
            size = self.segment[here + 1] - self.segment[here]
            begin = np.cumsum(size) - size
            every = np.repeat(self.segment[here] - begin, size) + np.arange(size.sum())
            reach = above[above >= 0] + np.add.reduceat(has[self.flat[every]], begin)
            left = len(s) - np.searchsorted(s, self.last[here], "right")
            most = reach + np.minimum(left, self.longest[here] - self.end[here])
            alive = (num + den) * most >= num * (len(s) + self.shortest[here])
            overlap[here[alive]] = reach[alive]
        has[s] = 0
        near = self._held(paths[overlap[paths] >= 0])
        own = overlap[self.holder[near]]
        overlap[paths] = -1
        return near[(num + den) * own >= num * (len(s) + self.sizes[near])]

    def _held(self, nodes: np.ndarray) -> np.ndarray:
        """The sets that end at the nodes, in order."""
        lo, hi = np.searchsorted(self.by_holder[1], nodes), np.searchsorted(self.by_holder[1], nodes, "right")
        size = hi - lo
        begin = np.cumsum(size) - size
        return np.sort(self.by_holder[0][np.repeat(lo - begin, size) + np.arange(size.sum())])


def link_forest(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least id of the linked sets, id) for every set that is not the least, and each set's links."""
    trie, root = Trie(sets), np.arange(len(ids))
    links = np.zeros(len(ids), np.int64)
    for k in range(len(ids)):
        found = trie.similar(k, num, den)
        links[k] = len(found) - 1
        roots = np.unique(root[found])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    least = pd.Series(ids).groupby(root).transform("min").to_numpy()
    return least, ids, links


# -- the operator --------------------------------------------------------------------------


def _cells(members: DataFrame, cell: int) -> DataFrame:
    """(mark, comp, cells): the tasks that a set takes part in."""
    room = members.groupBy("comp", "step").agg(F.sum("n_shingles").alias("elements"))
    whole = room.groupBy("comp").agg(F.sum("elements").alias("all"))
    large = whole.filter(F.col("all") > cell).select("comp")
    small = members.join(large, "comp", "left_anti").withColumn("cells", F.array(F.lit("0")))
    # A block holds half a cell at most, give or take the hash; two blocks make a task.
    blocks = room.join(large, "comp", "left_semi").select(
        "comp", "step", F.ceil(F.col("elements") * 2 / cell).cast("int").alias("n"))
    beside = blocks.select("comp", (F.col("step") - 1).alias("step"), F.col("n").alias("above"))
    below = blocks.select("comp", (F.col("step") + 1).alias("step"), F.col("n").alias("below"))
    cut = members.join(blocks, ["comp", "step"]).join(beside, ["comp", "step"], "left").join(below, ["comp", "step"], "left")
    mine = F.pmod(F.xxhash64("mark"), F.col("n")).cast("int")

    def name(step, a, b):
        return F.concat_ws(":", step.cast("string"), a.cast("string"), b.cast("string"))

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    same = F.transform(upto(F.col("n")), lambda j: name(F.col("step") * 2, F.least(mine, j), F.greatest(mine, j)))
    up = F.transform(upto(F.coalesce("above", F.lit(0))), lambda j: name(F.col("step") * 2 + 1, mine, j))
    down = F.transform(upto(F.coalesce("below", F.lit(0))), lambda j: name(F.col("step") * 2 - 1, j, mine))
    return small.select("mark", "comp", "cells").unionByName(cut.select("mark", "comp", F.concat(same, up, down).alias("cells")))


def linked_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, cell: int = CELL,
    many: int = MANY,
) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for every row of ``docs``."""
    docs = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    sets = materialize(set_table(docs, n, num, den), "gram-sets")
    known = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # A node is a set; ids of nodes are fixed by writing them.
    same = [F.any_value(c).alias(c) for c in ("n_shingles", "step", "mark", "profile")]
    nodes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), *same)
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "gram-nodes")

    shared = materialize(shared_keys(docs.filter("doc_id IS NOT NULL"), n, num, den), "gram-shared")
    near = components(neighbours(shared, nodes, num, den, many))
    ends = near.select(F.col("hi").alias("mark"), F.col("lo").alias("comp")).unionByName(near.select(F.col("lo").alias("mark"), F.col("lo").alias("comp")).distinct())
    sized = materialize(nodes.select("mark", "rep", "step", "n_shingles").join(ends, "mark"), "gram-sized")
    dealt = sized.select("mark", "rep").join(_cells(sized.drop("rep").distinct(), cell), "mark").withColumnRenamed("rep", "doc_id")
    dealt = materialize(dealt, "gram-cells")

    def to_sets(batches):
        seen = set()
        for batch in batches:
            grams, own = list(gram_sets(batch.column("text"), n)), []
            for g, m in zip(grams, batch.column("mark").to_pylist(), strict=True):
                # Of a doc_id that is repeated with other texts the one that is meant, and of equal rows one a task.
                this = mark(g) == m and (name := digest(g)) not in seen
                own.append(this)
                if this:
                    seen.add(name)
            own = pa.array(own, pa.bool_())
            blobs = pa.array([g.tobytes() for g in grams], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("comp"), batch.column("cells"), blobs], names=["comp", "cells", "grams"]).filter(own)

    texts = docs.join(broadcast_if_small(dealt), "doc_id").select("mark", "comp", "cells", "text")
    full = texts.mapInArrow(tidy(to_sets), "comp long, cells array<string>, grams binary")

    def join_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        blobs = pdf["grams"].drop_duplicates().to_numpy()
        none = pd.DataFrame({"lo": [], "hi": []}, dtype=object)
        if len(blobs) < 2:
            return none
        lo, hi, _ = link_forest(np.arange(len(blobs)), [np.frombuffer(g, np.uint64) for g in blobs], num, den)
        names = np.array([blake2b(g, digest_size=16).digest() for g in blobs], object)
        return pd.DataFrame({"lo": names[lo[lo != hi]], "hi": names[hi[lo != hi]]}) if (lo != hi).any() else none

    cells = full.select("comp", F.explode("cells").alias("cell"), "grams").groupBy("comp", "cell")
    found = materialize(cells.applyInPandas(join_cell, "lo binary, hi binary"), "gram-links")
    links = found.distinct().join(nodes.select(F.col("digest").alias("lo"), F.col("node").alias("a")), "lo")
    links = links.join(nodes.select(F.col("digest").alias("hi"), F.col("node").alias("b")), "hi").select("a", "b")

    # Rows that repeat a doc_id with other texts tie the nodes of those texts.
    texts_of = known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a != b").select("doc_id")
    several = known.join(broadcast_if_small(materialize(texts_of, "gram-repeats")), "doc_id").select("doc_id", "digest").distinct()
    several = materialize(several.join(nodes.select("digest", "node"), "digest").select("doc_id", "node"), "gram-several")
    ties = several.join(several.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
    label = components(links.unionByName(ties))

    named = nodes.select("digest", "rep", "node").join(label, nodes["node"] == label["hi"], "left")
    named = materialize(named.select("digest", "rep", F.coalesce("lo", "node").alias("class")), "gram-classes")
    least = named.groupBy("class").agg(F.min("rep").alias("component"))
    named = named.join(least, "class").select("digest", "component")
    rows = sets.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(named, "digest", "left").select("doc_id", "n_shingles", own.alias("component_id"))

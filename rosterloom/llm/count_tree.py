"""N-gram Jaccard join of documents over an R-tree of count vectors.

Each text is its set of distinct word shingles. The shingles are dealt by hash to groups, of which
large sets have more, and the counts of the groups make the set a point. Two sets can have no more in common than the
sum of the smaller count of each group, and a set no more with any set of a box of points than
with the box's upper corner; pairs that could still be similar enough are verified on the
shingles themselves. Classes are the connected components of the links.

Points meet only where a link is possible at all: of two similar sets, some of the first shingles
in the order of hashes are common, so the points with one such shingle are one bucket, and buckets
of equal members are one. A set with too few shared ones has no link. Which shingles are shared is counted on their hashes
alone, before nodes go along; texts are read again, and only for the nodes that are left. A bucket's points are linked to its most typical one first;
what is then in buckets of several classes goes into fewer buckets, as similar texts share many, so
that a pair meets about once. Points there whose shingles could be common with another
class in sufficient number are packed into pages of bounded size, pages of a bucket and of near
sizes meet, and each pair of pages is searched by a tree of boxes. No link between classes is
lost, and none of the steps needs a bucket in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.llm.near_dup import components
from rosterloom.llm.shared import among, cut, few, stored, with_row_id
from rosterloom.llm.words import LOWER, SPACED, bounds, distinct_grams, hashes, slices

#: GROUPS is the least number of groups.
SHINGLE, PERCENT, GROUPS = 5, 80, 128
#: Points of a page, about; and boxes or points in a box of the tree.
PAGE, FAN = 512, 16
#: Rounds in which nodes that share too little go.
PRUNE = 2
#: One in so many shingles is looked at beyond those that must include a common one, so that more have to be common.
EXTRA = 10
#: Bits of a shingle's hash that name its bucket. Shingles with equal ones add candidates and lose none.
NAMED = 40
#: Pairs of a point and a box that are bounded at once, and pairs of pages that are unpacked at once.
CHUNK, PAIRS = 1 << 13, 64
_MOST = np.iinfo(np.uint8).max
_NAME = np.uint64((1 << NAMED) - 1)


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct shingles of spaced words in lower case, by owner and hash."""
    lowered = LOWER[data]
    starts, ends, owner = bounds(lowered, offsets, SPACED)
    of, codes, _ = distinct_grams(hashes(lowered, starts, ends), owner, len(offsets) - 1, SHINGLE)
    return of, codes


def _first(size, percent: int):
    """How many of a set's shingles, in one order, are sure to include ``least_shared`` that a similar set has there too."""
    return np.minimum(size, size + (-percent * size // 100) + 1 + size // EXTRA)


def least_shared(size: Column, percent: int) -> Column:
    """How many of a set's first shingles are in those of a similar set, which may be as small as ``percent`` of it."""
    smallest = F.ceil(percent * size / 100 - 1e-9).cast("long")
    return F.floor(smallest / EXTRA).cast("long") + 1


def _points(percent: int):
    """Rows with the size, digest, first shingles and group counts of their sets."""
    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column(batch.schema.get_field_index("text"))):
                n = len(offsets) - 1
                of, codes = _sets(data, offsets)
                size = np.bincount(of, minlength=n)
                edges = np.concatenate(([0], np.cumsum(size)))
                rank = np.arange(len(of)) - edges[of]
                first = rank < _first(size, percent)[of]
                starts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of[first], minlength=n)))).astype(np.int32))
                counts = _counts(of, codes, size)
                digests = [xxhash.xxh3_128_digest(codes[a:b].tobytes()) if b > a else None for a, b in zip(edges[:-1], edges[1:])]
                piece = batch.slice(row, n)
                own = [pa.array(size), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(starts, pa.array((codes[first] & _NAME).view(np.int64))), pa.array(counts, pa.binary())]
                names = [name for name in piece.schema.names if name != "text"]
                yield pa.RecordBatch.from_arrays([*(piece.column(name) for name in names), *own], names=[*names, "size", "digest", "first", "counts"])

    return run


def _shingles(batches):
    """The rows with their shingles in place of their text."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        names = [name for name in batch.schema.names if name != "text"]
        for row, data, offsets in slices(batch.column(at)):
            n = len(offsets) - 1
            of, codes = _sets(data, offsets)
            edges = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
            piece = batch.slice(row, n)
            yield pa.RecordBatch.from_arrays([*(piece.column(name) for name in names), pa.ListArray.from_arrays(edges, pa.array(codes.view(np.int64)))], names=[*names, "shingles"])


def groups_of(size: np.ndarray) -> np.ndarray:
    """A large set has more groups, a power of two, so that unrelated sets differ in their counts at any size."""
    return np.maximum(GROUPS, 1 << np.ceil(np.log2(np.maximum(size, 1) / 8)).astype(np.int64))


def _counts(of: np.ndarray, codes: np.ndarray, size: np.ndarray) -> list[bytes | None]:
    """The group counts of each set, null for an empty one."""
    out: list[bytes | None] = [None] * len(size)
    groups = groups_of(size)
    for g in np.unique(groups[size > 0]).tolist():
        texts = np.flatnonzero((groups == g) & (size > 0))
        own = groups[of] == g
        counts = np.bincount(np.searchsorted(texts, of[own]) * g + (codes[own] & np.uint64(g - 1)).astype(np.int64), minlength=len(texts) * g)
        for i, row in zip(texts, np.minimum(counts, _MOST).astype(np.uint8).reshape(-1, g)):
            out[i] = row.tobytes()
    return out


class Points:
    """Sets as points: ``counts`` of the first ``GROUPS`` groups, to which finer counts fold, ``size``, and the finer ones."""

    def __init__(self, vectors: list[bytes], size: np.ndarray):
        self.size, self._fine = size, [np.frombuffer(v, np.uint8) for v in vectors]
        self.groups = np.array([len(v) for v in self._fine], np.int64)
        self.counts = self.folded(range(len(vectors)), GROUPS)

    def folded(self, rows, groups: int) -> np.ndarray:
        """The counts of ``rows`` by ``groups`` groups, which they have at least."""
        out = np.zeros((len(rows), groups), np.int32)
        for k, i in enumerate(rows):
            fine = self._fine[i]
            out[k] = fine if len(fine) == groups else fine.reshape(-1, groups).sum(axis=0, dtype=np.int32)
        return out


def finer(a: Points, b: Points, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether the pairs of ``a``'s points ``x`` and ``b``'s points ``y`` can be similar enough by the finest groups that both have."""
    out, common = np.ones(len(x), bool), np.minimum(a.groups[x], b.groups[y])
    for g in np.unique(common[common > GROUPS]).tolist():
        at, step = np.flatnonzero(common == g), max(1, CHUNK * GROUPS // g)
        for part in (at[k : k + step] for k in range(0, len(at), step)):
            out[part] = able(a.folded(x[part], g), b.folded(y[part], g), a.size[x[part]], b.size[y[part]], percent)
    return out


def able(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set with counts ``a`` can be similar enough to one with counts ``b``, or to any within the upper corner ``b``.

    ``b_size`` is the least size there. A count that is at its type's end may be larger.
    """
    common = np.minimum(a, b)
    return ((100 + percent) * common.sum(axis=1, dtype=np.int64) >= percent * (a_size + b_size)) | (common >= _MOST).any(axis=1)


class Tree:
    """An R-tree of points, packed: by size into slabs, and in a slab by the coordinate that varies most."""

    def __init__(self, points: Points):
        self.points, counts, size = points, points.counts, points.size
        n = len(size)
        slab = FAN * max(1, int(np.ceil(np.sqrt(n / FAN))))
        order = np.argsort(size, kind="stable")
        for at in range(0, n, slab):
            own = order[at : at + slab]
            order[at : at + slab] = own[np.argsort(counts[own, counts[own].var(axis=0).argmax()], kind="stable")]
        self.order = order
        #: From the points up: upper corner, least and largest size of each box.
        self.levels = [(counts[order], size[order], size[order])]
        while len(self.levels[-1][0]) > FAN:
            upper, least, most = self.levels[-1]
            heads = np.arange(0, len(least), FAN)
            self.levels.append((np.maximum.reduceat(upper, heads), np.minimum.reduceat(least, heads), np.maximum.reduceat(most, heads)))

    def near(self, queries: Points, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of queries and points that can be similar enough."""
        counts, size = queries.counts, queries.size
        top = len(self.levels[-1][1])
        query, box = np.repeat(np.arange(len(size)), top), np.tile(np.arange(top), len(size))
        for level in range(len(self.levels) - 1, -1, -1):
            upper, least, most = self.levels[level]
            fits = (100 * most[box] >= percent * size[query]) & (100 * size[query] >= percent * least[box])
            query, box = query[fits], box[fits]
            parts = [slice(at, at + CHUNK) for at in range(0, len(query), CHUNK)]
            good = np.concatenate([able(counts[query[p]], upper[box[p]], size[query[p]], least[box[p]], percent) for p in parts] or [np.zeros(0, bool)])
            query, box = query[good], box[good]
            if level:
                below = len(self.levels[level - 1][1])
                box = (box[:, None] * FAN + np.arange(FAN)).reshape(-1)
                query = np.repeat(query, FAN)
                query, box = query[box < below], box[box < below]
        point = self.order[box]
        good = finer(queries, self.points, query, point, percent)
        return query[good], point[good]


def _page(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, Points]:
    node, label, size = (np.array([r[k] for r in rows], np.int64) for k in ("node", "label", "size"))
    return node, label, Points([r["counts"] for r in rows], size)


def _page_pairs(percent: int, whole: bool):
    """Pairs of nodes of different classes of two pages, or of one page, that can be similar enough; or, not ``whole``, the nodes of such pairs."""
    def run(batches):
        for batch in (whole_batch.slice(k, PAIRS) for whole_batch in batches for k in range(0, len(whole_batch), PAIRS)):
            x, y = (batch.column(i).to_pylist() for i in (0, 1))
            a, b = [], []
            for left, right in zip(x, y):
                node, label, queries = _page(left)
                other, named, points_ = (node, label, queries) if right is None else _page(right)
                query, point = Tree(points_).near(queries, percent)
                apart = (label[query] != named[point]) & ((query < point) | (right is not None))
                a.append(node[query[apart]])
                b.append(other[point[apart]])
            found = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b)]
            found = found if whole else [np.unique(np.concatenate(found))]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["x", "y"] if whole else ["node"])

    return run


def _able_pairs(percent: int):
    """Of pairs (x, y, counts and sizes of both) those that can be similar enough."""
    def run(batches):
        for batch in (whole.slice(k, CHUNK) for whole in batches for k in range(0, len(whole), CHUNK)):
            sizes = [batch.column(i).to_numpy() for i in (4, 5)]
            batch = batch.filter(pa.array(100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)))
            a, b = (Points(batch.column(i).to_pylist(), batch.column(i + 2).to_numpy()) for i in (2, 3))
            near = np.flatnonzero(able(a.counts, b.counts, a.size, b.size, percent))
            near = pa.array(near[finer(a, b, near, near, percent)])
            yield pa.RecordBatch.from_arrays([batch.column(i).take(near) for i in (0, 1)], names=["x", "y"])

    return run


def points(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """_row, doc_id, key, size, digest, first and counts of every row of ``documents``, written once; the last three are null for texts without words.

    ``key`` stands for the text, of which no copy is written.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = with_row_id(documents.select("doc_id", "text")).select("_row", "doc_id", text_key().alias("key"), "text")
    return stored(rows.mapInArrow(_points(percent), f"_row long, doc_id {kind}, key binary, size long, digest binary, first array<long>, counts binary"))


def text_key() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def texts_of(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, key and others), which are of different keys, with the text of each in place of its key."""
    texts = among(documents.select(text_key().alias("key"), "text"), nodes.select("key"), "key")
    return nodes.join(texts.groupBy("key").agg(F.first("text").alias("text")), "key").drop("key")


def buckets(nodes: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(bucket, node) of the nodes that share enough first shingles, and (node, alone), the share of a node's first shingles that no other has there.

    Shingles with the same nodes are one bucket. A node that shares too few to be similar to any
    other goes, and then those that shared too many with such nodes only.
    """
    entries = nodes.select("node", F.explode("first").alias("bucket"))
    # Most shingles are of one set only: their nodes are not dealt out.
    shared = stored(entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"))
    entries = stored(among(entries, shared, "bucket"))
    held = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.hash("node").cast("long")).alias("sum"), F.bit_xor(F.xxhash64("node")).alias("xor"))
    held = stored(held.groupBy("n", "sum", "xor").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times")).select("bucket", "times"))
    members, sizes = stored(entries.join(few(held), "bucket")), nodes.select("node", "size", F.size("first").alias("n_first"))
    for _ in range(PRUNE):
        shared = members.groupBy("node").agg(F.sum("times").alias("shared")).join(sizes, "node")
        alone = stored(shared.filter(F.col("shared") >= least_shared(F.col("size"), percent)).select("node", (1 - F.col("shared") / F.col("n_first")).alias("alone")))
        members = stored(members.join(few(alone.select("node")), "node"))
        pairs = stored(members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket"))
        members = stored(members.join(few(pairs), "bucket"))
    return members.select("bucket", "node"), alone


def merged(entries: DataFrame) -> DataFrame:
    """Distinct (bucket, node) in fewer buckets, such that any two nodes of a bucket of ``entries`` (bucket, node) are in one of them too.

    A node's top bucket is its largest one. A bucket goes into the smallest of its nodes' top
    buckets, so that the many buckets of a group of similar texts become a few. Buckets that have
    more pairs of nodes together than one by one stay as they are.
    """
    sizes = stored(entries.groupBy("bucket").agg(F.count("*").alias("n")))
    sized = stored(entries.join(few(sizes), "bucket"))
    top = sized.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("top"))
    into = sized.join(top, "node").groupBy("bucket").agg(F.min("top").alias("into"), F.first("n").alias("n"))
    into = stored(into.select("bucket", F.col("into.bucket").alias("into"), "n"))
    together = stored(sized.join(few(into.select("bucket", "into")), "bucket").select("into", "node").distinct())
    # As doubles: the square of a number of rows may be beyond a long.
    pairs = together.groupBy("into").agg(F.pow(F.count("*"), F.lit(2)).alias("together"))
    worth = stored(pairs.join(into.groupBy("into").agg(F.sum(F.pow("n", F.lit(2))).alias("single")), "into").select("into", (F.col("together") <= F.col("single")).alias("good")))
    single = stored(into.join(few(worth.filter("NOT good").select("into")), "into").select("bucket"))
    joint = together.join(few(worth.filter("good").select("into")), "into").select(F.col("into").alias("bucket"), "node")
    return stored(joint.unionByName(sized.join(few(single), "bucket").select("bucket", "node")))


def _paged(members: DataFrame, counts: DataFrame) -> DataFrame:
    """bucket, part, page and points of pages of about ``PAGE`` points at most; ``part`` is a range of sizes, null in a bucket of one page."""
    sizes = stored(members.groupBy("bucket").agg(F.count("*").alias("n")))
    part = F.floor(F.log("size") / np.log(100 / PERCENT)).cast("int")
    named = members.join(few(sizes), "bucket").withColumn("part", F.when(F.col("n") > PAGE, part))
    large = stored(named.filter("part IS NOT NULL"))
    counted = large.groupBy("bucket", "part").agg(F.count("*").alias("of_part"))
    page = F.pmod(F.xxhash64("node"), F.ceil(F.col("of_part") / PAGE).cast("long")).cast("int")
    large = large.join(counted, ["bucket", "part"]).withColumn("page", page).drop("of_part")
    small = named.filter("part IS NULL").withColumn("page", F.lit(0))
    point = F.struct("node", "label", "size", "counts")
    return small.unionByName(large).join(counts, "node").groupBy("bucket", "part", "page").agg(F.collect_list(point).alias("points"))


def candidates(members: DataFrame, percent: int = PERCENT, whole: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """Pairs (x, y) of nodes that are in one bucket with different labels and can be similar enough, by the tree; or, not ``whole``, their nodes.

    ``members`` are bucket, node, label and size; ``counts`` has the counts of each node, unless
    ``members`` have them.
    """
    counts = members.select("node", "counts").dropDuplicates(["node"]) if counts is None else counts
    pages = stored(_paged(members.select("bucket", "node", "label", "size"), counts))
    alone = pages.select(F.col("points").alias("x"), F.lit(None).cast(pages.schema["points"].dataType).alias("y"))
    # Sets of similar sizes are in one part or in two that are next to each other.
    reach = int(np.ceil(np.log(100 / percent) / np.log(100 / PERCENT) - 1e-9)) if percent < 100 else 0
    large = pages.filter("part IS NOT NULL")
    left = large.select("bucket", F.col("part").alias("from"), F.col("page").alias("p"), F.col("points").alias("x"), F.explode(F.sequence(F.col("part"), F.col("part") + reach)).alias("part"))
    pairs = left.join(large.select("bucket", "part", F.col("page").alias("q"), F.col("points").alias("y")), ["bucket", "part"]).filter("from < part OR p < q")
    return alone.unionByName(pairs.select("x", "y")).mapInArrow(_page_pairs(percent, whole), "x long, y long" if whole else "node long")


def linked(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Null and empty texts and texts without words have an empty set, no link and their own doc_id; a
    text of fewer than 5 words is one shingle; very long texts are compared whole. Repeated rows
    and equal sets are linked; rows of equal or null doc_id stay apart, and a null doc_id names a
    component only if it has no other. An empty table gives no row; other columns are ignored,
    whatever their names.
    """
    rows = points(documents, percent)
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("_row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes)
    copies = rows.select("digest", "_row").join(few(classes.filter("n > 1").select("digest", "node")), "digest").filter("_row != node").select("_row")
    nodes = among(rows.filter("digest IS NOT NULL").select("_row", "size", "first"), stored(copies), "_row", False).withColumnRenamed("_row", "node")
    members, alone = buckets(nodes, percent)
    active = stored(rows.select(F.col("_row").alias("node"), "key", "size", "counts").join(few(alone.select("node")), "node"))
    active = stored(texts_of(documents, active))

    def sets_of(ids: DataFrame) -> DataFrame:
        """``ids`` (node and other long columns) with the shingles of each node."""
        texts = active.select("node", "text").join(few(ids), "node").select(*ids.columns, "text")
        return texts.mapInArrow(_shingles, ", ".join(f"{c} long" for c in ids.columns) + ", shingles array<long>")

    def side(name: str, *columns: str) -> DataFrame:
        return active.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (x, y) those whose sets are similar enough, as (a, b)."""
        pairs = pairs.groupBy(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).agg(F.max(F.struct("x", "y")).alias("pair"))
        pairs = stored(pairs.select(F.col("pair.x").alias("a"), F.col("pair.y").alias("b")))
        sets = stored(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        # Nodes that many others are compared with are ``y``, and so few sets go to the second join.
        second = sets.join(few(stored(pairs.select(F.col("b").alias("node")).distinct())), "node").select(F.col("node").alias("b"), F.col("shingles").alias("t"))
        both = few(pairs).join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a").join(second, "b")
        common = both.select("a", "b", F.size(F.array_intersect("s", "t")).cast("long").alias("common"), (F.size("s") + F.size("t")).cast("long").alias("sum"))
        return cut(common.filter(100 * F.col("common") >= percent * (F.col("sum") - F.col("common"))).select("a", "b"))

    def bounded(pairs: DataFrame) -> DataFrame:
        joined = pairs.distinct().join(side("x", "size", "counts"), "x").join(side("y", "size", "counts"), "y")
        return joined.select("x", "y", "x_counts", "y_counts", "x_size", "y_size").mapInArrow(_able_pairs(percent), "x long, y long")

    def crossing(nodes: DataFrame) -> DataFrame:
        """Those of ``nodes`` (node, label) that may be similar enough to one of another label: only shingles that are in sets of other labels too can be common with it."""
        terms = stored(sets_of(nodes)).select("node", "label", F.explode("shingles").alias("shingle"))
        # Dealt out once: as sums and a join, a shingle's nodes would be dealt out after its labels were.
        of = Window.partitionBy("shingle")
        terms = terms.select("node", F.min("label").over(of).alias("low"), F.max("label").over(of).alias("high"))
        count = terms.filter("low < high").groupBy("node").agg(F.count("*").alias("crossing"))
        return stored(count.join(active.select("node", "size"), "node").filter(100 * F.col("crossing") >= percent * F.col("size")).select("node"))

    def labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
        """``entries`` (bucket, node) of buckets with several labels, with the label and size of the node."""
        named = stored(entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
        return stored(several(named).join(active.select("node", "size"), "node"))

    def apart(named: DataFrame) -> DataFrame:
        """Those of ``named`` entries that may have a link to another label of their bucket."""
        # A bucket of many pages is searched for all pairs of them, so nodes that can have no link there go first.
        wide = stored(named.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > PAGE).select("bucket"))
        if not wide.isEmpty():
            inside = stored(named.join(few(wide), "bucket"))
            good = crossing(stored(inside.select("node", "label").distinct()))
            named = stored(several(stored(named.join(few(wide), "bucket", "left_anti").unionByName(inside.join(few(good), "node").select(*named.columns)))))
        near = stored(candidates(named, percent, False, active.select("node", "counts")).distinct())
        named = stored(several(stored(named.join(few(near), "node"))))
        good = crossing(stored(named.select("node", "label").distinct()))
        return stored(several(stored(named.join(few(good), "node"))))

    leaders = members.join(alone, "node").groupBy("bucket").agg(F.min(F.struct("alone", "node")).alias("leader")).select("bucket", F.col("leader.node").alias("y"))
    edges = verified(bounded(members.select("bucket", F.col("node").alias("x")).join(leaders, "bucket").filter("x != y").select("x", "y")))
    labels = components(edges)
    open_ = apart(labelled(merged(labelled(members, labels).select("bucket", "node")), labels))
    if not open_.isEmpty():
        # The nodes outside a bucket's commonest class meet that class's most typical node first.
        most = open_.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most")).select("bucket", F.col("most.label").alias("most"))
        centres = open_.select("node", "label").distinct().join(alone, "node").groupBy("label").agg(F.min(F.struct("alone", "node")).alias("centre")).select(F.col("label").alias("most"), F.col("centre.node").alias("y"))
        minor = open_.join(most, "bucket").filter("label != most").select(F.col("node").alias("x"), "most").distinct()
        edges = cut(edges.unionByName(verified(bounded(minor.join(centres, "most").select("x", "y")))))
        labels = components(edges)
        open_ = apart(labelled(open_.select("bucket", "node"), labels))
    if not open_.isEmpty():
        edges = edges.unionByName(verified(candidates(open_, percent, True, active.select("node", "counts"))))
        labels = components(edges)
    named = stored(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = stored(named.join(least, "label").select("digest", "component_id"))
    out = rows.select("doc_id", F.col("size").alias("n_shingles"), "digest").join(found, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def several(named: DataFrame) -> DataFrame:
    """The entries of buckets with more than one label."""
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    return named.join(few(stored(mixed)), "bucket")

"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts with the same set of word shingles are one class.  In every tree of the forest a class has a
label: a sequence of min-hashes in bits, so that sorted labels are the tree's prefix trie and the
longest prefix of two classes is that of neighbours in the order.  Labels are sorted by ranges, so
a label that very many classes share is split over tasks.

Prefixes are matched at full length first and shortened level by level.  A pair of similarity s is
met at depth d with probability 1 - (1 - s**d)**trees.  Shortening ends at the depth at which pairs
just at the threshold reach the target recall, so that every pair above it does, whatever the
table holds.  No two trees share a min-hash, so the trees are independent.

Classes that share a prefix of that depth are candidates.  Their components are the only groups in
which texts are compared, in large ones only blocks that share a prefix, and every candidate is
verified by its exact Jaccard similarity.  Tasks give counts of links and a spanning forest, never
all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, row_count, slim_join, stored
from .components import connected_components
from .hashing import ALNUM, U, Words, chunks, mix

TREES = 40
#: Depths by which prefixes can be shortened, and a label's bits for each of them; the rest are of the shortest prefix.
LEVELS, BITS = 3, 8
BLOCK = 256
#: Distinct shingles of a block pair up to which intersections are one matrix product.
DENSE = 200_000


def met(similarity: float, depth: int) -> float:
    """The probability that a pair of that similarity shares a prefix of ``depth`` in one tree at least."""
    return 1 - (1 - similarity**depth) ** TREES


def shortest(threshold: float, recall: float) -> int:
    """The longest prefix at which pairs just at ``threshold`` are met with probability ``recall``."""
    depth = 16
    while depth > 1 and met(threshold, depth) < recall:
        depth -= 1
    return depth


def shortened(similar: list[float], threshold: float, recall: float) -> int:
    """The depth at which shortening ends: the longest that recalls the target share of pairs like ``similar``.

    These were met at the shortest depth, so each stands for one over the probability of that.
    One pair at the threshold is counted in; with no others it is the depth at which every pair above the threshold is recalled so.
    """
    low = shortest(threshold, recall)
    pairs = [(s, 1 / met(s, low)) for s in [*similar, threshold]]
    depth = low + LEVELS
    while depth > low and sum(w * met(s, depth) for s, w in pairs) < recall * sum(w for _, w in pairs):
        depth -= 1
    return depth


def _draws(pool: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the permutations behind ``pool`` min-hashes."""
    rng = np.random.default_rng(20_240)
    return rng.integers(0, 1 << 31, pool, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, pool, dtype=np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within it, and where each text's begin."""
    words = Words(texts, ALNUM)
    codes, first = words.shingles(width)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((codes, doc))
    codes, doc = codes[order], doc[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
    codes, doc = codes[new], doc[new]
    return codes, np.searchsorted(doc, np.arange(len(first)))


def fingerprints(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit sum that names a set of shingles; 0 for an empty one."""
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, U), np.cumsum(mix(codes, 21), dtype=U)])
        total = mix(run[first[1:]] - run[first[:-1]], 21)
    return np.where(np.diff(first) > 0, total, U(0)).view(np.int64)


def labels(codes: np.ndarray, first: np.ndarray, low: int) -> np.ndarray:
    """Each text's label in every tree; texts without shingles have zeros.

    The upper bits hash the first ``low`` min-hashes, BITS further ones each min-hash after them.
    """
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, TREES), U)
    if not len(full):
        return out.view(np.int64)
    deep = low + LEVELS
    odd, add = _draws(TREES * deep)
    code, at = (codes >> U(32)).astype(np.uint32), first[:-1][full]
    with np.errstate(over="ignore"):
        for tree in range(TREES):
            h, label = np.full(len(full), U(tree + 1)), np.zeros(len(full), U)
            for level in range(deep):
                i = tree * deep + level
                h = mix(h * U(0x9FB21C651E98DF25) + np.minimum.reduceat(code * odd[i] + add[i], at).astype(U))
                rest = U(BITS * (deep - 1 - level))
                if level == low - 1:
                    label = h >> rest << rest
                elif level >= low:
                    label |= h >> U(64 - BITS) << rest
            out[full, tree] = label
    return out.view(np.int64)


def signatures(docs: DataFrame, low: int, width: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, node (fingerprint; null without a word), labels of each row."""
    rows = pick(docs, *dict.fromkeys([doc_id, text]))
    kind = rows.schema[doc_id].dataType.simpleString()
    rows = rows.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                codes, first = shingle_sets(part.column(1), width)
                found, n = labels(codes, first, low), len(first) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(fingerprints(codes, first), mask=np.diff(first) == 0),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * TREES, pa.int32()), pa.array(found.ravel())),
                    ],
                    names=["doc_id", "node", "labels"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, node bigint, labels array<bigint>")


def neighbours(rows: DataFrame, low: int, ends: bool) -> DataFrame:
    """Of sorted rows (tree, label, node) the edges (a, b, depth) between neighbours with a common prefix.

    ``ends``: the first and the last row of each partition are given too, with the partition's number.
    """
    deep = low + LEVELS

    def run(batches):
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        empty = np.zeros(0, np.int64)

        def batch_of(a, b, depth, tree=empty, label=empty, node=empty):
            n, m = len(a), len(tree)
            wide = lambda x, before, after: pa.array(np.concatenate([np.zeros(before, np.int64), x, np.zeros(after, np.int64)]))
            return pa.RecordBatch.from_arrays(
                [wide(a, 0, m), wide(b, 0, m), wide(depth, 0, m), wide(tree, n, 0), wide(label, n, 0), wide(node, n, 0), wide(np.full(m, part), n, 0)],
                names=["a", "b", "depth", "tree", "label", "node", "part"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy().astype(np.int64) for i in range(3)]
            if last is None and ends:
                yield batch_of(empty, empty, empty, *[c[:1] for c in cols])
            if last is not None:
                cols = [np.concatenate([x, c]) for x, c in zip(last, cols, strict=True)]
            last = [c[-1:] for c in cols]
            tree, label, node = cols
            depth, alike = np.zeros(len(tree) - 1, np.int64), (tree[1:] == tree[:-1]) & (node[1:] != node[:-1])
            for d in range(low, deep + 1):
                shift = BITS * (deep - d)
                depth[alike & (label[1:] >> shift == label[:-1] >> shift)] = d
            hit = depth > 0
            yield batch_of(node[:-1][hit], node[1:][hit], depth[hit])
        if last is not None and ends:
            yield batch_of(empty, empty, empty, *last)

    return rows.select("tree", "label", "node").mapInArrow(run, "a bigint, b bigint, depth bigint, tree bigint, label bigint, node bigint, part bigint")


def trie_edges(classes: DataFrame, low: int) -> DataFrame:
    """Pairs of classes (a, b) that are neighbours in a tree's sorted trie, with the longest prefix they share in one."""
    rows = classes.select(F.posexplode("labels").alias("tree", "label"), "node")
    found = stored(neighbours(rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node"), low, True), "forest-neighbours")
    # Two rows a partition: where one ends and the next begins.
    borders = found.where("depth = 0").coalesce(1).sortWithinPartitions("part", "tree", "label", "node")
    edges = found.where("depth > 0").unionByName(neighbours(borders, low, False).where("depth > 0"))
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("depth").alias("depth"))


def _sets(docs: DataFrame, wanted: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """The shingles (node, codes) of ``wanted`` classes (node, class_id), from the texts of one id each."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                codes, first = shingle_sets(part.column(0), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fingerprints(codes, first)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(codes.view(np.int64)))], names=["node", "codes"]
                )

    rows = pick(docs, *dict.fromkeys([doc_id, text])).select(F.col(f"`{doc_id}`").alias("class_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ids = wanted.where(F.col("class_id").isNotNull()).select("class_id").distinct()
    rows = slim_join(rows, ids, "class_id", "left_semi").select("text").unionByName(rows.where(F.col("class_id").isNull()).select("text"))
    found = slim_join(rows.mapInArrow(run, "node bigint, codes array<bigint>"), wanted.select("node"), "node", "left_semi")
    return found.groupBy("node").agg(F.any_value("codes").alias("codes"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows numbered by ``at`` within partitions (its low 33 bits), with their block: runs of BLOCK rows through all of them."""
    part, at = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition.
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.withColumn("part", part).join(F.broadcast(counts), "part").withColumn("block", F.floor((F.col("before") + at) / BLOCK)).drop("part", "before", "at")


class _Forest:
    """Union-find over the rows of a task; keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _linked(left: list[np.ndarray], right: list[np.ndarray], maybe: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of ``maybe`` have Jaccard similarity num / den or more."""
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    # Sizes alone rule out pairs whose smaller set is too small.
    maybe &= den * np.minimum.outer(a, b) >= num * np.maximum.outer(a, b)
    if not maybe.any():
        return maybe
    flat = np.concatenate([*left, *right])
    values, code = np.unique(flat, return_inverse=True)
    if len(values) <= DENSE and maybe.sum() > 64:
        rows = np.repeat(np.arange(len(left) + len(right)), np.concatenate([a, b]))
        order = np.argsort(code, kind="stable")
        code, rows = code[order], rows[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for low in range(0, len(values), 4096):
            i, j = np.searchsorted(code, [low, low + 4096])
            part = np.zeros((len(left) + len(right), min(4096, len(values) - low)), np.float32)
            part[rows[i:j], code[i:j] - low] = 1
            both += part[: len(left)] @ part[len(left) :].T
    else:
        both = np.zeros((len(left), len(right)), np.float32)
        for i, j in zip(*np.nonzero(maybe), strict=True):
            both[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
    return maybe & (den * both.astype(np.int64) >= num * (np.add.outer(a, b) - both.astype(np.int64)))


def _compare(num: int, den: int, shift: int):
    """Group function: links and forest edges of the components, or the pair of blocks, of one job."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for _, group in pdf.groupby("component", sort=False):
            sides = [g for _, g in group.groupby("block")]
            left, right, own = sides[0], sides[-1], len(sides) == 1
            a, b = np.stack(left["labels"].to_numpy()) >> shift, np.stack(right["labels"].to_numpy()) >> shift
            maybe = np.zeros((len(a), len(b)), bool)
            for tree in range(a.shape[1]):
                maybe |= a[:, tree][:, None] == b[:, tree][None, :]
            if own:
                maybe = np.triu(maybe, 1)
            hit = _linked(left["codes"].tolist(), right["codes"].tolist(), maybe, num, den)
            if not hit.any():
                continue
            na, nb = left["node"].to_numpy(), right["node"].to_numpy()
            for ids, n in ((na, hit @ right["copies"].to_numpy()), (nb, left["copies"].to_numpy() @ hit)):
                out += [(int(i), int(k), 0) for i, k in zip(ids, n, strict=True) if k]
            trees = _Forest(len(na) + len(nb))
            for i, j in zip(*np.nonzero(hit), strict=True):
                if trees.join(int(i), int(j) if own else len(na) + int(j)):
                    out.append((int(na[i]), int(nb[j]), 1))
        return pd.DataFrame(out, columns=["a", "b", "kind"]).astype("int64")

    return run


def jaccard_join(docs: DataFrame, num: int = 4, den: int = 5, width: int = 5, recall: float = 0.99999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, n_links, component_id, kept.

    Words are runs of letters and digits, lower-cased; documents link if the Jaccard similarity
    of their sets of ``width``-word shingles is num / den or more.  A text of fewer words has one
    shingle of them all, one without a word (null or empty) links with nothing.  ``class_id`` is
    the smallest id with the same set, ``n_links`` the number of other documents linked directly,
    copies included, ``component_id`` the smallest id that links lead to, ``kept`` is true for
    that row.  Rows that repeat an id are judged by their own text; a null id takes part in the
    links of others and has null class and component if no id is there.
    """
    low = shortest(num / den, recall)
    signed = stored(signatures(docs, low, width, doc_id, text), "forest")
    classes = signed.where(F.col("node").isNotNull()).groupBy("node")
    classes = stored(classes.agg(F.count("*").alias("copies"), F.min("doc_id").alias("class_id"), F.any_value("labels").alias("labels")), "forest-classes")
    edges = stored(trie_edges(classes, low), "forest-edges")
    depth = shortened([], num / den, recall)
    shift = BITS * (low + LEVELS - depth)
    near = connected_components(edges.where(F.col("depth") >= depth).select("a", "b"))
    sizes = near.groupBy("component").agg(F.count("*").alias("n"))
    near = stored(slim_join(classes, cut(near.join(sizes, "component")), "node"), "forest-near")
    members = near.drop("class_id").join(_sets(docs, near, width, doc_id, text), "node")
    jobs = max(1, -(-row_count(near.where(F.col("n") <= BLOCK)) // (4 * BLOCK)))
    # Blocks of a large component are runs of its order in one tree; a row goes to the pairs of its block and those that share a prefix with it.
    large = near.where(F.col("n") > BLOCK).repartitionByRange("component", F.col("labels")[0], "node").sortWithinPartitions("component", F.col("labels")[0], "node")
    large = in_blocks(stored(large.select("node", "component", F.monotonically_increasing_id().alias("at"), "labels"), "forest-blocks"))
    met_by = large.select("component", "block", F.posexplode("labels").alias("tree", "label"))
    met_by = met_by.select("component", "block", "tree", F.shiftright("label", shift).alias("prefix")).distinct()
    pairs = met_by.join(met_by.withColumnRenamed("block", "other"), ["component", "tree", "prefix"]).where("block <= other").select("component", "block", "other").distinct()
    sent = pairs.select("component", "block", F.concat_ws(":", "component", "block", "other").alias("job"))
    sent = sent.unionByName(pairs.where("block < other").select("component", F.col("other").alias("block"), F.concat_ws(":", "component", "block", "other").alias("job")))
    one = members.where(F.col("n") <= BLOCK).withColumn("block", F.lit(0).cast("bigint")).withColumn("job", F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(jobs))))
    many = members.where(F.col("n") > BLOCK).join(large.select("node", "block"), "node").join(sent, ["component", "block"])
    columns = ["job", "component", "block", "node", "copies", "labels", "codes"]
    found = one.select(*columns).unionByName(many.select(*columns))
    found = found.groupBy("job").applyInPandas(_compare(num, den, shift), "a bigint, b bigint, kind bigint")
    found = stored(found, "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    parts = connected_components(found.where("kind = 1").select("a", "b"))
    whole = classes.drop("labels").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    first = whole.groupBy("component").agg(F.min("class_id").alias("component_id"))
    whole = whole.join(first, "component").select("node", "class_id", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", "node").join(whole, "node", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

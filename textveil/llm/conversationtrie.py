"""Prefix trie of conversations.

Turns are known by digests; conversations of equal turns are one sequence with a count.  The trie
is parted by first turn: whole subtries of first turns share a task, which builds them with a
dictionary of children per node and sums them up from the leaves.  A first turn whose subtrie is
oversized is parted by the next turns, as far down as needed; the nodes above (the spine) are
summed up from what the subtries below report.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, slim_join, stored

#: Turns of a subtrie over which it is parted by its next turn, and turns of a task on the average, at most.
SUBTRIE_TURNS, TASK_TURNS = 2_000, 50_000
#: Low bits of an id: members of a sequence that differ in them alone are joined to one text before they are digested in order.
ID_BITS = 16
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
#: The root's key: the digest of no turns.
ROOT = hashlib.md5(b"").hexdigest()


def _prefix(n: Column) -> Column:
    """Key of the node that the first ``n`` of ``keys`` lead to."""
    return F.md5(F.array_join(F.slice("keys", F.lit(1), n), "").cast("binary"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, keys, words: each conversation after its first turns were replaced by those of the first of its twenty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words"),
    )
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "words"))).alias("own"))
    own = cut(own.select("conv_id", F.transform("own", lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words"))).alias("own")))
    heads = own.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    both = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 20, "h": h}).join(heads, "base", "left")
    first = F.slice(F.coalesce("head", F.array().cast(both.schema["own"].dataType)), F.lit(1), F.col("h"))
    both = both.select("conv_id", F.concat(first, F.slice("own", F.col("h") + 1, F.size("own"))).alias("all"))
    return both.select("conv_id", F.col("all.key").alias("keys"), F.col("all.words").alias("words"))


def sequences(convs: DataFrame) -> DataFrame:
    """key, keys, words, n, conv_id, ends: each distinct sequence, its members' number, smallest id and digest of ids."""
    # Members of one sequence and range of ids are few enough for one text; those texts are digested in order, a row at a time.
    parts = convs.withColumn("key", _prefix(F.size("keys"))).groupBy("key", F.shiftright("conv_id", ID_BITS).alias("range"))
    ids = F.sort_array(F.collect_list("conv_id"))
    parts = parts.agg(F.first("keys").alias("keys"), F.first("words").alias("words"), ids.alias("ids"))
    parts = parts.select("key", "range", "keys", "words", F.size("ids").cast("bigint").alias("n"), F.get("ids", F.lit(0)).alias("conv_id"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def digest(batches):
        # Of the sequence whose rows are being read: key, a row with its turns, members, smallest id, digest so far.
        open_ = None
        for batch in batches:
            done = []
            for i, (key, n, least, ids) in enumerate(zip(*[batch.column(j).to_pylist() for j in (0, 4, 5, 6)], strict=True)):
                if open_ and open_[0] == key:
                    open_[2] += n
                    open_[4].update(b"," + ids.encode())
                    continue
                if open_:
                    done.append(open_)
                open_ = [key, batch.slice(i, 1).select([2, 3]), n, least, hashlib.sha256(ids.encode())]
            if done:
                yield closed(done)
        if open_:
            yield closed([open_])

    def closed(done: list) -> pa.RecordBatch:
        keys, turns, n, conv_id, state = zip(*done, strict=True)
        turns = pa.Table.from_batches(turns).combine_chunks().to_batches()[0]
        columns = [pa.array(keys, pa.string()), *turns.columns, pa.array(n, pa.int64()), pa.array(conv_id, pa.int64()), pa.array([x.hexdigest() for x in state], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "keys", "words", "n", "conv_id", "ends"])

    dealt = parts.repartition("key").sortWithinPartitions("key", "range")
    return dealt.mapInArrow(digest, "key string, keys array<string>, words array<int>, n bigint, conv_id bigint, ends string")


def _spine_depths(seqs: DataFrame, limit: int) -> DataFrame:
    """``seqs`` with ``spine``: how many of a sequence's nodes, from its first turn on, have subtries of over ``limit`` turns.

    Each round looks at twice as many turns as that before, of sequences all whose nodes so far are oversized.
    """
    known, open_, step, reached = [], seqs.select("key", "keys").where(F.size("keys") > 0), 1, 0
    while True:
        at = open_.select("key", F.size("keys").alias("n"), "keys", F.explode(F.sequence(F.lit(reached + 1), F.least(F.size("keys"), F.lit(reached + step)))).alias("depth"))
        at = at.select("key", "depth", _prefix(F.col("depth")).alias("node"), (F.col("n") - F.col("depth") + 1).alias("turns"))
        over = cut(at.groupBy("node").agg(F.sum("turns").alias("turns")).where(F.col("turns") > limit).select("node"))
        if over.isEmpty():
            break
        deep = cut(slim_join(at, over, "node", "left_semi").groupBy("key").agg(F.max("depth").alias("spine")))
        known.append(deep)
        reached, step = reached + step, 2 * step
        open_ = slim_join(seqs.select("key", "keys"), deep.where(F.col("spine") == reached).select("key"), "key", "left_semi").where(F.size("keys") > reached)
    if not known:
        return seqs.withColumn("spine", F.lit(0))
    found = known[0]
    for more in known[1:]:
        found = found.unionByName(more)
    found = cut(found.groupBy("key").agg(F.max("spine").alias("spine")))
    return slim_join(seqs, found, "key", "left").withColumn("spine", F.coalesce("spine", F.lit(0)))


NODE = "depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, path array<string>"


def build_tries(group: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the subtries of some sequences: each from the node below its spine on.

    ``path``, of top nodes only: the keys of the spine nodes above, the nearest last.
    """
    tops: dict[str, int] = {}
    children: list[dict[str, int]] = []
    parent, depth, words, convs, least, ends, path = [], [], [], [], [], [], []

    def node(up: int, at: int, n_words: int, above) -> int:
        children.append({})
        for x, y in zip((parent, depth, words, convs, least, ends, path), (up, at, n_words, 0, None, None, above), strict=True):
            x.append(y)
        return len(parent) - 1

    for keys, n_words, n, conv_id, end, above in zip(*[group[c] for c in ("keys", "words", "n", "conv_id", "ends", "path")], strict=True):
        up, spine = -1, len(above)
        for i in range(spine, len(keys)):
            known = children[up] if up >= 0 else tops
            name = keys[i] if up >= 0 else (above[-1] if spine else "") + keys[i]
            if name not in known:
                known[name] = node(up, i + 1, int(n_words[i]), None if up >= 0 else above)
            up = known[name]
            convs[up] += n
            least[up] = conv_id if least[up] is None else min(least[up], conv_id)
        ends[up] = end
    leaves, saved = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
    # Nodes are numbered parents first, so this is a postorder: every child comes before its parent.
    for i in range(len(parent) - 1, -1, -1):
        leaves[i] += not children[i]
        saved[i] += (convs[i] - 1) * words[i]
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    columns = [depth, least, [least[p] if p >= 0 else None for p in parent], convs, [len(c) for c in children], leaves, saved, ends, path]
    names = [x.split()[0] for x in NODE.split(", ")]
    return pd.DataFrame({c: pd.Series(x, dtype=object if c in ("ends_sha256", "path") else "Int64") for c, x in zip(names, columns, strict=True)})


def conversation_trie(turns: DataFrame, limit: int = SUBTRIE_TURNS) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number, a null number first, and of one number by digest; null roles and
    texts count as empty, and repeated rows are turns of their own.  Rows without a conversation id
    belong to none.  An empty table has no conversation, and so no node.  A conversation's turns are
    gathered as digests, some 40 bytes each.
    """
    seqs = stored(sequences(rebuilt(pick(turns, "conv_id", "turn", "role", "text"))), "sequences")
    seqs = _spine_depths(seqs, limit).withColumn("path", F.transform(F.sequence(F.lit(0), F.col("spine")), _prefix))
    # The root is on every path; what hangs off it alone needs no join.
    seqs = seqs.withColumn("path", F.slice("path", F.lit(2), F.size("path")))
    total = seqs.agg(F.sum(F.size("keys") - F.col("spine")).alias("turns"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.max(F.when(F.col("key") == ROOT, F.col("ends"))).alias("ends")).first()
    tasks = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total["turns"] or 0) // TASK_TURNS)
    below = seqs.where(F.size("keys") > F.col("spine")).withColumn("task", F.pmod(F.xxhash64(_prefix(F.col("spine") + 1)), F.lit(tasks)))
    nodes = stored(below.select("task", "keys", "words", "n", "conv_id", "ends", "path").groupBy("task").applyInPandas(build_tries, NODE), "nodes")
    tops = nodes.where(F.col("path").isNotNull())

    # Spine nodes from the sequences that pass them.
    passing = seqs.where("spine > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("spine"))).alias("depth"))
    passing = passing.select(F.get("path", F.col("depth") - 1).alias("node"), "depth", F.get("words", F.col("depth") - 1).alias("words"), F.slice("path", F.lit(1), F.col("depth")).alias("path"), "n", "conv_id", F.when(F.size("keys") == F.col("depth"), F.col("ends")).alias("ends"))
    spine = passing.groupBy("node").agg(*[F.first(c).alias(c) for c in ("depth", "words", "path")], F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends_sha256"))
    spine = cut(spine.withColumn("own", (F.col("n_convs") - 1) * F.col("words")))
    reports = tops.select("path", F.col("depth") - 1, F.lit(1).alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    # A spine node is no leaf: its subtrie has more turns than a single one.
    reports = reports.union(spine.select(F.slice("path", F.lit(1), F.col("depth") - 1), F.col("depth") - 1, F.lit(1), F.lit(0), F.lit(0)))
    reports = reports.union(spine.select("path", F.lit(-1), F.lit(0), F.lit(0), F.col("own"))).toDF("path", "above", "children", "leaves", "saved")
    reports = cut(reports.groupBy("path", "above").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")]))
    sums = reports.select("*", F.posexplode("path").alias("i", "node")).groupBy("node").agg(F.sum(F.when(F.col("i") + 1 == F.col("above"), F.col("children"))).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    spine = spine.join(sums, "node")
    own = spine.select("node", F.col("conv_id").alias("parent_conv_id"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    first = F.lit(total["conv_id"]).cast("bigint")

    def under(rows: DataFrame) -> DataFrame:
        """Rows with the smallest member of the spine node, or root, that ends ``above``."""
        rows = rows.drop("parent_conv_id")
        hung = slim_join(rows.where(F.size("above") > 0).withColumn("node", F.element_at("above", -1)), own, "node")
        return hung.select(*names).unionByName(rows.where(F.size("above") == 0).withColumn("parent_conv_id", first).select(*names))

    hanging = [F.sum(F.when(F.col("above") == 0, F.col("children"))).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")]
    root = reports.agg(*hanging).where(F.lit(total["n"] is not None)).select(
        first.alias("conv_id"), F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(total["n"]).cast("bigint").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.lit(total["ends"]).cast("string").alias("ends_sha256"),
    )
    hung = under(tops.withColumn("above", F.col("path"))).unionByName(under(spine.withColumn("above", F.slice("path", F.lit(1), F.col("depth") - 1))))
    out = nodes.where(F.col("path").isNull()).select(*names).unionByName(hung).unionByName(root)
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in names[:-1]], F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))

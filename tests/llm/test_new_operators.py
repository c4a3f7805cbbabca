"""Conversation trie, filter audit and fingerprints: edges, and plain Python that looks at every case."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textveil.llm import conversationtrie, filteraudit, fingerprints, queries

from ..oracle import same

SF = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASH = ["bin", "extra", "at", "to", "head", "to_bin", "digest", "failed", "good", "left", "set", "n", "part", "key", "keys", "words", "own", "base", "h", "task", "path", "node", "depth", "spine", "range", "ids"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


# Trie


def trie_by_hand(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    count = lambda text: len([w for w in text.translate({i: " " for i in range(9, 14)}).split(" ") if w])
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * (count(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[p] if len(whole[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in nodes.items())


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


KIND = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limit", [1, 5, 2_000])
def test_trie_against_every_prefix(spark, limit):
    """Few texts, so that prefixes are shared; one opening holds a third of all conversations, some are long."""
    rng, rows = random.Random(4), []
    for c in range(150):
        opening = [("system", "be brief now"), ("user", "hi"), ("assistant", "hello there")] if c % 3 == 0 else []
        turns = opening + [("user", f"say {rng.randrange(3)} words")] * rng.randrange(3) + [("assistant", rng.choice(["a b", "", "c d e"])) for _ in range(rng.choice([0, 1, 2, 30]))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rng.shuffle(rows)
    found = conversationtrie.conversation_trie(clashing(spark.createDataFrame(rows, KIND)), limit=limit)
    assert trie_rows(found) == trie_by_hand(rows)


def test_trie_edges(spark):
    rows = [(None, 0, "user", "x"), (21, None, None, None), (21, 1, "user", "b"), (21, 1, "user", "b"), (21, 1, "user", "a"), (40, 0, "", "t " * 5000), (41, 5, "user", None), (41, None, "user", "z"), (1, 0, "u", "one")]
    assert trie_rows(conversationtrie.conversation_trie(spark.createDataFrame(rows, KIND))) == trie_by_hand(rows)
    assert conversationtrie.conversation_trie(spark.createDataFrame([], KIND)).count() == 0
    assert conversationtrie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], KIND)).count() == 0
    # A conversation of which nothing is left ends at the root.
    empty = next(c for c in range(1, 1000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(empty, 0, "user", "gone")]
    assert trie_rows(conversationtrie.conversation_trie(spark.createDataFrame(rows, KIND))) == trie_by_hand(rows) == [(empty, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(empty).encode()).hexdigest())]


def test_trie_digests_many_members_in_order(spark, monkeypatch):
    monkeypatch.setattr(conversationtrie, "ID_BITS", 4)
    rows = [(c, 0, "user", "same") for c in range(0, 4000, 7)] + [(c, 1, "user", "same") for c in range(0, 4000, 7)]
    assert trie_rows(conversationtrie.conversation_trie(spark.createDataFrame(rows, KIND))) == trie_by_hand(rows)


# Audit


def test_audit_counts_against_sets():
    rng = np.random.default_rng(1)
    part, failed, good, toxic = rng.integers(0, 3, 500), rng.integers(0, 32, 500), rng.random(500) < 0.5, rng.random(500) < 0.1
    counts = filteraudit.bitmap_counts(part, failed, good, toxic)
    for p, s in itertools.product(range(3), range(32)):
        left = (part == p) & (failed & s == 0)
        assert counts[p, s].tolist() == [left.sum(), (left & good).sum(), (left & toxic).sum()]


DOC = "doc_id long, text string, source string"


def test_audit_edges(spark):
    long_ = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, None, None), (1, "", ""), (2, None, None), (3, long_, "a"), (4, long_, "b"), (4, long_, "b"), (None, long_, "b"), (5, "A" * 60, "a"), (5, "é " * 60, "a"), (6, "x#", None)]
    labels = [(1, 1, None), (1, None, 1), (None, 1, 1), (4, 1, 0), (9, 1, 1)]
    docs, marks = clashing(spark.createDataFrame(rows, DOC)), clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = filteraudit.filter_audit(docs, marks).collect()
    assert len(out) == 3 * 600 and {r.part for r in out} == {"", "a", "b"}
    at = {(r.part, r.filter_order, r.step): r for r in out}
    # Of the empty texts 1 is the first, so 2 fails E; the row without an id does not.
    r = at["", "EABCD", 1]
    assert (r.kept, r.removed, r.redundant, r.good_lost, r.toxic_lost) == (3, 1, 0, 0, 0)
    r = at["", "ABCDE", 1]
    assert (r.kept, r.removed, r.good_lost, r.toxic_lost) == (0, 4, 1, 1) and at["", "ABCDE", 5].redundant == 1
    # Both rows of id 4 repeat the text of id 3; that without an id stays.
    assert (at["b", "EABCD", 1].removed, at["b", "EABCD", 1].kept, at["b", "EABCD", 1].good_lost) == (2, 1, 2)
    for p in ("", "a", "b"):
        assert all(sum(at[p, o, s].removed for o in {r.filter_order for r in out} for s in range(1, 6) if o[s - 1] == f) == at[p, "ABCDE", "ABCDE".index(f) + 1].shapley for f in "ABCDE")
    assert filteraudit.filter_audit(docs.where("false"), marks).count() == 0
    none = filteraudit.filter_audit(docs, marks.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)


# Fingerprints


def entropy_pairs(data):
    return [sum(math.comb(n, 2) for n in collections.Counter(data[i : i + fingerprints.WINDOW]).values()) for i in range(len(data) - fingerprints.WINDOW + 1)]


def test_equal_pairs_against_counts():
    rng = random.Random(2)
    for n in (0, 5, 15, 16, 17, 400):
        data = bytes(rng.choice(b"aab cde") for _ in range(n))
        assert fingerprints.equal_pairs(np.frombuffer(data, np.uint8)).tolist() == entropy_pairs(data)


def features_by_hand(text, rank):
    data = text.encode()
    pairs = entropy_pairs(data)
    n, won = len(pairs), collections.Counter()
    for i in range(n):
        won[min(range(i, min(i + fingerprints.RUN, n)), key=lambda k: (rank[pairs[k]], k))] += 1
    need = min(max(n // (2 * fingerprints.RUN), 1), fingerprints.NEEDED)
    spots = [k for k in range(n) if won[k] >= need and pairs[k] < fingerprints.PLAIN]
    return list(dict.fromkeys(data[k : k + fingerprints.WINDOW] for k in spots)) or ([data] if data else [])


def test_features_against_every_run():
    rng = random.Random(3)
    texts = ["", "short", "a" * 100, "é" * 40, "line of text\n" * 30] + ["".join(rng.choice("abcdefgh \nü") for _ in range(rng.randint(1, 900))) for _ in range(40)]
    pairs = collections.Counter(p for t in texts for p in entropy_pairs(t.encode()))
    rank = fingerprints.ranks(np.array([pairs[k] for k in range(fingerprints.PAIRS)]))
    assert sorted(range(fingerprints.PLAIN), key=lambda k: (pairs[k], k)) == sorted(range(fingerprints.PLAIN), key=rank.__getitem__)
    code, first = fingerprints.features(pa.array(texts, pa.large_string()), rank)
    names = {}
    for i, t in enumerate(texts):
        want = features_by_hand(t, rank)
        assert first[i + 1] - first[i] == len(want), t
        for c, w in zip(code[first[i] : first[i + 1]].tolist(), want, strict=True):
            assert names.setdefault(c, w) == w


def likeness_of(a, b):
    """From the fingerprints as text, filter by filter."""
    import base64

    def chain(x):
        return [(int(n, 16), int.from_bytes(base64.b64decode(bits), "little")) for n, bits in (f.split(":") for f in x.split("."))] if x else []

    def score(f, g):
        p, q = f[1].bit_count(), g[1].bit_count()
        chance, most = p * q / fingerprints.BITS, max(p, q)
        none = chance + fingerprints.CUTOFF * (most - chance)
        return max(0.0, ((f[1] & g[1]).bit_count() - none) / (most - none))

    x, y = chain(a), chain(b)
    if not x or not y:
        return float(x == y)
    side = lambda p, q: sum(f[0] * max(score(f, g) for g in q) for f in p) / sum(f[0] for f in p)
    return (side(x, y) + side(y, x)) / 2


def test_fingerprints_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    found = {r.doc_id: r for r in queries.op13_fingerprints(spark, SF).collect()}
    assert sorted(found) == sorted(texts)
    near = []
    for k, nxt in zip(order, order[1:] + order[:1], strict=True):
        r, t = found[k], texts[k]
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[nxt][:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - likeness_of(r.fingerprint, r.edited_fingerprint)) < 1e-9
        assert abs(r.near_next - likeness_of(r.fingerprint, found[nxt].fingerprint)) < 1e-9
        if len(t) > 200:
            near.append(r.near_edited > r.near_next)
    assert np.mean(near) > 0.95


def test_likeness_of_long_texts_and_copies():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, other = text(20_000), text(20_000)
    shifted = text(300) + " " + a
    texts = pa.array([a, other, shifted, a, "", "tiny", text(200)], pa.large_string())
    rank = fingerprints.ranks(np.ones(fingerprints.PAIRS, np.int64))
    c = fingerprints.Chains(texts, rank)
    got = fingerprints.likeness(c, np.array([0, 0, 0, 4, 4, 5, 5]), c, np.array([3, 1, 2, 4, 0, 0, 5])).tolist()
    assert got[0] == 1 and got[1] < 0.02 and got[2] > 0.4 and got[3] == 1 and got[4] == 0 and got[5] < 0.02 and got[6] == 1
    assert c.text(0) == c.text(3) and c.text(4) == "" and c.held.max() == fingerprints.FEATURES


def test_fingerprint_edges(spark):
    long_ = " ".join(f"word{i * 7919 % 10007}" for i in range(30_000))
    rows = [(None, None), (None, "b"), (3, "third text of a table"), (3, "third text of a table"), (3, "an other text of the id"), (9, long_), (-5, "minus"), (4, ""), (1 << 60, "far away"), ((1 << 60) + 1, "farther away")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = fingerprints.fingerprints(docs).collect()
    assert len(out) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = collections.Counter()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    assert len({r.fingerprint for r in out if r.n_chars == 21}) == 1 and all(0 <= x <= 1 for r in out for x in (r.near_edited, r.near_next))
    assert sum(r.near_next == 1 for r in out if r.n_chars == 21) == 1
    assert fingerprints.fingerprints(docs.where("false")).count() == 0
    single = fingerprints.fingerprints(docs.where("doc_id = 9")).collect()
    assert len(single) == 1 and single[0].near_next == 1


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_filter_audit"])
def test_hot_groups_against_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.01")

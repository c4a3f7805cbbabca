"""Operators against plain Python that looks at every case."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textveil.llm import common, compactwindows, covertree, importance, lshforest, outliers, packing, queries, toxicity, urlrules, warc
from textveil.llm.compactwindows import compact_windows, repeated_passages, without_passages
from textveil.llm.components import connected_components

from ..oracle import same

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def test_base_statistics():
    texts = ["", None, "a b c a b c\nx\nx\n\n x\ny", "é#a  b|\tc\u00a0d", "a b a b a b", "\n\n"]
    found = outliers.text_statistics(pa.array(texts, pa.string()))
    for i, text in enumerate(t or "" for t in texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        tri = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {j + k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in range(3)}
        want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(cover)]
        assert [int(found[s][i]) for s in outliers.STATS] == want, text


def test_quality_rules_part_junk_from_clean(spark):
    rng = random.Random(2)
    clean = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 400)))) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in clean[i][1].split())) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in clean + junk], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in outliers.quality_rules(docs).where("kept").collect()}
    assert kept == set(range(300))


def test_mcd_against_concentration_from_very_many_starts(spark):
    """Small groups, a quarter of each planted far off: exact C-steps from 300 random starts find the least determinant."""
    rng, rows, want = np.random.default_rng(8), [], {}
    p, h_share = len(outliers.FEATURES), 0.75
    upper, factor = np.triu_indices(p), outliers.consistency(0.75, p)

    def fit(x, by):
        return outliers.fitted(len(x), x.sum(axis=0), (x.T @ x)[upper], by)

    def d2(x, state):
        return np.einsum("ij,jk,ik->i", x - state[0], state[1], x - state[0])

    for g, n in (("a", 60), ("b", 120), ("c", 200)):
        x = np.concatenate([rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) * 0.5, rng.normal(size=(n // 4, p)) * 0.3 + 12]) + rng.normal(size=p)
        rows += [(g, *map(float, v)) for v in x]
        best = None
        for _ in range(300):
            state = fit(x[rng.choice(len(x), p + 1, replace=False)], 1.0)
            for _ in range(20):
                state = fit(x[np.argsort(d2(x, state))[: math.ceil(h_share * len(x))]], factor)
            best = state if best is None or state[2] < best[2] else best
        want[g] = fit(x[d2(x, best) <= outliers.chi2_quantile(outliers.CORE, p)], outliers.consistency(outliers.CORE, p)), x
    found = {r.g: r for r in outliers.mcd(spark.createDataFrame(rows, "g string, f0 double, f1 double, f2 double, f3 double"), "g").collect()}
    cutoff = outliers.chi2_quantile(1 - 1e-5, p)
    for g, (state, x) in want.items():
        have = np.array(found[g].center), np.array(found[g].precision).reshape(p, p)
        assert np.allclose(have[0], state[0], atol=0.15) and abs(found[g].logdet - state[2]) < 0.3
        assert np.allclose(np.linalg.inv(have[1]), np.linalg.inv(state[1]), atol=0.25 * np.abs(np.linalg.inv(state[1])).max())
        assert ((d2(x, have) > cutoff) == (d2(x, state) > cutoff)).mean() >= 0.99 and (d2(x, have)[-(len(x) // 5) :] > cutoff).all()


def test_chi_square():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(200_000, 4)) ** 2).sum(axis=1)
    assert all(abs((x <= outliers.chi2_quantile(q, 4)).mean() - q) < 0.005 for q in (0.1, 0.5, 0.75, 0.975))
    near = rng.normal(size=(200_000, 4))
    near = near[(near**2).sum(axis=1) <= outliers.chi2_quantile(0.75, 4)]
    assert np.allclose(np.cov(near.T) * outliers.consistency(0.75, 4), np.eye(4), atol=0.03)


def test_compact_windows_hold_every_run_once():
    rng = np.random.default_rng(5)
    for n in (1, 5, 9, 40):
        codes = rng.integers(0, 1 << 60, n, dtype=np.uint64)
        text, key, c, left, right = compact_windows(codes, np.array([0, n]), 5, 0)
        order = {int(x): int(outliers.mix(np.array([x], np.uint64), 31)[0]) for x in codes}
        for i in range(n):
            for j in range(i + 4, n):
                own = [k for k in range(len(c)) if left[k] <= i <= c[k] <= j <= right[k]]
                assert len(own) == 1 and order[int(key[own[0]])] == min(order[int(x)] for x in codes[i : j + 1])


def test_repeated_passages(spark):
    """Recall on runs of 50 words that occur before, word by word, and no passage that nothing near-copies."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    seen, need = {}, collections.defaultdict(set)
    for i in sorted(texts):
        w = words(texts[i])
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            if seen.setdefault(k, (i, j)) != (i, j):
                need[i].update(range(j, j + 50))
    spans = repeated_passages(docs).collect()
    got = collections.defaultdict(set)
    for s in spans:
        got[s.doc_id].update(range(s.start_word, s.end_word))
        assert words(texts[s.doc_id][s.start_char : s.end_char]) == words(texts[s.doc_id])[s.start_word : s.end_word]
        assert s.end_word - s.start_word >= 50
        # Something of it is in the source: near-copies share five words somewhere.
        grams = {tuple(words(texts[s.source_id])[j : j + 5]) for j in range(len(words(texts[s.source_id])))}
        own = words(texts[s.doc_id])[s.start_word : s.end_word]
        assert any(tuple(own[j : j + 5]) in grams for j in range(len(own) - 4))
    total = sum(map(len, need.values()))
    assert total and sum(len(need[i] & got[i]) for i in need) >= 0.99 * total
    left = without_passages(docs, repeated_passages(docs)).agg(F.sum(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[0-9a-z\u0080-\x{10ffff}]+"), F.lit(0))))).first()[0]
    assert left == sum(len(words(t)) for t in texts.values()) - sum(map(len, got.values()))


def test_passages_in_very_many_documents(spark, monkeypatch):
    """Keys dealt over several tasks give the rows that whole keys give."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(70))
    rows = [(i, " ".join([*(word() for _ in range(rng.randint(1, 60))), passage, *(word() for _ in range(rng.randint(1, 60)))])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(compactwindows._frequent_keys(docs, 150, 46, "bigint", np.zeros(0, np.uint64)))
    spread = {tuple(r) for r in repeated_passages(docs).collect()}
    monkeypatch.setattr(compactwindows, "_frequent_keys", lambda *a: np.zeros(0, np.int64))
    assert spread == {tuple(r) for r in repeated_passages(docs).collect()}
    for i, text in rows[1:]:
        at = text.index(passage)
        assert any(r[0] == i and r[4] <= at and r[5] >= at + len(passage) and r[6] == 0 for r in spread)


def test_passages_whose_earliest_meeting_fails(spark):
    """Ten earlier variants below the threshold come between two texts that share a passage word by word."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want = [], {}
    for k in range(40):
        passage = [word() for _ in range(60)]
        for v in range(12):
            own = passage if v > 9 else [word() if j % 14 == v % 14 else w for j, w in enumerate(passage)]
            rows.append((100 * k + v, " ".join([*(word() for _ in range(20)), *own, *(word() for _ in range(20))])))
        want[100 * k + 11] = " ".join(passage)
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    got = {r.doc_id for r in found if r.doc_id in want and want[r.doc_id] in texts[r.doc_id][r.start_char : r.end_char]}
    assert len(got) >= 39


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 150)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for x in got:
        for y in got:
            assert (got[x] == got[y]) == (root(x) == root(y))


def test_depth_is_that_of_the_threshold(spark, monkeypatch):
    """Pairs that are far above the threshold don't keep prefixes longer than those just at it need."""
    made, shifts = lshforest._compare, []
    monkeypatch.setattr(lshforest, "_compare", lambda num, den, shift: shifts.append(shift) or made(num, den, shift))
    texts = [" ".join(f"w{pair}x{k}" for k in range(200)) + f" end{side}" for pair in range(40) for side in "ab"]
    out = lshforest.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(out) == 80 and all(r.n_links == 1 and r.component_id == r.doc_id - r.doc_id % 2 for r in out)
    assert shifts == [lshforest.BITS * lshforest.LEVELS]


def test_forest_shortens_until_its_recall():
    low = lshforest.shortest(0.8, 0.99999)
    assert lshforest.met(0.8, low) >= 0.99999 > lshforest.met(0.8, low + 1)
    depths = [lshforest.shortened(s, 0.8, 0.99999) for s in ([], [0.8] * 500, [0.9] * 500, [0.99] * 100_000)]
    assert depths[:2] == [low, low] and depths == sorted(depths) and depths[-1] > low


def test_forest_recall_of_its_own_labels():
    """Pairs of sets whose similarity is just 0.8, by the labels that the join draws; each depth as the formula says."""
    rng, pairs, low = np.random.default_rng(9), 40_000, lshforest.shortest(0.8, 0.99999)
    missed = np.zeros(lshforest.LEVELS + 1)
    for _ in range(4):
        codes = rng.integers(0, 1 << 63, (pairs // 4, 50), dtype=np.uint64)
        both = np.stack([codes[:, :45], np.concatenate([codes[:, :40], codes[:, 45:]], axis=1)], axis=1)
        found = lshforest.labels(both.ravel(), np.arange(pairs // 2 + 1) * 45, low).reshape(-1, 2, lshforest.TREES)
        for k in range(lshforest.LEVELS + 1):
            cut = found >> (lshforest.BITS * (lshforest.LEVELS - k))
            missed[k] += (~(cut[:, 0] == cut[:, 1]).any(axis=1)).sum()
    want = np.array([pairs * (1 - lshforest.met(0.8, low + k)) for k in range(lshforest.LEVELS + 1)])
    assert (np.abs(missed - want) <= 5 * np.sqrt(want) + 3).all(), (missed, want)


def test_forest_of_large_components_and_many_partitions(spark, monkeypatch):
    """Blocks and ranges of a few rows give what SQL gives."""
    monkeypatch.setattr(lshforest, "BLOCK", 3)
    monkeypatch.setattr(common, "SLIM_ROWS", 0)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        same(spark, queries.op8_jaccard_join, queries.ORACLE_SQL["op8_jaccard_join"], SF)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_warc_with_version_lines_in_payloads(spark):
    rng = random.Random(1)
    bits = ["abc ", "WARC/1.1\r\n", "\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "é😀", "\n"]
    rows = [(i, "http://x/\r\ny", None if i % 17 == 0 else "".join(rng.choice(bits) for _ in range(rng.randrange(30))) if i % 5 else "z" * 200) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.setdefault(raw, i) if len(raw) >= 100 else i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), None if to == i else to)
        assert got[i].record_type == ("response" if to == i else "revisit")
    assert len(got) == len(rows)


def test_blocks_of_components_do_not_depend_on_partitions(spark, monkeypatch):
    """A component of 200 texts in blocks of 100 is three jobs, over however many partitions its rows are sorted."""
    rng, rows = random.Random(8), []
    base = [f"w{k}" for k in range(60)]
    for i in range(200):
        text = list(base)
        text[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(text)))
    docs, kept, want = spark.createDataFrame(rows, "doc_id long, text string"), {}, lshforest._compare
    put = lshforest.stored
    monkeypatch.setattr(lshforest, "BLOCK", 100)
    monkeypatch.setattr(lshforest, "stored", lambda df, what: kept.setdefault(what, put(df, what)))

    def sizes(*setting):
        run = want(*setting)
        return lambda pdf: pd.concat([run(pdf), pd.DataFrame({"a": [len(pdf)], "b": [0], "kind": [2]})])

    monkeypatch.setattr(lshforest, "_compare", sizes)
    names = {"spark.sql.shuffle.partitions": "25", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        out = {r.doc_id: r.n_links for r in lshforest.jaccard_join(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sets = [{tuple(t.split()[j : j + 5]) for j in range(56)} for _, t in rows]
    assert out == {i: sum(5 * len(a & b) >= 4 * len(a | b) for b in sets) - 1 for i, a in enumerate(sets)}
    assert kept["links"].where("kind = 2").agg(F.sum("a")).first()[0] == 400


def test_packing_by_the_tokenizer(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op9_packing(spark, SF).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(by_doc) == set(texts)
    total = 0
    for i, own in by_doc.items():
        ids = [*coder.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            part = ids[4096 * k : 4096 * (k + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 4096 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert len(own) == -(-len(ids) // 4096)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_sequence) <= math.ceil(total / 4096) * 1.02 + 1


@pytest.mark.parametrize("times, spread", [(1, "flat"), (40, "flat"), (1, "short"), (1000, "short")])
def test_packing_plan_covers_demand(times, spread):
    rng = np.random.default_rng(4)
    drawn = rng.integers(1, 4097, 5000 * times) if spread == "flat" else np.minimum(4095, 40 + rng.exponential(800, 5000)).astype(int)
    scale = 1 if spread == "flat" else times
    histogram = {int(k): int(n) * scale for k, n in zip(*np.unique(drawn, return_counts=True), strict=True)} | {4096: 9}
    facts = {}
    made = packing.plan(histogram, facts=facts)
    have = collections.Counter()
    for config, n in made:
        assert sum(k * a for k, a in config) <= 4096
        for k, a in config:
            have[k] += a * n
    assert have == histogram
    lowest = math.ceil(sum(k * n for k, n in histogram.items()) / 4096)
    assert facts["sequences"] == sum(n for _, n in made) <= (1.02 if spread == "flat" else 1.002) * lowest + 1
    # Rounded configurations carry the result, whatever the counts, and the LP's value is near the least one.
    assert facts["placed_by_lp"] >= 0.9
    assert lowest - 1 <= facts["bound"] <= facts["lp_value"] <= (1.02 if (times, spread) == (1, "flat") else 1.001) * facts["bound"]
    # Never more than the heuristic alone.
    size, count = (np.array(x, np.int64) for x in zip(*sorted(histogram.items()), strict=True))
    assert facts["sequences"] <= sum(packing.best_fit_decreasing(size, count).values())


def test_best_fit_runs_are_best_fit():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, 100, 40))
    counts = rng.integers(0, 9, len(lengths))
    room = []
    for size in sorted(np.repeat(lengths, counts).tolist(), reverse=True):
        fit = [r for r in range(len(room)) if room[r] >= size]
        if fit:
            room[min(fit, key=lambda r: room[r])] -= size
        else:
            room.append(100 - size)
    made = packing.best_fit_decreasing(lengths, counts, 100)
    rest = collections.Counter()
    for config, n in made.items():
        rest[100 - sum(int(lengths[k]) * a for k, a in config)] += n
    assert rest == collections.Counter(room)


def test_url_rules_of_any_length(spark):
    """Labelled URLs of which only five tokens together, two of them always beside each other, mean block."""
    rng, rows = random.Random(6), []
    for i in range(400):
        bits = [rng.random() < 0.75 for _ in range(4)]
        keys = [f"k{j}" for j, b in enumerate(bits) if b] + (["twin"] if bits[0] else [])
        rows.append((i, f"http://h{i}.{'bad' if all(bits) else 'good'}.net/x?" + "&".join(f"{k}=1" for k in keys)))
    rows += [(1000, "http://other.org/x?k0=1&k1=2&k2=3&k3=4"), (1001, "http://other.org/x?twin=1&k1=2&k2=3&k3=4"), (1002, "http://other.org/x?twin=1&k1=2&k2=3")]
    rules = [("block", "bad.net", "/"), ("allow", "good.net", "/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    # Host and scheme tokens left out: what remains takes all four keys.
    labelled = pages.where("page_id < 1000").select(F.col("page_id").alias("row"), F.filter(urlrules.url_tokens(F.lit(""), F.lit(""), F.col("url")), lambda x: x.startswith("key=")).alias("tokens"), F.col("url").contains("bad").alias("blocked"))
    alike = urlrules.alike_tokens(labelled, 0.01)
    assert {r.token: r.item for r in alike.collect()} == {f"key=k{j}": f"key=k{j}" for j in range(4)} | {"key=twin": "key=k0"}
    mined = urlrules.mine_rules(labelled, alike).collect()
    assert [sorted(r.tokens) for r in mined] == [[f"key=k{j}" for j in range(4)]]
    out = {r.page_id: r for r in urlrules.url_filter(pages, rules).collect()}
    assert [out[i].method_verdict for i in (1000, 1001, 1002)] == ["block", "block", "allow"]


@pytest.mark.parametrize("k", [11, 20])
def test_url_rules_of_many_loose_keys(spark, k):
    """Query keys that nearly all blocked URLs have, each by chance: rules by themselves, whose sets are not mined."""
    rng = random.Random(k)
    keys = lambda share: "&".join(f"k{chr(97 + i)}=1" for i in range(k) if rng.random() < share)
    rows = [(i, f"http://h.net/es/x?{keys(0.97)}") for i in range(1000)] + [(i, f"http://h{i % 9}.com/a/{i % 7}") for i in range(1000, 3000)] + [(i, f"http://q.org/b?{keys(0.3)}") for i in range(3000, 4000)]
    start = time.time()
    out = {r.page_id: r for r in urlrules.url_filter(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert time.time() - start < 60
    assert all(out[i].method_verdict == ("block" if i < 1000 or "k" in u.split("?")[-1] and "?" in u else "allow") for i, u in rows if i < 3000 or "?k" in u)


def test_word_ids_are_the_tokenizers():
    coder = packing.WordIds(queries.tokenizer_path())
    texts = ["Hello, WORLD's it's\t\n x", "", " ", "é\u0301 ﬁ \u00a0ab\x1cc <|endoftext|>d 12 3", "ǅ İ 中文字 a\r\nb"] * 2
    ids, count = coder.encode(texts)
    want = [e.ids for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert count.tolist() == [len(x) for x in want] and ids.tolist() == [x for y in want for x in y]


def test_word_ids_take_little_memory():
    """A worker keeps its cache between stages: 200,000 words take under 80 bytes each."""
    coder = packing.WordIds(queries.tokenizer_path())
    coder.encode([" ".join(f"w{i}" for i in range(a, a + 1000)) for a in range(0, 200_000, 1000)])
    held = sum(x.nbytes for x in (coder.known, coder.start, coder.length)) + coder.flat.itemsize * len(coder.flat)
    assert len(coder.known) == 200_000 and held < 80 * 200_000


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    bad = ["scum", "clown", "moron"]
    rows, labels = [], []
    for i in range(1200):
        w = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
        y = int(i % 5 == 0)
        if y:
            w[rng.randrange(60)] = rng.choice(bad)
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(docs, marks).join(marks, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert all(r.predicted == (r.score >= 0.3) for r in out)
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)


def test_importance_keeps_just_k_and_prefers_the_target(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc"] if i % 4 else ["xx!!", "yy!!"]) for _ in range(50))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int")
    out = importance.importance_resample(docs, marks).collect()
    assert sum(r.kept for r in out) == 300 and all(r.kept == (r.doc_id % 4 > 0) for r in out)
    key = {r.doc_id: r.log_weight + r.gumbel for r in out}
    for k in (1, 7, 399):
        part = importance.importance_resample(docs, marks, share=k / 400).where("kept").collect()
        assert {r.doc_id for r in part} == set(sorted(key, key=key.get)[-k:])


def test_pipeline_against_its_stages(spark):
    """Each stage's rows, one by one, against what its operator decides on the rows before."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in out.collect()}
        after = stage(spark, out, SF).persist()
        assert after.columns == docs.columns
        rows = {(r.doc_id, r.text) for r in after.collect()}
        if name == "quality rules":
            kept = {r.doc_id for r in outliers.quality_rules(out).where("kept").collect()}
            assert rows == {x for x in before if x[0] in kept}
        elif name == "n-gram Jaccard join":
            sets = {i: {tuple(words(t)[j : j + 5]) for j in range(max(1, len(words(t)) - 4))} for i, t in before}
            assert all(5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b]) for a in (x[0] for x in rows) for b in (x[0] for x in rows) if a < b)
            assert all(any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j, _ in before if j != i) for i, _ in before - rows)
        elif name == "substring dedup":
            assert {i for i, _ in rows} <= {i for i, _ in before} and sum(len(t) for _, t in rows) <= sum(len(t) for _, t in before)
            assert all(r.n_chars == len(r.text) for r in after.collect())
        else:
            assert rows <= before
        out = after
    assert corpus_pipeline.STAGES[-1][1](spark, out, SF).where("piece = 0").count() == out.count()


@pytest.mark.parametrize("k", [1, 2, 50, 99])
def test_kth_largest_with_ties(spark, k):
    values = [float(i // 3) for i in range(100)]
    level, ties = importance.kth_largest(spark.createDataFrame([(v,) for v in values], "x double"), "x", k)
    want = sorted(values, reverse=True)
    assert level == want[k - 1] and ties == k - sum(v > level for v in values)


def test_cover_trees_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(covertree, "LEAST", 40)
    monkeypatch.setattr(covertree, "MAX_CELLS", 9)
    monkeypatch.setattr(covertree, "TILE", 64)
    same(spark, queries.op7_embedding_near_dup, queries.ORACLE_SQL["op7_embedding_near_dup"], "/root/testdata/sf0.01")


@pytest.mark.parametrize("dim, spread", [(3, 0.5), (8, 0.4), (64, 0.3)])
def test_dual_traversal_against_all_pairs(dim, spread):
    rng = np.random.default_rng(dim)
    centers = rng.normal(size=(12, dim))
    x, y = (covertree.unit(np.concatenate([centers[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * spread / dim**0.5, rng.normal(size=(n, dim))])) for n in (150, 200))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : min(dim, 32)]
    a, b = covertree.CoverTree(x), covertree.CoverTree(y)
    for other in (None, b):
        points = a.points if other is None else np.concatenate([a.points, b.points])
        side = np.zeros(len(points), int) if other is None else np.repeat([0, 1], [len(x), len(y)])
        copies = rng.integers(1, 4, len(points))
        hit = points @ points.T >= 0.9
        np.fill_diagonal(hit, False)
        hit &= np.equal.outer(side, side) if other is None else ~np.equal.outer(side, side)
        count, label = covertree.dual_traversal(a, other, axes, 0.9, copies)
        assert (count == hit @ copies).all()
        want = np.arange(len(points))
        for _ in want:
            want = np.minimum(want, np.where(hit, want[None, :], len(want)).min(axis=1))
        assert len(set(zip(want.tolist(), label.tolist(), strict=True))) == len(set(want.tolist())) == len(set(label.tolist()))

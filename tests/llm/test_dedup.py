"""Near, suffix and substring dedup against brute force, and their edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackweave.llm import near_dedup, substring_dedup, suffix_dedup
from stackweave.llm.words import segment

SCHEMA = "doc_id long, text string, lang string, rep string, hash int, n int"
WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def corpus(n=80, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijé", k=rng.randint(1, 7))) for _ in range(3000)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    docs = [make(rng.choice([5, 60, 200, 400])) for _ in range(n)]
    for i in range(0, n, 4):
        source = docs[rng.randrange(n)]
        at = rng.randrange(max(1, len(source) - 70))
        docs[i] = docs[i][:30] + source[at : at + 70] + docs[i][30:]
    docs += [list(docs[1]), list(docs[2])]
    for i in (5, 6, 9):
        near = list(docs[i] * 2)
        docs.append(near)
    for i in range(10, 30):
        near = list(docs[i])
        for _ in range(len(near) // 50):
            near[rng.randrange(len(near))] = "changed"
        docs.append(near)
    docs += [["same"] * 300, ["ab", "ba"] * 200, ["ba", "ab"] * 100]
    return [(i, "  ".join(d) + ".\n", "en", "x", 1, 2) for i, d in enumerate(docs)]


EDGES = [(None, "no id " * 40, None, None, None, None), (900, None, None, None, None, None), (901, "", None, None, None, None), (902, " .,! ", None, None, None, None), (903, "one", None, None, None, None)]


def covered(rows):
    return {(r.doc_id, w) for r in rows for w in range(r.start_word, r.end_word)}


def windows(rows, k):
    """word windows by (doc_id, at), in order."""
    seen = {}
    for i, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1]}):
        w = WORD.findall(text.lower())
        for j in range(len(w) - k + 1):
            seen.setdefault(tuple(w[j : j + k]), []).append((i, j))
    return seen


def test_segment_folds_case_and_keeps_rows_apart():
    (w,) = segment(pa.array(["Éa É", None, "éA", "", "x"]))
    assert list(w.row) == [0, 0, 2, 4] and w.hash[0] == w.hash[2] and list(w.first) == [0, 2, 2, 3, 3, 4]


def test_long_rows_are_hashed_in_blocks():
    """A row longer than a block, and a word longer than one, have the hashes that plain arithmetic gives."""
    from stackweave.llm import words as w_

    text = "Ab é " * 250_000 + "x" * 600_000 + " end"
    (w,) = segment(pa.array([text]))
    short, long_ = segment(pa.array(["ab é ab é end", "x" * 600_000]))
    assert len(w.hash) == 500_002 and (w.hash[:-2:2] == short.hash[0]).all() and (w.hash[1:-2:2] == short.hash[1]).all()
    assert w.hash[-1] == short.hash[4] and w.hash[-2] == long_.hash[0]
    (many,) = segment(pa.array(["a b c " * 300_000]))
    g = many.grams(5)
    assert len(g) == 900_000 - 4 and (g[0::3] == g[0]).all() and (g[1::3] == g[1]).all() and len(set(g[:3].tolist())) == 3
    total = 0
    for i in reversed(range(3)):
        total = (total * (w_._GRAM) + int(many.hash[i])) % (1 << 64)
    assert int(many.grams(3)[0]) == int(w_.mix(np.array([total], np.uint64))[0])


def test_merge_runs_is_a_merge_with_common_prefixes():
    rng = random.Random(1)
    runs = []
    for _ in range(7):
        keys = sorted(tuple(rng.choices([1, 2], k=6)) for _ in range(rng.randrange(40)))
        lcp = [0] + [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(keys, keys[1:])]
        runs.append((keys, lcp[: len(keys)]))
    run, at, lcp = suffix_dedup.merge_runs(runs)
    merged = [runs[r][0][a] for r, a in zip(run, at)]
    assert merged == sorted(k for keys, _ in runs for k in keys)
    assert lcp[1:] == [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(merged, merged[1:])]


@pytest.mark.parametrize("repeat", [1, 2])
def test_suffix_dedup_equals_brute_force(spark, repeat):
    rows = (corpus() + EDGES) * repeat
    found = suffix_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {(i, j + d) for places in windows(rows, 50).values() for i, j in places[1:] for d in range(50)}
    assert covered(found) == want and len(want) > 1000
    assert all(r.first_doc_id <= r.doc_id for r in found)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus() + EDGES
    found = substring_dedup.incremental_repeats(spark.createDataFrame(rows, SCHEMA), batches=3).collect()
    chosen, at = {}, None
    for i, text in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1]):
        for w in segment(pa.array([text])):
            words = WORD.findall(text.lower())
            for at in w.anchors(32, 19)[0]:
                chosen.setdefault(tuple(words[at : at + 32]), []).append((i, int(at)))
    want = {(i, j + d) for places in chosen.values() for i, j in places[1:] for d in range(32)}
    assert covered(found) == want and len(want) > 1000
    # Every passage of 50 words that occurred before is hit.
    hit = covered(found)
    for places in windows(rows, 50).values():
        assert all(any((i, j + d) in hit for d in range(50)) for i, j in places[1:])


def test_substring_index_is_incremental(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    index = substring_dedup.FingerprintIndex(spark)
    assert index.add(df.filter("doc_id < 40")) is not None and [level for _, level in index.runs] == [0]
    again = index.add(df.filter("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 1000))
    assert [level for _, level in index.runs] == [1]
    assert again.select("start_word").count() > 0 and again.filter("first_doc_id >= 1000").count() == 0
    index.add(df.filter("doc_id >= 40"))
    assert [level for _, level in index.runs] == [1, 0]
    index.close()
    assert substring_dedup.incremental_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def whole(p, lo=None, hi=None):
    """The pair of a root with itself."""
    lo, hi = np.array([0]) if lo is None else lo, np.array([len(p)]) if hi is None else hi
    return lo, hi, lo, hi, np.zeros(len(lo), np.int64)


def test_trie_pairs_equal_brute_force():
    rng = np.random.default_rng(2)
    p = rng.integers(0, 1 << 63, (60, 2)).astype(np.uint64)
    p = np.concatenate([p, p ^ (np.uint64(1) << rng.integers(0, 40, (60, 2)).astype(np.uint64)), p[:5]])
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    d = np.bitwise_count(p[:, None] ^ p[None]).sum(2)
    for budget in (0, 2, 5, 50):
        for block in ((0, budget), (40, 1)):
            head = np.bitwise_count((p[:, None, 0] ^ p[None, :, 0]) >> np.uint64(64 - block[0])) if block[0] else 0 * d
            for leaf, frontier in ((2, 5), (1000, 1 << 16)):
                x, y = near_dedup.trie_pairs(p, whole(p), 0, block, budget, leaf=leaf, frontier=frontier)
                got = {tuple(sorted(q)) for q in zip(x.tolist(), y.tolist())}
                want = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if d[i, j] <= budget}
                sure = {(i, j) for i, j in want if head[i, j] <= block[1]}
                assert sure <= got <= want and len(x) == len(got)


def test_no_pair_within_the_budget_exceeds_every_block():
    for budget in (0, 3, 22):
        for m in range(4, 17):
            e = near_dedup.budgets(m, budget)
            assert len(e) == m and sum(x + 1 for x in e) > budget
    for n in (0, 1, 1000, 10**6, 10**8, 10**10):
        blocks, top = near_dedup.plan(n)
        assert sum(bits for bits, _ in blocks) == 128 and sum(e + 1 for _, e in blocks) > near_dedup.BUDGET and all(top <= bits for bits, _ in blocks)


def joined(sig, size):
    """Components of signatures by the tasks of the join, planned as for `size` of them."""
    blocks, top = near_dedup.plan(size)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sig))), *(pa.array(sig[:, i].view(np.int64)) for i in (0, 1))], ["rep", "s0", "s1"])
    rows = pa.Table.from_batches(near_dedup._nodes(blocks, min(top, 3))([batch])).combine_chunks().sort_by("key")
    out = pa.Table.from_batches(near_dedup._join_tries(blocks, min(top, 3), near_dedup.BUDGET)(iter(rows.to_batches(max_chunksize=5000))))
    return list(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))


@pytest.mark.parametrize("size", [5000, 10**6, 10**8])
def test_every_pair_up_to_the_budget_is_found_whatever_the_plan(size):
    """Pairs at each distance, planted among 10,000 signatures, with the blocks of small and of large inputs."""
    rng = np.random.default_rng(11)
    sig = rng.integers(0, 1 << 64, (10_000, 2), dtype=np.uint64)
    for k in range(31):  # rows 300 k .. 300 k + 149 have a partner at distance k
        for i in range(150):
            bits = np.zeros(128, np.uint8)
            bits[rng.choice(128, k, replace=False)] = 1
            sig[300 * k + 150 + i] = sig[300 * k + i] ^ np.packbits(bits).view(np.uint64)
    found = groups(joined(sig, size), range(len(sig)))
    for k in range(31):
        same = [found[300 * k + i] == found[300 * k + 150 + i] for i in range(150)]
        assert all(same) if k <= near_dedup.BUDGET else not any(same), k
    assert len(set(found.values())) == 10_000 - 23 * 150
    few = sig[: 300 * 20]
    alone = groups(joined(few, len(few)), range(len(few)))
    assert all(found[i] == alone[i] for i in range(len(few)))  # more rows change no pair


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rows = corpus(200) + EDGES
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r.kept_id for r in near_dedup.near_duplicates(df).collect()}
    ids = [r[0] for r in rows if r[0] is not None]
    sig, has = near_dedup.signatures(pa.array([r[1] for r in rows if r[0] is not None]))
    near = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if has[i] and has[j] and np.bitwise_count(sig[i] ^ sig[j]).sum() <= near_dedup.BUDGET]
    want = groups(near, ids)
    caught = sum(found.get(a) is not None and found.get(a) == found.get(b) for a, b in near)
    assert caught == len(near) and len(near) >= 20
    assert all(want[i] == k for i, k in found.items())
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i in [r[0] for r in rows] if found.get(i, i) == i)


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = spark.createDataFrame(corpus(8)[:3] * 2, SCHEMA)
    assert near_dedup.drop_near_duplicates(twice).count() == 6


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = groups(edges, {i for e in edges for i in e})
    assert got == {i: r for i, r in want.items() if i != r}


def test_signatures_do_not_depend_on_neighbours():
    texts = [r[1] for r in corpus(60)] + [None, ""]
    together, _ = near_dedup.signatures(pa.array(texts * 9))
    for i, t in enumerate(texts):
        alone, has = near_dedup.signatures(pa.array([t]))
        assert (alone[0] == together[i]).all() and has[0] == bool(t)


def test_stars_keep_the_components_and_save_the_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (4, 2)).astype(np.uint64)
    p = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, (n, 2, 6)).astype(np.uint64)).max(2) for b, n in zip(base, (700, 90, 2, 1))] + [rng.integers(0, 1 << 63, (60, 2)).astype(np.uint64)])
    p = np.unique(p, axis=0)
    lo, hi = np.array([0]), np.array([len(p)])
    for budget in (3, 8, 20):
        x, y = near_dedup.trie_pairs(p, whole(p), 0, (0, budget), budget)
        label, x0, y0 = near_dedup.stars(p, lo, hi, budget)
        x1, y1 = near_dedup.trie_pairs(p, whole(p), 0, (0, budget), budget, leaf=16, label=label)
        ids = range(len(p))
        assert groups(zip(x.tolist(), y.tolist()), ids) == groups([*zip(x0.tolist(), y0.tolist()), *zip(x1.tolist(), y1.tolist())], ids)
    assert len(x1) < len(x) / 20

"""Line dedup against all earlier documents."""

import random
from collections import defaultdict

from stackweave.llm import line_dedup

SCHEMA = "doc_id long, text string"
EDGES = [(None, "no id here " * 9), (None, None), (900, None), (901, ""), (902, " \n "), (903, "word")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain_patience(a, b):
    """Patience diff written down as its definition, without anything of the module: recursion, and the longest increasing sequence by its lengths."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(tail)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    pairs = [(i, y.index(line)) for i, line in enumerate(x) if x.count(line) == 1 == y.count(line)]
    if pairs:
        length = []
        for n, (_, j) in enumerate(pairs):
            length.append(1 + max((length[m] for m in range(n) if pairs[m][1] < j), default=0))
        chain, want, before = [], max(length), (len(x) + 1, len(y) + 1)
        for n in reversed(range(len(pairs))):  # of the places with the wanted length the last one, as the piles have it
            if length[n] == want and pairs[n][1] < before[1]:
                chain.insert(0, pairs[n])
                want, before = want - 1, pairs[n]
        i0 = j0 = 0
        for i, j in [*chain, (len(x), len(y))]:
            out += [(head + i0 + p, head + j0 + q) for p, q in plain_patience(x[i0:i], y[j0:j])]
            out += [(head + i, head + j)] * (i < len(x))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def plain_blocks(a, b, min_chars):
    """The lines of b in aligned blocks of at least min_chars characters."""
    blocks = []
    for i, j in plain_patience(a, b):
        if blocks and blocks[-1][-1] == (i - 1, j - 1):
            blocks[-1].append((i, j))
        else:
            blocks.append([(i, j)])
    return {j for block in blocks if sum(len(b[j]) for _, j in block) >= min_chars for _, j in block}


def brute(rows, min_chars):
    """Lines by document, and the line numbers that the alignments with all earlier documents delete."""
    docs = {d: [x.strip(" ") for x in text.split("\n")] for d, text in rows if d is not None and text is not None}
    gone = defaultdict(set)
    for d, lines in docs.items():
        for o, old in docs.items():
            if o < d:
                gone[d] |= plain_blocks(old, lines, min_chars)
    return docs, gone


def deleted(spark, rows):
    return defaultdict(set, {r["__sw_id"]: set(r["__sw_gone"]) for r in line_dedup.deletions(frame(spark, rows)).collect()})


def test_crossed_and_repeated_lines_go_on_to_further_holders(spark):
    rng = random.Random(14)
    pool = ["line %d %s" % (i, "w" * rng.randint(0, 25)) for i in range(40)] + ["", "x"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 14)))) for i in rng.sample(range(500), 150)]
    one, two = "a line that crosses the other one", "the other line, which is crossed"
    rows += [(1000, f"{one}\nbetween them\n{two}"), (1001, f"mine\n{one}\nyours"), (1002, f"theirs\n{two}\nours"), (1003, f"begin\n{two}\nwithin\n{one}\nend"), (1004, rows[3][1]), *EDGES]
    docs, gone = brute(rows, 20)
    assert gone[1003] == {1, 3}
    got = deleted(spark, rows)
    for d in docs:
        assert got[d] == gone[d], d
    by = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert by[1003] == "begin\nwithin\nend" and by[900] is None and by[901] == ""
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    assert line_dedup.dedup_lines(frame(spark, rows[:9] * 2)).count() == 18


def test_rows_of_one_doc_id_are_not_aligned_with_one_another(spark):
    passage = "a passage that three rows hold"
    got = deleted(spark, [(1, f"first\n{passage}"), (1, f"{passage}\nsecond"), (2, f"{passage}\nthird"), (2, f"{passage}\nthird")])
    assert got == {2: {0}}


def test_rows_of_one_doc_id_lose_their_own_lines_only(spark):
    passage = "a passage that stands in an earlier document"
    rows = [(1, passage), (7, f"{passage}\nmine"), (7, "a sentence that nobody else has\nmine too"), (7, f"{passage}\nmine")]
    got = sorted(r.text for r in line_dedup.dedup_lines(frame(spark, rows)).filter("doc_id = 7").collect())
    assert got == ["a sentence that nobody else has\nmine too", "mine", "mine"]


def test_documents_of_short_lines_and_of_one_line_that_many_hold(spark):
    verse = "\n".join(f"short line no {i:02}" for i in range(20))
    rows = [(1, verse), (2, verse)] + [(i, f"{i} begins here, all by itself\nthe line that each of these documents holds\nand ends {i}") for i in range(100, 300)]
    by = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert by[1] == verse and by[2] == "" and "each of these" in by[100]
    assert all(by[i] == f"{i} begins here, all by itself\nand ends {i}" for i in range(101, 300))


def test_a_frequent_line_goes_on_to_all_its_holders(spark):
    """The line crosses in the first holders and many others, and aligns with a late one only."""
    rng = random.Random(19)
    hot = "the line that very many documents hold"
    rows = [(0, f"{hot}\nanchor of the zeroth document")]
    for i in range(1, 120):
        rows.append((i, "\n".join([hot, hot, f"own {rng.random()}"])))
    rows += [(500, f"anchor of the zeroth document\n{hot}\n{hot}\nx"), (501, f"{hot}\ny\n{hot}"), (502, f"y\n{hot}\n{hot}\nx")]
    docs, gone = brute(rows, 20)
    got = deleted(spark, rows)
    assert {d: got[d] for d in docs} == {d: gone[d] for d in docs}


def test_patience_equals_its_plain_form():
    rng = random.Random(20)
    for _ in range(2000):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert line_dedup.patience(a, b) == plain_patience(a, b)
        lines = [x * 7 for x in b]
        assert set(line_dedup.common_blocks([x * 7 for x in a], lines, [7] * len(b), 20)) == plain_blocks([x * 7 for x in a], lines, 20)


def test_passages_in_short_lines_equal_brute_force(spark):
    rng = random.Random(15)
    pool = ["w" * rng.randint(1, 9) + str(i) for i in range(12)] + ["", "", "a single line that is long enough"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 14)))) for i in rng.sample(range(500), 150)]
    verse = [f"verse {i} goes on" for i in range(20)]
    rows += [(1000, "\n".join(["first", *verse])), (1001, "\n".join(["mine", *verse, "own end"])), (1002, rows[3][1]), *EDGES]
    docs, gone = brute(rows, 20)
    assert gone[1001] == set(range(1, 21))
    got = deleted(spark, rows)
    for d in docs:
        assert got[d] == gone[d], d


def test_every_shared_block_is_covered_by_keys_within_it():
    rng = random.Random(16)
    for _ in range(300):
        block = [rng.randint(-(1 << 63), 1 << 63) for _ in range(rng.randint(1, 9))]
        size = [rng.choice((0, 0, 3, 9, 12, 25)) for _ in block]
        alone = {k: (i, j) for k, i, j in line_dedup.evidence(block, size, 20)}
        covered = {x for i, j in alone.values() for x in range(i, j)}
        assert covered == (set(range(len(block))) if sum(size) >= 20 else set())
        inside = {k for k, _, _ in line_dedup.evidence([7, None, 8, *block, 9], [5, 30, *size, 15], 20)}
        assert set(alone) <= inside

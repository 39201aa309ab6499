import itertools
import random

import numpy as np

from tessera.llm import substring_dedup as sd


def tree(h, least):
    out = []

    def node(a, b):
        if b - a + 1 >= least:
            c = a + int(np.argmin(h[a : b + 1]))
            out.append((a, c, b))
            node(a, c - 1), node(c + 1, b)

    node(0, len(h) - 1)
    return sorted(out)


def test_windows_are_the_trees_nodes():
    r = np.random.default_rng(1)
    for n, least in ((5, 6), (40, 8), (500, 20), (1000, 46)):
        h = r.integers(0, 2**63, n, np.uint64)
        assert sorted(map(tuple, sd.compact_windows(h, least).tolist())) == tree(h, least)
    tied = r.integers(0, 9, 300, np.uint64)
    for a, c, b in sd.compact_windows(tied, 10).tolist():
        assert b - a + 1 >= 10 and tied[a : b + 1].min() == tied[c]


def test_finds_planted_passages_only(table, prose):
    r = random.Random(2)
    texts = {i: prose(i, r.choice([200, 800])).split() for i in range(24)}
    passage, near = prose(777, 60).split(), prose(778, 120).split()
    phrase = prose(779, 12).split()
    holders, near_holders = [2, 5, 11, 17], [3, 8, 20]
    for i in range(24):  # a common phrase in every text is no passage
        texts[i][10:10] = phrase
    for i in holders:
        at = r.randrange(30, 150)
        texts[i][at:at] = passage
    for i in near_holders:
        w = list(near)
        w[r.randrange(20, 100)] = f"edit{i}"
        texts[i][60:60] = w
    docs = [(i, " ".join(w)) for i, w in texts.items()] + [(30, None), (31, "short"), (None, " ".join(texts[2]))]
    got = sd.repeated_passages(table(docs)).collect()
    found = {r.key1 for r in got} | {r.key2 for r in got}
    assert found == {*holders, *near_holders, None}
    for x in got:
        a = texts[x.key1 if x.key1 is not None else 2][x.start1 : x.end1]
        b = texts[x.key2 if x.key2 is not None else 2][x.start : x.end]
        assert min(len(a), len(b)) >= 50 and x.similarity >= 0.8
    assert sd.repeated_passages(table(docs).filter("doc_id > 99")).count() == 0


def common_run(a, b):
    """Length in words of the longest run that two texts have in common."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = before[j] + 1
        best, before = max(best, *now), now
    return best


def classes(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return find


def test_every_pair_of_a_small_corpus(table):
    """All pairs by brute force: documents that share 50 words or more are linked, straight or through others, and no others are."""
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(3000)]
    words = lambda n: r.choices(vocabulary, k=n)
    phrases = [words(n) for n in (12, 30, 44, 48, 52, 60, 90, 150)]
    texts = []
    for _ in range(70):
        w = words(r.randint(0, 60))
        for p in r.sample(phrases, r.randint(0, 3)):
            cut = r.choice([0, 0, 4, 8])
            w += p[cut:] + words(r.randint(1, 60))
        texts.append(w)
    texts += [texts[3], texts[3] + ["more"], phrases[7][:60] + words(9) + phrases[7][:60], [], words(49)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = sd.repeated_passages(table(docs)).collect()
    want = {(i, j) for i in range(len(texts)) for j in range(i) if common_run(texts[i], texts[j]) >= 50}
    found = classes([(x.key1, x.key2) for x in got])
    lost = [p for p in want if found(p[0]) != found(p[1])]
    assert len(lost) <= 0.01 * len(want), lost
    true = classes(want)
    assert all(true(x.key1) == true(x.key2) for x in got)
    # both places within one text are found
    places = {(x.start // 60, x.end // 60) for x in got if x.key2 == 72} | {(x.start1 // 60, x.end1 // 60) for x in got if x.key1 == 72}
    assert places >= {(0, 1), (1, 2)}
    for x in got:
        a, b = texts[x.key1][x.start1 : x.end1], texts[x.key2][x.start : x.end]
        assert min(len(a), len(b)) >= 50 and x.similarity >= 0.8


def test_shared_phrases_hide_nothing(table):
    """Two texts share a passage, a third only a phrase of it that is too short: the first window of all is no help."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(5000)]
    words = lambda n: r.choices(vocabulary, k=n)
    texts, want = [], []
    for phrase, more, first in ((45, 8, False), (30, 25, True), (48, 2, False)) * 20:
        p, e = words(phrase), words(more)
        passage = e[: more // 2] + p + e[more // 2 :] if first else p + e
        i = len(texts)
        texts += [words(r.randint(30, 90)) + x + words(r.randint(30, 90)) for x in (p, passage, passage)]
        want.append((i + 1, i + 2))
    got = {tuple(sorted((x.key1, x.key2))) for x in sd.repeated_passages(table([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert sum(p in got for p in want) >= 0.99 * len(want)
    assert got <= set(want)


def test_odd_texts(table, prose):
    """Ties in one text, a very long text, and repeated rows with null ids."""
    long = prose(31, 60_000)
    part = " ".join(long.split()[40_000:40_080])
    docs = [(1, "la " * 5000), (2, long), (3, "before it " + part + " after"), (None, prose(32, 80)), (None, prose(32, 80)), (4, "la " * 5000)]
    docs.append((5, prose(33, 70) + " and then again " + prose(33, 70)))
    got = sd.repeated_passages(table(docs)).collect()
    pairs = {(x.key1, x.key2) for x in got}
    assert {(2, 3), (None, None), (1, 4), (5, 5)} <= pairs
    assert all(x.end1 <= x.start for x in got if x.key1 == x.key2 and x.key1 is not None)


def test_values_meet_over_batches(table, prose, monkeypatch):
    """A passage that all texts hold is linked as trees, never all pairs, whatever the batches."""
    monkeypatch.setattr(sd, "_TOGETHER", 500)
    passage = prose(50, 70)
    docs = [(i, prose(100 + i, 40) + " " + passage + " " + prose(900 + i, 40)) for i in range(60)]
    got = sd.repeated_passages(table(docs)).collect()
    found = classes([(x.key1, x.key2) for x in got])
    assert len({found(i) for i in range(60)}) == 1 and len(got) < 60 * 8


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_long_insertions_and_deletions(table):
    """Passages whose halves are too short alone, with one long edit between them or several: all that reach the threshold are found."""
    r = random.Random(21)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(4000)]
    words = lambda n: r.choices(vocabulary, k=n)
    texts, want = [], []

    def pair(one, two):
        if jaccard(one, two) >= 0.8:
            want.append((len(texts), len(texts) + 1))
        texts.extend(words(r.randint(20, 80)) + x + words(r.randint(20, 80)) for x in (one, two))

    for n, k in ((96, 12), (98, 14), (100, 16), (110, 17), (120, 18), (130, 18), (130, 22), (200, 36), (90, 10)) * 12:
        p, at = words(n), n // 2 + r.randint(-4, 4)
        one, two = p, p[:at] + words(k) + p[at:]
        pair(*((one, two) if r.random() < 0.5 else (two, one)))
    for n in (100, 140, 300) * 8:  # replaced, deleted and inserted words
        p = words(n)
        q = p[: n // 3] + words(r.randint(0, 4)) + p[n // 3 + r.randint(0, 3) : 2 * n // 3] + words(r.randint(1, 6)) + p[2 * n // 3 :]
        pair(p, q)
    near = len(want)
    for n in (60, 80):  # the edit is too long: neither half is a passage
        for _ in range(6):
            p = words(n)
            pair(p, p[: n // 2] + words(30) + p[n // 2 :])
    assert near > 90 and len(want) == near
    got = {}
    for x in sd.repeated_passages(table([(i, " ".join(t)) for i, t in enumerate(texts)])).collect():
        got.setdefault(tuple(sorted((x.key1, x.key2))), []).append(x)
        a, b = texts[x.key1][x.start1 : x.end1], texts[x.key2][x.start : x.end]
        assert min(len(a), len(b)) >= 50 and jaccard(a, b) >= 0.8
    assert [p for p in want if p not in got] == []
    # of the others a half may be a passage, but none of the last twelve
    assert all(i % 2 == 0 and j == i + 1 and i < len(texts) - 24 for i, j in got)


def test_words_are_hashed_where_they_lie(monkeypatch):
    """Hashes from running sums tell words apart as ``words_of`` does, in any script, over white space of any kind and over pieces."""
    odd = [None, "", " ", " A b　c\x1cd\x85e\xa0 F", "\x00 \x00\x00 x", "İ ǅ \ud800 \U0001f600 stra\xdfe Stra\xdfe", "x" * 3000 + " y " + "z " * 2000, "ab cd " * 1000]
    for piece in (1 << 18, 64):
        monkeypatch.setattr(sd.shingles, "_PIECE", piece)
        known = {}
        for t in odd:
            words, hashes = sd.shingles.words_of(t), sd.shingles.hash_text(t).tolist()
            assert len(words) == len(hashes)
            assert all(known.setdefault(w, h) == h for w, h in zip(words, hashes))
        assert len(set(known.values())) == len(known) > 10


def test_repeated_values_are_no_long_way():
    """Windows of texts that repeat a word or a period are the tree's, with the leftmost of equal values on top, and no round goes value by value."""
    r = np.random.default_rng(4)
    for h in (np.full(3000, 7, np.uint64), np.tile(r.integers(0, 2**63, 7, np.uint64), 300), np.repeat(r.integers(0, 9, 40).astype(np.uint64), 60)):
        assert sorted(map(tuple, sd.compact_windows(h, 46).tolist())) == sorted(x for x in by_stack(h) if x[2] - x[0] >= 45)
    looks = 0

    def stops(a, b):
        nonlocal looks
        looks += 1
        return a < b

    sd._bound(np.arange(100_000)[::-1], stops)
    assert looks < 50


def by_stack(h):
    left, right, stack = [0] * len(h), [len(h) - 1] * len(h), []
    for i, v in enumerate(h.tolist()):
        while stack and h[stack[-1]] > v:
            right[stack.pop()] = i - 1
        left[i] = stack[-1] + 1 if stack else 0
        stack.append(i)
    return list(zip(left, range(len(h)), right))


def test_alignments_by_numbers_and_by_arrays_agree(monkeypatch):
    """Few shingles and blocks are compared as Python numbers, many as arrays: both find the same."""
    r = np.random.default_rng(6)
    found = []
    for few in (10_000, 0):
        monkeypatch.setattr(sd, "_FEW", few)
        monkeypatch.setattr(sd, "_FEW_BLOCKS", few)
        r = np.random.default_rng(6)
        some = []
        for _ in range(60):
            a = r.integers(0, 2**63, r.integers(60, 900), np.uint64)
            b = a.copy()
            for at in r.integers(0, len(a), r.integers(0, 40)):
                b = np.concatenate([b[:at], r.integers(0, 2**63, r.integers(0, 9), np.uint64), b[at + r.integers(0, 9) :]])
            same = np.flatnonzero(a[: len(b)] == b[: len(a)])
            some.append([x.tolist() if isinstance(x, np.ndarray) else x for x in sd.passages(a, b, same, same)])
        found.append(some)
    assert found[0] == found[1] and sum(len(x[0]) for x in found[0]) > 30


def test_words_are_counted_for_copies_only(table, prose):
    """The texts' words are counted above the join with the copies, not for every row below it."""
    docs = [(i, prose(60 + i % 3, 70)) for i in range(4)] + [(9, "short"), (10, "short")]
    got = sd.repeated_passages(table(docs))
    assert [(x.key1, x.key2, x.end) for x in got.collect()] == [(0, 3, 70)]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    for i, line in enumerate(plan):
        if "regexp_replace" in line:
            below = list(itertools.takewhile(lambda x, line=line: depth(x) > depth(line), plan[i + 1 :]))
            assert any("Join" in x for x in below)

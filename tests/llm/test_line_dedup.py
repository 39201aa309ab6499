import random

from tessera.llm import line_dedup


def brute(docs, least=20):
    """Deletes what any window of lines, of any length, has in common with an earlier one."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    seqs = {i: [(n, s) for n, s in enumerate((docs[i][1] or "").split("\n")) if s.strip()] for i in order}
    gone = {i: set() for i in order}
    width = 1
    while any(len(s) >= width for s in seqs.values()):
        seen = set()
        for i in order:
            s = seqs[i]
            for at in range(len(s) - width + 1):
                w = tuple(x for _, x in s[at : at + width])
                if w in seen and sum(map(len, w)) >= least:
                    gone[i] |= {n for n, _ in s[at : at + width]}
                seen.add(w)
        width += 1
    return {i: "\n".join(s for n, s in enumerate((docs[i][1] or "").split("\n")) if n not in gone[i]) for i in order}


def test_matches_brute_force(table, prose):
    a, b = prose(1, 60, 6), prose(2, 40, 8)
    docs = [
        (1, a), (2, "intro line of this text\n" + a + "\nlast"), (3, b + "\n" + b), (4, "x\ny\nz\n\n" + b), (5, None), (6, ""),
        (7, "one\ntwo\nthree\nfour five six\n" * 3), (8, "a\nb\nc"), (9, "a\nb\nc"), (10, "line that is long enough\n" * 9),
        (11, "\n".join(a.split("\n")[2:5])), (12, "\n \n"),
    ]
    want = brute(docs)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(docs), counts=True).collect()}
    for i, (key, text) in enumerate(docs):
        assert (got[key].text or "") == want[i], key
        assert got[key].n_removed == len((text or "").split("\n")) - len(want[i].split("\n")) or want[i] == ""
    assert got[5].text is None and got[1].text == a and got[11].text == ""


def test_short_lines_count_together(table):
    """Runs count with all their lines, whatever their number, and windows that start or end them."""
    three, five = "alpha on\nbeta two\ngamma xy", "a\nbb\nccc\ndddd\neeeee\nffffff"
    docs = [
        (1, "first line here\n" + three), (2, "another start\n" + three + "\nz"), (3, three),
        (4, "x" * 40 + "\nfive5\n5five"), (5, "q\n" + "x" * 40 + "\nfive5\n5five\nr"), (6, "five5\n5five"),
        (7, five), (8, "9\n" + five + "\n8"), (9, "bb\nccc\ndddd\neeeee"), (10, "bb\nccc\ndddd\neeeee\nffffff"),
        (11, "\n".join("abcdefghijklmnopqrstuvwxyz")), (12, "1\n" + "\n".join("cdefghijklmnopqrstuvwxy") + "\n2"), (13, "\n".join("cdefghijklmnopqrstu")),
    ]
    want = brute(docs)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(docs)).collect()}
    assert got == {key: want[i] for i, (key, _) in enumerate(docs)}
    assert got[2] == "another start\nz" and got[3] == "" and got[5] == "q\nr" and got[6] == "five5\n5five" and got[12] == "1\n2"


def test_random_lines_match_brute_force(table):
    r = random.Random(3)
    docs = [(i, "\n".join(r.choice(["a", "bb", "cccc", "dddddd", "e" * 9, "f" * 21, " "]) for _ in range(r.randrange(40)))) for i in range(80)]
    docs.append((500, "\n".join(f"line {i % 700}" for i in range(5000))))
    want = brute(docs[:-1])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(docs)).collect()}
    assert {k: t for k, t in got.items() if k != 500} == {key: want[i] for i, (key, _) in enumerate(docs[:-1])}
    assert got[500] == "\n".join(f"line {i}" for i in range(700))


def test_repeated_rows_and_empty_tables(table, prose):
    text = prose(3, 50, 5)
    docs = table([(1, text), (1, text), (None, text), (None, None)])
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted(len(r.text or "") for r in out.collect()) == [0, 0, 0, len(text)]
    assert line_dedup.dedup_lines(docs.filter("doc_id > 9")).count() == 0

from tessera.llm import quality_rules


def repeat_words(words):
    n = len(words)
    seen = {}
    for i in range(n - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + d for at in seen.values() if len(at) > 1 for i in at for d in range(3)})


def test_figures_match_plain_counting(table):
    texts = [None, "", " \n\t ", "a b c", "a b c a b c", "the cat of the cat of the cat", "x x x x x", "one\n\none\ntwo\none", "#a $b |c| <d>", "a\tb\x0bc\rd"]
    docs = table(list(enumerate(texts)))
    for r in quality_rules.judge(docs).collect():
        words = [w for w in (texts[r.doc_id] or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\r", " ").split(" ") if w]
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if x.strip()]
        assert r.n_words == len(words)
        assert r.word_chars == sum(map(len, words))
        assert r.n_repeat_words == repeat_words(words)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in texts[r.doc_id] or "")


def test_keeps_prose_and_all_columns(table):
    good = "the old house on the hill was sold to a man from the town and he said that it is a fine place to live " * 1
    good += " ".join(f"word{i}" if i % 3 else "of" for i in range(60))
    docs = table([(1, good), (2, good.upper()), (3, None), (4, " ".join(w + "$$$" for w in good.split())), (1, good)])
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1]
    assert quality_rules.keep(docs.filter("doc_id > 99")).count() == 0


def test_clashing_names_stay(table):
    good = "the old house on the hill was sold to a man from the town and he said that it is a fine place to live "
    good += " ".join(f"word{i}" if i % 3 else "of" for i in range(60))
    docs = table([(1, good)]).withColumns({"_q_text": quality_rules.F.lit("mine"), "_q_words": quality_rules.F.lit(5), "kept": quality_rules.F.lit("k")})
    (row,) = quality_rules.keep(docs).collect()
    assert (row._q_text, row._q_words, row.kept) == ("mine", 5, "k")


def test_long_text_in_linear_memory(table):
    text = " ".join(f"w{i % 5000}" for i in range(60_000))
    (r,) = quality_rules.judge(table([(1, text)])).collect()
    assert r.n_words == 60_000 and r.n_repeat_words == 60_000


def test_kept_rows_keep_odd_columns(table):
    text = "the words of a text that is kept and to be in it for long " * 5
    docs = table([(1, text), (2, "short"), (1, text), (None, None)]).withColumnsRenamed({"key": "a.b", "rank": "stop_words"})
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    judged = quality_rules.judge(docs)
    assert kept.count() == judged.filter("kept").count()

import random

from kvlake.llm import leaks


def brute(text, item, least=20, per=6):
    """All stretches of the item against all of the text, by edit distance with free ends."""
    t, i = leaks.words_of(text), leaks.words_of(item)
    for a in range(len(i) - least + 1):
        row = [0] * (len(t) + 1)
        for n, w in enumerate(i[a:], 1):
            new = [n]
            for j, x in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != w)))
            row = new
            if n >= least and min(row) * per <= n:
                return True
    return False


def test_stretches_against_brute_force():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(f"i{n}", " ".join(r.choices(vocabulary, k=60)), " ".join(r.choices(vocabulary, k=9)) + "?") for n in range(6)]
    index, texts, want = leaks.Items(items), [], []
    for case in range(150):
        name, context, question = r.choice(items)
        words = context.split()
        a = r.randint(0, 20)
        part = words[a : a + r.choice([10, 15, 19, 20, 24, 35])]
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            at = r.randrange(len(part))
            part = r.choice([part[:at] + ["new"] + part[at:], part[:at] + part[at + 1 :], part[:at] + ["other"] + part[at + 1 :]])
        body = question.upper() if case % 10 == 0 else f"# {' **'.join(part)}"
        texts.append(" ".join(r.choices(vocabulary, k=15)) + "\n" + body + " " + " ".join(r.choices(vocabulary, k=15)))
    found = index.find(texts)
    wrong = missed = held = 0
    for t, got in zip(texts, found, strict=True):
        for name, context, question in items:
            whole = " ".join(leaks.words_of(question)) in " ".join(leaks.words_of(t))
            there = whole or brute(t, context)
            held += there
            wrong += name in got and not there
            missed += there and name not in got

    assert held > 40 and (wrong, missed) == (0, 0)


def test_rows(spark):
    context = " ".join(f"word{i}" for i in range(40))
    items = spark.createDataFrame([("a", context, "Who holds page nine?"), ("b", None, "How many?"), (None, context, "x"), ("c", "short", None)], "doc_id string, context_text string, query_prompt string")
    docs = spark.createDataFrame([(1, f"x {context.upper()} y", "n"), (2, "WHO **holds** page-nine", "n"), (3, None, "n"), (4, "", "n"), (5, "how many", "n"), (6, "word1 word2 " * 50_000, "n")], "doc_id int, text string, item_id string")
    want = {(1, "a"), (2, "a"), (5, "b")}
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(docs, items).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(docs, items, block_chars=1).collect()} == want
    assert leaks.leaked(docs.limit(0), items).count() == 0 and leaks.leaked(docs, items.limit(0)).count() == 0


def test_long_stretches_with_clustered_edits_against_brute_force():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(f"i{n}", " ".join(r.choices(vocabulary, k=130)), None) for n in range(4)]
    index, held = leaks.Items(items), 0
    for _ in range(120):
        name, context, _ = r.choice(items)
        a = r.randint(0, 40)
        part = context.split()[a : a + r.choice([20, 30, 36, 60, 90])]
        left = len(part) // 6 + r.choice([-1, 0, 0, 1])
        while left > 0:
            n = min(left, r.choice([1, 1, 2, 6, 9, 15]))
            at = r.randrange(len(part) + 1)
            kind = r.choice("idc")
            part = part[:at] + (["new"] * n if kind != "d" else []) + part[at + (n if kind != "i" else 0) :]
            left -= n
        text = " ".join([*r.choices(vocabulary, k=30), *part, *r.choices(vocabulary, k=30)])
        there = brute(text, context)
        held += there
        assert (name in index.find([text])[0]) == there, (name, text)
    assert held > 60


def test_short_questions_do_not_change_how_contexts_are_found():
    context = " ".join(f"word{i}" for i in range(40))
    index = leaks.Items([("a", context, "Why?"), ("b", None, "page pool size"), ("c", None, "Who holds the last page of the pool?")])
    assert index.seed == leaks.SEED
    got = index.find(["but WHY not", "the page-pool size is", "page pool", "who holds the last page of the pool", " ".join(context.split()[5:26]), "word1 word2 word3 " * 20])
    assert got == [{"a"}, {"b"}, set(), {"c"}, {"a"}, set()]


def test_characters_are_words_where_no_blanks_are_written():
    han = "页面缓冲区会改写过期索引位于第二十四层校验过程早于残差位淘汰队列早于打包"
    index = leaks.Items([("a", han, None)])
    assert index.find(["前言" + han[3:30] + "结束", "前言" + han[3:18] + "结束"]) == [{"a"}, set()]


def test_places_of_words():
    for text in ("The <b>page</b> pool's  CAFÉ &amp; na&#239;ve \\u00e9t\\u00e9", "ﬁne Straße ét́é ½ ㎏ 가각 각", "", "\\n a_b don’t", "&notit; <x y='1'> z &lt;b&gt;w"):
        words, places = leaks.words_of(text), leaks.word_places(text)
        assert len(words) == len(places) and all(0 <= b < e <= len(text) for b, e in places)
    text = "x <b>The</b> Page&nbsp;pool it’s"
    assert [text[b:e] for b, e in leaks.word_places(text)] == ["x", "The", "Page", "pool", "it’s"]


def test_spans_and_removal(spark):
    context = " ".join(f"word{i}" for i in range(40))
    items = spark.createDataFrame([("a", context, "Who holds page nine?"), ("b", " ".join(f"other{i}" for i in range(25)), "What now of it all?")], "doc_id string, context_text string, query_prompt string")
    part = ", ".join(context.upper().split()[:30])
    docs = spark.createDataFrame([(1, f"Before. {part} After", 0), (2, "x who <i>holds</i> page-nine? y", 0), (3, None, 0), (4, "", 0), (5, f"{part}. Who holds page nine? {part}", 0), (5, "clean", 0)], "doc_id int, text string, n_removed int")
    for block in (1, 10**6):
        spans = {(r.doc_id, r.item_id, r.kind, r.begin_at, r.end_at, r.n_words, round(r.coverage, 3)) for r in leaks.leak_spans(docs, items, block_chars=block).collect()}
        n = len(part)
        assert spans == {(1, "a", "context", 8, 8 + n, 30, 0.75), (2, "a", "question", 2, 28, 4, 1.0), (5, "a", "context", 0, n, 30, 0.75), (5, "a", "context", n + 23, 2 * n + 23, 30, 0.75), (5, "a", "question", n + 2, n + 21, 4, 1.0)}
        got = sorted((r.doc_id, r.n_removed, r.text) for r in leaks.without_leaks(docs, items, block_chars=block).collect())
        assert got == [(1, n, "Before.  After"), (2, 26, "x ? y"), (4, 0, ""), (5, 0, "clean"), (5, 2 * n + 19, ". ? ")]

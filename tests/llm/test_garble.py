from kvlake.llm import garble

CLEAN = [
    "The page pool of Brévhob keeps every key in 409 µs – roughly 3 × faster, or “Ørkpô mode”.", "Le cache déplace l’index périmé après 357 jetons, même si Åststi tourne.",
    "Die Freiliste überschreibt das größte Dokument für Mülzel.", "A verificação não altera a posição; CONFIGURAÇÃO – VERSÃO ESTÁVEL, ÂGE.", "La memoria añade la última página según Škoosk. ¿Qué falta?",
    "Буфер страниц системы опережает остаточные биты, хотя ещё работает.", "页面缓冲区会改写过期索引，位于第24层。校验过程早于残差位。", "Plain text about pages. ¯\\_(ツ)_/¯ 👍",
]


def test_made_mistakes_are_found_and_undone(spark):
    rows = [(i, CLEAN[i % len(CLEAN)] + f" Nr {i}.") for i in range(1600)]
    made = []
    for text, wrong, true in (
        (CLEAN[0], "cp437", "utf-8"), (CLEAN[1], "mac_roman", "utf-8"), (CLEAN[2], "cp850", "utf-8"), (CLEAN[3], "latin-1", "utf-8"), (CLEAN[5], "latin-1", "cp1251"),
        (CLEAN[5], "cp1251", "koi8_r"), (CLEAN[6], "latin-1", "gbk"), (CLEAN[5], "cp1251", "utf-8"), ("a naïve word", "cp1252", "utf-8"),
    ):
        raw = text.encode(true, "ignore")
        made.append((5000 + len(made), raw.decode(wrong, "replace"), text))
    twice = CLEAN[2].encode().decode("cp1252", "ignore").encode().decode("cp1252", "ignore")
    extra = [(6000, twice), (6001, "lost � here"), (6002, None), (6003, ""), (6004, "plain ascii " * 20_000), (6005, None)]
    df = spark.createDataFrame([*rows, *((i, t) for i, t, _ in made), *extra], "doc_id int, text string").repartition(4)
    got = {r.doc_id: r for r in garble.garbled(df).collect()}
    assert set(got) == {i for i, _, _ in made} | {6000, 6001}
    assert got[5000].restored == CLEAN[0] and got[5002].restored == CLEAN[2] and got[5008].restored == "a naïve word" and got[6001].restored is None
    assert garble.garbled(df.limit(0)).count() == 0


def found(spark, rows):
    return {r.doc_id: r for r in garble.garbled(spark.createDataFrame(rows, "doc_id int, text string")).collect()}


def test_one_document_alone(spark):
    for text, wrong, true in ((CLEAN[1], "cp1252", "utf-8"), (CLEAN[4], "mac_roman", "utf-8"), (CLEAN[2], "cp437", "utf-8"), (CLEAN[5], "cp1251", "utf-8"), (CLEAN[5], "latin-1", "cp1251"), (CLEAN[6], "latin-1", "gbk")):
        raw = text.encode(true, "ignore")
        bad = raw.decode(wrong, "ignore")
        if wrong == "cp1252" and "\xa0" in bad or raw.decode(wrong, "replace") != bad:
            bad = raw.decode("latin-1")
        assert found(spark, [(1, bad)])[1].restored == text, (wrong, true)
    assert found(spark, [(1, CLEAN[0])]) == found(spark, [(1, "┌──┬──┐\n├──┼──┤\n└──┴──┘ É” IRMÔ… 2√π")]) == {}


def test_a_third_of_the_rows_alike(spark):
    own = {1: (CLEAN[1], "latin-1", "utf-8"), 2: (CLEAN[2], "cp850", "utf-8"), 3: (CLEAN[5], "latin-1", "cp1251")}
    for text, wrong, true in own.values():
        rows = [(i, f"{text} Nr {i}.".encode(true).decode(wrong) if i % 3 == 0 else f"{CLEAN[i % len(CLEAN)]} Nr {i}.") for i in range(600)]
        got = found(spark, rows)
        assert set(got) == set(range(0, 600, 3)) and all(r.restored == f"{text} Nr {i}." for i, r in got.items())


def test_single_letters_of_legacy_codecs(spark):
    french, german = "La décision de la régie a précédé les opérations.", "Ein größerer Puffer überholt die ältere Prüfung; später hört der Wächter auf."
    made = [(french, w, t) for w, t in (("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1251", "cp1252"))]
    made += [(german, w, t) for w, t in (("mac_roman", "cp1252"), ("cp850", "cp1252"))]
    clean = [(i, (french, german, *CLEAN)[i % 10] + f" Nr {i}.") for i in range(500)]
    got = found(spark, [*clean, *((1000 + i, x.encode(t).decode(w)) for i, (x, w, t) in enumerate(made))])
    assert {i: r.restored for i, r in got.items()} == {1000 + i: x for i, (x, _, _) in enumerate(made)}
    often = [(i, french.encode("mac_roman").decode("cp1252") if i % 3 == 0 else x) for i, x in clean]
    assert set(found(spark, often)) == set(range(0, 500, 3))


def test_escaped_characters(spark):
    rows = [(i, CLEAN[i % len(CLEAN)] + f" Nr {i}.") for i in range(200)]
    made = {
        900: ("we don&acirc;&euro;&trade;t na&Atilde;&macr;ve &eacute;t&eacute;", "we don’t naïve &eacute;t&eacute;"),
        901: ("a na&#195;&#175;ve page", "a naïve page"),
        902: ('{"a": "na\\u00c3\\u00afve caf\\u00e9"}', '{"a": "naïve caf\\u00e9"}'),
        903: ("caf&eacute; and &amp; &copy; 2024 &mdash; fine", None),
        904: ('re.compile("[\\u0080-\\u009f\\u00c0-\\ufffd]") &nosuch; &#xD800;', None),
    }
    got = found(spark, [*rows, *((i, bad) for i, (bad, _) in made.items())])
    assert {i: r.restored for i, r in got.items()} == {i: right for i, (_, right) in made.items() if right}


def test_a_third_of_the_rows_by_every_pair_of_codecs():
    french, german = "La décision de la régie a précédé les opérations.", "Ein größerer Puffer überholt die ältere Prüfung; später hört der Wächter auf."
    clean = [(i, (french, german, *CLEAN)[i % 10] + f" Nr {i}.") for i in range(300)]
    pairs = [("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), *((w, "utf-8") for w in ("cp1252", "cp437", "mac_roman", "cp850", "gbk"))]
    for text in (french, german):
        for wrong, true in pairs:
            bad = text.encode(true).decode(wrong, "replace")
            texts = [f"{bad} Nr {i}." if i % 3 == 0 else t for i, t in clean]
            counts = garble.Counts()
            counts.add(texts)
            finder = garble.Finder(garble.improbability(list(zip(*counts.rows(), strict=True))))
            assert [i for i, hit in enumerate(finder.find(texts)) if hit] == list(range(0, 300, 3)), (wrong, true)

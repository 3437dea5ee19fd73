import random

from kvlake.llm import copies


def test_fields():
    a = copies.fields_of("name: x\nsize = 2\nmode=q")
    assert sorted(a) == sorted([("name", " x"), ("size", " 2"), ("mode", "q")])
    assert copies.fields_of('{"size": 2, "NAME": "x"}') == [("size", "2"), ("NAME", "x")]
    assert copies.fields_of("one: two") is None and copies.fields_of("2025-01-01 10:00 a: b\n2025-01-02 10:00 c: d\n2025-01-03 10:01 e: f") is None


def test_groups(spark):
    r = random.Random(1)
    base = [f"Record {i} says that page {i * 7} is kept." for i in range(20)]
    forms = [str.upper, lambda t: f"> {t}!", lambda t: t.replace(" ", "  "), lambda t: t.replace(" ", "\n")]
    rows, want = [], {}
    for i, t in enumerate(base):
        for _ in range(r.randint(1, 5)):
            rows.append((len(rows) + 1, r.choice(forms)(t)))
            want.setdefault(("t", i), []).append(len(rows))
    fields = [("name", "Größe"), ("size", "1.5"), ("note", "a, b")]
    for i in range(6):
        r.shuffle(fields)
        text = [", ".join(f'"{a}": "{b}"' for a, b in fields).join("{}"), "; ".join(f"{a} = {b}" for a, b in fields), "\n".join(f"{a.upper()}: {b.upper()}" for a, b in fields)][i % 3]
        rows.append((len(rows) + 1, text))
        want.setdefault("f", []).append(len(rows))
    rows += [(len(rows) + 1 + i, t) for i, t in enumerate([None, "", " - ", "…", "x" * 200_000])]
    r.shuffle(rows)
    df = spark.createDataFrame([(s, t, 5) for s, t in rows], "seq int, text string, first int").repartition(5)
    got = {(x.first_seq, x.seq) for x in copies.copies(df).collect()}
    assert got == {(min(v), s) for v in want.values() for s in v if s != min(v)}
    sizes = {x.seq: x.n_copies for x in copies.collapsed(df).collect()}
    assert {min(v): len(v) for v in want.values()}.items() <= sizes.items() and len(sizes) == len(want) + 1
    assert copies.copies(df.limit(0)).count() == 0

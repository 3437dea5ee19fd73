import random
import re

from kvlake.llm import split

CUTS = [r"\r?\n(?:[ \t]*\r?\n)+", r"\r?\n", "(?<=[.!?])(?=[ \t 　])|(?<=[。！？])", "[ \t 　]"]


def brute_cut(text, limit):
    parts = [text]
    for kind, cut in zip(split.KINDS, CUTS, strict=True):
        parts = [y for x in parts for y in re.split(cut, x)]
        if max(len(x.strip(" \t 　")) for x in parts) <= limit:
            return kind
    return "none"


def test_pieces(spark):
    r = random.Random(4)
    bits = ["word", "x" * 9, " ", " ", "\n", "\r\n\r\n", "\n \t\n", ". ", "。", "! ", "😀", "y" * 70, "\t"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 200))) for _ in range(150)] + [None, "", "z" * 5000, "a b " * 40000]
    rows = [(i, t, f"c{i}", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "seq int, text string, cut string, piece int")
    got = {}
    for p in split.split_oversized(df, ["seq"], limit=100, overlap=20).collect():
        got.setdefault(p.seq, []).append(p)
    assert set(got) == {i for i, t in enumerate(texts) if t and len(t) > 100}
    for i, ps in got.items():
        ps.sort(key=lambda p: p.piece_no)
        assert "".join(p.piece[p.n_overlap :] for p in ps) == texts[i]
        assert all(len(p.piece) <= 100 and p.n_overlap <= 20 for p in ps)
        assert all(b.piece[: b.n_overlap] == a.piece[len(a.piece) - b.n_overlap :] for a, b in zip(ps, ps[1:]))
        assert {p.cut for p in ps} == {brute_cut(texts[i], 100)}
    assert split.split_oversized(df.limit(0), ["seq"]).count() == 0


def test_cuts_lie_at_boundaries(spark):
    text = "One sentence here. Another one there. " * 4 + "\n\n" + "Second paragraph. " * 3
    df = spark.createDataFrame([(1, text)], "seq int, text string")
    ps = sorted(split.split_oversized(df, ["seq"], limit=120, overlap=10).collect(), key=lambda p: p.piece_no)
    assert all(p.piece.endswith((". ", "\n\n")) for p in ps[:-1])


def test_blank_lines_of_any_length_end_paragraphs(spark):
    paragraph = "One line.\n" + "word " * 8 + "end"
    text = f"\n{' ' * 300}\n".join([paragraph] * 30)
    rows = [(1, text), (2, ("x" * 99 + "\n\n") * 9), (3, ("x" * 100 + "\n\n") * 9), (4, ("a " * 50 + "\n") * 9)]
    df = spark.createDataFrame(rows, "seq int, text string")
    got = {}
    for p in split.split_oversized(df, ["seq"], limit=400, overlap=20).collect() + split.split_oversized(df.filter("seq > 1"), ["seq"], limit=100, overlap=10).collect():
        got.setdefault((p.seq, p.cut), []).append(p.piece)
    assert all(p.endswith(" \n") or p.endswith("end") for p in got[1, "paragraph"])
    # a stretch is measured without its blanks and line ends, whatever a piece had to be cut at
    assert {k for k in got} == {(1, "paragraph"), (2, "paragraph"), (3, "paragraph"), (4, "line")}

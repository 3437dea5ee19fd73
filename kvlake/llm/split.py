"""Splitting oversized texts at natural boundaries.

One bounded-quantifier regular expression consumes a text piece by piece: its alternatives stand in the order of the
boundaries' strength (end of text, paragraph, line, sentence, word), each takes as much as the limit allows, and a last
one takes characters where no boundary lies in reach. The matches partition the text; the overlap is the closing
characters of the match before. All of it is SQL array functions inside one stage, without a shuffle or Python.

What a record is cut at (`cut`) is the weakest kind of boundary that a match had to end at. Blanks and line ends around a
stretch count for a match, but not for the kind asked for; so where matches needed a weaker kind than `paragraph`, the
stronger kinds are looked at exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2000
OVERLAP = 200

#: Fixed values of the data's definition: a blank, and what ends a paragraph, line, sentence and word.
BLANKS = " \t\u00a0\u3000"
_B = "[ \t\u00a0\u3000]"
PARAGRAPH = r"\r?\n(?:[ \t]*\r?\n)+"
LINE = r"\r?\n"
SENTENCE = rf"(?<=[.!?])(?={_B})|(?<=[。！？])"
WORD = _B
KINDS = ("paragraph", "line", "sentence", "word")


def piece_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """The expression whose matches are the pieces without overlap. A boundary in reach with the whole overlap comes
    before one that leaves less room for it, and any boundary before a weaker one. A blank line may be of any length that
    fits into a piece."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("need limit >= 1 and 0 <= overlap < limit")
    ends = (rf"(?<=\n)(?<=\n[ \t]{{0,{limit}}}\r?\n)(?![ \t]*\r?\n)", r"(?<=\n)", rf"(?<=[.!?]{_B})|(?<=[。！？])", rf"(?<={_B})(?!{_B})")
    takes = [rf".{{1,{limit}}}\z"]
    for end in ends:
        takes.append(rf".{{1,{limit - overlap}}}(?:{end})")
        if overlap:
            takes.append(rf".{{{limit - overlap + 1},{limit}}}(?:{end})")
    return "(?s)" + "|".join([*takes, rf".{{1,{limit - overlap}}}"])


def longest_stretch(text: Column, boundary: str) -> Column:
    """Code points of the longest stretch between the boundaries, blanks at a stretch's ends not counted."""
    return F.array_max(F.transform(F.split(text, boundary, -1), lambda s: F.length(F.trim(s, F.lit(BLANKS)))))


def end_kind(piece: Column) -> Column:
    """The number (in KINDS) of the kind of boundary that a piece ends at; one more than the last for none."""
    ends = (r"\n[ \t]*\r?\n\z", r"\n\z", rf"[.!?]{_B}\z|[。！？]\z", rf"{_B}\z")
    kind = F.lit(len(KINDS))
    for n in reversed(range(len(KINDS))):
        kind = F.when(piece.rlike(ends[n]), F.lit(n)).otherwise(kind)
    return kind


def cut_kind(text: Column, limit: int = LIMIT, needed: Column | None = None) -> Column:
    """The first kind of boundary that, with those before it, leaves no stretch above the limit; else `none`. `needed` is
    the number of a kind that is known to be enough; only stronger ones are then looked at."""
    upto, levels = "", []
    for boundary in (PARAGRAPH, LINE, SENTENCE, WORD):
        upto = f"{upto}|{boundary}" if upto else boundary
        levels.append(upto)
    kind = F.lit("none")
    for n, boundary in reversed(list(enumerate(levels))):
        enough = longest_stretch(text, boundary) <= limit
        kind = F.when(enough if needed is None else (needed <= n) | enough, F.lit(KINDS[n])).otherwise(kind)
    return kind


def split_oversized(df: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The texts above `limit` code points as pieces: keys, cut, piece_no (from 0), n_overlap (leading code points that
    repeat the piece before), piece.

    Null, empty and short texts give no row; a text of any length is cut whole. Dropping the first n_overlap code points
    of each piece and joining the rest gives the text back. Repeated rows are cut each; other columns are ignored.
    """
    long = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text")).filter(F.length("__text") > limit)
    own = long.select(*keys, "__text", F.regexp_extract_all("__text", F.lit(piece_pattern(limit, overlap)), F.lit(0)).alias("__own"))
    ended = own.withColumn("__needed", F.array_max(F.transform("__own", lambda p, i: F.when(i < F.size("__own") - 1, end_kind(p)).otherwise(F.lit(0)))))
    cut = ended.select(*keys, cut_kind(F.col("__text"), limit, F.col("__needed")).alias("cut"), "__own")
    each = cut.select(*keys, "cut", F.posexplode(F.arrays_zip(F.col("__own"), F.concat(F.array(F.lit("")), F.col("__own")).alias("__before"))).alias("piece_no", "__p"))
    room = F.least(F.lit(overlap), F.lit(limit) - F.length("__p.__own"), F.length("__p.__before"))
    each = each.filter(F.col("__p.__own").isNotNull()).withColumn("n_overlap", F.when(F.col("piece_no") == 0, F.lit(0)).otherwise(room))
    lead = F.expr("right(__p.__before, n_overlap)")
    return each.select(*keys, "cut", "piece_no", "n_overlap", F.concat(lead, F.col("__p.__own")).alias("piece"))

"""Text functions of the transcript operators, as Spark expressions; difflib measures as Arrow functions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word classes that decide results.
STOP_WORDS = tuple("the a an and or but of to in on at for as is are was were be been it that this these those so you your we our i my they them he she his her with by from up out if then than there here what which who".split())
FRENCH_WORDS = tuple(
    "je tu il elle nous vous ils elles est sont suis es et le la les un une des du de mon ma mes ton ta son sa ses ce cette qui que quoi pour avec dans sur pas ne plus tres trs beaucoup aime aimes adore vais vas va allons fait faire avoir etre cest jai jaime sportif sportive quartier argent poche ecole semaine dernier prochain week".split()
)
SLIP_MARKERS = ("sorry", "oops", "i mean", "i meant", "scratch that", "no wait")
RETAKE_MARKERS = ("do that again", "say that again", "start that again", "try that again", "do it again", "go again", "one more time", "take two")

ASCII_TOKEN = "[a-z0-9']+"
ACCENT_TOKEN = "[a-zà-ÿ0-9']+"


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, digits and apostrophes; accents separate."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({ASCII_TOKEN})"), F.lit(1))


def accent_tokens(text: Column) -> Column:
    """Distinct lower-case runs that may hold accented letters, of two characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({ACCENT_TOKEN})"), F.lit(1)), lambda w: F.length(w) > 1))


def first_token(word: Column) -> Column:
    """A word's first token, or the empty string."""
    return F.coalesce(F.get(tokens(word), F.lit(0)), F.lit(""))


def is_stop(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def is_french(word: Column) -> Column:
    return word.isin(*FRENCH_WORDS)


def content(words: Column) -> Column:
    """The words of an array that are neither empty nor stop words."""
    return F.filter(words, lambda w: (w != "") & ~is_stop(w))


def french_share(words: Column) -> Column:
    """Share of French words among those that aren't empty; 0 for none."""
    full = F.filter(words, lambda w: w != "")
    return F.when(F.size(full) == 0, F.lit(0.0)).otherwise(F.size(F.filter(full, is_french)) / F.size(full))


def is_translation(a: Column, b: Column, gap: float = 0.25) -> Column:
    return F.abs(french_share(a) - french_share(b)) >= gap


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, each joined by spaces."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def similar(a: list[str], b: list[str]) -> float:
    """The larger of difflib's ratio and, from 0.7 on, the longest common block's share of the shorter run."""
    if not len(a) or not len(b):
        return 0.0
    short, long = sorted((list(a), list(b)), key=len)
    block = SequenceMatcher(None, short, long).find_longest_match().size / len(short)
    return max(SequenceMatcher(None, list(a), list(b)).ratio(), block if block >= 0.7 else 0.0)


def edits(a: list[str], b: list[str]) -> int:
    """Words that differ by difflib's alignment: the larger side of each stretch that isn't equal."""
    return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in SequenceMatcher(None, list(a), list(b)).get_opcodes() if tag != "equal")


def translated(a: list[str], b: list[str], gap: float = 0.25) -> bool:
    """Whether the shares of French words among those that aren't empty are so far apart."""

    def share(words: list[str]) -> float:
        full = [w for w in words if w]
        return sum(w in FRENCH_WORDS for w in full) / len(full) if full else 0.0

    return abs(share(a) - share(b)) >= gap


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(x, y) for x, y in zip(a, b)])


def _n_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits(x, y) for x, y in zip(a, b)])


def _longest_block(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    found = [SequenceMatcher(None, list(x), list(y)).find_longest_match() for x, y in zip(a, b)]
    return pd.DataFrame({"start": [m.a for m in found], "size": [m.size for m in found]})


# made on call: workers import this module without a session
def similarity(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_similarity, "double")(a, b)


def n_edits(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_n_edits, "long")(a, b)


def longest_block(a: Column | str, b: Column | str) -> Column:
    """Where in a the longest block common with b starts, and its size."""
    return F.pandas_udf(_longest_block, "start int, size int")(a, b)


def title_key(title: Column) -> Column:
    """A title for matching: lower case, three suffixes removed, letters and digits only."""
    t = F.lower(F.coalesce(title, F.lit("")))
    for suffix in ("(taskbar fixed)", "(re-render)", "(edited)"):
        t = F.replace(t, F.lit(suffix), F.lit(""))
    return F.regexp_replace(t, "[^a-z0-9]", "")


def stem(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def bracket_title(folder: Column, name: Column) -> Column:
    """The text between a folder's first and last bracket, else the folder's name, else the file's stem."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(full(F.regexp_extract(F.coalesce(folder, F.lit("")), r"\((.*)\)", 1)), full(folder), stem(name))


def safe_name(name: Column, default: str) -> Column:
    """Letters, digits, space, - and _ only; default if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "")), F.lit("")), F.lit(default))


def clock(seconds: Column) -> Column:
    """m:ss.s"""
    tenths = F.bround(seconds * 10).cast("long")
    return F.format_string("%d:%02d.%d", F.floor(tenths / 600), F.floor(tenths / 10) % 60, tenths % 10)


def overlay_escape(text: Column) -> Column:
    """Text as an overlay option: backslash, colon and percent escaped, quotes curled, one line."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for a, b in ((":", "\\:"), ("'", "’"), ("%", "\\%"), ("\n", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def position_xy(pos: Column, margin: int = 60) -> Column:
    """x and y expressions of a two-letter preset: t, m or b, then l, c or r; the centre otherwise."""
    ok = F.length(pos) == 2
    row, col = F.when(ok, F.substring(pos, 1, 1)).otherwise("m"), F.when(ok, F.substring(pos, 2, 1)).otherwise("c")
    x = F.when(col == "l", str(margin)).when(col == "r", f"W-w-{margin}").otherwise("(W-w)/2")
    y = F.when(row == "t", str(margin)).when(row == "b", f"H-h-{margin}").otherwise("(H-h)/2")
    return F.struct(x.alias("x"), y.alias("y"))


def link_id(url: Column) -> Column:
    """The id in a sharing link: a /d/ or /folders/ segment, else an id parameter."""
    some = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return F.coalesce(some("/(?:d|folders)/([A-Za-z0-9_-]+)"), some("[?&]id=([A-Za-z0-9_-]+)"))


def action(label: Column) -> Column:
    """mute or cut, by a disfluency's label."""
    u = F.upper(label)
    return F.when(u.startswith("MUTE_") | u.contains("BREATH"), "mute").otherwise("cut")


def base_type(label: Column) -> Column:
    return F.regexp_replace(F.upper(label), "^(MUTE_|CUT_)", "")

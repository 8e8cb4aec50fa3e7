"""License scans with a positional index of rare words.

Base labels come from four phrases whose words stand consecutively. Further labels come from
templates of license notices, standard headers and passages of full texts, several for a license, and
from the expressions in SPDX-License-Identifier lines, whose known identifiers are labels in lower case. Templates are rows of label, mandatory key
phrase and text, in TEMPLATES or given by the caller.

One pass over the texts finds the base columns and each file's license words (words of any template) with their positions,
written as a table in the shared folder. IDF is counted over all its rows, for the few hundred words of the templates. The
index holds the postings (template, position) of each template's words of highest IDF, INDEX at most. A file looks
up its own license words there, highest IDF first, RARE of them for a template; each occurrence votes for the offset of
file position less template position. The postings are intersected by relative position: votes whose offsets lie within
SPAN agree, and the largest share of the template's RARE highest weights that agrees is its score. Templates that reach
SHARE count if the file holds their key phrase word for word. Only DataFrame functions are used, and nothing is shuffled
but the sums of the counts.

Words are runs of digits, a-z (A-Z are lower-cased first) and characters beyond ASCII.

Defined results: a null or empty text has no words, no places and score 0; null or repeated document
numbers and equal rows are judged row by row; an SPDX expression ends at the first word that its grammar doesn't await,
unknown identifiers and exceptions after `WITH` are no labels; of equally rare words the first of the template is rarer; an empty table
gives no rows; columns other than the text and those in `carry` are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table, text_or_empty

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices: label, mandatory key phrase, text.
TEMPLATES = (
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("mit", "mit license", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "cc by 4 0", "this work is licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "this work is licensed under cc by sa 4 0"),
    ("isc", "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", "gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", "gnu general public license version 2 june 1991", "gnu general public license version 2 june 1991"),
    ("lgpl-3.0", "gnu lesser general public license as published by the free software foundation either version 3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0", "lesser general public license version 3", "gnu lesser general public license version 3"),
    ("lgpl-2.1", "lesser general public license version 2 1", "gnu lesser general public license version 2 1"),
    ("agpl-3.0", "gnu affero general public license as published by the free software foundation either version 3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0", "affero general public license version 3", "gnu affero general public license version 3"),
    ("apache-2.0", "apache license version 2 0 january 2004", "apache license version 2 0 january 2004"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("cc-by-4.0", "creative commons attribution 4 0", "creative commons attribution 4 0"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "cc by nc 4 0"),
    ("cc0-1.0", "cc0 1 0 universal", "cc0 1 0 universal"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose"),
)

#: An SPDX tag and the expression after it: identifiers in parentheses or without, joined by operators in one case, on one line. It
#: ends before the first word that isn't due.
SPDX, SPDX_ID, SPDX_OF = "spdx-license-identifier", r"[A-Za-z0-9_.+:\-]+", r"(?:\([ \t]*)*[A-Za-z0-9_.+:\-]+(?:[ \t]*\))*"
SPDX_LINE = rf"(?i:{SPDX}):[ \t]*({SPDX_OF}(?:[ \t]+(?:AND|OR|WITH|and|or|with)[ \t]+{SPDX_OF})*)"
#: An exception, which is no license, and what ends a sentence behind an identifier.
SPDX_WITH, SPDX_END = r"[ \t]with[ \t]+[a-z0-9_.+:\-]+", r"[.:\-]+$"
#: Identifiers that become labels, in lower case, besides those that begin with licenseref-; a `+` may follow. Fixed values.
SPDX_KNOWN = (
    "0bsd", "afl-3.0", "agpl-1.0-only", "agpl-1.0-or-later", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "apache-1.0", "apache-1.1", "apache-2.0", "artistic-1.0", "artistic-2.0",
    "blueoak-1.0.0", "bsd-1-clause", "bsd-2-clause", "bsd-2-clause-patent", "bsd-3-clause", "bsd-3-clause-clear", "bsd-3-clause-lbnl", "bsd-4-clause", "bsl-1.0", "bzip2-1.0.6",
    "cc-by-1.0", "cc-by-2.0", "cc-by-2.5", "cc-by-3.0", "cc-by-4.0", "cc-by-nc-3.0", "cc-by-nc-4.0", "cc-by-nc-nd-4.0", "cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0", "cc-by-nd-4.0", "cc-by-sa-2.0", "cc-by-sa-2.5", "cc-by-sa-3.0", "cc-by-sa-4.0", "cc0-1.0",
    "cddl-1.0", "cddl-1.1", "cecill-2.1", "cecill-b", "cecill-c", "cpl-1.0", "curl", "ecl-2.0", "epl-1.0", "epl-2.0", "eupl-1.1", "eupl-1.2",
    "ftl", "gfdl-1.2-only", "gfdl-1.2-or-later", "gfdl-1.3-only", "gfdl-1.3-or-later", "gpl-1.0-only", "gpl-1.0-or-later", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later",
    "hpnd", "icu", "ijg", "ipl-1.0", "isc", "lgpl-2.0-only", "lgpl-2.0-or-later", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later", "libpng", "libpng-2.0", "lppl-1.3c",
    "mit", "mit-0", "mpl-1.1", "mpl-2.0", "mpl-2.0-no-copyleft-exception", "ms-pl", "ms-rl", "mulanpsl-2.0", "ncsa", "odbl-1.0", "odc-by-1.0", "ofl-1.0", "ofl-1.1", "openssl", "osl-3.0",
    "php-3.01", "postgresql", "psf-2.0", "python-2.0", "qpl-1.0", "ruby", "sleepycat", "sspl-1.0", "tcl", "unicode-3.0", "unicode-dfs-2016", "unlicense", "upl-1.0", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl-2.1",
)

#: Postings of a template in the index, those of them that a file looks up, and the share of their weight that must agree.
INDEX, RARE, SHARE = 8, 6, 0.8
#: Postings that weigh less than this share of their template's heaviest aren't indexed.
LIGHT = 0.1
#: The widest span of offsets that agree, where words were put in or left out.
SPAN = 6

Templates = Sequence[tuple[str, str, str]]


def normal(text: Column) -> Column:
    """Words with one space between."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " "))


def _phrase(p: str) -> str:
    return " " + p.replace(" ", "  ") + " "


def _words(n: Column) -> Column:
    return (F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit("")))) / F.lit(2)


def idf(words: DataFrame) -> dict[str, float]:
    """IDF over all rows of column lw (array of struct w, p) of the words there; the rows themselves are counted as ""."""
    each = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.transform("lw", lambda x: x["w"])))).alias("w"))
    count = {r.w: r["count"] for r in each.groupBy("w").count().collect()}  # as many as the templates have words
    return {w: math.log((1 + count[""]) / (1 + c)) for w, c in count.items() if w}


def rare_index(templates: Templates, weights: dict[str, float]) -> tuple[dict[str, list[tuple[int, int, int, float]]], list[float]]:
    """Postings by word: template, rank, position, weight; and the weight of each template's RARE highest postings. Words
    that no file holds need no posting, but they weigh as much as the rarest."""
    most = max(weights.values(), default=1.0)
    postings: dict[str, list[tuple[int, int, int, float]]] = {}
    totals = []
    for t, (_, _, text) in enumerate(templates):
        places = sorted(((max(weights.get(w, most), 1e-6), i, w) for i, w in enumerate(text.split())), key=lambda x: (-x[0], x[1]))[:INDEX]
        places = [x for x in places if x[0] >= LIGHT * places[0][0]]
        totals.append(sum(v for v, _, _ in places[:RARE]))
        for rank, (v, i, w) in enumerate(places):
            postings.setdefault(w, []).append((t, rank, i, v))
    return postings, totals


def _scores(lw: Column, postings: dict[str, list[tuple[int, int, int, float]]], totals: list[float]) -> Column:
    """struct t, s: each template that shares indexed words with the file, and the largest share of weight that agrees."""
    posting = lambda x: F.struct(F.lit(x[0]).alias("t"), F.lit(x[1]).alias("r"), F.lit(x[2]).alias("i"), F.lit(x[3]).alias("v"))
    table_ = F.create_map(*[c for w, ps in postings.items() for c in (F.lit(w), F.array(*map(posting, ps)))])
    once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731 a name for a value, so that it is evaluated once
    found = F.flatten(F.transform(F.filter(lw, lambda x: x["w"].isin(*postings)), lambda x: F.transform(F.element_at(table_, x["w"]), lambda y: F.struct(y["t"].alias("t"), y["r"].alias("r"), (x["p"] - y["i"]).alias("o"), y["v"].alias("v")))))
    weight = lambda rows: F.aggregate(F.array_distinct(F.transform(rows, lambda x: F.struct(x["r"].alias("r"), x["v"].alias("v")))), F.lit(0.0), lambda a, x: a + x["v"])

    def best(t: Column, votes: Column) -> Column:
        own = F.filter(votes, lambda x: x["t"] == t)
        ranks = F.slice(F.array_sort(F.array_distinct(F.transform(own, lambda x: x["r"]))), 1, RARE)

        def agreed(own: Column, ranks: Column) -> Column:
            few = F.array_sort(F.transform(F.filter(own, lambda x: F.array_contains(ranks, x["r"])), lambda x: F.struct(x["o"].alias("o"), x["r"].alias("r"), x["v"].alias("v"))))
            # within a span an offset has a vote for each rank at most
            near = lambda s: F.transform(s, lambda x, i: weight(F.filter(F.slice(s, i + 1, RARE * (SPAN + 1)), lambda y: y["o"] - x["o"] <= SPAN)))
            return F.array_max(once(few, near))

        return once(own, lambda own_: once(ranks, lambda ranks_: agreed(own_, ranks_)))

    def each(votes: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(votes, lambda x: x["t"])), lambda t: F.struct(t.alias("t"), F.least(F.lit(1.0), best(t, votes) / F.get(F.array(*map(F.lit, totals)), t)).alias("s")))

    return F.when(F.exists(lw, lambda x: x["w"].isin(*postings)), once(found, each)).otherwise(F.array().cast("array<struct<t:int,s:double>>"))


def scan(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), weights: dict[str, float] | None = None, templates: Templates = TEMPLATES) -> DataFrame:
    """carry, n_words, n_base, first_word, last_word (long), base_labels, labels, score."""
    words = sorted({w for _, key, t in templates for w in f"{key} {t}".split()})
    raw = text_or_empty(text)
    tagged = F.when(F.contains(F.lower(raw), F.lit(SPDX)), F.regexp_extract_all(raw, F.lit(SPDX_LINE), F.lit(1))).otherwise(F.array().cast("array<string>"))
    ids = F.flatten(F.transform(tagged, lambda x: F.regexp_extract_all(F.regexp_replace(F.lower(x), SPDX_WITH, ""), F.lit(SPDX_ID), F.lit(0))))
    ids = F.transform(ids, lambda x: F.regexp_replace(x, SPDX_END, ""))
    known_id = lambda x: F.regexp_replace(x, r"\+$", "").isin(*SPDX_KNOWN) | x.startswith("licenseref-")
    read = docs.select(*carry, normal(raw).alias("_bare"), F.when(F.size(ids) > 0, F.filter(ids, known_id)).otherwise(F.array().cast("array<string>")).alias("_spdx"))
    # for phrases each word stands between two spaces of its own, so that phrases beside each other share none
    spaced = F.when(F.col("_bare") == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace("_bare", F.lit(" "), F.lit("  ")), F.lit(" ")))
    read = read.select(*carry, "_spdx", F.split("_bare", " ").alias("_w"), spaced.alias("n"))
    n = F.col("n")
    found, firsts, lasts, base = [], [], [], []
    for p, label in PHRASES.items():
        cut, width, here = F.split(n, _phrase(p)), len(p.split()), F.contains(n, F.lit(_phrase(p)))
        found.append(F.when(here, F.size(cut) - 1).otherwise(0))
        firsts.append(F.when(here, _words(F.get(cut, F.lit(0)))))
        lasts.append(F.when(here, _words(n) - _words(F.element_at(cut, -1)) - width))
        base.append(F.when(here, F.lit(label)))
    own = F.filter(F.transform("_w", lambda x, i: F.when(x.isin(*words), F.struct(x.alias("w"), i.alias("p")))), lambda x: x.isNotNull())
    read = read.select(
        *carry, F.when(n == "", 0).otherwise(F.size("_w")).cast("long").alias("n_words"), sum(found[1:], found[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.filter(F.array(*base), lambda x: x.isNotNull()).alias("_b"), "_spdx", own.alias("lw"),
    )
    read = stored(read, "license-words")
    postings, totals = rare_index(templates, weights or idf(read))
    out = read.withColumn("_s", F.filter(_scores(F.col("lw"), postings, totals), lambda x: x["s"] > 0))
    # the license words with a mark where others stand between
    lines = F.concat(F.array_join(F.transform("lw", lambda x, i: F.when((i > 0) & (x["p"] == F.get(F.col("lw"), i - 1)["p"] + 1), F.concat(F.lit(" "), x["w"])).otherwise(F.concat(F.lit(" | "), x["w"]))), ""), F.lit(" "))
    out = out.withColumn("_lines", F.when(F.size("_s") > 0, lines).otherwise(F.lit("")))
    keys = F.array(*[F.lit(f" {key} ") for _, key, _ in templates])
    out = out.withColumn("_s", F.filter("_s", lambda x: F.contains(F.col("_lines"), F.get(keys, x["t"]))))
    named = F.array(*[F.lit(label) for label, _, _ in templates])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    more = F.transform(F.filter("_s", lambda x: x["s"] >= SHARE), lambda x: F.get(named, x["t"]))
    return out.select(
        *carry, "n_words", "n_base", "first_word", "last_word",
        labels(F.col("_b")).alias("base_labels"), labels(F.concat("_b", "_spdx", more)).alias("labels"), F.coalesce(F.array_max(F.transform("_s", lambda x: x["s"])), F.lit(0.0)).alias("score"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sums of weights differ in their last digits by the order of adding
    return scan(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 9))


_text = lambda x: "'" + x.replace("'", "''") + "'"
OP9_SQL = rf"""
WITH ph(words, label) AS (VALUES {", ".join(f"(string_split({_text(p)}, ' '), {_text(label)})" for p, label in PHRASES.items())}),
tm(t, label, key, words) AS (VALUES {", ".join(f"({i}, {_text(label)}, {_text(key)}, string_split({_text(t)}, ' '))" for i, (label, key, t) in enumerate(TEMPLATES))}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS p FROM d),
b AS (SELECT x.r, x.p, ph.label FROM x JOIN ph ON x.w = ph.words[1] JOIN d ON d.r = x.r WHERE list_slice(d.w, x.p + 1, x.p + len(ph.words)) = ph.words),
ba AS (SELECT r, count(*) AS n, min(p) AS a, max(p) AS z, list(DISTINCT label) AS ls FROM b GROUP BY r),
vo AS (SELECT DISTINCT unnest(list_concat(words, string_split(key, ' '))) AS w FROM tm),
c AS (SELECT x.w, ln((1 + (SELECT count(*) FROM d)) / (1 + count(DISTINCT r))) AS v FROM x JOIN vo ON vo.w = x.w GROUP BY x.w),
tp AS (SELECT t, i, w, greatest(coalesce(c.v, (SELECT coalesce(max(v), 1.0) FROM c)), 0.000001) AS v FROM (SELECT t, unnest(words) AS w, unnest(range(len(words))) AS i FROM tm) LEFT JOIN c USING (w)),
rk AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v DESC, i) - 1 AS k, max(v) OVER (PARTITION BY t) AS top FROM tp),
ix AS (SELECT * FROM rk WHERE k < {INDEX} AND v >= {LIGHT} * top),
tt AS (SELECT t, sum(v) AS total FROM ix WHERE k < {RARE} GROUP BY t),
v0 AS (SELECT x.r, ix.t, ix.k, x.p - ix.i AS o, ix.v, dense_rank() OVER (PARTITION BY x.r, ix.t ORDER BY ix.k) AS n FROM x JOIN ix ON ix.w = x.w),
v AS (SELECT DISTINCT r, t, k, o, v FROM v0 WHERE n <= {RARE}),
sp AS (SELECT r, t, o, sum(v) AS s FROM (SELECT DISTINCT a.r, a.t, a.o, y.k, y.v FROM v a JOIN v y ON a.r = y.r AND a.t = y.t AND y.o BETWEEN a.o AND a.o + {SPAN}) GROUP BY r, t, o),
sc AS (SELECT sp.r, sp.t, least(1.0, max(s / total)) AS s FROM sp JOIN tt ON tt.t = sp.t GROUP BY sp.r, sp.t),
ok AS (SELECT sc.r, sc.s, tm.label FROM sc JOIN tm ON tm.t = sc.t JOIN d ON d.r = sc.r WHERE contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || tm.key || ' ')),
ow AS (SELECT r, max(s) AS s, list(DISTINCT label) FILTER (s >= {SHARE}) AS ls FROM ok GROUP BY r),
si AS (SELECT r, list_transform(flatten(list_transform(regexp_extract_all(x, '{SPDX_LINE}', 1), lambda y: regexp_extract_all(regexp_replace(lower(y), '{SPDX_WITH}', '', 'g'), '{SPDX_ID}'))), lambda y: regexp_replace(y, '{SPDX_END}', '')) AS ls FROM d),
sx AS (SELECT r, list_filter(ls, lambda y: list_contains([{", ".join(map(_text, SPDX_KNOWN))}], regexp_replace(y, '\+$', '')) OR starts_with(y, 'licenseref-')) AS ls FROM si)
SELECT doc_id, len(d.w)::BIGINT AS n_words, coalesce(ba.n, 0) AS n_base, ba.a AS first_word, ba.z AS last_word,
 coalesce(array_to_string(list_sort(ba.ls), ','), '') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(list_concat(coalesce(ba.ls, []), coalesce(ow.ls, [])), coalesce(sx.ls, [])))), ',') AS labels, coalesce(round(ow.s, 9), 0.0)::DOUBLE AS score
FROM d LEFT JOIN ba USING (r) LEFT JOIN ow USING (r) LEFT JOIN sx USING (r)
"""


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def plain_scan(text: str | None) -> tuple:
    """The base columns of one text, by plain Python; for tests."""
    ws = plain_words(text)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    return len(ws), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def plain_spdx(text: str | None) -> set[str]:
    """Labels of a text's SPDX lines, word by word; for tests."""
    out: set[str] = set()
    for line in re.split(r"(?i)spdx-license-identifier:", text or "")[1:]:
        words = re.findall(r"[()]|[A-Za-z0-9_.+:\-]+|[^\x00-\x20()A-Za-z0-9_.+:\-]+", line.split("\n")[0].split("\r")[0])
        due, exception = True, False
        for w in words:
            if w in ("(", ")"):
                continue
            if due:
                if not re.fullmatch(r"[A-Za-z0-9_.+:\-]+", w):
                    break
                name = w.lower().rstrip(".:-")
                if not exception and (name.removesuffix("+") in SPDX_KNOWN or name.startswith("licenseref-")):
                    out.add(name)
                due = False
            elif w in ("AND", "OR", "and", "or", "WITH", "with"):
                due, exception = True, w in ("WITH", "with")
            else:
                break
    return out


def plain_labels(texts: list[str | None], templates: Templates = TEMPLATES, weights: dict[str, float] | None = None) -> list[tuple[str, float]]:
    """labels and score of each text, by plain Python; for tests."""
    ws = [plain_words(t) for t in texts]
    known = {w for _, key, t in templates for w in f"{key} {t}".split()}
    held = {w: sum(w in x for x in ws) for w in known}
    weights = weights or {w: math.log((1 + len(texts)) / (1 + c)) for w, c in held.items() if c}
    postings, totals = rare_index(templates, weights)
    out = []
    for text, own in zip(texts, ws):
        names, top = set(plain_scan(text)[4].split(",")), 0.0
        names |= plain_spdx(text)
        for t, (label, key, _) in enumerate(templates):
            votes = [(p - i, rank, v) for p, w in enumerate(own) for u, rank, i, v in postings.get(w, []) if u == t]
            ranks = sorted({r for _, r, _ in votes})[:RARE]
            spans = [sum(dict((r, v) for p, r, v in votes if r in ranks and 0 <= p - o <= SPAN).values()) for o, r, _ in votes if r in ranks]
            if spans and f" {key} " in f" {' '.join(own)} ":
                score = min(1.0, max(spans) / totals[t])
                top = max(top, score)
                names |= {label} if score >= SHARE else set()
        out.append((",".join(sorted(names - {""})), top))
    return out

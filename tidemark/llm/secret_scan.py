"""Secret scans with a random forest that removes false positives.

Patterns propose candidates of any length, generously:

* values assigned to a name (`:`, `=`, `=>`): a quoted value runs to its closing quote, spaces, escaped quotes and markup
  included; one without runs to white space, a quote, markup or the next assignment. A quote that isn't closed on its line
  counts as none;
* what follows a name as a word (`password hunter2`, `my key is ...`), if it doesn't look like a plain word, and what follows
  `Bearer`, `Basic` and the like;
* the password in a URL's user-info;
* long runs of key characters, with digits or without: those of letters alone if their entropy is that of drawn letters;
* private key blocks, which count by their markers alone.

Candidates that overlap are one. Where such a union isn't a secret, its parts that are count. A random
forest scores each from its length, its character transitions, how much of it dictionary words
cover, the path it was found in and the words beside it. The forest is trained by Spark from labelled findings and applied
inside the scan, so texts are read once and never shuffled. Values of any length are scored, digested and redacted whole.

Neighbouring words and parts of the path count by their log odds among the labelled findings (of the other half, while the
forest is trained, so that it doesn't learn its own labels). Transitions count by their probability in dictionary words.

Labelled findings are a table path, before, value, after, label. Where none is given, SAMPLE findings are drawn from the
generator below with a fixed seed, from named shapes of credentials and of what looks like them. Tests leave shapes out of
training, plant them in texts, and measure recall and precision of the whole scan on those alone.

Defined results: null or empty texts have no findings and stay as they are; null or repeated
document numbers and equal rows are scanned row by row; an empty quoted value is no candidate; an empty table gives no rows;
columns other than those named and those in `carry` are left out of findings, and redaction keeps all columns.
"""

from __future__ import annotations

import json
import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import default_path
from tidemark.llm.common import table

#: Labelled findings drawn for training, trees, their depth, and the score from which a finding counts.
SAMPLE, TREES, DEPTH, SCORE = 4000, 40, 9, 0.45
SEED = 7

ASSIGN = re.compile(r"=>|[:=]")
OPEN = re.compile(r"[ \t]*(\\?[\"'`])?")
#: A quoted value, by its quote; escaped quotes are part of it.
QUOTED = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*(?={q})") for q in "\"'`"}
VALUE = re.compile(r"(?:[^\s\"'`<>]|<(?![A-Za-z/!]))*")
NEXT = re.compile(r"[&;,][\w.\-]+[:=](?=[^=])")  # the next assignment beside a value that isn't quoted
NAMES = r"(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth(?:orization)?|bearer|credentials?|creds?|key|pin|passkey)"
NAME = re.compile(rf"(?i){NAMES}(?:\\?[\"'`])?[\])]?[ \t]*$")
#: A name and what follows it as a word; an authorization scheme and its value; the password of a URL.
SAID = re.compile(rf"(?i)(?<![A-Za-z]){NAMES}[ \t]+(?:(?:is|was|are|to|of|=>?|:)[ \t]+)?[\"'`(]?([^\s\"'`<>]{{5,}})")
SCHEME = re.compile(r"(?i)\b(?:bearer|basic|digest|token|apikey)[ \t]+([A-Za-z0-9._~+/=\-]{6,})")
USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@\"'`<>]*:([^\s/\"'`<>]+)@(?=[\w\[])")
BARE = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
PIECE = re.compile(r"[^=]+=*")
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)
LETTERS = re.compile(r"[a-z]+")
#: Words that stand for a value that isn't there.
STAND_IN = re.compile(r"(?i)example|sample|dummy|fake|change[_\-]?me|your|insert|replace|placeholder|redacted|xxxx|\*\*\*|todo|none|null|undefined|<|\$\{|\{\{|%\(|\bgetenv|\benv\b|process\.")

KINDS = ("private_key", "url", "assigned", "bare")

FEATURES = ("length", "lower", "upper", "digit", "other", "class_changes", "letter_run", "entropy", "distinct", "hex", "transitions", "covered", "named", "quoted", "neighbours", "path", "stand_in", "repeats", "dotted", "vowels")


class Lexicon:
    """Dictionary words, and the log probability of each pair of letters in them."""

    def __init__(self, words: frozenset[str]):
        self.words = words
        pairs = Counter(a + b for w in words for a, b in zip(w.lower(), w[1:].lower()))
        first = Counter()
        for pair, n in pairs.items():
            first[pair[0]] += n
        self.steps = {p: math.log(n / first[p[0]]) for p, n in pairs.items()}
        self.rare = math.log(1e-4)

    def transitions(self, value: str) -> float:
        """Mean log probability of the pairs of letters in a value; 0 where it has none."""
        steps = [self.steps.get(a + b, self.rare) for run in LETTERS.findall(value.lower()) for a, b in zip(run, run[1:])]
        return sum(steps) / len(steps) if steps else 0.0


_lexicons: dict[str, Lexicon] = {}


def lexicon(path: str) -> Lexicon:
    """Whole words of at least four letters in a tokenizer's vocabulary, once for each worker process."""
    if path not in _lexicons:
        _lexicons[path] = Lexicon(words_of(path))
    return _lexicons[path]


def words_of(path: str) -> frozenset[str]:
    vocab = json.loads(open(path, encoding="utf-8").read())["model"]["vocab"]
    return frozenset(w for t in vocab if t.endswith("</w>") and len(w := t[:-4]) >= 4 and w.isascii() and w.isalpha())


def covered(value: str, words: frozenset[str]) -> float:
    """Share of a value's characters in dictionary words, taken greedily, longest first."""
    low, i, n = value.lower(), 0, 0
    while i < len(low):
        for k in range(min(14, len(low) - i), 3, -1):
            if low[i : i + k] in words:
                n, i = n + k, i + k
                break
        else:
            i += 1
    return n / max(1, len(value))


def neighbours(before: str) -> list[str]:
    """The last three words before a value, in lower case; parts of a name are words."""
    return re.findall(r"[a-z0-9]+", before.lower())[-3:]


def parts_of(path: str | None) -> list[str]:
    return re.findall(r"[a-z]+", (path or "").lower())


#: What stands between a name and its value.
LEAD = re.compile(r"(?i)[ \t]*(?:(?:=>|[:=]|\bis\b|\bwas\b|\bto\b|\bof\b)[ \t]*)?\\?[\"'`(]?$")

Odds = tuple[dict[str, float], dict[str, float]]


def log_odds(found: Sequence[tuple], part) -> dict[str, float]:
    """Smoothed log odds of each word of labelled findings; part gives a finding's words."""
    held = (Counter(), Counter())
    for row in found:
        held[row[4]].update(set(part(row)))
    n = [1 + sum(1 for r in found if r[4] == y) for y in (0, 1)]
    return {w: math.log((held[1][w] + 0.5) / n[1]) - math.log((held[0][w] + 0.5) / n[0]) for w in held[0] | held[1] if held[0][w] + held[1][w] >= 3}


def learned(found: Sequence[tuple]) -> Odds:
    return log_odds(found, lambda r: neighbours(r[1])), log_odds(found, lambda r: parts_of(r[0]))


def features(path: str | None, before: str, value: str, after: str, known: Lexicon, odds: Odds) -> list[float]:
    n = len(value)
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in value]
    count, chars = Counter(kinds), Counter(value)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    runs = max((len(m) for m in re.findall(r"[A-Za-z]+", value)), default=0)
    quote = before[-1:] in ("\"", "'", "`")
    return [
        n, count["l"] / n, count["u"] / n, count["d"] / n, count["o"] / n, changes / n, runs / n, entropy(value), len(chars) / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), known.transitions(value), covered(value, known.words),
        float(bool(NAME.search(LEAD.sub("", before)))), float(quote),
        sum(odds[0].get(w, 0.0) for w in neighbours(before)), sum(odds[1].get(w, 0.0) for w in parts_of(path)),
        float(bool(STAND_IN.search(value))), sum(a == b for a, b in zip(value, value[1:])) / n,
        sum(c in "./ ()[]" for c in value) / n, sum(count_ for c, count_ in chars.items() if c in "aeiouAEIOU") / max(1, count["l"] + count["u"]),
    ]


def entropy(value: str) -> float:
    """Bits for each character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def odd_word(value: str) -> bool:
    """Whether a word that follows a name doesn't look like a plain one: digits, signs or capitals inside, or drawn letters."""
    inner = value.strip(".,;:!?()[]{}")
    if len(inner) < 5:
        return False
    return any(c.isdigit() for c in inner) or any(c.isupper() for c in inner[1:]) and not inner.isupper() or any(not c.isalnum() and c not in "-'’" for c in inner) or drawn_letters(inner)


def drawn_letters(value: str, least: int = 16) -> bool:
    """Letters alone, whose entropy is near that of letters drawn by chance."""
    return len(value) >= least and value.isascii() and value.isalpha() and entropy(value) >= 0.8 * min(math.log2(len(value)), math.log2(26))


def _trimmed(text: str, a: int, b: int) -> int:
    """The end of a value without the punctuation of its sentence."""
    while b > a and text[b - 1] in "&.,;)!?":
        b -= 1
    return b


def proposed(text: str) -> list[tuple[int, int, str]]:
    """Spans that the patterns propose: start, end, kind; they may overlap."""
    out: list[tuple[int, int, str]] = []
    if "-----BEGIN" in text:
        out += [(*m.span(), "private_key") for m in BLOCK.finditer(text)]
    if "://" in text:
        out += [(*m.span(1), "url") for m in USERINFO.finditer(text)]
    named: list[tuple[int, int]] = []  # name's start, value's start
    end = cut = -1
    for m in ASSIGN.finditer(text):
        name = NAME.search(text, max(0, m.start() - 40), m.start())
        if not name:
            continue
        opened = OPEN.match(text, m.end())
        a = opened.end()
        quote = text[a - 1] if opened[1] else ""
        whole = QUOTED[quote].match(text, a) if quote else None
        if whole and opened[1] == quote:
            b = whole.end()
            if b - a >= 4:
                out.append((a, b, "assigned"))
                named.append((name.start(), a))
            continue
        if a >= end:  # else it's in the value before, and ends with it
            end, cut = VALUE.match(text, a).end(), -1
        if cut < a:
            found = NEXT.search(text, a, end)
            cut = found.start() if found else end
        b = cut
        if quote and b > a and text[b - 1] == "\\":  # an escaped quote closes it
            b -= 1
        if not quote or text[b : b + 1] not in (quote, "\\"):
            b = _trimmed(text, a, b)
        if b - a >= 4:
            out.append((a, b, "assigned"))
            named.append((name.start(), a))
    for m in SAID.finditer(text):
        a, b = m.span(1)
        b = _trimmed(text, a, b)
        if odd_word(text[a:b]):
            out.append((a, b, "assigned"))
    for m in SCHEME.finditer(text):
        a, b = m.span(1)
        b = _trimmed(text, a, b)
        if odd_word(text[a:b]):
            out.append((a, b, "assigned"))
    for m in BARE.finditer(text):
        begin, end_ = m.span()
        i = bisect_left(named, begin, key=lambda x: x[1])
        pieces = []
        while i < len(named) and named[i][1] < end_:  # the name beside a value is no part of it
            pieces.append((begin, named[i][0]))
            begin = max(begin, named[i][1])
            i += 1
        for a, b in (*pieces, (begin, end_)):
            for x in PIECE.finditer(text, a, b):  # what stands before a sign of equality is a name, whatever it is
                v = x[0]
                if len(v) >= 16 and (any(c.isdigit() for c in v) and any(c.isalpha() for c in v) or drawn_letters(v, 20)):
                    out.append((*x.span(), "bare"))
    return out


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The unions of overlapping spans, in order; the kind is the first of KINDS."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans):
        if out and a < out[-1][1]:
            c, d, other = out[-1]
            out[-1] = c, max(b, d), min(kind, other, key=KINDS.index)
        else:
            out.append((a, b, kind))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans to be scored: start, end, kind, in order and without overlaps."""
    return merged(proposed(text))


# ---- labelled findings and training --------------------------------------------------------------


def shapes(r: random.Random) -> tuple[dict[str, Callable[[], tuple[str, str]]], dict[str, Callable[[], tuple[str, str]]]]:
    """Makers of (before, value) by name: credentials, and what looks like them."""
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, upper, mixed = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    syllables = "the and ing tion er on re at en nd st es or ti hi as te et ng of al de se le sa si ar ve ra ld ur".split()
    foreign = "sch ung keit lich ver bee pf tz ein auf cion mente ado rra ll os jo eau ment que aux oi elle ch ska owi zny tto gli ssa ij oe".split()
    word = lambda k: "".join(r.choice(syllables) for _ in range(k))
    name = lambda: r.choice(("token", "api_key", "secret", "auth_token", "access_key", "client_secret", "password", "passwd", "pwd", "credentials"))
    sign = lambda: r.choice(("=", ": ", " = ", '="', ' = "', "='"))
    label = lambda *names: r.choice(names) + r.choice((" ", ": ", "=", " = "))
    ask = lambda: r.choice(("password", "passwd", "pwd", "pass", "passphrase", "secret", "pw"))
    said = lambda: r.choice((f"{name()} ", f"my {ask()} is ", f"the {name()} is ", f"use {ask()} ", f"{ask()} was ", "my key "))
    capital = lambda k: word(k).capitalize()
    true = {
        "access id": lambda: (r.choice((f"{word(2)} ", f"{name()}{sign()}")), r.choice(("AKIA", "ASIA")) + pick(upper, 16)),
        "hex key": lambda: (f"{name()}{sign()}", pick(hexes, r.choice((24, 32, 40, 64)))),
        "password": lambda: (f"{ask()}{sign()}", pick(r.choice((mixed, mixed + "!#$%*")), r.randint(8, 24))),
        "host token": lambda: (r.choice(("", f"{word(2)} ", f"{name()}{sign()}")), r.choice(("ghp_", "gho_", "glpat-")) + pick(mixed, r.randint(20, 36))),
        "service key": lambda: (r.choice(("key: ", f"{name()}{sign()}", f"{word(2)} ")), "sk-" + pick(mixed, r.randint(20, 64))),
        "random base64": lambda: (f"{name()}{sign()}", pick(mixed + "+/", r.choice((40, 64, 88)))),
        "web token": lambda: (r.choice(("Bearer ", "token: ", "auth=")), ".".join(("eyJ" + pick(mixed, r.randint(20, 60)), "eyJ" + pick(mixed + "_-", r.randint(40, 160)), pick(mixed + "_-", 43)))),
        "chat token": lambda: (r.choice((f"{word(3)} ", f"{name()}{sign()}")), f"xox{r.choice('abp')}-{pick(string.digits, 11)}-{pick(mixed, 24)}"),
        "word and number": lambda: (r.choice((f"{ask()}{sign()}", said())), r.choice((word(3), capital(3))) + str(r.randint(1, 9999)) + r.choice(("", "!", "#", "$"))),
        "letters swapped": lambda: (r.choice((f"{ask()}{sign()}", said())), "".join({"a": "@", "e": "3", "i": "1", "o": "0", "s": "$"}.get(c, c) if r.random() < 0.7 else c for c in capital(r.randint(3, 4))) + r.choice(("", "1", "!"))),
        "passphrase": lambda: (f"{ask()}{r.choice(('=', ': ', ' = '))}{chr(34)}", " ".join(word(r.randint(2, 3)) for _ in range(r.randint(3, 5)))),
        "drawn letters": lambda: (r.choice((f"{name()}{sign()}", said(), "Bearer ")), pick(r.choice((string.ascii_lowercase, string.ascii_letters, string.ascii_uppercase)), r.randint(18, 40))),
        "scheme": lambda: (f"Authorization: {r.choice(('Bearer', 'Basic', 'Token'))} ", pick(mixed + r.choice(("", "+/", "._-")), r.randint(16, 60)) + r.choice(("", "=", "=="))),
        "url password": lambda: (f"{r.choice(('postgres', 'mysql', 'amqp', 'redis', 'https', 'mongodb+srv'))}://{word(2)}:", pick(r.choice((mixed, mixed + "!$%*")), r.randint(8, 20))),
        "url word": lambda: (f"{r.choice(('postgres', 'mysql', 'ftp', 'https'))}://{word(2)}:", r.choice((capital(3), word(3))) + str(r.randint(10, 9999))),
        "prefixed key": lambda: (r.choice((f"{name()}{sign()}", said(), f"{word(2)} ")), f"{pick(string.ascii_lowercase, r.randint(2, 4))}{r.choice('_-')}{r.choice(('live', 'prod', 'test', ''))}{r.choice('_-')}{pick(mixed, r.randint(16, 40))}"),
        "spoken key": lambda: (said(), pick(r.choice((mixed, hexes)), r.randint(12, 40))),
    }
    false = {
        "commit": lambda: (label("commit", "sha1", "blob", "revision", "tree"), pick(hexes, r.choice((24, 40)))),
        "checksum": lambda: (label("md5", "checksum", "etag", "sha256", "digest"), pick(hexes, r.choice((32, 64)))),
        "identifier": lambda: (label("uuid", "id", "guid", "session"), "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))),
        "placeholder": lambda: (f"{name()}{sign()}", r.choice(("changeme", "your_password_here", "example123", "xxxxxxxx", "insert_key_here", "********", "replace-this-value", "YOUR-TOKEN-HERE", "<password>", "dummy-value-1"))),
        "words": lambda: (f"{name()}{sign()}", word(r.randint(3, 7))),
        "slug": lambda: (f"{word(2)} ", f"{word(3)}-{word(3)}-{r.randint(1, 99)}"),
        "variable name": lambda: (r.choice(("", f"{word(2)} ")), f"{word(4)}_{word(3)}{r.randint(1, 2030)}"),
        "path": lambda: (label("href", "src", "url"), f"/{word(3)}/{word(4)}/{r.randint(1, 9999)}"),
        "example id": lambda: (f"{name()}{sign()}", "AKIA" + r.choice(("IOSFODNN7EXAMPLE", "EXAMPLEEXAMPLE77", "XXXXXXXXXXXXXXXX"))),
        "number": lambda: (label("phone", "isbn", "order", "ref"), f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}x{r.randint(10, 99)}"),
        "template": lambda: (f"{name()}{sign()}", r.choice(("${" + word(3) + "}", "{{" + word(3) + "}}", "%(" + word(3) + ")s", "$" + word(3).upper()))),
        "image": lambda: (r.choice(("data:image/png;base64,", "base64, ")), pick(mixed + "+/", r.randint(60, 240))),
        "long word": lambda: (f"{word(2)} ", f"{word(5)}{r.randint(0, 9)}"),
        "compound": lambda: (f"{word(2)} ", word(r.randint(6, 12))),
        "foreign compound": lambda: (r.choice((f"{word(2)} ", said())), "".join(r.choice(foreign) for _ in range(r.randint(4, 9)))),
        "joined capitals": lambda: (r.choice((f"{word(2)} ", "class ", "def ")), "".join(capital(2) for _ in range(r.randint(4, 6)))),
        "said word": lambda: (said(), r.choice((f"{word(2)}-{word(2)}", f"{capital(2)}.{word(2)}", f"{word(3)}'s", f"{word(2)}_{word(2)}"))),
        "code": lambda: (f"{name()}{sign()}", r.choice((f"get_{word(2)}({word(2)})", f"self.{word(2)}_{word(1)}", f"{word(2)}.{word(2)}.{word(1)}", f"os.environ[{word(2)}]", f"{word(2)}[{r.randint(0, 9)}]"))),
        "sentence": lambda: (f"{name()}{r.choice(('=', ': ', ' = '))}{chr(34)}", " ".join(r.choice(("enter", "your", "the", "is", "must", "not", "be", "please", "type", "here", "required", "again", word(2))) for _ in range(r.randint(3, 7)))),
        "version": lambda: (label("version", "release", "build"), f"{r.randint(0, 30)}.{r.randint(0, 99)}.{r.randint(0, 99)}-{r.choice(('rc', 'beta', 'alpha'))}{r.randint(1, 9)}+{pick(hexes, 7)}"),
        "host and port": lambda: (f"{r.choice(('http', 'https'))}://{word(2)}.{word(1)}:", str(r.randint(80, 65000)) + f"?{word(1)}={word(1)}"),
        "time": lambda: (r.choice((label("date", "time", "at"), f"{name()} ")), f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}Z"),
        "integrity": lambda: (label("integrity", "hash", "sum"), r.choice(("sha256-", "sha512-", "h1:")) + pick(mixed + "+/", 43) + "="),
    }
    return true, false


def drawn(n: int = SAMPLE, seed: int = SEED, names: Callable[[str], bool] = lambda name: True) -> list[tuple[str, str, str, str, int]]:
    """n labelled findings of the shapes whose name is wanted: path, before, value, after, label; half of them true."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("an be co du er fi go ha in ju".split()) for _ in range(k))
    makers = [[f for name, f in kind.items() if names(name)] for kind in reversed(shapes(r))]
    out = []
    for i in range(n):
        label = i % 2 if all(makers) else int(bool(makers[1]))
        before, value = r.choice(makers[label])()
        path = f"{word(2)}/{r.choice(('src', 'app', 'conf', 'deploy', 'src0') if label else ('src', 'app', 'test', 'docs', 'examples', 'src0'))}/{word(2)}"
        out.append((path, f"{word(3)} {word(2)} {before}", value, f" {word(2)}", label))
    return out


class Forest:
    """Trees as arrays: for each node the feature (-1 for a leaf), threshold, children and share of true ones; and the words' odds."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]], odds: Odds):
        self.trees, self.odds = [tuple(np.array(c) for c in zip(*t)) for t in trees], odds

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), "int64")
            for _ in range(DEPTH + 1):
                f = feature[at]
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at])
                at = np.where(f < 0, at, go)
            total += share[at]
        return total / max(1, len(self.trees))


def train(spark: SparkSession, labelled: DataFrame | None = None, sample: int = SAMPLE, known: Lexicon | None = None) -> Forest:
    """A forest from at most `sample` labelled findings, chosen by a hash of their content."""
    known = known or lexicon(default_path())
    if labelled is None:
        found = drawn(sample)
    else:
        wanted = labelled.select("path", "before", "value", "after", "label").where("label IS NOT NULL AND value <> ''")
        found = [(p, b or "", v, a or "", int(y)) for p, b, v, a, y in wanted.orderBy(F.xxhash64("value", "before")).limit(sample).collect()]
    return fitted(spark, found, known)


def fitted(spark: SparkSession, found: list[tuple], known: Lexicon) -> Forest:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    half = [sum(map(ord, r[2])) % 2 for r in found]
    of = [learned([r for r, h in zip(found, half) if h == other]) for other in (1, 0)]  # for each half, from the other
    rows = [([float(v) for v in features(*r[:4], known, of[h])], float(r[4])) for r, h in zip(found, half)]
    columns = pa.table({"x": pa.array([x for x, _ in rows], pa.list_(pa.float64())), "label": pa.array([y for _, y in rows])})
    data = spark.createDataFrame(columns).coalesce(2).select(array_to_vector("x").alias("features"), "label")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(data)
    trees = []
    for tree in model.trees:
        nodes: list[list] = []

        def walk(node, nodes=nodes) -> int:
            i = len(nodes)
            stats = list(node.impurityStats().stats())
            nodes.append([-1, 0.0, 0, 0, stats[1] / max(1e-9, sum(stats))])
            if node.subtreeDepth() > 0:
                split = node.split()
                nodes[i][0], nodes[i][1] = split.featureIndex(), split.threshold()
                nodes[i][2], nodes[i][3] = walk(node.leftChild()), walk(node.rightChild())
            return i

        walk(tree._call_java("rootNode"))
        trees.append([tuple(x) for x in nodes])
    return Forest(trees, learned(found))


# ---- scanning ------------------------------------------------------------------------------------


def _scored(text: str, path: str, forest: Forest, known: Lexicon, least: float) -> list[tuple[int, int, str, float]]:
    found = proposed(text)
    if not found:
        return []
    whole = merged(found)
    spans = sorted({*found, *whole})
    x = np.array([features(path, text[max(0, a - 40) : a], text[a:b], text[b : b + 20], known, forest.odds) for a, b, _ in spans])
    p = dict(zip(spans, np.where([k == "private_key" for _, _, k in spans], 1.0, forest.score(x)).tolist()))
    out, good = [], []
    for span in whole:
        if p[span] >= least:
            out.append((*span, p[span]))
        else:
            good.append(span)
    if good and len(spans) > len(whole):  # of a union that is no secret, the parts that are
        starts = [a for a, _, _ in good]
        parts = [s for s in found if p[s] >= least and (i := bisect_right(starts, s[0])) and s[1] <= good[i - 1][1]]
        for a, b, kind in merged(parts):
            out.append((a, b, kind, max(p[s] for s in parts if a <= s[0] and s[1] <= b)))
        out.sort()
    return out


def findings(docs: DataFrame, forest: Forest, dictionary: str, path: str = "source", text: str = "text", carry: Sequence[str] = ("doc_id",), least: float = SCORE) -> DataFrame:
    """carry, start, end (code points), kind, secret_sha256, score of each secret."""
    import hashlib

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon(dictionary)
        for batch in batches:
            at, out = [], [[] for _ in range(5)]
            for i, (t, p) in enumerate(zip(batch.column(k), batch.column(k + 1))):
                if not t.is_valid:
                    continue
                s = t.as_py()
                for a, b, kind, score in _scored(s, p.as_py() or "", forest, known, least):
                    at.append(i)
                    for col, v in zip(out, (a, b, kind, hashlib.sha256(s[a:b].encode()).hexdigest(), score)):
                        col.append(v)
            if at:
                held = batch.take(pa.array(at))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([*held.columns[:k], *(pa.array(c, y) for c, y in zip(out, types))], [*carry, "start", "end", "kind", "secret_sha256", "score"])

    return docs.select(*carry, F.col(text).alias("_text"), F.col(path).cast("string").alias("_path")).mapInArrow(run, f"{kinds}, start long, end long, kind string, secret_sha256 string, score double")


def redact(docs: DataFrame, forest: Forest, dictionary: str, path: str = "source", text: str = "text", least: float = SCORE) -> DataFrame:
    """docs with each secret in the text replaced by a mark of its kind."""

    columns = docs.columns
    rows = docs.select(*columns, F.col(path).cast("string").alias("_path"))
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon(dictionary)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part, out = batch.slice(begin, 500), []
                for t, p in zip(part.column(at), part.column(len(columns))):
                    s = t.as_py()
                    if s:
                        for a, b, kind, _ in reversed(_scored(s, p.as_py() or "", forest, known, least)):
                            s = f"{s[:a]}<secret:{kind}>{s[b:]}"
                    out.append(s)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(out, pa.string()), *part.columns[at + 1 : len(columns)]], columns)

    return rows.mapInArrow(run, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = default_path()
    return findings(table(spark, sf_dir, "documents"), train(spark), dictionary)

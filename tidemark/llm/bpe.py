"""BPE encoding and decoding with forced boundaries.

A pair of bytes that occurs inside no vocabulary token can never be merged, so a cut between the two
is certain. A text is cut at special tokens, at white space, where the pre-tokenizer cuts, and inside
each word at such pairs; the fragments are encoded independently, and their ids concatenated. Words of plain texts are cut
and told apart for many texts at a time, so that each distinct word is looked up once. The
last fragment of a word is encoded with the word-end suffix, the others without. Since fragments
don't see each other, a bounded cache holds the ids of those met before, and a text of any length
is encoded piece by piece.

The tokenizer is a file of the tokenizers library, given by path; its normalizer and pre-tokenizer
are used as they are. Merges run on fragments only, by token ranks over bytes; the word-end suffix
is a byte that UTF-8 never holds, whose merge with the byte before it comes first.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows and
null or repeated document numbers are encoded row by row; an empty table gives no rows; columns
other than the text and those in `carry` are left out.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table

#: Entries of each cache, of chunks and of words; beyond them it starts anew.
CACHE = 600_000

SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = re.compile("[\x1c-\x1f]")

# Printable ASCII and Latin letters with one spelling only, whose classes all libraries agree on.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
PLAIN = re.compile("[!-~\u00df-\u00f6\u00f8-\u017f]*")
#: The same for whole lines, with blanks between the words; blanks are part of no word.
PLAIN_LINES = re.compile("[!-~\u00df-\u00f6\u00f8-\u017f\t-\r ]*")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
LINE_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9\t-\r ]+")
#: Characters of a text that are looked at together: one odd character costs the quick way for its piece alone.
PIECE = 1 << 12
#: Texts of such characters alone, which in lower case are as above, are cut many at a time; so many bytes together.
PLAIN_TEXT = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\t-\r ]*$"
NO_LETTERS = f"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^{LETTERS}0-9\t-\r ]+)"
TOGETHER = 6 << 20

_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level BPE's character for each byte: printable ones stand for themselves, the rest follow from 256 on.
CHAR_BYTES = {chr(b if b in _printable else 256 + sum(c not in _printable for c in range(b))): b for b in range(256)}
END = b"\xff"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Cache(dict):
    """What a function returned, kept for short keys, started anew when it is full."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) < 100:
            if len(self) >= CACHE:
                self.clear()
            self[key] = value
        return value


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of at least PIECE characters that end before a blank, so that no word is cut."""
    at = 0
    while len(text) - at > 2 * PIECE:
        to = text.find(" ", at + PIECE)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:] if at else text


class Encoder:
    """Encodes and decodes as the library does for the tokenizer file, without adding special tokens."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        whole = Tokenizer.from_file(path)
        self.normalize, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        vocab = model["vocab"]
        ranks = {self.bytes(t.removesuffix(self.suffix)) + END if t.endswith(self.suffix) and t != self.suffix else self.bytes(t): i for t, i in vocab.items()}
        if len(ranks) != len(vocab):
            raise ValueError("two tokens have the same bytes")
        # the pattern is never used: pieces are cut here
        self.merge = tiktoken.Encoding("fragments", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special, self.special_at = special, re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.tokens = {i: t for t, i in (vocab | special).items()}
        self.inside = [bytearray(256) for _ in range(256)]  # by first and second byte of a pair
        for t in ranks:
            for a, b in zip(t, t[1:]):
                self.inside[a][b] = 1
        self.joins = np.array([list(row) for row in self.inside], bool)
        self.words, self.chunks, self.plain = Cache(self.word), Cache(self.chunk), Cache(lambda w: self.word(w.encode()))  # packed ids

    @staticmethod
    def bytes(chars: str) -> bytes:
        """Byte characters as the bytes they stand for."""
        return bytes(map(CHAR_BYTES.__getitem__, chars))

    def fragments(self, word: bytes) -> list[bytes]:
        """A word with its end, cut at the pairs of bytes that no token holds."""
        inside, word = self.inside, word + END
        cuts = [i for i, (a, b) in enumerate(zip(word, word[1:]), 1) if not inside[a][b]]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def word(self, word: bytes) -> bytes:
        """Packed ids of a word, fragment by fragment."""
        found = self.fragments(word)
        return array("i", self.merge(found[0]) if len(found) == 1 else [i for f in found for i in self.merge(f)]).tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of plain words that aren't cached, which they are then: all their fragments are cut in one look."""
        body = "\0".join(words).encode().replace(b"\0", END) + END  # a plain word holds no NUL
        codes = np.frombuffer(body, "uint8")
        cuts = np.flatnonzero(~self.joins[codes[:-1], codes[1:]]) + 1  # behind a word's end no pair is inside a token
        bounds = [0, *cuts.tolist(), len(body)]
        found = list(map(self.merge, [body[a:b] for a, b in zip(bounds, bounds[1:])]))
        flat = array("i", chain.from_iterable(found)).tobytes()
        after = 4 * np.cumsum(np.fromiter(map(len, found), "int64", len(found)))
        ends = [0, *after[codes[np.array(bounds[1:]) - 1] == END[0]].tolist()]
        if len(self.plain) + len(words) > CACHE:
            self.plain.clear()
        new = {w: flat[a:b] for w, a, b in zip(words, ends, ends[1:])}
        self.plain.update((w, ids) for w, ids in new.items() if len(w) < 100)
        return new

    def packed(self, words: list[str]) -> list[bytes]:
        """Packed ids of plain words."""
        found = list(map(self.plain.get, words))
        missing = {w for w, ids in zip(words, found) if ids is None}
        if missing:
            new = self.learn(list(missing))
            found = [new[w] if ids is None else ids for w, ids in zip(words, found)]
        return found

    def split_words(self, chunk: str) -> list[bytes]:
        """Words of a run without white space. Where lower-casing leaves only ASCII and common Latin
        letters, a plain pattern cuts as the library's pre-tokenizer does; else that one does."""
        low = chunk.lower()
        if PLAIN.fullmatch(low):
            return [w.encode() for w in WORDS.findall(low)]
        # normalizing may still find white space, such as what lower-casing or composition leaves
        return [self.bytes(w) for part in self.normalize(chunk).split(" ") if part for w, _ in self.split(part)]

    def chunk(self, chunk: str) -> bytes:
        """Packed ids of a run without white space."""
        return b"".join(map(self.words.__getitem__, self.split_words(chunk)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text (int32)."""
        out: list[bytes] = []
        for part in self.special_at.split(text) if self.special_at else [text]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            else:
                for piece in pieces(part):
                    low = piece.lower()
                    if PLAIN_LINES.fullmatch(low):
                        out += self.packed(LINE_WORDS.findall(low))
                    else:
                        # no token reaches across white space; str.split also takes the separators FS to US for it
                        out += map(self.chunks.__getitem__, SPACES.split(piece) if SEPARATORS.search(piece) else piece.split())
        return np.frombuffer(b"".join(out), "int32")

    def encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, one behind the other, and where each text begins and the last one ends. Words are cut and
        told apart by Arrow, so that each distinct one of the texts is looked up once."""
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), NO_LETTERS, r" \1 "))
        words = pc.dictionary_encode(cut.flatten())
        each = words.dictionary.to_pylist()
        known = self.packed([w for w in each if w])
        if len(known) < len(each):  # white space at a text's ends leaves an empty word
            known.insert(each.index(""), b"")
        size = np.fromiter(map(len, known), "int64", len(known)) // 4
        ids, first, at = np.frombuffer(b"".join(known), "int32"), (np.cumsum(size) - size).astype("int32"), words.indices.to_numpy()
        count = size.astype("int32")[at]
        after = np.cumsum(count, dtype="int32")  # texts that are looked at together have far fewer ids
        where = np.repeat(first[at] - after + count, count) + np.arange(int(after[-1]) if len(after) else 0, dtype="int32")
        ends = np.concatenate([[0], after])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return ids[where], ends

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts (null: empty), one behind the other (int32), and where each text begins and the last one ends."""
        texts = pc.fill_null(texts, "")
        plain = pc.match_substring_regex(texts, PLAIN_TEXT)
        if self.special_at:
            plain = pc.and_(plain, pc.invert(pc.match_substring_regex(texts, self.special_at.pattern)))
        plain = plain.to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(texts).to_numpy()
        parts: list[np.ndarray] = []
        counts = np.zeros(len(texts), "int64")
        places: list[np.ndarray] = []  # rows of each part
        some = np.flatnonzero(plain & (sizes <= TOGETHER))
        group = np.cumsum(sizes[some]) // TOGETHER
        for g in np.unique(group):
            rows = some[group == g]
            ids, ends = self.encode_plain(texts.take(pa.array(rows)))
            counts[rows] = np.diff(ends)
            parts.append(ids)
            places.append(rows)
        for i in np.flatnonzero(~plain | (sizes > TOGETHER)).tolist():
            ids = self.encode(texts[i].as_py())
            counts[i] = len(ids)
            parts.append(ids)
            places.append(np.array([i]))
        ends = np.concatenate([[0], np.cumsum(counts)])
        if not parts:
            return np.zeros(0, "int32"), ends
        flat, order = np.concatenate(parts), np.concatenate(places)
        if (np.diff(order) > 0).all():
            return flat, ends
        # back into the order of rows
        have = counts[order]
        to = np.repeat(ends[order] - np.cumsum(have) + have, have) + np.arange(len(flat))
        out = np.empty(len(flat), "int32")
        out[to] = flat
        return out, ends

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder to a worker process."""
    if path not in _made:
        _made.clear()
        _made[path] = Encoder(path)
    return _made[path]


def encode(docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """carry and ids (array of int)."""
    rows = docs.select(*carry, F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                flat, ends = e.encode_batch(part.column(part.num_columns - 1))
                ids = pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], schema.names)

    # a mapped stream, not a column function: Spark would keep the rows beside one on disk meanwhile
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with the column decoded."""
    schema, at = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]), rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                column = part.column(at)
                flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                texts = pa.array([e.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], schema.names)

    return rows.mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )

"""Quality rules: a ledger with one bit for each failed rule.

Each rule is evaluated once. The ledger keeps the measurements and a bit mask of the rules that a
document fails; a policy is a mask with a version, and applying one is a bitwise AND. Ablations
come from a count by mask, so they never read a text again. Only DataFrame functions are used.

Defined results: a null or empty text has no words, all measurements 0 and fails FEW_WORDS; rows
that repeat are judged one by one; an empty table gives an empty ledger; columns of the input other
than the text and those in `carry` are left out, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, stored, table, text_or_empty

SYMBOLS = "#*$%&|<>"

#: Bit of each rule. The first two are the base.
RULES = {"few_words": 0, "repeated_words": 1, "symbols": 2, "repeated_lines": 3, "long_words": 4, "short_words": 5}

#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "2025.1": ("few_words", "repeated_words", "symbols", "repeated_lines", "long_words", "short_words"),
}
CURRENT = "2025.1"


def mask(policy: str | Sequence[str]) -> int:
    """The bits of a policy, by version or as a list of rules."""
    return sum(1 << RULES[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _repeat_words(words: Column, grams: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more: the windows are sorted with their
    places, places of equal neighbours remain, and each adds the words that the one before lacks."""
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: x["g"].eqNullSafe(F.get(s, j - 1)["g"]) | x["g"].eqNullSafe(F.get(s, j + 1)["g"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        added = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), x - F.get(p, k - 1)), F.lit(3)))
        return F.aggregate(added, F.lit(0), lambda a, x: a + x)

    # a one-element array binds a value to a name, so that it is evaluated once
    once = lambda value, then: F.transform(F.array(value), then)[0]
    repeats = once(placed, lambda s: once(places(s), covered))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(repeats)


def ledger(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """carry, then n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and
    fail_bits (long). n_lines counts the lines with a word."""
    body = text_or_empty(text)
    read = docs.select(*carry, body.alias("_t"), F.array_remove(F.split(body, SPACE), "").alias("_w"))
    w = F.col("_w")
    grams = F.when(F.size(w) > 2, F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    read = read.select(*carry, "_t", "_w", grams.alias("_g"), lines.alias("_l"))
    long = lambda c: c.cast("long")
    measured = read.select(
        *carry,
        long(F.size("_w")).alias("n_words"),
        long(F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_l")).alias("n_lines"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        long(_repeat_words(F.col("_w"), F.col("_g"))).alias("n_repeat_words"),
    )
    n = F.col("n_words")
    fails = {
        "few_words": n < 50,
        "repeated_words": F.col("n_repeat_words") * 100 > n * 50,
        "symbols": F.col("n_symbols") * 10 > n * 3,
        "repeated_lines": F.col("n_dup_lines") * 2 > F.col("n_lines"),
        "long_words": F.col("word_chars") > n * 12,
        "short_words": F.col("word_chars") * 2 < n * 5,
    }
    bits = [F.when(fails[r], F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for r, b in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def passes(policy: str | Sequence[str] = CURRENT) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def kept(rows: DataFrame, policy: str | Sequence[str] = CURRENT) -> DataFrame:
    """The ledger rows that pass. The mask goes through a generator of one row: a filter on the mask
    itself would be pushed below the ledger with a copy of every expression."""
    bits = rows.withColumn("_bits", F.explode(F.array("fail_bits")))
    return bits.where(F.col("_bits").bitwiseAND(F.lit(mask(policy))) == 0).drop("_bits")


def ablations(rows: DataFrame, policy: str | Sequence[str] = CURRENT) -> DataFrame:
    """For each rule of a policy: n_failed, n_only (rejected by this rule alone: what leaving it
    out would keep) and n_rejected of the whole policy. Works on the count by mask, which has at
    most two to the power of the rules rows."""
    m = mask(policy)
    names = POLICIES[policy] if isinstance(policy, str) else tuple(policy)
    counted = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("b")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in names]))
    each = counted.select("b", "n", rule.alias("r")).select("b", "n", "r.rule", "r.bit")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(
        some(F.col("b").bitwiseAND(F.col("bit")) != 0)("n_failed"), some(F.col("b") == F.col("bit"))("n_only"), some(F.col("b") != 0)("n_rejected")
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), passes(CURRENT).alias("kept"), "fail_bits",
    )


def policy_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablations of every policy from one stored ledger: texts are read once, whatever is asked of the ledger later."""
    held = stored(ledger(table(spark, sf_dir, "documents")), "ledger")
    out = None
    for version in POLICIES:
        one = ablations(held, version).select(F.lit(version).alias("policy"), "rule", "n_failed", "n_only", "n_rejected")
        out = one if out is None else out.unionByName(one)
    return out


OP1_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT r, i, list_aggregate(list_slice(w, i, i + 2), 'string_agg', ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS o(d) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered c USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * word_chars < 5 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

_ROWS = ", ".join(f"('{version}', '{rule}', {1 << RULES[rule]}, {mask(version)})" for version, rules in POLICIES.items() for rule in rules)
ABLATIONS_SQL = f"""
SELECT policy, rule, count(*) FILTER ((fail_bits & bit) <> 0) AS n_failed, count(*) FILTER ((fail_bits & m) = bit) AS n_only, count(*) FILTER ((fail_bits & m) <> 0) AS n_rejected
FROM ({OP1_SQL}), (VALUES {_ROWS}) AS p(policy, rule, bit, m) GROUP BY 1, 2
"""

"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; what is stored is the measurements and one
long with a bit for each failed rule. A policy is a versioned mask over those bits, so applying
another version, or asking what a rule alone rejects, never touches the texts again.
Only DataFrame expressions: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, pick, text_of

#: The rules, by bit, with the SQL condition of failure.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "symbols": "100 * n_symbols > 10 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "upper_case": "100 * n_upper > 40 * word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Policies by version; a document is rejected if it fails any rule listed.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "duplicate_lines", "symbols"),
    "v2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"


def mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(BIT[n] for n in set(names))


def _long(c: Column) -> Column:
    return c.cast("long")


def measure(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """df with the measurements of one text column; returns also measurement -> column name.

    Null text counts as empty: every measurement is 0. Repeated rows are measured alike.
    Each step is a projection of its own, so that an array is built once and then read.
    """
    names = dict(zip((*MEASURES, "words", "lines", "grams", "spots"), fresh(df, *(f"_q_{m}" for m in (*MEASURES, "words", "lines", "grams", "spots")))))
    n = {k: F.col(f"`{v}`") for k, v in names.items()}
    t = text_of(f"`{text}`")

    def removed(pattern: str) -> Column:
        return _long(F.length(t) - F.length(F.regexp_replace(t, pattern, "")))

    df = df.withColumns({
        names["words"]: F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        names["lines"]: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)),
        names["n_symbols"]: removed(f"{SYMBOLS}+"),
        names["n_upper"]: removed(r"\p{Lu}+"),
    })
    gram = lambda i: F.xxhash64(F.slice(n["words"], i, WINDOW))
    df = df.withColumns({
        names["n_words"]: _long(F.size(n["words"])),
        names["word_chars"]: _long(F.length(F.array_join(n["words"], ""))),
        names["n_lines"]: _long(F.size(n["lines"])),
        names["n_dup_lines"]: _long(F.size(n["lines"]) - F.size(F.array_distinct(n["lines"]))),
        names["grams"]: F.when(F.size(n["words"]) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(n["words"]) - (WINDOW - 1)), gram)).otherwise(F.array().cast("array<bigint>")),
    })
    # Only texts that repeat a window pay for sorting their (hash, place) pairs.
    repeats = F.size(F.array_distinct(n["grams"])) < F.size(n["grams"])
    pairs = F.sort_array(F.transform(n["grams"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(names["grams"], F.when(repeats, pairs))
    twice = lambda x, j: (x["h"] == F.get(n["grams"], j - 1)["h"]) | (x["h"] == F.get(n["grams"], j + 1)["h"])
    spots = F.sort_array(F.transform(F.filter(n["grams"], lambda x, j: F.coalesce(twice(x, j), (x["h"] == F.get(n["grams"], j - 1)["h"]), (x["h"] == F.get(n["grams"], j + 1)["h"]), F.lit(False))), lambda x: x["i"]))
    df = df.withColumn(names["spots"], F.when(n["grams"].isNotNull(), spots))
    # The union of [place, place + WINDOW): each place adds the gap to the next, WINDOW at most.
    covered = F.aggregate(F.transform(n["spots"], lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(n["spots"], j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn(names["n_repeat_words"], F.coalesce(_long(covered), F.lit(0).cast("long")))
    return df.drop(*(names.pop(k) for k in ("words", "lines", "grams", "spots"))), names


def failure_bits(names: dict[str, str]) -> Column:
    """The ledger's long: bit i is set if rule i fails.

    The condition, always true but not known to be, keeps a filter on the bits above the projections: pushed below them it would
    build the arrays anew inside the lambdas, for each of their elements.
    """
    total = F.lit(0).cast("long")
    for rule, condition in RULES.items():
        for measure_, column in names.items():
            condition = re.sub(rf"\b{measure_}\b", f"`{column}`", condition)
        total = total.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[rule])).otherwise(F.lit(0)).cast("long"))
    return F.when(F.monotonically_increasing_id() >= 0, total)


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, the measurements, fail_bits.

    Null or empty text: all measurements 0, few_words fails. An empty table gives an empty ledger.
    Columns other than the two named are ignored, whatever their names.
    """
    df, names = measure(pick(docs, doc_id=doc_id, text=text))
    return df.select("doc_id", *(F.col(names[m]).alias(m) for m in MEASURES), failure_bits(names).alias("fail_bits"))


def passes(bits: Column, policy: str | tuple[str, ...]) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """The ledger with base_failed and the policy's verdict."""
    bits = F.col("fail_bits")
    base_ok = passes(bits, "base")
    return book.withColumns({"base_failed": ~base_ok, "kept": base_ok & passes(bits, policy)})


def keep_rows(docs: DataFrame, policy: str, text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their columns unchanged.

    Null and empty texts fail few_words and go; repeated rows are judged alike; an empty table stays empty. Columns of any name pass.
    """
    df, names = measure(docs, text)
    bits = fresh(df, "_q_bits")[0]
    df = df.withColumn(bits, failure_bits(names))
    return df.filter(passes(F.col(f"`{bits}`"), tuple({*POLICIES["base"], *POLICIES[policy]}))).select(*(df[f"`{c}`"] for c in docs.columns))


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that only it rejects, rows kept without it.

    Works on the counts by distinct bit pattern, 2 ** rules at most, so the table is read once. seen_bits: all bits that any row failed.
    An empty ledger has no rows.
    """
    m = mask(policy)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]))
    each = patterns.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    others = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(add(hit).alias("failed"), add(hit & (others == 0)).alias("rejected_alone"), add(others == 0).alias("kept_without"), F.bit_or("bits").alias("seen_bits"))


def oracle_sql(policy: str) -> str:
    cond = {r: c for r, c in RULES.items()}
    bits = " + ".join(f"(CASE WHEN {c} THEN {BIT[r]} ELSE 0 END)" for r, c in cond.items())
    return rf"""
    WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
    g AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram
          FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
    d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
    r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM d) GROUP BY rid),
    m AS (SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
                 CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                 CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
                 CAST(len(lines) AS BIGINT) AS n_lines,
                 CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper
          FROM w LEFT JOIN r ON w.rid = r.rid),
    b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, fail_bits,
           (fail_bits & {mask('base')}) <> 0 AS base_failed,
           (fail_bits & {mask('base') | mask(policy)}) = 0 AS kept
    FROM b"""


def ablation_sql(policy: str) -> str:
    rules = ", ".join(f"('{r}', {BIT[r]})" for r in POLICIES[policy])
    bits = f"(fail_bits & {mask(policy)})"
    return f"""
    WITH book AS ({oracle_sql(policy)}), rules AS (SELECT * FROM (VALUES {rules}) v(rule, bit))
    SELECT rule, CAST(count(*) FILTER ({bits} & bit <> 0) AS BIGINT) AS failed, CAST(count(*) FILTER ({bits} = bit) AS BIGINT) AS rejected_alone,
           CAST(count(*) FILTER ({bits} & bit = {bits}) AS BIGINT) AS kept_without FROM book CROSS JOIN rules GROUP BY rule"""

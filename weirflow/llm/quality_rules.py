"""Quality rules as a ledger of bits.

``measure`` takes a fixed set of measurements of each whole text, once. ``ledger`` evaluates every rule on
them and stores which failed as bits of one number, next to the measurements. A policy is a version, a mask
of the rules that reject and nothing else, so that changing it reads the ledger only; ``ablation`` counts by
bitwise aggregation what each rule adds to a policy.

Words are runs of anything but the six ASCII space characters. Defined results: a null or empty text has no
words, measures zero throughout and fails the rule on length; each input row gives one row, so repeated rows
stay; columns besides the two named ones are ignored by ``measure``; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import id_type, keyed_text, map_slices

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_capitals", "n_letters")


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of five words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    base = len(number)
    if base < 6200:  # base ** 5 fits 63 bits
        key = np.zeros(n, np.int64)
        for j in range(WINDOW):
            key = key * base + ids[j : j + n]
    else:
        two = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * len(two) + two[2:], return_inverse=True)[1]
        key = four[:n] * base + ids[WINDOW - 1 :]
    _, of, count = np.unique(key, return_inverse=True, return_counts=True)
    steps = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(count[of] > 1)
    steps[twice] += 1
    steps[twice + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(steps)))


def measures(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on the six ASCII spaces, as these are bytes
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    letters = raw.translate(None, bytes(x for x in range(128) if not chr(x).isalpha()))
    capitals = raw.translate(None, bytes(x for x in range(256) if not 65 <= x <= 90))
    return (
        len(words), len(text) - (len(raw) - len(raw.translate(None, SPACES))), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), raw.count(b"!"), len(capitals), len(letters),
    )


def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [measures(x) for x in batch.column("text").to_pylist()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
    return pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns)], names=["doc_id", *MEASURES])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of each row's text, by one pass without a shuffle."""
    return map_slices(keyed_text(docs, id_col, text_col), measured, f"doc_id {id_type(docs, id_col)}, " + ", ".join(f"{x} long" for x in MEASURES))


#: Rules by bit, in whole numbers so that every engine agrees: true where the text fails.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "many_exclaims": "5 * n_exclaims > n_words",
    "duplicate_lines": "n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines",
    "capitals": "n_letters > 50 AND 100 * n_capitals > 40 * n_letters",
    "short_words": "2 * word_chars < 5 * n_words",
    "long_words": "word_chars > 12 * n_words",
}
BASE = ("few_words", "repeated_windows")


def bits(*rules: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(x) for x in set(rules))


@dataclass(frozen=True)
class Policy:
    """A version of what is rejected: every text that fails a rule of the mask."""

    version: str
    mask: int


POLICIES = {x.version: x for x in (Policy("v1", bits(*BASE)), Policy("v2", bits(*RULES)))}
CURRENT = POLICIES["v2"]


def ledger(measurements: DataFrame) -> DataFrame:
    """The measurements and ``failed_bits``, bit i for the i-th rule."""
    total: Column = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        total = total + F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return measurements.withColumn("failed_bits", total)


def kept(policy: Policy = CURRENT) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """For each rule of the policy: texts it fails, those it alone rejects, and those rejected without it.

    One aggregate over the distinct bit patterns (at most 2 ** rules of them), not a pass for each rule.
    """
    patterns = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(bits(k)).cast("long").alias("bit")) for k in RULES if policy.mask & bits(k)])).alias("r")
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return patterns.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        count(has).alias("n_failed"), count(F.col("bits") == F.col("r.bit")).alias("n_alone"), count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) != 0).alias("n_rejected_without")
    )


def filter_documents(docs: DataFrame, policy: Policy = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose texts pass, with all their columns; the text is measured where it lies, without a join.

    A column of ``docs`` that has the name of a measurement is kept as it is.
    """
    schema = ", ".join(f"{x} long" for x in MEASURES)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measures(x or "") for x in batch.column("_text").to_pylist()]
        made = pa.array([dict(zip(MEASURES, r, strict=True)) for r in rows], pa.struct([(x, pa.int64()) for x in MEASURES]))
        return pa.record_batch([batch.column("_row"), made], names=["_row", "_measures"])

    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    with_measures = map_slices(rows, one, f"_row {rows.schema['_row'].dataType.simpleString()}, _measures struct<{schema.replace(' long', ': long')}>", "_text")
    book = ledger(with_measures.select("_row", "_measures.*"))
    return book.where(kept(policy)).select("_row.*")


def digest(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The columns of the query, with the ledger's bits behind them."""
    book = ledger(measure(docs))
    base = F.col("failed_bits").bitwiseAND(F.lit(bits(*BASE))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & kept(policy)).alias("kept"), "failed_bits")


def oracle() -> str:
    failed = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT r, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS g
      FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM p) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY r),
m AS (SELECT w.r, doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
        (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaims, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals, text FROM w LEFT JOIN rep USING (r)),
n AS (SELECT *, (length(regexp_replace(text, '[^A-Za-z]', '', 'g')) + strlen(regexp_replace(text, '[\x00-\x7F]', '', 'g')))::BIGINT AS n_letters FROM m),
f AS (SELECT *, ({failed})::BIGINT AS failed_bits FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & {bits(*BASE)} <> 0 AS base_failed,
       failed_bits & {bits(*BASE) | CURRENT.mask} = 0 AS kept, failed_bits FROM f"""

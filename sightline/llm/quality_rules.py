"""Quality rules with verdicts on hosts.

Counts per document feed fixed rules. Failures are added up by host; a host's rate of failing documents is shrunk towards
the rate of all hosts by a beta prior that is itself fitted to the hosts (method of moments), so that a host with three
documents is not judged like one with three million. Documents that fail a base rule go. Documents that fail one of the milder
rules go as well, unless their host is known to fail less than expected: its posterior rate lies more than ``SURE`` standard
deviations below the prior mean. So junk that is spread evenly over hosts goes, and a host of otherwise good documents keeps its
odd ones. A document without failures always stays.

Counting is one pass over the text; only counts are shuffled, added up per task first, so a host with a third of all
documents is as cheap as any. The prior is two numbers. Defined results: null and empty texts have no words and fail;
documents with a null host are judged alone, so that nothing excuses a mild failure; very long texts are counted in slices of whole
rows; repeated rows are judged one by one and each counts for its host; counts and verdicts have the named columns only, whatever
further columns the input has, and ``passing_documents`` has those of its input; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import wordarrays as wa
from sightline.session import materialize

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
MEAN_WORD_CHARS = (2, 20)
SURE = 1.0
PRIOR_STRENGTH = (1.0, 1e6)

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its text replaced by the counts the rules need."""
    rest = [c for c in docs.columns if c != text_col and c not in COUNTS]
    columns = [F.coalesce(F.col(text_col), F.lit("")).alias("text"), *map(F.col, rest)]
    schema = ", ".join([*(f"{c} long" for c in COUNTS), *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema)])

    def count(batches):
        for batch in batches:
            for lo, hi, data, offsets in wa.slices(batch.column("text")):
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, _counts(data, offsets)), *(rows.column(c) for c in rest)], [*COUNTS, *rest],
                )

    return docs.select(*columns).mapInArrow(count, schema)


def _counts(data, offsets):
    words = wa.Words(data, offsets, hashes=1)
    chars = ~wa.IS_SPACE[data] & ((data & 0xC0) != 0x80)
    lines = wa.Words(data, offsets, hashes=1, gap=wa.IS_NEWLINE)
    full = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    again = np.zeros(len(full), bool)
    again[full] = wa.later_copies(lines.hashes[0][full], lines.rows[full])
    at, (windows,) = words.windows(REPEAT_WINDOW, wa.WORD_BASES[:1])
    twice = at[wa.repeated(windows, words.rows[at])]
    inside = wa.covered(twice, REPEAT_WINDOW, len(words.starts))
    return (
        words.counts.astype(np.int64), wa.per_row(chars, offsets), wa.per_row(SYMBOLS[data], offsets),
        wa.per_row(full, lines.offsets), wa.per_row(again, lines.offsets), wa.per_row(inside, words.offsets),
    )


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def mild_failed() -> F.Column:
    low, high = MEAN_WORD_CHARS
    return (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
        | (F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words"))
    )


def host_rates(judged: DataFrame, host_col: str = "source") -> DataFrame:
    """Per host: documents, failures, the shrunk rate and the verdict (whether mild failures count)."""
    hosts = judged.where(F.col(host_col).isNotNull()).groupBy(host_col).agg(
        F.count("*").alias("host_docs"), F.sum((F.col("base_failed") | F.col("mild_failed")).cast("long")).alias("host_failed"),
    )
    rate = F.col("host_failed") / F.col("host_docs")
    mean, spread = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    strength = PRIOR_STRENGTH[1]
    if spread:
        strength = min(max(mean * (1 - mean) / spread - 1, PRIOR_STRENGTH[0]), PRIOR_STRENGTH[1])
    shrunk = (F.col("host_failed") + (mean or 0.0) * strength) / (F.col("host_docs") + strength)
    rated = hosts.withColumn("host_rate", shrunk)
    deviation = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("host_docs") + strength + 1))
    return rated.withColumn("host_rejected", F.col("host_rate") + SURE * deviation >= (mean or 0.0))


def judged_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, host, counts, ``base_failed``, ``mild_failed``, ``host_rate``, ``host_rejected``, ``kept``."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("source"), F.col(text_col).alias("text"))
    judged = materialize(
        text_counts(plain).withColumn("base_failed", base_failed()).withColumn("mild_failed", mild_failed()), "quality",
    )
    hosts = host_rates(judged, "source").select("source", "host_rate", "host_rejected")
    rejected = F.coalesce(F.col("host_rejected"), F.lit(True))
    return judged.join(hosts, "source", "left").withColumn("host_rejected", rejected).withColumn(
        "kept", ~F.col("base_failed") & ~(rejected & F.col("mild_failed")),
    )


def passing_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with all their columns."""
    row = "quality_row_id"
    while row in docs.columns:
        row += "_"
    id_col, text_col, host_col = (options.pop(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("host_col", "source")))
    numbered = docs.withColumn(row, F.struct(F.col(id_col).alias("a"), F.xxhash64(text_col).alias("b"), F.col(host_col).alias("c")))
    kept = judged_documents(numbered, row, text_col, host_col, **options).where("kept").select(F.col("doc_id").alias(row)).distinct()
    return numbered.join(kept.hint("merge"), numbered[row].eqNullSafe(kept[row]), "left_semi").drop(row)

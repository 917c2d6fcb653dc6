"""Benchmark passages in documents, found by spaced seeds.

A seed is a fixed mask over neighbouring words: the hash takes the marked words and skips the others, so that a replaced word
under a gap does not matter. Seeds of documents and of benchmark items meet in a join; every hit names an alignment (document,
item, distance), and each alignment is verified word by word: it counts where ``span`` words of the item (all of a shorter item)
agree in at least ``percent`` percent of the places. Words are compared in lower case and without ASCII punctuation.

Everything is DataFrame functions. The document side is one pass whose seeds never leave their task while the seeds of the items
are broadcast, which is done up to ``BROADCAST_SEEDS`` of them, counted first; beyond that the join shuffles. Hits are
brought to distinct alignments before their texts are looked at again. Hot passages meet a broadcast table or are split by
adaptive execution; no group is collected.

Defined results: null and empty texts and items match nothing; items with fewer words than the shortest mask are not found; rows
with equal ids and different texts are examined apart, equal rows are reported once; null ids are reported with a null id;
other columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.tables import WORD_GAP, fresh, id_and_text
from sightline.session import materialize

MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6))
SPAN = 20
PERCENT = 80
BROADCAST_SEEDS = 500_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACES = " \t\n\x0b\x0c\r"


def plain_words(text: Column) -> Column:
    """Words in lower case without ASCII punctuation; one empty word if there is none."""
    return F.split(F.trim(F.translate(F.lower(text), PUNCTUATION, ""), F.lit(SPACES)), WORD_GAP, -1)


def _codes(words) -> Column:
    return F.transform(words, lambda word: F.xxhash64(word))


def _marked(words: str, number: int, mask):
    return lambda i: F.xxhash64(F.lit(number), *(F.get(F.col(words), i + k) for k in mask))


def _seeds(words: str, masks) -> Column:
    """Seed hashes at every place, one list per mask, one after the other."""
    lists = []
    for number, mask in enumerate(masks):
        last = F.size(words) - 1 - mask[-1]
        found = F.transform(F.sequence(F.lit(0), last), _marked(words, number, mask))
        lists.append(F.when(last >= 0, found).otherwise(F.array().cast("array<long>")))
    return F.concat(*lists)


def _places(df: DataFrame, words: str, masks, place: str) -> DataFrame:
    """One row per seed, with the word number it begins at."""
    counts = [F.greatest(F.col("n_words") - mask[-1], F.lit(0)) for mask in masks]
    offset, at = F.lit(0), F.col("pos")
    for count in counts:
        at = F.when(F.col("pos") >= offset, F.col("pos") - offset).otherwise(at)
        offset = offset + count
    keep = [c for c in df.columns if c != words]
    hashes = df.withColumn("n_words", F.size(words)).withColumn("seeds", _seeds(words, masks))
    # The outer form, as the plain one has its input filtered by size, for which all of it would be computed once more.
    rows = hashes.select(*keep, "n_words", F.posexplode_outer("seeds").alias("pos", "seed"))
    return rows.select(*keep, "seed", at.alias(place))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks=MASKS, span: int = SPAN, percent: int = PERCENT,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Verified overlaps: ``doc_id``, ``text_key``, ``item_id``, ``start`` (word number of the item's first word),
    ``n_agreeing`` and ``n_compared`` (words of the best stretch)."""
    texts = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    items = materialize(
        benchmark.select(F.col(item_col).alias("item_id"), plain_words(F.coalesce(F.col("text"), F.lit(""))).alias("item_words"))
        .distinct(), "benchmark-items",
    )
    item_codes = items.select("item_id", _codes("item_words").alias("words"))
    probes = materialize(_places(item_codes, "words", masks, "item_at").distinct(), "benchmark-seeds")
    probes = F.broadcast(probes) if probes.count() <= BROADCAST_SEEDS else probes
    hashed = texts.select("doc_id", "text_key", _codes(plain_words(F.col("text"))).alias("words"))
    hits = _places(hashed, "words", masks, "at").join(probes, "seed")
    alignments = materialize(
        hits.select("doc_id", "text_key", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct(), "alignments",
    )
    return _verified(texts, alignments, items, span, percent)


def _verified(texts, alignments, items, span, percent):
    found = texts.withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "key").join(
        alignments, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")),
    ).dropDuplicates(["doc_id", "text_key", "item_id", "start"])
    pair = found.join(items, "item_id").select(
        "doc_id", "text_key", "item_id", "start", "item_words", plain_words(F.col("text")).alias("words"),
    )
    skipped = F.greatest(-F.col("start"), F.lit(0))
    length = F.least(F.size("item_words") - skipped, F.size("words") - F.greatest("start", F.lit(0)))
    agree = F.zip_with(
        F.slice("item_words", skipped + 1, length), F.slice("words", F.greatest("start", F.lit(0)) + 1, length),
        lambda x, y: (x == y).cast("int"),
    )
    wide = F.least(F.lit(span), F.size("item_words"))
    stretch = F.when(
        F.size("agree") >= F.col("n_compared"),
        F.array_max(F.transform(
            F.sequence(F.lit(1), F.size("agree") - F.col("n_compared") + 1),
            lambda k: F.aggregate(F.slice("agree", k, F.col("n_compared")), F.lit(0), lambda total, x: total + x),
        )),
    ).otherwise(0)
    compared = pair.select("doc_id", "text_key", "item_id", "start", agree.alias("agree"), wide.alias("n_compared"))
    return materialize(compared, "compared").select(
        "doc_id", "text_key", "item_id", "start", stretch.alias("n_agreeing"), "n_compared",
    ).where(100 * F.col("n_agreeing") >= percent * F.col("n_compared"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without verified overlaps, with all their columns."""
    leak_id, leak_key = fresh(docs, "leak_id"), fresh(docs, "leak_key")
    found = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(
        F.col("doc_id").alias(leak_id), F.col("text_key").alias(leak_key),
    ).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(leak_id)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(leak_key))
    return docs.join(found, same, "left_anti")

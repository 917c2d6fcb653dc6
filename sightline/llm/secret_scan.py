"""Secrets, and credentials whose parts stand apart.

Three kinds are certain enough alone: assignments, access identifiers and long hexadecimal runs. Weaker parts (identifiers,
mixed-character tokens, endpoints) mean little alone and are reported only when a complementary part lies in the same
scope, which is ``scope`` code points around it:

* a weak identifier with any secret (assignment, hexadecimal run, weak secret),
* a weak secret with any identifier or endpoint,
* an endpoint with both an identifier and a secret.

Weak parts that overlap a certain span are dropped before. Everything is DataFrame functions. Text is read once, into the gap
before and the length of every match; running sums turn those into places. The interval join is a sweep: per document, in order
of start, the furthest end so far and the nearest start to come of each role tell whether an interval of that role is in
scope, so that no pairs are made. Only matches are shuffled, by row; a document's matches are bounded by its text.

Defined results: null and empty texts have no spans; repeated rows and rows with equal or null ids are scanned one by one; other
columns are ignored; an empty table gives an empty table. Places count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.tables import id_and_text
from sightline.session import materialize

SCOPE = 200

# The kinds, in their order, and their patterns.
ASSIGN_KEY = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?"
)
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
PATTERNS = {
    "assign": ASSIGN_KEY + "([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "(?<![0-9a-f])[0-9a-f]{24,}",
    "identifier": "([Uu]ser(_?[Nn]ame|_?[Ii][Dd])?|[Ll]ogin|[Cc]lient_?[Ii][Dd]|[Aa]ccount)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9_.@-]{3,}",
    "secret": "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}",
    "endpoint": "(https?|s?ftp|ssh|jdbc|postgres|mysql|mongodb|redis|amqp)://[^\\x20\\x09-\\x0D\"'<>]+",
}
ROLES = {"identifier": ["access", "identifier"], "secret": ["assign", "hex", "secret"], "endpoint": ["endpoint"]}
SURE = ["assign", "access", "hex"]


def scanned_documents(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``row``, ``doc_id`` and ``spans``, an array of (start, rank, kind, end) in order."""
    found = materialize(
        id_and_text(docs, id_col, text_col)
        .select("doc_id", F.flatten(F.array(*map(_matches, KINDS))).alias("matches"))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "matches"),
        "secret-matches",
    )
    spans = linked(placed(found), scope)
    by_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    return found.select("row", "doc_id").join(by_row, "row", "left")


def _matches(kind: str) -> Column:
    """For every match: kind, number, code points between it and the one before, its length, whether it passes."""
    text, pattern = F.col("text"), F.lit(PATTERNS[kind])
    match = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(match))
    passes = {
        "assign": lambda m: F.length(F.regexp_replace(m, "^" + ASSIGN_KEY, "")) >= 6,
        "secret": lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"),
    }.get(kind, lambda m: F.lit(True))
    rank = KINDS.index(kind)
    listed = F.transform(
        F.zip_with(gaps, match, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("length"), passes(m).alias("passes"))),
        lambda x, i: F.struct(
            F.lit(rank).alias("rank"), i.alias("number"), x["gap"].alias("gap"), x["length"].alias("length"),
            x["passes"].alias("passes"),
        ),
    )
    likely = {
        "access": text.contains("AKIA"), "endpoint": text.contains("://"),
        "assign": text.rlike("[Ww][Oo]?[Rr]?[Dd]|[Cc][Rr][Ee][Tt]|[Tt][Oo][Kk]|[Kk][Ee][Yy]") & text.rlike("[:=]"),
        "identifier": text.rlike("[:=]"),
    }.get(kind, F.lit(True))
    return F.when(likely & text.rlike(PATTERNS[kind]), listed).otherwise(F.array().cast(
        "array<struct<rank: int, number: int, gap: int, length: int, passes: boolean>>",
    ))


def placed(found: DataFrame) -> DataFrame:
    """Passing matches with their places: ``row``, ``rank``, ``kind``, ``start``, ``end``."""
    so_far = Window.partitionBy("row", "rank").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.col("length")).over(so_far) - F.col("length")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    return (
        found.select("row", F.explode("matches").alias("m")).select("row", "m.*")
        .select("row", "rank", kind.alias("kind"), start.alias("start"), (start + F.col("length")).alias("end"), "passes")
        .where("passes").drop("passes")
    )


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The certain spans, and those weak ones that have their complement in scope."""
    order = Window.partitionBy("row").orderBy("start")
    before, after = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)

    def within(kinds, reach):
        member = F.col("kind").isin(kinds)
        return F.coalesce(F.max(F.when(member, F.col("end"))).over(before) > F.col("start") - reach, F.lit(False)) | F.coalesce(
            F.min(F.when(member, F.col("start"))).over(after) < F.col("end") + reach, F.lit(False),
        )

    sure = F.col("kind").isin(SURE)
    clear = spans.withColumn("hidden", ~sure & within(SURE, 0)).where("not hidden").drop("hidden")
    near = clear.select("*", *(within(kinds, scope).alias(f"near_{role}") for role, kinds in ROLES.items()))
    return near.where(
        sure
        | ((F.col("kind") == "identifier") & F.col("near_secret"))
        | ((F.col("kind") == "secret") & (F.col("near_identifier") | F.col("near_endpoint")))
        | ((F.col("kind") == "endpoint") & F.col("near_identifier") & F.col("near_secret")),
    ).select("row", "rank", "kind", "start", "end")

"""Secret scan with multipart credential linking, in DataFrame expressions only.

Base kinds are found by pattern.  Weak parts (an identifier, a high-entropy token, an endpoint) mean little
alone, so they are reported only where complementary parts lie within ``reach`` code points in the same
document: an identifier needs a secret, a weak secret needs an identifier, an endpoint needs both.  The interval
join within a document runs over its parts sorted by start: the furthest end of each class before a part and the
nearest start after it (running extremes, two window frames) tell whether a part of that class is in reach, so the
work is that of a sort and no pairs are made.  Only rows of four numbers are dealt, by document row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base patterns in the order in which kinds sort, with the group and size that a match needs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A greedy run that is too short holds no later start that is long enough, so the length can be in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = r"""(?i)\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
WEAK = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{16,}"
ENDPOINT = r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+"""
KINDS = ("assign", "access", "hex", "identifier", "weak", "endpoint")
REACH = 200


def _hits(text: Column, kind: int, pattern: str, value_group: int | None = None, least: int = 0) -> Column:
    """array<struct<k, gap, size, fine>> of the leftmost non-overlapping matches: the code points between a match and
    the one before it, its own, and whether its ``value_group`` has ``least`` of them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if value_group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), values.alias("value"))
    matches = F.filter(pieces, lambda x: x["hit"].isNotNull())  # the last piece is what follows the last match
    sized = F.transform(matches, lambda x: F.struct(F.lit(kind).alias("k"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["value"]) >= least).alias("fine")))
    return F.when(text.rlike(pattern), sized).otherwise(_none())


def _none() -> Column:
    return F.expr("cast(array() as array<struct<k:int,gap:int,size:int,fine:boolean>>)")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def _parts(rows: DataFrame) -> DataFrame:
    """(row, doc_id, s, k, e): the matches of ``rows`` (row, doc_id, hits); rows without one have a null k.

    A match starts where the gaps and matches of its kind before it end, so starts are running sums.
    """
    each = rows.select("row", "doc_id", F.posexplode_outer("hits").alias("at", "hit")).repartition("row")
    before = Window.partitionBy("row", "hit.k").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = each.withColumn("e", F.sum(F.col("hit.gap") + F.col("hit.size")).over(before).cast("int"))
    fine = ended.filter("hit is null or hit.fine or at = 0")  # a row's first match stays, so that the row does
    kind = F.when(F.col("hit.fine"), F.col("hit.k"))
    return fine.select("row", "doc_id", (F.col("e") - F.col("hit.size")).alias("s"), kind.alias("k"), "e")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, base, found) of every row: arrays of struct<s, k, e> sorted by start and kind.

    ``base`` holds the base kinds; ``found`` holds those and the linked weak parts.  k indexes ``KINDS``, s
    and e are code points, e exclusive.  A weak part that overlaps a base part is that part and not reported
    again.  Null and empty texts have no spans; rows that repeat a doc_id are scanned each on its own; other
    columns are not read.  Texts of any length are read whole; their matches, not their text, are shuffled.
    """
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = (_hits(text, 0, ASSIGN, 2, 6), _hits(text, 1, ACCESS), _hits(text, 2, HEX))
    rows = rows.select("row", "doc_id", "text", *[x.alias(KINDS[k]) for k, x in enumerate(kinds)])
    ident = (F.size("access") > 0) | text.rlike(IDENTIFIER)
    secret = F.exists("assign", lambda x: x["fine"]) | (F.size("hex") > 0) | text.rlike(WEAK)
    weak = F.concat(_hits(text, 3, IDENTIFIER), _hits(text, 4, WEAK), _hits(text, 5, ENDPOINT))
    rows = rows.select("row", "doc_id", F.concat("assign", "access", "hex", F.when(ident & secret, weak).otherwise(_none())).alias("hits"))

    # frames that begin at an end of the order are running extremes; one that ended there would be computed anew for each row
    earlier, later = (Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (("s", "k", "e"), (F.desc("s"), F.desc("k"), F.desc("e"))))
    base, scopes = F.col("k") <= 2, {"ident": F.col("k").isin(1, 3), "secret": F.col("k").isin(0, 2, 4)}
    near = {
        name: F.coalesce((F.col("s") - F.max(F.when(of, F.col("e"))).over(earlier)) <= reach, F.lit(False))
        | F.coalesce((F.min(F.when(of, F.col("s"))).over(later) - F.col("e")) <= reach, F.lit(False))
        for name, of in scopes.items()
    }
    apart = F.coalesce(F.max(F.when(base, F.col("e"))).over(earlier) <= F.col("s"), F.lit(True)) & F.coalesce(F.min(F.when(base, F.col("s"))).over(later) >= F.col("e"), F.lit(True))
    parts = _parts(rows).select("row", "doc_id", "s", "k", "e", apart.alias("apart"), *[x.alias(n) for n, x in near.items()])
    wants = F.when(F.col("k") == 3, F.col("secret")).when(F.col("k") == 4, F.col("ident")).otherwise(F.col("ident") & F.col("secret"))
    span = F.struct("s", "k", "e")
    found = parts.groupBy("row", "doc_id").agg(F.collect_list(F.when(base, span)).alias("base"), F.collect_list(F.when(base | ((F.col("k") >= 3) & F.col("apart") & wants), span)).alias("found"))
    return found.select("doc_id", F.array_sort("base").alias("base"), F.array_sort("found").alias("found"))


def _equals(value: int):
    return lambda x: x == value


def digest(docs: DataFrame) -> DataFrame:
    """The scan as counts of the base kinds, the hash of the base spans, and all spans as a string."""
    kinds = F.transform("base", lambda x: x["k"])
    count = [F.size(F.filter(kinds, _equals(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return scan(docs).select("doc_id", *count, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))

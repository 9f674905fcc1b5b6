"""Secret scan with multipart credential linking (operator 2).  DataFrame
functions only.

Positions without a UDF: ``split`` by a pattern gives the texts between its
matches and ``regexp_extract_all`` the matches; running sums of their lengths
are the spans, in code points.  Only lengths are exploded and shuffled, one
exchange by row.

Kinds: assign, access and hex are reported wherever they match.  Access ids of
other kinds, unlabelled tokens and endpoints are weak: each is reported only if
a complementary part starts within ``scope`` code points in the same text (an
id needs a secret, a token an id or endpoint, an endpoint an access id or an
assignment).  That interval join is a range frame over the spans of a text in
order: linear, no pairs.  Spans of a kind don't overlap and have 12 characters
or more, so a frame holds a bounded number of rows, however long the text.

Nulls and empty texts have no spans.  Repeated rows are scanned each on their
own.  Other columns pass through where asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kind, Java pattern, group whose length counts, least length.  A kind's
#: place is its rank among spans with one start.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("weak_id", r"(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}", 0, 16),
    ("token", r"[A-Za-z0-9+/_]{20,}", 0, 20),
    ("endpoint", r"https?://[A-Za-z0-9._-]+(?::[0-9]+)?(?:/[A-Za-z0-9._/-]*)?", 0, 12),
)
BASE = ("assign", "access", "hex")
MASK = "[SECRET]"


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.length(x))


def _matches(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    good = F.transform(part, lambda x: F.length(x) >= least)
    if KINDS[rank][0] == "token":  # letters and digits, and not what the strong kinds report
        good = F.transform(part, lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]") & ~x.rlike("[0-9a-f]{16}|AKIA[A-Z0-9]{14}"))
    found = F.struct(F.lit(rank).alias("rank"), F.arrays_zip(_lengths(F.split(text, pattern)).alias("gap"), _lengths(whole).alias("size"), good.alias("good")).alias("hits"))
    return F.when(text.rlike(pattern), found)


def find_spans(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), scope: int = 512) -> DataFrame:
    """Per reported span (_row, rank, start, end), and per row one of rank -1
    with ``_doc``, a struct of its ``carry`` columns.  Dealt by _row."""
    text = F.col("_text")
    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                       F.struct(*[F.col(c) for c in carry]).alias("_doc"))
    none = F.struct(F.lit(-1).alias("rank"), F.expr("array(struct(0 as gap, 0 as size, true as good))").alias("hits"))
    kinds = F.array(none, *[_matches(text, i, p, g, n) for i, (_, p, g, n) in enumerate(KINDS)])
    rows = (base.select("_row", "_doc", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("_k"))
            .select("_row", F.when(F.col("_k.rank") == -1, F.col("_doc")).alias("_doc"), F.col("_k.rank").alias("rank"), F.posexplode("_k.hits").alias("_i", "_h"))
            .select("_row", "_doc", "rank", "_i", "_h.gap", "_h.size", "_h.good").where("size is not null")
            .repartition("_row"))
    order = Window.partitionBy("_row", "rank").orderBy("_i")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = (rows.withColumn("start", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + before)
             .withColumn("end", F.col("start") + F.col("size")).where("good"))
    rank = {k[0]: i for i, k in enumerate(KINDS)}
    near = Window.partitionBy("_row").orderBy("start").rangeBetween(-scope, scope)
    has = lambda *kinds: F.max(F.col("rank").isin(*[rank[k] for k in kinds])).over(near)
    linked = (F.when(F.col("rank") == rank["weak_id"], has("assign", "hex", "token"))
              .when(F.col("rank") == rank["token"], has("access", "weak_id", "endpoint"))
              .when(F.col("rank") == rank["endpoint"], has("access", "assign")).otherwise(F.lit(True)))
    return spans.withColumn("_linked", linked).where("_linked").select("_row", "_doc", "rank", "start", "end")


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", scope: int = 512) -> DataFrame:
    """Per row: id, counts of the strong kinds, spans (array of kind, start,
    end, ordered by start and kind)."""
    spans = find_spans(docs, text_col, (id_col,), scope)
    hit = F.when(F.col("rank") >= 0, F.struct("start", "rank", "end"))
    count = lambda k: F.count_if(F.col("rank") == [x[0] for x in KINDS].index(k)).alias(f"n_{k}")
    per_row = spans.groupBy("_row").agg(F.first("_doc", ignorenulls=True).alias("_doc"), *[count(k) for k in BASE], F.sort_array(F.collect_list(hit)).alias("_hits"))
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return per_row.select(F.col(f"_doc.`{id_col}`").alias(id_col), *[f"n_{k}" for k in BASE],
                          F.transform("_hits", lambda x: F.struct(F.get(names, x["rank"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", scope: int = 512, mask: str = MASK) -> DataFrame:
    """``docs`` with each reported span (overlapping ones as one) replaced by
    ``mask``; null texts stay null."""
    spans = find_spans(docs, text_col, tuple(docs.columns), scope)
    earlier = Window.partitionBy("_row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_to", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    new = F.when((F.col("rank") >= 0) & (F.col("start") >= F.col("_to")), F.struct("start", "_to"))
    rows = spans.groupBy("_row").agg(F.first("_doc", ignorenulls=True).alias("_doc"), F.sort_array(F.collect_list(new)).alias("_gaps"), F.max("end").alias("_end"))
    text = F.col(f"_doc.`{text_col}`")
    kept = F.transform("_gaps", lambda g: F.concat(F.substring(text, g["_to"] + 1, g["start"] - g["_to"]), F.lit(mask)))
    clean = F.when(F.size("_gaps") == 0, text).otherwise(F.concat(F.array_join(kept, ""), F.substring(text, F.col("_end") + 1, F.length(text))))
    return rows.select(*[clean.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])

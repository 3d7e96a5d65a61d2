"""Line deduplication over content-defined chunks, in DataFrame expressions only.

A rolling hash over the hashes of three successive lines ends a chunk where it is
0 modulo ``spread``, so boundaries move with the lines around them and survive
insertions elsewhere.  A chunk of two lines or more that occurs again anywhere is
removed everywhere but at its first place (least doc_id, then place).  Chunks
meet by digest, and are removed only after their bytes were compared.

Defined cases: null text stays null and has no lines; an empty text is one empty
line; a chunk of blank lines only is never removed; rows that agree in doc_id and
text are one document, so both keep what it keeps; an empty table gives no rows;
the other columns of ``docs`` are left alone, but for those with the name of a
result (n_lines, n_removed, removed_chunks), which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, attach_by_group, durable, let

#: A line's hash is this many hex digits of its MD5.
_DIGITS = 7


def chunks(text: Column, spread: int) -> Column:
    """Array of (no, lines) structs."""

    def cut(lines: Column) -> Column:
        h = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, _DIGITS), 16, 10).cast("long"))

        def ends(h: Column) -> Column:
            old = lambda i, k: F.coalesce(F.when(i >= k, F.get(h, i - k)), F.lit(0).cast("long"))
            last = F.size(h) - 1
            return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ((F.get(h, i) + 31 * old(i, 1) + 961 * old(i, 2)) % 1000003 % spread == 0))

        def take(e: Column) -> Column:
            start = lambda k: F.when(k > 0, F.get(e, k - 1) + 1).otherwise(0)
            return F.transform(e, lambda x, k: F.struct(k.alias("no"), F.slice(lines, start(k) + 1, x - start(k) + 1).alias("lines")))

        return let(let(h, ends), take)

    return let(F.split(text, "\n", -1), cut)


def line_dedup(docs: DataFrame, spread: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text left over, and n_lines, n_removed (lines) and removed_chunks (ordinals)."""
    docs = docs.drop("n_lines", "n_removed", "removed_chunks").withColumn("__mark", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    each = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("__mark").alias("mark"), F.explode(chunks(F.col(text_col), spread)).alias("c"))
    body = F.array_join("c.lines", "\n")
    each = each.where((F.size("c.lines") > 1) & body.rlike(f"[^{SPACE[1:]}")).select(F.struct("id", "mark", F.col("c.no").alias("no")).alias("place"), body.alias("body"))
    each = durable(each.withColumn("digest", F.unhex(F.md5("body"))))

    again = durable(each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"))
    if again.count() <= BROADCAST_ROWS:
        found = each.join(F.broadcast(again.select("digest")), "digest", "left_semi")
    else:
        found = attach_by_group(each, again, "digest", "n").drop("n")
    # Grouping by the bytes themselves is the comparison; what it found travels by a digest of 256 bits.
    found = found.withColumn("digest", F.unhex(F.sha2("body", 256)))
    kinds = found.groupBy("body").agg(F.first("digest").alias("digest"), F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    kinds = durable(kinds.drop("body"))
    gone = attach_by_group(found.drop("body"), kinds, "digest", "n").where("not place <=> first")
    gone = gone.groupBy(F.col("place.id").alias("__id"), F.col("place.mark").alias("__mark")).agg(F.sort_array(F.collect_set("place.no")).alias("__gone"))
    gone = gone.withColumnRenamed("__mark", "__m")

    joined = docs.join(gone.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__m")), "left")

    def rebuilt(c: Column) -> Column:
        stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(c) - 1), "__gone"), lambda no: F.get(c, no))
        return F.struct(
            F.array_join(F.flatten(F.transform(stay, lambda x: x["lines"])), "\n").alias("text"),
            F.size(F.flatten(F.transform(c, lambda x: x["lines"]))).cast("long").alias("n"),
            F.size(F.flatten(F.transform(stay, lambda x: x["lines"]))).cast("long").alias("kept"),
        )

    text = F.col(text_col)
    whole = F.struct(text.alias("text"), F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("n"), F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("kept"))
    out = joined.withColumn("__new", F.when(F.col("__gone").isNull(), whole).otherwise(let(chunks(text, spread), rebuilt)))
    kept_columns = [F.col("__new.text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "__mark"]
    none = F.array().cast("array<int>")
    return out.select(*kept_columns, F.col("__new.n").alias("n_lines"), (F.col("__new.n") - F.col("__new.kept")).alias("n_removed"), F.coalesce("__gone", none).alias("removed_chunks"))

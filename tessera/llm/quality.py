"""Quality rules with a distribution test, in DataFrame expressions only.

Base rules count words, symbols, repeated lines and repeated three-word windows.
Documents long enough are then compared with language references by the
Jensen-Shannon distance (base 2, so 0 to 1) of two histograms: character classes
and common words.  References are learned from all documents that name a language:
the sums of their classes, and the counts of the language's ``N_COMMON`` most
frequent words (in lower case, without ASCII marks at their ends; ties by byte
order), all other words being one bin.  A document's distance to a language is the
larger of its two distances, and it is kept if the nearest language is near enough.

A language has a reference if it holds at least one ``_SHARE``-th of the words of
all documents that name one, so there are at most ``_SHARE`` of them, of a few
numbers each.

Windows of a text are sorted by a hash and compared by their words; a text in which
different windows have one hash is sorted by the windows themselves.

Defined cases: null text has no words and fails the base rules; a null lang adds to
no reference, and its documents are compared with all; documents that name a
language too rare for a reference, and those under ``min_words`` words, are not
judged by distance, nor is any document if there is no reference; a text without a
common word is judged like any other; repeated rows are judged alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, durable, let, words_of

#: Common words of a language, and the share of all words that a language needs to have a reference.
N_COMMON, _SHARE = 16, 256
#: The ASCII marks, which are cut off both ends of a word before it is counted.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Patterns of character classes; lower-case ASCII letters are what remains.
CLASSES = {"blank": SPACE, "upper": "[A-Z]", "digit": "[0-9]", "mark": r"[!-/:-@\[-`{-~]", "wide": r"[^\x00-\x7F]"}
_REFERENCES = "array<struct<words: array<string>, word: array<double>, char: array<double>>>"


def by_words(w: Column) -> Column:
    """Ascending places of the three-word windows that occur twice or more, without a hash."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, 3)).alias("words"), i.cast("long").alias("at")))

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["words"] == x["words"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["at"]))

    return let(F.sort_array(windows), twice)


def repeated_words(words: Column) -> Column:
    """Number of words inside three-word windows that occur twice or more."""

    def positions(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        hashed = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
        )

        def matched(s: Column) -> Column:
            key = lambda x: F.call_function("shiftright", x, bits)
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            word = lambda x, k: F.get(w, x.bitwiseAND(mask).cast("int") + k)
            same = lambda x, y: (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
            # How each entry goes with the next: 0 for another hash, 1 for the same words, 2 for other words.
            links = F.transform(s, lambda x, j: let(F.get(s, j + 1), lambda y: F.when(y.isNull() | (key(x) != key(y)), 0).when(same(x, y), 1).otherwise(2)))

            def found(link: Column) -> Column:
                at = F.filter(s, lambda x, j: (F.get(link, j) == 1) | F.coalesce(F.get(link, j - 1) == 1, F.lit(False)))
                return F.when(F.array_contains(link, 2), by_words(w)).otherwise(F.sort_array(F.transform(at, lambda x: x.bitwiseAND(mask))))

            return let(links, found)

        return let(F.sort_array(hashed), matched)

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, j + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(positions(w), covered)))


def plain(word: Column) -> Column:
    """The form in which common words are counted."""
    return F.btrim(F.lower(word), F.lit(MARKS))


def common_words(docs: DataFrame) -> list[tuple[str, int, list[tuple[str, int]]]]:
    """(lang, number of its words, its common words with their counts) of each language that has a reference."""
    words = docs.where("lang is not null").select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    counts = durable(words.groupBy("lang", plain(F.col("word")).alias("word")).agg(F.count("*").alias("n")))
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    all_words = sums.agg(F.sum("total")).first()[0] or 0
    known = {r.lang: r.total for r in sums.where(F.col("total") * _SHARE >= all_words).collect()}
    # The limit by rank is applied in each task before the shuffle by language.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.where(F.col("lang").isin(*known) & (F.col("word") != "")).withColumn("rank", rank).where(F.col("rank") <= N_COMMON).collect() if known else []
    ranked = sorted(top, key=lambda r: r["rank"])
    return [(lang, known[lang], [(r.word, r.n) for r in ranked if r.lang == lang]) for lang in sorted(known)]


def measures(text: Column, common: list[str]) -> Column:
    """A struct of the base counts, the counts of character classes, and those of the ``common`` words it has."""
    text = F.coalesce(text, F.lit(""))
    ink = lambda x: x.rlike(f"[^{SPACE[1:]}")
    lines = F.filter(F.split(text, "\n", -1), ink)

    def counted(found: Column) -> Column:
        entry = lambda x: F.struct(x.alias("word"), F.size(F.filter(found, lambda y: y == x)).cast("long").alias("n"))
        return F.map_from_entries(F.transform(F.array_distinct(found), entry))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            let(F.filter(F.transform(w, plain), lambda x: x.isin(common)), counted).alias("common"),
        )

    return F.struct(
        let(words_of(text), of).alias("w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.length(text).cast("long").alias("n_chars"),
        F.array(*[F.regexp_count(text, F.lit(p)).cast("long") for k, p in CLASSES.items() if k != "blank"]).alias("chars"),
    )


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _shares(counts: Column) -> Column:
    return let(_total(counts), lambda t: F.when(t > 0, F.transform(counts, lambda x: x / t)))


def _with_rest(counts: Column, total: Column) -> Column:
    return let(counts, lambda c: F.concat(c, F.array(total - _total(c))))


def _distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(shares, reference, term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def quality(docs: DataFrame, max_distance: float = 0.3, min_words: int = 100, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance).

    ``distance`` is null where it isn't judged.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    languages = common_words(docs)
    listed = sorted({word for _, _, words in languages for word, _ in words})
    m = docs.select("doc_id", "lang", measures(F.col("text"), listed).alias("m"))
    m = m.select("doc_id", "lang", "m.w.*", "m.n_symbols", "m.n_dup_lines", "m.n_chars", "m.chars")
    blank = F.col("n_chars") - F.col("word_chars")
    m = durable(m.withColumn("char", _with_rest(F.concat("chars", F.array(blank)), F.col("n_chars"))).drop("chars"))
    known = F.col("lang").isin([lang for lang, _, _ in languages])
    sums = m.where(known).groupBy("lang").agg(F.array(*[F.sum(F.get("char", F.lit(i))) for i in range(len(CLASSES) + 1)]).alias("char"))
    chars = {r.lang: r.char for r in sums.collect()}
    references = []
    for lang, total, words in languages:
        counts = [n for _, n in words]
        shares = [n / total for n in [*counts, total - sum(counts)]]
        references.append({"words": [word for word, _ in words], "word": shares, "char": [n / sum(chars[lang]) for n in chars[lang]]})

    def distance(r: Column) -> Column:
        had = F.transform(r["words"], lambda x: F.coalesce(F.try_element_at("common", x), F.lit(0).cast("long")))
        return F.greatest(_distance(_shares(_with_rest(had, F.col("n_words"))), r["word"]), _distance(F.col("char_share"), r["char"]))

    m = m.withColumn("char_share", _shares(F.col("char")))
    nearest = F.array_min(F.transform(F.from_json(F.lit(json.dumps(references)), _REFERENCES), distance))
    judged = (F.col("n_words") >= min_words) & (F.col("lang").isNull() | known)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = m.withColumn("base_failed", failed).withColumn("distance", F.when(judged, nearest))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= max_distance, F.lit(True))
    return out.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")

"""Quality rules: repeated windows and a divergence of histograms from language references.

DataFrame functions only, all but one of them within a row: no text or window is ever shuffled. Only counts of words are, and
only of languages whose common words are not given here.

A document's bytes fall into seven character classes and its words into a language's common words or the rest. The references
are the same histograms summed over all documents of each value of lang. Jensen-Shannon distances (base 2,
0 to 1) to the nearest reference above a threshold reject a document long enough to tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import SPACE

#: Common words of some languages, as written inside a sentence. Fixed values; those of other languages are counted.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
#: Character classes as patterns of one-byte characters. The further bytes of longer characters, white space and all other bytes follow.
CLASSES = {
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "symbol": r"[#*$%&|<>]",
    "mark": r"[.,;:!?'\"()/\x2d]",
}
ALL_COMMON = sorted({w for words in COMMON_WORDS.values() for w in words})


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(words: Column, width: int = 8) -> Column:
    """The number of words in windows of `width` words found twice or more, by 64-bit hashes of windows."""

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = _let(
            ordered,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )
        gaps = _let(again, lambda t: F.transform(t, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(t, j + 1) - p, F.lit(width)))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(_let(words, hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def _with_words(docs: DataFrame) -> DataFrame:
    """docs with `q_text` (null: empty) and `q_words`."""
    held = docs.withColumn("q_text", F.coalesce(F.col("text"), F.lit("")))
    return held.withColumn("q_words", F.array_remove(F.split("q_text", SPACE), ""))


def _with_histograms(worded: DataFrame) -> DataFrame:
    """Adds `q_chars` (counts of the seven classes) and `q_common` (counts of ALL_COMMON, in order)."""
    sized = (
        worded.withColumn("q_word_chars", F.char_length(F.concat_ws("", "q_words")).cast("long"))
        .withColumn("q_marked", F.concat(F.lit("\x01"), F.array_join(F.filter("q_words", lambda w: w.isin(ALL_COMMON)), "\x02\x01"), F.lit("\x02")))
        .withColumn("q_classes", F.array(*[F.regexp_count("q_text", F.lit(p)).cast("long") for p in CLASSES.values()]))
    )
    chars = F.char_length("q_text").cast("long")
    space, wide = chars - F.col("q_word_chars"), F.octet_length("q_text").cast("long") - chars
    other = F.col("q_word_chars") - F.aggregate("q_classes", F.lit(0).cast("long"), lambda a, x: a + x)
    # Each matched word stands between two marks in one text: the bytes that go when a word is replaced by nothing count it.
    common = [((F.octet_length("q_marked") - F.octet_length(F.replace("q_marked", F.lit(f"\x01{w}\x02"), F.lit("")))) / (len(w.encode()) + 2)).cast("long") for w in ALL_COMMON]
    return sized.withColumn("q_chars", F.concat("q_classes", F.array(wide, space, other))).withColumn("q_common", F.array(*common))


def language_references(docs: DataFrame, least_words: int = 1000, most_common: int = 12) -> dict[str, tuple[list[int], list[int], int, list[str]]]:
    """{language: (character counts, counts of its common words, words, its common words)} over all documents of each
    lang of COMMON_WORDS, and of each other one with least_words words or more: at most a row and most_common words a language
    come to the driver. The common words of the others are their most frequent ones, counted in a pass over their documents alone."""
    known = F.col("lang").isin(list(COMMON_WORDS))
    rows = _with_histograms(_with_words(docs.select("lang", "text").where("lang is not null")))
    sums = [F.sum(F.get("q_chars", i)).alias(f"c{i}") for i in range(len(CLASSES) + 3)] + [F.sum(F.get("q_common", i)).alias(f"w{i}") for i in range(len(ALL_COMMON))]
    found = rows.groupBy("lang").agg(F.sum(F.size("q_words")).alias("n"), *sums).where((F.col("n") > 0) & (known | (F.col("n") >= least_words))).collect()
    chars = {r["lang"]: [r[f"c{i}"] for i in range(len(CLASSES) + 3)] for r in found}
    counted = {r["lang"]: [(w, r[f"w{ALL_COMMON.index(w)}"]) for w in COMMON_WORDS[r["lang"]]] for r in found if r["lang"] in COMMON_WORDS}
    others = [lang for lang in chars if lang not in COMMON_WORDS]
    if others:
        words = _with_words(docs.select("lang", "text").where(F.col("lang").isin(others))).select("lang", F.explode("q_words").alias("w"))
        order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "w")
        top = words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).withColumn("i", F.row_number().over(order)).where(F.col("i") <= most_common)
        for r in sorted(top.collect(), key=lambda r: r["i"]):
            counted.setdefault(r["lang"], []).append((r["w"], r["n"]))
    return {r["lang"]: (chars[r["lang"]], [n for _, n in counted[r["lang"]]], r["n"], [w for w, _ in counted[r["lang"]]]) for r in found}


def _shares(counts: list[int]) -> Column:
    total = sum(counts)
    return F.array(*[F.lit(c / total) for c in counts])


def js_distance(counts: Column, total: Column, shares: Column) -> Column:
    """The Jensen-Shannon distance (base 2) of counts, which sum to total > 0, to a reference's shares."""

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(F.transform(counts, lambda c: c / total), shares, lambda p, q: term(p, q) + term(q, p))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def _own_reference(references: dict) -> Column:
    """The reference of a row's lang where that is none of COMMON_WORDS: a struct of chars, words (shares) and common; else null."""
    entries = []
    for lang, (char_counts, common_counts, n, common) in sorted(references.items()):
        if lang not in COMMON_WORDS:
            parts = _shares(char_counts).alias("chars"), _shares([*common_counts, n - sum(common_counts)]).alias("words"), F.array(*map(F.lit, common)).alias("common")
            entries += [F.lit(lang), F.struct(*parts)]
    return F.try_element_at(F.create_map(*entries), F.coalesce("lang", F.lit(""))) if entries else None


def quality_rules(
    docs: DataFrame,
    references: dict | None = None,
    char_distance: float = 0.32,
    word_distance: float = 0.28,
    least_words: int = 20,
    least_words_for_words: int = 150,
    repeat_percent: int = 30,
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars, js_words, kept.

    docs needs text, and lang if no references are given; other columns stay (a column with one of these
    names is replaced). A null text counts as empty: no words, base_failed. base_failed: fewer than least_words words,
    or more than repeat_percent percent of them in 8-word windows found twice or more. kept is false for base_failed,
    for a distance of character classes above char_distance, and, from least_words_for_words words, for a distance of
    common words above word_distance; in each case to the nearest of COMMON_WORDS' languages and the document's own. Where lang is null or
    has no reference only base_failed rejects, and the distances are null. Repeated rows are judged alike. No rows give no rows.

    references: see language_references(), which is called on docs if they are not given: two passes over docs, and one
    more over those in languages other than COMMON_WORDS'. If they are given without a column lang, all are of COMMON_WORDS' languages.
    """
    references = language_references(docs) if references is None else references
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", "kept"]
    # The caller's columns go under numbers, so that none clashes with the columns used here.
    stay = [c for c in docs.columns if c.lower() not in names]
    kept_columns = [f"q_stay_{i}" for i in range(len(stay))]
    used = ["text", "lang"] if "lang" in docs.columns else ["text"]
    rows = _with_histograms(_with_words(docs.select(*[docs[f"`{c}`"].alias(k) for c, k in zip(stay, kept_columns)], *used)))
    own = _own_reference(references)
    if own is not None:
        # Counted only where there is such a reference: its common words, then the rest.
        common = F.transform(own["common"], lambda w: F.size(F.filter("q_words", lambda x: x == w)).cast("long"))
        rows = rows.withColumn("q_own", own).withColumn("q_own_words", F.when(own.isNotNull(), F.concat(common, F.array(F.size("q_words") - F.aggregate(common, F.lit(0).cast("long"), lambda a, x: a + x)))))
    held = ["q_own", "q_own_words"] if own is not None else []
    lines = F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("q_lines", lines).select(
        *kept_columns,
        *used[1:],
        *held,
        "q_chars",
        "q_common",
        F.size("q_words").cast("long").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.get("q_classes", list(CLASSES).index("symbol")).alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("q_words")).alias("n_repeat_words"),
    )
    chars = F.aggregate("q_chars", F.lit(0).cast("long"), lambda a, x: a + x)
    by_char, by_word = [F.lit(2.0)], [F.lit(2.0)]
    for lang, (char_counts, common_counts, n, common) in sorted(references.items()):
        if lang in COMMON_WORDS:
            counts = [F.get("q_common", F.lit(ALL_COMMON.index(w))) for w in common]
            by_char.append(js_distance(F.col("q_chars"), chars, _shares(char_counts)))
            by_word.append(js_distance(F.array(*counts, F.col("n_words") - sum(counts[1:], counts[0])), F.col("n_words"), _shares([*common_counts, n - sum(common_counts)])))
    if own is not None:
        by_char.append(F.when(F.col("q_own").isNotNull(), js_distance(F.col("q_chars"), chars, F.col("q_own")["chars"])))
        by_word.append(F.when(F.col("q_own").isNotNull(), js_distance(F.col("q_own_words"), F.col("n_words"), F.col("q_own")["words"])))
    some = (F.col("n_words") > 0) & (F.coalesce(F.col("lang").isin(list(references)), F.lit(False)) if "lang" in docs.columns else F.lit(bool(references)))
    rows = rows.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    rows = rows.withColumn("js_chars", F.when(some, F.least(*by_char, F.lit(2.0)))).withColumn("js_words", F.when(some, F.least(*by_word, F.lit(2.0))))
    far = (F.col("js_chars") > char_distance) | ((F.col("n_words") >= least_words_for_words) & (F.col("js_words") > word_distance))
    # The row number, never negative, keeps the optimizer from moving a filter on kept below the projections, where each use of a
    # text's words would split the text again.
    verdict = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)) & (F.monotonically_increasing_id() >= 0)
    return rows.withColumn("kept", verdict).select(*[F.col(k).alias(c) for c, k in zip(stay, kept_columns)], *names)

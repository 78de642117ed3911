"""Quality rules: counts over the whole text, and divergence from the language's references.

Character classes and common words of a document are histograms; so are those of all
documents of its language that pass the base rules and are long enough (integer sums, one
row per language). A document whose Jensen-Shannon distance from either reference is
larger than its threshold fails. Both are compared from `MIN_WORDS` words on; the threshold
of common words is larger below `FULL_WORDS`, by what chance adds there. Common words are
compared in languages with a word list only, character classes in all: a null or rare
language (fewer than `MIN_DOCUMENTS`, no word list) has the reference of all documents.
DataFrame functions only: every count is an expression on the row's own text, so nothing is
exploded or shuffled but the references.

Repeated words are found by sorting 64-bit hashes of the three-word windows.

Defined results: null and empty texts have zero of everything and fail (fewer than 50
words); where no document passes the base rules there is no reference;
repeated rows are judged alike; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import NOT_SPACES, SPACES, let, stored, total, whole_text

MIN_WORDS = 50
#: Chance adds about CHANCE / n to the squared distance of a word histogram of n words, with
#: CHANCE = (13 bins - 1) / (8 ln 2); what this is more than at FULL_WORDS is allowed.
FULL_WORDS, CHANCE = 100, 2.164
#: Languages without a word list have a reference of their own from so many documents on.
MIN_DOCUMENTS = 100
#: Largest accepted Jensen-Shannon distances (0 to 1, logarithms to base 2).
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.30
#: With more different repeated windows than this, windows are sorted instead of looked up.
FEW_WINDOWS = 32

#: Fixed: the most common words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "auf", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
}
CLASSES = ["small", "capital", "digit", "space", "mark", "symbol", "other"]


def _kept_length(text: Column, members: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{members}]+", ""))


def _counts(lang: Column, words: Column) -> Column:
    """How often each common word of the row's language occurs, the rest last; null without a list."""
    spelled = sorted({form for listed in COMMON_WORDS.values() for w in listed for form in (w, w.capitalize())})

    def count(hits: Column, word: str) -> Column:
        return F.size(F.filter(hits, lambda h: (h == word) | (h == word.capitalize())))

    chosen = F.lit(None).cast("array<int>")
    for name, listed in COMMON_WORDS.items():
        hits = F.filter(words, lambda w: w.isin(spelled))
        counts = let(hits, partial(lambda listed, hits: F.array(*[count(hits, w) for w in listed]), listed))
        chosen = F.when(lang == name, counts).otherwise(chosen)
    return chosen


def _covered(places: Column) -> Column:
    """Words covered by three-word windows that start at the ascending `places`."""
    return F.when(F.size(places) == 0, 0).otherwise(
        F.aggregate(
            F.transform(places, lambda p, i: F.when(i == 0, 3).otherwise(
                F.least(F.lit(3), p - places[F.greatest(i - 1, F.lit(0))])
            )),
            F.lit(0), lambda a, x: a + x,
        )
    )


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice."""
    def of_windows(windows: Column) -> Column:
        def of_sorted(ordered: Column) -> Column:
            twice = F.array_distinct(F.filter(
                ordered, lambda h, i: (i > 0) & (h == ordered[F.greatest(i - 1, F.lit(0))])
            ))

            def places(repeated: Column) -> Column:
                looked_up = F.filter(
                    F.transform(windows, lambda h, i: F.when(F.array_contains(repeated, h), i)),
                    lambda p: p.isNotNull(),
                )
                pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
                by_order = let(pairs, lambda s: F.sort_array(F.transform(
                    F.filter(
                        F.transform(s, lambda x, i: F.struct(
                            x["i"].alias("i"),
                            (((i > 0) & (x["h"] == s[F.greatest(i - 1, F.lit(0))]["h"]))
                             | ((i < F.size(s) - 1) & (x["h"] == s[F.least(i + 1, F.size(s) - 1)]["h"]))).alias("again"),
                        )),
                        lambda x: x["again"],
                    ),
                    lambda x: x["i"],
                )))
                found = F.when(F.size(repeated) == 0, F.array().cast("array<int>")).when(
                    F.size(repeated) <= FEW_WINDOWS, looked_up
                ).otherwise(by_order)
                return let(found, _covered)

            return let(twice, places)

        return let(F.sort_array(windows), of_sorted)

    windows = F.when(F.size(words) < 3, F.array().cast("array<long>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))),
            lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]),
        )
    )
    return let(windows, of_windows)


def measure(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    `classes` (characters by class) and `common` (occurrences of the common words, rest last)."""
    text = whole_text()

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            _counts(F.col("lang"), words).alias("hits"),
        )

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    measured = rows.select(
        "doc_id", "lang",
        let(F.array_remove(F.split("text", SPACES + "+", -1), ""), of_words).alias("m"),
        F.length("text").cast("long").alias("n_chars"),
        _kept_length(F.col("text"), r"#*$%&|<>").cast("long").alias("n_symbols"),
        let(F.filter(F.split("text", "\n", -1), lambda line: line.rlike(NOT_SPACES)), of_lines).alias("n_dup_lines"),
        _kept_length(F.col("text"), "A-Z").cast("long").alias("capital"),
        _kept_length(F.col("text"), "0-9").cast("long").alias("digit"),
        _kept_length(F.col("text"), r"-.,;:!?'\"()").cast("long").alias("mark"),
        _kept_length(F.col("text"), r"a-z").cast("long").alias("small"),
    )
    space = F.col("n_chars") - F.col("m.word_chars")
    named = [F.col("small"), F.col("capital"), F.col("digit"), space, F.col("mark"), F.col("n_symbols")]
    return measured.select(
        "doc_id", "lang", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words",
        F.array(*named, F.col("n_chars") - total(named)).alias("classes"),
        F.when(F.col("m.hits").isNotNull(), F.concat(
            F.transform("m.hits", lambda x: x.cast("long")),
            F.array(F.col("m.n_words") - F.aggregate("m.hits", F.lit(0).cast("long"), lambda a, x: a + x)),
        )).alias("common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _distance(counts: Column, shares: list[Column]) -> Column:
    """Jensen-Shannon distance of a histogram from a reference; null if it is empty or there is none."""
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    pieces = []
    for i, q in enumerate(shares):
        p = counts[i] / n
        m = (p + q) / 2
        pieces.append((part(p, m) + part(q, m)) / 2)
    return F.when((n > 0) & shares[0].isNotNull(), F.sqrt(F.greatest(total(pieces), F.lit(0.0))))


def word_references(measured: DataFrame) -> dict[str, list[int]]:
    """Word histogram of each listed language: at most one row per word list."""
    size = len(next(iter(COMMON_WORDS.values()))) + 1
    sums = [F.sum(F.col("common")[i]).alias(str(i)) for i in range(size)]
    rows = measured.where(~base_failed() & F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(*sums)
    return {r["lang"]: [r[str(i)] or 0 for i in range(size)] for r in rows.collect()}


def class_references(measured: DataFrame) -> tuple[DataFrame, list[int]]:
    """lang, `reference` (class histogram) of the languages with one of their own, and that of all."""
    names = [f"c{i}" for i in range(len(CLASSES))]
    sums = [F.sum(F.col("classes")[i]).alias(c) for i, c in enumerate(names)]
    by_lang = stored(
        measured.where(~base_failed()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums), "class-references"
    )
    everything = by_lang.agg(*[F.sum(c).alias(c) for c in names]).first()
    own = by_lang.where(F.col("lang").isin(list(COMMON_WORDS)) | (F.col("n") >= MIN_DOCUMENTS))
    return own.where("lang is not null").select("lang", F.array(*names).alias("reference")), [everything[c] or 0 for c in names]


def judge(docs: DataFrame) -> DataFrame:
    """Per document the counts, base_failed, class_distance, word_distance and kept."""
    measured = stored(measure(docs), "text-counts")
    by_word = F.lit(None).cast("double")
    for lang, common in word_references(measured).items():
        shares = [F.lit(x / sum(common) if sum(common) else None).cast("double") for x in common]
        by_word = F.when(F.col("lang") == lang, _distance(F.col("common"), shares)).otherwise(by_word)
    own, everything = class_references(measured)
    measured = measured.join(F.broadcast(own), "lang", "left").withColumn(
        "reference", F.coalesce("reference", F.array(*[F.lit(x).cast("long") for x in everything]))
    )
    whole = F.aggregate("reference", F.lit(0).cast("long"), lambda a, x: a + x)
    by_class = _distance(
        F.col("classes"), [F.when(whole > 0, F.col("reference")[i] / whole) for i in range(len(CLASSES))]
    )
    guarded = F.col("n_words") >= MIN_WORDS
    judged = measured.withColumns({
        "base_failed": base_failed(),
        "class_distance": F.when(guarded, by_class),
        "word_distance": F.when(guarded, by_word),
    })
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (
        F.coalesce("word_distance", F.lit(0.0)) > F.sqrt(MAX_WORD_DISTANCE ** 2 + CHANCE * (
            1 / F.greatest(F.least("n_words", F.lit(FULL_WORDS)), F.lit(1)) - 1 / FULL_WORDS
        ))
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance",
    )

"""Quality rules: counts of a text, and its divergence from its language's references.

Two histograms describe a text: its characters by class (capitals, digits, white space,
punctuation, symbols, the rest) and its words (the short words with the largest shares in
most texts of the language, one bin each, and all other words). The references are the mean of the same
histograms over the different texts of the language that pass the base rules and are not
odd themselves. A text is rejected when the Jensen-Shannon distance (base 2, 0 to 1) of
either histogram exceeds its bound and the text is long enough for the distance to mean
something.

Built-in functions only. The counts of a text are worked out once and stored; references
and verdicts both come from these. What is shuffled are the short words of each different
text, by its digest, and counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usageweave.llm.shared import SPACE, count_of, stored, words

SYMBOLS = r"[#*$%&|<>]"
#: Character classes with a pattern each; characters of none make up the last bin.
CLASSES = {
    "capitals": r"\p{Lu}",
    "digits": r"\p{Nd}",
    "spaces": SPACE,
    "punctuation": r"[.,;:!?'\"()\[\]{}\-]",
    "symbols": SYMBOLS,
}


@dataclass(frozen=True)
class QualityOptions:
    """Base rules, and bounds of the divergence rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: Common words a language reference has.
    common_words: int = 16
    #: Only words of at most so many characters can be common words.
    short_word: int = 4
    max_class_distance: float = 0.28
    #: A histogram of n words is off by chance by about 1 / sqrt(n): the bound of the word
    #: distance is ``max_word_distance + word_noise / sqrt(n)``.
    max_word_distance: float = 0.16
    word_noise: float = 1.4
    #: Texts under these sizes are not judged by the distance.
    min_class_chars: int = 200
    min_word_words: int = 50


#: What stands between characters of the classes other than white space.
_UNMARKED = r"[^\p{Lu}\p{Nd}.,;:!?'\"()\[\]{}\-#*$%&|<>]+"


def marked(text: Column) -> Column:
    """``text`` with nothing left but characters of the classes other than white space."""
    return F.regexp_replace(text, _UNMARKED, "")


def class_counts(text: Column, marks: Column) -> list[Column]:
    """Characters of ``text`` by class, the rest last. ``marks`` is its :func:`marked`, so that
    each class is looked for in little text; white space is what taking it out takes away.
    """
    solid = text
    for c in " \t\n\x0b\x0c\r":
        solid = F.replace(solid, F.lit(c), F.lit(""))
    spaces = (F.octet_length(text) - F.octet_length(solid)).cast("long")
    found = [spaces if k == "spaces" else count_of(marks, p) for k, p in CLASSES.items()]
    rest = F.length(text).cast("long")
    for c in found:
        rest = rest - c
    return [*found, rest]


#: Shares are summed as whole numbers of this size, so that order does not matter.
_UNIT = 1_000_000_000


def _units(count: Column, total: Column) -> Column:
    return F.round(F.lit(_UNIT) * count / total).cast("long")


def _short_counts(words: str) -> tuple[str, str]:
    """SQL of the different ones of the sorted ``words``, and of where each begins, with the
    number of words behind: their differences are how often each is there.
    """
    new = f"filter(sequence(0, size({words})), i -> i = 0 OR i = size({words}) OR"
    return f"array_distinct({words})", f"{new} {words}[i] <> {words}[i - 1])"


def _held(q: Column, listed: Column) -> Column:
    """How often each of the words ``listed`` is among the short ones of ``q``."""

    def held(w: Column) -> Column:
        def between(at: Column) -> Column:
            n = F.get(q["starts"], at) - F.get(q["starts"], at - 1)
            return F.when(at > 0, n).otherwise(0).cast("long")

        return F.transform(F.array(F.array_position(q["short"], w).cast("int")), between)[0]

    return F.transform(listed, held)


def _with_word_bins(df: DataFrame, q: Column, name: str) -> DataFrame:
    """``df`` with how often each of its ``ref_words`` is in a text, and all other words last.
    The words of a text are looked at once.
    """
    df = df.select("*", _once(_held(q, F.col("ref_words"))).alias("_common"))
    common = F.col("_common")
    rest = q["n_words"] - F.aggregate(common, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(name, F.concat(common, F.array(rest))).drop("_common")


def _in_units(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: _units(x, total))


def _of_lang(df: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
    """``df`` joined with ``other`` on lang, where null is a language of its own."""
    other = other.withColumnRenamed("lang", "of_lang")
    return df.join(other, F.expr("lang <=> of_lang"), how).drop("of_lang")


def _lower_medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, units): the lower median of ``units`` by ``keys``, in steps of 10,000."""
    each = values.groupBy(*keys, F.expr("units div 10000 AS step")).agg(F.count("*").alias("texts"))
    whole = Window.partitionBy(*keys)
    each = each.select(
        *keys,
        "step",
        F.sum("texts").over(whole.orderBy("step")).alias("upto"),
        F.sum("texts").over(whole).alias("all"),
    )
    middle = each.where("2 * upto >= all").groupBy(*keys)
    return middle.agg((F.min("step") * 10000).alias("units"))


def _common_words(texts: DataFrame, options: QualityOptions) -> DataFrame:
    """(lang, ref_words): the short words with the largest median shares in a language's texts.

    A word with a median over 0 is in more than half of the texts, so only those are counted.
    """
    held = (
        texts.select("lang", F.explode("q.short").alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("texts"))
    )
    all_ = texts.groupBy("lang").agg(F.count("*").alias("all"))
    most = _of_lang(held, all_, "inner").where("2 * texts > all")
    most = stored(most.groupBy("lang").agg(F.collect_list("word").alias("most")), "quality-held")
    n_held = _held(F.col("q"), F.col("most")).alias("n")
    counted = _of_lang(texts, most, "inner").select(
        "lang",
        "q.n_words",
        F.explode(F.arrays_zip(F.col("most").alias("word"), n_held)).alias("of"),
    )
    shares = counted.select("lang", "of.word", _units(F.col("of.n"), F.col("n_words")).alias("units"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("units"), "word"))
    return (
        _lower_medians(shares, ["lang", "word"])
        .withColumn("place", rank)
        .where((F.col("place") <= options.common_words) & (F.col("units") > 0))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "word")))["word"].alias("ref_words"))
    )


def _medians(texts: DataFrame, n_bins: int) -> DataFrame:
    """(lang, middle): the lower median of each of the ``bins`` over a language's texts."""
    each = texts.select("lang", F.posexplode("bins").alias("bin", "units"))
    middle = _lower_medians(each, ["lang", "bin"])
    found = F.map_from_entries(F.collect_list(F.struct("bin", "units")))
    bins = [F.coalesce(F.col("found")[i], F.lit(0).cast("long")) for i in range(n_bins)]
    by_lang = middle.groupBy("lang").agg(found.alias("found"))
    return by_lang.select("lang", F.array(*bins).alias("middle"))


def _word_bound(n_words: Column, options: QualityOptions) -> Column:
    return F.lit(options.max_word_distance) + F.lit(options.word_noise) / F.sqrt(n_words)


def references(docs: DataFrame, options: QualityOptions = QualityOptions()) -> DataFrame:
    """(lang, ref_classes, ref_words, ref_word_counts) of the ordinary texts of ``docs``.

    Each different text that passes the base rules counts once and by its shares, however
    long it is. Texts out of bounds of their language's medians (all of them stay if none
    is within) are left out, so near copies of one odd text do not become the reference
    while they are the smaller part. ``ref_words`` are the short words with the largest median
    shares, ties by spelling, and ``ref_word_counts`` their shares with all other words
    last. Null is a language of its own. Without such texts a language has no row.
    """
    return _references(measured(docs.select("lang", "text"), [], options), options)


def _references(found: DataFrame, options: QualityOptions) -> DataFrame:
    """:func:`references` from what :func:`measured` gives."""
    q = F.col("_quality")
    # Words are dealt out as one string, which has no word with a space.
    joined = F.array_join(q.short, " ").alias("short")
    narrow = F.struct(
        q.n_words.alias("n_words"), q.classes.alias("classes"), joined, q.starts.alias("starts")
    )
    once = (
        found.where(~q.base_failed)
        .select("lang", "digest", narrow.alias("q"))
        .groupBy("lang", "digest")
        .agg(F.first("q").alias("q"))
    )
    short = F.filter(F.split("q.short", " "), lambda w: w != "")
    texts = stored(once.select("lang", F.col("q").withField("short", short).alias("q")), "quality-texts")
    ref_words = stored(_common_words(texts, options), "quality-words")
    none = F.array().cast("array<string>")
    texts = _of_lang(texts, ref_words).withColumn("ref_words", F.coalesce("ref_words", none))
    n, n_words = len(CLASSES) + 1, options.common_words + 1
    # A language with fewer common words has empty bins in front of the last.
    texts = _with_word_bins(texts, F.col("q"), "own")
    own = F.col("own")
    empty = F.array_repeat(F.lit(0).cast("long"), options.common_words - F.size("ref_words"))
    counted = texts.select(
        "lang",
        "q.n_words",
        F.col("q.classes").alias("classes"),
        F.concat(F.slice(own, 1, F.size(own) - 1), empty, F.slice(own, -1, 1)).alias("words"),
    )
    both = F.concat(_in_units(F.col("classes")), _in_units(F.col("words")))
    counted = counted.withColumn("bins", both)
    counted = stored(counted, "quality-bins")
    df = _of_lang(counted, stored(_medians(counted, n + n_words), "quality-medians"))
    far = distance(F.col("classes"), F.slice("middle", 1, n)) > options.max_class_distance
    word_distance = distance(F.col("words"), F.slice("middle", n + 1, n_words))
    far_words = word_distance > _word_bound(F.col("n_words"), options)
    odd = F.coalesce(far, F.lit(False)) | F.coalesce(far_words, F.lit(False))
    df = stored(df.select("lang", "bins", odd.alias("odd")), "quality-ordinary")
    some = df.groupBy("lang").agg(F.min("odd").alias("all_odd"))
    df = _of_lang(df, some).where("all_odd OR NOT odd")
    sums = F.array(*[F.sum(F.col("bins")[i]) for i in range(n + n_words)])
    totals = _of_lang(df.groupBy("lang").agg(sums.alias("sums")), ref_words)
    return totals.select(
        "lang",
        F.slice("sums", 1, n).alias("ref_classes"),
        F.coalesce("ref_words", none).alias("ref_words"),
        F.concat(
            F.slice("sums", F.lit(n + 1), F.coalesce(F.size("ref_words"), F.lit(0))),
            F.slice("sums", -1, 1),
        ).alias("ref_word_counts"),
    )


def _once(value: Column) -> Column:
    """``value`` behind an explode, so that no filter or projection above copies it."""
    return F.explode(F.array(value))


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null if one is empty."""

    def total(h: Column) -> Column:
        return F.aggregate(h, F.lit(0.0), lambda a, x: a + x.cast("double"))

    def term(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def of(s: Column) -> Column:
        def both(x: Column, y: Column) -> Column:
            p, q = x / s["a"], y / s["b"]
            return (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2

        parts = F.zip_with(s["left"], s["right"], both)
        far = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return F.when((s["a"] > 0) & (s["b"] > 0), F.sqrt(F.greatest(F.lit(0.0), far)))

    # Totals are bound to the lambda's argument, once for each pair of histograms.
    bound = F.struct(
        left.alias("left"), right.alias("right"), total(left).alias("a"), total(right).alias("b")
    )
    return F.transform(F.array(bound), of)[0]


#: Hashes of 3-word windows.
_WINDOWS = """
CASE WHEN n_words >= 3 THEN transform(sequence(0, CAST(n_words AS INT) - 3), i ->
  xxhash64(words[i], words[i + 1], words[i + 2]))
ELSE CAST(array() AS ARRAY<BIGINT>) END
"""
#: Where hashes repeat, starts of windows as numbers that sort by hash, then by start.
_CODES = """
CASE WHEN size(array_distinct(windows)) < size(windows) THEN
  sort_array(transform(windows, (x, i) -> pmod(x, 9223372036854775807L div n_words) * n_words + i))
ELSE CAST(array() AS ARRAY<BIGINT>) END
"""


def _same(other: str) -> str:
    """Whether ``x`` and its neighbour ``other`` are windows of the same words."""
    at, to = "CAST(x % n_words AS INT)", f"CAST({other} % n_words AS INT)"
    pairs = [f"words[{at} + {k}] = words[{to} + {k}]" for k in range(3)]
    return " AND ".join([f"{other} div n_words = x div n_words", *pairs])


_REPEATED = f"""
sort_array(transform(filter(codes, (x, i) ->
  (i > 0 AND {_same("codes[i - 1]")})
  OR (i < n_words - 3 AND {_same("codes[i + 1]")})), x -> x % n_words))
"""

#: Words covered by windows of three that start at the sorted places ``repeated``.
_COVERED = """
aggregate(repeated, named_struct('upto', 0L, 'n', 0L), (a, x) -> named_struct(
  'upto', x + 3, 'n', a.n + x + 3 - greatest(a.upto, x)), a -> a.n)
"""


def features(
    docs: DataFrame, columns: list[str], options: QualityOptions = QualityOptions()
) -> DataFrame:
    """(_row, lang, digest, _quality) for each of ``docs``: a struct of its ``columns``, its
    language, a digest of its text, and the counts of its text with the base verdict.

    Null and empty texts count as texts without words, which fail the base rules.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    keep = F.struct(F.lit(0).alias("none"), *[F.col(c) for c in columns]).alias("_row")
    df = docs.select(keep, F.unhex(F.md5(text)).alias("digest"), text.alias("text"), F.col("lang").alias("lang"))
    df = df.withColumn("marks", marked(F.col("text")))
    df = df.withColumns(
        {
            "words": words(F.col("text")),
            "lines": lines,
            "classes": F.array(*class_counts(F.col("text"), F.col("marks"))),
        }
    ).withColumn("n_words", F.size("words").cast("long"))
    lowered = F.transform("words", F.lower)
    short = F.filter(lowered, lambda w: F.length(w) <= options.short_word)
    df = df.withColumn("sorted", F.sort_array(short))
    df = df.withColumn("windows", F.expr(_WINDOWS)).withColumn("codes", F.expr(_CODES))
    df = df.withColumn("repeated", F.expr(_REPEATED))
    spaces = list(CLASSES).index("spaces")
    symbols = list(CLASSES).index("symbols")
    different, starts = _short_counts("sorted")
    counts = {
        "n_words": F.col("n_words"),
        "word_chars": F.length("text").cast("long") - F.col("classes")[spaces],
        "n_symbols": F.col("classes")[symbols],
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.expr(_COVERED),
        "classes": F.col("classes"),
        "short": F.expr(different),
        "starts": F.expr(starts),
    }
    counted = F.struct(*[c.alias(k) for k, c in counts.items()])
    df = df.select("_row", "lang", "digest", _once(counted).alias("_quality"))
    q = F.col("_quality")
    failed = (q.n_words < options.min_words) | (
        100 * q.n_repeat_words > options.max_repeat_percent * q.n_words
    )
    return df.withColumn("_quality", q.withField("base_failed", failed))


def measured(
    docs: DataFrame, columns: list[str], options: QualityOptions = QualityOptions()
) -> DataFrame:
    """:func:`features` of ``docs``, stored: texts are looked at once, however often their
    counts are used.
    """
    return stored(features(docs, columns, options), "quality-features")


def judge(
    docs: DataFrame,
    refs: DataFrame | None = None,
    options: QualityOptions = QualityOptions(),
    columns: list[str] | None = None,
) -> DataFrame:
    """The ``columns`` of ``docs`` (all by default) with ``quality``, a struct of the counts,
    ``base_failed``, both distances (null where there is nothing to compare) and the verdict
    ``kept``.

    ``refs`` are :func:`references`, by default those of ``docs`` themselves. A document
    whose language has no reference is judged by the base rules alone. Every row of
    ``docs`` comes back once, repeated rows and null keys included; a column that is called
    ``quality`` is replaced. Null texts count as empty ones, which fail the base rules; very
    long ones are judged whole.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c != "quality"]
    found = measured(docs, columns, options)
    refs = _references(found, options) if refs is None else refs
    df = _of_lang(found, stored(refs, "quality-references"))
    q = F.col("_quality")
    df = _with_word_bins(df, q, "word_bins")
    df = df.withColumns(
        {
            "class_distance": distance(q.classes, F.col("ref_classes")),
            "word_distance": distance(F.col("word_bins"), F.col("ref_word_counts")),
        }
    )
    odd_chars = (F.col("class_distance") > options.max_class_distance) & (
        q.word_chars >= options.min_class_chars
    )
    odd_words = (F.col("word_distance") > _word_bound(q.n_words, options)) & (
        q.n_words >= options.min_word_words
    )
    odd = F.coalesce(odd_chars, F.lit(False)) | F.coalesce(odd_words, F.lit(False))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    quality = F.struct(
        *[q[n].alias(n) for n in [*names, "base_failed"]],
        (~q.base_failed & ~odd).alias("kept"),
        "class_distance",
        "word_distance",
    )
    return df.select(*[F.col("_row")[c].alias(c) for c in columns], quality.alias("quality"))

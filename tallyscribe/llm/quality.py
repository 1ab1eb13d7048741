"""Quality rules: a table of thresholds compiled into one Spark projection, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscribe.llm.frames import pick

WINDOW = 5

# The most frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "be", "by", "as", "are", "this", "or", "an",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "nicht", "ein", "dem", "eine", "ist",
    "le", "la", "les", "et", "de", "un", "une", "du", "que", "est", "pour", "qui", "dans", "sur", "pas", "au", "par",
    "el", "los", "las", "y", "en", "del", "se", "por", "con", "no", "su", "para", "al", "lo", "es",
)


@dataclass(frozen=True)
class Rule:
    """A text fails if ``scale * measure`` is beyond ``limit * per``; ``least_words``: only texts of so many words."""

    name: str
    measure: str
    op: str
    limit: int
    per: str | None = None
    scale: int = 1
    least_words: int = 0

    def sql(self) -> str:
        """The condition of failure, as SQL that every engine reads."""
        bound = f"{self.limit} * {self.per}" if self.per else str(self.limit)
        test = f"{self.scale} * {self.measure} {self.op} {bound}"
        return f"({test} AND n_words >= {self.least_words})" if self.least_words else f"({test})"


#: The first two are the base; the others are the method's own verdict. All arithmetic is on whole numbers.
BASE_RULES = (
    Rule("too_few_words", "n_words", "<", 10),
    Rule("repeated_windows", "n_repeat_words", ">", 20, per="n_words", scale=100),
)
RULES = (
    Rule("too_many_words", "n_words", ">", 1_000_000),
    Rule("short_words", "word_chars", "<", 2, per="n_words"),
    Rule("long_words", "word_chars", ">", 15, per="n_words"),
    Rule("symbols", "n_symbols", ">", 10, per="n_words", scale=100),
    Rule("exclamations", "n_exclaims", ">", 30, per="n_words", scale=100),
    Rule("repeated_lines", "n_dup_lines", ">", 50, per="n_lines", scale=100),
    Rule("no_stop_words", "n_stop_words", "<", 1, least_words=60),
)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: a lambda parameter is evaluated once, an inlined column each time it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, n: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words which occurs twice or more in the text."""

    def covered(grams: Column) -> Column:
        """Sort (window, place); places next to an equal window are repeats; each covers up to the next one's start."""
        tagged = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            def again(x: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(s, k - 1)["g"] == x["g"])
                after = F.get(s, k + 1)["g"] == x["g"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))

        def total(starts: Column) -> Column:
            step = lambda k: F.coalesce(F.get(starts, k + 1) - F.get(starts, k), F.lit(window))
            gaps = F.transform(starts, lambda _, k: F.least(step(k), F.lit(window)))
            return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

        return _let(_let(tagged, places), total)

    def of(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - window)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = _let(hashes, of)
    count = _let(
        grams,
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(covered(g)),
    )
    return F.when(n < window, F.lit(0).cast("bigint")).otherwise(count)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``doc_id`` and the whole-number measures that rules can use, one row per input row."""
    rows = pick(docs, id_col, text_col)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = rows.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    stops = F.filter("words", lambda w: F.lower(w).isin(list(stop_words)))
    return cut.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit("!")).cast("bigint").alias("n_exclaims"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(stops).cast("bigint").alias("n_stop_words"),
        _repeat_words(F.col("words"), n).alias("n_repeat_words"),
    )


def _any(rules: Sequence[Rule]) -> Column:
    return reduce(lambda a, b: a | b, [F.expr(r.sql()) for r in rules], F.lit(False))


def apply_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: Sequence[Rule] = BASE_RULES,
    rules: Sequence[Rule] = RULES,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Measures, ``base_failed``, ``failed`` (the names of all rules broken, in table order) and ``kept`` per input row.

    Words are runs of anything but ASCII white space. Null and empty text have no words and one empty line without a
    word: all measures are 0 and ``too_few_words`` fails. Repeated rows are judged one by one, null ids too; an empty
    table gives no rows. Nothing moves between tasks.
    """
    found = measures(docs, id_col, text_col, stop_words)
    names = F.filter(F.array(*[F.when(F.expr(r.sql()), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull())
    return found.select("*", _any(base).alias("base_failed"), (~_any((*base, *rules))).alias("kept"), names.alias("failed"))

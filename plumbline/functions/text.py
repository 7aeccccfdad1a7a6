"""Text functions, all native columns: words, shingles, retrieval words, sentences, exact facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.binding import let

WORD = r"[\p{L}\p{N}_]+"
RUN = r"[\p{L}\p{N}\p{M}]+"
DIGITS = r"\p{Nd}+"
EDGE_SPACE = r"(?U)^\s+|\s+$"
SENTENCE_BREAK = r"(?U)\n|(?<=[.!?])\s+|(?<=[。！？])"
PARAGRAPH_BREAK = r"(?U)\n\s*\n"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def words(c: Column) -> Column:
    return _all(F.lower(c), WORD)


def norm(c: Column) -> Column:
    """Lower-cased word runs joined by single spaces."""
    return F.array_join(words(c), " ")


def shingles(word_array: Column, n: int) -> Column:
    """Runs of `n` neighbouring words, each as an array; empty when there are fewer than `n` words."""
    count = F.size(word_array)
    return F.when(count >= n, F.transform(F.sequence(F.lit(1), count - (n - 1)),
                                          lambda i: F.slice(word_array, i, n))
                  ).otherwise(F.array().cast("array<array<string>>"))


def fingerprints(word_array: Column, n: int) -> Column:
    """64-bit hashes of the distinct `n`-word shingles: a tenth of the text's size, and primitive values keep
    `array_distinct` linear (arrays of structs or binaries are compared pairwise)."""
    return let(word_array, lambda w: F.array_distinct(F.transform(shingles(w, n), lambda g: F.xxhash64(g))))


def no_space(c: Column) -> Column:
    return c.rlike(fixed.NO_SPACE_CLASS)


def retrieval_words(c: Column) -> Column:
    """Words for ranking: stop words dropped, plain plurals cut, character pairs for scripts without spaces. Whether there is such a script is
    asked once a text, and of its words only where there is."""
    stop = F.array(*[F.lit(w) for w in fixed.STOP_WORDS])

    def pairs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 1)),
                           lambda i: F.substring(w, i, F.lit(2)))

    def singular(w: Column) -> Column:
        plural = (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss")
        return F.when(plural, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    def one(w: Column) -> Column:
        return (F.when(no_space(w), pairs(w))
                .when(F.array_contains(stop, w), F.array().cast("array<string>"))
                .otherwise(F.array(singular(w))))

    def of(t: Column) -> Column:
        kept = F.filter(_all(t, RUN), lambda w: ~w.isin(fixed.STOP_WORDS))
        return F.when(no_space(t), F.flatten(F.transform(_all(t, RUN), one))).otherwise(F.transform(kept, singular))

    return let(F.lower(c), of)


def rough_words(c: Column) -> Column:
    """Word count; text written without spaces counts one word per two characters."""
    spaced = F.regexp_count(c, F.lit(r"(?U)\S+"))
    return F.when(no_space(c), F.greatest(spaced, F.floor(F.length(c) / 2).cast("int"))).otherwise(spaced)


def sentences(c: Column) -> Column:
    """Sentences and list lines in order, trimmed, without empties."""
    return F.filter(F.transform(F.split(c, SENTENCE_BREAK), strip), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, PARAGRAPH_BREAK), strip), lambda s: s != "")


def digit_runs(c: Column) -> Column:
    return _all(c, DIGITS)


def keeps_numbers(source: Column, target: Column) -> Column:
    """True when each digit run of `source` also occurs in `target`."""
    return F.size(F.array_except(digit_runs(source), digit_runs(target))) == 0


def exact_facts(c: Column) -> Column:
    """Distinct e-mail addresses, links, clock times and numbers of three or more digits, each in one spelling."""
    def email(m: Column) -> Column:
        return F.regexp_replace(F.lower(m), r"[.,]+$", "")

    def link(m: Column) -> Column:
        cut = F.regexp_replace(F.lower(m), r"[.,;:!?]+$", "")
        return F.regexp_replace(F.regexp_replace(cut, r"^(?:https?://)?(?:www\.)?", ""), r"/+$", "")

    def clock(m: Column) -> Column:
        hour = F.regexp_extract(m, fixed.CLOCK, 1).cast("int").cast("string")
        minute = F.regexp_extract(m, fixed.CLOCK, 2)
        return F.concat(hour, F.lit(":"), F.when(minute == "", F.lit("00")).otherwise(minute),
                        F.lower(F.regexp_extract(m, fixed.CLOCK, 3)), F.lit("m"))

    def number(m: Column) -> Column:
        return F.when(m.rlike(r"^[0-9]+\.[0-9]+$"), F.regexp_replace(m, r"\.?0+$", "")).otherwise(m)

    def numbers(rest: Column) -> Column:
        plain = F.transform(_all(rest, fixed.NUMBER), lambda m: F.regexp_replace(m, fixed.THOUSANDS, ""))
        return F.transform(F.filter(plain, lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")) >= 3), number)

    # each kind is searched in what the kinds before it left over
    return F.array_distinct(let(c, lambda t: F.concat(
        F.transform(_all(t, fixed.EMAIL), email),
        let(F.regexp_replace(t, fixed.EMAIL, " "), lambda a: F.concat(
            F.transform(_all(a, fixed.LINK), link),
            let(F.regexp_replace(a, fixed.LINK, " "), lambda b: F.concat(
                F.transform(_all(b, fixed.CLOCK), clock),
                numbers(F.regexp_replace(b, fixed.CLOCK, " ")))))))))


def unmatched_facts(sentence: Column, source: Column) -> Column:
    """Exact facts of `sentence` that `source` does not contain, sorted."""
    return F.array_sort(F.array_except(exact_facts(sentence), exact_facts(source)))


def strip_letter(c: Column) -> Column:
    """Drop a first line that holds only an option letter."""
    body = F.regexp_replace(c, r"(?U)^\s+", "")
    first = F.substring_index(body, "\n", 1)
    letter = F.regexp_replace(first, r"^[ .()]+|[ .()]+$", "")
    rest = F.when(F.instr(body, "\n") > 0, F.substring(body, F.length(first) + 2, F.length(body))).otherwise(F.lit(""))
    return F.when(letter.rlike("^[A-Z]$"), strip(rest)).otherwise(strip(c))


def valid_key(c: Column) -> Column:
    return c.rlike(fixed.OPTION_KEY)


def fill(template: str, **values: Column) -> Column:
    """`template` with each {name} replaced by a column."""
    out, rest = [], template
    while rest:
        starts = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not starts:
            out.append(F.lit(rest))
            break
        at, key = min(starts)
        out += [F.lit(rest[:at]), values[key].cast("string")]
        rest = rest[at + len(key) + 2:]
    return F.concat(*out)


def percent_value(c: Column) -> Column:
    return F.regexp_extract(F.trim(c), r"^([\d.]+)%", 1).try_cast("double")


def money_value(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"^\$([\d,.]+)", 1), ",", "").try_cast("double")


def millis_value(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"^([\d,]+) ms", 1), ",", "").try_cast("double")


def parameter_billions(name: Column) -> Column:
    """Parameters stated in a system name: `0.8B` and `421M` count, an effective size such as `E2B` does not."""
    stated = r"(?<![A-Za-z])(\d+(?:\.\d+)?)\s*([BbMm])\b"
    size = F.regexp_extract(name, stated, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(name, stated, 2))
    return F.when(name.rlike(r"\bE\d+B\b"), F.lit(None).cast("double")).when(unit == "m", size / 1000).otherwise(size)


def day_count(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(" day")).otherwise(F.lit(" days")))

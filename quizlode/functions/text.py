"""Text scalars as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

#: White space as the normalisers mean it, no-break and wide spaces included; letters are told from it by the first ranges alone.
WS = r"[[^!-~À-ӿ]&&[\s   -     　﻿]]"


def strip(x: Column) -> Column:
    """Without white space at either end, whatever kind."""
    return F.regexp_replace(x, rf"^{WS}+|{WS}+\z", "")


def collapse(x: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, rf"{WS}+", " "))


def yo(x: Column) -> Column:
    return F.translate(x, "ё", "е")


def dedupe_key(x: Column) -> Column:
    """Lower case, letters and digits only, every other run one blank."""
    return F.trim(F.regexp_replace(yo(F.lower(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}]+", " "))


def answer_key_text(x: Column) -> Column:
    """Lower case, blanks collapsed, without common punctuation and quotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " "), r"""[.,;:!?«»"'()]""", ""))


def comparison_key(x: Column) -> Column:
    """Lower case without punctuation, curly quotes and danda signs."""
    plain = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"""[.,/#!$%^&*;:{}=\-_`~()?"'\[\]\\|<>@+“”‘’।॥]""", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def figure_key(x: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(yo(F.lower(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}]+", "")


def words(x: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def noise_key(x: Column) -> Column:
    """What running heads have in common: digits are alike."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[0-9]+", "#"), r"\s+", " "))


def fold_mixed_words(x: Column) -> Column:
    """Latin look-alikes as Cyrillic letters in words that have both alphabets."""
    mixed = lambda w: w.rlike("[Ѐ-ӿ]") & w.rlike("[a-z]")
    fold = lambda w: F.when(mixed(w), F.translate(w, rules.LATIN_TWINS, rules.CYRILLIC_TWINS)).otherwise(w)
    # a text without both alphabets has no such word and is not taken apart
    words_ = lambda t: F.when(mixed(t), F.array_join(F.transform(F.split(t, " "), fold), " ")).otherwise(t)
    return F.get(F.transform(F.array(x), words_), F.lit(0))


def match_key(x: Column) -> Column:
    """Identity for matching questions: no marks, folded alphabets, punctuation as blanks, signs and formulas kept."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), r"[-" + rules.CHECK_GLYPHS + rules.CROSS_GLYPHS.replace("×", "") + "]", "")
    low = fold_mixed_words(yo(F.lower(bare)))
    # brackets, quotes, punctuation and white space, in one pass
    apart = r"""[[^a-z0-9À-ӿ]&&[«»"“”„'`’‘()\[\]{}.,;:!?…–—\-_/\\|*#~""" + WS.split("&&[")[1]
    return F.trim(F.regexp_replace(low, rf"{apart}+", " "))


def bengali_to_digits(x: Column) -> Column:
    return F.translate(x, rules.BENGALI_DIGITS, rules.DIGITS)


def digits_to_bengali(x: Column) -> Column:
    return F.translate(x, rules.DIGITS, rules.BENGALI_DIGITS)


def has_bengali(x: Column) -> Column:
    return x.rlike("[ঀ-৿]")


def option_key(x: Column) -> Column:
    """A to E for letters of either alphabet, digits of either kind and either case; anything else as it is."""
    bare = F.translate(F.trim(x), "().:[]-–—", "")
    letters = rules.OPTION_LETTERS
    mapped = F.translate(
        bare, rules.BENGALI_OPTION_LETTERS + letters.lower() + "12345" + rules.BENGALI_DIGITS[1:6], letters * 4
    )
    return F.when(F.length(bare) == 1, mapped).otherwise(bare)


def is_noise_line(x: Column) -> Column:
    line = strip(x)
    return F.coalesce((line != "") & reduce(lambda a, b: a | b, (line.rlike(f"(?iu){p}") for p in rules.NOISE_LINES)), F.lit(False))


def is_scrambled_bijoy(x: Column) -> Column:
    return reduce(lambda a, b: a + b, (x.rlike(f"(?iu){p}").cast("int") for p in rules.BIJOY_SIGNS)) >= 2


def tidy_extracted(x: Column) -> Column:
    """Extracted page text with plain blanks, quotes, dashes, bullets and line ends, without page numbers."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"[  ᠎ -​  　﻿]", " ")
    quotes, dashes, bullets = "\u2018\u2019\u201A\u201B\u201C\u201D\u201E\u201F", "\u2013\u2014\u2015", "\u2022\u2023\u25E6\u2043\u2219"
    x = F.translate(x, quotes + dashes + bullets, "'" * 4 + '"' * 4 + "-" * 8)
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"(?imu)^\s*(?:page|পৃষ্ঠা)\s*[:.-]?\s*[0-9০-৯]+(?:\s*(?:of|এর|/)\s*[0-9০-৯]+)?\s*$", "")
    x = F.regexp_replace(x, r"(?m)^\s*-\s*[0-9০-৯]+\s*-\s*$", "")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(x, "\n"), strip), "\n"))


def locale_number(x: Column) -> Column:
    """"1,00" and "0.5" as numbers, null where it is none; an empty text is 0."""
    bare = F.regexp_replace(x, r"\s", "")
    return F.when(bare == "", F.lit(0.0)).otherwise(F.regexp_replace(bare, "^([^,]*),", "$1.").try_cast("double"))


def blanks(x: Column) -> Column:
    """Box glyphs and underscore runs as one blank to fill in."""
    return F.regexp_replace(F.regexp_replace(x, "[▁▂□☐]+", "_____"), r"_{2,}(?:\s*_{2,})*", "_____")


def to_latex(x: Column) -> Column:
    """Unicode mathematics as LaTeX; null where there is none."""
    out = x
    for chars, plain, sign in ((rules.SUPERSCRIPTS, rules.SUPERSCRIPT_PLAIN, "^"), (rules.SUBSCRIPTS, rules.SUBSCRIPT_PLAIN, "_")):
        out = F.translate(F.regexp_replace(out, f"([{chars}]+)", rf"\{sign}{{$1}}"), chars, plain)
    for char, name in rules.LATEX.items():
        out = F.replace(out, F.lit(char), F.lit(f"\\{name} "))
    return F.when(out != x, F.trim(F.regexp_replace(out, r"\s+", " ")))


def formula_damage(x: Column) -> Column:
    """Signs that a formula lost its exponents or characters."""
    edge, end = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    return F.array_compact(
        F.array(
            F.when(x.rlike(rf"{edge}10\s?-\s?[0-9]{{1,2}}{end}") & ~x.rlike(r"10\s?[⁻^]"), "exponent-may-be-flattened"),
            F.when(x.rlike(rf"{edge}10[0-9]{{2}}{end}") & x.rlike(r"(?:м|m|Гц|Hz|Дж|J)(?![A-Za-zА-Яа-я])"), "exponent-digits-merged"),
            F.when(x.contains("\uFFFD"), "replacement-char"),
        )
    )


def languages(x: Column) -> Column:
    """Languages of which the letters hold more than a tenth."""
    count = lambda p: F.length(F.regexp_replace(x, f"[^{p}]", ""))

    def named(n: Column) -> Column:
        cyrillic, latin, bengali = (F.get(n, F.lit(k)) for k in range(3))
        total = F.greatest(cyrillic + latin + bengali, F.lit(1))
        return F.array_compact(
            F.array(
                F.when(cyrillic / total > 0.1, F.when(x.rlike("[іїєґІЇЄҐ]"), "uk").otherwise("ru")),
                F.when(latin / total > 0.1, "en"),
                F.when(bengali / total > 0.1, "bn"),
            )
        )

    # the letters are counted once, though each share needs all counts
    return F.get(F.transform(F.array(F.array(count("Ѐ-ӿ"), count("A-Za-z"), count("ঀ-৿"))), named), F.lit(0))


def strip_markup(x: Column) -> Column:
    """Text of markup: tags as blanks, the five named entities and numbers decoded, blanks collapsed."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def escape_xml(x: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def count_phrase(text: Column, phrase: Column) -> Column:
    """Places of a phrase of four characters or more, apart from each other."""
    low, sought = F.lower(text), F.lower(phrase)
    n = (F.length(low) - F.length(F.replace(low, sought, F.lit("")))) / F.length(sought)
    return F.when(F.length(sought) >= 4, n.cast("int")).otherwise(F.lit(0))


def clamp(x: Column, least, most) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(least))


def percent(x: Column, whole: Column) -> Column:
    """x of a whole in percent; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(x * 100.0 / whole)


def union_box(boxes: DataFrame, by: str) -> DataFrame:
    """(by, x, y, w, h): the box around all boxes (x, y, w, h) of each group."""
    x, y = F.min("x"), F.min("y")
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return boxes.groupBy(by).agg(x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))


def is_blank_picture(fine: Column) -> Column:
    """Whether under 0.6 % of a fingerprint's cells (hex digits) are two shades or more from its commonest shade."""
    known = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731 - worked out once, not in every cell
    levels = F.transform(F.filter(F.split(fine, ""), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("int"))
    counts = lambda cells: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda v: F.struct(F.size(F.filter(cells, lambda x: x == v)).alias("n"), (-v).alias("v")))
    far = lambda cells, common: F.size(F.filter(cells, lambda x: F.abs(x - common) >= 2)) / F.size(cells)
    share = known(levels, lambda cells: known(-F.array_max(counts(cells))["v"], lambda common: far(cells, common)))
    return F.coalesce((F.length(fine) > 0) & (share < 0.006), F.lit(False))


def iso(x: Column) -> Column:
    """A moment as text, to the millisecond, in UTC."""
    return F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def renamed_pairs(pairs: Column, names: Column) -> Column:
    """A map with its keys by other names; pairs without a name or a value go."""
    known = F.map_filter(pairs, lambda k, v: v.isNotNull() & F.map_contains_key(names, k))
    return F.transform_keys(known, lambda k, v: F.element_at(names, k))


def looks_like_formula(x: Column) -> Column:
    """Raised or lowered signs, a short name set equal to something, powers of ten, or a number with a unit."""
    return F.coalesce(
        x.rlike("[⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺₀₁₂₃₄₅₆₇₈₉√∫∑∆∂≈≤≥∞·⋅]")
        | x.rlike(r"(?<![A-Za-zА-Яа-я])[A-Za-zА-Яа-яα-ωΑ-Ω]{1,3}\s*=\s*[A-Za-zА-Яа-яα-ωΑ-Ω0-9(]")
        | x.rlike(r"\d\s*[*×·]\s*10\s*[\^⁻-]?\s*-?\d")
        | x.rlike(rf"(?<![A-Za-z0-9_])\d+(?:[.,]\d+)?\s*(?:{rules.UNITS})(?![A-Za-zА-Яа-я])"),
        F.lit(False),
    )


def quoted_phrase(x: Column) -> Column:
    """A search phrase in quotes, its own quotes and parentheses gone."""
    return F.concat(F.lit('"'), F.trim(F.regexp_replace(F.regexp_replace(x, r'["()]', " "), r"\s+", " ")), F.lit('"'))


def core_term(x: Column) -> Column:
    """A term without the general noun at its end, if four characters are left."""
    core = F.trim(F.regexp_replace(x, rf"(?i)\s+({rules.GENERAL_NOUNS})$", ""))
    return F.when(F.length(core) >= 4, core).otherwise(x)


def picture_id(fine: Column) -> Column:
    """An id that the same fingerprint always has: two multiplicative 32-bit hashes of its characters, in base 36."""
    chars = F.transform(F.filter(F.split(fine, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    mixed = lambda start, factor: F.aggregate(chars, F.lit(start).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(factor).cast("long")).bitwiseAND(0xFFFFFFFF))
    base36 = lambda h: F.lower(F.conv(h.cast("string"), 10, 36))
    return F.concat(F.lit("mdl-img-"), base36(mixed(0x811C9DC5, 0x01000193)), base36(mixed(0x01000193, 0x5BD1E995)))


def average_hash(gray: Column) -> Column:
    """The cells of a picture (levels, a multiple of four) that are above its mean, as hex digits of four cells each."""
    mean = F.aggregate(gray, F.lit(0.0), lambda s, v: s + v, lambda s: s / F.size(gray))
    bits = F.get(F.transform(F.array(mean), lambda m: F.transform(gray, lambda v: F.when(v > m, "1").otherwise("0"))), F.lit(0))
    nibbles = F.transform(F.sequence(F.lit(0), F.floor(F.size(gray) / 4).cast("int") - 1), lambda i: F.lower(F.conv(F.array_join(F.slice(bits, i * 4 + 1, F.lit(4)), ""), 2, 16)))
    return F.array_join(nibbles, "")


def fine_fingerprint(gray: Column) -> Column:
    """A picture's cells at sixteen levels, a hex digit each."""
    return F.array_join(F.transform(gray, lambda v: F.lower(F.conv(F.least(F.lit(15), F.floor(v / 16)).cast("string"), 10, 16))), "")

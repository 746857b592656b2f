"""What photographed and exported tests need before their text is read, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules, text


def strip_score_noise(x: Column) -> Column:
    """Without fragments of scores and labels of the platform."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), f"(?iu){rules.SCORE_NOISE}", " ")
    return text.collapse(F.regexp_replace(x, f"(?iu){rules.PLATFORM_LABELS}", " "))


def strip_platform(x: Column) -> Column:
    """Without flags, addresses, clocks of a status bar and stray signs."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?iu)Отметить\s+вопрос|Flag\s+question", " ")
    for pattern in (rules.DOMAIN, rules.CLOCK, rules.STRAY_SIGNS):
        x = F.regexp_replace(x, f"(?i){pattern}" if pattern is rules.DOMAIN else pattern, " ")
    return text.collapse(x)


def is_ocr_garbage(x: Column) -> Column:
    """A status bar, or three words and more of which over 22 % are junk: mixed scripts, signs, short foreign bits."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    count = lambda script: F.regexp_count(x, F.lit(rf"\p{{Is{script}}}"))
    mostly_cyrillic = count("Cyrillic") > count("Latin")

    def junk(word: Column) -> Column:
        w = F.regexp_replace(word, r"""^[«"'(\[]+|[»"'),.:;!?\]]+\z""", "")
        cyrillic, latin = w.rlike(r"\p{IsCyrillic}"), w.rlike(r"\p{IsLatin}")
        sign = ~w.rlike(r"\p{L}") & ~w.rlike(r"^\d+(?:[.,)]\d*)?\z") & ~w.rlike(r"^[—–-]\z")
        return (w != "") & ((cyrillic & latin) | sign | (mostly_cyrillic & latin & (F.length(w) <= 4)))

    share = F.size(F.filter(words, junk)) / F.greatest(F.size(words), F.lit(1))
    return F.coalesce(x.rlike(f"(?iu){rules.STATUS_BAR}") | ((F.size(words) >= 3) & (share > 0.22)), F.lit(False))


def is_unreadable(x: Column) -> Column:
    """Too few letters or words, lists of numbers, or words too short to be a question."""
    x = F.coalesce(x, F.lit(""))
    letters = F.regexp_count(x, F.lit(r"\p{L}"))
    words = F.regexp_extract_all(x, F.lit(r"\p{L}{2,}"), F.lit(0))
    n = F.size(words)
    marks = F.regexp_count(x, F.lit(r"(?:^|\s)\d{1,2}[.)](?=\s|\z)"))
    solid = F.length(F.regexp_replace(x, r"\s", ""))
    total = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w))
    return (letters < 8) | (n < 2) | ((marks >= 2) & (marks * 2 >= n)) | (letters / F.greatest(solid, F.lit(1)) < 0.45) | (total / F.greatest(n, F.lit(1)) < 2.6)


def is_heading(x: Column) -> Column:
    """Two to eight words without punctuation, digits, acronyms and verbs."""
    s = text.strip(F.coalesce(x, F.lit("")))
    words = F.split(s, r"\s+")
    plain = (s != "") & ~s.rlike(r"[?:.,;!()_\d]") & ~s.rlike(r"\p{Lu}{2,}") & F.size(words).between(2, 8)
    return plain & F.forall(F.filter(words, lambda w: F.length(w) > 3), lambda w: ~F.lower(w).rlike(rules.VERB_ENDINGS))


def split_filled(x: Column) -> Column:
    """(stem, answer) of a fill-in question that ends with its answer and a hint how to give it; null for any other.

    The hint stands in parentheses or is a plain request. The answer is what follows the question's last sign, or else the
    last words after a verb that links them to the rest.
    """
    s = F.regexp_replace(text.strip(x), r"[.]+\z", "")
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    closed, open_ = rf"(?isu)^(.*?)\s*({rules.HINT})\s*\z", rf"(?isu)^(.*?)\s*({rules.PLAIN_HINT})\s*\z"
    in_brackets = s.rlike(closed)
    part = lambda g: F.when(in_brackets, F.regexp_extract(s, closed, g)).otherwise(F.regexp_extract(s, open_, g))
    before, said = part(1), text.strip(part(2))
    hint = F.when(in_brackets, said).otherwise(F.concat(F.lit("("), F.regexp_replace(said, r"[.]+\z", ""), F.lit(")")))
    sentence, link = r"(?su)^(.*[?!:.])\s+([^?!:.]{2,120})\z", rf"(?isu){rules.LINKED_ANSWER}"
    answer = text.strip(F.regexp_extract(before, sentence, 2))
    asked = F.regexp_extract(before, sentence, 1)
    capital = F.concat(F.upper(F.substring(answer, 1, 1)), F.substr(answer, F.lit(2)))
    stem, linked = F.regexp_extract(before, link, 1), text.strip(F.regexp_extract(before, link, 2))
    out = lambda head, tail: F.struct(F.concat_ws(" ", text.strip(head), F.lit(rules.BLANK), hint).alias("stem"), tail.alias("answer"))
    found = in_brackets | s.rlike(open_)
    by_sign = before.rlike(sentence) & (F.length(asked) >= 15) & (words(answer) <= 12)
    by_verb = before.rlike(link) & (F.length(stem) >= 15) & (words(linked) <= 6)
    return F.when(found & by_sign, out(asked, capital)).when(found & by_verb, out(stem, linked))


def wrap(x: Column, width: int = 42) -> Column:
    """Lines of at most ``width`` characters, broken between words; a longer word is a line of its own."""
    words = F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        longer = F.when(acc["line"] == "", w).otherwise(F.concat_ws(" ", acc["line"], w))
        fits = F.length(longer) <= width
        full = F.when(acc["line"] == "", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"])))
        return F.struct(F.when(fits, acc["lines"]).otherwise(full).alias("lines"), F.when(fits, longer).otherwise(w).alias("line"))

    return F.aggregate(words, start, step, lambda acc: F.when(acc["line"] == "", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"]))))


def mended_words(x: Column) -> Column:
    """Broken words of a converted font as they should be, one after another."""
    x = F.coalesce(x, F.lit(""))
    for broken, whole in rules.BROKEN_WORDS:
        x = F.regexp_replace(x, broken, whole)
    return x


def clean_stem(x: Column) -> Column:
    """Without scores, and without the label of an answer field at the end."""
    return text.strip(F.regexp_replace(strip_score_noise(x), f"(?iu){rules.ANSWER_LABEL}", ""))


def clean_option(x: Column) -> Column:
    """Without scores, and without a second label glued to the text."""
    return text.strip(F.regexp_replace(strip_score_noise(x), r"^[a-eA-E][.)](?=[А-ЯЁ])", ""))


def rejoined(x: Column) -> Column:
    """Words that were spaced out letter by letter, as one again.

    A run of Cyrillic pieces of up to three letters is one word if a piece of it is a letter that is no word; the piece
    that ends a run of two goes with it.
    """
    piece, lone = "[а-яё]{1,3}", f"[а-яё&&[^{rules.ONE_LETTER_WORDS}]]"
    run = F.split(x, " ")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("run"))

    def flush(acc: Column) -> Column:
        spaced = (F.size(acc["run"]) >= 2) & F.exists(acc["run"], lambda t: t.rlike(f"^{lone}$"))
        return F.when(spaced, F.concat(acc["out"], F.array(F.array_join(acc["run"], "")))).otherwise(F.concat(acc["out"], acc["run"]))

    def step(acc: Column, t: Column) -> Column:
        none = F.array().cast("array<string>")
        spaced = (F.size(acc["run"]) == 2) & F.exists(acc["run"], lambda r: r.rlike(f"^{lone}$"))
        tail = spaced & t.rlike("^[а-яё]+[,.;]?$")
        glued = F.concat(acc["out"], F.array(F.concat(F.array_join(acc["run"], ""), t)))
        return (
            F.when(t.rlike(f"^{piece}$"), F.struct(acc["out"].alias("out"), F.concat(acc["run"], F.array(t)).alias("run")))
            .when(tail, F.struct(glued.alias("out"), none.alias("run")))
            .otherwise(F.struct(F.concat(flush(acc), F.array(t)).alias("out"), none.alias("run")))
        )

    return F.when(x.rlike(f"(^| ){piece} {piece}( |$)"), F.array_join(F.aggregate(run, start, step, flush), " ")).otherwise(x)


def clean_answer(x: Column) -> Column:
    """A typed answer without a score glued to it and with its words rejoined; null if nothing is left."""
    return F.nullif(rejoined(strip_score_noise(F.regexp_replace(x, f"(?u){rules.GLUED_SCORE}", ""))), F.lit(""))


def _folded_runs(x: Column) -> Column:
    """Latin letters as Cyrillic ones in runs of letters of both alphabets, if each of them has a twin."""
    latin, cyrillic = rules.LATIN_TWINS + rules.LATIN_TWINS.upper(), rules.CYRILLIC_TWINS + rules.CYRILLIC_TWINS.upper()
    both = rf"^(?=.*\p{{IsCyrillic}})(?=.*\p{{IsLatin}})[\p{{IsCyrillic}}{latin}]+$"
    runs = F.regexp_extract_all(x, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(both), F.translate(r, latin, cyrillic)).otherwise(r)), "")


def display_text(x: Column) -> Column:
    """A text to show: invisible signs gone, look-alike letters and spacing mended, formulas as they are."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), "[\u00AD\u200B-\u200D\uFEFF]", "")
    x = _folded_runs(F.translate(x, "\u0138\u00A0", "к "))
    x = F.regexp_replace(x, r"С(?=\d{1,2}\s*[-–]\s*(?:Th|C|L|S|Co)\d)", "C")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s+([,.;:!?])(\s|$)", "$1$2")
    # runs of five and more pieces, mostly single letters, are one word
    pieces = F.regexp_extract_all(x, F.lit(r"(?:^|(?<=\s))(?:\p{L}{1,3} ){4,}\p{L}{1,3}(?=\s|$|[,.;:!?])"), F.lit(0))
    for_one = lambda run: F.when(F.size(F.filter(F.split(run, " "), lambda p: F.length(p) == 1)) >= 0.6 * F.size(F.split(run, " ")), F.replace(run, F.lit(" "), F.lit(""))).otherwise(run)
    mended = F.aggregate(pieces, x, lambda acc, run: F.replace(acc, run, for_one(run)))
    return text.strip(mended)


def review_text(x: Column) -> Column:
    """A text of a review page with its kinds of blanks as one."""
    return text.strip(F.regexp_replace(F.translate(F.coalesce(x, F.lit("")), "\u0138\u00a0\u2009\u202f", "к   "), r"\s+", " "))


def review_key(x: Column) -> Column:
    """That text in lower case, letters and digits only, field brackets gone."""
    return F.trim(F.regexp_replace(F.translate(F.lower(review_text(x)), "ё⟪⟫", "е"), r"[^\p{L}\p{N}]+", " "))


def without_quotes(x: Column) -> Column:
    """Without quotes and blanks at the ends, nor punctuation at the end."""
    return F.trim(F.regexp_replace(x, r"""^[\s«"“'„]+|[\s»"”'.,;:!?]+\z""", ""))


def filled(template: Column, values: Column) -> Column:
    """A text with its blanks (three underscores), one after another, replaced by values in quotes; null values leave theirs."""
    parts = F.split(template, "___", -1)
    said = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.concat(F.lit("«"), F.nullif(F.get(values, i - 1), F.lit("")), F.lit("»")), F.lit("___")), p)))
    return F.array_join(said, "")


def caption(x: Column) -> Column:
    """A figure's caption: punctuation at the ends gone, blanks collapsed, first letter a capital."""
    x = text.collapse(F.regexp_replace(F.coalesce(x, F.lit("")), r"^[\s.,;:—–-]+|[\s.,;:—–-]+\z", ""))
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))

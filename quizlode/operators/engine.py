"""The document engine: positioned page items to lines, roles, attempts, question instances and answers.

Lines are built page by page and roles are built-in expressions, without a shuffle. Only what depends on the order of a
whole document, the walk that opens and closes attempts and blocks, runs per document in Python; it sees a document's
lines and nothing else. What blocks mean and what they prove is expressions and aggregates again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from . import evidence, feedback, layout

PAGE = (
    "document_id string, page int, items array<struct<str:string,x:double,y:double,w:double,h:double>>"
)
LINE = "document_id string, page int, pos int, text string, x double, y double, w double, h double"
_MARKS = rules.CHECK_GLYPHS + rules.CROSS_GLYPHS
_SIDE = re.compile(f"{rules.HEADER_ALONE}|{rules.STATUS_LINE}|{rules.SCORE_LINE}|{rules.SCORE_MAX_LINE}|{rules.FLAG_LINE}", re.IGNORECASE)


def _page_lines(items: list[dict]) -> list[tuple[str, float, float, float, float]]:
    """Items on one baseline as lines, cells with wide gaps apart; labels of the side box as lines of their own, first."""
    items = sorted((i for i in items if (i["str"] or "").strip()), key=lambda i: (i["y"] + i["h"] / 2, i["x"]))
    if not items:
        return []
    heights = sorted(i["h"] for i in items)
    tolerance = max(0.45 * heights[len(heights) // 2], 2.0)
    rows: list[list[dict]] = []
    mean = 0.0
    for i in items:
        centre = i["y"] + i["h"] / 2
        if rows and abs(centre - mean) <= tolerance:
            rows[-1].append(i)
            mean += (centre - mean) / len(rows[-1])
        else:
            rows.append([i])
            mean = centre
    out = []
    for row in rows:
        cells: list[list[dict]] = []
        for i in sorted(row, key=lambda i: i["x"]):
            if cells and i["x"] - (cells[-1][-1]["x"] + cells[-1][-1]["w"]) <= max(2.2 * i["h"], 18.0):
                cells[-1].append(i)
            else:
                cells.append([i])
        joined = [(" ".join(i["str"].strip() for i in c), c) for c in cells]
        side = [c for c in joined[:1] if len(joined) > 1 and _SIDE.match(c[0].strip())]
        for label, parts in [*side, (" ".join(t for t, _ in joined[len(side) :]), [i for _, c in joined[len(side) :] for i in c])]:
            if parts:
                x, y = min(i["x"] for i in parts), min(i["y"] for i in parts)
                out.append((label, x, y, max(i["x"] + i["w"] for i in parts) - x, max(i["y"] + i["h"] for i in parts) - y))
    return out


def build_lines(pages: DataFrame) -> DataFrame:
    """(document_id, page, pos, text, x, y, w, h) of pages (document_id, page, items)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in LINE.split(", ")]
        for frame in frames:
            rows = [
                (r.document_id, r.page, pos, *line)
                for r in frame.itertuples(index=False)
                for pos, line in enumerate(_page_lines([dict(i) if isinstance(i, dict) else i.asDict() for i in r.items]))
            ]
            yield pd.DataFrame(rows, columns=columns)

    return pages.select("document_id", "page", "items").mapInPandas(run, LINE)


def classify(lines: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """Lines with their role and what it says: number, body, value, earned, maximum, multi, label, kind, sign, code, glyphs.

    noise, if given, lists running heads (document_id, key); lines that look like questions or options are never noise.
    """
    flag = "(?iu)"
    glyphs = F.regexp_extract_all("text", F.lit(f"[{_MARKS}\\uE000-\\uF8FF]"), F.lit(0))
    t = text.collapse(F.regexp_replace("text", f"[{_MARKS}\\uE000-\\uF8FF]", " "))
    rows = lines.withColumn("glyphs", glyphs).withColumn("t", t)
    t = F.col("t")
    take = lambda p, g: F.regexp_extract(t, flag + p, g)
    is_ = lambda p: t.rlike(flag + p)
    chrome = is_("|".join(f"(?:{p})" for p in rules.CHROME))
    score = F.when(is_(rules.INSTRUCTION_VERB), 2.0).otherwise(0.0) + F.when(is_(rules.INSTRUCTION_OBJECT), 1.5).otherwise(0.0) + F.when(is_("[:：]$"), 0.5).otherwise(0.0)
    instruction = (F.length(t) <= 110) & (score >= 3)
    kinds = (("SIGN", rules.OPTION_SIGN, 3), ("CODE", rules.OPTION_CODE, 2), ("BULLET", rules.OPTION_BULLET, 2), ("PAREN", rules.OPTION_PAREN, 2), ("LETTER", rules.OPTION_LETTER, 2), ("NUMBER", rules.OPTION_NUMBER, 2))
    kind, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    label = F.lit(None).cast("string")
    for name, p, g in reversed(kinds):
        kind, body = F.when(is_(p), name).otherwise(kind), F.when(is_(p), take(p, g)).otherwise(body)
        if name in ("PAREN", "LETTER", "NUMBER"):
            label = F.when(is_(p), take(p, 1)).otherwise(label)
    structural = is_(rules.HEADER_ALONE) | is_(rules.HEADER_INLINE) | is_(rules.STATUS_LINE) | is_(rules.SCORE_LINE) | instruction | kind.isNotNull()
    running = F.lit(False)
    if noise is not None:
        known = noise.select(F.col("document_id").alias("_d"), F.col("key").alias("_k"), F.lit(True).alias("_noise")).distinct()
        rows = rows.join(known, (F.col("document_id") == F.col("_d")) & (text.noise_key(F.col("text")) == F.col("_k")), "left")
        running = F.coalesce("_noise", F.lit(False)) & ~structural
    role = (
        F.when((t == "") & (F.size("glyphs") > 0), "MARK_ONLY")
        .when((t == "") | running | chrome, "NOISE")
        .when(is_(rules.HEADER_ALONE) | is_(rules.HEADER_INLINE) | is_(rules.HEADER_SIGN), "QUESTION_HEADER")
        .when(is_(rules.STATUS_LINE), "STATUS")
        .when(is_(rules.META_SCORE), "ATTEMPT_META")
        .when(is_(rules.SCORE_LINE) | is_(rules.SCORE_MAX_LINE), "SCORE")
        .when(is_(rules.FLAG_LINE), "FLAG")
        .when(is_(rules.FEEDBACK_LINE), "FEEDBACK")
        .when(is_(rules.META_LINE) & ((take(rules.META_LINE, 2) != "") | is_(rules.META_START)), "ATTEMPT_META")
        .when(instruction, "INSTRUCTION")
        .when(kind.isNotNull(), "OPTION")
        .otherwise("TEXT")
    )
    header = F.when(is_(rules.HEADER_ALONE), take(rules.HEADER_ALONE, 1)).when(is_(rules.HEADER_INLINE), take(rules.HEADER_INLINE, 1)).when(is_(rules.HEADER_SIGN), take(rules.HEADER_SIGN, 1))
    inline = F.when(is_(rules.HEADER_ALONE), F.lit("")).when(is_(rules.HEADER_INLINE), take(rules.HEADER_INLINE, 2)).otherwise(take(rules.HEADER_SIGN, 2))
    rows = rows.withColumn("role", role)
    r = F.col("role")
    number = F.when(r == "QUESTION_HEADER", header).when((r == "OPTION") & (kind == "NUMBER"), label).try_cast("int")
    value = (
        F.when((r == "ATTEMPT_META") & is_(rules.META_SCORE), take(rules.META_SCORE, 2)).when(r == "ATTEMPT_META", take(rules.META_LINE, 2))
        .when(r == "FEEDBACK", take(rules.FEEDBACK_LINE, 1)).when(r == "STATUS", F.lower(t))
    )
    key = F.when(r == "ATTEMPT_META", F.lower(F.when(is_(rules.META_SCORE), take(rules.META_SCORE, 1)).otherwise(take(rules.META_LINE, 1))))
    maximum = F.when(is_(rules.SCORE_LINE), take(rules.SCORE_LINE, 2)).otherwise(take(rules.SCORE_MAX_LINE, 1))
    return rows.select(
        "document_id", "page", "pos", "text", "x", "y", "h", "role", "glyphs", number.alias("number"),
        F.when(r == "QUESTION_HEADER", inline).when(r == "OPTION", body).otherwise(t).alias("body"), key.alias("key"), value.alias("value"),
        F.when((r == "SCORE") & is_(rules.SCORE_LINE), text.locale_number(take(rules.SCORE_LINE, 1))).alias("earned"),
        F.when(r == "SCORE", text.locale_number(maximum)).alias("maximum"),
        F.when(r == "INSTRUCTION", F.when(is_(rules.SEVERAL), True).when(is_(rules.SINGLE), False)).alias("multi"),
        F.when(r == "OPTION", kind).alias("kind"), F.when(r == "OPTION", label).alias("label"),
        F.when((r == "OPTION") & (kind == "SIGN"), F.when(take(rules.OPTION_SIGN, 1) == "+", "+").otherwise("-")).alias("sign"),
        F.when((r == "OPTION") & (kind == "CODE"), take(rules.OPTION_CODE, 1).try_cast("int")).alias("code"),
    )


class _Walk:
    """The walk over one document's lines: which attempt and block each belongs to."""

    def __init__(self, explicit: bool) -> None:
        self.explicit = explicit
        self.attempt, self.block, self.blocks = 0, None, 0
        self.last, self.asked = 0, False
        self.keys: set[str] = set()
        self.lines: list = []  # of the open block
        self.pending: list[int] = []
        self.headerless = False

    def begin(self) -> None:
        self.attempt += 1
        self.last, self.asked, self.keys = 0, False, set()

    def close(self) -> None:
        self.block, self.lines, self.headerless = None, [], False

    def open(self, number: int | None) -> None:
        self.close()
        if number is not None:
            if self.asked and number == 1 and self.last >= 1:
                self.begin()
            self.last = number
        self.block, self.blocks, self.asked = self.blocks, self.blocks + 1, True
        self.headerless = number is None

    def starts_question(self, n: int) -> bool:
        """Whether a numbered line is the next question and not an option of the open one."""
        if self.block is None:
            return True
        options = [r for r in self.lines if r.role == "OPTION"]
        numbers = [r.number for r in options if r.kind == "NUMBER"]
        as_question, as_option = n == self.last + 1, n == (numbers[-1] + 1 if numbers else 1)
        prompt = bool(re.search(r"[:?？]\s*$", self.lines[-1].text)) or any(r.role == "INSTRUCTION" for r in self.lines)
        if any(r.kind in ("LETTER", "PAREN") for r in options):
            return n > self.last
        if as_question:
            return len(options) >= 2 or not prompt
        return not as_option and n > self.last and len(options) >= 2


def _segment(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["page", "pos"], kind="stable").reset_index(drop=True)
    rows = list(frame.itertuples(index=False))
    walk = _Walk((frame["role"] == "QUESTION_HEADER").sum() >= 2)
    attempts: list[int] = [0] * len(rows)
    blocks: list[int | None] = [None] * len(rows)
    roles = list(frame["role"])

    def settle() -> None:
        """Lines before any header: a question if they look like one, else nothing."""
        some = [rows[i] for i in walk.pending]
        if sum(r.role in ("OPTION", "INSTRUCTION") for r in some) >= 2 or any(r.role in ("SCORE", "STATUS") or re.search(r"[?？]\s*$", r.text) for r in some):
            walk.open(None)
            for i in walk.pending:
                attempts[i], blocks[i] = walk.attempt, walk.block
            walk.close()
        walk.pending = []

    for i, r in enumerate(rows):
        if r.role == "NOISE":
            attempts[i] = walk.attempt
            continue
        if r.role == "ATTEMPT_META":
            start = bool(re.match(rules.META_START, r.key or "", re.IGNORECASE))
            if walk.asked and (start or r.key in walk.keys):
                settle()
                walk.close()
                walk.begin()
            walk.close()
            walk.keys.add(r.key)
            attempts[i] = walk.attempt
            continue
        numbered = r.role == "OPTION" and r.kind == "NUMBER" and not walk.explicit
        if r.role == "QUESTION_HEADER" or (numbered and walk.starts_question(int(r.number))):
            settle()
            walk.open(None if pd.isna(r.number) else int(r.number))
            roles[i] = "QUESTION_HEADER"
        elif walk.block is None:
            walk.pending.append(i)
            some = [rows[k] for k in walk.pending]
            if r.role == "OPTION" and any(p.role != "OPTION" for p in some):
                walk.open(None)
                walk.lines = some
                for k in walk.pending:
                    attempts[k], blocks[k] = walk.attempt, walk.block
                walk.pending = []
            continue
        elif r.role in ("TEXT", "INSTRUCTION") and (walk.headerless or not walk.explicit) and walk.lines and walk.lines[-1].role == "OPTION":
            before = walk.lines[-1]
            followed = i + 1 < len(rows) and rows[i + 1].role == "OPTION"
            if sum(p.role == "OPTION" for p in walk.lines) >= 2 and followed and (before.kind == "SIGN" or re.search(r"[:?？]\s*$", r.text)):
                walk.open(None)
        attempts[i], blocks[i] = walk.attempt, walk.block
        walk.lines.append(r)
    settle()
    frame["attempt"], frame["block"], frame["role"] = attempts, pd.array(blocks, dtype="Int64"), roles
    used = {a: k for k, a in enumerate(sorted({a for a, b in zip(attempts, blocks, strict=True) if b is not None}))}
    frame["attempt"] = [used.get(a) for a in attempts]
    return frame


def segment(classified: DataFrame) -> DataFrame:
    """Classified lines with attempt (from 0; only attempts with questions count) and block; null outside any."""
    schema = classified.select("*", F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("int").alias("block")).schema
    return classified.groupBy("document_id").applyInPandas(_segment, schema)


def instances(lines: DataFrame) -> DataFrame:
    """One row per block: number, stem, options, multi, score, status, feedback.

    Text before the first option is the stem, text after an option goes on with it; a mark on a line of its own belongs
    to the option before it.
    """
    part = F.struct("page", "pos", "role", "body", "number", "glyphs", "label", "kind", "sign", "code", "value", "earned", "maximum", "multi")
    blocks = lines.where("block IS NOT NULL").groupBy("document_id", "attempt", "block").agg(F.array_sort(F.collect_list(part)).alias("p"))
    option = "array<struct<label:string,text:string,glyphs:array<string>,sign:string,code:int,kind:string>>"
    start = F.struct(F.lit("").alias("stem"), F.array().cast(option).alias("options"))

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc["options"])
        head, last = F.slice(acc["options"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.get(acc["options"], n - 1)
        make = lambda label, body, glyphs, sign, code, kind: F.array(F.struct(label.alias("label"), body.alias("text"), glyphs.alias("glyphs"), sign.alias("sign"), code.alias("code"), kind.alias("kind"))).cast(option)
        is_text = (x["role"] == "TEXT") | ((x["role"] == "INSTRUCTION") & (n == 0) & (acc["stem"] == ""))
        more = make(last["label"], F.trim(F.concat_ws(" ", last["text"], F.when(is_text, x["body"]))), F.concat(last["glyphs"], x["glyphs"]), last["sign"], last["code"], last["kind"])
        stem = F.when((n == 0) & (is_text | (x["role"] == "QUESTION_HEADER")), F.trim(F.concat_ws(" ", acc["stem"], x["body"]))).otherwise(acc["stem"])
        options = (
            F.when(x["role"] == "OPTION", F.concat(acc["options"], make(x["label"], x["body"], x["glyphs"], x["sign"], x["code"], x["kind"])))
            .when((n > 0) & (is_text | (x["role"] == "MARK_ONLY")), F.concat(head, more))
            .otherwise(acc["options"])
        )
        return F.struct(stem.alias("stem"), options.alias("options"))

    first = lambda role, field: F.get(F.filter("p", lambda x: x["role"] == role), F.lit(0))[field]
    folded = blocks.withColumn("f", F.aggregate("p", start, step))
    return folded.select(
        F.sha2(F.concat_ws("|", "document_id", F.col("attempt").cast("string"), F.col("block").cast("string")), 256).alias("instance_id"),
        "document_id", "attempt", F.col("block").alias("sequence"), F.get("p", F.lit(0))["page"].alias("page"), first("QUESTION_HEADER", "number").alias("number"),
        F.col("f.stem").alias("stem"), F.col("f.options").alias("options"), F.coalesce(first("INSTRUCTION", "multi"), F.lit(False)).alias("multi"),
        first("SCORE", "earned").alias("earned"), first("SCORE", "maximum").alias("maximum"), first("STATUS", "value").alias("status"), first("FEEDBACK", "value").alias("feedback"),
    )


def answers(rows: DataFrame) -> DataFrame:
    """Instances with kind of score, positions of right and wrong options, order, status, confidence and completeness.

    Evidence in this order: plus and minus signs, a feedback line that names options (the others are wrong then), pairs or
    the answer to a question without options, marks read by the score. A private icon means what the document's full and
    zero scores say it means. Nothing is answered without such evidence. issues and extraction_status tell what a person
    should look at; a text layer is read with full confidence.
    """
    rows = rows.withColumn("score_kind", evidence.score_kind(F.col("earned"), F.col("maximum")))
    marks = rows.select("document_id", F.col("instance_id").alias("question_id"), "score_kind", F.explode(F.flatten(F.transform("options", lambda o: o["glyphs"]))).alias("glyph"))
    meanings = evidence.glyph_meanings(marks).where("meaning IS NOT NULL")
    learned = meanings.groupBy("document_id").agg(
        F.collect_set(F.when(F.col("meaning") == "CHECKMARK", F.col("glyph"))).alias("ok"), F.collect_set(F.when(F.col("meaning") == "CROSS", F.col("glyph"))).alias("no")
    )
    rows = rows.join(learned, "document_id", "left")
    chars = lambda s: F.array(*[F.lit(c) for c in s])
    none = F.array().cast("array<string>")
    ok, no = F.concat(chars(rules.CHECK_GLYPHS), F.coalesce("ok", none)), F.concat(chars(rules.CROSS_GLYPHS), F.coalesce("no", none))
    where = lambda test: F.filter(F.transform("options", lambda o, i: F.when(test(o), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("checks", where(lambda o: F.arrays_overlap(o["glyphs"], ok))).withColumn("crosses", where(lambda o: F.arrays_overlap(o["glyphs"], no)))
    rows = rows.withColumn("plus", where(lambda o: o["sign"] == "+")).withColumn("signed", where(lambda o: o["sign"].isNotNull()))
    rows = rows.withColumn("said", feedback.named(F.col("feedback"), F.transform("options", lambda o: o["text"])))
    rows = rows.withColumn("told", F.coalesce("said.told", F.array().cast("array<int>")))
    n = F.size("options")
    linked = F.coalesce(F.size("said.pairs"), F.lit(0))
    typed = F.col("said.text_answer").isNotNull() & (linked <= 0)
    all_signed = (F.size("signed") > 0) & (F.size("signed") == F.size("options"))
    marked = evidence.scored_answer(F.col("score_kind"), F.col("checks"), F.col("crosses"), F.array().cast("array<int>"), F.lit(0.95))
    state = lambda s, c, done: F.struct(F.lit(s).alias("status"), F.lit(c).cast("double").alias("confidence"), F.lit(done).alias("complete"))
    clash = (F.size("told") > 0) & (F.size("checks") > 0) & (F.size(F.array_except("checks", "told")) > 0) & (F.col("score_kind") == "FULL_SCORE")
    verdict = (
        F.when(all_signed & (F.size("plus") > 0), state("CONFIRMED_BY_DOCUMENT", 0.97, True))
        .when(F.size("signed") > 0, state("NEEDS_REVIEW", 0.6, False))
        .when(clash, state("CONFLICT", 0.4, False))
        .when(F.size("told") > 0, state("CONFIRMED_BY_DOCUMENT", 0.97, True))
        .when(linked > 0, F.when(linked == n, state("CONFIRMED_BY_DOCUMENT", 0.95, True)).otherwise(state("NEEDS_REVIEW", 0.6, False)))
        .when(typed & (n == 0), state("CONFIRMED_BY_DOCUMENT", 0.93, True))
        .otherwise(marked)
    )
    rows = rows.withColumn("verdict", verdict)
    right = F.when(F.size("signed") > 0, F.col("plus")).when(F.size("told") > 0, F.col("told")).when(F.col("score_kind") == "ZERO_SCORE", F.array().cast("array<int>")).otherwise(F.col("checks"))
    others = F.array_except(F.transform("options", lambda o, i: i), F.col("told"))
    wrong = F.when(all_signed, F.array_except("signed", "plus")).when((F.size("signed") == 0) & (F.size("told") > 0), others).otherwise(F.col("crosses"))
    issues = F.array_compact(F.array(
        F.when(F.coalesce("stem", F.lit("")) == "", "EMPTY_STEM"), F.when(n == 1, "SINGLE_OPTION"), F.when(typed & (n > 0), "FEEDBACK_UNMATCHED"), F.when(clash, "FEEDBACK_CONTRADICTS_MARKS"),
        F.when((F.size("signed") > 0) & (F.size("plus") == 0), "PLUS_MINUS_WITHOUT_PLUS"),
    ))
    found = evidence.extraction(F.col("stem"), n, issues, F.lit(1.0), F.lit("known"), F.col("verdict.status"), F.col("verdict.confidence"))
    pairs = F.transform_keys("said.pairs", lambda i, _: F.get("options", i)["text"])
    codes = F.transform("options", lambda o: o["code"])
    order = F.when((F.size("options") >= 2) & evidence.order_codes(codes), F.transform(F.array_sort(F.transform("options", lambda o, i: F.struct(o["code"].alias("c"), i.alias("i")))), lambda x: x["i"]))
    return rows.select(
        "instance_id", "document_id", "attempt", "sequence", "page", "number", "stem", "options", "multi", "score_kind",
        right.alias("right"), wrong.alias("wrong"), order.alias("right_order"), "verdict.status", "verdict.confidence", "verdict.complete",
        text.match_key(F.col("stem")).alias("key"),
        F.when(linked > 0, "MATCHING").when(F.col("multi") | (F.size(right) > 1), "MULTIPLE_CHOICE").otherwise("SINGLE_CHOICE").alias("type"),
        F.when(linked > 0, pairs).alias("matching"), F.when(typed, F.col("said.text_answer")).alias("text_answer"), issues.alias("issues"), found["extraction_status"].alias("extraction_status"),
    )


def running_heads(lines: DataFrame) -> DataFrame:
    """(document_id, key) of the lines that run through a document's pages at their margins."""
    plain = lines.select(F.col("document_id").alias("document"), "page", "pos", F.col("text").alias("line"))
    return layout.running_noise(plain).select(F.col("document").alias("document_id"), "key")


def analyze(pages: DataFrame) -> DataFrame:
    """Pages to answered instances; running heads are noise."""
    lines = build_lines(pages)
    return answers(instances(segment(classify(lines, running_heads(lines)))))

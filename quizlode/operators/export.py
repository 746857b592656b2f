"""Sinks: CSV, JSON and text of questions as columns, and files of them."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

CSV_HEADER = "question,option_a,option_b,option_c,option_d,answer"


def csv_cell(x: Column) -> Column:
    """Quoted, quotes doubled, line ends as \\n; null as empty."""
    plain = F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n?", "\n")
    return F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_rows(questions: DataFrame) -> DataFrame:
    """(id, line) of questions (id, question, options map, answer), options A to D only."""
    cells = [F.col("question"), *[F.try_element_at("options", F.lit(k)) for k in "ABCD"], F.col("answer")]
    return questions.select("id", F.concat_ws(",", *[csv_cell(c) for c in cells]).alias("line"))


def write_csv(questions: DataFrame, path: str) -> int:
    """One file with byte-order mark, CRLF between lines and none at the end; rows stream through the driver one by one."""
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write("﻿" + ",".join(f'"{c}"' for c in CSV_HEADER.split(",")))
        for row in csv_rows(questions).orderBy("id").toLocalIterator():
            out.write("\r\n" + row["line"])
            n += 1
    return n


#: The columns of the full sheet.
SHEET_HEADER = "Question No,Question,Option A,Option B,Option C,Option D,Option E,Correct Answer,Confidence,Page"


def sheet_rows(questions: DataFrame) -> DataFrame:
    """(id, line) of questions with options A to E, confidence and page; what is missing is empty or "Not detected"."""
    options = [F.coalesce(F.try_element_at("options", F.lit(k)), F.lit("")) for k in "ABCDE"]
    answer = F.coalesce(F.nullif("answer", F.lit("")), F.lit("Not detected"))
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.col("number"), F.col("question"), *options, answer, F.col("confidence"), F.coalesce("page", F.lit(1))]
    return questions.select("id", F.concat_ws(",", *[quote(c) for c in cells]).alias("line"))


def text_blocks(questions: DataFrame) -> DataFrame:
    """(id, block): a question with its options and answer as plain text."""
    options = F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(F.lit("   "), e["key"], F.lit(". "), e["value"]))
    shown = F.try_element_at("options", F.col("answer"))
    known = F.concat(F.lit("   Answer: "), F.col("answer"), F.when(shown != "", F.concat(F.lit(" ("), shown, F.lit(")"))).otherwise(""))
    answer = F.when(F.coalesce("answer", F.lit("")) != "", known).otherwise("   Answer: Not detected (Needs Review)")
    head = F.concat(F.col("number").cast("string"), F.lit(". "), F.col("question"))
    return questions.select("id", F.array_join(F.concat(F.array(head), options, F.array(answer)), "\n").alias("block"))


def json_rows(questions: DataFrame) -> DataFrame:
    """(id, json) of the reduced fields; a missing answer is written as null."""
    fields = F.struct("number", "question", "options", F.col("answer").alias("correctAnswer"), "confidence", F.col("page").alias("pageNumber"))
    return questions.select("id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def write_json(questions: DataFrame, path: str) -> int:
    """One envelope with the number of questions and the questions, streamed in order."""
    total = questions.count()
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'{{"totalQuestions":{total},"questions":[')
        for n, row in enumerate(json_rows(questions).orderBy("id").toLocalIterator()):
            out.write(("," if n else "") + row["json"])
        out.write("]}")
    return total


def svg_cards(questions: DataFrame, width: int = 800, ink: str = "#1e293b", paper: str = "#ffffff", accent: str = "#2563eb") -> DataFrame:
    """(id, svg): a card with a question part and an answer part."""
    line = lambda x, y, size, fill: F.concat(
        F.lit('<text x="40" y="'), y.cast("string"), F.lit(f'" font-size="{size}" fill="{fill}">'), text.escape_xml(x), F.lit("</text>")
    )
    entries = F.array_sort(F.map_entries("options"))
    options = F.array_join(F.transform(entries, lambda e, i: line(F.concat(e["key"], F.lit(") "), e["value"]), F.lit(110) + i * 32, 18, ink)), "")
    height = (F.lit(190) + F.size(entries) * 32).cast("string")
    answer = line(F.concat(F.lit("Answer: "), F.coalesce("answer", F.lit("-"))), F.lit(150) + F.size(entries) * 32, 18, accent)
    svg = F.concat(
        F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="'), height, F.lit(f'"><rect width="100%" height="100%" fill="{paper}"/><g id="question-section">'),
        line(F.concat(F.col("number").cast("string"), F.lit(". "), F.col("question")), F.lit(60), 22, ink), options,
        F.lit('</g><g id="answer-section">'), answer, F.lit("</g></svg>"),
    )
    return questions.select("id", "number", svg.alias("svg"))


def write_svg_zip(questions: DataFrame, path: str) -> int:
    """Cards as Question-NNN.svg in one archive, streamed in order."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for row in svg_cards(questions).orderBy("id").toLocalIterator():
            archive.writestr(f"Question-{row['number']:03d}.svg", row["svg"])
            n += 1
    return n


def write_sheet(rows: DataFrame, path: str) -> int:
    """A workbook with one sheet of inline strings, header first."""
    escape = lambda v: str("" if v is None else v).replace("&", "&amp;").replace("<", "&lt;")
    cells = lambda values: "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in values) + "</row>"
    body, n = io.StringIO(), 0
    body.write(cells(rows.columns))
    for row in rows.toLocalIterator():
        body.write(cells(row))
        n += 1
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Questions" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body.getvalue()}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in parts.items():
            archive.writestr(name, content)
    return n


def write_text(questions: DataFrame, path: str) -> int:
    """All text blocks, an empty line between them."""
    blocks = [r["block"] for r in text_blocks(questions).orderBy("id").toLocalIterator()]
    Path(path).write_text("\n\n".join(blocks), encoding="utf-8")
    return len(blocks)


def word_paragraphs(questions: DataFrame) -> DataFrame:
    """(id, place, style, text): the paragraphs of a word-processor document: a heading, options, and the answer of each question."""
    letter = F.transform(F.map_entries("options"), lambda o: F.struct(F.lit("Normal").alias("style"), F.concat(o["key"], F.lit(". "), o["value"]).alias("text")))
    head = F.array(F.struct(F.lit("Heading2").alias("style"), F.concat(F.col("number").cast("string"), F.lit(". "), F.col("question")).alias("text")))
    said = F.coalesce(F.concat(F.lit("Answer: "), F.col("answer")), F.lit("Answer: Not detected (Needs Review)"))
    tail = F.array(F.struct(F.lit("Strong").alias("style"), said.alias("text")))
    return questions.select("id", F.posexplode(F.concat(head, letter, tail)).alias("place", "p")).select("id", "place", "p.style", "p.text")


def write_word(questions: DataFrame, path: str) -> int:
    """A word-processor document of all questions, streamed in order; for downloads, so it goes through the driver."""
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    package = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
    escape = lambda v: str(v).replace("&", "&amp;").replace("<", "&lt;")
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
        rels = "application/vnd.openxmlformats-package.relationships+xml"
        archive.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="{rels}"/><Override PartName="/word/document.xml" ContentType="{kind}"/></Types>')
        archive.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}" Target="word/document.xml"/></Relationships>')
        with archive.open("word/document.xml", "w") as body:
            body.write(f'<w:document xmlns:w="{word}"><w:body>'.encode())
            for row in word_paragraphs(questions).orderBy("id", "place").toLocalIterator():
                body.write(f'<w:p><w:pPr><w:pStyle w:val="{row["style"]}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(row["text"])}</w:t></w:r></w:p>'.encode())
                n += row["place"] == 0
            body.write(b"</w:body></w:document>")
    return n

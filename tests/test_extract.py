"""Documents and media from synthetic files."""

import io
import struct
import zipfile

from pyspark.sql import functions as F

from shelfmark.operators.extract import document_text, ebml_length, ebml_uint, extract_text, media_info, probe


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = zipped(**{"word/document.xml": "<w:p><w:t>needle &amp; thread</w:t></w:p><w:p><w:t>two</w:t></w:p>"})


def test_documents(spark):
    assert extract_text(DOCX, "DOCX") == "needle & thread\ntwo"
    slides = zipped(**{f"ppt/slides/slide{k}.xml": f"<a:p>s{k}</a:p>" for k in (10, 2, 1)})
    assert extract_text(slides, "pptx").split() == ["s1", "s2", "s10"]
    assert extract_text(zipped(**{"xl/sharedStrings.xml": "<sst><si><t>alpha</t></si><si><t>beta</t></si></sst>"}), "xlsx") == "alpha\nbeta"
    assert extract_text(b"junk", "docx") is None and extract_text(None, "docx") is None and extract_text(DOCX, "pdf") is None and extract_text(DOCX, None) is None
    df = spark.createDataFrame([(DOCX, "docx"), (None, "docx")], "b binary, k string")
    assert [r[0] for r in df.select(document_text(F.col("b"), F.col("k"))).collect()] == ["needle & thread\ntwo", None]


def test_sheets():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = zipped(
        **{
            "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {ns}><si><t>a long cell of text</t></si></sst>",
            "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>3</v></c></row><row r="3"><c r="B3"><v>2.5</v></c></row></sheetData></worksheet>',
        }
    )
    assert extract_text(data, "xlsx").split("\n") == ["── One ──", "a long cell of 3", " " * 15 + "2.5"]


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def test_media(spark):
    mvhd = box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 1000, 222_000) + bytes(80))
    tkhd = box(b"tkhd", bytes(76) + struct.pack(">II", 1920 << 16, 1080 << 16))
    mp4 = box(b"ftyp", b"isom") + box(b"moov", mvhd + box(b"trak", tkhd))
    assert probe(mp4, "mp4") == (222.0, 1920, 1080, "MP4")
    assert probe(box(b"moov", box(b"mvhd", b"\x01" + bytes(40))), "mov") == (None, None, None, "MP4")
    mkv = b"\x2a\xd7\xb1\x83\x0f\x42\x40" + b"\x44\x89\x84" + struct.pack(">f", 3000.0) + b"\xb0\x82\x02\x80\xba\x82\x01\xe0" + bytes(8)
    assert probe(mkv, "webm") == (3.0, 640, 480, "MKV")
    assert probe(b"", "avi") == (None, None, None, "AVI") and probe(b"", "") == (None, None, None, None)
    assert ebml_uint(b"\x81\x20", 0) == (32, 2) and ebml_length(b"\x40\x02\xaa\xbb", 0) == (2, 2) and ebml_length(b"\x00", 0) is None
    row = spark.createDataFrame([(mp4, "mp4")], "b binary, k string").select(media_info(F.col("b"), F.col("k")).alias("m")).first()["m"]
    assert tuple(row) == (222.0, 1920, 1080, "MP4")


def test_odd_media_and_sheets():
    wide = b"\x00\x00\x00\x01moov" + struct.pack(">Q", 16 + 28) + box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 10, 25))
    assert probe(wide, "mp4")[0] == 2.5
    assert probe(b"\x00\x00\x00\x00moov" + box(b"trak", box(b"tkhd", struct.pack(">II", 7 << 16, 5 << 16))), "mp4")[1:3] == (7, 5)
    assert probe(box(b"free", b"")[:7], "mp4") == (None, None, None, "MP4") and probe(b"\x00\x00\x00\x04moov" * 9, "mp4")[0] is None
    assert probe(box(b"moov", b"") * 5000 + box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 10, 25))), "mp4")[0] is None
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = '<row r="1"><c r="A1"><v>1</v></c></row><row r="1048576"><c r="XFD1048576"><v>2</v></c></row>'
    parts = {
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="Far" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>",
    }
    assert extract_text(zipped(**parts), "xlsx") == "── Far ──\n1"
    bomb = parts | {"xl/worksheets/sheet1.xml": '<!DOCTYPE x [<!ENTITY a "aaaa">]>' + parts["xl/worksheets/sheet1.xml"]}
    assert extract_text(zipped(**bomb), "xlsx") is None

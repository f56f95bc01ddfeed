"""The exam parser against a loop over lines, PDF files written by hand, and chunks tried in halves."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from examloom import order, rounds
from examloom.sources import exams, pdf


def loop_exam(lines: list[str]) -> list[tuple]:
    clean = lambda t: re.sub(r"[ \t]+", " ", t).strip()
    page, expected, out = 1, 1, []
    for line in (x.strip() for x in lines):
        banner = re.fullmatch(r"===\s+PAGE\s+(\d+)\s+===", line, re.I)
        if not line:
            continue
        if banner:
            page = int(banner[1])
            continue
        if line.startswith("© UCLES 2020") or "0610/12" in line or "0610/22" in line or "[Turn over" in line or (re.fullmatch(r"\d+", line) and int(line) == page):
            continue
        head = re.match(r"(\d+)\s+(.+)$", line)
        if head and int(head[1]) == expected:
            out.append({"number": expected, "page": page, "question": clean(head[2]), "options": []})
            expected += 1
            continue
        if not out:
            continue
        q, four, option = out[-1], re.match(r"A\s+(.+?)\s+B\s+(.+?)\s+C\s+(.+?)\s+D\s+(.+)$", line), re.match(r"([A-D])\s+(.+)$", line)
        if four:
            q["options"] = [clean(x) for x in four.groups()]
        elif option:
            q["options"].append(clean(option[2]))
        elif q["options"]:
            q["options"][-1] += " " + clean(line)
        else:
            q["question"] += "\n" + clean(line)
    return [(q["number"], f"q{q['number']:03d}", q["page"], q["question"], q["options"]) for q in out]


def test_exam_lines(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK_BITS", 3)
    r, files = random.Random(1), {}
    for f in range(25):
        lines, n = [], 0
        for _ in range(r.randint(0, 90)):
            n += r.random() < 0.5
            lines.append(r.choice([f"{n} What  is\tthis?", f"{n}  Q", "A one", "B two three", "C x D y", "A a B b C c D d", "more   text", "", "  ", f"=== page {r.randint(1, 4)} ===", "2", "3", f"{r.randint(1, 9)} decoy", "© UCLES 2020 x", "a 0610/12", "[Turn over", "99999999999999999999 z"]))
        files[f"f{f}"] = lines
    files["long"] = [x for i in range(1, 600) for x in (f"{i} Question {i}", f"{i} again", "A a B b C c D d", "tail")]
    rows = [(f, i, t) for f, ls in files.items() for i, t in enumerate(ls)]
    df = spark.createDataFrame(rows, "file string, line int, text string").repartition(4)
    got: dict = {}
    for x in exams.parsed_exam(df).orderBy("number").collect():
        got.setdefault(x["file"], []).append((x["number"], x["id"], x["page"], x["question"], x["options"]))
    assert got == {f: want for f, ls in files.items() if (want := loop_exam(ls))}
    assert exams.parsed_exam(df.limit(0)).count() == 0


def test_key(spark):
    q = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3)], "file string, number long")
    k = spark.createDataFrame([("f", 1, "B"), ("f", 2, "E")], "file string, number long, letter string")
    assert {r["number"]: r["answer"] for r in exams.with_key(q, k).collect()} == {1: 1, 2: None, 3: None}


def objects(parts: list[bytes], trailer: bytes, start: bytes = b"%PDF-1.4\n") -> bytes:
    """A file of numbered objects with a cross-reference table."""
    out, at = start, []
    for i, p in enumerate(parts, 1):
        at.append(len(out))
        out += b"%d 0 obj\n" % i + p + b"\nendobj\n"
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(parts) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (len(parts) + 1, trailer, table)


TREE = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 7 >>", b"<< /Type /Page /Parent 2 0 R >>", b"<< /Type /Pages /Kids [5 0 R] >>", b"<< /Type /Page >>"]


def packed(predictor: bool) -> bytes:
    """A file whose catalogue and page tree lie in an object stream, behind a cross-reference stream."""
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count 12 >>"]
    heads = b"1 0 2 %d " % (len(inner[0]) + 1)
    body = zlib.compress(heads + b" ".join(inner))
    out = b"%PDF-1.5\n"
    at_stream = len(out)
    out += b"3 0 obj\n<< /Type /ObjStm /N 2 /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(heads), len(body)) + body + b"\nendstream\nendobj\n"
    at_cross = len(out)
    entries = [bytes([0, 0, 0, 0]), bytes([2, 0, 3, 0]), bytes([2, 0, 3, 1]), bytes([1, at_stream >> 8, at_stream & 255, 0]), bytes([1, at_cross >> 8, at_cross & 255, 0])]
    data, more = b"".join(entries), b""
    if predictor:
        above, data, more = bytes(4), b"", b"/DecodeParms << /Predictor 12 /Columns 4 >> "
        for e in entries:
            data += b"\x02" + bytes((x - y) & 255 for x, y in zip(e, above, strict=True))
            above = e
    data = zlib.compress(data)
    out += b"4 0 obj\n<< /Type /XRef /Size 5 /W [1 2 1] /Root 1 0 R %s/Length %d /Filter /FlateDecode >>\nstream\r\n" % (more, len(data)) + data + b"\nendstream\nendobj\n"
    return out + b"startxref\n%d\n%%%%EOF" % at_cross


def encrypted(password: bytes) -> bytes:
    """A file under the standard scheme, revision 3, that ``password`` opens."""
    owner, ident = b"o" * 32, b"i" * 16
    key = hashlib.md5((password + pdf.PADDING)[:32] + owner + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()
    for _ in range(50):
        key = hashlib.md5(key[:16]).digest()
    check = hashlib.md5(pdf.PADDING + ident).digest()
    for i in range(20):
        check = pdf._rc4(bytes(b ^ i for b in key), check)
    lock = b"<< /Filter /Standard /V 2 /R 3 /Length 128 /P -4 /O <%s> /U <%s> >>" % (owner.hex().encode(), (check + bytes(16)).hex().encode())
    return objects([*TREE, lock], b"/Encrypt 6 0 R /ID [<%s> <%s>]" % (ident.hex().encode(), ident.hex().encode()))


def test_pdf_info(spark):
    plain = objects(TREE, b"")
    # An update adds a newer page tree behind the old file, and points back to it.
    more = plain + b"2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 9 >>\nendobj\n"
    at = len(plain)
    table = len(more)
    old = int(re.findall(rb"startxref\s+(\d+)", plain)[-1])
    updated = more + b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 6 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, old, table)
    uncounted = objects([TREE[0], TREE[1].replace(b" /Count 7", b""), *TREE[2:]], b"")
    circle = objects([TREE[0], b"<< /Type /Pages /Kids [2 0 R] >>"], b"")
    cases = {
        "plain": (plain, 7, None), "updated": (updated, 9, None), "uncounted": (uncounted, 2, None), "packed": (packed(False), 12, None), "predicted": (packed(True), 12, None), "behind junk": (b"x" * 20 + b"\n%PDF-1.4", None, pdf.NOT_A_PDF),
        "open": (encrypted(b""), 7, None), "closed": (encrypted(b"secret"), None, pdf.ENCRYPTED), "newer lock": (objects([*TREE, b"<< /Filter /Standard /R 6 >>"], b"/Encrypt 6 0 R"), None, pdf.ENCRYPTED),
        "cut": (plain[: len(plain) // 2], None, pdf.NOT_A_PDF), "circle": (circle, None, pdf.NOT_A_PDF), "text": (b"hello", None, pdf.NOT_A_PDF), "empty": (b"", None, pdf.NOT_A_PDF), "null": (None, None, pdf.NOT_A_PDF), "no root": (plain.replace(b"/Root", b"/Boot"), None, pdf.NOT_A_PDF),
    }
    df = spark.createDataFrame([(n, c[0], "?", "?") for n, c in cases.items()], "name string, content binary, pages string, error string").drop("pages", "error")
    assert {r["name"]: (r["pages"], r["error"]) for r in pdf.pdf_info(df).collect()} == {n: c[1:] for n, c in cases.items()}
    r = random.Random(3)
    broken = []
    for _ in range(300):
        b = bytearray(r.choice([plain, packed(True), encrypted(b"")]))
        for _ in range(r.randint(1, 12)):
            b[r.randrange(len(b))] = r.randrange(256)
        broken.append((bytes(b[: r.randrange(len(b))] if r.random() < 0.3 else b),))
    assert pdf.pdf_info(spark.createDataFrame(broken, "content binary")).filter("pages is null and error is null").count() == 0


def test_discovery(spark, tmp_path):
    names = ["a/exam.pdf", "a/exam-key.PDF", "0610_m20_ms_12.pdf", "0610_m20_qp_12.pdf", "Answers/exam.pdf", "a/b/deep.pdf", "note.txt", "monkey.pdf", "a/final answers.pdf"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(objects(TREE, b""))
    (tmp_path / "bad.pdf").write_bytes(b"no")
    got = {r["path"]: (r["is_key"], r["pages"], r["error"]) for r in pdf.discovered(spark, str(tmp_path)).collect()}
    assert got == {
        "a/exam.pdf": (False, 7, None), "a/exam-key.PDF": (True, 7, None), "0610_m20_ms_12.pdf": (True, 7, None), "0610_m20_qp_12.pdf": (False, 7, None), "Answers/exam.pdf": (True, 7, None), "monkey.pdf": (False, 7, None), "a/final answers.pdf": (True, 7, None), "bad.pdf": (False, None, pdf.NOT_A_PDF),
    }
    assert spark.range(1).select(pdf.question_paper(F.lit("0610_m20_ms_12.pdf"))).first()[0] == "0610_m20_qp_12.pdf"


def test_bisected(spark):
    r = random.Random(4)
    rows = [(c, p, r.random() < 0.15) for c in range(40) for p in range(r.randint(1, 13))]
    bad = {(c, p) for c, p, b in rows if b}
    sizes = {c: sum(x[0] == c for x in rows) for c in range(40)}
    df = spark.createDataFrame(rows, "chunk long, pos long, bad boolean").repartition(3)
    done, failed = rounds.bisected(df, lambda some: some.filter("bad").select("piece"))
    want: dict = {}

    def split(c: int, lo: int, hi: int) -> None:
        if not any((c, p) in bad for p in range(lo, hi)):
            want.update({(c, p): (lo, hi - 1) for p in range(lo, hi)})
        elif hi - lo > 1:
            mid = lo + -(-(hi - lo) // 2)
            split(c, lo, mid)
            split(c, mid, hi)

    for c, n in sizes.items():
        split(c, 0, n)
    assert {(x["chunk"], x["pos"]): (x["piece"]["lo"], x["piece"]["hi"]) for x in done.collect()} == want
    assert {(x["chunk"], x["pos"]) for x in failed.collect()} == bad
    assert [d.count() for d in rounds.bisected(df.limit(0), lambda some: some.select("piece"))] == [0, 0]

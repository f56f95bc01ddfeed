"""Text rules of exam records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts in browsers see it: ASCII white space, no-break space and byte order mark.
WS = r"[\s\x{00A0}\x{FEFF}]"
#: Fixed value: a question's printed number.
QUESTION_LABEL = r"(?i)^\s*(?:q(?:uestion)?\s*)?\d{1,3}\s*[.):\-–—]\s+"
#: Openings that identify no question.
GENERIC_OPENINGS = ("which", "what", "select", "choose", "according", "refer", "please", "in the", "the most", "how", "why", "where", "case stem", "question")
#: Fixed values: (name, pattern with the label as its group), in the order they are tried.
LABEL_STYLES = (
    ("roman", r"^([ivxlIVXL]{1,6})\.\s+"),
    ("roman", r"^\(?([ivxlIVXL]{1,6})\)\s*"),
    ("letter-dot", r"^([A-Za-z])\.\s+"),
    ("letter", r"^\(?([A-Za-z])\)\s*"),
    ("number", r"^(\d{1,2})\.\s+"),
    ("number", r"^\(?(\d{1,2})\)\s*"),
)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeezed(c: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.lower(trim(F.regexp_replace(c, f"{WS}+", " ")))


def strip_question_label(c: Column) -> Column:
    """drops a leading question number; keeps the text if nothing else is in it."""
    bare = F.regexp_replace(c, QUESTION_LABEL, "")
    return F.when(trim(bare) == "", c).otherwise(bare)


def option_text(c: Column) -> Column:
    """an option without its letter."""
    return trim(F.regexp_replace(trim(c), r"^[A-Za-z][.)\-:]\s*", ""))


def content_key(question: Column, options: Column) -> Column:
    """equal for questions with equal words and options."""
    return F.concat_ws("\u0001", squeezed(question), F.array_join(F.transform(options, squeezed), "\u0001"))


def is_generic(anchor: Column) -> Column:
    """too short, or starts like any question."""
    a = squeezed(anchor)
    hit = F.length(a) < 12
    for g in GENERIC_OPENINGS:
        hit = hit | a.startswith(g)
    return hit


def section_key(hint: Column, page: Column) -> Column:
    """F8."""
    return F.when(squeezed(hint) == "", F.concat(F.lit("page-"), page.cast("string"))).otherwise(squeezed(hint))


def parent_row(row_id: Column) -> Column:
    """the row that a split row came from."""
    return F.regexp_replace(row_id, r"(?s)^(.*)~m.*$", "$1")


def assemble_question(stem: Column, prompt: Column, template: Column) -> Column:
    """stem and prompt without labels, in the template (first mention of each); the prompt alone without a stem."""
    s, p = strip_question_label(stem), strip_question_label(prompt)

    def once(text: Column, mark: str, value: Column) -> Column:
        at = F.position(F.lit(mark), text)
        return F.when(at == 0, text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), value, F.substring(text, at + len(mark), F.length(text))))

    return F.when(trim(s) == "", p).otherwise(once(once(template, "{case_stem}", s), "{question_prompt}", p))


def csv_field(c: Column) -> Column:
    """quoted where a comma, a quote or a line break needs it."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def safe_bundle_name(c: Column) -> Column:
    """F13."""
    base = F.regexp_replace(c, r"(?i)\.pdf$", "")
    base = F.regexp_replace(base, r'[\\/:*?"<>|]', "-")
    base = F.regexp_replace(base, r"\p{Cc}", "")
    base = F.regexp_replace(F.regexp_replace(base, f"{WS}+", " "), r"^[\s.]+|[\s.]+$", "")
    return F.when((base == "") | ~base.rlike(r"[\p{L}\p{N}]"), "exam").otherwise(base)


def file_slug(c: Column) -> Column:
    """letters and digits, joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def log_name(c: Column) -> Column:
    """F18."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")


def jpeg_path(c: Column) -> Column:
    """the same path with the extension of a JPEG file."""
    return F.regexp_replace(c, r"\.[A-Za-z0-9]+$", ".jpg")


def bundle_path(c: Column) -> Column:
    """F16: forward slashes, no leading ``./`` or ``/``."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(?:\./|/)+", "")


def graded_question(c: Column) -> Column:
    """what graders compare: letters and digits of the start."""
    return F.substring(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), 1, 120)


#: Typographic quotes and dashes, and what they count as.
FOLDED = {**dict.fromkeys("‘’ʼ", "'"), **dict.fromkeys("“”", '"'), **dict.fromkeys(map(chr, range(0x2010, 0x2016)), "-")}


def folded(c: Column) -> Column:
    """typographic quotes, dashes and spaces made plain."""
    return squeezed(F.translate(c, "".join(FOLDED), "".join(FOLDED.values())))


def tokens(c: Column) -> Column:
    """distinct words of more than two characters."""
    plain = F.lower(F.translate(c, "".join(FOLDED), "".join(FOLDED.values())))
    return F.array_distinct(F.filter(F.split(plain, f"{WS}+"), lambda t: F.length(t) > 2))


def similarity(a: Column, b: Column) -> Column:
    """shared tokens over the larger token set; 0 if either is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def truncated(c: Column, most: int = 8000) -> Column:
    """F27."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("… [truncated]"))).otherwise(c)


def is_newer(a: Column, b: Column) -> Column:
    """dotted numbers, missing parts count as 0."""
    parts = lambda c: F.transform(F.split(F.concat(c, F.lit(".0.0.0")), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.slice(parts(a), 1, 3) > F.slice(parts(b), 1, 3)


def strip_table(c: Column) -> Column:
    """drops the first table in pipes; keeps the text if nothing else is in it."""
    bare = F.regexp_replace(F.concat(c, F.lit("\n")), r"(?s)\A(.*?)(?:(?<=\n)|\A)[^\n]*\|[^\n]*\n[ \t]*(?=[|:\-\s]*-)(?=[:\-\s]*\|)[|:\-\s]+?\n(?:[^\n]*\|[^\n]*\n)*", "$1")
    bare = F.trim(F.regexp_replace(bare, r"\n{3,}", "\n\n"))
    bare = trim(bare)
    return F.when(F.concat(c, F.lit("\n")).rlike(r"\|[^\n]*\n[ \t]*[|:\-\s]*-") & (bare != ""), bare).otherwise(c)


def roman_value(label: Column) -> Column:
    """the number that a numeral of i, v, x and l in one case says, null for anything else: a figure counts against a greater one behind it."""
    figures = F.transform(F.regexp_extract_all(F.lower(label), F.lit("([ivxl])"), 1), lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).otherwise(50))
    signed = F.transform(figures, lambda x, i: F.when(F.get(figures, i + 1) > x, -x).otherwise(x))
    return F.when(label.rlike("^([ivxl]+|[IVXL]+)$"), F.aggregate(signed, F.lit(0), lambda a, x: a + x))


def strip_enumeration(options: Column) -> Column:
    """struct<options, ambiguous>. Labels go where all options have the same style, in sequence from its start, with text behind.

    Letters with a dot before single lower-case words may be abbreviations: these stay and are ambiguous.
    """
    same = F.struct(options.alias("options"), F.lit(False).alias("ambiguous"))
    out, n = same, F.size(options)
    for name, pattern in reversed(LABEL_STYLES):
        out = _without_labels(options, name, pattern).otherwise(out)
    return F.when(n < 2, same).otherwise(out)


def _without_labels(options: Column, name: str, pattern: str) -> Column:
    """A ``when`` for one style of labels."""
    n = F.size(options)
    rest = F.transform(options, lambda o: F.regexp_replace(o, pattern, ""))
    labels = F.transform(options, lambda o: F.regexp_extract(o, pattern, 1))
    every = F.forall(options, lambda o: o.rlike(pattern)) & F.forall(rest, lambda r: F.length(r) > 0)
    if name == "roman":
        sequence = F.coalesce(F.transform(labels, roman_value) == F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(False))
    elif name == "number":
        sequence = F.transform(labels, lambda x: x.try_cast("int")) == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    else:
        start = F.ascii(F.get(labels, F.lit(0)))
        sequence = F.get(labels, F.lit(0)).isin("A", "a") & F.forall(F.transform(labels, lambda x, i: F.ascii(x) == start + i), lambda x: x)
    stripped = F.struct(rest.alias("options"), F.lit(False).alias("ambiguous"))
    if name == "letter-dot":
        stripped = F.when(F.forall(rest, lambda r: r.rlike("^[a-z]+$")), F.struct(options.alias("options"), F.lit(True).alias("ambiguous"))).otherwise(stripped)
    return F.when(every & sequence, stripped)


def leaks(question: Column) -> Column:
    """struct<label, number>: whether a label of the plan, or the printed number, was left in a question."""
    return F.struct(trim(question).rlike(r"(?i)^(case stem:|question:)").alias("label"), question.rlike(r"^\s*\(?\d{1,3}\s*[.)-]").alias("number"))


def inline_options(line: Column) -> Column:
    """the texts behind A to D in one line, null unless all four are there."""
    found = F.array(*(trim(F.regexp_extract(line, r"(?i)^\s*\(?A[.)]\s*(.+?)\s+\(?B[.)]\s*(.+?)\s+\(?C[.)]\s*(.+?)\s+\(?D[.)]\s*(.+)$", k)) for k in range(1, 5)))
    return F.when(F.forall(found, lambda o: o != ""), found)


def short_number(n: Column) -> Column:
    """whole thousands with one decimal and a k. A half is rounded as the binary fraction nearest to it lies: up from the half itself and above, else down."""
    n = n.cast("bigint")
    x = n.cast("double") / F.lit(1000.0)
    # That fraction as a whole number of very small parts, held against the exact one.
    parts = F.when(x < 1 << 11, F.lit(1 << 52)).when(x < 1 << 21, F.lit(1 << 42)).otherwise(F.lit(1 << 31))
    above = (x * parts).cast("bigint").cast("decimal(19,0)") * F.lit(1000).cast("decimal(4,0)") >= n.cast("decimal(19,0)") * parts.cast("decimal(19,0)")
    rest = n % 100
    tenths = F.floor(n / 100) + F.when((rest > 50) | ((rest == 50) & above), 1).otherwise(0)
    shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k"))
    return F.when(n >= 1000, shown).otherwise(n.cast("string"))


def cleaned_topics(topics: Column) -> Column:
    """trimmed, without blank ones."""
    return F.filter(F.transform(topics, trim), lambda t: t != "")


def backup_name(at: Column, product: str, everything: Column, extension: str) -> Column:
    """sorts by time, in the session's time zone."""
    return F.concat(F.lit(f"{product} "), F.date_format(at, "yyyy-MM-dd HHmm"), F.when(everything, " full").otherwise(""), F.lit(extension))


def backup_due(reason: Column, last: Column, now: Column, hours: int = 12) -> Column:
    """always behind a batch; at startup without a backup, or with one of ``hours`` or more."""
    return (reason == "batch-finished") | last.isNull() | (F.unix_micros(now) - F.unix_micros(last) >= hours * 3_600_000_000)

"""Text columns: the normalisers, hashes, estimates and small renderers of the document pipeline. They differ; none replaces another."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F


def _decomposed() -> tuple[str, str]:
    """Letters that decompose into one base and marks, with their bases; the marks themselves come last and have none."""
    pairs = {}
    for code in (*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)):
        base = [x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != chr(code):
            pairs[chr(code)] = base[0]
    return "".join([*pairs, *map(chr, range(0x300, 0x370))]), "".join(pairs.values())


ACCENTED, BASES = _decomposed()


def let(value: Column, f) -> Column:
    """f(value) with value computed once a row, also where f uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: White space of any kind.
BLANKS = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def squeeze(t: Column) -> Column:
    """Runs of white space as one space, ends trimmed (T7 without lower case)."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def _plainly_folded(text: str) -> str:
    """What the column functions make of a letter, with Python's own of the same kind."""
    return text.lower().replace("ß", "ss").translate(_OFF)


def normalised(text: str) -> str:
    """Case-folded and decomposed by compatibility, without combining marks (T4)."""
    return "".join(x for x in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(x))


_OFF = {ord(a): BASES[i] if i < len(BASES) else None for i, a in enumerate(ACCENTED)}


def _ranges(codes, gap: int = 1) -> str:
    """Codes in order as ranges of a pattern's character class; those at most `gap` apart share one. Few ranges are read fast."""
    out: list[list[int]] = []
    for c in codes:
        if out and c - out[-1][1] <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in out)


#: A character that the column functions don't fold as Python does: any but ASCII and the Latin letters that they do. ASCII is
#: one range and asked first, so that the other ranges are only compared where a letter is beyond it.
_FOLDED_OTHERWISE = r"[^\x00-\x7F](?<![" + _ranges(c for c in range(0xA0, 0x180) if _plainly_folded(chr(c)) == normalised(chr(c))) + "])"


def _or_python(t: Column, plain: Column, pattern: str, f: Callable[[str], str]) -> Column:
    """`plain`, but f for the texts that have a character of the pattern; only these go to Python."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore")

    other = F.coalesce(t.rlike(pattern), F.lit(False))
    return F.when(other, run(F.when(other, t))).otherwise(plain)


def casefold(t: Column) -> Column:
    """Case-folded as far as a column function goes, also inside a lambda: Latin letters; whole_casefold folds all."""
    return F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))


def _unlike_lower() -> dict[str, str]:
    """What case folding makes of the lower-case letters of the basic plane that it changes, but of ß."""
    pairs = {chr(c).lower(): chr(c).casefold() for c in range(0x80, 0x10000) if chr(c).lower() != chr(c).casefold()}
    return {a: b for a, b in pairs.items() if a != "ß"}


_CASED = _unlike_lower()
_SINGLE = {a: b for a, b in _CASED.items() if len(b) == 1}
_SEVERAL = {a: b for a, b in _CASED.items() if len(b) > 1}


#: A letter that becomes another by case folding than by `casefold`, with some near it: few ranges are read fast. A capital sigma
#: becomes one of two small ones.
_UNLIKE = "[" + _ranges((c for c in range(0x80, 0x10000) if c == 0x3A3 or any(x in _CASED for x in chr(c).lower())), 0x20) + "]"


def whole_casefold(t: Column) -> Column:
    """Case-folded: one letter may become several."""

    def several(low: Column) -> Column:
        folded = F.translate(low, "".join(_SINGLE), "".join(_SINGLE.values()))
        pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _SEVERAL.items()])
        return F.aggregate(pairs, folded, lambda x, p: F.replace(x, p["a"], p["b"]))

    return F.when(~t.rlike(r"[^\x00-\x7F]"), F.lower(t)).when(t.rlike(_UNLIKE), several(casefold(t))).otherwise(casefold(t))


def strip_accents(t: Column) -> Column:
    """Letters without their marks; those that decompose into several letters stay."""
    return F.translate(t, ACCENTED, BASES)


def fold_plainly(t: Column) -> Column:
    """What column functions fold of a text: all of it but for the characters of `needs_python`."""
    return F.when(t.rlike(r"[^\x00-\x7F]"), strip_accents(casefold(t))).otherwise(F.lower(t))


def needs_python(t: Column) -> Column:
    """The texts that only `normalised` folds; null for others."""
    return F.when(F.coalesce(t.rlike(_FOLDED_OTHERWISE), F.lit(False)), t)


def fold_accents(t: Column) -> Column:
    """Case-folded and decomposed, without marks, any script (T4)."""
    return _or_python(t, fold_plainly(t), _FOLDED_OTHERWISE, normalised)


def fold_sections(t: Column) -> Column:
    """Accents off, length and case kept, so offsets stay valid."""
    return F.translate(t, "áéíóúñÁÉÍÓÚÑ", "aeiounAEIOUN")


def fingerprint(t: Column) -> Column:
    """SHA-256 of the case-folded, squeezed text."""
    return F.sha2(squeeze(whole_casefold(t)), 256)


def heading(t: Column) -> Column:
    """Letters and digits only, folded, single spaces (T5)."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(t)), "[^a-z0-9]+", " "))


def slug(t: Column, default: str = "documento", accents: bool = True) -> Column:
    """T6; without accents folded, an accented letter is a break as any other sign is (the variant for upload names)."""
    low = strip_accents(F.lower(t)) if accents else F.lower(t)
    s = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def plain_facts(t: Column) -> Column:
    """Lower case, squeezed, accents kept."""
    return squeeze(F.lower(t))


def evaluation(t: Column) -> Column:
    """Accents off, lower case, squeezed."""
    return squeeze(F.lower(strip_accents(t)))


def compact(t: Column) -> Column:
    """Runs of white space as one space, ends kept."""
    return F.regexp_replace(t, r"(?U)\s+", " ")


def yaml_quote(t: Column) -> Column:
    """T11."""
    return F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"(\S+)"), 1)


def token_estimate(t: Column) -> Column:
    """Words, at least 1."""
    return F.greatest(F.lit(1), F.size(words(t)))


def tail_words(t: Column, n: int) -> Column:
    """The last n words by single spaces."""
    return let(words(t), lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), F.lit(n)), " "))


# fixed values: beginnings of lines that are no product name
BOILERPLATE = ("ficha de datos", "hoja de datos", "fecha de emision", "fecha de emisión", "msds no", "versión", "version", "seccion", "sección")


def title_guess(t: Column, fallback: Column) -> Column:
    """First usable line among the first 25."""
    lines = F.transform(F.slice(F.split(t, "\n"), 1, 25), squeeze)

    def usable(line: Column) -> Column:
        starts = F.lit(False)
        for p in BOILERPLATE:
            starts = starts | F.lower(line).startswith(p)
        return ~starts & ~line.rlike(r"^\d+\s*/\s*\d+$") & F.length(line).between(4, 120)

    return F.coalesce(F.try_element_at(F.filter(lines, usable), F.lit(1)), fallback)


def running_line(line: Column, product: Column) -> Column:
    """Headers and footers that run through pages."""
    low = casefold(line)
    return (low == casefold(product)) | low.rlike(r"fecha de emisi[oó]n:.*msds no\.") | line.rlike(r"^\d+\s*/\s*\d+$")


def markdown_text(t: Column, product: Column) -> Column:
    """T14."""
    lines = F.transform(F.split(F.replace(t, F.lit("\r\n"), F.lit("\n")), "\n"), squeeze)
    lines = F.filter(lines, lambda x: ~running_line(x, product))
    lines = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[•●▪▫]\s*", "- "), r"^\(?([a-z])\)\s+", r"- ($1) "))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def page_span(a: Column, b: Column) -> Column:
    """T24."""
    return F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b))


def cell(t: Column) -> Column:
    """A value inside a Markdown table."""
    return F.replace(F.replace(F.replace(t, F.lit("|"), F.lit("&#124;")), F.lit("\n"), F.lit(" ")), F.lit("<br>"), F.lit("; "))


def table(headers: list[str], rows: Column) -> Column:
    """A Markdown table of rows (array of arrays of strings)."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))
    head = F.lit("| " + " | ".join(headers) + " |\n| " + " | ".join("---" for _ in headers) + " |")
    return F.array_join(F.concat(F.array(head), F.transform(rows, line)), "\n")


def source_label(rank: Column, source_file: Column, number: Column, page_start: Column, page_end: Column, chunk_id: Column) -> Column:
    """T26."""
    return F.concat(F.lit("[FUENTE "), rank, F.lit("] "), source_file, F.lit(" | seccion "), number, F.lit(" | paginas "), page_start, F.lit("-"), page_end, F.lit(" | "), chunk_id)


def strip(t: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def unique_in_order(items: Column) -> Column:
    """Squeezed, edge blanks and semicolons off, no empties, first seen first."""
    clean = F.transform(items, lambda x: F.regexp_replace(squeeze(x), "^[ ;]+|[ ;]+$", ""))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def first_group(t: Column, pattern: str, missing: str = "no reportado en el fragmento") -> Column:
    """The first match's group 1, any case."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(t, "(?i)" + pattern, 1)), F.lit("")), F.lit(missing))


def image_kind(width: Column, height: Column, page: Column, y0: Column) -> Column:
    """T19."""
    return (
        F.when((width >= 450) & (height >= 120) & (page == 1) & (y0 < 120), "header_logo")
        .when((width <= 80) & (height <= 80), "small_icon")
        .when((F.abs(width - height) <= 70) & (width >= 100), "pictogram")
        .otherwise("embedded")
    )


def image_extension(name: Column) -> Column:
    """T20."""
    e = F.regexp_replace(F.lower(name), r"^\.+", "")
    return F.when(e == "jpeg", "jpg").when(e.isin("png", "jpg", "webp", "gif", "bmp", "tiff"), e).otherwise("png")


def table_lines(t: Column) -> Column:
    """Lines without trailing blanks, no blank lines."""
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: F.rtrim(x)), lambda x: x != ""), "\n")

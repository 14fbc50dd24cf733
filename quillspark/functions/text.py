"""Text and name functions as Column expressions; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L

ColumnOrName = Column | str
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: The same characters, one by one.
SPACES = " \t\n\x0b\f\r\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_of(d: dict) -> Column:
    """A constant map."""
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def strip(c: ColumnOrName) -> Column:
    """Without Unicode white space at the ends; null gives ''."""
    return F.btrim(F.coalesce(col(c), F.lit("")), F.lit(SPACES))


def first_non_empty(*cs: ColumnOrName) -> Column:
    """The first value that isn't blank, stripped; '' if all are."""
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in cs), F.lit(""))


def fold_ascii(c: ColumnOrName) -> Column:
    """Lower case without the diacritics of Czech, German and French letters."""
    return F.replace(F.translate(F.lower(col(c)), L.FOLD_FROM, L.FOLD_TO), F.lit("ß"), F.lit("ss"))


def old_orthography(c: ColumnOrName) -> Column:
    """w as v, in a folded text."""
    return F.replace(col(c), F.lit("w"), F.lit("v"))


def _ends(c: Column, *ends: str) -> Column:
    out = F.endswith(c, F.lit(ends[0]))
    for e in ends[1:]:
        out = out | F.endswith(c, F.lit(e))
    return out


def surname_norm(c: ColumnOrName, genitive: Column | bool = False) -> Column:
    """One form for the spellings, genders and (with genitive) cases of a surname."""
    gen = genitive if isinstance(genitive, Column) else F.lit(genitive)
    f = F.regexp_replace(old_orthography(fold_ascii(strip(c))), "^(.{3,}[^aeiouy])([sc]k)(eho|emu|a|e|i|ym|ou)$", "$1$2y")
    cut = lambda n: F.substring(f, F.lit(1), F.length(f) - n)
    return F.when(_ends(f, "ova", "ove"), cut(3)).when(_ends(f, "sky", "cky"), f).when(gen & _ends(f, "a", "y") & (F.length(f) > 4), cut(1)).otherwise(f)


def given_norm(c: ColumnOrName) -> Column:
    """The canonical given name; a name outside the dictionary is folded, w as v."""
    f = fold_ascii(strip(c))
    known = map_of(L.CANONICAL)
    return F.coalesce(F.try_element_at(known, f), F.try_element_at(known, old_orthography(f)), old_orthography(f))


def given_norm_in_context(c: ColumnOrName, genitive: Column, sex: Column) -> Column:
    """given_norm, with the genitives of men's names first where a man's genitive is meant."""
    f, man = fold_ascii(strip(c)), genitive & (sex == "m")
    known, of_man = map_of(L.CANONICAL), map_of(L.MALE_GENITIVE)
    tries = [x for form in (f, old_orthography(f)) for x in (F.when(man, F.try_element_at(of_man, form)), F.try_element_at(known, form))]
    return F.coalesce(*tries, old_orthography(f))


def sex_from_given(c: ColumnOrName) -> Column:
    """m, f or '' by the dictionary, then by the ending."""
    g = given_norm(c)
    return F.coalesce(F.try_element_at(map_of(L.GIVEN_SEX), g), F.when(_ends(g, "a", "ie"), "f"), F.lit(""))


def nominative_given(c: ColumnOrName, genitive: Column, sex: Column) -> Column:
    """The given name as it is written, if it is known."""
    return F.coalesce(F.try_element_at(map_of(L.WRITTEN), given_norm_in_context(c, genitive, sex)), col(c))


def nominative_surname(c: ColumnOrName) -> Column:
    """The nominative of a surname's genitive, diacritics kept."""
    s = col(c)
    n = F.length(s)
    cut = lambda k, end="": F.concat(F.substring(s, F.lit(1), n - k), F.lit(end))
    return (
        F.when((n > 3) & _ends(s, "ové"), cut(3, "ová"))
        .when((n > 3) & _ends(s, "ého"), cut(3, "ý"))
        .when((n > 3) & _ends(s, "eho"), cut(3, "y"))
        .when((n > 4) & _ends(s, "a"), cut(1))
        .when((n > 4) & _ends(s, "y"), cut(1, "a"))
        .otherwise(s)
    )


def feminize_surname(c: ColumnOrName) -> Column:
    """A man's surname as his wife or daughter bears it."""
    s = col(c)
    f, n = fold_ascii(s), F.length(s)
    cut = lambda end: F.concat(F.substring(s, F.lit(1), n - 1), F.lit(end))
    return (
        F.when((s == "") | _ends(f, "ova") | _ends(s, "á"), s)
        .when((n > 2) & _ends(s, "ý") | (n > 3) & _ends(f, "sky", "cky"), cut("á"))
        .when((n > 2) & _ends(s, "a"), cut("ová"))
        .otherwise(F.concat(s, F.lit("ová")))
    )


def place_norm(c: ColumnOrName) -> Column:
    """One form for the cases of a place name."""
    return F.regexp_replace(old_orthography(fold_ascii(strip(c))), "^(.{3,})[aeiouy]$", "$1")


# A house number, and the second person of a list.
HOUSE = r"(?:č|c)\.?\s*(?:p|d)?\.?\s*(\d+)|(?<![A-Za-z0-9_])čp\.?\s*(\d+)"


def split_place_house(c: ColumnOrName) -> Column:
    """struct(place, house): the text before the house number, and the number."""
    s = strip(c)
    whole = F.regexp_extract(s, HOUSE, 0)
    place = F.when(whole == "", s).otherwise(strip(F.split_part(s, F.when(whole == "", F.lit(" ")).otherwise(whole), F.lit(1))))
    house = first_non_empty(F.regexp_extract(s, HOUSE, 1), F.regexp_extract(s, HOUSE, 2))
    return F.struct(F.btrim(place, F.lit(" ,.")).alias("place"), house.alias("house"))


LIST_AND = r"\s+a\s+(\p{Lu}\p{L}+\s+\p{Lu}\p{L}+)"


def split_people(c: ColumnOrName) -> Column:
    """The persons of a list cell in order: by ';', else at one ' a First Last', else the whole."""
    s = strip(c)
    by_mark = F.filter(F.transform(F.split(s, ";"), strip), lambda x: x != "")
    at = F.regexp_instr(s, F.lit(LIST_AND))
    after = F.substring(s, at, F.length(s))
    both = F.array(strip(F.substring(s, F.lit(1), at - 1)), F.regexp_replace(after, r"^\s+a\s+", ""))
    return F.when(s == "", F.array().cast("array<string>")).when(F.contains(s, F.lit(";")), by_mark).when(at > 0, both).otherwise(F.array(s))


def status_of(c: ColumnOrName) -> Column:
    """The marital status that a whole cell names, or null."""
    return F.try_element_at(map_of(L.STATUS), fold_ascii(strip(c)))


def leading_int(c: ColumnOrName) -> Column:
    """The number that a text starts with, or null."""
    return F.regexp_extract(strip(c), "^([0-9]+)", 1).try_cast("int")


def first_number(c: ColumnOrName) -> Column:
    """The first number in a text, or null."""
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"([0-9]+)", 1).try_cast("int")


def char_error_rate(truth: ColumnOrName, got: ColumnOrName) -> Column:
    """Edits over the truth's length (one at least)."""
    t = F.coalesce(col(truth), F.lit(""))
    return F.levenshtein(t, F.coalesce(col(got), F.lit(""))) / F.greatest(F.lit(1), F.length(t))


def book_id_of(file_name: ColumnOrName) -> Column:
    """The digits in brackets of a file name, or its base name."""
    base = F.regexp_replace(F.regexp_replace(col(file_name), "^.*/", ""), r"\.[^.]*$", "")
    return first_non_empty(F.regexp_extract(col(file_name), r"\[(\d+)\]", 1), base)


def safe_file_name(c: ColumnOrName) -> Column:
    """Without characters that file systems refuse."""
    return F.btrim(F.regexp_replace(strip(c), r'[\\/:*?"<>|]+', "_"))


def relative_path(path: ColumnOrName, root: ColumnOrName) -> Column:
    """path below root, with '/'."""
    p, r = F.replace(col(path), F.lit("\\"), F.lit("/")), F.regexp_replace(F.replace(col(root), F.lit("\\"), F.lit("/")), "/+$", "")
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p))).otherwise(p)


def image_type(content: ColumnOrName) -> Column:
    """png, jpg, gif, webp or bin by the first bytes."""
    h = F.hex(F.substring(col(content), 1, 12))
    return (
        F.when(F.startswith(h, F.lit("89504E47")), "png").when(F.startswith(h, F.lit("FFD8FF")), "jpg").when(F.startswith(h, F.lit("47494638")), "gif")
        .when(F.startswith(h, F.lit("52494646")) & F.endswith(h, F.lit("57454250")), "webp").otherwise("bin")
    )


def content_hash(content: ColumnOrName, first: int | None = None) -> Column:
    """SHA-256 of a binary, or of its first bytes."""
    return F.sha2(col(content) if first is None else F.substring(col(content), 1, first), 256)


def clean_cell(html: ColumnOrName) -> Column:
    """A table cell's text: tags away, the common entities read, spaces joined, ' -' trimmed."""
    s = F.regexp_replace(F.coalesce(col(html), F.lit("")), "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(s, f"{SPACE}+", " "), F.lit(" -"))


def years_label(birth: ColumnOrName, death: ColumnOrName) -> Column:
    """'*1876 †1903', either alone, or ''."""
    return F.concat_ws(" ", F.concat(F.lit("*"), col(birth).cast("string")), F.concat(F.lit("†"), col(death).cast("string")))


def month_label(c: ColumnOrName) -> Column:
    """The short name of a month; another number as text."""
    return F.coalesce(F.get(F.array(*map(F.lit, L.MONTH_LABELS)), col(c).cast("int")), col(c).cast("string"))


def wrapped(text: ColumnOrName, width: int) -> Column:
    """Lines of at most width characters, cut at the last space in their second half, or at width."""

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        back = F.instr(F.reverse(F.substring(rest, 1, width)), " ")
        cut = F.when((back > 0) & (width - back > width // 2), width - back).otherwise(width)
        more = F.struct(F.regexp_replace(F.substring(rest, cut + 1, F.length(rest)), f"^{SPACE}+", "").alias("rest"), F.concat(state["out"], F.array(F.substring(rest, F.lit(1), cut))).alias("out"))
        return F.when(F.length(rest) > width, more).otherwise(state)

    s = F.coalesce(col(text), F.lit(""))
    start = F.struct(s.alias("rest"), F.array().cast("array<string>").alias("out"))
    steps = F.sequence(F.lit(0), F.floor(F.length(s) / (width // 2 + 1)).cast("int"))
    return F.aggregate(steps, start, step, lambda x: F.concat(x["out"], F.array(x["rest"])))

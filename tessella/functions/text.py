"""Text expressions: normal forms, words, n-grams, hashes, scripts.

Regular expressions carry ``(?U)`` so that classes are those of Unicode.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Commands of LaTeX that the normal form drops.
LATEX_COMMANDS = ("text", "mathrm", "mathbf", "frac", "sqrt", "left", "right", "begin", "end")
LATEX = r"\\(?:" + "|".join(LATEX_COMMANDS) + r")\b"
SPACES = r"(?U)\s+"
#: White space that may stand at the ends of a text: the ASCII blanks and separators and those of Unicode.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: What the CJK repair replaces, in the order of its steps.
LEAKED_WORDS = {"호텔": "hotel"}
FULLWIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
ASCII_OF_FULLWIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
IDEOGRAPHIC_MARKS, ASCII_OF_MARKS = "　、。〃", ' ,."'
OTHER_MARKS = "[　-〿＀｟-￯]"
IDEOGRAPHS = "[一-鿿㐀-䶿぀-ゟ゠-ヿ가-힯]"
#: Ideographs and kana; Hangul is not among them.
CJK = "[一-鿿぀-ゟ゠-ヿ]"


@F.pandas_udf(StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def nfkd(text: Column) -> Column:
    """Compatibility decomposition; pure ASCII stays in the JVM and is handed to Python as null."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, text).otherwise(_nfkd(F.when(~ascii_only, text)))


def strip(text: Column) -> Column:
    """Without the white space at both ends, of whatever kind."""
    return F.trim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normal_form(text: Column, decompose: bool = True) -> Column:
    """For n-grams: NFKD, lower case, LaTeX commands to blanks, white space squeezed."""
    text = nfkd(text) if decompose else text
    return squeeze(F.regexp_replace(F.lower(text), "(?U)" + LATEX, " "))


def dedup_form(text: Column, decompose: bool = True) -> Column:
    """As ``normal_form`` but LaTeX stays."""
    return squeeze(F.lower(nfkd(text) if decompose else text))


def words(text: Column) -> Column:
    """What stands between white space; no empty ones."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def digest(text: Column, size: int = 64) -> Column:
    """SHA-256 in hexadecimal, its first ``size`` digits."""
    return F.substring(F.sha2(text, 256), 1, size)


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def _spread(counts: dict[str, Column]) -> Column:
    return F.struct(*[c.cast("long").alias(name) for name, c in counts.items()])


def repair_cjk(text: Column) -> Column:
    """Leaked words, fullwidth forms and ideographic marks become ASCII; other CJK marks and characters go."""
    for word, plain in LEAKED_WORDS.items():
        text = F.replace(text, F.lit(word), F.lit(plain))
    text = F.translate(F.translate(text, FULLWIDTH, ASCII_OF_FULLWIDTH), IDEOGRAPHIC_MARKS, ASCII_OF_MARKS)
    return F.regexp_replace(F.regexp_replace(text, OTHER_MARKS, ""), IDEOGRAPHS, "")


def cjk_changes(text: Column) -> Column:
    """How many characters of each class ``repair_cjk`` changes."""
    leaks = [F.regexp_count(text, F.lit(w)) for w in LEAKED_WORDS]
    rest = text
    for word in LEAKED_WORDS:
        rest = F.replace(rest, F.lit(word), F.lit(""))
    return _spread(
        {
            "fullwidth_ascii": F.regexp_count(rest, F.lit("[！-～]")),
            "explicit_punct": F.regexp_count(rest, F.lit(f"[{IDEOGRAPHIC_MARKS}]")),
            "other_cjk_punct": F.regexp_count(rest, F.lit("[〄-〿＀｟-￯]")),
            "ideograph": F.regexp_count(rest, F.lit(IDEOGRAPHS)),
            "multichar_leak": sum(leaks[1:], leaks[0]),
        }
    )


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def tail_chars(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def tail_words(text: Column, n: int) -> Column:
    """The last ``n`` words, all if there are fewer."""
    found = words(text)
    return F.slice(found, F.greatest(F.size(found) - n + 1, F.lit(1)), F.lit(n))


def fill(template: Column | str, **values: Column) -> Column:
    """``{{name}}`` in the template becomes the value; null counts as empty."""
    text = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return text


def first_of(*values: Column, default: str | None = None) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], *([F.lit(default)] if default is not None else []))

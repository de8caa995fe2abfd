"""Text kernels as Column expressions: the whole of them runs in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import RESIDENCE_WORDS

_SPACE = r"(?U)\s+"
#: Stands between words that are brought to their keys.
BETWEEN = "\x01"


@lru_cache(maxsize=1)
def _letters() -> tuple[str, str]:
    """Latin letters with diacritics and what they fold to, made from Unicode's decompositions."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source) + "đĐ", "".join(target) + "dD"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def fold(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(text, *_letters()), r"\p{Mn}", "")
    return F.replace(F.lower(plain), F.lit("ß"), F.lit("ss"))


def key(text: Column) -> Column:
    """Only [0-9a-z] of the folded text: what labels and anchors are matched on."""
    return F.regexp_replace(fold(text), "[^0-9a-z]", "")


clean_token = key


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def after_colon(text: Column) -> Column:
    at = F.instr(text, ":")
    return F.when(at > 0, empty_to_null(trim(F.substr(text, at + 1))))


def before_slash(text: Column) -> Column:
    return trim(F.substring_index(text, "/", 1))


def trailing_digit(text: Column) -> Column:
    return empty_to_null(F.regexp_extract(text, r"(\d)\s*$", 1))


def has_vietnamese(text: Column) -> Column:
    return text.rlike(r"[\p{L}&&[^\x00-\x7F]]")


# ---------------------------------------------------------------- dates

#: Fixed patterns of dates; the last is bounded by anything that is no letter, digit or underscore.
_COMPACT = r"(\d{1,2})[\s\-/.]+(\d{1,2})[\s\-/.]+(\d{4})"
_PHRASE = r"(?iu)ng[àa]y\D{0,10}?([0-9lio]{1,2})\D{0,10}?th[áa]ng\D{0,10}?([0-9lio]{1,2})\D{0,10}?n[ăa]m\D{0,10}?(\d{4})"
_LOOSE = r"(?:^|[^\p{L}\p{N}_])([0-9liIoO]{1,2})\D*?[A-Za-zÀ-ỹ]\D*?([0-9liIoO]{1,2})\D*?(\d{4})(?:$|[^\p{L}\p{N}_])"


def fix_date_digits(text: Column) -> Column:
    return F.translate(text, "lLIioO", "111100")


def _iso(match: Column, pattern: str) -> Column:
    """The date that a pattern's match, or a text, says; null where it is no date, or no match."""

    def date(found: Column) -> Column:
        d, m, y = (found[c] for c in "dmy")
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        return F.when(m.between(1, 12) & d.between(1, 31) & y.between(1900, 2100), F.concat_ws("-", y.cast("string"), two(m), two(d)))

    return let(F.struct(*(fix_date_digits(F.regexp_extract(match, pattern, i)).try_cast("int").alias(c) for i, c in enumerate("dmy", 1))), date)


def _dated(text: Column, find: Callable[[Column], Column]) -> Column:
    """find(text) where the four digits stand that every pattern ends in; most lines have none."""
    return F.when(text.rlike("[0-9]{4}"), find(text))


def _matched(text: Column, pattern: str, otherwise: Callable[[], Column] | None = None) -> Column:
    """The date of the first match of a pattern: the text is searched once, its parts are read from the match."""

    def read(match: Column) -> Column:
        found = F.when(match != "", _iso(match, pattern))
        return found.otherwise(otherwise()) if otherwise else found

    return let(F.regexp_extract(text, pattern, 0), read)


def find_date(text: Column) -> Column:
    return _dated(text, lambda t: _matched(t, _COMPACT))


def find_date_phrase(text: Column) -> Column:
    """The exact phrase decides if it stands there, even if what it says is no date."""
    return _dated(text, lambda t: _matched(t, _PHRASE, lambda: _matched(t, _LOOSE)))


def to_iso(text: Column) -> Column:
    return F.coalesce(find_date(text), find_date_phrase(text))


# ---------------------------------------------------------------- normalisers


def collapse_spaces(text: Column) -> Column:
    return trim(F.regexp_replace(text, _SPACE, " "))


#: All letters with diacritics that fold are in this range; what is out of it, most of a text, is told by one comparison.
_ACCENTED = r"\u00C0-\u1EFF"


@lru_cache(maxsize=1)
def _spellings() -> tuple[dict[str, str], str]:
    """Of each letter a class of all that fold to it, and a class of what words have that folds to nothing."""
    of = dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "")
    for letter, plain in zip(*_letters(), strict=True):
        if plain.lower() in of:
            of[plain.lower()] += letter
    known = {*"".join(of.values()), "ß", "ẞ"}
    silent = [c for c in map(chr, range(ord("À"), ord("ỹ") + 1)) if c not in known]
    runs = [[c for _, c in run] for _, run in groupby(enumerate(silent), lambda at: ord(at[1]) - at[0])]
    classes = {c: f"[{c}{c.upper()}[{_ACCENTED}&&[{letters}]]]" if letters else f"[{c}{c.upper()}]" for c, letters in of.items()}
    return classes, f"[{_ACCENTED}&&[" + "".join(f"{run[0]}-{run[-1]}" for run in runs) + "]]"


def spelled(key_letters: str, between: str) -> str:
    """A pattern of the texts that fold to a key, with what may stand between its letters."""
    return between.join(_spellings()[0].get(c, c) for c in key_letters)


def _word_pattern(*keys: str) -> str:
    silent = _spellings()[1] + "*+"
    return silent + "(?:" + "|".join(spelled(k, silent) for k in keys) + ")" + silent


def norm_sex(text: Column) -> Column:
    """By the first word that says one; `nam` after `viet` is part of a country's name.

    Letters are looked for in all their spellings, for to fold every line costs more than the search.
    """
    letter = "[0-9A-Za-zÀ-ỹ]"
    says = f"(?<!{letter})(?:({_word_pattern('female', 'f', 'nu')})|({_word_pattern('male', 'm', 'nam')}))(?!{letter})"
    country = f"(?<!{letter}){_word_pattern('viet')}[^0-9A-Za-zÀ-ỹ]++{_word_pattern('nam')}(?!{letter})"
    first = lambda t: F.when(F.regexp_extract(t, says, 1) != "", F.lit("Nữ")).when(F.regexp_extract(t, says, 2) != "", F.lit("Nam")).otherwise("")
    return F.when(text.rlike(says), let(F.regexp_replace(text, country, " "), first)).otherwise("")


def sex_from_id(number: Column) -> Column:
    return F.when(number.rlike(r"^[0-9]{12}\z"), F.when(F.substring(number, 4, 1).cast("int") % 2 == 0, "Nam").otherwise("Nữ"))


def strip_residence_label_echo(text: Column) -> Column:
    """Drop leading words that resemble the label's words; nothing where none does, or where all do."""
    words = F.filter(F.split(trim(text), _SPACE), lambda w: w != "")
    keys = F.transform(words, key)
    like = lambda w: reduce(lambda a, b: a | b, (F.levenshtein(w, F.lit(label), 2 if label == "thuong" else 1) >= 0 for label in RESIDENCE_WORDS))
    kept = F.filter(F.transform(keys, lambda w, i: F.when((w == "") | like(w), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    first = F.get(kept, 0)
    rest = F.regexp_replace(F.array_join(F.slice(words, first + 1, F.size(words)), " "), r"^[ ,]+|[ ,]+$", "")
    return F.when(first.isNull() | (first == 0), text).otherwise(rest)


#: Name -> Column function; users may add to it.
NORMALIZERS = {
    "trim": trim,
    "collapseSpaces": collapse_spaces,
    "removeSpaces": lambda c: F.regexp_replace(c, _SPACE, ""),
    "digitsOnly": lambda c: F.regexp_replace(c, r"\D", ""),
    "upperVi": F.upper,
    "fixDigits": lambda c: F.translate(c, "OoIl|BSZ", "00111852"),
    "stripDots": lambda c: collapse_spaces(F.regexp_replace(c, r"[·…]+|\.{2,}", " ")),
    "normSex": norm_sex,
    "toIsoDate": lambda c: F.coalesce(to_iso(c), c),
    "dictFix": lambda c: c,
    "beforeSlash": before_slash,
    "stripResidenceLabelEcho": strip_residence_label_echo,
    "dotSeparator": lambda c: F.regexp_replace(trim(c), r"(?U)(\d)[^\w]+(\d)", "$1.$2"),
    "stripEdgeNonDigits": lambda c: F.regexp_replace(c, r"^\D+|\D+$", ""),
}


def apply_normalizers(text: Column, names: Sequence[str]) -> Column:
    return reduce(lambda c, n: NORMALIZERS[n](c) if n in NORMALIZERS else c, names, text)


def post_process(text: Column, kind: str, names: Sequence[str] = ()) -> Column:
    value = trim(text)
    if kind == "date":
        value = F.coalesce(to_iso(value), value)
    elif kind == "sex":
        value = norm_sex(value)
    return apply_normalizers(value, names)


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(rf"^(?:{pattern})\z") if "$" not in pattern else text.rlike("^(?:" + pattern.replace("$", r"\z") + r")\z")


# ---------------------------------------------------------------- codes


def hex_to_text(text: Column) -> Column:
    """UTF-8 text of an even number of hex digits; null for anything else."""
    fits = (F.length(text) % 2 == 0) & text.rlike(r"^[0-9a-fA-F]+\z")
    return F.when(fits, F.try_validate_utf8(F.unhex(text)))


def pipe_field(parts: Column, index: int) -> Column:
    """The part at a 0-based index without white space and NULs; null for '' and '-'."""
    value = F.regexp_replace(F.try_element_at(parts, F.lit(index + 1)), r"(?U)^[\s\x00]+|[\s\x00]+$", "")
    return F.nullif(empty_to_null(value), F.lit("-"))


def ddmmyyyy(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{8}\z"), F.concat_ws("/", F.substring(text, 1, 2), F.substring(text, 3, 2), F.substring(text, 5, 4))).otherwise(text)


def yymmdd(text: Column, expiry: bool = False) -> Column:
    """dd/MM/yyyy; an expiry is in this century, and so is a birth up to the year 30."""
    yy = F.substring(text, 1, 2).try_cast("int")
    century = F.lit(2000) if expiry else F.when(yy <= 30, 2000).otherwise(1900)
    return F.when(text.rlike(r"^[0-9]{6}\z"), F.concat_ws("/", F.substring(text, 5, 2), F.substring(text, 3, 2), (century + yy).cast("string")))


def mrz_name(line: Column) -> Column:
    part = lambda c: F.trim(F.translate(c, "<", " "))
    at = F.instr(line, "<<")
    return F.trim(F.when(at > 0, F.concat_ws(" ", part(F.substr(line, F.lit(1), at - 1)), part(F.substr(line, at + 2)))).otherwise(part(line)))


def check_digit(text: Column) -> Column:
    """The last digit of the 7-3-1 weighted sum of a machine-readable string, as a string; any other character counts 0."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).otherwise(0)
    weight = lambda i: F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1)
    terms = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: value(c) * weight(i))
    return (F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10).cast("string")

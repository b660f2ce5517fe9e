"""Name and document normalization, and the features of a name.

Everything here is a built-in column expression, so it stays on the JVM. The two code-point
tables are derived from ``unicodedata`` by rule when first used.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwarden.config import DEFAULT, ScreeningConfig

HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3


def _base_letters(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")


@functools.lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """(composed letters, their base letters) for 1:1 cases, and a map for the few 1:n cases."""
    source, target, several = [], [], {}
    for point in range(0x80, 0x30000):
        if 0xD800 <= point <= 0xDFFF or HANGUL_FIRST <= point <= HANGUL_LAST:
            continue
        ch = chr(point)
        if unicodedata.category(ch) in ("Cn", "Mn"):
            continue
        base = _base_letters(ch)
        if base == ch:
            continue
        if len(base) == 1:
            source.append(ch)
            target.append(base)
        else:
            several[ch] = base
    return "".join(source), "".join(target), several


def _jamo(first: int, count: int) -> Column:
    return F.lit("".join(chr(first + i) for i in range(count)))


def _split_hangul(ch: Column) -> Column:
    """One Hangul syllable as its two or three letters (the arithmetic rule of the Unicode standard)."""
    index = F.ascii(ch) - F.lit(HANGUL_FIRST)
    lead = F.substr(_jamo(0x1100, 19), F.floor(index / 588).cast("int") + 1, F.lit(1))
    vowel = F.substr(_jamo(0x1161, 21), F.floor(F.pmod(index, F.lit(588)) / 28).cast("int") + 1, F.lit(1))
    tail_no = F.pmod(index, F.lit(28))
    tail = F.when(tail_no > 0, F.substr(_jamo(0x11A8, 27), tail_no, F.lit(1))).otherwise(F.lit(""))
    return F.concat(lead, vowel, tail)


def strip_marks(text: Column) -> Column:
    """Canonical decomposition without non-spacing marks."""
    source, target, several = _decompositions()
    rare = "[가-힣" + "".join(several) + "]"
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])

    def one(ch: Column) -> Column:
        hangul = ch.between(chr(HANGUL_FIRST), chr(HANGUL_LAST)) & (F.length(ch) == 1)
        return F.when(hangul, _split_hangul(ch)).otherwise(F.coalesce(F.try_element_at(table, ch), ch))

    expanded = F.when(
        text.rlike(rare), F.array_join(F.transform(F.split(text, ""), one), "")
    ).otherwise(text)
    return F.regexp_replace(F.translate(expanded, source, target), r"\p{Mn}+", "")


def normalize_name(name: Column) -> Column:
    """Accents and punctuation removed, blanks collapsed, upper case; '' for null."""
    ascii_only = F.octet_length(name) == F.length(name)
    simple = F.regexp_replace(name, "[^A-Za-z0-9_]+", " ")
    full = F.regexp_replace(strip_marks(name), r"[^\p{L}\p{N}_]+", " ")
    return F.coalesce(F.trim(F.upper(F.when(ascii_only, simple).otherwise(full))), F.lit(""))


def name_key(normalized: Column) -> Column:
    """Words of a normalized name in sorted order: names with equal keys score 100."""
    return F.array_join(F.sort_array(F.split(normalized, " ")), " ")


def normalize_document(number: Column) -> Column:
    """Blanks and ``- . , /`` removed, upper case; '' for null."""
    return F.coalesce(F.upper(F.regexp_replace(number, r"(?U)[\s\-.,/]+", "")), F.lit(""))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed one time, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Code point ranges of the scripts, and the letters outside of them.
SCRIPTS = [
    ("chinese", "[\u4e00-\u9fff]"),
    ("arabic", "[\u0600-\u06ff]"),
    ("cyrillic", "[\u0400-\u04ff]"),
    ("latin", "[\\p{L}&&[^\u4e00-\u9fff\u0600-\u06ff\u0400-\u04ff]]"),
]


def name_script(name: Column) -> Column:
    """The script of more than half of the letters, else 'mixed'; 'latin' without letters."""
    counts = F.array(*[F.regexp_count(name, F.lit(letters)) for _, letters in SCRIPTS])

    def dominant(n: Column) -> Column:
        total = n[0] + n[1] + n[2] + n[3]
        chosen = F.when(total == 0, "latin")
        for i, (script, _) in enumerate(SCRIPTS):
            chosen = chosen.when(n[i] * 2 > total, script)
        return chosen.otherwise("mixed")

    plain = F.octet_length(name) == F.length(name)
    return F.when(name.isNull() | plain, "latin").otherwise(once(counts, dominant))


def latin_initials(name: Column) -> Column:
    cleaned = F.regexp_replace(name, "[. ]", "")
    return (
        (F.length(cleaned) <= 4)
        & cleaned.rlike(r"^\p{L}+$")
        & (F.upper(cleaned) == cleaned)
        & (F.lower(cleaned) != cleaned)
    )


def short_name(name: Column) -> Column:
    """At most two words in fewer than ten characters, or any word of at most two."""
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    few = (F.size(words) <= 2) & (F.length(name) < 10)
    return few | F.exists(words, lambda w: F.length(w) <= 2)


def common_name(normalized: Column, config: ScreeningConfig = DEFAULT) -> Column:
    """Whether a normalized name is on the short configured list (a constant of the plan)."""
    if not config.common_names:
        return F.lit(False)
    return normalized.isin([normalize_literal(n) for n in config.common_names])


def normalize_literal(name: str) -> str:
    """The rule of ``normalize_name`` for one configured literal."""
    kept = "".join(c if c.isalnum() or c == "_" else " " for c in _base_letters(name))
    return " ".join(kept.split()).upper()


def adaptive_threshold(name: Column, config: ScreeningConfig = DEFAULT) -> Column:
    """struct(threshold, reason) for a short name."""

    def choice(threshold: float, reason: str) -> Column:
        return F.struct(
            F.lit(float(threshold)).alias("threshold"), F.lit(reason).alias("reason")
        )

    a = config.adaptive
    if not a.enabled:
        return choice(config.short_name_threshold, "default")

    def by_script(script: Column) -> Column:
        return (
            F.when(script == "chinese", choice(a.chinese, "chinese_name"))
            .when(script == "arabic", choice(a.arabic, "arabic_name"))
            .when(script == "cyrillic", choice(a.cyrillic, "cyrillic_name"))
            .otherwise(choice(config.short_name_threshold, "latin_default"))
        )

    initials = choice(a.latin_initials, "latin_initials")
    return F.when(latin_initials(name), initials).otherwise(once(name_script(name), by_script))


def dob_year(date_text: Column) -> Column:
    """The first run of four digits."""
    return F.nullif(F.regexp_extract(date_text, r"(\d{4})", 1), F.lit("")).try_cast("int")


def report_name(name: Column, at: Column) -> Column:
    """File name of a report: letters, digits, blank, ``-`` and ``_`` of the name, then the time."""
    safe = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""))
    return F.concat(F.lit("constancia_"), safe, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))

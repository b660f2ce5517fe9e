"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Positions are code points, end exclusive. For each kind the matches are the leftmost non-overlapping ones of its
pattern; a match that fails its check is dropped, and the search goes on behind it. The patterns are written with possessive
loops and start only where a run begins (or a match ended), so that they give the same matches
without deep recursion or rescanning of long runs.

The four base kinds always stay, whatever their score; the further kinds (iban by mod 97, ssn by its form) need ``least``.

An account number is followed by whatever stands there, so its pattern may run on into the next words. Each of its starts
is tried: first the part of the match that has the length of its country and ends with a word, then the whole match.

Cases: a null text counts as empty and has no spans. Rows come back one for one, so repeated rows repeat their result.
Spans of different kinds may overlap. An empty table gives an empty result. Texts are read whole. Further
columns are kept by ``redact`` and not read by ``detect``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAIL = r"[A-Za-z0-9._%+-]"
# kind: pattern, characters of which a text must hold one, score without context, context words
KINDS = {
    "email": (rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "", 0.9, "card|visa|pay"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5, "phone|call|tel|mobile"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "", 0.9, "iban|account|bank"),
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-", 0.3, "ssn|social|security"),
}
BASE = ["email", "ip", "card", "phone"]
#: Where an account number may start, and what shows the longest one there.
IBAN_START = r"\b[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
IBAN_REACH = 4 + 2 * 30 + 1
#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
NEAR = 40
LIFT = 0.4
LEAST = 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def part(i):
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether an account number without spaces leaves 1 by 97, its first four characters moved to the end."""
    turned = F.concat(F.substr(number, F.lit(5)), F.substring(number, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _confirmed(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


def _iban_length(m: Column) -> Column:
    known = F.create_map(*[F.lit(x) for n, codes in IBAN_LENGTHS.items() for code in codes.split() for x in (code, n)])
    return F.try_element_at(known, F.substring(m, 1, 2))


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _accounts(text: Column, starts: Column) -> Column:
    """Spans of the account numbers at ``starts``, without those that start inside an earlier one."""

    def reached(s):
        m = F.regexp_extract(F.substr(text, s["start"] + 1, F.lit(IBAN_REACH)), "^" + KINDS["iban"][0], 0)
        return F.struct(s["start"].alias("start"), m.alias("m"))

    def split(s):
        return F.struct(s["start"].alias("start"), s["m"].alias("m"), F.split(s["m"], " ").alias("words"), _iban_length(s["m"]).alias("length"))

    def parts(s):
        """The part of the country's length, if a word ends there, and the whole match."""
        heads = F.transform(F.sequence(F.lit(1), F.size(s["words"])), lambda j: F.slice(s["words"], F.lit(1), j))
        fits = F.filter(heads, lambda h: F.length(F.array_join(h, "")) == s["length"])
        tried = F.concat(F.transform(fits, lambda h: F.array_join(h, " ")), F.array(s["m"]))
        return F.struct(s["start"].alias("start"), F.get(F.filter(tried, lambda m: _confirmed("iban", m)), F.lit(0)).alias("m"))

    matches = F.filter(F.transform(starts, reached), lambda s: s["m"] != "")
    found = F.filter(F.transform(F.transform(matches, split), parts), lambda s: s["m"].isNotNull())
    spans = F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["m"])).alias("end"), s["m"].alias("m")))
    empty = F.array().cast("array<struct<start:int,end:int,m:string>>")
    behind = lambda done, s: F.coalesce(F.try_element_at(done, F.lit(-1))["end"] <= s["start"], F.lit(True))
    return F.aggregate(spans, empty, lambda done, s: F.when(behind(done, s), F.concat(done, F.array(s))).otherwise(done))


def _placed(kind: str, text: Column, matches: Column) -> Column:
    """Confirmed spans of one kind with their scores."""
    pattern, _, plain, near = KINDS[kind]
    pattern = IBAN_START if kind == "iban" else pattern
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    steps = F.zip_with(between, matches, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"), m.alias("m")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("spans"))

    def step(done, s):
        start = done["at"] + s["gap"]
        span = F.struct(start.alias("start"), (start + s["n"]).alias("end"), s["m"].alias("m"))
        return F.struct((start + s["n"]).alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    def scored(s):
        around = F.concat(
            F.substr(text, F.greatest(s["start"] - NEAR + 1, F.lit(1)), F.least(s["start"], F.lit(NEAR))), F.lit(" "),
            F.substr(text, s["end"] + 1, F.lit(NEAR)),
        )
        lifted = F.when(F.lower(around).rlike(rf"\b({near})\b"), F.least(F.lit(1.0), F.lit(plain + LIFT))).otherwise(F.lit(plain))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), lifted.alias("score"))

    spans = F.aggregate(steps, empty, step, lambda done: done["spans"])
    confirmed = _accounts(text, spans) if kind == "iban" else F.filter(spans, lambda s: _confirmed(kind, s["m"]))
    kept = F.transform(confirmed, scored)
    if kind not in BASE:
        kept = F.filter(kept, lambda s: s["score"] >= LEAST)
    return F.when(F.size(matches) > 0, kept.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _spans(docs: DataFrame) -> DataFrame:
    """``docs`` with _text (never null) and an array of spans for each kind."""
    text = F.col("_text")
    found = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    for kind, (pattern, holds, _, _) in KINDS.items():
        all_of = F.regexp_extract_all(text, F.lit(IBAN_START if kind == "iban" else pattern), F.lit(0))
        found = found.withColumn(f"_m_{kind}", F.when(F.contains(text, F.lit(holds)), all_of).otherwise(F.array().cast("array<string>")) if holds else all_of)
    return found.withColumns({f"_{kind}": _placed(kind, text, F.col(f"_m_{kind}")) for kind in KINDS})


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (as text), found (with scores)."""
    found = _spans(docs.select("doc_id", "text"))
    base = F.concat(*[F.col(f"_{k}") for k in BASE])
    every = F.concat(*[F.col(f"_{k}") for k in KINDS])
    return found.select(
        "doc_id", *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(_told(base), 256).alias("base_sha256"), _told(every).alias("spans"), every.alias("found"),
    )


def redact(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with every span of at least this score replaced by its kind in angle brackets; of overlapping spans
    the one that starts first, then the longer, stands."""
    found = _spans(docs)
    every = F.filter(F.concat(*[F.col(f"_{k}") for k in KINDS]), lambda s: s["score"] >= least)
    ordered = F.transform(
        F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["start"].alias("start"), (-s["minus_end"]).alias("end"), s["kind"].alias("kind")),
    )
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done, s):
        parts = F.array(F.substr(F.col("_text"), done["at"] + 1, s["start"] - done["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))
        after = F.struct(s["end"].alias("at"), F.concat(done["parts"], parts).alias("parts"))
        return F.when(s["start"] >= done["at"], after).otherwise(done)

    clean = F.aggregate(ordered, state, step, lambda d: F.concat(F.array_join(d["parts"], ""), F.substr(F.col("_text"), d["at"] + 1)))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), clean)).select(*docs.columns)

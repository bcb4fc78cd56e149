"""Personal data: patterns propose spans, checks confirm them, words nearby adjust the score.

Everything is a column expression. A kind's matches and the text between them (two passes of the
same pattern) give the spans in code points, without a search for the matched texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, without

# Patterns. Repetitions are possessive and a run of letters or digits is entered at
# its start only (or where the match before ended), which finds the same leftmost matches without
# trying every start of a long run and without deep recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# An account number's beginning; its end depends on the country (see account).
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
SSN = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
# Characters of an account number, and the countries whose numbers have so many.
IBAN_LENGTHS = {
    15: "NO", 16: "BE BI", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE",
    25: "LY PT ST", 26: "IS TR", 27: "DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
ACCOUNT_END = r"(?![A-Za-z0-9])"
ACCOUNT = "|".join(
    rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}{ACCOUNT_END}" for n, codes in IBAN_LENGTHS.items()
)
#: Code points from its start within which an account number ends: 34 characters with a blank before all but the first four.
ACCOUNT_REACH = 64
#: Code points before and after a span in which context words count.
NEAR = 40
KEEP_FROM = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: ``needs`` is a text without which there is no match."""

    name: str
    pattern: str
    needs: str
    base: float
    context: str
    kept: bool  # base kinds stay whatever their score


# Kinds in the order in which spans at one place are listed, with the score of a confirmed span
# and the words nearby that raise it.
KINDS = (
    Kind("email", EMAIL, r"@", 0.9, r"mail|contact|write|correo|courriel|schreib", True),
    Kind("ip", IP, r"[0-9]\.[0-9]", 0.6, r"\bip\b|addr|host|server|adresse|dirección", True),
    Kind("card", CARD, r"[0-9][\x20-]?[0-9]", 0.8, r"card|visa|master|credit|karte|carte|tarjeta", True),
    Kind("phone", PHONE, r"\+[0-9]", 0.7, r"phone|call|tel|fax|mobil|teléfono|anruf", True),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}", 0.7, r"iban|bank|account|konto|compte|cuenta", False),
    Kind("ssn", SSN, r"[0-9]-[0-9]", 0.3, r"ssn|social|security|tax|insurance", False),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.kept)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def mod97(s: Column) -> Column:
    """Whether an account number without blanks has the remainder 1 by 97 (first four characters last, A = 10)."""
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    step = lambda rest, c: (
        F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97
    )
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def account(text: Column, start: Column) -> Column:
    """The account number that starts at a place (null if none): as long as its country's are, never the words after it.

    With a code of no listed country it is the longest piece of 15 to 34 characters up to a word's end
    that passes the check.
    """
    ahead = F.substring(text, start + 1, F.lit(ACCOUNT_REACH + 1))
    fixed = F.regexp_extract(ahead, f"^(?:{ACCOUNT})", 0)
    listed_code = ahead.rlike(rf"^(?:{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})")
    # the words that may belong to it, then its beginnings up to each word's end
    run = F.regexp_extract(ahead, r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])*" + ACCOUNT_END, 0)
    words = F.split(run, " ")
    pieces = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    passing = F.filter(pieces, lambda p: confirmed("iban", p))
    return F.when(listed_code, F.when(confirmed("iban", fixed), fixed)).otherwise(F.get(passing, F.lit(0)))


def accounts(text: Column, placed: Column) -> Column:
    """Beginnings of account numbers to whole ones; one that starts inside another is part of it."""
    whole = F.filter(F.transform(placed, lambda x: F.struct(account(text, x["start"]).alias("m"), x["start"].alias("start"))), lambda x: x["m"].isNotNull())
    spans = F.transform(whole, lambda x: F.struct(x["m"], x["start"], (x["start"] + F.length(x["m"])).alias("end")))
    none = F.array().cast("array<struct<m:string,start:int,end:int>>")

    def apart(so_far: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(so_far, F.lit(-1))["end"], F.lit(0))
        return F.when(x["start"] >= last, F.concat(so_far, F.array(x))).otherwise(so_far)

    return F.aggregate(spans, none, apart)


def confirmed(kind: str, match: Column) -> Column:
    """The kind's check of a match."""
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(bare).between(15, 34) & mod97(bare)
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def spans_of(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind: array of (start, kind, end, score), with ``at``, the kind's place.

    The pieces between matches and the matches take turns, so the k-th match starts after the
    lengths of the first k pieces and k - 1 matches.
    """
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    lengths = F.zip_with(between, found, lambda b, m: F.struct(m.alias("m"), F.length(b).alias("gap"), F.length(m).alias("len")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<m:string,start:int,end:int>>").alias("spans"))

    def add(so_far: Column, x: Column) -> Column:
        begin = so_far["end"] + x["gap"]
        span = F.struct(x["m"].alias("m"), begin.alias("start"), (begin + x["len"]).alias("end"))
        more = F.when(x["m"].isNull(), so_far["spans"]).otherwise(F.concat(so_far["spans"], F.array(span)))
        return F.struct(F.coalesce(begin + x["len"], begin).alias("end"), more.alias("spans"))

    placed = F.aggregate(lengths, start, add, lambda x: x["spans"])
    right = accounts(text, placed) if kind.name == "iban" else F.filter(placed, lambda x: confirmed(kind.name, x["m"]))

    def scored(x: Column) -> Column:
        left = F.greatest(x["start"] - NEAR, F.lit(0))
        near = F.concat_ws(
            " ", F.substring(text, left + 1, x["start"] - left), F.substring(text, x["end"] + 1, F.lit(NEAR))
        )
        helped = F.lower(near).rlike(kind.context)
        score = F.when(helped, F.lit(kind.base + (1 - kind.base) * 0.7)).otherwise(F.lit(kind.base))
        return F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("at"), F.lit(kind.name).alias("kind"),
            x["end"].alias("end"), F.round(score, 3).alias("score"),
        )

    out = F.transform(right, scored)
    out = out if kind.kept else F.filter(out, lambda x: x["score"] >= KEEP_FROM)
    return F.when(text.rlike(kind.needs), out)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Every row with ``out``: array of (start, kind, end, score) sorted by start, then kind.

    Starts and ends count code points, the end is exclusive. E-mail addresses, IP addresses (parts
    up to 255), card numbers (12 to 19 digits, Luhn) and phone numbers (9 to 15 digits) stay whatever
    their score; account numbers (IBAN: mod 97) and social security numbers (only beside a context
    word) are kept from a score of 0.5. An account number ends where its country's length says, whatever
    follows. A match that fails its check is dropped and not tried again
    in part. Spans of different kinds may overlap.

    A map over rows: no shuffle, no state; a row needs memory for its own text and spans.

    Defined cases: null and empty texts have no spans (an empty array); a result column replaces an
    input column of its name; repeated rows are found alike; an empty table gives no rows.
    """
    [whole] = fresh([*docs.columns, out], "whole")
    rows = docs.withColumn(whole, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    none = F.array().cast("array<struct<start:int,at:int,kind:string,end:int,score:double>>")
    found = F.concat(*[F.coalesce(spans_of(F.col(whole), k), none) for k in KINDS])
    plain = F.transform(
        F.array_sort(found), lambda x: F.struct(x["start"], x["kind"], x["end"], x["score"])
    )
    return rows.withColumn(out, plain).select(*[f"`{c}`" for c in without(docs.columns, out)], out)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def summary(found: DataFrame, key: str = "doc_id", spans: str = "pii") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    base = F.filter(F.col(spans), lambda x: x["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col(spans), lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select(key, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans"))

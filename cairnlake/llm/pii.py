"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Each kind is a row of KINDS: a pattern, a validator of the matched string, a score by
itself, and context words that raise the score when one stands within CONTEXT characters
before or after the span; words that tell an example from the real thing lower it. Spans of
the kinds that the method adds are reported if their score reaches THRESHOLD: an IBAN (country
length and mod-97, in one run or in groups of four), a US social security number (only with
context) and a credential (a cloud access key, or hexadecimal digits right after a context
word). Spans of the base kinds (email, ip, card, phone) are reported whenever their validator
agrees, and carry their score. Scores are per cent.

Positions come from splitting the text by the same pattern: pieces and matches alternate, so
that their lengths add up to the starts. Everything is one projection of built-in functions;
a kind's steps are taken only for texts in which its pattern is found.

The patterns differ from the plain ones only in what they refuse to try again: a run of
characters that can't begin a match at its first character can't at a later one, so that
very long runs take linear time. \\G keeps the rest of a run that an earlier match ended in.

Cases: a null or empty text has no spans; overlapping spans of different kinds are all
reported; repeated rows are reported alike; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

CONTEXT, THRESHOLD = 40, 60
RAISED, LOWERED, DOUBT = 50, 30, "example|sample|dummy|placeholder"
#: Matches whose running sums are made together.
BLOCK = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    # Leading zeros don't count; a part of more than three digits is above 255.
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).try_cast("int") <= 255))


def _card_ok(m: Column) -> Column:
    return let(_digits(m), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


#: The length of an IBAN of each country.
IBAN_LENGTHS = """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27
GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24
ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24
TR26 UA29 VA22 VG24 XK20
""".split()


def _iban_taken(m: Column) -> Column:
    """The match without groups that follow an IBAN of its country's length; as it is for unknown countries."""
    own = F.filter(F.array(*map(F.lit, IBAN_LENGTHS)), lambda x: x.startswith(F.substring(m, 1, 2)))
    n = F.substring(F.get(own, F.lit(0)), 3, 2).cast("int")
    spaced = n + F.floor((n - 1) / 4).cast("int")
    return F.when(m.contains(" ") & (F.length(m) > spaced) & (m.substr(spaced + 1, F.lit(1)) == " "), m.substr(F.lit(1), spaced)).otherwise(m)


def _iban_ok(m: Column) -> Column:
    """Country and check digits go to the end, letters become 10 to 35, and the rest mod 97 is 1."""
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: let(code(c), lambda v: (F.when(v < 10, a * 10).otherwise(a * 100) + v) % 97)

    def one(plain: Column) -> Column:
        moved = F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4))
        right = ~F.exists(F.array(*map(F.lit, IBAN_LENGTHS)), lambda x: x.startswith(F.substring(plain, 1, 2)) & (F.substring(x, 3, 2).cast("int") != F.length(plain)))
        return F.length(plain).between(15, 34) & right & (F.aggregate(F.split(moved, "(?<=.)(?=.)"), F.lit(0), step) == 1)

    return let(F.replace(m, F.lit(" "), F.lit("")), one)


def _always(m: Column) -> Column:
    return m.isNotNull()


def _as_is(m: Column) -> Column:
    return m


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: int
    context: str = "(?!)"  # alternatives of a pattern, in lower case, before or after the span
    adjacent: str = "(?!)"  # the same, right before the span
    needs: str = "[0-9]"  # a shorter pattern, or plain text in FIXED, that every text with a match holds
    taken: Callable[[Column], Column] = _as_is


_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
_ALONE = r"(?<![A-Za-z0-9_]){}(?![A-Za-z0-9_])"
BASE = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", _always, 90, "mail|contact", needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip_ok, 60, "(^|[^a-z0-9])ip([^a-z0-9]|$)|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card_ok, 70, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone_ok, 60, "phone|tel|mobile|call|fax", needs="+"),
)
ADDED = (
    Kind("iban", _ALONE.format(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"), _iban_ok, 80, "iban|account|bank|konto", taken=_iban_taken),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", _always, 30, "(^|[^a-z0-9])ssn([^a-z0-9]|$)|social security"),
    Kind("credential", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,128}+)(?![A-Za-z0-9])", _always, 20, adjacent=r"(password|passwd|token|secret|api[_ -]?key)[^A-Za-z0-9_]{0,4}$", needs="[0-9a-f]{16}|AKIA"),
)
FIXED = ("@", "+")
KEY_SCORE = 90  # of a cloud access key, whatever stands around it
KINDS = BASE + ADDED
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:int>>"


def _score(kind: Kind, text: Column, start: Column, match: Column) -> Column:
    before = F.lower(F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
    after = F.lower(F.substring(text, start + F.length(match) + 1, F.lit(CONTEXT)))
    hit = before.rlike(kind.adjacent) | before.rlike(kind.context) | after.rlike(kind.context)
    doubt = before.rlike(DOUBT) | after.rlike(DOUBT)
    own = F.when(match.startswith("AKIA"), F.lit(KEY_SCORE)).otherwise(F.lit(kind.score)) if kind.name == "credential" else F.lit(kind.score)
    return F.least(F.lit(100), own + F.when(hit, F.lit(RAISED)).otherwise(F.lit(0))) - F.when(doubt, F.lit(LOWERED)).otherwise(F.lit(0))


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    def placed(matches: Column) -> Column:
        def from_gaps(gaps: Column) -> Column:
            pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
            return let(F.filter(pairs, lambda p: p["m"].isNotNull()), from_pairs)

        def from_pairs(pairs: Column) -> Column:
            # Running sums in blocks: copying the result so far stays cheap with many matches.
            blocks = F.transform(F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(BLOCK)), lambda c: F.slice(pairs, c + 1, F.lit(BLOCK)))
            return let(blocks, from_blocks)

        def from_blocks(blocks: Column) -> Column:
            # The state is the end of the last match; each step adds the gap before a match.
            one = lambda acc, x: F.struct(
                (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), x["m"].alias("m")))).alias("out"),
            )
            total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["g"] + F.length(x["m"])))
            none = F.array().cast("array<struct<start:int,m:string>>").alias("out")

            def runs(totals: Column) -> Column:
                before = lambda i: F.aggregate(F.slice(totals, 1, i), F.lit(0), lambda a, x: a + x)
                return F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, F.struct(before(i).alias("at"), none), one)["out"]))

            return let(total, runs)

        return let(F.split(text, kind.pattern, -1), from_gaps)

    every = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), placed)
    if kind.taken is not _as_is:
        every = F.transform(every, lambda s: F.struct(s["start"].alias("start"), kind.taken(s["m"]).alias("m")))
    found = F.filter(every, lambda s: kind.valid(s["m"]))
    scored = F.transform(
        found,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (s["start"] + F.length(s["m"])).alias("end"), _score(kind, text, s["start"], s["m"]).alias("score")),
    )
    none = F.array().cast(SPAN)
    kept = scored if rank < len(BASE) else F.filter(scored, lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(kind.pattern), kept.cast(SPAN)).otherwise(none)


def pii_spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """All spans of a text: start, kind, end (exclusive) and score, by start, then kind as listed. The base kinds come first in kinds.

    What a match can't do without is looked for first, once for all kinds that need the same.
    """
    found = []
    for need in dict.fromkeys(kind.needs for kind in kinds):
        own = F.concat(*[_spans(text, k, kind) for k, kind in enumerate(kinds) if kind.needs == need])
        found.append(F.when(text.contains(need) if need in FIXED else text.rlike(need), own).otherwise(F.array().cast(SPAN)))
    return F.sort_array(F.concat(*found))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every document."""
    return docs.select("doc_id", pii_spans(F.coalesce("text", F.lit(""))).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlaps are masked once."""
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out")),
    ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def count(s: Column, name: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")

    def digest(s: Column) -> Column:
        base = F.filter(s, lambda x: x["rank"] < len(BASE))
        counted = [count(s, k.name) for k in BASE]
        added = [count(s, k.name) for k in ADDED]
        scores = F.array_join(F.transform(s, lambda x: x["score"].cast("string")), ",")
        return F.struct(*counted, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(s).alias("spans"), *added, F.size(s).cast("long").alias("n_spans"), scores.alias("scores"))

    return found.select("doc_id", let(F.col("spans"), digest).alias("d")).select("doc_id", "d.*")

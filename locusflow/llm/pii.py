"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans: e-mail and IP addresses, card and phone numbers, secrets. Base spans (the strict forms) always
count. Every proposed span gets votes from a form labeler, a checksum labeler, a gazetteer of lead words and numbers, and
a context labeler; expectation-maximisation over counted vote patterns estimates the reliability of each and a prior for
each kind, and its posteriors train the final classifier, a naive Bayes model over votes, length and the neighbouring
characters. Spans beside the base ones are added where it gives PROBABILITY or more.

Nothing but counts of patterns (bounded by their number) reaches the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone", "secret")
PROBABILITY = 0.5
#: Runs are possessive and start at their first character, so no text takes quadratic time; the matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 12 digits or more; shorter ones are no candidates.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Proposed only, never base.
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SECRET = r"(?<![0-9A-Za-z+/_-])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?=[A-Z]*+[0-9])[A-Z0-9]{20}|(?:sk|pk|ghp|xox[bp])[-_][0-9A-Za-z_-]{16,}+)(?![0-9A-Za-z+/_-])"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
CONTEXT = 24
LEADS = {
    "email": r"(?i)(?:e-?mail|mail|contact|correo|courriel|kontakt|write to)\W*$",
    "ip": r"(?i)(?:\bip|address|host|server|client|adresse)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta|payment)\W*(?:n[or]?\W*|number\W*)?$",
    "phone": r"(?i)(?:phone|tel|mobile|cell|call|fax|telefon|handy|t[eé]l[eé]phone|tel[eé]fono)\W*$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|key|bearer|credential)s?[\"']?\s*[:=]?\s*[\"']?$",
}
AGAINST = r"(?i)(?:version|section|chapter|isbn|figure|table|kapitel|commit|sha1|sha256|md5|checksum|digest)\W*$"
LABELERS = ("form", "checksum", "gazetteer", "context")
SPAN = "struct<kind:int,start:int,end:int,base:boolean,form:int,checksum:int,gazetteer:int,context:int,shape:int>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(lengths: Column) -> Column:
    """For each place, the sum of what stands before it: blocks of blocks of 64, blocks of 64, then single lengths."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(a), 6)), lambda k: total(F.slice(a, k * 64 + 1, F.lit(64))))

    def within(a: Column, i: Column) -> Column:
        """The sum of the last, unfilled block of 64 before place i."""
        return total(F.slice(a, i - i % 64 + 1, i % 64))

    def at(one: Column, two: Column, three: Column) -> Column:
        up = lambda i: F.shiftright(i, 6)
        return F.transform(one, lambda _, i: within(one, i) + within(two, up(i)) + total(F.slice(three, F.lit(1), up(up(i)))))

    return let(lengths, lambda one: let(blocks(one), lambda two: let(blocks(two), lambda three: at(one, two, three))))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<value, start, end, left, right>> of the leftmost non-overlapping matches; places are code points."""

    def located(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def with_gaps(g: Column) -> Column:
            lengths = F.zip_with(F.transform(m, lambda x: F.char_length(x)), F.slice(g, F.lit(1), F.size(m)), lambda n, x: n + F.char_length(x))
            return let(
                F.struct(sums_before(lengths).alias("sums"), g.alias("gaps")),
                lambda s: F.transform(
                    m,
                    lambda v, i: let(
                        F.get(s["sums"], i) + F.char_length(F.get(s["gaps"], i)),
                        lambda start: F.struct(
                            v.alias("value"), start.alias("start"), (start + F.char_length(v)).alias("end"),
                            F.right(F.get(s["gaps"], i), F.lit(CONTEXT)).alias("left"), F.left(F.get(s["gaps"], i + 1), F.lit(CONTEXT)).alias("right"),
                        ),
                    ),
                ),
            )

        return F.when(F.size(m) > 0, let(gaps, with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def yes_no(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def span(kind: str, strict: bool, m: Column) -> Column:
    """The proposed span of a match, with its votes. strict: whether matches of this pattern can be base spans."""
    value, digits = m["value"], F.regexp_replace(m["value"], "[^0-9]", "")
    n = F.char_length(digits)
    false = F.lit(False)
    if kind == "email":
        base, form = F.lit(strict), yes_no(value.rlike(r"(?i)(?:\.|dot\x20?[\])]\x20?)[a-z]{2,12}$"), value.rlike(r"\.[0-9]+$"))
        checksum, known = F.lit(0), yes_no(value.rlike(r"(?i)(?:mail|gmail|example|\.com$|\.org$|\.net$)"), false)
    elif kind == "ip":
        base = value.rlike(OCTETS)
        form, checksum = yes_no(base, ~base), F.lit(0)
        known = yes_no(value.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."), value.rlike(r"^0+\."))
    elif kind == "card":
        sized = n.between(14, 19)
        luhn = F.call_function("luhn_check", digits)
        base = sized & luhn
        form, checksum = yes_no(n.isin(14, 15, 16), ~sized), F.when(sized, yes_no(luhn, ~luhn)).otherwise(0)
        known = yes_no(digits.rlike("^(?:4|5[1-5]|3[47]|6011|65)"), digits.rlike("^[01789]"))
    elif kind == "phone":
        base = n.between(10, 15) & F.lit(strict)
        form, checksum = yes_no(n.between(10, 15), ~n.between(7, 15)), F.lit(0)
        known = yes_no(value.rlike(r"^\+?(?:1|33|34|49|44)\b|^\("), false)
    else:
        base, checksum = false, F.lit(0)
        form = yes_no(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), ~(value.rlike("[0-9]") & value.rlike("[A-Za-z]")))
        known = yes_no(m["left"].rlike(LEADS["secret"]), false)
    context = yes_no(m["left"].rlike(LEADS[kind]), m["left"].rlike(AGAINST) | m["left"].rlike(r"[0-9A-Za-z]$") | m["right"].rlike(r"^[0-9A-Za-z]"))
    shape = F.when(m["left"].rlike(r"[\"'=:(<]\s?$"), 1).when(m["left"].rlike(r"(?:^|\s)$"), 0).otherwise(2)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), base.alias("base"),
        form.alias("form"), checksum.alias("checksum"), known.alias("gazetteer"), context.alias("context"), shape.alias("shape"),
    )


def proposals(text: Column) -> Column:
    """array<SPAN> of a whole text (null: empty). Patterns are tried only where a character they need occurs."""
    text = F.coalesce(text, F.lit(""))
    digit = text.rlike("[0-9]")
    plans = [
        ("email", EMAIL, True, text.contains("@")), ("ip", IP, True, digit & text.contains(".")), ("card", CARD, True, digit),
        ("phone", PHONE, True, digit & text.contains("+")), ("email", SPELT_EMAIL, False, text.rlike(r"[\[(]\x20?at\x20?[\])]")),
        ("phone", LOCAL_PHONE, False, digit), ("secret", SECRET, False, digit),
    ]
    parts = []
    for kind, pattern, strict, needs in plans:
        found = matches(text, pattern)
        if kind == "card":  # nor are long ones
            found = F.filter(found, lambda m: F.char_length(F.regexp_replace(m["value"], "[^0-9]", "")) <= 19)
        found = F.transform(found, partial(span, kind, strict))
        parts.append(F.coalesce(F.when(needs, found), F.array().cast(f"array<{SPAN}>")))
    return F.concat(*(p.cast(f"array<{SPAN}>") for p in parts))


def settled(spans: Column) -> Column:
    """Proposals without those beside the base that overlap a base span."""
    over = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    apart = lambda a, b: F.concat(b, F.filter(a, lambda s: ~s["base"] & ~F.exists(b, lambda o: over(s, o))))
    return let(spans, lambda a: let(F.filter(a, lambda s: s["base"]), lambda b: apart(a, b)))


def learn(counted: list[tuple[tuple[int, tuple[int, ...], int, bool], int]], steps: int = 60) -> dict:
    """The classifier from ((kind, votes, shape, base), count) rows: log odds by kind, and by (feature, value).

    Base spans are known to be personal data; the others' labels are latent. A labeler is right with its reliability
    (within 0.55 and 0.99) whichever the class. Base spans tell how personal data look, not how much of the rest is: what
    comes before the votes (the prior, the weight of a kind) is estimated from the others only.
    """
    right = dict.fromkeys(LABELERS, 0.8)
    prior = dict.fromkeys(range(len(KINDS)), 0.5)

    def posterior(kind, votes, base):
        if base:
            return 1.0
        z = math.log(prior[kind] / (1 - prior[kind]))
        z += sum(v * math.log(right[name] / (1 - right[name])) for name, v in zip(LABELERS, votes, strict=True))
        return 1 / (1 + math.exp(-z))

    for _ in range(steps):
        good, cast, share, size = defaultdict(float), defaultdict(float), defaultdict(float), defaultdict(float)
        for (kind, votes, _shape, base), n in counted:
            p = posterior(kind, votes, base)
            if not base:
                share[kind] += p * n
                size[kind] += n
            for name, v in zip(LABELERS, votes, strict=True):
                if v:
                    cast[name] += n
                    good[name] += n * (p if v > 0 else 1 - p)
        right = {k: min(0.99, max(0.55, (good[k] + 8) / (cast[k] + 10))) for k in LABELERS}
        prior = {k: min(0.9, max(0.1, (share[k] + 1) / (size[k] + 2))) for k in prior}
    # The final classifier: naive Bayes over kind with votes, and shape, from the posteriors.
    yes, no, all_yes, all_no = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0), 2.0, 2.0
    for (kind, votes, shape, base), n in counted:
        p = posterior(kind, votes, base)
        all_yes += p * n
        all_no += (1 - p) * n
        for f in [*([] if base else [("kind", kind)]), ("shape", shape), *zip(LABELERS, votes, strict=True)]:
            yes[f] += p * n
            no[f] += (1 - p) * n
    seen = {f: math.log(yes[f]) - math.log(no[f]) for f in set(yes) | set(no)}
    return {"weights": {f: w if f[0] == "kind" else w - math.log(all_yes / all_no) for f, w in seen.items()}, "bias": 0.0, "reliability": right, "prior": prior}


def model(stored: DataFrame) -> dict:
    """Fits on all proposals in column `spans`; collects one row for each pattern of kind, votes and shape."""
    keys = ["kind", *LABELERS, "shape", "base"]
    rows = stored.select(F.explode("spans").alias("s")).select(*(F.col(f"s.{k}").alias(k) for k in keys)).groupBy(*keys).count().collect()
    return learn(sorted(((r["kind"], tuple(r[k] for k in LABELERS), r["shape"], r["base"]), r["count"]) for r in rows))


def chosen(spans: Column, fitted: dict) -> Column:
    """Base spans and those that the classifier adds, by start, then kind, then end."""

    def odds(s: Column) -> Column:
        z = F.lit(fitted["bias"])
        for (name, value), w in sorted(fitted["weights"].items()):
            z = z + F.when(s[name] == value, w).otherwise(0.0)
        return z

    cut = math.log(PROBABILITY / (1 - PROBABILITY))
    kept = F.filter(spans, lambda s: s["base"] | ((odds(s) >= cut)))
    plain = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))
    return F.array_sort(plain)


def written(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, spans (array of start, kind, end, base) of every row.

    Null or empty texts have none; repeated rows and ids give a row each; an empty table gives no rows; other columns are
    not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    stored = scratch.keep(docs.select("doc_id", settled(proposals(F.col("text"))).alias("spans")), "proposals")
    return stored.select("doc_id", chosen(F.col("spans"), model(stored)).alias("spans"))


def report(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans."""
    found = find(docs, scratch).withColumn("base", F.filter("spans", lambda s: s["base"]))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    The proposals are computed twice, to fit and to replace, so nothing but their patterns is stored. Null texts stay null.
    Texts of any length are one row each; repeated rows are redacted each; extra columns pass through, but for two names of
    its own, which is checked.
    """
    if clash := {"_locusflow_spans", "_locusflow_merged"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are names used within")
    scratch = scratch or Scratch(docs.sparkSession, "redact")
    fitted = model(scratch.keep(docs.select(settled(proposals(F.col("text"))).alias("spans")), "proposals"))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    merged = F.aggregate(
        "_locusflow_spans", F.array().cast("array<struct<start:int,kind:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.element_at(acc, -1)["kind"].alias("kind"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))),
    )
    text = F.col("text")
    pieces = F.transform(
        "_locusflow_merged",
        lambda s, i: F.concat(
            F.substring(text, F.when(i == 0, 0).otherwise(F.get("_locusflow_merged", i - 1)["end"]) + 1, s["start"] - F.when(i == 0, 0).otherwise(F.get("_locusflow_merged", i - 1)["end"])),
            F.lit("<"), name(s["kind"]), F.lit(">"),
        ),
    )
    tail = F.substring(text, F.element_at("_locusflow_merged", -1)["end"] + 1, F.char_length(text))
    clean = F.when(F.size("_locusflow_merged") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)
    found = docs.withColumn("_locusflow_spans", chosen(settled(proposals(text)), fitted)).withColumn("_locusflow_merged", merged)
    return found.withColumn("text", clean).drop("_locusflow_spans", "_locusflow_merged")

"""Scalar functions on names and identifiers as Column expressions: nothing leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trailing tokens that are legal form, not name.
LEGAL_SUFFIXES = ("incorporated", "corporation", "company", "limited", "inc", "corp", "co", "llc", "llp", "lp", "ltd", "plc", "gmbh", "sa", "nv", "pac")


# Money bands of the filings, low and high bound (None: open).
BANDS = {
    "None (or less than $201)": (0, 200), "None (or less than $1,001)": (0, 1000), "$0 - $200": (0, 200), "$201 - $1,000": (201, 1000),
    "$1,001 - $2,500": (1001, 2500), "$1,001 - $15,000": (1001, 15000), "$2,501 - $5,000": (2501, 5000), "$5,001 - $15,000": (5001, 15000),
    "$15,001 - $50,000": (15001, 50000), "$50,001 - $100,000": (50001, 100000), "$100,001 - $250,000": (100001, 250000),
    "$100,001 - $1,000,000": (100001, 1000000), "$250,001 - $500,000": (250001, 500000), "$500,001 - $1,000,000": (500001, 1000000),
    "$1,000,001 - $5,000,000": (1000001, 5000000), "$5,000,001 - $25,000,000": (5000001, 25000000), "$25,000,001 - $50,000,000": (25000001, 50000000),
    "Over $5,000,000": (5000001, None), "Over $50,000,000": (50000001, None),
}
TRIVIAL_BANDS = ("None (or less than $201)", "None (or less than $1,001)")
DESIGNATION_RANK = {"P": 0, "A": 1, "D": 2, "J": 3, "U": 4}
DESIGNATIONS = {
    "P": "principal campaign committee", "A": "authorized committee", "D": "leadership PAC", "J": "joint fundraising committee", "U": "unauthorized committee", "B": "lobbyist/registrant PAC",
}
PARTIES = {"REP": "Republican", "DEM": "Democratic", "DFL": "Democratic"}
KINDS = {
    "person": "person", "org": "organization", "organization": "organization", "company": "organization", "pac": "pac", "agency": "agency",
    "candidate": "candidate", "place": "place", "topic": "topic", "lens": "topic", "event": "event", "concept": "concept",
}


def lookup(values: dict, key: Column, default: Column | None = None) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), key)
    return F.coalesce(found, default) if default is not None else found


def fold(name: Column) -> Column:
    """Compatibility decomposition, combining marks dropped, lower case.

    Plain ASCII, nearly all names, is only put in lower case; the normaliser that Spark's collations rest on is
    called for the others alone. Spark takes such a call for one that may differ between calls, so a
    name that is folded in a projection is folded once, however often the result is named above it.
    """
    decomposed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), name, F.lit(True))
    plain = F.when(F.octet_length(name) > F.length(name), F.regexp_replace(decomposed, r"\p{M}+", "")).otherwise(name)
    return F.lower(plain)


def normalize_name(name: Column) -> Column:
    """Folded, punctuation to spaces, spaces collapsed, trailing legal suffixes dropped unless nothing else is left."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(fold(name), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    stripped = F.regexp_replace(clean, rf"( ({'|'.join(LEGAL_SUFFIXES)}))+$", "")
    only = clean.rlike(rf"^({'|'.join(LEGAL_SUFFIXES)})( ({'|'.join(LEGAL_SUFFIXES)}))*$")
    return F.when(only, clean).otherwise(stripped)


def squash(norm: Column) -> Column:
    return F.replace(norm, F.lit(" "), F.lit(""))


def squash_is_evidence(norm: Column) -> Column:
    return (F.length(squash(norm)) >= 6) & ~norm.rlike("[0-9]")


def slug(prefix: Column, norm: Column) -> Column:
    return F.substring(F.concat(prefix, F.lit(":"), F.replace(norm, F.lit(" "), F.lit("-"))), 1, 64)


def name_is_evidence(norm: Column) -> Column:
    return (F.length(norm) >= 3) & norm.rlike("[a-z]")


def person_is_evidence(norm: Column) -> Column:
    return name_is_evidence(norm) & (F.size(F.filter(F.split(norm, " "), lambda t: F.length(t) >= 2)) >= 2)


def public_alias(id_: Column) -> Column:
    return F.concat(F.lit("Private donor #"), F.substring(F.replace(id_, F.lit("-"), F.lit("")), 1, 8))


def public_label(mode: Column, name: Column, alias: Column, id_: Column) -> Column:
    """What may be shown: the name if open, an alias if alias, nothing otherwise."""
    return F.when(mode == "open", name).when(mode == "alias", F.coalesce(alias, public_alias(id_)))


def identity_key(system: Column, raw: Column) -> Column:
    """namespace:id for well-formed identifiers of known systems, else null."""
    ns = lookup(IDENTITY, system)
    clean = F.trim(raw)
    clean = F.when(ns == "sec_cik", F.regexp_replace(clean, "^0+", "")).otherwise(F.upper(clean))
    good = (
        F.when(ns == "sec_cik", clean.rlike(r"^\d{1,10}$"))
        .when(ns == "fec_committee", clean.rlike(r"^C\d{8}$"))
        .when(ns == "fec_candidate", clean.rlike(r"^[HSP][0-9A-Z]{8}$"))
        .otherwise(clean != "")
    )
    return F.when(good, F.concat(ns, F.lit(":"), clean))


def last_first(label: Column) -> Column:
    """FIRST LAST as LAST, FIRST in capitals; a single word stays as it is."""
    up = F.upper(F.trim(label))
    return F.when(up.contains(" "), F.regexp_replace(up, r"^(.*)\s+(\S+)$", "$2, $1")).otherwise(up)


def name_variants(first: Column, last: Column, middle: Column, nick: Column, official: Column, suffix: Column | None = None, others: Column | None = None) -> Column:
    """All spellings of a member's name, each once, in order: the official name, the parts, LAST, FIRST as filings
    have it, first and last, nickname and last, first, middle and last, and other names (array of first, last; a
    missing first is the member's own). Blank parts make nothing."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    f, n, m, k, o = (some(c) for c in (first, last, middle, nick, official))
    full = lambda *p, by=" ": F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in p]), F.concat_ws(by, *p))
    listed = F.array(o, f, n, m, k, *([some(suffix)] if suffix is not None else []), full(n, f, by=", "), full(f, n), full(k, n), full(f, m, n))
    if others is not None:
        own = F.transform(others, lambda x: F.when(some(x["last"]).isNotNull(), F.trim(F.concat_ws(" ", F.coalesce(some(x["first"]), f), some(x["last"])))))
        listed = F.concat(listed, F.coalesce(own, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(listed, lambda x: x.isNotNull()))


def label_or_parts(official: Column, first: Column, last: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(official), F.lit("")), F.trim(F.concat_ws(" ", first, last)))


def permalink(base: str, slug_: Column, kind: Column, id_: Column, scheme: str = "ref") -> Column:
    return F.when(F.coalesce(slug_, F.lit("")) != "", F.concat(F.lit(base + "/"), slug_)).otherwise(F.concat(F.lit(scheme + "://"), kind, F.lit("/"), id_))


def uuid_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$", 1)
    return F.nullif(found, F.lit(""))


def cik_padded(cik: Column) -> Column:
    return F.lpad(F.regexp_replace(cik.cast("string"), "^0+", ""), 10, "0")


def accession_url(base: str, cik: Column, accession: Column) -> Column:
    return F.concat(F.lit(base + "/"), F.regexp_replace(cik.cast("string"), "^0+", ""), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), accession, F.lit("-index.htm"))


def band_dash(text: Column) -> Column:
    return F.translate(text, "–•", "--")


def band_bounds(band: Column) -> Column:
    rows = {b: i for i, b in enumerate(BANDS)}
    at = lookup(rows, band_dash(band)) + 1
    low = F.array(*[F.lit(v[0]).cast("long") for v in BANDS.values()])
    high = F.array(*[F.lit(v[1]).cast("long") for v in BANDS.values()])
    return F.when(at.isNotNull(), F.struct(F.get(low, at - 1).alias("low"), F.get(high, at - 1).alias("high")))


def transaction_type(raw: Column) -> Column:
    """Canonical type by spelling, or the first canonical within three edits; else null."""
    t = F.lower(F.trim(raw))
    out = F.when(t.isin("purchase", "sale", "exchange"), t).when(t.startswith("sale ("), F.lit("sale"))
    for word in ("purchase", "sale", "exchange"):
        out = out.when(F.levenshtein(t, F.lit(word), 3) >= 0, F.lit(word))
    return out


def vote_direction(vote: Column) -> Column:
    v = F.lower(F.trim(vote))
    return F.when(v.isin("aye", "yea", "yes"), F.lit("voted_for")).when(v.isin("no", "nay"), F.lit("voted_against"))


def party(code: Column) -> Column:
    return lookup(PARTIES, F.upper(F.trim(code)))


def kind_type(hint: Column) -> Column:
    return lookup(KINDS, F.lower(F.trim(hint)), F.lit("unknown"))


def recipient_type(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t.startswith("CANDIDATE"), F.lit("candidate")).when(F.coalesce(t, F.lit("")) != "", F.lit("pac")).otherwise(F.lit("organization"))


def contributor_type(text: Column) -> Column:
    """What a committee that gives is: pac where its kind says so, else organization."""
    t = F.upper(F.coalesce(text, F.lit("")))
    return F.when(t.contains("PAC") | t.contains("SUPER"), F.lit("pac")).otherwise(F.lit("organization"))


def designation_label(code: Column) -> Column:
    """The designation in words; a code that is none stays as it is."""
    return lookup(DESIGNATIONS, code, code)


def title_words(name: Column) -> Column:
    return F.initcap(F.lower(name))


def notes_value(notes: Column, key: str) -> Column:
    return F.element_at(F.str_to_map(notes, F.lit(";"), F.lit("=")), F.lit(key))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


# Alias systems with a real identity (see the model).
from ..model import IDENTITY_NAMESPACES as IDENTITY  # noqa: E402

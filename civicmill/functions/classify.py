"""Classifiers as ordered rules: the first that holds decides, and no rule means null, never a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicmill.functions.text import bound, fold, normalise

#: How sources of each origin begin, as patterns over folded lower-case names.
ATELIER = ("atelier",)
VERBATIM = (
    r"cm\b", r"cr\b", r"pv\b", r"conseil[ _-]municipal", r"raa\b", r"prefecture-\d+", "urbanisme:", r"web[ _-]?scraper", "agenda",
    r"(?:web\.)?archive\.org",
)
INSTITUTIONNEL = (
    "sirene", r"rna\b", "bodacc", "dvf", "ofgl", "dgfip", "dgcl", "banatic", "sitadel", "georisques", "gaspar", "insee", "melodi",
    r"decp\b", "boamp", "interieur", r"rne\b", "pappers", "hubeau", r"data\.gouv", r"data\.economie", r"api\.",
    r"subventions?[ _-]?etat", "occitanie", r"elections?\b", r"qualite[ _-]?eau", "fiscalite",
)
#: Words of a register's quality and the role each means, the first one found deciding.
ROLES = [("gerant", "gérant"), ("president", "président"), ("associe", "associé"), ("directeur", "dirigeant"), ("tresorier", "trésorier"), ("secretaire", "secrétaire")]
#: Families of legal announcements and their kinds of event.
ANNOUNCEMENTS = {
    "vente": "bodacc_vente", "creation": "bodacc_creation", "radiation": "bodacc_radiation", "modification": "bodacc_modification",
    "depot": "bodacc_depot", "collective": "bodacc_collective", "immatriculation": "bodacc_creation", "avis": "bodacc_divers",
}


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first (pattern, value) whose pattern occurs."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def origin_of(source: Column, local_domains: tuple[str, ...] = ()) -> Column:
    """Where a row comes from by the name of its source; null, never a guess, for a source that no rule knows.

    The workshop comes first, then pages of the instance's own domains, then minutes, then institutions.
    """
    name = F.trim(F.lower(fold(source)))
    begins = lambda patterns: name.rlike(f"^(?:{'|'.join(patterns)})")
    local = F.lit(False)
    for domain in local_domains:
        local |= name.contains(domain)
    return F.when(begins(ATELIER), "atelier").when(local | begins(VERBATIM), "verbatim").when(begins(INSTITUTIONNEL), "institutionnel")


def role_of(quality: Column) -> Column:
    """The role that a register's wording means; whoever is named without one leads. Null stays null."""
    return F.when(quality.isNotNull(), F.coalesce(first_match(F.lower(fold(quality)), ROLES), F.lit("dirigeant")))


def announcement_kind(family: Column) -> Column:
    """Kind of event of a family of legal announcements; null for other families."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ANNOUNCEMENTS.items() for x in kv]), F.lower(fold(family)))


def role_rank(role: Column) -> Column:
    """Mayor 0, nth deputy n, first deputy 1, other roles 40, none 50."""
    r = normalise(role)
    n = F.regexp_extract(r, r"^(\d+)", 1).try_cast("int")
    return F.when(r.isNull() | (r == ""), 50).when(r.rlike(r"^maire\b"), 0).when(r.rlike(r"adjoint"), F.coalesce(n, F.lit(1))).otherwise(40)


#: What the name of an authority above the communes holds; the blank after "ars" is part of it.
SUPRA = (
    "préfecture", "sous-préfecture", "département", "conseil départemental", "conseil régional", "région occitanie", "état français",
    "agence de l'eau", "ademe", "dreal", "ars ", "rectorat", "direction départementale", "trésorerie", "dgfip",
)
#: Legal forms that open the name of a council of communes.
COUNCIL_FORMS = r"^(?:CC|CA|CU|C\.C\.|communauté de communes|communaute de communes|communauté d'agglomération)\s+"


def plain_name(name: Column) -> Column:
    """Folded and lower-cased, hyphens and apostrophes blank, white space squeezed; other signs stay. Null is blank."""
    bare = F.translate(F.lower(fold(F.coalesce(name, F.lit("")))), "-'’", "   ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def declared_scope(name: Column, commune: Column, home: str, neighbours: tuple[str, ...], council: str = "") -> Column:
    """The scope that an entity's commune, else its name, tells: C1 the commune, C2 a neighbour or the council that the communes share, C3 an authority above, else "hors".

    The council is known by its name, or by what follows the legal form in it, standing anywhere.
    """
    same = lambda c: plain_name(F.lit(c))
    short = plain_name(F.regexp_replace(F.lit(council), f"(?i){COUNCIL_FORMS}", ""))

    def told(at: Column, called: Column) -> Column:
        is_council = ((called == same(council)) | ((short != "") & F.contains(called, short))) if council else F.lit(False)
        above = F.lit(False)
        for mark in SUPRA:
            above |= F.contains(called, F.concat(same(mark), F.lit(" " if mark.endswith(" ") else "")))
        near = F.lit(False)
        for c in neighbours:
            near |= at == same(c)
        return F.when(at == same(home), "C1").when(near | is_council, "C2").when(above, "C3").otherwise("hors")

    return bound(F.struct(plain_name(commune).alias("at"), plain_name(name).alias("called")), lambda s: told(s["at"], s["called"]))


def direction(from_id: Column, to_id: Column, pivot: Column) -> Column:
    """A flow as the pivot sees it."""
    return F.when(to_id == pivot, "entrant").when(from_id == pivot, "sortant").otherwise("tiers")


def geo_status(lat: Column, lng: Column, source: Column, score: Column) -> Column:
    """How far a place can be trusted: places of map and address services, and of unknown origin, are imprecise whatever their score."""
    missing = lat.isNull() | lng.isNull()
    vague = (F.coalesce(score, F.lit(0.0)) < 0.6) | source.isNull() | source.isin("osm", "ban")
    return F.when(missing, "missing").when(source == "manual", "ok_manual").when(vague, "imprecise").otherwise("ok")


def editable(origin: Column) -> Column:
    """Rows of an institution, and rows nobody can place, may not be edited."""
    return F.coalesce(origin.isin("verbatim", "atelier"), F.lit(False))


def shared_name_score(bearers: Column) -> Column:
    """Worth of a link by a shared surname: the more people bear it, the less it says; 20 at least."""
    return F.greatest(F.lit(20), 50 - 8 * bearers)


def overlap_score(share: Column) -> Column:
    """Worth of a link by words in common, by their share."""
    return 70 + 20 * share


def relevance(*hits: tuple[Column, float]) -> Column:
    """0.3 and what each hit adds, 1 at most."""
    score = F.lit(0.3)
    for hit, worth in hits:
        score = score + F.when(hit, worth).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def valid_correction(kind: str, value: Column) -> Column:
    """A corrected value as text if it is valid for its kind, else null."""
    if kind == "date":
        return F.date_format(F.try_to_date(value, "yyyy-MM-dd"), "yyyy-MM-dd")
    if kind == "year":
        year = value.try_cast("int")
        return F.when(year.between(1900, 2100), year.cast("string"))
    if kind == "amount":
        found = F.round(F.regexp_replace(value, ",", ".").try_cast("double"), 2)
        return F.when(found >= 0, found.cast("string"))
    if kind == "url":
        return F.when(value.rlike(r"^https?://[^\s]+$"), value)
    raise ValueError(f"no such kind of correction: {kind}")


#: Fixed value: how a filter names the rows that have no value.
NO_VALUE = "non-classe"


def or_default(value: Column, default: str) -> Column:
    """A status that is not told is the usual one."""
    return F.coalesce(value, F.lit(default))


def in_buckets(value: Column, wanted: tuple[str, ...]) -> Column:
    """Whether a value is one of those wanted, where the bucket of no value is one of them by its name."""
    named = [w for w in wanted if w != NO_VALUE]
    hit = value.isin(*named) if named else F.lit(False)
    return F.coalesce(hit, F.lit(False)) | (value.isNull() if NO_VALUE in wanted else F.lit(False))


def period(date: Column, date_end: Column, as_of: Column) -> Column:
    """"past" if an event ended before that day, by its end, else its date; "current" if not; null without dates."""
    last = F.coalesce(date_end, date)
    return F.when(last < as_of, "past").when(last >= as_of, "current")

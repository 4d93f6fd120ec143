"""How a money flow stands in time to a mandate, and what follows from it. The order of the tests is their meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What one mandate of several says of a flow, the one that counts first; one covering mandate is enough.
OUTCOMES = ("contemporain", "chevauchement_annee", "anterieur_mandat", "hors_mandat", "dates_manquantes", "lien_sans_flux")


def year_of(date: Column) -> Column:
    """Year of an ISO text date, whole or partial; null if it opens with anything else."""
    return F.substring(date, 1, 4).try_cast("int")


def chronology(flow_id: Column, flow_year: Column, event_date: Column, since: Column, until: Column) -> Column:
    """An exact date decides where there is one; else the year does, except in a mandate's first or last year."""
    first, last = year_of(since), year_of(until)
    dated = F.when(event_date > until, "hors_mandat").when(event_date < since, "anterieur_mandat").otherwise("contemporain")
    by_year = F.when(last < flow_year, "hors_mandat").when(first > flow_year, "anterieur_mandat").when((last == flow_year) | (first == flow_year), "chevauchement_annee").otherwise("contemporain")
    return F.when(flow_id.isNull(), "lien_sans_flux").when(since.isNull() & until.isNull(), "dates_manquantes").when(event_date.isNotNull(), dated).otherwise(by_year)


def severity(outcome: Column) -> Column:
    """0 for the outcome that counts first."""
    rank = F.lit(len(OUTCOMES))
    for k, name in reversed(list(enumerate(OUTCOMES))):
        rank = F.when(outcome == name, k).otherwise(rank)
    return rank


def best_outcome(outcomes: Column) -> Column:
    """Of an array of outcomes over all mandates of a person the one that counts; "indetermine" if none is known."""
    return F.coalesce(*[F.when(F.array_contains(outcomes, o), F.lit(o)) for o in OUTCOMES], F.lit("indetermine"))


def case_status(paid: Column, recused: Column, outcome: Column, any_closed: Column) -> Column:
    """Status of a (person, entity) case: whether money flowed, a recusal was found, and how the flow stands to mandates.

    A flow before every known mandate is outside only if a closed mandate is known; else the history may be incomplete.
    """
    return (
        F.when(~F.coalesce(paid, F.lit(False)), "lien_sans_versement")
        .when(recused, "deport_constate")
        .when((outcome == "hors_mandat") | ((outcome == "anterieur_mandat") & any_closed), "hors_mandat")
        .when(outcome == "anterieur_mandat", "chronologie_incertaine")
        .otherwise("deport_non_trouve")
    )

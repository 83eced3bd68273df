"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers, dates and years, and of the words that name them.
ECLI = r"\bECLI:[A-Z]{2}:[A-Z0-9]+:\d{4}:[A-Z0-9]+\b"
ARTICLE = r"\b(?:artikel|article|art\.?)\s+([0-9]+[a-z]*(?:[.:][0-9]+[a-z]*)*)\b"
ARTICLE_REF = r"\b(?:artikel|article|art\.?)\s+[0-9]+[a-z]*(?:[.:][0-9]+[a-z]*)*(?:\s+lid\s+[0-9]+)?(?:\s+onderdeel\s+[a-z])?\b"
PARAGRAPH = r"\b(?:lid|paragraph)\s+([0-9]+)\b"
SUBPARAGRAPH = r"\b(?:onderdeel|subparagraph|sub)\s+([a-z])\b"
IDENTIFIER = r"\b(?:ecli:|artikel|article|art\.?)"
IDENTIFIER_STRICT = r"\b(?:ecli:|artikel|article|art\.)"
ISO_DATE = r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b"
YEAR = r"\b((?:19|20)\d{2})\b"
ELIGIBILITY = r"\b(?:if someone|can they|can someone|qualified|qualify|eligible)\b"
CLAUSE_SPLIT = r"\s*(?:;|\?|(?:\s+(?:and|en)\s+))\s*"
TOKEN = r"([a-z0-9%:.+-]+)"

# Words without weight, concepts with the phrases that show them, and the terms each concept adds.
STOPWORDS = "a an and another be can de deze does een en for het hoe how if in is kan met naar of on or the to van wat what when werkt".split()
CONCEPTS: dict[str, list[str]] = {
    "concept:thirty_percent_ruling": ["30% ruling", "30 percent ruling", "30%-regeling", "30% regeling", "bewijsregel", "extraterritoriale"],
    "concept:employee": ["employee", "employees", "werknemer", "werknemers", "ingekomen werknemer"],
    "concept:employer": ["employer", "employers", "werkgever", "werkgevers", "inhoudingsplichtige", "inhoudingsplichtigen"],
    "concept:employment_change": [
        "change employer", "change employers", "change jobs", "change job", "another employer", "new employer", "other employer", "switch employer", "switch jobs", "different employer",
        "andere inhoudingsplichtige", "nieuwe inhoudingsplichtige", "wisseling van inhoudingsplichtige", "voortgezette toepassing", "resterende looptijd",
    ],
    "concept:study_stage": ["study", "studied", "student", "opleiding", "studie", "stage", "internship"],
    "concept:eligibility": ["qualify", "qualified", "eligible", "eligibility", "toepassing", "aangemerkt", "in aanmerking"],
    "concept:netherlands": ["netherlands", "dutch", "nederland", "nederlandse", "nederlands", "nl"],
}
ALIASES: dict[str, list[str]] = {
    "concept:thirty_percent_ruling": ["30_percent_ruling", "bewijsregel", "extraterritoriale", "regeling"],
    "concept:employee": ["werknemer", "employee", "ingekomen_werknemer"],
    "concept:employer": ["werkgever", "employer", "inhoudingsplichtige"],
    "concept:employment_change": ["switch_employer", "change_jobs", "new_employer", "andere_inhoudingsplichtige", "nieuwe_inhoudingsplichtige", "resterende_looptijd"],
    "concept:study_stage": ["study", "opleiding", "stage", "internship"],
    "concept:eligibility": ["eligibility", "toepassing", "aangemerkt"],
    "concept:netherlands": ["netherlands", "nederland", "dutch"],
}
# Recurring questions and the provision that answers each.
REWRITES: list[tuple[str, str]] = [
    (r"\b(?:duration|looptijd|term).*\b(?:reduc|verminder|earlier|previous|prior|eerder).*\b(?:work|residence|verblijf|tewerkstelling|netherlands|nederland)", "Artikel 10ef lid 1"),
    (r"\b(?:definition|define|meaning|what is).*\b(?:incoming employee|ingekomen werknemer)\b", "Artikel 10e lid 2 onderdeel b"),
    (r"\b(?:duration|looptijd|how long|maximum).*\b(?:30%|30 percent|30%-regeling|proof rule|evidence rule|bewijsregel)\b", "Artikel 10ec lid 1"),
]

_ANY_CASE = "(?iu)"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def squeeze(c: Column) -> Column:
    """White space of any kind, no-break spaces included, as single spaces; none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def match_norm(c: Column) -> Column:
    """Lower case, with each run of anything but a-z and 0-9 as one space."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def subparagraph_norm(c: Column) -> Column:
    return F.replace(match_norm(c), F.lit(" "), F.lit(""))


def slug(c: Column) -> Column:
    bare = F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(blank_to_null(bare), F.lit("item"))


def file_name(c: Column) -> Column:
    """A name safe for files: letters, digits, dot, dash and underscore, others as underscore."""
    return F.coalesce(blank_to_null(F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))), F.lit("item"))


def extension(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(kind.contains("xml"), ".xml").when(kind.contains("json"), ".json").when(kind.contains("html"), ".html").when(kind.contains("pdf"), ".pdf").otherwise(".bin")


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(_ANY_CASE + pattern)


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    return blank_to_null(F.regexp_extract(c, _ANY_CASE + pattern, group))


def query_terms(q: Column) -> Column:
    """ECLI in upper case, article as written, paragraph, and subparagraph in lower case."""
    return F.struct(
        F.upper(first_match(q, ECLI)).alias("ecli"),
        first_match(q, ARTICLE, 1).alias("article"),
        first_match(q, PARAGRAPH, 1).alias("paragraph"),
        F.lower(first_match(q, SUBPARAGRAPH, 1)).alias("subparagraph"),
    )


def is_identifier_query(q: Column) -> Column:
    return matches(q, IDENTIFIER)


def as_of_in(q: Column) -> Column:
    """First date of the form YYYY-MM-DD written in a text; null where none, or where it is no date."""
    return strict_date(first_match(q, ISO_DATE))


def strict_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def latest_year(q: Column) -> Column:
    years = F.transform(F.regexp_extract_all(q, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    return F.array_max(years)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1))


def trigrams(token: Column) -> Column:
    """Runs of three characters; a shorter token gives itself."""
    return F.when(F.length(token) < 3, F.array(token)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - 2, F.lit(1))), lambda i: F.substring(token, i, F.lit(3))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shown(low: Column) -> Column:
    """Concepts of which a lower-case text holds a phrase. Phrases that hold another one of their concept need no search of their own."""
    least = {k: [p for p in ps if not any(q != p and q in p for q in ps)] for k, ps in CONCEPTS.items()}
    every = F.from_json(F.lit(json.dumps([{"k": k, "p": p} for k, p in least.items()])), "array<struct<k:string,p:array<string>>>")
    met = F.filter(every, lambda x: F.coalesce(F.exists(x["p"], lambda p: F.contains(low, p)), F.lit(False)))
    return F.transform(met, lambda x: x["k"])


def _terms(low: Column, shown: Column) -> Column:
    """Tokens that are no stop words, and the terms that the concepts ``shown`` add."""
    own = F.filter(tokens(low), lambda t: ~t.isin(STOPWORDS))
    of = F.str_to_map(F.lit("|".join(f"{k}={','.join(v)}" for k, v in ALIASES.items())), F.lit("[|]"), F.lit("="))
    return F.array_distinct(F.concat(own, F.flatten(F.transform(shown, lambda k: F.split(F.element_at(of, k), ",")))))


def concepts(c: Column) -> Column:
    return bound(squeeze(F.lower(c)), _shown)


def lexical_terms(c: Column) -> Column:
    """Tokens that are no stop words, and the terms that the text's concepts add."""
    return bound(squeeze(F.lower(c)), lambda low: bound(_shown(low), lambda shown: _terms(low, shown)))


def semantic_terms(c: Column) -> Column:
    return bound(squeeze(F.lower(c)), lambda low: bound(_shown(low), lambda shown: F.array_union(_terms(low, shown), shown)))


def clauses(q: Column) -> Column:
    """Parts of a compound question, of twelve characters or more each, in order and once."""
    parts = F.filter(F.split(q, _ANY_CASE + CLAUSE_SPLIT), lambda x: F.length(squeeze(x)) >= 12)
    return F.array_distinct(F.transform(parts, lambda x: F.btrim(x, F.lit(" ."))))


def identifiers(q: Column) -> Column:
    found = F.concat(F.regexp_extract_all(q, F.lit(_ANY_CASE + ECLI), F.lit(0)), F.regexp_extract_all(q, F.lit(_ANY_CASE + ARTICLE_REF), F.lit(0)))
    return F.array_distinct(F.transform(found, squeeze))


def rewrites(q: Column) -> Column:
    return F.array_compact(F.array(*[F.when(matches(q, p), F.lit(to)) for p, to in REWRITES]))


def snippet(c: Column, most: int = 240) -> Column:
    x = squeeze(c)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, most - 3)), F.lit("...")))


def source_label(ecli: Column, citation_path: Column) -> Column:
    return F.coalesce(blank_to_null(ecli), F.split_part(citation_path, F.lit(" > "), F.lit(1)))


def joined(*parts: Column) -> Column:
    """Parts with a space between, null and empty ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")

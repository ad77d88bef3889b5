"""Defaults of the operators. Every one is a parameter where it is used."""

# Word lists, formats and patterns that results depend on.

#: Institutional and noise words of captions, which don't tell one party from another.
NAME_STOP = (
    "the", "and", "for", "versus", "etal", "et", "al", "ex", "rel",
    "inc", "incorporated", "llc", "llp", "corp", "corporation", "company", "companies",
    "ltd", "limited", "group", "holdings", "partners", "partnership", "associates",
    "association", "services", "service", "systems", "enterprises", "trust", "estate",
    "bank", "fund", "foundation", "insurance", "insurers", "insurer", "indemnity",
    "casualty", "mutual", "auto", "automobile", "assurance", "underwriters", "national",
    "american", "general", "first", "united", "state", "states", "farm", "county",
    "city", "department", "board", "commission", "authority", "district", "georgia",
    "hospital", "health", "medical", "center", "transport", "transportation", "logistics",
    "trucking", "construction", "properties", "property", "management", "realty",
    "investments", "capital", "financial", "credit", "wrecker", "towing", "doe", "john",
    "jane", "unknown",
)
#: Words of captions that a citation window must not be anchored on.
CAPTION_STOP = (
    "the", "of", "and", "for", "in", "re", "ex", "rel", "state", "states", "city", "county",
    "town", "village", "estate", "matter", "interest", "united", "people", "commonwealth",
    "department", "dept", "board", "commission", "authority", "company", "co", "inc", "llc",
    "corp", "corporation", "ltd", "lp", "llp",
)
#: Words of docket strings that aren't docket numbers.
DOCKET_NOISE = ("CASE", "NOS", "AND")
#: Kinds of treatment that count against an item.
ADVERSE_KINDS = (
    "overruled", "reversed", "abrogated", "superseded by statute",
    "limited", "disapproved", "criticized", "distinguished-narrowing",
)
#: Hedges in the lower-cased reason of a drop.
HEDGES = r"\b(?:likely|probably|presumably|possibly|seem(?:s|ed)?|appears?\s+to\s+be|suggest(?:s|ed|ing)?|may\s+be|might\s+be)\b"
#: Quoted markers: double, curly, or single quotes that no letter touches.
QUOTED = "\"[^\"]{2,60}\"|“[^”]{2,60}”|(?<![A-Za-z])'[^']{2,60}'(?![A-Za-z])"
#: Stands for the middle of a clipped text, of which the head gets this share.
CLIP_MARKER, CLIP_HEAD = "\n\n[... middle of the opinion omitted for length ...]\n\n", 72
#: Outcome buckets, first hit wins.
DISPOSITIONS = [("in part", "mixed"), ("affirm", "affirmed"), ("revers", "reversed"), ("vacat", "vacated"), ("dismiss", "dismissed")]
#: Prefixes of drop reasons and their tiers.
DROP_TIERS = [("screen:", "screen"), ("pretriage:", "pretriage"), ("triage:", "triage"), ("summarizer:", "summarizer")]
#: T4: words of silence, of the source that is called silent, and of the material that was supplied.
SILENCE = (
    r"\b(?:does\s+not|doesn'?t|do\s+not|don'?t|fails?\s+to|never)\s+(?:\w+\s+){0,2}?"
    r"(?:identify|identifies|specify|specifies|state|states|say|says|indicate|indicates|"
    r"mention|mentions|disclose|discloses|define|defines|spell\s+out|set\s+out|make\s+clear)\b"
    r"|\b(?:is|are|was|were)\s+silent\b"
    r"|\bnot\s+(?:identified|specified|stated|spelled\s+out)\b"
)
SILENT_SOURCE = r"\b(?:bill|act|statute|legislation|enrolled)\b"
SUPPLIED = r"\b(?:provided|supplied|given|description|title|summary|available)\b"
#: The date at the end of a snapshot's name.
SNAPSHOT = r"-[0-9]{8}$"
#: Steps that are recorded even where a run was torn down.
BOOKKEEPING = ("Complete job",)
#: Conclusions of steps that didn't run (null too), and name parts of steps that report.
DID_NOT_RUN = ("skipped", "cancelled")
REPORTING_HINTS = ("report", "alert", "notify", "issue")
#: Kinds of references: prefix of the printed form, and pattern with the reference as its group.
REFERENCE_PATTERNS = {
    "state code": ("O.C.G.A. § ", r"O\.C\.G\.A\.\s*§+\s*(\d+-\d+-\d+(?:\.\d+)?)"),
    "federal code": ("", r"\b(\d+\s+U\.S\.C\.\s*§+\s*\d+[A-Za-z]?)"),
    "federal regulation": ("", r"\b(\d+\s+C\.F\.R\.\s*§+\s*[\d.]+)"),
    "civil rule": ("Fed. R. Civ. P. ", r"(?:Fed\.\s*R\.\s*Civ\.\s*P\.|FRCP)\s*(\d+(?:\([a-z0-9]+\))*)"),
    "bill": ("", r"\b((?:SB|HB)\s+\d+)\b"),
    "bar rule": ("Ga. R. Prof. Conduct ", r"\bRule (\d+\.\d+)\b"),
}
#: A reporter citation, the year in brackets, and where a case name ends before its citation.
REPORTER = r"\d+\s+(?:Ga\.(?:\s+App\.)?|S\.E\.2?d?|U\.S\.|S\.\s?Ct\.)\s+\d+|\(\d+\s+SE2?d\s+\d+\)"
YEAR = r"\((\d{4})\)"
NAME_END = r",\s*(?=\d+\s+(?:Ga\.|S\.E\.|U\.S\.))"

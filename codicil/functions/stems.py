"""Stems of English words: only endings of inflection go, so that unrelated words stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words whose stem no rule finds, words that are no plurals, and endings in the order they are tried.
IRREGULAR = {
    "children": "child", "men": "man", "women": "woman", "people": "person",
    "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse",
    "freeze": "freez", "freezes": "freez", "frozen": "freez", "froze": "freez", "freezed": "freez",
    "unfreeze": "unfreez", "unfrozen": "unfreez",
    "licence": "license", "practise": "practice", "organisation": "organization",
    "organisations": "organizations", "recognise": "recogniz", "labour": "labor",
    "neighbour": "neighbor", "neighbours": "neighbors", "behaviour": "behavior",
    "favour": "favor", "centre": "center", "metre": "meter", "litre": "liter",
    "fibre": "fiber", "programme": "program", "utilise": "utiliz",
    "utilisation": "utiliz", "authorised": "authoriz", "authorisation": "authoriz",
    "modelling": "modeling", "cancelled": "canceled", "labelling": "labeling",
    "fulfil": "fulfill", "enrol": "enroll", "instalment": "installment",
    "travelling": "traveling", "cancelling": "canceling", "totalling": "totaling",
    "signalling": "signaling", "levelled": "leveled", "fuelled": "fueled",
    "analyses": "analysis", "crises": "crisis", "theses": "thesis",
    "diagnoses": "diagnosis", "hypotheses": "hypothesis", "parentheses": "parenthesis",
    "oases": "oasis", "axes": "axis", "bases": "basis", "data": "datum",
    "media": "medium", "criteria": "criterion", "phenomena": "phenomenon",
    "indices": "index", "matrices": "matrix", "vertices": "vertex",
    "authorize": "authoriz", "authorizing": "authoriz", "authorized": "authoriz",
    "authorization": "authoriz", "authorizations": "authoriz", "authorise": "authoriz",
    "authorising": "authoriz", "authorisations": "authoriz",
    "recognize": "recogniz", "recognized": "recogniz", "recognizes": "recogniz",
    "recognizing": "recogniz", "recognition": "recogniz", "recognised": "recogniz", "recognises": "recogniz",
    "utilize": "utiliz", "utilized": "utiliz", "utilizes": "utiliz", "utilizing": "utiliz", "utilization": "utiliz",
    "utilised": "utiliz", "utilises": "utiliz", "utilising": "utiliz",
}
NOT_PLURAL = (
    "analysis basis business bias status census focus genus process series species news always this his its "
    "as is was has gas plus less class pass axis thesis crisis diagnosis emphasis synthesis prognosis"
).split()
PLURAL_ENDINGS = (("sses", "ss"), ("ies", "y"), ("ss", "ss"), ("s", ""))
VERB_ENDINGS = (
    ("izations", "ization"), ("isations", "isation"), ("ization", "ization"), ("isation", "isation"), ("iveness", "iveness"), ("fulness", "fulness"),
    ("ousness", "ousness"), ("ations", "ation"), ("ing", ""), ("ings", ""), ("ied", "y"), ("ies", "y"), ("ical", "ic"), ("ically", "ic"), ("ally", ""), ("ely", ""), ("ed", ""), ("es", ""),
)
DOUBLED = "bdfgmnprt"
LEAST_STEM = 3


def stem(word: Column) -> Column:
    """A word in lower case without its ending of inflection; null for null.

    Words with digits stay; of the rules the first that leaves three letters applies, plurals before verbs (of two endings that
    fit the longer stands first); a doubled consonant it leaves is made single (of plurals only after ``s``). Meant for a
    vocabulary of distinct words.
    """
    w = F.regexp_replace(F.lower(word), "^[.'’]+|[.'’]+$", "")
    as_map = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])

    def without(endings: tuple, least: int, doubled: Column) -> Column:
        """The word without the longest of the endings that leaves enough letters; null if it has none."""
        pattern = rf"^(.{{{least},}}?)({'|'.join(dict.fromkeys(e for e, _ in endings))})$"
        head, ending = F.regexp_extract(w, pattern, 1), F.regexp_extract(w, pattern, 2)
        left = F.concat(head, as_map(dict(endings).items())[ending])
        return F.when(ending != "", F.when(doubled | (ending == "s"), F.regexp_replace(left, rf"([{DOUBLED}])\1$", "$1")).otherwise(left))

    kept = F.when((w == "") | F.rlike(w, F.lit(r"\d")) | w.isin(NOT_PLURAL), w)
    ies = F.when((F.length(w) > 4) & F.endswith(w, F.lit("ies")), F.regexp_replace(w, "ies$", "y"))
    verb = F.when(F.length(w) > 5, without(VERB_ENDINGS, LEAST_STEM, F.lit(True)))
    return F.coalesce(as_map(IRREGULAR.items())[w], kept, ies, without(PLURAL_ENDINGS, 3, F.lit(False)), verb, w)

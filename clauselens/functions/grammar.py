"""Deontic force, defeat and parties in a text, and the notation of atom names. All JVM-side expressions.

A name is ``[force_]stem[__principal_principal...]``. The force is one of five prefixes; the chain
names principals in order, and the order carries meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Force prefixes, principals (longest first) and roles of the notation.
FORCE_PREFIXES = ("must_", "mustnot_", "should_", "shouldnot_", "may_")
PRINCIPALS = ("third_party", "developer", "operator", "system", "model", "root", "user")
ROLES = ("condition", "exception", "consequent", "topic")

FORCES = tuple(p[:-1] for p in FORCE_PREFIXES)

# Words that may stand between a modal and its negator, negators, and each modal's force as it is and negated.
SCOPE_WORDS = (
    "always ever also still simply only just generally typically usually normally ordinarily therefore then necessarily by default in general "
    "certainly ideally really actually further otherwise"
).split()
NEGATORS = ("not", "never", "no", "nor", "neither")
MODALS = {"must": ("must", "mustnot"), "shall": ("must", "mustnot"), "should": ("should", "shouldnot"), "may": ("may", "mustnot"), "can": (None, "mustnot")}
# Phrases that carry a force without a modal.
FORCE_PHRASES = (
    (r"\bcannot\b", "mustnot"),
    (r"\bca not\b", "mustnot"),
    (r"\bprohibit(?:s|ed|ion|ions)?\b", "mustnot"),
    (r"\bforbid(?:s|den)?\b", "mustnot"),
    (r"\bnot (?:be )?(?:permitted|allowed)\b", "mustnot"),
    (r"\brefrain from\b", "mustnot"),
    (r"\bnever\b", "mustnot"),
    (r"\b(?:is|are|was|were|be|being) required to\b", "must"),
    (r"\b(?:is|are|was|were|be) obligated to\b", "must"),
    (r"\b(?:has|have|had) to\b", "must"),
    (r"\bit is (?:the )?(?:model'?s? )?(?:duty|obligation)\b", "must"),
    (r"\b(?:is|are) (?:permitted|allowed) to\b", "may"),
    (r"\bfree to\b", "may"),
)
# Cues of defeat.
DEFEATERS = {
    "unless": r"\bunless\b",
    "except": r"\bexcept\b",
    "exception": r"\bexceptions?\b",
    "however": r"\bhowever\b",
    "but": r"\bbut\b",
    "other than": r"\bother than\b",
    "provided that": r"\bprovided (?:that|it)\b",
    "notwithstanding": r"\bnotwithstanding\b",
    "aside from": r"\b(?:aside|apart) from\b",
    "even if": r"\beven (?:if|when|though)\b",
    "nevertheless": r"\b(?:nevertheless|nonetheless)\b",
    "otherwise": r"\botherwise\b",
    "in which case": r"\bin which case\b",
}
# How texts name parties, and phrases in which such a word is part of a name.
PARTIES = {
    "developer": r"\bdevelopers?\b",
    "model": r"\b(?:models?|assistants?|chatgpt)\b",
    "operator": r"\boperators?\b",
    "platform": r"\bplatforms?\b",
    "system": r"\bsystems?\b",
    "third_party": r"\bthird[ -]part(?:y|ies)\b",
    "user": r"\busers?\b",
}
NOT_A_PARTY = r"\bmodel (?:spec|behaviou?r)\b"


def plain(text: Column) -> Column:
    """Lower case, straight apostrophes, ``n't`` as `` not``; null is empty."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "‘’", "''"), r"n't\b", " not")


#: A negator that a modal reaches: at most two scope words lie between.
_REACH = rf"(?:[^a-z]+(?:{'|'.join(SCOPE_WORDS)})){{0,2}}[^a-z]+(?:{'|'.join(NEGATORS)})(?![a-z])"


def forces(text: Column) -> Column:
    """Deontic forces of a text in the order of FORCES. A negated modal gives the negated force alone."""
    t = plain(text)
    patterns: dict[str, list[str]] = {f: [] for f in FORCES}
    for modal, (as_is, negated) in MODALS.items():
        if as_is:
            patterns[as_is].append(rf"(?<![a-z]){modal}(?![a-z])(?!{_REACH})")
        patterns[negated].append(rf"(?<![a-z]){modal}{_REACH}")
    for phrase, force in FORCE_PHRASES:
        patterns[force].append(phrase)
    return F.array_compact(F.array(*(F.when(t.rlike("|".join(p)), F.lit(f)) for f, p in patterns.items())))


def defeaters(text: Column) -> Column:
    """Cues of defeat that a text holds, in list order."""
    t = plain(text)
    return F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(cue)) for cue, p in DEFEATERS.items())))


def principals(text: Column) -> Column:
    """Distinct parties that a text names, sorted."""
    t = F.regexp_replace(plain(text), NOT_A_PARTY, " ")
    return F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(name)) for name, p in PARTIES.items())))


def classify(text: Column) -> Column:
    """struct(categories, forces, defeaters, principals): DEONTIC, DEFEATED, PARTIED (two parties or more), else CONTROL."""
    f, d, p = forces(text), defeaters(text), principals(text)
    found = F.array_compact(F.array(F.when(F.size(f) > 0, "DEONTIC"), F.when(F.size(d) > 0, "DEFEATED"), F.when(F.size(p) >= 2, "PARTIED")))
    return F.struct(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("CONTROL"))).alias("categories"), f.alias("forces"), d.alias("defeaters"), p.alias("principals"))


def stratum(categories: Column) -> Column:
    """One category of several, the scarcer first, so that strata don't overlap."""
    return F.coalesce(*(F.when(F.array_contains(categories, c), c) for c in ("DEFEATED", "DEONTIC", "PARTIED")), F.lit("CONTROL"))


# --- notation -------------------------------------------------------------------------------------

_PRINCIPAL = f"(?:{'|'.join(PRINCIPALS)})"


#: A whole name: force, stem without a double underscore, chain. A force without a stem doesn't match.
_NAME = rf"(?s)^(?:({'|'.join(FORCES)})_)?+((?:(?!__).)+)(?:__({_PRINCIPAL}(?:_{_PRINCIPAL})*)_?)?$"


def parse_name(name: Column) -> Column:
    """struct(polarity, stem, principals, error). A name that can't be parsed gives the error, itself as the stem, and nothing else."""
    ok = F.coalesce(name.rlike(_NAME), F.lit(False))
    part = lambda k: F.when(ok, F.nullif(F.regexp_extract(name, _NAME, k), F.lit("")))
    named = F.regexp_extract_all(F.coalesce(part(3), F.lit("")), F.lit(f"({_PRINCIPAL})(?:_|$)"), F.lit(1))
    why = (
        F.when(F.coalesce(name, F.lit("")) == "", "not a name").when(name.rlike("__.*__"), "more than one chain").when(name.rlike("__$"), "empty chain")
        .when(name.rlike(f"^(?:(?:{'|'.join(FORCES)})_)?(?:__|$)"), "no stem").otherwise("unknown principal")
    )
    return F.struct(part(1).alias("polarity"), F.coalesce(part(2), name).alias("stem"), named.alias("principals"), F.when(~ok, why).alias("error"))


def format_name(parsed: Column) -> Column:
    """The inverse of parse_name()."""
    head = F.concat(F.coalesce(F.concat(parsed["polarity"], F.lit("_")), F.lit("")), parsed["stem"])
    return F.when(F.size(parsed["principals"]) > 0, F.concat(head, F.lit("__"), F.array_join(parsed["principals"], "_"))).otherwise(head)


def stem_of(name: Column) -> Column:
    """The name without its notation; a name that can't be parsed is its own stem."""
    return F.when(name.rlike(_NAME), F.regexp_extract(name, _NAME, 2)).otherwise(name)


def dechained(name: Column) -> Column:
    """Force and stem, the chain of principals cut off."""
    return F.regexp_replace(name, "__.*$", "")


def principal_named(stem: Column) -> Column:
    """The principal that a stem is, else the one it ends in, else null."""
    return F.nullif(F.regexp_extract(stem, f"(?:^|_)({_PRINCIPAL})$", 1), F.lit(""))


def role(value: Column) -> Column:
    """The declared role in lower case; null if absent or unknown, never a default."""
    r = F.lower(F.trim(value))
    return F.when(r.isin(*ROLES), r)

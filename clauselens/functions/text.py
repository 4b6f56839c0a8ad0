"""Scalar text functions over columns: normalising, tokens, locators, sentences, names.

All are JVM-side expressions. Where a value list must equal a published one it stands under "fixed values".
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import python_ready

# Stop words and the suffixes of the stemmer, in order of trial.
STOPWORDS = (
    "a an and are as at be been being but by can could do does doing for from had has have having he her here hers him his "
    "how i if in into is it its itself may me might must my no nor not of off on once only or other our out over own same shall "
    "she should so some such than that the their them then there these they this those through to too under until up very was "
    "we were what when where which while who whom why will with would you your yours it's don't"
).split()
SUFFIXES = "iveness fulness ations ation ements ement ingly edly ally ness ions ing ies ful ive ion ers est ed es ly er s".split()

#: Words are stemmed backwards, so that a pattern looks at their end alone: a suffix with four letters left, marked by U+0001.
SUFFIX_PATTERN = f"^(?:{'|'.join(x[::-1] for x in SUFFIXES)})(?=.{{4}})"
STEM_ROUNDS = 6
WORD = "[a-z][a-z']+"


def stem_step(word: Column) -> Column:
    """One suffix off a word that is spelt backwards; a stem of over four letters that then ends in i gets y."""
    return F.replace(F.regexp_replace(F.regexp_replace(word, SUFFIX_PATTERN, "\u0001"), "^\u0001i(?=.{4})", "y"), F.lit("\u0001"), F.lit(""))


def raw_words(text: Column) -> Column:
    """Lower-cased words in order, stop words included; underscores split."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), "_", " "), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased words without stop words, in order, repeats included; underscores split."""
    return F.filter(raw_words(text), lambda w: ~w.isin(STOPWORDS))


def tokens(text: Column) -> Column:
    """Stemmed words, repeats included. For one row a token, stemmed_rows() is much quicker."""
    out = F.transform(words(text), lambda w: F.reverse(F.rtrim(w, F.lit("'"))))
    for _ in range(STEM_ROUNDS):
        out = F.transform(out, stem_step)
    return F.filter(F.transform(out, F.reverse), lambda w: w != "")


_ENDING = re.compile(SUFFIX_PATTERN)


def stem(word: str) -> str:
    """stem_step() until nothing changes, for one word."""
    back = word.rstrip("'")[::-1]
    while found := _ENDING.match(back):
        back = back[found.end() :]
        if back[0] == "i" and len(back) > 4:
            back = "y" + back[1:]
    return back[::-1]


#: Stems that a worker remembers.
KNOWN_STEMS = 500_000


def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for batch in batches:
        codes, distinct = pd.factorize(batch)
        if len(known) > KNOWN_STEMS:
            known = {}
        for w in distinct:
            if w not in known:
                known[w] = stem(w)
        yield pd.Series(np.array([known[w] for w in distinct], object)[codes] if len(distinct) else [])


def counted_stems(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, term, tf): how often each stem stands in each row's text; no row for a null or empty text. One pass, nothing is shuffled.

    Words are found on the JVM; a batch's words are numbered by Arrow, and only distinct ones are stemmed.
    A row is one text: if an id is on several rows, each gives its own counts.
    """
    python_ready(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = dict.fromkeys(STOPWORDS, "")
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(known) > KNOWN_STEMS:
                known = dict.fromkeys(STOPWORDS, "")
            for w in distinct:
                if w not in known:
                    known[w] = stem(w)
            number, terms = pd.factorize(np.array([known[w] for w in distinct], object)) if distinct else (np.zeros(0, np.int64), np.zeros(0, object))
            code = number[coded.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            real = np.array([t != "" for t in terms], bool)[code] if len(terms) else np.zeros(0, bool)
            key, tf = np.unique(row[real] * max(1, len(terms)) + code[real], return_counts=True)
            row, code = np.divmod(key, max(1, len(terms)))
            for i in range(0, len(key), 1 << 18):
                part = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[part])), pa.array(list(terms[code[part]]), pa.string()), pa.array(tf[part], pa.int64())], ["id", "term", "tf"])

    return docs.select(F.col(id).alias("id"), raw_words(F.col(text)).alias("w")).mapInArrow(run, f"id {kind}, term string, tf bigint")


def stemmed_rows(rows: DataFrame, word: str) -> DataFrame:
    """rows with a column of raw words stemmed, stop words and empty stems left out.

    The rounds depend on each other and differ in number by word; as one expression they outgrow
    compiled code. So distinct words of an Arrow batch are stemmed in Python, once each.
    """
    python_ready(rows.sparkSession)
    stems = F.pandas_udf(_stems, "string")
    return rows.where(~F.col(word).isin(STOPWORDS)).withColumn(word, stems(F.col(word))).where(F.col(word) != "")


#: What a quoted line loses, in order: footnote marks, the marks of cross references (their anchor stays), link targets, a list mark.
LINE_MARKS = ((r"\[\^[^\]]+\]", ""), (r"\[\?\]\((#[A-Za-z0-9_-]+)\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"^(?:[-*+]|\d+[.)])\s+", ""))


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def citation_text(text: Column) -> Column:
    """A quoted line as it is cited: LINE_MARKS taken out, white space squeezed."""
    for pattern, by in LINE_MARKS:
        text = F.regexp_replace(text, pattern, by)
    return squeezed(text)


def match_text(text: Column) -> Column:
    """citation_text() with quotes folded, an ellipsis as three dots and any dash or run of hyphens as one, for searching only."""
    folded = F.replace(F.translate(citation_text(text), "‘’“”–—", "''\"\"--"), F.lit("…"), F.lit("..."))
    return squeezed(F.regexp_replace(folded, "-{2,}", "-"))


#: What a containment join takes out of a text: footnote marks and emphasis.
JOIN_NOISE = r"\[\^[a-z0-9]+\]|\*\*|\*|`"
LINK = r"\[([^\]]*)\]\(([^)]*)\)"


def join_text(text: Column, part: int = 1) -> Column:
    """The form that containment joins compare: links as their text (part 1) or target (2), JOIN_NOISE gone, white space squeezed. Null is empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\^[a-z0-9]+\]", "")
    return squeezed(F.regexp_replace(F.regexp_replace(bare, LINK, f"${part}"), JOIN_NOISE, ""))


def link_variants(text: Column) -> Column:
    """Distinct renderings of a text: all links as text, all as target."""
    return F.when(text.rlike(LINK), F.array_distinct(F.array(join_text(text), join_text(text, 2)))).otherwise(F.array(join_text(text)))


#: Renderings of a text beyond which only the two uniform ones count (a fixed value).
MOST_VARIANTS = 8


def mixed_link_variants(text: Column) -> Column:
    """Distinct renderings with every choice of text or target for each link; the two uniform ones where these would be over MOST_VARIANTS."""
    most = MOST_VARIANTS.bit_length() - 1
    links = F.regexp_count(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\^[a-z0-9]+\]", ""), F.lit(LINK))
    first = lambda c, by: F.regexp_replace(c, r"(?s)\A(.*?)" + LINK, "$1" + by)
    every = F.array(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\^[a-z0-9]+\]", ""))
    for _ in range(most):
        every = F.flatten(F.transform(every, lambda c: F.array(first(c, "$2"), first(c, "$3"))))
    return F.when(text.rlike(LINK) & (links <= most), F.array_distinct(F.transform(every, lambda x: join_text(x)))).otherwise(link_variants(text))


def locator(version: Column, path: Column, line: Column, name: Column | None = None) -> Column:
    """version > path > Lline [name]; without a name it isn't unique."""
    at = F.concat_ws(" > ", version, path, F.concat(F.lit("L"), line.cast("string")))
    return at if name is None else F.when(name.isNull(), at).otherwise(F.concat(at, F.lit(" ["), name, F.lit("]")))


def parse_locator(text: Column) -> Column:
    """struct(spec, version, section, b1, s1, b2, s2, error) of ``spec@2025-12-18 > #anchor > ¶2 s1-3`` or ``... > ¶2 s1 - ¶4 s2``.

    Blocks and sentences count from 1; a place without sentences means whole blocks. What can't be read gives the error.
    """
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s*[>›]\s*")
    part = lambda c, p, k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    head = r"^([a-z-]+)(?:@(\d{4}-\d{2}-\d{2}))?$"
    last = F.try_element_at(parts, F.lit(-1))
    placed = (F.size(parts) > 1) & last.rlike(r"^(?:¶|[pP])\d")
    place = F.when(placed, F.replace(last, F.lit(" "), F.lit("")))
    form = r"^(?:¶|[pP])(\d+)(?:[sS](\d+)(?:-(?:[sS]?(\d+)|(?:¶|[pP])(\d+)[sS](\d+)))?)?$"
    n = lambda k: part(place, form, k).cast("int")
    error = F.when(~parts[0].rlike(head), "bad spec identifier").when(placed & ~place.rlike(form), "bad position")
    ok = error.isNull()
    return F.struct(
        F.when(ok, part(parts[0], head, 1)).alias("spec"), F.when(ok, part(parts[0], head, 2)).alias("version"),
        F.when(ok, F.nullif(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1 - placed.cast("int"), F.lit(0))), " > "), F.lit(""))).alias("section"),
        F.when(ok, n(1)).alias("b1"), F.when(ok, n(2)).alias("s1"), F.when(ok, F.coalesce(n(4), n(1))).alias("b2"), F.when(ok, F.coalesce(n(5), n(3), n(2))).alias("s2"), error.alias("error"),
    )


def locator_anchor(text: Column) -> Column:
    """The anchor of ``> #anchor >``, or null."""
    return F.nullif(F.regexp_extract(text, r">\s*#([A-Za-z0-9_-]+)\s*>", 1), F.lit(""))


# Words before a full stop that doesn't end a sentence.
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "cf", "al", "approx", "no", "vol", "dr", "mr", "mrs", "ms", "st", "jr", "sr", "u.s", "u.k")
_SHORT = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
_CLOSERS = "[\"'’”)\\]]"


def sentences(text: Column) -> Column:
    """Sentences: a boundary is the one space after .!? and closers where a capital, digit, quote, bracket, * or # follows, unless an abbreviation stands before."""
    after = rf"(?<=[.!?]{_CLOSERS}{{0,9}}) (?=[\p{{Lu}}\p{{Nd}}\"'‘“(\[*#])"
    short = rf"(?<!(?:^|[\s(])(?i:{_SHORT})[.!?]{{0,9}}\.{_CLOSERS}{{0,9}})"
    parts = F.transform(F.split(F.regexp_replace(text, short + after, "\u0002"), "\u0002"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


FENCED = r"(?m)^(?:```|~~~)"


def span_text(blocks: Column, place: Column) -> Column:
    """What a parse_locator() place covers of an array of raw blocks: blocks b1 to b2, from sentence s1 of the first to s2 of the last, joined by a blank line.

    A block with a fence counts as a whole, as it stands. Out of range is null.
    """

    def covered(place):
        last = F.coalesce(place["b2"], F.lit(0))

        def one(x, i):
            n, said = i + place["b1"], x["said"]
            lo = F.when((n == place["b1"]) & place["s1"].isNotNull(), place["s1"]).otherwise(F.lit(1))
            hi = F.when((n == last) & place["s2"].isNotNull(), place["s2"]).otherwise(F.size(said))
            some = F.when((lo >= 1) & (hi >= lo) & (hi <= F.size(said)), F.array_join(F.slice(said, F.greatest(lo, F.lit(1)), F.greatest(hi - lo + 1, F.lit(0))), " "))
            return F.when(x["raw"].rlike(FENCED), x["raw"]).otherwise(some)

        fits = (place["b1"] >= 1) & (last >= place["b1"]) & (last <= F.size(blocks))
        chosen = F.slice(blocks, F.greatest(F.coalesce(place["b1"], F.lit(1)), F.lit(1)), F.greatest(last - place["b1"] + 1, F.lit(0)))
        split = F.transform(chosen, lambda b: F.struct(b.alias("raw"), sentences(citation_text(b)).alias("said")))
        return F.struct(fits.alias("fits"), F.transform(split, one).alias("texts"))

    # one-element arrays, so that a place is read and blocks are split once, not at each mention
    found = F.transform(F.array(place), covered)
    return F.transform(found, lambda x: F.when(x["fits"] & ~F.exists(x["texts"], F.isnull), F.array_join(x["texts"], "\n\n")))[0]


# Tiers of modal strength.
MODAL_TIERS = {"strong": ("must", "shall", "never", "always"), "medium": ("should", "ought", "will"), "weak": ("may", "might", "can", "could")}


def modal_profile(text: Column) -> Column:
    """struct of how many words of each strength a text has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.struct(*(F.regexp_count(low, F.lit(rf"\b(?:{'|'.join(w)})\b")).cast("bigint").alias(tier) for tier, w in MODAL_TIERS.items()))


def modal_flags(said: Column, source: Column) -> Column:
    """strengthened, weakened or flattened: how a statement's modal words depart from its source's."""
    a, b = modal_profile(said), modal_profile(source)
    return F.array_compact(F.array(
        F.when((a["strong"] > 0) & (b["strong"] == 0), "strengthened"),
        F.when((a["strong"] == 0) & (b["strong"] > 0) & (a["medium"] + a["weak"] > 0), "weakened"),
        F.when((a["strong"] + a["medium"] + a["weak"] == 0) & (b["strong"] + b["medium"] + b["weak"] > 0), "flattened"),
    ))


def formatting_reason(line: Column) -> Column:
    """Why a line carries no content, or null."""
    return (
        F.when(F.trim(line) == "", "blank").when(line.rlike(r"^\s*#{1,6}\s"), "heading").when(line.rlike(r"^\s*(?:```|~~~)"), "fence")
        .when(line.rlike(r"^\s*(?:[-*_]\s*){3,}$"), "rule").when(line.rlike(r"^\s*\|?[\s:|-]+\|[\s:|-]*$"), "table rule")
    )


def mentions(text: Column, name: Column) -> Column:
    """Whether a text names an identifier as a word of its own."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.lower(name), F.lit(" ")))


# Words that a vocabulary key leaves out, words that name the same thing, and parties whose order counts.
KEY_STOPWORDS = "the a an in on is are be being was that this it its and or with has have".split()
SYNONYMS = {
    "query": "request", "prompt": "request", "ask": "request", "question": "request", "message": "request",
    "unclear": "ambiguous", "vague": "ambiguous", "ambiguity": "ambiguous", "underspecified": "ambiguous",
    "assistant": "model", "ai": "model", "chatbot": "model", "human": "user", "person": "user",
    "reply": "response", "answer": "response", "output": "response",
    "decline": "refuse", "refusal": "refuse", "refused": "refuse",
    "harmful": "harm", "unsafe": "harm", "danger": "harm", "dangerous": "harm", "risky": "harm",
    "truthful": "honest", "honesty": "honest", "truthfulness": "honest",
    "instruction": "instruction", "directive": "instruction", "command": "instruction",
}
ORDERED_PARTIES = "user operator developer model assistant system root guideline platform human third_party party".split()


def name_words(name: Column) -> Column:
    """The words of a name that carry meaning, in order: lower case, synonyms folded, singular, no stop words."""
    fold = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    single = lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    words_ = F.transform(F.split(F.lower(F.coalesce(name, F.lit(""))), "_"), lambda w: F.coalesce(F.try_element_at(fold, w), F.try_element_at(fold, single(w)), single(w)))
    return F.filter(words_, lambda w: (w != "") & ~w.isin(KEY_STOPWORDS))


def vocab_key(name: Column) -> Column:
    """Sorted distinct name_words(); where two parties or more are named, their order is appended."""
    kept = name_words(name)
    named = F.filter(kept, lambda w: w.isin(ORDERED_PARTIES))
    key = F.array_join(F.array_sort(F.array_distinct(kept)), " ")
    return F.when(F.size(named) >= 2, F.concat(key, F.lit(" | "), F.array_join(named, ">"))).otherwise(key)


def gloss_is_empty(name: Column, gloss: Column) -> Column:
    """A gloss that says no more than its name."""
    return F.size(F.array_except(tokens(gloss), tokens(name))) == 0


def phrase_coverage(phrase: Column, text: Column) -> Column:
    """Share of a phrase's distinct content words that a text has; 0 without any."""
    p = F.array_distinct(tokens(phrase))
    return F.when(F.size(p) > 0, F.size(F.array_intersect(p, tokens(text))) / F.size(p)).otherwise(F.lit(0.0))


# Words by which a phrase carries a party, a duty, a trigger, an exception or a precedence.
PHRASE_WORDS = {
    "party": (
        r"assistant|users?|user's|developers?|developer's|openai|gpt-\d|system|root|operator|administrators?|end users?|third part\w*|humans?|people|person|"
        r"minors?|teens?|adolescent|adults?|u18|under-18|parent|guardian|counselor|doctor|caregivers?|customers?|audience|sub-?agents?|non-users|platform|organization|account"
    ),
    "deontic": (
        r"must|should|shall|may|cannot|can't|required?|requires|requirement|prohibit\w*|prohibition|forbidden|allow\w*|permit\w*|permission|encourage[ds]?|advised|"
        r"defaults?|do not|don't|never|rules out|avoid\w*|avoidance|obligat\w*|mandat\w*|restrict\w*|not required"
    ),
    "trigger": (
        r"when|whenever|if|in cases where|depending on|upon|during|conditions?|occurs when|applies when|triggers?|only after|as appropriate|when appropriate|in those cases|under high"
    ),
    "exception": (
        r"except|exceptions?|unless|other than|does not apply|only when|only if|aside from|carve-?out|but not|apart from|barring|outside|non-exhaustive"
    ),
    "precedence": (
        r"precedes?|preceded|precedence|overrides?|overriding|overrode|priority|prioriti\w*|higher-level|higher-authority|higher level|higher-order|supersed\w*|supersession|"
        r"subject to|ranks? (?:below|above)|outrank\w*|takes? priority|takes? precedence|preferred over|less preferred|far below|ranks? \w+|hierarch\w*|chain of command|authority"
    ),
}


def phrase_categories(phrase: Column) -> Column:
    """What a phrase carries, in the order of PHRASE_WORDS; empty for none of them. Styles and missions aren't parties, nor is a model spec."""
    low = F.lower(F.coalesce(phrase, F.lit("")))
    has = {k: low.rlike(rf"\b(?:{p})\b") for k, p in PHRASE_WORDS.items()}
    has["party"] = (has["party"] & ~low.rlike("human-like|humanity")) | (low.rlike(r"\bmodels\b") & ~low.contains("model spec"))
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in has.items())))


# Words that a count cosine leaves out.
COUNT_STOPWORDS = (
    "the a an and or of to in for with on by is are be as that this it its not no from at into under over any all one such when if then does do "
    "should must may can could would will has have had was were been"
).split()


def counted_words(text: Column) -> Column:
    """map of word to count, for count_cosine()."""
    said = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9_]+"), F.lit(0))
    kept = F.filter(said, lambda w: ~w.isin(COUNT_STOPWORDS))
    return F.map_from_entries(F.transform(F.array_distinct(kept), lambda w: F.struct(w, F.size(F.filter(kept, lambda x: x == w)))))


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of two texts' word counts, with 1e-9 beside the norms."""
    x, y = counted_words(a), counted_words(b)
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    dot = F.aggregate(F.map_entries(x), F.lit(0.0), lambda s, e: s + e["value"].cast("double") * F.coalesce(F.try_element_at(y, e["key"]), F.lit(0)))
    return dot / (F.sqrt(square(x)) * F.sqrt(square(y)) + F.lit(1e-9))


def content_hash(*columns: Column) -> Column:
    """SHA-256 of columns joined by U+0001, nulls as U+0002."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(c.cast("string"), F.lit("\u0002")) for c in columns)), 256)


def message_cause(message: Column) -> Column:
    """A finding's message with quotes, numbers and paths replaced, so that like findings group."""
    out = F.lower(message)
    for pattern, by in ((r"'[^']*'|\"[^\"]*\"", "<q>"), (r"\S*/\S+", "<path>"), (r"\d+", "<n>"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def banned_keys(payload: Column, keys: list[str]) -> Column:
    """Forbidden keys that a JSON text uses at any depth, sorted; escaped quotes inside strings aren't keys."""
    plain = F.regexp_replace(payload, r'\\.', "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(r'"(' + "|".join(keys) + r')"\s*:'), F.lit(1))))


def verdict_lines(reply: Column, n: int) -> Column:
    """map of number to verdict from ``N: V`` lines, else from the last n bare digits; null if neither fits."""
    pairs = F.regexp_extract_all(reply, F.lit(r"(?m)^\s*(\d+)\s*:\s*([0-2])\b"), F.lit(0))
    keyed = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"(\d+)\s*:", 1).cast("int"), F.regexp_extract(p, r":\s*([0-2])", 1).cast("int")))
    bare = F.regexp_extract_all(reply, F.lit(r"(?m)^\s*([0-2])\s*$"), F.lit(1))
    numbered = F.transform(F.slice(bare, F.greatest(F.lit(1), F.size(bare) - n + 1), n), lambda v, i: F.struct((i + 1).cast("int"), v.cast("int")))
    return F.when(F.size(pairs) > 0, F.map_from_entries(keyed)).when(F.size(bare) >= n, F.map_from_entries(numbered))


def published_quote(quote: Column) -> Column:
    """The caption before a fenced example."""
    return F.trim(F.substring_index(quote, "~~~", 1))


def jaccard_empty_zero(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; two empty ones have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def jaccard_empty_one(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; two empty ones have 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, with 1e-9 beside the norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): the 95 % score interval of k out of n."""
    p, zz = k / n, z * z
    mid, half = p + F.lit(zz) / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(zz) / (4 * n * n))
    return F.struct(((mid - half) / (1 + F.lit(zz) / n)).alias("low"), ((mid + half) / (1 + F.lit(zz) / n)).alias("high"))


def render_atoms(names: Column) -> Column:
    """Atom names as one English sentence."""
    return F.concat(F.lit("The text is about "), F.array_join(F.transform(names, lambda n: F.translate(F.regexp_replace(n, "__", " of "), "_", " ")), ", "), F.lit("."))

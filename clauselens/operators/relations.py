"""Relations between atom names, derived from names, glosses and kinds, checked and merged.

Relation rows are (rel, a, b, via, source). contrary and same_as are symmetric, with the smaller
name first; subsumes and entails point from a to b and must have no cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_words, stemmed_rows, raw_words, vocab_key
from ..lineage import cut
from .rules import feedback_edges

# Words that turn a name into its opposite, pairs of opposites, prefixes that make one.
NEGATION_WORDS = "avoid avoids avoiding not no non without absent lack lacking refrain prevent prevents preventing anti un".split()
ANTONYMS = (
    ("over", "under"), ("accept", "refuse"), ("comply", "refuse"), ("allow", "prohibit"), ("allow", "forbid"), ("permit", "deny"),
    ("disclose", "conceal"), ("disclose", "hide"), ("reveal", "hide"), ("honest", "deceptive"), ("honest", "deceive"), ("help", "harm"),
    ("explicit", "implicit"), ("public", "private"), ("known", "unknown"), ("ambiguous", "clear"), ("certain", "uncertain"), ("safe", "harm"),
    ("increase", "decrease"), ("follow", "violate"), ("obey", "violate"), ("enable", "disable"), ("include", "exclude"), ("present", "absent"),
    ("more", "less"), ("grant", "revoke"), ("trusted", "untrusted"), ("success", "failure"), ("agree", "disagree"), ("required", "optional"),
)
OPPOSITE_PREFIXES = ("un", "non", "dis", "in", "im")
RELATIONS = ("subsumes", "entails", "contrary", "same_as")
SYMMETRIC, ACYCLIC, ONE_KIND = ("contrary", "same_as"), ("subsumes", "entails"), ("subsumes", "contrary", "same_as")
#: Rules from the strongest to the weakest.
RULES = ("contrary_negation", "contrary_antonym", "same_as_key", "entails_nominalisation", "subsumes_name_tokens", "subsumes_gloss_names", "subsumes_gloss_tokens")


def described(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (name, kind, gloss, n) with words, key and gloss_words: sorted distinct words of names and stems of glosses. Null kind and gloss are empty, null n is 0."""
    v = vocabulary.select("name", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("gloss", F.lit("")).alias("gloss"), F.coalesce(F.col("n").cast("bigint"), F.lit(0)).alias("n"))
    stems = stemmed_rows(v.select("name", F.explode(raw_words(F.col("gloss"))).alias("w")), "w").groupBy("name").agg(F.array_sort(F.collect_set("w")).alias("gloss_words"))
    words = F.array_sort(F.array_distinct(name_words(F.col("name"))))
    return v.join(stems, "name", "left").select("name", "kind", "n", words.alias("words"), vocab_key(F.col("name")).alias("key"), F.coalesce("gloss_words", F.array().cast("array<string>")).alias("gloss_words"))


def _subset_pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b, wa, wb) of one kind where a's words (name, kind, words) all stand among b's: an index on words, counted, so no pair without a shared word is formed.

    Only the word of each small set that the fewest large sets hold is looked up.
    """
    df = large.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    x = small.select(F.col("name").alias("a"), "kind", F.col("words").alias("wa"), F.explode("words").alias("w")).join(df, "w")
    rare = x.groupBy("a", "kind", "wa").agg(F.min(F.struct("df", "w"))["w"].alias("w"))
    y = large.select(F.col("name").alias("b"), "kind", F.col("words").alias("wb"), F.explode("words").alias("w"))
    return rare.join(y, ["w", "kind"]).where((F.col("a") != F.col("b")) & (F.size(F.array_except("wa", "wb")) == 0)).select("a", "b", "wa", "wb")


def mechanical(vocabulary: DataFrame) -> DataFrame:
    """(rel, a, b, via, source, rank): every relation that RULES derive, before any check. vocabulary (name, kind, gloss, n), one row a name.

    rank orders rows by rule, then by falling n of a and rising n of b.
    """
    v = cut(described(vocabulary))
    words = v.select("name", "kind", "words")
    rows = []
    say = lambda df, rel, via: rows.append(df.select(F.lit(rel).alias("rel"), "a", "b", F.lit(via).alias("via")))
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # contrary: the words differ by negations alone, so what is left without them is equal
    neg = F.filter("words", lambda w: w.isin(NEGATION_WORDS))
    bare = words.select("name", "kind", "words", F.array_except("words", neg).alias("bare"), neg.alias("neg"))
    l, r = (bare.select(F.col("name").alias(n), "kind", "bare", F.col("neg").alias("n" + n)) for n in "ab")
    both = l.join(r, ["kind", "bare"]).where("a < b and na <> nb").where((F.size(F.array_except("na", "nb")) == 0) | (F.size(F.array_except("nb", "na")) == 0))
    say(both, "contrary", RULES[0])

    # contrary: equal but for one word each, and those are opposites
    holes = words.select("name", "kind", F.explode("words").alias("w"), "words").select("name", "kind", "w", F.array_except("words", F.array("w")).alias("rest"))
    pairs = [(x, y) for p in ANTONYMS for x, y in (p, p[::-1])]
    opposite = holes.sparkSession.createDataFrame(pairs, "w string, v string")
    listed = holes.withColumnRenamed("name", "a").join(F.broadcast(opposite), "w")  # a fixed table
    built = holes.withColumnRenamed("name", "a").select("a", "kind", "rest", "w", F.explode(F.array(*(F.concat(F.lit(p), "w") for p in OPPOSITE_PREFIXES))).alias("v"))
    other = holes.select(F.col("name").alias("b"), "kind", "rest", F.col("w").alias("v"))
    say(pair(listed.select("a", "kind", "rest", "v").union(built.select("a", "kind", "rest", "v")).join(other, ["kind", "rest", "v"]).where("a <> b").select("a", "b")), "contrary", RULES[1])

    # same_as, and entails from act to situation: one key
    l, r = (v.select(F.col("name").alias(n), "key", F.col("kind").alias("k" + n)) for n in "ab")
    keyed = l.join(r, "key")
    say(keyed.where("a < b and ka = kb"), "same_as", RULES[2])
    say(keyed.where("ka = 'act' and kb = 'situation'"), "entails", RULES[3])

    # subsumes: more words, none of them a negation; a gloss that names the other; a gloss that says more
    some = words.where(F.size("words") > 0)
    more = _subset_pairs(some, some).where(F.size("wa") < F.size("wb"))
    say(more.where(~F.arrays_overlap(F.array_except("wb", "wa"), F.array(*map(F.lit, NEGATION_WORDS)))), "subsumes", RULES[4])
    glosses = v.select("name", "kind", F.col("gloss_words").alias("words")).where(F.size("words") > 0)
    named = _subset_pairs(words.where(F.size("words") >= 2), glosses).join(v.select(F.col("name").alias("b"), F.col("words").alias("own")), "b")
    say(named.where(~((F.size(F.array_except("wa", "own")) == 0) & (F.size("wa") < F.size("own")))), "subsumes", RULES[5])
    wide = _subset_pairs(glosses.where(F.size("words") >= 3), glosses).where(F.size("wa") < F.size("wb"))
    say(wide, "subsumes", RULES[6])

    out = reduce(DataFrame.union, rows).distinct()
    n = lambda x: v.select(F.col("name").alias(x), F.col("n").alias("n" + x))
    rank = F.struct(F.array_position(F.array(*map(F.lit, RULES)), F.col("via")).alias("rule"), (-F.col("na")).alias("na"), F.col("nb"), F.col("a"), F.col("b"))
    return out.join(n("a"), "a").join(n("b"), "b").select("rel", "a", "b", "via", F.lit("mechanical").alias("source"), rank.alias("rank"))


def refused(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """rows (rel, a, b, rank, ...) with reason: the first ground to refuse a relation, or null. vocabulary (name, kind).

    bad_relation, unknown_atom, self_loop, cross_kind, contradictory_pair (a pair that is also contrary), duplicate (a better
    ranked row says the same), cycle (kept edges of better rank already lead back, feedback_edges()).
    """
    k = vocabulary.groupBy("name").agg(F.coalesce(F.min("kind"), F.lit("")).alias("kind"))
    j = rows.join(k.select(F.col("name").alias("a"), F.col("kind").alias("ka")), "a", "left").join(k.select(F.col("name").alias("b"), F.col("kind").alias("kb")), "b", "left")
    sym = F.col("rel").isin(*SYMMETRIC)
    j = j.withColumns({"x": F.when(sym, F.least("a", "b")).otherwise(F.col("a")), "y": F.when(sym, F.greatest("a", "b")).otherwise(F.col("b"))})
    first = F.when(~F.col("rel").isin(*RELATIONS), "bad_relation").when(F.col("ka").isNull() | F.col("kb").isNull(), "unknown_atom").when(F.col("a") == F.col("b"), "self_loop").when(F.col("rel").isin(*ONE_KIND) & (F.col("ka") != F.col("kb")), "cross_kind")
    j = cut(j.withColumn("reason", first))
    against = j.where("rel = 'contrary' and reason is null").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct().withColumn("against", F.lit(True))
    j = j.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(against, ["lo", "hi"], "left")
    j = j.withColumn("reason", F.coalesce("reason", F.when((F.col("rel") != "contrary") & F.col("against"), "contradictory_pair"))).drop("lo", "hi", "against")
    same = Window.partitionBy("rel", "x", "y").orderBy(F.col("reason").isNotNull(), "rank")
    j = cut(j.withColumn("reason", F.coalesce("reason", F.when(F.row_number().over(same) > 1, "duplicate"))))
    back = [feedback_edges(j.where((F.col("rel") == r) & F.col("reason").isNull()).select("a", "b", "rank")).select(F.lit(r).alias("rel"), "a", "b", F.lit(True).alias("back")) for r in ACYCLIC]
    j = j.join(reduce(DataFrame.union, back), ["rel", "a", "b"], "left")
    return j.withColumn("reason", F.coalesce("reason", F.when(F.col("back"), "cycle"))).select(*rows.columns, "reason")


def merged(*parts: DataFrame) -> DataFrame:
    """(rel, a, b, source, via) of several relation tables (rel, a, b, via, source): each triple once; ``both`` where sources differ, then with all ways joined by +, else the first way."""
    sym = F.col("rel").isin(*SYMMETRIC)
    rows = reduce(DataFrame.unionByName, (p.select("rel", F.when(sym, F.least("a", "b")).otherwise(F.col("a")).alias("a"), F.when(sym, F.greatest("a", "b")).otherwise(F.col("b")).alias("b"), "via", "source", F.lit(i).alias("i")) for i, p in enumerate(parts)))
    ways = rows.groupBy("rel", "a", "b", "via").agg(F.min("i").alias("i"), F.collect_set("source").alias("s"))
    g = ways.groupBy("rel", "a", "b").agg(F.array_sort(F.collect_list(F.struct("i", "via"))).alias("w"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    many = F.size("s") > 1
    return g.select("rel", "a", "b", F.when(many, "both").otherwise(F.col("s")[0]).alias("source"), F.when(many, F.array_join(F.transform("w", lambda x: x["via"]), "+")).otherwise(F.col("w")[0]["via"]).alias("via"))


def contraries(relations: DataFrame) -> DataFrame:
    """(name, against): both directions of the contrary pairs."""
    c = relations.where("rel = 'contrary'").select(F.col("a").alias("name"), F.col("b").alias("against"))
    return c.union(c.select("against", "name")).distinct()


def is_opposite(x: Column, y: Column) -> Column:
    """Whether two words are opposites, by the list or by a prefix."""
    listed = F.concat_ws("|", x, y).isin([f"{a}|{b}" for p in ANTONYMS for a, b in (p, p[::-1])])
    return reduce(Column.__or__, (F.concat(F.lit(p), s) == t for p in OPPOSITE_PREFIXES for s, t in ((x, y), (y, x))), listed)

"""Rule-based labels and scores, all as column expressions over one row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.text import all_anchors, bits, bound, count_phrases, matches, may_hold, quoted, unless


def any_substring(c: Column, terms: Iterable[str]) -> Column:
    return c.rlike("|".join(map(quoted, terms)))


def is_relevant(name: str, condition: str, *, products: Iterable[str] | None = None, conditions: Iterable[str] | None = None) -> Column:
    """A product's name or a condition holds a known one; nulls hold none."""
    hit = lambda c, terms: F.coalesce(any_substring(F.lower(c), terms), F.lit(False))
    return hit(name, config.PRODUCTS if products is None else products) | hit(condition, config.CONDITIONS if conditions is None else conditions)


def first_match(c: Column, categories: Mapping[str, str], default: str = "other") -> Column:
    """The category of the first key that c holds."""
    out = None
    for key, category in categories.items():
        hit = F.contains(c, F.lit(key))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return F.lit(default) if out is None else out.otherwise(default)


def map_value(c: Column, values: Mapping[str, str]) -> Column:
    """The value of c as a key, null if it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def product_category(name: str) -> Column:
    return first_match(F.coalesce(F.lower(name), F.lit("")), config.PRODUCTS)


def folder_category(name: str, *, version: int = 1) -> Column:
    """The category of a folder of reports, by the first substance of a combination.

    Version 1 cuts at "&" and looks into aliases and then products; version 2 cuts at " & " and looks into folder
    names, exact ones first.
    """
    primary = F.trim(F.lower(F.split(F.col(name), "&" if version == 1 else " & ")[0]))
    exact, parts = (config.PRODUCT_ALIASES, config.PRODUCTS) if version == 1 else (config.FOLDERS, config.FOLDERS)
    return F.coalesce(map_value(primary, exact), first_match(primary, parts))


def risk_label(text: str, rating: str | None = None, *, high=config.HIGH_RISK_PHRASES, distress=config.DISTRESS_PHRASES, distress_alone: bool = False) -> Column:
    """high: a high-risk phrase, or two distress phrases and a rating of at most 3 (or whatever the rating if
    distress_alone). medium: a distress phrase or a rating of at most 4. A null rating passes no test."""
    n_high, n_distress = count_phrases(text, high), count_phrases(text, distress)
    at_most = lambda k: F.coalesce(F.col(rating) <= k, F.lit(False)) if rating else F.lit(False)
    low_enough = F.lit(True) if distress_alone else at_most(3)
    return F.when((n_high >= 1) | ((n_distress >= 2) & low_enough), "high").when((n_distress >= 1) | at_most(4), "medium").otherwise("low")


def _hits(c: Column, patterns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, [c.rlike("(?i)" + p).cast("int") for p in patterns], F.lit(0))


def _any(c: Column, low: Column, patterns: Iterable[str]) -> Column:
    """Whether one of the patterns occurs; each is searched only in texts that can have it. low is c in lower case."""
    return reduce(lambda a, b: a | b, [matches(c, "(?i)" + p, low) for p in patterns])


def substance_score(text: str, substances: str, *, weights=None, boosts: Mapping[str, float] | None = None, negation=config.NEGATION, past=config.PAST) -> Column:
    """The largest weight among the substances, a fifth of it if the text negates, half if it is about the past.

    Negation holds for the whole text and all its substances. boosts add to a weight, up to 1.
    """
    weights = config.SUBSTANCE_WEIGHTS if weights is None else weights
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    base = lambda s: F.coalesce(F.element_at(table, s), F.lit(config.DEFAULT_SUBSTANCE_WEIGHT))
    if boosts:
        extra = F.create_map(*[F.lit(x) for k, v in boosts.items() for x in (k, float(v))])
        plain = base
        base = lambda s: F.least(plain(s) + F.coalesce(F.element_at(extra, s), F.lit(0.0)), F.lit(1.0))
    t = F.col(text)
    factor = bound(F.lower(t), lambda low: F.when(matches(t, "(?i)" + negation, low), 0.20).when(matches(t, "(?i)" + past, low), 0.50).otherwise(1.0))
    most = F.array_max(F.transform(F.col(substances), base))  # the factor is one for all, and only looked for if there is one
    return F.round(F.coalesce(F.when(F.size(substances) > 0, most * factor), F.lit(0.0)), 3)


def distress_score(text: str, signals: str, *, weights=None, urgency=config.URGENCY, escalation=config.ESCALATION, some: Column | None = None) -> Column:
    """The largest of the categories' weights, .20 for three categories, .95 for urgency, .70 for escalation. some is
    false only where no pattern of the last two occurs."""
    weights = config.DISTRESS_WEIGHTS if weights is None else weights
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    of = F.array_max(F.transform(F.map_keys(signals), lambda k: F.coalesce(F.element_at(table, k), F.lit(config.DEFAULT_DISTRESS_WEIGHT))))
    t, zero = F.col(text), F.lit(0.0)
    told = bound(F.lower(t), lambda low: F.when(_any(t, low, urgency), 0.95).when(_any(t, low, escalation), 0.70).otherwise(zero))
    best = F.greatest(F.coalesce(of, zero), F.when(F.size(signals) >= 3, 0.20).otherwise(zero), unless(some, told, zero))
    return F.round(F.least(best, F.lit(1.0)), 3)


def behavior_score(text: str, groups=None, *, some: Column | None = None) -> Column:
    """The largest weight among the groups of which a pattern occurs. some is false only where no pattern does."""
    t, zero = F.col(text), F.lit(0.0)
    groups = list((config.BEHAVIOURS if groups is None else groups).values())
    best = lambda low: F.greatest(*[F.when(_any(t, low, patterns), float(w)).otherwise(zero) for w, patterns in groups], zero, zero)
    return F.round(unless(some, bound(F.lower(t), best), zero), 3)


def evidence(text: str, substances: str, signals: str, groups=None) -> Column:
    """What the scores rest on, as short lines."""
    subs = F.transform(F.col(substances), lambda s: F.concat(F.lit("Substance: "), s))
    dist = F.transform(F.map_entries(signals), lambda e: F.concat(F.lit("Distress: "), e["key"], F.lit(" (phrases: "), F.array_join(F.slice(e["value"], 1, 2), ", "), F.lit(")")))
    found = []
    for name, (_, patterns) in (config.BEHAVIOURS if groups is None else groups).items():
        n = _hits(F.col(text), patterns)
        found.append(F.when(n > 0, F.concat(F.lit(f"Behavior: {name} ("), n.cast("string"), F.when(n > 1, " pattern matches)").otherwise(" pattern match)"))))
    return F.concat(subs, dist, F.filter(F.array(*found), lambda x: x.isNotNull()))


def classify(posts: DataFrame, *, text: str = "processed_text", substances: str = "substances_detected", signals: str = "distress_signals", weights=None, groups=None, boosts=None) -> DataFrame:
    """Adds substance_score, distress_score, behavior_score, combined_score and risk_level.

    high: a combined score of .55, the overdose category, behaviour of .90, or substance .90 and distress .70;
    medium: .30.
    """
    behaviours = config.BEHAVIOURS if groups is None else groups
    searched = [[*config.URGENCY, *config.ESCALATION], [p for _, patterns in behaviours.values() for p in patterns]]
    known = posts.withColumn("__m", may_hold(F.lower(text), [all_anchors("(?i)" + p for p in patterns) for patterns in searched]))
    scored = known.withColumns(
        {
            "substance_score": substance_score(text, substances, weights=weights, boosts=boosts),
            "distress_score": distress_score(text, signals, some=bits("__m", 1)),
            "behavior_score": behavior_score(text, groups, some=bits("__m", 2)),
        }
    ).drop("__m")
    return combine(scored, hard=F.coalesce(F.array_contains(F.map_keys(signals), "overdose"), F.lit(False)))


def combine(scored: DataFrame, *, hard: Column | None = None) -> DataFrame:
    s, d, b = F.col("substance_score"), F.col("distress_score"), F.col("behavior_score")
    w = config.LAYER_WEIGHTS
    out = scored.withColumn("combined_score", F.round(w["substance"] * s + w["distress"] * d + w["behavior"] * b, 3))
    certain = (b >= 0.90) | ((s >= 0.90) & (d >= 0.70))
    certain = certain if hard is None else hard | certain
    level = F.when(certain | (F.col("combined_score") >= 0.55), "high").when(F.col("combined_score") >= 0.30, "medium").otherwise("low")
    return out.withColumn("risk_level", level)


def route(score: str = "combined_score", *, high: float = 0.70, low: float = 0.15) -> Column:
    return F.when(F.col(score) >= high, "rule_based_high").when(F.col(score) <= low, "rule_based_low").otherwise("llm")


def route_hybrid(posts: DataFrame, *, id_col: str = "post_id", score: str = "combined_score", confidence: str = "confidence", cap: int | None = 200) -> DataFrame:
    """Adds routing: rule_high from .75, rule_low to .10, embedding in (.10, .40) if it is confident (.20), else llm.

    cap is the feature's limit on calls to the model: of the llm rows the first cap by the hash of their ids stay.
    None keeps all.
    """
    s = F.col(score)
    sure = (s > 0.10) & (s < 0.40) & F.coalesce(F.col(confidence) >= 0.20, F.lit(False))
    routed = posts.withColumn("routing", F.when(s >= 0.75, "rule_high").when(s <= 0.10, "rule_low").when(sure, "embedding").otherwise("llm"))
    if cap is None:
        return routed
    queue = routed.where("routing = 'llm'").orderBy(F.xxhash64(id_col), id_col).limit(cap)
    return routed.where("routing <> 'llm'").unionByName(queue)


def harm_boosts(profiles: DataFrame, *, terms=config.HARM_TERMS) -> DataFrame:
    """(substance, boost) of topic profiles (substance, dominant_topic_terms): .05, .10, .15 from 3, 5, 7 harm terms."""
    n = F.size(F.array_intersect(F.transform("dominant_topic_terms", F.lower), F.array(*map(F.lit, terms))))
    boost = F.when(n >= 7, 0.15).when(n >= 5, 0.10).when(n >= 3, 0.05)
    return profiles.select("substance", boost.alias("boost")).where("boost IS NOT NULL")


def slang_extensions(profiles: DataFrame, *, lexicon: Mapping[str, str] | None = None, blocked: Iterable[str] = ()) -> DataFrame:
    """(term, canonical) that topic profiles add to a lexicon: letters only, three or more, new, the first profile wins."""
    known = {*(config.SLANG if lexicon is None else lexicon), *blocked}
    terms = profiles.select("substance", F.posexplode("dominant_topic_terms").alias("place", "term")).withColumn("term", F.lower(F.trim("term")))
    new = terms.where(F.col("term").rlike(r"^\p{L}{3,}$") & ~F.col("term").isin(*known))
    return new.groupBy("term").agg(F.min(F.struct("substance", "place")).alias("s")).select("term", F.col("s.substance").alias("canonical"))


def mine_lexicon(reviews: DataFrame, *, text: str, term: str, window: int = 5, least: int = 2) -> DataFrame:
    """(canonical, term, n): how often words stand within window words of the canonical that term names."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    at = F.array_position(words, F.lower(term))
    first = F.greatest(at - window, F.lit(1))
    near = F.when(at > 0, F.slice(words, first.cast("int"), (at + window - first + 1).cast("int")))
    rows = reviews.select(F.lower(term).alias("canonical"), F.explode(near).alias("term"))
    rows = rows.where((F.length("term") >= 3) & ~F.col("term").isin(*config.STOPWORDS) & (F.col("term") != F.col("canonical")))
    return rows.groupBy("canonical", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)

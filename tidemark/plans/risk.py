"""From raw posts to fused risk verdicts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import text as X
from tidemark.operators import ensemble, rules
from tidemark.session import spread


def text_hash(text: str) -> Column:
    """What texts are compared by: 256 bits."""
    return F.sha2(F.col(text).cast("binary"), 256)


def distinct_posts(posts: DataFrame, *, text: str, id_col: str) -> DataFrame:
    """One row of each distinct text, that of the smallest id; null texts are left out.

    Texts are equal if their 256-bit hashes are. Only texts that occur more than once have an entry on the other side
    of the join, which adaptive execution broadcasts if it turns out small.
    """
    rows = posts.where(F.col(text).isNotNull()).withColumn("__h", text_hash(text))
    first = rows.groupBy("__h").agg(F.min(id_col).alias("__i"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).drop("__n")
    return rows.join(first, "__h", "left").where(F.col("__i").isNull() | (F.col(id_col) == F.col("__i"))).drop("__h", "__i")


def one_a_text(found: DataFrame, key: str, *, id_col: str = "post_id") -> DataFrame:
    """The row of the smallest id for each text_hash() in key, which is dropped, where all other columns follow from the
    text. Only these columns are shuffled, whereas distinct_posts() shuffles the texts."""
    rest = [c for c in found.columns if c not in (key, id_col)]
    return found.groupBy(key).agg(F.min(id_col).alias(id_col), *[F.first(c).alias(c) for c in rest]).select(*[c for c in found.columns if c != key])


def preprocess(posts: DataFrame, *, text: str, id_col: str, time: str | None = None, lexicon: Mapping[str, str] | None = None, signals: Mapping[str, Iterable[str]] | None = None, unescape: bool = True, carry: Iterable[str] = (), dedup: bool = True) -> DataFrame:
    """Cleaned, scrubbed and normalised posts with what was found in them, one row of each distinct raw text.

    carry names columns to keep, such as labels. Terms are normalised before signals are looked for.
    """
    lexicon = config.SLANG if lexicon is None else lexicon
    posts = spread(posts)
    rows = distinct_posts(posts, text=text, id_col=id_col) if dedup else posts.where(F.col(text).isNotNull())
    cleaned = F.lower(X.scrub(X.clean(text, unescape=unescape)))
    out = rows.select(F.col(id_col).alias("post_id"), *([F.col(time).alias("timestamp")] if time else []), *carry, F.col(text).alias("original_text"), cleaned.alias("__low"))
    # One search for all terms and one for all phrases say which texts need the searches for each. A text with a term
    # changes, so that anything may occur in it.
    signals = config.DISTRESS_SIGNALS if signals is None else signals
    lexicon, whole = dict(lexicon), lambda terms: [f"{X.EDGE}{t}{X.EDGE}" for t in terms]
    low = all(t.isascii() and t == t.lower() for t in lexicon.values())
    out = out.withColumn("__m", X.may_hold(F.col("__low"), [whole(lexicon), whole(lexicon.values()), [p for v in signals.values() for p in v]]))
    out = out.withColumn("processed_text", X.normalize_terms("__low", lexicon, some=X.bits("__m", 1), low=True))
    found = {"substances_detected": X.whole_terms("processed_text", lexicon.values(), some=X.bits("__m", 1 | 2), low=low), "distress_signals": X.phrase_hits("processed_text", signals, some=X.bits("__m", 1 | 4), low=low)}
    out = out.withColumns(found).drop("__low", "__m")
    return out.withColumns(
        {
            "distress_count": F.size("distress_signals"),
            "has_substance_mention": F.size("substances_detected") > 0,
            "has_distress_signal": F.size("distress_signals") > 0,
        }
    )


def quality_report(posts: DataFrame, *, key: str | None = None) -> DataFrame:
    """One row of counts over preprocessed posts.

    Posts with equal keys, which are copies of one text, count once. They meet as a few numbers each, so that no text
    is shuffled or sorted, as distinct_posts() has to.
    """
    found = {"substance": F.col("has_substance_mention"), "distress": F.col("has_distress_signal"), "pii": X.has_pii("processed_text"), "length": F.length("processed_text")}
    posts = posts.select(*([key] if key else []), *[c.alias(k) for k, c in found.items()])
    if key:
        posts = posts.groupBy(key).agg(*[F.max(k).alias(k) for k in found])
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return posts.agg(
        F.count(F.lit(1)).alias("n_posts"), share("substance").alias("substance_rate"), share("distress").alias("distress_rate"),
        F.count_if("pii").alias("n_with_pii"), F.count_if(F.col("length") == 0).alias("n_empty"), F.round(F.avg("length"), 6).alias("mean_length"),
    )


def rule_verdicts(posts: DataFrame, **options) -> DataFrame:
    """Scores, risk_level, evidence and routing of preprocessed posts."""
    out = rules.classify(posts, **options)
    return out.withColumns({"evidence": rules.evidence("processed_text", "substances_detected", "distress_signals"), "routing": rules.route(), "method": F.lit("rule_based")})


def fused_verdicts(rule: DataFrame, embedding: DataFrame, llm: DataFrame | None = None, finetuned: DataFrame | None = None, *, key: str = "post_id") -> DataFrame:
    """Merges verdicts, one row a key and source, and votes."""
    once = lambda df: None if df is None else ensemble.one_per_key(df.select(key, "risk_level", "confidence"), key)
    return ensemble.vote(ensemble.merge_verdicts(once(rule), once(embedding), once(llm), once(finetuned), key=key))

import html
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import text as X


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(fn("t").alias("x")).first()["x"]


def test_clean_drops_marks(spark):
    assert one(spark, "Visit http://x.y #relapse @bob <b>now</b> &amp; go", X.clean) == "Visit relapse now & go"
    assert one(spark, None, X.clean) is None and one(spark, "", X.clean) == ""
    assert one(spark, "café @jörg #über", X.clean) == "café über"


def test_scrub(spark):
    assert one(spark, "call 555-123-4567 or 64110-1234", X.scrub) == "call [PHONE] or [ZIP]"
    assert one(spark, "mail Ann.B+c@Ex-ample.ORG now", X.scrub) == "mail [EMAIL] now"
    assert one(spark, "x@y.z (816) 555 0199 12", lambda c: X.scrub(c, loose=True)).startswith("[EMAIL] ")
    cleaned = one(spark, "a@b.com 5551234567", lambda c: X.scrub(X.clean(c)))
    assert cleaned == "a.com [PHONE]"  # cleaning takes the mention first


def test_nothing_personal_is_left(spark):
    texts = ["call 816-555-0100, 64110", "write to me@x.org", "Mr. Smith said", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.has_pii("t")).collect()] == [True, True, True, False]
    assert not any(r[0] for r in df.limit(2).select(X.has_pii(X.scrub("t"))).collect())


def test_slang(spark):
    assert one(spark, "Took Oxys and black tar, dope sick", X.normalize_terms) == "took oxycodone and heroin, withdrawal"
    assert one(spark, "a$b c$ x", lambda c: X.normalize_terms(c, {"x": "c$\\1"})) == "a$b c$ c$\\1"


def twin(text, lexicon):
    out = text.lower()
    for t in sorted(lexicon, key=lambda t: -len(t)):
        out = re.sub(rf"\b{re.escape(t)}\b", lexicon[t], out)
    return out


def test_slang_equals_term_by_term(spark):
    import random

    rng = random.Random(1)
    words = [*config.SLANG, "and", "the", "dopey", "h.", "k-pins,", "black", "tar", "sick"]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["x"] for r in df.select(X.normalize_terms("t").alias("x")).collect()]
    assert got == [twin(t, config.SLANG) for t in texts]


def test_slang_and_back(spark):
    df = spark.createDataFrame([(i, "heroin and xanax then withdrawal") for i in range(20)], "i long, t string")
    mutated = df.withColumn("m", X.to_slang("t", "i"))
    rows = mutated.select("m", X.normalize_terms("m").alias("b")).collect()
    assert len({r["m"] for r in rows}) > 3 and {r["b"] for r in rows} == {"heroin and xanax then withdrawal"}


def test_phrases_and_terms(spark):
    got = one(spark, "I OVERDOSED and can't sleep, need more. Sick", X.phrase_hits)
    assert got == {"overdose": ["overdosed", "overdose"], "withdrawal": ["sick", "can't sleep"], "desperation": ["need more"]}
    assert one(spark, "Heroin, fentanyl-laced heroine", lambda c: X.whole_terms(c, config.SLANG.values())) == ["fentanyl", "heroin"]


def window_twin(text, term, window=5):
    words = re.findall(r"\b\w+\b", text.lower())
    if term not in words:
        return []
    at = words.index(term)
    return [w for w in words[max(0, at - window) : at + window + 1] if len(w) >= 3 and w not in config.STOPWORDS and w != term]


def test_window_terms(spark):
    assert one(spark, "a b cc ddd tramadol eee the fff", lambda c: X.window_terms(c, "tramadol")) == ["ddd", "eee", "fff"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in docs.select("text", X.window_terms("text", "thnt").alias("x")).collect():
        assert r["x"] == window_twin(r["text"], "thnt")


def test_ids_counts_years(spark):
    assert re.fullmatch(r"report_co_ca_ine_[0-9a-f]{12}", one(spark, " Co-ca ine!", lambda c: X.stable_id("report", c, F.lit("p/1.txt"))))
    assert [one(spark, t, X.word_count) for t in ("", "  ", "a  b\nc")] == [0, 0, 3]
    assert one(spark, "x Year: 2004 in 1999", X.labelled_year) == 2004 and one(spark, "none", X.labelled_year) is None
    assert one(spark, "born 1779, in 1985 and 2004", X.first_year) == 1985 and one(spark, "1979", X.first_year) is None
    assert one(spark, "```json\n{\"a\": 1}\n```", X.json_body) == '{"a": 1}'
    assert one(spark, "harm_reduction_score", X.title_case) == "Harm Reduction"


def test_html_text_equals_another_parse(spark):
    class Parts(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.out, self.skip = [], 0

        def handle_starttag(self, t, a):
            self.skip += t in ("script", "style")
            self.out.append(" ")

        def handle_endtag(self, t):
            self.skip = max(0, self.skip - (t in ("script", "style")))
            self.out.append(" ")

        def handle_data(self, d):
            self.out.append("" if self.skip else d)

        def handle_entityref(self, n):
            self.out.append(html.unescape(f"&{n};"))

        handle_comment = lambda self, d: self.out.append(" ")

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", X.html_text("html").alias("x")).collect():
        p = Parts()
        p.feed(r["html"])
        p.close()
        assert r["x"].split() == "".join(p.out).split()
    assert one(spark, "<p>a&amp;b<script>no()</script><b>c</b></p>", X.html_text) == "a&b c"


@pytest.mark.parametrize(("loose", "text", "want"), [(False, "1234567", "1234567"), (True, "12 34 56 78 90", "[PHONE]")])
def test_phone_patterns(spark, loose, text, want):
    assert one(spark, text, lambda c: X.scrub(c, loose=loose)) == want

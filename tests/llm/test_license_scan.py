from tests.llm.conftest import TEXTS
from tidemark.llm.license_scan import RULES, SENTENCES, Recogniser, scan_licenses
from tidemark.llm.queries import op5_license_scan

SF = "/root/testdata/sf0.01"
R = Recogniser(SENTENCES, RULES)


def names(text):
    return [m[2] for m in R.scan(text)]


def test_known_licences():
    mit = "Copyright (c) 2020 Someone\n\n" + ".\n\n".join(SENTENCES[k] for k in ("MIT-GRANT", "MIT-NOTICE", "AS-IS-MIT"))
    assert names(mit) == ["MIT"] and R.scan(mit)[0][3] == "MIT-GRANT+MIT-NOTICE+AS-IS-MIT"
    wrapped = "# " + SENTENCES["APACHE-GRANT"].replace(" may ", "\n# may ").replace(" in ", "\n# in ") + ".\n#\n# " + SENTENCES["APACHE-AS-IS"] + "."
    assert names(wrapped) == ["Apache-2.0"]
    bsd = ":\n".join(SENTENCES[k] for k in ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"))
    assert names(bsd) == ["BSD-2-Clause"] and names(bsd + ". " + SENTENCES["BSD-NAMES"]) == ["BSD-3-Clause"]
    assert names("// SPDX-License-Identifier: Apache-2.0 OR MIT\nint x;") == ["Apache-2.0 OR MIT"]
    assert names("licensed under the mit license") == ["MIT"]
    assert names("He was granted permission, and the licence of poetry.") == [] == names(None) == names("")


def test_identifiers_match_brute_force():
    import re

    text = "Intro. " + SENTENCES["GPL-HOPE"] + ". Between. " + SENTENCES["GPL-2-PLUS"] + "! All rights reserved"
    words = re.findall(r"[^\W_]+", text.lower())
    want = set()
    for name, s in SENTENCES.items():
        known = re.findall(r"[^\W_]+", s.lower())
        want |= {name for i in range(len(words)) if words[i : i + len(known)] == known}
    assert {f[3] for f in R.identifiers(text)} == want


def test_order_of_rules_matters():
    swapped = SENTENCES["GPL-HOPE"] + ". " + SENTENCES["GPL-2-PLUS"]
    assert R.scan(swapped)[0][3] == "GPL-2-PLUS"


def test_odd_rows(spark, odd_docs, no_docs):
    rows = scan_licenses(odd_docs).collect()
    assert len(rows) == len(TEXTS) and all(r["matches"] == [] for r in rows)
    assert scan_licenses(no_docs).count() == 0


def test_query_over_the_whole_table(spark):
    import re

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in op5_license_scan(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        plain = " ".join(re.findall(r"[^\W_]+", t.lower()))
        for sentence, licence in (("licensed under the apache license version 2 0", "Apache-2.0"), ("released under the mit license", "MIT"), ("licensed under cc by nc 4 0", "CC-BY-NC-4.0"), ("this work is licensed under the gnu general public license version 3", "GPL-3.0-only")):
            assert (licence in rows[i]["licenses"].split(",")) == (sentence in plain)


def plain_matches(found, rules, gap):
    """The rules one after the other, each from every place, with a scan for each identifier that follows."""
    used, out = set(), []
    for licence, wanted in rules:
        for k, first in enumerate(found):
            if k in used or first[3] != wanted[0]:
                continue
            taken = [k]
            for name in wanted[1:]:
                nxt = next((j for j in range(taken[-1] + 1, len(found)) if j not in used and found[j][3] == name), None)
                if nxt is None or found[nxt][0] - found[taken[-1]][4] - 1 > gap:
                    break
                taken.append(nxt)
            if len(taken) == len(wanted):
                used.update(taken)
                out.append((first[1], found[taken[-1]][2], licence, "+".join(wanted)))
    return sorted(out)


def test_matches_equal_the_plain_ones():
    import random

    rng = random.Random(8)
    names_ = ["MIT-GRANT", "MIT-NOTICE", "AS-IS-MIT", "BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES", "GPL-HOPE", "GPL-2-PLUS"]
    for _ in range(400):
        found, number = [], 0
        for k in range(rng.randint(0, 25)):
            number += rng.choice([0, 1, 1, 1, 2, 5])
            found.append((number, 10 * k, 10 * k + 9, rng.choice(names_), number + rng.choice([0, 0, 1])))
            number = found[-1][4]
        assert R.matches(found) == plain_matches(found, RULES, R.gap)


def test_sentences_between_are_counted():
    """Up to GAP sentences with words may stand between; empty lines and further marks are none."""
    for between, one in ((0, True), (3, True), (4, False)):
        text = SENTENCES["MIT-GRANT"] + ":\n\n" + "Some words here.\n\n ... \n\n" * between + SENTENCES["MIT-NOTICE"] + "."
        assert ("MIT-GRANT+MIT-NOTICE" in [m[3] for m in R.scan(text)]) == one, between
    inner = "Intro. " + SENTENCES["APACHE-COPY"] + ". Then. Last words of all; " + SENTENCES["PROPRIETARY"]
    assert [(f[0], f[4]) for f in R.identifiers(inner)] == [(1, 1), (4, 4)]


def test_many_licences_in_one_text_cost_no_more_than_their_number():
    import time

    for sentences in (["MIT-GRANT"], ["MIT-GRANT", "MIT-NOTICE", "AS-IS-MIT"]):
        text = "".join(SENTENCES[s] + ". " for s in sentences) * (6000 // len(sentences))
        found = R.identifiers(text)
        began = time.time()
        assert len(R.matches(found)) == 6000 // len(sentences)
        assert time.time() - began < 2
